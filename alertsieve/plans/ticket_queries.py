"""Queries over tickets, alert groups and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertsieve.functions import tickets as tk
from alertsieve.functions.probs import from_label
from alertsieve.functions.random import keyed_uniform_sql
from alertsieve.operators import alerts as al
from alertsieve.operators import categories as ct
from alertsieve.operators import metrics as mt
from alertsieve.operators import splits as sp
from alertsieve.operators import text as tx
from alertsieve.operators.ordering import with_scalars
from alertsieve.plans.registry import R, query
from alertsieve.session import materialise, spread
from alertsieve.sources import readers as rd
from alertsieve.sources.tables import ALERTS_SQL, TICKETS_SQL, alerts, documents, table, ticket_text, tickets

_T = "WITH " + TICKETS_SQL
_A = "WITH " + ALERTS_SQL
STOP = ["the", "of", "and", "to", "in", "is", "on", "at", "it", "for", "by", "an", "as", "le", "la", "les", "un", "une", "de", "des", "du", "et", "que", "qui", "der", "die", "das", "und", "el", "los", "en", "se"]
_STOP_SQL = "[" + ",".join(f"'{w}'" for w in STOP) + "]"

# --- sources -----------------------------------------------------------------------------------


@query(
    "table_profile",
    "SELECT 'c_custkey' AS \"column\", 'bigint' AS type, count(*) AS n_rows, count(*) FILTER (WHERE c_custkey IS NULL) AS n_null, min(c_custkey)::VARCHAR AS min, max(c_custkey)::VARCHAR AS max FROM customer UNION ALL "
    "SELECT 'c_name', 'string', count(*), count(*) FILTER (WHERE c_name IS NULL), min(c_name), max(c_name) FROM customer UNION ALL "
    "SELECT 'c_nationkey', 'int', count(*), count(*) FILTER (WHERE c_nationkey IS NULL), min(c_nationkey)::VARCHAR, max(c_nationkey)::VARCHAR FROM customer UNION ALL "
    "SELECT 'c_mktsegment', 'string', count(*), count(*) FILTER (WHERE c_mktsegment IS NULL), min(c_mktsegment), max(c_mktsegment) FROM customer UNION ALL "
    "SELECT 'c_acctbal', 'double', count(*), count(*) FILTER (WHERE c_acctbal IS NULL), min(c_acctbal)::VARCHAR, max(c_acctbal)::VARCHAR FROM customer",
)
def table_profile(spark, d):
    return rd.profile(table(spark, d, "customer"))


@query(
    "incident_rollup",
    f"SELECT user_id AS incident, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS opened_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS updated_at, count(*) AS n_events, arg_max(event_type, ts) AS final_state, {R('arg_max(value, ts)')} AS final_priority FROM events GROUP BY user_id",
)
def incident_rollup(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("incident"), "ts", "event_id", F.col("event_type").alias("state"), F.col("value").alias("priority"))
    r = rd.roll_up_events(e, "incident", "ts", ["ts", "event_id"], ["state", "priority"])
    return r.select("incident", F.date_format("opened_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("opened_at"), F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated_at"), "n_events", "final_state", "final_priority")


@query("cap_per_project", "SELECT doc_id AS id, source AS project FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20")
def cap_per_project(spark, d):
    t = documents(spark, d).select(F.col("doc_id").alias("id"), F.col("source").alias("project"))
    return rd.cap_per_key(t, "project", ["id"], 20)


@query("usable_alerts", "SELECT event_id AS id, trunc(coalesce(try_cast(CASE WHEN event_type='error' THEN 'x' ELSE value::VARCHAR END AS DOUBLE), user_id))::BIGINT AS series_id FROM events")
def usable_alerts(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "x").otherwise(F.col("value").cast("string")).alias("first_key"), F.col("user_id").alias("second_key"))
    return rd.usable_alerts(e, "first_key", "second_key").select("id", "series_id")


@query(
    "usage_costs",
    f"""WITH c AS (SELECT role AS model, CASE WHEN role='user' THEN length(text) ELSE 0 END AS ti, CASE WHEN role='user' THEN 0 ELSE length(text) END AS tn FROM conversations),
p(model, a, b) AS (VALUES ('user', 0.6::DOUBLE, 2.2::DOUBLE), ('assistant', 1.0::DOUBLE, 3.2::DOUBLE)),
u AS (SELECT c.model, count(*) AS n_calls, sum(ti)::BIGINT AS tokens_in, sum(tn)::BIGINT AS tokens_out, sum(ti*coalesce(a,0)/1e6 + tn*coalesce(b,0)/1e6) AS cost FROM c LEFT JOIN p USING (model) GROUP BY c.model)
SELECT model, n_calls, tokens_in, tokens_out, {R('cost')} AS cost, {R('50.0::DOUBLE - sum(cost) OVER ()')} AS budget_left FROM u""",
)
def usage_costs(spark, d):
    c = table(spark, d, "conversations")
    n = F.length("text")
    calls = c.select(F.col("role").alias("model"), F.when(F.col("role") == "user", n).otherwise(0).alias("tokens_in"), F.when(F.col("role") == "user", 0).otherwise(n).alias("tokens_out"))
    return rd.usage(rd.token_cost(calls, tx.prices(spark, {"user": (0.6, 2.2), "assistant": (1.0, 3.2)})), 50.0)


# --- filters, splits ------------------------------------------------------------------------------


@query("noise_filter", _T + " SELECT id, resolution FROM tickets WHERE upper(coalesce(CASE resolution WHEN 'F' THEN 'Duplicate' WHEN 'P' THEN NULL ELSE 'FIXED' END,'')) NOT IN ('INVALID','DUPLICATE','WONTFIX','WORKSFORME','INCOMPLETE')")
def noise_filter(spark, d):
    t = tickets(spark, d).select("id", "resolution")
    named = F.when(F.col("resolution") == "F", "Duplicate").when(F.col("resolution") == "P", None).otherwise("FIXED")
    return t.where(~tk.is_noise(named, "tracker_b"))


@query("closed_states", _T + " SELECT id, resolution, severity FROM tickets WHERE resolution IN ('F','P') AND severity <> '?' AND value IS NOT NULL")
def closed_states(spark, d):
    t = tickets(spark, d).where(F.col("resolution").isin("F", "P") & (F.col("severity") != "?") & F.col("value").isNotNull())
    return t.select("id", "resolution", "severity")


@query("frequent_classes", "SELECT doc_id AS id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) >= 50)")
def frequent_classes(spark, d):
    t = documents(spark, d).select(F.col("doc_id").alias("id"), "source")
    return ct.keep_frequent(t, "source", 50)


@query("status_merge", "SELECT c_custkey AS id, CASE c_nationkey WHEN 8 THEN 4 WHEN 2 THEN 4 ELSE c_nationkey END AS status FROM customer WHERE c_nationkey NOT IN (0, 5)")
def status_merge(spark, d):
    c = table(spark, d, "customer").where(~F.col("c_nationkey").isin(0, 5))
    return c.select(F.col("c_custkey").alias("id"), tk.merge_codes(F.col("c_nationkey"), tk.GROUP_STATUS_MERGE).alias("status"))


_SPLIT_SQL = _T + ", o AS (SELECT *, row_number() OVER (ORDER BY ts, id) - 1 AS r, count(*) OVER () AS n FROM tickets), s AS (SELECT *, CASE WHEN r < floor(n*0.6) THEN 'train' WHEN r < floor(n*0.8) THEN 'cal' ELSE 'test' END AS split FROM o) "


def split_tickets(spark, d):
    return sp.temporal_split(tickets(spark, d), ["ts", "id"], [0.6, 0.2, 0.2], ["train", "cal", "test"])


@query("temporal_split", _SPLIT_SQL + "SELECT id, split FROM s")
def temporal_split(spark, d):
    return split_tickets(spark, d).select("id", "split")


@query("split_summary", _SPLIT_SQL + "SELECT split, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_at FROM s GROUP BY split")
def split_summary(spark, d):
    s = sp.split_summary(split_tickets(spark, d), "ts")
    return s.select("split", "n", F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_at"), F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_at"))


@query("split_leakage_check", _SPLIT_SQL + "SELECT max(ts) FILTER (WHERE split='train') <= min(ts) FILTER (WHERE split='test') AS ok FROM s")
def split_leakage_check(spark, d):
    return sp.leakage_check(split_tickets(spark, d), "ts").select("ok")


@query("stratified_split", _T + f", o AS (SELECT id, severity, row_number() OVER (PARTITION BY severity ORDER BY {keyed_uniform_sql('id', 'split')}, id) - 1 AS r, count(*) OVER (PARTITION BY severity) AS n FROM tickets) SELECT id, CASE WHEN r < floor(n*0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM o")
def stratified_split(spark, d):
    return sp.stratified(tickets(spark, d).select("id", "severity"), "severity", "id", 0.8).select("id", "split")


@query("stratified_folds", _T + f" SELECT id, ((row_number() OVER (PARTITION BY severity ORDER BY {keyed_uniform_sql('id', 'fold')}, id) - 1) % 5)::INT AS fold FROM tickets")
def stratified_folds(spark, d):
    return sp.folds(tickets(spark, d).select("id", "severity"), "severity", "id", 5).select("id", "fold")


@query("leave_one_group_out", f"WITH g AS (SELECT source, count(*) AS n_test, sum(n_chars) AS s FROM documents GROUP BY source) SELECT source, n_test, sum(n_test) OVER () - n_test AS n_train, {R('s/n_test')} AS mean_test, {R('(sum(s) OVER () - s)/(sum(n_test) OVER () - n_test)')} AS mean_train FROM g")
def leave_one_group_out(spark, d):
    return sp.group_folds(documents(spark, d).select("source", "n_chars"), "source", "n_chars")


@query("semi_anti", "SELECT 'linked' AS side, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality=1) UNION ALL SELECT 'other', count(*), sum(n_chars)::BIGINT FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality=1)")
def semi_anti(spark, d):
    doc = documents(spark, d).select("doc_id", "n_chars")
    ids = table(spark, d, "labels").where("quality = 1").select("doc_id")

    def side(how: str, name: str):
        j = doc.join(ids, "doc_id", how)
        return j.agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))

    return side("left_semi", "linked").unionByName(side("left_anti", "other"))


@query("named_group_split", "SELECT CASE WHEN lang='en' THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM documents GROUP BY 1")
def named_group_split(spark, d):
    train, test = sp.leave_group_out(documents(spark, d).select("lang"), "lang", "en")
    return train.select(F.lit("train").alias("split")).unionByName(test.select(F.lit("test").alias("split"))).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# --- scalar features -------------------------------------------------------------------------------


@query(
    "ordinal_features",
    _T
    + """, s AS (SELECT id, CASE severity WHEN 'URGENT' THEN 'Blocker' WHEN 'HIGH' THEN 'Major' WHEN 'LOW' THEN 'Enhancement' WHEN 'MEDIUM' THEN NULL ELSE severity END AS sev, priority FROM tickets)
SELECT id, CASE lower(coalesce(sev,'normal')) WHEN 'blocker' THEN 5 WHEN 'critical' THEN 4 WHEN 'major' THEN 3 WHEN 'normal' THEN 2 WHEN 'minor' THEN 1 WHEN 'trivial' THEN 0 WHEN 'enhancement' THEN -1 ELSE 2 END AS severity_numeric,
 CASE priority WHEN 'P1' THEN 4 WHEN 'P2' THEN 3 WHEN 'P3' THEN 2 WHEN 'P4' THEN 1 WHEN 'P5' THEN 0 ELSE 2 END AS priority_numeric, (lower(coalesce(sev,'normal'))='enhancement')::INT AS is_enhancement, (lower(coalesce(sev,'normal')) IN ('blocker','critical'))::INT AS is_high_severity FROM s""",
)
def ordinal_features(spark, d):
    s = F.col("severity")
    sev = F.when(s == "URGENT", "Blocker").when(s == "HIGH", "Major").when(s == "LOW", "Enhancement").when(s == "MEDIUM", None).otherwise(s)
    low = F.lower(F.coalesce(sev, F.lit("normal")))
    return tickets(spark, d).select(
        "id",
        tk.severity_level(sev).alias("severity_numeric"),
        tk.priority_level(F.col("priority")).alias("priority_numeric"),
        (low == "enhancement").cast("int").alias("is_enhancement"),
        low.isin("blocker", "critical").cast("int").alias("is_high_severity"),
    )


@query("calendar_features", "SELECT event_id AS id, coalesce(hour(ts),12)::INT AS open_hour, coalesce(isodow(ts)-1,0)::INT AS open_dayofweek, coalesce(month(ts),1)::INT AS open_month FROM events")
def calendar_features(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), *[c.alias(n) for n, c in tk.calendar_features(F.col("ts")).items()])


_PARTS = "p AS (SELECT doc_id AS id, source, lang, split_part(text, chr(10), 1) AS s, CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10))+1) ELSE '' END AS de, text FROM documents)"


def _parts(spark, d):
    """First line as summary, the rest as description."""
    t = F.col("text")
    return documents(spark, d).select(
        F.col("doc_id").alias("id"),
        "source",
        "lang",
        "text",
        F.get(F.split(t, "\n", 2), F.lit(0)).alias("s"),
        F.coalesce(F.get(F.split(t, "\n", 2), F.lit(1)), F.lit("")).alias("de"),
    )


_WC = "len([w for w in regexp_split_to_array({x}, '[ \\t\\n\\r\\f]+') if w <> ''])"


@query("text_features", "WITH " + _PARTS + f", b AS (SELECT id, s || ' [SEP] ' || de AS t FROM p), z AS (SELECT id, split_part(t, ' [SEP] ', 1) AS s, split_part(t, ' [SEP] ', 2) AS de FROM b) SELECT id, length(s)::INT AS summary_length, {_WC.format(x='s')}::INT AS summary_word_count, length(de)::INT AS desc_length, {_WC.format(x='de')}::INT AS desc_word_count, (length(de) > 10)::INT AS has_description FROM z")
def text_features(spark, d):
    p = _parts(spark, d).select("id", tk.build_text(F.col("s"), F.col("de")).alias("t"))
    return p.select("id", *[c.alias(n) for n, c in tk.text_features(F.col("t")).items()])


@query("clean_text", r"""SELECT doc_id AS id, md5(trim(regexp_replace(regexp_replace(lower(text), 'http\S+|www\S+', '', 'g'), '[^a-z0-9]+', ' ', 'g'))) AS digest FROM documents""")
def clean_text(spark, d):
    return documents(spark, d).select(F.col("doc_id").alias("id"), F.md5(tk.clean_text(F.col("text"))).alias("digest"))


@query(
    "quality_flags",
    "WITH f AS (SELECT doc_id AS id, "
    + ", ".join(f"regexp_matches(text, '(?i){p}')::INT AS {n}" for n, p in tk.QUALITY_PATTERNS.items())
    + ", (length(text) > 200)::INT AS is_long FROM documents) SELECT *, has_steps+has_stacktrace+has_expected_actual+has_version+has_code_ref+is_long AS quality_score FROM f",
)
def quality_flags(spark, d):
    t = documents(spark, d)
    return t.select(F.col("doc_id").alias("id"), *[c.alias(n) for n, c in tk.quality_flags(F.col("text")).items()])


def _any(ws):
    return "list_has_any(w, [" + ",".join(f"'{x}'" for x in ws) + "])::INT"


@query(
    "lexical_flags",
    r"WITH l AS (SELECT doc_id AS id, text, [w for w in regexp_split_to_array(lower(text), '[ \t\n\r\f]+') if w <> ''] AS w FROM documents) "
    + f"SELECT id, len(w)::INT AS word_count, length(text)::INT AS char_count, {_any(tk.CRASH_WORDS)} AS has_crash, {_any(tk.ERROR_WORDS)} AS has_error, {_any(tk.REGRESSION_WORDS)} AS has_regression, "
    + r"(contains(text,'::') OR regexp_matches(text, '\w+\.\w+\('))::INT AS has_api_ref, (contains(text,'/') OR contains(text,'.cpp') OR contains(text,'.js') OR contains(text,'.h'))::INT AS has_file_path, 0 AS n_uppercase, (starts_with(text,'[') OR starts_with(text,'('))::INT AS starts_bracket FROM l",
)
def lexical_flags(spark, d):
    t = documents(spark, d)
    return t.select(F.col("doc_id").alias("id"), *[c.alias(n) for n, c in tk.lexical_flags(F.col("text")).items()])


def _cat_sql(col: str) -> str:
    hits = {n: "+".join(f"contains(lower({col}),'{k}')::INT" for k in ks) for n, ks in tk.KEYWORD_CATEGORIES.items()}
    best = "greatest(" + ",".join(f"({h})" for h in hits.values()) + ")"
    return f"CASE WHEN {col} IS NULL THEN 'unknown' WHEN {best}=0 THEN 'other' " + " ".join(f"WHEN ({h})={best} THEN '{n}'" for n, h in hits.items()) + " END"


@query("keyword_category", f"SELECT page_id AS id, {_cat_sql('html')} AS category FROM pages UNION ALL SELECT doc_id + 1000000000, {_cat_sql('text')} FROM documents")
def keyword_category(spark, d):
    p = spread(table(spark, d, "pages")).select(F.col("page_id").alias("id"), F.col("html").alias("t"))
    x = documents(spark, d).select((F.col("doc_id") + 1000000000).alias("id"), F.col("text").alias("t"))
    return p.unionByName(x).select("id", tk.keyword_category(F.col("t")).alias("category"))


@query(
    "magnitude_features",
    _A
    + f" SELECT summary_id, line, series_id, platform, {R('abs(new_value-prev_value)')} AS magnitude_abs, {R('abs((new_value-prev_value)*100.0::DOUBLE/nullif(prev_value,0))')} AS magnitude_pct_abs, {R('(new_value+prev_value)/2')} AS value_mean, {R('abs(ln(least(greatest(new_value/(prev_value+1e-10),0.01),100.0)))')} AS value_ratio_abs FROM alerts",
)
def magnitude_features(spark, d):
    a = alerts(spark, d)
    return a.select("summary_id", "line", "series_id", "platform", *[c.alias(n) for n, c in tk.change_magnitudes(F.col("new_value"), F.col("prev_value")).items()])


@query(
    "magnitude_zscores",
    _A
    + f", m AS (SELECT *, abs(new_value-prev_value) AS m FROM alerts), s AS (SELECT avg(m) AS a, stddev_samp(m) AS sd FROM m) SELECT summary_id, line, series_id, {R('(m-a)/sd')} AS z, (abs((m-a)/sd) > 2)::INT AS high, (abs((m-a)/sd) > 3)::INT AS extreme FROM m, s",
)
def magnitude_zscores(spark, d):
    m = alerts(spark, d).select("summary_id", "line", "series_id", F.abs(F.col("new_value") - F.col("prev_value")).alias("m"))
    m = with_scalars(m, m.agg(F.avg("m").alias("a"), F.stddev_samp("m").alias("sd")))
    z = (F.col("m") - F.col("a")) / F.col("sd")
    return m.select("summary_id", "line", "series_id", z.alias("z"), (F.abs(z) > 2).cast("int").alias("high"), (F.abs(z) > 3).cast("int").alias("extreme"))


@query(
    "rule_audit",
    _A
    + f", e AS (SELECT *, CASE WHEN lower_is_better THEN new_value > prev_value ELSE NOT (new_value > prev_value) END AS exp FROM alerts) SELECT lower_is_better, count(*) AS n, {R('avg((exp=is_regression)::INT)')} AS match_rate, {R('avg(is_regression::INT) FILTER (WHERE new_value > prev_value)')} AS rate_up, {R('avg(is_regression::INT) FILTER (WHERE new_value <= prev_value)')} AS rate_not_up FROM e GROUP BY lower_is_better",
)
def rule_audit(spark, d):
    up, reg = F.col("new_value") > F.col("prev_value"), F.col("is_regression").cast("int")
    e = tk.expected_regression(F.col("new_value"), F.col("prev_value"), F.col("lower_is_better"))
    return alerts(spark, d).groupBy("lower_is_better").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((e == F.col("is_regression")).cast("int")).alias("match_rate"),
        F.avg(F.when(up, reg)).alias("rate_up"),
        F.avg(F.when(~up, reg)).alias("rate_not_up"),
    )


@query("alert_targets", "SELECT c_custkey AS id, (CASE WHEN c_acctbal > 0 THEN c_custkey END IS NOT NULL)::INT AS has_bug, (c_nationkey IN (1,2,4))::INT AS is_valid, (c_nationkey = 3)::INT AS is_invalid FROM customer WHERE c_nationkey <> 0")
def alert_targets(spark, d):
    c = table(spark, d, "customer").where("c_nationkey <> 0")
    bug = F.when(F.col("c_acctbal") > 0, F.col("c_custkey"))
    return c.select(F.col("c_custkey").alias("id"), *[x.alias(n) for n, x in tk.alert_targets(F.col("c_nationkey"), bug).items()])


# --- answers -----------------------------------------------------------------------------------------


@query("answer_normalise", "WITH n AS (SELECT DISTINCT source AS name FROM documents), a AS (SELECT doc_id AS id, trim(CASE WHEN doc_id%3=0 THEN '  ' || upper(source) || ' ' WHEN doc_id%3=1 THEN '\"' || source || '\"' ELSE 'I think ' || source || '.' END, ' \"') AS t FROM documents) SELECT id, coalesce(max(name) FILTER (WHERE name=t), min(name) FILTER (WHERE lower(name)=lower(t)), min(name) FILTER (WHERE contains(lower(name),lower(t)) OR contains(lower(t),lower(name)))) AS label FROM a, n GROUP BY id")
def answer_normalise(spark, d):
    doc = documents(spark, d)
    names = tx.bounded_labels(doc, "source")
    s = F.col("source")
    a = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("  "), F.upper(s), F.lit(" "))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('"'), s, F.lit('"')))
    a = a.otherwise(F.concat(F.lit("I think "), s, F.lit(".")))
    return tk.match_label(doc.select(F.col("doc_id").alias("id"), a.alias("answer")), F.col("answer"), names).select("id", "label")


_KS = [str(i) for i in range(10, 60)]


@query(
    "json_answer",
    "WITH n AS (SELECT unnest([" + ",".join(f"'{k}'" for k in _KS) + "]) AS name) SELECT event_id AS id, coalesce(max(name) FILTER (WHERE name = json_extract_string(props, '$.k')), min(name) FILTER (WHERE contains(props, name)), '10') AS label FROM events, n GROUP BY event_id",
)
def json_answer(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "props")
    return tk.json_label(e, F.col("props"), _KS, "k").select("id", "label")


@query("answer_probs", "SELECT event_id AS id, CASE WHEN v IN (1,2,3,4) THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END AS p_max, CASE v WHEN 0 THEN 0.8::DOUBLE WHEN 1 THEN 0.05::DOUBLE WHEN 2 THEN 0.05::DOUBLE WHEN 3 THEN 0.05::DOUBLE WHEN 4 THEN 0.05::DOUBLE ELSE 0.2::DOUBLE END AS p0 FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'view' THEN 4 END AS v FROM events)")
def answer_probs(spark, d):
    t = F.col("event_type")
    lab = F.when(t == "click", 1).when(t == "error", 2).when(t == "purchase", 3).when(t == "view", 4)
    p = from_label(lab, 5)
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.array_max(p).alias("p_max"), p[0].alias("p0"))


@query("self_consistency_vote", f"WITH c AS (SELECT l_orderkey AS id, l_returnflag AS a, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, a) AS r, sum(n) OVER (PARTITION BY id) AS t, count(*) OVER (PARTITION BY id) AS u FROM c) SELECT id, a AS prediction, {R('n/t')} AS confidence, t::BIGINT AS n_samples, u AS n_unique FROM r WHERE r=1")
def self_consistency_vote(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("a"))
    return tx.majority_vote(li, "id", "a")


@query("prompt_texts", "WITH " + _PARTS + " SELECT id, md5('Title: ' || s || CASE WHEN length(de) > 0 THEN chr(10) || 'Description: ' || de ELSE '' END || chr(10) || 'Product: ' || source || chr(10) || 'Severity: ' || lang) AS digest FROM p")
def prompt_texts(spark, d):
    return _parts(spark, d).select("id", F.md5(tk.prompt(F.col("s"), F.col("de"), F.col("source"), F.col("lang"))).alias("digest"))


@query("few_shot_examples", "WITH f AS (SELECT source AS label, min(doc_id) AS id FROM documents GROUP BY source), h AS (SELECT *, 0 AS o FROM f ORDER BY id LIMIT 5) SELECT label, id FROM h")
def few_shot_examples(spark, d):
    t = documents(spark, d).select(F.col("source").alias("label"), F.col("doc_id").alias("id"), "text")
    return tx.few_shot(t, "label", "id", "text", 5).select("label", "id")


# --- categories -----------------------------------------------------------------------------------------


@query("class_distribution", _T + f" SELECT severity, count(*) AS n, {R('count(*)*100.0/sum(count(*)) OVER ()')} AS percent FROM tickets GROUP BY severity")
def class_distribution(spark, d):
    return ct.distribution(tickets(spark, d), "severity")


_LM = "top AS (SELECT source FROM documents WHERE doc_id%5 < 3 GROUP BY source ORDER BY count(*) DESC, source LIMIT 8), lm AS (SELECT source, (row_number() OVER (ORDER BY source)-1)::INT AS label FROM top)"


def _train_docs(doc):
    return doc.where(F.col("doc_id") % 5 < 3)


@query("label_map_topk", "WITH " + _LM + " SELECT doc_id AS id, coalesce(label, 8) AS label, CASE WHEN label IS NULL THEN 'Other' ELSE d.source END AS source_mapped FROM documents d LEFT JOIN lm USING (source)")
def label_map_topk(spark, d):
    doc = documents(spark, d).select("doc_id", "source")
    m = ct.label_mapping(_train_docs(doc), "source", 8)
    return ct.apply_label_mapping(doc, m, "source", 8).select(F.col("doc_id").alias("id"), "label", "source_mapped")


@query("label_map_no_other", "WITH " + _LM + " SELECT doc_id AS id, label FROM documents d JOIN lm USING (source)")
def label_map_no_other(spark, d):
    doc = documents(spark, d).select("doc_id", "source")
    m = ct.label_mapping(_train_docs(doc), "source", 8)
    return ct.apply_label_mapping(doc, m, "source", 8, other=False).select(F.col("doc_id").alias("id"), "label")


@query("rare_group", "WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) SELECT p_partkey AS id, CASE WHEN n/(SELECT sum(n) FROM c) < 0.04 THEN 'Other' ELSE p_brand END AS p_brand FROM part JOIN c USING (p_brand)")
def rare_group(spark, d):
    return ct.group_rare(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand"), "p_brand", 0.04)


@query("rare_class_warnings", "WITH c AS (SELECT source, count(*) FILTER (WHERE doc_id%5<3) AS n_train, count(*) FILTER (WHERE doc_id%5=3) AS n_cal FROM documents WHERE doc_id%5<4 GROUP BY source) SELECT * FROM c WHERE n_train < 50 OR n_cal < 20")
def rare_class_warnings(spark, d):
    doc = documents(spark, d).select("doc_id", "source")
    return ct.rare_warnings(_train_docs(doc), doc.where(F.col("doc_id") % 5 == 3), "source")


@query("count_lookup", _T + " SELECT id, coalesce(n, 1) AS creator_count FROM tickets LEFT JOIN (SELECT creator, count(*) AS n FROM tickets WHERE resolution='F' GROUP BY creator) c USING (creator)")
def count_lookup(spark, d):
    t = tickets(spark, d)
    return ct.train_counts(t.where("resolution = 'F'").select("creator"), t.select("id", "creator"), "creator").select("id", "creator_count")


@query("freq_encode", f"SELECT p_partkey AS id, {R('count(*) OVER (PARTITION BY p_type)/count(*) OVER ()')} AS p_type_freq FROM part")
def freq_encode(spark, d):
    return ct.frequency_encode(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_type"), "p_type").select("id", "p_type_freq")


@query("label_encode", "WITH v AS (SELECT DISTINCT p_brand AS b FROM part WHERE p_size < 5 UNION SELECT 'unknown'), e AS (SELECT b, row_number() OVER (ORDER BY b)-1 AS c FROM v) SELECT p_partkey AS id, coalesce(c, (SELECT c FROM e WHERE b='unknown')) AS p_brand_enc FROM part LEFT JOIN e ON b=p_brand")
def label_encode(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size")
    enc = ct.label_encoder(p.where("p_size < 5"), "p_brand")
    return ct.label_encode(enc, p, "p_brand").select("id", "p_brand_enc")


@query("one_hot", "SELECT p_partkey AS id, " + ", ".join(f"(p_type='{v}')::INT AS \"p_type_{v}\"" for v in ["LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]) + " FROM part")
def one_hot(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_type")
    return ct.one_hot(p, "p_type")


@query("mode_encode", "SELECT p_partkey AS id, (p_type = (SELECT p_type FROM part GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 1))::INT AS p_type_is_mode FROM part")
def mode_encode(spark, d):
    return ct.mode_encode(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_type"), "p_type").select("id", "p_type_is_mode")


@query("standard_scale", f"WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd FROM orders WHERE o_orderstatus='F') SELECT o_orderkey AS id, {R('(o_totalprice-m)/sd')} AS value_std FROM orders, s")
def standard_scale(spark, d):
    t = tickets(spark, d)
    return ct.standardise(t.where("resolution = 'F'"), t, ["value"]).select("id", "value_std")


@query("min_max_scale", f"WITH s AS (SELECT min(o_totalprice) AS m, max(o_totalprice) AS x FROM orders WHERE o_orderstatus='F') SELECT o_orderkey AS id, {R('(o_totalprice-m)/(x-m)')} AS value_01 FROM orders, s")
def min_max_scale(spark, d):
    t = tickets(spark, d)
    return ct.min_max(t.where("resolution = 'F'"), t, ["value"]).select("id", "value_01")


@query("median_impute", _T + f", x AS (SELECT id, resolution, CASE WHEN severity='LOW' THEN NULL ELSE value END AS value FROM tickets) SELECT id, {R('coalesce(value, (SELECT quantile_cont(value, 0.5) FROM x WHERE resolution=$$F$$))')} AS value FROM x")
def median_impute(spark, d):
    t = tickets(spark, d).select("id", "resolution", F.when(F.col("severity") != "LOW", F.col("value")).alias("value"))
    return ct.apply_impute(t, ct.fit_impute(t.where("resolution = 'F'"), ["value"])).select("id", "value")


_IMPUTED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "median_impute_columns",
    "WITH x AS (SELECT " + ", ".join(f"CASE WHEN l_returnflag='R' OR l_linenumber={i + 1} THEN NULL ELSE {c} END AS {c}" for i, c in enumerate(_IMPUTED)) + " FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {R(f'(SELECT quantile_cont({c}, 0.5) FROM x)')} AS median, {R(f'avg(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM x)))')} AS mean FROM x" for c in _IMPUTED),
)
def median_impute_columns(spark, d):
    """Four columns imputed by the jobs of one."""
    li = table(spark, d, "lineitem")
    x = li.select(*[F.when((F.col("l_returnflag") != "R") & (F.col("l_linenumber") != i + 1), F.col(c)).alias(c) for i, c in enumerate(_IMPUTED)])
    fills = ct.fit_impute(x, _IMPUTED)
    row = fills.first()
    full = ct.apply_impute(x, fills).agg(*[F.avg(c).alias(c) for c in _IMPUTED])
    return full.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(row[c]).alias("median"), F.col(c).alias("mean")) for c in _IMPUTED])))


@query("null_ratios", _T + f", x AS (SELECT CASE WHEN severity='LOW' THEN NULL ELSE value END AS value, CASE WHEN resolution='F' THEN creator END AS creator FROM tickets) SELECT 'value' AS \"column\", {R('avg((value IS NULL)::INT)')} AS null_ratio FROM x UNION ALL SELECT 'creator', {R('avg((creator IS NULL)::INT)')} FROM x")
def null_ratios(spark, d):
    t = tickets(spark, d).select(F.when(F.col("severity") != "LOW", F.col("value")).alias("value"), F.when(F.col("resolution") == "F", F.col("creator")).alias("creator"))
    return ct.null_ratios(t, ["value", "creator"])


@query("class_weights", _T + f", c AS (SELECT resolution, count(*) AS n FROM tickets GROUP BY resolution) SELECT resolution, n, {R('least(sum(n) OVER () / (count(*) OVER () * n), 10.0)')} AS weight FROM c")
def class_weights(spark, d):
    return ct.class_weights(tickets(spark, d), "resolution")


@query("undersample", _T + f", o AS (SELECT id, resolution, row_number() OVER (PARTITION BY resolution ORDER BY {keyed_uniform_sql('id', 'under')}, id) AS r FROM tickets) SELECT id, resolution FROM o WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM tickets GROUP BY resolution))")
def undersample(spark, d):
    return ct.undersample(tickets(spark, d).select("id", "resolution"), "resolution", "id")


@query("target_rate", _T + f", r AS (SELECT creator, avg((severity='URGENT')::INT) AS r FROM tickets WHERE resolution='F' GROUP BY creator) SELECT id, {R('coalesce(r, (SELECT avg((severity=$$URGENT$$)::INT) FROM tickets WHERE resolution=$$F$$))')} AS rate FROM tickets LEFT JOIN r USING (creator)")
def target_rate(spark, d):
    t = tickets(spark, d)
    return ct.target_rate(t.where("resolution = 'F'"), t, "creator", (F.col("severity") == "URGENT").cast("int"), "rate").select("id", "rate")


_EP = _T + ", c AS (SELECT creator, severity, count(*) AS n FROM tickets WHERE resolution='F' GROUP BY ALL), pr AS (SELECT creator, severity, n/sum(n) OVER (PARTITION BY creator) AS share FROM c) "


@query("entity_profile", _EP + f"SELECT creator, severity, {R('share')} AS share FROM pr")
def entity_profile(spark, d):
    return ct.entity_profile(tickets(spark, d).where("resolution = 'F'"), "creator", "severity")


@query("profile_features", _EP + f", s AS (SELECT creator, -sum(share*log2(share)) AS e, max(share) AS m FROM pr GROUP BY creator) SELECT id, {R('coalesce(e, log2(5))')} AS profile_entropy, {R('coalesce(m, 0.2)')} AS profile_max, CASE WHEN e IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS profile_known FROM tickets LEFT JOIN s USING (creator)")
def profile_features(spark, d):
    t = tickets(spark, d)
    p = ct.entity_profile(t.where("resolution = 'F'"), "creator", "severity")
    return ct.profile_features(p, t.select("id", "creator"), "creator", 5).select("id", "profile_entropy", "profile_max", "profile_known")


@query("entity_mean", _T + f", m AS (SELECT creator, avg(value) AS m FROM tickets WHERE resolution='F' GROUP BY creator), g AS (SELECT avg(value) AS g FROM tickets WHERE resolution='F') SELECT id, {R('coalesce(m, g)')} AS value_mean, {R('value-coalesce(m, g)')} AS value_diff FROM tickets LEFT JOIN m USING (creator), g")
def entity_mean(spark, d):
    t = tickets(spark, d)
    return ct.entity_mean(t.where("resolution = 'F'"), t.select("id", "creator", "value"), "creator", "value").select("id", "value_mean", "value_diff")


# --- alert groups -----------------------------------------------------------------------------------------


@query(
    "group_rollup",
    _A
    + f""", b AS (SELECT summary_id, count(*) AS group_size, {R('avg(new_value)')} AS new_value_mean, {R('max(new_value)')} AS new_value_max, {R('min(new_value)')} AS new_value_min, {R('stddev_samp(new_value)')} AS new_value_std, sum(is_regression::INT)::BIGINT AS is_regression_sum, {R('avg(is_regression::INT)')} AS is_regression_ratio, count(DISTINCT status) AS n_unique_status, count(DISTINCT platform) AS n_unique_platform FROM alerts GROUP BY summary_id),
s AS (SELECT summary_id, status, count(*) AS n FROM alerts GROUP BY summary_id, status QUALIFY row_number() OVER (PARTITION BY summary_id ORDER BY n DESC, status)=1), p AS (SELECT summary_id, platform, count(*) AS n FROM alerts GROUP BY summary_id, platform QUALIFY row_number() OVER (PARTITION BY summary_id ORDER BY n DESC, platform)=1)
SELECT b.*, s.status AS dominant_status, p.platform AS dominant_platform FROM b JOIN s USING (summary_id) JOIN p USING (summary_id)""",
)
def group_rollup(spark, d):
    return al.group_rollup(alerts(spark, d), "summary_id", ["new_value"], ["is_regression"], ["status", "platform"])


_ORD = "ts, line, series_id, platform, new_value, prev_value"
ORD = ["ts", "line", "series_id", "platform", "new_value", "prev_value"]


@query("primary_downstream", _A + f", r AS (SELECT *, row_number() OVER (PARTITION BY summary_id ORDER BY {_ORD}) AS r FROM alerts) SELECT summary_id, line, series_id, platform, {R('new_value')} AS new_value, r=1 AS is_primary, r>1 AS is_downstream FROM r")
def primary_downstream(spark, d):
    m = al.mark_primary(alerts(spark, d).select("summary_id", *ORD), "summary_id", ORD)
    return m.select("summary_id", "line", "series_id", "platform", "new_value", "is_primary", "is_downstream")


@query(
    "primary_vs_downstream",
    _A + f", r AS (SELECT *, row_number() OVER (PARTITION BY summary_id ORDER BY {_ORD}) AS r FROM alerts) SELECT CASE WHEN r=1 THEN 'primary' ELSE 'downstream' END AS role, count(*) AS n, {R('avg(abs(new_value-prev_value))')} AS mean_magnitude, {R('avg(is_regression::INT)')} AS regression_rate FROM r GROUP BY 1",
)
def primary_vs_downstream(spark, d):
    m = al.mark_primary(alerts(spark, d).select("summary_id", *ORD, "is_regression"), "summary_id", ORD)
    role = F.when(F.col("is_primary"), "primary").otherwise("downstream")
    return m.groupBy(role.alias("role")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("new_value") - F.col("prev_value"))).alias("mean_magnitude"), F.avg(F.col("is_regression").cast("int")).alias("regression_rate"))


@query(
    "downstream_distance",
    _A
    + f""", r AS (SELECT *, row_number() OVER (PARTITION BY summary_id ORDER BY {_ORD}) AS r FROM alerts), j AS (SELECT d.summary_id, sqrt((d.new_value-p.new_value)**2+(d.prev_value-p.prev_value)**2+(d.quantity-p.quantity)**2) AS dist FROM r d JOIN r p ON d.summary_id=p.summary_id AND p.r=1 WHERE d.r>1)
SELECT summary_id, count(*) AS n_downstream, {R('avg(dist)')} AS avg_distance, {R('min(dist)')} AS min_distance, {R('max(dist)')} AS max_distance FROM j GROUP BY summary_id""",
)
def downstream_distance(spark, d):
    return al.downstream_distance(alerts(spark, d), "summary_id", [*ORD, "quantity"], ["new_value", "prev_value", "quantity"])


@query("cluster_coherence", _A + f", c AS (SELECT summary_id, status, count(*) AS n FROM alerts GROUP BY ALL) SELECT summary_id, sum(n)::BIGINT AS n_alerts, count(*) AS n_clusters, {R('max(n)/sum(n)')} AS coherence, count(*)=1 AS all_same FROM c GROUP BY summary_id HAVING sum(n) > 1")
def cluster_coherence(spark, d):
    return al.cluster_coherence(alerts(spark, d), "summary_id", "status")


@query("status_share", _A + f" SELECT status, count(*) AS n, {R('count(*)*100.0/sum(count(*)) OVER ()')} AS percent, {R('avg(abs(new_value-prev_value))')} AS mean_magnitude, {R('avg(is_regression::INT)')} AS bug_rate FROM alerts GROUP BY status")
def status_share(spark, d):
    g = alerts(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("new_value") - F.col("prev_value"))).alias("mean_magnitude"), F.avg(F.col("is_regression").cast("int")).alias("bug_rate"))
    g = with_scalars(g, g.agg(F.sum("n").alias("_t")))
    return g.select("status", "n", (F.col("n") * 100.0 / F.col("_t")).alias("percent"), "mean_magnitude", "bug_rate")


_REL = "rel AS (SELECT o_orderkey AS summary_id, o_custkey AS cust, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS related_id FROM orders)"


def related(spark, d):
    """summary_id and the previous order of the same customer as its related group."""
    from alertsieve.operators.ordering import ordered

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("summary_id"), F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("ts"))
    w = ordered(o, ["cust"], ["ts", "summary_id"], before=1)
    return w.with_columns({"related_id": w.lag("summary_id")}).result().select("summary_id", "cust", "related_id")


@query("related_pairs", "WITH " + _REL + " SELECT summary_id, related_id FROM rel WHERE related_id IS NOT NULL")
def related_pairs(spark, d):
    return al.related_pairs(related(spark, d), "summary_id", "related_id").select("summary_id", "related_id")


@query(
    "related_chains",
    "WITH RECURSIVE " + _REL + ", ch AS (SELECT summary_id, summary_id AS last, summary_id::VARCHAR AS path, 1 AS n FROM rel UNION ALL SELECT c.summary_id, r.related_id, c.path || '>' || r.related_id, n+1 FROM ch c JOIN rel r ON r.summary_id=c.last WHERE r.related_id IS NOT NULL AND n <= 5) SELECT summary_id, max(n)::INT AS length, arg_max(path, n) AS path FROM ch GROUP BY summary_id HAVING max(n) > 1",
)
def related_chains(spark, d):
    c = al.related_chains(related(spark, d), "summary_id", "related_id", 5)
    return c.select("summary_id", F.size("path").alias("length"), F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query("relation_stats", "WITH " + _REL + f", g AS (SELECT cust, count(*) AS n, count(related_id) AS r FROM rel GROUP BY cust) SELECT sum(n)::BIGINT AS total_alerts, count(*) AS total_summaries, {R('avg(n)')} AS avg_alerts, max(n) AS max_alerts, count(*) FILTER (WHERE n=1) AS single_alert_summaries, count(*) FILTER (WHERE n>1) AS multi_alert_summaries, sum(r)::BIGINT AS alerts_with_related, {R('sum(r)/sum(n)')} AS related_ratio FROM g")
def relation_stats(spark, d):
    return al.relation_stats(related(spark, d), "cust", "related_id")


@query("alert_graph", "WITH " + _REL + ", e AS (SELECT 'summary_' || cust AS group_key, summary_id AS alert_id FROM rel UNION ALL SELECT 'related_' || (related_id % 500), summary_id FROM rel WHERE related_id IS NOT NULL AND related_id % 500 <> cust), n AS (SELECT group_key, count(*) AS group_size FROM e GROUP BY group_key HAVING count(*) > 1) SELECT group_key, alert_id, group_size FROM e JOIN n USING (group_key)")
def alert_graph(spark, d):
    r = related(spark, d).withColumn("rel", F.col("related_id") % 500)
    return al.alert_graph(r, "summary_id", "cust", "rel")


@query("alert_bug_join", _A + f", b AS (SELECT p_partkey, p_type, p_brand FROM part WHERE p_size < 10) SELECT coalesce(p_type,'unknown') AS component, count(*) AS n, count(p_partkey) AS n_linked, {R('avg(new_value)')} AS mean_value FROM alerts LEFT JOIN b ON series_id=p_partkey GROUP BY 1")
def alert_bug_join(spark, d):
    b = rd.filled_defaults(table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("series_id"), "p_type"), {"p_type": "unknown"})
    j = alerts(spark, d).select("series_id", "new_value").join(b, "series_id", "left")
    return j.groupBy(F.coalesce("p_type", F.lit("unknown")).alias("component")).agg(F.count(F.lit(1)).alias("n"), F.count("p_type").alias("n_linked"), F.avg("new_value").alias("mean_value"))


@query("summary_bug_join", _A + ", m AS (SELECT DISTINCT summary_id, series_id FROM alerts) SELECT p_brand AS component, count(DISTINCT summary_id) AS n_summaries, count(*) AS n_links FROM m JOIN part ON series_id=p_partkey GROUP BY 1")
def summary_bug_join(spark, d):
    m = materialise(alerts(spark, d).select("summary_id", "series_id").distinct())
    b = table(spark, d, "part").select(F.col("p_partkey").alias("series_id"), F.col("p_brand").alias("component"))
    return al.linked_components(m, b)


@query("first_row_lookup", _T + ", f AS (SELECT creator, severity AS first_severity FROM tickets WHERE resolution='O' QUALIFY row_number() OVER (PARTITION BY creator ORDER BY ts, id)=1) SELECT id, coalesce(first_severity, 'unknown') AS first_severity FROM tickets LEFT JOIN f USING (creator)")
def first_row_lookup(spark, d):
    """Lookup by the first row per key, with a default on a miss."""
    from alertsieve.operators.lookup import lookup_join
    from alertsieve.operators.topk import one_per_key

    t = tickets(spark, d)
    f = one_per_key(t.where("resolution = 'O'"), ["creator"], F.struct("ts", "id"), ["severity"]).withColumnRenamed("severity", "first_severity")
    return lookup_join(t.select("id", "creator"), f, ["creator"], "left").select("id", F.coalesce("first_severity", F.lit("unknown")).alias("first_severity"))


@query("group_context", _A + f", g AS (SELECT summary_id, count(*) AS group_size, avg(new_value) AS m FROM alerts GROUP BY summary_id) SELECT summary_id, line, series_id, platform, group_size, {R('new_value-m')} AS rel FROM alerts JOIN g USING (summary_id)")
def group_context(spark, d):
    a = alerts(spark, d).select("summary_id", "line", "series_id", "platform", "new_value")
    g = a.groupBy("summary_id").agg(F.count(F.lit(1)).alias("group_size"), F.avg("new_value").alias("m"))
    return a.join(g, "summary_id", "left").select("summary_id", "line", "series_id", "platform", "group_size", (F.col("new_value") - F.col("m")).alias("rel"))


# --- matching alerts to series ------------------------------------------------------------------------------


def _sides(spark, d):
    e = table(spark, d, "events")
    left = e.where("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("user_id").alias("series_id"), "ts", F.col("value").alias("new_value"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    right = e.where("event_type = 'purchase'").select(F.col("event_id").alias("rid"), F.col("user_id").alias("series_id"), "ts", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return left, right


@query("asof_match", f"WITH l AS (SELECT event_id AS id, user_id, ts FROM events WHERE event_type='error'), r AS (SELECT event_id AS rid, user_id, ts, value FROM events WHERE event_type='purchase') SELECT l.id, r.rid AS match_rid, {R('r.value')} AS match_value FROM l ASOF LEFT JOIN r ON l.user_id=r.user_id AND l.ts >= r.ts")
def asof_match(spark, d):
    left, right = _sides(spark, d)
    return al.asof_join(left, right, "series_id", "ts", "rid", ["rid", "value"], "id").select("id", "match_rid", "match_value")


_BM = """WITH l AS (SELECT event_id AS id, user_id, ts, value, (props->>'k')::INT AS k FROM events WHERE event_type='error'),
r AS (SELECT user_id, value, (props->>'k')::INT AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS pos FROM events WHERE event_type='purchase'),
m AS (SELECT l.id, min(pos) FILTER (WHERE r.k=l.k) AS p0, min(pos) FILTER (WHERE floor(r.value)=floor(l.value)) AS p1, arg_min(pos, (abs(r.value-l.value), pos)) AS p2, min(abs(r.value-l.value)) AS dm, max(l.value) AS v FROM l LEFT JOIN r ON l.user_id=r.user_id GROUP BY l.id),
b AS (SELECT id, coalesce(p0, p1, CASE WHEN dm < 0.01::DOUBLE*abs(v) THEN p2 END) AS pos, CASE WHEN p0 IS NOT NULL THEN 0 WHEN p1 IS NOT NULL THEN 1 WHEN dm < 0.01::DOUBLE*abs(v) THEN 2 END AS rule FROM m) """


def _best(spark, d):
    from alertsieve.operators.ordering import ordered

    left, right = _sides(spark, d)
    pts = ordered(right, ["series_id"], ["ts", "rid"]).with_position("pos").result()
    left = left.withColumn("floor_value", F.floor("new_value"))
    pts = pts.withColumns({"rev": F.floor("value"), "push": F.col("k")})
    return left, al.best_match(left, pts, "series_id", [("k", "push"), ("floor_value", "rev")], "new_value"), pts


@query("best_match_fallback", _BM + "SELECT id, pos, rule FROM b")
def best_match_fallback(spark, d):
    return _best(spark, d)[1].select("id", "pos", "rule")


@query("match_funnel", _BM + "SELECT count(*) AS n_alerts, (SELECT count(*) FROM l WHERE user_id IN (SELECT user_id FROM r)) AS n_series_found, count(pos) AS n_indexed, count(*) FILTER (WHERE pos >= 5) AS n_valid, count(*) FILTER (WHERE pos IS NULL OR pos < 5) AS n_skipped FROM b")
def match_funnel(spark, d):
    left, m, pts = _best(spark, d)
    return al.match_funnel(left, m, pts, "series_id")


# --- terms ----------------------------------------------------------------------------------------------------

_TOK = "tok AS (SELECT doc_id AS id, source, [w for w in regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') if NOT list_contains(" + _STOP_SQL + ", w)] AS t FROM documents)"
_NG = _TOK + ", ng AS (SELECT id, unnest(list_concat(t, [x[1] || ' ' || x[2] for x in list_zip(t, t[2:]) if x[2] IS NOT NULL])) AS term FROM tok), tf AS (SELECT id, term, count(*) AS tf FROM ng GROUP BY ALL), nd AS (SELECT count(*) AS nd FROM documents)"
_TFIDF = _NG + ", vo AS (SELECT term, count(*) AS df, sum(tf) AS n FROM tf GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.95::DOUBLE*(SELECT nd FROM nd) ORDER BY n DESC, term LIMIT 500), w0 AS (SELECT id, term, (1+ln(tf))*(ln((1+nd)/(1+df))+1) AS w FROM tf JOIN vo USING (term), nd), w AS (SELECT id, term, w/sqrt(sum(w*w) OVER (PARTITION BY id)) AS weight FROM w0)"


def _weights(spark, d):
    doc = documents(spark, d).select(F.col("doc_id").alias("id"), "text")
    return tx.tfidf(doc, "id", F.col("text"), 500, 2, 2, 0.95, True, STOP)


@query("tfidf_weights", "WITH " + _TFIDF + f" SELECT id, term, {R('weight')} AS weight FROM w")
def tfidf_weights(spark, d):
    return _weights(spark, d)


@query("tfidf_top_terms", "WITH " + _TFIDF + f" SELECT term, {R('sum(weight)/(SELECT nd FROM nd)')} AS score FROM w GROUP BY term ORDER BY round(sum(weight)/(SELECT nd FROM nd), 9) DESC, term LIMIT 20")
def tfidf_top_terms(spark, d):
    return tx.top_terms(_weights(spark, d), 20, table(spark, d, "documents").count())


@query("frequent_terms", "WITH " + _TOK + ", u AS (SELECT unnest(t) AS term FROM tok) SELECT term, count(*) AS n FROM u WHERE length(term) >= 3 GROUP BY term ORDER BY n DESC, term LIMIT 20")
def frequent_terms(spark, d):
    return tx.frequent_terms(documents(spark, d), F.col("text"), 20, STOP)


_KP = _TOK + ", se AS (SELECT id, source, unnest(list_distinct(t)) AS term FROM tok), tp AS (SELECT term, count(*) AS dd FROM se GROUP BY term HAVING count(*) >= 5 ORDER BY dd DESC, term LIMIT 200), kp AS (SELECT term, source, count(*)/max(dd) AS share FROM se JOIN tp USING (term) GROUP BY ALL)"


@query("keyword_profile", "WITH " + _KP + f" SELECT term, source, {R('share')} AS share FROM kp")
def keyword_profile(spark, d):
    doc = documents(spark, d).select(F.col("doc_id").alias("id"), "source", "text")
    return tx.keyword_profile(doc, "id", F.col("text"), "source", 200, 5, STOP)


@query("keyword_features", "WITH " + _KP + f", x AS (SELECT se.id, kp.source, sum(share) AS s FROM se JOIN kp USING (term) GROUP BY ALL) SELECT id, source, {R('s/sum(s) OVER (PARTITION BY id)')} AS share FROM x")
def keyword_features(spark, d):
    doc = documents(spark, d).select(F.col("doc_id").alias("id"), "source", "text")
    p = tx.keyword_profile(doc, "id", F.col("text"), "source", 200, 5, STOP)
    return tx.keyword_features(p, doc.select("id", "text"), "id", F.col("text"), "source", STOP)


@query("correlations", f"SELECT {R('corr(l_quantity, l_extendedprice)')} AS quantity_price, {R('corr(l_quantity, l_discount)')} AS quantity_discount, {R('corr(l_extendedprice, l_tax)')} AS price_tax FROM lineitem")
def correlations(spark, d):
    return table(spark, d, "lineitem").agg(F.corr("l_quantity", "l_extendedprice").alias("quantity_price"), F.corr("l_quantity", "l_discount").alias("quantity_discount"), F.corr("l_extendedprice", "l_tax").alias("price_tax"))


@query("majority_by_segment", _T + f", c AS (SELECT severity, resolution, count(*) AS n FROM tickets GROUP BY ALL) SELECT severity, arg_max(resolution, n) AS majority, {R('max(n)/sum(n)')} AS majority_accuracy FROM c GROUP BY severity")
def majority_by_segment(spark, d):
    c = mt.confusion_matrix(tickets(spark, d), "severity", "resolution")
    return c.groupBy(F.col("label").alias("severity")).agg(F.max_by("pred", "n").alias("majority"), (F.max("n") / F.sum("n")).alias("majority_accuracy"))


@query("documents_linked_text", "SELECT t.source AS component, count(*) AS n, sum(l.quality)::BIGINT AS n_quality FROM documents t JOIN labels l USING (doc_id) GROUP BY 1")
def documents_linked_text(spark, d):
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    return ticket_text(spark, d).select("id", "component").join(lab, "id").groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("n_quality"))
