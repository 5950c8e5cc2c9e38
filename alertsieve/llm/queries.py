"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertsieve.llm import collocations, decontaminate, divergence, jaccard, language, licenses, lm_scoring, quality, sentencepiece_fst, sharding, token_counts, token_output, url_rules
from alertsieve.llm.common import bucket, read

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLE: dict[str, str] = {}
SHARDS = 24


def llm_query(name: str, sql: str | None = None):
    def add(fn):
        LLM_QUERIES[name] = fn
        if sql:
            LLM_ORACLE[name] = sql.strip()
        return fn

    return add


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


@llm_query("op9_token_output")
def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_output.write_shards(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return token_output.read_shards(shards)


@llm_query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = bucket(F.col("doc_id"), 5) == 0
    model = language.fit(docs.where(~held))
    scored = language.predict(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@llm_query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


@llm_query("op4_ngram_jaccard")
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


@llm_query("op7_benchmark_leaks")
def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@llm_query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_file("piece_bpe_32k.model")
    coded = sentencepiece_fst.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), model)
    back = sentencepiece_fst.decode(coded, model)
    ids = F.concat_ws(",", F.col("piece_ids").cast("array<string>"))
    return back.select("doc_id", F.size("piece_ids").cast("bigint").alias("n_pieces"), F.crc32(ids.cast("binary")).alias("ids_crc32"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


@llm_query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


#: host, path, verdict (fixed values)
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
_URL_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


@llm_query(
    "op2_url_rules",
    f"""
WITH rules(h, p, v) AS (VALUES {_URL_RULES_SQL}),
u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT host, path, max(struct_pack(n := length(h) + length(p), k := length(h), rule := h || p, verdict := v)) AS best
  FROM (SELECT DISTINCT host, path FROM u) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, u.host, u.path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM u LEFT JOIN m ON u.host = m.host AND u.path = m.path
""",
)
def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(read(spark, sf_dir, "pages"), url_rules.rule_table(spark, URL_RULES))


#: license, text of its notice (fixed values)
LICENSES = [
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "Released under the MIT License."),
]
_LICENSES_SQL = ", ".join(f"('{k}', '{t}')" for k, t in LICENSES)
_SCAN_SQL = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda x: x <> '')"


def _shingles_sql(key: str, rows: str) -> str:
    """Distinct windows of three words of each text, or the whole of a shorter one, as (key, s)."""
    return f"""SELECT DISTINCT {key}, CASE WHEN n >= 3 THEN x || ' ' || y || ' ' || z ELSE whole END AS s FROM (
  SELECT {key}, n, whole, i, x, lead(x, 1) OVER p AS y, lead(x, 2) OVER p AS z
  FROM (SELECT {key}, len(w) AS n, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') END AS whole, unnest(w) AS x, generate_subscripts(w, 1) AS i
    FROM (SELECT {key}, {_SCAN_SQL} AS w FROM {rows}))
  WINDOW p AS (PARTITION BY {key} ORDER BY i)) WHERE n < 3 OR z IS NOT NULL"""


@llm_query(
    "op10_license_scan",
    f"""
WITH t AS ({_shingles_sql("license", f"(VALUES {_LICENSES_SQL}) v(license, text)")}),
m AS (SELECT license, count(*) AS m FROM t GROUP BY license),
d AS ({_shingles_sql("doc_id", "documents")})
SELECT doc_id, license, count(*) / any_value(m)::DOUBLE AS containment
FROM d JOIN t USING (s) JOIN m USING (license) GROUP BY doc_id, license HAVING count(*) >= 0.8 * any_value(m)
""",
)
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"), licenses.template_table(spark, LICENSES))


@llm_query("op1_lm_scoring")
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = bucket(F.col("doc_id"), 7) == 2
    scored = lm_scoring.score(read(spark, sf_dir, "documents"), ~held)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@llm_query(
    "op11_collocations",
    rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
o AS (SELECT lang, id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM p),
g AS (SELECT lang, x, lead(x, 1) OVER s AS y, lead(x, 2) OVER s AS z FROM o WINDOW s AS (PARTITION BY id ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM o GROUP BY lang),
u AS (SELECT lang, x, count(*) AS f FROM g GROUP BY lang, x),
b AS (SELECT lang, x, y, count(*) AS f FROM g WHERE y IS NOT NULL GROUP BY lang, x, y HAVING count(*) >= 10),
t AS (SELECT lang, x, y, z, count(*) AS f FROM g WHERE z IS NOT NULL GROUP BY lang, x, y, z HAVING count(*) >= 10),
m AS (SELECT lang, x, y, max(f) AS most FROM (SELECT lang, x, y, f FROM t UNION ALL SELECT lang, y, z, f FROM t) GROUP BY lang, x, y),
two AS (SELECT b.lang, b.x || ' ' || b.y AS phrase, b.f AS a, l.f AS l, r.f AS r FROM b JOIN u l ON l.lang = b.lang AND l.x = b.x
  JOIN u r ON r.lang = b.lang AND r.x = b.y LEFT JOIN m ON m.lang = b.lang AND m.x = b.x AND m.y = b.y WHERE coalesce(100 * most < 50 * b.f, true)),
three AS (SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z AS phrase, t.f AS a, l.f AS l1, q.f AS r1, p.f AS l2, r.f AS r2 FROM t
  JOIN u l ON l.lang = t.lang AND l.x = t.x JOIN u r ON r.lang = t.lang AND r.x = t.z
  JOIN b p ON p.lang = t.lang AND p.x = t.x AND p.y = t.y JOIN b q ON q.lang = t.lang AND q.x = t.y AND q.y = t.z),
c AS (SELECT lang, phrase, a, l, r, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM two UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2)
  FROM (SELECT *, (1000000::HUGEINT * a * a) // (l1::HUGEINT * r1) AS s1, (1000000::HUGEINT * a * a) // (l2::HUGEINT * r2) AS s2 FROM three)),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
SELECT k.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM k JOIN n ON n.lang = k.lang WHERE rank <= 2000
""",
)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


@llm_query(
    "op12_source_divergence",
    rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT id, lang, source, unnest(w) AS term FROM d),
v AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
k AS (SELECT lang, count(*) AS v FROM v GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN v USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, sum(n) AS s FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.s, 0) + 5 * k.v) AS p
  FROM g JOIN v ON g.lang = v.lang JOIN k ON g.lang = k.lang LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND v.term = c.term
  LEFT JOIN s ON g.lang = s.lang AND g.source = s.source),
q AS (SELECT c.lang, c.term, 1 + (1000000000::HUGEINT * (sum(c.n) + 5)) // (any_value(t.t) + 5 * any_value(k.v)) AS q
  FROM c JOIN k ON c.lang = k.lang JOIN (SELECT lang, sum(n) AS t FROM c GROUP BY lang) t ON c.lang = t.lang GROUP BY c.lang, c.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, (SELECT 0) + coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY a.lang, a.source, b.source),
r AS (SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value FROM pairs UNION ALL
  SELECT p.lang, p.source, 'term', p.term, (p.p - q.q)::BIGINT FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 50
""",
)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


@llm_query("op13_slot_shards")
def op13_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard(read(spark, sf_dir, "documents"), SHARDS)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


llm_query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
