"""Queries over series: window features, change points, forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertsieve.functions import arrays as ar
from alertsieve.operators import detect as dt
from alertsieve.operators import forecast as fc
from alertsieve.operators import metrics as mt
from alertsieve.operators import series as sr
from alertsieve.plans.registry import R, query
from alertsieve.session import materialise
from alertsieve.sources.tables import SERIES_SQL, series

_S = "WITH " + SERIES_SQL
def is_alert():
    return F.col("kind") == "error"


# --- window features -----------------------------------------------------------------------------

_W = _S + ", wn AS (SELECT a.eid AS id, a.value AS av, s.value AS v, s.pos - greatest(a.pos-20, 0) AS i, least(a.pos, 20) AS n FROM series a JOIN series s ON a.series_id=s.series_id AND s.pos BETWEEN a.pos-20 AND a.pos-1 WHERE a.kind='error') "


def windows(spark, d):
    return sr.pre_windows(series(spark, d), is_alert(), 20).withColumnRenamed("eid", "id")


@query("pre_alert_windows", _W + f"SELECT id, max(n)::INT AS size, {R('sum(v)')} AS total, {R('max(v) FILTER (WHERE i=0)')} AS first, {R('max(v) FILTER (WHERE i=n-1)')} AS last FROM wn GROUP BY id")
def pre_alert_windows(spark, d):
    w = F.col("w")
    return windows(spark, d).select("id", F.size(w).alias("size"), ar.total(w).alias("total"), F.get(w, F.lit(0)).alias("first"), F.element_at(w, -1).alias("last"))


_M = "m AS (SELECT *, avg(v) OVER (PARTITION BY id) AS m FROM wn), mo AS (SELECT id, max(n) AS n, max(m) AS m, max(av) AS av, avg((v-m)**2) AS m2, avg((v-m)**3) AS m3, avg((v-m)**4) AS m4, quantile_cont(v,0.5) AS med, quantile_cont(v,0.25) AS q1, quantile_cont(v,0.75) AS q3, min(v) AS lo, max(v) AS hi FROM m GROUP BY id)"


def _three(expr: str) -> str:
    return R(f"CASE WHEN n >= 3 THEN {expr} END")


@query(
    "window_stats",
    _W + ", " + _M
    + f" SELECT id, {_three('m')} AS ts_mean, {_three('med')} AS ts_median, {_three('sqrt(m2)')} AS ts_std, {_three('sqrt(m2)/nullif(m,0)')} AS ts_cv, {_three('lo')} AS ts_min, {_three('hi')} AS ts_max, {_three('hi-lo')} AS ts_range, {_three('q3-q1')} AS ts_iqr, {_three('m3/nullif(m2**1.5,0)')} AS ts_skew, {_three('CASE WHEN n > 3 THEN m4/nullif(m2*m2,0)-3 ELSE 0 END')} AS ts_kurtosis FROM mo",
)
def window_stats(spark, d):
    return sr.window_stats(windows(spark, d)).select("id", *sr.FEATURE_GROUPS["local_stats"])


@query(
    "change_metrics",
    _W + ", " + _M
    + f" SELECT id, {R('CASE WHEN n>=2 THEN av-m END')} AS ts_change_abs, {R('CASE WHEN n>=2 THEN (av-m)*100/nullif(m,0) END')} AS ts_change_pct, {R('CASE WHEN n>=2 AND m2>0 THEN (av-m)/sqrt(m2) END')} AS ts_zscore FROM mo",
)
def change_metrics(spark, d):
    return sr.change_metrics(windows(spark, d)).select("id", "ts_change_abs", "ts_change_pct", "ts_zscore")


@query(
    "slopes",
    _W
    + f", g AS (SELECT id, max(n) AS n, regr_slope(v,i) AS k, regr_r2(v,i) AS r2, regr_slope(v,i) FILTER (WHERE i < n//2) AS ke, regr_slope(v,i) FILTER (WHERE i >= n//2) AS kl FROM wn GROUP BY id) SELECT id, {_three('k')} AS ts_local_slope, {_three('r2')} AS ts_slope_r2, {R('CASE WHEN n//2 > 2 THEN ke END')} AS ts_early_slope, {R('CASE WHEN n//2 > 2 THEN kl END')} AS ts_late_slope, {R('CASE WHEN n//2 > 2 THEN kl-ke END')} AS ts_slope_diff FROM g",
)
def slopes(spark, d):
    return sr.slope_features(windows(spark, d)).select("id", *sr.FEATURE_GROUPS["slope_features"])


def _five(expr: str) -> str:
    return R(f"CASE WHEN n >= 5 THEN {expr} END")


@query(
    "stability",
    _W
    + f""", l AS (SELECT *, v - lag(v) OVER w AS dv, lag(v) OVER w AS pv FROM wn WINDOW w AS (PARTITION BY id ORDER BY i)), s AS (SELECT *, sign(dv) AS sg, lag(sign(dv)) OVER (PARTITION BY id ORDER BY i) AS ps FROM l),
g AS (SELECT id, max(n) AS n, count(*) FILTER (WHERE sg <> ps) AS dc, var_pop(v) FILTER (WHERE i >= n - greatest(n//3, 3)) AS rv, var_pop(v) AS av, corr(v, pv) AS ac FROM s GROUP BY id)
SELECT id, CASE WHEN n >= 5 THEN dc END AS ts_direction_changes, {_five('dc/(n-1)')} AS ts_direction_change_rate, {_five('rv/nullif(av,0)')} AS ts_variance_ratio, {_five('ac')} AS ts_autocorr_lag1 FROM g""",
)
def stability(spark, d):
    return sr.stability_features(windows(spark, d)).select("id", *sr.FEATURE_GROUPS["stability"])


@query(
    "drift",
    _W
    + f""", m AS (SELECT *, avg(v) OVER (PARTITION BY id) AS m FROM wn), c AS (SELECT *, sum(v-m) OVER (PARTITION BY id ORDER BY i) AS cs FROM m),
ew AS (SELECT a.id, a.i, max(a.v) - sum(b.v*0.7::DOUBLE**(a.i-b.i))/sum(0.7::DOUBLE**(a.i-b.i)) AS e FROM wn a JOIN wn b ON a.id=b.id AND b.i <= a.i GROUP BY a.id, a.i), es AS (SELECT id, stddev_pop(e) AS es FROM ew GROUP BY id),
g AS (SELECT id, max(n) AS n, max(cs) AS hi, min(cs) AS lo, regr_r2(v,i) AS r2 FROM c GROUP BY id) SELECT id, {_five('hi')} AS ts_cusum_max, {_five('lo')} AS ts_cusum_min, {_five('es')} AS ts_ewma_deviation, {_five('r2')} AS ts_trend_strength FROM g JOIN es USING (id)""",
)
def drift(spark, d):
    return sr.drift_features(windows(spark, d)).select("id", *sr.FEATURE_GROUPS["drift"])


@query(
    "direction_free_features",
    _W
    + f""", l AS (SELECT *, v - lag(v) OVER w AS dv, lag(v) OVER w AS pv, avg(v) OVER (PARTITION BY id) AS m, min(v) OVER (PARTITION BY id) AS lo, max(v) OVER (PARTITION BY id) AS hi FROM wn WINDOW w AS (PARTITION BY id ORDER BY i)), s AS (SELECT *, sign(dv) AS sg, lag(sign(dv)) OVER (PARTITION BY id ORDER BY i) AS ps, least(floor((v-lo)/CASE WHEN hi>lo THEN (hi-lo)/least(10,n) ELSE 1 END), least(10,n)-1) AS bin FROM l),
h AS (SELECT id, bin, count(*)/max(n) AS p FROM s GROUP BY id, bin), he AS (SELECT id, -sum(p*ln(p+1e-10)) AS ent FROM h GROUP BY id),
g AS (SELECT id, max(n) AS n, stddev_pop(dv) AS ds, avg(abs(dv)) AS da, count(*) FILTER (WHERE sg<>ps) AS dc, abs(regr_slope(v,i)) AS ta, corr(v,pv) AS ac, var_pop(v) FILTER (WHERE i < n//2) + 1e-10 AS va, var_pop(v) FILTER (WHERE i >= n//2) + 1e-10 AS vb, sum(abs(v-m)) AS cm FROM s GROUP BY id HAVING max(n) >= 3)
SELECT id, {R('ds')} AS ts_diff_std, {R('da')} AS ts_diff_mean_abs, dc AS ts_direction_changes, {R('ta')} AS ts_trend_abs, {R('CASE WHEN n > 3 THEN coalesce(ac,0) ELSE 0 END')} AS ts_autocorr, CASE WHEN n//2 > 1 THEN round(log10(greatest(va,vb)/least(va,vb)), 4)+0.0 ELSE 0.0::DOUBLE END AS log_variance_ratio, {R('cm')} AS ts_cusum_max, {R('ent')} AS ts_entropy FROM g JOIN he USING (id)""",
)
def direction_free_features(spark, d):
    f = sr.direction_free_features(windows(spark, d))
    return f.select("id", "ts_diff_std", "ts_diff_mean_abs", "ts_direction_changes", "ts_trend_abs", "ts_autocorr", F.round(F.log10("ts_variance_ratio"), 4).alias("log_variance_ratio"), "ts_cusum_max", "ts_entropy")


@query("filled_features", _W + ", " + _M + f", f AS (SELECT id, CASE WHEN n >= 3 THEN m3/nullif(m2**1.5,0) END AS ts_skew FROM mo) SELECT id, {R('coalesce(ts_skew, (SELECT quantile_cont(ts_skew, 0.5) FROM f), 0)')} AS ts_skew FROM f")
def filled_features(spark, d):
    return sr.fill_features(sr.window_stats(windows(spark, d)).select("id", "ts_skew"), ["ts_skew"])


@query("all_series_features")
def all_series_features(spark, d):
    f = sr.all_features(windows(spark, d))
    return f.select("id", "ts_window_size", *[c for g in sr.FEATURE_GROUPS.values() for c in g])


@query(
    "around_windows",
    _S + f", r AS (SELECT a.eid AS id, count(*) AS size, count(*) FILTER (WHERE s.pos < a.pos) AS true_pos, avg(s.value) AS mean FROM series a JOIN series s ON a.series_id=s.series_id AND s.pos BETWEEN a.pos-30 AND a.pos+19 WHERE a.kind='error' GROUP BY a.eid) SELECT id, size, true_pos, {R('mean')} AS mean FROM r WHERE size >= 20",
)
def around_windows(spark, d):
    w = sr.around_windows(series(spark, d), is_alert())
    return w.select(F.col("eid").alias("id"), F.size("signal").alias("size"), "true_pos", ar.mean(F.col("signal")).alias("mean"))


@query("signal_prep", _S + f", sm AS (SELECT *, avg(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS x FROM series), st AS (SELECT *, avg(x) OVER (PARTITION BY series_id) AS m, stddev_pop(x) OVER (PARTITION BY series_id) AS sd FROM sm) SELECT eid, {R('(x-m)/sd')} AS signal FROM st")
def signal_prep(spark, d):
    return sr.prepare_signal(series(spark, d), smooth=3).select("eid", "signal")


@query("lag_matrix", _S + f", l AS (SELECT eid, value, lag(value,1) OVER w AS lag_1, lag(value,2) OVER w AS lag_2, lag(value,3) OVER w AS lag_3 FROM series WINDOW w AS (PARTITION BY series_id ORDER BY pos)) SELECT eid, {R('lag_1')} AS lag_1, {R('lag_2')} AS lag_2, {R('lag_3')} AS lag_3 FROM l WHERE lag_3 IS NOT NULL")
def lag_matrix(spark, d):
    return sr.lag_matrix(series(spark, d), 3).select("eid", "lag_1", "lag_2", "lag_3")


@query(
    "sequence_pad",
    _W
    + f""", q AS (SELECT id, i + 25 - max(i+1) OVER (PARTITION BY id) AS j, v, avg(v) OVER (PARTITION BY id) AS m FROM wn), g AS (SELECT id, unnest(range(0,25)) AS j FROM (SELECT DISTINCT id FROM wn)), f AS (SELECT g.id, g.j, coalesce(q.v, x.m) AS v FROM g LEFT JOIN q ON g.id=q.id AND g.j=q.j JOIN (SELECT DISTINCT id, m FROM q) x ON g.id=x.id),
z AS (SELECT id, j, (v - avg(v) OVER (PARTITION BY id))/(stddev_pop(v) OVER (PARTITION BY id)+1e-8) AS z FROM f) SELECT id, count(*) AS n, {R('max(z) FILTER (WHERE j=24)')} AS last, {R('sum(z*z)')} AS energy FROM z GROUP BY id""",
)
def sequence_pad(spark, d):
    s = sr.sequences(windows(spark, d), 25)
    q = F.col("sequence")
    return s.select("id", F.size(q).cast("long").alias("n"), F.element_at(q, -1).alias("last"), F.aggregate(q, F.lit(0.0), lambda a, x: a + x * x).alias("energy"))


@query("last_points", _S + " SELECT series_id, eid FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC, eid DESC) AS r FROM series) WHERE r <= 40")
def last_points(spark, d):
    from alertsieve.sources.readers import last_points as tail

    return tail(series(spark, d), 40, ["series_id"], ["ts", "eid"]).select("series_id", "eid")


# --- change points ------------------------------------------------------------------------------------


def _win(w: int) -> str:
    p = "(PARTITION BY series_id ORDER BY pos ROWS BETWEEN {a} AND {b})"
    left, right, more = p.format(a=f"{w} PRECEDING", b="1 PRECEDING"), p.format(a="CURRENT ROW", b=f"{w - 1} FOLLOWING"), p.format(a="CURRENT ROW", b=f"{w} FOLLOWING")
    return f"avg(value) OVER {left} AS ml{w}, avg(value) OVER {right} AS mr{w}, var_pop(value) OVER {left} AS pl{w}, var_pop(value) OVER {right} AS pr{w}, (count(*) OVER {left} = {w} AND count(*) OVER {more} = {w + 1}) AS ok{w}"


def _t(w: int, cut: float) -> str:
    return f"abs(ml{w}-mr{w}) > {cut}::DOUBLE*sqrt((pl{w}+pr{w})*{w}/{w - 1}.0/{w})"


SQL_HITS = {
    "t_shift_10_2": (10, _t(10, 2.100922), 5),
    "t_shift_12_7": (12, _t(12, 7.0), 12),
    "t_shift_10_3": (10, _t(10, 3.0), 5),
    "effect_shift": (10, f"abs(mr10-ml10)/(sqrt((pl10+pr10)/2)+1e-10) > 0.5::DOUBLE AND {_t(10, 2.100922)}", 10),
    "mean_shift_2": (10, "pl10 > 0 AND abs(mr10-ml10) > 2.0*sqrt(pl10)", 10),
    "mean_shift_1": (10, "pl10 > 0 AND abs(mr10-ml10) > 1.0*sqrt(pl10)", 10),
    "hazard_shift": (10, "1-exp(-(abs(mr10-ml10)/nullif(sqrt(pl10),0))/10.0*10) > 0.5::DOUBLE", 5),
    "kl_shift": (5, "ln((sqrt(pr5)+1e-10)/(sqrt(pl5)+1e-10)) + ((sqrt(pl5)+1e-10)**2 + (ml5-mr5)**2)/(2*(sqrt(pr5)+1e-10)**2) - 0.5 > 1.0", 5),
    "variance_shift": (10, "least(pl10,pr10) > 0 AND greatest(pl10,pr10) > 2.0*least(pl10,pr10)", -1),
}
DETECTORS = [
    dt.t_shift(10, 2.0),
    dt.t_shift(12, 7.0, 12, test=False),
    dt.t_shift(10, 3.0, 5, test=False),
    dt.effect_shift(),
    dt.mean_shift(10, 2.0),
    dt.mean_shift(10, 1.0),
    dt.hazard_shift(hazard=10.0),
    dt.kl_shift(),
    dt.variance_shift(),
]
_BASE = SERIES_SQL + ", f AS (SELECT series_id, pos, " + ", ".join(_win(w) for w in (5, 10, 12)) + " FROM series)"


def _hits_sql(names) -> str:
    return _BASE + ", hits AS (" + " UNION ALL ".join(f"SELECT series_id, pos, '{n}' AS detector, {SQL_HITS[n][2]} AS gap FROM f WHERE ok{SQL_HITS[n][0]} AND ({SQL_HITS[n][1]})" for n in names) + ")"


_KEEP = ", k(series_id, detector, pos) AS (SELECT series_id, detector, min(pos) FROM hits GROUP BY 1, 2 UNION ALL SELECT k.series_id, k.detector, min(h.pos) FROM k JOIN hits h ON h.series_id=k.series_id AND h.detector=k.detector AND h.pos > k.pos AND h.pos - k.pos > h.gap GROUP BY k.series_id, k.detector) "


def positioned(spark, d):
    return sr.positioned(series(spark, d))


def stepped(spark, d):
    p = positioned(spark, d)
    return p.withColumn("value", F.col("value") + 200 * (F.floor(F.col("pos") / 30) % 2))


for _d in DETECTORS:

    def _run(spark, d, _d=_d):
        return dt.detect(stepped(spark, d) if _d.name == "t_shift_12_7" else positioned(spark, d), [_d])

    _sql = _hits_sql([_d.name])
    if _d.name == "t_shift_12_7":
        # t > 7 needs real level shifts: every other 30 points are raised
        _sql = _sql.replace(" FROM series)", " FROM stepped)").replace(", f AS (", ", stepped AS (SELECT series_id, pos, value + 200*((pos//30)%2) AS value FROM series), f AS (")
    query(f"detect_{_d.name}", "WITH RECURSIVE " + _sql + _KEEP + "SELECT series_id, detector, pos FROM k")(_run)


@query("raw_hits", "WITH " + _hits_sql(SQL_HITS) + " SELECT series_id, detector, pos FROM hits")
def raw_hits(spark, d):
    return dt.raw_hits(positioned(spark, d), DETECTORS).select("series_id", "detector", "pos")


@query("gap_suppress", "WITH RECURSIVE " + _hits_sql(SQL_HITS) + _KEEP + "SELECT detector, count(*) AS n_points, count(DISTINCT series_id) AS n_series, sum(pos)::BIGINT AS pos_sum FROM k GROUP BY detector")
def gap_suppress(spark, d):
    """All detectors in one pass, hits suppressed per series and detector."""
    k = dt.detect(positioned(spark, d), DETECTORS)
    return k.groupBy("detector").agg(F.count(F.lit(1)).alias("n_points"), F.count_distinct("series_id").alias("n_series"), F.sum("pos").alias("pos_sum"))


def _cusum_sql(th: float, dr: float) -> str:
    return _S + f""", z AS (SELECT series_id, pos, (value-avg(value) OVER p)/(stddev_pop(value) OVER p+1e-10) AS z, count(*) OVER p AS n FROM series WINDOW p AS (PARTITION BY series_id)),
s AS (SELECT series_id, pos, n, sum(CASE WHEN pos=0 THEN 0 ELSE z-{dr} END) OVER w AS su, sum(CASE WHEN pos=0 THEN 0 ELSE -z-{dr} END) OVER w AS sd FROM z WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
m AS (SELECT *, min(su) OVER w AS mu, min(sd) OVER w AS md FROM s WINDOW w AS (PARTITION BY series_id ORDER BY pos)) SELECT series_id, min(pos) AS pos FROM m WHERE n >= 10 AND (su-mu > {th} OR sd-md > {th}) GROUP BY series_id"""


@query("cusum", _cusum_sql(3.0, 0.5))
def cusum(spark, d):
    return dt.cusum(positioned(spark, d))


@query("cusum_no_drift", _cusum_sql(5.0, 0.0))
def cusum_no_drift(spark, d):
    return dt.cusum(positioned(spark, d), 5.0, 0.0)


#: thresholds and windows of the sensitivity tables (fixed values)
CUSUM_GRID = [2.0, 3.0, 5.0, 7.0, 10.0]
WINDOW_GRID = [5, 10, 15, 20]


@query(
    "cusum_thresholds",
    _cusum_sql(0.0, 0.5).replace(" SELECT series_id, min(pos) AS pos FROM m WHERE n >= 10 AND (su-mu > 0.0 OR sd-md > 0.0) GROUP BY series_id", "")
    + f" SELECT series_id, threshold, min(pos) AS pos FROM m JOIN (SELECT unnest({CUSUM_GRID}::DOUBLE[]) AS threshold) ON su-mu > threshold OR sd-md > threshold WHERE n >= 10 GROUP BY series_id, threshold",
)
def cusum_thresholds(spark, d):
    """First passage of a grid of thresholds, from one pass."""
    return dt.cusum_grid(positioned(spark, d), CUSUM_GRID)


@query("cusum_sensitivity")
def cusum_sensitivity(spark, d):
    """Precision, recall and F1 of each threshold against effect-size truth within 5."""
    p = positioned(spark, d)
    truth = materialise(dt.detect(p, [dt.effect_shift()])).select("series_id", "pos")
    name = F.concat(F.lit("cusum_"), F.col("threshold").cast("string"))
    hits = materialise(dt.cusum_grid(p, CUSUM_GRID).select("series_id", name.alias("detector"), "pos"))
    scores = dt.series_scores(hits, truth, 5, _population(p, [f"cusum_{t}" for t in CUSUM_GRID]).drop("n"))
    return dt.detector_summary(scores)


def _population(p, names):
    return p.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).select("series_id", "n", F.explode(F.array(*[F.lit(n) for n in names])).alias("detector"))


_COMPARED = [x.name for x in DETECTORS]


def _truth_and_hits(spark, d):
    p = positioned(spark, d)
    every = dt.detect(p, DETECTORS)
    every = materialise(every)
    truth = every.where("detector = 'effect_shift'").select("series_id", "pos")
    return truth, every.where("detector <> 'effect_shift'"), _population(p, [x.name for x in DETECTORS if x.name != "effect_shift"]).drop("n")


@query("detector_scores")
def detector_scores(spark, d):
    """Detectors against effect-size truth, nearest-first matching within 5."""
    truth, hits, pop = _truth_and_hits(spark, d)
    return dt.series_scores(hits, truth, 5, pop)


@query("detector_eval")
def detector_eval(spark, d):
    truth, hits, pop = _truth_and_hits(spark, d)
    return dt.detector_summary(dt.series_scores(hits, truth, 5, pop, nearest=False))


SENSITIVITY = [dt.t_shift(w, t, name=f"w{w}_t{t:g}") for w in (5, 10, 15, 20) for t in (2.0, 3.0, 5.0, 10.0)]


@query("detector_sensitivity")
def detector_sensitivity(spark, d):
    """Window sizes and thresholds side by side, all from one pass over the series."""
    p = positioned(spark, d)
    every = materialise(dt.detect(p, [*SENSITIVITY, dt.effect_shift()]))
    truth = every.where("detector = 'effect_shift'").select("series_id", "pos")
    s = dt.series_scores(every.where("detector <> 'effect_shift'"), truth, 5, _population(p, [x.name for x in SENSITIVITY]).drop("n"))
    return dt.detector_summary(s)


@query("window_sensitivity")
def window_sensitivity(spark, d):
    """The t rule by window, against effect-size truth of the same window, over series of two windows or more."""
    p = positioned(spark, d)
    rules = [r for w in WINDOW_GRID for r in (dt.t_shift(w, 2.0, name=f"window_{w}"), dt.effect_shift(w, name=f"truth_{w}"))]
    every = materialise(dt.detect(p, rules))
    truth = every.where("detector LIKE 'truth%'").select("series_id", F.regexp_replace("detector", "truth", "window").alias("detector"), "pos")
    pop = _population(p, [f"window_{w}" for w in WINDOW_GRID]).where(F.col("n") >= 2 * F.regexp_extract("detector", "[0-9]+", 0).cast("int")).drop("n")
    return dt.detector_summary(dt.series_scores(every.where("detector LIKE 'window%'"), truth, 5, pop))


_MT = "WITH RECURSIVE " + _hits_sql(_COMPARED) + _KEEP + """, n AS (SELECT series_id, count(*) AS n FROM series GROUP BY series_id), dl(detector) AS (VALUES """ + ", ".join(f"('{x}')" for x in _COMPARED) + """), pop AS (SELECT series_id, detector, CASE WHEN series_id%2=0 THEN n-10 END AS tp FROM n, dl),
g AS (SELECT p.series_id, p.detector, p.tp, count(k.pos) AS nd, min(abs(k.pos-p.tp)) AS dist FROM pop p LEFT JOIN k ON k.series_id=p.series_id AND k.detector=p.detector GROUP BY ALL), taus(tau) AS (VALUES (1),(3),(5),(7),(10),(15),(20)),
c AS (SELECT detector, tau, sum(coalesce((dist<=tau)::INT,0)) AS tp, sum(nd-coalesce((dist<=tau)::INT,0)) AS fp, sum((tp IS NOT NULL)::INT-coalesce((dist<=tau)::INT,0)) AS fn FROM g, taus GROUP BY ALL),
e AS (SELECT *, coalesce(tp/nullif(tp+fp,0),0) AS p, coalesce(tp/nullif(tp+fn,0),0) AS r, coalesce(2*tp/nullif(2*tp+fp+fn,0),0) AS f1 FROM c) """


def _tolerances(spark, d):
    p = positioned(spark, d)
    hits = dt.detect(p, [x for x in DETECTORS if x.name in _COMPARED])
    pop = _population(p, _COMPARED).withColumn("true_pos", F.when(F.col("series_id") % 2 == 0, F.col("n") - 10)).drop("n")
    return dt.multi_tolerance(hits, pop)


@query("multi_tolerance", _MT + f"SELECT detector, tau, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, {R('p')} AS precision, {R('r')} AS recall, {R('f1')} AS f1 FROM e")
def multi_tolerance(spark, d):
    return _tolerances(spark, d)


@query("tolerance_area", _MT + f", z AS (SELECT detector, (tau-lag(tau) OVER w)*(f1+lag(f1) OVER w)/2.0 AS a FROM e WINDOW w AS (PARTITION BY detector ORDER BY tau)) SELECT detector, {R('sum(a)/19.0')} AS area FROM z GROUP BY detector")
def tolerance_area(spark, d):
    return dt.tolerance_area(_tolerances(spark, d))


def _predictions(spark, d, tol):
    p = positioned(spark, d)
    hits = dt.detect(p, [x for x in DETECTORS if x.name in _COMPARED])
    pop = _population(p, _COMPARED).withColumn("alert_pos", F.col("n") - 13).drop("n")
    return dt.as_prediction(hits, pop, tol)


@query(
    "detection_as_prediction",
    "WITH RECURSIVE " + _hits_sql(_COMPARED) + _KEEP + ", n AS (SELECT series_id, count(*)-13 AS ap FROM series GROUP BY series_id), dl(detector) AS (VALUES " + ", ".join(f"('{x}')" for x in _COMPARED)
    + f"), q AS (SELECT n.series_id%2 AS y, dl.detector, coalesce(max((abs(k.pos-ap)<=5)::INT),0) AS p FROM n CROSS JOIN dl LEFT JOIN k ON k.series_id=n.series_id AND k.detector=dl.detector GROUP BY n.series_id, dl.detector), c AS (SELECT detector, sum(p*y) AS tp, sum(p*(1-y)) AS fp, sum((1-p)*y) AS fn, sum((1-p)*(1-y)) AS tn FROM q GROUP BY detector) SELECT detector, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, {R('(tp+tn)/(tp+fp+fn+tn)')} AS accuracy FROM c",
)
def detection_as_prediction(spark, d):
    p = _predictions(spark, d, 5).withColumn("y", (F.col("series_id") % 2).cast("int"))
    return mt.binary_metrics(p, F.col("y"), F.col("pred"), ["detector"]).select("detector", "tp", "fp", "fn", "tn", "accuracy")


# --- forecasts ---------------------------------------------------------------------------------------------

_FW = _S + """, al AS (SELECT * FROM series WHERE kind='error'), tr AS (SELECT a.eid AS id, a.series_id, s.pos-(a.pos-30) AS i, s.value AS v FROM al a JOIN series s ON a.series_id=s.series_id AND s.pos BETWEEN a.pos-30 AND a.pos-1 WHERE a.pos >= 30),
ac AS (SELECT a.eid AS id, s.pos-a.pos AS h, s.value AS v FROM al a JOIN series s ON a.series_id=s.series_id AND s.pos BETWEEN a.pos AND a.pos+4), ok AS (SELECT id FROM ac GROUP BY id HAVING count(*)=5),
st AS (SELECT id, max(v) FILTER (WHERE i=29) AS last, avg(v) AS mean, quantile_cont(v,0.5) AS med, avg(v) FILTER (WHERE i>=25) AS ma, sum(CASE WHEN i=0 THEN v*0.7::DOUBLE**29 ELSE 0.3::DOUBLE*0.7::DOUBLE**(29-i)*v END) AS es, stddev_pop(v) AS sd FROM tr GROUP BY id),
fo AS (SELECT id, sd, unnest(['naive_last','naive_mean','naive_median','moving_average_5','exp_smoothing']) AS model, unnest([last,mean,med,ma,es]) AS f FROM st JOIN ok USING (id)) """
FLAT = ["naive_last", "naive_mean", "naive_median", "moving_average_5", "exp_smoothing"]


def _forecasts(spark, d, models=FLAT):
    w = sr.forecast_windows(series(spark, d), is_alert(), 30, 5).withColumnRenamed("eid", "id")
    return fc.forecast(w, 5, models, keep=("id", "series_id"))


@query("forecasts", _FW + f"SELECT id, model, {R('f')} AS forecast FROM fo")
def forecasts(spark, d):
    return _forecasts(spark, d).select("id", "model", F.element_at("forecast", 1).alias("forecast"))


@query("trend_forecasts")
def trend_forecasts(spark, d):
    f = _forecasts(spark, d, ["trend_smoothing"])
    return f.select("id", F.element_at("forecast", 1).alias("first"), F.element_at("forecast", -1).alias("last"))


_ERR = ", er AS (SELECT fo.id, model, sd, avg(abs(v-f)) AS mae, avg((v-f)**2) AS mse, avg(abs((v-f)/(v+1e-10))) AS mape FROM fo JOIN ac ON ac.id=fo.id GROUP BY ALL), nv AS (SELECT id, avg(abs(dv)) AS nv FROM (SELECT id, v-lag(v) OVER (PARTITION BY id ORDER BY h) AS dv FROM ac) GROUP BY id) "


@query("forecast_errors", _FW + _ERR + f"SELECT model, {R('avg(mae)')} AS mae, {R('sqrt(avg(mse))')} AS rmse, {R('avg(mape)*100')} AS mape, count(*) AS n, {R('avg(mae)/(avg(nv)+1e-10)')} AS relative_mae FROM er JOIN nv USING (id) GROUP BY model")
def forecast_errors(spark, d):
    return fc.forecast_errors(_forecasts(spark, d))


@query("window_forecast_detection", _FW + _ERR + f"SELECT id, model, {R('CASE WHEN sd > 0 THEN mae/sd ELSE mae END')} AS score, (CASE WHEN sd > 0 THEN mae/sd ELSE mae END > 1.0)::INT AS pred FROM er")
def window_forecast_detection(spark, d):
    s = fc.forecast_scores(_forecasts(spark, d))
    return s.select("id", "model", "score", (F.col("score") > 1.0).cast("int").alias("pred"))


_BT = _FW + _ERR + ", sc AS (SELECT model, mae/sd AS s, (id%2)::INT AS y FROM er), g AS (SELECT unnest(range(0,20))*4.5::DOUBLE/19+0.5 AS t), c AS (SELECT model, t, count(*) FILTER (WHERE s>=t) AS n, count(*) FILTER (WHERE s>=t AND y=1) AS tp, sum(y) AS p FROM sc, g GROUP BY model, t), o AS (SELECT *, coalesce(2*tp/nullif(n+p,0),0) AS f1, row_number() OVER (PARTITION BY model ORDER BY coalesce(2*tp/nullif(n+p,0),0) DESC, t) AS r FROM c) "


@query("best_f1_threshold", _BT + f"SELECT model, {R('t')} AS threshold, {R('f1')} AS f1, {R('tp/n')} AS precision, {R('tp/p')} AS recall FROM o WHERE r=1")
def best_f1_threshold(spark, d):
    s = fc.forecast_scores(_forecasts(spark, d)).withColumn("y", (F.col("id") % 2).cast("int"))
    return fc.best_threshold(s, F.col("y"), F.col("score"), ["model"])


_RES = _S + ", rs AS (SELECT series_id, eid, pos, value, value - avg(value) OVER w AS r FROM series WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)), re AS (SELECT * FROM rs WHERE pos >= 10)"


@query(
    "residual_scores",
    _RES
    + f", md AS (SELECT *, quantile_cont(r,0.5) OVER p AS med, avg(r) OVER p AS a, stddev_pop(r) OVER p AS sd FROM re WINDOW p AS (PARTITION BY series_id)), ma AS (SELECT *, quantile_cont(abs(r-med),0.5) OVER (PARTITION BY series_id) AS mad FROM md) SELECT eid, {R('CASE WHEN sd>0 THEN abs((r-a)/sd) ELSE abs(r) END')} AS z_score, {R('abs(r)')} AS abs_score, {R('r*r')} AS squared_score, {R('CASE WHEN mad>0 THEN abs(r-med)/(1.4826*mad) ELSE abs(r) END')} AS mad_score FROM ma",
)
def residual_scores(spark, d):
    r = fc.residual_scores(fc.one_step_residuals(positioned(spark, d)))
    return r.select("eid", "z_score", "abs_score", "squared_score", "mad_score")


@query(
    "rolling_residual_anomaly",
    _RES
    + f""", a AS (SELECT *, abs(r) AS ar, avg(abs(r)) OVER p AS ma, stddev_pop(abs(r)) OVER p AS sa, avg(value) OVER l AS ml, avg(value) OVER q AS mr, var_pop(value) OVER l AS pl, var_pop(value) OVER q AS pr, count(*) OVER l AS nl, count(*) OVER q6 AS nr FROM re WINDOW p AS (PARTITION BY series_id), l AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), q AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), q6 AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
z AS (SELECT series_id, (ar-ma)/(sa+1e-10) AS z, (nl=5 AND nr=6 AND abs(mr-ml)/(sqrt((pl+pr)/2)+1e-10) > 0.5::DOUBLE)::INT AS y FROM a), t(threshold) AS (VALUES (1.5::DOUBLE),(2.0::DOUBLE),(2.5::DOUBLE),(3.0::DOUBLE)),
g AS (SELECT series_id, threshold, count(*) FILTER (WHERE z>threshold) AS n_flagged, sum(y) AS n_true, count(*) FILTER (WHERE z>threshold AND y=1) AS tp, count(*) AS n FROM z, t GROUP BY ALL) SELECT series_id, threshold, n_flagged, n_true::BIGINT AS n_true, tp, {R('coalesce(tp/nullif(n_flagged,0),0)')} AS precision, {R('tp/n_true')} AS recall, {R('coalesce(2*tp/nullif(n_flagged+n_true,0),0)')} AS f1 FROM g WHERE n_true > 0 AND n + 10 >= 30""",
)
def rolling_residual_anomaly(spark, d):
    return fc.rolling_anomalies(positioned(spark, d))


@query("anomaly_summary")
def anomaly_summary(spark, d):
    r = fc.rolling_anomalies(positioned(spark, d))
    return r.groupBy("threshold").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.count(F.lit(1)).alias("n_series"))


@query("forecast_pivot", _FW + _ERR + f"SELECT series_id%4 AS segment, {', '.join(R(f'avg(mae) FILTER (WHERE model=$${m}$$)') + f' AS {m}' for m in FLAT)} FROM er JOIN (SELECT eid, series_id FROM series) s ON s.eid=er.id GROUP BY 1")
def forecast_pivot(spark, d):
    f = _forecasts(spark, d).withColumn("residual", fc.mean_abs_error())
    return f.groupBy((F.col("series_id") % 4).alias("segment")).pivot("model", FLAT).agg(F.avg("residual"))
