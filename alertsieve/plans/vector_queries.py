"""Queries over vectors: neighbours, clusters, uncertainty."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertsieve.functions.uncertainty import digamma_sql, dirichlet
from alertsieve.operators import clusters as cu
from alertsieve.operators import metrics as mt
from alertsieve.operators import neighbours as nb
from alertsieve.operators import series as sr
from alertsieve.operators.grid import grid_sums
from alertsieve.operators.lookup import lookup_join
from alertsieve.plans.registry import R, query
from alertsieve.sources.tables import SCORES_SQL, scores, series, table

_V = "WITH v AS (SELECT vec_id AS id, [x::DOUBLE for x in embedding] AS v, label FROM embeddings)"
_NN = _V + ", p AS (SELECT a.id, b.id AS nid, list_distance(a.v, b.v) AS d FROM v a, v b WHERE a.id%2=1 AND b.id%2=0), nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d,12), nid) AS rank FROM p QUALIFY rank <= {k})"
_CN = _V + ", p AS (SELECT a.id, b.id AS nid, 1-list_cosine_similarity(a.v, b.v) AS d FROM v a, v b WHERE a.id%2=1 AND b.id%2=0), nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d,10), nid) AS rank FROM p QUALIFY rank <= {k})"


def vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def _split(spark, d):
    v = vectors(spark, d)
    return v.where("id % 2 = 1"), v.where("id % 2 = 0")


@query("knn_join", _NN.format(k=5) + f" SELECT id, nid, rank::INT AS rank, {R('d')} AS distance FROM nn")
def knn_join(spark, d):
    test, train = _split(spark, d)
    return nb.knn_join(test, train, 5)


_VOTE = ", j AS (SELECT nn.id, l.label, sum({w}) AS s FROM nn JOIN v l ON l.id=nn.nid GROUP BY ALL), b AS (SELECT id, arg_min(label, (-round(s,9), label)) AS pred_label, max(s)/sum(s) AS conf FROM j GROUP BY id) "


@query("knn_vote", _NN.format(k=5) + _VOTE.format(w="1/(d+1e-6)") + f"SELECT id, pred_label, {R('conf')} AS label_confidence FROM b")
def knn_vote(spark, d):
    test, train = _split(spark, d)
    return nb.weighted_vote(nb.knn_join(test, train, 5), train.select("id", "label"), ["label"])


@query("knn_vote_cosine", _CN.format(k=5) + _VOTE.format(w="greatest(1-d,0)") + f"SELECT id, pred_label, {R('conf')} AS label_confidence FROM b")
def knn_vote_cosine(spark, d):
    test, train = _split(spark, d)
    return nb.weighted_vote(nb.knn_join(test, train, 5, cosine=True), train.select("id", "label"), ["label"], cosine=True)


@query(
    "loo_retrieval",
    _V + ", p AS (SELECT a.id, b.id AS nid, list_distance(a.v, b.v) AS d FROM v a, v b WHERE a.id<>b.id), nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d,12), nid) AS rank FROM p QUALIFY rank <= 5)" + _VOTE.format(w="1/(d+1e-6)")
    + f"SELECT label, count(*) AS n, {R('avg((pred_label=label)::INT)')} AS accuracy, {R('avg(conf)')} AS mean_confidence FROM b JOIN v USING (id) GROUP BY label",
)
def loo_retrieval(spark, d):
    v = vectors(spark, d)
    vote = nb.weighted_vote(nb.knn_join(v, v, 5, skip_same=True), v.select("id", "label"), ["label"])
    j = v.select("id", "label").join(vote, "id")
    return j.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("pred_label") == F.col("label")).cast("int")).alias("accuracy"), F.avg("label_confidence").alias("mean_confidence"))


@query("neighbour_evidence", _NN.format(k=7) + " SELECT nn.id, sum((l.label<3)::INT)::BIGINT AS n_positive, count(*) AS n_neighbours FROM nn JOIN v l ON l.id=nn.nid GROUP BY nn.id")
def neighbour_evidence(spark, d):
    test, train = _split(spark, d)
    lab = train.select("id", (F.col("label") < 3).cast("int").alias("y"))
    return nb.neighbour_evidence(nb.knn_join(test, train, 7), lab, "y")


_TS = [0.70, 0.75, 0.80, 0.85, 0.90, 0.95]


@query(
    "near_duplicates",
    _CN.format(k=1)
    + f""", t AS (SELECT nn.id, 1-d AS s, (a.label=b.label)::INT AS y FROM nn JOIN v a ON a.id=nn.id JOIN v b ON b.id=nn.nid), g(t) AS (VALUES {','.join(f'({x}::DOUBLE)' for x in _TS)}),
c AS (SELECT g.t, count(*) FILTER (WHERE s>=g.t) AS n, count(*) FILTER (WHERE s>=g.t AND y=1) AS tp, sum(y) AS p FROM t, g GROUP BY g.t) SELECT t AS threshold, n AS n_flagged, {R('coalesce(tp/nullif(n,0),0)')} AS precision, {R('coalesce(tp/nullif(p,0),0)')} AS recall, {R('coalesce(2*tp/nullif(n+p,0),0)')} AS f1 FROM c""",
)
def near_duplicates(spark, d):
    """Similarity of the nearest training row as a duplicate score."""
    test, train = _split(spark, d)
    nn = nb.knn_join(test, train, 1, cosine=True)
    j = nn.join(test.select("id", "label"), "id").join(train.select(F.col("id").alias("nid"), F.col("label").alias("l2")), "nid")
    j = j.select((F.lit(1.0) - F.col("distance")).alias("s"), (F.col("label") == F.col("l2")).cast("int").alias("y"))
    g = grid_sums(j, [], F.col("s"), _TS, {"n": F.lit(1), "tp": F.col("y")})
    tp, n, p = F.col("tp"), F.col("n"), F.col("total_tp")
    return g.select("threshold", n.alias("n_flagged"), F.coalesce(F.try_divide(tp, n), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(tp, p), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide(F.lit(2.0) * tp, n + p), F.lit(0.0)).alias("f1"))


@query(
    "duplicate_auc",
    _CN.format(k=1) + f", t AS (SELECT 1-d AS p, (a.label=b.label)::INT AS y FROM nn JOIN v a ON a.id=nn.id JOIN v b ON b.id=nn.nid) SELECT {R('sum(CASE WHEN a.p>b.p THEN 1.0 WHEN a.p=b.p THEN 0.5 ELSE 0 END)/count(*)')} AS roc_auc FROM t a, t b WHERE a.y=1 AND b.y=0",
)
def duplicate_auc(spark, d):
    test, train = _split(spark, d)
    nn = nb.knn_join(test, train, 1, cosine=True)
    j = nn.join(test.select("id", "label"), "id").join(train.select(F.col("id").alias("nid"), F.col("label").alias("l2")), "nid")
    j = j.select((F.lit(1.0) - F.col("distance")).alias("s"), (F.col("label") == F.col("l2")).cast("int").alias("y"))
    return mt.ranking_metrics(j, F.col("y"), F.col("s")).select("roc_auc")


# --- resampling by neighbours -----------------------------------------------------------------------------


@query("smote")
def smote(spark, d):
    return nb.smote(vectors(spark, d), "label", 0, 100).select("source_id", "copy", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"))


_SELF = _V + ", p AS (SELECT a.id, b.id AS nid, list_distance(a.v, b.v) AS d FROM v a, v b WHERE a.id<>b.id), nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d,12), nid) AS rank FROM p QUALIFY rank <= {k})"


@query("adasyn_weights", _SELF.format(k=5) + f", r AS (SELECT nn.id, avg((b.label<>0)::INT) AS r FROM nn JOIN v a ON a.id=nn.id JOIN v b ON b.id=nn.nid WHERE a.label=0 GROUP BY nn.id) SELECT id, {R('r/sum(r) OVER ()')} AS weight FROM r")
def adasyn_weights(spark, d):
    return nb.adasyn_weights(vectors(spark, d), "label", 0)


@query("enn_clean", _SELF.format(k=3) + ", c AS (SELECT nn.id, b.label, count(*) AS n FROM nn JOIN v b ON b.id=nn.nid GROUP BY ALL), t AS (SELECT id, arg_min(label, (-n, label)) AS m FROM c GROUP BY id) SELECT v.id, v.label FROM v JOIN t ON t.id=v.id AND t.m=v.label")
def enn_clean(spark, d):
    return nb.enn_keep(vectors(spark, d), "label", 3).select("id", "label")


@query("tomek_links", _SELF.format(k=1) + " SELECT a.id, a.nid FROM nn a JOIN nn b ON a.id=b.nid AND a.nid=b.id JOIN v x ON x.id=a.id JOIN v y ON y.id=a.nid WHERE a.id < a.nid AND x.label <> y.label")
def tomek_links(spark, d):
    return nb.tomek_links(vectors(spark, d), "label")


# --- clusters -----------------------------------------------------------------------------------------------

_EPS = 1.17


@query(
    "eps_neighbourhoods",
    _V + f" SELECT a.id, count(*) AS n FROM v a, v b WHERE list_distance(a.v,b.v) <= {_EPS} GROUP BY a.id",
)
def eps_neighbourhoods(spark, d):
    v = vectors(spark, d).select("id", "v")
    return nb.within(v, v, _EPS).select("id", "n")


@query(
    "dbscan",
    "WITH RECURSIVE v AS (SELECT vec_id AS id, [x::DOUBLE for x in embedding] AS v FROM embeddings), e AS (SELECT a.id, b.id AS nid FROM v a, v b WHERE list_distance(a.v,b.v) <= 1.17), c AS (SELECT id FROM e GROUP BY id HAVING count(*) >= 5), ce AS (SELECT e.* FROM e WHERE id IN (SELECT id FROM c) AND nid IN (SELECT id FROM c)), "
    "rch(id, root) AS (SELECT id, id FROM c UNION SELECT ce.nid, r.root FROM rch r JOIN ce ON ce.id=r.id), lab AS (SELECT id, min(root) AS cluster FROM rch GROUP BY id) "
    "SELECT id, cluster, TRUE AS is_core FROM lab UNION ALL SELECT v.id, coalesce((SELECT min(l.cluster) FROM e JOIN lab l ON l.id=e.nid WHERE e.id=v.id), -1), FALSE FROM v WHERE v.id NOT IN (SELECT id FROM c)",
)
def dbscan(spark, d):
    return nb.dbscan(vectors(spark, d).select("id", "v"), _EPS, 5)


_CL = _V + ", c AS (SELECT id, v, label, CASE WHEN v[1] > 0 THEN 1 ELSE 0 END + CASE WHEN v[2] > 0 THEN 2 ELSE 0 END AS cluster FROM v)"


def _clustered(spark, d):
    v = vectors(spark, d)
    return v.withColumn("cluster", F.when(F.col("v")[0] > 0, 1).otherwise(0) + F.when(F.col("v")[1] > 0, 2).otherwise(0))


@query(
    "cluster_external_quality",
    _CL
    + f""", k AS (SELECT label, cluster, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT label, sum(n) AS n FROM k GROUP BY label), u AS (SELECT cluster, sum(n) AS n FROM k GROUP BY cluster), nz AS (SELECT sum(n)::DOUBLE AS nt FROM k),
x AS (SELECT nz.nt AS n, (SELECT -sum(t.n/nz.nt*ln(t.n/nz.nt)) FROM t) AS ht, (SELECT -sum(u.n/nz.nt*ln(u.n/nz.nt)) FROM u) AS hk, (SELECT sum(k.n/nz.nt*ln(k.n*nz.nt/(t.n*u.n))) FROM k JOIN t USING (label) JOIN u USING (cluster)) AS mi, (SELECT sum(k.n*(k.n-1)/2) FROM k) AS nij, (SELECT sum(t.n*(t.n-1)/2) FROM t) AS ct, (SELECT sum(u.n*(u.n-1)/2) FROM u) AS ck FROM nz)
SELECT {R('mi/ht')} AS homogeneity, {R('mi/hk')} AS completeness, {R('2*mi/(ht+hk)')} AS v_measure, {R('(nij-ct*ck/(n*(n-1)/2))/((ct+ck)/2-ct*ck/(n*(n-1)/2))')} AS ari, {R('mi/((ht+hk)/2)')} AS nmi FROM x""",
)
def cluster_external_quality(spark, d):
    return cu.external_quality(_clustered(spark, d), "label", "cluster")


@query(
    "cluster_internal_quality",
    _CL
    + f""", l AS (SELECT id, cluster, unnest(range(0,64)) AS d, unnest(v) AS x FROM c), m AS (SELECT cluster, d, avg(x) AS m, count(*) AS n FROM l GROUP BY ALL), g AS (SELECT d, avg(x) AS g FROM l GROUP BY d),
w AS (SELECT sum((x-m)**2) AS w FROM l JOIN m USING (cluster, d)), b AS (SELECT sum(n*(m-g)**2) AS b FROM m JOIN g USING (d)), s AS (SELECT cluster, avg(ds) AS s FROM (SELECT id, cluster, sqrt(sum((x-m)**2)) AS ds FROM l JOIN m USING (cluster, d) GROUP BY ALL) GROUP BY cluster),
r AS (SELECT a.cluster, max((sa.s+sb.s)/dd) AS r FROM (SELECT a.cluster, b.cluster AS o, sqrt(sum((a.m-b.m)**2)) AS dd FROM m a JOIN m b ON a.d=b.d AND a.cluster<>b.cluster GROUP BY ALL) a JOIN s sa ON sa.cluster=a.cluster JOIN s sb ON sb.cluster=a.o GROUP BY a.cluster), nn AS (SELECT count(*) AS n, count(DISTINCT cluster) AS k FROM c)
SELECT k::INT AS n_clusters, {R('(b/(k-1))/(w/(n-k))')} AS calinski_harabasz, {R('(SELECT avg(r) FROM r)')} AS davies_bouldin FROM w, b, nn""",
)
def cluster_internal_quality(spark, d):
    return cu.internal_quality(_clustered(spark, d), "cluster")


_XS = ", ".join(f"{R(f'avg(v[{i + 1}])')} AS x{i}_mean, {R(f'stddev_samp(v[{i + 1}])')} AS x{i}_std" for i in range(64))


@query("cluster_profiles", _CL + f", m AS (SELECT cluster, label, count(*) AS n FROM c GROUP BY cluster, label QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label)=1) SELECT c.cluster, count(*) AS size, {_XS}, any_value(m.label) AS label_mode, count(DISTINCT c.label) AS label_unique FROM c JOIN m USING (cluster) GROUP BY c.cluster")
def cluster_profiles(spark, d):
    c = _clustered(spark, d).select("cluster", "label", *[F.col("v")[i].alias(f"x{i}") for i in range(64)])
    return cu.cluster_profiles(c, "cluster", [f"x{i}" for i in range(64)], ["label"])


@query("standout_features", _CL + f", l AS (SELECT cluster, 'f' || (k-1) AS feature, v[k] AS x FROM c, range(1, 65) r(k)), g AS (SELECT feature, avg(x) AS g FROM l GROUP BY feature), a AS (SELECT cluster, l.feature, avg(x)-max(g) AS dv FROM l JOIN g ON l.feature=g.feature GROUP BY ALL) SELECT cluster, feature, {R('dv')} AS deviation FROM a QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(abs(dv),9) DESC, feature)=1")
def standout_features(spark, d):
    c = _clustered(spark, d).select("cluster", *[F.col("v")[i].alias(f"f{i}") for i in range(64)])
    return cu.standout_features(c, "cluster", [f"f{i}" for i in range(64)])


@query("noise_share", "WITH c AS (SELECT CASE WHEN embedding[1] > 0.1 THEN -1 ELSE label END AS k FROM embeddings) " + f"SELECT count(*) FILTER (WHERE k<0) AS n_noise, {R('avg((k<0)::INT)')} AS noise_ratio, count(DISTINCT k) FILTER (WHERE k>=0) AS n_clusters FROM c")
def noise_share(spark, d):
    c = table(spark, d, "embeddings").select(F.when(F.col("embedding")[0].cast("double") > 0.1, -1).otherwise(F.col("label")).alias("k"))
    return cu.noise_share(c, "k")


@query("cluster_accuracy", _CL.replace("WITH ", "WITH " + SCORES_SQL.strip() + ", ", 1) + f" SELECT cluster, count(*) AS n, {R('avg((s.preda=s.label)::INT)')} AS accuracy, {R('avg(1-s.ca)')} AS mean_uncertainty FROM c JOIN scores s USING (id) GROUP BY cluster")
def cluster_accuracy(spark, d):
    j = scores(spark, d).join(_clustered(spark, d).select("id", "cluster"), "id")
    return j.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("preda") == F.col("label")).cast("int")).alias("accuracy"), F.avg(F.lit(1.0) - F.array_max("pa")).alias("mean_uncertainty"))


# --- uncertainty ------------------------------------------------------------------------------------------------


@query(
    "dirichlet_uncertainty",
    f"""WITH a AS (SELECT vec_id AS id, [1.0::DOUBLE + 10.0::DOUBLE*abs(embedding[k]::DOUBLE) for k in range(1,11)] AS al FROM embeddings), s AS (SELECT id, list_sum(al) AS s, unnest(al) AS x FROM a),
g AS (SELECT id, max(s) AS s, -sum(x/s*ln(x/s+1e-10)) AS total, sum(-x/s*{digamma_sql('(x+1.0::DOUBLE)')}) AS inner_ FROM s GROUP BY id), f AS (SELECT id, s, total, inner_ + {digamma_sql('(s+1.0::DOUBLE)')} AS aleatoric FROM g) SELECT id, {R('s')} AS strength, {R('total')} AS total, {R('aleatoric')} AS aleatoric, {R('total-aleatoric')} AS epistemic FROM f""",
)
def dirichlet_uncertainty(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 10), lambda x: F.lit(1.0) + F.lit(10.0) * F.abs(x.cast("double"))).alias("alpha"))
    e = e.withColumn("strength", F.aggregate("alpha", F.lit(0.0), lambda a, x: a + x))
    u = dirichlet(F.col("alpha"), F.col("strength"))
    return e.select("id", "strength", *[c.alias(n) for n, c in u.items()])


# --- rows with labels ------------------------------------------------------------


@query("labelled_rows", "SELECT l.quality, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY 1")
def labelled_rows(spark, d):
    lab = table(spark, d, "labels").select("doc_id", "quality")
    return lookup_join(table(spark, d, "documents").select("doc_id"), lab, ["doc_id"], "inner").groupBy("quality").agg(F.count(F.lit(1)).alias("n"))
