"""The driver tables and the tables derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertsieve.functions.probs import normalised, predicted
from alertsieve.operators.lookup import large_join
from alertsieve.session import spread

CLASSES = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _softmax(v: Column, offset: int, label: Column) -> Column:
    e = F.transform(
        F.sequence(F.lit(0), F.lit(CLASSES - 1)),
        lambda k: F.exp(F.lit(8.0) * F.get(v, k + offset).cast("double") + F.when(k == label, F.lit(2.0)).otherwise(F.lit(0.0))),
    )
    return e


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two class-probability vectors per row: id, split, label, pa, pb, preda, predb, agree."""
    e = table(spark, sf_dir, "embeddings")
    v, label = F.col("embedding"), F.col("label")
    df = e.select(
        F.col("vec_id").alias("id"),
        F.when(F.col("vec_id") % 2 == 0, "cal").otherwise("test").alias("split"),
        "label",
        _softmax(v, 0, label).alias("ea"),
        _softmax(v, 10, label).alias("eb"),
    )

    df = df.select("id", "split", "label", normalised(F.col("ea")).alias("pa"), normalised(F.col("eb")).alias("pb"))
    df = df.withColumns({"preda": predicted(F.col("pa")), "predb": predicted(F.col("pb"))})
    return df.withColumn("agree", F.col("preda") == F.col("predb"))


SCORES_SQL = """
e0 AS (SELECT vec_id AS id, label, [x::DOUBLE for x in embedding] AS v FROM embeddings),
e1 AS (SELECT id, label,
  [exp(8.0::DOUBLE * v[k+1] + CASE WHEN k=label THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END) for k in range(0,10)] AS ea,
  [exp(8.0::DOUBLE * v[k+11] + CASE WHEN k=label THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END) for k in range(0,10)] AS eb FROM e0),
e2 AS (SELECT id, label, ea, eb, list_sum(ea) AS ta, list_sum(eb) AS tb FROM e1),
e3 AS (SELECT id, CASE WHEN id%2=0 THEN 'cal' ELSE 'test' END AS split, label, [x/ta for x in ea] AS pa, [x/tb for x in eb] AS pb FROM e2),
scores AS (SELECT *, list_max(pa) AS ca, list_max(pb) AS cb, CAST(list_position(pa, list_max(pa))-1 AS INT) AS preda, CAST(list_position(pb, list_max(pb))-1 AS INT) AS predb,
  list_position(pa, list_max(pa)) = list_position(pb, list_max(pb)) AS agree FROM e3)
"""


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, resolution, severity, priority, creator, value."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderstatus").alias("resolution"),
        F.substring("o_orderpriority", 3, 20).alias("severity"),
        F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1)).alias("priority"),
        F.col("o_custkey").alias("creator"),
        F.col("o_totalprice").alias("value"),
    )


TICKETS_SQL = """
tickets AS (SELECT o_orderkey AS id, o_orderdate AS ts, o_orderstatus AS resolution, substr(o_orderpriority,3,20) AS severity,
  'P' || substr(o_orderpriority,1,1) AS priority, o_custkey AS creator, o_totalprice AS value FROM orders)
"""


def ticket_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text, component, lang."""
    d = documents(spark, sf_dir)
    return d.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("component"), "lang")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts grouped by summary: rows of lineitem joined to their order."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_orderpriority")
    j = large_join(li, o, "l_orderkey")
    new = F.col("l_extendedprice")
    prev = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    return j.select(
        F.col("l_orderkey").alias("summary_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_partkey").alias("series_id"),
        F.col("l_suppkey").alias("platform"),
        new.alias("new_value"),
        prev.alias("prev_value"),
        F.col("l_returnflag").alias("status"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_linestatus") == "O").alias("is_regression"),
        (F.col("o_orderpriority") < "3").alias("lower_is_better"),
        F.col("o_orderdate").alias("opened"),
    )


ALERTS_SQL = """
alerts AS (SELECT l_orderkey AS summary_id, l_linenumber AS line, l_shipdate AS ts, l_partkey AS series_id, l_suppkey AS platform,
  l_extendedprice AS new_value, l_extendedprice*(1.0::DOUBLE-l_discount) AS prev_value, l_returnflag AS status, l_quantity AS quantity,
  l_linestatus='O' AS is_regression, o_orderpriority < '3' AS lower_is_better, o_orderdate AS opened FROM lineitem JOIN orders ON l_orderkey=o_orderkey)
"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, ts, value (and event_id, event_type to break ties and to build truth)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("series_id"), "ts", F.col("event_id").alias("eid"), "value", F.col("event_type").alias("kind"))


SERIES_SQL = """
series AS (SELECT user_id AS series_id, ts, event_id AS eid, value, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)
"""


def defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary rows: id, y, p (probability of the positive class) and p2 (a second model)."""
    s = scores(spark, sf_dir)
    return s.select("id", "split", (F.col("label") < 3).cast("int").alias("y"), _mass("pa").alias("p"), _mass("pb").alias("p2"))


def _mass(c: str) -> Column:
    return F.get(F.col(c), F.lit(0)) + F.get(F.col(c), F.lit(1)) + F.get(F.col(c), F.lit(2))


DEFECTS_SQL = (
    SCORES_SQL
    + """, defects AS (SELECT id, split, CAST(label < 3 AS INT) AS y, pa[1]+pa[2]+pa[3] AS p, pb[1]+pb[2]+pb[3] AS p2 FROM scores)
"""
)
