"""Reading and writing tables: CSV folders, series files, score tables, results."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertsieve.functions.probs import let

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("single_alert_id", T.LongType()),
        T.StructField("alert_summary_id", T.LongType()),
        T.StructField("signature_id", T.LongType()),
        T.StructField("push_timestamp", T.TimestampType()),
        *[T.StructField(f"single_alert_{c}", T.DoubleType()) for c in ("amount_abs", "amount_pct", "t_value", "prev_value", "new_value")],
        T.StructField("single_alert_is_regression", T.BooleanType()),
        T.StructField("single_alert_status", T.IntegerType()),
        T.StructField("alert_summary_status", T.IntegerType()),
        *[T.StructField(f"alert_summary_{c}", T.StringType()) for c in ("repository", "suite", "machine_platform", "framework_id")],
        T.StructField("alert_summary_lower_is_better", T.BooleanType()),
        T.StructField("single_alert_manually_created", T.BooleanType()),
        T.StructField("alert_summary_bug_number", T.StringType()),
        T.StructField("single_alert_related_summary_id", T.LongType()),
    ]
)
SERIES_FIELDS = "push_timestamp timestamp, value double, push_id long, revision string, single_alert_id long"


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def clean_names(df: DataFrame) -> DataFrame:
    """Column names in lower case, stripped, blanks as underscores."""
    return df.toDF(*[re.sub(r"\s+", "_", c.strip().lower()) for c in df.columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, line_breaks: bool = True) -> DataFrame:
    """A CSV with a header. Without ``line_breaks`` inside of cells, a file is read by several tasks."""
    r = spark.read.option("header", True).option("multiLine", line_breaks).option("escape", '"')
    return (r.schema(schema) if schema is not None else r).csv(path)


def read_csv_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """CSV files with differing headers, united by normalised name, all columns as strings."""
    out = None
    for p in paths:
        df = clean_names(read_csv(spark, p))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def with_dates(df: DataFrame, col: str, required: Sequence[str] = ()) -> DataFrame:
    """Tolerant timestamp parse; rows without a date or a required value are dropped."""
    return df.withColumn(col, F.try_to_timestamp(F.col(col).cast("string"))).dropna(subset=[col, *required])


def write_splits(df: DataFrame, path: str) -> None:
    """One folder per split, so that reading one split prunes the others."""
    df.write.mode("errorifexists").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")


WIDEST = 64  # columns of a series file


def read_series(spark: SparkSession, glob: str) -> DataFrame:
    """One CSV per series; the id is the last number in the file name.

    Columns are found by the file's header, the line with cells named ``push_timestamp`` and ``value``; quoted cells may hold
    commas. A file with lines but without a header raises. Lines are read in any order, so files are splittable, and a cell
    can't hold a line break. Files of the ``__MACOSX`` folder are left out.
    """
    lines = spark.read.text(glob).select(F.regexp_replace("value", "\r", "").alias("_line"), F.col("_metadata.file_path").alias("_f"))
    lines = lines.where(~F.col("_f").contains("__MACOSX") & (F.col("_line") != ""))
    parsed = F.from_csv("_line", ", ".join(f"c{i} string" for i in range(WIDEST)), {"escape": '"'})
    cells = let(parsed, lambda r: F.transform(F.array(*[r[f"c{i}"] for i in range(WIDEST)]), lambda c: F.trim(F.coalesce(c, F.lit("")))))
    lines = lines.select("_f", cells.alias("_cells"))
    is_head = F.array_contains("_cells", "push_timestamp") & F.array_contains("_cells", "value")
    heads = lines.where(is_head).groupBy("_f").agg(F.first("_cells").alias("_head"))
    rows = lines.where(~is_head).join(heads, "_f", "left")
    head = F.when(F.col("_head").isNotNull(), F.col("_head")).otherwise(F.raise_error(F.concat(F.lit("no header in "), F.col("_f"))).cast("array<string>"))
    rows = rows.withColumn("_head", head)
    names = [x.split() for x in SERIES_FIELDS.split(", ")]
    cell = lambda n: F.when(F.array_position("_head", n) > 0, F.nullif(F.try_element_at("_cells", F.array_position("_head", n).cast("int")), F.lit("")))
    df = rows.select("_f", *[cell(n).try_cast(kind).alias(n) for n, kind in names])
    name = F.regexp_extract("_f", r"([^/]+)$", 1)
    return df.withColumn("series_id", F.regexp_extract(name, r"(\d+)[^\d]*$", 1).cast("long")).drop("_f").where("series_id is not null and value is not null")


def read_series_zip(spark: SparkSession, glob: str) -> DataFrame:
    """The same from zip archives: one task per archive, one member in memory at a time."""
    files = spark.read.format("binaryFile").load(glob).select("path", "content")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for n in z.namelist():
                        m = re.search(r"(\d+)[^\d/]*\.csv$", n)
                        if "__MACOSX" in n or not m:
                            continue
                        one = pd.read_csv(z.open(n), usecols=lambda c: c in ("push_timestamp", "value"))
                        one["push_timestamp"] = pd.to_datetime(one["push_timestamp"], errors="coerce")
                        one.insert(0, "series_id", int(m.group(1)))
                        yield one[["series_id", "push_timestamp", "value"]]

    return files.mapInPandas(members, "series_id long, push_timestamp timestamp, value double").where("value is not null")


def last_points(df: DataFrame, max_points: int, keys: Sequence[str] = ("series_id",), order: Sequence[str] = ("ts",)) -> DataFrame:
    """The newest ``max_points`` rows per series (``order`` must be total)."""
    from alertsieve.operators.topk import first_k

    return first_k(df, list(keys), [F.desc(c) for c in order], max_points).drop("_rank")


def cap_per_key(df: DataFrame, key: str, order: Sequence[str], n: int) -> DataFrame:
    """The oldest n rows per key: the row cap that a job asks for."""
    from alertsieve.operators.topk import first_k

    return first_k(df, [key], list(order), n).drop("_rank")


SCORE_SCHEMA = "id long, split string, model string, label int, pred int, probs array<double>"


def read_scores(spark: SparkSession, path: str, model_a: str, model_b: str) -> DataFrame:
    """Two models' rows of a score table side by side: id, split, label, pa, pb, preda, predb, agree."""
    t = spark.read.schema(SCORE_SCHEMA).parquet(path)
    a = t.where(F.col("model") == model_a).select("id", "split", "label", F.col("probs").alias("pa"), F.col("pred").alias("preda"))
    b = t.where(F.col("model") == model_b).select("id", F.col("probs").alias("pb"), F.col("pred").alias("predb"))
    return a.join(b, "id").withColumn("agree", F.col("preda") == F.col("predb"))


def align_scores(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Rows and label mismatches per split between a score table and its tickets."""
    j = scores.join(truth, "id")
    return j.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") != F.col("true_label")).alias("mismatches"))


def roll_up_events(log: DataFrame, key: str, ts: str, order: Sequence[str], last: Sequence[str]) -> DataFrame:
    """One row per incident: first time, last time, last known states."""
    at = F.struct(*[F.col(c) for c in order])
    return log.groupBy(key).agg(
        F.min(ts).alias("opened_at"),
        F.max(ts).alias("updated_at"),
        F.count(F.lit(1)).alias("n_events"),
        *[F.max_by(c, at).alias(f"final_{c}") for c in last],
    )


def profile(df: DataFrame) -> DataFrame:
    """Per column: type, rows, nulls, smallest and largest value, from one aggregate."""
    cols = df.columns
    items = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(df.schema[c].dataType.simpleString()).alias("type"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col(c).isNull()).alias("n_null"),
            F.min(F.col(c)).cast("string").alias("min"),
            F.max(F.col(c)).cast("string").alias("max"),
        )
        for c in cols
    ]
    return df.agg(F.array(*items).alias("r")).select(F.inline("r"))


def usable_alerts(df: DataFrame, first: str, second: str) -> DataFrame:
    """Series id from the first column, else the second; rows without one are dropped."""
    return df.withColumn("series_id", F.coalesce(F.expr(f"try_cast({first} AS double)"), F.expr(f"try_cast({second} AS double)")).cast("long")).dropna(subset=["series_id"])


def filled_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    return df.fillna(defaults)


def write_result(df: DataFrame, path: str, fmt: str) -> None:
    w = df.write.mode("errorifexists")
    {"json": w.json, "parquet": w.parquet, "csv": lambda p: w.option("header", True).csv(p)}[fmt](path)


def collect_results(spark: SparkSession, globs: Sequence[str], source: str = "run") -> DataFrame:
    """Result files of many runs as one table with the file they came from."""
    out = None
    for g in globs:
        df = spark.read.json(g).withColumn(source, F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def token_cost(df: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of calls: tokens times the price per million of the model."""
    from alertsieve.operators.lookup import lookup_join

    p = lookup_join(df, prices, ["model"], "left")

    def part(tokens: str, price: str) -> Column:
        return F.col(tokens) * F.coalesce(F.col(price), F.lit(0.0)) / 1e6

    return p.withColumn("cost", part("tokens_in", "price_in") + part("tokens_out", "price_out")).drop("price_in", "price_out")


def usage(df: DataFrame, budget: float) -> DataFrame:
    """Calls, tokens and cost per model with the budget left after all of them."""
    from alertsieve.operators.ordering import with_scalars

    u = df.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.sum("cost").alias("cost"),
    )
    return with_scalars(u, u.agg((F.lit(budget) - F.sum("cost")).alias("budget_left")))
