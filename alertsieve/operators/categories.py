"""Category tables learned on training rows and joined to all rows.

Each learned table has one row per category. It is joined through ``lookup_join``: broadcast
while it is small, shuffled with adaptive skew handling when it is not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertsieve.operators.lookup import lookup_join
from alertsieve.operators.ordering import with_scalars


def distribution(df: DataFrame, col: str) -> DataFrame:
    c = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    c = with_scalars(c, c.agg(F.sum("n").alias("_t")))
    return c.select(col, "n", (F.col("n") * 100.0 / F.col("_t")).alias("percent"))


def label_mapping(train: DataFrame, col: str, top_k: int) -> DataFrame:
    """The ``top_k`` most frequent names (count, then name) with alphabetical ids."""
    top = train.where(F.col(col).isNotNull()).groupBy(col).count().orderBy(F.desc("count"), col).limit(top_k)
    # at most top_k rows: the id is the position in the sorted list of names
    names = top.agg(F.array_sort(F.collect_list(col)).alias("names"))
    return names.select(F.posexplode("names").alias("label", col)).select(col, F.col("label").cast("int").alias("label"))


def apply_label_mapping(df: DataFrame, mapping: DataFrame, col: str, top_k: int, other: bool = True) -> DataFrame:
    """Add ``label`` and ``<col>_mapped``; other names get id ``top_k`` or are dropped."""
    out = lookup_join(df, mapping, [col], "left")
    if not other:
        return out.where("label is not null").withColumn(f"{col}_mapped", F.col(col))
    return out.withColumns(
        {f"{col}_mapped": F.when(F.col("label").isNull(), "Other").otherwise(F.col(col)), "label": F.coalesce("label", F.lit(top_k))}
    )


def group_rare(df: DataFrame, col: str, min_share: float = 0.01, min_rows: int = 0, other: str = "Other") -> DataFrame:
    """Names below the share (or row count) become ``other``."""
    c = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    c = with_scalars(c, c.agg(F.sum("n").alias("_t")))
    rare = c.where((F.col("n") / F.col("_t") < min_share) | (F.col("n") < min_rows)).select(col, F.lit(True).alias("_rare"))
    out = lookup_join(df, rare, [col], "left")
    return out.withColumn(col, F.when(F.col("_rare"), other).otherwise(F.col(col))).drop("_rare")


def rare_warnings(train: DataFrame, cal: DataFrame, col: str, min_train: int = 50, min_cal: int = 20) -> DataFrame:
    """Classes with too few training or calibration rows."""
    n = train.select(col, F.lit(1).alias("t"), F.lit(0).alias("c")).unionByName(cal.select(col, F.lit(0).alias("t"), F.lit(1).alias("c")))
    g = n.groupBy(col).agg(F.sum("t").alias("n_train"), F.sum("c").alias("n_cal"))
    return g.where((F.col("n_train") < min_train) | (F.col("n_cal") < min_cal))


def keep_frequent(df: DataFrame, col: str, min_rows: int) -> DataFrame:
    """Rows of classes with at least ``min_rows`` rows."""
    keep = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows).select(col)
    return lookup_join(df, keep, [col], "left_semi")


def train_counts(train: DataFrame, df: DataFrame, col: str, default: int = 1, name: str | None = None) -> DataFrame:
    """Rows of the training table with the same value."""
    name = name or f"{col}_count"
    c = train.groupBy(col).agg(F.count(F.lit(1)).alias(name))
    return lookup_join(df, c, [col], "left").withColumn(name, F.coalesce(name, F.lit(default)))


def frequency_encode(df: DataFrame, col: str) -> DataFrame:
    c = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    c = with_scalars(c, c.agg(F.sum("_n").alias("_t"))).select(col, (F.col("_n") / F.col("_t")).alias(f"{col}_freq"))
    return lookup_join(df, c, [col], "left")


def target_rate(train: DataFrame, df: DataFrame, col: str, y: Column, name: str) -> DataFrame:
    """Mean target per category of the training rows; the global mean for unseen ones."""
    r = train.groupBy(col).agg(F.avg(y).alias(name))
    g = train.agg(F.avg(y).alias("_g"))
    out = with_scalars(lookup_join(df, r, [col], "left"), g)
    return out.withColumn(name, F.coalesce(name, "_g")).drop("_g")


def label_encoder(train: DataFrame, col: str, unknown: str = "unknown") -> DataFrame:
    """Alphabetical ids of the training values and of ``unknown``, without one global window.

    Values are ordered by a range sort; the id is the running count.
    """
    from alertsieve.operators.ordering import ordered

    v = train.select(F.coalesce(F.col(col), F.lit(unknown)).alias(col))
    v = v.unionByName(train.sparkSession.createDataFrame([(unknown,)], f"{col} string")).distinct()
    return ordered(v, [], [col]).with_position(f"{col}_enc").result()


def label_encode(encoder: DataFrame, df: DataFrame, col: str, unknown: str = "unknown") -> DataFrame:
    """Ids of the values; unseen and null values get the id of ``unknown``."""
    u = encoder.where(F.col(col) == unknown).select(F.col(f"{col}_enc").alias("_u"))
    out = with_scalars(lookup_join(df, encoder, [col], "left"), u)
    return out.withColumn(f"{col}_enc", F.coalesce(f"{col}_enc", "_u")).drop("_u")


def one_hot(df: DataFrame, col: str, max_levels: int = 20) -> DataFrame:
    """0/1 columns for all levels but the first; above ``max_levels`` the column is label-encoded instead."""
    levels = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(max_levels + 1).collect()]
    if len(levels) > max_levels:
        return label_encode(label_encoder(df, col), df, col).drop(col)
    return df.withColumns({f"{col}_{v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for v in sorted(levels)[1:]}).drop(col)


def mode_encode(df: DataFrame, col: str) -> DataFrame:
    """1 where the value is the most frequent one (first name on ties)."""
    m = df.groupBy(col).count().agg(F.min_by(col, F.struct(-F.col("count"), F.col(col))).alias("_m"))
    return with_scalars(df, m).withColumn(f"{col}_is_mode", (F.col(col) == F.col("_m")).cast("int")).drop("_m")


def entity_profile(train: DataFrame, entity: str, label: str) -> DataFrame:
    """Class shares of an entity in long form: ``entity, label, share``."""
    c = train.groupBy(entity, label).agg(F.count(F.lit(1)).alias("_n"))
    # one row per (entity, class) from here on, so the window holds at most one row per class
    return c.withColumn("share", F.col("_n") / F.sum("_n").over(Window.partitionBy(entity))).drop("_n")


def profile_features(profile: DataFrame, df: DataFrame, entity: str, classes: int) -> DataFrame:
    """Entropy (bits), largest share and known flag of the row's entity; uniform if unseen."""
    s = profile.groupBy(entity).agg(F.sum(-F.col("share") * F.log2("share")).alias("profile_entropy"), F.max("share").alias("profile_max"), F.lit(1.0).alias("profile_known"))
    import math

    out = lookup_join(df, s, [entity], "left")
    return out.withColumns(
        {
            "profile_entropy": F.coalesce("profile_entropy", F.lit(math.log2(classes))),
            "profile_max": F.coalesce("profile_max", F.lit(1.0 / classes)),
            "profile_known": F.coalesce("profile_known", F.lit(0.0)),
        }
    )


def entity_mean(train: DataFrame, df: DataFrame, entity: str, value: str) -> DataFrame:
    """Training mean of a value per entity (global mean if unseen) and the row's difference."""
    out = target_rate(train, df, entity, F.col(value), f"{value}_mean")
    return out.withColumn(f"{value}_diff", F.col(value) - F.col(f"{value}_mean"))


def class_weights(df: DataFrame, y: str, cap: float | None = 10.0) -> DataFrame:
    """Balanced weight n/(k*n_c) per class, capped."""
    c = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    c = with_scalars(c, c.agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_k")))
    w = F.col("_t") / (F.col("_k") * F.col("n"))
    return c.select(y, "n", (F.least(w, F.lit(cap)) if cap else w).alias("weight"))


def positive_weight(df: DataFrame, y: str) -> DataFrame:
    return df.agg(F.try_divide(F.count_if(F.col(y) == 0), F.count_if(F.col(y) == 1)).alias("scale_pos_weight"))


def undersample(df: DataFrame, y: str, key: str) -> DataFrame:
    """All classes cut to the smallest one by hashed order (the sampling operator)."""
    from alertsieve.functions.random import keyed_uniform
    from alertsieve.operators.ordering import ordered

    n = df.groupBy(y).count().agg(F.min("count").alias("_m"))
    rows = df.withColumn("_u", keyed_uniform(F.col(key), "under"))
    out = with_scalars(ordered(rows, [y], ["_u", key]).with_position("_p").result(), n)
    return out.where(F.col("_p") < F.col("_m")).drop("_u", "_p", "_m")


def null_ratios(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    one = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_ratio")) for c in cols])))


def drop_mostly_null(df: DataFrame, max_ratio: float = 0.9) -> DataFrame:
    bad = [r["column"] for r in null_ratios(df, df.columns).where(F.col("null_ratio") > max_ratio).collect()]
    return df.drop(*bad)


# Parts of column names that give the outcome away or carry no signal.
LEAKY_NAMES = [
    "single_alert_classifier",
    "single_alert_classifier_email",
    "alert_summary_first_triaged",
    "alert_summary_bug_number",
    "alert_summary_bug_updated",
    "alert_summary_bug_due_date",
    "alert_summary_notes",
    "alert_summary_status",
    "single_alert_status",
    "alert_summary_assignee_email",
    "alert_summary_assignee_username",
    "single_alert_starred",
    "single_alert_related_summary_id",
    "alert_summary_performance_tags",
]
LEAKY_SUFFIXES = ("_id", "_timestamp", "_hash")
LEAKY_WORDS = ("timestamp", "date", "url", "notes", "title")


def safe_columns(names: Sequence[str], targets: Sequence[str], strict: bool = False) -> list[str]:
    """Columns that may be used as features; ``strict`` goes by words in the name."""
    out = []
    for n in names:
        low = n.lower()
        if n in LEAKY_NAMES or n in targets or "backfill" in low:
            continue
        if strict and any(w in low for w in LEAKY_WORDS):
            continue
        if not strict and n.endswith(LEAKY_SUFFIXES):
            continue
        out.append(n)
    return out


# --- imputation and scaling, fitted on training rows ---------------------------------------------


def fit_impute(train: DataFrame, cols: Sequence[str], strategy: str = "median") -> DataFrame:
    """One row of fill values."""
    if strategy == "median":
        from alertsieve.operators.ordering import Quantile, column_quantiles

        q = column_quantiles(train, cols, {"_q": Quantile(0.5)})
        return q.agg(*[F.max(F.when(F.col("column") == c, F.col("_q"))).alias(c) for c in cols])
    return train.agg(*[(F.avg(c) if strategy == "mean" else F.lit(0.0)).alias(c) for c in cols])


def apply_impute(df: DataFrame, fills: DataFrame) -> DataFrame:
    row = fills.first().asDict()
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(v if v is not None else 0.0)) for c, v in row.items()})


def standardise(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population std of the training rows; a constant column becomes 0."""
    s = train.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    out = with_scalars(df, s)
    out = out.withColumns({f"{c}_std": (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in cols})
    return out.drop(*[f"_{p}_{c}" for c in cols for p in "ms"])


def min_max(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    s = train.agg(*[F.min(c).alias(f"_lo_{c}") for c in cols], *[F.max(c).alias(f"_hi_{c}") for c in cols])
    out = with_scalars(df, s)
    out = out.withColumns({f"{c}_01": F.coalesce(F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")), F.lit(0.0)) for c in cols})
    return out.drop(*[f"_{p}_{c}" for c in cols for p in ("lo", "hi")])
