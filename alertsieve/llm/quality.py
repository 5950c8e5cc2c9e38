"""Quality rules whose thresholds adapt to each language and source.

Mergeable quantile sketches of each measure are built per language and source: counts in log-spaced buckets, whose
borders are fixed, so that merging adds counts and the same rows give the same sketch in any order and after any retry.
They are merged into sketches per language and of all rows and turned into fences around the middle half. The fences of
a group are drawn towards its language's, and those towards the fences of all rows, the more the fewer rows it has.
They are joined to the rows and filter them. No Python runs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertsieve.functions.probs import let
from alertsieve.llm.common import WORD_BREAKS, words
from alertsieve.session import materialise

SYMBOLS = "#*$%&|<>"  # fixed values
#: measure: (side, least spread). A row fails beyond ``reach`` spreads from the middle half; the spread is the
#: interquartile range, but no less than this, so that a group of equal values isn't cut at its median.
FENCES = {
    "symbol_share": ("upper", 0.02),
    "dup_line_share": ("upper", 0.15),
    "repeat_share": ("upper", 0.10),
    "word_length": ("both", 0.25),
    "upper_share": ("upper", 0.10),
}
REACH = 4.0
PRIOR_ROWS = 16  # what the wider group's fences weigh, in rows
GROWTH = 1.01  # from bucket to bucket: a quantile is at most 0.5 % off


def repeated_words(w: Column) -> Column:
    """Words covered by 3-word windows that occur at least twice in the array.

    Windows are compared by a 64-bit hash. Texts without a repeated window end after one hash set; in the others
    the windows are sorted once, so a long text costs n log n.
    """

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, j: (F.get(s, j - 1)["h"] == F.get(s, j)["h"]) | (F.get(s, j + 1)["h"] == F.get(s, j)["h"])
        at = let(placed, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: F.coalesce(same(s, j), F.lit(False))), lambda x: x["i"])))
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x))

    hashed = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    found = let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("bigint")))
    return F.when(F.size(w) >= 4, found).otherwise(F.lit(0).cast("bigint"))


def _count(text: Column, kept: str) -> Column:
    return F.char_length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("bigint")


def measures(text: Column) -> Column:
    """A struct of the counts of one whole text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
        return let(
            words(t),
            lambda w: let(
                lines,
                lambda x: F.struct(
                    F.size(w).cast("bigint").alias("n_words"),
                    F.char_length(F.regexp_replace(t, WORD_BREAKS, "")).cast("bigint").alias("word_chars"),
                    _count(t, SYMBOLS).alias("n_symbols"),
                    (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
                    repeated_words(w).alias("n_repeat_words"),
                    F.size(x).cast("bigint").alias("n_lines"),
                    _count(t, "A-Z").alias("n_upper"),
                ),
            ),
        )

    return let(text, of)


def sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Written: keys, measure, bucket (null: 0), n. Measures are from 0 on."""
    bucket = lambda m: F.when(F.col(m) > 0, F.ceil(F.ln(m) / F.lit(math.log(GROWTH))).cast("int"))
    one = rows.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(m).alias("bucket")) for m in FENCES])))
    return materialise(one.groupBy(*keys, "measure", "bucket").agg(F.count("*").alias("n")))


def fences(sketches: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """keys, measure, rows, low, high from the merged sketches of ``keys``."""
    merged = sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    run = merged.withColumns({"_upto": F.sum("n").over(group.orderBy(F.asc_nulls_first("bucket"))), "rows": F.sum("n").over(group)})
    middle = F.coalesce(F.pow(F.lit(GROWTH), F.col("bucket")) * (2 / (1 + GROWTH)), F.lit(0.0))
    at = lambda p: F.min(F.when(F.col("_upto") >= F.ceil(F.col("rows") * p), middle))
    found = run.groupBy(*keys, "measure", "rows").agg(at(0.25).alias("_q1"), at(0.75).alias("_q3"))
    least, both = F.lit(None).cast("double"), F.lit(False)
    for m, (side, spread) in FENCES.items():
        least = F.when(F.col("measure") == m, F.lit(spread)).otherwise(least)
        both = F.when(F.col("measure") == m, F.lit(side == "both")).otherwise(both)
    spread = F.greatest(F.col("_q3") - F.col("_q1"), least) * reach
    return found.select(*keys, "measure", "rows", F.when(both, F.col("_q1") - spread).alias("low"), (F.col("_q3") + spread).alias("high"))


def group_limits(rows: DataFrame, good: Column, reach: float, prior: float) -> DataFrame:
    """_lang, _source, _limit (measure: low, high) for each language and source of ``rows``; from its good rows and the wider groups'."""
    sketches = sketch(rows.where(good), ["_lang", "_source"])
    named = lambda t, p: t.select(*[F.col(c).alias(c if c == "measure" else p + c) for c in t.columns])
    own, lang, every = named(fences(sketches, ["_lang", "_source"], reach), "o"), named(fences(sketches, ["_lang"], reach), "l"), named(fences(sketches, [], reach), "a")
    groups = rows.select("_lang", "_source").distinct().withColumn("measure", F.explode(F.array(*[F.lit(m) for m in FENCES]))).join(every, "measure", "left")
    groups = groups.join(lang, groups["_lang"].eqNullSafe(lang["l_lang"]) & (groups["measure"] == lang["measure"]), "left").drop(lang["measure"])
    groups = groups.join(own, groups["_lang"].eqNullSafe(own["o_lang"]) & groups["_source"].eqNullSafe(own["o_source"]) & (groups["measure"] == own["measure"]), "left").drop(own["measure"])

    def drawn(side: str) -> Column:
        weigh = lambda p, wider: (F.coalesce(F.col(f"{p}rows") * F.col(p + side), F.lit(0.0)) + prior * wider) / (F.coalesce(F.col(f"{p}rows"), F.lit(0)) + prior)
        return weigh("o", weigh("l", F.col(f"a{side}")))

    limit = F.struct("measure", F.struct(drawn("low").alias("low"), drawn("high").alias("high")))
    return groups.groupBy("_lang", "_source").agg(F.map_from_entries(F.collect_list(limit)).alias("_limit"))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", id_col: str = "doc_id", reach: float = REACH, prior: float = PRIOR_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, counts, ``base_failed``, ``failed`` (names of failed measures) and ``kept``.

    ``base_failed``: under 50 words, or more than half of the words in repeated windows. Null texts are empty and fail;
    null languages and sources are groups of their own; repeated ids keep their rows; a value at a fence is kept; other
    columns aren't read. ``prior``: the wider group counts as so many rows in a group's fences.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), F.inline(F.array(measures(F.col(text_col)))))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words")))
    rows = materialise(rows.withColumns(shares()))
    limits = group_limits(rows, ~F.col("base_failed"), reach, prior).withColumnsRenamed({"_lang": "_gl", "_source": "_gs"})
    judged = rows.join(limits, rows["_lang"].eqNullSafe(limits["_gl"]) & rows["_source"].eqNullSafe(limits["_gs"]), "left")
    beyond = [F.when((F.col(m) > F.col("_limit")[m]["high"]) | (F.col(m) < F.col("_limit")[m]["low"]), F.lit(m)) for m in FENCES]
    judged = judged.withColumn("failed", F.when(F.col("base_failed"), F.array(F.lit("base"))).otherwise(F.array_compact(F.array(*beyond))))
    return judged.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (F.size("failed") == 0).alias("kept"), "failed"
    )


def shares() -> dict[str, Column]:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "word_length": share("word_chars", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
    }
