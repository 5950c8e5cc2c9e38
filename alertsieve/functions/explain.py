"""Explanation texts for prediction sets, as Columns.

The row needs pa, pb (probability vectors of the text and the metadata model), preda, predb,
agree and a prediction set ``pset`` (array<int> in rank order of pa).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertsieve.functions.probs import ranked

# The two accuracies, the bounds of the tiers and the sentences of the functions below.
AGREE_ACCURACY, DISAGREE_ACCURACY = 0.857, 0.271
# What the two models are called in the texts.
TEXT_MODEL, METADATA_MODEL = "the text model", "the metadata model"


def pct(p: Column) -> Column:
    """A share as a whole percentage, half to even as in text formatting of floats."""
    return F.concat(F.bround(p * 100, 0).cast("int").cast("string"), F.lit("%"))


def class_name(c: Column) -> Column:
    return F.concat(F.lit("Class_"), c.cast("string"))


def confidence_tier(pmax: Column, agree: Column) -> Column:
    return F.when((pmax > 0.85) | (agree & (pmax > 0.70)), "HIGH").when(pmax >= 0.50, "MEDIUM").otherwise("LOW")


def action(size: Column, agree: Column) -> Column:
    """Action sentence by set size and agreement."""
    n = size.cast("string")
    return (
        F.when((size == 1) & agree, F.lit("AUTO-TRIAGE -- High confidence, models agree, singleton prediction set."))
        .when(size == 1, F.lit("AUTO-TRIAGE WITH CAUTION -- Singleton set but models disagree on other candidates."))
        .when((size <= 3) & agree, F.concat(F.lit("REVIEW SHORTLIST -- Models agree. Choose from "), n, F.lit(" candidates.")))
        .when(size <= 3, F.concat(F.lit("REVIEW SHORTLIST -- Models disagree. Examine the bug report and choose from "), n, F.lit(" candidates.")))
        .when(size <= 5, F.concat(F.lit("REVIEW NEEDED -- "), n, F.lit(" candidates in prediction set.")))
        .otherwise(F.concat(F.lit("NEEDS CAREFUL REVIEW -- Large prediction set ("), n, F.lit(" candidates). Model is uncertain.")))
    )


def action_kind(size: Column, agree: Column) -> Column:
    return F.trim(F.get(F.split(action(size, agree), " -- "), F.lit(0)))


def reliability(agree: Column, tier: Column, text_model: str = TEXT_MODEL) -> Column:
    return (
        F.when(agree, F.lit(f"High -- both models agree. In similar cases, accuracy is ~{AGREE_ACCURACY:.0%}."))
        .when(tier == "HIGH", F.lit(f"Moderate -- models disagree but {text_model} is very confident. Review recommended."))
        .otherwise(F.lit(f"Low -- models disagree. In similar cases, accuracy is ~{DISAGREE_ACCURACY:.0%}. Careful review recommended."))
    )


def top_candidate(ra: Column, agree: Column, text_model: str = TEXT_MODEL) -> Column:
    why = F.when(agree, "Both models agree on this component.").otherwise("Highest probability from text analysis.")
    return F.concat(class_name(ra[0]["cls"]), F.lit(f" -- ranked #1 by {text_model} ("), pct(ra[0]["p"]), F.lit(" confidence). "), why)


def alternatives(pset: Column, pa: Column, pb: Column, preda: Column, predb: Column, agree: Column, alpha: float, names: tuple[str, str] = (TEXT_MODEL, METADATA_MODEL)) -> Column:
    """One sentence per set member other than the top class, by probability."""
    cover = f"Included to meet {round((1 - alpha) * 100)}% coverage guarantee."

    def line(c: Column, i: Column) -> Column:
        own = F.concat(
            class_name(c), F.lit(" -- ranked #"), (i + 1).cast("string"), F.lit(f" by {names[0]} ("), pct(F.get(pa, c)), F.lit(f" confidence). {cover}")
        )
        other = F.concat(
            class_name(c), F.lit(f" -- ranked #1 by {names[1]} ("), pct(F.get(pb, c)), F.lit(" confidence). Highest probability from metadata patterns.")
        )
        return F.when(~agree & (c == predb), other).otherwise(own)

    # the set is a prefix of the ranking, so the position is the rank
    lines = F.transform(pset, lambda c, i: F.struct((c == preda).alias("top"), line(c, i).alias("t")))
    return F.transform(F.filter(lines, lambda x: ~x["top"]), lambda x: x["t"])


def reasoning(r: Column, prefix: str) -> Column:
    def item(i: int) -> Column:
        return F.concat(class_name(r[i]["cls"]), F.lit(" ("), pct(r[i]["p"]), F.lit(")"))

    return F.concat(F.lit(prefix + " "), item(0), F.lit(" over "), item(1), F.lit(" and "), item(2), F.lit("."))


def explain(df: DataFrame, alpha: float, names: tuple[str, str] = (TEXT_MODEL, METADATA_MODEL)) -> DataFrame:
    """Add the explanation record as columns; ``names`` are what the two models are called."""
    agree = F.col("agree")
    df = df.withColumns({"_ra": ranked(F.col("pa")), "_rb": ranked(F.col("pb")), "set_size": F.size("pset")})
    df = df.withColumn("confidence_tier", confidence_tier(F.col("_ra")[0]["p"], agree))
    return df.withColumns(
        {
            "prediction_set": F.transform("pset", class_name),
            "agreement_status": F.when(agree, "AGREE").otherwise("DISAGREE"),
            "reliability_estimate": reliability(agree, F.col("confidence_tier"), names[0]),
            "top_candidate": top_candidate(F.col("_ra"), agree, names[0]),
            "alternative_candidates": alternatives(F.col("pset"), F.col("pa"), F.col("pb"), F.col("preda"), F.col("predb"), agree, alpha, names),
            "action_recommendation": action(F.col("set_size"), agree),
            "action_kind": action_kind(F.col("set_size"), agree),
            "model_reasoning": F.struct(
                reasoning(F.col("_ra"), "Text analysis points to").alias("text"),
                reasoning(F.col("_rb"), "Metadata patterns point to").alias("metadata"),
            ),
        }
    ).drop("_ra", "_rb")


def summary(explained: DataFrame) -> DataFrame:
    """Distribution of actions, agreement and tiers plus mean size, as (metric, value) rows."""
    n = F.count(F.lit(1))
    kinds = ["AUTO-TRIAGE", "AUTO-TRIAGE WITH CAUTION", "REVIEW SHORTLIST", "REVIEW NEEDED", "NEEDS CAREFUL REVIEW"]
    items = [("total", n.cast("double"))]
    items += [(f"action {k}", F.count_if(F.col("action_kind") == k).cast("double")) for k in kinds]
    items += [(f"status {k}", F.count_if(F.col("agreement_status") == k).cast("double")) for k in ("AGREE", "DISAGREE")]
    items += [(f"confidence {k}", F.count_if(F.col("confidence_tier") == k).cast("double")) for k in ("HIGH", "MEDIUM", "LOW")]
    items += [("avg_set_size", F.avg("set_size")), ("different_top", F.avg((F.col("agreement_status") == "DISAGREE").cast("double")))]
    one = explained.agg(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in items]).alias("r"))
    return one.select(F.inline("r"))
