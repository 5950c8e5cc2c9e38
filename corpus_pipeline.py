"""A pipeline over the documents table: every stage works on what the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns rows; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertsieve.llm import decontaminate, jaccard, language, quality, sentencepiece_fst
from alertsieve.llm.common import read
from alertsieve.session import materialise

LEAST_SCORE = 0.3  # a text whose best language scores less is in none of the learned languages


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; those without letters or below ``LEAST_SCORE`` go."""
    model = language.fit(docs)
    scored = language.predict(docs, model)
    kept = scored.where((F.col("lang_pred") != language.UNDECIDED) & (F.col("lang_score") >= LEAST_SCORE))
    return kept.select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule of their language and source go.

    The verdict needs only id, text, language and source, so rows that repeat an id are kept if any of them is.
    """
    kept = quality.judge(docs).where("kept").select("doc_id").distinct()
    kept = kept.withColumnRenamed("doc_id", "_kept")
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest id stays (five-word shingles, 0.8).

    Rows that repeat an id are one document; rows without an id stay once for each text.
    """
    found = jaccard.jaccard_components(docs, k=5, percent=80)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id IS NULL").dropDuplicates(["text"]))


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, go."""
    leaks = decontaminate.leaks(docs, read(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """doc_id, lang, source, piece_ids and n_pieces of each document, and whether the ids give the text back."""
    import public_tokenizers

    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    back = sentencepiece_fst.decode(sentencepiece_fst.encode(docs, path), path)
    return back.select("doc_id", "lang", "source", "piece_ids", F.size("piece_ids").alias("n_pieces"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("benchmark_leaks", leak_stage),
    ("sentence_pieces", piece_stage),
]

ORACLE_SQL = None  # models and sketches have no SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
