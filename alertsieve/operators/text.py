"""Terms of texts: n-grams, TF-IDF in long form, top terms, keyword profiles, answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertsieve.functions.probs import let
from alertsieve.operators.lookup import lookup_join
from alertsieve.session import materialise

TOKEN = r"[\p{L}\p{N}_]{2,}"


def english_stop_words() -> list[str]:
    """Spark's own English list."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")


def tokens(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-cased words of two or more letters or digits, stop words removed."""
    t = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))
    if stop_words:
        # array_except would drop repeats, so filter
        t = F.filter(t, lambda w: ~w.isin(list(stop_words)))
    return t


def ngrams(t: Column, n: int = 2) -> Column:
    """Words and, for n=2, pairs of neighbouring words."""
    if n == 1:
        return t

    def both(w: Column) -> Column:
        nxt = F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0)))
        return F.concat(w, F.array_compact(F.zip_with(w, nxt, lambda x, y: F.when(y.isNotNull(), F.concat_ws(" ", x, y)))))

    return let(t, both)


def vocabulary(df: DataFrame, text: Column, n: int = 2, max_features: int = 500, min_df: int = 2, max_df: float = 1.0, stop_words: Sequence[str] = ()) -> DataFrame:
    """The most frequent terms with document frequency and smooth idf.

    Every task first adds up its own terms; corpus counts and document counts share one pass.
    """
    return corpus_vocabulary(df.select(ngrams(tokens(text, stop_words), n).alias("t")), df.count(), max_features, min_df, max_df)


def corpus_vocabulary(t: DataFrame, n_docs: int, max_features: int, min_df: int, max_df: float) -> DataFrame:
    """``vocabulary`` of rows that are cut to terms (column ``t``), most frequent first."""

    def counts(x: Column) -> Column:
        every = F.transform(x, lambda w: F.struct(w.alias("term"), F.lit(1).alias("n"), F.lit(0).alias("d")))
        return F.concat(every, F.transform(F.array_distinct(x), lambda w: F.struct(w.alias("term"), F.lit(0).alias("n"), F.lit(1).alias("d"))))

    # inline() alone would put the whole expression into a filter as well
    v = t.select(F.inline_outer(let(F.col("t"), counts))).where("term IS NOT NULL").groupBy("term").agg(F.sum("d").alias("df"), F.sum("n").alias("n"))
    v = v.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    v = v.orderBy(F.desc("n"), "term").limit(max_features)
    idf = F.ln(F.lit(1.0 + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0
    return v.select("term", "df", idf.alias("idf"))


def weigh(df: DataFrame, key: str, text: Column, vocab: DataFrame, n: int = 2, sublinear: bool = False, stop_words: Sequence[str] = ()) -> DataFrame:
    """L2-normalised weights ``key, term, weight`` of the vocabulary's terms.

    Other terms are dropped inside the row, before anything is exploded or shuffled.
    """
    return _weigh(df.select(key, ngrams(tokens(text, stop_words), n).alias("t")), key, vocab, sublinear)


def _weigh(tokenised: DataFrame, key: str, vocab: DataFrame, sublinear: bool) -> DataFrame:
    rows = vocab.collect()  # at most max_features rows
    known = [r["term"] for r in rows]
    v = tokenised.sparkSession.createDataFrame(rows, vocab.schema)
    t = tokenised.select(key, F.explode_outer(F.filter("t", lambda w: w.isin(known))).alias("term")).where("term IS NOT NULL")
    tf = t.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    w = tf.join(F.broadcast(v), "term")
    c = F.ln(F.col("tf")) + 1.0 if sublinear else F.col("tf").cast("double")
    # a document has at most max_features terms
    total = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return w.withColumn("_w", c * F.col("idf")).select(key, "term", (F.col("_w") / total).alias("weight"))


def tfidf(df: DataFrame, key: str, text: Column, max_features: int = 500, n: int = 2, min_df: int = 2, max_df: float = 1.0, sublinear: bool = False, stop_words: Sequence[str] = ()) -> DataFrame:
    """Vocabulary and weights of the same documents, in long form ``key, term, weight``. Texts are cut once and written."""
    t = materialise(df.select(key, ngrams(tokens(text, stop_words), n).alias("t")))
    return _weigh(t, key, corpus_vocabulary(t, t.count(), max_features, min_df, max_df), sublinear)


def top_terms(weights: DataFrame, k: int, n_docs: int | None = None) -> DataFrame:
    """Terms with the largest summed (or, with ``n_docs``, mean) weight."""
    s = weights.groupBy("term").agg(F.sum("weight").alias("score"))
    if n_docs:
        s = s.withColumn("score", F.col("score") / n_docs)
    return s.orderBy(F.desc(F.round("score", 9)), "term").limit(k)


def frequent_terms(df: DataFrame, text: Column, k: int, stop_words: Sequence[str] = (), min_length: int = 3) -> DataFrame:
    t = df.select(F.explode(tokens(text, stop_words)).alias("term")).where(F.length("term") >= min_length)
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(k)


def keyword_profile(train: DataFrame, key: str, text: Column, label: str, max_terms: int = 200, min_df: int = 5, stop_words: Sequence[str] = ()) -> DataFrame:
    """Class shares of the documents that contain a term: ``term, label, share``."""
    seen = train.select(key, label, F.explode(F.array_distinct(tokens(text, stop_words))).alias("term"))
    per = seen.groupBy("term", label).agg(F.count(F.lit(1)).alias("_n"))
    top = per.groupBy("term").agg(F.sum("_n").alias("_d")).where(F.col("_d") >= min_df).orderBy(F.desc("_d"), "term").limit(max_terms)
    j = lookup_join(per, top, ["term"], "inner")
    return j.select("term", label, (F.col("_n") / F.col("_d")).alias("share"))


def keyword_features(profile: DataFrame, df: DataFrame, key: str, text: Column, label: str, stop_words: Sequence[str] = ()) -> DataFrame:
    """Mean class shares over the known terms of each row, normalised: ``key, label, share``."""
    t = df.select(key, F.explode(F.array_distinct(tokens(text, stop_words))).alias("term"))
    s = lookup_join(t, profile, ["term"], "inner").groupBy(key, label).agg(F.sum("share").alias("_s"))
    tot = s.groupBy(key).agg(F.sum("_s").alias("_t"))
    return s.join(tot, key).select(key, label, (F.col("_s") / F.col("_t")).alias("share"))


def majority_vote(df: DataFrame, key: str, answer: str) -> DataFrame:
    """Most frequent answer per key with its share (first name on ties)."""
    c = df.groupBy(key, answer).agg(F.count(F.lit(1)).alias("_n"))
    g = c.groupBy(key).agg(F.min_by(answer, F.struct(-F.col("_n"), F.col(answer))).alias("prediction"), F.max("_n").alias("_m"), F.sum("_n").alias("n_samples"), F.count(F.lit(1)).alias("n_unique"))
    return g.select(key, "prediction", (F.col("_m") / F.col("n_samples")).alias("confidence"), "n_samples", "n_unique")


def few_shot(df: DataFrame, label: str, key: str, text: str, n: int = 5) -> DataFrame:
    """The first example of each class by key, then further ones, ``n`` in all."""
    from alertsieve.operators.topk import first_k

    first = df.groupBy(label).agg(F.min_by(F.struct(key, text), F.col(key)).alias("_e")).select(label, "_e.*")
    head = first.orderBy(key).limit(n).withColumn("_o", F.lit(0))
    rest = first_k(df.select(label, key, text).join(head.select(key), key, "left_anti").withColumn("_one", F.lit(1)), ["_one"], [key], n)
    both = head.unionByName(rest.select(label, key, text, F.lit(1).alias("_o")))
    return both.orderBy("_o", key).limit(n).drop("_o")


def bounded_labels(df: DataFrame, col: str, limit: int = 5_000) -> list[str]:
    """The label names in order; raises if there are too many for one expression."""
    rows = df.select(col).where(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} labels")
    return sorted(r[0] for r in rows)


def prices(spark: SparkSession, table: dict[str, tuple[float, float]]) -> DataFrame:
    return spark.createDataFrame([(m, a, b) for m, (a, b) in table.items()], "model string, price_in double, price_out double")

