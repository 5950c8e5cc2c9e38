"""Language identification by string kernels.

A text is the set of its character n-grams of 1 to ``SPECTRUM`` letters (blended spectrum, presence only), hashed to
``DIMS`` places; the kernel of two texts is their number of common n-grams over the root of the product of their
sizes. Landmarks from a bounded sample of labelled rows give Nystrom features, and a one-versus-rest kernel ridge
regression is fitted on them. As the kernel is linear in the presence vectors, landmarks and ridge weights fold into
one matrix, and a batch is scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertsieve.llm.common import drop_kept, slices, tidy

SPECTRUM = 4
DIMS = 1 << 15
SAMPLE_ROWS = 2400  # labelled rows that the model is fitted on, over all languages
LANDMARKS = 400
RIDGE = 1e-3
UNDECIDED = "und"
BATCH = 256
SCORED = 32  # texts that a task scores at once, as each has DIMS numbers


def presence(texts: list[str | None]) -> np.ndarray:
    """One row of DIMS flags for each whole text: which hashed n-grams it has."""
    out = np.zeros((len(texts), DIMS), bool)
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    for row, text in zip(out, texts):
        if not text:
            continue
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        h = c
        for n in range(1, SPECTRUM + 1):
            if n > 1:
                if len(c) < n:
                    break
                h = h[:-1] * np.uint32(0x01000193) + c[n - 1 :]
            row[((h + np.uint32(n)) * np.uint32(0x9E3779B1)) >> shift] = True
    return out


def _normed(flags: np.ndarray) -> np.ndarray:
    x = flags.astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    return x


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # DIMS x languages
    bias: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The best language and its score from 0 to 1; ``und`` and 0 for texts without letters. Ties go to the first language by name."""
        best, value = [UNDECIDED] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if rows and self.languages:
            found = _normed(presence([texts[i] for i in rows])) @ self.weights + self.bias
            top = found.argmax(1)
            for i, k, x in zip(rows, top, found.max(1)):
                best[i], value[i] = self.languages[k], float(min(max(x, 0.0), 1.0))
        return best, value


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS) -> LanguageModel:
    """Fit on at most ``sample_rows`` rows with text and label, as many of each label; one of each if there are more labels than that.

    The rows are those with the least hash of their id. Only their flags come to the driver: DIMS / 8 bytes a row.
    Without labelled rows the model knows no language and answers ``und``.
    """
    rows = docs.select(F.xxhash64(id_col).alias("_hash"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).where("_text IS NOT NULL AND _lang IS NOT NULL")
    sizes = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}  # a row for each label
    if not sizes:
        return LanguageModel([], np.zeros((DIMS, 0), np.float32), np.zeros(0, np.float32))
    each = max(1, sample_rows // len(sizes))
    share = F.element_at(F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, (2 * each + 20) / n)))]), F.col("_lang"))
    near = rows.where((F.pmod(F.col("_hash"), F.lit(1 << 30)) / float(1 << 30)) < share)  # about twice what is wanted
    order = Window.partitionBy("_lang").orderBy("_hash", F.xxhash64("_text"))
    sample = near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= each)

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for batch in slices(batches, SCORED):
            bits = np.packbits(presence(batch.column("_text").to_pylist()), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("_lang"), batch.column("_rank").cast(pa.int32()), pa.array([x.tobytes() for x in bits], pa.binary())], ["lang", "rank", "bits"])

    got = sorted(sample.select("_text", "_lang", "_rank").mapInArrow(tidy(flags), "lang string, rank int, bits binary").collect(), key=lambda r: (r["rank"], r["lang"]))
    languages = sorted({r["lang"] for r in got})
    y = np.asarray([[r["lang"] == k for k in languages] for r in got], np.float64)
    part = lambda i, n: _normed(np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in got[i : i + n]), np.uint8).reshape(-1, DIMS // 8), axis=1))
    z = part(0, landmarks)  # sorted by rank, so each language has as many landmarks
    kernel = np.concatenate([part(i, BATCH) @ z.T for i in range(0, len(got), BATCH)]).astype(np.float64)  # a batch of flags in memory at a time
    values, vectors = np.linalg.eigh(kernel[: len(z)])
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = kernel @ root
    mean = phi.mean(0)
    beta = np.linalg.solve((phi - mean).T @ (phi - mean) + RIDGE * len(phi) * np.eye(phi.shape[1]) / phi.shape[1], (phi - mean).T @ (y - y.mean(0)))
    weights = z.T @ (root @ beta).astype(np.float32)
    return LanguageModel(languages, weights.astype(np.float32), (y.mean(0) - mean @ beta).astype(np.float32))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``; names that the table has already are taken over. Whole texts are read.

    The model is broadcast: DIMS floats (128 kB) for each label.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.bias))  # plain values: workers may not know this module
    at = docs.columns.index(text_col)
    kept = [i for i, c in enumerate(docs.columns) if c not in ("lang_pred", "lang_score")]
    fields = [docs.schema.fields[i] for i in kept]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()  # a worker that encoded texts before would hold its machines beside this
        own = LanguageModel(*sent.value)
        for batch in slices(batches, SCORED):
            best, value = own.score(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(best, pa.string()), pa.array(value, pa.float64())], [*(f.name for f in fields), "lang_pred", "lang_score"])

    schema = docs.select(*[F.col(f"`{f.name}`") for f in fields]).schema.add("lang_pred", "string").add("lang_score", "double")
    return docs.mapInArrow(tidy(score), schema)
