"""Token counts of texts under a unigram piece model, by dynamic programming over a trie of distinct pre-tokens.

The distinct pre-tokens of a part of the table form a trie. At each node stands the best forward score of its prefix
and the tokens on that path; both follow from the nodes above, whatever comes below, so each shared prefix is scored
once. The pre-tokens are walked in sorted order, which visits the trie depth first with only the path to the current
node in memory. The counts at terminal nodes are kept, and a text's count is the sum over its pre-tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertsieve.llm.common import kept_in_worker, text_slices
from alertsieve.llm.pieces import Cutter, PieceModel

KEPT = 250_000  # terminal counts that a worker keeps
UNKNOWN_COST = 10.0  # below the least score of a piece (fixed value)


class TrieCounter:
    def __init__(self, model: PieceModel):
        self.cut = Cutter(model)
        self.bytes = bool(model.bytes())
        self.ends: dict = {}  # trie of the pieces read from their ends
        for piece, number in model.normal().items():
            node = self.ends
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = model.scores[number]
        self.least = min((model.scores[i] for i in model.normal().values()), default=0.0) - UNKNOWN_COST
        self.known: dict[str, int] = {}

    def insert(self, words: list[str]) -> None:
        """Counts of new pre-tokens; ties between paths go to the one with fewer tokens."""
        best, count, before = [0.0], [0], ""
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                top, n, alone = None, 0, False
                node, j = self.ends.get(word[i - 1]), i - 1
                while node is not None:
                    if (score := node.get("")) is not None:
                        alone |= j == i - 1
                        total, tokens = best[j] + score, count[j] + 1
                        if top is None or total > top or (total == top and tokens < n):
                            top, n = total, tokens
                    j -= 1
                    node = node.get(word[j]) if j >= 0 else None
                if not alone:
                    total, tokens = best[i - 1] + self.least, count[i - 1] + (len(word[i - 1].encode("utf-8", "surrogatepass")) if self.bytes else 1)
                    if top is None or total > top:
                        top, n = total, tokens
                best.append(top)
                count.append(n)
            before = word
            self.known[word] = count[-1]

    def count(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Pre-tokens and tokens of whole texts."""
        units = [self.cut(t) for t in texts]
        new = set().union(*units)
        if len(self.known) + len(new) > KEPT:
            self.known.clear()
        self.insert([w for w in new if w not in self.known])
        get = self.known.__getitem__
        return [len(u) for u in units], [sum(map(get, u)) for u in units]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_pretokens, n_tokens of the whole text.

    Null and empty texts have 0 of both; repeated rows are counted each; other columns are not read. Nothing is
    shuffled, and a task holds the pre-tokens of a few megabytes of text and at most ``KEPT`` counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_in_worker(("trie", model_path), lambda: TrieCounter(PieceModel.read(model_path)))
        for batch in text_slices(batches, 1, 4 << 20):
            n, tokens = counter.count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(tokens, pa.int64())], ["_id", "n_pretokens", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "_id bigint, n_pretokens bigint, n_tokens bigint").withColumnRenamed("_id", id_col)
