"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

p(word | history) = p(class | history) p(word | class). The class is a softmax over hashed features of the history: the
word before, the one before that (a skip), both together, and a bias. Each of the ``HOT`` words is a feature by itself. The word within its class has bias features
only, whose maximum-entropy solution is its smoothed share of the class. Frequent words have classes of their own;
the others of the ``HOT`` most frequent words share the class of the frequent word that they follow most above its
share; all further words, those seen once and unknown ones included, form the last class.

Counts of all training words are added up in tasks first and then by shuffle. So are the histories: how often each class
follows each pair of words before, packed as sorted numbers. The weights are trained on these by ``ROUNDS`` of gradient sums: each round, the
tasks add up what the model expects of each feature and class, the sums are added by shuffle, and each weight moves along
observed minus expected. So the weights come from all rows, however these are partitioned. Words are compared as 64-bit hashes; only the ``HOT`` words are broadcast, the counts of
all others are joined to the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertsieve.llm.common import mix64, most_frequent, text_slices, tidy, word_hashes
from alertsieve.session import materialise, release

HOT = 1 << 18  # words whose counts and classes are broadcast
CLASSES = 32
OWN_CLASS = 10  # most frequent words with a class of their own
LEADERS = 20  # frequent words that give the shared classes
BUCKETS = 1 << 16
CHUNK = 1 << 22  # tokens that a task counts at once
SHARD_TOKENS = 1 << 21  # tokens whose histories are merged at once
PART = 1024  # keys in a packed row, so that a batch of rows is small
PARTS = 64  # packed rows that a task adds up at once
TASK_KEYS = 1 << 23  # keys for which a task of a round sends a table of sums, so that the tables follow the input
STEPS = 16  # hot words of one slot that are looked at one by one
PIECE = 8192  # sums in a row of the shuffle
STEP = 8192  # histories whose softmax is computed at once
ROUNDS = 10
RATE = 2.0  # of a step of (observed - expected) / the larger of them, shared by the features of a token
END = np.uint64(0x656E642D6F662D74)
OTHER, RARE = CLASSES - 2, CLASSES - 1
PLACE = np.int64(BUCKETS.bit_length() - 1)  # bits of a bucket in a history


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text closed by the end token, and where each text begins and ends."""
    words, edges = word_hashes(texts)
    return np.insert(words, edges[1:], END), edges + np.arange(len(edges))


def slots_of(hashes: np.ndarray) -> tuple[int, np.ndarray, int]:
    """For sorted hashes: the shift that gives a hash's slot, where the hashes of each slot begin, and the most of a slot."""
    bits = len(hashes).bit_length() + 1
    begin = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)
    return 64 - bits, begin, int(np.diff(begin, append=len(hashes)).max())


def places_among(hashes: np.ndarray, slots: tuple[int, np.ndarray, int], tokens: np.ndarray) -> np.ndarray:
    """Places of the tokens among sorted hashes, or -1. Hashes are spread evenly, so a token's slot gives its place up to a few."""
    if not len(hashes):
        return np.full(len(tokens), -1)
    shift, begin, most = slots
    if most > STEPS:
        at = np.minimum(np.searchsorted(hashes, tokens), len(hashes) - 1)
    else:
        at = begin.take((tokens >> np.uint64(shift)).astype(np.intp)).astype(np.intp)
        for _ in range(most - 1):
            at += hashes.take(at, mode="clip") < tokens
        np.minimum(at, len(hashes) - 1, out=at)
    return np.where(hashes.take(at) == tokens, at, -1)


@dataclass
class Vocabulary:
    hashes: np.ndarray  # of the hot words, sorted
    counts: np.ndarray
    ranks: np.ndarray  # by count
    classes: np.ndarray
    total: int  # training tokens
    distinct: int

    @cached_property
    def slots(self) -> tuple[int, np.ndarray, int]:
        return slots_of(self.hashes)

    def look_up(self, tokens: np.ndarray) -> np.ndarray:
        """Places of the tokens among the hot words, or -1."""
        return places_among(self.hashes, self.slots, tokens)

    @cached_property
    def names(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names of the classes, of the place before a text and of the hot words; their buckets as nearer and as other word."""
        names = np.append(np.arange(CLASSES + 1, dtype=np.uint64), mix64(self.hashes))
        return names, bucket(names, 1) << 2 * PLACE, bucket(names, 2) << PLACE

    def word_shares(self) -> tuple[np.ndarray, float]:
        """log10 p(word | class) of the hot words; log10 of what a count of rare words is divided by."""
        size = np.bincount(self.classes, self.counts, CLASSES) + np.bincount(self.classes, minlength=CLASSES)
        rare = self.total - int(self.counts.sum()) + self.distinct - len(self.hashes) + 1
        return np.log10(self.counts + 1.0) - np.log10(size[self.classes]), float(np.log10(rare))


    def class_bias(self) -> np.ndarray:
        """Logarithms of the shares of the classes in the training tokens: the model before any gradient step."""
        size = np.bincount(self.classes, self.counts, CLASSES) + 1.0
        size[RARE] += self.total - int(self.counts.sum())
        return np.log(size / size.sum()).astype(np.float32)


def bucket(names: np.ndarray, kind: int) -> np.ndarray:
    return (mix64(names * np.uint64(4) + np.uint64(kind)) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1


def class_of(vocabulary: Vocabulary, places: np.ndarray) -> np.ndarray:
    return np.where(places < 0, RARE, vocabulary.classes[places] if len(vocabulary.classes) else RARE)


def histories(vocabulary: Vocabulary, places: np.ndarray, classes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each token the buckets of the features of the two words before it, in one number: nearer one, other one, both.

    A hot word is named by its own hash, the others by their class, the place before the first word by CLASSES.
    """
    names, near, far = vocabulary.names
    named = np.where(places >= 0, places + CLASSES + 1, classes)
    before = np.full((2, len(places)), CLASSES)
    before[0, 1:], before[1, 2:] = named[:-1], named[:-2]
    first = edges[:-1]
    before[0, first] = CLASSES
    before[1, first] = CLASSES
    second = first + 1
    before[1, second[second < edges[1:]]] = CLASSES
    both = bucket(names[before[0]] * np.uint64(8191) + names[before[1]], 3)
    return near[before[0]] | far[before[1]] | both


def features(history: np.ndarray) -> np.ndarray:
    """Buckets of the features of histories: bias, word before, word two before, both. A row for each."""
    out = np.zeros((len(history), 4), np.uint16)
    for k in (1, 2, 3):
        out[:, k] = (history >> (3 - k) * PLACE) & (BUCKETS - 1)
    return out


def exponentials(weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Exponentials of the summed weights of each row's features, less the largest."""
    z = weights.take(at[:, 0], axis=0)
    one = np.empty_like(z)
    for k in range(1, at.shape[1]):
        z += np.take(weights, at[:, k].astype(np.intp), axis=0, out=one, mode="clip")
    z -= z.max(1, keepdims=True)
    return np.exp(z, out=z)


def class_shares(weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Softmax of the summed weights of each row's features."""
    z = exponentials(weights, at)
    z /= z.sum(1, keepdims=True)
    return z


def class_logs(weights: np.ndarray, at: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """log10 of the softmax at each row's class, ``STEP`` rows at once."""
    out = np.empty(len(at), weights.dtype)
    for i in range(0, len(at), STEP):
        z, c = exponentials(weights, at[i : i + STEP]), classes[i : i + STEP]
        out[i : i + STEP] = z[np.arange(len(c)), c] / z.sum(1)
    return np.log10(np.maximum(out, 1e-30))


def renumbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets in ``x``, and for each row the place of its bucket among them."""
    seen = np.zeros(BUCKETS, bool)
    seen[x] = True
    found = np.flatnonzero(seen)
    place = np.empty(BUCKETS, np.intp)
    place[found] = np.arange(len(found))
    return found, place[x]


def byte_places(x: np.ndarray) -> bytes:
    """Numbers from 0 on as their lowest bytes, then their next ones, and so on; few bytes that compress well if the numbers are small."""
    places = (int(x.max(initial=0)).bit_length() + 7) // 8
    return x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :places].T.tobytes()


def from_byte_places(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((size, 8), np.uint8)
    if data:
        out[:, : len(data) // size] = np.frombuffer(data, np.uint8).reshape(-1, size).T
    return out.view("<i8").ravel()


PACKED = "shard int, size int, first bigint, keys binary, counts binary"


def pack(shards: list[int], parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """A row for each part of sorted keys with their counts."""
    columns = [
        pa.array(shards, pa.int32()),
        pa.array([len(k) for k, _ in parts], pa.int32()),
        pa.array([int(k[0]) for k, _ in parts], pa.int64()),
        pa.array([byte_places(np.diff(k)) for k, _ in parts], pa.binary()),
        pa.array([byte_places(n) for _, n in parts], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["shard", "size", "first", "keys", "counts"])


def unpack(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of all rows, one after the other."""
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size, first, k, n in zip(*(rows.column(c).to_pylist() for c in ("size", "first", "keys", "counts"))):
        keys.append(np.cumsum(np.append(first, from_byte_places(k, size - 1))))
        counts.append(from_byte_places(n, size))
    return np.concatenate(keys), np.concatenate(counts)


def add_up(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of sorted keys and the sums of their counts."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(n, first) if len(n) else n


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    held, size = [], 0
    for batch in text_slices(batches, 0):
        held.append(tokens_of(batch.column(0))[0])
        size += len(held[-1])
        if size >= CHUNK:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def count_words(texts: DataFrame) -> DataFrame:
    """Written: h, n of each distinct word of the column ``_text``, the end token included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens in _chunks(batches):
            found, n = np.unique(tokens, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return materialise(texts.mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")))


def build_vocabulary(texts: DataFrame, counts: DataFrame, hot: int = HOT) -> Vocabulary:
    context = texts.sparkSession.sparkContext
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = most_frequent(counts.where("n > 1"), "n", hot).orderBy(F.desc("n"), "h").toArrow()  # at most ``hot`` rows; words seen once stand for the unknown ones too
    hashes = top["h"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    hashes, n = hashes[order], top["n"].to_numpy().astype(np.int64)[order]
    sent = context.broadcast((hashes, order))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = sent.value
        slots = slots_of(known)
        for tokens in _chunks(batches):
            if not len(known):
                continue
            at = places_among(known, slots, tokens)
            hit = at >= 0
            pair = np.flatnonzero(hit[1:] & hit[:-1] & (rank[at[:-1]] < LEADERS))
            found, n = np.unique(at[pair + 1] * LEADERS + rank[at[pair]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found // LEADERS), pa.array(found % LEADERS), pa.array(n.astype(np.int64))], ["w", "leader", "n"])

    pairs = texts.mapInArrow(follow, "w bigint, leader bigint, n bigint").groupBy("w", "leader").agg(F.sum("n").alias("n"))
    size = np.ones(LEADERS)
    size[: min(LEADERS, len(n))] = np.sort(n)[::-1][:LEADERS]
    share = F.col("n") / F.element_at(F.array(*[F.lit(float(x)) for x in size]), (F.col("leader") + 1).cast("int"))
    best = pairs.groupBy("w").agg(F.max_by("leader", F.struct(share.alias("x"), -F.col("leader"))).alias("leader")).toArrow()  # at most ``hot`` rows
    classes = np.full(len(hashes), OTHER)
    classes[best["w"].to_numpy().astype(np.int64)] = OWN_CLASS + best["leader"].to_numpy().astype(np.int64)
    own = order < OWN_CLASS
    classes[own] = order[own]
    return Vocabulary(hashes, n, order, classes, int(total), int(distinct))


def count_histories(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Written: how often each class follows each history, as packed parts of sorted keys (history * CLASSES + class) with their counts.

    Tasks count their own tokens, and a shard of the histories (by the bucket of both words, a hash) is merged at once, about
    ``SHARD_TOKENS`` keys at most. The rows travel and stay packed, ``PART`` keys in a row.
    """
    context = texts.sparkSession.sparkContext
    sent = context.broadcast(asdict(vocabulary))
    shards = min(max(2 * context.defaultParallelism, -(-vocabulary.total // SHARD_TOKENS)), BUCKETS // 2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(**sent.value)

        def dealt(held: list[np.ndarray]) -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            shard = (keys // CLASSES % BUCKETS % shards).astype(np.uint16)
            order = np.argsort(shard, kind="stable")
            some, at = np.unique(shard[order], return_index=True)
            return pack(some.tolist(), list(zip(np.split(keys[order], at[1:]), np.split(n[order], at[1:]))))

        held, size = [], 0
        for batch in text_slices(batches, 0):
            tokens, edges = tokens_of(batch.column(0))
            places = words.look_up(tokens)
            classes = class_of(words, places)
            held.append(histories(words, places, classes, edges) * CLASSES + classes)
            size += len(tokens)
            if size >= CHUNK:
                yield dealt(held)
                held, size = [], 0
        if size:
            yield dealt(held)

    def merge(rows: pa.Table) -> pa.Table:
        keys, n = unpack(rows)
        order = np.argsort(keys, kind="stable")
        keys, n = add_up(keys[order], n[order])
        starts = range(0, len(keys), PART)
        return pa.Table.from_batches([pack([rows.column("shard")[0].as_py()] * len(starts), [(keys[i : i + PART], n[i : i + PART]) for i in starts])])

    return materialise(texts.mapInArrow(tidy(count), PACKED).groupBy("shard").applyInArrow(merge, PACKED))


def train(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (BUCKETS x CLASSES) after rounds of gradient sums over all histories."""
    context = texts.sparkSession.sparkContext
    counted = count_histories(texts, vocabulary)
    keys = counted.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = min(context.defaultParallelism, max(1, -(-keys // TASK_KEYS)))

    def added(start) -> np.ndarray:
        """The sum of the (CLASSES x BUCKETS) tables that the tasks add to, by the function that ``start`` gives each task.

        Each task sends a whole table, in pieces that are added up by shuffle, so there is one for ``TASK_KEYS`` keys and for each core at most.
        """

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, add = np.zeros((CLASSES, BUCKETS)), start()
            for batch in batches:
                for i in range(0, batch.num_rows, PARTS):
                    add(total, *unpack(batch.slice(i, PARTS)))
            pieces = total.reshape(-1, PIECE)
            some = np.flatnonzero(pieces.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([x.tobytes() for x in pieces[some]], pa.binary())], ["piece", "sums"])

        def whole(rows: pa.Table) -> pa.Table:
            out = np.zeros(PIECE)
            for x in sorted(rows.column("sums").to_pylist()):  # in the same order each time
                out += np.frombuffer(x)
            return pa.table({"piece": rows.column("piece")[:1], "sums": pa.array([out.tobytes()], pa.binary())})

        kind = "piece int, sums binary"
        each = counted.coalesce(tasks).mapInArrow(tidy(sums), kind)
        got = each.groupBy("piece").applyInArrow(whole, kind).toArrow()  # CLASSES * BUCKETS / PIECE rows, never as Python's numbers
        out = np.zeros((CLASSES * BUCKETS // PIECE, PIECE))
        for piece, x in zip(got["piece"].to_pylist(), got["sums"]):
            out[piece] = np.frombuffer(x.as_buffer())
        return out.reshape(CLASSES, BUCKETS)

    def count():
        def add(total: np.ndarray, keys: np.ndarray, n: np.ndarray) -> None:
            c = keys % CLASSES
            total[:, 0] += np.bincount(c, n, CLASSES)
            for at in features(keys // CLASSES)[:, 1:].T:
                np.add.at(total.reshape(-1), c * BUCKETS + at, n.astype(np.float64))

        return add

    def expect(weights: np.ndarray) -> np.ndarray:
        """How often the model expects each class after each feature."""
        sent = context.broadcast(weights)

        def start():
            factors = np.exp(sent.value.T.astype(np.float64))  # a softmax of sums is a share of products, so no history needs an exponential

            room = np.empty((CLASSES + 1, PARTS * PART))

            def add(total: np.ndarray, keys: np.ndarray, n: np.ndarray) -> None:
                history, n = add_up(keys // CLASSES, n)
                shares, x = room[:CLASSES, : len(history)], room[CLASSES, : len(history)]
                near, *others = kinds = [renumbered(at) for at in features(history)[:, 1:].T]  # so few numbers of a class are used that a core's cache holds them
                for f, share in zip(factors, shares):
                    np.take(f[near[0]] * f[0], near[1], out=share, mode="clip")
                    for found, at in others:
                        share *= np.take(f[found], at, out=x, mode="clip")
                shares *= n / shares.sum(axis=0)
                total[:, 0] += shares.sum(axis=1)
                for sums, share in zip(total, shares):
                    for found, at in kinds:
                        sums[found] += np.bincount(at, share, len(found))

            return add

        out = added(start)
        sent.destroy()
        return out

    weights = np.zeros((BUCKETS, CLASSES), np.float32)
    weights[0] = vocabulary.class_bias()  # bucket 0 is the bias of every token
    observed = added(count)
    for _ in range(rounds):
        expected = expect(weights)
        for i in range(0, BUCKETS, STEP):  # a part at a time, as the driver holds the tables already
            seen, awaited = observed[:, i : i + STEP].T, expected[:, i : i + STEP].T
            weights[i : i + STEP] += (RATE / 4 * (seen - awaited) / (np.maximum(seen, awaited) + 4.0)).astype(np.float32)
        release(texts)  # the shuffle files of the rounds
    release(counted)
    return weights


def score(docs: DataFrame, learned: Column, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Per row of ``docs``: id, learned, n_tokens, n_known, train_tokens, base_score, score.

    Rows where ``learned`` holds train the counts and the model; all rows are scored, whole texts. ``base_score`` is the
    log10 probability under add-one unigrams, ``score`` that under the model. Null texts are empty and have the end
    token only; repeated rows keep their rows; other columns are not read. Without training rows every token is the one
    unknown event, whose probability is 1 in the base.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(learned, F.lit(False)).alias("_learned"))
    texts = rows.where("_learned").select("_text")
    counts = count_words(texts)
    vocabulary = build_vocabulary(texts, counts, hot)
    weights = train(texts, vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast((asdict(vocabulary), weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(**sent.value[0])
        model = sent.value[1]
        shares, rare_size = words.word_shares()
        plain = np.log10(words.counts + 1.0)
        row = TaskContext.get().partitionId() << 33
        for batch in text_slices(batches, 1):
            tokens, edges = tokens_of(batch.column(1))
            places = words.look_up(tokens)
            classes = class_of(words, places)
            known = places >= 0
            at = features(histories(words, places, classes, edges))
            value = class_logs(model, at, classes)
            value = value.astype(np.float64)
            value[known] += shares[places[known]]
            value[~known] -= rare_size
            base = np.zeros(len(tokens))
            base[known] = plain[places[known]]
            sums = lambda x: np.add.reduceat(x, edges[:-1])  # noqa: E731  each text has its end token, so none is empty
            rare = np.flatnonzero(~known)
            ends = np.searchsorted(rare, edges).astype(np.int32)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), batch.column(0), batch.column(2), pa.array(np.diff(edges)), pa.array(sums(known.astype(np.int64))), pa.array(sums(base)), pa.array(sums(value)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens[rare].view(np.int64)))],
                ["row", "_id", "_learned", "n_tokens", "n_hot", "base", "value", "rare"],
            )
            row += n

    kind = dict(rows.dtypes)["_id"]
    scored = materialise(rows.mapInArrow(run, f"row bigint, _id {kind}, _learned boolean, n_tokens bigint, n_hot bigint, base double, value double, rare array<bigint>"))
    found = scored.select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count("*").alias("k")).join(counts, "h")
    found = found.groupBy("row").agg(F.sum("k").alias("n_rare"), F.sum(F.col("k") * F.log10(F.col("n") + F.lit(1.0))).alias("rare_log"))
    both = scored.drop("rare").join(found, "row", "left").na.fill(0, ["n_rare", "rare_log"])
    share = float(np.log10(vocabulary.total + vocabulary.distinct + 1))
    return both.select(
        F.col("_id").alias(id_col),
        F.col("_learned").alias("learned"),
        "n_tokens",
        (F.col("n_hot") + F.col("n_rare")).alias("n_known"),
        F.lit(vocabulary.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.col("rare_log") - F.col("n_tokens") * share).alias("base_score"),
        (F.col("value") + F.col("rare_log")).alias("score"),
    )
