"""Exact nearest neighbours and eps-neighbourhoods between two tables of vectors.

A small right side (checked by count) is sent to every task. A large one is cut by pivots: each
vector belongs to its nearest pivot, and triangle bounds say which right rows can matter to which
left cell. Where these bounds leave out little, as with many dimensions, both sides are packed to
matrices and meet in a grid of large blocks instead, so that rows are copied once per block of the
other side. A block returns only its k best or an aggregate per left row, never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertsieve.functions.random import keyed_uniform
from alertsieve.operators.topk import first_k
from alertsieve.session import materialise, release

SMALL_CONF, SMALL_ROWS = "spark.alertsieve.maxVectorRows", 20_000
BLOCK_ROWS = 16_384
GRID_ROWS = 65_536  # of a block of the grid
CHUNK_ROWS = 256  # vectors packed to one row
TILE = 1 << 21  # distances that a task holds at once
PRUNED = 0.25  # share of the pairs that pivots may leave for them to be used


def _small_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(SMALL_CONF, None) or SMALL_ROWS)


def unit(v: Column) -> Column:
    """Vector scaled to length one, as array<double>."""
    d = v.cast("array<double>")
    n = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: x / F.when(n > 0, n).otherwise(1.0))


def _matrix(s: pd.Series) -> np.ndarray:
    return np.vstack(s.to_numpy()).astype(np.float64) if len(s) else np.zeros((0, 1))


def _square_distances(a: np.ndarray, b: np.ndarray, squares: np.ndarray | None = None) -> np.ndarray:
    """Squared distances of all rows; ``squares`` are those of the rows of ``b``, if known."""
    out = a @ b.T
    out *= -2.0
    out += (a * a).sum(1)[:, None]
    out += (b * b).sum(1) if squares is None else squares
    return np.maximum(out, 0.0, out=out)


def _tiles(rows: int, columns: int) -> Iterator[slice]:
    step = max(1, TILE // max(columns, 1))
    return (slice(i, min(i + step, rows)) for i in range(0, rows if columns else 0, step))


def _kth_bound(d2: np.ndarray, k: int) -> np.ndarray:
    """For each row a value that at least k of its distances don't exceed, from the least of groups of columns."""
    n = d2.shape[1]
    if n <= k:
        return d2.max(1)
    w = max(1, min(64, n // (4 * k)))
    least = d2[:, : n // w * w].reshape(len(d2), n // w, w).min(2)
    return np.partition(least, k - 1, axis=1)[:, k - 1]


def _top_k(lid: np.ndarray, left: np.ndarray, rid: np.ndarray, right: np.ndarray, k: int, skip_same: bool) -> pd.DataFrame:
    """The k nearest right rows per left row; candidates by dot products, order by exact distance."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    by_id, squares = np.argsort(rid, kind="stable"), (right * right).sum(1)
    sorted_ids = rid[by_id]
    for at in _tiles(len(lid), len(rid)):
        a, ids = left[at], lid[at]
        d2 = _square_distances(a, right, squares)
        if skip_same:
            lo, hi = np.searchsorted(sorted_ids, ids, "left"), np.searchsorted(sorted_ids, ids, "right")
            for i in np.flatnonzero(hi > lo):
                d2[i, by_id[lo[i] : hi[i]]] = np.inf
        kth = _kth_bound(d2, k)
        kth += 1e-9 * (1.0 + (a * a).sum(1) + np.where(np.isfinite(kth), kth, 0.0))
        near = d2 <= np.minimum(kth, np.finfo(float).max)[:, None]
        r, c = np.divmod(np.flatnonzero(near), len(rid))
        edges = np.searchsorted(r, np.arange(len(ids) + 1))
        i = 0
        while i < len(ids):  # rows with up to 65,536 candidates at once, or one row
            j = max(i + 1, int(np.searchsorted(edges, edges[i] + 65_536, "right")) - 1)
            x, y = r[edges[i] : edges[j]], c[edges[i] : edges[j]]
            d = np.sqrt(((right[y] - a[x]) ** 2).sum(1))
            order = np.lexsort((rid[y], np.round(d, 12), x))
            x, y, d = x[order], y[order], d[order]
            best = np.arange(len(x)) - np.searchsorted(x, x) < k
            out.append((ids[x[best]], rid[y[best]], d[best]))
            i = j
    return pd.DataFrame({n: np.concatenate(v) for n, v in zip(("id", "nid", "distance"), zip(*out))})


BlockFn = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame]


def _packed(df: DataFrame) -> DataFrame:
    """Written: chunks of rows as number, ids, vectors, payload (bytes)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i in range(0, batch.num_rows, min(CHUNK_ROWS, GRID_ROWS)):
                part = batch.slice(i, min(CHUNK_ROWS, GRID_ROWS))
                v = pc.list_flatten(part.column(1)).to_numpy(zero_copy_only=False)
                if len(v) % part.num_rows or part.column(0).null_count:
                    raise ValueError("vectors of one length with an id are needed")
                sides = [part.column(0).to_numpy(), v, part.column(2).to_numpy(zero_copy_only=False).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([x.tobytes()], pa.binary()) for x in sides)], ["number", "ids", "v", "payload"])
                number += 1

    return materialise(df.mapInArrow(pack, "number long, ids binary, v binary, payload binary"))


def _unpacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not t.num_rows:  # a group that only the other side has comes without columns
        return np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(0, np.int64)
    ids, v, payload = (np.frombuffer(b"".join(x.as_buffer() for x in t.column(c)), kind) for c, kind in ((2, np.int64), (3, np.float64), (4, np.int64)))
    return ids, v.reshape(len(ids), -1), payload


def _grid(left: DataFrame, right: DataFrame, fn: BlockFn, schema: str, n_left: int, n_right: int, half: bool = False) -> DataFrame:
    """Apply ``fn`` to each block of ``left`` with each of ``right`` (both packed); with ``half``, one table, to each two blocks once."""
    nr = max(1, -(-n_right // GRID_ROWS))
    nl = max(-(-n_left // GRID_ROWS), nr if half else -(-2 * left.sparkSession.sparkContext.defaultParallelism // nr), 1)
    nr = nl if half else nr
    block = lambda n: F.pmod(F.xxhash64("number"), F.lit(n)).cast("int")
    ls = left.withColumn("lb", block(nl)).withColumn("rb", F.explode(F.sequence(F.col("lb") if half else F.lit(0), F.lit(nr - 1))))
    rs = right.withColumn("rb", block(nr)).withColumn("lb", F.explode(F.sequence(F.lit(0), F.col("rb") if half else F.lit(nl - 1))))

    def meet(a: pa.Table, c: pa.Table) -> pa.Table:
        lid, lv, _ = _unpacked(a)
        return pa.Table.from_pandas(fn(lid, lv, *_unpacked(c)), preserve_index=False)

    cols = ["lb", "rb", "ids", "v", "payload"]
    rs = rs.select([F.col(c).alias(f"_{c}") for c in cols])  # the sides may be one table
    return ls.select(cols).groupBy("lb", "rb").cogroup(rs.groupBy("_lb", "_rb")).applyInArrow(meet, schema)


def _blocked(left: DataFrame, right: DataFrame, fn: BlockFn, schema: str, reach: float | None, k: int, pivots: int) -> DataFrame:
    """Apply ``fn(left ids, left, right ids, right, right payload)`` to everything that may meet.

    ``left`` has (id, v), ``right`` (id, v, payload). ``reach`` is a fixed distance, or None for
    the k nearest. The results of different blocks of a left row have to be combined by the caller.
    """
    small = _small_rows(right)
    head = right.limit(small + 1).select("id", "v", "payload").toPandas()
    if len(head) <= small:
        rid, rv, rp = head["id"].to_numpy(np.int64), _matrix(head["v"]), head["payload"].to_numpy()

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield fn(pdf["id"].to_numpy(np.int64), _matrix(pdf["v"]), rid, rv, rp)

        return left.select("id", "v").mapInPandas(whole, schema)

    # a bounded number of pivots, drawn by hash
    centres = np.array([r["v"] for r in right.select("id", "v").orderBy(keyed_uniform(F.col("id"), "pivot"), "id").limit(pivots).collect()], dtype=np.float64)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = np.sqrt(_square_distances(_matrix(pdf["v"]), centres)) if len(pdf) else np.zeros((0, len(centres)))
            cell = d.argmin(1) if len(pdf) else np.zeros(0, dtype=int)
            yield pdf.assign(cell=cell.astype("int32"), d=d[np.arange(len(pdf)), cell])

    payload = right.schema["payload"].dataType.simpleString()
    left_c = materialise(left.select("id", "v").mapInPandas(assign, "id long, v array<double>, cell int, d double"))
    right_c = materialise(right.select("id", "v", "payload").mapInPandas(assign, f"id long, v array<double>, payload {payload}, cell int, d double"))
    between = np.sqrt(((centres[:, None, :] - centres[None, :, :]) ** 2).sum(2))
    radius = {r["cell"]: (r["r"], r["n"]) for r in left_c.groupBy("cell").agg(F.max("d").alias("r"), F.count(F.lit(1)).alias("n")).collect()}
    if reach is None:
        # an upper bound of the k-th distance of every row of a left cell (one more row, as a row may skip itself)
        near = first_k(right_c.select("cell", "d", "id"), ["cell"], ["d", "id"], k + 1).select("cell", "d").toPandas()
    bounds = []
    for i, (r, _) in radius.items():
        limit = reach
        if reach is None:
            up = np.sort(r + between[i, near["cell"].to_numpy()] + near["d"].to_numpy())
            limit = float(up[min(k, len(up) - 1)])
        for j in range(len(centres)):
            gap = float(between[i, j])
            bounds.append((j, int(i), gap - r - limit - 1e-6, gap + r + limit + 1e-6))
    spark = left.sparkSession
    b = spark.createDataFrame(bounds, "cell int, target int, lo double, hi double")
    b = b.groupBy("cell").agg(F.collect_list(F.struct("target", "lo", "hi")).alias("_b"))  # pivots x pivots entries
    sent = right_c.join(F.broadcast(b), "cell").select("id", "v", "payload", F.explode(F.filter("_b", lambda x: (F.col("d") >= x["lo"]) & (F.col("d") <= x["hi"]))["target"]).alias("cell"))
    sizes = {r["cell"]: r["n"] for r in sent.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_left, n_right = sum(n for _, n in radius.values()), right_c.count()
    if sum(n * sizes.get(i, 0) for i, (_, n) in radius.items()) > PRUNED * n_left * n_right:
        return _grid(_packed(left_c.select("id", "v", F.lit(0).alias("payload"))), _packed(right_c.select("id", "v", "payload")), fn, schema, n_left, n_right)
    plan = [(int(i), max(1, -(-n // BLOCK_ROWS)), max(1, -(-sizes.get(i, 0) // BLOCK_ROWS))) for i, (_, n) in radius.items()]
    p = F.broadcast(spark.createDataFrame(plan, "cell int, nl int, nr int"))

    def spread(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        x = df.join(p, "cell").withColumn(mine, F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
        return x.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    ls = spread(left_c.select("id", "v", "cell"), "nl", "nr", "lb", "rb").select("id", "v", "cell", "lb", "rb")
    rs = spread(sent, "nr", "nl", "rb", "lb").select("id", "v", "payload", "cell", "lb", "rb")

    def meet(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return fn(a["id"].to_numpy(np.int64), _matrix(a["v"]), c["id"].to_numpy(np.int64), _matrix(c["v"]), c["payload"].to_numpy())

    return ls.groupBy("cell", "lb", "rb").cogroup(rs.groupBy("cell", "lb", "rb")).applyInPandas(meet, schema)


def knn_join(left: DataFrame, right: DataFrame, k: int, vector: str = "v", cosine: bool = False, skip_same: bool = False, pivots: int = 64) -> DataFrame:
    """``id, nid, distance, rank`` of the k nearest right rows of every left row (both with ``id``).

    Euclidean distance, or cosine distance 1 - similarity. Ties go to the smaller id.
    """
    v = unit(F.col(vector)) if cosine else F.col(vector).cast("array<double>")
    a = left.select(F.col("id").cast("long").alias("id"), v.alias("v"))
    b = right.select(F.col("id").cast("long").alias("id"), v.alias("v"), F.lit(0).alias("payload"))

    def fn(lid, lv, rid, rv, rp):
        return _top_k(lid, lv, rid, rv, k, skip_same)

    part = _blocked(a, b, fn, "id long, nid long, distance double", None, k, pivots)
    out = first_k(part, ["id"], [F.round("distance", 12), "nid"], k).withColumnRenamed("_rank", "rank")
    return out.withColumn("distance", F.col("distance") * F.col("distance") / 2.0) if cosine else out


def within(left: DataFrame, right: DataFrame, eps: float, payload: str | None = None, pivots: int = 64) -> DataFrame:
    """Per left row the number of right rows within eps and the smallest payload among them."""
    a = left.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    b = right.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), (F.col(payload) if payload else F.col("id")).cast("long").alias("payload"))

    def fn(lid, lv, rid, rv, rp):
        n, low = np.zeros(len(lid), dtype=np.int64), np.full(len(lid), np.iinfo(np.int64).max)
        rp = rp.astype(np.int64)
        order = np.argsort(rp, kind="stable")  # so the first row within reach has the smallest payload
        rv, rp = rv[order], rp[order]
        squares = (rv * rv).sum(1)
        for at in _tiles(len(lid), len(rid)):
            near = _square_distances(lv[at], rv, squares) <= eps * eps + 1e-12
            n[at] = np.count_nonzero(near, axis=1)
            low[at] = np.where(n[at] > 0, rp[near.argmax(1)], np.iinfo(np.int64).max)
        return pd.DataFrame({"id": lid, "n": n, "low": low})

    part = _blocked(a, b, fn, "id long, n long, low long", eps, 1, pivots)
    g = part.groupBy("id").agg(F.sum("n").alias("n"), F.min("low").alias("low"))
    return g.withColumn("low", F.when(F.col("n") > 0, F.col("low")))


def weighted_vote(nn: DataFrame, labels: DataFrame, cols: Sequence[str], cosine: bool = False) -> DataFrame:
    """Vote of the neighbours for each label column with its share of the weight.

    Weights are 1/(distance + 1e-6), or the similarity cut at 0. First name on ties.
    """
    w = F.greatest(F.lit(1.0) - F.col("distance"), F.lit(0.0)) if cosine else F.lit(1.0) / (F.col("distance") + 1e-6)
    j = nn.withColumn("_w", w).join(labels.withColumnRenamed("id", "nid"), "nid")
    out = None
    for c in cols:
        s = j.groupBy("id", c).agg(F.sum("_w").alias("_s"))
        r = s.groupBy("id").agg(F.min_by(c, F.struct(-F.round("_s", 9), F.col(c))).alias(f"pred_{c}"), F.try_divide(F.max("_s"), F.sum("_s")).alias(f"{c}_confidence"))
        out = r if out is None else out.join(r, "id")
    return out


def neighbour_evidence(nn: DataFrame, labels: DataFrame, y: str) -> DataFrame:
    """Positives among the neighbours of each row."""
    j = nn.join(labels.select(F.col("id").alias("nid"), y), "nid")
    return j.groupBy("id").agg(F.sum(y).alias("n_positive"), F.count(F.lit(1)).alias("n_neighbours"))


# --- resampling by neighbours -----------------------------------------------------------------------


def smote(df: DataFrame, y: str, minority, n_new: int, k: int = 5) -> DataFrame:
    """``n_new`` synthetic rows of the minority class between a row and one of its neighbours."""
    from alertsieve.operators.ordering import ordered

    small = materialise(df.where(F.col(y) == minority).select("id", "v"))
    n = small.count()
    if n < 2:
        raise ValueError("too few minority rows")
    nn = knn_join(small, small, min(k, n - 1), skip_same=True)
    base = ordered(small, [], ["id"]).with_position("_p").result()
    times = F.lit(n_new // n) + (F.col("_p") < n_new % n).cast("int")
    base = base.withColumn("_t", times).where("_t > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_t"))))
    key = F.concat_ws("_", F.col("id").cast("string"), F.col("copy").cast("string"))
    base = base.withColumns({"rank": (F.floor(keyed_uniform(key, "nn") * min(k, n - 1)) + 1).cast("int"), "_u": keyed_uniform(key, "gap")})
    other = small.select(F.col("id").alias("nid"), F.col("v").alias("_o"))
    j = base.join(nn.select("id", "rank", "nid"), ["id", "rank"]).join(other, "nid")
    return j.select(F.col("id").alias("source_id"), "copy", F.zip_with("v", "_o", lambda a, b: a + F.col("_u") * (b - a)).alias("v"), F.lit(minority).alias(y))


def adasyn_weights(df: DataFrame, y: str, minority, k: int = 5) -> DataFrame:
    """Share of synthetic rows due to each minority row: the share of other classes around it."""
    from alertsieve.operators.ordering import with_scalars

    nn = knn_join(df.where(F.col(y) == minority), df, k, skip_same=True)
    j = nn.join(df.select(F.col("id").alias("nid"), F.col(y).alias("_y")), "nid")
    r = j.groupBy("id").agg(F.avg((F.col("_y") != minority).cast("int")).alias("_r"))
    r = with_scalars(r, r.agg(F.sum("_r").alias("_t")))
    return r.select("id", F.coalesce(F.try_divide("_r", "_t"), F.lit(0.0)).alias("weight"))


def enn_keep(df: DataFrame, y: str, k: int = 3) -> DataFrame:
    """Rows whose class is the majority among their k neighbours."""
    nn = knn_join(df, df, k, skip_same=True)
    j = nn.join(df.select(F.col("id").alias("nid"), F.col(y).alias("_y")), "nid")
    c = j.groupBy("id", "_y").agg(F.count(F.lit(1)).alias("_n"))
    top = c.groupBy("id").agg(F.min_by("_y", F.struct(-F.col("_n"), F.col("_y"))).alias("_y"))
    return df.join(top, "id").where(F.col(y) == F.col("_y")).drop("_y")


def tomek_links(df: DataFrame, y: str) -> DataFrame:
    """Pairs of rows of different classes that are each other's nearest neighbour."""
    nn = knn_join(df, df, 1, skip_same=True).select("id", "nid")
    back = nn.select(F.col("id").alias("nid"), F.col("nid").alias("id"))
    m = nn.join(back, ["id", "nid"]).where("id < nid")
    a = df.select("id", F.col(y).alias("_a"))
    b = df.select(F.col("id").alias("nid"), F.col(y).alias("_b"))
    return m.join(a, "id").join(b, "nid").where("_a <> _b").select("id", "nid")


# --- density clusters ---------------------------------------------------------------------------------


def _linked(lid: np.ndarray, lv: np.ndarray, rid: np.ndarray, rv: np.ndarray, eps: float) -> pd.DataFrame:
    """Each row of two blocks that has a row of the other one within eps, with the smallest id reachable by such links here."""
    ids = np.concatenate([lid, rid])
    root, squares = np.arange(len(ids)), (rv * rv).sum(1)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for at in _tiles(len(lid), len(rid)):
        r, c = np.divmod(np.flatnonzero(_square_distances(lv[at], rv, squares) <= eps * eps + 1e-12), len(rid))
        x, y = root[r + at.start], root[c + len(lid)]
        pairs = np.unique(x[x != y] * len(ids) + y[x != y])
        for p in pairs.tolist():
            i, j = find(p // len(ids)), find(p % len(ids))
            if i != j:
                root[max(i, j)] = min(i, j)
        while len(pairs) and (root[root] != root).any():
            root = root[root]
    low = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low, root, ids)
    low = low[root]
    return pd.DataFrame({"a": ids[low < ids], "b": low[low < ids]}).drop_duplicates()


def _components(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, label``: the smallest id reachable by the edges (a, b). Labels also jump to the label of their label; every round is written."""
    both = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    lab = materialise(ids.select("id", F.col("id").alias("label")))
    while True:  # labels only fall, so it ends
        near = both.join(lab.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("_near"))
        step = lab.join(near, "id", "left").select("id", F.least("label", "_near").alias("_new"), F.col("label").alias("_old"))
        jump = lab.select(F.col("id").alias("_new"), F.col("label").alias("_far"))
        nxt = materialise(step.join(jump, "_new", "left").select("id", F.least("_new", "_far").alias("label"), "_old"))
        release(lab)
        lab = nxt
        if not lab.where("label <> _old").limit(1).count():
            return lab.select("id", "label")


def dbscan(df: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """``id, cluster, is_core``; noise is -1, a cluster is named by its smallest core id.

    Each two blocks of core rows are compared once and give a star of links for each component that they form; the
    components of these few links are the clusters.
    """
    pts = materialise(df.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")))
    core = materialise(within(pts, pts, eps).where(F.col("n") >= min_samples).select("id").join(pts, "id"))
    packed, n = _packed(core.select("id", "v", F.lit(0).alias("payload"))), core.count()
    links = _grid(packed, packed, lambda lid, lv, rid, rv, _: _linked(lid, lv, rid, rv, eps), "a long, b long", n, n, half=True)
    lab = materialise(_components(core.select("id").distinct(), links).join(core, "id"))
    border = within(pts.join(lab.select("id"), "id", "left_anti"), lab, eps, "label").select("id", F.col("low").alias("cluster"))
    out = lab.select("id", F.col("label").alias("cluster"), F.lit(True).alias("is_core")).unionByName(border.withColumn("is_core", F.lit(False)))
    return out.withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
