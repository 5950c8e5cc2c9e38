"""Order-dependent work without one task per key.

``ordered`` gives windows and running values in the order of a key. Keys of up to
``max_group_rows`` rows use plain windows. If any key is larger (or there is no key at
all), the rows are range-partitioned by key and order, numbered, and cut into blocks of
equal size: bounded frames read a halo copied from the neighbouring blocks, running
values add a carry taken from one small row per block. Both ways give the same result.

``quantiles`` and ``rank_cut`` find exact order statistics without sorting the rows: an
approximate digest brackets the wanted rank, one pass counts below the bracket, and only
the distinct values inside it are ordered.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from alertsieve.operators.lookup import lookup_join
from alertsieve.session import materialise, materialise_portions, max_group_rows, portion_count

_PID_BITS = 33  # monotonically_increasing_id: partition number above, row number below
_MAX_BLOCKS = 50_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(rows, rows of the largest key); one partial count per key is shuffled."""
    if not keys:
        n = df.count()
        return n, n
    r = df.groupBy(*keys).count().agg(F.sum("count").alias("n"), F.max("count").alias("m")).first()
    return int(r["n"] or 0), int(r["m"] or 0)


class Ordered:
    """Rows arranged by ``keys`` and ``order``; see ``ordered``."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[Column], split: bool, halo: bool = False, written: DataFrame | None = None):
        self.df = df
        self.written = written  # what the rows are read from, to be released by who is done with them
        self.keys = keys
        self.order = order
        self.split = split
        self._halo = halo
        self._ran = False

    @property
    def _window(self) -> WindowSpec:
        if self.split:
            return Window.partitionBy("_blk", *self.keys).orderBy("_g")
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def rows(self, lo: int, hi: int) -> WindowSpec:
        """A bounded row frame; ``lo``/``hi`` must lie inside the halo asked for."""
        return self._window.rowsBetween(lo, hi)

    def lag(self, col: Column | str, n: int = 1) -> Column:
        return F.lag(col, n).over(self._window)

    def lead(self, col: Column | str, n: int = 1) -> Column:
        return F.lead(col, n).over(self._window)

    def with_columns(self, cols: dict[str, Column]) -> Ordered:
        self.df = self.df.withColumns(cols)
        return self

    def with_running(self, specs: dict[str, tuple[str, Column]]) -> Ordered:
        """Add inclusive running values; ``specs`` maps a name to (op, column).

        op is one of sum, min, max, count and last (last non-null value).
        """
        upto = self._window.rowsBetween(Window.unboundedPreceding, 0)
        local = {
            "sum": lambda c: F.sum(c),
            "min": lambda c: F.min(c),
            "max": lambda c: F.max(c),
            "count": lambda c: F.count(c),
            "last": lambda c: F.last(c, ignorenulls=True),
        }
        if not self.split:
            self.df = self.df.withColumns({n: local[op](c).over(upto) for n, (op, c) in specs.items()})
            return self
        if self._halo:
            raise ValueError("running values need blocks without a halo")
        if self._ran:
            self.df = materialise(self.df)
        self._ran = True
        total = dict(local, last=lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("_g"))))
        per_block = self.df.groupBy("_blk", *self.keys).agg(
            *[total[op](c).alias(f"_c_{n}") for n, (op, c) in specs.items()]
        )
        before = Window.partitionBy(*self.keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
        over = dict(local, count=lambda c: F.sum(c))
        carry = per_block.select(
            "_blk",
            *self.keys,
            F.count(F.lit(1)).over(before).alias("_prev"),
            *[over[op](F.col(f"_c_{n}")).over(before).alias(f"_c_{n}") for n, (op, c) in specs.items()],
        )
        # at most one key runs on from one block into the next, so this has at most a row per block
        carry = carry.where("_prev > 0").drop("_prev")
        combine = {
            "sum": lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
            "count": lambda a, b: F.coalesce(a, F.lit(0)) + b,
            "min": lambda a, b: F.least(a, b),
            "max": lambda a, b: F.greatest(a, b),
            "last": lambda a, b: F.coalesce(b, a),
        }
        df = self.df.withColumns({f"_l_{n}": local[op](c).over(upto) for n, (op, c) in specs.items()})
        df = lookup_join(df, carry, ["_blk", *self.keys], null_safe=True)
        df = df.withColumns({n: combine[op](F.col(f"_c_{n}"), F.col(f"_l_{n}")) for n, (op, c) in specs.items()})
        self.df = df.drop(*[p + n for n in specs for p in ("_c_", "_l_")])
        return self

    def with_position(self, name: str = "pos") -> Ordered:
        """Add the 0-based position inside the key. Without keys and a halo, cut rows are numbered already."""
        if self.split and not self.keys and not self._halo:
            return self.with_columns({name: F.col("_g")})
        self.with_running({name: ("count", F.lit(1))})
        return self.with_columns({name: F.col(name) - 1})

    def result(self) -> DataFrame:
        """The rows without halo copies and helper columns."""
        df = self.df
        if self._halo:
            df = df.where("_core")
        return df.drop("_blk", "_g", "_core")


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    before: int = 0,
    after: int = 0,
    max_rows: int | None = None,
    like: Ordered | None = None,
    portions: bool = False,
) -> Ordered:
    """Arrange ``df`` by ``keys`` and ``order`` (which must be total inside a key).

    ``before``/``after`` are the row frames that will be read; leave both 0 for running
    values. ``like`` is an arrangement of the same rows by the same keys: if its keys were small
    enough, they are not counted again. With ``portions`` the rows are cut by the first column, which must be ascending, and
    shuffled part by part: it takes a fraction of the disk and reads ``df`` as often, so ``df`` should be cheap to read.
    """
    keys = list(keys)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    if like is not None and not like.split and like.keys == keys:
        return Ordered(df, keys, order_cols, split=False)
    limit = max_rows or max_group_rows(df.sparkSession)
    n, largest = largest_group(df, keys)
    if largest <= limit:
        return Ordered(df, keys, order_cols, split=False)

    at_once = 2 * df.sparkSession.sparkContext.defaultParallelism  # fewer blocks would leave cores idle, here and in all that reads them
    size = max(min(limit, math.ceil(n / at_once)), math.ceil(n / _MAX_BLOCKS), before, after)
    parts = max(1, math.ceil(n / size))
    by = [F.col(k) for k in keys] + order_cols
    cut = _portions(df, [*keys, *order][0], portion_count(df.sparkSession, n)) if portions else [df]
    each = math.ceil(parts / len(cut))

    def ranged(i: int) -> DataFrame:
        return (
            cut[i].repartitionByRange(each, *by)
            .sortWithinPartitions(*by)
            .withColumn("_m", F.monotonically_increasing_id() + F.lit(i * each << _PID_BITS))
        )

    written = materialise_portions(ranged(i) for i in range(len(cut))) if portions else materialise(ranged(0))
    saved = written.withColumns(
        {
            "_pid": F.shiftright("_m", _PID_BITS),
            "_low": F.col("_m").bitwiseAND(F.lit((1 << _PID_BITS) - 1)),
        }
    )
    sizes = saved.groupBy("_pid").count().collect()  # one row per range partition
    offsets, seen = [], 0
    for r in sorted(sizes, key=lambda r: r["_pid"]):
        offsets.append((r["_pid"], seen))
        seen += r["count"]
    starts = df.sparkSession.createDataFrame(offsets, "_pid long, _start long")
    out = saved.join(F.broadcast(starts), "_pid").withColumn("_g", F.col("_start") + F.col("_low"))
    out = out.drop("_m", "_pid", "_low", "_start")
    home = F.floor(F.col("_g") / size)
    if not before and not after:
        return Ordered(out.withColumn("_blk", home), keys, order_cols, split=True, written=written)
    inside = F.col("_g") % size
    targets = F.array_compact(
        F.array(
            home,
            F.when((inside < after) & (home > 0), home - 1),
            F.when(inside >= size - before, home + 1),
        )
    )
    out = out.withColumn("_blk", F.explode(targets)).withColumn("_core", F.col("_blk") == home)
    return Ordered(out, keys, order_cols, split=True, halo=True, written=written)


def _portions(df: DataFrame, c: str, n: int) -> list[DataFrame]:
    """``df`` in at most ``n`` parts, the rows of each before those of the next in ascending order of ``c``, nulls first."""
    found = df.agg(F.percentile_approx(c, [i / n for i in range(1, n)])).first()[0] if n > 1 else None
    bounds = sorted(set(found or []))
    x, lit = F.col(c), lambda b: F.lit(b).cast(df.schema[c].dataType)
    tests = [x.isNull() | (x < lit(b)) if i == 0 else (x >= lit(bounds[i - 1])) & (x < lit(b)) for i, b in enumerate(bounds)]
    return [df.where(t) for t in tests] + [df.where(x >= lit(bounds[-1])) if bounds else df]


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row result as constants."""
    row = one_row.first()
    types = {f.name: f.dataType for f in one_row.schema.fields}
    return df.withColumns({c: F.lit(row[c]).cast(t) for c, t in types.items()})


@dataclass(frozen=True)
class Quantile:
    """A wanted order statistic.

    ``level`` is in [0,1]; ``exact_level`` may refine it from the group size ``n``.
    ``method`` is higher, lower or linear on the index ``level * (n - 1)``.
    """

    level: float
    method: str = "linear"
    exact_level: Callable[[Column], Column] | None = None

    def index(self, n: Column) -> Column:
        level = self.exact_level(n) if self.exact_level else F.lit(float(self.level))
        return level * (n - 1)


_ACCURACY = 100_000


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str,
    wanted: dict[str, Quantile],
    max_rows: int | None = None,
) -> DataFrame:
    """Exact quantiles of ``value`` per key: ``keys, n, <names>``."""
    keys = list(keys)
    value = F.col(value) if isinstance(value, str) else value
    base = df.select(*keys, value.alias("_v")).where("_v is not null")
    limit = max_rows or max_group_rows(df.sparkSession)
    # counted with null values: the size needs the keys only, so the value is not computed here
    _, largest = largest_group(df, keys)
    n = F.col("n")

    def pick(at: Callable[[Column], Column]) -> list[Column]:
        out = []
        for name, q in wanted.items():
            h = q.index(n)
            lo, hi = at(F.floor(h)), at(F.ceil(h))
            if q.method == "linear":
                out.append((lo + (hi - lo) * (F.max(h) - F.floor(F.max(h)))).alias(name))
            else:
                out.append((hi if q.method == "higher" else lo).alias(name))
        return out

    if largest <= limit:
        w = Window.partitionBy(*keys)
        ranked = base.select(
            *keys, "_v", F.count(F.lit(1)).over(w).alias("n"), (F.row_number().over(w.orderBy("_v")) - 1).alias("_r")
        )
        return ranked.groupBy(*keys).agg(
            F.max("n").alias("n"), *pick(lambda i: F.max(F.when(F.col("_r") == i, F.col("_v"))))
        )

    names = list(wanted)
    # the digest's own error, plus the few ranks by which an exact level or an interpolation
    # may move the index in a group of more than ``limit`` rows
    eps = 2.0 / _ACCURACY + 5.0 / limit
    points = [p for q in wanted.values() for p in (max(q.level - eps, 0.0), min(q.level + eps, 1.0))]
    stats = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
        F.percentile_approx("_v", points, _ACCURACY).alias("_a"),
    )
    # groups small enough to be ordered whole need no digest
    bounds = stats.select(
        *keys,
        "n",
        *[
            F.when(n <= limit, F.col(end)).otherwise(F.col("_a")[2 * j + k]).alias(f"_{end[1:]}{j}")
            for j in range(len(names))
            for k, end in enumerate(("_lo", "_hi"))
        ],
    )
    if keys:
        bounds = materialise(bounds)
        tagged = lookup_join(base, bounds, keys, "inner", null_safe=True)
    else:
        tagged = with_scalars(base, bounds)
    below = tagged.groupBy(*keys).agg(
        *[F.count_if(F.col("_v") < F.col(f"_lo{j}")).alias(f"_b{j}") for j in range(len(names))]
    )
    inside = (
        tagged.select(
            *keys,
            "_v",
            F.explode(
                F.array_compact(
                    F.array(*[F.when(F.col("_v").between(F.col(f"_lo{j}"), F.col(f"_hi{j}")), F.lit(j)) for j in range(len(names))])
                )
            ).alias("_j"),
        )
        .groupBy(*keys, "_j", "_v")
        .count()
    )
    inside = materialise(inside)
    run = ordered(inside, [*keys, "_j"], ["_v"], max_rows=limit).with_running({"_cum": ("sum", F.col("count"))}).result()
    if keys:
        out = lookup_join(run, lookup_join(below, bounds, keys, "inner", null_safe=True), keys, "inner", null_safe=True)
    else:
        out = with_scalars(with_scalars(run, below), bounds)
    cols = []
    kind = base.schema["_v"].dataType
    for j, (name, q) in enumerate(wanted.items()):
        first = F.col(f"_b{j}") + F.col("_cum") - F.col("count")
        last = F.col(f"_b{j}") + F.col("_cum")
        h = q.index(n)

        def at(i: Column, j=j, first=first, last=last) -> Column:
            found = F.max(F.when((F.col("_j") == j) & (i >= first) & (i < last), F.col("_v")))
            # a rank outside the digest's bracket must not become a null
            return F.coalesce(found, F.raise_error(F.lit("a rank lies outside its bracket")).cast(kind))

        lo, hi = at(F.floor(h)), at(F.ceil(h))
        if q.method == "linear":
            cols.append((lo + (hi - lo) * (F.max(h) - F.floor(F.max(h)))).alias(name))
        else:
            cols.append((hi if q.method == "higher" else lo).alias(name))
    return out.groupBy(*keys).agg(F.max("n").alias("n"), *cols)


def column_quantiles(df: DataFrame, cols: Sequence[str], wanted: dict[str, Quantile], max_rows: int | None = None) -> DataFrame:
    """Exact quantiles of several columns: ``column, n, <names>``, a row for each column with a value; nulls and NaN are no values.

    The columns become keys of one long table, so all brackets are refined and counted in the same jobs.
    """
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("_x")) for c in cols])))
    return quantiles(long, ["column"], "_x", wanted, max_rows)


def rank_cut(df: DataFrame, order: Sequence[str], ranks: Sequence[int], max_rows: int | None = None) -> list[tuple]:
    """The tuples of ``order`` at the given 0-based ranks, column by column.

    Each column is one exact selection, with nulls as the smallest value; ties are resolved by the next column.
    A rank beyond the last row has no tuple.
    """
    out = []
    total = df.count()
    if total <= (max_rows or max_group_rows(df.sparkSession)):
        # few enough rows for one sort
        r = df.select(*order).withColumn("_r", F.row_number().over(Window.orderBy(*order)) - 1).where(F.col("_r").isin(list(ranks)))
        found = {x["_r"]: tuple(x[c] for c in order) for x in r.collect()}
        return [found.get(k) for k in ranks]
    for k in ranks:
        if k >= total:
            out.append(None)
            continue
        rest, left, cut = df, k, []
        for c in order:
            n = rest.count() if cut else total
            nulls = rest.where(F.col(c).isNull()).count()
            if left < nulls:
                cut.append(None)
                rest = rest.where(F.col(c).isNull())
                continue
            left, n, rest = left - nulls, n - nulls, rest.where(F.col(c).isNotNull())
            level = left / (n - 1) if n > 1 else 0.0
            # the index is rebuilt from the rank itself, so guard against rounding below it
            q = _RankAt(level, "lower", None, left)
            v = quantiles(rest, [], c, {"v": q}, max_rows).first()["v"]
            if v is None:
                raise RuntimeError(f"no value of {c} at rank {left} of {n}")
            cut.append(v)
            left -= rest.where(F.col(c) < F.lit(v)).count()
            rest = rest.where(F.col(c) == F.lit(v))
        out.append(tuple(cut))
    return out


@dataclass(frozen=True)
class _RankAt(Quantile):
    rank: int = 0

    def index(self, n: Column) -> Column:
        return F.lit(float(self.rank)) + n * 0


def before_cut(order: Sequence[str], cut: tuple | None) -> Column:
    """True for rows that sort before ``cut`` (every row if there is no cut)."""
    if cut is None:
        return F.lit(True)
    return F.struct(*[F.col(c) for c in order]) < F.struct(*[(F.when(F.lit(False), F.col(c)) if v is None else F.lit(v)).alias(c) for c, v in zip(order, cut)])
