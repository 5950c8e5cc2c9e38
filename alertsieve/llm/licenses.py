"""License texts in documents: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Words are runs of letters and digits in lower case. A template (or each part of ``LARGEST`` shingles of a long one)
belongs to the smallest size class that holds its shingles. For each class in use, a text is cut into windows of twice
the class size that overlap by half, so a whole copy of a template of the class lies in one window. Each window and
template has ``BANDS`` MinHash values, one row a band: the least and the largest hash under ``BANDS`` / 2 scramblings.
A text that holds none of the shingles from which the templates' values come can't meet any and isn't cut to windows.
A window around a verbatim copy has a Jaccard similarity of 3/8 or more with it (a class is at most 4/3 of its
templates' size from 3 shingles on), so at least one of 16 bands meets with probability 1 - (5/8)^16 = 0.9995; at 80 %
of the shingles it is 1 - 0.71^16 = 0.996. Retrieved templates are then compared with the text, shingle by shingle.
No Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertsieve.functions.probs import let
from alertsieve.session import materialise

SHINGLE = 3  # words; license notices may have no more
CONTAINMENT = 0.8
BANDS = 16
SIZES = [1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64]
LARGEST = SIZES[-1]
MOST_VALUES = 400_000  # band values of the templates that are sent along with the scan; more are joined
TEMPLATE_SCHEMA = "license string, text string"


def scan_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"), "")


def _windows(w: Column, of) -> Column:
    """``of(words)`` for each window of SHINGLE words; for the whole if there are fewer; an empty array without words."""
    n = F.size(w)
    whole = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: of(*[F.get(w, i + j) for j in range(SHINGLE)]))
    return F.when(n >= SHINGLE, whole).when(n > 0, F.array(of(F.array_join(w, " ")))).otherwise(F.slice(F.array(of(F.lit(""))), 1, 0))


def shingle_texts(w: Column) -> Column:
    return F.array_distinct(_windows(w, lambda *x: F.concat_ws(" ", *x)))


def _scrambles() -> list[int]:
    """Constants of the scramblings: multiples of an odd number modulo 2^64, as signed."""
    out = [(0x9E3779B97F4A7C15 * (i + 1)) % (1 << 64) for i in range(BANDS // 2)]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in out]


def _min_and_max(hashes: str, body: str) -> str:
    """SQL: ``body`` for the hashes under each scrambling, with ``{x}`` for them and ``{f}`` for least and greatest; all in one array."""
    parts = [f"get(transform(array(transform({hashes}, v -> v ^ {a}L)), x -> {body.format(x='x', f=f)}), 0)" for a in _scrambles() for f in ("least", "greatest")]
    return f"concat({', '.join(parts)})"


def _chain(x: str, sizes: list[int], width: int, wanted: list[int]) -> str:
    """SQL: band values of the windows of ``wanted`` sizes among the doubling ``sizes``, from blocks of ``x`` of ``width`` each.

    A window is two blocks side by side. Blocks of a size come from pairs of blocks of half the size, so all sizes
    together cost two steps for each shingle.
    """
    name = f"b{sizes[0]}"
    values = ", ".join(f"get({x}, j * {width} + {i})" for i in range(width))
    blocks = x if width == 1 else f"transform(sequence(0, cast(ceil(size({x}) / {width}) AS int) - 1), j -> {{f}}({values}))"
    windows = f"transform(sequence(0, greatest(size({name}) - 2, 0)), j -> {{f}}(get({name}, j), get({name}, j + 1)))"
    more = [s for s in wanted if s > sizes[0]]
    body = windows if sizes[0] in wanted else ""
    if more:
        rest = _chain(name, sizes[1:], 2, more)
        body = f"concat({body}, {rest})" if body else rest
    return f"get(transform(array({blocks}), {name} -> {body}), 0)"


def band_values(hashes: str, sizes: list[int]) -> Column:
    """MinHash values of all overlapping windows of a text, of each size class in use; ``hashes`` names a column of shingle hashes."""
    twos, threes = [s for s in SIZES if s & (s - 1) == 0], [s for s in SIZES if s % 3 == 0]
    chains = [_chain("{x}", every, every[0], [s for s in sizes if s in every]) for every in (twos, threes) if any(s in every for s in sizes)]
    body = f"concat({', '.join(chains)})"
    return F.expr(f"CASE WHEN size({hashes}) > 0 THEN {_min_and_max(hashes, body)} ELSE cast(array() AS array<bigint>) END")


def template_bands(templates: DataFrame) -> DataFrame:
    """license, notice, size, value, shingle: band values of each template or part of one, the class of its size, and the shingle that has the value.

    ``notice`` is a hash of the template's text: a license may have several.
    """
    hashed = materialise(templates.select("license", F.xxhash64("text").alias("notice"), let(scan_words(F.col("text")), lambda w: _windows(w, lambda *x: F.xxhash64(*x))).alias("h"))).where("size(h) > 0")
    # the last part reaches back, so that it isn't short
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size("h") / LARGEST).cast("int") - 1), lambda i: F.slice("h", F.greatest(F.lit(1), F.least(i * LARGEST + 1, F.size("h") - LARGEST + 1)), F.lit(LARGEST)))
    cut = materialise(hashed.select("license", "notice", F.explode(parts).alias("h")))  # the plan below names the hashes many times
    size = F.element_at(F.filter(F.array(*[F.lit(s) for s in SIZES]), lambda s: s >= F.size("h")), 1)
    ends = [f"{end}(transform(h, v -> v ^ {a}L))" for a in _scrambles() for end in ("array_min", "array_max")]
    values = F.expr("array(" + ", ".join(f"struct({x} AS value, {x} ^ {a}L AS shingle)" for x, a in zip(ends, [a for a in _scrambles() for _ in range(2)])) + ")")
    return cut.select("license", "notice", size.alias("size"), F.inline(values)).distinct()


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT, most_values: int = MOST_VALUES) -> DataFrame:
    """Rows (id, license, containment): the documents that hold at least ``containment`` of a template's distinct shingles.

    ``templates`` has license, text; templates without words are skipped, repeated ones count once; of several texts of a
    license the one that the document holds most of counts. Whole texts are
    scanned; null and empty texts hold nothing; a repeated row with the same id and text gives one row for each license.
    Other columns are not read. Up to ``most_values`` band values of the templates travel with the scan; with more,
    the values of the documents are joined with them instead, with equal results.
    """
    bands = materialise(template_bands(templates))
    sizes = sorted(r["size"] for r in bands.select("size").distinct().collect())  # twelve at most
    hits = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    if not sizes:
        return hits.select(F.col("_id").alias(id_col), F.lit("").alias("license"), F.lit(0.0).alias("containment")).limit(0)
    known = bands.select("value", "shingle").distinct().limit(most_values + 1).collect()
    hashed = let(scan_words(F.col("_text")), lambda w: _windows(w, lambda *x: F.xxhash64(*x)))
    hits = hits.select("_id", "_text", F.inline(F.array(F.struct(hashed.alias("_h")))))
    values = band_values("_h", sizes)
    if len(known) <= most_values:
        # a window can only have a template's value if it holds the shingle that the value comes from
        literal = lambda name: F.expr("array(" + ", ".join(f"{v}L" if v > -(1 << 63) else f"-{(1 << 63) - 1}L - 1L" for v in sorted({r[name] for r in known})) + ")")
        values = F.when(F.arrays_overlap("_h", literal("shingle")), F.array_intersect(values, literal("value")))
    # explode() would put the whole expression into a filter as well
    hits = hits.select("_id", "_text", F.explode_outer(F.array_distinct(values)).alias("value")).where("value IS NOT NULL")
    pairs = hits.join(bands.select("license", "notice", "value").distinct(), "value").groupBy("_id", F.xxhash64("_text").alias("_key"), "license", "notice").agg(F.first("_text").alias("_text"))
    want = materialise(templates.select("license", F.xxhash64("text").alias("notice"), let(scan_words(F.col("text")), shingle_texts).alias("_want"))).where("size(_want) > 0").groupBy("license", "notice").agg(F.max("_want").alias("_want"))
    both = pairs.join(want, ["license", "notice"])
    share = let(let(scan_words(F.col("_text")), shingle_texts), lambda s: F.size(F.array_intersect(F.col("_want"), s)) / F.size("_want"))
    held = both.select("_id", "_key", "license", share.alias("containment")).where(F.col("containment") >= containment)
    return held.groupBy(F.col("_id").alias(id_col), "_key", "license").agg(F.max("containment").alias("containment")).drop("_key")


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(templates, TEMPLATE_SCHEMA)
