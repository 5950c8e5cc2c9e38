"""Shards by fixed virtual slots.

Each row is hashed into one of ``SLOTS`` slots, whose number never changes. Bytes are added up per slot, and a stored map
says in which shard a slot lies. The map has versions: version 1 deals the slots evenly, and rebalancing or growing
edits it, so that only the slots that must move do. Everything but the sums per slot works on the map, which has a row
for each slot, whatever the input. A slot that is heavy in itself (rows that repeat id and text) has several places in
the map and its rows are dealt over them. No Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertsieve.session import materialise

SLOTS = 4096
ROW_BYTES = 8  # of each row beside its text
PLACES = 16  # a slot above this part of a shard's fair share gets more places


def _size(text_col: str) -> Column:
    return (F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(ROW_BYTES)).cast("bigint")


def _crc(text_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def _slot(id_col: str, text_col: str, slots: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), _crc(text_col), _size(text_col)), F.lit(slots)).cast("int")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Written: _id, size (bytes of the text and ``ROW_BYTES``), text_crc32, _slot, and a number that deals equal rows.

    A null text counts as empty. The slot is a hash of id and text, so rows that repeat an id or have none spread by
    their texts. Other columns are not read.
    """
    size, crc = _size(text_col), _crc(text_col)
    return materialise(docs.select(F.col(id_col).alias("_id"), size.alias("size"), crc.alias("text_crc32"), _slot(id_col, text_col, slots).alias("_slot"), F.monotonically_increasing_id().alias("_deal")))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: version, slot, places (a shard for each part of the slot); slots in order, as many in each shard."""
    return spark.range(slots).select(
        F.lit(1).alias("version"), F.col("id").cast("int").alias("slot"), F.array(F.floor(F.col("id") * shards / slots).cast("int")).alias("places")
    )


def _part(slot_places: Column) -> Column:
    return F.pmod(F.col("_deal"), F.size(slot_places)).cast("int")


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` with the part of their slot (_part) and their shard by the map (_shard)."""
    places = F.broadcast(slot_map.select(F.col("slot").alias("_slot"), F.col("places").alias("_places")))  # one row for each slot
    part = _part(F.col("_places"))
    return rows.join(places, "_slot").select(*rows.columns, part.alias("_part"), F.element_at("_places", part + 1).alias("_shard"))


def sizes(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Written: slot, part, shard, bytes, rows of each part that has rows."""
    placed = place(rows, slot_map).groupBy(F.col("_slot").alias("slot"), F.col("_part").alias("part"), F.col("_shard").alias("shard"))
    return materialise(placed.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))


def widen(slot_map: DataFrame, of_slots: DataFrame, shards: int) -> DataFrame:
    """The map with more places, all in the same shard, for slots above a ``PLACES``-th of a fair share."""
    per_slot = of_slots.groupBy("slot").agg(F.sum("bytes").alias("bytes"))
    fair = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards * PLACES)  # a row for each slot
    want = per_slot.select("slot", F.ceil(F.col("bytes") / fair).cast("int").alias("n"))
    wide = F.flatten(F.array_repeat(F.col("places"), F.greatest(F.lit(1), F.ceil(F.col("n") / F.size("places")).cast("int"))))
    return slot_map.join(want, "slot", "left").select("version", "slot", F.when(F.col("n") > F.size("places"), wide).otherwise(F.col("places")).alias("places"))


def _moves(of_slots: DataFrame, shards: int, into: int | None) -> DataFrame:
    """slot, part, to: the parts that leave shards above the mean, and the shards that they go to.

    Each shard keeps its largest parts as long as they fit below the mean and gives up the others. They go, largest
    first, to the shard with fewest bytes, or all into shard ``into``.
    """
    mean = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards)  # a row for each part of a slot
    ahead = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot", "part").rowsBetween(Window.unboundedPreceding, 0)
    marked = of_slots.select("slot", "part", "shard", "bytes", (F.sum("bytes").over(ahead) <= mean).alias("_stays"))
    if into is not None:
        return marked.where(~F.col("_stays")).select("slot", "part", F.lit(into).alias("to"))
    stay, leave = F.when(F.col("_stays"), F.col("bytes")).otherwise(F.lit(0)), F.when(~F.col("_stays"), F.struct((-F.col("bytes")).alias("less"), "slot", "part"))
    each = marked.groupBy("shard").agg(F.sum(stay).alias("load"), F.collect_list(leave).alias("leave"))  # a row for each shard
    both = each.agg(F.map_from_entries(F.collect_list(F.struct("shard", "load"))).alias("_of"), F.sort_array(F.flatten(F.collect_list("leave"))).alias("_all"))
    start = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.element_at("_of", i), F.lit(0)).cast("bigint"))

    def take(state: Column, x: Column) -> Column:
        to = F.array_position(state["load"], F.array_min(state["load"])).cast("int") - 1
        load = F.transform(state["load"], lambda b, i: F.when(i == to, b - x["less"]).otherwise(b))
        return F.struct(load.alias("load"), F.concat(state["to"], F.array(to)).alias("to"))

    dealt = F.aggregate("_all", F.struct(start.alias("load"), F.array().cast("array<int>").alias("to")), take, lambda s: s["to"])
    pairs = both.select(F.explode(F.arrays_zip(F.col("_all").alias("x"), dealt.alias("to"))).alias("m"))
    return pairs.select(F.col("m.x.slot").alias("slot"), F.col("m.x.part").alias("part"), F.col("m.to").alias("to"))


def edit(slot_map: DataFrame, of_slots: DataFrame, shards: int, into: int | None = None) -> DataFrame:
    """Written: the next version of the map, with near equal bytes in ``shards`` shards.

    Slots without rows stay. With ``into``, the number of a new shard, slots move into it alone.
    """
    moves = _moves(of_slots, shards, into).groupBy("slot").agg(F.map_from_entries(F.collect_list(F.struct("part", "to"))).alias("_to"))
    moved = F.transform("places", lambda s, i: F.coalesce(F.element_at("_to", i), s))
    after = slot_map.join(moves, "slot", "left")
    return materialise(after.select((F.col("version") + 1).alias("version"), "slot", F.when(F.col("_to").isNull(), F.col("places")).otherwise(moved).alias("places")))


def balanced_map(rows: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Versions 1 and 2 of the map for the written ``rows``; version 2 has near equal bytes."""
    first = first_map(rows.sparkSession, shards, slots)
    first = materialise(widen(first, sizes(rows, first), shards))
    return first.unionByName(edit(first, sizes(rows, first), shards))


def version(versions: DataFrame, number: int) -> DataFrame:
    return versions.where(F.col("version") == number)


def number(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` with shard and slot: places in the shard, gapless from 0, by virtual slot, then id.

    Rows are ranked inside a part of a virtual slot; what comes before a part is a sum over the map.
    """
    before = Window.partitionBy("shard").orderBy("slot", "part").rowsBetween(Window.unboundedPreceding, -1)  # rows of the map
    starts = sizes(rows, slot_map).select(F.col("slot").alias("_slot"), F.col("part").alias("_part"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_start"))
    placed = place(rows, slot_map).join(F.broadcast(starts), ["_slot", "_part"])  # no more rows than places in the map
    inside = F.row_number().over(Window.partitionBy("_slot", "_part").orderBy("_id", "text_crc32", "size"))
    return placed.select(*[c for c in rows.columns if not c.startswith("_")], "_id", F.col("_shard").alias("shard"), (F.col("_start") + inside - 1).cast("bigint").alias("slot"))


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> None:
    """Write whole rows of ``docs`` as parquet, a folder for each shard (column ``_shard``).

    Row by row the shard is that of the map; a slot with several places deals its rows anew.
    """
    rows = docs.withColumns({"_slot": _slot(id_col, text_col, slots), "_deal": F.monotonically_increasing_id()})
    place(rows, slot_map).select(*docs.columns, "_shard").hint("rebalance", "_shard").write.partitionBy("_shard").parquet(path)


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Per row of ``docs``: id, size, text_crc32, shard, slot (place in the shard, gapless from 0).

    Shards have near equal bytes. Null texts are empty, null ids are an id of their own, repeated rows are rows of their
    own, an empty table gives an empty result; other columns are not read.
    """
    rows = digests(docs, id_col, text_col, slots)
    placed = number(rows, version(balanced_map(rows, shards, slots), 2))
    return placed.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot")
