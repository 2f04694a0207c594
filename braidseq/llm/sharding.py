"""Contiguous shards of near equal bytes from global prefix sums.

Rows are ranged over partitions by a content key and then the id; each
partition's bytes and rows are summed, the sums' prefix gives every partition
its offset, and a running sum inside the partition gives every row its place
in the whole.  Cuts lie at equal targets.  No task sees more than its own range
and the table of partition totals, and only narrow rows (no texts) move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pin, utf8_length

#: Rows in a range about; ranges at most, so that the table of their totals, which is broadcast, has a few MB whatever the corpus.
ROWS_PER_RANGE, MOST_RANGES = 250_000, 100_000


def shard_by_bytes(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None
) -> DataFrame:
    """One row per row of ``docs``: ``<id>, size, text_crc32, content, shard, slot``; nothing else of ``docs`` is kept.

    ``size`` is the text's UTF-8 bytes plus 1 (null: 1); ``content`` is the
    text's SHA-256 (null: that of no text), by which rows are ordered, then by
    id (null first) and size.  So equal texts lie together, also null and empty
    ones, and a group of any size may spread over ranges and shards.  Cuts lie
    at equal targets of bytes, each at the nearer edge of the row it falls into
    (at its end where both are as near).  ``slot`` counts from 0 in each shard
    without gaps.  Rows that are equal in all of this are interchangeable.
    ``ranges``: partitions to sort in; by default one for each
    ``ROWS_PER_RANGE`` rows, the session's shuffle partitions at least and
    ``MOST_RANGES`` at most.  Columns of ``docs`` besides the two named ones
    are left out, so none can clash.  Empty tables give empty results.
    """
    if shards < 1:
        raise ValueError("one shard at least")
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("id"), (utf8_length(F.col(text_col)) + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.sha2(text, 256).alias("content"))
    narrow = pin(narrow)
    if ranges is None:
        ranges = min(MOST_RANGES, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), narrow.count() // ROWS_PER_RANGE + 1))
    order = ("content", F.col("id").asc_nulls_first(), "size")
    # Written before its partitions are numbered: another attempt can't deal rows otherwise.
    ranged = pin(narrow.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))

    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
    )  # one row a range, MOST_RANGES at most
    inside = Window.partitionBy("range").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = pin(
        ranged.join(F.broadcast(offsets), "range")
        .withColumn("end", F.col("bytes_before") + F.sum("size").over(upto))
        .withColumn("place", F.col("rows_before") + F.row_number().over(inside) - 1)
        .select("id", "size", "text_crc32", "content", (F.col("end") - F.col("size")).alias("start"), "end", "place")
    )

    cuts = _cuts(placed, shards)
    first = F.lit(0)
    shard = F.lit(0)
    for place in cuts:  # shards - 1 of them
        first = F.when(F.col("place") >= place, F.lit(place)).otherwise(first)
        shard = shard + (F.col("place") >= place).cast("int")
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "content", shard.cast("int").alias("shard"), (F.col("place") - first).cast("long").alias("slot"))


def _cuts(placed: DataFrame, shards: int) -> list[int]:
    """Rows before each of the shards from the second on."""
    total = placed.agg(F.max("end").alias("end")).first()["end"]
    if total is None:
        return []
    # As whole numbers: a cut lies in the row with shards * start < k * total <= shards * end.
    wanted = [k * total for k in range(1, shards)]
    inside = F.lit(False)
    for at in wanted:
        inside = inside | ((shards * F.col("start") < at) & (shards * F.col("end") >= at))
    split = placed.where(inside).select("start", "end", "place").collect()  # one row a cut at most
    cuts = []
    for at in wanted:
        row = next(r for r in split if shards * r["start"] < at <= shards * r["end"])
        nearer_start = at - shards * row["start"] < shards * row["end"] - at
        cuts.append(row["place"] + (not nearer_start))
    return cuts
