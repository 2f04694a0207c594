"""Which pairs are aligned, in which batches, and whether only those came back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one target that are numbered in one task; a target with more is numbered in several.
NUMBERED_TOGETHER = 100_000


def plan_errors(candidates: DataFrame, sequences: DataFrame) -> DataFrame:
    """``query_id, target_id, error``: pairs out of order or with themselves, repeated pairs, and ids that ``sequences`` (``sequence_id``) lacks."""
    ids = sequences.select(F.col("sequence_id").alias("id"))
    disordered = candidates.where(~F.coalesce(F.col("query_id") < F.col("target_id"), F.lit(False))).select("query_id", "target_id", F.lit("not in order").alias("error"))
    twice = candidates.groupBy("query_id", "target_id").count().where("count > 1").select("query_id", "target_id", F.lit("repeated pair").alias("error"))
    out = disordered.union(twice)
    for side in ("query_id", "target_id"):
        unknown = candidates.join(ids, F.col(side) == F.col("id"), "left_anti").select("query_id", "target_id", F.lit(f"unknown {side}").alias("error"))
        out = out.union(unknown)
    return out


def alignment_batches(pairs: DataFrame, most_queries: int) -> DataFrame:
    """``query_id, target_id, part, batch``: at most ``most_queries`` queries of one target share ``(target_id, part, batch)``.

    Batches fill in order of query.  A target with more than
    ``NUMBERED_TOGETHER`` queries is first dealt into parts by hash, so that no
    task numbers an unbounded group; all others are part 0.  Repeated pairs
    count once.
    """
    distinct = pairs.select("query_id", "target_id").distinct()
    parts = distinct.groupBy("target_id").agg(F.count("*").alias("n")).select(F.col("target_id").alias("of"), F.ceil(F.col("n") / NUMBERED_TOGETHER).alias("parts"))
    dealt = distinct.join(parts, F.col("target_id") == F.col("of")).withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")))
    place = F.row_number().over(Window.partitionBy("target_id", "part").orderBy("query_id")) - 1
    return dealt.select("query_id", "target_id", "part", F.floor(place / most_queries).alias("batch"))


def unplanned_hits(hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """Hits of pairs that were never planned; empty when an aligner kept to its plan."""
    return hits.join(pairs.select("query_id", "target_id"), ["query_id", "target_id"], "left_anti")
