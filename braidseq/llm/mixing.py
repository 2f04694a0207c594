"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Water-filling: sources share a budget by weight; none gets more than
``max_epochs`` times its size, and what a clamped source can't take goes to the
others by weight, until none is above.  With sources sorted by the level at
which each is clamped (cap / weight), the final level follows from prefix sums.

Sampling: a source whose target is ``r`` times its size takes every document
``floor(r)`` times, and a seeded sample of its documents once more: those first
in the order of a seeded hash, up to the fraction left.  Documents fall into
buckets of the hash; the words of all buckets of a source are summed before the
shuffle, and only the one bucket in which the sample ends is put in order.  So
a source with a third of all rows never meets in one task.  What comes out is
one row a source, its last document in that order included, and every document
is decided by itself against it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACED_WORD, pin

#: Rows of one bucket of the sampling order about, whatever the corpus: of a source's buckets one is sorted.
BUCKET_ROWS = 50_000
#: Up to so many sources the plan is broadcast; more are joined over salted keys.
BROADCAST_SOURCES = 20_000
_SALTS = 16
_HASH_DIGITS = 15


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to ``sources`` (``source_size`` long, ``weight`` double; one row a source).

    The budget is ``share`` times all sizes.  Where all sources together can't
    take it, each gets its cap.  Empty sources get 0.  Only this table of
    sources, never their documents, is ordered in one task.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    order = Window.orderBy("clamp_at", "source_rank")
    filled = sources.withColumn("clamp_at", cap / F.col("weight")).withColumns(
        {
            "caps_before": F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "weights_left": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
            "budget": F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)),
        }
    )
    # The level if all sources before this one are clamped and neither it nor later ones are.
    level = (F.col("budget") - F.col("caps_before")) / F.col("weights_left")
    first_free = F.min(F.when(level <= F.col("clamp_at"), F.struct("clamp_at", "source_rank", level.alias("level")))).over(Window.partitionBy())
    return (
        filled.withColumn("free", first_free)
        .withColumn("target", F.when(F.col("free").isNull(), cap).otherwise(F.least(cap, F.col("weight") * F.col("free.level"))))
        .drop("clamp_at", "caps_before", "weights_left", "budget", "free")
    )


def _place(id_col: Column, size: Column, seed: int) -> Column:
    """Where a document stands in the sampling order."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("null")), size.cast("string")), 256)
    return F.conv(F.substring(digest, 1, _HASH_DIGITS), 16, 10).cast("long")


def bucket_digits_for(rows: int) -> int:
    """Hexadecimal digits of a bucket of the sampling order: so many that one of them holds about ``BUCKET_ROWS`` of ``rows``, three at least."""
    digits = 3
    while 16**digits * BUCKET_ROWS < rows and digits < _HASH_DIGITS:
        digits += 1
    return digits


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def mixing_plan(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, max_epochs: float, seed: int, bucket_digits: int | None
) -> tuple[DataFrame, int]:
    """One row a source: ``source, source_size, target, whole``, the bucket ``last`` in which its sample ends, and ``cut``, the last place that is taken once more (null: none); and the digits of a bucket."""
    if bucket_digits is None:
        bucket_digits = bucket_digits_for(docs.count())
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _words(F.col(text_col)).alias("size"))
    bucket = F.shiftright("at", 4 * (_HASH_DIGITS - bucket_digits)).cast("int")
    rows = pin(sized.withColumn("at", _place(F.col("id"), F.col("size"), seed)).withColumn("bucket", bucket))

    by_bucket = pin(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    by_source = by_bucket.groupBy("source").agg(F.sum("words").alias("source_size"))
    ranked = by_source.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("source_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    targets = water_fill(ranked.withColumn("weight", weight), share, max_epochs)
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    wanted = F.least(F.col("source_size"), F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    plan = targets.withColumn("whole", whole).withColumn("wanted", wanted)

    # The bucket in which each source's sample ends: the first whose running sum reaches what is wanted.
    through = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    sums = by_bucket.withColumn("through", through).alias("b")
    ends = pin(
        sums.join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")) & (F.col("through") >= F.col("wanted")))
        .groupBy("p.source", "source_size", "target", "whole", "wanted")
        .agg(F.min(F.struct("bucket", (F.col("through") - F.col("words")).alias("before"))).alias("end"))
        .select("source", "source_size", "target", "whole", "wanted", F.col("end.bucket").alias("last"), "end.before")
    )
    edge = rows.alias("r").join(ends.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.bucket") == F.col("e.last")))
    inside = Window.partitionBy("source").orderBy("at", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("before") + F.sum("size").over(inside) - F.col("size") / 2
    taken = edge.select("e.source", "at", "id", "size", "before", "wanted").withColumn("middle", middle).where("middle < wanted")
    cuts = taken.groupBy("source").agg(F.max(F.struct("at", "id", "size")).alias("cut"))
    met = ends.alias("e").join(cuts.alias("c"), F.col("e.source").eqNullSafe(F.col("c.source")), "left")
    return pin(met.select("e.source", "source_size", "target", "whole", "last", "cut")), bucket_digits


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    bucket_digits: int | None = None,
) -> DataFrame:
    """``docs`` with ``size`` (words; null texts: 0), ``source_size``, ``target`` and ``repetitions``.

    Sources in order of code points, null last and a source of its own, have
    the ``weights`` in turn.  A source's taken words miss its target by one
    document at most, and repeated rows: rows with equal id and size stand in
    one place and are taken alike, so ids should tell documents apart.  Null ids
    are ids like any other.  Columns of ``docs`` named like results are
    replaced, also where they are the id, text or source column.  Empty tables
    give empty results.
    """
    plan, bucket_digits = mixing_plan(docs, id_col, text_col, source_col, weights, share, max_epochs, seed, bucket_digits)
    named = plan.select(F.col("source").alias("__mix_source"), F.struct("source_size", "target", "whole", "last", "cut").alias("__mix_plan"))
    taken = {"size", "source_size", "target", "repetitions"}
    kept = [F.col(f"`{x}`") for x in docs.columns if x.lower() not in taken]
    own = docs.select(*kept, F.col(id_col).alias("__mix_id"), F.col(source_col).alias("__mix_own"), _words(F.col(text_col)).alias("size"))
    same = F.col("__mix_own").eqNullSafe(F.col("__mix_source"))
    if plan.count() <= BROADCAST_SOURCES:
        met = own.join(F.broadcast(named), same)
    else:
        salted = named.withColumn("__mix_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        salt = F.pmod(F.xxhash64(F.col("__mix_id"), F.col("size")), F.lit(_SALTS)).cast("int")
        met = own.join(salted, same & (salt == F.col("__mix_salt"))).drop("__mix_salt")
    at = _place(F.col("__mix_id"), F.col("size"), seed)
    place = F.struct(at.alias("at"), F.col("__mix_id").alias("id"), F.col("size").alias("size"))
    bucket = F.shiftright(at, 4 * (_HASH_DIGITS - bucket_digits)).cast("int")
    more = (bucket < F.col("__mix_plan.last")) | ((bucket == F.col("__mix_plan.last")) & F.coalesce(place <= F.col("__mix_plan.cut"), F.lit(False)))
    return met.withColumns(
        {"source_size": F.col("__mix_plan.source_size"), "target": F.col("__mix_plan.target"), "repetitions": (F.col("__mix_plan.whole") + more.cast("int")).cast("int")}
    ).drop("__mix_source", "__mix_plan", "__mix_id", "__mix_own")
