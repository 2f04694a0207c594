"""Alignment without external tools: ungapped diagonals from shared seeds, and gapped paths along chains of them.

Every diagonal that a seed names is laid over its whole overlap and its bases
are compared one by one, so counts of matches are real.  Nothing picks a best
diagonal: rivals must show up as ambiguity later.  Where the seeds of a pair
rise over several diagonals, ``gapped_hits`` follows them with gaps.  Hits from
another aligner (``sources.alignments.read_paf``) fit wherever these do.
"""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..config import RunConfig
from ..functions.sequences import packed_letters, unpacked
from ..session import pin
from .chaining import PAIRS, TURN, aligned, chains
from .minimisers import lines_of
from .skew import join_named


def _overlaps(lines, query_length, target_length, kmer: int):
    """Whether diagonals (``minimisers.lined_candidates``) are on different strands, and the forward intervals of their overlaps."""
    import numpy as np

    turned, named = lines & 1 == 1, lines >> 1
    shift = named - np.where(turned, target_length - kmer, 0)
    start, end = np.maximum(0, shift), np.minimum(query_length, target_length + shift)
    low, high = start - shift, end - shift
    return turned, start, end, np.where(turned, target_length - high, low), np.where(turned, target_length - low, high)


@F.arrow_udf(BinaryType())
def _as_bytes(lines: pa.Array) -> pa.Array:
    return pa.array([array("q", x).tobytes() for x in lines.to_pylist()], pa.binary())


def diagonal_hits(candidates: DataFrame, pairs: DataFrame, sequences: DataFrame, config: RunConfig) -> DataFrame:
    """``line_hits`` on the diagonals that the rows of ``pairs`` (``minimisers.seed_pairs``) name."""
    c = F.col
    # Many seeds lie on one diagonal: they are one row before anything moves.
    named = c("query_position").cast("long") + F.when(c("relative") == "+", -c("target_position")).otherwise(c("target_position"))
    lines = pairs.select("query_id", "target_id", (2 * named + F.when(c("relative") == "+", 0).otherwise(1)).alias("line")).distinct()
    lines = lines.join(candidates.select("query_id", "target_id"), ["query_id", "target_id"], "left_semi").groupBy("query_id", "target_id").agg(F.collect_list("line").alias("lines"))
    return line_hits(lines.select("query_id", "target_id", _as_bytes("lines").alias("lines")), sequences, config)


def line_hits(candidates: DataFrame, sequences: DataFrame, config: RunConfig) -> DataFrame:
    """Hits of the candidate pairs on their ``lines``.  Diagonals too short for any relationship are left out before bases move.

    ``sequences``: ``sequence_id, sequence, length``.  A pair's bases move once,
    however many diagonals it has, packed, and a sequence of many pairs reaches them by
    broadcast.
    """
    c, kinds = F.col, dict(candidates.dtypes)
    kmer, least = config.kmer, min(config.min_overlap, config.min_containment)
    sided = candidates.select("query_id", "target_id", "lines")
    for side in ("query", "target"):
        sided = sided.join(sequences.select(c("sequence_id").alias(f"{side}_id"), c("length").alias(f"{side}_length")), f"{side}_id")

    def long_enough(batches):
        import numpy as np

        for batch in batches:
            lines, counts = lines_of(batch.column("lines"))
            row = np.repeat(np.arange(batch.num_rows), counts)
            _, start, end, _, _ = _overlaps(lines, *(batch.column(f"{side}_length").to_numpy(zero_copy_only=False).astype(np.int64)[row] for side in ("query", "target")), kmer)
            kept = end - start >= least
            left = np.bincount(row[kept], minlength=batch.num_rows)
            some = np.flatnonzero(left)
            held = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((8 * np.append(0, np.cumsum(left[some]))).astype(np.int32)), pa.py_buffer(lines[kept])])
            yield pa.RecordBatch.from_arrays([*batch.select(["query_id", "target_id"]).take(pa.array(some)).columns, held], ["query_id", "target_id", "lines"])

    ids = f"query_id {kinds['query_id']}, target_id {kinds['target_id']}"
    grouped = pin(sided.select("query_id", "target_id", "lines", "query_length", "target_length").mapInArrow(long_enough, f"{ids}, lines binary"))
    total, met = grouped.count(), grouped
    for side in ("query", "target"):
        many = grouped.groupBy(f"{side}_id").agg(F.count("*").alias("n"))
        bases = sequences.select(c("sequence_id").alias(f"{side}_id"), packed_letters("sequence").alias(side), c("length").cast("int").alias(f"{side}_length"))
        met = join_named(met, bases.join(many, f"{side}_id"), f"{side}_id", "n", total)
    names = ["query_id", "target_id", "query_length", "query_start", "query_end", "orientation", "target_length", "target_start", "target_end", "matching_bases", "alignment_block_length"]
    schema = ", ".join([ids, *(f"{x} {'string' if x == 'orientation' else 'int'}" for x in names[2:])])

    def run(batches):
        import numpy as np

        for whole in batches:
            for at in range(0, whole.num_rows, PAIRS):
                batch = whole.slice(at, PAIRS)
                places, out = [], []
                for i, r in enumerate(batch.drop_columns(["query_id", "target_id"]).to_pylist()):
                    letters, ql, tl = unpacked(r["target"]), r["query_length"], r["target_length"]
                    query, plain = np.frombuffer(unpacked(r["query"]), dtype=np.uint8), np.frombuffer(letters, dtype=np.uint8)
                    other = None
                    for turned, qs, qe, ts, te in zip(*(x.tolist() for x in _overlaps(np.frombuffer(r["lines"], dtype=np.int64), ql, tl, kmer))):
                        a = query[qs:qe]
                        if turned:
                            other = np.frombuffer(letters.translate(TURN)[::-1], dtype=np.uint8) if other is None else other
                            b = other[tl - te : tl - ts]
                        else:
                            b = plain[ts:te]
                        places.append(i)
                        out.append((ql, qs, qe, "-" if turned else "+", tl, ts, te, int(np.count_nonzero(a == b)), len(a)))
                taken = batch.select(["query_id", "target_id"]).take(pa.array(places, pa.int32()))
                columns = list(zip(*out)) if out else [[]] * (len(names) - 2)
                types = [pa.string() if x == "orientation" else pa.int32() for x in names[2:]]
                yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(x, t) for x, t in zip(columns, types))], names)

    return met.select("query_id", "target_id", "lines", "query", "query_length", "target", "target_length").mapInArrow(run, schema)


def gapped_hits(candidates: DataFrame, pairs: DataFrame, sequences: DataFrame, config: RunConfig) -> DataFrame:
    """Hits of the candidate pairs along chains that no single diagonal explains, with ``cigar``; the columns of ``diagonal_hits`` otherwise.

    A chain whose seeds lie on one diagonal is left to ``diagonal_hits``, which
    compares all its bases.  All chains of a pair have their hit, so rivals
    stay.  Paths shorter than any relationship are left out.
    """
    c = F.col
    wanted = pairs.join(candidates.select("query_id", "target_id"), ["query_id", "target_id"], "left_semi")
    seeds = wanted.select(
        "query_id", "target_id", c("relative").alias("orientation"),
        F.when(c("relative") == "+", c("query_position")).otherwise(-c("query_position") - config.kmer).cast("int").alias("q"), c("target_position").cast("int").alias("t"),
    )
    found = aligned(chains(seeds).where("low < high"), sequences, sequences)
    least = min(config.min_overlap, config.min_containment)
    return found.where(c("query_end") - c("query_start") >= least).select(
        "query_id", "target_id", "query_length", "query_start", "query_end", "orientation", "target_length", "target_start", "target_end", "matching_bases", "alignment_block_length", "cigar"
    )


def aligned_hits(candidates: DataFrame, pairs: DataFrame, sequences: DataFrame, config: RunConfig) -> DataFrame:
    """Hits on diagonals and along gapped chains, with ``cigar`` (null on diagonals)."""
    plain = diagonal_hits(candidates, pairs, sequences, config).withColumn("cigar", F.lit(None).cast("string"))
    return plain.unionByName(gapped_hits(candidates, pairs, sequences, config))
