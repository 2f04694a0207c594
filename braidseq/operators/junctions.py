"""Provisional junctions: references built from two sequences, control reads that must not span them, and evidence by remapping reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .cardinality import exactly_one
from .evidence import cigar_blocks, paf_evidence, reads_near_end, spanning_reads
from .mapping import map_reads

#: Lengths of control reads, at most and at least.
CONTROL_BASES, LEAST_CONTROL = 1000, 100
#: The diagnostics of an evidence row.
NO_READS = "no reads selected"
EVIDENCE_ONLY = "junction-spanning alignments are evidence only and do not authorize a merge"
#: Prefix of a provisional reference's name, and the only relationship that joins end to start.
REFERENCE_PREFIX, JOINING = "junction_", "QUERY_SUFFIX_TO_TARGET_PREFIX"


def _joined(truth: DataFrame, relationships: DataFrame, sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cases with their relationship and both sequences, and ``case_id, reason`` of those that lack one."""
    c = F.col
    own = truth.select("case_id", "left_contig", "right_contig", "junction_is_true")
    named = relationships.select("case_id", c("query_id").alias("left_contig"), c("target_id").alias("right_contig"), "relationship_type", "orientation", "target_end")
    met, odd = exactly_one(own, named, ["case_id", "left_contig", "right_contig"])
    broken = [odd.select("case_id", F.lit("not exactly one ordered relationship").alias("reason"))]
    joining = F.coalesce((c("relationship_type") == JOINING) & (c("orientation") == "+"), F.lit(False))
    broken.append(met.where(~joining).select("case_id", F.lit("not a forward suffix-to-prefix relationship").alias("reason")))
    met = met.where(joining).drop("relationship_type", "orientation")
    for side in ("left", "right"):
        bases = sequences.select(c("identifier").alias(f"{side}_contig"), c("sequence").alias(f"{side}_sequence"))
        met, odd = exactly_one(met, bases, [f"{side}_contig"])
        why = F.when(c("matches") == 0, F.lit(f"unknown {side} sequence")).otherwise(F.lit(f"repeated {side} sequence"))
        broken.append(odd.select("case_id", why.alias("reason")))
    outside = ~F.coalesce((c("target_end") >= 0) & (c("target_end") <= F.length("right_sequence")), F.lit(False))
    broken.append(met.where(outside).select("case_id", F.lit("the overlap ends outside the right sequence").alias("reason")))
    all_broken = broken[0]
    for more in broken[1:]:
        all_broken = all_broken.unionByName(more)
    return met.where(~outside), all_broken


def provisional_references(truth: DataFrame, relationships: DataFrame, sequences: DataFrame, expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``case_id, reference, left_contig, right_contig, junction_is_true, junction, sequence``, and ``case_id, reason`` of the cases that give none.

    The reference is the left sequence and what the right one has behind the
    overlap; the junction lies at the left one's length.  ``truth``: ``case_id,
    left_contig, right_contig, junction_is_true``; ``relationships``:
    ``case_id, query_id, target_id, relationship_type, orientation,
    target_end``; ``sequences``: ``identifier, sequence``.  With ``expected``
    (``case_id, sequence``) a true junction must give the expected sequence and
    an artificial one must have none.  A case may break several rules.
    """
    c = F.col
    met, broken = _joined(truth, relationships, sequences)
    whole = F.concat("left_sequence", F.expr("substring(right_sequence, target_end + 1)"))
    built = met.select(
        "case_id", F.concat(F.lit(REFERENCE_PREFIX), "case_id").alias("reference"), "left_contig", "right_contig", "junction_is_true",
        F.length("left_sequence").alias("junction"), whole.alias("sequence"),
    )
    if expected is None:
        return built, broken
    wanted = expected.groupBy("case_id").agg(F.count("*").alias("_n"), F.min("sequence").alias("_expected"))
    checked = built.join(wanted, "case_id", "left")
    same = F.coalesce((c("_n") == 1) & (c("_expected") == c("sequence")), F.lit(False))
    odd = F.when(c("junction_is_true") & ~same, "not the expected merged sequence").when(~c("junction_is_true") & c("_n").isNotNull(), "an artificial junction has an expected sequence")
    checked = checked.withColumn("reason", odd)
    return checked.where("reason is null").select(*built.columns), broken.unionByName(checked.where("reason is not null").select("case_id", "reason"))


def negative_controls(truth: DataFrame, relationships: DataFrame, sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``case_id, name, sequence, quality``: two reads for each artificial junction that end at it, and ``case_id, reason`` of those too short for it.

    One read ends where the left sequence ends, the other begins where the
    overlap does in the right one; each has 1000 bases, or what both sides can
    give, 100 at least.  None can span the junction.
    """
    met, broken = _joined(truth.where(~F.col("junction_is_true")), relationships, sequences)
    met = met.withColumn("n", F.expr(f"least({CONTROL_BASES}, length(left_sequence), length(right_sequence) - target_end)"))
    enough = F.col("n") >= LEAST_CONTROL
    short = met.where(~enough).select("case_id", F.lit("too short for control reads").alias("reason"))
    sides = F.array(
        F.struct(F.concat("case_id", F.lit(":left-end")).alias("name"), F.expr("right(left_sequence, n)").alias("sequence")),
        F.struct(F.concat("case_id", F.lit(":right-after-overlap")).alias("name"), F.expr("substring(right_sequence, target_end + 1, n)").alias("sequence")),
    )
    reads = met.where(enough).select("case_id", F.explode(sides).alias("r")).select("case_id", "r.*").withColumn("quality", F.expr("repeat('I', length(sequence))"))
    return reads, broken.unionByName(short)


def remapping_evidence(requests: DataFrame, reads: DataFrame, flank: int, min_mapping_quality: int = 0) -> DataFrame:
    """A row a request: how many of its own reads map to its provisional reference, and how many span the junction without a gap.

    ``requests``: ``case_id, reference, sequence, junction``; ``reads``:
    ``case_id, name, sequence``: the reads selected for a case, names distinct
    within it.  Gives ``case_id, reference, reference_length,
    reference_sha256, junction, selected_reads, remapped_reads, spanning_reads,
    spanning_sha256, minimum_flank, minimum_mapping_quality, diagnostics``;
    the digest is over the sorted names of spanning reads.  Evidence only: no
    row authorizes a merge.
    """
    c = F.col
    own = reads.select("case_id", "name", F.concat_ws("\0", "case_id", "name").alias("key"), "sequence")
    asked = pin(own.join(requests.select("case_id", "reference"), "case_id"))
    hits = pin(map_reads(asked.select(c("key").alias("name"), "sequence", "reference"), requests.select("reference", "sequence")))
    blocks = paf_evidence(hits.withColumn("error", F.lit(None).cast("string"))).where("error is null")
    counts = spanning_reads(blocks, requests.select("case_id", "reference", "junction"), flank, min_mapping_quality)
    over = blocks.join(requests.select("reference", "case_id", "junction"), "reference")
    if min_mapping_quality:
        over = over.where((c("mapping_quality") >= min_mapping_quality) & (c("mapping_quality") < 255))
    spans = F.exists("blocks", lambda b: (b["start"] <= c("junction") - flank) & (b["end"] >= c("junction") + flank))
    names = over.where(spans).select("case_id", F.substring_index("name", "\0", -1).alias("name"))
    digests = names.groupBy("case_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("name")), "\n"), 256).alias("spanning_sha256"))
    selected = asked.groupBy("case_id").agg(F.count_distinct("name").alias("selected_reads"))
    met = requests.select("case_id", "reference", F.length("sequence").alias("reference_length"), F.sha2("sequence", 256).alias("reference_sha256"), "junction")
    met = met.join(selected, "case_id", "left").join(counts, "case_id").join(digests, "case_id", "left")
    return met.select(
        "case_id", "reference", "reference_length", "reference_sha256", "junction", F.coalesce("selected_reads", F.lit(0)).alias("selected_reads"),
        "remapped_reads", "spanning_reads", F.coalesce("spanning_sha256", F.sha2(F.lit(""), 256)).alias("spanning_sha256"),
        F.lit(flank).alias("minimum_flank"), F.lit(min_mapping_quality).alias("minimum_mapping_quality"),
        F.when(c("selected_reads").isNull(), NO_READS).otherwise(EVIDENCE_ONLY).alias("diagnostics"),
    )


def select_reads(requests: DataFrame, alignments: DataFrame, reads: DataFrame, lengths: DataFrame, distance: int) -> DataFrame:
    """``case_id, name, sequence``: the reads that lie near the joined ends in the source alignments, each once.

    ``requests``: ``case_id, left_contig, right_contig``; a junction joins the
    left one's end and the right one's start.  ``alignments``: primary records
    ``name, reference, position, cigar``; ``reads``: ``name, sequence``, all
    records of a selected name; ``lengths``: ``reference, length``.
    """
    near = pin(reads_near_end(cigar_blocks(alignments), lengths, distance))
    ends = requests.select("case_id", F.explode(F.array(F.struct(F.col("left_contig").alias("reference"), F.lit("right").alias("side")), F.struct(F.col("right_contig").alias("reference"), F.lit("left").alias("side")))).alias("e"))
    chosen = ends.select("case_id", "e.*").join(near, ["reference", "side"]).select("case_id", "name").distinct()
    return chosen.join(reads.select("name", "sequence"), "name").select("case_id", "name", "sequence")
