"""Results as text: FASTA, tab-separated tables, GFA; and atomic publication of several at once."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import InputError

#: The columns of the candidate table.
CANDIDATE_COLUMNS = ["query", "target", "shared_minimisers", "orientation", "supported_orientations", "query_positions", "target_positions", "terminal_topologies", "reasons"]
#: The columns of the provenance table.
PROVENANCE_COLUMNS = [
    "output_sequence", "source_sample", "source_contig", "relationship", "orientation", "source_start", "source_end",
    "output_start", "output_end", "identity", "disposition", "decision_reason", "evidence_mode",
]


def fasta_lines(outputs: DataFrame, width: int = 80) -> DataFrame:
    """``value``: a record of each of ``output_sequence, sequence``, wrapped; in order of name.  Names that repeat raise an InputError."""
    twice = outputs.groupBy("output_sequence").count().where("count > 1").limit(5).collect()
    if twice:
        raise InputError("repeated output: " + ", ".join(sorted(r["output_sequence"] for r in twice)))
    wrapped = F.regexp_replace("sequence", f"(.{{{width}}})(?!$)", "$1\n")
    return outputs.orderBy("output_sequence").select(F.concat(F.lit(">"), "output_sequence", F.lit("\n"), wrapped).alias("value"))


def provenance_table(provenance: DataFrame) -> DataFrame:
    identity = F.coalesce(F.format_string("%.6f", "identity"), F.lit(""))
    return provenance.withColumn("identity", identity).select(*PROVENANCE_COLUMNS).orderBy("output_sequence", "output_start", "source_sample", "source_contig")


def gfa_lines(outputs: DataFrame, edges: DataFrame) -> DataFrame:
    """``value``: header, segments, and links between segments that were both written, oriented by the ends that meet."""
    head = outputs.sparkSession.createDataFrame([("H\tVN:Z:1.0",)], "value string").select("value", F.lit(0).alias("o"), F.lit("").alias("k"))
    segments = outputs.select(F.concat_ws("\t", F.lit("S"), "output_sequence", "sequence").alias("value"), F.lit(1).alias("o"), F.col("output_sequence").alias("k"))
    written = outputs.select(F.col("output_sequence").alias("id"))
    overlaps = edges.where("kind = 'overlap'").join(written, F.col("query_id") == F.col("id"), "left_semi").join(written, F.col("target_id") == F.col("id"), "left_semi")
    ahead = F.col("relationship_type") == "QUERY_SUFFIX_TO_TARGET_PREFIX"
    turned = F.translate("orientation", "+-", "-+")
    link = F.when(ahead, F.concat_ws("\t", F.lit("L"), "query_id", F.lit("+"), "target_id", "orientation")).otherwise(F.concat_ws("\t", F.lit("L"), "query_id", F.lit("-"), "target_id", turned))
    links = overlaps.select(F.concat_ws("\t", link, F.concat("aligned_length", F.lit("M"))).alias("value"), F.lit(2).alias("o"), F.col("edge_id").alias("k"))
    return head.unionByName(segments).unionByName(links).orderBy("o", "k").select("value")


#: The columns of the pair and join-support tables, and the text of a junction without a policy.
PAIR_COLUMNS = [
    "query", "target", "relationship_type", "orientation", "identity", "aligned_length", "query_start", "query_end", "target_start", "target_end",
    "query_coverage", "target_coverage", "status", "accepted_hits", "rejected_hits", "reasons",
]
JOIN_SUPPORT_COLUMNS = [
    "component_id", "edge_id", "left_contig", "right_contig", "technology", "samples_tested", "selected_reads", "remapped_reads", "spanning_reads", "spanning_fraction",
    "minimum_mapping_quality", "minimum_flank", "junction_status", "policy_id", "decision_reason",
]
NO_POLICY = "no approved junction policy; imperfect overlap retained"


def _six(name: str) -> Column:
    return F.format_string("%.6f", F.bround(name, 6))


def pair_table(decisions: DataFrame) -> DataFrame:
    """``PAIR_COLUMNS`` of ``hits.classify_pairs``: fractions with six digits, reasons of the decision and of its rejected hits, each once and in order."""
    both = F.concat(F.split(F.coalesce("reasons", F.lit("")), "; "), F.split(F.coalesce("rejections", F.lit("")), "; "))
    reasons = F.array_join(F.array_sort(F.filter(F.array_distinct(both), lambda r: r != "")), "; ")
    named = decisions.withColumns({"query": F.col("query_id"), "target": F.col("target_id"), "reasons": reasons} | {x: _six(x) for x in ("identity", "query_coverage", "target_coverage")})
    return named.select(*PAIR_COLUMNS)


def candidate_table(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """``CANDIDATE_COLUMNS`` of ``minimisers.candidate_pairs``: a dot where both strands are supported, the places of the shared seeds from ``minimisers.seed_pairs``.

    A pair's places are no more than its sequences have seeds.
    """
    wanted = pairs.join(candidates.select("query_id", "target_id"), ["query_id", "target_id"], "left_semi")
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: x.cast("string")), ",").alias(f"{c}s")
    places = wanted.groupBy("query_id", "target_id").agg(listed("query_position"), listed("target_position"))
    met = candidates.join(places, ["query_id", "target_id"]).withColumns({"query": F.col("query_id"), "target": F.col("target_id"), "orientation": F.coalesce("orientation", F.lit("."))})
    return met.select(*CANDIDATE_COLUMNS)


def relationship_table(decisions: DataFrame) -> DataFrame:
    """The narrow table of decisions: names, type, strand, identity with six digits, length, status, reasons as decided."""
    return decisions.select(F.col("query_id").alias("query"), F.col("target_id").alias("target"), "relationship_type", "orientation", _six("identity").alias("identity"), "aligned_length", "status", "reasons")


def join_support_table(edges: DataFrame, supported: DataFrame) -> DataFrame:
    """``JOIN_SUPPORT_COLUMNS``: every overlap edge without support (``edge_id`` in ``supported``), deferred, as no policy authorises it."""
    left = edges.where("kind = 'overlap'").join(supported.select("edge_id").distinct(), "edge_id", "left_anti")
    fixed = {"component_id": "unknown", "technology": "", "spanning_fraction": 0.0, "minimum_mapping_quality": "", "minimum_flank": "", "junction_status": "DEFERRED", "policy_id": "", "decision_reason": NO_POLICY}
    counts = dict.fromkeys(("samples_tested", "selected_reads", "remapped_reads", "spanning_reads"), 0)
    named = left.withColumns({"left_contig": F.col("query_id"), "right_contig": F.col("target_id")} | {k: F.lit(v) for k, v in (fixed | counts).items()})
    return named.select(*JOIN_SUPPORT_COLUMNS)


def write_tsv(df: DataFrame, path: str) -> None:
    """One folder of tab-separated parts with headers; Spark's committer makes it appear whole."""
    df.write.option("sep", "\t").option("header", True).option("quote", "").csv(path)


def publish(results: dict[str, DataFrame], folder: str, last: str) -> str:
    """Writes each result as Parquet into a new folder under ``folder`` and then names that folder in ``<folder>/current``; returns its name.

    A run that ends midway leaves ``current`` as it was, so readers (``published``)
    see one run's results, all of them, or the last run's before it.  ``last``
    is written after all others.
    """
    run = f"run-{uuid.uuid4().hex}"
    for name in [*sorted(set(results) - {last}), last]:
        results[name].write.mode("errorifexists").parquet(f"{folder}/{run}/{name}")
    spark = results[last].sparkSession
    # A new marker beside the old ones: the newest that is complete counts, so nothing is ever replaced in place.
    marker = spark.range(1).select(F.lit(run).alias("run"), F.current_timestamp().alias("at"))
    marker.coalesce(1).write.mode("append").parquet(f"{folder}/current")
    return run


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``name`` as the newest complete run under ``folder`` has it."""
    run = spark.read.parquet(f"{folder}/current").orderBy(F.col("at").desc(), F.col("run").desc()).first()["run"]
    return spark.read.parquet(f"{folder}/{run}/{name}")
