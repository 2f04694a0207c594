"""The catalogue: exact and reverse-complement duplicates as one entry, every source accounted for.

Sources have ``identifier, source_sample, original_identifier, sequence,
source_ordinal``.  A group of copies, however large, is pre-aggregated on each
partition before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import InputError
from ..functions.sequences import canonical_digest, canonical_packed, unpacked_letters
from ..session import pin, stored
from .skew import join_named


def repeated_identifiers(sources: DataFrame) -> DataFrame:
    """``identifier, n`` of those that occur more than once: an error in the input."""
    return sources.groupBy("identifier").agg(F.count("*").alias("n")).where("n > 1")


def require_unique(sources: DataFrame) -> DataFrame:
    found = repeated_identifiers(sources).orderBy("identifier").limit(5).collect()
    if found:
        raise InputError("repeated identifiers: " + ", ".join(r["identifier"] for r in found))
    return sources


def keyed(sources: DataFrame) -> DataFrame:
    """Sources with ``catalogue_id`` and ``orientation``."""
    return _with_form(sources, canonical_digest).drop("_form")


def _with_form(sources: DataFrame, form) -> DataFrame:
    """``keyed`` with the struct ``_form``: both strands are made and digested once."""
    rows = sources.withColumn("_form", form("sequence"))
    return rows.withColumns({"catalogue_id": F.concat(F.lit("ctg_"), "_form.digest"), "orientation": F.when(F.col("_form.plus"), "+").otherwise("-")})


def _rank():
    """The representative of a group is the least: forward first, then sample, name, ordinal and identifier."""
    return F.struct(
        (F.col("orientation") != "+").alias("turned"),
        F.col("source_sample").alias("sample"),
        F.col("original_identifier").alias("name"),
        F.coalesce(F.col("source_ordinal"), F.lit(-1)).alias("ordinal"),
        F.col("identifier").alias("identifier"),
    )


def catalogue_sequences(sources: DataFrame) -> DataFrame:
    """``catalogue_id, sequence, length, sha256, representative_source_id, members``: one row a distinct molecule."""
    return packed_sequences(sources).select(
        "catalogue_id", unpacked_letters("packed").alias("sequence"), "length", F.substring("catalogue_id", 5, 64).alias("sha256"), "representative_source_id", "members"
    )


def packed_sequences(sources: DataFrame) -> DataFrame:
    """``catalogue_sequences`` with ``packed_letters`` for the sequence."""
    grouped = _with_form(sources, canonical_packed).groupBy("catalogue_id").agg(
        F.first(F.struct("_form.packed", "_form.length")).alias("letters"), F.min(_rank()).alias("rank"), F.count("*").alias("members")
    )
    return grouped.select("catalogue_id", "letters.packed", "letters.length", F.col("rank.identifier").alias("representative_source_id"), "members")


def catalogue_members(sources: DataFrame) -> DataFrame:
    """``catalogue_id, source_id, source_sample, original_identifier, orientation, representative, group_size, length``: one row a source.

    A large group of copies gets its representative by broadcast, so no task
    sees all of it.
    """
    rows = keyed(sources).select("catalogue_id", "identifier", "source_sample", "original_identifier", "source_ordinal", "orientation", F.length("sequence").alias("length"))
    rows = stored(rows, "members")  # read twice; the digests are the work
    groups = rows.groupBy("catalogue_id").agg(F.min(_rank()).alias("rank"), F.count("*").alias("group_size"))
    groups = pin(groups.select("catalogue_id", F.col("rank.identifier").alias("first"), "group_size", F.col("group_size").alias("n")))
    met = join_named(rows, groups, "catalogue_id", "n", groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])
    return met.select(
        "catalogue_id", F.col("identifier").alias("source_id"), "source_sample", "original_identifier", "orientation",
        (F.col("identifier") == F.col("first")).alias("representative"), "group_size", "length",
    )


def catalogue_provenance(members: DataFrame) -> DataFrame:
    """The catalogue's provenance: a full-span row for each source."""
    return members.select(
        F.col("catalogue_id").alias("output_sequence"), "source_sample", F.col("original_identifier").alias("source_contig"),
        F.when(F.col("group_size") > 1, "EXACT_MATCH").otherwise("UNIQUE").alias("relationship"), "orientation",
        F.lit(0).alias("source_start"), F.col("length").alias("source_end"), F.lit(0).alias("output_start"), F.col("length").alias("output_end"),
        F.lit(1.0).alias("identity"), F.when(F.col("representative"), "representative").otherwise("exact_duplicate").alias("disposition"),
        F.lit("canonical exact sequence catalogue").alias("decision_reason"), F.lit("none").alias("evidence_mode"),
    )


def sample_totals(samples: DataFrame, sources: DataFrame) -> DataFrame:
    """``source_sample, contigs, bases`` for every sample, those without contigs too."""
    counted = sources.groupBy("source_sample").agg(F.count("*").alias("n"), F.sum(F.length("sequence")).alias("b"))
    return samples.select("source_sample").distinct().join(counted, "source_sample", "left").select(
        "source_sample", F.coalesce("n", F.lit(0)).cast("long").alias("contigs"), F.coalesce("b", F.lit(0)).cast("long").alias("bases")
    )
