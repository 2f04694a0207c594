"""PAF and SAM text as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import numbered_lines

_PAF = ["query_id", "query_length", "query_start", "query_end", "orientation", "target_id", "target_length", "target_start", "target_end", "matching_bases", "alignment_block_length", "mapping_quality"]
_TEXT = {"query_id", "orientation", "target_id"}
_TAGS = {"AS": ("alignment_score", "int"), "cm": ("chain_minimisers", "int"), "s1": ("chain_score", "int"), "s2": ("secondary_chain_score", "int"), "tp": ("alignment_type", "string"), "cg": ("cigar", "string")}


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """Hits with their optional tags, ``file`` and ``line`` (from 1); ``error`` is null for sound lines.  Blank lines are skipped, but count."""
    rows = numbered_lines(spark, path).where("trim(value) <> ''").select("file", "line", F.split("value", "\t").alias("f"))
    fields = [F.try_element_at("f", F.lit(i + 1)).alias(x) if x in _TEXT else F.expr(f"try_cast(try_element_at(f, {i + 1}) as int)").alias(x) for i, x in enumerate(_PAF)]
    tags = F.slice("f", 13, F.greatest(F.size("f") - 12, F.lit(0)))
    named = rows.select("file", "line", *fields, tags.alias("tags"), F.size("f").alias("n"))
    for tag, (name, kind) in _TAGS.items():
        own = F.expr(f"filter(tags, t -> startswith(t, '{tag}:'))")
        value = F.expr(f"substring(try_element_at(filter(tags, t -> startswith(t, '{tag}:')), 1), 6)")
        named = named.withColumn(f"_{name}_n", F.size(own)).withColumn(name, value.try_cast(kind) if kind == "int" else value)
    numbers = [x for x in _PAF if x not in _TEXT]
    missing = None
    for x in numbers:
        missing = F.col(x).isNull() if missing is None else missing | F.col(x).isNull()
    twice = None
    for name, _ in _TAGS.values():
        twice = (F.col(f"_{name}_n") > 1) if twice is None else twice | (F.col(f"_{name}_n") > 1)
    c = F.col
    odd = (c("query_start") < 0) | (c("query_end") < c("query_start")) | (c("query_end") > c("query_length")) | (c("target_start") < 0) | (c("target_end") < c("target_start")) | (c("target_end") > c("target_length"))
    odd_tag = None
    for tag, (name, kind) in _TAGS.items():
        bad = (c(f"_{name}_n") == 1) & (c(name).isNull() if kind == "int" else c(name) == "")
        odd_tag = bad if odd_tag is None else odd_tag | bad
    error = F.when(F.col("n") < 12, "fewer than twelve fields").when(missing, "a number is malformed").when(~F.col("orientation").isin("+", "-"), "orientation").when(twice, "a tag occurs twice").when(odd_tag, "a tag is malformed").when(odd, "an interval is out of range").when((c("mapping_quality") < 0) | (c("mapping_quality") > 255), "mapping quality")
    spans = [c("query_end") - c("query_start"), c("target_end") - c("target_start")]
    block, equal = c("alignment_block_length"), c("matching_bases")
    error = (
        error.when((block < 0) | (equal < 0) | (equal > block), "matching bases and block length").when(equal > F.least(*spans), "more matching bases than an aligned span")
        .when(block < F.greatest(*spans), "a block shorter than an aligned span").when(block > spans[0] + spans[1], "a block longer than both aligned spans")
    )
    # The explode keeps a filter on the error above it; below it the filter would be written out in all that the error is made of.
    return named.select(*_PAF, *[name for name, _ in _TAGS.values()], F.explode(F.array(error)).alias("error"), "file", "line")


#: Flags of records that are no primary alignment (unmapped, secondary, supplementary).
NOT_PRIMARY = 0x904


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """``name, flag, reference, position`` (0-based), ``mapping_quality, cigar, sequence, qualities, error, file, line`` of primary mapped records.

    ``error`` is null for sound records; malformed lines keep what could be
    read.  Where a file's header names references, a record's must be one of
    them and the alignment must lie inside it.  Unmapped, secondary and
    supplementary records are left out, blank lines are skipped.
    """
    c = F.col
    lines = numbered_lines(spark, path)
    rows = lines.where("not startswith(value, '@') and trim(value) <> ''").select("file", "line", F.split("value", "\t", -1).alias("f"))
    part = lambda i: F.try_element_at("f", F.lit(i))
    number = lambda i: F.expr(f"try_cast(try_element_at(f, {i}) as int)")
    typed = rows.select(
        "file", "line", (F.size("f") >= 11).alias("whole"), part(1).alias("name"), number(2).alias("flag"), part(3).alias("reference"), (number(4) - 1).alias("position"),
        number(5).alias("mapping_quality"), part(6).alias("cigar"), part(10).alias("sequence"), part(11).alias("qualities"),
    )
    primary = typed.where(~F.coalesce(c("flag").bitwiseAND(NOT_PRIMARY) != 0, F.lit(False)) & ~F.coalesce(c("whole") & (c("reference") == "*"), F.lit(False)))
    header = _references(lines).where("error is null").groupBy("file", "reference").agg(F.min("length").alias("_length"))
    headed = header.groupBy("file").agg(F.lit(True).alias("_headed"))
    met = primary.join(header, ["file", "reference"], "left").join(F.broadcast(headed), "file", "left")
    steps = F.expr("regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1)")
    span = F.aggregate(F.transform(steps, lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    odd_cigar = ~F.coalesce(c("cigar").rlike(r"^(\*|([0-9]+[MIDNSHP=X])+)$"), F.lit(False))
    numbers = c("flag").isNull() | c("position").isNull() | c("mapping_quality").isNull()
    error = (
        F.when(~c("whole"), "fewer than eleven fields").when(numbers, "a number is malformed").when((c("mapping_quality") < 0) | (c("mapping_quality") > 255), "mapping quality")
        .when(odd_cigar, "malformed CIGAR").when(c("_headed") & c("_length").isNull(), "a reference that the header does not name")
        .when((c("position") < 0) | (c("position") + span > c("_length")), "the alignment lies outside its reference")
    )
    return met.select("name", "flag", "reference", "position", "mapping_quality", "cigar", "sequence", "qualities", error.alias("error"), "file", "line")


def _references(lines: DataFrame) -> DataFrame:
    """``file, line, reference, length, error`` of the ``@SQ`` lines."""
    c = F.col
    rows = lines.where("startswith(value, '@SQ\t')")
    own = rows.select("file", "line", F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("reference"), F.regexp_extract("value", r"\tLN:([^\t]+)", 1).alias("given"))
    own = own.withColumn("length", F.expr("try_cast(given as int)"))
    first = own.groupBy("file", "reference").agg(F.min("line").alias("first"))
    met = own.join(first, ["file", "reference"])
    error = F.when((c("reference") == "") | (c("given") == ""), "SN and LN are required").when(c("line") > c("first"), "repeated reference").when(c("length").isNull(), "a length is malformed").when(c("length") < 1, "a length is positive")
    return met.select("file", "line", "reference", "length", error.alias("error"))


def sam_reference_errors(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, reference, error`` of ``@SQ`` lines that break a rule, and a row without a line for each file that has none."""
    lines = numbered_lines(spark, path)
    found = _references(lines)
    none = lines.select("file").distinct().join(found.select("file").distinct(), "file", "left_anti")
    return found.where("error is not null").select("file", "line", "reference", "error").unionByName(
        none.select("file", F.lit(None).cast("long").alias("line"), F.lit(None).cast("string").alias("reference"), F.lit("no reference in the header").alias("error"))
    )


def sam_references(spark: SparkSession, path: str) -> DataFrame:
    """``reference, length`` of the header."""
    rows = spark.read.text(path).where("startswith(value, '@SQ')")
    return rows.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("reference"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("int").alias("length"))


def reference_mismatches(references: DataFrame, sequences: DataFrame) -> DataFrame:
    """References and sequences that differ in name or length; empty if both are the same."""
    own = sequences.select(F.col("identifier").alias("reference"), F.length("sequence").alias("sequence_length"))
    return references.join(own, "reference", "full").where(~F.col("length").eqNullSafe(F.col("sequence_length")))
