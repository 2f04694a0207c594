"""FASTA and FASTQ files, manifests, and generated sequences as DataFrames."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import InputError
from ..functions.sequences import illegal_symbols
from .lines import numbered_lines, with_place


def read_fasta(spark: SparkSession, path: str | list[str], sample: str = "") -> DataFrame:
    """``identifier, source_sample, original_identifier, description, sequence, source_ordinal`` from FASTA, gzip by suffix.

    Records are split by Spark's reader, so a large plain file is read by many
    tasks; ``source_ordinal`` is the record's place in its file, from 0, by
    counts of the file's splits.  Text before a file's first header is a row
    without a name, described as ``data before header``.  Use ``fasta_errors``
    to check what was read.
    """
    prefix = f"{sample}:" if sample else ""
    found = _records(spark, path)
    return found.select(F.concat(F.lit(prefix), "original_identifier").alias("identifier"), F.lit(sample).alias("source_sample"), "original_identifier", "description", "sequence", "source_ordinal")


def _records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, original_identifier, description, sequence, source_ordinal``: one scan, however many files."""
    cut = spark.read.option("lineSep", "\n>").text(path)
    raw = cut.select(F.regexp_replace("value", "\r", "").alias("r"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    met = with_place(raw, "place").where("trim(r) <> ''")
    # Every record but a file's first lost its sign to the separator.
    stray = (F.col("place") == 0) & ~F.col("r").startswith(">")
    head, body = F.regexp_extract("r", r"^>?([^\n]*)", 1), F.regexp_extract("r", r"(?s)^[^\n]*\n(.*)$", 1)
    name = F.when(stray, "").otherwise(F.regexp_extract(head, r"^(\S*)", 1))
    bases = F.upper(F.regexp_replace(F.when(stray, F.col("r")).otherwise(body), r"\s", ""))
    return met.select(
        "file", name.alias("original_identifier"), F.when(stray, STRAY).otherwise(F.trim(F.regexp_replace(head, r"^\S*", ""))).alias("description"),
        bases.alias("sequence"), F.col("place").cast("int").alias("source_ordinal"),
    )


STRAY = "data before header"


def fasta_errors(sources: DataFrame) -> DataFrame:
    """``identifier, error``: empty names and sequences, illegal symbols, repeated names."""
    what = F.when(F.col("description") == STRAY, STRAY).otherwise("empty header") if "description" in sources.columns else F.lit("empty header")
    empty = sources.where("original_identifier = ''").select("identifier", what.alias("error"))
    bare = sources.where("sequence = ''").select("identifier", F.lit("empty sequence").alias("error"))
    odd = sources.where(illegal_symbols(F.col("sequence")) != "").select("identifier", F.lit("illegal symbol").alias("error"))
    twice = sources.groupBy("identifier").count().where("count > 1").select("identifier", F.lit("duplicate identifier").alias("error"))
    return empty.union(bare).union(odd).union(twice)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """``name, sequence, quality, error`` (null: a sound record) from FASTQ records of four lines each, whatever their qualities begin with.

    ``file`` and ``line`` (of the header, from 1) tell where a record is.  A
    name that occurs more than once in a file is an error of all its records.
    """
    lines = numbered_lines(spark, path).select("file", (F.col("line") - 1).alias("line"), F.regexp_replace("value", "[\r\n]+$", "").alias("value"))
    part = lambda k: F.max(F.when(F.pmod("line", F.lit(4)) == k, F.col("value")))
    rows = lines.groupBy("file", F.floor(F.col("line") / 4).alias("record")).agg(
        part(0).alias("header"), part(1).alias("sequence"), part(2).alias("plus"), part(3).alias("quality")
    )
    name = F.when(F.col("header").startswith("@"), F.regexp_extract("header", r"^@\s*(\S*)", 1)).otherwise("")
    error = (
        F.when(F.col("quality").isNull(), "incomplete record").when(~F.col("header").startswith("@"), "malformed record").when(~F.col("plus").startswith("+"), "malformed record")
        .when(name == "", "empty name").when(F.length("sequence") != F.length("quality"), "sequence and quality differ in length")
    )
    named = rows.select("file", (4 * F.col("record") + 1).alias("line"), name.alias("name"), "sequence", "quality", error.alias("error"))
    twice = named.where("name <> ''").groupBy("file", "name").agg(F.count("*").alias("n")).where("n > 1").select("file", "name", F.lit("repeated name").alias("again"))
    return named.join(twice, ["file", "name"], "left").select("name", "sequence", "quality", F.coalesce("error", "again").alias("error"), "file", "line")


MANIFEST_REQUIRED = ("sample", "contigs")
MANIFEST_OPTIONAL = ("bam", "technology", "assembly_graph")


def read_manifest(path: str) -> list[dict]:
    """Samples in order of name; a small control table, read on the driver.  Further columns go to ``metadata``."""
    lines = Path(path).read_text(encoding="utf-8").splitlines()
    if not lines:
        raise InputError("line 1: the manifest is empty")
    header = [x.strip() for x in lines[0].split("\t")]
    if len(set(header)) < len(header) or not set(MANIFEST_REQUIRED) <= set(header):
        raise InputError("line 1: columns repeat, or sample and contigs are missing")
    out, seen = [], set()
    base = Path(path).resolve().parent
    for k, line in enumerate(lines[1:], 2):
        if not line.strip():
            continue
        values = [x.strip() for x in line.split("\t")]
        if len(values) > len(header):
            raise InputError(f"line {k}: more fields than columns")
        row = dict(zip(header, values + [""] * (len(header) - len(values))))
        if not all(row[x] for x in MANIFEST_REQUIRED):
            raise InputError(f"line {k}: sample and contigs are required")
        if row["sample"] in seen:
            raise InputError(f"line {k}: sample {row['sample']} occurs twice")
        seen.add(row["sample"])
        place = lambda x: str((base / Path(x).expanduser()).resolve()) if x else None
        known = {"sample": row["sample"], "contigs": place(row["contigs"]), "bam": place(row.get("bam")), "technology": row.get("technology") or None, "assembly_graph": place(row.get("assembly_graph"))}
        out.append(known | {"metadata": {x: row[x] for x in header if x not in MANIFEST_REQUIRED + MANIFEST_OPTIONAL}})
    if not out:
        raise InputError("the manifest names no sample")
    return sorted(out, key=lambda r: r["sample"])


def scan_samples(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """All samples' sequences in one scan: the columns of ``read_fasta``, samples named by the file a record lies in.

    The manifest is a control table on the driver, a row a sample; it meets the
    records by broadcast.  A file that two samples name is read once and gives
    its records to both.
    """
    if not manifest:
        raise InputError("the manifest names no sample")
    resolved = spark._jvm.org.apache.hadoop.fs.Path
    plain = lambda c: F.regexp_replace(c, r"^[a-zA-Z0-9+.-]+:(//[^/]*)?", "")
    named = spark.createDataFrame([(resolved(r["contigs"]).toUri().getRawPath(), r["sample"]) for r in manifest], "_path string, source_sample string")
    found = _records(spark, sorted({r["contigs"] for r in manifest})).withColumn("_path", plain("file"))
    met = found.join(F.broadcast(named), "_path")
    return met.select(F.concat_ws(":", "source_sample", "original_identifier").alias("identifier"), "source_sample", "original_identifier", "description", "sequence", "source_ordinal")


def load_samples(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """All samples' sequences; raises on the first errors found."""
    out = scan_samples(spark, manifest)
    bad = fasta_errors(out).limit(5).collect()
    if bad:
        raise InputError("; ".join(f"{r['identifier']}: {r['error']}" for r in bad))
    return out


def scale_sequences(spark: SparkSession, n: int, length: int) -> DataFrame:
    """``n`` generated sequences: the bytes of SHA-256 of ``contig-<i>`` as bases, each repeated, cut to ``length``."""
    times = (length + 31) // 32
    digits = F.expr("regexp_extract_all(sha2(concat('contig-', id), 256), '..', 0)")
    base = lambda b: F.repeat(F.substring(F.lit("ACGT"), F.pmod(F.conv(b, 16, 10).cast("int"), F.lit(4)) + 1, 1), times)
    name = F.concat(F.lit("contig-"), F.col("id"))
    return spark.range(n).select(
        name.alias("identifier"), F.lit("scale").alias("source_sample"), name.alias("original_identifier"),
        F.substring(F.array_join(F.transform(digits, base), ""), 1, length).alias("sequence"), F.lit(0).alias("source_ordinal"),
    )


#: Hexadecimal digits that a step of the search for a rank looks at; rows that are ordered in one task at most.
RANK_DIGITS, MOST_ORDERED = 3, 100_000


def nested_sample(sources: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The ``n`` sources of lowest seeded rank; a larger ``n`` holds every smaller one.

    The rank is the SHA-256 of the seed, NUL and the identifier.  A histogram
    over its first digits finds the bucket in which the last chosen one lies;
    rows of lower buckets all stay, and only that bucket, halved further while
    it is large, is ordered.  Repeated identifiers and fewer than ``n`` sources
    raise an InputError (``repeated_identifiers`` lists the former).
    """
    if n < 1:
        raise InputError("a sample has one source at least")
    ranked = sources.withColumn("_rank", F.sha2(F.concat_ws("\0", F.lit(str(seed)), "identifier"), 256))
    if not repeated_identifiers(sources).isEmpty():
        raise InputError("identifiers repeat")
    prefix, missing = "", n
    while True:
        digits = len(prefix) + RANK_DIGITS
        sizes = ranked.where(F.col("_rank").startswith(prefix)).groupBy(F.substring("_rank", 1, digits).alias("bucket")).count().collect()
        if not prefix and sum(r["count"] for r in sizes) < n:
            raise InputError(f"{n} sources are asked for, there are fewer")
        for row in sorted(sizes, key=lambda r: r["bucket"]):
            if row["count"] > missing:
                break
            missing -= row["count"]
            if missing == 0:
                return ranked.where(F.substring("_rank", 1, digits) <= row["bucket"]).drop("_rank")
        prefix = row["bucket"]
        if row["count"] <= MOST_ORDERED or digits >= 60:
            below = ranked.where(F.substring("_rank", 1, digits) < prefix)
            edge = ranked.where(F.col("_rank").startswith(prefix)).orderBy("_rank").limit(missing)
            return below.unionByName(edge).drop("_rank")


def repeated_identifiers(sources: DataFrame) -> DataFrame:
    """``identifier, count`` of identifiers that occur more than once."""
    return sources.groupBy("identifier").count().where("count > 1")
