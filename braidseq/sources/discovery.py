"""Manifests from folders: assemblies and the files that belong to them, found by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import InputError

#: The suffixes of each kind of file (case is ignored), and the columns of a manifest.
SUFFIXES = {
    "contigs": r"(?i)\.(fasta|fa|fna|fas|fsa)(\.gz)?$",
    "assembly_graph": r"(?i)\.gfa(\.gz)?$",
    "bam": r"(?i)\.(bam|cram)$",
}
MANIFEST_COLUMNS = ["sample", "contigs", "bam", "technology", "assembly_graph"]
_WHAT = {"contigs": "multiple FASTA files", "bam": "multiple alignment files", "assembly_graph": "multiple assembly graph files"}


def discover_samples(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """``sample, contigs, bam, technology, assembly_graph, index, warning, error``: one row a FASTA stem under ``folder``.

    Files belong together if their names without suffix are equal, case
    ignored.  Several files of one kind are an ``error`` of the sample (null: none);
    an alignment without an index beside it is a ``warning``.  Only names are
    read, by Spark's own reader, so ``folder`` may lie in any store.
    """
    c = F.col
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    if not recursive:
        top = F.regexp_replace(F.lit(folder.rstrip("/")), "^[a-z]+:/+", "/")
        files = files.where(F.regexp_replace(F.regexp_replace("path", "/[^/]*$", ""), "^[a-z]+:/+", "/") == top)
    kind, stem = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, suffix in SUFFIXES.items():
        kind = F.when(c("name").rlike(suffix), name).otherwise(kind)
        stem = F.when(c("name").rlike(suffix), F.trim(F.regexp_replace("name", suffix, ""))).otherwise(stem)
    typed = files.select("path", kind.alias("kind"), stem.alias("stem")).where("stem <> ''")
    of = lambda name: F.when(c("kind") == name, c("path"))
    grouped = typed.groupBy(F.lower("stem").alias("key")).agg(
        F.min(F.when(c("kind") == "contigs", F.struct("stem", "path"))).alias("own"), *[F.min(of(x)).alias(x) for x in ("bam", "assembly_graph")], *[F.count(of(x)).alias(f"n_{x}") for x in SUFFIXES]
    ).where("n_contigs > 0")
    names = F.when(c("bam").rlike(r"(?i)\.bam$"), ".bai").otherwise(".crai")
    beside = files.where(c("name").rlike(r"\.(bai|crai)$")).select(c("path").alias("index"))
    wanted = grouped.select("key", F.posexplode(F.array(F.concat("bam", names), F.concat(F.regexp_replace("bam", r"\.[^.]*$", ""), names))).alias("place", "index"))
    index = wanted.join(beside, "index", "left_semi").groupBy("key").agg(F.min(F.struct("place", "index")).alias("first")).select("key", "first.index")
    errors = F.concat_ws("; ", *[F.when(c(f"n_{x}") > 1, what) for x, what in _WHAT.items()])
    return grouped.join(index, "key", "left").select(
        c("own.stem").alias("sample"), c("own.path").alias("contigs"), "bam", F.lit(None).cast("string").alias("technology"), "assembly_graph", "index",
        F.when(c("bam").isNotNull() & c("index").isNull(), "no adjacent BAM/CRAM index found").alias("warning"), F.when(errors != "", errors).alias("error"),
    )


def manifest_lines(samples: DataFrame, base: str) -> DataFrame:
    """``value``: the manifest of ``discover_samples`` as tab-separated lines in order of sample, header first; paths under ``base`` become relative to it.

    Raises ``InputError`` on samples with errors, and if there are none at all.
    """
    bad = samples.where("error is not null").select("sample", "error").limit(5).collect()
    if bad:
        raise InputError("; ".join(f"{r['sample']}: {r['error']}" for r in bad))
    if samples.isEmpty():
        raise InputError("no FASTA files found")
    plain = lambda x: F.regexp_replace(x, "^[a-z]+:/+", "/")
    root = base.rstrip("/") + "/"
    short = lambda x: F.coalesce(F.when(plain(x).startswith(root), F.substr(plain(x), F.lit(len(root) + 1))).otherwise(F.col(x)), F.lit(""))
    rows = samples.select(F.lower("sample").alias("o"), F.concat_ws("\t", "sample", short("contigs"), short("bam"), F.coalesce("technology", F.lit("")), short("assembly_graph")).alias("value"))
    head = samples.sparkSession.range(1).select(F.lit("").alias("o"), F.lit("\t".join(MANIFEST_COLUMNS)).alias("value"))
    return head.unionByName(rows).orderBy("o", "value").select("value")
