"""Text sources, sinks, and the streaming catalogue."""

import gzip

import pytest

from braidseq.config import InputError
from braidseq.operators.catalogue import catalogue_sequences
from braidseq.operators import evidence, planning
from braidseq.sources import alignments, sequences, sinks, truth
from braidseq.streaming.catalogue import read_catalogue, stream_sources

FASTA = ">one first > contig\nacgt\r\nAC GT\n>two\nNNRY\n"


@pytest.mark.parametrize("suffix", ["fa", "fa.gz"])
def test_fasta(spark, tmp_path, suffix):
    path = tmp_path / f"x.{suffix}"
    path.write_bytes(gzip.compress(FASTA.encode()) if suffix.endswith("gz") else FASTA.encode())
    rows = {r["original_identifier"]: r for r in sequences.read_fasta(spark, str(path), "s1").collect()}
    assert rows["one"]["sequence"] == "ACGTACGT" and rows["one"]["description"] == "first > contig" and rows["two"]["identifier"] == "s1:two"
    assert sequences.fasta_errors(sequences.read_fasta(spark, str(path), "s1")).count() == 0


def test_fasta_errors(spark, tmp_path):
    path = tmp_path / "bad.fa"
    path.write_text(">a\nAC-T\n>a\nAC\n>b\n\n>\nAC\n")
    assert {r["error"] for r in sequences.fasta_errors(sequences.read_fasta(spark, str(path))).collect()} == {"illegal symbol", "duplicate identifier", "empty sequence", "empty header"}


def test_fastq(spark, tmp_path):
    path = tmp_path / "x.fq"
    path.write_text("@r1 x\nACGT\n+\nII@I\n@r2\nAC\n+\nIII\n")
    rows = {r["name"]: r["error"] for r in sequences.read_fastq(spark, str(path)).collect()}
    assert rows == {"r1": None, "r2": "sequence and quality differ in length"}


def test_manifest(spark, tmp_path):
    (tmp_path / "a.fa").write_text(FASTA)
    (tmp_path / "m.tsv").write_text("sample\tcontigs\tsite\nz\ta.fa\tlake\nb\ta.fa\t\n")
    rows = sequences.read_manifest(str(tmp_path / "m.tsv"))
    assert [r["sample"] for r in rows] == ["b", "z"] and rows[1]["metadata"] == {"site": "lake"}
    assert sequences.load_samples(spark, rows).count() == 4
    (tmp_path / "m.tsv").write_text("sample\tcontigs\nz\ta.fa\nz\ta.fa\n")
    with pytest.raises(InputError, match="line 3"):
        sequences.read_manifest(str(tmp_path / "m.tsv"))


def test_paf_and_sam(spark, tmp_path):
    path = tmp_path / "x.paf"
    path.write_text("q\t10\t0\t10\t+\tt\t20\t5\t15\t10\t10\t60\ttp:A:P\tAS:i:7\n\nq\t10\t0\nq\t1\t0\t1\t*\tt\t2\t0\t1\t1\t1\t0\n")
    rows = alignments.read_paf(spark, str(path)).collect()
    assert sorted(str(r["error"]) for r in rows) == ["None", "fewer than twelve fields", "orientation"]
    good = next(r for r in rows if r["error"] is None)
    assert good["alignment_type"] == "P" and good["alignment_score"] == 7 and good["target_start"] == 5
    sam = tmp_path / "x.sam"
    sam.write_text("@SQ\tSN:r\tLN:9\nn1\t0\tr\t3\t60\t4M\t*\t0\t0\tACGT\tIIII\nn2\t256\tr\t3\t60\t4M\t*\t0\t0\tACGT\tIIII\n")
    assert [(r["name"], r["position"]) for r in alignments.read_sam(spark, str(sam)).collect()] == [("n1", 2)]
    assert [tuple(r) for r in alignments.sam_references(spark, str(sam)).collect()] == [("r", 9)]


def test_sinks(spark):
    outputs = spark.createDataFrame([("b", "A" * 160), ("a", "C" * 81)], "output_sequence string, sequence string")
    assert [r["value"] for r in sinks.fasta_lines(outputs).collect()] == [">a\n" + "C" * 80 + "\nC", ">b\n" + "A" * 80 + "\n" + "A" * 80]
    edges = spark.createDataFrame([("e", "overlap", "a", "b", "TARGET_SUFFIX_TO_QUERY_PREFIX", "+", 9)], "edge_id string, kind string, query_id string, target_id string, relationship_type string, orientation string, aligned_length int")
    assert sinks.gfa_lines(outputs, edges).collect()[-1]["value"] == "L\ta\t-\tb\t-\t9M"


def test_streamed_catalogue_equals_batch(spark, tmp_path):
    schema = "identifier string, source_sample string, original_identifier string, sequence string, source_ordinal int"
    rows = [("s:1", "s", "1", "AACC", 0), ("s:2", "s", "2", "GGTT", 1), ("t:1", "t", "1", "AAAA", 0)]
    for k, row in enumerate(rows):
        spark.createDataFrame([row], schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_sources(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    want = catalogue_sequences(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, read_catalogue(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))


def test_scale_sequences_have_the_published_counters(spark):
    got = {r["identifier"]: r["sequence"] for r in sequences.scale_sequences(spark, 3, 100).collect()}
    import hashlib

    for i in range(3):
        assert got[f"contig-{i}"] == "".join("ACGT"[b % 4] * 4 for b in hashlib.sha256(f"contig-{i}".encode()).digest())[:100]


def test_truth_tables(spark, tmp_path):
    path = tmp_path / "t.tsv"
    row = lambda q, status="VALID", start="0": "\t".join([q, "t", "EXACT_MATCH", ".", status, "true", "10", "100.0", start, "10", "0", "10", "", f"case_{q}", "why"])
    path.write_text("\n".join(["\t".join(truth.RELATIONSHIP_COLUMNS), row("a"), row("b", "ODD"), row("c", start="x"), row("d"), row("d"), row("e", start="11")]) + "\n")
    rows = truth.read_relationship_truth(spark, str(path)).collect()
    assert sorted((r["query_id"], r["error"]) for r in rows if r["error"]) == [("b", "status"), ("c", "a value is malformed"), ("d", "repeated pair"), ("d", "repeated pair"), ("e", "interval")]
    assert next(r for r in rows if r["query_id"] == "a")["expected_orientation"] is None
    path.write_text("\n".join(["\t".join(truth.JUNCTION_COLUMNS), "c1\ta\tb\ttrue\t5\tfalse\t3\t2\tyes\twhy", "c2\ta\tc\ttrue\t-5\tfalse\t3\t2\tyes\twhy"]) + "\n")
    assert [(r["case_id"], r["error"]) for r in truth.read_junction_truth(spark, str(path)).orderBy("case_id").collect()] == [("c1", None), ("c2", "a number is negative")]
    path.write_text("case_id\n")
    with pytest.raises(InputError, match="expected"):
        truth.read_junction_truth(spark, str(path))


def test_paf_as_evidence(spark, tmp_path):
    path = tmp_path / "e.paf"
    line = lambda name, end, *tags: "\t".join([name, "10", "0", "10", "+", "t", "90", "5", str(end), "10", "10", "60", *tags])
    path.write_text("\n".join([line("a", 15, "tp:A:P", "cg:Z:10M"), line("b", 15, "tp:A:S", "cg:Z:10M"), line("c", 16, "tp:A:P", "cg:Z:10M"), line("d", 15, "tp:A:P")]) + "\n")
    rows = {r["name"]: r for r in evidence.paf_evidence(alignments.read_paf(spark, str(path))).collect()}
    assert {k: r["error"] for k, r in rows.items()} == {"a": None, "c": "CIGAR and coordinates differ", "d": "no CIGAR"}
    assert [tuple(b) for b in rows["a"]["blocks"]] == [(5, 15)]


def test_plan_errors_and_batches(spark, monkeypatch):
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "b"), ("b", "z")], "query_id string, target_id string")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "sequence_id string")
    assert sorted(r["error"] for r in planning.plan_errors(pairs, known).collect()) == ["not in order", "repeated pair", "unknown target_id"]
    monkeypatch.setattr(planning, "NUMBERED_TOGETHER", 10)
    many = spark.range(45).selectExpr("concat('q', id) AS query_id", "'t' AS target_id")
    sizes = planning.alignment_batches(many, 4).groupBy("target_id", "part", "batch").count().collect()
    assert sum(r["count"] for r in sizes) == 45 and max(r["count"] for r in sizes) <= 4
    assert planning.alignment_batches(many.limit(0), 4).count() == 0


def test_fastq_qualities_may_begin_with_the_sign(spark, tmp_path):
    path = tmp_path / "r.fq"
    path.write_text("@a x\nAC\n+\n@I\n@b\nACG\n+b\nII\n@c\nA\n+\nI\n@c\nA\n+\nI\n@d\nA\n")
    rows = sorted((r["line"], r["name"], r["quality"], r["error"]) for r in sequences.read_fastq(spark, str(path)).collect())
    assert [r[:2] for r in rows] == [(1, "a"), (5, "b"), (9, "c"), (13, "c"), (17, "d")]
    assert [r[3] for r in rows] == [None, "sequence and quality differ in length", "repeated name", "repeated name", "incomplete record"] and rows[0][2] == "@I"


def test_fasta_data_before_the_first_header(spark, tmp_path):
    (tmp_path / "a.fa").write_text("ACGT\n>x one\nAC\nGT\n>y\nA\n")
    rows = sequences.read_fasta(spark, str(tmp_path / "a.fa"))
    assert {(r["original_identifier"], r["sequence"]) for r in rows.collect()} == {("", "ACGT"), ("x", "ACGT"), ("y", "A")}
    assert [r["error"] for r in sequences.fasta_errors(rows).collect()] == ["data before header"]


def test_publication_midway_leaves_the_last_run(spark, tmp_path):
    from pyspark.sql import functions as F

    from braidseq.sources.sinks import publish, published

    one = {"a": spark.range(3), "b": spark.range(5)}
    publish(one, str(tmp_path), "b")
    bad = {"a": spark.range(9), "b": spark.range(1).select(F.raise_error(F.lit("no")).cast("long").alias("id"))}
    with pytest.raises(Exception):
        publish(bad, str(tmp_path), "b")
    assert published(spark, str(tmp_path), "a").count() == 3 and published(spark, str(tmp_path), "b").count() == 5
    publish({"a": spark.range(7), "b": spark.range(8)}, str(tmp_path), "b")
    assert published(spark, str(tmp_path), "a").count() == 7


def test_samples_are_discovered_by_name(spark, tmp_path):
    from braidseq.sources import discovery

    (tmp_path / "sub").mkdir()
    for name in ("B.fa", "a.FASTA.gz", "b.gfa", "A.bam", "A.bam.bai", "sub/c.fna", "sub/c.cram", "notes.txt", ".fa"):
        (tmp_path / name).write_text("x")
    found = discovery.discover_samples(spark, str(tmp_path))
    rows = {r["sample"]: r for r in found.collect()}
    assert sorted(rows) == ["B", "a", "c"] and not any(r["error"] for r in rows.values())
    assert rows["a"]["index"].endswith("/A.bam.bai") and rows["a"]["warning"] is None and rows["c"]["warning"] and rows["B"]["assembly_graph"].endswith("/b.gfa")
    assert {r["sample"] for r in discovery.discover_samples(spark, str(tmp_path), recursive=False).collect()} == {"B", "a"}
    lines = [r["value"] for r in discovery.manifest_lines(found, str(tmp_path)).collect()]
    assert lines == ["sample\tcontigs\tbam\ttechnology\tassembly_graph", "a\ta.FASTA.gz\tA.bam\t\t", "B\tB.fa\t\t\tb.gfa", "c\tsub/c.fna\tsub/c.cram\t\t"]
    (tmp_path / "sub" / "b.fsa").write_text("x")
    with pytest.raises(InputError, match="multiple FASTA"):
        discovery.manifest_lines(discovery.discover_samples(spark, str(tmp_path)), str(tmp_path))
