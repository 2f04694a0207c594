"""Queries of provisional junctions over every document, with their DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import reverse_complement, text_as_sequence
from ..operators import junctions
from ..session import pin
from .inputs import _RC, _S0, TILE_LENGTH, TILE_STRIDE, table
from .queries import query

OVERLAP = TILE_LENGTH - TILE_STRIDE
#: Reads of a true junction, bases that must lie on both sides of it.
READS, FLANK = 8, 100


def _tiles(spark, sf_dir) -> DataFrame:
    """``doc_id, i, last, identifier, sequence``: every document forward, in tiles that overlap."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", text_as_sequence(F.col("text")).alias("s"))
    rows = rows.withColumn("last", F.expr(f"greatest(0, cast((length(s) - {TILE_LENGTH}) div {TILE_STRIDE} as int))"))
    cut = rows.select("doc_id", "source", "s", "last", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("i"))
    piece = F.expr(f"substring(s, i * {TILE_STRIDE} + 1, if(i = last, length(s), {TILE_LENGTH}))")
    return cut.select("doc_id", "i", "last", F.concat_ws(":", "source", F.col("doc_id").cast("string"), F.col("i").cast("string")).alias("identifier"), piece.alias("sequence"))


def _tables(spark, sf_dir) -> dict[str, DataFrame]:
    """Truth: each tile and the next one of its document, and each document's last tile with the first of the next document.

    Some relationships are of another type or occur twice, and some expected
    sequences are altered or there where none should be.
    """
    tiles = pin(_tiles(spark, sf_dir))
    c = F.col
    left = tiles.select("doc_id", "i", "last", c("identifier").alias("left_contig"))
    following = tiles.select("doc_id", (c("i") - 1).alias("i"), c("identifier").alias("right_contig"))
    true = left.join(following, ["doc_id", "i"]).select(F.concat_ws(":", F.lit("true"), c("doc_id").cast("string"), c("i").cast("string")).alias("case_id"), "doc_id", "left_contig", "right_contig", F.lit(True).alias("junction_is_true"))
    heads = tiles.where("i = 0").select((c("doc_id") - 1).alias("doc_id"), c("identifier").alias("right_contig"))
    artificial = left.where("i = last").join(heads, "doc_id").select(F.concat_ws(":", F.lit("artificial"), c("doc_id").cast("string")).alias("case_id"), "doc_id", "left_contig", "right_contig", F.lit(False).alias("junction_is_true"))
    truth = pin(true.unionByName(artificial))
    copies = F.when(c("doc_id") % 13 == 0, 2).otherwise(1)
    relationships = truth.select(
        "case_id", c("left_contig").alias("query_id"), c("right_contig").alias("target_id"),
        F.when(c("doc_id") % 11 == 0, "QUERY_CONTAINED_IN_TARGET").otherwise(junctions.JOINING).alias("relationship_type"), F.lit("+").alias("orientation"),
        F.lit(OVERLAP).alias("target_end"), F.explode(F.sequence(F.lit(1), copies)).alias("copy"),
    ).drop("copy")
    sequences = tiles.select("identifier", "sequence")
    sides = truth.join(sequences.withColumnRenamed("identifier", "left_contig").withColumnRenamed("sequence", "ls"), "left_contig").join(sequences.withColumnRenamed("identifier", "right_contig").withColumnRenamed("sequence", "rs"), "right_contig")
    merged = F.concat("ls", F.expr(f"substring(rs, {OVERLAP} + 1)"))
    altered = F.when(c("doc_id") % 17 == 0, F.concat(merged, F.lit("A"))).otherwise(merged)
    expected = sides.where(c("junction_is_true") | (c("doc_id") % 19 == 0)).select("case_id", altered.alias("sequence"))
    return {"truth": truth, "relationships": relationships, "sequences": sequences, "expected": expected}


def _references(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t = _tables(spark, sf_dir)
    return junctions.provisional_references(t["truth"], t["relationships"], t["sequences"], t["expected"])


@query
def provisional_references(spark, sf_dir):
    built, _ = _references(spark, sf_dir)
    return built.select("case_id", "junction", F.length("sequence").alias("length"), F.md5("sequence").alias("sequence_md5"))


@query
def junction_violations(spark, sf_dir):
    return _references(spark, sf_dir)[1]


@query
def control_reads(spark, sf_dir):
    t = _tables(spark, sf_dir)
    reads, _ = junctions.negative_controls(t["truth"], t["relationships"], t["sequences"])
    return reads.select("case_id", "name", F.length("sequence").alias("length"), F.md5("sequence").alias("sequence_md5"))


@query
def control_violations(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return junctions.negative_controls(t["truth"], t["relationships"], t["sequences"])[1]


@query
def junction_remapping(spark, sf_dir):
    """Reads cut around each true junction, every other one on the other strand, and the control reads of the artificial ones, mapped to their references."""
    t = _tables(spark, sf_dir)
    built = pin(junctions.provisional_references(t["truth"], t["relationships"], t["sequences"], t["expected"])[0])
    controls, _ = junctions.negative_controls(t["truth"], t["relationships"], t["sequences"])
    cut = built.where("junction_is_true").select("case_id", "junction", "sequence", F.explode(F.sequence(F.lit(0), F.lit(READS - 1))).alias("k"))
    part = F.expr("substring(sequence, junction - 650 + 130 * k + 1, 400 + 50 * k)")
    true = cut.select("case_id", F.concat(F.lit("read"), F.col("k").cast("string")).alias("name"), F.when(F.col("k") % 2 == 1, reverse_complement(part)).otherwise(part).alias("sequence"))
    reads = true.unionByName(controls.select("case_id", "name", "sequence"))
    found = junctions.remapping_evidence(built, reads, FLANK)
    return found.drop("minimum_flank", "minimum_mapping_quality")


_CASES = f"""tiles AS (
  SELECT doc_id, i, last, source || ':' || doc_id || ':' || i AS identifier, substr(s, i * {TILE_STRIDE} + 1, CASE WHEN i = last THEN length(s) ELSE {TILE_LENGTH} END) AS sequence
  FROM (SELECT *, unnest(range(last + 1)) AS i FROM (SELECT doc_id, source, s, greatest(0, (length(s) - {TILE_LENGTH}) // {TILE_STRIDE}) AS last FROM (SELECT doc_id, source, {_S0} AS s FROM documents)))
), cases AS (
  SELECT 'true:' || a.doc_id || ':' || a.i AS case_id, a.doc_id, a.sequence AS ls, b.sequence AS rs, true AS is_true FROM tiles a JOIN tiles b ON b.doc_id = a.doc_id AND b.i = a.i + 1
  UNION ALL
  SELECT 'artificial:' || a.doc_id, a.doc_id, a.sequence, b.sequence, false FROM tiles a JOIN tiles b ON b.doc_id = a.doc_id + 1 AND a.i = a.last AND b.i = 0
), judged AS (
  SELECT *, ls || substr(rs, {OVERLAP} + 1) AS sequence,
    CASE WHEN doc_id % 13 = 0 THEN 'not exactly one ordered relationship' WHEN doc_id % 11 = 0 THEN 'not a forward suffix-to-prefix relationship'
         WHEN length(rs) < {OVERLAP} THEN 'the overlap ends outside the right sequence' END AS early
  FROM cases
), expected AS (
  SELECT *, coalesce(early, CASE WHEN is_true AND doc_id % 17 = 0 THEN 'not the expected merged sequence' WHEN NOT is_true AND doc_id % 19 = 0 THEN 'an artificial junction has an expected sequence' END) AS reason FROM judged
), controls AS (
  SELECT *, least({junctions.CONTROL_BASES}, length(ls), length(rs) - {OVERLAP}) AS n FROM judged WHERE NOT is_true AND early IS NULL
), control_reads AS (
  SELECT case_id, case_id || ':left-end' AS name, right(ls, n) AS sequence FROM controls WHERE n >= {junctions.LEAST_CONTROL}
  UNION ALL SELECT case_id, case_id || ':right-after-overlap', substr(rs, {OVERLAP} + 1, n) FROM controls WHERE n >= {junctions.LEAST_CONTROL}
)"""

SQL = {
    "provisional_references": f"WITH {_CASES} SELECT case_id, length(ls) AS junction, length(sequence) AS length, md5(sequence) AS sequence_md5 FROM expected WHERE reason IS NULL",
    "junction_violations": f"WITH {_CASES} SELECT case_id, reason FROM expected WHERE reason IS NOT NULL",
    "control_reads": f"WITH {_CASES} SELECT case_id, name, length(sequence) AS length, md5(sequence) AS sequence_md5 FROM control_reads",
    "control_violations": f"""WITH {_CASES} SELECT case_id, early AS reason FROM judged WHERE NOT is_true AND early IS NOT NULL
        UNION ALL SELECT case_id, 'too short for control reads' FROM controls WHERE n < {junctions.LEAST_CONTROL}""",
    "junction_remapping": f"""WITH {_CASES}, requests AS (
  SELECT case_id, length(ls) AS junction, sequence, is_true FROM expected WHERE reason IS NULL
), plain AS (
  SELECT *, substr(sequence, junction - 650 + 130 * k + 1, 400 + 50 * k) AS part FROM (SELECT *, unnest(range({READS})) AS k FROM requests WHERE is_true)
), reads AS (
  SELECT case_id, 'read' || k AS name, CASE WHEN k % 2 = 1 THEN {_RC.format('part')} ELSE part END AS read FROM plain UNION ALL SELECT case_id, name, sequence FROM control_reads
), placed AS (
  SELECT case_id, name, read, junction, coalesce(nullif(strpos(sequence, read), 0), strpos(sequence, {_RC.format('read')})) - 1 AS start FROM reads JOIN requests USING (case_id)
), spans AS (SELECT *, start <= junction - {FLANK} AND start + length(read) >= junction + {FLANK} AS over FROM placed
), counted AS (
  SELECT case_id, count(*) AS selected_reads, count(*) AS remapped_reads, count(*) FILTER (over) AS spanning_reads,
         sha256(coalesce(string_agg(name, chr(10) ORDER BY name) FILTER (over), '')) AS spanning_sha256
  FROM spans GROUP BY case_id
)
SELECT case_id, 'junction_' || case_id AS reference, length(sequence) AS reference_length, sha256(sequence) AS reference_sha256, junction, coalesce(selected_reads, 0) AS selected_reads,
       coalesce(remapped_reads, 0) AS remapped_reads, coalesce(spanning_reads, 0) AS spanning_reads, coalesce(spanning_sha256, sha256('')) AS spanning_sha256,
       CASE WHEN selected_reads IS NULL THEN '{junctions.NO_READS}' ELSE '{junctions.EVIDENCE_ONLY}' END AS diagnostics
FROM requests LEFT JOIN counted USING (case_id)""",
}
