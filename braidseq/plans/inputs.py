"""The driver tables as sequences, tiles and hits; each with the DuckDB text that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import text_as_sequence, turned_where

TILE_LENGTH, TILE_STRIDE = 3000, 2000
PIECE_LENGTH = 1500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sequences; those with odd ids on the other strand."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", text_as_sequence(F.col("text")).alias("s"))
    return rows.select(
        F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("identifier"), F.col("source").alias("source_sample"), F.col("doc_id").cast("string").alias("original_identifier"),
        turned_where("s", F.col("doc_id") % 2 == 1).alias("sequence"), F.lit(0).alias("source_ordinal"),
    )


def _cut(spark: SparkSession, sf_dir: str, length: int, stride: int, altered: bool = False) -> DataFrame:
    """Every letter of every document: pieces of ``length`` every ``stride``, the last one to the document's end; every other one on the other strand.

    With ``altered`` each 60th letter of every other piece is A, so overlaps are near but not exact.
    """
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", text_as_sequence(F.col("text")).alias("s"))
    rows = rows.withColumn("last", F.expr(f"greatest(0, cast((length(s) - {length}) div {stride} as int))"))
    cut = rows.select("doc_id", "source", "s", "last", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("i"))
    # Letters are ASCII: a slice of the binary form costs its own length, wherever it begins.
    piece = F.expr(f"cast(substring(cast(s as binary), i * {stride} + 1, if(i = last, length(s), {length})) as string)")
    if altered:
        piece = F.when(F.col("i") % 2 == 1, F.regexp_replace(piece, "(.{59}).", "$1A")).otherwise(piece)
    cut = cut.select("doc_id", "source", "i", piece.alias("piece"))
    return cut.select(
        F.concat_ws(":", "source", F.col("doc_id").cast("string"), F.col("i").cast("string")).alias("identifier"), F.col("source").alias("source_sample"),
        F.concat_ws(":", F.col("doc_id").cast("string"), F.col("i").cast("string")).alias("original_identifier"),
        turned_where("piece", F.col("i") % 2 == 1).alias("sequence"), F.col("i").alias("source_ordinal"),
    )


def document_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in overlapping tiles."""
    return _cut(spark, sf_dir, TILE_LENGTH, TILE_STRIDE)


def altered_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in overlapping tiles of which every other one has other letters here and there."""
    return _cut(spark, sf_dir, TILE_LENGTH, TILE_STRIDE, altered=True)


def documents_and_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whole, and again in pieces that lie end to end: so there are containments, of one container or of several."""
    return contigs(spark, sf_dir).unionByName(_cut(spark, sf_dir, PIECE_LENGTH, PIECE_LENGTH))


def documents_and_gapped_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whole, and again in pieces that lie end to end; of a piece of more than 1000 letters every other one lacks five letters, the others have seven more."""
    pieces = _cut(spark, sf_dir, PIECE_LENGTH, PIECE_LENGTH)
    lacking, more = F.expr("concat(left(sequence, 700), substring(sequence, 706))"), F.expr("concat(left(sequence, 800), 'ACGTTGA', substring(sequence, 801))")
    altered = F.when(F.length("sequence") <= 1000, F.col("sequence")).when(F.col("source_ordinal") % 2 == 1, lacking).otherwise(more)
    return contigs(spark, sf_dir).unionByName(pieces.withColumn("sequence", altered))


def documents_and_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whole, and again in overlapping tiles: containments and overlaps in one component."""
    return contigs(spark, sf_dir).unionByName(document_tiles(spark, sf_dir))


_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
_S0 = "translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"

CONTIGS_SQL = f"""contigs AS (
  SELECT source || ':' || doc_id AS identifier, source AS source_sample, doc_id::VARCHAR AS original_identifier,
         CASE WHEN doc_id % 2 = 1 THEN {_RC.format('s')} ELSE s END AS sequence
  FROM (SELECT doc_id, source, {_S0} AS s FROM documents)
)"""

def _cut_sql(length: int, stride: int, altered: bool = False) -> str:
    piece = "CASE WHEN i % 2 = 1 THEN regexp_replace(plain, '(.{59}).', '\\1A', 'g') ELSE plain END" if altered else "plain"
    return f"""SELECT source || ':' || doc_id || ':' || i AS identifier, source AS source_sample, doc_id || ':' || i AS original_identifier,
         CASE WHEN i % 2 = 1 THEN {_RC.format('piece')} ELSE piece END AS sequence, i AS source_ordinal
  FROM (SELECT *, {piece} AS piece FROM (SELECT *, substr(s, i * {stride} + 1, CASE WHEN i = last THEN length(s) ELSE {length} END) AS plain
        FROM (SELECT *, unnest(range(last + 1)) AS i FROM (SELECT doc_id, source, s, greatest(0, (length(s) - {length}) // {stride}) AS last FROM (SELECT doc_id, source, {_S0} AS s FROM documents)))))"""


TILES_SQL = f"contigs AS ({_cut_sql(TILE_LENGTH, TILE_STRIDE)})"
ALTERED_SQL = f"contigs AS ({_cut_sql(TILE_LENGTH, TILE_STRIDE, altered=True)})"

def _with_whole(cut: str) -> str:
    return f"""{CONTIGS_SQL.replace('contigs AS', 'whole_documents AS', 1)}, contigs AS (
  SELECT identifier, source_sample, original_identifier, sequence, 0 AS source_ordinal FROM whole_documents UNION ALL {cut}
)"""


PIECES_SQL = _with_whole(_cut_sql(PIECE_LENGTH, PIECE_LENGTH))
WHOLE_AND_TILES_SQL = _with_whole(_cut_sql(TILE_LENGTH, TILE_STRIDE))

#: Hits folded out of line items, with geometry around every bound; the same text in both dialects.
HITS_SQL = """
SELECT query_id, target_id, ql AS query_length, qs AS query_start, qe AS query_end, orientation, tl AS target_length, ts AS target_start, te AS target_end,
       m AS matching_bases, b AS alignment_block_length, mapq AS mapping_quality
FROM (
  SELECT *, CASE WHEN kind = 7 THEN sp - CAST((sp - sp % 40) / 40 AS INT) - 1 WHEN kind IN (0, 6) THEN sp ELSE sp - x % 12 END AS m,
         CASE WHEN qe - qs > te - ts THEN qe - qs ELSE te - ts END AS b
  FROM (
    SELECT *, CASE WHEN qe - qs < te - ts THEN qe - qs ELSE te - ts END AS sp
    FROM (
      SELECT *,
        CASE WHEN kind = 3 THEN ql - 1000 - x % 40 WHEN kind = 5 THEN 200 WHEN kind = 2 THEN x WHEN kind = 6 THEN x ELSE 0 END AS qs,
        CASE WHEN kind IN (0, 1) THEN ql WHEN kind = 3 THEN ql - e WHEN kind = 4 THEN 1000 + x % 40 WHEN kind = 5 THEN 1400 WHEN kind = 2 THEN CASE WHEN x + tl < ql THEN x + tl ELSE ql END
             WHEN kind = 6 THEN x + 300 ELSE ql - e END AS qe,
        CASE WHEN kind = 3 THEN e WHEN kind = 4 THEN tl - 1000 - x % 40 WHEN kind = 5 THEN 300 WHEN kind = 1 THEN x WHEN kind = 6 THEN x ELSE 0 END AS ts,
        CASE WHEN kind IN (0, 2) THEN tl WHEN kind = 3 THEN 1000 + x % 40 WHEN kind = 4 THEN tl - e WHEN kind = 5 THEN 1500 WHEN kind = 1 THEN CASE WHEN x + ql < tl THEN x + ql ELSE tl END
             WHEN kind = 6 THEN x + 300 ELSE tl - e END AS te
      FROM (
        SELECT concat('q', CAST(l_orderkey % 1500 AS STRING)) AS query_id, concat('t', CAST(l_partkey % 40 AS STRING)) AS target_id,
               CAST(2000 + 500 * (l_orderkey % 3) AS INT) AS ql, CAST(2000 + 500 * (l_partkey % 40 % 4) AS INT) AS tl,
               CAST((l_orderkey % 1500 + l_partkey % 40) % 8 AS INT) AS kind,
               CAST(CASE WHEN l_suppkey % 11 = 0 THEN (l_linenumber * 31) % 90 ELSE (l_partkey % 40) * 2 END AS INT) AS x,
               CAST((l_orderkey % 29) * 2 AS INT) AS e,
               CASE WHEN (l_orderkey % 2 = 0) <> (l_suppkey % 17 = 0) THEN '+' ELSE '-' END AS orientation,
               CAST(l_linenumber * 8 AS INT) AS mapq
        FROM lineitem
      ) AS h0
    ) AS h1
  ) AS h2
) AS h3
"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(HITS_SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def _unfolded(text: str) -> str:
    for folded, own in (("CAST(l_orderkey % 1500 AS STRING)", "CAST(l_orderkey AS STRING)"), ("CAST(l_partkey % 40 AS STRING)", "CAST(l_partkey AS STRING)")):
        if text.count(folded) != 1:
            raise ValueError(f"HITS_SQL has no single {folded}")
        text = text.replace(folded, own)
    return text


#: ``HITS_SQL`` with an id for each order and each part, so the graph grows with the table.
UNFOLDED_HITS_SQL = _unfolded(HITS_SQL)


def unfolded_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(UNFOLDED_HITS_SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
