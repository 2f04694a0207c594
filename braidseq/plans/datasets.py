"""Queries of edits, samples, validation and PAF text over whole tables, with their DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import hits as hit_operators
from ..operators import aligner, catalogue, evidence, minimisers, mutations, scoring, statistics, validation
from ..session import fresh_dir, pin, stored
from ..sources import alignments, sequences, sinks
from . import inputs
from .inputs import CONTIGS_SQL, table
from .junctions import _CASES, OVERLAP, _tiles
from .queries import CONFIG, _candidates, _packed, _sparse_truth, query

#: Places between edits, and what is inserted.
STRETCH, INSERTED = 100, "GATTACA"


def _edits(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every document with an edit in each stretch of 100 letters; some edits lie outside, occur twice or are of sequences that aren't there."""
    c = F.col
    whole = stored(inputs.contigs(spark, sf_dir).select("identifier", "sequence", c("original_identifier").cast("long").alias("doc_id")), "whole")
    k = whole.where(F.length("sequence") >= STRETCH).select("identifier", "sequence", "doc_id", F.explode(F.expr(f"sequence(0, length(sequence) div {STRETCH} - 1)")).alias("k"))
    at = (c("k") * STRETCH + (c("k") * 7 + c("doc_id")) % 50).cast("int")
    kind = F.element_at(F.array(F.lit(mutations.SUBSTITUTION), F.lit(mutations.INSERTION), F.lit(mutations.DELETION)), ((c("k") + c("doc_id")) % 3 + 1).cast("int"))
    rows = k.withColumn("position", at).withColumn("kind", kind)
    bases = F.when(c("kind") == mutations.SUBSTITUTION, F.expr("translate(cast(substring(cast(sequence as binary), position + 1, 1) as string), 'ACGT', 'CGTA')")).when(c("kind") == mutations.INSERTION, F.expr(f"left('{INSERTED}', cast(1 + k % 7 as int))"))
    made = rows.select("identifier", "position", "kind", (c("k") % 5 + 1).cast("int").alias("length"), bases.alias("bases"), "doc_id", "k")
    twice = made.where("doc_id % 11 = 0 and k = 0")
    outside = whole.where("doc_id % 10 = 0").select("identifier", (F.length("sequence") + 5).alias("position"), F.lit(mutations.DELETION).alias("kind"), F.lit(1).alias("length"), F.lit(None).cast("string").alias("bases"), "doc_id", F.lit(-1).alias("k"))
    unknown = outside.withColumn("identifier", F.concat(F.lit("x"), "identifier"))
    return whole.select("identifier", "sequence"), made.unionByName(twice).unionByName(outside).unionByName(unknown).drop("doc_id", "k")


@query
def mutated_sequences(spark, sf_dir):
    edited, _ = mutations.apply_edits(*_edits(spark, sf_dir))
    return edited.select("identifier", F.length("sequence").alias("length"), F.md5("sequence").alias("sequence_md5"))


@query
def mutation_truth(spark, sf_dir):
    """With ``holds``: whether the edited sequence has the new bases where the truth says."""
    edited, truth = mutations.apply_edits(*_edits(spark, sf_dir))
    met = truth.join(edited, "identifier")
    return met.select("identifier", "position", "kind", "old", "new", "edited_position", (F.expr("substring(sequence, edited_position + 1, length(new))") == F.col("new")).alias("holds"))


@query
def edit_errors(spark, sf_dir):
    return mutations.edit_errors(*_edits(spark, sf_dir))


@query
def nested_sample(spark, sf_dir):
    return sequences.nested_sample(inputs.contigs(spark, sf_dir), 100, 17).select("identifier")


@query
def validation_errors(spark, sf_dir):
    """Every document in tiles as a dataset, damaged here and there: the errors are what was planted."""
    c = F.col
    tiles = pin(_tiles(spark, sf_dir))
    first = c("i") == 0
    contigs = tiles.where(~(first & (c("doc_id") % 10 == 0))).select(
        "identifier", (F.length("sequence") + F.when(first & (c("doc_id") % 9 == 0), 1).otherwise(0)).alias("length"), (c("doc_id") % 8 == 0).alias("circular_wrap"),
        F.lit(0).alias("source_start"), (F.length("sequence") + F.when(c("doc_id") % 16 == 0, 1).otherwise(0)).alias("source_end"),
    )
    ghosts = tiles.where(first & (c("doc_id") % 14 == 0)).select(F.concat(F.lit("ghost:"), "identifier").alias("identifier"), F.lit(5).alias("length"), F.lit(False).alias("circular_wrap"), F.lit(0).alias("source_start"), F.lit(5).alias("source_end"))
    right = tiles.select("doc_id", (c("i") - 1).alias("i"), c("identifier").alias("target_id"), c("sequence").alias("t"))
    cases = pin(tiles.select("doc_id", "i", c("identifier").alias("query_id"), c("sequence").alias("q")).join(right, ["doc_id", "i"]).withColumn("case_id", F.concat_ws(":", F.lit("case"), c("doc_id").cast("string"), c("i").cast("string"))))
    other = c("i") % 4 == 3
    relationships = cases.select(
        "case_id", "query_id", F.when(c("doc_id") % 15 == 0, "gone").otherwise(c("target_id")).alias("target_id"), F.when(other, "EXACT_MATCH").otherwise(validation.MERGING).alias("relationship_type"),
        F.lit("+").alias("orientation"), F.lit(0).alias("target_start"), F.lit(OVERLAP).alias("target_end"), (~other).alias("merge_allowed"),
    )
    planted = cases.withColumn("n", (c("doc_id") % 5).cast("int"))
    found = planted.where("n > 0").select("case_id", F.explode(F.expr("sequence(1, n)")), F.lit("substitution").alias("kind")).select("case_id", "kind")
    expected = planted.select("case_id", F.lit("substitution").alias("kind"), (c("n") + F.when(c("doc_id") % 20 == 0, 1).otherwise(0)).alias("n"))
    merged = cases.where(~other & (c("doc_id") % 18 != 0)).select("case_id", F.concat("q", F.expr(f"substring(t, {OVERLAP} + 1)"), F.when(c("doc_id") % 12 == 0, "A").otherwise("")).alias("sequence"))
    extra = cases.where("i = 0 and doc_id % 25 = 0").select(F.concat(F.lit("extra:"), "case_id").alias("case_id"), F.lit("A").alias("sequence"))
    hits = cases.where("doc_id % 21 <> 0").select("query_id", "target_id")
    doc = table(spark, sf_dir, "documents").select(F.concat(F.lit("read"), c("doc_id").cast("string")).alias("name"), F.explode(F.when(c("doc_id") % 30 == 0, F.array(F.lit("f0"), F.lit("f1"))).when(c("doc_id") % 33 == 0, F.array(F.lit("f0"), F.lit("f0"))).otherwise(F.array(F.lit("f0")))).alias("file"))
    return validation.validate_dataset(tiles.select("identifier", "sequence"), contigs.unionByName(ghosts), relationships, found, expected, merged.unionByName(extra), hits, doc)


@query
def run_statistics(spark, sf_dir):
    """The measures of a run over tiles, observed on the tables that it writes anyway."""
    run = statistics.RunStatistics()
    sources = inputs.document_tiles(spark, sf_dir)
    own = minimisers.numbered(run.pinned("catalogue", _packed(sources), statistics.lengths("length")))
    every = minimisers.seed_lists(own, CONFIG, counted=True)
    run.pinned("seeds", every.groupBy("frequency").agg(F.sum("keys").alias("minimisers")), statistics.seed_measures(CONFIG.max_frequency, "minimisers"))
    statistics.guard_seed_pairs(run, "seeds", None)
    lists = every.where(F.col("frequency").between(2, CONFIG.max_frequency))
    shared = {"pairs": F.count("*"), "median_shared": F.percentile("shared_minimisers", F.lit(0.5)), "most_shared": F.max("shared_minimisers")}
    candidates = run.pinned("candidates", minimisers.lined_candidates(lists, CONFIG), shared | statistics.by_value("orientation", "+-"))
    run.pinned("members", catalogue.catalogue_members(sources), {"sources": F.count("*"), "duplicates_collapsed": F.count_if(~F.col("representative"))} | statistics.by_value("orientation", "+-"))
    kinds = [*validation.CLASSES]
    run.pinned("decisions", hit_operators.classify_pairs(aligner.line_hits(candidates, own, CONFIG), CONFIG), {"pairs": F.count("*")} | statistics.by_value("relationship_type", kinds))
    return run.rows(spark)


@query
def candidate_table(spark, sf_dir):
    numbers, lists, candidates = _candidates(_packed(inputs.document_tiles(spark, sf_dir)))
    candidates = pin(candidates)
    found = sinks.candidate_table(candidates, minimisers.place_pairs(lists, candidates))
    return minimisers.named(found.withColumnsRenamed({"query": "query_id", "target": "target_id"}), numbers).withColumnsRenamed({"query_id": "query", "target_id": "target"})


@query
def observation_violations(spark, sf_dir):
    """Events as observations of fifty cases in three samples; some name another junction or pair, a sample twice, or a case without truth."""
    n, e = F.col("user_id") % 50, F.col("event_id")
    rows = table(spark, sf_dir, "events").select(n.alias("n"), F.when((n % 11 == 0) & (e % 3 == 1), 0).otherwise(e % 3).alias("k"), (e % 3).alias("own")).distinct()
    n, k = F.col("n"), F.col("k")
    reference = F.concat(F.lit("ref"), (n + F.when((n % 7 == 0) & (F.col("own") == 2), 1).otherwise(0)).cast("string"))
    made = rows.select(
        F.concat(F.lit("case"), n.cast("string")).alias("case_id"), F.concat(F.lit("s"), k.cast("string")).alias("sample"), F.concat(F.lit("l"), n.cast("string")).alias("left_contig"),
        F.concat(F.lit("r"), n.cast("string")).alias("right_contig"), reference.alias("reference"), F.lit(1000).alias("reference_length"), F.md5(reference).alias("reference_sha256"), F.lit(450).alias("junction"),
    )
    i = F.col("id").cast("string")
    truth = spark.range(45).select(F.concat(F.lit("case"), i).alias("case_id"), F.concat(F.lit("l"), i).alias("left_contig"), F.when(F.col("id") % 9 == 0, "x").otherwise(F.concat(F.lit("r"), i)).alias("right_contig"))
    return evidence.observation_violations(truth, made)


@query
def parameter_grid(spark, sf_dir):
    """Two values each of k, w and the frequency bound: minimisers are selected once for each k and w."""
    return minimisers.parameter_sweep(_packed(inputs.contigs(spark, sf_dir)), [15, 21], [5, 10], [20, 100], CONFIG)


@query
def hit_decisions(spark, sf_dir):
    """A row a hit, with ids for each order and part."""
    names = ["query_id", "target_id", "orientation", "query_start", "query_end", "target_start", "target_end", "matching_bases", "alignment_block_length", "relationship_type", "status", "reason"]
    return hit_operators.classify_hits(inputs.unfolded_hits(spark, sf_dir), CONFIG).select(*names)


@query
def pair_decisions(spark, sf_dir):
    """A row a pair, with ids for each order and part: pairs grow with the table."""
    found = hit_operators.classify_pairs(inputs.unfolded_hits(spark, sf_dir), CONFIG)
    return found.select("query_id", "target_id", "relationship_type", "orientation", "identity", "aligned_length", "status", "reasons", "accepted_hits", "rejected_hits")


def _paf(spark, sf_dir) -> DataFrame:
    """Hits as PAF text, with lines of sequences against themselves and lines cut short, read again."""
    found = inputs.unfolded_hits(spark, sf_dir)
    names = ["query_id", "query_length", "query_start", "query_end", "orientation", "target_id", "target_length", "target_start", "target_end", "matching_bases", "alignment_block_length", "mapping_quality"]
    line = lambda target: F.concat_ws("\t", *[target if x == "target_id" else F.col(x).cast("string") for x in names], F.lit("tp:A:P"))
    more = F.array_compact(F.array(line(F.col("target_id")), F.when(F.col("mapping_quality") == 56, line(F.col("query_id"))), F.when(F.col("mapping_quality") == 48, F.concat_ws("\t", "query_id", F.lit("7")))))
    folder = fresh_dir(spark, "paf")
    found.select(F.explode(more).alias("value")).write.text(folder)
    return alignments.read_paf(spark, folder)


@query
def paf_score_counts(spark, sf_dir):
    # Truth is made of the decisions that it is held against: they are worked out once.
    decided = stored(scoring.paf_decisions(_paf(spark, sf_dir), CONFIG).select("query_id", "target_id", "relationship_type", "orientation"), "decided")
    return scoring.score_counts(_sparse_truth(decided), decided)


@query
def paf_errors(spark, sf_dir):
    return scoring.paf_errors(_paf(spark, sf_dir)).groupBy("error").agg(F.count("line").alias("lines"))


_EDITS = f"""{CONTIGS_SQL}, whole AS (SELECT identifier, sequence, original_identifier::BIGINT AS doc_id FROM contigs
), placed AS (
  SELECT *, k * {STRETCH} + (k * 7 + doc_id) % 50 AS position, (k + doc_id) % 3 AS kind FROM (SELECT *, unnest(range(length(sequence) // {STRETCH})) AS k FROM whole)
), made AS (
  SELECT *, CASE kind WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE k % 5 + 1 END AS removed,
         CASE kind WHEN 0 THEN translate(substr(sequence, position + 1, 1), 'ACGT', 'CGTA') WHEN 1 THEN left('{INSERTED}', (1 + k % 7)::INT) ELSE '' END AS added
  FROM placed
), sound AS (
  SELECT *, substr(sequence, position + 1, removed) AS old, coalesce(sum(length(added) - removed) OVER (PARTITION BY identifier ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift
  FROM made WHERE NOT (doc_id % 11 = 0 AND k = 0)
), pieces AS (
  SELECT w.identifier, k, substr(w.sequence, k * {STRETCH} + 1, {STRETCH}) AS piece, position - k * {STRETCH} AS o, removed, added
  FROM (SELECT *, unnest(range((length(sequence) + {STRETCH} - 1) // {STRETCH})) AS k FROM whole) w LEFT JOIN (SELECT identifier, k, position, removed, added FROM sound) s USING (identifier, k)
), edited AS (
  SELECT identifier, string_agg(CASE WHEN o IS NULL THEN piece ELSE left(piece, o::INT) || added || substr(piece, o + removed + 1) END, '' ORDER BY k) AS sequence FROM pieces GROUP BY identifier
)"""
_KIND = f"CASE kind WHEN 0 THEN '{mutations.SUBSTITUTION}' WHEN 1 THEN '{mutations.INSERTION}' ELSE '{mutations.DELETION}' END"
_OVERLAPS, _OUTSIDE, _UNKNOWN = mutations.REASONS[5], mutations.REASONS[2], mutations.REASONS[0]

SQL = {
    "observation_violations": """WITH made AS (
  SELECT DISTINCT user_id % 50 AS n, CASE WHEN user_id % 50 % 11 = 0 AND event_id % 3 = 1 THEN 0 ELSE event_id % 3 END AS k, event_id % 3 AS own FROM events
), seen AS (SELECT n, count(*) AS rows, count(DISTINCT k) AS samples, count(DISTINCT CASE WHEN n % 7 = 0 AND own = 2 THEN 1 ELSE 0 END) AS junctions FROM made GROUP BY n)
SELECT 'case' || n AS case_id, 'unknown case' AS reason FROM seen WHERE n >= 45
UNION ALL SELECT 'case' || n, 'duplicate sample' FROM seen WHERE samples < rows
UNION ALL SELECT 'case' || n, 'not one identical provisional junction' FROM seen WHERE junctions > 1
UNION ALL SELECT 'case' || n, 'pair differs from the truth' FROM seen WHERE n < 45 AND n % 9 = 0""",
    "mutated_sequences": f"WITH {_EDITS} SELECT w.identifier, length(coalesce(e.sequence, '')) AS length, md5(coalesce(e.sequence, '')) AS sequence_md5 FROM whole w LEFT JOIN edited e USING (identifier)",
    "mutation_truth": f"WITH {_EDITS} SELECT identifier, position, {_KIND} AS kind, old, added AS new, position + shift AS edited_position, true AS holds FROM sound",
    "edit_errors": f"""WITH {_EDITS} SELECT identifier, position, {_KIND} AS kind, '{_OVERLAPS}' AS reason FROM (SELECT *, unnest(range(2)) FROM made WHERE doc_id % 11 = 0 AND k = 0)
        UNION ALL SELECT identifier, length(sequence) + 5, '{mutations.DELETION}', '{_OUTSIDE}' FROM whole WHERE doc_id % 10 = 0
        UNION ALL SELECT 'x' || identifier, length(sequence) + 5, '{mutations.DELETION}', '{_UNKNOWN}' FROM whole WHERE doc_id % 10 = 0""",
    "nested_sample": f"WITH {CONTIGS_SQL} SELECT identifier FROM contigs ORDER BY sha256('17' || chr(0) || identifier) LIMIT 100",
    "validation_errors": f"""WITH {_CASES}, sides AS (
  SELECT 'case:' || a.doc_id || ':' || a.i AS case_id, a.doc_id, a.i, a.identifier AS q, b.identifier AS t FROM tiles a JOIN tiles b ON b.doc_id = a.doc_id AND b.i = a.i + 1
)
SELECT identifier AS subject, 'sequence without truth' AS error FROM tiles WHERE i = 0 AND doc_id % 10 = 0
UNION ALL SELECT 'ghost:' || identifier, 'truth without a sequence' FROM tiles WHERE i = 0 AND doc_id % 14 = 0
UNION ALL SELECT identifier, 'length differs' FROM tiles WHERE i = 0 AND doc_id % 9 = 0 AND doc_id % 10 <> 0
UNION ALL SELECT identifier, 'invalid circular interval' FROM tiles WHERE doc_id % 8 = 0 AND NOT (i = 0 AND doc_id % 10 = 0) AND (doc_id % 16 = 0) <> (i = 0 AND doc_id % 9 = 0)
UNION ALL SELECT c, 'no relationship of this class' FROM (SELECT unnest({list(validation.CLASSES)}) AS c) WHERE c NOT IN (SELECT CASE WHEN i % 4 = 3 THEN 'EXACT_MATCH' ELSE '{validation.MERGING}' END FROM sides)
UNION ALL SELECT case_id, 'relationship of an absent sequence' FROM sides WHERE doc_id % 15 = 0
UNION ALL SELECT case_id || ':substitution', 'number of mutations differs' FROM sides WHERE doc_id % 20 = 0
UNION ALL SELECT 'extra:' || case_id, 'merged sequence without an allowed overlap' FROM sides WHERE i = 0 AND doc_id % 25 = 0
UNION ALL SELECT case_id, 'allowed overlap without a merged sequence' FROM sides WHERE i % 4 <> 3 AND doc_id % 18 = 0
UNION ALL SELECT case_id, 'merged sequence differs' FROM sides WHERE i % 4 <> 3 AND doc_id % 12 = 0 AND doc_id % 18 <> 0 AND doc_id % 15 <> 0
UNION ALL SELECT case_id, 'no hit for an allowed overlap' FROM sides WHERE i % 4 <> 3 AND (doc_id % 21 = 0 OR doc_id % 15 = 0)
UNION ALL SELECT 'read' || doc_id, 'read in several files' FROM documents WHERE doc_id % 30 = 0
UNION ALL SELECT 'read' || doc_id, 'read repeated in a file' FROM documents WHERE doc_id % 33 = 0 AND doc_id % 30 <> 0""",
}
