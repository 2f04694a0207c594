"""Alignment hits: derived measures, checks, and classification of single hits and of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig

#: The columns of a hit, in their order of sorting.
HIT_COLUMNS = [
    "query_id", "target_id", "query_length", "query_start", "query_end", "orientation", "target_length", "target_start", "target_end",
    "matching_bases", "alignment_block_length", "mapping_quality", "alignment_score", "chain_minimisers", "chain_score", "secondary_chain_score", "alignment_type",
]
_OPTIONAL = {"mapping_quality", "alignment_score", "chain_minimisers", "chain_score", "secondary_chain_score"}


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def with_measures(hits: DataFrame) -> DataFrame:
    """Adds ``identity``, both coverages and the four end distances."""
    c = F.col
    return hits.withColumns(
        {
            "identity": _ratio(c("matching_bases"), c("alignment_block_length")),
            "query_coverage": _ratio(c("query_end") - c("query_start"), c("query_length")),
            "target_coverage": _ratio(c("target_end") - c("target_start"), c("target_length")),
            "query_start_distance": c("query_start"),
            "query_end_distance": c("query_length") - c("query_end"),
            "target_start_distance": c("target_start"),
            "target_end_distance": c("target_length") - c("target_end"),
        }
    )


def violations(hits: DataFrame) -> DataFrame:
    """``query_id, target_id, violations``: hits that break a rule, with the rules' names joined."""
    c = F.col
    q, t = c("query_end") - c("query_start"), c("target_end") - c("target_start")
    rules = {
        "query interval": (c("query_start") < 0) | (c("query_end") < c("query_start")) | (c("query_end") > c("query_length")),
        "target interval": (c("target_start") < 0) | (c("target_end") < c("target_start")) | (c("target_end") > c("target_length")),
        "matching bases": (c("matching_bases") < 0) | (c("matching_bases") > F.least(q, t)),
        "block length": (c("alignment_block_length") < F.greatest(q, t)) | (c("alignment_block_length") > q + t),
        "mapping quality": (c("mapping_quality") < 0) | (c("mapping_quality") > 255),
        "orientation": ~c("orientation").isin("+", "-"),
    }
    broken = F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules.items()]))
    said = hits.select("query_id", "target_id", F.array_join(broken, ",").alias("said"))
    # Sound hits go by an explode of nothing: a filter would be pushed below the columns that the rules are on, each written out at every use.
    return said.select("query_id", "target_id", F.explode(F.when(F.col("said") != "", F.array("said"))).alias("violations"))


#: The reasons of rejected hits, sorted.
REJECTIONS = ("alignment lacks compatible terminal geometry", "below identity threshold", "below minimum overlap", "zero length")


def classify_hits(hits: DataFrame, config: RunConfig) -> DataFrame:
    """Adds ``relationship_type, status, reason``; the first rule that holds decides, all bounds inclusive."""
    c, tol = F.col, config.end_tolerance
    hits = with_measures(hits)
    q_full = (c("query_start_distance") <= tol) & (c("query_end_distance") <= tol)
    t_full = (c("target_start_distance") <= tol) & (c("target_end_distance") <= tol)
    q_whole, t_whole = q_full & (c("query_coverage") >= config.containment_coverage), t_full & (c("target_coverage") >= config.containment_coverage)
    forward = c("orientation") == "+"
    near_start = F.when(forward, c("target_start_distance")).otherwise(c("target_end_distance"))
    near_end = F.when(forward, c("target_end_distance")).otherwise(c("target_start_distance"))
    ahead = (c("query_end_distance") <= tol) & (near_start <= tol)
    behind = (c("query_start_distance") <= tol) & (near_end <= tol)
    long_enough = c("alignment_block_length") >= config.min_containment
    none = "NO_RELATIONSHIP"
    # The types, statuses and reasons of the rules.
    table = [
        (c("alignment_block_length") == 0, none, "rejected", "zero length"),
        (c("identity") < config.identity, none, "rejected", "below identity threshold"),
        (q_whole & t_whole & (c("identity") == 1.0) & (c("query_length") == c("target_length")), "EXACT_MATCH", "confident", "full exact span"),
        (long_enough & q_whole & (c("query_length") <= c("target_length")), "QUERY_CONTAINED_IN_TARGET", "candidate", "query covered end-to-end"),
        (long_enough & t_whole & (c("target_length") <= c("query_length")), "TARGET_CONTAINED_IN_QUERY", "candidate", "target covered end-to-end"),
        (c("alignment_block_length") < config.min_overlap, none, "rejected", "below minimum overlap"),
        (ahead & behind, "AMBIGUOUS_OVERLAP", "ambiguous", "alignment satisfies competing terminal topologies"),
        (ahead, "QUERY_SUFFIX_TO_TARGET_PREFIX", "candidate", "compatible terminal geometry"),
        (behind, "TARGET_SUFFIX_TO_QUERY_PREFIX", "candidate", "compatible terminal geometry"),
    ]
    last = (none, "rejected", "alignment lacks compatible terminal geometry")
    # The rules are written once; three cases with all of them make code too long for the JVM to compile.
    rule = None
    for i, (holds, *_) in enumerate(table):
        rule = F.when(holds, i) if rule is None else rule.when(holds, i)
    said = [*(x[1:] for x in table), last]
    names = ("relationship_type", "status", "reason")
    found = {name: F.get(F.array(*[F.lit(x[k]) for x in said]), c("_rule")) for k, name in enumerate(names)}
    return hits.withColumn("_rule", rule.otherwise(len(table))).withColumns(found).drop("_rule")


def _order() -> list[Column]:
    return [F.coalesce(F.col(x), F.lit(-1)) if x in _OPTIONAL else F.coalesce(F.col(x), F.lit("")) if x == "alignment_type" else F.col(x) for x in HIT_COLUMNS]


def complete(hits: DataFrame) -> DataFrame:
    """``hits`` with null for every hit column that is missing."""
    missing = {x: F.lit(None).cast("string" if x == "alignment_type" else "int") for x in HIT_COLUMNS if x not in hits.columns}
    return hits.withColumns(missing).select(*HIT_COLUMNS) if missing else hits.select(*HIT_COLUMNS)


def classify_pairs(hits: DataFrame, config: RunConfig) -> DataFrame:
    """One decision for each ordered pair.

    Equal hits count once.  Without an accepted hit the first hit's verdict
    stands, with all reasons.  Otherwise every accepted hit must agree with the
    first: in type, in orientation, and in its four coordinates within the end
    tolerance.  If not, the pair is ambiguous; no score elects a winner.

    ``query_id, target_id, relationship_type, orientation, identity,
    aligned_length, query_coverage, target_coverage, status, reasons`` (joined),
    ``accepted_hits, rejected_hits``, lengths, and the coordinates of the hit
    that stands (of the first accepted one where the pair is ambiguous).
    """
    c = F.col
    # A pair's hits move once: equal ones are dropped and the pair is judged where they meet.
    dealt = complete(hits).repartition("query_id", "target_id").dropDuplicates()
    rows = classify_hits(dealt, config).withColumn("accepted", c("relationship_type") != "NO_RELATIONSHIP")
    sides = ["query_start", "query_end", "target_start", "target_end"]
    keep = ["relationship_type", "orientation", "identity", "alignment_block_length", "query_coverage", "target_coverage", "status", "reason", "query_length", "target_length", *sides]
    of_accepted = lambda x: F.when(c("accepted"), c(x))
    first = F.struct((~c("accepted")).alias("rejected"), *[x.alias(f"_{i}") for i, x in enumerate(_order())], F.struct(*keep).alias("hit"))
    grouped = rows.groupBy("query_id", "target_id").agg(
        F.min(first).alias("first"),
        F.count_if("accepted").alias("accepted_hits"),
        F.count_if(~c("accepted")).alias("rejected_hits"),
        (F.min(of_accepted("relationship_type")) != F.max(of_accepted("relationship_type"))).alias("by_type"),
        (F.min(of_accepted("orientation")) != F.max(of_accepted("orientation"))).alias("by_strand"),
        *[edge(of_accepted(x)).alias(f"{name}_{x}") for x in sides for name, edge in (("least", F.min), ("most", F.max))],
        *[F.count_if(~c("accepted") & (c("reason") == x)).alias(f"reason_{i}") for i, x in enumerate(REJECTIONS)],
    )
    far = F.greatest(*[F.greatest(c(f"most_{x}") - c(f"lead.{x}"), c(f"lead.{x}") - c(f"least_{x}")) for x in sides]) > config.end_tolerance
    grouped = grouped.withColumn("lead", c("first.hit")).withColumn("by_place", far).withColumn(
        "rejections", F.array_compact(F.array(*[F.when(c(f"reason_{i}") > 0, x) for i, x in enumerate(REJECTIONS)]))
    )
    torn = (F.col("accepted_hits") > 0) & (F.col("by_type") | F.col("by_strand") | F.col("by_place"))
    # The reasons of an ambiguous pair.
    said = F.array_sort(F.array_compact(F.array(
        F.when(F.col("by_type"), "accepted hits imply incompatible relationship types or terminal topologies"),
        F.when(F.col("by_strand"), "accepted hits imply incompatible orientations"),
        F.when(F.col("by_place"), "accepted hits imply materially different coordinate placements"),
    )))
    return grouped.select(
        "query_id", "target_id",
        F.when(torn, "AMBIGUOUS_OVERLAP").otherwise(F.col("lead.relationship_type")).alias("relationship_type"),
        "lead.orientation", "lead.identity", F.col("lead.alignment_block_length").alias("aligned_length"), "lead.query_coverage", "lead.target_coverage",
        F.when(torn, "ambiguous").otherwise(F.col("lead.status")).alias("status"),
        F.when(torn, F.array_join(said, "; ")).when(F.col("accepted_hits") == 0, F.array_join("rejections", "; ")).otherwise(F.col("lead.reason")).alias("reasons"),
        F.array_join("rejections", "; ").alias("rejections"),
        "accepted_hits", "rejected_hits", "lead.query_length", "lead.target_length", "lead.query_start", "lead.query_end", "lead.target_start", "lead.target_end",
    )


def relationship_histogram(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("relationship_type", "status").agg(F.count("*").alias("pairs"))
