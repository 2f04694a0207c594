"""Decisions against truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from .hits import classify_pairs

MERGE_LIKE = ("EXACT_MATCH", "QUERY_CONTAINED_IN_TARGET", "TARGET_CONTAINED_IN_QUERY", "QUERY_SUFFIX_TO_TARGET_PREFIX", "TARGET_SUFFIX_TO_QUERY_PREFIX")
_MEASURES = ("correct", "false_merge", "missed", "wrong_type", "wrong_orientation", "deferred", "boundary_failure")
_BOUNDARY = "^(identity_|length_|end_tolerance_|containment_coverage_)"


def score_cases(truth: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row a truth row, with ``correct, false_merge, missed, wrong_type, wrong_orientation, deferred, boundary_failure``.

    ``truth``: ``query_id, target_id, case_id, expected_relationship,
    expected_orientation, expected_status, merge_allowed, ambiguity_group``.
    Pairs with themselves are never scored, nor are pairs without truth.
    """
    c = F.col
    observed = decisions.where("query_id <> target_id").select("query_id", "target_id", c("relationship_type").alias("observed"), c("orientation").alias("observed_orientation"))
    met = truth.join(observed, ["query_id", "target_id"], "left")
    deferred = F.coalesce(c("ambiguity_group"), F.lit("")) != ""
    merges, absent = F.coalesce(c("observed").isin(*MERGE_LIKE), F.lit(False)), c("observed").isNull()
    expected = F.when(c("merge_allowed"), c("expected_relationship")).otherwise("NO_RELATIONSHIP")
    strand_ok = c("expected_orientation").isNull() | c("expected_orientation").eqNullSafe(c("observed_orientation"))
    same = F.coalesce(c("observed") == expected, F.lit(False))
    vague = F.coalesce(c("observed") == "AMBIGUOUS_OVERLAP", F.lit(False))
    correct = ~deferred & same & ((expected == "NO_RELATIONSHIP") | strand_ok)
    return met.withColumns(
        {
            "deferred": deferred,
            "false_merge": ~deferred & ~c("merge_allowed") & merges,
            "missed": (c("expected_status") == "VALID") & c("expected_relationship").isin(*MERGE_LIKE) & (absent | F.coalesce(c("observed") == "NO_RELATIONSHIP", F.lit(False))),
            "correct": correct,
            "wrong_type": ~deferred & ~vague & ~absent & ~same,
            "wrong_orientation": ~deferred & ~vague & same & (expected != "NO_RELATIONSHIP") & ~strand_ok,
            "boundary_failure": c("case_id").rlike(_BOUNDARY) & ~(correct | deferred),
        }
    )


def score_summary(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count("*").alias("cases"), *[F.count_if(n).alias(n) for n in _MEASURES])


#: Fixed value.
_UNEXPECTED = "ordered pair is absent from sparse truth table"


def unexpected_pairs(truth: DataFrame, decisions: DataFrame) -> DataFrame:
    """``query_id, target_id, observed, observed_orientation, ambiguous, reason``: decided pairs without a truth row; pairs with themselves are left out."""
    seen = decisions.where("query_id <> target_id").join(truth.select("query_id", "target_id").distinct(), ["query_id", "target_id"], "left_anti")
    kind = F.col("relationship_type")
    return seen.select("query_id", "target_id", kind.alias("observed"), F.col("orientation").alias("observed_orientation"), (kind == "AMBIGUOUS_OVERLAP").alias("ambiguous"), F.lit(_UNEXPECTED).alias("reason"))


def score_counts(truth: DataFrame, decisions: DataFrame) -> DataFrame:
    """``measure, relationship_type, n``: how often each type was observed and was found correctly, and totals (type null) of pairs and failures.

    Totals are of the columns of ``score_cases``, of truth rows that were not
    observed, of those observed as ambiguous though not deferred, of the
    ambiguity groups, and of observed pairs without truth.  Empty tables give
    zeros.
    """
    c = F.col
    cases = score_cases(truth, decisions)
    seen = decisions.where("query_id <> target_id")
    totals = {
        "truth": F.count("*"), **{x: F.count_if(x) for x in _MEASURES}, "absent": F.count_if(c("observed").isNull()),
        "ambiguous": F.count_if((c("observed") == "AMBIGUOUS_OVERLAP") & ~c("deferred")), "ambiguity_groups": F.count_distinct(F.when(c("ambiguity_group") != "", c("ambiguity_group"))),
    }
    wide = cases.agg(*[n.alias(x) for x, n in totals.items()])
    long = wide.select(F.explode(F.create_map(*[x for name in totals for x in (F.lit(name), c(name))])).alias("measure", "n")).select("measure", F.lit(None).cast("string").alias("relationship_type"), "n")
    others = [
        seen.agg(F.count("*").alias("n")).select(F.lit("observed").alias("measure"), F.lit(None).cast("string").alias("relationship_type"), "n"),
        unexpected_pairs(truth, decisions).agg(F.count("*").alias("n")).select(F.lit("unexpected").alias("measure"), F.lit(None).cast("string").alias("relationship_type"), "n"),
        cases.where("correct").groupBy(c("expected_relationship").alias("relationship_type")).agg(F.count("*").alias("n")).select(F.lit("correct_of_type").alias("measure"), "relationship_type", "n"),
        seen.groupBy("relationship_type").agg(F.count("*").alias("n")).select(F.lit("observed_of_type").alias("measure"), "relationship_type", "n"),
    ]
    for more in others:
        long = long.unionByName(more)
    return long


def pipeline_recall(truth: DataFrame, members: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: what of ``truth``, whose ids are sources, the catalogue and the candidate search keep.

    ``exact_rows, exact_recovered`` (both sources have one catalogue entry), and
    of valid mergeable pairs of other types ``rows, recalled_rows, missed_rows,
    groups, recalled_groups``.  ``members``: ``source_id, catalogue_id``;
    ``candidates``: catalogue ids in any order.  A source without an entry is
    never recovered.
    """
    c = F.col
    of = lambda side: members.select(c("source_id").alias(f"{side}_id"), c("catalogue_id").alias(side))
    met = truth.join(of("query"), "query_id", "left").join(of("target"), "target_id", "left").withColumns({"lo": F.least("query", "target"), "hi": F.greatest("query", "target")})
    found = candidates.select(F.least("query_id", "target_id").alias("lo"), F.greatest("query_id", "target_id").alias("hi")).distinct().withColumn("hit", F.lit(True))
    judged = met.join(found, ["lo", "hi"], "left")
    exact = c("expected_relationship") == "EXACT_MATCH"
    wanted = ~exact & (c("expected_status") == "VALID") & c("merge_allowed") & c("expected_relationship").isin(*MERGE_LIKE)
    recalled = wanted & F.coalesce("hit", F.lit(False))
    return judged.agg(
        F.count_if(exact).alias("exact_rows"), F.count_if(exact & (c("query") == c("target"))).alias("exact_recovered"), F.count_if(wanted).alias("rows"), F.count_if(recalled).alias("recalled_rows"),
        F.count_if(wanted & ~recalled).alias("missed_rows"), F.count_distinct(F.when(wanted, c("case_id"))).alias("groups"), F.count_distinct(F.when(recalled, c("case_id"))).alias("recalled_groups"),
    )


def stage_recall(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """``rows, groups, recalled_rows, recalled_groups``: of the valid pairs, those that are candidates in either order."""
    wanted = truth.where("merge_allowed").select(F.least("query_id", "target_id").alias("query_id"), F.greatest("query_id", "target_id").alias("target_id"), "case_id")
    found = candidates.select(F.least("query_id", "target_id").alias("query_id"), F.greatest("query_id", "target_id").alias("target_id")).distinct().withColumn("hit", F.lit(True))
    met = wanted.join(found, ["query_id", "target_id"], "left")
    return met.agg(
        F.count("*").alias("rows"), F.count_distinct("case_id").alias("groups"), F.count_if(F.col("hit")).alias("recalled_rows"), F.count_distinct(F.when(F.col("hit"), F.col("case_id"))).alias("recalled_groups")
    )


def evaluate_paf(found: DataFrame, truth: DataFrame, config: RunConfig) -> tuple[DataFrame, DataFrame]:
    """``score_counts`` of the hits in PAF text (``sources.alignments.read_paf``), and ``file, line, error`` of the lines that count nowhere.

    Hits of a sequence with itself are left out.  A broken line takes no part
    in any decision; whether the counts stand in spite of it is the caller's
    to decide.
    """
    return score_counts(truth, paf_decisions(found, config)), paf_errors(found)


def paf_decisions(found: DataFrame, config: RunConfig) -> DataFrame:
    """Decisions (``hits.classify_pairs``) of the sound lines of PAF text; hits of a sequence with itself are left out."""
    return classify_pairs(found.where("error is null and query_id <> target_id").drop("error", "file", "line"), config)


def paf_errors(found: DataFrame) -> DataFrame:
    """``file, line, error`` of the broken lines of PAF text."""
    return found.where("error is not null").select("file", "line", "error")
