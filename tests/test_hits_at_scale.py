"""Plans and work of the queries over hits, which grow with line items."""

from hashlib import sha256

from braidseq.config import RunConfig
from braidseq.operators import graph, hits, scoring
from braidseq.plans import inputs
from braidseq.sources import alignments

DATA = "/root/testdata/sf0.001"


def test_rules_are_not_written_out_in_a_filter(spark):
    """A filter on the rules was pushed below every column that they are on: its text had 164,000 letters."""
    broken = hits.violations(inputs.hits(spark, DATA).selectExpr("* except (query_end)", "query_length + 1 as query_end"))
    plan = broken._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000
    assert "query interval" in broken.first()["violations"]


def test_hits_of_a_pair_move_once(spark):
    """Equal hits were dropped in one shuffle and pairs judged in another; the rules stood in the plan three times."""
    decided = hits.classify_pairs(inputs.unfolded_hits(spark, DATA), RunConfig())
    plan = decided._jdf.queryExecution().optimizedPlan().toString()
    assert decided._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert plan.count("query_end_distance#") and len(plan) < 20_000


def test_errors_of_paf_are_not_written_out_in_a_filter(spark, tmp_path):
    """The filter on errors stood below the fields that they are made of, with all of them written out."""
    (tmp_path / "a.paf").write_text("q\t100\t0\t100\t+\tt\t100\t0\t100\t100\t100\t60\ttp:A:P\nq\t7\nq\t100\t0\t101\t+\tt\t100\t0\t100\t100\t100\t60\n")
    found = alignments.read_paf(spark, str(tmp_path))
    sound = scoring.paf_decisions(found, RunConfig())
    filters = [line for line in sound._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in line]
    assert max(map(len, filters)) < 2_000
    assert [(r["query_id"], r["relationship_type"]) for r in sound.collect()] == [("q", "EXACT_MATCH")]
    assert sorted((r["line"], r["error"]) for r in scoring.paf_errors(found).collect()) == [(2, "fewer than twelve fields"), (3, "an interval is out of range")]


def test_names_of_components_are_hashed_once(spark):
    """The joins of names to nodes hashed all components' names again, three times in a large graph."""
    rows = spark.range(30_000, numPartitions=1).selectExpr("cast(id div 2 as string) as root", "cast(id as string) as value")
    found = {r["root"]: r for r in graph.digest_of_each(rows, "root", ["value"], "c_").collect()}
    assert len(found) == 15_000 and all(r["rows"] == 2 for r in found.values())
    assert found["7"]["digest"] == "c_" + sha256(b"14\x0015").hexdigest()[:20]
    nodes = rows.selectExpr("concat('n', value) as sequence_id")
    edges = spark.range(9_000).selectExpr("concat('n', 2 * id) as query_id", "concat('n', 2 * id + 1) as target_id")
    labels = graph.node_components(nodes, edges)
    assert "MapInArrow" not in labels._jdf.queryExecution().executedPlan().toString()
    assert labels.groupBy("component_id").count().groupBy("count").count().sort("count").collect() == [(1, 12_000), (2, 9_000)]
