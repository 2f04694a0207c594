"""Operators on small inputs: brute force, bounds, and every source accounted for."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from braidseq.config import ConfigError, InputError, RunConfig
from braidseq.functions.sequences import canonical, reverse_complement
from braidseq.operators import aligner, catalogue, evidence, graph, hits, minimisers, reconcile, scoring
from braidseq.operators.components import connected_components
from braidseq.session import pin

TURN = str.maketrans("ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN")


def rc(s):
    return s[::-1].translate(TURN)


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def sources(spark, rows):
    return spark.createDataFrame([(f"s:{i}", "s", i, s, k) for k, (i, s) in enumerate(rows)], "identifier string, source_sample string, original_identifier string, sequence string, source_ordinal int")


def test_strands(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("ACGTRYSWKMBDHVN") for _ in range(rng.randint(0, 30))),) for _ in range(100)]
    got = spark.createDataFrame(rows, "s string").select("s", reverse_complement(F.col("s")).alias("r"), canonical(F.col("s")).alias("c")).collect()
    assert all(r["r"] == rc(r["s"]) and r["c"] == min(r["s"], rc(r["s"])) for r in got)


def test_catalogue_joins_both_strands(spark):
    rows = [("b", "AACC"), ("a", "GGTT"), ("c", "ACGT"), ("d", "TTTT")]
    members = catalogue.catalogue_members(sources(spark, rows)).collect()
    assert len(members) == 4
    by = {m["original_identifier"]: m for m in members}
    assert by["a"]["catalogue_id"] == by["b"]["catalogue_id"] and by["b"]["representative"] and not by["a"]["representative"]
    assert by["c"]["orientation"] == "+" and by["d"]["orientation"] == "-"
    with pytest.raises(InputError):
        catalogue.require_unique(sources(spark, rows).union(sources(spark, rows)))


def brute_minimisers(s, k, w):
    n = len(s) - k + 1
    values = []
    for p in range(max(0, n)):
        f = s[p : p + k]
        values.append(hashlib.sha256(min(f, rc(f)).encode()).hexdigest()[:16] if set(f) <= set("ACGT") else None)
    out, w = set(), min(w, n)
    for e in range(max(0, n - w + 1)) if n > 0 else ():
        real = [v for v in values[e : e + w] if v]
        if real:
            out |= {p for p in range(e, e + w) if values[p] == min(real)}
    return {(p, values[p]) for p in out}


def test_minimisers_equal_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    texts = [dna(rng, n) for n in (0, 5, 6, 7, 20, 200, 700)] + ["A" * 60, "ACGT" * 30, dna(rng, 40) + "NNN" + dna(rng, 40), "NNNNNNNNNN"]
    monkeypatch.setattr(minimisers, "TILE", 16)
    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(texts)], "catalogue_id string, sequence string")
    got = {}
    for r in minimisers.sequence_minimisers(df, 6, 4).collect():
        got.setdefault(int(r["sequence_id"]), []).append((r["position"], r["value"]))
    for i, s in enumerate(texts):
        found = got.get(i, [])
        assert len(found) == len(set(found)) and set(found) == brute_minimisers(s, 6, 4)


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    group = {}

    def root(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            lo, hi = sorted((root(a), root(b)))
            group[hi] = lo
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b", pin).collect()}
    assert got == {x: root(x) for x in group}


def hit(q="q", t="t", ql=3000, qs=2000, qe=3000, o="+", tl=3000, ts=0, te=1000, m=1000, b=1000):
    return (q, t, ql, qs, qe, o, tl, ts, te, m, b)


SCHEMA = "query_id string, target_id string, query_length int, query_start int, query_end int, orientation string, target_length int, target_start int, target_end int, matching_bases int, alignment_block_length int"


@pytest.mark.parametrize(
    "row, kind",
    [
        (hit(), "QUERY_SUFFIX_TO_TARGET_PREFIX"),
        (hit(m=980), "QUERY_SUFFIX_TO_TARGET_PREFIX"),
        (hit(m=979), "NO_RELATIONSHIP"),
        (hit(qs=2001, te=999, m=999, b=999), "NO_RELATIONSHIP"),
        (hit(qe=2950, te=950, m=1000, b=1000), "QUERY_SUFFIX_TO_TARGET_PREFIX"),
        (hit(qs=1949, qe=2949), "NO_RELATIONSHIP"),
        (hit(o="-"), "NO_RELATIONSHIP"),
        (hit(o="-", ts=2000, te=3000), "QUERY_SUFFIX_TO_TARGET_PREFIX"),
        (hit(qs=0, qe=1000, ts=2000, te=3000), "TARGET_SUFFIX_TO_QUERY_PREFIX"),
        (hit(qs=0, qe=3000, te=3000, m=3000, b=3000), "EXACT_MATCH"),
        (hit(qs=0, qe=3000, te=3000, m=2999, b=3000), "QUERY_CONTAINED_IN_TARGET"),
        (hit(tl=600, qs=100, qe=700, te=600, m=600, b=600), "TARGET_CONTAINED_IN_QUERY"),
        (hit(tl=499, qs=100, qe=599, te=499, m=499, b=499), "NO_RELATIONSHIP"),
        (hit(b=0, m=0), "NO_RELATIONSHIP"),
    ],
)
def test_single_hits_at_their_bounds(spark, row, kind):
    assert hits.classify_hits(spark.createDataFrame([row], SCHEMA), RunConfig()).first()["relationship_type"] == kind


def test_pairs_never_elect_a_winner(spark):
    rows = [hit(), hit(), hit(q="a", o="-", ts=2000, te=3000), hit(q="a"), hit(q="b"), hit(q="b", m=1)]
    got = {r["query_id"]: r for r in hits.classify_pairs(spark.createDataFrame(rows, SCHEMA), RunConfig()).collect()}
    assert got["q"]["accepted_hits"] == 1 and got["q"]["status"] == "candidate"
    assert got["a"]["status"] == "ambiguous" and "orientations" in got["a"]["reasons"]
    assert got["b"]["status"] == "candidate" and got["b"]["rejected_hits"] == 1


def run(spark, rows):
    config = RunConfig()
    source = sources(spark, rows)
    sequences = pin(catalogue.catalogue_sequences(source).selectExpr("catalogue_id as sequence_id", "sequence", "length"))
    seeds = pin(minimisers.retained_seeds(minimisers.sequence_minimisers(sequences, id_col="sequence_id"), config.max_frequency))
    pairs = pin(minimisers.seed_pairs(seeds))
    found = aligner.diagonal_hits(minimisers.candidate_pairs(pairs, sequences, config), pairs, sequences, config)
    members = catalogue.catalogue_members(source)
    return reconcile.reconcile(sequences, members, pin(hits.classify_pairs(found, config)), config), members


def test_tiles_merge_back_and_all_sources_are_accounted_for(spark):
    rng = random.Random(5)
    whole, other, lone = dna(rng, 11000), dna(rng, 5000), dna(rng, 3000)
    tiles = [whole[i : i + 3000] for i in range(0, 8001, 2000)]
    rows = [(f"t{i}", rc(t) if i % 2 else t) for i, t in enumerate(tiles)] + [("copy", rc(tiles[0])), ("big", other), ("in", rc(other[1000:2500])), ("lone", lone)]
    results, _ = run(spark, rows)
    out = {r["output_sequence"]: r["sequence"] for r in results["outputs"].collect()}
    merged = [s for n, s in out.items() if n.startswith("merge_")]
    assert len(merged) == 1 and merged[0] in (whole, rc(whole))
    assert sorted(map(len, out.values())) == [3000, 5000, 11000]
    prov = results["provenance"].collect()
    assert sorted(r["source_contig"] for r in prov) == sorted(n for n, _ in rows)
    for r in prov:
        part = out[r["output_sequence"]][r["output_start"] : r["output_end"]]
        source = dict(rows)[r["source_contig"]]
        if r["disposition"] == "constructed_path":
            assert part == (source if r["orientation"] == "+" else rc(source))
        if r["disposition"] == "contained_removed":
            assert part in (source, rc(source))


def test_branches_and_imperfect_overlaps_are_not_merged(spark):
    rng = random.Random(6)
    stem = dna(rng, 3000)
    left, right = stem[2000:] + dna(rng, 2000), stem[2000:] + dna(rng, 2000)
    bent = list(dna(rng, 2000) + dna(rng, 1000))
    follow = "".join(bent[2000:])
    follow = "".join("ACGT"[("ACGT".index(c) + 1) % 4] if i % 50 == 0 else c for i, c in enumerate(follow)) + dna(rng, 2000)
    results, _ = run(spark, [("stem", stem), ("l", left), ("r", right), ("bent", "".join(bent)), ("follow", follow)])
    assert not [r for r in results["outputs"].collect() if r["output_sequence"].startswith("merge_")]
    assert results["outputs"].count() == 5
    reasons = " | ".join(r["reason"] for r in results["ambiguous"].collect())
    assert "compete for the same oriented terminal" in reasons and "deferred by conservative policy" in reasons


def test_graph_cycles_conflicts_and_reciprocals(spark):
    cols = "query_id string, target_id string, relationship_type string, orientation string"
    tail = "QUERY_SUFFIX_TO_TARGET_PREFIX"
    rows = [("a", "b", tail, "+"), ("b", "c", tail, "+"), ("c", "a", tail, "+"), ("d", "e", tail, "+"), ("e", "f", tail, "-"), ("f", "d", tail, "+"), ("x", "y", tail, "+")]
    edges = spark.createDataFrame(rows, cols)
    assert {r["node"] for r in graph.overlap_cycles(edges).collect()} == {"a", "d"}
    assert {r["node"] for r in graph.orientation_conflicts(edges).collect()} == {"d", "e", "f"}
    one, back = hit(q="a", t="b"), hit(q="b", t="a", qs=0, qe=1000, ts=2000, te=3000)
    decided = hits.classify_pairs(spark.createDataFrame([one, back, hit(q="c", t="d"), hit(q="d", t="c")], SCHEMA), RunConfig())
    kinds = {(r["query_id"], r["target_id"]): (r["kind"], r["ambiguity_reasons"]) for r in graph.graph_edges(decided).collect()}
    assert kinds["a", "b"] == ("overlap", "") and kinds["c", "d"] == ("ambiguous", "reciprocal ordered-pair decisions are inconsistent")


@pytest.mark.parametrize(
    "cigar, blocks, end",
    [("10M2D5M", [(3, 13), (15, 20)], 20), ("5M3I5M", [(3, 13)], 13), ("4S10M", [(3, 13)], 13), ("5M10N5M", [(3, 8), (18, 23)], 23), ("3=1X6=", [(3, 13)], 13), ("10", None, None), ("0M5M", None, None), ("*", None, None)],
)
def test_cigar_blocks(spark, cigar, blocks, end):
    row = evidence.cigar_blocks(spark.createDataFrame([(3, cigar)], "position int, cigar string")).first()
    assert (row["blocks"] and [tuple(b) for b in row["blocks"]]) == blocks and row["reference_end"] == end


def test_scores(spark):
    truth = spark.createDataFrame([("a", "b", "identity_1", "EXACT_MATCH", "+", "VALID", True, ""), ("c", "d", "x", "NO_RELATIONSHIP", None, "FORBIDDEN", False, "")],
                                  "query_id string, target_id string, case_id string, expected_relationship string, expected_orientation string, expected_status string, merge_allowed boolean, ambiguity_group string")
    seen = spark.createDataFrame([("c", "d", "EXACT_MATCH", "+")], "query_id string, target_id string, relationship_type string, orientation string")
    row = scoring.score_summary(scoring.score_cases(truth, seen)).first()
    assert (row["cases"], row["missed"], row["false_merge"], row["boundary_failure"]) == (2, 1, 1, 1)


def test_settings():
    assert RunConfig.from_percent(99.0).identity == 0.99 and RunConfig().terminal_band == 1000
    for bad in ({"identity": 2.0}, {"kmer": 0}, {"evidence": "reads"}):
        with pytest.raises(ConfigError):
            RunConfig(**bad)


def test_graph_violations_of_labels(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("",)], "sequence_id string")
    edges = spark.createDataFrame([("e", "overlap", "a", "b", "QUERY_SUFFIX_TO_TARGET_PREFIX")], "edge_id string, kind string, query_id string, target_id string, relationship_type string")
    sound = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "3"), ("", "4")], "node string, component_id string")
    assert [tuple(r) for r in graph.graph_violations(nodes, edges, sound).collect()] == [("", "empty node identifier")]
    odd = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "2"), ("", "4")], "node string, component_id string")
    got = {tuple(r) for r in graph.graph_violations(nodes.where("sequence_id <> ''"), edges, odd).collect()}
    assert got == {("a", "component is torn apart"), ("2", "component joins nodes without a path"), ("d", "node without a component")}
