"""The registered queries take the whole of their tables."""

import hashlib

from pyspark.sql import functions as F

from braidseq.config import RunConfig
from braidseq.functions.sequences import reverse_complement, text_as_sequence
from braidseq.operators import graph, hits
from braidseq.plans import inputs
from braidseq.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_tiles_hold_every_letter_of_every_document(spark, tmp_path):
    rows = [(i, "abcdefg" * 2000, "s", n) for i, n in enumerate([0, 1, 40, 2999, 3000, 3001, 4999, 5000, 5001, 6999, 7000, 12345])] + [(99, None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").withColumn("text", F.expr("left(text, n)"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    whole = {r["doc_id"]: r["s"] for r in docs.select("doc_id", text_as_sequence(F.col("text")).alias("s")).collect()}
    plain = F.when(F.col("source_ordinal") % 2 == 1, reverse_complement(F.col("sequence"))).otherwise(F.col("sequence")).alias("s")
    found = {}
    for r in inputs.document_tiles(spark, str(tmp_path)).select("original_identifier", "source_ordinal", plain).collect():
        found.setdefault(int(r["original_identifier"].split(":")[0]), {})[r["source_ordinal"]] = r["s"]
    assert set(found) == set(whole)
    for doc, tiles in found.items():
        assert sorted(tiles) == list(range(len(tiles)))
        assert "".join(tiles[i][: inputs.TILE_STRIDE] for i in range(len(tiles) - 1)) + tiles[len(tiles) - 1] == whole[doc]


def test_every_document_is_in_provenance(spark):
    got = {r[0] for r in QUERIES["merge_provenance"](spark, SF).select(F.split("source_contig", ":")[0].cast("long")).collect()}
    assert got == {r[0] for r in inputs.table(spark, SF, "documents").select("doc_id").collect()}


def test_components_join_edges_of_every_kind(spark):
    found = inputs.unfolded_hits(spark, SF).cache()
    edges = graph.graph_edges(hits.classify_pairs(found, RunConfig())).select("query_id", "target_id", "kind").collect()
    assert {e["kind"] for e in edges} == {"ambiguous", "containment", "overlap"}
    group = {r[0]: r[0] for r in found.selectExpr("explode(array(query_id, target_id))").distinct().collect()}
    assert len(group) > 1540

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for e in edges:
        low, high = sorted((root(e["query_id"]), root(e["target_id"])))
        group[high] = low
    members = {}
    for x in sorted(group):
        members.setdefault(root(x), []).append(x)
    wanted = {x: ("component_" + hashlib.sha256("\0".join(m).encode()).hexdigest()[:20], len(m)) for m in members.values() for x in m}
    assert {r["node"]: (r["component_id"], r["members"]) for r in QUERIES["graph_components"](spark, SF).collect()} == wanted


def test_names_of_components_and_paths_gather_no_rows(spark):
    nodes = spark.range(3000).selectExpr("concat('n', id) as sequence_id")
    edges = spark.range(2000).selectExpr("concat('n', id) as query_id", "concat('n', id + 1) as target_id")
    named = graph.node_components(nodes, edges)
    assert "collect_list" not in named._jdf.queryExecution().toString()
    got = {r["node"]: (r["component_id"], r["members"]) for r in named.collect()}
    one = "component_" + hashlib.sha256("\0".join(sorted(f"n{i}" for i in range(2001))).encode()).hexdigest()[:20]
    assert len(got) == 3000 and all(got[f"n{i}"] == (one, 2001) for i in range(2001))
    assert got["n2500"] == ("component_" + hashlib.sha256(b"n2500").hexdigest()[:20], 1)
    paths = QUERIES["linear_paths"](spark, SF)
    assert "collect_list" not in paths._jdf.queryExecution().toString()
    walks = {}
    for r in sorted(paths.collect(), key=lambda r: r["step"]):
        walks.setdefault((r["path_id"], r["component_id"]), []).append(r)
    assert max(map(len, walks.values())) > 2
    for (path, component), walk in walks.items():
        parts = [component, *[f"{r['sequence_id']}:{r['strand']}" for r in walk], *[r["edge_id"] for r in walk if r["edge_id"]]]
        assert path == "path_" + hashlib.sha256("\0".join(parts).encode()).hexdigest()[:20]
