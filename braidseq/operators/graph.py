"""The relationship graph: edges from reciprocal decisions, components, and reasons for ambiguity.

Decisions are the rows of ``hits.classify_pairs``; exact matches and pairs
without a relationship make no edge.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import content_id
from ..session import pin
from .components import connected_components
from .skew import join_named

_CONTAINED = ("QUERY_CONTAINED_IN_TARGET", "TARGET_CONTAINED_IN_QUERY")
_SIDES = ("query_start", "query_end", "target_start", "target_end")
#: The reasons of ambiguous edges.
_REASONS = (
    "reciprocal decisions disagree on whether a relationship exists",
    "pair classifier retained ambiguous alignment evidence",
    "reciprocal ordered-pair decisions are inconsistent",
)


def graph_edges(decisions: DataFrame) -> DataFrame:
    """One edge for each unordered pair with a relationship.

    ``edge_id, kind`` (containment, overlap, ambiguous), ``query_id, target_id,
    relationship_type, orientation, identity, aligned_length``, coordinates
    (null where ambiguous), ``accepted_hits, rejected_hits, ambiguity_reasons``
    (joined).  The decision from the smaller (query, target) speaks for both.
    """
    c = F.col
    rows = decisions.where(c("relationship_type") != "EXACT_MATCH").withColumn("active", c("relationship_type") != "NO_RELATIONSHIP")
    fields = ["query_id", "target_id", "relationship_type", "orientation", "identity", "aligned_length", *_SIDES, "accepted_hits", "rejected_hits"]
    pairs = rows.groupBy(F.least("query_id", "target_id").alias("a"), F.greatest("query_id", "target_id").alias("b")).agg(
        F.count("*").alias("n"), F.count_if("active").alias("active"),
        F.min(F.when(c("active"), F.struct(*fields))).alias("one"), F.max(F.when(c("active"), F.struct(*fields))).alias("two"),
        F.bool_or(c("relationship_type") == "AMBIGUOUS_OVERLAP").alias("vague"),
        F.sum("accepted_hits").alias("all_accepted"), F.sum("rejected_hits").alias("all_rejected"),
        F.sum(F.when(c("active"), c("accepted_hits")).otherwise(0)).alias("accepted"), F.sum(F.when(c("active"), c("rejected_hits")).otherwise(0)).alias("rejected"),
    ).where("active > 0")
    one, two = (lambda name: c(f"one.{name}")), (lambda name: c(f"two.{name}"))
    swap = F.create_map(*[F.lit(x) for x in (*_CONTAINED, *_CONTAINED[::-1])])
    overlap = F.create_map(*[F.lit(x) for x in ("QUERY_SUFFIX_TO_TARGET_PREFIX", "TARGET_SUFFIX_TO_QUERY_PREFIX", "TARGET_SUFFIX_TO_QUERY_PREFIX", "QUERY_SUFFIX_TO_TARGET_PREFIX")])
    kind = one("relationship_type")
    inverse = F.when(kind.isin(*_CONTAINED), F.try_element_at(swap, kind)).when(one("orientation") == "+", F.try_element_at(overlap, kind)).otherwise(kind)
    agree = (
        (two("relationship_type") == inverse) & (one("orientation") == two("orientation")) & (F.abs(one("identity") - two("identity")) <= 1e-12)
        & (one("query_start") == two("target_start")) & (one("query_end") == two("target_end"))
        & (one("target_start") == two("query_start")) & (one("target_end") == two("query_end"))
    )
    reasons = F.array_compact(F.array(
        F.when(c("active") < c("n"), _REASONS[0]), F.when(c("vague"), _REASONS[1]), F.when((c("active") > 1) & ~agree, _REASONS[2]),
    ))
    torn = F.size("why") > 0
    edge_kind = F.when(torn, "ambiguous").when(kind.isin(*_CONTAINED), "containment").otherwise("overlap")
    found = pairs.withColumn("why", reasons).withColumn("kind", edge_kind)
    return found.select(
        content_id("edge_", c("a"), c("b"), c("kind")).alias("edge_id"), "kind", "one.query_id", "one.target_id",
        F.when(torn, "AMBIGUOUS_OVERLAP").otherwise(kind).alias("relationship_type"), "one.orientation", "one.identity", "one.aligned_length",
        *[F.when(~torn, one(x)).alias(x) for x in _SIDES],
        F.when(torn, c("all_accepted")).otherwise(c("accepted")).alias("accepted_hits"), F.when(torn, c("all_rejected")).otherwise(c("rejected")).alias("rejected_hits"),
        F.array_join("why", "; ").alias("ambiguity_reasons"),
    )


def with_ports(overlaps: DataFrame) -> DataFrame:
    """``edge_id, node, port`` (prefix or suffix), two rows an overlap edge."""
    ahead = F.col("relationship_type") == "QUERY_SUFFIX_TO_TARGET_PREFIX"
    plain = F.col("orientation") == "+"
    q = F.when(ahead, "suffix").otherwise("prefix")
    t = F.when(ahead == plain, "prefix").otherwise("suffix")
    return overlaps.select("edge_id", F.explode(F.array(F.struct(F.col("query_id").alias("node"), q.alias("port")), F.struct(F.col("target_id").alias("node"), t.alias("port")))).alias("x")).select("edge_id", "x.*")


def with_children(containments: DataFrame) -> DataFrame:
    """``edge_id, child, parent`` and the intervals of both."""
    inner = F.col("relationship_type") == "QUERY_CONTAINED_IN_TARGET"
    pick = lambda a, b: F.when(inner, F.col(a)).otherwise(F.col(b))
    return containments.select(
        "edge_id", pick("query_id", "target_id").alias("child"), pick("target_id", "query_id").alias("parent"),
        pick("target_start", "query_start").alias("parent_start"), pick("target_end", "query_end").alias("parent_end"),
        "orientation", "identity",
    )


def node_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component_id, members``: over edges of every kind; a node without one is a component of its own.

    A component is named by the digest of its sorted members, whose names run
    through one hash; they are never in one row.
    """
    found = connected_components(edges, "query_id", "target_id", pin)
    labels = pin(nodes.select(F.col("sequence_id").alias("node")).join(found, "node", "left").select("node", F.coalesce("component", "node").alias("root")))
    named = pin(digest_of_each(labels.select("root", "node", F.col("node").alias("value")), "root", ["node"], "component_"))
    # A large component's nodes get its name by broadcast.
    found = join_named(labels, named.withColumn("n", F.col("rows")), "root", "n", labels.count())
    return found.select("node", F.col("digest").alias("component_id"), F.col("rows").alias("members"))


def digest_of_each(rows: DataFrame, key: str, order: list[str], prefix: str) -> DataFrame:
    """``<key>, digest, rows``: the content id of a key's ``value`` strings in the order given, and their count.

    The rows are sorted on disk and run through one hash, so a key of any size
    takes no more memory than a batch; a key's rows pass one task.
    """

    def work(batches):
        import pyarrow as pa

        now, digest, count = None, None, 0
        # The keys that have ended, as columns: most keys have few rows, so a batch of its own for each would be most of the work.
        keys, digests, counts = [], [], []

        def done():
            keys.append(now)
            digests.append(prefix + digest.hexdigest()[:20])
            counts.append(count)

        def taken():
            out = pa.RecordBatch.from_pydict({key: pa.array(keys, pa.string()), "digest": pa.array(digests, pa.string()), "rows": pa.array(counts, pa.int32())})
            for column in (keys, digests, counts):
                column.clear()
            return out

        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or k != now:
                    if digest is not None:
                        done()
                    now, digest, count = k, sha256(), 0
                if count:
                    digest.update(b"\0")
                digest.update(value.encode())
                count += 1
            if keys:
                yield taken()
        if digest is not None:
            done()
            yield taken()

    dealt = rows.where(F.col(key).isNotNull() & F.col("value").isNotNull()).repartition(key).sortWithinPartitions(key, *order)
    return dealt.select(key, "value").mapInArrow(work, f"{key} string, digest string, rows int")


def component_ambiguity(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``component_id, nodes, edges, overlap_edges, containment_edges, ambiguity_reasons`` (joined; empty: none), one row a component."""
    of = labels.select("node", "component_id")
    placed = edges.join(of, edges["query_id"] == of["node"]).drop("node")
    counts = placed.groupBy("component_id").agg(
        F.count("*").alias("edges"), F.count_if(F.col("kind") == "overlap").alias("overlap_edges"),
        F.count_if(F.col("kind") == "containment").alias("containment_edges"), F.count_if(F.col("kind") == "ambiguous").alias("vague_edges"),
    )
    overlaps = placed.where("kind = 'overlap'")
    children = with_children(placed.where("kind = 'containment'")).groupBy("child").agg(F.count("*").alias("n")).where("n > 1")
    rivals = with_ports(overlaps).groupBy("node", "port").agg(F.count("*").alias("n")).where("n > 1")
    flag = lambda found, node, name: found.join(of, found[node] == of["node"]).groupBy("component_id").agg(F.lit(True).alias(name))
    cycles, conflicts = overlap_faults(overlaps)
    flags = [
        flag(children, "child", "many_parents"), flag(rivals, "node", "rivals"),
        flag(cycles, "node", "cycle"), flag(conflicts, "node", "conflict"),
    ]
    sizes = labels.groupBy("component_id").agg(F.count("*").alias("nodes"))
    out = sizes.join(counts, "component_id", "left")
    for one in flags:
        out = out.join(one, "component_id", "left")
    # The reasons of an ambiguous component.
    reasons = F.array_compact(F.array(
        F.when(F.col("vague_edges") > 0, "component contains ambiguous pairwise evidence"),
        F.when(F.col("many_parents"), "contained sequence has multiple possible containers"),
        F.when(F.col("rivals"), "multiple overlaps compete for the same oriented terminal"),
        F.when(F.col("cycle"), "overlap subgraph contains a cycle"),
        F.when(F.col("conflict"), "overlap orientations are mutually inconsistent"),
    ))
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return out.select("component_id", "nodes", zero("edges"), zero("overlap_edges"), zero("containment_edges"), F.array_join(reasons, "; ").alias("ambiguity_reasons"))


#: The types an edge of each kind may have.
_TYPES_OF = {"containment": _CONTAINED, "overlap": ("QUERY_SUFFIX_TO_TARGET_PREFIX", "TARGET_SUFFIX_TO_QUERY_PREFIX"), "ambiguous": ("AMBIGUOUS_OVERLAP",)}


def graph_violations(nodes: DataFrame, edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``id, error``: what is wrong with a stored graph; empty if it is sound.

    Nodes (``sequence_id``) without a name or named twice; edges whose type
    doesn't go with their kind, whose ends are no nodes, or whose id occurs
    twice.  With ``labels`` (``node, component_id``) also nodes without a label, and
    components that are not those of the edges, which are worked out anew.
    """
    c = F.col
    ids = nodes.select("sequence_id")
    fits = F.lit(False)
    for kind, types in _TYPES_OF.items():
        fits = fits | ((c("kind") == kind) & c("relationship_type").isin(*types))
    ends = edges.select("edge_id", F.explode(F.array("query_id", "target_id")).alias("sequence_id"))
    found = [
        ids.where("sequence_id is null or sequence_id = ''").select(F.coalesce("sequence_id", F.lit("")).alias("id"), F.lit("empty node identifier").alias("error")),
        ids.groupBy("sequence_id").count().where("count > 1").select(c("sequence_id").alias("id"), F.lit("repeated node").alias("error")),
        edges.where(~F.coalesce(fits, F.lit(False))).select(c("edge_id").alias("id"), F.lit("incompatible kind or type").alias("error")),
        ends.join(ids, "sequence_id", "left_anti").select(c("edge_id").alias("id"), F.lit("unknown sequence identifier").alias("error")).distinct(),
        edges.groupBy("edge_id").count().where("count > 1").select(c("edge_id").alias("id"), F.lit("repeated edge").alias("error")),
    ]
    if labels is not None:
        anew = connected_components(edges, "query_id", "target_id", pin)
        met = ids.distinct().join(labels.select(c("node").alias("sequence_id"), "component_id"), "sequence_id", "left").join(anew.select(c("node").alias("sequence_id"), "component"), "sequence_id", "left")
        both = pin(met.select("sequence_id", "component_id", F.coalesce("component", "sequence_id").alias("root")))
        pairs = both.where("component_id is not null").groupBy("component_id", "root").agg(F.min("sequence_id").alias("one"))
        torn = pairs.groupBy("root").agg(F.count("*").alias("n"), F.min("one").alias("id")).where("n > 1").select("id", F.lit("component is torn apart").alias("error"))
        mixed = pairs.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select(c("component_id").alias("id"), F.lit("component joins nodes without a path").alias("error"))
        found += [both.where("component_id is null").select(c("sequence_id").alias("id"), F.lit("node without a component").alias("error")), torn, mixed]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def overlap_faults(overlaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node`` of each cyclic component of the overlap edges, which has at least as many edges as nodes; and ``node`` of nodes that must lie on both strands.

    Both come from the components of the signed double cover: a node on both
    strands has both of its signs in one of them, and without the signs those
    of a component and of its mirror image are those of the overlap edges.
    """
    # NUL is less than any symbol of a name, so names are in order with their signs too.
    signed = overlaps.select("query_id", "target_id", "orientation", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("sign"))
    other = F.when(F.col("orientation") == "+", F.col("sign")).otherwise(F.translate("sign", "+-", "-+"))
    cover = signed.select(F.concat("query_id", F.lit("\0"), "sign").alias("x"), F.concat("target_id", F.lit("\0"), other).alias("y"))
    bare = lambda name: F.expr(f"substring({name}, 1, length({name}) - 2)")
    found = connected_components(cover, "x", "y", pin).select(bare("node").alias("node"), "component")
    conflicts = found.groupBy("node", "component").agg(F.count("*").alias("n")).where("n > 1").select("node").distinct()
    of = found.select("node", bare("component").alias("root")).distinct()
    nodes = of.groupBy("root").agg(F.count("*").alias("nodes"))
    edges = overlaps.join(of, overlaps["query_id"] == of["node"]).groupBy("root").agg(F.count("*").alias("edges"))
    # A node that only loops lead to has no other edge.
    return nodes.join(edges, "root").where("edges >= nodes and nodes > 1").select(F.col("root").alias("node")), conflicts


def overlap_cycles(overlaps: DataFrame) -> DataFrame:
    """``node``: one node of each cyclic component of the overlap edges."""
    return overlap_faults(overlaps)[0]


def orientation_conflicts(overlaps: DataFrame) -> DataFrame:
    """``node``: nodes that must lie on both strands."""
    return overlap_faults(overlaps)[1]
