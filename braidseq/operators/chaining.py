"""From seeds to gapped alignments: anchors, collinear chains, and paths through the bases along a chain.

Anchors of a pair that lie on near diagonals form a cluster; the longest run in
a cluster that rises on both sides (a longest increasing subsequence) is a
chain.  The bases along a chain are aligned by banded dynamic programming
(``gapped``).  Only the blocks of a target that a chain touches meet the query,
so a long target is never moved whole.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import many
from .gapped import BLOCK_BYTES, MATCH, Path, Task, align_all, cigar, joined

#: Diagonals further apart than this are of two clusters; how far a path may leave the diagonals of its chain.
BAND, MARGIN = 64, 16
#: Bases of a target that move together.
BLOCK = 4096
#: Query bases between anchors at which a long pair is cut; pairs aligned at once.
PIECE, PAIRS = 2000, 512
#: Anchors that are sorted at once.
POINTS = 1_000_000

CHAIN_COLUMNS = "orientation string, chain int, anchors int, rival int, low int, high int, q array<int>, t array<int>"


def anchors(query_seeds: DataFrame, target_seeds: DataFrame, kmer: int, also: tuple[str, ...] = (), on: tuple[str, ...] = ("value", "kmer")) -> DataFrame:
    """``query_id, target_id, orientation, q, t``: places of one minimiser on both sides.

    Both: ``sequence_id, position, orientation``, the columns ``on`` that name a
    minimiser, and the columns ``also``, which must agree too.  On the other strand ``q`` counts from the
    query's end: minus the place where the seed ends.
    """
    a = query_seeds.select(*on, *also, F.col("sequence_id").alias("query_id"), F.col("position").alias("p"), F.col("orientation").alias("qo"))
    b = target_seeds.select(*on, *also, F.col("sequence_id").alias("target_id"), F.col("position").alias("t"), F.col("orientation").alias("to"))
    same = F.col("qo") == F.col("to")
    met = a.join(b, [*on, *also])
    return met.select("query_id", "target_id", F.when(same, "+").otherwise("-").alias("orientation"), F.when(same, F.col("p")).otherwise(-F.col("p") - kmer).cast("int").alias("q"), F.col("t").cast("int").alias("t"))


def longest_rise(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of (t, q) that rises strictly in both; of equally long ones that which ends lowest."""
    ordered = sorted(set(points), key=lambda p: (p[0], -p[1]))
    ends, at, before = [], [], [-1] * len(ordered)
    for i, (_, q) in enumerate(ordered):
        k = bisect_left(ends, q)
        if k == len(ends):
            ends.append(q)
            at.append(i)
        elif q < ends[k]:
            ends[k], at[k] = q, i
        before[i] = at[k - 1] if k else -1
    run, i = [], at[-1] if at else -1
    while i >= 0:
        run.append(ordered[i])
        i = before[i]
    return run[::-1]


def best_chains(cluster: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The longest run of a cluster; where whole diagonals are as long, each of them, so that repeats compete instead of being mixed."""
    run = longest_rise(cluster)
    lines: dict[int, set[tuple[int, int]]] = {}
    for t, q in cluster:
        lines.setdefault(t - q, set()).add((t, q))
    return [sorted(line) for _, line in sorted(lines.items()) if len(line) == len(run)] or [run]


def clusters(points: list[tuple[int, int]], band: int) -> list[list[tuple[int, int]]]:
    """Points (t, q) by diagonal: a new cluster where the next diagonal is more than ``band`` away."""
    out, last = [], None
    for t, q in sorted(points, key=lambda p: (p[0] - p[1], p)):
        if last is None or t - q - last > band:
            out.append([])
        out[-1].append((t, q))
        last = t - q
    return out


def chains(found: DataFrame, least: int = 3, band: int = BAND, only_best: bool = False) -> DataFrame:
    """``query_id, target_id, orientation, chain, anchors, rival, low, high, q, t`` from ``anchors``: one row a chain of ``least`` anchors or more.

    A cluster of diagonals gives its ``best_chains``.
    ``low`` and ``high`` bound the chain's diagonals, ``rival`` is the largest
    number of anchors in another chain of the pair, on either strand.  With
    ``only_best`` a pair has the chains with most anchors alone, ties all.  A
    pair's anchors are no more than the query's seeds times the most frequent
    one's places in the target.
    """
    kinds = dict(found.dtypes)
    grouped = found.groupBy("query_id", "target_id").agg(F.collect_list(F.struct((F.col("orientation") == "-").alias("minus"), "t", "q")).alias("seeds"))

    def run(batches):
        import pyarrow as pa

        names = ["query_id", "target_id", *[c.split()[0] for c in CHAIN_COLUMNS.split(", ")]]
        for batch in batches:
            ends, low = np.cumsum(batch.column("seeds").value_lengths().to_numpy(zero_copy_only=False)), 0
            while low < batch.num_rows:  # so many pairs at once that their anchors are few enough
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + POINTS, side="right")))
                part = batch.slice(low, high - low)
                low = high
                seeds = part.column("seeds")
                flat = seeds.flatten()
                rows = np.repeat(np.arange(part.num_rows), seeds.value_lengths().to_numpy(zero_copy_only=False))
                places, minus, numbers, counts, rivals, q, t = _chains_of(rows, *(flat.field(x).to_numpy(zero_copy_only=False) for x in ("minus", "t", "q")), least, band, only_best)
                offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
                lean = t - q
                edges = [f.reduceat(lean, offsets[:-1]) if len(counts) else counts for f in (np.minimum, np.maximum)]
                columns = [pa.array(np.where(minus, "-", "+").tolist(), pa.string()), *(pa.array(x.astype(np.int32)) for x in (numbers, counts, rivals, *edges)), *(pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (q, t))]
                yield pa.RecordBatch.from_arrays([*part.select(["query_id", "target_id"]).take(pa.array(places)).columns, *columns], names)

    return grouped.mapInArrow(run, f"query_id {kinds['query_id']}, target_id {kinds['target_id']}, {CHAIN_COLUMNS}")


def _distinct_in(groups, values, n: int):
    """How many distinct values each of ``n`` groups has."""
    order = np.lexsort((values, groups))
    g, v = groups[order], values[order]
    new = np.append(True, (g[1:] != g[:-1]) | (v[1:] != v[:-1]))[: len(g)]
    return np.bincount(g[new], minlength=n)


def _chains_of(rows, minus, t, q, least: int, band: int, only_best: bool):
    """Of the anchors of many pairs (``rows``): each chain's pair, strand, number in the pair, anchors and rival, and the places of all anchors, chain by chain.

    Clusters are those of ``clusters``, chains those of ``best_chains``.  No
    chain of a cluster has more anchors than there are distinct places on either
    side; where a diagonal has so many, the longest diagonals are the chains.
    Of other clusters the longest rise is looked for, with ``only_best`` in
    those that may give a pair's best chain or its rival.
    """
    t, q, minus = t.astype(np.int64), q.astype(np.int64), minus.astype(bool)
    lean = t - q
    order = np.lexsort((t, lean, minus, rows))
    rows, minus, t, q, lean = rows[order], minus[order], t[order], q[order], lean[order]
    other = np.append(True, (rows[1:] != rows[:-1]) | (minus[1:] != minus[:-1]))[: len(rows)]
    step = np.append(0, lean[1:] - lean[:-1])[: len(rows)]
    new = other | (step != 0) | np.append(True, t[1:] != t[:-1])[: len(rows)]
    cluster_starts, line_starts = (other | (step > band))[new], (other | (step != 0))[new]
    rows, minus, t, q = rows[new], minus[new], t[new], q[new]
    cluster = np.cumsum(cluster_starts) - 1
    line_at = np.flatnonzero(line_starts)
    line_size, line_cluster = np.diff(line_at, append=len(t)), cluster[line_at]
    cluster_at = np.flatnonzero(cluster_starts)
    n = len(cluster_at)
    size, first_line = np.diff(cluster_at, append=len(t)), np.searchsorted(line_cluster, np.arange(n))
    longest = np.maximum.reduceat(line_size, first_line) if n else size
    lines = np.diff(first_line, append=len(line_at))
    # No more anchors than this are in a chain of the cluster.
    bound = np.where(lines == 1, size, 0)
    several = (lines > 1) & (size >= least)
    if several.any():
        inner = several[cluster]
        bound = np.where(several, np.minimum(_distinct_in(cluster[inner], t[inner], n), _distinct_in(cluster[inner], q[inner], n)), bound)
    plain = (longest == bound) & (bound >= least)
    chosen = plain[line_cluster] & (line_size == longest[line_cluster])
    begin, count = line_at[chosen], line_size[chosen]
    made = [(rows[begin], minus[begin], count, t[begin], q[begin], begin)]
    left = np.flatnonzero((bound > longest) & (bound >= least))
    risen: list[list[tuple[int, int]]] = []
    if len(left):
        if only_best:
            # The two largest numbers of anchors of a pair's chains so far, any cluster's longest diagonal being the least that it gives.
            sure_rows, sure = np.append(rows[begin], rows[cluster_at[left]]), np.append(count, longest[left])
            kept = sure >= least
            by = np.lexsort((-sure[kept], sure_rows[kept]))
            sure_rows, sure = sure_rows[kept][by], sure[kept][by]
            heads = np.flatnonzero(np.append(True, sure_rows[1:] != sure_rows[:-1])[: len(sure_rows)])
            best, second = np.zeros(rows[-1] + 1, dtype=np.int64), np.zeros(rows[-1] + 1, dtype=np.int64)
            best[sure_rows[heads]] = sure[heads]
            following = heads + 1
            paired = following[(following < len(sure_rows))]
            paired = paired[sure_rows[paired] == sure_rows[paired - 1]]
            second[sure_rows[paired]] = sure[paired]
            of = rows[cluster_at[left]]
            left = left[(bound[left] > second[of]) | ((bound[left] == second[of]) & (second[of] == best[of])) | (longest[left] == second[of])]
        found = []
        for k in left.tolist():
            own = slice(int(cluster_at[k]), int(cluster_at[k] + size[k]))
            for chain in best_chains(list(zip(t[own].tolist(), q[own].tolist()))):
                if len(chain) >= least:
                    found.append((int(rows[own.start]), bool(minus[own.start]), len(chain), *chain[0], -1 - len(risen)))
                    risen.append(chain)
        if found:
            made.append(tuple(np.array(x) for x in zip(*found)))
    places, strands, counts, first_t, first_q, source = (np.concatenate(x) for x in zip(*made))
    order = np.lexsort((first_q, first_t, strands, -counts, places))
    places, strands, counts, source = places[order], strands[order], counts[order], source[order]
    heads = np.flatnonzero(np.append(True, places[1:] != places[:-1])[: len(places)])
    many = np.diff(heads, append=len(places))
    best = np.repeat(counts[heads], many)
    after = np.where(many > 1, counts[np.minimum(heads + 1, max(len(counts) - 1, 0))], 0) if len(heads) else many
    rivals = np.where(counts == best, np.repeat(after, many), best)
    numbers = np.arange(len(places)) - np.repeat(heads, many)
    if only_best:
        kept = counts == best
        places, strands, counts, source, rivals, numbers = (x[kept] for x in (places, strands, counts, source, rivals, numbers))
    sides = []
    for k, side in ((1, q), (0, t)):
        sides.append(np.concatenate([side[s : s + m] if s >= 0 else np.array([p[k] for p in risen[-1 - s]]) for s, m in zip(source.tolist(), counts.tolist())]) if len(source) else np.zeros(0, dtype=np.int64))
    return places, strands.astype(bool), numbers, counts, rivals, *sides


def _along(query: bytes, target: bytes, chain: list[tuple[int, int]], low: int, high: int) -> list[tuple[Task, bool, bool]]:
    """What is to be aligned: the whole pair, or pieces that meet at anchors where the whole is too large for a block."""
    if len(query) * (high - low + 1) <= BLOCK_BYTES:
        return [(Task(query, target, low, high), True, True)]
    cuts = []
    for t, q in chain:
        if q - (cuts[-1][1] if cuts else 0) >= PIECE:
            cuts.append((t, q))
    out, at_t, at_q = [], 0, 0
    for k, (t, q) in enumerate(cuts):
        out.append((Task(query[at_q:q], target[at_t:t], low - (at_t - at_q), high - (at_t - at_q)), k == 0, False))
        at_t, at_q = t, q
    out.append((Task(query[at_q:], target[at_t:], low - (at_t - at_q), high - (at_t - at_q)), not cuts, True))
    return out


def _shifted(path: Path, q: int, t: int) -> Path:
    return Path(path.score, path.query_start + q, path.query_end + q, path.target_start + t, path.target_end + t, path.matches, path.steps)


def paths_along(pairs: list[tuple[bytes, bytes, list[tuple[int, int]], int, int]]) -> list[Path | None]:
    """For each (query, target, chain, low, high), all in the places of these bytes, the best path near the chain.

    A query that its one diagonal matches from end to end needs no matrix: no
    path scores more.
    """
    out: list[Path | None] = [None] * len(pairs)
    work: dict[tuple[bool, bool], list[tuple[int, int, Task]]] = {}
    parts: dict[int, list] = {}
    for i, (query, target, chain, low, high) in enumerate(pairs):
        lean = chain[0][0] - chain[0][1]
        if lean >= 0 and target[lean : lean + len(query)] == query:
            if low + MARGIN == high - MARGIN:
                out[i] = Path(MATCH * len(query), 0, len(query), lean, lean + len(query), len(query), (("M", len(query)),))
                continue
        parts[i] = [None] * len(pieces := _along(query, target, chain, low, high))
        for k, (task, free_start, free_end) in enumerate(pieces):
            work.setdefault((free_start, free_end), []).append((i, k, task))
    for (free_start, free_end), tasks in work.items():
        for (i, k, _), path in zip(tasks, align_all([t for _, _, t in tasks], free_start, free_end)):
            parts[i][k] = path
    for i, found in parts.items():
        if len(found) == 1:
            out[i] = found[0]
        elif all(p is not None for p in found):
            whole, at_q, at_t = [], 0, 0
            for piece, (task, _, _) in zip(found, _along(*pairs[i])):
                whole.append(_shifted(piece, at_q, at_t))
                at_q, at_t = at_q + len(task.query), at_t + len(task.target)
            out[i] = Path(sum(p.score for p in whole), whole[0].query_start, whole[-1].query_end, whole[0].target_start, whole[-1].target_end, sum(p.matches for p in whole), joined(s for p in whole for s in p.steps))
    return out


#: Bases and their complements.
TURN = bytes.maketrans(b"ACGTRYSWKMBDHVN", b"TGCAYRSWMKVHDBN")

HIT_COLUMNS = (
    "query_length int, query_start int, query_end int, orientation string, target_length int, target_start int, target_end int, "
    "matching_bases int, alignment_block_length int, mapping_quality int, score int, cigar string"
)


def aligned(chained: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Hits, with ``score``, ``cigar`` and ``mapping_quality``, of the rows of ``chains``: the best gapped path near each.

    ``queries`` and ``targets``: ``sequence_id, sequence``, one row an id.  In
    hits both intervals are on the forward strand; the CIGAR follows the
    target.  The quality is 60 times the share of anchors that the best rival
    lacks: 0 for ties.
    """
    c = F.col
    kinds = dict(chained.dtypes)
    lengths = queries.select(c("sequence_id").alias("query_id"), F.length("sequence").alias("query_length"))
    turned = F.when(c("orientation") == "-", c("query_length")).otherwise(0)
    placed = (
        chained.join(lengths, "query_id").withColumn("low", c("low") - turned - MARGIN).withColumn("high", c("high") - turned + MARGIN)
        .withColumn("first_block", F.expr(f"cast(greatest(low, 0) div {BLOCK} as int)"))
        .withColumn("last_block", F.expr(f"cast(greatest(query_length + high, 0) div {BLOCK} as int)"))
    )
    cut = f"""transform(array(cast(sequence as binary)), b -> transform(sequence(0, (length(sequence) - 1) div {BLOCK}), i -> substring(b, i * {BLOCK} + 1, {BLOCK})))[0]"""
    blocks = targets.where(F.length("sequence") > 0).select(c("sequence_id").alias("target_id"), F.length("sequence").alias("target_length"), F.posexplode(F.expr(cut)).alias("block", "bases"))
    own = [x for x in placed.columns if x not in ("query_id", "target_id", "chain")]
    met = placed.withColumn("block", F.explode(F.sequence("first_block", "last_block"))).join(blocks, ["target_id", "block"])
    windows = met.groupBy("query_id", "target_id", "chain").agg(
        F.any_value(F.struct(*own)).alias("own"), F.any_value("target_length").alias("target_length"), F.array_sort(F.collect_list(F.struct("block", "bases"))).alias("blocks")
    )
    # Little data and much work: tasks of a number, which aren't united by their size.
    parts = 4 * many(chained.sparkSession)
    ready = windows.repartition(parts, "query_id").join(queries.select(c("sequence_id").alias("query_id"), c("sequence").cast("binary").alias("query")).repartition(parts, "query_id"), "query_id")
    ready = ready.select("query_id", "target_id", "own.*", "target_length", "query", F.expr("transform(blocks, x -> x.bases)").alias("window"))

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, PAIRS):
                batch = whole.slice(at, PAIRS)
                rows, pairs = batch.drop_columns(["query_id", "target_id"]).to_pylist(), []
                for r in rows:
                    base, n = r["first_block"] * BLOCK, r["query_length"]
                    turned = r["orientation"] == "-"
                    query = r["query"].translate(TURN)[::-1] if turned else r["query"]
                    chain = [(t - base, q + n * turned) for t, q in zip(r["t"], r["q"])]
                    pairs.append((query, b"".join(r["window"]), chain, r["low"] - base, r["high"] - base))
                keep, out = [], []
                for i, (r, p) in enumerate(zip(rows, paths_along(pairs))):
                    if p is None:
                        continue
                    n, base, turned = r["query_length"], r["first_block"] * BLOCK, r["orientation"] == "-"
                    start, end = (n - p.query_end, n - p.query_start) if turned else (p.query_start, p.query_end)
                    quality = 60 * (r["anchors"] - min(r["rival"], r["anchors"])) // r["anchors"]
                    keep.append(i)
                    out.append((n, start, end, r["orientation"], r["target_length"], p.target_start + base, p.target_end + base, p.matches, sum(k for _, k in p.steps), quality, p.score, cigar(p.steps)))
                names = [x.split()[0] for x in HIT_COLUMNS.split(", ")]
                types = [pa.string() if x.endswith("string") else pa.int32() for x in HIT_COLUMNS.split(", ")]
                taken = batch.select(["query_id", "target_id"]).take(pa.array(keep, pa.int32()))
                columns = list(zip(*out)) if out else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(x, t) for x, t in zip(columns, types))], ["query_id", "target_id", *names])

    return ready.mapInArrow(run, f"query_id {kinds['query_id']}, target_id {kinds['target_id']}, {HIT_COLUMNS}")
