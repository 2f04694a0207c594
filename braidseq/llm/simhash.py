"""SimHash fingerprints and near-duplicate components by multi-index hashing.

A fingerprint's 64 bits are cut into ``m`` segments.  Two fingerprints within
``r`` bits, ``r = m * q + a``, agree within ``q`` bits in one of the first
``a + 1`` segments or within ``q - 1`` bits in one of the others.  So the
values in a small Hamming ball around each segment are enumerated and looked up
in a table of the segments of all fingerprints; matches are verified on the
complete distance inside the join, so that only true links leave it.

Documents with one fingerprint are one node: a group of copies, however large,
is one row of every table.  A cloud of near copies is first joined by stars:
each fingerprint is compared with the least one that has its segment.  After
that only links between different stars leave the join, as pairs of stars.

A segment that many fingerprints share is split by their other bits.

``near_components`` links by fingerprints alone.  ``keep_one_of_each`` takes
fingerprints, whole and partial ones, as a search only and links texts by the
exact similarity of their word shingles.
"""

from __future__ import annotations

from itertools import combinations
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.skew import join_named
from .common import append_columns, pin
from .url_cascade import Cascade, _build

BITS = 64
#: Up to so many different fingerprints three segments are used, two beyond it: longer segments, so shorter lists in the table.
THREE_SEGMENTS_UPTO = 100_000_000
#: A segment's value that more fingerprints than this have is split by the other bits, in so many parts.
HOT_KEY, OUTSIDE = 1000, 3


def _shingle_hashes(text: bytes, shingle: int, seed: int) -> list[int]:
    """XXH64 of each shingle of the lower-cased words, repeats included; fewer words are one shingle."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return []
    plain = b" ".join(words)
    ends, at = [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: max(0, len(words) - shingle)]]]
    return [xxh64_intdigest(plain[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :] or ends[-1:])]


def _majority():
    """A function from hashes, and how many of them are each group's, to the groups' fingerprints: bits that more than half of them have."""
    import numpy as np

    # Eight counters of eight bits in a word, one for each bit of a byte.
    spread = np.zeros(256, dtype=np.uint64)
    for byte in range(256):
        spread[byte] = sum(1 << (8 * bit) for bit in range(8) if byte >> bit & 1)

    def vote(hashes, counts):
        n = np.asarray(counts, dtype=np.int64)
        out = np.zeros(len(n), dtype=np.int64)
        full = np.flatnonzero(n)
        if len(full):
            lanes = spread[np.asarray(hashes, dtype=np.uint64).view(np.uint8)].reshape(-1, 8)
            # Runs of 255 at most, for the counters' sake; then the runs of a group.
            size, first = n[full], (np.cumsum(n) - n)[full]
            runs = -(-size // 255)
            before = np.cumsum(runs) - runs
            at = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - np.repeat(before, runs))
            sums = np.add.reduceat(lanes, at, axis=0).view(np.uint8).reshape(-1, BITS)
            ones = np.add.reduceat(sums.astype(np.int64), before, axis=0)
            bits = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little")
            out[full] = np.ascontiguousarray(bits).view(np.int64).ravel()
        return out

    return vote


def _fingerprinter(text_col: str, shingle: int, seed: int):
    def start():
        vote = _majority()

        def work(batch):
            found = [_shingle_hashes((text or "").encode(), shingle, seed) for text in batch.column(text_col).to_pylist()]
            return [vote([h for own in found for h in own], [len(own) for own in found])]

        return work

    return start


def simhash(docs: DataFrame, text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` with ``simhash`` (long, the 64 bits): A-Z lower-cased, ASCII white space between words.

    Null, empty and blank texts have fingerprint 0; texts of fewer than
    ``shingle`` words have one shingle, all their words.  A bit is 1 if more
    than half of the shingles' XXH64 values, repeats counted, have it.
    """
    return append_columns(docs, "simhash long", text_col, _fingerprinter(text_col, shingle, seed), most_bytes=2_000_000)


def hexadecimal(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def ball_radii(radius: int, segments: int) -> list[int]:
    """How far each segment's ball reaches so that no pair within ``radius`` is lost; -1: the segment isn't needed."""
    whole, rest = divmod(radius, segments)
    return [whole if i <= rest else whole - 1 for i in range(segments)]


def _segments(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each."""
    out, shift = [], 0
    for i in range(segments):
        width = BITS // segments + (i < BITS % segments)
        out.append((shift, width))
        shift += width
    return out


def _number_of_segments(nodes: int) -> int:
    return 3 if nodes <= THREE_SEGMENTS_UPTO else 2


def _tagged(value: Column, segment: int) -> Column:
    """The key of a segment's value; BITS / 2 bits of value at most."""
    return value.bitwiseOR(F.lit(segment << 56))


def _segment_keys(fp: Column, segments: int, reaches: list[int]) -> list[Column]:
    """The keys of all values within ``reaches[i]`` bits of segment ``i`` of ``fp``; -1: none."""
    keys = []
    for i, ((shift, width), reach) in enumerate(zip(_segments(segments), reaches, strict=True)):
        value = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))
        for size in range(reach + 1):
            keys += [_tagged(value.bitwiseXOR(F.lit(sum(1 << b for b in bits))), i) for bits in combinations(range(width), size)]
    return keys


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def near_links(fingerprints: DataFrame, radius: int = 4, segments: int = 3) -> DataFrame:
    """``left, right``: the pairs of different values of the column ``fp`` within ``radius`` bits; a pair may repeat.

    ``fp`` must hold no value twice and no null.  If there is a column
    ``group``, only pairs of different groups are given, with ``left_group`` and
    ``right_group``.  More segments mean shorter segments, so fewer probes a
    fingerprint but longer lists in the table: for 4 bits 3 segments (25
    probes) suit up to about 10^8 values, 2 (some 300) more than that.
    """
    if not 0 < radius < BITS or not 2 <= segments <= 16:
        raise ValueError("radius from 1 to 63, segments from 2 to 16")
    fp = F.col("fp")
    stored, probes, places = [], [], list(zip(_segments(segments), ball_radii(radius, segments)))
    for i, ((shift, width), reach) in enumerate(places):
        if reach < 0:
            continue
        value = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))
        stored.append(_tagged(value, i))
        probes.append(F.struct(_tagged(value, i).alias("key"), F.lit(False).alias("moved")))
        for size in range(1, reach + 1):
            for bits in combinations(range(width), size):
                mask = sum(1 << b for b in bits)
                moved = F.struct(_tagged(value.bitwiseXOR(F.lit(mask)), i).alias("key"), F.lit(True).alias("moved"))
                # Of the two directions of a probe only that from the side whose lowest differing bit is 0.
                probes.append(F.when(value.bitwiseAND(F.lit(1 << bits[0])) == 0, moved))
    grouped = "group" in fingerprints.columns
    more = lambda side: [F.col("group").alias(f"{side}_group")] if grouped else []
    table = fingerprints.select(fp.alias("right"), *more("right"), F.explode(F.array(*stored)).alias("key"))
    asked = fingerprints.select(fp.alias("left"), *more("left"), F.explode(F.array_compact(F.array(*probes))).alias("probe")).select("*", "probe.key", "probe.moved").drop("probe")
    # A key that many fingerprints have is split by the bits outside its segment, of which a pair differs in ``radius`` at most.
    often = pin(table.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_KEY).select("key"))
    hot, split = F.broadcast(often), not often.isEmpty()
    once = (F.col("moved") & (F.col("left") != F.col("right"))) | (F.col("left") < F.col("right"))
    wanted = (_distance("left", "right") <= radius) & once
    if grouped:
        wanted = wanted & (F.col("left_group") != F.col("right_group"))
    if not split:
        return asked.join(table, (asked["key"] == table["key"]) & wanted).drop("key", "moved")
    cold_asked, cold_table = asked.join(hot, "key", "left_anti"), table.join(hot, "key", "left_anti")
    cold = cold_asked.join(cold_table, (cold_asked["key"] == cold_table["key"]) & wanted).drop("key", "moved")
    held = table.join(hot, "key").withColumn("part", F.explode(F.array(*_outside_keys("right", segments, [0] * OUTSIDE))))
    sought = asked.join(hot, "key").withColumn("part", F.explode(F.array(*_outside_keys("left", segments, ball_radii(radius, OUTSIDE)))))
    warm = sought.join(held, (sought["key"] == held["key"]) & (sought["part"] == held["part"]) & wanted).drop("key", "moved", "part")
    return cold.unionByName(warm)


def _outside_keys(fp: str, segments: int, reaches: list[int]) -> list[Column]:
    """Keys of the values within ``reaches[i]`` bits of part ``i`` of the bits outside the segment that the column ``key`` is of."""
    outside, places = None, _segments(segments)
    for i, (shift, width) in enumerate(places):
        high = F.shiftleft(F.shiftrightunsigned(F.col(fp), shift + width), shift) if shift + width < BITS else F.lit(0).cast("long")
        rest = high.bitwiseOR(F.col(fp).bitwiseAND(F.lit((1 << shift) - 1)))
        mine = F.shiftrightunsigned("key", 56) == i
        outside = F.when(mine, rest) if outside is None else outside.when(mine, rest)
    # The widths are those of the longest remainder; bits beyond a shorter one are zero on both sides.
    bits = BITS - min(width for _, width in places)
    keys, shift = [], 0
    for i, reach in enumerate(reaches):
        width = bits // OUTSIDE + (i < bits % OUTSIDE)
        value = F.shiftrightunsigned(outside, shift).bitwiseAND(F.lit((1 << width) - 1))
        for size in range(reach + 1):
            keys += [_tagged(value.bitwiseXOR(F.lit(sum(1 << b for b in own))), i) for own in combinations(range(width), size)]
        shift += width
    return keys


def _stars(fingerprints: DataFrame, radius: int, segments: int, total: int) -> DataFrame:
    """``left, right``: each ``fp`` and the least one that has one of its segments, if within ``radius``.  No pairs are enumerated."""
    table = fingerprints.select("fp", F.explode(F.array(*_segment_keys(F.col("fp"), segments, [0] * segments))).alias("key"))
    least = table.groupBy("key").agg(F.min("fp").alias("least"), F.count("*").alias("n"))
    met = join_named(table, least, "key", "n", total * segments)
    return met.where((F.col("fp") != F.col("least")) & (_distance("fp", "least") <= radius)).select(F.col("fp").alias("left"), F.col("least").alias("right")).distinct()


def linked_fingerprints(fingerprints: DataFrame, radius: int, segments: int | None = None) -> DataFrame:
    """``fp, group`` for every value of the column ``fp`` (distinct, no nulls): values that links of ``radius`` bits connect share ``group``, the least of them."""
    total = fingerprints.count()
    segments = segments or _number_of_segments(total)
    starred = connected_components(_stars(fingerprints, radius, segments, total), "left", "right", pin)
    first = pin(fingerprints.join(starred, fingerprints["fp"] == starred["node"], "left").select("fp", F.coalesce("component", "fp").alias("group")))
    links = near_links(first, radius, segments).select(F.least("left_group", "right_group").alias("a"), F.greatest("left_group", "right_group").alias("b")).distinct()
    joined = connected_components(links, "a", "b", pin)
    met = first.join(joined, first["group"] == joined["node"], "left")
    return met.select("fp", F.coalesce("component", "group").alias("group"))


def _named_after_least(nodes: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """``fp, component_id, n`` from ``fp, first, n`` and ``fp, group``: the least ``first`` of the group."""
    members = pin(nodes.join(groups, "fp"))
    least = members.groupBy("group").agg(F.min("first").alias("component_id"), F.count("*").alias("in_group"))
    return join_named(members, least, "group", "in_group", total).select("fp", "component_id", "n")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, segments: int | None = None, shingle: int = 4) -> DataFrame:
    """``<id>, simhash, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id that links reach, its own included;
    null ids count only where a component has no other.  Rows with equal ids
    are rows of their own.  Null, empty and blank texts have fingerprint 0,
    which is linked like any other.  Other columns of ``docs`` are left out, so
    none can clash.  Empty tables give empty results.
    """
    rows = pin(simhash(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", shingle).select("id", F.col("simhash").alias("fp")))
    nodes = pin(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    total = rows.count()
    named = pin(_named_after_least(nodes, linked_fingerprints(nodes.select("fp"), radius, segments), total))
    return join_named(rows, named, "fp", "n", total).select(F.col("id").alias(id_col), F.col("fp").alias("simhash"), "component_id")


# --- groups of similar texts

#: The search of ``keep_one_of_each``: fingerprints of two-word shingles that differ in so many bits at most.
SEARCH_WORDS, SEARCH_RADIUS = 2, 16
#: Partial fingerprints of a text at most, shingles that a sampled text has about (a power of two), and how far the numbers of shingles of similar texts lie apart.
PARTS, SAMPLED, APART = 16, 128, 1.12
#: Orders by which keys choose their stars: a text meets about twice so many of them, however many keys it shares.
ORDERS = 8
#: False positives of the filter that leaves out keys of one text, and its bits at most; it only spares shuffles.
SPARED, FILTER_BITS = 0.03, 1 << 25
#: Bytes of packed texts that are broadcast at most; larger tables of them are shuffled.
BROADCAST_BYTES = 32_000_000
#: Whole fingerprints within so many bits are all looked up; names of texts that are broadcast at most.
BALL_RADIUS, FEW_NAMES = 4, 20_000
#: What links two texts: five-word shingles whose sets are at least so similar, in hundredths.
WORDS, SIMILARITY = 5, 80


def _partial_fingerprints(hashes):
    """(shingles, their number in each part, names of the parts) of a text's different shingles.

    A part is a class of the shingles' hashes, of a sample of them in a long
    text; texts of similar length have the same classes.  Where the length is
    near the next size both divisions are given.
    """
    import numpy as np

    n = len(hashes)
    sizes = sorted({int(np.log2(max(n / APART, 1))), int(np.log2(n * APART))}) if n else []
    kept, counts, names = [], [], []
    most = SAMPLED.bit_length() - 1
    for size in sizes:
        own = hashes if size <= most else hashes[(hashes >> np.uint64(20)) % np.uint64(1 << (size - most)) == 0]
        parts = min(PARTS, 1 << max(0, size - 1))
        part = (own * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        met, times = np.unique(part, return_counts=True)
        kept.append(own[order])
        counts.append(times)
        names.append(met + np.uint64(size * PARTS))
    return kept, counts, names


def _searched(text_col: str):
    """``fp``, ``node``, which names the sequence of words, and ``parts``: the keys of the partial fingerprints."""

    def start():
        from hashlib import md5

        import numpy as np
        import pyarrow as pa

        vote = _majority()

        def work(batch):
            texts = [(t or "").encode() for t in batch.column(text_col).to_pylist()]
            found = [_shingle_hashes(t, SEARCH_WORDS, 42) for t in texts]
            whole = vote([h for own in found for h in own], [len(own) for own in found])
            kept, counts, names, sizes = [], [], [], []
            for own in found:
                parts = _partial_fingerprints(np.unique(np.array(own, dtype=np.uint64)))
                for held, more in zip((kept, counts, names), parts):
                    held += more
                sizes.append(sum(map(len, parts[1])))
            if kept:
                votes = vote(np.concatenate(kept), np.concatenate(counts)).view(np.uint64)
                keys = ((votes ^ np.concatenate(names) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            else:
                keys = np.zeros(0, dtype=np.int64)
            offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
            return [whole, [md5(b" ".join(t.lower().split())).digest() for t in texts], pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))]

        return work

    return start


def _packed_texts(text_col: str):
    def start():
        import pyarrow as pa

        def work(batch):
            texts = [b" ".join((text or "").encode().lower().split()) for text in batch.column(text_col).to_pylist()]
            return [[len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True) for x in texts]]

        return work

    return start


def _shingles(packed: bytes) -> set[bytes]:
    """The five-word shingles of a text of ``_packed_texts``."""
    import pyarrow as pa

    words = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True).split()
    return {b" ".join(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))} if words else set()


def _alike(batches):
    """The ``left, right`` of batches of pairs with both texts whose sets of shingles are similar enough."""
    import pyarrow as pa

    known = {"left": (None, None), "right": (None, None)}
    for batch in batches:
        kept = []
        for at in range(batch.num_rows):
            for side in known:
                held = batch.column(f"{side}_text")[at].as_py()
                if held != known[side][0]:  # pairs of a star often follow each other
                    known[side] = held, _shingles(held)
            left, right = known["left"][1], known["right"][1]
            both = len(left & right)
            if 100 * both >= SIMILARITY * (len(left) + len(right) - both):
                kept.append(at)
        yield batch.select(["left", "right"]).take(pa.array(kept, pa.int64()))


def _shared_keys(table: DataFrame) -> tuple[DataFrame, int]:
    """The rows of ``table`` (``key`` and others) whose key has several, and some more; and at least their number.

    Keys are counted alone, so only keys and counts are shuffled; a Bloom
    filter over those that repeat sorts out the rows where they lie.
    """
    counts = pin(table.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    row = counts.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    if not row["keys"]:
        return table.limit(0), 0
    rate = max(SPARED, exp(-FILTER_BITS * log(2) ** 2 / row["keys"]))
    if rate > 0.5:
        return table, row["rows"]
    # A table, however small: each probe in a plan would hold the literal again.
    one = Cascade((_build(counts, row["keys"], rate, 1, literal_words=0),), "shared")
    return one.detach(one.attach(table).where(one.holds(F.col("key")))), row["rows"]


def _candidates(nodes: DataFrame) -> DataFrame:
    """``left, right, far``: pairs of different nodes, each node with two stars of each of its keys, if their fingerprints differ in ``SEARCH_RADIUS`` bits at most.

    A key's stars are the nodes that come first and last in one of ``ORDERS``
    orders, which the key chooses.  So the pairs grow with the nodes, however
    many share a key, and nodes that share many keys meet several others.  If
    there is a column ``group``, only pairs of different groups are given: the
    same pairs otherwise, and none of one group is ever made.
    """
    c = F.col
    more = ["group"] if "group" in nodes.columns else []
    table, total = _shared_keys(nodes.select("id", "fp", *more, F.explode("parts").alias("key")))
    one = F.struct(F.xxhash64("id", F.pmod("key", F.lit(ORDERS))).alias("order"), "id", "fp", *more)
    stars = table.groupBy("key").agg(F.min(one).alias("first"), F.max(one).alias("last"), F.count("*").alias("n")).where("n > 1")
    met = join_named(table, stars, "key", "n", total).select("id", "fp", *more, F.explode(F.array("first", "last")).alias("star"))
    far = F.bit_count(c("fp").bitwiseXOR(c("star.fp")))
    near = met.where((c("group") != c("star.group") if more else c("id") != c("star.id")) & (far <= SEARCH_RADIUS))
    return near.select(c("id").alias("left"), c("star.id").alias("right"), far.alias("far")).distinct()


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``left, right`` of ``pairs`` (distinct) whose sets of shingles are similar enough.

    ``texts``: ``id, packed``.  Packed texts move, which take a fourth of what
    their shingles' hashes do; the sets are made where both texts have met.
    """
    pairs = pin(pairs.select("left", "right"))
    total = pairs.count()
    met = pairs
    size = texts.agg(F.coalesce(F.sum(F.octet_length("packed") + 64), F.lit(0)).alias("bytes")).first()["bytes"]
    for side in ("left", "right"):
        own = texts.select(F.col("id").alias(side), F.col("packed").alias(f"{side}_text"))
        if size <= BROADCAST_BYTES:
            met = met.join(F.broadcast(own), side)
            continue
        met = join_named(met, own.join(pairs.groupBy(side).agg(F.count("*").alias("n")), side), side, "n", total)
    kinds = dict(pairs.dtypes)
    return pin(met.select("left", "right", "left_text", "right_text").mapInArrow(_alike, f"left {kinds['left']}, right {kinds['right']}"))


def _in_order(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).distinct()


def _grouped(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with ``group``: the least ``id`` that ``links`` connect to a node."""
    joined = connected_components(links, "left", "right", pin).withColumnRenamed("node", "id")
    return pin(nodes.join(joined, "id", "left").withColumn("group", F.coalesce("component", "id")).drop("component"))


def _within_balls(grouped: DataFrame) -> DataFrame:
    """``left, right``: pairs of nodes of different groups whose whole fingerprints lie within ``BALL_RADIUS`` bits, found by multi-index hashing.

    A fingerprint of several nodes stands for the least of them, and the others
    are paired with it; so texts with one fingerprint are never all pairs.
    """
    c = F.col
    one = pin(grouped.groupBy("fp").agg(F.min(F.struct("id", "group")).alias("least"), F.count("*").alias("n")).select("fp", c("least.id").alias("id"), c("least.group").alias("group"), "n"))
    names = one.select("fp", "id")
    near = near_links(one.select("fp", "group"), BALL_RADIUS, _number_of_segments(one.count())).select("left", "right").distinct()
    for side in ("left", "right"):
        near = near.join(names.select(c("fp").alias(side), c("id").alias(f"{side}_id")), side)
    shared = one.where("n > 1")
    same = join_named(grouped.select("fp", "id", "group"), shared.select("fp", c("id").alias("star"), c("group").alias("star_group"), "n"), "fp", "n", grouped.count()).where(c("group") != c("star_group"))
    return _in_order(near.select(c("left_id").alias("left"), c("right_id").alias("right")).unionByName(same.select(c("id").alias("left"), c("star").alias("right"))))


def similar_components(docs: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """``key, component`` for every row of ``docs``: texts that chains of similar pairs connect share ``component``, the smallest key.

    A pair is similar if the sets of its five-word shingles (A-Z lower-cased,
    ASCII white space between words) have a Jaccard similarity of 0.8 or more.
    Pairs are searched by SimHash in several tables: besides its fingerprint a
    text has partial ones, each over a class of its two-word shingles, so texts
    with few different words agree in many of them.  Each text meets two stars
    for each partial fingerprint; first the one whose whole fingerprint is
    nearest is compared, then those that are not in its component yet.  What
    is not in one component then is also looked up in the balls around the
    segments of the whole fingerprint (``near_links``): without stars, so no
    pair of fingerprints within ``BALL_RADIUS`` bits is passed over.  Null,
    empty and blank texts are equal texts, repeated rows are rows of their own,
    empty tables give empty results.
    """
    c = F.col
    rows = pin(append_columns(docs.select(c(key_col).alias("key"), c(text_col).alias("text")), "fp long, node binary, parts array<long>", "text", _searched("text"), most_bytes=2_000_000).drop("text"))
    nodes = rows.groupBy("node").agg(F.min("key").alias("first"), F.count("*").alias("n"), F.any_value("fp").alias("fp"), F.any_value("parts").alias("parts"))
    nodes = pin(nodes.withColumn("id", F.monotonically_increasing_id()))  # short names for what follows
    total = rows.count()
    texts = docs.select(c(key_col).alias("key"), c(text_col).alias("text"))

    def texts_of(wanted: DataFrame) -> DataFrame:
        """The packed texts of the named nodes, one row of documents for each."""
        named = pin(nodes.select("id", c("first").alias("key"), "n").join(wanted.distinct(), "id"))
        few = named.count() <= FEW_NAMES  # broadcast, else all texts would move for them
        met = texts.join(F.broadcast(named.select("key", "id")), "key") if few else join_named(texts, named, "key", "n", total)
        found = append_columns(met.select("id", "text"), "packed binary", "text", _packed_texts("text")).drop("text")
        return pin(found.dropDuplicates(["id"]))  # rows of one key and text

    pairs = pin(_candidates(nodes))
    nearest = pin(_in_order(pairs.groupBy("left").agg(F.min(F.struct("far", "right")).alias("m")).select("left", c("m.right").alias("right"))))
    both = lambda p: p.select(c("left").alias("id")).unionByName(p.select(c("right").alias("id")))
    held = texts_of(both(pairs))
    links = _similar(nearest, held)
    # Pairs within a group are left out where they would be made, so a cloud of near copies gives few.
    grouped = _grouped(nodes.select("id", "fp", "parts"), links)
    balls = pin(_within_balls(grouped))
    untried = _in_order(_candidates(grouped).select("left", "right").unionByName(balls))
    unseen = both(balls).join(held.select("id"), "id", "left_anti")
    links = links.unionByName(_similar(untried, held.unionByName(texts_of(unseen))))
    final = connected_components(links, "left", "right", pin).withColumnRenamed("node", "id")
    named = pin(nodes.select("node", "id", "first", "n").join(final, "id", "left").select("node", "first", "n", F.coalesce("component", "id").alias("group")))
    least = named.groupBy("group").agg(F.min("first").alias("component"), F.count("*").alias("in_group"))
    told = pin(join_named(named, least, "group", "in_group", nodes.count()).select("node", "n", "component"))
    return join_named(rows.select("key", "node"), told, "node", "n", total).select("key", "component")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but one document of each component of ``similar_components``: that with the smallest id (null ids last), then the smallest text hash.

    Of rows with equal id and text one stays.  Null, empty and blank texts are
    equal texts.  All columns stay as they are, whatever their names.  Empty
    tables give empty results.
    """
    key = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash"))
    found = similar_components(docs.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text")
    kept = pin(found.where(F.col("key") == F.col("component")).groupBy("key").agg(F.count("*").alias("_rows")))
    named = kept.select(F.col("key.id").alias("_id"), F.col("key.hash").alias("_hash"), "_rows")
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("k._id")) & (F.xxhash64(F.col(f"d.{text_col}")) == F.col("k._hash"))
    met = docs.alias("d").join(named.alias("k"), same)
    single = met.where(F.col("k._rows") == 1).select("d.*")
    if not kept.where("_rows > 1").limit(1).count():
        return single
    repeated = met.where(F.col("k._rows") > 1).select(F.struct("d.*").alias("doc"), F.col("k._id").alias("id"), F.col("k._hash").alias("hash"))
    return single.unionByName(repeated.dropDuplicates(["id", "hash"]).select("doc.*"))
