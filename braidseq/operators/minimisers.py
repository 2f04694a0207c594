"""Canonical positional minimisers, and candidate pairs from the seeds that sequences share.

A sequence is cut once into chunks, which are dealt out and have a halo of one
window on either side.  A chunk's hashes, window minima and selected starts are
computed in Arrow batches.  So the work is linear in the sequence's length, and
a sequence of any length is work for many tasks.
"""

from __future__ import annotations

from dataclasses import replace
from operator import methodcaller

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import InputError, RunConfig
from ..functions.sequences import packed_letters, unpacked_letters
from ..session import many, pin, stored

#: A chunk has so many k-mer starts times so many.
TILE, CHUNK_TILES = 512, 16


def sequence_minimisers(sequences: DataFrame, kmer: int = 21, window: int = 10, id_col: str = "catalogue_id") -> DataFrame:
    """``sequence_id, value, kmer, position, orientation`` from ``<id>, sequence``.

    ``value`` is the first 16 hexadecimal digits of the canonical k-mer's
    SHA-256: in the order of unsigned integers.  A start is selected if its value
    is the least, ties too, of some window of ``min(window, starts)`` consecutive
    starts.  K-mers with a symbol other than A, C, G, T take a start but are
    never selected.  Sequences shorter than ``kmer`` have none.  Sequences are
    of ASCII symbols.
    """
    session = sequences.sparkSession
    # Dealt out evenly: a chunk is little data and much work, more than the size of a partition tells.
    chunks = _chunks(sequences, kmer, window, id_col).repartition(many(session), "sequence_id", "first")
    kind = dict(chunks.dtypes)["sequence_id"]
    return chunks.mapInArrow(_selected(kmer, TILE * CHUNK_TILES), f"sequence_id {kind}, value string, kmer string, position int, orientation string")


def _chunks(sequences: DataFrame, kmer: int, window: int, id_col: str) -> DataFrame:
    """``sequence_id, w, first, base, part``: chunks of ``TILE * CHUNK_TILES`` starts with their halo, ``part`` from ``base`` on."""
    n, chunk = f"(length(sequence) - {kmer} + 1)", TILE * CHUNK_TILES
    w = f"least({window}, {n})"
    # Slices of the binary form cost their own length, wherever they begin; the cast is bound once for all of them.
    base = f"greatest(0, i * {chunk} - ({w} - 1))"
    cut = f"""transform(array(cast(sequence as binary)), b -> transform(sequence(0, ({n} - 1) div {chunk}), i -> named_struct(
        'first', cast(i * {chunk} as int), 'base', cast({base} as int), 'part', substring(b, {base} + 1, (i + 1) * {chunk} + {w} - 1 - {base} + {kmer} - 1))))[0]"""
    return (
        sequences.select(F.col(id_col).alias("sequence_id"), "sequence").where(F.expr(f"{n} > 0"))
        .select("sequence_id", F.expr(f"cast({w} as int)").alias("w"), F.explode(F.expr(cut)).alias("c")).select("sequence_id", "w", "c.*")
    )


#: Seeds in a batch of results, but for the last chunk's.
BATCH = 20_000
#: Complements of the four bases; other symbols are in no seed.
_TURN = bytes.maketrans(b"ACGT", b"TGCA")


def _found(kmer: int, chunk: int, windows: tuple[int, ...] | None = None):
    """A function from a batch of chunks to each chunk's seeds: SHA-256 of each k-mer, minima of windows by numpy.

    With ``windows``, of which the chunks are cut for the largest, a chunk has its seeds for each of them in turn.
    """
    try:
        from _sha2 import sha256  # Python's own: half the time on so short strings
    except ImportError:
        from hashlib import sha256

    import numpy as np

    plain = np.zeros(256, dtype=bool)
    plain[list(b"ACGT")] = True
    digest = methodcaller("digest")

    def found(batch):
        """The row, the chunk's canonical k-mers and hashes by start, its symbols, which k-mers are their own strand, the seeds' starts, the chunk's base and the place of the window."""
        firsts, bases, widths = (batch.column(x).to_pylist() for x in ("first", "base", "w"))
        for row, part in enumerate(batch.column("part")):
            forward = part.as_py()
            m, w, base = len(forward) - kmer + 1, widths[row], bases[row]
            turned = forward.translate(_TURN)[::-1]
            bytes_of, back = np.frombuffer(forward, dtype=np.uint8), np.frombuffer(turned, dtype=np.uint8)
            straight, open_ = np.ones(m, dtype=bool), np.arange(m)
            for j in range(kmer):  # which strand is the lesser, by the first symbol in which both differ
                a, b = bytes_of[open_ + j], back[m - 1 - open_ + j]
                straight[open_[a > b]] = False
                open_ = open_[a == b]
                if not len(open_):
                    break
            # All k-mers of both strands are one view; a NUL at an end would go, but is no base.
            places = np.where(straight, np.arange(m), len(forward) + m - 1 - np.arange(m))
            canon = np.lib.stride_tricks.sliding_window_view(np.frombuffer(forward + turned, dtype=np.uint8), kmer)[places].view(f"S{kmer}").ravel().tolist()
            hashes = np.frombuffer(b"".join(map(digest, map(sha256, canon))), dtype=">u8")[::4].astype(np.uint64)
            odd = np.concatenate([[0], np.cumsum(~plain[bytes_of])])
            sound = odd[kmer:] == odd[:m]
            hashes[~sound] = ~np.uint64(0)
            low = firsts[row] - base
            for number, own in enumerate(windows or (w,)):
                width = min(own, w)
                least = hashes[: m - width + 1].copy()
                for i in range(1, width):
                    np.minimum(least, hashes[i : m - width + 1 + i], out=least)
                chosen = np.zeros(m, dtype=bool)
                for i in range(width):
                    chosen[i : m - width + 1 + i] |= hashes[i : m - width + 1 + i] == least
                chosen[:low] = chosen[low + chunk :] = False
                yield row, canon, hashes, bytes_of, straight, np.flatnonzero(chosen & sound), base, number

    return found


def _selected(kmer: int, chunk: int):
    """A function from batches of chunks to their seeds."""

    def run(batches):
        import pyarrow as pa

        found = _found(kmer, chunk)

        def table(batch, places, columns):
            made = [pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.string()))]
            return pa.RecordBatch.from_arrays([batch.column("sequence_id").take(pa.array(places, pa.int32())), *made], ["sequence_id", "value", "kmer", "position", "orientation"])

        for batch in batches:
            places, columns = [], ([], [], [], [])
            for row, canon, hashes, _, straight, at, base, _ in found(batch):
                named, starts = hashes[at].astype(">u8").tobytes().hex(), at.tolist()
                own = [named[i : i + 16] for i in range(0, len(named), 16)], [canon[i].decode() for i in starts], (at + base).tolist(), ["+" if x else "-" for x in straight[at].tolist()]
                places += [row] * len(starts)
                for held, more in zip(columns, own):
                    held += more
                if len(places) >= BATCH:
                    yield table(batch, places, columns)
                    places, columns = [], ([], [], [], [])
            yield table(batch, places, columns)

    return run


#: Letters whose codes are made at once.
CODED = 2_000_000


def coded_minimisers(sequences: DataFrame, kmer: int, window: int, id_col: str = "catalogue_id") -> DataFrame:
    """``sequence_id, key, position, orientation``: minimisers as ``sequence_minimisers`` selects them, by another order and without text.

    ``key`` is the canonical k-mer at two bits a base, so ``kmer`` is 31 at
    most; its order is a mix of these bits, for which no k-mer goes through a
    digest.  ``orientation`` is true on the forward strand.
    """
    if kmer > 31:
        raise InputError("codes hold 31 bases at most")
    session = sequences.sparkSession
    chunks = _chunks(sequences, kmer, window, id_col).repartition(many(session), "sequence_id", "first")
    kind = dict(chunks.dtypes)["sequence_id"]
    return chunks.mapInArrow(_coded(kmer, TILE * CHUNK_TILES), f"sequence_id {kind}, key long, position int, orientation boolean")


def _codes(letters, kmer: int):
    """The two-bit codes of all k-mers of an array of bases, and of their reverse complements."""
    import numpy as np

    n, forward, back, held, of = len(letters) - kmer + 1, None, None, 0, {}
    f, r, size = letters, np.uint64(3) - letters, 1
    while size <= kmer:  # codes of 1, 2, 4 and so on bases, of which those for the bits of ``kmer`` are put together
        of[size] = f, r
        shift = np.uint64(2 * size)
        f, r, size = (f[:-size] << shift) | f[size:], r[:-size] | (r[size:] << shift), 2 * size
    for size in sorted(of, reverse=True):
        if kmer & size:
            f, r = (x[held : held + n] for x in of[size])
            if held:
                f, r = (forward << np.uint64(2 * size)) | f, back | (r << np.uint64(2 * held))
            forward, back, held = f, r, held + size
    return forward, back


def _coded(kmer: int, chunk: int):
    """A function from batches of chunks to their seeds by code: many chunks are one array."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bits, plain = np.zeros(256, dtype=np.uint64), np.zeros(256, dtype=bool)
        bits[list(b"ACGT")], plain[list(b"ACGT")] = range(4), True
        most = ~np.uint64(0)

        def selected(parts, low, w):
            """Chunk, place, key and strand of the seeds of these chunks."""
            letters, sizes = np.frombuffer(b"".join(parts), dtype=np.uint8), np.array([len(x) for x in parts])
            n = len(letters) - kmer + 1
            place = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            left = (np.repeat(sizes, sizes) - place)[:n]
            odd = np.concatenate([[0], np.cumsum(~plain[letters])])
            sound = (odd[kmer:] == odd[:n]) & (left >= kmer)
            forward, back = _codes(bits[letters], kmer)
            straight = forward <= back
            keys = np.where(straight, forward, back)
            order = keys.copy()
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                order ^= order >> np.uint64(shift)
                order *= np.uint64(factor)
            order ^= order >> np.uint64(31)
            order[~sound] = most
            # The least of each window that lies in its chunk; a start is selected if it is the least of some window with it.
            least = np.zeros(n, dtype=np.uint64)
            least[: n - w + 1] = _least(order, w)
            least[left < kmer + w - 1] = 0
            highest = least.copy()
            for j in range(1, w):
                np.maximum(highest[j:], least[:-j], out=highest[j:])
            first = np.repeat(low, sizes)[:n]
            at = np.flatnonzero(sound & (highest == order) & (place[:n] >= first) & (place[:n] < first + chunk))
            return np.repeat(np.arange(len(parts)), sizes)[at], place[at], keys[at], straight[at]

        for batch in batches:
            firsts, bases, widths = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("first", "base", "w"))
            for w in np.unique(widths).tolist():
                rows = np.flatnonzero(widths == w)
                parts = [x.as_py() for x in batch.column("part").take(pa.array(rows))]
                ends, begin = np.cumsum([len(x) for x in parts]), 0
                while begin < len(rows):
                    end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CODED, side="right")))
                    own = rows[begin:end]
                    chunks, places, keys, straight = selected(parts[begin:end], firsts[own] - bases[own], w)
                    columns = [pa.array(keys.astype(np.int64)), pa.array((places + bases[own][chunks]).astype(np.int32)), pa.array(straight)]
                    yield pa.RecordBatch.from_arrays([batch.column("sequence_id").take(pa.array(own[chunks])), *columns], ["sequence_id", "key", "position", "orientation"])
                    begin = end

    return run


def _least(order, w: int):
    """The least of each ``w`` neighbours."""
    import numpy as np

    out = order[: len(order) - w + 1].copy()
    for j in range(1, w):
        np.minimum(out, order[j : len(order) - w + 1 + j], out=out)
    return out


def minimiser_frequency(observations: DataFrame) -> DataFrame:
    """``value, kmer, frequency``: places, not sequences, are counted."""
    return observations.groupBy("value", "kmer").agg(F.count("*").alias("frequency"))


def seed_pair_bound(frequencies: DataFrame, max_frequency: int) -> DataFrame:
    """``unique_minimisers, retained_observations, pair_bound``: the pairs that a self-join can give at most."""
    kept = F.col("frequency") <= max_frequency
    return frequencies.agg(
        F.count("*").alias("unique_minimisers"),
        F.coalesce(F.sum(F.when(kept, F.col("frequency"))), F.lit(0)).alias("retained_observations"),
        F.coalesce(F.sum(F.when(kept, F.expr("frequency * (frequency - 1) div 2"))), F.lit(0)).cast("long").alias("pair_bound"),
    )


def retained_seeds(observations: DataFrame, max_frequency: int) -> DataFrame:
    """Observations of minimisers that occur at most ``max_frequency`` times; so no key has more rows in the join to come."""
    often = minimiser_frequency(observations).where(F.col("frequency") <= max_frequency)
    return observations.join(often.select("value", "kmer"), ["value", "kmer"])


def seed_pairs(retained: DataFrame) -> DataFrame:
    """Places of one minimiser in two sequences, the smaller id as query; ``relative`` is ``+`` on equal strands."""
    a = retained.select("value", "kmer", F.col("sequence_id").alias("query_id"), F.col("position").alias("query_position"), F.col("orientation").alias("qo"))
    b = retained.select("value", "kmer", F.col("sequence_id").alias("target_id"), F.col("position").alias("target_position"), F.col("orientation").alias("to"))
    met = a.join(b, ["value", "kmer"]).where(F.col("query_id") < F.col("target_id"))
    return met.select("query_id", "target_id", "kmer", "query_position", "target_position", F.when(F.col("qo") == F.col("to"), "+").otherwise("-").alias("relative"))


def pair_evidence(pairs: DataFrame) -> DataFrame:
    """``query_id, target_id, shared_minimisers, query_positions, target_positions, evidence``: distinct seeds and places, and all seed pairs."""
    return pairs.groupBy("query_id", "target_id").agg(
        F.count_distinct("kmer").alias("shared_minimisers"),
        F.count_distinct("query_position").alias("query_positions"),
        F.count_distinct("target_position").alias("target_positions"),
        F.count("*").alias("evidence"),
    )


def candidate_pairs(pairs: DataFrame, lengths: DataFrame, config: RunConfig, terminal_band: int | None = None) -> DataFrame:
    """Pairs that share ``min_shared`` distinct seeds and show a terminal topology.

    ``query_id, target_id, shared_minimisers, orientation`` (null if both
    occur), ``supported_orientations, terminal_topologies, reasons`` (joined).
    ``lengths``: ``sequence_id, length``.  The two flags of a topology may come
    from different seeds.
    """
    band = terminal_band or config.terminal_band
    k = config.kmer
    sided = (
        pairs.join(lengths.select(F.col("sequence_id").alias("query_id"), F.col("length").alias("query_length")), "query_id")
        .join(lengths.select(F.col("sequence_id").alias("target_id"), F.col("length").alias("target_length")), "target_id")
    )
    grouped = sided.groupBy("query_id", "target_id", "kmer").agg(*_flags(band, k))
    per_pair = grouped.groupBy("query_id", "target_id").agg(F.count("*").alias("shared_minimisers"), *[F.bool_or(c).alias(c) for c in _FLAGS])
    return _judged(per_pair, config)


def _judged(per_pair: DataFrame, config: RunConfig, *also: str) -> DataFrame:
    """The candidates among ``query_id, target_id, shared_minimisers`` and the columns ``_FLAGS``, with the columns ``also``."""
    topologies = []
    for way, suffix in (("f", ""), ("r", "_REVERSE")):
        head, tail = (f"t_prefix_{way}", f"t_suffix_{way}") if way == "f" else (f"t_suffix_{way}", f"t_prefix_{way}")
        q_head, q_tail = f"q_prefix_{way}", f"q_suffix_{way}"
        topologies += [
            F.when(F.col(q_tail) & F.col(head), f"QUERY_SUFFIX_TO_TARGET_PREFIX{suffix}"),
            F.when(F.col(q_head) & F.col(tail), f"TARGET_SUFFIX_TO_QUERY_PREFIX{suffix}"),
            F.when(F.col(q_head) & F.col(q_tail), f"QUERY_CONTAINMENT_POSSIBLE{suffix}"),
            F.when(F.col(head) & F.col(tail), f"TARGET_CONTAINMENT_POSSIBLE{suffix}"),
        ]
    both = F.col("any_f") & F.col("any_r")
    first, second = "canonical positional minimisers support terminal geometry", "orientation evidence is ambiguous"
    return (
        per_pair.withColumn("found", F.array_sort(F.array_compact(F.array(*topologies))))
        .where((F.col("shared_minimisers") >= config.min_shared) & (F.size("found") > 0))
        .select(
            "query_id", "target_id", "shared_minimisers",
            F.when(~both, F.when(F.col("any_f"), "+").otherwise("-")).alias("orientation"),
            F.when(both, "+,-").when(F.col("any_f"), "+").otherwise("-").alias("supported_orientations"),
            F.array_join("found", ",").alias("terminal_topologies"),
            F.when(both, f"{first}; {second}").otherwise(first).alias("reasons"), *also,
        )
    )


_FLAGS = [f"{side}_{end}_{way}" for side in "qt" for end in ("prefix", "suffix") for way in "fr"] + ["any_f", "any_r"]


def _flags(band: int, k: int) -> list:
    out = []
    for side, name in (("q", "query"), ("t", "target")):
        for end in ("prefix", "suffix"):
            at = F.col(f"{name}_position")
            near = at < band if end == "prefix" else at + k > F.col(f"{name}_length") - band
            out += [F.bool_or((F.col("relative") == sign) & near).alias(f"{side}_{end}_{way}") for way, sign in (("f", "+"), ("r", "-"))]
    return out + [F.bool_or(F.col("relative") == sign).alias(f"any_{way}") for way, sign in (("f", "+"), ("r", "-"))]


# --- candidates without rows of places


def numbered(sequences: DataFrame) -> DataFrame:
    """``sequence_id, name, sequence, length``, stored: ``sequence_id`` is a long in the order of the names (``sequences``: ``sequence_id, sequence, length``, or ``packed`` letters).

    Ids by content are much longer than all else that a seed has.
    """
    # Letters move once, packed; ids rise over the partitions of the sort and within them.
    packed = F.col("packed") if "packed" in sequences.columns else packed_letters("sequence").alias("packed")
    rows = sequences.select(F.col("sequence_id").alias("name"), packed, "length")
    rows = rows.repartitionByRange(many(sequences.sparkSession), "name").sortWithinPartitions("name")
    return stored(rows.select(F.monotonically_increasing_id().alias("sequence_id"), "name", unpacked_letters("packed").alias("sequence"), "length"), "numbered")


def named(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """``rows`` with the names of ``query_id`` and ``target_id`` for their numbers."""
    columns = rows.columns
    for side in ("query_id", "target_id"):
        rows = rows.join(numbers.select(F.col("sequence_id").alias(side), F.col("name").alias(f"_{side}")), side).drop(side).withColumnRenamed(f"_{side}", side)
    return rows.select(*columns)


#: Seeds that a task packs at once, letters for which there is one bucket of keys, and pairs that a task adds up at once.
PACKED, BUCKET_LETTERS, ADDED = 2_000_000, 4_000_000, 1_000_000
#: Sequences of more chunks than this have them dealt out; the chunks of others stay where the sequence is.
FEW_CHUNKS = 16
_PLACE = "struct<sequence_id: bigint, position: int, plus: boolean, near: tinyint>"


def _near(band: int, kmer: int, position, length):
    """1 for a place in the terminal band at the start, 2 at the end, 3 for both."""
    return 1 * (position < band) + 2 * (position + kmer > length - band)


def _planes(columns, codec) -> bytes:
    """Arrays of equal length as bytes: each byte of their numbers by itself, those that are all zero left out."""
    import numpy as np

    parts = []
    for x in columns:
        for plane in np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T:
            parts.append(codec.compress(plane.tobytes(), asbytes=True) if plane.any() else b"")
    return np.array([len(columns[0]), *map(len, parts)], dtype=np.int32).tobytes() + b"".join(parts)


def _unplaned(held: bytes, kinds, codec) -> list:
    """The arrays of ``_planes``, of these kinds."""
    import numpy as np

    sizes = [np.dtype(x).itemsize for x in kinds]
    n, *lengths = np.frombuffer(held, dtype=np.int32, count=1 + sum(sizes)).tolist()
    at, out, lengths = 4 * (1 + sum(sizes)), [], iter(lengths)
    for kind, size in zip(kinds, sizes):
        x = np.zeros((n, size), dtype=np.uint8)
        for i in range(size):
            if taken := next(lengths):
                x[:, i] = np.frombuffer(codec.decompress(held[at : at + taken], n, asbytes=True), dtype=np.uint8)
                at += taken
        out.append(x.reshape(-1).view(kind))
    return out


#: Offset of the key in its bucket, sequence, position, strand with terminal band, and places of the key that stay behind.
_KINDS = ("<u8", "<i8", "<i4", "u1", "<i8")


def _runs(sorted_keys):
    """Where each run of equal keys begins, and its length."""
    import numpy as np

    first = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])[: len(sorted_keys)])
    return first, np.diff(first, append=len(sorted_keys))


def _bucketed(kmer: int, chunk: int, band: int, most: int, stride: int, windows: tuple[int, ...] | None = None):
    """A function from batches of chunks to ``bucket, seeds``: keys by bucket, with their places packed.

    A key is a permutation of its k-mer's two-bit code, so that buckets fill
    evenly.  Of a key with more than ``most`` places among those that are packed
    at once, ``most + 1`` leave, the last with the number of the others: it is
    too frequent either way.  Each of ``windows`` has buckets of its own, one set after the other.
    """
    buckets_each = -(-(4**kmer) // stride)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        found, codec = _found(kmer, chunk, windows), pa.Codec("zstd", compression_level=1)
        two_bits = np.zeros(256, dtype=np.uint64)
        two_bits[list(b"ACGT")] = range(4)
        falling = np.uint64(4) ** np.arange(kmer - 1, -1, -1, dtype=np.uint64)
        mask, odd, steps = np.uint64(4**kmer - 1), np.uint64(0x9E3779B97F4A7C15), np.arange(kmer)

        def mixed(codes):
            codes = codes * odd & mask
            codes ^= codes >> np.uint64(kmer)
            return codes * odd & mask

        def packed(held, number):
            keys, ids, places, marks = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(keys)
            first, times = _runs(keys[order])
            behind = np.zeros(len(order), dtype=np.int64)
            often = times > most + 1
            behind[first[often] + most] = times[often] - most - 1
            kept = np.arange(len(order)) - np.repeat(first, times) <= most
            order, behind = order[kept], behind[kept]
            keys, ids, places, marks = keys[order], ids[order], places[order], marks[order]
            buckets = keys // np.uint64(stride)
            starts, sizes = _runs(buckets)
            rows = []
            for at, size in zip(starts.tolist(), sizes.tolist()):
                own = slice(at, at + size)
                rows.append(_planes([np.diff(keys[own], prepend=buckets[at] * np.uint64(stride)), ids[own], places[own], marks[own], behind[own]], codec))
            return pa.RecordBatch.from_arrays([pa.array(buckets[starts].astype(np.int64) + number * buckets_each), pa.array(rows, pa.large_binary()).cast(pa.binary())], ["bucket", "seeds"])

        held, count = {}, 0
        for batch in batches:
            ids, lengths = (batch.column("sequence_id").field(x).to_pylist() for x in ("sequence_id", "length"))
            for row, _, _, symbols, straight, at, base, number in found(batch):
                codes = two_bits[symbols[at[:, None] + steps]]
                codes = np.where(straight[at], (codes * falling).sum(axis=1), ((np.uint64(3) - codes) * falling[::-1]).sum(axis=1))
                places = (at + base).astype(np.int32)
                marks = (straight[at] + 2 * _near(band, kmer, places, lengths[row])).astype(np.uint8)
                held.setdefault(number, []).append((mixed(codes), np.full(len(at), ids[row], dtype=np.int64), places, marks))
                count += len(at)
                if count >= PACKED:
                    for number, some in held.items():
                        yield packed(some, number)
                    held, count = {}, 0
        if count:
            for number, some in held.items():
                yield packed(some, number)

    return run


def _listed(most: int, stride: int, counted: bool, each: int | None = None):
    """A function from a bucket's rows to its keys of 2 to ``most`` places, with the places by sequence and position; with ``each``, the buckets of a window, also with the place of the window."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        codec = pa.Codec("zstd")
        number, bucket = divmod(table.column("bucket")[0].as_py(), each or 1 << 62)
        start = np.uint64(bucket * stride)
        parts = []
        for held in table.column("seeds"):
            deltas, *rest = _unplaned(held.as_py(), _KINDS, codec)
            parts.append((start + np.cumsum(deltas, dtype=np.uint64), *rest))
        keys, ids, places, marks, behind = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(keys)
        first, times = _runs(keys[order])
        frequencies = np.add.reduceat(1 + behind[order], first)
        others, many = np.unique(frequencies[(frequencies < 2) | (frequencies > most)], return_counts=True)
        order = order[np.repeat((times > 1) & (times <= most), times)]
        keys, ids, places, marks = keys[order], ids[order], places[order], marks[order]
        order = np.lexsort((places, ids, keys))
        keys, ids, places, marks = keys[order], ids[order], places[order], marks[order]
        first, times = _runs(keys)
        rows = pa.StructArray.from_arrays(
            [pa.array(ids), pa.array(places), pa.array(marks % 2 == 1), pa.array((marks // 2).astype(np.int8))], ["sequence_id", "position", "plus", "near"]
        )
        columns = [pa.array(keys[first].astype(np.int64)), pa.array(times.astype(np.int64)), pa.array(np.ones(len(first), dtype=np.int64)), pa.ListArray.from_arrays(pa.array(np.append(first, len(keys)).astype(np.int32)), rows)]
        names = ["key", "frequency", "keys", "places"]
        out = pa.Table.from_arrays(columns, names)
        if counted:
            more = pa.Table.from_arrays([pa.nulls(len(others), pa.int64()), pa.array(others), pa.array(many.astype(np.int64)), pa.nulls(len(others), columns[3].type)], names)
            out = pa.concat_tables([out, more])
        if each:
            out = out.append_column("window", pa.array(np.full(len(out), number, dtype=np.int32)))
        return out

    return run


def seed_lists(numbers: DataFrame, config: RunConfig, terminal_band: int | None = None, counted: bool = False, windows: tuple[int, ...] | None = None) -> DataFrame:
    """``key, frequency, keys, places``, stored: one row a minimiser that has 2 to ``max_frequency`` places, with these as a list.

    ``places``: ``sequence_id, position, plus, near``; ``near`` is 1 if the place
    lies in the terminal band at the start, 2 at the end, 3 both.  ``keys`` is 1.
    With ``counted`` there are rows without key and places beside these, which
    hold in ``keys`` how many other minimisers have a ``frequency``.

    Seeds move once, packed by task and bucket of keys: most of them occur once
    and end there.  With ``windows``, the largest of which is the config's, there
    is ``window`` too, the place in them, and each k-mer is hashed once for all;
    k-mers are of 31 bases at most.
    """
    kmer, band, most, chunk = config.kmer, terminal_band or config.terminal_band, config.max_frequency, TILE * CHUNK_TILES
    session = numbers.sparkSession
    if windows and (kmer > 31 or max(windows) != config.window):
        raise InputError("several windows need two bits a base, and chunks cut for the largest")
    if kmer > 31:  # no two bits a base in a long
        return _lists_by_name(numbers, config, band, counted)
    letters = numbers.agg(F.sum(F.col("length").cast("long"))).first()[0] or 0
    stride = -(-(4**kmer) // max(4 * many(session), letters // BUCKET_LETTERS))
    marked = numbers.select(F.struct("sequence_id", "length").alias("id"), "sequence")
    few = F.length("sequence") < FEW_CHUNKS * chunk
    here, dealt = _chunks(marked.where(few), kmer, config.window, "id"), _chunks(marked.where(~few), kmer, config.window, "id")
    chunks = here.unionByName(dealt.repartition(many(session), "sequence_id", "first"))
    seeds = chunks.mapInArrow(_bucketed(kmer, chunk, band, most, stride, windows), "bucket long, seeds binary")
    schema = f"key long, frequency long, keys long, places array<{_PLACE}>" + (", window int" if windows else "")
    return stored(seeds.groupBy("bucket").applyInArrow(_listed(most, stride, counted, -(-(4**kmer) // stride) if windows else None), schema), "seeds")


def _lists_by_name(numbers: DataFrame, config: RunConfig, band: int, counted: bool) -> DataFrame:
    """``seed_lists`` with the k-mers themselves as keys."""
    c = F.col
    marked = numbers.select(F.struct("sequence_id", "length").alias("id"), "sequence")
    near = F.when(c("position") < band, 1).otherwise(0) + F.when(c("position") + config.kmer > c("sequence_id.length") - band, 2).otherwise(0)
    found = sequence_minimisers(marked, config.kmer, config.window, "id").select(
        c("kmer").alias("key"), F.struct(c("sequence_id.sequence_id").alias("sequence_id"), "position", (c("orientation") == "+").alias("plus"), near.cast("byte").alias("near")).alias("place")
    )
    found = stored(found.withColumn("frequency", F.count("*").over(Window.partitionBy("key"))), "places")
    lists = found.where(c("frequency").between(2, config.max_frequency)).groupBy("key", "frequency").agg(F.lit(1).cast("long").alias("keys"), F.sort_array(F.collect_list("place")).alias("places"))
    if counted:
        others = found.where(~c("frequency").between(2, config.max_frequency)).groupBy("frequency").agg(F.count_distinct("key").alias("keys"))
        lists = lists.unionByName(others, allowMissingColumns=True)
    return stored(lists, "seeds")


def places_of(lists: DataFrame) -> DataFrame:
    """``key, sequence_id, position, plus, near, frequency``: one row a place of ``seed_lists``."""
    return lists.select("key", "frequency", F.explode("places").alias("p")).select("key", "p.*", "frequency")


def seed_places(numbers: DataFrame, config: RunConfig, terminal_band: int | None = None) -> DataFrame:
    """The places of ``seed_lists``, one row a place."""
    return places_of(seed_lists(numbers, config, terminal_band))


def _listed_places(batch, fields):
    """The fields of all places of a batch of lists, and which list they are of, by list and sequence."""
    import numpy as np

    column = batch.column("places")
    flat = column.flatten()
    columns = [flat.field(x).to_numpy(zero_copy_only=False) for x in ("sequence_id", *fields)]
    keys = np.repeat(np.arange(len(column)), np.asarray(column.value_lengths().fill_null(0)))
    order = np.lexsort((columns[0], keys))
    return keys[order], *(x[order] for x in columns)


def _pairs_of(keys, ids):
    """Places in the arrays, as of ``_listed_places``, of all pairs of one key and different sequences, some at once: the lesser sequence first."""
    import numpy as np

    if not len(keys):
        return
    _, own = _runs_of(keys, ids)
    begin = np.repeat(np.cumsum(own), own)
    partners = np.searchsorted(keys, keys, side="right") - begin
    ends, low = np.cumsum(partners), 0
    while low < len(keys):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + ADDED, side="right")))
        some = partners[low:high]
        q = np.repeat(np.arange(low, high), some)
        if len(q):
            yield q, begin[q] + np.arange(len(q)) - np.repeat(np.cumsum(some) - some, some)
        low = high


def _runs_of(x, y):
    """``_runs`` of pairs."""
    import numpy as np

    first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(x)])
    return first, np.diff(first, append=len(x))


def _met(batches):
    """Batches of lists of places to ``shared_seeds`` of them, added up as far as a task holds them at once."""
    import numpy as np
    import pyarrow as pa

    names = ["query_id", "target_id", "shared_minimisers", "query_positions", "target_positions", "evidence", "flags"]
    for batch in batches:
        keys, ids, plus, near = _listed_places(batch, ("plus", "near"))
        if not len(keys):
            continue
        bits = 1 + 2 * near.astype(np.int32)
        # One row a seed and sequence: its places, and their bits on either strand.
        first, n = _runs_of(keys, ids)
        a, b = (np.bitwise_or.reduceat(np.where(way, bits, 0), first) for way in (plus, ~plus))
        keys, ids = keys[first], ids[first]
        for q, t in _pairs_of(keys, ids):
            qa, qb, ta, tb = a[q], b[q], a[t], b[t]

            def seen(one, two, x, y):
                """The bits ``one`` where there is a place of ``x``, and ``two`` where there is one of ``y``."""
                return np.where(x > 0, one, 0) | np.where(y > 0, two, 0)

            flags = seen(qa, qb, ta, tb) | seen(qa, qb, tb, ta) * 8 | seen(ta, tb, qa, qb) * 64 | seen(ta, tb, qb, qa) * 512
            qn, tn, q, t = n[q], n[t], ids[q], ids[t]
            order = np.lexsort((t, q))
            q, t, qn, tn, flags = q[order], t[order], qn[order], tn[order], flags[order]
            first, many = _runs_of(q, t)
            sums = [many, *(np.add.reduceat(x, first) for x in (qn, tn, qn * tn))]
            columns = [q[first], t[first], *(x.astype(np.int64) for x in sums), np.bitwise_or.reduceat(flags, first).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)


def _met_places(batches):
    """Batches of lists of places to all pairs of their places in different sequences."""
    import pyarrow as pa

    names = ["query_id", "target_id", "query_position", "target_position", "same"]
    for batch in batches:
        keys, ids, places, plus = _listed_places(batch, ("position", "plus"))
        for q, t in _pairs_of(keys, ids):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[q], ids[t], places[q], places[t], plus[q] == plus[t])], names)


def _lists(places: DataFrame) -> DataFrame:
    """The lists of ``seed_lists``; ``seed_places`` are brought together by key."""
    if "places" not in places.columns:
        places = places.groupBy("key").agg(F.collect_list(F.struct("sequence_id", "position", "plus", "near")).alias("places"))
    return places.where(F.col("places").isNotNull()).select("places")


def shared_seeds(places: DataFrame) -> DataFrame:
    """``query_id, target_id, shared_minimisers, query_positions, target_positions, evidence, flags`` of every pair of sequences with a common seed.

    ``places``: ``seed_lists``, whose rows meet where they are, or
    ``seed_places``, which are brought together by key first.  All of it adds up
    over the seeds, and is added where it is made.  ``flags`` holds, three bits
    each, whether the seeds lie anywhere, at the start and at the end: of the
    query on equal strands and on different ones, then of the target.
    """
    schema = "query_id long, target_id long, shared_minimisers long, query_positions long, target_positions long, evidence long, flags int"
    met = _lists(places).mapInArrow(_met, schema)
    sums = [F.sum(x).alias(x) for x in ("shared_minimisers", "query_positions", "target_positions", "evidence")]
    return met.groupBy("query_id", "target_id").agg(*sums, F.bit_or("flags").alias("flags"))


def candidates_of(places: DataFrame, config: RunConfig) -> DataFrame:
    """``candidate_pairs`` from ``seed_lists`` or ``seed_places``."""
    often = shared_seeds(places).where(F.col("shared_minimisers") >= config.min_shared)
    return _judged(often.select("query_id", "target_id", "shared_minimisers", *_unflagged()), config)


def _unflagged() -> list:
    """The columns ``_FLAGS`` from the bits of ``flags``."""
    shifts = {f"{side}_{end}_{way}": 6 * (side == "t") + 3 * (way == "r") + (1 if end == "prefix" else 2) for side in "qt" for end in ("prefix", "suffix") for way in "fr"} | {"any_f": 0, "any_r": 3}
    return [(F.col("flags").bitwiseAND(F.lit(1 << shifts[x])) != 0).alias(x) for x in _FLAGS]


#: The part of a number of ``numbered`` that counts within its partition; rows in a batch of pairs.
_ROW_BITS, PAIR_ROWS = 33, 100_000
_LINED = "query_id long, target_id long, shared_minimisers long, flags int, lines binary"


def _pair_codes(q, t):
    """A number for each pair of numbers, equal for equal pairs alone."""
    import numpy as np

    mask = (1 << _ROW_BITS) - 1
    low = int(max((q & mask).max(), (t & mask).max())).bit_length()
    wide = low + int(max(q.max(), t.max()) >> _ROW_BITS).bit_length()
    if wide <= 31:
        a, b = ((x >> _ROW_BITS << low) | (x & mask) for x in (q, t))
        return (a << wide) | b
    order = np.lexsort((t, q))
    codes = np.empty(len(q), dtype=np.int64)
    codes[order] = np.repeat(np.arange(len(first := _runs_of(q[order], t[order])[0])), np.diff(first, append=len(q)))
    return codes


def _lined(q, t, shared, flags, owners, lines):
    """Batches of one row a pair from rows that may repeat pairs, and from the rows (``owners``) that ``lines`` are of."""
    import numpy as np
    import pyarrow as pa

    codes = _pair_codes(q, t)
    order = np.argsort(codes, kind="stable")
    first, n = _runs(codes[order])
    pair = np.empty(len(q), dtype=np.int64)
    pair[order] = np.repeat(np.arange(len(first)), n)
    pairs = pair if owners is None else pair[owners]
    by_line = np.lexsort((lines, pairs))
    pairs, lines = pairs[by_line], lines[by_line]
    own, _ = _runs_of(pairs, lines)
    ends = np.cumsum(np.bincount(pairs[own], minlength=len(first)))
    shared, flags = np.add.reduceat(shared[order], first, dtype=np.int64), np.bitwise_or.reduceat(flags[order], first)
    q, t, lines = q[order[first]], t[order[first]], lines[own]
    for low in range(0, len(q), PAIR_ROWS):
        high = min(low + PAIR_ROWS, len(q))
        base = int(ends[low - 1]) if low else 0
        held = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer((8 * (np.append(base, ends[low:high]) - base)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(lines[base : ends[high - 1]]))])
        yield pa.RecordBatch.from_arrays([pa.array(q[low:high]), pa.array(t[low:high]), pa.array(shared[low:high]), pa.array(flags[low:high].astype(np.int32)), held], [x.split()[0] for x in _LINED.split(", ")])


def lines_of(column):
    """The lines of a binary column of them, and how many each row has."""
    import numpy as np

    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8)[offsets[0] : offsets[-1]].copy().view(np.int64) if held is not None and len(column) else np.zeros(0, dtype=np.int64)
    return data, np.diff(offsets) // 8


def _met_lines(batches):
    """Batches of lists of places to pairs with their common seeds and lines, added up as far as a task holds them at once."""
    import numpy as np

    held, count = [], 0
    for batch in batches:
        keys, ids, places, plus, near = _listed_places(batch, ("position", "plus", "near"))
        if not len(keys):
            continue
        lead = np.zeros(len(keys), dtype=np.int64)
        lead[_runs_of(keys, ids)[0]] = 1
        places, bits = places.astype(np.int64), 1 + 2 * near.astype(np.int32)
        for q, t in _pairs_of(keys, ids):
            turned = plus[q] != plus[t]
            shift = 3 * turned.astype(np.int32)
            lines = 2 * (places[q] + np.where(turned, places[t], -places[t])) + turned
            held.append((ids[q], ids[t], lead[q] & lead[t], (bits[q] << shift) | (bits[t] << (shift + 6)), lines))
            count += len(q)
            if count >= ADDED:
                q, t, shared, flags, lines = (np.concatenate(x) for x in zip(*held))
                yield from _lined(q, t, shared, flags, None, lines)
                held, count = [], 0
    if count:
        q, t, shared, flags, lines = (np.concatenate(x) for x in zip(*held))
        yield from _lined(q, t, shared, flags, None, lines)


def _whole_pairs(least: int):
    """A function that adds up sorted rows of ``_met_lines`` and leaves the pairs with ``least`` seeds or more."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def added(batch):
            q, t, shared, flags = (batch.column(x).to_numpy(zero_copy_only=False) for x in range(4))
            lines, counts = lines_of(batch.column(4))
            for out in _lined(q, t, shared, flags, np.repeat(np.arange(len(q)), counts), lines):
                yield out.filter(pc.greater_equal(out.column(2), least))

        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            q, t = (batch.column(x).to_numpy(zero_copy_only=False) for x in range(2))
            # The last pair may go on in the next batch.
            last = int(_runs_of(q, t)[0][-1])
            if last:
                yield from added(batch.slice(0, last) if kept is None else pa.concat_batches([kept, batch.slice(0, last)]))
                kept = batch.slice(last)
            else:
                kept = batch if kept is None else pa.concat_batches([kept, batch])
        if kept is not None:
            yield from added(kept)

    return run


def lined_candidates(lists: DataFrame, config: RunConfig) -> DataFrame:
    """``candidate_pairs`` with ``lines``: the distinct diagonals of a pair's seeds, 8 bytes each.

    A diagonal is twice the query's place less the target's, or twice their sum
    and one where the strands differ.  Places of ``lists`` (``seed_lists`` or
    ``seed_places``) meet once, for counts and diagonals, and a pair's diagonals
    are distinct before they move.
    """
    met = _lists(lists).mapInArrow(_met_lines, _LINED)
    dealt = met.repartition("query_id", "target_id").sortWithinPartitions("query_id", "target_id")
    often = dealt.mapInArrow(_whole_pairs(config.min_shared), _LINED)
    return _judged(often.select("query_id", "target_id", "shared_minimisers", "lines", *_unflagged()), config, "lines")


#: Candidates that are broadcast at most.
MOST_BROADCAST = 1_000_000


def place_pairs(places: DataFrame, candidates: DataFrame) -> DataFrame:
    """``query_id, target_id, query_position, target_position, relative``: ``seed_pairs`` of the candidates alone.

    ``places``: ``seed_lists`` or ``seed_places``; ``candidates`` is read twice.
    Places meet where their list is.  Up to ``MOST_BROADCAST`` candidates go
    there; if there are more, the pairs of places are dealt out by their sequences.
    """
    wanted = candidates.select("query_id", "target_id")
    if wanted.count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    met = _lists(places).mapInArrow(_met_places, "query_id long, target_id long, query_position int, target_position int, same boolean").join(wanted, ["query_id", "target_id"], "left_semi")
    return met.select("query_id", "target_id", "query_position", "target_position", F.when(F.col("same"), "+").otherwise("-").alias("relative"))


def candidate_metrics(observations: DataFrame, pairs: DataFrame, candidates: DataFrame, sequences: int, max_frequency: int) -> DataFrame:
    """One row of counters, with the factor by which all pairs are reduced."""
    counts = seed_pair_bound(minimiser_frequency(observations), max_frequency)
    all_pairs = sequences * (sequences - 1) // 2
    return (
        counts.withColumn("observations", F.lit(observations.count())).withColumn("candidates", F.lit(candidates.count()))
        .withColumn("all_pairs", F.lit(all_pairs)).withColumn("reduction", F.when(F.col("candidates") > 0, F.lit(all_pairs) / F.col("candidates")))
    )


def guard(frequencies: DataFrame, config: RunConfig, max_seed_pairs: int | None) -> None:
    """Stops before a self-join whose bound is above ``max_seed_pairs``."""
    if max_seed_pairs is None:
        return
    bound = seed_pair_bound(frequencies, config.max_frequency).first()["pair_bound"]
    if bound > max_seed_pairs:
        raise InputError(f"seed pairs may reach {bound}, more than {max_seed_pairs}")


def parameter_sweep(sequences: DataFrame, kmers: list[int], windows: list[int], frequencies: list[int], config: RunConfig) -> DataFrame:
    """``kmer, window, max_frequency, unique_minimisers, retained_observations, pair_bound, candidates``: one row a setting of a stated list.

    ``sequences`` as for ``numbered``.  K-mers are hashed once for each k and
    minimisers selected once for each w, on the cluster; only the settings are
    looped over.
    """
    numbers, out = numbered(sequences), None
    c = F.col
    for k in kmers:
        several = tuple(windows) if len(windows) > 1 and k <= 31 else None
        every = seed_lists(numbers, replace(config, kmer=k, window=max(windows), max_frequency=max(frequencies)), counted=True, windows=several) if several else None
        for i, w in enumerate(windows):
            lists = every.where(c("window") == i).drop("window") if several else seed_lists(numbers, replace(config, kmer=k, window=w, max_frequency=max(frequencies)), counted=True)
            counts = pin(lists.groupBy("frequency").agg(F.sum("keys").alias("minimisers")))
            for most in frequencies:
                own = replace(config, kmer=k, window=w, max_frequency=most)
                found = candidates_of(lists.where(c("frequency").between(2, most)), own).agg(F.count("*").alias("candidates"))
                kept, n = c("frequency") <= most, c("minimisers")
                bound = counts.agg(
                    F.coalesce(F.sum(n), F.lit(0)).alias("unique_minimisers"), F.coalesce(F.sum(F.when(kept, n * c("frequency"))), F.lit(0)).alias("retained_observations"),
                    F.coalesce(F.sum(F.when(kept, n * F.expr("frequency * (frequency - 1) div 2"))), F.lit(0)).cast("long").alias("pair_bound"),
                )
                row = bound.crossJoin(found)
                row = row.select(F.lit(k).alias("kmer"), F.lit(w).alias("window"), F.lit(most).alias("max_frequency"), "unique_minimisers", "retained_observations", "pair_bound", "candidates")
                out = row if out is None else out.unionByName(row)
    return out
