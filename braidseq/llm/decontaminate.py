"""Benchmark decontamination as a prefix-filtered set join.

A window is ``length`` consecutive words of an item (a shorter item is one
window), seen as the set of its word shingles with their positions.  A document
that contains a window contains all its shingles, so the necessary prefix of a
window, in order of rarity over the corpus, is its single rarest shingle.
First the document frequency of every window shingle is counted over all
documents; then every place of a document that holds a window's rarest shingle
gives a candidate whose start and end must lie inside the document (position
and length bounds), and its words are compared one by one.

Windows are the stated query set: they are taken in blocks of at most
``block_windows``, each broadcast; the documents stream past every block.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, ascii_lower

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
SHINGLE = 5
#: Windows in a block at most about; one takes some hundred bytes.
BLOCK_WINDOWS = 100_000

_MULTIPLIER = 0x9E3779B97F4A7C15
_NEW = "n_words long, hits array<long>, items array<string>"


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", length: int = WINDOW) -> DataFrame:
    """``words`` (array of strings), ``items`` (sorted distinct ids as strings): one row a distinct window.

    Null and wordless texts have no window.  A null id marks words but names no item.
    """
    words = F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(WORD), F.lit(0))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("all") - length))
    windows = F.transform(starts, lambda i: F.slice("all", i + 1, length))
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words.alias("all")).where(F.size("all") > 0)
    return items.select("item", F.explode(windows).alias("words")).groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _word_cutter():
    """From a text to its words as bytes: separators become spaces, A-Z lower case."""
    table = bytearray(range(256))
    for b in range(128):
        if not (48 <= b <= 57 or 97 <= b <= 122):
            table[b] = b + 32 if 65 <= b <= 90 else 32
    table = bytes(table)
    return lambda text: text.encode().translate(table).split()


class Block:
    """Windows over a vocabulary of their own, with keys of their shingles.  Bounded by the block's size."""

    def __init__(self, windows: list[list[str]], items: list[list[str]], shingle: int):
        self.items = items
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        self.widths = np.array([len(w) for w in windows], dtype=np.int64)
        self.words = np.zeros((len(windows), max(map(len, windows))), dtype=np.int64)
        for i, words in enumerate(windows):
            self.words[i, : len(words)] = [number(w.encode(), len(self.vocabulary) + 1) for w in words]
        window, offset, key = [], [], []
        self.spans = sorted({min(shingle, len(w)) for w in windows})
        for span in self.spans:
            of = np.flatnonzero(np.minimum(self.widths, shingle) == span)
            keys = self.keys(self.words[of].ravel(), span).reshape(len(of), -1)
            for at in range(self.words.shape[1] - span + 1):
                inside = of[self.widths[of] >= at + span]
                window.append(inside)
                offset.append(np.full(len(inside), at))
                key.append(keys[self.widths[of] >= at + span, at])
        self.window, self.offset, key = (np.concatenate(x) for x in (window, offset, key))
        self.shingles, self.shingle_of = np.unique(key, return_inverse=True)

    @staticmethod
    def keys(ids, span: int):
        """A 64-bit key of the ``span`` ids from each place on; equal ids have equal keys, different ones nearly never."""
        out = np.full(len(ids), span, dtype=np.uint64)
        for step in range(span):
            shifted = np.zeros(len(ids), dtype=np.uint64)
            shifted[: max(0, len(ids) - step)] = ids[step:]
            out = (out ^ shifted) * np.uint64(_MULTIPLIER)
            out ^= out >> np.uint64(29)
        return out

    def places(self, ids):
        """(place, shingle number) of every window shingle in the sequence ``ids``, in which 0 is any other word."""
        known = ids != 0
        for span in self.spans:
            full = known.copy()
            for step in range(1, span):
                rest = max(0, len(ids) - step)
                full[:rest] &= known[step:]
                full[rest:] = False
            at = np.flatnonzero(full)
            if not len(at):
                continue
            keys = self.keys(ids, span)[at]
            slot = np.minimum(np.searchsorted(self.shingles, keys), len(self.shingles) - 1)
            same = self.shingles[slot] == keys
            yield at[same], slot[same]

    def keep_rarest(self, frequency) -> None:
        """Leaves each window its rarest shingle (ties: the first); windows with a shingle that no document holds go."""
        often = frequency[self.shingle_of]
        order = np.lexsort((self.offset, often, self.window))
        first = np.unique(self.window[order], return_index=True)[1]
        chosen = order[first]
        chosen = chosen[often[chosen] > 0]
        chosen = chosen[np.argsort(self.shingle_of[chosen], kind="stable")]
        self.prefix_window, self.prefix_offset = self.window[chosen], self.offset[chosen]
        self.begin = np.searchsorted(self.shingle_of[chosen], np.arange(len(self.shingles) + 1))


def _sequences(texts, vocabulary):
    """The documents' known words as one sequence of ids with a 0 after each document; starts and word counts."""
    cut, get = _word_cutter(), vocabulary.get
    ids: list[int] = []
    counts = []
    for text in texts:
        words = cut(text) if text else []
        ids += [get(w, 0) for w in words]
        ids.append(0)
        counts.append(len(words))
    n = np.array(counts, dtype=np.int64)
    return np.array(ids, dtype=np.int64), np.cumsum(n + 1) - (n + 1), n


def _frequencies(docs: DataFrame, text_col: str, block) -> DataFrame:
    """``shingle, n``: documents that hold each shingle of the block."""

    def count(batches):
        import pyarrow as pa

        from .common import sliced

        own = block.value
        total = np.zeros(len(own.shingles), dtype=np.int64)
        for batch in batches:
            for part in sliced(batch, text_col, 4_000_000):
                ids, starts, _ = _sequences(part.column(text_col).to_pylist(), own.vocabulary)
                for at, shingle in own.places(ids):
                    doc = np.searchsorted(starts, at, side="right")
                    pairs = np.unique(doc * len(total) + shingle)
                    total += np.bincount(pairs % len(total), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["shingle", "n"])

    return docs.select(text_col).mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _matcher(text_col: str, block):
    def start():
        own = block.value

        def spans(ids, starts, n):
            """(start, end, window, document) of every occurrence."""
            out = []
            for at, shingle in own.places(ids):
                many = own.begin[shingle + 1] - own.begin[shingle]
                for low in range(0, len(at), 65_536):  # bounded rows at a time
                    cut = slice(low, low + 65_536)
                    m = many[cut]
                    rank = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    entry = np.repeat(own.begin[shingle[cut]], m) + rank
                    window = own.prefix_window[entry]
                    begin = np.repeat(at[cut], m) - own.prefix_offset[entry]
                    doc = np.repeat(np.searchsorted(starts, at[cut], side="right") - 1, m)
                    fits = (begin >= starts[doc]) & (begin + own.widths[window] <= starts[doc] + n[doc])
                    begin, window, doc = begin[fits], window[fits], doc[fits]
                    same = np.ones(len(begin), dtype=bool)
                    for step in range(own.words.shape[1]):
                        inside = step < own.widths[window]
                        same &= ~inside | (ids[np.minimum(begin + step, len(ids) - 1)] == own.words[window, step])
                    out.append((begin[same], begin[same] + own.widths[window[same]], window[same], doc[same]))
            return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, dtype=np.int64)] * 4

        def work(batch):
            texts = batch.column(text_col).to_pylist()
            ids, starts, n = _sequences(texts, own.vocabulary)
            earlier = {x: batch.column(x).to_pylist() if x in batch.schema.names else [None] * len(texts) for x in ("hits", "items")}
            hits = [list(old or []) for old in earlier["hits"]]
            items = [set(old or []) for old in earlier["items"]]
            begin, end, window, doc = spans(ids, starts, n)
            order = np.argsort(doc, kind="stable")
            begin, end, window, doc = begin[order], end[order], window[order], doc[order]
            found, first = np.unique(doc, return_index=True)
            for k, low, high in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(doc)]):
                mine = slice(low, high)
                edges = [(b - int(starts[k]), e - int(starts[k])) for b, e in zip(begin[mine].tolist(), end[mine].tolist())]
                old = hits[k]
                edges = sorted({*edges, *zip(old[::2], old[1::2])})
                merged: list[int] = []
                for b, e in edges:
                    if merged and b <= merged[-1]:
                        merged[-1] = max(merged[-1], e)
                    else:
                        merged += [b, e]
                hits[k] = merged
                for w in np.unique(window[mine]).tolist():
                    items[k].update(own.items[w])
            return [n, hits, [sorted(x) for x in items]]

        return work

    return start


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    length: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` (start, end, start, end, ... of the words inside windows) and ``items`` (ids as strings, sorted).

    Null and empty texts have no words; texts of any length are read whole.
    Every other column passes through; columns of ``docs`` named like a result
    are replaced.  Repeated rows are rows of their own.  An empty benchmark hits
    nothing, empty documents give an empty result.
    """
    spark = docs.sparkSession
    windows = item_windows(benchmark, item_col, item_text, length)
    blocks = math.ceil(windows.count() / block_windows)
    out = docs.drop("n_words", "hits", "items")
    if not blocks:
        none = F.array().cast("array<long>"), F.array().cast("array<string>")
        count = F.coalesce(F.regexp_count(ascii_lower(F.col(text_col)), F.lit(WORD)), F.lit(0)).cast("long")
        return out.withColumns({"n_words": count, "hits": none[0], "items": none[1]})
    numbered = windows.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks)))
    for k in range(blocks):
        rows = numbered.where(F.col("block") == k).select("words", "items").collect()
        if not rows:
            continue
        rows.sort(key=lambda r: r["words"])
        block = Block([r["words"] for r in rows], [r["items"] for r in rows], shingle)
        counting = spark.sparkContext.broadcast(block)
        found = _frequencies(docs, text_col, counting).collect()  # a row a shingle of the block at most
        frequency = np.zeros(len(block.shingles), dtype=np.int64)
        for row in found:
            frequency[row["shingle"]] = row["n"]
        counting.unpersist()
        block.keep_rarest(frequency)
        ready = spark.sparkContext.broadcast(block)
        # The first block's results are columns; each further block takes them in and gives them anew.
        out = _carry(out, text_col, ready) if "hits" in out.columns else append_columns(out, _NEW, text_col, _matcher(text_col, ready))
    return out


def _carry(found: DataFrame, text_col: str, block) -> DataFrame:
    """Another block over documents that carry the results of earlier ones."""
    renamed = found.withColumnsRenamed({"hits": "_hits", "items": "_items"}).drop("n_words")
    inner = _matcher(text_col, block)

    def start():
        import pyarrow as pa

        work = inner()

        def again(batch):
            names = [{"_hits": "hits", "_items": "items"}.get(x, x) for x in batch.schema.names]
            return work(pa.RecordBatch.from_arrays(batch.columns, names=names))

        return again

    return append_columns(renamed, _NEW, text_col, start).drop("_hits", "_items")


def with_verdict(found: DataFrame, share_inverse: int = 20) -> DataFrame:
    """Adds ``n_hit`` and ``contaminated``: some word is hit, and at least one in ``share_inverse`` words."""
    pairs = F.sequence(F.lit(1), F.col("n_hit_edges") - 1, F.lit(2))
    total = F.aggregate(
        F.when(F.col("n_hit_edges") > 0, pairs).otherwise(F.array().cast("array<int>")),
        F.lit(0).cast("long"),
        lambda acc, i: acc + F.element_at("hits", i + 1) - F.element_at("hits", i),
    )
    return (
        found.withColumn("n_hit_edges", F.size("hits")).withColumn("n_hit", total).drop("n_hit_edges")
        .withColumn("contaminated", (F.col("n_hit") > 0) & (share_inverse * F.col("n_hit") >= F.col("n_words")))
    )
