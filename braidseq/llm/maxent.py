"""A hashed maximum-entropy language model with class-factored softmax.

The event space is that of add-0.1 unigram counts: all tokens of the training
texts and one for all others.  The most frequent words fill classes of equal
size, everything else is one class more.  A token's probability is that of its
class given the words before it, times that of the token in its class: for the
filled classes a softmax over their words given the words before it, for the
last class its share of the counts.  All weights are rows of one table, which
hashed features of the words before a token select: bigram, trigram and skip
for the class, bigram and skip within it.  With zero weights the model is the
smoothed unigram model, so the features only add what they learn.

Training is by gradient steps in all tasks at once: each goes once over its
part of the texts from the weights it was given, and the weights are averaged
row by row, each task's by how often it met the row.  Every round does so over
texts of its own, so each training text is seen once.  Counts are over all
training texts and exact for every word: the most frequent ones are broadcast
(bounded in number and bytes), the others are joined by key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import repeat
from math import isqrt, log, log10

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, stored

#: Words whose counts are broadcast at most, and the bytes of one at most.
HEAD_WORDS, HEAD_BYTES = 1 << 18, 64
#: Classes of words, the last for what is in no other, and words in each other class.
CLASSES, SLOTS = 64, 64
MODELLED = (CLASSES - 1) * SLOTS
#: Rows of the weight table for each kind of feature; half of a bigram or skip kind is for the most frequent words alone.
BIGRAM, SKIP, TRIGRAM, INNER, INNER_SKIP = 4096, 2048, 8192, 256, 64
KINDS = {"bigram": BIGRAM, "skip": SKIP, "trigram": TRIGRAM, "inner": (CLASSES - 1) * INNER, "inner_skip": (CLASSES - 1) * INNER_SKIP}
STARTS = dict(zip(KINDS, np.cumsum([0, *KINDS.values()]).tolist()))
ROWS = sum(KINDS.values())
#: Tokens of a gradient step, its length, and rounds of averaging.
STEP_TOKENS, RATE, ROUNDS = 4096, 0.5, 2
#: Tokens scored at once, and bytes of text in memory as words.
SCORE_TOKENS, TEXT_BYTES = 4096, 2_000_000
#: Words a task counts before it hands its counts on.
MOST_COUNTED = 400_000
#: The added count; buckets of counts in a doubling.
ADDED, BUCKETS = 0.1, 64
#: Rows of the weight table in a row that tasks exchange.
BLOCK = 512
#: The token after the last word; no word has a space.
END = b" "


@dataclass(frozen=True)
class LanguageModel:
    """``words`` by falling count with their ``counts``; ``rare`` is the table (word, n) of the other counted words."""

    tokens: int
    distinct: int
    words: tuple[bytes, ...]
    counts: np.ndarray
    rare: DataFrame
    weights: np.ndarray

    def outlook(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Logarithms of the classes' shares, of the words' shares in their classes (padded), and of the last class's total, all with the added counts."""
        few = self.counts[:MODELLED] + ADDED
        inner = np.full(MODELLED, -np.inf)
        inner[: len(few)] = np.log(few)
        inner = inner.reshape(CLASSES - 1, SLOTS)
        masses = np.exp(inner).sum(axis=1)
        last = self.tokens - float(self.counts[:MODELLED].sum()) + ADDED * (self.distinct - len(few) + 1)
        with np.errstate(divide="ignore"):
            classes = np.log(np.append(masses, last) / (masses.sum() + last))
        return classes.astype(np.float32), inner.astype(np.float32), log(last)


def remainder(key: Column, by: int) -> Column:
    """The CRC-32 of the key as text modulo ``by``; null for null."""
    return F.crc32(key.cast("string").cast("binary")) % by


# --- counts


def count_words(texts: DataFrame) -> DataFrame:
    """``word`` (binary), ``n``: the tokens of the column ``text``, one END a row included."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        def rows(counts):
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        counts = Counter()
        for batch in batches:
            for part in sliced(batch, "text", TEXT_BYTES):
                counts[END] += part.num_rows
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    counts.update((text or b"").lower().split())
                if len(counts) > MOST_COUNTED:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _head(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words above the least count for which there are no more than HEAD_WORDS of them, and all others.  Very long words are never in the head."""
    bucket = F.floor(F.log2(F.col("n").cast("double")) * BUCKETS)
    short = F.octet_length("word") <= HEAD_BYTES
    sizes = counts.where(short).groupBy(bucket.alias("b")).agg(F.count("*").alias("words")).collect()
    least, total = None, 0
    for row in sorted(sizes, key=lambda r: -r["b"]):
        total += row["words"]
        if total > HEAD_WORDS:
            break
        least = row["b"]
    held = short & (bucket >= F.lit(least)) if least is not None else F.lit(False)
    return counts.where(held), counts.where(~held)


# --- what tasks do


class _Reader:
    """Turns texts into numbers of words and of features."""

    def __init__(self, words, counts):
        self.number = {w: i for i, w in enumerate(words)}
        self.unknown, self.start = len(words), len(words) + 1
        ids = np.arange(len(words) + 2, dtype=np.uint64)
        mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)

        def folded(size: int) -> np.ndarray:
            half = size // 2
            return np.where(ids < half, ids, half + mixed % np.uint64(half)).astype(np.int32)

        self.bigram, self.skip, self.inner, self.inner_skip = (folded(s) for s in (BIGRAM, SKIP, INNER, INNER_SKIP))
        rank = np.append(np.minimum(np.arange(len(words)), MODELLED), [MODELLED, MODELLED])
        self.group, self.slot = (rank // SLOTS).astype(np.int32), (rank % SLOTS).astype(np.int32)
        self.counts = np.append(counts, [0, 0]).astype(np.float64)

    def read(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """The tokens' numbers, the texts' lengths in tokens, and the tokens."""
        tokens, lengths = [], []
        for text in texts:
            words = text.lower().split() if text else []
            tokens += words
            tokens.append(END)
            lengths.append(len(words) + 1)
        return np.fromiter(map(self.number.get, tokens, repeat(self.unknown)), dtype=np.int32, count=len(tokens)), np.array(lengths, dtype=np.int64), tokens

    def features(self, ids: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
        """For each token its class, its place in it, and the rows of the weight table."""
        first = np.cumsum(lengths) - lengths
        before, skipped = np.empty_like(ids), np.empty_like(ids)
        before[1:], skipped[2:] = ids[:-1], ids[:-2]
        before[first] = skipped[first] = self.start
        skipped[first[lengths > 1] + 1] = self.start
        one, two = self.bigram[before], self.bigram[skipped]
        mixed = (one.astype(np.uint64) * np.uint64(BIGRAM) + two.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        group = self.group[ids]
        kept = np.minimum(group, CLASSES - 2)
        return {
            "group": group,
            "slot": self.slot[ids],
            "bigram": one,
            "skip": STARTS["skip"] + self.skip[skipped],
            "trigram": STARTS["trigram"] + (mixed >> np.uint64(64 - TRIGRAM.bit_length() + 1)).astype(np.int32),
            "inner": STARTS["inner"] + kept * INNER + self.inner[before],
            "inner_skip": STARTS["inner_skip"] + kept * INNER_SKIP + self.inner_skip[skipped],
        }


_READERS: dict[str, _Reader] = {}


def _reader(shared) -> _Reader:
    """The reader of this worker; only the last one is kept."""
    name, words, counts = shared.value
    if name not in _READERS:
        _READERS.clear()
        _READERS[name] = _Reader(words.split(b"\n") if words else [], counts)
    return _READERS[name]


OUTER_FEATURES, INNER_FEATURES = ("bigram", "skip", "trigram"), ("inner", "inner_skip")


def _rows(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``table[at]`` for places that lie in it: clipping saves the copy by which numpy guards against others."""
    return np.take(table, at, axis=0, mode="clip")


def _exps(weights: np.ndarray, rows: list[np.ndarray], outlook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of the logits, and the logits."""
    z = _rows(weights, rows[0])
    for more in rows[1:]:
        z += _rows(weights, more)
    z += outlook
    if z.max(initial=0) > 60:
        np.minimum(z, np.float32(60), out=z)
    return np.exp(z), z


def _totals(e: np.ndarray) -> np.ndarray:
    """The sums of the rows; much quicker than ``sum`` on rows as short as these."""
    return np.einsum("ij->i", e)


def _added(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ``rows``, how often each is met, and the sums of their ``values``.

    Neighbours of a sorted run are added in pairs, then pairs of pairs: whole
    rows move at once, whether runs are long or short.  The first sums are taken
    from ``values`` as they lie, so no row moves before it is added.
    """
    n = len(rows)
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    found = rows[order]
    first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
    times = np.diff(first, append=n)
    place = np.arange(n) - np.repeat(first, times)
    left = np.repeat(times, times) - place
    even = place & 1 == 0
    live, lone = np.flatnonzero(even & (left > 1)), np.flatnonzero(even & (left == 1))
    x = _rows(values, order[np.concatenate([live, lone])])
    x[: len(live)] += _rows(values, order[live + 1])
    at = np.empty(n, dtype=np.intp)
    at[live], at[lone] = np.arange(len(live)), np.arange(len(live), len(x))
    apart = 2
    while True:
        live = live[(place[live] & (2 * apart - 1) == 0) & (left[live] > apart)]
        if not len(live):
            break
        both = _rows(x, at[live])
        both += _rows(x, at[live + apart])
        x[at[live]] = both
        apart *= 2
    return found[first], times, _rows(x, at[first])


def _ascend(weights, met, spread, rows, slope):
    """One step along ``slope`` (a row an event) for the weights that ``rows`` select, scaled by the length of the slopes so far."""
    at, times, total = _added(rows, slope)
    met[at] += times
    spread[at] += np.einsum("ij,ij->i", total, total)
    total *= (RATE / np.sqrt(spread[at] + 1e-6))[:, None]
    total += _rows(weights, at)
    weights[at] = total


def _step(weights, met, spread, f, classes, inner) -> None:
    """A gradient step on one block of events."""
    n = len(f["group"])
    for names, outlook, events, target in (
        (OUTER_FEATURES, classes, slice(None), f["group"]),
        (INNER_FEATURES, inner, np.flatnonzero(f["group"] < CLASSES - 1), f["slot"]),
    ):
        target = target[events]
        n = len(target)
        if not n:
            continue
        rows = [f[name][events] for name in names]
        p, _ = _exps(weights, rows, _rows(outlook, f["group"][events]) if outlook.ndim == 2 else outlook)
        p *= (np.float32(-1) / _totals(p))[:, None]
        p[np.arange(n), target] += np.float32(1)
        for one in rows:
            _ascend(weights, met, spread, one, p)


def _log_probability(weights, f, classes, inner) -> np.ndarray:
    """Of each token's class, and of the token in it for all classes but the last."""
    n = len(f["group"])
    e, z = _exps(weights, [f[name] for name in OUTER_FEATURES], classes)
    out = z[np.arange(n), f["group"]].astype(np.float64) - np.log(_totals(e), dtype=np.float64)
    few = np.flatnonzero(f["group"] < CLASSES - 1)
    if len(few):
        e, z = _exps(weights, [f[name][few] for name in INNER_FEATURES], _rows(inner, f["group"][few]))
        out[few] += z[np.arange(len(few)), f["slot"][few]].astype(np.float64) - np.log(_totals(e), dtype=np.float64)
    return out


def _part(f: dict[str, np.ndarray], at: int, size: int) -> dict[str, np.ndarray]:
    return {k: v[at : at + size] for k, v in f.items()}


# --- training


def _round(texts: DataFrame, head, model: LanguageModel) -> np.ndarray:
    """The weights after all tasks went over ``texts`` from the model's weights, averaged."""
    classes, inner, _ = model.outlook()
    given = texts.sparkSession.sparkContext.broadcast(model.weights)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        reader = _reader(head)
        weights, met, spread = given.value.copy(), np.zeros(ROWS), np.zeros(ROWS, dtype=np.float32)
        for batch in batches:
            for part in sliced(batch, "text", TEXT_BYTES):
                ids, lengths, _ = reader.read(part.column("text").cast(pa.binary()).to_pylist())
                f = reader.features(ids, lengths)
                for at in range(0, len(ids), STEP_TOKENS):
                    _step(weights, met, spread, _part(f, at, STEP_TOKENS), classes, inner)
        starts = [at for at in range(0, ROWS, BLOCK) if met[at : at + BLOCK].any()]
        sums = [(weights[at : at + BLOCK] * met[at : at + BLOCK, None]).astype(np.float32).tobytes() for at in starts]
        here = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([here] * len(starts), pa.int64()), pa.array(starts, pa.int64()), pa.array(sums, pa.binary()), pa.array([met[at : at + BLOCK].tobytes() for at in starts], pa.binary())],
            ["part", "start", "sums", "met"],
        )

    def added(_, parts):
        import pandas as pd

        parts = parts.sort_values("part")
        both = [reduce(np.add, (np.frombuffer(x, dtype=kind).astype(np.float64) for x in parts[c])) for c, kind in (("sums", np.float32), ("met", np.float64))]
        return pd.DataFrame({"part": parts["part"][:1], "start": parts["start"][:1], "sums": [both[0].astype(np.float32).tobytes()], "met": [both[1].tobytes()]})

    schema = "part long, start long, sums binary, met binary"
    made = texts.select("text").mapInArrow(run, schema)
    salts = isqrt(texts.rdd.getNumPartitions())
    if salts > 1:
        made = made.groupBy("start", (F.col("part") % salts).alias("salt")).applyInPandas(added, schema)
    weights = model.weights.copy()
    for row in made.groupBy("start").applyInPandas(added, schema).collect():
        met = np.frombuffer(bytes(row["met"]))
        sums = np.frombuffer(bytes(row["sums"]), dtype=np.float32).reshape(len(met), SLOTS)
        seen = np.flatnonzero(met)
        weights[row["start"] + seen] = sums[seen] / met[seen, None]
    return weights


def _shared(spark, model: LanguageModel):
    import uuid

    return spark.sparkContext.broadcast((uuid.uuid4().hex, b"\n".join(model.words), model.counts))


def train_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> LanguageModel:
    """The model of all texts of ``docs``; null texts are empty ones, an empty table gives the model in which every token is the unknown one."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(remainder(F.col(id_col), 1 << 16), F.lit(0)).alias("deal"), F.col(text_col).alias("text"))
    counts = stored(count_words(texts), "words")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("words")).first()
    frequent, rare = _head(counts)
    head = sorted(((bytes(r["word"]), r["n"]) for r in frequent.collect()), key=lambda r: (-r[1], r[0]))
    model = LanguageModel(totals["tokens"], totals["words"], tuple(w for w, _ in head), np.array([n for _, n in head], dtype=np.int64), rare, np.zeros((ROWS, SLOTS), dtype=np.float32))
    shared = _shared(spark, model)
    for k in range(rounds):
        own = texts.where(F.floor(F.col("deal") * rounds / (1 << 16)) == k)
        model = LanguageModel(model.tokens, model.distinct, model.words, model.counts, rare, _round(own, shared, model))
    return model


# --- scoring


def score_language_model(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, n_tokens, n_known, base_score, score`` for every row of ``docs``: log10 probabilities of whole texts.

    ``base_score`` is by add-0.1 counts, ``score`` by the model.  Null and empty
    texts have one token, the end.  Rows with equal or null ids are rows of
    their own.  Other columns are left out, so none can clash.  Empty tables
    give empty results.
    """
    shared = _shared(docs.sparkSession, model)
    given = docs.sparkSession.sparkContext.broadcast(model.weights)
    classes, inner, last = model.outlook()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        reader, weights = _reader(shared), given.value
        logs = np.log10(reader.counts + ADDED)
        # The unknown word's count is looked up elsewhere, its class is not.
        logs[reader.unknown] = 0.0
        in_last = np.where(reader.group == CLASSES - 1, logs - last / log(10), 0.0)
        for batch in batches:
            for part in sliced(batch, "text", TEXT_BYTES):
                ids, lengths, tokens = reader.read(part.column("text").cast(pa.binary()).to_pylist())
                f = reader.features(ids, lengths)
                found = np.concatenate([_log_probability(weights, _part(f, at, SCORE_TOKENS), classes, inner) for at in range(0, len(ids), SCORE_TOKENS)])
                owner, m = np.repeat(np.arange(len(lengths)), lengths), len(lengths)
                of = lambda x: np.bincount(owner, weights=x, minlength=m)
                unknown = np.flatnonzero(ids == reader.unknown)
                bounds = np.searchsorted(owner[unknown], np.arange(m + 1)).tolist()
                places = unknown.tolist()
                rest = [Counter([tokens[i] for i in places[a:b]]) for a, b in zip(bounds, bounds[1:])]
                offsets = np.cumsum([0, *map(len, rest)])
                words = pa.StructArray.from_arrays(
                    [pa.array([w for c in rest for w in c], pa.binary()), pa.array([n for c in rest for n in c.values()], pa.int64())], ["word", "times"]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), part.column("row"), pa.array(lengths), pa.array(of((ids != reader.unknown).astype(float)).astype(np.int64)),
                        pa.array(of(logs[ids])), pa.array(of(found / log(10) + in_last[ids])), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words),
                    ],
                    ["id", "row", "n_tokens", "n_known", "base", "score", "rest"],
                )

    schema = f"id {kind}, row long, n_tokens long, n_known long, base double, score double, rest array<struct<word: binary, times: bigint>>"
    scored = stored(rows.mapInArrow(run, schema), "scored")
    rest = scored.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.times")
    logs = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + ADDED)
    known = F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)
    looked_up = rest.join(model.rare, "word", "left").select("row", logs.alias("more"), known.alias("seen")).groupBy("row").agg(F.sum("more").alias("more"), F.sum("seen").alias("seen"))
    all_tokens = F.lit(log10(model.tokens + ADDED * (model.distinct + 1)))
    return (
        scored.drop("rest").join(looked_up, "row", "left")
        .select(
            F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
            (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * all_tokens).alias("base_score"),
            (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
        )
    )
