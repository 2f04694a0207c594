"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word's input is the embedding of the word, if the training sample knows it,
beside the last states of a bidirectional gated recurrent network that reads
the word's characters (UTF-8 bytes) in order.  A window of ``WINDOW`` words runs
through gated recurrent units in both directions; attention pools their states
into a logit.  Windows overlap; all windows of a text are scored, and the text
has the score of its highest.  Words of more than ``PIECE`` bytes are several
words, so every byte is read.

Training sees a bounded sample of labelled rows, whole texts, all windows of
each: ``MOST_TOXIC`` and ``MOST_CLEAN`` documents by hash order of their ids, as
far as ``MOST_BYTES`` of text go for each label.  Three quarters of it train the
network; the other quarter, which it hasn't seen, sets the decision.
"""

from __future__ import annotations

from dataclasses import dataclass
from pickle import dumps, loads

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_columns

#: Labelled documents that training takes at most, and bytes of their texts for each label.
MOST_TOXIC, MOST_CLEAN, MOST_BYTES = 1500, 2500, 12_000_000
WINDOW, STRIDE = 48, 32
PIECE = 24
THRESHOLD = 0.3
#: One in so many documents of the sample sets the decision instead of training.
SET_ASIDE = 4
_UNITS, _WORD_DIM, _ATTENTION = 12, 12, 8
_BYTE_DIM, _BYTE_UNITS = 6, 6
_INPUT = _WORD_DIM + 2 * _BYTE_UNITS
_LEAST_DOCS = 3
#: Words whose inputs a scorer remembers; it starts anew beyond that, with the same results.
_REMEMBERED = 80_000
#: Windows that a scorer runs at once, which bounds the new words it spells at once, and bytes of text that it gets at once.
_RUN, _TEXT_BYTES = 512, 1_000_000
_BATCH, _RATE, _DECAY = 64, 0.01, 1e-4
#: Passes over the sample: so many that about as many steps are made, within these bounds.
_STEPS, _EPOCHS = 1200, (6, 40)
#: Words that are spelled at once when a whole vocabulary is.
_SPELLED = 20_000
_PAD, _OTHER = 0, 1


def _cutter():
    table = bytearray(range(256))
    for b in range(128):
        if not (48 <= b <= 57 or 97 <= b <= 122):
            table[b] = b + 32 if 65 <= b <= 90 else 32
    table = bytes(table)

    def cut(text: str) -> list[bytes]:
        words = text.encode().translate(table).split()
        if words and max(map(len, words)) > PIECE:
            words = [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]
        return words

    return cut


def _starts(n: int) -> range:
    """Where the windows of ``n`` words begin: one at least, and the last reaches the end."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _sum_by(key: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """The sums of ``rows`` for each key from 0 to ``size - 1``."""
    out = np.zeros((size, rows.shape[1]), dtype=rows.dtype)
    if len(key):
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        out[key[order][first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def _step(x: np.ndarray, state: np.ndarray, hidden: np.ndarray) -> tuple[np.ndarray, tuple]:
    """One step of both directions: the states after it, and what ``_step_back`` needs.  ``x``: inputs of the gates, 2 x rows x 3 units."""
    units = hidden.shape[1]
    g = np.matmul(state, hidden)
    gates = _sigmoid(x[..., : 2 * units] + g[..., : 2 * units])
    z, r = gates[..., :units], gates[..., units:]
    new = np.tanh(x[..., 2 * units :] + r * g[..., 2 * units :])
    return new + z * (state - new), (state, z, r, new, g[..., 2 * units :])


def _step_back(d_now: np.ndarray, kept: tuple, hidden: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the gates' inputs, of ``hidden``, and of the states before, from that of the states after."""
    state, z, r, new, g = kept
    d_new = d_now * (1 - z) * (1 - new**2)
    d_z = d_now * (state - new) * z * (1 - z)
    d_r = d_new * g * r * (1 - r)
    d_g = np.concatenate([d_z, d_r, d_new * r], axis=-1)
    d_hidden = np.matmul(state.transpose(0, 2, 1), d_g)
    return np.concatenate([d_z, d_r, d_new], axis=-1), d_hidden, d_now * z + np.matmul(d_g, hidden.transpose(0, 2, 1))


def _packed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words by length, longest first: their order, their bytes from either end (2 x words x places), and how many reach each place."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    most = int(sizes.max(initial=0))
    flat = np.frombuffer(b"".join(words), dtype=np.uint8)
    first = (np.cumsum(sizes) - sizes)[order]
    at = np.arange(most)
    inside = at < sizes[order][:, None]
    ahead = np.where(inside, first[:, None] + at, 0)
    back = np.where(inside, first[:, None] + sizes[order][:, None] - 1 - at, 0)
    text = np.stack([flat[ahead], flat[back]]) if len(flat) else np.zeros((2, len(words), 0), dtype=np.uint8)
    return order, text, inside.sum(axis=0)


@dataclass
class Model:
    words: dict[bytes, int]
    weights: dict[str, np.ndarray]
    shift: float = 0.0

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.array([self.words.get(w, _OTHER) for w in words], dtype=np.int64)

    def spell(self, words: list[bytes], keep: list | None = None) -> np.ndarray:
        """The last states of both directions over each word's bytes."""
        w = self.weights
        order, text, reach = _packed(words)
        table = np.matmul(w["bytes"][None], w["byte_in"]) + w["byte_bias"][:, None]
        state = np.zeros((2, len(words), _BYTE_UNITS), dtype=table.dtype)
        for s, n in enumerate(reach.tolist()):
            x = np.stack([table[0][text[0, :n, s]], table[1][text[1, :n, s]]])
            state[:, :n], kept = _step(x, state[:, :n].copy(), w["byte_hidden"])
            if keep is not None:
                keep.append(kept)
        if keep is not None:
            keep.append((order, text, reach))
        out = np.empty((len(words), 2 * _BYTE_UNITS), dtype=table.dtype)
        out[order] = np.concatenate([state[0], state[1]], axis=-1)
        return out

    def spell_back(self, d_out: np.ndarray, keep: list) -> dict[str, np.ndarray]:
        """Gradients of the byte network from those of its last states."""
        w = self.weights
        order, text, reach = keep[-1]
        d_state = np.stack([d_out[order, :_BYTE_UNITS], d_out[order, _BYTE_UNITS:]])
        d_hidden = np.zeros_like(w["byte_hidden"])
        read, d_read = [np.zeros((2, 0), dtype=np.uint8)], [np.zeros((2, 0, 3 * _BYTE_UNITS), dtype=d_out.dtype)]
        for s in range(len(reach) - 1, -1, -1):
            n = int(reach[s])
            d_x, more, d_state[:, :n] = _step_back(d_state[:, :n].copy(), keep[s], w["byte_hidden"])
            d_hidden += more
            read.append(text[:, :n, s])
            d_read.append(d_x)
        of, d_x = np.concatenate(read, axis=1), np.concatenate(d_read, axis=1)
        d_table = np.stack([_sum_by(of[way].astype(np.int64), d_x[way], 256) for way in (0, 1)])
        return {
            "byte_hidden": d_hidden, "byte_in": np.matmul(w["bytes"].T[None], d_table), "byte_bias": d_table.sum(axis=1),
            "bytes": (d_table @ w["byte_in"].transpose(0, 2, 1)).sum(axis=0),
        }

    def inputs(self, number: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        return np.concatenate([self.weights["words"][number], spelled], axis=1)

    def padding(self) -> np.ndarray:
        """The input of places beyond a text's end."""
        return np.concatenate([self.weights["words"][_PAD], np.zeros(2 * _BYTE_UNITS, dtype=np.float32)])[None]

    def project(self, inputs: np.ndarray) -> np.ndarray:
        """What both directions' gates get from each input: ``2 x n x 3 units``."""
        return np.matmul(inputs[None], self.weights["in"]) + self.weights["bias"][:, None]

    def run(self, projected: np.ndarray, ids: np.ndarray, keep: list | None = None):
        """Logits of windows (``ids``: windows x places, 0 pads)."""
        w = self.weights
        n, places = ids.shape
        turned = np.ascontiguousarray(ids.T)
        state = np.zeros((2, n, _UNITS), dtype=np.float32)
        states = np.empty((places, 2, n, _UNITS), dtype=np.float32)
        for s in range(places):
            x = np.stack([projected[0][turned[s]], projected[1][turned[places - 1 - s]]])
            state, kept = _step(x, state, w["hidden"])
            states[s] = state
            if keep is not None:
                keep.append(kept)
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1)
        hidden = np.tanh(both @ w["attend"] + w["attend_bias"])
        score = hidden @ w["attend_out"]
        score[turned == _PAD] = -1e4
        score -= score.max(axis=0)
        alpha = np.exp(score)
        alpha /= alpha.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", alpha, both)
        logit = pooled @ w["out"] + w["out_bias"]
        return logit if keep is None else (logit, both, hidden, alpha, pooled, turned)

    def gradient(self, projected: np.ndarray, ids: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss, the inputs' as ``projected``."""
        w, units = self.weights, _UNITS
        keep: list = []
        logit, both, hidden, alpha, pooled, turned = self.run(projected, ids, keep)
        grad: dict[str, np.ndarray] = {}
        d = ((_sigmoid(logit.copy()) - label) * weight / weight.sum()).astype(np.float32)
        grad["out"], grad["out_bias"] = pooled.T @ d, np.array([d.sum()], dtype=np.float32)
        d_pooled = d[:, None] * w["out"]
        d_both = alpha[..., None] * d_pooled
        d_alpha = np.einsum("tnk,nk->tn", both, d_pooled)
        d_score = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        grad["attend_out"] = np.einsum("tnk,tn->k", hidden, d_score)
        d_hidden = d_score[..., None] * w["attend_out"] * (1 - hidden**2)
        grad["attend"] = np.einsum("tnk,tna->ka", both, d_hidden)
        grad["attend_bias"] = d_hidden.sum(axis=(0, 1))
        d_both += d_hidden @ w["attend"].T
        d_states = np.stack([d_both[..., :units], d_both[::-1, :, units:]], axis=1)
        carry = np.zeros_like(d_states[0])
        grad["hidden"] = np.zeros_like(w["hidden"])
        d_inputs = np.empty((2, *turned.shape, 3 * units), dtype=np.float32)
        places = len(keep)
        for s in range(places - 1, -1, -1):
            d_x, more, carry = _step_back(d_states[s] + carry, keep[s], w["hidden"])
            grad["hidden"] += more
            d_inputs[0, s], d_inputs[1, places - 1 - s] = d_x
        flat = turned.ravel()
        d_projected = np.stack([_sum_by(flat, d_inputs[way].reshape(len(flat), -1), projected.shape[1]) for way in (0, 1)])
        grad["projected"] = d_projected
        return grad


def _fresh(n_words: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    some = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {
        "words": some(n_words, _WORD_DIM, scale=0.1), "bytes": some(256, _BYTE_DIM, scale=0.5),
        "byte_in": some(2, _BYTE_DIM, 3 * _BYTE_UNITS, scale=_BYTE_DIM**-0.5), "byte_bias": np.zeros((2, 3 * _BYTE_UNITS), dtype=np.float32),
        "byte_hidden": some(2, _BYTE_UNITS, 3 * _BYTE_UNITS, scale=_BYTE_UNITS**-0.5),
        "in": some(2, _INPUT, 3 * _UNITS, scale=_INPUT**-0.5), "bias": np.zeros((2, 3 * _UNITS), dtype=np.float32),
        "hidden": some(2, _UNITS, 3 * _UNITS, scale=_UNITS**-0.5),
        "attend": some(2 * _UNITS, _ATTENTION, scale=0.3), "attend_bias": np.zeros(_ATTENTION, dtype=np.float32), "attend_out": some(_ATTENTION, scale=0.3),
        "out": some(2 * _UNITS, scale=0.3), "out_bias": np.zeros(1, dtype=np.float32),
    }


def train(windows: list[list[bytes]], labels: list[int], counts: tuple[int, int] | None = None, aside: list[bool] | None = None, seed: int = 5) -> Model:
    """A model from documents, each a list of windows (words joined by spaces), with labels 0 and 1.

    The first epochs take windows at random under their document's label; the
    others take each document's highest window.  Documents that are set
    ``aside`` (by default every fourth of each label) train nothing; the
    decision is the cut with the highest F1 on them, each label weighted to its
    share of ``counts`` (clean and toxic rows of the whole table).  Without
    documents of both labels the model knows only how frequent the label is.
    """
    rng = np.random.default_rng(seed)
    label = np.array(labels, dtype=np.float32)
    number = {w: i for i, w in enumerate(sorted({w for doc in windows for window in doc for w in window.split()}))}
    everything = list(number)
    ids = np.zeros((sum(map(len, windows)), WINDOW), dtype=np.int32)
    owner = np.repeat(np.arange(len(windows)), [len(doc) for doc in windows])
    for k, window in enumerate(window for doc in windows for window in doc):
        own = [number[w] + 1 for w in window.split()]
        ids[k, : len(own)] = own
    if aside is None:
        place = np.where(label == 1, np.cumsum(label == 1), np.cumsum(label == 0))
        apart = place % SET_ASIDE == 0
    else:
        apart = np.array(aside, dtype=bool)
    if not all(((label == x) & ~apart).any() and ((label == x) & apart).any() for x in (0, 1)):
        apart = np.zeros(len(label), dtype=bool)  # too few documents: all train and all decide
    learns = ~apart[owner] if len(owner) else np.zeros(0, dtype=bool)
    in_docs = np.zeros(len(everything), dtype=np.int64)
    firsts = np.searchsorted(owner, np.arange(len(label) + 1))
    for k in np.flatnonzero(~apart).tolist():
        own = np.unique(ids[firsts[k] : firsts[k + 1]])
        in_docs[own[own > 0] - 1] += 1
    words = {everything[i]: k + 2 for k, i in enumerate(np.flatnonzero(in_docs >= _LEAST_DOCS).tolist())}
    model = Model(words, _fresh(len(words) + 2, rng))
    if not len(label) or label.min() == label.max():
        model.weights["out"][:] = 0
        model.shift = 3.0 if not len(label) or label.max() == 0 else -3.0
        return model

    wid = model.numbers(everything)
    share = label[~apart].mean()
    balance = np.where(label == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step = 0

    def logits_of(rows: np.ndarray) -> np.ndarray:
        spelled = [model.spell(everything[a : a + _SPELLED]) for a in range(0, max(1, len(everything)), _SPELLED)]
        projected = model.project(np.concatenate([model.padding(), model.inputs(wid, np.concatenate(spelled))]))
        return np.concatenate([model.run(projected, ids[rows[a : a + 1024]]) for a in range(0, len(rows), 1024)])

    def highest(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each document's windows among ``rows`` the highest, and its logit."""
        logit = logits_of(rows)
        order = np.lexsort((logit, owner[rows]))
        last = order[np.r_[owner[rows][order][1:] != owner[rows][order][:-1], True]]
        return rows[last], logit[last]

    taught = np.flatnonzero(learns)
    documents = int((~apart).sum())
    epochs = int(np.clip(_STEPS * _BATCH // (2 * documents), *_EPOCHS))
    for epoch in range(epochs):
        if epoch < max(2, epochs // 4):
            order = rng.permutation(taught)
            chosen = order[np.argsort(owner[order], kind="stable")]
            rank = np.arange(len(chosen)) - np.searchsorted(owner[chosen], owner[chosen])
            chosen = chosen[rank < 4]
        else:
            top, _ = highest(taught)
            clean = rng.permutation(taught[label[owner[taught]] == 0])[: len(top) // 2]
            chosen = np.concatenate([top, clean])
        chosen = rng.permutation(chosen)
        for at in range(0, len(chosen), _BATCH):
            own = chosen[at : at + _BATCH]
            used, inverse = np.unique(ids[own], return_inverse=True)
            if used[0] != _PAD:
                used, inverse = np.r_[_PAD, used], inverse + 1
            inverse = inverse.reshape(len(own), WINDOW)
            real = used[1:] - 1
            numbers = np.where(rng.random(len(real)) < 0.3, _OTHER, wid[real])
            keep: list = []
            spelled = model.spell([everything[i] for i in real.tolist()], keep)
            table = np.concatenate([model.padding(), model.inputs(numbers, spelled)])
            doc = owner[own]
            grad = model.gradient(model.project(table), inverse, label[doc], balance[doc])
            d_projected = grad.pop("projected")
            grad["in"] = np.matmul(table.T[None], d_projected)
            grad["bias"] = d_projected.sum(axis=1)
            d_table = (d_projected @ model.weights["in"].transpose(0, 2, 1)).sum(axis=0)
            grad["words"] = _sum_by(np.r_[_PAD, numbers], d_table[:, :_WORD_DIM], len(model.weights["words"]))
            grad |= model.spell_back(d_table[1:, _WORD_DIM:], keep)
            step += 1
            rate = _RATE * (1 - 0.9 * epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grad.items():
                g += _DECAY * model.weights[k]
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                model.weights[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    deciding = np.flatnonzero(~learns) if apart.any() else taught
    last, logit = highest(deciding)
    truth = label[owner[last]]
    clean, toxic = counts or (int((label == 0).sum()), int((label == 1).sum()))
    weight = np.where(truth == 1, toxic / max(1, truth.sum()), clean / max(1, (truth == 0).sum()))
    model.shift = _best_cut(logit, truth, weight)
    return model


def _best_cut(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The logit between two documents at which the weighted F1 is highest; of a range of equals its middle."""
    order = np.argsort(-logit, kind="stable")
    mass = weight[order]
    hits = np.cumsum(mass * label[order])
    f1 = 2 * hits / (np.cumsum(mass) + (weight * label).sum())
    best = int(np.argmax(f1))
    upper = float(logit[order[best]])
    lower = float(logit[order[best + 1]]) if best + 1 < len(order) else upper - 1
    return (upper + lower) / 2


# --- Spark


def remainder(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4; null ids have none."""
    return F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(4))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``id, rank, label, windows``: the bounded sample; of ids with remainder 2 nothing, of rows with null ids, labels or texts nothing.

    ``MOST_TOXIC`` and ``MOST_CLEAN`` ids of lowest hash, one text each (that of
    lowest hash where an id repeats), as far as ``MOST_BYTES`` of text for each
    label go: a text that doesn't fit any more is passed over whole.
    """
    usable = labels.where((remainder(F.col(id_col)) != 2) & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    ranked = usable.withColumn("rank", F.xxhash64("id"))
    chosen = None
    for value, most in ((1, MOST_TOXIC), (0, MOST_CLEAN)):
        part = ranked.where(F.col("label") == value).orderBy("rank", "id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).withColumn("hash", F.xxhash64("text"))
    # One narrow row an id and label, so a few thousand, however often the ids occur in the documents.
    sizes = texts.select("id", "hash", F.octet_length("text").alias("size")).join(F.broadcast(chosen), "id")
    narrow = sizes.groupBy("id", "label", "rank").agg(F.min(F.struct("hash", "size")).alias("t")).collect()
    left, kept = {0: MOST_BYTES, 1: MOST_BYTES}, []
    for r in sorted(narrow, key=lambda r: (r["rank"], r["id"], r["label"])):
        if r["label"] in left and r["t"]["size"] <= left[r["label"]]:
            left[r["label"]] -= r["t"]["size"]
            kept.append((r["id"], r["t"]["hash"], r["rank"], r["label"]))
    named = docs.sparkSession.createDataFrame(kept, texts.select("id", "hash").schema.add("rank", "long").add("label", "integer"))
    met = texts.join(F.broadcast(named), ["id", "hash"]).dropDuplicates(["id", "hash", "label"])

    def start():
        cut = _cutter()

        def work(batch):
            out = []
            for text in batch.column("text").to_pylist():
                words = cut(text)
                out.append([b" ".join(words[s : s + WINDOW]) for s in _starts(len(words))])
            return [out]

        return work

    return append_columns(met, "windows array<binary>", "text", start).select("id", "rank", "label", "windows")


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 5) -> Model:
    """Trains on the bounded sample, in one task.  Reruns on equal tables give the same model on one machine; others may round otherwise.

    Null ids, labels and texts teach nothing, an empty text is one window of
    padding, repeated rows count once, other columns are not read.
    """
    of = labels.where((remainder(F.col(id_col)) != 2) & F.col(label_col).isin(0, 1)).groupBy(F.col(label_col).cast("int").alias("label")).count().collect()
    by_label = {r["label"]: r["count"] for r in of}
    counts = (by_label.get(0, 0), by_label.get(1, 0))

    def work(batches):
        import pyarrow as pa

        rows = []
        for batch in batches:
            rows += zip(*[batch.column(name).to_pylist() for name in ("label", "rank", "windows")], strict=True)
        rows.sort()
        model = train([r[2] for r in rows], [r[0] for r in rows], counts, seed=seed)
        yield pa.RecordBatch.from_pydict({"model": [dumps(model)]})

    # Bounded by ids and by bytes, so one task; what is left for the driver is the model.
    sample = training_sample(docs, labels, id_col, text_col, label_col).select("label", "rank", "windows")
    made = sample.repartition(1).mapInArrow(work, "model binary").collect()
    return loads(bytes(made[0]["model"])) if made else train([], [], counts, seed=seed)


class Scorer:
    """Scores texts; what words contribute is remembered, up to a bound, and memory follows a block of windows, not the texts."""

    def __init__(self, model: Model):
        self.model, self.cut = model, _cutter()
        self.projected = np.empty((2, 1 + _REMEMBERED + _RUN * WINDOW, 3 * _UNITS), dtype=np.float32)
        self.projected[:, :1] = model.project(model.padding())
        self.number: dict[bytes, int] = {}

    def ids(self, windows: list[list[bytes]]) -> np.ndarray:
        """The numbers of the windows' words; new words are spelled."""
        if len(self.number) > _REMEMBERED:
            self.number = {}
        number, new = self.number, []
        ids = np.zeros((len(windows), WINDOW), dtype=np.int64)
        for k, words in enumerate(windows):
            try:
                own = [number[w] for w in words]
            except KeyError:
                for w in words:
                    if w not in number:
                        number[w] = len(number) + 1
                        new.append(w)
                own = [number[w] for w in words]
            ids[k, : len(own)] = own
        if new:
            at = len(number) + 1
            self.projected[:, at - len(new) : at] = self.model.project(self.model.inputs(self.model.numbers(new), self.model.spell(new)))
        return ids

    def __call__(self, texts: list[str | None]) -> list[float]:
        best = np.full(len(texts), -np.inf)
        block, owner = [], []

        def flush():
            np.maximum.at(best, owner, self.model.run(self.projected, self.ids(block)))
            block.clear()
            owner.clear()

        for k, text in enumerate(texts):
            words = self.cut(text) if text else []
            for s in _starts(len(words)):
                block.append(words[s : s + WINDOW])
                owner.append(k)
                if len(block) == _RUN:
                    flush()
        if block:
            flush()
        raw = best - self.model.shift + np.log(THRESHOLD / (1 - THRESHOLD))
        return (1 / (1 + np.exp(-np.clip(raw, -50, 50)))).tolist()


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``: 0 to 1, ``THRESHOLD`` where the model's cut lies.

    Null, empty and wordless texts are one window of padding and have one
    score; texts of any length are read whole.  Other columns pass through, a
    column ``score`` is replaced, repeated rows have one score, and an empty
    table gives an empty result.  The model is broadcast; the bound on the
    sample's bytes bounds its vocabulary.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        score = Scorer(shared.value)

        def work(batch):
            return [score(batch.column(text_col).to_pylist())]

        return work

    return append_columns(docs, "score double", text_col, start, _TEXT_BYTES)
