"""Chains of many pairs at once, against the chains of each pair by itself."""

import random

import numpy as np
import pytest

from braidseq.operators import chaining


def plain(seeds, least, band, only_best):
    """The chains of one pair, one cluster after the other."""
    made = []
    for strand in "+-":
        points = [(t, q) for m, t, q in seeds if m == (strand == "-")]
        made += [(strand, c) for part in chaining.clusters(sorted(set(points)), band) for c in chaining.best_chains(part) if len(c) >= least]
    sizes = sorted((len(c) for _, c in made), reverse=True)
    made.sort(key=lambda c: (-len(c[1]), c[0], c[1][0]))
    out = []
    for k, (strand, chain) in enumerate(made):
        if only_best and len(chain) < sizes[0]:
            break
        rival = sizes[1] if len(chain) == sizes[0] and len(sizes) > 1 else sizes[0] if len(chain) < sizes[0] else 0
        out.append((strand, k, len(chain), rival, [tuple(p) for p in chain]))
    return out


@pytest.mark.parametrize("only_best", [False, True])
def test_chains_at_once_equal_chains_by_pair(only_best, monkeypatch):
    rng = random.Random(31)
    pairs = []
    for i in range(400):
        seeds = [(rng.random() < 0.3, rng.randrange(60), rng.randrange(60) - 30) for _ in range(rng.choice([0, 1, 3, 20, 60]))]
        for _ in range(rng.randrange(4)):  # diagonals, some of them twice and some broken by a gap
            at, n, m, gap = rng.randrange(200), rng.randrange(2, 25), rng.random() < 0.5, rng.choice([0, 0, 3, 90])
            seeds += [(m, at + 5 * j + gap * (j > n // 2), 5 * j) for j in range(n)]
        rng.shuffle(seeds)
        pairs.append(seeds)
    for band in (0, 8, 64):
        flat = [(i, *s) for i, seeds in enumerate(pairs) for s in seeds]
        rows, minus, t, q = (np.array(x) for x in zip(*flat))
        places, strands, numbers, counts, rivals, qs, ts = chaining._chains_of(rows, minus, t, q, 3, band, only_best)
        got, at = [[] for _ in pairs], 0
        for p, s, k, n, r in zip(places.tolist(), strands.tolist(), numbers.tolist(), counts.tolist(), rivals.tolist()):
            got[p].append(("-" if s else "+", k, n, r, list(zip(ts[at : at + n].tolist(), qs[at : at + n].tolist()))))
            at += n
        assert got == [plain(seeds, 3, band, only_best) for seeds in pairs]


def test_exact_reads_of_repeats_are_not_looked_at_anchor_by_anchor(monkeypatch):
    """Each anchor of each pair was an object and went through the search for a longest rise: 300,000 of them took seconds."""
    monkeypatch.setattr(chaining, "longest_rise", lambda points: pytest.fail("a search where a diagonal has all places"))
    rows = np.repeat(np.arange(100), 3000)
    q = np.tile(np.repeat(np.arange(100) * 4, 30), 100)
    t = q + 20 * np.tile(np.arange(30), 10_000)
    places, _, numbers, counts, rivals, _, _ = chaining._chains_of(rows, np.zeros(len(rows), dtype=bool), t, q, 3, chaining.BAND, True)
    assert len(places) == 3000 and set(counts.tolist()) == set(rivals.tolist()) == {100} and max(numbers.tolist()) == 29


def test_no_anchors_no_chains():
    none = np.zeros(0, dtype=np.int64)
    assert [len(x) for x in chaining._chains_of(none, none.astype(bool), none, none, 3, 64, True)] == [0] * 7


def test_coded_minimisers_are_those_of_their_order():
    """Seeds of reads went through SHA-256, one k-mer after the other; many chunks are one array now."""
    import pyarrow as pa
    from braidseq.operators import minimisers
    from test_operators import rc

    def mix(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ x >> shift) * factor) % (1 << 64)
        return x ^ x >> 31

    rng = random.Random(32)
    texts = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (15, 16, 21, 300, 90, 24)] + ["ACGT" * 20 + "N" + "A" * 50 + "CG" * 30, "N" * 40]
    for k, window in ((15, 10), (7, 1), (31, 3), (6, 4), (16, 10)):
        kept = [x for x in texts if len(x) >= k]
        chunks = []
        for i, x in enumerate(kept):
            m = len(x) - k + 1
            w = min(window, m)
            for first in range(0, m, 64):
                base = max(0, first - w + 1)
                chunks.append((i, w, first, base, x[base : first + 64 + w - 1 + k - 1].encode()))
        batch = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*chunks), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["sequence_id", "w", "first", "base", "part"])
        got = sorted((r["sequence_id"], r["position"], r["key"], r["orientation"]) for b in minimisers._coded(k, 64)([batch]) for r in b.to_pylist())
        wanted = set()
        for i, x in enumerate(kept):
            m = len(x) - k + 1
            w, codes = min(window, m), []
            for p in range(m):
                f = x[p : p + k]
                codes.append(None if set(f) - set("ACGT") else int("".join(str("ACGT".index(b)) for b in min(f, rc(f))), 4))
            order = [1 << 65 if c is None else mix(c) for c in codes]
            for p in range(m - w + 1):
                low = min(order[p : p + w])
                wanted |= {(i, j, codes[j], x[j : j + k] <= rc(x[j : j + k])) for j in range(p, p + w) if order[j] == low and codes[j] is not None}
        assert got == sorted(wanted)
