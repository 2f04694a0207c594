"""Token counts by heap-and-linked-list byte-pair merging.

A text's symbols are its characters, linked left to right.  All adjacent pairs
that form a piece wait in a heap by rank; the lowest rank (ties: the leftmost)
is popped, merged, and its new neighbours are pushed.  The count is the initial
symbols minus the merges; no ids are made.  A character outside the vocabulary
counts as its UTF-8 bytes (byte fallback).

Where no piece crosses a boundary, the text is cut: before a space that follows
another character, and around line feeds, if no piece of the model has one
inside.  Words then are counted once and remembered, in a table of bounded
size.  Other models are merged over whole texts.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame

from .common import append_columns

SPACE = "▁"
#: Words remembered in each worker.
REMEMBERED = 400_000
_NORMAL, _USER, _UNUSED = 1, 4, 5


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError("not a model file")


@dataclass(frozen=True)
class PieceModel:
    """What counting needs of a byte-pair model: merge ranks, single characters, and where texts can be cut."""

    ranks: dict[str, float]
    known: frozenset[str]
    dummy_prefix: bool
    cut_at_space: bool
    cut_at_line: bool

    def weight(self, character: str) -> int:
        return 1 if character in self.known else len(character.encode())

    def merged(self, symbols: str) -> int:
        """Tokens of ``symbols``, in which spaces are already marked."""
        n = len(symbols)
        ranks = self.ranks
        text = list(symbols)
        total = sum([1 if c in self.known else len(c.encode()) for c in text])
        heap = []
        for i in range(n - 1):
            rank = ranks.get(symbols[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 1, 2))
        if not heap:
            return total
        heapify(heap)
        before = list(range(-1, n - 1))
        after = list(range(1, n + 1))
        weight = None if total == n else [self.weight(c) for c in text]
        while heap:
            _, i, j, size = heappop(heap)
            left, right = text[i], text[j]
            if not left or not right or len(left) + len(right) != size:
                continue  # one of them has merged since
            if weight is None:
                total -= 1
            else:
                total -= weight[i] + weight[j] - 1
                weight[i] = 1
            both = text[i] = left + right
            text[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get(both + text[k])
                if rank is not None:
                    heappush(heap, (rank, i, k, size + len(text[k])))
            k = before[i]
            if k >= 0:
                rank = ranks.get(text[k] + both)
                if rank is not None:
                    heappush(heap, (rank, k, i, size + len(text[k])))
        return total


@lru_cache(maxsize=4)
def load_model(path: str) -> PieceModel:
    """Reads a ``.model`` file of byte-pair kind; models with a normaliser of their own raise ``ValueError``."""
    with open(path, "rb") as file:
        data = file.read()
    pieces: dict[str, float] = {}
    trainer: dict[int, object] = {}
    normal: dict[int, object] = {}
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, _NORMAL
            for part, x in _fields(value):
                if part == 1:
                    piece = x.decode()
                elif part == 2:
                    score = struct.unpack("<f", x)[0]
                elif part == 3:
                    kind = x
            if kind == _NORMAL:
                pieces[piece] = -score
            elif kind in (_USER, _UNUSED):
                raise ValueError("user-defined and unused pieces are not handled")
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normal = dict(_fields(value))
    # Field numbers of the public message: model_type 3, suffix spaces 24, byte fallback 35; charsmap 2, prefix 3, extra spaces 4, escaping 5.
    if trainer.get(3) != 2 or trainer.get(24) or not trainer.get(35):
        raise ValueError("only byte-pair models with byte fallback are handled")
    if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1):
        raise ValueError("only models without a normaliser are handled")
    long = {p: r for p, r in pieces.items() if len(p) > 1}
    return PieceModel(
        ranks=long,
        known=frozenset(p for p in pieces if len(p) == 1),
        dummy_prefix=bool(normal.get(3, 1)),
        cut_at_space=not any(SPACE in p.lstrip(SPACE) for p in long),
        cut_at_line=not any("\n" in p for p in long),
    )


_words: dict[tuple[str, str], dict[str, int]] = {}


def _remember(path: str, kind: str) -> dict[str, int]:
    return _words.setdefault((path, kind), {})


class Counter:
    """Counts texts under a model; words are remembered by each Python process, up to ``REMEMBERED`` of them."""

    def __init__(self, path: str):
        self.model = load_model(path)
        self.spaced, self.bare = _remember(path, "spaced"), _remember(path, "bare")

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        model = self.model
        if not model.cut_at_space or not model.cut_at_line or not model.dummy_prefix or SPACE in text or "  " in text or text[0] == " ":
            return self._plain(text)
        spaced, bare, total = self.spaced, self.bare, 0
        lines = text.split("\n")
        total += (len(lines) - 1) * model.weight("\n")
        known, first = spaced, True
        for line in lines:
            words = line.split(" ")
            head = words[0]
            if head or first:
                n = known.get(head)
                total += self._new(head, first) if n is None else n
            known, first = bare, False
            for n, word in zip(map(spaced.get, words[1:]), words[1:]):
                total += self._new(word, True) if n is None else n
        return total

    def _new(self, word: str, spaced: bool) -> int:
        n = self.model.merged(SPACE + word if spaced else word)
        table = self.spaced if spaced else self.bare
        if len(word) <= 64:
            if len(table) >= REMEMBERED:
                table.clear()
            table[word] = n
        return n

    def _plain(self, text: str) -> int:
        model = self.model
        marked = (SPACE if model.dummy_prefix else "") + text.replace(" ", SPACE)
        if not model.cut_at_space:
            return model.merged(marked)
        total, start, n = 0, 0, len(marked)
        while start < n:  # a run of spaces and what follows it, up to the next space
            at = start
            while at < n and marked[at] == SPACE:
                at += 1
            end = marked.find(SPACE, at)
            end = n if end < 0 else end
            total += model.merged(marked[start:end])
            start = end
        return total


def count_tokens(docs: DataFrame, model_path: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` (long) and ``over_limit`` (more than ``limit`` tokens).

    Counts equal those of the model's own library without begin and end marks;
    special strings inside texts are ordinary text.  Null counts as empty: no
    bytes, no tokens.  ``model_path`` must name the file on every machine.
    """

    def start():
        count = Counter(model_path)

        def work(batch):
            texts = batch.column(text_col).to_pylist()
            tokens = [count(t) for t in texts]
            return [[len(t.encode()) if t else 0 for t in texts], tokens, [n > limit for n in tokens]]

        return work

    return append_columns(docs, "n_bytes long, n_tokens long, over_limit boolean", text_col, start)
