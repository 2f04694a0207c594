"""Personal data, also in disguise: transducers that keep their alignment.

Plain patterns find the base spans.  Then three transducers rewrite the text:
homoglyphs, invisible characters and foreign digits to ASCII; spelled digits to
digits; "at" and "dot" in their disguises to the signs.  Each is a set of edits
(start, end, replacement) with the alignment they leave behind.  The same
patterns run over the normalised text, and every span that an edit touches is
mapped back through the alignments to characters of the source.

All patterns are linear in the text: none can rescan a run that has failed.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import append_columns
from .top_labels import TOP_LABELS

KINDS = ("email", "ip", "card", "phone")

# --- the plain patterns

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind and then by start.

    The leftmost email at an @ begins where the run of its local characters
    does, or where the email before it ends; so it is found from the @.
    """
    out = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                done = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append(("phone", *m.span()))
    return out


# --- alignments


class Alignment:
    """How a rewritten text lies over its source.  ``edits`` are in order and don't overlap."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, at, out = [], 0, 0
        self.begin: list[int] = []  # of each edit in the rewritten text
        self.end: list[int] = []
        self.source: list[tuple[int, int]] = []
        for start, end, new in edits:
            parts += [text[at:start], new]
            out += start - at
            self.begin.append(out)
            out += len(new)
            self.end.append(out)
            self.source.append((start, end))
            at = end
        parts.append(text[at:])
        self.text = "".join(parts)

    def touches(self, start: int, end: int) -> bool:
        """Whether an edit lies in the span or rewrote part of it."""
        k = bisect_right(self.begin, end - 1) - 1
        return k >= 0 and (self.end[k] > start or (self.begin[k] > start and self.begin[k] == self.end[k]))

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source span: an edit that the span cuts counts whole; deleted characters count where they are inside."""
        k = bisect_right(self.begin, start) - 1
        while k >= 0 and self.begin[k] == self.end[k] == start:
            k -= 1  # a deletion just before the span stays outside
        if k < 0:
            first = start
        elif self.end[k] > start:
            first = self.source[k][0]
        else:
            first = self.source[k][1] + start - self.end[k]
        # Deletions at the very start lie between; skip what they removed.
        j = k + 1
        while j < len(self.begin) and self.begin[j] == self.end[j] == start and self.source[j][0] == first:
            first = self.source[j][1]
            j += 1
        k = bisect_right(self.begin, end - 1) - 1
        while k >= 0 and self.begin[k] == self.end[k] and self.begin[k] > end - 1:
            k -= 1
        if k < 0:
            return first, end
        if self.end[k] >= end:
            return first, self.source[k][1]
        return first, self.source[k][1] + end - self.end[k]


# --- homoglyphs

# Letters of other scripts that look like ASCII ones.
_LOOKALIKE = {
    **dict(zip("АВЕЅІЈКМНОРСТУХ", "ABESIJKMHOPCTYX", strict=True)),
    **dict(zip("аеіјорсѕухԁѡһӏԛ", "aeijopcsyxdwhlq", strict=True)),
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX", strict=True)),
    **dict(zip("ανορικχγ", "avopikxy", strict=True)),
    **dict(zip("ɑɡıℓİſK", "agilIsK", strict=True)),
}
# Ligatures stand for several letters.
_LIGATURES = "ﬀﬁﬂﬃﬄﬅﬆ"
_SIGNS = {
    " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", "　": " ",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "⁃": "-",
    "。": ".", "․": ".", "·": ".", "•": ".", "∙": ".", "｡": ".", "۔": ".",
}
_INVISIBLE = "­͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
_COMPATIBLE = ((0x00B2, 0x00BA), (0x0660, 0x0670), (0x06F0, 0x06FA), (0x0966, 0x0970), (0x2070, 0x209D), (0x2460, 0x249C), (0x24B6, 0x24EB), (0xFE50, 0xFE6C), (0xFF01, 0xFF5F), (0x1D400, 0x1D800))


@lru_cache(maxsize=1)
def _glyphs() -> tuple[dict[str, str], re.Pattern]:
    """ASCII for every character that stands for one; by Unicode's compatibility forms and digit values, but for the lists above."""
    table = dict(_LOOKALIKE) | _SIGNS | dict.fromkeys(_INVISIBLE, "")
    for low, high in _COMPATIBLE:
        for code in range(low, high):
            c = chr(code)
            plain = unicodedata.normalize("NFKC", c)
            digit = unicodedata.digit(c, None)
            if digit is not None:
                plain = str(digit)
            if len(plain) == 1 and plain.isascii() and c not in table:
                table[c] = plain
    table |= {c: unicodedata.normalize("NFKC", c) for c in _LIGATURES}
    return table, re.compile("[" + "".join(map(re.escape, sorted(table))) + "]+")


_LATIN_GLYPHS = re.compile("[ ­²³·¹ªº]")


def homoglyph_edits(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    try:
        text.encode("latin-1")
        if not _LATIN_GLYPHS.search(text):
            return []
    except UnicodeEncodeError:
        pass
    table, any_of = _glyphs()
    return [(i, i + 1, table[text[i]]) for m in any_of.finditer(text) for i in range(*m.span())]


# --- spelled digits

_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_TIMES = {"double": 2, "triple": 3}
_WORD = "(?:" + "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True)) + ")"
_NUMERAL = rf"(?:(?:(?:double|triple)[ -])?{_WORD}(?![^\W_])|[0-9]+)"
_BREAK = r"[ ,/-]{1,3}"
_DOT_BEFORE, _DOT_AFTER = re.compile(r"(?:dot|punkt|point|punto)[ ]$", re.I), re.compile(r"[ ](?:dot|punkt|point|punto)[ ]", re.I)
_SPELLED = re.compile(rf"(?<![^\W_])(?:{_WORD}|double|triple|plus)(?![^\W_])", re.I)
#: Characters that patterns without regard to case take for ASCII letters, though lower() does not give those.
_CASE_FOLDS = str.maketrans("ıİſK", "iisk")
#: From a spelled digit on: the rest of a run of numerals.
_RUN = re.compile(rf"(?:plus[ ])?{_NUMERAL}(?:{_BREAK}{_NUMERAL})*", re.I)
_PART = re.compile(rf"(plus)[ ]|(?:(double|triple)[ -])?({_WORD})(?![^\W_])|([0-9]+)|({_BREAK})", re.I)


def _folded(word: str) -> str:
    """``word`` as the tables have it, for every spelling that the patterns let through."""
    return word.translate(_CASE_FOLDS).lower()


def spelled_edits(text: str) -> list[tuple[int, int, str]]:
    """Runs with at least two numerals, one of them spelled, or one spelled next to digits or a spelled dot."""
    edits, done = [], 0
    for m in _SPELLED.finditer(text):
        start = m.start()
        if start < done:
            continue
        run = _RUN.match(text, start)
        if run is None:
            continue
        parts = list(_PART.finditer(text, run.start(), run.end()))
        numerals = sum(1 for p in parts if p[3] or p[4])
        joined = start and text[start - 1] in " -." and start > 1 and text[start - 2].isdigit()
        joined = joined or _DOT_BEFORE.search(text, max(0, start - 8), start) or _DOT_AFTER.match(text, run.end())
        if numerals < 2 and not joined:
            continue
        for p in parts:
            if p[1]:
                edits.append((p.start(), p.end(), "+"))
            elif p[3]:
                edits.append((p.start(), p.end(), _DIGIT_WORDS[_folded(p[3])] * _TIMES.get(_folded(p[2] or ""), 1)))
            elif p[5] and p[5] not in (" ", "-"):
                edits.append((p.start(), p.end(), " "))
        done = run.end()
    return edits


# --- at and dot

#: White space of one character, as blanks.
_BLANKS = dict.fromkeys(map(ord, "\t\n\v\f\r\u00a0"), " ")
_AT_WORD, _DOT_WORD = "(?:at|arroba|arobase|ät)", "(?:dot|punkt|point|punto)"
_OPEN, _SHUT = r"[ ]{0,3}[(\[{<][ ]{0,3}", r"[ ]{0,3}[)\]}>][ ]{0,3}"
_AT = re.compile(rf"{_OPEN}(?:{_AT_WORD}|@){_SHUT}|[ ]{{1,3}}{_AT_WORD}[ ]{{1,3}}|[ ]{{0,3}}_at_[ ]{{0,3}}|[ ]{{0,3}}&#64;[ ]{{0,3}}|[ ]{{0,3}}@[ ]{{0,3}}", re.I)
_DOT = rf"(?:\.|{_OPEN}(?:{_DOT_WORD}|\.){_SHUT}|[ ]{{1,3}}(?:{_DOT_WORD}|\.)[ ]{{1,3}}|[ ]{{0,3}}_dot_[ ]{{0,3}}|&#46;)"
_DOTS = re.compile(_DOT, re.I)
_LABEL = "[A-Za-z0-9]+(?:-+[A-Za-z0-9]+)*"
_TOP = re.compile("[A-Za-z]{2,24}")
_LABELS = re.compile(rf"{_LABEL}(?:{_DOT}{_LABEL})+", re.I)
#: Last labels that make "x at y point z" an address, where all signs are words of plain prose too.
_TOPS = frozenset("com net org edu gov mil int info biz name pro io ai app dev me tv cc co us uk ca au nz ie de at ch fr be nl lu es pt it eu se no dk fi pl cz ru in cn jp kr br mx ar cl za test example invalid local".split())
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")
_DOT_ENDS, _LONGEST_DOT = re.compile(rf"{_DOT}\Z", re.I), 19
_NUMBER = r"[0-9](?:[ ]?[0-9]){0,2}"
#: A number of three digits one by one; fewer may be another number before an address.
_SPACED = re.compile(r"(?<![0-9])[0-9] [0-9] [0-9](?![0-9])")
_ADDRESS = re.compile(rf"(?<![0-9.]){_NUMBER}(?:{_DOT}{_NUMBER}){{3}}(?![0-9])", re.I)
#: Lies in every match of _AT, which reaches at most so many characters farther; quicker to look for.
_AT_CORE = re.compile(rf"(?<=[ (\[{{<]){_AT_WORD}(?=[ )\]}}>])|@|_at_|&#64;", re.I)
_AT_MARGIN = 7


def _at_signs(text: str):
    """The matches of _AT, one after the other."""
    done = 0
    for core in _AT_CORE.finditer(text):
        at = _AT.search(text, max(done, core.start() - _AT_MARGIN), core.end() + _AT_MARGIN) if core.end() > done else None
        if at is not None:
            done = at.end()
            yield at


def _full_stop(dot: str) -> bool:
    """A full stop with spaces, which may end a sentence."""
    return dot != "." and dot.strip(" ") == "."


def _name_start(text: str, floor: int, end: int) -> int:
    """Where the name that ends at ``end`` begins: runs of its characters with dots, plain or disguised, between them."""
    start = end
    while True:
        at = start
        while at > floor and text[at - 1] in _NAME_CHARS:
            at -= 1
        if at == start:
            return found if start < end else end
        found = start = at
        dot = _DOT_ENDS.search(text, max(floor, at - _LONGEST_DOT), at)
        if dot is None or dot.start() == floor or text[dot.start() - 1] not in _NAME_CHARS:
            return found
        start = dot.start()


def sign_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits of addresses with a disguised sign: mail addresses, and IP addresses with disguised dots."""
    source, text = text, text.translate(_BLANKS)  # lines may break inside a disguise
    edits: dict[int, tuple[int, int, str]] = {}

    def put(start: int, end: int, new: str) -> None:
        if source[start:end] != new:
            edits[start] = (start, end, new)

    floor = 0  # a name doesn't reach over a sign that has a domain, so no name is read twice
    for at in _at_signs(text):
        site = _LABELS.match(text, at.end())
        if site is None:
            continue
        low, floor = floor, at.end()
        start = _name_start(text, low, at.start())
        if start == at.start():
            continue
        before = list(_DOTS.finditer(text, start, at.start()))
        # Spaced full stops before the name end sentences; only what is after the last of them counts.
        for k in range(len(before) - 1, -1, -1):
            if _full_stop(before[k].group()):
                start = before[k].end()
                before = before[k + 1 :]
                break
        dots = list(_DOTS.finditer(text, site.start(), site.end()))
        bare = at.group().strip().isalpha()
        dotted = any(d.group() != "." for d in before)
        signed = dotted or re.search(r"[0-9._%+]", text[start : at.start()]) is not None
        if bare and not signed and all(d.group() == "." for d in dots):  # "at" may be a word here
            continue
        # So do those after a whole domain that has other dots.
        end = site.end()
        for k in range(1, len(dots)):
            whole = text[dots[k - 1].end() : dots[k].start()].lower() in TOP_LABELS
            if whole and _full_stop(dots[k].group()) and not all(_full_stop(d.group()) for d in dots[:k]):
                end = dots[k].start()
                dots = dots[:k]
                break
        # Words may follow the address: its last label is of letters.
        while dots and not _TOP.fullmatch(text, dots[-1].end(), end):
            end = dots.pop().start()
        if not dots:
            continue
        top = text[dots[-1].end() : end].lower()
        if bare and all(d.group().strip().isalpha() or d.group() == "." for d in dots):
            words = {_folded(d.group().strip()) for d in dots} - {"."}
            if _folded(at.group().strip()) == "at" and not dotted:
                # "at this point it" is prose; "dot", or a sign in the name, is not.
                prose = not signed and "dot" not in words
                if top not in (_TOPS if prose else TOP_LABELS):
                    continue
        if at.group() == "@" and all(d.group() == "." for d in [*before, *dots]):
            continue  # a plain address
        if at.group() == "@" and not dotted and all(d.group() == "." or _full_stop(d.group()) for d in dots) and top not in TOP_LABELS:
            continue  # a sentence ends behind the sign
        put(at.start(), at.end(), "@")
        for d in [*before, *dots]:
            put(d.start(), d.end(), ".")
    for m in _ADDRESS.finditer(text) if _DIGIT.search(text) else ():
        inner = list(_DOTS.finditer(text, m.start(), m.end()))
        if all(d.group() == "." for d in inner) and not _SPACED.search(m.group()):
            continue
        at = m.start()
        for d in inner:
            if " " in text[at : d.start()]:
                put(at, d.start(), text[at : d.start()].replace(" ", ""))
            put(d.start(), d.end(), ".")
            at = d.end()
        if " " in text[at : m.end()]:
            put(at, m.end(), text[at : m.end()].replace(" ", ""))
    out, done = [], 0
    for e in sorted(edits.values()):
        if e[0] >= done:
            out.append(e)
            done = e[1]
    return out


def disguised_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that only the normalised text shows, in characters of ``text``; none that lies inside a base span of its kind."""
    layers = []
    now = text
    for transducer in (homoglyph_edits, spelled_edits, sign_edits):
        edits = transducer(now)
        if edits:
            layers.append(Alignment(now, edits))
            now = layers[-1].text
    if not layers:
        return []
    by_kind = {k: [(s, e) for kind, s, e in base if kind == k] for k in KINDS}
    out = []
    for kind, start, end in plain_spans(now):
        touched = False
        for layer in reversed(layers):
            touched = touched or layer.touches(start, end)
            start, end = layer.back(start, end)
        own = by_kind[kind]
        if touched:
            k = bisect_right(own, (start, len(text) + 1)) - 1
            if k < 0 or own[k][1] < end:
                out.append((kind, start, end))
    return out


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans`` (base and added): arrays of kind, start, end, by kind and start.

    Offsets are code points, ends exclusive.  Null and empty texts have none;
    texts of any length are read whole.  Repeated rows are rows of their own,
    other columns pass through, columns of ``docs`` named like a result are
    replaced, and an empty table gives an empty result.
    """
    ddl = "base_spans array<struct<kind: string, start: int, end: int>>, spans array<struct<kind: string, start: int, end: int>>"

    def start():
        order = {k: i for i, k in enumerate(KINDS)}

        def work(batch):
            base, everything = [], []
            for text in batch.column(text_col).to_pylist():
                plain = plain_spans(text) if text else []
                more = disguised_spans(text, plain) if text else []
                base.append(plain)
                everything.append(sorted([*plain, *more], key=lambda s: (order[s[0]], s[1], s[2])) if more else plain)
            named = lambda rows: [[{"kind": k, "start": s, "end": e} for k, s, e in row] for row in rows]
            return [named(base), named(everything)]

        return work

    return append_columns(docs, ddl, text_col, start)
