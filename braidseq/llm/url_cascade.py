"""URL rules through Bloom filter cascades: exact membership over a known key universe, without joins.

Level 1 holds the listed keys.  Level 2 holds the universe's other keys that
level 1 lets through, level 3 the listed keys that level 2 lets through, and so
on until a level lets nothing wrong through.  Over the universe the first level
that rejects a key decides: an odd one means "not listed", an even one "listed".

The first level's error rate shrinks with the universe, so that about as many
false positives are left as keys are listed: every level is as small as the
list, whatever the corpus (times a logarithm of the universe).  Everything here
is DataFrame functions; bit arrays are built by ``bit_or`` aggregates.  Small
ones are literals; larger ones are written as a table of one row, which is
broadcast to the rows it judges and never passes the driver.  A cascade has a
few megabytes at most: longer lists are cut by their keys' hashes into as many
cascades as their count asks for.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, pin, stored

#: 64-bit words of a level that is a literal in the plan; larger ones are a column of one broadcast row.
LITERAL_WORDS = 50_000
#: 64-bit words of all levels of a cascade together, four megabytes: some millions of listed keys.  Longer lists are cut into several cascades.
MOST_WORDS = 1 << 19
#: Rules whose keys are a literal in the plan; longer lists are a table.
LITERAL_RULES = 10_000
_LIMIT_LEVELS = 64


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``bits`` bits in 64-bit words, ``hashes`` probes, hashed under ``seed``.

    Its words are ``words``, or the one row of ``table``.
    """

    bits: int
    hashes: int
    seed: int
    words: tuple[int, ...] = field(repr=False, default=())
    table: DataFrame | None = field(repr=False, default=None)

    def __contains__(self, key: object) -> bool:
        raise TypeError("use holds(column)")

    def holds(self, key: Column, words: Column | None = None) -> Column:
        """Whether ``key`` may be in the filter; ``words``: its bits, where they are a column."""
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>") if words is None else words
        hit = None
        for at in _probes(key, self.bits, self.hashes, self.seed):
            one = F.getbit(F.element_at(words, (F.shiftright(at, 6) + 1).cast("int")), at.bitwiseAND(63).cast("int")) == 1
            hit = one if hit is None else hit & one
        return hit


def _probes(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    first = F.pmod(F.xxhash64(F.lit(2 * seed), key), F.lit(bits))
    step = F.pmod(F.xxhash64(F.lit(2 * seed + 1), key), F.lit(bits))
    return [F.pmod(first + step * i, F.lit(bits)) for i in range(hashes)]


def _build(keys: DataFrame, n: int, rate: float, seed: int, literal_words: int | None = None) -> Level:
    """A filter over the column ``key`` of ``keys``, which has about ``n`` rows; of more than ``literal_words`` words it is a table."""
    bits = max(64, 64 * math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64))
    hashes = max(1, min(24, round(-math.log2(rate))))
    at = F.explode(F.array(*_probes(F.col("key"), bits, hashes, seed)))
    one = F.expr("shiftleft(1L, cast(at & 63 as int))")
    rows = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("set"))
    if bits // 64 > (LITERAL_WORDS if literal_words is None else literal_words):
        every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word")).join(rows, "word", "left")
        whole = every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("set", F.lit(0)).alias("set")))).alias("pairs"))
        return Level(bits, hashes, seed, table=stored(whole.select(F.expr("transform(pairs, x -> x.set)").alias("words")), "bloom"))
    words = [0] * (bits // 64)  # at most so many rows come back
    for row in rows.collect():
        words[row["word"]] = row["set"]
    return Level(bits, hashes, seed, tuple(words))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]
    name: str = "cascade"

    def _words(self, i: int) -> Column | None:
        return F.col(f"__{self.name}_{i}") if self.levels[i].table is not None else None

    def attach(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the levels that are tables, each a column of one broadcast row; ``detach`` drops them."""
        for i, level in enumerate(self.levels):
            if level.table is not None:
                rows = rows.crossJoin(F.broadcast(level.table.select(F.col("words").alias(f"__{self.name}_{i}"))))
        return rows

    def detach(self, rows: DataFrame) -> DataFrame:
        return rows.drop(*[f"__{self.name}_{i}" for i in range(len(self.levels))])

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed, on rows of ``attach``.  Exact there; other keys may err at the last level's rate."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            out = F.when(~self.levels[i - 1].holds(key, self._words(i - 1)), F.lit(i % 2 == 0)).otherwise(out)
        return out


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts))


@dataclass(frozen=True)
class Cascades:
    """One cascade for each hash part of a long list."""

    parts: tuple[Cascade, ...]

    def attach(self, rows: DataFrame) -> DataFrame:
        for one in self.parts:
            rows = one.attach(rows)
        return rows

    def detach(self, rows: DataFrame) -> DataFrame:
        for one in self.parts:
            rows = one.detach(rows)
        return rows

    def holds(self, key: Column) -> Column:
        found = F.lit(False)
        for p, one in enumerate(self.parts):
            found = F.when(_part(key, len(self.parts)) == p, one.holds(key)).otherwise(found)
        return F.coalesce(found, F.lit(False))


def _rate(n: int, universe_size: int) -> float:
    return min(0.5, n / (math.sqrt(2) * max(1, universe_size)))


def _words_needed(n: int, rate: float) -> float:
    return n * (-math.log(rate) / math.log(2) ** 2 + 6) / 64  # later levels shrink by halves


def build_cascades(listed: DataFrame, universe: DataFrame, universe_size: int | None = None, name: str = "cascade") -> Cascade | Cascades:
    """A cascade over the column ``key`` of both, or as many as keep each within ``MOST_WORDS``."""
    listed = pin(listed.select("key").where(F.col("key").isNotNull()).distinct())
    universe = universe.select("key").where(F.col("key").isNotNull())
    n = listed.count()
    if universe_size is None:
        universe_size = universe.agg(F.approx_count_distinct("key").alias("n")).first()["n"]
    # Half of the bound, so that no part of a list that is cut passes it.
    needed = _words_needed(n, _rate(n, universe_size)) if n else 0
    if needed <= MOST_WORDS:
        return build_cascade(listed, universe, universe_size, name)
    parts = math.ceil(2 * needed / MOST_WORDS)
    own = lambda df, p: df.where(_part(F.col("key"), parts) == p)
    return Cascades(tuple(build_cascade(own(listed, p), own(universe, p), max(1, universe_size // parts), f"{name}_{p}") for p in range(parts)))


def build_cascade(listed: DataFrame, universe: DataFrame, universe_size: int | None = None, name: str = "cascade") -> Cascade:
    """A cascade over the column ``key`` of both.

    ``universe`` is read once, or twice if its size isn't given; its rows may
    repeat.  Null keys are no keys.  An empty list gives a cascade that holds
    nothing.  The levels' sizes follow from the list's; a list whose levels
    would have more than ``MOST_WORDS`` words raises ``ValueError`` before
    anything is built: ``build_cascades`` takes lists of any length.
    """
    listed = listed.select("key").where(F.col("key").isNotNull()).distinct()
    n = listed.count()
    if not n:
        return Cascade((), name)
    keys = universe.select("key").where(F.col("key").isNotNull())
    if universe_size is None:
        universe_size = keys.agg(F.approx_count_distinct("key").alias("n")).first()["n"]
    rate = _rate(n, universe_size)
    if _words_needed(n, rate) > MOST_WORDS:
        raise ValueError(f"{n} listed keys take more than {MOST_WORDS} words; use build_cascades")
    levels = [_build(listed, n, rate, 1)]

    def let_through(rows: DataFrame, level: int) -> DataFrame:
        one = Cascade((levels[level],), f"level{level}")
        return one.detach(one.attach(rows).where(one.holds(F.col("key"))))

    passed = let_through(keys, 0).distinct()
    wrong = pin(passed.join(listed, "key", "left_anti"))
    inside, outside = listed, wrong
    while len(levels) < _LIMIT_LEVELS:
        turn = outside if len(levels) % 2 else inside
        left = turn.count()
        if not left:
            return Cascade(tuple(levels), name)
        levels.append(_build(turn, left, 0.5, len(levels) + 1))
        kept = pin(let_through(inside if turn is outside else outside, len(levels) - 1))
        inside, outside = (kept, outside) if turn is outside else (inside, kept)
    raise RuntimeError("the cascade did not close")


def listed_keys(rows: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """``rows`` with ``listed`` (boolean): whether their ``key`` is in the column ``key`` of ``listed``, a list of any length; null is in none.

    ``rows`` are their own universe.  A column of their own named ``listed`` is
    replaced; repeated rows stay, empty tables give empty results.
    """
    cascade = build_cascades(listed, rows.select(F.col(key).alias("key")))
    out = cascade.attach(rows.drop("listed"))
    out = out.withColumn("listed", F.coalesce(F.when(F.col(key).isNotNull(), cascade.holds(F.col(key))), F.lit(False)))
    return out.select(*[F.col(f"`{x}`") for x in rows.columns if x != "listed"], "listed")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and for urls without ``://``."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = [F.coalesce(F.regexp_extract(url, shape, i), F.lit("")) for i in (1, 2)]
    return ascii_lower(part[0]), part[1]


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains where the path starts with ``path``."""

    action: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path

    @property
    def shape(self) -> tuple[int, int]:
        """Labels of the host and characters of the path: where a url would hold this rule's key."""
        return self.host.count(".") + 1, len(self.path)


def _candidates(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """The keys that a url offers, longest first: for each shape among the rules the host's last labels and the path's start."""
    keys = []
    for labels, length in sorted({r.shape for r in rules}):
        enough = (F.length(host) - F.length(F.replace(host, F.lit("."))) + 1 >= labels) & (F.length(path) >= length)
        keys.append(F.when(enough, F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, length))))
    return F.array_sort(
        F.array_compact(F.array(*keys)),
        lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0),
    )


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the longest that fits, or null) and ``verdict``.

    Rules' hosts are lower case; of equal keys the first rule holds.  A url
    that no rule fits is not in the block list and gets ``default``.  Null and
    malformed urls have no host, offer no key and get ``default`` too.  Columns
    of ``pages`` with the names of results are replaced; others stay, repeated
    rows too, and empty tables give empty results.  The urls are read three
    times: for the universe's size, for its keys that the first levels let
    through, and for the verdicts.
    """
    if len({r.key for r in rules}) < len(rules):
        rules = list({r.key: r for r in reversed(rules)}.values())
    if any(r.host != r.host.translate(str.maketrans(UPPER, LOWER)) or r.action not in ("allow", "block") for r in rules):
        raise ValueError("rules have lower-case hosts and allow or block")
    host, path = url_parts(F.col(url))
    parts = pages.withColumns({"host": host, "path": path})
    if not rules:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    offered = _candidates(F.col("host"), F.col("path"), rules)
    universe = parts.select(F.explode(offered).alias("key"))
    size = universe.agg(F.approx_count_distinct("key").alias("n")).first()["n"]
    one = pages.sparkSession.range(1)
    by_action = {}
    for action in ("allow", "block"):
        own = [r.key for r in rules if r.action == action]
        literal = F.from_json(F.lit(json.dumps(own)), "array<string>") if len(own) <= LITERAL_RULES else None
        keys = one.select(F.explode(literal).alias("key")) if literal is not None else stored(pages.sparkSession.createDataFrame([(k,) for k in own], "key string"), "rules")
        by_action[action] = build_cascades(keys, universe, size, action)
        parts = by_action[action].attach(parts)
    fits = lambda key: by_action["block"].holds(key) | by_action["allow"].holds(key)
    judged = (
        parts.withColumn("rule", F.try_element_at(F.filter(offered, fits), F.lit(1)))
        .withColumn("verdict", F.when(F.col("rule").isNull(), F.lit(default)).when(by_action["block"].holds(F.col("rule")), "block").otherwise("allow"))
    )
    return by_action["allow"].detach(by_action["block"].detach(judged))
