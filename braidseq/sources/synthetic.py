"""Small cases of every relationship, generated by hashes, to hold an aligner and its classification against."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession

#: The settings that the cases are made for.
MIN_OVERLAP, END_TOLERANCE = 100, 10


def _bases(seed: int, name: str, n: int) -> str:
    out = ""
    while len(out) < n:
        digest = sha256(f"{seed}:{name}:{len(out)}".encode()).digest()
        out += "".join("ACGT"[byte >> shift & 3] for byte in digest for shift in (0, 2, 4, 6))
    return out[:n]


def _turned(s: str) -> str:
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def synthetic_cases(spark: SparkSession, seed: int = 1729) -> DataFrame:
    """``case_id, query, target, expected``: thirteen cases; each is aligned by itself."""
    part = lambda name, n: _bases(seed, name, n)
    core, left, right, overlap, repeat, inner = (part(x, n) for x, n in (("core", 400), ("left", 250), ("right", 250), ("overlap", 300), ("repeat", 140), ("inner", 170)))
    changed = "".join("ACGT"["ACGT".index(b) - 3] if i % 50 == 0 else b for i, b in enumerate(overlap))
    contained = left + core + right
    forward = "QUERY_SUFFIX_TO_TARGET_PREFIX"
    cases = [
        ("exact_duplicate", core, core, "EXACT_MATCH"),
        ("reverse_complement_duplicate", _turned(core), core, "EXACT_MATCH"),
        ("query_contained", core, contained, "QUERY_CONTAINED_IN_TARGET"),
        ("target_contained", contained, core, "TARGET_CONTAINED_IN_QUERY"),
        ("forward_suffix_prefix", left + overlap, overlap + right, forward),
        ("reverse_suffix_prefix", left + _turned(overlap), right + overlap, forward),
        ("identity_98_percent", left + changed, overlap + right, forward),
        ("small_indel", left + overlap[:150] + "A" + overlap[150:], overlap + right, forward),
        ("internal_conserved", left + inner + right, part("before", 200) + inner + part("behind", 200), "NO_RELATIONSHIP"),
        ("repeated_hits", repeat + part("gap1", 180) + repeat, repeat + part("gap2", 220) + repeat, "AMBIGUOUS_OVERLAP"),
        ("incompatible_terminal_placements", repeat + part("gap3", 160) + repeat, repeat + part("gap4", 160) + repeat, "AMBIGUOUS_OVERLAP"),
        ("low_complexity", "A" * 400, "C" * 400, "NO_RELATIONSHIP"),
        ("unrelated", part("one", 400), part("other", 400), "NO_RELATIONSHIP"),
    ]
    return spark.createDataFrame(cases, "case_id string, query string, target string, expected string")
