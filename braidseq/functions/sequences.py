"""Strand algebra on sequence columns.  All of it is Catalyst expressions, but for the letters of texts."""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, StringType, StructField, StructType

#: The IUPAC symbols and their complements.
SYMBOLS = "ACGTRYSWKMBDHVN"
COMPLEMENTS = "TGCAYRSWMKVHDBN"


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, SYMBOLS + SYMBOLS.lower(), COMPLEMENTS + COMPLEMENTS.lower()))


def canonical(sequence: Column) -> Column:
    """The smaller of both strands, by bytes."""
    return F.least(sequence, reverse_complement(sequence))


def strand(sequence: Column) -> Column:
    """``+`` if the sequence is its own canonical strand; palindromes are."""
    return F.when(sequence <= reverse_complement(sequence), "+").otherwise("-")


def same_strand(left: Column, right: Column) -> Column:
    """The relative orientation of two strands."""
    return F.when(left == right, "+").otherwise("-")


def oriented_slice(sequence: Column, start: Column, end: Column, orientation: Column) -> Column:
    """``sequence[start:end]`` read in ``orientation``; coordinates are on the forward strand, 0-based, end exclusive."""
    part = sequence.substr(start + 1, end - start)
    return F.when(orientation == "+", part).otherwise(reverse_complement(part))


def circular_slice(sequence: Column, start: Column, end: Column, orientation: Column) -> Column:
    """As ``oriented_slice`` on a ring: where ``end`` is not beyond ``start``, the slice runs over the origin."""
    over = F.when(end > start, end).otherwise(end + F.length(sequence))
    return oriented_slice(F.concat(sequence, sequence), start, over, orientation)


def read_partition(name: Column, seed: str, parts: int = 3) -> Column:
    """The part, from 0, of a read: the first 8 bytes of SHA-256 of the seed, NUL and the name, as a number modulo ``parts``."""
    digest = F.sha2(F.concat(F.lit(seed), F.lit("\0"), name), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(parts).cast("decimal(20,0)")).cast("int")


def illegal_symbols(sequence: Column) -> Column:
    """What is left when all legal symbols go; empty for a legal sequence."""
    return F.translate(F.upper(sequence), SYMBOLS, "")


def content_id(prefix: str, *parts: Column) -> Column:
    """``prefix`` and 20 hexadecimal digits of the SHA-256 of the parts, joined by NUL."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 20))


def text_as_sequence(text: Column) -> Column:
    """A text's letters as bases: a is A, b is C, c is G, d is T, e is A, and so on.  Null is empty."""
    return _letters_as_bases(text)


#: The base of each byte that is a small letter; the bytes that are none go.
_BASES = bytes(b"ACGT"[(b - 97) % 4] for b in range(256))
_NO_LETTERS = bytes(b for b in range(256) if not 97 <= b <= 122)


@F.arrow_udf(StringType())
def _letters_as_bases(text: pa.Array) -> pa.Array:
    # The JVM's translate looks every letter up as a string of its own: many times slower.
    return pa.array([(x or "").lower().encode().translate(_BASES, _NO_LETTERS).decode() for x in text.to_pylist()], pa.string())


#: The complements of both cases, for bytes and for text with other characters.
_TURNED = bytes.maketrans((SYMBOLS + SYMBOLS.lower()).encode(), (COMPLEMENTS + COMPLEMENTS.lower()).encode())


def _turned(sequence: bytes) -> bytes:
    """``reverse_complement`` of UTF-8."""
    if sequence.isascii():
        return sequence.translate(_TURNED)[::-1]
    return sequence.decode().translate(str.maketrans(SYMBOLS + SYMBOLS.lower(), COMPLEMENTS + COMPLEMENTS.lower()))[::-1].encode()


@F.arrow_udf(StringType())
def turned_where(sequence: pa.Array, turn: pa.Array) -> pa.Array:
    """``reverse_complement`` where ``turn`` holds, else the sequence: for long sequences, of which the JVM looks every letter up as a string of its own."""
    return pa.array([x if x is None or not t else _turned(x.encode()).decode() for x, t in zip(sequence.to_pylist(), turn.to_pylist())], pa.string())


def _canonical(sequence: pa.Array):
    """The canonical form of each sequence, and whether it is the sequence."""
    for x in sequence.to_pylist():
        if x is None:
            yield None, False
        else:
            forward = x.encode()
            back = _turned(forward)
            yield (forward, True) if forward <= back else (back, False)


_FORM = [StructField("digest", StringType()), StructField("plus", BooleanType())]


@F.arrow_udf(StructType(_FORM))
def canonical_digest(sequence: pa.Array) -> pa.Array:
    """SHA-256 of the canonical form, and ``plus`` if the sequence is its own canonical strand."""
    digests, plus = zip(*[(None if x is None else sha256(x).hexdigest(), p) for x, p in _canonical(sequence)]) if len(sequence) else ([], [])
    return pa.StructArray.from_arrays([pa.array(digests, pa.string()), pa.array(plus, pa.bool_())], ["digest", "plus"])


@F.arrow_udf(StructType([*_FORM, StructField("packed", BinaryType()), StructField("length", IntegerType())]))
def canonical_packed(sequence: pa.Array) -> pa.Array:
    """``canonical_digest`` with the canonical form as ``packed_letters`` and its length."""
    codec = pa.Codec("zstd", compression_level=1)
    digests, plus, packed, lengths = [], [], [], []
    for x, p in _canonical(sequence):
        digests.append(None if x is None else sha256(x).hexdigest())
        plus.append(p)
        packed.append(None if x is None else _packed(x, codec))
        lengths.append(None if x is None else len(x) if x.isascii() else len(x.decode()))
    columns = [pa.array(digests, pa.string()), pa.array(plus, pa.bool_()), pa.array(packed, pa.binary()), pa.array(lengths, pa.int32())]
    return pa.StructArray.from_arrays(columns, ["digest", "plus", "packed", "length"])


def _packed(sequence: bytes, codec) -> bytes:
    return len(sequence).to_bytes(8, "little") + codec.compress(sequence, asbytes=True)


@F.arrow_udf(BinaryType())
def packed_letters(sequence: pa.Array) -> pa.Array:
    """Sequences by zstd, which takes two bits a base where Spark's own compression of shuffles takes six; null is null."""
    codec = pa.Codec("zstd", compression_level=1)
    return pa.array([None if x is None else _packed(x.encode(), codec) for x in sequence.to_pylist()], pa.binary())


@F.arrow_udf(StringType())
def unpacked_letters(packed: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unpacked(x).decode() for x in packed.to_pylist()], pa.string())


def unpacked(packed: bytes) -> bytes:
    """The letters of a value of ``packed_letters``."""
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
