"""Perceptual hashes: reading, lanes and Hamming distance as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_DIGITS = 64


def clean_hash(c: Column | str, digits: int = HASH_DIGITS) -> Column:
    """Lower-case hex filled with zeros on the right; null for what is not 1 to ``digits`` hex digits.

    Outer white space and a leading 0x are no part of the value.
    """
    h = F.regexp_replace(F.lower(c), r"^\s*(0x)?|\s+$", "")
    return F.when(h.rlike(f"^[0-9a-f]{{1,{digits}}}$"), F.rpad(h, digits, "0"))


def lanes(h: Column | str, digits: int = HASH_DIGITS) -> Column:
    """The padded hash as an array of 64-bit integers."""
    h = F.col(h) if isinstance(h, str) else h
    return F.array(*[F.conv(F.substring(h, i + 1, 16), 16, -10).cast("bigint") for i in range(0, digits, 16)])


def hamming(a: Column, b: Column, n: int = HASH_DIGITS // 16) -> Column:
    """Differing bits of two lane arrays."""
    total = F.bit_count(a[0].bitwiseXOR(b[0]))
    for i in range(1, n):
        total = total + F.bit_count(a[i].bitwiseXOR(b[i]))
    return total
