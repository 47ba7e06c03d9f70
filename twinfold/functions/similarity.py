"""Similarity measures and fingerprint formats as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shingles(normalized: Column, size: int = 5) -> Column:
    """All overlapping ``size``-character pieces in order; empty for shorter text.

    One linear pass of the regex engine; it steps by code point, so characters
    outside the basic plane count once.
    """
    return F.regexp_extract_all(normalized, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1))


def overlap(left: Column, right: Column) -> Column:
    return F.size(F.array_intersect(left, right))


def jaccard_from_counts(common: Column, n_left: Column, n_right: Column) -> Column:
    union = n_left + n_right - common
    return F.when(union == 0, F.lit(0.0)).otherwise(common.cast("double") / union.cast("double"))


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of two arrays taken as sets; 0.0 when both are empty."""
    return jaccard_from_counts(
        overlap(left, right), F.size(F.array_distinct(left)), F.size(F.array_distinct(right))
    )


def size_ratio(n_left: Column, n_right: Column) -> Column:
    """Upper bound of the Jaccard similarity from the two set sizes alone."""
    return F.least(n_left, n_right).cast("double") / F.greatest(n_left, n_right).cast("double")


def hamming(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseXOR(right))


def simhash_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def band_hex(bucket: Column) -> Column:
    """The 8-digit band hash inside a bucket number (band index in the upper 32 bits)."""
    return F.lower(F.lpad(F.hex(bucket.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))


def band_index(bucket: Column) -> Column:
    return F.shiftright(bucket, 32).cast("int")
