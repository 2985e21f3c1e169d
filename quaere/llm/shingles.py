"""Word shingles as Column expressions.

A word is a lower-cased run of letters and digits.  A shingle is the hash of ``size`` words
that follow each other; a text of fewer words has one shingle of all of them, or none if it
has no words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, let

WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """The words of a text; of a null, none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def shingles(of: Column, size: int = SHINGLE_WORDS, *, short: bool = True) -> Column:
    """Hashes of the runs of ``size`` words; with ``short``, a text of fewer words counts as one run."""

    def made(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))
        none = F.array().cast("array<bigint>")
        one = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.when(F.size(w) >= size, runs).when((F.size(w) > 0) & F.lit(short), one).otherwise(none)

    return let(of, made)
