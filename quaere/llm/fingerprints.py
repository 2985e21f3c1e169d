"""Document fingerprints by one-permutation MinHash.

Every five-word shingle is hashed once.  The top bits of the hash choose one of ``BINS``
bins, and each bin keeps its least hash.  An empty bin takes the value of a full one, by a
sequence of tries fixed for the bin (optimal densification): its k-th try is a random bin,
and after ``TRIES`` of them the full bin that comes first in a random order of its own.
The low ``BITS`` bits of the values, packed, are the fingerprint.  Unlike values agree in
these bits once in 2^BITS, so of a share p of equal bins (p - c) / (1 - c) with
c = 2^-BITS estimates the Jaccard similarity.

Everything is Column expressions.  The bins of a text come from one sort of its hashes
together with one sentinel, the greatest possible hash, of each bin.

Results: null and empty texts, and others without a word, have the empty fingerprint, which
is like itself (1) and unlike any other (0); a text of one to four words is one shingle; equal texts
have equal fingerprints; columns besides the key and the text are ignored.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let
from .shingles import shingles, words

BINS, BITS = 128, 8
TRIES = 24
#: Ranges of keys for each shuffle partition, and in all, at most: their bounds go into the plan.
RANGES, MOST_RANGES = 4, 1 << 14

_shift = 64 - (BINS.bit_length() - 1)
_random = random.Random(5)
_tries = [[_random.randrange(BINS) for _ in range(TRIES)] for _ in range(BINS)]
_orders = [_random.sample(range(BINS), BINS) for _ in range(BINS)]
#: The greatest hash of each bin, in ascending order of (signed) hashes.
_sentinels = [((b - BINS // 2 + 1) << _shift) - 1 for b in range(BINS)]


def _numbers(of: list[int], kind: str = "int") -> Column:
    """A constant array as one literal: as one for each number it would fill the driver with the plan."""
    return F.split(F.lit(",".join(map(str, of))), ",").cast(f"array<{kind}>")


def bins(of: Column) -> Column:
    """Per bin the least hash, empty bins densified; of no shingles, an empty array."""
    sentinels = _numbers(_sentinels, "bigint")
    tries = _numbers([x for row in _tries for x in row])
    orders = _numbers([x for row in _orders for x in row])
    none = F.array().cast("array<bigint>")

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, _shift) != F.shiftright(F.get(s, i - 1), _shift)))

    def densified(v: Column) -> Column:
        full = F.zip_with(v, sentinels, lambda x, s: F.when(x != s, x))

        def fill(u: Column) -> Column:
            def value(x: Column, b: Column) -> Column:
                tried = [F.get(u, F.get(tries, b * TRIES + k)) for k in range(TRIES)]
                last = F.get(F.filter(F.transform(F.slice(orders, b * BINS + 1, F.lit(BINS)), lambda j: F.get(u, j)), lambda y: y.isNotNull()), F.lit(0))
                return F.coalesce(x, *tried, last)

            return F.transform(u, value)

        return let(full, fill)

    return let(of, lambda h: F.when(F.size(h) == 0, none).otherwise(let(let(F.sort_array(F.concat(h, sentinels)), firsts), densified)))


def packed(values: Column) -> Column:
    """The low bits of all bins as lowercase hex; the empty string of no bins."""
    digits = F.split(F.lit(",".join(f"{i:0{BITS // 4}x}" for i in range(1 << BITS))), ",")
    return F.array_join(F.transform(values, lambda v: F.get(digits, v.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of what two arrays of bins were made from."""
    chance = 2.0**-BITS

    def of(s: Column) -> Column:
        x, y = s["a"], s["b"]
        equal = F.size(F.filter(F.zip_with(x, y, lambda i, j: i.bitwiseXOR(j).bitwiseAND(F.lit((1 << BITS) - 1))), lambda d: d == 0))
        near = F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1 - chance))
        return F.when((F.size(x) == 0) | (F.size(y) == 0), (F.size(x) == F.size(y)).cast("double")).otherwise(near)

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every whole text; nothing is shuffled."""
    return docs.select("doc_id", packed(bins(shingles(words(F.col("text"))))).alias("fingerprint"))


def _range(df: DataFrame, key: str, ranges: int) -> Column:
    """The number of a row's range, from 1 in order of keys, 0 for a null: ranges hold about as many rows, wherever the keys are."""
    steps = [k / ranges for k in range(1, ranges)]
    bounds = df.agg(F.percentile_approx(key, F.lit(steps), F.lit(20 * ranges))).first()[0] if steps else None
    if not bounds:
        return F.when(F.col(key).isNull(), F.lit(0)).otherwise(F.lit(1))
    # the place that the key takes among the bounds
    place = F.array_position(F.sort_array(F.concat(_numbers(sorted(set(bounds)), "bigint"), F.array(key))), F.col(key))
    return F.coalesce(place, F.lit(0)).cast("int")


def following(keys: DataFrame, key: str, rows: int = 1_000_000) -> DataFrame:
    """``key, next``: the next lower of some distinct whole numbers; of the least, the greatest.

    Up to ``rows`` numbers are put in order by one task; more are cut into ranges, and only the
    ranges' greatest numbers go on.
    """
    n, high = keys.agg(F.count("*"), F.max(key)).first()
    if not n:
        return keys.select(F.col(key), F.col(key).alias("next"))
    if n <= rows:
        w = Window.partitionBy(F.lit(0)).orderBy(F.desc(key))
        return keys.select(key, F.coalesce(F.lead(key).over(w), F.lit(high)).alias("next"))
    of = keys.withColumn("_range", _range(keys, key, min(MOST_RANGES, 2 * n // rows + 1)))
    w = Window.partitionBy("_range").orderBy(F.desc(key))
    heads = of.groupBy("_range").agg(F.max(key).alias("_head"))
    order = following(heads.select("_range"), "_range", MOST_RANGES).join(heads.select(F.col("_range").alias("next"), F.col("_head").alias("_first")), "next")
    return of.withColumn("next", F.lead(key).over(w)).join(F.broadcast(order.select("_range", "_first")), "_range").select(key, F.coalesce("next", "_first").alias("next"))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, v, next_text, next_v``: each document, its bins, and those of the next by descending key; the first follows the last.

    Texts move once, to ranges of keys; only the first of each range moves again.  Rows of one key
    follow each other by descending text, and null keys come last.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.withColumn("range", _range(docs, "doc_id", min(MOST_RANGES, RANGES * parts)))
    # MOST_RANGES + 1 rows at most: the greatest key of each range, and then its text
    heads = ranged.groupBy("range").agg(F.max("doc_id").alias("_head"))
    firsts = ranged.join(F.broadcast(heads.withColumnRenamed("range", "_range")), (F.col("range") == F.col("_range")) & F.col("doc_id").eqNullSafe(F.col("_head")))
    firsts = firsts.groupBy("range").agg(F.max("text").alias("head_text"))
    order = following(heads.select("range"), "range").join(firsts.withColumnRenamed("range", "next"), "next").drop("next")
    ranged = ranged.repartitionByRange(parts, "range").withColumn("v", bins(shingles(words(F.col("text")))))
    w = Window.partitionBy("range").orderBy(F.desc("doc_id"), F.desc("text"))
    placed = ranged.select("range", "doc_id", "text", "v", F.lead("text").over(w).alias("next_text"), F.lead("v").over(w).alias("next_v"))
    out = placed.join(F.broadcast(order), "range")
    head = bins(shingles(words(F.col("head_text"))))  # made for the last row of a range alone
    return out.select("doc_id", "text", "v", F.coalesce("next_text", "head_text").alias("next_text"), F.coalesce("next_v", head).alias("next_v"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against that of its edited text and that of the next document.

    The edited text: its last third (code points, rounded down) replaced by the first as many of the next document's text.
    """
    length = F.length("text")
    third = F.floor(length / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), length - third), F.substring("next_text", F.lit(1), third))
    of = with_next(docs).select("doc_id", length.cast("bigint").alias("n_chars"), edited.alias("edited"), "v", "next_v")
    of = of.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "v", "next_v", bins(shingles(words(F.col("edited")))).alias("e"))
    return of.select("doc_id", "n_chars", "edited_sha256", packed(F.col("v")).alias("fingerprint"), packed(F.col("e")).alias("edited_fingerprint"), likeness(F.col("v"), F.col("e")).alias("near_edited"), likeness(F.col("v"), F.col("next_v")).alias("near_next"))
