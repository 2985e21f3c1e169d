"""Removal of repeated byte strings by suffix sorting, block by block.

Wanted is every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else.
All suffixes of a corpus don't fit anywhere, so they are put into buckets that can be
sorted one at a time:

1. A suffix belongs to the least of the hashes of the ``GRAM``-byte strings within its first
   LENGTH bytes, the leftmost of equals.  Suffixes that agree in LENGTH bytes thus share a
   bucket, and consecutive suffixes mostly do, so a run of suffixes is one short row.
2. A bucket of one run holds no repeat.  The runs of the others are fetched: a run of n
   suffixes takes n + LENGTH - 1 bytes.  Equal runs of a bucket are set aside as repeats.
3. What is left is sorted as in blockwise construction with a difference cover: suffixes are
   named by their first 32 bytes; ties are resolved by names, made beforehand by doubling,
   of the suffixes at a difference cover modulo 13 (by place in the document).  Any two
   suffixes reach the cover together within 12 bytes, so two names at each of a
   suffix's four cover places, with those of its ends, tell all of LENGTH bytes, and no
   tie is ever followed byte by byte.
   One block of buckets, at most ``BLOCK_BYTES`` unless a bucket alone is larger, is in memory.
4. A bucket of more than ``HOT`` runs isn't gathered: its equal runs are found by grouping them by their
   bytes, first within documents and on the map side.  Equal runs are repeats throughout.
   Of each different run one goes on to the sorting, cut into pieces of up to eight suffixes that keep their
   distance from the anchor, in buckets by what all strings of a piece have in common.  Should
   one of these be as large again, its strings are grouped by their bytes, one by one.

Equal texts are told first, by hashes that the documents alone are grouped by: all of such a text is a
repeat, and one of them goes through the steps above so that other texts meet it.  A key that holds more than
1 / ``SPLIT`` of the rows of a join is joined by broadcast: there are at most SPLIT of them.

Matches never cross documents, as runs don't.  Texts move once (to their runs' places; the
last join reuses that exchange).

Results: a null text is empty; texts of fewer than LENGTH bytes have nothing removed; equal rows and rows of
one key are documents of their own, a null key like any other; columns besides the key and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, pieces, split_join, split_semi, staged

LENGTH, GRAM = 200, 32
#: Runs of a bucket that one task gathers, at most, and bytes of a block.
HOT, BLOCK_BYTES = 8192, 1 << 20
#: Runs of hot buckets, or texts with copies, up to which their list is broadcast: some 30 bytes each.
FEW = 1_000_000
#: Suffixes of a piece of a run, at most.
PIECE = 8
#: A perfect difference set: every residue is a difference of two of its members.
MODULUS, COVER = 13, (0, 1, 3, 9)

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0][0]) < n:
        size = max(n, 1 << 16)
        both = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers[:] = [tuple(both)]
    return _powers[0]


def _grams(data: np.ndarray) -> np.ndarray:
    """A mixed hash of the GRAM bytes at each place."""
    up, down = _power_tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    h = (total[GRAM:] - total[:-GRAM]) * down[: len(data) - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values, from the running least of blocks in both directions."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts end to end: each run's bucket, text, first place in the text, and number of suffixes."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none, none, none
    grams = _grams(data)
    half = np.uint64(32)  # the upper half of a hash ranks it; equal ones go by place
    least = _sliding_least((grams >> half << half) | np.arange(len(grams), dtype=np.uint64), LENGTH - GRAM + 1)
    anchor = (least & np.uint64((1 << 32) - 1)).astype(np.int64)
    text = np.searchsorted(ends, np.arange(len(least)), side="right")
    inside = np.arange(len(least)) + LENGTH <= ends[np.minimum(text, len(ends) - 1)]
    begins = np.ones(len(least), bool)
    begins[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(begins & inside)
    # a run ends where the next begins or where its text has no more suffixes
    stops = np.append(np.flatnonzero(begins | ~inside), len(least))
    n = stops[np.searchsorted(stops, at, side="right")] - at
    starts = np.concatenate([[0], ends[:-1]])
    return grams[anchor[at]], text[at], at - starts[text[at]], n


#: Bytes of texts that are hashed together.
CHUNK_BYTES = 1 << 20


def _run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 4096):
        rows, held, texts = batch.column("row").to_numpy(), [], batch.column("data").to_pylist()
        size, first = 0, 0
        for k, text in enumerate(texts):
            held.append(text)
            size += len(text)
            if size >= CHUNK_BYTES or k == len(texts) - 1:
                bucket, number, place, n = runs(np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held]))
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array(rows[first + number] if len(number) else rows[:0]), pa.array(place << 16 | n)], ["bucket", "row", "run"])
                held, size, first = [], 0, k + 1


def _names(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.uint64)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _names(a << np.uint64(32) | b)


def repeats(rows: list[bytes], places: list[int]) -> list[np.ndarray]:
    """For each row of bytes, from ``places`` of its document on: which of its suffixes share LENGTH bytes with another."""
    sizes = np.array([len(r) for r in rows])
    starts = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    data = np.frombuffer(b"".join(rows) + bytes(LENGTH), np.uint8)
    words = np.ndarray((n + LENGTH - 7,), ">u8", data, strides=(1,)).astype(np.uint64)
    named = _names(words)
    for width in (8, 16):  # names of 16 and then 32 bytes
        named = _pairs(named[:-width], named[width:])
    row = np.searchsorted(starts, np.arange(n), side="right") - 1
    residue = (np.arange(n) - starts[row] + np.array(places)[row]) % MODULUS
    cover = np.isin(residue, COVER)
    at = np.flatnonzero(cover)
    number = np.zeros(len(named) + LENGTH, np.int64)
    number[at] = np.arange(len(at))
    # a cover suffix's name of 58 bytes, from two of 32 that are 26 apart, and of 110, from two of 58 that are 52 apart
    last = len(named) - 1
    name = _pairs(named[at], named[np.minimum(at + 2 * MODULUS, last)])
    name = _pairs(name, name[number[at + 4 * MODULUS]])
    counts = sizes - LENGTH + 1
    suffix = np.repeat(starts, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    keys: list[list[np.ndarray]] = [[], [], [], [], []]
    owners = []
    for ahead in range(MODULUS):
        own = np.flatnonzero(np.isin((residue[suffix] + ahead) % MODULUS, COVER))
        p = suffix[own]
        owners.append(own)
        for k, v in enumerate((np.full(len(p), ahead, np.uint64), named[p], name[number[p + ahead]], name[number[p + ahead + 6 * MODULUS]], named[p + LENGTH - 32])):
            keys[k].append(v)
    columns = [np.concatenate(k) for k in keys]
    owner = np.concatenate(owners)
    mixed = np.zeros(len(owner), np.uint64)
    for c in columns:
        mixed = (mixed ^ c) * np.uint64(_BASE)
        mixed ^= mixed >> np.uint64(31)
    order = np.argsort(mixed, kind="stable")
    same = np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in columns])
    out = np.zeros(len(suffix), bool)
    out[owner[order][1:][same]] = True
    out[owner[order][:-1][same]] = True
    return np.split(out, np.cumsum(counts)[:-1])


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """First suffix and one after the last of each run of flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


_SPANS = pa.list_(pa.struct([("at", pa.int32()), ("until", pa.int32())]))
_FETCHED = {"bucket": pa.int64(), "place": pa.int32(), "data": pa.binary(), "row": pa.int64()}
_FETCHED_DDL = "bucket bigint, place int, data binary, row bigint"


def _made(out: list, kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out or [[]] * len(kinds), kinds.values(), strict=True)], list(kinds))


def _block(rows: list[tuple]) -> pa.RecordBatch:
    """Removed stretches of the runs of whole buckets: ``(bucket, place, data, row)``."""
    owners: dict[tuple, list[tuple[int, int]]] = {}
    buckets: dict[int, set] = {}
    for bucket, place, data, row in rows:
        owners.setdefault((bucket, data), []).append((row, place))
        buckets.setdefault(bucket, set()).add(data)
    flags = {key: np.ones(len(key[1]) - LENGTH + 1, bool) for key, of in owners.items() if len(of) > 1}
    rest = [key for key in owners if len(buckets[key[0]]) > 1]
    if rest:
        for key, found in zip(rest, repeats([k[1] for k in rest], [owners[k][0][1] for k in rest]), strict=True):
            flags[key] = found | flags[key] if key in flags else found
    out: dict[int, list[dict]] = {}
    for key, found in flags.items():
        for a, b in _spans(found):
            for row, place in owners[key]:
                out.setdefault(row, []).append({"at": place + a, "until": place + b + LENGTH - 1})
    return _made([list(out), list(out.values())], {"row": pa.int64(), "spans": _SPANS})


def _sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of their buckets; blocks are of whole buckets."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in _FETCHED), strict=True):
            if size >= BLOCK_BYTES and held[-1][0] != row[0]:
                yield _block(held)
                held, size = [], 0
            held.append(row)
            size += len(row[2])
    if held:
        yield _block(held)


def _fetched_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Of each text: ``(bucket, place, data, row)`` of the runs that are wanted."""
    for batch in pieces(batches, 256):
        for row, data, found in zip(*(batch.column(c).to_pylist() for c in ("row", "data", "runs")), strict=True):
            ends = [(r["bucket"], r["run"] >> 16, (r["run"] >> 16) + (r["run"] & 0xFFFF) + LENGTH - 1) for r in found]
            yield [(bucket, a, data[a:b], row) for bucket, a, b in ends]


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for runs_of in _fetched_runs(batches):
        yield _made(list(zip(*runs_of, strict=True)), _FETCHED)


def _distinct_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different run of a text, with all its places there."""
    for runs_of in _fetched_runs(batches):
        places: dict[tuple[int, bytes, int], list[int]] = {}
        for bucket, place, data, row in runs_of:
            places.setdefault((bucket, data, row), []).append(place)
        yield _made([*zip(*places, strict=True), list(places.values())], {"bucket": pa.int64(), "data": pa.binary(), "row": pa.int64(), "places": pa.list_(pa.int32())})


def _pieces_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs cut up by their suffixes' distance from the anchor, under the hash of what a piece's strings share."""
    for batch in pieces(batches):
        out: list[list] = [[], [], [], []]
        for bucket, place, data, row in zip(*(batch.column(c).to_pylist() for c in _FETCHED), strict=True):
            n = len(data) - LENGTH + 1
            anchor = int((_grams(np.frombuffer(data, np.uint8))[: LENGTH - GRAM + 1] >> np.uint64(32)).argmin())
            begin = 0
            while begin < n:
                end = min(n, begin + (anchor - begin) % PIECE + 1)
                # what all strings at these distances share, whether or not this run has all of them
                number = (anchor - begin) // PIECE
                shared = anchor - number * PIECE
                common = xxhash.xxh3_64_intdigest(data[shared : shared + LENGTH - PIECE + 1], (bucket + number) & (1 << 64) - 1)
                for k, v in enumerate((common - (1 << 63), place + begin, data[begin : end + LENGTH - 1], row)):
                    out[k].append(v)
                begin = end
        yield _made(out, _FETCHED)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each string of LENGTH bytes of the pieces."""
    for batch in pieces(batches):
        out: list[list] = [[], [], []]
        for place, data, row in zip(*(batch.column(c).to_pylist() for c in ("place", "data", "row")), strict=True):
            for k in range(len(data) - LENGTH + 1):
                for i, v in enumerate((data[k : k + LENGTH], row, place + k)):
                    out[i].append(v)
        yield _made(out, {"data": pa.binary(), "row": pa.int64(), "at": pa.int32()})


_KEPT = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary()}


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        batch = batch.filter(batch.column("own"))
        out: list[list] = [[], [], [], []]
        for data, spans in zip(batch.column("data").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            merged: list[list[int]] = []
            for a, b in sorted((s["at"], s["until"]) for part in spans or [] for s in part):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            kept, done = [], 0
            for a, b in merged:
                kept.append(data[done:a])
                done = b
            kept.append(data[done:])
            for k, v in enumerate((len(data), sum(b - a for a, b in merged), len(merged), b"".join(kept))):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_made(out, _KEPT).columns], ["doc_id", *_KEPT])


def _with_rows(of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts with ``row``, a number that just equal ones share, and the numbers of those that have copies."""
    seed = 0
    while True:
        rows = of.withColumn("row", F.xxhash64(F.lit(seed), "data"))
        told = rows.select("row", *(F.xxhash64(F.lit(seed + k), "data").alias(f"h{k}") for k in (1, 2)))
        copied = told.groupBy("row").agg(F.count("*").alias("n"), *(f(h).alias(f"{f.__name__}_{h}") for f in (F.min, F.max) for h in ("h1", "h2"))).where("n > 1")
        copied = cut(copied.select("row", "n", (F.col("min_h1") != F.col("max_h1")) | (F.col("min_h2") != F.col("max_h2"))).toDF("row", "n", "mixed"))
        if not copied.where("mixed").limit(1).count():
            return rows, copied.select("row", "n")
        seed += 3  # two texts met in one number: number them anew


def removed(docs: DataFrame, *, hot: int = HOT, few: int = FEW) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept binary`` of every document."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    of = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    size, none = F.length("data").cast("bigint"), F.lit(0).cast("bigint")
    short = of.where(F.length("data") < LENGTH).select("doc_id", size.alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("data").alias("kept"))
    rows, copied = _with_rows(of.where(F.length("data") >= LENGTH))
    n_copied, n_copies = copied.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n_copied <= few:
        single = rows.join(F.broadcast(copied.select("row")), "row", "left_anti")
        met = rows.join(F.broadcast(copied.select("row")), "row", "left_semi").groupBy("row").agg(F.first("data").alias("data"))
    else:
        single = rows.join(copied.select("row"), "row", "left_anti")
        met = rows.groupBy("row").agg(F.first("data").alias("data"), F.count("*").alias("n")).where("n > 1")
    copies = split_semi(rows.select("row", "doc_id", size.alias("n_bytes")), copied, "row", n_copies)
    copies = copies.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), F.lit(b"").alias("kept"))
    each = single.select("doc_id", F.lit(True).alias("own"), "row", "data")
    if n_copied:
        one = staged(met.select("row", "data"))
        each = each.unionByName(one.select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(False).alias("own"), "row", "data"))

    found = staged(each.select("row", "data").mapInArrow(_run_batches, "bucket bigint, row bigint, run bigint"))
    often = found.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")

    def fetched(wanted: DataFrame, to, schema: str, broadcast: bool = False) -> DataFrame:
        """``wanted`` are ``bucket, row, run``; a few are sent to the texts, for many the texts move."""
        lists = wanted.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("bucket", "run")).alias("runs"))
        return each.join(F.broadcast(lists) if broadcast else lists, F.col("row") == F.col("_row")).select("doc_id", "own", "row", "data", "runs").mapInArrow(to, schema)

    parts = spark.conf.get("spark.sql.shuffle.partitions")
    large = cut(often.where(F.col("n") > hot))
    n_hot = large.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # rows of the large buckets meet nothing in the next join: they stay away where their list is short
    rest = found.join(F.broadcast(large.select("bucket")), "bucket", "left_anti") if 0 < n_hot <= few * hot else found
    cold = fetched(rest.join(often.where(F.col("n") <= hot).select("bucket"), "bucket", "left_semi"), _fetch, _FETCHED_DDL)
    spans = None
    if n_hot:
        of_hot = staged(fetched(split_semi(found, large, "bucket", n_hot), _distinct_runs, "bucket bigint, data binary, row bigint, places array<int>", n_hot <= few))
        first = F.struct("row", F.get("places", F.lit(0)).alias("place"))
        kinds = staged(of_hot.groupBy("bucket", "data").agg(F.sum(F.size("places")).alias("n"), F.count("*").alias("texts"), F.min(first).alias("first")))
        twice = kinds.where("n > 1")
        equal = split_join(of_hot, twice.select("bucket", "data", F.col("texts").alias("n")), ["bucket", "data"])
        spans = equal.select("row", F.transform("places", lambda p: F.struct(p.alias("at"), (p + F.length("data")).alias("until"))).cast("array<struct<at:int,until:int>>").alias("spans"))
        cuts = staged(kinds.select("bucket", "first.place", "data", "first.row").mapInArrow(_pieces_of_runs, _FETCHED_DDL))
        shared = cut(cuts.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
        cold = cold.unionByName(cuts.join(shared.where(F.col("n") <= hot).select("bucket"), "bucket", "left_semi").select(*cold.columns))
        if shared.where(F.col("n") > hot).limit(1).count():
            counted = staged(split_semi(cuts, shared.where(F.col("n") > hot), "bucket", n_hot).mapInArrow(_strings, "data binary, row bigint, at int"))
            often_met = counted.groupBy("data").agg(F.count("*").alias("n")).where("n > 1")
            spans = spans.unionByName(split_join(counted, often_met, "data").select("row", F.array(F.struct(F.col("at"), (F.col("at") + LENGTH).alias("until"))).alias("spans")))
    blocks = cold.repartition(int(parts), "bucket").sortWithinPartitions("bucket").mapInArrow(_sorted_blocks, "row bigint, spans array<struct<at:int,until:int>>")
    spans = blocks if spans is None else blocks.unionByName(spans)
    lists = spans.groupBy(F.col("row").alias("_row")).agg(F.collect_list("spans").alias("spans"))
    both = each.join(lists, F.col("row") == F.col("_row"), "left")
    kept = both.select("doc_id", "own", "row", "data", "spans").mapInArrow(_keep, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return short.unionByName(copies).unionByName(kept)


def digests(docs: DataFrame) -> DataFrame:
    """What was removed of each document, and the digest of what is left."""
    out = removed(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute(texts: list[bytes]) -> list[tuple[int, int, str]]:
    """For tests: removed bytes, spans and digest, from a table of all strings."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for k in range(len(t) - LENGTH + 1):
            seen[t[k : k + LENGTH]] = seen.get(t[k : k + LENGTH], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - LENGTH + 1):
            if seen[t[k : k + LENGTH]] > 1:
                gone[k : k + LENGTH] = b"\x01" * LENGTH
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out
