"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are compared word by word (lower-cased runs of letters and
digits).  Pairs come from seeds, runs of ``least`` words that both have.  Of such a pair
the longest run of words that neither side has used yet is marked, then the next longest,
down to ``least`` words: Karp-Rabin hashes of all unmarked runs of one length, checked
word by word and drawn out as far as they go, find the runs; the length halves whenever
nothing of it is left.  The share of the item's words that end up marked is its coverage,
which doesn't ask in which order the document has the pieces.

The benchmark is brought to the documents in parts of at most ``PART_WORDS`` words each;
more parts mean more passes over the documents.  No document is moved.

Results: null and empty texts match nothing; an item of fewer than ``least`` words matches
nothing; items that stand on several rows count on their own; equal documents give equal
results; among equally long runs the first in the item, then the first in the document is
marked; columns besides keys and texts are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, bounded_batches, pieces, texts

#: Share of an item's words from which a document is taken to hold it.
COVERAGE = 0.5
#: Words of one broadcast part of the benchmark, at most (but one item at least): some 40 MB.
PART_WORDS = 1_000_000

_words = re.compile(r"[^\W_]+").findall
_BASE = 1_000_003
_MASK = (1 << 61) - 1


def words(text: str | None) -> list[str]:
    return _words((text or "").lower())


def _hashes(ids: list[int], length: int) -> list[int]:
    """Karp-Rabin hashes of all runs of ``length`` ids."""
    lead, h, out = pow(_BASE, length - 1, _MASK), 0, []
    for k, x in enumerate(ids):
        if k >= length:
            h = (h - ids[k - length] * lead) % _MASK
        h = (h * _BASE + x) % _MASK
        if k >= length - 1:
            out.append(h)
    return out


def _clear(marked: bytearray, length: int) -> list[bool]:
    """For each run of ``length``: whether no place of it is marked."""
    out, last = [], -1
    for k, m in enumerate(marked):
        if m:
            last = k
        if k >= length - 1:
            out.append(last <= k - length)
    return out


def tiles(doc: list[int], item: list[int], least: int = SHINGLE_WORDS) -> list[tuple[int, int, int]]:
    """``(place in doc, place in item, length)`` of the marked runs, in the order of marking.

    Ids may be any non-negative numbers; a document's word that the item lacks may be -1.
    """
    in_doc, in_item = bytearray(x < 0 for x in doc), bytearray(len(item))
    out: list[tuple[int, int, int]] = []
    size = max(least, len(item) // 2)
    while size >= least:
        found = _scan(doc, item, in_doc, in_item, size)
        longest = max((n for n, _, _ in found), default=0)
        if longest > 2 * size:
            size = longest  # so long a match first
            continue
        for n, i, j in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if not (any(in_item[i : i + n]) or any(in_doc[j : j + n])):
                in_item[i : i + n] = in_doc[j : j + n] = b"\x01" * n
                out.append((j, i, n))
            elif n > size:
                break  # what is left of it may still be longer than what follows: scan again
        else:
            if size == least:
                if not found:
                    break
            elif not found:
                size = max(least, size // 2)
    return out


def _scan(doc: list[int], item: list[int], in_doc: bytearray, in_item: bytearray, size: int) -> list[tuple[int, int, int]]:
    """``(length, place in item, place in doc)`` of the maximal unmarked matches of ``size`` words or more."""
    if min(len(doc), len(item)) < size:
        return []
    at: dict[int, list[int]] = defaultdict(list)
    for i, (h, free) in enumerate(zip(_hashes(item, size), _clear(in_item, size), strict=True)):
        if free:
            at[h].append(i)
    out = []
    for j, (h, free) in enumerate(zip(_hashes(doc, size), _clear(in_doc, size), strict=True)):
        if not free:
            continue
        for i in at.get(h, ()):
            if i and j and not in_item[i - 1] and not in_doc[j - 1] and item[i - 1] == doc[j - 1]:
                continue  # part of a match that begins further left
            n = 0
            while i + n < len(item) and j + n < len(doc) and not in_item[i + n] and not in_doc[j + n] and item[i + n] == doc[j + n]:
                n += 1
            if n >= size:
                out.append((n, i, j))
    return out


@dataclass
class Benchmark:
    """Items as ids of their words, and which items have which seed."""

    ids: dict[str, int]
    keys: list
    items: list[list[int]]
    least: int
    seeds: np.ndarray
    owners: dict[int, list[tuple[int, int]]]

    @classmethod
    def of(cls, rows: list[tuple[object, str | None]], least: int) -> Benchmark:
        ids: dict[str, int] = {}
        keys, items = [], []
        for key, text in rows:
            found = [ids.setdefault(w, len(ids)) for w in words(text)]
            if len(found) >= least:
                keys.append(key)
                items.append(found)
        owners: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, item in enumerate(items):
            for at, h in enumerate(_rolled(np.array(item, np.int64), least).tolist()):
                owners[h].append((k, at))
        return cls(ids, keys, items, least, np.array(sorted(owners), np.uint64), dict(owners))

    def found_in(self, of: list[str], coverage: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """``(number of the text, number of the item, tiles)`` wherever the coverage is reached."""
        lists = [words(x) for x in of]
        sizes = np.array([len(x) + 1 for x in lists])  # a word that nothing has stands between the texts
        ends = np.cumsum(sizes)
        ids = np.full(int(sizes.sum()), -1, np.int64)
        for begin, x in zip(ends - sizes, lists, strict=True):
            ids[begin : begin + len(x)] = np.fromiter(map(self.ids.get, x, repeat(-1)), np.int64, len(x))
        run = np.convolve(ids >= 0, np.ones(self.least, np.int64), "valid") == self.least if len(ids) >= self.least else np.zeros(0, bool)
        at = np.flatnonzero(run)
        hashes = _rolled(ids, self.least, at)
        place = np.searchsorted(self.seeds, hashes).clip(0, max(0, len(self.seeds) - 1))
        hit = self.seeds[place] == hashes if len(self.seeds) else np.zeros(len(hashes), bool)
        shared: dict[tuple[int, int], set[int]] = defaultdict(set)
        for text, h in zip(np.searchsorted(ends, at[hit], side="right").tolist(), hashes[hit].tolist(), strict=True):
            for item, first in self.owners[h]:
                shared[text, item].add(first)
        for (text, item), firsts in sorted(shared.items()):
            target = self.items[item]
            # no tiling can cover more than the seeds do
            if len({f + k for f in firsts for k in range(self.least)}) < coverage * len(target):
                continue
            begin = int(ends[text] - sizes[text])
            made = tiles(ids[begin : begin + len(lists[text])].tolist(), target, self.least)
            if sum(n for _, _, n in made) >= coverage * len(target):
                yield text, item, made


def _rolled(ids: np.ndarray, length: int, at: np.ndarray | None = None) -> np.ndarray:
    """A hash of the run of ``length`` ids at each place."""
    at = np.arange(max(0, len(ids) - length + 1)) if at is None else at
    h = np.zeros(len(at), np.uint64)
    for k in range(length):
        h = (h ^ ids[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _parts(benchmark: DataFrame, least: int, part_words: int) -> Iterator[Benchmark]:
    """The benchmark in parts whose size is checked, one at a time on the driver."""
    rows: list[tuple[object, str | None]] = []
    held = 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        n = len(words(row["text"]))
        if rows and held + n > part_words:
            yield Benchmark.of(rows, least)
            rows, held = [], 0
        rows.append((row["item_id"], row["text"]))
        held += n
    yield Benchmark.of(rows, least)


def matches(docs: DataFrame, benchmark: DataFrame, *, least: int = SHINGLE_WORDS, coverage: float = COVERAGE, part_words: int = PART_WORDS) -> DataFrame:
    """A row for each document and item whose coverage is reached: ``doc_id, item_id, item_words, covered, coverage, tiles``."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, item_words int, covered int, coverage double, tiles array<struct<doc_at:int,item_at:int,length:int>>"
    tile = pa.list_(pa.struct([("doc_at", pa.int32()), ("item_at", pa.int32()), ("length", pa.int32())]))
    kinds = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int32()), ("covered", pa.int32()), ("coverage", pa.float64()), ("tiles", tile)]
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def over(part: Benchmark) -> DataFrame:
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = shared.value
            for batch in pieces(batches):
                keys, rows = batch.column("doc_id").to_pylist(), []
                for text, item, made in bench.found_in(texts(batch), coverage):
                    n, total = sum(t[2] for t in made), len(bench.items[item])
                    rows.append({"doc_id": keys[text], "item_id": bench.keys[item], "item_words": total, "covered": n, "coverage": n / total, "tiles": [dict(zip(("doc_at", "item_at", "length"), t, strict=True)) for t in made]})
                yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

        return docs.mapInArrow(run, schema)

    return reduce(DataFrame.unionAll, map(over, _parts(benchmark, least, part_words)))


def remove(docs: DataFrame, benchmark: DataFrame, *, least: int = SHINGLE_WORDS, coverage: float = COVERAGE, part_words: int = PART_WORDS) -> DataFrame:
    """The documents that hold no item of the benchmark, with all their columns; nothing is moved."""
    bounded_batches(docs.sparkSession)
    for part in _parts(benchmark, least, part_words):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                bad = {text for text, _, _ in shared.value.found_in(texts(batch), coverage)}
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
