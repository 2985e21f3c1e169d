"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of byte strings.  Each adjacent pair that has a
rank sits in the bucket of that rank; a two-level bitmap says which buckets have
entries, so the next rank is two find-first-set steps away, whatever the length of the
pre-token.  Merging a pair moves only its two neighbours to other buckets; the entries
they leave behind are recognised as stale when they are popped.  A pre-token of n bytes
takes O(n log n) steps at worst, against O(n^2) for rescanning the list per merge.

Results: null and empty texts encode to no ids; equal rows give equal rows; any column
besides the key and the text is ignored, whatever its name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, pieces, texts

#: Pre-tokens of a generation whose ids a worker keeps; when it is full, the one before it goes.  Bounds memory only, never results.
CACHE_ENTRIES = 400_000
#: Only pre-tokens up to so many characters are kept.
CACHE_CHARS = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankQueue:
    """Buckets of positions by rank under a two-level bitmap; ``pop`` takes the whole bucket of the least rank."""

    __slots__ = ("buckets", "top", "words")
    #: Ranks of one word of the lower level, as a power of two.
    SHIFT = 8

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.words: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, at: int) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held.append(at)
            return
        self.buckets[rank] = [at]
        high = rank >> self.SHIFT
        bit = 1 << (rank & (1 << self.SHIFT) - 1)
        word = self.words.get(high)
        if word is None:
            self.words[high] = bit
            self.top |= 1 << high
        else:
            self.words[high] = word | bit

    def pop(self) -> tuple[int, list[int]]:
        top = self.top
        high = (top & -top).bit_length() - 1
        word = self.words[high]
        bit = word & -word
        word ^= bit
        if word:
            self.words[high] = word
        else:
            del self.words[high]
            self.top = top ^ (1 << high)
        rank = (high << self.SHIFT) + bit.bit_length() - 1
        held = self.buckets.pop(rank)
        if len(held) > 1:
            held.sort()
        return rank, held


def merge(tokens: list[bytes], ranks: dict[bytes, int]) -> list[tuple[int, ...]]:
    """Ids of each pre-token: always its pair of least rank, the leftmost of equals, is merged next.

    The pre-tokens lie end to end in one list and share one queue; no pair spans two of them.
    """
    text = b"".join(tokens)
    n = len(text)
    get = ranks.get
    first = bytearray(n + 1)  # where a pre-token begins
    at = 0
    for token in tokens:
        first[at] = 1
        at += len(token)
    first[n] = 1
    pair = [-1 if first[i + 1] else get(text[i : i + 2], -1) for i in range(n)]
    queue = RankQueue()
    buckets, pop, push = queue.buckets, queue.pop, queue.push
    for at, rank in enumerate(pair):
        if rank >= 0:
            if rank in buckets:
                buckets[rank].append(at)
            else:
                push(rank, at)
    # a part is text[at : after[at]]; before[at] is where the part to its left begins
    after = list(range(1, n + 1))
    before = list(range(-1, n))
    while queue.top:
        rank, held = pop()
        for k, at in enumerate(held):
            if pair[at] != rank:
                continue  # stale: the pair at this place has changed or gone
            gone = after[at]
            right = after[gone]
            pair[gone] = -1
            after[at] = right
            before[right] = at
            least = rank
            if first[right]:
                pair[at] = -1
            else:
                pair[at] = new = get(text[at : after[right]], -1)
                if new >= 0:
                    if new in buckets:
                        buckets[new].append(at)
                    else:
                        push(new, at)
                    least = new
            if not first[at]:
                left = before[at]
                pair[left] = new = get(text[left:right], -1)
                if new >= 0:
                    if new in buckets:
                        buckets[new].append(left)
                    else:
                        push(new, left)
                    if new < least:
                        least = new
            if least < rank:  # what has come up ranks before the rest of this bucket
                for rest in held[k + 1 :]:
                    push(rank, rest)
                break
    out = []
    at = 0
    for token in tokens:
        end = at + len(token)
        ids = []
        while at < end:
            ids.append(ranks[text[at : after[at]]])
            at = after[at]
        out.append(tuple(ids))  # the garbage collector leaves tuples of numbers alone
    return out


class Codec:
    """Encodes and decodes texts; a rank file must have every single byte."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.name_of = {i: str(i) for i in ranks.values()}
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def learn(self, words: set[str]) -> None:
        """Make the ids of words that aren't known known."""
        fresh: dict[str, tuple[int, ...]] = {}
        for word in words.intersection(self.older):
            fresh[word] = self.older[word]
        rest = [(w, w.encode()) for w in words.difference(fresh)]
        whole = self.ranks.get
        fresh |= {w: (i,) for w, raw in rest if (i := whole(raw)) is not None}
        rest = [(w, raw) for w, raw in rest if w not in fresh]
        fresh.update(zip([w for w, _ in rest], merge([raw for _, raw in rest], self.ranks), strict=True))
        self.known |= fresh

    def encode_all(self, of: list[str]) -> list[list[int]]:
        found = [self.find(x) for x in of]
        words = set().union(*found)
        if unknown := words.difference(self.known):
            if len(self.known) + len(unknown) > CACHE_ENTRIES:  # a new generation, that must hold all words of this batch
                self.older, self.known = self.known, {}
                unknown = words
            self.learn(unknown)
        known = self.known
        out = [list(chain.from_iterable(map(known.__getitem__, x))) for x in found]
        for long in [w for w in unknown if len(w) > CACHE_CHARS]:
            known.pop(long, None)
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def spelled(self, ids: list[int]) -> bytes:
        return " ".join(map(self.name_of.__getitem__, ids)).encode()


_codecs: dict[object, Codec] = {}


def _codec(key: object, ranks: dict[bytes, int], pattern: str) -> Codec:
    """One codec per worker process, so that its known pre-tokens serve all of its tasks."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def _mapped(docs: DataFrame, columns: list[str], make, schema: str, path: str, pattern: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))  # a vocabulary file: about a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec((path, pattern), shared.value, pattern)
        for batch in pieces(batches):
            yield make(codec, batch)

    return docs.select(*columns).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids array<int>``: the ids of every whole text."""

    def make(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = pa.array(codec.encode_all(texts(batch, text)), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(key), ids], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return _mapped(docs, [key, text], make, f"`{key}` {kind}, ids array<int>", path, pattern)


def decode(encoded: DataFrame, path: str, pattern: str = "", *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, data binary``: the bytes of every list of ids; a null list has none.  An unknown id is an error."""

    def make(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        data = pa.array([codec.decode(x or []) for x in batch.column(ids).to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(key), data], [key, "data"])

    kind = encoded.schema[key].dataType.simpleString()
    return _mapped(encoded, [key, ids], make, f"`{key}` {kind}, data binary", path, pattern)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode and digest in one pass over the texts; nothing is shuffled."""

    def make(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        count, spelled, decoded = [], [], []
        for ids in codec.encode_all(texts(batch)):
            count.append(len(ids))
            spelled.append(hashlib.sha256(codec.spelled(ids)).hexdigest())
            decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(spelled, pa.string()), pa.array(decoded, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return _mapped(docs, ["doc_id", "text"], make, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", path, pattern)
