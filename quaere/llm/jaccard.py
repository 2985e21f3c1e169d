"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles.  A set is known by ``COORDINATES`` min-hashes;
the shingle behind a min-hash is a token sampled from the set, the same one in two sets with
probability equal to their Jaccard similarity.  A run of the join is a tree: at the root and at
each node some coordinates are drawn, every one with probability 1 / (SIMILARITY *
COORDINATES), and the sets at the node go to a child for each drawn coordinate and sampled
token.  So a pair at the threshold has one common child of a node on average, and less similar
ones die out.  A node of at most ``LIMIT`` sets is a leaf and is compared by brute force; a
node that is still larger at ``DEPTH`` (a dense group) is compared in blocks of LIMIT / 2.
A pair at the threshold that meets at depth d does so in a run with probability s(d), where
s(0) = 1 and s(d) = 1 - exp(-s(d - 1)); as many runs are made as bring the chance to meet in
any of them to ``RECALL``.

Equal sets are one set with a number of copies from the start.  Every pair is compared once: in
the least of the leaves that it shares, which each set carries a list of.  A leaf first tells the
sets that have a partner whose min-hashes agree often enough (a pair at the threshold fails this once in some
ten million times), and hands on those sets, never pairs; only they are
fetched whole, and their leaf finds the pairs again and compares them exactly.  What a leaf gives back is each set's
number of links and a spanning forest, from which connected components follow by least labels and
pointer jumping.  Nodes, labels and sets that a large share of a join's rows have are joined by broadcast.

Results: a document without words has an empty set, which is linked to none; a text of one to
four words has one shingle; equal sets are linked whether or not their texts are equal; rows of one key, or of none,
count as documents of their own; columns besides the key and the text are ignored.  The class
of a document is the least key of its connected component (null where none of it has a key).
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NEAR, SHINGLE_WORDS, bounded_batches, cut, pieces, split_join, staged, texts

SIMILARITY, RECALL = NEAR, 0.9999
COORDINATES, LIMIT, DEPTH = 64, 1024, 3
#: Equal min-hashes from which a pair is compared exactly: five standard deviations below the threshold.
LEAST_EQUAL = int(COORDINATES * (SIMILARITY - 5 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / COORDINATES)))
#: Sets that are fetched by a broadcast list of their keys, at most: 16 bytes each.
FEW_SETS = 1_000_000
#: Words whose hash a worker keeps.
KNOWN = 300_000

_words = re.compile(r"[^\W_]+").findall
_known: dict[str, int] = {}
_MASKS = np.array([random.Random(1000 + k).getrandbits(64) for k in range(COORDINATES)], np.uint64)


def meets(depth: int) -> float:
    """Chance that a pair at the threshold shares a node at ``depth`` in one run."""
    s = 1.0
    for _ in range(depth):
        s = 1 - math.exp(-s)
    return s


RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - meets(DEPTH)))


def _hash(word: str) -> int:
    if len(_known) >= KNOWN:
        _known.clear()
    _known[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
    return h


def shingle_set(text: str, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of ``size`` words (of all its words, if they are fewer)."""
    known = _known.get
    h = np.array([known(w) or _hash(w) for w in _words(text.lower())], np.uint64)
    if not len(h):
        return h
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ h[k : len(h) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def _digest(items: np.ndarray, seed: int = 0) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(items.tobytes(), seed)
    high, low = d >> 64, d & (1 << 64) - 1
    return high - (1 << 63), low - (1 << 63)


def _anew(items: np.ndarray, mask: np.uint64) -> np.ndarray:
    """Hashes of the items under a mask; after the XOR alone an item of a small set could own half of all masks."""
    h = (items ^ mask) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def signature(items: np.ndarray) -> np.ndarray:
    """Min-hashes, the low 32 bits of each."""
    return np.array([_anew(items, m).min() for m in _MASKS]).astype(np.uint32).view(np.int32)


def _describe(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    empty = np.zeros(0, np.int32)
    for batch in pieces(batches):
        sets = [shingle_set(t) for t in texts(batch)]
        keys = [_digest(s, seed) for s in sets]
        signs = [signature(s) if len(s) else empty for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("twin"), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(signs, pa.list_(pa.int32()))], ["doc_id", "twin", "set", "low", "signs"])


def _fetch(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Whole sets of the documents that are wanted, under the keys that they are wanted for."""
    for batch in pieces(batches):
        keys, items = [], []
        for key, text in zip(batch.column("set").to_pylist(), texts(batch), strict=True):
            s = shingle_set(text)
            if _digest(s, seed)[0] == key:  # a hash of two texts may stand for the other one
                keys.append(key)
                items.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(items, pa.binary())], ["set", "items"])


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[tuple]]:
    """Rows in order of their first column, by its values."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if held and held[-1][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


#: What a part of a leaf is told of each of its sets.
_MEMBER = ["part", "leaf", "set", "copies", "signs", "leaves", "block", "first", "second"]


def _pairs(rows: list[tuple]) -> np.ndarray:
    """Which sets of a part (columns ``_MEMBER``) are a pair to compare: a half matrix."""
    n, leaf = len(rows), rows[0][1]
    signs = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(n, COORDINATES)
    if n <= 128:
        equal = np.count_nonzero(signs[:, None, :] == signs[None, :, :], axis=2)
    else:
        equal = np.zeros((n, n), np.uint8)
        for k in range(COORDINATES):
            equal += signs[:, k, None] == signs[None, :, k]
    pair = np.triu(equal >= LEAST_EQUAL, 1)
    if rows[0][7] != rows[0][8]:
        blocks = np.array([r[6] for r in rows])
        pair &= blocks[:, None] != blocks[None, :]
    if pair.any():
        # an earlier leaf that both are in has compared them
        column: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            for other in r[5]:
                if other < leaf:
                    column.setdefault(other, []).append(i)
        shared = [v for v in column.values() if len(v) > 1]
        if shared:
            inside = np.zeros((n, len(shared)), np.float32)
            for j, v in enumerate(shared):
                inside[v, j] = 1
            pair &= (inside @ inside.T) == 0
    return pair


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part: the sets with a candidate partner."""
    names, kinds = ["part", "leaf", "set", "block", "first", "second"], [pa.int64()] * 3 + [pa.int32()] * 3
    out: list[tuple] = []
    made = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names)
    for rows in _groups(batches, _MEMBER):
        if len(rows) > 1:
            pair = _pairs(rows)
            out += [(r[0], r[1], r[2], r[6], r[7], r[8]) for r, some in zip(rows, pair.any(axis=0) | pair.any(axis=1), strict=True) if some]
        if len(out) > 10_000:
            yield made()
            out = []
    yield made()


def verify(sets: list[np.ndarray], copies: list[int], partners: list[np.ndarray], least: float = SIMILARITY) -> tuple[list[int], list[int], list[int]]:
    """Exact comparison of each set with its partners (by number): links to documents, links to sets, and roots of the linked."""
    values, local = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    parts = np.split(local, np.cumsum(sizes)[:-1])
    mark = np.zeros(len(values), np.int64)
    links, others, root = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64), list(range(len(sets)))
    number = np.array(copies)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, of in enumerate(partners):
        if not len(of):
            continue
        mark[parts[i]] = 1
        both = np.add.reduceat(mark[np.concatenate([parts[j] for j in of])], np.cumsum(sizes[of]) - sizes[of])
        mark[parts[i]] = 0
        near = of[both >= least * (sizes[i] + sizes[of] - both) - 1e-9]
        links[i] += number[near].sum()
        links[near] += number[i]
        others[i] += len(near)
        others[near] += 1
        for j in near.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    return links.tolist(), others.tolist(), [find(i) for i in range(len(sets))]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _groups(batches, [*_MEMBER, "items"]):
        pair = _pairs(rows)
        links, others, root = verify([np.frombuffer(r[9], np.uint64) for r in rows], [r[3] for r in rows], [np.flatnonzero(x) for x in pair])
        keys = [r[2] for r in rows]
        kept = [k for k in range(len(rows)) if links[k]]
        yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in kept], pa.int64()), pa.array([keys[root[k]] for k in kept], pa.int64()), pa.array([links[k] for k in kept], pa.int64()), pa.array([others[k] for k in kept], pa.int64())], ["set", "root", "links", "others"])


def _picks() -> list[tuple[int, int]]:
    """Run and coordinate of the roots' children."""
    rng = random.Random(11)
    return [(r, i) for r in range(RUNS) for i in range(COORDINATES) if rng.random() < 1 / (SIMILARITY * COORDINATES)]


def _leaves(sets: DataFrame, limit: int, depth: int) -> DataFrame:
    """``leaf, set, size``: the leaves of all runs, those of one set left out."""
    top = F.array(*(F.xxhash64(F.lit(r), F.lit(i), F.get("signs", F.lit(i))) for r, i in _picks()))
    nodes = cut(sets.where(F.size("signs") > 0).select("set", F.explode(top).alias("leaf")).distinct())
    out = None
    for level in range(1, depth + 1):
        sizes = nodes.groupBy("leaf").agg(F.count("*").alias("size")).where("size > 1")
        sized = cut(split_join(nodes, cut(sizes.withColumn("n", F.col("size"))), "leaf"))
        done = sized if level == depth else sized.where(F.col("size") <= limit)
        out = done if out is None else out.unionByName(done)
        large = sized.where(F.col("size") > limit)
        if level == depth or not large.limit(1).count():
            break
        most = (1 << 30) / (SIMILARITY * COORDINATES)
        drawn = F.filter(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), lambda i: F.pmod(F.xxhash64("leaf", i), F.lit(1 << 30)) < F.lit(int(most)))
        children = F.transform(drawn, lambda i: F.xxhash64("leaf", i, F.get("signs", i)))
        nodes = cut(large.join(sets.select("set", "signs"), "set").select("set", F.explode(children).alias("leaf")).distinct())
    return out


def components(edges: DataFrame) -> DataFrame:
    """``set, root``: the least set of each one's connected component, for ``set, root`` edges."""
    both = cut(edges.select("set", "root").unionByName(edges.select(F.col("root").alias("set"), F.col("set").alias("root"))).distinct())
    total = both.count()
    labels = cut(both.groupBy("set").agg(F.least(F.min("root"), F.col("set")).alias("label"), F.count("*").alias("n")))
    while True:
        near = split_join(both, labels.select(F.col("set").alias("root"), "label", "n"), "root", total).groupBy("set").agg(F.min("label").alias("near"))
        least = cut(labels.join(near, "set").select("set", "n", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        # a label's own label is a shorter way to the least one
        jump = least.groupBy("label").agg(F.count("*").alias("n")).join(least.select(F.col("set").alias("label"), F.col("label").alias("further")), "label", "left")
        new = split_join(least.withColumnRenamed("n", "degree"), jump, "label")
        new = cut(new.select("set", F.col("degree").alias("n"), "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("set", "label", "n")
        if not changed:
            return labels.select("set", F.col("label").alias("root"))


def join(docs: DataFrame, *, limit: int = LIMIT, depth: int = DEPTH) -> DataFrame:
    """Of every document: ``class_id``, ``set_id`` (the least key with its very set), ``n_links`` (other documents
    at the threshold, copies included) and ``n_set_links`` (different sets among them)."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("twin"), "text")
    seed = 0
    while True:
        all_rows = staged(docs.mapInArrow(lambda batches, seed=seed: _describe(batches, seed), "doc_id bigint, twin bigint, set bigint, low bigint, signs array<int>"))
        one = F.min(F.struct("doc_id", "twin")).alias("one")
        sets = staged(all_rows.groupBy("set", "low").agg(F.count("*").alias("copies"), F.min("doc_id").alias("set_id"), one, F.first("signs").alias("signs")))
        if not sets.groupBy("set").count().where("count > 1").limit(1).count():
            break
        seed += 1  # two sets met in half of their digests: number them anew
    leaves = cut(_leaves(sets, limit, depth))
    half = F.lit(max(1, limit // 2))
    lists = leaves.groupBy("set").agg(F.collect_list("leaf").alias("leaves"))
    signs = F.unhex(F.array_join(F.transform("signs", lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(255))), 2, "0")), "")).alias("signs")
    info = sets.select("set", "copies", signs).join(lists, "set")
    members = leaves.join(info, "set")
    # a leaf is one part; a dense one is as many parts as it has pairs of blocks
    blocks = F.when(F.col("size") <= limit, F.lit(1)).otherwise(F.ceil(F.col("size") / half)).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("set", F.lit(3)), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.named_struct(F.lit("first"), F.least("block", o), F.lit("second"), F.greatest("block", o)))
    members = members.select("leaf", "set", "copies", "signs", "leaves", "block", F.inline(pairs))
    members = members.select(F.xxhash64("leaf", "first", "second").alias("part"), "leaf", "set", "copies", "signs", "leaves", "block", "first", "second")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = staged(members.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_candidates, "part bigint, leaf bigint, set bigint, block int, first int, second int"))
    ids = cut(wanted.select("set").distinct().join(sets, "set").select("set", F.col("one.doc_id").alias("_id"), F.col("one.twin").alias("_twin")))
    few = ids.limit(FEW_SETS + 1).count() <= FEW_SETS
    fetched = docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("twin") == F.col("_twin")))
    fetched = fetched.select("set", "text").mapInArrow(lambda batches: _fetch(batches, seed), "set bigint, items binary").dropDuplicates(["set"])
    whole = wanted.join(info.join(fetched, "set"), "set").repartition(parts, "part").sortWithinPartitions("part").select(*_MEMBER, "items")
    linked = cut(whole.mapInArrow(_verified, "set bigint, root bigint, links bigint, others bigint"))
    counts = linked.groupBy("set").agg(F.sum("links").alias("links"), F.sum("others").alias("others"))
    roots = components(linked.where("set <> root").select("set", "root"))
    firsts = cut(roots.join(sets.select("set", "set_id"), "set").groupBy("root").agg(F.min("set_id").alias("class_id"), F.count("*").alias("n")))
    known = sets.select("set", "copies", "set_id", (F.size("signs") > 0).alias("words")).join(counts, "set", "left").join(split_join(roots, firsts, "root"), "set", "left")
    own = F.when(F.col("words"), F.col("copies") - 1).otherwise(F.lit(0))
    # documents without words are all of one set but of no one's class
    set_id = F.when(F.col("words"), F.col("set_id"))
    class_id = F.when(F.col("root").isNotNull(), F.col("class_id")).otherwise(set_id)
    known = cut(known.select("set", "words", set_id.alias("set_id"), class_id.alias("class_id"), (own + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("others", F.lit(0)).alias("n_set_links"), F.col("copies").alias("n")))
    out = split_join(all_rows.select("doc_id", "set"), known, "set")
    own_id = lambda c: F.when(F.col("words"), F.col(c)).otherwise(F.col("doc_id")).alias(c)
    return out.select("doc_id", own_id("class_id"), own_id("set_id"), F.col("n_links").cast("bigint").alias("n_links"), F.col("n_set_links").cast("bigint").alias("n_set_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the least key, with all its columns; rows of one key stay together, those without a key stay."""
    dropped = join(docs).groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept")).where("NOT kept AND doc_id IS NOT NULL")
    dropped = cut(dropped.select(F.col("doc_id").alias("_dropped")))
    few = dropped.limit(FEW_SETS + 1).count() <= FEW_SETS
    return docs.join(F.broadcast(dropped) if few else dropped, F.col("doc_id") == F.col("_dropped"), "left_anti")
