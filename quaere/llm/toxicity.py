"""Toxicity by class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary texts, spell each word from its start, each
interpolated and absolutely discounted, over the context u of all its characters so far:

    P(c | u) = max(C(u c) - D, 0) / (C(u) + B) + (D T(u) + B) / (C(u) + B) * A(c | u)

``C`` and ``T`` (distinct characters after the context) are of the class, ``D`` is
``DISCOUNT`` and ``B`` the ``SHARED`` backoff counts.  ``A``, the shared backoff, is a Kneser-Ney model of *all* documents,
labelled or not: the same form and, below it, the continuation shares of the word's last
``SHORT`` characters v (of the distinct characters before ``v c``).  A rare expression
thus gets nearly the same probability from both models, and what is frequent in one
class only stands out, inflected or not.  A text's evidence is the mean over its words
of the difference of the log-likelihoods, in two parts (see ``evidence``); a logistic
curve over them and the length makes it a score.
Characters are lower-cased, and a run of others than letters and digits ends a word.
Past ``LONG`` characters of a word the context slides: it is the last ``LONG - 1``.

Everything is counted over whole texts of all documents, exactly, and grows with them:

1. Words are counted, in the tasks and then by word: in all documents and in each class.
2. Distinct words are spelled into grams; all grams of one context meet, and leave the
   difference of their log-probabilities, or nothing where neither class has met the context.
3. Texts are scored by these differences.  Up to ``FEW_GRAMS`` they are broadcast; more
   are joined to the texts' distinct words, and the words' sums to the texts.

One labelled row in ``FOLDS`` is kept for the curve, at most ``sample`` rows: it is fitted to their evidence by models that
are counted without them.  The models that score count them too.

Results: null, empty and letterless texts have no evidence and take the score of
evidence 0; equal texts have equal scores; a key labelled more than once takes the mean
label; null labels and labels without a document are left out; without two classes all
scores are the base rate (0 without labels).  Columns besides the key and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, pieces, split_join, staged, texts
from .quality import held_out, training_rows

#: Characters of the longest gram and of the short context.
LONG, SHORT = 9, 3
#: Counts a gram gives up to the backoff, and the backoff counts that every context of a class has besides.
DISCOUNT, SHARED = 0.75, 10.0
#: Log-likelihood that a word of ordinary use adds either way.
BULK = 2.0
#: Labelled rows that the logistic curve is fitted to, at most, and the share of labelled rows that it takes them from.
SAMPLE, FOLDS = 20_000, 4
THRESHOLD = 0.7
#: Rows that a task holds before it adds up those of one key, and words that it spells at once.
HELD, SPELLED = 1 << 21, 1 << 16
#: Differences that are broadcast, at most (16 bytes each); labels (16 bytes) and shares of short grams (12 bytes) likewise.
FEW_GRAMS, FEW_LABELS, FEW_SHORTS = 6_000_000, 1_000_000, 1_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_symbols: list[np.ndarray] = []


def symbols(of: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' characters in one array, ``LONG`` zeros before each, and the number of the text that each is of (-1: the zeros)."""
    if not _symbols:
        plane = [chr(i) for i in range(1 << 16)]
        _symbols.append(np.array([ord(low) if c.isalnum() and len(low := c.lower()) == 1 else 1 for c in plane], np.uint32))
    pad = "\0" * LONG
    raw = np.frombuffer((pad + pad.join(of)).encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum(np.array([len(x) + LONG for x in of]))
    number = np.repeat(np.arange(len(of)), [len(x) + LONG for x in of])
    begins = np.concatenate([[0], ends[:-1]])
    number[(begins[:, None] + np.arange(LONG)).ravel()] = -1
    made = np.where(raw < 1 << 16, _symbols[0][np.minimum(raw, (1 << 16) - 1)], raw)
    made[number < 0] = 0
    keep = np.ones(len(made), bool)
    keep[1:] = (made[1:] != 1) | (made[:-1] > 1)
    return made[keep], number[keep]


def _mixed(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h ^ c) * _MIX
    return h ^ (h >> np.uint64(31))


@dataclass
class Grams:
    """For each character of some texts: the keys of its gram and context, of the short ones, of its short gram with the character before, and its text's number."""

    gram: np.ndarray
    context: np.ndarray
    short: np.ndarray
    above: np.ndarray
    before: np.ndarray
    number: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Grams:
        made, number = symbols(texts)
        wide = made.astype(np.uint64) * _MIX
        place = np.arange(len(made))
        begun = np.maximum.accumulate(np.where(made <= 1, place, 0))
        depth = place - np.concatenate([[0], begun[:-1]])[: len(made)]  # 1 for the first character of a word
        depth[number < 0] = 0
        whole = np.zeros(len(made), np.uint64)
        for k in range(2, LONG + 1):
            at = np.flatnonzero(depth == k)
            whole[at] = _mixed(whole[at - 1], wide[at - 1])
        at = np.flatnonzero(depth > LONG)
        for back in range(LONG - 1, 0, -1):
            whole[at] = _mixed(whole[at], wide[at - back])
        at = np.flatnonzero((depth >= 1) & ((depth > 1) | (made > 1)))
        h, c = whole[at], wide[at]
        v = np.zeros(len(at), np.uint64)
        for back in range(1, SHORT + 1):
            v = _mixed(v, wide[at - back])
        short = _mixed(v, c)
        return cls(_mixed(h, c), h, short, v, _mixed(short, wide[at - SHORT - 1]), number[at], depth[at] == 1)


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, and each place's number among them."""
    found, back = np.unique(keys, return_inverse=True)
    at = np.empty(len(found), np.int64)
    at[back] = np.arange(len(keys))
    return found, at, back


@dataclass
class Words:
    """The distinct words of some texts, with a space where something follows; for each word in the texts, its place among them and its text."""

    keys: np.ndarray
    words: list[str]
    which: np.ndarray
    number: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Words:
        made, number = symbols(texts)
        made, number = np.append(made, np.zeros(1, np.uint32)), np.append(number, -1)
        letter = made > 1
        edge = np.flatnonzero(np.diff(np.concatenate([[False], letter])))
        begin, end = edge[::2], edge[1::2]
        end = end + (made[end] == 1)
        depth = np.arange(len(made)) - np.repeat(np.append(0, begin), np.diff(np.concatenate([[0], begin, [len(made)]])))
        h = _mixed(depth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), made.astype(np.uint64))
        h = np.add.reduceat(_mixed(h, h >> np.uint64(32)), np.stack([begin, end], axis=1).ravel())[::2] if len(begin) else np.zeros(0, np.uint64)
        keys, at, which = _unique(h)
        size = (end - begin)[at]
        to = np.cumsum(size)
        spelled = made[np.arange(to[-1] if len(to) else 0) + np.repeat(begin[at] - to + size, size)]
        text = np.where(spelled == 1, 32, spelled).astype("<u4").tobytes().decode("utf-32-le", "replace")
        return cls(keys, [text[b - n : b] for b, n in zip(to.tolist(), size.tolist(), strict=True)], which, number[begin])


#: Counts of a word or gram: in all documents, in each class without the curve's rows, and in those.
COUNTS = ["a", "c0", "c1", "h0", "h1"]
_LONGS = ", ".join(f"{c} bigint" for c in COUNTS)


def _add(parts: list[list]) -> list:
    """Rows of one key (first) added up: what the key has besides, then counts."""
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    key, at, back = _unique(columns[0])
    return [key, *(c[at] for c in columns[1 : -len(COUNTS)]), *(np.bincount(back, c, len(key)).astype(np.int64) for c in columns[-len(COUNTS) :])]


def _held(made: Iterator[list], names: list[str], first: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows added up by their keys, as many as fit; columns from ``first`` on are given."""
    held: list[list] = []

    def given() -> Iterator[pa.RecordBatch]:
        rows = _add(held) if held else [[]]
        held.clear()
        for at in range(0, len(rows[0]), SPELLED):
            part = [r[at : at + SPELLED] for r in rows[first:]]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in part], names)

    for rows in made:
        held.append(rows)
        if sum(len(r[0]) for r in held) > HELD:
            yield from given()
    yield from given()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[list]:
        for batch in pieces(batches):
            w = Words.of(texts(batch))
            kind = np.array([-1 if v is None else v for v in batch.column("kind").to_pylist()], np.int64)[w.number]
            yield [w.keys, np.array(w.words, object), *(np.bincount(w.which[of], minlength=len(w.keys)) for of in (slice(None), *(kind == k for k in range(4))))]

    return _held(rows(), ["word", *COUNTS], 1)


def _labels(labels: DataFrame, keep) -> DataFrame:
    """``_key, kind``: 0 and 1 are the classes, 2 and 3 those of the rows kept for the curve."""
    rows = labels.select(F.col("doc_id").alias("_key"), F.col("toxic").cast("double").alias("_y")).where(F.col("_y").isNotNull() & F.col("_key").isNotNull() & keep(F.col("_key")))
    rows = rows.groupBy("_key").agg(F.avg("_y").alias("_y"))
    return rows.select("_key", ((F.col("_y") >= 0.5).cast("int") + 2 * _for_curve(F.col("_key")).cast("int")).alias("kind"))


def _for_curve(key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), key), F.lit(FOLDS)) == 0


def words(docs: DataFrame, labels: DataFrame, keep) -> DataFrame:
    """``word`` and its counts over all documents; ``keep`` picks the keys that labels are learnt from."""
    bounded_batches(docs.sparkSession)
    rows = _labels(labels, keep)
    # labels are a few bytes a row: they are brought to the texts where they are few, and else both are dealt by key
    few = rows.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    labelled = docs.select("doc_id", "text").join(F.broadcast(rows) if few else rows, F.col("doc_id") == F.col("_key"), "left").select("text", "kind")
    return labelled.mapInArrow(_count_words, f"word string, {_LONGS}").groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS))


def _word_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to some SPELLED rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= SPELLED:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    yield from pa.Table.from_batches(held).combine_chunks().to_batches() if held else ()


def spell(of: pa.RecordBatch) -> list[np.ndarray]:
    """The grams of counted words, added up: gram, context, short gram, and the counts."""
    g = Grams.of(of.column("word").to_pylist())
    return _add([[g.gram, g.context, g.short, *(of.column(c).to_numpy()[g.number] for c in COUNTS)]])


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _held(map(spell, _word_parts(batches)), ["gram", "context", "short", *COUNTS])


def _shorts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct short grams with the character before, and their contexts."""
    met = np.zeros(0, np.uint64)
    for batch in _word_parts(batches):
        g = Grams.of(batch.column("word").to_pylist())
        key, at, _ = _unique(g.before)
        new = ~np.isin(key, met)
        met = np.union1d(met, key) if len(met) < HELD else key
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key[new], g.short[at[new]], g.above[at[new]])], ["before", "short", "above"])


def _share(before, total):
    """The short model's share; each of 64 characters that may follow is taken to have a tenth of a neighbour besides."""
    return (before + 0.1) / (total + 6.4)


def shares(of: DataFrame) -> DataFrame:
    """``short, share`` of each short gram of the words: its part in the distinct characters before all of its context."""
    rows = of.select("word").mapInArrow(_shorts, "before bigint, short bigint, above bigint").distinct()
    rows = staged(rows.groupBy("short", "above").agg(F.count("*").alias("n")))
    totals = rows.groupBy("above").agg(F.sum("n").alias("total"))
    return rows.join(totals, "above").select("short", _share(F.col("n"), F.col("total")).alias("share"))


def _places(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Where each of ``of`` stands in the ordered ``keys``; behind their end if nowhere."""
    at = np.searchsorted(keys, of)
    inside = at < len(keys)
    at[inside] = np.where(keys[at[inside]] == of[inside], at[inside], len(keys))
    return at


def _backed(n: np.ndarray, begins: np.ndarray, p: np.ndarray, more: float) -> np.ndarray:
    """Probabilities of grams that occur ``n`` times, those of one context together, over the backoff ``p``."""
    size = np.diff(np.append(begins, len(n)))
    total, after = (np.repeat(np.add.reduceat(v, begins), size) for v in (n, n > 0)) if len(n) else (n, n)
    gained = np.maximum(n - DISCOUNT, 0)
    left = np.minimum(DISCOUNT * np.maximum(after, 1), total - gained)
    return np.where(total + more > 0, (gained + (left + more) * p) / np.maximum(total + more, 1e-9), p)


def differences(context: np.ndarray, share: np.ndarray, counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability by the toxic less that by the ordinary model of distinct grams in order of their contexts: with the curve's rows, and without."""
    begins = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
    a, c0, c1, h0, h1 = (c.astype(float) for c in counts)
    p = _backed(a, begins, share, 0.0)
    one = lambda toxic, plain: np.log(_backed(toxic, begins, p, SHARED) / _backed(plain, begins, p, SHARED))
    return one(c1 + h1, c0 + h0), one(c1, c0)


def _differ(batches: Iterator[pa.RecordBatch], known: tuple[np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """Rows come in order of their contexts, and those of a gram may be several."""
    names = ["gram", "context", "short", *([] if known else ["share"]), *COUNTS]

    def made(rows: list[np.ndarray]) -> pa.RecordBatch:
        rows = _add([rows])
        order = np.argsort(rows[1], kind="stable")
        gram, context, short, *rest = (r[order] for r in rows)
        share = np.append(known[1], 0.0)[_places(known[0], short)] if known else rest.pop(0)
        full, part = differences(context, share, rest)
        tell = (full != 0) | (part != 0)
        return pa.RecordBatch.from_arrays([pa.array(gram[tell]), pa.array(full[tell].astype(np.float32)), pa.array(part[tell].astype(np.float32))], ["gram", "full", "part"])

    held: list[np.ndarray] | None = None
    for batch in _word_parts(batches):
        rows = [batch.column(c).to_numpy() for c in names]
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
        last = np.searchsorted(rows[1], rows[1][-1])  # the last context may go on
        if last:
            yield made([r[:last] for r in rows])
        held = [r[last:] for r in rows]
    if held is not None:
        yield made(held)


@dataclass
class KneserNey:
    """``gram, full, part``: what each gram says with and without the curve's rows; the same in order of keys, if they are few; and the curve."""

    rows: DataFrame
    few: tuple[np.ndarray, np.ndarray, np.ndarray] | None
    two: bool
    curve: np.ndarray
    base: float = 0.0


def inputs(n: np.ndarray, bulk: np.ndarray, beyond: np.ndarray) -> np.ndarray:
    """What the curve weighs: the logarithms of the length and of all that goes beyond, so that it finds by which power of the length to divide."""
    return np.stack([np.ones(len(n)), np.log1p(n), bulk, np.log1p(np.maximum(n * beyond, 0))], axis=1)


def gaps(of: list[str], keys: np.ndarray, says: np.ndarray) -> np.ndarray:
    """What each word says by its grams' differences."""
    g = Grams.of(of)
    one, _, back = _unique(g.gram)
    return np.bincount(g.number, np.append(says, 0.0)[_places(keys, one)][back], len(of))


def evidence(of: list[str], keys: np.ndarray, says: np.ndarray) -> np.ndarray:
    """For each text: the number of words, and two means over them of toxic minus ordinary log-likelihood.

    The first is of what a word says within ``BULK`` either way: that follows the language and the style of a text.
    The second is of what goes beyond, the mark of single expressions.
    """
    w = Words.of(of)
    gap = gaps(w.words, keys, says)[w.which]
    bulk = np.clip(gap, -BULK, BULK)
    n = np.bincount(w.number, minlength=len(of))
    return np.stack([n, *(np.bincount(w.number, v, len(of)) / np.maximum(n, 1) for v in (bulk, gap - bulk))], axis=1)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct words and how often it has them, with the number of its words."""
    for batch in pieces(batches):
        w = Words.of(texts(batch))
        pair, n = np.unique(w.number * len(w.words) + w.which, return_counts=True)
        number, word = pair // max(1, len(w.words)), pair % max(1, len(w.words))
        size = np.bincount(w.number, minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(number)), batch.column("twin").take(pa.array(number)), pa.array(size[number]), pa.array(w.words, pa.string()).take(pa.array(word)), pa.array(n)], ["doc_id", "twin", "size", "word", "times"])


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _word_parts(batches):
        g = Grams.of(batch.column("word").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("word").take(pa.array(g.number)), pa.array(g.gram.view(np.int64))], ["word", "gram"])


def _joined_evidence(docs: DataFrame, rows: DataFrame, says: str) -> DataFrame:
    """``evidence`` by joins, for more differences than are broadcast."""
    told = docs.withColumn("twin", F.xxhash64("text"))
    bags = staged(told.select("doc_id", "twin", "text").mapInArrow(_bags, "doc_id bigint, twin bigint, size bigint, word string, times bigint"))
    met = staged(bags.groupBy("word").agg(F.count("*").alias("n")))
    grams = staged(met.select("word").mapInArrow(_grams_of, "word string, gram bigint"))
    found = staged(rows.select("gram", F.col(says).cast("double").alias("says")).join(grams.groupBy("gram").agg(F.count("*").alias("n")), "gram"))
    sums = split_join(grams, found, "gram").groupBy("word").agg(F.sum("says").alias("gap"))
    gap = F.coalesce(F.col("gap"), F.lit(0.0))
    bulk = F.least(F.greatest(gap, F.lit(-BULK)), F.lit(BULK))
    of = split_join(bags, staged(met.join(sums, "word", "left").select("word", "n", bulk.alias("bulk"), (gap - bulk).alias("beyond"))), "word")
    # equal rows of one key add up alike
    means = of.groupBy(F.col("doc_id").alias("_id"), F.col("twin").alias("_twin")).agg(F.max("size").alias("n"), *((F.sum(F.col(c) * F.col("times")) / F.sum("times")).alias(c) for c in ("bulk", "beyond")))
    out = told.drop("text").join(means, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("twin") == F.col("_twin")), "left")
    return out.drop("_id", "_twin", "twin").fillna(0, ["n", "bulk", "beyond"])


def _evidence(docs: DataFrame, model: KneserNey, part: bool) -> DataFrame:
    """``n, bulk, beyond`` of each row of ``docs``, whose columns are a key, a text and at most a number y."""
    bounded_batches(docs.sparkSession)
    if model.few is None:
        return _joined_evidence(docs, model.rows, "part" if part else "full")
    shared = docs.sparkSession.sparkContext.broadcast((model.few[0], model.few[2 if part else 1]))  # FEW_GRAMS rows at most
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = evidence(texts(batch), *shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(found[:, 0].astype(np.int64)), pa.array(found[:, 1]), pa.array(found[:, 2])], [*others, "n", "bulk", "beyond"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in others)
    return docs.mapInArrow(run, f"{kinds}, n bigint, bulk double, beyond double")


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, *, keep=lambda key: F.lit(True), sample: int = SAMPLE, few_grams: int = FEW_GRAMS, few_shorts: int = FEW_SHORTS) -> KneserNey:
    counted = staged(words(docs, labels, keep))
    share = shares(counted)
    table = share.limit(few_shorts + 1).toArrow()
    rows = counted.mapInArrow(_spell, f"gram bigint, context bigint, short bigint, {_LONGS}")
    known = None
    if table.num_rows <= few_shorts:
        key, at, _ = _unique(table["short"].to_numpy())
        known = (key, table["share"].to_numpy()[at])
    else:
        rows = rows.join(share, "short")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "context").sortWithinPartitions("context")
    rows = staged(rows.mapInArrow(lambda batches: _differ(batches, known), "gram bigint, full float, part float"))
    few = None
    if rows.count() <= few_grams:
        table = rows.toArrow()
        order = np.argsort(table["gram"].to_numpy().view(np.uint64))
        few = tuple(table[c].to_numpy()[order].view(np.uint64) if c == "gram" else table[c].to_numpy()[order] for c in ("gram", "full", "part"))
    seen = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS)).first()
    model = KneserNey(rows, few, bool(seen["c0"] and seen["c1"]), np.zeros(4))
    of = training_rows(docs, labels, "toxic", lambda key: keep(key) & _for_curve(key), sample)
    # a key that stands on several rows gives one of them, so that the bound holds
    names = ["n", "bulk", "beyond"]
    found = _evidence(of.select("doc_id", "y", "text"), model, True).groupBy("doc_id").agg(F.min(F.struct(*names, "y")).alias("r")).select("doc_id", "r.*").toArrow()
    order = np.argsort(found["doc_id"].to_numpy(), kind="stable")
    y = (found["y"].to_numpy()[order] >= 0.5).astype(float)
    model.two = model.two and bool(0 < y.sum() < len(y))
    if model.two:
        model.curve = _curve(inputs(*(found[k].to_numpy()[order].astype(float) for k in names)), y)
    elif seen["c0"] or seen["c1"] or len(y):
        both = _labels(labels, keep).join(docs.select(F.col("doc_id").alias("_key")).distinct(), "_key", "left_semi").agg(F.avg((F.col("kind") % 2).cast("double"))).first()[0]
        model.base = float(both or 0.0)
    return model


def score(docs: DataFrame, model: KneserNey, *, text: str = "text") -> DataFrame:
    """``doc_id, n_words, bulk, beyond, score`` of every whole text."""
    found = _evidence(docs.select("doc_id", F.col(text).alias("text")), model, False)
    terms = [F.lit(1.0), F.log1p("n"), F.col("bulk"), F.log1p(F.greatest(F.col("n") * F.col("beyond"), F.lit(0.0)))]  # as in inputs
    z = sum((t * float(w) for t, w in zip(terms, model.curve, strict=True)), F.lit(0.0))
    made = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0)))) if model.two else F.lit(model.base)
    return found.select("doc_id", F.col("n").alias("n_words"), "bulk", "beyond", made.alias("score"))


def classify(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, threshold: float = THRESHOLD, few_grams: int = FEW_GRAMS, few_shorts: int = FEW_SHORTS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the evidence of every document."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    model = train(docs, labels, keep=lambda key: ~held_out(key, 3, 1), sample=sample, few_grams=few_grams, few_shorts=few_shorts)
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id"), 3, 1), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_words", "bulk", "beyond")


def counts(docs: DataFrame, labels: DataFrame, keep) -> dict[str, np.ndarray]:
    """All grams of a small corpus, in order of their keys, with their contexts and counts: what the models are made of."""
    of = pa.Table.from_batches(words(docs, labels, keep).toArrow().to_batches()).combine_chunks()
    gram, context, _, a, c0, c1, h0, h1 = spell(of.to_batches()[0])
    return {"gram": gram, "context": context, "a": a, "0": c0 + h0, "1": c1 + h1}
