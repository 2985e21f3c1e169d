"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a short row of numbers (shares of letter classes, word and line
shapes, repetition).  Every number is cut into quantile bins.  Boosting goes round the
features in turn: a tree of at most three leaves over one feature's bins is fitted to
the current residuals and added, shrunk, to that feature's lookup table.  The pairs of
features whose coarse grids explain most of what is left are boosted the same way, a
tree of one cut per axis at a time.  A score is a sum of looked-up numbers, so scoring
is one vectorised bin search and addition per table.

The model is fitted on the driver to at most ``sample`` labelled rows, drawn by the hash
of their key; everything is scored.

Results: null and empty texts are scored like any other (all their features are 0); equal texts
have equal scores; a key labelled more than once takes the mean label; labels without a
document and null labels are left out; without two classes every score is the base rate
(0.5 without labels).  Columns besides the key and the text are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, pieces, texts

FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "space", "stop", "comma", "bang", "bar", "symbol", "other_ascii", "high_bytes",
    "distinct_words", "distinct_pairs", "wordless", "log_lines", "line_length", "repeated_lines", "sentence_length", "short_words", "capitalised", "commonest", "long_words",
)

#: Labelled rows that the model is fitted to, at most.
SAMPLE = 20_000
#: Score from which a text is taken as good.
THRESHOLD = 0.3


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[[ord(c) for c in chars]] = 1
    return out


_CLASSES = np.stack([
    _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("0123456789"), _bytes(" \t\n\r"), _bytes(".?"), _bytes(",;:"), _bytes("!"), _bytes("|"), _bytes("#$%&*+=~^@"),
    _bytes("\"'()/<>[\\]_`{}-"), (np.arange(256) >= 128).astype(float),
], axis=1)


def features(text: str) -> list[float]:
    """The numbers of one whole text, in the order of FEATURES."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = (counts @ _CLASSES) / len(raw)
    lines = text.split("\n")
    seen = Counter(words)
    sizes = Counter(map(len, words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    stops = counts[46] + counts[63] + counts[33]
    return [
        np.log1p(len(text)), np.log1p(n), len(text) / n, *shares[:9], shares[9],
        len(seen) / n, pairs / max(1, n - 1), sum(v for w, v in seen.items() if not any(map(str.isalpha, w))) / n if shares[7] + shares[1] + shares[6] > 0 else 0.0,
        np.log1p(len(lines)), len(text) / len(lines), 1 - len(set(lines)) / len(lines), n / (stops + 1.0),
        sum(v for k, v in sizes.items() if k <= 3) / n, sum(v for w, v in seen.items() if w[0].isupper()) / n, seen.most_common(1)[0][1] / n, sum(v for k, v in sizes.items() if k >= 13) / n,
    ]


def matrix(of: list[str]) -> np.ndarray:
    return np.array([features(x) for x in of], dtype=np.float64).reshape(len(of), len(FEATURES))


@dataclass
class Additive:
    """Lookup tables: one for each feature, and a grid for each chosen pair of features."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edge, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edge, x[:, j], side="right")]
        for (a, b), grid in zip(self.pairs, self.grids, strict=True):
            total += grid[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(x)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _cut(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, int]:
    """The best place to cut a run of bins in two, and what it gains."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), _gain(gl, hl, ridge) + _gain(gr, hr, ridge) - _gain(g.sum(), h.sum(), ridge), 0)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> np.ndarray:
    """A step over the bins: three leaves at most, the second cut where it gains most."""
    runs = [(0, len(g))]
    for _ in range(2):
        found = [(*_cut(g[a:b], h[a:b], ridge, least), a, b) for a, b in runs]
        gain, at, a, b = max(found)
        if gain <= 0:
            break
        runs.remove((a, b))
        runs += [(a, a + at), (a + at, b)]
    step = np.zeros(len(g))
    for a, b in runs:
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return step


def _quarters(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """The best pair of cuts, one for each axis of a grid: the gain, and the step over the grid."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(cg.shape) < 2:
        return 0.0, np.zeros_like(g)
    parts = []
    for c in (cg, ch):
        ll = c[:-1, :-1]
        lr, rl = c[:-1, -1:] - ll, c[-1:, :-1] - ll
        parts.append((ll, lr, rl, c[-1, -1] - ll - lr - rl))
    ok = np.minimum.reduce(parts[1]) >= least
    gain = np.where(ok, sum(_gain(a, b, ridge) for a, b in zip(*parts, strict=True)) - _gain(cg[-1, -1], ch[-1, -1], ridge), 0)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    step = np.zeros_like(g)
    if gain[i, j] > 0:
        for rows in (slice(0, i + 1), slice(i + 1, None)):
            for cols in (slice(0, j + 1), slice(j + 1, None)):
                step[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
    return float(gain[i, j]), step


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 64, grid: int = 12, rounds: int = 40, pairs: int = 8, pair_rounds: int = 60, rate: float = 0.1, ridge: float = 5.0, least: float = 2.0) -> Additive:
    """Cyclic boosting on the logistic loss; ``least`` is the curvature that a leaf must hold."""
    model = Additive()
    if len(y) == 0:
        return model
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model.base = float(np.log(share / (1 - share)))
    width = x.shape[1]
    model.edges = [_edges(x[:, j], bins) for j in range(width)]
    model.coarse = [_edges(x[:, j], grid) for j in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if y.min() == y.max():
        return model
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    cell = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]
    f = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    def mains() -> None:
        nonlocal f
        for j in range(width):
            g, h = slopes()
            n = len(model.tables[j])
            step = rate * _tree(np.bincount(at[j], g, n), np.bincount(at[j], h, n), ridge, least)
            model.tables[j] += step
            f = f + step[at[j]]

    for _ in range(rounds):
        mains()
    g, h = slopes()

    def shaped(a: int, b: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
        k = cell[a] * shape[1] + cell[b]
        return k, *(np.bincount(k, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    ranked = sorted(((_quarters(*shaped(a, b, g, h)[1:], ridge, least)[0], a, b) for a, b in combinations(range(width), 2)), reverse=True)
    model.pairs = [(a, b) for gain, a, b in ranked[:pairs] if gain > 0]
    model.grids = [np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(pair_rounds):  # the cycle goes on over single features and pairs together
        mains()
        for k, (a, b) in enumerate(model.pairs):
            key, g, h = shaped(a, b, *slopes())
            step = rate * _quarters(g, h, ridge, least)[1]
            model.grids[k] += step
            f = f + step.ravel()[key]
    return model


def training_rows(docs: DataFrame, labels: DataFrame, label: str, keep, sample: int) -> DataFrame:
    """``text, y`` of at most ``sample`` labelled documents for whose key ``keep`` holds, drawn by the key's hash."""
    rows = labels.select(F.col("doc_id").alias("_key"), F.col(label).cast("double").alias("_y")).where(F.col("_y").isNotNull() & F.col("_key").isNotNull() & keep(F.col("_key")))
    rows = rows.groupBy("_key").agg(F.avg("_y").alias("_y"))
    rows = rows.join(docs.select(F.col("doc_id").alias("_key")).distinct(), "_key", "left_semi")
    rows = rows.orderBy(F.xxhash64("_key"), "_key").limit(sample)  # a top-k with a fixed bound, and so is what is broadcast
    return docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("_key")).select("doc_id", "text", F.col("_y").alias("y"))


def train(docs: DataFrame, labels: DataFrame, *, keep=lambda key: F.lit(True), sample: int = SAMPLE) -> Additive:
    """Features are made on the executors; ``sample`` rows of numbers at most come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = matrix(texts(batch)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "y", "x"])

    bounded_batches(docs.sparkSession)
    # a key that stands on several rows gives one of them, so that the bound holds
    rows = training_rows(docs, labels, "quality", keep, sample).mapInArrow(run, "doc_id bigint, y double, x array<float>")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).select("doc_id", "r.x", "r.y").toArrow()
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    if not len(order):
        return Additive(base=0.0)
    x = np.array(rows["x"].to_pylist(), dtype=np.float32)[order].astype(np.float64)
    return fit(x, (rows["y"].to_numpy()[order] >= 0.5).astype(float))


def score(docs: DataFrame, model: Additive, *, columns: tuple[str, ...] = ("doc_id",), output: str = "score", text: str = "text") -> DataFrame:
    """``columns`` and the score of every row's whole text; nothing is shuffled."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some tables of at most 64 numbers
    kinds = [docs.schema[c] for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            # the same width of numbers as in training, so that the same text falls into the same bins
            x = matrix(texts(batch, text)).astype(np.float32).astype(np.float64)
            s = np.full(len(x), 1 / (1 + np.exp(-shared.value.base))) if not shared.value.edges else shared.value.scores(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(s)], [*columns, output])

    schema = ", ".join(f"`{k.name}` {k.dataType.simpleString()}" for k in kinds) + f", `{output}` double"
    return docs.select(*dict.fromkeys([*columns, text])).mapInArrow(run, schema)


def held_out(key, folds: int, fold: int):
    """Rows that no label is learnt from: crc32 of the key as text, modulo ``folds``."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)) == fold


def classify(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    model = train(docs, labels, keep=lambda key: ~held_out(key, 5, 0), sample=sample)
    return score(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id"), 5, 0), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches ``threshold``, with all their columns."""
    model = train(docs, labels, keep=lambda key: ~held_out(key, 5, 0), sample=sample)
    name = "_score"
    while name in docs.columns:
        name += "_"
    return score(docs, model, columns=tuple(docs.columns), output=name).where(F.col(name) >= threshold).drop(name)
