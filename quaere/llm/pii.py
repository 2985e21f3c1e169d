"""Personal data by weak supervision.

Candidates are spans found by patterns: the base pattern of each kind, and looser ones
(bracketed e-mail addresses, national phone numbers, card-like numbers that fail their
check digit, IPv6 addresses).  Labelers vote on each candidate, for, against or not at all:

* check: the kind's own rule (digits, Luhn, parts of an address);
* shape: how it is grouped, and whether it goes on at either end;
* gazetteer: top-level domains, calling codes, card issuers, reserved address blocks;
* context: cue words, and words that speak of something else, in the text just before.

How often each pattern of votes occurs is counted over all documents; the patterns are
few, whatever the input (``MOST_PATTERNS``).  Expectation-maximisation over these counts
estimates, per kind, each labeler's rates for true and for false spans and the share of true
ones; a logistic classifier over the votes is then trained on the resulting posteriors, again
by pattern.  A looser candidate whose probability reaches ``THRESHOLD`` is added, unless its check votes
against it (a card that fails Luhn) or it overlaps a base span or an added one before it; base spans that pass their
rule always stay.

All work on texts is Column expressions; only counts of vote patterns come to the driver.
Patterns start only where a run of their characters starts (or a match has ended) and don't
backtrack into runs, so that long runs cost no more than their length.

Results: null and empty texts have no spans; equal texts have equal spans; columns besides the
key and the text are ignored.  Places count code points, ends are exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

KINDS = ("email", "ip", "card", "phone")

#: The base patterns: each finds what the plain one beside it finds, without rescanning.
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({]at[\])}] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[({]dot[\])}]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:.])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: What a text must hold for a pattern to match: a cheap test.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}

#: Fixed lists of the labelers: top-level domains, calling codes, issuers' first digits.
DOMAINS = ["com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "de", "fr", "es", "it", "nl", "uk", "us", "ca", "eu", "ch", "at", "be", "se", "no", "dk", "fi", "pl", "pt", "ru", "jp", "cn", "in", "br", "au", "mx"]
CALLING = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35)"
RESERVED = r"^(?:0|10|127|255|2(?:2[4-9]|3[0-9])|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|169\.254)\."
CUES = {"email": r"(?i)\b(?:e-?mail|mailto|contact|write to)\b", "ip": r"(?i)\b(?:ip|address|host|server|ping)\b", "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|payment)\b", "phone": r"(?i)\b(?:phone|tel|call|mobile|cell|fax|contact)\b"}
AGAINST = {"email": r"(?i)\b(?:example|sample)\b", "ip": r"(?i)\b(?:version|release|v|section|chapter)\b", "card": r"(?i)\b(?:isbn|order|invoice|serial|id|number|token)\b", "phone": r"(?i)\b(?:isbn|score|line|page)\b"}
#: Code points before a candidate that the context labeler sees.
CONTEXT = 32

LABELERS = ("check", "shape", "gazetteer", "context")
MOST_PATTERNS = len(KINDS) * 2 * 3 ** len(LABELERS)
THRESHOLD = 0.5
#: Lengths that are added up in one go.
_BLOCK = 256


def _running(lengths: Column) -> Column:
    """Sums of all that comes before, block by block, so that many matches of one text don't cost their square."""

    def of(x: Column) -> Column:
        n = F.size(x)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: F.slice(x, b * _BLOCK + 1, F.lit(_BLOCK)))

        def before(values: Column) -> Column:
            start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))
            return F.aggregate(values, start, lambda a, v: F.named_struct(F.lit("sum"), a["sum"] + v, F.lit("all"), F.concat(a["all"], F.array(a["sum"]))))["all"]

        def joined(bs: Column) -> Column:
            totals = before(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda a, v: a + v)))
            return let(totals, lambda t: F.flatten(F.transform(bs, lambda b, k: let(F.get(t, k), lambda base: F.transform(before(b), lambda v: v + base)))))

        return let(blocks, joined)

    return let(lengths, of)


def found(text: Column, pattern: str) -> Column:
    """``array<struct<s,at>>``: the leftmost non-overlapping matches and where they begin."""
    none = F.array().cast("array<struct<s:string,at:int>>")

    def placed(matches: Column) -> Column:
        pieces = F.split(text, F.lit(pattern), -1)
        # what lies before the k-th match: the pieces up to it and the matches before it
        lengths = let(pieces, lambda p: F.transform(matches, lambda m, k: F.length(F.get(p, k)) + F.length(m)))
        ends = let(lengths, lambda x: F.zip_with(_running(x), x, lambda a, b: a + b))
        return F.when(F.size(matches) == 0, none).otherwise(F.zip_with(matches, ends, lambda m, e: F.named_struct(F.lit("s"), m, F.lit("at"), e - F.length(m))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    """Whether the digits' check digit is right."""

    def value(i: Column) -> Column:
        v = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, v).otherwise(F.when(v > 4, 2 * v - 9).otherwise(2 * v))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(d) - 1), value), F.lit(0), lambda a, v: a + v) % 10 == 0


def passes(kind: str, s: Column) -> Column:
    """The base rule of a kind."""
    if kind == "ip":
        return F.regexp_like(s, F.lit(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"))
    if kind == "card":
        return let(_digits(s), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, F.lit(1))
    return (out.when(no, F.lit(-1)) if no is not None else out).otherwise(F.lit(0))


def _votes(kind: str, s: Column, before: Column, after: Column, base: Column) -> list[Column]:
    """The labelers' votes, in their order, for a candidate and the text around it."""
    like = lambda x, p: F.regexp_like(x, F.lit(p))
    ok = passes(kind, s)
    goes_on = like(before, r"[0-9.]$") | like(after, r"^[.-]?[0-9]")
    if kind == "email":
        last = F.lower(F.regexp_extract(s, r"([A-Za-z0-9-]+)$", 1))
        votes = [_vote(base), _vote(like(s, r"^[A-Za-z0-9]"), like(s, r"^[.%+-]+[@\[({ ]")), _vote(last.isin(DOMAINS), ~last.isin(DOMAINS))]
    elif kind == "ip":
        votes = [_vote(ok & base, base & ~ok), _vote(~goes_on, goes_on), _vote(base & ~like(s, RESERVED), like(s, RESERVED))]
    elif kind == "card":
        grouped = like(s, r"^[0-9]{13,19}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$|^3[0-9]{3}([ -])[0-9]{6}\2[0-9]{5}$")
        votes = [_vote(ok, ~ok), _vote(grouped & ~goes_on, ~grouped | goes_on), _vote(like(_digits(s), ISSUERS), ~like(_digits(s), ISSUERS))]
    else:
        grouped = like(s, r"[ .-][0-9]{3}[ .-][0-9]{4}$|[ ).-][0-9]{2,4}[ .-][0-9]{2,4}$")
        votes = [_vote(base & ok, base & ~ok), _vote(grouped, goes_on), _vote(like(s, CALLING), base & ~like(s, CALLING))]
    return [*votes, _vote(like(before, CUES[kind]), like(before, AGAINST[kind]))]


def _one(body, *rest):
    """A function of one column, as higher-order functions want it."""
    return lambda x: body(x, *rest)


def candidates(text: Column) -> Column:
    """``array<struct<kind,at,until,base,stays,votes>>``: kind is a place in KINDS, ``stays`` marks base spans that pass."""
    parts = []
    for k, kind in enumerate(KINDS):
        for base, patterns in ((True, BASE), (False, LOOSE)):
            if kind not in patterns:
                continue
            hint = HINTS[kind] if base else ""
            spans = found(text, patterns[kind])
            if kind == "card":
                # a number that isn't of a card's length is no candidate at all
                spans = F.filter(spans, lambda x: F.length(_digits(x["s"])).between(13, 19))

            def told(x: Column, k: int, kind: str, base: bool) -> Column:
                s, at = x["s"], x["at"]
                start = F.greatest(at - CONTEXT, F.lit(0))
                before, after = F.substring(text, start + 1, at - start), F.substring(text, at + F.length(s) + 1, F.lit(2))
                votes = F.array(*_votes(kind, s, before, after, F.lit(base)))
                return F.named_struct(F.lit("kind"), F.lit(k), F.lit("at"), at, F.lit("until"), at + F.length(s), F.lit("base"), F.lit(base), F.lit("stays"), passes(kind, s) & F.lit(base), F.lit("votes"), votes)

            made = F.transform(spans, _one(told, k, kind, base))
            none = F.array().cast("array<struct<kind:int,at:int,until:int,base:boolean,stays:boolean,votes:array<int>>>")
            test = F.contains(text, F.lit(hint)) if hint else F.regexp_like(text, F.lit({"card": r"[0-9][\x20-]?[0-9]", "email": r"[\[({]at[\])}]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]", "phone": r"[0-9][ .-][0-9]{4}"}[kind]))
            parts.append(F.when(test, made).otherwise(none))
    return F.concat(*parts)


def _with_candidates(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", let(F.coalesce("text", F.lit("")), candidates).alias("c"))


def patterns(docs: DataFrame) -> list[tuple[int, bool, tuple[int, ...], int]]:
    """Kind, base or not, votes and number of all candidates."""
    rows = _with_candidates(docs).select(F.explode("c").alias("c")).groupBy("c.kind", "c.base", "c.votes").count()
    return sorted((r["kind"], r["base"], tuple(r["votes"]), r["count"]) for r in rows.collect())  # MOST_PATTERNS rows at most


@dataclass
class SpanModel:
    """Per kind: rates of the labelers' votes for true and false spans, the share of true ones, and the classifier's weights."""

    rates: np.ndarray
    share: np.ndarray
    weights: np.ndarray

    def probability(self, kind: int, votes: tuple[int, ...]) -> float:
        x = np.concatenate([[1.0], _inputs(np.array([votes]))[0]])
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[kind], -30, 30))))


def _inputs(votes: np.ndarray) -> np.ndarray:
    """A number for each labeler and each side it takes."""
    return np.concatenate([votes == 1, votes == -1], axis=1).astype(float)


def fit(rows: list[tuple[int, bool, tuple[int, ...], int]], *, rounds: int = 100) -> SpanModel:
    """Expectation-maximisation and then the classifier, over counted vote patterns."""
    m = len(LABELERS)
    model = SpanModel(np.zeros((len(KINDS), 2, m, 3)), np.full(len(KINDS), 0.5), np.zeros((len(KINDS), 1 + 2 * m)))
    for k in range(len(KINDS)):
        own = [r for r in rows if r[0] == k]
        # labelers start as better than chance; the prior counts keep rare votes from certainty
        prior = np.stack([np.tile([1.0, 2.0, 4.0], (m, 1)), np.tile([4.0, 2.0, 1.0], (m, 1))])[::-1]  # false first: for is rare
        rates = prior / prior.sum(axis=2, keepdims=True)
        share = 0.5
        votes = np.array([r[2] for r in own]).reshape(-1, m)
        n = np.array([r[3] for r in own], float)
        p = np.zeros(len(own))
        for _ in range(rounds if own else 0):
            ll = np.stack([np.log(rates[c][np.arange(m), votes + 1]).sum(axis=1) for c in (0, 1)], axis=1) + np.log([1 - share, share])
            p = 1 / (1 + np.exp(np.clip(ll[:, 0] - ll[:, 1], -30, 30)))
            share = float((n @ p + 1) / (n.sum() + 2))
            for c, weight in ((0, n * (1 - p)), (1, n * p)):
                got = np.stack([[weight[votes[:, j] == v].sum() for v in (-1, 0, 1)] for j in range(m)])
                rates[c] = (got + prior[c]) / (got + prior[c]).sum(axis=1, keepdims=True)
        model.rates[k], model.share[k] = rates, share
        if own:
            model.weights[k] = _logistic(np.concatenate([np.ones((len(own), 1)), _inputs(votes)], axis=1), p, n)
        else:
            model.weights[k, 0] = -30.0
    return model


def _logistic(x: np.ndarray, p: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels ``p``, each row counting ``n`` times."""
    w = np.zeros(x.shape[1])
    n = n * min(1.0, 1e6 / n.sum())
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (n * q * (1 - q))[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (n * (p - q)) - ridge * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _accepted(model: SpanModel, threshold: float) -> Column:
    """Keys of the vote patterns of looser candidates that the classifier takes for true spans."""
    from itertools import product

    keys = [_code(k, v) for k in range(len(KINDS)) for v in product((-1, 0, 1), repeat=len(LABELERS)) if v[0] >= 0 and model.probability(k, v) >= threshold]
    return F.lit(keys or [-1]).cast("array<int>")


def _code(kind: int, votes: tuple[int, ...]) -> int:
    code = kind
    for v in votes:
        code = code * 3 + v + 1
    return code


def detect(docs: DataFrame, *, threshold: float = THRESHOLD, model: SpanModel | None = None) -> DataFrame:
    """``doc_id, base, added``: each document's base spans and those the classifier adds, as ``array<struct<kind,at,until>>`` by kind, then place."""
    docs = docs.select("doc_id", "text")
    keys = _accepted(model or fit(patterns(docs)), threshold)

    def coded(c: Column) -> Column:
        code = c["kind"]
        for j in range(len(LABELERS)):
            code = code * 3 + F.get(c["votes"], F.lit(j)) + 1
        return code

    span = lambda c: F.named_struct(F.lit("kind"), c["kind"], F.lit("at"), c["at"], F.lit("until"), c["until"])

    def chosen(c: Column) -> Column:
        base = F.transform(F.filter(c, lambda x: x["stays"]), span)

        def both(b: Column) -> Column:
            free = F.filter(c, lambda x: ~x["stays"] & F.array_contains(keys, coded(x)) & ~F.exists(b, lambda y: (x["at"] < y["until"]) & (y["at"] < x["until"])))
            none = F.array().cast("array<struct<kind:int,at:int,until:int>>")
            apart = F.aggregate(F.transform(free, span), none, lambda a, x: F.when(F.exists(a, lambda y: (x["at"] < y["until"]) & (y["at"] < x["until"])), a).otherwise(F.concat(a, F.array(x))))
            return F.named_struct(F.lit("base"), F.array_sort(b), F.lit("added"), F.array_sort(apart))

        return let(base, both)

    rows = _with_candidates(docs)
    return rows.select("doc_id", let(F.col("c"), chosen).alias("r")).select("doc_id", "r.base", "r.added")


def _spelled(spans: Column) -> Column:
    names = F.lit(list(KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["at"].cast("string"), s["until"].cast("string"))), ",")


def _is_of(kind: int):
    return lambda s: s["kind"] == kind  # a second parameter, were there one, would be given the place in the array


def digests(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans spelled out."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    of = detect(docs)
    counts = [F.size(F.filter("base", _is_of(k))).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return of.select("doc_id", *counts, F.sha2(_spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"), _spelled(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("bigint").alias("n_added"))


def masked(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with every span replaced by its kind in angle brackets."""
    both = docs.select("doc_id", "text").join(detect(docs), "doc_id")
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.named_struct(F.lit("at"), s["at"], F.lit("until"), s["until"], F.lit("kind"), s["kind"])))
    start = F.struct(F.lit(0).alias("done"), F.lit("").alias("out"))
    names = F.lit(list(KINDS))
    step = lambda a, s: F.when(s["at"] < a["done"], a).otherwise(F.named_struct(F.lit("done"), s["until"], F.lit("out"), F.concat(a["out"], F.substring("text", a["done"] + 1, s["at"] - a["done"]), F.lit("<"), F.get(names, s["kind"]), F.lit(">"))))
    folded = let(F.aggregate(spans, start, step), lambda r: F.concat(r["out"], F.substring("text", r["done"] + 1, F.length("text"))))
    return both.select("doc_id", folded.alias("text"))
