"""Sentences, windows and terms of one text in plain Python, for workers that go over whole collections.

Twins of the expressions in `spans`, `text` and ``operators.passages``; a test holds them against each other.
"""

from __future__ import annotations

import re
import unicodedata

from ..params import DEFAULTS, Params
from .spans import ABBREVIATIONS, CANDIDATE
from .text import ENDINGS, KEEP_S, MORPHS, PLURALS, STOPWORDS, TOKEN

#: What ``(?U)\s`` matches; Python's own class has four control characters more.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_CANDIDATE = re.compile(CANDIDATE.replace(r"(?U:\s)", f"[{SPACE}]"))
_TOKEN = re.compile(TOKEN)
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz."
_LINE_END = re.compile("(?:\r\n|[\n\r\x85\u2028\u2029])\\Z")
_SHORT, _STOP, _DIGIT = frozenset(ABBREVIATIONS), frozenset(STOPWORDS), re.compile("[0-9]")
_SUFFIXES = [(s, r, 4 - len(r) + len(s)) for s, r in MORPHS] + [(s, r, 3 - len(r) + len(s)) for s, r in PLURALS] + [(s, "", 4 + len(s)) for s in ENDINGS]
#: Characters before a period that are looked at first.
_NEAR = 64


def _last_word(core: str) -> str:
    run = core[len(core.rstrip(_LETTERS)) :]
    return run.lstrip(".")


def _abbreviated(text: str, first: int, end: int) -> bool:
    """Whether the part of a text before a period ends in an abbreviation or an initial."""
    core = text[max(first, end - _NEAR) : end]
    core = _LINE_END.sub("", core, count=1)
    if len(core) >= _NEAR - 2 and not core.strip(_LETTERS):
        core = _LINE_END.sub("", text[first:end], count=1)
    word = _last_word(core)
    return word.lower().rstrip(".") in _SHORT or len(word) == 1 and word.isupper()


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Places of the sentences in order, as ``spans.sentences`` has them."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    first = piece = 0

    def add(end: int) -> None:
        s = text[first:end]
        last = first + len(s.rstrip(SPACE))
        start = end - len(s.lstrip(SPACE))
        if last > start:
            out.append((start, last))

    for m in _CANDIDATE.finditer(text):
        at, end = m.span()
        if end == len(text):
            break
        after = text[end]
        goes_on = after in "ªº" or unicodedata.category(after) == "Ll"
        if text.count("\n", at, end) > 1 or not (goes_on or _abbreviated(text, piece, at)):
            add(end)
            first = end
        piece = end
    add(len(text))
    return out


def windows(spans: list[tuple[int, int]], params: Params = DEFAULTS) -> list[tuple[int, int]]:
    """The first sentence of each window and the one after its last, as ``passages.windows`` has them."""
    n, w, s = len(spans), params.window, params.stride
    made = [(p, min(p + w, n)) for p in range(0, n, s) if p == 0 or p - s + w < n]
    return [(a, b) for a, b in made if spans[b - 1][1] - spans[a][0] >= params.min_passage_chars] or made[-1:]


def stem(x: str) -> str:
    if len(x) <= 3 or _DIGIT.search(x):
        return x
    for suffix, put, least in _SUFFIXES:
        if len(x) >= least and x.endswith(suffix):
            return x[: -len(suffix)] + put
    return x[:-1] if x[-1] == "s" and x[-2:] not in KEEP_S else x


class Codes(dict):
    """The number of each token's term: -2 of a token that is no term, -1 of a term that isn't asked for.  Tokens are stemmed once."""

    #: Tokens that are kept at most.
    MOST = 400_000

    def __init__(self, asked: dict[str, int]) -> None:
        super().__init__()
        self.asked = asked

    def __missing__(self, token: str) -> int:
        low = token.lower()
        term = None if low in _STOP else stem(low)
        code = self.asked.get(term, -1) if term else -2
        if len(self) >= self.MOST:
            self.clear()
        self[token] = code
        return code

    def of(self, text: str, start: int, end: int) -> list[int]:
        return list(map(self.__getitem__, _TOKEN.findall(text, start, end)))
