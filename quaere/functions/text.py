"""Text as Column expressions: tokens, stems, terms, titles, snippets.

The stem is one SQL expression that Spark and other engines read alike.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed pattern of a token: ASCII letters and digits, with inner apostrophes and hyphens.
TOKEN = r"[A-Za-z0-9]+(?:['’\-][A-Za-z0-9]+)*"

#: Fixed word list: what is dropped before matching.
STOPWORDS = """
a about above after again against all am an and any are aren't as at be because been before being below between both but by
can cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't
have haven't having he her here hers herself him himself his how i if in into is isn't it its itself just me more most
mustn't my myself no nor not of off on once only or other ought our ours ourselves out over own same shan't she should
shouldn't so some such than that the their theirs them themselves then there these they this those through to too under until
up very was wasn't we were weren't what when where which while who whom why with won't would wouldn't you your yours yourself
yourselves
""".split()

#: Fixed word list: question words, kept on request.
QUESTION_WORDS = "who whom whose what which when where why how many much long".split()

#: Fixed suffix tables, in order: what is cut off, what is put there, and the least length of the result.
MORPHS = [("isations", "is"), ("izations", "iz"), ("isation", "is"), ("ization", "iz"), ("ising", "is"), ("izing", "iz"), ("ised", "is"), ("ized", "iz"), ("ises", "is"), ("izes", "iz"), ("ise", "is"), ("ize", "iz")]
PLURALS = [("ies", "y"), ("sses", "ss"), ("shes", "sh"), ("ches", "ch"), ("xes", "x")]
ENDINGS = ["ingly", "edly", "ing", "ed", "ly"]
KEEP_S = ["ss", "us", "is", "as", "os"]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def quoted(words: list[str]) -> str:
    """A list of SQL string literals."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def stem_sql(x: str) -> str:
    """The stem of the lower-case token ``x`` as an SQL expression."""
    rules = [(s, r, 4) for s, r in MORPHS] + [(s, r, 3) for s, r in PLURALS] + [(s, "", 4) for s in ENDINGS]
    cases = "".join(f" WHEN right({x}, {len(s)}) = '{s}' AND length({x}) >= {least - len(r) + len(s)} THEN substr({x}, 1, length({x}) - {len(s)}) || '{r}'" for s, r, least in rules)
    return f"CASE WHEN length({x}) <= 3 OR translate({x}, '0123456789', '') <> {x} THEN {x}{cases} WHEN right({x}, 1) = 's' AND right({x}, 2) NOT IN ({quoted(KEEP_S)}) THEN substr({x}, 1, length({x}) - 1) ELSE {x} END"


def tokens(text: Column, *, lower: bool = True) -> Column:
    """Tokens in order; matched first and lower-cased after."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.transform(found, F.lower) if lower else found


def stem(token: Column) -> Column:
    # a lambda over one element lets the SQL text name its argument
    return F.element_at(F.call_function("transform", F.array(token), F.expr(f"t -> {stem_sql('t')}")), 1)


def analyze(text: Column, *, stopwords: bool = True, stemmed: bool = True, keep_question_words: bool = False) -> Column:
    """Terms of a text, for index and query alike: tokens without stopwords, stemmed."""
    dropped = sorted(set(STOPWORDS) - (set(QUESTION_WORDS) if keep_question_words else set()))
    out = tokens(text)
    if stopwords:
        # apostrophes double in SQL text
        out = F.filter(out, lambda t: ~t.isin(dropped))
    if stemmed:
        out = F.call_function("transform", out, F.expr(f"t -> {stem_sql('t')}"))
    return F.filter(out, lambda t: t != "")


def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalise(text: Column) -> Column:
    """Canonical Unicode and white space.  Only texts beyond ASCII reach Python, for which Spark has no NFKC; others are sent as nulls."""
    nfkc = F.coalesce(F.pandas_udf(_nfkc, "string")(F.when(F.regexp_like(text, F.lit(r"[^\x00-\x7F]")), text)), text)
    out = F.regexp_replace(nfkc, "\r\n?", "\n")
    out = F.regexp_replace(out, "[ \t\u00a0]+", " ")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    return stripped(out)


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def flattened(text: Column) -> Column:
    """Each run of white space one space, none at the ends."""
    return stripped(F.regexp_replace(text, r"(?U)\s+", " "))


def shortened(text: Column, limit: int) -> Column:
    """At most ``limit`` code points, an ellipsis at the end where some are cut off."""
    cut = F.regexp_replace(F.substring(text, 1, limit - 1), r"(?U)\s+$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("…")))


def slug(filename: Column) -> Column:
    """An identifier from a file's stem."""
    made = F.btrim(F.regexp_replace(F.lower(file_stem(filename)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(made == "", F.lit("doc")).otherwise(made)


def file_stem(filename: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(filename, "^.*/", ""), r"(?<=.)\.[^.]*$", "")


def title(text: Column, filename: Column) -> Column:
    """The first heading near the top, else the first line with words, else the file's name."""
    heading = F.nullif(stripped(F.regexp_extract(F.substring(text, 1, 400), r"(?m)^#\s+(.+?)\s*$", 1)), F.lit(""))
    line = F.nullif(F.substring(stripped(F.regexp_extract(text, r"(?m)^[ \t]*#*[ \t]*([^#\s].*)$", 1)), 1, 120), F.lit(""))
    return F.coalesce(heading, line, F.initcap(F.translate(file_stem(filename), "_-", "  ")))


def preview(text: Column, limit: int = 180) -> Column:
    """The beginning of the body, without its heading."""
    body = F.regexp_replace(text, r"\A#\s+(.+?)[ \t]*(?:\n\s*|\z)", "")
    return shortened(flattened(body), limit)


def snippet(text: Column, limit: int = 240) -> Column:
    """A passage for display, without marks of headings."""
    flat = F.array_join(F.filter(F.split(flattened(text), " "), lambda w: F.btrim(w, F.lit("#")) != ""), " ")
    return shortened(F.replace(flat, F.lit("# "), F.lit("")), limit)


def mark_answer(text: Column, answer: Column) -> Column:
    """Escaped for HTML, the first occurrence of the answer marked."""

    def escaped(x: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    whole, part = escaped(text), escaped(answer)
    at = F.position(part, whole)
    marked = F.concat(F.substring(whole, F.lit(1), at - 1), F.lit("<mark>"), part, F.lit("</mark>"), F.substring(whole, at + F.length(part), F.length(whole)))
    return F.when((part == "") | (at == 0), whole).otherwise(marked)
