"""Places of matches and of sentences, as Column expressions.  Places count code points, from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Lengths that are added up in one go.
_BLOCK = 256


def running_sum(lengths: Column) -> Column:
    """The sum of all elements before each, block by block: no quadratic cost in long arrays."""

    def before(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))
        step = lambda a, v: F.named_struct(F.lit("sum"), a["sum"] + v, F.lit("all"), F.concat(a["all"], F.array(a["sum"])))
        return F.aggregate(values, start, step)["all"]

    def of(x: Column) -> Column:
        last = F.floor((F.size(x) - 1) / _BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(x, b * _BLOCK + 1, F.lit(_BLOCK)))

        def joined(bs: Column) -> Column:
            totals = before(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda a, v: a + v)))
            return let(totals, lambda t: F.flatten(F.transform(bs, lambda b, k: let(F.get(t, k), lambda base: F.transform(before(b), lambda v: v + base)))))

        return F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(let(blocks, joined))

    return let(lengths, of)


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<text,start,end>>``: leftmost non-overlapping matches; the pattern has no group that splits."""
    none = F.array().cast("array<struct<text:string,start:int,end:int>>")

    def placed(found: Column) -> Column:
        pieces = F.split(text, F.lit(pattern), -1)
        steps = let(pieces, lambda p: F.transform(found, lambda m, k: F.length(F.get(p, k)) + F.length(m)))
        ends = let(steps, lambda x: F.zip_with(running_sum(x), x, lambda a, b: a + b))
        made = F.zip_with(found, ends, lambda m, e: F.named_struct(F.lit("text"), m, F.lit("start"), e - F.length(m), F.lit("end"), e))
        return F.when(F.size(found) == 0, none).otherwise(made)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


#: Fixed word list: what ends in a period without ending a sentence.
ABBREVIATIONS = """
dr mr mrs ms prof sr jr st vs etc al fig no inc ltd co corp dept univ e.g i.e approx est ca cf viz u.s u.k a.m p.m ph.d b.sc m.sc
jan feb mar apr jun jul aug sep sept oct nov dec
""".split()

#: A place where a sentence may end; and one where it must.
CANDIDATE = r"""(\n(?U:\s)*\n|[.!?]+["')\]]*(?U:\s)+)"""
#: A text up to the next such place, that included; or what comes after the last.
_PIECE = rf"(?s).*?{CANDIDATE}|.+"


def _ends(pieces: Column) -> Column:
    """Whether a sentence ends with each piece."""

    def ends(p: Column, k: Column) -> Column:
        core = F.regexp_replace(p, r"""[.!?]+["')\]]*(?U:\s)+$""", "")
        word = F.regexp_extract(core, r"([A-Za-z][A-Za-z.]*)$", 1)
        short = F.regexp_replace(F.lower(word), r"\.+$", "").isin(ABBREVIATIONS) | F.regexp_like(word, F.lit("^[A-Z]$"))
        goes_on = F.regexp_like(F.coalesce(F.get(pieces, k + 1), F.lit("")), F.lit(r"^[\p{Ll}\x{AA}\x{BA}]"))
        blank = F.regexp_like(p, F.lit(r"(?U)\n\s*\n\s*$"))
        return (k + 1 == F.size(pieces)) | blank | ~(short | goes_on)

    return F.transform(pieces, ends)


def sentences(text: Column) -> Column:
    """``array<struct<start,end>>``: sentences in order, trimmed; a blank line always parts them."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def cut(pieces: Column) -> Column:
        offsets = running_sum(F.transform(pieces, F.length))
        lasts = let(_ends(pieces), lambda e: F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda k: F.get(e, k)))

        def spans(last: Column, at: Column) -> Column:
            def span(k: Column, i: Column) -> Column:
                first = F.when(i == 0, F.lit(0)).otherwise(F.get(last, i - 1) + 1)
                raw = F.array_join(F.slice(pieces, first + 1, k - first + 1), "")

                def trimmed(r: Column) -> Column:
                    left = F.regexp_replace(r, r"(?U)^\s+", "")
                    start = F.get(at, first) + F.length(r) - F.length(left)
                    return F.named_struct(F.lit("start"), start, F.lit("end"), start + F.length(F.regexp_replace(left, r"(?U)\s+$", "")))

                return let(raw, trimmed)

            return F.filter(F.transform(last, span), lambda s: s["end"] > s["start"])

        return let(lasts, lambda last: let(offsets, lambda at: spans(last, at)))

    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, none).otherwise(let(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), cut))


def sentence_texts(text: Column) -> Column:
    return F.transform(sentences(text), lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]))


#: Fixed patterns of the entity kinds, in the order of their output.
YEAR = r"(?U)\b(?:1[5-9]\d{2}|20\d{2})\b"
NUMBER = r"(?U)\b\d[\d,]*(?:\.\d+)?\b"
NAME = r"(?U)\b[A-Z][a-zA-Z0-9.\-]*(?:\s+[A-Z][a-zA-Z0-9.\-]*)*\b"


def entities(text: Column) -> Column:
    """``array<struct<text,label,start,end>>``: years, numbers outside of them, and capitalised names that don't just begin a sentence."""

    def labelled(found: Column, label: str) -> Column:
        return F.transform(found, lambda m: F.named_struct(F.lit("text"), m["text"], F.lit("label"), F.lit(label), F.lit("start"), m["start"], F.lit("end"), m["end"]))

    def made(years: Column) -> Column:
        numbers = F.filter(matches(text, NUMBER), lambda m: ~F.exists(years, lambda y: (m["start"] >= y["start"]) & (m["start"] < y["end"])))

        def lone(m: Column) -> Column:
            # two places before a name; before the second character of a text, its last one
            place = F.when(m["start"] == 1, F.length(text)).otherwise(m["start"] - 1)
            return ~F.contains(m["text"], F.lit(" ")) & ((m["start"] == 0) | F.substring(text, place, F.lit(1)).isin(".", "!", "?"))

        names = F.filter(matches(text, NAME), lambda m: ~lone(m))
        return F.concat(labelled(years, "DATE"), labelled(numbers, "CARDINAL"), labelled(names, "PROPN"))

    return let(matches(text, YEAR), made)
