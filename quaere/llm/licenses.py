"""Licence scan: MinHash bands over text windows find templates, exact containment verifies them.

Texts become five-word shingles.  Windows of w shingles begin at each one, so that they overlap in all but
one; each has ``HASHES`` min-hashes (the least of the shingles' hashes after an XOR with a constant) in ``BANDS``
bands of two.  A template's windows have the same; a shared band retrieves the template.
Two windows with Jaccard J collide with probability 1 - (1 - J^2)^4: 0.98 at 0.8, and 1 at 1.

The width belongs to the template: the shingles that a match must have, ``WINDOW`` at most.  A notice that matches
after edits keeps a run of w shingles, so that two windows are equal and collide for certain: what is put in, taken out, put
in another's place or moved within a notice costs four shingles or more, or else is at its ends.  Of n shingles a fifth
may be lost; below 20 that is no change within (n - lost >= w are left in one run), and from 20 on e <= n / 20 changes leave
e + 1 runs of 0.8 n shingles, the longest of 8 or more.

A band collides only where the text has the template's least shingles; for a width whose templates' least shingles
a text has none of, its windows aren't hashed.  Of a retrieved template the share of its
distinct shingles that the text has is counted exactly; from ``CONTAINMENT`` it is a match.  All of it
is one projection of a document: nothing is shuffled, and a hot source is as cheap as any other.

Results: null and empty texts, and texts of fewer than five words, match nothing; equal texts match
equally; a text may match several templates; columns besides the key and the text are
ignored.  The templates are a parameter, ``(name, text)`` with at least five words each;
their bands go into the plan, so their number is checked against ``MOST_KEYS``.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NEAR, let
from .license_texts import TEMPLATES
from .shingles import shingles, words

#: Shingles of a window, at most.
WINDOW = 8
HASHES, BANDS = 8, 4
CONTAINMENT = NEAR
#: Band keys of all templates, at most: 8 bytes each in every task's plan.
MOST_KEYS = 200_000

_random = random.Random(20)
_MASKS = [_random.getrandbits(63) for _ in range(HASHES)]


def width(n: int, containment: float = CONTAINMENT) -> int:
    """Shingles of the windows of a template that has ``n`` of them."""
    return max(1, min(WINDOW, math.ceil(containment * n - 1e-9)))


def _least(h: Column, w: int, mask: int) -> Column:
    """Of the ``w`` shingles from each place on (fewer at the end), the least hash after the XOR."""
    masked = F.transform(h, lambda x: x.bitwiseXOR(F.lit(mask)))
    return let(masked, lambda x: F.transform(x, lambda _, i: F.array_min(F.slice(x, i + 1, F.lit(w)))))


def _unmasked(least: Column, mask: int) -> Column:
    return F.transform(least, lambda x: x.bitwiseXOR(F.lit(mask)))


def _band(h: Column, w: int, b: int) -> Column:
    """Keys of a band of all windows of ``w`` shingles, in order."""
    rows = HASHES // BANDS
    least = [_least(h, w, m) for m in _MASKS[b * rows : (b + 1) * rows]]
    return F.transform(F.arrays_zip(*(x.alias(f"m{k}") for k, x in enumerate(least))), lambda s: F.xxhash64(F.lit(w), F.lit(b), *(s[f"m{k}"] for k in range(rows))))


def index(spark: SparkSession, templates: list[tuple[str, str]], containment: float = CONTAINMENT) -> list[dict]:
    """Of each template: name, distinct shingles, the width of its windows, their band keys and least shingles."""
    df = spark.createDataFrame(templates, "name string, text string")
    rows = df.select("name", shingles(words(F.col("text")), short=False).alias("h")).collect()
    if any(not r["h"] for r in rows):
        raise ValueError("a template needs five words")
    out = []
    for w in sorted({width(len(r["h"]), containment) for r in rows}):
        own = spark.createDataFrame([(r["name"], r["h"]) for r in rows if width(len(r["h"]), containment) == w], "name string, h array<bigint>")
        full = F.size("h") - w + 1  # windows that don't end early
        banded = F.concat(*(F.slice(k, F.lit(1), full) for k in [_band(F.col("h"), w, b) for b in range(BANDS)]))
        least = F.concat(*(_unmasked(F.slice(_least(F.col("h"), w, m), F.lit(1), full), m) for m in _MASKS))
        out += [r.asDict() | {"width": w} for r in own.select("name", F.array_distinct("h").alias("h"), F.array_distinct(banded).alias("keys"), F.array_distinct(least).alias("least")).collect()]
    if (n := sum(len(r["keys"]) for r in out)) > MOST_KEYS:
        raise ValueError(f"{n} band keys: scan for the templates in parts of {MOST_KEYS} at most")
    return out


def _longs(of) -> Column:
    return F.lit([int(x) for x in of]).cast("array<bigint>")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, *, containment: float = CONTAINMENT) -> DataFrame:
    """A row for each match: ``doc_id, license, containment, first_word`` (where the first shared shingle begins, from 0)."""
    known = index(docs.sparkSession, templates, containment)
    least = _longs({k for r in known for k in r["least"]})
    widths = sorted({r["width"] for r in known})
    keyless = F.array().cast("array<bigint>")

    def hits(h: Column, w: int) -> Column:
        """Which band keys of the templates of this width a text has."""
        own = [r for r in known if r["width"] == w]
        bands = F.flatten(F.array(*(_band(h, w, b) for b in range(BANDS))))
        return F.when(F.arrays_overlap(_longs({k for r in own for k in r["least"]}), h), F.array_intersect(_longs({k for r in own for k in r["keys"]}), bands)).otherwise(keyless)

    def verified(h: Column, found: Column) -> Column:
        """Names and shares of the retrieved templates."""
        made = []
        for r in known:
            share = F.size(F.array_intersect(_longs(r["h"]), h)) / F.lit(float(len(r["h"])))
            retrieved = F.arrays_overlap(_longs(r["keys"]), found)
            first = F.array_min(F.transform(F.array_intersect(_longs(r["h"]), h), lambda x: F.array_position(h, x))) - 1
            nothing = F.lit(None).cast("struct<license:string,containment:double,first_word:bigint>")
            made.append(F.when(retrieved, F.struct(F.lit(r["name"]).alias("license"), share.alias("containment"), first.alias("first_word"))).otherwise(nothing))
        return F.filter(F.array(*made), lambda m: m.isNotNull() & (m["containment"] >= F.lit(containment)))

    none = F.array().cast("array<struct<license:string,containment:double,first_word:bigint>>")

    def matched(h: Column) -> Column:
        found = F.concat(*(hits(h, w) for w in widths))
        return F.when(~F.arrays_overlap(least, h), none).otherwise(let(found, lambda k: F.when(F.size(k) == 0, none).otherwise(verified(h, k))))

    rows = docs.select("doc_id", let(shingles(words(F.col("text")), short=False), matched).alias("m")).where(F.size("m") > 0)
    return rows.select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.license", "m.containment", "m.first_word")


def oracle_sql(templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> str:
    """The same matches in DuckDB, from the shingles' words themselves."""
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in templates)
    words_of = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"
    shingled = "SELECT {k}, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s, unnest(range(0, len(w) - 4)) AS pos FROM ({q}) WHERE len(w) >= 5"
    docs = shingled.format(k="doc_id", q=f"SELECT doc_id, {words_of.format('text')} AS w FROM documents")
    known = shingled.format(k="license", q=f"SELECT license, {words_of.format('text')} AS w FROM (VALUES {values}) v(license, text)")
    return f"""
WITH t AS (SELECT DISTINCT license, s FROM ({known})), n AS (SELECT license, count(*) AS n FROM t GROUP BY license),
d AS (SELECT doc_id, s, min(pos) AS pos FROM ({docs}) WHERE s IN (SELECT s FROM t) GROUP BY doc_id, s)
SELECT doc_id, license, count(*) / n::DOUBLE AS containment, min(pos) AS first_word
FROM d JOIN t USING (s) JOIN n USING (license) GROUP BY doc_id, license, n HAVING count(*) / n::DOUBLE >= {containment}"""
