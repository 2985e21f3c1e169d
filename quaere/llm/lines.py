"""Line dedup by content-defined chunks of lines.

A text's lines are hashed, and a rolling hash goes over each line and the one before.  A
chunk begins where the rolling hash is less than both of its neighbours, so a boundary
depends on the few lines around it and not on what stands far before them; chunks have two
lines or more.  Chunks whose hash occurs more than once are fetched and grouped by their
bytes; every occurrence but the first (by key, then place) of a chunk of two lines or more
goes.

Only hashes of chunks are compared globally, after counting on the map side; then each
document's text moves once, and only the text of repeated chunks besides.  A chunk that is a large
share of them all is joined by broadcast.

Results: a null text stays null, an empty one empty; single lines and chunks of white space stay;
a document may lose all its lines and stays with an empty text; rows of one key are told
apart by their text, and equal rows share their first occurrence's fate, so that both keep or lose
the same chunks; all columns are returned as they are but the text (and n_chars, where there is one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, split_join, staged


def chunks(text: Column) -> Column:
    """``array<struct<text,lines>>``: a text's chunks in order; joined by line feeds they are the text."""

    def rolled(h: Column) -> Column:
        return F.transform(h, lambda x, i: F.md5(F.concat(F.coalesce(F.get(h, i - 1), F.lit("")), x).cast("binary")))

    def begun(r: Column) -> Column:
        n = F.size(r)
        least = lambda i: (i >= 2) & (i + 1 < n) & (F.get(r, i) < F.get(r, i - 1)) & (F.get(r, i) < F.get(r, i + 1))
        return F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | least(i))

    def cut_up(lines: Column) -> Column:
        hashes = F.transform(lines, lambda x: F.md5(x.cast("binary")))
        starts = let(let(hashes, rolled), begun)

        def runs(s: Column) -> Column:
            def run(at: Column, k: Column) -> Column:
                n = F.coalesce(F.get(s, k + 1), F.size(lines)) - at
                return F.named_struct(F.lit("text"), F.array_join(F.slice(lines, at + 1, n), "\n"), F.lit("lines"), n)

            return F.transform(s, run)

        return let(starts, runs)

    return F.when(text.isNull(), F.array().cast("array<struct<text:string,lines:int>>")).otherwise(let(F.split(text, F.lit("\n"), -1), cut_up))


def _told(c: Column) -> Column:
    """Chunks that may go."""
    return (c["lines"] >= 2) & F.regexp_like(c["text"], F.lit(r"\S"))


def repeated(docs: DataFrame) -> DataFrame:
    """``_id, _twin, _gone array<int>``: of each document (its key, its text's hash), the places of the chunks that go."""
    of = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_twin"), chunks(F.col("text")).alias("c"))
    keyed = of.select("_id", "_twin", F.posexplode(F.transform("c", lambda c: F.when(_told(c), F.xxhash64(c["text"])))).alias("at", "k")).where("k IS NOT NULL")
    keyed = cut(keyed)
    often = cut(keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"))
    places = split_join(keyed, often, "k").groupBy("_id", "_twin").agg(F.collect_set("at").alias("_places"))
    fetched = let(chunks(F.col("text")), lambda c: F.transform("_places", lambda p: F.named_struct(F.lit("at"), p, F.lit("chunk"), F.get(c, p)["text"])))
    held = staged(_joined(docs, places, "inner").select("_id", "_twin", F.inline(fetched)), "chunks")
    first = cut(held.groupBy("chunk").agg(F.min(F.struct("_id", "_twin", "at")).alias("first"), F.count("*").alias("n")).where("n > 1"))
    gone = split_join(held, first, "chunk").where(F.struct("_id", "_twin", "at") != F.col("first"))
    return gone.groupBy("_id", "_twin").agg(F.array_sort(F.collect_set("at")).alias("_gone"))


def _joined(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """Documents with what is known of them; their exchange is the same wherever this stands in a plan, and so runs once."""
    return docs.join(places, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_twin")), how)


def remove(docs: DataFrame) -> DataFrame:
    """All documents without their repeated chunks, with ``_lines, _gone_lines, _gone_chunks`` besides their columns."""
    parted = _joined(docs, repeated(docs), "left").withColumn("_c", F.when(F.col("_gone").isNotNull(), chunks(F.col("text"))))
    lines = F.coalesce(F.size(F.split("text", F.lit("\n"), -1)), F.lit(0))
    stays = F.filter("_c", lambda c, i: ~F.array_contains(F.col("_gone"), i))
    text = F.when(F.col("_c").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stays, lambda c: c["text"]), "\n"))
    counted = F.coalesce(F.aggregate(F.filter("_c", lambda c, i: F.array_contains(F.col("_gone"), i)), F.lit(0), lambda a, c: a + c["lines"]), F.lit(0))
    out = parted.withColumns({"_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(lines).cast("bigint"), "_gone_lines": counted.cast("bigint"), "_gone_chunks": F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).cast("bigint"), "_text": text})
    columns = [F.col("_text").alias("text") if c == "text" else F.length("_text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*columns, "_lines", "_gone_lines", "_gone_chunks")


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, text, n_lines, n_removed_lines, n_removed_chunks`` of every document."""
    out = remove(docs.select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("_lines").alias("n_lines"), F.col("_gone_lines").alias("n_removed_lines"), F.col("_gone_chunks").alias("n_removed_chunks"))


#: The same in DuckDB, for keys that stand on one row each.
ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, unnest(range(0, len(w))) AS i, unnest(w) AS line, len(w) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents WHERE text IS NOT NULL)),
h AS (SELECT *, md5(coalesce(lag(md5(line)) OVER (PARTITION BY doc_id ORDER BY i), '') || md5(line)) AS r FROM l),
b AS (SELECT *, i = 0 OR (i >= 2 AND i + 1 < n AND r < lag(r) OVER d AND r < lead(r) OVER d) AS begins FROM h WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk FROM b),
c AS (SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS lines FROM k GROUP BY doc_id, chunk),
g AS (SELECT *, lines >= 2 AND regexp_matches(text, '\S') AND row_number() OVER (PARTITION BY text, lines >= 2 ORDER BY doc_id, chunk) > 1 AS gone FROM c)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(g.text, chr(10) ORDER BY chunk) FILTER (WHERE NOT gone), '') END AS text,
  coalesce(sum(lines), 0)::BIGINT AS n_lines, coalesce(sum(lines) FILTER (WHERE gone), 0)::BIGINT AS n_removed_lines, count(*) FILTER (WHERE gone) AS n_removed_chunks
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id GROUP BY d.doc_id, d.text"""
