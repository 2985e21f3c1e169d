"""Sliding windows of sentences over documents; no document leaves its row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import sentences
from ..functions.text import let
from ..params import DEFAULTS, Params


def sentence_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, sid, start, end``."""
    return docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("sid", "s")).select("doc_id", "sid", "s.start", "s.end")


def windows(text: Column, *, params: Params = DEFAULTS) -> Column:
    """``array<struct<start,end,n_sentences>>``: windows long enough, or the last one if none is."""
    if params.window < 1 or params.stride < 1:
        raise ValueError("window and stride must be at least 1")
    w, s = params.window, params.stride
    none = F.array().cast("array<struct<start:int,end:int,n_sentences:int>>")

    def over(spans: Column) -> Column:
        n = F.size(spans)
        starts = F.filter(F.sequence(F.lit(0), n - 1, F.lit(s)), lambda p: (p == 0) | (p - s + w < n))
        made = F.transform(starts, lambda p: F.named_struct(F.lit("start"), F.get(spans, p)["start"], F.lit("end"), F.get(spans, F.least(p + w, n) - 1)["end"], F.lit("n_sentences"), F.least(F.lit(w), n - p)))

        def kept(all_: Column) -> Column:
            long = F.filter(all_, lambda x: x["end"] - x["start"] >= params.min_passage_chars)
            return F.when(F.size(long) > 0, long).otherwise(F.slice(all_, -1, 1))

        return F.when(n == 0, none).otherwise(let(made, kept))

    return let(sentences(text), over)


def passages(docs: DataFrame, *, params: Params = DEFAULTS) -> DataFrame:
    """``passage_id, doc_id, doc_title, text, start, end, index, n_sentences, doc_ord`` of documents with a title and an order."""
    cut = docs.select("doc_id", "title", "text", "doc_ord", F.posexplode(windows(F.col("text"), params=params)).alias("index", "w"))
    text = F.substring("text", F.col("w.start") + 1, F.col("w.end") - F.col("w.start"))
    name = F.format_string("%s::p%03d", F.col("doc_id").cast("string"), F.col("index"))
    return cut.select(name.alias("passage_id"), "doc_id", F.col("title").alias("doc_title"), text.alias("text"), "w.start", "w.end", "index", "w.n_sentences", "doc_ord")


def offset_violations(passages_: DataFrame, docs: DataFrame) -> DataFrame:
    """Passages that their documents don't have at their places, or whose documents are missing."""
    own = docs.select("doc_id", F.col("text").alias("_text"))
    both = passages_.join(own, "doc_id", "left")
    there = F.substring("_text", F.col("start") + 1, F.col("end") - F.col("start"))
    return both.where(F.col("_text").isNull() | (there != F.col("text"))).select("passage_id", "doc_id", F.when(F.col("_text").isNull(), "missing").otherwise("moved").alias("problem"))
