"""An inverted index as tables, and ranked retrieval over it.

Units (passages or documents) have a ``unit_id`` and an order ``ord`` that breaks ties.  Scores are
rounded to six places before they are ranked, so that the order of summation doesn't show.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import analyze
from ..params import DEFAULTS, Params

#: Rows that are broadcast at most, once they have been counted: terms of queries, or of their hits (some 50 MB).
FEW_ROWS = 500_000


def units(df: DataFrame, unit_id: str, order: list[str]) -> DataFrame:
    """``unit_id, ord, text``: ``ord`` is a struct that sorts as the units do."""
    return df.select(F.col(unit_id).alias("unit_id"), F.struct(*order).alias("ord"), "text")


def by_unit(units_: DataFrame) -> DataFrame:
    """Units dealt by ``unit_id``: scores of postings made of them are then added up where they stand, and only the best travel."""
    return units_.repartition(int(units_.sparkSession.conf.get("spark.sql.shuffle.partitions")), "unit_id")


def postings(units_: DataFrame) -> DataFrame:
    """``term, unit_id, ord, tf, length``: terms are counted within each unit's row, so nothing is shuffled."""
    rows = units_.select("unit_id", "ord", F.array_sort(analyze(F.col("text"))).alias("terms"))
    n = F.size("terms")
    # no filter by n: it would be pushed below, and the terms made twice
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    starts = F.filter(places, lambda i: (i == 0) | (F.get("terms", i) != F.get("terms", i - 1)))
    counted = F.transform(F.col("starts"), lambda s, k: F.named_struct(F.lit("term"), F.get("terms", s), F.lit("tf"), F.coalesce(F.get("starts", k + 1), n) - s))
    rows = rows.withColumn("starts", starts)
    return rows.select("unit_id", "ord", n.alias("length"), F.inline(counted)).select("term", "unit_id", "ord", "tf", "length")


def lengths(units_: DataFrame) -> DataFrame:
    """``unit_id, length``, units without terms included."""
    return units_.select("unit_id", F.size(analyze(F.col("text"))).alias("length"))


def index_stats(units_: DataFrame, postings_: DataFrame | None = None) -> DataFrame:
    """One row: the number of units and their mean length (0 if there are none); from stored postings, if there are any."""
    if postings_ is None:
        return lengths(units_).agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg_length"))
    total = postings_.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("_total"))
    n = units_.agg(F.count("*").alias("n"))
    return n.join(F.broadcast(total)).select("n", F.when(F.col("n") == 0, 0.0).otherwise(F.col("_total") / F.col("n")).alias("avg_length"))


def stored(rows: DataFrame) -> DataFrame:
    """Rows kept by the executors, in memory as far as it goes, for what reads them several times; lost ones are made anew."""
    return rows.persist(StorageLevel.MEMORY_AND_DISK)


def vocabulary(postings_: DataFrame, stats: DataFrame) -> DataFrame:
    """``term, df, idf, idf_tfidf``."""
    df = postings_.groupBy("term").agg(F.count("*").alias("df"))
    n = F.col("n")
    return df.join(F.broadcast(stats.select("n"))).select("term", "df", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), F.log(n / F.col("df")).alias("idf_tfidf"))


def norms(postings_: DataFrame, terms: DataFrame) -> DataFrame:
    """``unit_id, norm`` of the TF-IDF vectors, 1 where it would be 0."""
    weight = (1 + F.log("tf")) * F.col("idf_tfidf")
    norm = F.sqrt(F.sum(weight * weight))
    return postings_.join(terms, "term").groupBy("unit_id").agg(F.when(norm == 0, 1.0).otherwise(norm).alias("norm"))


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, pos, term``, with repeats, in order."""
    return queries.select("query_id", F.posexplode(analyze(F.col("text"))).alias("pos", "term"))


def known_terms(queries: DataFrame, terms: DataFrame) -> DataFrame:
    return query_terms(queries).join(terms.select("term"), "term", "left_semi")


def unknown_terms(queries: DataFrame, terms: DataFrame) -> DataFrame:
    return query_terms(queries).join(terms.select("term"), "term", "left_anti")


def bm25(tf: Column, length: Column, idf: Column, avg: Column, params: Params = DEFAULTS) -> Column:
    return idf * tf * (params.k1 + 1) / (tf + params.k1 * (1 - params.b + params.b * length / avg))


def _asked(queries: DataFrame) -> DataFrame:
    return query_terms(queries).select("query_id", "term").distinct()


def few_terms(queries: DataFrame, times: int = 1) -> bool:
    """Whether ``times`` the distinct terms of all queries are few enough to be broadcast; they are counted for it."""
    most = FEW_ROWS // max(times, 1)
    return _asked(queries).limit(most + 1).count() <= most


def _hint(rows: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(rows) if few else rows


def _wanted(queries: DataFrame, postings_: DataFrame, stats: DataFrame, few: bool) -> DataFrame:
    """``query_id, term, df, avg_length, idf, idf_tfidf``: the distinct terms of each query that the index has."""
    asked = _asked(queries)
    terms = postings_.join(_hint(asked.select("term").distinct(), few), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(stats))
    n = F.col("n")
    terms = terms.select("term", "df", "avg_length", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), F.log(n / F.col("df")).alias("idf_tfidf"))
    return asked.join(terms, "term")


def _scored(postings_: DataFrame, stats: DataFrame, wanted: DataFrame, on: list[str], scorer: str, params: Params) -> DataFrame:
    rows = postings_.join(wanted, on)
    if scorer == "bm25":
        score = bm25(F.col("tf"), F.col("length"), F.col("idf"), F.col("avg_length"), params)
    else:
        # the norm of a unit takes all of its terms, asked for or not
        every = vocabulary(postings_, stats)
        rows = rows.join(norms(postings_, every), "unit_id")
        score = (1 + F.log("tf")) * F.col("idf_tfidf") * F.col("idf_tfidf") / F.col("norm")
    return rows.withColumn("_score", score)


def _check(scorer: str) -> None:
    if scorer not in ("bm25", "tfidf"):
        raise ValueError(f"unknown scorer {scorer!r}")


def contributions(queries: DataFrame, postings_: DataFrame, stats: DataFrame, *, scorer: str = "bm25", params: Params = DEFAULTS) -> DataFrame:
    """``query_id, unit_id, ord, term, tf, df, idf, score``: what each distinct term of a query adds to a unit.

    Postings meet the queries' terms in one join, which sends the terms to the postings if they were counted and are few.
    """
    _check(scorer)
    few = few_terms(queries)
    return _scored(postings_, stats, _hint(_wanted(queries, postings_, stats, few), few), ["term"], scorer, params).select("query_id", "unit_id", "ord", "term", "tf", "df", "idf", F.col("_score").alias("score"))


def ranked(scored: DataFrame, k: int | None) -> DataFrame:
    """``rank`` by descending score, then order; the first ``k`` of each query."""
    if k is not None and k < 0:
        raise ValueError("k must not be negative")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    out = scored.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def scores(queries: DataFrame, postings_: DataFrame, stats: DataFrame, *, scorer: str = "bm25", params: Params = DEFAULTS) -> DataFrame:
    """``query_id, unit_id, ord, score`` of all units that have a term of a query; without a shuffle if postings lie by unit."""
    parts = contributions(queries, postings_, stats, scorer=scorer, params=params)
    return parts.groupBy("query_id", "unit_id", "ord").agg(F.round(F.sum("score"), 6).alias("score"))


def top(queries: DataFrame, postings_: DataFrame, stats: DataFrame, *, k: int | None = DEFAULTS.top_k, scorer: str = "bm25", params: Params = DEFAULTS) -> DataFrame:
    """``query_id, unit_id, ord, score, rank`` of the best units of each query."""
    return ranked(scores(queries, postings_, stats, scorer=scorer, params=params), k)


def _behind(queries: DataFrame, hits: DataFrame, k: int | None, postings_: DataFrame, stats: DataFrame, scorer: str, params: Params) -> DataFrame:
    """A row for each term of each of at most ``k`` hits a query.  Only the hits' own postings are scored again."""
    few = few_terms(queries)
    pairs = _wanted(queries, postings_, stats, few).join(hits.withColumnRenamed("score", "total").drop("ord"), "query_id")
    return _scored(postings_, stats, _hint(pairs, k is not None and few_terms(queries, k)), ["term", "unit_id"], scorer, params)


def search(queries: DataFrame, postings_: DataFrame, stats: DataFrame, *, k: int | None = DEFAULTS.top_k, scorer: str = "bm25", params: Params = DEFAULTS) -> DataFrame:
    """``query_id, unit_id, ord, score, rank, term_scores`` of the best units of each query; the terms of these alone are put into maps."""
    hits = top(queries, postings_, stats, k=k, scorer=scorer, params=params)
    rows = _behind(queries, hits, k, postings_, stats, scorer, params)
    return rows.groupBy("query_id", "unit_id", "ord", F.col("total").alias("score"), "rank").agg(F.map_from_entries(F.collect_list(F.struct("term", F.round("_score", 6).alias("score")))).alias("term_scores"))


def matched_terms(term_scores: Column) -> Column:
    """Terms by descending contribution."""
    order = F.array_sort(F.transform(F.map_entries(term_scores), lambda e: F.named_struct(F.lit("down"), -e["value"], F.lit("term"), e["key"])))
    return F.transform(order, lambda e: e["term"])


def explain(queries: DataFrame, postings_: DataFrame, stats: DataFrame, *, k: int = DEFAULTS.top_k, params: Params = DEFAULTS) -> DataFrame:
    """``query_id, unit_id, rank, term, tf, df, idf, score``: the terms behind each hit, by descending contribution."""
    hits = top(queries, postings_, stats, k=k, params=params)
    rows = _behind(queries, hits, k, postings_, stats, "bm25", params)
    return rows.select("query_id", "unit_id", "rank", "term", "tf", "df", F.round("idf", 3).alias("idf"), F.round("_score", 3).alias("score"))


def best_per_document(scored: DataFrame, doc_id: Column, k: int = 3) -> DataFrame:
    """The best unit of each document, ranked anew; ``scored`` are the `scores` of all units, ``doc_id`` says whose they are."""
    best = scored.groupBy("query_id", doc_id.alias("doc_id")).agg(F.min(F.struct((-F.col("score")).alias("down"), "ord", "unit_id")).alias("b"))
    return ranked(best.select("query_id", "doc_id", "b.unit_id", "b.ord", (-F.col("b.down")).alias("score")), k)


def coverage(question: Column, text: Column) -> Column:
    """Share of a question's distinct terms that a text has; 0 of no terms."""
    from ..functions.text import let

    def share(q: Column) -> Column:
        return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, analyze(text))) / F.size(q))

    return let(F.array_distinct(analyze(question)), share)


def add_documents(postings_: DataFrame, more: DataFrame) -> DataFrame:
    """Postings with those of more units: an index grows by appending, only its statistics are made anew."""
    return postings_.unionByName(postings(more))


def remove_documents(postings_: DataFrame, gone: DataFrame) -> DataFrame:
    return postings_.join(gone.select("unit_id"), "unit_id", "left_anti")
