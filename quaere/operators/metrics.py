"""How good answers and rankings are, set at a time.

``results``: query_id, gold (null: must be refused), predicted, route, question_type, gold_doc, refused, doc_rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules


def doc_ranks(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """``query_id, doc_rank``: where the gold document first stands; ``hits`` have ``query_id, doc_id, rank``."""
    both = hits.join(gold.select("query_id", F.col("doc").alias("doc_id")), ["query_id", "doc_id"])
    return both.groupBy("query_id").agg(F.min("rank").alias("doc_rank"))


def scored(results: DataFrame) -> DataFrame:
    """With ``em, f1, contains, reciprocal_rank, correct``; the first three are 0 where nothing was to be answered."""
    answerable = F.col("gold").isNotNull()
    zero = lambda c: F.when(answerable, c).otherwise(0.0)
    out = results.withColumns({"em": zero(rules.exact_match(F.col("predicted"), F.col("gold"))), "f1": zero(rules.token_f1(F.col("predicted"), F.col("gold"))), "contains": zero(rules.contains_gold(F.col("predicted"), F.col("gold"))), "reciprocal_rank": F.coalesce(1.0 / F.col("doc_rank"), F.lit(0.0))})
    return out.withColumn("correct", F.when(answerable, (F.col("contains") > 0) | (F.col("em") > 0)).otherwise(F.col("refused")))


def summary(scored_: DataFrame) -> DataFrame:
    """One row: questions, recall, MRR, exact match, F1, contains, refusals, overall; means over nothing are 0."""
    answerable, ranked = F.col("gold").isNotNull(), F.col("gold").isNotNull() & F.col("gold_doc").isNotNull()
    mean = lambda cond, value: F.coalesce(F.avg(F.when(cond, value.cast("double"))), F.lit(0.0))
    return scored_.agg(
        F.count("*").alias("questions"), F.count(F.when(answerable, 1)).alias("answerable"), mean(ranked, F.col("doc_rank").isNotNull()).alias("recall_at_k"), mean(ranked, F.col("reciprocal_rank")).alias("mrr"),
        mean(answerable, F.col("em")).alias("exact_match"), mean(answerable, F.col("f1")).alias("f1"), mean(answerable, F.col("contains")).alias("contains"), mean(~answerable, F.col("refused")).alias("refusal_accuracy"), mean(F.lit(True), F.col("correct")).alias("overall"),
    )


def by_type(scored_: DataFrame) -> DataFrame:
    out = scored_.groupBy("question_type").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("correct"), F.coalesce(F.avg(F.when(F.col("gold").isNotNull(), F.col("f1"))), F.lit(0.0)).alias("f1"))
    return out.orderBy("question_type")


def by_route(scored_: DataFrame) -> DataFrame:
    return scored_.groupBy("route").agg(F.count("*").alias("n")).orderBy("route")


def failures(scored_: DataFrame) -> DataFrame:
    return scored_.where(~F.col("correct"))


def evaluate(gold: DataFrame, replies: DataFrame, hits: DataFrame) -> DataFrame:
    """Scored results of ``gold(query_id, q, a, doc, type)`` by the replies and the ranking of documents."""
    own = replies.select("query_id", "route", F.col("reply").alias("_reply"))
    ranks = doc_ranks(gold, hits)
    rows = gold.join(own, "query_id", "left").join(ranks, "query_id", "left")
    evidence = F.col("route").isin("knowledge base", "retrieval")
    rows = rows.select("query_id", F.col("q").alias("question"), F.col("a").alias("gold"), F.when(evidence, F.col("_reply")).otherwise("").alias("predicted"), F.coalesce("route", F.lit("none")).alias("route"), F.coalesce("type", F.lit("OTHER")).alias("question_type"), F.col("doc").alias("gold_doc"), (~F.coalesce(evidence, F.lit(False))).alias("refused"), F.when(F.col("a").isNotNull(), F.col("doc_rank")).alias("doc_rank"))
    return scored(rows)
