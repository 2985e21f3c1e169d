"""Lookups in a table of facts (subject, relation, object): which subject, which relation, and the fact.

``facts``: ord, subject, relation, object, doc_id.  ``cues``: rel_ord, relation, label, cue_ord, cue.  ``aliases``: ord, alias, canonical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names up to which each is looked for in every question; more are joined to the questions' runs of words.
FEW_NAMES = 16


def subjects(facts: DataFrame) -> DataFrame:
    """``subject, ord``: each subject and where it first stands."""
    return facts.groupBy("subject").agg(F.min("ord").alias("ord"))


def facts_about(facts: DataFrame, subject: str) -> DataFrame:
    return facts.where(F.lower("subject") == subject.lower())


def stats(facts: DataFrame, cues: DataFrame) -> DataFrame:
    own = facts.agg(F.count("*").alias("facts"), F.countDistinct("subject").alias("subjects"), F.countDistinct("doc_id").alias("documents_covered"))
    return own.join(F.broadcast(cues.agg(F.countDistinct("relation").alias("relations")))).select("facts", "subjects", "relations", "documents_covered")


def as_triple(subject: Column, relation: Column, obj: Column) -> Column:
    return F.format_string("(%s, %s, %s)", subject, relation, obj)


def names_in(text: Column, name: Column) -> Column:
    """Whether a lower-case text has a name as whole words."""
    edge = F.lit(r"(?U)\b")
    return F.regexp_like(text, F.concat(edge, F.lit(r"\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"), edge))


def _grams(questions: DataFrame, longest: int) -> DataFrame:
    """Every run of up to ``longest`` tokens of a question, as it stands in the text."""
    parts = F.split("text", r"(?U)\b")
    n = F.size("_p")
    df = questions.withColumn("_p", parts)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - i + 1)), lambda k: F.array_join(F.slice("_p", i, k), ""))))
    return df.select("query_id", F.explode(F.array_distinct(runs)).alias("gram")).drop("_p")


def _longest_name(questions: DataFrame, names: DataFrame) -> DataFrame:
    """``query_id`` and the best row of ``names(name, ord, value)``: the longest name in the text, the first of equals.

    A few names are compared with every question.  Many are found by an equi-join with the questions' runs of words.
    """
    known = names.agg(F.count("*").alias("n"), F.max(F.size(F.split("name", r"(?U)\b"))).alias("parts")).first()
    low = questions.select("query_id", F.lower("text").alias("text"))
    if known["n"] <= FEW_NAMES:
        hit = low.join(F.broadcast(names), names_in(F.col("text"), F.col("name")))
    else:
        hit = _grams(low, known["parts"]).join(names, F.col("gram") == F.col("name"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.length("name")), "ord")
    return hit.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").select("query_id", "name", "value")


def find_subject(questions: DataFrame, facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """``query_id, subject``: the longest alias becomes its canonical name, then the longest subject counts."""
    alias = _longest_name(questions, aliases.select(F.lower("alias").alias("name"), "ord", F.lower("canonical").alias("value")))
    replaced = questions.join(alias, "query_id", "left").select("query_id", F.when(F.col("name").isNull(), F.lower("text")).otherwise(F.replace(F.lower("text"), F.col("name"), F.col("value"))).alias("text"))
    found = _longest_name(replaced, subjects(facts).select(F.lower("subject").alias("name"), "ord", F.col("subject").alias("value")))
    return found.select("query_id", F.col("value").alias("subject"))


def find_relation(questions: DataFrame, cues: DataFrame) -> DataFrame:
    """``query_id, relation, label, cue``: the longest cue that a question holds, the first of equals."""
    hit = questions.select("query_id", F.lower("text").alias("text")).join(F.broadcast(cues), F.contains(F.col("text"), F.col("cue")))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.length("cue")), "rel_ord", "cue_ord")
    return hit.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").select("query_id", "relation", "label", "cue")


def answer(questions: DataFrame, facts: DataFrame, cues: DataFrame, aliases: DataFrame) -> DataFrame:
    """``query_id, subject, relation, relation_label, matched_cue, object, doc_id`` of the questions that a fact answers.

    Of several facts of one subject and relation the last counts.
    """
    last = facts.groupBy(F.lower("subject").alias("_low"), "relation").agg(F.max(F.struct("ord", "object", "doc_id")).alias("f"))
    both = find_subject(questions, facts, aliases).join(find_relation(questions, cues), "query_id").withColumn("_low", F.lower("subject"))
    return both.join(last, ["_low", "relation"]).select("query_id", "subject", "relation", F.col("label").alias("relation_label"), F.col("cue").alias("matched_cue"), F.col("f.object").alias("object"), F.col("f.doc_id").alias("doc_id"))


def explain(subject: Column, relation_label: Column, cue: Column, obj: Column) -> Column:
    return F.format_string("subject %s; cue \"%s\" means %s; so %s", subject, cue, relation_label, obj)
