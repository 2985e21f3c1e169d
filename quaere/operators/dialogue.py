"""Conversations: intents, follow-ups that lean on a topic, and which route answers a turn.

``turns``: conv_id, turn, text.  The topic slot is folded over the turns of a conversation in order.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import stripped
from ..params import DEFAULTS, Params
from . import answers, facts, index
from .staging import written

#: Fixed texts of replies that need no documents.
SMALL_TALK = {
    "farewell": "Until next time.",
    "thanks": "You are welcome; go on asking.",
    "help": "Ask about a person, a date, a place or a number and I will name it with the sentence it stands in; ask why or what something is and I will quote the sentence. Follow-ups such as \"and when?\" work.",
}
#: Questions of the kinds that are answered, for any collection.
SUGGESTIONS = ["Who is the first author named here?", "In which year did it begin?", "Where is the institute?", "How many pages are there?", "What is the main topic?", "Why is that so?"]


def described(turns: DataFrame, facts_: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each turn with its intent, whether it leans on a topic, and the subject that it names itself."""
    text = stripped(F.col("text"))
    rows = turns.select("conv_id", "turn", text.alias("text")).where("text <> ''")
    rows = rows.withColumns({"intent": rules.intent(F.col("text")), "alone": rules.is_question_only(F.col("text")), "pronoun": rules.has_pronoun(F.col("text")), "query_id": F.struct("conv_id", "turn")})
    named = facts.find_subject(rows, facts_, aliases)
    return rows.join(named, "query_id", "left").drop("query_id")


def with_topics(rows: DataFrame) -> DataFrame:
    """``topic_before, question, rewritten, topic`` of described turns, by a fold in the order of turns.

    Small talk leaves the topic.  A turn that leans on it is about the longer of the topic and the subject it names,
    the topic if they are as long; another is about what it names, or else leaves the topic.
    """
    item = F.struct("turn", "text", "intent", "alone", "pronoun", "subject")
    start = F.struct(F.lit(None).cast("string").alias("topic"), F.array().cast("array<struct<turn:bigint,topic_before:string,topic:string>>").alias("out"))

    def step(a, x):
        leans = a["topic"].isNotNull() & (x["alone"] | x["pronoun"])
        longer = F.when(F.length(F.coalesce(x["subject"], F.lit(""))) > F.length(a["topic"]), x["subject"]).otherwise(a["topic"])
        topic = F.when(x["intent"] != "question", a["topic"]).when(leans, longer).otherwise(F.coalesce(x["subject"], a["topic"]))
        return F.named_struct(F.lit("topic"), topic, F.lit("out"), F.concat(a["out"], F.array(F.named_struct(F.lit("turn"), x["turn"].cast("bigint"), F.lit("topic_before"), a["topic"], F.lit("topic"), topic))))

    folded = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("turns")).select("conv_id", F.explode(F.aggregate("turns", start, step)["out"]).alias("o"))
    state = folded.select("conv_id", F.col("o.turn").alias("turn"), "o.topic_before", "o.topic")
    both = rows.withColumn("turn", F.col("turn").cast("bigint")).join(state, ["conv_id", "turn"])
    question = F.when(F.col("intent") == "question", rules.resolved(F.col("text"), F.col("topic_before")))
    return both.withColumn("question", question).withColumn("rewritten", F.coalesce(F.col("question") != F.col("text"), F.lit(False)))


def topics_by_rules(rows: DataFrame, facts_: list[tuple[str, int]], aliases: list[tuple[str, str]]) -> DataFrame:
    """The same fold in full generality: each rewritten question is searched for subjects anew.

    For fact bases in which putting a topic into a question makes or breaks the match of another name.
    """
    from ..streaming.conversations import Slots

    slots = Slots(facts_, aliases)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        topic, out = None, []
        for row in pdf.sort_values("turn").itertuples():
            question, topic = slots.step(row.text, row.intent, topic)
            out.append((row.conv_id, row.turn, question, topic))
        return pd.DataFrame(out, columns=["conv_id", "turn", "question", "topic"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "text", "intent").groupBy("conv_id").applyInPandas(fold, f"conv_id {kind}, turn bigint, question string, topic string")


def respond(turns: DataFrame, *, documents: DataFrame, passages: DataFrame | None = None, postings: DataFrame | None = None, stats: DataFrame | None = None, facts_: DataFrame, cues: DataFrame, aliases: DataFrame, params: Params = DEFAULTS, listed: int | None = None, retrieve: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]] | None = None) -> DataFrame:
    """``conv_id, turn, text, intent, question, rewritten, route, reply, topic`` of every turn.

    Facts are tried first, and only what they leave open is searched for.  A reply counts all documents and names
    the first ``listed`` of them (None: all).  ``retrieve`` gives hits, their passages and the known terms of questions;
    without it they come from passages, postings and their statistics.  Each step is written down: the next ones read it several times, and a
    plan of all of them at once takes the driver minutes.
    """
    rows = written(with_topics(written(described(turns, facts_, aliases))).withColumn("query_id", F.col("question")))
    # a question that many conversations ask is answered once
    asked = rows.where("intent = 'question'").select("query_id", F.col("question").alias("text")).distinct()
    known = written(facts.answer(asked, facts_, cues, aliases).select("query_id", "object"))
    open_ = written(asked.join(known.select("query_id"), "query_id", "left_anti"))
    if retrieve is None:
        hits = written(index.top(open_, postings, stats, k=params.top_k, params=params))
        shown = passages.join(hits.select(F.col("unit_id").alias("passage_id")).distinct(), "passage_id", "left_semi")
        terms = postings.select("term").distinct()
    else:
        hits, shown, terms = retrieve(open_)
    found = written(answers.extract(open_, hits, shown, params=params).where("kind <> 'none'").select("query_id", "text"))
    refused = open_.join(found.select("query_id"), "query_id", "left_anti")
    missing = index.unknown_terms(refused, terms).groupBy("query_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("pos", "term"))), 1, 3), lambda x: x["term"]).alias("missing"))
    named = documents if listed is None else documents.orderBy("doc_ord", "title").limit(listed)
    titles = named.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_ord", "title"))), lambda d: d["title"]), "; ").alias("titles"))
    n = documents.agg(F.count("*").alias("n_docs")).crossJoin(titles)
    replied = known.select("query_id", F.lit("knowledge base").alias("route"), F.concat("object", F.lit(".")).alias("reply")).unionByName(found.select("query_id", F.lit("retrieval").alias("route"), F.col("text").alias("reply")))
    out = rows.join(replied, "query_id", "left").join(missing, "query_id", "left").join(F.broadcast(n))
    refusal = F.when(F.col("missing").isNotNull(), F.concat(F.lit("None of "), F.col("n_docs").cast("string"), F.lit(" documents speaks of "), F.array_join(F.transform("missing", lambda t: F.concat(F.lit("“"), t, F.lit("”"))), ", "), F.lit(".")))
    refusal = refusal.otherwise(F.lit("No passage answers that, though some are about it."))
    talk = F.when(F.col("intent") == "greeting", F.concat(F.lit("Good to see you. "), F.col("n_docs").cast("string"), F.lit(" documents are ready for your questions."))).when(F.col("intent") == "documents", F.concat(F.lit("The collection counts "), F.col("n_docs").cast("string"), F.lit(" documents, among them: "), F.col("titles"), F.lit(".")))
    for name, text in SMALL_TALK.items():
        talk = talk.when(F.col("intent") == name, F.lit(text))
    route = F.when(F.col("intent") != "question", "conversation").otherwise(F.coalesce("route", F.lit("none")))
    reply = F.when(F.col("intent") != "question", talk).otherwise(F.coalesce(F.col("reply"), refusal))
    return out.select("conv_id", "turn", "text", "intent", F.coalesce("question", F.lit("")).alias("question"), "rewritten", route.alias("route"), reply.alias("reply"), "topic")


def last_topics(rows: DataFrame) -> DataFrame:
    """``conv_id, topic`` after the last turn of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").select("conv_id", "topic")


