"""One query for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..functions.spans import entities
from ..operators import answers, collection, dialogue, index, metrics, passages, ranking
from ..operators import facts as kb
from ..operators.staging import place, written
from ..params import DEFAULTS, Params
from . import tables as t


def doc_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.admit(t.collection(spark, sf_dir)).select("doc_ord", "doc_id", "slug", "checksum", "char_count", "word_count", "reject_reason")


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.stats(collection.members(collection.admit(t.collection(spark, sf_dir)))).drop("slots_free")


def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.fingerprint(collection.members(collection.admit(t.collection(spark, sf_dir))))


def quick_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.quick_fingerprint(collection.members(collection.admit(t.collection(spark, sf_dir))))


def corpus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.rows(collection.members(collection.admit(t.collection(spark, sf_dir))))


def corpus_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents a bounded collection admits and refuses, and why, and what is free of it then."""
    bound = Params(max_docs=t.CAP)
    admitted = collection.admit(t.collection(spark, sf_dir), params=bound)
    free = collection.stats(collection.members(admitted), params=bound).select("slots_free")
    return admitted.groupBy(F.coalesce("reject_reason", F.lit("admitted")).alias("reason")).agg(F.count("*").alias("n")).join(F.broadcast(free))


def document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.read(spark, sf_dir, "documents")
    terms = T.analyze(F.col("text"))
    return docs.select("doc_id", F.size(T.tokens(F.col("text"))).alias("n_tokens"), F.size(terms).alias("n_terms"), F.md5(F.array_join(terms, " ").cast("binary")).alias("terms_md5"))


def document_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.documents(spark, sf_dir)
    return docs.select("doc_id", "title", T.preview(F.col("text")).alias("preview"), T.snippet(F.col("text")).alias("snippet"))


def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.sentence_spans(t.documents(spark, sf_dir))


def passage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.passages(t.documents(spark, sf_dir))
    return out.select("passage_id", "doc_id", "start", "end", "index", "n_sentences", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def offset_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.documents(spark, sf_dir)
    return passages.offset_violations(passages.passages(docs), docs)


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.units(t.documents(spark, sf_dir), "doc_id", ["doc_ord"])


def _postings(units: DataFrame) -> DataFrame:
    return index.stored(index.postings(index.by_unit(units)))


def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(_units(spark, sf_dir)).select("term", F.col("unit_id").alias("doc_id"), "tf", "length")


def vocabulary_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _units(spark, sf_dir)
    posted = _postings(units)
    out = index.vocabulary(posted, index.index_stats(units, posted))
    return out.select("term", "df", F.round("idf", 6).alias("idf"), F.round("idf_tfidf", 6).alias("idf_tfidf"))


def passage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _units(spark, sf_dir)
    posted = _postings(units)
    norms = index.norms(posted, index.vocabulary(posted, index.index_stats(units, posted)))
    return index.lengths(units).join(norms, "unit_id", "left").select(F.col("unit_id").alias("doc_id"), "length", F.round(F.coalesce("norm", F.lit(1.0)), 6).alias("norm"))


def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _units(spark, sf_dir)
    posted = _postings(units)
    n = posted.select("term").distinct().agg(F.count("*").alias("vocabulary"))
    return index.index_stats(units, posted).join(n).select("n", "vocabulary", F.round("avg_length", 1).alias("avg_length"), F.lit(DEFAULTS.k1).alias("k1"), F.lit(DEFAULTS.b).alias("b"))


def _doc_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    units = _units(spark, sf_dir)
    posted = _postings(units)
    return posted, index.index_stats(units, posted)


def _ranked(spark: SparkSession, sf_dir: str, scorer: str) -> DataFrame:
    return index.top(t.benchmark(spark, sf_dir), *_doc_index(spark, sf_dir), scorer=scorer)


def _document_hits(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    """``query_id, doc_id, rank`` of the best documents for each query by BM25."""
    return ranking.top(ranking.asked(t.documents(spark, sf_dir), asked, whole=True)).select("query_id", "doc_id", "rank")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = index.search(t.benchmark(spark, sf_dir), *_doc_index(spark, sf_dir))
    return hits.select("query_id", F.col("unit_id").alias("doc_id"), "score", "rank", F.array_join(F.array_sort(F.map_keys("term_scores")), " ").alias("terms"))


def matched_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms behind each hit, the weightiest first."""
    hits = index.search(t.benchmark(spark, sf_dir), *_doc_index(spark, sf_dir))
    return hits.select("query_id", F.col("unit_id").alias("doc_id"), F.array_join(index.matched_terms(F.col("term_scores")), " ").alias("terms"))


def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, "tfidf").select("query_id", F.col("unit_id").alias("doc_id"), "score", "rank")


def _passage_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cut = passages.passages(t.documents(spark, sf_dir))
    units = index.units(cut, "passage_id", ["doc_ord", "index", "doc_id"])
    posted = _postings(units)
    return cut, posted, index.index_stats(units, posted)


def document_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, posted, stats = _passage_index(spark, sf_dir)
    hits = index.scores(t.benchmark(spark, sf_dir), posted, stats)
    return index.best_per_document(hits, F.col("ord.doc_id")).select("query_id", "doc_id", F.col("unit_id").alias("passage_id"), "score", "rank")


def score_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = index.explain(t.benchmark(spark, sf_dir), *_doc_index(spark, sf_dir))
    return out.withColumnRenamed("unit_id", "doc_id")


def unknown_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of questions and of benchmark items that no document has."""
    asked = t.fact_questions(spark, sf_dir).unionByName(t.benchmark(spark, sf_dir).withColumn("query_id", -100 - F.col("query_id")))
    return index.unknown_terms(asked, _postings(_units(spark, sf_dir)).select("term").distinct())


def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _ranked(spark, sf_dir, "bm25").where(F.col("rank") <= DEFAULTS.extract_from)
    docs = t.documents(spark, sf_dir).select(F.col("doc_id").alias("unit_id"), F.col("text").alias("unit_text"))
    rows = hits.join(docs, "unit_id").join(t.benchmark(spark, sf_dir), "query_id").withColumn("coverage", F.round(index.coverage(F.col("text"), F.col("unit_text")), 6))
    return rows.select("query_id", F.col("unit_id").alias("doc_id"), "rank", "coverage", (F.col("coverage") >= DEFAULTS.min_coverage).alias("passes"))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document that holds each benchmark item as it stands."""
    docs = t.read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    items = t.benchmark(spark, sf_dir)
    held = collection.holders(docs, items).groupBy("query_id").agg(F.min("doc_id").alias("doc"))
    return items.join(held, "query_id", "left")


def retrieval_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _gold(spark, sf_dir).where("doc IS NOT NULL")
    hits = _ranked(spark, sf_dir, "bm25").select("query_id", F.col("unit_id").alias("doc_id"), "rank")
    ranks = gold.join(metrics.doc_ranks(gold, hits), "query_id", "left")
    found = F.col("doc_rank").isNotNull().cast("double")
    return ranks.agg(F.count("*").alias("n"), F.round(F.avg(found), 6).alias("recall_at_5"), F.round(F.avg(F.coalesce(1 / F.col("doc_rank"), F.lit(0.0))), 6).alias("mrr"))


def _passage_hits(spark: SparkSession, sf_dir: str, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The best passages for each query, and the passages that are hit."""
    docs = t.documents(spark, sf_dir)
    hits = written(ranking.top(ranking.asked(docs, asked)))
    return ranking.passage_hits(hits), ranking.passages_of(hits, docs)


def _sentence_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = t.benchmark(spark, sf_dir)
    hits, cut = _passage_hits(spark, sf_dir, asked)
    return answers.best_sentences(written(answers.considered(asked, hits, cut)))


def sentence_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _sentence_answers(spark, sf_dir)
    return out.select("query_id", "text", "confidence", "doc_id", "passage_id", "doc_start", "doc_end")


def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each benchmark item against the sentence that answers it best."""
    both = _sentence_answers(spark, sf_dir).select("query_id", F.col("text").alias("predicted")).join(t.benchmark(spark, sf_dir), "query_id")
    p, g = F.col("predicted"), F.col("text")
    return both.select("query_id", rules.exact_match(p, g).alias("exact_match"), F.round(rules.token_f1(p, g), 6).alias("f1"), rules.contains_gold(p, g).alias("contains"))


def regex_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.documents(spark, sf_dir).select("doc_id", F.posexplode(entities(F.col("text"))).alias("nth", "e")).select("doc_id", "nth", "e.text", "e.label", "e.start", "e.end")


def _item_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = written(t.item_questions(spark, sf_dir))
    return answers.extract(asked, *_passage_hits(spark, sf_dir, asked))


def span_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to questions of several kinds about each whole benchmark item, with the parts of their scores; '', -1 or 0 is what isn't there."""
    out = _item_answers(spark, sf_dir)
    shown = F.array_join(F.transform("alternatives", lambda a: F.format_string("%s (%.3f)", a["text"], a["score"])), "; ")
    out = out.withColumns({f"{k}_part": F.col("parts")[k] for k in ("evidence", "type", "context", "repeat")}).withColumn("alternatives", shown).drop("parts")
    return out.fillna("").fillna(-1, ["doc_id", "doc_start", "doc_end"]).fillna(0.0)


def answer_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _item_answers(spark, sf_dir).where("kind <> 'none'")
    return found.select("query_id", F.array_join(answers.explain(F.col("parts"), F.col("question_type")), "\n").alias("explanation"))


def fact_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.facts(spark, sf_dir).select("ord", kb.as_triple(F.col("subject"), F.col("relation"), F.col("object")).alias("triple"))


def kb_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kb_lookup(spark, sf_dir)
    return found.select("query_id", kb.explain(F.col("subject"), F.col("relation_label"), F.col("matched_cue"), F.col("object")).alias("explanation"))


def kb_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.stats(t.facts(spark, sf_dir), t.cues(spark))


def subject_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.find_subject(t.fact_questions(spark, sf_dir), t.facts(spark, sf_dir), t.aliases(spark))


def relation_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.find_relation(t.fact_questions(spark, sf_dir), t.cues(spark))


def kb_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.answer(t.fact_questions(spark, sf_dir), t.facts(spark, sf_dir), t.cues(spark), t.aliases(spark))


def question_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.questions(spark, sf_dir).select("doc_id", "sid", rules.question_type(F.col("text")).alias("question_type"))


def intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.turns(spark, sf_dir).select("conv_id", "turn", rules.intent(F.col("text")).alias("intent"))


def topic_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dialogue.described(t.turns(spark, sf_dir), t.facts(spark, sf_dir), t.aliases(spark))
    return dialogue.with_topics(rows).select("conv_id", "turn", "question", "rewritten", "topic")


def last_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dialogue.described(t.turns(spark, sf_dir), t.facts(spark, sf_dir), t.aliases(spark))
    return dialogue.last_topics(dialogue.with_topics(rows)).fillna("")


def _replies(spark: SparkSession, sf_dir: str, turns: DataFrame) -> DataFrame:
    docs = t.documents(spark, sf_dir)

    def retrieve(asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        found = ranking.asked(docs, asked)
        hits = written(ranking.top(found))
        return ranking.passage_hits(hits), ranking.passages_of(hits, docs), found.known_terms(asked)

    return dialogue.respond(turns, documents=docs, retrieve=retrieve, facts_=t.facts(spark, sf_dir), cues=t.cues(spark), aliases=t.aliases(spark), listed=t.LISTED)


def reply_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir, t.turns(spark, sf_dir))


def _dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and benchmark items as gold: each is asked in a conversation of its own, and the whole dialogue answers."""
    told = t.facts(spark, sf_dir).select(F.col("ord").alias("query_id"), F.col("object").alias("a"), F.lit(None).cast("bigint").alias("doc"), F.lit("PLACE").alias("type")).join(t.fact_questions(spark, sf_dir), "query_id")
    held = F.col("doc").isNotNull()
    read = _gold(spark, sf_dir).select((-1 - F.col("query_id")).alias("query_id"), F.when(held, F.col("text")).alias("a"), "doc", F.when(held, "OTHER").otherwise("UNANSWERABLE").alias("type"), F.concat(F.lit("Tell me of "), "text").alias("text"))
    gold = written(told.unionByName(read))
    replies = _replies(spark, sf_dir, gold.select(F.col("query_id").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), "text")).select(F.col("conv_id").alias("query_id"), "route", "reply")
    # a rank counts only where there is a gold document
    hits = _document_hits(spark, sf_dir, gold.where("doc IS NOT NULL").select("query_id", "text"))
    return metrics.evaluate(gold.withColumnRenamed("text", "q"), replies, hits)


def dialogue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.summary(_dialogue(spark, sf_dir))
    return out.select(*(F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes))


def dialogue_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.failures(_dialogue(spark, sf_dir)).select("query_id", "question_type", "route", F.round("f1", 6).alias("f1"))


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as gold: each is asked by itself, and answered by the sentence that has most of it."""
    gold = written(_gold(spark, sf_dir).select("query_id", F.col("text").alias("q"), F.when(F.col("doc").isNotNull(), F.col("text")).alias("a"), "doc", F.when(F.col("doc").isNotNull(), "DEFINITION").otherwise("UNANSWERABLE").alias("type")))
    replies = _sentence_answers(spark, sf_dir).select("query_id", F.lit("retrieval").alias("route"), F.col("text").alias("reply"))
    hits = _document_hits(spark, sf_dir, gold.where("doc IS NOT NULL").select("query_id", F.col("q").alias("text")))
    return metrics.evaluate(gold, replies, hits)


def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.summary(_evaluated(spark, sf_dir))
    return out.select(*(F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes))


def summary_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_type(_evaluated(spark, sf_dir)).select("question_type", "n", F.round("correct", 6).alias("correct"), F.round("f1", 6).alias("f1"))


def summary_by_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_route(_evaluated(spark, sf_dir))


def stream_topic_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic fold over conversations read as a stream, into a table in the shared folder."""
    from ..streaming.conversations import topics

    names = [(r["subject"], r["ord"]) for r in kb.subjects(t.facts(spark, sf_dir)).collect()]
    source = t.read(spark, sf_dir, "conversations")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/conversation[s].parquet")  # a pattern: a stream takes no single file
    live = topics(stream.where("role = 'user'").select("conv_id", "turn", "text"), names, t.ALIASES, idle_ms=None)
    path = place(spark, "topics")
    query = live.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    try:
        query.awaitTermination()  # ends by itself when all that is there has been read
    finally:
        query.stop()
    return spark.read.schema(live.schema).parquet(f"{path}/rows")


QUERIES = {f.__name__: f for f in (
    doc_admission, corpus_stats, corpus_rows, corpus_cap, corpus_fingerprint, quick_fingerprint, document_terms, document_display, sentence_spans, passage_windows, offset_violations, term_frequencies, vocabulary_idf, passage_stats, index_summary, bm25_topk, matched_terms, tfidf_topk,
    document_rank, score_explain, unknown_terms, coverage_gate, retrieval_eval, sentence_answer, answer_metrics, regex_entities, span_answer, answer_explain, fact_triples, kb_explain, kb_stats, subject_match, relation_match, kb_lookup, question_type, intent,
    topic_carry, last_topics, reply_route, dialogue_summary, dialogue_failures, evaluation_summary, summary_by_type, summary_by_route, stream_topic_state,
)}
