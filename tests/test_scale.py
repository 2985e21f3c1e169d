"""What queries take must not grow with all sentences or all postings: plain twins, exact ranking."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quaere import plans
from quaere.functions import plain, spans
from quaere.functions import text as T
from quaere.operators import collection, index, passages, ranking

SF = "/root/testdata/sf0.001"
PARTS = ["a", "B", "e.g", "Dr", "etc", "J", ".", "!", "?", " ", "  ", "\n", "\n\n", "\r\n", "\x85", "\xa0", "\x1c", '"', ")", "é", "ª", "ß", "3", "'", "’", "-", "running", "classes", "organised", "𝒳", " and ", "..."]


@pytest.fixture(scope="module")
def texts():
    made = random.Random(5)
    return ["".join(made.choice(PARTS) for _ in range(made.randint(0, 60))) for _ in range(600)] + ["", None, "x" * 100 + ". y", "a" + "." * 80 + "etc. Foo Bar. " * 9]


def test_plain_twins(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in docs.select("text", spans.sentences(F.col("text")).alias("s"), passages.windows(F.col("text")).alias("w"), T.analyze(F.col("text")).alias("t")).collect():
        found = plain.sentences(r.text)
        assert found == [(x.start, x.end) for x in r.s]
        assert [(found[a][0], found[b - 1][1]) for a, b in plain.windows(found)] == [(x.start, x.end) for x in r.w]
        codes = plain.Codes({t: k for k, t in enumerate(sorted(set(r.t or [])))})
        assert [c for c in codes.of(r.text or "", 0, len(r.text or "")) if c > -2] == [codes.asked[t] for t in r.t or []]


@pytest.mark.parametrize("whole", [True, False])
def test_ranking_is_that_of_the_index(spark, texts, whole, monkeypatch):
    monkeypatch.setattr(ranking, "_UNITS", 50)
    monkeypatch.setattr(ranking, "_DOCS", 7)
    docs = spark.createDataFrame([(k, k, "t", x) for k, x in enumerate(texts)] + [(2000 + k, 2000 + k, "t", "Etc runs. " * 12) for k in range(30)], "doc_id long, doc_ord long, title string, text string").repartition(3)
    asked = spark.createDataFrame([(f"q{k}", x) for k, x in enumerate(texts[:40])] + [("tie", "runs"), ("none", "the of"), ("unknown", "zebra runs"), ("null", None)], "query_id string, text string")
    if whole:
        units = index.units(docs.where("text IS NOT NULL"), "doc_id", ["doc_ord"])
        docs = docs.where("text IS NOT NULL")
    else:
        units = index.units(passages.passages(docs), "passage_id", ["doc_ord", "index", "doc_id"])
    posted = index.postings(units).cache()
    want = index.top(asked, posted, index.index_stats(units)).collect()
    found = ranking.asked(docs, asked, whole=whole)
    hits = ranking.top(found)
    got = (hits.withColumn("unit_id", F.col("doc_id")) if whole else ranking.passage_hits(hits)).collect()
    key = lambda r: (r.query_id, r["rank"], r.unit_id, r.score)
    assert len(want) > 100 and sorted(map(key, got)) == sorted(map(key, want))
    assert {r.term for r in found.known_terms(docs).collect()} == {r.term for r in index.known_terms(asked, posted.select("term").distinct()).collect()}
    if not whole:
        cut = {(r.passage_id, r.doc_id, r.doc_title, r.text, r.start) for r in passages.passages(docs).collect()}
        assert {tuple(r) for r in ranking.passages_of(hits, docs).collect()} <= cut


def test_ranking_of_nothing(spark):
    none = spark.createDataFrame([], "query_id long, text string")
    docs = spark.createDataFrame([(1, 1, "t", "some text")], "doc_id long, doc_ord long, title string, text string")
    assert ranking.top(ranking.asked(docs, none)).count() == 0
    assert ranking.top(ranking.asked(docs.where("false"), none.union(spark.createDataFrame([(1, "text")], none.schema)))).count() == 0
    with pytest.raises(ValueError):
        ranking.top(ranking.asked(docs, none), k=0)


def test_holders(spark):
    docs = spark.createDataFrame([(1, "so one two  three four"), (2, "one twothree"), (3, "x one two"), (4, None), (5, "a  b")], "doc_id long, body string")
    items = spark.createDataFrame([(1, "one two  three"), (2, "one two"), (3, "ne two"), (4, "  "), (5, "so one two  t")], "query_id long, text string")
    got = sorted(map(tuple, collection.holders(docs, items).collect()))
    assert got == sorted((q.query_id, d.doc_id) for q in items.collect() for d in docs.collect() if d.body and q.text in d.body)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["answer_explain", "span_answer", "answer_metrics", "evaluation_summary", "summary_by_route", "reply_route", "dialogue_summary", "dialogue_failures"])
def test_answers_need_no_postings_of_all_terms(spark, name, monkeypatch):
    def whole(*_, **__):
        raise AssertionError("the whole collection was cut or posted")

    monkeypatch.setattr(passages, "passages", whole)
    monkeypatch.setattr(index, "postings", whole)
    assert plans.QUERIES[name](spark, SF).columns
