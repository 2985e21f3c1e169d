import json
import math

import pytest
from pyspark.sql import functions as F

from quaere.functions import text as T
from quaere.operators import answers, collection, dialogue, facts, index, metrics, passages
from quaere.params import Params
from quaere.sources import readers
from quaere.streaming.conversations import Slots

LONG = "The tower was built by Anna Berg in 1931. It stands in Oslo and has 120 rooms. Many visitors climb it on Sundays, for the view of the fjord is wide. "


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("docs")
    (folder / "01_tower.md").write_text("# Berg Tower\n\n" + LONG)
    (folder / "02_copy.txt").write_text("# Berg Tower\n\n" + LONG)
    (folder / "03_short.txt").write_text("too little")
    (folder / "04_bridge.TXT").write_text("Bridge of Moss\n" + "The bridge of Moss was opened in 1954 by Olav Dahl. It is 300 metres long. A toll was paid there until 1980, when the debt was settled. ")
    (folder / "05_skip.pdf").write_text(LONG)
    raw = readers.read_directory(spark, str(folder))
    return collection.admit(readers.as_documents(raw)).cache()


def test_admission(docs):
    got = {r.filename: (r.doc_ord, r.doc_id, r.reject_reason) for r in docs.collect()}
    assert got == {"01_tower.md": (0, "01-tower", None), "02_copy.txt": (1, None, "duplicate"), "03_short.txt": (2, None, "too short"), "04_bridge.TXT": (3, "04-bridge", None)}


def test_cap_and_names(spark):
    rows = [(k, f"text {k} " * 30, "a.txt", "bundled") for k in range(4)] + [(4, "other " * 30, "a-2.txt", "upload")]
    raw = readers.describe(spark.createDataFrame(rows, "doc_ord long, text string, filename string, source string"))
    got = {r.doc_ord: (r.doc_id, r.reject_reason) for r in collection.admit(raw, params=Params(max_docs=3)).collect()}
    assert got == {0: ("a", None), 1: ("a-2", None), 2: ("a-3", None), 3: (None, "full"), 4: (None, "full")}
    ids = [r.doc_id for r in collection.admit(raw).orderBy("doc_ord").collect()]
    assert len(set(ids)) == 5
    stats = collection.stats(collection.admit(raw)).first()
    assert (stats.documents, stats.uploaded, stats.median_words) == (5, 1, 60)


def members(docs):
    return collection.members(docs)


def test_passages(docs):
    cut = passages.passages(members(docs), params=Params(min_passage_chars=20))
    assert passages.offset_violations(cut, docs).count() == 0
    assert [r.passage_id for r in cut.where("doc_id = '01-tower'").orderBy("index").collect()] == ["01-tower::p000", "01-tower::p001"]
    with pytest.raises(ValueError):
        passages.passages(docs, params=Params(window=0))


def test_bm25_numbers(spark):
    units = spark.createDataFrame([(0, 0, "cat"), (1, 1, "dog")], "id long, o long, text string")
    units = index.units(units, "id", ["o"])
    got = index.search(spark.createDataFrame([("q", "cats")], "query_id string, text string"), index.postings(units), index.index_stats(units)).collect()
    assert [(r.unit_id, r.score, r.rank) for r in got] == [(0, round(math.log(2), 6), 1)]
    with pytest.raises(ValueError):
        index.search(units, units, units, scorer="x")
    with pytest.raises(ValueError):
        index.ranked(units, -1)


def test_search_and_answers(spark, docs):
    cut = passages.passages(members(docs))
    units = index.units(cut, "passage_id", ["doc_ord", "index"])
    posted, stats = index.postings(units).cache(), index.index_stats(units)
    asked = spark.createDataFrame([("a", "When was the Berg Tower built?"), ("b", "Who opened the bridge of Moss?"), ("c", "Who won the 2022 World Cup?"), ("d", "the of"), ("e", "Why was a toll paid?")], "query_id string, text string")
    hits = index.search(asked, posted, stats).cache()
    first = {r.query_id: r.unit_id for r in hits.where("rank = 1").collect()}
    assert first["a"].startswith("01-tower") and first["b"].startswith("04-bridge") and "d" not in first
    for r in hits.collect():
        assert abs(sum(r.term_scores.values()) - r.score) < 1e-4
    got = {r.query_id: r for r in answers.extract(asked, hits, cut).collect()}
    assert (got["a"].text, got["a"].kind) == ("1931", "span")
    assert got["b"].kind == "span" and "Olav Dahl" in got["b"].text
    assert got["c"].kind == "none" and got["d"].kind == "none"
    assert got["e"].kind == "sentence" and "toll" in got["e"].text
    texts = {r.doc_id: r.text for r in docs.where("doc_id IS NOT NULL").collect()}
    for q in "ab":
        assert texts[got[q].doc_id][got[q].doc_start : got[q].doc_end] == got[q].text
        assert abs(sum(got[q].parts.values()) - got[q].confidence) < 1e-3
    unknown = [r.term for r in index.unknown_terms(asked.where("query_id = 'c'"), posted.select("term").distinct()).orderBy("pos").collect()]
    assert unknown == ["won", "2022", "world", "cup"]


def test_proximity(spark):
    terms = F.lit(["alpha", "delta"])
    near = answers.proximity(F.lit("alpha x y z delta"), F.lit(6), F.lit(7), terms)  # distances 1 and 3
    assert abs(spark.range(1).select(near).first()[0] - 1 / 1.4) < 1e-9


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("kb") / "facts.json"
    path.write_text(json.dumps({
        "relations": [{"name": "created_by", "label": "was created by", "answer_type": "PERSON", "cues": ["who", "who wrote"]}, {"name": "created_in", "label": "was created in", "answer_type": "DATE", "cues": ["when"]}],
        "aliases": [{"alias": "The Graph", "canonical": "Moss Knowledge Graph"}],
        "facts": [{"s": "Moss", "r": "created_by", "o": "Olav", "doc": "d1"}, {"s": "Moss Knowledge Graph", "r": "created_by", "o": "Ida", "doc": "d2"}, {"s": "Moss", "r": "created_in", "o": "1954"}, {"s": "Moss", "r": "created_by", "o": "Olav Dahl", "doc": "d3"}],
    }))
    return readers.read_facts(spark, str(path))


@pytest.mark.parametrize("few", [10_000, 0])
def test_facts(spark, base, few, monkeypatch):
    monkeypatch.setattr(facts, "FEW_NAMES", few)
    asked = spark.createDataFrame([(1, "Who wrote Moss?"), (2, "who made the graph?"), (3, "When was Moss Knowledge Graph made?"), (4, "Who is Mossy?")], "query_id int, text string")
    got = {r.query_id: (r.subject, r.relation, r.matched_cue, r.object) for r in facts.answer(asked, *base).collect()}
    assert got == {1: ("Moss", "created_by", "who wrote", "Olav Dahl"), 2: ("Moss Knowledge Graph", "created_by", "who", "Ida")}


def test_dialogue(spark, docs, base):
    said = ["Hi", "Who wrote Moss?", "and when?", "thanks", "Who won the 2022 World Cup?", "", "When was the Berg Tower built?"]
    turns = spark.createDataFrame([(7, k, t) for k, t in enumerate(said)], "conv_id long, turn long, text string")
    cut = passages.passages(members(docs))
    units = index.units(cut, "passage_id", ["doc_ord", "index"])
    out = dialogue.respond(turns, documents=members(docs), passages=cut, postings=index.postings(units), stats=index.index_stats(units), facts_=base[0], cues=base[1], aliases=base[2])
    got = {r.turn: (r.route, r.topic, r.question) for r in out.collect()}
    assert got == {0: ("conversation", None, ""), 1: ("knowledge base", "Moss", "Who wrote Moss?"), 2: ("knowledge base", "Moss", "and when Moss"), 3: ("conversation", "Moss", ""), 4: ("none", "Moss", "Who won the 2022 World Cup?"), 6: ("retrieval", "Moss", "When was the Berg Tower built?")}
    assert any("2022" in r.reply for r in out.collect())
    slots = Slots([("Moss", 0), ("Moss Knowledge Graph", 1)], [("the graph", "Moss Knowledge Graph")])
    assert slots.step("and when?", "question", "Moss") == ("and when Moss", "Moss")
    assert slots.step("who made the graph?", "question", None)[1] == "Moss Knowledge Graph"
    plain = dialogue.described(turns, base[0], base[2])
    general = {r.turn: r.topic for r in dialogue.topics_by_rules(plain, [("Moss", 0)], []).collect()}
    assert general == {r.turn: r.topic for r in dialogue.with_topics(plain).collect()}


def test_evaluation(spark, tmp_path):
    (tmp_path / "gold.json").write_text(json.dumps({"pairs": [{"q": "a?", "a": "Olav Dahl", "doc": "d1", "type": "PERSON"}, {"q": "b?", "a": None, "doc": None, "type": "UNANSWERABLE"}, {"q": "c?", "a": "1954", "doc": "d9", "type": "DATE"}]}))
    gold = readers.read_gold(spark, str(tmp_path / "gold.json")).withColumnRenamed("qid", "query_id")
    replies = spark.createDataFrame([(0, "knowledge base", "Olav Dahl."), (1, "none", "no"), (2, "retrieval", "in 1955")], "query_id int, route string, reply string")
    hits = spark.createDataFrame([(0, "d2", 1), (0, "d1", 2), (2, "d3", 1)], "query_id int, doc_id string, rank int")
    out = metrics.evaluate(gold, replies, hits)
    s = metrics.summary(out).first()
    assert (s.questions, s.answerable, s.recall_at_k, s.mrr, s.exact_match, s.refusal_accuracy) == (3, 2, 0.5, 0.25, 0.5, 1.0)
    assert abs(s.overall - 2 / 3) < 1e-9 and metrics.failures(out).count() == 1
    assert [r.question_type for r in metrics.by_type(out).collect()] == ["DATE", "PERSON", "UNANSWERABLE"]
    assert metrics.summary(out.where("false")).first().overall == 0.0


def test_order_of_files(spark):
    names = [f"{k * 7919 % 1000:04d}.txt" for k in range(1000)]
    rows = spark.createDataFrame([(n, "x") for n in names], "path string, raw string").repartition(7)
    assert [r.path for r in readers.with_order(rows, "path").orderBy("doc_ord").collect()] == sorted(names)
    assert [r.doc_ord for r in readers.with_order(rows, "path").orderBy("path").collect()] == list(range(1000))
    assert readers.with_order(rows.where("false"), "path").count() == 0


def test_normal_texts(spark):
    rows = ["plain  a\tb\r\nc", "ﬁne\u00a0\u00a0½", None, "", "a\n\n\n\nb "]
    made = spark.createDataFrame([(x,) for x in rows], "t string").select(T.normalise(F.col("t"))).collect()
    assert [r[0] for r in made] == ["plain a b\nc", "fine 1⁄2", None, "", "a\n\nb"]


def test_uploads_are_admitted_and_written(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b.txt").write_text(LONG)
    (tmp_path / "in" / "c.md").write_text("short")
    query = readers.uploads(spark, str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "raw")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    raw = readers.with_order(spark.read.parquet(str(tmp_path / "raw")), "path")
    own = collection.members(collection.admit(readers.as_documents(raw)))
    assert [(r.doc_id, r.file, r.source) for r in collection.rows(own).collect()] == [("a-b", "a b.txt", "upload")]
    assert collection.remove(own, own.select("doc_id")).count() == 0
    readers.write_texts(own, str(tmp_path / "out"))
    got = spark.read.text(str(tmp_path / "out"), wholetext=True).collect()
    assert [(r.file, r.value.strip()) for r in got] == [("a b.txt", LONG.strip())]


def test_index_grows_and_shrinks(spark):
    rows = [(0, "cats and dogs"), (1, "a dog"), (2, "birds")]
    made = lambda part: index.units(spark.createDataFrame(part, "id long, text string"), "id", ["id"])
    whole = index.postings(made(rows))
    grown = index.add_documents(index.postings(made(rows[:2])), made(rows[2:]))
    key = ["term", "unit_id", "tf", "length"]
    assert sorted(map(tuple, grown.select(key).collect())) == sorted(map(tuple, whole.select(key).collect()))
    less = index.remove_documents(whole, made(rows[:1]))
    assert sorted({r.unit_id for r in less.collect()}) == [1, 2]


def test_facts_about(spark, base):
    got = facts.facts_about(base[0], "moss").orderBy("ord").collect()
    assert [(r.relation, r.object) for r in got] == [("created_by", "Olav"), ("created_in", "1954"), ("created_by", "Olav Dahl")]
