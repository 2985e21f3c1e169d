from pyspark.sql import functions as F

from quaere.functions import rules as R
from quaere.functions import spans as S
from quaere.functions import text as T


def row(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first())


def test_stems(spark):
    words = {"normalises": "normalis", "normalised": "normalis", "normalisation": "normalis", "functions": "function", "developed": "develop", "retrieving": "retriev", "retrieve": "retrieve", "turing": "turing", "turing's": "turing'", "ties": "tie", "boxes": "box", "analysis": "analysis", "bm25": "bm25", "rise": "rise"}
    assert row(spark, *(T.stem(F.lit(w)) for w in words)) == tuple(words.values())


def test_terms(spark):
    (terms,) = row(spark, T.analyze(F.lit("Who developed the BM25 ranking functions at City University?")))
    assert terms == ["develop", "bm25", "rank", "function", "city", "university"]
    assert row(spark, T.analyze(F.lit("the of and")), T.tokens(F.lit("State-of-the-art, Turing's 3")))[:2] == ([], ["state-of-the-art", "turing's", "3"])


def test_sentences(spark):
    text = 'Dr. Smith came e.g. late. George A. Miller began. "Yes." Then left.\n\n# Head\n \nLast one... and more? 😀é End'
    (found,) = row(spark, S.sentence_texts(F.lit(text)))
    assert found == ["Dr. Smith came e.g. late.", "George A. Miller began.", '"Yes."', "Then left.", "# Head", "Last one... and more?", "😀é End"]
    (spans,) = row(spark, S.sentences(F.lit(text)))
    assert [text[s.start : s.end] for s in spans] == found
    assert row(spark, S.sentences(F.lit("")), S.sentences(F.lit("  "))) == ([], [])


def test_entities(spark):
    text = "In 1966 Joseph Weizenbaum wrote 3,000 lines. Rather short."
    (found,) = row(spark, S.entities(F.lit(text)))
    assert [(e.text, e.label) for e in found] == [("1966", "DATE"), ("3,000", "CARDINAL"), ("Joseph Weizenbaum", "PROPN")]
    assert all(text[e.start : e.end] == e.text for e in found)


def test_rules(spark):
    asked = {"How many are there?": "NUMBER", "Who wrote it?": "PERSON", "In what year?": "DATE", "Where is it": "PLACE", "Which company?": "ORG", "What is a synset?": "DEFINITION", "Why so?": "EXPLANATION", "Which algorithm ranks best of all those?": "TITLE", "Tell me": "OTHER"}
    assert row(spark, *(R.question_type(F.lit(q)) for q in asked)) == tuple(asked.values())
    said = {"Hi there": "greeting", "bye": "farewell", "thanks!": "thanks", "help me": "help", "which documents?": "documents", "who?": "question"}
    assert row(spark, *(R.intent(F.lit(q)) for q in said)) == tuple(said.values())
    assert row(spark, R.resolved(F.lit("and when?"), F.lit("ELIZA")), R.resolved(F.lit("Who built it, and its x?"), F.lit("$1\\")), R.resolved(F.lit("who?"), F.lit(None).cast("string"))) == ("and when ELIZA", "Who built $1\\, and its x?", "who?")


def test_answer_metrics(spark):
    f1 = lambda a, b: R.token_f1(F.lit(a), F.lit(b))
    assert row(spark, f1("Stephen Robertson", "Stephen Robertson and Karen Sparck Jones"), f1("", "the"), f1("x", ""), f1("a b b", "b b c")) == (0.5, 1.0, 0.0, 0.8)
    assert row(spark, R.exact_match(F.lit("the Journal, of X"), F.lit("Journal of x")), R.contains_gold(F.lit("it is 117,000."), F.lit("117000"))) == (1.0, 1.0)


def test_display(spark):
    assert row(spark, T.title(F.lit("x\n# Hello  \ny"), F.lit("a.md")), T.title(F.lit("\n ## sub\n"), F.lit("a.md")), T.title(F.lit("\n"), F.lit("a_b-c.md")), T.slug(F.lit("/x/My File.md")), T.slug(F.lit("??.md"))) == ("Hello", "sub", "A B C", "my-file", "doc")
    assert row(spark, T.preview(F.lit("# T\n\nbody  here"), 6), T.mark_answer(F.lit("a <b> & <b>"), F.lit("<b>")), T.normalise(F.lit("ﬁ\r\nx\t\ty\n\n\n\nz "))) == ("body…", "a <mark>&lt;b&gt;</mark> &amp; &lt;b&gt;", "fi\nx y\n\nz")


def test_sentences_of_texts_with_control_characters(spark):
    text = "One two.\x01 Three four. Five six. \x01\n\nEnd"
    got = spark.createDataFrame([(text,), ("",), (None,), ("Of Dr. ",), ("  ",)], "t string").select(S.sentences(F.col("t")).alias("s")).collect()
    assert [[text[x.start : x.end] for x in got[0].s]] == [["One two.\x01 Three four.", "Five six.", "\x01", "End"]]
    assert [[(x.start, x.end) for x in r.s] for r in got[1:]] == [[], [], [(0, 6)], []]
