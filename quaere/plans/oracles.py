"""The queries in DuckDB SQL."""

from __future__ import annotations

from ..functions.rules import INTENT_RULES, LABELS, PRONOUNS, PUNCTUATION, QUESTION_ONLY, QUESTION_RULES
from ..functions.spans import ABBREVIATIONS, NAME, NUMBER, YEAR
from ..functions.text import STOPWORDS, TOKEN, quoted, stem_sql
from ..operators.dialogue import SMALL_TALK
from ..params import DEFAULTS as P
from .tables import ALIASES, CAP, CUES, FOLLOW_UPS, ITEM_QUESTIONS, KINDS, LISTED


def s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {s(TOKEN)}), lambda t: lower(t))"


def analyzed(x: str) -> str:
    return f"list_filter(list_transform(list_filter({tokens(x)}, lambda t: t NOT IN ({quoted(STOPWORDS)})), lambda t: {stem_sql('t')}), lambda t: t <> '')"


def stripped(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def flat(x: str) -> str:
    return stripped(rf"regexp_replace({x}, '\s+', ' ', 'g')")


DOCS = f"""described AS (
  SELECT doc_id AS doc_ord, text, source, source AS slug, substr(sha256(text), 1, 16) AS checksum, length(text) AS char_count, len({tokens('text')}) AS word_count,
    CASE WHEN length(text) < {P.min_doc_chars} THEN 'too short' WHEN length(text) > {P.max_doc_chars} THEN 'too long' END AS reject_reason
  FROM documents),
marked AS (SELECT d.* EXCLUDE (reject_reason), coalesce(d.reject_reason, CASE WHEN doc_ord > min(CASE WHEN d.reject_reason IS NULL THEN doc_ord END) OVER (PARTITION BY checksum) THEN 'duplicate' END) AS reject_reason FROM described d),
members AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY doc_ord) AS n FROM marked WHERE reject_reason IS NULL)"""

#: A document's pieces, where its sentences end, and its sentences.
SENTENCES = rf"""pieces AS (
  SELECT doc_id, unnest(range(0, len(p))) AS k, unnest(p) AS piece, len(p) AS n
  FROM (SELECT doc_id, string_split(regexp_replace(text, '(\n\s*\n|[.!?]+["'')\]]*\s+)', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents WHERE length(text) > 0)),
ending AS (
  SELECT doc_id, k, piece, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place,
    regexp_matches(piece, '\n\s*\n\s*$') OR NOT (
      rtrim(lower(regexp_extract(regexp_replace(piece, '[.!?]+["'')\]]*\s+$', ''), '([A-Za-z][A-Za-z.]*)$', 1)), '.') IN ({quoted(ABBREVIATIONS)})
      OR regexp_matches(regexp_extract(regexp_replace(piece, '[.!?]+["'')\]]*\s+$', ''), '([A-Za-z][A-Za-z.]*)$', 1), '^[A-Z]$')
      OR regexp_matches(coalesce(lead(piece) OVER (PARTITION BY doc_id ORDER BY k), ''), '^[\p{{Ll}}ªº]')) AS ends
  FROM pieces),
grouped AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM ending),
raw_sentences AS (SELECT doc_id, g, min(place) AS place, string_agg(piece, '' ORDER BY k) AS raw FROM grouped GROUP BY doc_id, g),
sentences AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS sid, (place + length(raw) - length(l))::INT AS "start", (place + length(raw) - length(l) + length({stripped('raw')}))::INT AS "end"
  FROM (SELECT *, regexp_replace(raw, '^\s+', '') AS l FROM raw_sentences) WHERE length({stripped('raw')}) > 0)"""

PASSAGES = f"""{SENTENCES},
windows AS (
  SELECT doc_id, sid, "start", max("end") OVER w AS "end", count(*) OVER w AS n_sentences, count(*) OVER (PARTITION BY doc_id) AS n
  FROM sentences WINDOW w AS (PARTITION BY doc_id ORDER BY sid ROWS BETWEEN CURRENT ROW AND {P.window - 1} FOLLOWING)),
starting AS (SELECT *, "end" - "start" >= {P.min_passage_chars} AS long FROM windows WHERE sid % {P.stride} = 0 AND (sid = 0 OR sid - {P.stride} + {P.window} < n)),
kept AS (SELECT * FROM (SELECT *, bool_or(long) OVER (PARTITION BY doc_id) AS any_long, max(sid) OVER (PARTITION BY doc_id) AS last FROM starting) WHERE long OR (NOT any_long AND sid = last)),
passages AS (
  SELECT format('{{}}::p{{:03d}}', k.doc_id, nth) AS passage_id, k.doc_id, substr(text, "start" + 1, "end" - "start") AS text, "start", "end", nth::INT AS "index", n_sentences::INT AS n_sentences
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sid) - 1 AS nth FROM kept) k JOIN documents d ON d.doc_id = k.doc_id)"""


def indexed(unit: str, source: str, queries: str = "benchmark", key: str = "item_id") -> str:
    """Tables of an index over ``source``, whose units are named by ``unit``, and what ``queries`` find in it."""
    return f"""analyzed AS (SELECT {unit}, {analyzed('text')} AS terms FROM {source}),
sizes AS (SELECT {unit}, len(terms) AS length FROM analyzed),
stats AS (SELECT count(*) AS n, coalesce(avg(length), 0.0::DOUBLE) AS avg_length FROM sizes),
postings AS (SELECT term, {unit}, count(*) AS tf FROM (SELECT {unit}, unnest(terms) AS term FROM analyzed) GROUP BY ALL),
vocabulary AS (SELECT term, df, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf, ln(n::DOUBLE / df) AS idf_tfidf FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), stats),
norms AS (SELECT {unit}, CASE WHEN sum(w * w) = 0 THEN 1.0::DOUBLE ELSE sqrt(sum(w * w)) END AS norm FROM (SELECT {unit}, (1 + ln(tf)) * idf_tfidf AS w FROM postings JOIN vocabulary USING (term)) GROUP BY {unit}),
asked AS (SELECT DISTINCT query_id, term FROM (SELECT {key} AS query_id, unnest({analyzed('text')}) AS term FROM {queries})),
parts AS (
  SELECT query_id, {unit}, term, tf, df, idf, idf * tf * ({P.k1}::DOUBLE + 1) / (tf + {P.k1}::DOUBLE * (1 - {P.b}::DOUBLE + {P.b}::DOUBLE * length / avg_length)) AS bm25, (1 + ln(tf)) * idf_tfidf * idf_tfidf / norm AS tfidf
  FROM asked JOIN postings USING (term) JOIN vocabulary USING (term) JOIN sizes USING ({unit}) JOIN norms USING ({unit}), stats)"""


def hits(unit: str, order: str, scorer: str = "bm25", k: int = P.top_k) -> str:
    return f"""hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {order})::INT AS rank FROM (SELECT query_id, {unit}, round(sum({scorer}), 6) AS score, string_agg(term, ' ' ORDER BY term) AS terms FROM parts GROUP BY query_id, {unit})) WHERE rank <= {k})"""


DOCUMENT_INDEX = indexed("doc_id", "documents")


def passage_index(queries: str = "benchmark", key: str = "item_id") -> str:
    return f"{PASSAGES}, {indexed('passage_id', 'passages', queries, key)}"


PASSAGE_INDEX = passage_index()
PASSAGE_ORDER = "split_part(passage_id, '::p', 1)::BIGINT, split_part(passage_id, '::p', 2)::BIGINT"
GOLD = "gold AS (SELECT b.item_id AS query_id, b.text, min(d.doc_id) AS doc FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY ALL)"


def overlap(terms: str, text: str) -> str:
    return f"(CASE WHEN len({terms}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({terms}, list_distinct({analyzed(text)})))::DOUBLE / len({terms}) END)"


def sentence_answers(queries: str = "benchmark", key: str = "item_id") -> str:
    """Sentences of the passages that a question's coverage lets through, scored; the best of each question."""
    return rf"""{passage_index(queries, key)}, {hits('passage_id', PASSAGE_ORDER)},
evident AS (SELECT h.query_id, h.passage_id, h.rank, h.score / CASE WHEN max(h.score) OVER (PARTITION BY h.query_id) = 0 THEN 1.0::DOUBLE ELSE max(h.score) OVER (PARTITION BY h.query_id) END AS evidence FROM hits h),
considered AS (SELECT e.*, p.doc_id, p.text, p."start" AS place_0, list_distinct({analyzed('b.text')}) AS terms FROM evident e JOIN passages p USING (passage_id) JOIN {queries} b ON b.{key} = e.query_id WHERE rank <= {P.extract_from}),
gated AS (SELECT * FROM considered WHERE {overlap('terms', 'text')} >= {P.min_coverage}),
p_pieces AS (SELECT query_id, passage_id, unnest(range(0, len(p))) AS k, unnest(p) AS piece FROM (SELECT query_id, passage_id, string_split(regexp_replace(text, '(\n\s*\n|[.!?]+["'')\]]*\s+)', '\1' || chr(1), 'g'), chr(1)) AS p FROM gated)),
p_ending AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY query_id, passage_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place,
    regexp_matches(piece, '\n\s*\n\s*$') OR NOT (
      rtrim(lower(regexp_extract(regexp_replace(piece, '[.!?]+["'')\]]*\s+$', ''), '([A-Za-z][A-Za-z.]*)$', 1)), '.') IN ({quoted(ABBREVIATIONS)})
      OR regexp_matches(regexp_extract(regexp_replace(piece, '[.!?]+["'')\]]*\s+$', ''), '([A-Za-z][A-Za-z.]*)$', 1), '^[A-Z]$')
      OR regexp_matches(coalesce(lead(piece) OVER (PARTITION BY query_id, passage_id ORDER BY k), ''), '^[\p{{Ll}}ªº]')) AS ends
  FROM p_pieces),
p_grouped AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY query_id, passage_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM p_ending),
p_raw AS (SELECT query_id, passage_id, g, min(place) AS place, string_agg(piece, '' ORDER BY k) AS raw FROM p_grouped GROUP BY ALL),
p_sentences AS (SELECT query_id, passage_id, row_number() OVER (PARTITION BY query_id, passage_id ORDER BY g) - 1 AS nth, place + length(raw) - length(regexp_replace(raw, '^\s+', '')) AS a, {stripped('raw')} AS sentence FROM p_raw WHERE length({stripped('raw')}) > 0),
p_typed AS (SELECT *, lead(a + length(sentence)) OVER (PARTITION BY query_id, passage_id ORDER BY nth) AS next_end FROM (SELECT *, a AS b FROM p_sentences)),
p_scored AS (SELECT s.*, g.doc_id, g.text, g.place_0, g.rank, round({P.w_evidence}::DOUBLE * evidence + {P.w_type + P.w_context}::DOUBLE * {overlap('g.terms', 's.sentence')}, 6) AS total FROM p_typed s JOIN gated g USING (query_id, passage_id)),
answers AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, rank, nth) AS best FROM p_scored) WHERE best = 1)"""


def question_type(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {s(p)}) THEN '{name}'" for p, name, _, _ in QUESTION_RULES) + " ELSE 'OTHER' END"


def intent(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {s(p)}) THEN '{name}'" for name, p in INTENT_RULES) + " ELSE 'question' END"


#: An answer, where a question of a sentence-shaped type takes a short sentence's successor along.
ANSWER = f"CASE WHEN {question_type('lower(' + stripped('b.text') + ')')} IN ('DEFINITION', 'EXPLANATION') AND length(sentence) < 130 AND next_end IS NOT NULL THEN next_end ELSE a.a + length(sentence) END"


def words(x: str) -> str:
    """Words of a normal form; articles stand alone once punctuation has gone."""
    return f"list_filter(string_split({flat(f'translate(lower({x}), {s(PUNCTUATION)}, {s(str())})')}, ' '), lambda w: w NOT IN ('', 'a', 'an', 'the'))"


def normal(x: str) -> str:
    return f"array_to_string({words(x)}, ' ')"


def predicted(queries: str = "benchmark", key: str = "item_id") -> str:
    return f"""{sentence_answers(queries, key)},
predicted AS (SELECT a.query_id, regexp_replace(regexp_replace(substr(a.text, a.a::INT + 1, ({ANSWER})::INT - a.a::INT), '^[# ]+', ''), '^\\s+|\\s+$', '', 'g') AS text, total, a.doc_id, passage_id, (place_0 + a.a)::INT AS doc_start, (place_0 + {ANSWER})::INT AS doc_end FROM answers a JOIN {queries} b ON b.{key} = a.query_id)"""


METRICS = f"""{predicted()},
pairs AS (SELECT query_id, p.text AS predicted, b.text AS gold, {words('p.text')} AS pw, {words('b.text')} AS gw FROM predicted p JOIN benchmark b ON b.item_id = query_id),
common AS (SELECT query_id, sum(least(p, g)) AS n FROM (SELECT query_id, w, count(*) AS p FROM (SELECT query_id, unnest(pw) AS w FROM pairs) GROUP BY ALL) JOIN (SELECT query_id, w, count(*) AS g FROM (SELECT query_id, unnest(gw) AS w FROM pairs) GROUP BY ALL) USING (query_id, w) GROUP BY query_id),
measured AS (SELECT query_id, ({normal('predicted')} = {normal('gold')})::INT::DOUBLE AS exact_match, CASE WHEN len(pw) = 0 OR len(gw) = 0 THEN (len(pw) = len(gw))::INT::DOUBLE ELSE 2.0::DOUBLE * coalesce(n, 0) / (len(pw) + len(gw)) END AS f1, contains({normal('predicted')}, {normal('gold')})::INT::DOUBLE AS contains FROM pairs LEFT JOIN common USING (query_id))"""

def document_hits(asked: str) -> str:
    """``d_hits``: documents ranked for the terms of ``asked(query_id, term)``."""
    return f"""d_analyzed AS (SELECT doc_id, {analyzed('text')} AS terms FROM documents), d_sizes AS (SELECT doc_id, len(terms) AS length FROM d_analyzed), d_stats AS (SELECT count(*) AS n, avg(length) AS avg_length FROM d_sizes),
d_postings AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d_analyzed) GROUP BY ALL), d_vocabulary AS (SELECT term, count(*) AS df FROM d_postings GROUP BY term),
d_hits AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * ({P.k1}::DOUBLE + 1) / (tf + {P.k1}::DOUBLE * (1 - {P.b}::DOUBLE + {P.b}::DOUBLE * length / avg_length))), 6) AS score FROM {asked} JOIN d_postings USING (term) JOIN d_vocabulary USING (term) JOIN d_sizes USING (doc_id), d_stats GROUP BY query_id, doc_id))"""


EVALUATED = f"""{METRICS}, {GOLD},
{document_hits('asked')},
results AS (
  SELECT g.query_id, g.doc IS NOT NULL AS answerable, CASE WHEN g.doc IS NOT NULL THEN 'DEFINITION' ELSE 'UNANSWERABLE' END AS question_type, CASE WHEN p.query_id IS NULL THEN 'none' ELSE 'retrieval' END AS route, p.query_id IS NULL AS refused,
    CASE WHEN g.doc IS NOT NULL THEN coalesce(m.exact_match, 0) ELSE 0.0 END AS em, CASE WHEN g.doc IS NOT NULL THEN coalesce(m.f1, 0) ELSE 0.0 END AS f1, CASE WHEN g.doc IS NOT NULL THEN coalesce(m.contains, 0) ELSE 0.0 END AS contains,
    CASE WHEN g.doc IS NOT NULL AND h.rank <= {P.top_k} THEN h.rank END AS doc_rank
  FROM gold g LEFT JOIN predicted p USING (query_id) LEFT JOIN measured m USING (query_id) LEFT JOIN d_hits h ON h.query_id = g.query_id AND h.doc_id = g.doc),
correct AS (SELECT *, CASE WHEN answerable THEN contains > 0 OR em > 0 ELSE refused END AS correct FROM results)"""

FACTS = """facts AS (
  SELECT n_nationkey::BIGINT AS ord, n_name AS subject, 'located_in' AS relation, r_name AS object, 'located_in' AS doc_id FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT s_suppkey + 1000, s_name, 'based_in', n_name, 'based_in' FROM supplier JOIN nation ON s_nationkey = n_nationkey),
cues AS (SELECT * FROM (VALUES {cues}) v(rel_ord, relation, label, cue_ord, cue)), aliases AS (SELECT * FROM (VALUES {aliases}) v(ord, alias, canonical)),
questions AS (
  SELECT ord AS query_id, CASE WHEN relation = 'located_in' THEN 'Where is ' || subject || ' located?' ELSE 'Which country is ' || subject || ' based in?' END AS text FROM facts
  UNION ALL SELECT ord - 10, 'Which region has ' || alias || '?' FROM aliases)""".format(
    cues=", ".join(f"({r}, {s(a)}, {s(b)}, {c}, {s(cue)})" for r, (a, b, found) in enumerate(CUES) for c, cue in enumerate(found)),
    aliases=", ".join(f"({k}, {s(a)}, {s(c)})" for k, (a, c) in enumerate(ALIASES)),
)


def subjects_of(source: str, key: str) -> str:
    """``found``: the subject that each text of ``source(key, text)`` names."""
    return rf"""by_alias AS (SELECT * FROM (SELECT {key}, alias, canonical, row_number() OVER (PARTITION BY {key} ORDER BY length(alias) DESC, ord) AS nth FROM {source} JOIN aliases ON regexp_matches(lower(text), '\b' || regexp_escape(alias) || '\b')) WHERE nth = 1),
replaced AS (SELECT q.{key}, CASE WHEN alias IS NULL THEN lower(text) ELSE replace(lower(text), alias, lower(canonical)) END AS text FROM {source} q LEFT JOIN by_alias USING ({key})),
subjects AS (SELECT subject, min(ord) AS ord FROM facts GROUP BY subject),
found AS (SELECT {key}, subject FROM (SELECT {key}, subject, row_number() OVER (PARTITION BY {key} ORDER BY length(subject) DESC, ord) AS nth FROM replaced JOIN subjects ON contains(text, lower(subject)) AND regexp_matches(text, '\b' || regexp_escape(lower(subject)) || '\b')) WHERE nth = 1)"""


def relations_of(source: str) -> str:
    """``related``: the relation that each text of ``source(query_id, text)`` asks for."""
    return f"related AS (SELECT * EXCLUDE (nth) FROM (SELECT query_id, relation, label, cue, row_number() OVER (PARTITION BY query_id ORDER BY length(cue) DESC, rel_ord, cue_ord) AS nth FROM {source} JOIN cues ON contains(lower(text), cue)) WHERE nth = 1)"


RELATIONS = relations_of("questions")
LAST = "last AS (SELECT lower(subject) AS low, relation, arg_max(object, ord) AS object, arg_max(doc_id, ord) AS doc_id FROM facts GROUP BY ALL)"

_MORE = " UNION ALL ".join(f"SELECT conv_id, {turn}, {s(head)}" + ("" if tail is None else f" || 'NATION_' || (conv_id % 25) || {s(tail)}") + " FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user')" for turn, head, tail in FOLLOW_UPS)
TURNS = f"turns AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' UNION ALL {_MORE})"


def short(x: str, limit: int) -> str:
    return rf"CASE WHEN length({x}) <= {limit} THEN {x} ELSE regexp_replace(substr({x}, 1, {limit - 1}), '\s+$', '') || '…' END"


_HEADING = stripped(r"regexp_extract(substr(text, 1, 400), '(?m)^#\s+(.+?)\s*$', 1)")
_LINE = "substr(" + stripped(r"regexp_extract(text, '(?m)^[ \t]*#*[ \t]*([^#\s].*)$', 1)") + ", 1, 120)"
_BODY = flat(r"regexp_replace(text, '\A#\s+(.+?)[ \t]*(?:\n\s*|\z)', '')")
_PLAIN = f"replace(array_to_string(list_filter(string_split({flat('text')}, ' '), lambda w: trim(w, '#') <> ''), ' '), '# ', '')"
DISPLAY = f"SELECT doc_id, title, {short('body', 180)} AS preview, {short('plain', 240)} AS snippet FROM (SELECT doc_id, coalesce(nullif({_HEADING}, ''), nullif({_LINE}, ''), 'Document') AS title, {_BODY} AS body, {_PLAIN} AS plain FROM documents)"

#: Letters beyond ASCII: at the edge of a word they count as its part.
_LETTERS = "[ªµºÀ-ÖØ-öø-ʸͰ-῿぀-퟿]"


def found(pattern: str, kind: int, label: str) -> str:
    """Matches of a pattern in ``t(doc_id, text, ascii)`` with their places, by marks around them."""
    marked = f"string_split(regexp_replace(ascii, {s('(' + pattern.removeprefix('(?U)') + ')')}, chr(1) || '\\1' || chr(2), 'g'), chr(1))"
    placed = f"SELECT doc_id, text, k, piece, coalesce(sum(length(piece) - (k > 0)::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS a FROM (SELECT doc_id, text, unnest(range(0, len(p))) AS k, unnest(p) AS piece FROM (SELECT doc_id, text, {marked} AS p FROM t))"
    return f"SELECT doc_id, text AS body, {kind} AS kind, '{label}' AS label, a, a + length(split_part(piece, chr(2), 1))::INT AS b FROM ({placed}) WHERE k > 0"


def entities(source: str, key: str = "doc_id") -> str:
    """``whole``: the entities of the texts of ``source(key, text)``."""
    return f"""t AS (SELECT {key + " AS doc_id" if key != "doc_id" else key}, text, regexp_replace(text, '{_LETTERS}', '_', 'g') AS ascii FROM {source} WHERE text IS NOT NULL),
years AS ({found(YEAR, 0, 'DATE')}), numbers AS ({found(NUMBER, 1, 'CARDINAL')}), names AS ({found(NAME, 2, 'PROPN')}),
whole AS (
  SELECT * FROM years
  UNION ALL SELECT * FROM numbers n WHERE NOT EXISTS (SELECT 1 FROM years y WHERE y.doc_id = n.doc_id AND n.a >= y.a AND n.a < y.b)
  UNION ALL SELECT * FROM names WHERE contains(substr(body, a + 1, b - a), ' ') OR NOT (a = 0 OR substr(body, CASE WHEN a = 1 THEN length(body) ELSE a - 1 END, 1) IN ('.', '!', '?')))"""


ENTITIES = entities("documents")
_FIT = "CASE " + " ".join((f"WHEN qtype = '{k}' AND label IN ({quoted(v)}) THEN 1.0::DOUBLE" if v else f"WHEN qtype = '{k}' THEN 0.4::DOUBLE") for k, v in LABELS.items()) + " WHEN label = 'PROPN' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"
_TITLE = f"coalesce(nullif({_HEADING}, ''), nullif({_LINE}, ''), 'Document')"


def extracted(queries: str) -> str:
    """``extracted``: the answer to each question of ``queries(query_id, text)`` that has one, a span or else a sentence."""
    words_ = f"string_split(regexp_replace(sentence, {s('(' + TOKEN + ')')}, chr(1) || '\\1' || chr(2), 'g'), chr(1))"
    return f"""{predicted(queries, 'query_id')},
typed AS (SELECT query_id, {question_type('lower(' + stripped('text') + ')')} AS qtype FROM {queries}),
{entities('(SELECT DISTINCT passage_id, text FROM gated)', 'passage_id')},
named AS (SELECT doc_id AS passage_id, row_number() OVER (PARTITION BY doc_id ORDER BY kind, a) - 1 AS e_nth, label, a AS e_a, b AS e_b, substr(body, a + 1, b - a) AS entity FROM whole),
fitting AS (SELECT *, {_FIT} AS fit FROM gated JOIN typed USING (query_id) JOIN named USING (passage_id) WHERE qtype NOT IN ('DEFINITION', 'EXPLANATION')),
placed AS (SELECT f.*, coalesce(x.a, 0) AS s_a, coalesce(x.sentence, f.text) AS sentence FROM fitting f LEFT JOIN p_sentences x ON x.query_id = f.query_id AND x.passage_id = f.passage_id AND x.a <= f.e_a AND f.e_a < x.a + length(x.sentence) WHERE fit > 0),
w_pieces AS (SELECT passage_id, s_a, unnest(range(0, len(p))) AS k, unnest(p) AS piece FROM (SELECT passage_id, s_a, {words_} AS p FROM (SELECT DISTINCT passage_id, s_a, sentence FROM placed))),
w_placed AS (SELECT *, coalesce(sum(length(piece) - (k > 0)::INT) OVER (PARTITION BY passage_id, s_a ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM w_pieces),
w AS (SELECT passage_id, s_a, k AS i, a, a + length(split_part(piece, chr(2), 1)) AS b, {stem_sql("lower(split_part(piece, chr(2), 1))")} AS term FROM w_placed WHERE k > 0),
covered AS (SELECT query_id, passage_id, e_nth, min(i) AS low, max(i) AS high FROM placed p JOIN w USING (passage_id, s_a) WHERE w.a < p.e_b - s_a AND w.b > p.e_a - s_a GROUP BY ALL),
away AS (SELECT query_id, passage_id, e_nth, term, min(least(abs(i - low), abs(i - high))) AS d FROM covered JOIN placed USING (query_id, passage_id, e_nth) JOIN w USING (passage_id, s_a) WHERE (i < low OR i > high) AND list_contains(terms, w.term) GROUP BY ALL),
near AS (SELECT query_id, passage_id, e_nth, 1.0::DOUBLE / (1.0::DOUBLE + sum(d)::DOUBLE / count(*) / 5.0::DOUBLE) AS near FROM away GROUP BY ALL),
weighed AS (
  SELECT *, round({P.w_evidence}::DOUBLE * evidence, 4) AS evidence_part, round({P.w_type}::DOUBLE * fit, 4) AS type_part,
    round({P.w_context}::DOUBLE * (0.55::DOUBLE * {overlap('terms', 'sentence')} + 0.45::DOUBLE * coalesce(near, 0)), 4) AS context_part,
    round(-{P.w_repeat}::DOUBLE * (len({analyzed('entity')}) > 0 AND list_has_all(terms, {analyzed('entity')}))::INT, 4) AS repeat_part
  FROM placed LEFT JOIN near USING (query_id, passage_id, e_nth)),
candidates AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, rank, e_nth) AS best FROM (SELECT *, round(evidence_part + type_part + context_part + repeat_part, 6) AS total FROM weighed)),
firsts AS (SELECT * FROM candidates WHERE best = 1 AND total >= {P.min_confidence}),
others AS (
  SELECT query_id, string_agg(format('{{}} ({{:.3f}})', entity, round(greatest(total, 0), 3)), '; ' ORDER BY best) AS alternatives
  FROM (SELECT c.*, row_number() OVER (PARTITION BY c.query_id ORDER BY c.best) AS n FROM candidates c JOIN firsts f USING (query_id) WHERE lower(c.entity) <> lower(f.entity)) WHERE n <= 3 GROUP BY query_id),
extracted AS (
  SELECT query_id, entity AS text, 'span' AS kind, round(least(greatest(total, 0), 1), 3) AS confidence, label, sentence, doc_id, (place_0 + e_a)::INT AS doc_start, (place_0 + e_b)::INT AS doc_end, passage_id, evidence_part, type_part, context_part, repeat_part, coalesce(alternatives, '') AS alternatives
  FROM firsts LEFT JOIN others USING (query_id)
  UNION ALL SELECT query_id, p.text, 'sentence', round(least(greatest(total, 0), 1), 3), '', substr(g.text, doc_start - g.place_0::INT + 1, doc_end - doc_start), p.doc_id, doc_start, doc_end, passage_id, round({P.w_evidence}::DOUBLE * evidence, 4), NULL, round({P.w_type + P.w_context}::DOUBLE * {overlap('g.terms', 'a.sentence')}, 4), NULL, ''
  FROM predicted p JOIN gated g USING (query_id, passage_id) JOIN answers a USING (query_id, passage_id, total) WHERE query_id NOT IN (SELECT query_id FROM firsts))"""


_ITEMS = " UNION ALL ".join(f"SELECT item_id * {len(ITEM_QUESTIONS)} + {k} AS query_id, {s(q.split('{}')[0])} || text || {s(q.split('{}')[1])} AS text FROM benchmark" for k, q in enumerate(ITEM_QUESTIONS))


def folded(turns: str) -> str:
    """``fold``: what each turn of ``turns(conv_id, turn, text)`` asks, and the topic after it; every rewritten question is searched for names anew."""
    question = f"CASE WHEN s.intent <> 'question' THEN NULL WHEN coalesce(f.topic, '') = '' THEN s.text WHEN regexp_matches(s.text, {s('(?i)' + QUESTION_ONLY)}) THEN regexp_replace(s.text, '\\?+$', '') || ' ' || f.topic ELSE regexp_replace(s.text, {s('(?i)' + PRONOUNS)}, f.topic) END"
    canonical = "CASE " + " ".join(f"WHEN regexp_matches(lower(question), '\\b{alias}\\b') THEN replace(lower(question), {s(alias)}, {s(name.lower())})" for alias, name in sorted(ALIASES, key=lambda x: -len(x[0]))) + " ELSE lower(question) END"
    return f"""said AS (SELECT *, {intent('lower(text)')} AS intent, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM (SELECT conv_id, turn, {stripped('text')} AS text FROM {turns}) WHERE text <> ''),
known AS (SELECT lower(subject) AS low, subject, min(ord) AS ord FROM facts GROUP BY ALL),
fold AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS nth, NULL::BIGINT AS turn, NULL::VARCHAR AS text, NULL::VARCHAR AS intent, NULL::VARCHAR AS question, NULL::VARCHAR AS topic FROM said
  UNION ALL SELECT conv_id, nth, turn, text, intent, question, CASE WHEN intent <> 'question' THEN before ELSE coalesce((
      SELECT subject FROM known WHERE contains(asked, low) AND regexp_matches(asked, '\\b' || regexp_escape(low) || '\\b') ORDER BY length(subject) DESC, ord LIMIT 1), before) END
    FROM (SELECT *, {canonical} AS asked FROM (SELECT s.conv_id, s.nth, s.turn, s.text, s.intent, f.topic AS before, {question} AS question FROM fold f JOIN said s ON s.conv_id = f.conv_id AND s.nth = f.nth + 1)))"""


def replies(turns: str) -> str:
    """``replied``: what each of the ``turns`` that the SQL makes is answered, by which route: a fact, else a span or sentence of a passage, else the words that no document has."""
    talk = " ".join(f"WHEN intent = '{k}' THEN {s(v)}" for k, v in SMALL_TALK.items())
    return f"""{turns}, {folded('turns')},
put AS (SELECT DISTINCT question AS query_id, question AS text FROM fold WHERE nth > 0 AND intent = 'question'),
{subjects_of('put', 'query_id')}, {relations_of('put')}, {LAST},
told AS (SELECT query_id, object || '.' AS reply FROM found JOIN related USING (query_id) JOIN last USING (relation) WHERE low = lower(subject)),
left_open AS (SELECT * FROM put WHERE query_id NOT IN (SELECT query_id FROM told)), {extracted('left_open')},
strange AS (
  SELECT query_id, string_agg('“' || term || '”', ', ' ORDER BY pos) AS missing
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM (SELECT query_id, unnest(range(0, len(x))) AS pos, unnest(x) AS term FROM (SELECT query_id, {analyzed('text')} AS x FROM left_open)) WHERE term NOT IN (SELECT term FROM vocabulary)) WHERE n <= 3 GROUP BY query_id),
size AS (SELECT count(*) AS n_docs FROM documents), list AS (SELECT string_agg(title, '; ' ORDER BY doc_id, title) AS titles FROM (SELECT doc_id, {_TITLE} AS title FROM documents ORDER BY doc_id, title LIMIT {LISTED})),
replied AS (SELECT conv_id, turn, f.text, intent, coalesce(question, '') AS question, coalesce(question <> f.text, false) AS rewritten, topic,
  CASE WHEN intent <> 'question' THEN 'conversation' WHEN k.reply IS NOT NULL THEN 'knowledge base' WHEN e.text IS NOT NULL THEN 'retrieval' ELSE 'none' END AS route,
  CASE WHEN intent = 'greeting' THEN 'Good to see you. ' || n_docs || ' documents are ready for your questions.' WHEN intent = 'documents' THEN 'The collection counts ' || n_docs || ' documents, among them: ' || titles || '.' {talk}
    ELSE coalesce(k.reply, e.text, 'None of ' || n_docs || ' documents speaks of ' || missing || '.', 'No passage answers that, though some are about it.') END AS reply
FROM fold f LEFT JOIN told k ON k.query_id = f.question LEFT JOIN extracted e ON e.query_id = f.question LEFT JOIN strange x ON x.query_id = f.question, size, list WHERE nth > 0)"""


def means(of: str) -> str:
    """The one row of an evaluation."""
    return f"SELECT count(*) AS questions, count(*) FILTER (WHERE answerable) AS answerable, round(coalesce(avg((doc_rank IS NOT NULL)::INT::DOUBLE) FILTER (WHERE ranked), 0), 6) AS recall_at_k, round(coalesce(avg(coalesce(1.0::DOUBLE / doc_rank, 0)) FILTER (WHERE ranked), 0), 6) AS mrr, round(coalesce(avg(em) FILTER (WHERE answerable), 0), 6) AS exact_match, round(coalesce(avg(f1) FILTER (WHERE answerable), 0), 6) AS f1, round(coalesce(avg(contains) FILTER (WHERE answerable), 0), 6) AS contains, round(coalesce(avg(refused::INT::DOUBLE) FILTER (WHERE NOT answerable), 0), 6) AS refusal_accuracy, round(coalesce(avg(correct::INT::DOUBLE), 0), 6) AS overall FROM {of}"


#: Facts and benchmark items as gold, asked as conversations of one turn, with measures of each reply.
DIALOGUE = f"""{FACTS}, {GOLD},
gold_q AS (SELECT ord AS query_id, q.text, object AS a, NULL::BIGINT AS doc, 'PLACE' AS type FROM facts JOIN questions q ON query_id = ord UNION ALL SELECT -1 - query_id, 'Tell me of ' || text, CASE WHEN doc IS NOT NULL THEN text END, doc, CASE WHEN doc IS NULL THEN 'UNANSWERABLE' ELSE 'OTHER' END FROM gold),
{replies('turns AS (SELECT query_id AS conv_id, 0::BIGINT AS turn, text FROM gold_q)')},
g_asked AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({analyzed('text')}) AS term FROM gold_q)), {document_hits('g_asked')},
g_pairs AS (SELECT *, {words('predicted')} AS pw, {words('a')} AS gw FROM (SELECT g.*, r.route, r.route NOT IN ('knowledge base', 'retrieval') AS refused, CASE WHEN r.route IN ('knowledge base', 'retrieval') THEN r.reply ELSE '' END AS predicted FROM gold_q g JOIN replied r ON r.conv_id = query_id)),
g_common AS (SELECT query_id, sum(least(p, g)) AS n FROM (SELECT query_id, w, count(*) AS p FROM (SELECT query_id, unnest(pw) AS w FROM g_pairs) GROUP BY ALL) JOIN (SELECT query_id, w, count(*) AS g FROM (SELECT query_id, unnest(gw) AS w FROM g_pairs) GROUP BY ALL) USING (query_id, w) GROUP BY query_id),
g_results AS (
  SELECT query_id, type AS question_type, route, refused, a IS NOT NULL AS answerable, a IS NOT NULL AND doc IS NOT NULL AS ranked, CASE WHEN h.rank <= {P.top_k} THEN h.rank END AS doc_rank, CASE WHEN a IS NULL THEN 0 ELSE ({normal('predicted')} = {normal('a')})::INT::DOUBLE END AS em,
    CASE WHEN a IS NULL THEN 0 WHEN len(pw) = 0 OR len(gw) = 0 THEN (len(pw) = len(gw))::INT::DOUBLE ELSE 2.0::DOUBLE * coalesce(n, 0) / (len(pw) + len(gw)) END AS f1, CASE WHEN a IS NULL THEN 0 ELSE contains({normal('predicted')}, {normal('a')})::INT::DOUBLE END AS contains
  FROM g_pairs p LEFT JOIN g_common USING (query_id) LEFT JOIN (SELECT query_id, doc_id AS doc, rank FROM d_hits) h USING (query_id, doc)),
g_correct AS (SELECT *, CASE WHEN answerable THEN contains > 0 OR em > 0 ELSE refused END AS correct FROM g_results)"""


ORACLE_SQL = {
    "doc_admission": f"WITH {DOCS} SELECT m.doc_ord, CASE WHEN k.n = 1 THEN m.slug WHEN k.n > 1 THEN m.slug || '-' || k.n END AS doc_id, m.slug, m.checksum, m.char_count::INT AS char_count, m.word_count::INT AS word_count, m.reject_reason FROM marked m LEFT JOIN members k USING (doc_ord)",
    "corpus_stats": f"WITH {DOCS} SELECT count(*) AS documents, sum(word_count)::BIGINT AS total_words, list_sort(list(word_count))[count(*) // 2 + 1]::INT AS median_words, count(*) FILTER (WHERE source = 'upload') AS uploaded FROM members",
    "corpus_fingerprint": f"WITH {DOCS} SELECT substr(sha256(string_agg(checksum, '|' ORDER BY checksum)), 1, 16) AS fingerprint FROM members",
    "document_terms": f"SELECT doc_id, len({tokens('text')})::INT AS n_tokens, len(t)::INT AS n_terms, md5(array_to_string(t, ' ')) AS terms_md5 FROM (SELECT doc_id, text, {analyzed('text')} AS t FROM documents)",
    "sentence_spans": f'WITH {SENTENCES} SELECT doc_id, sid::INT AS sid, "start", "end" FROM sentences',
    "passage_windows": f'WITH {PASSAGES} SELECT passage_id, doc_id, "start", "end", "index", n_sentences, md5(text) AS text_md5 FROM passages',
    "offset_violations": f"WITH {PASSAGES} SELECT passage_id, p.doc_id, 'moved' AS problem FROM passages p JOIN documents d USING (doc_id) WHERE substr(d.text, p.\"start\" + 1, p.\"end\" - p.\"start\") <> p.text",
    "term_frequencies": f"WITH {DOCUMENT_INDEX} SELECT term, doc_id, tf::INT AS tf, length::INT AS length FROM postings JOIN sizes USING (doc_id)",
    "vocabulary_idf": f"WITH {DOCUMENT_INDEX} SELECT term, df, round(idf, 6) AS idf, round(idf_tfidf, 6) AS idf_tfidf FROM vocabulary",
    "passage_stats": f"WITH {DOCUMENT_INDEX} SELECT doc_id, length::INT AS length, round(coalesce(norm, 1.0::DOUBLE), 6) AS norm FROM sizes LEFT JOIN norms USING (doc_id)",
    "index_summary": f"WITH {DOCUMENT_INDEX} SELECT n, (SELECT count(*) FROM vocabulary) AS vocabulary, round(avg_length, 1) AS avg_length, {P.k1}::DOUBLE AS k1, {P.b}::DOUBLE AS b FROM stats",
    "bm25_topk": f"WITH {DOCUMENT_INDEX}, {hits('doc_id', 'doc_id')} SELECT query_id, doc_id, score, rank, terms FROM hits",
    "tfidf_topk": f"WITH {DOCUMENT_INDEX}, {hits('doc_id', 'doc_id', 'tfidf')} SELECT query_id, doc_id, score, rank FROM hits",
    "document_rank": f"WITH {PASSAGE_INDEX}, {hits('passage_id', PASSAGE_ORDER, k=1_000_000_000)}, own AS (SELECT *, split_part(passage_id, '::p', 1)::BIGINT AS doc_id FROM hits), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS nth FROM own) WHERE nth = 1) SELECT * FROM (SELECT query_id, doc_id, passage_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {PASSAGE_ORDER})::INT AS rank FROM best) WHERE rank <= 3",
    "score_explain": f"WITH {DOCUMENT_INDEX}, {hits('doc_id', 'doc_id')} SELECT p.query_id, p.doc_id, h.rank, p.term, p.tf::INT AS tf, p.df, round(p.idf, 3) AS idf, round(p.bm25, 3) AS score FROM parts p JOIN hits h USING (query_id, doc_id)",
    "unknown_terms": f"WITH {FACTS}, texts AS (SELECT query_id, text FROM questions UNION ALL SELECT -100 - item_id, text FROM benchmark), a AS (SELECT query_id, unnest(range(0, len(t))) AS pos, unnest(t) AS term FROM (SELECT query_id, {analyzed('text')} AS t FROM texts)), v AS (SELECT DISTINCT unnest({analyzed('text')}) AS term FROM documents) SELECT query_id, pos::INT AS pos, term FROM a WHERE term NOT IN (SELECT term FROM v)",
    "coverage_gate": f"WITH {DOCUMENT_INDEX}, {hits('doc_id', 'doc_id', k=P.extract_from)}, c AS (SELECT query_id, h.doc_id, rank, round({overlap('list_distinct(' + analyzed('b.text') + ')', 'd.text')}, 6) AS coverage FROM hits h JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id) SELECT *, coverage >= {P.min_coverage} AS passes FROM c",
    "retrieval_eval": f"WITH {DOCUMENT_INDEX}, {hits('doc_id', 'doc_id')}, {GOLD} SELECT count(*) AS n, round(avg((rank IS NOT NULL)::INT::DOUBLE), 6) AS recall_at_5, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM gold LEFT JOIN hits h ON h.query_id = gold.query_id AND h.doc_id = gold.doc WHERE doc IS NOT NULL",
    "sentence_answer": f"WITH {METRICS} SELECT query_id, text, round(least(greatest(total, 0), 1), 3) AS confidence, doc_id, passage_id, doc_start, doc_end FROM predicted",
    "answer_metrics": f"WITH {METRICS} SELECT query_id, exact_match, round(f1, 6) AS f1, contains FROM measured",
    "evaluation_summary": f"WITH {EVALUATED} SELECT count(*) AS questions, count(*) FILTER (WHERE answerable) AS answerable, round(coalesce(avg((doc_rank IS NOT NULL)::INT::DOUBLE) FILTER (WHERE answerable), 0), 6) AS recall_at_k, round(coalesce(avg(coalesce(1.0::DOUBLE / doc_rank, 0)) FILTER (WHERE answerable), 0), 6) AS mrr, round(coalesce(avg(em) FILTER (WHERE answerable), 0), 6) AS exact_match, round(coalesce(avg(f1) FILTER (WHERE answerable), 0), 6) AS f1, round(coalesce(avg(contains) FILTER (WHERE answerable), 0), 6) AS contains, round(coalesce(avg(refused::INT::DOUBLE) FILTER (WHERE NOT answerable), 0), 6) AS refusal_accuracy, round(coalesce(avg(correct::INT::DOUBLE), 0), 6) AS overall FROM correct",
    "summary_by_type": f"WITH {EVALUATED} SELECT question_type, count(*) AS n, round(avg(correct::INT::DOUBLE), 6) AS correct, round(coalesce(avg(f1) FILTER (WHERE answerable), 0), 6) AS f1 FROM correct GROUP BY question_type",
    "summary_by_route": f"WITH {EVALUATED} SELECT route, count(*) AS n FROM correct GROUP BY route",
    "answer_explain": f"WITH item_questions AS ({_ITEMS}), {extracted('item_questions')} SELECT query_id, printf('%-38s %+.3f', 'rank of the passage', evidence_part) || chr(10) || CASE WHEN kind = 'span' THEN printf('%-38s %+.3f', 'is of the type ' || qtype, type_part) || chr(10) ELSE '' END || printf('%-38s %+.3f', 'words shared with the question', context_part) || CASE WHEN kind = 'span' THEN chr(10) || printf('%-38s %+.3f', 'less for words of the question', repeat_part) ELSE '' END AS explanation FROM extracted JOIN typed USING (query_id)",
    "matched_terms": f"WITH {DOCUMENT_INDEX}, {hits('doc_id', 'doc_id')} SELECT p.query_id, p.doc_id, string_agg(p.term, ' ' ORDER BY round(p.bm25, 6) DESC, p.term) AS terms FROM parts p JOIN hits h USING (query_id, doc_id) GROUP BY ALL",
    "corpus_rows": f"WITH {DOCS} SELECT CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS doc_id, coalesce(nullif({_HEADING}, ''), nullif({_LINE}, ''), upper(source[1]) || source[2:]) AS title, word_count::INT AS words, source, source || '.txt' AS file FROM members",
    "corpus_cap": f"WITH {DOCS}, capped AS (SELECT CASE WHEN reject_reason IS NULL AND row_number() OVER (PARTITION BY reject_reason IS NULL ORDER BY doc_ord) > {CAP} THEN 'full' ELSE coalesce(reject_reason, 'admitted') END AS reason FROM marked) SELECT reason, count(*) AS n, greatest({CAP} - (SELECT count(*) FROM capped WHERE reason = 'admitted'), 0)::BIGINT AS slots_free FROM capped GROUP BY reason",
    "fact_triples": f"WITH {FACTS} SELECT ord, '(' || subject || ', ' || relation || ', ' || object || ')' AS triple FROM facts",
    "span_answer": f"WITH item_questions AS ({_ITEMS}), {extracted('item_questions')} SELECT i.query_id, coalesce(e.text, '') AS text, coalesce(kind, 'none') AS kind, coalesce(confidence, 0.0::DOUBLE) AS confidence, qtype AS question_type, coalesce(label, '') AS label, coalesce(sentence, '') AS sentence, coalesce(e.doc_id, -1) AS doc_id, coalesce(title, '') AS doc_title, coalesce(doc_start, -1) AS doc_start, coalesce(doc_end, -1) AS doc_end, coalesce(passage_id, '') AS passage_id, " + ", ".join(f"coalesce({k}_part, 0.0::DOUBLE) AS {k}_part" for k in ("evidence", "type", "context", "repeat")) + f", coalesce(alternatives, '') AS alternatives FROM item_questions i JOIN typed USING (query_id) LEFT JOIN extracted e USING (query_id) LEFT JOIN (SELECT doc_id, {_TITLE} AS title FROM documents) USING (doc_id)",
    "kb_explain": f"WITH {FACTS}, {subjects_of('questions', 'query_id')}, {RELATIONS}, {LAST} SELECT query_id, 'subject ' || subject || '; cue \"' || cue || '\" means ' || label || '; so ' || object AS explanation FROM found JOIN related USING (query_id) JOIN last USING (relation) WHERE low = lower(subject)",
    "kb_stats": f"WITH {FACTS} SELECT count(*) AS facts, count(DISTINCT subject) AS subjects, (SELECT count(DISTINCT relation) FROM cues) AS relations, count(DISTINCT doc_id) AS documents_covered FROM facts",
    "subject_match": f"WITH {FACTS}, {subjects_of('questions', 'query_id')} SELECT query_id, subject FROM found",
    "relation_match": f"WITH {FACTS}, {RELATIONS} SELECT query_id, relation, label, cue FROM related",
    "kb_lookup": f"WITH {FACTS}, {subjects_of('questions', 'query_id')}, {RELATIONS}, {LAST} SELECT query_id, subject, relation, label AS relation_label, cue AS matched_cue, object, doc_id FROM found JOIN related USING (query_id) JOIN last USING (relation) WHERE low = lower(subject)",
    "question_type": f"WITH {SENTENCES}, q AS (SELECT doc_id, sid, CASE sid % {len(KINDS)} " + " ".join(f"WHEN {k} THEN {s(q.split('{}')[0])} || said || {s(q.split('{}')[1])}" for k, q in enumerate(KINDS)) + f" END AS text FROM (SELECT doc_id, sid, substr(text, \"start\" + 1, \"end\" - \"start\") AS said FROM sentences JOIN documents USING (doc_id))) SELECT doc_id, sid::INT AS sid, {question_type('lower(text)').replace(chr(92) + 'w-', chr(92) + 'p{L}' + chr(92) + 'p{N}_-')} AS question_type FROM q",
    "quick_fingerprint": f"WITH {DOCS} SELECT coalesce(bit_xor(bits), 0)::VARCHAR || '-' || coalesce(sum(bits::HUGEINT), 0)::VARCHAR || '-' || count(*) AS fingerprint FROM (SELECT ('0x' || substr(checksum, 1, 15))::BIGINT AS bits FROM members)",
    "intent": f"WITH {TURNS} SELECT conv_id, turn, {intent('lower(' + stripped('text') + ')')} AS intent FROM turns",
    "document_display": DISPLAY,
    "regex_entities": f"WITH {ENTITIES} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY kind, a) - 1)::INT AS nth, substr(body, a + 1, b - a) AS text, label, a AS \"start\", b AS \"end\" FROM whole",
    "topic_carry": f"WITH RECURSIVE {FACTS}, {TURNS}, {folded('turns')} SELECT conv_id, turn, question, coalesce(question <> text, false) AS rewritten, topic FROM fold WHERE nth > 0",
    "reply_route": f"WITH RECURSIVE {FACTS}, {replies(TURNS)} SELECT * FROM replied",
    "dialogue_summary": f"WITH RECURSIVE {DIALOGUE} {means('g_correct')}",
    "dialogue_failures": f"WITH RECURSIVE {DIALOGUE} SELECT query_id, question_type, route, round(f1, 6) AS f1 FROM g_correct WHERE NOT correct",
    "last_topics": f"WITH RECURSIVE {FACTS}, {TURNS}, {folded('turns')} SELECT conv_id, arg_max(coalesce(topic, ''), nth) AS topic FROM fold WHERE nth > 0 GROUP BY conv_id",
    "stream_topic_state": f"WITH RECURSIVE {FACTS}, {folded('(FROM conversations WHERE role = ' + s('user') + ')')} SELECT conv_id, turn, text, intent, question, topic FROM fold WHERE nth > 0",
}
