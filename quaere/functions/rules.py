"""Rule tables as Column expressions: question types, intents, normal forms of answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed rules, the first that matches counts: pattern, type, labels that answer it, and whether a span does.
QUESTION_RULES = [
    (r"\bhow (many|much|large|big|long is)\b", "NUMBER", ["CARDINAL", "QUANTITY", "PERCENT", "MONEY", "ORDINAL"], True),
    (r"\b(who|whom|whose)\b", "PERSON", ["PERSON"], True),
    (r"\b(when|what year|which year|in what year)\b", "DATE", ["DATE"], True),
    (r"\bwhere\b", "PLACE", ["GPE", "LOC", "FAC", "ORG"], True),
    (r"\b(which|what) (company|organisation|organization|university|institution|lab|team|group)\b", "ORG", ["ORG"], True),
    (r"\b(what|which) (is|are|was|were)\s+(a|an|the)?\s*[\w-]+(\s+[\w-]+){0,2}\s*\??$", "DEFINITION", [], False),
    (r"\b(define|what does .+ mean|what is meant by)\b", "DEFINITION", [], False),
    (r"\b(why|how does|how do|how is|how are|explain)\b", "EXPLANATION", [], False),
    (r"\b(which|what) (language|model|algorithm|method|dataset|paper|book|system|tool)\b", "TITLE", ["WORK_OF_ART", "PRODUCT", "EVENT", "ORG", "LANGUAGE"], True),
]
LABELS = {name: labels for _, name, labels, _ in QUESTION_RULES} | {"OTHER": []}

#: Fixed rules, the first that matches counts: intent and pattern.
INTENT_RULES = [
    ("greeting", r"^\s*(hi|hey|hello|yo|good (morning|afternoon|evening))\b"),
    ("farewell", r"^\s*(bye|goodbye|see you|that'?s all|exit|quit)\b"),
    ("thanks", r"^\s*(thanks|thank you|ta|cheers|nice|great|perfect)\b\s*[.!]?\s*$"),
    ("help", r"\b(help|what can you do|how do i use|who are you|what are you)\b"),
    ("documents", r"\b(what|which) (documents|docs|topics|sources|files)\b|\blist (the )?(documents|docs|topics|sources)\b|\bwhat do you know about\b"),
]

#: Fixed patterns of turns that lean on what came before.
PRONOUNS = r"\b(it|its|it's|that|this|they|them|their|he|his|she|her)\b"
QUESTION_ONLY = r"^\s*(and\s+|so\s+|ok\s+|okay\s+)?(who|what|when|where|why|which|how)(\s+(is|are|was|were|did|does|do|about|many|much|long))?\s*\??\s*$"


def _first(text: Column, rules: list[tuple[str, object]], otherwise: object) -> Column:
    lowered = F.lower(text)
    out = None
    for pattern, value in rules:
        test = F.regexp_like(lowered, F.lit("(?U)" + pattern))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(otherwise)


def question_type(question: Column) -> Column:
    """The kind of answer a question asks for."""
    from .text import stripped

    return _first(stripped(question), [(p, F.lit(name)) for p, name, _, _ in QUESTION_RULES], F.lit("OTHER"))


def wants_span(qtype: Column) -> Column:
    return ~qtype.isin("DEFINITION", "EXPLANATION")


def labels_of(qtype: Column) -> Column:
    """Entity labels that answer a type."""
    out = None
    for name, labels in LABELS.items():
        value = F.lit(labels).cast("array<string>") if labels else F.array().cast("array<string>")
        out = F.when(qtype == name, value) if out is None else out.when(qtype == name, value)
    return out


def type_match(label: Column, qtype: Column) -> Column:
    """How well an entity's label fits: any fits an open question somewhat, a mere name fits any other by half."""
    return F.when(F.size(labels_of(qtype)) == 0, F.lit(0.4)).when(F.array_contains(labels_of(qtype), label), F.lit(1.0)).when(label == "PROPN", F.lit(0.5)).otherwise(F.lit(0.0))


def intent(text: Column) -> Column:
    from .text import stripped

    return _first(stripped(text), [(p, F.lit(name)) for name, p in INTENT_RULES], F.lit("question"))


def is_question_only(text: Column) -> Column:
    return F.regexp_like(text, F.lit("(?iU)" + QUESTION_ONLY))


def has_pronoun(text: Column) -> Column:
    return F.regexp_like(text, F.lit("(?iU)" + PRONOUNS))


def resolved(text: Column, topic: Column) -> Column:
    """A turn that leans on the topic, made to stand alone; others as they are."""
    from .text import let, stripped

    alone = F.concat(F.regexp_replace(stripped(text), r"\?+$", ""), F.lit(" "), topic)
    # the text up to the first pronoun, and the rest after it
    head = F.regexp_extract(text, "(?isU)^(.*?)" + PRONOUNS, 1)
    pronoun = F.regexp_extract(text, "(?isU)^(.*?)" + PRONOUNS, 2)
    replaced = let(F.length(head), lambda n: F.concat(F.substring(text, F.lit(1), n), topic, F.substring(text, n + F.length(pronoun) + 1, F.length(text))))
    return F.when(topic.isNull() | (topic == ""), text).when(is_question_only(text), alone).when(has_pronoun(text), replaced).otherwise(text)


#: Fixed: the ASCII punctuation that answers are compared without.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def normal_answer(text: Column) -> Column:
    """Lower case, no punctuation, no articles, single spaces."""
    from .text import flattened

    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return flattened(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "))


def exact_match(predicted: Column, gold: Column) -> Column:
    return (normal_answer(predicted) == normal_answer(gold)).cast("double")


def contains_gold(predicted: Column, gold: Column) -> Column:
    return F.contains(normal_answer(predicted), normal_answer(gold)).cast("double")


def token_f1(predicted: Column, gold: Column) -> Column:
    """Overlap of two answers' words as multisets: the harmonic mean of precision and recall; two empty answers agree."""
    from .text import let

    def words(x: Column) -> Column:
        return F.filter(F.split(normal_answer(x), " "), lambda w: w != "")

    def score(s: Column) -> Column:
        p, g = s["p"], s["g"]
        count = lambda a, w: F.size(F.filter(a, lambda x: x == w))
        overlap = F.aggregate(F.transform(F.array_distinct(p), lambda w: F.least(count(p, w), count(g, w))), F.lit(0), lambda a, v: a + v)
        f1 = 2 * overlap / (F.size(p) + F.size(g))
        return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).otherwise(f1.cast("double"))

    return let(F.struct(words(predicted).alias("p"), words(gold).alias("g")), score)
