"""Live conversations: the topic slot as keyed state of a stream."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.rules import PRONOUNS, QUESTION_ONLY, intent
from ..functions.text import stripped

#: How long a conversation's topic is kept without a turn.
IDLE_MS = 24 * 60 * 60 * 1000


class Names:
    """Names that are found in a lower-case text as whole words: the first by their order, and what it stands for.

    A text is cut at the edges of its words, and its runs of parts are looked up; the time doesn't grow with the number of names.
    """

    EDGE = re.compile(r"\b")

    def __init__(self, names: list[tuple[str, str]]) -> None:
        self.rank: dict[str, int] = {}
        self.named = names
        sizes = set()
        for k, (name, _) in enumerate(names):
            self.rank.setdefault(name, k)
            sizes.add(sum(p != "" for p in self.EDGE.split(name)))
        self.sizes = sorted(sizes)

    def first(self, low: str) -> tuple[str, str] | None:
        parts = self.EDGE.split(low)[1:-1]  # a name begins and ends at an edge
        runs = ("".join(parts[i : i + n]) for n in self.sizes for i in range(len(parts) - n + 1) if parts)
        best = min((k for r in runs if (k := self.rank.get(r)) is not None), default=None)
        return None if best is None else self.named[best]


class Slots:
    """One step of a conversation over a table of names: what is asked, and what it is about."""

    def __init__(self, subjects: list[tuple[str, int]], aliases: list[tuple[str, str]]) -> None:
        self.subjects = Names([(s.lower(), s) for s, _ in sorted(subjects, key=lambda x: (-len(x[0]), x[1]))])
        self.aliases = Names([(a.lower(), c.lower()) for a, c in sorted(aliases, key=lambda x: -len(x[0]))])
        self.pronoun, self.alone = re.compile(PRONOUNS, re.I), re.compile(QUESTION_ONLY, re.I)

    def subject(self, question: str) -> str | None:
        low = question.lower()
        if alias := self.aliases.first(low):
            low = low.replace(*alias)
        found = self.subjects.first(low)
        return found and found[1]

    def step(self, text: str, kind: str, topic: str | None) -> tuple[str | None, str | None]:
        """The question that a turn asks (none of small talk), and the topic after it."""
        if kind != "question":
            return None, topic
        question = text
        if topic and self.alone.match(text):
            question = f"{text.strip().rstrip('?')} {topic}"
        elif topic:
            question = self.pronoun.sub(lambda _: topic, text, count=1)
        return question, self.subject(question) or topic


def topics(turns: DataFrame, subjects: list[tuple[str, int]], aliases: list[tuple[str, str]], *, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """``conv_id, turn, text, intent, question, topic`` of a stream of ``conv_id, turn, text``; turns of a batch are taken in their order.

    Without ``idle_ms`` a topic is kept for ever; with it, a stream goes on making batches to look for idle conversations.
    """
    slots = Slots(subjects, aliases)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        topic, out = (state.get[0] if state.exists else None), []
        rows = pd.concat(list(batches)).sort_values("turn")  # the turns of one conversation in one batch
        for row in rows.itertuples():
            question, topic = slots.step(row.text, row.intent, topic)
            out.append((key[0], row.turn, row.text, row.intent, question, topic))
        state.update((topic,))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "text", "intent", "question", "topic"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), stripped(F.col("text")).alias("text")).where("text <> ''").withColumn("intent", intent(F.col("text")))
    return rows.groupBy("conv_id").applyInPandasWithState(fold, f"conv_id {kind}, turn bigint, text string, intent string, question string, topic string", "topic string", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
