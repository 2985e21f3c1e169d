"""Defaults of the whole library, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    max_docs: int | None = None
    min_doc_chars: int = 120
    max_doc_chars: int = 200_000
    suffixes: tuple[str, ...] = (".txt", ".md")
    window: int = 3
    stride: int = 2
    min_passage_chars: int = 90
    k1: float = 1.5
    b: float = 0.75
    top_k: int = 5
    w_evidence: float = 0.30
    w_type: float = 0.30
    w_context: float = 0.40
    w_repeat: float = 0.35
    min_confidence: float = 0.35
    min_coverage: float = 0.4
    extract_from: int = 4


DEFAULTS = Params()
