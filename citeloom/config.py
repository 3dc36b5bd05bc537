"""Thresholds of retrieval, chunking and extraction, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    rrf_k: int = 2
    relative_floor: float = 0.5
    decision_relative_floor: float = 0.85
    search_evidence_floor: float = 0.35
    find_evidence_floor: float = 0.58
    find_dense_floor: float = 0.45
    supersede_floor: float = 0.75
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    bm25_avgdl: float = 180.0
    window: int = 2000
    overlap: int = 200
    paragraph_group: int = 1800
    rerank_head: int = 20
    explain_summaries: int = 40
    summary_chars: int = 4000
    topic_chars: int = 500
    sections_per_file: int = 20
    doc_decisions_per_run: int = 100
    max_doc_bytes: int = 200_000
    max_file_bytes: int = 512_000
    min_confidence: float = 0.5
    retention_days: int = 30
    vector_size: int = 32


SETTINGS = Settings()
