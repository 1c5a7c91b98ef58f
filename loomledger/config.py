"""Every threshold of the engine in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    max_file_bytes: int = 10 * 1024 * 1024
    chunk_words: int = 800
    window_sentences: int = 2
    window_words: int = 120
    quoted_words: int = 3
    grounded_share: float = 0.6
    merge_similarity_pm: int = 800
    merge_entailment_pm: int = 800
    merge_partners: int = 8
    retrieve_k: int = 4
    retrieve_floor_pm: int = 300
    support_pm: int = 800
    contradict_pm: int = 950
    contradict_similarity_pm: int = 600
    ground_k: int = 4
    ground_pm: int = 800
    words_per_minute: int = 150
    chunk_min_secs: int = 60
    request_bytes: int = 24 * 1024
    #: A query block of a similarity search: at most so many rows are sent to every task at once.
    query_block: int = 4096


DEFAULT = Settings()
SCHEMA_VERSION = 10
