"""Constants and knobs of the search, with the defaults that results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SearchConfig:
    # chunks
    chunk_lines: int = 60
    chunk_overlap: int = 15
    max_file_bytes: int = 50 * 1024 * 1024
    max_chunks: int | None = None  # newest chunks kept; 50,000 for parity on one machine
    # lexical score
    max_tf: int = 5
    long_token_bytes: int = 4
    long_token_boost: float = 1.5
    phrase_bonus: float = 30.0
    symbol_bonus: float = 10.0
    file_name_bonus: float = 10.0
    code_boost: float = 1.2
    candidate_cap: int | None = 500  # None scores every candidate
    top_k: int = 10
    # fusion
    rrf_k: float = 60.0
    identifier_boost: float = 1.5
    # vectors
    doc_prefix: str = "search_document: "
    query_prefix: str = "search_query: "
    embed_bytes: int = 1024
    model_tag: str = "stand-in-v1"
    dim: int = 0  # 0 keeps all entries
    # commits
    commit_limit: int = 200
    commit_diff_bytes: int = 2048
    diff_block_bytes: int = 4096
    diff_bytes: int = 8192


DEFAULT = SearchConfig()
