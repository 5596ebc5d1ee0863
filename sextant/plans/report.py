"""The full search report: code and commits, by words and by vectors, in one frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.config import DEFAULT, SearchConfig
from sextant.operators import explain, fusion, lexical, vector_search
from sextant.operators.index import Index
from sextant.sources import commits as commit_source
from sextant.sources.tables import stored

SECTIONS = ("code_lexical", "code_hybrid", "commits_lexical", "commits_vector")


def hybrid_search(index: Index, queries: DataFrame, config: SearchConfig = DEFAULT) -> DataFrame:
    """Lexical results in hybrid order: (query_id, rank, file_path, chunk_id, vector_score, score).

    Vectors are the stand-in embedding of the ranked chunks and of the queries.
    """
    return reranked(index, lexical.search(index, queries, config), queries, config)


def reranked(index: Index, found: DataFrame, queries: DataFrame, config: SearchConfig = DEFAULT) -> DataFrame:
    """Lexical results put into hybrid order."""
    texts = found.select("chunk_id").distinct().join(index.chunks.select("chunk_id", "content"), "chunk_id")
    texts = texts.select(F.col("chunk_id").alias("id"), vector_search.embed_text(F.col("content"), config).alias("text"))
    asked = queries.select("query_id", vector_search.query_text(F.col("query"), config).alias("text"))
    order = fusion.rerank(
        found.withColumnRenamed("chunk_id", "id"),
        queries,
        vector_search.hashed_vectors(asked, "query_id", "text"),
        vector_search.hashed_vectors(texts, "id", "text"),
        config,
    ).withColumnRenamed("id", "chunk_id")
    return order.join(found.select("query_id", "chunk_id", "file_path"), ["query_id", "chunk_id"])


def commit_lexical(items: DataFrame, queries: DataFrame, config: SearchConfig = DEFAULT) -> DataFrame:
    """(query_id, rank, id, score) of the best items by words."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("raw", 9)), "id")
    scored = lexical.search_items(items, queries, config)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.top_k).select("query_id", "rank", "id", "score")


def commit_vector(items: DataFrame, queries: DataFrame, config: SearchConfig = DEFAULT) -> DataFrame:
    """(query_id, rank, id, score) of the best items by cosine of stand-in vectors."""
    texts = items.select("id", vector_search.embed_text(F.col("text"), config).alias("text"))
    asked = queries.select("query_id", vector_search.query_text(F.col("query"), config).alias("text"))
    found = vector_search.search(
        vector_search.hashed_vectors(texts, "id", "text"), vector_search.hashed_vectors(asked, "query_id", "text"), config.top_k
    )
    return found.withColumnRenamed("cosine", "score")


def search_report(
    index: Index, commits: DataFrame, queries: DataFrame, total_lines: DataFrame, config: SearchConfig = DEFAULT, preview_lines: int = 3, preview_bytes: int | None = 80
) -> DataFrame:
    """(section, query_id, rank, id, percent) of all four sections, and what a report shows of each.

    Code has band, coverage, context, line_start, total_lines and preview; commits
    have short_hash, subject, files, plus and minus. ``commits`` has hash, seq, message,
    raw_diff. Cosines become percent as (cosine + 1) / 2, other scores by a factor of 100.
    """
    recent = stored(commit_source.recent(commits, config.commit_limit, config), "recent-commits")
    items = commit_source.searchable(recent, config)
    found = stored(lexical.search(index, queries, config), "report-lexical")  # two sections need it
    order = stored(reranked(index, found, queries, config), "report-hybrid")

    def code(name: str, df: DataFrame) -> DataFrame:
        rows = explain.presented(index, df, queries, total_lines, preview_lines, preview_bytes)
        return rows.select(F.lit(name).alias("section"), "query_id", "rank", F.col("chunk_id").alias("id"), "percent", "band", "coverage", "context", "line_start", "total_lines", "preview")

    def commit(name: str, df: DataFrame, percent: Column) -> DataFrame:
        rows = df.join(commit_source.described(recent), "id")
        return rows.select(F.lit(name).alias("section"), "query_id", "rank", "id", percent.alias("percent"), "short_hash", "subject", "files", "plus", "minus")

    score = F.col("score")
    return (
        code(SECTIONS[0], found)
        .unionByName(code(SECTIONS[1], order))
        .unionByName(commit(SECTIONS[2], commit_lexical(items, queries, config), score * 100), allowMissingColumns=True)
        .unionByName(commit(SECTIONS[3], commit_vector(items, queries, config), (score + 1) / 2 * 100), allowMissingColumns=True)
    )


def server_report(index: Index, commits: DataFrame, queries: DataFrame, total_lines: DataFrame, config: SearchConfig = DEFAULT) -> DataFrame:
    """The same four sections with fewer columns and longer previews, as a server answers."""
    rows = search_report(index, commits, queries, total_lines, config, preview_lines=5, preview_bytes=None)
    return rows.select("section", "query_id", "rank", "id", "percent", "line_start", "preview", "short_hash", "subject")
