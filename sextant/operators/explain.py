"""Why a result ranked where it did: token weights, matches, coverage, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.config import DEFAULT, SearchConfig
from sextant.functions.text import confidence_band, enclosing_context, looks_like_identifier, utf8_prefix
from sextant.operators.index import Index, idf
from sextant.operators.lexical import query_terms, search, sent
from sextant.sources.tables import stored


def explain_tokens(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, token, doc_freq, idf, is_identifier_query) of each query token; unknown ones have df 0."""
    terms = query_terms(queries).select("query_id", looks_like_identifier(F.col("query")).alias("is_identifier_query"), F.explode("query_tokens").alias("token"))
    known = terms.join(index.doc_freq, "token", "left").crossJoin(F.broadcast(index.stats))
    df = F.coalesce(F.col("df"), F.lit(0))
    return known.select("query_id", "token", df.alias("doc_freq"), idf(F.col("n"), df).alias("idf"), "is_identifier_query")


def _with_matches(index: Index, results: DataFrame, terms: DataFrame) -> DataFrame:
    """Results with the query tokens that their chunk holds, by a lookup in the postings."""
    wanted = results.select("query_id", "chunk_id").join(terms.select("query_id", F.explode("query_tokens").alias("token")), "query_id")
    wanted = stored(wanted, "explain-wanted")
    # the few that are wanted go to the postings, which have each token of a chunk once
    met = index.postings.select("token", "chunk_id").join(sent(wanted, wanted.count()), ["token", "chunk_id"])
    found = met.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list("token")).alias("matched"))
    rows = results.join(found, ["query_id", "chunk_id"], "left").join(terms, "query_id")
    return rows.withColumn("matched", F.coalesce("matched", F.array().cast("array<string>")))


def explain_results(index: Index, queries: DataFrame, config: SearchConfig = DEFAULT) -> DataFrame:
    """(query_id, rank, chunk_id, score, raw, matched, missing) of lexical results."""
    rows = _with_matches(index, stored(search(index, queries, config), "explain-results"), query_terms(queries))
    return rows.select("query_id", "rank", "chunk_id", "score", "raw", "matched", F.array_sort(F.array_except("query_tokens", "matched")).alias("missing"))


def presented(index: Index, results: DataFrame, queries: DataFrame, total_lines: DataFrame, preview_lines: int = 3, preview_bytes: int | None = 80) -> DataFrame:
    """Results with percent, band, token coverage, context and preview, as a report shows them.

    ``results`` has query_id, rank, chunk_id, file_path and score. Contents are met
    by the ranked rows only.
    """
    results = stored(results, "explain-results")
    rows = _with_matches(index, results, query_terms(queries))
    n_results = results.count()
    contents = index.chunks.select("chunk_id", "content", "line_start", "line_end").join(sent(results.select("chunk_id").distinct(), n_results), "chunk_id", "left_semi")
    lines = total_lines.join(sent(results.select("file_path").distinct(), n_results), "file_path", "left_semi")
    rows = rows.join(contents, "chunk_id").join(lines, "file_path", "left")
    best = F.greatest(F.max("score").over(Window.partitionBy("query_id")), F.lit(1e-9))
    of_best = F.col("score") / best * 100
    n_tokens = F.size("query_tokens")
    preview = F.slice(F.split("content", "\n"), 1, preview_lines)
    if preview_bytes is not None:
        preview = F.transform(preview, lambda x: utf8_prefix(x, preview_bytes))
    return rows.select(
        "query_id",
        "rank",
        "chunk_id",
        "file_path",
        "line_start",
        "line_end",
        "total_lines",
        (F.col("score") * 100).alias("percent"),
        of_best.alias("percent_of_best"),
        confidence_band(of_best).alias("band"),
        F.when(n_tokens > 0, F.size("matched") / n_tokens * 100).otherwise(F.lit(0.0)).alias("coverage"),
        enclosing_context(F.col("content"), F.col("line_start")).alias("context"),
        F.array_join(preview, "\n").alias("preview"),
    )
