"""Lexical search: a batch of queries against the index, in one join plan.

Query terms are joined to document frequencies, then to postings; one aggregate
by (query, chunk) gives the token score and the pruning mass. Symbols and file names
are met only by the candidates that pruning leaves, and contents are searched only for
those that have the inner words of the query. Terms go to the buckets of chunks that the
index lies in, so postings, contents and candidates are not shuffled for it, but for a
task's best of each query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.config import DEFAULT, SearchConfig
from sextant.functions.text import is_blank, symbols, tokens, words
from sextant.operators.index import Index, document_frequency, idf, term_frequency
from sextant.sources.tables import stored

#: Query terms of a batch up to which they are sent to all tasks; Spark decides beyond.
SENT_TERMS = 1_000_000


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, query, lowered, tokens, symbols of the queries that are not blank."""
    return queries.where(~is_blank(F.col("query"))).select(
        "query_id",
        "query",
        F.lower("query").alias("lowered"),
        tokens(F.col("query")).alias("query_tokens"),
        symbols(F.col("query")).alias("query_symbols"),
    )


def inner_tokens(lowered: Column) -> Column:
    """Tokens of the query's inner words in plain ASCII: a text that contains the query has them all."""
    inner = F.slice(words(lowered), F.lit(2), F.greatest(F.size(words(lowered)) - F.lit(2), F.lit(0)))
    return tokens(F.array_join(F.filter(inner, lambda w: w.rlike(r"^[\x21-\x7E]+$")), " "))


def sent(df: DataFrame, n_terms: int) -> DataFrame:
    """``df`` to be broadcast if its rows are few enough."""
    return F.broadcast(df) if n_terms <= SENT_TERMS else df


def token_weight(token: Column, tf: Column, idf_: Column, config: SearchConfig) -> Column:
    boost = F.when(F.octet_length(token) > config.long_token_bytes, config.long_token_boost).otherwise(F.lit(1.0))
    return boost * F.least(tf, F.lit(config.max_tf)) * idf_


def candidates(index: Index, terms: DataFrame, config: SearchConfig = DEFAULT) -> DataFrame:
    """(query_id, chunk_id, token_score, idf_mass, inner) of chunks with a token or symbol of the query.

    ``inner`` counts those of ``inner_tokens``, of the query's own.
    """
    terms = terms.select("query_id", "query_tokens", "query_symbols", F.array_intersect(inner_tokens(F.col("lowered")), "query_tokens").alias("inner"))
    by_token = terms.select("query_id", F.explode("query_tokens").alias("token"), F.lit(1).alias("scored"), F.lit(0).alias("inner"))
    by_symbol = terms.select("query_id", F.explode("query_symbols").alias("token"), F.lit(0).alias("scored"), F.lit(0).alias("inner"))
    by_inner = terms.select("query_id", F.explode("inner").alias("token"), F.lit(0).alias("scored"), F.lit(1).alias("inner"))
    wanted = by_token.unionByName(by_symbol).unionByName(by_inner).groupBy("query_id", "token").agg(F.max("scored").alias("scored"), F.max("inner").alias("inner"))
    n = F.col("n")
    weighted = (
        wanted.join(index.doc_freq, "token")
        .crossJoin(F.broadcast(index.stats))  # stats has one row
        .select("query_id", "token", (F.col("scored") * idf(n, F.col("df"))).alias("idf"), "inner")
    )
    weighted = stored(weighted, "query-weights")
    met = index.postings.join(sent(weighted, weighted.count()), "token")
    return met.groupBy("query_id", "chunk_id").agg(
        F.sum(token_weight(F.col("token"), F.col("tf"), F.col("idf"), config)).alias("token_score"),
        F.sum("idf").alias("idf_mass"),
        F.sum("inner").alias("inner"),
    )


def prune(found: DataFrame, config: SearchConfig = DEFAULT) -> DataFrame:
    """The candidates of largest idf mass of each query; ties by chunk_id."""
    if config.candidate_cap is None:
        return found
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("idf_mass", 9)), "chunk_id")
    return found.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= config.candidate_cap).drop("_nth")


def contains_phrase(content: Column, lowered: Column, query_tokens: Column) -> Column:
    return (F.size(query_tokens) > 1) & F.contains(F.lower(content), lowered)


def with_contents(index: Index, found: DataFrame, terms: DataFrame) -> DataFrame:
    """Candidates with their terms, meta data and contents, each bucket by itself."""
    n_inner = F.size(F.array_intersect(inner_tokens(F.col("lowered")), "query_tokens")).alias("n_inner")
    asked = stored(terms.select("*", n_inner), "query-inner")
    n_terms = asked.agg(F.sum(F.size("query_tokens"))).first()[0] or 0
    # chunks are the side that is hashed: they have a bucket's size, candidates may be many more
    rows = found.join(index.chunk_meta.hint("shuffle_hash"), "chunk_id").join(index.chunks.select("chunk_id", "content").hint("shuffle_hash"), "chunk_id")
    return rows.join(sent(asked, n_terms), "query_id")


def has_phrase() -> Column:
    """Of rows of ``with_contents``: a chunk without all inner tokens of the query does not hold it, and is not searched."""
    return F.when(F.col("inner") >= F.col("n_inner"), contains_phrase(F.col("content"), F.col("lowered"), F.col("query_tokens"))).otherwise(F.lit(False))


def score(index: Index, terms: DataFrame, config: SearchConfig = DEFAULT) -> DataFrame:
    """(query_id, chunk_id, file_path, chunk_index, raw) of pruned candidates with a positive score."""
    terms = stored(terms, "query-terms")
    left = prune(candidates(index, terms, config), config)
    rows = with_contents(index, left, terms)
    phrase = F.when(has_phrase(), config.phrase_bonus).otherwise(F.lit(0.0))
    overlap = lambda a, b: F.size(F.array_intersect(a, b))
    raw = (
        phrase
        + F.lit(config.symbol_bonus) * overlap("query_symbols", "symbols")
        + F.lit(config.file_name_bonus) * overlap("query_tokens", "file_name_tokens")
        + F.col("token_score")
    ) * F.when(F.col("is_code"), config.code_boost).otherwise(F.lit(1.0))
    scored = rows.select("query_id", "chunk_id", "file_path", "chunk_index", raw.alias("raw")).where("raw > 0")
    return leading(index, scored, config) if config.candidate_cap is None else scored


def leading(index: Index, scored: DataFrame, config: SearchConfig) -> DataFrame:
    """Scored chunks without those that as many others are before as ``top_k`` files have chunks at most."""
    most = (index.chunks.agg(F.max("chunk_index")).first()[0] or 0) + 1
    order = Window.partitionBy("query_id").orderBy(*ranking("raw", "file_path", "chunk_index"))
    return scored.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= config.top_k * most).drop("_nth")


def ranking(*parts: str) -> tuple[Column, ...]:
    """Falling score rounded to 9 places, then the columns given: a total order."""
    return (F.desc(F.round(parts[0], 9)), *map(F.col, parts[1:]))


def ranked(scored: DataFrame, config: SearchConfig = DEFAULT) -> DataFrame:
    """The best chunk of each query's top files, of chunks with their ``raw`` scores."""
    per_query = Window.partitionBy("query_id")
    best = Window.partitionBy("query_id", "file_path").orderBy(*ranking("raw", "chunk_index"))
    files = scored.withColumn("_nth", F.row_number().over(best)).where("_nth = 1").drop("_nth")
    top = per_query.orderBy(*ranking("raw", "file_path", "chunk_index"))
    first = files.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= config.top_k)
    # the largest raw score is always among the top
    return first.withColumn("score", F.col("raw") / F.max("raw").over(per_query)).select(
        "query_id", "rank", "chunk_id", "file_path", "chunk_index", "raw", "score"
    )


def search(index: Index, queries: DataFrame, config: SearchConfig = DEFAULT) -> DataFrame:
    """(query_id, rank, chunk_id, file_path, chunk_index, raw, score): the best chunk of the top files."""
    return ranked(score(index, query_terms(queries), config), config)


def search_items(items: DataFrame, queries: DataFrame, config: SearchConfig = DEFAULT) -> DataFrame:
    """(query_id, id, raw, score) of (id, text) items: phrase and tokens only, no pruning, no limit."""
    terms = query_terms(queries)
    postings = term_frequency(items, "id", "text")
    stats = items.agg(F.count(F.lit(1)).alias("n"))
    weighted = (
        terms.select("query_id", F.explode("query_tokens").alias("token"))
        .join(document_frequency(postings), "token")
        .crossJoin(F.broadcast(stats))
        .select("query_id", "token", idf(F.col("n"), F.col("df")).alias("idf"))
    )
    sums = (
        postings.join(weighted, "token")
        .groupBy("query_id", "id")
        .agg(F.sum(token_weight(F.col("token"), F.col("tf"), F.col("idf"), config)).alias("token_score"))
    )
    rows = sums.join(items, "id").join(terms, "query_id")
    phrase = F.when(contains_phrase(F.col("text"), F.col("lowered"), F.col("query_tokens")), config.phrase_bonus).otherwise(F.lit(0.0))
    raw = rows.select("query_id", "id", (phrase + F.col("token_score")).alias("raw")).where("raw > 0")
    return raw.withColumn("score", F.col("raw") / F.max("raw").over(Window.partitionBy("query_id")))
