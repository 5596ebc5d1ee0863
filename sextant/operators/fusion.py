"""Reciprocal rank fusion, normalisation, hybrid re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.config import DEFAULT, SearchConfig
from sextant.functions.text import looks_like_identifier
from sextant.functions.vectors import cosine


def rrf(lexical: DataFrame, vector: DataFrame, lexical_weight: Column | float = 1.0, vector_weight: float = 1.0, config: SearchConfig = DEFAULT) -> DataFrame:
    """(query_id, id, fused): sums of weight / (k + rank) over two ranked lists.

    ``lexical_weight`` may be a column of ``lexical``. An id of one list alone
    keeps that list's part.
    """
    part = lambda df, w: df.select("query_id", "id", ((w if isinstance(w, Column) else F.lit(w)) / (F.lit(config.rrf_k) + F.col("rank"))).alias("part"))
    both = part(lexical, lexical_weight).unionByName(part(vector, vector_weight))
    return both.groupBy("query_id", "id").agg(F.sum("part").alias("fused"))


def lexical_weight(query: Column, config: SearchConfig = DEFAULT) -> Column:
    return F.when(looks_like_identifier(query), config.identifier_boost).otherwise(F.lit(1.0))


def normalised(scored: DataFrame, column: str) -> DataFrame:
    """``column`` divided by its maximum of each query, if that is positive."""
    top = F.max(column).over(Window.partitionBy("query_id"))
    return scored.withColumn(column, F.when(top > 0, F.col(column) / top).otherwise(F.col(column)))


def rerank(results: DataFrame, queries: DataFrame, query_vectors: DataFrame, vectors: DataFrame, config: SearchConfig = DEFAULT) -> DataFrame:
    """Lexical results (query_id, id, rank) in hybrid order: (query_id, id, rank, vector_score, score).

    Vectors rank only the lexical results; a row without a vector keeps the lexical
    part alone. Ties keep the lexical order.
    """
    rows = results.select("query_id", "id", F.col("rank").alias("lexical_rank"))
    rows = rows.join(queries.select("query_id", lexical_weight(F.col("query"), config).alias("w")), "query_id")
    rows = rows.join(query_vectors.select("query_id", F.col("vec").alias("query_vec")), "query_id", "left")
    rows = rows.join(vectors.select("id", F.col("vec").alias("id_vec")), "id", "left")
    rows = rows.withColumn("vector_score", cosine(F.col("query_vec"), F.col("id_vec"))).drop("query_vec", "id_vec")
    has = F.col("vector_score").isNotNull()
    by_vector = Window.partitionBy("query_id", has).orderBy(F.desc(F.round("vector_score", 9)), "lexical_rank")
    part = F.when(has, F.lit(1.0) / (F.lit(config.rrf_k) + F.row_number().over(by_vector))).otherwise(F.lit(0.0))
    fused = rows.withColumn("score", F.col("w") / (F.lit(config.rrf_k) + F.col("lexical_rank")) + part)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "lexical_rank")
    ranked = normalised(fused.withColumn("rank", F.row_number().over(order)), "score")
    return ranked.select("query_id", "id", "rank", "vector_score", "score")
