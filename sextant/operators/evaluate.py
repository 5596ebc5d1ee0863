"""Quality of rankings against graded judgments: NDCG, MRR, recall, precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _gain(rel: Column, rank: Column) -> Column:
    """Linear gain, discounted by log2(rank + 1) for a 1-based rank."""
    return rel / F.log2(rank + F.lit(1))


def judged(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """Ranked ids with their relevance, 0 where there is no judgment."""
    return ranked.join(qrels, ["query_id", "id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0.0)))


def evaluate(ranked: DataFrame, qrels: DataFrame, k: int = 10, recall_k: int = 100) -> DataFrame:
    """(query_id, ndcg, mrr, recall, precision) of every query that is ranked or judged."""
    rank, rel = F.col("rank"), F.col("rel")
    hits = lambda n: F.count_if((rel > 0) & (rank <= n))
    own = judged(ranked, qrels).groupBy("query_id").agg(
        F.sum(F.when(rank <= k, _gain(rel, rank)).otherwise(F.lit(0.0))).alias("dcg"),
        F.min(F.when(rel > 0, rank)).alias("first_hit"),
        hits(recall_k).alias("hits_recall"),
        hits(k).alias("hits_k"),
    )
    by_rel = Window.partitionBy("query_id").orderBy(F.desc("rel"), "id")
    ideal = (
        qrels.withColumn("rank", F.row_number().over(by_rel))
        .groupBy("query_id")
        .agg(F.sum(F.when(rank <= k, _gain(rel, rank)).otherwise(F.lit(0.0))).alias("idcg"), F.count_if(rel > 0).alias("relevant"))
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    both = own.join(ideal, "query_id", "full_outer").fillna(0, ["dcg", "idcg", "hits_recall", "hits_k", "relevant"])
    return both.select(
        "query_id",
        share("dcg", "idcg").alias("ndcg"),
        F.coalesce(F.lit(1.0) / F.col("first_hit"), F.lit(0.0)).alias("mrr"),
        share("hits_recall", "relevant").alias("recall"),
        (F.col("hits_k") / F.lit(k) if k else F.lit(0.0)).alias("precision"),
    )


def mean_report(per_query: DataFrame) -> DataFrame:
    names = ("ndcg", "mrr", "recall", "precision")
    return per_query.agg(F.count(F.lit(1)).alias("queries"), *[F.avg(n).alias(n) for n in names])
