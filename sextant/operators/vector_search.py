"""Exact vector search, and the content-addressed cache of embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.config import DEFAULT, SearchConfig
from sextant.functions.text import utf8_prefix, word_tokens, words
from sextant.functions.vectors import cache_key
from sextant.sources.tables import replaced, stored

#: Query vectors that a task multiplies at once, and that are sent to the tasks in one pass over the vectors.
QUERY_BLOCK = 256
PASS_QUERIES = 16_384


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def _trimmed(parts: list[pd.DataFrame], k: int) -> list[pd.DataFrame]:
    """The best k rows of each query; ties go to the smaller id."""
    rows = pd.concat(parts, ignore_index=True)
    rows = rows.assign(_place=-np.round(rows["cosine"], 9)).sort_values(["query_id", "_place", "id"], kind="stable")
    return [rows.groupby("query_id", sort=False).head(k).drop(columns="_place")]


def _pass(vectors: DataFrame, query_vectors: DataFrame, k: int | None, schema: str) -> DataFrame:
    """The nearest items of one set of queries within each task; all items if k is None."""
    rows = query_vectors.collect()
    ids = np.array([r["query_id"] for r in rows], dtype=object)
    block = _unit(np.array([r["vec"] for r in rows], dtype=np.float64).reshape(len(rows), -1)) if rows else np.zeros((0, 1))
    shared = vectors.sparkSession.sparkContext.broadcast((ids, block))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, queries = shared.value
        best: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf) or not len(names):
                continue
            items = _unit(np.stack(pdf["vec"].to_numpy()).astype(np.float64))
            own = pdf["id"].to_numpy()
            for at in range(0, len(names), QUERY_BLOCK):
                scores = queries[at : at + QUERY_BLOCK] @ items.T
                if k is None or k >= len(own):
                    q, i = (x.ravel() for x in np.indices(scores.shape))
                else:  # what reaches the k-th best; ties at the end are told apart when trimmed
                    near = np.round(scores, 9)
                    q, i = np.nonzero(near >= -np.partition(-near, k - 1, axis=1)[:, k - 1 : k])
                found = pd.DataFrame({"query_id": names[at + q], "id": own[i], "cosine": scores[q, i]})
                if k is None:
                    yield found
                else:
                    best.append(found)
            if sum(map(len, best)) > 8 * k * len(names) if k else False:
                best = _trimmed(best, k)
        if best:
            yield _trimmed(best, k)[0]

    return vectors.select("id", "vec").where("vec IS NOT NULL").mapInPandas(nearest, schema)


def search(vectors: DataFrame, query_vectors: DataFrame, k: int | None) -> DataFrame:
    """(query_id, id, rank, cosine): the k nearest items of each query, by matrix products.

    Queries are counted first and go over the vectors in passes of at most about
    PASS_QUERIES; within a pass they are sent to every task and multiplied in blocks.
    Each task keeps its own best k of a query, so what is shuffled does not grow with
    the items of a task. Ties go to the smaller id. Without k the cosines of all pairs
    come, unranked: (query_id, id, cosine).
    """
    schema = f"query_id {query_vectors.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, cosine double"
    asked = query_vectors.select("query_id", "vec")
    passes = max(1, -(-asked.count() // PASS_QUERIES))
    if passes == 1:
        found = _pass(vectors, asked, k, schema)
    else:
        asked = stored(asked, "query-vectors")
        parts = [asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i) for i in range(passes)]
        # one after the other, so that one pass's queries are held at a time
        found = reduce(DataFrame.unionByName, [stored(_pass(vectors, part, k, schema), "near-vectors") for part in parts])
    if k is None:
        return found
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "rank", "cosine")


def embed_text(text, config: SearchConfig = DEFAULT):
    """What is embedded of a document: the prefix and the first bytes of the text."""
    return F.concat(F.lit(config.doc_prefix), utf8_prefix(text, config.embed_bytes))


def query_text(query, config: SearchConfig = DEFAULT):
    return F.concat(F.lit(config.query_prefix), query)


def keyed(texts: DataFrame, text: str, config: SearchConfig = DEFAULT) -> DataFrame:
    return texts.withColumn("key", cache_key(F.col(text), config.model_tag, config.dim))


def missing(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """The distinct keys of ``texts`` that the cache does not hold, with one text each."""
    need = texts.groupBy("key").agg(F.min("text").alias("text"))
    return need.join(cache, "key", "left_anti")


def embed_missing(texts: DataFrame, cache: DataFrame, vectorizer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cache with vectors of all texts: only misses are computed (key, text) -> (key, vec)."""
    return cache.select("key", "vec").unionByName(vectorizer(missing(texts, cache)).select("key", "vec"))


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with the new vectors put in: one row for each key, the new one where both have it."""
    once = new.groupBy("key").agg(F.min("vec").alias("vec"))
    return cache.join(once, "key", "left_anti").select("key", "vec").unionByName(once)


def write_cache(new: DataFrame, path: str, digits: int = 1) -> None:
    """Put new vectors into the cache below ``path``, kept in parts of the key's first hex digits.

    Only the parts that new keys fall into are written again, so a large cache that
    few keys come to takes more digits. They must be the same in all calls.
    """
    part = F.substring("key", 1, digits).alias("part")
    once = new.groupBy("key").agg(F.min("vec").alias("vec")).select("key", "vec", part)
    replaced(new.sparkSession, path, "key string, vec array<float>, part string", once, once.select("key"), "key", "part")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, vec array<float>, part string").parquet(path).drop("part")


def sweep(cache: DataFrame, live: DataFrame) -> DataFrame:
    """The cache rows whose key is live."""
    return cache.join(live.select("key").distinct(), "key", "left_semi")


def swept(cache: DataFrame, live: DataFrame) -> DataFrame:
    """One row: keys removed and the bytes of their float vectors."""
    gone = cache.join(live.select("key").distinct(), "key", "left_anti")
    return gone.agg(F.count(F.lit(1)).alias("removed"), F.coalesce(F.sum(F.size("vec").cast("long") * 4), F.lit(0)).alias("bytes_freed"))


def hashed_vectors(texts: DataFrame, key: str, text: str, dim: int = 32) -> DataFrame:
    """A stand-in embedding: signed hashing of tokens into ``dim`` entries, at unit length.

    It needs no model and is not semantic; it only gives text a reproducible vector.
    """
    token = texts.select(key, F.explode(words(F.col(text))).alias("word")).select(key, F.explode(word_tokens(F.col("word"))).alias("token"))
    number = F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long")
    signed = token.select(key, (number % dim).alias("at"), (F.lit(1) - F.lit(2) * (F.floor(number / dim) % 2)).cast("double").alias("sign"))
    entries = signed.groupBy(key, "at").agg(F.sum("sign").alias("x"))
    full = entries.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("m"))
    at = F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long"))
    vec = F.transform(at, lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    size = F.sqrt(F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, x: a + x * x))
    return full.select(key, vec.alias("v"), size.alias("size")).select(
        key, F.transform("v", lambda x: x / F.when(F.col("size") > 0, F.col("size")).otherwise(F.lit(1.0))).alias("vec")
    )
