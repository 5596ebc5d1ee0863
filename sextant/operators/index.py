"""The inverted index as tables: postings, doc_freq, chunk_meta, stats.

Built once, read by every batch of queries. ``postings`` is the only large table. It,
the chunks and their meta data lie in buckets of chunks, so that what a search adds up
for a chunk, or meets its content by, is in one task. Postings are sorted by token
within a bucket, so that a lookup reads few row groups.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import rules
from sextant.functions.counts import other_tokens, token_counts
from sextant.functions.text import symbols, tokens
from sextant.sources.tables import bucketed, in_buckets, shared_dir, stored

#: Bytes of content of a bucket, on average.
PART_BYTES = 8 << 20


@dataclass(frozen=True)
class Index:
    chunks: DataFrame  # chunk_id, file_path, chunk_index, content, line_start, line_end, mtime
    postings: DataFrame  # token, chunk_id, tf
    doc_freq: DataFrame  # token, df
    chunk_meta: DataFrame  # chunk_id, file_path, chunk_index, file_name_tokens, symbols, is_code
    stats: DataFrame  # n: one row
    buckets: int | None = None  # of chunks that the large tables lie in

    TABLES: ClassVar = ("chunks", "postings", "doc_freq", "chunk_meta", "stats")

    #: Tables in buckets of chunks, and the order within a bucket.
    ORDER: ClassVar = {"chunks": "chunk_id", "postings": "token", "chunk_meta": "chunk_id"}

    def write(self, path: str, spread: int | None = None) -> None:
        """One Parquet folder for each table below ``path``; the number of buckets beside them."""
        buckets = spread or self.buckets or parts(self.chunks)
        for name in self.TABLES:
            df = getattr(self, name)
            if name in self.ORDER:
                df = df if buckets == self.buckets else dealt(df, buckets)
                bucketed(df, f"{path}/{name}", buckets, "chunk_id", self.ORDER[name])
            else:
                df.write.parquet(f"{path}/{name}")
        self.chunks.sparkSession.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{path}/layout")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        buckets = spark.read.parquet(f"{path}/layout").first()[0]
        plain = {name: spark.read.parquet(f"{path}/{name}") for name in cls.TABLES}
        return cls(**plain | {name: in_buckets(spark, f"{path}/{name}", plain[name].schema, buckets, "chunk_id", order) for name, order in cls.ORDER.items()}, buckets=buckets)


def parts(chunks: DataFrame) -> int:
    """Buckets for these chunks: one for each PART_BYTES of content, and one for each core at least."""
    return parts_of(chunks.sparkSession, chunks.agg(F.sum(F.octet_length("content").cast("long"))).first()[0] or 0)


def parts_of(spark: SparkSession, n_bytes: int) -> int:
    """Buckets for so many bytes of content."""
    return max(spark.sparkContext.defaultParallelism, -(-n_bytes // PART_BYTES))


def dealt(df: DataFrame, buckets: int) -> DataFrame:
    """Dealt out as the buckets are, so that each is written by one task."""
    return df.repartition(buckets, "chunk_id")


def term_frequency(items: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key, tf): the words of a text that have the token, each counted once.

    Nothing is shuffled if the items are dealt by the key. They are read twice: rows of
    one key, if there are such, count as one text.
    """
    column = items.schema[key]
    asked = items.select(key, text, other_tokens(F.col(text)).alias("others"))
    counted = asked.mapInArrow(token_counts, f"token string, `{key}` {column.dataType.simpleString()}, tf long")
    if items.groupBy(key).count().where("count > 1").isEmpty():
        return counted
    return counted.groupBy("token", key).agg(F.sum("tf").alias("tf"))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    """ln((n + 1) / (df + 1)) + 1; never below 1."""
    return F.log((n + F.lit(1)) / (df + F.lit(1))) + F.lit(1.0)


def meta(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "chunk_id",
        "file_path",
        "chunk_index",
        tokens(F.col("file_path")).alias("file_name_tokens"),
        symbols(F.col("content")).alias("symbols"),
        rules.is_code_file(F.col("file_path")).alias("is_code"),
    )


def build(chunks: DataFrame, spread: int | None = None) -> Index:
    """Build and store all tables, in ``spread`` buckets of chunks (as many as the contents need, if None)."""
    spark, path = chunks.sparkSession, f"{shared_dir(chunks.sparkSession)}/index-{uuid.uuid4().hex}"
    buckets = spread or parts(chunks)
    put = lambda df, name: bucketed(df, f"{path}/{name}", buckets, "chunk_id", Index.ORDER[name])
    chunks = put(dealt(chunks, buckets), "chunks")
    tf = term_frequency(chunks, "chunk_id", "content")
    postings = put(tf.select("token", "chunk_id", "tf"), "postings")
    return Index(
        chunks=chunks,
        postings=postings,
        doc_freq=stored(document_frequency(postings), "doc-freq"),
        chunk_meta=put(meta(chunks), "chunk_meta"),
        stats=stored(chunks.agg(F.count(F.lit(1)).alias("n")), "stats"),
        buckets=buckets,
    )
