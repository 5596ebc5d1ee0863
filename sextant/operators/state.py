"""Keeping an index current: snapshots of file state, and replacing what changed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.config import DEFAULT, SearchConfig
from sextant.operators.index import Index, dealt, meta, parts, term_frequency
from sextant.operators.vector_search import embed_text, keyed, sweep
from sextant.sources.files import chunk_lines, scan
from sextant.sources.tables import shared_dir, stored


def snapshot(files: DataFrame) -> DataFrame:
    return files.groupBy(F.col("path").alias("file_path")).agg(F.max("mtime").alias("mtime"))


def compare(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(file_path, state, old_mtime, new_mtime); state is added, changed, unchanged or removed."""
    old = previous.select("file_path", F.col("mtime").alias("old_mtime"))
    new = current.select("file_path", F.col("mtime").alias("new_mtime"))
    state = (
        F.when(F.col("old_mtime").isNull(), "added")
        .when(F.col("new_mtime").isNull(), "removed")
        .when(F.col("old_mtime") == F.col("new_mtime"), "unchanged")
        .otherwise("changed")
    )
    return old.join(new, "file_path", "full_outer").select("file_path", state.alias("state"), "old_mtime", "new_mtime")


def sync(index: Index, previous: DataFrame, files: DataFrame, config: SearchConfig = DEFAULT) -> tuple[Index, DataFrame]:
    """(index, changes): only added and changed files are cut and tokenised again.

    Nothing that stays is written again: a table of the new index is the old table
    without the rows of touched files, and a small stored table of new rows. Document
    frequencies are the old ones and the sums of what came and went. After many syncs
    ``compacted`` writes the tables anew.
    """
    changes = stored(compare(previous, snapshot(files)), "changes")
    touched = stored(changes.where("state <> 'unchanged'").select("file_path"), "touched")
    fresh = changes.where("state IN ('added', 'changed')").select(F.col("file_path").alias("path"))
    new = stored(chunk_lines(files.join(fresh, "path", "left_semi"), config), "fresh-chunks")
    tf = term_frequency(dealt(new, parts(new)), "chunk_id", "content")
    came = stored(tf.select("token", "chunk_id", "tf").sortWithinPartitions("token"), "fresh-postings")
    gone = stored(index.chunk_meta.join(touched, "file_path", "left_semi").select("chunk_id"), "gone-chunks")
    went = index.postings.join(gone, "chunk_id", "left_semi").select("token", F.lit(-1).cast("long").alias("df"))
    deltas = came.select("token", F.lit(1).cast("long").alias("df")).unionByName(went).groupBy("token").agg(F.sum("df").alias("df"))
    counts = index.doc_freq.unionByName(stored(deltas, "deltas")).groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")
    n = new.agg(F.count(F.lit(1)).alias("n")).unionByName(gone.agg((-F.count(F.lit(1))).alias("n"))).unionByName(index.stats)
    return (
        Index(
            chunks=index.chunks.join(touched, "file_path", "left_anti").unionByName(new),
            postings=index.postings.join(gone, "chunk_id", "left_anti").select("token", "chunk_id", "tf").unionByName(came),
            doc_freq=stored(counts, "doc-freq"),
            chunk_meta=index.chunk_meta.join(touched, "file_path", "left_anti").unionByName(stored(meta(new), "fresh-meta")),
            stats=stored(n.agg(F.sum("n").alias("n")), "stats"),
        ),
        changes,
    )


def compacted(index: Index) -> Index:
    """The same index with all tables written anew."""
    spark = index.chunks.sparkSession
    path = f"{shared_dir(spark)}/compacted-{uuid.uuid4().hex}"
    index.write(path)
    return Index.read(spark, path)


def sync_tree(index: Index, previous: DataFrame, files: DataFrame, cache: DataFrame, config: SearchConfig = DEFAULT) -> tuple[Index, DataFrame, DataFrame]:
    """(index, changes, cache) after a scan: files that the scan drops count as removed, and cached vectors of texts that are gone are swept."""
    synced, changes = sync(index, previous, scan(files, config), config)
    texts = synced.chunks.select(embed_text(F.col("content"), config).alias("text"))
    return synced, changes, sweep(cache, keyed(texts, "text", config))


def summary(chunks: DataFrame) -> DataFrame:
    """One row: distinct files and chunks."""
    return chunks.agg(F.countDistinct("file_path").alias("files"), F.count(F.lit(1)).alias("chunks"))
