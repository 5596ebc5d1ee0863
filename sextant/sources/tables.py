"""Tables that jobs share: written once as Parquet, read by all executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_own_dirs: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and all runs in one process, as in tests, the
    application gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="sextant-tables-")
        found = _own_dirs[app]
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def stored_meanwhile(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``stored``, and deleted at the end."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs_path, True)


def bucketed(df: DataFrame, path: str, buckets: int, key: str, *order: str, mode: str = "error", compression: str | None = None) -> DataFrame:
    """``df`` written below ``path`` in buckets by ``key``, each sorted, and read back so that Spark knows the buckets.

    Rows should be dealt out by the key already, so that each task writes one bucket.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").mode(mode).bucketBy(buckets, key).sortBy(*order).option("path", path)
    (writer.option("compression", compression) if compression else writer).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, as the path is the caller's
    return in_buckets(spark, path, df.schema, buckets, key, *order)


def in_buckets(spark: SparkSession, path: str, schema: StructType, buckets: int, key: str, *order: str, parts: tuple[str, list[int]] | None = None) -> DataFrame:
    """The files of ``bucketed`` below ``path`` as a table that Spark knows the buckets of, for this session.

    ``parts``: the column, behind the others, whose values folders are named by, and the values to read.
    """
    name = f"bucketed_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    by = f"PARTITIONED BY ({parts[0]})" if parts else ""
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {by} CLUSTERED BY ({key}) SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    if parts and parts[1]:
        spark.sql(f"ALTER TABLE {name} ADD {' '.join(f'PARTITION ({parts[0]} = {value})' for value in parts[1])}")
    return spark.table(name)


def freed(spark: SparkSession) -> None:
    """Delete the tables that ``stored`` wrote; only for when nothing that came of them is needed any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table below ``path``; empty before anything wrote it."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def replaced(spark: SparkSession, path: str, schema: str, new: DataFrame, touched: DataFrame, key: str, part: str) -> None:
    """Put ``new`` into the table below ``path``, partitioned by ``part``, in place of the rows with a touched key.

    Only partitions that ``new`` or touched keys fall into are written again. They are
    read and written at once, so their new content is stored first; writing is
    idempotent, so a run again after a failure leaves the same table.
    """
    old = read_or_empty(spark, path, schema)
    hit = old.join(touched, key, "left_semi").select(part).unionByName(new.select(part)).distinct()
    kept = old.join(F.broadcast(hit), part, "left_semi").join(touched, key, "left_anti")
    rows = stored(kept.unionByName(new.select(*old.columns)), "replaced")
    # partitions left without rows; their number is that of partitions at most
    empty = [r[0] for r in hit.join(rows.select(part).distinct(), part, "left_anti").collect()]
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for value in empty:
        fs_path = jvm.org.apache.hadoop.fs.Path(f"{path}/{part}={value}")
        fs_path.getFileSystem(conf).delete(fs_path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
