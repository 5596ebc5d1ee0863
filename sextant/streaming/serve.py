"""Answering a stream of queries from the persisted index, or from the tables that a stream keeps current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sextant.config import DEFAULT, SearchConfig
from sextant.operators.index import Index
from sextant.operators.lexical import search
from sextant.sources.tables import read_or_empty
from sextant.streaming import ingest

QUERY_SCHEMA = "query_id long, query string"


def start(spark: SparkSession, index: Index, source: str, out: str, checkpoint: str, config: SearchConfig = DEFAULT) -> StreamingQuery:
    """Search each micro-batch of queries as one plan; results go to a folder for each batch.

    A batch that is run again replaces its own folder, so results come once.
    """

    def answer(df: DataFrame, batch_id: int) -> None:
        _write(search(index, df, config), batch_id, out)

    return _started(spark, answer, source, checkpoint)


def start_live(spark: SparkSession, tables: str, source: str, out: str, checkpoint: str, config: SearchConfig = DEFAULT) -> StreamingQuery:
    """Search the live tables below ``tables``, each micro-batch as of their last generation then.

    Result rows name it as ``version``. It is written down before the batch is answered,
    so a batch that is run again is answered as of the same version, unless that has been
    compacted away; then as of the last.
    """

    def answer(df: DataFrame, batch_id: int) -> None:
        noted = read_or_empty(spark, f"{out}-versions", "version long, batch long").where(F.col("batch") == batch_id).first()
        now = ingest.tables(spark, tables).now(noted and noted["version"])
        if noted is None or now.last != noted["version"]:
            spark.createDataFrame([(now.last,)], "version long").coalesce(1).write.mode("overwrite").parquet(f"{out}-versions/batch={batch_id}")
        _write(search(ingest.index_of(now), df, config).withColumn("version", F.lit(now.last).cast("long")), batch_id, out)

    return _started(spark, answer, source, checkpoint)


def _write(found: DataFrame, batch_id: int, out: str) -> None:
    rows = found.withColumn("batch", F.lit(batch_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)


def _started(spark: SparkSession, answer, source: str, checkpoint: str) -> StreamingQuery:
    stream = spark.readStream.schema(QUERY_SCHEMA).json(source)
    return stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
