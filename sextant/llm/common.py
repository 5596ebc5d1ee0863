"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the text contracts define it: space and \t..\r.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

#: Records in one Arrow batch sent to Python, so that a batch of long texts
#: stays small next to an executor's memory.
ARROW_RECORDS = 512


#: Rows from which a key of a join is split, and the most keys that are (which then are larger).
HOT_ROWS = 100
MOST_HOT = 1000

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
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="sextant-shared-")
        found = _own_dirs[app]
    return found.rstrip("/")


def stored(df: DataFrame, name: str, keep: bool = False, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    ``freed`` deletes the table, unless it is one to ``keep``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not keep:
        _written.append(path)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables that ``stored`` wrote, from the given one on.

    Only for when no DataFrame that came of them is needed any more.
    """
    deleted(spark, _written[since:])


def written(since: int = 0) -> list[str]:
    """The tables that ``stored`` wrote and that are not deleted, from the given one on."""
    return _written[since:]


def deleted(spark: SparkSession, paths: list[str]) -> None:
    """Delete these tables of ``stored``."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        if path in _written:
            _written.remove(path)
            fs_path = jvm.org.apache.hadoop.fs.Path(path)
            fs_path.getFileSystem(conf).delete(fs_path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Frees at its end what ``stored`` wrote within it."""
    since = len(_written)
    try:
        yield
    finally:
        freed(spark, since)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores behind it, so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def located(docs: DataFrame, name: str) -> DataFrame | None:
    """``docs`` with a locator of each row, the same in every read, in the column ``name``.

    The locator is a hash of the file's path above the row's place in the file; as many
    bits are the place's as the longest file needs. None if the rows do not come from
    Parquet files, have a column named ``_metadata``, or two files share a hash.
    ``docs`` may be filtered and projected, but a file's row may be in it once at most.
    """
    if "_metadata" in {c.lower() for c in docs.columns}:
        return None
    path, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    try:
        files = docs.groupBy(path.alias("path")).agg(F.max(place).alias("last"))
    except AnalysisException:
        return None
    bits = (files.agg(F.max("last")).first()[0] or 0).bit_length()
    hashed = lambda x: F.shiftrightunsigned(F.xxhash64(x), bits + 1)
    one = files.agg(F.count(F.lit(1)).alias("files"), F.countDistinct(hashed("path")).alias("hashes")).first()
    if one.files != one.hashes:
        return None
    return docs.withColumn(name, F.shiftleft(hashed(path), bits).bitwiseOR(place))


def numbered(docs: DataFrame, name: str, table_name: str, from_files: bool) -> DataFrame:
    """``docs`` with a locator that stays: of the files' rows where the caller says that they are such, else of a stored copy."""
    found = located(docs, name) if from_files else None
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), table_name) if found is None else found


def joined(rows: DataFrame, facts: DataFrame, on: str, count: str) -> DataFrame:
    """``rows`` joined with ``facts``, a stored table with one row for each key and ``count``, its number of rows.

    Keys of more rows than HOT_ROWS, and than a MOST_HOT-th of all, are split: their
    rows are dealt to as many parts as needed, and their facts go to each of them.
    So no task gets more than that of one key. The list of such keys, MOST_HOT at
    most, is broadcast. No column may be named ``_parts`` or ``_part``.
    """
    total = facts.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    least = max(HOT_ROWS, -(-total // MOST_HOT))
    parts = F.ceil(F.col(count) / F.lit(least)).cast("int")
    hot = F.broadcast(facts.where(F.col(count) > least).select(on, parts.alias("_parts")))
    part = F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = rows.join(hot, on, "left").withColumn("_part", part).drop("_parts")
    copies = facts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - F.lit(1))))
    return dealt.join(copies, [on, "_part"]).drop("_part")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def id_remainder(modulus: int, name: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null counts as '')."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit(""))) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lower the records of an Arrow batch to ARROW_RECORDS; never raise them.

    Texts can be long, and a batch is held by the executor and by its Python
    worker at once.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) not in range(1, ARROW_RECORDS + 1):
        spark.conf.set(key, str(ARROW_RECORDS))
