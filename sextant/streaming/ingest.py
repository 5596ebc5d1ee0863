"""Keeping chunks and postings current from a stream of versions of files.

Each path has a state: the mark of its newest version, its mtime, whether it was
deleted, and the digest of its content. A version goes on only if its mark is above
that of the state, whatever batch it comes in; late versions are dropped, and a
tombstone (``deleted``) stays, so that a late version does not bring a file back. In a
stream the state is Spark's (``transformWithState``, by path, in RocksDB); a batch
applied by itself compares with the marks that the tables hold. The state sees marks and
the place of a version in its source file; contents are read from there once, and are
shuffled once, into the buckets that they stay in.

The tables are generations (``sources.generations``): a micro-batch appends the chunks
and postings of its files, the keys it touches, the ids of chunks that no longer count,
and what document frequencies gain and lose. Rows are merged when read, and compacted
when half of them are dead.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sextant.config import DEFAULT, SearchConfig
from sextant.functions import rules
from sextant.operators.index import Index, dealt, meta, parts_of, term_frequency
from sextant.sources.files import chunk_id, chunk_lines, is_scanned, scan, windowed
from sextant.sources.generations import Commit, Generations, Layout, Merged
from sextant.sources.tables import stored_meanwhile

FILE_SCHEMA = "path string, content string, n_bytes long, mtime long"
#: Versions of files: a deleted one needs no content.
VERSION_SCHEMA = f"{FILE_SCHEMA}, deleted boolean"
#: Mark of a version: later ones are larger.
MARK = ("mtime", "deleted", "digest")
LAYOUT = Layout(
    key="file_path",
    row="chunk_id",
    schemas={
        "chunks": "chunk_id string, file_path string, chunk_index int, content string, line_start int, line_end int, mtime long",
        "postings": "token string, chunk_id string, tf long",
        "gone": "chunk_id string",
        "doc_freq": "token string, df long",
        "touched": "file_path string, mtime long, deleted boolean, digest string",
    },
    order={"chunks": "chunk_id", "postings": "token", "gone": "chunk_id"},
    buckets=parts_of,
)
CHUNK_COLUMNS = ("chunk_id", "file_path", "chunk_index", "content", "line_start", "line_end", "mtime")
#: Columns of a stream's version that say where its row is.
PLACE = ("file", "row")
#: Set for a stream's own session: a write's shuffle files go once it has ended, not when the driver next collects garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Source files of a micro-batch up to which they are named when its contents are read.
NAMED_FILES = 4096
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def versions(files: DataFrame, *more: str) -> DataFrame:
    """Files as versions with their mark, and the columns ``more``; null mtime counts as 0, null ``deleted`` as false, null content as empty."""
    deleted = F.coalesce("deleted", F.lit(False)) if "deleted" in files.columns else F.lit(False)
    content = F.coalesce("content", F.lit(""))
    return files.select("path", content.alias("content"), "n_bytes", F.coalesce("mtime", F.lit(0)).cast("long").alias("mtime"), deleted.alias("deleted"), F.md5(content).alias("digest"), *more)


def _mark() -> Column:
    return F.struct(*MARK)


class NewestVersion(StatefulProcessor):
    """Passes on a path's version if it is newer than all before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "mtime long, deleted boolean, digest string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = max(rows, key=lambda r: tuple(r[c] for c in MARK))
        mark = tuple(newest[c] for c in MARK)
        seen = self.seen.get()
        if seen is None or mark > tuple(seen):
            self.seen.update(mark)
            yield newest

    def close(self) -> None:
        pass


def newest_versions(stream: DataFrame, *carried: str) -> DataFrame:
    """The versions of a stream that are newer than all that came before for their path: path, mark and the columns ``carried``."""
    rows = stream.select("path", *MARK, *carried)
    return rows.groupBy("path").transformWithState(NewestVersion(), rows.schema, "Update", "None")


def tables(spark: SparkSession, out: str) -> Generations:
    return Generations(spark, out, LAYOUT)


def _sized(files: DataFrame, config: SearchConfig) -> DataFrame:
    """Versions with the number of their chunks, and the bytes of those that have any."""
    live = ~F.col("deleted") & F.coalesce(is_scanned(config), F.lit(False))
    sized = windowed(files, config).withColumn("n_chunks", F.when(live, F.size("windows")).otherwise(F.lit(0))).drop("windows")
    return sized.withColumn("size", F.when(live, F.octet_length("content")).otherwise(F.lit(0)).cast("long"))


def _generation(live: Generations, now: Merged, batch: int | None) -> int | None:
    """The number of the generation that a batch makes, if it was not made before."""
    gen = 2 * batch + 1 if batch is not None else (now.last or -1) // 2 * 2 + 3  # even ones are compactions
    return gen if now.last is None or gen > now.last else None


def apply_batch(files: DataFrame, out: str, config: SearchConfig = DEFAULT, batch: int | None = None, newest: bool = False) -> None:
    """Put a batch of new, changed or deleted files into the tables below ``out``.

    Of a path's versions the newest counts, in the batch and beside what the tables
    hold; ``newest`` says that the batch has one version of a path, newer than what they
    hold. A numbered batch that was applied already is passed over.
    """
    live = tables(files.sparkSession, out)
    now = live.now()
    gen = _generation(live, now, batch)
    if gen is None:
        return
    one = versions(files) if "digest" not in files.columns else files
    if not newest:
        one = one.groupBy("path").agg(F.max_by(F.struct("content", "n_bytes", *MARK), _mark()).alias("f")).select("path", "f.*")
        held = now.known().select(F.col("file_path").alias("path"), _mark().alias("held"))
        one = one.join(held, "path", "left").where(F.col("held").isNull() | (_mark() > F.col("held"))).drop("held")
    with stored_meanwhile(one, "stream-files") as one:
        chunks = chunk_lines(scan(one.where("NOT deleted").select("path", "content", "n_bytes", "mtime"), config), config)
        _append(live, now, gen, _sized(one, config).select("path", *MARK, "size"), lambda buckets: dealt(chunks, buckets))


def _append(live: Generations, now: Merged, gen: int, newer: DataFrame, dealt_chunks) -> None:
    """A generation of ``newer`` versions (path, mark, size); ``dealt_chunks`` gives their chunks in so many buckets."""
    size, n_files = newer.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not n_files:
        return
    buckets = now.buckets or parts_of(live.spark, size)
    put = lambda name, df: live.put(gen, buckets, name, df)
    touched = put("touched", newer.select(F.col("path").alias("file_path"), *MARK))
    chunks = put("chunks", dealt_chunks(buckets))
    postings = put("postings", term_frequency(chunks, "chunk_id", "content").select("token", "chunk_id", "tf"))
    changes, dead = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")), 0
    if now.commits:
        # only ids and paths are shuffled here
        gone = now.live("chunks").select("chunk_id", "file_path").join(touched.select("file_path"), "file_path", "left_semi").select("chunk_id")
        gone = put("gone", dealt(gone, buckets))
        dead = gone.count()
        if dead:
            went = now.live("postings").join(gone.hint("shuffle_hash"), "chunk_id", "left_semi").groupBy("token").agg((-F.count(F.lit(1))).alias("df"))
            changes = changes.unionByName(went).groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0")
    put("doc_freq", changes)
    n_chunks = chunks.count()
    now = live.append(now, Commit(gen, now.commits[-1].base if now.commits else gen, n_chunks, dead, size, buckets))
    if now.due:
        live.compacted(now, gen + 1, {"doc_freq": document_frequency(now)})


def _apply_streamed(newer: DataFrame, batch: int, source: str, out: str, config: SearchConfig) -> None:
    """Put a micro-batch of ``newest_versions`` into the tables: contents are read from the source once more, and dealt out."""
    newer.sparkSession.conf.set(SHUFFLES_GO, "true")
    live = tables(newer.sparkSession, out)
    now = live.now()
    gen = _generation(live, now, batch)
    if gen is None:
        return
    with stored_meanwhile(newer, "stream-newer") as newer:
        names = [r[0] for r in newer.select("file").distinct().limit(NAMED_FILES + 1).collect()]
        rows = _placed(newer.sparkSession.read.schema(VERSION_SCHEMA).parquet(source))
        if len(names) <= NAMED_FILES:
            rows = rows.where(F.col("file").isin(names))
        rows = versions(rows, *PLACE).where("NOT deleted")
        every = chunk_lines(scan(rows, config), config, PLACE)
        wanted = newer.where("n_chunks > 0").select(
            F.explode(F.transform(F.sequence(F.lit(0), F.col("n_chunks") - F.lit(1)), lambda i: chunk_id(rules.normal_path(F.col("path")), i))).alias("_id"),
            F.concat_ws("#", *PLACE).alias("_place"),
        )

        def chunks(buckets: int) -> DataFrame:
            # the place is worked out behind the shuffle: over a bare one Spark would deal anew into its own number of partitions
            found = dealt(every, buckets).select(*CHUNK_COLUMNS, F.concat_ws("#", *PLACE).alias("place"))
            # compared beside the key, so that the id alone deals; not a semi join, which would be done before rows are dealt
            same = (found["chunk_id"] == wanted["_id"]) & found["place"].between(wanted["_place"], wanted["_place"])
            return found.join(wanted.hint("shuffle_hash"), same).select(*CHUNK_COLUMNS)

        _append(live, now, gen, newer, chunks)


def document_frequency(now: Merged) -> DataFrame:
    """The sums of what generations gained and lost."""
    return now.rows("doc_freq").groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")


def _placed(files: DataFrame) -> DataFrame:
    """Rows of Parquet files with the place where each is."""
    return files.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def start(spark: SparkSession, source: str, out: str, checkpoint: str, config: SearchConfig = DEFAULT) -> StreamingQuery:
    """Follow Parquet files with VERSION_SCHEMA (``deleted`` may be missing) below ``source`` until no new ones are there."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    placed = _placed(spark.readStream.schema(VERSION_SCHEMA).parquet(source))
    stream = newest_versions(_sized(versions(placed, *PLACE), config), "n_chunks", "size", *PLACE)
    return (
        stream.writeStream.outputMode("update")
        .foreachBatch(lambda df, batch: _apply_streamed(df, batch, source, out, config))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def index_of(now: Merged) -> Index:
    """An index over the rows that count; frequencies are sums over generations."""
    chunks, n = now.live("chunks"), now.spark.range(1).select(F.lit(now.n_live).cast("long").alias("n"))
    return Index(chunks, now.live("postings"), document_frequency(now), meta(chunks), n, now.buckets)


def live_index(spark: SparkSession, out: str) -> Index:
    """The index as of the last generation."""
    return index_of(tables(spark, out).now())
