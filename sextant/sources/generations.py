"""Tables kept current by generations that are merged when read.

A change appends a generation: new rows of each table, the keys it touches, and the ids
of the older rows that no longer count. Nothing that lies there is written again. A row
counts as long as no later generation names its id in ``gone``. Tables of rows and
``gone`` lie in buckets by id, as many in each generation, so a reader joins each bucket
by itself and shuffles nothing; the plan has one scan of each table however many
generations there are. ``compacted`` writes the rows that count as one new generation,
the base that readers start from, and is due once the share of dead rows is above
DEAD_SHARE, generations are more than MOST_GENERATIONS, or the rows are GROWN times as
many bytes as the buckets were made for; it makes as many as are needed then.

A generation is visible once its commit is written, as the last of its files. Writing
one is idempotent, so a change that is run again after a failure leaves the same tables.
One writer at a time. What an older base alone needs is deleted by the next compaction
but one, so that readers have time to end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sextant.sources.tables import bucketed, in_buckets, read_or_empty

DEAD_SHARE = 0.5
MOST_GENERATIONS = 64
GROWN = 4

#: Of the tables' files, which hold texts and lie for long.
COMPRESSION = "zstd"
COMMIT_SCHEMA = "gen long, base long, rows long, dead long, n_bytes long, buckets int"


@dataclass(frozen=True)
class Commit:
    gen: int
    base: int
    rows: int
    dead: int
    n_bytes: int  # of the rows
    buckets: int  # those of the base


@dataclass(frozen=True)
class Layout:
    """What tables there are, and how they lie."""

    key: str  # the column whose values a change touches
    row: str  # the column that tables of rows, and ``gone``, lie in buckets by: a row's id
    schemas: dict[str, str]  # ``touched`` holds the key and what is known of it, ``gone`` the row
    order: dict[str, str]  # of each table in buckets, the column that a bucket is sorted by
    buckets: Callable[[SparkSession, int], int]  # for so many bytes


@dataclass(frozen=True)
class Merged:
    """Tables as of some commits, from a base on."""

    spark: SparkSession
    path: str
    layout: Layout
    commits: list[Commit]

    @property
    def last(self) -> int | None:
        return self.commits[-1].gen if self.commits else None

    @property
    def n_live(self) -> int:
        return sum(c.rows - c.dead for c in self.commits)

    @property
    def n_bytes(self) -> int:
        """Of all rows, dead ones too."""
        return sum(c.n_bytes for c in self.commits)

    @property
    def buckets(self) -> int | None:
        return self.commits[0].buckets if self.commits else None

    @property
    def due(self) -> bool:
        """Whether a compaction is."""
        dead = sum(c.dead for c in self.commits)
        if len(self.commits) > MOST_GENERATIONS or (len(self.commits) > 1 and dead > DEAD_SHARE * sum(c.rows for c in self.commits)):
            return True
        return self.layout.buckets(self.spark, self.n_bytes) > GROWN * self.buckets

    def rows(self, name: str, after: int | None = None) -> DataFrame:
        """All rows from the base on, or of generations after one; dead ones too, with their ``gen``."""
        gens = [c.gen for c in self.commits if after is None or c.gen > after]
        schema = f"{self.layout.schemas[name]}, gen long"
        if name in self.layout.order and self.commits:
            return in_buckets(self.spark, f"{self.path}/{name}", StructType.fromDDL(schema), self.buckets, self.layout.row, self.layout.order[name], parts=("gen", gens))
        return read_or_empty(self.spark, f"{self.path}/{name}", schema).where(F.col("gen").isin(gens))

    def live(self, name: str) -> DataFrame:
        """The rows that count, bucket by bucket."""
        rows, base = self.rows(name), self.commits[0].gen if self.commits else 0
        gone = self.rows("gone", base).select(F.col(self.layout.row).alias("_row"), F.col("gen").alias("_gen")).hint("shuffle_hash")
        return rows.join(gone, (rows[self.layout.row] == gone["_row"]) & (rows["gen"] < gone["_gen"]), "left_anti").drop("gen")

    def known(self) -> DataFrame:
        """The latest ``touched`` row of each key."""
        rows = self.rows("touched")
        own = [c for c in rows.columns if c not in (self.layout.key, "gen")]
        return rows.groupBy(self.layout.key).agg(F.max_by(F.struct(*own), "gen").alias("_last")).select(self.layout.key, "_last.*")


@dataclass(frozen=True)
class Generations:
    """Tables below ``path``."""

    spark: SparkSession
    path: str
    layout: Layout

    def _commits(self) -> list[Commit]:
        """Few: those before the last base but one are deleted."""
        rows = read_or_empty(self.spark, f"{self.path}/commits", COMMIT_SCHEMA).select("gen", "base", "rows", "dead", "n_bytes", "buckets").collect()
        return sorted((Commit(*r) for r in rows), key=lambda c: c.gen)

    def now(self, version: int | None = None) -> Merged:
        """The tables as of the last generation, or as of a given one that is still there."""
        found = self._commits()
        if any(c.gen == version for c in found):
            found = [c for c in found if c.gen <= version]
        own = [c for c in found if c.gen >= found[-1].base]
        if own and own[0].gen != own[0].base:  # its base has been deleted
            return self.now()
        return Merged(self.spark, self.path, self.layout, own)

    def put(self, gen: int, buckets: int, name: str, df: DataFrame) -> DataFrame:
        """A table of a generation, not seen before the commit; rows in buckets should be dealt out so. Read back."""
        path = f"{self.path}/{name}/gen={gen}"
        if name in self.layout.order:
            return bucketed(df, path, buckets, self.layout.row, self.layout.order[name], mode="overwrite", compression=COMPRESSION)
        df.write.mode("overwrite").parquet(path, compression=COMPRESSION)
        return self.spark.read.schema(df.schema).parquet(path)

    def append(self, now: Merged, commit: Commit) -> Merged:
        """Let a generation be seen whose tables were all put."""
        row = self.spark.createDataFrame([(commit.gen, commit.base, commit.rows, commit.dead, commit.n_bytes, commit.buckets)], COMMIT_SCHEMA)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/commit={commit.gen}")
        return replace(now, commits=[*now.commits, commit])

    def compacted(self, now: Merged, gen: int, merged: dict[str, DataFrame]) -> Merged:
        """Write what counts as generation ``gen``, the new base; tables without the key are given ``merged``."""
        buckets = max(now.buckets, self.layout.buckets(self.spark, now.n_bytes))
        dealt = lambda df: df if buckets == now.buckets else df.repartition(buckets, self.layout.row)
        live = {name: dealt(now.live(name)) for name in self.layout.order if name != "gone"}
        for name, df in (live | {"touched": now.known()} | merged).items():
            self.put(gen, buckets, name, df)
        # dead rows count in n_bytes until then; of the new base their share is left out
        share = now.n_live / max(1, sum(c.rows for c in now.commits))
        new = self.append(replace(now, commits=[]), Commit(gen, gen, now.n_live, 0, int(now.n_bytes * share), buckets))
        self._delete_before(now.commits[0].gen)
        return new

    def _delete_before(self, gen: int) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for c in self._commits():
            for folder in (f"commits/commit={c.gen}", *(f"{name}/gen={c.gen}" for name in self.layout.schemas)) if c.gen < gen else ():
                fs_path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
                fs_path.getFileSystem(conf).delete(fs_path, True)
