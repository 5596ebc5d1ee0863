"""Sharding by jump consistent hashing, in DataFrame functions only.

A stable 64-bit key is stepped through the linear congruential generator of the
jump hash (Lamping and Veach, 2014); each step jumps to a later shard number
until the shard count is passed, and the last number before that is the shard.
There is no ring table, and one more shard takes rows only into itself: about
one row in ``n_shards + 1`` moves.

The generator needs products modulo 2**64, which ANSI mode would reject as
overflow, so the state is kept in three limbs of 22, 22 and 20 bits.

The id and the shard count alone decide the shard. A null id is a key like any
other. Null text counts as empty. Slots count each shard's rows without a gap:
rows are dealt to sub-groups of bounded size by a second hash, of id and text, so
that rows that share an id are dealt too, and numbered within the sub-group, so no
task holds a whole shard. Rows alike in both get slots of their own in any order.
An empty table gives none. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import text_or_empty

#: Fixed value: multiplier of the jump hash's generator.
MULTIPLIER = 2862933555777941757
#: Rows that one numbering group holds on average.
GROUP_ROWS = 20_000

_LOW = (1 << 22) - 1
_HIGH = (1 << 20) - 1


def _limbs(x: Column) -> Column:
    return F.struct(
        x.bitwiseAND(F.lit(_LOW)).alias("a"),
        F.shiftrightunsigned(x, 22).bitwiseAND(F.lit(_LOW)).alias("b"),
        F.shiftrightunsigned(x, 44).alias("c"),
    )


def _stepped(k: Column) -> Column:
    """k * MULTIPLIER + 1 modulo 2**64, limb by limb."""
    m0, m1, m2 = MULTIPLIER & _LOW, MULTIPLIER >> 22 & _LOW, MULTIPLIER >> 44
    p0 = k["a"] * F.lit(m0) + F.lit(1)
    p1 = k["a"] * F.lit(m1) + k["b"] * F.lit(m0) + F.shiftright(p0, 22)
    p2 = k["a"] * F.lit(m2) + k["b"] * F.lit(m1) + k["c"] * F.lit(m0) + F.shiftright(p1, 22)
    return F.struct(
        p0.bitwiseAND(F.lit(_LOW)).alias("a"),
        p1.bitwiseAND(F.lit(_LOW)).alias("b"),
        p2.bitwiseAND(F.lit(_HIGH)).alias("c"),
    )


def _jump(state: Column) -> Column:
    """One jump: from shard j to a later one, at odds that fall as 1/j."""
    key = _stepped(state["key"])
    top = F.shiftleft(key["c"], 11) + F.shiftright(key["b"], 11)
    to = F.floor((state["to"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / (top + F.lit(1)).cast("double")))
    return F.struct(key.alias("key"), state["to"].alias("at"), to.cast("long").alias("to"))


def jump_hash(key: Column, n_shards: int) -> Column:
    """struct(shard, grown): the shard of n_shards, and that of one more.

    A jump always goes up, so n_shards + 1 jumps always suffice, but about
    ln(n_shards) are expected: a short chain is run first, and only rows that
    it leaves unfinished run the full one.
    """
    start = F.struct(_limbs(key).alias("key"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("to"))
    going = lambda s: F.when(s["to"] < F.lit(n_shards), _jump(s)).otherwise(s)

    def run(first: Column, jumps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(jumps)), first, lambda s, _: going(s))

    jumps = min(n_shards + 1, 3 * n_shards.bit_length() + 4)
    short = run(start, jumps)
    # a one-element array binds the chain's end to a name, so that it is computed once
    done = F.transform(F.array(short), lambda s: F.when(s["to"] < F.lit(n_shards), run(s, n_shards + 1)).otherwise(s))
    return F.transform(
        done,
        lambda s: F.struct(
            s["at"].cast("int").alias("shard"),
            F.when(s["to"] == F.lit(n_shards), s["to"]).otherwise(s["at"]).cast("int").alias("grown"),
        ),
    )[0]


def stable_key(name: str = "doc_id") -> Column:
    """The 64-bit key of an id of any type."""
    return F.xxhash64(F.lit("shard"), F.col(name).cast("string"))


def shard(docs: DataFrame, n_shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    n_groups = max(1, -(-docs.count() // (n_shards * GROUP_ROWS)))
    text = text_or_empty()
    jumped = jump_hash(stable_key(), n_shards)
    group = F.pmod(F.xxhash64(F.lit("slot"), F.col("doc_id").cast("string"), F.crc32(text)), F.lit(n_groups)).cast("int")
    offsets = (
        docs.select(jumped["shard"].alias("shard"), group.alias("part"))
        .groupBy("shard", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn(
            "before",
            F.coalesce(
                F.sum("n").over(
                    Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .select("shard", "part", "before")
    )
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        jumped.alias("jumped"),
        group.alias("part"),
    ).select("doc_id", "size", "text_crc32", "jumped.shard", "jumped.grown", "part")
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("nth", F.row_number().over(order))
        .join(offsets, ["shard", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("before") + F.col("nth") - F.lit(1)).cast("long").alias("slot"),
            F.col("grown").alias("grown_shard"),
        )
    )


def write_shards(docs: DataFrame, n_shards: int, path: str) -> None:
    """Write all columns of ``docs`` as Parquet, a folder for each shard.

    The column ``shard`` of the output is the folder's; a column of that name in
    ``docs`` is refused rather than overwritten.
    """
    if "shard" in docs.columns:
        raise ValueError("docs already has a column named shard")
    jumped = jump_hash(stable_key(), n_shards)
    docs.withColumn("shard", jumped["shard"]).write.partitionBy("shard").parquet(path)
