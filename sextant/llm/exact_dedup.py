"""Exact deduplication against a history, by a minimal perfect hash.

The distinct digests of the history are dealt into buckets by their leading
bits; each bucket gets a minimal perfect hash (levels of collision-free bits,
slot = rank of the bit) whose slots hold the full digest and the locator of the
winning row. Digests of incoming rows are looked up by slot and compared byte
for byte: members join their slot's group, the rest form groups of their own.

Null text counts as empty. Rows are aggregated per digest before any shuffle by
bucket, so a group that holds a third of all rows costs one row per map task; where
rows meet their groups again, such a group is split over tasks.
In ``dedup``, rows that repeat a doc_id with equal text are one document: they are
kept or not together, and each counts in ``group_size``; ``keep_first`` leaves one.
Only ``doc_id`` and ``text`` are read, so other columns may have any name. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import SPACE_CLASS, fresh, id_remainder, joined, numbered, stored, text_or_empty

#: Digests that one bucket of the index holds on average.
BUCKET_KEYS = 2048
#: Bits per key in a level of the hash.
LOAD = 1.5

_INDEX_SCHEMA = (
    "bucket long, level_bits array<int>, bits binary, digests binary, "
    "win_ids array<long>, win_known array<boolean>, win_lens array<long>, win_rows array<long>"
)
_GROUP_SCHEMA = (
    "digest binary, bucket long, slot long, member boolean, "
    "keep_id long, keep_known boolean, keep_len long, group_size long"
)


def normalised(text: Column) -> Column:
    """The text without ASCII white space; equal texts are equal in this form."""
    return F.regexp_replace(text, SPACE_CLASS + "+", "")


def digests(docs: DataFrame, *more: Column | str) -> DataFrame:
    """doc_id, code points of the original text, SHA-256 of the normalised text."""
    text = text_or_empty()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(text).cast("long").alias("n_points"),
        F.sha2(normalised(text), 256).alias("text_sha256"),
        *more,
    )


def winners(rows: DataFrame) -> DataFrame:
    """One row per digest: the longest original, then the smallest doc_id.

    A null doc_id loses against any other. Ids go on without nulls, as 0 where ``known``
    is false, because pandas would turn longs beside nulls into doubles.
    """
    order = F.struct(
        F.col("n_points"),
        F.col("doc_id").isNotNull().alias("known"),
        F.bitwise_not(F.coalesce(F.col("doc_id"), F.lit(0))).alias("low"),
    )
    best = rows.groupBy("text_sha256").agg(
        F.max(order).alias("best"), F.count(F.lit(1)).alias("n_rows")
    )
    return best.select(
        F.unhex("text_sha256").alias("digest"),
        F.bitwise_not("best.low").alias("win_id"),
        F.col("best.known").alias("known"),
        F.col("best.n_points").alias("win_len"),
        "n_rows",
    )


def bucketed(found: DataFrame, n_buckets: int) -> DataFrame:
    lead = F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long")
    return found.withColumn("bucket", lead % F.lit(n_buckets))


def _as_words(digest_bytes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digest_bytes), dtype="<u8").reshape(-1, 4)


def _positions(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where each key falls in a level: its 256 bits mixed with the level number."""
    x = words[:, level % 4] ^ (words[:, (level + 1) % 4] * np.uint64(2 * level + 1))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    return (x % np.uint64(size)).astype(np.int64)


def build_hash(words: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes and the bits of all levels. Each key is alone on one set bit.

    Keys that share a position in a level go on to the next; distinct keys part
    sooner or later, so the loop ends.
    """
    sizes, parts, rest = [], [], words
    while len(rest):
        size = max(1, int(len(rest) * LOAD))
        at = _positions(rest, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        parts.append(alone)
        rest = rest[~alone[at]]
    return sizes, np.concatenate(parts) if parts else np.zeros(0, bool)


def slots_of(words: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 where no level has its bit."""
    rank = np.cumsum(bits) - 1
    slot = np.full(len(words), -1, dtype=np.int64)
    open_ = np.arange(len(words))
    offset = 0
    for level, size in enumerate(sizes):
        if not len(open_):
            break
        at = offset + _positions(words[open_], level, size)
        hit = bits[at]
        slot[open_[hit]] = rank[at[hit]]
        open_ = open_[~hit]
        offset += size
    return slot


def _build_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = pdf["digest"].tolist()
    words = _as_words(keys)
    sizes, bits = build_hash(words)
    order = np.empty(len(keys), dtype=np.int64)
    order[slots_of(words, sizes, bits)] = np.arange(len(keys))
    column = lambda name: pdf[name].to_numpy()[order].tolist()
    return pd.DataFrame(
        {
            "bucket": [int(pdf["bucket"].iloc[0])],
            "level_bits": [sizes],
            "bits": [np.packbits(bits).tobytes()],
            "digests": [b"".join(keys[i] for i in order)],
            "win_ids": [column("win_id")],
            "win_known": [column("known")],
            "win_lens": [column("win_len")],
            "win_rows": [column("n_rows")],
        }
    )


def build_index(history: DataFrame, n_buckets: int) -> DataFrame:
    """The index of a history given as ``winners``: one row per bucket."""
    return bucketed(history, n_buckets).groupBy("bucket").applyInPandas(_build_bucket, _INDEX_SCHEMA)


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (id, known, length): the longer, then the smaller id, an unknown one last."""
    rank = lambda x: (x[2], x[1], -x[0])
    return a if rank(a) >= rank(b) else b


def _lookup_bucket(incoming: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    rows: list[tuple] = []
    slots: list[list] = []
    keys = incoming["digest"].tolist() if len(incoming) else []
    bucket = int(index["bucket"].iloc[0] if len(index) else incoming["bucket"].iloc[0])
    hit = np.full(len(keys), -1, dtype=np.int64)
    if len(index):
        entry = index.iloc[0]
        sizes = [int(x) for x in entry["level_bits"]]
        bits = np.unpackbits(np.frombuffer(entry["bits"], np.uint8), count=sum(sizes)).astype(bool)
        held = [entry["digests"][i : i + 32] for i in range(0, len(entry["digests"]), 32)]
        held_facts = ("win_ids", "win_known", "win_lens", "win_rows")
        slots = [[*x] for x in zip(*(entry[name].tolist() for name in held_facts))]
        if keys:
            hit = slots_of(_as_words(keys), sizes, bits)
            hit = np.array([s if s >= 0 and held[s] == k else -1 for s, k in zip(hit, keys)], dtype=np.int64)
    if keys:
        found = zip(keys, hit, *(incoming[name].tolist() for name in ("win_id", "known", "win_len", "n_rows")))
        for key, slot, doc, known, length, n in found:
            if slot < 0:
                rows.append((key, bucket, -1, False, doc, known, length, n))
            else:
                *old, old_n = slots[slot]
                slots[slot] = [*_better(tuple(old), (doc, known, length)), old_n + n]
    rows += [(held[s], bucket, s, True, *slots[s]) for s in range(len(slots))]
    names = ["digest", "bucket", "slot", "member", "keep_id", "keep_known", "keep_len", "group_size"]
    out = pd.DataFrame(rows, columns=names)
    return out.assign(slot=out["slot"].astype("Int64").where(out["member"].astype(bool)))


def group(index: DataFrame, incoming: DataFrame, n_buckets: int) -> DataFrame:
    """Groups after the incoming ``winners``: a row per slot and per nonmember."""
    return (
        bucketed(incoming, n_buckets)
        .groupBy("bucket")
        .cogroup(index.groupBy("bucket"))
        .applyInPandas(_lookup_bucket, _GROUP_SCHEMA)
    )


def dedup(docs: DataFrame, in_history: Column | None = None, *more: str) -> DataFrame:
    """One row per document: who stays for it, its group's size, whether it stays.

    Columns named in ``more`` are added as they came.

    ``in_history`` says which rows are the history that the index is built of;
    by default those with an even crc32 of doc_id, so that every table passes
    both through the index and through the lookups.
    """
    if in_history is None:
        in_history = id_remainder(2) == 0
    past = F.coalesce(in_history, F.lit(False)).alias("past")
    rows = stored(digests(docs, past, *more), "exact-digests")
    n_buckets = max(1, -(-rows.where("past").count() // BUCKET_KEYS))
    index = stored(build_index(winners(rows.where("past")), n_buckets), "exact-index")
    groups = group(index, winners(rows.where("NOT past")), n_buckets).select(
        F.lower(F.hex("digest")).alias("text_sha256"), F.when(F.col("keep_known"), F.col("keep_id")).alias("keep_id"), "keep_len", "group_size", "member"
    )
    return joined(rows, stored(groups, "exact-groups"), "text_sha256", "group_size").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_len"))).alias("kept"),
        "text_sha256",
        F.col("member").alias("in_history"),
        *more,
    )


def keep_first(docs: DataFrame, from_files: bool = False) -> DataFrame:
    """One row of each group, with all its columns as they came.

    Rows that repeat the doc_id (or have none) and text of the one that stays are
    told apart by a locator; the first of them stays.

    ``from_files`` says that ``docs`` are a Parquet table as read, at most filtered and
    projected. Its rows are then known by file and place, and no copy of them is stored.
    """
    row = fresh(docs, "_exact_row")
    rows = numbered(docs, row, "exact-rows", from_files)
    kept = dedup(rows, None, row).where("kept")
    stay = kept.groupBy("text_sha256").agg(F.min(row).alias(row)).select(row)
    return rows.join(stay, row, "left_semi").select(*docs.columns)
