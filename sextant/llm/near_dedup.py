"""Near-duplicate removal by verified shingle overlap.

Two documents are linked if their sets of five-word shingles have a Jaccard
similarity of at least 0.8, worked out exactly. Pairs to work out come from

* SimHash fingerprints of the same shingles within four bits (``simhash.links``),
* min-hash bands: BANDS keys of BAND_ROWS minima each. A pair at 0.8 shares none
  of them with a probability of (1 - 0.8 ** 5) ** 24, or 7 in 100,000.

Rows that share a band are first tried against one of them, so that a group of near
copies costs few pairs. Of their minima one byte each is kept: a pair that agrees in
fewer than LIKELY of all 120 is not worked out (at 0.8, five standard deviations below
the mean, or less than one pair in a million). Of the others each row's likeliest pair is
worked out first, and then those whose ends are in different components. Where that
leaves the others of a band in several components, all pairs of different components
are tried, in blocks of bounded size. Texts travel with the pairs, as shingle sets are
larger and do not compress.

Of each component the smallest doc_id stays (null last, then the first row). Every
stored row has a locator of its own, so rows that repeat a doc_id, or have none,
are told apart. Null text counts as empty; empty texts are alike. Keys that many rows
share are split over tasks. Other columns pass through, whatever their names; an
empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType

from sextant.llm import simhash
from sextant.llm.common import bounded_batches, fresh, joined, numbered, stored, text_or_empty

SHINGLE_WORDS = 5
#: Least Jaccard similarity of a link, as a fraction of whole numbers.
LEAST = (4, 5)
BANDS = 24
BAND_ROWS = 5
#: Rows of a band that are tried against as many at once.
BLOCK_ROWS = 1000
#: Bytes of the pairs of texts in an Arrow batch.
BATCH_BYTES = "4m"
#: Shingles whose minima are taken at once.
BLOCK = 4096
#: Minima, of BANDS * BAND_ROWS, whose last bytes agree in a pair that is worked out.
LIKELY = 72
_ROW = "_near_row"

_FACTORS = np.random.default_rng(simhash.SEED).integers(0, 2**63, (2, BANDS * BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIGNATURE = f"{_ROW} long, n long, fp long, bands array<long>, minima binary"


def shingle_set(hashes: list[int]) -> np.ndarray:
    """Distinct shingle hashes; the empty text has one of its own."""
    return np.unique(np.array(hashes or [0], dtype=np.uint64).view(np.int64))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each permutation."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), BLOCK):
        x = shingles[at : at + BLOCK].view(np.uint64)
        np.minimum(least, (x * _FACTORS[0][:, None] + _FACTORS[1][:, None]).min(axis=1), out=least)
    return least


def bands(shingles: np.ndarray, least: np.ndarray | None = None) -> np.ndarray:
    """A key for each band: the minima of its permutations, mixed with its number."""
    least = minima(shingles) if least is None else least
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sizes, keys, prints, leasts, waiting, n = [], [], [], [], [], 0
        for raw in pdf["raw"]:
            hashes = simhash.shingle_hashes(raw, SHINGLE_WORDS)
            shingles = shingle_set(hashes)
            sizes.append(len(shingles))
            least = minima(shingles)
            keys.append(bands(shingles, least))
            leasts.append((least >> np.uint64(56)).astype(np.uint8).tobytes())
            waiting.append(hashes)
            n += len(hashes)
            if n >= simhash.BATCH_SHINGLES:
                prints.append(simhash.majority(waiting))
                waiting, n = [], 0
        prints.append(simhash.majority(waiting))
        yield pd.DataFrame({_ROW: pdf[_ROW].to_numpy(), "n": sizes, "fp": np.concatenate(prints), "bands": keys, "minima": leasts})


@lru_cache(maxsize=64)
def _set_of(raw: bytes) -> np.ndarray:
    return shingle_set(simhash.shingle_hashes(raw, SHINGLE_WORDS))


@F.pandas_udf(BooleanType())
def _texts_alike(one: pd.Series, two: pd.Series) -> pd.Series:
    over, under = LEAST

    def alike(a: bytes, b: bytes) -> bool:
        a, b = _set_of(a), _set_of(b)
        common = len(np.intersect1d(a, b, assume_unique=True))
        return common * under >= (len(a) + len(b) - common) * over

    return pd.Series([alike(a, b) for a, b in zip(one, two)], dtype=bool)


@F.pandas_udf(IntegerType())
def _agreeing(one: pd.Series, two: pd.Series) -> pd.Series:
    """Bytes that two strings of equal length have in common, place by place."""
    if not len(one):
        return pd.Series([], dtype="int32")
    rows = lambda x: np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1)
    return pd.Series((rows(one) == rows(two)).sum(axis=1).astype(np.int32))


def _alike(common: Column, one: Column, two: Column) -> Column:
    over, under = LEAST
    return common * under >= (one + two - common) * over


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs of two rows, the higher first."""
    return pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _worked_out(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose shingle sets are alike, stored."""
    side = lambda name: rows.select(F.col(_ROW).alias(name), F.encode(text_or_empty(), "UTF-8").alias("t" + name))
    both = pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v")
    return stored(both.where(_texts_alike("tu", "tv")).select("u", "v"), "near-links")


def _verified(rows: DataFrame, signed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links (u, v) among the pairs, all that components need."""
    side = lambda name: signed.select(F.col(_ROW).alias(name), F.col("minima").alias("m" + name))
    likely = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", _agreeing("mu", "mv").alias("same")).where(F.col("same") >= LIKELY)
    likely = stored(likely, "near-likely")
    best = likely.groupBy("u").agg(F.max_by("v", F.struct("same", "v")).alias("v"))
    found = _worked_out(rows, best)
    roots = stored(simhash.stars(found).withColumnRenamed("v", "root"), "near-roots")
    of = lambda name: roots.select(F.col("u").alias(name), F.col("root").alias("r" + name))
    apart = likely.join(of("u"), "u", "left").join(of("v"), "v", "left").where(F.coalesce("ru", "u") != F.coalesce("rv", "v"))
    tried = best.select("u", "v")  # not alike, as their ends are apart
    return found.unionByName(_worked_out(rows, apart.join(tried, ["u", "v"], "left_anti")))


def _fingerprint_pairs(signed: DataFrame) -> DataFrame:
    """Rows of one fingerprint against the first of them, and linked fingerprints' first rows."""
    classes = stored(signed.groupBy("fp").agg(F.min(_ROW).alias("first"), F.count(F.lit(1)).alias("c")), "near-classes")
    same = joined(signed.select("fp", _ROW), classes, "fp", "c").select(F.col(_ROW).alias("a"), F.col("first").alias("b"))
    of = lambda name, to: classes.select(F.col("fp").alias(name), F.col("first").alias(to))
    near = simhash.links(classes).join(of("u", "a"), "u").join(of("v", "b"), "v").select("a", "b")
    return same.unionByName(near)


def _may_be_alike(one: str, two: str) -> Column:
    """Sizes of sets that can reach the similarity at all."""
    return _alike(F.least(one, two), F.col(one), F.col(two))


def _hub_pairs(members: DataFrame) -> DataFrame:
    """Each row of a band against one row of it."""
    pick = F.min(F.struct(F.col(_ROW).alias("hub"), F.col("n").alias("hub_n")))
    hubs = members.groupBy("key").agg(pick.alias("h"), F.count(F.lit(1)).alias("c")).select("key", "h.hub", "h.hub_n", "c")
    met = joined(members, stored(hubs, "near-hubs"), "key", "c").where(_may_be_alike("n", "hub_n"))
    return met.select(F.col(_ROW).alias("a"), F.col("hub").alias("b"))


def _untried(placed: DataFrame) -> DataFrame:
    """The rows of bands that have pairs yet to be tried: the band's hub has met all others."""
    firsts = placed.groupBy("key").agg(F.min(_ROW).alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 2").select("key", "hub")
    rest = stored(placed.join(firsts, "key").where(F.col(_ROW) != F.col("hub")).drop("hub"), "near-rest")
    split = rest.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return stored(rest.join(split, "key", "left_semi"), "near-untried")


def forest(rows: np.ndarray, roots: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links within a group that join all its components that any link joins."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    rows, place, sets = rows[order], np.unique(roots[order], return_inverse=True)[1], [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(sizes)]
    flat = np.concatenate(sets)
    over, under = LEAST
    one, two = [], []
    for c in range(len(rows) - 1):
        end = int(np.searchsorted(sizes * over, sizes[c] * under, side="right"))
        if end <= c + 1 or not (place[c + 1 : end] != place[c]).any():
            continue
        rest = flat[starts[c + 1] : starts[end]]
        same = sets[c][np.minimum(np.searchsorted(sets[c], rest), sizes[c] - 1)] == rest
        common = np.add.reduceat(same, starts[c + 1 : end] - starts[c + 1], dtype=np.int64)
        alike = common * under >= (sizes[c + 1 : end] + sizes[c] - common) * over
        for i in (np.flatnonzero(alike) + c + 1).tolist():
            if place[i] != place[c]:
                one.append(int(rows[i]))
                two.append(int(rows[c]))
                place[place == place[i]] = place[c]
    return one, two


def _link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by block; a block may go on in the next batch."""
    kept: list[pd.DataFrame] = []

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        us, vs = [], []
        block, rows, roots = (pdf[x].to_numpy() for x in ("block", _ROW, "root"))
        raw = pdf["raw"].tolist()
        cut = np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(block)]
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            u, v = forest(rows[a:b], roots[a:b], [_set_of(x) for x in raw[a:b]])
            us += u
            vs += v
        return pd.DataFrame({"a": np.array(us, np.int64), "b": np.array(vs, np.int64)}).drop_duplicates()

    for pdf in batches:
        if not len(pdf):
            continue
        whole = int((pdf["block"] != pdf["block"].iloc[-1]).sum())
        if whole or (kept and kept[-1]["block"].iloc[-1] != pdf["block"].iloc[0]):
            yield edges(pd.concat([*kept, pdf.iloc[:whole]]))
            kept = []
        kept.append(pdf.iloc[whole:])
    if kept:
        yield edges(pd.concat(kept))


def _block_links(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Links (u, v) between components within each band, of rows with their root."""
    sized = members.join(members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks")), "key")
    own = sized.withColumn("own", F.pmod(F.xxhash64(_ROW), "blocks"))
    other = own.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    block = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("block")
    dealt = other.select(block, _ROW, "root")
    held = dealt.join(rows.select(_ROW, F.encode(text_or_empty(), "UTF-8").alias("raw")), _ROW)
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = held.repartition(width, "block").sortWithinPartitions("block").mapInPandas(_link, "a long, b long")
    return stored(_ordered(found), "near-links")


def components(rows: DataFrame) -> DataFrame:
    """(u, v): each row (locator) of a component but its lowest, and the lowest."""
    bounded_batches(rows.sparkSession)
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    raw = rows.select(_ROW, F.encode(text_or_empty(), "UTF-8").alias("raw"))
    signed = stored(raw.mapInPandas(_sign, _SIGNATURE), "near-signatures")
    each = signed.select(F.explode("bands").alias("key"), _ROW, "n")
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    members = stored(each.join(shared, "key", "left_semi"), "near-members")
    tried = stored(_ordered(_fingerprint_pairs(signed).unionByName(_hub_pairs(members))), "near-pairs")
    found = _verified(rows, signed, tried)
    roots = simhash.stars(found).select(F.col("u").alias(_ROW), F.col("v").alias("root"))
    placed = stored(members.join(roots, _ROW, "left").withColumn("root", F.coalesce("root", _ROW)), "near-members")
    more = _block_links(rows, _untried(placed))
    return simhash.stars(found.unionByName(more))


def keep_first(docs: DataFrame, from_files: bool = False) -> DataFrame:
    """One document of each component, the smallest doc_id, with all its columns.

    ``from_files`` says that ``docs`` are a Parquet table as read, at most filtered and
    projected. Its rows are then known by file and place, and no copy of them is stored.
    """
    row = fresh(docs, _ROW)
    held = numbered(docs, row, "near-rows", from_files)
    rows = held.select(F.col(row).alias(_ROW), "doc_id", "text")
    linked = components(rows)
    members = linked.select(F.col("u").alias(_ROW), "v").unionByName(linked.select(F.col("v").alias(_ROW), "v").distinct())
    known = rows.select(_ROW, F.col("doc_id").cast("long").alias("doc_id")).join(members, _ROW)
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id"), F.col(_ROW).alias("row"))
    known = stored(known, "near-known")
    first = known.groupBy("v").agg(F.min(order)["row"].alias("first"), F.count(F.lit(1)).alias("c"))
    met = joined(known.select("v", _ROW), stored(first, "near-first"), "v", "c")
    gone = met.where(F.col(_ROW) != F.col("first")).select(F.col(_ROW).alias(row))
    return held.join(gone, row, "left_anti").select(*docs.columns)
