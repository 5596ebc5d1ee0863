"""Exact nearest vectors without scoring them all: cells around pivots, rings of angles.

Every vector lies in the cell of its nearest pivot and in a ring of its angle to it.
Angles obey the triangle inequality, so the angle of a query to any vector of a ring is
at least the query's angle to the pivot less the ring's largest, or the ring's smallest
less it. A search scores the rings of the best bounds until they hold k vectors, and
then only the rings whose bound reaches the k-th best of those.

Pivots are fitted on at most SAMPLE vectors, drawn by a hash of the id; all vectors are
indexed. Rings of more than PART_ROWS vectors are dealt over parts. Null vectors are
left out; zero vectors have a cell of their own and a cosine of 0 to all, as in
``vector_search``. Ties go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.operators.vector_search import PASS_QUERIES, _trimmed, _unit
from sextant.sources.tables import stored

#: Vectors that pivots are fitted on, and the most pivots.
SAMPLE = 8192
MOST_CELLS = 1024
#: Rounds in which pivots move to the middle of their cell.
ROUNDS = 6
#: Rings that the angles from 0 to pi fall into.
RINGS = 64
#: Vectors of a part of a ring, on average, queries scored at once, and bounds (of queries to rings) worked out at once.
PART_ROWS = 8192
QUERY_BLOCK = 64
BOUNDS = 1 << 20
#: What angles and cosines may be off by.
ANGLE_SLACK = 1e-6
COSINE_SLACK = 1e-8
#: The cell of zero vectors.
ZERO = -1


@dataclass(frozen=True)
class PivotIndex:
    """items(block, cell, id, unit), rings(cell, ring, low, high, n, parts) and the pivots."""

    items: DataFrame
    rings: DataFrame
    pivots: np.ndarray


def fit(vectors: DataFrame) -> np.ndarray:
    """Pivots, as many as the root of the number of vectors: middles of cells of a sample."""
    known = vectors.where("vec IS NOT NULL")
    n = known.count()
    sample = known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").collect()
    units = _unit(np.array([r["vec"] for r in sample], dtype=np.float64).reshape(len(sample), -1)) if sample else np.zeros((0, 1))
    units = units[units.any(axis=1)]
    pivots = units[: max(1, min(MOST_CELLS, isqrt(n)))]
    for _ in range(ROUNDS if len(pivots) else 0):
        cell = (units @ pivots.T).argmax(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, cell, units)
        moved = _unit(sums)
        pivots = np.where(moved.any(axis=1, keepdims=True), moved, pivots)
    return pivots


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def _block(cell, ring, part):
    """One number for a part of a ring."""
    return ((cell - ZERO) * (RINGS + 1) + ring) * 2**32 + part


def build(vectors: DataFrame, pivots: np.ndarray | None = None) -> PivotIndex:
    """The index of (id, vec), stored in partitions of cells, parts in order."""
    pivots = fit(vectors) if pivots is None else pivots
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            units = _unit(np.stack(pdf["vec"].to_numpy()).astype(np.float64))
            cell, angle = np.full(len(units), ZERO), np.zeros(len(units))
            some = units.any(axis=1)
            if some.any() and len(shared.value):
                angles = _angles(units[some], shared.value)
                cell[some], angle[some] = angles.argmin(axis=1), angles.min(axis=1)
            elif some.any():
                cell[some] = 0
            yield pd.DataFrame({"id": pdf["id"], "unit": list(units), "cell": cell, "ring": (angle / np.pi * RINGS).astype(int), "angle": angle})

    kind = vectors.schema["id"].dataType.simpleString()
    known = vectors.select("id", "vec").where("vec IS NOT NULL")
    placed = stored(known.mapInPandas(place, f"id {kind}, unit array<double>, cell int, ring int, angle double"), "pivot-placed")
    sizes = placed.groupBy("cell", "ring").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("n"))
    rings = stored(sizes.withColumn("parts", F.ceil(F.col("n") / PART_ROWS)), "pivot-rings")
    part = F.pmod(F.xxhash64("id"), "parts")
    items = placed.join(rings.select("cell", "ring", "parts"), ["cell", "ring"]).select(
        _block(F.col("cell").cast("long"), F.col("ring"), part).alias("block"), "cell", "id", "unit"
    )
    # cells of any size are split over tasks, which write few files each
    return PivotIndex(stored(items.hint("rebalance", "cell").sortWithinPartitions("cell", "block"), "pivot-items"), rings, pivots)


def _bounds(units: np.ndarray, pivots: np.ndarray, rings: pd.DataFrame) -> np.ndarray:
    """The largest cosine that each query can have to a vector of each ring."""
    cell = rings["cell"].to_numpy()
    own = cell != ZERO
    bounds = np.zeros((len(units), len(rings)))
    if len(pivots) and own.any():
        angle = _angles(units, pivots)[:, cell[own]]
        least = np.maximum(angle - rings["high"].to_numpy()[own], rings["low"].to_numpy()[own] - angle)
        bounds[:, own] = np.cos(np.maximum(least - ANGLE_SLACK, 0.0))
    bounds[~units.any(axis=1)] = 0.0
    return bounds


def _wanted(asked: DataFrame, index: PivotIndex, k: int, first: bool) -> DataFrame:
    """(block, at): parts with the places of the queries that want them: those that hold k vectors at the best bounds, or all others that reach ``least``."""
    shared = asked.sparkSession.sparkContext.broadcast((index.pivots, index.rings.orderBy("cell", "ring").toPandas()))

    def want(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, rings = shared.value
        n, parts = rings["n"].to_numpy(), rings["parts"].to_numpy()
        base = _block(rings["cell"].to_numpy(np.int64), rings["ring"].to_numpy(), 0)
        step = max(1, BOUNDS // max(1, len(rings)))
        for pdf in batches:
            for at in range(0, len(pdf) if len(rings) else 0, step):
                some = pdf.iloc[at : at + step]
                bounds = _bounds(np.stack(some["unit"].to_numpy()), pivots, rings)
                order = np.argsort(-bounds, axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                take = np.zeros(bounds.shape, dtype=bool)
                np.put_along_axis(take, order, before < k, axis=1)
                if not first:
                    take = ~take & (bounds >= some["least"].to_numpy()[:, None] - COSINE_SLACK)
                r, q = np.nonzero(take.T)
                r, starts = np.unique(r, return_index=True)
                places = np.split(some["at"].to_numpy()[q], starts[1:]) if len(r) else []
                nth = np.arange(parts[r].sum()) - np.repeat(np.cumsum(parts[r]) - parts[r], parts[r])
                held = np.repeat(np.arange(len(r)), parts[r])
                yield pd.DataFrame({"block": base[r[held]] + nth, "at": [places[i] for i in held]})

    return asked.mapInPandas(want, "block long, at array<long>")


def _scored(wanted: DataFrame, asked: DataFrame, index: PivotIndex, k: int) -> DataFrame:
    """(query_id, id, cosine): the best k of each part for each query that wants it, stored.

    The queries of a pass go to all tasks; of those with a ``least``, only what reaches it is kept.
    """
    rows = asked.orderBy("at").collect()
    least = np.array([r["least"] if "least" in asked.columns else -np.inf for r in rows])
    units = np.array([r["unit"] for r in rows], dtype=np.float64)
    shared = asked.sparkSession.sparkContext.broadcast((np.array([r["at"] for r in rows]), np.array([r["query_id"] for r in rows], dtype=object), units, least))

    def score(asked: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(items):
            return pd.DataFrame({"query_id": [], "id": [], "cosine": []})
        places, names, queries, enough = shared.value
        every = np.searchsorted(places, np.concatenate(asked["at"].to_numpy()))
        own, vectors = items["id"].to_numpy(), np.stack(items["unit"].to_numpy()).T
        last, best = min(k, len(items)) - 1, []
        for start in range(0, len(every), QUERY_BLOCK):
            some = every[start : start + QUERY_BLOCK]
            cosines = queries[some] @ vectors
            near = np.round(cosines, 9)
            kth = -np.partition(-near, last, axis=1)[:, last : last + 1]
            q, i = np.nonzero(near >= np.maximum(kth, enough[some][:, None]))
            best.append(pd.DataFrame({"query_id": names[some[q]], "id": own[i], "cosine": cosines[q, i]}))
            if sum(map(len, best)) > 8 * k * len(every):
                best = _trimmed(best, k)
        return _trimmed(best, k)[0]

    query, item = (frame.schema[name].dataType.simpleString() for frame, name in ((asked, "query_id"), (index.items, "id")))
    items = index.items.join(wanted.select("block").distinct(), "block", "left_semi")
    # a number of tasks given, as their work is in the products and not in the bytes they read
    tasks = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = wanted.repartition(tasks, "block").groupBy("block").cogroup(items.repartition(tasks, "block").groupBy("block"))
    return stored(met.applyInPandas(score, f"query_id {query}, id {item}, cosine double"), "pivot-scores")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "rank", "cosine")


def search(index: PivotIndex, query_vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, id, rank, cosine) of the k nearest vectors, and (query_id, scored): how many were looked at.

    At most about PASS_QUERIES queries go over the index at a time.
    """
    asked = query_vectors.select("query_id", "vec").where("vec IS NOT NULL")
    passes = max(1, -(-asked.count() // PASS_QUERIES))

    def units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"query_id": pdf["query_id"], "unit": list(_unit(np.stack(pdf["vec"].to_numpy()).astype(np.float64)))})

    kind = asked.schema["query_id"].dataType.simpleString()
    asked = asked.mapInPandas(units, f"query_id {kind}, unit array<double>").withColumn("at", F.monotonically_increasing_id())
    asked = stored(asked, "pivot-queries")  # numbered once
    found, wanted = [], []
    for i in range(passes):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)
        first = stored(_wanted(part, index, k, True), "pivot-first")
        near = _scored(first, part, index, k)
        least = _ranked(near, k).where(F.col("rank") == k).select("query_id", F.round("cosine", 9).alias("least"))
        # a query that has met fewer than k vectors has met all
        part = stored(part.join(least, "query_id"), "pivot-least")
        more = stored(_wanted(part, index, k, False), "pivot-more")
        found += [near, _scored(more, part, index, k)]
        wanted += [first, more]
    both = reduce(DataFrame.unionByName, wanted).select("block", F.explode("at").alias("at")).join(asked.select("query_id", "at"), "at").join(index.items.groupBy("block").agg(F.count(F.lit(1)).alias("n")), "block")
    return _ranked(reduce(DataFrame.unionByName, found), k), both.groupBy("query_id").agg(F.sum("n").alias("scored"))
