"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

Fingerprint: XXH64 (seed 42) of every word shingle; a bit is 1 if it is set in
over half of them. Equal fingerprints are merged first, so copies cost one row.

Two fingerprints of 64 bits are linked at 4 or fewer differing bits. To find all
such pairs, a fingerprint is cut into three segments (22, 21 and 21 bits), each
read as a word of the perfect (23, 12) Golay code. Decoding a segment, and each
segment one bit away, gives one to six codeword indices; segments at distance 2
or less share one of them. Of at most 4 differing bits in three segments, either

* one segment is free of errors and another has at most 2: the exact bits of the
  first and a shared index of the second make a key (any ordered pair), or
* all have errors, so two have exactly one each: a key takes one index of either,
  and the half of the first that is free of errors.

For single errors it is enough that one side spreads its indices and the other
gives its own, so each fingerprint spreads one segment at a time. Fingerprints
that share a key meet, in blocks of bounded size where there are many; every link is
verified by its distance. Within a block only a spanning forest of the links is
passed on, which keeps all connections without listing the pairs of a group.
Components are found by alternating star steps, over nodes in order of the smallest
doc_id of their fingerprint, so that a component's lowest node also names it.

Null text counts as empty: it has no words, fingerprint zero, and links like any
other. Null ids never name a component if it has another id. Rows that repeat a
doc_id with one fingerprint are one document. Only doc_id and text are read. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sextant.llm.common import bounded_batches, joined, stored

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: Lowest bit and length of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: generator polynomial of the binary Golay code,
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Shingles whose bits are counted together.
BATCH_SHINGLES = 200_000
#: Fingerprints of a key that meet as one block; more are split, and all pairs of their blocks meet.
BLOCK_FPS = 4096
#: Rounds of the component search; each at least halves the depth of a tree.
MAX_ROUNDS = 60


def shingle_hashes(raw: bytes, width: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of each run of ``width`` words; of all words if there are fewer."""
    words = raw.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[: len(words) - width]].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, stops)]


def majority(hashes: list[list[int]]) -> np.ndarray:
    """The fingerprint of each list of hashes, as signed 64-bit integers."""
    counts = np.array([len(h) for h in hashes], dtype=np.int64)
    out = np.zeros(len(hashes), dtype=np.int64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    flat = np.array([x for h in hashes for x in h], dtype="<u8")
    bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    starts = np.r_[0, np.cumsum(counts[some])[:-1]]
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    over = 2 * ones > counts[some][:, None]
    out[some] = np.packbits(over, axis=1, bitorder="little").view("<i8")[:, 0]
    return out


def fingerprint_column(text: Column, width: int = SHINGLE_WORDS) -> Column:
    """The fingerprint of a text as a long."""

    @F.pandas_udf("long")
    def fingerprint(raw: pd.Series) -> pd.Series:
        done, waiting, n = [], [], 0
        for x in raw:
            waiting.append(shingle_hashes(x or b"", width))
            n += len(waiting[-1])
            if n >= BATCH_SHINGLES:
                done.append(majority(waiting))
                waiting, n = [], 0
        return pd.Series(np.concatenate([*done, majority(waiting)]))

    return fingerprint(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp (a long) of each document, stored."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column(F.col("text"), width).alias("fp"))
    return stored(rows, "simhash-fingerprints")


def _remainders(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator polynomial."""
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= np.where(words >> bit & 1, GENERATOR << (bit - 11), 0)
    return words


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and the high 11 bits, and the error of each remainder."""
    low, high = _remainders(np.arange(1 << 12)), _remainders(np.arange(1 << 11) << 12)
    single = [0, *(1 << i for i in range(23))]
    errors = np.array(sorted({a | b | c for a in single for b in single for c in single}))
    table = np.zeros(1 << 11, dtype=np.int64)
    table[_remainders(errors)] = errors
    return low, high, table


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The number (12 bits) of the codeword nearest to each 23-bit word."""
    low, high, errors = _golay()
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def spread_indices(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of each word and of those one bit away: (row of the word, index)."""
    flips = np.concatenate([[0], 1 << np.arange(length)])
    found = np.sort(codeword_index(words[:, None] ^ flips), axis=1)
    new = np.concatenate([np.ones((len(words), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)
    rows, columns = np.nonzero(new)
    return rows, found[rows, columns]


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the fingerprint, key): links within 4 bits share a key."""
    bits = fps.view(np.uint64)
    segments = [(bits >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    own = [codeword_index(s) for s in segments]
    spread = [spread_indices(s, n) for s, (_, n) in zip(segments, SEGMENTS)]
    rows, keys, tag = [], [], 0
    for exact in range(3):
        for near in range(3):
            if near != exact:
                row, index = spread[near]
                rows.append(row)
                keys.append((np.int64(tag) << 34) | (index << 22) | segments[exact][row])
                tag += 1
    for a, b in ((0, 1), (0, 2), (1, 2)):
        n = SEGMENTS[a][1]
        for half in (segments[a] & ((1 << n // 2) - 1), segments[a] >> n // 2):
            for row, one, two in ((spread[a][0], spread[a][1], own[b][spread[a][0]]), (spread[b][0], own[a][spread[b][0]], spread[b][1])):
                rows.append(row)
                keys.append((np.int64(tag) << 35) | (one << 23) | (two << 11) | half[row])
            tag += 1
    return np.concatenate(rows), np.concatenate(keys)


def _emit_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        fps = pdf["fp"].to_numpy(np.int64)
        if len(fps):
            rows, keys = fuzzy_keys(fps)
            yield pd.DataFrame({"key": keys, "fp": fps[rows]})


def forest(fps: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links within one group of fingerprints."""
    one, two = [], []
    rest = fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count((rest ^ at).view(np.uint64)) <= bits
            if near.any():
                hits = rest[near].tolist()
                queue += rest[near].tolist()
                one += [int(at)] * len(hits)
                two += hits
                rest = rest[~near]
    return one, two


def _linker(bits: int):
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by key; a key may go on in the next batch."""
        kept_keys, kept_fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def edges(keys: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
            cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            size = np.diff(np.r_[cut, len(keys)])
            two = cut[size == 2]
            a, b = fps[two], fps[two + 1]
            near = (np.bitwise_count((a ^ b).view(np.uint64)) <= bits) & (a != b)
            us, vs = a[near].tolist(), b[near].tolist()
            for at, n in zip(cut[size > 2].tolist(), size[size > 2].tolist()):
                u, v = forest(np.unique(fps[at : at + n]), bits)
                us += u
                vs += v
            return pd.DataFrame({"u": np.array(us, np.int64), "v": np.array(vs, np.int64)}).drop_duplicates()

        for pdf in batches:
            keys = np.concatenate([kept_keys, pdf["key"].to_numpy(np.int64)])
            fps = np.concatenate([kept_fps, pdf["fp"].to_numpy(np.int64)])
            if not len(keys):
                continue
            whole = int(np.searchsorted(keys, keys[-1]))
            if whole:
                yield edges(keys[:whole], fps[:whole])
            kept_keys, kept_fps = keys[whole:], fps[whole:]
        if len(kept_keys):
            yield edges(kept_keys, kept_fps)

    return link


def links(classes: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Edges (u > v) between distinct fingerprints that connect all that are linked."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"the keys reach {MAX_BITS} differing bits")
    # a fingerprint gives some hundred keys, so the few bytes of a class are spread over all tasks first
    width = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = classes.select("fp").repartition(width, "fp").mapInPandas(_emit_keys, "key long, fp long")
    shared = keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where(F.col("n") > 1)
    small = shared.where(F.col("n") <= BLOCK_FPS).select("key", "fp").sortWithinPartitions("key")
    found = small.mapInPandas(_linker(bits), "u long, v long")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK_FPS / 2))
    own = shared.where(F.col("n") > BLOCK_FPS).select("key", "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).alias("own"))
    pairs = own.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - F.lit(1))).alias("other"))
    block = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key")
    large = pairs.select(block, "fp").repartition(width, "key").sortWithinPartitions("key")
    found = found.unionByName(large.mapInPandas(_linker(bits), "u long, v long"))
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _lowest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("u").agg(F.min("v").alias("m"))


def stars(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u > v) of any ordered type: each node u with the lowest node v.

    Large star: every neighbour above u moves to the lowest neighbour of u, or to
    u. Small star: the neighbours below u, and u, move to the lowest of them. The
    edges are written after each round; they stop changing when all are stars.
    """
    edges = stored(edges, "simhash-edges")
    seal = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _lowest(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(_lowest(large), "u")
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(moved.unionByName(_lowest(large).select("u", F.col("m").alias("v"))).distinct(), "simhash-edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == seal:
            return edges
        seal = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def components(docs: DataFrame, width: int = SHINGLE_WORDS, bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of each document.

    The component is named by the smallest doc_id that links reach.
    """
    rows = fingerprints(docs, width)
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low_id"), F.count(F.lit(1)).alias("n_rows")), "simhash-classes")
    node = F.struct(F.col("low_id").isNull().alias("unknown"), "low_id", "fp")
    side = lambda name: classes.select(F.col("fp").alias(name), node.alias(f"{name}_node"))
    met = links(classes, bits).join(side("u"), "u").join(side("v"), "v")
    edges = met.select(F.greatest("u_node", "v_node").alias("u"), F.least("u_node", "v_node").alias("v"))
    roots = stars(edges).select(F.col("u.fp").alias("fp"), F.col("v.low_id").alias("component_id"))
    of_class = classes.join(roots, "fp", "left").withColumn("component_id", F.coalesce("component_id", "low_id")).drop("low_id")
    return joined(rows, stored(of_class, "simhash-components"), "fp", "n_rows").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
