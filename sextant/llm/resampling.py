"""Importance resampling towards a target distribution, by hashed word n-grams.

Texts are lower-cased (A-Z) and every run of bytes that are not word bytes becomes
one space. A regular expression with overlapped matches and look-arounds then finds,
from each word on, the span of the longest n-gram that begins there; the shorter ones
end where its first words do. CRC-32 of all spans runs column by column in numpy: the
state after one word goes on to the two- and three-word grams. Counts by bucket (crc
modulo BUCKETS) are kept for each document as differences of its bucket numbers and
their counts, so texts are scanned once.

``gains`` compares the bucket counts of all documents with those of the target, as
``floor(1000 * ln((t + 1) * (S + BUCKETS) / ((s + 1) * (T + BUCKETS))))``; a document's
weight is the sum over its features, and its score the weight plus Gumbel noise from
a hash of its id, so that the highest scores are a draw without replacement. Only the
gains, BUCKETS numbers, go through the driver. The drawn are numbered within ranges
of scores whose borders are approximate quantiles (MOST_RANGES at most) and whose
rows are counted, so no task sorts all of them.

Null text has no words: weight 0, never drawn below LEAST_WORDS words. A null doc_id
is hashed as '' and comes last among ties. Repeated rows are documents of their own;
rows alike in id and score are ranked in any order. Very long texts are scanned in
slices of SLICE_SPANS spans. Without documents the result is empty, without target
texts t and T are 0. Other columns are not read.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import bounded_batches, stored

BUCKETS = 10_000
#: Percent of the documents with enough words that are drawn.
PERCENT = 5
LEAST_WORDS = 20
SEED = 42
#: Text bytes scanned at a time, and spans of a scan that are hashed at a time.
CHUNK_BYTES = 2 << 20
SLICE_SPANS = 1 << 19
#: Rows of a range of scores on average, until there are MOST_RANGES.
RANGE_ROWS = 50_000
MOST_RANGES = 1000
QUANTILE_ERROR = 0.001
#: Bytes of a word that are hashed in step with those of other words.
STEP_BYTES = 64

IS_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
SPACE, END = 0x20, 0x0A
#: From a word's first byte on, one to three words; texts end with a line feed.
GRAM = regex.compile(rb"(?<![^ \n])[^ \n]+(?: [^ \n]+)?(?: [^ \n]+)?(?![^ \n])")

_FEATURES = pa.schema([("row", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary()), ("counts", pa.binary())])


def _crc_table() -> np.ndarray:
    """The reflected CRC-32 table: each byte value shifted out bit by bit."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1).astype(np.uint32)
    return table


CRC_TABLE = _crc_table()


def collapsed(texts: list[bytes]) -> np.ndarray:
    """The texts in lower case with one space between words and a line feed behind each text."""
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    word = IS_WORD[data]
    after_word = np.concatenate([[False], word[:-1]])
    data[~word] = SPACE
    data[ends] = END
    keep = word | after_word
    keep[ends] = True
    return data[keep]


def crc_on(state: np.ndarray, data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 continued from finished values over a span of each, one byte of all spans at a time."""
    out = state ^ np.uint32(0xFFFFFFFF)
    size = np.minimum(length, STEP_BYTES + 1).astype(np.int8)
    order = np.argsort(-size, kind="stable")  # numpy sorts 8-bit numbers by counting them
    less = -size[order]
    n_long = int(np.searchsorted(less, -STEP_BYTES))  # beyond STEP_BYTES; hashed one by one
    own, at, less = out[order[n_long:]], first[order[n_long:]], less[n_long:]
    for step in range(-int(less[0]) if len(less) else 0):
        n = int(np.searchsorted(less, -step))
        own[:n] = CRC_TABLE[(own[:n] ^ data[at[:n] + step]) & 255] ^ (own[:n] >> 8)
    out[order[n_long:]] = own
    out ^= np.uint32(0xFFFFFFFF)
    for i in order[:n_long]:
        out[i] = zlib.crc32(data[first[i] : first[i] + length[i]].tobytes(), int(state[i]))
    return out


def grams(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first byte of its first word, bucket) of the features of collapsed texts, some SLICE_SPANS words at a time."""
    found = GRAM.finditer(data.tobytes(), overlapped=True)
    held: list[tuple[int, int]] = []
    while True:
        more = [m.span() for m in itertools.islice(found, SLICE_SPANS)]
        spans = held + more
        # the two words behind a gram's first say where it can end, so the last two wait
        own = len(spans) - 2 if len(more) == SLICE_SPANS else len(spans)
        if spans:
            at = np.array(spans, dtype=np.int64)
            first, last = at[:, 0], at[:, 1]
            following = np.concatenate([first[1:], np.full(3, len(data))]) - 1  # one separator stands before a word
            first, last = first[:own], last[:own]
            end, state = first, np.zeros(own, np.uint32)
            has = np.arange(own)
            for n in range(3):
                start, end = end, end.copy()
                end[has] = np.minimum(following[has + n], last[has])
                state[has] = crc_on(state[has], data, start[has], (end - start)[has])
                yield first[has], state[has] % BUCKETS
                has = has[last[has] > end[has]]
        if len(more) < SLICE_SPANS:
            return
        held = spans[own:]


def _planes(numbers: np.ndarray) -> bytes:
    """The numbers' lowest bytes, then the next: most are 0 behind the first, which compresses well."""
    return numbers.view(np.uint8).reshape(-1, numbers.dtype.itemsize).T.tobytes()


def _numbers(raw: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _chunk(rows: list[int], texts: list[bytes]) -> pa.RecordBatch:
    data = collapsed(texts)
    ends = np.flatnonzero(data == END)
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i, (first, bucket) in enumerate(grams(data)):
        text = np.searchsorted(ends, first)
        own, n = np.unique(text * BUCKETS + bucket, return_counts=True)
        keys, counts = np.concatenate([keys, own]), np.concatenate([counts, n])
        if i % 8 == 7:  # of a long text: a bucket is kept once
            keys, back = np.unique(keys, return_inverse=True)
            counts = np.bincount(back, counts).astype(np.int64)
    keys, back = np.unique(keys, return_inverse=True)
    counts = np.bincount(back, counts, len(keys)).astype(np.uint32)
    begins = (data > SPACE) & (np.concatenate([[END], data[:-1]]) <= SPACE)
    words = np.bincount(np.searchsorted(ends, np.flatnonzero(begins)), minlength=len(texts))
    border = np.searchsorted(keys, np.arange(len(texts) + 1) * BUCKETS)
    number = (keys % BUCKETS).astype(np.uint16)
    features = [int(counts[a:b].sum()) for a, b in itertools.pairwise(border)]
    buckets = [_planes(np.diff(number[a:b], prepend=np.uint16(0))) for a, b in itertools.pairwise(border)]
    found = [_planes(counts[a:b]) for a, b in itertools.pairwise(border)]
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(buckets, pa.binary()), pa.array(found, pa.binary())], schema=_FEATURES)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, texts, held = [], [], 0
    for batch in batches:
        for row, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            rows.append(row), texts.append(text.as_buffer().to_pybytes())
            held += len(texts[-1])
            if held >= CHUNK_BYTES:
                yield _chunk(rows, texts)
                rows, texts, held = [], [], 0
    if rows:
        yield _chunk(rows, texts)


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for buckets, counts in zip(batch["buckets"], batch["counts"]):
        yield np.cumsum(_numbers(buckets.as_py(), "<u2"), dtype=np.uint16), _numbers(counts.as_py(), "<u4").astype(np.int64)


def features(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(row, n_words, n_features, buckets, counts) of each document; ``row`` is its id."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_scan, "row long, n_words long, n_features long, buckets binary, counts binary")


def bucket_totals(found: DataFrame) -> DataFrame:
    """(bucket, n): features of all documents, added up within each task first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for buckets, counts in _unpacked(batch):
                sums[buckets] += counts
        has = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int64()), pa.array(sums[has])], names=["bucket", "n"])

    return found.select("buckets", "counts").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) of every bucket, from the ``bucket_totals`` of all documents and of the target."""
    s, t = raw.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    rows = raw.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    sums = rows.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    plus = lambda name, n: (F.col(name) + F.lit(n)).cast("double")
    ratio = plus("t", 1) * plus("all_s", BUCKETS) / (plus("s", 1) * plus("all_t", BUCKETS))
    return rows.crossJoin(F.broadcast(sums)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))  # sums has one row


def weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(row, n_words, n_features, weight): the gains of a document's features added up."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int((gain[buckets] * counts).sum()) for buckets, counts in _unpacked(batch)]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["n_words"], batch["n_features"], pa.array(sums, pa.int64())], names=["row", "n_words", "n_features", "weight"])

    return found.mapInArrow(weigh, "row long, n_words long, n_features long, weight long")


def with_rank(rows: DataFrame, n_drawn: int, n_rows: int) -> DataFrame:
    """Stored ``rows`` with their ``rank`` where they are among the ``n_drawn`` of highest score that are ``able``.

    ``n_rows`` of them are able. Scores at or above the lowest border are dealt to ranges and numbered there.
    """
    none = F.lit(None).cast("long").alias("rank")
    if not n_drawn:
        return rows.select("*", none)
    able = rows.where("able")
    n = min(max(1, -(-n_drawn // RANGE_ROWS)), MOST_RANGES)
    share = n_drawn / n_rows
    borders = sorted(set(able.approxQuantile("score", [1 - share * (i + 1) / n for i in range(n)], QUANTILE_ERROR)), reverse=True)
    while able.where(F.col("score") >= borders[-1]).count() < n_drawn:  # quantiles are approximate
        share = min(1.0, 2 * share + QUANTILE_ERROR)
        borders.append(able.approxQuantile("score", [1 - share], 0.0 if share == 1.0 else QUANTILE_ERROR)[0])
    borders = [int(b) for b in borders]
    high = F.col("able") & (F.col("score") >= borders[-1])
    place = F.size(F.filter(F.array(*map(F.lit, borders)), lambda b: b > F.col("score"))).alias("_range")
    top = rows.where(high).select("*", place)
    counts = dict(top.groupBy("_range").count().collect())  # a row of each range
    before = list(itertools.accumulate((counts.get(i, 0) for i in range(len(borders))), initial=0))
    order = Window.partitionBy("_range").orderBy(F.desc("score"), F.asc_nulls_last("row"))
    rank = F.array(*(F.lit(x).cast("long") for x in before))[F.col("_range")] + F.row_number().over(order)
    top = top.withColumn("rank", F.when(rank <= n_drawn, rank)).drop("_range")
    return top.unionByName(rows.where(~high).select("*", none))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each document: drawn ones have a rank from 1."""
    found = stored(features(docs), "resample-features", compression="zstd")
    gain = np.zeros(BUCKETS, np.int64)
    for r in gains(bucket_totals(found), bucket_totals(features(target.withColumn("doc_id", F.lit(0))))).collect():  # BUCKETS rows
        gain[r["bucket"]] = r["gain"]
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((hashed + F.lit(0.5)) / F.lit(4294967296.0))))
    rows = stored(weighted(found, gain).select("row", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("able")), "resample-scores")
    n_rows = rows.where("able").count()
    return with_rank(rows, percent * n_rows // 100, n_rows).select(F.col("row").alias("doc_id"), "n_features", "weight", "score", "rank")
