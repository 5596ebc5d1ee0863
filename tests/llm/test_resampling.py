import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sextant.llm import resampling

DOCS = "doc_id long, text string, row long, score string, weight string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 5, "x", "y") for i, t in rows], DOCS)


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def buckets(text):
    own = words(text)
    grams = [" ".join(own[i : i + n]) for n in (1, 2, 3) for i in range(len(own) - n + 1)]
    return Counter(zlib.crc32(g.encode()) % 10_000 for g in grams)


def brute(rows, target):
    s, t = (sum((buckets(x) for x in texts), Counter()) for texts in ([r[1] for r in rows], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    out = []
    for i, text in rows:
        own = buckets(text)
        weight = sum(gain(b) * n for b, n in own.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, own.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r, (_, text) in zip(out, rows) if len(words(text)) >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return Counter(map(tuple, out))


def corpus(n=400):
    rng = random.Random(8)
    stock = ["The", "the", "cat", "Sat", "on", "mat", "12", "x1", "É", "é", "ñu", "日本", "𝄞", "a" * 63, "b" * 64, "c" * 65, "d" * 300, "e"]
    seps = [" ", "  ", "\n", "-", "\x00", "...\t", "\x7f"]
    text = lambda k: rng.choice(["", " ", "\n"]) + "".join(w + rng.choice(seps) for w in rng.choices(stock, k=k))
    rows = [(i, text(rng.choice([0, 1, 2, 3, 19, 20, 21, 60]))) for i in range(n)]
    rows += [(n + i, "hot " * 25) for i in range(n // 2)]
    return rows + [(5, rows[5][1]), (7, "other " * 30), (None, "none " * 22), (None, None), (9001, None), (9002, ""), (9003, "w" * 5000)]


TARGET = ["the cat sat on the mat", "É é 12 12 12", None, "", "hot hot hot"]


def target(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_resample_by_brute_force(spark, monkeypatch):
    rows = corpus()
    for size in (resampling.RANGE_ROWS, 3):
        monkeypatch.setattr(resampling, "RANGE_ROWS", size)
        got = resampling.resample(docs(spark, rows).repartition(5), target(spark, TARGET))
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
        assert Counter(map(tuple, got.collect())) == brute(rows, TARGET)


def test_no_target_and_no_documents(spark):
    rows = corpus(50)
    assert Counter(map(tuple, resampling.resample(docs(spark, rows), target(spark, [])).collect())) == brute(rows, [])
    assert resampling.resample(docs(spark, []), target(spark, TARGET)).count() == 0


def test_borders_below_the_drawn_go_on(spark, monkeypatch):
    """Quantiles that miss too many rows are followed by lower ones."""
    rows = spark.range(200).select(F.col("id").alias("row"), (F.col("id") % 7).alias("score"), (F.col("id") % 2 == 0).alias("able"))
    frame = type(rows)
    real = frame.approxQuantile
    first = iter([True])
    monkeypatch.setattr(frame, "approxQuantile", lambda self, c, q, e: [6.0] * len(q) if next(first, False) else real(self, c, q, e))
    got = resampling.with_rank(rows, 40, 100).collect()
    able = sorted((r.row for r in got if r.able), key=lambda i: (-(i % 7), i))
    assert {r.row: r["rank"] for r in got} == {i: able.index(i) + 1 if i in able[:40] else None for i in range(200)}


@pytest.mark.parametrize("slice_spans", [3, 4, 7, 1 << 19])
def test_long_texts_in_slices(monkeypatch, slice_spans):
    monkeypatch.setattr(resampling, "SLICE_SPANS", slice_spans)
    monkeypatch.setattr(resampling, "CHUNK_BYTES", 300)
    texts = [t or "" for _, t in corpus(60)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    seen = 0
    for out in resampling._scan(iter([batch])):
        for r, (own, counts) in zip(out.to_pylist(), resampling._unpacked(out)):
            text = texts[r["row"]]
            assert dict(zip(own.tolist(), counts.tolist())) == dict(buckets(text))
            assert (r["n_words"], r["n_features"]) == (len(words(text)), buckets(text).total())
            seen += 1
    assert seen == len(texts)


def test_crc_in_steps():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    first = rng.integers(0, 4000, 300)
    length = np.concatenate([rng.integers(0, 70, 290), rng.integers(60, 900, 10)])
    state = np.array([zlib.crc32(b"before" * (i % 3)) for i in range(300)], dtype=np.uint32)
    want = [zlib.crc32(data[a : a + n].tobytes(), int(s)) for a, n, s in zip(first, length, state)]
    assert resampling.crc_on(state, data, first, length).tolist() == want
