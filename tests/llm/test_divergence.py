import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sextant.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, n long, term string"


def docs(spark, rows):
    return spark.createDataFrame([(i, *r, 7, "x") for i, r in enumerate(rows)], DOCS)


def terms(text):
    found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in found]


def brute(rows, min_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        seen = Counter(t for r in rows if r[1] == lang for t in set(terms(r[0])))
        kept = sorted(t for t, n in seen.items() if n >= min_docs)
        counts = defaultdict(Counter)
        for text, l, source in rows:
            if l == lang:
                counts[source].update(t for t in terms(text) if t in set(kept))
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        q = share(whole)
        p = {s: share(c) for s, c in counts.items()}
        for s in p:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in p if o != s]
            own = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(own)[:top])):
                out |= {(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)}
    return out


def corpus(seed=3, n=240):
    rng = random.Random(seed)
    stock = ["a", "Ab", "eight8ch", "eightchr", "eightchrs", "sixteen-chars", "abcdefghijklmnop", "abcdefghijklmnopq", "é" * 8, "É", "ñandú", "x" * 33, "x" * 32, "y" * 70, "日本語", "𝄞", "zz\x7fzz", "q_q", "\x00nul\x00"]
    text = lambda: rng.choice([" ", "\n", "1", ""]).join(rng.choices(stock, k=rng.randint(0, 30)))
    rows = [(text(), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "é", None])) for _ in range(n)]
    hot = [("hot words hot", "en", "s1")] * (n // 2)
    return rows + hot + [(None, "en", "s1"), ("", "fr", None), (None, "xx", "s1"), ("lone", "xx", "s2"), ("w" * 5000, "en", "s9"), ("12 34", "one", "only")]


@pytest.mark.parametrize("min_docs,top", [(30, 50), (1, 3)])
def test_audit_by_brute_force(spark, min_docs, top):
    rows = corpus()
    got = divergence.audit(docs(spark, rows), min_docs, top).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute(rows, min_docs, top)


def test_split_input_changes_nothing(spark):
    df = docs(spark, corpus())
    result = lambda x: sorted(map(tuple, divergence.audit(x, 5).collect()))
    assert result(df.repartition(7)) == result(df.coalesce(1))


def test_nothing(spark):
    assert divergence.audit(docs(spark, [])).count() == 0
    got = divergence.audit(docs(spark, [(None, None, None), (None, None, "b")])).collect()
    assert sorted(map(tuple, got)) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


def test_terms_of_joined_texts():
    texts = ["ab", "cd", "", " ef", "é", "日x ", "y"]
    raw = [t.encode() for t in texts]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])
    first, length = divergence.term_spans(data, ends)
    assert [data[a : a + n].tobytes().decode() for a, n in zip(first, length)] == ["ab", "cd", "ef", "é", "日x", "y"]


def test_radix_order():
    rng = np.random.default_rng(5)
    for high in (1, 300, 2**64 - 1):
        keys = [rng.integers(0, high, 2000, dtype=np.uint64), rng.integers(0, 9, 2000).astype(np.uint32)]
        assert (divergence.radix_order(keys) == np.lexsort(keys)).all()


def test_long_text_counts_as_one_document(monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK_BYTES", 64)
    text = ("Ab cd" * 40 + " " + "z" * 200 + " ab").encode()
    batch = pa.RecordBatch.from_pydict({"text": [text.decode(), "ab", None or ""], "lang": ["l"] * 3, "source": ["s"] * 3})
    found = defaultdict(lambda: [0, 0])
    for out in divergence._count(iter([batch])):
        for r in out.to_pylist():
            found[r["term"]][0] += r["n"]
            found[r["term"]][1] += r["docs"]
    want = Counter(terms(text.decode()))
    assert dict(found) == {t: [n + (t == "ab"), 1 + (t == "ab")] for t, n in want.items()}


def test_shares_beyond_64_bits(spark):
    rows = [(0, 0, 1), (5, 9, 4), (8_000_000_000, 9_000_000_000, 7), (10**15 + 3, 10**15 + 9, 123), (4_611_686_013, 4_611_686_014, 2), (1, 1, 0)]
    df = spark.createDataFrame(rows, "c long, n long, v long")
    got = df.select(divergence.scaled(F.col("c"), F.col("n"), F.col("v"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (c + 5) // (n + 5 * v) if v else None for c, n, v in rows]
