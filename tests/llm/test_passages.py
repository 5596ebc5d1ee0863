import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sextant.llm import passages

DOCS = "doc_id long, text string, sha string, lo long, spans string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS)


def brute(rows, n):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + n] for r in raw for i in range(len(r) - n + 1))
    out = Counter()
    for (doc, _), r in zip(rows, raw):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                gone[i : i + n] = True
        starts = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out[doc, len(r), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()] += 1
    return out


def corpus(n, seed=1, letters="abcdé "):
    """Texts with passages of about ``n`` bytes in common, near copies, copies, and texts that repeat themselves."""
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choices(letters, k=k))
    shared = [text(k) for k in (n // 2, n - 8, n - 1, n, n + 1, 2 * n, 5 * n)]
    long = text(8 * n)
    rows = [text(rng.randint(0, 2 * n)) + rng.choice(shared) + text(rng.randint(0, 2 * n)) for _ in range(50)]
    for _ in range(12):  # near copies: one letter in some hundred differs
        x = list(long)
        for _ in range(rng.randint(1, 5)):
            x[rng.randrange(len(x))] = "#"
        rows.append("".join(x))
    rows += [long, long, text(30), "", None, None, "é" * n, "a" * (3 * n), "a" * (n - 1), "ab" * n, ("xyz" * n)[: 2 * n], shared[4] * 3, text(40) + "a" * (2 * n) + text(40)]
    block = text(n // 3)
    rows += [block * 9, text(5) + block * 4, shared[5][3:] + shared[5][:-3]]
    return list(enumerate(rows)) + [(3, rows[3]), (None, "none " + shared[6]), (None, None)]


@pytest.mark.parametrize("n,seed", [(400, 1), (16, 2), (20, 3), (9, 4)])
def test_report_by_brute_force(spark, n, seed):
    rows = corpus(n, seed)
    got = passages.report(docs(spark, rows).repartition(3), n)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert Counter(map(tuple, got.collect())) == brute(rows, n)


@pytest.mark.parametrize("size", [2, 3, 20])
def test_hot_groups_are_dealt(spark, monkeypatch, size):
    """Small parts: groups go through all hashes, and what is left meets by digests."""
    monkeypatch.setattr(passages, "GROUP_PIECES", size)
    rows = corpus(32, 7) + [(1000 + i, f"{i:07d}" + "common words that stand in a great many texts, " + f"{i * 7:09d}") for i in range(60)]
    assert Counter(map(tuple, passages.report(docs(spark, rows), 32).collect())) == brute(rows, 32)


def test_spans_and_nothing(spark):
    assert passages.report(docs(spark, [])).count() == 0
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in passages.spans(docs(spark, [(1, "x" + "abcdefgh" * 2), (2, "yabcdefghabcdefgh"), (3, None)]), 16).collect()}
    assert got == {1: [(1, 17)], 2: [(1, 17)], 3: []}


def test_anchors_do_not_depend_on_the_place():
    rng = np.random.default_rng(3)
    common = rng.integers(97, 100, 3000, dtype=np.uint8)
    for n, gram in ((400, 96), (16, 8), (9, 4)):
        where = {}
        for before in (0, 1, 777):
            data = np.concatenate([rng.integers(97, 100, before, dtype=np.uint8), common])
            lo, hi, _, hashes = passages.anchored(data, np.array([len(data)]), n, gram)
            covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi)])
            assert (covered == np.arange(len(data) - n + 1)).all()
            of = np.repeat(hashes, hi - lo + 1)[before:]
            where[before] = of
        assert (where[0] == where[1]).all() and (where[0] == where[777]).all()


def test_long_texts_in_slices(monkeypatch):
    monkeypatch.setattr(passages, "SLICE_BYTES", 100)
    raw = ("abc" * 200 + "defgh" * 50 + "x" * 130).encode()
    anchors, own = passages._scan_long(raw, 16, 8)
    starts = sorted(i for a, b, _, _ in anchors for i in range(a, b + 1))
    assert len(starts) == len(set(starts))
    gone = {i for a, b in own for i in range(a, b)}
    assert set(range(len(raw) - 15)) - set(starts) <= gone  # what is not in a piece is known to recur
    assert max(starts, default=0) <= len(raw) - 16


@pytest.mark.parametrize("step", [1, 2, 3, 5, 8, 11, 16, 50])
def test_transform_orders_suffixes(tmp_path, step):
    rng = np.random.default_rng(step)
    pieces = [bytes(rng.integers(97, 99, n, dtype=np.uint8)) for n in (40, 1, 33, 64, 40, 17)] + [b"a" * 50, b"a" * 50]
    data = np.frombuffer(b"".join(pieces), np.uint8)
    length = np.array([len(p) for p in pieces])
    base = np.cumsum(length) - length
    count = length // step
    start, common = passages.transform(passages.symbols(data, step), base, count, step, 255, passages._Files(str(tmp_path), len(pieces) + int(count.sum())))
    units = [[] for _ in pieces]  # the empty suffixes come first
    for s in np.array(start)[len(pieces) :]:
        i = int(np.searchsorted(base, s, side="right")) - 1
        units.append([data[k : k + step].tobytes() for k in range(s, base[i] + step * count[i], step)])
    assert units == sorted(units) and len(units) == int(count.sum()) + len(pieces)
    for a, b, n in zip(units, units[1:], np.array(common)[1:]):
        same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert n == same


def test_most_alike():
    rng = np.random.default_rng(4)
    strings = [bytes(rng.integers(97, 99, rng.integers(0, 12), dtype=np.uint8)) for _ in range(60)]
    same = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert passages._most_alike(strings) == [max(same(a, b) for j, b in enumerate(strings) if j != i) for i, a in enumerate(strings)]
    assert passages._most_alike([b"x"]) == [0] and passages._most_alike([]) == []


def test_least_of_ranges():
    rng = np.random.default_rng(1)
    numbers = rng.integers(0, 200, 5000).astype(np.uint8)
    first = rng.integers(0, 5000, 800)
    last = np.minimum(first + rng.choice([0, 1, 10, 70, 300, 4000], 800), 4999)
    assert passages._Least(numbers)(first, last).tolist() == [numbers[a : b + 1].min() for a, b in zip(first, last)]
