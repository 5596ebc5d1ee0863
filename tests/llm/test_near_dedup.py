import random

import numpy as np
import pytest

from sextant.llm import near_dedup

DOCS = "doc_id long, text string, u string, root string"


def shingles(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute(rows):
    """The places of the rows that stay."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                parent[find(i)] = find(j)
    best = {}
    for i, (doc, _) in enumerate(rows):
        best.setdefault(find(i), []).append((doc is None, doc or 0, i))
    return sorted(min(g)[2] for g in best.values())


def corpus(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(80):
        base = rng.choices(words, k=rng.randint(3, 150))
        rows.append((rng.randint(1, 10**6), " ".join(base)))
        for _ in range(rng.choice([0, 1, 3])):
            copy = list(base)
            for _ in range(rng.randint(1, 1 + len(base) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((rng.randint(1, 10**6), " ".join(copy).upper()))
    family = rng.choices(words, k=100)
    for i in range(60):  # alike among themselves only in part
        copy = list(family)
        for _ in range(i % 5):
            copy[rng.randrange(100)] = rng.choice(words)
        rows.append((2 * 10**6 + i, " ".join(copy)))
    text = " ".join(rng.choices(words, k=30))
    rows += [(7, text), (7, text), (None, text), (None, rows[0][1]), (None, "alone " * 9), (None, "by itself"), (8, ""), (9, None)]
    return rows


@pytest.mark.parametrize("block_rows", [4, 1000])
def test_keep_first_by_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block_rows)
    rows = corpus()
    df = spark.createDataFrame([(i, t, str(k), "r") for k, (i, t) in enumerate(rows)], DOCS).coalesce(1)
    out = near_dedup.keep_first(df)
    assert out.columns == df.columns
    assert sorted(int(r.u) for r in out.collect()) == brute(rows)


def test_nothing(spark):
    assert near_dedup.keep_first(spark.createDataFrame([], DOCS)).count() == 0


def test_bands_reach_pairs_at_the_least_similarity():
    rng = np.random.default_rng(0)
    missed = 0
    for _ in range(2000):
        x = rng.integers(-(2**63), 2**63, 100)
        a, b = np.unique(x[:90]), np.unique(x[10:])  # 80 of 100 in common
        missed += not (near_dedup.bands(a) == near_dedup.bands(b)).any()
    assert missed <= 2
