import numpy as np

from sextant.operators import pivots, vector_search
from sextant.sources import tables

ITEMS = "id long, vec array<double>"
QUERIES = "query_id long, vec array<double>"


def clusters(n, seed=4):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, 8))
    return (middles[rng.integers(12, size=n)] + 0.05 * rng.normal(size=(n, 8))).tolist()


def test_same_as_scoring_all(spark, monkeypatch):
    """Ties, zero vectors, null vectors and split rings, against the search that scores every vector."""
    monkeypatch.setattr(pivots, "PART_ROWS", 20)
    vecs = clusters(500)
    rows = [(i, v) for i, v in enumerate(vecs)] + [(600 + i, vecs[i]) for i in range(60)] + [(700, [0.0] * 8), (701, [0.0] * 8), (702, None)]
    items = spark.createDataFrame(rows, ITEMS)
    asked = spark.createDataFrame([(i, vecs[i * 7]) for i in range(20)] + [(50, [0.0] * 8), (51, [-x for x in vecs[3]])], QUERIES)
    got, work = pivots.search(pivots.build(items), asked, 7)
    key = lambda r: (r.query_id, r["rank"], r.id, round(r.cosine, 8))
    assert sorted(map(key, got.collect())) == sorted(map(key, vector_search.search(items, asked, 7).collect()))
    scored = {r.query_id: r.scored for r in work.collect()}
    assert max(scored.values()) <= 562 and sum(scored[i] for i in range(20)) < 20 * 562 / 3


def test_few_and_none(spark):
    """Fewer vectors than asked for come all; no vectors give no rows."""
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.6, 0.8])], ITEMS)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], QUERIES)
    got, _ = pivots.search(pivots.build(items), asked, 10)
    assert [(r.id, r["rank"], round(r.cosine, 9)) for r in got.orderBy("rank").collect()] == [(1, 1, 1.0), (3, 2, 0.6), (2, 3, 0.0)]
    assert pivots.search(pivots.build(items.where("id > 9")), asked, 3)[0].count() == 0


def test_pairs_carry_no_vectors_and_late_scores_reach_the_kth_best(spark, monkeypatch):
    """What grows with queries times rings are numbers; of the second pass only rows that may be among the k best are stored."""
    kept = []

    def stored(df, name):
        kept.append((name, tables.stored(df, name)))
        return kept[-1][1]

    monkeypatch.setattr(pivots, "stored", stored)
    monkeypatch.setattr(pivots, "BOUNDS", 8)
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(400, 24)).tolist()
    items = spark.createDataFrame(list(enumerate(vecs)), ITEMS)
    asked = spark.createDataFrame([(i, vecs[i]) for i in range(30)], QUERIES)
    got, _ = pivots.search(pivots.build(items), asked, 5)
    key = lambda r: (r.query_id, r["rank"], r.id, round(r.cosine, 8))
    assert sorted(map(key, got.collect())) == sorted(map(key, vector_search.search(items, asked, 5).collect()))
    assert all(df.columns == ["block", "at"] for name, df in kept if name in ("pivot-first", "pivot-more"))
    least = dict(kept)["pivot-least"].select("query_id", "least")
    late = dict(kept)["pivot-scores"]
    assert late.count() and late.join(least, "query_id").where("round(cosine, 9) < least").count() == 0
