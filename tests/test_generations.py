"""Versions in any order, deletions, and tables merged from generations."""

import random
import re
from pathlib import Path

import pytest

from sextant.operators import index as index_module
from sextant.operators import lexical
from sextant.operators.index import build
from sextant.sources import files, generations
from sextant.sources.tables import shared_dir
from sextant.streaming import ingest, serve


def frame(spark, rows):
    return spark.createDataFrame([(p, c, len(c or ""), m, d) for p, c, m, d in rows], ingest.VERSION_SCHEMA)


def newest(rows):
    """What counts of versions, whatever their order."""
    import hashlib

    best = {}
    for p, c, m, d in rows:
        mark = (m, bool(d), hashlib.md5((c or "").encode()).hexdigest())
        if p not in best or mark > best[p][0]:
            best[p] = (mark, c)
    return [(p, c, mark[0], False) for p, (mark, c) in best.items() if not mark[1]]


def as_sets(index):
    return [{tuple(r) for r in df.collect()} for df in (index.postings, index.doc_freq, index.stats, index.chunks)]


def rebuilt(spark, rows):
    return as_sets(build(files.chunk_lines(files.scan(frame(spark, newest(rows)).drop("deleted")))))


BATCHES = [
    [("a.py", "one two", 10, False), ("b.py", "two three", 10, None), ("c.py", "gone", 10, False), ("x.bin", "no", 5, False)],
    [("a.py", "late", 9, False), ("b.py", None, 11, True), ("c.py", "newer", 12, False), ("c.py", "newest", 13, False)],
    [("b.py", "late after deletion", 10, False), ("c.py", None, 12, True), ("d.py", "four", 1, False), ("a.py", "one two", 10, False)],
    [("b.py", "back again", 12, False), ("d.py", None, 2, True), ("a.py", "zz tie is broken by digest", 10, False)],
]


def test_batches_by_themselves(spark, tmp_path):
    out, seen = str(tmp_path / "live"), []
    for batch in BATCHES:
        ingest.apply_batch(frame(spark, batch), out)
        seen += batch
        assert as_sets(ingest.live_index(spark, out)) == rebuilt(spark, seen)


def test_stream_keeps_state_across_runs(spark, tmp_path):
    source, out, seen = str(tmp_path / "in"), str(tmp_path / "live"), []
    for batch in BATCHES:
        frame(spark, batch).write.mode("append").parquet(source)
        ingest.start(spark, source, out, str(tmp_path / "progress")).awaitTermination()
        seen += batch
    assert as_sets(ingest.live_index(spark, out)) == rebuilt(spark, seen)


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "live")
    for i, batch in enumerate(BATCHES[:2]):
        ingest.apply_batch(frame(spark, batch), out, batch=i)
    before = as_sets(ingest.live_index(spark, out))
    ingest.apply_batch(frame(spark, [("a.py", "other", 99, False)]), out, batch=1)
    assert as_sets(ingest.live_index(spark, out)) == before
    # files of a generation that was not committed are not seen, and written over
    ingest.tables(spark, out)
    frame(spark, [("q.py", "x", 1, False)]).selectExpr("path AS file_path", "mtime", "false AS deleted", "'' AS digest").write.parquet(f"{out}/touched/gen=5")
    assert as_sets(ingest.live_index(spark, out)) == before


def size_of_plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("\n")


def test_many_changes_keep_the_plan_flat(spark, tmp_path, monkeypatch):
    """Many changes with few kept generations: plans do not grow, and the result is that of a rebuild."""
    monkeypatch.setattr(generations, "MOST_GENERATIONS", 4)
    rng, out, seen, sizes = random.Random(3), str(tmp_path / "live"), [], []
    for i in range(12):
        batch = [(f"f{rng.randrange(12)}.py", f"word{rng.randrange(9)} step{i}", i * 10 + rng.randrange(30), rng.random() < 0.2) for _ in range(3)]
        ingest.apply_batch(frame(spark, batch), out)
        seen += batch
        live = ingest.live_index(spark, out)
        sizes.append((size_of_plan(live.postings), size_of_plan(live.doc_freq)))
    assert len(set(sizes)) <= 2  # with later generations than the base, and without
    assert as_sets(ingest.live_index(spark, out)) == rebuilt(spark, seen)
    commits = ingest.tables(spark, out).now().commits
    assert len(commits) <= 5 and commits[0].gen > 1


def test_compaction_by_share_of_dead_rows(spark, tmp_path):
    out = str(tmp_path / "live")
    for i in range(4):
        ingest.apply_batch(frame(spark, [("a.py", f"v{i}", i, False), (f"{i}.py", "own", i, False)]), out)
    live = ingest.tables(spark, out)
    now = live.now()
    assert now.commits[0].gen == now.commits[0].base
    live.compacted(now, now.last + 1, {"doc_freq": ingest.document_frequency(now)})
    assert [c.dead for c in live.now().commits] == [0]
    assert as_sets(ingest.live_index(spark, out)) == rebuilt(spark, [("a.py", "v3", 3, False)] + [(f"{i}.py", "own", i, False) for i in range(4)])


@pytest.mark.parametrize("rows", [[], [("a.py", "x", 1, True)]])
def test_nothing(spark, tmp_path, rows):
    out = str(tmp_path / "live")
    ingest.apply_batch(frame(spark, rows), out)
    assert ingest.live_index(spark, out).postings.count() == 0


def test_answers_name_the_version_they_come_from(spark, tmp_path):
    """An index that changes between two batches shows in the results; a version asked for again is the same."""
    live, asked, out = (str(tmp_path / x) for x in ("live", "asked", "out"))
    for i, content in enumerate(("alpha beta", "gamma beta")):
        ingest.apply_batch(frame(spark, [("a.py", content, i, False), ("b.py", "other text", 0, False), ("c.py", "more", 0, False)]), live)
        spark.createDataFrame([(i, "alpha"), (10 + i, "beta")], serve.QUERY_SCHEMA).write.mode("append").json(asked)
        serve.start_live(spark, live, asked, out, str(tmp_path / "progress")).awaitTermination()
    got = {(r.query_id, r.version) for r in spark.read.parquet(out).collect()}
    assert got == {(0, 1), (10, 1), (11, 3)}
    assert ingest.tables(spark, live).now(1).last == 1 and ingest.tables(spark, live).now(77).last == 3
    assert {r.content for r in ingest.index_of(ingest.tables(spark, live).now(1)).chunks.collect()} == {"alpha beta", "other text", "more"}


def shared(spark):
    return {p.name for p in Path(shared_dir(spark).removeprefix("file://")).iterdir()}


def test_a_stream_leaves_its_tables_only(spark, tmp_path):
    """Neither files, chunks nor postings of a batch stay beside the generation they went to."""
    source, out, before = str(tmp_path / "in"), str(tmp_path / "live"), shared(spark)
    for batch in BATCHES[:2]:
        frame(spark, batch).write.mode("append").parquet(source)
        ingest.start(spark, source, out, str(tmp_path / "progress")).awaitTermination()
    assert shared(spark) == before
    assert {p.name for p in Path(out).iterdir()} == {"chunks", "postings", "doc_freq", "touched", "gone", "commits"}
    assert "file_path" not in spark.read.parquet(f"{out}/postings").columns


def shuffled(spark):
    """Bytes written to shuffles by now."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_a_stream_shuffles_contents_once(spark, tmp_path):
    """Late and deleted versions, and copies in two source files, leave each file once; the folder's name has a space."""
    rng, source, out = random.Random(5), str(tmp_path / "in here"), str(tmp_path / "live")
    noise = lambda: "".join(rng.choices("!#$%&()*+,/:;<=>?@[]^{|}~", k=20_000))  # noqa: E731  # no tokens, hard to compress
    first = [(f"{i}.py", noise(), 10, False) for i in range(60)]
    later = [(p, noise(), 9, False) for p, *_ in first[:20]] + [(p, None, 11, True) for p, *_ in first[20:30]] + [(p, noise(), 12, False) for p, *_ in first[30:]]
    for batch, copies in ((first, 2), (later, 1)):
        before, n_bytes = shuffled(spark), copies * sum(len(c or "") for _, c, *_ in batch)
        for _ in range(copies):
            frame(spark, batch).coalesce(1).write.mode("append").parquet(source)
        ingest.start(spark, source, out, str(tmp_path / "progress")).awaitTermination()
        assert shuffled(spark) - before < 1.5 * n_bytes
    assert as_sets(ingest.live_index(spark, out))[2:] == rebuilt(spark, first + later)[2:]


def test_live_rows_meet_a_search_where_they_lie(spark, tmp_path):
    """Neither postings nor contents of live tables are shuffled, whatever died since the base."""
    out = str(tmp_path / "live")
    for i in range(2):
        ingest.apply_batch(frame(spark, [("a.py", f"alpha v{i}", i, False), (f"{i}.py", "own alpha", i, False)]), out)
    index = ingest.live_index(spark, out)
    terms = lexical.query_terms(spark.createDataFrame([(1, "alpha own")], serve.QUERY_SCHEMA))
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(key, "-1")
    try:
        found = lexical.candidates(index, terms)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (found, index.chunks, index.postings)]
        assert not any(re.search(r"Exchange (hash|range)partitioning", plan) for plan in plans)
        assert sorted((r.chunk_id, r.inner) for r in found.collect()) == [("0.py#0", 0), ("1.py#0", 0), ("a.py#0", 0)]
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)


def test_buckets_grow_with_the_rows(spark, tmp_path, monkeypatch):
    """A small first batch does not fix the size of buckets: a compaction makes more."""
    monkeypatch.setattr(index_module, "PART_BYTES", 30)
    out, seen = str(tmp_path / "live"), []
    for i, n in enumerate((1, 40)):
        batch = [(f"{i}_{k}.py", f"word{k} and some more words", i, False) for k in range(n)]
        ingest.apply_batch(frame(spark, batch), out)
        seen += batch
    commits = ingest.tables(spark, out).now().commits
    assert [(c.gen, c.buckets) for c in commits] == [(4, 36)]
    assert as_sets(ingest.live_index(spark, out)) == rebuilt(spark, seen)
