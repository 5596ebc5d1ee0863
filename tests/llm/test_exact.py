import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import common, exact_dedup, mixing, near_dedup, sharding, warc

DOCS = "doc_id long, text string, source string, digest string, bucket string"
PAGES = "page_id long, url string, html string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], DOCS)


def mixed(seed=1, n=300):
    rng = random.Random(seed)
    texts = ["", None, " \t\n", "a b", "ab", "a\x0bb ", "a b", "é" * 3000, "word " * 2000] + [f"text {i} {'x' * (i % 7)}" for i in range(60)]
    rows = [(i, rng.choice(texts), rng.choice(["s1", "s2", None])) for i in range(n)]
    return rows + [(n, "hot text", "s1") for n in range(n, n + n // 2)] + [(5, rows[5][1], "s1"), (None, "ab", "s2")]


def squeezed(text):
    return "".join(c for c in text or "" if c not in " \t\n\v\f\r")


def test_dedup_by_brute_force(spark):
    rows = mixed()
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(squeezed(t), []).append((-len(t or ""), i is None, i))
    got = exact_dedup.dedup(docs(spark, rows)).collect()
    want = Counter()
    for i, t, _ in rows:
        g = groups[squeezed(t)]
        low = min(g, key=lambda x: (x[0], x[1], x[2] or 0))
        want[i, low[2], len(g), i == low[2] and -len(t or "") == low[0], hashlib.sha256(squeezed(t).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert {r.in_history for r in got} == {True, False}


@pytest.mark.parametrize("past", [True, False, None])
def test_all_or_nothing_in_history(spark, past):
    got = exact_dedup.dedup(docs(spark, [(1, "a", "s"), (2, "a ", "s"), (3, None, "s")]), F.lit(past).cast("boolean")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got] == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]


@pytest.mark.parametrize("past", [None, True, False])
def test_large_ids_beside_none(spark, past):
    """Ids that a double cannot hold, in one bucket with rows without an id: every group keeps a document."""
    low, high = -(2**63), 2**63 - 1
    ids = [high, high - 2, low, low + 1, 2**53 + 1, 2**53 + 3]
    rows = [(i, f"text {k // 2}", "s") for k, i in enumerate(ids)] + [(None, "bbb", "s"), (None, "ddd", "s"), (None, "text 0", "s"), (high - 4, "ddd", "s")]
    df = docs(spark, rows)
    want = {"text 0": high - 2, "text 1": low, "text 2": 2**53 + 1, "bbb": None, "ddd": high - 4}
    in_history = None if past is None else F.lit(past)
    got = exact_dedup.dedup(df, in_history, "text").collect()
    assert all(r.keep_id == want[r.text] and r.kept == (r.doc_id == want[r.text]) for r in got) and len(got) == len(rows)
    assert {(r.doc_id, r.text) for r in exact_dedup.keep_first(df).collect()} == {(i, t) for t, i in want.items()}


def test_dedup_of_nothing(spark):
    assert exact_dedup.dedup(docs(spark, [])).count() == 0


def test_keep_first_keeps_columns(spark):
    df = docs(spark, [(1, "a", "s"), (2, "a", "s"), (3, None, None)])
    out = exact_dedup.keep_first(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {1, 3}
    for name in ("_exact_row", "text_sha256", "kept", "past", "n_points"):
        df = df.withColumn(name, F.lit(name))
    out = exact_dedup.keep_first(df.unionByName(df))
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} == {(i, t, s, "x", "y", *df.columns[5:]) for i, t, s in [(1, "a", "s"), (3, None, None)]}
    assert out.count() == 2


def test_keep_first_leaves_one_row_of_each_text(spark):
    """A batch ingested twice, an id with several texts, and rows without an id."""
    twice = [(1, "a", "s"), (2, "b b", "t"), (3, None, None)] * 2
    several = [(5, "long  text", "s"), (5, "other", "s"), (4, "o ther", "s")]
    unknown = [(None, "x  x", "s"), (None, "x x", "s"), (None, "y", "s"), (None, "y", "s"), (9, "y", "s")]
    got = exact_dedup.keep_first(docs(spark, twice + several + unknown)).collect()
    want = [(1, "a"), (2, "b b"), (3, None), (5, "long  text"), (4, "o ther"), (None, "x  x"), (9, "y")]
    assert Counter((r.doc_id, r.text) for r in got) == Counter(want)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 3000])
def test_hash_is_minimal_and_perfect(n):
    words = np.random.default_rng(n).integers(0, 2**63, (n, 4)).astype(np.uint64)
    sizes, bits = exact_dedup.build_hash(words)
    assert sorted(exact_dedup.slots_of(words, sizes, bits)) == list(range(n))


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 24, 700])
def test_jump_hash(spark, n):
    keys = spark.range(400).select(F.xxhash64("id").alias("k"))
    for r in keys.select("k", sharding.jump_hash(F.col("k"), n).alias("j")).collect():
        assert (r.j.shard, r.j.grown) == (jump(r.k % 2**64, n), jump(r.k % 2**64, n + 1))


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUP_ROWS", 5)
    rows = mixed()
    got = sharding.shard(docs(spark, rows), 24).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    texts = {i: t or "" for i, t, _ in rows}
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key") and r.grown_shard in (r.shard, 24)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard(docs(spark, []), 24).count() == 0


def test_written_shards(spark, tmp_path):
    sharding.write_shards(docs(spark, mixed()), 4, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(mixed())
    assert back.select((F.col("shard") == sharding.jump_hash(sharding.stable_key(), 4)["shard"]).alias("ok")).where("NOT ok").count() == 0


def test_warc_round_trip(spark):
    big, other = "é" * 600, "z" * 1000
    rows = [(1, "u1", big), (9, "u9", big), (4, None, big), (2, "u", other), (3, "v", "small"), (5, "w", "small"), (6, "a\r\nb", None), (7, "", ""), (8, "x", "WARC/1.1\r\nWARC-Type: revisit\r\n" * 50)]
    headers, payloads = warc.write_archive(spark.createDataFrame(rows, PAGES).withColumn("sha256", F.lit(1)))
    got = {r.page_id: r[1:] for r in warc.archive_report(headers, payloads).collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "")]
        revisit = len(raw) >= 1000 and i < max(same)
        assert got[i] == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None)
    assert payloads.count() == len({h or "" for _, _, h in rows})
    for r in warc.read_archive(headers, payloads).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert rest.endswith(b"\r\n\r\n") and f"Content-Length: {len(rest) - 4}".encode() in head


def test_warc_files(spark, tmp_path):
    rows = [(i, f"u{i}", ("é\r\n\r\n" * 200 if i % 3 else f"own {i}") if i else None) for i in range(40)]
    headers, payloads = warc.write_archive(spark.createDataFrame(rows, PAGES), "2024-05-01T00:00:00Z")
    warc.write_warc(headers, payloads, str(tmp_path / "warc"), 7)
    got = {r.header: bytes(r.block) for r in warc.read_warc(spark, str(tmp_path / "warc")).collect()}
    want = {r.header: bytes(r.payload) if "response" in r.header else b"" for r in warc.read_archive(headers, payloads).collect()}
    assert got == want and len(got) == 40 and all("WARC-Date: 2024-05-01T00:00:00Z\r\n" in h for h in got)
    assert sum("revisit" in h for h in got) == 25


def test_warc_of_one_hot_payload(spark):
    rows = [(i, "u", "x" * 1200 if i % 2 else f"own {i}") for i in range(900)]
    got = warc.archive_report(*warc.write_archive(spark.createDataFrame(rows, PAGES))).collect()
    assert Counter(r.record_type for r in got) == {"revisit": 449, "response": 451} and {r.refers_to for r in got} == {None, 899}


def test_warc_detects_damage(spark):
    headers, payloads = warc.write_archive(spark.createDataFrame([(1, "u", "page")], PAGES))
    with pytest.raises(Exception, match="does not match"):
        warc.archive_report(headers, payloads.withColumn("payload", F.lit("pagf").cast("binary"))).collect()
    headers, payloads = warc.write_archive(spark.createDataFrame([], PAGES))
    assert warc.archive_report(headers, payloads).count() == 0


def water_fill(sizes, weights):
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in capped]
        share = {s: (total - sum(capped.values())) * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 2 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(1.2) * 5)), rng.choice(["a", "b", "c", "d", "d", "d", None])) for i in range(900)] + [(900, None, "a"), (901, "", "e"), (902, " \n", None)]
    got = mixing.mix(docs(spark, rows)).collect()
    by_id = {i: (s, len((t or "").split())) for i, t, s in rows}
    sizes, taken = Counter(), Counter()
    for s, n in by_id.values():
        sizes[s] += n
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    want = water_fill(dict(sizes), weights)
    for r in got:
        s, n = by_id[r.doc_id]
        taken[s] += r.taken
        assert r.size == n and r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * n
    for s, t in want.items():
        assert taken[s] == pytest.approx(t, rel=0.02, abs=3)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs(spark, rows).repartition(7)).collect()))
    assert mixing.mix(docs(spark, [])).count() == 0


def test_many_bins_take_the_same_share(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BIN_ROWS", 10)
    rows = [(i, "w " * (i % 50), "ab"[i % 2]) for i in range(600)]
    got = mixing.mix(docs(spark, rows)).collect()
    for source in (0, 1):
        mine = [r for r in got if r.doc_id % 2 == source]
        assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, rel=0.01)


@pytest.mark.parametrize("seed", ["mix", "other"])
def test_inclusion_follows_size(spark, monkeypatch, seed):
    """Of a source that gets 5/3 of its words, the few long documents are certain a second time, the others by their words."""
    monkeypatch.setattr(mixing, "SEED", seed)
    n = 4000
    rows = [(i, "w " * (100 if i % 50 == 0 else 10 if i % 2 == 0 else 5), "abc"[i // n]) for i in range(3 * n)]
    got = [r for r in mixing.mix(docs(spark, rows)).collect() if r.doc_id >= 2 * n]
    again = {size: np.mean([r.taken // r.size - 1 for r in got if r.size == size]) for size in (5, 10, 100)}
    scale = (930 * 2 / 3 - 200) / (50 * 5**2 + 48 * 10**2)
    assert again[100] == 1 and again[5] == pytest.approx(5 * scale, abs=0.04) and again[10] == pytest.approx(10 * scale, abs=0.04)


def test_a_document_larger_than_a_bin(spark, monkeypatch):
    """The gap that a passed-over document leaves is filled from all bins behind it."""
    monkeypatch.setattr(mixing, "BIN_ROWS", 5)
    rows = [(i, "w " * (3000 if i % 40 == 0 else 3), "ab"[i % 2]) for i in range(800)]
    got = mixing.mix(docs(spark, rows)).collect()
    for source in (0, 1):
        mine = [r for r in got if r.doc_id % 2 == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 3000 and sum(r.taken for r in mine) <= mine[0].target


def test_repeat(spark):
    rows = [(i, "w " * (i % 20), "abc"[i % 3]) for i in range(300)]
    df = docs(spark, rows)
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(df).collect() if r.taken}
    assert Counter(r.doc_id for r in mixing.repeat(df, "copy").collect()) == Counter(taken)


def test_repeat_of_equal_rows_and_clashing_names(spark):
    rows = [(i % 7 if i % 3 else None, "w " * (i % 5), "abc"[i % 3]) for i in range(300)] + [(None, None, None)]
    df = docs(spark, rows)
    for name in ("_mix_row", "_mix_copies", "_words", "_id", "size", "row", "u", "gap", "copies"):
        df = df.withColumn(name, F.lit(name))
    out = mixing.repeat(df, "copy")
    assert out.columns == [*df.columns, "copy"] and all(r["_words"] == "_words" and r.gap == "gap" for r in out.collect())
    assert out.count() == sum(r.taken // r.size for r in mixing.mix(df).collect() if r.size)
    with pytest.raises(ValueError):
        mixing.repeat(df, "U")


def test_rows_of_files_have_locators(spark, tmp_path):
    """Locators of file rows are unique and stay; rows that have none are stored instead."""
    path = str(tmp_path / "rows.parquet")
    df = docs(spark, [(i % 40 if i % 9 else None, f"text {i % 50}", "s") for i in range(300)])
    df.repartition(7).write.parquet(path)
    files = spark.read.parquet(path)
    at = lambda: {(r.row, r.text) for r in common.located(files, "row").collect()}
    first = at()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    assert at() == first and len({row for row, _ in first}) == 300 and min(first)[0] >= 0
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert common.located(df, "row") is None
    assert common.located(files.withColumn("_metadata", F.lit("own")), "row") is None
    empty = spark.read.schema(files.schema).parquet(path).where("doc_id > 1000")
    assert common.located(empty, "row").count() == 0
    for keep in (exact_dedup.keep_first, near_dedup.keep_first):
        kept = [sorted(map(str, keep(x, from_files=True).collect())) for x in (files, df)]
        assert kept[0] and kept[0] == kept[1]
        assert keep(empty, from_files=True).count() == 0
    m1, m2 = (Counter(r.doc_id for r in mixing.repeat(x, "copy", from_files=True).collect()) for x in (files, df))
    assert sum(m1.values()) == sum(m2.values()) > 0
