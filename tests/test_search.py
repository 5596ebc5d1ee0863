import pytest
from pyspark.sql import functions as F

from sextant.config import SearchConfig
from sextant.operators import evaluate, explain, fusion, lexical, state, vector_search
from sextant.operators.index import Index, build
from sextant.sources import commits, files
from sextant.streaming import ingest, serve

FILES = [
    ("src/auth.rs", "fn login user token\nuser user", 30, 1),
    ("src/db.rs", "struct Pool connection token", 28, 2),
    ("docs/readme.txt", "login page for the user login token", 35, 3),
]


def frame(spark, rows=FILES):
    return spark.createDataFrame(rows, ingest.FILE_SCHEMA)


@pytest.fixture(scope="module")
def index(spark):
    return build(files.chunk_lines(files.scan(frame(spark))))


def found(index, spark, *asked, **config):
    queries = spark.createDataFrame(list(enumerate(asked)), serve.QUERY_SCHEMA)
    rows = lexical.search(index, queries, SearchConfig(**config)).orderBy("query_id", "rank").collect()
    return [(r.query_id, r.file_path, round(r.raw, 6), round(r.score, 6)) for r in rows]


def test_scores(spark, index):
    assert found(index, spark, "user token", "fn login", "struct Pool", "  ") == [
        (0, "src/auth.rs", 42.435655, 1.0),
        (0, "docs/readme.txt", 3.345218, 0.07883),
        (0, "src/db.rs", 1.8, 0.042417),
        (1, "src/auth.rs", 52.349604, 1.0),
        (1, "docs/readme.txt", 4.635655, 0.088552),
        (2, "src/db.rs", 53.079442, 1.0),
    ]


def test_candidate_cap(spark, index):
    assert len(found(index, spark, "token", candidate_cap=1)) == 1
    assert len(found(index, spark, "token", candidate_cap=None)) == 3


def test_index_on_disk(spark, index, tmp_path):
    index.write(str(tmp_path / "index"))
    again = Index.read(spark, str(tmp_path / "index"))
    assert found(again, spark, "user token") == found(index, spark, "user token")


@pytest.mark.parametrize("lines,windows", [(1, [(1, 1)]), (60, [(1, 60)]), (61, [(1, 60), (46, 61)]), (105, [(1, 60), (46, 105)]), (106, [(1, 60), (46, 105), (91, 106)])])
def test_windows(spark, lines, windows):
    rows = files.chunk_lines(frame(spark, [("a.py", "\n".join(["x"] * lines), 1, 1)])).orderBy("chunk_index").collect()
    assert [(r.line_start, r.line_end) for r in rows] == windows


def test_blank_windows_take_no_index(spark):
    content = "\n".join([""] * 61 + ["x"] * 60)
    rows = files.chunk_lines(frame(spark, [("a.py", content, 1, 1), ("b.py", "", 0, 1)])).orderBy("file_path", "chunk_index").collect()
    assert [(r.file_path, r.chunk_index, r.line_start) for r in rows] == [("a.py", 0, 46), ("a.py", 1, 91), ("b.py", 0, 1)]


def test_pages_keep_their_numbers(spark):
    rows = files.chunk_pages(frame(spark, [("a.pdf", " one \f \fthree", 1, 1)])).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.content, r.line_start) for r in rows] == [(0, "one", 1), (2, "three", 3)]


def test_ignore_patterns(spark):
    ignore = spark.createDataFrame([("# c\n\nout/gen/*\n!no\nskip.py\nlib/\n",)], "text string")
    patterns = files.parse_ignore(ignore)
    assert {"out/gen", "skip.py", "lib", "Cargo.lock"} <= {r[0] for r in patterns.collect()}
    tree = [(p, "", 0, 0) for p in ("a/out/gen/x.py", "skip.py", "lib/x.py", "libs/x.py", "build/x.py", "a/build.py")]
    assert {r[0] for r in files.not_ignored(frame(spark, tree), patterns).select("path").collect()} == {"libs/x.py", "a/build.py"}


def test_tree_and_size_limit(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1")
    (tmp_path / "src/bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "src/big.py").write_text("y" * 100)
    rows = files.scan(files.read_tree(spark, str(tmp_path)), SearchConfig(max_file_bytes=50)).collect()
    assert [(r.path, r.content) for r in rows] == [("src/a.py", "x = 1")]


def ranked(spark, ids, query_id=1):
    return spark.createDataFrame([(query_id, x, i + 1) for i, x in enumerate(ids)], "query_id long, id string, rank int")


@pytest.mark.parametrize("weight,expected", [(1.0, {"a": (0.032266458, 1.0), "c": (0.032266458, 1.0), "b": (0.016129032, 0.49987), "d": (0.016129032, 0.49987)}), (1.5, {"a": (0.04046318, 1.0), "c": (0.040202966, 0.993569), "b": (0.024193548, 0.597915), "d": (0.016129032, 0.39861)})])
def test_rrf(spark, weight, expected):
    merged = fusion.rrf(ranked(spark, "abc"), ranked(spark, "cda"), weight)
    both = merged.withColumn("share", F.col("fused"))
    got = {r.id: (round(r.fused, 9), round(r.share, 6)) for r in fusion.normalised(both, "share").collect()}
    assert got == expected


def test_rerank_keeps_rows_without_vector(spark):
    queries = spark.createDataFrame([(1, "some words")], serve.QUERY_SCHEMA)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vec array<double>")
    vecs = spark.createDataFrame([("a", [0.0, 1.0]), ("c", [1.0, 0.0])], "id string, vec array<double>")
    rows = fusion.rerank(ranked(spark, "abc"), queries, asked, vecs).orderBy("rank").collect()
    assert [(r.id, r.vector_score) for r in rows] == [("a", 0.0), ("c", 1.0), ("b", None)] and rows[0].score == 1.0


def test_metrics(spark):
    qrels = spark.createDataFrame([(1, "d2", 3.0), (1, "d4", 1.0), (1, "d9", 2.0), (1, "d3", 0.0), (2, "x", 1.0)], "query_id long, id string, rel double")
    got = {r.query_id: tuple(round(x, 6) for x in r[1:]) for r in evaluate.evaluate(ranked(spark, ["d1", "d2", "d3", "d4"]), qrels).collect()}
    assert got == {1: (0.487932, 0.5, 0.666667, 0.2), 2: (0.0, 0.0, 0.0, 0.0)}


def test_explain(spark, index):
    asked = spark.createDataFrame([(0, "user nowhere")], serve.QUERY_SCHEMA)
    tokens = {r.token: (r.doc_freq, round(r.idf, 6)) for r in explain.explain_tokens(index, asked).collect()}
    assert tokens == {"user": (2, 1.287682), "nowhere": (0, 2.386294)}
    row = explain.explain_results(index, asked).where("rank = 1").first()
    assert (row.matched, row.missing) == (["user"], ["nowhere"])


def test_vector_search_ties_and_zero(spark):
    vecs = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)] + [(99, [0.0, 0.0])], "id long, vec array<double>")
    asked = spark.createDataFrame([(7, [2.0, 0.0])], "query_id long, vec array<double>")
    rows = vector_search.search(vecs.repartition(4), asked, 5).orderBy("rank").collect()
    assert [r.id for r in rows] == [0, 1, 2, 3, 4] and all(abs(r.cosine - 1) < 1e-12 for r in rows)


def test_cache(spark):
    cache = spark.createDataFrame([("k1", [1.0, 2.0]), ("k2", [3.0, 4.0])], "key string, vec array<float>")
    live = spark.createDataFrame([("k1",), ("k1",), ("k3",)], "key string")
    assert [r.key for r in vector_search.sweep(cache, live).collect()] == ["k1"]
    assert vector_search.swept(cache, live).first()[:] == (1, 8)
    assert vector_search.swept(cache, live.limit(0)).first()[:] == (2, 16)
    texts = vector_search.keyed(spark.createDataFrame([("t",), ("t",)], "text string"), "text")
    filled = vector_search.embed_missing(texts, cache, lambda df: df.select("key", F.array(F.lit(0.5).cast("float")).alias("vec")))
    assert filled.count() == 3
    assert vector_search.missing(texts, filled).count() == 0


def test_diff(spark):
    raw = "diff --git a/src/x.rs b/src/x.rs\n+++ b/src/x.rs\n+a\n-b\ndiff --git a/node_modules/y.js b/node_modules/y.js\n+c\n"
    rows = spark.createDataFrame([("h" * 40, 2, " msg \n", raw), ("e" * 40, 1, "", "")], "hash string, seq long, message string, raw_diff string")
    kept = commits.recent(rows, 200)
    assert [(r.message, r.diff_text) for r in kept.collect()] == [("msg", raw[: raw.index("diff --git a/node")])]
    assert commits.described(kept).first()[:] == ("h" * 40, "h" * 12, "msg", 1, 1, 1)
    long = "diff --git a/x.py b/x.py\n" + "+é\n" * 3000
    cut = spark.createDataFrame([(long,)], "d string").select(commits.filter_diff(F.col("d"))).first()[0]
    assert len(cut.encode()) in (4096, 4097) and cut.endswith("\n")


def as_sets(index):
    return [{tuple(r) for r in df.collect()} for df in (index.postings, index.doc_freq, index.stats)]


def test_sync_equals_rebuild(spark, index):
    now = [*FILES[:1], ("src/db.rs", "struct Pool changed", 20, 9), ("new.py", "def fresh", 9, 4)]
    synced, changes = state.sync(index, state.snapshot(frame(spark)), frame(spark, now))
    assert {r.file_path: r.state for r in changes.collect()} == {"src/auth.rs": "unchanged", "src/db.rs": "changed", "docs/readme.txt": "removed", "new.py": "added"}
    assert as_sets(synced) == as_sets(build(files.chunk_lines(frame(spark, now))))


def test_streams(spark, index, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "live")
    frame(spark).write.parquet(source)
    ingest.start(spark, source, out, str(tmp_path / "c1")).awaitTermination()
    assert as_sets(ingest.live_index(spark, out)) == as_sets(index)
    changed = ("src/db.rs", "struct Pool changed", 20, 9)
    frame(spark, [changed]).write.mode("append").parquet(source)
    ingest.start(spark, source, out, str(tmp_path / "c1")).awaitTermination()
    live = ingest.live_index(spark, out)
    assert as_sets(live) == as_sets(build(files.chunk_lines(frame(spark, [FILES[0], changed, FILES[2]]))))

    asked = spark.createDataFrame([(1, "user token")], serve.QUERY_SCHEMA)
    asked.write.json(str(tmp_path / "asked"))
    serve.start(spark, live, str(tmp_path / "asked"), str(tmp_path / "answers"), str(tmp_path / "c2")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "answers")).orderBy("rank").collect()
    direct = lexical.search(live, asked).orderBy("rank").collect()
    assert [(r.file_path, r.raw) for r in rows] == [(r.file_path, r.raw) for r in direct] and rows


def test_vector_passes_and_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "PASS_QUERIES", 3)
    vecs = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "id long, vec array<double>")
    asked = vecs.where("id < 10").withColumnRenamed("id", "query_id")
    top = {(r.query_id, r["rank"]): r.id for r in vector_search.search(vecs.repartition(3), asked, 4).collect()}
    pairs = vector_search.search(vecs, asked, None).collect()
    assert len(pairs) == 600
    for q in range(10):
        best = sorted((-round(r.cosine, 9), r.id) for r in pairs if r.query_id == q)[:4]
        assert [top[q, i + 1] for i in range(4)] == [i for _, i in best]


def test_cache_on_disk_and_upsert(spark, tmp_path):
    row = "key string, vec array<float>"
    one = spark.createDataFrame([("ab", [1.0]), ("ac", [2.0]), ("b0", [3.0])], row)
    two = spark.createDataFrame([("ab", [9.0]), ("ab", [9.0]), ("ff", [4.0])], row)
    want = {("ab", 9.0), ("ac", 2.0), ("b0", 3.0), ("ff", 4.0)}
    assert {(r.key, r.vec[0]) for r in vector_search.upsert(one, two).collect()} == want
    for new in (one, two, two):
        vector_search.write_cache(new, str(tmp_path / "cache"))
    assert sorted((r.key, r.vec[0]) for r in vector_search.read_cache(spark, str(tmp_path / "cache")).collect()) == sorted(want)


def test_sync_tree_drops_what_the_scan_drops(spark, index):
    now = [*FILES[:2], ("node_modules/x.js", "var dropped", 11, 4), ("big.py", "x", 10**9, 4)]
    cache = vector_search.keyed(spark.createDataFrame([("search_document: " + c,) for _, c, _, _ in FILES], "text string"), "text")
    synced, changes, swept = state.sync_tree(index, state.snapshot(frame(spark)), frame(spark, now), cache)
    assert {r.file_path: r.state for r in changes.collect()} == {"src/auth.rs": "unchanged", "src/db.rs": "unchanged", "docs/readme.txt": "removed"}
    assert as_sets(state.compacted(synced)) == as_sets(build(files.chunk_lines(frame(spark, FILES[:2])))) and swept.count() == 2


def test_deleted_rows_leave_no_partition(spark, tmp_path):
    """A file that the scan drops in a later batch takes its old rows with it."""
    out = str(tmp_path / "live")
    ingest.apply_batch(frame(spark), out)
    ingest.apply_batch(frame(spark, [("docs/readme.txt", "x", 10**9, 9)]), out)
    assert as_sets(ingest.live_index(spark, out)) == as_sets(build(files.chunk_lines(frame(spark, FILES[:2]))))


def test_tree_skips_ignored_and_unknown_files(spark, tmp_path):
    for name, content in (("a/x.py", b"x"), ("node_modules/y.py", b"y"), ("a/z.bin", b"\x00"), ("a/bad.rs", b"\xff")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    assert [(r.path, r.content) for r in files.read_tree(spark, str(tmp_path)).collect()] == [("a/x.py", "x")]
    (tmp_path / "none").mkdir()
    (tmp_path / "none/q.bin").write_bytes(b"1")
    assert files.read_tree(spark, str(tmp_path / "none")).count() == 0


def test_report_previews_and_stored_tables(spark, index):
    from sextant.plans import report
    from sextant.sources import tables

    log = spark.createDataFrame([("h" * 40, 1, "login fix\nmore", "diff --git a/x.py b/x.py\n+login\n")], "hash string, seq long, message string, raw_diff string")
    asked = spark.createDataFrame([(0, "login user")], serve.QUERY_SCHEMA)
    rows = report.search_report(index, log, asked, files.total_lines(frame(spark))).collect()
    assert {r.section for r in rows} == set(report.SECTIONS)
    first = next(r for r in rows if r.section == "code_lexical" and r["rank"] == 1)
    assert (first.band, first.preview, first.total_lines, first.subject) == ("strong", "fn login user token\nuser user", 2, None)
    mine = next(r for r in rows if r.section == "commits_lexical")
    assert (mine.short_hash, mine.subject, mine.files, mine.plus, mine.minus) == ("h" * 12, "login fix", 1, 1, 0)
    assert len(report.server_report(index, log, asked, files.total_lines(frame(spark))).columns) == 9
    kept = list(tables._written)
    tables._written.clear()
    tables.stored(asked, "gone")
    path = tables._written[-1]
    tables.freed(spark)
    assert tables.read_or_empty(spark, path, "query_id long").count() == 0 and not tables._written
    tables._written.extend(kept)


def test_uncapped_search_shuffles_no_postings(spark, index):
    """Only rows that may lead are dealt out; postings, contents and candidates stay in their buckets."""
    queries = spark.createDataFrame([(1, "user token"), (2, "fn login")], serve.QUERY_SCHEMA)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = lexical.search(index, queries, SearchConfig(candidate_cap=None))._jdf.queryExecution().executedPlan().toString().splitlines()
        scans = [i for i, line in enumerate(lines) if "Bucketed: true" in line]
        shuffles = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
        assert len(scans) == 3 and all(i < scans[0] for i in shuffles)
        assert any("WindowGroupLimit" in line for line in lines[shuffles[-1] :])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_uncapped_search_with_files_of_many_chunks(spark):
    """Chunks of one file that fill the first places leave room for the other files."""
    long = "\n".join(["user token user"] * 400)
    rows = [("a/long.py", long, len(long), 1), *[(f"b/{i}.py", "user" if i % 2 else "user token", 4, i) for i in range(8)]]
    many = build(files.chunk_lines(frame(spark, rows)), 3)
    got = found(many, spark, "user token", candidate_cap=None, top_k=6)
    assert len(got) == 6 and got == found(many, spark, "user token", candidate_cap=1000, top_k=6)


def test_parts_of_words_are_cleaned_of_all_signs(spark):
    from sextant.functions.text import word_tokens

    rows = spark.createDataFrame([("it's_a(b)",), ("don't",), ("<name>.x1",), ("Word,",), ("OK.",), ("é",), ("x",)], "w string")
    assert [r[0] for r in rows.select(word_tokens(F.col("w"))).collect()] == [["its", "ab", "its_ab"], ["dont"], ["name", "x1", "namex1"], ["word,", "word"], ["ok.", "ok"], ["é"], []]


def test_rerank_lists_no_more_of_a_label_than_it_shows(spark, tmp_path):
    """The join of queries with the items of their label has a few rows for each query, however large the label is."""
    from sextant.plans import queries as plan_queries

    spark.createDataFrame([(i, [1.0, float(i)], "a") for i in range(1000)], "vec_id long, embedding array<double>, label string").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = plan_queries.hybrid_rerank(spark, str(tmp_path))
    assert found.count() == 20 * plan_queries.RERANK_DEPTH
    lines = found._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(label" in lines  # cut by label before queries meet it


def test_lookups_of_results_shuffle_no_postings(spark, index):
    """Matches, contents and line counts are met where they lie."""
    queries = spark.createDataFrame([(1, "user token"), (2, "fn login")], serve.QUERY_SCHEMA)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = explain.explain_results(index, queries)
        lines = rows._jdf.queryExecution().executedPlan().toString().splitlines()
        at = next(i for i, line in enumerate(lines) if "Bucketed: true" in line or "bucketed_" in line)
        assert "Exchange hashpartitioning(token" not in "\n".join(lines) and any("BroadcastHashJoin [token" in line for line in lines[:at])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_judgments_are_worked_out_once(spark):
    from sextant.plans import corpus

    rows = corpus.qrels(spark, "/root/testdata/sf0.001")
    assert "Generate" not in rows._jdf.queryExecution().optimizedPlan().toString()
