"""Registered queries: each applies an operator to a whole given table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.config import DEFAULT, SearchConfig
from sextant.functions import text, vectors
from sextant.operators import evaluate as ev
from sextant.operators import blocks, explain, fusion, lexical, pivots, state, vector_search
from sextant.operators import index as ix
from sextant.plans import corpus, report
from sextant.sources import commits as commit_source
from sextant.sources import files as file_source
from sextant.sources.generations import COMPRESSION
from sextant.sources.tables import shared_dir, table
from sextant.streaming import ingest, serve

IGNORE_TEXT = "# generated\n\nsrc3/\n*.rs\nsrc/src4/doc_*\n!src/keep.py\ndoc_61.py\n"
RECENT = 50_000
#: A limit below the number of commits.
FEW_COMMITS = 20
RERANK_DEPTH = 10


def r6(column) -> F.Column:
    return F.round(column, 6)


def joined(column: str, as_: str) -> F.Column:
    return F.array_join(F.array_sort(column), "|").alias(as_)


def scan_filter(spark: SparkSession, d: str) -> DataFrame:
    return file_source.scan(corpus.files(spark, d)).select("path", "n_bytes", "mtime")


def ignore_rules(spark: SparkSession, d: str) -> DataFrame:
    patterns = file_source.parse_ignore(spark.createDataFrame([(IGNORE_TEXT,)], "text string"))
    return file_source.not_ignored(corpus.files(spark, d), patterns).select("path")


def recency_cap(spark: SparkSession, d: str) -> DataFrame:
    return file_source.newest(corpus.chunks(spark, d), RECENT).select("chunk_id", "mtime")


def chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = file_source.chunk_lines(corpus.long_files(spark, d))
    return rows.select("chunk_id", "chunk_index", "line_start", "line_end", F.md5("content").alias("content_md5"))


def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = file_source.chunk_pages(corpus.html_files(spark, d))
    return rows.select("chunk_id", "chunk_index", "line_start", F.md5("content").alias("content_md5"))


def _distinct_words(spark: SparkSession, d: str) -> DataFrame:
    return corpus.files(spark, d).select(F.explode(text.words(F.col("content"))).alias("word")).distinct()


def camel_split(spark: SparkSession, d: str) -> DataFrame:
    """Each word and its reverse run together, so that words have humps."""
    pair = F.concat("word", F.lit("Xy"), F.reverse("word"))
    return _distinct_words(spark, d).select("word", F.array_join(text.split_camel(pair), "|").alias("parts"))


def tokenize_tf(spark: SparkSession, d: str) -> DataFrame:
    return corpus.index(spark, d).postings.select("token", "chunk_id", "tf")


def doc_freq_idf(spark: SparkSession, d: str) -> DataFrame:
    index = corpus.index(spark, d)
    rows = index.doc_freq.crossJoin(F.broadcast(index.stats))
    return rows.select("token", "df", r6(ix.idf(F.col("n"), F.col("df"))).alias("idf"))


def symbols(spark: SparkSession, d: str) -> DataFrame:
    return corpus.index(spark, d).chunk_meta.select("chunk_id", joined("symbols", "symbols"))


def enclosing_context(spark: SparkSession, d: str) -> DataFrame:
    rows = file_source.chunk_lines(file_source.scan(corpus.files(spark, d)))
    return rows.select("chunk_id", text.enclosing_context(F.col("content"), F.col("line_start")).alias("context"))


def identifier_query(spark: SparkSession, d: str) -> DataFrame:
    return _distinct_words(spark, d).select("word", text.looks_like_identifier(F.col("word")).alias("is_identifier"))


def _results(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "chunk_id", r6("raw").alias("raw"), r6("score").alias("score"))


def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    """One query at a time would be the same plan; this asks all, in lower case and without a code boost."""
    asked = corpus.queries(spark, d).withColumn("query", F.lower("query"))
    return _results(lexical.search(corpus.index(spark, d), asked, SearchConfig(code_boost=1.0)))


def lexical_search_batch(spark: SparkSession, d: str) -> DataFrame:
    return _results(lexical.search(corpus.index(spark, d), corpus.queries(spark, d)))


def lexical_search_uncapped(spark: SparkSession, d: str) -> DataFrame:
    return _results(lexical.search(corpus.index(spark, d), corpus.queries(spark, d), SearchConfig(candidate_cap=None)))


def lexical_search_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The search without a cap, by block bounds: most postings are not scored."""
    return _results(blocks.search(corpus.block_index(spark, d), corpus.queries(spark, d))[0])


def block_lists(spark: SparkSession, d: str) -> DataFrame:
    """Each token's postings and largest frequency, from the block lists written to buckets and read back."""
    path = f"{shared_dir(spark)}/block-index-{uuid.uuid4().hex}"
    blocks.write(corpus.block_index(spark, d), path)
    lists = blocks.read(spark, path).lists
    return lists.groupBy("token").agg(F.sum("n").alias("postings"), F.sum(F.size("postings")).alias("listed"), F.max("max_tf").alias("max_tf"))


def lexical_search_items(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "text")
    rows = lexical.search_items(items, corpus.queries(spark, d))
    return rows.select("query_id", "id", r6("raw").alias("raw"), r6("score").alias("score"))


def candidate_prune(spark: SparkSession, d: str) -> DataFrame:
    found = lexical.candidates(corpus.index(spark, d), lexical.query_terms(corpus.queries(spark, d)))
    return lexical.prune(found).select("query_id", "chunk_id", r6("idf_mass").alias("idf_mass"))


def _scored_terms(spark: SparkSession, d: str) -> DataFrame:
    index, terms = corpus.index(spark, d), lexical.query_terms(corpus.queries(spark, d))
    return lexical.with_contents(index, lexical.prune(lexical.candidates(index, terms)), terms)


def phrase_bonus(spark: SparkSession, d: str) -> DataFrame:
    return _scored_terms(spark, d).where(lexical.has_phrase()).select("query_id", "chunk_id")


def filename_bonus(spark: SparkSession, d: str) -> DataFrame:
    """Queries that name files: the path without its folder."""
    index = corpus.index(spark, d)
    asked = index.chunk_meta.where("chunk_index = 0").select("file_path", text.tokens(F.element_at(F.split("file_path", "/"), -1)).alias("q"))
    n = F.size(F.array_intersect("q", "file_name_tokens"))
    return asked.join(index.chunk_meta, "file_path").select("chunk_id", n.alias("matches"))


def vector_search_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = vector_search.search(corpus.vectors(spark, d), corpus.query_vectors(spark, d), DEFAULT.top_k)
    return rows.select("query_id", "id", "rank", r6("cosine").alias("cosine"))


def vector_search_pruned(spark: SparkSession, d: str) -> DataFrame:
    """The same nearest vectors by cells around pivots, of which only those in reach are scored."""
    rows, _ = pivots.search(pivots.build(corpus.vectors(spark, d)), corpus.query_vectors(spark, d), DEFAULT.top_k)
    return rows.select("query_id", "id", "rank", r6("cosine").alias("cosine"))


def vector_scores(spark: SparkSession, d: str) -> DataFrame:
    """The cosine of every vector to every query vector: the ranking without a limit."""
    rows = vector_search.search(corpus.vectors(spark, d), corpus.query_vectors(spark, d), None)
    return rows.select("query_id", "id", r6("cosine").alias("cosine"))


def mrl_truncate(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.vectors(spark, d).select("id", F.posexplode(vectors.truncate_mrl(F.col("vec"), 16)).alias("at", "x"))
    return rows.select("id", "at", r6("x").alias("x"))


def _two_rankings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Items by length and by id within each source and language, the second without the very short."""
    docs = table(spark, d, "documents").select(F.concat_ws("/", "source", "lang").alias("query_id"), F.col("doc_id").alias("id"), F.length("text").alias("n"))
    by = lambda rows, *order: rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return by(docs, F.desc("n"), "id"), by(docs.where("n >= 100"), "id")


def rrf_merge(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two_rankings(spark, d)
    merged = fusion.normalised(fusion.rrf(a, b, DEFAULT.identifier_boost), "fused")
    return merged.select("query_id", "id", r6("fused").alias("fused"))


def hybrid_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Each query vector's items by label and id, re-ranked by cosine."""
    asked = corpus.query_vectors(spark, d)
    items = corpus.vectors(spark, d)
    labels = items.select(F.col("id").alias("query_id"), "label")
    # no query lists more of a label than its first items
    first = Window.partitionBy("label").orderBy("id")
    heads = items.select("id", "label").withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= RERANK_DEPTH).drop("_nth")
    rows = asked.select("query_id").join(labels, "query_id").join(heads, "label")
    order = Window.partitionBy("query_id").orderBy("id")
    listed = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= RERANK_DEPTH).select("query_id", "id", "rank")
    named = asked.select("query_id", F.when(F.col("query_id") % 2 == 0, "parseConfig").otherwise(F.lit("parse config")).alias("query"))
    out = fusion.rerank(listed, named, asked, items)
    return out.select("query_id", "id", "rank", r6("vector_score").alias("vector_score"), r6("score").alias("score"))


def embed_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", vector_search.embed_text(F.col("text")).alias("t"))
    return docs.select("doc_id", F.octet_length("t").cast("long").alias("n_bytes"), F.md5("t").alias("text_md5"))


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", vector_search.embed_text(F.col("text")).alias("text"))
    return vector_search.keyed(rows, "text")


def _half_cache(spark: SparkSession, d: str) -> DataFrame:
    """A cache of the even documents' texts; the vector has four entries."""
    rows = _keyed(spark, d).where("doc_id % 2 = 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    return rows.select("key", F.array(*[F.col("doc_id").cast("float")] * 4).alias("vec"))


def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    return vector_search.missing(_keyed(spark, d), _half_cache(spark, d)).select("key")


def cache_sweep(spark: SparkSession, d: str) -> DataFrame:
    return vector_search.swept(_half_cache(spark, d), _keyed(spark, d).where("source <> 'src2'"))


def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A stored cache of the even documents, into which vectors of every third document are put."""
    path = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    vector_search.write_cache(_half_cache(spark, d), path)
    new = _keyed(spark, d).where("doc_id % 3 = 0").groupBy("key").agg(F.max("doc_id").alias("doc_id"))
    vector_search.write_cache(new.select("key", F.array(*[(-F.col("doc_id")).cast("float")] * 4).alias("vec")), path)
    return vector_search.read_cache(spark, path).select("key", F.col("vec")[3].cast("double").alias("x"))


def embed_cached(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all documents: cached ones as they are, the others computed."""
    cache = _half_cache(spark, d).select("key", F.col("vec").cast("array<double>").alias("vec"))
    rows = vector_search.embed_missing(_keyed(spark, d), cache, lambda texts: vector_search.hashed_vectors(texts, "key", "text"))
    return rows.select("key", F.size("vec").alias("n"), r6(F.col("vec")[0]).alias("first"), r6(F.col("vec")[3]).alias("fourth"))


def utf8_files(spark: SparkSession, d: str) -> DataFrame:
    """Pages as binary files, every fifth with a byte that is not UTF-8."""
    content = F.encode("html", "UTF-8")
    broken = F.when(F.col("page_id") % 5 == 0, F.concat(content, F.unhex(F.lit("FF")))).otherwise(content)
    raw = table(spark, d, "pages").select("page_id", broken.alias("content"), F.octet_length("html").cast("long").alias("length"), F.timestamp_seconds("page_id").alias("modificationTime"))
    rows = file_source.text_files(raw, F.concat(F.lit("page_"), F.col("page_id").cast("string")))
    return rows.select("path", "n_bytes", "mtime", F.md5("content").alias("content_md5"))


def tree_scan(spark: SparkSession, d: str) -> DataFrame:
    """Bytes and lines of the files of each folder, documents being written as a tree; src7's folder is an ignored one."""
    path = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    folder = F.when(F.col("source") == "src7", "src7.egg-info").otherwise(F.coalesce("source", F.lit("none")))
    table(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("value"), folder.alias("folder")).write.partitionBy("folder").text(path)
    rows = file_source.read_tree(spark, path).where(~F.startswith("path", F.lit("folder=src3/")))
    name = F.regexp_extract("path", "^folder=([^/]*)/", 1).alias("folder")
    lines = F.size(F.split("content", "\n", -1)) - F.lit(1)
    return rows.groupBy(name).agg(F.sum("n_bytes").alias("n_bytes"), F.sum(lines).alias("n_lines"))


def index_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A search on the index written to a folder and read back."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    corpus.index(spark, d).write(path)
    return _results(lexical.search(ix.Index.read(spark, path), corpus.queries(spark, d)))


def previews(spark: SparkSession, d: str) -> DataFrame:
    index, asked = corpus.index(spark, d), corpus.queries(spark, d)
    lines = file_source.total_lines(file_source.scan(corpus.files(spark, d)))
    rows = explain.presented(index, lexical.search(index, asked), asked, lines)
    return rows.select("query_id", "rank", F.md5("preview").alias("preview_md5"))


def diff_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = commit_source.recent(corpus.commits(spark, d), None)
    return rows.select("hash", F.octet_length("diff_text").cast("long").alias("n_bytes"), F.md5("diff_text").alias("diff_md5"))


def diff_stats(spark: SparkSession, d: str) -> DataFrame:
    return commit_source.described(commit_source.recent(corpus.commits(spark, d), None)).select("short_hash", "subject", "files", "plus", "minus")


def few_commits(spark: SparkSession, d: str) -> DataFrame:
    """The newest commits, under a limit below their number."""
    return commit_source.recent(corpus.commits(spark, d), FEW_COMMITS).select("hash", "seq")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return commit_source.searchable(commit_source.recent(corpus.commits(spark, d), DEFAULT.commit_limit))


def commit_search(spark: SparkSession, d: str) -> DataFrame:
    rows = report.commit_lexical(_items(spark, d), corpus.queries(spark, d))
    return rows.select("query_id", "rank", "id", r6("score").alias("score"))


def commit_vector_search(spark: SparkSession, d: str) -> DataFrame:
    rows = report.commit_vector(_items(spark, d), corpus.queries(spark, d))
    return rows.select("query_id", "rank", "id", r6("score").alias("score"))


def explain_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = explain.explain_tokens(corpus.index(spark, d), corpus.queries(spark, d))
    return rows.select("query_id", "token", F.col("doc_freq").cast("long").alias("doc_freq"), r6("idf").alias("idf"), "is_identifier_query")


def explain_results(spark: SparkSession, d: str) -> DataFrame:
    rows = explain.explain_results(corpus.index(spark, d), corpus.queries(spark, d))
    return rows.select("query_id", "rank", "chunk_id", joined("matched", "matched"), joined("missing", "missing"))


def coverage_bands(spark: SparkSession, d: str) -> DataFrame:
    index, asked = corpus.index(spark, d), corpus.queries(spark, d)
    lines = file_source.total_lines(file_source.scan(corpus.files(spark, d)))
    rows = explain.presented(index, lexical.search(index, asked), asked, lines)
    return rows.select("query_id", "rank", "chunk_id", "total_lines", r6("percent_of_best").alias("percent_of_best"), "band", r6("coverage").alias("coverage"), "context")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return lexical.search(corpus.index(spark, d), corpus.queries(spark, d)).select("query_id", F.col("file_path").alias("id"), "rank")


def eval_report(spark: SparkSession, d: str) -> DataFrame:
    rows = ev.evaluate(_ranked(spark, d), corpus.qrels(spark, d))
    return rows.select("query_id", *[r6(c).alias(c) for c in ("ndcg", "mrr", "recall", "precision")])


def eval_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = ev.mean_report(ev.evaluate(_ranked(spark, d), corpus.qrels(spark, d)))
    return rows.select("queries", *[r6(c).alias(c) for c in ("ndcg", "mrr", "recall", "precision")])


def vector_eval(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors judged by label: how many neighbours share the query's label."""
    items = corpus.vectors(spark, d)
    ranked = vector_search.search(items, corpus.query_vectors(spark, d), 100).select("query_id", "id", "rank")
    own = items.where(F.col("id") % corpus.QUERY_STEP == 0).select(F.col("id").alias("query_id"), "label")
    judged = own.join(items.select("id", "label"), "label").select("query_id", "id", F.lit(1.0).alias("rel"))
    rows = ev.evaluate(ranked, judged)
    return rows.select("query_id", *[r6(c).alias(c) for c in ("ndcg", "mrr", "recall", "precision")])


def _previous(spark: SparkSession, d: str) -> DataFrame:
    """An older tree: every third file missing, every fifth older, every seventh under a path that is gone."""
    n = F.regexp_extract("path", r"doc_(\d+)\.", 1).cast("long")
    rows = corpus.files(spark, d).where(n % 3 != 0)
    return rows.select(
        F.when(n % 7 == 0, F.concat(F.lit("old/"), "path")).otherwise(F.col("path")).alias("path"),
        "content",
        F.when(n % 5 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime"),
    )


def state_diff(spark: SparkSession, d: str) -> DataFrame:
    return state.compare(state.snapshot(_previous(spark, d)), state.snapshot(corpus.files(spark, d)))


def sync_index(spark: SparkSession, d: str) -> DataFrame:
    """Postings after syncing an index of the older tree; they must be those of a full build."""
    old = _previous(spark, d)
    base = ix.build(file_source.chunk_lines(old), corpus.spread(spark, d))
    synced, _ = state.sync(base, state.snapshot(old), corpus.files(spark, d))
    return synced.doc_freq.crossJoin(F.broadcast(synced.stats)).select("token", "df", "n")


def sync_tree(spark: SparkSession, d: str) -> DataFrame:
    """After a sync with scan: postings' sizes and the cached vectors that stay."""
    old = file_source.scan(_previous(spark, d))
    base = ix.build(file_source.chunk_lines(old), corpus.spread(spark, d))
    cached = vector_search.keyed(base.chunks.select(vector_search.embed_text(F.col("content")).alias("text")), "text").select("key").distinct()
    index, _, cache = state.sync_tree(base, state.snapshot(old), corpus.files(spark, d), cached)
    whole = state.compacted(index)
    sizes = whole.postings.agg(F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("tf"), F.countDistinct("token").alias("tokens"))
    return sizes.crossJoin(cache.agg(F.count(F.lit(1)).alias("cached"))).crossJoin(F.broadcast(whole.stats))


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies of an index kept current by a stream: first the older tree, then the files of today."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = corpus.files(spark, d)
    older = rows.where(F.regexp_extract("path", r"doc_(\d+)\.", 1).cast("long") % 2 == 0)
    older = older.select("path", F.concat(F.lit("fn stale\n"), "content").alias("content"), (F.col("n_bytes") + 9).alias("n_bytes"), (F.col("mtime") - 1).alias("mtime"))
    for part in (older, rows):
        part.write.mode("append").parquet(f"{base}/in", compression=COMPRESSION)
        ingest.start(spark, f"{base}/in", f"{base}/out", f"{base}/progress").awaitTermination()
    live = ingest.live_index(spark, f"{base}/out")
    return live.doc_freq.crossJoin(F.broadcast(live.stats)).select("token", "df", "n")


def stream_versions(spark: SparkSession, d: str) -> DataFrame:
    """What a stream of versions leaves: files of today, then late versions and deletions, then some files again."""
    base = f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}"
    number = F.regexp_extract("path", r"doc_(\d+)\.", 1).cast("long")
    rows = corpus.files(spark, d).withColumn("deleted", F.lit(False)).withColumn("k", number)
    later = lambda of, n, head, deleted=False: of.select("path", F.concat(F.lit(head), "content").alias("content"), "n_bytes", (F.col("mtime") + n).alias("mtime"), F.lit(deleted).alias("deleted"))
    batches = [
        rows.drop("k"),
        later(rows.where("k % 2 = 0"), -1, "fn stale\n").unionByName(later(rows.where("k % 5 = 0"), 5, "", True)),
        later(rows.where("k % 10 = 0"), 6, "fn again\n").unionByName(later(rows.where("k % 15 = 0 AND k % 10 <> 0"), 4, "fn toolate\n")),
    ]
    for part in batches:
        part.write.mode("append").parquet(f"{base}/in", compression=COMPRESSION)
        ingest.start(spark, f"{base}/in", f"{base}/out", f"{base}/progress").awaitTermination()
    live = ingest.live_index(spark, f"{base}/out")
    return live.doc_freq.crossJoin(F.broadcast(live.stats)).select("token", "df", "n")


def stream_serve(spark: SparkSession, d: str) -> DataFrame:
    """The batch of queries, answered as a stream."""
    base = f"{shared_dir(spark)}/serve-{uuid.uuid4().hex}"
    corpus.queries(spark, d).write.json(f"{base}/in")
    serve.start(spark, corpus.index(spark, d), f"{base}/in", f"{base}/out", f"{base}/progress").awaitTermination()
    return _results(spark.read.parquet(f"{base}/out"))


def stream_serve_live(spark: SparkSession, d: str) -> DataFrame:
    """Even queries asked when half of the files are in, odd ones when all are: results name their version."""
    base = f"{shared_dir(spark)}/serve-live-{uuid.uuid4().hex}"
    rows, asked = corpus.files(spark, d), corpus.queries(spark, d)
    half = F.regexp_extract("path", r"doc_(\d+)\.", 1).cast("long") % 2 == 0
    for files, batch in ((rows.where(half), asked.where("query_id % 2 = 0")), (rows.where(~half), asked.where("query_id % 2 <> 0"))):
        files.write.mode("append").parquet(f"{base}/files", compression=COMPRESSION)
        ingest.start(spark, f"{base}/files", f"{base}/live", f"{base}/ingested").awaitTermination()
        batch.write.mode("append").json(f"{base}/asked")
        serve.start_live(spark, f"{base}/live", f"{base}/asked", f"{base}/out", f"{base}/served").awaitTermination()
    found = spark.read.parquet(f"{base}/out")
    return found.select("version", "query_id", "rank", "chunk_id", r6("raw").alias("raw"), r6("score").alias("score"))


def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    return state.summary(corpus.index(spark, d).chunks)


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    rows = report.hybrid_search(corpus.index(spark, d), corpus.queries(spark, d))
    return rows.select("query_id", "rank", "chunk_id", r6("vector_score").alias("vector_score"), r6("score").alias("score"))


def search_report(spark: SparkSession, d: str) -> DataFrame:
    lines = file_source.total_lines(file_source.scan(corpus.files(spark, d)))
    rows = report.search_report(corpus.index(spark, d), corpus.commits(spark, d), corpus.queries(spark, d), lines)
    same = ["context", "line_start", "total_lines", "short_hash", "subject", "files", "plus", "minus"]
    return rows.select("section", "query_id", "rank", "id", r6("percent").alias("percent"), "band", r6("coverage").alias("coverage"), F.md5("preview").alias("preview_md5"), *same)


def server_report(spark: SparkSession, d: str) -> DataFrame:
    lines = file_source.total_lines(file_source.scan(corpus.files(spark, d)))
    rows = report.server_report(corpus.index(spark, d), corpus.commits(spark, d), corpus.queries(spark, d), lines)
    return rows.select("section", "query_id", "rank", "id", r6("percent").alias("percent"), "line_start", F.md5("preview").alias("preview_md5"), "short_hash", "subject")


_ALL = (
    scan_filter, ignore_rules, recency_cap, chunk_lines, chunk_pages, camel_split, tokenize_tf, doc_freq_idf, symbols,
    enclosing_context, identifier_query, lexical_search, lexical_search_batch, lexical_search_uncapped,
    lexical_search_items, candidate_prune, phrase_bonus, filename_bonus, vector_search_topk, vector_search_pruned, mrl_truncate, rrf_merge,
    hybrid_rerank, embed_text, cache_misses, cache_sweep, diff_filter, diff_stats, commit_search, commit_vector_search,
    explain_tokens, explain_results, coverage_bands, eval_report, eval_mean, vector_eval, state_diff, sync_index,
    corpus_summary, hybrid_search, search_report, vector_scores, cache_upsert, embed_cached, utf8_files,
    tree_scan, lexical_search_blocks, block_lists, index_round_trip, previews, few_commits, sync_tree, stream_ingest, stream_versions, stream_serve, stream_serve_live, server_report,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}
