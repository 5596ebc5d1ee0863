"""The given tables as files, queries, judgments, commits and vectors.

``documents`` stand for source files: source and language choose directory and
extension, so that every scan rule has files on both sides. A first line names a
definition, because the texts themselves have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators import blocks
from sextant.operators.index import Index, build, parts
from sextant.operators.lexical import sent
from sextant.sources.files import chunk_lines, scan
from sextant.sources.tables import stored, table

FIRST_MTIME = 1_704_067_200
#: Vectors whose id this divides are queries.
QUERY_STEP = 50
#: Words of a passage by which documents that may hold it are found.
KEY_WORDS = 5
#: A blank query, which finds nothing, beside the passages.
BLANK_QUERY = (-1, " \t")

_indexes: dict[tuple[str, str], Index] = {}
_block_indexes: dict[tuple[str, str], blocks.BlockIndex] = {}


def _path() -> F.Column:
    folder = F.when(F.col("source") == "src7", "node_modules/").otherwise(F.lit("src/"))
    ending = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".md").when(F.col("lang") == "de", ".rs").otherwise(F.lit(".log"))
    return F.concat(folder, "source", F.lit("/doc_"), F.col("doc_id").cast("string"), ending)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.regexp_extract("text", "^[A-Za-z]*", 0)
    rows = table(spark, sf_dir, "documents").select(
        _path().alias("path"),
        F.concat(F.lit("fn "), name, F.lit("\n"), "text").alias("content"),
        (F.lit(FIRST_MTIME) + F.col("doc_id") * 60).alias("mtime"),
    )
    return rows.select("path", "content", F.octet_length("content").cast("long").alias("n_bytes"), "mtime")


def long_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents one after the other in each file."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"])
    group = F.floor(F.col("doc_id") / 10)
    rows = table(spark, sf_dir, "documents").groupBy(group.alias("g")).agg(F.array_join(parts, "\n").alias("content"))
    return rows.select(
        F.concat(F.lit("src/long_"), F.col("g").cast("string"), F.lit(".txt")).alias("path"),
        "content",
        F.octet_length("content").cast("long").alias("n_bytes"),
        (F.lit(FIRST_MTIME) + F.col("g")).alias("mtime"),
    )


def html_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files whose paragraphs are pages of their own."""
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("site/page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.replace("html", F.lit("<p>"), F.lit("\f<p>")).alias("content"),
        (F.lit(FIRST_MTIME) + F.col("page_id")).alias("mtime"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_lines(scan(files(spark, sf_dir)))


def spread(spark: SparkSession, sf_dir: str) -> int:
    """Buckets for an index of ``documents``, by the bytes of their texts."""
    return parts(table(spark, sf_dir, "documents").select(F.col("text").alias("content")))


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of ``chunks``, built once for each session and input."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        _indexes[key] = build(chunks(spark, sf_dir), spread(spark, sf_dir))
    return _indexes[key]


def block_index(spark: SparkSession, sf_dir: str) -> blocks.BlockIndex:
    """The block index over ``index``, built once likewise."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _block_indexes:
        _block_indexes[key] = blocks.build(index(spark, sf_dir))
    return _block_indexes[key]


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a query, and a blank one."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), F.col("text").alias("query"))
    return rows.unionByName(spark.createDataFrame([BLANK_QUERY], "query_id long, query string"))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that hold a whole query item: relevance 1, and 1 more for good quality.

    A document that holds an item holds the words inside it, without the first and
    last, which may be parts of longer ones. So pairs are found by a run of KEY_WORDS
    of them, and verified. Items of fewer words are tried on every document.
    """
    words = lambda text: F.split(text, r"\s+")
    run = lambda ws, at: F.xxhash64(F.array_join(F.slice(ws, at, F.lit(KEY_WORDS)), " "))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), F.col("text").alias("item"))
    items = items.where("item IS NOT NULL").withColumn("ws", words(F.trim("item")))
    long = items.where(F.size("ws") >= KEY_WORDS + 2).select("query_id", "item", run(F.col("ws"), F.lit(2)).alias("run"))
    short = items.where(F.size("ws") < KEY_WORDS + 2).select("query_id", "item")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", _path().alias("id"))
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(1.0))
    last = F.size("ws") - F.lit(KEY_WORDS - 1)
    runs = F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: run(F.col("ws"), i)))
    keyed = docs.select("doc_id", words(F.col("text")).alias("ws")).select("doc_id", F.explode(F.array_distinct(runs)).alias("run"))
    pairs = stored(keyed.join(sent(long, long.count()), "run").select("doc_id", "query_id").distinct(), "qrels-pairs")
    # texts stay where they are: the pairs, and then the items, go to them
    found = docs.join(sent(pairs, pairs.count()), "doc_id").join(sent(long.select("query_id", "item"), long.count()), "query_id")
    held = found.where(F.contains("text", "item")).select("doc_id", "id", "query_id").distinct()
    held = held.unionByName(docs.join(short, F.contains("text", "item")).select("doc_id", "id", "query_id"))
    rel = F.lit(1.0) + F.coalesce("good", F.lit(0.0))
    rows = held.select("query_id", "id", "doc_id").join(good, "doc_id", "left").select("query_id", "id", rel.alias("rel"))
    return stored(rows, "qrels")  # met by the ranking and by the ideal one


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as commits: the first turn is the message, later ones are diff blocks."""
    odd = F.col("turn") % 2 == 1
    number = F.col("turn").cast("string")
    path = F.when(odd, F.concat(F.lit("src/t"), number, F.lit(".py"))).otherwise(F.concat(F.lit("node_modules/t"), number, F.lit(".js")))
    sign = F.when(F.col("role") == "assistant", "+").otherwise("-")
    body = F.concat(sign, F.replace("text", F.lit("\n"), F.concat(F.lit("\n"), sign)))
    block = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n"), body, F.lit("\n"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", block.alias("block"))
    joined = rows.groupBy("conv_id").agg(
        F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("message"),
        F.array_sort(F.collect_list(F.when(F.col("turn") > 0, F.struct("turn", "block")))).alias("blocks"),
    )
    return joined.select(
        F.md5(F.col("conv_id").cast("string")).alias("hash"),
        F.col("conv_id").alias("seq"),
        F.coalesce("message", F.lit("")).alias("message"),
        F.array_join(F.transform("blocks", lambda b: b["block"]), "").alias("raw_diff"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by QUERY_STEP, as a query."""
    return vectors(spark, sf_dir).where(F.col("id") % QUERY_STEP == 0).select(F.col("id").alias("query_id"), "vec")
