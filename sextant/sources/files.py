"""Files to chunks: scan filters, ignore rules, line windows, pages, recency cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.config import DEFAULT, SearchConfig
from sextant.functions import rules
from sextant.functions.text import is_blank, trimmed
from sextant.sources import tree


def text_files(raw: DataFrame, path: Column) -> DataFrame:
    """files(path, content, n_bytes, mtime) of binary files (content, length, modificationTime); invalid UTF-8 is dropped."""
    text = F.col("content").cast("string")
    return raw.where(F.is_valid_utf8(text)).select(
        path.alias("path"),
        text.alias("content"),
        F.col("length").alias("n_bytes"),
        F.unix_seconds("modificationTime").alias("mtime"),
    )


def read_tree(spark: SparkSession, root: str, config: SearchConfig = DEFAULT, tasks: int = tree.TASKS) -> DataFrame:
    """A file tree as files(path, content, n_bytes, mtime), without those that ``scan`` drops: they are not opened."""
    tree.register(spark)
    return spark.read.format(tree.FORMAT).option("maxBytes", config.max_file_bytes).option("tasks", tasks).load(root)


def is_scanned(config: SearchConfig = DEFAULT) -> Column:
    """Whether a file is indexed: no ignored directory, a known extension, not too large."""
    path = rules.normal_path(F.col("path"))
    return ~rules.in_ignored_dir(path) & rules.is_code_file(path) & ~rules.is_binary_file(path) & (F.col("n_bytes") <= config.max_file_bytes)


def scan(files: DataFrame, config: SearchConfig = DEFAULT) -> DataFrame:
    """The files that are indexed."""
    return files.where(is_scanned(config)).withColumn("path", rules.normal_path(F.col("path")))


def parse_ignore(texts: DataFrame) -> DataFrame:
    """pattern of each line of ignore files (column ``text``), with the built-in names."""
    line = trimmed(F.col("line"))
    bare = F.regexp_replace(line, "/+$", "")
    cleaned = F.when(bare.contains("*"), F.regexp_replace(bare, r"[*/]+$", "")).otherwise(bare)
    own = (
        texts.select(F.explode(F.split("text", "\r?\n")).alias("line"))
        .where((line != "") & ~line.startswith("#") & ~line.startswith("!"))
        .select(cleaned.alias("pattern"))
        .where("pattern <> ''")
    )
    spark = texts.sparkSession
    return own.union(spark.createDataFrame([(p,) for p in rules.BUILT_IN_PATTERNS], "pattern string")).distinct()


def not_ignored(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Files that neither the lists nor a pattern excludes.

    A pattern with a slash must not occur in the path, another must equal no
    component. Components meet patterns by an equi join; only the patterns with a
    slash are tried on every path, and those are the lines of a few ignore files.
    """
    path = rules.normal_path(F.col("path"))
    keep = ~rules.in_ignored_dir(path, with_name=False) & rules.is_code_file(path) & ~rules.is_binary_file(path)
    base = files.where(keep).withColumn("path", path)
    plain = patterns.where(~F.col("pattern").contains("/"))
    nested = patterns.where(F.col("pattern").contains("/"))
    parts = base.select("path", F.explode(F.split("path", "/")).alias("pattern"))
    hit = parts.join(plain, "pattern", "left_semi").select("path").distinct()
    found = base.join(hit, "path", "left_anti")
    return found.join(nested, F.contains(found["path"], nested["pattern"]), "left_anti")


def windowed(files: DataFrame, config: SearchConfig = DEFAULT) -> DataFrame:
    """Files with their overlapping ``windows`` of lines: (content, line_start, line_end) in order.

    A file of at most ``chunk_lines`` lines is one window, even if empty. Of longer
    files, blank windows are left out.
    """
    size, step = config.chunk_lines, config.chunk_lines - config.chunk_overlap
    lines = F.split("content", "\n", -1)
    n = F.size("lines")
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - F.lit(size)) / F.lit(step)) * F.lit(step)).cast("int")

    def window(start):
        body = F.array_join(F.slice(F.col("lines"), start + F.lit(1), F.lit(size)), "\n")
        return F.struct(body.alias("content"), (start + F.lit(1)).alias("line_start"), F.least(start + F.lit(size), n).alias("line_end"))

    windows = F.transform(F.sequence(F.lit(0), last, F.lit(step)), window)
    kept = F.when(n <= size, windows).otherwise(F.filter(windows, lambda w: ~is_blank(w["content"])))
    return files.withColumn("lines", lines).withColumn("windows", kept).drop("lines")


def chunk_lines(files: DataFrame, config: SearchConfig = DEFAULT, more: tuple[str, ...] = ()) -> DataFrame:
    """The windows of files: chunks(chunk_id, file_path, chunk_index, content, ...), with the files' columns ``more`` behind.

    Windows that are left out take no index. All windows of a file come from its own
    row, so nothing is shuffled.
    """
    rows = windowed(files, config).select("path", "mtime", *more, F.posexplode("windows").alias("chunk_index", "w"))
    return rows.select(
        chunk_id(F.col("path"), F.col("chunk_index")).alias("chunk_id"),
        F.col("path").alias("file_path"),
        "chunk_index",
        "w.content",
        "w.line_start",
        "w.line_end",
        F.col("mtime").cast("long").alias("mtime"),
        *more,
    )


def chunk_id(path: Column, chunk_index: Column) -> Column:
    return F.concat_ws("#", path, chunk_index)


def chunk_pages(files: DataFrame) -> DataFrame:
    """A chunk for each page between form feeds; blank pages are left out, numbers keep their gaps."""
    pages = files.select("path", "mtime", F.posexplode(F.split("content", "\f", -1)).alias("chunk_index", "page"))
    return pages.where(~is_blank(F.col("page"))).select(
        F.concat_ws("#", "path", "chunk_index").alias("chunk_id"),
        F.col("path").alias("file_path"),
        "chunk_index",
        trimmed(F.col("page")).alias("content"),
        (F.col("chunk_index") + 1).alias("line_start"),
        (F.col("chunk_index") + 1).alias("line_end"),
        F.col("mtime").cast("long").alias("mtime"),
    )


def newest(chunks: DataFrame, n: int | None) -> DataFrame:
    """The n chunks of the newest files; all if n is None."""
    if n is None:
        return chunks
    return chunks.orderBy(F.desc("mtime"), "file_path", "chunk_index").limit(n)


def total_lines(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("file_path"), F.size(F.split("content", "\n", -1)).alias("total_lines"))
