"""Commits: recent ones, diffs cut to indexed files, text to search, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.config import DEFAULT, SearchConfig
from sextant.functions import rules
from sextant.functions.text import ellipsis, trimmed, utf8_prefix

_HEADER = "diff --git "


def diff_path(header: Column) -> Column:
    """The path of a diff header line: its fourth field without leading b/."""
    return F.regexp_replace(F.coalesce(F.try_element_at(F.split(header, " ", 4), F.lit(4)), F.lit("")), "^(b/)+", "")


def is_indexed(path: Column) -> Column:
    return ~rules.in_ignored_dir(path, with_name=False) & rules.is_code_file(path)


def filter_diff(raw: Column, config: SearchConfig = DEFAULT) -> Column:
    """The blocks of indexed files, each cut to a number of bytes, and the whole too.

    All blocks of a diff are in its own row, so an array expression does it.
    """
    body = F.when(raw.endswith("\n") | (raw == ""), raw).otherwise(F.concat(raw, F.lit("\n")))
    blocks = F.filter(F.split(F.regexp_replace(body, "\r\n", "\n"), f"(?m)(?=^{_HEADER})"), lambda b: b.startswith(_HEADER))
    mine = F.filter(blocks, lambda b: is_indexed(diff_path(F.split(b, "\n")[0])))
    limit = config.diff_block_bytes
    cut = F.transform(mine, lambda b: F.when(F.octet_length(b) > limit, F.concat(utf8_prefix(b, limit), F.lit("\n"))).otherwise(b))
    return utf8_prefix(F.array_join(cut, ""), config.diff_bytes)


def recent(commits: DataFrame, limit: int | None, config: SearchConfig = DEFAULT) -> DataFrame:
    """(hash, seq, message, diff_text) of the newest commits that have a message or a diff."""
    rows = commits if limit is None else commits.orderBy(F.desc("seq"), "hash").limit(limit)
    out = rows.select("hash", "seq", trimmed(F.col("message")).alias("message"), filter_diff(F.coalesce("raw_diff", F.lit("")), config).alias("diff_text"))
    return out.where("message <> '' OR diff_text <> ''")


def searchable(commits: DataFrame, config: SearchConfig = DEFAULT) -> DataFrame:
    """(id, text): the message, and the first bytes of the diff if there is one."""
    diff = utf8_prefix(F.col("diff_text"), config.commit_diff_bytes)
    text = F.when(F.col("diff_text") == "", F.col("message")).otherwise(F.concat_ws("\n", "message", diff))
    return commits.select(F.col("hash").alias("id"), text.alias("text"))


def diff_stats(diff: Column) -> Column:
    """struct(files, plus, minus) of a diff."""
    lines = F.split(diff, "\n")
    count = lambda test: F.size(F.filter(lines, test))
    return F.struct(
        count(lambda x: x.startswith("diff --git")).alias("files"),
        count(lambda x: x.startswith("+") & ~x.startswith("+++ ")).alias("plus"),
        count(lambda x: x.startswith("-") & ~x.startswith("--- ")).alias("minus"),
    )


def described(commits: DataFrame) -> DataFrame:
    """(id, short_hash, subject, files, plus, minus) as a report shows them."""
    return commits.select(
        F.col("hash").alias("id"),
        F.substring("hash", 1, 12).alias("short_hash"),
        ellipsis(F.split("message", "\r?\n")[0], 100).alias("subject"),
        diff_stats(F.col("diff_text")).alias("s"),
    ).select("id", "short_hash", "subject", "s.*")
