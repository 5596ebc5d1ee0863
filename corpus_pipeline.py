"""The corpus pipeline: five stages over the documents, each reread from Parquet.

Counted as part of the training-data operators: it goes where they go. Columns of
documents pass through all stages as they came, whatever their names; the last
stage adds ``token_ids`` and ``n_tokens`` (with underscores behind them where a
column has that name). An empty table passes through all stages empty.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import bpe, exact_dedup, langid, mixing, near_dedup
from sextant.llm.common import deleted, fresh, id_remainder, scratch, stored, table, written
from sextant.llm.queries import tokenizer_path

#: A document stays if its language is known with at least this probability.
LEAST_LANGUAGE_SCORE = 0.5


#: Tables stored on the way by the last stage that ran.
_on_the_way: list[str] = []


def _stage(run: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(run)
    def alone(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        deleted(spark, _on_the_way)
        before = len(written())
        out = run(spark, docs, sf_dir)
        _on_the_way[:] = written(before)
        return out

    return alone


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those whose language is uncertain."""
    net = langid.train(docs, id_remainder(4) != 2)
    lang, score = fresh(docs, "_lang"), fresh(docs, "_score")
    found = langid.predict(docs, net, lang, score)
    sure = (F.col(lang) != F.lit(langid.UNKNOWN)) & (F.col(score) >= F.lit(LEAST_LANGUAGE_SCORE))
    return found.where(sure).select(*docs.columns)


@_stage
def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the longest original, then the smallest doc_id."""
    return exact_dedup.keep_first(docs, from_files=True)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group linked by five-word shingles alike to 0.8."""
    return near_dedup.keep_first(docs, from_files=True)


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents until each source has its target of words."""
    return mixing.repeat(docs, fresh(docs, "_copy"), from_files=True).select(*docs.columns)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids (little-endian unsigned 32-bit) and count."""
    return bpe.encode(docs, tokenizer_path(), "token_ids", "n_tokens")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("exact dedup", exact_duplicates),
    ("SimHash near-dedup", near_duplicates),
    ("mixing to target weights", mixture),
    ("BPE encoding", tokens),
]

#: A trained network, fingerprints and token ids have no SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            docs = stage(spark, docs, sf_dir)
            if i < len(STAGES) - 1:
                docs = stored(docs, f"stage-{i + 1}", keep=True)
    return docs
