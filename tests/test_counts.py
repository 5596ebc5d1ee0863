import random

from pyspark.sql import functions as F

from sextant.functions.counts import KNOWN
from sextant.functions.text import SYMBOL_KEYWORDS, SYMBOL_PATTERNS, symbols, word_tokens, words
from sextant.operators.index import term_frequency


def by_columns(items):
    word = items.select("k", F.explode(words(F.col("t"))).alias("w"))
    return word.select("k", F.explode(word_tokens(F.col("w"))).alias("token")).groupBy("token", "k").agg(F.count(F.lit(1)).alias("tf"))


def rows(df):
    return sorted(map(tuple, df.select("token", "k", "tf").collect()))


def test_counts_are_those_of_the_columns(spark):
    chars = [chr(i) for i in range(KNOWN)] + list("İıſǅΣς 　​’…𝄞٣Ⅷ")
    around = [f"{c} {c}{c} a{c} {c}b A{c} {c}B a{c}b aB{c}C AB{c}c x{c}Yz {c}Ab_{c} -{c}. 1{c}" for c in chars]
    draw = random.Random(7)
    mixed = ["".join(draw.choices("abABzZ09éÉßŸ-_.,!()'\" \t\n\x1c\x85İ’", k=120)) for _ in range(400)]
    spaces = [f"\x1c a{chr(i)}b" for i in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    texts = [*around, *spaces, *mixed, None, "", " \x1c ", "the THE!! the. The, THE"]
    items = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    assert rows(term_frequency(items, "k", "t")) == rows(by_columns(items))


def test_rows_of_one_key_count_as_one_text(spark):
    items = spark.createDataFrame([(1, "one two one"), (1, "two Éa"), (2, "one")], "k long, t string")
    assert rows(term_frequency(items, "k", "t")) == [("one", 1, 2), ("one", 2, 1), ("two", 1, 2), ("éa", 1, 1)]


def test_words_are_not_rows(spark):
    """No row for each word, and no aggregate over them."""
    items = spark.createDataFrame([(1, "one two")], "k long, t string")
    plan = term_frequency(items, "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


def test_keywords_stand_before_names(spark):
    assert [len(k) for k in SYMBOL_KEYWORDS] == [n for _, n in SYMBOL_PATTERNS]
    code = spark.createDataFrame([("const f = (x) => 1",), ("async function g() {}",), ("export function h",), ("nothing",), (None,)], "t string")
    assert [r[0] for r in code.select(symbols(F.col("t"))).collect()] == [["f"], ["g"], ["h"], [], None]
