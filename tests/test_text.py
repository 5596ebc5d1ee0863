import pytest
from pyspark.sql import functions as F

from sextant.functions import rules, text, vectors
from sextant.operators.vector_search import embed_text

TOKENS = {
    "getUserName": "get getusername name user",
    "HTTPServer": "http httpserver server",
    "XMLHttpRequest()": "http request() xml xmlhttprequest",
    "IOError2": "error2 io ioerror2",
    "foo_bar.rs": "bar foo foo_barrs rs",
    "src/main.rs": "rs srcmain srcmainrs",
    "snake_case": "case snake snake_case",
    "kebab-case": "case kebab kebabcase",
    "v1.5": "v1 v15",
    "Hello,": "hello hello,",
    "été": "été",
    "é": "é",
    "x": "",
    "A": "",
    "aB": "ab",
}


def column(spark, values, expression, name="x"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


def test_word_tokens(spark):
    got = column(spark, TOKENS, F.array_sort(text.word_tokens(F.col("x"))))
    assert [" ".join(g) for g in got] == [" ".join(sorted(v.split())) for v in TOKENS.values()]


def test_tokens_of_a_text_are_distinct(spark):
    assert sorted(column(spark, ["foo  foo\tBar bar"], text.tokens(F.col("x")))[0]) == ["bar", "foo"]
    assert column(spark, ["", "  "], text.tokens(F.col("x"))) == [[], []]


@pytest.mark.parametrize(
    "query,expected",
    [("parseConfig", True), ("foo_bar", True), ("Hello", True), ("hello.", True), (" a-b ", True), ("a\tB", True),
     ("parse config", False), ("hello", False), ("HELLO", False), ("", False)],
)
def test_identifier(spark, query, expected):
    assert column(spark, [query], text.looks_like_identifier(F.col("x"))) == [expected]


def test_symbols(spark):
    code = "async function Load() {}\nconst run = async (x) => 1\nexport class Foo {}\nfn été() {}\nstruct Pool;\nimpl Pool {}"
    assert sorted(column(spark, [code], text.symbols(F.col("x")))[0]) == ["foo", "load", "pool", "run", "été"]


def test_enclosing_context(spark):
    code = "fn outer() {\n  let x = 1;\n  if (x) {\n    y\n  }\nclass Foo\n z"
    expected = {1: "outer", 2: "outer", 4: "outer", 5: "outer", 6: "Foo", 7: "Foo", 99: "Foo"}
    rows = spark.createDataFrame([(k, code) for k in expected], "at int, x string")
    assert {r[0]: r[1] for r in rows.select("at", text.enclosing_context(F.col("x"), F.col("at"))).collect()} == expected
    assert column(spark, ["plain\nlines"], text.enclosing_context(F.col("x"), F.lit(2))) == [None]


@pytest.mark.parametrize("n", range(1, 13))
def test_utf8_prefix(spark, n):
    values = ["a€b𝄞c", "éééééé", "plain text", ""]
    expected = [v.encode()[:n].decode("utf-8", "ignore") for v in values]
    assert column(spark, values, text.utf8_prefix(F.col("x"), n)) == expected


def test_rules(spark):
    paths = {"src/a.py": True, "build/a.py": False, "x/chromium-1/a.py": False, "x/y.egg-info/a.md": False, "a.log": False, "A.PY": True, "noext": False, "a.b/c": False}
    kept = ~rules.in_ignored_dir(F.col("x")) & rules.is_code_file(F.col("x"))
    assert column(spark, paths, kept) == list(paths.values())


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0, 6.0]), ([0.0, 0.0, 0.0], [4.0, 5.0, 6.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in rows.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.974632, 0.0]
    row = spark.createDataFrame([([3.0, 4.0, 12.0],)], "v array<double>")
    cut = lambda d: [round(x, 6) for x in row.select(vectors.truncate_mrl(F.col("v"), d)).first()[0]]
    assert cut(2) == [0.6, 0.8] and cut(0) == cut(3) == cut(9) == [3.0, 4.0, 12.0]


def test_embedded_text_is_bounded(spark):
    assert len(column(spark, ["é" * 2000], embed_text(F.col("x")))[0].encode()) == len("search_document: ") + 1024
