"""The driver's contract: names, and importing without the optional part."""

import hashlib
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from sextant.plans import queries

ROOT = Path(__file__).resolve().parent.parent
SMALL = Path("/root/testdata/sf0.001")
SIZES = (112, 100, 13)
PATTERNS = (6, 7)
#: The first digits of SHA-256 over each list's and pattern's text.
PINS = {
    "IGNORED_DIRS": "ccafd5e111953a21",
    "IGNORED_DIR_SUFFIXES": "00e468d3b7df445e",
    "IGNORED_DIR_PREFIXES": "0fae534e334c60a5",
    "CODE_EXTENSIONS": "ab1ac67dacdcb019",
    "BINARY_EXTENSIONS": "c708d3a96661ee30",
    "BUILT_IN_PATTERNS": "5cce62c31fd88487",
    "SYMBOL_PATTERNS": "baa0494e3cb1104f",
    "CONTEXT_PATTERN": "214229c660a25da0",
    "CONTEXT_SKIP": "17d25d566b8af35e",
}


def test_every_retrieval_query_has_sql():
    assert set(queries.queries()) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_without_the_optional_part(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "sextant", tmp_path / "sextant", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    n = str(len(queries.queries()))
    assert done.stdout.split()[-2:] == [n, n]


@pytest.mark.skipif(not SMALL.exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", ["chunk_lines", "tokenize_tf", "lexical_search_batch", "hybrid_rerank", "diff_filter", "coverage_bands", "eval_report", "server_report", "embed_cached", "utf8_files"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = queries.queries()[name](spark, str(SMALL))
    columns = sorted(got.columns)
    result = con.sql(entry.oracle_sql()[name])
    assert sorted(result.columns) == columns
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted(tuple("" if x is None else f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert plain(map(tuple, got.select(*columns).collect())) == plain(want)


def test_a_part_that_cannot_be_imported_is_left_out(tmp_path):
    """A missing package of the optional part takes its queries away, not the others."""
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "sextant", tmp_path / "sextant", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "sextant/llm").mkdir()
    (tmp_path / "sextant/llm/__init__.py").write_text("import a_package_that_is_missing\n")
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert done.stdout.split()[-1] == str(len(queries.queries()))


def test_fixed_lists():
    """Lengths and ends of the lists that library and SQL share, so that a wrong one cannot pass on both sides."""
    from sextant.functions import rules, text

    assert (len(rules.IGNORED_DIRS), len(rules.CODE_EXTENSIONS), len(rules.BUILT_IN_PATTERNS)) == SIZES
    assert ".py" in rules.CODE_EXTENSIONS and "node_modules" in rules.IGNORED_DIRS and "Cargo.lock" in rules.BUILT_IN_PATTERNS
    assert (len(text.SYMBOL_PATTERNS), text.CONTEXT_GROUPS) == PATTERNS
    for name, pin in PINS.items():
        value = getattr(rules, name, None) or getattr(text, name)
        assert hashlib.sha256(repr(value).encode()).hexdigest()[:16] == pin, name
