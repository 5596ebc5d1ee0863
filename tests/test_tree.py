"""The file tree source: what it leaves out is never opened, and filters are tried by path."""

import pytest
from pyarrow import fs as pafs
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from sextant.functions import rules
from sextant.sources import files, tree


def written(root, names):
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"content of {name}")


NAMES = ["a.py", "src/b.rs", "src/deep/er/c.md", "src/node_modules/d.py", "build/e.py", "x.egg-info/f.py", "src/g.bin", "src/noending", "src/H.PY", "src/z.svg"]
KEPT = ["a.py", "src/H.PY", "src/b.rs", "src/deep/er/c.md"]


class Watched(tree.TreeReader):
    """Notes the folders that are listed and the files that are opened."""

    def __init__(self, *args):
        super().__init__(*args)
        self.listed, self.opened = [], []

    def _system(self):
        system, base = super()._system()
        note = self

        class System:
            def get_file_info(self, what):
                if isinstance(what, pafs.FileSelector):
                    note.listed.append(what.base_dir)
                return system.get_file_info(what)

            def open_input_file(self, path):
                note.opened.append(path)
                return system.open_input_file(path)

        return System(), base


@pytest.mark.parametrize("tasks", [1, 2, 3, 64])
def test_ignored_folders_are_not_listed_and_files_not_opened(tmp_path, tasks):
    written(tmp_path, NAMES)
    reader = Watched(str(tmp_path), 1 << 40, tasks)
    rows = [r for share in reader.partitions() for batch in reader.read(share) for r in batch.to_pylist()]
    assert sorted(r["path"] for r in rows) == KEPT and all(r["content"] == f"content of {r['path']}" for r in rows)
    assert sorted(p[len(str(tmp_path)) + 1 :] for p in reader.opened) == KEPT
    assert not any(x in p for p in reader.listed for x in ("node_modules", "build", "egg-info"))


def test_pushed_filters_are_tried_before_opening(tmp_path):
    written(tmp_path, NAMES)
    reader = Watched(str(tmp_path), 1 << 40, 2)
    wanted = [ds.StringStartsWith(("path",), "src/"), ds.Not(ds.StringEndsWith(("path",), ".md")), ds.GreaterThan(("n_bytes",), 3), ds.IsNotNull(("mtime",))]
    content = ds.StringContains(("content",), "x")
    assert list(reader.pushFilters([*wanted, content])) == [content]
    rows = [r for share in reader.partitions() for batch in reader.read(share) for r in batch.to_pylist()]
    assert sorted(r["path"] for r in rows) == ["src/H.PY", "src/b.rs"] and len(reader.opened) == 2


def test_through_spark(spark, tmp_path):
    written(tmp_path, NAMES)
    (tmp_path / "src/bad.py").write_bytes(b"\xff\xfe")
    df = files.read_tree(spark, str(tmp_path), tasks=3)
    assert df.columns == ["path", "content", "n_bytes", "mtime"]
    assert sorted(r.path for r in df.collect()) == KEPT
    some = df.where(F.col("path").endswith(".py") & (F.col("n_bytes") > 5) & F.col("content").contains("content"))
    assert [r.path for r in some.collect()] == ["a.py"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "content" in plan.split("Filter")[1].split("BatchScan")[0] and "EndsWith(path" not in plan.split("Filter")[1].split("BatchScan")[0]
    assert files.read_tree(spark, f"file://{tmp_path}/src").count() == 3 and files.read_tree(spark, str(tmp_path / "nowhere")).count() == 0


def test_many_files_in_one_folder(tmp_path):
    written(tmp_path, [f"flat/{i}.py" for i in range(50)] + [f"flat/{i}/x.py" for i in range(3)])
    reader = tree.TreeReader(str(tmp_path), 1 << 40, 7)
    shares = reader.partitions()
    found = [[r["path"] for batch in reader.read(s) for r in batch.to_pylist()] for s in shares]
    assert len(shares) == 7 and sum(map(len, found)) == 53 == len({p for own in found for p in own})
    assert max(map(len, found)) < 20


def test_names_as_columns_and_strings(spark):
    names = [*rules.IGNORED_DIRS[:5], "x.egg-info", "chromium-1", "src", "", "Node_modules"]
    paths = ["a.py", "A.PY", "a", "a.", ".py", "x.svg", "a.tar.gz", "d.e/f", "a.pdf", "a.py\n"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", rules.is_ignored_dir(F.col("n"))).collect()
    assert all(rules.ignored_dir_name(n) == found for n, found in got)
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", rules.is_code_file(F.col("p")) & ~rules.is_binary_file(F.col("p"))).collect()
    assert all(rules.indexed_ending(p) == found for p, found in got)
