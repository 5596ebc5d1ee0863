"""A Spark data source for file trees that decides by path before a content is opened.

``spark.read.format("file_tree").load(root)`` gives files(path, content, n_bytes,
mtime) without ignored folders, unknown or binary endings, files above ``maxBytes``
and contents that are not UTF-8. Ignored folders are not even listed. Filters on path,
n_bytes and mtime that a query has are pushed into the source and tried before a file
is opened; only a filter on the content needs it.

The driver lists folders from the root down only until it has enough of them, or of
files, for ``tasks`` tasks, so what it holds is some ``tasks`` folders and no tree. Each task walks its own
folders. If they are fewer than tasks, all tasks list the same ones, and each reads the
files whose path falls to it by a hash; files that the driver met are dealt out by it. Files are listed and read through Arrow's file
systems, so a root may be any address that those know. A folder or file that is gone or
cannot be read is left out, as is a root that does not exist.
"""

from __future__ import annotations

import operator
import posixpath
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

from sextant.functions import rules

SCHEMA = "path string, content string, n_bytes long, mtime long"
FORMAT = "file_tree"
#: Tasks that a tree is dealt over, if the reader's option ``tasks`` does not say.
TASKS = 64
#: Bytes of contents in a batch that goes to Spark.
BATCH_BYTES = 8 << 20

_FACTS = ("path", "n_bytes", "mtime")
_COMPARE: dict[type, Callable] = {
    ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt,
    ds.LessThanOrEqual: operator.le, ds.In: lambda x, many: x in many, ds.StringStartsWith: str.startswith,
    ds.StringEndsWith: str.endswith, ds.StringContains: operator.contains,
}


@dataclass
class Share(ds.InputPartition):
    """Folders to walk, files beside them, and which of the paths below are this task's."""

    folders: list[str]
    files: list[str]
    nth: int
    of: int


def _test(found: ds.Filter) -> Callable[[dict], bool] | None:
    """A filter as a test of a file's facts; None where it needs more than those."""
    if isinstance(found, ds.Not):
        inner = _test(found.child)
        return inner and (lambda facts: not inner(facts))
    name = found.attribute[0] if len(getattr(found, "attribute", ())) == 1 else None
    if name not in _FACTS:
        return None
    if isinstance(found, ds.IsNotNull):
        return lambda facts: True
    compare = _COMPARE.get(type(found))
    if compare is None or getattr(found, "value", None) is None:
        return None
    return lambda facts: compare(facts[name], found.value)


class TreeReader(ds.DataSourceReader):
    def __init__(self, root: str, max_bytes: int, tasks: int):
        self.root, self.max_bytes, self.tasks = root, max_bytes, tasks
        self.tests: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for found in filters:
            if _test(found) is None:
                yield found
            else:
                self.tests.append(found)

    def _system(self) -> tuple[pafs.FileSystem, str]:
        if self.root.startswith("file:") or ":/" not in self.root:
            return pafs.LocalFileSystem(), "/" + self.root.removeprefix("file:").strip("/")
        system, base = pafs.FileSystem.from_uri(self.root)
        return system, base.rstrip("/")

    def _listed(self, system: pafs.FileSystem, folder: str) -> tuple[list[str], list[pafs.FileInfo]]:
        """The folders below that are not ignored, and the files."""
        try:
            found = system.get_file_info(pafs.FileSelector(folder, recursive=False))
        except OSError:
            return [], []
        folders = [x.path for x in found if x.type == pafs.FileType.Directory and not rules.ignored_dir_name(posixpath.basename(x.path))]
        return sorted(folders), [x for x in found if x.type == pafs.FileType.File]

    def partitions(self) -> list[Share]:
        system, base = self._system()
        folders, files = deque([base]), []
        while folders and len(folders) < self.tasks and len(files) < self.tasks:
            below, own = self._listed(system, folders.popleft())
            folders += below
            files += [x.path for x in own]
        folders, n = list(folders), self.tasks
        if len(folders) >= n:
            return [Share(folders[i::n], files[i::n], 0, 1) for i in range(n)]
        shares = [Share(folders, files[i::n], i, n) for i in range(n)]
        return [x for x in shares if x.folders or x.files] or shares[:1]

    def _walked(self, system: pafs.FileSystem, share: Share) -> Iterator[pafs.FileInfo]:
        yield from (x for x in system.get_file_info(share.files) if x.type == pafs.FileType.File) if share.files else ()
        waiting = deque(share.folders)
        while waiting:
            folders, files = self._listed(system, waiting.popleft())
            waiting += folders
            yield from (x for x in files if share.of == 1 or zlib.crc32(x.path.encode("utf-8", "surrogateescape")) % share.of == share.nth)

    def _facts(self, info: pafs.FileInfo, base: str) -> dict | None:
        """What is known of a file before it is opened; None if it is not indexed."""
        path = info.path[len(base) :].lstrip("/").replace("\\", "/")
        if any(map(rules.ignored_dir_name, path.split("/"))) or not rules.indexed_ending(path) or info.size > self.max_bytes:
            return None
        return {"path": path, "n_bytes": info.size, "mtime": int((info.mtime_ns or 0) // 1_000_000_000)}

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        system, base = self._system()
        tests = [_test(x) for x in self.tests]
        rows, held = [], 0
        schema = pa.schema([("path", pa.string()), ("content", pa.string()), ("n_bytes", pa.int64()), ("mtime", pa.int64())])
        for info in self._walked(system, partition):
            facts = self._facts(info, base)
            if facts is None or not all(test(facts) for test in tests):
                continue
            try:
                with system.open_input_file(info.path) as f:
                    content = f.read().decode()
            except (OSError, UnicodeDecodeError):
                continue
            rows.append((facts["path"], content, facts["n_bytes"], facts["mtime"]))
            held += facts["n_bytes"]
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class TreeSource(ds.DataSource):
    """Options: ``path`` (of load), ``maxBytes``, ``tasks``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        if "path" not in self.options:
            raise ValueError("a file tree needs a path: load(root)")
        return TreeReader(self.options["path"], int(self.options.get("maxbytes", 1 << 62)), int(self.options.get("tasks", TASKS)))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let queries push filters into it."""
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
