"""Python data source for directory trees on storage that all executors can reach.

``binaryFile`` drops names that begin with an underscore or a dot, so it cannot list a source
tree. Usage::

    spark.dataSource.register(TreeSource)
    spark.read.format("source_tree").option("path", "/repos/a").load()

Options: ``path`` (several with newlines), ``content`` (``true`` adds the bytes), ``max_file_mb``,
``min_partitions``, ``split_files`` (files of one folder that a task takes, if the planner lists the folder),
``pushdown`` (``true`` lets filters reach the walk; needs ``spark.sql.python.filterPushdown.enabled``).
One row per file, folder and error, told apart by ``kind``. ``read_tree`` sets the options that the session allows.
"""

from __future__ import annotations

import os
import stat as st
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from treeloom.functions import lookups
from treeloom.sources.encoding import decode

SCHEMA = (
    "kind string, repo string, path string, relative_path string, name string, size long, "
    "last_modified timestamp, error string"
)

PART = 1 << 21
ROW = 512  # about the bytes of a row's facts
KINDS = list(pa.schema(
    [("kind", pa.string()), ("repo", pa.string()), ("path", pa.string()), ("relative_path", pa.string()), ("name", pa.string()),
     ("size", pa.int64()), ("last_modified", pa.timestamp("us", "UTC")), ("error", pa.string()), ("content", pa.binary())]
))


def _batch(rows: list[tuple], kinds: list[pa.Field]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], names=[k.name for k in kinds])


def _skips_dir(name: str) -> bool:
    return name.startswith(".") or name in lookups.EXCLUDED_DIRS


def _skips_file(name: str) -> bool:
    return name.startswith(".") or ("lock" in name.lower() and name.endswith(lookups.LOCK_SUFFIXES))


def _is_dir(entry: os.DirEntry) -> bool:
    """Whether an entry is a folder; a link that cannot be followed is none."""
    try:
        return entry.is_dir()
    except OSError:
        return False


def _is_file(entry: os.DirEntry) -> bool:
    try:
        return entry.is_file()
    except OSError:
        return False


COMPARED = {
    ds.EqualTo: lambda a, b: a == b, ds.GreaterThan: lambda a, b: a > b, ds.GreaterThanOrEqual: lambda a, b: a >= b,
    ds.LessThan: lambda a, b: a < b, ds.LessThanOrEqual: lambda a, b: a <= b,
    ds.StringStartsWith: str.startswith, ds.StringEndsWith: str.endswith, ds.StringContains: lambda a, b: b in a,
}
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
PUSHED = {"kind", "repo", "path", "relative_path", "name", "size"}


def holds(condition: ds.Filter, facts: dict) -> bool | None:
    """A filter on the facts of a row, as SQL has it: nothing if an operand is null."""
    if isinstance(condition, ds.Not):
        inner = holds(condition.child, facts)
        return None if inner is None else not inner
    value = facts[condition.attribute[0]]
    if isinstance(condition, ds.IsNull):
        return value is None
    if isinstance(condition, ds.IsNotNull):
        return value is not None
    if isinstance(condition, ds.EqualNullSafe):
        return value == condition.value
    operand = condition.value
    if isinstance(condition, ds.In):
        if value is None:
            return None
        return True if value in operand else (None if None in operand else False)
    return None if value is None or operand is None else COMPARED[type(condition)](value, operand)


def pushable(condition: ds.Filter) -> bool:
    """Can the walk decide this filter before it reads a file?"""
    if isinstance(condition, ds.Not):
        return pushable(condition.child)
    known = type(condition) in COMPARED or isinstance(condition, (ds.In, ds.IsNull, ds.IsNotNull, ds.EqualNullSafe))
    return known and len(condition.attribute) == 1 and condition.attribute[0] in PUSHED


class Subtree(InputPartition):
    """Folders one task reads: ``(root, folder, whether to descend, share, shares)``.

    A folder dealt to several tasks is listed by each, which takes the files of its share.
    """

    def __init__(self, folders: list[tuple[str, str, bool, int, int]]):
        super().__init__(None)
        self.folders = folders


class TreeSource(DataSource):
    """Batch source of tree rows."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        with_content = self.options.get("content", "false").lower() == "true"
        return SCHEMA + (", content binary" if with_content else "")

    def reader(self, schema: StructType) -> DataSourceReader:
        pushes = self.options.get("pushdown", "false").lower() == "true"
        return BatchedFilteredTreeReader(self.options) if pushes else BatchedTreeReader(self.options)


class TreeReader(DataSourceReader):
    """Splits the tree into subtrees and walks each in its task; excluded folders are never listed."""

    def __init__(self, options):
        self.roots = [os.path.abspath(p) for p in options["path"].split("\n") if p.strip()]
        self.repos = repo_names(self.roots)
        self.with_content = options.get("content", "false").lower() == "true"
        self.max_size = float(options.get("max_file_mb", lookups.MAX_FILE_MB)) * 1024 * 1024
        self.min_partitions = int(options.get("min_partitions", "64"))
        self.split_files = max(1, int(options.get("split_files", "1000")))
        self.filters: list[ds.Filter] = []
        for root in self.roots:
            if not os.path.exists(root):
                raise ValueError(f"Directory does not exist: {root}")
            if not os.path.isdir(root):
                raise ValueError(f"Path is not a directory: {root}")
            if not os.access(root, os.R_OK | os.X_OK):
                raise ValueError(f"Permission denied: {root}")

    def partitions(self) -> list[InputPartition]:
        """Widen the frontier level by level until there are enough subtrees.

        A folder listed on the way that holds many files is dealt to several tasks, at most
        ``min_partitions``, so that listing it again stays cheap beside reading it.
        """
        frontier = [(root, root) for root in self.roots]
        shallow: list[tuple[str, str, bool, int, int]] = []
        while frontier and len(frontier) < self.min_partitions:
            deeper = []
            for root, folder in frontier:
                n_others = 0
                try:
                    with os.scandir(folder) as entries:
                        for e in entries:
                            if not _is_dir(e):
                                n_others += 1
                            elif not _skips_dir(e.name):
                                deeper.append((root, e.path))
                except OSError:
                    pass  # the task that reads this folder reports it
                shares = max(1, min(self.min_partitions, -(-n_others // self.split_files)))
                shallow += [(root, folder, False, i, shares) for i in range(shares)]
            frontier = sorted(deeper)
        whole = [(root, folder, True, 0, 1) for root, folder in frontier]
        work = whole + shallow
        n = max(1, min(len(work), max(self.min_partitions, len(whole))))
        return [Subtree(work[i::n]) for i in range(n)]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        for root, folder, descend, share, shares in partition.folders:
            pending = [folder]
            while pending:
                yield from self._folder(root, pending.pop(), pending if descend else None, share, shares)

    def _kept(self, kind, root, path, size=None) -> bool:
        """Do the filters pushed down keep a row of these facts?"""
        if not self.filters:
            return True
        facts = {
            "kind": kind, "repo": self.repos[root], "path": path, "relative_path": os.path.relpath(path, root),
            "name": os.path.basename(path), "size": size,
        }
        return all(holds(f, facts) for f in self.filters)

    def _row(self, kind, root, path, size=None, modified=None, error=None, content=None) -> tuple:
        relative = os.path.relpath(path, root)
        row = (kind, self.repos[root], path, relative, os.path.basename(path), size, modified, error)
        return row + (content,) if self.with_content else row

    def _folder(self, root: str, folder: str, pending: list | None, share: int = 0, shares: int = 1) -> Iterator[tuple]:
        if share == 0 and self._kept("dir", root, folder):
            yield self._row("dir", root, folder)
        try:
            with os.scandir(folder) as listing:
                entries = list(listing)
        except OSError as error:
            if share == 0 and self._kept("error", root, folder):
                yield self._row("error", root, folder, error=f"Permission denied: {error}")
            return
        for entry in entries:
            if _is_dir(entry):
                if pending is not None and not _skips_dir(entry.name):
                    pending.append(entry.path)
                continue
            if zlib.crc32(os.fsencode(entry.name)) % shares != share:
                continue
            if not _is_file(entry) or _skips_file(entry.name):
                continue
            try:
                facts = entry.stat()
                if not st.S_ISREG(facts.st_mode) or facts.st_size > self.max_size:
                    continue
                if not self._kept("file", root, entry.path, facts.st_size):
                    continue
                content = None
                if self.with_content:
                    with open(entry.path, "rb") as handle:
                        content = handle.read()
                modified = datetime.fromtimestamp(facts.st_mtime, tz=timezone.utc)
                yield self._row("file", root, entry.path, facts.st_size, modified, content=content)
            except OSError as error:
                if self._kept("error", root, entry.path):
                    yield self._row("error", root, entry.path, error=str(error))


class FilteredTreeReader(TreeReader):
    """Takes the filters it can decide from a row's facts; files they drop are not opened."""

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for condition in filters:
            if pushable(condition):
                self.filters.append(condition)
            else:
                yield condition


class InBatches:
    """Hands a reader's rows on in batches of about ``PART`` bytes; Spark's own batches count rows, whatever files hold."""

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        kinds = KINDS if self.with_content else KINDS[:-1]
        part, size = [], 0
        for row in super().read(partition):
            part.append(row)
            size += ROW + (len(row[-1] or b"") if self.with_content else 0)
            if size >= PART:
                yield _batch(part, kinds)
                part, size = [], 0
        if part:
            yield _batch(part, kinds)


class BatchedTreeReader(InBatches, TreeReader):
    pass


class BatchedFilteredTreeReader(InBatches, FilteredTreeReader):
    pass


def read_tree(spark: SparkSession, roots: list[str], content: bool = False, pushdown: bool = False, **options) -> DataFrame:
    """Rows of the trees; with ``pushdown``, if the session's settings allow it, filters reach the walk.

    Spark keeps the reader that took the filters with the DataFrame, so one read so may serve one query only.
    """
    spark.dataSource.register(TreeSource)
    pushes = str(pushdown and spark.conf.get(PUSHDOWN, "false") == "true").lower()
    reader = spark.read.format("source_tree").option("path", "\n".join(roots)).option("content", str(content).lower())
    return reader.option("pushdown", pushes).options(**options).load()


def repo_names(roots: list[str]) -> dict[str, str]:
    """A name per root folder: its last part, or as many parts as tell it from the other roots."""
    names = {}
    for root in roots:
        parts = root.strip("/").split("/")
        ends = ["/".join(parts[-n:]) for n in range(1, len(parts) + 1)]
        others = [f"/{r.strip('/')}" for r in roots if r != root]
        names[root] = next((e for e in ends if not any(o.endswith(f"/{e}") for o in others)), root)
    return names


def files(tree: DataFrame) -> DataFrame:
    """File rows."""
    return tree.filter("kind = 'file'").drop("kind", "error")


def directories(tree: DataFrame) -> DataFrame:
    """Folder rows; the root is ``.``."""
    return tree.filter("kind = 'dir'").select("repo", "path", F.col("relative_path").alias("directory"), "name")


def scan_errors(tree: DataFrame) -> DataFrame:
    """Error rows."""
    return tree.filter("kind = 'error'").select("repo", "path", "error")


def decoded(file_rows: DataFrame) -> DataFrame:
    """Content as text, bad bytes replaced, with line ends made uniform."""
    return file_rows.withColumn("content", F.regexp_replace(decode(F.col("content")), "\r\n?", "\n"))
