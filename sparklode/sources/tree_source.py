"""Data sources over files that executors see: a folder tree with one partition a range of folders, and a search of large files by chunks.

``tree``: a row for every file and folder. Folders are listed breadth-first on the driver until there are enough of them for the
partitions; the executors walk what lies below. Links are rows, and aren't followed. A folder that is found again below itself, by device
and inode, isn't entered, and one that can't be listed is a row with ``listed`` false (a hole). Filters on ``path`` (equal to, one of,
starts with) choose where the walk begins, where the session allows filters in Python sources.

``chunks``: files cut into pieces of a fixed size, each read with as many more bytes as a literal that starts in it may need; a match is
counted in the piece it starts in. No file is ever held whole.
"""

from __future__ import annotations

import os
import stat
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from sparklode.functions import paths

TREE = "path string, parent string, name string, is_dir boolean, is_link boolean, size long, modified timestamp, changed timestamp, hidden boolean, device long, inode long, listed boolean"
CHUNK = "path string, start long, n long"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def local_path(uri: str) -> str:
    """The path of a file: URI, or the path itself."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"not a folder of a mounted file system: {uri}")
    path = unquote(parts.path) if parts.scheme else uri
    return path.rstrip("/") or "/"


@dataclass
class Folders(InputPartition):
    """Folders to walk: (path, identities of the folders above it); and rows that the driver has seen already."""

    roots: list[tuple[str, tuple[tuple[int, int], ...]]]
    rows: list[tuple]


def _row(path: str, listed: bool | None, info: os.stat_result | None = None) -> tuple | None:
    try:
        info = info or os.lstat(path)
    except OSError:
        return None
    name = path.rsplit("/", 1)[-1]
    when = lambda t: datetime.fromtimestamp(t, timezone.utc)
    is_dir = stat.S_ISDIR(info.st_mode)
    return (path, os.path.dirname(path), name, is_dir, stat.S_ISLNK(info.st_mode), 0 if is_dir else info.st_size, when(info.st_mtime), when(info.st_ctime), name.startswith("."), info.st_dev, info.st_ino, listed if is_dir else None)


def _listed(path: str, above: tuple[tuple[int, int], ...]) -> tuple[tuple | None, list[tuple], list[tuple[str, tuple[tuple[int, int], ...]]]]:
    """(row of the folder, rows of its files, folders in it)."""
    try:
        info = os.lstat(path)
    except OSError:
        return None, [], []
    me = (info.st_dev, info.st_ino)
    if not stat.S_ISDIR(info.st_mode):
        return _row(path, None, info), [], []
    if me in above:
        return _row(path, False, info), [], []
    try:
        with os.scandir(path) as entries:
            names = sorted((e.name, e.is_dir(follow_symlinks=False)) for e in entries)
    except OSError:
        return _row(path, False, info), [], []
    inside = lambda name: f"{path.rstrip('/')}/{name}"
    files = [r for name, is_dir in names if not is_dir and (r := _row(inside(name), None)) is not None]
    return _row(path, True, info), files, [(inside(name), (*above, me)) for name, is_dir in names if is_dir]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots = [local_path(p) for p in options["path"].split("\n")]
        self.least = int(options.get("folders", "64"))

    def partitions(self) -> list[Folders]:
        queue, rows = deque((r, ()) for r in self.roots), []
        while queue and len(queue) < self.least:
            path, above = queue.popleft()
            me, files, folders = _listed(path, above)
            rows += [r for r in (me, *files) if r is not None]
            queue.extend(folders)
        # Neighbours in the order of paths go together.
        left = sorted(queue)
        each = max(1, -(-len(left) // self.least))
        return [Folders([], rows), *(Folders(left[k : k + each], []) for k in range(0, len(left), each))]

    def read(self, partition: Folders) -> Iterator[tuple]:
        yield from partition.rows
        stack = list(partition.roots)
        while stack:
            me, files, folders = _listed(*stack.pop())
            if me is not None:
                yield me
            yield from files
            stack.extend(folders)


class PushingTreeReader(TreeReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Roots of the walk from filters on the path; Spark tests all filters again, as a walk takes what is below as well."""
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith) and f.attribute == ("path",):
                wanted = list(f.value) if isinstance(f, In) else [f.value]
                if isinstance(f, StringStartsWith):
                    wanted = [f.value.rstrip("/") if f.value.endswith("/") else os.path.dirname(f.value)]
                inside = [w for w in wanted if any(_under(w, r) for r in self.roots)]
                self.roots = sorted({*inside, *(r for r in self.roots if any(_under(r, w) for w in wanted))} - {""})
            yield f


def _under(path: str, root: str) -> bool:
    return path == root or path.startswith(root.rstrip("/") + "/")


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return TREE

    def reader(self, schema) -> DataSourceReader:
        return (PushingTreeReader if self.options.get("push") == "true" else TreeReader)(dict(self.options))


def tree(spark: SparkSession, roots: list[str], folders: int = 64) -> DataFrame:
    """Rows of everything at and below ``roots``, each path once."""
    spark.dataSource.register(TreeSource)
    push = str(spark.conf.get(PUSHDOWN, "false")).lower()
    return spark.read.format("tree").option("path", "\n".join(roots)).option("folders", str(folders)).option("push", push).load()


def holes(rows: DataFrame) -> DataFrame:
    """(hole): folders that couldn't be listed."""
    return rows.filter("is_dir AND NOT listed").select(F.col("path").alias("hole"))


def identities(rows: DataFrame) -> DataFrame:
    """(device, inode, path, aliases) of files: names of one file are one row, under the first of them."""
    files = rows.filter("NOT is_dir AND NOT is_link")
    return files.groupBy("device", "inode").agg(F.min("path").alias("path"), (F.count("*") - 1).alias("aliases"))


def as_files(rows: DataFrame) -> DataFrame:
    """Tree rows as a table of files for searches; ids by path."""
    p = F.col("path")
    return rows.select(
        F.xxhash64("path").alias("node_id"), "path", "name", "is_dir", "size", "modified", F.col("changed").alias("created"), paths.is_hidden(p).alias("hidden"), paths.in_package(p).alias("in_package"),
        F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("text"),
    )


def look(spark: SparkSession, columns: list[str], row: Column | None = None):
    """What a live index needs to look at the folders here again: found rows (``columns`` of the tree) and holes for the work of a batch.

    The roots of a batch's work are read on the driver: they are what a batch of events names after subtrees took in what lies below.
    """

    def at(work: DataFrame) -> tuple[DataFrame, DataFrame]:
        wanted = work.select("kind", "path").collect()
        deep = [r["path"] for r in wanted if r["kind"] == "subtree"]
        walked = tree(spark, deep) if deep else spark.createDataFrame([], TREE)
        roots = work.filter("kind = 'subtree'").select(F.col("path").alias("root"))
        inside = walked.select("*", F.explode(paths.ancestors(F.col("path"))).alias("root")).join(roots, "root")
        found = inside.select("root", F.lit(True).alias("present"), F.lit(True).alias("is_complete"), *columns)
        single = work.filter("kind = 'exact'").select(F.col("path").alias("root"))
        here = single.join(tree_rows(single, "root"), "root", "left")
        found = found.unionByName(here.select("root", F.coalesce("present", F.lit(False)).alias("present"), F.coalesce("is_complete", F.lit(True)).alias("is_complete"), *(F.col("root").alias(c) if c == "path" else F.col(c) for c in columns)))
        return found, inside.filter("is_dir AND NOT listed").select("root", F.col("path").alias("hole"))

    return at


def tree_rows(paths_of: DataFrame, column: str) -> DataFrame:
    """(column, present, is_complete, tree columns) of single paths, looked at where the rows are; what may not be looked at is incomplete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p in b.column(0).to_pylist():
                try:
                    out.append((p, True, True, *_row(p, True, os.lstat(p))))
                except (FileNotFoundError, NotADirectoryError):
                    out.append((p, False, True, *[None] * len(names[3:])))
                except OSError:
                    out.append((p, False, False, *[None] * len(names[3:])))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], arrow)

    names = [column, "present", "is_complete", *(c.split()[0] for c in TREE.split(", "))]
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64(), "timestamp": pa.timestamp("us", "UTC")}
    arrow = pa.schema([(column, pa.string()), ("present", pa.bool_()), ("is_complete", pa.bool_()), *((c.split()[0], kinds[c.split()[1]]) for c in TREE.split(", "))])
    return paths_of.select(column).distinct().mapInArrow(run, f"{column} string, present boolean, is_complete boolean, {TREE}")


# ---------------------------------------------------------------- large files

@dataclass
class Piece(InputPartition):
    path: str
    starts: list[int]


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.needle, self.size = options["path"], options["needle"].encode(), int(options.get("chunk", str(1 << 20)))
        self.per_task = int(options.get("chunks", "64"))
        if not self.needle or self.size < 1:
            raise ValueError("an empty literal, or a chunk without bytes")

    def partitions(self) -> list[Piece]:
        system, at = arrow_fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (arrow_fs.LocalFileSystem(), self.path)
        info = system.get_file_info(at)
        files = [info] if info.type == arrow_fs.FileType.File else [f for f in system.get_file_info(arrow_fs.FileSelector(at, recursive=True)) if f.type == arrow_fs.FileType.File]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if not f.base_name.startswith((".", "_")):
                starts = list(range(0, f.size or 0, self.size))
                out += [Piece(f.path, starts[k : k + self.per_task]) for k in range(0, len(starts), self.per_task)]
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        system = arrow_fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else arrow_fs.LocalFileSystem()
        more = len(self.needle) - 1
        with system.open_input_file(partition.path) as f:
            for start in partition.starts:
                f.seek(start)
                yield partition.path, start, hits(f.read(self.size + more).lower(), self.needle.lower(), self.size)


def hits(data: bytes, needle: bytes, size: int) -> int:
    """Places before ``size`` where the needle starts."""
    n, at = 0, data.find(needle)
    while 0 <= at < size:
        n += 1
        at = data.find(needle, at + 1)
    return n


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunks"

    def schema(self) -> str:
        return CHUNK

    def reader(self, schema) -> DataSourceReader:
        return ChunkReader(dict(self.options))


def literal_hits(spark: SparkSession, path: str, needle: str, chunk: int = 1 << 20) -> DataFrame:
    """(path, n) of the files at or below ``path`` that hold an ASCII literal, in any case of its letters; n: at how many places."""
    if not needle.isascii():
        raise ValueError("chunks are searched for ASCII literals")
    spark.dataSource.register(ChunkSource)
    rows = spark.read.format("chunks").option("path", path).option("needle", needle).option("chunk", str(chunk)).load()
    return rows.groupBy("path").agg(F.sum("n").alias("n")).filter("n > 0")
