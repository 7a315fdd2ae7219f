"""File trees as DataFrames."""

from __future__ import annotations

import os
import stat
import time
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lumenquarry.functions.globs import IgnoreRules
from lumenquarry.schema import WALK

IGNORE_FILES = (".gitignore", ".lumenignore")
INDEX_DIR = ".lumenquarry"


#: Tasks that a walk is split into, if the tree has as many folders; folders that the driver lists to find them, for each of those.
TASKS, LISTED = 64, 4


@lru_cache(maxsize=4096)
def _compiled(text: str) -> IgnoreRules:
    return IgnoreRules(text)


class _Folders(InputPartition):
    """Folders of one task: with everything below (deep), or only the files in them. since: no row that hasn't changed after it, until: none that has changed later."""

    def __init__(self, folders: list[tuple[str, bool]], since: int | None = None, until: int | None = None):
        super().__init__(folders)
        self.folders, self.since, self.until = folders, since, until


class _Walker:
    """The tree is split breadth-first: folders are opened from the root down until there are enough of them to deal out."""

    def __init__(self, options: dict[str, str]):
        self.root = os.path.abspath(options["path"])
        self.real = os.path.realpath(self.root)
        flag = lambda name, default: options.get(name, default).lower() == "true"
        self.hidden, self.links, self.rules = flag("hidden", "true"), flag("followsymlinks", "true"), flag("ignorefiles", "true")
        self.tasks = int(options.get("tasks", TASKS))

    def split(self) -> list[list[tuple[str, bool]]]:
        """Lists of (folder, deep): each folder of the tree is in just one of them."""
        opened, waiting = [], deque([(self.root, self._texts(self.root), frozenset())])
        while waiting and len(waiting) < self.tasks and len(opened) < LISTED * self.tasks:
            folder, texts, above = waiting.popleft()
            opened.append(folder)
            for path, is_folder, _, inner, chain in self._entries(folder, texts, above):
                if is_folder:
                    waiting.append((path, inner, chain))
        parts = [[(f, True)] for f, _, _ in waiting]
        size = max(1, -(-len(opened) // self.tasks))
        return parts + [[(f, False) for f in opened[i : i + size]] for i in range(0, len(opened), size)]

    def rows(self, part: _Folders) -> Iterator[tuple]:
        for folder, deep in part.folders:
            texts, above, here = self._texts(self.root), set(), self.root
            for name in os.path.relpath(folder, self.root).split(os.sep) if folder != self.root else ():
                try:
                    info = os.stat(here)
                    above.add((info.st_dev, info.st_ino))
                except OSError:
                    pass
                here = os.path.join(here, name)
                texts = texts + self._texts(here)
            for row in self._below(folder, texts, frozenset(above), deep):
                if part.since is None or part.since < max(row[3], row[4]) <= part.until:
                    yield row

    def _texts(self, folder: str) -> list[tuple[str, str]]:
        out = []
        for name in IGNORE_FILES if self.rules else ():
            try:
                with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                    out.append((folder, f.read()))
            except OSError:
                pass
        return out

    @staticmethod
    def _ignored(path: str, texts: list[tuple[str, str]]) -> bool:
        out = False
        for folder, text in texts:  # the nearest folder decides, and of its files the later one
            rel = os.path.relpath(path, folder) + ("/" if path.endswith("/") else "")
            for keep, pattern in _compiled(text).rules:
                if pattern.match(rel) or (rel.endswith("/") and pattern.match(rel + "x")):
                    out = not keep
        return out

    def _entries(self, folder: str, texts: list, above: frozenset) -> Iterator[tuple]:
        """(path, is a folder, stat, ignore files that hold below, folders above it) of what a folder holds, without what is left out."""
        try:
            own = os.stat(folder)
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return  # an unreadable folder is left out
        above = above | {(own.st_dev, own.st_ino)}
        for e in entries:
            try:
                is_folder, info = e.is_dir(follow_symlinks=self.links), e.stat(follow_symlinks=self.links)
            except OSError:
                continue
            if e.name == INDEX_DIR or (not self.hidden and e.name.startswith(".")) or self._ignored(e.path + "/" * is_folder, texts):
                continue
            if self.links and e.is_symlink() and not os.path.realpath(e.path).startswith(self.real + os.sep):
                continue  # a link out of the tree, or to the tree itself
            if is_folder and (info.st_dev, info.st_ino) in above:
                continue  # a link that leads back
            yield e.path, is_folder, info, texts + self._texts(e.path) if is_folder else texts, above

    def _below(self, folder: str, texts: list, above: frozenset, deep: bool) -> Iterator[tuple]:
        if folder != self.root:
            try:
                yield self._row(folder, os.stat(folder), True)
            except OSError:
                return
        stack = [self._entries(folder, texts, above)]
        while stack:
            entry = next(stack[-1], None)
            if entry is None:
                stack.pop()
                continue
            path, is_folder, info, inner, chain = entry
            if is_folder and deep:
                yield self._row(path, info, True)
                stack.append(self._entries(path, inner, chain))
            elif not is_folder and stat.S_ISREG(info.st_mode):
                yield self._row(path, info, False)

    def _row(self, path: str, info: os.stat_result, folder: bool) -> tuple:
        raw = os.path.relpath(os.fsencode(path), os.fsencode(self.root))
        return (raw.decode("utf-8", "replace"), raw, info.st_size, info.st_mtime_ns, info.st_ctime_ns, info.st_ino, info.st_dev, info.st_mode, info.st_uid, info.st_gid, folder)


class _WalkReader(_Walker, DataSourceReader):
    def partitions(self) -> list[_Folders]:
        return [_Folders(p) for p in self.split()]

    def read(self, part: _Folders) -> Iterator[tuple]:
        yield from self.rows(part)


class _WalkStream(_Walker, DataSourceStreamReader):
    """What has changed since the last batch. An offset is a moment; a batch is what was written, or changed otherwise, between two of them.

    A moment is `lagMs` old when it is taken, so that a file changed in it is seen as it is after it.
    Deletions leave no file that could be read: a reconciling run finds them.
    """

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.lag = int(float(options.get("lagms", "1000")) * 1_000_000)

    def initialOffset(self) -> dict:
        return {"ns": 0}

    def latestOffset(self) -> dict:
        return {"ns": time.time_ns() - self.lag}

    def partitions(self, start: dict, end: dict) -> list[_Folders]:
        return [_Folders(p, start["ns"], end["ns"]) for p in self.split()]

    def read(self, part: _Folders) -> Iterator[tuple]:
        yield from self.rows(part)

    def commit(self, end: dict) -> None:
        pass


class WalkSource(DataSource):
    """format("walk"): files and folders below `path`, with what stat() says; as a stream, those that changed. Options: hidden, followSymlinks, ignoreFiles, tasks, lagMs."""

    @classmethod
    def name(cls) -> str:
        return "walk"

    def schema(self):
        return WALK

    def reader(self, schema) -> DataSourceReader:
        return _WalkReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _WalkStream(dict(self.options))


def walk(spark: SparkSession, root: str, hidden: bool = True, follow_symlinks: bool = True, ignore_files: bool = True) -> DataFrame:
    """A tree that every executor can see, without reading contents."""
    spark.dataSource.register(WalkSource)
    return spark.read.format("walk").option("hidden", str(hidden)).option("followSymlinks", str(follow_symlinks)).option("ignoreFiles", str(ignore_files)).load(root)


def walk_stream(spark: SparkSession, root: str, lag_ms: int = 1000) -> DataFrame:
    """What changes in a tree, batch by batch: the first holds everything."""
    spark.dataSource.register(WalkSource)
    return spark.readStream.format("walk").option("lagMs", lag_ms).load(root)


def contents(spark: SparkSession, root: str, max_size: int = 2 * 2**30) -> DataFrame:
    """(path, size, mtime_ns, content) by Spark's own reader, from any store that it knows; bytes are read only where content is selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= max_size)
    prefix = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = prefix.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(prefix).toString().rstrip("/") + "/"
    return files.select(F.replace("path", F.lit(base), F.lit("")).alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content")


def with_contents(files: DataFrame, root: str, path: str = "path") -> DataFrame:
    """Adds `content`, null where a file can't be read: for trees that executors see, hidden files and odd names included."""
    from collections.abc import Iterator as It

    import pyarrow as pa

    def run(batches: It[pa.RecordBatch]) -> It[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one file at a time in memory
                one = batch.slice(i, 1)
                try:
                    with open(os.path.join(root, one.column(path)[0].as_py()), "rb") as f:
                        raw = f.read()
                except OSError:
                    raw = None
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([raw], pa.binary())], names=[*one.schema.names, "content"])

    from pyspark.sql.types import BinaryType, StructField, StructType

    return files.mapInArrow(run, StructType([*files.schema.fields, StructField("content", BinaryType())]))
