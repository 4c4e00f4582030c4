"""The ``files`` table: root string, path string, length bigint, content string.

``path`` starts with the name of its root, so that ignore rules see the corpus and not the
place where it happens to be mounted.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text
from ..session import stored

#: Directories or files of a task at most, roughly; bytes of a task, and of an Arrow batch that it hands over.
LISTED, TASK_BYTES, HELD_BYTES = 5_000, 64 << 20, 8 << 20
FILES_SCHEMA = "root string, path string, length bigint, content string"


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """A files table from parquet.  Several inputs are read as one."""
    return spark.read.schema(FILES_SCHEMA).parquet(*paths)


def list_tree(spark: SparkSession, directory: str) -> DataFrame:
    """(rel, length) of every file below a directory, whatever its name begins with.

    Spark's own file sources leave out names that begin with `_` or `.`, so directories are listed by
    tasks, a level of the tree at a time: the directories that a level holds are the rows of the next
    one.  Each level is written, so a lost executor costs the level; the driver sees no names.  Links to
    directories are not followed, special files and unreadable directories have no rows.
    """
    where = _place(directory)

    def entries(files, base: str, rel: str):
        """(name, is_dir, length) of one directory."""
        if isinstance(files, fs.LocalFileSystem):
            with os.scandir(f"{base}/{rel}") as found:
                for e in found:
                    if e.is_dir(follow_symlinks=False) or e.is_file():
                        yield e.name, e.is_dir(follow_symlinks=False), e.stat(follow_symlinks=e.is_file()).st_size
                    elif e.is_symlink() and not e.is_dir():                  # leads nowhere: a file that can't be read
                        yield e.name, False, 0
        else:
            for e in files.get_file_info(fs.FileSelector(f"{base}/{rel}".rstrip("/"))):
                if e.type in (fs.FileType.File, fs.FileType.Directory):
                    yield e.base_name, e.type == fs.FileType.Directory, e.size or 0

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(where)
        for batch in batches:
            for rel in batch.column("rel").to_pylist():
                held = []
                try:
                    for name, is_dir, length in entries(files, base, rel):
                        name = name.encode("utf-8", "replace").decode()
                        held.append((f"{rel}/{name}" if rel else name, is_dir, length))
                except OSError:
                    pass
                for a in range(0, len(held), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held[a:a + 10_000]), (pa.string(), pa.bool_(), pa.int64()))],
                                                     ["rel", "is_dir", "length"])

    level = spark.createDataFrame([("",)], "rel string")
    levels, many = [], 1
    while many:
        dealt = level.repartition(max(1, min(many, spark.sparkContext.defaultParallelism), many // LISTED), "rel")
        entered = stored(dealt.mapInArrow(listing, "rel string, is_dir boolean, length bigint"), "tree-level")
        levels.append(entered.where("NOT is_dir").select("rel", "length"))
        level = entered.where("is_dir").select("rel")
        many = level.count()
    return union_roots(*levels)


def read_tree(spark: SparkSession, directory: str, max_bytes: int | None = None) -> DataFrame:
    """A files table from one raw directory tree, which all executors reach by the same path or URI (of a
    file system that pyarrow knows).  Every name counts, see ``list_tree``.  A file that can't be read
    is a row with a null content; files larger than ``max_bytes`` are left out unread (no limit by
    default).  Files are dealt to tasks by their number and bytes."""
    where = _place(directory)
    root = where.rstrip("/").rpartition("/")[2]
    found = list_tree(spark, directory)
    found = found if max_bytes is None else found.where(F.col("length") <= max_bytes)
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(size.n, spark.sparkContext.defaultParallelism), size.n // LISTED, size.bytes // TASK_BYTES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(where)
        for batch in batches:
            start, held, total = 0, [], 0
            for i, rel in enumerate(batch.column("rel").to_pylist()):
                try:
                    with files.open_input_stream(f"{base.rstrip('/')}/{rel}", compression=None) as stream:
                        held.append(stream.read())
                except OSError:
                    held.append(None)
                total += len(held[-1] or b"")
                if total >= HELD_BYTES or i + 1 == len(batch):
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, i + 1 - start).columns, pa.array(held, pa.binary())], ["rel", "length", "raw"])
                    start, held, total = i + 1, [], 0

    raw = found.repartition(tasks, "rel").mapInArrow(read, "rel string, length bigint, raw binary")
    return raw.select(F.lit(root).alias("root"), F.concat(F.lit(f"{root}/"), "rel").alias("path"), "length", text.decode_text(F.col("raw")).alias("content"))


def _place(directory: str) -> str:
    return directory if "://" in directory or directory.startswith("file:") else os.path.abspath(directory)


def union_roots(*files: DataFrame) -> DataFrame:
    """Files of several roots in one table; every job keeps the roots apart."""
    result = files[0]
    for other in files[1:]:
        result = result.unionByName(other)
    return result


def expand_roots(files: DataFrame) -> DataFrame:
    """Make every immediate sub-directory of each root a root of its own.  Files that lie
    directly in a root belong to none of them."""
    parts = F.split("path", "/")
    return (files.where(F.size(parts) > 2)
            .withColumn("root", F.get(parts, F.lit(1)))
            .withColumn("path", F.expr("substring(path, locate('/', path) + 1)")))


def root_names(files: DataFrame) -> DataFrame:
    """The immediate sub-directories, each once."""
    return expand_roots(files).select("root").distinct()
