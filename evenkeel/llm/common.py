"""What the corpus operators share: column picking, Arrow batches, hashing of ids, checkpoints."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ship

#: White space of the contracts: space and the five ASCII controls from tab to carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def position(names: list[str], wanted: str) -> int:
    """Which column is meant: one of that very name, else one that differs in case only."""
    at = [i for i, n in enumerate(names) if n == wanted] or [i for i, n in enumerate(names) if n.lower() == wanted.lower()]
    if not at:
        raise ValueError(f"no column {wanted!r} among {names}")
    return at[0]


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """The wanted columns under new names, found by exact name first, then ignoring case.

    Works by position, so other columns may clash in any way (repeated names, names that
    differ in case only, names that an operator uses itself).
    """
    ship(df.sparkSession)
    names = df.columns
    flat = df.toDF(*[f"_{i}" for i in range(len(names))])
    return flat.select(*[F.col(f"_{position(names, old)}").alias(new) for new, old in wanted.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: Column, parts: int) -> Column:
    """crc32 of an id written as text, modulo parts; null ids give null."""
    return F.crc32(column.cast("string").cast("binary")) % parts


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a folder of its own only where that is unset (tests)."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), f"evenkeel-{os.getuid()}-{os.getpid()}")


_made: list[str] = []


def new_folder(spark: SparkSession, what: str) -> str:
    """A folder of its own in the shared one, for as long as the application lives (see `release`)."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def release() -> None:
    """Deletes what the operators have written for themselves so far. Results not yet read are lost with it."""
    jvm, session = SparkContext._jvm, SparkSession.getActiveSession()
    if jvm is None:
        return
    conf = session.sparkContext._jsc.hadoopConfiguration() if session else jvm.org.apache.hadoop.conf.Configuration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _release_at_end() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        release()


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there and survives lost executors.

    Columns are written by position, so names may clash in any way.
    """
    path = new_folder(df.sparkSession, what)
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    flat.write.parquet(path)
    return df.sparkSession.read.schema(flat.schema).parquet(path).toDF(*df.columns)


#: Logical operators under which a second reading gives the same rows in the same tasks.
STEADY = {"LogicalRelation", "LocalRelation", "LogicalRDD", "Project", "Filter", "Union", "SubqueryAlias", "LocalLimit"}


def steady(df: DataFrame) -> bool:
    """Whether a second reading numbers the same rows alike: stored tables and what is taken from them row by row."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() not in STEADY or not node.deterministic():
            return False
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return True


def settled(df: DataFrame, what: str = "rows") -> DataFrame:
    """df itself where it can be read twice alike, else df written out: operators match rows by their numbers."""
    return df if steady(df) else cut(df, what)


def match_rows(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs (settled) joined by how (left_semi or left_anti) to rows (column row), with the columns of docs, whatever their names."""
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("own_row", F.monotonically_increasing_id())
    kept = flat.join(rows.select("row"), F.col("own_row") == F.col("row"), how).drop("own_row")
    return kept.toDF(*names)


#: Rows of a batch that are turned into Python objects at a time.
BATCH_ROWS = 1000


def give_back() -> None:
    """Returns freed memory to the system, where that can be done: Spark's Python workers live on after a task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not with every C library
        ctypes.CDLL(None).malloc_trim(0)


def lean(work):
    """`work` for mapInArrow, with batches of at most BATCH_ROWS rows, and its memory given back at the end."""

    def run(batches):
        yield from work(b.slice(i, BATCH_ROWS) for b in batches for i in range(0, b.num_rows, BATCH_ROWS))
        give_back()

    return run


def binaries(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def by_size(items: list, most: int):
    """Slices (start, end) of items of at most `most` bytes or characters each, one item at least."""
    start = total = 0
    for i, x in enumerate(items):
        if total and total + len(x) > most:
            yield start, i
            start, total = i, 0
        total += len(x)
    if start < len(items):
        yield start, len(items)


def merge_runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open runs, merged where they overlap or touch, in ascending order."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.ones(len(start), bool)
    first[1:] = start[1:] > end[:-1]
    last = np.append(first[1:], True)
    return start[first], end[last]
