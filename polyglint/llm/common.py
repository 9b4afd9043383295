"""Shared helpers: materialised intermediate tables and stable hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import threading
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK = os.path.join(tempfile.gettempdir(), f"polyglint-{os.getpid()}")

#: Words that one worker's memo holds (some 200 bytes each) before it starts afresh.
MEMO_ENTRIES = 1_000_000

#: Words in the memo of an operator that hashes a word in less than a microsecond.
HASH_ENTRIES = 250_000

#: Rows that a broadcast side may have (some 20 MB of two or three numbers each); larger sides are joined by shuffle.
BROADCAST_ROWS = 500_000

#: Tasks that files are dealt to at most; beyond that a task reads several, one after the other.
MOST_TASKS = 20_000

#: White space of the word rule `[^\x20\x09-\x0D]+`, as a regular expression for the JVM and for DuckDB.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where that is unset and Spark runs in one process (tests)."""
    if folder := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return folder
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return f"file://{_FALLBACK}"
    raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/polyglint/{name}-{uuid.uuid4().hex}"


#: Removes the shuffle files of a query when it ends; else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITES, _LOCK = Counter(), threading.Lock()
#: For each `passing` block that is open, the tables written in it.
_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


@contextlib.contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """_CLEANUP holds as long as a write of this session runs, in whatever thread."""
    key = id(spark)
    with _LOCK:
        _WRITES[key] += 1
        if _WRITES[key] == 1:
            spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            _WRITES[key] -= 1
            if not _WRITES[key]:
                spark.conf.unset(_CLEANUP)


def written(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back: lineage ends there and lost executors cost nothing.

    The shuffle files of the write go with it. A `lasting` table outlives the `passing` block in which it is written.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    blocks = _PASSING.get()
    if len(blocks) > lasting:
        blocks[-1 - lasting].append(path)
    with _cleaning(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are `written` inside are deleted at its end but for lasting ones, so nothing lazy may lead back to them then. The driver gives its garbage back."""
    own: list[str] = []
    token = _PASSING.set((*_PASSING.get(), own))
    try:
        yield
    finally:
        _PASSING.reset(token)
        for path in own:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        relieve(spark)


_MEMOS: dict[str, object] = {}
_Memo = TypeVar("_Memo")


def _trim() -> None:
    """Memory of this Python process that is free goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def memo(name: str, make: Callable[[], _Memo]) -> _Memo:
    """The worker's memo of this name. Workers are used again by later operators, so those of other names are dropped and their memory given back."""
    if name not in _MEMOS:
        _MEMOS.clear()
        _trim()
        _MEMOS[name] = make()
    return _MEMOS[name]


def relieve(spark: SparkSession) -> None:
    """The driver's two processes collect their garbage and give it back: plans, results and generated code of what ended."""
    _trim()
    spark._jvm.System.gc()


def give_back(spark: SparkSession) -> None:
    """Executors and the driver collect their garbage and give free heap back to the system, where their Python processes need it.

    By itself a heap keeps the size that the largest operator so far needed, and classes of generated code pile up.
    A short task for each core; an executor whose cores are all busy may be passed over.
    """
    cores = max(1, spark.sparkContext.defaultParallelism)
    spark.range(cores, numPartitions=cores).select(F.expr("java_method('java.lang.System', 'gc')")).collect()
    relieve(spark)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of few narrow columns, marked for broadcast if it has been counted and has at most `rows` rows; else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def crc32_mod(column: Column | str, modulus: int) -> Column:
    """crc32 of an integer id's decimal text, modulo `modulus`; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")) if isinstance(column, str) else F.crc32(column.cast("string").cast("binary")), F.lit(modulus))


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or with underscores after it, such that `df` has no such column."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name
