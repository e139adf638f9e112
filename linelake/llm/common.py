"""What the operators share: reading tables, staging results, keys of rows, word patterns."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Rows sent to Python at once, at most.
BATCH = 1_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_OWN: dict[str, str] = {}
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir``. Where it is unset, one of our own in local mode; on a cluster that is an error."""
    base, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if base:
        return base
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='linelake-')}"
    return _OWN[context.applicationId]


def bound_batches(spark: SparkSession, rows: int = BATCH) -> None:
    """From now on the session sends at most so many rows at once to Python: what a worker holds is a few rows' texts, not ten thousand."""
    now = int(spark.conf.get(_ROWS))
    if not 0 < now <= rows:
        spark.conf.set(_ROWS, rows)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Send at most so many rows at once to Python in the jobs run inside."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, min(int(before) if int(before) > 0 else rows, rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside go at the end: for results that are written by then."""
    paths: list[str] = []
    token = _SCRATCH.set(paths)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def staged(df: DataFrame, label: str, batch: int = BATCH, kept: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and the rows stay as they are if executors are lost. kept: not scratch."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not kept and _SCRATCH.get() is not None:
        _SCRATCH.get().append(path)
    with batches_of(spark, batch):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Give what a Python worker has freed back to the system; for the end of a task, as workers wait for the next one."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what has run and is no longer referred to: it does so once both Python and its driver have collected
    their garbage. Twice, as its listeners hold on to a query for a moment."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def text_key(text: Column) -> Column:
    """Rows with the same id and text get the same results, so these two name a row well enough to join back on."""
    return F.xxhash64(text)


def copies_of(rows: DataFrame, few: int = 1_000_000) -> tuple[DataFrame, int]:
    """``rows`` (doc_id, key, text) with n_bytes and ``first``, the least doc_id of the rows with the same text where there are several ids, else
    null; and the bytes of all distinct texts. Texts are told apart by two hashes of 64 bits, key being one, and their length. Only texts with
    several ids are joined: broadcast if they are few, else sorted."""
    rows = rows.withColumns({"check": F.xxhash64(F.lit(1), "text"), "n_bytes": F.octet_length("text").cast("long")})
    same = ["key", "check", "n_bytes"]
    texts = staged(rows.groupBy(same).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "texts")
    several = texts.where("first < last").drop("last")
    n, size = texts.agg(F.count_if(F.col("first") < F.col("last")), F.sum("n_bytes")).first()
    return rows.join(F.broadcast(several) if n <= few else several, same, "left").drop("check"), size or 0
