"""What the operators of this subpackage share: shared folders, row keys, column helpers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these ASCII white space characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Python code takes so many rows of an Arrow batch at a time, which bounds what it holds beside the batch.
SLICE_ROWS = 512


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. The session's spark.checkpoint.dir rules; only where
    it is unset and all runs in one process (tests) a temporary folder takes its place."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not configured:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="docloom-checkpoint-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(configured)
    return configured


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared checkpoint folder and read from there,
    so a lost executor costs no recomputation of what came before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_STORED: ContextVar[list[str] | None] = ContextVar("stored", default=None)


def store(df: DataFrame) -> DataFrame:
    """Like materialize(), as a compressed Parquet table in the same shared folder."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    if (made := _STORED.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_stores(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside go at the end, so what is computed from them must not be lazy any more."""
    token = _STORED.set(made := [])
    try:
        yield
    finally:
        _STORED.reset(token)
        for path in made:
            delete_folder(spark, path)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, with all in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: What operators keep in a worker from one task to the next: how to drop it, by operator.
KEPT: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    """Memory that workers would keep for later tasks goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def slices(batches: Iterator[pa.RecordBatch], operator: str = "") -> Iterator[pa.RecordBatch]:
    """The batches in slices of SLICE_ROWS rows. A task first drops what other operators kept in its worker."""
    for name, drop in KEPT.items():
        if name != operator:
            drop()
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)
    give_back()


def let(value: Column, body) -> Column:
    """Evaluate value once and use it many times: the binding is a lambda variable, which the
    optimizer never inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Join condition under which nulls match nulls."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition
