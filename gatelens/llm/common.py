"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.session import on_workers

#: A key is hot if it has more than this share of all rows; so there are fewer hot keys than this.
HOT = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder (tests); on a
    cluster that would lose files, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gatelens-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


#: The lists of the scratch blocks that this thread or task is in, the innermost last.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/gatelens-{tag}-{uuid.uuid4().hex}"
    for named in _open.get()[-1:]:
        named.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the folders that operators named within; what reads them must be written by then.

    Each block knows its own folders only, so pipelines of one process don't meet.
    """
    named: list[str] = []
    token = _open.set((*_open.get(), named))
    try:
        yield
    finally:
        _open.reset(token)
        for path in named:
            remove(spark, path)


def materialize(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    Cuts the lineage; a lost executor costs no recomputation behind this point.
    """
    path = fresh_path(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this library's own making by Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return on_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is in fold -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def shuffle_width(df: DataFrame, rows: int, rows_per_task: int) -> int:
    """Partitions for a shuffle of so many rows: the session's number, or more if tasks grew too large."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task))


def trim() -> None:
    """Gives memory that a task has freed back to the system; Python workers of other stages live beside this one for a while."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if release is not None:
        release(0)


def join_hot(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """left joined with right, which has a row a key and in the column weight the number of left's rows with that key.

    Of total rows in left, fewer than HOT keys can have over a HOT-th each:
    right's rows of those are broadcast, so that left's stay where they are;
    all others are shuffled, none of them to a task that grows with one key.
    """
    hot = right.where(F.col(weight) * HOT > total).drop(weight)
    cold = right.where(F.col(weight) * HOT <= total).drop(weight)
    near = left.join(F.broadcast(hot), on)
    return near.unionByName(left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))


#: From a text column to runs of its rows: first row, end row, one array of numbers a score.
Scorer = Callable[[pa.Array], Iterator[tuple[int, int, list[pa.Array]]]]


def scored_rows(docs: DataFrame, score: Scorer, names: list[str], id_col: str, text_col: str) -> DataFrame:
    """(doc_id long, one double a name) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for a, b, found in score(batch.column(1)):
                yield pa.RecordBatch.from_arrays([ids[a:b], *found], ["doc_id", *names])
        trim()

    schema = ", ".join(["doc_id long", *(f"{n} double" for n in names)])
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def filtered_rows(docs: DataFrame, score: Scorer, keep: Callable[[list[pa.Array]], np.ndarray], text_col: str) -> DataFrame:
    """The rows whose scores keep accepts; columns, names and types stay."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, found in score(batch.column(at).cast(pa.string())):
                yield batch.slice(a, b - a).filter(pa.array(keep(found)))
        trim()

    return docs.mapInArrow(run, docs.schema)
