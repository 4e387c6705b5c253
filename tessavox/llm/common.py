"""Small helpers that all operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a written table's files up to which it is broadcast; beyond that the same join shuffles.
BROADCAST_BYTES = 16 << 20

#: Texts of an Arrow batch that are Python's at once.
TEXTS = 256

_open = threading.local()
_left: list[str] = []


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Select columns by exact name and rename them: ``pick(df, doc_id="id", text="body")``.

    Columns are found by position, so extra columns whose names clash with the operator's own (also
    by case only) never make a reference ambiguous.
    """
    at = {}
    for new, old in wanted.items():
        if old not in df.columns:
            raise ValueError(f"no column {old!r} among {df.columns}")
        at[new] = df.columns.index(old)
    plain = df.toDF(*[f"c{i}_" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}_").alias(new) for new, i in at.items()])


def whole(text: str | Column) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def texts(batch: pa.Array) -> Iterator[str | None]:
    """The texts of an Arrow batch, TEXTS at a time: a worker holds the batch, but not all its texts once more."""
    for i in range(0, len(batch), TEXTS):
        yield from batch.slice(i, TEXTS).to_pylist()


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; behind the last one the worker, which stays, idle, beside the next step, gives free memory back to the system."""
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named by ``spark.checkpoint.dir``.

    Where it is unset, one is made up for a session of one machine (``local[n]``); a cluster's session must name it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is not None:
        return base
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="tessavox-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, tag: str, last: bool = False) -> str:
    """A fresh path in the shared folder; see ``tidy`` for its end."""
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    scopes = _scopes()
    outer = scopes[:-1] if last else scopes
    (outer[-1] if outer else _left).append(path)
    return path


def written(df: DataFrame, tag: str, last: bool = False) -> DataFrame:
    """Write to the shared folder as Parquet and read it again: a cut in the lineage that outlives executors.

    ``last`` is for tables that the operator's result reads: they outlive its scope.
    """
    path = scratch(df.sparkSession, tag, last)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its files are within BROADCAST_BYTES."""
    files = df.inputFiles()
    if not files:
        return F.broadcast(df)
    folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    size = folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path of any file system that Spark can reach."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(df: DataFrame) -> None:
    """Remove a written table that has been read for the last time."""
    for file in df.inputFiles()[:1]:
        path = file.rpartition("/")[0]
        for paths in [*_scopes(), _left]:
            paths[:] = [p for p in paths if p.rpartition("/")[2] != path.rpartition("/")[2]]
        delete(df.sparkSession, path)


def _scopes() -> list[list[str]]:
    if not hasattr(_open, "stack"):
        _open.stack = []
    return _open.stack


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was written inside, but for tables written as ``last``: these pass to the scope around.

    Without one around they stay for whoever reads the result, until ``clean``.
    """
    _scopes().append([])
    try:
        yield
    finally:
        for path in _scopes().pop():
            delete(spark, path)


def clean(spark: SparkSession) -> None:
    """Removes all tables that finished results have left in the shared folder."""
    while _left:
        delete(spark, _left.pop())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
