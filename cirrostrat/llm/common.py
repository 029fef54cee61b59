"""Shared plumbing of the training-data operators: tables, work folders and
shipping of Python functions to executors.

Intermediate tables go to the shared folder named by ``spark.checkpoint.dir``;
they cut lineage, so a lost executor costs the reading of a file, not a replay.
"""

from __future__ import annotations

import os
import pickle
import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions sent to executors travel by value, and so does what Shared broadcasts: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])


class Shared:
    """A broadcast value. Broadcasts alone would pickle its classes by reference, and the workers would have
    to import them; here it travels as bytes that hold its classes, and a worker process reads them once."""

    def __init__(self, spark: SparkSession, value) -> None:
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value, protocol=pickle.HIGHEST_PROTOCOL))

    @property
    def value(self):
        sent = self._sent.__dict__
        if "_own" not in sent:
            sent["_own"] = pickle.loads(self._sent.value)
            sent.pop("_value", None)
        return sent["_own"]


#: Rows and bytes of an Arrow batch between the engine and Python, unless the session has numbers of its own: rows
#: hold whole texts or sets. A longer row goes alone.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
_BATCH, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, BATCH_ROWS)
    if spark.conf.get(_BYTES, None) is None:
        spark.conf.set(_BYTES, BATCH_BYTES)


def renamed(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str], list[Column]]:
    """For operators that give back rows as they were: docs with columns c0, c1 and so on, which meet no name of
    the operator's own; how the given columns are called there; and the columns that undo it."""
    columns = docs.columns
    inner = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    return inner, [f"c{columns.index(n)}" for n in names], [F.col(f"c{i}").alias(c) for i, c in enumerate(columns)]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, with its file system's scheme. Where it is unset, a session that
    runs in one process (tests, local runs) gets one of its own; on a cluster that's an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cirrostrat-")
        spark.sparkContext.setCheckpointDir(base)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; nothing is created."""
    small_batches(spark)
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, *, codec: str = "zstd") -> DataFrame:
    """df written as Parquet to the shared folder and read again."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote and that nothing reads any more."""
    for t in tables:
        delete_folder(t.sparkSession, t._stored_at)


def delete_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def filesystem(path: str):
    """pyarrow filesystem and the path in it, for files that executors read or write themselves."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path)
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def in_fold(column: str, folds: int, remainder: int):
    """True where crc32 of the id as text leaves that remainder; false for null ids."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == remainder, F.lit(False))


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Puts a finished folder in place."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(at, jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} can't be renamed to {to}")
