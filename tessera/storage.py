"""Intermediate tables in the folder that a cluster shares.

A stage whose result several later steps read is written as Parquet to the folder named by
spark.checkpoint.dir and read again: the lineage is cut, so a lost executor costs a reread, and
nothing upstream is computed twice.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share (spark.checkpoint.dir). In local mode only, where one
    machine is the whole cluster, an unset value is replaced by a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _LOCAL[key]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{app_folder(spark)}/{name}-{uuid.uuid4().hex}"


def app_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tessera/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written to the shared folder: those that results
    still read, which no step can drop by itself, too."""
    delete(spark, app_folder(spark))


def staged(df: DataFrame, name: str, by: tuple[str, ...] = (), compression: str = "snappy") -> DataFrame:
    """df, written to the shared folder and read again; in a folder for each value of `by`, if given."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def _opened(file: str) -> pq.ParquetFile:
    """A file of a staged table, as inputFiles names it, in a worker."""
    system, path = pafs.FileSystem.from_uri("s3" + file[3:] if file.startswith("s3a:") else file)
    return pq.ParquetFile(system.open_input_file(path))


def read_table(file: str, columns: list[str]) -> pa.Table:
    with _opened(file) as f:
        return f.read(columns, use_threads=False).combine_chunks()


def read_batches(file: str, columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    with _opened(file) as f:
        for b in f.iter_batches(rows, columns=columns, use_threads=False):
            yield b.select(columns)


#: Bytes a core below which a table is dealt to all cores.
SMALL = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores, if it is so small that its files may hold it in fewer parts than there
    are cores; a table that fills the cluster stays where it is read."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= cores * SMALL:
        return df
    return df.repartition(cores)


#: Steps that run beside each other.
THREADS = 4


def at_once(work: list[Callable]) -> list:
    """The results of steps that do not need each other, run beside each other: a step of few or short
    tasks leaves cores free while it is planned and while its last task ends."""
    # Wrapped one by one: each has local properties of its own.
    todo = [inheritable_thread_target(SparkSession.active())(w) for w in work]
    with ThreadPoolExecutor(THREADS) as pool:
        return [f.result() for f in [pool.submit(w) for w in todo]]


def dropped(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    path = getattr(df, "_tessera_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow(df: DataFrame, kernel, schema) -> DataFrame:
    """mapInArrow in which a batch's columns come as plain arrays, with batches bounded in bytes as well
    as rows (8 MB where the session has no bound of its own), so that long texts cannot fill a worker."""
    conf = df.sparkSession.conf
    if int(conf.get(BATCH_BYTES, str(2**31 - 1))) >= 2**31 - 1:
        conf.set(BATCH_BYTES, str(8 << 20))

    def run(batches):
        yield from kernel(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return a worker's freed memory to the system: workers outlive their tasks, and an executor's
    bound counts what they keep."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
