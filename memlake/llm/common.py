"""What the training-data operators share: shared tables, Arrow batches, size-checked joins."""

from __future__ import annotations

import contextvars
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows and bytes of what a batch function gets at once; a single row may be larger.
BATCH_ROWS, BATCH_BYTES = 400, 2 << 20
#: Bytes of an Arrow batch between the JVM and Python, where the session doesn't say.
ARROW_BYTES = "4m"
#: A side is broadcast only if it was measured to be no larger than this.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a local session gets one of its own; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-memlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_SCRATCH: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("scratch", default=None)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """The tables that written() makes inside, for the caller to drop once nothing reads them."""
    made: list[DataFrame] = []
    token = _SCRATCH.set(made)
    try:
        yield made
    finally:
        _SCRATCH.reset(token)


def written(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/memlake-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._memlake_path = path
    if (made := _SCRATCH.get()) is not None:
        made.append(again)
    return again


def dropped(*frames: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for df in frames:
        spark, path = df.sparkSession, getattr(df, "_memlake_path", None)
        if path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession) -> None:
    """Texts can be very long: bound Arrow batches by bytes unless the session does so itself."""
    if not spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most BATCH_ROWS rows and, where a row isn't larger, BATCH_BYTES bytes of strings and lists."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(column.type):
            sizes += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        upto = int(np.searchsorted(ends, before + BATCH_BYTES, "right"))
        upto = min(max(upto, at + 1), at + BATCH_ROWS)
        yield batch.slice(at, upto - at)
        at = upto


def give_back() -> None:
    """Free memory that an idle worker would hold: a worker lives on after its task, beside those of other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def over_texts(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str | StructType) -> DataFrame:
    """Apply a batch function to Arrow batches; make() runs once in each task, and what it holds goes with the task.

    The function gets column name -> list and returns column name -> list for the named schema.
    """
    small_batches(df.sparkSession)
    out = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, made = make(), None
        for whole in batches:
            for batch in sliced(whole):
                made = fn(batch.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in arrow], schema=arrow)
        del fn, made
        give_back()

    return df.mapInArrow(run, out)


def joined_small(left: DataFrame, right: DataFrame, on: list[str], how: str, measured_bytes: int, salts: int = 64) -> DataFrame:
    """Join a large left side with a right side that is unique on its keys.

    Broadcast the right side if its measured size allows; else salt: the right side is repeated over salts,
    so that a hot key of the left side spreads over that many tasks.
    """
    if measured_bytes <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), on, how)
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    row = F.xxhash64(*[F.col(c) for c in left.columns if c not in on]) if len(left.columns) > len(on) else F.lit(0)
    return left.withColumn("_salt", F.pmod(row, F.lit(salts)).cast("int")).join(salted, [*on, "_salt"], how).drop("_salt")
