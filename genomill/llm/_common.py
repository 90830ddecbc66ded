"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SPLIT = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; where that is unset and all run on this machine, a local one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "genomill-checkpoints")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, whose files stay below the shared folder."""
    spark = df.sparkSession
    at = shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return df.checkpoint(eager=True)


def fresh_dir(spark: SparkSession, kind: str) -> str:
    """A new folder's path below the shared folder (not yet made)."""
    return f"{shared_dir(spark).rstrip('/')}/genomill-{kind}-{uuid.uuid4().hex}"


class Scratch:
    """The folders of one run of an operator, below the shared folder.

    A table that is written and read again has its lineage cut and, unlike a checkpoint, real sizes for the planner.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, []

    def table(self, df: DataFrame, kind: str) -> DataFrame:
        at = fresh_dir(self.spark, kind)
        df.write.parquet(at)
        self.made.append(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, at: str) -> None:
        self.made.remove(at)
        release(self.spark, at)

    def done(self, df: DataFrame, kind: str) -> DataFrame:
        """df written for the caller (its folder stays), everything else removed."""
        at = fresh_dir(self.spark, kind)
        df.write.parquet(at)
        for x in self.made:
            release(self.spark, x)
        self.made = []
        return self.spark.read.schema(df.schema).parquet(at)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions to ask for where a count has to be named."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def own(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(columns: list[str], name: str) -> str:
    """name, with as many underscores before it as no column has (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def range_of(bounds: list[int], value: Column) -> Column:
    """How many of the ascending bounds are at most value, found by halving."""
    if not bounds:
        return F.lit(0)
    array = F.array(*(F.lit(x).cast("long") for x in bounds))
    steps = F.array(*(F.lit(1 << j) for j in reversed(range(len(bounds).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, j: F.when((at + j <= len(bounds)) & (F.try_element_at(array, at + j) <= value), at + j).otherwise(at))


def words_of(text: Column) -> Column:
    """Array of the maximal runs of characters other than space and U+0009 to U+000D; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: w != "")


@functools.cache
def _libc() -> str | None:
    """Found by starting a process, so once a worker."""
    return ctypes.util.find_library("c")


def trim() -> None:
    """Give a finished task's freed memory back to the system: workers stay, and wait beside other stages."""
    pa.default_memory_pool().release_unused()
    libc = _libc()
    if libc and hasattr(lib := ctypes.CDLL(libc), "malloc_trim"):
        lib.malloc_trim(0)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a per-task state: make() is called once in each task and its result maps every batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            out = f(batch)
            if out is not None and out.num_rows:
                yield out
        trim()

    return df.mapInArrow(run, schema)


def join_apart(left: DataFrame, sums: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined with sums (grouped by the long column key) on key, both exchanged for the join alone.

    The exchange of the grouping would serve the join as well, but adaptive execution can't split a frequent key's
    partition of left then. Under an equal key that the planner doesn't recognise, it can.
    """
    apart = F.col(key).bitwiseXOR(F.lit(0x5DEECE66D).cast("long"))
    return left.withColumn("__apart", apart).join(sums.withColumn("__apart", apart).drop(key), "__apart", how).drop("__apart")


_HELD: dict[tuple, object] = {}


def held(name: tuple, make: Callable[[], object]) -> object:
    """The one large object that a worker process keeps between tasks; another operator's takes its place."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def release(spark: SparkSession, uri: str) -> None:
    """Delete a folder below the shared folder, through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
