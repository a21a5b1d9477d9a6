"""Intermediate tables in the folder that the driver and all executors share.

`materialize` writes a frame as Parquet below ``spark.checkpoint.dir`` and reads it back. That cuts lineage, and
the table survives the loss of any executor (unlike a local checkpoint, of which an executor holds the only copy).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one of this process only where none is set (tests, local mode)."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return _own_dir


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and return a frame that reads it."""
    return materialized_at(df, name)[0]


def materialized_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same, and the folder, for who deletes it when nothing reads it any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most `rows` rows for what runs inside: rows that hold long texts or large sets fill memory otherwise."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lower_batches(spark: SparkSession, rows: int) -> None:
    """Lower the session's Arrow batches to at most `rows` rows, for a frame of long texts that runs after its query has returned."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, str(min(rows, int(spark.conf.get(name)))))


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark `df` for broadcast only if it has at most `max_rows` rows; beyond that Spark shuffles it.

    Counts at most ``max_rows + 1`` rows, so the check itself is cheap on a large frame.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def once_each(df: DataFrame, keys: list[str], work: dict[str, Column] | Callable[[DataFrame], DataFrame], of: DataFrame | None = None, max_rows: int = 100_000) -> DataFrame:
    """`df` with the columns of `work`, which depend on the columns `keys` alone, worked out once a distinct combination of these.
    `work` is those columns, or what adds them to a frame and may drop rows by them.

    Combinations are found in a pass of their own over `of` (by default `df`), which should be cheap to read and hold all that `df`
    holds. Few are broadcast; beyond `max_rows` of them texts hardly repeat, and each row works out its own, without a shuffle by text.
    """
    add = work if callable(work) else lambda d: d.withColumns(work)
    seen = materialize((df if of is None else of).select(*keys).distinct(), "distinct")
    n = seen.count()
    if n > max_rows:
        return add(df)
    told = materialize(add(seen.repartition(1 + min(n // 256, 63))), "told")
    named = {k: f"_key_{i}" for i, k in enumerate(keys)}
    told = told.withColumnsRenamed(named)
    return df.join(F.broadcast(told), [F.col(k).eqNullSafe(F.col(x)) for k, x in named.items()]).drop(*named.values())


def numbered(df: DataFrame, order: list[Column | str], name: str, first: int = 0) -> DataFrame:
    """`df` with each row's place in `order` as the long column `name`, counted from `first` without gaps.

    Rows are dealt by range, so that no task sorts more than its share, and written with their place in their partition. What
    comes before a partition is the sum of the counts of those before it: one number a partition is all the driver gets, and
    all that is broadcast. Rows that are equal in `order` are numbered in any order; name enough columns to tell them apart.
    An empty frame gives an empty one.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    rows = materialize(rows, "numbered")
    part = F.shiftright(name, 33)
    starts, before = [], first
    for p, n in sorted(map(tuple, rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())):
        starts.append((p, before - (p << 33)))
        before += n
    shift = f"{name}_shift"
    table = df.sparkSession.createDataFrame(starts, f"p long, {shift} long")
    return rows.join(F.broadcast(table), part == F.col("p")).withColumn(name, F.col(name) + F.col(shift)).drop("p", shift)


def folder_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def newest_generation(spark: SparkSession, path: str) -> int:
    """The newest generation of a stored table, ``gen=N`` below `path`, that is marked as whole; the first, 0, needs no mark."""
    g = 0
    while folder_exists(spark, f"{path}/gen={g + 1}/whole/_SUCCESS"):
        g += 1
    return g
