"""Partition layout: input for stages that spend their time in Python, and global numbering."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.session import shared_folder

BYTES_PER_CORE = 32 << 20


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate; no job runs. None where the plan is not at hand."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        return None


def spread_small(df: DataFrame) -> DataFrame:
    """Give every core a share of an input too small to fill them.

    A file of one row group is one task, whatever the number of cores. That only
    matters for small inputs; one that is large enough keeps the partitions of
    its scan and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = estimated_bytes(df)
    if size is None or size >= cores * BYTES_PER_CORE:
        return df
    return df.repartition(cores)


# Shuffle files of a table go once it is written, not when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scratch: list[list[str]] = []


def written(df: DataFrame, purpose: str, codec: str | None = None, by: str | None = None, keep: bool = False) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder.

    For a small result that is about to meet a very large table: its true size
    is then known when the join is planned, so it is broadcast if and only if it
    is below the session's limit, and the large side is read where it lies
    instead of being shuffled on a guess. The work behind it is not repeated
    when an executor is lost.

    ``codec``: its compression; the session's if not given. ``by``: a column with few values, which get a folder each.
    Within ``scratch`` the table goes at its end; one to ``keep`` goes with the scratch around it, if there is one.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    path = shared_folder(df.sparkSession, purpose)
    if len(_scratch) > keep:
        _scratch[-1 - keep].append(path)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, partitionBy=by, compression=codec)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written in here are deleted at the end: for work whose result is kept, so that nothing reads them later."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def number_rows(df: DataFrame, order: list[Column | str], name: str = "number") -> DataFrame:
    """Adds the place of each row in the whole order, from 0, without sorting in one task.

    Rows are range partitioned and sorted; a row's place is its place within its
    partition plus the sizes of the partitions before. The ranges come from a
    sample, so the sorted rows are written once to the shared folder: counting
    and numbering then see the same partitions, also after an executor is lost.
    """
    path = shared_folder(df.sparkSession, "numbered")
    # The upper bits of this id are the partition, the lower 33 the row within it.
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged.write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumn("_part", F.shiftright("_id", 33))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_shift")
    return rows.join(shifts, "_part").withColumn(name, place).drop("_id", "_part", "_shift")


def largest_so_far(df: DataFrame, order: list[Column | str], value: str, name: str) -> DataFrame:
    """Adds the largest ``value`` of all rows up to this one in the whole order; null where there is none yet.

    Sorted and written like ``number_rows``: a partition hands the next ones one number.
    """
    path = shared_folder(df.sparkSession, "carried")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged.write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumn("_part", F.shiftright("_id", 33))
    tops = rows.groupBy("_part").agg(F.max(value).alias("_top"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    carried = tops.select("_part", F.max("_top").over(before).alias("_carry"))
    inside = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.max(value).over(inside)
    return rows.join(carried, "_part").withColumn(name, F.greatest(here, "_carry")).drop("_id", "_part", "_carry")
