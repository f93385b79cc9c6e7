"""Table writes: keyed upsert, versioned rows, reports."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None when there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per key, by partial aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*").select(*rows.columns)


def _bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _replace_partitions(df: DataFrame, path: str, parts: list[str]) -> None:
    # rebalance: AQE splits a large partition over several files and merges small ones.
    # Inside a streaming batch AQE is off and the hint unknown.
    adaptive = df.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true"
    laid = df.hint("rebalance", *parts) if adaptive else df.repartition(*parts)
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *parts
    ).parquet(path)


def stored_buckets(spark: SparkSession, path: str, buckets: int) -> int:
    """The bucket count of the table at ``path``: it is written with the table when it is made, and holds from then on."""
    layout = read_table(spark, f"{path}/_layout")
    if layout is not None:
        return layout.first()["buckets"]
    if read_table(spark, path) is not None:
        raise ValueError(f"{path} holds rows but no layout: write it again with rebucket()")
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/_layout")
    return buckets


def rebucket(table: DataFrame, path: str, keys: list[str], within: list[str] = (), buckets: int = BUCKETS) -> None:
    """Writes ``table`` to a new ``path`` with another bucket count, say when its buckets have grown too large."""
    stored_buckets(table.sparkSession, path, buckets)
    _replace_partitions(_bucketed(table.drop("bucket"), keys, buckets), path, [*within, "bucket"])


def upsert(
    new: DataFrame, path: str, keys: list[str], order: list[str], within: list[str] = (), buckets: int = BUCKETS
) -> None:
    """K1: insert or replace rows by key; the newest by ``order`` stays, whichever batch brings it.

    The table is laid out by ``within`` (say, the collection) and a hash bucket of
    the key. Only the buckets the new rows fall into are read and rewritten, so a
    large collection is never rewritten whole. ``buckets`` counts when the table is
    made. One batch may hold a key twice. At equal order the new row stays.
    """
    spark = new.sparkSession
    buckets = stored_buckets(spark, path, buckets)
    # Used several times below; kept so that, say, an encoder runs once per row.
    fresh = _bucketed(latest(new, keys, order), keys, buckets).persist(StorageLevel.MEMORY_AND_DISK)
    parts = [*within, "bucket"]
    old = read_table(spark, path)
    rows = fresh
    if old is not None:
        old = old.join(fresh.select(*parts).distinct(), parts, "left_semi")
        # Keys and order decide; texts and vectors are not sorted or compared.
        held = old.select(*keys, F.struct(*order).alias("_old"))
        newer = fresh.select(*keys, F.struct(*order).alias("_new")).join(held, keys).where("_old > _new").select(*keys)
        rows = fresh.join(newer, keys, "left_anti")
        kept = old.join(rows.select(*keys), keys, "left_anti")
        rows = rows.unionByName(kept.select(*fresh.columns))
    _replace_partitions(rows, path, parts)
    fresh.unpersist()


def replace_groups(
    new: DataFrame, groups: DataFrame, path: str, keys: list[str], order: str, within: list[str] = (), buckets: int = BUCKETS
) -> None:
    """Replaces all rows of each group (say, the chunks of a document) by those of ``new``, which may be fewer, or none.

    ``groups`` has one row per group with ``keys`` and ``order``. A group whose stored
    rows are newer stays as it is. Groups are hashed whole, so one lies in one bucket.
    """
    spark = new.sparkSession
    buckets = stored_buckets(spark, path, buckets)
    asked = _bucketed(groups.select(*keys, order), keys, buckets).persist(StorageLevel.MEMORY_AND_DISK)
    parts = [*within, "bucket"]
    old = read_table(spark, path)
    rows = _bucketed(new, keys, buckets)
    if old is not None:
        old = old.join(asked.select(*parts).distinct(), parts, "left_semi")
        held = old.groupBy(*keys).agg(F.max(order).alias("_old"))
        newer = asked.join(held, keys).where(F.col("_old") > F.col(order)).select(*keys)
        kept = old.join(asked.join(newer, keys, "left_anti").select(*keys), keys, "left_anti")
        # A bucket whose rows all go would not be written, and so not replaced: it is emptied by name.
        rows = rows.join(newer, keys, "left_anti").unionByName(kept.select(*rows.columns))
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        gone = old.select(*parts).distinct().join(rows.select(*parts).distinct(), parts, "left_anti").collect()
        _replace_partitions(rows, path, parts)
        for r in gone:  # a few partition names
            _delete(spark, "/".join([path, *(f"{c}={r[c]}" for c in parts)]))
        rows.unpersist()
    else:
        _replace_partitions(rows, path, parts)
    asked.unpersist()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def append_version(rows: DataFrame, path: str, within: list[str] = ()) -> None:
    """Add rows to an append-only table; the current state is ``latest``."""
    writer = rows.write.mode("append")
    (writer.partitionBy(*within) if within else writer).parquet(path)


def write_report(df: DataFrame, path: str, form: str = "csv") -> None:
    """K4 / K5: a report table as CSV with header, or JSON."""
    writer = df.write.mode("overwrite")
    if form == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.json(path)


def write_reports(report: DataFrame, weak: DataFrame, path: str, form: str = "csv") -> None:
    """K4 / K5: the report and the weak questions or concepts behind it, as two tables below ``path``."""
    write_report(report, f"{path}/report", form)
    write_report(weak, f"{path}/weak", form)
