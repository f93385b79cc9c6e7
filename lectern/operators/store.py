"""A store laid out by collection: listed from its folders, read only where a question may look.

What a batch of questions selects is a
small table; joined on the collection it prunes folders while the query runs, before any of their rows is read.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.layout import written

FILE_ROWS = 1 << 20
MISSING = "__HIVE_DEFAULT_PARTITION__"


def write_store(rows: DataFrame, path: str, mode: str = "overwrite", file_rows: int = FILE_ROWS) -> None:
    """Write ``rows`` by ``collection``; a large collection is spread over files of about ``file_rows`` rows.

    With ``overwrite`` only the collections that ``rows`` has are replaced, whatever the session's setting.
    """
    sizes = rows.groupBy("collection").agg(F.ceil(F.count(F.lit(1)) / file_rows).cast("int").alias("_files"))
    sizes = written(sizes.withColumnRenamed("collection", "_of"), "store-sizes")
    spread = rows.join(sizes, F.col("collection").eqNullSafe(F.col("_of"))).drop("_of")
    spread = spread.withColumn("_file", F.pmod(F.xxhash64(*rows.columns), F.col("_files")))
    laid = spread.repartition("collection", "_file").drop("_files", "_file")
    laid.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", file_rows).partitionBy("collection").parquet(path)


def collections(spark: SparkSession, path: str) -> DataFrame:
    """The names of the store's collections, from its folders; no file is opened. A store that is not there has none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = []
    if files.exists(where):
        names = [s.getPath().getName().removeprefix("collection=") for s in files.listStatus(where) if s.isDirectory() and s.getPath().getName().startswith("collection=")]
    return spark.createDataFrame([(None if n == MISSING else unquote(n),) for n in sorted(names)], "collection string")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The whole store. Collections are text, also where all their names look like numbers."""
    held = spark.read.parquet(path)
    if held.schema["collection"].dataType != T.StringType():
        fields = [T.StructField("collection", T.StringType()) if f.name == "collection" else f for f in held.schema.fields]
        held = spark.read.schema(T.StructType(fields)).parquet(path)
    return held


def get_collection(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of one collection, from its folder alone."""
    return read_store(spark, path).where(F.col("collection") == name)


def selected_rows(store: DataFrame, chosen: DataFrame) -> DataFrame:
    """O1: the rows of the collections that ``chosen`` (collection, one row per request and choice) names.

    The names are written first: a table of known small size, that Spark turns into a filter on the folders.
    """
    wanted = written(chosen.select(F.col("collection").alias("_wanted")).where("_wanted IS NOT NULL").distinct(), "wanted")
    # The condition lets the planner know that the small side selects.
    return store.join(wanted.where(F.length("_wanted") >= 0), F.col("collection") == F.col("_wanted"), "left_semi")
