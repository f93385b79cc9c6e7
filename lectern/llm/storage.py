"""Intermediate tables that give back the disk of the shuffles behind them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from lectern.session import shared_folder

# What holds while a table is written: shuffle files go with it, and texts reach Python in batches of bounded bytes, which
# the JVM holds beside its heap and a worker beside its work; the session's bound by rows lets long texts fill both.
SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}

_scratch: list[list[str]] = []


def stored(df: DataFrame, purpose: str, keep: bool = False, codec: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder; Spark drops its shuffle files as soon as it is written.

    Within ``scratch`` the table goes at its end, unless it is one to ``keep``. ``codec``: its compression; the session's if not given.
    """
    conf = df.sparkSession.conf
    before = {name: conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        conf.set(name, value)
    try:
        path = shared_folder(df.sparkSession, purpose)
        if _scratch and not keep:
            _scratch[-1].append(path)
        df.write.parquet(path, compression=codec)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored in here are deleted at the end: for work whose result is stored to keep, so that nothing reads them later."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
