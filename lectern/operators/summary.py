"""Benchmark statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def describe(samples: DataFrame, value: str, by: list[Column | str]) -> DataFrame:
    """Mean, population standard deviation, least and greatest value per group."""
    return samples.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def describe_samples(samples: DataFrame, metrics: list[str]) -> DataFrame:
    """The same for wide samples: one row per metric column; no samples gives zeros."""
    long = samples.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics
    ])).alias("s")).select("s.*")
    names = samples.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    stats = describe(long, "value", ["metric"])
    return names.join(stats, "metric", "left").na.fill(0.0)
