"""Session defaults and the shared folder used for written intermediate tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Long texts cross to Python workers: keep an Arrow batch small in rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
}


def local_session(app: str = "lectern", cores: int | str = 8, **extra: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": "8g"} | extra
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only a session that runs in one process may go without: it gets a folder of
    its own, removed when Python ends. On any other master a machine-local folder
    would give each executor its own part of the rows, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return str(held.get()).rstrip("/")
    if not re.match(r"local(\[[^\]]*\])?$", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL_ROOTS:
        root = tempfile.mkdtemp(prefix="lectern-")
        _LOCAL_ROOTS[context.applicationId] = root
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return _LOCAL_ROOTS[context.applicationId]


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"
