"""Keyword catalogue files (D13): YAML to entry rows."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "subject string, grades array<int>, id string, type string, title string, keywords array<string>, body string, source_file string"


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Every YAML file below ``root`` whose name does not start with an underscore."""
    return (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "[!_]*.{yaml,yml}")
        .text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    )


def grades_of(metadata: dict, stem: str) -> list[int]:
    given = metadata.get("grade") or metadata.get("grades", [])
    if isinstance(given, int):
        return [given]
    if isinstance(given, list):
        return [int(g) for g in given if str(g).isdigit()]
    named = re.search(r"grade[_\-]?(\d+)", stem, re.I)
    return [int(named.group(1))] if named else [8, 9, 10, 11, 12]


def _entries(path: str, text: str) -> Iterator[tuple]:
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("reading YAML catalogues needs PyYAML on the executors") from error
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError:
        return
    if not isinstance(data, dict):
        return
    parts = path.rstrip("/").split("/")
    metadata = data.get("metadata") or {}
    subject = str(metadata.get("subject") or (parts[-2] if len(parts) > 1 else "")).lower()
    grades = grades_of(metadata, parts[-1].rsplit(".", 1)[0])
    for name, entry in (data.get("diagrams") or {}).items():
        if isinstance(entry, dict):
            words = entry.get("keywords") or None
            yield (
                subject, grades, f"{subject}_{name}", entry.get("type"), entry.get("title") or "",
                [str(w) for w in words] if words else None, json.dumps(entry, default=str), path,
            )


def parse_files(files: DataFrame) -> DataFrame:
    """Entry rows; of entries with equal subject, grades and id the last path wins.

    A file that does not parse gives no rows.
    """
    names = [part.strip().split(" ")[0] for part in ENTRY.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for path, text in zip(batch["path"], batch["value"]) for row in _entries(path, text)]
            yield pd.DataFrame(rows, columns=names)

    rows = files.select("path", "value").mapInPandas(run, ENTRY)
    keys = ["subject", "grades", "id"]
    rest = [n for n in names if n not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "source_file").alias("r")).select(*keys, "r.*")
