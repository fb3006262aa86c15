"""Which files must be read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Raise when a reader changes, so that every file is read again.
READER_VERSION = 1


def changed_files(listed: DataFrame, manifest: DataFrame, version: int = READER_VERSION) -> DataFrame:
    """Listed files the manifest does not hold with the same size, read by this version."""
    current = manifest.where(F.col("version") == version).select("path", "file_size")
    return listed.join(current, ["path", "file_size"], "left_anti")


def gone_files(listed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of the manifest that are no longer there."""
    return manifest.join(listed.select("path"), "path", "left_anti")
