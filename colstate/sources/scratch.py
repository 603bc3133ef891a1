"""Folders for datasets that a query makes: under the folder that all machines of a cluster share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

from colstate.sources.snapshots import SnapshotTable

_OWN: list[str] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of this machine only with ``local[...]`` masters."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="colstate-"))
    return _OWN[0]


def path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/colstate/{name}-{uuid.uuid4().hex[:12]}"


def table(spark: SparkSession, name: str, primary_key: str) -> SnapshotTable:
    return SnapshotTable(spark, path(spark, name), primary_key)
