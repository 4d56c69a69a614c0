"""Cutting lineage, so that a lost executor repeats one step only."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read from there; a folder of this machine only where the session names none."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="gneiss-"))
    return df.checkpoint()


def folder(spark, label: str) -> str:
    """A new folder beside the checkpoints, for tables that a query writes and reads again."""
    import uuid

    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="gneiss-"))
    return f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"
