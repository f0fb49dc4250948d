"""Folders for what a session writes on the way: inside the folder that all executors share, or a local one for local masters."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, what: str) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/streamtable"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
