"""Folders and small files by Spark's own file system, so any store that Spark reaches will do."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path where all executors see it: under spark.checkpoint.dir, else the context's. On one machine, where neither is set, under a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _OWN.setdefault("root", "file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, raw: bytes) -> None:
    """Write one small file."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()
