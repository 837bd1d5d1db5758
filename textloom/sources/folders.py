"""Folders that the driver and all executors share, and files in any store that Hadoop reaches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path under the one that the session shares; it goes with the session.

    Only where the session names none and runs in one process a temporary one is used.
    """
    shared = spark.conf.get(CHECKPOINT_DIR, None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-")
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    files, at = store(spark, path)
    files.deleteOnExit(at)
    return path


def store(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop's objects."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none where there is no folder."""
    files, at = store(spark, folder)
    return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file if nobody has; false where it is there already."""
    files, at = store(spark, path)
    try:
        out = files.create(at, False)
    except Exception as e:  # the store's own exception for a file that exists, wrapped by the gateway
        if files.exists(at):
            return False
        raise e
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def content(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    files, at = store(spark, path)
    stream = files.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
