"""Files and folders through Hadoop's file system, whatever the storage."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _open(spark: SparkSession, path: str):
    location = _path(spark, path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), location


def exists(spark: SparkSession, path: str) -> bool:
    fs, location = _open(spark, path)
    return fs.exists(location)


def delete(spark: SparkSession, path: str) -> None:
    fs, location = _open(spark, path)
    fs.delete(location, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if there is no such folder."""
    fs, location = _open(spark, path)
    if not fs.exists(location):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(location))


def modified(spark: SparkSession, path: str) -> int:
    """When a file or folder last changed, in milliseconds."""
    fs, location = _open(spark, path)
    return fs.getFileStatus(location).getModificationTime()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that does not exist yet; False if it does."""
    fs, location = _open(spark, path)
    if fs.exists(location):
        return False
    try:
        out = fs.create(location, False)
    except Py4JJavaError:
        if fs.exists(location):
            return False
        raise
    try:
        out.write(text.encode())
    finally:
        out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    fs, location = _open(spark, path)
    try:
        stream = fs.open(location)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
    except Py4JJavaError as error:
        raise OSError(f"cannot read {path}") from error
