"""Folders of shared storage, seen through Hadoop so that any store works."""

from __future__ import annotations

from pyspark.sql import SparkSession


def folder(spark: SparkSession, path: str):
    """The Hadoop path and the file system it lies in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none when there is no such folder."""
    where, files = folder(spark, path)
    return [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []


def is_folder(spark: SparkSession, path: str) -> bool:
    where, files = folder(spark, path)
    return files.exists(where) and files.getFileStatus(where).isDirectory()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder or file, if it is there."""
    where, files = folder(spark, path)
    files.delete(where, True)


def put(spark: SparkSession, path: str, text: str) -> None:
    """Create or replace a small text file; readers see the old one or the new one, whole."""
    where, files = folder(spark, path)
    beside, _ = folder(spark, f"{path}.part")
    out = files.create(beside, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    files.delete(where, False)
    files.rename(beside, where)


def get(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    where, files = folder(spark, path)
    stream = files.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def mark(spark: SparkSession, path: str) -> None:
    """Create an empty file."""
    where, files = folder(spark, path)
    files.create(where, True).close()
