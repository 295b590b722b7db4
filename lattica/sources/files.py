"""Small files in the tables' file system, replaced whole."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _jvm(spark: SparkSession):
    return spark._jvm, spark._jsc.hadoopConfiguration()


def file_system(spark: SparkSession, path: str):
    """(file system, path object)."""
    jvm, conf = _jvm(spark)
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it is not there."""
    fs, at = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def move(spark: SparkSession, old: str, new: str) -> None:
    """Rename, over what is there; one step for a reader, and an error if it fails."""
    jvm, conf = _jvm(spark)
    fs, source = file_system(spark, old)
    target = jvm.org.apache.hadoop.fs.Path(new)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(source).toUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(source), fs.makeQualified(target), options)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside the file and moved over it: a reader sees the old text or the new one."""
    fresh = f"{path}.{uuid.uuid4().hex}.new"
    fs, at = file_system(spark, fresh)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    move(spark, fresh, path)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)
