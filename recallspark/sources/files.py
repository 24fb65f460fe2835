"""Small text files in the store's own file system, whatever it is: read, and replaced whole."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _context(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    whole = at.getFileSystem(conf).makeQualified(at)
    return jvm, jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), conf), whole


def read_text(spark: SparkSession, path: str) -> str | None:
    """The file's text, or None if there is none."""
    jvm, context, at = _context(spark, path)
    if not context.util().exists(at):
        return None
    stream = context.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _written_beside(spark: SparkSession, jvm, at, text: str):
    fresh = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at.getParent())
    stream = files.create(fresh, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return fresh


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the file, then rename over it: a reader sees the old text or the new one."""
    jvm, context, at = _context(spark, path)
    fresh = _written_beside(spark, jvm, at, text)
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(fresh, at, options)


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that must not exist yet, whole or not at all; False if it does exist."""
    jvm, context, at = _context(spark, path)
    fresh = _written_beside(spark, jvm, at, text)
    try:
        context.rename(fresh, at, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception:  # the other side's error class is not a Python one
        if not context.util().exists(at):
            raise
        context.delete(fresh, False)
        return False
    return True


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    _, context, at = _context(spark, path)
    if not context.util().exists(at):
        return []
    return sorted(s.getPath().getName() for s in context.util().listStatus(at))


def remove(spark: SparkSession, path: str) -> None:
    _, context, at = _context(spark, path)
    if context.util().exists(at):
        context.delete(at, True)
