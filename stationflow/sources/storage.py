"""Listing, deleting and pointing at folders on whatever file system a path names."""

from __future__ import annotations

import datetime as dt
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _open(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _open(spark, path)
    return fs.exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder; empty when it is missing."""
    fs, target = _open(spark, path)
    if not fs.exists(target):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(target))


def data_files(spark: SparkSession, path: str) -> list[str]:
    """Parquet files below a folder, in path order."""
    fs, target = _open(spark, path)
    if not fs.exists(target):
        return []
    found, files = [], fs.listFiles(target, True)
    while files.hasNext():
        name = files.next().getPath().toString()
        if name.endswith(".parquet"):
            found.append(name)
    return sorted(found)


def has_data(spark: SparkSession, path: str) -> bool:
    """Whether a folder has anything but marker files, one level down at most."""
    names = [n for n in children(spark, path) if not n.startswith(("_", "."))]
    return any(n.endswith(".parquet") or children(spark, f"{path}/{n}") for n in names)


def delete(spark: SparkSession, path: str) -> bool:
    fs, target = _open(spark, path)
    return fs.delete(target, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small UTF-8 file, or None when it is missing."""
    fs, target = _open(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, text: str, *, replace: bool) -> None:
    """Write a small UTF-8 file under another name, then rename it into place in one step."""
    jvm = spark._jvm
    fs, target = _open(spark, path)
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.new")
    fs.mkdirs(target.getParent())
    stream = fs.create(fresh, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE if replace else kind.NONE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration()
    )
    try:
        files.rename(fs.makeQualified(fresh), fs.makeQualified(target), options)
    except Py4JJavaError:
        fs.delete(fresh, False)
        raise


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write or replace a small UTF-8 file; a reader finds the old content or the new one."""
    _put(spark, path, text, replace=True)


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small UTF-8 file where there is none; False when somebody else's is there.

    Needs a file system whose rename does not replace, as HDFS has.
    """
    try:
        _put(spark, path, text, replace=False)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    return True


def partition_days(spark: SparkSession, path: str) -> list[dt.date]:
    """Days a ``date=`` partitioned folder holds data for; other names are skipped."""
    days = []
    for name in children(spark, path):
        if not name.startswith("date="):
            continue
        try:
            day = dt.date.fromisoformat(name.removeprefix("date="))
        except ValueError:
            continue
        if has_data(spark, f"{path}/{name}"):
            days.append(day)
    return days


def day_frame(spark: SparkSession, days: list[dt.date]) -> DataFrame:
    return spark.createDataFrame([(d,) for d in days], "day date")
