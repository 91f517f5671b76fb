"""Writers that never overwrite by accident."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def parquet_strict(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """An error if the path exists; Spark's committer makes attempts safe."""
    df.write.mode("errorifexists").option("compression", compression).parquet(path)


def partitioned(df: DataFrame, path: str, *columns: str, rows_a_file: int = 0) -> None:
    """One folder for each value; rows of a value meet in few files of a bounded size."""
    df.repartition(*columns).write.mode("errorifexists").option("maxRecordsPerFile", rows_a_file).partitionBy(*columns).parquet(path)


def sorted_parts(df: DataFrame, path: str, parts: int, *keys: str) -> None:
    """A given number of files, each sorted by the keys it is dealt by."""
    df.repartition(parts, *keys).sortWithinPartitions(*keys).write.mode("errorifexists").parquet(path)


def avro(df: DataFrame, path: str, record: str, namespace: str) -> None:
    """A folder of Avro files whose records have that name; an error if the path exists."""
    from tessera.sources import avro_files

    avro_files.write(df, path, record, namespace)


def csv_result(df: DataFrame, path: str, most_rows: int = 100_000) -> None:
    """A small result as one CSV file; an error if it is not small."""
    rows = df.limit(most_rows + 1).toPandas()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    rows.to_csv(path, index=False)


def json_atomic(value: object, path: str) -> None:
    """Written beside and renamed, so that readers see all or nothing."""
    handle, beside = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".tmp")
    with os.fdopen(handle, "w") as out:
        json.dump(value, out, sort_keys=True)
    os.replace(beside, path)


def publish(staged: str, target: str, owner: str) -> None:
    """Move a finished folder to its place; a folder of another owner is never replaced."""
    mark = os.path.join(target, "_OWNER")
    if os.path.exists(target):
        if not os.path.exists(mark) or open(mark).read() != owner:
            raise FileExistsError(target)
        shutil.rmtree(target)
    with open(os.path.join(staged, "_OWNER"), "w") as out:
        out.write(owner)
    os.replace(staged, target)


def _files(spark: SparkSession, path: str):
    """Hadoop's view of a path's file system, and the path in it."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _renamed(spark: SparkSession, source, target, replace: bool) -> None:
    """One path to another in a single step of the file system."""
    jvm = spark._jvm
    kinds = jvm.org.apache.hadoop.fs.Options.Rename
    flags = spark.sparkContext._gateway.new_array(kinds, 1)
    flags[0] = kinds.OVERWRITE if replace else kinds.NONE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(source, target, flags)


def _content(spark: SparkSession, files, path) -> str:
    """A small file's text."""
    stream = files.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def json_published(spark: SparkSession, value: object, path: str) -> None:
    """json_atomic for any file system that Spark can reach."""
    files, target = _files(spark, path)
    beside = target.suffix(f".{uuid.uuid4().hex}.tmp")
    out = files.create(beside)
    try:
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    finally:
        out.close()
    _renamed(spark, beside, target, True)


def folder_published(spark: SparkSession, staged: str, target: str, owner: str) -> None:
    """publish for any file system that Spark can reach; the old folder stands aside until the new one is in place."""
    files, to = _files(spark, target)
    mark = spark._jvm.org.apache.hadoop.fs.Path(to, "_OWNER")
    aside = None
    if files.exists(to):
        if not files.exists(mark) or _content(spark, files, mark) != owner:
            raise FileExistsError(target)
        aside = to.suffix(f".{uuid.uuid4().hex}.old")
        _renamed(spark, to, aside, False)
    out = files.create(spark._jvm.org.apache.hadoop.fs.Path(staged, "_OWNER"))
    try:
        out.write(bytearray(owner.encode()))
    finally:
        out.close()
    _renamed(spark, _files(spark, staged)[1], to, False)
    if aside is not None:
        files.delete(aside, True)


def csv_published(spark: SparkSession, df: DataFrame, path: str, most_rows: int = 100_000) -> None:
    """csv_result for any file system that Spark can reach."""
    rows = df.limit(most_rows + 1).toPandas()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    files, target = _files(spark, path)
    out = files.create(target, False)
    try:
        out.write(bytearray(rows.to_csv(index=False).encode()))
    finally:
        out.close()
