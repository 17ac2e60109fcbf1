"""Tables in versions: readers follow a pointer that moves when a version is whole.

A version is a folder of its own; the pointer is a small file that a rename replaces at once, so a
job that fails half way leaves readers with what they had. Works on any file system that Spark sees.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"


def _system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> dict | None:
    """What the pointer of a table says; None where nothing was written whole yet."""
    jvm, where, system = _system(spark, f"{path}/{POINTER}")
    if not system.exists(where):
        return None
    stream = system.open(where)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def move(spark: SparkSession, path: str, said: dict) -> None:
    """Points readers to another version, at once."""
    jvm, ready, system = _system(spark, f"{path}/.{POINTER}-{uuid.uuid4().hex}")
    stream = system.create(ready, True)
    stream.write(bytearray(json.dumps(said), "utf-8"))
    stream.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(ready, jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}"), options)


def folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names of a table's folders that begin so; [] where there is no table."""
    _, where, system = _system(spark, path)
    if not system.exists(where):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(where) if s.isDirectory() and s.getPath().getName().startswith(prefix))


def discard(spark: SparkSession, path: str) -> None:
    _, where, system = _system(spark, path)
    system.delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder, read back: several steps read it, one makes it."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
