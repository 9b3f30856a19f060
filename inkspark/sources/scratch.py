"""The folder for intermediate data that driver and executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[tuple[str, str], str] = {}


def _root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset: a temporary folder if driver and executors are one process, else the warehouse,
    which they share if it is no local folder of each machine (else that is an error)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        return tempfile.mkdtemp(prefix="inkspark-")
    shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_inkspark"
    if hadoop_path(spark, shared)[1].getScheme() == "file":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share: the warehouse is a local one")
    return shared


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system, as Spark's JVM knows them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession) -> str:
    """A new path in the session's folder for intermediate data. The folder is removed when the JVM ends, whether the session
    was stopped before or not."""
    session = (spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None) or "")
    if session not in _folders:
        _folders[session] = f"{_root(spark)}/inkspark-{session[0]}"
        path, where = hadoop_path(spark, _folders[session])
        where.mkdirs(path)
        where.deleteOnExit(path)
    return f"{_folders[session]}/{uuid.uuid4().hex}"


_tables: dict[int, tuple[DataFrame, str]] = {}


def kept(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage is cut and survives lost executors. The tables ``spent``,
    which came from here and are not read any more, are dropped then."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    _tables[id(made)] = (made, path)
    drop(*spent)
    return made


def drop(*tables: DataFrame) -> None:
    """Remove the files of tables that kept() gave."""
    for t in tables:
        if id(t) in _tables:
            path, where = hadoop_path(t.sparkSession, _tables.pop(id(t))[1])
            with contextlib.suppress(Exception):  # a store that refuses keeps the files till the end
                where.delete(path, True)
