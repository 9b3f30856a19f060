"""A stored table that is changed in place: hash buckets, copied on write, published by one rename.

A table is a folder. ``data/<change>/__bucket=<b>`` has the rows of a bucket as a change wrote them, sorted by key and order, in
row groups with statistics and Bloom filters. ``manifests/<n>`` names, for each bucket, the change that wrote it last; the
largest n is the table. A change rewrites the buckets it touches and no others, and comes to be when its manifest is renamed to the next
number: a reader has the old table or the new one, and what a lost job left behind is named by no manifest. Of two changes made at once
the second one fails and can be made again. A manifest has a few numbers for each bucket; rows never pass the driver.

``key`` (such as doc_id) decides the bucket, and with ``order`` (such as sent_id) it names a row. A key with very many rows has
several files, cut by order.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import hadoop_path

BUCKETS = 64
#: Bytes of a row group.
GROUP = 4 << 20


class Conflict(RuntimeError):
    """Another change was published first."""


def sorted_writer(df: DataFrame, order: list[str], bloom: list[str], group: int = GROUP):
    """A writer of ``df`` in files that follow each other in ``order``, so that scans of a range skip row groups, and lookups
    in ``bloom`` columns those without the value."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.option("parquet.block.size", group)
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    return writer


def _bucket(keys: list[str] | list[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    folder, where = hadoop_path(spark, f"{path}/manifests")
    if version is None:
        version = max(int(s.getPath().getName()) for s in where.listStatus(folder) if s.getPath().getName().isdigit())
    stream = where.open(hadoop_path(spark, f"{path}/manifests/{version}")[0])
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return version, json.loads(text)


def _publish(spark: SparkSession, path: str, version: int, manifest: dict) -> None:
    jvm = spark.sparkContext._jvm
    part, where = hadoop_path(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    out = where.create(part)
    out.write(json.dumps(manifest).encode())
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE  # an existing manifest is never replaced
    try:
        files.rename(part, hadoop_path(spark, f"{path}/manifests/{version}")[0], options)
    except Exception as e:
        where.delete(part, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {version} of {path} was published by another change") from None
        raise


def _write(rows: DataFrame, path: str, change: str, key: list[str], order: list[str], buckets: int) -> list[int]:
    """The buckets that have rows."""
    spark = rows.sparkSession
    dealt = rows.withColumn("__bucket", _bucket(key, buckets))
    sorted_writer(dealt, ["__bucket", *key, *order], key).partitionBy("__bucket").parquet(f"{path}/data/{change}")
    folder, where = hadoop_path(spark, f"{path}/data/{change}")
    return [int(s.getPath().getName().partition("=")[2]) for s in where.listStatus(folder) if s.isDirectory() and "=" in s.getPath().getName()]


def create(rows: DataFrame, path: str, key: str | list[str], order: str | list[str], buckets: int = BUCKETS) -> None:
    """Version 0 of a new table. Keys and orders are not null, and name a row each."""
    key, order, change = [key] if isinstance(key, str) else key, [order] if isinstance(order, str) else order, f"0-{uuid.uuid4().hex[:8]}"
    full = _write(rows, path, change, key, order, buckets)
    schema = StructType.fromJson(json.loads(rows.schema.json()))
    _publish(rows.sparkSession, path, 0, {"key": key, "order": order, "buckets": buckets, "schema": schema.jsonValue(), "at": {str(b): change for b in full}})


def _rows(spark: SparkSession, path: str, manifest: dict, wanted: list[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(manifest["schema"])
    at = {int(b): change for b, change in manifest["at"].items() if wanted is None or int(b) in set(wanted)}
    folders = [f"{path}/data/{change}/__bucket={b}" for b, change in sorted(at.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table, or how it was at an earlier version."""
    return _rows(spark, path, _manifest(spark, path, version)[1])


def version(spark: SparkSession, path: str) -> int:
    return _manifest(spark, path)[0]


def lookup(spark: SparkSession, path: str, *key: object) -> DataFrame:
    """The rows of one key: of its bucket, those row groups that may have it."""
    _, manifest = _manifest(spark, path)
    kinds = {f.name: f.dataType for f in StructType.fromJson(manifest["schema"])}
    values = [F.lit(v).cast(kinds[k]) for k, v in zip(manifest["key"], key, strict=True)]
    bucket = spark.range(1).select(_bucket(values, manifest["buckets"])).first()[0]
    rows = _rows(spark, path, manifest, [bucket])
    for k, v in zip(manifest["key"], values, strict=True):
        rows = rows.where(F.col(k) == v)
    return rows


def change(spark: SparkSession, path: str, puts: DataFrame | None = None, gone: DataFrame | None = None) -> int:
    """A new version: without the keys of ``gone``, and then with the rows of ``puts`` in place of those they name. Of several puts
    for a row the largest by its other columns counts. Returns the version; the table as it was stays readable by its number."""
    number, manifest = _manifest(spark, path)
    key, order, buckets = manifest["key"], manifest["order"], manifest["buckets"]
    schema, name = StructType.fromJson(manifest["schema"]), f"{number + 1}-{uuid.uuid4().hex[:8]}"
    rest = [f.name for f in schema if f.name not in (*key, *order)]
    if puts is not None:
        puts = puts.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        puts = puts.groupBy(*key, *order).agg(F.max(F.struct(*rest)).alias("__x")).select(*key, *order, *[F.col(f"__x.{c}").alias(c) for c in rest]) if rest else puts.distinct()
    keys = [d.select(*[F.col(k) for k in key]) for d in (puts, gone) if d is not None]
    if not keys:
        return number
    touched = keys[0] if len(keys) == 1 else keys[0].unionByName(keys[1])
    touched = [r[0] for r in touched.select(_bucket(key, buckets)).distinct().collect()]  # at most ``buckets`` numbers
    rows = _rows(spark, path, manifest, touched)
    if gone is not None:
        rows = rows.join(gone.select(*key).distinct(), key, "left_anti")
    if puts is not None:
        rows = rows.join(puts.select(*key, *order), [*key, *order], "left_anti").select(*schema.names).unionByName(puts.select(*schema.names))
    full = set(_write(rows, path, name, key, order, buckets)) if touched else set()
    at = {b: c for b, c in manifest["at"].items() if int(b) not in touched} | {str(b): name for b in full}
    _publish(spark, path, number + 1, manifest | {"at": at})
    return number + 1


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove what the last ``keep`` versions do not name; returns how many bucket folders went. No change may be under way."""
    last = version(spark, path)
    kept = {f"{c}/__bucket={b}" for n in range(max(0, last - keep + 1), last + 1) for b, c in _manifest(spark, path, n)[1]["at"].items()}
    removed = 0
    data, where = hadoop_path(spark, f"{path}/data")
    for made in where.listStatus(data):
        inside = [s.getPath() for s in where.listStatus(made.getPath()) if s.isDirectory()]
        for p in inside:
            if f"{made.getPath().getName()}/{p.getName()}" not in kept:
                where.delete(p, True)
                removed += 1
        if not any(f"{made.getPath().getName()}/{p.getName()}" in kept for p in inside):
            where.delete(made.getPath(), True)
    for n in range(max(0, last - keep + 1)):
        where.delete(hadoop_path(spark, f"{path}/manifests/{n}")[0], False)
    return removed
