"""Stored tables: changes rewrite the buckets they touch, readers see old or new, lookups skip data."""

import os

import pytest
from pyspark.sql import functions as F

from inkspark.sources import sinks, stored


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(3000).selectExpr("id div 10 AS doc_id", "id % 10 AS sent_id", "concat('s', id) AS text", "'x' AS __bucket_name")
    stored.create(rows, path, "doc_id", "sent_id", 16)
    return path, rows_of(rows)


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def test_a_change_rewrites_its_buckets_alone(spark, table):
    path, old = table
    before = files(path)
    puts = spark.createDataFrame([(7, 3, "new", "x"), (7, 3, "older", "x"), (7, 99, "more", "x"), (1000, 0, "doc", "x")], "doc_id long, sent_id long, text string, __bucket_name string")
    gone = spark.createDataFrame([(12,), (7,), (5555,)], "doc_id long")
    assert stored.change(spark, path, puts, gone) == stored.version(spark, path) == 1
    after = files(path)
    assert all(after[f] == t for f, t in before.items())
    buckets = {r[0] for r in spark.createDataFrame([(i,) for i in (7, 12, 1000, 5555)], "doc_id long").select(F.pmod(F.xxhash64("doc_id"), F.lit(16))).collect()}
    assert {f.split("__bucket=")[1].split("/")[0] for f in after.keys() - before.keys()} <= set(map(str, buckets))
    want = [r for r in old if r[0] not in (12, 7)] + [(7, 3, "older", "x"), (7, 99, "more", "x"), (1000, 0, "doc", "x")]
    assert rows_of(stored.read(spark, path)) == sorted(want)
    assert rows_of(stored.read(spark, path, 0)) == old
    assert rows_of(stored.lookup(spark, path, 7)) == [(7, 3, "older", "x"), (7, 99, "more", "x")]
    assert stored.lookup(spark, path, 12).count() == 0
    assert stored.vacuum(spark, path) == len({f.split("/part-")[0] for f in before if f.split("__bucket=")[1].split("/")[0] in set(map(str, buckets))})
    assert rows_of(stored.read(spark, path)) == sorted(want)


def test_readers_see_old_or_new(spark, table, monkeypatch):
    path, old = table
    held = stored.read(spark, path)
    publish, seen = stored._publish, []

    def slow(spark, path, number, manifest):
        seen.append(rows_of(stored.read(spark, path)))  # all files of the change are written
        publish(spark, path, number, manifest)

    monkeypatch.setattr(stored, "_publish", slow)
    stored.change(spark, path, gone=spark.range(100).withColumnRenamed("id", "doc_id"))
    assert seen == [old] and rows_of(held) == old
    assert stored.read(spark, path).count() == 2000
    monkeypatch.setattr(stored, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        stored.change(spark, path, gone=spark.range(300).withColumnRenamed("id", "doc_id"))
    assert stored.version(spark, path) == 1 and stored.read(spark, path).count() == 2000


def test_the_second_of_two_changes_fails(spark, table, monkeypatch):
    path, _ = table
    publish = stored._publish

    def late(spark, path, number, manifest):
        monkeypatch.setattr(stored, "_publish", publish)
        stored.change(spark, path, gone=spark.createDataFrame([(1,)], "doc_id long"))
        publish(spark, path, number, manifest)

    monkeypatch.setattr(stored, "_publish", late)
    with pytest.raises(stored.Conflict):
        stored.change(spark, path, gone=spark.createDataFrame([(2,)], "doc_id long"))
    assert stored.version(spark, path) == 1 and stored.lookup(spark, path, 2).count() == 10 and stored.lookup(spark, path, 1).count() == 0
    assert not [f for f in os.listdir(f"{path}/manifests") if f.startswith(".") and not f.endswith(".crc")]


def test_everything_may_go_and_come_back(spark, table):
    path, _ = table
    stored.change(spark, path, gone=stored.read(spark, path))
    assert stored.read(spark, path).count() == 0
    stored.change(spark, path, puts=spark.createDataFrame([(1, 1, None, None)], "doc_id long, sent_id long, text string, __bucket_name string"))
    assert rows_of(stored.read(spark, path)) == [(1, 1, None, None)]
    assert stored.change(spark, path) == 2


def scanned(df):
    """Rows that the scan gave to the filter: those of the row groups that were read."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_lookups_read_one_row_group(spark, tmp_path):
    path = str(tmp_path / "library")
    sents = spark.range(200_000).selectExpr("id % 2000 * 2 AS doc_id", "id div 2000 AS sent_id", "sha2(string(id), 256) AS text")
    docs = sents.select(F.col("doc_id").alias("id")).distinct()
    sinks.write_library(docs, sents, path, group=1 << 18)
    read = spark.read.parquet(f"{path}/sentences")
    one = scanned(read.where("doc_id = 1234 AND sent_id BETWEEN 10 AND 12"))
    assert 0 < one < 10_000
    assert scanned(read.where("doc_id = 1235")) == 0  # within the statistics: the Bloom filter knows
    table = str(tmp_path / "table")
    stored.create(sents, table, "doc_id", "sent_id", 8)
    assert 0 < scanned(stored.lookup(spark, table, 1234)) <= 30_000
