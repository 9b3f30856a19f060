"""Sharding by jump consistent hashing (operator 5).

A row's shard depends on its key and the number of shards alone (law ``key``), with no ring table. Jump hashing
steps a 64-bit linear congruential generator seeded by the key from one candidate shard to the next; when shards
are appended, a key either stays or goes to a new shard. Equal texts with different keys are not held together:
the law forbids it. Keys are mixed by XXH64 first, so dense ids spread well; a null key is a key like any other.

Slots number the rows of each shard without gaps from 0. They come from counts of 256 hash buckets in each shard,
so no task sorts a whole shard.

Repeated rows have slots of their own; an empty table gives no rows. Only the named columns are read, but for
write_shards(), which renames its own column where it clashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, materialize

BUCKETS = 256


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key (Lamping and Veach 2014), all keys stepped together."""
    state, at, jump = keys.astype(np.uint64), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    with np.errstate(over="ignore"):
        while len(live):
            at[live] = jump[live]
            state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
            step = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
            jump[live] = ((at[live] + 1) * (float(1 << 31) / step)).astype(np.int64)
            live = live[jump[live] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def jumped(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(hashed.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return jumped(F.xxhash64(key))


def shard_rows(docs: DataFrame, shards: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each document: id, size (UTF-8 bytes plus 16), text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("shard", shard_of(F.col(id_col), shards)).withColumn("grown_shard", shard_of(F.col(id_col), shards + 1))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.col(id_col), "text_crc32", "size"), F.lit(BUCKETS)).cast("int"))
    rows = materialize(rows)
    counts = rows.groupBy("shard", "bucket").count()  # shards * BUCKETS rows at most
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "bucket", before.alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(id_col, "text_crc32", "size"))
    starts = F.broadcast(starts) if shards * BUCKETS <= BROADCAST_ROWS else starts
    placed = rows.withColumn("inside", inside).join(starts, ["shard", "bucket"])
    return placed.select(
        id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("inside") - 1).cast("long").alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, shards: int, files: int = 1, id_col: str = "doc_id") -> str:
    """Write whole rows to a folder for each shard, and return the name of the folders' column: ``shard``, with as many
    underscores behind it as a column of ``docs`` demands. With ``files`` over 1 a shard is written by as many tasks."""
    name = "shard"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    placed = docs.withColumn(name, shard_of(F.col(id_col), shards))
    spread = F.pmod(F.xxhash64(F.lit(1), id_col), F.lit(files))
    placed.repartition(shards * files, name, spread).write.partitionBy(name).parquet(path)
    return name
