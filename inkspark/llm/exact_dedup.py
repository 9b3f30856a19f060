"""Exact dedup with a heavy-hitter split (operator 1). Native: no Python runs on the executors.

Texts are equal when they are identical; a null text counts as empty. Of equal texts the row with the
largest id stays (a null id is the smallest; among repeated rows with one id exactly one stays).

1. Digests: each text is read once and becomes a row (id, SHA-256, row number) of a shared table.
2. Misra-Gries: ``DataFrame.freqItems`` keeps ``1 / support`` counters in each partition and merges them, so
   every digest with more than ``support`` of the rows is among its candidates.
3. The candidates are counted exactly. Those verified as heavy, fewer than ``1 / support`` rows, are broadcast,
   and their copies are decided on the map side without a shuffle.
4. All other digests have at most ``support`` of the rows each; their groups are counted with a combine on the map side,
   and rows meet their group in an ordinary join, which holds one row of the group and streams the others.

Empty tables give empty results; extra columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: A digest with more than this share of the rows is heavy. 1 / SUPPORT bounds candidates and broadcast.
SUPPORT = 1 / 1024


def heavy_hitters(rows: DataFrame, key: str, best: F.Column, support: float = SUPPORT) -> DataFrame:
    """(key, group_size, best) of each key with more than ``support`` of the rows: at most 1 / support rows. ``rows`` should be
    a narrow table, since it is read three times and each of its partitions gives a summary of 1 / support counters."""
    found = rows.freqItems([key], support)
    candidates = found.select(F.explode(found.columns[0]).alias(key))
    counted = rows.join(F.broadcast(candidates), key, "left_semi").groupBy(key)
    counted = counted.agg(F.count(F.lit(1)).alias("group_size"), F.max(best).alias("best"))
    total = rows.agg((F.count(F.lit(1)) * F.lit(support)).alias("least"))
    return materialize(counted.join(F.broadcast(total), F.col("group_size") > F.col("least")).drop("least"))


def keepers(rows: DataFrame, key: str, id_col: str, row_no: str, support: float = SUPPORT) -> DataFrame:
    """``rows`` with group_size, keep_id and kept. ``rows`` must be stable when read again and ``row_no`` unique."""
    best = F.struct(F.col(id_col).alias("id"), F.col(row_no).alias("row_no"))
    winners = heavy_hitters(rows, key, best, support)
    heavy = rows.join(F.broadcast(winners), key)
    light = rows.join(F.broadcast(winners.select(key)), key, "left_anti")
    light = light.join(light.groupBy(key).agg(F.count(F.lit(1)).alias("group_size"), F.max(best).alias("best")), key)
    return heavy.unionByName(light).select(
        *rows.columns, "group_size", F.col("best.id").alias("keep_id"), (F.col("best.row_no") == F.col(row_no)).alias("kept")
    )


def digests(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row (id, text_sha256, row_no) for each document, in a table of its own."""
    return materialize(
        docs.select(
            F.col(id_col),
            F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row_no"),
        )
    )


def exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """One row for each document: id, text_sha256, group_size, keep_id, kept."""
    return keepers(digests(docs, text_col, id_col), "text_sha256", id_col, "row_no", support).drop("row_no")


def drop_exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns. Copies of heavy texts go before the shuffle, and of the others each
    task passes on one of a group only. Of repeated rows with one id, the first by a hash of the other columns stays."""
    keyed = docs.withColumn("__key", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    winners = heavy_hitters(materialize(keyed.select("__key", F.col(id_col).alias("id"))), "__key", F.struct("id"), support)
    winners = winners.select("__key", F.lit(True).alias("__heavy"), F.col("best.id").alias("__best"))
    left = keyed.join(F.broadcast(winners), "__key", "left")
    left = left.where(F.col("__heavy").isNull() | F.col(id_col).eqNullSafe(F.col("__best")))
    rest = [F.col(c) for c in docs.columns if c not in (text_col, id_col)]
    order = Window.partitionBy("__key").orderBy(F.col(id_col).desc_nulls_last(), F.xxhash64(F.lit(0), *[c.cast("string") for c in rest]))
    return left.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").select(*docs.columns)
