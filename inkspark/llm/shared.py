"""Tables and files that every executor can read, and joins whose broadcast side is bounded.

Intermediate tables are Parquet in the folder that spark.checkpoint.dir names: every executor can read them again after
another one was lost. A loop drops a table once what was made of it is written; what a returned DataFrame still reads
goes when the JVM ends, whether the session was stopped before or not.
"""

from __future__ import annotations

import contextlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.sources.scratch import hadoop_path, scratch

#: A side of a join is broadcast only when a count has shown that it has no more rows.
BROADCAST_ROWS = 50_000
#: The same for rows of any width.
BROADCAST_BYTES = 1 << 23
#: Copies of the small side where it is too large to broadcast and the other side may be skewed.
SALTS = 32
#: A key with more than this share of a join's rows is heavy; there are fewer than 1 / HEAVY of them.
HEAVY = 1 / 1024

_tables: dict[int, tuple[DataFrame, str]] = {}


def materialize(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, and survives lost executors. The tables ``spent``,
    which came from here and are not read any more, are dropped then."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    _tables[id(made)] = (made, path)
    drop(*spent)
    return made


def drop(*tables: DataFrame) -> None:
    """Remove the files of tables that materialize() gave."""
    for t in tables:
        if id(t) in _tables:
            path, where = hadoop_path(t.sparkSession, _tables.pop(id(t))[1])
            with contextlib.suppress(Exception):  # a store that refuses keeps the files till the end
                where.delete(path, True)


def has_rows(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def join_checked(big: DataFrame, small: DataFrame, on: str | Sequence[str], how: str, spread: Column) -> DataFrame:
    """Join on non-null columns. ``small`` has a row for each key; it is broadcast if its row count is
    proven small, else each of its rows is copied to SALTS salts and ``big`` is salted by ``spread``, so a
    hot key does not meet in one task. The copies are shuffled: Spark, which goes by the size of the files, would take them
    for small and pass all of them through the driver."""
    on = [on] if isinstance(on, str) else list(on)
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies.hint("merge"), [*on, "__salt"], how).drop("__salt")


def join_counted(big: DataFrame, small: DataFrame, on: str | Sequence[str], rows: str) -> DataFrame:
    """Inner join on non-null columns. ``small``, a written table of narrow rows, has a row for each key and in ``rows`` how many
    of ``big`` have it. It is broadcast if it has few rows. Else keys with more than HEAVY of all rows, fewer than 1 / HEAVY, are
    broadcast, and their rows of ``big`` are not shuffled; the rest is, on both sides."""
    on = [on] if isinstance(on, str) else list(on)
    total, most, keys = small.agg(F.sum(rows), F.max(rows), F.count(F.lit(1))).first()
    if keys <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on)
    least = (total or 0) * HEAVY
    if not total or most <= least:
        return big.join(small.hint("merge"), on)
    heavy, light = small.where(F.col(rows) > least), small.where(F.col(rows) <= least)
    rest = big.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light.hint("merge"), on)
    return big.join(F.broadcast(heavy), on).unionByName(rest)


def join_wide(big: DataFrame, small: DataFrame, on: str, rows: str, size: Column, spread: Column) -> DataFrame:
    """As join_counted() on one column, for a written table ``small`` of wide rows, of ``size`` bytes each. It is broadcast if it has
    few bytes. Else only the names of heavy keys are broadcast; their rows of ``small`` are copied to SALTS salts, over which
    ``spread`` deals those of ``big``, and both sides are shuffled."""
    total, whole = small.agg(F.sum(rows), F.sum(size)).first()
    if (whole or 0) <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on)
    heavy = F.col(rows) > (total or 0) * HEAVY
    salted = big.join(F.broadcast(small.where(heavy).select(on, F.lit(SALTS).alias("__salts"))), on, "left")
    salted = salted.withColumn("__salt", F.pmod(F.xxhash64(spread), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(heavy, SALTS - 1).otherwise(0))))
    return salted.join(copies.hint("merge"), [on, "__salt"]).drop("__salt")
