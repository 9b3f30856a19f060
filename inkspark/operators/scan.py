"""Scans along the rows of a key in two levels, so that one key may hold all rows of a table.

Rows are dealt into ranges of their order, of at most a bounded number of rows. Each range is summed up by itself (a row for each key in
it), the summaries are scanned along each key, and then each range is scanned by itself from what came before or comes after.
Where no key has more rows than a range may have, the plain window does the same and is used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspark.sources.scratch import kept

#: Rows of a range.
ROWS = 1 << 16


def _window(key: list[str], order: list[str], start: int, end: int):
    return Window.partitionBy(*key).orderBy(*order).rowsBetween(start, end)


class Ranges:
    """Rows in ranges of (key, order); scan() adds columns, and rows() are all rows as they are then. Null keys are a key."""

    def __init__(self, df: DataFrame, key: str | list[str], order: str | list[str], rows: int = ROWS) -> None:
        self.key, self.order = [key] if isinstance(key, str) else list(key), [order] if isinstance(order, str) else list(order)
        self.df = kept(df)
        largest = self.df.groupBy(*self.key).count().agg(F.max("count")).first()[0] or 0
        self.split = largest > rows
        if self.split:
            parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
            dealt = self.df.repartitionByRange(parts, *self.key, *self.order).sortWithinPartitions(*self.key, *self.order)
            # The upper bits name the partition, the lower ones count its rows: numbers of ranges rise with the order.
            self.df = kept(dealt.withColumn("__range", F.expr(f"monotonically_increasing_id() div {rows}")))

    def scan(self, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, nexts: dict[str, Column] | None = None, lags: dict[str, Column] | None = None) -> Ranges:
        """Adds for each row: the sum up to and with it (``sums``), the last value up to and with it that is not null (``lasts``),
        the first such from it on (``nexts``), and the value of the row before (``lags``)."""
        past, future = Window.unboundedPreceding, Window.unboundedFollowing
        sums, lasts, nexts, lags = sums or {}, lasts or {}, nexts or {}, {n: F.struct(c.alias("v")) for n, c in (lags or {}).items()}
        names = [*sums, *lasts, *nexts, *lags]
        value = {n: F.col(f"__v_{n}") for n in names}
        df = self.df.withColumns({f"__v_{n}": c for n, c in (sums | lasts | nexts | lags).items()})
        within = [*self.key, *(["__range"] if self.split else [])]
        here, back, on = _window(within, self.order, past, 0), _window(within, self.order, past, -1), _window(within, self.order, 0, future)
        made = {n: F.sum(value[n]).over(here) for n in sums} | {n: F.last(value[n], ignorenulls=True).over(here) for n in lasts}
        made |= {n: F.first(value[n], ignorenulls=True).over(on) for n in nexts} | {n: F.last(value[n], ignorenulls=True).over(back) for n in lags}
        if self.split:
            place = F.struct(*self.order)
            known = lambda n: F.when(value[n].isNotNull(), F.struct(place.alias("at"), value[n].alias("v")))
            parts = [F.sum(value[n]).alias(f"__c_{n}") for n in sums] + [F.max(known(n))["v"].alias(f"__c_{n}") for n in [*lasts, *lags]] + [F.min(known(n))["v"].alias(f"__c_{n}") for n in nexts]
            ranges = df.groupBy(*self.key, "__range").agg(*parts)
            before, after = _window(self.key, ["__range"], past, -1), _window(self.key, ["__range"], 1, future)
            carried = {f"__c_{n}": F.sum(f"__c_{n}").over(before) for n in sums} | {f"__c_{n}": F.last(f"__c_{n}", ignorenulls=True).over(before) for n in [*lasts, *lags]}
            carried |= {f"__c_{n}": F.first(f"__c_{n}", ignorenulls=True).over(after) for n in nexts}
            carried = ranges.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(self.key)), F.col("__range").alias("__r"), *(c.alias(n) for n, c in carried.items()))
            same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(self.key)), F.col("__range") == F.col("__r"))
            df = df.join(carried, same, "left")
            for n in names:
                carry = F.col(f"__c_{n}")
                both = F.when(made[n].isNull(), carry).when(carry.isNull(), made[n]).otherwise(made[n] + carry) if n in sums else F.coalesce(made[n], carry)
                made[n] = both
        made |= {n: made[n]["v"] for n in lags}
        found = df.withColumns(made).select(*(c for c in self.df.columns if c not in names), *names)
        done = object.__new__(Ranges)
        done.key, done.order, done.split, done.df = self.key, self.order, self.split, found
        return done

    def rows(self) -> DataFrame:
        return self.df.drop("__range")


def positions(df: DataFrame, key: str | list[str], order: str | list[str], rows: int = ROWS) -> DataFrame:
    """Adds pos, the place of each row among its key's, from 0."""
    return Ranges(df, key, order, rows).scan(sums={"pos": F.lit(1).cast("long")}).rows().withColumn("pos", F.col("pos") - 1)


def run_numbers(df: DataFrame, key: str | list[str], order: str | list[str], *same: str, rows: int = ROWS) -> DataFrame:
    """Adds run: consecutive rows that agree in ``same`` (null equals null) have one number, from 0."""
    before = Ranges(df, key, order, rows).scan(lags={"__before": F.struct(*same)})
    changed = F.when(F.col("__before").isNull() | F.col("__before").eqNullSafe(F.struct(*same)), 0).otherwise(1).cast("long")
    return before.scan(sums={"run": changed}).rows().drop("__before")
