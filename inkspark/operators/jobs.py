"""Queues and incremental estimates, over rows of jobs and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOW, SOON, LATER = 0, 1, 2


def order_jobs(jobs: DataFrame, queue: str) -> DataFrame:
    """Jobs (queue, priority, seq) with their place: lowest priority number first, arrival within."""
    return jobs.withColumn("place", F.row_number().over(Window.partitionBy(queue).orderBy("priority", "seq")).cast("long"))


def eligible(priority: Column, loaded: Column, busy_guesses: Column) -> Column:
    """One worker of two or more stays free of speculative jobs."""
    return (priority == NOW) | (F.greatest(F.lit(1), loaded - 1) - busy_guesses > 0)


def promote(jobs: DataFrame, key: str) -> DataFrame:
    """Requests for one key are one job, with the most urgent priority and the first arrival."""
    return jobs.groupBy(key).agg(F.min("priority").alias("priority"), F.min("seq").alias("seq"), F.count(F.lit(1)).alias("requests"))


def drop_guesses(jobs: DataFrame, tag: str) -> DataFrame:
    """Queued jobs that stay when the reader turns to ``tag``: urgent ones and its own."""
    return jobs.where((F.col("priority") == NOW) | (F.col("tag") == tag))


def supersede(results: DataFrame, key: str, generation: str) -> DataFrame:
    """Results of each key's latest generation; late ones of others are dropped, never merged."""
    last = results.groupBy(key).agg(F.max(generation).alias(generation))
    return results.join(last, [key, generation], "left_semi")


def contiguous_prefix(packs: DataFrame, key: str) -> DataFrame:
    """How many packs of each key can be delivered in order: up to the first (ord from 0) that is not done."""
    return packs.groupBy(key).agg(F.coalesce(F.min(F.when(~F.col("done"), F.col("ord"))), F.count(F.lit(1))).alias("deliverable"))


#: Values of a queue that one fold takes in order.
SPAN = 8192


def folded(rows: DataFrame, key: str, seq: str, **folds: tuple[Column, Column, Column]) -> DataFrame:
    """For each key the folds of its rows in the order of the whole number ``seq``. A fold's rows are maps a -> least(c, m * a + b),
    given as (c, m, b) with m not negative; such maps make such maps when one follows another. So a range of SPAN
    numbers is folded to one map by itself, and only these few are put in order for each key: no queue is gathered in
    one task. Folds may use the column ``first``, whether a row is its key's first; that one's map must not depend on a (m = 0)."""
    rows = rows.join(rows.groupBy(key).agg(F.min(seq).alias("__first")), key).withColumn("first", F.col(seq) == F.col("__first"))
    maps = F.struct(*[F.struct(c.cast("double").alias("c"), m.cast("double").alias("m"), b.cast("double").alias("b")).alias(name) for name, (c, m, b) in folds.items()])

    def after(first: Column, then: Column) -> Column:
        both = lambda f, g: F.struct(
            F.least(g.c, F.when(g.m == 0, g.b).otherwise(g.m * f.c + g.b)).alias("c"), (g.m * f.m).alias("m"), (g.m * f.b + g.b).alias("b")
        )
        return F.struct(*[both(first[name], then[name]).alias(name) for name in folds])

    none = F.struct(*[F.struct(F.lit(float("inf")).alias("c"), F.lit(1.0).alias("m"), F.lit(0.0).alias("b")).alias(name) for name in folds])
    in_turn = lambda xs: F.aggregate(F.array_sort(xs), none, lambda was, x: after(was, x.map))
    spans = rows.groupBy(key, F.floor(F.col(seq) / SPAN).alias("seq")).agg(in_turn(F.collect_list(F.struct(F.col(seq).alias("at"), maps.alias("map")))).alias("map"))
    whole = spans.groupBy(key).agg(in_turn(F.collect_list(F.struct(F.col("seq").alias("at"), "map"))).alias("map"))
    return whole.select(key, *[F.least(F.col(f"map.{name}.c"), F.col(f"map.{name}.b")).alias(name) for name in folds])


def smoothed(value: Column) -> tuple[Column, Column, Column]:
    """A fold: the first value taken whole, then 0.4 of the way to each further one."""
    return F.lit(float("inf")), F.when(F.col("first"), 0.0).otherwise(0.6), F.when(F.col("first"), value).otherwise(0.4 * value)


def guessed_low(value: Column, start: float) -> tuple[Column, Column, Column]:
    """A fold from ``start``: down at once, up by a twentieth of the way."""
    return value, F.when(F.col("first"), 0.0).otherwise(0.95), F.when(F.col("first"), 0.95 * start + 0.05 * value).otherwise(0.05 * value)


def prefetch(spoken: DataFrame, in_flight: DataFrame, ahead: int = 1) -> DataFrame:
    """Keys (doc_id, sent_id, voice) to make next: for each pack that was asked for (doc_id, through, voice) the ``ahead`` starts
    behind it, once each, but for those in flight."""
    wanted = spoken.select("doc_id", F.explode(F.sequence(F.col("through") + 1, F.col("through") + ahead)).alias("sent_id"), "voice").distinct()
    return wanted.join(in_flight, ["doc_id", "sent_id", "voice"], "left_anti")


def in_flight(log: DataFrame, *key: str) -> DataFrame:
    """Of a log (key, seq, op) of adds and discards, the keys whose last entry is an add."""
    return log.groupBy(*key).agg(F.max_by("op", "seq").alias("op")).where("op = 'add'").select(*key)


def shared_requests(log: DataFrame, key: str) -> DataFrame:
    """Requests of a log (key, seq, op: request or fail) with the request whose job they share: the first one since the key's last
    failure, which evicted the job before."""
    order = Window.partitionBy(key).orderBy("seq")
    lives = log.withColumn("life", F.sum((F.col("op") == "fail").cast("long")).over(order)).where("op = 'request'")
    return lives.withColumn("job", F.min("seq").over(Window.partitionBy(key, "life")))


def throttled(events: DataFrame, key: str, every: str = "250 milliseconds") -> DataFrame:
    """One refill (key, tick, n) for each stretch of ``every`` in which something happened."""
    return events.groupBy(key, F.window("ts", every).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("tick"), "n")


def realtime_ratio(packs: DataFrame, key: str) -> DataFrame:
    """Seconds of audio for each second of work, without the first pack."""
    order = Window.partitionBy(key).orderBy("ord")
    later = packs.withColumn("n", F.row_number().over(order)).where("n > 1")
    return later.groupBy(key).agg((F.sum("audio") / F.sum("work")).alias("ratio"))


def progress(events: DataFrame, key: str) -> DataFrame:
    """Share loaded over the latest event of each (key, file), at most 0.99."""
    last = events.groupBy(key, "file").agg(F.max_by(F.struct("loaded", "total"), F.struct("ts", "seq")).alias("x"))
    return last.groupBy(key).agg(F.least(F.lit(0.99), F.sum("x.loaded") / F.sum("x.total")).alias("progress"))


def overdue(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose kind's deadline has passed: first 30 s, speak 90 s, load 180 s."""
    deadline = F.when(F.col("kind") == "first", 30).when(F.col("kind") == "speak", 90).otherwise(180)
    return jobs.where(now - F.col("started") > deadline)


def debounced(updates: DataFrame, key: str, gap: str = "600 milliseconds") -> DataFrame:
    """The last update (key, ts, seq, value) of each burst: updates less than ``gap`` apart are one burst."""
    burst = updates.groupBy(key, F.session_window("ts", gap).alias("w"))
    return burst.agg(F.max_by("value", F.struct("ts", "seq")).alias("value"), F.count(F.lit(1)).alias("updates")).select(key, F.col("w.start").alias("burst_start"), "value", "updates")


EVENT_FIELDS = ("file", "name", "status", "loaded", "total", "progress", "why")


def plain_event(payload: Column) -> Column:
    """A progress event's JSON as a struct of its seven fields; others are left out, missing ones null."""
    kinds = {"loaded": "bigint", "total": "bigint", "progress": "double"}
    return F.from_json(payload, ", ".join(f"{f} {kinds.get(f, 'string')}" for f in EVENT_FIELDS))
