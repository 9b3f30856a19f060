"""Streaming forms, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from inkspark.streaming import incremental as I
from inkspark.streaming import queues as Q

from .registry import micros, query


def _name(base: str) -> str:
    return f"{base}_{uuid.uuid4().hex[:8]}"


@query("""
    WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM g)
    SELECT user_id, arg_max(event_id, (ts, event_id)) AS value, count(*) AS updates FROM b GROUP BY user_id, burst""")
def stream_debounced_position(spark, d):
    events, folder = I.with_ending(I.events(spark, d))
    stream = I.debounced(events, "user_id", "event_id", "6 hours", "1 hour")
    return I.run_to_end(stream, "append", _name("debounced"), ending=(events.schema, folder)).where("user_id IS NOT NULL").select("user_id", "value", "updates")


@query("SELECT user_id, strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS tick, count(*) AS n FROM events GROUP BY ALL")
def stream_throttled(spark, d):
    """One refill of a user every 6 hours at most."""
    events, folder = I.with_ending(I.events(spark, d))
    stream = I.throttled(events, "user_id", "6 hours", "1 hour")
    rows = I.run_to_end(stream, "append", _name("throttled"), ending=(events.schema, folder)).where("user_id IS NOT NULL")
    return rows.withColumn("tick", F.date_format("tick", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT DISTINCT user_id FROM events")
def stream_dedup(spark, d):
    """One request for each user, whatever arrives within the (long) watermark."""
    return I.run_to_end(I.first_of_key(I.events(spark, d), "user_id", "400 days"), "append", _name("dedup")).select("user_id")


@query("""
    WITH files AS (SELECT user_id AS q, event_type AS file, event_id AS seq, ts, floor(value * 10)::BIGINT AS loaded, floor(value * 10)::BIGINT + user_id % 50 AS total FROM events),
    last AS (SELECT q, file, arg_max(loaded, (ts, seq)) AS loaded, arg_max(total, (ts, seq)) AS total FROM files GROUP BY 1, 2)
    SELECT q, floor(least(0.99::DOUBLE, sum(loaded) / sum(total)::DOUBLE) * 1e6 + 0.5)::BIGINT AS progress_us FROM last GROUP BY 1""")
def stream_progress(spark, d):
    loaded = F.floor(F.col("value") * 10)
    files = I.events(spark, d).select(F.col("user_id").alias("q"), F.col("event_type").alias("file"), F.col("event_id").alias("seq"), "ts", loaded.alias("loaded"), (loaded + F.col("user_id") % 50).alias("total"))
    updates = I.run_to_end(I.file_progress(files, "q"), "update", _name("progress"))
    last = updates.groupBy("q", "file").agg(F.max_by("x", "batch").alias("x"))
    return last.groupBy("q").agg(micros(F.least(F.lit(0.99), F.sum("x.loaded") / F.sum("x.total"))).alias("progress_us"))


def _in_order(stream, key, processor, delay, out, name):
    """The rows of a queue's stream, to the end of what is there."""
    spark = stream.sparkSession
    rows, folder = I.with_ending(stream)
    with Q.state_store(spark):
        return I.run_to_end(Q.in_order(rows, key, processor, delay, out), "append", _name(name), ending=(rows.schema, folder)).where(F.col(key) >= 0)


_HOUR_US = 3_600_000_000


@query(f"""
    WITH e AS (SELECT user_id, ts, event_id, event_type, CASE event_id % 3 WHEN 0 THEN 30 WHEN 1 THEN 90 ELSE 180 END AS hours FROM events),
    f AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS finished FROM e)
    SELECT user_id, event_id AS job, epoch_us(ts) + hours * {_HOUR_US}::BIGINT AS retired_us FROM f WHERE event_type <> 'purchase' AND (finished IS NULL OR finished > ts + to_hours(hours))""")
def stream_retired(spark, d):
    """Events start jobs, and a purchase finishes all of the user's; those running for 30, 90 or 180 hours are retired by a timer."""
    kind = F.when(F.col("event_type") == "purchase", "finish").otherwise(F.element_at(F.array(*map(F.lit, Q.DEADLINES)), (F.col("event_id") % 3 + 1).cast("int")))
    stream = I.events(spark, d).select("user_id", "ts", F.col("event_id").alias("seq"), kind.alias("kind"))
    return _in_order(stream, "user_id", Q.Retired(_HOUR_US), "1 hour", "job long, retired_us long", "retired")


@query(f"""
    WITH e AS (SELECT user_id, ts, event_id, event_type = 'error' AS fail,
            coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 48 * {_HOUR_US}::BIGINT, false) AS silent, count(*) FILTER (event_type = 'error') OVER w AS fails FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    lives AS (SELECT *, count(*) FILTER (silent) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS silences FROM e)
    SELECT user_id, event_id AS seq, first(event_id) OVER (PARTITION BY user_id, fails, silences ORDER BY ts, event_id) AS job FROM lives WHERE NOT fail""")
def stream_shared(spark, d):
    """A user's requests share one job until an error evicts it, or nothing came for 48 hours."""
    stream = I.events(spark, d).select("user_id", "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "fail").otherwise("request").alias("kind"))
    return _in_order(stream, "user_id", Q.Shared(48 * _HOUR_US), "1 hour", "seq long, job long", "shared")


@query("""
    SELECT conv_id, turn, 1 + max((conv_id * 37 + turn * 61) % 101) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS delivered_s FROM conversations""")
def stream_in_turn(spark, d):
    """Turns that come in another order (their seconds are made of their numbers) are delivered in theirs."""
    stream = I.events(spark, d, "conversations.parquet", None)
    at = F.timestamp_seconds(1 + (F.col("conv_id") * 37 + F.col("turn") * 61) % 101)
    rows = _in_order(stream.select("conv_id", at.alias("ts"), F.col("turn").alias("seq"), F.lit("result").alias("kind")), "conv_id", Q.InTurn(3_600_000_000), "10 minutes", "turn long, at_us long", "in_turn")
    return rows.select("conv_id", "turn", F.expr("at_us div 1000000").alias("delivered_s"))
