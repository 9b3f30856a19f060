"""Queues, estimates and rules, over events: a user is a queue, an event a job or a result."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspark.functions import timing as M
from inkspark.operators import jobs as J

from .registry import golden, micros, query, table

_JOBS = "jobs AS (SELECT event_id AS seq, user_id AS q, ts, value, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS priority, 't' || (event_id % 5) AS tag, 'k' || (event_id % 400) AS key, event_type FROM events)"


def _jobs(spark, d):
    p = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("q"), "ts", "value", p.alias("priority"), F.concat(F.lit("t"), F.col("event_id") % 5).alias("tag"), F.concat(F.lit("k"), F.col("event_id") % 400).alias("key"), "event_type")


@query(f"WITH {_JOBS} SELECT q, seq, row_number() OVER (PARTITION BY q ORDER BY priority, seq) AS place, priority = 0 OR greatest(1, 3 - 1) - (q % 4) > 0 AS may_run FROM jobs")
def job_order(spark, d):
    placed = J.order_jobs(_jobs(spark, d), "q")
    return placed.select("q", "seq", "place", J.eligible(F.col("priority"), F.lit(3), F.col("q") % 4).alias("may_run"))


@query(f"WITH {_JOBS} SELECT key, min(priority)::BIGINT AS priority, min(seq) AS seq, count(*) AS requests FROM jobs GROUP BY 1")
def promoted_jobs(spark, d):
    return J.promote(_jobs(spark, d), "key").withColumn("priority", F.col("priority").cast("long"))


@query(f"WITH {_JOBS} SELECT q, seq FROM jobs WHERE priority = 0 OR tag = 't3'")
def dropped_guesses(spark, d):
    return J.drop_guesses(_jobs(spark, d), "t3").select("q", "seq")


@query(f"WITH {_JOBS}, g AS (SELECT *, date_trunc('week', ts) AS gen FROM jobs) SELECT q, seq FROM g WHERE gen = (SELECT max(gen) FROM g h WHERE h.q = g.q)")
def superseded_results(spark, d):
    return J.supersede(_jobs(spark, d).withColumn("gen", F.date_trunc("week", "ts")), "q", "gen").select("q", "seq")


@query(f"""
    WITH {_JOBS}, p AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY seq) - 1 AS ord, event_type <> 'error' AS done FROM jobs)
    SELECT q, coalesce(min(ord) FILTER (NOT done), count(*))::BIGINT AS deliverable FROM p GROUP BY 1""")
def contiguous_prefix(spark, d):
    from pyspark.sql import Window

    packs = _jobs(spark, d).select("q", (F.row_number().over(Window.partitionBy("q").orderBy("seq")) - 1).cast("long").alias("ord"), (F.col("event_type") != "error").alias("done"))
    return J.contiguous_prefix(packs, "q")


@query(f"""
    WITH {_JOBS}, l AS (SELECT q, list(value ORDER BY seq) AS v FROM jobs GROUP BY 1)
    SELECT q, floor(list_reduce(v, lambda a, x: a + 0.4::DOUBLE * (x - a)) * 1e6 + 0.5001)::BIGINT AS ratio_us, floor(list_reduce(list_prepend(14.0::DOUBLE, v), lambda a, x: CASE WHEN x < a THEN x ELSE a + 0.05::DOUBLE * (x - a) END) * 1e6 + 0.5001)::BIGINT AS rate_us FROM l""")
def smoothed_estimates(spark, d):
    done = J.folded(_jobs(spark, d), "q", "seq", ratio=J.smoothed(F.col("value")), rate=J.guessed_low(F.col("value"), 14.0))
    near = lambda c: F.floor(F.col(c) * 1e6 + 0.5001).cast("long")  # noqa: E731  values of two decimals end in ties, which the order of steps must not decide
    return done.select("q", near("ratio").alias("ratio_us"), near("rate").alias("rate_us"))


@query(f"""
    WITH {_JOBS}, p AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY seq) AS n, floor(value * 100)::BIGINT AS audio, floor(value * 37)::BIGINT + 1 AS work FROM jobs)
    SELECT q, floor(sum(audio) / sum(work)::DOUBLE * 1e6 + 0.5)::BIGINT AS ratio_us FROM p WHERE n > 1 GROUP BY 1""")
def realtime_ratio(spark, d):
    packs = _jobs(spark, d).select("q", F.col("seq").alias("ord"), F.floor(F.col("value") * 100).alias("audio"), (F.floor(F.col("value") * 37) + 1).alias("work"))
    return J.realtime_ratio(packs, "q").select("q", micros(F.col("ratio")).alias("ratio_us"))


_FILES = "files AS (SELECT user_id AS q, event_type AS file, event_id AS seq, ts, floor(value * 10)::BIGINT AS loaded, floor(value * 10)::BIGINT + user_id % 50 AS total FROM events)"


def _files(spark, d):
    loaded = F.floor(F.col("value") * 10)
    return table(spark, d, "events").select(F.col("user_id").alias("q"), F.col("event_type").alias("file"), F.col("event_id").alias("seq"), "ts", loaded.alias("loaded"), (loaded + F.col("user_id") % 50).alias("total"))


@query(f"""
    WITH {_FILES}, last AS (SELECT q, file, arg_max(loaded, (ts, seq)) AS loaded, arg_max(total, (ts, seq)) AS total FROM files GROUP BY 1, 2)
    SELECT q, floor(least(0.99::DOUBLE, sum(loaded) / sum(total)::DOUBLE) * 1e6 + 0.5)::BIGINT AS progress_us FROM last GROUP BY 1""")
def download_progress(spark, d):
    return J.progress(_files(spark, d), "q").select("q", micros(F.col("progress")).alias("progress_us"))


@query(f"WITH {_JOBS} SELECT seq FROM jobs WHERE 200 - (seq % 200) > CASE event_type WHEN 'view' THEN 30 WHEN 'click' THEN 90 ELSE 180 END")
def overdue_jobs(spark, d):
    kind = F.when(F.col("event_type") == "view", "first").when(F.col("event_type") == "click", "speak").otherwise("load")
    return J.overdue(_jobs(spark, d).select("seq", kind.alias("kind"), (F.col("seq") % 200).alias("started")), F.lit(200)).select("seq")


@query("""
    WITH g AS (SELECT user_id AS q, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY q ORDER BY ts) AS burst FROM g)
    SELECT q, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS burst_start, arg_max(event_id, (ts, event_id)) AS value, count(*) AS updates FROM b GROUP BY q, burst""")
def debounced_updates(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("q"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_id").alias("value"))
    return J.debounced(e, "q", "6 hours").withColumn("burst_start", F.date_format("burst_start", "yyyy-MM-dd HH:mm:ss"))


@query(f"""
    WITH {_JOBS}, spoken AS (SELECT q AS doc_id, seq % 30 AS through, tag AS voice FROM jobs WHERE event_type = 'view'),
    log AS (SELECT q AS doc_id, seq % 30 + 1 AS sent_id, tag AS voice, seq, CASE event_type WHEN 'click' THEN 'add' ELSE 'discard' END AS op FROM jobs WHERE event_type IN ('click', 'error')),
    flying AS (SELECT doc_id, sent_id, voice FROM (SELECT doc_id, sent_id, voice, arg_max(op, seq) AS op FROM log GROUP BY ALL) WHERE op = 'add'),
    wanted AS (SELECT DISTINCT doc_id, through + unnest([1, 2]) AS sent_id, voice FROM spoken)
    SELECT w.* FROM wanted w ANTI JOIN flying f ON w.doc_id = f.doc_id AND w.sent_id = f.sent_id AND w.voice = f.voice""")
def prefetched_packs(spark, d):
    """The two packs behind each one asked for, but for those in flight: added by a click and not discarded by an error since."""
    jobs = _jobs(spark, d)
    spoken = jobs.where("event_type = 'view'").select(F.col("q").alias("doc_id"), (F.col("seq") % 30).alias("through"), F.col("tag").alias("voice"))
    op = F.when(F.col("event_type") == "click", "add").otherwise("discard")
    log = jobs.where("event_type IN ('click', 'error')").select(F.col("q").alias("doc_id"), (F.col("seq") % 30 + 1).alias("sent_id"), F.col("tag").alias("voice"), "seq", op.alias("op"))
    return J.prefetch(spoken, J.in_flight(log, "doc_id", "sent_id", "voice"), ahead=2)


@query(f"""
    WITH {_JOBS}, log AS (SELECT key, seq, CASE event_type WHEN 'error' THEN 'fail' ELSE 'request' END AS op FROM jobs),
    lives AS (SELECT *, count(*) FILTER (op = 'fail') OVER (PARTITION BY key ORDER BY seq) AS life FROM log)
    SELECT key, seq, min(seq) OVER (PARTITION BY key, life) AS job FROM lives WHERE op = 'request'""")
def shared_jobs(spark, d):
    """Requests for one key share a job until it fails."""
    log = _jobs(spark, d).select("key", "seq", F.when(F.col("event_type") == "error", "fail").otherwise("request").alias("op"))
    return J.shared_requests(log, "key").select("key", "seq", "job")


@query("""
    SELECT user_id AS q, strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS tick, count(*) AS n FROM events GROUP BY ALL""")
def throttled_refills(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("q"), F.col("ts").cast("timestamp").alias("ts"))
    return J.throttled(e, "q", "6 hours").withColumn("tick", F.date_format("tick", "yyyy-MM-dd HH:mm:ss"))


_MACHINES = [
    (1, 8, 16.0, None, None, False, True, False, None, True), (2, 8, 16.0, "small", None, False, True, False, None, True), (3, 8, 16.0, None, "3g", False, True, False, None, True),
    (4, 8, 16.0, "big", "3g", True, True, False, None, True), (5, 8, 2.0, None, "4g", False, True, False, None, True), (6, 12, 0.0, None, None, False, True, True, None, True),
    (7, 12, 8.0, None, None, False, False, False, None, False), (8, 4, 0.0, None, None, False, True, False, 1000, True), (9, 4, 0.0, "big", None, False, False, False, None, True), (10, 16, 4.0, None, None, False, False, False, None, True),
]


@golden("""
    SELECT * FROM (VALUES (1::BIGINT, 'webgpu', 'fp32', 'gpu', 1::BIGINT, 6::BIGINT), (2, 'wasm', 'q8', 'chosen', 2, 4), (3, 'wasm', 'q8', 'metered', 2, 4), (4, 'webgpu', 'fp32', 'gpu', 1, 6), (5, 'wasm', 'q8', 'memory', 2, 4),
        (6, 'wasm', 'fp32', 'cores', 2, 6), (7, 'wasm', 'q8', 'not isolated', 3, 4), (8, 'wasm', 'q8', 'small machine', 1, 4), (9, 'wasm', 'fp32', 'cores', 1, 4), (10, 'wasm', 'q8', 'small machine', 3, 5)) t(id, device, dtype, why, workers, threads)""")
def pick_backend(spark, d):
    m = spark.createDataFrame(_MACHINES, "id long, cores int, memory double, preference string, net string, save_data boolean, gpu boolean, fallback boolean, max_buffer long, isolated boolean")
    has_gpu = M.usable_gpu(F.col("gpu"), F.col("fallback"), F.col("max_buffer"))
    m = m.withColumn("b", M.pick_backend(F.col("cores"), F.col("memory"), F.col("preference"), M.metered(F.col("save_data"), F.col("net")), has_gpu, F.col("isolated")))
    workers = M.worker_budget(F.col("b.device"), F.col("b.dtype"), F.col("cores"), F.col("memory"))
    return m.select("id", "b.device", "b.dtype", "b.why", workers.cast("long").alias("workers"), M.thread_count(F.col("cores"), workers).cast("long").alias("threads"))


_CAPABLE = """SELECT c_custkey AS id, (1 + c_custkey % 16)::INT AS cores, ([0.0, 2.0, 4.0, 8.0, 16.0])[(c_custkey % 5 + 1)::INT]::DOUBLE AS memory, ([NULL, 'small', 'big'])[(c_custkey % 3 + 1)::INT] AS preference,
        ([NULL, '2g', '3g', '4g'])[(c_custkey % 4 + 1)::INT] AS net, c_custkey % 11 = 0 AS save_data, c_nationkey % 2 = 0 AS gpu, c_nationkey % 7 = 0 AS fallback,
        ([NULL, 0, 1000, 300000000])[(c_nationkey % 4 + 1)::INT]::BIGINT AS max_buffer, c_nationkey % 3 > 0 AS isolated FROM customer"""


@query(f"""
    WITH m AS ({_CAPABLE}),
    t AS (SELECT *, save_data OR coalesce(net, '') IN ('slow-2g', '2g', '3g') AS metered, gpu AND NOT fallback AND NOT (coalesce(max_buffer, 0) <> 0 AND coalesce(max_buffer, 0) < 256000000) AS usable FROM m),
    w AS (SELECT *, CASE WHEN preference = 'small' THEN 'chosen' WHEN preference IS DISTINCT FROM 'big' AND metered THEN 'metered' WHEN preference IS DISTINCT FROM 'big' AND memory > 0 AND memory < 4 THEN 'memory'
            WHEN usable THEN 'gpu' WHEN isolated AND (preference IS NOT DISTINCT FROM 'big' OR (cores >= 8 AND (memory = 0 OR memory >= 8))) THEN 'cores' WHEN NOT isolated THEN 'not isolated' ELSE 'small machine' END AS why FROM t),
    b AS (SELECT *, CASE why WHEN 'gpu' THEN 'webgpu' ELSE 'wasm' END AS device, CASE WHEN why IN ('gpu', 'cores') THEN 'fp32' ELSE 'q8' END AS dtype FROM w),
    n AS (SELECT *, CASE WHEN device = 'webgpu' THEN 1 WHEN dtype = 'fp32' THEN CASE WHEN memory > 0 AND memory < 8 THEN 1 WHEN cores >= 12 THEN 2 ELSE 1 END WHEN cores >= 12 THEN 3 WHEN cores >= 8 THEN 2 ELSE 1 END AS workers FROM b)
    SELECT id, device, dtype, why, workers::BIGINT AS workers, greatest(1, least(6, cores // workers))::BIGINT AS threads, CASE WHEN device = 'webgpu' THEN 120 WHEN dtype = 'fp32' THEN 650 ELSE 1050 END::BIGINT AS hint_thousandths FROM n""")
def machine_backends(spark, d):
    """A backend for each customer's machine, with its workers, threads and first guess of the ratio."""
    c, key, land = table(spark, d, "customer"), F.col("c_custkey"), F.col("c_nationkey")
    pick = lambda by, values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), (by % len(values)).cast("int"))
    m = c.select(
        key.alias("id"), (1 + key % 16).cast("int").alias("cores"), pick(key, [0.0, 2.0, 4.0, 8.0, 16.0], "double").alias("memory"), pick(key, [None, "small", "big"], "string").alias("preference"),
        pick(key, [None, "2g", "3g", "4g"], "string").alias("net"), (key % 11 == 0).alias("save_data"), (land % 2 == 0).alias("gpu"), (land % 7 == 0).alias("fallback"),
        pick(land, [None, 0, 1000, 300_000_000], "long").alias("max_buffer"), (land % 3 > 0).alias("isolated"),
    )
    usable = M.usable_gpu(F.col("gpu"), F.col("fallback"), F.col("max_buffer"))
    m = m.withColumn("b", M.pick_backend(F.col("cores"), F.col("memory"), F.col("preference"), M.metered(F.col("save_data"), F.col("net")), usable, F.col("isolated"))).select("id", "cores", "memory", "b.*")
    workers, hint = M.worker_budget(F.col("device"), F.col("dtype"), F.col("cores"), F.col("memory")), M.ratio_hint(F.col("device"), F.col("dtype"))
    return m.select("id", "device", "dtype", "why", workers.cast("long").alias("workers"), M.thread_count(F.col("cores"), workers).cast("long").alias("threads"), F.floor(hint * 1000 + 0.5).cast("long").alias("hint_thousandths"))


@golden("SELECT * FROM (VALUES ('webgpu', 'fp32', 120::BIGINT, 220::BIGINT), ('wasm', 'fp32', 650, 40), ('wasm', 'q8', 1050, 40)) t(device, dtype, hint_thousandths, tail)")
def backend_hints(spark, d):
    rows = spark.createDataFrame([("webgpu", "fp32"), ("wasm", "fp32"), ("wasm", "q8")], "device string, dtype string")
    return rows.select("device", "dtype", F.floor(M.ratio_hint(F.col("device"), F.col("dtype")) * 1000 + 0.5).cast("long").alias("hint_thousandths"), M.tail_ms(F.col("device") == "webgpu").cast("long").alias("tail"))
