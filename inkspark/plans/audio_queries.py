"""Sample arrays, over embeddings (64 samples at 1,000 a second)."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspark.functions import audio as A
from inkspark.operators import long_audio as LA
from inkspark.sources import readers, sinks
from inkspark.sources.scratch import kept, scratch

from .registry import ORACLE_SQL, golden, micros, query, table

RATE = 1000
#: DuckDB: samples as rows.
_X = "x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"


def _samples(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


@query(f"""
    WITH {_X}, l AS (SELECT *, lag(v) OVER (PARTITION BY vec_id ORDER BY i) AS p FROM x)
    SELECT vec_id, count(*) AS samples, floor(sqrt(sum(v * v) / count(*)) * 1e6 + 0.5)::BIGINT AS rms_us, floor(max(abs(v)) * 1e6 + 0.5)::BIGINT AS peak_us, count(*) FILTER (abs(v) >= 0.999) AS clipped,
           floor(count(*) FILTER (abs(v) < 1e-4) / count(*)::DOUBLE * 1e6 + 0.5)::BIGINT AS silent_us, floor(count(*) FILTER ((p < 0) <> (v < 0)) / count(*)::DOUBLE * 1e6 + 0.5)::BIGINT AS zcr_us FROM l GROUP BY 1""")
def wave_stats(spark, d):
    s = _samples(spark, d).select("vec_id", F.size("x").cast("long").alias("samples"), A.stats(F.col("x"), F.lit(RATE)).alias("s"))
    return s.select("vec_id", "samples", micros(F.col("s.rms")).alias("rms_us"), micros(F.col("s.peak")).alias("peak_us"), F.col("s.clipped").cast("long").alias("clipped"), micros(F.col("s.silent_fraction")).alias("silent_us"), micros(F.col("s.zcr")).alias("zcr_us"))


@query(f"WITH {_X} SELECT vec_id, (i - 1) // 8 AS bin, floor(sqrt(sum(v * v) / count(*)) * 1e6 + 0.5)::BIGINT AS rms_us FROM x GROUP BY 1, 2")
def loudness_envelope(spark, d):
    rows = _samples(spark, d).select("vec_id", F.posexplode(A.envelope(F.col("x"), 8)).alias("bin", "e"))
    return rows.select("vec_id", F.col("bin").cast("long").alias("bin"), micros(F.col("e")).alias("rms_us"))


@query("""
    WITH r AS (SELECT a.vec_id, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1)
    SELECT vec_id, floor(corr(x, y) * 1e6 + 0.5)::BIGINT AS corr_us FROM r GROUP BY 1""")
def envelope_correlation(spark, d):
    """Each clip with the one before it; vec_ids are dense, so an equality join finds it and no label's clips meet in one task."""
    e = _samples(spark, d)
    before = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("x").alias("y"))
    return e.join(before, "vec_id").select("vec_id", micros(A.correlation(F.col("x"), F.col("y"))).alias("corr_us"))


@query(f"""
    WITH {_X}, z AS (SELECT vec_id, i, CASE WHEN vec_id % 31 = 0 AND i = 3 THEN 'nan'::DOUBLE WHEN vec_id % 13 = 0 THEN v / 100 WHEN vec_id % 7 = 0 AND i > 20 THEN 0.0 ELSE v * (1 + vec_id % 5) END AS v FROM x),
    l AS (SELECT *, lag(v) OVER (PARTITION BY vec_id ORDER BY i) AS p FROM z),
    s AS (SELECT vec_id, count(*) / 1000.0::DOUBLE AS seconds, sqrt(sum(v * v) / count(*)) AS rms, count(*) FILTER (abs(v) >= 0.999) AS clipped, count(*) FILTER (abs(v) < 1e-4) / count(*)::DOUBLE AS silent,
          count(*) FILTER ((p < 0) <> (v < 0)) / count(*)::DOUBLE AS zcr, bool_or(isnan(v)) AS broken FROM l GROUP BY 1),
    b AS (SELECT s.*, base.zcr AS base_zcr, base.seconds * (1 + (s.vec_id % 3) / 4.0::DOUBLE) AS base_seconds FROM s LEFT JOIN s base ON base.vec_id = s.vec_id - 1 AND NOT base.broken)
    SELECT vec_id, CASE WHEN broken THEN 'non-finite' ELSE concat_ws(',', CASE WHEN seconds > (vec_id % 2) / 5.0::DOUBLE THEN 'too long' END, CASE WHEN rms < 0.01 THEN 'near-silent' END, CASE WHEN silent > 0.6 THEN 'silence' END,
        CASE WHEN clipped > 8 THEN 'clipped' END, CASE WHEN seconds < base_seconds * 0.8::DOUBLE THEN 'shorter than baseline' END, CASE WHEN zcr > base_zcr * 1.5::DOUBLE THEN 'brighter than baseline' END) END AS flags FROM b""")
def clip_verdict(spark, d):
    """Flags of each clip, some of them made quiet, cut short, loud or broken; the clip before is the baseline, taken to be longer for
    two clips in three; clips with an odd id speak one character, the others none."""
    key, v = F.col("vec_id"), lambda v, i: F.when((key % 31 == 0) & (i == 2), F.lit(float("nan"))).when(key % 13 == 0, v / 100).when((key % 7 == 0) & (i > 19), F.lit(0.0)).otherwise(v * (1 + key % 5))
    s = _samples(spark, d).select("vec_id", A.stats(F.transform("x", v), F.lit(RATE)).alias("s"))
    base = s.where(~F.isnan("s.rms")).select((key + 1).alias("vec_id"), F.col("s").alias("b"))
    both = s.join(base, "vec_id", "left")
    longer = F.struct((F.col("b.seconds") * (1 + (key % 3) / 4)).alias("seconds"), F.col("b.zcr").alias("zcr"))
    return both.select("vec_id", F.array_join(A.verdict(F.col("s"), key % 2, longer), ",").alias("flags"))


@query(f"""
    WITH {_X}, s AS (SELECT vec_id, quantile_cont(abs(v), 0.999) * 1.5 AS most FROM x GROUP BY 1),
    c AS (SELECT vec_id, i, greatest(-most, least(most, v)) AS v FROM x JOIN s USING (vec_id)),
    p AS (SELECT vec_id, max(abs(v)) AS peak FROM c GROUP BY 1), z AS (SELECT vec_id, i, v * (0.92 / peak) AS v FROM c JOIN p USING (vec_id)),
    t AS (SELECT vec_id, min(i - 1) FILTER (abs(v) > 0.92 * pow(10, -42.0 / 20)) AS a, max(i - 1) FILTER (abs(v) > 0.92 * pow(10, -42.0 / 20)) AS b FROM z GROUP BY 1)
    SELECT z.vec_id, count(*) FILTER (i - 1 >= greatest(0, a - 1) AND i - 1 < least(64, b + 1)) AS samples, floor(max(abs(v)) * 1e6 + 0.5)::BIGINT AS peak_us,
           floor(sum(abs(v)) FILTER (i - 1 >= greatest(0, a - 1) AND i - 1 < least(64, b + 1)) * 1e3 + 0.5)::BIGINT AS total_ms FROM z JOIN t USING (vec_id) GROUP BY 1""")
def declick_normalise(spark, d):
    rows = _samples(spark, d).select("vec_id", A.declicked(A.finite(F.col("x"))).alias("y"))
    rows = rows.select("vec_id", "y", A.trimmed(F.col("y"), F.lit(RATE), pad_ms=1).alias("z"))
    return rows.select("vec_id", F.size("z").cast("long").alias("samples"), micros(F.array_max(F.transform("y", F.abs))).alias("peak_us"), F.floor(A.total(F.transform("z", F.abs)) * 1e3 + 0.5).cast("long").alias("total_ms"))


@golden("""
    SELECT * FROM (VALUES (1::BIGINT, 740::BIGINT, 1980::BIGINT, 1300::BIGINT), (2::BIGINT, 90::BIGINT, 100::BIGINT, 30::BIGINT), (3::BIGINT, 0::BIGINT, 100::BIGINT, 100::BIGINT)) t(id, start, last, samples)""")
def silence_trim(spark, d):
    """A clip with a tone from sample 745 to 1980, silence (of which the last window stays), and a tone throughout."""
    tone = F.transform(F.sequence(F.lit(0), F.lit(2499)), lambda i: F.when((i >= 745) & (i < 1980), F.lit(0.5)).otherwise(F.lit(0.0)))
    flat = lambda v: F.transform(F.sequence(F.lit(0), F.lit(99)), lambda _: F.lit(v))
    rows = spark.range(1, 4).select("id", F.when(F.col("id") == 1, tone).when(F.col("id") == 2, flat(0.0)).otherwise(flat(0.5)).alias("x"))
    rows = rows.withColumn("span", A.silence_span(F.col("x"), F.lit(RATE)))
    cut = A.trimmed_with_ramps(F.col("x"), F.col("span"), F.lit(RATE), F.lit(40))
    return rows.select("id", F.col("span.start").cast("long").alias("start"), F.col("span.end").cast("long").alias("last"), F.size(cut).cast("long").alias("samples"))


@query("""
    WITH z AS (SELECT a.vec_id, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, floor(sum(x * 0.6::DOUBLE + y * 0.4::DOUBLE) * 1e6 + 0.5)::BIGINT AS total_us FROM z GROUP BY 1""")
def style_blend(spark, d):
    e = _samples(spark, d)
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    return pairs.select("vec_id", micros(A.total(A.blended([(0.6, F.col("x")), (0.4, F.col("y"))]))).alias("total_us"))


@query("""
    WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS x, vec_id % 20 AS a, 64 - vec_id % 17 AS b FROM embeddings),
    v AS (SELECT vec_id, i - 1 AS i, CASE WHEN i - 1 >= a AND i - 1 < b THEN x[i] ELSE 0.0 END AS v FROM q, (SELECT unnest(generate_series(1, 64)) AS i)),
    f AS (SELECT vec_id, min(k * 10) AS first FROM (SELECT vec_id, k, k * 10 + 10 >= 64 OR (SELECT sqrt(sum(v * v) / count(*)) FROM v w WHERE w.vec_id = q.vec_id AND w.i >= k * 10 AND w.i < least(64, k * 10 + 10)) >= 0.004 AS stops
        FROM q, (SELECT unnest(generate_series(0, 6)) AS k)) WHERE stops GROUP BY 1),
    l AS (SELECT vec_id, max(64 - k * 10) AS last FROM (SELECT q.vec_id, k, 54 - k * 10 <= first OR (SELECT sqrt(sum(v * v) / count(*)) FROM v w WHERE w.vec_id = q.vec_id AND w.i >= greatest(0, 54 - k * 10) AND w.i < 64 - k * 10) >= 0.004 AS stops
        FROM q JOIN f USING (vec_id), (SELECT unnest(generate_series(0, 6)) AS k)) WHERE stops GROUP BY 1)
    SELECT vec_id, first::BIGINT AS start, last::BIGINT AS last FROM f JOIN l USING (vec_id)""")
def silence_spans(spark, d):
    """Where each clip, with silence put before and behind, is not silent: windows of 10 samples."""
    key = F.col("vec_id")
    quiet = F.transform("x", lambda v, i: F.when((i >= key % 20) & (i < 64 - key % 17), v).otherwise(0.0))
    spans = _samples(spark, d).select("vec_id", quiet.alias("x")).select("vec_id", A.silence_span(F.col("x"), F.lit(RATE)).alias("s"))
    return spans.select("vec_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("last"))


@query("""
    SELECT vec_id, CASE vec_id % 4 WHEN 3 THEN 0 ELSE 64 END::BIGINT AS samples, CASE vec_id % 4 WHEN 0 THEN 16000 WHEN 1 THEN 22050 ELSE 24000 END::BIGINT AS rate FROM embeddings""")
def result_shapes(spark, d):
    """Samples and rate beside each other, one level down, without a rate, and absent."""
    kind = F.col("vec_id") % 4
    rows = _samples(spark, d).select("vec_id", A.shaped(F.when(kind == 1, F.col("x")), F.when(kind == 1, 22050), F.when(kind.isin(0, 2), F.col("x")), F.when(kind == 0, 16000).otherwise(0)).alias("r"))
    return rows.select("vec_id", F.size("r.samples").cast("long").alias("samples"), F.col("r.rate").cast("long").alias("rate"))


@query(f"WITH {_X} SELECT vec_id, i - 1 AS i, trunc(CASE WHEN v * 8 < 0 THEN greatest(-1.0, v * 8) * 32768 ELSE least(1.0, v * 8) * 32767 END)::BIGINT AS pcm FROM x")
def pcm16(spark, d):
    rows = _samples(spark, d).select("vec_id", F.posexplode(A.pcm16(F.transform("x", lambda v: v * 8))).alias("i", "pcm"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), F.col("pcm").cast("long").alias("pcm"))


@query("SELECT vec_id::VARCHAR AS name, 24000::BIGINT AS rate, 1::BIGINT AS channels, 16::BIGINT AS bits, (len(embedding) * 2)::BIGINT AS data_bytes, (44 + 2 * len(embedding))::BIGINT AS bytes FROM embeddings")
def wav_round_trip(spark, d):
    files = sinks.wav_files(_samples(spark, d), "vec_id", "x", 24000)
    return files.select("name", A.wav_header(F.col("content")).alias("h"), F.octet_length("content").cast("long").alias("bytes")).select("name", "h.rate", "h.channels", "h.bits", "h.data_bytes", "bytes")


@query("SELECT vec_id::VARCHAR || '.wav' AS name, (44 + 2 * len(embedding))::BIGINT AS bytes, 24000::BIGINT AS rate, (2 * len(embedding))::BIGINT AS data_bytes FROM embeddings")
def published_audio(spark, d):
    """WAV files written to the shared folder, each whole or not at all, and their headers read back."""
    files = sinks.wav_files(readers.spread(_samples(spark, d)), "vec_id", "x", 24000)
    listed = kept(sinks.publish(files.withColumn("name", F.concat("name", F.lit(".wav"))), scratch(spark)))
    read = readers.read_wav_headers(spark, listed).join(listed, "path")
    return read.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "bytes", "rate", "data_bytes")


@golden("SELECT * FROM (VALUES ('adam', 95::BIGINT, 2::BIGINT), ('aria', 93, 2), ('emma', 93, 1), ('george', 95, 1), ('river', 91, 2), ('sky', 100, 1)) t(preset, speed_percent, voices)")
def voice_presets(spark, d):
    return readers.presets(spark).select("preset", F.round(F.col("base_speed") * 100).cast("long").alias("speed_percent"), F.size("blend").cast("long").alias("voices"))


_LONG = "SELECT vec_id // 40 AS clip, vec_id % 40 * 64 + i - 1 AS place, embedding[i]::DOUBLE AS v FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i)"


def _long_rows(spark, d):
    """Clips of 40 vectors one after another."""
    return _samples(spark, d).select(F.floor(F.col("vec_id") / 40).alias("clip"), (F.col("vec_id") % 40 * 64).alias("at"), "x")


@query(f"""
    WITH x AS ({_LONG}), q AS (SELECT clip, 1.5 * quantile_cont(abs(v), 0.999) AS most, max(abs(v)) AS peak FROM x GROUP BY 1)
    SELECT clip, place, floor(greatest(-most, least(most, v)) * (0.92::DOUBLE / least(peak, most)) * 1e6 + 0.5)::BIGINT AS y_us FROM x JOIN q USING (clip)""")
def long_declicked(spark, d):
    """Clips whose samples are in many rows, clipped and scaled."""
    rows = LA.declicked(_long_rows(spark, d)).select("clip", F.col("at").alias("first"), F.posexplode("x").alias("i", "y"))
    return rows.select("clip", (F.col("first") + F.col("i")).alias("place"), micros(F.col("y")).alias("y_us"))


@query(f"""
    WITH x AS ({_LONG}), q AS (SELECT clip, max(abs(v)) * pow(10.0::DOUBLE, -12.0 / 20) AS loud, count(*) AS n FROM x GROUP BY 1),
    s AS (SELECT clip, greatest(0, min(place) FILTER (abs(v) > loud) - 600) AS first, least(any_value(n), max(place) FILTER (abs(v) > loud) + 600) AS last FROM x JOIN q USING (clip) GROUP BY 1)
    SELECT clip, (last - first)::BIGINT AS n, floor(sum(v) * 1e6 + 0.5)::BIGINT AS sum_us FROM x JOIN s USING (clip) WHERE place >= first AND place < last GROUP BY ALL""")
def long_trimmed(spark, d):
    """What is left of clips in many rows from 25 ms before the first sample within 12 dB of the peak to 25 ms after the last."""
    rows = LA.trimmed(_long_rows(spark, d), 24_000, -12.0).groupBy("clip").agg(F.sum(F.size("x")).alias("n"), F.sum(A.total(F.col("x"))).alias("sum"))
    return rows.select("clip", "n", micros(F.col("sum")).alias("sum_us"))


@query(f"""
    WITH s AS ({ORACLE_SQL["silence_spans"]}), x AS (SELECT vec_id, i - 1 AS i, CASE WHEN i - 1 >= vec_id % 20 AND i - 1 < 64 - vec_id % 17 THEN embedding[i]::DOUBLE ELSE 0.0 END AS v FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i)),
    c AS (SELECT vec_id, greatest(0, start - 20) AS a, least(64, last + 5) AS b, last <= start AS quiet FROM s),
    g AS (SELECT x.*, quiet, i - a AS k, b - a AS n, least(3, (b - a) // 2) AS ramp FROM x JOIN c USING (vec_id) WHERE quiet OR (i >= a AND i < b))
    SELECT vec_id, count(*) AS n, floor(sum(v * CASE WHEN quiet THEN 1.0 ELSE CASE WHEN k < ramp THEN k / ramp::DOUBLE ELSE 1.0 END * CASE WHEN n - 1 - k < ramp THEN (n - 1 - k) / ramp::DOUBLE ELSE 1.0 END END) * 1e6 + 0.5)::BIGINT AS sum_us FROM g GROUP BY 1""")
def ramped_clips(spark, d):
    """Clips cut to what is not silent, with 20 samples before and 5 after, and ramps of 3 samples."""
    key = F.col("vec_id")
    quiet = F.transform("x", lambda v, i: F.when((i >= key % 20) & (i < 64 - key % 17), v).otherwise(0.0))
    rows = _samples(spark, d).select("vec_id", quiet.alias("x")).withColumn("span", A.silence_span(F.col("x"), F.lit(RATE)))
    cut = rows.select("vec_id", A.trimmed_with_ramps(F.col("x"), F.col("span"), F.lit(RATE), F.lit(5)).alias("y"))
    return cut.select("vec_id", F.size("y").cast("long").alias("n"), micros(A.total(F.col("y"))).alias("sum_us"))
