"""Audio in rows against the same functions on one array."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspark.functions import audio as A
from inkspark.operators import long_audio as L

RATE = 1000


@pytest.fixture(scope="module")
def clips(spark):
    rng = np.random.default_rng(2)
    made = {i: rng.standard_normal(n) * 10.0 ** rng.integers(-8, 3) for i, n in enumerate([1, 2, 9, 10, 11, 400, 1001, 2503])}
    for i in range(20, 32):
        x = np.zeros(500 + 7 * i)
        x[i : 400 - 3 * i] = rng.standard_normal(400 - 4 * i) * 0.1
        made[i] = x
    made |= {40: np.zeros(300), 41: np.zeros(0), 42: np.r_[np.zeros(2999), 5.0], 43: np.r_[337.0, rng.standard_normal(3000) * 0.1], 44: np.full(1000, -0.25), 45: np.r_[np.zeros(995), np.full(5, 0.2)]}
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in made.items()], "clip long, x array<double>").repartition(3)


def whole(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.clip, r.at)):
        assert r.at == len(out.setdefault(r.clip, []))
        out[r.clip] += r.x
    return out


def arrays(df, c="y"):
    return {r.clip: r[c] for r in df.select("clip", F.expr(c)).collect()}


def same(got, want):
    want = {k: v for k, v in want.items() if v or k in got}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=1e-12, atol=0) and len(got[k]) == len(want[k]) for k in want)


@pytest.mark.parametrize("size", [7, 256])
def test_rows_equal_arrays(clips, size):
    rows = L.in_rows(clips, "clip", "x", size)
    assert whole(rows) == arrays(clips, "x")
    same(whole(L.declicked(rows)), arrays(clips.withColumn("y", A.declicked(F.col("x")))))
    same(whole(L.trimmed(rows, RATE)), arrays(clips.withColumn("y", A.trimmed(F.col("x"), F.lit(RATE)))))
    spans = L.silence_spans(rows, RATE)
    want = clips.withColumn("span", A.silence_span(F.col("x"), F.lit(RATE)))
    assert {r.clip: (r.start, r.end) for r in spans.collect()} == {r.clip: (r.span.start, r.span.end) for r in want.collect()}
    same(whole(L.trimmed_with_ramps(rows, spans, RATE, 40)), arrays(want.withColumn("y", A.trimmed_with_ramps(F.col("x"), F.col("span"), F.lit(RATE), F.lit(40)))))


def test_order_statistics_are_exact(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.standard_normal(5000), np.repeat(0.5, 3000), -np.repeat(1e-300, 5), 0.0, -0.0, 1e300, 5e-324]
    rng.shuffle(x)
    rows = L.in_rows(spark.createDataFrame([(1, x.tolist())], "clip long, x array<double>"), "clip", "x", 1000)
    ranks = [0, 1, 2, 6, 7, 100, 4000, 7999, len(x) - 1]
    got = {r.rank: r.v for r in L.order_statistics(rows, spark.createDataFrame([(1, r) for r in ranks], "clip long, rank long")).collect()}
    assert got == {r: np.sort(np.abs(x))[r] for r in ranks}


def test_ten_minutes_in_rows_of_bounded_size(spark):
    """24,000 samples a second, made by the tasks themselves; the level is that of the formula, and no row has more than SIZE samples."""
    n = 600 * 24_000
    begins = spark.range(0, n, L.SIZE, 16).select(F.lit(1).cast("long").alias("clip"), F.col("id").alias("at"))
    tone = F.transform(F.sequence(F.col("at"), F.least(F.col("at") + L.SIZE, F.lit(n)) - 1), lambda i: F.when((i < 480_000) | (i >= n - 720_000), 0.0).otherwise((i * 7919 % 1009 - 504) / 2016.0))
    rows = begins.withColumn("x", tone)
    level = L.quantiles(rows, 0.999).first()
    assert level.v == 504 / 2016
    span = L.silence_spans(rows, 24_000).first()
    assert (span.start, span.end, span.n) == (480_000, n - 720_000, n)
