"""Two-level scans and clips by composed block maps against plain windows and plain loops, with one key holding most rows."""

import bisect
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from inkspark.operators import navigation as N
from inkspark.operators import packing as P
from inkspark.operators import scan
from inkspark.operators.layout import with_runs


@pytest.fixture(scope="module")
def hot(spark):
    """One document of 5,000 sentences, 40 of a few, and a null one."""
    rng = random.Random(4)
    rows = [(7, 3 * i, rng.choice(["body", "body", "header"]), "x" * rng.randint(1, 200), rng.choice([None, 1, 2])) for i in range(5000)]
    rows += [(d, i, "body" if i % 3 else "footer", "y" * (10 + i), None) for d in range(100, 140) for i in range(d % 9)] + [(None, i, "body", "z", i) for i in range(60)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, sent_id long, kind string, text string, v long").repartition(5)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_scan_equals_windows(hot):
    by = Window.partitionBy("doc_id").orderBy("sent_id")
    up, back, on = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    columns = ["doc_id", "sent_id", "s", "l", "n", "p", "pos", "run"]
    want = hot.withColumns({"s": F.sum("v").over(up), "l": F.last("v", True).over(up), "n": F.first("v", True).over(on), "p": F.lag("v").over(by), "pos": F.row_number().over(by) - 1})
    want = with_runs(want, "doc_id", "sent_id", "kind", "v").select(columns)
    for rows in (100, 1 << 16):
        ranges = scan.Ranges(hot, "doc_id", "sent_id", rows)
        assert ranges.split == (rows == 100)
        got = ranges.scan(sums={"s": F.col("v")}, lasts={"l": F.col("v")}, nexts={"n": F.col("v")}, lags={"p": F.col("v")}).rows()
        got = scan.run_numbers(scan.positions(got, "doc_id", "sent_id", rows), "doc_id", "sent_id", "kind", "v", rows=rows)
        assert rows_of(got.select(columns)) == rows_of(want)


def test_no_range_is_large(hot):
    ranges = scan.Ranges(hot, "doc_id", "sent_id", 100).df
    assert ranges.groupBy("__range").count().agg(F.max("count")).first()[0] <= 100
    assert ranges.where("doc_id = 7").select("__range").distinct().count() >= 50


def test_navigation_equals_windows(hot):
    for f in (N.neighbours, N.readable_ids, lambda s, rows: N.scrub(s, F.lit(0.6), rows), lambda s, rows: P.part_starts(s.select(F.col("doc_id").alias("clip"), F.col("sent_id").alias("part"), F.length("text").alias("words")), rows)):
        assert rows_of(f(hot, rows=64)) == rows_of(f(hot, rows=1 << 16))
    by = Window.partitionBy("doc_id").orderBy("sent_id")
    ok = F.when(F.col("kind") == "body", F.col("sent_id"))
    want = hot.withColumns({"next_readable": F.first(ok, True).over(by.rowsBetween(0, Window.unboundedFollowing)), "prev_readable": F.last(ok, True).over(by.rowsBetween(Window.unboundedPreceding, 0))})
    assert rows_of(N.neighbours(hot, rows=64).select(want.columns)) == rows_of(want)


def test_locate_by_hand(spark):
    parts = {1: [3, 0, 4], 2: [5], 3: [0]}
    asked = [(c, i) for c in (1, 2, 3, 4) for i in (0, 2, 3, 6, 7, 99)] * 2
    want = []
    for c, i in asked:
        flat = [(p, w) for p, n in enumerate(parts.get(c, [])) for w in range(n)]
        if flat:
            want.append((c, i, *flat[min(i, len(flat) - 1)]))
    words = spark.createDataFrame(asked, "clip long, idx long")
    rows = spark.createDataFrame([(c, p, n) for c, ns in parts.items() for p, n in enumerate(ns)], "clip long, part long, words long")
    for size in (2, 1 << 16):
        assert sorted(map(tuple, P.locate(words, rows, size).collect())) == sorted(want)


def plain_clips(rows, limit):
    out, docs = [], {}
    for d, i, kind, text, *_ in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        docs.setdefault(d, []).append((i, kind, len(text)))
    for d, sents in docs.items():
        at = clip = 0
        while at < len(sents):
            n, size = 1, sents[at][2]
            while at + n < len(sents) and n < 16 and sents[at + n][1] == sents[at][1] and size + 1 + sents[at + n][2] <= limit:
                size += 1 + sents[at + n][2]
                n += 1
            out.append((d, clip, sents[at][0], n, size))
            at, clip = at + n, clip + 1
    return sorted(map(str, out))


@pytest.mark.parametrize(("block", "fan", "rows"), [(16, 2, 100), (17, 3, 1 << 16), (64, 256, 500), (1024, 256, 1 << 16)])
def test_clips_by_block_maps(hot, block, fan, rows):
    want = plain_clips([tuple(r) for r in hot.where("doc_id is not null").collect()], 480)
    got = P.greedy_clips(hot.where("doc_id is not null"), 480, block, fan, rows)
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_clips_of_a_very_long_document(spark):
    """10^6 sentences in one document: no row holds more than a block, and clips are those of a plain loop."""
    sents = spark.range(1_000_000).selectExpr("1L AS doc_id", "id AS sent_id", "CASE WHEN hash(id) % 50 = 0 THEN 'header' ELSE 'body' END AS kind", "repeat('x', cast(pmod(hash(id, 7), 120) AS int)) AS text")
    clips = P.greedy_clips(sents)
    got = clips.agg(F.count("*"), F.sum("n_sents"), F.sum(F.hash("clip", "first_sent", "n_sents", "n_chars").cast("long")), F.max("n_sents")).first()
    kinds = sents.select("sent_id", "kind", F.length("text").alias("n")).toPandas().sort_values("sent_id")
    want, at, n, size, kind, rows = [], 0, 0, 0, None, list(zip(kinds["kind"], kinds["n"], strict=True))
    for i, (k, length) in enumerate(rows):
        if n and k == kind and size + 1 + length <= 480 and n < 16:
            n, size = n + 1, size + 1 + length
        else:
            if n:
                want.append((len(want), at, n, size))
            at, n, size, kind = i, 1, length, k
    want.append((len(want), at, n, size))
    plain = spark.createDataFrame([tuple(map(int, w)) for w in want], "clip long, first_sent long, n_sents long, n_chars long")
    assert got[1] == 1_000_000 and got[3] <= 16
    assert got == plain.agg(F.count("*"), F.sum("n_sents"), F.sum(F.hash("clip", "first_sent", "n_sents", "n_chars").cast("long")), F.max("n_sents")).first()


def test_a_block_is_longer_than_a_clip(hot):
    with pytest.raises(ValueError, match="block"):
        P.greedy_clips(hot, block=15)


@pytest.mark.parametrize("rows", [700, 1 << 16])
def test_word_at_in_a_long_clip(spark, rows):
    """One clip with most words and lookups, many of them at one time, and clips without words."""
    rng = random.Random(5)
    starts = {1: sorted(round(rng.random() * 500, 2) for _ in range(20_000)), 2: [0.0, 1.0, 1.0, 4.0], 3: [2.0]}
    asked = [(1, round(rng.random() * 520 - 10, 2)) for _ in range(3000)] + [(1, 250.0)] * 2000 + [(c, t) for c in (2, 3, 4) for t in (-1.0, 0.0, 1.0, 3.0, 9.0)]
    words = spark.createDataFrame([(c, i, s) for c, ss in starts.items() for i, s in enumerate(ss)], "clip long, idx long, start double")
    got = N.word_at(spark.createDataFrame(asked, "clip long, t double"), words, rows)
    want = [(c, t, max(bisect.bisect_right(starts.get(c, []), t) - 1, 0)) for c, t in asked]
    assert sorted(map(tuple, got.collect())) == sorted(want)
