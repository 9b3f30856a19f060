"""Whole patterns in texts against a plain loop, with keys and pairs that are broadcast and that are not."""

import random

import pytest
from pyspark.sql import functions as F

from inkspark.operators import patterns as X
from inkspark.plans import layout_queries as L


@pytest.mark.parametrize("at_once", [10_000, 3])
def test_whole_items(spark, tmp_path, monkeypatch, at_once):
    monkeypatch.setattr(X, "KEYS", at_once)
    monkeypatch.setattr(X, "PAIRS", at_once)
    items = {i: f"item {i:02d} begins with these forty characters, and ends with {i}." for i in range(12)}
    docs = {0: f"a {items[3]} b {items[11]}", 1: items[5][:-4], 2: "none", 3: items[0], 4: f"glued{items[7]}too", 5: "a short onego", 6: None}
    items[20] = "short one"
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in L.pattern_hits(spark, str(tmp_path)).collect()) == [(0, 3), (0, 11), (3, 0), (4, 7), (5, 20)]


@pytest.mark.parametrize(("keys", "pairs"), [(None, None), (0, 0)])
def test_patterns_of_all_lengths(spark, keys, pairs):
    """Few different words, so that patterns lie in many texts, across words and over odd white space; equal patterns and texts."""
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["ab", "abc", "b", "ca", "bc\tb", "c  a"]) for _ in range(n))
    texts = [(i, text(rng.randint(0, 40))) for i in range(150)] + [(3, "ab abc b"), (900, None), (901, ""), (902, "one very long opening phrase that all share and then 7 of them")]
    patterns = [(i, p[rng.randint(0, 2) : len(p) - rng.randint(0, 2)]) for i, p in enumerate(text(rng.randint(1, 12)) for _ in range(120))]
    patterns += [(500, "ab abc b"), (501, "ab abc b"), (502, None), (503, ""), (504, "zz zz zz zz")] + [(600 + i, f"one very long opening phrase that all share and then {i} of them") for i in range(30)]
    want = sorted((i, j) for i, t in texts for j, p in patterns if t is not None and p is not None and p in t)
    a, b = spark.createDataFrame(texts, "t long, text string").repartition(3), spark.createDataFrame(patterns, "j long, p string")
    assert sorted(map(tuple, X.hits(a, b, "t", "j", keys, pairs).collect())) == want
    assert X.hits(a.limit(0), b, "t", "j").count() == X.hits(a, b.limit(0), "t", "j").count() == 0


def test_a_shared_opening_is_no_key(spark):
    """A thousand patterns with one opening, which is in every text: each is looked up by its own words, so few pairs meet."""
    opening = "this long opening phrase is in every one of the texts and patterns"
    texts = spark.range(400).select(F.col("id").alias("t"), F.concat(F.lit(opening), F.lit(" word"), "id", F.lit(" then word"), "id", F.lit(" and the last")).alias("text"))
    patterns = spark.range(1000).select(F.col("id").alias("pattern"), F.concat(F.lit(opening), F.lit(" word"), "id", F.lit(" then word"), "id", F.lit(" and")).alias("p"))
    inner = patterns.select("pattern", F.split("p", " ").alias("ws"), F.lit(5).alias("n"))
    keys = X.rarest_keys(texts, inner, [5])
    met = texts.select("t", F.explode(X.ngram_keys(F.col("text"), [5])).alias("key")).join(keys, "key")
    assert keys.count() == 1000 and met.count() < 500
    assert X.hits(texts, patterns.withColumnRenamed("pattern", "j"), "t", "j").count() == 400
