"""Exact dedup, mixing and sharding on edge cases, against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspark.llm import exact_dedup, mixing, sharding

from .conftest import EDGE


def test_exact_duplicates(edge):
    rows = exact_dedup.exact_duplicates(edge).collect()
    assert len(rows) == len(EDGE)
    groups = defaultdict(list)
    for i, t, *_ in EDGE:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    kept = Counter()
    for r in rows:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
        kept[r.text_sha256] += r.kept
    assert all(kept[g] == 1 for g in groups)


@pytest.mark.parametrize("support", [1 / 1024, 0.1])
def test_heavy_and_light_paths_agree(spark, support):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id % 700) END AS text")
    rows = exact_dedup.exact_duplicates(df, support=support).collect()
    best, size = {}, Counter()
    for i in range(3000):
        t = "hot" if i % 3 == 0 else f"t{i % 700}"
        best[t], size[t] = i, size[t] + 1
    assert len(rows) == 3000
    for r in rows:
        t = "hot" if r.doc_id % 3 == 0 else f"t{r.doc_id % 700}"
        assert (r.keep_id, r.group_size, r.kept) == (best[t], size[t], r.doc_id == best[t])


def test_drop_keeps_columns_and_one_of_each(edge, empty):
    left = exact_dedup.drop_exact_duplicates(edge)
    assert left.columns == edge.columns
    assert sorted((r.text or "")[:50] for r in left.collect()) == sorted({(t or "")[:50] for _, t, *_ in EDGE})
    assert exact_dedup.drop_exact_duplicates(empty).count() == exact_dedup.exact_duplicates(empty).count() == 0


def test_mixing_meets_entropy_and_budget(spark):
    sizes = {"a": 600, "b": 90, "c": 30, None: 20}
    rows = [(i, "w " * (1 + i % 5), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, target_entropy=0.9, budget=1.0).collect()
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len(t.split()) + 1
    total = sum(tokens.values())
    weight = {r.source: r.weight for r in out}
    assert abs(sum(weight.values()) - 1) < 1e-9
    entropy = -sum(w * math.log(w) for w in weight.values())
    assert 0.9 * math.log(4) <= entropy < 0.9 * math.log(4) + 1e-3
    got = Counter()
    for r in out:
        got[r.source] += r.n_tokens
    for s, w in weight.items():
        assert 0 <= w * total - got[s] <= 7  # the document that would not fit
    copies = Counter(r.doc_id for r in out)
    for s in sizes:
        counts = {copies.get(i, 0) for i, _, x in rows if x == s}
        assert max(counts) - min(counts) <= 1


def test_mixing_limits_repetition_and_covers(edge, empty):
    out = mixing.mix_documents(edge, max_repetition=1.5, budget=None)
    assert out.columns == edge.columns
    seen = Counter(r.doc_id for r in out.collect())
    rows = Counter(i for i, *_ in EDGE)
    assert set(seen) == set(rows) and all(seen[i] <= 2 * n for i, n in rows.items())
    assert mixing.mix_documents(empty, max_repetition=1.5, budget=None).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(edge, budget=1.0).count()


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one():
    keys = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    for n in (1, 2, 40, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]


def test_shards(spark, edge, empty):
    rows = sharding.shard_rows(edge, 5).collect()
    assert len(rows) == len(EDGE)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 5)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    text = {i: (t or "").encode() for i, t, *_ in EDGE}
    for r in rows:
        assert (r.size, r.text_crc32) == (len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id]))
    assert sharding.shard_rows(empty, 5).count() == 0
    many = sharding.shard_rows(spark.range(20000).selectExpr("id AS doc_id", "'t' AS text"), 40)
    moved = many.where("grown_shard <> shard").count()
    assert 20000 / 41 * 0.7 < moved < 20000 / 41 * 1.3


def test_write_shards(edge, spark, tmp_path):
    clash = edge.withColumn("Shard", F.lit("mine"))
    assert sharding.write_shards(clash, f"{tmp_path}/c", 3) == "shard_"
    assert spark.read.parquet(f"{tmp_path}/c").where("Shard = 'mine' AND shard_ BETWEEN 0 AND 2").count() == len(EDGE)
    assert sharding.write_shards(edge, f"{tmp_path}/s", 3, files=2) == "shard"
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == len(EDGE) and set(edge.columns) <= set(back.columns)
