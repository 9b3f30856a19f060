"""SimHash, embeddings and components against brute force."""

import re

import numpy as np
import pytest
import xxhash

from inkspark.llm import components, rp_forest, simhash

from .conftest import EDGE


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def roots(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("text", [t for _, t, *_ in EDGE if t is None or len(t) < 1000] + ["A b", "one two three four FIVE"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == fingerprint(text)


@pytest.mark.parametrize("bits, run, short", [(3, 512, 64), (3, 4, 64), (5, 512, 2), (7, 8, 3), (3, 16384, 1)])
def test_links_connect_what_brute_force_links(spark, monkeypatch, bits, run, short):
    monkeypatch.setattr(simhash, "SHORT", short)
    rng = np.random.default_rng(bits * 1000 + run)
    centres = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = {0, 2**64 - 1}
    for c in centres.tolist():
        for _ in range(12):
            fps.add(c)
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                c ^= 1 << int(b)
    fps = np.array(sorted(fps), np.uint64)
    signed = fps.view(np.int64)
    linked = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= bits) if i < j]
    want = roots(len(fps), linked)
    links = simhash.near_links(spark.createDataFrame([(int(x),) for x in signed], "fp long"), bits, run).collect()
    at = {int(x): i for i, x in enumerate(signed)}
    assert roots(len(fps), [(at[r.a], at[r.b]) for r in links]) == want


def test_near_duplicates_on_edge_cases(edge, empty):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == len(EDGE)
    fps = [fingerprint(t if t is None or len(t) < 50000 else t[:0] + t) for _, t, *_ in EDGE]
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    ids = [i for i, *_ in EDGE]
    least = {}
    for i, r in zip(ids, want):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    expected = sorted((str(i), f"{f:016x}", str(least.get(r))) for i, f, r in zip(ids, fps, want))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows) == expected
    assert simhash.near_duplicates(empty).count() == 0


def test_drop_near_duplicates_is_verified(spark, edge, empty):
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 300)) for _ in range(30)]
    rows = []
    for i, t in enumerate(base):
        rows.append((i, t))
        words = t.split()
        words[int(rng.integers(300))] = "changed"
        rows.append((100 + i, " ".join(words)))
        words[10::12] = ["other"] * len(words[10::12])  # similarity well under 0.8
        rows.append((200 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}
    assert left >= set(range(30)) | set(range(200, 230))
    assert len(left & set(range(100, 130))) <= 3
    # pairs just above the threshold: two changed words of 100 leave a similarity of 0.81 or so
    pairs = [(i, " ".join(f"v{x}" for x in rng.integers(0, 5000, 100))) for i in range(60)]
    pairs += [(100 + i, " ".join("new" if k in (30, 70) else w for k, w in enumerate(t.split()))) for i, t in pairs]
    left = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    assert left >= set(range(60)) and len(left) <= 60 + 0.1 * 60
    # one text held by a third of the rows under many ids, and rows that are equal in every column
    hot = [(i, base[0]) for i in range(400)] + [(7, base[0])] * 5 + [(1000 + i, base[1 + i % 20]) for i in range(40)]
    left = sorted(r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(hot, "doc_id long, text string")).collect())
    assert left == [0, *range(1000, 1020)]
    kept = simhash.drop_near_duplicates(edge)
    assert kept.columns == edge.columns and kept.where("doc_id IS NULL").count() == 1
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_recall_of_near_copies_at_every_length(spark):
    """Pairs with a five-word Jaccard of 0.80 to 0.87: nine in ten go at least, of texts of 60 to 1,000 words."""
    rng, rows, pairs = np.random.default_rng(11), [], []
    for n in (60, 100, 200, 400, 1000):
        for _ in range(80):
            words = [f"w{x}" for x in rng.integers(0, 20_000, n)]
            other = list(words)
            for at in rng.permutation(n):
                changed = list(other)
                changed[at] = f"new{at}"
                a, b = set(zip(*(words[i:] for i in range(5)))), set(zip(*(changed[i:] for i in range(5))))
                if len(a & b) / len(a | b) < 0.80:
                    continue
                other = changed
                if len(a & b) / len(a | b) < 0.87:
                    break
            pairs.append((n, len(rows)))
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    left = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert left >= {i for _, i in pairs}
    found = {n: sum(i + 1 not in left for m, i in pairs if m == n) / 80 for n, _ in pairs}
    print(found)
    assert min(found.values()) >= 0.9


def test_components(spark):
    rng = np.random.default_rng(5)
    linked = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(500, 560)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(linked, "a long, b long")).collect()}
    want = roots(600, linked)
    nodes = {x for l in linked if l[0] != l[1] for x in l}
    assert got == {n: want[n] for n in nodes}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("leaf", [1024, 24])
def test_embeddings(spark, leaf):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((150, 64))
    x = np.concatenate([centres, *(centres[:60] + 0.1 * rng.standard_normal((60, 64)) * k for k in (1, 2, 3)), centres[:5], np.tile(centres[140], (20, 1))])
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    odd = [(1000, None), (1001, [0.0] * 64), (1002, [float("nan")] * 64), (1003, [1.0, None]), (1004, [float("inf")] + [1.0] * 63), (1005, [1.0, 2.0]), (1006, []), (None, rows[0][1]), (1007, [2.0, 4.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in rp_forest.near_duplicates(df, 0.95, leaf=leaf).collect()}
    y = np.array([v for _, v in rows], np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = (y @ y.T >= 0.95) & ~np.eye(len(y), dtype=bool)
    degree = near.sum(1) + near[0] * 0
    degree = degree + ((y @ y[0]) >= 0.95)  # the vector without an id
    found = sum(got[i].n_links for i in range(len(y)))
    assert all(got[i].n_links <= degree[i] for i in range(len(y)))
    assert found >= 0.98 * degree.sum()
    if found == degree.sum():
        want = roots(len(y), list(zip(*np.nonzero(near))))
        assert [got[i].component_id for i in range(len(y))] == want
    for i in (1000, 1001, 1002, 1003, 1004, 1006):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[1005].n_links, got[1007].component_id, got[1007].kept) == (1, 1005, False)
    assert len(got) == len(rows) + len(odd)
    assert rp_forest.near_duplicates(df.limit(0)).count() == 0


def brute(x, least):
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = y @ y.T >= least
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("block", [4096, 64])
def test_dense_cells_are_compared_in_blocks(spark, block):
    rng = np.random.default_rng(9)
    x = 1 + 0.001 * rng.standard_normal((300, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = rp_forest.near_duplicates(df, 0.95, leaf=32, block=block).collect()
    assert {(r.n_links, r.component_id) for r in rows} == {(299, 0)}


@pytest.mark.parametrize("trees", [0, 3])
def test_cells_that_splitting_would_copy_many_times_go_to_blocks(spark, trees):
    """One cluster of mean cosine 0.986: in 64 dimensions most rows are within the spill, but each child has under 95 % of its parent."""
    rng = np.random.default_rng(11)
    centre = rng.standard_normal(64)
    x = centre / np.linalg.norm(centre) + 0.0149 * rng.standard_normal((1500, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = rp_forest.near_duplicates(df, 0.95, trees=trees, leaf=128, block=200).collect()
    near = brute(x, 0.95)
    assert {r.vec_id: r.n_links for r in rows} == dict(enumerate(near.sum(1).tolist()))


@pytest.fixture(scope="module")
def close_pairs():
    """12,000 vectors: 5,000 pairs planted at a cosine of 0.95 to 0.96, the hardest to find, and some groups that link in chains."""
    rng = np.random.default_rng(21)
    x = rng.standard_normal((7000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.standard_normal((5000, 64))
    other -= (other * x[:5000]).sum(1, keepdims=True) * x[:5000]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = rng.uniform(0.9501, 0.96, (5000, 1))
    return np.concatenate([x, cosine * x[:5000] + np.sqrt(1 - cosine**2) * other]).astype(np.float32)


@pytest.mark.parametrize("trees, floor", [(rp_forest.TREES, 0.98), (0, 1.0)])
def test_recall_near_the_threshold(spark, close_pairs, trees, floor):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(close_pairs)], "vec_id long, embedding array<float>").repartition(4)
    near = brute(close_pairs, 0.95)
    got = {r.vec_id: r for r in rp_forest.near_duplicates(df, 0.95, trees=trees, leaf=512).collect()}
    assert all(got[i].n_links <= d for i, d in enumerate(near.sum(1)))
    assert near.sum() >= 10_000 and sum(r.n_links for r in got.values()) >= floor * near.sum()
    if trees == 0:
        want = roots(len(near), [(int(i), int(j)) for i, j in zip(*np.nonzero(near)) if i < j])
        assert [got[i].component_id for i in range(len(near))] == want


def test_thresholds_in_several_rounds(spark, close_pairs, monkeypatch):
    monkeypatch.setattr(rp_forest, "THRESHOLDS", 64)
    x = close_pairs[:2000]
    x[1000:] = x[:1000] + 0.02
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    near, rows = brute(x, 0.95), rp_forest.near_duplicates(df, 0.95, leaf=100).collect()
    assert all(r.n_links <= near[r.vec_id].sum() for r in rows) and sum(r.n_links for r in rows) >= 0.98 * near.sum()


def test_copies_for_salts_do_not_pass_through_the_driver(spark, monkeypatch):
    """A side that is too large to broadcast is not broadcast by its files' size either, which copies to salts do not show."""
    from pyspark.sql import functions as F

    from inkspark.llm import shared

    big = spark.range(600).select((F.col("id") % 150).alias("k"), "id")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    sides = {
        "few": shared.materialize(spark.range(100).select(F.col("id").alias("k"), F.lit(6).alias("n"), F.array(F.lit(7)).alias("x"))),
        "many": shared.materialize(spark.range(shared.BROADCAST_ROWS + 1).select(F.col("id").alias("k"), F.lit(6).alias("n"), F.array(F.lit(7)).alias("x"))),
        "wide": shared.materialize(spark.range(100).select(F.col("id").alias("k"), F.when(F.col("id") > 0, 6).otherwise(10_000).alias("n"), F.array_repeat(F.lit(7), 30_000).alias("x"))),
    }
    size = 8 * F.size("x")
    joins = {
        "checked": lambda s: shared.join_checked(big, s, "k", "inner", F.col("id")),
        "left": lambda s: shared.join_checked(big, s, "k", "left", F.col("id")),
        "counted": lambda s: shared.join_counted(big, s, "k", "n"),
        "wide": lambda s: shared.join_wide(big, s, "k", "n", size, F.col("id")),
    }
    for name, join in joins.items():
        for side in ("few", "wide" if name == "wide" else "many"):
            made, want = join(sides[side]), big.join(sides[side], "k", "left" if name == "left" else "inner")
            assert ("SortMergeJoin" in plan(made)) == (side != "few")
            if side != "few":  # names of heavy keys alone are broadcast, no copies of rows
                assert plan(made).count("BroadcastExchange") == (name == "wide")
            assert sorted(map(tuple, made.select("id", "k", "n").collect()), key=str) == sorted(map(tuple, want.select("id", "k", "n").collect()), key=str)
    for t in sides.values():
        shared.drop(t)
