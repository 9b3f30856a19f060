"""Whole inputs of the reading queries, against plain Python."""

import re

from inkspark.plans import reading_queries as R


def weight(word):
    return 2 + len(re.findall(r"[^\W_]", word)) + sum({",": 3, ";": 4, ":": 4, ".": 6, "!": 6, "?": 6, "—": 4}.get(c, 0) for c in word)


def test_weights_and_times_without_a_shuffle(spark, tmp_path):
    """Odd words and texts: words without a letter, ideographs beyond 16 bits, empty and null texts; no query shuffles words."""
    texts = {1: "a, -- b; \"q\" (c).\n\n\u2014 \ud840\udc00x d:e!?".encode("utf-16", "surrogatepass").decode("utf-16"), 2: " \t ", 3: "", 4: None, 5: "' \"", 6: "x" * 70000 + " y" * 3000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    words = {i: (t or "").split() for i, t in texts.items()}
    got = sorted(tuple(r) for r in R.word_weights(spark, str(tmp_path)).collect())
    assert got == [(i, k, w, weight(w)) for i, ws in words.items() for k, w in enumerate(ws)]
    starts, want = {}, []
    for i, ws in words.items():
        at, total = 0, sum(map(weight, ws))
        starts[i] = []
        for k, w in enumerate(ws):
            starts[i].append(10.0 * at / total)
            want.append((i, k, int(10.0 * at / total * 1000 + 0.5), int(10.0 * (at + weight(w)) / total * 1000 + 0.5)))
            at += weight(w)
    assert sorted(tuple(r) for r in R.word_timings(spark, str(tmp_path)).collect()) == want
    times = (-1.0, 0.0, 2.5, 4.123, 9.99, 30.0)
    assert sorted(tuple(r) for r in R.word_at_time(spark, str(tmp_path)).collect()) == sorted((i, int(t * 1000 + 0.5) if t >= 0 else -1000, max(sum(s <= t for s in ss) - 1, 0)) for i, ss in starts.items() if ss for t in times)
    for query in (R.word_weights, R.word_timings, R.word_at_time):
        plan = query(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert not any(x in plan for x in ("Window", "Join", "Sort")), query


def test_words_after_the_200th_character(spark, tmp_path):
    texts = {1: "one, two. " * 90, 2: "short", 3: "", 4: "x" * 199 + " after the cut; and more words"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = {i: t.split() for i, t in texts.items()}
    got = sorted((r.doc_id, r.idx, r.word, r.weight) for r in R.word_weights_whole(spark, str(tmp_path)).collect())
    assert got == [(i, k, w, weight(w)) for i, ws in words.items() for k, w in enumerate(ws)]
    times = {(r.doc_id, r.idx): (r.start_ms, r.end_ms) for r in R.word_timings_whole(spark, str(tmp_path)).collect()}
    starts = {}
    for i, ws in words.items():
        at, total = 0, sum(map(weight, ws))
        for k, w in enumerate(ws):
            starts[i, k] = 10 * at / total
            assert times.pop((i, k)) == (int(10 * at / total * 1000 + 0.5), int(10 * (at + weight(w)) / total * 1000 + 0.5))
            at += weight(w)
    assert not times
    for r in R.word_at_time_whole(spark, str(tmp_path)).collect():
        assert r.word == max([k for (i, k), s in starts.items() if i == r.doc_id and s * 1000 <= r.t_ms], default=0)


def test_clips_of_odd_texts_as_in_sql(spark, tmp_path):
    """Texts without a chunk have no row, and words are counted as the SQL counts them, at whatever clause marks are cut."""
    import duckdb

    from inkspark.plans import catalog

    long = "word " * 120
    texts = [None, "", " \n\n\t", ", " * 300, "Plain words.", f"Mot : {long}— encore ; {long}!", f"One — {'y' * 500} , B? {long}", f"A. 5. \"B\" (C) {long}: \x85 D ;"]
    rows = spark.createDataFrame([(i - 1, t) for i, t in enumerate(texts * 2)] + [(None, "No id.")], "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["document_clips"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = duck.execute(catalog.ORACLE_SQL["document_clips"])
    assert [c[0] for c in found.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall()) != []
