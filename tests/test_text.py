"""Properties of sentences and chunks on documents, and golden cases."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from inkspark.functions import text as T

DATA = "/root/testdata/sf0.001"


def chunks_of(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return [r.c for r in df.select("id", T.chunks(F.col("text")).alias("c")).orderBy("id").collect()]


def test_sentences_split_at_ends(spark):
    df = spark.createDataFrame([("One is here. Two is there! Is three? It is.",), ("See approx. five of e.g. these",)], "t string")
    rows = [r.s for r in df.select(T.sentences(F.col("t")).alias("s")).collect()]
    assert rows[0] == ["One is here.", "Two is there!", "Is three?", "It is."]
    assert rows[1] == ["See approx. five of e.g. these"]


def test_numbers_at_ends_of_sentences_stay(spark):
    said = [f"{i}{i} is the number{i}." for i in range(12)]
    df = spark.createDataFrame([(" ".join(said),), ("Under one. 19.37.233.111",)], "t string")
    rows = [r.s for r in df.select(T.sentences(F.col("t")).alias("s")).collect()]
    assert rows == [said, ["Under one.", "19.37.233.111"]]


def test_long_sentences_are_cut(spark):
    long = ", ".join(f"clause number {i} goes on for a while" for i in range(20)) + "."
    token = "x" * 1200
    (a,), (b,) = [[c] for c in chunks_of(spark, long, f"short words {token} more short words")]
    assert len(a) >= 2 and max(map(len, a)) <= 480
    assert max(map(len, b)) <= 480 and "".join(b).count("x") == 1200


def test_short_sentences_join(spark):
    assert chunks_of(spark, "A b. C d. E f.") == [["A b. C d. E f."]]


def test_empty_and_odd_texts(spark):
    assert chunks_of(spark, "", " \n\n ", None) == [[], [], None]
    assert all(chunks_of(spark, "Ünïcödé is här 😀. 漢字。"))


def test_no_word_is_lost(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.select(T.words(F.col("text")).alias("before"), T.words(F.array_join(T.chunks(F.col("text")), " ")).alias("after"), T.chunks(F.col("text")).alias("c")).collect()
    for r in rows:
        assert len(r.before) == len(r.after)
        assert all(len(c) <= 480 for c in r.c)


def test_offsets_slice_back(spark):
    df = spark.createDataFrame([("a  bb\tccc 😀 é a",)], "t string")
    t, words = df.select("t", T.tokenize(F.col("t")).alias("w")).first()
    assert [t[w.start : w.end] for w in words] == [w.text for w in words] == t.split()


def _words_right(rows, c):
    """Precision and recall of words against those of the marked article."""
    hit = got = want = 0
    for r in rows:
        g, w = Counter((r[c] or "").split()), Counter(r.want.split())
        hit, got, want = hit + sum((g & w).values()), got + sum(g.values()), want + sum(w.values())
    return hit / got, hit / want


def test_main_text_of_marked_pages(spark):
    """Where tags tell nothing (all are div) and where they do; what is marked as the article is what should come out."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    pages = pages.withColumn("plain", F.regexp_replace("html", r"(?i)<(/?)(?:article|nav|header|footer|main)\b[^>]*>", "<$1div>"))
    want = T.strip_tags(F.regexp_extract("html", r"(?s)<article>(.*)</article>", 1))
    made = {f"{name} {c}": f(F.col(c)) for c in ("html", "plain") for name, f in (("tags", T.article_text), ("main", T.main_text))}
    rows = pages.select(want.alias("want"), *[x.alias(n) for n, x in made.items()]).collect()
    score = {n: _words_right(rows, n) for n in made}
    f1 = {n: 2 * p * r / (p + r) for n, (p, r) in score.items()}
    print(score)
    assert f1["main plain"] > f1["tags plain"] and f1["main plain"] > 0.97
    assert score["main html"][0] > score["tags html"][0] and min(score["main html"]) > 0.98


def _best_run(html, share):
    """The run of blocks with the largest sum, by all pairs of ends."""
    bare = re.sub(r"(?is)<!--.*?-->|<(script|style|nav|header|footer|aside|head|noscript|template)\b.*?</\1\s*>", " ", html)
    blocks, heading = [], False
    for part in re.split(r"(?i)</?(?:p|div|li|ul)\b[^>]*>|</h[1-6]>|(<h[1-6]\b[^>]*>)", bare):
        if part is None or re.match(r"(?i)<h[1-6]\b", part):
            heading = part is not None
            continue
        links = sum(len(re.sub(r"<[^>]+>", " ", a).split()) for a in re.findall(r"(?is)<a\b[^>]*>(.*?)</a\s*>", part))
        words = re.sub(r"<[^>]+>", " ", part).split()
        if words:
            blocks.append((words, links, heading))
    n = sum(len(w) for w, *_ in blocks)
    least = share * sum(len(w) ** 2 for w, *_ in blocks) / n if n else 0
    value = [0 if h and not k else len(w) - 2 * k - least for w, k, h in blocks]
    runs = [(sum(value[i:j]), i, j) for i in range(len(blocks)) for j in range(i + 1, len(blocks) + 1)]
    most = max((r[0] for r in runs), default=0)
    return [{"\n\n".join(" ".join(w) for w, k, _ in blocks[i:j] if len(w) >= 2 * k) for s, i, j in runs if abs(s - most) < 1e-9}, {""}][not runs]


def test_main_text_is_the_best_run(spark):
    rng = random.Random(6)
    made = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(0, 12)):
            words = " ".join(rng.choice(["one", "two", "three,", "<b>four</b>", "five."]) for _ in range(rng.choice([1, 3, 8, 30])))
            parts.append(rng.choice([f"<p>{words}</p>", f"<div>{words}</div>", f"<h2>{words}</h2>", f'<li><a href="/x">{words}</a></li>', f'<p>{words} <a href="/y">more of it</a></p>']))
        made.append("<html><head><title>t</title></head><body>" + "".join(parts) + "<script>var a = '<p>no</p>';</script></body></html>")
    made += ["", "only text", "<p>a</p>", "<nav>all</nav>", "<p>x <a href='1'>open link<p>y"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(made)] + [(-1, None)], "i long, html string")
    for r in df.select("i", "html", T.main_text(F.col("html"), 0.3).alias("text")).collect():
        if r.html is None:
            assert r.text is None
        else:
            assert r.text in _best_run(re.sub(r"(?i)</?(?:html|body)\b[^>]*>", "<p>", r.html), 0.3), r.html
