"""Phrases, spelling variants and languages against brute force, on edge cases and on the documents."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspark.llm import language, phrases, spelling

from .conftest import EDGE

SF = "/root/testdata/sf0.001"


def plain_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_phrases(rows, least, longest, best):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", plain_lower(text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, of in counts.items():
        frequent = {p: a for p, a in of.items() if a >= least}
        inside = {(p[i:j], a) for p, a in frequent.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p)}
        found = []
        for p, a in frequent.items():
            if len(p) > 1 and (p, a) not in inside:
                n = total[lang]
                score, k = min((1000 * a * n // (frequent[p[:k]] * frequent[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), frequent[p[:k]], frequent[p[k:]], n))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -score) for i, (score, a, p, left, right, n) in enumerate(sorted(found)[:best])]
    return sorted(out)


@pytest.mark.parametrize(("least", "buckets", "best"), [(2, 1 << 20, 2000), (4, 1 << 14, 30)])
def test_phrases_of_documents(spark, least, buckets, best):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    got = sorted(map(tuple, phrases.collocations(docs, least=least, best=best, buckets=buckets).collect()))
    assert got == brute_phrases(rows, least, 5, best)
    assert len(got) > 50


def test_phrases_of_odd_texts(spark, edge, empty, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 1000)
    odd = [("Aa bb\tcc  dd. aa BB cc;dd", None), ("aa bb cc\naa bb cc\x0bÉ é É é", "xx"), ("aa aa aa aa aa", "xx"), (None, "xx"), ("", None), ("a" * 5000 + " b", "xx"), ("a" * 5000 + " b\x00 c", "und")]
    df = spark.createDataFrame(odd * 3, "text string, lang string")
    assert sorted(map(tuple, phrases.collocations(df, least=2).collect())) == brute_phrases([(b, a) for a, b in odd * 3], 2, 5, 2000)
    got = sorted(map(tuple, phrases.collocations(edge, least=2).collect()))
    assert got == brute_phrases([(r[2], r[1]) for r in EDGE], 2, 5, 2000)
    assert phrases.collocations(empty).collect() == []


def test_large_counts_are_exact(spark):
    a = F.expr("cast(1000 as decimal(4,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    rows = [(10**13 + 7, 10**15 + 1, 10**13 + 9, 10**13 + 8), (99, 10**17, 100, 101), (3, 7, 5, 11)]
    got = [r[0] for r in spark.createDataFrame(rows, "a long, n long, l long, r long").select(a).collect()]
    assert got == [1000 * a * n // (left * r) for a, n, left, r in rows]


def test_bucket_blocks_go_through(spark):
    rng = np.random.default_rng(1)
    counters = np.zeros(4 * phrases.BLOCK, np.uint8)
    counters[rng.integers(0, 2 * phrases.BLOCK, 50)] = 7
    counters[3 * phrases.BLOCK :] = 1
    back = np.zeros(len(counters), np.int64)
    for block, data in phrases.packed(counters):
        at, n = phrases.unpacked(data)
        back[block * phrases.BLOCK : (block + 1) * phrases.BLOCK][at] = n
    assert (back == counters).all()


def brute_variants(rows, length=6, least=5, times=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = plain_lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            counts[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 199 == 0 else word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= length and n >= least}

    def distance_one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by_size, near = defaultdict(list), defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    for w in words:
        near[w] = [x for d in (-1, 0, 1) for x in by_size[len(w) + d] if distance_one(w, x)]
    form = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: f for w, f in form.items() if words[f] >= times * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w, ""), root(w), n, len(near[w]), words[form[w]] if w in form else 0) for w, n in words.items())


def found_variants(docs, **more):
    rows = spelling.variants_of_words(docs, **more).select("word", F.coalesce("form", F.lit("")), "root", "n", "n_near", F.coalesce("form_n", F.lit(0))).collect()
    return sorted(map(tuple, rows))


@pytest.mark.parametrize("sizes", [{}, {"hot": 9}, {"hot": 1, "heavy": 1e-4}])
def test_variants_of_documents(spark, sizes):
    """By groups within tasks, by groups dealt over tasks, and by sides that are not brought together."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_variants(rows, least=2, times=2)
    assert found_variants(docs, least=2, times=2, **sizes) == want
    assert sum(w[4] for w in want) > 100


def test_variants_of_odd_words(spark, edge, empty):
    chain = [("colour", 3), ("colourr", 15), ("colourrs", 80), ("aaaaaa", 5), ("aaaaaaa", 5), ("aaaaaaaa", 30), ("ÀÉÎÕÜß", 6), ("àÉÎÕÜß", 6), ("xy" * 2000, 7), ("xy" * 2000 + "z", 5), ("short", 9), ("ab×÷ab", 5)]
    rows = [(1000 * i + j, f"{w}. {w}") for i, (w, n) in enumerate(chain) for j in range(n)] + [(None, "xyzzyx " * 9), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_variants(rows)
    assert any(w[1] != w[2] and w[1] for w in want)
    assert found_variants(docs) == found_variants(docs, hot=1, heavy=1e-6) == want
    assert found_variants(edge, least=1) == brute_variants([r[:2] for r in EDGE], least=1)
    assert found_variants(empty) == []
    with pytest.raises(ValueError, match="4"):
        spelling.variants_of_words(docs, length=3)


def test_prefix_filter_misses_no_edit():
    rng = np.random.default_rng(3)
    for alphabet in ("ab", "abcde"):
        words = {"".join(rng.choice(list(alphabet), rng.integers(6, 10))) for _ in range(300)}
        known = Counter(g for w in words for g in {w[i : i + 2] for i in range(len(w) - 1)})
        sides = {w: set(spelling.sides(w, known)) for w in words}
        for a in words:
            for b in words:
                if a < b and spelling.one_edit(a, b):
                    assert any((key, not short) in sides[b] or (not short and (key, False) in sides[b]) for key, short in sides[a])


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, language.fit(docs)


def test_languages_of_documents(labelled):
    docs, model = labelled
    found = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held) > 100
    assert all(0 <= r.score <= 1 for r in found)


def test_mixtures_give_proportions(labelled):
    docs, model = labelled
    of = {lang: language.words_of(" ".join(r.text for r in docs.where((F.col("lang") == lang) & (F.length("text") > 500)).orderBy("doc_id").limit(20).collect())) for lang in ("en", "fr", "de")}
    lang, score = language.predict([" ".join(of["en"][:300] + of["fr"][:100]), " ".join(of["fr"][:300] + of["de"][:300] + of["en"][:400]), " ".join(of["de"][:6])], model)
    assert lang == ["en", "en", "de"]
    assert np.abs(np.array(score) - [0.75, 0.4, 1.0]).max() < 0.06


def test_mixture_against_a_plain_loop(labelled):
    _, model = labelled
    text = "Éièr leaux the whonth und der einen los para de, the of in der"
    words = language.words_of(text)
    like = np.exp(np.array([model.of_words([w])[0] for w in words], float))
    sets, n, worth = [tuple(range(len(model.langs)))], len(words), {}
    share = np.full(len(model.langs), 1 / len(model.langs))
    first = True
    while True:
        for _ in range(language.ROUNDS):
            new = sum(x * share / (x * share).sum() for x in like) / n
            moved, share = np.abs(new - share).max(), new
            if moved < language.CLOSE:
                break
        if first:
            first, few = False, share * n < 0.5
            few[share.argmax()] = False
            share = np.where(few, 0, share) / np.where(few, 0, share).sum()
            continue
        sets = share > 0
        worth[tuple(share)] = sum(np.log((x * share).sum()) for x in like) - language.PENALTY * np.log(n + 1) * (sets.sum() - 1)
        if sets.sum() == 1:
            break
        share = np.where(np.arange(len(share)) == np.where(sets, share, 9).argmin(), 0, share)
        share = share / share.sum()
    best = np.array(max(worth, key=worth.get))
    lang, score = language.predict([text, "x", None], model)
    assert lang[0] == model.langs[best.argmax()]
    assert score[0] == pytest.approx(best.max(), abs=1e-6)
    assert (lang[2], score[2]) == ("und", 0.0)


def test_word_likelihoods_by_hand():
    counts = {"aa": Counter(), "bb": Counter()}
    for lang, words in (("aa", ["ab", "abc"]), ("bb", ["b"])):
        code, _ = language.triples(words)
        counts[lang].update(map(int, [*code, *language.starts(words)]))
    context = {x: Counter() for x in counts}
    for lang, of in counts.items():
        for c, n in of.items():
            context[lang][c >> 21] += n
    model = language.table_of(counts, context, np.array(sorted({c for of in counts.values() for c in of})))
    s, v = language.SMOOTH, language.SMOOTH / language.LETTERS
    aa = (2 + v) / (2 + s) * (2 + v) / (2 + s) * (1 + v) / (2 + s)  # ##a, #ab, ab#
    bb = (0 + v) / (1 + s) * v / s * v / s
    assert model.of_words(["ab"])[0].tolist() == pytest.approx([0, np.log(bb / aa)], rel=1e-5)


def test_languages_of_odd_rows(spark, edge, empty, labelled):
    rows = {(r.doc_id, r.lang_pred): r for r in language.identify(edge, labelled[1]).collect()}
    assert rows[4, "und"].score == rows[3, "und"].score == rows[5, "und"].score == 0
    assert not next(r for k, r in rows.items() if k[0] is None).held_out
    assert language.identify(edge, labelled[1]).count() == len(EDGE)
    assert language.fit(empty) is None
    assert {r.lang_pred for r in language.identify(edge, None).collect()} == {"und"}
    own = language.fit(edge)
    assert set(own.langs) <= {"en", "fr", "de"}
    digits, other = language.predict(["123 456 !", "Ωμέγα"], labelled[1])[0]
    assert digits == "und" and other in labelled[1].langs
    shuffled = language.fit(edge.orderBy(F.desc("text")).repartition(3))
    assert shuffled.langs == own.langs and np.array_equal(shuffled.table, own.table)


def test_sample_is_bounded(spark):
    docs = spark.range(3000).selectExpr("id % 2900 AS doc_id", "concat('wort ', id) AS text", "CASE WHEN id % 10 = 0 THEN 'fr' ELSE 'de' END AS lang")
    counts = {r.lang: r["count"] for r in language.sample(docs, per_lang=300).groupBy("lang").count().collect()}
    assert 240 < counts["de"] < 360 and 200 < counts["fr"] <= 300
