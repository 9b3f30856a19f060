"""Spelling variants: words one edit apart, found by rare-first prefix filters of positional bigrams (operator 12).

Words are maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of whole texts, lower-cased in A-Z. With h the crc32 of ``<id>:<word>``, a
word whose h is divisible by 199 loses its code point h % length. Words of LENGTH code points and LEAST occurrences are compared.

Two words are near if one insertion, deletion or replacement makes one of the other. Bigrams are ordered by the number
of words that have them, the rarest first (ties: by bigram). One edit destroys two bigrams at most, so of the three rarest of
each of two near words, one occurrence is the same bigram untouched: had all three of one word's been destroyed or lain behind
the other's third, more than two bigrams would be gone. The edit is then wholly left or wholly right of it, which limits its
position and more: the words agree from the bigram to the end, or from the start to the bigram. So words are joined on that
shared side, written out (it holds the bigram and fixes its position), and on the length of the longer word; what met is
verified on the other side alone.

A group of more than a few words is not compared pair by pair: of what is left of each word all variants with one code
point deleted are grouped with the deleted place, and words that share one are near. Such a group has a word for each letter
at most (for an insertion, one for each letter and place), so no group of words is squared and no pair is dropped. Groups of
up to HOT words do so within their task; larger ones are dealt over all tasks by their variants, and shared sides with more
than HEAVY of all rows (told by counts of hashes, fewer than 1 / HEAVY of them) are not even brought together.

Null texts have no words; a null id is written as nothing in ``<id>:<word>``. Words of any length are handled. Repeated rows
count each time. An empty table gives no rows; columns other than the two named ones are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import HEAVY, drop, has_rows, materialize

LENGTH, LEAST, TIMES, STRIDE = 6, 5, 5, 199
#: Bigrams of a word that are joined on.
RAREST = 3
#: Words of a shared side that a task compares by itself; more of them are dealt by deletion variants.
HOT = 2048
#: Distinct words of a task that are counted before they are passed on.
HELD = 200_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RUN = re.compile("[a-zÀ-ÿ]+")


def words_of(doc_id: int | None, text: str) -> Iterator[tuple[str, int]]:
    """The words of a text and how often each comes out."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(_RUN.findall(text.encode().translate(_LOWER).decode())).items():
        h = zlib.crc32(run.encode(), start)
        if h % STRIDE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def word_counts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """(word, n) of the words of at least ``length`` code points with at least ``least`` occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for word, n in words_of(doc_id, text or ""):
                    if len(word) >= length:
                        held[word] += n
                if len(held) >= HELD:
                    yield flushed(held)
        if held:
            yield flushed(held)

    def flushed(held: Counter[str]) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return made

    rows = docs.select(F.col(id_col).cast("string"), text_col).mapInArrow(count, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def bigram_counts(words: DataFrame) -> dict[str, int]:
    """How many words have each bigram: 90 letters, so 8,100 rows at most."""
    gram = F.transform(F.sequence(F.lit(0), F.length("word") - 2), lambda i: F.substring(F.col("word"), i + 1, F.lit(2)))
    found = words.where(F.length("word") > 1).select(F.explode(F.array_distinct(gram)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    return {r.gram: r.n for r in found.collect()}


def rarest(word: str, known: dict[str, int]) -> list[int]:
    """Where the RAREST rarest bigrams begin; of equal bigrams those further left."""
    return [at for _, _, at in sorted((known[word[i : i + 2]], word[i : i + 2], i) for i in range(len(word) - 1))[:RAREST]]


def sides(word: str, known: dict[str, int]) -> Iterator[tuple[str, bool]]:
    """What the word is joined on, and whether as the shorter one: side, length of the longer word, shared part."""
    for at in rarest(word, known):
        for side, part in (("l", word[: at + 2]), ("r", word[at:])):
            yield f"{side}{len(word)}:{part}", False
            yield f"{side}{len(word) + 1}:{part}", True


def rest(word: str, key: str) -> str:
    """What of the word is not on the shared side."""
    n = len(key) - key.index(":") - 1
    return word[n:] if key[0] == "l" else word[: len(word) - n]


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one insertion, deletion or replacement makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def variants(text: str, short: bool) -> Iterator[str]:
    """Words with a common variant, of a shared side, are one edit apart: ``=`` joins replacements, ``-`` the shorter word with
    longer ones."""
    if short:
        yield f"-{text}"
        return
    for i in range(len(text)):
        less = text[:i] + text[i + 1 :]
        yield f"={i}:{less}"
        if not i or text[i] != text[i - 1]:
            yield f"-{less}"


def near_in_group(key: str, group: list[tuple[str, int, bool]]) -> Iterator[tuple[tuple[str, int], tuple[str, int]]]:
    """Pairs of near words among (word, n, short) of one shared side; two shorter ones meet elsewhere."""
    if len(group) <= 8:
        for i, (a, n, a_short) in enumerate(group):
            for b, m, b_short in group[:i]:
                if not (a_short and b_short) and one_edit(rest(a, key), rest(b, key)):
                    yield (a, n), (b, m)
        return
    met: dict[str, list[tuple[str, int, bool]]] = {}
    for word, n, short in group:
        for v in variants(rest(word, key), short):
            others = met.setdefault(v, [])
            yield from (((word, n), (a, m)) for a, m, s in others if v[0] == "=" or s != short)
            others.append((word, n, short))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


_SIDES = pa.schema([("key", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("short", pa.bool_())])
_MET = pa.schema([("key", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("short", pa.bool_()), ("near", pa.string()), ("near_n", pa.int64())])
#: Shared sides are counted by this many hashes to tell those that hold many of all rows.
HASHES = 1 << 20


def near_pairs(words: DataFrame, hot: int = HOT, heavy: float = HEAVY) -> DataFrame:
    """(word, n, near, near_n): all pairs of near words of a written table (word, n), both ways round, some of them repeated."""
    spark, known = words.sparkSession, bigram_counts(words)
    held = spark.sparkContext.broadcast(known)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield from _batches(((key, word, n, short) for word, n in read for key, short in sides(word, held.value)), _SIDES)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of a sorted part: pairs, or the rows themselves where a group is larger than ``hot``."""

        def rows() -> Iterator[tuple]:
            key, group, large = None, [], False
            for b in batches:
                for k, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if k != key:
                        yield from pairs(key, group)
                        key, group, large = k, [], False
                    group.append(tuple(row))
                    if large or len(group) > hot:
                        large = True
                        yield from ((key, *x, None, None) for x in group)
                        group = []
            yield from pairs(key, group)

        def pairs(key: str | None, group: list[tuple[str, int, bool]]) -> Iterator[tuple]:
            if len(group) > 1:
                for (a, n), (b, m) in near_in_group(key, group):
                    yield None, a, n, None, b, m
                    yield None, b, m, None, a, n

        yield from _batches(rows(), _MET)

    def variant_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from _batches(((f"{key}/{v}", word, n, short) for key, word, n, short in read for v in variants(rest(word, key), short)), _SIDES)

    side_rows = materialize(words.select("word", "n").mapInArrow(emit, "key string, word string, n bigint, short boolean"))
    bucket = F.pmod(F.xxhash64("key"), F.lit(HASHES)).cast("int")
    least = max(hot, int(side_rows.count() * heavy))
    many = materialize(side_rows.groupBy(bucket.alias("bucket")).count().where(F.col("count") > least).select("bucket"))  # fewer than 1 / heavy rows
    marked = side_rows.withColumn("bucket", bucket)
    sorted_rows = marked.join(F.broadcast(many), "bucket", "left_anti").select("key", "word", "n", "short").repartition("key").sortWithinPartitions("key")
    met = materialize(sorted_rows.mapInArrow(compare, "key string, word string, n bigint, short boolean, near string, near_n bigint"))
    large = met.where("key is not null").select("key", "word", "n", "short").unionByName(marked.join(F.broadcast(many), "bucket").select("key", "word", "n", "short"))
    found = met.where("key is null").select("word", "n", "near", "near_n")
    if not has_rows(large):
        drop(side_rows)
        return found
    group = large.mapInArrow(variant_rows, "key string, word string, n bigint, short boolean").groupBy("key").agg(F.collect_list(F.struct("word", "n", "short")).alias("x")).where(F.size("x") > 1)
    pair = group.select("key", "x", F.explode("x").alias("a")).select("key", "a", F.explode("x").alias("b"))
    pair = pair.where((F.col("a.word") != F.col("b.word")) & ((F.instr("key", "/=") > 0) | (F.col("a.short") != F.col("b.short"))))
    return found.unionByName(pair.select("a.word", "a.n", F.col("b.word").alias("near"), F.col("b.n").alias("near_n")))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): links are followed by doubling until none goes further. Forms are TIMES as frequent as
    their words, so there are no rings and a few rounds do."""
    at = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.alias("a").join(at.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        new = materialize(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), at)
        moved, at = has_rows(new.where("moved")), new
        if not moved:
            return at.select("word", "root")


def variants_of_words(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH, least: int = LEAST, times: int = TIMES, hot: int = HOT, heavy: float = HEAVY) -> DataFrame:
    """word, form (its near word of largest n, ties: smallest, if that n is at least ``times`` its own; else null), root (where
    forms end), n, n_near, form_n."""
    if length < 4:
        raise ValueError("words of fewer than 4 code points may have no bigram that an edit leaves alone")
    words = materialize(word_counts(docs, text_col, id_col, length, least))
    pairs = near_pairs(words, hot, heavy).repartition("word").groupBy("word", "n", "near", "near_n").agg(F.lit(1).alias("one"))
    best = F.struct(F.col("near_n").alias("n"), F.col("near"))
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.max("near_n").alias("most"), F.min(F.struct((-best["n"]).alias("order"), F.col("near"))).alias("best"))
    near = materialize(near.select("word", "n_near", F.col("most").alias("near_n"), F.col("best.near").alias("near")))
    made = words.join(near, "word", "left").withColumn("has", F.coalesce(F.col("near_n") >= times * F.col("n"), F.lit(False)))
    made = materialize(made.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("near")).alias("form"), F.when(F.col("has"), F.col("near_n")).alias("form_n")), near)
    found = made.join(_roots(made.where("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
