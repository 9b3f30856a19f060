"""Phrase collocations by hashed counting passes (operator 11).

A text is lower-cased (A-Z), split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words ``[^\\x20\\x09]+``. Everything is
counted for each language (null: ``und``). Pass k counts phrases of k words exactly and, beside that, adds phrases of k + 1
words up in hash buckets (PCY, with DHP's rule that both shorter parts must have passed). What the next pass counts exactly has a
bucket of at least ``least`` occurrences, and first and last k words that are frequent themselves (Apriori). Buckets and the
names of frequent phrases reach the tasks as bitmaps of ``buckets`` bits, whatever the corpus has: at most 8 MB each. A bitmap
lets too much through at worst, never too little, and what goes through is counted by its words: counts are exact.

The number of buckets follows from the size that Spark knows of the table; it changes the work, not the rows. A task holds
one table of saturating bucket counters (64 MB at most) and some CHUNK bytes of texts, or one text if that is longer.

A candidate (2 to 5 words, a >= ``least``) is cut after each of its first words; the cut with the lowest
floor(1000 * a * n / (l * r)) counts, the first of equal ones. Candidates within a longer one that occurs as often are dropped;
a phrase one word longer shows that, since counts of nested phrases never rise. Ranks are taken within salts first, then among
the best of these, so no task sorts a language.

Null and empty texts have no words; an empty table gives no rows. Repeated rows count each time. Columns other than the two
named ones are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SALTS, drop, join_checked, join_counted, materialize

LEAST, LONGEST, BEST = 100, 5, 2000
#: Bytes of text that a task takes at a time.
CHUNK = 2 << 20
#: Bucket counters of a row that is passed on, and the fewest and most buckets.
BLOCK, BUCKETS = 1 << 14, (1 << 20, 1 << 26)
#: Bytes of the table, as Spark knows them, for each bucket.
BYTES_A_BUCKET = 64

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?\n\x0b\x0c\r"]] = 2
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PASS = "lang string, phrase string, n bigint, block int, counters binary"


def bucket_count(docs: DataFrame) -> int:
    known = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(max(1 << math.ceil(math.log2(max(known, 1) / BYTES_A_BUCKET + 1)), BUCKETS[0]), BUCKETS[1])


def _join_hash(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _ODD + word
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of some texts, in order: ids of equal words, hashes, pieces, and each one's language."""

    def __init__(self, texts: list[str], langs: list[str]) -> None:
        parts = [t.encode() for t in texts]
        at = np.frombuffer(b"\n".join(parts).translate(_LOWER), np.uint8)
        kind = _KIND[at]
        inside = np.zeros(len(at) + 2, np.int8)
        inside[1:-1] = kind == 0
        edge = np.diff(inside)
        start, size = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(at[kind == 0].tobytes())]).dictionary_encode()
        self.names, self.ids = words.dictionary, words.indices.to_numpy().astype(np.int64)
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), start)
        row = np.searchsorted(np.cumsum([0, *(len(p) + 1 for p in parts)]), start, "right") - 1
        self.langs, of_row = np.unique(np.array(langs, object), return_inverse=True)
        self.lang = of_row[row]
        self.hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in self.names.to_pylist()], np.uint64)[self.ids] if len(size) else np.zeros(0, np.uint64)
        self.seed = np.array([xxhash.xxh3_64_intdigest(x, seed=1) for x in self.langs], np.uint64)[self.lang] if len(size) else self.hashes

    def hash(self, k: int) -> np.ndarray:
        """Of the phrase of k words that begins at each word (those past the end are short)."""
        h = self.seed
        for j in range(k):
            h = _join_hash(h[: max(0, len(self.ids) - j)], self.hashes[j:])
        return h

    def whole(self, k: int) -> np.ndarray:
        """Whether k words from here on are in one piece."""
        n = max(0, len(self.ids) - k + 1)
        return self.piece[:n] == self.piece[k - 1 :]

    def counted(self, at: np.ndarray, k: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Language, phrase and number of the distinct phrases of k words that begin at ``at``."""
        group, wide = self.lang[at], max(1, len(self.names))
        for j in range(k):
            _, first, group, n = np.unique(group * wide + self.ids[at + j], return_index=True, return_inverse=True, return_counts=True)
        place = at[first]
        words = [self.names.take(pa.array(self.ids[place + j])) for j in range(k)]
        phrase = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())) if k > 1 else words[0]
        return pa.array(self.langs[self.lang[place]], pa.string()), phrase.cast(pa.large_string()).cast(pa.string()), n


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    h = h & np.uint64(len(bits) * 8 - 1)
    return (bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 == 1


def survivors(words: Words, k: int, bucketed: np.ndarray | None, frequent: np.ndarray | None) -> np.ndarray:
    """Whether the phrase of k words from here on may be frequent: by its bucket, and by its first and last k - 1 words."""
    may = words.whole(k)
    if bucketed is not None:
        shorter = _has(frequent, words.hash(k - 1))
        may = may & _has(bucketed, words.hash(k)) & shorter[: len(may)] & shorter[1 : len(may) + 1]
    return may


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    texts, langs, size = [], [], 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            texts.append(text)
            langs.append(lang)
            size += len(text)
            if size >= CHUNK:
                yield Words(texts, langs)
                texts, langs, size = [], [], 0
    if texts:
        yield Words(texts, langs)


def packed(counters: np.ndarray, first: int = 0) -> Iterator[tuple[int, bytes]]:
    """Blocks with a counter above zero: all counters, or where most are zero the places and values of the others."""
    for i in range(0, len(counters), BLOCK):
        part = counters[i : i + BLOCK]
        full = np.flatnonzero(part)
        if len(full):
            short = b"s" + full.astype("<u2").tobytes() + part[full].astype("<u4").tobytes()
            yield first + i // BLOCK, min(short, b"d" + part.astype("<u4").tobytes(), key=len)


def unpacked(data: bytes) -> tuple[np.ndarray | slice, np.ndarray]:
    if data[:1] == b"d":
        return slice(None), np.frombuffer(data, "<u4", offset=1)
    n = (len(data) - 1) // 6
    return np.frombuffer(data, "<u2", n, 1).astype(np.int64), np.frombuffer(data, "<u4", n, 1 + 2 * n)


def _pass(docs: DataFrame, k: int, buckets: int, least: int, longest: int, bucketed: bytes | None, frequent: bytes | None) -> DataFrame:
    """Rows of exact counts of a chunk (lang, phrase, n), and of bucket counters of a task (block, counters)."""
    held = [docs.sparkSession.sparkContext.broadcast(x) for x in (bucketed, frequent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [None if h.value is None else np.frombuffer(h.value, np.uint8) for h in held]
        counters = np.zeros(buckets if k < longest else 0, np.min_scalar_type(least))
        for words in _chunks(batches):
            may = survivors(words, k, *bits)
            lang, phrase, n = words.counted(np.flatnonzero(may), k)
            if len(n):
                yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(n, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], schema=schema)
            if k < longest:
                next_ones = words.whole(k + 1)
                next_ones &= may[: len(next_ones)] & may[1 : len(next_ones) + 1]
                at, n = np.unique(words.hash(k + 1)[: len(next_ones)][next_ones] & np.uint64(buckets - 1), return_counts=True)
                at = at.astype(np.int64)
                counters[at] = np.minimum(counters[at].astype(np.int64) + n, least)
        blocks = list(packed(counters))
        for i in range(0, len(blocks), 64):
            some = blocks[i : i + 64]
            empty = [pa.nulls(len(some), t) for t in (pa.string(), pa.string(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([b for b, _ in some], pa.int32()), pa.array([d for _, d in some], pa.binary())], schema=schema)

    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("block", pa.int32()), ("counters", pa.binary())])
    return docs.mapInArrow(run, _PASS)


def _bitmap(rows: DataFrame, buckets: int, least: int) -> bytes:
    """The buckets whose counters (block, counters) add up to ``least``. Each task adds blocks of its own, row after row; the
    driver gets ``buckets`` bits."""
    blocks = buckets // BLOCK

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, n = unpacked(data)
                sums = held.setdefault(block, np.zeros(BLOCK, np.uint32))
                sums[at] = np.minimum(sums[at] + n, least)
        made = [np.packbits(x >= least, bitorder="little").tobytes() for x in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(made, pa.binary())], ["block", "bits"])

    found = rows.repartition(min(blocks, 256), "block").mapInArrow(add, "block int, bits binary").collect()
    bits = np.zeros((blocks, BLOCK // 8), np.uint8)
    for r in found:
        bits[r.block] = np.frombuffer(r.bits, np.uint8)
    return bits.tobytes()


def _marks(frequent: DataFrame, buckets: int) -> DataFrame:
    """(block, counters) with a counter of one for each of the phrases (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(buckets, np.uint8)
        for b in batches:
            for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = np.array([xxhash.xxh3_64_intdigest(lang, seed=1)], np.uint64)
                for w in phrase.split(" "):
                    h = _join_hash(h, np.array([xxhash.xxh3_64_intdigest(w)], np.uint64))
                counters[int(h[0]) & (buckets - 1)] = 1
        made = list(packed(counters))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in made], pa.int32()), pa.array([d for _, d in made], pa.binary())], ["block", "counters"])

    return frequent.select("lang", "phrase").mapInArrow(run, "block int, counters binary")


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words with at least ``least`` occurrences (lang, phrase, words, a), and the number of
    words of each language (lang, n)."""
    buckets = buckets or bucket_count(docs)
    docs = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bucketed = frequent = total = None
    levels: list[DataFrame] = []
    for k in range(1, longest + 1):
        rows = materialize(_pass(docs, k, buckets, least, longest, bucketed, frequent))
        exact = rows.where("phrase is not null")
        if k == 1:
            total = materialize(exact.groupBy("lang").agg(F.sum("n").alias("n")))
        levels.append(materialize(exact.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least).select("lang", "phrase", F.lit(k).alias("words"), "a")))
        if k < longest:
            bucketed = _bitmap(rows.where("block is not null").select("block", "counters"), buckets, least)
            frequent = _bitmap(_marks(levels[-1], buckets), buckets, 1)
        drop(rows)
        if not any(frequent) or not any(bucketed):
            break
    found = levels[0]
    for more in levels[1:]:
        found = found.unionByName(more)
    return found, total


def _part(words: F.Column, first: F.Column | int, n: F.Column | int) -> F.Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, best: int = BEST, buckets: int | None = None) -> DataFrame:
    """For each language its ``best`` phrases by score, then a (both falling), then phrase: lang, rank, phrase, a, l, r, n, score."""
    known, total = frequent_phrases(docs, text_col, lang_col, least, longest, buckets)
    split, n = F.split("phrase", " "), F.col("words")
    found = known.where("words >= 2")
    longer = found.where("words >= 3").select("lang", F.explode(F.array(_part(split, 1, n - 1), _part(split, 2, n - 1))).alias("phrase"), "a").distinct()
    found = materialize(found.join(longer, ["lang", "phrase", "a"], "left_anti"))
    # Key 2k is the part before the cut after k words, 2k + 1 the part after it.
    cuts = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array(F.struct((2 * k).alias("key"), _part(split, 1, k).alias("part")), F.struct((2 * k + 1).alias("key"), _part(split, k + 1, n - k).alias("part"))))))
    parts = found.select("lang", "phrase", "words", "a", cuts.alias("cut")).select("lang", "phrase", "words", "a", "cut.key", "cut.part")
    sizes = materialize(parts.groupBy("lang", "part").agg(F.count("*").alias("rows")).join(known.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")), ["lang", "part"]))
    met = join_counted(parts, sizes, ["lang", "part"], "rows").groupBy("lang", "phrase", "words", "a")
    met = met.agg(F.map_from_entries(F.collect_list(F.struct("key", "f"))).alias("f"))  # 8 entries at most
    cut = met.select("lang", "phrase", "a", "f", F.explode(F.sequence(F.lit(1), n - 1)).alias("k"))
    cut = join_checked(cut.select("lang", "phrase", "a", "k", F.col("f")[F.col("k") * 2].alias("l"), F.col("f")[F.col("k") * 2 + 1].alias("r")), total, "lang", "inner", F.col("phrase"))
    scored = cut.withColumn("score", F.expr("cast(1000 as decimal(4,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = lowest.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near_best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= best)
    ranked = near_best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
