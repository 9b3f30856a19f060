"""Whole patterns within texts: an equality join on each pattern's rarest word n-gram, then a check of each pair that met."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.functions import text as T
from inkspark.functions.core import let
from inkspark.operators.joins import join_heavy
from inkspark.sources.scratch import kept

#: Words of a key, if a pattern has as many between its first and last word: those may be parts of longer words in a text.
WORDS = 5
#: Keys of patterns (16 bytes each) and pairs that met that are broadcast at most; more are joined by a shuffle.
KEYS, PAIRS = 1_000_000, 200_000
#: Counters of n-grams by which a pattern's rarest is told.
COUNTERS = 1 << 20


def _runs(ws: Column, n: int, first: Column | int = 1, last: Column | None = None) -> Column:
    """64-bit hashes of the runs of n words that begin at word ``first`` (from 1) to ``last``."""
    end = F.size(ws) - n + 1 if last is None else last
    return F.when(end < first, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(first) if isinstance(first, int) else first, F.greatest(end, F.lit(first))), lambda i: F.xxhash64(F.slice(ws, i, n))))


def ngram_keys(text: Column, lengths: list[int]) -> Column:
    """Hashes of all runs of so many words, repeats once."""
    return F.array_distinct(let(T.words(text), lambda ws: F.concat(*[_runs(ws, n) for n in lengths])))


def _bucket(key: Column) -> Column:
    return F.pmod(key, F.lit(COUNTERS)).cast("int")


def rarest_keys(texts: DataFrame, inner: DataFrame, lengths: list[int]) -> DataFrame:
    """(pattern, key): of each pattern (pattern, ws, n) the run of n words between its first and last whose counter is lowest over
    ``texts``. Counters are shared by many n-grams and never too low; a phrase that many patterns begin with is frequent at most in the
    patterns, and they have rarer ones. Counting is one pass with at most COUNTERS rows from each task."""
    own = F.coalesce(*[F.when(F.col("n") == n, _runs(F.col("ws"), n, 2, F.size("ws") - n)) for n in lengths])
    keys = kept(inner.select("pattern", F.explode(F.array_distinct(own)).alias("key")))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("patterns"))
    counted = texts.select(F.explode(ngram_keys(F.col("text"), lengths)).alias("key")).groupBy(_bucket(F.col("key")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    counted = F.broadcast(kept(counted))  # COUNTERS rows at most
    each = keys.join(shared, "key").withColumn("bucket", _bucket(F.col("key"))).join(counted, "bucket", "left")
    # what a key costs: the pairs that it lets meet
    cost = F.struct(F.coalesce("n", F.lit(0)) * F.col("patterns"), F.col("key"))
    return each.groupBy("pattern").agg(F.min_by("key", cost).alias("key"))


def hits(texts: DataFrame, patterns: DataFrame, text_id: str, pattern_id: str, most_keys: int | None = None, most_pairs: int | None = None) -> DataFrame:
    """(text_id, pattern_id) for each row of ``texts`` (text_id, text) and each of ``patterns`` (pattern_id, p) that the text holds
    whole. Any number of patterns of three words and more are looked for in one pass: by one key each, joined with the texts' n-grams. Shorter
    ones are compared with every text. Equal patterns are one. Null texts and patterns hold nothing; an empty pattern is in
    every text."""
    most_keys, most_pairs = KEYS if most_keys is None else most_keys, PAIRS if most_pairs is None else most_pairs
    texts = texts.select(text_id, "text")
    known = kept(patterns.where("p IS NOT NULL").groupBy("p").agg(F.min(F.xxhash64(pattern_id, "p")).alias("h"), F.collect_set(pattern_id).alias("ids")).withColumn("pattern", F.struct(F.col("h"), F.sha2("p", 256).alias("d"))).select("pattern", "p", "ids"))
    words = T.words(F.col("p"))
    inner = kept(known.select("pattern", words.alias("ws")).withColumn("n", F.least(F.size("ws") - 2, F.lit(WORDS))).where("n > 0"))
    lengths = sorted(r.n for r in inner.select("n").distinct().collect())  # WORDS numbers at most
    short = texts.join(F.broadcast(known.where(F.size(words) <= 2).select("p", "ids")), F.contains("text", "p")).select(text_id, F.explode("ids").alias(pattern_id))
    if not lengths:
        return short
    keys = kept(rarest_keys(texts, inner, lengths))
    grams = texts.select(text_id, F.explode(ngram_keys(F.col("text"), lengths)).alias("key"))
    met = grams.join(F.broadcast(keys) if keys.count() <= most_keys else keys, "key").select(text_id, "pattern").distinct()
    met = kept(met.join(known.select("pattern", "p", "ids"), "pattern").select(text_id, "p", "ids"))
    if met.count() <= most_pairs:
        pairs = texts.join(F.broadcast(met), text_id)
    else:
        counts = kept(texts.groupBy(text_id).agg(F.count(F.lit(1)).alias("__n")).join(met.groupBy(text_id).agg(F.collect_list(F.struct("p", "ids")).alias("__met")), text_id))
        pairs = join_heavy(texts.withColumn("__key", F.col(text_id)), counts.withColumnRenamed(text_id, "__key"), "__key", "__n").select(text_id, "text", F.inline("__met"))
    return pairs.where(F.contains("text", "p")).select(text_id, F.explode("ids").alias(pattern_id)).unionByName(short)
