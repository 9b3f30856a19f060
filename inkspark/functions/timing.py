"""Weights and times of words, and sizes of clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import let, prefix_sums, running

# Pause weight of punctuation.
PAUSES = {",": 3, ";": 4, ":": 4, ".": 6, "!": 6, "?": 6, "—": 4}
WORD_FLOOR = 2


def word_weight(word: Column) -> Column:
    """2, 1 for each letter or digit, and the pauses of punctuation; marks of equal weight are counted at once."""
    weight = F.length(F.regexp_replace(word, r"[^\p{L}\p{N}]+", "")) + WORD_FLOOR
    for pause in sorted(set(PAUSES.values())):
        marks = "".join(mark for mark, p in PAUSES.items() if p == pause)
        weight = weight + pause * (F.length(word) - F.length(F.translate(word, marks, "")))
    return weight.cast("long")


def weights_of(text: Column) -> Column:
    """word_weight() of each word of a text in which single spaces separate words (see text.collapse()), in a few passes over the
    text as a whole: what has no weight goes, a mark becomes as many letters as it weighs, and what is left of a word is counted."""
    bare = F.regexp_replace(text, rf"[^\p{{L}}\p{{N}} {''.join(PAUSES)}]+", "")
    for mark, pause in PAUSES.items():
        bare = F.replace(bare, F.lit(mark), F.lit("x" * pause))
    weights = F.transform(F.split(bare, " "), lambda w: (F.length(w) + WORD_FLOOR).cast("long"))
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(weights)


def timed_words(rows: DataFrame, key: str, duration: Column) -> DataFrame:
    """As exploded_timings(), where a text's weights are in one row: without a shuffle."""
    summed = rows.select(key, "weights", prefix_sums(F.col("weights")).alias("upto"))
    each = summed.select(key, F.element_at("upto", -1).alias("total"), F.posexplode(F.arrays_zip("weights", "upto")).alias("idx", "w"))
    end = F.when(F.col("w.upto") == F.col("total"), duration).otherwise(duration * F.col("w.upto") / F.col("total"))
    return each.select(key, F.col("idx").cast("long").alias("idx"), (duration * (F.col("w.upto") - F.col("w.weights")) / F.col("total")).alias("start"), end.alias("end"))


def word_timings(words: Column, duration: Column) -> Column:
    """Start and end of each word: the duration dealt out by weight, in order; the last end is the duration itself."""

    def deal(weights: Column, total: Column) -> Column:
        upto = running(weights, F.lit(0).cast("long"), lambda s, w: s + w, lambda s: s, "bigint")
        end = lambda u: F.when(u == total, duration).otherwise(duration * u / total)
        return F.zip_with(weights, upto, lambda w, u: F.struct((duration * (u - w) / total).alias("start"), end(u).alias("end")))

    return let(F.transform(words, word_weight), lambda ws: let(F.aggregate(ws, F.lit(0).cast("long"), lambda s, w: s + w), lambda total: deal(ws, total)))


def exploded_timings(rows: DataFrame, key: str, duration: Column) -> DataFrame:
    """As word_timings(), of rows (key, weights): a row (key, idx, start, end) for each word. Prefix sums are a window,
    so that work is in proportion to the words of a long text."""
    totals = rows.select(key, "weights", F.aggregate("weights", F.lit(0).cast("long"), lambda s, w: s + w).alias("total"))
    each = totals.select(key, "total", F.posexplode("weights").alias("idx", "w"))
    upto = F.sum("w").over(Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    placed = each.withColumn("upto", upto)
    end = F.when(F.col("upto") == F.col("total"), duration).otherwise(duration * F.col("upto") / F.col("total"))
    return placed.select(key, F.col("idx").cast("long").alias("idx"), (duration * (F.col("upto") - F.col("w")) / F.col("total")).alias("start"), end.alias("end"))


def content_key(preset: Column, spoken: Column, prefix: str = "kokoro") -> Column:
    """24 hex digits that name a clip: of its voice and spoken text."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(prefix), preset, spoken), 256), 1, 24)


def pack_limit(bank: Column, chars_per_second: Column, ratio: Column) -> Column:
    """Characters that the next clip may have with ``bank`` seconds of speech in hand."""
    floor = F.least(F.lit(260), F.greatest(F.lit(44), F.round(1.5 * chars_per_second / ratio)))
    return F.greatest(floor, F.least(F.lit(260), F.round(bank * 0.96 / ratio * chars_per_second))).cast("long")


def ratio_hint(device: Column, dtype: Column) -> Column:
    """Seconds of work for a second of speech, before any was measured."""
    return F.when(device == "webgpu", 0.12).when(dtype == "fp32", 0.65).otherwise(1.05)


def first_wait_ms(limit: Column, chars_per_second: Column, ratio: Column) -> Column:
    return F.greatest(F.lit(400.0), 1000 * limit / chars_per_second * ratio)


def tail_ms(ends_sentence: Column) -> Column:
    """Silence to leave after a clip."""
    return F.when(ends_sentence, 220).otherwise(40)


def metered(save_data: Column, effective_type: Column) -> Column:
    return F.coalesce(save_data, F.lit(False)) | F.coalesce(effective_type.isin("slow-2g", "2g", "3g"), F.lit(False))


def usable_gpu(gpu: Column, fallback: Column, max_buffer: Column) -> Column:
    small = F.coalesce((max_buffer != 0) & (max_buffer < 256_000_000), F.lit(False))
    return F.coalesce(gpu, F.lit(False)) & ~F.coalesce(fallback, F.lit(False)) & ~small


def pick_backend(cores: Column, memory: Column, preference: Column, is_metered: Column, has_gpu: Column, isolated: Column) -> Column:
    """A struct of device, dtype and why, from ordered rules."""
    big = F.coalesce(preference == "big", F.lit(False))
    known = F.coalesce(memory, F.lit(0.0))

    def pick(device: str, dtype: str, why: str) -> Column:
        return F.struct(F.lit(device).alias("device"), F.lit(dtype).alias("dtype"), F.lit(why).alias("why"))

    return (
        F.when(F.coalesce(preference == "small", F.lit(False)), pick("wasm", "q8", "chosen"))
        .when(~big & is_metered, pick("wasm", "q8", "metered"))
        .when(~big & (known != 0) & (known < 4), pick("wasm", "q8", "memory"))
        .when(has_gpu, pick("webgpu", "fp32", "gpu"))
        .when(isolated & (big | ((cores >= 8) & ((known == 0) | (known >= 8)))), pick("wasm", "fp32", "cores"))
        .when(~isolated, pick("wasm", "q8", "not isolated"))
        .otherwise(pick("wasm", "q8", "small machine"))
    )


def worker_budget(device: Column, dtype: Column, cores: Column, memory: Column) -> Column:
    known = F.coalesce(memory, F.lit(0.0))
    full = F.when((known != 0) & (known < 8), 1).when(cores >= 12, 2).otherwise(1)
    return F.when(device == "webgpu", 1).when(dtype == "fp32", full).when(cores >= 12, 3).when(cores >= 8, 2).otherwise(1)


def thread_count(cores: Column, workers: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(6), F.floor(cores / workers))).cast("int")
