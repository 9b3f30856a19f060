"""Post-processing of audio of any length: a clip is many rows (clip, at, x), each with some samples from place ``at`` on.

What the functions of ``functions.audio`` do to one array is done here without ever having one: places and levels of a clip are
found from what its rows say by themselves (maxima, first and last loud samples, sums of squares of windows, counts of
digits), and then each row is cut and scaled by itself. Rows of a clip follow each other without gaps; samples are finite.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.functions import audio as A
from inkspark.sources.scratch import kept

#: Samples of a row: a little over a second at 24 kHz.
SIZE = 1 << 15
#: Bits of a double that a counting pass looks at.
DIGIT = 16


def in_rows(samples: DataFrame, clip: str, x: str, size: int = SIZE) -> DataFrame:
    """Arrays of samples (clip, x) as rows of ``size`` samples. An empty clip has one row, without samples."""
    begins = F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(size))
    return samples.select(F.col(clip).alias("clip"), F.explode(F.transform(begins, lambda i: F.struct(i.cast("long").alias("at"), F.slice(x, i + 1, size).alias("x")))).alias("r")).select("clip", "r.at", "r.x")


def order_statistics(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """(clip, rank, v): for each of ``ranks`` (clip, rank; from 0) the magnitude of that rank, exactly.

    Doubles that are not negative are in the order of their bits. A pass counts, for each clip, the next DIGIT bits of the
    values that begin as the wanted one does, and so gives its next digit: a few passes over the samples, each with at most
    2**DIGIT counts for each wanted rank, added up in the tasks first. Nothing is sorted."""
    found = kept(ranks.select("clip", "rank", F.lit(0).cast("long").alias("prefix"), F.col("rank").alias("left")))
    for taken in range(0, 64, DIGIT):
        shift = 64 - taken - DIGIT

        def count(batches: Iterator[pa.RecordBatch], shift: int = shift, taken: int = taken) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clips, prefixes = b.column("clip").take(pa.array([], pa.int32())).to_pylist(), []
                digits, counts = [], []
                for i, prefix in enumerate(b.column("prefix").to_pylist()):
                    x = b.column("x")[i].values
                    bits = np.abs(np.asarray(x.to_numpy(zero_copy_only=False), np.float64)).view(np.int64) if x is not None else np.zeros(0, np.int64)
                    same = bits if taken == 0 else bits[bits >> (shift + DIGIT) == prefix]
                    digit, n = np.unique((same >> shift) & ((1 << DIGIT) - 1), return_counts=True)
                    clips += [b.column("clip")[i].as_py()] * len(n)
                    prefixes += [prefix] * len(n)
                    digits.append(digit)
                    counts.append(n)
                yield pa.RecordBatch.from_arrays([pa.array(clips, b.schema.field("clip").type), pa.array(prefixes, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *digits])), pa.array(np.concatenate([np.zeros(0, np.int64), *counts]))], ["clip", "prefix", "digit", "n"])

        wanted = found.select("clip", "prefix").distinct()
        kind = rows.schema["clip"].dataType.simpleString()
        counted = rows.join(wanted, "clip").select("clip", "prefix", "x").mapInArrow(count, f"clip {kind}, prefix long, digit long, n long").groupBy("clip", "prefix", "digit").agg(F.sum("n").alias("n"))
        upto = counted.groupBy("clip", "prefix").agg(F.array_sort(F.collect_list(F.struct("digit", "n"))).alias("counts"))  # 2**DIGIT at most
        none = F.struct(F.lit(None).cast("long").alias("digit"), F.col("left").alias("left"))
        step = lambda acc, c: F.when(acc["digit"].isNotNull(), acc).otherwise(F.struct(F.when(acc["left"] < c.n, c.digit).alias("digit"), F.when(acc["left"] < c.n, acc["left"]).otherwise(acc["left"] - c.n).alias("left")))
        new = found.join(upto, ["clip", "prefix"]).withColumn("next", F.aggregate("counts", none, step))
        found = kept(new.select("clip", "rank", (F.shiftleft("prefix", DIGIT) + F.col("next.digit")).alias("prefix"), F.col("next.left").alias("left")), found)

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("clip"), b.column("rank"), pa.array(b.column("prefix").to_numpy().view(np.float64))], ["clip", "rank", "v"])

    return found.select("clip", "rank", "prefix").mapInArrow(value, f"clip {rows.schema['clip'].dataType.simpleString()}, rank long, v double")


def quantiles(rows: DataFrame, q: float) -> DataFrame:
    """(clip, v): a quantile of each clip's magnitudes, interpolated between the two nearest; none for empty clips."""
    sizes = kept(rows.groupBy("clip").agg(F.sum(F.size("x")).alias("n")).where("n > 0").withColumn("place", (F.col("n") - 1) * F.lit(q)))
    low, high = F.floor("place"), F.least(F.floor("place") + 1, F.col("n") - 1)
    stats = order_statistics(rows, sizes.select("clip", F.explode(F.array_distinct(F.array(low, high))).alias("rank")))
    both = stats.groupBy("clip").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return sizes.join(both, "clip").select("clip", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - low)).alias("v"))


def declicked(rows: DataFrame) -> DataFrame:
    """As audio.declicked(): clipped at 1.5 times the 99.9th percentile of the magnitude, then the peak scaled to 0.92."""
    peaks = rows.groupBy("clip").agg(F.max(A.peak(F.col("x"))).alias("peak"))
    levels = peaks.join(quantiles(rows, 0.999), "clip").select("clip", (1.5 * F.col("v")).alias("most"), F.least("peak", 1.5 * F.col("v")).alias("top"))
    scaled = F.transform("x", lambda v: F.greatest(-F.col("most"), F.least(F.col("most"), v)) * (0.92 / F.col("top")))
    return rows.join(levels, "clip", "left").select("clip", "at", F.when(F.coalesce("top", F.lit(0.0)) == 0, F.col("x")).otherwise(scaled).alias("x"))


def _cut(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows with only what lies from ``first`` to ``last`` (exclusive) of ``spans`` (clip, first, last, and more), placed anew from 0."""
    both = rows.join(spans, "clip").withColumn("n", F.size("x")).where((F.col("at") < F.col("last")) & (F.col("at") + F.col("n") > F.col("first")))
    skip = F.greatest(F.col("first") - F.col("at"), F.lit(0)).cast("int")
    stay = (F.least(F.col("last") - F.col("at"), F.col("n").cast("long")) - skip).cast("int")
    return both.withColumn("x", F.slice("x", skip + 1, stay)).withColumn("at", F.greatest(F.col("at") - F.col("first"), F.lit(0))).drop("n")


def trimmed(rows: DataFrame, rate: int, below_peak_db: float = -42.0, pad_ms: int = 25) -> DataFrame:
    """As audio.trimmed(): from ``pad_ms`` before the first loud sample to as much after the last one (exclusive)."""
    pad = rate * pad_ms // 1000
    sizes = rows.groupBy("clip").agg(F.max(A.peak(F.col("x"))).alias("peak"), F.sum(F.size("x")).alias("n"))
    least = F.col("peak") * 10 ** (below_peak_db / 20)
    places = F.filter(F.transform("x", lambda v, i: F.when(F.abs(v) > least, i)), lambda i: i.isNotNull())
    loud = rows.join(sizes, "clip").select("clip", "n", "at", places.alias("p")).where("size(p) > 0")
    spans = loud.groupBy("clip").agg(F.min(F.col("at") + F.element_at("p", 1)).alias("a"), F.max(F.col("at") + F.element_at("p", -1)).alias("b"), F.max("n").alias("n"))
    spans = kept(spans.select("clip", F.greatest(F.col("a") - pad, F.lit(0)).alias("first"), F.least(F.col("n"), F.col("b") + pad).alias("last")))
    quiet = rows.join(spans, "clip", "left_anti").select("clip", "at", "x")
    return _cut(rows, spans).select("clip", "at", "x").unionByName(quiet)


def silence_spans(rows: DataFrame, rate: int, floor: float = 0.004, window_ms: int = 10) -> DataFrame:
    """As audio.silence_span(): (clip, start, end, n) of what is not silent, by whole windows that are quiet from either end. A
    row tells its part of the sum of squares of each window; windows go from the clip's start, and from its end."""
    win = max(1, round(rate * window_ms / 1000))
    sizes = kept(rows.groupBy("clip").agg(F.sum(F.size("x")).alias("n")))
    energy = lambda a, m: F.aggregate(F.slice("x", a + 1, m), F.lit(0.0), lambda s, v: s + v * v)

    def parts(offset: Column) -> Column:
        """(k, e) of the windows that the row's samples are in: window k begins at offset + k * win."""
        begin = F.col("at") - offset
        windows = F.sequence(F.floor(begin / win), F.floor((begin + F.size("x") - 1) / win))
        inside = lambda k: F.greatest(k * win - begin, F.lit(0)).cast("int")
        upto = lambda k: F.least((k + 1) * win - begin, F.size("x").cast("long")).cast("int")
        return F.transform(windows, lambda k: F.struct(k.alias("k"), energy(inside(k), upto(k) - inside(k)).alias("e")))

    placed = rows.where(F.size("x") > 0).join(sizes, "clip")
    each = placed.select("clip", "n", F.explode(F.concat(F.transform(parts(F.lit(0).cast("long")), lambda p: F.struct(F.lit(True).alias("fore"), p.k, p.e)), F.transform(parts(F.col("n") % win), lambda p: F.struct(F.lit(False).alias("fore"), p.k, p.e)))).alias("p"))
    sums = each.groupBy("clip", "n", "p.fore", "p.k").agg(F.sum("p.e").alias("e"))
    long = F.when(F.col("fore"), F.least(F.lit(win).cast("long"), F.col("n") - F.col("k") * win)).otherwise(win)
    loud = sums.where(((~F.col("fore") & (F.col("k") >= 0)) | F.col("fore")) & (F.sqrt(F.col("e") / long) >= floor))
    found = loud.groupBy("clip").agg(F.min(F.when(F.col("fore"), F.col("k") * win)).alias("a"), F.max(F.when(~F.col("fore"), F.col("n") % win + (F.col("k") + 1) * win)).alias("b"))
    last_window = F.greatest(F.ceil(F.col("n") / win) - 1, F.lit(0)) * win
    start = F.least(F.coalesce("a", last_window), last_window)
    spans = sizes.join(found, "clip", "left").withColumn("start", F.when(F.col("n") > 0, start).otherwise(0))
    reach = F.col("n") - F.greatest(F.ceil((F.col("n") - F.col("start") - win) / win), F.lit(0)) * win
    end = F.when(F.col("n") > 0, F.greatest(F.coalesce("b", reach), reach)).otherwise(0)
    return spans.select("clip", F.col("start").cast("long").alias("start"), end.cast("long").alias("end"), "n")


def trimmed_with_ramps(rows: DataFrame, spans: DataFrame, rate: int, tail_ms: int) -> DataFrame:
    """As audio.trimmed_with_ramps(): a span (clip, start, end, n) with 20 ms before and ``tail_ms`` after, and 3 ms ramps at both
    ends; silence as it is."""
    spans = kept(spans)
    wide = spans.where("end > start").select("clip", F.greatest(F.col("start") - round(rate * 0.02), F.lit(0)).alias("first"), F.least("n", F.col("end") + round(rate * tail_ms / 1000)).alias("last"))
    size = F.col("last") - F.col("first")
    ramp = F.least(F.lit(round(rate * 0.003)).cast("long"), F.floor(size / 2))

    def gain(i: Column) -> Column:
        fore, back = F.when(i < ramp, i / ramp).otherwise(1.0), F.when(size - 1 - i < ramp, (size - 1 - i) / ramp).otherwise(1.0)
        return fore * back

    made = _cut(rows, wide).withColumn("x", F.transform("x", lambda v, i: v * gain(F.col("at") + i))).select("clip", "at", "x")
    return made.unionByName(rows.join(wide, "clip", "left_anti").select("clip", "at", "x"))
