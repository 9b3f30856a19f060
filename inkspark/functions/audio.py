"""Functions over arrays of samples (doubles)."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def mean_square(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / F.greatest(F.size(x), F.lit(1))


def rms(x: Column) -> Column:
    return F.sqrt(mean_square(x))


def count_where(x: Column, test) -> Column:
    return F.size(F.filter(x, test))


def stats(x: Column, rate: Column) -> Column:
    """Struct of seconds, rms, peak, clipped, silent_fraction and zcr (zero crossings for each sample)."""
    n = F.greatest(F.size(x), F.lit(1))
    crossings = F.size(F.filter(F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: (a < 0) != (b < 0)), lambda c: c))
    return F.struct(
        (F.size(x) / rate).alias("seconds"), rms(x).alias("rms"), F.coalesce(F.array_max(F.transform(x, F.abs)), F.lit(0.0)).alias("peak"),
        count_where(x, lambda v: F.abs(v) >= 0.999).alias("clipped"), (count_where(x, lambda v: F.abs(v) < 1e-4) / n).alias("silent_fraction"), (crossings / n).alias("zcr"),
    )


def envelope(x: Column, bins: int = 400) -> Column:
    """RMS of each of ``bins`` equal parts; 0 where there are no samples."""
    per = F.greatest(F.lit(1), F.floor(F.size(x) / bins)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.when(b * per >= F.size(x), F.lit(0.0)).otherwise(rms(F.slice(x, b * per + 1, per))))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's, 0 where either has no variance."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)

    def of_means(m: Column) -> Column:
        covariance = total(F.zip_with(a, b, lambda x, y: (x - m.a) * (y - m.b)))
        one, two = total(F.transform(a, lambda x: (x - m.a) * (x - m.a))), total(F.transform(b, lambda y: (y - m.b) * (y - m.b)))
        return F.when((one == 0) | (two == 0), F.lit(0.0)).otherwise(covariance / F.sqrt(one * two))

    return let(F.struct((total(a) / n).alias("a"), (total(b) / n).alias("b")), of_means)


# Limits of a clip that is speech.
LEAST_RMS, MOST_SILENT, MOST_CLIPPED, CHARS_A_SECOND, LEAST_LENGTH, MOST_BRIGHT = 0.01, 0.6, 8, 5, 0.8, 1.5


def verdict(s: Column, chars: Column, base: Column) -> Column:
    """What is wrong with a clip: an array of flags from its stats(), the characters it speaks, and the stats of the same text in a
    baseline (null where there is none). A clip that is not all finite has that flag alone, for no comparison with NaN holds."""
    broken = s.rms.isNull() | F.isnan(s.rms) | (F.abs(s.rms) == float("inf")) | s.peak.isNull()
    flags = [
        (s.seconds > chars / CHARS_A_SECOND, "too long"), (s.rms < LEAST_RMS, "near-silent"), (s.silent_fraction > MOST_SILENT, "silence"), (s.clipped > MOST_CLIPPED, "clipped"),
        (s.seconds < base.seconds * LEAST_LENGTH, "shorter than baseline"), (s.zcr > base.zcr * MOST_BRIGHT, "brighter than baseline"),
    ]
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in flags]), lambda f: f.isNotNull())
    return F.when(broken, F.array(F.lit("non-finite"))).otherwise(found)


def shaped(nested_audio: Column, nested_rate: Column, audio: Column, rate: Column) -> Column:
    """A result's samples and rate, wherever it has them: beside each other or one level down; 24 kHz where no rate is given."""
    given = lambda r: F.when(r != 0, r)
    samples = F.coalesce(audio, nested_audio, F.array().cast("array<double>"))
    return F.struct(samples.alias("samples"), F.coalesce(given(rate), given(nested_rate), F.lit(24000)).alias("rate"))


def finite(x: Column) -> Column:
    return F.transform(x, lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v))


def quantile(x: Column, q: float) -> Column:
    """With linear interpolation between the two nearest values."""
    at = (F.size(x) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    return let(F.array_sort(x), lambda s: F.get(s, low) + (F.get(s, F.least(low + 1, F.size(s) - 1)) - F.get(s, low)) * (at - low))


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def declicked(x: Column) -> Column:
    """Clipped at 1.5 times the 99.9th percentile of the magnitude, then the peak scaled to 0.92. Needs ``x`` to be finite
    (see finite()); silence and emptiness stay as they are."""
    clipped = let(1.5 * quantile(F.transform(x, F.abs), 0.999), lambda most: F.transform(x, lambda v: F.greatest(-most, F.least(most, v))))
    scaled = let(clipped, lambda c: let(0.92 / F.nullif(peak(c), F.lit(0.0)), lambda gain: F.transform(c, lambda v: v * gain)))
    return F.when(F.coalesce(peak(x), F.lit(0.0)) == 0, x).otherwise(F.when(F.exists(scaled, lambda v: v.isNull()), x).otherwise(scaled))


def trimmed(x: Column, rate: Column, below_peak_db: float = -42.0, pad_ms: int = 25) -> Column:
    """From ``pad_ms`` before the first loud sample to as much after the last one (exclusive)."""
    pad = F.floor(rate * pad_ms / 1000).cast("int")
    loud = let(peak(x) * (10 ** (below_peak_db / 20)), lambda least: F.filter(F.transform(x, lambda v, i: F.when(F.abs(v) > least, i)), lambda i: i.isNotNull()))

    def cut(at: Column) -> Column:
        first, last = F.greatest(F.lit(0), F.array_min(at) - pad), F.least(F.size(x), F.array_max(at) + pad)
        return F.when(F.coalesce(F.size(at), F.lit(0)) == 0, x).otherwise(F.slice(x, first + 1, F.greatest(F.lit(0), last - first)))

    return let(loud, cut)


def silence_span(x: Column, rate: Column, floor: float = 0.004, window_ms: int = 10) -> Column:
    """Struct of start and end of what is not silent: whole windows that are quiet go from either end."""
    win = F.greatest(F.lit(1), F.round(rate * window_ms / 1000)).cast("int")
    n = F.size(x)
    quiet = lambda i: rms(F.slice(x, i + 1, F.least(win, n - i))) < floor
    windows = F.sequence(F.lit(0), F.floor(n / win).cast("int"))
    first = F.array_min(F.filter(F.transform(windows, lambda k: k * win), lambda i: (i + win >= n) | ((i < n) & ~quiet(i))))

    def span(start: Column) -> Column:
        end = F.array_max(F.filter(F.transform(windows, lambda k: n - k * win), lambda e: (e - win <= start) | ~quiet(F.greatest(e - win, F.lit(0)))))
        return F.struct(start.alias("start"), F.coalesce(end, n).alias("end"))

    return let(F.coalesce(first, F.lit(0)), span)


def trimmed_with_ramps(x: Column, span: Column, rate: Column, tail_ms: Column) -> Column:
    """The samples of a span with 20 ms before and ``tail_ms`` after, and 3 ms ramps at both ends; silence as it is."""
    first = F.greatest(F.lit(0), span.start - F.round(rate * 0.02).cast("int"))
    last = F.least(F.size(x), span.end + F.round(rate * tail_ms / 1000).cast("int"))

    def ramped(cut: Column) -> Column:
        n = F.size(cut)
        ramp = F.least(F.round(rate * 0.003).cast("int"), F.floor(n / 2).cast("int"))
        gain = lambda i: F.when(i < ramp, i / ramp).otherwise(1.0) * F.when(n - 1 - i < ramp, (n - 1 - i) / ramp).otherwise(1.0)
        return F.transform(cut, lambda v, i: v * gain(i))

    return F.when(span.end <= span.start, x).otherwise(let(F.slice(x, first + 1, F.greatest(F.lit(0), last - first)), ramped))


def pcm16(x: Column) -> Column:
    """Signed 16-bit values: clamped to -1..1, negatives times 32768, others 32767, cut towards zero."""
    return F.transform(x, lambda v: F.when(v < 0, F.greatest(F.lit(-1.0), v) * 32768).otherwise(F.least(F.lit(1.0), v) * 32767).cast("int"))


def blended(weighted: list[tuple[float, Column]]) -> Column:
    """Sum of vectors times weights."""
    weight, first = weighted[0]
    out = F.transform(first, lambda v: v * weight)
    for weight, x in weighted[1:]:
        out = F.zip_with(out, F.transform(x, lambda v: v * weight), lambda a, b: a + b)  # noqa: B023
    return out


def wav_header(data: Column) -> Column:
    """Struct of rate, channels, bits, data_bytes and seconds from the 44-byte header of a binary WAV column."""
    digits = F.hex(F.substring(data, 1, 44))

    def little(at: int, size: int) -> Column:
        return F.conv(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(at + size - 1, at - 1, -1)]), 16, 10).cast("long")

    rate, width, size = little(24, 4), little(32, 2), little(40, 4)
    return F.struct(rate.alias("rate"), little(22, 2).alias("channels"), little(34, 2).alias("bits"), size.alias("data_bytes"), (size / width / rate).alias("seconds"))


def wav_bytes(samples, rate: int) -> bytes:
    """A mono 16-bit WAV file; a small helper of sinks.wav_files()."""
    body = np.asarray(samples, "<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(body)) + body
