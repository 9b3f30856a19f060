"""Where the reader is: next and previous sentences, words at a time, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import ROWS, Ranges, positions


def readable(kind: Column, with_furniture: bool = False) -> Column:
    return F.lit(True) if with_furniture else kind == "body"


def readable_ids(sentences: DataFrame, with_furniture: bool = False, rows: int = ROWS) -> DataFrame:
    """(doc_id, place, sent_id) of the readable sentences, place counted from 0 in order."""
    ok = sentences.where(readable(F.col("kind"), with_furniture)).select("doc_id", "sent_id")
    return positions(ok, "doc_id", "sent_id", rows).select("doc_id", F.col("pos").alias("place"), "sent_id")


def full_text(sentences: DataFrame) -> DataFrame:
    """(doc_id, text): all sentences of a document with single spaces between."""
    rows = F.array_sort(F.collect_list(F.struct("sent_id", "text")))
    return sentences.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r.text), " ").alias("text"))


def neighbours(sentences: DataFrame, with_furniture: bool = False, rows: int = ROWS) -> DataFrame:
    """Each sentence (doc_id, sent_id, kind) with the next and previous readable one; itself counts."""
    ok = F.when(readable(F.col("kind"), with_furniture), F.col("sent_id"))
    return Ranges(sentences, "doc_id", "sent_id", rows).scan(nexts={"next_readable": ok}, lasts={"prev_readable": ok}).rows()


def word_at(times: DataFrame, words: DataFrame, rows: int = ROWS) -> DataFrame:
    """The word spoken at each time (clip, t): the last that has begun (words: clip, idx, start), else the first.
    Words and times are merged in one order and scanned, rather than compared in pairs; a clip's words and lookups may lie in
    many ranges, so no task has them all."""
    events = words.select("clip", F.col("start").alias("at"), F.lit(0).alias("is_query"), F.col("idx").cast("long").alias("idx"), F.lit(None).cast("double").alias("t"))
    events = events.unionByName(times.select("clip", F.col("t").alias("at"), F.lit(1).alias("is_query"), F.lit(None).cast("long").alias("idx"), F.col("t").cast("double")))
    found = Ranges(events, "clip", ["at", "is_query", "idx"], rows).scan(lasts={"word": F.col("idx")}).rows()
    return found.where("is_query = 1").select("clip", "t", F.coalesce("word", F.lit(0)).alias("word"))


def words_at(words: DataFrame, times: tuple[float, ...]) -> DataFrame:
    """As word_at(), where each clip is asked for the same few times: words (clip, idx, start, in order) are never sorted, and tasks
    reduce them before they are shuffled."""
    begun = [F.coalesce(F.max(F.when(F.col("start") <= t, F.col("idx"))), F.lit(0)).cast("long") for t in times]
    found = words.groupBy("clip").agg(F.array(*[F.struct(F.lit(t).alias("t"), w.alias("word")) for t, w in zip(times, begun)]).alias("found"))
    return found.select("clip", F.inline("found"))


def scrub(sentences: DataFrame, fraction: Column, rows: int = ROWS) -> DataFrame:
    """The readable sentence at a fraction of each document."""
    ranked = readable_ids(sentences, rows=rows)
    wanted = ranked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select("doc_id", F.least(F.col("n") - 1, F.floor(fraction * F.col("n"))).alias("place"))
    return ranked.join(wanted, ["doc_id", "place"]).select("doc_id", "sent_id")


def reading_time(sentences: DataFrame, at: Column, speed: float = 1.0, average: float = 3.2) -> DataFrame:
    """Seconds before the position and in all, of readable sentences; an unknown duration counts as ``average``."""
    d = F.when(readable(F.col("kind")), F.coalesce("duration", F.lit(average)))
    return sentences.groupBy("doc_id").agg((F.coalesce(F.sum(F.when(F.col("sent_id") < at, d)), F.lit(0.0)) / speed).alias("before"), (F.coalesce(F.sum(d), F.lit(0.0)) / speed).alias("total"))


def resume_point(sentences: DataFrame, positions: DataFrame) -> DataFrame:
    """The stored position (doc_id, position), not past the last sentence, then the next readable one, else 0."""
    last = sentences.groupBy("doc_id").agg(F.max("sent_id").alias("last"))
    wanted = positions.join(last, "doc_id").select("doc_id", F.least("position", "last").alias("sent_id"))
    return wanted.join(neighbours(sentences), ["doc_id", "sent_id"], "left").select("doc_id", F.greatest(F.lit(0), F.coalesce("next_readable", F.lit(0))).alias("sent_id"))


def first_readable(sentences: DataFrame) -> DataFrame:
    return sentences.groupBy("doc_id").agg(F.coalesce(F.min(F.when(readable(F.col("kind")), F.col("sent_id"))), F.lit(0)).alias("sent_id"))
