"""The stored library: listings, range scans, upserts, deletes with cascade, migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(position: Column, total: Column) -> Column:
    """Progress in whole percent, 0 where there is nothing to read."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(0)).otherwise(F.round(100 * position / total)).cast("long")


def listing(documents: DataFrame, sentences: DataFrame) -> DataFrame:
    """Documents (id, title, created, position) with their number of sentences and progress; newest first by the caller.
    Sentences are counted before the join, so the join meets one row for each document."""
    counts = sentences.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("sentences"))
    listed = documents.join(counts, "id", "left").withColumn("sentences", F.coalesce("sentences", F.lit(0)))
    return listed.withColumn("progress", percent(F.col("position"), F.col("sentences")))


def newest_first(listed: DataFrame) -> DataFrame:
    return listed.orderBy(F.desc("created"), F.desc("id"))


def sentences_from(sentences: DataFrame, doc_id: int, first: int, limit: int = 16) -> DataFrame:
    """One document's sentences from a position; the filters reach the scan."""
    return sentences.where((F.col("doc_id") == doc_id) & (F.col("sent_id") >= first)).orderBy("sent_id").limit(limit)


def windows_from(sentences: DataFrame, first: int, limit: int = 16) -> DataFrame:
    """As sentences_from(), for every document at once."""
    order = Window.partitionBy("doc_id").orderBy("sent_id")
    return sentences.where(F.col("sent_id") >= first).withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= limit)


def latest(updates: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """The last value of each key."""
    return updates.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``base`` with the non-null values of ``changes``, and those of ``changes`` with new keys."""
    values = [c for c in base.columns if c != key]
    a, b = base.alias("a"), changes.alias("b")
    return a.join(b, key, "full_outer").select(key, *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in values])


def delete_cascade(documents: DataFrame, sentences: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and sentences without those of ``gone`` (id)."""
    ids = gone.select("id").distinct()
    return documents.join(ids, "id", "left_anti"), sentences.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_anti")


def migrate(table: DataFrame, added: dict[str, tuple[str, object]]) -> DataFrame:
    """``table`` with the columns of ``added`` (name: type, default) that it lacks, and their nulls filled."""
    for name, (kind, default) in added.items():
        value = F.lit(default).cast(kind)
        table = table.withColumn(name, F.coalesce(F.col(name), value) if name in table.columns else value)
    return table


def encode_sentences(sentences: DataFrame) -> DataFrame:
    """``words`` (text, start, end) as the stored JSON [[text,start,end],...]."""
    word = lambda w: F.concat(F.lit("["), F.regexp_extract(F.to_json(F.struct(w.text.alias("t"))), r"^\{\"t\":(.*)\}$", 1), F.lit(","), w.start.cast("string"), F.lit(","), w.end.cast("string"), F.lit("]"))
    return sentences.withColumn("words", F.concat(F.lit("["), F.array_join(F.transform("words", word), ","), F.lit("]")))


def decode_words(words_json: Column) -> Column:
    rows = F.from_json(words_json, "array<array<string>>")
    return F.transform(rows, lambda w: F.struct(w[0].alias("text"), w[1].cast("int").alias("start"), w[2].cast("int").alias("end")))


def import_status(chunks: Column, words: Column | None = None) -> Column:
    """200, or 422 for a document with no sentence."""
    return F.when(F.size(chunks) > 0, 200).otherwise(422)


def put(table: DataFrame, rows: DataFrame, key: str, defaults: dict[str, Column], *order: str) -> DataFrame:
    """Insert or replace rows; columns that are missing or null get their defaults. Of rows with one key the last by ``order``
    counts; without an order, rows are taken to have different keys."""
    for name, value in defaults.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    if order:
        rows = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in table.columns if c != key]), F.struct(*order)).alias("__last")).select(key, "__last.*")
    return table.join(rows.select(key), key, "left_anti").unionByName(rows.select(*table.columns))


def files_to_remove(documents: DataFrame, cached: DataFrame, gone: DataFrame) -> DataFrame:
    """(id, path) of what a delete leaves on disk: the original file of each document (id, source_ext) of ``gone`` (id) that has
    one, and its page pictures among ``cached`` (path), whose names are the id, a dash and more."""
    ids = gone.select("id").distinct()
    originals = documents.join(ids, "id", "left_semi").where("source_ext IS NOT NULL").select("id", F.concat(F.col("id").cast("string"), "source_ext").alias("path"))
    named = cached.withColumn("id", F.regexp_extract("path", r"(?:^|/)(\d+)-[^/]*\.png$", 1)).where("id <> ''").withColumn("id", F.col("id").cast("long"))
    return originals.unionByName(named.join(ids, "id", "left_semi").select("id", "path"))


def found_status(asked: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Requests with a status: 200 where ``table`` has the key, else 404."""
    known = table.select(key).distinct().withColumn("__known", F.lit(200))
    return asked.join(known, key, "left").withColumn("status", F.coalesce("__known", F.lit(404))).drop("__known")


def list_answers(listed: DataFrame) -> DataFrame:
    """Of listing(): (id, answer), an object of id, title, position, created and total for each document."""
    fields = F.struct("id", "title", "position", F.col("created").cast("string").alias("created"), F.col("sentences").alias("total"))
    return listed.select("id", F.to_json(fields, {"ignoreNullFields": "false"}).alias("answer"))


def document_answers(documents: DataFrame, sentences: DataFrame) -> DataFrame:
    """(id, answer): a document (id, title, position, pages) with its sentences (doc_id, sent_id, text, words, kind, boxes) in order."""
    one = F.struct(F.col("sent_id").alias("id"), "text", "words", "kind", "boxes")
    inside = sentences.groupBy(F.col("doc_id").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("sentences"))
    whole = documents.join(inside, "id", "left").withColumn("sentences", F.coalesce("sentences", F.array().cast(inside.schema["sentences"].dataType)))
    return whole.select("id", F.to_json(F.struct("id", "title", "position", "pages", "sentences"), {"ignoreNullFields": "false"}).alias("answer"))


def chunk_answers(packs: DataFrame, *key: str) -> DataFrame:
    """Key and answer of spoken packs (name, duration, timings, parts)."""
    fields = F.struct(F.concat(F.lit("/api/audio/"), "name").alias("audio"), "duration", "timings", "parts")
    return packs.select(*key, F.to_json(fields).alias("answer"))


def voice_answers(presets: DataFrame) -> DataFrame:
    return presets.select("preset", F.to_json(F.struct(F.col("preset").alias("id"), "label")).alias("answer"))


def has_pages(pages: Column, original: Column) -> Column:
    """A document can be shown as it was if its pages and its file are there."""
    return F.coalesce((F.size(pages) > 0) & original.isNotNull(), F.lit(False))


def position_key(sent_id: Column, word: Column) -> Column:
    """'sentence+word'"""
    return F.concat_ws("+", sent_id.cast("string"), word.cast("string"))


def parse_position(key: Column) -> Column:
    parts = F.split(key, r"\+")
    return F.struct(parts[0].cast("long").alias("sent_id"), parts[1].cast("long").alias("word"))


def text_after_word(text: Column, words: Column, first: Column) -> Column:
    """The rest of a sentence from a word on."""
    return F.substr(text, F.coalesce(F.get(words, first).start, F.lit(0)) + 1)
