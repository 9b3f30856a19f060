"""Token counts of whole texts with a two-tier lookup on the map side (operator 3).

The vocabulary is a sentencepiece BPE model with identity normalisation and a dummy prefix: a text is the string of
its characters with a space in front, spaces written as U+2581. No piece of the vocabulary holds U+2581 after another
character (checked when the model is loaded), so no merge crosses from a character to a following space. A text is
therefore cut before each run of spaces into pre-tokens whose token counts add up exactly to the library's count.

* Tier 1: a hash table of the TABLE most frequent pre-tokens and their counts, broadcast. It is found from the whole
  corpus: each task keeps a bounded Misra-Gries summary and gives SUMMARY candidates at most.
* Tier 2: misses go through a bounded cache in each Python worker; what it lacks is encoded by the library.

Pre-tokens are never shuffled; only the bounded summaries are. The table decides speed alone, never a count. A null
text counts as empty: 0 bytes, 0 tokens. Very long texts are cut like others. Repeated rows each give
a row, an empty table none; only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE = 32_768
SUMMARY = 8_192
CACHE = 400_000
#: Longer pre-tokens stay out of table and cache, so both are bounded in bytes as well.
LONG = 40

_SPACES = re.compile(r" +[^ ]*")
_models: dict[str, object] = {}


def _model(path: str):
    if path not in _models:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        if any("▁" in m.id_to_piece(i).lstrip("▁") for i in range(m.get_piece_size())):
            raise ValueError(f"{path}: pieces cross spaces, so counts of pre-tokens do not add up")
        _models[path] = m
    return _models[path]


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens, each without its first space; "" is a single space at the end."""
    if not text:
        return []
    text = text.replace("▁", " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [m[1:] for m in _SPACES.findall(" " + text)]
    return text.split(" ")


def _lengths(model, keys: list[str]) -> list[int]:
    # the library adds the first space, but not to an empty string
    return [len(ids) or 1 for ids in model.encode(keys, num_threads=1)]


def frequent(docs: DataFrame, text_col: str, path: str, table: int = TABLE, summary: int = SUMMARY) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of the corpus: ``table`` entries at most."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                keys = pre_tokens(text)
                seen.update(keys if max(map(len, keys), default=0) <= LONG else [k for k in keys if len(k) <= LONG])
                if len(seen) > 16 * summary:  # Misra-Gries: take the same count off all, drop what is used up
                    off = sorted(seen.values(), reverse=True)[4 * summary]
                    seen = Counter({k: n - off for k, n in seen.items() if n > off})
        top = seen.most_common(summary)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["key", "n"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_lengths(_model(path), batch.column(0).to_pylist()), pa.int32())], names=["key", "tokens"])

    found = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(summarise, "key string, n long")
    top = found.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(table).select("key")
    return dict(map(tuple, top.mapInArrow(encode, "key string, tokens int").collect()))


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each document: id, n_bytes, n_tokens, over_limit."""
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, text_col, model_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, cache = _model(model_path), table.value, {}
        for batch in batches:
            totals, missed = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                keys = pre_tokens(text)
                lengths = list(map(known.get, keys))
                totals.append(sum(filter(None, lengths)))
                if None in lengths:
                    missed.append((i, [k for k, n in zip(keys, lengths) if n is None]))
            for i, keys in missed:
                lengths = list(map(cache.get, keys))
                totals[i] += sum(filter(None, lengths))
                if None in lengths:
                    new = Counter(k for k, n in zip(keys, lengths) if n is None)
                    for (k, times), n in zip(new.items(), _lengths(model, list(new))):
                        totals[i] += times * n
                        if len(k) <= LONG:
                            cache[k] = n
            if len(cache) > CACHE:
                cache.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(totals, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return rows.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
