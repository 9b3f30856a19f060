"""Writers: Parquet tables of a library, JSON answers, WAV files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.functions import audio

from .stored import GROUP, sorted_writer


def write_library(documents: DataFrame, sentences: DataFrame, path: str, group: int = GROUP) -> None:
    """Both tables. Sentences follow each other by (doc_id, sent_id) over files and row groups, with Bloom filters on doc_id, so a
    lookup or a range scan reads the row groups that have its rows; a document of very many sentences has several files. Files
    appear when a job commits, never in part."""
    documents.write.mode("overwrite").option("parquet.bloom.filter.enabled#id", "true").parquet(f"{path}/documents")
    sorted_writer(sentences, ["doc_id", "sent_id"], ["doc_id"], group).mode("overwrite").parquet(f"{path}/sentences")


def answers(rows: DataFrame, *key: str) -> DataFrame:
    """Rows as JSON objects, beside their key."""
    return rows.select(*key, F.to_json(F.struct("*")).alias("answer"))


def wav_files(samples: DataFrame, name: str, value: str, rate: int) -> DataFrame:
    """(name, content): arrays of samples as mono 16-bit WAV files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"name": b["name"], "content": [audio.wav_bytes(x, rate) for x in b["pcm"]]})

    rows = samples.select(F.col(name).cast("string").alias("name"), audio.pcm16(F.col(value)).alias("pcm"))
    return rows.mapInPandas(run, "name string, content binary")


def publish(files: DataFrame, folder: str) -> DataFrame:
    """Write files (name, content) to a shared folder, and list them (path, bytes). Each is written under a name of its own task
    and then renamed, so a reader sees whole files only, whatever task is lost or run twice."""
    root = folder if ":" in folder else f"file://{folder}"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, top = fs.FileSystem.from_uri(root)
        where.create_dir(top, recursive=True)
        for b in batches:
            for name, content in zip(b["name"], b["content"]):
                part = f"{top}/.{name}.{uuid.uuid4().hex}"
                with where.open_output_stream(part, compression=None) as out:
                    out.write(bytes(content))
                where.move(part, f"{top}/{name}")
            yield pd.DataFrame({"path": [f"{folder}/{n}" for n in b["name"]], "bytes": [len(c) for c in b["content"]]})

    return files.select("name", "content").mapInPandas(write, "path string, bytes long")
