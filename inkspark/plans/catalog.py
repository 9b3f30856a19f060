"""All queries of the library by name, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import audio_queries, job_queries, layout_queries, library_queries, reading_queries, server_queries, speech_queries, spoken_queries, stream_queries, text_queries  # noqa: F401
from .registry import GOLDEN, ORACLE_SQL, QUERIES

__all__ = ["GOLDEN", "ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["document_clips"](spark, sf_dir)
