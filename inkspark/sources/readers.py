"""Readers of documents: text, Word, e-books, pages, glyph tables, audio headers.

Each gives rows of a document with its title and text; containers are decoded inside tasks, file by file.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.functions import audio
from inkspark.functions import text as T

READERS = {".pdf": "layout", ".docx": "docx", ".epub": "epub", ".txt": "text", ".md": "text"}
# Voices as blends of style vectors.
PRESETS = (
    ("aria", "Aria · warm", {"af_heart": 0.6, "af_bella": 0.4}, 0.93),
    ("river", "River · calm", {"af_heart": 0.5, "af_nicole": 0.5}, 0.91),
    ("sky", "Sky · bright", {"af_sky": 1.0}, 1.00),
    ("emma", "Emma · storyteller", {"bf_emma": 1.0}, 0.93),
    ("george", "George · rich", {"bm_george": 1.0}, 0.95),
    ("adam", "Adam · deep", {"am_liam": 0.7, "am_michael": 0.3}, 0.95),
)
DEFAULT_PRESET = "aria"


def reader_of(path: Column) -> Column:
    """Which reader takes a file, by its lower-cased suffix; null for unknown ones."""
    found = F.lit(None).cast("string")
    for suffix, reader in READERS.items():
        found = F.when(T.suffix_of(path) == suffix, F.lit(reader)).otherwise(found)
    return found


def browser_reader_of(path: Column) -> Column:
    """Which reader takes a file where only PDF, plain text and files without a suffix are taken; null for others."""
    suffix = T.suffix_of(path)
    return F.when(suffix == ".pdf", "layout").when(suffix.isin(".txt", ".md", ""), "text")


def supported() -> str:
    return ", ".join(sorted(READERS))


def upload_outcome(path: Column, scanned: Column, sentences: Column) -> Column:
    """Struct of status and why: 415 for a file that no reader takes, 422 for a scan and for a text without a sentence, else 200."""
    suffix = T.suffix_of(path)
    unknown = F.concat(F.lit("unknown format "), F.coalesce(F.nullif(suffix, F.lit("")), F.lit("(none)")), F.lit(f", known: {supported()}"))
    said = lambda status, why: F.struct(F.lit(status).alias("status"), why.alias("why"))
    return (
        F.when(reader_of(path).isNull(), said(415, unknown))
        .when((suffix == ".pdf") & scanned, said(422, F.lit("a scan without text")))
        .when(sentences == 0, said(422, F.lit("no readable text")))
        .otherwise(said(200, F.lit("stored")))
    )


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row for each text or Markdown file: path, title, text. Bytes that are not UTF-8 become U+FFFD."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    # the path is a URI: %20 is a space, but a plus is a plus
    name = F.url_decode(F.replace(F.regexp_replace("path", "^.*/", ""), F.lit("+"), F.lit("%2B")))
    return files.select("path", T.title_of(name).alias("title"), "text")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx_text(data: bytes) -> str:
    """Non-blank paragraphs of the body, joined by blank lines."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    marks = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n"}
    paragraphs = ("".join(marks[e.tag](e) for e in p.iter() if e.tag in marks) for p in body.findall(f"{_W}p"))
    return "\n\n".join(p for p in paragraphs if p.strip())


def _epub_pages(data: bytes) -> list[str]:
    """The book's XHTML items in the order of its manifest, undecodable bytes left out."""
    book = zipfile.ZipFile(io.BytesIO(data))
    root = ElementTree.fromstring(book.read("META-INF/container.xml")).find(".//{*}rootfile").get("full-path")
    folder = root.rpartition("/")[0]
    items = ElementTree.fromstring(book.read(root)).findall(".//{*}manifest/{*}item")
    names = [i.get("href") for i in items if i.get("media-type") == "application/xhtml+xml"]
    return [book.read(f"{folder}/{n}" if folder else n).decode("utf-8", "ignore") for n in names]


#: Bytes of files that a task of contents() holds before it gives them on.
HELD = 1 << 24


def contents(spark: SparkSession, files: str | DataFrame) -> DataFrame:
    """(path, content) of each file of a path or pattern, or of a table with the column path, which may name a file twice. A pattern
    for names of one folder is one listing of the folder. Files of a table are opened in the tasks that have its rows: the driver
    has no list of them, however many."""
    if isinstance(files, DataFrame):

        def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known: dict[str, tuple[fs.FileSystem, str]] = {}
            for b in batches:
                paths, data, held = [], [], 0
                for path in b["path"]:
                    folder, _, name = path.rpartition("/")
                    if folder not in known:
                        known[folder] = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
                    where, top = known[folder]
                    with where.open_input_stream(f"{top}/{name}", compression=None) as f:
                        data.append(f.read())
                    paths.append(path)
                    held += len(data[-1])
                    if held >= HELD:
                        yield pd.DataFrame({"path": paths, "content": data})
                        paths, data, held = [], [], 0
                yield pd.DataFrame({"path": paths, "content": data})

        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        return files.select("path").repartition(parts, "path").distinct().mapInPandas(opened, "path string, content binary")
    folder, _, name = files.rpartition("/")
    pattern = re.compile(r"[*?\[{]")
    if folder and pattern.search(name) and not pattern.search(folder):
        return spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder).select("path", "content")
    return spark.read.format("binaryFile").load(files).select("path", "content")


def _decoded(spark: SparkSession, files: str | DataFrame, decode, kind: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "made": [decode(bytes(x)) for x in b["content"]]})

    return contents(spark, files).mapInPandas(run, f"path string, made {kind}")


def read_docx(spark: SparkSession, files: str | DataFrame) -> DataFrame:
    rows = _decoded(spark, files, _docx_text, "string")
    return rows.select("path", T.title_of(F.col("path")).alias("title"), F.col("made").alias("text"))


def read_epub(spark: SparkSession, files: str | DataFrame) -> DataFrame:
    """Tags of each item become spaces; empty items go; the others are joined by blank lines."""
    rows = _decoded(spark, files, _epub_pages, "array<string>")
    items = F.filter(F.transform("made", T.strip_tags), lambda t: t != "")
    return rows.select("path", T.title_of(F.col("path")).alias("title"), F.array_join(items, "\n\n").alias("text"))


def read_wav_headers(spark: SparkSession, files: str | DataFrame) -> DataFrame:
    """path, rate, channels, bits, data_bytes, seconds of each WAV file."""
    return contents(spark, files).select("path", audio.wav_header(F.col("content")).alias("h")).select("path", "h.*")


def pasted_title(title: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit("Pasted text"))


def page_title(html: Column) -> Column:
    """What a page calls itself: its og:title, else its title element, white space collapsed; null where it has neither."""
    named = F.regexp_extract(html, r"""(?is)<meta\s[^>]*property\s*=\s*["']og:title["'][^>]*content\s*=\s*["']([^"']*)["']""", 1)
    titled = T.collapse(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1))
    return F.coalesce(F.nullif(T.collapse(named), F.lit("")), F.nullif(titled, F.lit("")))


def from_pages(pages: DataFrame, main: bool = False) -> DataFrame:
    """Web pages as documents: the page's own title, else its URL, cut to 120 characters. The text is all that is not tagged as
    navigation, head or foot, or with ``main`` the main text, told by the page's blocks."""
    title = F.substring(F.coalesce(page_title(F.col("html")), F.col("url")), 1, 120)
    return pages.withColumn("title", title).withColumn("text", (T.main_text if main else T.article_text)(F.col("html")))


def scanned(texts: DataFrame, key: str, least: int = 40) -> DataFrame:
    """Characters of each file, and whether they are so few that it must be a scan."""
    return texts.groupBy(key).agg(F.sum(F.length("text")).alias("chars")).withColumn("scanned", F.col("chars") < least)


def has_text(texts: DataFrame, key: str) -> DataFrame:
    return texts.groupBy(key).agg(F.bool_or(F.trim("text") != "").alias("has_text"))


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRESETS), "preset string, label string, blend map<string,double>, base_speed double")


def with_preset(rows: DataFrame, asked: str) -> DataFrame:
    """``rows`` with the preset asked for, or the default one where there is none of that name. The six presets are broadcast."""
    names = F.array(*[F.lit(p[0]) for p in PRESETS])
    wanted = rows.withColumn("preset", F.when(F.array_contains(names, F.col(asked)), F.col(asked)).otherwise(DEFAULT_PRESET))
    return wanted.join(F.broadcast(presets(rows.sparkSession)), "preset")


def preference(*stores: Column) -> Column:
    """The first store with a valid choice."""
    return F.coalesce(*[F.when(s.isin("big", "small"), s) for s in stores])


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table of few row groups dealt over the cores, for work that is heavy for each row. A table with a part for each
    core, as any large one has, stays as it is: it is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
