"""Readers and writers round trips."""

import io
import zipfile

from pyspark.sql import functions as F

from inkspark.sources import readers, sinks


def test_text_files(spark, tmp_path):
    (tmp_path / "My notes.v2.txt").write_bytes("One.\n\nTwo é.".encode() + b"\xff")
    row = readers.read_text(spark, str(tmp_path)).first()
    assert (row.title, row.text) == ("My notes.v2", "One.\n\nTwo é.�")


def test_docx(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in ("First.", " ", "Second."))
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    assert readers.read_docx(spark, str(tmp_path / "*.docx")).first().text == "First.\n\nSecond."


def test_epub(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="u"><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        items = "".join(f'<item href="{n}.xhtml" media-type="application/xhtml+xml"/>' for n in "xyz") + '<item href="p.css" media-type="text/css"/>'
        z.writestr("o/c.opf", f'<package xmlns="v"><manifest>{items}</manifest></package>')
        for n, t in (("x", "<p>One <b>bold</b></p>"), ("y", "<p> </p>"), ("z", "<h1>Two</h1>")):
            z.writestr(f"o/{n}.xhtml", t)
    assert readers.read_epub(spark, str(tmp_path / "*.epub")).first().text == "One bold\n\nTwo"


def test_wav(spark, tmp_path):
    df = spark.createDataFrame([("a", [0.0, 0.5, -0.5, 2.0])], "name string, x array<double>")
    content = sinks.wav_files(df, "name", "x", 24000).first().content
    (tmp_path / "a.wav").write_bytes(content)
    import wave

    with wave.open(io.BytesIO(bytes(content))) as w:
        assert (w.getframerate(), w.getnframes(), w.getsampwidth()) == (24000, 4, 2)
    row = readers.read_wav_headers(spark, str(tmp_path / "*.wav")).first()
    assert (row.rate, row.data_bytes, row.seconds) == (24000, 8, 4 / 24000)


def test_library_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "t")], "id long, title string")
    sents = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "doc_id long, sent_id long, text string")
    sinks.write_library(docs, sents, str(tmp_path))
    assert [r.text for r in spark.read.parquet(f"{tmp_path}/sentences").orderBy("sent_id").collect()] == ["a", "b"]
    assert sinks.answers(docs, "id").first().answer == '{"id":1,"title":"t"}'


def test_dispatch_and_empty(spark):
    df = spark.createDataFrame([("a/B.PDF",), ("c.odt",)], "p string")
    assert [r.r for r in df.select(readers.reader_of(F.col("p")).alias("r")).collect()] == ["layout", None]
    assert readers.supported() == ".docx, .epub, .md, .pdf, .txt"
    texts = spark.createDataFrame([(1, " "), (2, "x")], "f int, text string")
    assert {r.f: r.has_text for r in readers.has_text(texts, "f").collect()} == {1: False, 2: True}


def test_many_files_of_one_folder(spark, tmp_path):
    """By a pattern the folder is listed once, without a job; by a table of paths each file is opened once, though named twice."""
    df = spark.range(50).select(F.concat("id", F.lit(".wav")).alias("name"), F.array(F.lit(0.5)).alias("x"))
    listed = sinks.publish(sinks.wav_files(df, "name", "x", 24000), str(tmp_path)).collect()
    listed = spark.createDataFrame(listed + listed[:5])
    spark.sparkContext.setJobGroup("listing", "listing of files")
    read = readers.read_wav_headers(spark, str(tmp_path / "*.wav"))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("listing")
    spark.sparkContext.setJobGroup("", "")
    assert not jobs
    rows = lambda df: sorted((r.path.rpartition("/")[2], r.rate, r.data_bytes) for r in df.collect())
    want = sorted((f"{i}.wav", 24000, 2) for i in range(50))
    assert rows(read) == rows(readers.read_wav_headers(spark, listed)) == want
    assert readers.contents(spark, listed.limit(0)).count() == 0
