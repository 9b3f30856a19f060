"""What a library's server takes in, answers and leaves on disk."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspark.functions import text as T
from inkspark.operators import library as L
from inkspark.operators import navigation as N
from inkspark.sources import readers, sinks
from inkspark.sources.scratch import kept, scratch

from .library_queries import _documents, _sentences
from .registry import golden, query, table


@query(r"""
    WITH up AS (SELECT doc_id, ([doc_id || '.pdf', doc_id || '.TXT', doc_id || '.odt', 'folder.x/' || doc_id])[(doc_id % 4 + 1)::INT] AS path, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE text END AS text FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 4 > 1 THEN 415 WHEN doc_id % 4 = 0 AND length(text) < 40 THEN 422 WHEN NOT regexp_matches(text, '\S') THEN 422 ELSE 200 END AS status,
           CASE WHEN doc_id % 4 > 1 THEN 'unknown format ' || CASE doc_id % 4 WHEN 2 THEN '.odt' ELSE '(none)' END || ', known: .docx, .epub, .md, .pdf, .txt' WHEN doc_id % 4 = 0 AND length(text) < 40 THEN 'a scan without text'
                WHEN NOT regexp_matches(text, '\S') THEN 'no readable text' ELSE 'stored' END AS why,
           CASE doc_id % 4 WHEN 0 THEN 'layout' WHEN 2 THEN NULL ELSE 'text' END AS browser_reader FROM up""")
def upload_outcomes(spark, d):
    """Documents as uploads of four suffixes, some of them blank."""
    key = F.col("doc_id")
    paths = F.array(F.concat(key, F.lit(".pdf")), F.concat(key, F.lit(".TXT")), F.concat(key, F.lit(".odt")), F.concat(F.lit("folder.x/"), key))
    up = table(spark, d, "documents").select(key, F.get(paths, (key % 4).cast("int")).alias("path"), F.when(key % 9 == 0, F.lit(" ")).otherwise(F.col("text")).alias("text"))
    up = up.withColumn("r", readers.upload_outcome(F.col("path"), F.length("text") < 40, F.size(T.sentences(F.col("text")))))
    return up.select("doc_id", "r.status", "r.why", readers.browser_reader_of(F.col("path")).alias("browser_reader"))


@query("SELECT event_id, user_id AS asked, CASE WHEN user_id * 7 IN (SELECT o_orderkey FROM orders) THEN 200 ELSE 404 END AS status FROM events")
def missing_documents(spark, d):
    asked = table(spark, d, "events").select("event_id", F.col("user_id").alias("asked"), (F.col("user_id") * 7).alias("id"))
    return L.found_status(asked, table(spark, d, "orders").withColumnRenamed("o_orderkey", "id"), "id").select("event_id", "asked", "status")


@query("""
    WITH docs AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '.pdf' END AS ext FROM orders), gone AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F')
    SELECT id, id || ext AS path FROM docs WHERE ext IS NOT NULL AND id IN (SELECT id FROM gone)
    UNION ALL SELECT l_orderkey, 'pages/' || l_orderkey || '-' || l_linenumber || '@2.png' FROM lineitem WHERE l_orderkey IN (SELECT id FROM gone)""")
def files_of_deleted(spark, d):
    """What a delete leaves on disk: originals and page pictures of the documents that go."""
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, ".pdf").alias("source_ext"), "o_orderstatus")
    cached = table(spark, d, "lineitem").select(F.concat(F.lit("pages/"), "l_orderkey", F.lit("-"), "l_linenumber", F.lit("@2.png")).alias("path"))
    return L.files_to_remove(docs, cached, docs.where("o_orderstatus = 'F'").select("id"))


@query("""
    SELECT o_orderkey AS id, '{"id":' || o_orderkey || ',"title":"' || any_value(o_orderpriority) || '","position":' || o_orderkey % 5 || ',"created":"' || strftime(any_value(o_orderdate), '%Y-%m-%d') || '","total":' || count(l_linenumber) || '}' AS answer
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def list_answers(spark, d):
    listed = L.listing(_documents(spark, d).withColumn("created", F.date_format("created", "yyyy-MM-dd")), _sentences(spark, d))
    return L.list_answers(listed)


@query(r"""
    WITH s AS (SELECT conv_id, turn, translate(text, '\"', '') AS text, role FROM conversations WHERE NOT regexp_matches(text, '[\x00-\x1f]'))
    SELECT conv_id AS id, '{"id":' || conv_id || ',"title":null,"position":' || conv_id % 3 || ',"pages":[],"sentences":[' || string_agg('{"id":' || turn || ',"text":"' || text || '","words":[0,1],"kind":"' || role || '","boxes":[]}', ',' ORDER BY turn, text) || ']}' AS answer
    FROM s GROUP BY 1""")
def document_answers(spark, d):
    """Documents with their sentences as one object each."""
    c = table(spark, d, "conversations").where(~F.col("text").rlike(r"[\x00-\x1f]")).withColumn("text", F.translate("text", '\\"', ""))
    none = F.array().cast("array<int>")
    sents = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sent_id"), "text", F.array(F.lit(0), F.lit(1)).alias("words"), F.col("role").alias("kind"), none.alias("boxes"))
    docs = c.select(F.col("conv_id").alias("id")).distinct().select("id", F.lit(None).cast("string").alias("title"), (F.col("id") % 3).alias("position"), none.alias("pages"))
    return L.document_answers(docs, sents)


@query("""
    SELECT o_orderkey AS id, '{"audio":"/api/audio/c' || o_orderkey || '.wav","duration":' || o_orderkey % 60 || ',"timings":[0,' || o_orderkey % 60 || '],"parts":[' || string_agg('{"id":' || l_linenumber || ',"words":' || l_quantity::BIGINT || '}', ',' ORDER BY l_linenumber, l_quantity) || ']}' AS answer
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def chunk_answers(spark, d):
    part = F.struct(F.col("l_linenumber").cast("long").alias("id"), F.col("l_quantity").cast("long").alias("words"))
    packs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    packs = packs.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", "left_semi")
    packs = packs.withColumn("name", F.concat(F.lit("c"), "id", F.lit(".wav"))).withColumn("duration", F.col("id") % 60).withColumn("timings", F.array(F.lit(0).cast("long"), F.col("id") % 60))
    return L.chunk_answers(packs, "id")


@golden("""
    SELECT preset, '{"id":"' || preset || '","label":"' || label || '"}' AS answer
    FROM (VALUES ('aria', 'Aria · warm'), ('river', 'River · calm'), ('sky', 'Sky · bright'), ('emma', 'Emma · storyteller'), ('george', 'George · rich'), ('adam', 'Adam · deep')) t(preset, label)""")
def voice_answers(spark, d):
    return L.voice_answers(readers.presets(spark))


@query("""
    SELECT c_custkey AS id, ['1x', '1.25x', '1.5x', '2x', '0.75x'][(c_custkey % 5 + 1)::INT] AS speed, CASE WHEN c_custkey % 3 = 0 THEN 'Pasted text' ELSE c_name END AS title, CASE c_custkey % 4 WHEN 0 THEN 'big' WHEN 1 THEN 'small' END AS preference FROM customer""")
def labels_of_settings(spark, d):
    """Speed labels, titles of pasted texts, and the stored choice of a model."""
    key = F.col("c_custkey")
    speed = F.get(F.array(*map(F.lit, [1.0, 1.25, 1.5, 2.0, 0.75])), (key % 5).cast("int"))
    title = readers.pasted_title(F.when(key % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "c_name")))
    local, shared = F.when(key % 4 == 0, "big").when(key % 4 == 1, "huge").when(key % 4 == 2, "huge"), F.when(key % 4 == 1, "small")
    return table(spark, d, "customer").select(key.alias("id"), T.speed_label(speed).alias("speed"), title.alias("title"), readers.preference(local, shared).alias("preference"))


@query("SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, turn AS sent_id FROM conversations WHERE role <> 'system'")
def readable_ids(spark, d):
    kind = F.when(F.col("role") == "system", "header").otherwise("body")
    return N.readable_ids(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sent_id"), kind.alias("kind")))


@query("SELECT conv_id AS doc_id, string_agg(text, ' ' ORDER BY turn, text) AS text FROM conversations GROUP BY 1")
def full_texts(spark, d):
    return N.full_text(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sent_id"), "text"))


@query("SELECT page_id, 'My notes+' || page_id || '.v2' AS title, 'Text of page ' || page_id || '.' AS text FROM pages")
def text_files(spark, d):
    """Text files written to the shared folder and read back: names with spaces, pluses and dots keep them in the title."""
    rows = table(spark, d, "pages").select(F.concat(F.lit("My notes+"), "page_id", F.lit(".v2.txt")).alias("name"), F.encode(F.concat(F.lit("Text of page "), "page_id", F.lit(".")), "UTF-8").alias("content"))
    folder = scratch(spark)
    sinks.publish(rows, folder).write.format("noop").mode("overwrite").save()
    return readers.read_text(spark, folder).select(F.regexp_extract("title", r"(\d+)\.v2$", 1).cast("long").alias("page_id"), "title", "text")


@query("SELECT o_orderkey AS id, o_orderpriority AS title, l_linenumber::BIGINT AS sent_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber >= 3")
def stored_library(spark, d):
    """Both tables of a library written, sentences sorted by document, and a range read back."""
    folder = scratch(spark)
    sinks.write_library(_documents(spark, d).select("id", "title"), _sentences(spark, d).select("doc_id", "sent_id"), folder)
    sents = spark.read.parquet(f"{folder}/sentences").where("sent_id >= 3")
    return spark.read.parquet(f"{folder}/documents").join(sents.withColumnRenamed("doc_id", "id"), "id")


@query(r"""
    SELECT page_id, 'b' || page_id AS title, 'Chapter one of ' || page_id || CASE WHEN page_id % 3 = 0 THEN '' ELSE chr(10) || chr(10) || 'Two & more' END AS epub,
           'First.' || chr(10) || chr(10) || 'Page ' || page_id || '.' AS docx FROM pages""")
def container_files(spark, d):
    """E-books and Word files made of pages, written to the shared folder and read back."""
    pages = readers.spread(table(spark, d, "pages").select("page_id"))
    listed = kept(sinks.publish(_containers(pages), scratch(spark)))
    books, notes = readers.read_epub(spark, listed.where("path LIKE '%.epub'")), readers.read_docx(spark, listed.where("path LIKE '%.docx'"))
    named = lambda df, text: df.select(F.regexp_extract("title", r"\d+$", 0).cast("long").alias("page_id"), "title", F.col("text").alias(text))
    return named(books, "epub").join(named(notes, "docx").drop("title"), "page_id")


def _containers(pages):
    """(name, content): for each page a small e-book and a small Word file."""
    import io
    import zipfile

    import pandas as pd

    def packed(parts: dict[str, str]) -> bytes:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for name, text in parts.items():
                z.writestr(name, text)
        return data.getvalue()

    def make(batches):
        for b in batches:
            for i in b["page_id"]:
                second = "<p> </p>" if i % 3 == 0 else "<h2>Two &amp; more</h2>".replace("&amp;", "&")
                items = "".join(f'<item href="{n}.xhtml" media-type="application/xhtml+xml"/>' for n in "xy")
                epub = {
                    "META-INF/container.xml": '<container xmlns="u"><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>',
                    "o/c.opf": f'<package xmlns="v"><manifest>{items}</manifest></package>', "o/x.xhtml": f"<p>Chapter <b>one</b> of {i}</p>", "o/y.xhtml": second,
                }
                w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
                body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in ("First.", " ", f"Page {i}."))
                docx = {"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>'}
                yield pd.DataFrame({"name": [f"b{i}.epub", f"b{i}.docx"], "content": [packed(epub), packed(docx)]})

    return pages.mapInPandas(make, "name string, content binary")
