"""The stored library, over orders (documents), lineitem (sentences) and events (updates)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.functions import text as T
from inkspark.operators import library as L
from inkspark.sources import readers, stored
from inkspark.sources.scratch import scratch

from .registry import golden, query, table


def _documents(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("created"), F.pmod("o_orderkey", F.lit(5)).alias("position"))


def _sentences(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("sent_id"), F.col("l_shipdate").alias("shipped"))


@query("""
    SELECT o_orderkey AS id, o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%d') AS created, count(l_linenumber) AS sentences,
           CASE WHEN count(l_linenumber) = 0 THEN 0 ELSE round(100.0 * (o_orderkey % 5) / count(l_linenumber))::BIGINT END AS progress
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderdate""")
def library_listing(spark: SparkSession, d: str) -> DataFrame:
    listed = L.listing(_documents(spark, d), _sentences(spark, d))
    return listed.select("id", "title", F.date_format("created", "yyyy-MM-dd").alias("created"), "sentences", "progress")


@query("""
    SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""")
def library_newest(spark, d):
    return L.newest_first(_documents(spark, d)).limit(50).select("id", F.date_format("created", "yyyy-MM-dd").alias("created"))


@query("SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS sent_id FROM lineitem WHERE l_orderkey = 7 AND l_linenumber >= 2 ORDER BY 2 LIMIT 16")
def sentence_range_scan(spark, d):
    return L.sentences_from(_sentences(spark, d), 7, 2).select("doc_id", "sent_id")


@query("""
    SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS sent_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS ord
    FROM lineitem WHERE l_linenumber >= 2 QUALIFY ord <= 3""")
def sentence_windows(spark, d):
    return L.windows_from(_sentences(spark, d), 2, 3).select("doc_id", "sent_id", F.col("ord").cast("long").alias("ord"))


@query("SELECT o_orderkey AS id, o_orderpriority AS title FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, d):
    return _documents(spark, d).where("id = 7").select("id", "title")


@query("""
    WITH changes AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS position FROM events WHERE event_type = 'view' GROUP BY 1),
         base AS (SELECT c_custkey AS user_id, 0::BIGINT AS position FROM customer)
    SELECT user_id, coalesce(changes.position, base.position) AS position FROM base FULL JOIN changes USING (user_id)""")
def latest_position_upsert(spark, d):
    e = table(spark, d, "events").where("event_type = 'view'").withColumn("position", F.col("event_id"))
    changes = L.latest(e, "user_id", "position", "ts", "event_id")
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(0).cast("long").alias("position"))
    return L.upsert(base, changes, "user_id")


@query("""
    SELECT 'documents' AS tab, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_orderstatus <> 'F'
    UNION ALL SELECT 'sentences', count(*), sum(l_orderkey)::BIGINT FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def delete_cascade(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    docs, sents = L.delete_cascade(_documents(spark, d), _sentences(spark, d), gone)
    left = docs.agg(F.lit("documents").alias("tab"), F.count(F.lit(1)).alias("n"), F.sum("id").alias("keys"))
    return left.unionByName(sents.agg(F.lit("sentences").alias("tab"), F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("keys")))


@query("""
    SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'seen' ELSE n_name END AS value FROM nation
    UNION ALL SELECT 100, 'new'""")
def kv_upsert(spark, d):
    base = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("value"))
    extra = spark.range(100, 101).select("id", F.lit("new").alias("value"))
    return L.upsert(base, base.where("id % 2 = 0").select("id", F.lit("seen").alias("value")).unionByName(extra), "id")


@query("""
    SELECT r_regionkey::BIGINT AS id, coalesce(r_name, '') AS title, 0::BIGINT AS position, 'body' AS kind, '[]' AS boxes FROM region""")
def schema_migration(spark, d):
    old = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("title"))
    return L.migrate(old, {"title": ("string", ""), "position": ("bigint", 0), "kind": ("string", "body"), "boxes": ("string", "[]")})


@query("""
    WITH base AS (SELECT c_custkey AS id, c_name AS title, 0::BIGINT AS position FROM customer),
    puts AS (SELECT user_id * 3 AS id, arg_max(CASE WHEN event_id % 3 > 0 THEN 'Note ' || event_id ELSE 'Pasted text' END, (ts, event_id)) AS title, arg_max(CASE WHEN event_id % 2 = 0 THEN event_id ELSE 0 END, (ts, event_id)) AS position FROM events GROUP BY 1)
    SELECT * FROM puts UNION ALL SELECT * FROM base WHERE id NOT IN (SELECT id FROM puts)""")
def put_with_defaults(spark, d):
    """Many puts for one key, of which the last counts; a put without a title or position gets the defaults."""
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit(0).cast("long").alias("position"))
    title, position = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("Note "), F.col("event_id"))), F.when(F.col("event_id") % 2 == 0, F.col("event_id"))
    rows = table(spark, d, "events").select((F.col("user_id") * 3).alias("id"), title.alias("title"), position.alias("position"), "ts", "event_id")
    return L.put(base, rows, "id", {"title": F.lit("Pasted text"), "position": F.lit(0).cast("long")}, "ts", "event_id")


@query("""
    SELECT doc_id, CASE WHEN regexp_matches(text, '\\S') THEN 200 ELSE 422 END AS status FROM documents
    UNION ALL SELECT * FROM (VALUES (-1::BIGINT, 422), (-2::BIGINT, 200))""")
def store_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, " \n\n "), (-2, "One.")], "doc_id long, text string"))
    return docs.select("doc_id", L.import_status(T.sentences(F.col("text"))).alias("status"))


@golden("""
    SELECT * FROM (VALUES (1::BIGINT, '[["He",0,2],["said",3,7],["\\"no\\"",8,12]]', 'He|said|"no"'), (2::BIGINT, '[]', ''))
    t(doc_id, words, decoded)""")
def stored_words(spark, d):
    rows = spark.createDataFrame([(1, 'He said "no"'), (2, "")], "doc_id long, text string")
    stored = L.encode_sentences(rows.select("doc_id", T.tokenize(F.col("text")).alias("words")))
    return stored.select("doc_id", "words", F.array_join(F.transform(L.decode_words(F.col("words")), lambda w: w.text), "|").alias("decoded"))


@query("""
    SELECT page_id, lower(regexp_extract(p, '(\\.[^./]+)$', 1)) AS suffix,
           CASE lower(regexp_extract(p, '(\\.[^./]+)$', 1)) WHEN '.pdf' THEN 'layout' WHEN '.docx' THEN 'docx' WHEN '.epub' THEN 'epub'
                WHEN '.txt' THEN 'text' WHEN '.md' THEN 'text' END AS reader
    FROM (SELECT page_id, 'in/file' || page_id || (['.PDF', '.docx', '.epub', '.txt', '.md', '.xyz', ''])[1 + page_id % 7] AS p FROM pages)""")
def format_dispatch(spark, d):
    ends = F.array(*map(F.lit, [".PDF", ".docx", ".epub", ".txt", ".md", ".xyz", ""]))
    paths = table(spark, d, "pages").select("page_id", F.concat(F.lit("in/file"), "page_id", F.get(ends, F.pmod("page_id", F.lit(7)).cast("int"))).alias("p"))
    return paths.select("page_id", T.suffix_of(F.col("p")).alias("suffix"), readers.reader_of(F.col("p")).alias("reader"))


@query("""
    SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\\s\\p{Z}\\x85\\x1c-\\x1f]+', ' ', 'g')) AS text FROM pages""")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query("""
    SELECT page_id, substr(coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\\s*>', 1), '\\s+', ' ', 'g')), ''), url), 1, 120) AS title,
           trim(regexp_replace(regexp_replace(regexp_replace(html,
             '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<nav\\b.*?</nav\\s*>|<header\\b.*?</header\\s*>|<footer\\b.*?</footer\\s*>|<head\\b.*?</head\\s*>', ' ', 'g'),
             '<[^>]+>', ' ', 'g'), '[\\s\\p{Z}\\x85\\x1c-\\x1f]+', ' ', 'g')) AS text FROM pages""")
def url_import(spark, d):
    return readers.from_pages(table(spark, d, "pages")).select("page_id", "title", "text")


@query()
def page_main_text(spark, d):
    """Web pages as documents with their main text, told by the density of text and links in blocks."""
    return readers.from_pages(table(spark, d, "pages"), main=True).select("page_id", "title", "text")


@golden("""
    SELECT * FROM (VALUES (1::BIGINT, 'Pasted text'), (2::BIGINT, 'Pasted text'), (3::BIGINT, 'My notes')) t(id, title)""")
def pasted_text(spark, d):
    rows = spark.createDataFrame([(1, None), (2, "  "), (3, "My notes")], "id long, title string")
    return rows.select("id", readers.pasted_title(F.col("title")).alias("title"))


@query("""
    SELECT source AS file, sum(length(text))::BIGINT AS chars, sum(length(text)) < 5000 AS scanned FROM documents GROUP BY 1""")
def scanned_files(spark, d):
    return readers.scanned(table(spark, d, "documents").withColumnRenamed("source", "file"), "file", 5000)


@golden("""
    SELECT * FROM (VALUES ('adam', 'adam', 'deep'), ('aria', 'aria', 'warm'), ('nobody', 'aria', 'warm')) t(asked, preset, label)""")
def preset_lookup(spark, d):
    asked = spark.createDataFrame([("adam",), ("aria",), ("nobody",)], "asked string")
    return readers.with_preset(asked, "asked").select("asked", "preset", F.regexp_extract("label", r"(\w+)$", 1).alias("label"))


@golden("""
    SELECT * FROM (VALUES (1::BIGINT, 'big'), (2::BIGINT, 'small'), (3::BIGINT, NULL), (4::BIGINT, 'small')) t(id, preference)""")
def stored_preference(spark, d):
    rows = spark.createDataFrame([(1, "big", "small"), (2, None, "small"), (3, "huge", None), (4, "huge", "small")], "id long, local string, shared string")
    return rows.select("id", readers.preference(F.col("local"), F.col("shared")).alias("preference"))


@query("""
    WITH keys AS (SELECT doc_id, substr(sha256('kokoro|aria|' || text), 1, 24) AS key FROM documents),
         cache AS (SELECT DISTINCT key FROM keys WHERE doc_id % 3 = 0)
    SELECT key, min(doc_id) AS doc_id, bool_or(key IN (SELECT key FROM cache)) AS hit FROM keys GROUP BY 1""")
def clip_cache(spark, d):
    from inkspark.functions.timing import content_key

    keys = table(spark, d, "documents").select("doc_id", content_key(F.lit("aria"), F.col("text")).alias("key"))
    cache = keys.where("doc_id % 3 = 0").select("key").distinct()
    jobs = keys.groupBy("key").agg(F.min("doc_id").alias("doc_id"))  # one request for each key
    missing = jobs.join(cache, "key", "left_anti").withColumn("hit", F.lit(False))
    return missing.unionByName(jobs.join(cache, "key", "left_semi").withColumn("hit", F.lit(True)))


@query("""
    SELECT conv_id AS doc_id, turn AS sent_id, turn || '+' || (turn % 3) AS key, turn AS back_sent, (turn % 3)::BIGINT AS back_word, turn % 2 = 1 AS shown,
           array_to_string((string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '))[(turn % 3) + 1:], ' ') AS rest
    FROM conversations WHERE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) > 3""")
def positions(spark, d):
    """Position keys there and back, the rest of a sentence from a word, and which documents can be shown as they were."""
    c = table(spark, d, "conversations").select("conv_id", "turn", T.collapse(F.col("text")).alias("text")).withColumn("words", T.tokenize(F.col("text"))).where(F.size("words") > 3)
    c = c.withColumn("word", F.col("turn") % 3).withColumn("key", L.position_key(F.col("turn"), F.col("word"))).withColumn("back", L.parse_position(F.col("key")))
    shown = L.has_pages(F.when(F.col("turn") % 2 == 1, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")), F.lit("file"))
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sent_id"), "key", F.col("back.sent_id").alias("back_sent"), F.col("back.word").alias("back_word"), shown.alias("shown"), L.text_after_word(F.col("text"), F.col("words"), F.col("word").cast("int")).alias("rest"))


@query("""
    SELECT conv_id AS doc_id, list_sort(list_distinct(list_concat(list(DISTINCT role), ['body'])))::VARCHAR[] AS kinds, count(DISTINCT role) AS n FROM conversations GROUP BY 1""")
def kinds_of_documents(spark, d):
    found = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.collect_set("role").alias("k"))
    return found.select("doc_id", F.array_sort(F.array_union("k", F.array(F.lit("body")))).alias("kinds"), F.size("k").cast("long").alias("n"))


@query("""
    SELECT event_id, event_type AS file, (props->>'k')::BIGINT AS loaded, NULL::BIGINT AS total FROM events""")
def plain_events(spark, d):
    from inkspark.operators.jobs import plain_event

    e = table(spark, d, "events").select("event_id", F.concat(F.lit('{"extra": 1, "file": "'), "event_type", F.lit('", "loaded": '), F.get_json_object("props", "$.k"), F.lit("}")).alias("payload"))
    return e.select("event_id", plain_event(F.col("payload")).alias("p")).select("event_id", "p.file", "p.loaded", "p.total")


@query("""
    WITH puts AS (SELECT l_orderkey AS doc_id, l_linenumber AS sent_id, max(l_quantity)::BIGINT + 100 AS size FROM lineitem WHERE l_orderkey % 97 = 0 AND l_linenumber <= 2 GROUP BY 1, 2
                  UNION ALL SELECT o_orderkey, 99, 1 FROM orders WHERE o_orderkey % 101 = 0),
    left_over AS (SELECT l_orderkey AS doc_id, l_linenumber AS sent_id, l_quantity::BIGINT AS size FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 89 = 0))
    SELECT doc_id, sent_id::BIGINT AS sent_id, size, 'now' AS of FROM (SELECT * FROM left_over ANTI JOIN puts USING (doc_id, sent_id) UNION ALL SELECT * FROM puts)
    UNION ALL SELECT l_orderkey, l_linenumber, l_quantity::BIGINT, 'before' FROM lineitem""")
def stored_changes(spark, d):
    """A stored table after a delete of documents and puts of sentences, and as it was before."""
    folder = scratch(spark)
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("sent_id"), F.col("l_quantity").cast("long").alias("size"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    stored.create(rows, folder, "doc_id", "sent_id")
    puts = rows.where("doc_id % 97 = 0 AND sent_id <= 2").withColumn("size", F.col("size") + 100)
    puts = puts.unionByName(orders.where("doc_id % 101 = 0").select("doc_id", F.lit(99).cast("long").alias("sent_id"), F.lit(1).cast("long").alias("size")))
    stored.change(spark, folder, puts, orders.where("doc_id % 89 = 0"))
    return stored.read(spark, folder).withColumn("of", F.lit("now")).unionByName(stored.read(spark, folder, 0).withColumn("of", F.lit("before")))


@query(r"""
    WITH w AS (SELECT conv_id, turn, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM (SELECT conv_id, turn, string_split(trim(regexp_replace(text, '[\s\p{Z}\x85\x1c-\x1f]+', ' ', 'g')), ' ') AS ws FROM conversations)),
    o AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS e FROM w)
    SELECT conv_id, turn, '[' || string_agg('[' || to_json(word)::VARCHAR || ',' || (e - length(word)) || ',' || e || ']', ',' ORDER BY i) || ']' AS words, string_agg(word, '|' ORDER BY i) AS decoded
    FROM o WHERE word <> '' GROUP BY 1, 2""")
def stored_turns(spark, d):
    """Words of turns as the JSON that is stored, and read back from it."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", T.tokenize(T.collapse(F.col("text"))).alias("words")).where(F.size("words") > 0)
    stored_rows = L.encode_sentences(rows)
    return stored_rows.select("conv_id", "turn", "words", F.array_join(F.transform(L.decode_words(F.col("words")), lambda w: w.text), "|").alias("decoded"))


@query("""
    WITH p(preset, speed) AS (VALUES ('adam', 95::BIGINT), ('aria', 93), ('emma', 93), ('george', 95), ('river', 91), ('sky', 100)),
    asked AS (SELECT c_custkey AS id, (['adam', 'aria', 'emma', 'george', 'river', 'sky', 'nobody', NULL])[(c_custkey % 8 + 1)::INT] AS asked FROM customer)
    SELECT id, asked, p.preset, speed AS speed_percent FROM asked JOIN p ON p.preset = CASE WHEN asked IN (SELECT preset FROM p) THEN asked ELSE 'aria' END""")
def customers_presets(spark, d):
    """The voice that each customer asks for, and the usual one for a name that is none."""
    names = F.array(*[F.lit(n).cast("string") for n in ("adam", "aria", "emma", "george", "river", "sky", "nobody", None)])
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.get(names, (F.col("c_custkey") % 8).cast("int")).alias("asked"))
    return readers.with_preset(asked, "asked").select("id", "asked", "preset", F.round(F.col("base_speed") * 100).cast("long").alias("speed_percent"))
