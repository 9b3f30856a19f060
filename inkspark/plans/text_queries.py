"""Sentences, chunks and words of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.functions import text as T

from .registry import query, table

_WS = r"[\s\p{Z}\x85\x1c-\x1f]"
#: DuckDB: (doc_id, ord, block) of documents and of literal rows with blank lines.
_BLOCKS = f"""
    texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES
        (-1::BIGINT, 'One two.' || chr(10) || ' ' || chr(10) || 'Three  four' || chr(10) || 'five.' || chr(10) || chr(10) || '   '), (-2::BIGINT, ''),
        (-3::BIGINT, 'He said "Hi." Then left. (See p. 4.) 5 more! no split. Étage. A.B. C?'))),
    parts AS (SELECT doc_id, unnest(string_split_regex(text, '\\n{_WS}*\\n')) AS raw, generate_subscripts(string_split_regex(text, '\\n{_WS}*\\n'), 1) AS ord FROM texts),
    blocks AS (SELECT doc_id, ord, trim(regexp_replace(raw, '{_WS}+', ' ', 'g')) AS block FROM parts WHERE trim(regexp_replace(raw, '{_WS}+', ' ', 'g')) <> '')"""
_SENTENCES = _BLOCKS + r""",
    cut AS (SELECT doc_id, ord, string_split(regexp_replace(block, '([.!?])["'')\]]*\s+(["''(\[]?[A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ss FROM blocks),
    flat AS (SELECT doc_id, ord, generate_subscripts(ss, 1) AS k, trim(unnest(ss)) AS s FROM cut),
    sentences AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord, k) - 1 AS sent_id, s AS text FROM flat WHERE s <> '')"""


#: DuckDB: (doc_id, chunks) of each text.
CHUNKS = rf"""{_SENTENCES},
    pieces AS (SELECT doc_id, sent_id, text, CASE WHEN length(text) <= 480 THEN [text] ELSE CASE WHEN f.cur = '' THEN f.parts ELSE list_append(f.parts, f.cur) END END AS ps FROM (
        SELECT doc_id, sent_id, text, list_reduce(list_transform(string_split_regex(text, '[,;:—–]\s+'), lambda p: {{'cur': p, 'parts': []::VARCHAR[]}}),
            lambda a, x: CASE WHEN length(CASE WHEN a.cur = '' THEN x.cur ELSE trim(a.cur || ', ' || x.cur, ', ') END) > 480 AND a.cur <> ''
                THEN {{'cur': x.cur, 'parts': list_append(a.parts, a.cur)}}
                ELSE {{'cur': CASE WHEN a.cur = '' THEN x.cur ELSE trim(a.cur || ', ' || x.cur, ', ') END, 'parts': a.parts}} END) AS f FROM sentences)),
    numbered AS (SELECT doc_id, sent_id, generate_subscripts(ps, 1) AS k, unnest(ps) AS rest FROM pieces),
    hard(doc_id, sent_id, k, step, rest, got) AS (
        SELECT doc_id, sent_id, k, 0, rest, NULL::VARCHAR FROM numbered
        UNION ALL
        SELECT doc_id, sent_id, k, step + 1,
               CASE WHEN length(rest) > 480 THEN trim(substr(rest, 1 + CASE WHEN instr(reverse(substr(rest, 1, 480)), ' ') IN (0, 480) THEN 480 ELSE 480 - instr(reverse(substr(rest, 1, 480)), ' ') END)) END,
               CASE WHEN length(rest) > 480 THEN substr(rest, 1, CASE WHEN instr(reverse(substr(rest, 1, 480)), ' ') IN (0, 480) THEN 480 ELSE 480 - instr(reverse(substr(rest, 1, 480)), ' ') END) ELSE rest END
        FROM hard WHERE rest IS NOT NULL),
    cutup AS (SELECT doc_id, sent_id, k, step, got FROM hard WHERE got IS NOT NULL AND got <> ''),
    items AS (SELECT doc_id, list({{'done': []::VARCHAR[], 'cur': got}} ORDER BY sent_id, k, step) AS l FROM cutup GROUP BY 1),
    folded AS (SELECT doc_id, list_reduce(l, lambda a, x: CASE WHEN (length(x.cur) < 40 OR length(a.cur) < 40) AND length(a.cur) + 1 + length(x.cur) <= 480
        THEN {{'done': a.done, 'cur': a.cur || ' ' || x.cur}} ELSE {{'done': list_append(a.done, a.cur), 'cur': x.cur}} END) AS f FROM items),
    merged AS (SELECT doc_id, list_append(f.done, f.cur) AS chunks FROM folded)"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    own = [(-1, "One two.\n \nThree  four\nfive.\n\n   "), (-2, ""), (-3, 'He said "Hi." Then left. (See p. 4.) 5 more! no split. Étage. A.B. C?')]
    return table(spark, d, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(own, "doc_id long, text string"))


@query(f"WITH {_BLOCKS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS ord, block FROM blocks")
def whitespace_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", F.posexplode(T.blocks(F.col("text"))).alias("ord", "block")).withColumn("ord", F.col("ord").cast("long"))


@query(f"WITH {_SENTENCES} SELECT * FROM sentences")
def sentences(spark, d):
    return _texts(spark, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_id", "text")).withColumn("sent_id", F.col("sent_id").cast("long"))


@query(f"""
    WITH {_SENTENCES},
    items AS (SELECT doc_id, list({{'done': []::VARCHAR[], 'cur': text}} ORDER BY sent_id) AS l FROM sentences GROUP BY 1),
    folded AS (SELECT doc_id, list_reduce(l, lambda a, x: CASE WHEN (length(x.cur) < 40 OR length(a.cur) < 40) AND length(a.cur) + 1 + length(x.cur) <= 480
        THEN {{'done': a.done, 'cur': a.cur || ' ' || x.cur}} ELSE {{'done': list_append(a.done, a.cur), 'cur': x.cur}} END) AS f FROM items),
    merged AS (SELECT doc_id, list_append(f.done, f.cur) AS chunks FROM folded)
    SELECT doc_id, generate_subscripts(chunks, 1) - 1 AS chunk_id, unnest(chunks) AS text FROM merged""")
def merged_sentences(spark, d):
    """Sentences as they are, joined where short."""
    merged = T.merge_short(T.sentences(F.col("text")))
    return _texts(spark, d).select("doc_id", F.posexplode(merged).alias("chunk_id", "text")).withColumn("chunk_id", F.col("chunk_id").cast("long"))


@query(f"WITH RECURSIVE {CHUNKS} SELECT doc_id, generate_subscripts(chunks, 1) - 1 AS chunk_id, unnest(chunks) AS text FROM merged")
def chunks(spark, d):
    return _texts(spark, d).select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk_id", "text")).withColumn("chunk_id", F.col("chunk_id").cast("long"))


@query(f"""
    WITH {_SENTENCES},
    w AS (SELECT doc_id, sent_id, generate_subscripts(string_split(text, ' '), 1) - 1 AS ord, unnest(string_split(text, ' ')) AS word FROM sentences),
    o AS (SELECT *, (coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, sent_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS b FROM w)
    SELECT doc_id, sent_id, ord, word, b AS start, b + length(word) AS "end" FROM o""")
def words_with_offsets(spark, d):
    sents = _texts(spark, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_id", "text"))
    rows = sents.select("doc_id", F.col("sent_id").cast("long").alias("sent_id"), F.posexplode(T.tokenize(F.col("text"))).alias("ord", "w"))
    return rows.select("doc_id", "sent_id", F.col("ord").cast("long").alias("ord"), F.col("w.text").alias("word"), F.col("w.start").cast("long").alias("start"), F.col("w.end").cast("long").alias("end"))


@query(rf"""
    SELECT doc_id, len(regexp_extract_all(text, '[^\s\p{{Z}}\x85\x1c-\x1f]+'))::BIGINT AS words FROM documents""")
def document_roundtrip(spark, d):
    """Words of all chunks of a document. Only punctuation at clause ends may differ from the source, never a count of words."""
    joined = T.words(F.array_join(T.chunks(F.col("text")), " "))
    return table(spark, d, "documents").select("doc_id", F.size(joined).cast("long").alias("words"))


@query(rf"""
    SELECT doc_id, CASE WHEN regexp_matches(trim(l), '^\d{{1,4}}$') OR (length(trim(l)) BETWEEN 2 AND 47 AND trim(l) = upper(trim(l)) AND regexp_matches(l, '[A-Z]'))
                        THEN 'header' ELSE 'body' END AS kind, count(*) AS n
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY 1, 2""")
def plain_kinds(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return lines.groupBy("doc_id", T.plain_kind(F.col("l")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT page_id, regexp_replace(regexp_replace(url, '^.*/', ''), '(.)\\.[^.]+$', '\\1') AS title,
           page_id || CASE WHEN page_id = 1 THEN ' passage' ELSE ' passages' END AS label, (page_id * 37) // 60 || ':' || lpad(((page_id * 37) % 60)::VARCHAR, 2, '0') AS clock FROM pages""")
def labels_and_titles(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", T.title_of(F.col("url")).alias("title"), T.counted(F.col("page_id"), "passage").alias("label"), T.clock(F.col("page_id") * 37).alias("clock"))


@query(r"""
    WITH src AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations WHERE regexp_matches(text, '\S')),
    w AS (SELECT conv_id, turn, text, generate_subscripts(string_split(text, ' '), 1) AS i1, unnest(string_split(text, ' ')) AS word, len(string_split(text, ' ')) AS n FROM src),
    o AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY conv_id, turn ORDER BY i1) - 1 AS e FROM w),
    f AS (SELECT conv_id, turn, any_value(length(text)) AS len, any_value(n) AS n, greatest(count(*) FILTER (e <= 90), least(5, any_value(n))) AS fits FROM o GROUP BY 1, 2),
    c AS (SELECT o.conv_id, o.turn, max(i1) AS clause FROM o JOIN f USING (conv_id, turn) WHERE i1 >= 5 AND i1 <= fits AND regexp_matches(word, '[,;:—–]["'')\]]?$') GROUP BY 1, 2)
    SELECT f.conv_id, f.turn, (CASE WHEN len <= 90 THEN n WHEN n - coalesce(clause, fits) >= 5 THEN coalesce(clause, fits) ELSE least(n, greatest(5, n - 5)) END)::BIGINT AS cut
    FROM f LEFT JOIN c USING (conv_id, turn)""")
def clause_cut(spark, d):
    """Where to stop in each turn of a conversation to stay within 90 characters."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", T.collapse(F.col("text")).alias("text")).where("text <> ''").withColumn("words", T.tokenize(F.col("text")))
    return turns.select("conv_id", "turn", T.cut_at(F.col("words"), F.length("text"), F.lit(0), F.lit(90)).cast("long").alias("cut"))
