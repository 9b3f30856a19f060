"""Spoken forms: literal cases with their expected results, and whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspark.functions import speech, timing

from .registry import golden, query, table

#: step: (input, expected)
CASES = {
    "states_after_comma": [("Lexington, Ky.—we met", "Lexington, Kentucky—we met"), ("Portland, ME 04101", "Portland, Maine 04101"), ("Austin, TX", "Austin, Texas"), ("well, In 1978", "well, In 1978"), ("tell, me,", "tell, Maine,")],
    "states_in_parentheses": [("Boston (MA) and (zz)", "Boston (Massachusetts) and (zz)"), ("(tx)", "(Texas)")],
    "dotted_places": [("the U.S.A. and U.S. and U.K.", "the United States and United States and United Kingdom"), ("Ph.D. in D.C.", "PhD in District of Columbia")],
    "dotted_acronyms": [("an M.B.A. degree", "an MBA degree"), ("a B.A. degree", "a B.A. degree"), ("J.R.R.T wrote", "JRRT wrote")],
    "money": [("$1.3 billion", "1.3 billion dollars"), ("$1", "1 dollar"), ("$ 1,200.50 now", "1,200.50 dollars now"), ("$1.00", "1.00 dollar"), ("a $12 Billion offer", "a 12 billion dollars offer")],
    "year_ranges": [("1978-1982", "nineteen seventy eight to nineteen eighty two"), ("in 2001 – 2010", "in two thousand one to twenty ten")],
    "decades": [("the 1970s", "the nineteen seventies"), ("1910's", "nineteen tens"), ("2000s and 1900s", "two thousands and nineteen hundreds"), ("2010s", "twenty tens")],
    "years": [("in 1978.", "in nineteen seventy eight."), ("1,500 and 1500", "1,500 and fifteen hundred"), ("2005 to 1905", "two thousand five to nineteen oh five"), ("x1999 $1978 1978.5", "xnineteen ninety nine $1978 1978.5"), ("2000", "two thousand")],
    "numbered_things": [("World War II", "World War two"), ("chapter iv", "chapter four"), ("World War I", "World War one"), ("Malcolm X", "Malcolm X")],
    "numbered_names": [("Henry VIII", "Henry the eighth"), ("Malcolm X", "Malcolm the tenth"), ("And I have", "And I have"), ("Pope John XXIII", "Pope John the twenty third"), ("Louis XXVIII", "Louis the twenty eightth")],
    "smooth": [("a — b", "a, b"), ("wait... now…", "wait, now,"), ("the “big” one (a note) ends", "the big one, a note, ends"), ("it’s , fine,, yes", "it's, fine, yes")],
    "speakable": [("In Lexington, Ky.—since 1978, the U.S. paid $1.3 billion for World War II (1939-1945).", "In Lexington, Kentucky, since nineteen seventy eight, the United States paid 1.3 billion dollars for World War two, nineteen thirty nine to nineteen forty five,."), ("", ""), ("Plain text.", "Plain text.")],
}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _register(step: str) -> None:
    cases = CASES[step]

    def run(spark, d):
        rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "id long, input string")
        if step == "speakable":
            return speech.with_speakable(rows, "input").select("id", "spoken")
        return rows.select("id", getattr(speech, step)(F.col("input")).alias("spoken"))

    run.__name__ = f"speak_{step}" if step != "speakable" else "speakable_cases"
    golden("SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {_quoted(out)})" for i, (_, out) in enumerate(cases)) + ") t(id, spoken)")(run)


for _step in CASES:
    _register(_step)


@query(r"""
    WITH s AS (SELECT doc_id, text AS t FROM documents),
    a AS (SELECT doc_id, regexp_replace(t, '\s*[—–]+\s*', ', ', 'g') AS t FROM s), b AS (SELECT doc_id, regexp_replace(t, '\.\.\.+|…', ',', 'g') AS t FROM a),
    c AS (SELECT doc_id, translate(t, '‘’“”', '''''') AS t FROM b), e AS (SELECT doc_id, regexp_replace(t, '\s*\(([^)]{1,80})\)', ', \1,', 'g') AS t FROM c),
    f AS (SELECT doc_id, regexp_replace(t, '\s+,', ',', 'g') AS t FROM e), g AS (SELECT doc_id, regexp_replace(t, ',\s*,+', ', ', 'g') AS t FROM f)
    SELECT doc_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS smooth FROM g""")
def smooth_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", speech.smooth(F.col("text")).alias("smooth"))


@query()
def speakable_documents(spark, d):
    """All steps on whole documents, and the clip key of the result. Look-around keeps this out of DuckDB; the tests compare
    it with a version in plain Python."""
    spoken = speech.with_speakable(table(spark, d, "documents").select("doc_id", "text"))
    return spoken.select("doc_id", "spoken", timing.content_key(F.lit("aria"), F.col("spoken")).alias("key"))


@query("SELECT doc_id, substr(sha256('kokoro|aria|' || text), 1, 24) AS key FROM documents")
def clip_key(spark, d):
    return table(spark, d, "documents").select("doc_id", timing.content_key(F.lit("aria"), F.col("text")).alias("key"))


@query()
def speakable_lines(spark, d):
    """Spoken forms of all lines of documents; lines that no step may change are told by one look."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return speech.speakable_sentences(lines).select("doc_id", F.col("line").cast("long").alias("line"), "spoken")
