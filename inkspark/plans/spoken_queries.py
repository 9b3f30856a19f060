"""Spoken forms over orders: each order gives a sentence, made by one expression that Spark and DuckDB both read, and SQL says
how it is spoken from the numbers themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspark.functions import speech

from .registry import query, table


def _pick(by: str, values) -> str:
    return f"CASE {by} " + " ".join(f"WHEN {i} THEN " + "'" + v.replace("'", "''") + "'" for i, v in enumerate(values)) + " END"


_CODES, _STATES = list(speech.STATES), list(speech.STATES.values())
_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
#: DuckDB: num(n, w), the words of 0 to 99.
_NUM = f"""num AS (SELECT n, CASE WHEN n < 20 THEN {_pick("n", _SMALL)} WHEN n % 10 = 0 THEN {_pick("n // 10", _TENS)}
    ELSE {_pick("n // 10", _TENS)} || ' ' || {_pick("n % 10", _SMALL[:10])} END AS w FROM (SELECT unnest(range(100)) AS n))"""


def _year(y: str) -> str:
    """DuckDB: the words of a year."""
    word = lambda n: f"(SELECT w FROM num WHERE n = {n})"
    recent = f"CASE WHEN {y} = 2000 THEN 'two thousand' WHEN {y} < 2010 THEN 'two thousand ' || {word(f'{y} - 2000')} ELSE 'twenty ' || {word(f'{y} - 2000')} END"
    older = f"{word(f'{y} // 100')} || CASE WHEN {y} % 100 = 0 THEN ' hundred' WHEN {y} % 100 < 10 THEN ' oh ' || {word(f'{y} % 100')} ELSE ' ' || {word(f'{y} % 100')} END"
    return f"CASE WHEN {y} >= 2000 THEN {recent} ELSE {older} END"


_ROMAN = lambda n: f"({_pick(f'cast(floor({n} / 10) AS INT)', ['', 'X', 'XX', 'XXX', 'XL'])} || {_pick(f'cast({n} % 10 AS INT)', ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])})"
_Y = "(1100 + k % 1000)"
_ORDINALS = {1: "first", 2: "second", 3: "third", 5: "fifth", 8: "eighth", 9: "ninth", 12: "twelfth"}


def _ordinal(n: str) -> str:
    """DuckDB: ordinals up to twenty five, thirty and forty are the English ones; others are the cardinal and "th"."""
    of = lambda m: f"CASE {m} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in _ORDINALS.items()) + f" ELSE (SELECT w FROM num WHERE n = {m}) || 'th' END"
    return f"CASE WHEN {n} < 20 THEN {of(n)} WHEN {n} = 20 THEN 'twentieth' WHEN {n} = 30 THEN 'thirtieth' WHEN {n} = 40 THEN 'fortieth' WHEN {n} <= 25 THEN 'twenty ' || {of(f'({n} - 20)')} ELSE (SELECT w FROM num WHERE n = {n}) || 'th' END"


_AMOUNT = """(CASE WHEN k % 50 = 0 THEN '1' WHEN k % 50 = 1 THEN '1.00' WHEN k % 3 = 0 THEN cast(k % 999 + 2 AS STRING)
    ELSE cast(k % 37 + 1 AS STRING) || ',' || lpad(cast(k % 1000 AS STRING), 3, '0') || '.5' END)"""
_SCALE = _pick("cast(k % 5 AS INT)", ["", "", " million", " Billion", " thousand"])
_HEADS = ["war", "chapter", "Part", "volume", "Figure", "act"]
_PLACES = {"U.S.A.": "United States", "U.S.": "United States", "U.K.": "United Kingdom", "D.C.": "District of Columbia", "Ph.D.": "PhD"}
_LETTER = lambda n: _pick(f"cast({n} % 8 AS INT)", list("BFGHJMQR"))
_CODE, _NAME = _pick(f"cast(k % {len(_CODES)} AS INT)", _CODES), _pick(f"cast(k % {len(_CODES)} AS INT)", _STATES)
_AFTER = _pick("cast(k % 6 AS INT)", ["", ", today", " 04101", ")", "—we met", " and more"])

#: step: (the sentence, in both dialects; DuckDB: how it is spoken)
RULES = {
    "years": (f"'It was in ' || cast({_Y} AS STRING) || '.'", f"'It was in ' || {_year(_Y)} || '.'"),
    "year_ranges": (f"'from ' || cast({_Y} AS STRING) || CASE WHEN k % 2 = 0 THEN '-' ELSE ' – ' END || cast(1990 + k % 30 AS STRING) || ' on'", f"'from ' || {_year(_Y)} || ' to ' || {_year('(1990 + k % 30)')} || ' on'"),
    "decades": (
        "'the ' || cast((110 + k % 95) * 10 AS STRING) || CASE WHEN k % 2 = 0 THEN 's' ELSE '''s' END || ' were'",
        "'the ' || CASE (110 + k % 95) WHEN 200 THEN 'two thousands' ELSE (SELECT w FROM num WHERE n = (110 + k % 95) // 10) || ' ' || "
        + _pick("(110 + k % 95) % 10", ["hundreds", "tens", "twenties", "thirties", "forties", "fifties", "sixties", "seventies", "eighties", "nineties"]) + " END || ' were'",
    ),
    "money": (f"'a $' || {_AMOUNT} || {_SCALE} || ' offer'", f"'a ' || {_AMOUNT} || lower({_SCALE}) || CASE WHEN {_SCALE} = '' AND k % 50 < 2 THEN ' dollar' ELSE ' dollars' END || ' offer'"),
    "states_after_comma": (f"'in Springfield, ' || {_CODE} || {_AFTER}", f"'in Springfield, ' || CASE k % 6 WHEN 5 THEN {_CODE} ELSE {_NAME} END || {_AFTER}"),
    "states_in_parentheses": (f"'Boston (' || CASE WHEN k % 7 = 0 THEN 'zz' ELSE {_CODE} END || ') won'", f"'Boston (' || CASE WHEN k % 7 = 0 THEN 'zz' ELSE {_NAME} END || ') won'"),
    "dotted_places": (f"'the ' || {_pick('cast(k % 5 AS INT)', _PLACES)} || ' rule'", f"'the ' || {_pick('k % 5', _PLACES.values())} || ' rule'"),
    "dotted_acronyms": (
        f"'an ' || {_LETTER('k')} || '.' || {_LETTER('floor(k / 8)')} || '.' || CASE WHEN k % 3 = 0 THEN '' ELSE {_LETTER('floor(k / 64)')} || '.' END || ' here'",
        f"'an ' || {_LETTER('k')} || CASE WHEN k % 3 = 0 THEN '.' ELSE '' END || {_LETTER('floor(k / 8)')} || CASE WHEN k % 3 = 0 THEN '.' ELSE {_LETTER('floor(k / 64)')} END || ' here'",
    ),
    "numbered_things": (
        f"'See ' || {_pick('cast(k % 6 AS INT)', _HEADS)} || ' ' || CASE WHEN k % 2 = 0 THEN {_ROMAN('(k % 40 + 1)')} ELSE lower({_ROMAN('(k % 40 + 1)')}) END || ' now'",
        f"'See ' || {_pick('k % 6', _HEADS)} || ' ' || (SELECT w FROM num WHERE n = k % 40 + 1) || ' now'",
    ),
    "numbered_names": (f"'King Henry ' || {_ROMAN('(k % 39 + 2)')} || ' spoke'", f"'King Henry the ' || {_ordinal('(k % 39 + 2)')} || ' spoke'"),
}


def _register(step: str, sentence: str, spoken: str) -> None:
    def run(spark, d):
        said = table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).select("k", F.expr(sentence).alias("t"))
        return said.select("k", "t", getattr(speech, step)(F.col("t")).alias("spoken"))

    run.__name__ = f"spoken_{step}"
    query(f"WITH {_NUM}, o AS (SELECT o_orderkey AS k FROM orders) SELECT k, {sentence} AS t, {spoken} AS spoken FROM o")(run)


for _step, _rule in RULES.items():
    _register(_step, *_rule)
