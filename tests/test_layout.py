"""Layout operators on literal geometry beyond what the queries cover."""

from pyspark.sql import functions as F

from inkspark.operators import layout as Y


def test_superscripts(spark):
    cases = {"gas^2": "gas", "70^th": "70th", "70^thx": "70", "a^b c^d": "a c", "^1": "", "3^rd": "3rd", "x^nd": "x"}
    rows = []
    for i, t in enumerate(cases):
        sup = False
        for k, c in enumerate(t):
            sup = (sup or c == "^") and c != " "
            if c != "^":
                rows.append((i, k, c, sup))
    kept = Y.strip_superscripts(spark.createDataFrame(rows, "line int, ord int, c string, sup boolean"), "line")
    got = {r.line: "".join(x.c for x in sorted(r.cs)) for r in kept.groupBy("line").agg(F.collect_list(F.struct("ord", "c")).alias("cs")).collect()}
    assert {t: got.get(i, "") for i, t in enumerate(cases)} == cases


def test_box_count_is_word_count_and_kinds_do_not_mix(spark):
    from inkspark.plans.layout_queries import _stream

    for r in Y.build_document(_stream(spark)).collect():
        assert len(r.boxes) == len(r.text.split())
        assert "Head" not in r.text or r.kind == "header"


def test_raised_small_items(spark):
    items = [("70", 100.0, 10.0), ("th", 98.0, 6.0), ("x", 104.0, 6.0)]
    df = spark.createDataFrame([([{"y": y - s * 0.8 + 8.0, "size": s} for _, y, s in items],)], "items array<struct<y:double,size:double>>")
    assert df.select(Y.flagged_superscripts(F.col("items")).alias("f")).first().f == [False, True, False]


def test_looks_at_lines_are_cheap_and_leave_nothing_out(spark):
    """Rules of lines against their plain forms on odd lines; none remakes the text or cuts it into words where no rule can hold."""
    import random

    from inkspark.functions import text as T
    from inkspark.plans.layout_queries import _paged

    bits = ["Copyright", "copyright", "©", "COPYRıGHT ©", "ALL RİGHTS RESERVED", "all rightſ reſerved", "Harvard  business review", "harvard buſiness school", "HBSP.harvard.edu", "hbspxharvardxedu", "K", "a", "B", "7", "é", "word", "9-111-222",
            "9 - 1 1 1", "-222", "9-1", "11-2", "22", "\x1c", "\x85", "\xa0", "\t", "\n", "  ", "x", "12", "\U00010400"]
    rng = random.Random(2)
    texts = ["".join(rng.choice(bits) + rng.choice([" ", " ", "", " "]) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    texts += ["a b c longer", "a longer b longer c", "a b longer longer c", "a 1 2 word", "", " ", None]
    rows, t = spark.createDataFrame([(x,) for x in texts], "text string"), F.col("text")
    words = T.words(t)
    lone = F.filter(words, lambda w: w.rlike(r"^[\p{L}\p{N}]$"))
    pairs = {
        "notice": (Y.is_boilerplate(t), t.rlike("(?iU)" + "|".join(Y.BOILERPLATE))),
        "number": (Y.starts_with_case_number(t), F.regexp_replace(t, f"(?U){T.WS}+", "").rlike(Y.CASE_NUMBER)),
        "tracked": (Y.is_tracked(t), (F.size(words) >= 4) & (F.size(lone) >= 0.6 * F.size(words)) & (F.size(F.filter(lone, lambda w: w.rlike(r"^\p{L}$"))) >= 2)),
        "collapsed": (T.collapse(t), F.trim(F.regexp_replace(t, f"(?U){T.WS}+", " "))),
    }
    made = rows.select("text", *[c.alias(f"{n}{i}") for n, both in pairs.items() for i, c in enumerate(both)]).collect()
    for name in pairs:
        assert [r.text for r in made if r[f"{name}0"] != r[f"{name}1"] and r.text is not None] == []
        assert name == "collapsed" or {True, False} <= {r[f"{name}0"] for r in made}
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan(rows.select(Y.starts_with_case_number(t)))
    assert "posexplode" not in plan(_paged(spark, "/root/testdata/sf0.001")[0])


def test_characters_without_functions_for_each(spark):
    """Words of characters: white space is looked up as the pattern has it, and no function is run for each character."""
    from inkspark.functions import text as T
    from inkspark.plans.layout_queries import words_of_characters

    singles = [chr(i) for i in range(1, 0x3100)]
    chars = spark.createDataFrame([(c,) for c in [*singles, "", " \n", "\r\n", "fi", "\U00010400", None]], "c string")
    text = "".join(singles) + "\U00010400e\u0301 "
    assert spark.createDataFrame([(text,)], "t string").select(F.split("t", "").alias("cs")).first().cs == list(text)
    assert chars.where(~Y.is_blank(F.col("c")).eqNullSafe(F.col("c").rlike(rf"(?U)^{T.WS}$"))).count() == 0
    assert chars.where(Y.is_blank(F.col("c"))).count() > 20
    plan = words_of_characters(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan


def test_layout_of_odd_texts_as_in_sql_and_without_a_shuffle(spark, tmp_path):
    """Words, lines and sentences stay in their document's row; a word that single spaces leave empty has a box, as in the SQL."""
    import duckdb

    from inkspark.plans import catalog

    long = "word " * 120
    texts = [None, "", " \n\t\n", "One line.", f"Head\nMot : {long}— encore ; {long}!\nA.  B\n\n\n{', ' * 300}", "\n".join(f"Line {i}, of it{'.' * (i % 3 == 0)}" for i in range(140))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("document_layout", "document_leading"):
        got, found = catalog.QUERIES[name](spark, str(tmp_path)), duck.execute(catalog.ORACLE_SQL[name])
        order = [got.columns.index(c[0]) for c in found.description]
        assert sorted(tuple(r[i] for i in order) for r in got.collect()) == sorted(found.fetchall()) != []
        assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
