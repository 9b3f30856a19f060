"""Page layout: lines and characters with boxes to words, kinds of text, paragraphs and sentences with boxes.

Everything that needs order carries an ordinal. Statistics of a document are grouped by doc_id and joined back.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspark.functions import text as T
from inkspark.functions.core import let, running

TOP, BOTTOM = 0.10, 0.90
# Wording of publishers' notices.
BOILERPLATE = (
    r"copyright\s*©", "all rights reserved", "president and fellows of harvard college", "this document is authorized for use only",
    "for the exclusive use of", "no part of this publication may be reproduced", "harvard business (school|publishing|review)",
    r"hbsp\.harvard\.edu", "to order copies or request permission", "developed solely as the basis for class discussion",
    "not intended to serve as endorsements",
)
#: Of each of these the longest part without a pattern. The other letters are those that equal one of a to z whatever the case.
_WORDING = tuple(max(re.split(r"\\s\*|\(.*\)", p.replace(r"\.", ".")), key=len) for p in BOILERPLATE)
_OTHER_LETTERS = "\u0130\u0131\u017f\u212a"
# What a page's number and a case's number look like.
PAGE_LABEL, CASE_NUMBER = r"(?iU)^(page\s*)?[\divxlc]+(\s*(of|/)\s*\d+)?$", r"(?U)^\d-\d{3}-\d{3}"
#: The latter with white space anywhere.
_SPACED_NUMBER = "(?U)^" + "".join(f"{T.WS}*{c}" for c in (r"\d", "-", r"\d", r"\d", r"\d", "-", r"\d", r"\d", r"\d"))
_BOX = ("x0", "y0", "x1", "y1")


def is_boilerplate(text: Column) -> Column:
    """The patterns are run where the wording of one of them is found, which is looked up without a pattern."""
    worded = let(F.lower(text), lambda low: reduce(Column.__or__, (F.contains(low, F.lit(w)) for w in _WORDING)))
    other = reduce(Column.__or__, (F.contains(text, F.lit(c)) for c in _OTHER_LETTERS))
    return F.when(worded | other | text.isNull(), text.rlike("(?iU)" + "|".join(BOILERPLATE))).otherwise(False)


def is_page_label(text: Column) -> Column:
    return text.rlike(PAGE_LABEL)


def is_case_number(text: Column) -> Column:
    return text.rlike(CASE_NUMBER + "$")


def starts_with_case_number(text: Column) -> Column:
    return text.rlike(_SPACED_NUMBER)


def is_tracked(text: Column) -> Column:
    """Letter-spaced type: 4 words or more, of which 60 % or more are single letters or digits, with 2 letters or more. So two of
    those follow each other with one other word between them at most; words are counted where that is so."""
    one = r"[\p{L}\p{N}]"
    close = F.concat(F.lit(" "), text, F.lit(" ")).rlike(rf"(?U){T.WS}{one}{T.WS}+(?:[^\s\x1c-\x1f]+{T.WS}+)?{one}{T.WS}")
    words = T.words(text)
    lone = F.filter(words, lambda w: w.rlike(rf"^{one}$"))
    letters = F.size(F.filter(lone, lambda w: w.rlike(r"^\p{L}$")))
    return F.when(close | text.isNull(), (F.size(words) >= 4) & (F.size(lone) >= 0.6 * F.size(words)) & (letters >= 2)).otherwise(False)


def at_top(y1: Column, height: Column) -> Column:
    return y1 <= height * TOP


def at_bottom(y0: Column, height: Column) -> Column:
    return y0 >= height * BOTTOM


def running_signatures(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, signature) of lines that recur at the head or foot of 30 % of the pages, 2 at least (half to even)."""
    n = pages.groupBy("doc_id").agg(F.greatest(F.lit(2), F.bround(F.count(F.lit(1)) * 0.3)).alias("least"))
    # lines that are in the middle of the highest and of the lowest page are not joined
    heights = F.broadcast(pages.agg(F.max("height").alias("__most"), F.min("height").alias("__least")))
    outer = lines.crossJoin(heights).where(at_top(F.col("y1"), F.col("__most")) | at_bottom(F.col("y0"), F.col("__least"))).drop("__most", "__least")
    banded = outer.join(pages.select("doc_id", "page", "height"), ["doc_id", "page"]).where(at_top(F.col("y1"), F.col("height")) | at_bottom(F.col("y0"), F.col("height")))
    seen = banded.groupBy("doc_id", T.signature(F.col("text")).alias("signature")).agg(F.countDistinct("page").alias("pages"))
    return seen.join(n, "doc_id").where("pages >= least").select("doc_id", "signature")


def weighted_mode(rows: DataFrame, key: str, value: Column, weight: Column, *order: str) -> DataFrame:
    """(key, mode): the value with the most weight; of equals, the one seen first."""
    tally = rows.groupBy(key, value.alias("__v")).agg(F.sum(weight).alias("__w"), F.min(F.struct(*order)).alias("__first"))
    return tally.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__w"), "__first"))).where("__n = 1").select(key, F.col("__v").alias("mode"))


def body_size(lines: DataFrame) -> DataFrame:
    """(doc_id, mode): the size, to half points, that most text is set in."""
    return weighted_mode(lines, "doc_id", F.bround(F.col("size") * 2) / 2, F.length("text"), "page", "block", "line")


def upper_median(name: str) -> Column:
    """The middle value of a column of numbers; of an even number the upper one. Values are counted, not gathered."""
    return -F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -`{name}`)")


def in_order(c: str) -> Column:
    """Aggregate: the characters of a group by ``ord``, joined. Neither the order nor the field goes through a function for each."""
    return F.array_join(F.sort_array(F.collect_list(F.struct("ord", c)))[c], "")


#: What T.WS matches.
_BLANKS = [chr(i) for i in (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def is_blank(c: Column) -> Column:
    """Whether a character is white space: looked up; what is no single character is left to the pattern."""
    return F.when(F.length(c) == 1, c.isin(_BLANKS)).otherwise(c.rlike(rf"(?U)^{T.WS}$"))


def lines_from_chars(chars: DataFrame, *key: str) -> DataFrame:
    """Lines of characters (key, ord, c, size, sup, x0, y0, x1, y1), such as a glyph table has them: text, the largest size that is
    not raised (of all, if everything is), weight (the text's length) and the hull. Blank lines go."""
    size = F.coalesce(F.max(F.when(~F.col("sup"), F.col("size"))), F.max("size"))
    hull = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    text = in_order("c")
    lines = chars.groupBy(*key).agg(text.alias("text"), size.alias("size"), *hull).withColumn("weight", F.length("text"))
    return lines.where(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]"))


def line_kinds(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines (doc_id, page, block, line, x0, y0, x1, y1, text, size) with their kind; the first rule that holds decides. What a text
    says by itself is looked up before the joins, so that they carry it and a digest of the signature, and texts where asked for."""
    digest = lambda signature: F.unhex(F.sha2(signature, 256)).alias("__signature")
    text = F.col("text")
    says = {"__notice": is_boilerplate(text), "__label": is_page_label(text) | is_case_number(text), "__number": starts_with_case_number(text), "__tracked": is_tracked(text)}
    running = running_signatures(lines, pages).select("doc_id", digest(F.col("signature")), F.lit(True).alias("__recurs"))
    sized = lines.select("*", *[c.alias(n) for n, c in says.items()], digest(T.signature(text))).join(pages.select("doc_id", "page", "height"), ["doc_id", "page"])
    sized = sized.join(running, ["doc_id", "__signature"], "left").join(body_size(lines).withColumnRenamed("mode", "__body"), "doc_id", "left")
    top, bottom = at_top(F.col("y1"), F.col("height")), at_bottom(F.col("y0"), F.col("height"))
    head_or_foot = F.when(top, F.lit("header")).otherwise(F.lit("footer"))
    kind = (
        F.when(F.col("__notice"), F.lit("boilerplate"))
        .when(F.col("__recurs"), head_or_foot)
        .when((top | bottom) & F.col("__label"), head_or_foot)
        .when(F.col("__number"), F.lit("header"))
        .when(F.col("__tracked"), F.when(F.col("y0") < F.col("height") / 2, F.lit("header")).otherwise(F.lit("footer")))
        .when(F.col("size") <= F.col("__body") - 0.6, F.lit("footnote"))
        .otherwise(F.lit("body"))
    )
    return sized.select(*lines.columns, kind.alias("kind"))


def strip_superscripts(chars: DataFrame, *key: str, within: str | None = None) -> DataFrame:
    """Characters (key, ord, c, sup) without runs of superscripts, but for st, nd, rd, th right after a digit. With ``within``, a
    column that rises along a line, each of its values is a line of its own, though lines are sorted and scanned whole."""
    order, before = Window.partitionBy(*key).orderBy("ord"), Window.partitionBy(*key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    part = F.col(within) if within else F.lit(0)
    same = F.coalesce(F.lag(part).over(order) == part, F.lit(False))
    runs = chars.withColumn("__new", F.when(same, F.coalesce((F.col("sup") != F.lag("sup").over(order)).cast("int"), F.lit(1))).otherwise(1))
    plain = F.last(F.when(~F.col("sup"), F.struct(part.alias("part"), "c")), ignorenulls=True).over(before)
    runs = runs.withColumn("__run", F.sum("__new").over(order)).withColumn("__prev", plain)
    runs = runs.withColumn("__prev", F.when(F.col("__prev.part") == part, F.col("__prev.c")))
    whole = Window.partitionBy(*key, "__run").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    suffix = F.lower(F.trim(F.array_join(F.collect_list("c").over(whole), "")))
    kept = ~F.col("sup") | (suffix.isin("st", "nd", "rd", "th") & F.coalesce(F.first("__prev").over(whole).rlike(r"^\p{Nd}$"), F.lit(False)))
    return runs.withColumn("__kept", kept).where("__kept").drop("__new", "__run", "__prev", "__kept")


def words_from_chars(chars: DataFrame, *key: str) -> DataFrame:
    """Words of lines of characters (key, ord, c, sup, x0, y0, x1, y1): cut at white space, superscripts stripped within
    each word; a word's box is the hull of what stays. Adds pos, counted in each line."""
    order = Window.partitionBy(*key).orderBy("ord")
    blank = is_blank(F.col("c"))
    cut = chars.withColumn("__word", F.sum(blank.cast("int")).over(order)).where(~blank)
    kept = strip_superscripts(cut, *key, within="__word")
    hull = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    words = kept.groupBy(*key, "__word").agg(in_order("c").alias("text"), *hull)
    placed = Window.partitionBy(*key).orderBy("__word")
    return words.where("text <> ''").withColumn("pos", (F.row_number().over(placed) - 1).cast("long")).drop("__word")


def with_runs(rows: DataFrame, partition: str, order: str, *same: str) -> DataFrame:
    """Gaps and islands: consecutive rows that agree in ``same`` get one run number, from 0. ``scan.run_numbers`` does the same
    where one partition may hold a large share of all rows."""
    by = Window.partitionBy(partition).orderBy(order)
    now = F.struct(*same)
    changed = F.coalesce((~now.eqNullSafe(F.lag(now).over(by))).cast("long"), F.lit(0))
    changed = F.when(F.row_number().over(by) == 1, F.lit(0)).otherwise(changed)
    return rows.withColumn("__c", changed).withColumn("run", F.sum("__c").over(by)).drop("__c")


def stream_lines(words: DataFrame) -> DataFrame:
    """Words (doc_id, pos, page, block, line, text, box) in stream order to lines: consecutive words of one place."""
    numbered = with_runs(words, "doc_id", "pos", "page", "block", "line").withColumnRenamed("run", "line_no")
    return numbered.groupBy("doc_id", "line_no").agg(
        F.first("page").alias("page"), F.first("block").alias("block"), F.min("pos").alias("pos"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda w: w.text).alias("words"),
    )


def typical_leading(lines: DataFrame) -> DataFrame:
    """(doc_id, leading): upper median of the gaps from line to line on a page, above 1 and at most 2.2 heights; without
    such, 1.15 times the median height and 1 at least."""
    by = Window.partitionBy("doc_id").orderBy("line_no")
    gaps = lines.withColumn("dy", F.when(F.lag("page").over(by) == F.col("page"), F.col("y0") - F.lag("y0").over(by)))
    height = lines.withColumn("__height", F.col("y1") - F.col("y0")).groupBy("doc_id").agg(upper_median("__height").alias("height"))
    both = gaps.join(height, "doc_id")
    fits = F.when((F.col("dy") > 1) & (F.col("dy") <= F.col("height") * 2.2), F.col("dy"))
    return both.withColumn("__fits", fits).groupBy("doc_id").agg(F.coalesce(upper_median("__fits"), F.greatest(F.max("height") * 1.15, F.lit(1.0))).alias("leading"))


def islands(items: Column, same) -> Column:
    """Consecutive items of an array, as arrays: an item joins the one before it where ``same`` of the two holds."""

    def cut(xs: Column) -> Column:
        first = F.filter(F.transform(xs, lambda x, i: F.when((i == 0) | ~F.coalesce(same(F.get(xs, i - 1), x), F.lit(False)), i)), lambda i: i.isNotNull())

        def parts(at: Column) -> Column:
            ends = F.slice(F.concat(F.slice(at, 2, F.size(at)), F.array(F.size(xs))), 1, F.size(at))
            return F.zip_with(at, ends, lambda a, b: F.slice(xs, a + 1, b - a))

        return let(first, parts)

    return let(items, cut)


def _same(*fields: str):
    return lambda a, b: F.struct(*[a[f].alias(f) for f in fields]).eqNullSafe(F.struct(*[b[f].alias(f) for f in fields]))


def lines_of_words(words: Column) -> Column:
    """Lines of a document's words (kind, page, block, line, text, box) in stream order: consecutive words of one kind and place, as
    (kind, page, block, line, y0, y1, words, boxes)."""

    def line(ws: Column) -> Column:
        first, box = F.get(ws, F.lit(0)), lambda w: F.struct(w.page.alias("page"), *[w[c].alias(c) for c in _BOX])
        y0, y1 = F.array_min(F.transform(ws, lambda w: w.y0)), F.array_max(F.transform(ws, lambda w: w.y1))
        places = [first[f].alias(f) for f in ("kind", "page", "block", "line")]
        return F.struct(*places, y0.alias("y0"), y1.alias("y1"), F.transform(ws, lambda w: w.text).alias("words"), F.transform(ws, box).alias("boxes"))

    return F.transform(islands(words, _same("kind", "page", "block", "line")), line)


def leading_of(lines: Column) -> Column:
    """As typical_leading(), of the lines of one document in order; null where it has no body."""
    median = lambda xs: let(F.sort_array(F.filter(xs, lambda x: x.isNotNull())), lambda v: F.get(v, F.floor(F.size(v) / 2).cast("int")))
    body = F.transform(F.filter(lines, lambda x: x.kind == "body"), lambda x: F.struct(x.page.alias("page"), x.block.alias("block"), x.line.alias("line"), x.y0.alias("y0"), x.y1.alias("y1")))
    hull = lambda xs: F.struct(F.get(xs, F.lit(0)).page.alias("page"), F.array_min(F.transform(xs, lambda x: x.y0)).alias("y0"), F.array_max(F.transform(xs, lambda x: x.y1)).alias("y1"))

    def usual(ls: Column, height: Column) -> Column:
        gaps = F.transform(ls, lambda x, i: F.when(F.get(ls, i - 1).page == x.page, x.y0 - F.get(ls, i - 1).y0))
        fits = F.filter(gaps, lambda dy: (dy > 1) & (dy <= height * 2.2))
        return F.coalesce(median(fits), F.when(F.size(ls) > 0, F.greatest(height * 1.15, F.lit(1.0))))

    return let(F.transform(islands(body, _same("page", "block", "line")), hull), lambda ls: let(median(F.transform(ls, lambda x: x.y1 - x.y0)), lambda h: usual(ls, h)))


def joined_lines(lines: Column, leading: Column) -> Column:
    """The text of a run's lines, joined by a space where wrapped, else a blank line."""

    def part(x: Column, i: Column) -> Column:
        before = F.get(lines, i - 1)
        last = F.trim(F.element_at(before.words, -1))
        ends, dy = last.rlike(r"[.!?:;]$") | (last == ""), x.y0 - before.y0
        wrapped = F.when((before.page == x.page) & (before.block == x.block), True).when(before.page != x.page, ~ends).when(dy <= 1, False).otherwise(dy <= leading * 1.4)
        gap = F.when(before.page.isNull(), F.lit("")).when(wrapped, F.lit(" ")).otherwise(F.lit("\n\n"))
        return F.concat(gap, F.array_join(x.words, " "))

    return F.array_join(F.transform(lines, part), "")


def aligned(tokens: Column, words: Column) -> Column:
    """For each token the index of its source word, or -1 past the end: the word at the cursor if equal, else the first of
    the next 8 that begins with the token or with which it begins, else the one at the cursor. An empty token has none."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("found"))

    def of(ws: Column) -> Column:
        def add(acc: Column, token: Column) -> Column:
            at = acc["at"]
            near = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.when(F.startswith(token, F.get(ws, at + k)) | F.startswith(F.get(ws, at + k), token), at + k))
            probe = F.get(F.filter(near, lambda k: k.isNotNull()), F.lit(0))
            found = F.when((at >= F.size(ws)) | (token == ""), -1).when(F.get(ws, at) == token, at).otherwise(F.coalesce(probe, at))
            return let(found, lambda f: F.struct(F.when(f < 0, at).otherwise(f + 1).alias("at"), f.alias("found")))

        return running(tokens, start, add, lambda acc: acc["found"], "int")

    return let(words, of)


def laid_out(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_id, kind, text, boxes): sentences of documents (doc_id, lines), whose lines (kind, page, block, line, y0, y1, words,
    boxes) are in stream order. Each run of one kind is cut by itself, so furniture never joins prose; single spaces part words, each
    has a box, and one that is not found a zero box. A document is one row, so neither its words nor its lines are shuffled."""
    tokens = lambda c: F.split(c, " ")

    def parts(run: Column, chunks: Column, at: Column) -> Column:
        kind, boxes = F.get(run, F.lit(0)).kind, F.flatten(F.transform(run, lambda x: x.boxes))
        zero = F.struct(F.get(F.get(run, F.lit(0)).boxes, F.lit(0)).page.alias("page"), *[F.lit(0.0).alias(c) for c in _BOX])
        found = let(boxes, lambda bs: F.transform(at, lambda i: F.coalesce(F.get(bs, i), zero)))
        counted = F.transform(chunks, lambda c: F.struct(c.alias("text"), F.size(tokens(c)).alias("n")))
        ends = lambda cs: running(F.transform(cs, lambda c: c.n), F.lit(0), lambda s, n: s + n, lambda s: s, "int")
        one = lambda bs: lambda c, end: F.struct(kind.alias("kind"), c.text.alias("text"), F.slice(bs, end - c.n + 1, c.n).alias("boxes"))
        return let(counted, lambda cs: let(found, lambda bs: F.zip_with(cs, ends(cs), one(bs))))

    # in steps: one expression of them all would be nested too deeply for the analyser
    runs = docs.select("doc_id", F.coalesce(leading_of(F.col("lines")), F.lit(13.8)).alias("leading"), islands(F.col("lines"), _same("kind")).alias("runs"))
    texts = runs.select("doc_id", "runs", let(F.col("leading"), lambda usual: F.transform("runs", lambda run: joined_lines(run, usual))).alias("texts"))
    cut = texts.select("doc_id", "runs", F.transform("texts", lambda t: T.chunks(t)).alias("chunks"))
    source = lambda run: F.flatten(F.transform(run, lambda x: x.words))
    placed = cut.select("doc_id", "runs", "chunks", F.zip_with("runs", "chunks", lambda run, cs: aligned(F.flatten(F.transform(cs, tokens)), source(run))).alias("at"))
    zipped = F.transform(F.arrays_zip("runs", "chunks", "at"), lambda x: parts(x.runs, x.chunks, x["at"]))
    rows = placed.select("doc_id", F.posexplode(F.flatten(zipped)).alias("sent_id", "s"))
    return rows.select("doc_id", F.col("sent_id").cast("long").alias("sent_id"), "s.kind", "s.text", "s.boxes")


def build_document(words: DataFrame) -> DataFrame:
    """(doc_id, sent_id, kind, text, boxes): laid_out() of words (doc_id, pos, page, block, line, kind, text, box), which are
    brought together by document once."""
    fields = ["pos", "kind", "page", "block", "line", "text", *_BOX]
    docs = words.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("words"))
    return laid_out(docs.select("doc_id", lines_of_words(F.col("words")).alias("lines")))


def line_bands(boxes: Column) -> Column:
    """Boxes (page, x, y, w, h) in order to bands, one for each visual line: a box joins the band before it if it is on the
    same page and its y differs by at most 0.6 of the band's height, which grows. Boxes without area are skipped."""
    band = "struct<page:int,x:double,y:double,w:double,h:double>"
    none = F.lit(None).cast(band)

    def step(acc: Column, b: Column) -> Column:
        cur = acc["cur"]
        joins = F.coalesce((cur.page == b.page) & (F.abs(b.y - cur.y) <= cur.h * 0.6), F.lit(False))
        x, y = F.least(cur.x, b.x), F.least(cur.y, b.y)
        hull = F.struct(cur.page.alias("page"), x.alias("x"), y.alias("y"), (F.greatest(cur.x + cur.w, b.x + b.w) - x).alias("w"), (F.greatest(cur.y + cur.h, b.y + b.h) - y).alias("h"))
        return F.struct(F.when(joins, hull).otherwise(b).cast(band).alias("cur"), F.when(~joins, cur).alias("done"))

    valid = F.transform(F.filter(boxes, lambda b: (b.w > 0) & (b.h > 0)), lambda b: F.struct(b.page.alias("page"), b.x.alias("x"), b.y.alias("y"), b.w.alias("w"), b.h.alias("h")).cast(band))
    # nothing behind the last box ends the last band
    done = running(F.concat(valid, F.array(none)), F.struct(none.alias("cur"), none.alias("done")), step, lambda acc: acc["done"], band)
    return F.when(boxes.isNotNull(), F.filter(done, lambda x: x.isNotNull()))


def place(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A box in percent of its page."""
    return F.struct((100 * x / width).alias("left"), (100 * y / height).alias("top"), (100 * w / width).alias("width"), (100 * h / height).alias("height"))


def item_box(viewport: Column, transform: Column, width: Column, item_height: Column) -> Column:
    """A text item's box (x, y, w, h, size) from the page's and its own affine matrices of six numbers; the ascent is 0.8."""
    m, t = [F.get(viewport, F.lit(i)) for i in range(6)], [F.get(transform, F.lit(i)) for i in range(6)]
    reach = F.hypot(m[0] * t[2] + m[2] * t[3], m[1] * t[2] + m[3] * t[3])
    size = F.when(reach != 0, reach).otherwise(F.coalesce(item_height, F.lit(0.0)))
    x, baseline = m[0] * t[4] + m[2] * t[5] + m[4], m[1] * t[4] + m[3] * t[5] + m[5]
    return F.struct(x.alias("x"), (baseline - size * 0.8).alias("y"), width.alias("w"), size.alias("h"), size.alias("size"))


def item_lines(items: Column) -> Column:
    """For each item (x, y, w, h, size) in order the number of its line: it joins the line it overlaps by 40 % of the lower
    height, unless it begins more than its size left of the line's right edge. The line's box grows."""
    state = "struct<line:int,y:double,h:double,right:double>"
    start = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("y"), F.lit(0.0).alias("h"), F.lit(0.0).alias("right")).cast(state)

    def step(acc: Column, it: Column) -> Column:
        y, h, right = acc["y"], acc["h"], acc["right"]
        overlap = F.least(y + h, it.y + it.h) - F.greatest(y, it.y)
        fits = (acc["line"] >= 0) & (overlap >= 0.4 * F.least(h, it.h)) & (it.x >= right - it["size"])
        top = F.when(fits, F.least(y, it.y)).otherwise(it.y)
        low = F.when(fits, F.greatest(y + h, it.y + it.h)).otherwise(it.y + it.h)
        far = F.when(fits, F.greatest(right, it.x + it.w)).otherwise(F.greatest(it.x, it.x + it.w))
        return F.struct((acc["line"] + (~fits).cast("int")).alias("line"), top.alias("y"), (low - top).alias("h"), far.alias("right")).cast(state)

    return running(items, start, step, lambda acc: acc["line"], "int")


def joined_items(items: Column) -> Column:
    """A line's items (str, x, w, size) as one string; a gap of 0.12 of the smaller size or more is a space."""
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("right"), F.lit(0.0).alias("size"))

    def add(acc: Column, it: Column) -> Column:
        spaced = acc["text"].rlike(r"\s$") | it.str.rlike(r"^\s") | (acc["text"] == "")
        gap = F.coalesce(~spaced & (it.x - acc["right"] >= 0.12 * F.least(acc["size"], it["size"])), F.lit(False))
        return F.struct(F.concat(acc["text"], F.when(gap, F.lit(" ")).otherwise(F.lit("")), it.str).alias("text"), (it.x + it.w).alias("right"), it["size"].alias("size"))

    return F.aggregate(items, start, add, lambda acc: T.collapse(acc["text"]))


def flagged_superscripts(items: Column) -> Column:
    """For each of a line's items (y, size): is it smaller than the largest by 0.6 or more, and raised by over a tenth?"""
    most = F.array_max(F.transform(items, lambda it: it["size"]))
    first = F.get(F.filter(items, lambda it: it["size"] == most), F.lit(0))
    baseline = first.y + most * 0.8
    return F.transform(items, lambda it: (it["size"] <= most - 0.6) & (baseline - (it.y + it["size"] * 0.8) > 0.1 * most))


# Characters wider and narrower than average.
WIDE, NARROW = "MWmw@%", "ijltfIJ.,;:'\"`!|()[]{}-"


def text_width(text: Column, wide: str = WIDE, narrow: str = NARROW) -> Column:
    """Width of a string in average characters: wide ones count 1.6, narrow ones 0.55."""
    count = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    return F.length(text) + 0.6 * count(wide) - 0.45 * count(narrow)


def item_words(items: Column, wide: str = WIDE, narrow: str = NARROW) -> Column:
    """Words (text, x, y, w, h) of a line's items (str, x, y, w, h, size): pieces join when less than 0.12 of the smaller
    size separates them and no white space does."""
    word = "struct<text:string,x:double,y:double,w:double,h:double>"
    piece_of = lambda it: F.transform(T.tokenize(it.str), lambda t: F.struct(
        t.text.alias("text"), (it.x + it.w * text_width(F.substr(it.str, F.lit(1), t.start), wide, narrow) / text_width(it.str, wide, narrow)).alias("x"),
        (it.w * text_width(t.text, wide, narrow) / text_width(it.str, wide, narrow)).alias("w"), it.y.alias("y"), it.h.alias("h"), it["size"].alias("size"),
        (t.start > 0).alias("before"), ((t.end == F.length(it.str)) & ~it.str.rlike(r"\s$")).alias("glued"),
    ))
    pieces = F.flatten(F.transform(items, piece_of))
    piece = "struct<text:string,x:double,w:double,y:double,h:double,size:double,before:boolean,glued:boolean>"
    none = F.lit(None).cast(word)
    start = F.struct(none.alias("cur"), F.lit(0.0).alias("right"), F.lit(0.0).alias("size"), F.lit(False).alias("glued"), none.alias("done"))

    def step(acc: Column, p: Column) -> Column:
        cur = acc["cur"]
        joins = F.coalesce(cur.isNotNull() & acc["glued"] & ~p.before & (p.x - acc["right"] < 0.12 * F.least(acc["size"], p["size"])), F.lit(False))
        y = F.least(cur.y, p.y)
        grown = F.struct(F.concat(cur.text, p.text).alias("text"), cur.x.alias("x"), y.alias("y"), F.greatest(cur.w, p.x + p.w - cur.x).alias("w"), (F.greatest(cur.y + cur.h, p.y + p.h) - y).alias("h"))
        fresh = F.struct(p.text.alias("text"), p.x.alias("x"), p.y.alias("y"), p.w.alias("w"), p.h.alias("h"))
        return F.struct(F.when(joins, grown).otherwise(fresh).cast(word).alias("cur"), (p.x + p.w).alias("right"), p["size"].alias("size"), p.glued.alias("glued"), F.when(~joins, cur).alias("done"))

    # nothing behind the last piece ends the last word
    done = running(F.concat(F.transform(pieces, lambda p: p.cast(piece)), F.array(F.lit(None).cast(piece))), start, step, lambda acc: acc["done"], word)
    return F.filter(done, lambda w: w.isNotNull())
