"""Sentence and token functions over columns.

White space is Python's: Unicode's plus \\x1c-\\x1f. Lengths and offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let, running

WS = r"[\s\x1c-\x1f]"
#: A chunk has at most MAX_CHARS characters; a sentence or chunk under MIN_CHARS joins its neighbour.
MIN_CHARS, MAX_CHARS = 40, 480
# Where texts are cut.
#: Ends of sentences. Closing quotes and brackets before the gap are part of the separator and so are dropped.
SENTENCE_GAP = rf"""(?U)(?<=[.!?])["')\]]*{WS}+(?=["'(\[]?[A-Z0-9])"""
CLAUSE_GAP = rf"(?U)[,;:—–]{WS}+"


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends. Single spaces are not replaced by themselves."""
    return F.trim(F.regexp_replace(text, rf"(?U)[\s\x1c-\x1f&&[^ ]]{WS}*| {WS}+", " "))


def blocks(text: Column) -> Column:
    """Paragraphs, separated by blank lines, collapsed, without blank ones."""
    return F.filter(F.transform(F.split(text, rf"(?U)\n{WS}*\n"), collapse), lambda b: b != "")


def sentences(text: Column) -> Column:
    """The sentences of each paragraph, in order."""
    parts = F.flatten(F.transform(blocks(text), lambda b: F.transform(F.split(b, SENTENCE_GAP), lambda s: F.trim(s))))  # as a function of two, F.trim would be given the place as well
    return F.filter(parts, lambda s: s != "")


def _rejoined(sentence: Column) -> Column:
    """Clauses put together again, up to MAX_CHARS; the delimiter between two that stay together becomes a comma."""
    empty = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("parts"))

    def add(acc: Column, piece: Column) -> Column:
        longer = F.when(acc.cur == "", piece).otherwise(F.btrim(F.concat(acc.cur, F.lit(", "), piece), F.lit(", ")))
        full = (F.length(longer) > MAX_CHARS) & (acc.cur != "")
        return F.struct(F.when(full, piece).otherwise(longer).alias("cur"), F.when(full, F.array_append(acc.parts, acc.cur)).otherwise(acc.parts).alias("parts"))

    done = F.aggregate(F.split(sentence, CLAUSE_GAP), empty, add, lambda acc: F.when(acc.cur == "", acc.parts).otherwise(F.array_append(acc.parts, acc.cur)))
    return done


def _hard_cut(part: Column) -> Column:
    """Pieces of at most MAX_CHARS, cut at the last space before that, else there. Two neighbouring pieces have MAX_CHARS
    characters or more, which bounds the steps."""
    steps = F.sequence(F.lit(1), 2 * F.floor(F.length(part) / MAX_CHARS).cast("int") + 2)
    start = F.struct(part.alias("rest"), F.array().cast("array<string>").alias("out"))

    def cut(acc: Column, _: Column) -> Column:
        space = MAX_CHARS - F.instr(F.reverse(F.substring(acc.rest, 1, MAX_CHARS)), " ")
        at = F.when((space > 0) & (space < MAX_CHARS), space).otherwise(MAX_CHARS)
        long = F.length(acc.rest) > MAX_CHARS
        rest = F.when(long, F.trim(F.substr(acc.rest, at + 1))).otherwise(acc.rest)
        return F.struct(rest.alias("rest"), F.when(long, F.array_append(acc.out, F.substr(acc.rest, F.lit(1), at))).otherwise(acc.out).alias("out"))

    return F.aggregate(steps, start, cut, lambda acc: F.array_append(acc.out, acc.rest))


def split_long(sentence: Column) -> Column:
    """The sentence, in pieces of at most MAX_CHARS."""
    pieces = F.flatten(F.transform(_rejoined(sentence), lambda p: F.when(F.length(p) > MAX_CHARS, _hard_cut(p)).otherwise(F.array(p))))
    return F.when(F.length(sentence) <= MAX_CHARS, F.array(sentence)).otherwise(F.filter(pieces, lambda p: p != ""))


def merge_short(parts: Column) -> Column:
    """Each part joins the chunk before it if either is short and both fit. Lengths alone decide; texts are put together once."""
    start = F.struct(F.lit(-1).alias("size"), F.lit(False).alias("opens"))

    def add(acc: Column, n: Column) -> Column:
        both = acc["size"] + 1 + n
        opens = (acc["size"] < 0) | ((n >= MIN_CHARS) & (acc["size"] >= MIN_CHARS)) | (both > MAX_CHARS)
        return F.struct(F.when(opens, n).otherwise(both).alias("size"), opens.alias("opens"))

    def joined(ps: Column) -> Column:
        opens = running(F.transform(ps, F.length), start, add, lambda acc: acc["opens"], "boolean")
        first = F.filter(F.transform(opens, lambda o, i: F.when(o, i + 1)), lambda i: i.isNotNull())

        def texts(at: Column) -> Column:
            ends = F.concat(F.slice(at, 2, F.size(at)), F.array(F.size(ps) + 1))
            return F.zip_with(at, F.slice(ends, 1, F.size(at)), lambda a, b: F.array_join(F.slice(ps, a, b - a), " "))

        return let(first, texts)

    return let(parts, joined)


def chunks(text: Column) -> Column:
    """Texts to speak: sentences cut to MAX_CHARS, short ones joined."""
    return merge_short(F.flatten(F.transform(sentences(text), split_long)))


def tokenize(text: Column) -> Column:
    """Words (runs other than white space) as structs of text, start and end (exclusive). A word ends where the lengths of
    all words so far, each with the white space before it, add up to."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?U){WS}*[^\s\x1c-\x1f]+"), F.lit(0))
    ends = running(F.transform(pieces, F.length), F.lit(0), lambda s, n: s + n, lambda s: s, "int")
    return F.zip_with(words(text), ends, lambda w, end: F.struct(w.alias("text"), (end - F.length(w)).alias("start"), end.alias("end")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))


def signature(text: Column) -> Column:
    """Digits and white space collapsed and lower-cased, so that 'Page 3' and 'page  4' are equal."""
    return F.lower(F.trim(F.regexp_replace(collapse(text), r"(?U)\d+", "#")))


def strip_tags(html: Column) -> Column:
    """Each tag becomes a space; white space collapses."""
    return collapse(F.regexp_replace(html, "<[^>]+>", " "))


def article_text(html: Column) -> Column:
    """An approximation of main-text extraction: scripts, styles, navigation, comments and tags go."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|nav|header|footer|head)\b.*?</\1\s*>", " ")
    return strip_tags(bare)


_BLOCK, _HEADING = "\ufdd0", "\ufdd1"
_BLOCKS = "p|div|h[1-6]|li|ul|ol|dl|dt|dd|table|tr|td|th|section|article|aside|main|nav|header|footer|form|blockquote|pre|figure|figcaption|body|html"


def main_text(html: Column, share: float = 0.1) -> Column:
    """The main text of a page. Scripts, styles, comments and what is tagged as navigation, head or foot go; of what is left
    blocks tell, whatever their tags are called.

    A page is cut at block tags. A block is worth its words outside links, less those inside, less what a block must have: a
    ``share`` of the length of the block in which a word of the page stands on average. The main text is the run of blocks with the
    largest sum (the first of equal ones), so short paragraphs between long ones stay, and notices, lists of links and
    footers at either end go, as do blocks within the run that are mostly links. Headings cost nothing. Blocks are joined by
    blank lines; a page without words gives an empty text, null stays null."""
    bare = F.translate(F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|nav|header|footer|aside|head|noscript|template)\b.*?</\1\s*>", " "), _BLOCK + _HEADING, "")
    cut = F.regexp_replace(F.regexp_replace(bare, r"(?i)<h[1-6]\b[^>]*>", _BLOCK + _HEADING), rf"(?i)</?(?:{_BLOCKS})\b[^>]*>", _BLOCK)
    size = lambda t: F.size(F.filter(F.split(t, " "), lambda w: w != ""))
    linked = lambda b: F.coalesce(F.aggregate(F.regexp_extract_all(b, F.lit(r"(?is)<a\b[^>]*>(.*?)</a\s*>"), F.lit(1)), F.lit(0), lambda n, a: n + size(strip_tags(a))), F.lit(0))

    def measured(b: Column) -> Column:
        return let(strip_tags(F.replace(b, F.lit(_HEADING), F.lit(""))), lambda t: F.struct(t.alias("text"), size(t).alias("n"), linked(b).alias("links"), F.startswith(b, F.lit(_HEADING)).alias("heading")))

    blocks = F.filter(F.transform(F.split(cut, _BLOCK), measured), lambda b: b.n > 0)

    def run(bs: Column) -> Column:
        total = F.aggregate(bs, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("squares")), lambda s, b: F.struct((s.n + b.n).alias("n"), (s.squares + b.n * b.n).alias("squares")))
        return let(total, lambda t: best(bs, F.when(t.n > 0, share * t.squares / t.n).otherwise(0.0)))

    def best(bs: Column, least: Column) -> Column:
        values = F.transform(bs, lambda b: F.when(b.heading & (b.links == 0), 0.0).otherwise(b.n - 2 * b.links - least))
        start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.lit(0).alias("since"), F.lit(float("-inf")).alias("best"), F.lit(0).alias("first"), F.lit(0).alias("last"))

        def step(s: Column, v: Column) -> Column:
            # A run with a negative sum is given up; one of zero, such as a heading, goes on.
            return let(F.struct(F.when(s["sum"] < 0, v).otherwise(s["sum"] + v).alias("sum"), F.when(s["sum"] < 0, s["at"]).otherwise(s["since"]).alias("since")), lambda new: F.struct(
                (s["at"] + 1).alias("at"), new["sum"].alias("sum"), new["since"].alias("since"), F.greatest(new["sum"], s["best"]).alias("best"),
                F.when(new["sum"] > s["best"], new["since"]).otherwise(s["first"]).alias("first"), F.when(new["sum"] > s["best"], s["at"] + 1).otherwise(s["last"]).alias("last"),
            ))

        found = F.aggregate(values, start, step)
        return let(found, lambda f: F.array_join(F.transform(F.filter(F.slice(bs, f["first"] + 1, f["last"] - f["first"]), lambda b: b.n >= 2 * b.links), lambda b: b.text), "\n\n"))

    return let(blocks, run)


def title_of(path: Column) -> Column:
    """File name without folder and last suffix."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(?<=.)\.[^.]+$", "")


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def plain_kind(text: Column) -> Column:
    """Of a block of plain text: short upper-case lines and bare page numbers are headers."""
    t = F.trim(text)
    shout = (F.length(t) < 48) & (F.length(t) > 1) & (t == F.upper(t)) & t.rlike("[A-Z]")
    return F.when(t.rlike(r"^\d{1,4}$") | shout, F.lit("header")).otherwise(F.lit("body"))


def clock(seconds: Column) -> Column:
    """m:ss"""
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("long"), F.floor(seconds % 60).cast("long"))


def counted(n: Column, noun: str) -> Column:
    """'1 passage', '2 passages'"""
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def speed_label(speed: Column) -> Column:
    """'1x', '1.25x'"""
    return F.concat(F.regexp_replace(speed.cast("string"), r"\.0$", ""), F.lit("x"))


def cut_at(words: Column, length: Column, first: Column, limit: Column, least: int = 5) -> Column:
    """Where to stop in a sentence (an index one past the last word) so that the text from word ``first`` fits into
    ``limit`` characters: after the last clause that fits, else the last word; never fewer than ``least`` words, and
    never leaving a scrap of fewer than ``least``."""
    n = F.size(words)
    base = F.coalesce(F.get(words, first).start, F.lit(0))
    fit = F.size(F.filter(words, lambda w, i: (i >= first) & (w.end - base <= limit)))
    fits = F.greatest(first + fit, F.least(first + least, n))
    ends = F.filter(F.transform(words, lambda w, i: F.when(w.text.rlike(r"""[,;:—–]["')\]]?$""") & (i + 1 - first >= least) & (i < fits), i + 1)), lambda i: i.isNotNull())
    end = F.coalesce(F.array_max(ends), fits)
    scrap = F.least(n, F.greatest(first + least, n - least))
    return F.when(length - base <= limit, n).when(n - end >= least, end).otherwise(scrap)
