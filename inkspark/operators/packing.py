"""Sentences to clips, and reading ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.functions import text as T
from inkspark.functions.core import running
from inkspark.operators.scan import ROWS, Ranges, positions
from inkspark.sources.scratch import kept

LOOKAHEAD, LIMIT = 15, 480
#: A sentence: id, kind, text.
ITEM = "struct<id:bigint,kind:string,text:string>"


def packed(items: Column, limit: Column | int = LIMIT, size=lambda x: F.length(x.text)) -> Column:
    """How many of ``items`` (kind, and what ``size`` measures) to speak as one clip: the first, whatever its length, and those
    that follow with its kind while their length with single spaces is within the limit."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("size"), F.lit(True).alias("open"))

    def add(acc: Column, x: Column) -> Column:
        upto = acc["size"] + 1 + size(x)
        taken = acc["open"] & ((acc["n"] == 0) | ((x.kind == F.get(items, F.lit(0)).kind) & (upto <= limit)))
        return F.struct((acc["n"] + taken.cast("int")).alias("n"), F.when(taken, upto).otherwise(acc["size"]).alias("size"), taken.alias("open"))

    return F.aggregate(items, start, add, lambda acc: acc["n"])


def _with_ahead(sentences: DataFrame, rows: int, block: int = 256) -> DataFrame:
    """Sentences (doc_id, sent_id, text), each with itself and the LOOKAHEAD after it in ``items``."""
    blocks = blocks_ahead(sentences, ["kind", "text"], block, rows)
    own = F.sequence(F.lit(0), F.least(F.size("items"), F.lit(block)) - 1)
    one = lambda i: F.struct(F.get("items", i).sent_id.alias("sent_id"), F.get("items", i).text.alias("text"), F.slice("items", i + 1, 1 + LOOKAHEAD).alias("items"))
    return blocks.select("doc_id", F.inline(F.transform(own, one)))


def packs_from_every_start(sentences: DataFrame, limit: int = LIMIT, rows: int = ROWS) -> DataFrame:
    """For each sentence (doc_id, sent_id, kind, text) the clip that starts there: ids, text, and words of each part."""
    items = _with_ahead(sentences, rows).withColumn("taken", F.slice("items", 1, packed(F.col("items"), limit)))
    return items.select(
        "doc_id", "sent_id", F.transform("taken", lambda x: x.sent_id).alias("ids"), F.array_join(F.transform("taken", lambda x: x.text), " ").alias("text"),
        F.transform("taken", lambda x: F.size(F.regexp_extract_all(x.text, F.lit(r"\S+"), F.lit(0))).cast("long")).alias("part_words"),
    )


def packs_with_split(sentences: DataFrame, limit: int, allow_split: bool = True, rows: int = ROWS) -> DataFrame:
    """As packs_from_every_start(), with a first sentence longer than the limit cut where breath is drawn:
    ids, text, n_words, through (last sentence) and thru_word (where to go on in it; 0 means that it is finished)."""
    ahead = _with_ahead(sentences, rows).withColumn("words", T.tokenize(F.col("text")))
    ahead = ahead.withColumn("stop", T.cut_at(F.col("words"), F.length("text"), F.lit(0), F.lit(limit)) if allow_split else F.size("words"))
    ahead = ahead.withColumn("part", F.col("stop") < F.size("words")).withColumn("taken", F.slice("items", 1, packed(F.col("items"), limit)))
    from_word, to_word = F.get("words", F.lit(0)).start, F.get("words", F.col("stop") - 1).end
    return ahead.select(
        "doc_id", "sent_id", F.when(F.col("part"), F.array(F.col("sent_id"))).otherwise(F.transform("taken", lambda x: x.sent_id)).alias("ids"),
        F.when(F.col("part"), F.substr("text", from_word + 1, to_word - from_word)).otherwise(F.array_join(F.transform("taken", lambda x: x.text), " ")).alias("text"),
        F.when(F.col("part"), F.col("sent_id")).otherwise(F.element_at(F.transform("taken", lambda x: x.sent_id), -1)).alias("through"),
        F.when(F.col("part"), F.col("stop")).otherwise(0).alias("thru_word"),
    )


def greedy_clip_numbers(items: Column, limit: int = LIMIT) -> Column:
    """For each of a document's sentences in order, the number of its clip: clips follow each other, each as packed().
    Look-ahead is bounded, so a clip has 1 + LOOKAHEAD sentences at most."""
    start = F.struct(F.lit(-1).alias("clip"), F.lit("").alias("kind"), F.lit(0).alias("size"), F.lit(0).alias("n"))

    def add(acc: Column, x: Column) -> Column:
        size = acc["size"] + 1 + F.length(x.text)
        joins = (acc["clip"] >= 0) & (x.kind == acc["kind"]) & (size <= limit) & (acc["n"] <= LOOKAHEAD)
        return F.struct(
            F.when(joins, acc["clip"]).otherwise(acc["clip"] + 1).alias("clip"), x.kind.alias("kind"),
            F.when(joins, size).otherwise(F.length(x.text)).alias("size"), F.when(joins, acc["n"] + 1).otherwise(1).alias("n"),
        )

    return running(items, start, add, lambda acc: acc["clip"], "int")


#: Sentences of a block, and blocks whose maps are composed at a time.
BLOCK, FAN = 1024, 256
_MAP = "array<struct<exit:int,clips:bigint>>"


def blocks_ahead(sentences: DataFrame, fields: list[str], block: int = BLOCK, rows: int = ROWS) -> DataFrame:
    """(doc_id, b, items): each document's sentences in blocks of ``block``, each with the LOOKAHEAD sentences after it; an item
    has pos (in the document, from 0), sent_id and ``fields``."""
    placed = positions(sentences.select("doc_id", F.col("sent_id").cast("long").alias("sent_id"), *fields), "doc_id", "sent_id", rows)
    b = F.floor(F.col("pos") / block)
    also = F.when((b > 0) & (F.col("pos") % block < LOOKAHEAD), F.array(b, b - 1)).otherwise(F.array(b))
    copies = placed.withColumn("b", F.explode(also))
    return copies.groupBy("doc_id", "b").agg(F.array_sort(F.collect_list(F.struct("pos", "sent_id", *fields))).alias("items"))


def _block_map(after: Column) -> Column:
    """For each of the first 1 + LOOKAHEAD places of a block: how far into the next block the walk from there ends up, and how
    many clips it begins. ``after`` has the place where the clip from each place ends. Folded from the last place to the first; the
    state has the answers of the 1 + LOOKAHEAD places behind."""
    beyond = F.transform(F.sequence(F.lit(0), F.lit(LOOKAHEAD)), lambda e: F.struct(e.alias("exit"), F.lit(0).cast("long").alias("clips")))
    indexed = F.reverse(F.transform(after, lambda n, i: F.struct(i.alias("at"), n.alias("to"))))

    def add(acc: Column, x: Column) -> Column:
        to = F.get(acc, x["to"] - x["at"] - 1)
        return F.concat(F.array(F.struct(to["exit"].alias("exit"), (to["clips"] + 1).alias("clips"))), F.slice(acc, 1, LOOKAHEAD))

    return F.aggregate(indexed, beyond, add)


def _follow(state: Column, one: Column) -> Column:
    to = F.get(one, state["exit"])
    return F.struct(to["exit"].alias("exit"), (state["clips"] + to["clips"]).alias("clips"))


def _entries(maps: DataFrame, fan: int) -> DataFrame:
    """(doc_id, b, exit, clips): where the walk from the document's start comes into each block, and how many clips it began
    before. Maps of ``fan`` blocks are composed to one, and so on until a document has one; the entries come down the same way."""
    group = maps.groupBy("doc_id", F.floor(F.col("b") / fan).alias("up")).agg(F.array_sort(F.collect_list(F.struct("b", "map"))).alias("maps"))
    group = kept(group)
    most = group.agg(F.max("up")).first()[0] or 0
    identity = F.transform(F.sequence(F.lit(0), F.lit(LOOKAHEAD)), lambda e: F.struct(e.alias("exit"), F.lit(0).cast("long").alias("clips")))
    if most:
        composed = F.aggregate("maps", identity, lambda acc, m: F.transform(acc, lambda s: _follow(s, m.map)))
        came = _entries(kept(group.select("doc_id", F.col("up").alias("b"), composed.alias("map"))), fan)
        group = group.join(came.withColumnRenamed("b", "up"), ["doc_id", "up"])
    else:
        group = group.withColumns({"exit": F.lit(0), "clips": F.lit(0).cast("long")})
    start = F.struct(F.struct("exit", "clips").alias("now"), F.struct("exit", "clips").alias("next"))
    step = lambda s, m: F.struct(s["next"].alias("now"), _follow(s["next"], m.map).alias("next"))
    into = running(F.col("maps"), start, step, lambda s: s["now"], "struct<exit:int,clips:bigint>")
    return group.select("doc_id", F.inline(F.transform(F.arrays_zip(F.col("maps").alias("m"), into.alias("e")), lambda x: F.struct(x.m.b.alias("b"), x.e.exit.alias("exit"), x.e.clips.alias("clips")))))


def greedy_clips(sentences: DataFrame, limit: int = LIMIT, block: int = BLOCK, fan: int = FAN, rows: int = ROWS) -> DataFrame:
    """(doc_id, clip, first_sent, n_sents, n_chars) of each document's clips, which follow each other, each as packed(). Look-ahead
    is bounded, so a clip has 1 + LOOKAHEAD sentences at most.

    Where a clip ends depends on where it begins alone, so a block of sentences is a map from the few places where a walk can
    come in to where it leaves. Maps are composed in levels; no document is one row or one task."""
    if block <= LOOKAHEAD:
        raise ValueError("a block has more sentences than a clip looks ahead")
    lengths = sentences.select("doc_id", "sent_id", "kind", F.length("text").alias("len"))
    blocks = blocks_ahead(lengths, ["kind", "len"], block, rows)
    own = F.least(F.size("items"), F.lit(block))
    after = F.transform(F.sequence(F.lit(0), own - 1), lambda i: i + packed(F.slice("items", i + 1, 1 + LOOKAHEAD), limit, lambda x: x.len))
    blocks = kept(blocks.select("doc_id", "b", "items", after.alias("after")))
    alone = (F.col("b") == 0) & (F.size("items") <= block)
    placed = blocks.where(alone).withColumns({"exit": F.lit(0), "clips": F.lit(0).cast("long")})
    longer = blocks.where(~alone)
    if longer.limit(1).count():
        maps = kept(longer.select("doc_id", "b", _block_map(F.col("after")).alias("map")))
        placed = placed.unionByName(longer.join(_entries(maps, fan), ["doc_id", "b"]))

    start = F.struct(F.col("exit").alias("at"), (F.col("clips") - 1).alias("clip"), F.lit(False).alias("began"))

    def step(s: Column, x: Column) -> Column:
        here = x["at"] == s["at"]
        return F.struct(F.when(here, x["to"]).otherwise(s["at"]).alias("at"), (s["clip"] + here.cast("long")).alias("clip"), here.alias("began"))

    numbers = running(F.transform("after", lambda n, i: F.struct(i.alias("at"), n.alias("to"))), start, step, lambda s: F.when(s["began"], s["clip"]), "bigint")

    def clip(number: Column, i: Column) -> Column:
        n = F.get("after", i) - i
        chars = F.aggregate(F.slice("items", i + 1, n), F.lit(-1).cast("long"), lambda acc, x: acc + 1 + x.len)
        return F.struct(number.alias("clip"), F.get("items", i).sent_id.alias("first_sent"), F.when(number.isNotNull(), n).cast("long").alias("n_sents"), F.when(number.isNotNull(), chars).alias("n_chars"))

    return placed.select("doc_id", F.inline(F.filter(F.transform(numbers, clip), lambda c: c.clip.isNotNull())))


def part_starts(parts: DataFrame, rows: int = ROWS) -> DataFrame:
    """Parts (clip, part, words) with the index of their first word in the clip, and the next part's."""
    return Ranges(parts, "clip", "part", rows).scan(sums={"upto": F.col("words")}).rows().withColumn("start", F.col("upto") - F.col("words"))


def locate(words: DataFrame, parts: DataFrame, rows: int = ROWS) -> DataFrame:
    """Word indexes (clip, idx) to (part, word); past the end it is the last word. Parts and indexes are merged in one order of
    word numbers and scanned, so neither a clip's parts nor its lookups are compared in pairs or held by one task. Indexes of clips without
    a word are left out."""
    placed = part_starts(parts.where("words > 0"), rows)
    begin = F.struct("part", "start", F.col("upto").alias("end"))
    events = placed.select("clip", F.col("start").alias("at"), F.lit(0).alias("asked"), F.lit(None).cast(words.schema["idx"].dataType).alias("idx"), begin.alias("place"))
    events = events.unionByName(words.select("clip", F.greatest(F.col("idx"), F.lit(0)).cast("long").alias("at"), F.lit(1).alias("asked"), "idx", F.lit(None).cast(events.schema["place"].dataType).alias("place")))
    found = Ranges(events.where("clip is not null"), "clip", ["at", "asked"], rows).scan(lasts={"last": F.col("place")}).rows().where("asked = 1 AND last is not null")
    return found.select("clip", "idx", "last.part", (F.least("at", F.col("last.end") - 1) - F.col("last.start")).alias("word"))


def ahead_plan(lengths: Column, chars_per_second: Column, speed: Column, in_hand: Column, horizon: float = 30.0, most: int = 8) -> Column:
    """How many of the clips to come (their lengths in characters) to make now: until ``horizon`` seconds of listening are
    in hand, and ``most`` at most. Returns a struct of clips and bank (seconds of speech)."""
    start = F.struct(F.lit(0).alias("clips"), in_hand.cast("double").alias("bank"))

    def add(acc: Column, n: Column) -> Column:
        more = (acc["clips"] < most) & (acc["bank"] / speed < horizon)
        return F.struct((acc["clips"] + more.cast("int")).alias("clips"), (acc["bank"] + F.when(more, n / chars_per_second).otherwise(0.0)).alias("bank"))

    return F.aggregate(lengths, start, add)


def opening_plan(lengths: Column, chars_per_second: Column, speed: Column) -> Column:
    """The clips to make before play is pressed: the first, and up to 9 more until 26 seconds of speech are in hand
    (as many times more at higher speed). Returns a struct of clips and bank."""
    start = F.struct(F.lit(0).alias("clips"), F.lit(0.0).alias("bank"))

    def add(acc: Column, n: Column) -> Column:
        more = (acc["clips"] < 10) & ((acc["clips"] == 0) | (acc["bank"] < 26 * F.greatest(F.lit(1.0), speed)))
        return F.struct((acc["clips"] + more.cast("int")).alias("clips"), (acc["bank"] + F.when(more, n / chars_per_second).otherwise(0.0)).alias("bank"))

    return F.aggregate(lengths, start, add)


def banked(links: DataFrame, starts: DataFrame, speed: float = 1.0) -> DataFrame:
    """Seconds of listening made for each start (who, at): the durations along ``links`` (who, pos, duration, next), each link
    once; a chain ends where its next position has no link or was counted before. (who, banked)

    Positions that chains go through are found by doubling: round k joins where 2**k steps lead with itself, so a chain of n
    links takes log2(n) rounds of one equality join, and no chain is held in a row. A cycle's links are reached again and
    again, so they are kept once."""
    nexts = links.select("who", F.col("pos").alias("from"), F.col("next").alias("to"))
    jump = nexts.join(nexts.select("who", F.col("from").alias("to")), ["who", "to"], "left_semi").select("who", "from", "to")
    reached, count = starts.select("who", "at", F.col("at").alias("pos")).distinct(), -1
    while (now := reached.count()) != count:
        count = now
        further = reached.withColumnRenamed("pos", "from").join(jump, ["who", "from"]).select("who", "at", F.col("to").alias("pos"))
        further = reached.unionByName(further).distinct()
        twice = jump.join(jump.select("who", F.col("from").alias("to"), F.col("to").alias("far")), ["who", "to"]).select("who", "from", F.col("far").alias("to"))
        reached, jump = kept(further, reached), kept(twice, jump)
    made = reached.join(links.select("who", "pos", "duration"), ["who", "pos"]).groupBy("who", "at").agg(F.sum("duration").alias("made"))
    return starts.join(made, ["who", "at"], "left").select("who", (F.coalesce("made", F.lit(0.0)) / float(speed)).alias("banked"))
