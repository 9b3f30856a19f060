"""SimHash near-dedup with deletion-variant signatures (operator 6).

Fingerprints have 64 bits. Texts are lower-cased in A-Z and cut at the six ASCII blanks into words; the XXH64 values
(seed 42) of all word shingles, repeats included, vote on each bit. Two fingerprints are linked when at most
``bits`` of them differ (3). Texts with no word have fingerprint 0 and are linked like others; null counts as empty.

Candidates: with 64 bits in ``bits // 2 + 1`` segments, one segment of a linked pair differs by one bit at most. So for
each segment and each of its bits a key is made of the segment without that bit; a linked pair has a key in common
(equality join, on distinct fingerprints only), and each pair that meets is verified. A key with over RUN fingerprints
is split again by the same rule over the bits that the key leaves open, level by level, until the keys hold so many
bits that a run is small by construction. Runs give the links of a spanning forest instead of all pairs, and lose no
connection. Copies are one fingerprint and never paired.

Repeated rows each give a row, an empty table none. Only the named columns are read; drop_near_duplicates() keeps all,
whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspark.functions.core import let

from .components import connected_components
from .shared import SALTS, has_rows, join_checked, join_counted, join_wide, materialize

SEED = 42
#: Fingerprints under one key that one task compares; keys with more are split. Splitting makes some 50 rows of each
#: fingerprint, so up to this size comparing costs less, even where no two are near.
RUN = 16_384
#: Runs up to this size are compared many at a time.
SHORT = 64
#: Documents of each component that a round of verification settles: in the first one, and at most.
LEADERS, MOST_LEADERS = 8, 1024
#: Shingles of all leaders of a component in one round; a component's first document counts whatever its length.
MOST_SHINGLES = 1 << 21
#: Independent fingerprints of each document where candidates are verified afterwards. One alone parts about half of the
#: pairs at a similarity of 0.8 in texts of 1,000 words, four together one in fourteen.
TABLES = 4
_BLOCK = 100_000


def _mixed(hashes: np.ndarray, table: int) -> np.ndarray:
    """The hashes for a table: as they are for the first, else the output step of SplitMix64 on them, for independent votes."""
    if not table:
        return hashes
    with np.errstate(over="ignore"):
        z = hashes + np.uint64(table * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def signatures(text: str | None, words_in_shingle: int = 3, tables: int = 1) -> list[int]:
    """A text's fingerprint in each table; all are 0 for a text with no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII blanks alone
    if not words:
        return [0] * tables
    n, joined = min(words_in_shingle, len(words)), b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends, hash_of = starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), xxhash.xxh64_intdigest
    votes = np.zeros((tables, 64), np.int64)
    for i in range(0, len(starts), _BLOCK):
        part = np.array([hash_of(joined[s:e], SEED) for s, e in zip(starts[i : i + _BLOCK], ends[i : i + _BLOCK])], "<u8")
        for t in range(tables):
            bits = np.unpackbits(_mixed(part, t).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            # 255 rows of bytes add up within 8-byte lanes without a carry
            lanes = np.add.reduceat(bits.view(np.uint64), np.arange(0, len(bits), 255), axis=0)
            votes[t] += lanes.view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return np.packbits(votes * 2 > len(starts), axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def fingerprint(text: str | None, words_in_shingle: int = 3) -> int:
    return signatures(text, words_in_shingle)[0]


def shingle_set(text: str | None, words_in_shingle: int) -> np.ndarray:
    """The XXH64 values of a text's distinct word shingles, as sorted signed integers."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = min(words_in_shingle, len(words))
    found = {xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), SEED) for i in range(len(words) - n + 1)} if n else set()
    return np.sort(np.fromiter(found, np.uint64, len(found)).view(np.int64))


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words_in_shingle: int = 3, tables: int = 1) -> DataFrame:
    """(id, version, fps): the fingerprint in each table as a signed 64-bit integer; version tells texts with one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([signatures(t, words_in_shingle, tables) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64).reshape(-1)
            fps = pa.ListArray.from_arrays(pa.array(np.arange(0, len(found) + 1, tables, dtype=np.int32)), pa.array(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], names=["id", "version", "fps"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, version long, fps array<long>")


def _segments(width: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``parts`` segments of the lowest ``width`` bits."""
    edges = [width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _variants(rows: DataFrame, segments: list[tuple[int, int]]) -> DataFrame:
    """``rows`` (key, fp, rest) with a further key for each segment of rest and each of its bits left out; bit says which."""
    picks = [(bit, (((1 << width) - 1) << first) & ~(1 << bit)) for first, width in segments for bit in range(first, first + width)]
    signed = [F.struct(F.lit(b).alias("bit"), F.lit(m - (m >> 63 << 64)).alias("mask")) for b, m in picks]
    made = rows.select("*", F.explode(F.array(*signed)).alias("x"))
    return made.select(F.xxhash64("key", "x.bit", F.col("rest").bitwiseAND(F.col("x.mask"))).alias("key"), "fp", "rest", "x.bit")


def _short_runs(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the fingerprints that share a key and differ in at most ``bits``, for many short runs."""
    one, two, d, at = [], [], 1, np.arange(len(fp))
    while True:
        at = at[at + d < len(fp)]
        at = at[key[at] == key[at + d]]
        if not len(at):
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= bits]
        one.append(near)
        two.append(near + d)
        d += 1
    if not sum(map(len, one)):
        return fp[:0], fp[:0]
    i, j, label = np.concatenate(one), np.concatenate(two), np.arange(len(fp))
    while True:
        before = label.copy()
        np.minimum.at(label, j, label[i])
        np.minimum.at(label, i, label[j])
        label = label[label]
        if (before == label).all():
            break
    moved = np.flatnonzero(label != np.arange(len(label)))
    return fp[label[moved]], fp[moved]


def _long_run(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for one run, breadth first: what is reached is not compared again, so a group of near copies costs little
    more than its size."""
    left, roots, reached = np.arange(len(fp)), [], []
    while len(left):
        root, left = left[0], left[1:]
        front = np.array([root])
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for i in range(0, len(front), 256):
                rest = np.flatnonzero(~near)
                near[rest] = (np.bitwise_count(fp[front[i : i + 256], None] ^ fp[left[rest]]) <= bits).any(0)
            front, left = left[near], left[~near]
            roots.append(np.full(len(front), root))
            reached.append(front)
    if not roots:
        return fp[:0], fp[:0]
    return fp[np.concatenate(roots)], fp[np.concatenate(reached)]


def _runs(bits: int, limit: int | None, segments: list[tuple[int, int]]):
    """Of rows sorted by key: links (a, b) that connect each run. Of runs over the limit: key, fp and what the key leaves open."""
    first, width = (np.array([s[i] for s in segments for _ in range(s[1])], np.uint64) for i in (0, 1))
    none = np.zeros(0, np.uint64)

    def out(key, a, b, rest, big: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (key, a, b, rest)), pa.array(np.full(len(a), big))], names=["key", "a", "b", "rest", "big"])

    def overfull(rows) -> pa.RecordBatch:
        key, fp, rest, bit = rows
        low, after = first[bit], first[bit] + width[bit]
        above = np.where(after < 64, rest >> np.minimum(after, np.uint64(63)), np.uint64(0))
        return out(key, fp, fp, (rest & ((np.uint64(1) << low) - np.uint64(1))) | (above << low), True)

    def close(rows) -> Iterator[pa.RecordBatch]:
        key = rows[0]
        if not len(key):
            return
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(edge, len(key)))
        size = np.repeat(size, size)
        if limit is not None and (size > limit).any():
            yield overfull([x[size > limit] for x in rows])
        short = (size > 1) & (size <= SHORT)
        a, b = _short_runs(rows[0][short], rows[1][short], bits)
        yield out(a, a, b, b, False)
        for i in edge[(size[edge] > SHORT) & (size[edge] <= (limit or len(key)))]:
            a, b = _long_run(rows[1][i : i + size[i]], bits)
            yield out(a, a, b, b, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, flowing = [none, none, none, np.zeros(0, np.int64)], None
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]
            new = [*(x.view(np.uint64) for x in new[:3]), new[3]]
            if flowing is not None:  # a run over the limit goes on: its rows pass through
                same = new[0] == flowing
                yield overfull([x[same] for x in new])
                if same.all():
                    continue
                new, flowing = [x[~same] for x in new], None
            held = [np.concatenate(x) for x in zip(held, new)]
            last = int(np.argmax(held[0] == held[0][-1])) if len(held[0]) else 0  # the last run may go on
            yield from close([x[:last] for x in held])
            held = [x[last:] for x in held]
            if limit is not None and len(held[0]) > limit:
                flowing = held[0][0]
                yield overfull(held)
                held = [x[:0] for x in held]
        yield from close(held)

    return run


def near_links(distinct: DataFrame, bits: int = 3, run: int = RUN) -> DataFrame:
    """Links (a, b) that connect all fingerprints of ``distinct`` (fp) that are within ``bits`` of each other; where it has a
    column table too, those of one table alone."""
    parts, width, links = bits // 2 + 1, 64, None
    key = F.col("table") if "table" in distinct.columns else F.lit(0)
    rows = distinct.select(key.cast("long").alias("key"), "fp", F.col("fp").alias("rest"))
    while True:
        segments, last = _segments(width, parts), width <= 16  # by then the keys hold so many bits that runs are small
        keyed = _variants(rows, segments).repartition("key").sortWithinPartitions("key", "fp")
        met = materialize(keyed.mapInArrow(_runs(bits, None if last else run, segments), "key long, a long, b long, rest long, big boolean"))
        found = met.where("NOT big").select("a", "b")  # a spanning forest of each run
        links = found if links is None else links.unionByName(found)
        rows, width = met.where("big").select("key", F.col("a").alias("fp"), "rest"), width - min(w for _, w in segments)
        if last or not has_rows(rows):
            return links


def _components(docs: DataFrame, text_col: str, id_col: str, words_in_shingle: int, bits: int) -> DataFrame:
    """(id, version, fp, component_id) of each document."""
    rows = materialize(fingerprints(docs, text_col, id_col, words_in_shingle).select("id", "version", F.get("fps", F.lit(0)).alias("fp")))
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = connected_components(near_links(classes.select("fp"), bits))
    rooted = materialize(classes.join(roots.hint("merge"), classes.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), classes)
    names = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("classes")))
    named = materialize(join_counted(rooted, names, "root", "classes").select("fp", "component_id", "n"), rooted, names)
    return join_counted(rows, named, "fp", "n")  # few distinct fingerprints may hold most rows


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words_in_shingle: int = 3, bits: int = 3) -> DataFrame:
    """One row for each document: id, fingerprint (16 hex digits), component_id (smallest id that links reach).
    A null id takes part in links; its component is named by the others' ids, or null where there are none."""
    named = _components(docs, text_col, id_col, words_in_shingle, bits)
    return named.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _candidates(docs: DataFrame, text_col: str, id_col: str, bits: int, tables: int) -> DataFrame:
    """(id, version, component_id) of the documents that fingerprints in any of the tables link with others, repeated rows once."""
    rows = materialize(fingerprints(docs.where(F.col(id_col).isNotNull()), text_col, id_col, 3, tables))
    each = rows.select("id", "version", F.posexplode("fps").alias("table", "fp"))
    classes = materialize(each.groupBy("table", "fp").agg(F.count(F.lit(1)).alias("n")))
    roots = connected_components(near_links(classes.select("table", "fp"), bits))
    rooted = materialize(classes.join(roots.hint("merge"), classes.fp == roots.node, "left").select("table", "fp", "n", F.coalesce("root", "fp").alias("root")), classes)
    sizes = rooted.groupBy("table", "root").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")).where("rows > 1").drop("rows")
    sizes = materialize(sizes)
    shared = materialize(join_counted(rooted, sizes, ["table", "root"], "classes").select("table", "fp", "root", "n"), rooted, sizes)
    # a document has a root for each table at most
    found = join_counted(each, shared, ["table", "fp"], "n").groupBy("id", "version").agg(F.min("root").alias("node"), F.collect_set("root").alias("roots"))
    found = materialize(found, rows, shared)
    across = connected_components(found.select(F.col("node").alias("a"), F.explode("roots").alias("b")).where("a <> b"))
    joined = join_checked(found.select("id", "version", "node"), across, "node", "left", F.xxhash64("id", "version"))
    return joined.select("id", "version", F.coalesce("root", "node").alias("component_id"))


def verified_duplicates(docs: DataFrame, text_col: str, id_col: str, bits: int, shingle: int, least: float, tables: int = TABLES) -> DataFrame:
    """(id, version, keep_id) of the documents that have a near copy with a smaller id which stays.

    Components of fingerprints within ``bits``, in any of ``tables`` independent tables, are candidates. In each, documents are
    judged in the order of their ids: one goes if an earlier one that stays has a Jaccard similarity of ``least`` or more to its
    set of ``shingle``-word shingles. A round settles the first LEADERS documents of each component among themselves and compares
    the others with those of them that stay; rounds go on, with more leaders each, until no component has two left. So no pairs
    are made within a group, and nothing goes unless a document that stays is that similar."""
    kind = dict(docs.dtypes)[id_col]
    found = materialize(_candidates(docs, text_col, id_col, bits, tables))
    several = materialize(found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = materialize(join_counted(found, several, "component_id", "n"), found, several)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([shingle_set(t, shingle) for t in batch.column(3).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], made], names=["id", "version", "component_id", "grams"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            staying, going = [], []
            for leaders in batch.column(1).to_pylist():
                stay, gone = [], []
                for x in leaders:
                    x["set"], x["head"] = frozenset(x["grams"]), frozenset(x["grams"][: len(x["grams"]) - math.ceil(least * len(x["grams"]) - 1e-9) + 1])
                    like = next((y for y in stay if not x["head"].isdisjoint(y["head"]) and (n := len(x["set"] & y["set"])) >= least * (len(x["set"]) + len(y["set"]) - n)), None)
                    stay.append(x) if like is None else gone.append({"id": x["id"], "version": x["version"], "keep_id": like["id"]})
                staying.append([{k: x[k] for k in ("id", "version", "grams")} for x in stay])
                going.append(gone)
            kinds = [batch.schema.field(1).type, pa.list_(pa.struct([("id", batch.schema.field(0).type), ("version", pa.int64()), ("keep_id", batch.schema.field(0).type)]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(staying, kinds[0]), pa.array(going, kinds[1]), batch.column(2)], names=["component_id", "n", "staying", "going", "last"])

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    left = join_checked(texts, members, ["id", "version"], "inner", F.col("version")).select("id", "version", "component_id", "text")
    left = materialize(left.dropDuplicates(["id", "version"]).mapInArrow(sets, f"id {kind}, version long, component_id long, grams array<long>"), members)
    gone, leaders = docs.sparkSession.createDataFrame([], f"id {kind}, version long, keep_id {kind}"), LEADERS
    salt = F.pmod(F.xxhash64("id", "version"), F.lit(SALTS))
    one = f"struct<id:{kind},version:bigint,grams:array<bigint>>"
    while has_rows(several := materialize(left.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))):
        first = join_counted(left, several, "component_id", "n")
        # Of a component's first documents each salt gives a few. They are all there up to the first one that a salt did not give
        each = 2 * leaders // SALTS + 2
        of_salt, whole = Window.partitionBy("component_id", "salt").orderBy("id", "version"), Window.partitionBy("component_id")
        first = first.withColumn("salt", salt).withColumn("turn", F.row_number().over(of_salt)).where(F.col("turn") <= each)
        first = first.withColumn("cut", F.min(F.when(F.col("turn") == each, F.struct("id", "version"))).over(whole)).where("cut IS NULL OR struct(id, version) < cut")
        order = whole.orderBy("id", "version")
        first = first.withColumn("rank", F.row_number().over(order)).withColumn("sum", F.sum(F.size("grams")).over(order))
        first = first.where((F.col("rank") == 1) | ((F.col("rank") <= leaders) & (F.col("sum") <= MOST_SHINGLES)))
        heads = first.groupBy("component_id", "n").agg(F.sort_array(F.collect_list(F.struct("id", "version", "grams"))).alias("leaders"), F.max(F.struct("id", "version")).alias("last"))
        schema = f"component_id long, n long, staying array<{one}>, going array<struct<id:{kind},version:bigint,keep_id:{kind}>>, last struct<id:{kind},version:bigint>"
        heads = materialize(heads.select("component_id", "leaders", "last", "n").mapInArrow(settle, schema))
        gone = gone.unionByName(heads.select(F.explode("going").alias("g")).select("g.*"))
        size = F.aggregate("staying", F.lit(128).cast("long"), lambda a, x: a + 64 + 8 * F.size(x.grams))
        met = join_wide(left, heads.drop("going"), "component_id", "n", size, F.col("version"))
        others = met.where(F.struct("id", "version") > F.col("last"))
        # sets that are as similar share a shingle in these first parts of their sorted lists, so few are intersected
        head = lambda x: F.slice(x, 1, F.size(x) - F.ceil(F.lit(least) * F.size(x) - 1e-9).cast("int") + 1)
        enough = lambda y: let(F.size(F.array_intersect("grams", y.grams)), lambda n: n >= F.lit(least) * (F.size("grams") + F.size(y.grams) - n))
        like = let(head(F.col("grams")), lambda own: F.filter("staying", lambda y: F.arrays_overlap(own, head(y.grams)) & enough(y)))
        judged = materialize(others.select("id", "version", "component_id", "grams", F.get(like, F.lit(0)).id.alias("keep_id")), left, several)
        gone = gone.unionByName(judged.where("keep_id IS NOT NULL").select("id", "version", "keep_id"))
        left, leaders = judged.where("keep_id IS NULL").drop("keep_id"), min(MOST_LEADERS, 2 * leaders)
    return materialize(gone)


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", bits: int = 7, shingle: int = 5, least: float = 0.8, tables: int = TABLES) -> DataFrame:
    """``docs`` without those that verified_duplicates() finds; rows with a null id always stay."""
    gone = verified_duplicates(docs, text_col, id_col, bits, shingle, least, tables)
    gone = materialize(gone.select(F.col("id").alias("__id"), F.col("version").alias("__version"), F.lit(True).alias("__gone")).dropDuplicates(["__id", "__version"]))
    keyed = docs.withColumn("__id", F.col(id_col)).withColumn("__version", F.xxhash64(text_col))
    return join_checked(keyed, gone, ["__id", "__version"], "left", F.col("__version")).where("__gone IS NULL").select(*docs.columns)
