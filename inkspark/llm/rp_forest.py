"""Embedding near-dedup with a forest of random-projection trees (operator 7).

Vectors that are equal are one class and are never paired. Each class's vector stays in one row, with the list of its cells
in TREES trees; only these lists change while the forest grows. A cell of more than LEAF vectors is split by up to DEPTH
random directions, one for each level, at thresholds for each node that are medians of a sample of the cell (SAMPLE vectors
for each part that is to come; every vector is indexed). A vector within the spill of a threshold goes to both sides: a pair
at the least similarity is parted only if its projections differ by more than twice the spill, on opposite sides, and then
another tree finds it. A cell of which splitting would make more copies than comparing it in blocks of BLOCK (very many
vectors within the spill of each other) is compared in blocks, exactly; how splitting would grow is carried on from what
the sample's split holds. With ``trees=0`` all vectors of a length are one such cell: the exact way, for any table.

Only then do vectors meet, once for each cell. A cell compares its vectors by cosine in double precision (single
precision decides first where its error bound allows). A pair that shares several cells belongs to the first of them by
number; the cell counts its own pairs' links and gives each vector's count and a spanning forest of its own pairs. So
results are as many rows as vectors in cells, and no pair is ever shuffled. Found links are all true.

Vectors that are null, zero, or have null or non-finite components link with nothing; nor do vectors of different lengths.
A null id counts in others' links; its component is named by the others' ids, or null where there are none, and then it is kept.
Repeated rows are copies, each with a row; an empty table gives none. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import drop, join_counted, materialize

TREES, LEAF, DEPTH, SAMPLE, BLOCK = 5, 2048, 8, 32, 4096
#: Half of this times the standard deviation of a linked pair's projected difference is the spill.
SPILL = 0.9
#: Thresholds that one round of splitting holds in memory; a level with more is split in several rounds.
THRESHOLDS = 1 << 22


def _directions(cell: int, depth: int, dim: int) -> np.ndarray:
    """One direction for each level, at right angles while the dimensions allow it."""
    found = np.random.default_rng(cell).standard_normal((dim, depth))
    return np.linalg.qr(found)[0].T if depth <= dim else (found / np.linalg.norm(found, axis=0)).T


def _spill(least: float, dim: int) -> float:
    return SPILL / 2 * np.sqrt(2 - 2 * least) / np.sqrt(dim)


def _descend(projected: np.ndarray, thresholds: np.ndarray, spill: float) -> list[tuple[np.ndarray, int]]:
    """(rows, leaf number) of each leaf of a split; rows may be in several."""
    cells = [(np.arange(len(projected)), 0)]
    for level in range(projected.shape[1]):
        cells = [
            (rows[side], child)
            for rows, node in cells
            for at in (projected[rows, level] - thresholds[node],)
            for side, child in ((at <= spill, 2 * node + 1), (at > -spill, 2 * node + 2))
        ]
    return cells


def _copies(rows: int, growth: float, depth: int, leaf: int) -> float:
    """Copies of each row when a cell of ``rows`` rows is down to ``leaf``, if ``depth`` levels hold ``growth`` times the rows and others do alike."""
    level = max(1.0, growth) ** (1 / depth)
    return np.inf if level >= 1.99 else level ** (np.log(rows / leaf) / np.log(2 / level))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; very large and very small components are brought to a safe range first."""
    x = x.astype(np.float64)
    top = np.abs(x).max(1, keepdims=True)
    x = np.where((top > 1e100) | (top < 1e-100), x / top, x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _fit(least: float, leaf: int, block: int):
    """Of a cell's sample: the thresholds of its split, or none and how many blocks to compare it in."""

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cell, depth, size = key
        x = _unit(np.stack(rows["vec"].to_numpy()))
        projected, thresholds = x @ _directions(cell, depth, x.shape[1]).T, np.zeros((1 << depth) - 1)
        cells = {0: np.arange(len(x))}
        for node in range(len(thresholds)):
            level = (node + 1).bit_length() - 1
            here = cells[node]
            values = projected[here, level]
            thresholds[node] = np.median(values if len(here) else projected[:, level])
            cells[2 * node + 1], cells[2 * node + 2] = here[values <= thresholds[node]], here[values > thresholds[node]]
        growth = sum(len(inside) for inside, _ in _descend(projected, thresholds, _spill(least, x.shape[1]))) / len(x)
        blocks = -(-size // block)
        if _copies(size, growth, depth, leaf) > blocks:
            return pd.DataFrame({"cell": [cell], "thresholds": [np.zeros(0)], "blocks": [blocks]})
        return pd.DataFrame({"cell": [cell], "thresholds": [thresholds], "blocks": [1]})

    return fit


_LISTS = "cid long, copies long, vec array<{}>, active array<long>, fresh array<long>, done array<long>, blocks array<int>"


def _split(fits, slices: int, number: int, least: float):
    """Each row's active cells of one slice: those that are fitted go down to parts (fresh) or to blocks, the others are done."""

    def lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
        column = batch.column(name)
        sizes = np.diff(column.offsets.to_numpy())
        return np.repeat(np.arange(len(sizes)), sizes), column.flatten().to_numpy(zero_copy_only=False)

    def packed(rows: list[np.ndarray], values: list[np.ndarray], count: int, kind: pa.DataType) -> tuple[pa.ListArray, np.ndarray]:
        row = np.concatenate(rows)
        order = np.argsort(row, kind="stable")
        ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=count))))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values)[order], kind)), order

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, sizes = batch.num_rows, np.diff(batch.column("vec").offsets.to_numpy())
            first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            numbers = batch.column("vec").flatten().to_numpy(zero_copy_only=False)
            row, cell = lists(batch, "active")
            (fresh_row, fresh), (done_row, done), blocks = lists(batch, "fresh"), lists(batch, "done"), lists(batch, "blocks")[1]
            fresh_rows, fresh_cells, done_rows, done_cells, done_blocks = [fresh_row], [fresh], [done_row], [done], [blocks]
            turn = cell % slices == number
            order = np.flatnonzero(turn)[np.argsort(cell[turn], kind="stable")]
            for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else []:
                name, here = int(cell[part[0]]), row[part]
                thresholds, in_blocks = fits.value.get(name, (None, 1))
                if thresholds is None:
                    done_rows.append(here)
                    done_cells.append(np.full(len(here), name))
                    done_blocks.append(np.full(len(here), in_blocks))
                    continue
                dim = int(sizes[here[0]])  # a cell has vectors of one length
                x = _unit(numbers[first[here][:, None] + np.arange(dim)])
                projected = x @ _directions(name, (len(thresholds) + 1).bit_length() - 1, dim).T
                for inside, leaf in _descend(projected, thresholds, _spill(least, dim)):
                    if len(inside):
                        fresh_rows.append(here[inside])
                        fresh_cells.append(np.full(len(inside), np.random.default_rng([name, leaf]).integers(1 << 62)))
            later, _ = packed([row[~turn]], [cell[~turn]], n, pa.int64())
            found, _ = packed(fresh_rows, fresh_cells, n, pa.int64())
            ready, order = packed(done_rows, done_cells, n, pa.int64())
            in_blocks = pa.ListArray.from_arrays(ready.offsets, pa.array(np.concatenate(done_blocks)[order], pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cid", "copies", "vec")), later, found, ready, in_blocks], names=["cid", "copies", "vec", "active", "fresh", "done", "blocks"])

    return split


def _shares_earlier(cell: int, rows: np.ndarray, cells: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """For members ``one`` and ``two``, given as numbers: do they share a cell before this one? (rows, cells) lists all."""
    rows, cells = rows[cells < cell], cells[cells < cell]
    size = int(max(one.max(), two.max())) + 1
    place_one, place_two = np.full(size, -1), np.full(size, -1)
    place_one[one], place_two[two] = np.arange(len(one)), np.arange(len(two))
    inside = rows < size
    rows, cells = rows[inside], cells[inside]
    common = np.intersect1d(cells[place_one[rows] >= 0], cells[place_two[rows] >= 0])
    shared = np.zeros((len(one), len(two)), bool)
    for i in range(0, len(common), 1024):
        column = np.searchsorted(common[i : i + 1024], cells)
        known = (column < len(common[i : i + 1024])) & (common[np.minimum(i + column, len(common) - 1)] == cells)
        a, b = np.zeros((len(one), 1024), np.float32), np.zeros((len(two), 1024), np.float32)
        in_one, in_two = known & (place_one[rows] >= 0), known & (place_two[rows] >= 0)
        a[place_one[rows[in_one]], column[in_one]] = 1
        b[place_two[rows[in_two]], column[in_two]] = 1
        shared |= a @ b.T > 0.5
    return shared


def _near(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which unit vectors of ``a`` and ``b`` have cosine ``least`` or more. Products in single precision are sure but for a margin."""
    margin = 2e-7 * a.shape[1] + 1e-6
    one, two, near = a.astype(np.float32), b.astype(np.float32), np.zeros((len(a), len(b)), bool)
    for i in range(0, len(a), 512):
        cosine = one[i : i + 512] @ two.T
        near[i : i + 512] = cosine >= least + margin
        x, y = np.nonzero(np.abs(cosine - least) <= margin)
        for j in range(0, len(x), 1 << 16):
            p, q = x[j : j + (1 << 16)] + i, y[j : j + (1 << 16)]
            near[p, q] = (a[p] * b[q]).sum(1) >= least
    return near


def _forest(near: np.ndarray, square: bool) -> np.ndarray:
    """The first member that each one reaches, breadth first; members are the rows, then, unless ``square``, the columns."""
    rows = len(near)
    root = np.arange(rows if square else rows + near.shape[1])
    left = np.flatnonzero(near.any(1)) if square else np.concatenate((np.flatnonzero(near.any(1)), rows + np.flatnonzero(near.any(0))))
    while len(left):
        start, left = left[0], left[1:]
        front = np.array([start])
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for i in range(0, len(front), 256):
                part, rest = front[i : i + 256], np.flatnonzero(~hit)
                if square:
                    hit[rest] = near[np.ix_(part, left[rest])].any(0)
                else:
                    over = left[rest] >= rows
                    hit[rest[over]] = near[np.ix_(part[part < rows], left[rest[over]] - rows)].any(0)
                    hit[rest[~over]] = near[np.ix_(left[rest[~over]], part[part >= rows] - rows)].any(1)
            front, left = left[hit], left[~hit]
            root[front] = start
    return root


def _compare(least: float):
    """Of rows sorted by (cell, lo, hi): each unit's own links, as (cid, links, root) of the vectors that have some."""
    names = ["cid", "links", "root"]

    def unit(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, cell = part.num_rows, part.column("cell")[0].as_py()
        cid, copies, own = (part.column(c).to_numpy(zero_copy_only=False) for c in ("cid", "copies", "own"))
        lists = part.column("cells")
        rows, cells = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(zero_copy_only=False)
        earlier = np.unique(cells[cells < cell], return_counts=True)[1]
        if n < 2 or (len(earlier) and earlier.max() == n):  # all pairs belong to an earlier cell
            return
        square = own.min() == own.max()
        a, b = (np.arange(n),) * 2 if square else (np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min()))
        x = _unit(part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(n, -1))
        near = _near(x[a], x[b], least)
        if square:
            np.fill_diagonal(near, False)
        at, to = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(at):
            return
        a, b, near = a[at], b[to], near[np.ix_(at, to)]
        near &= ~_shares_earlier(cell, rows, cells, a, b)
        members, links = (a, near @ copies[a]) if square else (np.concatenate((a, b)), np.concatenate((near @ copies[b], copies[a] @ near)))
        root, some = _forest(near, square), links > 0
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (cid[members][some], links[some], cid[members][root][some])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch if held is None else pa.concat_batches([held, batch])
            keys = np.stack([held.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "lo", "hi")])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist()]
            for i, j in zip(edges, edges[1:]):
                yield from unit(held.slice(i, j - i))
            held = held.slice(edges[-1])
        if held is not None:
            yield from unit(held)

    return run


def forest_links(vectors: DataFrame, least: float, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(cid, links, root) rows, several for a vector: links add up to how many others (counted by their ``copies``) are
    linked with it, and (cid, root) connect what links connect. ``vectors`` has cid, copies and vec; none is null, zero or twice."""
    kind, none = dict(vectors.dtypes)["vec"][6:-1], F.array().cast("array<long>")
    roots = F.array(*[F.pmod(F.xxhash64(F.size("vec"), F.lit(t)), F.lit(1 << 62)) for t in range(max(1, trees))])
    rows = vectors.select("cid", "copies", "vec", roots.alias("active"), none.alias("fresh"), none.alias("done"), F.array().cast("array<int>").alias("blocks"))
    rows, each = materialize(rows), F.explode("active").alias("cell")
    while True:
        counts = rows.select(each).groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
        depth = F.least(F.lit(DEPTH), F.greatest(F.lit(1), F.ceil(F.log2(F.col("rows") * 2.4 / leaf)))).cast("int")
        large = materialize(counts.where(F.col("rows") > (leaf if trees else 1)).withColumn("depth", depth))
        need = large.agg(F.sum(F.pow(F.lit(2), "depth").cast("long"))).first()[0] or 0
        if not need:
            break
        slices = -(-need // THRESHOLDS)
        for number in range(slices):
            part = large.where(F.col("cell") % slices == number)  # THRESHOLDS / 2 rows at most
            if trees:
                share = SAMPLE * F.pow(F.lit(2), "depth") / F.col("rows")
                sample = rows.select("cid", "vec", each).join(F.broadcast(part), "cell").where(F.pmod(F.xxhash64("cid", "cell"), F.lit(1 << 30)) <= share * (1 << 30))
                fits = sample.groupBy("cell", "depth", "rows").applyInPandas(_fit(least, leaf, block), "cell long, thresholds array<double>, blocks int")
            else:
                fits = part.select("cell", F.array().cast("array<double>").alias("thresholds"), F.ceil(F.col("rows") / block).cast("int").alias("blocks"))
            known = {r.cell: (np.array(r.thresholds) if r.thresholds else None, r.blocks) for r in fits.collect()}  # THRESHOLDS numbers at most
            split = _split(vectors.sparkSession.sparkContext.broadcast(known), slices, number, least)
            rows = materialize(rows.mapInArrow(split, _LISTS.format(kind)), rows)
        drop(large)
        rows = rows.select("cid", "copies", "vec", F.col("fresh").alias("active"), none.alias("fresh"), "done", "blocks")
    cells = F.concat("done", "active")
    placed = F.arrays_zip(cells.alias("cell"), F.concat("blocks", F.transform("active", lambda _: F.lit(1))).alias("blocks"))
    meet = rows.select("cid", "copies", "vec", cells.alias("cells"), F.explode(placed).alias("c")).select("*", "c.*").drop("c")
    meet = meet.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = meet.select("cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "cid", "copies", "vec", "cells")
    meet = meet.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")
    return materialize(meet.mapInArrow(_compare(least), "cid long, links long, root long"))


def near_duplicates(table: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """One row for each vector: id, n_links, component_id (smallest id that links reach), kept. ``trees=0`` compares all vectors."""
    kind = dict(table.dtypes)[vector_col]
    vec = F.col(vector_col) if kind == "array<float>" else F.col(vector_col).cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = table.select(F.col(id_col).alias("id"), vec.alias("vec")).withColumn("usable", usable)
    keyed = rows.where("usable").withColumn("h1", F.xxhash64(F.lit(1), "vec")).withColumn("h2", F.xxhash64(F.lit(2), "vec"))
    classes = keyed.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))
    found = forest_links(classes.select("cid", "copies", "vec"), least, trees, leaf, block)
    narrow = materialize(classes.drop("vec"), classes)
    degrees = found.groupBy("cid").agg(F.sum("links").alias("others"))
    roots = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("cid"), "root")
    known = narrow.join(degrees, "cid", "left").join(roots, "cid", "left")
    known = materialize(known.select("h1", "h2", "least", "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root")), narrow, found)
    names = materialize(known.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
    named = materialize(join_counted(known, names, "root", "n").select("h1", "h2", "copies", "n_links", "component_id"), known, names)
    linked = join_counted(keyed.select("id", "h1", "h2"), named, ["h1", "h2"], "copies").select("id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))
