"""Mixing sources to target weights by temperature (operator 2). Native: no Python runs on the executors.

A document's cost is its number of words (runs other than space and \\t..\\r) plus one end mark, so even a null
or empty text costs 1. With p the sources' shares of all tokens, weights are p**a / sum(p**a). The exponent a in
[0, 1] is found by bisection on the grid k / 2**20:

* ``target_entropy``: the largest a whose weights have at least that entropy, as a share of ln(number of sources);
* ``max_repetition``: the smallest a with which no source is repeated more often than that.

The weights are realised as budgeted block permutations. A source with quota w * budget gets each of its documents
in floor(quota / tokens) whole epochs. For the rest of the quota, the source's 4,096 hash blocks are put into a
keyed permutation and taken whole while they fit; of the block at the edge, documents are taken in a keyed
permutation while they fit. So a source needs two cut keys, and whether a document has a further copy is
decided on the map side from its id alone. No text is shuffled, and the permutation of the hot source is never
sorted in one task: windows see one row for each block, and the documents of one block in 4,096.

A null source is a source of its own. Repeated rows with the same id are taken or left together. An empty table gives no rows. Columns keep
their values and names in mix_documents(), whatever they are called; elsewhere only the named ones are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_checked, materialize

GRID = 1 << 20
#: Levels of the bisection that one pass over the sources evaluates.
LEVELS = 5


def token_cost(text: Column) -> Column:
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def _keys(seed: int, id_col: Column, source_key: Column, epoch: Column) -> tuple[Column, Column, Column]:
    """block, the block's place and the document's place in the permutation of an epoch."""
    name = F.coalesce(id_col.cast("string"), F.lit("null"))
    block = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), name)), 1, 3)
    of_block = F.md5(F.concat_ws("|", F.lit(str(seed)), source_key, epoch.cast("string"), block))
    return block, of_block, F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), name))


def exponent(sources: DataFrame, total: int, target_entropy: float | None, max_repetition: float | None, budget: float) -> float:
    """Bisect the exponent; ``sources`` has a row (source_key, tokens) for each source."""
    if (target_entropy is None) == (max_repetition is None):
        raise ValueError("give either target_entropy or max_repetition")
    p = F.col("tokens") / F.lit(total)

    def judged(points: list[int]) -> dict[int, bool]:
        powered = sources.select("tokens", p.alias("p"), F.explode(F.array(*map(F.lit, points))).alias("k"))
        powered = powered.withColumn("q", F.pow("p", F.col("k") / GRID))
        sums = powered.groupBy("k").agg(
            F.sum("q").alias("s"), F.sum(F.col("q") * F.ln("p") * F.col("k") / GRID).alias("t"), F.max(F.col("q") / F.col("tokens")).alias("r"), F.count(F.lit(1)).alias("n")
        )
        if target_entropy is not None:
            good = F.ln("s") - F.col("t") / F.col("s") >= F.lit(target_entropy) * F.ln("n") - 1e-12
        else:
            good = F.col("r") * budget / F.col("s") > max_repetition + 1e-9  # still too much: the exponent must grow
        return {r.k: r.good for r in sums.select("k", good.alias("good")).collect()}  # 2**LEVELS rows at most

    lo, hi = 0, GRID + 1  # entropy: the largest good point; repetition: the largest point with too much
    while hi - lo > 1:
        points, spans = set(), [(lo, hi)]
        for _ in range(LEVELS):
            mids = [(a, (a + b) // 2, b) for a, b in spans if b - a > 1]
            points |= {m for _, m, _ in mids}
            spans = [s for a, m, b in mids for s in ((a, m), (m, b))]
        good = judged(sorted(points))
        while hi - lo > 1 and (lo + hi) // 2 in good:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if good[mid] else (lo, mid)
    if target_entropy is not None:
        return lo / GRID
    return (0 if lo == 0 and not judged([0])[0] else min(lo + 1, GRID)) / GRID


def mixing_plan(
    costs: DataFrame, id_col: str, target_entropy: float | None = None, max_repetition: float | None = None, budget: float | None = 1.0, seed: int = 7
) -> DataFrame:
    """(source_key, tokens, weight, quota, epochs, cut_block, cut_doc) for each source. ``costs`` has source_key,
    n_tokens and the id, and is stable when read again. ``budget`` is a multiple of all tokens; None takes the
    least budget that holds every source whole at least once."""
    block = _keys(seed, F.col(id_col), F.col("source_key"), F.lit(0))[0]
    blocks = materialize(costs.groupBy("source_key", block.alias("block")).agg(F.sum("n_tokens").alias("tokens")))
    sources = materialize(blocks.groupBy("source_key").agg(F.sum("tokens").alias("tokens")))
    total, most = sources.agg(F.sum("tokens"), F.max("tokens")).first()
    if total is None:
        total = most = 1
        alpha = 1.0
    else:
        # with no budget given, the largest source is the one seen once: its weight decides the budget
        alpha = exponent(sources, total, target_entropy, max_repetition, total * budget) if budget is not None else _covering(sources, total, most, target_entropy, max_repetition)
    weighed = sources.withColumn("q", F.pow(F.col("tokens") / F.lit(total), F.lit(alpha)))
    sums = weighed.agg(F.sum("q").alias("s"), F.max(F.col("tokens") / F.col("q")).alias("cover"))
    tokens = F.lit(float(total * budget)) if budget is not None else F.col("cover") * F.col("s")
    plan = weighed.join(F.broadcast(sums)).select(
        "source_key", "tokens", (F.col("q") / F.col("s")).alias("weight"), (F.col("q") / F.col("s") * tokens).alias("quota")
    )
    plan = plan.withColumn("epochs", F.floor(F.col("quota") / F.col("tokens") + 1e-9))
    plan = materialize(plan.withColumn("rest", F.floor(F.greatest(F.lit(0.0), F.col("quota") - F.col("epochs") * F.col("tokens") + 1e-6))))

    def running(df: DataFrame, key: str, cost: str, start: Column) -> DataFrame:
        return df.withColumn("upto", start + F.sum(cost).over(Window.partitionBy("source_key").orderBy(key)))

    # a source has 4,096 blocks at most, whatever its size
    ordered = blocks.join(plan.select("source_key", "epochs", "rest"), "source_key")
    ordered = ordered.withColumn("place", F.md5(F.concat_ws("|", F.lit(str(seed)), "source_key", F.col("epochs").cast("string"), "block")))
    edge = running(ordered, "place", "tokens", F.lit(0)).where("rest > 0 AND upto >= rest")
    edge = edge.groupBy("source_key").agg(F.min(F.struct("place", "block", "tokens", "upto", "rest", "epochs")).alias("e"))
    edge = edge.select("source_key", F.col("e.place").alias("cut_block"), F.col("e.block").alias("edge"), (F.col("e.upto") - F.col("e.tokens")).alias("before"), F.col("e.rest").alias("rest"), F.col("e.epochs").alias("epochs"))
    edge = materialize(edge)
    inside = join_checked(costs, edge, "source_key", "inner", F.col(id_col)).where(block == F.col("edge"))
    inside = inside.withColumn("place", _keys(seed, F.col(id_col), F.col("source_key"), F.col("epochs"))[2])
    cut = running(inside, "place", "n_tokens", F.col("before")).where("upto <= rest").groupBy("source_key").agg(F.max("place").alias("cut_doc"))
    return materialize(plan.join(edge.select("source_key", "cut_block"), "source_key", "left").join(cut, "source_key", "left"))


def _covering(sources: DataFrame, total: int, most: int, target_entropy: float | None, max_repetition: float | None) -> float:
    if max_repetition is None:
        return exponent(sources, total, target_entropy, None, 0.0)
    # repetition of a source is (p / p_max) ** (a - 1) when the largest one is seen once
    least = sources.agg(F.min("tokens")).first()[0]
    lo, hi = -1, GRID  # the smallest point that is good; at a = 1 nothing is repeated
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if (least / most) ** (mid / GRID - 1) <= max_repetition else (mid, hi)
    return hi / GRID


def realise(rows: DataFrame, plan: DataFrame, id_col: str, seed: int = 7) -> DataFrame:
    """``rows`` (with source_key) repeated as the plan says; adds epoch, counted from 0 for each document."""
    planned = join_checked(rows, plan.drop("tokens"), "source_key", "inner", F.col(id_col))
    _, of_block, of_doc = _keys(seed, F.col(id_col), F.col("source_key"), F.col("epochs"))
    further = (of_block < F.col("cut_block")) | ((of_block == F.col("cut_block")) & (of_doc <= F.col("cut_doc")))
    copies = F.col("epochs") + F.coalesce(further, F.lit(False)).cast("long")
    return planned.withColumn("__copies", copies).where("__copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("__copies")))).withColumn("epoch", F.col("epoch") - 1).drop("__copies")


def _costs(docs: DataFrame, text_col: str, source_col: str, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col), _source_key(F.col(source_col)).alias("source_key"), F.col(source_col).alias("source"), token_cost(F.col(text_col)).alias("n_tokens"))


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", seed: int = 7, **target) -> DataFrame:
    """One row for each copy in the mixture: id, source, n_tokens, weight, epoch, block."""
    costs = materialize(_costs(docs, text_col, source_col, id_col))
    plan = mixing_plan(costs, id_col, seed=seed, **target)
    block = _keys(seed, F.col(id_col), F.col("source_key"), F.lit(0))[0]
    return realise(costs, plan, id_col, seed).select(id_col, "source", "n_tokens", "weight", "epoch", block.alias("block"))


def mix_documents(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", seed: int = 7, **target) -> DataFrame:
    """The documents of the mixture with the columns of ``docs``; a copy is a row."""
    costs = materialize(_costs(docs, text_col, source_col, id_col).drop("source"))
    plan = mixing_plan(costs, id_col, seed=seed, **target)
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}  # the plan's columns clash with no column of the input
    rows = docs.select(_source_key(F.col(source_col)).alias("source_key"), *[F.col(c).alias(n) for c, n in names.items()])
    return realise(rows, plan, names[id_col], seed).select(*[F.col(n).alias(c) for c, n in names.items()])
