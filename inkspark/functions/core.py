"""Helpers for column functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once for each row, though ``then`` uses it for each element of an array."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def prefix_sums(values: Column) -> Column:
    """For each of an array of whole numbers the sum up to and with it; all arrays of a batch at once."""

    def sums(lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        upto = np.concatenate([[0], np.cumsum(lists.flatten().to_numpy())]).astype(np.int64)
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(upto[1:] - np.repeat(upto[ends - sizes], sizes)), mask=lists.is_null())

    return F.arrow_udf(sums, "array<bigint>")(values.cast("array<bigint>"))


#: Values that a running fold takes at a time. What a fold appends to is copied at each step, so it must stay short.
BLOCK = 128


def running(values: Column, start: Column, step, out, kind: str) -> Column:
    """``out`` of the state after each value, as an array of ``kind``; ``step`` makes the next state of a state and a value, and
    ``start`` has the state's type. Blocks of BLOCK values are folded one after another, so work is nearly linear."""

    def fold(values: Column, start: Column, emit, kind: str) -> Column:
        """A struct of the last state and all that ``emit`` (of a state and a value: the next state and what to put out) made."""
        begin = F.struct(start.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))

        def add(acc: Column, v: Column) -> Column:
            return let(emit(acc["state"], v), lambda made: F.struct(made["state"].alias("state"), F.array_append(acc["out"], made["out"]).alias("out")))

        return F.aggregate(values, begin, add)

    def one(state: Column, v: Column) -> Column:
        return let(step(state, v), lambda new: F.struct(new.alias("state"), out(new).cast(kind).alias("out")))

    def blocks(xs: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))
        cut = F.transform(firsts, lambda i: F.slice(xs, i * BLOCK + 1, BLOCK))
        return F.when(F.size(xs) == 0, F.array().cast(f"array<array<{kind}>>")).otherwise(fold(cut, start, lambda s, b: fold(b, s, one, kind), f"array<{kind}>")["out"])

    return F.flatten(let(values, blocks))
