"""Scans over long channels: running sums, maxima and the like, and folds of
states, without a task that holds a channel.

A channel's rows are cut in blocks of their order. Each block is scanned on its
own; what a block adds is one row, and these rows are scanned in the same way,
in blocks of blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Keys = tuple[str, ...]

#: Rows of a channel in one window; two levels scan FAN * FAN rows.
FAN = 1 << 16

#: Bytes (by the optimizer's estimate, which is no less than what is read) up to which one level does: a channel is no larger than its table.
ONE_LEVEL = 1 << 28


def levels_of(rows: DataFrame) -> int:
    """1 for a table that a task could hold whole, else 2."""
    return 1 if int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= ONE_LEVEL else 2


_TWO: dict[Callable, Callable[[Column], Column]] = {
    F.max: F.array_max,
    F.min: F.array_min,
    F.sum: lambda parts: F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0).cast("double"), lambda a, v: a + v)),
}


def before(rows: DataFrame, keys: Keys, order: str, value: str, how: Callable[[str], Column], name: str, fan: int = FAN, levels: int | None = None) -> DataFrame:
    """rows with a column ``name``: how(value) over the channel's rows with a smaller
    ``order`` (a long, unique in its channel); null where there are none.

    how is F.sum (as a double), F.max or F.min.
    """
    levels = levels or levels_of(rows)
    if levels == 1:
        return rows.withColumn(name, how(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))
    block, all_, earlier, inner, at = (f"__{x}{levels}" for x in ("block", "all", "earlier", "inner", "at"))
    own = [f"__{i}_{levels}" for i in range(len(keys))]
    cut = rows.withColumn(block, F.floor(F.col(order) / fan))
    inside = Window.partitionBy(*keys, block).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut.groupBy(*keys, block).agg(how(value).alias(all_))
    blocks = before(blocks, keys, block, all_, how, earlier, fan, levels - 1)
    blocks = blocks.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col(block).alias(at), earlier)
    same = F.col(block) == F.col(at)
    for k, o in zip(keys, own):
        same = same & F.col(k).eqNullSafe(F.col(o))
    out = cut.withColumn(inner, how(value).over(inside)).join(blocks, same)
    return out.withColumn(name, _TWO[how](F.array_compact(F.array(earlier, inner)))).drop(block, at, inner, earlier, *own)


# --- folds of states ------------------------------------------------------------


class Linear:
    """A block's map is what it adds to the state that one matrix has moved."""

    def __init__(self, move: np.ndarray):
        self.move, self.powers = move, {}

    def rest(self, n: int, state: np.ndarray) -> np.ndarray:
        """The state behind n blocks without rows."""
        if n not in self.powers and len(self.powers) < 1000:
            self.powers[n] = np.linalg.matrix_power(self.move, n)
        return (self.powers[n] if n in self.powers else np.linalg.matrix_power(self.move, n)) @ state

    def apply(self, map_: np.ndarray, state: np.ndarray) -> np.ndarray:
        return self.move @ state + map_

    def composed(self, blocks: list[int], maps: list[np.ndarray], first: int, size: int) -> np.ndarray:
        """The map of ``size`` blocks from the first on."""
        state, at = np.zeros(len(self.move)), first
        for b, m in zip(blocks, maps):
            state, at = self.apply(m, self.rest(b - at, state)), b + 1
        return self.rest(first + size - at, state)

    def up(self, size: int) -> Linear:
        """The carrier of maps of so many blocks."""
        return Linear(np.linalg.matrix_power(self.move, size))


class Affine:
    """Maps [c, d]: state to c * state + d; blocks without rows change nothing."""

    def rest(self, n: int, state: np.ndarray) -> np.ndarray:
        return state

    def apply(self, map_: np.ndarray, state: np.ndarray) -> np.ndarray:
        return map_[0] * state + map_[1]

    def composed(self, blocks: list[int], maps: list[np.ndarray], first: int, size: int) -> np.ndarray:
        c, d = 1.0, 0.0
        for m in maps:
            c, d = m[0] * c, m[0] * d + m[1]
        return np.array([c, d])

    def up(self, size: int) -> Affine:
        return self


class Moved:
    """Maps [M row by row, d] of so many states: state to M state + d; blocks without rows change nothing."""

    def __init__(self, states: int):
        self.states = states

    def _parts(self, map_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self.states
        return map_[: k * k].reshape(k, k), map_[k * k :]

    def rest(self, n: int, state: np.ndarray) -> np.ndarray:
        return state

    def apply(self, map_: np.ndarray, state: np.ndarray) -> np.ndarray:
        move, add = self._parts(map_)
        return move @ state + add

    def composed(self, blocks: list[int], maps: list[np.ndarray], first: int, size: int) -> np.ndarray:
        move, add = np.eye(self.states), np.zeros(self.states)
        for m in maps:
            a, d = self._parts(m)
            move, add = a @ move, a @ add + d
        return np.concatenate([move.ravel(), add])

    def up(self, size: int) -> Moved:
        return self


class Monotone:
    """Maps [x0 .. xm, y0 .. ym]: rising and piecewise linear through (x, y); states stay between x0 and xm."""

    def rest(self, n: int, state: np.ndarray) -> np.ndarray:
        return state

    def apply(self, map_: np.ndarray, state: np.ndarray) -> np.ndarray:
        x, y = np.split(map_, 2)
        return np.interp(state, x, y)

    def composed(self, blocks: list[int], maps: list[np.ndarray], first: int, size: int) -> np.ndarray:
        out = maps[0]
        for m in maps[1:]:
            (x, y), (u, v) = np.split(out, 2), np.split(m, 2)
            # the second map's bends, where the first one's values reach them
            inner = u[(u > y[0]) & (u < y[-1])]
            x = np.union1d(x, np.interp(inner, y, x))
            y = np.interp(np.interp(x, *np.split(out, 2)), u, v)
            out = simplified(x, y)
        return out

    def up(self, size: int) -> Monotone:
        return self


def simplified(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """[x, y] without points between two others of nearly the same value: where a
    map has forgotten the state, two points tell it."""
    keep = np.append(True, np.diff(y) > 4e-16 * np.maximum(np.abs(y[1:]), np.abs(y[:-1])))
    keep |= np.append(keep[1:], True)
    keep[[0, -1]] = True
    return np.concatenate([x[keep], y[keep]])


def folded(ends: DataFrame, keys: Keys, carrier, start: np.ndarray, fan: int = 256, levels: int | None = None) -> DataFrame:
    """(*keys, block, state): the state that each block of a channel begins with.

    ends: (*keys, block, map), one row for each block that has rows; the carrier
    tells what a map does. ``fan`` blocks are composed to one map, so a channel's
    group has a row for each fan of blocks only; states then go down again.
    """
    array, levels = pa.list_(pa.float64()), levels or levels_of(ends)
    kept = [ends.schema[k] for k in keys]
    block, numbers = T.StructField("block", T.LongType()), lambda name: T.StructField(name, T.ArrayType(T.DoubleType()))
    carried = T.StructType([*kept, block, numbers("state")])

    def lists(df: DataFrame, *by: str) -> DataFrame:
        """One row for each of ``by`` with its (block, map) in order: many groups go through one call of a kernel."""
        first = [F.first("top").alias("top")] if "top" in df.columns else []
        return df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("block", "map"))).alias("m"), *first)

    def groups_of(batch: pa.RecordBatch):
        """(row, its blocks, its maps)"""
        m = batch.column("m")
        flat, size = m.flatten(), np.asarray(m.value_lengths())
        blocks, maps = flat.field("block").to_pylist(), flat.field("map")
        values, at = np.asarray(maps.values), np.asarray(maps.offsets)
        end = 0
        for row, n in enumerate(size.tolist()):
            begin, end = end, end + n
            yield row, blocks[begin:end], [values[at[i] : at[i + 1]] for i in range(begin, end)]

    def walk(batch: pa.RecordBatch, begun: Callable) -> pa.RecordBatch:
        rows, numbers_, out = [], [], []
        for row, blocks, maps in groups_of(batch):
            at, state = begun(row, blocks)
            for i, (b, map_) in enumerate(zip(blocks, maps)):
                state = carrier.rest(b - at, state) if b > at else state
                rows.append(row)
                out.append(np.atleast_1d(state))
                if i + 1 < len(blocks):
                    state, at = carrier.apply(map_, state), b + 1
            numbers_ += blocks
        take = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in keys), pa.array(numbers_, pa.int64()), pa.array(out, array)], names=[*keys, "block", "state"])

    if levels == 1:
        return lists(ends, *keys).mapInArrow(lambda it: (walk(batch, lambda row, blocks: (blocks[0], start)) for batch in it), carried)

    cut = ends.withColumn("group", F.floor(F.col("block") / fan))

    def compose(it):
        for batch in it:
            group = batch.column("group").to_pylist()
            ones = [np.asarray(carrier.composed(blocks, maps, group[row] * fan, fan)) for row, blocks, maps in groups_of(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("group"), pa.array(ones, array)], names=[*keys, "block", "map"])

    groups = lists(cut, *keys, "group").mapInArrow(compose, T.StructType([*kept, block, numbers("map")]))
    tops = folded(groups, keys, carrier.up(fan), start, fan, levels - 1).withColumnsRenamed({"block": "group", "state": "top"})

    def down(it):
        for batch in it:
            group, top = batch.column("group").to_pylist(), batch.column("top")
            yield walk(batch, lambda row, blocks: (group[row] * fan, np.array(top[row].as_py())))

    return lists(cut.join(tops, [*keys, "group"]), *keys, "group").mapInArrow(down, carried)
