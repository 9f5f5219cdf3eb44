"""Recursive filters over blocks of samples.

A linear recursion's state behind a block is a matrix times the state before it
plus what the block's own samples add. So channels are cut in blocks of BLOCK
samples, rows of their own that Spark deals out by (channel, block): each adds
its part to the state from a zero state, these parts are folded in order (scans),
and each block is then computed with the state it begins with, as products of
matrices over many blocks at once. A channel of any length is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonagrid.operators.scans import Affine, Linear, folded

Keys = tuple[str, ...]

BLOCK = 256


class LinearStep:
    """A recursion y, state' = step(state, x) with real states, as matrices."""

    def __init__(self, step: Callable, states: int):
        self.a = np.zeros((states, states))
        self.c = np.zeros(states)
        for k, unit in enumerate(np.eye(states)):
            self.c[k], self.a[:, k] = step(unit, 0.0)
        self.d, b = step(np.zeros(states), 1.0)
        self.b = np.asarray(b, dtype=float)

    def of_block(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(samples to samples, states to samples, samples to state, state to state) of a block."""
        seen, moved = np.zeros((size, len(self.c))), np.zeros((size, len(self.c)))
        row, column = self.c, self.b
        for i in range(size):
            seen[i], moved[size - 1 - i] = row, column
            row, column = row @ self.a, self.a @ column
        impulse = np.append(self.d, seen[:-1] @ self.b)
        lag = np.subtract.outer(np.arange(size), np.arange(size))
        return np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0), seen, moved, np.linalg.matrix_power(self.a, size)


    @classmethod
    def of(cls, processor: Callable, initial: np.ndarray) -> LinearStep:
        """From a processor of sample blocks with a state vector (sonagrid.streaming)."""

        def step(state, x):
            y, after = processor(np.array([x]), np.array(state, dtype=float))
            return float(y[0]), after

        return cls(step, len(initial))

    def blockwise(self, size: int = BLOCK) -> Callable:
        """The processor again, whole blocks at once: (samples, state) to (samples, state)."""
        direct, seen, moved, _ = self.of_block(size)
        powers = {0: np.eye(len(self.c))}

        def move(n: int) -> np.ndarray:
            if n not in powers:
                powers[n] = np.linalg.matrix_power(self.a, n)
            return powers[n]

        def run(x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            out = np.empty(len(x))
            for i in range(0, len(x), size):
                part = x[i : i + size]
                n = len(part)
                out[i : i + n] = direct[:n, :n] @ part + seen[:n] @ state
                state = move(n) @ state + part @ moved[size - n :]
            return out, state

        return run


def sections_step(sections: np.ndarray) -> LinearStep:
    """A cascade of second-order sections [b0 b1 b2 1 a1 a2]; two states for each."""
    rows = np.atleast_2d(sections).tolist()

    def step(state, x):
        new = []
        for k, (b0, b1, b2, _, a1, a2) in enumerate(rows):
            y = b0 * x + state[2 * k]
            new += [b1 * x - a1 * y + state[2 * k + 1], b2 * x - a2 * y]
            x = y
        return x, new

    return LinearStep(step, 2 * len(rows))


def poles_step(poles: list[complex], gain: complex) -> LinearStep:
    """Real part of ``gain`` times a cascade of complex one-pole filters."""

    def step(state, x):
        new = []
        for k, p in enumerate(poles):
            x = x + p * complex(state[2 * k], state[2 * k + 1])
            new += [x.real, x.imag]
        return (gain * complex(x)).real, new

    return LinearStep(step, 2 * len(poles))


def _dense(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(samples by block and place, block of each sample, its place)."""
    lists = part.column("s")
    flat = lists.flatten()
    row = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
    at = np.asarray(flat.field("at"), dtype=np.int64)
    x = np.zeros((part.num_rows, size))
    x[row, at] = np.asarray(flat.field("re"))
    return x, row, at


def _blocks(signal: DataFrame, keys: Keys, size: int, *values: str) -> DataFrame:
    """(*keys, block, s): samples of a block with their places in it; a missing sample counts as 0."""
    at = F.pmod("n", F.lit(size).cast("long")).cast("int").alias("at")
    return signal.groupBy(*keys, F.floor(F.col("n") / size).alias("block")).agg(F.collect_list(F.struct(at, *values)).alias("s"))


def _key_fields(df: DataFrame, keys: Keys) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def _taken(part: pa.RecordBatch, keys: Keys, row: np.ndarray, n: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    at = pa.array(row)
    return pa.RecordBatch.from_arrays([*(part.column(k).take(at) for k in keys), pa.array(n), pa.array(y)], names=[*keys, "n", "re"])


def filtered(signal: DataFrame, step: LinearStep, keys: Keys = ("ch",), size: int = BLOCK, levels: int | None = None) -> DataFrame:
    """(*keys, n, re): the recursion over each channel's samples in the order of n, from a zero state."""
    direct, seen, moved, move = step.of_block(size)
    blocks = _blocks(signal, keys, size, "re")

    def ends(it):
        for batch in it:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                end = _dense(part, size)[0] @ moved
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), part.column("block"), pa.array(list(end), pa.list_(pa.float64()))], names=[*keys, "block", "map"])

    def samples(it):
        for batch in it:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x, row, at = _dense(part, size)
                y = x @ direct.T + np.stack([np.asarray(v.values) for v in part.column("state")]) @ seen.T
                yield _taken(part, keys, row, np.asarray(part.column("block"), dtype=np.int64)[row] * size + at, y[row, at])

    fields = _key_fields(signal, keys)
    state = T.StructType([*fields, T.StructField("block", T.LongType()), T.StructField("map", T.ArrayType(T.DoubleType()))])
    carried = folded(blocks.mapInArrow(ends, state), keys, Linear(move), np.zeros(len(move)), levels=levels)
    out = T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("re", T.DoubleType())])
    return blocks.join(carried, [*keys, "block"]).select(*keys, "block", "s", "state").mapInArrow(samples, out)


def bank(signal: DataFrame, steps: dict[str, LinearStep], keys: Keys = ("ch",), size: int = BLOCK, levels: int | None = None) -> DataFrame:
    """(*keys, n, re, band): several recursions over the same blocks at once; their states are one, moved by a matrix of blocks."""
    parts = {name: step.of_block(size) for name, step in steps.items()}
    count = [len(move) for _, _, _, move in parts.values()]
    at = np.concatenate([[0], np.cumsum(count)])
    moved = np.hstack([m for _, _, m, _ in parts.values()])
    move = np.zeros((at[-1], at[-1]))
    for i, (_, _, _, own) in enumerate(parts.values()):
        move[at[i] : at[i + 1], at[i] : at[i + 1]] = own
    blocks = _blocks(signal, keys, size, "re")

    def ends(it):
        for batch in it:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                end = _dense(part, size)[0] @ moved
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), part.column("block"), pa.array(list(end), pa.list_(pa.float64()))], names=[*keys, "block", "map"])

    def samples(it):
        for batch in it:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x, row, place = _dense(part, size)
                state = np.stack([np.asarray(v.values) for v in part.column("state")])
                n = np.asarray(part.column("block"), dtype=np.int64)[row] * size + place
                for i, (name, (direct, seen, _, _)) in enumerate(parts.items()):
                    y = x @ direct.T + state[:, at[i] : at[i + 1]] @ seen.T
                    one = _taken(part, keys, row, n, y[row, place])
                    yield pa.RecordBatch.from_arrays([*one.columns, pa.array([name] * one.num_rows, pa.string())], names=[*one.schema.names, "band"])

    fields = _key_fields(signal, keys)
    state = T.StructType([*fields, T.StructField("block", T.LongType()), T.StructField("map", T.ArrayType(T.DoubleType()))])
    carried = folded(blocks.mapInArrow(ends, state), keys, Linear(move), np.zeros(len(move)), levels=levels)
    out = T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("re", T.DoubleType()), T.StructField("band", T.StringType())])
    return blocks.join(carried, [*keys, "block"]).select(*keys, "block", "s", "state").mapInArrow(samples, out)


def sections(signal: DataFrame, sections_: np.ndarray, keys: Keys = ("ch",)) -> DataFrame:
    """Cascade of second-order sections."""
    return filtered(signal, sections_step(sections_), keys)


def zero_phase(signal: DataFrame, sections_: np.ndarray, keys: Keys = ("ch",)) -> DataFrame:
    """Forward and backward, with ends extended by odd reflection; n starts at 0."""
    ends = signal.groupBy(*keys).agg(F.max("n").alias("last"), F.min_by("re", "n").alias("x0"), F.max_by("re", "n").alias("x1"))
    reach = F.least(F.lit(3 * (2 * len(np.atleast_2d(sections_)) + 1)).cast("long"), F.col("last"))
    s = signal.join(ends.withColumn("m", reach), list(keys))
    place = lambda n, v: F.struct(n.alias("n"), v.alias("re"))
    left = F.when((F.col("n") >= 1) & (F.col("n") <= F.col("m")), place(F.col("m") - F.col("n"), 2 * F.col("x0") - F.col("re")))
    right = F.when((F.col("n") < F.col("last")) & (F.col("n") >= F.col("last") - F.col("m")), place(2 * F.col("last") - F.col("n") + F.col("m"), 2 * F.col("x1") - F.col("re")))
    wide = s.select(*keys, F.inline(F.array_compact(F.array(place(F.col("n") + F.col("m"), F.col("re")), left, right))))
    size = ends.select(*keys, reach.alias("m"), (F.col("last") + 2 * reach).alias("end"), "last")
    back = lambda d: d.join(size, list(keys)).select(*keys, (F.col("end") - F.col("n")).alias("n"), "re")
    twice = back(sections(back(sections(wide, sections_, keys)), sections_, keys))
    out = twice.join(size, list(keys)).withColumn("n", F.col("n") - F.col("m"))
    return out.where((F.col("n") >= 0) & (F.col("n") <= F.col("last"))).select(*keys, "n", "re")


def affine(signal: DataFrame, keys: Keys = ("ch",), size: int = BLOCK, levels: int | None = None) -> DataFrame:
    """(*keys, n, re): re[n] = c[n] * re[n - 1] + d[n] from 0, for columns c and d of signal.

    The maps of a block compose to one; many blocks are stepped through at once.
    """
    blocks = _blocks(signal, keys, size, "c", "d")

    def composed(part: pa.RecordBatch):
        flat = part.column("s").flatten()
        row = np.repeat(np.arange(part.num_rows), np.asarray(part.column("s").value_lengths()))
        at = np.asarray(flat.field("at"), dtype=np.int64)
        c, d = np.ones((part.num_rows, size)), np.zeros((part.num_rows, size))
        c[row, at], d[row, at] = np.asarray(flat.field("c")), np.asarray(flat.field("d"))
        for i in range(1, size):
            d[:, i] += c[:, i] * d[:, i - 1]
            c[:, i] *= c[:, i - 1]
        return c, d, row, at

    def ends(it):
        for part in it:
            c, d, _, _ = composed(part)
            maps = pa.array(list(np.column_stack([c[:, -1], d[:, -1]])), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), part.column("block"), maps], names=[*keys, "block", "map"])

    def samples(it):
        for part in it:
            c, d, row, at = composed(part)
            y = d + c * np.asarray(part.column("state").flatten())[:, None]
            yield _taken(part, keys, row, np.asarray(part.column("block"), dtype=np.int64)[row] * size + at, y[row, at])

    fields, block = _key_fields(signal, keys), T.StructField("block", T.LongType())
    double = lambda n: T.StructField(n, T.DoubleType())
    maps = blocks.mapInArrow(ends, T.StructType([*fields, block, T.StructField("map", T.ArrayType(T.DoubleType()))]))
    carried = folded(maps, keys, Affine(), np.zeros(1), levels=levels)
    out = T.StructType([*fields, T.StructField("n", T.LongType()), double("re")])
    return blocks.join(carried, [*keys, "block"]).select(*keys, "block", "s", "state").mapInArrow(samples, out)


def feedback_delay(signal: DataFrame, samples: int, feedback: float, keys: Keys = ("ch",)) -> DataFrame:
    """y[n] = x[n] + feedback * y[n - samples]: a one-pole recursion of each of the delay's phases."""
    phases = signal.select(*keys, F.pmod("n", F.lit(samples).cast("long")).alias("phase"), F.floor(F.col("n") / samples).alias("n"), "re")
    y = sections(phases, np.array([[1.0, 0, 0, 1, -feedback, 0]]), (*keys, "phase"))
    return y.select(*keys, (F.col("n") * samples + F.col("phase")).alias("n"), "re")


def activity(signal: DataFrame, threshold_dbfs: float, coefficient: float, relative: bool = True, keys: Keys = ("ch",)) -> DataFrame:
    """(n, active): whether the smoothed power is above a threshold, relative to
    the peak or absolute. The smoother starts at 0 and rests where the power
    before was exactly 0."""
    by = Window.partitionBy(*keys)
    scale = F.greatest(F.max(F.abs("re")).over(by), F.lit(1e-300)) if relative else F.lit(1.0)
    p = signal.select(*keys, "n", F.pow(F.col("re") / scale, 2).alias("p"))
    moves = F.coalesce(F.lag("p").over(by.orderBy("n")), F.lit(0.0)) > 0
    p = p.select(*keys, "n", F.when(moves, 1.0 - coefficient).otherwise(1.0).alias("c"), F.when(moves, coefficient * F.col("p")).otherwise(0.0).alias("d"))
    return affine(p, keys).select(*keys, "n", (10 * F.log10(F.greatest("re", F.lit(1e-300))) > threshold_dbfs).alias("active"))


def resample(signal: DataFrame, up: int, down: int, keys: Keys = ("ch",)) -> DataFrame:
    """Rational resampling: a Kaiser-windowed sinc on the raised rate. Each sample
    is sent to the outputs that its response reaches, and outputs are sums."""
    g = np.gcd(up, down)
    up, down = int(up // g), int(down // g)
    half = 10 * max(up, down)
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    taps *= up / taps.sum()
    table = F.array(*[F.lit(float(v)) for v in taps])
    size = F.max("n").over(Window.partitionBy(*keys)) + 1
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("n") * up - half) / down))
    last = F.least(F.ceil(F.col("size") * up / down) - 1, F.floor((F.col("n") * up + half) / down))
    sent = signal.withColumn("size", size).select(*keys, "n", "re", first.alias("first"), last.alias("last")).where("first <= last")
    sent = sent.select(*keys, "n", "re", F.explode(F.sequence("first", "last")).alias("m"))
    tap = F.get(table, (F.col("m") * down - F.col("n") * up + half).cast("int"))
    return sent.groupBy(*keys, F.col("m").alias("n")).agg(F.sum(F.col("re") * tap).alias("re"))


def processed(signal: DataFrame, part: tuple[Callable, np.ndarray], keys: Keys = ("ch",)) -> DataFrame:
    """A linear processor of sonagrid.streaming, with its state at rest, over whole channels."""
    return filtered(signal, LinearStep.of(*part), keys)
