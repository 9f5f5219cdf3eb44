"""Level-driven effects on channels of any length: attack, hold and release of a
gate, and a compressor with attack and release.

Gating is a matter of gaps and islands: runs of samples beyond a threshold are
joined to islands by running maxima over blocks. A compressor's gain moves
towards the wanted one with the attack's or the release's coefficient. For one
sample that is a rising, continuous, piecewise linear map of the gain with one
bend (at the wanted gain), so a block's map is piecewise linear too, with a
bend for each sample at most, and maps compose: blocks give their maps, the maps
are folded in order (scans), and each block is stepped through from its own gain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonagrid.operators import scans
from sonagrid.operators.effects import compression_curve
from sonagrid.operators.recursive import _blocks, _key_fields, _taken

Keys = tuple[str, ...]

# --- gating -----------------------------------------------------------------------


def triggers(signal: DataFrame, beyond: Column, in_a_row: int = 2, keys: Keys = ("ch",)) -> DataFrame:
    """(*keys, n): samples behind ``in_a_row`` samples beyond the threshold (or behind
    as many as there are at the channel's start); the channel ends before its last sample."""
    last = signal.groupBy(*keys).agg(F.max("n").alias("last"))
    on = signal.where(beyond).select(*keys, F.col("n").alias("of"))
    hits = on.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.lit(in_a_row)), lambda k: F.col("of") + k)).alias("n")).groupBy(*keys, "n").agg(F.count(F.lit(1)).alias("hits"))
    return hits.where(F.col("hits") == F.least(F.lit(in_a_row).cast("long"), F.col("n"))).join(last, list(keys)).where("n <= last").select(*keys, "n")


def islands(marks: DataFrame, reach: int, keys: Keys = ("ch",), levels: int | None = None) -> DataFrame:
    """(*keys, first, last): runs of samples that marks (*keys, n) cover, each mark covering ``reach`` samples from its own on."""
    seen = scans.before(marks, keys, "n", "n", F.max, "earlier", levels=levels)
    opens = F.col("earlier").isNull() | (F.col("n") - F.col("earlier") > reach)
    cut = seen.withColumn("opens", F.when(opens, F.col("n")))
    cut = scans.before(cut, keys, "n", "opens", F.max, "opened", levels=levels)
    return cut.groupBy(*keys, F.coalesce("opens", "opened").alias("first")).agg((F.max("n") + (reach - 1)).alias("last"))


def attack_hold_release(signal: DataFrame, beyond: Column, attack: int, hold: int, release: int, side_chain: Column | None = None, in_a_row: int = 2, keys: Keys = ("ch",), levels: int | None = None) -> DataFrame:
    """(*keys, n, attack, hold, release, since, until): the phase of a gate at each
    sample, and samples since the open run's first and until its last (null where shut).

    A sample behind ``in_a_row`` samples beyond the threshold opens the gate for
    attack + hold + release samples (hold and release are at least 1), later ones
    keep it open. An open run begins with ``attack`` samples; its last sample and
    the ``release`` ones before are the release, unless it ends with the channel;
    the rest holds. With side_chain, a condition on the signal's rows, the gate
    is open where it is true, and phases are cut where a run is shorter. Channels
    begin at n = 0. Gaps and islands: no task holds a channel.
    """
    hold, release = max(1, hold), max(1, release)
    if side_chain is None:
        reach = attack + hold + release
        runs = islands(triggers(signal, beyond, in_a_row, keys), reach, keys, levels)
    else:
        reach = 1
        runs = islands(signal.where(side_chain).select(*keys, "n"), 1, keys, levels)
    ends = signal.groupBy(*keys).agg(F.max("n").alias("end"))
    size = max(reach, 64)  # a block of samples meets two or three islands
    runs = runs.join(ends, list(keys)).select(*keys, "first", F.least("last", "end").alias("last"), "end")
    cut = runs.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / size), F.floor(F.col("last") / size))))
    rows = signal.select(*keys, "n", F.floor(F.col("n") / size).alias("block"))
    both = rows.join(cut.withColumnsRenamed({k: f"__{k}" for k in keys}).withColumnRenamed("block", "__block"), _same(keys) & F.expr("n between first and last"), "left")
    begins = F.coalesce((F.col("n") < F.col("first") + attack) & (F.col("first") > 0), F.lit(False))
    ending = F.coalesce((F.col("n") >= F.col("last") - release) & (F.col("last") < F.col("end")), F.lit(False))
    return both.select(*keys, "n", begins.alias("attack"), (F.col("first").isNotNull() & ~begins & ~ending).alias("hold"), ending.alias("release"), (F.col("n") - F.col("first")).alias("since"), (F.col("last") - F.col("n")).alias("until"))


def _same(keys: Keys) -> Column:
    out = F.col("block") == F.col("__block")
    for k in keys:
        out = out & (F.col(k) == F.col(f"__{k}"))
    return out


def gate_gain(signal: DataFrame, phases: DataFrame, attack: int, release: int, floor: float = 0.0, keys: Keys = ("ch",)) -> DataFrame:
    """(*keys, n, re): the signal with a gate's gain: 1 while it holds, ``floor`` while
    it is shut, and straight lines between over the phases' lengths."""
    both = signal.select(*keys, "n", "re").join(phases, [*keys, "n"])
    rise, fall = (F.col("since") + 1) / float(max(1, attack)), F.col("until") / float(max(1, release) + 1)
    share = F.when(F.col("attack"), rise).when(F.col("release"), fall).when(F.col("hold"), 1.0).otherwise(0.0)
    return both.select(*keys, "n", (F.col("re") * (floor + (1.0 - floor) * share)).alias("re"))


# --- compressor -------------------------------------------------------------------


def wanted_gain(x: Column, threshold_db: float, ratio: float, knee_db: float = 0.0) -> Column:
    """The gain that a sample's own level asks for."""
    level = 10.0 * F.log10(F.greatest(x * x, F.lit(1e-30)))
    return F.pow(F.lit(10.0), (compression_curve(level, threshold_db, ratio, knee_db) - level) / 20)


def _dense(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(wanted gains by block and place, nan where there is no sample; signal's values, blocks, places)."""
    lists = part.column("s")
    flat = lists.flatten()
    row = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
    at = np.asarray(flat.field("at"), dtype=np.int64)
    v = np.full((part.num_rows, size), np.nan)
    v[row, at] = np.asarray(flat.field("v"))
    return v, np.asarray(flat.field("re"), dtype=float), row, at


def block_maps(v: np.ndarray, up: float, down: float, low: float, high: float) -> list[np.ndarray]:
    """The map (scans.Monotone) of each row of wanted gains, for gains between low and high; all rows at once."""
    n, size = v.shape
    x, y = np.empty((n, size + 2)), np.empty((n, size + 2))
    x[:, 0] = y[:, 0] = low
    x[:, 1] = y[:, 1] = high
    for i in range(size):
        k = i + 2
        w = v[:, i]
        there = ~np.isnan(w)
        w = np.where(there, w, 0.0)
        xs, ys = x[:, :k], y[:, :k]
        under = ys < w[:, None]
        # the map's points next to the wanted gain; where it lies outside, the end is taken twice
        x0, y0 = np.where(under, xs, -np.inf).max(axis=1), np.where(under, ys, -np.inf).max(axis=1)
        x1, y1 = np.where(under, np.inf, xs).min(axis=1), np.where(under, np.inf, ys).min(axis=1)
        x0, y0 = np.where(np.isinf(x0), x1, x0), np.where(np.isinf(y0), y1, y0)
        x1, y1 = np.where(np.isinf(x1), x0, x1), np.where(np.isinf(y1), y0, y1)
        wide = y1 > y0
        share = np.where(wide, (w - y0) / np.where(wide, y1 - y0, 1.0), 0.0).clip(0, 1)
        x[:, k], y[:, k] = x0 + share * (x1 - x0), y0 + share * (y1 - y0)
        ys = y[:, : k + 1]
        ys += np.where(there[:, None], np.where(ys < w[:, None], up, down) * (w[:, None] - ys), 0.0)
    order = np.argsort(x, axis=1, kind="stable")
    x, y = np.take_along_axis(x, order, axis=1), np.maximum.accumulate(np.take_along_axis(y, order, axis=1), axis=1)
    return [scans.simplified(a, b) for a, b in zip(x, y)]


def follow(signal: DataFrame, up: float, down: float, bounds: tuple[float, float], start: float = 1.0, keys: Keys = ("ch",), size: int = 128, levels: int | None = None) -> DataFrame:
    """(*keys, n, re, gain): gain[n] moves from gain[n - 1] towards v[n] by ``up`` of the
    way where v is above it, else by ``down``; ``start`` before the first sample.
    signal: (*keys, n, re, v); v and start lie within bounds; other n change nothing."""
    blocks = _blocks(signal, keys, size, "re", "v")
    low, high = bounds

    def maps(it):
        for batch in it:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                found = block_maps(_dense(part, size)[0], up, down, low, high)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), part.column("block"), pa.array([m.tolist() for m in found], pa.list_(pa.float64()))], names=[*keys, "block", "map"])

    def samples(it):
        for batch in it:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                v, x, row, at = _dense(part, size)
                now, gain = np.asarray(part.column("state").flatten(), dtype=float), np.empty_like(v)
                for i in range(size):
                    w = np.where(np.isnan(v[:, i]), now, v[:, i])
                    now = now + np.where(w > now, up, down) * (w - now)
                    gain[:, i] = now
                n = np.asarray(part.column("block"), dtype=np.int64)[row] * size + at
                out = _taken(part, keys, row, n, x)
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(gain[row, at])], names=[*out.schema.names, "gain"])

    fields, double = _key_fields(signal, keys), T.DoubleType()
    block = T.StructField("block", T.LongType())
    ends = blocks.mapInArrow(maps, T.StructType([*fields, block, T.StructField("map", T.ArrayType(double))]))
    carried = scans.folded(ends, keys, scans.Monotone(), np.array([start]), levels=levels)
    out = T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("re", double), T.StructField("gain", double)])
    return blocks.join(carried, [*keys, "block"]).select(*keys, "block", "s", "state").mapInArrow(samples, out)


def compressor(
    signal: DataFrame, rate_hz: int, threshold_db: float, ratio: float, attack_s: float, release_s: float, knee_db: float = 0.0, mix: float = 1.0, keys: Keys = ("ch",), levels: int | None = None
) -> DataFrame:
    """(*keys, n, re): gain that each sample's own level asks for, followed by a
    one-pole smoother: the attack's coefficient while the wanted gain is above the
    present one, else that of the release."""
    from sonagrid.operators.kernels import smoothing_coefficient

    up, down = smoothing_coefficient(attack_s, rate_hz), smoothing_coefficient(release_s, rate_hz)
    asked = signal.select(*keys, "n", "re", wanted_gain(F.col("re"), threshold_db, ratio, knee_db).alias("v"))
    bounds = (0.0, 1.0)  # a ratio of 1 or more only ever lowers
    if ratio < 1:
        least, most = asked.agg(F.min("v"), F.max("v")).first()
        bounds = (min(1.0, least or 1.0), max(1.0, most or 1.0))
    followed = follow(asked, up, down, bounds, keys=keys, levels=levels)
    return followed.select(*keys, "n", (F.col("re") * (1.0 - mix + mix * F.col("gain"))).alias("re"))
