"""Finite responses of a wanted group delay and magnitude, and those that make a measured phase linear.

Delays of a channel are rows by bin, which meet their neighbours in windows over blocks of bins.
A channel whose transform a row may hold (long_fft.WHOLE) is one row of delays, and many go through
numpy at once: its finer bins are never rows. In longer ones the delay becomes a phase by a running
sum over blocks (scans), and the response comes from transforms in rounds (long_fft), so no task
holds such a channel's spectrum.
"""

from __future__ import annotations

from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonagrid.operators import long_fft, scans
from sonagrid.state import kept

Keys = tuple[str, ...]

#: A transform shorter than so many times the longest delay is made longer, and its spectrum interpolated.
FINER = 10

#: Bins of a channel in one window.
BLOCK = 1 << 16


def beside(rows: DataFrame, keys: Keys, order: str, values: tuple[str, ...], offsets: tuple[int, ...]) -> DataFrame:
    """(*keys, order, values, and for each value v and offset o a column v_o, with a minus as m):
    the values of the rows at order + o, null where there is none. Orders are unique in their channel."""
    name = lambda v, o: f"{v}_{o}".replace("-", "m")
    block = lambda at: F.floor(at / BLOCK)
    # a row goes to its own block, and at a block's ends to those of its neighbours too
    to = F.array_distinct(F.array(block(F.col(order)), *[block(F.col(order) - o) for o in offsets]))
    sent = rows.select(*keys, order, *values, F.explode(to).alias("block"))
    near = Window.partitionBy(*keys, "block").orderBy(order)
    # orders may lack numbers: the row at order + o is one of the next |o|
    steps = lambda o: [i if o > 0 else -i for i in range(1, abs(o) + 1)]
    at = lambda v, o: F.coalesce(*[F.when(F.lead(order, i).over(near) == F.col(order) + o, F.lead(v, i).over(near)) for i in steps(o)])
    met = sent.select(*keys, order, *values, "block", *[at(v, o).alias(name(v, o)) for v in values for o in offsets])
    return met.where(F.col("block").eqNullSafe(block(F.col(order)))).drop("block")


def delay_of_phase(spectrum: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    """(*keys, k, delay): negative slope of the unwrapped phase in radians a bin, the mean of both
    sides' steps, at the ends the only one. Bins 0 to the last must be there; one bin alone has null."""
    near = beside(spectrum.select(*keys, F.col("k").cast("long").alias("k"), "re", "im"), keys, "k", ("re", "im"), (-1, 1))
    step = lambda r0, i0, r1, i1: F.expr(f"atan2({r0} * {i1} - {i0} * {r1}, {r0} * {r1} + {i0} * {i1})")
    steps = F.array_compact(F.array(step("re_m1", "im_m1", "re", "im"), step("re", "im", "re_1", "im_1")))
    return near.select(*keys, "k", F.when(F.size(steps) > 0, -F.aggregate(steps, F.lit(0.0), lambda a, v: a + v) / F.size(steps)).alias("delay"))


def _end_slope(inner: Column, next_: Column) -> Column:
    """Slope at an end from the steps of the two intervals next to it, kept from overshooting."""
    slope = (3 * inner - F.coalesce(next_, inner)) / 2
    limited = F.when((F.signum(inner) != F.signum(next_)) & (F.abs(slope) > 3 * F.abs(inner)), 3 * inner).otherwise(slope)
    return F.when(F.signum(slope) != F.signum(inner), F.lit(0.0)).otherwise(limited)


def _monotone(v: str, u: Column) -> Column:
    """Shape-preserving cubic between v and v_1, at u from 0 to 1, of equally spaced values v_m1, v, v_1, v_2."""
    before, here, after = F.col(v) - F.col(f"{v}_m1"), F.col(f"{v}_1") - F.col(v), F.col(f"{v}_2") - F.col(f"{v}_1")
    harmonic = lambda a, b: F.when(a * b > 0, 2 * a * b / (a + b)).otherwise(F.lit(0.0))
    left = F.when(before.isNull(), _end_slope(here, after)).otherwise(harmonic(before, here))
    right = F.when(after.isNull(), _end_slope(here, before)).otherwise(harmonic(here, after))
    t = 1 - u
    return F.col(v) * (1 + 2 * u) * t * t + left * u * t * t + F.col(f"{v}_1") * u * u * (3 - 2 * u) - right * u * u * t


def _integrated(bins: DataFrame, keys: Keys, simpson: bool) -> DataFrame:
    """bins (*keys, size, late, j, delay, magnitude) with the phase: minus the running integral of the delay from bin 0."""
    if simpson:
        near = beside(bins, keys, "j", ("delay", "magnitude", "size", "late"), (-2, -1, 1)).drop(*[f"{v}_{o}" for v in ("magnitude", "size", "late") for o in ("m2", "m1", "1")])
        # parabolas over pairs of intervals; the first of a pair looks ahead, the second and the last one back
        ahead = F.expr("(5 * delay_m1 + 8 * delay - delay_1) / 12")
        back = F.expr("(5 * delay + 8 * delay_m1 - delay_m2) / 12")
        part = F.when(F.col("delay_m1").isNull(), F.lit(0.0)).when((F.col("j") % 2 == 1) & F.col("delay_1").isNotNull(), ahead).otherwise(F.coalesce(back, F.expr("(delay + delay_m1) / 2")))
        bins = near.withColumn("part", part)
    else:
        bins = bins.withColumn("part", F.col("delay"))
    summed = scans.before(bins, keys, "j", "part", F.sum, "ahead")
    whole = F.coalesce("ahead", F.lit(0.0)) + F.col("part")
    # trapezoids: half of the first and of the last value of a sum too many
    return summed.withColumn("phase", -whole if simpson else -(whole - (F.col("delay") + F.col("first")) / 2))


def _slopes(delay: np.ndarray) -> np.ndarray:
    """Slopes of _monotone at all bins of each line."""
    steps = np.diff(delay)
    a, b = steps[:, :-1], steps[:, 1:]
    inside = np.where(np.isnan(a * b), np.nan, 0.0)
    np.divide(2 * a * b, a + b, out=inside, where=a * b > 0)

    def end(inner: np.ndarray, next_: np.ndarray) -> np.ndarray:
        slope = (3 * inner - next_) / 2
        limited = np.where((np.sign(inner) != np.sign(next_)) & (abs(slope) > 3 * abs(inner)), 3 * inner, slope)
        return np.where(np.sign(slope) != np.sign(inner), 0.0, limited)

    return np.column_stack([end(steps[:, 0], steps[:, 1]), inside, end(steps[:, -1], steps[:, -2])])


def _phases(delay: np.ndarray, simpson: bool) -> np.ndarray:
    """_integrated for lines of bins."""
    if not simpson:
        return -(np.cumsum(delay, axis=1) - (delay + delay[:, :1]) / 2)
    part = np.zeros(delay.shape)
    part[:, 1] = (delay[:, 1] + delay[:, 0]) / 2
    part[:, 2:] = (5 * delay[:, 2:] + 8 * delay[:, 1:-1] - delay[:, :-2]) / 12
    part[:, 1:-1:2] = ((5 * delay[:, :-2] + 8 * delay[:, 1:-1] - delay[:, 2:]) / 12)[:, ::2]
    return -np.cumsum(part, axis=1)


def _responses(delay: np.ndarray, power: np.ndarray, length: int, size: int, simpson: bool, integer_delay: bool) -> tuple[np.ndarray, np.ndarray]:
    """Lines of bins to lines of ``size`` samples, and the samples that integer_delay makes a line longer."""
    j = np.arange(size // 2 + 1)
    k = np.minimum(j * length // size, length // 2 - 1)
    u = j * float(length) / size - k
    t = 1 - u

    def finer(v: np.ndarray) -> np.ndarray:
        m = _slopes(v)
        return v[:, k] * (1 + 2 * u) * t * t + m[:, k] * u * t * t + v[:, k + 1] * u * u * (3 - 2 * u) - m[:, k + 1] * u * u * t

    phase = _phases(finer(delay) * (length / size), simpson)
    longer = np.zeros(len(delay), dtype=np.int64)
    if integer_delay and size % 2 == 0:
        over = np.mod(phase[:, -1:], pi)
        phase = phase - over * 2 * j / size
        longer += over[:, 0] > pi / 2
    bins = np.sqrt(np.maximum(0.0, finer(power))) * np.exp(1j * phase)
    # of the first and, of an even number, the last bin the real part counts
    return np.fft.irfft(bins, size, axis=1), longer


def _whole(rows: DataFrame, keys: Keys, length: int, additional: int | None, simpson: bool, integer_delay: bool) -> DataFrame:
    """(*keys, n, re) from (*keys, size, late, bins of (k, delay, power)), a channel for each row."""
    bins = length // 2 + 1

    def run(it):
        for batch in it:
            batch = batch.take(pa.array(np.argsort(np.asarray(batch.column("size")), kind="stable")))
            lists, sizes, late = batch.column("bins"), np.asarray(batch.column("size")), np.asarray(batch.column("late"))
            flat, counts = lists.flatten(), np.asarray(lists.value_lengths(), dtype=np.int64)
            first, line = np.concatenate([[0], np.cumsum(counts)]), np.repeat(np.arange(len(counts)), counts)
            k, *values = (np.asarray(flat.field(x)) for x in ("k", "delay", "power"))
            at = 0
            while at < batch.num_rows:
                # channels of one size, some 2^18 values at once
                size = int(sizes[at])
                to = min(int(np.searchsorted(sizes, size, "right")), at + max(1, (1 << 18) // size))
                own = slice(first[at], first[to])
                # bins that are not there make a response of nan, of those that are there twice the larger value counts
                delay, power = np.full((2, (to - at) * bins), np.nan)
                for x, v in zip((delay, power), values):
                    np.fmax.at(x, (line[own] - at) * bins + k[own], v[own])
                y, longer = _responses(delay.reshape(-1, bins), power.reshape(-1, bins), length, size, simpson, integer_delay)
                samples = np.full(to - at, size) if additional is None else np.minimum(size, late[at:to] + 1 + longer + additional)
                there = np.arange(size) < samples[:, None]
                take = pa.array(np.repeat(np.arange(at, to), samples))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in keys), pa.array(np.nonzero(there)[1]), pa.array(y[there])], names=[*keys, "n", "re"])
                at = to

    return rows.select(*keys, "size", "late", "bins").mapInArrow(run, T.StructType([*(rows.schema[c] for c in keys), T.StructField("n", T.LongType()), T.StructField("re", T.DoubleType())]))


def _named(rows: DataFrame, keys: Keys) -> DataFrame:
    """rows of channels; a null key is none."""
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    return rows


def _late(delay: Column, length: int) -> Column:
    """Samples of the longest delay, in radians a bin."""
    return F.greatest(F.lit(0), (delay * (length / 2 / pi) + 1).cast("long"))


def _size(late: Column, length: int) -> Column:
    """The transform's length."""
    finer = late * FINER + 1
    return F.when(late * FINER > length, finer + finer % 2).otherwise(F.lit(length)).cast("long")


def designed(targets: DataFrame, length: int, rate_hz: float, more_s: float = 0.0, additional: int | None = 0, simpson: bool = False, integer_delay: bool = False, keys: Keys = ("ch",)) -> DataFrame:
    """(*keys, n, re): for each channel a response whose group delay follows (*keys, k, delay_s, and
    magnitude if there is one) on all bins k from 0 to length // 2.

    more_s is added to all delays. The response ends ``additional`` samples behind the longest
    delay, or is whole (None). A transform less than FINER times as long as the longest
    delay is made that long; delays and powers are then interpolated by shape-preserving cubics.
    simpson integrates by parabolas instead of trapezoids. integer_delay turns the
    phase so that it is a multiple of pi at the highest of an even number's bins. A null delay counts
    as none, a null magnitude as 0. Bins of channels too long for a row are written to the shared
    folder once (state.kept); whether there are any, the longest of all delays tells.
    """
    return _designed(targets, length, rate_hz, more_s, additional, simpson, integer_delay, keys)


def _designed(targets: DataFrame, length: int, rate_hz: float, more_s: float, additional: int | None, simpson: bool, integer_delay: bool, keys: Keys, most: float | None = None, whole: int | None = None) -> DataFrame:
    """designed(); most: what no delay passes, in radians a bin, where that is known."""
    whole = long_fft.WHOLE if whole is None else whole
    if more_s < 0 or (additional is not None and additional < 0):
        raise ValueError("a delay or length to be added is negative")
    if length < 4:
        raise ValueError("a design needs a length of 4 samples or more")
    magnitude = F.col("magnitude") if "magnitude" in targets.columns else F.lit(1.0)
    unit = 2 * pi * rate_hz / length
    rows = _named(targets, keys).where(F.col("k") <= length // 2).select(
        *keys,
        F.col("k").cast("long").alias("k"),
        ((F.coalesce("delay_s", F.lit(0.0)) + more_s) * unit).alias("delay"),
        F.pow(F.coalesce(magnitude, F.lit(0.0)), 2).alias("power"),
    )
    if length > whole:
        return _in_rounds(rows, length, additional, simpson, integer_delay, keys)
    if most is None:
        most = rows.agg(F.max("delay")).first()[0] or 0.0
    channels = rows.groupBy(*keys).agg(_late(F.max("delay"), length).alias("late"), F.collect_list(F.struct("k", "delay", "power")).alias("bins")).withColumn("size", _size(F.col("late"), length))
    # a sample more, for what rounding may add
    if (most * (length / 2 / pi) + 2) * FINER + 2 <= whole:
        return _whole(channels, keys, length, additional, simpson, integer_delay)
    short = _whole(channels.where(F.col("size") <= whole), keys, length, additional, simpson, integer_delay)
    return short.unionByName(_in_rounds(channels.where(F.col("size") > whole).select(*keys, F.inline("bins")), length, additional, simpson, integer_delay, keys))


def _in_rounds(rows: DataFrame, length: int, additional: int | None, simpson: bool, integer_delay: bool, keys: Keys) -> DataFrame:
    """(*keys, n, re) from (*keys, k, delay, power) for channels of any length."""
    sizes = rows.groupBy(*keys).agg(_late(F.max("delay"), length).alias("late"), F.min_by("delay", "k").alias("first")).withColumn("size", _size(F.col("late"), length))
    last = length // 2 - 1
    near = beside(rows, keys, "k", ("delay", "power"), (-1, 1, 2)).where(F.col("k") <= last).join(sizes, list(keys))
    start = lambda k: F.expr(f"({k} * size + {length - 1}) div {length}")
    end = F.when(F.col("k") == last, F.expr("size div 2")).otherwise(start("(k + 1)") - 1)
    u = F.col("j") * F.lit(float(length)) / F.col("size") - F.col("k")
    scale = F.lit(float(length)) / F.col("size")
    bins = near.withColumn("j", F.explode(F.sequence(start("k"), end))).select(
        *keys, "size", "late", "j", (F.col("first") * scale).alias("first"), (_monotone("delay", u) * scale).alias("delay"), F.sqrt(F.greatest(F.lit(0.0), _monotone("power", u))).alias("magnitude")
    )
    # the transform reads them several times
    bins = kept(_integrated(bins, keys, simpson).select(*keys, "size", "late", "j", "phase", "magnitude"))
    longer = F.lit(0)
    if integer_delay:
        ends = bins.where("2 * j = size").select(*keys, F.col("phase").alias("last"))
        bins = bins.join(ends, list(keys), "left")
        over = F.pmod(F.col("last"), F.lit(pi))
        turned = F.col("phase") - over * 2 * F.col("j") / F.col("size")
        # a delay of up to one sample more, for which the response gets one where it is over a half
        longer = F.when(over > pi / 2, 1).otherwise(0)
        bins = bins.withColumn("phase", F.coalesce(turned, F.col("phase")))
    sure = (F.col("j") == 0) | (2 * F.col("j") == F.col("size"))
    re, im = F.col("magnitude") * F.cos("phase"), F.when(sure, F.lit(0.0)).otherwise(F.col("magnitude") * F.sin("phase"))
    both = F.when(sure, F.array(F.struct(F.col("j").alias("k"), im.alias("im")))).otherwise(F.array(F.struct(F.col("j").alias("k"), im.alias("im")), F.struct((F.col("size") - F.col("j")).alias("k"), (-im).alias("im"))))
    out = long_fft.fft(bins.select(*keys, re.alias("re"), F.inline(both)), keys, inverse=True).select(*keys, "n", "re")
    if additional is None:
        return out
    lengths = bins.groupBy(*keys).agg(F.max(F.col("late") + 1 + longer + additional).alias("samples"))
    return out.join(lengths, list(keys)).where("n < samples").select(*keys, "n", "re")


def linearized(spectrum: DataFrame, length: int, rate_hz: float, increase: float = 1.0, additional: int | None = 0, simpson: bool = False, integer_delay: bool = False, keys: Keys = ("ch",)) -> DataFrame:
    """(*keys, n, re): the response that turns each channel's phase into a constant delay of
    1 + increase times its longest. spectrum (*keys, k, re, im) has bins 0 to length // 2; bins beyond are left out."""
    if increase < 0:
        raise ValueError("the delay cannot get shorter")
    delays = delay_of_phase(_named(spectrum, keys).where(F.col("k") <= length // 2), keys)
    if length <= long_fft.WHOLE:
        of = Window.partitionBy(*keys)
        both = delays.withColumns({"longest": F.max("delay").over(of), "bins": F.count(F.lit(1)).over(of)})
    else:
        both = delays.join(delays.groupBy(*keys).agg(F.max("delay").alias("longest"), F.count(F.lit(1)).alias("bins")), list(keys))
    unit = length / (2 * pi * rate_hz)
    targets = both.select(*keys, "k", ((F.col("longest") * (1 + increase) - F.col("delay")) * unit).alias("delay_s"), F.assert_true(F.col("bins") == length // 2 + 1, "a channel lacks bins of its length").alias("whole"))
    # a step of the phase is half a turn at most
    return _designed(targets.where("whole is null").drop("whole"), length, rate_hz, 0.0, additional, simpson, integer_delay, keys, most=(2 + increase) * pi)
