"""Frames: overlapping stretches of a signal as rows (frame, m, x)."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = tuple[str, ...]


def frame_count(length: int, window: int, hop: int, padded: bool) -> int:
    """Number of frames; without padding only those that begin before length - window."""
    return ceil(length / hop) if padded else max(0, ceil((length - window) / hop))


def frames(signal: DataFrame, window: int, hop: int, padded: bool = False, keys: Keys = ("ch",)) -> DataFrame:
    """(frame, m, x): sample m of each frame. Sample n is in the frames
    floor((n - window) / hop) + 1 to floor(n / hop); padded adds zeros behind the
    end, else frames that reach beyond it are left out. The channel's length
    comes by a window over the channel, the frames by exploding each sample."""
    length = F.max("n").over(Window.partitionBy(*keys)) + 1
    n = F.col("n")
    count = F.ceil(F.col("__len") / hop) if padded else F.greatest(F.lit(0), F.ceil((F.col("__len") - window) / hop))
    first, last = F.greatest(F.lit(0), F.floor((n - window) / hop) + 1), F.least(F.floor(n / hop), count - 1)
    some = signal.withColumn("__len", length).where(last >= first)
    out = some.withColumn("frame", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    out = out.select(*keys, "frame", (n - F.col("frame") * hop).cast("int").alias("m"), F.col("re").alias("x"))
    return out


def window_weight(kind: str, m: Column, length: int) -> Column:
    """Periodic window of length at sample m."""
    from math import pi

    angle = m * (2 * pi / length)
    if kind == "boxcar":
        return F.lit(1.0)
    if kind == "hann":
        return 0.5 - 0.5 * F.cos(angle)
    if kind == "hamming":
        return 0.54 - 0.46 * F.cos(angle)
    if kind == "blackman":
        return 0.42 - 0.5 * F.cos(angle) + 0.08 * F.cos(2 * angle)
    raise ValueError(kind)


def windowed(framed: DataFrame, kind: str, length: int, detrend: bool = False, keys: Keys = ("ch",)) -> DataFrame:
    """x times the window; detrend then takes the mean of the windowed frame away."""
    out = framed.withColumn("x", F.col("x") * window_weight(kind, F.col("m"), length))
    if detrend:
        mean = F.sum("x").over(Window.partitionBy(*keys, "frame")) / float(length)
        out = out.withColumn("x", F.col("x") - mean)
    return out


def frame_statistics(framed: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    return framed.groupBy(*keys, "frame").agg(F.avg("x").alias("mean"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.max(F.abs("x")).alias("peak"))


def zero_crossings(framed: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    """Sign changes of each frame (zero counts as positive)."""
    w = Window.partitionBy(*keys, "frame").orderBy("m")
    sign = F.col("x") >= 0
    marked = framed.withColumn("__z", (sign != F.lag(sign).over(w)).cast("int"))
    return marked.groupBy(*keys, "frame").agg(F.coalesce(F.sum("__z"), F.lit(0)).cast("long").alias("crossings"))


def overlap_add(framed: DataFrame, hop: int, kind: str = "boxcar", length: int | None = None, floor: float = 1e-4, keys: Keys = ("ch",)) -> DataFrame:
    """(n, re): frames summed in place and divided by the summed squared window."""
    w = window_weight(kind, F.col("m"), length or 1)
    placed = framed.select(*keys, (F.col("frame") * hop + F.col("m")).cast("long").alias("n"), (F.col("x") * w).alias("y"), (w * w).alias("w"))
    return placed.groupBy(*keys, "n").agg((F.sum("y") / F.greatest(F.sum("w"), F.lit(floor))).alias("re"))
