"""Levels and level changes. All aggregates are partial first; shares of a
channel's total use one window over the channel."""

from __future__ import annotations

from math import log10, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonagrid.functions import from_db, to_db

Keys = tuple[str, ...]


def rms_dbfs(signal: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    """Level of each channel without its mean, in dBFS."""
    return signal.groupBy(*keys).agg((20.0 * F.log10(F.stddev_pop("re"))).alias("rms_dbfs"))


def peak_dbfs(signal: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    return signal.groupBy(*keys).agg((20.0 * F.log10(F.max(F.abs("re")))).alias("peak_dbfs"))


def crest_factor_db(signal: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    """Peak over level without mean, in dB."""
    return signal.groupBy(*keys).agg((20.0 * F.log10(F.max(F.abs("re")) / F.stddev_pop("re"))).alias("crest_db"))


def energy(signal: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    return signal.groupBy(*keys).agg(F.sum(F.col("re") * F.col("re")).alias("energy"), F.avg(F.col("re") * F.col("re")).alias("power"))


def normalize(signal: DataFrame, to_dbfs: float = 0.0, peak: bool = True, each_channel: bool = False, keys: Keys = ("ch",)) -> DataFrame:
    """Scaled so that the peak or the level is to_dbfs: of each channel, or the largest of all channels."""
    measure = F.max(F.abs("re")) if peak else F.stddev_pop("re")
    if each_channel:
        found = measure.over(Window.partitionBy(*keys))
        return signal.withColumn("re", F.col("re") * (10 ** (to_dbfs / 20) / found))
    per = signal.groupBy(*keys).agg(measure.alias("m")).agg(F.max("m").alias("m"))
    return signal.join(F.broadcast(per), F.lit(True)).withColumn("re", F.col("re") * (10 ** (to_dbfs / 20) / F.col("m"))).drop("m")


def gain(signal: DataFrame, db: float | Column) -> DataFrame:
    return signal.withColumn("re", F.col("re") * from_db(db))


def in_db(signal: DataFrame) -> DataFrame:
    return signal.withColumn("re", to_db("re"))


def _curve(kind: str, i: Column, length: int) -> Column:
    """Value of a fade-in at its sample i of length."""
    x = i / float(max(length - 1, 1))
    if kind == "linear":
        return x
    if kind == "exponential":
        return F.pow(F.lit(10.0), (x - 1.0) * 5.0)
    if kind == "logarithmic":
        top = 50 * sqrt(10)
        return F.log10(1.0 + x * (top - 1.0)) / log10(top)
    raise ValueError(kind)


def fade(signal: DataFrame, length: int, kind: str = "linear", start: bool = True, end: bool = True, keys: Keys = ("ch",)) -> DataFrame:
    """Fade in over the first samples and out over the last ones of each channel."""
    out, re = signal, F.col("re")
    if end:
        out = out.withColumn("__last", F.max("n").over(Window.partitionBy(*keys)))
        back = F.col("__last") - F.col("n")
        re = re * F.when(back < length, _curve(kind, back, length)).otherwise(1.0)
    if start:
        re = re * F.when(F.col("n") < length, _curve(kind, F.col("n"), length)).otherwise(1.0)
    return out.withColumn("re", re).drop("__last")


def detrend(signal: DataFrame, order: int = 1, keys: Keys = ("ch",)) -> DataFrame:
    """Without the mean (order 0) or the regression line (order 1) of each channel."""
    by = Window.partitionBy(*keys)
    if order == 0:
        return signal.withColumn("re", F.col("re") - F.avg("re").over(by))
    n = F.col("n").cast("double")
    slope = F.covar_pop("re", n).over(by) / F.var_pop(n).over(by)
    return signal.withColumn("re", F.col("re") - F.avg("re").over(by) - F.coalesce(slope, F.lit(0.0)) * (n - F.avg(n).over(by)))


def envelope_rms(signal: DataFrame, length: int = 16, keys: Keys = ("ch",)) -> DataFrame:
    """Root of the mean square over the last ``length`` samples, zeros before the first."""
    w = Window.partitionBy(*keys).orderBy("n").rowsBetween(-(length - 1), 0)
    return signal.withColumn("re", F.sqrt(F.sum(F.col("re") * F.col("re")).over(w) / float(length)))


def activity(signal: DataFrame, threshold_dbfs: float, length: int, keys: Keys = ("ch",)) -> DataFrame:
    """signal with active: whether the short-time level relative to the channel's largest reaches the threshold."""
    level = envelope_rms(signal, length, keys).withColumnRenamed("re", "__env")
    top = F.max("__env").over(Window.partitionBy(*keys))
    return level.withColumn("active", to_db(F.col("__env") / top) >= threshold_dbfs).select(*keys, "n", "active")


def calibrate(signal: DataFrame, recording: DataFrame, level_db: float = 94.0, keys: Keys = ("ch",)) -> DataFrame:
    """signal in pascal: a recording of a calibrator of known level gives each channel's factor."""
    pascal = 20e-6 * 10 ** (level_db / 20)
    factor = recording.groupBy(*keys).agg((pascal / F.stddev_pop("re")).alias("__f"))
    return signal.join(factor, list(keys)).withColumn("re", F.col("re") * F.col("__f")).drop("__f")


def quantize(signal: DataFrame, bits: int = 16) -> DataFrame:
    """Rounded to a signed PCM format of bits and back to [-1, 1)."""
    top = float(1 << (bits - 1))
    return signal.withColumn("re", F.greatest(F.lit(-top), F.least(F.lit(top - 1), F.floor(F.col("re") * top + 0.5))) / top)


def dither(signal: DataFrame, bits: int = 16, seed: int = 0, keys: Keys = ("ch",)) -> DataFrame:
    """quantize() with triangular noise of one step on each side."""
    from sonagrid.sources.generators import uniform

    return quantize(signal.withColumn("re", F.col("re") + (uniform(seed, 1, keys) - uniform(seed, 2, keys)) / float(1 << (bits - 1))), bits)
