"""Generated signals: spark.range and column functions, so any length is distributed."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _signal(spark: SparkSession, length: int, value: Column, channels: int = 1) -> DataFrame:
    base = spark.range(length).select(F.col("id").alias("n"))
    return base.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(channels - 1).cast("long"))).alias("ch"), "n").select("ch", "n", value.cast("double").alias("re"))


def _turns(frequency_hz: float, rate_hz: int) -> Column:
    return F.col("n") * (frequency_hz / rate_hz)


def sine(spark, frequency_hz: float, rate_hz: int, length: int, phase: float = 0.0, channels: int = 1) -> DataFrame:
    return _signal(spark, length, F.sin(2 * pi * _turns(frequency_hz, rate_hz) + phase), channels)


def square(spark, frequency_hz: float, rate_hz: int, length: int) -> DataFrame:
    """1 in the first half of each period, -1 in the second."""
    t = _turns(frequency_hz, rate_hz)
    return _signal(spark, length, F.when(t - F.floor(t) < 0.5, 1.0).otherwise(-1.0))


def sawtooth(spark, frequency_hz: float, rate_hz: int, length: int) -> DataFrame:
    t = _turns(frequency_hz, rate_hz)
    return _signal(spark, length, 2.0 * (t - F.floor(t)) - 1.0)


def triangle(spark, frequency_hz: float, rate_hz: int, length: int) -> DataFrame:
    t = _turns(frequency_hz, rate_hz)
    return _signal(spark, length, 1.0 - 4.0 * F.abs(t - F.floor(t) - 0.5))


def harmonic(spark, frequency_hz: float, rate_hz: int, length: int, shape: str = "sawtooth") -> DataFrame:
    """Band-limited oscillator: the harmonics of the shape below half the rate."""
    top = int((rate_hz / 2 - 1e-9) // frequency_hz)
    odd = range(1, top + 1, 2)
    weights = {
        "sawtooth": [(k, -2 / pi * (-1) ** k / k) for k in range(1, top + 1)],
        "square": [(k, 4 / pi / k) for k in odd],
        "triangle": [(k, 8 / pi**2 * (-1) ** ((k - 1) // 2) / k**2) for k in odd],
    }[shape]
    total = F.lit(0.0)
    for k, w in weights:
        total = total + w * F.sin(2 * pi * k * _turns(frequency_hz, rate_hz))
    return _signal(spark, length, total)


def dirac(spark, length: int, delay: int = 0) -> DataFrame:
    return _signal(spark, length, F.when(F.col("n") == delay, 1.0).otherwise(0.0))


def chirp(spark, low_hz: float, high_hz: float, rate_hz: int, length: int, logarithmic: bool = True) -> DataFrame:
    """A sweep from low_hz to high_hz, exponential or linear in time."""
    t, total = F.col("n") / float(rate_hz), length / rate_hz
    if logarithmic:
        k = total / log(high_hz / low_hz)
        phase = 2 * pi * low_hz * k * (F.exp(t / k) - 1.0)
    else:
        phase = 2 * pi * (low_hz * t + (high_hz - low_hz) / (2 * total) * t * t)
    return _signal(spark, length, F.sin(phase))


def uniform(seed: int, draw: int, keys: tuple[str, ...] = ("ch",)) -> Column:
    """A number in (0, 1) for each (seed, draw, *keys, n): the same on every partitioning, and in any engine that has MD5."""
    name = F.concat_ws(":", F.lit(str(seed)), F.lit(str(draw)), *[F.col(k).cast("string") for k in (*keys, "n")])
    return (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def noise(spark, length: int, channels: int = 1, seed: int = 0) -> DataFrame:
    """White Gaussian noise by Box-Muller from hashes of (seed, ch, n)."""
    return _signal(spark, length, F.sqrt(-2.0 * F.log(uniform(seed, 1))) * F.cos(2 * pi * uniform(seed, 2)), channels)


def synchronised_chirp(spark, low_hz: float, high_hz: float, rate_hz: int, length: int) -> DataFrame:
    """An exponential sweep whose rate is such that each harmonic of it is the sweep itself, earlier by a whole number of the lowest frequency's periods."""
    turns = max(1, round(low_hz * (length / rate_hz) / log(high_hz / low_hz)))
    t = F.col("n") / float(rate_hz)
    return _signal(spark, length, F.sin(2 * pi * turns * (F.exp(t * low_hz / turns) - 1.0)))
