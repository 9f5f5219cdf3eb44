"""Impulse responses: windows, deconvolution, distortion, phase."""

from __future__ import annotations

from math import pi

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonagrid.operators import kernels as ke

Keys = tuple[str, ...]


def peak(ir: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    """(peak): index of the largest absolute sample, the first of equals."""
    return ir.groupBy(*keys).agg((-F.max(F.struct(F.abs("re").alias("a"), (-F.col("n")).alias("i"))).getField("i")).alias("peak"))


def tukey_like(n: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """0 before a, Hann flank to b, 1 to c, Hann flank to d, 0 behind."""
    rise = 0.5 - 0.5 * F.cos(pi * (n - a) / (b - a))
    fall = 0.5 + 0.5 * F.cos(pi * (n - c) / (d - c))
    return F.when((n < a) | (n > d), 0.0).when(n < b, rise).when(n <= c, 1.0).otherwise(fall)


def window_around_peak(ir: DataFrame, before: int, after: int, flank: float = 0.5, keys: Keys = ("ch",)) -> DataFrame:
    """Weighted from before to after the peak; flank is the share of each side that rises or falls."""
    at = peak(ir, keys)
    p, n = F.col("peak"), F.col("n")
    w = tukey_like(n, p - before, p - round(before * (1 - flank)), p + round(after * (1 - flank)), p + after)
    return ir.join(at, list(keys)).withColumn("re", F.col("re") * w).select(*keys, "n", "re")


def centred(ir: DataFrame, length: int, keys: Keys = ("ch",)) -> DataFrame:
    """length samples with the peak in the middle; zeros where the input has none."""
    at = peak(ir, keys)
    m = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long")))
    grid = at.select(*keys, "peak", m.alias("m")).withColumn("n", F.col("m") - length // 2 + F.col("peak"))
    return grid.join(ir, [*keys, "n"], "left").select(*keys, F.col("m").alias("n"), F.coalesce("re", F.lit(0.0)).alias("re"))


def deconvolve(signal: DataFrame, source, rate_hz: int, low_hz: float, high_hz: float, keys: Keys = ("ch",)) -> DataFrame:
    """Impulse responses from channel source to all others: spectra divided, with
    a penalty outside of the band that keeps the quotient finite."""
    spectra = ke.fft_spectrum(signal, rate_hz, keys)
    den = spectra.where(F.col("ch") == source).select("k", F.col("re").alias("a"), F.col("im").alias("b"))
    outside = F.when(F.col("f_hz").between(low_hz, high_hz), 0.0).otherwise(1000.0)
    both = spectra.where(F.col("ch") != source).join(den, "k")
    size = F.expr("a * a + b * b") + outside + 1e-12
    quotient = both.select(*keys, "k", (F.expr("re * a + im * b") / size).alias("re"), (F.expr("im * a - re * b") / size).alias("im"))
    return inverse(quotient, keys)


def inverse(spectrum: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    """Real signals of whole one-sided spectra (even lengths), by fast transforms."""
    rows = spectrum.select(*keys, F.col("k").cast("long").alias("n"), F.explode(F.array(F.struct(F.lit(0).alias("p"), F.col("re").alias("v")), F.struct(F.lit(1).alias("p"), F.col("im").alias("v")))).alias("c"))
    flat = rows.select(*keys, (F.col("n") * 2 + F.col("c.p")).alias("n"), F.col("c.v").alias("re"))
    return ke.mapped(flat, lambda v: np.fft.irfft(v[0::2] + 1j * v[1::2]), keys)


def harmonic_windows(spark, rate_hz: int, length: int, low_hz: float, high_hz: float, sweep_s: float, harmonics: int) -> DataFrame:
    """(harmonic, n0): where the harmonics of an exponential sweep arrive in the deconvolved response (circular)."""
    k = F.col("harmonic")
    ahead = sweep_s * F.log(k) / float(np.log(high_hz / low_hz))
    return spark.range(2, harmonics + 2).select(F.col("id").alias("harmonic")).select("harmonic", F.pmod(-F.round(ahead * rate_hz).cast("long"), F.lit(length)).alias("n0"))


def total_harmonic_distortion(power: DataFrame, fundamental_k: int, harmonics: int = 5, keys: Keys = ("ch",)) -> DataFrame:
    """(thd): root of the harmonics' power over the fundamental's, from (k, power)."""
    h = F.sum(F.when(F.col("k").isin(*[fundamental_k * i for i in range(2, harmonics + 2)]), F.col("power")).otherwise(0.0))
    f = F.sum(F.when(F.col("k") == fundamental_k, F.col("power")).otherwise(0.0))
    return power.groupBy(*keys).agg(F.sqrt(h / f).alias("thd"))


def noise_and_distortion(power: DataFrame, fundamental_k: int, keys: Keys = ("ch",)) -> DataFrame:
    """(thd_n): root of all other power but the mean's over the fundamental's."""
    rest = F.sum(F.when((F.col("k") != fundamental_k) & (F.col("k") > 0), F.col("power")).otherwise(0.0))
    f = F.sum(F.when(F.col("k") == fundamental_k, F.col("power")).otherwise(0.0))
    return power.groupBy(*keys).agg(F.sqrt(rest / f).alias("thd_n"))


def average(ir: DataFrame, keys: Keys = ()) -> DataFrame:
    """Mean over channels after each one's peak is moved to the earliest peak."""
    at = peak(ir, ("ch",))
    first = at.agg(F.min("peak").alias("first"))
    moved = ir.join(at, "ch").join(F.broadcast(first), F.lit(True)).withColumn("n", F.col("n") - F.col("peak") + F.col("first"))
    count = ir.agg(F.countDistinct("ch").alias("c"))
    return moved.groupBy("n").agg(F.sum("re").alias("s")).join(F.broadcast(count), F.lit(True)).select("n", (F.col("s") / F.col("c")).alias("re"))


def linear_phase(magnitude: DataFrame, length: int, keys: Keys = ("ch",)) -> DataFrame:
    """Symmetric response of (k, value) magnitudes, delayed by half its length."""
    turn = F.pmod(F.col("k") * (length // 2), F.lit(length)) * (-2 * pi / length)
    return inverse(magnitude.select(*keys, "k", (F.col("value") * F.cos(turn)).alias("re"), (F.col("value") * F.sin(turn)).alias("im")), keys)


def excess_group_delay(ir: DataFrame, rate_hz: int, keys: Keys = ("ch",)) -> DataFrame:
    """(k, delay_s): group delay less that of the minimum-phase response with the same magnitude."""
    from sonagrid.operators.spectra import group_delay

    whole = group_delay(ke.fft_spectrum(ir, rate_hz, keys), keys)
    least = group_delay(ke.fft_spectrum(ke.minimum_phase(ir, keys), rate_hz, keys), keys).withColumnRenamed("delay_s", "least")
    return whole.join(least, [*keys, "k"]).select(*keys, "k", (F.col("delay_s") - F.col("least")).alias("delay_s"))


def with_impulse(ir: DataFrame, f_hz: float, rate_hz: int, below: bool = True, order: int = 2, keys: Keys = ("ch",)) -> DataFrame:
    """The response kept on one side of a crossover, a unit impulse at its peak on the other."""
    at = peak(ir, keys)
    unit = ir.join(at, list(keys)).select(*keys, "n", F.when(F.col("n") == F.col("peak"), 1.0).otherwise(0.0).alias("re"))
    low, high = ke.butterworth(order, f_hz, rate_hz), ke.butterworth(order, f_hz, rate_hz, True)
    kept, other = (low, high) if below else (high, low)
    a, b = ke.iir(ir, np.vstack([kept, kept]), keys), ke.iir(unit, np.vstack([other, other]), keys)
    return a.unionByName(b).groupBy(*keys, "n").agg(F.sum("re").alias("re"))


def trim_to_noise_floor(ir: DataFrame, window: int, margin_db: float = 10.0, keys: Keys = ("ch",)) -> DataFrame:
    """From the first sample to the end of the last block whose level is margin_db
    above the floor, the median level of the last tenth of blocks."""
    block = F.floor(F.col("n") / window)
    level = ir.groupBy(*keys, block.alias("block")).agg((10.0 * F.log10(F.greatest(F.avg(F.col("re") * F.col("re")), F.lit(1e-30)))).alias("l"))
    ranked = level.withColumn("last", F.max("block").over(Window.partitionBy(*keys)))
    floor = ranked.where("block >= 0.9 * last").groupBy(*keys).agg(F.percentile("l", 0.5).alias("floor"))
    end = ranked.join(floor, list(keys)).groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("l") > F.col("floor") + margin_db, F.col("block"))), F.max("block")).alias("end"))
    return ir.join(end, list(keys)).where(block <= F.col("end")).select(*keys, "n", "re")


def frequency_dependent_window(ir: DataFrame, frequencies: list[float], cycles: float, rate_hz: int, keys: Keys = ("ch",)) -> DataFrame:
    """(f_hz, re, im): at each frequency the transform under a Gaussian of so many of its cycles around the peak."""
    spark = ir.sparkSession
    table = spark.createDataFrame([(float(f),) for f in frequencies], "f_hz double")
    both = ir.join(peak(ir, keys), list(keys)).join(F.broadcast(table), F.lit(True))
    t = (F.col("n") - F.col("peak")) / float(rate_hz)
    w = F.exp(-0.5 * F.pow(t * F.col("f_hz") / (cycles / 2), F.lit(2.0)))
    angle = -2 * pi * F.col("f_hz") * t
    return both.groupBy(*keys, "f_hz").agg(F.sum(F.col("re") * w * F.cos(angle)).alias("re"), F.sum(F.col("re") * w * F.sin(angle)).alias("im"))


def minimum_phase_from_magnitude(magnitude: DataFrame, length: int, keys: Keys = ("ch",)) -> DataFrame:
    """(*keys, n, re): the response of ``length`` samples with least delay whose spectrum has the
    magnitudes (k, value): logarithm, cepstrum, its second half folded onto the first, and back."""
    from sonagrid.operators.spectra import dft, idft

    level = magnitude.select(*keys, "k", F.log(F.greatest("value", F.lit(1e-12))).alias("re"), F.lit(0.0).alias("im"))
    cepstrum = idft(level, length, keys)
    fold = F.when((F.col("n") == 0) | (2 * F.col("n") == length), 1.0).when(2 * F.col("n") < length, 2.0).otherwise(0.0)
    folded = dft(cepstrum.withColumn("re", F.col("re") * fold), length, 1, keys)
    size = F.exp("re")
    return idft(folded.select(*keys, "k", (size * F.cos("im")).alias("re"), (size * F.sin("im")).alias("im")), length, keys)
