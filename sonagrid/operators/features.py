"""Perceptual and spectral features from power spectra (k, f_hz, power)."""

from __future__ import annotations

from math import cos, log, log10, pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Keys = tuple[str, ...]


def mel_weights(n_bins: int, rate_hz: int, bands: int, low_hz: float = 20.0, high_hz: float | None = None) -> list[tuple[int, int, float]]:
    """(band, k, weight): triangles between mel-spaced bins, each of sum 1."""
    mel = lambda f: 2595 * log10(1 + f / 700)
    high_hz = high_hz or rate_hz / 2
    step = (mel(high_hz) - mel(low_hz)) / (bands + 1)
    hz = [700 * (10 ** ((mel(low_hz) + i * step) / 2595) - 1) for i in range(bands + 2)]
    at = [min(n_bins - 1, round(f * 2 * (n_bins - 1) / rate_hz)) for f in hz]
    out = []
    for b in range(bands):
        a, c, e = at[b], at[b + 1], at[b + 2]
        raw = {k: ((k - a) / max(c - a, 1) if k < c else (e - k) / max(e - c, 1)) for k in range(a, e)}
        raw = {k: w for k, w in raw.items() if w > 0} or {c: 1.0}
        total = sum(raw.values())
        out += [(b, k, w / total) for k, w in raw.items()]
    return out


def weighted_bands(power: DataFrame, weights: list[tuple[int, int, float]], keys: Keys = ("ch",)) -> DataFrame:
    """(band, energy): bins times a small table of weights, summed by band."""
    spark = power.sparkSession
    table = spark.createDataFrame(weights, "band int, k int, w double")
    return power.join(F.broadcast(table), "k").groupBy(*keys, "band").agg(F.sum(F.col("power") * F.col("w")).alias("energy"))


def cepstral_coefficients(bands: DataFrame, n_bands: int, count: int, keys: Keys = ("ch",)) -> DataFrame:
    """(c, value): absolute unnormalised cosine transform of the bands' log energies."""
    spark = bands.sparkSession
    table = spark.createDataFrame([(b, c, 2 * cos(pi * c * (2 * b + 1) / (2 * n_bands))) for b in range(n_bands) for c in range(count)], "band int, c int, w double")
    level = 10.0 * F.log10(F.greatest("energy", F.lit(1e-30)))
    return bands.join(F.broadcast(table), "band").groupBy(*keys, "c").agg(F.abs(F.sum(level * F.col("w"))).alias("value"))


def chroma_weights(n_bins: int, rate_hz: int, a4: float = 440.0, low: int = 24, high: int = 107) -> list[tuple[int, int, float]]:
    """(pitch class, k, 1): bins within a quarter tone of each pitch (a class has all its octaves)."""
    out = []
    for k in range(1, n_bins):
        pitch = round(69 + 12 * log(k * rate_hz / (2 * (n_bins - 1)) / a4) / log(2))
        if low <= pitch <= high:
            out.append((pitch % 12, k, 1.0))
    return out


def chroma(power: DataFrame, n_bins: int, rate_hz: int, compression: float = 0.5, keys: Keys = ("ch",)) -> DataFrame:
    """(band, value): log-compressed energy of each pitch class."""
    e = weighted_bands(power, chroma_weights(n_bins, rate_hz), keys)
    return e.select(*keys, "band", F.log(1.0 + compression * F.col("energy")).alias("value"))


def octave_bands(power: DataFrame, centres: list[float], fraction: int = 1, keys: Keys = ("ch",)) -> DataFrame:
    """(centre_hz, energy): an interval join of bins with the bands' edges."""
    spark = power.sparkSession
    half = 2 ** (0.5 / fraction)
    table = spark.createDataFrame([(float(f), f / half, f * half) for f in centres], "centre_hz double, lo double, hi double")
    inside = power.join(F.broadcast(table), (F.col("f_hz") >= F.col("lo")) & (F.col("f_hz") < F.col("hi")))
    return inside.groupBy(*keys, "centre_hz").agg(F.sum("power").alias("energy"))


def octave_centres(spark, low_hz: float, high_hz: float, fraction: int = 1) -> DataFrame:
    """(i, f_hz): 1000 * 2**(i / fraction) within a range."""
    top = 12 * fraction
    f = 1000.0 * F.pow(F.lit(2.0), F.col("i") / float(fraction))
    return spark.range(-top, top + 1).select(F.col("id").alias("i")).select("i", f.alias("f_hz")).where(F.col("f_hz").between(low_hz, high_hz))


def flux(spectra: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    """(frame, flux): rise of the magnitudes since the frame before, summed over bins."""
    mag = spectra.select(*keys, "frame", "k", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("m"))
    w = Window.partitionBy(*keys, "k").orderBy("frame")
    rise = mag.withColumn("d", F.greatest(F.lit(0.0), F.col("m") - F.lag("m").over(w)))
    return rise.groupBy(*keys, "frame").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("flux"))


def peaks(power: DataFrame, count: int, keys: Keys = ("ch",)) -> DataFrame:
    """(rank, k, power): the largest local maxima along k; smaller k first among equals."""
    w = Window.partitionBy(*keys).orderBy("k")
    local = power.withColumn("a", F.lag("power").over(w)).withColumn("b", F.lead("power").over(w)).where("power > a and power > b")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("power"), "k"))
    return local.withColumn("rank", rank).where(F.col("rank") <= count).select(*keys, "rank", "k", "power")


def real_cepstrum(spectrum: DataFrame, length: int, keys: Keys = ("ch",)) -> DataFrame:
    """(n, re): inverse transform of the log magnitude."""
    from sonagrid.operators.spectra import idft

    level = F.log(F.greatest(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")), F.lit(1e-30)))
    return idft(spectrum.select(*keys, "k", level.alias("re"), F.lit(0.0).alias("im")), length, keys)
