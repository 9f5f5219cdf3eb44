"""Distances and alignments between signals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Keys = tuple[str, ...]


def snr(signal: DataFrame, noise: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    """Level of signal over that of noise in dB; noise has the same channels, or one for all of them."""
    s = signal.groupBy(*keys).agg(F.stddev_pop("re").alias("s"))
    n = noise.groupBy(*keys).agg(F.stddev_pop("re").alias("v"))
    return s.join(n, list(keys)).select(*keys, (20.0 * F.log10(F.col("s") / F.col("v"))).alias("snr_db"))


def snr_one(signal: DataFrame, noise: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    """snr() against a noise of one channel: its level is one row, whatever its length."""
    v = noise.agg(F.stddev_pop("re").alias("v"))
    return signal.groupBy(*keys).agg(F.stddev_pop("re").alias("s")).join(F.broadcast(v), F.lit(True)).select(*keys, (20.0 * F.log10(F.col("s") / F.col("v"))).alias("snr_db"))


def si_sdr(target: DataFrame, estimate: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    """Scale-invariant signal-to-distortion ratio in dB; sums of products are enough:
    with a = <x, y> / <x, x> the target part has the energy a a <x, x>, and the
    distortion <y, y> - a <x, y>."""
    both = target.select(*keys, "n", F.col("re").alias("x")).join(estimate.select(*keys, "n", F.col("re").alias("y")), [*keys, "n"])
    g = both.groupBy(*keys).agg(F.sum(F.expr("x * x")).alias("xx"), F.sum(F.expr("x * y")).alias("xy"), F.sum(F.expr("y * y")).alias("yy"))
    return g.select(*keys, (10.0 * F.log10(F.expr("xy * xy / xx / (yy - xy * xy / xx)"))).alias("si_sdr_db"))


def against(signal: DataFrame, reference) -> tuple[DataFrame, DataFrame]:
    """(all other channels, the reference channel under each of their numbers)."""
    others = signal.where(F.col("ch") != reference)
    one = signal.where(F.col("ch") == reference).select("n", F.col("re"))
    copies = others.select("ch", "n").join(one, "n")
    return others, copies.select("ch", "n", "re")


def correlation_lag(signal: DataFrame, reference: DataFrame, most: int | None = None, keys: Keys = ("ch",)) -> DataFrame:
    """(lag, value): the lag at which the sum of products with reference (n, re) is
    largest in absolute value; the smallest lag of equals. All lags at which the two
    overlap, or those between -most and most.

    With ``most`` each reference sample meets the 2 most + 1 lags around it: an
    equi-join on n, summed by lag. All lags take a fast transform of each channel.
    """
    if most is None:
        return _full_correlation_lag(signal, reference, keys)
    lags = F.explode(F.sequence(F.lit(-most).cast("long"), F.lit(most).cast("long")))
    moved = reference.select(F.col("n").alias("m"), F.col("re").alias("r"), lags.alias("lag")).withColumn("n", F.col("m") + F.col("lag"))
    sums = signal.join(moved, "n").groupBy(*keys, "lag").agg(F.sum(F.col("re") * F.col("r")).alias("v"))
    best = sums.groupBy(*keys).agg(F.max(F.struct(F.round(F.abs("v"), 9).alias("a"), (-F.col("lag")).alias("l"), F.col("v").alias("v"))).alias("b"))
    return best.select(*keys, (-F.col("b.l")).alias("lag"), F.col("b.v").alias("value"))


def _full_correlation_lag(signal: DataFrame, reference: DataFrame, keys: Keys) -> DataFrame:
    samples = lambda name: F.collect_list(F.struct(F.col("n").cast("long").alias("n"), F.col("re").cast("double").alias("re"))).alias(name)
    known = F.col("re").isNotNull() & F.col("n").isNotNull()
    one = reference.where(known).agg(samples("r")).where(F.size("r") > 0)
    arrays = signal.where(known).groupBy(*keys).agg(samples("s")).join(F.broadcast(one), F.lit(True))

    def dense(column, i: int) -> tuple[int, np.ndarray]:
        part = column.slice(i, 1).flatten()
        n, x = np.asarray(part.field("n")), np.asarray(part.field("re"))
        out = np.zeros(n.max() - n.min() + 1)
        np.add.at(out, n - n.min(), x)
        return int(n.min()), out

    def run(it):
        for batch in it:
            lag, value = [], []
            for i in range(batch.num_rows):
                (a, x), (b, y) = dense(batch.column("s"), i), dense(batch.column("r"), i)
                length = len(x) + len(y) - 1
                size = 1 << (length - 1).bit_length()
                # at index j the lag is a - b + j - (len(y) - 1)
                sums = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(y[::-1], size), size)[:length]
                best = int(np.argmax(np.round(np.abs(sums), 9)))
                lag.append(a - b + best - len(y) + 1)
                value.append(float(sums[best]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(lag, pa.int64()), pa.array(value, pa.float64())], names=[*keys, "lag", "value"])

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in arrays.schema.fields if f.name in keys)
    return arrays.mapInArrow(run, f"{schema}lag long, value double")


def autocorrelation(signal: DataFrame, lags: int, keys: Keys = ("ch",)) -> DataFrame:
    """(lag, value) for lags 0 .. lags: sums of x[n] x[n + lag], by windows over the channel."""
    w = Window.partitionBy(*keys).orderBy("n")
    sums = signal
    for k in range(1, lags + 1):
        sums = sums.withColumn(f"__r{k}", F.col("re") * F.lead("re", k, 0.0).over(w))
    g = sums.groupBy(*keys).agg(F.sum(F.col("re") * F.col("re")).alias("__r0"), *[F.sum(f"__r{k}").alias(f"__r{k}") for k in range(1, lags + 1)])
    return g.select(*keys, F.posexplode(F.array(*[f"__r{k}" for k in range(lags + 1)])).alias("lag", "value"))


def pearson(signal: DataFrame, reference: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    return signal.join(reference.select("n", F.col("re").alias("r")), "n").groupBy(*keys).agg(F.corr("re", "r").alias("r"))


def simpson(rows: DataFrame, x: str, y: str, keys: Keys = ("ch",)) -> DataFrame:
    """(integral): y over evenly spaced x by Simpson's rule; with an even number of
    points the last interval takes the parabola through the last three."""
    w = Window.partitionBy(*keys)
    r = rows.withColumn("__i", F.row_number().over(w.orderBy(x)) - 1).withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__h", (F.max(x).over(w) - F.min(x).over(w)) / F.greatest(F.col("__n") - 1, F.lit(1)))
    i, n = F.col("__i"), F.col("__n")
    last = F.when(n % 2 == 1, n - 1).otherwise(n - 2)  # of the part with whole parabolas
    whole = F.when(i > last, 0.0).when((i == 0) | (i == last), 1 / 3).when(i % 2 == 1, 4 / 3).otherwise(2 / 3)
    tail = F.when(n % 2 == 1, 0.0).when(i == n - 1, 5 / 12).when(i == n - 2, 2 / 3).when(i == n - 3, -1 / 12).otherwise(0.0)
    few = F.when(n == 2, 0.5).otherwise(whole + tail)
    return r.groupBy(*keys).agg(F.sum(few * F.col(y) * F.col("__h")).alias("integral"))


def spectral_distances(a: DataFrame, b: DataFrame, low_hz: float, high_hz: float, normalise: bool = True, keys: Keys = ("ch",)) -> DataFrame:
    """(log_spectral, itakura_saito) of power spectra (k, f_hz, power) between the
    bins nearest to two frequencies, the upper one left out.

    Root of the integral of the squared log ratio in dB, and the integral of
    ratio - log10(ratio) - 1; normalise brings each band to sum 1 first.
    """
    edge = lambda f: F.min(F.struct(F.round(F.abs(F.col("f_hz") - f), 9).alias("d"), "k")).getField("k")
    band = a.groupBy(*keys).agg(edge(low_hz).alias("__lo"), edge(high_hz).alias("__hi"))
    both = a.join(b.select(*keys, "k", F.col("power").alias("q")), [*keys, "k"]).join(band, list(keys)).where("k >= __lo and k < __hi")
    p, q = F.col("power"), F.col("q")
    if normalise:
        w = Window.partitionBy(*keys)
        p, q = p / F.sum("power").over(w), q / F.sum("q").over(w)
    ratios = both.select(*keys, "f_hz", (p / q).alias("r"))
    values = ratios.select(*keys, "f_hz", F.pow(10.0 * F.log10("r"), F.lit(2.0)).alias("l"), (F.col("r") - F.log10("r") - 1.0).alias("s"))
    log = simpson(values, "f_hz", "l", keys).withColumn("log_spectral", F.sqrt("integral")).drop("integral")
    return log.join(simpson(values, "f_hz", "s", keys).withColumnRenamed("integral", "itakura_saito"), list(keys))


def segmental_snr(target: DataFrame, estimate: DataFrame, window: int, low_db: float = -10.0, high_db: float = 35.0, keys: Keys = ("ch",)) -> DataFrame:
    """Mean over frames of the SNR in dB, each held between low_db and high_db."""
    both = target.select(*keys, "n", F.col("re").alias("x")).join(estimate.select(*keys, "n", F.col("re").alias("y")), [*keys, "n"])
    frame = F.floor(F.col("n") / window)
    g = both.groupBy(*keys, frame.alias("frame")).agg(F.sum(F.expr("x * x")).alias("s"), F.sum(F.expr("(x - y) * (x - y)")).alias("d"))
    value = F.least(F.lit(high_db), F.greatest(F.lit(low_db), 10.0 * F.log10(F.col("s") / F.greatest(F.col("d"), F.lit(1e-300)))))
    return g.where("s > 0").groupBy(*keys).agg(F.avg(value).alias("seg_snr_db"))


def fractional_peak(signal: DataFrame, rate_hz: int = 1, keys: Keys = ("ch",)) -> DataFrame:
    """(*keys, delay_s): place of the largest absolute sample (the first of equals), between
    samples by the parabola through it and its neighbours."""
    w = Window.partitionBy(*keys).orderBy("n")
    a = signal.select(*keys, "n", F.abs("re").alias("y"))
    a = a.withColumns({"l": F.coalesce(F.lag("y").over(w), F.lit(0.0)), "r": F.coalesce(F.lead("y").over(w), F.lit(0.0))})
    best = a.groupBy(*keys).agg(F.max(F.struct("y", (-F.col("n")).alias("m"), "l", "r")).alias("b"))
    bend = F.expr("b.l - 2 * b.y + b.r")
    shift = F.when(bend != 0, F.expr("0.5 * (b.l - b.r)") / bend).otherwise(0.0)
    return best.select(*keys, ((-F.col("b.m") + shift) / rate_hz).alias("delay_s"))


def weighted_segmental_snr(clean: DataFrame, noisy: DataFrame, weights: list[tuple[int, int, float]], window: int, gamma: float = 0.2, low_db: float = -10.0, high_db: float = 35.0, keys: Keys = ("ch",)) -> DataFrame:
    """(*keys, fw_snr_db): signal-to-noise ratio of bands of each frame, weighted by the clean band's
    magnitude to the power gamma, limited, averaged over frames. weights: (band, k, w)."""
    from sonagrid.operators.spectra import stft

    def bands(signal: DataFrame, name: str) -> DataFrame:
        s = stft(signal, window, window // 2, "hann", keys=keys).select(*keys, "frame", "k", F.sqrt(F.expr("re * re + im * im")).alias("m"))
        table = signal.sparkSession.createDataFrame(weights, "band int, k int, w double")
        return s.join(F.broadcast(table), "k").groupBy(*keys, "frame", "band").agg(F.sum(F.col("m") * F.col("w")).alias(name))

    both = bands(clean, "x").join(bands(noisy, "y"), [*keys, "frame", "band"])
    error = F.greatest(F.pow(F.col("x") - F.col("y"), 2), F.lit(1e-30))
    snr = F.least(F.lit(high_db), F.greatest(F.lit(low_db), 10.0 * F.log10(F.greatest(F.col("x") * F.col("x"), F.lit(1e-30)) / error)))
    weight = F.pow(F.col("x"), gamma)
    frames_ = both.groupBy(*keys, "frame").agg(F.sum(weight * snr).alias("s"), F.sum(weight).alias("w")).where("w > 0")
    return frames_.groupBy(*keys).agg(F.avg(F.col("s") / F.col("w")).alias("fw_snr_db"))
