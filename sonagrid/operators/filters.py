"""Filtering. Short finite responses are window expressions or a product with a
small table of taps; recursions need a channel's samples in order and run as
kernels on arrays (one-pole forms as an aggregate expression)."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Keys = tuple[str, ...]

#: Up to so many taps a finite response is a sum of lags in one window.
MOST_LAGS = 32

#: Up to so many taps of a multichannel filter are broadcast (some 4 MB).
MOST_TAPS = 1 << 17

#: Parts of a source's samples in a join with more taps.
PHASES = 64

#: Outputs of a channel that meet in one task.
OUTPUTS = 1 << 12


def fir(signal: DataFrame, taps: list[float], keys: Keys = ("ch",)) -> DataFrame:
    """Convolution with taps, as long as the input (zeros before the first sample).

    Few taps: lags over one window, one sort of the channel. Many: each sample
    is spread over the outputs it reaches and summed, which needs no order and
    combines before the shuffle.
    """
    if len(taps) <= MOST_LAGS:
        w = Window.partitionBy(*keys).orderBy("n")
        total = F.lit(0.0)
        for m, b in enumerate(taps):
            total = total + b * (F.col("re") if m == 0 else F.coalesce(F.lag("re", m).over(w), F.lit(0.0)))
        return signal.withColumn("re", total)
    return convolve(signal, taps, keys).join(signal.groupBy(*keys).agg(F.max("n").alias("__last")), list(keys)).where("n <= __last").drop("__last")


def convolve(signal: DataFrame, taps: list[float], keys: Keys = ("ch",)) -> DataFrame:
    """Full convolution: len(taps) - 1 samples longer than the input."""
    table = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(float(b)).alias("b")) for m, b in enumerate(taps)])
    spread = signal.select(*keys, "n", "re", F.inline(table))
    return spread.groupBy(*keys, (F.col("n") + F.col("m")).alias("n")).agg(F.sum(F.col("re") * F.col("b")).alias("re"))


def windowed_sinc(order: int, cutoff: float, kind: str = "hamming") -> list[float]:
    """Low-pass taps (order + 1 of them), cutoff relative to half the rate, sum 1."""
    from math import cos, sin

    out = []
    for m in range(order + 1):
        t = m - order / 2
        ideal = cutoff if t == 0 else sin(pi * cutoff * t) / (pi * t)
        w = {"hamming": 0.54 - 0.46 * cos(2 * pi * m / order), "hann": 0.5 - 0.5 * cos(2 * pi * m / order), "boxcar": 1.0}[kind]
        out.append(ideal * w)
    return [x / sum(out) for x in out]


def decimate(signal: DataFrame, factor: int, order: int = 20, keys: Keys = ("ch",)) -> DataFrame:
    """Low-passed, then every factor-th sample."""
    low = fir(signal, windowed_sinc(order, 1.0 / factor), keys)
    return low.where(F.pmod("n", F.lit(factor)) == 0).withColumn("n", F.floor(F.col("n") / factor).cast("long"))


def upsample(signal: DataFrame, factor: int, order: int = 20, keys: Keys = ("ch",)) -> DataFrame:
    """Zeros between the samples and a low-pass of gain factor, in polyphase form:
    output n * factor + p takes the taps p, p + factor, ... only."""
    taps = [factor * b for b in windowed_sinc(order, 1.0 / factor)]
    table = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(b).alias("b")) for m, b in enumerate(taps)])
    last = Window.partitionBy(*keys)
    spread = signal.withColumn("__last", F.max("n").over(last)).select(*keys, "n", "re", "__last", F.inline(table))
    n = F.col("n") * factor + F.col("m")
    return spread.where(n < (F.col("__last") + 1) * factor).groupBy(*keys, n.alias("n")).agg(F.sum(F.col("re") * F.col("b")).alias("re"))


def fractional_delay_taps(delay: float, order: int = 30, beta: float = 5.65) -> tuple[list[float], int]:
    """(taps, whole samples to shift before): Kaiser-windowed sinc around the fraction."""
    from math import sin, sqrt

    def bessel(x):
        total = term = 1.0
        k = 1
        while term > 1e-17 * total:
            term *= (x / 2 / k) ** 2
            total += term
            k += 1
        return total

    whole = int(delay) - order // 2
    out = []
    for m in range(order + 1):
        t = m - (delay - whole)
        ideal = 1.0 if abs(t) < 1e-12 else sin(pi * t) / (pi * t)
        r = 2 * m / order - 1
        out.append(ideal * bessel(beta * sqrt(max(0.0, 1 - r * r))) / bessel(beta))
    return out, whole


def fractional_delay(signal: DataFrame, delay: float, order: int = 30, keys: Keys = ("ch",)) -> DataFrame:
    """Later by any number of samples of at least order / 2."""
    taps, whole = fractional_delay_taps(delay, order)
    if whole < 0:
        raise ValueError("delay is shorter than half the filter's order")
    return convolve(signal, taps, keys).withColumn("n", F.col("n") + whole)


def moving_average(signal: DataFrame, length: int, keys: Keys = ("ch",)) -> DataFrame:
    """Mean over a centred stretch of odd length, shorter at the ends."""
    w = Window.partitionBy(*keys).orderBy("n").rowsBetween(-(length // 2), length // 2)
    return signal.withColumn("re", F.avg("re").over(w))


def one_pole(signal: DataFrame, coefficient: float, keys: Keys = ("ch",)) -> DataFrame:
    """(value): the last output of y[n] = c x[n] + (1 - c) y[n - 1] for each channel."""
    ordered = signal.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("n", "re"))).alias("s"))
    y = F.aggregate("s", F.lit(0.0), lambda acc, s: coefficient * s.re + (1 - coefficient) * acc)
    return ordered.select(*keys, y.alias("value"))


def one_pole_series(signal: DataFrame, coefficient: float, keys: Keys = ("ch",)) -> DataFrame:
    """All outputs of the same recursion, by the closed form of a geometric window:
    y[n] = c sum_k (1 - c)**k x[n - k], cut where the weight is below 1e-15."""
    from math import ceil, log

    reach = ceil(log(1e-15) / log(1 - coefficient))
    weights = [coefficient * (1 - coefficient) ** k for k in range(reach + 1)]
    w = Window.partitionBy(*keys).orderBy("n").rowsBetween(-reach, 0)
    past = F.reverse(F.collect_list("re").over(w))
    y = F.aggregate(F.zip_with(past, F.slice(F.array(*[F.lit(v) for v in weights]), F.lit(1), F.size(past)), lambda x, b: x * b), F.lit(0.0), lambda a, v: a + v)
    return signal.withColumn("re", y)


def mirror_split(signal: DataFrame, taps: list[float], keys: Keys = ("ch",)) -> DataFrame:
    """(band 0 low or 1 high, n, re): both halves of a quadrature mirror bank, every second sample kept."""
    sign = lambda b: [(-1.0) ** (m * b) * t for m, t in enumerate(taps)]
    bands = None
    for b in (0, 1):
        one = convolve(signal, sign(b), keys).where("n % 2 = 0").select(*keys, F.lit(b).alias("band"), (F.col("n") / 2).cast("long").alias("n"), "re")
        bands = one if bands is None else bands.unionByName(one)
    return bands


def mirror_join(bands: DataFrame, taps: list[float], keys: Keys = ("ch",)) -> DataFrame:
    """The signal back from mirror_split, later by the taps' length less one."""
    wide = bands.withColumn("n", F.col("n") * 2)
    low = convolve(wide.where("band = 0").drop("band"), [2 * t for t in taps], keys)
    high = convolve(wide.where("band = 1").drop("band"), [-2 * (-1.0) ** m * t for m, t in enumerate(taps)], keys)
    return low.unionByName(high).groupBy(*keys, "n").agg(F.sum("re").alias("re"))


def gaussian_taps(sigma: float, reach: int) -> list[tuple[int, float]]:
    """(place, weight) of a Gaussian of sum 1 around 0."""
    from math import exp

    w = [exp(-0.5 * (m / sigma) ** 2) for m in range(-reach, reach + 1)]
    return [(m, v / sum(w)) for m, v in zip(range(-reach, reach + 1), w)]


def band_weights(centres: list[float], n_bins: int, rate_hz: int) -> list[tuple[int, int, float]]:
    """(band, k, w): bands that rise and fall as half cosines over the logarithm of frequency between
    neighbouring centres, the first and last open, so that the weights of a bin add up to 1."""
    from math import cos, log

    out = []
    for k in range(n_bins):
        f = k * rate_hz / (2 * (n_bins - 1))
        for band in range(len(centres)):
            w = 1.0
            if band > 0 and f < centres[band]:
                x = (log(f / centres[band - 1]) / log(centres[band] / centres[band - 1])) if f > centres[band - 1] else 0.0
                w = 0.5 - 0.5 * cos(pi * x)
            if band < len(centres) - 1 and f > centres[band]:
                x = min(1.0, log(f / centres[band]) / log(centres[band + 1] / centres[band]))
                w = 0.5 + 0.5 * cos(pi * x)
            if w > 0:
                out.append((band, k, w))
    return out


def reconstructing_bands(signal: DataFrame, centres: list[float], length: int, rate_hz: int, keys: Keys = ("ch",)) -> DataFrame:
    """(*keys, band, n, re): linear-phase bands that add up to the signal, from one transform of ``length`` samples."""
    from sonagrid.operators.spectra import dft, idft

    table = signal.sparkSession.createDataFrame(band_weights(centres, length // 2 + 1, rate_hz), "band int, k int, w double")
    bands = dft(signal, length, rate_hz, keys).join(F.broadcast(table), "k")
    return idft(bands.select(*keys, "band", "k", (F.col("re") * F.col("w")).alias("re"), (F.col("im") * F.col("w")).alias("im")), length, (*keys, "band"))


def response(frequencies: DataFrame, sections, rate_hz: int) -> DataFrame:
    """frequencies (f_hz) with re and im of a cascade of sections there."""
    import numpy as np

    w = F.col("f_hz") * (-2 * pi / rate_hz)
    c, s, c2, s2 = F.cos(w), F.sin(w), F.cos(2 * w), F.sin(2 * w)
    out = frequencies.withColumns({"re": F.lit(1.0), "im": F.lit(0.0)})
    for b0, b1, b2, a0, a1, a2 in np.atleast_2d(sections).tolist():
        nr, ni, dr, di = b0 + b1 * c + b2 * c2, b1 * s + b2 * s2, a0 + a1 * c + a2 * c2, a1 * s + a2 * s2
        size = dr * dr + di * di
        hr, hi = (nr * dr + ni * di) / size, (ni * dr - nr * di) / size
        out = out.withColumns({"re": F.col("re") * hr - F.col("im") * hi, "im": F.col("re") * hi + F.col("im") * hr})
    return out


def convolve_matrix(signal: DataFrame, taps: DataFrame, keys: Keys = ()) -> DataFrame:
    """(*keys, ch, n, re) of a multichannel filter: taps (source, ch, m, b) lead from each channel ``source`` to the
    outputs ``ch``; outputs sum over all sources.

    Up to MOST_TAPS taps are broadcast; more are joined on the source and the place of a sample modulo
    PHASES, as an array has few sources. Products meet by blocks of outputs before they are summed, so that
    a task sums a partition's outputs and not all of those of the file it reads.
    """
    samples = signal.withColumnRenamed("ch", "source")
    if taps.limit(MOST_TAPS + 1).count() <= MOST_TAPS:
        both = samples.join(F.broadcast(taps), "source")
    else:
        spread = taps.withColumn("__phase", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PHASES - 1).cast("long"))))
        both = samples.withColumn("__phase", F.pmod("n", F.lit(PHASES).cast("long"))).join(spread, ["source", "__phase"])
    place = F.col("n") + F.col("m")
    sent = both.select(*keys, "ch", place.alias("n"), (F.col("re") * F.col("b")).alias("re"), F.floor(place / OUTPUTS).alias("__block"))
    by = (*keys, "ch", "__block")
    return sent.repartition(*by).groupBy(*by, "n").agg(F.sum("re").alias("re")).drop("__block")


def band_levels(bands: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    """(*keys, band, power): mean square of each band of a filter bank."""
    return bands.groupBy(*keys, "band").agg(F.avg(F.col("re") * F.col("re")).alias("power"))
