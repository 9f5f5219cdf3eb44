"""Time-frequency transforms and warping."""

from __future__ import annotations

from math import pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonagrid.operators import kernels as ke

Keys = tuple[str, ...]


def morlet_taps(f_hz: float, rate_hz: int, cycles: float = 6.0) -> list[tuple[int, float, float]]:
    """(m, re, im) of a Morlet wavelet of so many cycles, of unit absolute sum, centred at m = 0."""
    sigma = cycles / (2 * pi * f_hz) * rate_hz
    reach = int(np.ceil(4 * sigma))
    g = [np.exp(-0.5 * (m / sigma) ** 2) for m in range(-reach, reach + 1)]
    total = sum(g)
    return [(m, float(v / total * np.cos(2 * pi * f_hz * m / rate_hz)), float(v / total * np.sin(2 * pi * f_hz * m / rate_hz))) for m, v in zip(range(-reach, reach + 1), g)]


def cwt(signal: DataFrame, frequencies: list[float], rate_hz: int, cycles: float = 6.0, keys: Keys = ("ch",)) -> DataFrame:
    """(f_hz, n, re, im): the signal with each wavelet, a product with a table of
    taps summed by place; as long as the signal."""
    spark = signal.sparkSession
    table = spark.createDataFrame([(float(f), m, a, b) for f in frequencies for m, a, b in morlet_taps(f, rate_hz, cycles)], "f_hz double, m int, a double, b double")
    packed = table.groupBy("f_hz").agg(F.collect_list(F.struct("m", "a", "b")).alias("taps"))
    last = F.max("n").over(Window.partitionBy(*keys))
    spread = signal.withColumn("__last", last).join(F.broadcast(packed), F.lit(True)).select(*keys, "f_hz", "n", "__last", F.col("re").alias("x"), F.inline("taps"))
    at = F.col("n") + F.col("m")
    return spread.where((at >= 0) & (at <= F.col("__last"))).groupBy(*keys, "f_hz", at.alias("n")).agg(F.sum(F.col("x") * F.col("a")).alias("re"), F.sum(F.col("x") * F.col("b")).alias("im"))


def squeezed(scalogram: DataFrame, frequencies: list[float], rate_hz: int, keys: Keys = ("ch",)) -> DataFrame:
    """(n, f_hz, power): power moved to the nearest of the frequencies to the
    instantaneous one, the phase step between neighbouring samples."""
    w = Window.partitionBy(*keys, "f_hz").orderBy("n")
    re, im = F.lag("re").over(w), F.lag("im").over(w)
    step = F.atan2(F.col("im") * re - F.col("re") * im, F.col("re") * re + F.col("im") * im) * (rate_hz / (2 * pi))
    marked = scalogram.withColumn("inst", F.coalesce(step, F.col("f_hz")))
    near = F.array_min(F.array(*[F.struct(F.abs(F.col("inst") - f).alias("d"), F.lit(float(f)).alias("f")) for f in frequencies])).getField("f")
    return marked.select(*keys, "n", near.alias("f_hz"), F.expr("re * re + im * im").alias("p")).groupBy(*keys, "n", "f_hz").agg(F.sum("p").alias("power"))


def variable_q(signal: DataFrame, low_hz: float, octaves: int, per_octave: int, rate_hz: int, q: float = 17.0, keys: Keys = ("ch",)) -> DataFrame:
    """(f_hz, n, re, im) at logarithmically spaced frequencies: wavelets whose
    length follows the quality factor."""
    frequencies = [low_hz * 2 ** (i / per_octave) for i in range(octaves * per_octave)]
    return cwt(signal, [f for f in frequencies if f < rate_hz / 2], rate_hz, q / sqrt(2), keys)


def complex_cepstrum(signal: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    """Inverse transform of log magnitude and unwrapped phase, its slope taken away."""

    def kernel(x):
        s = np.fft.rfft(x)
        phase = np.unwrap(np.angle(s))
        phase -= np.pi * np.round(phase[-1] / np.pi) * np.arange(len(s)) / (len(s) - 1)
        return np.fft.irfft(np.log(np.maximum(np.abs(s), 1e-30)) + 1j * phase, len(x))

    return ke.mapped(signal, kernel, keys)


def from_cepstrum(signal: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    return ke.mapped(signal, lambda c: np.fft.irfft(np.exp(np.fft.rfft(c)), len(c)), keys)


#: Entries of a basis table at most; more would no longer be a small side of a join (see _bent for the other way).
MOST_ENTRIES = 1 << 20


def allpass_chain(warp: float, inputs: int, length: int, first: np.ndarray | None = None) -> np.ndarray:
    """Row m: response (``length`` samples) of m first-order allpasses in a chain, behind a filter of response ``first``."""
    line = np.zeros(length) if first is None else np.array(first[:length], dtype=float)
    if first is None:
        line[0] = 1.0
    out = np.empty((inputs, length))
    for m in range(inputs):
        out[m] = line
        after, x0, y0 = np.empty(length), 0.0, 0.0
        for i, x in enumerate(line.tolist()):
            y0 = -warp * x + x0 + warp * y0
            x0, after[i] = x, y0
        line = after
    return out


def _on_basis(signal: DataFrame, basis: np.ndarray, keys: Keys) -> DataFrame:
    """Samples times the rows of a basis, summed by column: a join on the sample index."""
    table = signal.sparkSession.createDataFrame([(m, row.tolist()) for m, row in enumerate(basis)], "n long, basis array<double>")
    spread = signal.join(F.broadcast(table), "n").select(*keys, F.col("re").alias("x"), F.posexplode("basis").alias("n", "b"))
    return spread.groupBy(*keys, F.col("n").cast("long").alias("n")).agg(F.sum(F.col("x") * F.col("b")).alias("re"))


def _length(signal: DataFrame) -> int:
    return (signal.agg(F.max("n")).first()[0] or 0) + 1


#: Neighbours on the doubled frequency grid that a value between is read from, and the window's shape: errors of some 1e-13.
TAPS, SHAPE = 16, 2.3 * 16


def _bent(signal: DataFrame, inputs: int, length: int, warp: float, laguerre_: bool, keys: Keys) -> DataFrame:
    """Warping as a resampling of the frequency axis, for channels of any length.

    A chain of m allpasses is exp(-i m theta(w)), so the warped signal's spectrum
    at w is the signal's at theta(w): samples over a window's transform, a
    transform of twice the length (long_fft), TAPS neighbours of each bent
    frequency with the window's weights (Kaiser-Bessel), and a transform back,
    long enough for the chain's tail to fade before it wraps around. Laguerre
    coefficients bend the other way, by a factor of (1 - warp exp(-i w)). Tables
    have a row for each sample or frequency; no table grows with the square.
    """
    from sonagrid.operators.long_fft import fft

    spark = signal.sparkSession
    grid = 1 << (2 * inputs - 1).bit_length()
    ring = inputs * (1 + abs(warp)) / (1 - abs(warp)) + 64 / max(1e-3, 1 - abs(warp))
    bins = 1 << int(np.ceil(np.log2(max(length, 1.5 * ring, 2))))
    middle = inputs // 2
    kind = T.StructType([*(signal.schema[k] for k in keys), T.StructField("n", T.LongType()), T.StructField("re", T.DoubleType())])

    def scaled(it):
        for batch in it:
            n = np.asarray(batch.column("n"), dtype=np.int64) - middle
            root = np.sqrt(SHAPE**2 - (np.pi * TAPS * n / grid) ** 2 + 0j)
            size = (TAPS * np.sinh(root) / root).real / np.i0(SHAPE)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(n % grid), pa.array(np.asarray(batch.column("re"), dtype=float) / size)], names=[*keys, "n", "re"])

    fine = fft(signal.select(*keys, "n", F.col("re").cast("double").alias("re")).where(F.col("n") < inputs).mapInArrow(scaled, kind), keys, length=grid)
    bend = -warp if laguerre_ else warp

    def neighbours(it):
        for batch in it:
            k = np.asarray(batch.column("id"), dtype=np.int64)
            w = 2 * np.pi * k / bins
            theta = w + 2 * np.arctan2(bend * np.sin(w), 1 - bend * np.cos(w))
            place = theta * (grid / (2 * np.pi))
            g = np.floor(place).astype(np.int64)[:, None] + np.arange(1 - TAPS // 2, TAPS // 2 + 1)
            u = 2 * (place[:, None] - g) / TAPS
            weight = np.where(np.abs(u) <= 1, np.i0(SHAPE * np.sqrt(np.maximum(1 - u * u, 0))) / np.i0(SHAPE), 0.0)
            turn = np.exp(-1j * theta * middle)
            if laguerre_:
                turn = turn * (1 - warp * np.exp(-1j * theta)) / sqrt(1 - warp**2)
            flat = lambda v: pa.array(np.repeat(v, TAPS))
            yield pa.RecordBatch.from_arrays([flat(k), pa.array((g % grid).ravel()), pa.array(weight.ravel()), flat(turn.real.copy()), flat(turn.imag.copy())], names=["bin", "k", "v", "c", "s"])

    asked = spark.range(bins).mapInArrow(neighbours, "bin long, k long, v double, c double, s double")
    read = fine.join(asked, "k").groupBy(*keys, "bin").agg(F.sum(F.col("re") * F.col("v")).alias("a"), F.sum(F.col("im") * F.col("v")).alias("b"), F.first("c").alias("c"), F.first("s").alias("s"))
    turned = read.select(*keys, F.col("bin").alias("k"), F.expr("a * c - b * s").alias("re"), F.expr("a * s + b * c").alias("im"))
    return fft(turned, keys, inverse=True, length=bins).where(F.col("n") < length).select(*keys, "n", "re")


def warped(signal: DataFrame, warp: float, length: int | None = None, keys: Keys = ("ch",), entries: int = MOST_ENTRIES) -> DataFrame:
    """Samples along a chain of first-order allpasses in place of delays: the
    frequency axis is bent, warp > 0 widens low frequencies. length: of the
    result, by default that of the longest channel."""
    inputs = _length(signal)
    if inputs * (length or inputs) > entries:
        return _bent(signal, inputs, length or inputs, warp, False, keys)
    return _on_basis(signal, allpass_chain(warp, inputs, length or inputs), keys)


def bark_warp(rate_hz: int) -> float:
    """Warping factor that comes nearest to the Bark scale (Smith and Abel)."""
    return 1.0674 * sqrt(2 / pi * np.arctan(0.06583 * rate_hz / 1000)) - 0.1916


def laguerre(signal: DataFrame, warp: float, keys: Keys = ("ch",), entries: int = MOST_ENTRIES) -> DataFrame:
    """Coefficients of the Laguerre basis: sums of the samples with the responses of a low-pass and the chain of allpasses behind it."""
    n = _length(signal)
    if n * n > entries:
        return _bent(signal, n, n, warp, True, keys)
    return _on_basis(signal, allpass_chain(warp, n, n, sqrt(1 - warp**2) * warp ** np.arange(n, dtype=float)).T, keys)


def kautz_basis(poles: list[float], length: int) -> np.ndarray:
    """Rows: responses of the orthonormal sections of real poles, each behind the allpasses of those before it."""
    n = np.arange(length)
    line, out = np.zeros(length), np.empty((len(poles), length))
    line[0] = 1.0
    for j, p in enumerate(poles):
        tail = p**n
        through = np.convolve(line, tail)[:length]  # one pole
        out[j] = sqrt(1 - p * p) * through
        line = np.append(0.0, through[:-1]) - p * through  # its allpass
    return out


def kautz_weights(response: DataFrame, poles: list[float], keys: Keys = ("ch",)) -> DataFrame:
    """(*keys, n, re): weight of each section n in the response nearest in least squares: as
    sections are orthonormal, its sum of products with the response."""
    return _on_basis(response, kautz_basis(poles, _length(response)).T, keys)


def parallel_weights(response: DataFrame, poles: list[float], keys: Keys = ("ch",)) -> DataFrame:
    """(*keys, n, re): weights of parallel one-pole sections p_n whose sum is nearest to the response in least
    squares: products with the dual basis, which the poles alone decide."""
    n = np.arange(_length(response))
    rows = np.array([p**n for p in poles])
    return _on_basis(response, np.linalg.solve(rows @ rows.T, rows).T, keys)


def from_weights(weights: DataFrame, basis: np.ndarray, keys: Keys = ("ch",)) -> DataFrame:
    """(*keys, n, re): the response that weights (*keys, n, re) make of the rows of a basis."""
    return _on_basis(weights, basis, keys)


def longest_wavelet(frequencies: list[float], rate_hz: int, cycles: float = 6.0) -> int:
    """Samples of the longest of the wavelets of cwt()."""
    return len(morlet_taps(min(frequencies), rate_hz, cycles))


def log_mel(power_frames: DataFrame, weights: list[tuple[int, int, float]], keys: Keys = ("ch", "frame")) -> DataFrame:
    """(band, level_db) of each frame from (frame, k, power)."""
    from sonagrid.operators.features import weighted_bands

    e = weighted_bands(power_frames, weights, keys)
    return e.select(*keys, "band", (10.0 * F.log10(F.greatest("energy", F.lit(1e-30)))).alias("level_db"))
