"""Filters and operators that need a whole channel in order. Linear recursions
run over blocks of samples (sonagrid.operators.recursive). For long transforms,
iterative fits and recursions that are not linear, one row for each channel has
its samples as an array; numpy runs on it inside a Spark task, so channels are
the unit of distribution."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonagrid.operators import long_fft, recursive, scans
from sonagrid.sources.tables import to_arrays, to_rows

Keys = tuple[str, ...]


def per_channel(signal: DataFrame, kernel, result: str = "array<double>", keys: Keys = ("ch",)) -> DataFrame:
    """(keys, out): kernel(samples as float64 array) for each channel."""
    arrays = to_arrays(signal, keys)

    def run(it):
        for batch in it:
            values = [kernel(np.asarray(x.values, dtype=float)) for x in batch.column("samples")]
            flat = result.startswith("array")
            out = pa.array([np.asarray(v).tolist() if flat else float(v) for v in values], pa.list_(pa.float64()) if flat else pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + [out], names=[*keys, "out"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in arrays.schema.fields if f.name in keys)
    return arrays.mapInArrow(run, f"{schema}, out {result}")


def mapped(signal: DataFrame, kernel, keys: Keys = ("ch",)) -> DataFrame:
    """A signal from a signal, channel by channel."""
    return to_rows(per_channel(signal, kernel, keys=keys), keys, "out")


# --- design -------------------------------------------------------------------


def biquad(kind: str, f_hz: float, rate_hz: int, q: float = 2**-0.5, gain_db: float = 0.0) -> np.ndarray:
    """[b0 b1 b2 1 a1 a2] of a second-order section (bilinear forms of the audio equaliser cookbook).

    The gain is that of the bell or shelf, and of the whole output for the other kinds.
    """
    w = 2 * np.pi * f_hz / rate_hz
    c, s, a = np.cos(w), np.sin(w), 10 ** (gain_db / 40)
    alpha, root, t = s / (2 * q), np.sqrt(10 ** (gain_db / 40)), np.tan(w / 2)
    b, d = {
        "lowpass": ([(1 - c) / 2, 1 - c, (1 - c) / 2], [1 + alpha, -2 * c, 1 - alpha]),
        "highpass": ([(1 + c) / 2, -1 - c, (1 + c) / 2], [1 + alpha, -2 * c, 1 - alpha]),
        "bandpass": ([alpha, 0, -alpha], [1 + alpha, -2 * c, 1 - alpha]),
        "bandpass_skirt": ([s / 2, 0, -s / 2], [1 + alpha, -2 * c, 1 - alpha]),
        "notch": ([1, -2 * c, 1], [1 + alpha, -2 * c, 1 - alpha]),
        "allpass": ([1 - alpha, -2 * c, 1 + alpha], [1 + alpha, -2 * c, 1 - alpha]),
        "peaking": ([1 + alpha * a, -2 * c, 1 - alpha * a], [1 + alpha / a, -2 * c, 1 - alpha / a]),
        "lowshelf": (
            [a * (a + 1 - (a - 1) * c + 2 * root * alpha), 2 * a * (a - 1 - (a + 1) * c), a * (a + 1 - (a - 1) * c - 2 * root * alpha)],
            [a + 1 + (a - 1) * c + 2 * root * alpha, -2 * (a - 1 + (a + 1) * c), a + 1 + (a - 1) * c - 2 * root * alpha],
        ),
        "highshelf": (
            [a * (a + 1 + (a - 1) * c + 2 * root * alpha), -2 * a * (a - 1 + (a + 1) * c), a * (a + 1 + (a - 1) * c - 2 * root * alpha)],
            [a + 1 - (a - 1) * c + 2 * root * alpha, 2 * (a - 1 - (a + 1) * c), a + 1 - (a - 1) * c - 2 * root * alpha],
        ),
        # first order, by the bilinear transform of 1 / (1 + s), s / (1 + s) and (1 - s) / (1 + s)
        "lowpass1": ([t, t, 0], [1 + t, t - 1, 0]),
        "highpass1": ([1, -1, 0], [1 + t, t - 1, 0]),
        "allpass1": ([t - 1, t + 1, 0], [1 + t, t - 1, 0]),
    }[kind]
    level = 1.0 if kind in ("peaking", "lowshelf", "highshelf") else 10 ** (gain_db / 20)
    return np.array([*(level * v for v in b), *d], dtype=float) / d[0]


def butterworth(order: int, f_hz: float, rate_hz: int, highpass: bool = False) -> np.ndarray:
    """Sections of a Butterworth filter: pole pairs as biquads, a real pole last for odd orders."""
    kind = "highpass" if highpass else "lowpass"
    angles = [np.pi * ((2 * k + 1) / (2 * order) if order % 2 == 0 else (k + 1) / order) for k in range(order // 2)]
    out = [biquad(kind, f_hz, rate_hz, 1 / (2 * np.cos(t))) for t in angles]
    if order % 2:
        t = np.tan(np.pi * f_hz / rate_hz)
        b = [1, -1] if highpass else [t, t]
        out.append(np.array([*b, 0, 1 + t, t - 1, 0]) / (1 + t))
    return np.array(out)


def response(sections: np.ndarray, f_hz: np.ndarray, rate_hz: int) -> np.ndarray:
    z = np.exp(-2j * np.pi * np.asarray(f_hz) / rate_hz)[:, None] ** np.arange(3)
    return np.prod([(z @ s[:3]) / (z @ s[3:]) for s in np.atleast_2d(sections)], axis=0)


# --- filtering ----------------------------------------------------------------


def section_filter(x: np.ndarray, sections: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cascade of second-order sections (transposed form) and the state behind the last sample."""
    sections = np.atleast_2d(sections)
    state = np.zeros((len(sections), 2)) if state is None else np.array(state, dtype=float)
    y = np.asarray(x, dtype=float)
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sections.tolist()):
        s0, s1 = state[k].tolist()
        out = np.empty(len(y))
        for i, v in enumerate(y.tolist()):
            w = b0 * v + s0
            s0, s1 = b1 * v - a1 * w + s1, b2 * v - a2 * w
            out[i] = w
        y, state[k] = out, (s0, s1)
    return y, state


def iir(signal: DataFrame, sections: np.ndarray, keys: Keys = ("ch",)) -> DataFrame:
    return recursive.sections(signal, sections, keys)


zero_phase = recursive.zero_phase


def filter_bank(signal: DataFrame, bank: dict[str, np.ndarray], mode: str = "parallel", keys: Keys = ("ch",)) -> DataFrame:
    """parallel: (band, ...) of each filter; sequential: one after the other; summed: outputs added."""
    if mode == "sequential":
        return iir(signal, np.vstack([np.atleast_2d(s) for s in bank.values()]), keys)
    bands = recursive.bank(signal, {name: recursive.sections_step(sections) for name, sections in bank.items()}, keys)
    return bands if mode == "parallel" else bands.groupBy(*keys, "n").agg(F.sum("re").alias("re"))


def crossover(signal: DataFrame, f_hz: float, rate_hz: int, keys: Keys = ("ch",)) -> DataFrame:
    """Linkwitz-Riley halves (band low, high) of order 4: each Butterworth filter of order 2 twice."""
    low, high = butterworth(2, f_hz, rate_hz), butterworth(2, f_hz, rate_hz, True)
    return filter_bank(signal, {"low": np.vstack([low, low]), "high": np.vstack([high, high])}, "parallel", keys)


def allpass_of_crossover(f_hz: float, rate_hz: int) -> np.ndarray:
    """What the halves of a Linkwitz-Riley crossover of order 4 add up to: the allpass with the poles of one Butterworth filter."""
    return biquad("allpass", f_hz, rate_hz)


def linkwitz_riley_bank(frequencies: list[float], rate_hz: int) -> dict[str, np.ndarray]:
    """Bands (0 to len(frequencies)) that add up to an allpass: split from the lowest frequency
    on, and each band below a later crossover goes through that one's allpass."""
    f = sorted(frequencies)
    bank = {}
    for band in range(len(f) + 1):
        rows = [butterworth(2, x, rate_hz, True) for x in f[:band] for _ in (0, 1)]
        if band < len(f):
            rows += [butterworth(2, f[band], rate_hz)] * 2 + [np.atleast_2d(allpass_of_crossover(x, rate_hz)) for x in f[band + 1 :]]
        bank[str(band)] = np.vstack(rows)
    return bank


def octave_filter_bank(signal: DataFrame, centres: list[float], rate_hz: int, order: int = 2, keys: Keys = ("ch",)) -> DataFrame:
    """Bands of an octave as high-pass and low-pass in series."""
    bank = {f"{f:g}": np.vstack([butterworth(order, f / 2**0.5, rate_hz, True), butterworth(order, f * 2**0.5, rate_hz)]) for f in centres}
    return filter_bank(signal, bank, "parallel", keys)


# --- transforms -----------------------------------------------------------------


def fft_spectrum(signal: DataFrame, rate_hz: int = 1, keys: Keys = ("ch",)) -> DataFrame:
    """(k, f_hz, re, im) of whole channels of any length; a table that a task could
    not hold goes in rounds of short transforms (long_fft)."""
    if scans.levels_of(signal) > 1:
        return long_fft.spectrum(signal, rate_hz, keys)

    def kernel(x):
        s = np.fft.rfft(x)
        return np.column_stack([np.fft.rfftfreq(len(x), 1 / rate_hz), s.real, s.imag]).ravel()

    out = per_channel(signal, kernel, keys=keys).select(*keys, F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("out") / 3 - 1).cast("int")), lambda k: F.slice("out", 3 * k + 1, 3))).alias("k", "v"))
    return out.select(*keys, "k", F.get("v", 0).alias("f_hz"), F.get("v", 1).alias("re"), F.get("v", 2).alias("im"))


def _analytic(x: np.ndarray) -> np.ndarray:
    s = np.fft.fft(x)
    n = len(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(s * gain)


def hilbert_envelope(signal: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    return long_fft.envelope(signal, keys) if scans.levels_of(signal) > 1 else mapped(signal, lambda x: np.abs(_analytic(x)), keys)


def instantaneous_frequency(signal: DataFrame, rate_hz: int, keys: Keys = ("ch",)) -> DataFrame:
    return mapped(signal, lambda x: np.diff(np.unwrap(np.angle(_analytic(x)))) * rate_hz / (2 * np.pi), keys)


def minimum_phase(signal: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    """Same magnitude with the least delay, by folding the cepstrum."""

    def kernel(x):
        n = 8 * len(x)
        c = np.fft.ifft(np.log(np.maximum(np.abs(np.fft.fft(x, n)), 1e-12))).real
        c[1 : n // 2] *= 2
        c[n // 2 + 1 :] = 0
        return np.fft.ifft(np.exp(np.fft.fft(c))).real[: len(x)]

    return mapped(signal, kernel, keys)


resample = recursive.resample


def lpc(signal: DataFrame, order: int, keys: Keys = ("ch",)) -> DataFrame:
    """(out): [1, a1 ... a_order] by the recursion of Levinson and Durbin on autocorrelations."""

    def kernel(x):
        r = np.array([x[: len(x) - k] @ x[k:] for k in range(order + 1)])
        a, e = np.array([1.0]), max(r[0], 1e-300)
        for k in range(1, order + 1):
            reflect = -(a @ r[k:0:-1]) / e
            a = np.append(a, 0.0)
            a = a + reflect * a[::-1]
            e *= 1 - reflect**2
        return a

    return per_channel(signal, kernel, keys=keys)


def burg(signal: DataFrame, order: int, keys: Keys = ("ch",)) -> DataFrame:
    """(out): [1, a1 ... a_order] by Burg's forward and backward prediction errors."""

    def kernel(x):
        f, b, a = x[1:], x[:-1], np.array([1.0])
        for _ in range(order):
            k = -2 * (b @ f) / max(f @ f + b @ b, 1e-300)
            a = np.append(a, 0.0)
            a = a + k * a[::-1]
            f, b = (f + k * b)[1:], (b + k * f)[:-1]
        return a

    return per_channel(signal, kernel, keys=keys)


# --- levels ---------------------------------------------------------------------


def k_weighting(rate_hz: int) -> np.ndarray:
    """The two sections before a loudness measurement: a high shelf and a high-pass."""
    return np.array([biquad("highshelf", 1500.0, rate_hz, 2**-0.5, 4.0), biquad("highpass", 38.1, rate_hz, 0.5)])


def loudness(signal: DataFrame, rate_hz: int, weights: tuple[float, ...] = (1.0, 1.0, 1.0, 1.41, 1.41)) -> DataFrame:
    """(lufs): integrated loudness over the channels 0 to 4 of one signal.

    The kernel filters; blocks of 400 ms every 100 ms, channel weights and both gates are relational.
    Blocks are sums over samples wherever these are, as there are five channels at most; those that
    reach a channel's last sample are left out afterwards.
    """
    z = iir(signal, k_weighting(rate_hz))
    block, hop = round(0.4 * rate_hz), round(0.1 * rate_hz)
    w = F.get(F.array(*[F.lit(v) for v in weights]), F.col("ch").cast("int"))
    n = F.col("n")
    first, last = F.greatest(F.lit(0).cast("long"), F.floor((n - block) / hop) + 1), F.floor(n / hop)
    sent = z.where(last >= first).select("ch", "n", "re", F.explode(F.sequence(first, last)).alias("frame"))
    whole = sent.groupBy("ch", "frame").agg((F.sum(F.col("re") * F.col("re")) / block).alias("p"), F.max("n").alias("last"))
    # one row a block here, a hop's share of the samples
    end = F.max("last").over(Window.partitionBy("ch"))
    whole = whole.withColumn("end", end).where(F.col("frame") * hop + block <= F.col("end"))
    blocks = whole.groupBy("frame").agg(F.sum(F.col("p") * w).alias("p"))
    blocks = blocks.withColumn("l", -0.691 + 10 * F.log10(F.greatest("p", F.lit(1e-30)))).where("l > -70")
    gate = blocks.agg((-0.691 + 10 * F.log10(F.avg("p")) - 10).alias("gate"))
    return blocks.join(F.broadcast(gate), F.lit(True)).where("l > gate").agg((-0.691 + 10 * F.log10(F.avg("p"))).alias("lufs"))


def true_peak(signal: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    """(true_peak_db): peak of the signal at four times the rate."""
    return resample(signal, 4, 1, keys).groupBy(*keys).agg((20.0 * F.log10(F.max(F.abs("re")))).alias("true_peak_db"))


def smoothing_coefficient(seconds: float, rate_hz: float, accuracy: float = 0.95) -> float:
    """Of the one-pole smoother that reaches a share of a step in a time."""
    return 1 - float(np.exp(np.log(1 - accuracy) / max(seconds * rate_hz, 1e-9)))


activity = recursive.activity


def split_by_activity(signal: DataFrame, threshold_dbfs: float, coefficient: float, keys: Keys = ("ch",)) -> DataFrame:
    """signal with active: the parts of an activity detector."""
    return signal.join(activity(signal, threshold_dbfs, coefficient, keys=keys), [*keys, "n"])


def convolve_long(signal: DataFrame, response: np.ndarray, keep_length: bool = False, keys: Keys = ("ch",)) -> DataFrame:
    """Fast convolution of whole channels with a long response."""
    h = np.asarray(response, dtype=float)

    def kernel(x):
        n = len(x) + len(h) - 1
        y = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(h, n), n)
        return y[: len(x)] if keep_length else y

    return mapped(signal, kernel, keys)


def gammatone(signal: DataFrame, f_hz: float, rate_hz: int, keys: Keys = ("ch",)) -> DataFrame:
    """Real part of a complex gammatone band, 0 dB at its centre."""
    from sonagrid.operators.design import gammatone_sections

    poles = gammatone_sections(f_hz, rate_hz)
    return recursive.filtered(signal, recursive.poles_step(list(poles), float(2 * np.prod([1 - abs(p) for p in poles]))), keys)


def gammatone_resynthesis(signal: DataFrame, frequencies: list[float], rate_hz: int, delay_s: float = 0.004, keys: Keys = ("ch",)) -> DataFrame:
    """The signal from its gammatone bands, delay_s late: bands turned, delayed, weighed and
    added (design.gammatone_synthesis); as long as the signal. A band is one
    recursion over blocks, the delay a shift of n, the sum a grouping."""
    from sonagrid.operators.design import gammatone_sections, gammatone_synthesis

    bands = None
    for f, (late, factor) in zip(frequencies, gammatone_synthesis(frequencies, rate_hz, delay_s)):
        one = recursive.filtered(signal, recursive.poles_step(list(gammatone_sections(f, rate_hz)), factor), keys)
        one = one.select(*keys, (F.col("n") + late).alias("n"), "re")
        bands = one if bands is None else bands.unionByName(one)
    last = signal.groupBy(*keys).agg(F.max("n").alias("last"))
    return bands.groupBy(*keys, "n").agg(F.sum("re").alias("re")).join(last, list(keys)).where("n <= last").select(*keys, "n", "re")


def feedback_delay(signal: DataFrame, samples: int, feedback: float, saturate: bool = False, tail: bool = False, keep_peak: bool = False, keys: Keys = ("ch",)) -> DataFrame:
    """y[n] = x[n] + feedback * f(y[n - samples]), f the identity or half an arctan of
    twice the value; block by block of the delay. tail lets 1 + 15 * feedback delays ring out."""
    if not (saturate or tail or keep_peak):
        return recursive.feedback_delay(signal, samples, feedback, keys)

    def kernel(x):
        more = int(samples * (1 + 15 * feedback)) if tail else 0
        y = np.concatenate([x, np.zeros(more)])
        for a in range(samples, len(y), samples):
            back = y[a - samples : a][: len(y) - a]
            y[a : a + samples] += feedback * (0.5 * np.arctan(2 * back) if saturate else back)
        return y * (np.abs(x).max() / max(np.abs(y).max(), 1e-300)) if keep_peak else y

    return mapped(signal, kernel, keys)


def chorus(signal: DataFrame, rate_hz: int, voices: list[tuple[float, float, float]], keys: Keys = ("ch",)) -> DataFrame:
    """The signal and copies read at a moving place; voices: (base delay, depth, frequency in Hz), delays in samples."""

    def kernel(x):
        n = np.arange(len(x))
        out = np.array(x, dtype=float)
        for base, depth, f in voices:
            at = n - base - depth * np.sin(2 * np.pi * f * n / rate_hz)
            out += np.interp(at, n, x, left=0.0)
        return out / (1 + len(voices))

    return mapped(signal, kernel, keys)


def spectral_subtraction(signal: DataFrame, window: int, noise_frames: int, factor: float = 1.0, keys: Keys = ("ch",)) -> DataFrame:
    """Mean magnitude of the first frames taken from all, Hann frames at half overlap added back; never below zero.

    Relational: frames, transforms, the noise table and the overlap-add are joins and sums.
    """
    from sonagrid.operators.spectra import istft, stft

    s = stft(signal, window, window // 2, "hann", keys=keys)
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    noise = s.where(F.col("frame") < noise_frames).groupBy(*keys, "k").agg(F.avg(size).alias("noise"))
    gain = F.greatest(F.lit(0.0), 1.0 - factor * F.col("noise") / F.greatest(size, F.lit(1e-30)))
    cut = s.join(noise, [*keys, "k"]).select(*keys, "frame", "k", (F.col("re") * gain).alias("re"), (F.col("im") * gain).alias("im"))
    return istft(cut, window, window // 2, "hann", keys)


def arma(signal: DataFrame, poles: int, zeros: int, keys: Keys = ("ch",)) -> DataFrame:
    """(out): [b0 ... b_zeros, 1, a1 ... a_poles] of a response's model: the
    denominator by linear prediction behind the zeros, the numerator by the response's start."""

    def kernel(h):
        n = len(h)
        rows = np.array([[h[i - k] if i >= k else 0.0 for k in range(1, poles + 1)] for i in range(zeros + 1, n)])
        a = np.concatenate([[1.0], np.linalg.lstsq(rows, -h[zeros + 1 :], rcond=None)[0]])
        return np.concatenate([np.convolve(h, a)[: zeros + 1], a])

    return per_channel(signal, kernel, keys=keys)
