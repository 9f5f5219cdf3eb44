"""Spectra as relations: (k, f_hz, re, im). A transform is a product of samples
with a small table of bins, summed by bin, so it needs no driver and no whole
channel in one place. Long transforms: sonagrid.operators.kernels.fft_spectrum."""

from __future__ import annotations

from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonagrid.operators import frames as fr

Keys = tuple[str, ...]


#: Up to so many bins a transform is a row of sums.
MOST_SUMS = 33


def _fast(samples: DataFrame, by: Keys, m: str, x: str, length: int) -> DataFrame:
    """One-sided fast transforms of the groups' samples; missing ones are zero."""
    arrays = samples.groupBy(*by).agg(F.collect_list(F.struct(F.col(m).cast("int").alias("m"), F.col(x).alias("x"))).alias("s"))

    def run(it):
        for batch in it:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                column = part.column("s")
                rows, flat = np.repeat(np.arange(part.num_rows), np.asarray(column.value_lengths())), column.flatten()
                frames = np.zeros((part.num_rows, length))
                frames[rows, np.asarray(flat.field("m"))] = np.asarray(flat.field("x"))
                out = np.fft.rfft(frames, axis=1)
                pack = lambda v: pa.ListArray.from_arrays(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in by), pack(out.real), pack(out.imag)], names=[*by, "re", "im"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in arrays.schema.fields if f.name in by)
    wide = arrays.mapInArrow(run, f"{schema}, re array<double>, im array<double>")
    return wide.select(*by, F.posexplode(F.arrays_zip("re", "im")).alias("k", "v")).select(*by, "k", "v.re", "v.im")


def _dft(samples: DataFrame, by: Keys, m: str, x: str, length: int, n_bins: int) -> DataFrame:
    """Sums of x[m] exp(-2 pi i k m / length) by ``by`` and k.

    The n_bins sums of a group are aggregates of one pass over its samples
    (partial before the shuffle), turned into rows afterwards: the shuffle
    carries one row for each group and task, not one for each sample and bin.
    With more than MOST_SUMS bins the group's samples meet as an array and a
    fast transform runs on many of them at once.
    """
    if n_bins > MOST_SUMS:
        return _fast(samples, by, m, x, length)
    angle = lambda k: F.pmod(F.col(m) * k, F.lit(length)) * (-2 * pi / length)
    sums = [F.sum(F.col(x) * F.cos(angle(k))).alias(f"__c{k}") for k in range(n_bins)]
    sums += [F.sum(F.col(x) * F.sin(angle(k))).alias(f"__s{k}") for k in range(n_bins)]
    whole = samples.groupBy(*by).agg(*sums)
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"__c{k}").alias("re"), F.col(f"__s{k}").alias("im")) for k in range(n_bins)])
    return whole.select(*by, F.inline(rows))


def dft(signal: DataFrame, length: int, rate_hz: int = 1, keys: Keys = ("ch",)) -> DataFrame:
    """One-sided spectrum of the first length samples of each channel."""
    out = _dft(signal.where(F.col("n") < length), keys, "n", "re", length, length // 2 + 1)
    return out.select(*keys, "k", (F.col("k") * (rate_hz / length)).alias("f_hz"), "re", "im")


def dft_at(signal: DataFrame, frequencies: DataFrame, rate_hz: int, keys: Keys = ("ch",)) -> DataFrame:
    """Fourier sums at any frequencies: frequencies is a table (f_hz)."""
    angle = F.col("n") * F.col("f_hz") * (-2 * pi / rate_hz)
    pairs = signal.join(frequencies, F.lit(True))
    return pairs.groupBy(*keys, "f_hz").agg(F.sum(F.col("re") * F.cos(angle)).alias("re"), F.sum(F.col("re") * F.sin(angle)).alias("im"))


def idft(spectrum: DataFrame, length: int, keys: Keys = ("ch",)) -> DataFrame:
    """Real signal of a one-sided spectrum."""
    twice = F.when((F.col("k") == 0) | (F.col("k") * 2 == length), 1.0).otherwise(2.0) / float(length)
    n = spectrum.select("*", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("n"))
    angle = F.pmod(F.col("k") * F.col("n"), F.lit(length)) * (2 * pi / length)
    return n.groupBy(*keys, F.col("n").cast("long").alias("n")).agg(F.sum(twice * (F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle))).alias("re"))


def stft(signal: DataFrame, window: int, hop: int, kind: str = "hann", detrend: bool = False, padded: bool = False, keys: Keys = ("ch",)) -> DataFrame:
    """(frame, k, re, im)."""
    framed = fr.windowed(fr.frames(signal, window, hop, padded, keys), kind, window, detrend, keys)
    return _dft(framed, (*keys, "frame"), "m", "x", window, window // 2 + 1)


def istft(spectra: DataFrame, window: int, hop: int, kind: str = "hann", keys: Keys = ("ch",)) -> DataFrame:
    """Overlap-add of the frames' inverse transforms, by the summed squared window."""
    back = idft(spectra, window, (*keys, "frame"))
    return fr.overlap_add(back.select(*keys, "frame", F.col("n").alias("m"), F.col("re").alias("x")), hop, kind, window, keys=keys)


def welch(signal: DataFrame, window: int, hop: int, kind: str = "hann", average: str = "mean", detrend: bool = True, keys: Keys = ("ch",)) -> DataFrame:
    """(k, power): mean or median over frames of the squared magnitude."""
    power = stft(signal, window, hop, kind, detrend, keys=keys).select(*keys, "k", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p"))
    return power.groupBy(*keys, "k").agg((F.avg("p") if average == "mean" else F.percentile("p", 0.5)).alias("power"))


#: Power spectra scaled to physical units; the one-sided factor 2 leaves out the first and the last bin.
SCALINGS = ("fft_backward", "amplitude", "power", "density")


def scaled(power: DataFrame, window: int, kind: str, rate_hz: int, scaling: str = "fft_backward") -> DataFrame:
    """(k, value) of welch() in one of SCALINGS."""
    weights = [_weight(kind, m, window) for m in range(window)]
    total, squares = sum(weights), sum(w * w for w in weights)
    sided = F.when((F.col("k") == 0) | (F.col("k") * 2 == window), 1.0).otherwise(2.0)
    value = {
        "fft_backward": F.sqrt("power"),
        "amplitude": F.sqrt(F.col("power") * sided) / total,
        "power": F.col("power") * sided / total**2,
        "density": F.col("power") * sided / (rate_hz * squares),
    }[scaling]
    return power.withColumn("value", value).drop("power")


def _weight(kind: str, m: int, length: int) -> float:
    from math import cos

    a = 2 * pi * m / length
    return {"boxcar": 1.0, "hann": 0.5 - 0.5 * cos(a), "hamming": 0.54 - 0.46 * cos(a), "blackman": 0.42 - 0.5 * cos(a) + 0.08 * cos(2 * a)}[kind]


def cross_spectra(spectra: DataFrame, pairs: DataFrame | None = None, keys: Keys = ()) -> DataFrame:
    """(*keys, k, ch_i, ch_j, re, im) for i <= j: mean over frames of conj(X_i) X_j.

    spectra: (*keys, ch, frame, k, re, im), with a matrix for each of keys (arrays, say).
    The join is on (*keys, frame, k), and pairs (ch_i, ch_j) limits it; the
    lower half is the conjugate of the upper. With keys and without pairs the
    channels of an array meet as a list instead, so that spectra are computed once.
    """
    if keys and pairs is None:
        known = spectra.dropna(subset=[*keys, "frame", "k"]).groupBy(*keys, "frame", "k").agg(F.collect_list(F.struct("ch", "re", "im")).alias("s"))
        both = known.select(*keys, "k", "s", F.inline("s").alias("ch_i", "a", "b")).select(*keys, "k", "ch_i", "a", "b", F.inline("s").alias("ch_j", "c", "d")).where("ch_i <= ch_j")
        return _mean_products(both, keys)
    a = spectra.select(*keys, F.col("ch").alias("ch_i"), "frame", "k", F.col("re").alias("a"), F.col("im").alias("b"))
    b = spectra.select(*keys, F.col("ch").alias("ch_j"), "frame", "k", F.col("re").alias("c"), F.col("im").alias("d"))
    if pairs is not None:
        a = a.join(pairs, "ch_i")
        both = a.join(b, [*keys, "ch_j", "frame", "k"])
    else:
        both = a.join(b, [*keys, "frame", "k"]).where("ch_i <= ch_j")
    return _mean_products(both, keys)


def _mean_products(both: DataFrame, keys: Keys) -> DataFrame:
    """Means of conj(a + ib) (c + id) by keys, bin and channels."""
    re, im = F.col("a") * F.col("c") + F.col("b") * F.col("d"), F.col("a") * F.col("d") - F.col("b") * F.col("c")
    return both.groupBy(*keys, "k", "ch_i", "ch_j").agg(F.avg(re).alias("re"), F.avg(im).alias("im"))


def _pairs(spectra: DataFrame, source, target, by: Keys) -> DataFrame:
    """(*by, a, b, c, d): source a + i b and target c + i d where both are there."""
    pick = lambda c, x: F.max(F.when(F.col("ch") == c, F.col(x)))
    pair = spectra.where(F.col("ch").isin(source, target)).groupBy(*by).agg(pick(source, "re").alias("a"), pick(source, "im").alias("b"), pick(target, "re").alias("c"), pick(target, "im").alias("d"))
    return pair.where("a is not null and c is not null")


def transfer(spectra: DataFrame, source, target, keys: Keys = ()) -> DataFrame:
    """(*keys, k, H1, H2, H3 and coherence) between two channels of (*keys, ch, frame, k, re, im), over the frames that both have."""
    g = _pairs(spectra, source, target, (*keys, "frame", "k")).groupBy(*keys, "k").agg(
        F.avg(F.expr("a * a + b * b")).alias("xx"),
        F.avg(F.expr("c * c + d * d")).alias("yy"),
        F.avg(F.expr("a * c + b * d")).alias("r"),
        F.avg(F.expr("a * d - b * c")).alias("i"),
    )
    cross = F.sqrt(F.expr("r * r + i * i"))
    return g.select(
        *keys,
        "k",
        F.expr("r / xx").alias("h1_re"),
        F.expr("i / xx").alias("h1_im"),
        F.expr("yy * r / (r * r + i * i)").alias("h2_re"),
        F.expr("yy * i / (r * r + i * i)").alias("h2_im"),
        (F.col("r") / cross * F.sqrt(F.expr("yy / xx"))).alias("h3_re"),
        (F.col("i") / cross * F.sqrt(F.expr("yy / xx"))).alias("h3_im"),
        F.expr("(r * r + i * i) / (xx * yy)").alias("coherence"),
    )


def deconvolve(spectrum: DataFrame, source, target, regularisation: float = 1e-2, keys: Keys = ()) -> DataFrame:
    """(*keys, k, re, im): target times conj(source) over |source|**2 plus a constant."""
    den = F.expr("a * a + b * b") + regularisation
    return _pairs(spectrum, source, target, (*keys, "k")).select(*keys, "k", (F.expr("c * a + d * b") / den).alias("re"), (F.expr("d * a - c * b") / den).alias("im"))


def band_energy(spectrum: DataFrame, low: float, high: float, keys: Keys = ("ch",)) -> DataFrame:
    """Energy between two frequencies: trapezoids over the bins inside."""
    p = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    w = Window.partitionBy(*keys).orderBy("f_hz")
    inside = spectrum.where(F.col("f_hz").between(low, high)).withColumn("p", p)
    area = (F.col("f_hz") - F.lag("f_hz").over(w)) * (F.col("p") + F.lag("p").over(w)) / 2
    return inside.withColumn("area", area).groupBy(*keys).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("energy"))


def trim(spectrum: DataFrame, low: float, high: float) -> DataFrame:
    return spectrum.where(F.col("f_hz").between(low, high))


def interpolate(spectrum: DataFrame, at: DataFrame, value: str = "value", keys: Keys = ("ch",)) -> DataFrame:
    """value at the frequencies of ``at`` (f_hz), linear between bins, the edge bins' beyond them.

    An as-of join by union: each asked frequency looks back and ahead along
    its channel for the next bins.
    """
    asked = spectrum.select(*keys).distinct().join(at, F.lit(True)).select(*keys, "f_hz", F.lit(None).cast("double").alias("v"), F.lit(1).alias("ask"))
    both = spectrum.select(*keys, "f_hz", F.col(value).alias("v"), F.lit(0).alias("ask")).union(asked)
    w = Window.partitionBy(*keys).orderBy("f_hz", "ask")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("ask") == 0, F.struct("f_hz", "v"))
    both = both.withColumn("a", F.last(known, ignorenulls=True).over(back)).withColumn("b", F.first(known, ignorenulls=True).over(ahead))
    a, b = F.coalesce("a", "b"), F.coalesce("b", "a")
    share = F.when(b.f_hz > a.f_hz, (F.col("f_hz") - a.f_hz) / (b.f_hz - a.f_hz)).otherwise(0.0)
    return both.where("ask = 1").select(*keys, "f_hz", (a.v + share * (b.v - a.v)).alias(value))


def smooth_octaves(spectrum: DataFrame, fraction: float, value: str = "value", keys: Keys = ("ch",)) -> DataFrame:
    """Mean of value over a band of 1 / fraction octave around each bin (f_hz > 0): a range window over log2 f."""
    half = 0.5 / fraction
    micro = F.round(F.log2("f_hz") * 1e6).cast("long")
    w = Window.partitionBy(*keys).orderBy("__l").rangeBetween(-round(half * 1e6), round(half * 1e6))
    return spectrum.where("f_hz > 0").withColumn("__l", micro).withColumn(value, F.avg(value).over(w)).drop("__l")


def group_delay(spectrum: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    """(k, seconds): negative slope of the phase between neighbouring bins; wrapping does not matter
    as the phase of conj(X_k) X_(k+1) is taken."""
    w = Window.partitionBy(*keys).orderBy("k")
    re, im, f = (F.lead(x).over(w) for x in ("re", "im", "f_hz"))
    phase = F.atan2(F.col("re") * im - F.col("im") * re, F.col("re") * re + F.col("im") * im)
    return spectrum.select(*keys, "k", (-phase / (2 * pi * (f - F.col("f_hz")))).alias("delay_s")).where("delay_s is not null")


def shape(spectrum: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    """Centroid, spread and flatness of each spectrum's power (bins of power 0 do not count)."""
    p = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    s = spectrum.withColumn("p", p).where("p > 0")
    g = s.groupBy(*keys).agg(F.sum("p").alias("s0"), F.sum(F.col("p") * F.col("f_hz")).alias("s1"), F.sum(F.col("p") * F.col("f_hz") * F.col("f_hz")).alias("s2"), F.avg(F.log("p")).alias("l"), F.avg("p").alias("a"))
    c = F.col("s1") / F.col("s0")
    return g.select(*keys, c.alias("centroid_hz"), F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("s0") - c * c)).alias("spread_hz"), (F.exp("l") / F.col("a")).alias("flatness"))


# --- more on the frequency axis ---------------------------------------------------


def interpolate_as(spectrum: DataFrame, at: DataFrame, domain: str = "magnitude", scheme: str = "linear", edges: str = "extend", keys: Keys = ("ch",)) -> DataFrame:
    """(*keys, f_hz, value or re, im) at other frequencies.

    domain: what is interpolated: "complex" (re and im), "magnitude", "power" or
    "magnitude_phase" (magnitude and unwrapped phase; gives re and im). scheme:
    "linear" or "nearest" over frequency. edges, beyond the first and last bin:
    "extend" their values, "zero", or "error".
    """
    s = spectrum.withColumn("__m", F.sqrt(F.expr("re * re + im * im")))
    if domain == "magnitude_phase":
        by = Window.partitionBy(*keys).orderBy("f_hz")
        turn = F.atan2(F.expr("im * __r - re * __i"), F.expr("re * __r + im * __i"))
        s = s.withColumns({"__r": F.lag("re").over(by), "__i": F.lag("im").over(by)})
        s = s.withColumn("__p", F.sum(F.coalesce(turn, F.atan2("im", "re"))).over(by))
    parts = {"complex": ["re", "im"], "magnitude": ["__m"], "power": ["__q"], "magnitude_phase": ["__m", "__p"]}[domain]
    s = s.withColumn("__q", F.col("__m") * F.col("__m")).withColumn("v", F.array(*parts)).select(*keys, "f_hz", "v")
    asked = s.groupBy(*keys).agg(F.min("f_hz").alias("low"), F.max("f_hz").alias("high")).join(at, F.lit(True))
    outside = ~F.col("f_hz").between(F.col("low"), F.col("high"))
    if edges == "error":
        asked = asked.withColumn("f_hz", F.when(outside, F.raise_error(F.lit("a frequency beyond the spectrum"))).otherwise(F.col("f_hz")))
    none = F.lit(None).cast("array<double>")
    both = s.select(*keys, "f_hz", "v", F.lit(False).alias("ask"), F.lit(False).alias("outside")).unionByName(asked.select(*keys, "f_hz", none.alias("v"), F.lit(True).alias("ask"), outside.alias("outside")))
    w = Window.partitionBy(*keys).orderBy("f_hz", "ask")
    known = F.when(~F.col("ask"), F.struct("f_hz", "v"))
    both = both.withColumn("a", F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    a, b = F.coalesce("a", "b"), F.coalesce("b", "a")
    share = F.when(b.f_hz > a.f_hz, (F.col("f_hz") - a.f_hz) / (b.f_hz - a.f_hz)).otherwise(0.0)
    if scheme == "nearest":
        share = F.when(share > 0.5, 1.0).otherwise(0.0)
    value = [F.get(a.v, i) + share * (F.get(b.v, i) - F.get(a.v, i)) for i in range(len(parts))]
    if edges == "zero":
        value = [F.when(F.col("outside"), 0.0).otherwise(v) for v in value]
    out = {"magnitude": value[:1], "power": value[:1], "complex": value}.get(domain) or [value[0] * F.cos(value[1]), value[0] * F.sin(value[1])]
    names = ["value"] if len(out) == 1 else ["re", "im"]
    return both.where("ask").select(*keys, "f_hz", *[v.alias(n) for v, n in zip(out, names)])


def resampled(spectrum: DataFrame, length: int, rate_hz: int, domain: str = "complex", keys: Keys = ("ch",)) -> DataFrame:
    """The spectrum on the bins of a transform of another length."""
    f = spectrum.sparkSession.range(length // 2 + 1).select((F.col("id") * rate_hz / length).alias("f_hz"))
    return interpolate_as(spectrum, f, domain, keys=keys)


def normalised(spectrum: DataFrame, how: str = "peak", level_db: float = 0.0, at_hz: tuple[float, float] | None = None, keys: Keys = ("ch",)) -> DataFrame:
    """re and im scaled so that the magnitude's peak, root mean square ("rms"), or mean over a range of
    frequencies ("range") is level_db."""
    size = F.sqrt(F.expr("re * re + im * im"))
    by = Window.partitionBy(*keys)
    have = {
        "peak": F.max(size).over(by),
        "rms": F.sqrt(F.avg(size * size).over(by)),
        "range": F.avg(F.when(F.col("f_hz").between(*(at_hz or (0.0, 0.0))), size)).over(by),
    }[how]
    scale = 10 ** (level_db / 20) / have
    return spectrum.withColumn("__s", scale).withColumns({"re": F.col("re") * F.col("__s"), "im": F.col("im") * F.col("__s")}).drop("__s")


def warped_axis(f_hz, warp: float, rate_hz: int) -> Column:
    """Frequencies behind a first-order allpass of coefficient warp; 0 and half the rate stay."""
    w = 2 * pi / rate_hz * F.col(f_hz)
    return (w + 2 * F.atan2(warp * F.sin(w), 1 - warp * F.cos(w))) * (rate_hz / (2 * pi))


def warp(spectrum: DataFrame, coefficient: float, rate_hz: int, keys: Keys = ("ch",)) -> DataFrame:
    """The spectrum on a bent frequency axis, read at its own frequencies again (linear, re and im)."""
    bent = spectrum.withColumn("f_hz", warped_axis("f_hz", coefficient, rate_hz))
    return interpolate_as(bent, spectrum.select("f_hz").distinct(), "complex", keys=keys)


def smooth_complex(spectrum: DataFrame, fraction: float, domain: str = "complex", keys: Keys = ("ch",)) -> DataFrame:
    """(*keys, k, re, im) smoothed over 1 / fraction octave: "complex" (re and im), "magnitude" or
    "power" with the bin's own phase, or "equivalent" (power's mean with the phase of the complex mean)."""
    half = round(0.5e6 / fraction)
    w = Window.partitionBy(*keys).orderBy("__l").rangeBetween(-half, half)
    s = spectrum.where("f_hz > 0").withColumn("__l", F.round(F.log2("f_hz") * 1e6).cast("long")).withColumn("__m", F.sqrt(F.expr("re * re + im * im")))
    re, im = F.avg("re").over(w), F.avg("im").over(w)
    size = {"complex": None, "magnitude": F.avg("__m").over(w), "power": F.sqrt(F.avg(F.col("__m") * F.col("__m")).over(w)), "equivalent": F.sqrt(F.avg(F.col("__m") * F.col("__m")).over(w))}[domain]
    if domain == "complex":
        out = (re, im)
    elif domain == "equivalent":
        r = F.greatest(F.sqrt(re * re + im * im), F.lit(1e-300))
        out = (size * re / r, size * im / r)
    else:
        out = tuple(size * F.col(x) / F.greatest(F.col("__m"), F.lit(1e-300)) for x in ("re", "im"))
    return s.withColumns({"__a": out[0], "__b": out[1]}).select(*keys, "k", F.col("__a").alias("re"), F.col("__b").alias("im"))


def difference(spectrum: DataFrame, other: DataFrame, complex_: bool = False, keys: Keys = ("ch",)) -> DataFrame:
    """(*keys, k, level_db, or re and im): the spectrum over another, bin by bin."""
    both = spectrum.join(other.select(*keys, "k", F.col("re").alias("c"), F.col("im").alias("d")), [*keys, "k"])
    if complex_:
        size = F.greatest(F.expr("c * c + d * d"), F.lit(1e-300))
        return both.select(*keys, "k", (F.expr("re * c + im * d") / size).alias("re"), (F.expr("im * c - re * d") / size).alias("im"))
    ratio = F.greatest(F.expr("re * re + im * im"), F.lit(1e-300)) / F.greatest(F.expr("c * c + d * d"), F.lit(1e-300))
    return both.select(*keys, "k", (10.0 * F.log10(ratio)).alias("level_db"))


def append(first: DataFrame, second: DataFrame) -> DataFrame:
    """Channels of a second spectrum behind those of the first, read at the first one's frequencies."""
    moved = interpolate_as(second, first.select("f_hz").distinct(), "complex").join(first.select("k", "f_hz").distinct(), "f_hz")
    count = first.agg((F.coalesce(F.max("ch"), F.lit(-1)) + 1).alias("at"))
    behind = moved.join(F.broadcast(count), F.lit(True)).select((F.col("ch") + F.col("at")).alias("ch"), "k", "f_hz", "re", "im")
    return first.select("ch", "k", "f_hz", "re", "im").unionByName(behind)


def log_frequencies(spark, low_hz: float, high_hz: float, per_octave: int) -> DataFrame:
    """(i, f_hz): logarithmically spaced from low to at most high."""
    from math import floor, log2

    return spark.range(floor(log2(high_hz / low_hz) * per_octave + 1e-9) + 1).select(F.col("id").alias("i"), (low_hz * F.pow(F.lit(2.0), F.col("id") / per_octave)).alias("f_hz"))


def log_mean(spectrum: DataFrame, value: str = "value", keys: Keys = ("ch",)) -> DataFrame:
    """(*keys, value): mean over the logarithm of frequency: bins weighted by the octaves between the middles to their neighbours."""
    w = Window.partitionBy(*keys).orderBy("f_hz")
    s = spectrum.where("f_hz > 0").withColumn("l", F.log2("f_hz"))
    width = (F.coalesce(F.lead("l").over(w), F.col("l")) - F.coalesce(F.lag("l").over(w), F.col("l"))) / 2
    s = s.withColumn("w", width)
    return s.groupBy(*keys).agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value))


def crossover_weight(f_hz, low_hz: float, high_hz: float, up: bool = True) -> Column:
    """From 0 at low to 1 at high (or the reverse) as half a cosine over the logarithm of frequency."""
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log(F.greatest(F.col(f_hz), F.lit(1e-300)) / low_hz) / F.log(F.lit(high_hz / low_hz))))
    rise = 0.5 - 0.5 * F.cos(pi * x)
    return rise if up else 1.0 - rise


def merged(low: DataFrame, high: DataFrame, low_hz: float, high_hz: float, keys: Keys = ("ch",)) -> DataFrame:
    """Two spectra joined by a crossover between two frequencies: the first below, the second above."""
    both = low.join(high.select(*keys, "k", F.col("re").alias("c"), F.col("im").alias("d")), [*keys, "k"])
    w = crossover_weight("f_hz", low_hz, high_hz)
    return both.select(*keys, "k", "f_hz", (F.col("re") * (1 - w) + F.col("c") * w).alias("re"), (F.col("im") * (1 - w) + F.col("d") * w).alias("im"))


def above_threshold(spectrum: DataFrame, threshold_db: float, relative: bool = True, keys: Keys = ("ch",)) -> DataFrame:
    """(*keys, low_hz, high_hz): first and last frequency whose level is at or above a threshold, relative to the highest or absolute."""
    level = 10.0 * F.log10(F.greatest(F.expr("re * re + im * im"), F.lit(1e-300)))
    s = spectrum.withColumn("l", level)
    least = F.max("l").over(Window.partitionBy(*keys)) + threshold_db if relative else F.lit(threshold_db)
    return s.withColumn("least", least).where("l >= least").groupBy(*keys).agg(F.min("f_hz").alias("low_hz"), F.max("f_hz").alias("high_hz"))


def without_delay(spectrum: DataFrame, delays: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    """The spectrum with a delay of each channel (*keys, delay_s) taken from its phase."""
    angle = 2 * pi * F.col("f_hz") * F.col("delay_s")
    re, im = F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle), F.col("im") * F.cos(angle) + F.col("re") * F.sin(angle)
    both = spectrum.join(delays, list(keys)).withColumns({"__a": re, "__b": im})
    return both.select(*keys, "k", "f_hz", F.col("__a").alias("re"), F.col("__b").alias("im"))
