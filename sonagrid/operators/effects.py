"""Audio effects. Memoryless ones and fixed delays are columns; level followers
and feedback run as kernels (sonagrid.operators.kernels)."""

from __future__ import annotations

from math import log10, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonagrid.functions import from_db, to_db

Keys = tuple[str, ...]


def distortion(signal: DataFrame, kind: str = "arctan", level_db: float = 20.0, offset_db: float | None = None, keep_peak: bool = True, keys: Keys = ("ch",)) -> DataFrame:
    """A static curve on each channel, brought to peak 1 before, with an offset
    in front of it; keep_peak brings the result back to the channel's peak."""
    by = Window.partitionBy(*keys)
    g, o = 10 ** (level_db / 20), 0.0 if offset_db is None else 10 ** (offset_db / 20)
    x = F.col("re") / F.col("__peak")
    cubic = (x * (2 / 3) + o) * g
    wet = {
        "arctan": F.atan(x * g + o) * (2 / pi),
        "hard_clip": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x * g + o)),
        "soft_clip": F.greatest(F.lit(-2 / 3), F.least(F.lit(2 / 3), cubic - cubic * cubic * cubic / 3)),
        "tanh": F.tanh(x * g + o),
        "clean": F.col("re"),
    }[kind]
    out = signal.withColumn("__peak", F.max(F.abs("re")).over(by)).withColumn("re", wet)
    if keep_peak and kind != "clean":
        out = out.withColumn("re", F.col("re") * F.col("__peak") / F.max(F.abs("re")).over(by))
    return out.drop("__peak")


def distortions(signal: DataFrame, kinds: list[tuple[str, float, float]], keys: Keys = ("ch",)) -> DataFrame:
    """Several curves summed: (kind, level_db, share)."""
    out = None
    for kind, level_db, share in kinds:
        one = distortion(signal, kind, level_db, keys=keys).withColumn("re", F.col("re") * share)
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*keys, "n").agg(F.sum("re").alias("re"))


def custom(signal: DataFrame, curve) -> DataFrame:
    """Any function of a column to a column as the curve."""
    return signal.withColumn("re", curve(F.col("re")))


def lfo(rate_hz: int, frequency_hz: float, shape: str = "harmonic", phase: float = 0.0) -> Column:
    """Slow oscillator at sample n, between -1 and 1."""
    t = F.col("n") * (frequency_hz / rate_hz) + phase / (2 * pi)
    part = t - F.floor(t)
    return {
        "harmonic": F.sin(2 * pi * t),
        "square": F.when(part < 0.5, 1.0).otherwise(-1.0),
        "sawtooth": 2.0 * part - 1.0,
        "triangle": 1.0 - 4.0 * F.abs(part - 0.5),
    }[shape]


def tremolo(signal: DataFrame, modulator: Column, depth: float = 0.5) -> DataFrame:
    """The signal times |1 + depth * modulator|."""
    return signal.withColumn("re", F.col("re") * F.abs(depth * modulator + 1.0))


def ring_modulation(signal: DataFrame, rate_hz: int, frequency_hz: float) -> DataFrame:
    return signal.withColumn("re", F.col("re") * F.cos(F.col("n") * (2 * pi * frequency_hz / rate_hz)))


def echo(signal: DataFrame, samples: int, feedback: float, repeats: int, mix: float = 0.5, keys: Keys = ("ch",)) -> DataFrame:
    """Delayed copies of the input, each weaker by feedback; as long as the input."""
    w = Window.partitionBy(*keys).orderBy("n")
    wet = F.lit(0.0)
    for k in range(1, repeats + 1):
        wet = wet + feedback ** (k - 1) * F.coalesce(F.lag("re", k * samples).over(w), F.lit(0.0))
    return signal.withColumn("re", (1 - mix) * F.col("re") + mix * wet)


def vibrato(signal: DataFrame, rate_hz: int, frequency_hz: float, depth_samples: float, keys: Keys = ("ch",)) -> DataFrame:
    """The signal read at n - depth (1 + sin) with linear interpolation: each output
    finds its two neighbours by joins on the sample index; zero before the start."""
    at = F.col("n") - depth_samples * (1.0 + F.sin(F.col("n") * (2 * pi * frequency_hz / rate_hz)))
    asked = signal.select(*keys, "n", F.floor(at).cast("long").alias("i"), (at - F.floor(at)).alias("f"))
    a = signal.select(*keys, F.col("n").alias("i"), F.col("re").alias("a"))
    b = signal.select(*keys, (F.col("n") - 1).alias("i"), F.col("re").alias("b"))
    out = asked.join(a, [*keys, "i"], "left").join(b, [*keys, "i"], "left")
    return out.select(*keys, "n", ((1 - F.col("f")) * F.coalesce("a", F.lit(0.0)) + F.col("f") * F.coalesce("b", F.lit(0.0))).alias("re"))


def compression_curve(level_db: Column, threshold_db: float, ratio: float, knee_db: float = 0.0) -> Column:
    """Output level in dB of an input level; the knee is a parabola around the threshold."""
    over = level_db - threshold_db
    hard = F.when(over <= 0, level_db).otherwise(threshold_db + over / ratio)
    if knee_db == 0:
        return hard
    soft = level_db + (1 / ratio - 1) * F.pow(over + knee_db / 2, F.lit(2.0)) / (2 * knee_db)
    return F.when(F.abs(over) * 2 <= knee_db, soft).otherwise(hard)


def static_compressor(signal: DataFrame, threshold_db: float, ratio: float, knee_db: float = 0.0) -> DataFrame:
    """The curve on each sample's own level (no attack or release)."""
    level = to_db("re")
    return signal.withColumn("re", F.col("re") * from_db(compression_curve(level, threshold_db, ratio, knee_db) - level))


def stereo_width(signal: DataFrame, left, right, width: float, keys: Keys = ()) -> DataFrame:
    """(*keys, n, a, b): left and right with the side scaled by width."""
    from sonagrid.operators.editing import mid_side

    ms = mid_side(signal, left, right, keys=keys)
    return ms.select(*keys, "n", (F.col("a") + width * F.col("b")).alias("a"), (F.col("a") - width * F.col("b")).alias("b"))


def rhythm_seconds(beats_per_minute: float, note: float, dotted: bool = False, triplet: bool = False) -> float:
    """Length of a note (0.25: quarter) at a tempo of quarters."""
    return 240.0 / beats_per_minute * note * (1.5 if dotted else 1.0) * (2 / 3 if triplet else 1.0)


def chorus(signal: DataFrame, rate_hz: int, voices: list[tuple[float, float, float]], keys: Keys = ("ch",)) -> DataFrame:
    """The mean of the signal and copies read at a moving place, linear between samples,
    zero before the start; voices: (base delay, depth, frequency in Hz), delays in samples.
    A place's two neighbours are found by a join on (channel, sample)."""
    asked = F.array(
        *[
            F.struct((F.col("n") - base - depth * F.sin(F.col("n") * (2 * pi * f / rate_hz))).alias("at"))
            for base, depth, f in voices
        ]
    )
    places = signal.select(*keys, "n", F.inline(asked)).withColumn("f", F.col("at") - F.floor("at"))
    ends = F.inline(F.array(F.struct(F.floor("at").cast("long").alias("i"), (1 - F.col("f")).alias("w")), F.struct((F.floor("at") + 1).cast("long").alias("i"), F.col("f").alias("w"))))
    read = places.where("at >= 0").select(*keys, "n", ends).join(signal.withColumnsRenamed({"n": "i"}), [*keys, "i"])
    parts = read.select(*keys, "n", (F.col("w") * F.col("re")).alias("re")).unionByName(signal.select(*keys, "n", "re"))
    return parts.groupBy(*keys, "n").agg((F.sum("re") / (1 + len(voices))).alias("re"))


def spectral_subtraction(
    signal: DataFrame,
    window: int,
    threshold_db: float | None = None,
    noise_frames: int | None = None,
    exponent: float = 2.0,
    factor: float = 1.0,
    floor_db: float = -60.0,
    forgetting: float = 0.0,
    keys: Keys = ("ch",),
) -> DataFrame:
    """Noise taken from spectra: |Y|^p = max(|X|^p - factor * |N|^p, floor * |X|^p) with the phase of X.

    The noise is the mean of |X|^p over frames without activity: those whose
    level is threshold_db below the channel's loudest frame, or the first
    noise_frames. With forgetting it follows the signal: each frame's noise is
    the exponentially weighted mean of silent frames up to it (weights
    forgetting ** age), or |X|^p of the first frame where there are none yet.
    Frames are Hann windows at half overlap.
    """
    from sonagrid.operators.spectra import istft, stft

    if (threshold_db is None) == (noise_frames is None):
        raise ValueError("give threshold_db or noise_frames")
    s = stft(signal, window, window // 2, "hann", keys=keys).withColumn("p", F.pow(F.expr("re * re + im * im"), exponent / 2))
    if noise_frames is not None:
        silent = s.select(*keys, "frame", "k", "p", (F.col("frame") < noise_frames).alias("silent"))
    else:
        level = s.groupBy(*keys, "frame").agg(F.sum(F.expr("re * re + im * im")).alias("e"))
        level = level.withColumn("silent", F.col("e") < F.max("e").over(Window.partitionBy(*keys)) * 10 ** (threshold_db / 10)).drop("e")
        silent = s.join(level, [*keys, "frame"]).select(*keys, "frame", "k", "p", "silent")
    if forgetting:
        # weighted sums of frames up to this one, without large powers: pairs of frames within the weights' reach
        reach = int(-36 / log10(forgetting) / 2) + 1
        near = silent.where("silent").select(*keys, "k", "p", F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("age"), F.col("frame").alias("of"))
        near = near.select(*keys, "k", (F.col("of") + F.col("age")).alias("frame"), F.pow(F.lit(forgetting), F.col("age")).alias("w"), "p")
        mean = near.groupBy(*keys, "frame", "k").agg((F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("noise"))
        first = s.where("frame = 0").select(*keys, "k", F.col("p").alias("first"))
        both = s.join(mean, [*keys, "frame", "k"], "left").join(first, [*keys, "k"]).withColumn("noise", F.coalesce("noise", "first"))
    else:
        mean = silent.where("silent").groupBy(*keys, "k").agg(F.avg("p").alias("noise"))
        both = s.join(mean, [*keys, "k"], "left").withColumn("noise", F.coalesce("noise", F.lit(0.0)))
    left = F.greatest(F.col("p") - factor * F.col("noise"), 10 ** (floor_db / 20 * exponent) * F.col("p"))
    gain = F.when(F.col("p") > 0, F.pow(left / F.col("p"), 1 / exponent)).otherwise(0.0)
    return istft(both.select(*keys, "frame", "k", (F.col("re") * gain).alias("re"), (F.col("im") * gain).alias("im")), window, window // 2, "hann", keys)
