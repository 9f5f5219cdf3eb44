"""Room acoustics: descriptors of impulse responses, modes, image sources."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Keys = tuple[str, ...]

#: Samples of a response that auralise() sends to every task.
MOST_TAPS = 100_000


def start(ir: DataFrame, threshold_db: float = 20.0, keys: Keys = ("ch",)) -> DataFrame:
    """(start): the sample after the last one before the peak that is more than threshold_db below it."""
    by = Window.partitionBy(*keys)
    top = ir.withColumn("__top", F.max(F.struct(F.abs("re").alias("a"), (-F.col("n")).alias("i"))).over(by))
    low = F.when((F.col("n") < -F.col("__top.i")) & (F.abs("re") < F.col("__top.a") * 10 ** (-threshold_db / 20)), F.col("n"))
    return top.groupBy(*keys).agg((F.coalesce(F.max(low), F.lit(-1)) + 1).alias("start"))


def energy_decay(ir: DataFrame, keys: Keys = ("ch",), levels: int | None = None) -> DataFrame:
    """(n, edc_db): energy from n to the end over the whole energy, in dB (backward
    integration): a running sum over blocks, from the end."""
    from sonagrid.operators.scans import before

    rows = ir.select(*keys, "n", (-F.col("n")).alias("back"), (F.col("re") * F.col("re")).cast("double").alias("e"))
    whole = rows.groupBy(*keys).agg(F.sum("e").alias("whole"))
    ahead = F.col("e") + F.coalesce("later", F.lit(0.0))
    both = before(rows, keys, "back", "e", F.sum, "later", levels=levels).join(whole, list(keys))
    return both.select(*keys, "n", (10.0 * F.log10(F.greatest(ahead / F.col("whole"), F.lit(1e-300)))).alias("edc_db"))


def reverberation_time(edc: DataFrame, rate_hz: int, high_db: float = -5.0, low_db: float = -35.0, keys: Keys = ("ch",)) -> DataFrame:
    """(rt_s): 60 dB over the slope of the regression line between two levels of the decay;
    T20: -5 to -25, T30: -5 to -35, EDT: 0 to -10."""
    part = edc.where(F.col("edc_db").between(low_db - 1e-9, high_db + 1e-9))
    slope = F.regr_slope("edc_db", F.col("n") / float(rate_hz))
    return part.groupBy(*keys).agg((-60.0 / slope).alias("rt_s"))


def _split(ir: DataFrame, samples: int, keys: Keys) -> DataFrame:
    e = F.col("re") * F.col("re")
    return ir.groupBy(*keys).agg(F.sum(F.when(F.col("n") < samples, e).otherwise(0.0)).alias("early"), F.sum(e).alias("whole"))


def definition(ir: DataFrame, rate_hz: int, seconds: float = 0.05, keys: Keys = ("ch",)) -> DataFrame:
    """Share of the energy in the first part (D50)."""
    return _split(ir, round(seconds * rate_hz), keys).select(*keys, (F.col("early") / F.col("whole")).alias("definition"))


def clarity(ir: DataFrame, rate_hz: int, seconds: float = 0.08, keys: Keys = ("ch",)) -> DataFrame:
    """Early over late energy in dB (C80)."""
    return _split(ir, round(seconds * rate_hz), keys).select(*keys, (10.0 * F.log10(F.expr("early / (whole - early)"))).alias("clarity_db"))


def centre_time(ir: DataFrame, rate_hz: int, keys: Keys = ("ch",)) -> DataFrame:
    e = F.col("re") * F.col("re")
    return ir.groupBy(*keys).agg((F.sum(e * F.col("n")) / F.sum(e) / float(rate_hz)).alias("centre_time_s"))


def interaural_correlation(ir: DataFrame, left, right, most: int, keys: Keys = ()) -> DataFrame:
    """(*keys, iacc): largest absolute normalised correlation of two channels over lags up to most."""
    lags = F.explode(F.sequence(F.lit(-most).cast("long"), F.lit(most).cast("long"))).alias("lag")
    moved = ir.where(F.col("ch") == left).select(*keys, "n", F.col("re").alias("l"), lags).withColumn("n", F.col("n") + F.col("lag"))
    sums = ir.where(F.col("ch") == right).join(moved, [*keys, "n"]).groupBy(*keys, "lag").agg(F.sum(F.col("l") * F.col("re")).alias("v"))
    e = lambda c: F.sum(F.when(F.col("ch") == c, F.col("re") * F.col("re")))
    norm = ir.where(F.col("ch").isin(left, right)).groupBy(*keys).agg((e(left) * e(right)).alias("e"))
    most_ = sums.groupBy(*keys).agg(F.max(F.abs("v")).alias("v"))
    both = most_.join(norm, list(keys)) if keys else most_.join(norm, F.lit(True))
    return both.select(*keys, (F.col("v") / F.sqrt("e")).alias("iacc"))


def inside(points: DataFrame, lengths: tuple[float, float, float]) -> DataFrame:
    """points (pid, x, y, z) with inside: whether they are in a box with a corner at 0."""
    test = F.lit(True)
    for a, length in zip("xyz", lengths):
        test = test & (F.col(a) >= 0) & (F.col(a) <= length)
    return points.withColumn("inside", test)


def image_sources_by_wall(
    images: DataFrame, walls: DataFrame, lengths: tuple[float, float, float], source: tuple[float, float, float], receiver: tuple[float, float, float], c: float = 343.0
) -> DataFrame:
    """(i, j, k, f_hz, distance_m, gain) of images (i, j, k) when each wall absorbs its own share of each band.

    walls: (axis 0 to 2, side 0 or 1, f_hz, absorption). An image of number i
    along an axis has bounced |i| times, in turn off both sides; the far side
    first for i > 0. gain is the product of the walls' reflections over the distance.
    """
    wide = walls.groupBy("f_hz").agg(*[F.max(F.when((F.col("axis") == a) & (F.col("side") == b), 0.5 * F.log(1.0 - F.col("absorption")))).alias(f"w{a}{b}") for a in range(3) for b in range(2)])
    log_gain, square = F.lit(0.0), F.lit(0.0)
    for a, (name, length, s, r) in enumerate(zip("ijk", lengths, source, receiver)):
        n = F.col(name)
        far = F.when(n > 0, F.ceil(n / 2)).otherwise(F.floor(-n / 2))
        log_gain = log_gain + far * F.col(f"w{a}1") + (F.abs(n) - far) * F.col(f"w{a}0")
        gap = F.when(F.pmod(n, F.lit(2)) == 0, n * length + s).otherwise((n + 1) * length - s) - r
        square = square + gap * gap
    return images.join(wide, F.lit(True)).select("i", "j", "k", "f_hz", F.sqrt(square).alias("distance_m"), (F.exp(log_gain) / F.sqrt(square)).alias("gain"))


def reverberant_tail(spark: SparkSession, rt_s: float, start: int, length: int, rate_hz: int, level: float, seed: int = 0) -> DataFrame:
    """(n, re): noise from sample start on that decays by 60 dB in rt_s; level is its deviation at start."""
    from sonagrid.sources.generators import noise

    decay = F.pow(F.lit(10.0), -3.0 * F.col("n") / (rt_s * rate_hz))
    return noise(spark, length, 1, seed).select((F.col("n") + start).alias("n"), (F.col("re") * decay * level).alias("re"))


def best_decay_range(edc: DataFrame, rate_hz: int, high_db: float = -5.0, lows_db: tuple[float, ...] = (-15.0, -25.0, -35.0, -45.0, -65.0), keys: Keys = ("ch",)) -> DataFrame:
    """(low_db, rt_s, r2): of regression lines from high_db to each low, the one that fits best; the longer range of equals."""
    ranges = F.explode(F.array(*[F.lit(v) for v in lows_db])).alias("low_db")
    reach = F.min("edc_db").over(Window.partitionBy(*keys))
    part = edc.withColumn("least", reach).select(*keys, "n", "edc_db", "least", ranges)
    part = part.where((F.col("edc_db") <= high_db) & (F.col("edc_db") >= F.col("low_db")) & (F.col("least") <= F.col("low_db")))
    t = F.col("n") / float(rate_hz)
    fits = part.groupBy(*keys, "low_db").agg((-60.0 / F.regr_slope("edc_db", t)).alias("rt_s"), F.regr_r2("edc_db", t).alias("r2"), F.count(F.lit(1)).alias("c")).where("c > 2")
    best = fits.groupBy(*keys).agg(F.max(F.struct(F.round("r2", 9).alias("fit"), (-F.col("low_db")).alias("range"), "low_db", "rt_s", "r2")).alias("b"))
    return best.select(*keys, "b.low_db", "b.rt_s", "b.r2")


def complex_mode_indicator(spectra: DataFrame) -> DataFrame:
    """(f_hz, indicator): energy of the spectra (ch, f_hz, re, im) at each frequency, the
    square of the singular value of the one-column matrix of all channels."""
    return spectra.groupBy("f_hz").agg(F.sum(F.expr("re * re + im * im")).alias("indicator"))


def shoebox_modes(spark: SparkSession, lengths: tuple[float, float, float], most_hz: float, c: float = 343.0) -> DataFrame:
    """(nx, ny, nz, f_hz, kind) of a rigid box up to a frequency."""
    top = [int(2 * x * most_hz / c) for x in lengths]
    axis = lambda name, k: F.explode(F.sequence(F.lit(0), F.lit(k))).alias(name)
    n = spark.range(1).select(axis("nx", top[0])).select("nx", axis("ny", top[1])).select("nx", "ny", axis("nz", top[2]))
    f = c / 2 * F.sqrt(sum((F.col(k) / x * F.col(k) / x for k, x in zip(("nx", "ny", "nz"), lengths)), F.lit(0.0)))
    kind = F.element_at(F.array(F.lit("axial"), F.lit("tangential"), F.lit("oblique")), sum(((F.col(k) > 0).cast("int") for k in ("nx", "ny", "nz")), F.lit(0)))
    return n.where("nx + ny + nz > 0").select("nx", "ny", "nz", f.alias("f_hz"), kind.alias("kind")).where(F.col("f_hz") <= most_hz)


def image_sources(spark: SparkSession, lengths: tuple[float, float, float], source: tuple[float, float, float], receiver: tuple[float, float, float], order: int, reflection: float, rate_hz: int, c: float = 343.0) -> DataFrame:
    """(i, j, k, distance_m, n, gain): mirror images up to an order in each direction, as arrivals at a receiver."""
    axis = lambda name: F.explode(F.sequence(F.lit(-order), F.lit(order))).alias(name)
    g = spark.range(1).select(axis("i")).select("i", axis("j")).select("i", "j", axis("k"))

    def gap(name: str, length: float, s: float, r: float) -> Column:
        """Coordinate of image number name along one axis, seen from the receiver."""
        even = F.pmod(F.col(name), F.lit(2)) == 0
        return F.when(even, F.col(name) * length + s).otherwise((F.col(name) + 1) * length - s) - r

    d = [gap(name, length, s, r) for name, length, s, r in zip("ijk", lengths, source, receiver)]
    distance = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    bounces = F.abs("i") + F.abs("j") + F.abs("k")
    out = g.select("i", "j", "k", distance.alias("distance_m"), bounces.alias("bounces"))
    arrival = F.floor(F.col("distance_m") / c * rate_hz + 0.5).cast("long")
    return out.select("i", "j", "k", "distance_m", arrival.alias("n"), (F.pow(F.lit(reflection), F.col("bounces")) / F.col("distance_m")).alias("gain"))


def synthetic_response(arrivals: DataFrame) -> DataFrame:
    """(n, re): arrivals at the same sample summed."""
    return arrivals.groupBy("n").agg(F.sum("gain").alias("re"))


def sabine(volume: Column, area: Column, absorption: Column) -> Column:
    """Reverberation time after Sabine."""
    return 0.161 * volume / (area * absorption)


def eyring(volume: Column, area: Column, absorption: Column) -> Column:
    return 0.161 * volume / (-area * F.log(1.0 - absorption))


def schroeder_frequency(volume: Column, rt_s: Column) -> Column:
    return 2000.0 * F.sqrt(rt_s / volume)


def critical_distance(volume: Column, rt_s: Column) -> Column:
    """Where direct and diffuse sound are equally loud."""
    return F.sqrt(13.82 * volume / (16 * pi * rt_s * 343.0) * 4.0) / 2.0


def modal_density(f_hz: Column, volume: Column, area: Column, edges: Column, c: float = 343.0) -> Column:
    """Modes for each Hz of a shoebox of a volume, wall area and total edge length."""
    return 4 * pi * volume * f_hz * f_hz / c**3 + pi / 2 * area * f_hz / c**2 + edges / (8 * c)


def mixing_time(volume: Column, physical: bool = True) -> Column:
    """Milliseconds until the field is diffuse: root of the volume, or the perceptual estimate."""
    return F.sqrt(volume) if physical else 0.0117 * volume + 50.1


def modal_response(modes: DataFrame, source: tuple, receiver: tuple, lengths: tuple, frequencies: DataFrame, damping: float, c: float = 343.0) -> DataFrame:
    """(f_hz, re, im): modes (nx, ny, nz, f_hz) summed at a table of frequencies."""

    def shape(place):
        out = F.lit(1.0)
        for n, x, length in zip(("nx", "ny", "nz"), place, lengths):
            out = out * F.cos(F.col(n) * pi * x / length)
        return out

    weight = sum(((F.col(n) > 0).cast("int") for n in ("nx", "ny", "nz")), F.lit(0))
    m = modes.select((2 * pi * F.col("f_hz")).alias("w0"), (shape(source) * shape(receiver) * F.pow(F.lit(2.0), weight)).alias("g"))
    w = 2 * pi * F.col("f_hz")
    both = frequencies.join(m, F.lit(True)).withColumn("a", F.col("w0") * F.col("w0") - w * w).withColumn("b", 2 * damping * w)
    size = F.col("a") * F.col("a") + F.col("b") * F.col("b")
    return both.groupBy("f_hz").agg((F.sum(F.col("g") * F.col("a") / size) * c * c).alias("re"), (-F.sum(F.col("g") * F.col("b") / size) * c * c).alias("im"))


def find_modes(power: DataFrame, low_hz: float, high_hz: float, least_gap_hz: float) -> DataFrame:
    """(f_hz, indicator): peaks over frequency of the channels' summed power that no larger one within the gap hides."""
    total = power.where(F.col("f_hz").between(low_hz, high_hz)).groupBy("f_hz").agg(F.sum("power").alias("indicator"))
    milli = F.round(F.col("f_hz") * 1000).cast("long")
    around = Window.orderBy("__m").rangeBetween(-round(least_gap_hz * 1000), round(least_gap_hz * 1000))
    return total.withColumn("__m", milli).withColumn("__top", F.max("indicator").over(around)).where("indicator = __top").select("f_hz", "indicator")


def bass_ratio(rt: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    """(bass_ratio): reverberation at 125 and 250 Hz over that at 500 and 1000 Hz, from (centre_hz, rt_s)."""
    part = lambda *f: F.sum(F.when(F.col("centre_hz").isin(*f), F.col("rt_s")))
    return rt.groupBy(*keys).agg((part(125.0, 250.0) / part(500.0, 1000.0)).alias("bass_ratio"))


def auralise(signal: DataFrame, response: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    """signal convolved with a response (n, re) of at most MOST_TAPS samples, such as
    early reflections; long responses: sonagrid.operators.kernels.convolve_long."""
    if response.limit(MOST_TAPS + 1).count() > MOST_TAPS:
        raise ValueError("a long response: use convolve_long")
    taps = response.agg(F.sort_array(F.collect_list(F.struct(F.col("n").alias("m"), F.col("re").alias("b")))).alias("taps"))
    spread = signal.join(F.broadcast(taps), F.lit(True)).select(*keys, "n", "re", F.inline("taps"))
    return spread.groupBy(*keys, (F.col("n") + F.col("m")).alias("n")).agg(F.sum(F.col("re") * F.col("b")).alias("re"))
