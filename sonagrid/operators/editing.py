"""Cutting, shifting and combining signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Keys = tuple[str, ...]


def time_slice(signal: DataFrame, first: int, stop: int) -> DataFrame:
    """Samples first .. stop - 1, counted from 0 again."""
    return signal.where((F.col("n") >= first) & (F.col("n") < stop)).withColumn("n", F.col("n") - first)


def pad_trim(signal: DataFrame, length: int, at_end: bool = True, keys: Keys = ("ch",)) -> DataFrame:
    """Exactly length samples in each channel: cut, or zeros added, at the end or the start."""
    if not at_end:
        last = F.max("n").over(Window.partitionBy(*keys))
        signal = signal.withColumn("n", F.col("n") + (length - 1) - last)
    grid = signal.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))).alias("n"))
    return grid.join(signal.where(F.col("n").between(0, length - 1)), [*keys, "n"], "left").select(*keys, "n", F.coalesce("re", F.lit(0.0)).alias("re"))


def delay(signal: DataFrame, samples: int, keys: Keys = ("ch",)) -> DataFrame:
    """Later by a number of samples; zeros come first, the signal gets longer."""
    zeros = signal.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long"))).alias("n"), F.lit(0.0).alias("re"))
    moved = signal.select(*keys, (F.col("n") + samples).alias("n"), "re")
    return moved.unionByName(zeros) if samples else signal


def trim_level(signal: DataFrame, threshold_db: float, keys: Keys = ("ch",)) -> DataFrame:
    """From the first to the last sample within threshold_db of the channel's peak."""
    by = Window.partitionBy(*keys)
    loud = signal.withColumn("__top", F.max(F.abs("re")).over(by))
    loud = loud.withColumn("__hit", F.when(F.abs("re") >= F.col("__top") * 10 ** (threshold_db / 20), F.col("n")))
    loud = loud.withColumn("__a", F.min("__hit").over(by)).withColumn("__b", F.max("__hit").over(by))
    return loud.where(F.col("n").between(F.col("__a"), F.col("__b"))).select(*keys, (F.col("n") - F.col("__a")).alias("n"), "re")


def reverse(signal: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    return signal.withColumn("n", F.max("n").over(Window.partitionBy(*keys)) - F.col("n"))


def get_channels(signal: DataFrame, channels: list) -> DataFrame:
    """The listed channels, numbered in the order of the list."""
    order = F.create_map(*[F.lit(x) for i, c in enumerate(channels) for x in (c, i)])
    return signal.where(F.col("ch").isin(*channels)).withColumn("ch", order[F.col("ch")].cast("long"))


def remove_channel(signal: DataFrame, channel) -> DataFrame:
    return signal.where(F.col("ch") != channel)


def sum_channels(signal: DataFrame) -> DataFrame:
    return signal.groupBy("n").agg(F.sum("re").alias("re"))


def mean_channels(signal: DataFrame) -> DataFrame:
    return signal.groupBy("n").agg(F.avg("re").alias("re"))


def mid_side(signal: DataFrame, left, right, inverse: bool = False, keys: Keys = ()) -> DataFrame:
    """(*keys, n, a, b): half sum and half difference of two channels; inverse: sum and difference."""
    scale = 1.0 if inverse else 0.5
    pair = signal.where(F.col("ch").isin(left, right)).groupBy(*keys, "n").agg(
        F.max(F.when(F.col("ch") == left, F.col("re"))).alias("l"), F.max(F.when(F.col("ch") == right, F.col("re"))).alias("r")
    )
    return pair.where("l is not null and r is not null").select(*keys, "n", ((F.col("l") + F.col("r")) * scale).alias("a"), ((F.col("l") - F.col("r")) * scale).alias("b"))


def in_pairs(signal: DataFrame) -> DataFrame:
    """signal with pair, and ch 0 or 1 in it: channels 2 j and 2 j + 1 are pair j."""
    return signal.withColumns({"pair": F.floor(F.col("ch") / 2), "ch": F.pmod("ch", F.lit(2).cast("long"))})


def append(first: DataFrame, second: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    """second behind first, channel by channel."""
    lengths = first.groupBy(*keys).agg((F.max("n") + 1).alias("__at"))
    moved = second.join(lengths, list(keys)).select(*keys, (F.col("n") + F.col("__at")).alias("n"), "re")
    return first.select(*keys, "n", "re").unionByName(moved)


def mix(signals: list[DataFrame], keys: Keys = ("ch",)) -> DataFrame:
    """Sample-wise sum; missing samples are zero."""
    out = signals[0].select(*keys, "n", "re")
    for s in signals[1:]:
        out = out.unionByName(s.select(*keys, "n", "re"))
    return out.groupBy(*keys, "n").agg(F.sum("re").alias("re"))


def interleave(signal: DataFrame, factor: int) -> DataFrame:
    """Polyphase form: (phase, position) of each sample."""
    return signal.withColumn("phase", F.pmod("n", F.lit(factor))).withColumn("m", F.floor(F.col("n") / factor).cast("long"))


def hold(signal: DataFrame, factor: int) -> DataFrame:
    """Each sample repeated factor times."""
    return signal.select("ch", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(factor - 1).cast("long")), lambda k: F.col("n") * factor + k)).alias("n"), "re")


# --- bands ----------------------------------------------------------------------


def add_band(bands: DataFrame, band: DataFrame, number: int | None = None) -> DataFrame:
    """(band, ch, n, re) with a signal as band ``number``, those from there on one higher; by default behind the last."""
    if number is None:
        last = bands.agg((F.coalesce(F.max("band"), F.lit(-1)) + 1).alias("band"))
        return bands.unionByName(band.join(F.broadcast(last), F.lit(True)).select(*bands.columns))
    moved = bands.withColumn("band", F.when(F.col("band") >= number, F.col("band") + 1).otherwise(F.col("band")))
    return moved.unionByName(band.withColumn("band", F.lit(number)).select(*bands.columns))


def remove_band(bands: DataFrame, number: int) -> DataFrame:
    """Without a band; those behind it one lower."""
    left = bands.where(F.col("band") != number)
    return left.withColumn("band", F.when(F.col("band") > number, F.col("band") - 1).otherwise(F.col("band")))


def swap_bands(bands: DataFrame, order: list[int]) -> DataFrame:
    """Bands in another order: place i has what band order[i] was."""
    return bands.withColumn("band", F.array_position(F.array(*[F.lit(b) for b in order]), F.col("band").cast("int")).cast("int") - 1)


def collapse(bands: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    """Bands summed to one signal."""
    return bands.groupBy(*keys, "n").agg(F.sum("re").alias("re"))


def constrain_amplitude(signal: DataFrame, keys: Keys = ()) -> DataFrame:
    """A signal that goes beyond -1 to 1 scaled down to it, all channels (of keys) alike; scale tells by what."""
    peak = F.max(F.abs("re")).over(Window.partitionBy(*keys)) if keys else None
    if peak is None:
        top = signal.agg(F.max(F.abs("re")).alias("peak"))
        wide = signal.join(F.broadcast(top), F.lit(True))
    else:
        wide = signal.withColumn("peak", peak)
    scale = F.greatest(F.col("peak"), F.lit(1.0))
    return wide.select(*signal.columns, scale.alias("scale")).withColumn("re", F.col("re") / F.col("scale"))


def side_by_side(bands: DataFrame, count: int, keys: Keys = ("ch",)) -> DataFrame:
    """(*keys, n, b0 ... ): the bands of a sample in one row."""
    return bands.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("band") == b, F.col("re"))).alias(f"b{b}") for b in range(count)])
