"""Chains of operators that answer a whole question in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonagrid.operators import features as ft
from sonagrid.operators import kernels as ke
from sonagrid.operators import levels as lv
from sonagrid.operators import rooms as rm
from sonagrid.operators import spectra as sp

Keys = tuple[str, ...]


def level_report(signal: DataFrame, keys: Keys = ("ch",)) -> DataFrame:
    """Length, level, peak, crest factor and energy of each channel in one aggregation."""
    rms, peak = F.stddev_pop("re"), F.max(F.abs("re"))
    return signal.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("length"),
        (20.0 * F.log10(rms)).alias("rms_dbfs"),
        (20.0 * F.log10(peak)).alias("peak_dbfs"),
        (20.0 * F.log10(peak / rms)).alias("crest_db"),
        F.sum(F.col("re") * F.col("re")).alias("energy"),
    )


def room_report(ir: DataFrame, rate_hz: int, keys: Keys = ("ch",)) -> DataFrame:
    """Definition, clarity, centre time and reverberation times of responses, their start taken as time 0."""
    moved = ir.join(rm.start(ir, keys=keys), list(keys)).where("n >= start").select(*keys, (F.col("n") - F.col("start")).alias("n"), "re")
    edc = rm.energy_decay(moved, keys)
    out = rm.definition(moved, rate_hz, keys=keys).join(rm.clarity(moved, rate_hz, keys=keys), list(keys)).join(rm.centre_time(moved, rate_hz, keys), list(keys))
    for name, high, low in (("edt_s", 0.0, -10.0), ("t20_s", -5.0, -25.0), ("t30_s", -5.0, -35.0)):
        out = out.join(rm.reverberation_time(edc, rate_hz, high, low, keys).withColumnRenamed("rt_s", name), list(keys), "left")
    return out


def octave_reverberation(ir: DataFrame, rate_hz: int, centres: list[float], keys: Keys = ("ch",)) -> DataFrame:
    """(band, rt_s): the responses through an octave filter bank, then the decay of each band."""
    bands = ke.octave_filter_bank(ir, centres, rate_hz, keys=keys)
    by = (*keys, "band")
    return rm.reverberation_time(rm.energy_decay(bands, by), rate_hz, -5.0, -25.0, by)


def speech_features(signal: DataFrame, rate_hz: int, window: int, hop: int, bands: int = 24, count: int = 12, keys: Keys = ("ch",)) -> DataFrame:
    """(frame, c, value): mel-cepstral coefficients of frames: one transform, two small joins."""
    s = sp.stft(signal, window, hop, "hamming", keys=keys).select(*keys, "frame", "k", F.expr("re * re + im * im").alias("power"))
    by = (*keys, "frame")
    mel = ft.weighted_bands(s, ft.mel_weights(window // 2 + 1, rate_hz, bands), by)
    return ft.cepstral_coefficients(mel, bands, count, by)


def normalised_spectra(signal: DataFrame, window: int, hop: int, keys: Keys = ("ch",)) -> DataFrame:
    """(k, level_db): Welch spectra of channels brought to the same level."""
    power = sp.welch(lv.normalize(signal, 0.0, peak=False, each_channel=True, keys=keys), window, hop, keys=keys)
    return power.select(*keys, "k", (10.0 * F.log10(F.greatest("power", F.lit(1e-30)))).alias("level_db"))
