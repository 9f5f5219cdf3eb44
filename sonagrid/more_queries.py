"""More registered queries with their SQL: the frequency axis, rooms, bands,
effects and designs; see sonagrid.queries."""

from __future__ import annotations

import uuid
from math import cos, log10, pi, sqrt

import numpy as np
from pyspark.sql import functions as F

from sonagrid import functions as fn
from sonagrid import plans
from sonagrid import streaming as stream
from sonagrid.functions import stable
from sonagrid.operators import beamforming as bf
from sonagrid.operators import design as de
from sonagrid.operators import editing as ed
from sonagrid.operators import effects as fx
from sonagrid.operators import features as ft
from sonagrid.operators import filters as fi
from sonagrid.operators import kernels as ke
from sonagrid.operators import levels as lv
from sonagrid.operators import phase_design as pe
from sonagrid.operators import pole_search as ps
from sonagrid.operators import recursive as rc
from sonagrid.operators import responses as rs
from sonagrid.operators import rooms as rm
from sonagrid.operators import similarity as si
from sonagrid.operators import spectra as sp
from sonagrid.operators import transforms as tf
from sonagrid.queries import _DFT, _HANN, _MICS, _PEAK, _POWER, _STFT, E, P, V, _bank_sql, _basis_sql, _impulse, _mics, _out, _power, _r, _stft, _taps_sql, _wavelet_sql, _weights_sql, octave_reverberation, query, speech_features
from sonagrid.sources import generators as ge
from sonagrid.sources import tables as tb
from sonagrid.sources import wav
from sonagrid.state import shared
from sonagrid.streaming import ordered as od


def _spectrum(spark, d):
    return sp.dft(tb.vectors(spark, d), 64)


def _at(spark, *f):
    return spark.createDataFrame([(x,) for x in f], "f_hz double")


# --- frequency axis ----------------------------------------------------------------

_ASKED = "q as (select cast(unnest([0.003, 0.05, 0.123, 0.377, 0.6]) as double) as f), o as (select ch, q.f, least(greatest(floor(q.f * 64), 0), 31)::integer as k, least(greatest(q.f * 64 - least(greatest(floor(q.f * 64), 0), 31), 0), 1) as t from (select distinct ch from s), q)"
_BOTH = "from o join s a on a.ch = o.ch and a.k = o.k join s b on b.ch = o.ch and b.k = o.k + 1"


@query(f"with {_DFT}, {_ASKED} select o.ch, f as f_hz, {_r('a.re + t * (b.re - a.re)')} as re, {_r('a.im + t * (b.im - a.im)')} as im {_BOTH}")
def interpolate_complex(spark, d):
    return _out(sp.interpolate_as(_spectrum(spark, d), _at(spark, 0.003, 0.05, 0.123, 0.377, 0.6), "complex"), "re", "im")


@query(f"with {_DFT}, {_ASKED} select o.ch, f as f_hz, {_r('case when f > 0.5 then 0 else a.re * a.re + a.im * a.im + t * (b.re * b.re + b.im * b.im - a.re * a.re - a.im * a.im) end')} as value {_BOTH}")
def interpolate_power_zero_edges(spark, d):
    return _out(sp.interpolate_as(_spectrum(spark, d), _at(spark, 0.003, 0.05, 0.123, 0.377, 0.6), "power", edges="zero"), "value")


@query(f"with {_DFT}, {_ASKED} select o.ch, f as f_hz, {_r('case when t > 0.5 then sqrt(b.re * b.re + b.im * b.im) else sqrt(a.re * a.re + a.im * a.im) end')} as value {_BOTH}")
def interpolate_nearest(spark, d):
    return _out(sp.interpolate_as(_spectrum(spark, d), _at(spark, 0.003, 0.05, 0.123, 0.377, 0.6), "magnitude", "nearest"), "value")


@query(
    f"with {_DFT}, g as (select ch, k, f_hz, sqrt(re * re + im * im) as m, re, im, lag(re) over w as r, lag(im) over w as i from s window w as (partition by ch order by k)), "
    "u as (select ch, k, f_hz, m, sum(case when r is null then atan2(im, re) else atan2(im * r - re * i, re * r + im * i) end) over (partition by ch order by k) as p from g), "
    f"o as (select a.ch, a.f_hz + 1 / 256.0 as f, (3 * a.m + b.m) / 4 as m, (3 * a.p + b.p) / 4 as p from u a join u b on b.ch = a.ch and b.k = a.k + 1 where a.k in (3, 10)) "
    f"select ch, cast(f as double) as f_hz, {_r('m * cos(p)', 4)} as re, {_r('m * sin(p)', 4)} as im from o"
)
def interpolate_magnitude_and_phase(spark, d):
    return _out(sp.interpolate_as(_spectrum(spark, d), _at(spark, 3 / 64 + 1 / 256, 10 / 64 + 1 / 256), "magnitude_phase"), "re", "im", digits=4)


@query(
    f"with {_DFT}, q as (select unnest(range(0, 13)) as j), o as (select ch, j / 24.0 as f, least(floor(j * 64 / 24.0), 31)::integer as k from (select distinct ch from s), q) "
    f"select o.ch, cast(f as double) as f_hz, {_r('a.re + (f * 64 - o.k) * (b.re - a.re)')} as re, {_r('a.im + (f * 64 - o.k) * (b.im - a.im)')} as im {_BOTH}"
)
def resample_spectrum(spark, d):
    return _out(sp.resampled(_spectrum(spark, d), 24, 1), "re", "im")


def _normalise_sql(have: str) -> str:
    return f"with {_DFT}, h as (select ch, {have} as h from s group by ch) select s.ch, k, f_hz, {_r('re * ' + repr(10 ** (-6 / 20)) + ' / h')} as re, {_r('im * ' + repr(10 ** (-6 / 20)) + ' / h')} as im from s join h on s.ch = h.ch"


@query(_normalise_sql("max(sqrt(re * re + im * im))"))
def normalise_spectrum_peak(spark, d):
    return _out(sp.normalised(_spectrum(spark, d), "peak", -6.0), "re", "im")


@query(_normalise_sql("sqrt(avg(re * re + im * im))"))
def normalise_spectrum_rms(spark, d):
    return _out(sp.normalised(_spectrum(spark, d), "rms", -6.0), "re", "im")


@query(_normalise_sql("avg(sqrt(re * re + im * im)) filter (where f_hz between 0.1 and 0.3)"))
def normalise_spectrum_range(spark, d):
    return _out(sp.normalised(_spectrum(spark, d), "range", -6.0, (0.1, 0.3)), "re", "im")


_BENT = "(2 * pi() * {k} / 64.0 + 2 * atan2(0.3 * sin(2 * pi() * {k} / 64.0), 1 - 0.3 * cos(2 * pi() * {k} / 64.0))) / (2 * pi())"


@query(
    f"with {_DFT}, z as (select ch, k, {_BENT.format(k='k')} as f, re, im from s), i as (select a.ch, a.f as f0, b.f as f1, a.re as r0, a.im as i0, b.re as r1, b.im as i1, a.k as k from z a join z b on a.ch = b.ch and b.k = a.k + 1), "
    "o as (select ch, k, f_hz from s) "
    f"select o.ch, f_hz, {_r('r0 + (f_hz - f0) / (f1 - f0) * (r1 - r0)', 4)} as re, {_r('i0 + (f_hz - f0) / (f1 - f0) * (i1 - i0)', 4)} as im from o join i on i.ch = o.ch and f_hz > f0 + 1e-12 and f_hz <= f1 + 1e-12 where o.k between 1 and 31"
)
def warp_spectrum(spark, d):
    out = sp.warp(_spectrum(spark, d), 0.3, 1).where("f_hz > 0 and f_hz < 0.5")
    return _out(out, "re", "im", digits=4)


_OCTAVE = "l as (select *, cast(round(log2(f_hz) * 1e6) as bigint) as l, sqrt(re * re + im * im) as m from s where k > 0)"
_AROUND = "over (partition by ch order by l range between 166667 preceding and 166667 following)"


@query(f"with {_DFT}, {_OCTAVE} select ch, k, {_r('avg(re) ' + _AROUND)} as re, {_r('avg(im) ' + _AROUND)} as im from l")
def smooth_complex(spark, d):
    return _out(sp.smooth_complex(_spectrum(spark, d), 3.0), "re", "im")


@query(f"with {_DFT}, {_OCTAVE} select ch, k, {_r('sqrt(avg(m * m) ' + _AROUND + ') * re / m')} as re, {_r('sqrt(avg(m * m) ' + _AROUND + ') * im / m')} as im from l")
def smooth_complex_power(spark, d):
    return _out(sp.smooth_complex(_spectrum(spark, d), 3.0, "power"), "re", "im")


@query(
    f"with {_DFT}, {_OCTAVE}, g as (select ch, k, avg(re) {_AROUND} as a, avg(im) {_AROUND} as b, sqrt(avg(m * m) {_AROUND}) as p from l) "
    f"select ch, k, {_r('p * a / sqrt(a * a + b * b)')} as re, {_r('p * b / sqrt(a * a + b * b)')} as im from g"
)
def smooth_complex_equivalent(spark, d):
    return _out(sp.smooth_complex(_spectrum(spark, d), 3.0, "equivalent"), "re", "im")


@query(f"with {_DFT} select a.ch, a.k, {_r('10 * log10((a.re * a.re + a.im * a.im) / (b.re * b.re + b.im * b.im))', 4)} as level_db from s a join s b on a.k = b.k and b.ch = 0 where a.ch <> 0")
def spectral_difference(spark, d):
    s = _spectrum(spark, d)
    others = s.where("ch <> 0")
    one = others.select("ch").distinct().join(s.where("ch = 0").drop("ch"), F.lit(True))
    return _out(sp.difference(others, one), "level_db", digits=4)


@query(f"with {_DFT}, c as (select max(ch) + 1 as c from s) select ch, k, f_hz, {_r('re')} as re, {_r('im')} as im from s union all select ch + c, k, f_hz, {_r('2 * re')}, {_r('2 * im')} from s, c")
def append_spectra(spark, d):
    s = _spectrum(spark, d)
    double = s.withColumns({"re": F.col("re") * 2, "im": F.col("im") * 2})
    return _out(sp.append(s, double), "re", "im")


@query(f"select i, {_r('20 * pow(2, i / 6.0)')} as f_hz from range(0, 60) t(i) where 20 * pow(2, i / 6.0) <= 20000")
def log_frequency_vector(spark, d):
    return _out(sp.log_frequencies(spark, 20.0, 20000.0, 6), "f_hz")


@query(
    f"with {_DFT}, l as (select ch, k, log2(f_hz) as l, sqrt(re * re + im * im) as v from s where k > 0), w as (select ch, v, (coalesce(lead(l) over o, l) - coalesce(lag(l) over o, l)) / 2 as w from l window o as (partition by ch order by k)) "
    f"select ch, {_r('sum(w * v) / sum(w)')} as value from w group by ch"
)
def log_mean(spark, d):
    return _out(sp.log_mean(_spectrum(spark, d).withColumn("value", fn.magnitude())), "value")


_RISE = "(0.5 - 0.5 * cos(pi() * least(1, greatest(0, ln(greatest(a.f_hz, 1e-300) / 0.1) / ln(2)))))"


@query(
    f"with {_DFT} select a.ch // 2 as pair, a.k, a.f_hz, {_r('a.re * (1 - ' + _RISE + ') + b.re * ' + _RISE)} as re, {_r('a.im * (1 - ' + _RISE + ') + b.im * ' + _RISE)} as im "
    "from s a join s b on a.ch % 2 = 0 and b.ch = a.ch + 1 and a.k = b.k"
)
def frequency_crossover(spark, d):
    s = ed.in_pairs(_spectrum(spark, d))
    return _out(sp.merged(s.where("ch = 0"), s.where("ch = 1"), 0.1, 0.2, ("pair",)), "re", "im")


@query(f"with {_DFT}, l as (select ch, f_hz, 10 * log10(re * re + im * im) as l from s), t as (select *, max(l) over (partition by ch) - 6 as t from l) select ch, min(f_hz) as low_hz, max(f_hz) as high_hz from t where l >= t group by ch")
def frequencies_above_threshold(spark, d):
    return sp.above_threshold(_spectrum(spark, d), -6.0)


@query(f"with {_DFT} select ch, k, f_hz, {_r('re', 4)} as re, {_r('im', 4)} as im from s where f_hz between 0.1 and 0.3")
def trim_spectrum(spark, d):
    return _out(sp.trim(_spectrum(spark, d), 0.1, 0.3), "re", "im", digits=4)


_PARABOLA = (
    "y as (select ch, n, abs(re) as y, coalesce(lag(abs(re)) over w, 0) as l, coalesce(lead(abs(re)) over w, 0) as r from v window w as (partition by ch order by n)), "
    "top as (select *, row_number() over (partition by ch order by y desc, n) as i from y), f as (select ch, n + case when l - 2 * y + r <> 0 then 0.5 * (l - r) / (l - 2 * y + r) else 0 end as t from top where i = 1)"
)


@query(f"with {V}, {_PARABOLA} select ch, {_r('t / 48000.0 * 1000')} as delay_ms from f")
def fractional_latency(spark, d):
    out = si.fractional_peak(tb.vectors(spark, d), 48000)
    return out.select("ch", stable(F.col("delay_s") * 1000).alias("delay_ms"))


@query(
    f"with {_DFT}, {_PARABOLA} select s.ch, k, f_hz, {_r('re * cos(2 * pi() * f_hz * t) - im * sin(2 * pi() * f_hz * t)', 4)} as re, {_r('im * cos(2 * pi() * f_hz * t) + re * sin(2 * pi() * f_hz * t)', 4)} as im from s join f on f.ch = s.ch"
)
def spectrum_without_latency(spark, d):
    return _out(sp.without_delay(_spectrum(spark, d), si.fractional_peak(tb.vectors(spark, d))), "re", "im", digits=4)


@query(f"with {V} select ch, n, {_r('re * 4 - 2 * pi() * ceil((re * 4 - pi()) / (2 * pi()))')} as re from v")
def wrap_phase(spark, d):
    return _out(tb.vectors(spark, d).withColumn("re", fn.wrap_phase(F.col("re") * 4)), "re")


# --- effects, bands and editing ------------------------------------------------------


def _subtraction_sql(silent: str, noise: str) -> str:
    return (
        f"with {_FRAMES_}, w as (select ch, frame, m, x * {_HANN} as x from f), s as materialized (select ch, frame, k, sum(x * cos(-2 * pi() * ((m * k) % 16) / 16)) as re, sum(x * sin(-2 * pi() * ((m * k) % 16) / 16)) as im "
        "from w, (select unnest(range(0, 9)) as k) b group by ch, frame, k), e as (select ch, frame, sum(re * re + im * im) as e from s group by ch, frame), "
        f"q as (select ch, frame, {silent} as silent from e), z as materialized (select s.ch, s.frame, s.k, re, im, re * re + im * im as p, silent from s join q on q.ch = s.ch and q.frame = s.frame), {noise}, "
        "c as (select ch, frame, k, case when p > 0 then sqrt(greatest(p - 1.5 * coalesce(noise, 0), 1e-6 * p) / p) else 0 end as g, re, im from y), "
        "i as (select ch, frame, m, sum((case when k in (0, 8) then 1 else 2 end) / 16.0 * g * (re * cos(2 * pi() * ((k * m) % 16) / 16) - im * sin(2 * pi() * ((k * m) % 16) / 16))) as x from c, (select unnest(range(0, 16)) as m) q group by ch, frame, m) "
        f"select ch, frame * 8 + m as n, {_r('sum(x * ' + _HANN + ') / greatest(sum(' + _HANN + ' * ' + _HANN + '), 1e-4)', 4)} as re from i group by ch, frame * 8 + m"
    )


_FRAMES_ = (
    f"{E.replace('e as', 'ee as', 1)}, kk as (select ch, greatest(0, ceil((max(n) + 1 - 16) / 8.0)) as c from ee group by ch), "
    "f as (select ee.ch, cast(g.frame as bigint) as frame, ee.n - g.frame * 8 as m, ee.re as x from ee join kk on ee.ch = kk.ch, (select unnest(range(0, 200)) as frame) g "
    "where ee.n >= g.frame * 8 and ee.n < g.frame * 8 + 16 and g.frame < kk.c)"
)


@query(_subtraction_sql("e < max(e) over (partition by ch) * 0.5", "n as (select ch, k, avg(p) as noise from z where silent group by ch, k), y as (select z.*, n.noise from z left join n on n.ch = z.ch and n.k = z.k)"))
def spectral_subtraction_by_activity(spark, d):
    return _out(fx.spectral_subtraction(tb.events(spark, d), 16, 10 * log10(0.5), factor=1.5), "re", digits=4)


@query(
    _subtraction_sql(
        "e < max(e) over (partition by ch) * 0.5",
        "n as (select a.ch, a.frame, a.k, sum(pow(0.5, a.frame - b.frame) * b.p) / sum(pow(0.5, a.frame - b.frame)) as noise from z a join z b on a.ch = b.ch and a.k = b.k and b.frame <= a.frame and b.silent group by a.ch, a.frame, a.k), "
        "y as (select z.*, coalesce(n.noise, o.p) as noise from z left join n on n.ch = z.ch and n.k = z.k and n.frame = z.frame join z o on o.ch = z.ch and o.k = z.k and o.frame = 0)",
    )
)
def spectral_subtraction_adaptive(spark, d):
    return _out(fx.spectral_subtraction(tb.events(spark, d), 16, 10 * log10(0.5), factor=1.5, forgetting=0.5), "re", digits=4)


@query(
    f"with {V}, x as (select ch, list(re order by n) as x from v group by ch), a as (select ch, x, n, unnest([n - 3 - 2 * sin(n * 2 * pi() * 3 / 64), n - 5 - 1.5 * sin(n * 2 * pi() * 2 / 64)]) as p from x, (select unnest(range(0, 64)) as n) q), "
    "b as (select ch, n, case when p >= 0 then (1 - (p - floor(p))) * x[floor(p)::bigint + 1] + (p - floor(p)) * coalesce(x[floor(p)::bigint + 2], 0) else 0 end as w, x[n + 1] as d from a) "
    f"select ch, n, {_r('(max(d) + sum(w)) / 3')} as re from b group by ch, n"
)
def chorus(spark, d):
    return _out(fx.chorus(tb.vectors(spark, d), 64, [(3.0, 2.0, 3.0), (5.0, 1.5, 2.0)]), "re")


def _bands(spark, d):
    v = tb.vectors(spark, d)
    parts = [v.select(F.lit(b).alias("band"), "ch", "n", (F.col("re") * (b + 1)).alias("re")) for b in (0, 1, 2)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"with {V} select b::integer as band, ch, n, re * f as re from v, (values (0, 1), (1, 9), (2, 2), (3, 3)) g(b, f)")
def add_band(spark, d):
    new = tb.vectors(spark, d).withColumn("re", F.col("re") * 9)
    return ed.add_band(_bands(spark, d), new, 1).select(F.col("band").cast("int").alias("band"), "ch", "n", "re")


@query(f"with {V} select b::integer as band, ch, n, re * f as re from v, (values (0, 1), (1, 3)) g(b, f)")
def remove_band(spark, d):
    return ed.remove_band(_bands(spark, d), 1)


@query(f"with {V} select b::integer as band, ch, n, re * f as re from v, (values (0, 3), (1, 1), (2, 2)) g(b, f)")
def swap_bands(spark, d):
    return ed.swap_bands(_bands(spark, d), [2, 0, 1])


@query(f"with {V} select ch, n, {_r('re * 6')} as re from v")
def collapse_bands(spark, d):
    return _out(ed.collapse(_bands(spark, d)), "re")


@query(f"with {V} select ch, n, {_r('re * 5 / greatest(1, max(abs(re * 5)) over (partition by ch))')} as re, {_r('greatest(1, max(abs(re * 5)) over (partition by ch))')} as scale from v")
def constrain_amplitude(spark, d):
    v = tb.vectors(spark, d).withColumn("re", F.col("re") * 5)
    return _out(ed.constrain_amplitude(v, ("ch",)), "re", "scale")


@query(f"with {V} select ch, n, re from v where ch <> 3")
def remove_channel(spark, d):
    return tb.vectors(spark, d).where("ch <> 3")


@query(f"select b::integer as beats, {_r('240.0 / b * 0.25 * 1.5')} as dotted_s, {_r('240.0 / b * 0.125 * 2 / 3')} as triplet_s from (select unnest([60, 97, 120, 174]) as b)")
def rhythm_lengths(spark, d):
    rows = [(b, fx.rhythm_seconds(b, 0.25, dotted=True), fx.rhythm_seconds(b, 0.125, triplet=True)) for b in (60, 97, 120, 174)]
    return _out(spark.createDataFrame(rows, "beats int, dotted_s double, triplet_s double"), "dotted_s", "triplet_s")


# --- filters and banks ---------------------------------------------------------------

_MIRROR = fi.windowed_sinc(14, 0.5)


@query(
    f"with {V}, {_taps_sql(_MIRROR)}, c as (select ch, n + m as n, sum(re * b) as lo, sum(re * b * (case when m % 2 = 0 then 1 else -1 end)) as hi from v, t group by ch, n + m) "
    f"select 0 as band, ch, n // 2 as n, {_r('lo')} as re from c where n % 2 = 0 union all select 1, ch, n // 2, {_r('hi')} from c where n % 2 = 0"
)
def mirror_split(spark, d):
    return _out(fi.mirror_split(tb.vectors(spark, d), _MIRROR), "re")


@query(
    f"with {V}, {_taps_sql(_MIRROR)}, c as (select ch, n + m as n, sum(re * b) as lo, sum(re * b * (case when m % 2 = 0 then 1 else -1 end)) as hi from v, t group by ch, n + m), "
    f"e as (select * from c where n % 2 = 0) select ch, n + m as n, {_r('sum(2 * b * lo - 2 * b * (case when m % 2 = 0 then 1 else -1 end) * hi)')} as re from e, t group by ch, n + m"
)
def mirror_round_trip(spark, d):
    return _out(fi.mirror_join(fi.mirror_split(tb.vectors(spark, d), _MIRROR), _MIRROR), "re")


def _three_way() -> dict:
    """Linkwitz-Riley bands at 300 and 900 Hz; the lowest goes through the allpass of the upper crossover."""
    return ke.linkwitz_riley_bank([300.0, 900.0], 4800)


@query(_bank_sql(_three_way()))
def crossover_three_way(spark, d):
    return _out(ke.filter_bank(tb.events(spark, d), _three_way()), "re")


@query(
    f"with {E}, {_taps_sql(_impulse(np.vstack([ke.allpass_of_crossover(300.0, 4800), ke.allpass_of_crossover(900.0, 4800)])))}, x as (select *, max(n) over (partition by ch) as k from e) "
    f"select ch, n + m as n, {_r('sum(re * b)')} as re from x, t where n + m <= k group by ch, n + m"
)
def crossover_sum_is_allpass(spark, d):
    """The sum of the three bands, against the SQL of the two allpasses alone."""
    return _out(ke.filter_bank(tb.events(spark, d), _three_way(), "summed"), "re")


_KINDS = ("lowpass", "highpass", "bandpass", "bandpass_skirt", "notch", "allpass", "peaking", "lowshelf", "highshelf", "lowpass1", "highpass1", "allpass1")


def _kind_bank() -> dict:
    return {k: ke.biquad(k, 500.0, 4800, 0.9, 3.0) for k in _KINDS}


@query(_bank_sql(_kind_bank()))
def biquad_kinds(spark, d):
    return _out(ke.filter_bank(tb.events(spark, d), _kind_bank()), "re")


def _gammatone_taps(f_hz: float, rate_hz: int, length: int = 64) -> list[float]:
    """n**3-weighted decays: the closed form of four equal complex poles."""
    p = de.gammatone_sections(f_hz, rate_hz)[0]
    return [float((2 * (1 - abs(p)) ** 4 * (n + 1) * (n + 2) * (n + 3) / 6 * p**n).real) for n in range(length)]


@query(f"with {V}, {_taps_sql(_gammatone_taps(1000.0, 8000))} select ch, n + m as n, {_r('sum(re * b)')} as re from v, t where n + m < 64 group by ch, n + m")
def gammatone_band(spark, d):
    return _out(ke.gammatone(tb.vectors(spark, d), 1000.0, 8000), "re")


@query(f"with {V}, {_taps_sql((np.eye(1, 15, 7)[0] - np.array(fi.windowed_sinc(14, 0.25))).tolist())} select ch, n + m as n, {_r('sum(re * b)')} as re from v, t group by ch, n + m")
def complementary_filter(spark, d):
    return _out(fi.convolve(tb.vectors(spark, d), de.complementary(fi.windowed_sinc(14, 0.25)).tolist()), "re")


@query(
    f"with w as (select n, n - 15.5 as c from range(0, 32) t(n)) select n, {_r('exp(-0.5 * pow(c / 4, 2))')} as gaussian, {_r('0.5 - 0.5 * cos(2 * pi() * n / 31)')} as hann, {_r('sin(pi() * (n + 0.5) / 32)')} as cosine, "
    f"{_r('0.35875 - 0.48829 * cos(2 * pi() * n / 31) + 0.14128 * cos(4 * pi() * n / 31) - 0.01168 * cos(6 * pi() * n / 31)')} as blackmanharris from w"
)
def window_shapes(spark, d):
    kinds = ("gaussian", "hann", "cosine", "blackmanharris")
    rows = [(n, *map(float, v)) for n, v in enumerate(zip(*(de.window(k, 32, 4.0) for k in kinds)))]
    return _out(spark.createDataFrame(rows, "n long, gaussian double, hann double, cosine double, blackmanharris double"), *kinds)


@query(f"select s as suppression_db, {_r('case when s > 50 then 0.1102 * (s - 8.7) when s > 21 then 0.5842 * pow(s - 21, 0.4) + 0.07886 * (s - 21) else 0 end')} as beta from (select cast(unnest([10, 21, 30, 50, 60, 96]) as double) as s)")
def kaiser_beta(spark, d):
    return _out(spark.createDataFrame([(float(s), de.kaiser_beta(s)) for s in (10, 21, 30, 50, 60, 96)], "suppression_db double, beta double"), "beta")


def _curve_sql() -> str:
    r = "12194.217 ** 2 * f ** 4 / ((f ** 2 + 20.598997 ** 2) * (f ** 2 + 12194.217 ** 2) * sqrt((f ** 2 + 107.65265 ** 2) * (f ** 2 + 737.86223 ** 2)))"
    return f"select f as f_hz, {_r('20 * log10(' + r + ') + 2.0')} as a_db from (select cast(unnest([31.5, 63, 125, 250, 500, 1000, 2000, 4000, 8000, 16000]) as double) as f)"


@query(_curve_sql())
def weighting_curve(spark, d):
    f = [31.5, 63.0, 125.0, 250.0, 500.0, 1000.0, 2000.0, 4000.0, 8000.0, 16000.0]
    return _out(spark.createDataFrame(list(zip(f, map(float, de.weighting_db(f, "A")))), "f_hz double, a_db double"), "a_db")


@query(f"select f as f_hz, {_r('f / sqrt(sqrt(2))')} as low_hz, {_r('f * sqrt(sqrt(2))')} as high_hz from (select cast(unnest([125, 250, 500]) as double) as f)")
def half_octave_edges(spark, d):
    f = [125.0, 250.0, 500.0]
    rows = [(c, a, b) for c, (a, b) in zip(f, de.fractional_octave_edges(f, 2))]
    return _out(spark.createDataFrame(rows, "f_hz double, low_hz double, high_hz double"), "low_hz", "high_hz")


def _response_sql() -> str:
    """|H| of a peaking section from its coefficients, in closed form."""
    b0, b1, b2, _, a1, a2 = ke.biquad("peaking", 500.0, 4800, 0.9, 3.0).tolist()
    part = lambda x, y, z: f"(pow({x!r} + {y!r} * cos(w) + {z!r} * cos(2 * w), 2) + pow({y!r} * sin(w) + {z!r} * sin(2 * w), 2))"
    return f"select f as f_hz, {_r(f'10 * log10({part(b0, b1, b2)} / {part(1.0, a1, a2)})')} as level_db from (select f, 2 * pi() * f / 4800 as w from (select cast(unnest(range(50, 2400, 50)) as double) as f))"


@query(_response_sql())
def filter_response(spark, d):
    f = np.arange(50.0, 2400.0, 50.0)
    h = ke.response(ke.biquad("peaking", 500.0, 4800, 0.9, 3.0), f, 4800)
    return _out(spark.createDataFrame([(float(a), float(20 * np.log10(abs(b)))) for a, b in zip(f, h)], "f_hz double, level_db double"), "level_db")


# --- transforms and features ----------------------------------------------------------


@query(
    f"with {_STFT}, {_weights_sql(ft.mel_weights(9, 8000, 4)).replace('w as', 'mel as', 1)}, z as (select ch, frame, band, sum((re * re + im * im) * w) as e from s join mel on s.k = mel.k group by ch, frame, band) "
    f"select ch, frame, cast(band as integer) as band, {_r('10 * log10(greatest(e, 1e-30))', 4)} as level_db from z"
)
def log_mel_spectrogram(spark, d):
    p = _stft(spark, d).select("ch", "frame", "k", F.expr("re * re + im * im").alias("power"))
    return _out(tf.log_mel(p, ft.mel_weights(9, 8000, 4)), "level_db", digits=4)


@query(
    f"with {V}, {_wavelet_sql()}, c as (select ch, f_hz, n + m as n, sum(re * a) as re, sum(re * b) as im from v, w where n + m between 0 and 63 group by ch, f_hz, n + m), "
    "i as (select ch, n, f_hz, re, im, lag(re) over o as r, lag(im) over o as j from c window o as (partition by ch, f_hz order by n)), "
    "s as (select ch, n, re * re + im * im as p, case when r is null then f_hz else atan2(im * r - re * j, re * r + im * j) * 8000 / (2 * pi()) end as inst from i) "
    f"select ch, n, case when abs(inst - 500) <= abs(inst - 1000) then 500.0::double else 1000.0::double end as f_hz, {_r('sum(p)')} as power from s group by ch, n, case when abs(inst - 500) <= abs(inst - 1000) then 500.0::double else 1000.0::double end"
)
def squeezed_scalogram(spark, d):
    return _out(tf.squeezed(tf.cwt(tb.vectors(spark, d), [500.0, 1000.0], 8000, 3.0), [500.0, 1000.0], 8000), "power")


def _variable_sql() -> str:
    rows = [(f, m, a, b) for f in (1000.0, 1000.0 * 2**0.5) for m, a, b in tf.morlet_taps(f, 8000, 4.0 / sqrt(2))]
    return "w as (select * from (values " + ", ".join(f"({f!r}::double, {m}, {a!r}::double, {b!r}::double)" for f, m, a, b in rows) + ") w(f_hz, m, a, b))"


@query(f"with {V}, {_variable_sql()} select ch, f_hz, n + m as n, {_r('sum(re * a)')} as re, {_r('sum(re * b)')} as im from v, w where n + m between 0 and 63 group by ch, f_hz, n + m")
def variable_q(spark, d):
    return _out(tf.variable_q(tb.vectors(spark, d), 1000.0, 1, 2, 8000, 4.0), "re", "im")


def _speech_sql() -> str:
    frames = (
        f"{E.replace('e as', 'ee as', 1)}, kk as (select ch, greatest(0, ceil((max(n) + 1 - 32) / 16.0)) as c from ee group by ch), f as (select ee.ch, cast(g.frame as bigint) as frame, ee.n - g.frame * 16 as m, "
        "ee.re * (0.54 - 0.46 * cos(2 * pi() * (ee.n - g.frame * 16) / 32)) as x from ee join kk on ee.ch = kk.ch, (select unnest(range(0, 100)) as frame) g where ee.n >= g.frame * 16 and ee.n < g.frame * 16 + 32 and g.frame < kk.c)"
    )
    return (
        f"with {frames}, s as (select ch, frame, k, sum(x * cos(2 * pi() * ((m * k) % 32) / 32)) as re, sum(x * sin(2 * pi() * ((m * k) % 32) / 32)) as im from f, (select unnest(range(0, 17)) as k) b group by ch, frame, k), "
        f"{_weights_sql(ft.mel_weights(17, 8000, 8))}, e as (select ch, frame, band, sum((re * re + im * im) * w) as e from s join w on s.k = w.k group by ch, frame, band) "
        f"select ch, frame, cast(c as integer) as c, {_r('abs(sum(10 * log10(greatest(e, 1e-30)) * 2 * cos(pi() * c * (2 * band + 1) / 16)))', 4)} as value from e, (select unnest(range(0, 6)) as c) g group by ch, frame, c"
    )


query(_speech_sql())(speech_features)


_WEIGHTED = ft.mel_weights(9, 8000, 4)


@query(
    f"with recursive {V}, o as (select ch, n, re from v union all select ch + 1000000, n, (select re from v r where r.ch = 0 and r.n = v.n) from v), "
    f"f as (select ch, g.frame, n - g.frame * 8 as m, re as x from o, (select unnest(range(0, 6)) as frame) g where n >= g.frame * 8 and n < g.frame * 8 + 16), "
    f"s as (select ch, frame, k, sum(x * {_HANN} * cos(2 * pi() * ((m * k) % 16) / 16)) as re, sum(x * {_HANN} * sin(2 * pi() * ((m * k) % 16) / 16)) as im from f, (select unnest(range(0, 9)) as k) b group by ch, frame, k), "
    f"{_weights_sql(_WEIGHTED)}, b as materialized (select ch, frame, band, sum(sqrt(re * re + im * im) * w) as e from s join w on s.k = w.k group by ch, frame, band), "
    "p as (select y.ch, y.frame, y.band, x.e as x, y.e as y from b y join b x on x.ch = y.ch + 1000000 and x.frame = y.frame and x.band = y.band where y.ch <> 0 and y.ch < 1000000), "
    "q as (select ch, frame, sum(pow(x, 0.2) * least(35, greatest(-10, 10 * log10(greatest(x * x, 1e-30) / greatest((x - y) * (x - y), 1e-30))))) / sum(pow(x, 0.2)) as v from p group by ch, frame) "
    f"select ch, {_r('avg(v)', 4)} as fw_snr_db from q group by ch"
)
def weighted_segmental_snr(spark, d):
    others, one = si.against(tb.vectors(spark, d), 0)
    return _out(si.weighted_segmental_snr(one, others, _WEIGHTED, 16), "fw_snr_db", digits=4)


# --- rooms and arrays -------------------------------------------------------------------


@query(
    f"with {V}, x as (select ch, n, re * exp(-0.08 * n) as re from v), t as (select *, first_value(n) over (partition by ch order by abs(re) desc, n) as p, max(abs(re)) over (partition by ch) as m from x), "
    "z as (select ch, coalesce(max(case when n < p and abs(re) < m * 0.1 then n end), -1) + 1 as start from t group by ch), i as (select x.ch, n - start as n, re from x join z on x.ch = z.ch where n >= start), "
    "c as (select ch, n, 10 * log10(greatest(sum(re * re) over (partition by ch order by n desc rows between unbounded preceding and current row) / sum(re * re) over (partition by ch), 1e-300)) as l from i), "
    "r as (select ch, -60 / regr_slope(l, n / 400.0) filter (where l between -10 - 1e-9 and 1e-9) as edt, -60 / regr_slope(l, n / 400.0) filter (where l between -25 and -5) as t20, -60 / regr_slope(l, n / 400.0) filter (where l between -35 and -5) as t30 from c group by ch), "
    "g as (select ch, sum(re * re) as e, sum(case when n < 20 then re * re else 0 end) as d, sum(case when n < 32 then re * re else 0 end) as c, sum(re * re * n) as t from i group by ch) "
    f"select g.ch, {_r('d / e', 4)} as definition, {_r('10 * log10(c / (e - c))', 4)} as clarity_db, {_r('t / e / 400', 4)} as centre_time_s, {_r('edt', 4)} as edt_s, {_r('t20', 4)} as t20_s, {_r('t30', 4)} as t30_s from g join r on r.ch = g.ch"
)
def room_report(spark, d):
    ir = tb.vectors(spark, d).withColumn("re", F.col("re") * F.exp(-0.08 * F.col("n")))
    return _out(plans.room_report(ir, 400), "definition", "clarity_db", "centre_time_s", "edt_s", "t20_s", "t30_s", digits=4)


def _octave_rt_sql() -> str:
    bank = {f"{f:g}": np.vstack([ke.butterworth(2, f / 2**0.5, 4000, True), ke.butterworth(2, f * 2**0.5, 4000)]) for f in (250.0, 500.0, 1000.0)}
    rows = " union all ".join(f"select '{b}' as band, * from ({_taps_sql(_impulse(s, 64))[6:-1]})" for b, s in bank.items())
    return (
        f"with {V}, t as ({rows}), y as (select ch, band, n + m as n, sum(re * exp(-0.05 * n) * b) as re from v, t where n + m < 64 group by ch, band, n + m), "
        "c as (select ch, band, n, 10 * log10(greatest(sum(re * re) over (partition by ch, band order by n desc rows between unbounded preceding and current row) / sum(re * re) over (partition by ch, band), 1e-300)) as l from y) "
        f"select ch, band, {_r('-60 / regr_slope(l, n / 4000.0)', 4)} as rt_s from c where l between -25 and -5 group by ch, band"
    )


query(_octave_rt_sql())(octave_reverberation)


@query(f"with {P} select pid, x, y, z, x between 0 and 0.1 and y between 0 and 0.2 and z between 0 and 0.3 as inside from p")
def points_inside(spark, d):
    return rm.inside(tb.points(spark, d), (0.1, 0.2, 0.3))


_WALLS = [(a, b, f, round(0.05 + 0.07 * a + 0.03 * b + f / 20000, 4)) for a in range(3) for b in range(2) for f in (500.0, 1000.0)]


@query(
    "with g as (select cast(a.i as integer) as i, cast(b.i as integer) as j, cast(c.i as integer) as k from range(-2, 3) a(i), range(-2, 3) b(i), range(-2, 3) c(i)), "
    "w as (select * from (values " + ", ".join(f"({a}, {b}, {f}::double, {s}::double)" for a, b, f, s in _WALLS) + ") w(axis, side, f, s)), "
    "q as (select *, sqrt(pow((case when i % 2 = 0 then i * 6.0 + 1.0 else (i + 1) * 6.0 - 1.0 end) - 4.0, 2) + pow((case when j % 2 = 0 then j * 4.0 + 2.0 else (j + 1) * 4.0 - 2.0 end) - 1.0, 2) "
    "+ pow((case when k % 2 = 0 then k * 3.0 + 1.5 else (k + 1) * 3.0 - 1.5 end) - 1.2, 2)) as d from g), "
    # bounces off the far side (1): the first of alternating ones for positive numbers, the second for negative
    "n as (select i, j, k, d, axis, side, f, s, (case when (case axis when 0 then i when 1 then j else k end) > 0 then (abs(case axis when 0 then i when 1 then j else k end) + side) // 2 "
    "else (abs(case axis when 0 then i when 1 then j else k end) + 1 - side) // 2 end) as bounces from q, w) "
    f"select i, j, k, f as f_hz, {_r('max(d)')} as distance_m, {_r('exp(sum(bounces * 0.5 * ln(1 - s))) / max(d)')} as gain from n group by i, j, k, f"
)
def image_sources_by_wall(spark, d):
    box, source, receiver = (6.0, 4.0, 3.0), (1.0, 2.0, 1.5), (4.0, 1.0, 1.2)
    walls = spark.createDataFrame(_WALLS, "axis int, side int, f_hz double, absorption double")
    images = rm.image_sources(spark, box, source, receiver, 2, 1.0, 48000).select("i", "j", "k")
    return _out(rm.image_sources_by_wall(images, walls, box, source, receiver), "distance_m", "gain")


@query(
    f"with {V}, c as (select ch, n, 10 * log10(greatest(sum(re * re) over (partition by ch order by n desc rows between unbounded preceding and current row) / sum(re * re) over (partition by ch), 1e-300)) as l from v), "
    "q as (select cast(unnest([-6.0, -9.0, -12.0]) as double) as low), m as (select ch, min(l) as least from c group by ch), "
    "r as (select c.ch, low, -60 / regr_slope(l, n / 400.0) as rt, regr_r2(l, n / 400.0) as r2 from c join m on m.ch = c.ch, q where l <= -1.0 and l >= low and least <= low group by c.ch, low having count(*) > 2), "
    "b as (select *, row_number() over (partition by ch order by round(r2, 9) desc, low) as i from r) "
    f"select ch, low as low_db, {_r('rt')} as rt_s, {_r('r2')} as r2 from b where i = 1"
)
def best_decay_range(spark, d):
    return _out(rm.best_decay_range(rm.energy_decay(tb.vectors(spark, d)), 400, -1.0, (-6.0, -9.0, -12.0)), "rt_s", "r2")


@query(f"with {_DFT} select f_hz, {_r('sum(re * re + im * im)', 3)} as indicator from s group by f_hz")
def complex_mode_indicator(spark, d):
    return _out(rm.complex_mode_indicator(_spectrum(spark, d)), "indicator", digits=3)


@query(
    f"with {_POWER}, t as (select f_hz, sum(power) as p from p where f_hz between 200 and 3800 group by f_hz), m as (select *, max(p) over (order by cast(round(f_hz * 1000) as bigint) range between 300000 preceding and 300000 following) as top from t) "
    f"select f_hz, {_r('p', 3)} as indicator from m where p = top"
)
def room_mode_peaks(spark, d):
    return _out(rm.find_modes(_power(spark, d), 200.0, 3800.0, 300.0), "indicator", digits=3)


@query(
    f"with {V}, r as (select ch, 0.5 + abs(re) as rt, case n % 4 when 0 then 125.0 when 1 then 250.0 when 2 then 500.0 else 1000.0 end as c from v where n < 4) "
    f"select ch, {_r('sum(case when c <= 250 then rt end) / sum(case when c > 250 then rt end)')} as bass_ratio from r group by ch"
)
def bass_ratio(spark, d):
    centre = F.element_at(F.array(*[F.lit(x) for x in (125.0, 250.0, 500.0, 1000.0)]), (F.col("n") + 1).cast("int"))
    rt = tb.vectors(spark, d).where("n < 4").select("ch", centre.alias("centre_hz"), (0.5 + F.abs("re")).alias("rt_s"))
    return _out(rm.bass_ratio(rt), "bass_ratio")


@query(f"with {V}, h as (select * from (values (0, 1.0::double), (3, 0.5::double), (7, -0.25::double)) h(m, b)) select ch, n + m as n, {_r('sum(re * b)')} as re from v, h group by ch, n + m")
def auralise(spark, d):
    h = spark.createDataFrame([(0, 1.0), (3, 0.5), (7, -0.25)], "n long, re double")
    return _out(rm.auralise(tb.vectors(spark, d), h), "re")


@query(f"with {_MICS}, q as (select sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) as d from m a join m b on a.pid < b.pid) select {_r('4 * 343.0 / max(d)')} as low_hz, {_r('343.0 / (2 * min(d))')} as high_hz from q")
def array_frequency_range(spark, d):
    return _out(bf.frequency_range(_mics(spark)), "low_hz", "high_hz")


@query(f"with {P} select pid, {_r('(abs(x) * 1000 + 1) * 0.8 / 343')} as he, {_r('(abs(y) + 1) * 343.0 / 0.8', 4)} as f_hz from p")
def helmholtz_numbers(spark, d):
    p = tb.points(spark, d)
    a = F.lit(0.8)
    return p.select("pid", stable(bf.hz_to_helmholtz(F.abs("x") * 1000 + 1, a)).alias("he"), stable(bf.helmholtz_to_hz(F.abs("y") + 1, a), 4).alias("f_hz"))


@query(f"with {P} select pid // 8 as row, {_r('sum(x)')} as total, count(*) as cells from p group by pid // 8")
def map_rows(spark, d):
    p = tb.points(spark, d).select("pid", F.col("x").alias("power"))
    rows = bf.as_map(p, 8)
    return rows.select("row", stable(F.aggregate("values", F.lit(0.0), lambda a, v: a + v)).alias("total"), F.size("values").cast("long").alias("cells"))


@query(f"select i as pid, {_r('i / 9.0')} as x, {_r('2 - i / 9.0 * 2')} as y, 0.5::double as z from range(0, 10) t(i)")
def line_grid(spark, d):
    return _out(bf.line_grid(spark, (0.0, 2.0, 0.5), (1.0, 0.0, 0.5), 10), "x", "y")


@query("select cast(c.i * 12 + b.i * 4 + a.i as bigint) as pid, a.i * 0.5::double as x, b.i * 0.25::double as y, c.i * 1.0::double as z from range(0, 4) a(i), range(0, 3) b(i), range(0, 2) c(i)")
def box_grid(spark, d):
    return bf.regular_box(spark, [0.5 * i for i in range(4)], [0.25 * i for i in range(3)], [0.0, 1.0])


# --- responses ------------------------------------------------------------------------------


@query(
    f"with {_DFT}, m as (select ch, k, sqrt(re * re + im * im) as m from s), t as (select ch, k, m * cos(-2 * pi() * ((k * 32) % 64) / 64) as re, m * sin(-2 * pi() * ((k * 32) % 64) / 64) as im from m) "
    f"select ch, n, {_r('sum((case when k in (0, 32) then 1 else 2 end) / 64.0 * (re * cos(2 * pi() * ((k * n) % 64) / 64) - im * sin(2 * pi() * ((k * n) % 64) / 64)))', 4)} as re from t, (select unnest(range(0, 64)) as n) g group by ch, n"
)
def linear_phase_response(spark, d):
    s = _spectrum(spark, d).withColumn("value", fn.magnitude())
    return _out(rs.linear_phase(s, 64), "re", digits=4)


def _with_impulse_sql() -> str:
    low, high = np.vstack([ke.butterworth(2, 600.0, 4800)] * 2), np.vstack([ke.butterworth(2, 600.0, 4800, True)] * 2)
    tables = f"{_taps_sql(_impulse(low, 64)).replace('t as', 'lo as', 1)}, {_taps_sql(_impulse(high, 64)).replace('t as', 'hi as', 1)}"
    return (
        f"with {V}, {_PEAK}, {tables}, a as (select ch, n + m as n, sum(re * b) as re from v, lo where n + m < 64 group by ch, n + m union all select ch, p + m, b from (select distinct ch, p from k), hi where p + m < 64) "
        f"select ch, n, {_r('sum(re)')} as re from (select * from a union all select distinct ch, g.n, 0.0::double from v, (select unnest(range(0, 64)) as n) g) group by ch, n"
    )


@query(_with_impulse_sql())
def response_with_impulse(spark, d):
    return _out(rs.with_impulse(tb.vectors(spark, d), 600.0, 4800), "re")


@query(
    f"with {V}, b as (select ch, n // 4 as block, 10 * log10(greatest(avg(re * re), 1e-30)) as l from v group by ch, n // 4), x as (select *, max(block) over (partition by ch) as last from b), "
    "f as (select ch, median(l) as f from x where block >= 0.9 * last group by ch), z as (select x.ch, coalesce(max(case when l > f + 1.0 then block end), max(block)) as z from x join f on f.ch = x.ch group by x.ch) "
    "select v.ch, n, re from v join z on z.ch = v.ch where n // 4 <= z"
)
def trim_to_noise_floor(spark, d):
    return rs.trim_to_noise_floor(tb.vectors(spark, d), 4, 1.0)


_BANDS = fi.band_weights([1000.0, 2000.0, 3000.0], 33, 8000)


@query(
    f"with {_DFT}, {_weights_sql(_BANDS)} select ch, cast(band as integer) as band, n, {_r('sum(w * (case when s.k in (0, 32) then 1 else 2 end) / 64.0 * (re * cos(2 * pi() * ((s.k * n) % 64) / 64) - im * sin(2 * pi() * ((s.k * n) % 64) / 64)))', 4)} as re "
    "from s join w on w.k = s.k, (select unnest(range(0, 64)) as n) g group by ch, band, n"
)
def reconstructing_bands(spark, d):
    return _out(fi.reconstructing_bands(tb.vectors(spark, d), [1000.0, 2000.0, 3000.0], 64, 8000), "re", digits=4)


@query(f"with {V} select ch, n, {_r('re', 4)} as re from v")
def reconstructing_bands_sum(spark, d):
    """All bands together, against the signal itself."""
    return _out(ed.collapse(fi.reconstructing_bands(tb.vectors(spark, d), [1000.0, 2000.0, 3000.0], 64, 8000)), "re", digits=4)


def _bank_levels_sql() -> str:
    parts = []
    for name, s in _three_way().items():
        level = []
        for b0, b1, b2, a0, a1, a2 in np.atleast_2d(s).tolist():
            square = lambda x, y, z: f"(pow({x!r} + {y!r} * cos(w) + {z!r} * cos(2 * w), 2) + pow({y!r} * sin(w) + {z!r} * sin(2 * w), 2))"
            level.append(f"10 * log10({square(b0, b1, b2)} / {square(a0, a1, a2)})")
        parts.append(f"select '{name}' as band, f as f_hz, {_r(' + '.join(level))} as level_db from g")
    return "with g as (select f, 2 * pi() * f / 4800 as w from (select cast(unnest(range(50, 2400, 50)) as double) as f)) " + " union all ".join(parts)


@query(_bank_levels_sql())
def bank_responses(spark, d):
    f = np.arange(50.0, 2400.0, 50.0)
    rows = [(name, float(a), float(20 * np.log10(abs(b)))) for name, s in _three_way().items() for a, b in zip(f, ke.response(s, f, 4800))]
    return _out(spark.createDataFrame(rows, "band string, f_hz double, level_db double"), "level_db")


@query(f"select 0::bigint as ch, n, {_r('sin(2 * pi() * 2 * (exp(n / 48000.0 * 20 / 2) - 1))')} as re from range(0, 24000) t(n)")
def synchronised_chirp(spark, d):
    return _out(ge.synchronised_chirp(spark, 20.0, 4000.0, 48000, 24000), "re")


@query(_basis_sql(tf.allpass_chain(0.2, 64, 64, sqrt(1 - 0.04) * 0.2 ** np.arange(64.0)).T))
def laguerre_coefficients(spark, d):
    return _out(tf.laguerre(tb.vectors(spark, d), 0.2), "re")


@query(
    f"with x as (select n, sin(2 * pi() * n * 997 / 8000) as re from range(0, 8000) t(n)), {_taps_sql(_impulse(ke.k_weighting(8000), 1000))}, y as materialized (select n + m as n, sum(re * b) as re from x, t where n + m < 8000 group by n + m), "
    "f as (select g.f, sum(re * re) / 3200 as p from y, (select unnest(range(0, 6)) as f) g where n >= g.f * 800 and n < g.f * 800 + 3200 group by g.f), b as (select p, -0.691 + 10 * log10(p) as l from f where -0.691 + 10 * log10(p) > -70) "
    f"select {_r('-0.691 + 10 * log10(avg(p))', 4)} as lufs from b where l > (select -0.691 + 10 * log10(avg(p)) - 10 from b)"
)
def loudness_of_a_tone(spark, d):
    return _out(ke.loudness(ge.sine(spark, 997.0, 8000, 8000), 8000), "lufs", digits=4)


_DRAW = "((('0x' || substr(md5('0:{}:' || ch || ':' || n), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)"


@query(f"with {V} select ch, n, greatest(-128.0, least(127.0, floor((re + ({_DRAW.format(1)} - {_DRAW.format(2)}) / 128) * 128 + 0.5))) / 128 as re from v")
def dither_8bit(spark, d):
    return lv.dither(tb.vectors(spark, d), 8)


def _turned(of: str, n: str, k: str) -> str:
    return f"{of}(2 * pi() * (({k} * {n}) % 64) / 64)"


@query(
    f"with {_DFT}, l as (select ch, k, ln(greatest(sqrt(re * re + im * im), 1e-12)) as l from s), n as (select unnest(range(0, 64)) as n), "
    f"c as (select ch, n, sum((case when k in (0, 32) then 1 else 2 end) / 64.0 * l * {_turned('cos', 'n', 'k')}) * (case when n in (0, 32) then 1 when n < 32 then 2 else 0 end) as c from l, n group by ch, n), "
    f"d as (select ch, q.k, sum(c * {_turned('cos', 'n', 'q.k')}) as a, -sum(c * {_turned('sin', 'n', 'q.k')}) as b from c, (select unnest(range(0, 33)) as k) q group by ch, q.k) "
    f"select ch, n, {_r('sum((case when k in (0, 32) then 1 else 2 end) / 64.0 * exp(a) * (cos(b) * ' + _turned('cos', 'n', 'k') + ' - sin(b) * ' + _turned('sin', 'n', 'k') + '))', 4)} as re from d, n group by ch, n"
)
def minimum_phase_from_magnitude(spark, d):
    m = _spectrum(spark, d).withColumn("value", fn.magnitude())
    return _out(rs.minimum_phase_from_magnitude(m, 64), "re", digits=4)


def _matched_bank() -> dict:
    return {k: de.matched(k, 900.0, 4800, 1.1, 6.0) for k in ("lowpass", "highpass", "bandpass", "peaking")}


@query(_bank_sql(_matched_bank()))
def matched_sections(spark, d):
    return _out(ke.filter_bank(tb.events(spark, d), _matched_bank()), "re")


@query(_basis_sql(tf.kautz_basis([0.3, -0.5, 0.6], 64).T))
def kautz_fit(spark, d):
    return _out(tf.kautz_weights(tb.vectors(spark, d), [0.3, -0.5, 0.6]), "re")


def _dual(poles: list[float]) -> np.ndarray:
    rows = np.array([p ** np.arange(64) for p in poles])
    return np.linalg.solve(rows @ rows.T, rows)


@query(_basis_sql(_dual([0.3, -0.5, 0.8]).T))
def parallel_fit(spark, d):
    return _out(tf.parallel_weights(tb.vectors(spark, d), [0.3, -0.5, 0.8]), "re")


@query(_basis_sql(tf.kautz_basis([0.3, -0.5, 0.6], 64).T @ tf.kautz_basis([0.3, -0.5, 0.6], 64)))
def kautz_response(spark, d):
    weights = tf.kautz_weights(tb.vectors(spark, d), [0.3, -0.5, 0.6])
    return _out(tf.from_weights(weights, tf.kautz_basis([0.3, -0.5, 0.6], 64)), "re")


def _spectrum_of_sections_sql() -> str:
    rows, re, im = np.vstack([ke.biquad("peaking", 500.0, 4800, 0.9, 3.0), ke.biquad("lowpass", 900.0, 4800)]), "1.0", "0.0"
    steps = ["g as (select f, -2 * pi() * f / 4800 as w, 1.0::double as re, 0.0::double as im from (select cast(unnest(range(0, 2401, 50)) as double) as f))"]
    last = "g"
    for j, (b0, b1, b2, a0, a1, a2) in enumerate(rows.tolist()):
        part = lambda x, y, z, f: f"({x!r} * {'1' if f == 'cos' else '0'} + {y!r} * {f}(w) + {z!r} * {f}(2 * w))"
        nr, ni, dr, di = part(b0, b1, b2, "cos"), part(b0, b1, b2, "sin"), part(a0, a1, a2, "cos"), part(a0, a1, a2, "sin")
        steps.append(f"h{j} as (select f, w, re, im, ({nr} * {dr} + {ni} * {di}) / ({dr} * {dr} + {di} * {di}) as x, ({ni} * {dr} - {nr} * {di}) / ({dr} * {dr} + {di} * {di}) as y from {last}), p{j} as (select f, w, re * x - im * y as re, re * y + im * x as im from h{j})")
        last = f"p{j}"
    return f"with {', '.join(steps)} select f as f_hz, {_r('re')} as re, {_r('im')} as im from {last}"


@query(_spectrum_of_sections_sql())
def spectrum_of_sections(spark, d):
    f = spark.range(0, 2401, 50).select(F.col("id").cast("double").alias("f_hz"))
    sections = np.vstack([ke.biquad("peaking", 500.0, 4800, 0.9, 3.0), ke.biquad("lowpass", 900.0, 4800)])
    return _out(fi.response(f, sections, 4800), "re", "im")


@query(f"select v.ch // 2 * 2 + o.ch as ch, v.n + o.m as n, {_r('sum(v.re * o.b)')} as re from ({f'with {V} select * from v'}) v join (values (0, 0, 0, 1.0::double), (0, 1, 2, 0.5::double), (1, 0, 1, -0.25::double), (1, 1, 0, 0.75::double)) o(source, ch, m, b) on v.ch % 2 = o.source group by v.ch // 2 * 2 + o.ch, v.n + o.m")
def multichannel_filter(spark, d):
    taps = spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 2, 0.5), (1, 0, 1, -0.25), (1, 1, 0, 0.75)], "source long, ch long, m long, b double")
    out = fi.convolve_matrix(ed.in_pairs(tb.vectors(spark, d)), taps, ("pair",))
    return _out(out.select((F.col("pair") * 2 + F.col("ch")).alias("ch"), "n", "re"), "re")


@query(f"select ch, band, {_r('avg(re * re)', 2)} as power from ({_bank_sql(_three_way())}) group by ch, band")
def spectrum_via_filter_bank(spark, d):
    return _out(fi.band_levels(ke.filter_bank(tb.events(spark, d), _three_way())), "power", digits=2)


@query(" union all ".join(f"select 0::bigint as ch, n, {_r('re')} as re, '{b}' as band from (select unnest(range(0, 150)) as n, unnest([{', '.join(repr(v) for v in _impulse(s, 150))}]::double[]) as re)" for b, s in _three_way().items()))
def bank_impulse_responses(spark, d):
    return _out(ke.filter_bank(ge.dirac(spark, 150), _three_way()), "re")


@query(f"with {V} select ch, n, {_r('re')} as b0, {_r('re * 2')} as b1, {_r('re * 3')} as b2 from v")
def bands_side_by_side(spark, d):
    return _out(ed.side_by_side(_bands(spark, d), 3), "b0", "b1", "b2")


# --- recursions by blocks ---------------------------------------------------------------------


@query(f"with {E} select a.ch, a.n, {_r('sum(0.4 * pow(0.6, a.n - b.n) * b.re)')} as re from e a join e b on a.ch = b.ch and b.n <= a.n group by a.ch, a.n")
def smoothed_by_blocks(spark, d):
    e = tb.events(spark, d).select("ch", "n", F.lit(0.6).alias("c"), (0.4 * F.col("re")).alias("d"))
    return _out(rc.affine(e), "re")


@query(f"with {E} select ch, n, {_r('sum(re) over (partition by ch order by n)')} as re from e")
def integrated_by_blocks(spark, d):
    return _out(rc.sections(tb.events(spark, d), np.array([[1.0, 0, 0, 1, -1, 0]])), "re")


def _structure(name: str, part, taps: list[float]) -> None:
    """A filter structure of sonagrid.streaming over whole channels, against its response in closed form."""

    def run(spark, d):
        return _out(rc.processed(tb.events(spark, d), part()), "re")

    run.__name__ = name
    sql = f"with {E}, {_taps_sql(taps)}, x as (select *, max(n) over (partition by ch) as k from e) select ch, n + m as n, {_r('sum(re * b)')} as re from x, t where n + m <= k group by ch, n + m"
    query(sql)(run)


def _plus(*parts: list[float]) -> list[float]:
    return [sum(v) for v in zip(*parts)]


def _scaled(taps: list[float], by: float) -> list[float]:
    return [by * t for t in taps]


def _allpass(c: float) -> list[float]:
    return [-c, 1.0, 0, 1, -c, 0]


def _step_up(reflection: list[float]) -> list[float]:
    """Taps of a finite lattice."""
    a = [1.0]
    for k in reflection:
        a = _plus([*a, 0.0], _scaled([0.0, *a[::-1]], k))
    return a


def _unwarped(c: list[float], warp: float) -> list[float]:
    """Second-order polynomial in first-order allpasses, times (1 - warp / z) squared."""
    top, bottom = np.array([-warp, 1.0]), np.array([1.0, -warp])
    return sum(v * np.convolve(*[top if i < k else bottom for i in (0, 1)]) for k, v in enumerate(c)).tolist()


_SECTION = ke.biquad("bandpass", 400.0, 4800, 1.2)
_B, _A = _SECTION[:3].tolist(), _SECTION[3:].tolist()
_NONE = [1.0, 0, 0, 1, 0, 0]

for _kind, _name in (("low", "lowpass"), ("band", None), ("high", "highpass")):
    _taps = _impulse(ke.biquad(_name, 400.0, 4800, 1.2)) if _name else _scaled(_impulse(ke.biquad("bandpass", 400.0, 4800, 1.2)), 1.2)
    _structure(f"state_variable_{_kind}", lambda kind=_kind: stream.state_variable(400.0, 1.2, 4800, kind), _taps)

_structure("lattice_fir", lambda: stream.lattice([0.5, -0.3, 0.2]), _step_up([0.5, -0.3, 0.2]))
_structure("lattice_ladder", lambda: stream.lattice_ladder(_B, _A), _impulse(_SECTION))
_structure("warped_fir", lambda: stream.warped_fir([0.5, 0.3, 0.2], 0.4), _plus(_scaled(_impulse(_NONE), 0.5), _scaled(_impulse(_allpass(0.4)), 0.3), _scaled(_impulse([_allpass(0.4)] * 2), 0.2)))
_structure("warped_iir", lambda: stream.warped_iir([0.2, 0.1, 0.05], [1.0, -0.4, 0.2], 0.3), _impulse(np.concatenate([np.array(_unwarped([0.2, 0.1, 0.05], 0.3)), np.array(_unwarped([1.0, -0.4, 0.2], 0.3))]) / _unwarped([1.0, -0.4, 0.2], 0.3)[0]))
_structure(
    "kautz_filter",
    lambda: stream.kautz([0.3, -0.5], [0.7, 0.4]),
    _plus(_scaled(_impulse([1.0, 0, 0, 1, -0.3, 0]), 0.7 * sqrt(1 - 0.09)), _scaled(_impulse([_allpass(0.3), [1.0, 0, 0, 1, 0.5, 0]]), 0.4 * sqrt(1 - 0.25))),
)
_structure("parallel_sections", lambda: stream.parallel(stream.sections(_SECTION), stream.sections(ke.biquad("lowpass", 200.0, 4800))), _plus(_impulse(_SECTION), _impulse(ke.biquad("lowpass", 200.0, 4800))))
_structure("sections_in_chain", lambda: stream.chain(stream.sections(_SECTION), stream.fir([0.5, 0.5])), _impulse([_SECTION, [0.5, 0.5, 0, 1, 0, 0]]))
_structure(
    "state_space_filter",
    lambda: stream.state_space([[-_A[1], -_A[2]], [1, 0]], [1, 0], [_B[1] - _A[1] * _B[0], _B[2] - _A[2] * _B[0]], _B[0]),
    _impulse(_SECTION),
)


@query(f"select n, {_r('exp(-0.5 * pow(n / 2.0, 2)) / (select sum(exp(-0.5 * pow(i / 2.0, 2))) from range(-6, 7) g(i))')} as w from range(-6, 7) t(n)")
def gaussian_taps(spark, d):
    return _out(spark.createDataFrame([(m, w) for m, w in fi.gaussian_taps(2.0, 6)], "n long, w double"), "w")


# --- searches and resynthesis -----------------------------------------------------

_ERB = [500.0, 620.0, 760.0, 920.0, 1100.0, 1310.0]


def _resynthesis_taps(frequencies: list[float], rate_hz: int, length: int) -> list[float]:
    """Responses of all bands, turned and delayed, added."""
    out = np.zeros(length)
    for f, (late, factor) in zip(frequencies, de.gammatone_synthesis(frequencies, rate_hz)):
        n, p = np.arange(length - late), de.gammatone_sections(f, rate_hz)[0]
        out[late:] += (factor * (n + 1) * (n + 2) * (n + 3) / 6 * p**n).real
    return out.tolist()


@query(f"with {V}, {_taps_sql(_resynthesis_taps(_ERB, 8000, 64))} select ch, n + m as n, {_r('sum(re * b)')} as re from v, t where n + m < 64 group by ch, n + m")
def gammatone_resynthesis(spark, d):
    return _out(ke.gammatone_resynthesis(tb.vectors(spark, d), _ERB, 8000), "re")


_TWO_POLES = "h as (select vec_id as ch, 0.5 + 0.2 * tanh(3 * cast(embedding[1] as double)) as p, -0.35 - 0.1 * tanh(3 * cast(embedding[2] as double)) as q from embeddings)"


@query(
    f"with {_TWO_POLES}, r as (select ch, unnest([p, q]) as re from h) select ch, cast(row_number() over (partition by ch order by abs(re) desc) - 1 as integer) as i, {_r('re', 4)} as re, {_r('0.0', 4)} as im from r"
)
def kautz_poles(spark, d):
    """Responses p**n + q**n / 2 of poles that each vector's components give; the search finds the poles again."""
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    two = v.select(F.col("vec_id").alias("ch"), (0.5 + 0.2 * F.tanh(3 * e(0))).alias("p"), (-0.35 - 0.1 * F.tanh(3 * e(1))).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(63)).cast("array<long>")).alias("n"))
    return _out(ps.poles(two.select("ch", "n", (F.pow("p", F.col("n")) + 0.5 * F.pow("q", F.col("n"))).alias("re")), 2, 4), "re", "im", digits=4).drop("error")


# --- phase design -----------------------------------------------------------------

_END = lambda d, e: f"case when sign((3 * {d} - {e}) / 2) <> sign({d}) then 0 when sign({d}) <> sign({e}) and abs((3 * {d} - {e}) / 2) > 3 * abs({d}) then 3 * {d} else (3 * {d} - {e}) / 2 end"

_DELAYS = (
    f"{_DFT}, q as (select *, lag(re) over o as r0, lag(im) over o as i0 from s window o as (partition by ch order by k)), "
    "a as (select ch, k, case when k > 0 then atan2(r0 * im - i0 * re, r0 * re + i0 * im) end as d from q), "
    "g as (select ch, k, -case when k = 0 then lead(d) over o when k = 32 then d else (d + lead(d) over o) / 2 end as g from a window o as (partition by ch order by k))"
)

#: From y (ch, k, y), a delay in radians a bin at bins 0 to 32, to the taps r (ch, n, re).
_DESIGN = (
    "z as (select ch, c.late, case when c.late * 10 > 64 then c.late * 10 + 1 + (c.late * 10 + 1) % 2 else 64 end as size from "
    "(select ch, cast(trunc(max(y) * 64 / (2 * pi()) + 1) as bigint) as late from y group by ch) c), "
    "d as (select ch, k, y, y - lag(y) over o as d0, lead(y) over o - y as d1, lead(y, 2) over o - lead(y) over o as d2, lag(y) over o - lag(y, 2) over o as dm from y window o as (partition by ch order by k)), "
    f"m as (select ch, k, y, case when k = 0 then {_END('d1', 'd2')} when k = 32 then {_END('d0', 'dm')} when d0 * d1 > 0 then 2 * d0 * d1 / (d0 + d1) else 0 end as m from d), "
    "c as (select ch, k, y as y0, m as m0, lead(y) over o as y1, lead(m) over o as m1 from m window o as (partition by ch order by k)), "
    "j as (select ch, size, late, unnest(range(0, size // 2 + 1)) as j from z), "
    "u as (select *, least(j * 64 // size, 31) as k, j * 64.0::double / size - least(j * 64 // size, 31) as u from j), "
    "vv as (select u.ch, u.size, u.late, u.j, 64.0::double / u.size * (y0 * (1 + 2 * u) * (1 - u) * (1 - u) + m0 * u * (1 - u) * (1 - u) + y1 * u * u * (3 - 2 * u) - m1 * u * u * (1 - u)) as v "
    "from u join c on c.ch = u.ch and c.k = u.k), "
    "w as (select *, -(sum(v) over (partition by ch order by j) - (v + first_value(v) over (partition by ch order by j)) / 2) as phase from vv), "
    "r as (select ch, n, sum(case when j = 0 or 2 * j = size then cos(phase) * cos(pi() * 2 * j / size * n) else 2 * cos(phase + 2 * pi() * ((j * n) % size) / size) end) / any_value(size) as re "
    "from (select *, unnest(range(0, late + 1)) as n from w) t group by ch, n)"
)


@query(f"with {_DELAYS} select ch, k, {_r('g')} as delay from g")
def delay_of_phase(spark, d):
    return _out(pe.delay_of_phase(_spectrum(spark, d)), "delay")


@query(f"with {_DELAYS}, y as (select ch, k, 2 * max(g) over (partition by ch) - g as y from g), {_DESIGN} select ch, n, {_r('re')} as re from r")
def phase_linearizer(spark, d):
    """Responses that make the phase of each vector's spectrum linear."""
    return _out(pe.linearized(_spectrum(spark, d), 64, 1), "re")


@query(f"with {V}, y as (select ch, n as k, (2 + tanh(re)) * 2 * pi() / 64 as y from v where n <= 32), {_DESIGN} select ch, n, {_r('re')} as re from r")
def group_delay_design(spark, d):
    """Responses whose delays, between 1 and 3 samples, follow each vector's components."""
    delays = tb.vectors(spark, d).select("ch", F.col("n").alias("k"), (2 + F.tanh("re")).alias("delay_s"))
    return _out(pe.designed(delays, 64, 1), "re")


# --- streams in event time ----------------------------------------------------------


@query(
    f"with {E}, c as (select ch, count(*) as size from e group by ch), f as (select ch, unnest(range(0, (size - 32) // 12 + 1)) as frame from c where size >= 32) "
    f"select f.ch, frame, n - frame * 12 as m, {_r('re')} as x from f join e on e.ch = f.ch and e.n between frame * 12 and frame * 12 + 31"
)
def frames_of_a_stream(spark, d):
    """Sliding frames of each user's events, of which a stream has blocks of 20 in any order."""
    out = od.replayed(od.blocks_of(tb.events(spark, d), 20), lambda s: od.frames(s, 32, 12, 20))
    return _out(out.select("ch", "frame", F.posexplode("samples").alias("m", "x")).withColumn("m", F.col("m").cast("long")), "x")


_MATRIX = np.array([[[0.5, 0.3, -0.2, 0.1, 0.05], [1.0, 0.0, 0.4, 0.0, 0.0]], [[0.0, 0.25, 0.25, 0.25, 0.25], [-0.5, 0.5, 0.0, 0.0, 0.1]]])
_MATRIX_ROWS = ", ".join(f"({o}, {i}, {m}, {float(_MATRIX[o, i, m])!r}::double)" for o in range(2) for i in range(2) for m in range(5))


@query(
    f"with {V}, t(output, input, m, b) as (values {_MATRIX_ROWS}), a as (select ch // 2 as ch, ch % 2 as input, n, re from v), "
    f"y as (select ch, output, n + m as n, sum(re * b) as re from a join t using (input) where n + m < 64 group by ch, output, n + m) select ch, output, n, {_r('re')} as re from y"
)
def matrix_of_responses_stream(spark, d):
    """Two inputs, vectors 2 i and 2 i + 1, through a matrix of responses as a stream of blocks in any order."""
    x = tb.vectors(spark, d).select(F.floor(F.col("ch") / 2).alias("pair"), (F.col("ch") % 2).alias("input"), "n", "re")
    out = od.replayed(od.blocks_of(x, 16, "pair", "input"), lambda s: od.convolved(s, _MATRIX, 16))
    rows = out.select("ch", "output", "block", F.posexplode("samples").alias("i", "re"))
    return _out(rows.select("ch", "output", (F.col("block") * 16 + F.col("i")).alias("n"), "re"), "re")


@query(
    f"with {V}, i as (select ch, ch // 64 as file, dense_rank() over (partition by ch // 64 order by ch) - 1 as c from (select distinct ch from v)) "
    "select file, c as ch, n, greatest(-8388608, least(8388607, round_even(re * 8388608, 0))) / 8388608 as re from v join i using (ch)"
)
def wav_in_ranges(spark, d):
    """Vectors as channels of 24-bit files, 64 in each, written and read back in ranges of 4 kB."""
    folder = f"{shared(spark)}/wav-{uuid.uuid4().hex}"
    x = tb.vectors(spark, d).select(F.floor(F.col("ch") / 64).alias("file"), "ch", "n", "re")
    wav.write(x, folder, 8000, "file", 24)
    back = wav.samples(wav.read_ranges(spark, folder, 16, 4096))
    return back.select(F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("file"), "ch", "n", "re")
