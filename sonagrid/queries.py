"""Registered signal queries and the DuckDB SQL that gives the same rows.

Signals: E (events by user), V (embeddings by vector), H (events by hour and
type), L (prices by supplier); see sonagrid.sources.tables. Results are rounded
in the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log10, pi, sqrt

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonagrid import functions as fn
from sonagrid import plans
from sonagrid.functions import stable
from sonagrid.operators import beamforming as bf
from sonagrid.operators import editing as ed
from sonagrid.operators import effects as fx
from sonagrid.operators import features as ft
from sonagrid.operators import filters as fi
from sonagrid.operators import frames as fr
from sonagrid.operators import design as de
from sonagrid.operators import dynamics as dy
from sonagrid.operators import kernels as ke
from sonagrid.operators import levels as lv
from sonagrid.operators import long_fft as lf
from sonagrid.operators import responses as rs
from sonagrid.operators import rooms as rm
from sonagrid.operators import similarity as si
from sonagrid.operators import spectra as sp
from sonagrid.operators import transforms as tf
from sonagrid.sources import generators as ge
from sonagrid.sources import tables as tb
from sonagrid.sources import wav

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}

E = "e as materialized (select user_id as ch, row_number() over (partition by user_id order by ts, event_id) - 1 as n, value as re from events)"
V = "v as (select vec_id as ch, u.i - 1 as n, cast(embedding[u.i] as double) as re from embeddings, (select unnest(range(1, 65)) as i) u)"
L = (
    "l as (select l_suppkey as ch, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity, "
    "l_extendedprice, l_discount, l_tax) - 1 as n, l_extendedprice as re from lineitem)"
)
H = (
    "h as (select t.ch, g.n, cast(coalesce(c.c, 0) as double) as re from (select distinct event_type as ch from events) t cross join "
    "(select unnest(range(0, 720)) as n) g left join (select event_type as ch, cast(floor((epoch_us(ts) - 1704067200000000) / 3600000000) as bigint) as n, "
    "count(*) as c from events group by all) c on c.ch = t.ch and c.n = g.n)"
)
P = "p as (select vec_id as pid, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as z from embeddings)"


def _r(expr: str, digits: int = 6) -> str:
    return f"round({expr} + 3.14159e-8, {digits}) + 0.0"


def _out(df: DataFrame, *values: str, digits: int = 6) -> DataFrame:
    return df.withColumns({v: stable(v, digits) for v in values})


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_PAIR = ("pair",)


def _pair_sql(a: str, b: str) -> str:
    """Channels 2 p and 2 p + 1, side by side by one grouping."""
    sides = "select ch // 2 as pair, n, max(case when ch % 2 = 0 then re end) as l, max(case when ch % 2 = 1 then re end) as r from v group by ch // 2, n having count(distinct ch % 2) = 2"
    return f"with {V}, p as ({sides}) select pair, n, {_r(a)} as a, {_r(b)} as b from p"


# --- levels ---------------------------------------------------------------------


@query(f"with {E} select ch, {_r('20 * log10(stddev_pop(re))')} as rms_dbfs from e group by ch")
def rms_dbfs(spark, d):
    return _out(lv.rms_dbfs(tb.events(spark, d)), "rms_dbfs")


@query(f"with {E} select ch, {_r('20 * log10(max(abs(re)))')} as peak_dbfs from e group by ch")
def peak_dbfs(spark, d):
    return _out(lv.peak_dbfs(tb.events(spark, d)), "peak_dbfs")


@query(f"with {E} select ch, {_r('20 * log10(max(abs(re)) / stddev_pop(re))')} as crest_db from e group by ch")
def crest_factor_db(spark, d):
    return _out(lv.crest_factor_db(tb.events(spark, d)), "crest_db")


@query(f"with {L} select ch, {_r('sum(re * re) / 1e6', 3)} as energy, {_r('avg(re * re) / 1e6', 4)} as power from l group by ch")
def energy_power(spark, d):
    out = lv.energy(tb.lineitem(spark, d))
    return out.select("ch", stable(F.col("energy") / 1e6, 3).alias("energy"), stable(F.col("power") / 1e6, 4).alias("power"))


@query(f"with {E} select ch, n, {_r('re / max(abs(re)) over (partition by ch)')} as re from e")
def normalize_peak(spark, d):
    return _out(lv.normalize(tb.events(spark, d), each_channel=True), "re")


@query(f"with {E}, m as (select max(s) as s from (select stddev_pop(re) as s from e group by ch)) select ch, n, {_r('re * (0.1 / s)')} as re from e, m")
def normalize_rms(spark, d):
    return _out(lv.normalize(tb.events(spark, d), -20.0, peak=False), "re")


@query(f"with {V} select ch, n, {_r('re * pow(10, 6.0 / 20)')} as re from v")
def apply_gain(spark, d):
    return _out(lv.gain(tb.vectors(spark, d), 6.0), "re")


@query(f"with {V} select ch, n, {_r('20 * log10(greatest(abs(re), 2.2250738585072014e-308))')} as re from v")
def to_db(spark, d):
    return _out(lv.in_db(tb.vectors(spark, d)), "re")


@query(f"with {V} select ch, n, {_r('pow(10, re / 20)')} as re from v")
def from_db(spark, d):
    return _out(tb.vectors(spark, d).withColumn("re", fn.from_db("re")), "re")


def _fade_sql(curve: str) -> str:
    back = curve.replace("@", "(m - n)")
    front = curve.replace("@", "n")
    return f"with {E}, f as (select *, max(n) over (partition by ch) as m from e) select ch, n, {_r(f're * (case when m - n < 10 then {back} else 1.0 end) * (case when n < 10 then {front} else 1.0 end)')} as re from f"


@query(_fade_sql("@ / 9.0"))
def fade_linear(spark, d):
    return _out(lv.fade(tb.events(spark, d), 10), "re")


@query(_fade_sql("pow(10, (@ / 9.0 - 1) * 5)"))
def fade_exponential(spark, d):
    return _out(lv.fade(tb.events(spark, d), 10, "exponential"), "re")


@query(_fade_sql(f"log10(1 + @ / 9.0 * {50 * sqrt(10) - 1!r}) / {log10(50 * sqrt(10))!r}"))
def fade_logarithmic(spark, d):
    return _out(lv.fade(tb.events(spark, d), 10, "logarithmic"), "re")


@query(f"with {E} select ch, n, {_r('re - avg(re) over (partition by ch)')} as re from e")
def detrend_constant(spark, d):
    return _out(lv.detrend(tb.events(spark, d), 0), "re")


@query(f"with {V} select ch, n, {_r('re - avg(re) over w - covar_pop(re, n) over w / var_pop(n) over w * (n - avg(n) over w)')} as re from v window w as (partition by ch)")
def detrend_linear(spark, d):
    return _out(lv.detrend(tb.vectors(spark, d), 1), "re")


@query(f"with {E} select ch, n, {_r('sqrt(sum(re * re) over (partition by ch order by n rows between 15 preceding and current row) / 16)')} as re from e")
def envelope_rms16(spark, d):
    return _out(lv.envelope_rms(tb.events(spark, d), 16), "re")


@query(
    f"with {E}, v as (select ch, n, sqrt(sum(re * re) over (partition by ch order by n rows between 7 preceding and current row) / 8) as r from e) "
    "select ch, n, 20 * log10(r / max(r) over (partition by ch)) >= -3.0 as active from v"
)
def activity(spark, d):
    return lv.activity(tb.events(spark, d), -3.0, 8)


@query(f"with {V} select ch, n, greatest(-128.0, least(127.0, floor(re * 128 + 0.5))) / 128 as re from v")
def quantize_8bit(spark, d):
    return lv.quantize(tb.vectors(spark, d), 8)


@query(f"with {E}, f as (select ch, {2e-5 * 10 ** (94 / 20)!r} / stddev_pop(re) as f from e group by ch) select e.ch, n, {_r('re * f')} as re from e join f on e.ch = f.ch")
def calibrate(spark, d):
    e = tb.events(spark, d)
    return _out(lv.calibrate(e, e), "re")


# --- editing --------------------------------------------------------------------


@query(f"with {E} select ch, n - 10 as n, re from e where n >= 10 and n < 40")
def time_slice(spark, d):
    return ed.time_slice(tb.events(spark, d), 10, 40)


@query(f"with {E} select c.ch, g.n, coalesce(e.re, 0.0) as re from (select distinct ch from e) c cross join (select unnest(range(0, 80)) as n) g left join e on e.ch = c.ch and e.n = g.n")
def pad_trim(spark, d):
    return ed.pad_trim(tb.events(spark, d), 80)


@query(f"with {E} select ch, n + 5 as n, re from e union all select ch, g.n, 0.0 from (select distinct ch from e) c, (select unnest(range(0, 5)) as n) g")
def delay(spark, d):
    return ed.delay(tb.events(spark, d), 5)


@query(
    f"with {V}, t as (select *, max(abs(re)) over (partition by ch) as m from v), h as (select *, min(case when abs(re) >= m * {10 ** (-6 / 20)!r} then n end) over (partition by ch) as a, "
    f"max(case when abs(re) >= m * {10 ** (-6 / 20)!r} then n end) over (partition by ch) as b from t) select ch, n - a as n, re from h where n between a and b"
)
def trim_level(spark, d):
    return ed.trim_level(tb.vectors(spark, d), -6.0)


@query(f"with {E} select ch, max(n) over (partition by ch) - n as n, re from e")
def reverse(spark, d):
    return ed.reverse(tb.events(spark, d))


@query(f"with {V} select cast(case ch when 3 then 0 when 1 then 1 else 2 end as bigint) as ch, n, re from v where ch in (3, 1, 7)")
def get_channels(spark, d):
    return ed.get_channels(tb.vectors(spark, d), [3, 1, 7])


@query(f"with {V} select n, {_r('sum(re)')} as re from v group by n")
def sum_channels(spark, d):
    return _out(ed.sum_channels(tb.vectors(spark, d)), "re")


@query(_pair_sql("(l + r) * 0.5", "(l - r) * 0.5"))
def mid_side(spark, d):
    return _out(ed.mid_side(ed.in_pairs(tb.vectors(spark, d)), 0, 1, keys=_PAIR), "a", "b")


@query(f"with {E}, m as (select ch, max(n) + 1 as k from e group by ch) select ch, n, re from e union all select e.ch, n + k, re from e join m on e.ch = m.ch where n < 10")
def append(spark, d):
    e = tb.events(spark, d)
    return ed.append(e, e.where("n < 10"))


@query(f"with {E} select ch, n, {_r('sum(re)')} as re from (select * from e union all select ch, n + 3, re from e) group by ch, n")
def mix_signals(spark, d):
    e = tb.events(spark, d)
    return _out(ed.mix([e, e.withColumn("n", F.col("n") + 3)]), "re")


@query(f"with {E} select ch, n, re, cast(n % 3 as bigint) as phase, n // 3 as m from e")
def polyphase(spark, d):
    out = ed.interleave(tb.events(spark, d), 3)
    return out.withColumn("phase", F.col("phase").cast("long"))


@query(f"with {V} select ch, n * 2 + g.k as n, re from v, (select unnest(range(0, 2)) as k) g")
def sample_hold(spark, d):
    return ed.hold(tb.vectors(spark, d), 2)


# --- frames ---------------------------------------------------------------------

_FRAMES = (
    f"{E}, k as (select ch, greatest(0, ceil((max(n) + 1 - 16) / 8.0)) as c from e group by ch), "
    "f as (select e.ch, cast(g.frame as bigint) as frame, e.n - g.frame * 8 as m, e.re as x from e join k on e.ch = k.ch, (select unnest(range(0, 200)) as frame) g "
    "where e.n >= g.frame * 8 and e.n < g.frame * 8 + 16 and g.frame < k.c)"
)
_HANN = "(0.5 - 0.5 * cos(m * 2 * pi() / 16))"


@query(f"with {_FRAMES} select ch, frame, {_r('avg(x)')} as mean, {_r('sqrt(avg(x * x))')} as rms, {_r('max(abs(x))')} as peak from f group by ch, frame")
def frame_statistics(spark, d):
    return _out(fr.frame_statistics(fr.frames(tb.events(spark, d), 16, 8)), "mean", "rms", "peak")


@query(
    f"with {V}, f as (select ch, n // 16 as frame, n % 16 as m, re as x from v where n < 48), z as (select *, lag(x >= 0) over (partition by ch, frame order by m) as b from f) "
    "select ch, frame, cast(coalesce(sum(case when (x >= 0) <> b then 1 else 0 end), 0) as bigint) as crossings from z group by ch, frame"
)
def zero_crossings(spark, d):
    return fr.zero_crossings(fr.frames(tb.vectors(spark, d), 16, 16))


@query(
    f"with {_FRAMES}, o as (select ch, frame * 8 + m as n, x * {_HANN} * {_HANN} as y, {_HANN} * {_HANN} as w from f) "
    f"select ch, n, {_r('sum(y) / greatest(sum(w), 1e-4)')} as re from o group by ch, n"
)
def overlap_add(spark, d):
    framed = fr.windowed(fr.frames(tb.events(spark, d), 16, 8), "hann", 16)
    return _out(fr.overlap_add(framed, 8, "hann", 16), "re")


# --- spectra --------------------------------------------------------------------

_DFT = (
    f"{V}, b as (select unnest(range(0, 33)) as k), s as (select ch, cast(k as integer) as k, k / 64.0 as f_hz, "
    "sum(re * cos(-2 * pi() * ((n * k) % 64) / 64)) as re, sum(re * sin(-2 * pi() * ((n * k) % 64) / 64)) as im from v, b group by ch, k)"
)
_STFT = (
    f"{_FRAMES}, w as (select ch, frame, m, x * {_HANN} as x from f), t as (select ch, frame, m, x - sum(x) over (partition by ch, frame) / 16 as x from w), "
    "s as (select ch, frame, cast(k as integer) as k, sum(x * cos(-2 * pi() * ((m * k) % 16) / 16)) as re, sum(x * sin(-2 * pi() * ((m * k) % 16) / 16)) as im "
    "from t, (select unnest(range(0, 9)) as k) b group by ch, frame, k)"
)


def _stft(spark, d):
    return sp.stft(tb.events(spark, d), 16, 8, "hann", detrend=True)


@query(f"with {_DFT} select ch, k, f_hz, {_r('re', 4)} as re, {_r('im', 4)} as im from s")
def spectrum_dft(spark, d):
    return _out(sp.dft(tb.vectors(spark, d), 64), "re", "im", digits=4)


@query(
    f"with {V}, q as (select unnest([1.5, 3.25, 7.0]) as f_hz) select ch, cast(f_hz as double) as f_hz, {_r('sum(re * cos(-2 * pi() * n * f_hz / 64))', 4)} as re, "
    f"{_r('sum(re * sin(-2 * pi() * n * f_hz / 64))', 4)} as im from v, q group by ch, f_hz"
)
def dft_arbitrary(spark, d):
    at = spark.createDataFrame([(1.5,), (3.25,), (7.0,)], "f_hz double")
    return _out(sp.dft_at(tb.vectors(spark, d), at, 64), "re", "im", digits=4)


@query(f"with {V} select ch, n, {_r('re', 4)} as re from v")
def dft_round_trip(spark, d):
    return _out(sp.idft(sp.dft(tb.vectors(spark, d), 64), 64), "re", digits=4)


@query(f"with {_STFT} select ch, frame, k, {_r('re', 4)} as re, {_r('im', 4)} as im from s")
def stft(spark, d):
    return _out(_stft(spark, d), "re", "im", digits=4)


@query(
    f"with {_FRAMES}, o as (select ch, frame * 8 + m as n, x * {_HANN} * {_HANN} as y, {_HANN} * {_HANN} as w from f) "
    f"select ch, n, {_r('sum(y) / greatest(sum(w), 1e-4)', 4)} as re from o group by ch, n"
)
def istft(spark, d):
    spectra = sp.stft(tb.events(spark, d), 16, 8, "hann")
    return _out(sp.istft(spectra, 16, 8, "hann"), "re", digits=4)


@query(f"with {_STFT} select ch, k, {_r('sqrt(avg(re * re + im * im))', 4)} as value from s group by ch, k")
def welch_mean(spark, d):
    power = sp.welch(tb.events(spark, d), 16, 8, "hann")
    return _out(sp.scaled(power, 16, "hann", 1, "fft_backward"), "value", digits=4)


@query(f"with {_STFT} select ch, k, {_r('median(re * re + im * im)', 3)} as power from s group by ch, k")
def welch_median(spark, d):
    return _out(sp.welch(tb.events(spark, d), 16, 8, "hann", "median"), "power", digits=3)


@query(
    f"with {_STFT} select ch, k, {_r('avg(re * re + im * im) * (case when k in (0, 8) then 1 else 2 end) / (100 * (select sum(' + _HANN + ' * ' + _HANN + ') from (select unnest(range(0, 16)) as m)))', 4)} as value from s group by ch, k"
)
def power_density(spark, d):
    power = sp.welch(tb.events(spark, d), 16, 8, "hann")
    return _out(sp.scaled(power, 16, "hann", 100, "density"), "value", digits=4)


_MATRICES = (
    f"with {_STFT}, c as (select *, ch // 12 as array_id, ch % 12 as mic from s) select a.array_id, a.k, a.mic as ch_i, b.mic as ch_j, {_r('avg(a.re * b.re + a.im * b.im)', 3)} as re, "
    f"{_r('avg(a.re * b.im - a.im * b.re)', 3)} as im from c a join c b on a.array_id = b.array_id and a.frame = b.frame and a.k = b.k and a.mic <= b.mic group by a.array_id, a.k, a.mic, b.mic"
)


@query(_MATRICES)
def cross_spectral_matrix(spark, d):
    return _out(sp.cross_spectra(_array_spectra(spark, d, 12), keys=_ARRAY), "re", "im", digits=3)


@query(
    f"with {_STFT}, p as (select a.ch // 2 as pair, a.k, a.re as a, a.im as b, b.re as c, b.im as d from s a join s b on a.frame = b.frame and a.k = b.k and a.ch % 2 = 0 and b.ch = a.ch + 1 where a.k between 1 and 7), "
    "g as (select pair, k, avg(a * a + b * b) as xx, avg(c * c + d * d) as yy, avg(a * c + b * d) as r, avg(a * d - b * c) as i from p group by pair, k) "
    f"select pair, k, {_r('r / xx')} as h1_re, {_r('i / xx')} as h1_im, {_r('yy * r / (r * r + i * i)')} as h2_re, {_r('yy * i / (r * r + i * i)')} as h2_im, "
    f"{_r('r / sqrt(r * r + i * i) * sqrt(yy / xx)')} as h3_re, {_r('i / sqrt(r * r + i * i) * sqrt(yy / xx)')} as h3_im, {_r('(r * r + i * i) / (xx * yy)')} as coherence from g"
)
def transfer_coherence(spark, d):
    return _out(sp.transfer(ed.in_pairs(_stft(spark, d)).where("k between 1 and 7"), 0, 1, _PAIR), "h1_re", "h1_im", "h2_re", "h2_im", "h3_re", "h3_im", "coherence")


@query(
    f"with {_DFT} select a.ch // 2 as pair, a.k, {_r('(b.re * a.re + b.im * a.im) / (a.re * a.re + a.im * a.im + 0.01)')} as re, {_r('(b.im * a.re - b.re * a.im) / (a.re * a.re + a.im * a.im + 0.01)')} as im "
    "from s a join s b on a.k = b.k and a.ch % 2 = 0 and b.ch = a.ch + 1"
)
def deconvolution(spark, d):
    return _out(sp.deconvolve(ed.in_pairs(sp.dft(tb.vectors(spark, d), 64)), 0, 1, keys=_PAIR), "re", "im")


@query(
    f"with {_DFT}, i as (select ch, f_hz, re * re + im * im as p from s where f_hz between 0.1 and 0.3), t as (select ch, (f_hz - lag(f_hz) over w) * (p + lag(p) over w) / 2 as a from i window w as (partition by ch order by f_hz)) "
    f"select ch, {_r('coalesce(sum(a), 0.0)')} as energy from t group by ch"
)
def spectrum_energy(spark, d):
    return _out(sp.band_energy(sp.dft(tb.vectors(spark, d), 64), 0.1, 0.3), "energy")


@query(
    f"with {_DFT}, q as (select unnest([0.05, 0.123, 0.377]) as f), m as (select ch, k, f_hz, sqrt(re * re + im * im) as v from s) "
    f"select a.ch, cast(q.f as double) as f_hz, {_r('a.v + (q.f - a.f_hz) * 64 * (b.v - a.v)')} as value from q, m a join m b on a.ch = b.ch and b.k = a.k + 1 where q.f >= a.f_hz and q.f < b.f_hz"
)
def interpolate_linear(spark, d):
    s = sp.dft(tb.vectors(spark, d), 64).withColumn("value", fn.magnitude())
    at = spark.createDataFrame([(0.05,), (0.123,), (0.377,)], "f_hz double")
    return _out(sp.interpolate(s, at), "value")


@query(
    f"with {_DFT}, m as (select ch, k, f_hz, sqrt(re * re + im * im) as v, cast(round(log2(f_hz) * 1e6) as bigint) as l from s where k > 0) "
    f"select ch, k, {_r('avg(v) over (partition by ch order by l range between 166667 preceding and 166667 following)')} as value from m"
)
def smooth_third_octave(spark, d):
    s = sp.dft(tb.vectors(spark, d), 64).withColumn("value", fn.magnitude())
    return _out(sp.smooth_octaves(s, 3.0).select("ch", "k", "value"), "value")


@query(
    f"with {_DFT}, w as (select ch, k, f_hz, re, im, lead(re) over o as r, lead(im) over o as i, lead(f_hz) over o as f from s window o as (partition by ch order by k)) "
    f"select ch, k, {_r('-atan2(re * i - im * r, re * r + im * i) / (2 * pi() * (f - f_hz))', 3)} as delay_s from w where f is not null"
)
def group_delay(spark, d):
    return _out(sp.group_delay(sp.dft(tb.vectors(spark, d), 64)), "delay_s", digits=3)


@query(
    f"with {_DFT}, p as (select ch, f_hz, re * re + im * im as p from s), g as (select ch, sum(p) as s0, sum(p * f_hz) as s1, sum(p * f_hz * f_hz) as s2, avg(ln(p)) as l, avg(p) as a from p where p > 0 group by ch) "
    f"select ch, {_r('s1 / s0')} as centroid_hz, {_r('sqrt(greatest(0, s2 / s0 - (s1 / s0) * (s1 / s0)))')} as spread_hz, {_r('exp(l) / a')} as flatness from g"
)
def spectral_shape(spark, d):
    return _out(sp.shape(sp.dft(tb.vectors(spark, d), 64)), "centroid_hz", "spread_hz", "flatness")


# --- filters --------------------------------------------------------------------


@query(f"with {E} select ch, n, {_r('0.5 * re + 0.3 * coalesce(lag(re, 1) over w, 0) + 0.2 * coalesce(lag(re, 2) over w, 0)')} as re from e window w as (partition by ch order by n)")
def fir3(spark, d):
    return _out(fi.fir(tb.events(spark, d), [0.5, 0.3, 0.2]), "re")


def _taps_sql(taps: list[float]) -> str:
    return f"t as (select unnest(range(0, {len(taps)})) as m, unnest([{', '.join(repr(float(b)) for b in taps)}]::double[]) as b)"


@query(f"with {E}, {_taps_sql(fi.windowed_sinc(14, 0.25))} select ch, n + m as n, {_r('sum(re * b)')} as re from e, t group by ch, n + m")
def fir_hamming15(spark, d):
    return _out(fi.convolve(tb.events(spark, d), fi.windowed_sinc(14, 0.25)), "re")


@query(
    f"with {L}, {_taps_sql(fi.windowed_sinc(40, 0.125))}, x as (select *, max(n) over (partition by ch) as k from l) "
    f"select ch, n + m as n, {_r('sum(re * b)', 4)} as re from x, t where n + m <= k group by ch, n + m"
)
def fir_long(spark, d):
    return _out(fi.fir(tb.lineitem(spark, d), fi.windowed_sinc(40, 0.125)), "re", digits=4)


@query(
    f"with {E}, {_taps_sql(fi.windowed_sinc(20, 0.5))}, x as (select *, max(n) over (partition by ch) as k from e) "
    f"select ch, (n + m) // 2 as n, {_r('sum(re * b)')} as re from x, t where n + m <= k and (n + m) % 2 = 0 group by ch, n + m"
)
def decimate2(spark, d):
    return _out(fi.decimate(tb.events(spark, d), 2), "re")


@query(
    f"with {E}, {_taps_sql([2 * b for b in fi.windowed_sinc(20, 0.5)])}, x as (select *, max(n) over (partition by ch) as k from e) "
    f"select ch, n * 2 + m as n, {_r('sum(re * b)')} as re from x, t where n * 2 + m < (k + 1) * 2 group by ch, n * 2 + m"
)
def upsample2(spark, d):
    return _out(fi.upsample(tb.events(spark, d), 2), "re")


@query(f"with {V}, {_taps_sql(fi.fractional_delay_taps(20.5)[0])} select ch, n + m + {fi.fractional_delay_taps(20.5)[1]} as n, {_r('sum(re * b)')} as re from v, t group by ch, n + m")
def fractional_delay(spark, d):
    return _out(fi.fractional_delay(tb.vectors(spark, d), 20.5), "re")


@query(f"with {E} select ch, n, {_r('avg(re) over (partition by ch order by n rows between 2 preceding and 2 following)')} as re from e")
def moving_average5(spark, d):
    return _out(fi.moving_average(tb.events(spark, d), 5), "re")


_FOLD = "list_reduce(list_prepend(0.0::double, list(re order by n)), lambda acc, x: 0.1 * x + 0.9 * acc)"


@query(f"with {E} select ch, {_r(_FOLD)} as value from e group by ch")
def one_pole_last(spark, d):
    return _out(fi.one_pole(tb.events(spark, d), 0.1), "value")


@query(
    f"with {E} select a.ch, a.n, {_r('sum(0.3 * pow(0.7, a.n - b.n) * b.re)')} as re from e a join e b on a.ch = b.ch and b.n <= a.n and b.n >= a.n - 97 group by a.ch, a.n"
)
def one_pole_series(spark, d):
    return _out(fi.one_pole_series(tb.events(spark, d), 0.3), "re")


# --- similarity -----------------------------------------------------------------

_ONE = f"{V}, r as (select n, re from v where ch = 0), o as (select * from v where ch <> 0)"


@query(f"with {_ONE} select ch, {_r('20 * log10(stddev_pop(re) / (select stddev_pop(re) from r))')} as snr_db from o group by ch")
def snr(spark, d):
    v = tb.vectors(spark, d)
    return _out(si.snr_one(v.where("ch <> 0"), v.where("ch = 0")), "snr_db")


@query(
    f"with {_ONE}, g as (select o.ch, sum(r.re * r.re) as xx, sum(r.re * o.re) as xy, sum(o.re * o.re) as yy from o join r on o.n = r.n group by o.ch) "
    f"select ch, {_r('10 * log10(xy * xy / xx / (yy - xy * xy / xx))', 4)} as si_sdr_db from g"
)
def si_sdr(spark, d):
    others, one = si.against(tb.vectors(spark, d), 0)
    return _out(si.si_sdr(one, others), "si_sdr_db", digits=4)


@query(
    f"with {_ONE}, c as (select o.ch, o.n - r.n as lag, sum(o.re * r.re) as v from o, r group by o.ch, o.n - r.n), "
    "x as (select *, row_number() over (partition by ch order by round(abs(v), 9) desc, lag) as i from c) "
    f"select ch, lag, {_r('v')} as value from x where i = 1"
)
def correlation_latency(spark, d):
    v = tb.vectors(spark, d)
    return _out(si.correlation_lag(v.where("ch <> 0"), v.where("ch = 0")), "value")


@query(f"with {V} select a.ch, cast(b.n - a.n as integer) as lag, {_r('sum(a.re * b.re)')} as value from v a join v b on a.ch = b.ch and b.n - a.n between 0 and 8 group by a.ch, b.n - a.n")
def autocorrelation(spark, d):
    return _out(si.autocorrelation(tb.vectors(spark, d), 8), "value")


@query(f"with {_ONE} select ch, {_r('corr(o.re, r.re)')} as r from o join r on o.n = r.n group by ch")
def pearson(spark, d):
    v = tb.vectors(spark, d)
    return _out(si.pearson(v.where("ch <> 0"), v.where("ch = 0")), "r")


@query(
    f"with {_DFT}, p as (select ch, k, f_hz, re * re + im * im as p from s where k < 32), z as (select ch, k, f_hz, p / sum(p) over (partition by ch) as p from p), "
    "r as (select a.ch, a.k, a.p / b.p as r from z a join z b on a.k = b.k and b.ch = 0 where a.ch <> 0), "
    "w as (select ch, (case when k > 30 then 0 when k in (0, 30) then 1 / 3.0 when k % 2 = 1 then 4 / 3.0 else 2 / 3.0 end + case k when 31 then 5 / 12.0 when 30 then 2 / 3.0 when 29 then -1 / 12.0 else 0 end)::double / 64 as w, r from r) "
    f"select ch, {_r('sqrt(sum(w * pow(10 * log10(r), 2)))', 4)} as log_spectral, {_r('sum(w * (r - log10(r) - 1)) / 100', 3)} as itakura_saito from w group by ch"
)
def spectral_distances(spark, d):
    p = sp.dft(tb.vectors(spark, d), 64, 1).select("ch", "k", "f_hz", F.expr("re * re + im * im").alias("power"))
    others = p.where("ch <> 0")
    reference = others.select("ch", "k").join(p.where("ch = 0").select("k", "power"), "k")
    out = si.spectral_distances(others, reference, 0.0, 0.5)
    return out.select("ch", stable("log_spectral", 4).alias("log_spectral"), stable(F.col("itakura_saito") / 100, 3).alias("itakura_saito"))


@query(
    f"with {_ONE}, g as (select o.ch, o.n // 16 as f, sum(r.re * r.re) as s, sum((r.re - o.re) * (r.re - o.re)) as d from o join r on o.n = r.n group by all) "
    f"select ch, {_r('avg(least(35.0, greatest(-10.0, 10 * log10(s / greatest(d, 1e-300)))))')} as seg_snr_db from g where s > 0 group by ch"
)
def segmental_snr(spark, d):
    others, one = si.against(tb.vectors(spark, d), 0)
    return _out(si.segmental_snr(one, others, 16), "seg_snr_db")


# --- rooms ----------------------------------------------------------------------


@query(f"with {V} select ch, n, {_r('10 * log10(greatest(sum(re * re) over (partition by ch order by n desc rows between unbounded preceding and current row) / sum(re * re) over (partition by ch), 1e-300))')} as edc_db from v")
def energy_decay(spark, d):
    return _out(rm.energy_decay(tb.vectors(spark, d)), "edc_db")


@query(
    f"with {V}, c as (select ch, n, 10 * log10(greatest(sum(re * re) over (partition by ch order by n desc rows between unbounded preceding and current row) / sum(re * re) over (partition by ch), 1e-300)) as l from v) "
    f"select ch, {_r('-60 / regr_slope(l, n / 1000.0)')} as rt_s from c where l between -10 and -1 group by ch"
)
def reverberation_time(spark, d):
    return _out(rm.reverberation_time(rm.energy_decay(tb.vectors(spark, d)), 1000, -1.0, -10.0), "rt_s")


@query(f"with {V} select ch, {_r('sum(case when n < 20 then re * re else 0 end) / sum(re * re)')} as definition from v group by ch")
def definition_d50(spark, d):
    return _out(rm.definition(tb.vectors(spark, d), 400), "definition")


@query(f"with {V} select ch, {_r('10 * log10(sum(case when n < 32 then re * re else 0 end) / (sum(re * re) - sum(case when n < 32 then re * re else 0 end)))')} as clarity_db from v group by ch")
def clarity_c80(spark, d):
    return _out(rm.clarity(tb.vectors(spark, d), 400), "clarity_db")


@query(f"with {V} select ch, {_r('sum(re * re * n) / sum(re * re) / 400')} as centre_time_s from v group by ch")
def centre_time(spark, d):
    return _out(rm.centre_time(tb.vectors(spark, d), 400), "centre_time_s")


@query(
    f"with {V}, t as (select *, first_value(n) over (partition by ch order by abs(re) desc, n) as p, max(abs(re)) over (partition by ch) as m from v) "
    "select ch, coalesce(max(case when n < p and abs(re) < m * 0.1 then n end), -1) + 1 as start from t group by ch"
)
def response_start(spark, d):
    return rm.start(tb.vectors(spark, d))


@query(
    f"with {V}, s as (select a.ch // 2 as pair, b.n - a.n as g, sum(a.re * b.re) as v from v a join v b on a.ch % 2 = 0 and b.ch = a.ch + 1 and b.n - a.n between -8 and 8 group by a.ch // 2, b.n - a.n), "
    "e as (select ch // 2 as pair, sum(case when ch % 2 = 0 then re * re end) * sum(case when ch % 2 = 1 then re * re end) as e from v group by ch // 2), m as (select pair, max(abs(v)) as v from s group by pair) "
    f"select m.pair, {_r('v / sqrt(e)')} as iacc from m join e on m.pair = e.pair"
)
def interaural_correlation(spark, d):
    return _out(rm.interaural_correlation(ed.in_pairs(tb.vectors(spark, d)), 0, 1, 8, _PAIR), "iacc")


@query(
    "with m as (select cast(a.i as integer) as nx, cast(b.i as integer) as ny, cast(c.i as integer) as nz, 343 / 2.0 * sqrt((a.i / 6.0) ** 2 + (b.i / 4.0) ** 2 + (c.i / 3.0) ** 2) as f "
    "from range(0, 40) a(i), range(0, 40) b(i), range(0, 40) c(i)) "
    f"select nx, ny, nz, {_r('f')} as f_hz, ['axial', 'tangential', 'oblique'][(nx > 0)::int + (ny > 0)::int + (nz > 0)::int] as kind from m where nx + ny + nz > 0 and f <= 200"
)
def room_modes(spark, d):
    return _out(rm.shoebox_modes(spark, (6.0, 4.0, 3.0), 200.0), "f_hz")


@query(
    "with g as (select cast(a.i as integer) as i, cast(b.i as integer) as j, cast(c.i as integer) as k from range(-3, 4) a(i), range(-3, 4) b(i), range(-3, 4) c(i)), "
    "q as (select *, (case when i % 2 = 0 then i * 6.0 + 1.0 else (i + 1) * 6.0 - 1.0 end) - 4.0 as x, (case when j % 2 = 0 then j * 4.0 + 2.0 else (j + 1) * 4.0 - 2.0 end) - 1.0 as y, "
    "(case when k % 2 = 0 then k * 3.0 + 1.5 else (k + 1) * 3.0 - 1.5 end) - 1.2 as z from g), r as (select *, sqrt(x * x + y * y + z * z) as dist from q) "
    f"select i, j, k, {_r('dist')} as distance_m, cast(floor(dist / 343 * 48000 + 0.5) as bigint) as n, {_r('pow(0.8, abs(i) + abs(j) + abs(k)) / dist')} as gain from r"
)
def image_source_delays(spark, d):
    out = rm.image_sources(spark, (6.0, 4.0, 3.0), (1.0, 2.0, 1.5), (4.0, 1.0, 1.2), 3, 0.8, 48000)
    return _out(out, "distance_m", "gain")


@query(
    f"select o_orderkey as room, {_r('0.161 * o_totalprice / (o_totalprice / 4 * 0.2)')} as sabine_s, {_r('0.161 * o_totalprice / (-(o_totalprice / 4) * ln(0.8))')} as eyring_s, {_r('2000 * sqrt(0.5 / o_totalprice)')} as schroeder_hz from orders"
)
def room_estimates(spark, d):
    v = F.col("o_totalprice")
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(
        F.col("o_orderkey").alias("room"),
        stable(rm.sabine(v, v / 4, F.lit(0.2))).alias("sabine_s"),
        stable(rm.eyring(v, v / 4, F.lit(0.2))).alias("eyring_s"),
        stable(rm.schroeder_frequency(v, F.lit(0.5))).alias("schroeder_hz"),
    )


# --- features -------------------------------------------------------------------

_POWER = f"{_DFT}, p as (select ch, k, f_hz * 8000 as f_hz, re * re + im * im as power from s)"


def _power(spark, d):
    s = sp.dft(tb.vectors(spark, d), 64, 8000)
    return s.select("ch", "k", "f_hz", F.expr("re * re + im * im").alias("power"))


def _weights_sql(rows: list[tuple]) -> str:
    return "w as (select * from (values " + ", ".join(f"({b}, {k}, {v!r}::double)" for b, k, v in rows) + ") w(band, k, w))"


_MEL = ft.mel_weights(33, 8000, 12)


@query(f"with {_POWER}, {_weights_sql(_MEL)} select ch, cast(band as integer) as band, {_r('sum(power * w)')} as energy from p join w on p.k = w.k group by ch, band")
def mel_energy(spark, d):
    return _out(ft.weighted_bands(_power(spark, d), _MEL), "energy")


@query(
    f"with {_POWER}, {_weights_sql(_MEL)}, m as (select ch, band, sum(power * w) as energy from p join w on p.k = w.k group by ch, band) "
    f"select ch, cast(c as integer) as c, {_r('abs(sum(10 * log10(greatest(energy, 1e-30)) * 2 * cos(pi() * c * (2 * band + 1) / 24)))', 4)} as value from m, (select unnest(range(0, 12)) as c) g group by ch, c"
)
def mfcc(spark, d):
    bands = ft.weighted_bands(_power(spark, d), _MEL)
    return _out(ft.cepstral_coefficients(bands, 12, 12), "value", digits=4)


@query(f"with {_POWER}, {_weights_sql(ft.chroma_weights(33, 8000))} select ch, cast(band as integer) as band, {_r('ln(1 + 0.5 * sum(power * w))')} as value from p join w on p.k = w.k group by ch, band")
def chroma_energy(spark, d):
    return _out(ft.chroma(_power(spark, d), 33, 8000), "value")


@query(
    f"with {_POWER}, c as (select unnest([250.0, 500.0, 1000.0, 2000.0]) as c) select ch, cast(c as double) as centre_hz, {_r('sum(power)')} as energy from p join c on f_hz >= c / sqrt(2) and f_hz < c * sqrt(2) group by ch, c"
)
def octave_energy(spark, d):
    return _out(ft.octave_bands(_power(spark, d), [250.0, 500.0, 1000.0, 2000.0]), "energy")


@query(f"select i, {_r('1000 * pow(2, i / 3.0)')} as f_hz from range(-36, 37) t(i) where 1000 * pow(2, i / 3.0) between 20 and 20000")
def octave_centres(spark, d):
    return _out(ft.octave_centres(spark, 20.0, 20000.0, 3), "f_hz")


@query(
    f"with {_STFT}, m as (select ch, frame, k, sqrt(re * re + im * im) as m from s), r as (select ch, frame, greatest(0, m - lag(m) over (partition by ch, k order by frame)) as d, lag(m) over (partition by ch, k order by frame) as b from m) "
    f"select ch, frame, {_r('coalesce(sum(case when b is not null then d else 0 end), 0.0)', 4)} as flux from r group by ch, frame"
)
def spectral_flux(spark, d):
    return _out(ft.flux(_stft(spark, d)), "flux", digits=4)


@query(
    f"with {_POWER}, l as (select *, lag(power) over w as a, lead(power) over w as b from p window w as (partition by ch order by k)), r as (select ch, row_number() over (partition by ch order by power desc, k) as rank, k, power from l where power > a and power > b) "
    f"select ch, cast(rank as integer) as rank, k, {_r('power', 4)} as power from r where rank <= 3"
)
def spectral_peaks(spark, d):
    return _out(ft.peaks(_power(spark, d), 3), "power", digits=4)


@query(
    f"with {_DFT}, l as (select ch, k, ln(greatest(sqrt(re * re + im * im), 1e-30)) as v from s) select ch, n, {_r('sum((case when k in (0, 32) then 1 else 2 end) / 64.0 * v * cos(2 * pi() * ((k * n) % 64) / 64))', 4)} as re from l, (select unnest(range(0, 64)) as n) g group by ch, n"
)
def real_cepstrum(spark, d):
    return _out(ft.real_cepstrum(sp.dft(tb.vectors(spark, d), 64), 64), "re", digits=4)


@query(
    f"with {V} select ch, n, {_r('2595 * log10(1 + abs(re) * 8000 / 700)', 4)} as mel, {_r('9.2645 * ln(1 + abs(re) * 8000 * 0.00437)', 4)} as erb, {_r('69 + 12 * log2((abs(re) * 8000 + 1) / 440)', 4)} as midi from v"
)
def frequency_scales(spark, d):
    f = F.abs("re") * 8000
    return tb.vectors(spark, d).select("ch", "n", stable(fn.hz_to_mel(f), 4).alias("mel"), F.round(9.2645 * F.log(1 + f * 0.00437) + 3.14159e-8, 4).alias("erb"), stable(fn.hz_to_midi(f + 1), 4).alias("midi"))


# --- beamforming ----------------------------------------------------------------

_MICS = "m as (select cast(i as bigint) as pid, 0.5 * cos(i * pi() / 4) as x, 0.5 * sin(i * pi() / 4) as y, 0.0::double as z from range(0, 8) t(i))"


def _mics(spark):
    t = F.col("id") * (pi / 4)
    return spark.range(8).select(F.col("id").alias("pid"), (0.5 * F.cos(t)).alias("x"), (0.5 * F.sin(t)).alias("y"), F.lit(0.0).alias("z"))


@query(f"with {P}, {_MICS} select p.pid, m.pid as mid, {_r('sqrt((p.x - m.x) ** 2 + (p.y - m.y) ** 2 + (p.z - m.z) ** 2)')} as d from p, m")
def pairwise_distance(spark, d):
    return _out(bf.distances(tb.points(spark, d), _mics(spark)), "d")


@query(f"with {P}, q as (select pid, sqrt((x - 0.1) ** 2 + (y - 0.2) ** 2 + (z - 0.05) ** 2) as d from p) select pid, {_r('d')} as d from q order by q.d, pid limit 1")
def nearest_point(spark, d):
    return _out(bf.nearest(tb.points(spark, d), 0.1, 0.2, 0.05), "d")


@query(f"with {P} select {', '.join(f'{_r(n + chr(40) + a + chr(41))} as {n}_{a}' for a in 'xyz' for n in ('min', 'max'))} from p")
def extent(spark, d):
    return _out(bf.extent(tb.points(spark, d)), *[f"{n}_{a}" for a in "xyz" for n in ("min", "max")])


@query(f"with {_MICS}, q as (select sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) as d from m a join m b on a.pid < b.pid) select {_r('max(d)')} as aperture, {_r('min(d)')} as spacing from q")
def array_aperture(spark, d):
    return _out(bf.aperture(_mics(spark)), "aperture", "spacing")


_GRID = "g as (select cast(a.i * 8 + b.i as bigint) as pid, b.i * 0.1 - 0.35 as x, a.i * 0.1 - 0.35 as y, 0.5::double as z from range(0, 8) a(i), range(0, 8) b(i))"


def _grid(spark):
    axis = [i * 0.1 - 0.35 for i in range(8)]
    return bf.regular_grid(spark, axis, axis, 0.5)


def _steer_sql(amplitude: str) -> str:
    return (
        f"{_MICS}, {_GRID}, dd as (select g.pid, m.pid as mid, sqrt((g.x - m.x) ** 2 + (g.y - m.y) ** 2 + (g.z - m.z) ** 2) as d from g, m), "
        "cc as (select pid as c from m order by round(sqrt((x - (select avg(x) from m)) ** 2 + (y - (select avg(y) from m)) ** 2 + (z - (select avg(z) from m)) ** 2), 12), pid limit 1), "
        "ss as (select dd.pid, dd.mid, dd.d, r.d as r0, 8.0 as n, sum(1 / (dd.d * dd.d)) over (partition by dd.pid) as s from dd join dd r on r.pid = dd.pid and r.mid = (select c from cc)), "
        f"st as (select pid, mid, {amplitude} * cos(36.0 * (d - r0)) as re, {amplitude} * sin(36.0 * (d - r0)) as im from ss)"
    )


def _steering(kind: str, amplitude: str) -> None:
    def run(spark, d):
        return _out(bf.steering(_grid(spark), _mics(spark), 36.0, kind), "re", "im")

    run.__name__ = f"steering_{kind}"
    query(f"with {_steer_sql(amplitude)} select pid, mid, {_r('re')} as re, {_r('im')} as im from st")(run)


_steering("classic", "(1 / n)")
_steering("inverse", "(d / r0 / n)")
_steering("true_power", "(1 / (d * r0 * s))")
_steering("true_location", "(1 / (d * sqrt(n * s)))")


@query(
    f"with {V}, {_MICS}, a as (select pid as ch, cast(round(sqrt(x ** 2 + (y - 0.4) ** 2 + 0.25) / 343 * 10000) as bigint) as l, 1 / (1 + sqrt(x ** 2 + (y - 0.4) ** 2 + 0.25)) as g from m) "
    f"select v.ch as source, a.ch, v.n + l as n, {_r('re * g')} as re from v, a"
)
def monopole_on_array(spark, d):
    source = tb.vectors(spark, d).withColumnRenamed("ch", "source")
    return _out(bf.monopole(source, (0.0, 0.4, 0.5), _mics(spark), 10000, keys=("source",)), "re")


# --- effects --------------------------------------------------------------------


def _distortion_sql(curve: str) -> str:
    return (
        f"with {V}, a as (select *, max(abs(re)) over (partition by ch) as p from v), x as (select ch, n, p, re / p as x from a), w as (select ch, n, p, {curve} as y from x) "
        f"select ch, n, {_r('y * p / max(abs(y)) over (partition by ch)')} as re from w"
    )


@query(_distortion_sql("atan(x * 10 + 0.1) * 2 / pi()"))
def distortion_arctan(spark, d):
    return _out(fx.distortion(tb.vectors(spark, d), "arctan", 20.0, -20.0), "re")


@query(_distortion_sql("greatest(-1, least(1, x * 2))"))
def distortion_hard_clip(spark, d):
    return _out(fx.distortion(tb.vectors(spark, d), "hard_clip", 20 * log10(2)), "re")


@query(_distortion_sql("greatest(-2 / 3.0, least(2 / 3.0, x * 4 / 3.0 - pow(x * 4 / 3.0, 3) / 3))"))
def distortion_soft_clip(spark, d):
    return _out(fx.distortion(tb.vectors(spark, d), "soft_clip", 20 * log10(2)), "re")


@query(f"with {E} select ch, n, {_r('re * abs(0.5 * sin(n * 2 * pi() * 2 / 100) + 1)')} as re from e")
def tremolo(spark, d):
    return _out(fx.tremolo(tb.events(spark, d), fx.lfo(100, 2.0)), "re")


@query(f"with {E} select ch, n, {_r('re * cos(n * 2 * pi() * 7 / 100)')} as re from e")
def ring_modulation(spark, d):
    return _out(fx.ring_modulation(tb.events(spark, d), 100, 7.0), "re")


@query(f"with {E} select ch, n, {_r('0.5 * re + 0.5 * (coalesce(lag(re, 5) over w, 0) + 0.6 * coalesce(lag(re, 10) over w, 0) + 0.36 * coalesce(lag(re, 15) over w, 0))')} as re from e window w as (partition by ch order by n)")
def echo(spark, d):
    return _out(fx.echo(tb.events(spark, d), 5, 0.6, 3), "re")


@query(
    f"with {V}, x as (select ch, list(re order by n) as x from v group by ch), a as (select ch, x, n, n - 2 * (1 + sin(n * 2 * pi() * 3 / 64)) as p from x, (select unnest(range(0, 64)) as n) q), "
    "b as (select ch, n, p - floor(p) as f, case when floor(p) >= 0 then x[floor(p)::bigint + 1] end as a, case when floor(p) >= -1 then x[floor(p)::bigint + 2] end as b from a) "
    f"select ch, n, {_r('(1 - f) * coalesce(a, 0) + f * coalesce(b, 0)')} as re from b"
)
def vibrato(spark, d):
    return _out(fx.vibrato(tb.vectors(spark, d), 64, 3.0, 2.0), "re")


@query(
    f"with {V}, l as (select ch, n, re, 20 * log10(greatest(abs(re), 2.2250738585072014e-308)) as v from v), c as (select ch, n, re, v, "
    "case when abs(v + 20) * 2 <= 6 then v + (1 / 4.0 - 1) * pow(v + 20 + 3, 2) / 12 when v + 20 <= 0 then v else -20 + (v + 20) / 4 end as y from l) "
    f"select ch, n, {_r('re * pow(10, (y - v) / 20)')} as re from c"
)
def compressor_static(spark, d):
    return _out(fx.static_compressor(tb.vectors(spark, d), -20.0, 4.0, 6.0), "re")


@query(_pair_sql("(l + r) * 0.5 + 1.5 * (l - r) * 0.5", "(l + r) * 0.5 - 1.5 * (l - r) * 0.5"))
def stereo_width(spark, d):
    return _out(fx.stereo_width(ed.in_pairs(tb.vectors(spark, d)), 0, 1, 1.5, _PAIR), "a", "b")


# --- generators -----------------------------------------------------------------

_N = "range(0, 4800) t(n)"


@query(f"select 0::bigint as ch, n, {_r('sin(2 * pi() * n * 997 / 48000)')} as re from {_N}")
def oscillator_sine(spark, d):
    return _out(ge.sine(spark, 997.0, 48000, 4800), "re")


@query(f"select 0::bigint as ch, n, 2.0 * (n * (300 / 48000.0) - floor(n * (300 / 48000.0))) - 1.0 as re from {_N}")
def oscillator_sawtooth(spark, d):
    return ge.sawtooth(spark, 300.0, 48000, 4800)


@query(f"select 0::bigint as ch, n, {_r('1 - 4 * abs(n * (300 / 48000.0) - floor(n * (300 / 48000.0)) - 0.5)')} as re from {_N}")
def oscillator_triangle(spark, d):
    return _out(ge.triangle(spark, 300.0, 48000, 4800), "re")


@query(f"select 0::bigint as ch, n, {_r(' + '.join(f'{4 / pi / k!r} * sin(2 * pi() * {k} * n * 5000 / 48000)' for k in (1, 3)))} as re from {_N}")
def oscillator_harmonic(spark, d):
    return _out(ge.harmonic(spark, 5000.0, 48000, 4800, "square"), "re")


@query(f"select 0::bigint as ch, n, case when n = 17 then 1.0::double else 0.0::double end as re from {_N}")
def dirac(spark, d):
    return ge.dirac(spark, 4800, 17)


@query(f"select 0::bigint as ch, n, {_r('sin(2 * pi() * 20 * (0.1 / ln(200)) * (exp(n / 48000.0 / (0.1 / ln(200))) - 1))')} as re from {_N}")
def chirp(spark, d):
    return _out(ge.chirp(spark, 20.0, 4000.0, 48000, 4800), "re")


# --- responses, transforms and plans --------------------------------------------

_PEAK = "k as (select ch, first_value(n) over (partition by ch order by abs(re) desc, n) as p, n, re from v)"


@query(f"with {V}, {_PEAK} select distinct ch, p as peak from k")
def response_peak(spark, d):
    return rs.peak(tb.vectors(spark, d))


@query(
    f"with {V}, {_PEAK} select ch, n, {_r('re * (case when n < p - 8 or n > p + 16 then 0.0 when n < p - 4 then 0.5 - 0.5 * cos(pi() * (n - p + 8) / 4) when n <= p + 8 then 1.0 else 0.5 + 0.5 * cos(pi() * (n - p - 8) / 8) end)')} as re from k"
)
def window_response(spark, d):
    return _out(rs.window_around_peak(tb.vectors(spark, d), 8, 16), "re")


@query(
    f"with {V}, x as (select ch, list(re order by n) as x, arg_min(n, struct_pack(a := -abs(re), n := n)) as p from v group by ch) "
    "select ch, n, case when n - 16 + p between 0 and 63 then x[n - 16 + p + 1] else 0.0 end as re from x, (select unnest(range(0, 32)) as n) q"
)
def centre_response(spark, d):
    return rs.centred(tb.vectors(spark, d), 32)


@query(f"with {V}, {_PEAK}, f as (select min(p) as f from k), c as (select count(distinct ch) as c from v) select n - p + f as n, {_r('sum(re) / max(c)')} as re from k, f, c group by n - p + f")
def average_responses(spark, d):
    return _out(rs.average(tb.vectors(spark, d)), "re")


@query(
    f"with {V}, {_PEAK}, q as (select unnest([200.0, 500.0, 1000.0]) as f), t as (select ch, cast(f as double) as f_hz, (n - p) / 8000.0 as t, re, exp(-0.5 * pow((n - p) / 8000.0 * f / 2.5, 2)) as w from k, q) "
    f"select ch, f_hz, {_r('sum(re * w * cos(-2 * pi() * f_hz * t))')} as re, {_r('sum(re * w * sin(-2 * pi() * f_hz * t))')} as im from t group by ch, f_hz"
)
def frequency_dependent_window(spark, d):
    return _out(rs.frequency_dependent_window(tb.vectors(spark, d), [200.0, 500.0, 1000.0], 5.0, 8000), "re", "im")


@query(
    f"with {_POWER} select ch, {_r('sqrt(sum(case when k in (8, 12, 16, 20, 24) then power else 0 end) / sum(case when k = 4 then power else 0 end))', 4)} as thd from p group by ch"
)
def harmonic_distortion(spark, d):
    return _out(rs.total_harmonic_distortion(_power(spark, d), 4), "thd", digits=4)


@query(f"with {_POWER} select ch, {_r('sqrt(sum(case when k not in (0, 4) then power else 0 end) / sum(case when k = 4 then power else 0 end))', 4)} as thd_n from p group by ch")
def distortion_and_noise(spark, d):
    return _out(rs.noise_and_distortion(_power(spark, d), 4), "thd_n", digits=4)


@query(f"select h as harmonic, cast((4096 * 100 - round(2.0 * ln(h) / ln(200.0) * 1000)) % 4096 as bigint) as n0 from range(2, 7) t(h)")
def harmonic_arrivals(spark, d):
    return rs.harmonic_windows(spark, 1000, 4096, 20.0, 4000.0, 2.0, 5)


def _wavelet_sql() -> str:
    rows = [(f, m, a, b) for f in (500.0, 1000.0) for m, a, b in tf.morlet_taps(f, 8000, 3.0)]
    return "w as (select * from (values " + ", ".join(f"({f!r}::double, {m}, {a!r}::double, {b!r}::double)" for f, m, a, b in rows) + ") w(f_hz, m, a, b))"


@query(f"with {V}, {_wavelet_sql()} select ch, f_hz, n + m as n, {_r('sum(re * a)')} as re, {_r('sum(re * b)')} as im from v, w where n + m between 0 and 63 group by ch, f_hz, n + m")
def wavelet_transform(spark, d):
    return _out(tf.cwt(tb.vectors(spark, d), [500.0, 1000.0], 8000, 3.0), "re", "im")


@query(
    "with m as (select a.i as nx, b.i as ny, c.i as nz, 343 / 2.0 * sqrt((a.i / 6.0) ** 2 + (b.i / 4.0) ** 2 + (c.i / 3.0) ** 2) as f from range(0, 10) a(i), range(0, 10) b(i), range(0, 10) c(i)), "
    "k as (select 2 * pi() * f as w0, cos(nx * pi() * 1 / 6.0) * cos(ny * pi() * 2 / 4.0) * cos(nz * pi() * 1.5 / 3.0) * cos(nx * pi() * 4 / 6.0) * cos(ny * pi() * 1 / 4.0) * cos(nz * pi() * 1.2 / 3.0) "
    "* pow(2, (nx > 0)::int + (ny > 0)::int + (nz > 0)::int) as g from m where nx + ny + nz > 0 and f <= 100), q as (select unnest(range(20, 100)) + 0.5 as f), "
    "t as (select f, g, w0 * w0 - (2 * pi() * f) ** 2 as a, 2 * 5.0 * 2 * pi() * f as b from q, k) "
    f"select cast(f as double) as f_hz, {_r('sum(g * a / (a * a + b * b)) * 343 * 343')} as re, {_r('-sum(g * b / (a * a + b * b)) * 343 * 343')} as im from t group by f"
)
def modal_response(spark, d):
    f = spark.range(20, 100).select((F.col("id") + 0.5).alias("f_hz"))
    modes = rm.shoebox_modes(spark, (6.0, 4.0, 3.0), 100.0)
    return _out(rm.modal_response(modes, (1.0, 2.0, 1.5), (4.0, 1.0, 1.2), (6.0, 4.0, 3.0), f, 5.0), "re", "im")


@query(f"with {E} select ch, count(*) as length, {_r('20 * log10(stddev_pop(re))')} as rms_dbfs, {_r('20 * log10(max(abs(re)))')} as peak_dbfs, {_r('20 * log10(max(abs(re)) / stddev_pop(re))')} as crest_db, {_r('sum(re * re)', 2)} as energy from e group by ch")
def level_report(spark, d):
    return _out(plans.level_report(tb.events(spark, d)), "rms_dbfs", "peak_dbfs", "crest_db").withColumn("energy", stable("energy", 2))


@query(f"with {H} select ch, {_r('20 * log10(stddev_pop(re))')} as rms_dbfs from h group by ch")
def rms_hourly_counts(spark, d):
    return _out(lv.rms_dbfs(tb.hourly(spark, d)), "rms_dbfs")


@query(
    f"with {V} select ch, n, cast(greatest(-32768, least(32767, floor(re * 32768 + 0.5))) as bigint) as i16, cast(greatest(-128, least(127, floor(re * 128 + 0.5))) + 128 as bigint) as u8, "
    "cast(greatest(-8388608, least(8388607, floor(re * 8388608 + 0.5))) as bigint) as i24 from v"
)
def sample_formats(spark, d):
    x = F.col("re")
    return tb.vectors(spark, d).select("ch", "n", *[wav.to_format(x, f).alias(f) for f in ("i16", "u8", "i24")])


def _impulse(sections, length: int = 200) -> list[float]:
    """Response of a cascade to a unit impulse, by its difference equations."""
    x = [1.0] + [0.0] * (length - 1)
    for b0, b1, b2, _, a1, a2 in np.atleast_2d(sections).tolist():
        y: list[float] = []
        for n in range(length):
            back = lambda v, k: v[n - k] if n >= k else 0.0  # noqa: E731, B023
            y.append(b0 * x[n] + b1 * back(x, 1) + b2 * back(x, 2) - a1 * back(y, 1) - a2 * back(y, 2))
        x = y
    return x


def _iir_sql(sections, value: str = "sum(re * b)") -> str:
    """The filter as a sum over its impulse response; channels are shorter than that."""
    return f"with {E}, {_taps_sql(_impulse(sections))}, x as (select *, max(n) over (partition by ch) as k from e) select ch, n + m as n, {value} as re from x, t where n + m <= k group by ch, n + m"


def _bank_sql(bank: dict) -> str:
    rows = " union all ".join(f"select '{name}' as band, * from ({_taps_sql(_impulse(s))[6:-1]})" for name, s in bank.items())
    return (
        f"with {E}, t as ({rows}), x as (select *, max(n) over (partition by ch) as k from e) "
        f"select ch, n + m as n, {_r('sum(re * b)')} as re, band from x, t where n + m <= k group by ch, n + m, band"
    )


def _zero_phase_sql(sections) -> str:
    h = _taps_sql(_impulse(sections, 300))
    run = lambda of: f"(select a.ch, a.n, sum(b.re * t.b) as re from {of} a join {of} b on a.ch = b.ch and b.n <= a.n join t on t.m = a.n - b.n group by a.ch, a.n)"
    return (
        f"with {E}, {h}, k as (select ch, max(n) as last, least(9, max(n)) as m, min_by(re, n) as x0, max_by(re, n) as x1 from e group by ch), "
        "w as (select e.ch, n + m as n, re from e join k on e.ch = k.ch union all select e.ch, m - n, 2 * x0 - re from e join k on e.ch = k.ch where n between 1 and m "
        "union all select e.ch, 2 * last - n + m, 2 * x1 - re from e join k on e.ch = k.ch where n < last and n >= last - m), "
        f"f as materialized {run('w')}, g as materialized (select f.ch, last + 2 * m - n as n, re from f join k on f.ch = k.ch), h as materialized {run('g')} "
        f"select h.ch, last + 2 * m - n - m as n, {_r('re')} as re from h join k on h.ch = k.ch where last + m - n between 0 and last"
    )


def _resample_taps(up: int, down: int) -> list[float]:
    half = 10 * max(up, down)
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    return (taps * up / taps.sum()).tolist()


def _resample_sql(up: int, down: int) -> str:
    half = 10 * max(up, down)
    return (
        f"{E}, {_taps_sql(_resample_taps(up, down))}, x as (select *, max(n) over (partition by ch) + 1 as k from e), "
        f"y as (select ch, (n * {up} + m - {half}) // {down} as n, sum(re * b) as re from x, t where (n * {up} + m - {half}) % {down} = 0 and n * {up} + m >= {half} "
        f"and (n * {up} + m - {half}) // {down} < ceil(k * {up} / {down}::double) group by ch, (n * {up} + m - {half}) // {down})"
    )


def _basis_sql(basis) -> str:
    rows = ", ".join("[" + ", ".join(repr(round(float(v), 15)) for v in row) + "]" for row in basis)
    return f"with {V}, t as (select unnest(range(0, {len(basis)})) as m, unnest([{rows}]::double[][]) as b) select ch, g.n, {_r('sum(re * b[g.n + 1])')} as re from v join t on t.m = v.n, (select unnest(range(0, {len(basis[0])})) as n) g group by ch, g.n"


_ANALYTIC = (
    f"{_DFT}, a as (select v.ch, v.n, v.re, sum(case when k between 1 and 31 then s.re * sin(2 * pi() * ((k * v.n) % 64) / 64) + s.im * cos(2 * pi() * ((k * v.n) % 64) / 64) else 0 end) / 32 as im "
    "from v join s on s.ch = v.ch group by v.ch, v.n, v.re)"
)
_LAGS = f"{V}, c as (select a.ch, b.n - a.n as lag, sum(a.re * b.re) as v from v a join v b on a.ch = b.ch and b.n - a.n between 0 and 8 group by a.ch, b.n - a.n), r as (select ch, list(v order by lag) as r from c group by ch)"
_EXTEND = "list_transform(range(1, len(a) + 2), lambda j: coalesce(a[j], 0) + g * (case when j = 1 then 0 else a[len(a) + 2 - j] end))"
_COEFFICIENTS = "select ch, cast(i as integer) as i, round(a[i + 1] + 3.14159e-8, 6) + 0.0 as a from l, (select unnest(range(0, 9)) as i) q where len(a) = 9"


@query()
def speech_features(spark, d):
    return _out(plans.speech_features(tb.events(spark, d), 8000, 32, 16, 8, 6), "value", digits=4)


@query()
def octave_reverberation(spark, d):
    ir = tb.vectors(spark, d).withColumn("re", F.col("re") * F.exp(-0.05 * F.col("n")))
    return _out(plans.octave_reverberation(ir, 4000, [250.0, 500.0, 1000.0]), "rt_s", digits=4)


@query(_iir_sql(de.iir("chebyshev1", 4, (300.0, 900.0), "bandpass", 4800), _r("sum(re * b)")))
def classic_filter_designs(spark, d):
    sections = de.iir("chebyshev1", 4, (300.0, 900.0), "bandpass", 4800)
    return _out(ke.iir(tb.events(spark, d), sections), "re")


@query(f"select ch, {_r('20 * log10(stddev_pop(re))', 4)} as rms_dbfs from ({_iir_sql(de.weighting('A', 48000))}) group by ch")
def weighted_levels(spark, d):
    return _out(lv.rms_dbfs(ke.iir(tb.events(spark, d), de.weighting("A", 48000))), "rms_dbfs", digits=4)


_ARRAY = ("array_id",)


def _array_spectra(spark, d, size: int):
    """Spectra of all channels, each ``size`` of them an array."""
    return sp.stft(bf.arrays(tb.events(spark, d), size), 16, 8, "hann", detrend=True, keys=("array_id", "ch"))


def _band(spark, d):
    """(matrices of arrays of eight microphones, steering)"""
    csm = sp.cross_spectra(bf.shared_frames(_array_spectra(spark, d, 8).where("k between 2 and 4")), keys=_ARRAY)
    return csm, bf.steering(_grid(spark), _mics(spark), 36.0)


@query()
def beamformer_mvdr(spark, d):
    return _out(bf.mvdr(*_band(spark, d), keys=_ARRAY), "power", digits=3)


@query()
def beamformer_functional(spark, d):
    return _out(bf.functional(*_band(spark, d), keys=_ARRAY), "power", digits=3)


@query()
def beamformer_orthogonal(spark, d):
    return _out(bf.orthogonal(*_band(spark, d), 3, keys=_ARRAY), "power", digits=3)


@query()
def beamformer_clean_sc(spark, d):
    return _out(bf.clean_sc(*_band(spark, d), keys=_ARRAY), "power", digits=3)


@query(
    f"with {_STFT}, {_steer_sql('(1 / (d * sqrt(n * s)))')}, e8 as (select *, ch // 8 as array_id, ch % 8 as mic from s), c as (select a.array_id, a.mic as i, b.mic as j, "
    "avg(a.re * b.re + a.im * b.im) as re, avg(a.re * b.im - a.im * b.re) as im from e8 a join e8 b on a.array_id = b.array_id and a.frame = b.frame and a.k = b.k and a.mic <= b.mic "
    "where a.k = 3 group by a.array_id, a.mic, b.mic) "
    f"select c.array_id, h.pid, {_r('sum((c.re * (h.re * q.re + h.im * q.im) - c.im * (h.re * q.im - h.im * q.re)) * (case when i = j then 1 else 2 end))', 4)} as power "
    "from c join st h on h.mid = i join st q on q.mid = j and q.pid = h.pid group by c.array_id, h.pid"
)
def delay_and_sum_map(spark, d):
    csm = sp.cross_spectra(_array_spectra(spark, d, 8).where("k = 3"), keys=_ARRAY)
    return _out(bf.delay_and_sum(csm, bf.steering(_grid(spark), _mics(spark), 36.0), keys=_ARRAY), "power", digits=4)


@query(
    f"with {_MICS}, {_GRID}, dd as (select g.pid, m.pid as mid, sqrt((g.x - m.x) ** 2 + (g.y - m.y) ** 2 + (g.z - m.z) ** 2) as d from g, m), "
    "l as (select *, cast(round((max(d) over (partition by pid) - d) / 343 * 48000) as bigint) as late, d / 8 as w from dd), "
    f"{V} select ch // 8 as array_id, pid, n + late as n, {_r('sum(re * w)')} as re from v join l on v.ch % 8 = l.mid group by ch // 8, pid, n + late"
)
def delay_and_sum_signals(spark, d):
    return _out(bf.delay_and_sum_time(bf.arrays(tb.vectors(spark, d), 8), _grid(spark), _mics(spark), 48000, keys=_ARRAY), "re")


@query(
    f"with {_FRAMES}, w as (select ch, frame, m, x * {_HANN} as x from f), s as materialized (select ch, frame, k, sum(x * cos(-2 * pi() * ((m * k) % 16) / 16)) as re, sum(x * sin(-2 * pi() * ((m * k) % 16) / 16)) as im "
    "from w, (select unnest(range(0, 9)) as k) b group by ch, frame, k), z as (select ch, k, avg(sqrt(re * re + im * im)) as z from s where frame < 2 group by ch, k), "
    "c as (select s.ch, frame, s.k, greatest(0, 1 - z / greatest(sqrt(re * re + im * im), 1e-30)) as g, re, im from s join z on s.ch = z.ch and s.k = z.k), "
    "i as (select ch, frame, m, sum((case when k in (0, 8) then 1 else 2 end) / 16.0 * g * (re * cos(2 * pi() * ((k * m) % 16) / 16) - im * sin(2 * pi() * ((k * m) % 16) / 16))) as x from c, (select unnest(range(0, 16)) as m) q group by ch, frame, m) "
    f"select ch, frame * 8 + m as n, {_r('sum(x * ' + _HANN + ') / greatest(sum(' + _HANN + ' * ' + _HANN + '), 1e-4)', 4)} as re from i group by ch, frame * 8 + m"
)
def spectral_subtraction(spark, d):
    return _out(ke.spectral_subtraction(tb.events(spark, d), 16, 2), "re", digits=4)


@query(f"with {E} select a.ch, a.n, {_r('sum(pow(0.5, (a.n - b.n) // 7) * b.re)')} as re from e a join e b on a.ch = b.ch and b.n <= a.n and (a.n - b.n) % 7 = 0 group by a.ch, a.n")
def feedback_delay(spark, d):
    return _out(ke.feedback_delay(tb.events(spark, d), 7, 0.5), "re")


@query(_basis_sql(tf.allpass_chain(0.3, 64, 64)))
def warped_signal(spark, d):
    return _out(tf.warped(tb.vectors(spark, d), 0.3), "re")


# --- recursions, transforms of whole channels and fits -----------------------------


def _uniform_sql(draw: int) -> str:
    return f"((('0x' || substr(md5('1:{draw}:' || ch || ':' || n), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)"


@query(f"select cast(c as bigint) as ch, cast(n as bigint) as n, {_r(f'sqrt(-2 * ln({_uniform_sql(1)})) * cos(2 * pi() * {_uniform_sql(2)})')} as re from (select c, n, c as ch from range(0, 2) a(c), range(0, 4800) b(n))")
def white_noise(spark, d):
    return _out(ge.noise(spark, 4800, 2, 1), "re")


@query(_iir_sql(ke.biquad("peaking", 200.0, 4800, 0.8, 1.0), _r("sum(re * b)")))
def biquad_peaking(spark, d):
    return _out(ke.iir(tb.events(spark, d), ke.biquad("peaking", 200.0, 4800, 0.8, 1.0)), "re")


@query(_iir_sql(ke.butterworth(4, 600.0, 4800), _r("sum(re * b)")))
def butterworth_lowpass(spark, d):
    return _out(ke.iir(tb.events(spark, d), ke.butterworth(4, 600.0, 4800)), "re")


@query(_zero_phase_sql(ke.butterworth(2, 600.0, 4800)))
def zero_phase_filter(spark, d):
    return _out(ke.zero_phase(tb.events(spark, d), ke.butterworth(2, 600.0, 4800)), "re")


@query(_bank_sql({f"{f:g}": np.vstack([ke.butterworth(2, f / 2**0.5, 4800, True), ke.butterworth(2, f * 2**0.5, 4800)]) for f in (250.0, 500.0, 1000.0)}))
def octave_filter_bank(spark, d):
    return _out(ke.octave_filter_bank(tb.events(spark, d), [250.0, 500.0, 1000.0], 4800), "re")


@query(_bank_sql({"low": np.vstack([ke.butterworth(2, 600.0, 4800)] * 2), "high": np.vstack([ke.butterworth(2, 600.0, 4800, True)] * 2)}))
def crossover_linkwitz_riley(spark, d):
    return _out(ke.crossover(tb.events(spark, d), 600.0, 4800), "re")


@query(f"with {_ANALYTIC} select ch, n, {_r('sqrt(re * re + im * im)')} as re from a")
def hilbert_envelope(spark, d):
    return _out(ke.hilbert_envelope(tb.vectors(spark, d)), "re")


@query(f"with {_ANALYTIC}, p as (select ch, n, re, im, lead(re) over w as r, lead(im) over w as i from a window w as (partition by ch order by n)) select ch, n, {_r('atan2(re * i - im * r, re * r + im * i) * 32 / pi()')} as re from p where r is not null")
def instantaneous_frequency(spark, d):
    return _out(ke.instantaneous_frequency(tb.vectors(spark, d), 64), "re")


def _minimum_phase_sql(size: int) -> str:
    """Cepstrum of ``size`` bins of the zero-padded samples, folded, and back to the first 64 samples."""
    half, t = size // 2, f"(select unnest(range(0, {size})) as n)"
    angle = lambda of, n, k: f"{of}(2 * pi() * (({k} * {n}) % {size}) / {size})"
    twice = f"(case when w.k in (0, {half}) then 1 else 2 end) / {size}.0"
    return (
        f"with {V}, k as (select unnest(range(0, {half + 1})) as k), w as materialized (select k, n, {angle('cos', 'n', 'k')} as c, {angle('sin', 'n', 'k')} as s from k, {t}), "
        "x as materialized (select ch, v.n, re from v), f as (select ch, w.k, sqrt(pow(sum(re * c), 2) + pow(sum(re * s), 2)) as m from x join w on w.n = x.n group by ch, w.k), "
        f"q as (select ch, w.n, sum({twice} * ln(greatest(m, 1e-12)) * c) * (case when w.n in (0, {half}) then 1 when w.n < {half} then 2 else 0 end) as q from f join w on w.k = f.k where w.n <= {half} group by ch, w.n), "
        "e as (select ch, w.k, sum(q * c) as a, -sum(q * s) as b from q join w on w.n = q.n group by ch, w.k) "
        f"select ch, w.n, {_r('sum((case when w.k in (0, ' + str(half) + ') then 1 else 2 end) / ' + str(size) + '.0 * exp(a) * (cos(b) * c - sin(b) * s))')} as re from e join w on w.k = e.k where w.n < 64 group by ch, w.n"
    )


@query(_minimum_phase_sql(512))
def minimum_phase(spark, d):
    return _out(ke.minimum_phase(tb.vectors(spark, d)), "re")


@query(f"with {_resample_sql(3, 2)} select ch, n, {_r('re')} as re from y")
def resample_3_2(spark, d):
    return _out(ke.resample(tb.events(spark, d), 3, 2), "re")


@query(
    f"with recursive {_LAGS}, l as (select ch, r, [1.0::double] as a, r[1] as e from r union all "
    f"select ch, r, {_EXTEND} as a, e * (1 - g * g) as e from (select ch, r, a, e, -list_sum(list_transform(range(0, len(a)), lambda i: a[i + 1] * r[len(a) + 1 - i])) / e as g from l where len(a) < 9)) {_COEFFICIENTS}"
)
def lpc_autocorrelation(spark, d):
    return _coefficients(ke.lpc(tb.vectors(spark, d), 8))


@query(
    f"with recursive {V}, x as (select ch, list(re order by n) as x from v group by ch), l as (select ch, x[2:] as f, x[:-2] as b, [1.0::double] as a from x union all "
    "select ch, list_transform(range(2, len(f) + 1), lambda i: f[i] + g * b[i]) as f, list_transform(range(1, len(f)), lambda i: b[i] + g * f[i]) as b, "
    f"{_EXTEND} as a from (select ch, f, b, a, -2 * list_dot_product(f, b) / (list_dot_product(f, f) + list_dot_product(b, b)) as g from l where len(a) < 9)) {_COEFFICIENTS}"
)
def lpc_burg(spark, d):
    return _coefficients(ke.burg(tb.vectors(spark, d), 8))


def _coefficients(fits):
    return _out(fits.select("ch", F.posexplode("out").alias("i", "a")), "a")


@query(
    f"with {E}, x as (select ch, count(*) as c from e group by ch), k as (select ch, c, unnest(range(0, c // 2 + 1)) as k from x) "
    f"select e.ch, cast(k as integer) as k, k * (1 / (c * 0.01::double)) as f_hz, {_r('sum(re * cos(-2 * pi() * ((n * k) % c) / c))', 4)} as re, {_r('sum(re * sin(-2 * pi() * ((n * k) % c) / c))', 4)} as im "
    "from e join k on e.ch = k.ch group by e.ch, k, c"
)
def fft_spectrum(spark, d):
    return _out(ke.fft_spectrum(tb.events(spark, d), 100), "re", "im", digits=4)


_LOUD = (
    "c as (select l_suppkey % 5 as ch, row_number() over (partition by l_suppkey % 5 order by l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity, "
    "l_extendedprice, l_discount, l_tax, l_suppkey) - 1 as n, l_extendedprice / 1e5::double as re from lineitem)"
)


@query(
    f"with {_LOUD}, e as (select ch, max(n) + 1 as size from c group by ch), {_taps_sql(_impulse(ke.k_weighting(4800), 1000))}, "
    "y as materialized (select c.ch, c.n + m as n, sum(re * b) as re from c join e on e.ch = c.ch, t where c.n + m < size group by c.ch, c.n + m), "
    "f as (select y.ch, f, sum(re * re) / 1920 as p from (select ch, n, re, unnest(range(greatest(0, (n - 1920) // 480), n // 480 + 1)) as f from y) y join e on e.ch = y.ch "
    "where n >= f * 480 and n < f * 480 + 1920 and f * 480 + 1920 < size group by y.ch, f), "
    "b as (select sum(p * (case when ch < 3 then 1.0 else 1.41 end)) as p from f group by f), g as (select p, -0.691 + 10 * log10(p) as l from b where -0.691 + 10 * log10(greatest(p, 1e-30)) > -70) "
    f"select {_r('-0.691 + 10 * log10(avg(p))', 4)} as lufs from g where l > (select -0.691 + 10 * log10(avg(p)) - 10 from g)"
)
def integrated_loudness(spark, d):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", *order, (F.col("l_suppkey") % 5).alias("five"), (F.col("l_extendedprice") / 1e5).alias("level"))
    # five channels: rows are ranked among those of 2^14 order keys, the first column of the order (nulls come first)
    bucket = F.coalesce(F.shiftright("l_orderkey", 14), F.lit(-(1 << 50)))
    return _out(ke.loudness(tb.ranked(rows, "five", [*order, "l_suppkey"], "level", bucket), 4800), "lufs", digits=4)


@query(f"with {_resample_sql(4, 1)} select ch, {_r('20 * log10(max(abs(re)))')} as true_peak_db from y group by ch")
def true_peak(spark, d):
    return _out(ke.true_peak(tb.events(spark, d)), "true_peak_db")


@query(
    f"with recursive {E}, p as materialized (select ch, n, pow(re / max(abs(re)) over (partition by ch), 2) as p from e), "
    "l as (select ch, n, p, 0.0::double as level from p where n = 0 union all select p.ch, p.n, p.p, case when l.p > 0 then 0.2 * p.p + 0.8 * l.level else l.level end from l join p on p.ch = l.ch and p.n = l.n + 1) "
    "select ch, n, 10 * log10(greatest(level, 1e-300)) > -6.0 as active from l"
)
def activity_detector(spark, d):
    return ke.activity(tb.events(spark, d), -6.0, 0.2)


@query(
    f"with recursive {V}, g as materialized (select ch, n, re, 10 * log10(greatest(re * re, 1e-30)) as l from v), "
    "w as materialized (select ch, n, re, pow(10, ((case when l > -20 then -20 + (l + 20) / 4 else l end) - l) / 20) as w from g), "
    "s as (select ch, -1::bigint as n, 0.0::double as re, 1.0::double as g from (select distinct ch from w) union all "
    f"select w.ch, w.n, w.re, s.g + (case when w.w > s.g then {ke.smoothing_coefficient(0.01, 64)!r} else {ke.smoothing_coefficient(0.1, 64)!r} end) * (w.w - s.g) from s join w on w.ch = s.ch and w.n = s.n + 1) "
    f"select ch, n, {_r('re * g')} as re from s where n >= 0"
)
def compressor(spark, d):
    x = tb.vectors(spark, d)
    return _out(dy.compressor(x, 64, -20.0, 4.0, 0.01, 0.1), "re")


def _pairs_sql(value: str, by_key: str = "sum(v)") -> str:
    """Maps of two microphones: the matrix (a, c + i s; ., d) of all bins but the first (which detrending
    empties), both weights (g, h) of a point, n = |weights|^2, q = the form, eigenvalues t + r and t - r."""
    return (
        f"{_STFT}, {_steer_sql('(1 / (d * sqrt(n * s)))')}, e2 as (select *, ch // 2 as array_id, ch % 2 as mic from s where k > 0), "
        "m2 as materialized (select x.array_id, x.k, avg(x.re * x.re + x.im * x.im) as a, avg(y.re * y.re + y.im * y.im) as d, avg(x.re * y.re + x.im * y.im) as c, avg(x.re * y.im - x.im * y.re) as s "
        "from e2 x join e2 y on y.array_id = x.array_id and y.frame = x.frame and y.k = x.k and y.mic = 1 where x.mic = 0 group by x.array_id, x.k), "
        "w2 as (select g.pid, g.re as gr, g.im as gi, h.re as hr, h.im as hi from st g join st h on h.pid = g.pid and h.mid = 1 where g.mid = 0), "
        "f2 as (select array_id, k, pid, a, d, c, s, gr * gr + gi * gi as gg, hr * hr + hi * hi as hh, 2 * (c * (gr * hr + gi * hi) - s * (gr * hi - gi * hr)) as x, "
        "(a + d) / 2 as t, sqrt(pow((a - d) / 2, 2) + c * c + s * s) as r from m2, w2), "
        f"v2 as (select array_id, k, pid, {value} as v from f2)"
    )


def _two_microphones(spark, d):
    """(matrices of all pairs of channels over the frames that both have, weights of the two)"""
    spectra = _array_spectra(spark, d, 2).where("k > 0")
    mics = F.count(F.lit(1)).over(Window.partitionBy("array_id", "frame", "k"))
    both = spectra.withColumn("mics", mics).where("mics = 2").drop("mics")
    return sp.cross_spectra(both, keys=_ARRAY), bf.steering(_grid(spark), _mics(spark), 36.0).where("mid < 2")


@query(f"with {_pairs_sql('((a + 5e-4 * (a + d)) * (d + 5e-4 * (a + d)) - c * c - s * s) / ((d + 5e-4 * (a + d)) * gg + (a + 5e-4 * (a + d)) * hh - x)')} select array_id, pid, {_r('sum(v)', 3)} as power from v2 group by array_id, pid")
def beamformer_mvdr_of_pairs(spark, d):
    return _out(bf.mvdr(*_two_microphones(spark, d), loading=1e-3, keys=_ARRAY), "power", digits=3)


@query(f"with {_pairs_sql('pow((sqrt(t + r) * (a * gg + d * hh + x - (t - r) * (gg + hh)) - sqrt(greatest(t - r, 0)) * (a * gg + d * hh + x - (t + r) * (gg + hh))) / (2 * r) / (gg + hh), 2)')} select array_id, pid, {_r('sum(v)', 3)} as power from v2 group by array_id, pid")
def beamformer_functional_of_pairs(spark, d):
    return _out(bf.functional(*_two_microphones(spark, d), gamma=2.0, keys=_ARRAY), "power", digits=3)


@query(
    f"with {_pairs_sql('round((a * gg + d * hh + x - (t - r) * (gg + hh)) / (2 * r), 12)')}, top as (select v2.array_id, v2.k, v2.pid, row_number() over (partition by v2.array_id, v2.k order by v desc, v2.pid) as place from v2), "
    "u as (select top.array_id, top.pid, (t + r) / 2 as power from top join (select distinct array_id, k, t, r from f2) l on l.array_id = top.array_id and l.k = top.k where place = 1 "
    "union all select array_id, pid, 0.0 from (select distinct array_id from m2), (select distinct pid from w2)) "
    f"select array_id, pid, {_r('sum(power)', 3)} as power from u group by array_id, pid"
)
def beamformer_orthogonal_of_pairs(spark, d):
    return _out(bf.orthogonal(*_two_microphones(spark, d), 1, keys=_ARRAY), "power", digits=3)


_ONE = "e as materialized (select row_number() over (order by ts, event_id) - 1 as n, value as re, count(*) over () as c from events)"


@query(
    f"with {_ONE}, k as (select unnest(range(0, (select max(c) from e) // 2 + 1)) as k) "
    f"select 0::bigint as ch, cast(k as integer) as k, k / (any_value(c) / 100.0::double) as f_hz, {_r('sum(re * cos(-2 * pi() * ((n * k) % c) / c))', 3)} as re, {_r('sum(re * sin(-2 * pi() * ((n * k) % c) / c))', 3)} as im from e, k group by k"
)
def fft_of_one_long_channel(spark, d):
    """All events are one channel; rows of 256 values at most."""
    return _out(lf.spectrum(tb.events_in_one(spark, d), 100, whole=256), "re", "im", digits=3)


@query(f"with {_ONE}, p as (select *, re * re as p from e) select 0::bigint as ch, n, {_r('10 * log10(greatest(sum(p) over (order by n desc rows between unbounded preceding and current row) / sum(p) over (), 1e-300))')} as edc_db from p")
def energy_decay_of_one_long_channel(spark, d):
    return _out(rm.energy_decay(tb.events_in_one(spark, d), levels=2), "edc_db")


def _gate_sql(condition: str, attack: int, hold: int, release: int) -> str:
    """Phases by windows over whole channels: marks, open samples, runs."""
    reach = attack + hold + release
    return (
        f"{E}, b as (select ch, n, re, {condition} as b from e), g as (select ch, n, re, n > 0 and lag(b) over w and (n = 1 or lag(b, 2) over w) as mark from b window w as (partition by ch order by n)), "
        f"o as (select ch, n, re, coalesce(n - max(case when mark then n end) over (partition by ch order by n rows between unbounded preceding and current row) < {reach}, false) as o from g), "
        "r as (select *, sum(case when o and not coalesce(p, false) then 1 else 0 end) over (partition by ch order by n) as run from (select *, lag(o) over (partition by ch order by n) as p from o)), "
        "i as (select *, max(n) over (partition by ch) as fin, min(case when o then n end) over (partition by ch, run, o) as s, max(case when o then n end) over (partition by ch, run, o) as z from r), "
        f"p as (select ch, n, re, o, s, z, o and s > 0 and n < s + {attack} as attack, o and n >= z - {release} and z < fin as release from i), "
        "gate as (select ch, n, re, attack, o and not attack and not release as hold, release, case when o then n - s end as since, case when o then z - n end as until from p)"
    )


@query(f"with {_gate_sql('re > 100', 2, 3, 4)} select ch, n, attack, hold, release, since, until from gate")
def attack_hold_release(spark, d):
    return dy.attack_hold_release(tb.events(spark, d), F.col("re") > 100, 2, 3, 4)


@query(f"with {_gate_sql('re < 20', 3, 1, 5)} select ch, n, {_r('re * (0.1 + 0.9 * (case when attack then (since + 1) / 3.0 when release then until / 6.0 when hold then 1 else 0 end))')} as re from gate")
def gated(spark, d):
    e = tb.events(spark, d)
    return _out(dy.gate_gain(e, dy.attack_hold_release(e, F.col("re") < 20, 3, 1, 5), 3, 5, 0.1), "re")


# --- names of before, for the same rows -------------------------------------------

for _old, _new in (
    ("cross_spectral_matrices", "cross_spectral_matrix"),
    ("delay_and_sum_maps", "delay_and_sum_map"),
    ("delay_and_sum_array_signals", "delay_and_sum_signals"),
    ("correlation_latency_all_lags", "correlation_latency"),
):
    _QUERIES[_old], _SQL[_old] = _QUERIES[_new], _SQL[_new]

from sonagrid import more_queries  # noqa: E402, F401  (registers its queries here)
