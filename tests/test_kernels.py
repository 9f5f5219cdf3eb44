"""Kernels and stateful operators against closed forms and each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonagrid import streaming as st
from sonagrid.operators import filters as fi
from sonagrid.operators import kernels as ke
from sonagrid.operators import rooms as rm
from sonagrid.operators import spectra as sp
from sonagrid.sources import generators as ge
from sonagrid.sources import tables as tb

RATE = 48000


def values(signal, ch=0):
    rows = signal.where(F.col("ch") == ch).orderBy("n").select("re").collect()
    return np.array([r.re for r in rows])


def test_loudness_of_a_full_scale_tone(spark):
    tone = ge.sine(spark, 997.0, RATE, 2 * RATE)
    assert ke.loudness(tone, RATE).first().lufs == pytest.approx(-3.01, abs=0.07)


def test_butterworth_is_3_db_down_at_its_frequency():
    for order in range(1, 9):
        for high in (False, True):
            h = np.abs(ke.response(ke.butterworth(order, 1000.0, RATE, high), np.array([10.0, 1000.0, 20000.0]), RATE))
            assert 20 * np.log10(h[1]) == pytest.approx(-3.0103, abs=1e-6)
            assert h[2 if high else 0] == pytest.approx(1, abs=2e-2)
            assert h[0 if high else 2] < 0.1


def test_crossover_sums_to_an_allpass():
    f = np.geomspace(20, 20000, 50)
    low, high = ke.butterworth(2, 800.0, RATE), ke.butterworth(2, 800.0, RATE, True)
    total = ke.response(np.vstack([low, low]), f, RATE) + ke.response(np.vstack([high, high]), f, RATE)
    assert np.allclose(np.abs(total), 1)


def test_peaking_gain_at_its_centre():
    h = ke.response(ke.biquad("peaking", 200.0, RATE, 0.8, 6.0), np.array([200.0]), RATE)
    assert 20 * np.log10(abs(h[0])) == pytest.approx(6.0)


def test_impulse_through_sections_gives_the_response(spark):
    s = ke.butterworth(4, 3000.0, RATE)
    y = values(ke.iir(ge.dirac(spark, 4096), s))
    f = np.fft.rfftfreq(4096, 1 / RATE)
    assert np.allclose(np.fft.rfft(y), ke.response(s, f, RATE), atol=1e-9)


def test_zero_phase_keeps_a_low_tone_in_place(spark):
    x = ge.sine(spark, 100.0, 8000, 2000)
    y = values(ke.zero_phase(x, ke.butterworth(2, 1000.0, 8000)))
    assert np.max(np.abs(y - values(x))[200:-200]) < 1e-3


def test_fft_equals_relational_transform(spark):
    x = ge.noise(spark, 64, 2, 3)
    a = {(r.ch, r.k): (r.re, r.im) for r in ke.fft_spectrum(x).collect()}
    b = {(r.ch, r.k): (r.re, r.im) for r in sp.dft(x, 64).collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_sums_and_fast_transforms_agree(spark, monkeypatch):
    x = ge.noise(spark, 300, 2, 4).where("n % 7 <> 3")
    key = lambda df: {(r.ch, r.frame, r.k): (r.re, r.im) for r in df.collect()}
    sums = key(sp.stft(x, 64, 16))
    monkeypatch.setattr(sp, "MOST_SUMS", 8)
    fast = key(sp.stft(x, 64, 16))
    assert sums.keys() == fast.keys() and all(np.allclose(sums[k], fast[k]) for k in sums)


def test_analytic_signal_of_a_tone(spark):
    x = ge.sine(spark, 32.0, 1024, 1024)
    assert np.allclose(values(ke.hilbert_envelope(x)), 1)
    assert np.allclose(values(ke.instantaneous_frequency(x, 1024)), 32.0)


def test_minimum_phase_keeps_the_magnitude_and_moves_energy_ahead(spark):
    x = spark.createDataFrame([(0, n, float(v)) for n, v in enumerate([0.1, 0.5, 1.0, 0.3] + [0.0] * 60)], "ch long, n long, re double")
    y = values(ke.minimum_phase(x))
    assert np.allclose(np.abs(np.fft.fft(y)), np.abs(np.fft.fft(values(x))), atol=1e-3)
    assert y[0] ** 2 > 0.01


def test_resampling_a_tone(spark):
    y = values(ke.resample(ge.sine(spark, 500.0, 8000, 800), 3, 2))
    want = np.sin(2 * np.pi * 500 * np.arange(1200) / 12000)
    assert len(y) == 1200 and np.max(np.abs(y - want)[60:-60]) < 0.02


def test_autoregression_recovers_its_coefficients(spark):
    rng = np.random.default_rng(1)
    x = np.zeros(8000)
    e = rng.standard_normal(8000)
    for n in range(2, 8000):
        x[n] = 1.6 * x[n - 1] - 0.8 * x[n - 2] + e[n]
    s = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "ch long, n long, re double")
    for f in (ke.lpc, ke.burg):
        assert np.allclose(f(s, 2).first().out, [1, -1.6, 0.8], atol=0.03)


def test_reverberation_time_of_an_exponential_decay(spark):
    for t in (0.3, 1.0):
        n = spark.range(16000)
        ir = n.select(F.lit(0).cast("long").alias("ch"), F.col("id").alias("n"), F.exp(-6.907755 * F.col("id") / (8000 * t)).alias("re"))
        assert rm.reverberation_time(rm.energy_decay(ir), 8000, -5, -35).first().rt_s == pytest.approx(t, rel=2e-2)


def test_fractional_delay_of_a_tone(spark):
    x = ge.sine(spark, 400.0, 8000, 400)
    y = values(fi.fractional_delay(x, 20.25))
    want = np.sin(2 * np.pi * 400 * (np.arange(len(y)) + 5 - 20.25) / 8000)
    assert np.max(np.abs(y[30:350] - want[30:350])) < 5e-3


def test_short_and_long_responses_agree(spark):
    x = ge.noise(spark, 200, 2, 5)
    taps = fi.windowed_sinc(30, 0.3)
    assert np.allclose(values(fi.fir(x, taps), 1), np.convolve(values(x, 1), taps)[:200])
    longer = fi.windowed_sinc(60, 0.3)
    assert np.allclose(values(fi.fir(x, longer), 1), np.convolve(values(x, 1), longer)[:200])


def test_one_pole_forms_agree(spark):
    x = ge.noise(spark, 150, 3, 7)
    last = {r.ch: r.value for r in fi.one_pole(x, 0.2).collect()}
    series = fi.one_pole_series(x, 0.2).where("n = 149").collect()
    assert all(np.isclose(last[r.ch], r.re) for r in series)


PROCESSORS = {
    "sections": lambda: st.sections(ke.butterworth(4, 500.0, 8000)),
    "fir": lambda: st.fir(fi.windowed_sinc(20, 0.4)),
    "average": lambda: st.exponential_average(0.3, 0.05),
    "state_space": lambda: st.state_space([[0.5, 0.1], [-0.2, 0.3]], [1, 0.5], [0.3, 1], 0.7),
    "state_variable": lambda: st.state_variable(500.0, 0.8, 8000),
    "lattice": lambda: st.lattice([0.5, -0.3, 0.2]),
    "warped": lambda: st.warped_fir([0.5, 0.2, 0.1, -0.3], 0.4),
    "chain": lambda: st.chain(st.fir([0.5, 0.5]), st.state_variable(300.0, 0.7, 8000, "high")),
    "parallel": lambda: st.parallel(st.fir([0.5, 0.5]), st.lattice([0.1])),
}


@pytest.mark.parametrize("name", PROCESSORS)
def test_blocks_equal_the_whole(name):
    process, state = PROCESSORS[name]()
    x = np.random.default_rng(2).standard_normal(500)
    whole, _ = process(x, state.copy())
    parts, held = [], state.copy()
    for block in np.split(x, [7, 64, 65, 300]):
        y, held = process(block, held)
        parts.append(y)
    assert np.allclose(np.concatenate(parts), whole)


def test_warped_response_without_warping_is_a_plain_one():
    x = np.random.default_rng(3).standard_normal(50)
    a, b = st.warped_fir([0.5, 0.2, 0.1], 0.0), st.fir([0.5, 0.2, 0.1])
    assert np.allclose(a[0](x, a[1])[0], b[0](x, b[1])[0])


def test_state_variable_low_pass_equals_the_biquad():
    x = np.random.default_rng(4).standard_normal(300)
    p, s = st.state_variable(700.0, 0.9, 8000)
    assert np.allclose(p(x, s)[0], ke.section_filter(x, ke.biquad("lowpass", 700.0, 8000, 0.9))[0])


def test_stream_equals_batch(spark, tmp_path):
    x = ge.noise(spark, 600, 2, 9)
    s = ke.butterworth(2, 900.0, 8000)
    whole = {c: values(ke.iir(x, s), c) for c in (0, 1)}
    arrays = {r.ch: r.samples for r in tb.to_arrays(x).collect()}
    schema = "ch long, block long, samples array<double>"
    for k, (a, b) in enumerate([(0, 100), (100, 256), (256, 600)]):
        spark.createDataFrame([(c, k, arrays[c][a:b]) for c in arrays], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")
    out = st.stateful(stream, *st.sections(s))
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = spark.read.parquet(f"{tmp_path}/out").orderBy("ch", "block").collect()
    for c in (0, 1):
        assert np.allclose(np.concatenate([r.samples for r in rows if r.ch == c]), whole[c])
