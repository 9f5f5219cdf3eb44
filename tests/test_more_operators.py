"""Designs, responses, transforms, beamformers, effects and files."""

import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonagrid import streaming as st
from sonagrid.operators import beamforming as bf
from sonagrid.operators import design as de
from sonagrid.operators import features as ft
from sonagrid.operators import kernels as ke
from sonagrid.operators import responses as rs
from sonagrid.operators import rooms as rm
from sonagrid.operators import spectra as sp
from sonagrid.operators import transforms as tf
from sonagrid.sources import generators as ge
from sonagrid.sources import wav

RATE = 48000


def values(signal, ch=0):
    return np.array([r.re for r in signal.where(F.col("ch") == ch).orderBy("n").select("re").collect()])


def signal(spark, *channels):
    return spark.createDataFrame([(c, n, float(v)) for c, x in enumerate(channels) for n, v in enumerate(x)], "ch long, n long, re double")


@pytest.mark.parametrize("family", ["butterworth", "chebyshev1", "chebyshev2", "bessel"])
@pytest.mark.parametrize("order", [1, 2, 3, 4, 5, 6])
def test_classic_designs(family, order):
    low = np.abs(ke.response(de.iir(family, order, 1000.0, "lowpass", RATE), np.array([1.0, 1000.0, 15000.0]), RATE))
    high = np.abs(ke.response(de.iir(family, order, 1000.0, "highpass", RATE), np.array([23900.0, 1000.0, 40.0]), RATE))
    assert low[0] == pytest.approx(1 if family != "chebyshev1" or order % 2 else 10 ** (-1 / 20), rel=1e-2 if order == 1 else 1e-3)
    assert low[1] == pytest.approx(high[1], rel=1e-6)
    edge = {"butterworth": -3.0103, "chebyshev1": -1.0, "chebyshev2": -40.0}.get(family)
    if edge is not None:
        assert 20 * np.log10(low[1]) == pytest.approx(edge, abs=1e-3)
    assert low[2] < 0.15 and high[2] < 0.15
    if family == "chebyshev2" and order == 1:
        return  # 40 dB at the edge leaves one pole pair next to no passband
    band = np.abs(ke.response(de.iir(family, order, (500.0, 2000.0), "bandpass", RATE), np.array([30.0, 995.0, 20000.0]), RATE))
    stop = np.abs(ke.response(de.iir(family, order, (500.0, 2000.0), "bandstop", RATE), np.array([10.0, 1000.0, 23000.0]), RATE))
    assert band[1] > 0.8
    assert band[0] < 0.2 and band[2] < 0.2
    assert stop[0] > 0.85 and stop[1] < 0.2


def test_sections_match_the_audio_form():
    f = np.array([50.0, 1000.0, 9000.0])
    assert np.allclose(ke.response(de.iir("butterworth", 4, 1000.0, "lowpass", RATE), f, RATE), ke.response(ke.butterworth(4, 1000.0, RATE), f, RATE))


def test_weighting_curves():
    f = np.array([100.0, 1000.0, 4000.0])
    for kind, want in (("A", [-19.1, 0.0, 1.0]), ("C", [-0.3, 0.0, -0.8])):
        assert np.allclose(de.weighting_db(f, kind), want, atol=0.1)
        assert np.allclose(20 * np.log10(np.abs(ke.response(de.weighting(kind, RATE), f, RATE))), want, atol=0.3)


def test_windows():
    assert np.allclose(de.window("hann", 5), [0, 0.5, 1, 0.5, 0])
    assert np.allclose(de.window("tukey", 64, 0.0), 1) and np.allclose(de.window("tukey", 65, 1.0), de.window("hann", 65))
    for kind in ("boxcar", "triangle", "bartlett", "kaiser", "gaussian", "cosine", "hamming", "blackman", "nuttall", "blackmanharris", "flattop"):
        w = de.window(kind, 33)
        assert len(w) == 33 and np.allclose(w, w[::-1]) and w[16] == pytest.approx(1, abs=1e-6)
        assert len(de.window(kind, 32, periodic=True)) == 32


def test_pinking_slope():
    h = 20 * np.log10(np.abs(ke.response(de.pinking(RATE), np.array([100.0, 1000.0, 10000.0]), RATE)))
    assert h[1] - h[0] == pytest.approx(-10, abs=1.5) and h[2] - h[1] == pytest.approx(-10, abs=3)


def test_thiran_delay():
    b, a = de.thiran(2.3, 2)
    w = 0.05
    z = np.exp(-1j * w * np.arange(3))
    assert -np.angle((b @ z) / (a @ z)) / w == pytest.approx(2.3, abs=1e-3)


def test_quadrature_mirror_bank_has_no_alias():
    taps = np.array([1.0, 1.0]) / 2
    q = de.quadrature_mirror(taps)
    x = np.random.default_rng(0).standard_normal(64)
    half = lambda h: np.convolve(x, h)[::2]
    up = lambda y: np.ravel(np.column_stack([y, np.zeros(len(y))]))
    y = np.convolve(up(half(q["low"])), q["low_back"]) + np.convolve(up(half(q["high"])), q["high_back"])
    assert np.allclose(y[1:64], x[:63])


def test_group_delay_designer():
    target = np.full(257, 40.0)
    h = de.group_delay_fir(target, 512)
    assert np.argmax(np.abs(h)) == 40
    assert np.allclose(np.abs(np.fft.rfft(h))[1:-1], 1)


def test_reflections_give_the_taps_back():
    taps = [1.0, 0.5, -0.2, 0.1]
    p, s = st.lattice(de.reflection_from_taps(taps))
    x = np.zeros(6)
    x[0] = 1
    assert np.allclose(p(x, s)[0][:4], taps)


def test_more_processors_equal_plain_filters():
    x = np.random.default_rng(1).standard_normal(256)
    s = ke.biquad("lowpass", 3000.0, RATE)
    plain, _ = ke.section_filter(x, s)
    for p, state in (st.lattice_ladder(s[:3], s[3:]), st.warped_iir(s[:3], s[3:], 0.0), st.filter_bank({"a": s})):
        assert np.allclose(p(x, state)[0], plain)
    p, state = st.lattice_ladder(s[:3], s[3:])
    first, held = p(x[:100], state)
    assert np.allclose(np.concatenate([first, p(x[100:], held)[0]]), plain)
    taps = np.random.default_rng(2).standard_normal(150)
    p, state = st.partitioned_fir(taps, 64)
    out = []
    for block in x.reshape(4, 64):
        y, state = p(block, state)
        out.append(y)
    assert np.allclose(np.concatenate(out), np.convolve(x, taps)[:256])


def test_kautz_sections_are_orthonormal():
    x = np.zeros(4000)
    x[0] = 1
    basis = []
    for k in range(3):
        p, s = st.kautz([0.5, -0.3, 0.8], np.eye(3)[k])
        basis.append(p(x, s)[0])
    assert np.allclose(np.array(basis) @ np.array(basis).T, np.eye(3), atol=1e-9)


def test_deconvolution_returns_the_filter(spark):
    x = values(ge.chirp(spark, 20.0, 3900.0, 8000, 4096))
    taps = np.array([0.0, 0.0, 1.0, 0.5, -0.25])
    y = np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(taps, 4096))
    h = values(rs.deconvolve(signal(spark, x, y), 0, 8000, 0.0, 4000.0), 1)
    assert np.allclose(h[:5], taps, atol=0.02)


def test_windows_around_the_peak(spark):
    x = np.full(200, 0.1)
    x[80] = 1.0
    s = signal(spark, x)
    y = values(rs.window_around_peak(s, 20, 40))
    assert y[80] == 1 and y[61] < 0.01 and y[59] == 0 and y[121] == 0 and y[85] == 0.1
    c = values(rs.centred(s, 100))
    assert len(c) == 100 and c[50] == 1


def test_linear_phase_and_excess_delay(spark):
    mag = spark.createDataFrame([(0, k, 1.0 if k < 20 else 0.0) for k in range(65)], "ch long, k int, value double")
    h = values(rs.linear_phase(mag, 128))
    assert np.argmax(h) == 64 and np.allclose(h[1:64], h[:64:-1])
    delayed = np.zeros(256)
    delayed[[30, 31]] = 1.0, 0.4
    d = [r.delay_s for r in rs.excess_group_delay(signal(spark, delayed), 1).where("k < 120").collect()]
    assert np.allclose(d, 30, atol=0.1)


def test_distortion_of_two_harmonics(spark):
    n = np.arange(512)
    x = np.sin(2 * np.pi * 8 * n / 512) + 0.1 * np.sin(2 * np.pi * 16 * n / 512) + 0.05 * np.sin(2 * np.pi * 24 * n / 512)
    p = ke.fft_spectrum(signal(spark, x)).select("ch", "k", F.expr("re * re + im * im").alias("power"))
    assert rs.total_harmonic_distortion(p, 8).first().thd == pytest.approx(np.hypot(0.1, 0.05))
    assert rs.noise_and_distortion(p, 8).first().thd_n == pytest.approx(np.hypot(0.1, 0.05))


def test_aligned_average_and_trim(spark):
    a, b = np.zeros(400), np.zeros(400)
    a[10], b[30] = 1.0, 0.5
    assert {r.n: r.re for r in rs.average(signal(spark, a, b)).where("re <> 0").collect()} == {10: 0.75}
    rng = np.random.default_rng(3)
    x = np.exp(-np.arange(4000) / 100) * rng.standard_normal(4000) + 1e-4 * rng.standard_normal(4000)
    kept = rs.trim_to_noise_floor(signal(spark, x), 100).count()
    assert 600 <= kept <= 1200


def test_wavelets_find_a_tone(spark):
    x = ge.sine(spark, 500.0, 8000, 800)
    bands = [250.0, 500.0, 1000.0]
    s = tf.cwt(x, bands, 8000)
    level = {r.f_hz: r.p for r in s.where("n between 200 and 600").groupBy("f_hz").agg(F.avg(F.expr("re * re + im * im")).alias("p")).collect()}
    assert level[500.0] == pytest.approx(0.25, rel=0.02) and max(level[250.0], level[1000.0]) < 0.01
    moved = tf.squeezed(s, bands, 8000).where("n between 200 and 600").groupBy("f_hz").agg(F.sum("power").alias("p")).collect()
    assert max(moved, key=lambda r: r.p).f_hz == 500.0
    vq = tf.variable_q(x, 250.0, 2, 2, 8000).where("n = 400").select("f_hz", F.expr("re * re + im * im").alias("p")).collect()
    assert max(vq, key=lambda r: r.p).f_hz == pytest.approx(500.0)


def test_cepstrum_round_trip_and_warping(spark):
    x = np.zeros(64)
    x[:4] = [1.0, 0.4, -0.2, 0.1]
    s = signal(spark, x)
    assert np.allclose(values(tf.from_cepstrum(tf.complex_cepstrum(s))), x, atol=1e-6)
    assert np.allclose(values(tf.warped(s, 0.0)), x)
    there = tf.warped(s, 0.3, 256)
    assert np.allclose(values(tf.warped(there, -0.3, 64)), x, atol=1e-3)
    c = values(tf.laguerre(s, 0.2))
    assert np.sum(c**2) == pytest.approx(np.sum(x**2), rel=1e-3)


def test_beamformers_point_at_the_source(spark):
    mics = spark.createDataFrame([(i, 0.3 * float(np.cos(i * np.pi / 4)), 0.3 * float(np.sin(i * np.pi / 4)), 0.0) for i in range(8)], "pid long, x double, y double, z double")
    grid = bf.regular_grid(spark, [-0.4, -0.2, 0.0, 0.2, 0.4], [-0.4, -0.2, 0.0, 0.2, 0.4], 0.6)
    place = grid.where("pid = 8").first()
    k = bf.wave_number(2500.0)
    xyz = np.array([[r.x, r.y, r.z] for r in mics.orderBy("pid").collect()])
    d = np.linalg.norm(xyz - np.array([place.x, place.y, place.z]), axis=1)
    p = np.exp(-1j * k * d) / d
    # entries are conj(X_i) X_j of pressures that arrive later from farther away
    c = np.outer(p.conj(), p) + 1e-3 * np.eye(8)
    csm = spark.createDataFrame([(0, i, j, float(c[i, j].real), float(c[i, j].imag)) for i in range(8) for j in range(i, 8)], "k int, ch_i long, ch_j long, re double, im double")
    weights = bf.steering(grid, mics, k)
    maps = {
        "das": bf.delay_and_sum(csm.drop("k"), weights),
        "no diagonal": bf.delay_and_sum(csm.drop("k"), weights, True),
        "mvdr": bf.mvdr(csm, weights),
        "functional": bf.functional(csm, weights),
        "orthogonal": bf.orthogonal(csm, weights, 1),
        "clean": bf.clean_sc(csm, weights),
    }
    best = {n: m.orderBy(F.desc("power")).first().pid for n, m in maps.items()}
    assert best.keys() == maps.keys()
    assert set(best.values()) == {8}, best


def test_rooms(spark):
    modes = rm.shoebox_modes(spark, (5.0, 4.0, 3.0), 100.0)
    f = spark.createDataFrame([(34.3,), (40.0,)], "f_hz double")
    level = {r.f_hz: np.hypot(r.re, r.im) for r in rm.modal_response(modes, (0, 0, 0), (0, 0, 0), (5.0, 4.0, 3.0), f, 1.0).collect()}
    assert level[34.3] > 5 * level[40.0]
    power = spark.range(200).select(F.lit(0).alias("ch"), (F.col("id") * 0.5).alias("f_hz"), F.exp(-F.pow(F.col("id") * 0.5 - 40, F.lit(2.0)) / 8).alias("power"))
    assert [r.f_hz for r in rm.find_modes(power, 10.0, 90.0, 100.0).collect()] == [40.0]
    rt = spark.createDataFrame([(0, 125.0, 1.2), (0, 250.0, 1.0), (0, 500.0, 0.8), (0, 1000.0, 0.6)], "ch int, centre_hz double, rt_s double")
    assert rm.bass_ratio(rt).first().bass_ratio == pytest.approx(2.2 / 1.4)
    x = ge.noise(spark, 100, 1, 2)
    ir = rm.synthetic_response(rm.image_sources(spark, (5.0, 4.0, 3.0), (1.0, 1.0, 1.0), (3.0, 2.0, 1.5), 1, 0.7, 1000))
    taps = np.zeros(200)
    for r in ir.collect():
        taps[r.n] = r.re
    y = values(rm.auralise(x, ir))
    assert np.allclose(y, np.convolve(values(x), taps)[np.flatnonzero(taps)[0] :][: len(y)])
    assert np.allclose(values(ke.convolve_long(x, taps, True)), np.convolve(values(x), taps)[:100])


def test_effects(spark):
    x = ge.noise(spark, 400, 1, 4)
    y = values(ke.feedback_delay(x, 50, 0.5))
    v = values(x)
    assert np.allclose(y[50:100], v[50:100] + 0.5 * v[:50]) and np.allclose(y[100:150], v[100:150] + 0.5 * y[50:100])
    assert np.allclose(values(ke.chorus(x, 8000, [(0.0, 0.0, 1.0)])), v)
    tone = values(ge.sine(spark, 500.0, 8000, 2048))
    rng = np.random.default_rng(5)
    noisy = np.concatenate([np.zeros(1024), tone]) + 0.05 * rng.standard_normal(3072)
    clean = values(ke.spectral_subtraction(signal(spark, noisy), 128, 12, 2.0))
    assert np.std(clean[128:900]) < 0.6 * np.std(noisy[128:900])
    b = ke.arma(signal(spark, ke.section_filter(np.eye(1, 200)[0], ke.biquad("lowpass", 2000.0, 8000))[0]), 2, 2).first().out
    assert np.allclose(b, ke.biquad("lowpass", 2000.0, 8000), atol=1e-6)
    g = values(ke.gammatone(signal(spark, tone), 500.0, 8000))
    assert np.max(np.abs(g[1000:])) == pytest.approx(1.0, abs=0.05)


def test_wav_files_both_ways(spark, tmp_path):
    x = ge.noise(spark, 1000, 2, 6).withColumn("re", F.col("re") / 5).withColumn("name", F.lit("take"))
    wav.write(x, f"file://{tmp_path}/out", 8000, "name", 24)
    assert [p.name for p in (tmp_path / "out").glob("*.wav")] == ["take.wav"] and not list((tmp_path / "out").glob("_tmp*"))
    back = wav.samples(wav.read(spark, f"file://{tmp_path}/out", 300))
    for c in (0, 1):
        assert np.allclose(values(back, c), np.clip(values(x, c), -1, 1 - 2**-23), atol=2**-23)
    for bits in (8, 16, 32):
        raw = wav.encode(8000, np.array([[0.0], [0.5], [-0.5], [2.0]]), bits)
        rate, y = wav.decode(raw)
        assert rate == 8000 and np.allclose(y[:3, 0], [0, 0.5, -0.5], atol=2.0 ** (1 - bits))
    with wave.open(str(tmp_path / "out" / "take.wav")) as f:
        assert (f.getnchannels(), f.getsampwidth(), f.getframerate(), f.getnframes()) == (2, 3, 8000, 1000)


def test_sample_formats_and_positions(spark, tmp_path):
    rows = spark.createDataFrame([(v,) for v in (0.0, 1.0, -1.0, 0.5)], "x double")
    got = {n: [r[0] for r in rows.select(wav.to_format(F.col("x"), n)).collect()] for n in wav.FORMATS}
    assert got["i8"] == [0, 127, -128, 64] and got["u8"] == [128, 255, 0, 192] and got["i24"] == [0, 2**23 - 1, -(2**23), 2**22]
    for n in wav.FORMATS:
        back = [r[0] for r in rows.select(wav.from_format(wav.to_format(F.col("x"), n), n)).collect()]
        assert np.allclose(back, [0, 1, -1, 0.5], atol=2.0 ** -(wav.FORMATS[n][0] - 1))
    assert wav.to_24_bits(np.array([1, -1])) == b"\x01\x00\x00\xff\xff\xff"
    (tmp_path / "a.xml").write_text('<MicArray name="a">\n<pos Name="P 1" x="0.5" y="-1" z="0"/>\n<pos Name="P 2" x="1" y="2" z="3"/>\n</MicArray>')
    assert [tuple(r) for r in wav.microphone_positions(spark, f"file://{tmp_path}/a.xml").orderBy("name").collect()] == [("P 1", 0.5, -1.0, 0.0), ("P 2", 1.0, 2.0, 3.0)]


def test_log_mel(spark):
    weights = ft.mel_weights(33, 8000, 6)
    frames = sp.stft(ge.noise(spark, 256, 1, 7), 64, 32).select("ch", "frame", "k", F.expr("re * re + im * im").alias("power"))
    assert tf.log_mel(frames, weights, ("ch", "frame")).groupBy("frame").count().where("count <> 6").count() == 0
