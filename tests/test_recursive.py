"""Recursions over blocks equal those sample by sample, wherever blocks end."""

import numpy as np
import pytest

from sonagrid import streaming as st
from sonagrid.operators import design as de
from sonagrid.operators import effects as fx
from sonagrid.operators import kernels as ke
from sonagrid.operators import recursive as rc
from sonagrid.operators import spectra as sp

SECTIONS = np.vstack([ke.biquad("peaking", 300.0, 4800, 0.8, 6.0), ke.butterworth(3, 500.0, 4800)])


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(1)
    return {ch: rng.standard_normal(n) for ch, n in ((0, 100), (1, 7), (2, 1), (3, 64))}


@pytest.fixture(scope="module")
def signal(spark, series):
    return spark.createDataFrame([(c, n, float(v)) for c, x in series.items() for n, v in enumerate(x)], "ch long, n long, re double").repartition(3)


def values(df, ch):
    return np.array([r.re for r in sorted(df.where(f"ch = {ch}").collect(), key=lambda r: r.n)])


@pytest.mark.parametrize("size", [8, 64, 256])
def test_sections_in_blocks(signal, series, size):
    got = rc.filtered(signal, rc.sections_step(SECTIONS), size=size).cache()
    for ch, x in series.items():
        assert np.allclose(values(got, ch), ke.section_filter(x, SECTIONS)[0])


def test_gaps_count_as_zeros(signal, series):
    got = rc.filtered(signal.where("n % 50 < 5"), rc.sections_step(SECTIONS), size=8)
    x = np.where(np.arange(100) % 50 < 5, series[0], 0.0)
    assert np.allclose(values(got, 0), ke.section_filter(x, SECTIONS)[0][np.arange(100) % 50 < 5])


def test_varying_first_order_recursion(spark, series):
    rng = np.random.default_rng(2)
    c, d = rng.uniform(0, 1, 100), series[0]
    rows = spark.createDataFrame([(0, n, float(a), float(b)) for n, (a, b) in enumerate(zip(c, d))], "ch long, n long, c double, d double")
    want, y = [], 0.0
    for a, b in zip(c, d):
        y = a * y + b
        want.append(y)
    for size in (8, 256):
        assert np.allclose(values(rc.affine(rows, size=size), 0), want)


def test_zero_phase_of_every_length(signal, series):
    got = rc.zero_phase(signal, ke.butterworth(2, 600.0, 4800)).cache()
    for ch, x in series.items():
        n = min(9, len(x) - 1)
        ext = np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]]) if n > 0 else x
        run = lambda v: ke.section_filter(v, ke.butterworth(2, 600.0, 4800))[0]
        assert np.allclose(values(got, ch), run(run(ext)[::-1])[::-1][n : n + len(x)])


@pytest.mark.parametrize(
    "part",
    [
        st.sections(SECTIONS),
        st.lattice_ladder([0.2, 0.3, 0.1], [1.0, -0.5, 0.3]),
        st.kautz([0.3, -0.5], [0.7, 0.4]),
        st.warped_iir([0.2, 0.1], [1.0, -0.4], 0.3),
        st.state_variable(400.0, 1.2, 4800, "high"),
    ],
)
def test_processors_of_blocks_equal_those_of_samples(part, series):
    run, state = part
    x, one, many = np.tile(series[0], 7), [], []
    held = state
    for v in x:
        y, held = run(np.array([v]), held)
        one.append(y[0])
    held = state
    for block in (x[:300], x[300:301], x[301:]):
        y, held = run(block, held)
        many.extend(y)
    assert np.allclose(one, many)


def test_bands_of_a_bank_add_up_to_an_allpass(signal, series):
    bank = ke.linkwitz_riley_bank([200.0, 500.0, 1200.0], 4800)
    f = np.linspace(10, 2390, 50)
    total = sum(ke.response(s, f, 4800) for s in bank.values())
    assert np.allclose(np.abs(total), 1)


def test_subtraction_leaves_silence_and_keeps_strong_frames(spark):
    rng = np.random.default_rng(3)
    x = 0.01 * rng.standard_normal(512)
    x[200:300] += np.sin(2 * np.pi * 0.125 * np.arange(100))
    signal = spark.createDataFrame([(0, n, float(v)) for n, v in enumerate(x)], "ch long, n long, re double")
    for forgetting in (0.0, 0.8):
        y = values(fx.spectral_subtraction(signal, 32, -20.0, factor=2.0, forgetting=forgetting), 0)
        assert np.std(y[32:160]) < 0.6 * np.std(x[32:160])
        assert np.corrcoef(y[210:290], x[210:290])[0, 1] > 0.99


def test_a_frequency_beyond_the_spectrum_may_be_an_error(spark):
    s = spark.createDataFrame([(0, k, k / 4, 1.0, 0.0) for k in range(3)], "ch long, k int, f_hz double, re double, im double")
    at = spark.createDataFrame([(0.7,)], "f_hz double")
    assert sp.interpolate_as(s, at, "complex").first().re == 1.0
    with pytest.raises(Exception, match="beyond the spectrum"):
        sp.interpolate_as(s, at, "complex", edges="error").collect()


def test_matched_sections_follow_the_analogue_magnitude():
    f, q, rate = 900.0, 1.1, 48000
    at = lambda s, x: abs(ke.response(s, np.array([x]), rate)[0])
    low, high, band, bell = (de.matched(k, f, rate, q, 6.0) for k in ("lowpass", "highpass", "bandpass", "peaking"))
    assert np.isclose(at(low, 0.0), 1) and np.isclose(at(low, f), q)
    assert np.isclose(at(high, 0.0), 0, atol=1e-9) and np.isclose(at(high, f), q)
    assert np.isclose(at(band, f), 1) and np.isclose(at(bell, f), 10 ** (6 / 20)) and np.isclose(at(bell, 0.0), 1)
    for x in (300.0, 2000.0, 10_000.0):
        s = 1j * x / f
        assert np.isclose(at(low, x), abs(1 / (s * s + s / q + 1)), rtol=0.02)
        assert np.isclose(at(bell, x), abs((s * s + s * 10 ** (3 / 20) / q + 1) / (s * s + s / q / 10 ** (3 / 20) + 1)), rtol=0.02)
