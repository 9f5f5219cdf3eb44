"""Poles of responses against the plain method on whole arrays."""

import numpy as np
import pytest

from sonagrid.operators import pole_search


def _plain(h, order, rounds):
    """The method on one array: filtered response, matrix of its delays, least squares, error of the allpass."""

    def through(b, a, x):
        y = np.zeros(len(x))
        for n in range(len(x)):
            y[n] = sum(b[k] * x[n - k] for k in range(min(len(b), n + 1))) - sum(a[k] * y[n - k] for k in range(1, min(len(a), n + 1)))
        return y

    x, poly, best = h[::-1], np.append(1.0, np.zeros(order)), (np.inf, None)
    for _ in range(rounds):
        u = through([1.0], poly, x)
        rows = np.column_stack([np.append(np.zeros(k), u[: len(u) - k]) for k in range(order + 1)])
        poly = np.append(1.0, np.linalg.lstsq(rows[:, :order], -rows[:, order], rcond=None)[0][::-1])
        error = (through(poly[::-1], poly, x) ** 2).sum()
        if error < best[0]:
            best = (error, poly)
    return best


@pytest.mark.parametrize("block, levels", [(16, 2), (1024, None)])
def test_poles_are_those_of_the_plain_method(spark, block, levels):
    rng = np.random.default_rng(1)
    planted = np.array([0.9 * np.exp(0.7j), 0.9 * np.exp(-0.7j), 0.6])
    n = np.arange(120)
    exact = (2 * 0.9**n * np.cos(0.7 * n + 0.3) + 0.8 * 0.6**n)
    h = {0: exact, 1: exact + 0.05 * rng.normal(size=120), 2: rng.normal(size=70) * 0.95 ** np.arange(70)}
    frame = spark.createDataFrame([(c, k, float(v)) for c, x in h.items() for k, v in enumerate(x)], "ch long, n long, re double")
    got = pole_search.poles(frame, 3, 4, block=block, levels=levels).toPandas()
    for c, x in h.items():
        mine = got[got.ch == c].sort_values("i")
        error, poly = _plain(x, 3, 4)
        p = mine.re.to_numpy() + 1j * mine.im.to_numpy()
        assert np.allclose(np.poly(p), poly, atol=1e-6 if c == 0 else 1e-7)
        assert abs(mine.error.iloc[0] - error) < 1e-8 * max(1, error)
    first = got[got.ch == 0]
    found = first.re.to_numpy() + 1j * first.im.to_numpy()
    assert all(np.abs(found - p).min() < 1e-4 for p in planted) and first.error.iloc[0] < 1e-8


def test_gammatone_bands_add_up_to_a_flat_band():
    from sonagrid import more_queries as mq

    rate = 16_000
    centres = [500.0]
    while centres[-1] < 3000:
        centres.append(centres[-1] + 24.7 * (1 + 4.37 * centres[-1] / 1000))
    h = np.array(mq._resynthesis_taps(centres, rate, 4096))
    f = np.fft.rfftfreq(4096, 1 / rate)
    inside = (f > 700) & (f < centres[-1])  # below, 4 ms are short for the narrowest bands
    level = 20 * np.log10(np.abs(np.fft.rfft(h)))[inside]
    assert np.abs(level).max() < 1.0, (level.min(), level.max())
    assert abs(np.argmax(np.abs(h)) - round(0.004 * rate)) <= 2
