"""Transforms in rounds against numpy's."""

import numpy as np
import pytest

from sonagrid.operators import long_fft

LENGTHS = (1, 2, 7, 16, 60, 97, 210, 211, 263)


def _frame(spark, channels):
    rows = [(c, n, float(v.real), float(v.imag)) for c, x in enumerate(channels) for n, v in enumerate(x)]
    return spark.createDataFrame(rows, "ch long, n long, re double, im double")


def _values(df, at="k"):
    out = {}
    for r in df.collect():
        out.setdefault(r.ch, {})[r[at]] = complex(r.re, r["im"] if "im" in df.columns else 0)
    return {c: np.array([v[k] for k in range(len(v))]) for c, v in out.items()}


@pytest.fixture(scope="module")
def channels():
    rng = np.random.default_rng(1)
    return [rng.normal(size=n) + 1j * rng.normal(size=n) for n in LENGTHS]


def test_divisors_near_the_root():
    assert long_fft.two_factors(16, 20) == (16, 1) and long_fft.two_factors(60, 20) == (6, 10)
    assert long_fft.two_factors(97, 20) == (0, 0) and long_fft.two_factors(1 << 22, 1 << 14) == (1 << 11, 1 << 11)


@pytest.mark.parametrize("whole", [12, long_fft.WHOLE])
def test_transforms_of_any_length(spark, channels, whole):
    """With rows of 12 values at most: whole, two rounds (60, 16), and chirps (97, 210 = 14 x 15, 211)."""
    frame = _frame(spark, channels)
    got = _values(long_fft.fft(frame, whole=whole))
    assert sorted(got) == list(range(len(LENGTHS)))
    for c, x in enumerate(channels):
        assert np.allclose(got[c], np.fft.fft(x), rtol=0, atol=1e-9), LENGTHS[c]
    back = _values(long_fft.fft(frame.withColumnRenamed("n", "k"), inverse=True, whole=whole), "n")
    for c, x in enumerate(channels):
        assert np.allclose(back[c], np.fft.ifft(x), rtol=0, atol=1e-9)


def test_envelopes_spectra_and_convolutions(spark, channels):
    real = [x.real for x in channels]
    frame = _frame(spark, real).drop("im")
    got = _values(long_fft.envelope(frame, whole=16), "n")
    for c, x in enumerate(real):
        s, n = np.fft.fft(x), len(x)
        s[(n + 1) // 2 + (n % 2 == 0) :] = 0
        s[1 : (n + 1) // 2] *= 2
        assert np.allclose(got[c], np.abs(np.fft.ifft(s)), rtol=0, atol=1e-9)
    got = long_fft.spectrum(frame, 100, whole=16).toPandas()
    for c, x in enumerate(real):
        mine = got[got.ch == c].sort_values("k")
        assert np.allclose(mine.f_hz, np.fft.rfftfreq(len(x), 0.01)) and np.allclose(mine.re + 1j * mine.im, np.fft.rfft(x), rtol=0, atol=1e-9)
    h = [np.random.default_rng(c).normal(size=5 + c) for c in range(len(real))]
    got = _values(long_fft.convolved(frame, _frame(spark, h).drop("im"), whole=16), "n")
    for c, x in enumerate(real):
        assert np.allclose(got[c], np.convolve(x, h[c]), rtol=0, atol=1e-9)


def test_one_channel_of_two_to_the_twenty(spark):
    """No row has more than 2^10 values, so no task holds the channel."""
    n = 1 << 20
    from pyspark.sql import functions as F

    x = spark.range(n).select(F.lit(0).cast("long").alias("ch"), F.col("id").alias("n"), (F.cos(F.col("id") * (2 * np.pi * 12345 / n)) + F.when(F.col("id") == 7, 1.0).otherwise(0.0)).alias("re"))
    s = long_fft.fft(x)
    top = s.where("abs(re) > 1000").orderBy("k").collect()
    assert [r.k for r in top] == [12345, n - 12345] and all(abs(r.re - n / 2) < 2 for r in top)
    k = 777
    one = s.where(f"k = {k}").first()
    assert abs(complex(one.re, one.im) - np.exp(-2j * np.pi * 7 * k / n)) < 1e-6
    assert s.count() == n


def test_a_chirp_is_not_broadcast(spark):
    """Its kernel comes from one row, so that the optimizer takes it for small, but has more values than the channel."""
    x = spark.range(1009).selectExpr("0L as ch", "id as n", "cos(id) as re")
    s = long_fft.spectrum(x, whole=256)
    assert len(s.collect()) == 505
    joins = [line for line in s._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0].splitlines() if "Join [ch#" in line and ", k#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins), joins
