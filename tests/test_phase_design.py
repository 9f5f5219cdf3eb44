"""Designs of delay and phase against the same steps in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonagrid.operators import kernels as ke
from sonagrid.operators import phase_design as pd


def rows(spark, channels):
    return spark.createDataFrame([(c, k, float(v.real), float(v.imag)) for c, x in channels.items() for k, v in enumerate(np.fft.rfft(x))], "ch long, k long, re double, im double")


def signal(df):
    out = {}
    for r in df.orderBy("ch", "n").collect():
        out.setdefault(r.ch, []).append(r.re)
    return {c: np.array(x) for c, x in out.items()}


def crossover(length):
    """An impulse through a fourth-order crossover of two ways, summed: an allpass."""
    x = np.zeros(length)
    x[0] = 1
    return ke.section_filter(x, ke.allpass_of_crossover(570.0, 48000))[0]


@pytest.mark.parametrize("length,whole", [(4096, True), (256, False)])
def test_phase_becomes_linear(spark, length, whole):
    x = crossover(length)
    got = signal(pd.linearized(rows(spark, {1: x, 2: np.roll(x, 3)}), length, 48000))
    assert set(got) == {1, 2}
    for c, late in ((1, 0), (2, 3)):
        response = np.roll(x, late)
        both = np.fft.rfft(np.convolve(response, got[c]), 1 << 15)
        delays = -np.gradient(np.unwrap(np.angle(np.fft.rfft(response))))
        longest = 2 * delays.max() * length / 2 / np.pi
        # what the response and its linearizer do is one delay at all frequencies
        late = -np.gradient(np.unwrap(np.angle(both)))[20:-20] * (1 << 15) / 2 / np.pi
        before = delays * length / 2 / np.pi
        assert np.std(late) < (0.05 if whole else 0.3) * np.ptp(before) and abs(np.median(late) - longest) < 0.5
        assert len(got[c]) == int(longest - before.min() + 1) + 1


def test_design_equals_its_sums(spark):
    length, rate = 512, 1000
    k = np.arange(length // 2 + 1)
    delay, magnitude = (10 + 5 * np.sin(k / 40)) / rate, 1 / (1 + k / 100)
    targets = spark.createDataFrame([(7, int(i), float(d), float(m)) for i, d, m in zip(k, delay, magnitude)], "ch long, k long, delay_s double, magnitude double")
    steps = delay * rate * 2 * np.pi / length
    phase = -np.concatenate([[0], np.cumsum((steps[1:] + steps[:-1]) / 2)])
    want = np.fft.irfft(magnitude * np.exp(1j * phase), length)
    assert np.allclose(signal(pd.designed(targets, length, rate, additional=None))[7], want, atol=1e-12)
    assert np.allclose(signal(pd.designed(targets, length, rate, additional=5))[7], want[: int((delay * rate).max() + 1) + 6], atol=1e-12)
    smooth = signal(pd.designed(targets, length, rate, additional=None, simpson=True))[7]
    assert 0 < np.max(np.abs(smooth - want)) < 1e-3
    exact = signal(pd.designed(targets, length, rate, additional=None, integer_delay=True))[7]
    assert abs(abs(np.fft.rfft(exact)[-1]) - magnitude[-1]) < 1e-12
    # parabolas are exact for a quadratic delay
    steps = (k / 100) ** 2 / 10
    quadratic = spark.createDataFrame([(7, int(i), float(s * length / 2 / np.pi / rate)) for i, s in zip(k, steps)], "ch long, k long, delay_s double")
    want = np.fft.irfft(np.exp(-1j * (k / 100) ** 3 * 100 / 30), length)
    spectrum = np.fft.rfft(signal(pd.designed(quadratic, length, rate, additional=None, simpson=True))[7], axis=0)
    if len(spectrum) == len(k):
        assert np.allclose(spectrum[:-1], np.fft.rfft(want)[:-1], atol=1e-9)


def test_cubics_between_bins_keep_shape(spark):
    steps = np.array([1.0, 1.0, 2.0, 5.0, 5.0, 3.0, 3.5, 3.0, 9.0])
    targets = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate(steps)], "ch long, k long, delay_s double")
    near = pd.beside(targets, ("ch",), "k", ("delay_s",), (-1, 1, 2)).where("k < 8")
    values = near.select("k", *[pd._monotone("delay_s", F.lit(i / 8)).alias(f"u{i}") for i in range(9)]).orderBy("k").collect()
    for r in values:
        line = np.array(r[1:])
        assert abs(line[0] - steps[r.k]) < 1e-12 and abs(line[8] - steps[r.k + 1]) < 1e-12
        rising = np.diff(line) * np.sign(steps[r.k + 1] - steps[r.k])
        assert (rising >= -1e-12).all()


def test_odd_cases(spark):
    empty = spark.createDataFrame([], "ch long, k long, re double, im double")
    assert pd.linearized(empty, 64, 1000).count() == 0
    x = np.zeros(65)
    x[4] = 1
    got = signal(pd.linearized(rows(spark, {3: x}), 65, 1000))[3]
    assert int(np.argmax(got)) == 4 and got[4] > 0.99
    lacking = rows(spark, {3: x}).where("k <> 5")
    with pytest.raises(Exception, match="lacks bins"):
        pd.linearized(lacking, 65, 1000).count()
    with pytest.raises(ValueError):
        pd.linearized(lacking, 65, 1000, increase=-0.1)


@pytest.mark.parametrize("length", [64, 65])
def test_channels_in_a_row_equal_channels_in_rounds(spark, length):
    """Of channels 0 to 4 the last three need transforms longer than 300 samples; channel 5 lacks its key."""
    k = np.arange(length // 2 + 1)
    of = lambda c: (np.cos(k * (c + 1) / 7) + 1.01) * (c + 1) ** 2 / 2
    targets = spark.createDataFrame([(c if c < 5 else None, int(i), float(d), float(1 / (1 + i + c))) for c in range(6) for i, d in zip(k, of(c))], "ch long, k long, delay_s double, magnitude double")
    values = lambda df: {(r.ch, r.n): r.re for r in df.collect()}
    for additional, simpson, integer_delay in ((0, False, False), (None, True, False), (7, False, True), (None, True, True)):
        ways = [values(pd._designed(targets, length, 1, 0.25, additional, simpson, integer_delay, ("ch",), whole=whole)) for whole in (1 << 14, 300, 0)]
        assert {c for c, _ in ways[0]} == set(range(5))
        for other in ways[1:]:
            assert ways[0].keys() == other.keys() and max(abs(v - other[at]) for at, v in ways[0].items()) < 1e-11

    # rows that are there twice, in any order, are those with the larger delay
    once = targets.drop("magnitude").where("ch < 3")
    both = once.unionByName(once.withColumn("delay_s", F.col("delay_s") / 2))
    assert values(pd.designed(both.orderBy("delay_s"), length, 1)) == values(pd.designed(both.orderBy(F.desc("delay_s")), length, 1)) == values(pd.designed(once, length, 1))


def test_bins_meet_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(pd, "BLOCK", 4)
    there = [0, 1, 2, 3, 4, 5, 7, 8, 9, 11, 12, 16]
    rows_ = spark.createDataFrame([(c, k, float(10 * c + k)) for c in (1, 2) for k in there], "ch long, k long, v double")
    got = pd.beside(rows_, ("ch",), "k", ("v",), (-2, -1, 1, 2)).collect()
    assert sorted((r.ch, r.k) for r in got) == [(c, k) for c in (1, 2) for k in there]
    for r in got:
        for o, name in ((-2, "v_m2"), (-1, "v_m1"), (0, "v"), (1, "v_1"), (2, "v_2")):
            assert r[name] == (10 * r.ch + r.k + o if r.k + o in there else None)
