"""Scans over blocks, gates and the compressor against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonagrid.operators import dynamics, kernels, recursive, scans


def _signal(spark, channels, parts=4):
    rows = [(c, n, float(v)) for c, x in channels.items() for n, v in enumerate(x)]
    return spark.createDataFrame(rows, "ch long, n long, re double").repartition(parts)


@pytest.mark.parametrize("fan, levels", [(7, 2), (3, 3), (1 << 16, None)])
def test_what_lies_before_a_row(spark, fan, levels):
    rng = np.random.default_rng(1)
    rows = [(c, int(n), float(v)) for c in range(3) for n, v in zip(np.sort(rng.choice(200, 60, replace=False)), rng.normal(0, 3, 60))]
    df = spark.createDataFrame(rows, "ch long, n long, re double")
    for how, plain in ((F.sum, sum), (F.max, max), (F.min, min)):
        got = {(r.ch, r.n): r.x for r in scans.before(df, ("ch",), "n", "re", how, "x", fan, levels).collect()}
        assert len(got) == len(rows)
        for c, n, _ in rows:
            earlier = [v for d, m, v in rows if d == c and m < n]
            want = plain(earlier) if earlier else None
            assert (got[c, n] is None) if want is None else abs(got[c, n] - want) < 1e-9


def test_long_recursions_fold_in_two_levels(spark):
    rng = np.random.default_rng(2)
    x = {0: rng.normal(size=9000), 1: rng.normal(size=300), 2: rng.normal(size=1)}
    sections = np.array([kernels.biquad("peaking", 5.0, 64, 2.0, 6.0), kernels.biquad("lowpass", 0.05, 64)])
    got = recursive.filtered(_signal(spark, x), recursive.sections_step(sections), size=16, levels=2)
    rows = {(r.ch, r.n): r.re for r in got.collect()}
    for c, v in x.items():
        want = kernels.section_filter(v, sections)[0]
        assert np.allclose([rows[c, n] for n in range(len(v))], want, rtol=0, atol=1e-9)
    maps = _signal(spark, x).select("ch", "n", (0.9 + 0.05 * F.sin("n")).alias("c"), F.col("re").alias("d"))
    got = {(r.ch, r.n): r.re for r in recursive.affine(maps, size=8, levels=2).collect()}
    for c, v in x.items():
        y = 0.0
        for n, d in enumerate(v):
            y = (0.9 + 0.05 * np.sin(n)) * y + d
            assert abs(got[c, n] - y) < 1e-9


def test_energy_decay_over_blocks(spark, monkeypatch):
    from sonagrid.operators import rooms

    monkeypatch.setattr(scans.before, "__defaults__", (50, None))
    rng = np.random.default_rng(6)
    x = {0: rng.normal(size=700) * 0.98 ** np.arange(700), 1: np.ones(1)}
    got = {(r.ch, r.n): r.edc_db for r in rooms.energy_decay(_signal(spark, x), levels=2).collect()}
    for c, v in x.items():
        want = 10 * np.log10(np.cumsum((v * v)[::-1])[::-1] / (v * v).sum())
        assert np.allclose([got[c, n] for n in range(len(v))], want, rtol=0, atol=1e-9)


# --- gates ------------------------------------------------------------------------


def _phases(x, threshold, attack, hold, release, above=True, side=None):
    """The gate sample by sample."""
    hold, release = max(1, hold), max(1, release)
    n, on = len(x), np.zeros(len(x), dtype=bool)
    beyond = x > threshold if above else x < threshold
    for i in range(1, n):
        if beyond[max(0, i - 2) : i].all():
            on[i : i + attack + hold + release] = True
    if side is not None:
        on = side
    a, r = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    i = 0
    while i < n:
        if not on[i]:
            i += 1
            continue
        j = i
        while j + 1 < n and on[j + 1]:
            j += 1
        if i > 0:
            a[i : min(i + attack, j + 1)] = True
        if j < n - 1:
            r[max(i, j - release) : j + 1] = True
        i = j + 1
    return a, on & ~a & ~r, r


@pytest.mark.parametrize("attack, hold, release, above", [(3, 2, 4, True), (0, 0, 0, True), (5, 40, 100, False), (2, 7, 1, True)])
def test_attack_hold_release(spark, attack, hold, release, above):
    rng = np.random.default_rng(attack)
    x = {c: rng.normal(size=size) for c, size in enumerate((1, 2, 3, 400, 900))}
    x[5] = np.ones(200)
    x[6] = -np.ones(50)
    signal = _signal(spark, x)
    condition = F.col("re") > 1.0 if above else F.col("re") < -1.2
    got = {(r.ch, r.n): (r.attack, r.hold, r.release) for r in dynamics.attack_hold_release(signal, condition, attack, hold, release, levels=2).collect()}
    assert len(got) == sum(map(len, x.values()))
    for c, v in x.items():
        want = np.column_stack(_phases(v, 1.0 if above else -1.2, attack, hold, release, above))
        assert [got[c, n] for n in range(len(v))] == [tuple(w) for w in want.tolist()]


def test_a_side_chain_opens_the_gate(spark):
    x = {0: np.sin(np.arange(300) / 9.0)}
    side = x[0] > 0.2
    got = dynamics.attack_hold_release(_signal(spark, x), F.lit(False), 4, 1, 6, side_chain=F.col("re") > 0.2).orderBy("n").collect()
    want = np.column_stack(_phases(x[0], 0, 4, 1, 6, side=side))
    assert [(r.attack, r.hold, r.release) for r in got] == [tuple(w) for w in want.tolist()]


def test_a_gate_is_open_while_it_holds(spark):
    x = {0: np.concatenate([np.zeros(50), np.ones(30), np.zeros(100)])}
    signal = _signal(spark, x)
    phases = dynamics.attack_hold_release(signal, F.col("re") > 0.5, 5, 10, 8)
    y = np.array([r.re for r in dynamics.gate_gain(signal, phases, 5, 8).orderBy("n").collect()])
    # open from 52 to 79 + 22, the last eight samples and one fall
    assert np.allclose(y[80:], 0) and (y[:52] == 0).all() and np.allclose(y[52:57], np.arange(1, 6) / 5) and np.allclose(y[57:80], 1)


# --- compressor -------------------------------------------------------------------


def _followed(v, up, down, g=1.0):
    out = []
    for w in v:
        g += (up if w > g else down) * (w - g)
        out.append(g)
    return np.array(out)


@pytest.mark.parametrize("up, down", [(0.5, 0.001), (0.003, 0.2), (1.0, 0.0), (1e-4, 1e-5)])
def test_gains_follow_as_a_loop_does(spark, up, down):
    rng = np.random.default_rng(3)
    v = {c: rng.random(size) ** 3 for c, size in enumerate((5000, 700, 31, 1))}
    frame = _signal(spark, v).withColumn("v", F.col("re"))
    got = {(r.ch, r.n): r.gain for r in dynamics.follow(frame, up, down, (0.0, 1.0), size=16, levels=2).collect()}
    for c, x in v.items():
        assert np.allclose([got[c, n] for n in range(len(x))], _followed(x, up, down), rtol=0, atol=1e-12)


def test_maps_of_blocks_are_those_of_their_samples():
    rng = np.random.default_rng(4)
    v = rng.random((50, 40)) * 3
    v[7, 5:] = np.nan
    for x, m in zip(v, dynamics.block_maps(v, 0.3, 0.02, 0.0, 3.0)):
        for g in rng.random(20) * 3:
            assert abs(scans.Monotone().apply(m, g) - _followed(x[~np.isnan(x)], 0.3, 0.02, g)[-1]) < 1e-12
    maps = dynamics.block_maps(v, 0.3, 0.02, 0.0, 3.0)
    whole = scans.Monotone().composed([0, 1, 2], maps[:3], 0, 3)
    for g in rng.random(20) * 3:
        assert abs(scans.Monotone().apply(whole, g) - _followed(v[:3].ravel(), 0.3, 0.02, g)[-1]) < 1e-12


@pytest.mark.parametrize("ratio, knee", [(4.0, 6.0), (0.7, 0.0)])
def test_compressor(spark, ratio, knee):
    rng = np.random.default_rng(5)
    x = {0: rng.normal(size=3000), 1: np.zeros(100)}
    got = {(r.ch, r.n): r.re for r in dynamics.compressor(_signal(spark, x), 64, -10.0, ratio, 0.05, 0.4, knee, 0.8, levels=2).collect()}
    up, down = kernels.smoothing_coefficient(0.05, 64), kernels.smoothing_coefficient(0.4, 64)
    for c, s in x.items():
        level = 10 * np.log10(np.maximum(s * s, 1e-30))
        over = level + 10.0
        wanted = np.where(over > 0, -10.0 + over / ratio, level)
        if knee:
            wanted = np.where(np.abs(over) <= knee / 2, level + (1 / ratio - 1) * (over + knee / 2) ** 2 / (2 * knee), wanted)
        want = s * (0.2 + 0.8 * _followed(10 ** ((wanted - level) / 20), up, down))
        assert np.allclose([got[c, n] for n in range(len(s))], want, rtol=0, atol=1e-12)
