"""Maps of arrays against their formulas, point by point."""

import numpy as np
import pytest

from sonagrid.operators import beamforming as bf


@pytest.fixture(scope="module")
def scene(spark):
    rng = np.random.default_rng(3)
    mics = rng.uniform(-0.5, 0.5, (5, 3)) * [1, 1, 0]
    grid = np.array([[x, y, 1.0] for y in (-0.5, 0.0, 0.5) for x in (-0.5, 0.0, 0.5)])
    matrices = {}
    for key in (0, 1):
        for k in (2, 3):
            x = rng.standard_normal((5, 8)) + 1j * rng.standard_normal((5, 8))
            matrices[key, k] = x @ x.conj().T / 8
    rows = [(key, k, i, j, float(c[i, j].real), float(c[i, j].imag)) for (key, k), c in matrices.items() for i in range(5) for j in range(i, 5)]
    csm = spark.createDataFrame(rows, "array_id long, k int, ch_i long, ch_j long, re double, im double")
    point = lambda table: spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(table)], "pid long, x double, y double, z double")
    weights = bf.steering(point(grid), point(mics), 20.0)
    h = np.zeros((9, 5), dtype=complex)
    for r in weights.collect():
        h[r.pid, r.mid] = r.re + 1j * r.im
    return matrices, csm, weights, h


def maps(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.array_id, np.zeros(9))[r.pid] = r.power
    return out


def check(df, scene, formula):
    matrices, _, _, h = scene
    got = maps(df)
    assert sorted(got) == [0, 1]
    for key in (0, 1):
        assert np.allclose(got[key], sum(formula(matrices[key, k], h) for k in (2, 3)), rtol=1e-6)


def test_minimum_variance(scene):
    def formula(c, h):
        c = c + np.eye(5) * 1e-6 * np.trace(c).real / 5
        return np.array([1 / (w.conj() @ np.linalg.inv(c) @ w).real for w in h])

    check(bf.mvdr(scene[1], scene[2], keys=("array_id",)), scene, formula)


def test_functional(scene):
    def formula(c, h):
        w, v = np.linalg.eigh(c)
        root = v @ np.diag(np.maximum(w, 0) ** 0.25) @ v.conj().T
        return np.array([(x.conj() @ root @ x).real ** 4 / np.linalg.norm(x) ** 8 for x in h])

    check(bf.functional(scene[1], scene[2], 4.0, keys=("array_id",)), scene, formula)


def test_orthogonal(scene):
    def formula(c, h):
        w, v = np.linalg.eigh(c)
        out = np.zeros(len(h))
        for k in (4, 3):
            out[np.argmax([abs(x.conj() @ v[:, k]) for x in h])] += w[k] / 5
        return out

    check(bf.orthogonal(scene[1], scene[2], 2, keys=("array_id",)), scene, formula)


def test_clean_finds_the_one_source(spark, scene):
    h = scene[3]
    a = h[4] / np.linalg.norm(h[4]) ** 2  # a source at point 4 seen by the microphones
    c = np.outer(a, a.conj())
    rows = [(0, 2, i, j, float(c[i, j].real), float(c[i, j].imag)) for i in range(5) for j in range(i, 5)]
    csm = spark.createDataFrame(rows, "array_id long, k int, ch_i long, ch_j long, re double, im double")
    got = maps(bf.clean_sc(csm, scene[2], keys=("array_id",)))[0]
    assert np.argmax(got) == 4 and got[4] > 0.99 * got.sum() and np.isclose(got[4], 1, rtol=1e-3)


def test_functional_keeps_the_scale_of_weights_on_demand(scene):
    def formula(c, h):
        w, v = np.linalg.eigh(c)
        root = v @ np.diag(np.maximum(w, 0) ** 0.25) @ v.conj().T
        return np.array([(x.conj() @ root @ x).real ** 4 / np.linalg.norm(x) ** 6 for x in h])

    check(bf.functional(scene[1], scene[2], 4.0, keys=("array_id",), scaled=True), scene, formula)


@pytest.mark.parametrize("remove_diagonal, share, inner", [(False, 0.5, 0), (True, 0.5, 20), (False, 0.7, 20)])
def test_clean_takes_the_steps_of_the_method(scene, remove_diagonal, share, inner):
    def formula(c, h):
        c = c - np.diag(np.diag(c)) if remove_diagonal else c.copy()
        power = np.einsum("pi,ij,pj->p", h.conj(), c, h).real
        out, norm = np.zeros(len(h)), 2 * np.linalg.norm(c, 1)
        for _ in range(10):
            best = int(np.argmax(power))
            peak, w = power[best], h[best]
            out[best] += share * peak
            if np.linalg.norm(c, 1) >= norm:
                break
            norm, x = np.linalg.norm(c, 1), w if inner else c @ w / peak
            for _ in range(inner):
                x = (c @ w / peak + np.abs(x) ** 2 * w) / np.sqrt(1 + np.abs(x) ** 2 @ np.abs(w) ** 2)
            g = peak * np.outer(x, x.conj())
            if remove_diagonal:
                np.fill_diagonal(g, 0)
            c = c - share * g
            power = power - share * np.einsum("pi,ij,pj->p", h.conj(), g, h).real
        return out

    check(bf.clean_sc(scene[1], scene[2], share=share, remove_diagonal=remove_diagonal, keys=("array_id",), inner=inner), scene, formula)


def test_clean_separates_two_sources(spark, scene):
    """Two sources that are not coherent, each seen exactly by the steering of its point."""
    h = scene[3]
    a, b = (h[p] / np.linalg.norm(h[p]) ** 2 for p in (0, 8))
    c = 4.0 * np.outer(a, a.conj()) + np.outer(b, b.conj())
    rows = [(0, 2, i, j, float(c[i, j].real), float(c[i, j].imag)) for i in range(5) for j in range(i, 5)]
    csm = spark.createDataFrame(rows, "array_id long, k int, ch_i long, ch_j long, re double, im double")
    got = maps(bf.clean_sc(csm, scene[2], iterations=20, keys=("array_id",)))[0]
    assert set(np.argsort(got)[-2:]) == {0, 8} and got[0] > 2 * got[8] > 0
