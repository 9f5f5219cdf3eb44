"""Steps whose tasks must not grow with the input: as many rows as before, in more and smaller tasks."""

import re

import pytest
from pyspark.sql import functions as F

from sonagrid.operators import filters as fi


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]


@pytest.mark.parametrize("most", [fi.MOST_TAPS, 1])
def test_products_of_a_multichannel_filter_meet_before_they_are_summed(spark, monkeypatch, most):
    """All samples of a source do not meet, nor does a task sum what it reads before the shuffle."""
    monkeypatch.setattr(fi, "MOST_TAPS", most)
    x = spark.range(3 * 2 * 500).select((F.col("id") % 3).alias("pair"), (F.floor(F.col("id") / 3) % 2).alias("ch"), F.floor(F.col("id") / 6).alias("n"), F.sin("id").alias("re"))
    taps = spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 200, 0.5), (1, 0, 1, -0.25), (1, 1, 0, 0.75)], "source long, ch long, m long, b double")
    out = fi.convolve_matrix(x, taps, ("pair",))
    got = {(r.pair, r.ch, r.n): r.re for r in out.collect()}
    want = {}
    for r in x.collect():
        for source, ch, m, b in ((0, 0, 0, 1.0), (0, 1, 200, 0.5), (1, 0, 1, -0.25), (1, 1, 0, 0.75)):
            if source == r.ch:
                want[r.pair, ch, r.n + m] = want.get((r.pair, ch, r.n + m), 0.0) + r.re * b
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    plan = _plan(out)
    assert not re.search(r"hashpartitioning\(source#\d+L, \d+\)", plan)
    assert plan.count("partial_sum") == 1 and plan.index("partial_sum") < plan.index("Exchange hashpartitioning(pair")


def test_matrices_of_arrays_change_together(spark):
    """Many small matrices go through numpy at once, not each as a group of its own, and spectra are computed once."""
    import numpy as np

    from sonagrid.operators import beamforming as bf
    from sonagrid.operators import spectra as sp

    rng = np.random.default_rng(3)
    rows = [(a, c, f, k, float(rng.normal()), float(rng.normal())) for a in range(4) for c in range(2 + a % 2) for f in range(9) for k in (1, 2)]
    spectra = spark.createDataFrame(rows, "array_id long, ch long, frame long, k int, re double, im double")
    csm = sp.cross_spectra(spectra, keys=("array_id",))
    assert _plan(csm).count("Scan ExistingRDD") == 1
    mics = spark.createDataFrame([(i, 0.3 * i, 0.1 * i * i, 0.0) for i in range(3)], "pid long, x double, y double, z double")
    weights = bf.steering(bf.regular_grid(spark, [-0.2, 0.2], [-0.1, 0.1], 0.5), mics, 30.0).cache()
    w = {(r.pid, r.mid): complex(r.re, r.im) for r in weights.collect()}
    x = {(a, c, f, k): complex(re, im) for a, c, f, k, re, im in rows}
    for map_ in (bf.mvdr, bf.functional, lambda c, h, **o: bf.orthogonal(c, h, 1, **o)):
        out = map_(csm, weights, keys=("array_id",))
        assert "FlatMapGroups" not in _plan(out)
    got = {(r.array_id, r.pid): r.power for r in bf.functional(csm, weights, gamma=3.0, keys=("array_id",)).collect()}
    best = {(r.array_id, r.pid): r.power for r in bf.orthogonal(csm, weights, 1, keys=("array_id",)).collect()}
    inverse = {(r.array_id, r.pid): r.power for r in bf.mvdr(csm, weights, loading=1e-3, keys=("array_id",)).collect()}
    for a in range(4):
        n = 2 + a % 2
        power, loud, least = np.zeros(4), np.zeros(4), np.zeros(4)
        for k in (1, 2):
            v = np.array([[x[a, c, f, k] for f in range(9)] for c in range(n)])
            c = v.conj() @ v.T / 9
            values, vectors = np.linalg.eigh(c)
            h = np.array([[w[p, m] for m in range(n)] for p in range(4)])
            root = (vectors * values ** (1 / 3)) @ vectors.conj().T
            power += (np.einsum("pi,ij,pj->p", h.conj(), root, h).real / (abs(h) ** 2).sum(axis=1)) ** 3
            loud[np.argmax(np.round(abs(h.conj() @ vectors[:, -1]) ** 2, 12))] += values[-1] / n
            least += 1 / np.einsum("pi,ij,pj->p", h.conj(), np.linalg.inv(c + np.eye(n) * 1e-3 * np.trace(c).real / n), h).real
        for p in range(4):
            assert abs(got[a, p] - power[p]) < 1e-9 and abs(best[a, p] - loud[p]) < 1e-9 and abs(inverse[a, p] - least[p]) < 1e-9


def test_loudness_has_no_task_for_each_channel(spark, tmp_path):
    """Neither the ranks of few channels nor their blocks take windows over whole channels; hop is 10 and a block 40 samples."""
    import numpy as np

    from sonagrid import queries
    from sonagrid.operators import kernels as ke

    x = [np.sin(np.arange(n) * 0.9) * (1 + c) for c, n in enumerate((400, 331, 40, 41))]
    signal = spark.createDataFrame([(c, n, float(v)) for c, s in enumerate(x) for n, v in enumerate(s)], "ch long, n long, re double")
    out = ke.loudness(signal, 100)
    power = np.zeros(40)
    for c, s in enumerate(x):
        y = ke.section_filter(s, ke.k_weighting(100))[0]
        for f in range(40):
            if f * 10 + 40 < len(s):
                power[f] += (1.0, 1.0, 1.0, 1.41)[c] * (y[f * 10 : f * 10 + 40] ** 2).mean()
    loud = power[power > 0]
    level = lambda p: -0.691 + 10 * np.log10(p)
    loud = loud[level(loud) > -70]
    want = level(loud[level(loud) > level(loud.mean()) - 10].mean())
    assert abs(out.first().lufs - want) < 1e-9
    sorts = [line for line in _plan(out).splitlines() if "Sort [" in line]
    assert not any(", n#" in line or "re#" in line for line in sorts)
    assert "max(n#" in _plan(out) and not re.search(r"Window \[max\(n#", _plan(out))
    rows = [(o, 1 + o % 3, 1 + o % 7, 1 + o % 4, 1.0 * o, 1e5 * float(np.sin(o)), 0.0, 0.0) for o in range(0, 1 << 16, 7)]
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame(rows, columns).withColumn("l_shipdate", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/lineitem.parquet")
    query = queries.queries()["integrated_loudness"](spark, str(tmp_path))
    assert query.count() == 1
    assert not re.search(r"hashpartitioning\(five#\d+L, \d+\)", _plan(query))


def test_many_short_channels_go_through_folds_and_searches_together(spark):
    """No call of a kernel for each channel: neither where states are folded nor where a polynomial's recursion runs."""
    import numpy as np

    from sonagrid.operators import pole_search as ps
    from sonagrid.operators import recursive as rc

    signal = spark.range(40 * 300).selectExpr("id % 40 as ch", "id div 40 as n", "sin(id) as re")
    for levels in (1, 2):
        out = rc.filtered(signal, rc.sections_step(np.array([[1.0, 0, 0, 1, -0.5, 0]])), size=64, levels=levels)
        assert "FlatMapGroups" not in _plan(out)
        got = {r.n: r.re for r in out.where("ch = 7").collect()}
        y = 0.0
        for n in range(300):
            y = np.sin(n * 40 + 7) + 0.5 * y
            assert abs(got[n] - y) < 1e-12
    x, poly, past = np.random.default_rng(5).normal(size=(9, 4)), np.array([[1.0] * 4, [0.3, -0.2, 0.1, 0.5], [0.2, 0.1, 0.0, -0.3]]), np.ones((2, 4))
    y = ps._all_pole(x, poly, past)
    for c in range(4):
        out = [1.0, 1.0]
        for v in x[:, c]:
            out.append(v - poly[1, c] * out[-1] - poly[2, c] * out[-2])
        assert np.allclose(y[:, c], out)


def test_bands_of_a_bank_share_their_blocks(spark):
    """One fold and one pass for all bands, with the rows of each filter on its own."""
    from sonagrid.operators import kernels as ke

    signal = spark.range(3 * 700).selectExpr("id % 3 as ch", "id div 3 as n", "sin(id) as re")
    bank = {"low": ke.butterworth(2, 300.0, 4800), "peak": ke.biquad("peaking", 500.0, 4800, 0.9, 3.0), "high": ke.butterworth(4, 900.0, 4800, True)}
    out = ke.filter_bank(signal, bank)
    got = {(r.band, r.ch, r.n): r.re for r in out.collect()}
    assert len(got) == 3 * 3 * 700 and "Union" not in _plan(out)
    for name, sections in bank.items():
        for r in ke.iir(signal, sections).collect():
            assert abs(got[name, r.ch, r.n] - r.re) < 1e-12


def test_finer_bins_of_short_channels_are_never_rows(spark):
    """One shuffle by channel and one pass of numpy; bins meet in windows, not in a group for each bin."""
    import numpy as np

    from sonagrid.operators import phase_design as pd

    x = np.random.default_rng(2).normal(size=(5, 64))
    spectrum = spark.createDataFrame([(c, k, float(v.real), float(v.imag)) for c in range(5) for k, v in enumerate(np.fft.rfft(x[c]))], "ch long, k long, re double, im double")
    out = pd.linearized(spectrum.repartition(4, "ch"), 64, 1)
    plan = _plan(out)
    assert plan.count("Exchange") == 1 and plan.count("MapInArrow") == 1 and "ExistingRDD[ch" in plan
    got = {(r.ch, r.n): r.re for r in out.collect()}
    lengths = 0
    for c in range(5):
        delays = np.diff(np.unwrap(np.angle(np.fft.rfft(x[c])))) * -1
        delays = np.concatenate([delays[:1], (delays[1:] + delays[:-1]) / 2, delays[-1:]])
        late = int((2 * delays.max() - delays.min()) * 64 / 2 / np.pi + 1)
        assert late * 10 > 64 and {n for ch, n in got if ch == c} == set(range(late + 1))
        lengths += late + 1
    assert len(got) == lengths
