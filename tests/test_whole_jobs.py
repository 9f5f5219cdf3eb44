"""Operators do the whole job: all channels, lags, shards, lines and points."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonagrid.operators import beamforming as bf
from sonagrid.operators import similarity as si
from sonagrid.operators import spectra as sp
from sonagrid.sources import tables as tb


def test_each_array_has_its_own_matrix_and_map(spark):
    rows = [(a, c, f, k, math.cos(3 * a + 2 * c + 5 * f + k), math.sin(a + 3 * c * f + k)) for a in range(3) for c in range(4 - (a == 2)) for f in range(6) for k in (1, 2)]
    spectra = spark.createDataFrame(rows, "array_id long, ch long, frame long, k int, re double, im double")
    mics = spark.createDataFrame([(i, 0.3 * math.cos(1.6 * i), 0.3 * math.sin(1.6 * i), 0.0) for i in range(4)], "pid long, x double, y double, z double")
    weights = bf.steering(bf.regular_grid(spark, [-0.2, 0.0, 0.2], [-0.1, 0.1], 0.5), mics, 30.0).cache()
    csm = sp.cross_spectra(spectra, keys=("array_id",)).cache()
    for f in (bf.delay_and_sum, bf.mvdr, bf.functional, bf.clean_sc, lambda c, w, **o: bf.orthogonal(c, w, 2, **o)):
        got = {(r.array_id, r.pid): r.power for r in f(csm, weights, keys=("array_id",)).collect()}
        assert len(got) == 3 * 6
        for a in range(3):
            one = sp.cross_spectra(spectra.where(f"array_id = {a}").drop("array_id"))
            mine = weights if a < 2 else weights.where("mid < 3")  # the third array lacks a microphone
            for r in f(one, mine).collect():
                assert abs(got[a, r.pid] - r.power) < 1e-9 * max(1, abs(r.power))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
@pytest.mark.parametrize("name", ["beamformer_mvdr", "beamformer_functional", "beamformer_orthogonal", "beamformer_clean_sc"])
def test_all_channels_take_part_in_the_maps(spark, name):
    from sonagrid import queries

    d = "/root/testdata/sf0.001"
    users = {r[0] for r in spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct().collect()}
    assert {r[0] for r in queries.queries()[name](spark, d).select("array_id").distinct().collect()} == {u // 8 for u in users}


def test_latency_of_more_than_sixteen_samples(spark):
    x = np.random.default_rng(1).normal(size=64)
    late, early = np.concatenate([np.zeros(41), -2 * x[:23]]), np.concatenate([x[37:], np.zeros(37)])
    rows = [(c, n, float(v)) for c, y in ((1, late), (2, early)) for n, v in enumerate(y)]
    signal = spark.createDataFrame(rows, "ch long, n long, re double")
    reference = spark.createDataFrame([(n, float(v)) for n, v in enumerate(x)], "n long, re double")
    got = {r.ch: (r.lag, r.value) for r in si.correlation_lag(signal, reference).collect()}
    assert got == {1: (41, pytest.approx(-2 * (x[:23] ** 2).sum())), 2: (-37, pytest.approx((x[37:] ** 2).sum()))}


def test_no_frequency_or_microphone_is_left_out(spark):
    n = 4500
    one = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "ch long, n long, re double")
    frequencies = spark.range(n).select((F.col("id") / 10).alias("f_hz"))
    assert sp.dft_at(one, frequencies, 1000).count() == n
    line = spark.createDataFrame([(0, 0.0, 1.0), (0, 400.0, 5.0)], "ch long, f_hz double, value double")
    assert sp.interpolate(line, frequencies).count() == n
    mics = spark.range(n).select(F.col("id").alias("pid"), (F.col("id") * 1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    assert bf.distances(mics.where("pid = 0"), mics).agg(F.count("*"), F.max("d")).first()[:] == (n, n - 1.0)
    assert bf.monopole(one.select("n", "re"), (0.0, 0.0, 0.0), mics, 1000).count() == 2 * n
    assert bf.aperture(mics).first()[:] == (n - 1.0, 1.0)


def test_hours_before_and_after_one_month(spark, tmp_path):
    rows = [("a", "2023-12-30 22:30:00"), ("a", "2024-01-10 00:00:00"), ("b", "2024-03-01 05:59:59"), ("b", "2024-03-01 05:00:00")]
    spark.createDataFrame(rows, "event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    got = tb.hourly(spark, str(tmp_path)).collect()
    hours = 61 * 24 + 8
    assert sorted((r.ch, r.n) for r in got) == [(c, n) for c in "ab" for n in range(hours)]
    assert {(r.ch, r.n): r.re for r in got if r.re} == {("a", 0): 1.0, ("a", 10 * 24 + 2): 1.0, ("b", hours - 1): 2.0}
