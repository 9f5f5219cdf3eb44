"""Warping by bent frequencies against the chain of allpasses itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonagrid.operators import transforms as tf


@pytest.mark.parametrize("warp", [0.6, -0.4])
def test_bent_frequencies_equal_the_chain(spark, warp):
    rng = np.random.default_rng(1)
    x = {0: rng.normal(size=200), 1: rng.normal(size=120)}
    frame = spark.createDataFrame([(c, n, float(v)) for c, s in x.items() for n, v in enumerate(s)], "ch long, n long, re double")
    values = lambda df: {(r.ch, r.n): r.re for r in df.collect()}
    for long, short in ((tf.warped(frame, warp, entries=0), tf.warped(frame, warp)), (tf.laguerre(frame, warp, entries=0), tf.laguerre(frame, warp))):
        got, want = values(long), values(short)
        assert len(got) == 400 and all(abs(got[k] - want.get(k, 0.0)) < 1e-10 for k in got)


def test_energy_of_a_long_channel_stays(spark):
    """Laguerre functions are orthonormal; 30 000 samples that fade, and no table of their square."""
    n = 30_000
    x = spark.range(n).select(F.lit(0).cast("long").alias("ch"), F.col("id").alias("n"), (F.sin(F.col("id") * 0.7) * F.exp(-F.col("id") / 900)).alias("re"))
    energy = lambda df: df.agg(F.sum(F.col("re") * F.col("re"))).first()[0]
    assert abs(energy(tf.laguerre(x, 0.3)) / energy(x) - 1) < 1e-9
