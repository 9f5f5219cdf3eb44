"""Shuffled, partly late and lossy streams against whole channels."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from sonagrid.operators import frames as fr
from sonagrid.streaming import ordered as od

SCHEMA = "ch long, input long, block long, ts timestamp, samples array<double>"
SIZE = 16
START = datetime(2024, 1, 1)


def blocks(x, ch=0, i=0):
    return [(ch, i, b, START + timedelta(seconds=b), x[b * SIZE : (b + 1) * SIZE].tolist()) for b in range(-(-len(x) // SIZE))]


def fed(spark, tmp_path, batches, operator):
    """Micro-batches one by one through one query, restarted in the middle."""
    sent, results = 0, []
    for part in (batches[: len(batches) // 2], batches[len(batches) // 2 :]):
        for rows in part:
            at = tmp_path / "in" / f"{sent:03d}"
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(at))
            sent += 1
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
            query = operator(stream).writeStream.foreachBatch(lambda df, _: results.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            query.awaitTermination(120)
            assert query.exception() is None
    return results


@pytest.fixture(autouse=True)
def few_partitions(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


def test_shuffled_stream_has_the_frames_of_the_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = {c: rng.normal(size=n) for c, n in ((0, 150), (1, 90))}
    rows = [r for c in x for r in blocks(x[c], c)]
    # out of order by up to six blocks, some twice
    order = np.argsort([r[2] + rng.uniform(0, 6) for r in rows])
    rows = [rows[i] for i in order] + [rows[order[-1]]]
    got = fed(spark, tmp_path, [rows[i : i + 6] for i in range(0, len(rows), 6)], lambda s: od.frames(s, 40, 12, SIZE))
    signal = spark.createDataFrame([(c, n, float(v)) for c in x for n, v in enumerate(x[c])], "ch long, n long, re double")
    want = {}
    for r in fr.frames(signal, 40, 12).orderBy("ch", "frame", "m").collect():
        want.setdefault((r.ch, r.frame), []).append(r.x)
    assert len(got) == len(want) and all(r.lost == 0 and np.allclose(r.samples, want[r.ch, r.frame], atol=0) for r in got)


def test_lost_blocks_are_zeros_once_the_watermark_passes(spark, tmp_path):
    x = np.arange(1.0, 16 * 40 + 1)
    rows = [r for r in blocks(x) if r[2] not in (3, 4)]
    late = [r for r in blocks(x) if r[2] == 3]
    # blocks 5 to 12 wait; the watermark passes them by block 39, and block 3 comes too late then
    got = fed(spark, tmp_path, [rows[:11], rows[11:], late, late], lambda s: od.frames(s, 32, 16, SIZE, "5 seconds"))
    x[3 * 16 : 5 * 16] = 0
    assert sorted(r.frame for r in got) == list(range(39))
    for r in got:
        assert np.array_equal(r.samples, x[r.frame * 16 : r.frame * 16 + 32])
        assert r.lost == {2: 1, 3: 2, 4: 1}.get(r.frame, 0)


def test_matrix_of_responses_as_a_stream(spark, tmp_path):
    rng = np.random.default_rng(2)
    x, taps = rng.normal(size=(3, 8 * SIZE)), rng.normal(size=(2, 3, 41))
    rows = [r for i in range(3) for r in blocks(x[i], 5, i)]
    rows = [rows[i] for i in np.argsort([r[2] + rng.uniform(0, 4) for r in rows])]
    got = fed(spark, tmp_path, [rows[:9], rows[9:15], rows[15:]], lambda s: od.convolved(s, taps, SIZE))
    assert len(got) == 16
    for o in range(2):
        y = np.concatenate([r.samples for r in sorted(got, key=lambda r: r.block) if r.output == o])
        assert np.allclose(y, sum(np.convolve(x[i], taps[o, i]) for i in range(3))[: len(y)], atol=1e-9)


def test_running_spectra(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=10 * SIZE)
    got = fed(spark, tmp_path, [blocks(x)[5:], blocks(x)[:5]], lambda s: od.welch(s, 32, 16, SIZE, delay="1 minute"))
    weight = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(32) / 32)
    whole = [x[a : a + 32] for a in range(0, len(x) - 31, 16)]
    powers = np.array([np.abs(np.fft.rfft((f - f.mean()) * weight)) ** 2 for f in whole])
    assert [r.frames for r in got] == list(range(1, len(whole) + 1))
    assert all(np.allclose(r.power, powers[: r.frames].mean(axis=0)) for r in got)
    signal = spark.createDataFrame([(0, n, float(v)) for n, v in enumerate(x)], "ch long, n long, re double")
    rows = od.powers(od.replayed(od.blocks_of(signal, SIZE), lambda s: od.frames(s, 32, 16, SIZE))).orderBy("frame").collect()
    assert np.allclose([r.power for r in rows], powers)


def test_batch_rows_and_odd_ones(spark):
    rows = blocks(np.ones(40)) + [(0, 0, 7, None, [1.0]), (None, 0, 0, START, [1.0]), (0, 4, 0, START, [1.0]), (0, 0, 0, START, None)]
    signal = spark.createDataFrame([(3, n, float(n)) for n in range(40)], "ch long, n long, re double")
    cut = sorted(od.blocks_of(signal, SIZE).collect(), key=lambda r: r.block)
    assert [len(r.samples) for r in cut] == [16, 16, 8] and cut[2].samples[0] == 32.0 and (cut[2].ts - cut[0].ts).seconds == 2
    run, state = od.sliding(10, 30)
    seen = []
    for b in rows[:3]:
        out, state = run(b[2], np.array([b[4]]), 0, state)
        seen += [r[1] for r in out]
    assert seen == [0, 1] and len(state) < 20
