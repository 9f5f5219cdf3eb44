"""Streams in event time: blocks that come late, twice, out of order or never.

Rows are (ch long, input long, block long, ts timestamp, samples array<double>):
one block of one input (a microphone, say) of a channel (an array of them).
Blocks count from 0, all have ``size`` samples but the last, and the time
never falls with the block's number. The state of a channel holds the blocks
that came too early, until those before them are there. A block whose time the watermark
has passed cannot come any more (Spark drops it), so once the watermark reaches
the earliest block that waits, all before it are lost and count as zeros; an
event-time timer sees to that when no more rows come. So what waits is at most
what comes within the watermark's delay.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sonagrid.state import shared

#: lost is the number of input blocks that an output had to take as zeros.
OUTPUT = "ch long, output long, number long, lost long, samples array<double>"
STATE = "next long, blocks array<long>, inputs array<long>, times array<long>, lengths array<int>, held array<double>, inner array<double>"

#: Takes (block's number, inputs x samples, lost inputs, state vector), returns ([(output, number, lost, samples)], new state vector).
Processor = Callable[[int, np.ndarray, int, np.ndarray], tuple[list[tuple[int, int, int, np.ndarray]], np.ndarray]]


class _Waiting:
    """Blocks of one channel that wait: number to input to (time in ms, samples)."""

    def __init__(self, state: GroupState, initial: np.ndarray):
        self.next, self.inner, self.early = 0, initial, {}
        if state.exists:
            self.next, blocks, inputs, times, lengths, held, inner = state.get
            self.inner, flat, at = np.array(inner, dtype=float), np.array(held, dtype=float), 0
            for block, i, ms, n in zip(blocks, inputs, times, lengths):
                self.put(block, i, ms, flat[at : at + n])
                at += n

    def put(self, block: int, i: int, ms: int, samples: np.ndarray) -> None:
        """Keep a block; one that was passed or is there already changes nothing."""
        if block >= self.next:
            self.early.setdefault(block, {}).setdefault(i, (ms, samples))

    def due(self) -> int | None:
        """The first time of the earliest block that waits."""
        return min(ms for ms, _ in self.early[min(self.early)].values()) if self.early else None

    def turns(self, inputs: int, size: int, watermark: int) -> Iterator[tuple[int, np.ndarray, int]]:
        """Blocks whose turn it is, with zeros for what is lost by the watermark."""
        while self.early:
            there = self.early.get(self.next, {})
            if len(there) < inputs and self.due() > watermark:
                return
            length = max((len(x) for _, x in there.values()), default=size)
            x = np.zeros((inputs, length))
            for i, (_, samples) in there.items():
                x[i, : len(samples)] = samples
            yield self.next, x, inputs - len(there)
            self.early.pop(self.next, None)
            self.next += 1

    def row(self) -> tuple:
        pieces = [(b, i, ms, x) for b, there in sorted(self.early.items()) for i, (ms, x) in sorted(there.items())]
        held = np.concatenate([x for *_, x in pieces]).tolist() if pieces else []
        return (self.next, [p[0] for p in pieces], [p[1] for p in pieces], [p[2] for p in pieces], [len(p[3]) for p in pieces], held, self.inner.tolist())


def in_order(blocks: DataFrame, processor: Processor, initial: np.ndarray, size: int, inputs: int = 1, delay: str = "10 seconds") -> DataFrame:
    """(ch, output, number, lost, samples) of a processor that sees each channel's blocks in
    order. ``delay`` is the watermark's. Rows with nulls and of inputs beyond ``inputs`` are left out."""
    start = np.asarray(initial, dtype=float).ravel()

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = _Waiting(state, start)
        watermark = state.getCurrentWatermarkMs()

        def out() -> pd.DataFrame:
            rows = []
            for number, x, lost in waiting.turns(inputs, size, watermark):
                results, waiting.inner = processor(number, x, lost, waiting.inner)
                rows += [(int(key[0]), o, n, gone, y.tolist()) for o, n, gone, y in results]
            return pd.DataFrame(rows, columns=["ch", "output", "number", "lost", "samples"])

        if not state.hasTimedOut:
            for frame in frames:
                for block, i, ms, samples in zip(frame["block"], frame["input"], frame["ms"], frame["samples"]):
                    waiting.put(int(block), int(i), int(ms), np.asarray(samples, dtype=float))
                yield out()
        else:
            yield out()
        state.update(waiting.row())
        if waiting.early:
            state.setTimeoutTimestamp(max(waiting.due(), watermark + 1))

    sure = F.col("input").between(0, inputs - 1) & (F.col("block") >= 0) & F.col("ts").isNotNull() & F.col("samples").isNotNull() & F.col("ch").isNotNull()
    rows = blocks.where(sure & ~F.exists("samples", lambda v: v.isNull())).select("ch", "input", "block", "ts", F.unix_millis("ts").alias("ms"), "samples")
    return rows.withWatermark("ts", delay).groupBy("ch").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


# --- sliding frames ---------------------------------------------------------------


def sliding(window: int, hop: int) -> tuple[Processor, np.ndarray]:
    """Frames of ``window`` samples each ``hop``: the state holds the overlap, where it
    begins, which frame is next, and how many of its blocks were lost (as (end, lost) pairs)."""
    if window < 1 or hop < 1:
        raise ValueError("window and hop are positive")

    def run(number, x, lost, state):
        begin, frame, gone = int(state[0]), int(state[1]), int(state[2])
        ends = state[3 : 3 + 2 * gone].reshape(-1, 2)
        line = np.concatenate([state[3 + 2 * gone :], x[0]])
        if lost:
            ends = np.concatenate([ends, [[begin + len(line) - len(x[0]), begin + len(line)]]])
        rows = []
        while frame * hop + window <= begin + len(line):
            a = frame * hop
            hit = int(((ends[:, 0] < a + window) & (ends[:, 1] > a)).sum())
            rows.append((0, frame, hit, line[a - begin : a - begin + window].copy()))
            frame += 1
        # samples before the next frame are done with
        cut = min(frame * hop - begin, len(line))
        begin, line = begin + cut, line[cut:]
        ends = ends[ends[:, 1] > begin]
        return rows, np.concatenate([[begin, frame, len(ends)], ends.ravel(), line])

    return run, np.zeros(3)


def frames(blocks: DataFrame, window: int, hop: int, size: int, delay: str = "10 seconds") -> DataFrame:
    """(ch, frame, lost, samples): the frames that frames.frames cuts from the whole
    channel, each once, when its last sample is there. blocks need no column ``input``."""
    one = blocks if "input" in blocks.columns else blocks.withColumn("input", F.lit(0).cast("long"))
    out = in_order(one, *sliding(window, hop), size, 1, delay)
    return out.select("ch", F.col("number").alias("frame"), "lost", "samples")


def _powers(whole: np.ndarray, kind: str, detrend: bool) -> np.ndarray:
    """Squared magnitudes of windowed frames, a frame in each row."""
    m = np.arange(whole.shape[1])
    weight = {"hann": 0.5 - 0.5 * np.cos(2 * np.pi * m / whole.shape[1]), "boxcar": np.ones(whole.shape[1])}[kind]
    return np.abs(np.fft.rfft((whole - whole.mean(axis=1, keepdims=True) if detrend else whole) * weight)) ** 2


def powers(framed: DataFrame, kind: str = "hann", detrend: bool = True) -> DataFrame:
    """(ch, frame, lost, power array<double>) of frames: the squared magnitudes of each frame's bins,
    row by row and so in a stream as in a batch."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            if len(part):
                p = _powers(np.stack(part["samples"].to_list()).astype(float), kind, detrend)
                yield part[["ch", "frame", "lost"]].assign(power=p.tolist())

    return framed.select("ch", "frame", "lost", "samples").mapInPandas(run, "ch long, frame long, lost long, power array<double>")


def running_power(window: int, hop: int, kind: str = "hann", detrend: bool = True) -> tuple[Processor, np.ndarray]:
    """Mean powers of all frames so far without lost blocks, given whenever a block ends frames; number is the
    count of frames. The state holds the sums in front of that of sliding."""
    cut, start = sliding(window, hop)
    bins = window // 2 + 1

    def run(number, x, lost, state):
        rows, after = cut(number, x, lost, state[bins + 1 :])
        whole = [y for _, _, gone, y in rows if not gone]
        sums, count = state[:bins], state[bins] + len(whole)
        if whole:
            sums = sums + _powers(np.stack(whole), kind, detrend).sum(axis=0)
        out = [(0, int(count), lost, sums / count)] if whole else []
        return out, np.concatenate([sums, [count], after])

    return run, np.concatenate([np.zeros(bins + 1), start])


def welch(blocks: DataFrame, window: int, hop: int, size: int, kind: str = "hann", detrend: bool = True, delay: str = "10 seconds") -> DataFrame:
    """(ch, frames, power array<double>): running Welch means, one row for each block that
    ends frames; the row of most frames is the channel's spectrum so far."""
    one = blocks if "input" in blocks.columns else blocks.withColumn("input", F.lit(0).cast("long"))
    out = in_order(one, *running_power(window, hop, kind, detrend), size, 1, delay)
    return out.select("ch", F.col("number").alias("frames"), F.col("samples").alias("power"))


# --- convolution of several inputs ------------------------------------------------


def matrix_fir(taps: np.ndarray, size: int) -> tuple[Processor, np.ndarray]:
    """Outputs as sums of all inputs through responses taps[output, input, n], in uniform
    partitions of ``size``: the state holds the last block and the spectra of as many past blocks as
    the responses have partitions, for each input. One transform an input and one an output for each block.

    An output block has ``size`` samples too; a shorter last block is filled with zeros.
    """
    taps = np.asarray(taps, dtype=float)
    outputs, inputs, length = taps.shape
    count = -(-length // size)
    padded = np.zeros((outputs, inputs, count * size))
    padded[..., :length] = taps
    parts = np.fft.rfft(padded.reshape(outputs, inputs, count, size), 2 * size)
    bins = size + 1

    def run(number, x, lost, state):
        if x.shape[1] > size:
            raise ValueError("a block is longer than a partition")
        x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
        last, line = state[: inputs * size].reshape(inputs, size), state[inputs * size :].reshape(inputs, count, bins, 2)
        now = np.fft.rfft(np.concatenate([last, x], axis=1))
        line = np.concatenate([np.stack([now.real, now.imag], axis=-1)[:, None], line[:, :-1]], axis=1)
        met = np.einsum("oipk,ipk->ok", parts, line[..., 0] + 1j * line[..., 1])
        y = np.fft.irfft(met, 2 * size)[:, size:]
        return [(o, number, lost, y[o]) for o in range(outputs)], np.concatenate([x.ravel(), line.ravel()])

    return run, np.zeros(inputs * size + inputs * count * bins * 2)


def convolved(blocks: DataFrame, taps: np.ndarray, size: int, delay: str = "10 seconds") -> DataFrame:
    """(ch, output, block, lost, samples): every channel's inputs through a matrix of responses."""
    taps = np.asarray(taps, dtype=float)
    out = in_order(blocks, *matrix_fir(taps, size), size, taps.shape[1], delay)
    return out.withColumnRenamed("number", "block")


def blocks_of(signal: DataFrame, size: int, key: str = "ch", input_: str | None = None, start: str = "2000-01-01 00:00:00") -> DataFrame:
    """Rows for this module from samples (key, input, n, re), n from 0 without gaps: a second for each
    block from ``start`` on. A batch operation."""
    i = F.col(input_) if input_ else F.lit(0)
    cut = signal.groupBy(F.col(key).cast("long").alias("ch"), i.cast("long").alias("input"), F.floor(F.col("n") / size).alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "re"))), lambda s: s.re).alias("samples"))
    return cut.select("ch", "input", "block", F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + F.col("block")).alias("ts"), "samples")


def replayed(blocks: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream operator gives for a table of blocks, which it reads in one micro-batch as
    it finds them; input, checkpoint and output are tables in the shared folder."""
    spark = blocks.sparkSession
    folder = f"{shared(spark)}/stream-{uuid.uuid4().hex}"
    blocks.write.parquet(f"{folder}/in")
    out = operator(spark.readStream.schema(blocks.schema).parquet(f"{folder}/in"))
    query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
