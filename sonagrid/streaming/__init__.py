"""Stateful operators on block streams.

A stream has rows (ch, block, samples array<double>): blocks of a channel come
in order within and across micro-batches, or are put in order by their number
inside a micro-batch. State is kept for each channel by Spark's state store, so
a restarted query continues where its checkpoint ends. Output blocks keep their
numbers, and joined they equal the batch operator's signal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "ch long, block long, samples array<double>"
STATE = "state array<double>"

#: A processor takes (block, state vector) and returns (output block, new state vector).
Processor = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def stateful(blocks: DataFrame, processor: Processor, initial: np.ndarray) -> DataFrame:
    """Blocks through a processor with one state vector for each channel."""
    start = np.asarray(initial, dtype=float).ravel()

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.array(state.get[0], dtype=float) if state.exists else start
        rows = []
        for frame in [pd.concat(list(frames)).sort_values("block")]:
            for block, samples in zip(frame["block"], frame["samples"]):
                out, held = processor(np.asarray(samples, dtype=float), held)
                rows.append((int(key[0]), int(block), np.asarray(out).tolist()))
        state.update((held.tolist(),))
        yield pd.DataFrame(rows, columns=["ch", "block", "samples"])

    return blocks.groupBy("ch").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def linear(make: Callable) -> Callable:
    """Of a recursion written sample by sample, the processor that runs blocks as
    products of matrices; its matrices are read off the recursion's answers to unit states and samples."""

    @wraps(make)
    def made(*args, **kwargs) -> tuple[Processor, np.ndarray]:
        from sonagrid.operators.recursive import LinearStep

        step, initial = make(*args, **kwargs)
        return LinearStep.of(step, initial).blockwise(), initial

    return made


@linear
def sections(coefficients: np.ndarray) -> tuple[Processor, np.ndarray]:
    """Second-order sections with carried state."""
    from sonagrid.operators.kernels import section_filter

    coefficients = np.atleast_2d(coefficients)

    def run(x, state):
        y, after = section_filter(x, coefficients, state.reshape(-1, 2))
        return y, after.ravel()

    return run, np.zeros(2 * len(coefficients))


def fir(taps: list[float]) -> tuple[Processor, np.ndarray]:
    """Finite response by overlap-save: the state is the last len(taps) - 1 inputs."""
    taps = np.asarray(taps, dtype=float)

    def run(x, state):
        line = np.concatenate([state, x])
        return np.convolve(line, taps, "valid"), line[len(line) - len(state) :]

    return run, np.zeros(len(taps) - 1)


def exponential_average(rise: float, fall: float) -> tuple[Processor, np.ndarray]:
    """One-pole follower with a coefficient for rising and one for falling input."""

    def run(x, state):
        y, out = float(state[0]), np.empty(len(x))
        for i, v in enumerate(x.tolist()):
            y += (rise if v > y else fall) * (v - y)
            out[i] = y
        return out, np.array([y])

    return run, np.zeros(1)


@linear
def state_space(a, b, c, d) -> tuple[Processor, np.ndarray]:
    """x' = A x + B u, y = C x + D u."""
    a, b, c = np.atleast_2d(a).astype(float), np.ravel(b).astype(float), np.ravel(c).astype(float)

    def run(u, x):
        out = np.empty(len(u))
        for i, v in enumerate(u.tolist()):
            out[i] = c @ x + d * v
            x = a @ x + b * v
        return out, x

    return run, np.zeros(len(b))


@linear
def state_variable(f_hz: float, q: float, rate_hz: int, output: str = "low") -> tuple[Processor, np.ndarray]:
    """Trapezoidal state-variable filter; output: low, band or high."""
    g = np.tan(np.pi * f_hz / rate_hz)
    k = 1 / q
    a1 = 1 / (1 + g * (g + k))

    def run(x, s):
        s1, s2 = s.tolist()
        out = np.empty(len(x))
        for i, v in enumerate(x.tolist()):
            band = a1 * (s1 + g * (v - s2))
            low = s2 + g * band
            s1, s2 = 2 * band - s1, 2 * low - s2
            out[i] = {"low": low, "band": band, "high": v - k * band - low}[output]
        return out, np.array([s1, s2])

    return run, np.zeros(2)


@linear
def lattice(reflection: list[float]) -> tuple[Processor, np.ndarray]:
    """Finite lattice: each stage mixes the forward and the delayed backward error."""
    ks = [float(k) for k in reflection]

    def run(x, s):
        back, out = s.tolist(), np.empty(len(x))
        for i, v in enumerate(x.tolist()):
            f, below = v, v
            for j, k in enumerate(ks):
                f, here = f + k * back[j], back[j] + k * f
                back[j], below = below, here
            out[i] = f
        return out, np.array(back)

    return run, np.zeros(len(ks))


@linear
def warped_fir(taps: list[float], warp: float) -> tuple[Processor, np.ndarray]:
    """Finite response whose unit delays are first-order allpasses of coefficient warp."""
    b = [float(t) for t in taps]

    def run(x, s):
        held, out = s.tolist(), np.empty(len(x))
        for i, v in enumerate(x.tolist()):
            total, before = b[0] * v, v
            for j in range(len(b) - 1):
                # y = -warp * x + x' + warp * y'; held has x' and y' of each allpass
                y = held[2 * j] + warp * (held[2 * j + 1] - before)
                held[2 * j], held[2 * j + 1] = before, y
                total += b[j + 1] * y
                before = y
            out[i] = total
        return out, np.array(held)

    return run, np.zeros(2 * (len(b) - 1))


def chain(*parts: tuple[Processor, np.ndarray]) -> tuple[Processor, np.ndarray]:
    """Processors one after the other; their states side by side."""
    sizes = np.cumsum([0, *[len(s) for _, s in parts]])

    def run(x, state):
        after = []
        for (process, _), a, b in zip(parts, sizes[:-1], sizes[1:]):
            x, held = process(x, state[a:b])
            after.append(held)
        return x, np.concatenate(after) if after else state

    return run, np.concatenate([s for _, s in parts]) if parts else np.zeros(0)


def parallel(*parts: tuple[Processor, np.ndarray]) -> tuple[Processor, np.ndarray]:
    """The sum of processors on the same input."""
    sizes = np.cumsum([0, *[len(s) for _, s in parts]])

    def run(x, state):
        total, after = np.zeros(len(x)), []
        for (process, _), a, b in zip(parts, sizes[:-1], sizes[1:]):
            y, held = process(x, state[a:b])
            total = total + y
            after.append(held)
        return total, np.concatenate(after)

    return run, np.concatenate([s for _, s in parts])


def partitioned_fir(taps: list[float], block: int) -> tuple[Processor, np.ndarray]:
    """Long response in uniform partitions: spectra of the last inputs meet the
    spectra of the taps' blocks. Input blocks must have the length ``block``."""
    taps = np.asarray(taps, dtype=float)
    count = -(-len(taps) // block)
    padded = np.zeros(count * block)
    padded[: len(taps)] = taps
    parts = np.fft.rfft(padded.reshape(count, block), 2 * block)
    bins = block + 1

    def run(x, state):
        if len(x) != block:
            raise ValueError("blocks must have the partition's length")
        before, line = state[:block], state[block:].reshape(count, bins, 2)
        spectrum = np.fft.rfft(np.concatenate([before, x]))
        line = np.concatenate([np.stack([spectrum.real, spectrum.imag], axis=1)[None], line[:-1]])
        y = np.fft.irfft((parts * (line[..., 0] + 1j * line[..., 1])).sum(axis=0), 2 * block)[block:]
        return y, np.concatenate([x, line.ravel()])

    return run, np.zeros(block + count * bins * 2)


@linear
def lattice_ladder(b, a) -> tuple[Processor, np.ndarray]:
    """Recursive filter as lattice of the denominator with a ladder of taps: the
    step-down recursion gives reflections, the numerator's expansion the taps."""
    b, a = np.asarray(b, dtype=float) / a[0], np.asarray(a, dtype=float) / a[0]
    order = max(len(a), len(b)) - 1
    poly = np.pad(a, (0, order + 1 - len(a)))
    num = np.pad(b, (0, order + 1 - len(b)))
    ks, taps = np.zeros(order), np.zeros(order + 1)
    for m in range(order, 0, -1):
        taps[m] = num[m]
        num = num - taps[m] * poly[::-1]
        num = num[:m]
        ks[m - 1] = k = poly[m]
        poly = ((poly - k * poly[::-1]) / (1 - k * k))[:m]
    taps[0] = num[0]

    def run(x, s):
        back, out = s.tolist(), np.empty(len(x))
        for i, v in enumerate(x.tolist()):
            f, new = v, [0.0] * (order + 1)
            for m in range(order, 0, -1):
                f = f - ks[m - 1] * back[m - 1]
                new[m] = back[m - 1] + ks[m - 1] * f
            new[0] = f
            out[i] = float(np.dot(taps, new))
            back = new[:order]
        return out, np.array(back)

    return run, np.zeros(order)


@linear
def kautz(poles, weights) -> tuple[Processor, np.ndarray]:
    """Orthonormal sections of real poles in a chain of allpasses, their taps weighted and summed."""
    p, w = [float(v) for v in poles], [float(v) for v in weights]
    norm = [(1 - v * v) ** 0.5 for v in p]

    def run(x, s):
        held, out = s.tolist(), np.empty(len(x))
        for i, v in enumerate(x.tolist()):
            total, u = 0.0, v
            for j, a in enumerate(p):
                # one-pole state r[n] = u[n] + a r[n-1]; allpass output r[n-1] - a r[n]
                before = held[j]
                r = u + a * before
                held[j] = r
                total += w[j] * norm[j] * r
                u = before - a * r
            out[i] = total
        return out, np.array(held)

    return run, np.zeros(len(p))


@linear
def warped_iir(b, a, warp: float) -> tuple[Processor, np.ndarray]:
    """Recursive filter whose unit delays are allpasses: the loop without delay is
    solved for each sample, as every allpass gives -warp times its input at once."""
    order = max(len(a), len(b)) - 1
    b = np.pad(np.asarray(b, dtype=float), (0, order + 1 - len(b)))
    a = np.pad(np.asarray(a, dtype=float), (0, order + 1 - len(a)))
    # w = x - sum a_k D_k(w); D_k(w) = g_k w + h_k with h_k from the held values
    gain = (-warp) ** np.arange(order + 1)
    loop = float(a @ gain)

    def run(x, s):
        held, out = s.tolist(), np.empty(len(x))
        for i, v in enumerate(x.tolist()):
            rest = [0.0]
            for j in range(order):
                rest.append(-warp * rest[j] + held[2 * j] + warp * held[2 * j + 1])
            w = (v - float(np.dot(a, rest))) / loop
            chain_in, total = w, b[0] * w
            for j in range(order):
                y = gain[j + 1] * w + rest[j + 1]
                held[2 * j], held[2 * j + 1] = chain_in, y
                total += b[j + 1] * y
                chain_in = y
            out[i] = total
        return out, np.array(held)

    return run, np.zeros(2 * order)


def filter_bank(bank: dict[str, np.ndarray], mode: str = "sequential") -> tuple[Processor, np.ndarray]:
    """Sections in series or summed, each with its own state."""
    parts = [sections(s) for s in bank.values()]
    return chain(*parts) if mode == "sequential" else parallel(*parts)
