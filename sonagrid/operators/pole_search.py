"""Poles for a response: iterative least squares (Brandenstein and Unbehauen 1998).

The best allpass-like denominator A of a response, reversed in time, is sought by
rounds: the reversed response goes through 1 / A of the round before, and the
next A makes the filtered samples' linear combination least. A round needs only
the sums of products of each sample with the ones up to ``order`` before it, an
outer product for each sample added up over blocks. The recursion 1 / A differs
by channel and runs over blocks too: a block's map of its last outputs is a
matrix and a vector, folded in order (scans), and these outputs are just what
the block's products lack. The same sums tell the error of the round before.
Only polynomials, one row a channel, go from round to round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonagrid.operators import scans
from sonagrid.state import kept

Keys = tuple[str, ...]

BLOCK = 1024


#: Blocks that go through a recursion at once.
TOGETHER = 1 << 12


def _rows(part: pa.RecordBatch):
    """(rows, samples in order (samples, rows), polynomials (order + 1, rows)) of blocks of one length."""
    flat, size = part.column("s").flatten(), np.asarray(part.column("s").value_lengths())
    at, re = np.asarray(flat.field("at")), np.asarray(flat.field("re"))
    re = re[np.lexsort((at, np.repeat(np.arange(len(size)), size)))]
    start = np.cumsum(size) - size
    polys = np.asarray(part.column("poly").flatten(), dtype=float).reshape(len(size), -1)
    for n in np.unique(size):
        same = np.flatnonzero(size == n)
        for first in range(0, len(same), TOGETHER):
            rows = same[first : first + TOGETHER]
            yield rows, re[start[rows] + np.arange(n)[:, None]], polys[rows].T


def _all_pole(x: np.ndarray, poly: np.ndarray, past: np.ndarray) -> np.ndarray:
    """Each column of x through 1 / poly behind the outputs ``past`` (the last one first), with these in front (the first one first)."""
    order = len(poly) - 1
    out = np.concatenate([past[::-1], np.empty_like(x)])
    back = -poly[:0:-1]
    for i, v in enumerate(x):
        out[order + i] = v + (back * out[i : i + order]).sum(axis=0)
    return out


def _products(y: np.ndarray, order: int, size: int) -> np.ndarray:
    """(rows, ...): sums of products of samples 0 .. order before each of the last ``size`` ones."""
    lags = np.stack([y[order - k : order - k + size].T for k in range(order + 1)], axis=1)
    return (lags @ lags.swapaxes(1, 2)).reshape(y.shape[1], -1)


def poles(response: DataFrame, order: int, rounds: int = 10, keys: Keys = ("ch",), block: int = BLOCK, levels: int | None = None) -> DataFrame:
    """(*keys, i, re, im, error): the poles of the round with the least error, by
    size and angle; error is that of the allpass behind them, the energy that
    poles of this number leave.

    Channels begin at n = 0. Rounds that are not finite do not count; those whose
    sums are singular take the least solution. ``order`` is at most some 30.
    """
    with np.errstate(all="ignore"):
        return _poles(response, order, rounds, keys, block, levels)


def _poles(response: DataFrame, order: int, rounds: int, keys: Keys, block: int, levels: int | None) -> DataFrame:
    last = response.groupBy(*keys).agg(F.max("n").alias("last"))
    turned = response.join(last, list(keys)).select(*keys, (F.col("last") - F.col("n")).alias("n"), F.col("re").cast("double").alias("re"))
    at = F.pmod("n", F.lit(block).cast("long")).cast("int").alias("at")
    blocks = kept(turned.groupBy(*keys, F.floor(F.col("n") / block).alias("block")).agg(F.collect_list(F.struct(at, "re")).alias("s")))
    fields = [response.schema[k] for k in keys]
    array = lambda name: T.StructField(name, T.ArrayType(T.DoubleType()))
    block_field = T.StructField("block", T.LongType())
    numbers = pa.list_(pa.float64())

    def maps(it):
        for part in it:
            out = np.empty((part.num_rows, order * order + order))
            for rows, x, poly in _rows(part):
                last = lambda y: y[-1 : -order - 1 : -1]
                end = last(_all_pole(x, poly, np.zeros((order, len(rows)))))
                ends = [last(_all_pole(np.zeros_like(x), poly, np.repeat(unit[:, None], len(rows), axis=1))) for unit in np.eye(order)]
                out[rows] = np.concatenate([np.stack(ends, axis=1).reshape(order * order, -1), end]).T
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), part.column("block"), pa.array(list(out), numbers)], names=[*keys, "block", "map"])

    def sums(it):
        for part in it:
            out = np.empty((part.num_rows, (order + 1) ** 2))
            state = np.asarray(part.column("state").flatten(), dtype=float).reshape(part.num_rows, order)
            for rows, x, poly in _rows(part):
                out[rows] = _products(_all_pole(x, poly, state[rows].T), order, len(x))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(list(out), numbers)], names=[*keys, "g"])

    def solved(it):
        """The error of each polynomial, the best one so far, and the next."""
        for part in it:
            columns: dict[str, list] = {"poly": [], "best": [], "error": []}
            for row in part.select(["poly", "best", "error", "g"]).to_pylist():
                g, poly = np.array(row["g"]).reshape(order + 1, order + 1), np.array(row["poly"])
                error = float(poly[::-1] @ g @ poly[::-1])
                best, least = row["best"], row["error"]
                if np.isfinite(error) and poly[1:].any() and (least is None or error < least):
                    best, least = row["poly"], error
                if np.isfinite(g).all():
                    found = np.linalg.lstsq(g[:order, :order], -g[:order, order], rcond=1e-13)[0]
                    poly = np.append(1.0, found[::-1])
                for name, value in zip(columns, (poly.tolist(), best, least)):
                    columns[name].append(value)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(columns["poly"], numbers), pa.array(columns["best"], numbers), pa.array(columns["error"], pa.float64())], names=[*keys, *columns])

    state = last.select(*keys, F.array(F.lit(1.0), *[F.lit(0.0)] * order).alias("poly"), F.lit(None).cast("array<double>").alias("best"), F.lit(None).cast("double").alias("error"))
    for _ in range(rounds + 1):
        met = blocks.join(state.select(*keys, "poly"), list(keys))
        ends = met.mapInArrow(maps, T.StructType([*fields, block_field, array("map")]))
        begun = scans.folded(ends, keys, scans.Moved(order), np.zeros(order), levels=levels)
        parts = met.join(begun, [*keys, "block"]).mapInArrow(sums, T.StructType([*fields, array("g")]))
        total = parts.select(*keys, F.posexplode("g").alias("i", "g")).groupBy(*keys, "i").agg(F.sum("g").alias("g"))
        total = total.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "g"))), lambda v: v.g).alias("g"))
        state = kept(state.join(total, list(keys)).mapInArrow(solved, T.StructType([*fields, array("poly"), array("best"), T.StructField("error", T.DoubleType())])))

    def roots(it):
        for part in it:
            found = []
            for best in part.column("best").to_pylist():
                r = np.roots(best) if best is not None else np.zeros(0)
                r = r[np.lexsort((np.round(np.angle(r), 9), np.round(-np.abs(r), 9)))]
                found.append([{"re": float(p.real), "im": float(p.imag)} for p in r])
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(found, pa.list_(pa.struct([("re", pa.float64()), ("im", pa.float64())]))), part.column("error")], names=[*keys, "p", "error"])

    pair = T.ArrayType(T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())]))
    out = state.mapInArrow(roots, T.StructType([*fields, T.StructField("p", pair), T.StructField("error", T.DoubleType())]))
    return out.select(*keys, "error", F.posexplode("p").alias("i", "p")).select(*keys, "i", "p.re", "p.im", "error")
