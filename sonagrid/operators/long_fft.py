"""Transforms of channels of any length, without a row that holds one.

A transform of N = A B samples is two rounds of short ones (the four-step way):
with n = a B + b and k = c + A d, the columns b are transformed over a, each
value is turned by exp(-2 pi i b c / N), and the rows c are transformed over b.
Each round is one shuffle, and its rows have A or B values, about the square root
of N. Lengths without a divisor near their root are transformed as a chirp
(Bluestein): three transforms of a power of two. Channels differ in length, so
A, B and the way are columns; a channel of up to WHOLE samples is one column.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Keys = tuple[str, ...]

#: Samples of a channel that one row may hold (256 kB), and a round's row at most; longer ones go in two rounds.
WHOLE = 1 << 14

#: How a channel is transformed.
PLAN = ("size", "a", "b", "padded")


def two_factors(n: int, most: int) -> tuple[int, int]:
    """(A, B) with A * B = n, A the largest divisor up to the root, and B up to ``most``; (0, 0) if there is none."""
    if n <= most:
        return n, 1
    for a in range(isqrt(n), 0, -1):
        if n % a == 0:
            return (a, n // a) if n // a <= most else (0, 0)
    return 0, 0


def _plans(lengths: DataFrame, keys: Keys, whole: int) -> DataFrame:
    """(*keys, size, a, b, padded): how each channel is transformed; padded is the chirp's length, or 0."""

    def run(it):
        for batch in it:
            found = []
            for n in batch.column("size").to_pylist():
                a, b = two_factors(n, whole)
                padded = 0 if a else 1 << (2 * n - 1 - 1).bit_length()
                if padded:
                    a, b = two_factors(padded, max(whole, 1 << (padded.bit_length() // 2 + 1)))
                found.append((a, b, padded))
            columns = [pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "a", "b", "padded"])

    long = [T.StructField(x, T.LongType()) for x in ("size", "a", "b", "padded")]
    return lengths.mapInArrow(run, T.StructType([*(lengths.schema[k] for k in keys), *long]))


def _short(keys: Keys, group: str, by: str, size: str, sign: float):
    """Transforms of packed rows: (*keys, group, s) with s of (at, re, im) to a row for each of ``size`` outputs."""

    def run(it):
        for batch in it:
            at = 0
            count = np.asarray(batch.column(size), dtype=np.int64)
            while at < batch.num_rows:
                # rows of one length, some 2^18 values at once
                n = int(count[at])
                to = at + 1
                while to < batch.num_rows and count[to] == n and (to - at + 1) * n <= 1 << 18:
                    to += 1
                part = batch.slice(at, to - at)
                lists = part.column("s")
                flat = lists.flatten()
                row = np.repeat(np.arange(to - at), np.asarray(lists.value_lengths()))
                x = np.zeros((to - at, n), dtype=complex)
                x[row, np.asarray(flat.field("at"), dtype=np.int64)] = np.asarray(flat.field("re")) + 1j * np.asarray(flat.field("im"))
                yield _outputs(part, (*keys, group, *PLAN), by, np.fft.fft(x, axis=1) if sign < 0 else np.fft.ifft(x, axis=1) * n)
                at = to

    return run


def _outputs(part: pa.RecordBatch, kept: Keys, by: str, y: np.ndarray) -> pa.RecordBatch:
    """(kept, by, re, im): a row for each value of y, whose lines belong to the rows of part."""
    take = pa.array(np.repeat(np.arange(len(y)), y.shape[1]))
    columns = [part.column(c).take(take) for c in kept]
    flat = y.ravel()
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.tile(np.arange(y.shape[1]), len(y))), pa.array(flat.real.copy()), pa.array(flat.imag.copy())], names=[*kept, by, "re", "im"])


def _kernels(keys: Keys, sign: float):
    """Transforms of the chirp's columns: (*keys, column, plan) to a row for each of ``a`` outputs."""

    def run(it):
        for batch in it:
            for at in range(batch.num_rows):
                part = batch.slice(at, 1)
                column, size, a, b, padded = (part.column(c)[0].as_py() for c in ("column", *PLAN))
                n = np.arange(a) * b + column
                lag = np.where(n < size, n, n - padded)
                x = np.where(lag > -size, np.exp(-1j * sign * np.pi * (lag * lag % (2 * size)) / size), 0)
                yield _outputs(part, (*keys, "column", *PLAN), "row", np.fft.fft(x)[None, :])

    return run


def _round_schema(rows: DataFrame, keys: Keys, group: str, by: str) -> T.StructType:
    long = [T.StructField(x, T.LongType()) for x in (group, *PLAN, by)]
    return T.StructType([*(rows.schema[k] for k in keys), *long, T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])


def _first(rows: DataFrame, keys: Keys, sign: float) -> DataFrame:
    """(*keys, column, plan, row, re, im): transformed columns of (*keys, plan, n, re, im) of length a * b."""
    columns = rows.groupBy(*keys, *PLAN, F.pmod("n", F.col("b")).alias("column")).agg(F.collect_list(F.struct(F.floor(F.col("n") / F.col("b")).alias("at"), "re", "im")).alias("s"))
    return columns.select(*keys, "column", *PLAN, "s").mapInArrow(_short(keys, "column", "row", "a", sign), _round_schema(rows, keys, "column", "row"))


def _second(first: DataFrame, keys: Keys, sign: float) -> DataFrame:
    """(*keys, size, padded, k, re, im) from transformed columns."""
    turn = F.lit(sign * 2 * np.pi) * F.pmod(F.col("column") * F.col("row"), F.col("a") * F.col("b")) / (F.col("a") * F.col("b"))
    lines = _turned(first, turn).groupBy(*keys, *PLAN, "row").agg(F.collect_list(F.struct(F.col("column").alias("at"), "re", "im")).alias("s")).select(*keys, "row", *PLAN, "s")
    second = lines.mapInArrow(_short(keys, "row", "d", "b", sign), _round_schema(first, keys, "row", "d"))
    return second.select(*keys, "size", "padded", (F.col("row") + F.col("a") * F.col("d")).alias("k"), "re", "im")


def _rounds(rows: DataFrame, keys: Keys, sign: float) -> DataFrame:
    """(*keys, size, padded, k, re, im): transforms of (*keys, size, a, b, padded, n, re, im) of length a * b > a."""
    return _second(_first(rows, keys, sign), keys, sign)


def _turned(rows: DataFrame, angle: Column) -> DataFrame:
    """re and im times exp(i angle)."""
    c, s = F.cos(angle), F.sin(angle)
    return rows.withColumns({"re": F.col("re") * c - F.col("im") * s, "im": F.col("re") * s + F.col("im") * c})


def fft(signal: DataFrame, keys: Keys = ("ch",), inverse: bool = False, length: int | None = None, whole: int = WHOLE) -> DataFrame:
    """(*keys, k, re, im), all N bins of channels (*keys, n, re and, if complex, im).

    N is a channel's last n and one, or ``length`` for all (zeros are added;
    samples beyond it are left out). The inverse has n in place of k and 1 / N.
    """
    if "im" not in signal.columns:
        signal = signal.withColumn("im", F.lit(0.0))
    rows = signal.select(*keys, F.col("k" if inverse else "n").cast("long").alias("n"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    if length is None:
        lengths = rows.groupBy(*keys).agg((F.max("n") + 1).alias("size"))
    else:
        rows = rows.where(F.col("n") < length)
        lengths = rows.select(*keys).distinct().withColumn("size", F.lit(length).cast("long"))
    sign = 1.0 if inverse else -1.0
    plans = _plans(lengths, keys, whole)
    both = rows.join(plans, list(keys))
    one = _first(both.where("padded = 0 and b = 1"), keys, sign).select(*keys, F.col("row").alias("k"), "re", "im", "size")
    two = _rounds(both.where("padded = 0 and b > 1"), keys, sign).select(*keys, "k", "re", "im", "size")
    # a chirp: nk = (n^2 + k^2 - (k - n)^2) / 2, so the transform is a convolution with exp(-sign i pi n^2 / N)
    square = lambda n: F.lit(sign * np.pi) * F.pmod(n * n, 2 * F.col("size")) / F.col("size")
    there = _rounds(_turned(both.where("padded > 0"), square(F.col("n"))), keys, -1.0)
    # the kernel's columns are dealt out before they are computed: a channel's kernel has more values than the channel
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = plans.where("padded > 0").select(*keys, F.explode(F.expr("sequence(0L, b - 1)")).alias("column"), *PLAN).repartition(parts, *keys, "column")
    h = _second(columns.mapInArrow(_kernels(keys, sign), _round_schema(columns, keys, "column", "row")), keys, -1.0)
    # both are as long as the padded channel, whatever the optimizer expects of a kernel that comes from one row: no broadcast
    met = there.join(h.select(*keys, "k", F.col("re").alias("hr"), F.col("im").alias("hi")).hint("merge"), [*keys, "k"]).select(*keys, F.col("k").alias("n"), F.expr("re * hr - im * hi").alias("re"), F.expr("re * hi + im * hr").alias("im"))
    back = _rounds(met.join(plans, list(keys)), keys, 1.0).where("k < size")
    back = _turned(back.withColumns({"re": F.col("re") / F.col("padded"), "im": F.col("im") / F.col("padded")}), square(F.col("k"))).select(*keys, "k", "re", "im", "size")
    direct = one.unionByName(two)
    out = direct.unionByName(back)
    if not inverse:
        return out.drop("size")
    return out.select(*keys, F.col("k").alias("n"), (F.col("re") / F.col("size")).alias("re"), (F.col("im") / F.col("size")).alias("im"))


def spectrum(signal: DataFrame, rate_hz: int = 1, keys: Keys = ("ch",), whole: int = WHOLE) -> DataFrame:
    """(*keys, k, f_hz, re, im): bins 0 to N / 2 of real channels."""
    size = signal.groupBy(*keys).agg((F.max("n") + 1).alias("size"))
    out = fft(signal, keys, whole=whole).join(size, list(keys)).where(F.col("k") <= F.floor(F.col("size") / 2))
    return out.select(*keys, F.col("k").cast("int").alias("k"), (F.col("k") / (F.col("size") / F.lit(float(rate_hz)))).alias("f_hz"), "re", "im")


def analytic(signal: DataFrame, keys: Keys = ("ch",), whole: int = WHOLE) -> DataFrame:
    """(*keys, n, re, im): the signal without its negative frequencies."""
    size = signal.groupBy(*keys).agg((F.max("n") + 1).alias("size"))
    s = fft(signal, keys, whole=whole).join(size, list(keys))
    gain = F.when((F.col("k") == 0) | (2 * F.col("k") == F.col("size")), 1.0).when(2 * F.col("k") < F.col("size"), 2.0).otherwise(0.0)
    # all bins stay, so that the inverse has the channel's length
    return fft(s.select(*keys, "k", (F.col("re") * gain).alias("re"), (F.col("im") * gain).alias("im")), keys, inverse=True, whole=whole)


def envelope(signal: DataFrame, keys: Keys = ("ch",), whole: int = WHOLE) -> DataFrame:
    """(*keys, n, re): the analytic signal's magnitude, for channels of any length."""
    return analytic(signal, keys, whole).select(*keys, "n", F.sqrt(F.expr("re * re + im * im")).alias("re"))


def convolved(signal: DataFrame, response: DataFrame, keys: Keys = ("ch",), whole: int = WHOLE) -> DataFrame:
    """(*keys, n, re): each channel with the response (*keys, n, re) of its keys, both of any length; whole (no sample is cut)."""
    sizes = lambda df, name: df.groupBy(*keys).agg((F.max("n") + 1).alias(name))
    size = sizes(signal, "x").join(sizes(response, "h"), list(keys)).select(*keys, (F.col("x") + F.col("h") - 1).alias("m"))
    # a zero at the last place makes both as long as the result
    longer = lambda df: df.select(*keys, "n", "re").unionByName(size.select(*keys, (F.col("m") - 1).alias("n"), F.lit(0.0).alias("re"))).groupBy(*keys, "n").agg(F.sum("re").alias("re"))
    a, b = (fft(longer(df), keys, whole=whole) for df in (signal, response))
    met = a.join(b.withColumnsRenamed({"re": "hr", "im": "hi"}), [*keys, "k"]).select(*keys, "k", F.expr("re * hr - im * hi").alias("re"), F.expr("re * hi + im * hr").alias("im"))
    return fft(met, keys, inverse=True, whole=whole).select(*keys, "n", "re")
