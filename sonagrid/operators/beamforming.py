"""Beamforming: geometry, steering and maps as joins of small tables with spectra."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = tuple[str, ...]


def arrays(signal: DataFrame, size: int) -> DataFrame:
    """signal with array_id, and ch (0 .. size - 1) in it: each ``size`` channels in turn are an array."""
    return signal.withColumns({"array_id": F.floor(F.col("ch") / size), "ch": F.pmod("ch", F.lit(size).cast("long"))})


def shared_frames(spectra: DataFrame, keys: Keys = ("array_id",)) -> DataFrame:
    """The frames that all channels of an array have: means over other frames for
    each pair of channels would make a matrix that no signals can have."""
    has = spectra.select(*keys, "ch", "frame").distinct()
    all_ = has.groupBy(*keys).agg(F.countDistinct("ch").alias("__mics"))
    whole = has.groupBy(*keys, "frame").agg(F.count(F.lit(1)).alias("__there")).join(all_, list(keys)).where("__there = __mics")
    return spectra.join(whole.select(*keys, "frame"), [*keys, "frame"], "left_semi")


def _distance(a: str, b: str) -> Column:
    d = [F.col(f"{a}.{x}") - F.col(f"{b}.{x}") for x in "xyz"]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def distances(points: DataFrame, to: DataFrame) -> DataFrame:
    """(pid, mid, d): of all points (pid, x, y, z) to all of a set (pid, x, y, z)."""
    return points.alias("p").join(to.alias("m"), F.lit(True)).select(F.col("p.pid").alias("pid"), F.col("m.pid").alias("mid"), _distance("p", "m").alias("d"))


def nearest(points: DataFrame, x: float, y: float, z: float) -> DataFrame:
    """The point nearest to a place; the smallest pid of equals."""
    d = F.sqrt((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y) + (F.col("z") - z) * (F.col("z") - z))
    return points.agg(F.min(F.struct(d.alias("d"), "pid")).alias("b")).select("b.pid", "b.d")


def extent(points: DataFrame) -> DataFrame:
    return points.agg(*[f(x).alias(f"{n}_{x}") for x in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def aperture(mics: DataFrame) -> DataFrame:
    """(aperture, spacing): largest and smallest distance of two microphones of an array."""
    pairs = mics.alias("a").join(mics.alias("b"), F.col("a.pid") < F.col("b.pid"))
    return pairs.select(_distance("a", "b").alias("d")).agg(F.max("d").alias("aperture"), F.min("d").alias("spacing"))


def centre_microphone(mics: DataFrame) -> DataFrame:
    """(pid, d): the microphone nearest to the array's mean position."""
    mean = mics.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"))
    d = F.sqrt(sum(((F.col(a) - F.col("c" + a)) * (F.col(a) - F.col("c" + a)) for a in "xyz"), F.lit(0.0)))
    return mics.join(F.broadcast(mean), F.lit(True)).agg(F.min(F.struct(F.round(d, 12).alias("d"), "pid")).alias("b")).select("b.pid", "b.d")


def regular_grid(spark, xs: list[float], ys: list[float], z: float) -> DataFrame:
    """(pid, x, y, z) of a rectangle, row by row."""
    axis = lambda v, n: F.posexplode(F.array(*[F.lit(float(t)) for t in v])).alias("i" + n, n)
    g = spark.range(1).select(axis(ys, "y")).select("iy", "y", axis(xs, "x"))
    return g.select((F.col("iy") * len(xs) + F.col("ix")).cast("long").alias("pid"), "x", "y", F.lit(float(z)).alias("z"))


def steering(grid: DataFrame, mics: DataFrame, wave_number: float, kind: str = "true_location") -> DataFrame:
    """(pid, mid, re, im): weights of each microphone for each point.

    r is the distance to the microphone, r0 that to the array's centre
    microphone; the phase takes the delay of r - r0 back. Amplitudes by kind: 1/N (classic),
    r/(r0 N) (inverse), 1/(r r0 sum r**-2) (true_power), 1/(r sqrt(N sum r**-2)) (true_location).
    """
    d = distances(grid, mics)
    reference = distances(grid, mics.join(F.broadcast(centre_microphone(mics).select("pid")), "pid", "left_semi")).select("pid", F.col("d").alias("r0"))
    by = Window.partitionBy("pid")
    s = d.join(reference, "pid").withColumn("n", F.count(F.lit(1)).over(by)).withColumn("s", F.sum(1.0 / (F.col("d") * F.col("d"))).over(by))
    size = {
        "classic": 1.0 / F.col("n"),
        "inverse": F.col("d") / F.col("r0") / F.col("n"),
        "true_power": 1.0 / (F.col("d") * F.col("r0") * F.col("s")),
        "true_location": 1.0 / (F.col("d") * F.sqrt(F.col("n") * F.col("s"))),
    }[kind]
    phase = wave_number * (F.col("d") - F.col("r0"))
    return s.select("pid", "mid", (size * F.cos(phase)).alias("re"), (size * F.sin(phase)).alias("im"))


def _forms(csm: DataFrame, weights: DataFrame) -> DataFrame:
    """Entries i <= j of a matrix with both weights of every point, a + ib and c + id, and in
    ``term`` their part of h^H C h (the real part of conj(h_i) C_ij h_j, twice off the diagonal)."""
    i = weights.select("pid", F.col("mid").alias("ch_i"), F.col("re").alias("a"), F.col("im").alias("b"))
    j = weights.select("pid", F.col("mid").alias("ch_j"), F.col("re").alias("c"), F.col("im").alias("d"))
    term = F.expr("(re * (a * c + b * d) - im * (a * d - b * c)) * if(ch_i = ch_j, 1.0D, 2.0D)")
    return csm.join(i, "ch_i").join(j, ["pid", "ch_j"]).withColumn("term", term)


def delay_and_sum(csm: DataFrame, weights: DataFrame, remove_diagonal: bool = False, keys: Keys = ()) -> DataFrame:
    """(*keys, pid, power): h^H C h for each point, from (*keys, ch_i, ch_j, re, im) with i <= j and steering weights.

    Without the diagonal the sum is scaled by N / (N - 1), and negative powers are 0.
    Keys name arrays of the same shape.
    """
    both = _forms(csm, weights)
    term = F.when(F.col("ch_i") == F.col("ch_j"), F.lit(0.0)).otherwise(F.col("term")) if remove_diagonal else F.col("term")
    if not remove_diagonal:
        return both.groupBy(*keys, "pid").agg(F.sum(term).alias("power"))
    n = F.size(F.array_union(F.collect_set("ch_i"), F.collect_set("ch_j")))
    out = both.groupBy(*keys, "pid").agg(F.sum(term).alias("power"), n.alias("n"))
    return out.select(*keys, "pid", (F.greatest(F.lit(0.0), F.col("power")) * F.col("n") / (F.col("n") - 1)).alias("power"))


def monopole(signal: DataFrame, place: tuple[float, float, float], mics: DataFrame, rate_hz: int, c: float = 343.0, keys: Keys = ()) -> DataFrame:
    """(*keys, ch, n, re): a source's signal (*keys, n, re) at each microphone, later by whole samples and weaker by 1 / (1 + d)."""
    d = F.sqrt(sum(((F.col(a) - v) * (F.col(a) - v) for a, v in zip("xyz", place)), F.lit(0.0)))
    arrive = mics.select(F.col("pid").alias("ch"), F.round(d / c * rate_hz).cast("long").alias("late"), (1.0 / (1.0 + d)).alias("g"))
    return signal.join(arrive, F.lit(True)).select(*keys, "ch", (F.col("n") + F.col("late")).alias("n"), (F.col("re") * F.col("g")).alias("re"))


def helmholtz_to_hz(he: Column, aperture_m: Column, c: float = 343.0) -> Column:
    return he * c / aperture_m


def hz_to_helmholtz(f_hz: Column, aperture_m: Column, c: float = 343.0) -> Column:
    """Aperture over wave length."""
    return f_hz * aperture_m / c


def frequency_range(mics: DataFrame, least_he: float = 4.0, c: float = 343.0) -> DataFrame:
    """(low_hz, high_hz): where an array's aperture is least_he wave lengths, and where its spacing is half of one."""
    return aperture(mics).select((least_he * c / F.col("aperture")).alias("low_hz"), (c / (2 * F.col("spacing"))).alias("high_hz"))


def as_map(power: DataFrame, columns: int, keys: Keys = ()) -> DataFrame:
    """(*keys, row, values): a regular grid's map row by row, from (*keys, pid, power)."""
    row = F.floor(F.col("pid") / columns).alias("row")
    cells = power.groupBy(*keys, row).agg(F.sort_array(F.collect_list(F.struct("pid", "power"))).alias("v"))
    return cells.select(*keys, "row", F.transform("v", lambda x: x.power).alias("values"))


def line_grid(spark, start: tuple[float, float, float], end: tuple[float, float, float], points: int) -> DataFrame:
    """(pid, x, y, z): points at equal steps on a line."""
    share = F.col("id") / max(1, points - 1)
    return spark.range(points).select(F.col("id").alias("pid"), *[(F.lit(float(a)) + share * (b - a)).alias(n) for n, a, b in zip("xyz", start, end)])


def regular_box(spark, xs: list[float], ys: list[float], zs: list[float]) -> DataFrame:
    """(pid, x, y, z) of a box, plane by plane."""
    planes = spark.range(len(zs)).select(F.col("id").alias("iz"), F.get(F.array(*[F.lit(float(v)) for v in zs]), F.col("id").cast("int")).alias("z"))
    flat = regular_grid(spark, xs, ys, 0.0).drop("z")
    return planes.join(flat, F.lit(True)).select((F.col("iz") * (len(xs) * len(ys)) + F.col("pid")).alias("pid"), "x", "y", "z")


def wave_number(f_hz: float, c: float = 343.0) -> float:
    return 2 * pi * f_hz / c


#: Entries of matrices that are computed at once.
ENTRIES = 1 << 18


def _matrices(csm: DataFrame, change, schema: str, keys: Keys) -> DataFrame:
    """change(matrices, their microphones) -> columns, for each of keys and bin; a matrix has the size of the
    array squared. Matrices of one size (m, n, n) are changed together; columns are (m, rows of a matrix)."""
    import numpy as np
    import pyarrow as pa

    packed = csm.groupBy(*keys, "k").agg(F.collect_list(F.struct("ch_i", "ch_j", "re", "im")).alias("e")).select(*keys, "k", "e")

    def run(it):
        for batch in it:
            flat, lists = batch.column("e").flatten(), batch.column("e").value_lengths()
            i, j, re, im = (np.asarray(flat.field(c)) for c in ("ch_i", "ch_j", "re", "im"))
            row = np.repeat(np.arange(batch.num_rows), np.asarray(lists))
            # the microphones of each matrix in order, and the place of an entry's two among them
            ids, code = np.unique(np.concatenate([i, j]), return_inverse=True)
            there, at = np.unique(np.tile(row, 2) * len(ids) + code, return_inverse=True)
            mics, size = ids[there % len(ids)], np.bincount(there // len(ids), minlength=batch.num_rows)
            start = np.cumsum(size) - size
            i, j = np.split(at - start[np.tile(row, 2)], 2)
            for n in np.unique(size):
                same = np.flatnonzero(size == n)
                step = max(1, ENTRIES // int(n * n))
                for first in range(0, len(same), step):
                    rows = same[first : first + step]
                    line = np.full(batch.num_rows, -1)
                    line[rows] = np.arange(len(rows))
                    own = line[row] >= 0
                    c = np.zeros((len(rows), n, n), dtype=complex)
                    c[line[row[own]], i[own], j[own]] = re[own] + 1j * im[own]
                    c[line[row[own]], j[own], i[own]] = re[own] - 1j * im[own]
                    columns = change(c, mics[start[rows][:, None] + np.arange(n)])
                    take = pa.array(np.repeat(rows, next(iter(columns.values())).shape[1]))
                    kept = [batch.column(x).take(take) for x in (*keys, "k")]
                    yield pa.RecordBatch.from_arrays([*kept, *(pa.array(np.ascontiguousarray(v).ravel()) for v in columns.values())], names=[*keys, "k", *columns])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in csm.select(*keys, "k").schema.fields)
    return packed.mapInArrow(run, f"{kept}, {schema}")


def _upper(c, there) -> dict:
    import numpy as np

    i, j = np.triu_indices(there.shape[1])
    return {"ch_i": there[:, i], "ch_j": there[:, j], "re": c[:, i, j].real, "im": c[:, i, j].imag}


def mvdr(csm: DataFrame, weights: DataFrame, loading: float = 1e-6, keys: Keys = ()) -> DataFrame:
    """(*keys, pid, power): 1 / (h^H C^-1 h), the diagonal loaded by a share of its mean, summed over bins.
    Each bin's small matrix is inverted; its form with every point's weights is a join and a sum."""
    import numpy as np

    def inverse(c, there):
        n = there.shape[1]
        mean = np.trace(c, axis1=1, axis2=2).real / n
        return _upper(np.linalg.inv(c + np.eye(n) * (loading * mean)[:, None, None]), there)

    forms = delay_and_sum(_matrices(csm, inverse, "ch_i long, ch_j long, re double, im double", keys), weights, keys=(*keys, "k"))
    return forms.groupBy(*keys, "pid").agg(F.sum(1 / F.col("power")).alias("power"))


def functional(csm: DataFrame, weights: DataFrame, gamma: float = 10.0, keys: Keys = (), scaled: bool = False) -> DataFrame:
    """(*keys, pid, power): (h^H C^(1/gamma) h / l)^gamma, times l where scaled, summed over bins. l is
    h^H h over the microphones that the matrix of these keys and this bin has."""
    import numpy as np

    def root(c, there):
        w, v = np.linalg.eigh(c)
        return _upper((v * (np.maximum(w, 0) ** (1 / gamma))[:, None, :]) @ v.conj().swapaxes(1, 2), there)

    roots = _matrices(csm, root, "ch_i long, ch_j long, re double, im double", keys)
    own = F.when(F.col("ch_i") == F.col("ch_j"), F.expr("a * a + b * b"))
    forms = _forms(roots, weights).groupBy(*keys, "k", "pid").agg(F.sum("term").alias("form"), F.sum(own).alias("l"))
    return forms.groupBy(*keys, "pid").agg(F.sum(F.pow(F.greatest(F.col("form"), F.lit(0.0)) / F.col("l"), gamma) * (F.col("l") if scaled else F.lit(1.0))).alias("power"))


def orthogonal(csm: DataFrame, weights: DataFrame, leading: int, keys: Keys = ()) -> DataFrame:
    """(*keys, pid, power): each bin's leading eigenvectors put their eigenvalues (over the number of
    microphones) at the points of their own maps' maxima, the smallest pid of equals; other points have 0."""
    import numpy as np

    def vectors(c, there):
        w, v = np.linalg.eigh(c)
        m, n = there.shape
        best = np.arange(n)[::-1][:leading]  # eigh's are in rising order
        by_vector = lambda x: np.broadcast_to(x, (m, len(best), n)).reshape(m, -1)
        parts = v[:, :, best].swapaxes(1, 2).reshape(m, -1)
        e = np.arange(len(best), dtype=np.int32)[None, :, None]
        return {"e": by_vector(e), "value": by_vector(w[:, best, None] / n), "mid": by_vector(there[:, None, :]), "c": parts.real, "d": parts.imag}

    parts = _matrices(csm, vectors, "e int, value double, mid long, c double, d double", keys)
    by = (*keys, "k", "e", "value")
    maps = parts.join(weights, "mid").groupBy(*by, "pid").agg(F.sum(F.expr("re * c + im * d")).alias("a"), F.sum(F.expr("re * d - im * c")).alias("b"))
    top = maps.groupBy(*by).agg(F.max(F.struct(F.round(F.expr("a * a + b * b"), 12).alias("m"), (-F.col("pid")).alias("p"))).alias("t"))
    found = top.select(*keys, (-F.col("t.p")).alias("pid"), F.col("value").alias("power"))
    everywhere = csm.select(*keys).distinct().join(weights.select("pid").distinct(), F.lit(True)).select(*keys, "pid", F.lit(0.0).alias("power"))
    return found.unionByName(everywhere).groupBy(*keys, "pid").agg(F.sum("power").alias("power"))


def _coherent(share: float, remove_diagonal: bool, inner: int):
    """One round of CLEAN-SC on packed rows of matrices: the part h of the field that is
    coherent with the loudest point, and the matrix without ``share`` of it."""
    import numpy as np
    import pyarrow as pa

    def run(it):
        for batch in it:
            columns = {name: [] for name in ("re", "im", "norm", "open", "h_re", "h_im", "peak")}
            for row in batch.select(["mics", "re", "im", "norm", "peak", "w"]).to_pylist():
                n = len(row["mics"])
                d = (np.array(row["re"]) + 1j * np.array(row["im"])).reshape(n, n)
                by = {v["mid"]: complex(v["re"], v["im"]) for v in row["w"]}
                w = np.array([by.get(m, 0j) for m in row["mics"]])
                now = np.abs(d).sum(axis=0).max() if n else 0.0
                peak, h = row["peak"], np.zeros(n, dtype=complex)
                going = row["norm"] is None or now < row["norm"]
                if going and peak != 0:
                    u = d @ w / peak
                    h = w if inner else u
                    for _ in range(inner):
                        own = np.abs(h) ** 2
                        h = (u + own * w) / np.sqrt(1 + own @ np.abs(w) ** 2)
                    g = peak * np.outer(h, h.conj())
                    if remove_diagonal:
                        np.fill_diagonal(g, 0)
                    d = d - share * g
                for name, value in zip(columns, (d.real.ravel().tolist(), d.imag.ravel().tolist(), now, bool(going and peak != 0), h.real.tolist(), h.imag.tolist(), peak)):
                    columns[name].append(value)
            kinds = dict.fromkeys(("re", "im", "h_re", "h_im"), pa.list_(pa.float64())) | {"norm": pa.float64(), "peak": pa.float64(), "open": pa.bool_()}
            kept = [c for c in batch.schema.names if c not in ("re", "im", "norm", "peak", "w")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(v, kinds[c]) for c, v in columns.items())], names=[*kept, *columns])

    return run


def clean_sc(csm: DataFrame, weights: DataFrame, iterations: int | None = None, share: float = 0.5, remove_diagonal: bool = False, keys: Keys = (), inner: int | None = None) -> DataFrame:
    """(*keys, pid, power): sources taken one by one with all that is coherent with them,
    summed over bins, by CLEAN-SC (Sijtsma 2007).

    Rounds (twice as many as microphones at most) go over tables of all arrays
    and bins: a packed matrix for each, and a map with a row for each point. In a
    round the loudest point of each map (the smallest pid of equals) gets
    ``share`` of its power; its coherent part leaves the matrix and, as a product
    with every point's weights, the map. A matrix rests once its norm (the
    largest column sum) does not fall. The coherent part is C h / power; where
    the diagonal is removed, ``inner`` steps (20) find the one without it. Tables
    of a round are checkpoints.
    """
    from sonagrid.state import kept

    by, inner = (*keys, "k"), (20 if remove_diagonal else 0) if inner is None else inner
    turned = csm.select(*by, F.col("ch_j").alias("i"), F.col("ch_i").alias("j"), "re", (-F.col("im")).alias("im")).where("i <> j")
    entries = csm.select(*by, F.col("ch_i").alias("i"), F.col("ch_j").alias("j"), "re", "im").unionByName(turned)
    if remove_diagonal:
        entries = entries.withColumns({c: F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.col(c)) for c in ("re", "im")})
    packed = entries.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("i", "j", "re", "im"))).alias("e"), F.array_sort(F.collect_set("i")).alias("mics"))
    matrices = kept(packed.select(*by, "mics", F.transform("e", lambda x: x.re).alias("re"), F.transform("e", lambda x: x.im).alias("im"), F.lit(None).cast("double").alias("norm")))
    points = kept(weights.groupBy("pid").agg(F.collect_list(F.struct("mid", "re", "im")).alias("w")))
    maps = kept(delay_and_sum(csm.where("ch_i <> ch_j") if remove_diagonal else csm, weights, keys=by).select(*by, "pid", "power"))
    most = F.lit(iterations) if iterations is not None else 2 * F.size("mics")  # of each matrix, whatever others have
    if iterations is None:
        iterations = 2 * (matrices.agg(F.max(F.size("mics"))).first()[0] or 0)
    kinds = {f.name: f.dataType.simpleString() for f in matrices.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*by, "mics")) + ", pid long, re array<double>, im array<double>, norm double, open boolean, h_re array<double>, h_im array<double>, peak double"
    found = None
    for turn in range(iterations):
        top = maps.groupBy(*by).agg(F.max(F.struct("power", (-F.col("pid")).alias("p"))).alias("t")).select(*by, F.col("t.power").alias("peak"), (-F.col("t.p")).alias("pid"))
        now = kept(matrices.join(top, list(by)).join(points, "pid").select(*by, "mics", "pid", "re", "im", "norm", "peak", "w").mapInArrow(_coherent(share, remove_diagonal, inner), schema))
        taken = now.select(*keys, "pid", (share * F.col("peak")).alias("power"))
        found = taken if found is None else found.unionByName(taken)
        going = now.where(F.col("open") & (most > turn + 1))
        if going.isEmpty():
            break
        matrices = going.select(*by, "mics", "re", "im", "norm")
        part = going.select(*by, "peak", F.map_from_entries(F.arrays_zip("mics", F.arrays_zip("h_re", "h_im"))).alias("h"))
        part = part.withColumn("h", F.expr("transform_values(h, (m, v) -> named_struct('re', v.h_re, 'im', v.h_im))"))
        met = maps.join(part, list(by)).join(points, "pid")
        sums = F.expr(
            "aggregate(filter(w, x -> h[x.mid] is not null), named_struct('a', 0.0D, 'b', 0.0D, 'own', 0.0D), (s, x) -> named_struct("
            "'a', s.a + h[x.mid].re * x.re + h[x.mid].im * x.im, 'b', s.b + h[x.mid].re * x.im - h[x.mid].im * x.re, "
            "'own', s.own + (h[x.mid].re * h[x.mid].re + h[x.mid].im * h[x.mid].im) * (x.re * x.re + x.im * x.im)))"
        )
        own = F.col("s.own") if remove_diagonal else F.lit(0.0)
        lost = share * F.col("peak") * (F.col("s.a") * F.col("s.a") + F.col("s.b") * F.col("s.b") - own)
        maps = kept(met.withColumn("s", sums).select(*by, "pid", (F.col("power") - lost).alias("power")))
    everywhere = csm.select(*keys).distinct().join(weights.select("pid").distinct(), F.lit(True)).select(*keys, "pid", F.lit(0.0).alias("power"))
    both = everywhere if found is None else found.unionByName(everywhere)
    return both.groupBy(*keys, "pid").agg(F.sum("power").alias("power"))


def delay_and_sum_time(signal: DataFrame, grid: DataFrame, mics: DataFrame, rate_hz: int, c: float = 343.0, keys: Keys = ()) -> DataFrame:
    """(*keys, pid, n, re): for each point the microphones, shifted by whole samples to the
    farthest distance and scaled by their distance, averaged."""
    d = distances(grid, mics)
    far = F.max("d").over(Window.partitionBy("pid"))
    shift = d.withColumn("late", F.round((far - F.col("d")) / c * rate_hz).cast("long")).withColumn("w", F.col("d") / F.count(F.lit(1)).over(Window.partitionBy("pid")))
    both = signal.join(shift.withColumnRenamed("mid", "ch"), "ch")
    return both.groupBy(*keys, "pid", (F.col("n") + F.col("late")).alias("n")).agg(F.sum(F.col("re") * F.col("w")).alias("re"))
