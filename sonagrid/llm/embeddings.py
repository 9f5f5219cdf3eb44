"""Embedding near-dedup with collision-counting projections.

Vectors are scaled to length 1 and projected on many random Gaussian
directions. A pair of cosine c is sqrt(2 - 2c) apart, so its difference along
one direction is normal with that deviation: for a pair at the threshold the
chance of falling in a query-centred window of a given width, and from it the
number of collisions that all but a fraction ``miss`` of such pairs reach, are
known beforehand. Pairs that reach the count are verified exactly.

Counting collisions of all pairs of a label would grow with the square of the
label, so the sorted projections are first cut in slabs: ``tables`` times, rows
with the same label and the same slab on each of ``width`` directions meet in a
cell. A threshold pair shares a direction's slab with known chance, so the
number of tables that finds all but ``miss`` of them is known too. ``width``
grows with the logarithm of the label's size, which keeps a vector's company
bounded while its copies grow slowly (about n ** 0.25).

Inside cells the windows are counted over sorted projections: small cells are
bundled, so that one sort serves many of them, and large ones are cut in blocks.
A pair counts in the first table where it meets only, so a bundle returns for
each vector a number of links and one edge of a spanning forest, never pairs.
Equal vectors of a label are one entry with a multiplicity and a number of its
own, so ids may be repeated or null.
"""

from __future__ import annotations

from math import comb, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonagrid.llm.common import connected_components, dropped, join_by_key, written

SLAB = 1.2
WINDOW = 0.6
COUNTERS = 24
BLOCK = 2048
#: Pairs that are counted at once, and rows of a label for each bundle of its cells.
PAIRS, BUNDLE = 1 << 20, 256
#: Directions of a table at most; a label would need 10 ** 11 vectors to want more.
WIDEST = 20


def _same_slab(distance: float) -> float:
    """Chance that two vectors at this distance share a direction's slab."""
    x = SLAB / distance
    return erf(x / sqrt(2)) - 2 / (sqrt(2 * pi) * x) * (1 - exp(-x * x / 2))


def widths() -> list[int]:
    """Sizes of a label above which one more direction is used: entry k is for width k + 2."""
    return [round(64 * _same_slab(sqrt(2)) ** -(w - 0.5)) for w in range(2, WIDEST + 1)]


def plan(cosine: float, width: int, miss: float = 1e-3) -> dict:
    """Number of tables of ``width`` directions, collisions to reach."""
    near = sqrt(2 - 2 * cosine)
    tables = max(1, int(np.ceil(log(miss) / log(1 - _same_slab(near) ** width))))
    hit = erf(WINDOW / near / sqrt(2))
    chance, count = 0.0, 0
    while chance + comb(COUNTERS, count) * hit**count * (1 - hit) ** (COUNTERS - count) <= miss:
        chance += comb(COUNTERS, count) * hit**count * (1 - hit) ** (COUNTERS - count)
        count += 1
    return {"width": width, "tables": tables, "count": count}


def _directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def _slabs(unit: np.ndarray, width: int, tables: int) -> np.ndarray:
    """A cell number for each vector (row) and table (column)."""
    shift = np.random.default_rng(11).random(width * tables) * SLAB
    p = np.floor((unit @ _directions(unit.shape[1], width * tables, 7) + shift) / SLAB).astype(np.int64)
    p = p.reshape(len(unit), tables, width).astype(np.uint64)
    weight = np.random.default_rng(13).integers(1, 1 << 62, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return (p * weight).sum(axis=2, dtype=np.uint64).view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.asarray(x.values, dtype=float) for x in column]) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(cosine: float, miss: float):
    def run(it):
        for batch in it:
            dims, wide = np.asarray(batch.column("dim")), np.asarray(batch.column("width"))
            for dim, width in np.unique(np.stack([dims, wide], axis=1), axis=0):
                tables = plan(cosine, int(width), miss)["tables"]
                mine = batch.take(pa.array(np.flatnonzero((dims == dim) & (wide == width))))
                for a in range(0, mine.num_rows, BLOCK):
                    part = mine.slice(a, BLOCK)
                    cells = _slabs(_unit(_matrix(part.column("embedding"))), int(width), tables)
                    row = pa.array(np.repeat(np.arange(part.num_rows), tables))
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(x).take(row) for x in ("c", "label", "dim", "width", "bundles")), pa.array(np.tile(np.arange(tables, dtype=np.int32), part.num_rows)), pa.array(cells.ravel())],
                        names=["c", "label", "dim", "width", "bundles", "t", "cell"],
                    )

    return run


def _windows(p: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank, begin, end) of each row on each sorted projection: rows with a rank from
    begin to end are in its window. Cells lie apart on the line, so one sort serves all."""
    rank = np.empty(p.shape, dtype=np.int32)
    begin, end = np.empty_like(rank), np.empty_like(rank)
    apart = cell * (2 * np.abs(p).max(initial=1.0) + 2 * WINDOW)
    for j in range(p.shape[1]):
        at = p[:, j] + apart
        by = np.argsort(at, kind="stable")
        rank[by, j] = np.arange(len(at))
        begin[:, j] = np.searchsorted(at[by], at - WINDOW, "left")
        end[:, j] = np.searchsorted(at[by], at + WINDOW, "right")
    return rank, begin, end


def _links(cosine: float, miss: float):
    """For a bundle of cells of one label and dimension, or two blocks of a cell: links by vector."""

    def run(table: pa.Table) -> pa.Table:
        how = plan(cosine, table["width"][0].as_py(), miss)
        width, tables, count = how["width"], how["tables"], how["count"]
        lo, hi = (table[x][0].as_py() for x in ("lo", "hi"))
        ids, t, cell, block = (np.asarray(table[x], dtype=np.int64) for x in ("c", "t", "cell", "block"))
        order = np.lexsort((ids, block != lo, cell, t))
        ids, t, cell, block = ids[order], t[order], cell[order], block[order]
        times = np.asarray(table["times"], dtype=np.int64)[order]
        unit = _unit(_matrix(table["embedding"].combine_chunks().take(pa.array(order))))
        cells = _slabs(unit, width, tables)
        new = np.append(True, (t[1:] != t[:-1]) | (cell[1:] != cell[:-1]))
        group = np.cumsum(new) - 1
        stop = np.append(np.flatnonzero(new)[1:], len(ids))[group]
        rank, begin, end = _windows(unit @ _directions(unit.shape[1], COUNTERS, 17), group)
        # partners of a row are those behind it in its cell, or all of the other block
        start = np.arange(len(ids)) + 1
        if lo != hi:
            start = np.where(block == lo, np.flatnonzero(new)[group] + np.bincount(group, block == lo).astype(np.int64)[group], stop)
        partners = stop - start
        before = np.append(0, np.cumsum(partners))
        links, root = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        row = 0
        while row < len(ids):
            last = max(row + 1, int(np.searchsorted(before, before[row] + PAIRS, "right")) - 1)
            i = np.repeat(np.arange(row, last), partners[row:last])
            k = np.arange(len(i)) + np.repeat(start[row:last] - (before[row:last] - before[row]), partners[row:last])
            hits = np.zeros(len(i), dtype=np.int8)
            for j in range(COUNTERS):
                r = rank[k, j]
                hits += (begin[i, j] <= r) & (r < end[i, j])
            near = hits >= count
            i, k = i[near], k[near]
            ok = np.einsum("ij,ij->i", unit[i], unit[k]) >= cosine
            i, k = i[ok], k[ok]
            ok = ~((cells[i] == cells[k]) & (np.arange(tables) < t[i][:, None])).any(axis=1)
            i, k = i[ok], k[ok]
            np.add.at(links, i, times[k])
            np.add.at(links, k, times[i])
            while True:  # join the trees of linked vectors, smaller roots win
                a, b = root[i], root[k]
                if (a == b).all():
                    break
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                root = root[root]
                while (root != root[root]).any():
                    root = root[root]
            row = last
        some = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
        return pa.table({"c": ids[some], "links": links[some], "root": ids[root[some]]})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", miss: float = 1e-3) -> DataFrame:
    """id_col, n_links, component_id, kept for each row of vectors.

    Rows link when their labels are equal and not null and the cosine is at
    least ``cosine``; a link missed has a chance of about ``2 * miss`` at the
    threshold and less above it. Vectors that are null, empty, zero or hold a
    null or non-finite component link with nothing, nor do vectors of different
    dimensions. Equal vectors link with each other. Repeated ids count as rows,
    whatever their vectors and labels. Rows with a null id link like any other;
    component_id is the smallest id reachable that is not null, null if there is
    none, and they are never kept. Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).alias("label"))
    good = (
        F.col("label").isNotNull()
        & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
        & ~F.coalesce(F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    )
    same = rows.where(good).groupBy("label", "embedding").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("times"))
    # the number of a class is fixed once its table is written
    classes = written(same.select("*", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("c")), "vectors")
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size"))
    steps = F.array(*[F.lit(x).cast("long") for x in widths()])
    sizes = written(sizes.select("*", (F.size(F.filter(steps, lambda x: F.col("size") > x)) + 1).alias("width"), F.ceil(F.col("size") / BUNDLE).alias("bundles")), "labels")
    wide = join_by_key(classes, sizes, ["label", "dim"], "size")
    wide = wide.select("c", "label", "dim", "width", "bundles", "embedding")
    schema = T.StructType([*wide.schema.fields[:5], T.StructField("t", T.IntegerType()), T.StructField("cell", T.LongType())])
    cell = written(wide.mapInArrow(_cells(cosine, miss), schema), "cells")
    keys = ["label", "dim", "width", "t", "cell"]
    many = cell.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    many = written(many.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), "crowded")
    spread = join_by_key(cell, many, keys, "size")
    spread = spread.withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bundle = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("t", "cell"), F.col("bundles"))).otherwise(F.xxhash64("t", "cell"))
    spread = spread.select("c", *keys, bundle.alias("bundle"), "block", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"))
    full = spread.join(classes.select("c", "embedding", "times"), "c")
    found = full.groupBy("label", "dim", "width", "bundle", "lo", "hi").applyInArrow(_links(cosine, miss), "c long, links long, root long")
    found = written(found, "links")
    for table in (cell, many):
        dropped(table)
    parts = written(connected_components(found.select("c", "root"), "c", "root").withColumnsRenamed({"node": "c", "component": "root"}), "parts")
    ids = classes.select("c", "id")
    least = parts.join(ids, "c").groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    least = written(least, "components")
    named = join_by_key(parts, least, ["root"], "n").select("c", "component_id")
    per = classes.select("label", "embedding", "id", "times", "c").join(found.groupBy("c").agg(F.sum("links").alias("links")), "c", "left").join(named, "c", "left")
    per = per.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), "times")
    per = written(per, "classes")
    known = join_by_key(rows.where(good), per, ["label", "embedding"], "times").select("id", "n_links", "component_id")
    rest = rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return known.union(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
