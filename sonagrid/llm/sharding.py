"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has virtual nodes on a ring; where a node lies depends on its shard
and number only, so one more shard adds nodes and moves none. The ring is cut
in cells; a row's hash names its cell, and the next virtual node clockwise its
home shard. Shards have a capacity in rows, and the rows that overflow a full
shard go on clockwise until a shard has room. Without slack, capacities add up
to the number of rows and are at most one apart, so the finished shards are too.

The rows of a cell are interchangeable for the walk, so the walk runs over
counts of cells, whose number is a parameter and no matter of the data: they
come to the driver, own rows fill their shards in ring order, the overflow is
carried once around the ring and a second time, first in first out, and the
result is a table of rank intervals of cells. Every virtual node stays on the
ring, also where it shares a cell with others. A cell with many rows (a hot
key) is cut by the hash of the whole row, and once more by the place of the row
in its table where rows are equal, so no task sorts more than its share.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonagrid.llm.common import written

#: Cells of the ring at least, and for each virtual node.
CELLS, NODE_CELLS = 1 << 14, 4
#: Parts of a cell with more than a HOT_CELLS-th of all rows; there are fewer than HOT_CELLS of these.
CUTS, HOT_CELLS = 256, 1000


def cell_bits(shards: int, nodes: int) -> int:
    return (max(CELLS, shards * nodes * NODE_CELLS) - 1).bit_length()


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes in clockwise order."""
    place = lambda s, k: int.from_bytes(hashlib.blake2b(f"{s}:{k}".encode(), digest_size=8).digest(), "big")
    shift = 64 - cell_bits(shards, nodes)
    return [(at >> shift, s) for at, s, _ in sorted((place(s, k), s, k) for s in range(shards) for k in range(nodes))]


def stops(points: list[tuple[int, int]], loads: dict[tuple, int]) -> list[tuple[int, tuple | None, int]]:
    """(shard, unit, rows) in clockwise order from cell 0; units are tuples that
    start with their cell. A node whose arc has no rows stops at no unit."""
    of_arc: list[list[tuple]] = [[] for _ in range(len(points) + 1)]
    cells = [c for c, _ in points]
    for unit in sorted(loads):
        of_arc[bisect_left(cells, unit[0])].append(unit)
    out = []
    for arc, units in enumerate(of_arc):
        shard = points[arc % len(points)][1]  # beyond the last node lies the first
        out += [(shard, u, loads[u]) for u in units] or ([(shard, None, 0)] if arc < len(points) else [])
    return out


def walk(way: list[tuple[int, tuple | None, int]], room: list[int]) -> list[tuple[tuple, int, int, int, int]]:
    """(unit, lo, hi, shard, slot0): rows of a unit with ranks lo .. hi - 1 go to shard, from slot0 on."""
    taken = [0] * len(room)
    plan, over = [], []
    for shard, unit, n in way:
        own = min(n, room[shard] - taken[shard])
        if own:
            plan.append((unit, 0, own, shard, taken[shard]))
            taken[shard] += own
        over.append(own)
    # the overflow, carried around the ring: two laps, first in, first out
    carried: deque[tuple[tuple, int, int]] = deque()
    for lap in range(2):
        for (shard, unit, n), own in zip(way, over):
            while carried and taken[shard] < room[shard]:
                of, lo, hi = carried.popleft()
                some = min(hi - lo, room[shard] - taken[shard])
                plan.append((of, lo, lo + some, shard, taken[shard]))
                taken[shard] += some
                if lo + some < hi:
                    carried.appendleft((of, lo + some, hi))
            if not lap and own < n:
                carried.append((unit, own, n))
    if carried:
        raise ValueError("capacities are below the number of rows")
    return plan


def shard_rows(rows: DataFrame, key: str, shards: int = 16, nodes: int = 128, slack: float = 0.0) -> DataFrame:
    """rows with shard (0 .. shards - 1) and slot (gapless from 0 in each shard).

    A row leaves its home shard only if that is full. Without slack, counts of
    shards are at most one apart; with slack, a shard takes at most
    1 + slack times its even share, and fewer rows move when shards are added.
    Rows of a key are told apart by their other columns; rows equal in all
    columns get different slots in any order. A null key hashes like a value.
    No rows give no rows. Columns may have any name; maps are not compared.
    """
    spark, names = rows.sparkSession, rows.columns
    plain = rows.toDF(*[f"c{i}" for i in range(len(names))])
    told = [F.col(f.name) for f in plain.schema.fields if not isinstance(f.dataType, T.MapType)]
    hash_ = F.xxhash64(F.lit("row"), F.col(f"c{names.index(key)}"))
    bits = cell_bits(shards, nodes)
    placed = plain.select("*", F.shiftrightunsigned(hash_, 64 - bits).alias("cell"), hash_.alias("hash"), F.spark_partition_id().alias("part"))
    placed = written(placed, "placed")

    loads = {(r.cell,): r.n for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(loads.values())
    unit = ["cell"]
    for name, cut in (("by_row", F.pmod(F.xxhash64(F.lit("cut"), *told), F.lit(CUTS))), ("by_place", F.pmod(F.col("part"), F.lit(CUTS)).cast("long"))):
        hot = [u for u, n in loads.items() if n > max(1000, total // HOT_CELLS)]
        if hot:
            few = F.broadcast(spark.createDataFrame(hot, ", ".join(f"{c} long" for c in unit)).withColumn("hot", F.lit(True)))
            placed = placed.join(few, unit, "left").withColumn(name, F.when(F.col("hot"), cut).otherwise(F.lit(0))).drop("hot")
            parts = placed.join(few, unit, "left_semi").groupBy(*unit, name).agg(F.count(F.lit(1)).alias("n")).collect()
        else:
            placed, parts = placed.withColumn(name, F.lit(0).cast("long")), []
        warm = set(hot)
        loads = {(*u, 0): n for u, n in loads.items() if u not in warm} | {tuple(r)[:-1]: r.n for r in parts}
        unit.append(name)

    each = [total // shards + (s < total % shards) for s in range(shards)]
    room = [max(n, -int(-(1 + slack) * total // shards)) if slack else n for n in each]
    plan = [(*u, lo, hi, s, slot) for u, lo, hi, s, slot in walk(stops(ring(shards, nodes), loads), room)]
    plan = spark.createDataFrame(plan, "cell long, by_row long, by_place long, lo long, hi long, shard int, slot0 long")
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy(*unit).orderBy("hash", *told)) - 1)
    out = ranked.join(plan, unit).where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16, nodes: int = 128, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, size (UTF-8 bytes and 1), text_crc32, shard, slot for each row of
    docs; see shard_rows. A null text counts as empty. Other columns are not read."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    return shard_rows(rows, id_col, shards, nodes, slack)
