"""Pieces that several operators share: word spans in numpy, tables in the
shared folder, connected components."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and DuckDB (RE2) pattern of a word: code points other than these six.
WORD = r"[^\x20\x09-\x0D]+"

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


# --- tables in the shared folder ------------------------------------------


_own_folders: dict[str, str] = {}  # of local sessions without a folder


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary folder in
    local mode, where driver and executors are one process, and an error on a
    cluster, where a machine's own folder would hide what other machines write."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if sc.applicationId not in _own_folders:
            _own_folders[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="shared-")
        found = _own_folders[sc.applicationId]
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends here, and a
    lost executor costs a re-read instead of a re-computation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table that written() made and nothing reads any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df.table_path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt out where the files have fewer splits than the session has
    cores: a small table's few row groups would keep the other cores idle.
    Larger tables stay as they are read. For rows of files: asking for the
    splits of a plan with shuffles would run them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


# --- joins with hot keys ------------------------------------------------------

#: Hot keys of a join at most; a key is hot with more than a HOT_KEYS-th of all rows.
HOT_KEYS = 10_000
#: Rows that one task takes well whatever their share.
FEW_ROWS = 100


def hot_bound(rows_in_all: int) -> int:
    """Rows of a key above which it is hot; at most HOT_KEYS keys can be."""
    return max(FEW_ROWS, rows_in_all // HOT_KEYS)


def total(keyed: DataFrame, n: str) -> int:
    return keyed.agg(F.sum(n)).first()[0] or 0


def join_by_key(rows: DataFrame, keyed: DataFrame, on: list[str], n: str, rows_in_all: int | None = None, how: str = "inner") -> DataFrame:
    """rows joined (inner, left or left_semi) with ``keyed``, which has one row for
    each key and in ``n`` the rows of the key.

    Rows of a hot key would meet in one task. At most HOT_KEYS keys are hot, so
    their part of ``keyed`` is broadcast and their rows stay where they are; the
    others are shuffled. ``keyed`` and ``rows`` are read twice: pass tables.
    """
    bound = hot_bound(total(keyed, n) if rows_in_all is None else rows_in_all)
    hot, cold = (keyed.where(c).drop(n) for c in (F.col(n) > bound, F.col(n) <= bound))
    common = rows.join(F.broadcast(hot), on, "left_semi" if how == "left_semi" else "inner")
    return common.unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how))


# --- connected components ---------------------------------------------------


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest id that each node of an edge reaches.

    Alternating large-star and small-star rounds; the edges of a round are a
    table in the shared folder, never on the driver. The hubs of the stars are
    hot keys: see join_by_key. Loops, repeats and null ends are ignored; no
    edges give no rows.
    """
    now = written(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    mark = None
    while True:
        at = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if at == mark or at[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select("v", "v").distinct()
            )
        mark = at
        both = now.union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        least = written(least.select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = written(join_by_key(both, least, ["u"], "n", 2 * at[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        small = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "small")
        new = (
            join_by_key(large, small, ["u"], "n", at[0])
            .where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", "m"))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct()
        )
        old, now = now, written(new, "edges")
        for table in (old, least, large, small):
            dropped(table)


# --- words ------------------------------------------------------------------


def text_slices(column: pa.ChunkedArray | pa.Array, most_bytes: int = 1 << 20, most_rows: int = 512):
    """(first row, last row + 1) of runs with about most_bytes of UTF-8; a longer text stands alone."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
    at = 0
    ends = np.cumsum(sizes)
    while at < len(sizes):
        base = ends[at] - sizes[at]
        to = int(np.searchsorted(ends, base + most_bytes, side="right"))
        to = min(max(to, at + 1), at + most_rows, len(sizes))
        yield at, to
        at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = pa.compute.fill_null(column.cast(pa.large_string()), "")
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and for each text (and one past the last) its first word."""
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    solid = ~SPACE[data]
    before = np.append(True, ~solid)[:-1] if len(data) else solid
    after = np.append(~solid, True)[1:] if len(data) else solid
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes are hashed one by one.
SHORT = 32
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """64-bit hashes of words, independent for each key.

    Eight bytes at a time go into a state that is scrambled after each step, so
    no relation among letters (as in sums of powers) carries over to hashes.
    Words of over SHORT bytes have a keyed BLAKE2b digest.
    """
    size = ends - starts
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    out = mix(size.astype(np.uint64) * _ODD + np.uint64(2 * key + 1))
    at = np.flatnonzero(size <= SHORT)
    k = 0
    while len(at):
        left = size[at] - k
        out[at] = mix((out[at] ^ (eight[starts[at] + k] & _LOW_BYTES[np.minimum(left, 8)])) * _ODD + np.uint64(key))
        k += 8
        at = at[left > 8]
    long = np.flatnonzero(size > SHORT)
    if len(long):
        raw, by = data.tobytes(), key.to_bytes(8, "little")
        digests = [hashlib.blake2b(raw[x:y], digest_size=8, key=by).digest() for x, y in zip(starts[long].tolist(), ends[long].tolist())]
        out[long] = np.frombuffer(b"".join(digests), dtype="<u8")
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashes; the order counts."""
    return mix(mix(a + _ODD) ^ (b * np.uint64(0xD6E8FEB86659FD93)))


def run_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive values, by doubling: a run is two
    of half its length, or two that overlap where no power of two fits."""
    reach = 1
    while 2 * reach <= size:
        values = joined(values[: max(0, len(values) - reach)], values[reach:])
        reach *= 2
    if reach < size:
        step = size - reach
        values = joined(values[: max(0, len(values) - step)], values[step:])
    return values


def batches(rows: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in rows.items()})
