"""SimHash near-dedup by multi-index hashing.

A fingerprint has 64 bits, cut in m segments. Two fingerprints that differ in
fewer than m * (r + 1) bits differ in at most r bits in one of the segments. So
each distinct fingerprint is in m tables by its exact segments, looks up the
Hamming ball of radius r around each of its own segments, and whole distances
are verified inside the join. For distance 4 there are two ways: three segments
with balls of radius 1 (67 keys), which meet n / 2^21 others by chance, and two
segments with balls of radius 2 (1058 keys), which meet n / 2^32. plan() takes
that with fewer keys and chance meetings for the number of fingerprints. Equal
fingerprints are one entry from the start, so exact copies cost a group-by and
no pair; a segment that many fingerprints share is cut in parts, and each
look-up goes to all of them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonagrid.llm.common import HOT_KEYS, SPACE, connected_components, join_by_key, spread, text_slices, total, utf8, words, written

#: Fingerprints of a segment's value in one part, at least.
PART_ROWS = 1000


def segments(m: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of m segments of nearly equal length."""
    edges = [64 * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def flips(bits: int, radius: int) -> list[int]:
    """All words of that many bits of which at most ``radius`` are set."""
    return [sum(1 << i for i in at) for r in range(radius + 1) for at in combinations(range(bits), r)]


def plan(n: int, most: int) -> tuple[int, int]:
    """(segments, radius) with the least keys and chance meetings for n fingerprints."""

    def cost(m: int, r: int) -> float:
        return sum(len(flips(bits, r)) * (1 + n / 2**bits) for _, bits in segments(m))

    ways = [(m, r) for r in (1, 2) for m in range(1, 65) if m * (r + 1) > most and (m - 1) * (r + 1) <= most]
    return min(ways, key=lambda way: cost(*way))


def _fingerprints(shingle: int):
    hashed = xxhash.xxh64_intdigest

    def run(it):
        for batch in it:
            text = batch.column("text")
            for a, b in text_slices(text):
                data, off = utf8(text.slice(a, b - a))
                starts, ends, first = words(data, off)
                # words with one space behind each: a shingle is then one slice
                size = ends - starts + 1
                to = np.cumsum(size)
                joined = np.full(int(to[-1]) if len(to) else 0, 32, dtype=np.uint8)
                if len(to):
                    inside = np.ones(len(joined), dtype=bool)
                    inside[to - 1] = False
                    joined[inside] = data[~SPACE[data]]
                raw = joined.tobytes().lower()
                n = np.diff(first)
                count = np.where(n == 0, 0, np.maximum(n - shingle + 1, 1))
                doc = np.repeat(np.arange(len(n)), count)
                i = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][doc]
                last = np.minimum(i + shingle, first[1:][doc]) - 1
                begin, end = (to - size)[i], to[last] - 1
                h = np.fromiter((hashed(raw[x:y], 42) for x, y in zip(begin.tolist(), end.tolist())), dtype=np.uint64, count=len(doc))
                fp = np.zeros(len(n), dtype=np.uint64)
                some = np.flatnonzero(count)
                if len(some):
                    at = (np.cumsum(count) - count)[some]
                    for k in range(64):
                        bits = ((h >> np.uint64(k)) & np.uint64(1)).astype(np.int32)
                        fp[some] |= (2 * np.add.reduceat(bits, at) > count[some]).astype(np.uint64) << np.uint64(k)
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(a, b - a), pa.array(fp.view(np.int64))], names=["doc", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, fp): XXH64 (seed 42) of word shingles in lower case (A-Z), majority by bit."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return spread(rows).mapInArrow(_fingerprints(shingle), "doc long, fp long")


def hamming_links(fps: DataFrame, most: int = 4, way: tuple[int, int] | None = None) -> DataFrame:
    """(a, b): ids of distinct fingerprints that differ in at most ``most`` bits.
    fps: a table of id long, fp long, one row for each fingerprint. way: number
    of segments and radius, by default those of plan()."""
    m, radius = way or plan(fps.count(), most)
    if most >= m * (radius + 1):
        raise ValueError("balls of this radius do not cover this distance")
    cut = segments(m)
    exact = F.array(*[F.struct(F.lit(k).alias("k"), _segment(s).alias("s")) for k, s in enumerate(cut)])
    ball = F.concat(*[F.transform(F.array(*[F.lit(x).cast("long") for x in flips(s[1], radius)]), lambda x: F.struct(F.lit(k).alias("k"), _segment(s).bitwiseXOR(x).alias("s"))) for k, s in enumerate(cut)])
    table = fps.select("id", "fp", F.inline(exact))
    probe = fps.select(F.col("id").alias("other"), F.col("fp").alias("fp2"), F.inline(ball))
    # values that many share: their number is bounded, as a part has PART_ROWS rows or more
    sizes = written(table.groupBy("k", "s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART_ROWS), "segments")
    bound = max(PART_ROWS, total(sizes, "n") // HOT_KEYS)
    hot = F.broadcast(sizes.where(F.col("n") > bound).select("k", "s", F.ceil(F.col("n") / bound).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    table = table.join(hot, ["k", "s"], "left").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("parts")
    probe = probe.join(hot, ["k", "s"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= most
    return probe.join(table, ["k", "s", "part"]).where((F.col("other") < F.col("id")) & near).select(F.col("other").alias("a"), F.col("id").alias("b"))


def _segment(segment: tuple[int, int]):
    low, bits = segment
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def near_duplicates(docs: DataFrame, shingle: int = 4, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint (16 hex digits), component_id, kept for each row of docs.

    component_id is the smallest id that is reached over links of at most
    ``most`` differing bits; kept marks its row. Null and empty texts have the
    fingerprint zero, which links like any other. Texts with fewer words than a
    shingle have their whole sequence as the only one. Rows with a null id link
    like others, get their group's id (null where no row of it has one) and are
    never kept. Repeated
    rows each get a row. Other columns are not read.
    """
    rows = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    known = written(rows.groupBy("fp").agg(F.min("doc").alias("id"), F.count(F.lit(1)).alias("n")), "distinct")
    # fingerprints are their own numbers in links, as one that only rows without an id have links too
    links = hamming_links(known.select(F.col("fp").alias("id"), "fp"), most)
    parts = written(connected_components(links).withColumnRenamed("component", "part"), "parts")
    groups = known.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "n", "id", F.coalesce("part", "fp").alias("part"))
    least = groups.groupBy("part").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    roots = join_by_key(written(groups, "groups"), written(least, "least"), ["part"], "classes").select("fp", "component_id", "n")
    return join_by_key(rows, written(roots, "roots"), ["fp"], "n").select(
        F.col("doc").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("doc") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def deduplicated(docs: DataFrame, shingle: int = 4, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group, all columns as they are: that with the
    smallest id. Of rows that share this id one stays. Rows without an id stay."""
    found = near_duplicates(docs, shingle, most, id_col, text_col).select(F.col(id_col).alias("id"), "kept")
    # ids of rows that go: those of a row that is kept stay, once each; rows without an id are not in any join
    kept = written(found.where("kept").groupBy("id").agg(F.count(F.lit(1)).alias("n")), "groups")
    rows = docs.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"))
    key = F.col(f"row.c{docs.columns.index(id_col)}").cast("long")
    back = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)]
    without = rows.where(key.isNull())
    one = rows.join(kept.where("n = 1"), key == F.col("id"), "left_semi")
    out = without.select("row").union(one.select("row"))
    several = kept.where("n > 1").select("id")
    if not several.isEmpty():
        # of rows that share a kept id one stays: the first place in the order of rows' hashes, then of partial choices
        twice = rows.withColumn("id", key).join(several, "id", "left_semi")
        out = out.union(twice.dropDuplicates(["id"]).select("row"))
    return out.select(*back)
