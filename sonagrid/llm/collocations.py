"""Phrase collocation mining with count tries.

A shard of the corpus is a slice of texts; its trie has a node for each phrase of
up to four words, found by numbering words and then pairs of (parent node, next
word). Tries go out as sorted rows, a key and a count each; Spark deals these out by
range of prefixes and merges the sorted runs, and equal neighbours are added up.
In a merged range, phrases stand in the order of a walk through the trie, so the
counts of a phrase's left parts are those of its ancestors on the way. The right
parts follow suffix links, level by level: the link of w1 w2 .. wk is w2 .. wk.

A phrase is as frequent as its rarest part at most. Shards therefore deepen their
tries only below phrases that pass a bit table of all frequent ones of the level
before. The table has FILTER_BITS bits whatever the corpus is, says yes to every
frequent phrase and by chance to some others, which the merge drops: it saves
work and decides nothing.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonagrid.llm.common import SPACE, dropped, join_by_key, joined, spread, text_slices, utf8, word_hashes, written

DEPTH = 4
#: Bits of the table of frequent phrases (16 MB).
FILTER_BITS = 1 << 27
#: Bytes of text in a shard's trie; a longer text is a shard of its own.
SHARD_BYTES = 1 << 22
#: Parts of a language that are ranked on their own first.
RANK_PARTS = 64

_CUT = np.zeros(256, dtype=bool)
_CUT[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_BREAK = _CUT.copy()
_BREAK[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

ROW = "lang string, w array<string>, f long"
#: Phrases on their way: words, an empty one and the language, joined by line feeds, which no word has.
KEYED = "key string, f long"


class Shard:
    """Words of a slice of texts: numbers of (language, word), and which words follow the one before in its piece."""

    def __init__(self, text: pa.Array, lang: pa.Array):
        data, off = utf8(text)
        data = _LOWER[data]
        solid = ~_BREAK[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[off] = True
        before = np.append(True, ~solid)[:-1] if len(data) else solid
        after = np.append(~solid, True)[1:] if len(data) else solid
        starts = np.flatnonzero(solid & (before | edge[:-1]))
        ends = np.flatnonzero(solid & (after | edge[1:])) + 1
        doc = np.searchsorted(off, starts, side="right") - 1
        cuts = np.cumsum(_CUT[data], dtype=np.int32 if len(data) < 1 << 31 else np.int64)[starts]
        self.follows = np.append(False, (cuts[1:] == cuts[:-1]) & (doc[1:] == doc[:-1]))[: len(starts)]
        bounds = np.append(0, np.cumsum(ends - starts))
        packed = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[solid])])
        packed = packed.dictionary_encode()
        langs = pa.compute.fill_null(lang, "und").dictionary_encode()
        self.langs, self.words = langs.dictionary, packed.dictionary
        v = max(1, len(self.words))
        both = np.asarray(langs.indices, dtype=np.int64)[doc] * v + np.asarray(packed.indices, dtype=np.int64)
        kinds, self.token, self.count = np.unique(both, return_inverse=True, return_counts=True)
        self.lang_of, self.word_of = np.divmod(kinds, v)
        self.hash = joined(_hashes(self.langs)[self.lang_of], _hashes(self.words)[self.word_of])

    def rows(self, nodes: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        """Phrases (rows of word numbers) as keys, sorted by language and words."""
        place = np.empty(len(self.words), dtype=np.int64)
        place[np.asarray(pa.compute.array_sort_indices(self.words))] = np.arange(len(self.words))
        rank = place[self.word_of]
        order = np.lexsort((*(rank[nodes[:, k]] for k in range(nodes.shape[1] - 1, -1, -1)), self.lang_of[nodes[:, 0]]))
        nodes, f = nodes[order], f[order]
        words_ = [self.words.take(pa.array(self.word_of[column])) for column in nodes.T]
        langs = self.langs.cast(pa.large_string()).take(pa.array(self.lang_of[nodes[:, 0]]))
        none = pa.scalar("", pa.large_string())
        key = pa.compute.binary_join_element_wise(*words_, none, langs, pa.scalar("\n", pa.large_string()))
        return pa.RecordBatch.from_arrays([key.cast(pa.string()), pa.array(f)], names=["key", "f"])


def _hashes(strings: pa.Array) -> np.ndarray:
    data, off = utf8(strings)
    return word_hashes(data, off[:-1], off[1:])


def _passes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h % np.uint64(FILTER_BITS)).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _tries(depths: tuple[int, ...], table):
    """Shards' nodes at these depths; ``table`` (a broadcast) has the frequent phrases of the level that ends before them."""

    def run(it):
        known = None if table is None else np.frombuffer(table.value, dtype=np.uint8)
        for batch in it:
            for a, b in text_slices(batch.column("text"), SHARD_BYTES, 1 << 20):
                shard = Shard(batch.column("text").slice(a, b - a), batch.column("lang").slice(a, b - a))
                if not len(shard.token):
                    continue
                if depths == (1,):
                    yield from _chunks(shard.rows(np.arange(len(shard.count))[:, None], shard.count))
                    continue
                token, h = shard.token, shard.hash
                if depths == (2,):
                    good = _passes(known, h)[token]
                    open_ = shard.follows & good & np.append(False, good[:-1])
                else:
                    pair = joined(h[token[:-1]], h[token[1:]])
                    open_ = np.append(False, shard.follows[1:] & _passes(known, pair))
                # open_[i]: word i goes on from word i - 1; node[i]: the node of the phrase that ends at i
                at = np.flatnonzero(open_)
                node, parent = token[at - 1], None
                for depth in range(2, max(depths) + 1):
                    if not len(at):
                        break
                    kinds, node, count = np.unique(node * len(h) + token[at], return_inverse=True, return_counts=True)
                    up, last = np.divmod(kinds, len(h))
                    parent = np.column_stack([up if parent is None else parent[up], last])
                    if depth in depths:
                        yield from _chunks(shard.rows(parent, count))
                    # phrases that end at i + 1 and begin one word before those of this depth
                    on = at + 1 < len(token)
                    on[on] = open_[at[on] + 1]
                    at, node = at[on] + 1, node[on]

    return run


def _chunks(rows: pa.RecordBatch, size: int = 1 << 16):
    for a in range(0, rows.num_rows, size):
        yield rows.slice(a, size)


def _added(it):
    """Rows in order: the sum of neighbours with equal keys."""
    last = None
    for batch in it:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        key, n = batch.column("key"), batch.num_rows
        heads = np.flatnonzero(np.append(True, np.asarray(pa.compute.not_equal(key.slice(1), key.slice(0, n - 1)))))
        f = np.add.reduceat(np.asarray(batch.column("f")), heads)
        out = batch.take(pa.array(heads)).set_column(1, "f", pa.array(f))
        yield out.slice(0, len(heads) - 1)
        last = out.slice(len(heads) - 1)
    if last is not None:
        yield last


def _merged(docs: DataFrame, depths: tuple[int, ...], table, least: int, name: str) -> DataFrame:
    """(lang, w, f) of all phrases of these depths with f >= least, a table."""
    with _set(docs.sparkSession, "spark.sql.parquet.compression.codec", "zstd"):
        shards = written(docs.mapInArrow(_tries(depths, table), KEYED), f"{name}-shards")
    runs = shards.repartitionByRange("key").sortWithinPartitions("key")
    many = runs.mapInArrow(_added, KEYED).where(F.col("f") >= least)
    phrase = F.substring_index("key", "\n\n", 1)
    lang = F.expr("substring(key, length(substring_index(key, '\\n\\n', 1)) + 3)").alias("lang")
    # nothing reads a merge's shuffle once its result is a table: its files go with the query
    with _set(docs.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        out = written(many.select(lang, F.split(phrase, "\n").alias("w"), "f"), name)
    dropped(shards)
    return out


@contextmanager
def _set(spark: SparkSession, key: str, value: str):
    """A session's setting for a while."""
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def _bit_table(frequent: DataFrame):
    """The bits of all phrases: at most FILTER_BITS / 64 numbers, whatever the corpus is."""

    def run(it):
        for batch in it:
            w = batch.column("w")
            h = _hashes(batch.column("lang"))
            flat, size = _hashes(w.flatten()), np.asarray(pa.compute.list_value_length(w), dtype=np.int64)
            first = np.append(0, np.cumsum(size))[:-1]
            if len(size):
                key = joined(h, flat[first])
                if size[0] == 2:
                    key = joined(key, joined(h, flat[first + 1]))
                at = (key % np.uint64(FILTER_BITS)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], names=["at", "bits"])

    words = frequent.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS >> 6, dtype=np.int64)
    table[np.asarray(words["at"])] = np.asarray(words["bits"])
    return frequent.sparkSession.sparkContext.broadcast(table.tobytes())


def _walk(it):
    """Rows in the order of the trie: each with the counts of its ancestors; null where a range began below them."""
    path: list[tuple[str, int | None]] = []
    lang = None
    for batch in it:
        left = []
        for x, w, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "w", "f"))):
            same = 0
            if x == lang:
                while same < min(len(path), len(w) - 1) and path[same][0] == w[same]:
                    same += 1
            lang = x
            path = path[:same] + [(v, None) for v in w[same:]]
            path[-1] = (w[-1], n)
            left.append([c for _, c in path[:-1]])
        if left:
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("w"), batch.column("f"), pa.array(left, pa.list_(pa.int64()))], names=["lang", "w", "f", "left"])


def _with_left(nodes: DataFrame) -> DataFrame:
    """nodes (a table) with the counts of their first 1, 2 .. words.

    A range of prefixes that begins inside a subtree lacks at most DEPTH - 1
    ancestors, those of its first row; these few are looked up and broadcast.
    """
    walked = written(nodes.repartitionByRange("lang", "w").sortWithinPartitions("lang", "w").mapInArrow(_walk, f"{ROW}, left array<long>"), "walked")
    lost = F.filter(F.transform("left", lambda c, k: F.when(c.isNull(), F.slice("w", 1, k + 1))), lambda p: p.isNotNull())
    missing = walked.select("lang", F.explode(lost).alias("w")).distinct()
    found = nodes.join(F.broadcast(missing), ["lang", "w"]).select(F.col("lang").alias("l2"), F.col("w").alias("w2"), F.col("f").alias("f2"))
    lacks = F.exists("left", lambda c: c.isNull())
    mended = walked.where(lacks)
    for k in range(1, DEPTH):
        here = F.broadcast(found.where(F.size("w2") == k))
        on = (F.get("left", F.lit(k - 1)).isNull()) & (F.size("w") > k) & (F.col("lang") == F.col("l2")) & (F.slice("w", 1, k) == F.col("w2"))
        fixed = F.transform("left", lambda c, i: F.coalesce(c, F.when(i == F.lit(k - 1), F.col("f2"))))  # noqa: B023
        mended = mended.join(here, on, "left").select("lang", "w", "f", fixed.alias("left"))
    return walked.where(~lacks).unionByName(mended)


def _with_right(nodes: DataFrame) -> DataFrame:
    """nodes with the counts of what is left behind their first 1, 2 .. words, along suffix links."""
    rest = F.expr("slice(w, 2, size(w) - 1)")
    level = nodes.where(F.size("w") == 1).withColumn("right", F.array().cast("array<long>"))
    levels = []
    for depth in range(2, DEPTH + 1):
        below = written(nodes.where(F.size("w") == depth).withColumn("rest", rest), "level")
        shared = below.groupBy("lang", "rest").agg(F.count(F.lit(1)).alias("n"))
        ends = level.select("lang", F.col("w").alias("rest"), F.concat(F.array("f"), "right").alias("right"))
        ends = written(ends.join(shared, ["lang", "rest"]), "ends")
        level = written(join_by_key(below, ends, ["lang", "rest"], "n").drop("rest"), "linked")
        levels.append(level)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def phrase_counts(docs: DataFrame, least: int = 30, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, n), (lang, w, f)): words in all, and every phrase of up to four words with f >= least.

    Texts are lower-cased (A-Z), cut in pieces at . , ; : ! ? and line ends, and
    the pieces into words at spaces and tabs; phrases lie within a piece. A null
    text is empty, a null language "und".
    """
    rows = spread(docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null"))
    one = _merged(rows, (1,), None, 1, "words")
    total = one.groupBy("lang").agg(F.sum("f").alias("n"))
    one = one.where(F.col("f") >= least)
    table = _bit_table(one)
    two = _merged(rows, (2,), table, least, "pairs")
    table.unpersist()
    table = _bit_table(two)
    more = _merged(rows, (3, 4), table, least, "phrases")
    table.unpersist()
    return total, written(one.unionByName(two).unionByName(more), "nodes")


def collocations(docs: DataFrame, least: int = 30, inside: int = 80, top: int | None = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: phrases of two to four words with a >= least occurrences.

    score is floor(2000000 a / (l + r)) for the cut into a first and a last part
    (l and r occurrences) where it is lowest, the first of equals. Phrases inside
    a longer one that has at least ``inside`` percent of their occurrences are
    left out; as counts fall with length, the phrases with one word more tell.
    The first ``top`` of each language by score, occurrences and phrase (bytes);
    all with None. Decimals keep products exact. Repeated rows count each time;
    no rows or only empty texts give no rows. Other columns are not read.
    """
    total, nodes = phrase_counts(docs, least, text_col, lang_col)
    counted = _with_right(_with_left(nodes))
    wide = lambda c: c.cast("decimal(20,0)")
    cuts = F.transform(F.arrays_zip("left", "right"), lambda p: _cut(wide(F.col("f")), p))
    best = F.array_min(F.transform(cuts, lambda c, k: F.struct(c["score"].alias("score"), k.alias("k"), c["l"].alias("l"), c["r"].alias("r"))))
    longer = nodes.where(F.size("w") > 2)
    parts = longer.select("lang", "f", F.explode(F.array(F.expr("slice(w, 1, size(w) - 1)"), F.expr("slice(w, 2, size(w) - 1)"))).alias("w"))
    parts = parts.groupBy("lang", "w").agg(F.max("f").alias("longest"))
    kept = counted.join(parts, ["lang", "w"], "left").where(F.col("longest").isNull() | (100 * wide(F.col("longest")) < inside * wide(F.col("f"))))
    rows = kept.select("lang", F.array_join("w", " ").alias("phrase"), F.col("f").alias("a"), best.alias("best"))
    rows = rows.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        # no task ranks a whole language: first parts of it, then at most RANK_PARTS * top rows
        part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
        rows = rows.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _cut(a: Column, p: Column) -> Column:
    twice = p["left"].cast("decimal(20,0)") + p["right"].cast("decimal(20,0)")
    return F.struct(F.call_function("div", F.lit(2000000).cast("decimal(8,0)") * a, twice).cast("long").alias("score"), p["left"].alias("l"), p["right"].alias("r"))
