"""Substring dedup by level-wise doubling.

Level 1 looks at windows of half the wanted length: only those that repeat in
another document go on. Level 2 extends the survivors to the full length and
keeps those that still repeat. With ``window`` = 50 the levels are 25 and 50
words. A window of 100 words that repeats consists of windows of 50 that
repeat, so longer levels cannot remove another word; longest_repeats() goes on
doubling until no candidate survives.

Not every half-length window is written: inside each full window the one with
the smallest hash (the leftmost of equals) is its *seed*. Equal full windows
have the same seed at the same place, so grouping by seed loses no repeat, and
2 rows in 27 words are shuffled in place of one for each word.

A seed *owns* the consecutive full windows that chose it. Occurrences of a
seed whose owned stretches agree word by word form a class:

* an occurrence in a document with a larger id than its class's smallest
  repeats whole, without looking at single windows;
* the class's own first document can only repeat windows of another class of
  the same seed; for those alone the windows are extended and grouped one by
  one.

Windows are told apart by two hashes of independent keys, one of the seed's
words and one of the window's, so two that differ count as equal with a chance
of 2 ** -64 for each pair with the same seed, and 2 ** -128 for others. Seeds
and classes of common passages are hot keys; see common.join_by_key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonagrid.llm.common import dropped, join_by_key, joined, mix, run_hashes, spread, text_slices, utf8, word_hashes, words, written

_SEEDS = "doc long, tag int, q0 int, n int, h long, c long"
_WINDOWS = "doc long, tag int, q int, h long, w long"


def _leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the place of the leftmost smallest of values[i : i + width]; built by doubling."""
    at = np.arange(len(values))
    reach = 1
    while 2 * reach <= width:
        left, right = at[: len(at) - reach], at[reach:]
        at = np.where(values[left] <= values[right], left, right)
        reach *= 2
    if reach < width:
        left, right = at[: len(at) - (width - reach)], at[width - reach :]
        at = np.where(values[left] <= values[right], left, right)
    return at


def _seeds(window: int):
    half = window // 2

    def run(it):
        for batch in it:
            text = batch.column("text")
            for a, b in text_slices(text):
                data, off = utf8(text.slice(a, b - a))
                starts, ends, first = words(data, off)
                if len(starts) < window:
                    continue
                short = run_hashes(word_hashes(data, starts, ends), half)
                full = run_hashes(word_hashes(data, starts, ends, key=1), window)
                seed = _leftmost_min(short, window - half + 1)
                sizes = np.diff(first)
                doc = np.repeat(np.arange(len(sizes)), np.maximum(sizes - window + 1, 0))
                if not len(doc):
                    continue
                base = np.repeat(np.cumsum(np.maximum(sizes - window + 1, 0)) - np.maximum(sizes - window + 1, 0), np.maximum(sizes - window + 1, 0))
                q = np.arange(len(doc)) - base + first[:-1][doc]
                own = seed[q]
                new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])))
                last = np.append(new[1:], len(q)) - 1
                q0, q1, place = q[new], q[last], own[new]
                # the first and the last window cover the stretch, as it owns one seed
                stretch = mix(joined(full[q0], full[q1]) + ((place - q0) * window + (q1 - q0)).astype(np.uint64))
                d = doc[new]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").slice(a, b - a).take(pa.array(d)),
                        batch.column("tag").slice(a, b - a).take(pa.array(d)),
                        pa.array((q0 - first[d]).astype(np.int32)),
                        pa.array((q1 - q0 + 1).astype(np.int32)),
                        pa.array(short[place].view(np.int64)),
                        pa.array(stretch.view(np.int64)),
                    ],
                    names=["doc", "tag", "q0", "n", "h", "c"],
                )

    return run


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """(offsets, values) of a list column; null lists are empty."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0), dtype=np.int64)
    return np.append(0, np.cumsum(sizes)), column.flatten()


def _extend(window: int):
    def run(it):
        for batch in it:
            text = batch.column("text")
            for a, b in text_slices(text):
                data, off = utf8(text.slice(a, b - a))
                starts, ends, first = words(data, off)
                full = run_hashes(word_hashes(data, starts, ends, key=1), window)
                at, found = _lists(batch.column("found").slice(a, b - a))
                doc = np.repeat(np.arange(b - a), np.diff(at))
                q0, n = (np.asarray(found.field(x), dtype=np.int64) for x in ("q0", "n"))
                h = np.asarray(found.field("h"), dtype=np.int64)
                each = np.repeat(np.arange(len(n)), n)
                q = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + q0[each]
                begin = q + first[doc[each]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").slice(a, b - a).take(pa.array(doc[each])),
                        batch.column("tag").slice(a, b - a).take(pa.array(doc[each])),
                        pa.array(q.astype(np.int32)),
                        pa.array(h[each]),
                        pa.array(full[begin].view(np.int64)),
                    ],
                    names=["doc", "tag", "q", "h", "w"],
                )

    return run


def _cut(window: int, extra: list[str]):
    def run(it):
        for batch in it:
            text = batch.column("text")
            for a, b in text_slices(text):
                part = text.slice(a, b - a)
                data, off = utf8(part)
                starts, ends, first = words(data, off)
                at, found = _lists(batch.column("found").slice(a, b - a))
                doc = np.repeat(np.arange(b - a), np.diff(at))
                edge = np.zeros(len(starts) + 1, dtype=np.int64)
                if len(doc):
                    begin = np.asarray(found.field("q0"), dtype=np.int64) + first[doc]
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + np.asarray(found.field("n"), dtype=np.int64) + window - 1, -1)
                keep = np.cumsum(edge[:-1]) == 0
                raw = data.tobytes()
                texts, sums, removed = [], [], []
                for i, whole in enumerate(part.to_pylist()):
                    f, t = first[i], first[i + 1]
                    kept = keep[f:t]
                    gone = int(t - f - kept.sum())
                    removed.append(gone)
                    s, e = starts[f:t][kept], ends[f:t][kept]
                    sums.append(hashlib.sha256(b" ".join([raw[x:y] for x, y in zip(s.tolist(), e.tolist())])).hexdigest())
                    if gone and whole is not None:
                        # a kept word keeps the white space behind it
                        stop = np.append(starts[f + 1 : t], off[i + 1])[kept]
                        whole = b"".join([raw[x:y] for x, y in zip(s.tolist(), stop.tolist())]).decode().rstrip(" \t\n\x0b\x0c\r")
                    texts.append(whole)
                sizes = np.diff(first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(x).slice(a, b - a) for x in extra]
                    + [pa.array(texts, pa.string()), pa.array(sizes), pa.array(removed, pa.int64()), pa.array(sums, pa.string())],
                    names=[*extra, "text", "n_words", "n_removed", "kept_sha256"],
                )

    return run


def _level(docs: DataFrame, window: int) -> DataFrame:
    """(doc, tag, q0, n, h, c): seeds that two documents or more have. These alone
    can be part of a repeated window; all others end here."""
    seeds = written(docs.where("doc is not null").mapInArrow(_seeds(window), _SEEDS), "seeds")
    repeated = seeds.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("times"))
    repeated = written(repeated.where("lo < hi").select("h", "times"), "repeated")
    shared = written(join_by_key(seeds, repeated, ["h"], "times", how="left_semi").select("doc", "tag", "q0", "n", "h", "c"), "shared")
    dropped(seeds)
    dropped(repeated)
    return shared


def _spans(docs: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """(doc, tag, q0, n) of the windows over shared seeds that repeat from a smaller id."""
    classes = written(shared.groupBy("h", "c").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("times")), "classes")
    several = written(classes.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "several")
    # alone: no other class has the seed, so its first document repeats nothing
    marked = join_by_key(classes, several.withColumn("alone", F.lit(False)), ["h"], "k", how="left")
    marked = written(marked.withColumn("alone", F.coalesce("alone", F.lit(True))), "marked")
    alive = join_by_key(shared, marked, ["h", "c"], "times").where("doc > least or not alone")
    alive = written(alive.select("doc", "tag", "q0", "n", "h", (F.col("doc") > F.col("least")).alias("whole")), "alive")
    parts = alive.where("not whole").groupBy("doc", "tag").agg(F.collect_set(F.struct("q0", "n", "h")).alias("found"))
    windows = written(
        docs.join(parts.hint("shuffle_hash"), ["doc", "tag"]).select("doc", "tag", "text", "found").mapInArrow(_extend(window), _WINDOWS),
        "windows",
    )
    earliest = windows.groupBy("h", "w").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("times"))
    earliest = written(earliest.where("least < most").select("h", "w", "least", "times"), "earliest")
    single = join_by_key(windows, earliest, ["h", "w"], "times").where("doc > least")
    return alive.where("whole").select("doc", "tag", "q0", "n").union(single.select("doc", "tag", F.col("q").alias("q0"), F.lit(1).alias("n")))


def repeated_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc, tag, q0, n): windows starting at words q0 .. q0 + n - 1 of a document
    that also start in one with a smaller id. docs: doc long, tag int, text."""
    return _spans(docs, _level(spread(docs), window), window)


def longest_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, longest): for each row the longest window, of window, 2 * window,
    4 * window ... words, that also starts in a document with a smaller id; 0 for none.

    A level looks only at documents that share a seed of the level below, and
    the doubling ends with the first level at which nothing repeats. Odd rows
    are treated as by dedup_substrings.
    """
    rows = _rows(docs, id_col, text_col)
    found, now, size = None, rows, window
    while True:
        shared = _level(now, size)
        marks = written(_spans(now, shared, size).select("doc", "tag", F.lit(size).alias("size")).distinct(), "level")
        if marks.isEmpty():
            break
        found = marks if found is None else found.union(marks)
        takes_part = written(shared.select("doc", "tag").distinct(), "documents")
        dropped(shared)
        now, size = rows.join(takes_part.hint("shuffle_hash"), ["doc", "tag"], "left_semi"), 2 * size
    if found is None:
        return rows.select(F.col("doc").alias(id_col), F.lit(0).alias("longest"))
    most = found.groupBy("doc", "tag").agg(F.max("size").alias("longest"))
    return rows.select("doc", "tag").join(most, ["doc", "tag"], "left").select(F.col("doc").alias(id_col), F.coalesce("longest", F.lit(0)).alias("longest"))


def _rows(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    tag = (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) % 2147483647).cast("int")
    return docs.select(F.col(id_col).cast("long").alias("doc"), tag.alias("tag"), F.col(text_col).alias("text"), *more)


def dedup_substrings(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """docs without the words of repeated windows.

    A word goes if a window of ``window`` consecutive words over it also starts
    in a document with a smaller id; windows are judged on the input. Returns
    id_col, text (what is left, with its own white space), n_words, n_removed,
    kept_sha256 (of the kept words joined by one space) and the columns ``carry``.

    A null or empty text has no words and stays as it is; a null id is neither
    smaller nor larger than another, so its text loses nothing; rows that share
    an id are told apart by their text and never remove each other's words;
    texts of under ``window`` words lose nothing. Other columns of docs are not
    read. ``window`` must be even, so that it is the double of the level below.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be even")
    rows = _rows(docs, id_col, text_col)
    spans = repeated_spans(rows, window).groupBy("doc", "tag").agg(F.collect_set(F.struct("q0", "n")).alias("found"))
    if carry:
        rows = _rows(docs, id_col, text_col, F.struct(*carry).alias("extra"))
    more = ["extra"] if carry else []
    schema = T.StructType(
        [T.StructField("doc", T.LongType()), *(rows.schema[x] for x in more), T.StructField("text", T.StringType())]
        + [T.StructField(x, T.LongType()) for x in ("n_words", "n_removed")]
        + [T.StructField("kept_sha256", T.StringType())]
    )
    out = (
        rows.join(spans.hint("shuffle_hash"), ["doc", "tag"], "left")
        .select("doc", *more, "text", "found")
        .mapInArrow(_cut(window, ["doc", *more]), schema)
    )
    return out.select(F.col("doc").alias(id_col), "text", "n_words", "n_removed", "kept_sha256", *[F.col("extra").getField(x).alias(x) for x in carry])
