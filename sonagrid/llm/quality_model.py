"""Quality classifier: a factorisation machine.

A document is a sparse vector: hashed words (log counts, length 1) and one-hot
bins of structure statistics (length, line and word shapes, character classes,
repetition) and of metadata (the table's own count of characters, a bin of its
own where it is missing, and how it compares with the text). The score adds all
pairwise interactions through vectors of low rank, in linear time by

    sum over pairs <v_i, v_j> x_i x_j = 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2],

whose sums run over the entries that a document has.

The model is fitted on at most ``most_rows`` labelled ids, chosen by a hash of
the id, one text each; its size is fixed by HASHED, BINS and RANK, so it travels
in the tasks' closure. Every text is scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonagrid.llm.common import SPACE, spread, text_slices, utf8, word_hashes, words

HASHED = 2048
BINS = 12
RANK = 6
#: Labelled rows that a fit looks at.
MOST_ROWS = 6000


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_CLASSES = [
    _class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    _class(b"abcdefghijklmnopqrstuvwxyz"),
    _class(b"0123456789"),
    _class(b"#*$%&|<>~^_=+@\\{}[]/"),
    _class(b".,;:"),
    _class(b"!?"),
    _class(b"\n"),
    _class(bytes(range(128, 256))),
]
N_STATS = 19


def statistics(data: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hashes: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    """Structure statistics and metadata (columns) of texts (rows); n_chars is -1 where unknown."""
    n_docs = len(off) - 1
    solid = off[1:] > off[:-1]

    def per_text(values):
        out = np.zeros(n_docs)
        if solid.any():
            out[solid] = np.add.reduceat(values, off[:-1][solid], dtype=np.int64)
        return out

    chars = np.maximum(per_text(~SPACE[data]), 1)
    n = np.diff(first).astype(float)
    some = np.maximum(n, 1)
    shares = [per_text(c[data]) for c in _CLASSES]
    lines = shares[6] + 1
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    count = lambda mask: np.bincount(doc[mask], minlength=n_docs)
    order = np.lexsort((hashes, doc))
    new = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1]))[: len(order)]
    distinct = np.bincount(doc[order][new], minlength=n_docs)
    run = np.append(False, (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1]))[: len(doc)]
    upper, lower = _CLASSES[0][data[starts]], _CLASSES[1][data[starts]]
    tail = data[ends - 1]
    size = ends - starts
    columns = [
        np.log1p(n),
        chars / some,
        *[shares[k] / chars for k in (0, 2, 3, 4, 5, 7)],
        n / lines,
        shares[6] / some,
        distinct / some,
        count(run) / some,
        count(upper) / some,
        count(lower) / some,
        count(_CLASSES[4][tail]) / some,
        count(size == 1) / some,
        count(size > 14) / some,
        np.where(n_chars < 0, -1, np.log1p(np.maximum(n_chars, 0))),
        np.where(n_chars < 0, -1, n_chars / np.maximum(off[1:] - off[:-1], 1)),
    ]
    return np.stack(columns, axis=1)


class Sparse:
    """Rows of a sparse matrix: entry e has column at[e] and value x[e]; row r has entries first[r] .. first[r + 1] - 1."""

    def __init__(self, first: np.ndarray, at: np.ndarray, x: np.ndarray):
        self.first, self.at, self.x = first, at, x

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of values (one for each entry) by row."""
        total = np.zeros((len(values) + 1, *values.shape[1:]))
        np.cumsum(values, axis=0, out=total[1:])
        return total[self.first[1:]] - total[self.first[:-1]]

    def take(self, rows: np.ndarray) -> Sparse:
        size = np.diff(self.first)[rows]
        first = np.append(0, np.cumsum(size))
        e = np.arange(first[-1]) + np.repeat(self.first[:-1][rows] - first[:-1], size)
        return Sparse(first, self.at[e], self.x[e])


def _slice(text: pa.Array, n_chars: pa.Array) -> tuple[np.ndarray, Sparse]:
    """(statistics, hashed words) of texts."""
    data, off = utf8(text)
    starts, ends, first = words(data, off)
    hashes = word_hashes(data, starts, ends)
    doc = np.repeat(np.arange(len(text)), np.diff(first))
    entry, count = np.unique(doc * HASHED + (hashes % np.uint64(HASHED)).astype(np.int64), return_counts=True)
    row, at = np.divmod(entry, HASHED)
    bag = Sparse(np.searchsorted(row, np.arange(len(text) + 1)), at, np.log1p(count))
    bag.x = bag.x / np.sqrt(np.maximum(bag.sums(bag.x**2), 1e-12))[row]
    known = np.asarray(pa.compute.fill_null(n_chars, -1), dtype=np.int64)
    return statistics(data, off, starts, ends, first, hashes, known), bag


def _features(it):
    for batch in it:
        for a, b in text_slices(batch.column("text")):
            stats, bag = _slice(batch.column("text").slice(a, b - a), batch.column("n_chars").slice(a, b - a))
            lists = [pa.ListArray.from_arrays(pa.array(bag.first, pa.int32()), pa.array(v, kind)) for v, kind in ((bag.at, pa.int32()), (bag.x, pa.float32()))]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * N_STATS, pa.int32()), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(a, b - a) for x in ("id", "label")), flat, *lists], names=["id", "label", "stats", "at", "x"])


class FactorisationMachine:
    """b + <w, x> + pairwise interactions of rank RANK, for x of hashed words and binned statistics."""

    def __init__(self, edges: np.ndarray, seed: int = 5):
        self.edges = edges
        rng = np.random.default_rng(seed)
        d = HASHED + N_STATS * BINS
        self.b, self.w, self.v = np.zeros(1), np.zeros(d), rng.normal(0, 0.05, (d, RANK))

    def vectors(self, stats: np.ndarray, bag: Sparse) -> Sparse:
        """The words' entries and one for each statistic's bin."""
        n = len(stats)
        size = np.diff(bag.first) + N_STATS
        first = np.append(0, np.cumsum(size))
        at, x = np.empty(first[-1], dtype=np.int64), np.full(first[-1], 1 / np.sqrt(N_STATS))
        tail = first[1:, None] - N_STATS + np.arange(N_STATS)
        words_ = np.ones(first[-1], dtype=bool)
        words_[tail.ravel()] = False
        at[words_], x[words_] = bag.at, bag.x
        bins = [np.searchsorted(self.edges[j], stats[:, j], side="right") for j in range(N_STATS)]
        at[tail] = HASHED + np.arange(N_STATS) * BINS + np.stack(bins, axis=1).reshape(n, N_STATS)
        return Sparse(first, at, x)

    def raw(self, x: Sparse) -> np.ndarray:
        pulled = self.v[x.at] * x.x[:, None]
        return self.b[0] + x.sums(self.w[x.at] * x.x) + 0.5 * (x.sums(pulled) ** 2 - x.sums(pulled**2)).sum(axis=1)

    def score(self, x: Sparse) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))

    def fit(self, x: Sparse, y: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.02, decay: float = 1e-4) -> FactorisationMachine:
        """Logistic loss by Adam."""
        rng = np.random.default_rng(3)
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in (self.b, self.w, self.v)]
        t, d = 0, len(self.w)
        for _ in range(epochs if len(y) else 0):
            for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
                xb, t = x.take(rows), t + 1
                g = (self.score(xb) - y[rows]) / len(rows)
                each = np.repeat(g, np.diff(xb.first)) * xb.x
                s = np.repeat(xb.sums(self.v[xb.at] * xb.x[:, None]), np.diff(xb.first), axis=0)
                of_v = np.stack([np.bincount(xb.at, each * s[:, f], d) for f in range(RANK)], axis=1)
                grads = (
                    np.array([g.sum()]),
                    np.bincount(xb.at, each, d) + decay * self.w,
                    of_v - np.bincount(xb.at, each * xb.x, d)[:, None] * self.v + decay * self.v,
                )
                for q, d_, (m, u) in zip((self.b, self.w, self.v), grads, state):
                    m += 0.1 * (d_ - m)
                    u += 0.001 * (d_ * d_ - u)
                    q -= rate * (m / (1 - 0.9**t)) / (np.sqrt(u / (1 - 0.999**t)) + 1e-8)
        return self


def held_out(id_: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(id_.cast("string").cast("binary")) % 5 == 0


def _texts(docs: DataFrame, text_col: str, chars_col: str, *more: Column) -> DataFrame:
    n_chars = F.col(chars_col).cast("long") if chars_col in docs.columns else F.lit(None).cast("long")
    return docs.select(*more, F.col(text_col).alias("text"), n_chars.alias("n_chars"))


def train(
    docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", chars_col: str = "n_chars"
) -> FactorisationMachine:
    """A model of label_col from rows of labels that are not held out.

    Rows with a null id or label, or one other than 0 and 1, teach nothing; an
    id with several labels counts with the smallest, and one with several texts
    with the first in order. Without any, all scores are 1/2. With more than
    most_rows ids, those with the smallest hash are taken. The count of
    characters may be null or missing.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most_rows)
    texts = _texts(docs, text_col, chars_col, F.col(id_col).alias("id")).join(F.broadcast(known), "id")
    texts = texts.groupBy("id", "label").agg(F.min(F.struct("text", "n_chars")).alias("first")).select(F.col("id").cast("long").alias("id"), "label", "first.*")
    found = texts.mapInArrow(_features, "id long, label int, stats array<double>, at array<int>, x array<float>").toArrow().sort_by([("id", "ascending")]).combine_chunks()
    stats = np.asarray(found["stats"].combine_chunks().flatten(), dtype=float).reshape(-1, N_STATS)
    y = np.asarray(found["label"], dtype=float)
    size = np.asarray(pa.compute.list_value_length(found["at"].combine_chunks()), dtype=np.int64)
    bag = Sparse(np.append(0, np.cumsum(size)), *(np.asarray(found[c].combine_chunks().flatten()) for c in ("at", "x")))
    cut = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = np.quantile(stats, cut, axis=0).T if len(y) else np.zeros((N_STATS, BINS - 1))
    model = FactorisationMachine(edges)
    return model.fit(model.vectors(stats, bag), y)


def score(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """id_col, held_out, score, predicted for each row of docs.

    Null and empty texts are scored as texts without words; rows with equal
    texts and counts of characters have equal scores. A null id is not held
    out. Other columns are not read.
    """

    def run(it):
        for batch in it:
            for a, b in text_slices(batch.column("text")):
                p = model.score(model.vectors(*_slice(batch.column("text").slice(a, b - a), batch.column("n_chars").slice(a, b - a))))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(p)], names=["id", "held_out", "score"])

    rows = _texts(docs, text_col, chars_col, F.col(id_col).cast("long").alias("id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"))
    out = spread(rows).mapInArrow(run, "id long, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.3, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows of docs with a score of at least threshold, all columns as they are."""

    def run(it):
        for batch in it:
            text = batch.column(text_col)
            n_chars = batch.column(chars_col).cast(pa.int64()) if chars_col in batch.schema.names else pa.nulls(batch.num_rows, pa.int64())
            for a, b in text_slices(text):
                p = model.score(model.vectors(*_slice(text.slice(a, b - a), n_chars.slice(a, b - a))))
                yield batch.slice(a, b - a).filter(pa.array(p >= threshold))

    return spread(docs).mapInArrow(run, docs.schema)
