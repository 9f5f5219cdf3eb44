"""Toxicity: a lexicon trie met by Levenshtein automata, and scores of context.

Training finds terms in labelled texts: whole words, and stems (beginnings of
words) where a language builds many words on one, that toxic texts have far more
often than others. The terms form a trie. The automaton of all words within a
few edits of a term (replaced, missing, extra or swapped letters behind the first
one) is the trie met with the Levenshtein automaton: its positions are (node,
edits so far), and its states, sets of positions, are made when a word first
needs them. All different words of a slice of texts go through it side by side,
a letter a step; most leave it at the second. Digits and signs that stand for
letters count as these. A near form that clean training texts use is a word of
its own, not a misspelling.

Each match weighs by its term, its edits and the words around it: inside
quotation marks or beside words of reporting it counts less, beside second-person
words more. A text's sums go into a small logistic model.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonagrid.llm.common import SPACE, spread, text_slices, utf8, words, written

#: Labelled ids that a fit looks at; terms of a lexicon at most; words that vary a term in clean texts at most.
MOST_ROWS = 8000
MOST_TERMS = 400
MOST_ORDINARY = 20_000
#: Lengths of stems.
STEMS = range(4, 9)
#: Words around a match that are its context.
WINDOW = 8
#: States of the automaton that are kept from one slice to the next.
MOST_STATES = 20_000

# Signs that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
# Words that address a reader, and words that report what others said.
ADDRESS = ["you", "your", "you're", "yours", "yourself", "u", "ur", "du", "dich", "dein", "ihr", "tu", "toi", "ton", "vous", "votre", "tú", "te", "tus", "usted"]
REPORT = ["said", "says", "wrote", "called", "quoted", "quote", "word", "term", "reported", "sagte", "schrieb", "wort", "disait", "écrit", "mot", "dijo", "escribió", "palabra"]
OPEN, CLOSE = '"“«„‘', '"”»“’'


def fold(word: str) -> str:
    """A word as the automaton reads it: lower case, bare of signs around it, digits and signs inside as letters."""
    word = word.lower()
    a, b = 0, len(word)
    while a < b and not (word[a].isalnum() or word[a] in "@$"):
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return "".join(LEET.get(c, c) for c in word[a:b])


def edits_of(term: str) -> int:
    """Edits that a whole word forgives: none for short ones."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


@dataclass(frozen=True)
class Term:
    """A word, or a stem; worth is between 0 and 1."""

    text: str
    stem: bool = False
    edits: int = 0
    worth: float = 1.0

    def __str__(self):
        return self.text + "*" * self.stem


class Automaton:
    """All words within a term's edits, as a deterministic automaton whose states are made on demand."""

    def __init__(self, terms: list[Term]):
        self.letters = {c: k + 1 for k, c in enumerate(sorted({c for t in terms for c in t.text}))}
        self.children: list[dict[int, int]] = [{}]
        self.whole, self.stem, self.most = [-1], [-1], [0]
        for i, term in enumerate(terms):
            node = 0
            for c in term.text:
                down = self.children[node]
                if self.letters[c] not in down:
                    down[self.letters[c]] = len(self.children)
                    self.children.append({})
                    for per_node, none in ((self.whole, -1), (self.stem, -1), (self.most, 0)):
                        per_node.append(none)
                node = down[self.letters[c]]
                self.most[node] = max(self.most[node], term.edits)
            (self.stem if term.stem else self.whole)[node] = i
        self.limit = [t.edits for t in terms]
        self.start()

    def start(self) -> None:
        self.sets: list[tuple[frozenset, int]] = [(frozenset(), -1), (frozenset({(0, 0, 0)}), -1)]
        self.number = {s: k for k, s in enumerate(self.sets)}
        self.table = np.full((64, len(self.letters) + 1), -1, dtype=np.int32)
        self.table[0] = 0
        self.found = np.full((64, 2), -1, dtype=np.int32)

    def _closed(self, positions: set) -> set:
        """With terms' letters that the word lacks."""
        todo = list(positions)
        while todo:
            node, e, owed = todo.pop()
            if node and not owed:
                for down in self.children[node].values():
                    if e < self.most[down] and (down, e + 1, 0) not in positions:
                        positions.add((down, e + 1, 0))
                        todo.append((down, e + 1, 0))
        return positions

    def _next(self, state: int, c: int) -> int:
        at, stem = self.sets[state]
        new = set()
        for node, e, owed in at:
            if owed:  # a swap: this letter must be the one passed over
                if c == owed:
                    new.add((node, e, 0))
                continue
            if c in self.children[node]:
                new.add((self.children[node][c], e, 0))
            if node and e < self.most[node]:
                new.add((node, e + 1, 0))
                for x, down in self.children[node].items():
                    if x != c and e < self.most[down]:
                        new.add((down, e + 1, 0))
                    if c in self.children[down] and x != c and e < self.most[self.children[down][c]]:
                        new.add((self.children[down][c], e + 1, x))
        for node, e, owed in new:
            if not e and not owed and self.stem[node] >= 0:
                stem = self.stem[node]
        new = self._closed(new)
        least: dict[tuple, int] = {}
        for node, e, owed in new:
            least[node, owed] = min(e, least.get((node, owed), e))
        key = (frozenset((n, e, o) for (n, o), e in least.items()), stem)
        if key not in self.number:
            k = self.number[key] = len(self.sets)
            self.sets.append(key)
            if k == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.found = np.concatenate([self.found, np.full_like(self.found, -1)])
            ends = [(e, self.whole[n]) for n, e, o in key[0] if not o and self.whole[n] >= 0 and e <= self.limit[self.whole[n]]]
            self.found[k] = min(ends)[::-1] if ends else (stem, 0)
        self.table[state, c] = self.number[key]
        return self.number[key]

    def run(self, folded: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(term or -1, edits) of each word: the nearest whole term, else the longest stem."""
        if len(self.sets) > MOST_STATES:
            self.start()
        size = np.array([len(w) for w in folded], dtype=np.int64)
        points = np.frombuffer("".join(folded).encode("utf-32-le"), dtype="<u4")
        alphabet, at = np.unique(points, return_inverse=True)
        letters = np.array([self.letters.get(chr(p), 0) for p in alphabet], dtype=np.int64)[at] if len(alphabet) else at
        first = np.cumsum(size) - size
        state = np.ones(len(folded), dtype=np.int32)
        alive, k = np.flatnonzero(size > 0), 0
        while len(alive):
            c = letters[first[alive] + k]
            to = self.table[state[alive], c]
            lacking = np.flatnonzero(to < 0)
            for s, x in set(zip(state[alive[lacking]].tolist(), c[lacking].tolist())):
                self._next(s, x)
            state[alive] = self.table[state[alive], c]
            k += 1
            alive = alive[(state[alive] != 0) & (size[alive] > k)]
        return self.found[state, 0], np.maximum(self.found[state, 1], 0)


def _slice_words(text: pa.Array):
    """(document of each word, number of each word's form, forms, first word of each document)."""
    data, off = utf8(text)
    starts, ends, first = words(data, off)
    bounds = np.append(0, np.cumsum(ends - starts))
    forms = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[~SPACE[data]])]).dictionary_encode()
    return np.repeat(np.arange(len(text)), np.diff(first)), np.asarray(forms.indices, dtype=np.int64), forms.dictionary.to_pylist(), first


N_INPUTS = 4


@dataclass
class Model:
    terms: list[Term]
    ordinary: frozenset[str] = frozenset()
    bias: float = -3.0
    weights: np.ndarray = field(default_factory=lambda: np.array([6.0, 6.0, 0.5, 0.5]))

    def __post_init__(self):
        self.automaton = None

    def matches(self, text: pa.Array):
        """(word's document, its term, edits, weight in its context, beside an address, form) of all matches, and the words of each document."""
        if self.automaton is None:
            self.automaton = Automaton(self.terms)
        doc, form, forms, first = _slice_words(text)
        folded = [fold(w) for w in forms]
        term, edits = self.automaton.run(folded)
        if self.ordinary:
            for k in np.flatnonzero((term >= 0) & (edits > 0)).tolist():
                if folded[k] in self.ordinary:
                    term[k] = -1
        hit = np.flatnonzero(term[form] >= 0) if len(form) else form
        if not len(hit):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none, np.zeros(0), np.zeros(0, dtype=bool), [], np.diff(first)

        def before(kind: np.ndarray) -> np.ndarray:
            return np.append(0, np.cumsum(kind[form]))

        address, report = set(ADDRESS), set(REPORT)
        opens = before(np.array([w[0] in OPEN for w in forms]))
        closes = before(np.array([w.rstrip(".,;:!?")[-1:] != "" and w.rstrip(".,;:!?")[-1] in CLOSE for w in forms]))
        addressed, reported = (before(np.array([w in kinds for w in folded])) for kinds in (address, report))
        low, high = np.maximum(hit - WINDOW, first[doc[hit]]), np.minimum(hit + WINDOW + 1, first[doc[hit] + 1])
        inside = (opens[hit + 1] - opens[low] > closes[hit] - closes[low]) & (closes[high] > closes[hit])
        beside_report = reported[high] > reported[low]
        beside_address = addressed[high] > addressed[low]
        weight = np.array([t.worth for t in self.terms])[term[form[hit]]] * 0.7 ** edits[form[hit]] * np.where(inside, 0.25, 1.0) * np.where(beside_report, 0.5, 1.0) * np.where(beside_address, 1.3, 1.0)
        return doc[hit], term[form[hit]], edits[form[hit]], weight, beside_address & ~inside, [folded[k] for k in form[hit]], np.diff(first)

    def inputs(self, matches: tuple) -> np.ndarray:
        """Of each text: saturated sums over whole words and over stems, addresses, different terms."""
        doc, term, _, weight, addressed, _, n = matches
        stem = np.array([t.stem for t in self.terms], dtype=bool)[term] if len(term) else np.zeros(0, dtype=bool)
        total = lambda mask: np.bincount(doc[mask], weight[mask], len(n))
        different = np.bincount(np.unique(doc * max(1, len(self.terms)) + term) // max(1, len(self.terms)), minlength=len(n)) if len(doc) else np.zeros(len(n))
        return np.column_stack([1 - np.exp(-1.5 * total(~stem)), 1 - np.exp(-1.5 * total(stem)), np.log1p(np.bincount(doc[addressed], minlength=len(n))), np.log1p(np.maximum(different - 1, 0))])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + x @ self.weights, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, hold: float = 0.3, steps: int = 30) -> Model:
        """Logistic loss, held to the weights of before by ``hold``, by Newton's method; weights stay positive."""
        prior = np.append(self.bias, self.weights)
        beta, full = prior.copy(), np.column_stack([np.ones(len(y)), x])
        ridge = np.diag(np.append(1e-3, np.full(len(self.weights), hold)))
        for _ in range(steps if len(y) else 0):
            p = 1 / (1 + np.exp(-np.clip(full @ beta, -30, 30)))
            grad = full.T @ (p - y) + ridge @ (beta - prior)
            step = np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + ridge + 1e-9 * np.eye(len(beta)), grad)
            beta = beta - step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
            beta[1:] = np.maximum(beta[1:], 0)
        self.bias, self.weights = float(beta[0]), beta[1:]
        return self


def held_out(id_: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(id_.cast("string").cast("binary")) % 4 == 2


def _terms_of(it):
    """(id, label, term, stem): different words and stems of each text."""
    for batch in it:
        for a, b in text_slices(batch.column("text")):
            doc, form, forms, _ = _slice_words(batch.column("text").slice(a, b - a))
            kinds = np.unique(doc * max(1, len(forms)) + form)
            folded = [fold(w) for w in forms]
            rows: set[tuple[int, str, bool]] = set()
            for key in kinds.tolist():
                d, k = divmod(key, len(forms))
                w = folded[k]
                if STEMS[0] <= len(w) <= 40:
                    rows.add((d, w, False))
                    rows.update((d, w[:n], True) for n in STEMS if n < len(w))
            if rows:
                at, term, stem = zip(*rows)
                label = batch.column("label").slice(a, b - a).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([label, pa.array(term), pa.array(stem)], names=["label", "term", "stem"])


def lexicon(texts: DataFrame, least: int = 4, odds: float = 3.0) -> list[Term]:
    """Terms of (text, label): those in at least ``least`` toxic texts whose
    logarithm of odds is at least ``odds``; worth grows with both.

    Terms with more toxic texts come first, and of equals the shorter. One is
    left out where one before it is its stem; a stem also where a whole word or
    a longer stem has nearly all of its toxic texts. Words that no clean text
    and many toxic ones have forgive edits.
    """
    n = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    counted = texts.mapInArrow(_terms_of, "label int, term string, stem boolean").groupBy("term", "stem").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    gain = F.log((F.col("toxic") + 0.5) / (n.get(1, 0) + 1)) - F.log((F.col("clean") + 0.5) / (n.get(0, 0) + 1))
    rows = counted.withColumn("gain", gain).where((F.col("toxic") >= least) & (F.col("gain") >= odds))
    rows = rows.orderBy(F.desc("toxic"), F.length("term"), "term", "stem").limit(20 * MOST_TERMS).collect()
    below: dict[str, float] = {}  # of each stem, the share of toxic texts that make it needless
    for r in rows:
        for k in STEMS:
            if k < len(r["term"]) + (not r["stem"]):
                share = r["toxic"] / (0.9 if r["stem"] else 0.8)
                below[r["term"][:k]] = max(share, below.get(r["term"][:k], 0))
    taken: list[Term] = []
    stems: set[str] = set()
    for r in rows:
        term, stem = r["term"], r["stem"]
        if any(term[:k] in stems for k in STEMS if k <= len(term)) or (stem and below.get(term, 0) > r["toxic"]):
            continue
        if stem:
            stems.add(term)
        sure = not stem and not r["clean"] and r["toxic"] >= 4 * least
        taken.append(Term(term, stem, edits_of(term) if sure else 0, min(1.0, r["gain"] / 6) * r["toxic"] / (r["toxic"] + least)))
        if len(taken) == MOST_TERMS:
            break
    return taken


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, more_terms: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of label_col from rows of labels that are not held out.

    Rows with a null id or label, or one other than 0 and 1, teach nothing; an
    id with several labels counts with the largest, and one with several texts
    with the first in order. With more than most_rows ids, those with the
    smallest hash are taken. more_terms are terms of worth 1 besides the found
    ones. Without any labels there are only these.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    texts = texts.groupBy("id", "label").agg(F.min("text").alias("text"))
    texts = written(texts, "labelled")  # at most most_rows, read by four passes
    own = {fold(t) for t in more_terms if fold(t)}
    model = Model([t for t in lexicon(texts) if t.stem or t.text not in own] + [Term(t, False, edits_of(t)) for t in sorted(own)])

    def near(it):
        for batch in it:
            for a, b in text_slices(batch.column("text")):
                edits, form = (model.matches(batch.column("text").slice(a, b - a))[k] for k in (2, 5))
                yield pa.RecordBatch.from_arrays([pa.array([f for f, e in zip(form, edits) if e], pa.string())], names=["form"])

    clean = texts.where("label = 0").mapInArrow(near, "form string").groupBy("form").count()
    model.ordinary = frozenset(r["form"] for r in clean.orderBy(F.desc("count"), "form").limit(MOST_ORDINARY).collect())

    def inputs(it):
        for batch in it:
            for a, b in text_slices(batch.column("text")):
                x = model.inputs(model.matches(batch.column("text").slice(a, b - a)))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * N_INPUTS, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("id", "label")), flat], names=["id", "label", "x"])

    table = texts.select(F.col("id").cast("long").alias("id"), "label", "text").mapInArrow(inputs, "id long, label int, x array<double>").toArrow().sort_by([("id", "ascending")]).combine_chunks()
    x = np.asarray(table["x"].combine_chunks().flatten(), dtype=float).reshape(-1, N_INPUTS)
    return model.fit(x, np.asarray(table["label"], dtype=float))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score, predicted, n_matches, terms for each row of docs.

    terms lists the different terms found. Null and empty texts are scored as
    texts without words; rows with equal texts have equal scores. A null id is
    not held out. Other columns are not read; no rows give no rows.
    """

    def run(it):
        for batch in it:
            for a, b in text_slices(batch.column("text")):
                matches = model.matches(batch.column("text").slice(a, b - a))
                p, (doc, term) = model.probability(model.inputs(matches)), matches[:2]
                per: list[set[str]] = [set() for _ in range(b - a)]
                for d, t in set(zip(doc.tolist(), term.tolist())):
                    per[d].add(str(model.terms[t]))
                columns = [pa.array(p), pa.array(np.bincount(doc, minlength=b - a), pa.int64()), pa.array([sorted(t) for t in per], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("id", "held_out")), *columns], names=["id", "held_out", "score", "n_matches", "terms"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    out = spread(rows).mapInArrow(run, "id long, held_out boolean, score double, n_matches long, terms array<string>")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_matches", "terms")
