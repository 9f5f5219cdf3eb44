"""Toxicity, fill-in-middle and collocations against brute force."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sonagrid.llm import collocations, fill_middle, toxicity
from sonagrid.llm import queries as llm_queries

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None, None, "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n", "en", None, 3),
    (4, "é😀<P>x", "fr", "b", None),
    (5, "one two one two. one two", "en", "b", 20),
    (5, "one two one two. one two", "en", "b", 20),
    (None, "One TWO, one two", None, "c", 16),
    (7, "ab " * 40_000, "en", "c", 120_000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with names of the operators' own."""
    rows = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    return rows.selectExpr("*", "1 as id", "'x' as w", "2 as f", "'y' as key", "3 as n", "4 as label", "5 as a", "'p' as phrase", "true as held_out", "0.5D as score", "6 as `left`")


# --- fill-in-middle -----------------------------------------------------------


def _fim(doc_id, text):
    """The contract in plain Python strings."""
    text = text or ""
    x = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_equals_plain_strings(spark, odd):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    more = [(k, "".join(random.Random(k).choices("ab<PSM> \n\tüß😀", k=k % 60)), "en", "s", None) for k in range(100, 900)]
    rows = odd.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(more, SCHEMA))
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.output_sha256, r.restored_sha256) for r in fill_middle.fill_in_middle(rows).collect())
    want = Counter()
    for doc_id, text, *_ in ODD + more:
        n, form, a, b, out = _fim(doc_id, text)
        want[doc_id, n, form, a, b, out, sha(out), sha(text or "")] += 1
    assert got == want
    assert {form for _, _, form, *_ in want} == {"plain", "psm", "spm"}
    assert len(fill_middle.fill_in_middle(odd).collect()) == len(ODD)
    assert fill_middle.fill_in_middle(odd.limit(0)).collect() == []


@pytest.mark.parametrize("unit, pattern", [("word", r"[ \t-\r]+|[^ \t-\r]+"), ("line", r"[^\n]*\n|[^\n]+")])
def test_units_are_cut_where_classes_change(unit, pattern):
    rng = random.Random(4)
    for k in range(300):
        text = "".join(rng.choices("ab \n\té", k=rng.randrange(40)))
        parts = re.findall(pattern, text)
        ends = fill_middle.boundaries(np.frombuffer(text.encode("utf-32-le"), "<u4"), unit).tolist()
        assert ends == [0, *np.cumsum([len(p) for p in parts]).tolist()], (text, ends)
        form = fill_middle.Form(cut_rate=100, spm_rate=50)
        out, n, name, a, b = fill_middle.transformed(text, str(k), form, unit)
        assert n == len(parts) and fill_middle.restored(out, name, form) == text
        assert name == "plain" or {a, a + b} <= set(ends)


def test_markers_that_overlap_are_refused():
    with pytest.raises(ValueError):
        fill_middle.Form(prefix="<a<", suffix="<b>")
    with pytest.raises(ValueError):
        fill_middle.Form(middle="")


# --- collocations -------------------------------------------------------------


def _phrases(docs, least, inside, top):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n-\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            ws = re.findall(r"[^ \t]+", piece)
            n[lang] += len(ws)
            for m in range(1, 5):
                f.update((lang, *ws[i : i + m]) for i in range(len(ws) - m + 1))
    kept = {k: c for k, c in f.items() if c >= least and len(k) > 2}
    rows = {}
    for (lang, *w), a in kept.items():
        cuts = [(2_000_000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        longer = (v for p, v in kept.items() if p[0] == lang and len(p) - 1 > len(w) and any(list(p[i : i + len(w)]) == w for i in range(1, len(p))))
        if not any(100 * v >= inside * a for v in longer):
            rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in rows.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])}


@pytest.mark.parametrize("least, inside, top", [(3, 80, 2000), (2, 60, 7), (5, 101, 2000)])
def test_collocations_equal_brute_force(spark, least, inside, top):
    rng = random.Random(least)
    words = ["a", "b", "B", "cé", "d\x01", "d", "e'f", "ﬀ", "😀", "\x1f"]
    docs = [(k, "".join(w + rng.choice("     \t\t  ..,\n") for w in rng.choices(words, weights=[9, 5, 5, 3, 2, 2, 1, 1, 1, 1], k=rng.randrange(60))), rng.choice(["en", "de", None]), "s", 0) for k in range(150)] + ODD[:7]
    rows = spark.createDataFrame(docs, SCHEMA).repartition(5)
    got = {tuple(r) for r in collocations.collocations(rows, least, inside, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
    assert got == _phrases(docs, least, inside, top)


def test_collocations_of_odd_rows(spark, odd):
    got = [tuple(r) for r in collocations.collocations(odd, least=1000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert got == [("en", 1, "ab ab ab ab", 39_997, 40_000, 39_998, 40_012, 2_000_000 * 39_997 // 79_998)]
    assert collocations.collocations(odd.limit(0)).collect() == []
    assert collocations.collocations(odd.where("doc_id < 4")).collect() == []


def test_walks_look_up_ancestors_that_lie_in_another_range(spark):
    """A hot first word fills several ranges."""
    rows = [("en", ["a"], 900)] + [("en", ["a", f"w{k:03d}"], 100 + k) for k in range(300)] + [("en", ["a", "w007", f"v{k:03d}"], 30 + k) for k in range(60)] + [("en", [f"w{k:03d}"], 500) for k in range(300)]
    nodes = spark.createDataFrame(rows, "lang string, w array<string>, f long")
    f = {tuple(w): n for _, w, n in rows}
    for r in collocations._with_left(nodes).collect():
        assert r.left == [f[tuple(r.w[:k])] for k in range(1, len(r.w))]


def test_a_word_filter_loses_no_frequent_phrase(spark):
    """Passing all phrases or only the frequent ones gives the same counts."""
    docs = spark.createDataFrame([(k, f"x{k % 7} y{k % 5} z{k % 3} x{k % 7} once{k}", "en", "s", 0) for k in range(200)], SCHEMA)
    _, nodes = collocations.phrase_counts(docs, 10)
    got = {tuple(r.w): r.f for r in nodes.collect()}
    want = Counter()
    for k in range(200):
        ws = f"x{k % 7} y{k % 5} z{k % 3} x{k % 7} once{k}".split()
        want.update(tuple(ws[i : i + m]) for m in range(1, 5) for i in range(len(ws) - m + 1))
    assert got == {w: n for w, n in want.items() if n >= 10}


# --- toxicity -----------------------------------------------------------------


def _distance(a, b):
    """Edits between words, a swap of neighbours is one (no letter is edited twice)."""
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = i + j
                continue
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_the_automaton_accepts_what_edit_distance_does():
    rng = random.Random(2)
    terms = [toxicity.Term(t, False, e) for t, e in (("abca", 1), ("abcd", 0), ("bcab", 1), ("cabbac", 2), ("cabba", 1), ("aab", 0))]
    machine = toxicity.Automaton(terms)
    tried = list({"".join(rng.choices("abcx", k=rng.randrange(9))) for _ in range(4000)})
    term, edits = machine.run(tried)
    for w, t, e in zip(tried, term.tolist(), edits.tolist()):
        # the first letter stands, so edits are those of the rest
        ways = [(_distance(w[1:], x.text[1:]), i) for i, x in enumerate(terms) if w[:1] == x.text[:1]]
        ways = [(d, i) for d, i in ways if d <= terms[i].edits]
        assert (t, e) == ((min(ways)[1], min(ways)[0]) if ways else (-1, 0)), (w, ways)


def test_stems_match_beginnings_and_words_win():
    machine = toxicity.Automaton([toxicity.Term("trol", True), toxicity.Term("trollop", False, 1), toxicity.Term("scum")])
    term, edits = machine.run([toxicity.fold(w) for w in ("trolls", "TROLLOP!", "troIlop", "trollep", "control", "$cum", "scums", "tr0ll", "")])
    assert term.tolist() == [0, 1, 1, 1, -1, 2, -1, 0, -1] and edits.tolist() == [0, 0, 1, 1, 0, 0, 0, 0, 0]


def _corpus(spark, n=400):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(n):
        ws = [rng.choice("the of and river stone lamp under window table quiet road sing paper".split()) for _ in range(60)]
        toxic = k % 4 == 0
        if toxic:
            ws[rng.randrange(50)] = rng.choice(["blockhead", "nitwit", "scumbag"])
        rows.append((k, " ".join(ws), "en", "s", 0))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_terms_misspellings_and_quotation(spark, odd):
    docs, labels = _corpus(spark)
    model = toxicity.train(docs, labels)
    assert {t.text for t in model.terms if not t.stem} >= {"blockhead", "nitwit", "scumbag"}
    got = toxicity.score(docs, model).join(labels, "doc_id").collect()
    assert all((r.predicted == 1) == (r.toxic == 1) for r in got)
    assert {r.held_out for r in got} == {True, False}
    plain = "the lamp under the quiet road and the stone of the river"
    texts = {"clean": plain, "plain": f"{plain} you scumbag {plain}", "misspelt": f"{plain} you scumbgag {plain}", "signs": f"{plain} sc0mbag {plain}".replace("0", "u"), "leet": f"{plain} bl0ckhe4d! {plain}", "quoted": f'{plain} he wrote "a scumbag" {plain}', "empty": "", "null": None}
    frame = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    score = dict(zip(texts, (r.score for r in toxicity.score(frame, model).orderBy("doc_id").collect())))
    assert min(score[k] for k in ("plain", "misspelt", "signs", "leet")) >= 0.3 > score["clean"]
    assert score["quoted"] < score["plain"] and score["clean"] == score["empty"] == score["null"]
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(odd.limit(0), model).collect() == []


def test_training_without_labels_keeps_given_terms(spark, odd):
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels, more_terms=("Scoundrel",))
    frame = spark.createDataFrame([(1, "you scoundrell"), (2, "a quiet road")], "doc_id long, text string")
    assert [r.predicted for r in toxicity.score(frame, model).orderBy("doc_id").collect()] == [1, 0]
    assert toxicity.train(odd.limit(0), labels.limit(0)).terms == []


def test_ordinary_words_are_no_misspellings():
    model = toxicity.Model([toxicity.Term("moron", False, 1)], frozenset({"moran"}))
    found = lambda text: len(model.matches(pa.array([text]))[0])
    assert found("moran") == 0 and found("moron") == 1 and found("morron") == 1


def test_scores_do_not_depend_on_slices():
    model = toxicity.Model([toxicity.Term("moron", False, 1), toxicity.Term("abc", True)])
    texts = ["a moron", None, 'say "moron" now', "abcd abcd you", "", "moronn you"]
    whole = model.inputs(model.matches(pa.array(texts)))
    single = np.concatenate([model.inputs(model.matches(pa.array([t], pa.string()))) for t in texts])
    assert np.allclose(whole, single, atol=0)


# --- queries ------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_collocations"])
def test_new_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = llm_queries.queries()[name](spark, SF).toPandas()
    want = con.execute(llm_queries.oracle_sql()[name]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    got, want = (x[columns].astype(object).where(x[columns].notna(), None).sort_values(columns, key=lambda c: c.astype(str)).reset_index(drop=True) for x in (got, want))
    assert got.equals(want) or all((got[c].astype(str) == want[c].astype(str)).all() for c in columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_held_out_toxicity(spark):
    got = llm_queries.op11_toxicity(spark, "/root/testdata/sf0.1").cache()
    rows = got.where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where(F.col("toxic").isNotNull()).collect()
    assert {(r.held_out, r.score >= 0.3) for r in got.collect()} and all((r.predicted == 1) == (r.score >= 0.3) for r in rows)
    toxic = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)
