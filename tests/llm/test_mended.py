"""Cases that once went wrong: odd weights, names, ids, markup and partitions."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonagrid.llm import html_text, mixing, packing, simhash
from sonagrid.llm.queries import tokenizer_path

# --- mixing -----------------------------------------------------------------------


def test_any_quality_is_a_weight(spark):
    values = [None, 0.0, -1.0, float("nan"), float("inf"), 1e-300, 0.5, 1.0]
    docs = spark.createDataFrame([(i, f"one two three {i}", "ab"[i % 2], v) for i, v in enumerate(values * 5)], "doc_id long, text string, source string, q double")
    got = mixing.mix(docs, quality=F.col("q")).collect()
    assert sorted(r.doc_id for r in got) == list(range(40))
    target = {r.target for r in got}
    assert abs(sum(r.taken for r in got) - sum(target)) < 2
    # whole epochs first, so what the weights decide is who has one copy more
    more = {i: sum(r.taken for r in got if r.doc_id % 8 == i) for i in (1, 6, 7)}
    assert more[1] <= more[6] + more[7]


def test_names_of_the_operators_may_be_columns(spark):
    names = ["__id", "__tie", "__from", "__n", "id", "tie", "from", "n", "size", "taken", "own", "left", "row", "c0", "kept"]
    docs = spark.createDataFrame([(i, f"word {i % 3} " * 30, "ab"[i % 2]) for i in range(12)], "doc_id long, text string, source string")
    docs = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    out = mixing.mixture(docs)
    assert out.columns == docs.columns and out.count() > 0
    assert {tuple(r[n] for n in names) for r in out.collect()} == {tuple(range(len(names)))}
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2]


# --- simhash ----------------------------------------------------------------------


def test_rows_without_an_id_link(spark, monkeypatch):
    prints = {1: 0, None: 0xF, 2: 0xFF, 7: 0xFFFFF << 40, 8: (0xFFFFF << 40) | 0x1F}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *a: docs.selectExpr("doc_id as doc", "n_chars as fp"))
    docs = spark.createDataFrame([(k, "x", v) for k, v in prints.items()] + [(None, "y", 0x3FFFF << 20)], "doc_id long, text string, n_chars long")
    got = {(r.doc_id, r.fingerprint): (r.component_id, r.kept) for r in simhash.near_duplicates(docs).collect()}
    assert got == {
        (1, f"{0:016x}"): (1, True),
        (None, f"{0xF:016x}"): (1, False),
        (2, f"{0xFF:016x}"): (1, False),
        (7, f"{0xFFFFF << 40:016x}"): (7, True),
        (8, f"{(0xFFFFF << 40) | 0x1F:016x}"): (8, True),
        (None, f"{0x3FFFF << 20:016x}"): (None, False),
    }


# --- HTML -------------------------------------------------------------------------


@pytest.mark.parametrize("part", ["<a ", "<!--", "<![x[", "<?p", "</a ", "<!x", "<a b='", '<a b="', "<![CDATA[", "<script></x ", "<div>", "</p", "&#", "&x", "<a b='>", "<!-- >", "<![x[ >", "<a <b>", "<![CDATA[>", "<style><", "<p><b><i>"])
def test_hostile_markup_takes_time_in_proportion(part):
    page = f"<p>begin {'word ' * 100}</p>" + part * ((1 << 20) // len(part))
    began = time.time()
    text = html_text.main_text(page)
    assert time.time() - began < 8, part
    assert "begin word" in text


def test_no_soup_of_tags_raises():
    rng = random.Random(1)
    parts = ["<", ">", "<a", "<!", "<!-", "<!--", "-->", "--!>", "<![", "<![x[", "]]>", "]>", "<![CDATA[", "<!doctype", "<?", "</", "/>", "<p>", "</p>", "<script>", "</script", "<style>", "'", '"', "=", " ", "x", "&", "&#", "&#x", ";", "<article>", "</article>", "<div class='", "<br", "\n", "\x00", "é", "<!DOCTYPE html [", "<title>", "<svg/", "<!ELEMENT", "<![if x]>"]
    for _ in range(10_000):
        html_text.main_text("".join(rng.choices(parts, k=rng.randrange(1, 14))))


@pytest.mark.parametrize(
    "page, text",
    [
        ("<![foo[ bar ]]>hello", "hello"),
        ("<p>one</p><![CDATA[ x > y ]]><p>two</p>", "one\ntwo"),
        ("<p>one</p><!-- never closed <p>two</p>", "one\ntwo"),
        ("<p>one <b>two</b></p><p>5 < 6 and <a", "one two\n5 < 6 and <a"),
        ("<p>one</p><!-- tail", "one"),
    ],
)
def test_markup_that_never_ends(page, text):
    assert html_text.main_text(page) == text


# --- packing ----------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 16, 200])
def test_padding_does_not_follow_the_partitions(spark, parts):
    rng = np.random.default_rng(1)
    texts = [(i, " ".join(rng.choice(["river", "stone", "lamp", "a", "window", "quiet"], int(rng.integers(1, 1600))))) for i in range(1000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(parts)
    got = packing.pack_documents(docs, tokenizer_path(), most_tokens=4096).toPandas()
    for (_, doc), n in {((d, d), t) for d, t in zip(got.doc_id, got.doc_tokens)}:
        mine = got[got.doc_id == doc].sort_values("start")
        assert mine.start.tolist() == np.append(0, mine.length.cumsum()[:-1]).tolist() and mine.length.sum() == n
    filled = 0
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == np.append(0, rows.length.cumsum()[:-1]).tolist() and rows.length.sum() <= 4096
        filled += 1
    assert set(got.doc_id) == set(range(1000))
    tokens = got.length.sum()
    assert 1 - tokens / (4096 * filled) < 0.01, (filled, tokens)
