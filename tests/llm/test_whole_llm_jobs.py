"""Training-data operators do the whole job."""

import html
import os
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonagrid.llm import common, embeddings, html_text, sharding, substring, warc


@pytest.mark.parametrize("shards", [1000, 2000])
def test_many_shards_return_every_row(spark, shards):
    rows = spark.range(shards * 3 + 7).withColumnRenamed("id", "k")
    got = sharding.shard_rows(rows, "k", shards).collect()
    assert sorted(r.k for r in got) == list(range(shards * 3 + 7))
    counts = Counter(r.shard for r in got)
    assert sorted(counts) == list(range(shards)) and set(counts.values()) <= {3, 4}
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(counts[s])) for s in range(0, shards, 97))


def _words(n, word="word"):
    return " ".join([word] * (n // (len(word) + 1)))


@pytest.mark.parametrize(
    "page, parts",
    [
        # a split body: the lead is less than a third of the text
        (f"<div class=post><div class=lead>{_words(300, 'lead')}</div><div class=rest>{_words(1200, 'rest')}</div></div>", ["lead", "rest"]),
        # a heading outside of the body's container
        (f"<div class=post><h1>Heading</h1><div class=body><p>{_words(400)}</p><p>{_words(500)}</p></div></div>", ["Heading", "word"]),
        # a list and a quotation with most of the characters
        (f"<div><h2>Heading</h2><p>{_words(200, 'intro')}</p><ul>" + f"<li>{_words(300, 'item')}</li>" * 5 + "</ul></div>", ["Heading", "intro", "item"]),
        (f"<div><h2>Heading</h2><blockquote><p>{_words(900, 'quote')}</p><p>{_words(900, 'more')}</p></blockquote></div>", ["Heading", "quote", "more"]),
        # several articles, a short one among them
        (f"<body><article><p>{_words(900, 'first')}</p></article><article><h2>Two</h2><p>short</p></article><article><p>{_words(300, 'third')}</p></article></body>", ["first", "Two", "short", "third"]),
        # an article that is only a teaser
        (f"<div><div><p>{_words(900, 'body')}</p></div><article><p>{_words(100, 'teaser')}</p></article></div>", ["body", "teaser"]),
    ],
)
def test_no_part_of_a_page_is_lost(page, parts):
    menu = "<nav><a href='/'>Home</a></nav><div class=menu><a href='/a'>A</a></div>"
    text = html_text.main_text(f"<html><body>{menu}{page}</body></html>")
    assert all(p in text for p in parts) and "Home" not in text


def test_vectors_of_many_dimensions_link(spark):
    rows = [(2 * d + k, [1.0] * d + [0.01 * k], "a") for d in range(1, 1102) for k in (0, 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert len(got) == len(rows)
    assert all(r.n_links == 1 and r.component_id == r.vec_id // 2 * 2 for r in got)


def test_repeated_and_null_ids_count_as_rows(spark):
    a, b, c = [1.0] + [0.0] * 7, [0.0, 1.0] + [0.0] * 6, [1.0, 0.01] + [0.0] * 6
    rows = [(1, a, "x"), (1, b, "x"), (1, a, "y"), (2, c, "x"), (3, b, "x"), (4, a, "x"), (None, a, "x"), (None, None, "x"), (5, b, None)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    have = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got)
    # x: a (ids 1, 4, null) and c (2) link; b (ids 1, 3) links; y: alone
    assert have == sorted(
        [(1, 3, 1, True), (4, 3, 1, False), (0, 3, 1, False), (2, 3, 1, False), (1, 1, 1, True), (3, 1, 1, False), (1, 0, 1, True), (0, 0, 0, False), (5, 0, 5, True)]
    )


def test_words_that_sums_of_powers_confuse_are_told_apart(spark):
    one = ""
    for i in range(1024):
        one += "ab"[i.bit_count() % 2]
    other = one.translate(str.maketrans("ab", "ba"))
    rest = [f"w{i}" for i in range(60)]
    texts = [" ".join(rest[:30] + [w] + rest[30:]) for w in (one, other, one)]
    got = {r.doc_id: r.n_removed for r in substring.dedup_substrings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 61}
    # the same with words in place of letters
    one, other = (" ".join("ab"[(i.bit_count() + k) % 2] for i in range(4096)) for k in (0, 1))
    data = np.frombuffer((one + " " + other).encode(), dtype=np.uint8)
    starts, ends, _ = common.words(data, np.array([0, len(data)]))
    hashes = common.run_hashes(common.word_hashes(data, starts, ends), 4096)
    assert len(hashes) == 4097 and hashes[0] != hashes[-1]


def test_word_hashes_of_each_length_differ_by_word_and_key():
    text = " ".join("x" * n + c for n in range(70) for c in "ab")
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    starts, ends, _ = common.words(data, np.array([0, len(data)]))
    both = [common.word_hashes(data, starts, ends, key) for key in (0, 1)]
    assert len(set(both[0].tolist()) | set(both[1].tolist())) == 280
    shifted = np.frombuffer(("zz " + text).encode(), dtype=np.uint8)
    starts, ends, _ = common.words(shifted, np.array([0, len(shifted)]))
    assert (common.word_hashes(shifted, starts, ends)[1:] == both[0]).all()


def test_hot_keys_join_as_others_do(spark):
    rows = spark.range(3000).selectExpr("if(id < 1000, 7, id) as k", "id as v")
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("most")).where("k < 2000")
    for how in ("inner", "left", "left_semi"):
        got = common.join_by_key(rows, keyed, ["k"], "n", how=how)
        want = rows.join(keyed.drop("n"), "k", how)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_archives_are_equal_byte_for_byte_on_every_partitioning(spark, tmp_path):
    pages = spark.range(40_000).selectExpr(
        "case when id < 9000 then null when id < 15000 then 77 when id < 15010 then -id else id * id * id end as page_id",
        "concat('http://h/', id) as url",
        "if(id % 10 = 0, 'the same page', repeat(md5(cast(id as string)), 3 + int(id % 7))) as html",
    )
    sums = []
    for name, parts in (("a", 8), ("b", 3), ("c", 8)):
        manifest = warc.write(pages.repartition(parts), f"file://{tmp_path}/{name}", roll_bytes=100_000, range_bytes=300_000).collect()
        assert sum(r.records for r in manifest) == 40_000 and len(manifest) > 20
        assert max(r.bytes for r in manifest) < 110_000
        sums.append(sorted((r.path.rsplit("/", 1)[1], r.records, r.sha256) for r in manifest))
        assert not list((tmp_path / name).glob("_tmp*"))
    assert sums[0] == sums[1] == sums[2]
    back = warc.read(spark.read.parquet(f"file://{tmp_path}/a/_manifest"), f"file://{tmp_path}/a")
    got = back.groupBy("page_id").count().where("count > 1").collect()
    assert {(r.page_id, r["count"]) for r in got} == {(None, 9000), (77, 6000)}


def test_ranges_are_in_order_and_of_bounded_size(spark):
    ids = [None] * 3 + [-(1 << 63), -5, 0, 1, 2, 3, 1 << 40, (1 << 63) - 1] + list(range(1000, 1400))
    rows = spark.createDataFrame([(i, f"{k % 256:02x}", 10) for k, i in enumerate(ids)] + [(9, f"{k:02x}", 10) for k in range(256)], "page_id long, sha string, bytes long")
    leaves, parts = warc.ranges(rows, 100)
    got = warc._with_part(rows, leaves).collect()
    assert all(r.part is not None for r in got) and parts == 1 + max(r.part for r in got)
    size = {}
    for r in got:
        size[r.part] = size.get(r.part, 0) + r.bytes
    assert max(size.values()) <= 100 and len(size) >= 67
    order = sorted(got, key=lambda r: (-(1 << 63) if r.page_id is None else r.page_id, r.sha if r.page_id == 9 else ""))
    assert all(a.part <= b.part for a, b in zip(order, order[1:]))


def test_a_file_that_is_there_already_is_not_in_the_way(tmp_path):
    for data in (b"one", b"one", b"other"):
        writer = warc._Writer(f"file://{tmp_path}", 1000, 5)
        writer.add(3, 1, data)
        done = writer.close()
    assert [x.name for x in tmp_path.iterdir()] == ["part-000003-000000.warc.gz"]
    assert done["bytes"] == (tmp_path / "part-000003-000000.warc.gz").stat().st_size


def test_marks_of_spans_headings_and_named_sections_take_no_text():
    text = html_text.main_text(
        "<body><article><h1 class='banner-title'>Head</h1><p>A paragraph of <span class='comment'>these very</span> words, long enough to count.</p>"
        "<section class='related-work'><h2>Related work</h2><p>Others have written of this before, at some length.</p></section>"
        "<div class='related'><p>Read also this</p></div></article></body>"
    )
    assert text == "Head\nA paragraph of these very words, long enough to count.\nRelated work\nOthers have written of this before, at some length."


def test_ratios_leave_out_unmarked_boxes_of_links():
    links = "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(8))
    text = html_text.main_text(f"<body><div><div><ul>{links}</ul></div><p>{_words(300)}</p><p>Short.</p><ul><li>An item</li><li>Another, <a href='/x'>see x</a></li></ul><p>{_words(300)}</p></div></body>")
    assert text == "\n".join([_words(300), "Short.", "An item", "Another, see x", _words(300)])


@pytest.mark.parametrize("piece", ["<div>x", "<b>x<div>", "</b></i>x<i>", "<p>x", "<ul><li>x", "x</div>", "<a href=x>y</p>", "<span><div class=ad>x</span>"])
def test_time_is_in_proportion_to_the_page(piece):
    html_text.main_text(piece * 1000)
    began = time.process_time()
    html_text.main_text(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 8


def test_text_of_generated_pages_is_that_of_their_articles():
    """A plain reading of the articles of real pages: the paragraphs between their tags."""
    rows = pytest.importorskip("pyarrow.parquet").read_table("/root/testdata/sf0.001/pages.parquet").to_pylist() if os.path.exists("/root/testdata/sf0.001/pages.parquet") else []
    block = re.compile(r"</?(?:p|h[1-6]|div|ul|ol|li|table|tr|td|section|blockquote)\b[^>]*>", re.I)
    for r in rows:
        if (r["html"] or "").count("<article") != 1 or re.search("<(aside|nav|form|script|div|section|figure|pre|header|footer|button)", r["html"].split("<article")[1].split("</article")[0]):
            continue
        body = r["html"].split("<article")[1].partition(">")[2].split("</article")[0]
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", x))).split()) for x in block.split(body)]
        assert html_text.main_text(r["html"]) == "\n".join(x for x in lines if x), r["page_id"]


def test_blocks_and_bundles_of_any_size_find_the_same_links(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((6, 12))
    rows = [(i, [float(v) for v in base[i % 6] + 0.15 * rng.standard_normal(12)], str(i % 2)) for i in range(240)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    want = sorted(map(str, embeddings.near_duplicates(vectors).collect()))
    assert sum(r[1] for r in embeddings.near_duplicates(vectors).select("vec_id", "n_links").collect()) > 1000
    for name, value in (("BLOCK", 5), ("BUNDLE", 1), ("PAIRS", 3)):
        monkeypatch.setattr(embeddings, name, value)
    assert sorted(map(str, embeddings.near_duplicates(vectors).collect())) == want


@pytest.mark.parametrize("lo_hi", [(0, 0), (0, 1)])
def test_links_of_blocks_are_those_of_all_pairs(lo_hi):
    import pyarrow as pa

    rng = np.random.default_rng(7)
    x = np.repeat(rng.standard_normal((5, 8)), 8, axis=0) + 0.1 * rng.standard_normal((40, 8))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    lo, hi = lo_hi
    block = np.zeros(40, dtype=int) if lo == hi else np.arange(40) % 2
    table = pa.table(
        {
            "c": np.arange(40), "t": np.zeros(40, dtype=np.int32), "cell": np.arange(40) % 2 if lo == hi else np.zeros(40, dtype=int), "block": block,
            "times": np.ones(40, dtype=int), "embedding": pa.array(x.tolist()), "width": [1] * 40, "lo": [lo] * 40, "hi": [hi] * 40,
        }
    )
    got = embeddings._links(0.93, 1e-3)(table)
    cell = np.arange(40) % 2 if lo == hi else np.zeros(40)
    near = (unit @ unit.T >= 0.93) & (cell[:, None] == cell) & ~np.eye(40, dtype=bool)
    if lo != hi:
        near &= block[:, None] != block
    assert dict(zip(got["c"].to_pylist(), got["links"].to_pylist())) == {i: int(n) for i, n in enumerate(near.sum(axis=1)) if n}
