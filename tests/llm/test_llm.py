"""The ten operators against brute force on small tables with every odd row:
nulls in each column, empty and long texts, ties, repeated rows, no rows, and
columns whose names clash with those used inside."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sonagrid.llm import common, embeddings, html_text, mixing, packing, quality_model, rules, sharding, simhash, substring, warc
from sonagrid.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, doc string, tag int, cell int, rank long, id long, size int, found string"


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("abcdefgé"), rng.integers(1, 8))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    long, passage = say(20_000), say(60)
    base = say(200)
    out = {
        0: base,
        1: None,
        2: "",
        3: " \t\n ",
        4: base,
        5: say(80) + "\n" + passage + "\t" + say(40),
        6: passage + " " + say(30),
        7: long,
        8: "x " * 400,
        9: say(10) + " " + "wörter  zusammen " + say(3),
        10: " ".join(base.split()[:120] + ["changed"] + base.split()[121:]),
        11: long + " end",
        12: "one",
        13: "x x x x " * 30,
        14: passage,
        15: base.upper(),
        16: say(49),
        17: "!! ## $$ " * 30,
        18: say(50) + "\n\n" + say(50) + "\n" + say(5) + "\r\n" + say(5),
    }
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", None, "clash", 1, 2, 3, 4, 5, "f") for i, t in texts.items()]
    rows.append(rows[4])  # a repeated row
    rows.append((None, texts[0], None, None, None, None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words_agree_with_the_pattern(texts):
    import pyarrow as pa

    column = pa.array(list(texts.values()))
    data, off = common.utf8(column)
    starts, ends, first = common.words(data, off)
    raw = data.tobytes()
    for i, t in enumerate(texts.values()):
        assert [raw[a:b].decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])] == words(t)
    found = common.word_hashes(data, starts, ends)
    by_word = {raw[a:b]: h for a, b, h in zip(starts, ends, found)}
    assert len(set(by_word.values())) == len(by_word)
    assert all(by_word[raw[a:b]] == h for a, b, h in zip(starts, ends, found))


def test_connected_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (7, 7), (20, 30), (30, 10), (None, 3)]
    chain = [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges + chain, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 10: 10, 20: 10, 30: 10} | {i: 100 for i in range(100, 141)}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


class _Session:
    """A session's settings, without Spark."""

    def __init__(self, master, folder):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{id(self)}"})


def test_the_shared_folder_is_that_of_the_session(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert common.shared_dir(_Session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    local = _Session("local[4]", None)
    assert common.shared_dir(local) == common.shared_dir(local) != common.shared_dir(_Session("local[4]", None))
    with pytest.raises(ValueError):
        common.shared_dir(_Session("spark://host:7077", None))


def substring_truth(texts, window):
    first = {}
    for d, t in texts.items():
        w = words(t)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = {}
    for d, t in texts.items():
        w = words(t)
        keep = np.ones(len(w), bool)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                keep[i : i + window] = False
        out[d] = [x for x, k in zip(w, keep) if k]
    return out


@pytest.mark.parametrize("window", [50, 10])
def test_substring_dedup(spark, docs, texts, empty, window):
    kept = substring_truth(texts, window)
    rows = substring.dedup_substrings(docs, window, carry=("lang", "tag")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        w = kept[r.doc_id] if r.doc_id is not None else words(texts[0])
        assert r.n_words == len(words(texts[r.doc_id or 0]))
        assert r.n_removed == r.n_words - len(w)
        assert r.kept_sha256 == hashlib.sha256(" ".join(w).encode()).hexdigest()
        assert words(r.text) == w
        if not r.n_removed:
            assert r.text == texts[r.doc_id or 0]
    assert substring.dedup_substrings(empty).count() == 0


def test_substring_dedup_where_windows_overlap_in_part(spark):
    rng = np.random.default_rng(3)
    line = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
    texts = {i: " ".join(line[a:b]) for i, (a, b) in enumerate([(100, 160), (130, 260), (0, 120), (55, 105), (240, 400), (0, 400)])}
    kept = substring_truth(texts, 50)
    got = substring.dedup_substrings(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: words(r.text) for r in got.collect()} == kept


def test_longest_repeats_double_until_nothing_survives(spark, docs, texts):
    got = {r.doc_id: r.longest for r in substring.longest_repeats(docs).collect()}
    want = {7: 0, 11: 12_800}
    short = {d: t for d, t in texts.items() if d not in want}
    for d in short:
        size, best = 50, 0
        while True:
            kept = substring_truth({k: t for k, t in short.items() if k <= d}, size)
            if len(kept[d]) == len(words(texts[d])):
                break
            size, best = 2 * size, size
        want[d] = best
    assert {d: got[d] for d in texts} == want


def test_simhash(spark, docs, texts, empty):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    prints = {}
    for d, t in texts.items():
        w = words((t or "").translate(lower))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        prints[d] = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))
    component = {d: d for d in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    component[a] = component[b] = min(component[a], component[b])
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.fingerprint == f"{prints[r.doc_id or 0]:016x}"
        assert r.component_id == component[r.doc_id or 0]
        assert r.kept == (r.doc_id == r.component_id)
    assert simhash.near_duplicates(empty).count() == 0
    left = simhash.deduplicated(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted({component[d] for d in texts})


def test_hamming_links_are_those_of_brute_force(spark):
    rng = np.random.default_rng(2)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 150, dtype=np.uint64)]
    for x in fps[:60]:
        bits = rng.choice(64, rng.integers(1, 7), replace=False)
        fps.append(x ^ sum(1 << int(b) for b in bits))
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    table = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 4}
    parts, simhash.PART_ROWS = simhash.PART_ROWS, 1
    for way in (None, (3, 1), (2, 2), (5, 0)):
        assert {tuple(r) for r in simhash.hamming_links(table, 4, way).distinct().collect()} == want
    simhash.PART_ROWS = parts
    assert simhash.plan(10**6, 4) == (3, 1) and simhash.plan(10**10, 4) == (2, 2)


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 16))
    rows, i = [], 0
    for b in base:
        for scale in (0, 0, 0.02, 0.1, 0.3):
            v = b + scale * rng.standard_normal(16)
            rows.append((i, [float(x) for x in v], int(i % 7 == 0), "extra"))
            i += 1
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 16, [nan] + [1.0] * 15, [inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 8, [1.0] * 8]
    rows += [(1000 + k, v, 0, None) for k, v in enumerate(odd)] + [(2000, rows[0][1], None, None), (2001, rows[0][1], None, None)]
    rows += [(3000, [1.0] * 16, 3, None), (3001, [1.0] * 16, 3, None)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string")).collect()}
    assert len(got) == len(rows)
    ok = {r[0]: np.asarray(np.asarray(r[1], dtype=np.float32), dtype=float) for r in rows if r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1]) and r[2] is not None}
    label = {r[0]: r[2] for r in rows}
    link = lambda a, b: label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.93
    near = {a: [b for b in ok if a != b and link(a, b)] for a in ok}
    component = {r[0]: r[0] for r in rows}
    for _ in range(6):
        for a in ok:
            component[a] = min([component[a], *(component[b] for b in near[a])])
    wanted = {r[0]: len(near.get(r[0], [])) for r in rows}
    assert sum(got[i].n_links for i in wanted) >= 0.99 * sum(wanted.values())
    assert all(got[i].n_links <= wanted[i] for i in wanted)
    assert sum(got[i].component_id != component[i] for i in wanted) <= 1
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(none).count() == 0


def test_embedding_plan_is_calibrated():
    for largest in (10, 5_000, 1_000_000):
        how = embeddings.plan(0.93, sum(largest > x for x in embeddings.widths()) + 1)
        rng = np.random.default_rng(0)
        d = rng.standard_normal((4000, embeddings.COUNTERS)) * np.sqrt(2 - 2 * 0.93)
        assert ((np.abs(d) <= embeddings.WINDOW).sum(axis=1) >= how["count"]).mean() > 0.99


def test_quality_model_learns_and_scores_every_row(spark, docs, empty, texts):
    rng = np.random.default_rng(5)
    rows, marks = [], []
    for i in range(400):
        good = i % 3 > 0
        w = rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"], 60)
        rows.append((i, " ".join(w) if good else " ".join(x.upper() + "##" for x in w)))
        marks.append((i, int(good)))
    corpus = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks + [(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    model = quality_model.train(corpus, labels)
    got = {r.doc_id: r for r in quality_model.score(corpus, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [got[i].held_out for i in range(400)] == [i in set(held) for i in range(400)]
    assert np.mean([got[i].predicted == (i % 3 > 0) for i in held]) > 0.95
    out = quality_model.score(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert len({r.score for r in out if r.doc_id in (0, 4)}) == 1
    assert quality_model.score(empty, model).count() == 0
    untaught = quality_model.train(corpus, labels.limit(0))
    assert untaught.b[0] == 0
    kept = quality_model.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in out)


def test_interactions_equal_the_sum_over_pairs():
    rng = np.random.default_rng(9)
    model = quality_model.FactorisationMachine(np.zeros((quality_model.N_STATS, quality_model.BINS - 1)))
    model.b[0], model.w = 0.3, rng.normal(size=len(model.w))
    rows = [{3: 0.5, 70: 2.0, 2060: 1.5}, {}, {0: 1.0}, {k: float(k) for k in range(5, 50, 7)}]
    x = quality_model.Sparse(np.cumsum([0] + [len(r) for r in rows]), np.array([k for r in rows for k in r]), np.array([v for r in rows for v in r.values()]))
    for r, got in zip(rows, model.raw(x)):
        pairs = sum(model.v[i] @ model.v[j] * r[i] * r[j] for i in r for j in r if i < j)
        assert np.isclose(got, 0.3 + sum(model.w[i] * v for i, v in r.items()) + pairs)


def test_quality_scores_equal_a_plain_scorer(spark, docs, texts):
    """Features and score of each text again, word by word."""
    rng = np.random.default_rng(2)
    edges = np.sort(rng.random((quality_model.N_STATS, quality_model.BINS - 1)), axis=1)
    model = quality_model.FactorisationMachine(edges)
    model.w = rng.normal(size=len(model.w))

    def plain(text, n_chars):
        raw, ws = (text or "").encode(), [w.encode() for w in words(text)]
        data = np.frombuffer(b" ".join(ws), dtype=np.uint8)
        starts, ends, _ = common.words(data, np.array([0, len(data)]))
        buckets = Counter(int(h % quality_model.HASHED) for h in common.word_hashes(data, starts, ends).tolist())
        x = {k: np.log1p(n) for k, n in buckets.items()}
        norm = max(sum(v * v for v in x.values()) ** 0.5, 1e-6)
        x = {k: v / norm for k, v in x.items()}
        n, chars = len(ws), max(1, sum(c not in b" \t\n\x0b\x0c\r" for c in raw))
        some, lines = max(n, 1), raw.count(b"\n") + 1
        share = lambda chosen: sum(c in chosen for c in raw)
        upper, lower = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
        stats = [np.log1p(n), chars / some]
        stats += [share(c) / chars for c in (upper, b"0123456789", b"#*$%&|<>~^_=+@\\{}[]/", b".,;:", b"!?", bytes(range(128, 256)))]
        stats += [n / lines, (lines - 1) / some, len(set(ws)) / some, sum(a == b for a, b in zip(ws, ws[1:])) / some]
        stats += [sum(w[0] in upper for w in ws) / some, sum(w[0] in lower for w in ws) / some, sum(w[-1] in b".,;:" for w in ws) / some]
        stats += [sum(len(w) == 1 for w in ws) / some, sum(len(w) > 14 for w in ws) / some]
        stats += [-1, -1] if n_chars is None else [np.log1p(n_chars), n_chars / max(len(raw), 1)]
        for j, v in enumerate(stats):
            x[quality_model.HASHED + j * quality_model.BINS + int(np.sum(edges[j] <= v))] = 1 / len(stats) ** 0.5
        at = sorted(x)
        total = sum(model.w[i] * x[i] for i in at) + sum(model.v[i] @ model.v[j] * x[i] * x[j] for k, i in enumerate(at) for j in at[k + 1 :])
        return 1 / (1 + np.exp(-total))

    few = {d: t for d, t in texts.items() if d not in (7, 11)}
    rows = spark.createDataFrame([(d, t, None if d % 3 else len(t or "")) for d, t in few.items()], "doc_id long, text string, n_chars long")
    for r in quality_model.score(rows, model).collect():
        t = few[r.doc_id]
        assert np.isclose(r.score, plain(t, None if r.doc_id % 3 else len(t or ""))), r.doc_id


def test_training_takes_one_text_for_each_label(spark):
    docs = spark.createDataFrame([(1, f"text {i % 3}", i) for i in range(50)] + [(2, None, None), (None, "x", 1)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1)], "doc_id long, quality int")
    one, two = (quality_model.train(docs.repartition(n), labels) for n in (1, 5))
    assert (one.w == two.w).all() and (one.v == two.v).all()


def test_packing_round_trip(spark, docs, texts, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = packing.pack_documents(docs, tokenizer_path(), run_bytes=60_000).collect()
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4") for d, t in texts.items()}
    seen = Counter()
    for r in got:
        whole = ids[r.doc_id if r.doc_id is not None else 0]
        assert r.doc_tokens == len(whole)
        assert r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes())
        seen.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
    times = Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert seen == Counter({(d, k): n for d, n in times.items() for k in range(len(ids[d or 0]))})
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


def test_word_tokenizer_equals_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    odd = ["It's I'll they’re x\x85y\x1cz   á é", "<|endoftext|> a<|startoftext|>b 12345 １２", "ΑΣ ΌΔΟΣ, İstanbul ﬁ ẞ", "\t\n", "", "日本語 テキスト😀👍🏽 d'ëtre"]
    coder, whole = packing.WordTokenizer(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    odd += ["So, it is.", "well,### don'. x!' a<b. C++: 3.5%!", "<|ENDOFTEXT|> Ab."]
    for skip in (0, 1, 3):  # slices, with and without a special token among them
        ids, off = coder.encode(pa.array(odd).slice(skip))
        assert off[-1] == len(ids)
        for i, t in enumerate(odd[skip:]):
            assert ids[off[i] : off[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids, t
    ids, off = coder.encode(pa.array(odd))
    for i, t in enumerate(odd):
        assert ids[off[i] : off[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_any_other_tokenizer_encodes_whole_texts():
    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = packing.coder(path)
    assert isinstance(coder, packing.WholeTokenizer) and isinstance(packing.coder(tokenizer_path()), packing.WordTokenizer)
    texts = ["Some  Text, it's\n here", None, "", "é <|endoftext|> x"]
    ids, off = coder.encode(pa.array(texts))
    whole = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids


def naive_pack(tokens, loss, limits, cut):
    """The heuristic item by item: a list of bins, each a list of (tokens, loss) taken."""
    items = [(t, x) for t, x in zip(tokens, loss) if t]
    bins = []
    if not cut:
        bins = [[i] for i in sorted(items) if i[0] > limits[0] or i[1] > limits[2]]
        items = [i for i in items if i[0] <= limits[0] and i[1] <= limits[2]]
    while items:
        left, taken = list(limits), []
        demand = [sum(t for t, _ in items) / limits[0], len(items) / limits[1], sum(x for _, x in items) / limits[2]]
        weight = [d / sum(demand) for d in demand]
        while left[0] and left[1]:
            pull = [w * v / m / m for w, v, m in zip(weight, left, limits)]
            found = []
            for rank in (0, 1):
                for t, x in items:
                    some = min(t, left[0], t - x + left[2])
                    borne = max(0, some - (t - x))
                    fits = some == t or (cut and some > 0 and (rank == 1 or t > limits[0] or x > limits[2]))
                    if fits:
                        found.append((some * pull[0] + pull[1] + borne * pull[2], t, x, some, borne))
                if found or not cut:
                    break
            if not found:
                break
            best = max(f[0] for f in found)
            _, t, x, some, borne = max((f for f in found if np.isclose(f[0], best, rtol=1e-12)), key=lambda f: f[1:3])
            items.remove((t, x))
            if some < t:
                items.append((t - some, x - borne))
            taken.append((some, borne))
            left = [left[0] - some, left[1] - 1, left[2] - borne]
        bins.append(taken)
    return bins


@pytest.mark.parametrize("cut", [True, False])
@pytest.mark.parametrize("seed", range(4))
def test_pack_is_the_dot_product_heuristic(seed, cut):
    rng = np.random.default_rng(seed)
    tokens = np.where(rng.random(250) < 0.1, rng.integers(1000, 5000, 250), rng.integers(0, 700, 250))
    loss = np.maximum(0, tokens - 64) if seed % 2 else (tokens * rng.random(250)).astype(int)
    got = {}
    for _, _, length, bin_, offset, x in packing.pack(tokens, loss, 1000, 6, 700, cut):
        got.setdefault(bin_, []).append((offset, length, x))
    got = [[p[1:] for p in sorted(got[b])] for b in sorted(got)]
    assert got == naive_pack(tokens.tolist(), loss.tolist(), (1000, 6, 700), cut)


def test_the_loss_limit_decides_what_shares_a_sequence():
    # long examples that bear loss throughout, and short ones that bear none
    plan = packing.pack([900] * 10 + [100] * 10, [600] * 10 + [0] * 10, 1000, 50, 600, cut=False)
    assert max(p[3] for p in plan) == 9


def test_pack_holds_all_limits():
    rng = np.random.default_rng(6)
    tokens = rng.integers(0, 900, 400)
    loss = (tokens * rng.random(400)).astype(int)
    plan = packing.pack(tokens, loss, 1000, 6, 400)
    bins, seen = {}, Counter()
    for item, start, length, bin_, offset, x in plan:
        bins.setdefault(bin_, []).append((offset, length, x))
        seen.update((item, k) for k in range(start, start + length))
    assert seen == Counter((i, k) for i, t in enumerate(tokens) for k in range(t))
    for pieces in bins.values():
        assert sum(p[1] for p in pieces) <= 1000 and len(pieces) <= 6 and sum(p[2] for p in pieces) <= 400
    assert sum(p[5] for p in plan) == loss.sum()
    assert packing.pack([], [], 10, 2, 10) == []


def test_pack_examples_keeps_them_whole(spark):
    rng = np.random.default_rng(7)
    rows = [(i, int(t), int(t * rng.random())) for i, t in enumerate(rng.integers(1, 1500, 300))]
    rows += [(900, 5000, 10), (901, 10, None), (902, None, 5), (903, 0, 0), (None, 7, 99), (5, 40, 3)]
    got = packing.pack_examples(spark.createDataFrame(rows, "id long, n_tokens int, n_loss int"), 2000, 5, 900).collect()
    assert Counter((r.id, r.n_tokens) for r in got) == Counter((i, t or 0) for i, t, _ in rows)
    bins = {}
    for r in got:
        if r.n_tokens:
            bins.setdefault(r.sequence_id, []).append(r)
        else:
            assert r.sequence_id is None and r.offset is None
    for mine in bins.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.n_tokens
        assert len(mine) == 1 or (at <= 2000 and len(mine) <= 5 and sum(r.n_loss for r in mine) <= 900)
    assert len(bins) < 180


def test_sharding(spark, docs, texts, empty):
    got = sharding.shard_documents(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        raw = (texts[r.doc_id or 0] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    check_shards(got, 16)
    assert sharding.shard_documents(empty).count() == 0


def check_shards(rows, shards):
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


@pytest.mark.parametrize("n, shards, nodes, slack", [(1000, 5, 8, 0.0), (1003, 7, 3, 0.0), (2000, 6, 4, 0.1)])
def test_ring_overflows_clockwise(spark, n, shards, nodes, slack):
    """Row by row: home first, then clockwise to the next shard with room."""
    rows = spark.range(n).select(F.col("id").alias("k"))
    got = {r.k: r.shard for r in sharding.shard_rows(rows, "k", shards, nodes, slack).collect()}
    hashes = {r.k: r.h % (1 << 64) for r in rows.select("k", F.xxhash64(F.lit("row"), "k").alias("h")).collect()}
    shift = 64 - sharding.cell_bits(shards, nodes)
    points = sharding.ring(shards, nodes)
    arc = {k: next((i for i, (c, _) in enumerate(points) if c >= h >> shift), len(points)) for k, h in hashes.items()}
    room = [int(np.ceil((1 + slack) * n / shards)) if slack else n // shards + (s < n % shards) for s in range(shards)]
    # ranks inside a cell are those of signed hashes
    order = sorted(hashes, key=lambda k: (hashes[k] >> shift, (hashes[k] ^ 1 << 63), k))
    want, rest = {}, []
    for k in order:
        home = points[arc[k] % len(points)][1]
        if room[home]:
            want[k], room[home] = home, room[home] - 1
        else:
            rest.append(k)
    waiting, at = [], 0
    for lap in range(2):
        for i in range(len(points) + 1):
            if i < len(points) or any(arc[k] == i for k in order):
                shard = points[i % len(points)][1]
                while waiting and room[shard]:
                    want[waiting.pop(0)] = shard
                    room[shard] -= 1
            while not lap and at < len(rest) and arc[rest[at]] == i:
                waiting.append(rest[at])
                at += 1
    assert got == want


def test_one_more_shard_moves_few_rows(spark):
    rows = spark.range(20_000).select(F.col("id").alias("k"))

    def moved(slack):
        before, after = ({r.k: r.shard for r in sharding.shard_rows(rows, "k", shards, slack=slack).collect()} for shards in (16, 17))
        return sum(before[k] != after[k] for k in before) / len(before)

    assert moved(0.5) < 1.5 / 17  # hardly any shard is full: the new shard's rows move, and few others
    assert moved(0.25) < 2 / 17
    assert moved(0.0) < 0.3


def test_hot_keys_and_equal_rows_are_cut_and_shared_out(spark):
    rows = spark.range(9000).selectExpr("if(id % 3 = 0, null, id) as lo", "if(id < 3000, 1, id) as hi", "cast(null as int) as cell")
    rows = rows.unionAll(spark.range(4000).selectExpr("cast(7 as long)", "cast(7 as long)", "7"))
    for key in ("lo", "cell"):
        got = sharding.shard_rows(rows.repartition(5), key, 7, 16).collect()
        check_shards(got, 7)
        assert Counter((r.lo, r.hi, r.cell) for r in got) == Counter(tuple(r) for r in rows.collect())


def test_mixing(spark, docs, texts, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in docs.collect():
        by.setdefault(r.source, []).append(len(words(r.text)))
    order = sorted((s for s in by if s is not None)) + [None]
    size = np.array([sum(by[s]) for s in order], dtype=float)
    weight = np.array([(5, 2, 1)[i % 3] for i in range(len(order))], dtype=float)
    target, capped = size.sum() * weight / weight.sum(), np.zeros(len(order), bool)
    while (target > 3 * size + 1e-9).any():
        capped |= target > 3 * size + 1e-9
        target = np.where(capped, 3 * size, weight * (size.sum() - 3 * size[capped].sum()) / max(weight[~capped].sum(), 1e-9))
    source = {r.doc_id: r.source for r in docs.collect()}
    for k, s in enumerate(order):
        mine = [r for r in got if source[r.doc_id] == s]
        assert all(np.isclose(r.target, target[k]) and r.source_size == size[k] for r in mine)
        assert target[k] - 1 < sum(r.taken for r in mine) <= target[k] + 1e-6
        assert all(0 <= r.taken <= 3 * r["size"] for r in mine)
        if target[k] >= size[k]:
            assert all(r.taken >= r["size"] for r in mine)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(empty).count() == 0


def test_mixture_repeats_rows_and_cuts_at_the_line(spark, texts):
    docs = spark.createDataFrame([(i, t, "a" if i < 12 else "b") for i, t in texts.items()], "doc_id long, text string, source string")
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    got = Counter()
    for r in mixing.mixture(docs).collect():
        got[r.doc_id] += len(words(r.text))
        w = words(texts[r.doc_id])
        assert words(r.text) == w[: len(words(r.text))]
    assert got == Counter({d: n for d, n in taken.items() if n})


def test_mixture_of_rows_that_share_an_id_takes_what_mix_says(spark, texts):
    rows = [(None, texts[0], "a"), (None, texts[0], "a"), (None, texts[5], "a"), (3, texts[5], "b"), (3, texts[6], "b"), (3, texts[6], "b"), (4, texts[16], "b"), (5, texts[9], "c"), (6, None, "c"), (None, texts[0], "b"), (None, texts[0], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for quality in (None, F.lit(0.5)):
        want = sum(r.taken for r in mixing.mix(docs, quality=quality).collect())
        out = mixing.mixture(docs, quality=quality).collect()
        assert sum(len(words(r.text)) for r in out) == want
        assert max(Counter((r.doc_id, r.text) for r in out).values()) <= 6


def test_quality_rules(spark, docs, texts, empty):
    got = rules.apply_rules(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        t = texts[r.doc_id or 0] or ""
        w = words(t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if words(x)]
        assert r.n_words == len(w) and r.word_chars == sum(map(len, w))
        assert r.n_symbols == sum(t.count(c) for c in "#*$%&|<>")
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == len(again)
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        n, chars, lower = len(w), sum(map(len, w)), [x.rstrip(".,;:").lower() for x in w]
        full = lambda test: sum(bool(test(x)) for x in lines) / max(len(lines), 1)
        measured = {
            "n_words": n,
            "mean_word_chars": chars / n if n else 0,
            "symbols_per_word": r.n_symbols / n if n else 0,
            "stop_word_ratio": sum(x in rules.STOP_WORDS for x in lower) / n if n else 0,
            "dup_line_ratio": r.n_dup_lines / max(len(lines), 1),
            "ellipsis_line_ratio": full(lambda x: x.rstrip(" ").endswith(("...", "…"))),
            "bullet_line_ratio": full(lambda x: x.lstrip(" ")[:1] in ("-", "•", "*", "·")),
            "letter_ratio": (chars - len(re.findall(r"[!-@\[-`{-~]", t))) / chars if chars else 0,
        }
        assert all(abs(r[k] - v) < 1e-12 for k, v in measured.items())
        assert r.kept == (not r.base_failed and all((a is None or measured[k] >= a) and (b is None or measured[k] <= b) for k, a, b in rules.RULES))
    assert rules.apply_rules(empty).count() == 0


PAGES = [
    (
        "<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a></ul></nav>"
        "<div class='cookie-notice'><p>We use cookies and long words to tell you so.</p></div><article><header><h1>Head &amp; tail</h1></header><p>First  paragraph\n of the text, long enough.</p>"
        "<p>Second<script>if (a < b) track('<p>')</script> one with <b>bold <i>words</b></i> in it.<p>Third, unclosed, goes on for a while here.<ul><li>Item one<li>Item two</ul>"
        "<form><input><button>Send this form now</button></form><aside>See also other things</aside><p>Sh.</p></article>"
        "<section id='comments'><h2>Comments</h2><p>I like this a lot and write a long comment about it all.</p></section><footer>&copy; all of us</footer></body></html>",
        "Head & tail\nFirst paragraph of the text, long enough.\nSecond one with bold words in it.\nThird, unclosed, goes on for a while here.\nItem one\nItem two\nSh.",
    ),
    (
        "<body><div class='menu'><a>One</a><a>Two</a></div><div id='content'><h2>No article element</h2><div><p>Words in a box, many of them, so that it counts as content.</p></div>"
        "<p>More words follow in another paragraph of the same box.</p></div><div class='sidebar'><p>Latest posts and so on</p></div></body>",
        "No article element\nWords in a box, many of them, so that it counts as content.\nMore words follow in another paragraph of the same box.",
    ),
    (
        "<main class='has-sidebar'><div class='content with-comments'><p>Kept words of the main part of this page.</p><p style='display: none'>Hidden words of this page.</p></div>"
        "<article class='comment'><p>A reader's remark on the page.</p></article></main><div role='search'>Find</div>",
        "Kept words of the main part of this page.",
    ),
    ("just text", "just text"),
    ("", ""),
    (None, ""),
    ("<nav>only a menu</nav>", ""),
    ("<p>broken <b <i>markup</p", "broken markup"),
]


def test_html_text(spark):
    rows = [(i, None if i == 3 else "u", h, "x") for i, (h, _) in enumerate(PAGES[:-1])] + [(None, "u", "<p>no id</p>", "x"), (0, "u", PAGES[0][0], "x")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, id string")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = PAGES[r.page_id][1] if r.page_id is not None else "no id"
        assert (r.text, r.n_chars) == (want, len(want))
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(none).count() == 0
    html_text.main_text(PAGES[-1][0])
    html_text.main_text("<p>" * 3000 + "deep")


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/ä b", "<p>ä</p>"), (2, None, "<p>ä</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 300_000), (6, "u", "WARC/1.1\r\n\r\n"), (7, "u", "WARC/1.1\r\n\r\n"), (None, "u", "alone"), (8, "u", "y")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, sha string, kind int")
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), i or -1)
    for r in got:
        raw = next((h or "" for i, _, h in rows if i == r.page_id)).encode()
        assert r.payload_bytes == len(raw)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        target = last[raw.decode()]
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id is None or target == r.page_id else ("revisit", target))
    assert warc.round_trip(pages.limit(0)).count() == 0
    # small files: rolled by size, the same bytes on a second run, nothing temporary left
    many = spark.range(200).selectExpr("id as page_id", "concat('http://h/', id) as url", "repeat(md5(cast(id as string)), 50) as html").coalesce(2)
    sums = []
    for name in ("one", "two"):
        manifest = warc.write(many, f"file://{tmp_path}/{name}", roll_bytes=4000).collect()
        assert len(manifest) > 4 and sum(r.records for r in manifest) == 200
        sums.append(sorted((r.path.rsplit("/", 1)[1], r.sha256) for r in manifest))
        assert not list((tmp_path / name).glob("_tmp*"))
    assert sums[0] == sums[1]


def test_pipeline_stages_take_effect(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(800)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    passage = say(70)
    rows = []
    for i in range(120):
        text = say(100) if i % 4 else " ".join(w.upper() + "##" for w in say(100).split())
        rows.append((i, f"{text} {passage} {say(30)}" if i % 10 == 1 else text, "en", f"s{i % 3}", 0))
    rows.append((500, rows[2][1], "en", "s1", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(120)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = common.written(corpus_pipeline.quality(spark, docs, str(tmp_path)), "t")
    ids = {r.doc_id for r in kept.collect()}
    assert sum(i % 4 == 0 for i in ids if i < 500) <= 3 and sum(i % 4 > 0 for i in ids if i < 500) >= 85
    unique = common.written(corpus_pipeline.near_dedup(spark, kept, str(tmp_path)), "t")
    assert 2 in {r.doc_id for r in unique.collect()} and 500 not in {r.doc_id for r in unique.collect()}
    cut = common.written(corpus_pipeline.substring_dedup(spark, unique, str(tmp_path)), "t")
    assert sum(passage in r.text for r in cut.collect()) == 1
    mixed = common.written(corpus_pipeline.mix_sources(spark, cut, str(tmp_path)), "t")
    assert mixed.columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    for d in (kept, unique, cut):
        assert d.columns == docs.columns


def test_pipeline_stages_bear_odd_rows(spark, tmp_path, docs, empty):
    """Nulls in each column, empty and long texts, repeated rows, no rows, further columns of clashing names."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(12)] + [(None, 1), (3, None)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for rows, least in ((docs, 1), (empty, 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = common.written(stage(spark, common.written(rows, "odd"), str(tmp_path)), "stage")
            if name != "packing":
                assert out.columns == columns, name
            assert out.count() >= least, name
        now = rows
        for _, stage in corpus_pipeline.STAGES:
            now = common.written(stage(spark, now, str(tmp_path)), "stage")
        assert "sequence_id" in now.columns
    # no row without an id is lost to another one, and exact copies are one
    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()
    assert sum(r.doc_id is None for r in kept) == 1 and sum(r.doc_id == 4 for r in kept) == 0
