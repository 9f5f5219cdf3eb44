"""Vector bin packing of token sequences with the dot-product heuristic.

Items and bins are vectors of (tokens, segments, loss-bearing tokens). A bin
takes, again and again, the item with the largest dot product with what the bin
has left (each dimension relative to its limit, weighted by how much of it all
open items demand). Candidates are the items that fit whole, and of those too
long for any bin as much as fits. When there are none, as much of the best
other item as fits fills the bin, and its rest returns to the open items. A bin
with room for more loss-bearing tokens is so paired with items that have few.

Tasks pack what they read in runs of about ``group_bytes`` of text: nothing is
shuffled, a task's memory is bounded, no key can be hot, and bins that are not
full at a run's end return to the next one.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonagrid.llm.common import spread, text_slices, utf8, written

#: Words whose ids a tokenizing worker keeps between batches and tasks; all are dropped when there are more.
CACHE_WORDS = 800_000

#: Part-full bins that a run hands on to the next one, or to the second pass, at most; the others stay as they are.
OPEN_BINS = 64
#: Tasks whose part-full bins one task of the second pass takes: at most SHARED * OPEN_BINS sequences of ids.
SHARED = 64

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, n_loss long"
#: Pieces of the first pass; those without a sequence have their ids, and their task in ids_crc32.
OPEN_PIECES = PIECES + ", ids binary"

# The normalizer and pre-tokenizer that WordTokenizer is right for.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_PARTS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

# the signs that stand for bytes in byte-level vocabularies: printable Latin-1 as it is, the others from 256 on in turn
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class WordTokenizer:
    """Ids of whole texts from ids of their words.

    Holds for tokenizers that take text in lower case, drop white space, never
    join across it, and part letters and digits from other signs: the ids of a
    text are those of its words in turn, with the signs behind a word as a word
    of their own. Words repeat, so most are encoded once for each worker. A
    text with "<|" may hold a special token, whose case counts; such texts are
    not put in lower case beforehand.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.begin = np.zeros(1, dtype=np.int64)
        self.pool = np.zeros(0, dtype=self.type)

    def _ids(self, word: str) -> list[int] | None:
        """Ids of a word of letters only, which the tokenizer neither changes nor
        splits before its merges; None for others."""
        if not word.isalpha() or word != word.lower() or not unicodedata.is_normalized("NFC", word):
            return None
        piece = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_SIGNS)
        return [t.id for t in self.tokenizer.model.tokenize(piece)]

    def learn(self, new: list[str]) -> None:
        """Encode words that are not known yet."""
        found = [self._ids(w) for w in new]
        rest = [i for i, ids in enumerate(found) if ids is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([new[i] for i in rest], add_special_tokens=False)):
            found[i] = e.ids
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        at = len(self.known)
        self.known.update(zip(new, range(at, at + len(new))))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(size)])
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(found), dtype=self.type, count=int(size.sum()))])

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): ids of text i are ids[offsets[i] : offsets[i + 1]]."""
        data, off = utf8(text)
        if b"<|" not in data.tobytes():
            data = _LOWER[data]
        text = pa.Array.from_buffers(pa.large_string(), len(text), [None, pa.py_buffer(off), pa.py_buffer(data)])
        text = pa.compute.replace_substring_regex(text, r"([A-Za-z0-9])([.,;:!?#*$%&]+)(\s|$)", r"\1 \2\3")
        parts = pa.compute.ascii_split_whitespace(text)
        count = np.asarray(pa.compute.list_value_length(parts), dtype=np.int64)
        flat = parts.flatten().dictionary_encode()
        vocabulary = flat.dictionary.to_pylist()
        if len(self.known) + len(vocabulary) > CACHE_WORDS:
            self.clear()
        known = self.known
        if new := [w for w in vocabulary if w not in known]:
            self.learn(new)
        word = np.fromiter((known[w] for w in vocabulary), dtype=np.int64, count=len(vocabulary))[np.asarray(flat.indices, dtype=np.int64)]
        begin = self.begin[word]
        length = self.begin[word + 1] - begin
        total = np.append(0, np.cumsum(length))
        take = np.arange(total[-1]) + np.repeat(begin - total[:-1], length)
        return self.pool[take], total[np.append(0, np.cumsum(count))]


class WholeTokenizer:
    """Ids of whole texts by any tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([x or "" for x in text.to_pylist()], add_special_tokens=False)]
        off = np.append(0, np.cumsum([len(x) for x in found], dtype=np.int64))
        return np.fromiter(chain.from_iterable(found), dtype=self.type, count=int(off[-1])), off


_coders: dict[str, WordTokenizer | WholeTokenizer] = {}


def coder(path: str) -> WordTokenizer | WholeTokenizer:
    """The tokenizer of a file: by words if its rules are those of WordTokenizer, or else by whole texts."""
    if path not in _coders:
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        by_words = rules["normalizer"] == WORD_NORMALIZER and rules["pre_tokenizer"] == WORD_PARTS and rules["post_processor"] is None
        by_words = by_words and rules["model"]["type"] == "BPE" and not rules["model"].get("dropout")
        by_words = by_words and all(t["content"].startswith("<|") for t in rules["added_tokens"])
        _coders[path] = WordTokenizer(path) if by_words else WholeTokenizer(path)
    return _coders[path]


def pack(tokens, loss, most_tokens: int, most_segments: int, most_loss: int, cut: bool = True) -> list[tuple[int, int, int, int, int, int]]:
    """(item, start, length, bin, offset, loss) for items of given token and
    loss-bearing token counts; loss-bearing tokens are an item's last ones.

    Items with equal needs are interchangeable, so a placement scores all open
    distinct needs, as arrays, and takes the last item of the best one; of equal
    scores, the need with most tokens, then most loss. Empty items take no part.
    Without cut items stay whole, and one that is above a limit by itself has a
    bin of its own.
    """
    limit = np.array([most_tokens, most_segments, most_loss], dtype=float)
    out: list[tuple[int, int, int, int, int, int]] = []
    bins, demand = 0, np.zeros(3)
    stacks: list[list[tuple[int, int]]] = []
    place: dict[tuple[int, int], int] = {}
    need = np.zeros((2, 64), dtype=np.int64)  # tokens, loss-bearing tokens; 0, 0: none left

    def add(item: int, start: int, t: int, x: int) -> None:
        nonlocal need
        k = place.get((t, x))
        if k is None:
            k = place[t, x] = len(stacks)
            stacks.append([])
            if k == need.shape[1]:
                need = np.concatenate([need, np.zeros_like(need)], axis=1)
        if not stacks[k]:
            need[:, k] = t, x
        stacks[k].append((item, start))
        demand[:] += (t, 1, x)

    for t, x, i in sorted(zip(map(int, tokens), map(int, loss), range(len(tokens)))):
        if not t:
            continue
        if not cut and (t > most_tokens or x > most_loss or most_segments < 1):
            out.append((i, 0, t, bins, 0, x))
            bins += 1
        else:
            add(i, 0, t, x)

    while demand[1] > 0:
        left = np.array([most_tokens, most_segments, most_loss], dtype=np.int64)
        weight = demand / limit
        weight = weight / weight.sum()
        offset = 0
        if 2 * np.count_nonzero(need[0]) < len(stacks) - 64:  # needs that are used up
            keep = [k for k, s in enumerate(stacks) if s]
            stacks, place = [stacks[k] for k in keep], {tuple(need[:, k].tolist()): j for j, k in enumerate(keep)}
            need = np.concatenate([need[:, keep], np.zeros((2, 64), dtype=np.int64)], axis=1)
        while left[0] > 0 and left[1] > 0:
            t, x = need[:, : len(stacks)]
            open_ = t > 0
            take = np.minimum(np.minimum(t, left[0]), t - x + left[2]) if cut else t
            bear = np.maximum(0, take - (t - x))
            good = open_ & (take == t) & (take <= left[0]) & (bear <= left[2])
            if cut:
                good |= open_ & ((t > most_tokens) | (x > most_loss)) & (take > 0)
                if not good.any():
                    good = open_ & (take > 0)
            if not good.any():
                break
            pull = weight * left / limit / limit
            score = np.where(good, take * pull[0] + pull[1] + bear * pull[2], -1.0)
            best = np.flatnonzero(score == score.max())
            k = int(best[np.lexsort((x[best], t[best]))[-1]]) if len(best) > 1 else int(best[0])
            t, x, some, borne = int(t[k]), int(x[k]), int(take[k]), int(bear[k])
            item, start = stacks[k].pop()
            if not stacks[k]:
                need[:, k] = 0
                del place[t, x]
                stacks[k] = []
            out.append((item, start, some, bins, offset, borne))
            left -= (some, 1, borne)
            offset += some
            demand[:] -= (t, 1, x)
            if some < t:
                add(item, start + some, t - some, x - borne)
        bins += 1
    return out


def _sequences(path: str, end_id: int, prompt: int, limits: tuple[int, int, int], run_bytes: int):
    """Pieces of the rows of a task, packed run by run."""

    def packed(open_: list[tuple], bins: int, task: int, last: bool):
        """Rows of the full sequences, what stays open, and the next sequence."""
        tokens = [len(ids) for *_, ids in open_]
        loss = [max(0, n - max(0, prompt - base)) for n, (_, base, _, _) in zip(tokens, open_)]
        plan = pack(tokens, loss, *limits)
        filled = np.zeros(max((p[3] for p in plan), default=-1) + 1, dtype=np.int64)
        for _, _, length, bin_, _, _ in plan:
            filled[bin_] += length
        # the emptiest go on, to the next run or to the second pass
        partly = np.flatnonzero(filled < limits[0])
        back = set() if last else set(partly[np.argsort(filled[partly], kind="stable")][:OPEN_BINS].tolist())
        number = bins + np.cumsum([b not in back for b in range(len(filled))]) - 1
        rows, rest = [], []
        for item, start, length, bin_, offset, borne in plan:
            doc, base, whole, ids = open_[item]
            part = ids[start : start + length]
            if bin_ in back:
                rest.append((doc, base + start, whole, part))
            else:
                crc = zlib.crc32(part.astype("<u4"))
                rows.append((doc, base + start, length, crc, whole, (task << 32) + int(number[bin_]), offset, borne))
        return rows, rest, int(number[-1]) + 1 if len(number) else bins

    def batch_of(rows: list[tuple], open_: list[tuple] = [], task: int = 0) -> pa.RecordBatch:  # noqa: B006
        """Pieces, and open ones with their ids in place of a sequence."""
        rows = [(*r, None) for r in rows] + [(doc, base, len(ids), task, whole, None, None, None, ids.astype("<u4").tobytes()) for doc, base, whole, ids in open_]
        columns = list(zip(*rows)) if rows else [()] * 9
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:8]), pa.array(columns[8], pa.binary())], names=[x.split()[0] for x in OPEN_PIECES.split(", ")])

    def run(it):
        from pyspark import TaskContext

        tokenizer, task = coder(path), TaskContext.get().partitionId()
        open_, size, bins = [], 0, 0
        for batch in it:
            text = batch.column("text")
            for a, b in text_slices(text, 1 << 22, 4096):
                ids, off = tokenizer.encode(text.slice(a, b - a))
                for doc, i, j in zip(batch.column("doc_id").slice(a, b - a).to_pylist(), off[:-1].tolist(), off[1:].tolist()):
                    open_.append((doc, 0, j - i + 1, np.append(ids[i:j], tokenizer.type(end_id))))
                size += text.slice(a, b - a).nbytes
                if size >= run_bytes:
                    rows, open_, bins = packed(open_, bins, task, False)
                    yield batch_of(rows)
                    size = 0
        rows, open_, bins = packed(open_, bins, task, False)
        yield batch_of(rows, open_, task)

    def rest(it):
        """Open pieces of SHARED tasks, packed to the end; a batch is a part of one group's rows."""
        from pyspark import TaskContext

        task = (1 << 29) + TaskContext.get().partitionId()
        open_, bins = [], 0
        for batch in it:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))
            open_ += [(doc, base, whole, np.frombuffer(ids, dtype="<u4")) for doc, base, whole, ids in zip(*columns)]
            if sum(len(x[3]) for x in open_) * 4 >= run_bytes:
                rows, open_, bins = packed(open_, bins, task, False)
                yield batch_of(rows)
        rows, open_, bins = packed(open_, bins, task, True)
        yield batch_of(rows)

    return run, rest


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    most_tokens: int = 4096,
    most_segments: int = 512,
    most_loss: int | None = None,
    prompt_tokens: int = 64,
    run_bytes: int = 16 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all rows, packed in sequences of at most ``most_tokens``.

    A row's ids are those of its text (null: none) and end_id. All but its
    first ``prompt_tokens`` bear loss, of which a sequence takes at most
    most_loss (None: most_tokens less prompt_tokens, as a row that fills a
    sequence has). Rows are cut where the packing needs it; each id is in one
    piece. Returns id_col, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, n_loss.

    Rows that share an id, repeated rows among them, are packed one by one;
    null ids too. No rows give no pieces. A text longer than a run is a run of
    its own. Tasks pack what they read; the sequences that a task leaves part
    full (the emptiest OPEN_BINS) are packed with those of SHARED other tasks in
    a second pass. So which pieces share a sequence follows the partitions of
    docs, the padding hardly does. Other columns are not read.
    """
    limits = (most_tokens, most_segments, most_tokens - prompt_tokens if most_loss is None else most_loss)
    if min(limits) < 1:
        raise ValueError("limits must be at least 1")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    run, rest = _sequences(tokenizer_path, end_id, prompt_tokens, limits, run_bytes)
    first = written(spread(rows).mapInArrow(run, OPEN_PIECES), "pieces")
    done = first.where("ids is null").drop("ids")
    open_ = first.where("ids is not null").withColumn("group", F.floor(F.col("ids_crc32") / SHARED))
    groups = open_.agg(F.max("group")).first()[0]
    if groups is None:
        return done.withColumnRenamed("doc_id", id_col)
    more = open_.repartitionById(groups + 1, F.col("group").cast("int")).drop("group").mapInArrow(rest, OPEN_PIECES).drop("ids")
    return done.unionByName(more).withColumnRenamed("doc_id", id_col)


def pack_examples(
    examples: DataFrame,
    most_tokens: int = 4096,
    most_segments: int = 64,
    most_loss: int = 2048,
    run_rows: int = 20_000,
    id_col: str = "id",
    tokens_col: str = "n_tokens",
    loss_col: str = "n_loss",
) -> DataFrame:
    """Whole examples of instruction data under all three limits: id_col,
    n_tokens, n_loss, sequence_id, offset for each row of examples.

    Null counts are 0; loss-bearing tokens beyond the tokens count as all of
    them. Examples without tokens have sequence_id and offset null. An example
    above a limit by itself has a sequence of its own. A task packs runs of
    run_rows examples apart. Other columns are not read.
    """
    n = F.greatest(F.lit(0).cast("long"), F.coalesce(F.col(tokens_col), F.lit(0)).cast("long"))
    x = F.least(n, F.greatest(F.lit(0).cast("long"), F.coalesce(F.col(loss_col), F.lit(0)).cast("long")))
    rows = examples.select(F.col(id_col).alias("id"), n.alias("n"), x.alias("x"))

    def run(it):
        from pyspark import TaskContext

        task, bins, held = TaskContext.get().partitionId(), 0, []

        def packed(table: pa.Table, bins: int):
            size, loss = (np.asarray(table[c], dtype=np.int64) for c in ("n", "x"))
            bin_, offset = np.full(len(size), -1), np.full(len(size), -1)
            for item, _, _, b, o, _ in pack(size, loss, most_tokens, most_segments, most_loss, cut=False):
                bin_[item], offset[item] = b, o
            gone = bin_ < 0
            out = table.append_column("sequence_id", pa.array((task << 32) + bins + bin_, mask=gone)).append_column("offset", pa.array(offset, mask=gone))
            return out.to_batches(), bins + int(bin_.max(initial=-1)) + 1

        for batch in it:
            for a in range(0, batch.num_rows, run_rows):
                held.append(batch.slice(a, run_rows))
                if sum(h.num_rows for h in held) >= run_rows:
                    out, bins = packed(pa.Table.from_batches(held), bins)
                    held = []
                    yield from out
        if held:
            yield from packed(pa.Table.from_batches(held), bins)[0]

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n long, x long, sequence_id long, offset long")
    return out.withColumnsRenamed({"id": id_col, "n": "n_tokens", "x": "n_loss"})
