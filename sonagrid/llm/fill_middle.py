"""Fill-in-middle transformation.

Each text is decoded to an array of code points. Units are runs of one class of
code points (words and the space between them, lines) or single code points:
neighbouring classes are compared, ``flatnonzero`` of the differences gives the
units' boundaries, and two ranks that only the row's key decides pick the ends of
prefix and middle among them. The three slices are encoded again and put in
one of two orders behind markers, from which restored() finds the text again.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonagrid.llm.common import spread

UNITS = ("char", "word", "line")


@dataclass(frozen=True)
class Form:
    """Markers of prefix, suffix and middle, the share (in 100) of texts that are
    cut at all, and the share of these that begin with the suffix."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    cut_rate: int = 90
    spm_rate: int = 20
    seed: str = "1"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        # no marker may begin inside another one, or one could appear where pieces meet
        if not all(marks) or any(a.endswith(b[:k]) for a in marks for b in marks for k in range(1, len(b) + (a != b))):
            raise ValueError("markers must not be empty or overlap")


def boundaries(points: np.ndarray, unit: str) -> np.ndarray:
    """Where units end, 0 first: unit k spans boundaries k to k + 1."""
    if unit == "char":
        kind = np.arange(len(points))
    elif unit == "word":
        kind = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    elif unit == "line":
        kind = np.cumsum(np.append(0, points[:-1] == 0x0A)) if len(points) else points
    else:
        raise ValueError(f"unit is one of {UNITS}")
    inner = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    return np.concatenate([[0], inner, [len(points)] if len(points) else []]).astype(np.int64)


def draws(key: str) -> list[int]:
    """Four numbers of 32 bits: the first groups of the key's SHA-256."""
    digest = hashlib.sha256(key.encode()).digest()
    return [int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4)]


def transformed(text: str, key: str, form: Form, unit: str) -> tuple[str, int, str, int | None, int | None]:
    """(output, units, form's name, code points of prefix, of middle)."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    ends = boundaries(points, unit)
    n = len(ends) - 1
    h = draws(key)
    if not n or any(m in text for m in (form.prefix, form.suffix, form.middle)) or h[2] % 100 >= form.cut_rate:
        return text, n, "plain", None, None
    a, b = (int(ends[r]) for r in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = (p.tobytes().decode("utf-32-le") for p in (points[:a], points[a:b], points[b:]))
    if h[3] % 100 < form.spm_rate:
        return form.suffix + suffix + form.prefix + prefix + form.middle + middle, n, "spm", a, b - a
    return form.prefix + prefix + form.suffix + suffix + form.middle + middle, n, "psm", a, b - a


def restored(output: str, name: str, form: Form) -> str:
    """The text that transformed() took; the pieces hold no marker, so the first of each is its place."""
    if name == "plain":
        return output
    first, second = (form.prefix, form.suffix) if name == "psm" else (form.suffix, form.prefix)
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(form.middle)
    return one + middle + two if name == "psm" else two + middle + one


def fill_in_middle(docs: DataFrame, form: Form | None = None, unit: str = "char", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256 for each row of docs.

    n is the number of units of the whole text. A null text is empty, and a null
    id is the key "null"; rows with equal ids and texts have equal results. Texts
    without units, with a marker in them, or beyond cut_rate stay plain, where
    prefix_chars and middle_chars are null. Ids may be of any type that has a
    text. restored_sha256 is that of the text rebuilt from output and form alone.
    Other columns are not read; no rows give no rows.
    """
    form = form or Form()
    boundaries(np.zeros(0, "<u4"), unit)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.concat(F.lit(form.seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("key"))

    def run(it):
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in it:
            text, key = batch.column("text"), batch.column("key")
            at = 0
            while at < len(text):
                # outputs of about 8 MB in one batch, whatever the texts' length
                columns, begin, size = [[] for _ in range(7)], at, 0
                while at < len(text) and size < 1 << 23:
                    out, n, name, a, b = transformed(text[at].as_py(), key[at].as_py(), form, unit)
                    for column, value in zip(columns, (n, name, a, b, out, sha(out), sha(restored(out, name, form)))):
                        column.append(value)
                    at, size = at + 1, size + len(out)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(begin, at - begin), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"]
    kind = rows.schema["id"].dataType.simpleString()
    out = spread(rows).mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string")
    return out.withColumnRenamed("id", id_col)
