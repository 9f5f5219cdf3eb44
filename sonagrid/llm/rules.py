"""Quality rules: a threshold table compiled into one projection.

Every measure is a native expression of the text; a rule is a row (measure,
least, most) and its check a comparison in the same projection. No measure
leaves the row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and a in that have it is for on with as was at by are this from or an "
    "der die das und ist in den von zu mit sich des auf für im ein eine nicht als dem es "
    "le la les de des et un une est en que qui dans pour pas sur par au avec du il "
    "el los las y del se por con una su para es al lo como más o"
).split()

#: (measure, least, most); None: no limit.
RULES = (
    ("n_words", 50, 100_000),
    ("mean_word_chars", 2.0, 15.0),
    ("symbols_per_word", None, 0.25),
    ("stop_word_ratio", 0.05, None),
    ("dup_line_ratio", None, 0.50),  # a third is one repeat among three lines
    ("ellipsis_line_ratio", None, 0.30),
    ("bullet_line_ratio", None, 0.90),
    ("letter_ratio", 0.60, None),  # characters of words that are no digits or signs of ASCII
)


def _line_share(lines: str, test: str) -> Column:
    return F.expr(f"size(filter({lines}, l -> {test})) / greatest(size({lines}), 1)")


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with columns __words, __lines and one for each measure of RULES and
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.withColumn("__words", F.array_remove(F.split(F.btrim(text, F.lit(_SPACES)), _SPACE), ""))
    split = split.withColumn("__lines", F.expr(f"filter(split(coalesce(`{text_col}`, ''), '\\n'), l -> l rlike '[^ \\\\t-\\\\r]')"))
    # Words of 3-word windows that are found again. Most texts have distinct hashes only and are
    # done. In others a window's hash with its place in the low bits is sorted as a plain long;
    # neighbours with equal high bits are candidates, and only those are compared as words.
    n = "size(__words)"
    low = f"if({n} < 1048576, 20, 31)"
    split = split.withColumn("__hash", F.expr(f"if({n} < 3, array(), transform(slice(__words, 1, greatest({n} - 2, 0)), (w, i) -> xxhash64(w, get(__words, i + 1), get(__words, i + 2))))"))
    split = split.withColumn("__tri", F.expr(f"if(size(array_distinct(__hash)) = size(__hash), array(), sort_array(transform(__hash, (x, i) -> shiftleft(x, {low}) | i)))"))
    split = split.withColumn(
        "__again",
        F.expr(
            f"transform(filter(__tri, (x, j) -> shiftright(x, {low}) <=> shiftright(get(__tri, j - 1), {low}) "
            f"or shiftright(x, {low}) <=> shiftright(get(__tri, j + 1), {low})), x -> cast(x & (shiftleft(1L, {low}) - 1) as int))"
        ),
    )
    split = split.withColumn(
        "__same",
        F.expr("sort_array(transform(__again, i -> named_struct('w', concat_ws(' ', get(__words, i), get(__words, i + 1), get(__words, i + 2)), 'i', i)))"),
    )
    split = split.withColumn("__at", F.expr("sort_array(transform(filter(__same, (x, j) -> x.w <=> get(__same, j - 1).w or x.w <=> get(__same, j + 1).w), x -> x.i))"))
    covered = "if(size(__at) = 0, 0, aggregate(__at, named_struct('n', 0, 'to', 0), (s, i) -> named_struct('n', s.n + i + 3 - greatest(i, s.to), 'to', i + 3), s -> s.n))"
    per_word = lambda c: F.coalesce(c / F.when(F.col("n_words") > 0, F.col("n_words")), F.lit(0.0))
    base = split.select(
        *docs.columns,
        "__lines",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.expr("size(__lines) - size(array_distinct(__lines))").cast("long").alias("n_dup_lines"),
        F.expr(covered).cast("long").alias("n_repeat_words"),
        # signs behind a word are no part of a stop word, and its case does not count
        F.size(F.filter("__words", lambda w: F.lower(F.rtrim(w, F.lit(".,;:"))).isin(*sorted(set(STOP_WORDS))))).alias("__n_stop"),
        (F.length(F.array_join("__words", "")) - F.length(text) + F.length(F.regexp_replace(text, r"[!-@\[-`{-~]+", ""))).alias("__letters"),
    )
    return base.select(
        "*",
        per_word(F.col("word_chars")).alias("mean_word_chars"),
        per_word(F.col("n_symbols")).alias("symbols_per_word"),
        per_word(F.col("__n_stop")).alias("stop_word_ratio"),
        F.expr("n_dup_lines / greatest(size(__lines), 1)").alias("dup_line_ratio"),
        _line_share("__lines", "rtrim(l) like '%...' or rtrim(l) like '%…'").alias("ellipsis_line_ratio"),
        _line_share("__lines", "ltrim(l) rlike '^[-•*·]'").alias("bullet_line_ratio"),
        F.expr("coalesce(__letters / nullif(word_chars, 0), 0.0)").alias("letter_ratio"),
    )


def compiled(rules=RULES) -> Column:
    """True where all rules hold."""
    out = F.lit(True)
    for name, least, most in rules:
        if least is not None:
            out = out & (F.col(name) >= least)
        if most is not None:
            out = out & (F.col(name) <= most)
    return out


def apply_rules(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, the measures, base_failed, kept for each row.

    base_failed: under 50 words, or more than half of the words in 3-word
    windows that the text has twice. kept: not base_failed and all rules hold.
    A null text has no words, lines or symbols and fails. Ids may be null or
    repeated. Other columns are not read.
    """
    found = measures(docs.select(F.col(id_col), F.col(text_col)), text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word_chars", "symbols_per_word", "stop_word_ratio", "dup_line_ratio", "ellipsis_line_ratio", "bullet_line_ratio", "letter_ratio"]
    return found.select(id_col, *names, failed.alias("base_failed"), (~failed & compiled(rules)).alias("kept"))
