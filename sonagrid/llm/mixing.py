"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share of all words by weight, at most ``most`` times
its own size. Whole epochs of the source come first; the rest of the target is
filled in the order of exponential keys -ln(u) / w, where u is a number of the
document's id and w its quality weight, up to the word where the budget ends.

The order within a source needs no task to hold a source: keys are cut in
buckets, buckets are summed before anything is sorted, and only rows of the
same bucket are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonagrid.llm.common import written

#: Weights of sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: Buckets of keys between a number and its double.
BUCKETS = 256
#: Weight of a document whose quality is null, not a number, or below it.
LEAST_QUALITY = 1e-6

_SPACE = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")).cast("long")


def quality_weight(text: Column, words: Column) -> Column:
    """Between 0.25 and 1: nearer to 1 the nearer the bytes for each word are to
    those of running text (4 to 9 with the space)."""
    each = F.octet_length(F.coalesce(text, F.lit(""))) / F.greatest(words, F.lit(1))
    return F.when(each < 4, F.greatest(F.lit(0.25), each / 4)).when(each > 9, F.greatest(F.lit(0.25), F.lit(9.0) / each)).otherwise(F.lit(1.0))


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that only key and seed decide; null counts as a key."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, most: int = 3, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in the order of code points, null last, have the weights in turn.
    All sizes are shared by weight; what a source would get beyond ``most``
    times its size is shared among the others by weight, until none is above.
    With sources sorted by most * size / weight, those at their limit are the
    first ones, and the level of the others follows from prefix sums.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (turn % len(weights)).cast("int")).cast("long")
    s = sizes.select("source", "source_size", turn.alias("turn"), weight.alias("weight"))
    order = Window.orderBy(most * F.col("source_size") / F.col("weight"), "turn")
    earlier, rest, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.select(
        "*",
        (F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(earlier), F.lit(0))).alias("left"),
        F.sum("weight").over(rest).alias("others"),
    )
    level = F.col("left") / F.col("others")
    s = s.withColumn("free", (F.col("left") * F.col("weight") < most * F.col("source_size") * F.col("others")))
    # the first source below its limit fixes the level for all after it
    fixed = F.min(F.when(F.col("free"), F.struct(F.col("order"), level.alias("level"))))
    s = s.withColumn("order", F.row_number().over(order))
    s = s.withColumn("fixed", fixed.over(everything))
    capped = F.col("fixed").isNull() | (F.col("order") < F.col("fixed.order"))
    target = F.when(capped, (most * F.col("source_size")).cast("double")).otherwise(F.col("fixed.level") * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    most: int = 3,
    weights: tuple[int, ...] = WEIGHTS,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
    with_ties: bool = False,
) -> DataFrame:
    """id_col, size, source_size, target, taken for each row of docs (and, on demand,
    tie, a hash of the text, and from, the source).

    taken counts a row's words in the mix: size for each whole epoch of its
    source and once more if the sample has it; the row on the budget's line
    gives its first words only. ``quality`` is a column of docs that weighs
    documents, such as a classifier's score (null, not a number, zero and less
    count as LEAST_QUALITY); by default quality_weight.
    A null text has size 0, and rows without words are never taken. Null is a
    source. Rows that share an id have the same number and are taken in the
    order of their keys, sizes and texts; equal rows in any order. No rows give
    no rows. Other columns are not read.
    """
    text, size = F.col(text_col), n_words(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), text.alias("text"), (F.lit(None).cast("double") if quality is None else quality).alias("quality"))
    given = F.col("quality").cast("double")
    least = F.lit(LEAST_QUALITY)
    weight = quality_weight(F.col("text"), F.col("size")) if quality is None else F.when(given > least, F.least(given, F.lit(1e9))).otherwise(least)
    weight = F.when(F.isnan(weight), least).otherwise(weight)
    rows = rows.select("id", "source", "size", (-F.log(uniform(F.col("id"), seed)) / weight).alias("key"), F.xxhash64("text").alias("tie"))
    # any function that grows with the key will do; this one spreads keys of any size of weight.
    # The table spares a second reading of the texts.
    rows = written(rows.withColumn("bucket", F.floor(BUCKETS * F.log2(F.greatest("key", F.lit(1e-300)))).cast("int")), "sizes")
    parts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    wanted = targets(parts.groupBy("source").agg(F.sum("n").alias("source_size")), most, weights)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    parts = parts.join(wanted, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    full = rows.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    full = full.select("id", "size", "source_size", "target", start.alias("start"), epochs.alias("epochs"), "tie", F.col("s").alias("from"))
    rest = F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least("size", rest - F.col("start")))
    return full.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"), *(["tie", "from"] if with_ties else []))


def mixture(
    docs: DataFrame,
    most: int = 3,
    weights: tuple[int, ...] = WEIGHTS,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, all columns as
    they are; a row taken in part has its first words. Rows that share an id are
    told apart by source and text; those that share these too (null ids are
    equal) are together taken as often as mix() says."""
    found = mix(docs, most, weights, seed, id_col, text_col, source_col, quality, with_ties=True)
    found = found.groupBy(F.col(id_col).alias("id"), F.col("tie"), F.col("from")).agg(F.max("size").alias("size"), F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("n"))
    found = written(found.where("taken > 0"), "taken")
    # the input as one struct, so that no name of it can meet one of these
    rows = docs.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"))
    of = {c: F.col(f"row.c{i}") for i, c in enumerate(docs.columns)}
    on = of[id_col].eqNullSafe(F.col("id")) & (F.xxhash64(of[text_col]) == F.col("tie")) & of[source_col].eqNullSafe(F.col("from"))
    rows = rows.join(found, on)
    lone = rows.where("n = 1").withColumn("own", F.col("taken"))
    # equal rows: the first of them have whole copies more, one may have a part
    place = F.row_number().over(Window.partitionBy("id", "tie", "from").orderBy("taken")) - 1
    least = F.greatest(F.lit(0), F.floor((F.col("taken") - 1) / F.col("n") / F.greatest("size", F.lit(1))) * F.col("size"))
    several = rows.where("n > 1").withColumn("own", least + F.greatest(F.lit(0), F.least("size", F.col("taken") - F.col("n") * least - place * F.col("size"))))
    rows = lone.unionByName(several).where("own > 0")
    rows = rows.withColumn("left", F.explode(F.expr("transform(sequence(0, cast((own - 1) div size as int)), k -> own - k * size)")))
    bare = F.regexp_replace(of[text_col], rf"^{_SPACE}|{_SPACE}$", "")
    cut = F.array_join(F.slice(F.split(bare, _SPACE), F.lit(1), F.col("left").cast("int")), " ")
    text = F.when(F.col("left") < F.col("size"), cut).otherwise(of[text_col])
    return rows.select(*[(text if c == text_col else of[c]).alias(c) for c in docs.columns])
