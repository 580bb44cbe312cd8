"""Mixing sources to target weights (operator 5): hash-threshold histograms, all in DataFrame functions.

A source's target is its share by weight of all words, stopped at `most` times its size; what is over is
shared again by weight (water filling, solved in closed form over the sources' table). A source is taken
floor(target / size) times in whole; for the rest, each row has a place in hash space and the rows below a
threshold are taken once more. The threshold is found by nested histograms: words by (source, 12 hash bits),
then the boundary bucket alone by the next 12, then its words by full hash. Rows on the boundary hash itself
are taken in part, so each source's words differ from its target by less than the rows that share one hash.
Nothing is sorted and no source is gathered: every histogram is a map-side combined sum.

Nulls: a null text has size 0, a null source is a source of its own, the last, and a null id is hashed by the text. Rows with
equal id and text (ties, repeated rows) share one hash and are treated alike. Texts of any length are only counted and
hashed. Columns of any other names do no harm. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, cut, small

BITS = 12


def sizes(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Each row's source, size in words and place in hash space (0 to 2^60)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # a hash that SQL engines share, so that the result can be checked in SQL
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)), 1, 15), 16, 10).cast("long")
    return docs.select(
        *(carry or ["doc_id"]),
        F.col("source").alias("src"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.shiftright(h, 48).cast("int").alias("b1"),
        (F.shiftright(h, 36) % (1 << BITS)).cast("int").alias("b2"),
        h.alias("h"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(src, source_size, target): one row for each source; the weights repeat over the sources in code-point order."""
    by = cut(sized.groupBy("src").agg(F.sum("size").alias("source_size")))
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("src").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    t = by.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    t = t.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("reach", F.col("cap") / F.col("w"))
    upto = everything.orderBy("reach", "src").rowsBetween(Window.unboundedPreceding, 0)
    after = everything.orderBy("reach", "src").rowsBetween(1, Window.unboundedFollowing)
    t = t.withColumn("level", (F.col("total") - F.sum("cap").over(upto)) / F.sum("w").over(after))
    # the level at which the sources up to here are stopped; the right one is the first that the next source's reach is above
    t = t.withColumn("next", F.lead("reach").over(everything.orderBy("reach", "src")))
    none = F.col("total") / F.sum("w").over(everything)
    first = F.min("reach").over(everything)
    fits = F.min(F.when((F.col("level") >= F.col("reach")) & (F.col("level") <= F.col("next")), F.col("level"))).over(everything)
    level = F.when(none <= first, none).otherwise(F.coalesce(fits, F.max("reach").over(everything)))
    return t.select("src", "source_size", F.least(F.col("cap"), F.col("w") * level).alias("target"))


def _crossing(hist: DataFrame, keys: list[str], left: str, by: str) -> DataFrame:
    """Of hist (keys, by, words, left): the bucket in which the running sum of words passes left, and what is left there."""
    over = Window.partitionBy(*keys).orderBy(by)
    before = F.sum("words").over(over) - F.col("words")
    return hist.withColumn("before", before).filter((F.col("before") <= F.col(left)) & (F.col("before") + F.col("words") > F.col(left)))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def thresholds(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """One row for each source: of, source_size, target, times (whole takes), at3 (hash of the boundary) and part (words from each row on it)."""
    plan = targets(sized, weights, most)
    plan = cut(
        plan.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.floor(F.col("target")).cast("long") - F.col("times") * F.col("source_size"))
        .withColumnRenamed("src", "of")
    )
    one = cut(
        _crossing(sized.groupBy("src", "b1").agg(F.sum("size").alias("words")).join(small(plan), _same(F.col("src"), F.col("of"))), ["src"], "rest", "b1")
        .select(F.col("of").alias("of1"), F.col("b1").alias("at1"), (F.col("rest") - F.col("before")).alias("rest1"))
    )
    in_one = sized.join(small(one), _same(F.col("src"), F.col("of1")) & (F.col("b1") == F.col("at1")))
    two = cut(
        _crossing(in_one.groupBy("src", "at1", "rest1", "b2").agg(F.sum("size").alias("words")), ["src"], "rest1", "b2")
        .select(F.col("src").alias("of2"), F.col("at1").alias("at1b"), F.col("b2").alias("at2"), (F.col("rest1") - F.col("before")).alias("rest2"))
    )
    in_two = sized.join(small(two), _same(F.col("src"), F.col("of2")) & (F.col("b1") == F.col("at1b")) & (F.col("b2") == F.col("at2")))
    three = cut(
        _crossing(in_two.groupBy("src", "rest2", "h").agg(F.sum("size").alias("words"), F.count("*").alias("sharers")), ["src"], "rest2", "h")
        .select(F.col("src").alias("of3"), F.col("h").alias("at3"), F.floor((F.col("rest2") - F.col("before")) / F.col("sharers")).cast("long").alias("part"))
    )
    return cut(plan.join(three, _same(F.col("of"), F.col("of3")), "left").select("of", "source_size", "target", "times", "at3", "part"))


def take(sized: DataFrame, table: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns of sized with size, source_size, target and taken."""
    more = F.when(F.col("h") < F.col("at3"), F.col("size")).when(F.col("h") == F.col("at3"), F.least("part", "size")).otherwise(0)
    taken = (F.col("times") * F.col("size") + F.coalesce(more, F.lit(0))).cast("long")
    return sized.join(small(table), _same(F.col("src"), F.col("of"))).select(*keep, "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Each row's doc_id, size, source_size, target and taken (words the mix takes, repeats counted)."""
    sized = cut(sizes(docs))
    return take(sized, thresholds(sized, weights, most), ["doc_id"])


def resample(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """docs' rows as often as the mix takes them: taken / size times, rounded half up. Rows without words go."""
    row = docs.select(F.struct("*").alias("_row"), "doc_id", "text", "source")
    table = thresholds(cut(sizes(row)), weights, most)
    found = take(sizes(row, ["_row"]), table, ["_row"])  # texts are read again rather than checkpointed
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    out = found.withColumn("_times", times).filter("_times > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return out.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
