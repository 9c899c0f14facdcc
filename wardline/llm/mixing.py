"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every row gets an exponential key scaled by its quality weight.  Within a source rows are taken in key order
up to the source's budget of words: whole epochs first, then the rows of lowest key.  Prefix sums run over
key ranges of bounded size, whose totals are summed first, in groups and then over groups, so a source may hold
any share of all rows.

An exponential variable of any scale has a density of 1/e at most over its natural logarithm, and so has every
mixture of them.  Ranges of equal width in the key's logarithm, as many to a unit as RANGE_ROWS asks for, so hold
about that many rows at most, whatever the quality weights are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a source that one key range holds at most, about.
RANGE_ROWS = 1000
#: Ranges whose totals are summed together, before the sums of such groups.
GROUP_RANGES = 1000
#: A to Z, a to z, and the Latin letters from U+00C0 to U+00FF with the two signs between them.
LETTERS = "".join(chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)])
#: Weight of a text without letters, and in general the least.
LEAST_QUALITY = 0.05


def text_quality(text: Column) -> Column:
    """Share of letters among the characters of a text, LEAST_QUALITY at least (null and empty too)."""
    letters = F.length(text) - F.length(F.translate(text, LETTERS, ""))
    return F.greatest(F.lit(LEAST_QUALITY), F.coalesce(F.try_divide(letters.cast("double"), F.length(text).cast("double")), F.lit(0.0)))


def uniform(*columns: Column, seed: int) -> Column:
    """A number within (0, 1) from 52 bits of an MD5, the same in every run and engine."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *columns, F.lit(str(seed)))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], epochs: int) -> DataFrame:
    """``sizes`` (source, source_size, ...) with target: all words shared by weight, at most ``epochs`` times a source's size.

    Weights repeat over the sources by code point, null last.  A source whose share exceeds its limit gets the
    limit, and the rest is shared anew: sources go in order of limit / weight, and the first that stays below
    its share of what is left sets the level of all after it.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    n = len(weights)
    s = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(by_name) - 1) % n + 1))
    s = s.withColumn("limit", (F.col("source_size") * epochs).cast("double"))
    order = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), "source")
    before, after, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(1))
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(after))
    s = s.withColumn("at", F.row_number().over(order))
    s = s.withColumn("level", F.coalesce(F.min_by("level", F.when(F.col("level") * F.col("w") <= F.col("limit"), F.col("at"))).over(every), F.lit(0.0)))
    return s.withColumn("target", F.least("limit", F.col("level") * F.col("w"))).drop("w", "limit", "level", "at")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), epochs: int = 3, quality: Column | None = None, seed: int = 1, keep_hash: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies) of every row of ``docs`` (doc_id, source, text).

    size counts words, a null text's being 0; taken are the words that the mix takes, repeats counted, so each
    source's sum is its target rounded.  copies says how often the whole row goes into a mix of whole rows: a
    row that the budget cuts counts as taken.  Rows that agree in id and size may stand for one another.
    keep_hash adds row_hash, of source and text.  Reruns agree.  Null sources form one source; an empty table gives an empty one.
    A text of any length is one number by the time rows are exchanged.  The list of sources, a row each, is ranked
    by one task; other columns are not read.
    """
    quality = text_quality(F.col("text")) if quality is None else quality
    extra = [F.xxhash64("source", "text").alias("row_hash")] if keep_hash else []
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = -F.ln(uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), seed=seed)) / F.col("q")
    base = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), quality.alias("q"), *extra).withColumn("key", key).drop("q"))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    plan = source_targets(sizes, tuple(weights), epochs)
    words, whole = F.floor(F.col("target") + 0.5).cast("long"), F.coalesce(F.floor(F.try_divide(F.floor(F.col("target") + 0.5).cast("double"), F.col("source_size").cast("double"))), F.lit(0)).cast("long")
    plan = materialize(plan.withColumn("whole", whole).withColumn("rest", words - F.col("whole") * F.col("source_size")).withColumn("none", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit(""))).drop("source"))
    rows = base.withColumn("none", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit("")))
    to_a_unit = F.col("rows") / (math.e * RANGE_ROWS)
    rows = rows.join(F.broadcast(plan) if plan.count() <= 100_000 else plan, ["none", "name"]).withColumn("range", F.floor(F.ln("key") * to_a_unit))
    totals = rows.groupBy("none", "name", "range").agg(F.sum("size").alias("words"))
    # two levels, so that no task sorts all ranges of a source
    totals = totals.withColumn("group", F.floor(F.col("range") / GROUP_RANGES))
    before = lambda level, by: F.coalesce(F.sum("words").over(Window.partitionBy("none", "name", *level).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = totals.groupBy("none", "name", "group").agg(F.sum("words").alias("words")).select("none", "name", "group", before([], "group").alias("groups_before"))
    totals = totals.withColumn("within", before(["group"], "range")).join(groups, ["none", "name", "group"])
    totals = totals.select("none", "name", "range", (F.col("within") + F.col("groups_before")).alias("words_before"))
    here = Window.partitionBy("none", "name", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("prefix", F.coalesce(F.sum("size").over(here), F.lit(0))).join(totals, ["none", "name", "range"])
    left = F.greatest(F.lit(0), F.col("rest") - F.col("prefix") - F.col("words_before"))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.least(left, F.col("size"))).alias("taken"), (F.col("whole") + F.when((left > 0), 1).otherwise(0)).alias("copies"), *(["row_hash"] if keep_hash else []))
