"""Overlaps of spans between tables too large for arrays: an equality join on bins instead of a range join.

Each span stands in the bins that it covers; two that overlap share the bin in which the later one begins, and only
there they are a pair.  Long spans use wider bins, so none stands in more than SPREAD + 1; a pair meets in the
bins of its longer span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of the finest bins; how much wider each next level's are, which bounds a span's bins.
WIDTH, SPREAD, LEVELS = 256, 64, 5


def _binned(df: DataFrame, width: int, names: tuple[str, str, str, str]) -> DataFrame:
    """``df`` once for each level and bin: the level of the bins, the span's own level, the bin."""
    start, end, level, bin_ = names
    own = F.lit(0)
    for k in range(1, LEVELS):
        own = F.when(F.col(end) - F.col(start) > width * SPREAD**k, k).otherwise(own)
    top = LEVELS - 1
    at = lambda x, k: F.floor(x / F.pow(F.lit(float(SPREAD)), k) / width).cast("long")
    out = df.filter(F.col(end) > F.col(start)).withColumn(f"{level}_own", own)
    out = out.withColumn(level, F.explode(F.sequence(F.col(f"{level}_own"), F.lit(top))))
    return out.withColumn(bin_, F.explode(F.sequence(at(F.col(start), F.col(level)), at(F.col(end) - 1, F.col(level)))))


def overlapping(left: DataFrame, right: DataFrame, on: tuple[str, ...], prefix: str = "other_", width: int = WIDTH) -> DataFrame:
    """Pairs of spans [start, end) of ``left`` and ``right`` with equal ``on`` that share a place; columns of ``right`` get the prefix.

    Both have ``on``, start and end.  Spans without width overlap nothing, nor do those of a null key.  Every pair
    comes once, repeated rows as often as they stand there.  Work grows with the spans of a bin, not of a key.
    """
    other = right.select(*(F.col(c).alias(prefix + c) for c in right.columns))
    a = _binned(left, width, ("start", "end", "__la", "__bin"))
    b = _binned(other, width, (f"{prefix}start", f"{prefix}end", "__lb", "__other_bin"))
    same = [F.col(c) == F.col(prefix + c) for c in on]
    # a pair meets at the level of its longer span, and there in the bin where the later one begins
    later = F.greatest(F.col("start"), F.col(f"{prefix}start"))
    here = F.floor(later / F.pow(F.lit(float(SPREAD)), F.col("__la")) / width).cast("long") == F.col("__bin")
    level = F.col("__la") == F.greatest("__la_own", "__lb_own")
    # merged, never broadcast: Spark judges the spans' size by that of the files they were found in
    met = a.join(b.hint("merge"), [*same, F.col("__la") == F.col("__lb"), F.col("__bin") == F.col("__other_bin")])
    kept = met.filter(level & here & (F.col("start") < F.col(f"{prefix}end")) & (F.col(f"{prefix}start") < F.col("end")))
    return kept.select(*left.columns, *(prefix + c for c in right.columns))


def beside(candidates: DataFrame, kept: DataFrame, on: tuple[str, ...], width: int = WIDTH, when: Column | None = None) -> DataFrame:
    """``candidates`` that overlap no span of ``kept``: what a second detector adds to a first one.

    ``when`` narrows what counts as an overlap, over the columns of both, those of ``kept`` with ``other_`` before
    them; :func:`ends_within` is the rule by which findings by entropy give way to those by pattern.
    """
    pairs = overlapping(candidates, kept.select(*on, "start", "end"), on, width=width)
    hit = (pairs if when is None else pairs.filter(when)).select(*candidates.columns).distinct().alias("h")
    c = candidates.alias("c")
    return c.join(hit, [F.col(f"c.{n}").eqNullSafe(F.col(f"h.{n}")) for n in candidates.columns], "left_anti")


def ends_within() -> Column:
    """An overlap in which the candidate begins or ends within the other span; one that holds the whole other span doesn't count."""
    begins = (F.col("start") >= F.col("other_start")) & (F.col("start") < F.col("other_end"))
    return begins | ((F.col("end") > F.col("other_start")) & (F.col("end") <= F.col("other_end")))
