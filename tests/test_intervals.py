"""Interval joins against all pairs, and the table function against arrays."""

import random

import pytest
from pyspark.sql import functions as F

from wardline.functions.table import register_tables
from wardline.operators import intervals, spans


def some(rng, n, longest, keys=3):
    out = []
    for i in range(n):
        start = rng.randrange(3000)
        out.append((rng.choice([None, *range(keys)]), start, start + rng.choice([0, 1, 5, rng.randrange(1, longest)]), f"t{i % 40}"))
    return out


@pytest.mark.parametrize("longest", [40, 3000])
def test_overlaps_against_all_pairs(spark, monkeypatch, longest):
    """Short and long spans, repeats, touching ends, spans without width, null keys; bins so narrow that several levels are in use."""
    monkeypatch.setattr(intervals, "SPREAD", 4)
    rng = random.Random(longest)
    a, b = some(rng, 200, longest), some(rng, 150, longest)
    a += a[:5]
    da, db = (spark.createDataFrame(x, "doc int, start int, end int, tag string") for x in (a, b))
    meets = lambda x, y: x[0] is not None and x[0] == y[0] and x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2]
    got = intervals.overlapping(da, db, ("doc",), width=4)
    want = [(*x, *y) for x in a for y in b if meets(x, y)]
    assert want and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    left = intervals.beside(da, db, ("doc",), width=4)
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, (x for x in a if not any(meets(x, y) for y in b))))
    within = lambda x, y: meets(x, y) and (y[1] <= x[1] < y[2] or y[1] < x[2] <= y[2])
    left = intervals.beside(da, db, ("doc",), width=4, when=intervals.ends_within())
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, (x for x in a if not any(within(x, y) for y in b))))


@pytest.mark.parametrize("query", ["detect_span_overlaps", "detect_spans_beside"])
def test_found_spans_are_not_broadcast(spark, query):
    """The files seem small enough to broadcast, the spans found in them aren't."""
    from wardline.plans import QUERIES

    plan = QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_a_span_stands_in_few_bins(spark):
    df = spark.createDataFrame([(1, 0, 40_000_000)], "doc int, start int, end int")
    assert intervals._binned(df, intervals.WIDTH, ("start", "end", "l", "b")).groupBy("l").count().agg(F.max("count")).first()[0] <= intervals.SPREAD + 1


def test_table_function_equals_arrays(spark):
    texts = ["mail ann@x.org or 4111 1111 1111 1111", None, "", "call 555-123-4567 by 1999-01-02", "Jane Doe at 12 Oak Street"]
    spark.createDataFrame(list(enumerate(texts)), "id int, text string").createOrReplaceTempView("texts_here")
    own = {"years": (lambda: [spans.Rule("YEAR", r"\b(?:19|20)\d\d\b", 1.0)], spans.leftmost, 0.0)}
    assert register_tables(spark, own) == ["guard_spans"]
    got = spark.sql("SELECT t.id, s.* FROM texts_here t, LATERAL guard_spans(t.text, 'entities') s")
    want = spark.table("texts_here").select("id", F.explode(spans.entities(F.col("text"))).alias("s")).select("id", "s.*")
    assert got.count() > 4 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert [tuple(r) for r in spark.sql("SELECT t.id, s.value FROM texts_here t, LATERAL guard_spans(t.text, 'years') s").collect()] == [(3, "1999")]
    with pytest.raises(Exception, match="knows the detectors"):
        spark.sql("SELECT * FROM texts_here t, LATERAL guard_spans(t.text, 'nothing') s").collect()
