import datetime as dt
import random

from pyspark.sql import functions as F

from wardline.operators import metrics as M


def events(spark, rows):
    base = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    return spark.createDataFrame([(i, base + dt.timedelta(seconds=s), u) for i, (u, s) in enumerate(rows)], "event_id long, ts timestamp, user_id long")


def test_anchored_quota(spark):
    got = {r.event_id: r.allowed for r in M.anchored_quota(events(spark, [(1, 0), (1, 30), (1, 59), (1, 60), (1, 61), (2, 5)]), (2, 100, 100)).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True}


def test_token_bucket(spark):
    got = [r.allowed for r in M.token_bucket(events(spark, [(1, 0), (1, 0), (1, 0), (1, 30), (1, 31)]), 2, 2).orderBy("event_id").collect()]
    assert got == [True, True, False, True, False]


def test_concurrency(spark):
    rows = [(1, dt.datetime(2024, 1, 1, 0, a), dt.datetime(2024, 1, 1, 0, b)) for a, b in [(0, 10), (5, 15), (10, 20), (30, 31)]]
    assert M.concurrency(spark.createDataFrame(rows, "user_id long, begins timestamp, ends timestamp")).first().max_overlap == 2


def test_index_percentiles(spark):
    rng = random.Random(2)
    values = [rng.randrange(50) / 2 for _ in range(137)]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    row = M.index_percentiles(df, "g", "v", {"p50": 0.5, "p99": 0.99}).first()
    values.sort()
    assert row.p50 == values[int(137 * 0.5)] and row.p99 == values[int(137 * 0.99)]


def test_softmax_and_sigmoid(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([-1e9, -1e9],)], "x array<double>").select(M.softmax(F.col("x")).alias("s"), M.sigmoid(F.col("x")).alias("g"))
    rows = df.collect()
    assert abs(sum(rows[0].s) - 1) < 1e-9 and abs(rows[0].g[0] - 0.7310585786) < 1e-9 and rows[1].s == [0.5, 0.5]


def test_accuracy_without_positives(spark):
    row = M.accuracy(spark.createDataFrame([(False, False)], "t boolean, g boolean"), F.col("t"), F.col("g")).first()
    assert (row.tn, row.precision, row.recall, row.f1, row.accuracy) == (1, 0.0, 0.0, 0.0, 1.0)


def test_retention(spark):
    df = events(spark, [(1, 0), (1, 86400 * 3), (1, 86400 * 5)])
    assert M.retained(df, "2 DAYS").count() == 2
