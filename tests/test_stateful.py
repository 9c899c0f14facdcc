"""Stored rollups, session vaults and sustained alerts on streams against their batch forms."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from wardline.operators import spans
from wardline.operators.metrics import alert_transitions, rollup
from wardline.streaming.aggregate import RollupTable
from wardline.streaming.stateful import STATE_STORE, alert_stream, vault_stream

DAY0 = dt.datetime(2024, 3, 1)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def events(seed, n=600, days=4):
    rng = random.Random(seed)
    return [(i, DAY0 + dt.timedelta(seconds=rng.randrange(days * 86400)), rng.choice(["view", "error", None]), rng.choice([None, round(rng.random() * 100, 3)])) for i in range(n)]


EVENTS = "event_id long, ts timestamp, event_type string, value double"


def batches(spark, rows, path, files=6):
    """Rows in so many files, in any order, one file a batch."""
    for k in range(files):
        spark.createDataFrame(rows[k::files] or rows[:1], EVENTS).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", "1").parquet(path)


def rounded(df):
    return sorted(((r.bucket, r.event_type, r.n, *(None if x is None else round(x, 6) for x in (r.avg, r.max, r.min))) for r in df.collect()), key=str)


@pytest.mark.parametrize("partition", ["day", "hour"])
def test_stored_rollup_after_late_batches_in_any_order(spark, tmp_path, partition):
    """A stream of late batches, a restart in between, and each batch applied again: the table equals the full rollup."""
    rows = events(1)
    stream = batches(spark, rows, str(tmp_path / "in"))
    table = RollupTable(spark, str(tmp_path / "table"), "10 minutes", partition=partition)
    q = table.follow(stream, str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    want = rounded(rollup(spark.createDataFrame(rows, EVENTS), "10 minutes"))
    assert rounded(table.read()) == want
    # a restarted stream has nothing new; a batch that comes again after a failure changes nothing
    table.follow(stream, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(60)
    assert rounded(table.read()) == want


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    """Applied twice, or broken off after some partitions and then applied whole."""
    rows = events(5)
    df = lambda some: spark.createDataFrame(some, EVENTS)
    table = RollupTable(spark, str(tmp_path / "table"), "10 minutes", partition="hour")
    for k in (0, 1, 1, 2):
        table.apply(df(rows[k::4]), k)
    last = rows[3::4]
    table.apply(df([r for r in last if r[1].hour < 9]), 3)  # what was committed before the failure
    table.apply(df(last), 3)
    assert rounded(table.read()) == rounded(rollup(df(rows), "10 minutes"))


def test_only_touched_partitions_are_written(spark, tmp_path):
    table = RollupTable(spark, str(tmp_path / "table"), "1 hour")
    rows = events(2)
    table.apply(spark.createDataFrame(rows, EVENTS), 0)
    files = lambda: {f"{f.parent.name}/{f.name}" for f in (tmp_path / "table").rglob("*.parquet")}
    before = files()
    late = [(1000, DAY0 + dt.timedelta(days=1, minutes=5), "view", 1.0)]
    table.apply(spark.createDataFrame(late, EVENTS), 1)
    assert {f.split("/")[0] for f in files() - before} == {"part=2024-03-02"} and len(before & files()) >= 3
    assert rounded(table.read()) == rounded(rollup(spark.createDataFrame(rows + late, EVENTS), "1 hour"))
    table.apply(spark.createDataFrame([], EVENTS), 2)
    assert rounded(table.read()) == rounded(rollup(spark.createDataFrame(rows + late, EVENTS), "1 hour"))


def test_reads_prune_and_retention_drops_partitions(spark, tmp_path):
    table = RollupTable(spark, str(tmp_path / "table"), "1 hour")
    table.apply(spark.createDataFrame(events(3, days=6), EVENTS), 0)
    some = table.read(since=F.lit(DAY0 + dt.timedelta(days=2)), until=F.lit(DAY0 + dt.timedelta(days=3)))
    assert {f.split("part=")[1][:10] for f in some.inputFiles()} >= {"2024-03-03"}
    node = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in node and "part#" in node.split("PartitionFilters: [")[1][:40]
    gone = table.retain("2 days", F.lit(DAY0 + dt.timedelta(days=5)))
    assert gone == ["2024-03-01", "2024-03-02", "2024-03-03"]
    assert table.states().agg(F.min("part")).first()[0] == "2024-03-04"


def test_percentiles_from_merged_sketches(spark, tmp_path):
    """Sketches of many buckets, merged over late batches: ranks are within the sketch's error, stored bytes are bounded."""
    rng = random.Random(4)
    rows = [(i, DAY0 + dt.timedelta(seconds=rng.randrange(4 * 86400)), rng.choice(["a", "b"]), rng.gauss(0, 1) ** 3) for i in range(20_000)]
    table = RollupTable(spark, str(tmp_path / "table"), "6 hours", sketch=True)
    for k in range(3):
        table.apply(spark.createDataFrame(rows[k::3], EVENTS), k)
    got = {r.event_type: r for r in table.percentiles({"p50": 0.5, "p95": 0.95, "p99": 0.99}).collect()}
    for kind in "ab":
        own = sorted(r[3] for r in rows if r[2] == kind)
        assert got[kind].n == len(own)
        for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            rank = sum(v <= got[kind][name] for v in own) / len(own)
            assert abs(rank - q) < 0.02
    assert table.states().agg(F.max(F.length("sketch"))).first()[0] < 16_000
    whole = table.percentiles({"p50": 0.5}, by=(), since=F.lit(DAY0 + dt.timedelta(days=1)), until=F.lit(DAY0 + dt.timedelta(days=2))).first()
    day = sorted(r[3] for r in rows if DAY0 + dt.timedelta(days=1) <= r[1] < DAY0 + dt.timedelta(days=2))
    assert whole.n == len(day) and abs(sum(v <= whole.p50 for v in day) / len(day) - 0.5) < 0.02


TEXTS = "session string, row_id string, ts timestamp, text string, back boolean"


def told(rows):
    return [("s1", f"r{i}", DAY0 + dt.timedelta(seconds=i), t, False) for i, t in enumerate(rows)]


def run_stream(df, path, check):
    """Everything that is there, in as many batches as there are files; what all runs have written."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return df.sparkSession.read.schema(df.schema).parquet(path)


def test_vault_stream_equals_batch_and_restores(rocks, tmp_path):
    spark = rocks
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    first = told(["write to ann@x.org or bob@y.org", "see [EMAIL_1] and cy@z.org", "call 555-123-4567", None, "[EMAIL_[EMAIL_2]] then ann@x.org"]) + [("s2", "q0", DAY0, "dee@w.org", False), (None, "n0", DAY0, "eve@v.org", False)]
    second = [("s1", "t0", DAY0 + dt.timedelta(minutes=1), "fay@u.org", False)]
    at = str(tmp_path / "in")
    for rows in (first, second):
        spark.createDataFrame(rows, TEXTS).coalesce(1).write.mode("append").parquet(at)
        time.sleep(1.1)  # batches follow the files' times
    stream = lambda: spark.readStream.schema(TEXTS).option("maxFilesPerTrigger", "1").parquet(at)
    out = vault_stream(stream(), "session", "row_id", restore="back")
    got = {r.row_id: r.told for r in run_stream(out, str(tmp_path / "out"), str(tmp_path / "check")).collect()}
    batch, mapping = spans.anonymise(spark.createDataFrame(first + second, TEXTS), "session", order=("ts",))
    assert got == {r.row_id: r.anonymised for r in batch.collect()}
    assert "[LITERAL_1]" in got["r1"] and got["t0"] == "[EMAIL_5]"
    # a later run of the same stream restores what the vault knows, and only in its session
    again = [("s1", f"back-{r}", DAY0 + dt.timedelta(minutes=2), got[r], True) for r in ("r0", "r1", "r2", "r4", "t0")] + [("s2", "other", DAY0 + dt.timedelta(minutes=2), "[EMAIL_2] [EMAIL_1]", True)]
    spark.createDataFrame(again, TEXTS).coalesce(1).write.mode("append").parquet(at)
    got = {r.row_id: r.told for r in run_stream(vault_stream(stream(), "session", "row_id", restore="back"), str(tmp_path / "out"), str(tmp_path / "check")).collect()}
    assert {k: got[f"back-{k}"] for k in ("r0", "r1", "r2", "r4", "t0")} == {r[1]: r[3] for r in first + second if r[1] in ("r0", "r1", "r2", "r4", "t0")}
    assert got["other"] == "[EMAIL_2] dee@w.org"


def test_expired_placeholders_go(rocks, tmp_path):
    spark = rocks
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    at = str(tmp_path / "in")
    spark.createDataFrame(told(["ann@x.org"]), TEXTS).coalesce(1).write.mode("append").parquet(at)
    stream = lambda: vault_stream(spark.readStream.schema(TEXTS).option("maxFilesPerTrigger", "1").parquet(at), "session", "row_id", restore="back", ttl_seconds=5)
    run_stream(stream(), str(tmp_path / "out"), str(tmp_path / "check"))
    time.sleep(6)
    spark.createDataFrame([("s1", "b", DAY0 + dt.timedelta(minutes=1), "[EMAIL_1]", True)], TEXTS).coalesce(1).write.mode("append").parquet(at)
    got = run_stream(stream(), str(tmp_path / "out"), str(tmp_path / "check"))
    assert [r.told for r in got.filter("row_id = 'b'").collect()] == ["[EMAIL_1]"]


def transitions(values, needed, step, until):
    """One rule that holds above 10, bucket by bucket."""
    out, status, held, at = [], "inactive", 0, min(values)
    while at < until:
        v = values.get(at)
        if v is not None and v > 10:
            held += 1
            if status == "inactive":
                status = "pending"
                out.append((at, "pending", v))
            if status == "pending" and held >= needed:
                status = "firing"
                out.append((at, "firing", v))
        else:
            if status == "firing":
                out.append((at, "resolved", v))
            status, held = "inactive", 0
        at += step
    return out


def test_alert_transitions_of_batch_and_stream(rocks, tmp_path):
    spark = rocks
    rng = random.Random(9)
    series = {m: {DAY0 + dt.timedelta(minutes=i): float(rng.choice([5, 20, 20, 30])) for i in range(60) if rng.random() < 0.9} for m in ("a", "b")}
    rules = [("r1", "a", "gt", 10.0, 1), ("r2", "a", "gt", 10.0, 3), ("r3", "b", "gt", 10.0, 5), ("r4", "b", "gt", 100.0, 1)]
    rows = [(m, t, v) for m, s in series.items() for t, v in s.items()]
    rule_df = spark.createDataFrame(rules, "rule_id string, metric string, operator string, threshold double, for_buckets int")
    until = DAY0 + dt.timedelta(minutes=58)
    want = sorted(((r[0], *x) for r in rules if r[3] < 50 for x in transitions(series[r[1]], r[4], dt.timedelta(minutes=1), until)), key=str)
    schema = "metric string, bucket timestamp, value double"
    batch = alert_transitions(spark.createDataFrame(rows, schema), rule_df, 60, F.lit(until))
    assert sorted((tuple(r) for r in batch.collect()), key=str) == want
    # the stream gets the buckets out of order within its lateness, then a newer one
    rows.sort(key=lambda r: (r[1].minute // 5, rng.random()))
    rows.append(("a", DAY0 + dt.timedelta(minutes=64), 0.0))
    at = str(tmp_path / "in")
    for k in range(0, len(rows), 30):
        spark.createDataFrame(rows[k : k + 30], schema).coalesce(1).write.mode("append").parquet(at)
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(at)
    got = run_stream(alert_stream(stream, rule_df, 60, "6 minutes"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted((tuple(r) for r in got.collect() if r.at < until), key=str) == want
