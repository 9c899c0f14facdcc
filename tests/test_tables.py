"""Partitioned tables by the files that they read, and constrained labels against all sequences."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import tagging
from wardline.sources import tables

DAY0 = dt.datetime(2024, 5, 1)


@pytest.fixture
def events(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, DAY0 + dt.timedelta(seconds=rng.randrange(10 * 86400)), rng.randrange(50), f"k{i}") for i in range(5000)] + [(9999, None, 1, "none")]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, key string")
    tables.write_partitioned(df, str(tmp_path / "t"), sort=("user_id", "ts"), lookup={"key": 1000})
    return rows, spark.read.parquet(str(tmp_path / "t")), str(tmp_path / "t")


def test_ranges_read_their_partitions_alone(events):
    rows, table, _ = events
    whole = tables.files_read(table)
    some = tables.between(table, F.lit(DAY0 + dt.timedelta(days=2)), F.lit(DAY0 + dt.timedelta(days=4)))
    assert sorted(r.event_id for r in some.collect()) == sorted(r[0] for r in rows if r[1] and DAY0 + dt.timedelta(days=2) <= r[1] < DAY0 + dt.timedelta(days=4))
    assert whole >= 11 and tables.files_read(some) <= 3
    assert table.count() == len(rows) and table.filter("part is null").count() == 1


def test_files_are_sorted_and_have_bloom_filters(spark, events):
    import pyarrow.parquet as pq

    _, table, path = events
    files = [f.removeprefix("file://") for f in table.inputFiles()]
    for f in files:
        users = pq.read_table(f, partitioning=None).column("user_id").to_pylist()
        assert users == sorted(users)
    assert b"key" in open(files[0], "rb").read()
    # the filter stands in the file: without it the column chunk's pages end where the footer begins
    column = pq.ParquetFile(files[0]).metadata.row_group(0)
    last = max(column.column(i).data_page_offset + column.column(i).total_compressed_size for i in range(column.num_columns))
    size = len(open(files[0], "rb").read())
    footer = int.from_bytes(open(files[0], "rb").read()[-8:-4], "little") + 8
    assert size - footer - last > 500
    assert [r.event_id for r in table.filter("key = 'k17'").collect()] == [17]


def test_retention_drops_whole_partitions(spark, events):
    rows, _, path = events
    gone = tables.drop_older(spark, path, "3 days", F.lit(DAY0 + dt.timedelta(days=10)))
    assert gone == [f"2024-05-0{d}" for d in range(1, 8)]
    left = spark.read.parquet(path)
    assert sorted(r.event_id for r in left.collect()) == sorted(r[0] for r in rows if r[1] is None or r[1] >= DAY0 + dt.timedelta(days=7))


def test_overwriting_replaces_the_partitions_given(spark, events):
    rows, _, path = events
    new = spark.createDataFrame([(1, DAY0 + dt.timedelta(days=1), 1, "new")], "event_id long, ts timestamp, user_id long, key string")
    tables.write_partitioned(new, path, mode="overwrite")
    left = spark.read.parquet(path)
    assert [r.key for r in left.filter("part = '2024-05-02'").collect()] == ["new"]
    assert left.count() == 1 + sum(r[1] is None or r[1].day != 2 for r in rows)


LABELS = tagging.bio_labels(("P", "Q"))


def best_sequence(logits):
    """The first of the best among all allowed sequences, compared from their ends."""
    ok = lambda s: all(not LABELS[x].startswith("I-") or k and LABELS[s[k - 1]][2:] == LABELS[x][2:] for k, x in enumerate(s))
    allowed = [s for s in itertools.product(range(len(LABELS)), repeat=len(logits)) if ok(s)]
    return min(allowed, key=lambda s: (-sum(logits[k][x] for k, x in enumerate(s)), s[::-1]))


def test_labels_against_all_sequences(spark):
    rng = random.Random(7)
    docs = {d: [[rng.randrange(8) / 2 for _ in LABELS] for _ in range(rng.randrange(1, 6))] for d in range(40)}
    rows = [(d, k, 10 * k, 10 * k + 5, x) for d, logits in docs.items() for k, x in enumerate(logits)] + [(None, 0, 0, 1, [0.0] * 5), (99, 0, 0, 1, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id int, pos int, start int, end int, logits array<double>").repartition(5)
    got = {}
    for r in tagging.constrained_labels(df, LABELS).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(docs)
    for d, logits in docs.items():
        want = best_sequence(logits)
        assert [r.label for r in got[d]] == [LABELS[x] for x in want]
        for r, x, row in zip(got[d], want, logits):
            assert r.confidence == pytest.approx(np.exp(row[x]) / np.exp(row).sum())


def test_entities_of_logits(spark):
    """A greedy I after O begins an entity; the constrained sequence gives it its B or leaves it out."""
    x = [[0, 0, 9, 0, 0], [0, 0, 9, 0, 0], [9, 0, 0, 0, 0], [0, 0, 0, 8, 8.5]]
    df = spark.createDataFrame([(1, k, 10 * k, 10 * k + 4, [float(v) for v in row]) for k, row in enumerate(x)], "doc_id long, pos int, start int, end int, logits array<double>")
    greedy = sorted(map(tuple, tagging.decode_logits(df, ("P", "Q"), 0.0, constrained=False).select("kind", "start", "end").collect()))
    assert greedy == [("P", 0, 14), ("Q", 30, 34)]
    labels = [r.label for r in tagging.constrained_labels(df, LABELS).orderBy("pos").collect()]
    assert labels == ["B-P", "I-P", "O", "B-Q"] and tagging.decode_logits(df, ("P", "Q"), 0.0).count() == 2
    assert tagging.decode_logits(df.limit(0), ("P",)).count() == 0
