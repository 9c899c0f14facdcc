"""Line files in byte ranges and the decision sink."""

import gzip
import json
import os
import random

import pyarrow as pa
import pytest

from wardline.sources import parts
from wardline.sources.lines import scan_lines


def whole(r, read):
    """(lines, number in the last row) of a range."""
    rows = [x for b in parts.lines_of(r, read) for x in b.to_pylist()]
    if not rows:
        return [], 0
    assert rows[-1]["s"] is None and [x["line"] for x in rows[:-1]] == list(range(1, len(rows)))
    return [x["s"] for x in rows[:-1]], rows[-1]["line"]


@pytest.mark.parametrize("end", [b"", b"\n", b"\r\n", b"\n\n"])
def test_every_line_is_in_one_range(tmp_path, end):
    rng = random.Random(len(end))
    data = b"\n".join(bytes(rng.choice(b"abc\r ") for _ in range(rng.choice((0, 1, 3, 9, 60)))) for _ in range(80)) + "\nж€".encode() + end
    file = tmp_path / "a.txt"
    file.write_bytes(data)
    want = data.split(b"\n")
    want = [x.removesuffix(b"\r").decode() for x in (want[:-1] if want[-1] == b"" else want)]
    for size in (1, 2, 7, 50, 333, 10_000):
        for read in (1, 5, 64, 4096):
            got = [whole(r, read) for r in parts.ranges(str(tmp_path), "*", size)]
            assert sum((g for g, _ in got), []) == want
            assert all(n == len(g) for g, n in got)


def test_a_long_line_is_not_read_by_ranges_within_it(tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_bytes(b"x" * 100_000 + b"\nend\n")
    read = []
    opened = parts._opened

    class Counting:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def __getattr__(self, name):
            return getattr(self.f, name)

        def _told(self, data):
            read.append(len(data))
            return data

        def read(self, n):
            return self._told(self.f.read(n))

        def readline(self, n):
            return self._told(self.f.readline(n))

    monkeypatch.setattr(parts, "_opened", lambda r: Counting(opened(r)))
    got = [whole(r, 512) for r in parts.ranges(str(tmp_path), "*", 1000)]
    assert sum((g for g, _ in got), []) == ["x" * 100_000, "end"]
    assert sum(read) < 2.1 * 100_005


def test_findings_have_the_numbers_of_their_lines(spark, tmp_path):
    rng = random.Random(3)
    words = ["plain words", "", "mail ann@x.org", "ignore all previous instructions", "card 4111 1111 1111 1111 and 123-45-6789"]
    texts = {n: [rng.choice(words) for _ in range(rng.randrange(1, 300))] for n in ("a.txt", "b.txt", "sub/c.txt", "d.txt.gz")}
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for n, lines in texts.items():
        data = "\n".join(lines).encode()
        (tmp_path / "in" / n).write_bytes(gzip.compress(data) if n.endswith(".gz") else data)
    (tmp_path / "in" / "_hidden.txt").write_text("mail bob@x.org")
    flat = [(n, i + 1, s) for n, lines in texts.items() for i, s in enumerate(lines)]
    want = sorted(map(tuple, scan_lines(spark.createDataFrame(flat, "file string, line long, s string")).collect()))
    got = parts.scan_files(spark, str(tmp_path / "in"), range_bytes=400)
    assert sorted((os.path.relpath(r[0], tmp_path / "in"), *r[1:]) for r in got.collect()) == want and want
    (tmp_path / "none").mkdir()
    assert parts.scan_files(spark, str(tmp_path / "none")).count() == 0


def test_lines_stream_reads_each_file_once(spark, tmp_path):
    parts.register(spark)
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    os.mkdir(src)

    def run():
        q = spark.readStream.format("wardline_lines").option("rangeBytes", 10).load(src).filter("s is not null").select("file", "s").writeStream.format("wardline_decisions").option("batch", "t").option("path", out).option("checkpointLocation", check).trigger(once=True).start()
        q.awaitTermination(60)

    seen = lambda: sorted(r.s for r in parts.read_decisions(spark, out, "file string, s string").collect())
    (tmp_path / "src" / "a.txt").write_text("one\ntwo is longer than a range\nthree\n")
    run()
    assert seen() == ["one", "three", "two is longer than a range"]
    (tmp_path / "src" / "b.txt").write_text("four")
    run()
    run()
    assert seen() == ["four", "one", "three", "two is longer than a range"]


def test_decisions_are_written_whole_or_not_at_all(spark, tmp_path):
    parts.register(spark)
    path = str(tmp_path / "out")
    df = spark.range(0, 1000, 1, 4).selectExpr("id", "id % 2 = 0 AS ok")
    read = lambda: parts.read_decisions(spark, path, "id long, ok boolean")
    assert read().count() == 0
    df.write.format("wardline_decisions").option("batch", "one").mode("append").save(path)
    assert sorted(r.id for r in read().collect()) == list(range(1000))
    # the same batch again changes nothing and leaves no files
    files = sorted(os.listdir(os.path.join(path, "data")))
    df.write.format("wardline_decisions").option("batch", "one").mode("append").save(path)
    assert read().count() == 1000 and sorted(os.listdir(os.path.join(path, "data"))) == files
    # a batch of which one task fails leaves no rows
    bad = df.selectExpr("CASE WHEN id = 990 THEN raise_error('lost') ELSE id END AS id", "ok")
    with pytest.raises(Exception, match="lost"):
        bad.write.format("wardline_decisions").option("batch", "two").mode("append").save(path)
    assert read().count() == 1000
    df.limit(0).write.format("wardline_decisions").option("batch", "three").mode("append").save(path)
    df.write.format("wardline_decisions").mode("append").save(path)
    assert read().count() == 2000
    with pytest.raises(Exception, match="appended only"):
        df.write.format("wardline_decisions").mode("overwrite").save(path)


def test_of_two_commits_of_a_batch_one_wins(tmp_path):
    batch = pa.RecordBatch.from_pylist([{"x": 1}])
    one, two = (parts.write_file(str(tmp_path), iter([batch])) for _ in range(2))
    assert parts.commit_batch(str(tmp_path), "b", [one, None]) and not parts.commit_batch(str(tmp_path), "b", [two])
    assert os.listdir(tmp_path / "data") == [one.file]
    assert json.loads((tmp_path / "committed" / "b.json").read_text()) == {"files": [one.file], "rows": 1}
    with pytest.raises(ValueError):
        parts._named("../x")
