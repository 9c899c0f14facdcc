"""Python data sources: lines of files in byte ranges, and decisions written once.

``register(spark)``, then ``spark.read.format("wardline_lines").load(folder)`` or ``readStream``, and
``df.write.format("wardline_decisions").mode("append").save(folder)``.  Folders are ones that all machines see as
files; for other file systems use :func:`wardline.sources.lines.read_lines` and Spark's own writers.
"""

from __future__ import annotations

import glob
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

from .lines import scan_lines
from .scratch import work_folder

#: Bytes of a range, and of one read.
RANGE_BYTES, READ_BYTES = 128 << 20, 4 << 20
LINES = "file string, start long, line long, s string"


@dataclass
class Range(InputPartition):
    """Bytes [start, end) of a file; ``whole`` if it can't be split, being compressed."""

    file: str
    start: int
    end: int
    whole: bool


def ranges(path: str, pattern: str, size: int, names: list[str] | None = None) -> list[Range]:
    """Ranges of the files below ``path``, or of ``names``; a folder is listed, no byte is read."""
    files = names if names is not None else listed(path, pattern)
    out = []
    for f in files:
        n = os.path.getsize(f)
        if f.endswith(".gz"):
            out.append(Range(f, 0, n, True))
        else:
            out += [Range(f, x, min(x + size, n), False) for x in range(0, n, size)]
    return out


def listed(path: str, pattern: str) -> list[str]:
    path = path.removeprefix("file://")
    found = [path] if os.path.isfile(path) else glob.glob(os.path.join(glob.escape(path), "**", pattern), recursive=True)
    hidden = lambda f: any(p[0] in "._" for p in os.path.relpath(f, path).split(os.sep) if p not in (".", ""))
    return sorted(f for f in found if os.path.isfile(f) and (f == path or not hidden(f)))


def _batch(file: str, start: int, line: int, data: list[bytes]) -> pa.RecordBatch:
    n = len(data)
    texts = pa.array([None if x is None else x.removesuffix(b"\r").decode("utf-8", "replace") for x in data], pa.string())
    return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array(np.full(n, start), pa.int64()), pa.array(np.arange(line, line + n)), texts], ["file", "start", "line", "s"])


def _opened(r: Range):
    if r.whole:
        import gzip

        return gzip.open(r.file, "rb")
    return open(r.file, "rb")


def lines_of(r: Range, read: int = READ_BYTES) -> Iterator[pa.RecordBatch]:
    """The lines that begin in a range, numbered within it from 1, then a row without text whose line is their number.

    A range begins a line if the byte before it ends one, so it looks at that byte, and every line is in one range,
    which reads its last line on to its end.  What is held is one read and the line it ends in.
    """
    with _opened(r) as f:
        at = r.start
        if at and not r.whole:
            f.seek(at - 1)
            while True:  # skip to the first line that begins here; there may be none
                piece = f.readline(min(read, r.end - f.tell()))
                if not piece or f.tell() >= r.end:
                    return
                if piece.endswith(b"\n"):
                    break
            at = f.tell()
        line, rest = 1, []  # pieces of a line that no read has ended yet
        while r.whole or at < r.end:
            block = f.read(read if r.whole else min(read, r.end - at))
            if not block:
                break
            at += len(block)
            *done, tail = block.split(b"\n")
            if done:
                done[0] = b"".join([*rest, done[0]])
                yield _batch(r.file, r.start, line, done)
                line, rest = line + len(done), []
            if tail:
                rest.append(tail)
        if rest:
            if not r.whole:  # the range ends within a line
                while piece := f.readline(read):
                    rest.append(piece)
                    if piece.endswith(b"\n"):
                        break
            yield _batch(r.file, r.start, line, [b"".join(rest).removesuffix(b"\n")])
            line += 1
        yield _batch(r.file, r.start, line - 1, [None])


class LinesReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.glob, self.size = options["path"], options.get("glob", "*"), int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self):
        return ranges(self.path, self.glob, self.size)

    def read(self, partition):
        # an empty folder has no partition, and Spark asks for one with None
        return lines_of(partition) if partition is not None else iter(())


class LinesStreamReader(DataSourceStreamReader):
    """Files that appear, each read once; an offset is the time of the newest file and the files of that time.

    Files are to be moved into the folder when they are whole, as with Spark's own file streams, and in order of time.
    """

    def __init__(self, options):
        self.path, self.glob, self.size = options["path"], options.get("glob", "*"), int(options.get("rangeBytes", RANGE_BYTES))

    def initialOffset(self):
        return {"ns": -1, "names": []}

    def latestOffset(self):
        times = [(os.stat(f).st_mtime_ns, f) for f in listed(self.path, self.glob)]
        if not times:
            return self.initialOffset()
        newest = max(t for t, _ in times)
        return {"ns": newest, "names": sorted(f for t, f in times if t == newest)}

    def partitions(self, start, end):
        known, told = set(start["names"]), set(end["names"])
        new = []
        for f in listed(self.path, self.glob):
            t = os.stat(f).st_mtime_ns
            after = t > start["ns"] or t == start["ns"] and f not in known
            before = t < end["ns"] or t == end["ns"] and f in told
            if after and before:
                new.append(f)
        return ranges(self.path, self.glob, self.size, new)

    def read(self, partition):
        return lines_of(partition)


class Lines(DataSource):
    """(file, start, line, s): lines of text files, ``line`` counted from 1 within the byte range that begins at ``start``.

    Each range ends with a row whose ``s`` is null and whose ``line`` is the number of its lines.  Lines end in \\n or
    \\r\\n; bytes that aren't UTF-8 are replaced.  Options: path, glob, rangeBytes.  A compressed file is one range.
    """

    @classmethod
    def name(cls):
        return "wardline_lines"

    def schema(self):
        return LINES

    def reader(self, schema):
        return LinesReader(self.options)

    def streamReader(self, schema):
        return LinesStreamReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


def _named(name: str) -> str:
    if not name or not all(c.isalnum() or c in "-_" for c in name):
        raise ValueError("a batch is named by letters, digits, - and _")
    return name


def write_file(path: str, batches: Iterator[pa.RecordBatch]) -> Written:
    """A task's rows in a file under a new name; none if there are no rows or the task fails."""
    folder = os.path.join(path, "data")
    os.makedirs(folder, exist_ok=True)
    name, writer, rows = f"{uuid.uuid4().hex}.parquet", None, 0
    file = os.path.join(folder, name)
    try:
        for batch in batches:
            if batch.num_rows:
                writer = writer or pq.ParquetWriter(file, batch.schema, compression="zstd")
                writer.write_batch(batch)
                rows += batch.num_rows
    except BaseException:
        if writer is not None:
            writer.close()
            os.unlink(file)
        raise
    if writer is not None:
        writer.close()
    return Written(name if rows else "", rows)


def drop_files(path: str, messages: list[Written | None]) -> None:
    for m in messages:
        if m is not None and m.file:
            try:
                os.unlink(os.path.join(path, "data", m.file))
            except FileNotFoundError:
                pass


def commit_batch(path: str, batch: str, messages: list[Written | None]) -> bool:
    """Put a batch's files into place by its manifest; false, and the files go, if the batch stands already."""
    folder = os.path.join(path, "committed")
    os.makedirs(folder, exist_ok=True)
    manifest = os.path.join(folder, f"{batch}.json")
    staged = f"{manifest}.{uuid.uuid4().hex}"
    with open(staged, "w") as f:
        json.dump({"files": [m.file for m in messages if m is not None and m.file], "rows": sum(m.rows for m in messages if m is not None)}, f)
        f.flush()
        os.fsync(f.fileno())
    try:
        os.link(staged, manifest)  # fails if the name stands: of two commits one wins
        return True
    except FileExistsError:
        drop_files(path, messages)
        return False
    finally:
        os.unlink(staged)


class DecisionsWriter(DataSourceArrowWriter):
    """Tasks write files that no reader knows; the driver's commit names all of them in one manifest.

    What a failed task or a second run of one leaves behind is named by none.
    """

    def __init__(self, options, overwrite: bool):
        if overwrite:
            raise ValueError("decisions are appended only")
        self.path = options["path"].removeprefix("file://")
        self.batch = _named(options.get("batch") or uuid.uuid4().hex)

    def write(self, iterator):
        return write_file(self.path, iterator)

    def commit(self, messages):
        commit_batch(self.path, self.batch, messages)

    def abort(self, messages):
        drop_files(self.path, messages)


class DecisionsStreamWriter(DataSourceStreamArrowWriter):
    """The same for a stream's batches, which the option ``batch`` and their number name; one that comes again changes nothing."""

    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")
        self.batch = _named(options.get("batch") or "stream")

    def write(self, iterator):
        return write_file(self.path, iterator)

    def commit(self, messages, batchId):
        commit_batch(self.path, f"{self.batch}-{batchId}", messages)

    def abort(self, messages, batchId):
        drop_files(self.path, messages)


class Decisions(DataSource):
    """Append-only sink of decision events.  Options: path, batch (a name that makes a rerun change nothing; on a stream that of its checkpoint)."""

    @classmethod
    def name(cls):
        return "wardline_decisions"

    def writer(self, schema, overwrite):
        return DecisionsWriter(self.options, overwrite)

    def streamWriter(self, schema, overwrite):
        return DecisionsStreamWriter(self.options)


def register(spark: SparkSession) -> None:
    for source in (Lines, Decisions):
        spark.dataSource.register(source)


def scan_files(spark: SparkSession, path: str, glob: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Findings (file, line, column, type, category, severity, preview) of files of any size, each byte read once.

    Findings and the ranges' numbers of lines go to a table in the shared folder; a range's findings are then moved
    by the lines of the ranges before it.
    """
    register(spark)
    lines = spark.read.format("wardline_lines").option("glob", glob).option("rangeBytes", range_bytes).load(path)
    folder = work_folder(spark)
    found = scan_lines(lines, counts=True)
    found.write.parquet(folder)
    table = spark.read.schema(found.schema).parquet(folder)
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    shift = table.filter("type is null").select("file", "start", F.coalesce(F.sum("line").over(before), F.lit(0)).alias("before"))
    rest = [c for c in table.columns if c not in ("file", "start", "line")]
    return table.filter("type is not null").join(shift, ["file", "start"]).select("file", (F.col("before") + F.col("line")).alias("line"), *rest)


def read_decisions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of committed batches; a file that no manifest names is never read."""
    folder = path.removeprefix("file://")
    names = []
    for m in sorted(glob.glob(os.path.join(glob.escape(folder), "committed", "*.json"))):
        with open(m) as f:
            names += json.load(f)["files"]
    reader = spark.read.schema(schema)
    return reader.parquet(*(f"file://{os.path.join(os.path.abspath(folder), 'data', n)}" for n in names)) if names else spark.createDataFrame([], schema)
