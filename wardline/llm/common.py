"""Shared pieces: vectorised word splitting on Arrow buffers, hashing, shared tables, components.

Words are maximal runs of bytes other than space and 0x09-0x0D.  UTF-8 never uses those bytes inside a
character, so splitting bytes equals splitting code points.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer document is a step of its own.
SLICE_BYTES = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BYTE_FOLDED = _BYTE[_FOLD]
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, key: str) -> np.ndarray:
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if size <= 1 << 22:  # a very long document's table isn't kept
            _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix, on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string array; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, one row at least."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(rows, max(at + 1, end))
        yield at, end
        at = end


class Words:
    """Words of a slice of documents: ``start``/``end`` bytes (within ``data``), ``doc`` (row), ``hash`` (uint64).

    ``first[i]`` is the index of document i's first word; there is a last entry for the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool):
        base = offsets[0]
        self.data = data[base : offsets[-1]]
        self.offsets = offsets - base
        n = len(self.data)
        space = _SPACE[self.data]
        cut = np.ones(n + 1, bool)  # a word can't reach over this place
        cut[1:n] = space[:-1]
        cut[self.offsets] = True
        self.start = np.flatnonzero(~space & cut[:n])
        stop = np.ones(n + 1, bool)
        stop[:n] = space
        stop[self.offsets] = True
        stop[0] = False
        ends = np.flatnonzero(stop)
        ends = ends[~space[ends - 1]] if n else ends[:0]
        self.end = ends
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        total = np.zeros(n + 1, np.uint64)
        if n:
            np.cumsum((_BYTE_FOLDED if fold else _BYTE)[self.data] * _power(_R, n, "r"), out=total[1:])
        h = (total[self.end] - total[self.start]) * (_power(_RINV, n + 1, "i")[self.start] if n else np.zeros(0, np.uint64))
        self.hash = mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k consecutive words from each place on; shorter by k - 1 than ``h``."""
    n = max(0, len(h) - k + 1)
    out = h[:n] + np.uint64(k)
    for j in range(1, k):
        out = mix(out * np.uint64(0xA24BAED4963EE407) + h[j : j + n])
    return out


def to_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def blobs(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts may be long: at most ``rows`` rows to an Arrow batch of this session, unless it has fewer already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that all executors share, ``spark.checkpoint.dir``; it goes when the driver's JVM ends.

    Where that is unset, a temporary folder serves a local master, whose tasks are all on this machine; on a
    cluster it is an error.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        told = "file://" + tempfile.mkdtemp(prefix="wardline-")
        spark.conf.set("spark.checkpoint.dir", told)
    own = f"{told.rstrip('/')}/wardline-{spark.sparkContext.applicationId}"
    if own not in _owned:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _owned.add(own)
    return own


_owned: set[str] = set()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores before them as it takes to clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    mark = "__"
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: a lost executor costs no more than its own tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Remove the files of tables of :func:`materialize` that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
            if "/wardline-" in f:
                path = spark._jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def compressed(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with a text column as compressed bytes, null and empty texts as none: a third less for an exchange to write."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    at = df.columns.index(column)

    def run(batches):
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = [zip_(t.encode("utf-8", "surrogatepass")) if t else b"" for t in batch.column(at).to_pylist()]
            columns = [pa.array(packed, pa.binary()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    fields = [StructField(column, BinaryType()) if f.name == column else f for f in df.schema.fields]
    return df.mapInArrow(run, StructType(fields))


def expanded(packed: list[bytes | None]) -> list[bytes]:
    """UTF-8 of texts that :func:`compressed` packed."""
    import zstandard

    return [zstandard.ZstdDecompressor().decompress(p) if p else b"" for p in packed]


def bytes_buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`string_buffer` gives, of a list of UTF-8 texts."""
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def partitions_for(df: DataFrame) -> int:
    spark = df.sparkSession
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of one key from which a join deals them to several places.
HOT_ROWS = 1000


def join_hot(left: DataFrame, right: DataFrame, key: str, by: str, many: str) -> DataFrame:
    """Inner join on ``key``, one row of ``right`` a key, however many rows of ``left`` share one.

    ``many`` is the column of ``right`` that counts them; it goes.  Rows of a key with more than HOT_ROWS are dealt
    by a hash of their column ``by``, and the key's row goes to every place.
    """
    places = partitions_for(left)
    rest = [c for c in right.columns if c not in (key, many)]
    (place,) = fresh(left, "place")
    hot = right.filter(F.col(many) > HOT_ROWS).select(key, *rest, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(places - 1).cast("long"))).alias(place))
    dealt = left.withColumn(place, F.pmod(F.xxhash64(by, key), F.lit(places))).join(hot, [key, place], "left")
    cold = dealt.filter(F.col(rest[0]).isNull()).select(*left.columns).join(right.filter(F.col(many) <= HOT_ROWS).drop(many), key)
    return dealt.filter(F.col(rest[0]).isNotNull()).select(*left.columns, *rest).unionByName(cold)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a long, b long) -> (id, component): the smallest id reachable, for every id on an edge.

    Large-star and small-star rounds by joins and map-side combined minima; every round is a table in the
    shared folder.  Self loops, repeated edges and nulls are allowed and change nothing.  A hub's edges are dealt
    to several tasks.
    """
    now = materialize(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    mark = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("c"))
        large = join_hot(both.filter("v > u"), low, "u", "v", "c").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        hung = join_hot(large, low, "u", "v", "c")
        small = hung.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        then = materialize(small)
        said = then.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        forget(now, large)
        now = then
        if tuple(said) == mark:
            break
        mark = tuple(said)
    else:
        raise RuntimeError("components have not settled")
    lows = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return lows.union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
