"""Stupid-backoff language model scores, computed relationally.

Texts are dealt to blocks.  Each block explodes into its distinct n-grams, a column of hashes with counts for
each bucket of the hash.  A bucket sums its n-grams over a part's blocks, a finer bucket those sums over all parts,
and the totals go back the same way, aligned with what each sent; a block joined with its totals scores its texts.
A common n-gram is one entry of a block and then one of a part, however often it stands there, so no bucket is hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bytes_buffer, compressed, expanded, grams, mix, partitions_for, slices, small_batches, string_buffer

ORDER, BACKOFF = 3, 0.4
#: Bytes of text of a block, and n-grams of a bucket, about.  Numbers of both follow from the corpus.
BLOCK_BYTES, BUCKET_GRAMS = 6_000_000, 1_500_000
#: Blocks whose n-grams are summed at once.  A larger corpus is so many parts, whose sums are summed by as many finer buckets.
PART_BLOCKS = 8000
#: Tasks of an exchange at most; up to that number each holds a block or a bucket or few.
TASKS = 100_000
#: Bits of a hash that tell n-grams of one bucket apart, after those that name the bucket.
KEY_BITS = 48


def _pack(sorted_values: np.ndarray) -> bytes:
    """Ascending integers below 2^48: differences by byte plane, compressed."""
    import zstandard

    delta = np.diff(sorted_values, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(delta.view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8].T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(KEY_BITS // 8, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, : KEY_BITS // 8] = planes.T
    return np.cumsum(wide.view("<u8").ravel())


def _pack_counts(counts: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack_counts(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


class Block:
    """The n-grams of a block of texts: hash and document of each, by order, and the distinct ones by bucket."""

    def __init__(self, packed: list[bytes], order: int, buckets: int):
        data, offsets = bytes_buffer(expanded(packed))
        parts = [Words(data, offsets[x : y + 1], fold=False) for x, y in slices(offsets)]
        rows = np.cumsum([0, *(len(p.offsets) - 1 for p in parts)])
        self.hash = np.concatenate([p.hash for p in parts]) if parts else np.zeros(0, np.uint64)
        self.doc = np.concatenate([p.doc + r for p, r in zip(parts, rows)]) if parts else np.zeros(0, np.int64)
        self.order, self.buckets = order, buckets

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of the last word) of the n-grams within documents."""
        g = grams(self.hash, n)
        inside = np.flatnonzero(self.doc[: len(g)] == self.doc[n - 1 :]) if len(g) else np.zeros(0, np.int64)
        return mix(g[inside] + np.uint64(n)), inside + n - 1

    def sorted(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, key, place of each of ``g`` among them) of the distinct hashes, by bucket and key.

        With the hash a fraction of 2^64, the bucket is the whole part of fraction times buckets, the key the
        first bits of what remains, so both ascend with the hash.
        """
        n, low = np.uint64(self.buckets), np.uint64(0xFFFFFFFF)
        order = np.argsort(g)
        s = g[order]
        b = ((s >> np.uint64(32)) * n + (((s & low) * n) >> np.uint64(32))) >> np.uint64(32)
        k = (s * n) >> np.uint64(64 - KEY_BITS)
        new = np.ones(len(b), bool)
        new[1:] = (b[1:] != b[:-1]) | (k[1:] != k[:-1])
        place = np.empty(len(g), np.int64)
        place[order] = np.cumsum(new) - 1
        return b[new].astype(np.int64), k[new], place


def _explode(order: int, buckets: int):
    def run(batches):
        key, held = None, []

        def done():
            block = Block(held, order, buckets)
            for n in range(1, order + 1):
                b, k, place = block.sorted(block.ngrams(n)[0])
                count = np.bincount(place, minlength=len(b))
                some, at = np.unique(b, return_index=True)
                cut = [*at, len(b)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), n)), pa.array(some), pa.array(np.full(len(some), key)), pa.array([_pack(k[x:y]) for x, y in zip(cut, cut[1:])], pa.binary()), pa.array([_pack_counts(count[x:y]) for x, y in zip(cut, cut[1:])], pa.binary())],
                    ["n", "bucket", "block", "keys", "counts"],
                )

        for batch in batches:
            blocks, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("block", "text"))
            blocks = blocks.to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1], [True]])) if len(blocks) else [0]
            for x, y in zip(edge, edge[1:]):
                if blocks[x] != key:
                    if held:
                        yield from done()
                    key, held = int(blocks[x]), []
                held += texts.slice(x, y - x).to_pylist()
        if held:
            yield from done()

    return run


def _by_key(batches):
    """(key, rows of the other columns) of rows that are sorted by their first three columns, the key."""
    key, rows = None, []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if r[:3] != key:
                if rows:
                    yield key, rows
                key, rows = r[:3], []
            rows.append(r[3:])
    if rows:
        yield key, rows


def _distinct(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, place of each key among them, where each sender's keys after the first's begin)."""
    lists = [_unpack(k) for k in keys]
    distinct, at = np.unique(np.concatenate(lists), return_inverse=True)
    return distinct, at, np.cumsum([len(x) for x in lists])[:-1]


def _summed(at: np.ndarray, size: int, counts: list[bytes]) -> np.ndarray:
    total = np.zeros(size, np.int64)
    np.add.at(total, at, np.concatenate([_unpack_counts(c) for c in counts]))
    return total


def _total(names: list[str]):
    """Rows (key, sender, keys, counts) by key: the sums over all of a key's senders, to each in the order of its own keys."""

    def run(batches):
        for key, rows in _by_key(batches):
            senders, keys, counts = zip(*rows)
            distinct, at, cuts = _distinct(keys)
            told = np.split(_summed(at, len(distinct), counts)[at], cuts)
            yield pa.RecordBatch.from_arrays([*(pa.array([k] * len(rows), pa.int64()) for k in key), pa.array(senders, pa.int64()), pa.array([_pack_counts(t) for t in told], pa.binary())], [*names, "totals"])

    return run


def _merge(fine: int):
    """Rows (n, bucket, part, block, keys, counts) by part: its distinct keys with their sums, a row for each fine bucket."""

    def run(batches):
        for (n, bucket, part), rows in _by_key(batches):
            _, keys, counts = zip(*rows)
            distinct, at, _ = _distinct(keys)
            total = _summed(at, len(distinct), counts)
            # 16 bits less, so that the product stays within 64
            some, first = np.unique(((distinct >> np.uint64(16)) * np.uint64(fine)) >> np.uint64(KEY_BITS - 16), return_index=True)
            ends = [*first, len(distinct)]
            each = list(zip(ends, ends[1:]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([n] * len(some), pa.int64()),
                    pa.array([bucket] * len(some), pa.int64()),
                    pa.array(some.astype(np.int64)),
                    pa.array([part] * len(some), pa.int64()),
                    pa.array([_pack(distinct[x:y]) for x, y in each], pa.binary()),
                    pa.array([_pack_counts(total[x:y]) for x, y in each], pa.binary()),
                ],
                ["n", "bucket", "fine", "part", "keys", "counts"],
            )

    return run


def _answer(left: pa.Table, right: pa.Table) -> pa.Table:
    """A part's blocks with the corpus counts of its distinct keys, which come by fine bucket: the counts that each block asked for."""
    _, at, cuts = _distinct(left.column("keys").to_pylist())
    total = np.concatenate([_unpack_counts(t) for t in right.sort_by("fine").column("totals").to_pylist()])
    return pa.table({"block": left.column("block"), "n": left.column("n"), "bucket": left.column("bucket"), "totals": pa.array([_pack_counts(t) for t in np.split(total[at], cuts)], pa.binary())})


def _own(g: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often each n-gram stands in its own document."""
    pair = mix(g + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(pair)
    s = pair[order]
    at = np.cumsum(np.concatenate([[False], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    out = np.empty(len(g), np.int64)
    out[order] = np.bincount(at)[at] if len(s) else 0
    return out


def _score(order: int, buckets: int, backoff: float, words: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left.column("text").to_pylist(), order, buckets)
        by = {(r["n"], r["bucket"]): r["totals"] for r in right.to_pylist()}
        m, rows = len(block.hash), left.num_rows
        counts = []  # by order, at each word: the n-gram that ends there, without its own document's
        for n in range(1, order + 1):
            g, end = block.ngrams(n)
            b, _, place = block.sorted(g)
            total = np.concatenate([_unpack_counts(by[n, int(x)]) for x in np.unique(b)]) if len(b) else np.zeros(0, np.int64)
            c = np.zeros(m, np.int64)
            c[end] = total[place] - _own(g, block.doc[end])
            counts.append(c)
        size = np.bincount(block.doc, minlength=rows)
        rest = words - size[block.doc]
        value = backoff ** (order - 1) * (counts[0] + 1.0) / (rest + 1.0)
        seen = np.zeros((order, rows), np.int64)
        level = np.zeros(m, np.int64)
        for n in range(2, order + 1):
            before = np.concatenate([[0], counts[n - 2][:-1]])
            yes = counts[n - 1] > 0
            value = np.where(yes, backoff ** (order - n) * counts[n - 1] / np.maximum(before, 1), value)
            level[yes] = n - 1
        for n in range(order):
            seen[n] = np.bincount(block.doc[level == n], minlength=rows)
        total = np.bincount(block.doc, np.log(value), minlength=rows).astype(np.float64)
        score = np.divide(total, size, out=np.zeros(rows), where=size > 0)
        return pa.table({"doc_id": left.column("doc_id"), "n_words": size.astype(np.int64), "n_top": seen[-1], "log_score": pa.array(total, mask=size == 0), "lm_score": pa.array(score, mask=size == 0)})

    return run


def _sizes(batches):
    nbytes = words = 0
    for batch in batches:
        data, offsets = string_buffer(batch.column(0))
        for x, y in slices(offsets):
            words += len(Words(data, offsets[x : y + 1], False).start)
        nbytes += int(offsets[-1] - offsets[0])
    yield pa.RecordBatch.from_arrays([pa.array([nbytes]), pa.array([words])], ["bytes", "words"])


def _dealt(base: DataFrame, blocks: int) -> DataFrame:
    """(doc_id, block, text) of rows (doc_id, text), rows that agree in all in several blocks.

    Their place counts among a task's rows in order, whatever order they came in, so a task that runs again after a
    shuffle sends each block the same texts.
    """
    place = F.xxhash64("doc_id", "text", F.monotonically_increasing_id())
    return base.sortWithinPartitions("doc_id", "text").select("doc_id", F.pmod(place, F.lit(blocks)).alias("block"), "text")


def score_texts(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """(doc_id, n_words, n_top, log_score, lm_score) of every row of ``docs`` (doc_id, text).

    A word's score is count(n-gram) / count(its history) for the longest n-gram that other rows hold, times
    ``backoff`` for each word of history given up; for a lone word (count + 1) / (words + 1).  Counts are over
    all rows but the scored one.  log_score sums natural logs, lm_score is their mean, n_top counts words with
    the full order.  A null or wordless text has null scores.  Rows with one id are scored on their own, and so is
    each repeated row, which the others' counts hold.  A long text makes a block of its own size; other columns
    are not read.

    A block sends a row for each bucket that it meets, and a part a row for each finer bucket.  Buckets grow in number
    with a part, up to PART_BLOCKS blocks, and finer ones with the parts, so a row holds some dozens of n-grams at
    least up to about a hundred terabytes, and a task the rows of PART_BLOCKS blocks or of all parts.  The finer
    buckets' exchange writes a part's distinct n-grams once more, about as much as its texts.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    said = base.select("text").mapInArrow(_sizes, "bytes long, words long").agg(F.sum("bytes").alias("b"), F.sum("words").alias("w")).first()
    blocks_n, words = max(1, -(-(said["b"] or 0) // BLOCK_BYTES)), said["w"] or 0
    parts = -(-blocks_n // PART_BLOCKS)
    buckets = max(1, -(-words * order // (BUCKET_GRAMS * parts)))
    n, m = (max(partitions_for(docs), min(k, TASKS)) for k in (blocks_n, buckets * parts))
    blocks = compressed(_dealt(base, blocks_n)).repartition(n, "block")
    # all columns, as below: one exchange of the texts serves both
    sent = blocks.sortWithinPartitions("block").mapInArrow(_explode(order, buckets), "n long, bucket long, block long, keys binary, counts binary")
    by = ["n", "bucket", "part"]
    sent = sent.select("n", "bucket", F.pmod("block", F.lit(parts)).alias("part"), "block", "keys", "counts").repartition(m, *by)
    inward = sent.sortWithinPartitions(*by)
    if parts == 1:
        totals = inward.mapInArrow(_total([*by, "block"]), "n long, bucket long, part long, block long, totals binary").drop("part")
    else:
        over = ["n", "bucket", "fine"]
        merged = inward.mapInArrow(_merge(parts), "n long, bucket long, fine long, part long, keys binary, counts binary").repartition(m, *over).sortWithinPartitions(*over)
        sums = merged.mapInArrow(_total([*over, "part"]), "n long, bucket long, fine long, part long, totals binary")
        totals = sent.groupBy(*by).cogroup(sums.groupBy(*by)).applyInArrow(_answer, "block long, n long, bucket long, totals binary")
    return blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(_score(order, buckets, backoff, words), "doc_id long, n_words long, n_top long, log_score double, lm_score double")
