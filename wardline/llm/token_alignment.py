"""Alignment of two tokenizers over the bytes of each text, and how often ids stand together in the corpus.

Each byte has one owner among A's tokens and one among B's: ``np.repeat`` of token numbers over their bytes.  Where
both owners change at once both tokenizations are cut; between such cuts tokens form a group, and every A token of
a group is linked with each of its B tokens.

A text is read as units, each a space and what follows up to the next space after a character that isn't white
space.  A never joins over such a place, its pattern letting a space only begin a token, and B has no piece with a
space mark behind another character, so both cut there and a unit's groups are those of the text.  A worker keeps
what it has learned of a unit; B's vocabulary is asked, and where it holds such a piece a whole text is one unit.

Texts become blocks, one row each, with the block's distinct id pairs and how many of its documents hold each.  Pairs
are summed over blocks, held against the best of their A id, and each block gets the counts of its own pairs back,
so what is shuffled grows with the blocks' distinct pairs and the blocks, not with the tokens.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions_for, slices, small_batches

#: Bytes of text of a block; units that a worker keeps, and bytes of what it keeps of them.
BLOCK_BYTES, KNOWN_UNITS, KNOWN_BYTES = 8_000_000, 600_000, 250_000_000
#: An id pair as one number: A's id, then B's.
SHIFT = 32

_cut = re.compile(r"(?<=\S)(?= )")
_odd = re.compile(r"\s ")


def split_units(text: str) -> list[str]:
    """Units of a space and ``text``, in order."""
    text = " " + text
    if _odd.search(text) or text[-1] == " ":
        return _cut.split(text)
    return [" " + u for u in text[1:].split(" ")]


def byte_level() -> dict[str, int]:
    """The byte of each character of byte-level vocabularies: printable ones stand for themselves, the rest from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        at = byte_level()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(at[c] for c in entry) if all(c in at for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.long_a, self.long_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.mark = self.b.piece_to_id("▁")
        self.by_unit = not any(re.search("[^▁]▁", p) for p in pieces)

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A, of a unit as it stands, and of B, which adds the space that a unit begins with."""
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b = self.b.encode([u[1:] for u in units], num_threads=1)
        return a, [ids if ids or u != " " else [self.mark] for u, ids in zip(units, b)]


def _runs(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... anew for each count."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(n.sum())), n


def _rebuilt(table: list[bytes], long: np.ndarray, ids: list[list[int]], raw: list[bytes]) -> np.ndarray:
    """Whether each unit's tokens have its own bytes; all at once where they do."""
    flat, n = _flat(ids)
    ends = np.concatenate([[0], np.cumsum(long[flat])])[np.cumsum(n)]
    if (ends == np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))).all() and b"".join(map(table.__getitem__, flat.tolist())) == b"".join(raw):
        return np.ones(len(raw), bool)
    return np.array([b"".join(map(table.__getitem__, x)) == r for x, r in zip(ids, raw)], bool)


def align(tok: Tokenizers, units: list[str]) -> dict:
    """Of each unit: ``ok``, n_a, n_b, n_groups, n_links, its groups as text, and its distinct id pairs with their numbers.

    A unit isn't ok if the bytes of its tokens aren't its own.  ``pairs`` and ``times`` are of all units, cut by ``ends``.
    """
    ids_a, ids_b = tok.encode(units)
    raw = [u.encode("utf-8", "surrogatepass") for u in units]
    ok = _rebuilt(tok.bytes_a, tok.long_a, ids_a, raw) & _rebuilt(tok.bytes_b, tok.long_b, ids_b, raw)
    for i in np.flatnonzero(~ok):
        ids_a[i] = ids_b[i] = []
    (a, n_a), (b, n_b) = _flat(ids_a), _flat(ids_b)
    long_a, long_b = tok.long_a[a], tok.long_b[b]
    own_a, own_b = np.repeat(np.arange(len(a)), long_a), np.repeat(np.arange(len(b)), long_b)
    opens = np.ones(len(own_a), bool)  # both owners change here, as they do where a unit begins
    opens[1:] = (own_a[1:] != own_a[:-1]) & (own_b[1:] != own_b[:-1])
    group = np.cumsum(opens) - 1
    first_a, first_b = np.cumsum(long_a) - long_a, np.cumsum(long_b) - long_b
    in_a, in_b = group[first_a], group[first_b]
    groups = int(group[-1]) + 1 if len(group) else 0
    size_a, size_b = np.bincount(in_a, minlength=groups), np.bincount(in_b, minlength=groups)
    unit_of = np.repeat(np.arange(len(units)), n_a)
    group_unit = unit_of[np.cumsum(size_a) - size_a] if groups else np.zeros(0, np.int64)
    n_groups = np.bincount(group_unit, minlength=len(units))
    n_links = np.bincount(group_unit, size_a * size_b, minlength=len(units)).astype(np.int64)

    def distinct(ids, at):
        """Ids of each group with their numbers: (group, id, times)."""
        code, times = np.unique(at << SHIFT | ids, return_counts=True)
        return code >> SHIFT, code & ((1 << SHIFT) - 1), times

    ga, ia, ta = distinct(a, in_a)
    gb, ib, tb = distinct(b, in_b)
    many = np.bincount(gb, minlength=groups)
    each = many[ga]
    left = np.repeat(np.arange(len(ga)), each)
    right = np.repeat((np.cumsum(many) - many)[ga], each) + _runs(each)
    unit, code, times = group_unit[ga[left]], ia[left] << SHIFT | ib[right], ta[left] * tb[right]
    order = np.lexsort((code, unit))
    unit, code, times = unit[order], code[order], times[order]
    new = np.ones(len(unit), bool)
    new[1:] = (unit[1:] != unit[:-1]) | (code[1:] != code[:-1])
    at = np.flatnonzero(new)
    text_a, text_b = (list(map(str, x.tolist())) for x in (a, b))
    ends_a, ends_b = np.cumsum(size_a).tolist(), np.cumsum(size_b).tolist()
    told = [f"{','.join(text_a[p:q])}|{','.join(text_b[x:y])}" for p, q, x, y in zip([0, *ends_a], ends_a, [0, *ends_b], ends_b)]
    last = np.cumsum(n_groups).tolist()
    return {
        "stats": np.stack([ok.astype(np.int64), n_a, n_b, n_groups, n_links], 1),
        "groups": [";".join(told[x:y]) for x, y in zip([0, *last], last)],
        "pairs": code[at],
        "times": np.add.reduceat(times, at) if len(at) else times,
        "ends": np.cumsum(np.bincount(unit[at], minlength=len(units))),
    }


class Known:
    """What a worker has learned of units; it starts anew when it holds too much."""

    def __init__(self, tok: Tokenizers):
        self.tok = tok
        self.clear()

    def clear(self):
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        self.held = 0
        self.stats, self.pairs, self.times, self.first = np.zeros((0, 5), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, units: list[str]) -> None:
        if len(self.place) > KNOWN_UNITS or self.held > KNOWN_BYTES:
            self.clear()
        new = [u for u in dict.fromkeys(units) if u not in self.place]
        if not new:
            return
        got = align(self.tok, new)
        self.place.update(zip(new, range(len(self.groups), len(self.groups) + len(new))))
        self.groups += got["groups"]
        self.stats = np.concatenate([self.stats, got["stats"]])
        self.first = np.concatenate([self.first, self.first[-1] + got["ends"]])
        self.pairs, self.times = np.concatenate([self.pairs, got["pairs"]]), np.concatenate([self.times, got["times"]])
        self.held += sum(map(len, got["groups"])) + 4 * sum(map(len, new)) + 16 * len(got["pairs"]) + 200 * len(new)


#: What this worker knows, by tokenizers.
_kept: dict[tuple[str, str], Known] = {}


def _digest(known: Known, texts: list[str]):
    """(stats, sha256) of each text, and (text, pair, times) of their distinct linked id pairs, in order."""
    units = [(split_units(t) if known.tok.by_unit else [" " + t]) if t else [] for t in texts]
    flat = [u for x in units for u in x]
    known.learn(flat)
    at = np.fromiter(map(known.place.__getitem__, flat), np.int64, len(flat))
    size = np.array([len(x) for x in units], np.int64)
    doc = np.repeat(np.arange(len(texts)), size)
    whole = (size > 0) & (np.bincount(doc, known.stats[at, 0] == 0, minlength=len(texts)) == 0)
    stats = np.stack([np.bincount(doc, known.stats[at, k], minlength=len(texts)) for k in range(1, 5)], 1).astype(np.int64) * whole[:, None]
    shas, x = [], 0
    places = at.tolist()
    for fine, n in zip(whole.tolist(), size.tolist()):
        shas.append(hashlib.sha256(";".join(map(known.groups.__getitem__, places[x : x + n])).encode()).hexdigest() if fine else "")
        x += n
    seen, often = np.unique(doc[whole[doc]] << SHIFT | at[whole[doc]], return_counts=True)
    doc, at = seen >> SHIFT, seen & ((1 << SHIFT) - 1)
    count = known.first[at + 1] - known.first[at]
    some = np.repeat(known.first[at], count) + _runs(count)
    doc, pair, times = np.repeat(doc, count), known.pairs[some], known.times[some] * np.repeat(often, count)
    order = np.lexsort((pair, doc))
    doc, pair, times = doc[order], pair[order], times[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])
    first = np.flatnonzero(new)
    return stats, shas, doc[first], pair[first], np.add.reduceat(times, first) if len(first) else times


_BLOCK = "block long, doc_ids array<long>, stats binary, shas array<string>, sizes binary, places binary, times binary, pairs array<long>, holders array<int>"


def _blocks(path_a: str, path_b: str):
    def run(batches):
        import zstandard

        known = _kept.get((path_a, path_b)) or _kept.setdefault((path_a, path_b), Known(Tokenizers(path_a, path_b)))
        task = TaskContext.get()
        block = (task.partitionId() if task else 0) << 32
        small = lambda x: zstandard.ZstdCompressor(level=3).compress(x.tobytes())

        def done(ids, parts):
            stats, docs = np.concatenate([p[0] for p in parts]), 0
            sizes = np.concatenate([np.bincount(p[2], minlength=len(p[1])) for p in parts])
            pair, times = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
            pairs, place, holders = np.unique(pair, return_inverse=True, return_counts=True)
            shas = [s for p in parts for s in p[1]]
            columns = [pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([stats.tobytes()], pa.binary()), pa.array([shas], pa.list_(pa.string()))]
            columns += [pa.array([small(x)], pa.binary()) for x in (sizes.astype(np.uint32), place.astype(np.uint32), times.astype(np.uint32 if times.max(initial=0) < 1 << 32 else np.uint64))]
            columns += [pa.array([pairs], pa.list_(pa.int64())), pa.array([holders], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "stats", "shas", "sizes", "places", "times", "pairs", "holders"])

        ids, parts, held = [], [], 0
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            for x, y in slices(offsets):
                ids += doc_ids[x:y]
                parts.append(_digest(known, texts[x:y]))
                held += int(offsets[y] - offsets[x])
                if held >= BLOCK_BYTES:
                    yield done(ids, parts)
                    ids, parts, held, block = [], [], 0, block + 1
        if ids:
            yield done(ids, parts)

    return run


_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _score(batches):
    import zstandard

    def wide(x, n):
        raw = zstandard.ZstdDecompressor().decompress(x)
        return np.frombuffer(raw, np.uint32 if len(raw) == 4 * n else np.uint64)

    for batch in batches:
        for i in range(batch.num_rows):
            r = {name: batch.column(name)[i] for name in batch.schema.names}
            stats = np.frombuffer(r["stats"].as_py(), np.int64).reshape(-1, 4)
            sizes = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["sizes"].as_py()), np.uint32).astype(np.int64)
            place = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["places"].as_py()), np.uint32)
            times = wide(r["times"].as_py(), len(place)).astype(np.int64)
            told = r["told"].values if r["told"].is_valid else None
            total = told.field(1).to_numpy(zero_copy_only=False) if told is not None else np.zeros(0, np.int64)
            best = told.field(2).to_numpy(zero_copy_only=False).astype(np.int64) if told is not None else total
            sums = []
            for value in (times * best[place], times * total[place]):
                run = np.concatenate([[0], np.cumsum(value)])
                ends = np.cumsum(sizes)
                sums.append(run[ends] - run[ends - sizes])
            yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"].as_py(), pa.int64()), *(pa.array(stats[:, k]) for k in range(4)), *(pa.array(s.astype(np.int64)) for s in sums), pa.array(r["shas"].as_py(), pa.string())], _NAMES)


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs`` (doc_id, text).

    A is a byte-level BPE of the tokenizers library, read with a space ahead of the text; B is a sentencepiece
    model with byte fallback, which adds that space.  Strings of special tokens are plain text.  A null or empty
    text has no tokens, nor has one whose joined bytes of A or of B aren't a space and the text: its numbers are 0
    and its digest is empty.  An id pair's count is the number of rows that hold it linked; rows of one id and
    repeated rows are rows of their own.  n_best counts a row's links whose pair no other pair of the same A id
    exceeds, count_sum adds the counts over its links.  A long text is a block of its own.  Other columns are
    not read.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = materialize(base.mapInArrow(_blocks(path_a, path_b), _BLOCK))
    held = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "z")).select("block", "place", F.col("z.pairs").alias("pair"), F.col("z.holders").alias("holders"))
    total = held.groupBy("pair").agg(F.sum("holders").alias("total"))
    # an A id has as many rows as B has ids at most
    best = F.col("total") == F.max("total").over(Window.partitionBy(F.shiftright("pair", SHIFT)))
    total = total.select("pair", "total", best.alias("best"))
    told = held.join(total, "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "total", "best"))).alias("told"))
    rows = blocks.drop("pairs", "holders").join(told, "block", "left").repartition(partitions_for(docs), "block")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.mapInArrow(_score, schema)
