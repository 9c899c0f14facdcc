"""Packing token sequences by order-preserving dynamic programming.

Documents keep their order within a partition.  Windows of at most ``limit`` tokens are cut at document or
sentence ends (elsewhere only in long sentences and at the end of a partition), minimising padding, a cost of
each cut within a document, and a small cost of each window.  With f the least cost up to a place x,
f(x) = cut(x) + window + min over the last ``limit`` tokens of f(y) + limit - (x - y): a sliding minimum of
f(y) + y that a monotone queue keeps.  Windows whose length is a power of two need no padding and are tried
besides.  No row is shuffled; a task holds one buffer of tokens.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

LIMIT = 2048
#: Costs in tokens of padding: a window, a cut at a sentence's end, a cut elsewhere in a document.
WINDOW_COST, SENTENCE_COST, TRUNCATION_COST = 8, 4, 64
#: Shorter windows of a power of two are tried at the end of a partition alone.
LEAST_POWER = 64
#: Tokens that are packed at a time; what may still change goes with the next ones.
BUFFER = 1 << 18
#: Pieces of texts whose ids a worker keeps, and characters of the longest that it keeps.
KNOWN_PIECES, KNOWN_LETTERS = 1_200_000, 64


def word_encoder(path: str, end_id: int):
    """text -> ids as little-endian uint32 bytes, ``end_id`` last; and a mask of ids that end a sentence.

    The tokenizer drops white space and never joins tokens over it, nor over the pieces that its own pattern
    cuts a text into, so each piece is encoded once and kept.  Texts of ASCII and Latin letters are cut here;
    others go to it by words.
    """
    import re

    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+").findall
    simple = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*").fullmatch

    merged, letters = tok.model.tokenize, ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    class Known(dict):
        def __init__(self, ids):
            self.ids = ids

        def __missing__(self, piece: str) -> bytes:
            ids = np.array(self.ids(piece), "<u4").tobytes() if piece else b""
            if len(piece) <= KNOWN_LETTERS:
                if len(self) > KNOWN_PIECES:
                    self.clear()
                self[piece] = ids
            return ids

    known = Known(lambda piece: [t.id for t in merged(piece if piece.isascii() else letters(piece)[0][0])])
    words = Known(lambda word: tok.encode(word, add_special_tokens=False).ids)
    last = np.array([end_id], "<u4").tobytes()

    def encode(text: str | None) -> bytes:
        if not text:
            return last
        if simple(text) and "<|" not in text:
            return b"".join(map(known.__getitem__, pieces(text.lower()))) + last
        return b"".join(map(words.__getitem__, text.split(" "))) + last

    vocabulary = tok.get_vocab()
    ends = np.zeros(max(max(vocabulary.values()), end_id) + 1, bool)
    ends[[i for t, i in vocabulary.items() if t.removesuffix("</w>").endswith((".", "!", "?"))]] = True
    return encode, ends


def cuts(places: list[int], costs: list[float], limit: int, total: int, window_cost: float = WINDOW_COST, least: int = 1) -> list[int]:
    """The window ends of least cost among ``places`` (ascending, each at most ``limit`` after another, the last ``total``).

    Windows of a power of two from ``least`` on count as full.
    """
    place, best, back = [0, *places], [0.0], [0]
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    at = [-1] * limit + [0] + [-1] * total  # node at each place, from -limit on
    powers = [limit - (1 << k) for k in range(limit.bit_length()) if least <= 1 << k < limit or 1 << k == limit]
    for i in range(1, len(place)):
        x = place[i]
        while place[queue[0][1]] < x - limit:
            queue.popleft()
        low, j = queue[0]
        low += limit - x
        for p in powers:
            y = at[x + p]
            if y >= 0 and best[y] < low:
                low, j = best[y], y
        f = low + costs[i - 1] + window_cost
        best.append(f)
        back.append(j)
        at[limit + x] = i
        key = f + x
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, i))
    out, i = [], len(place) - 1
    while i:
        out.append(place[i])
        i = back[i]
    return out[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, limit: int, last: bool) -> tuple[list[int], list[float]]:
    """Places where a window may end, and what a cut there costs.  The last place is the end of ``ids``."""
    n = len(ids)
    cost = np.full(n + 1, np.inf)
    cost[1:][ends[ids]] = SENTENCE_COST
    if last:  # any place near the end, so that little is padded there
        tail = cost[max(1, n - 2 * limit) :]
        tail[np.isinf(tail)] = TRUNCATION_COST
    cost[doc_ends] = 0
    cost[n] = 0
    places = np.flatnonzero(np.isfinite(cost[1:])) + 1
    wide = np.flatnonzero(np.diff(np.concatenate([[0], places])) > limit // 8)
    for w in wide:  # a long sentence may be cut anywhere that a few windows ask for
        a = 0 if w == 0 else places[w - 1]
        cost[a + limit // 16 : places[w] : limit // 16] = TRUNCATION_COST
    places = np.flatnonzero(np.isfinite(cost[1:])) + 1
    return places.tolist(), cost[places].tolist()


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, path: str, end_id: int = 1, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of ``docs`` (doc_id, text).

    A document's ids are its text's with ``end_id`` after them, so a null or empty text is ``end_id`` alone;
    each id lies in one piece.  Pieces of a sequence follow one another without gaps.  Rows that share an id,
    or have a null one, are packed as documents of their own, repeated rows too.  An empty table gives no pieces.
    A text of any length is cut wherever windows end; its ids are in memory as a whole.  Other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        encode, ends = word_encoder(path, end_id)
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 40
        names: list = []  # of the documents in the buffer: id, tokens before the buffer, all tokens
        parts: list[bytes] = []
        held = 0

        def flush(last: bool):
            nonlocal sequence, names, parts, held
            ids = np.frombuffer(b"".join(parts), "<u4")
            size = np.array([t - s for _, s, t in names])
            stop = np.cumsum(size)
            windows = cuts(*candidates(ids, stop, ends, limit, last), limit, len(ids), least=1 if last else LEAST_POWER)
            if not last:  # the windows near the end may still change
                windows = [w for w in windows if w <= len(ids) - 4 * limit]
            done = windows[-1] if windows else 0
            edge = np.unique(np.concatenate([[0], windows, stop[stop <= done]])).astype(np.int64)
            begin = edge[:-1]
            doc = np.searchsorted(stop, begin, "right")
            window = np.searchsorted(windows, begin, "right")
            opened = np.concatenate([[0], windows]).astype(np.int64)
            start = begin - (stop - size)[doc] + np.array([s for _, s, _ in names])[doc] if len(begin) else begin
            columns = [
                pa.array([names[d][0] for d in doc], pa.int64()),
                pa.array(start, pa.int64()),
                pa.array(np.diff(edge), pa.int64()),
                pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(edge, edge[1:])], pa.int64()),
                pa.array([names[d][2] for d in doc], pa.int64()),
                pa.array(window + sequence, pa.int64()),
                pa.array(begin - opened[window], pa.int64()),
            ]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids[:done].astype(np.int32))))
            sequence += len(windows)
            first = int(np.searchsorted(stop, done, "right"))
            names = [(i, s + max(0, done - int(e - z)), t) for (i, s, t), e, z in zip(names[first:], stop[first:], size[first:])]
            parts, held = [ids[done:].tobytes()], len(ids) - done
            return pa.RecordBatch.from_arrays(columns, [*_NAMES, *["ids"] * with_ids])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                b = encode(text)
                names.append((i, 0, len(b) // 4))
                parts.append(b)
                held += len(b) // 4
                if held >= BUFFER:
                    yield flush(False)
        if held:
            yield flush(True)

    schema = ", ".join(f"{c} long" for c in _NAMES) + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
