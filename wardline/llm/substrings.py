"""Substring deduplication: suffix automata of reference shards, and matching statistics of what streams through.

Every window of ``window`` words is filed under its least k-gram hash, so equal windows meet under one hash.
Neighbouring windows under one hash are a run.  The distinct runs of a hash, with how often each stands in the
corpus, are a reference shard: its suffix automaton, with end counts, is built, and the runs stream through it; a
window is repeated if its state ends in two places or more.  Shards travel to the task that holds the runs of
their hash, since broadcasting each to all documents would grow with the square of the corpus.  Words covered by
repeated windows are removed.

Hot groups: copies of a run are one run of a shard, found by a sort that deals them into portions.  A shard whose
distinct runs are too many for an automaton is dealt out once more, window by window, by a hash of the window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _R, _RINV, Words, _power, bytes_buffer, compressed, expanded, forget, grams, materialize, mix, partitions_for, slices, small_batches, string_buffer

WINDOW, GRAM = 35, 12
#: Runs of one hash that wait for a second one; more go on at once.
WAITING = 20_000
#: Words of the distinct runs of a shard that one automaton takes.
SHARD_WORDS = 30_000
#: Copies of a run, within a task of the sort, that learn in one place what their shard says.
PORTION = 1000


def _slide(of, x: np.ndarray, want: int) -> np.ndarray:
    """``of`` each ``want`` neighbours; shorter by want - 1 than ``x``."""
    have = 1
    while have < want:
        step = min(have, want - have)
        x = of(x[:-step], x[step:])
        have += step
    return x


def runs_of(hashes: np.ndarray, doc: np.ndarray, window: int, gram: int):
    """(start word, windows, least gram hash, content hash, 1 if it may repeat itself) of each run of windows within documents.

    Equal windows of one run hold its least gram twice, at places less than a window apart.
    """
    n, want = len(hashes) - window + 1, window - gram + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),)
    g = grams(hashes, gram)
    low = _slide(np.minimum, g, want)
    # a gram is least in some window if the greatest of the least of its windows is its own
    most = _slide(np.maximum, np.concatenate([np.zeros(want - 1, np.uint64), low, np.zeros(want - 1, np.uint64)]), want)
    place = np.flatnonzero(most == g)
    twice = np.zeros(len(g) + 1, np.int64)
    twice[place[:-1][(g[place[1:]] == g[place[:-1]]) & (np.diff(place) < want)] + 1] = 1
    twice = np.cumsum(twice)
    at = np.flatnonzero(doc[:n] == doc[window - 1 :])
    value = low[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (np.diff(at) != 1)
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(at)]]))
    start = at[first]
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes) * _power(_R, len(hashes), "r"), out=total[1:])
    content = (total[start + count + window - 1] - total[start]) * _power(_RINV, len(hashes) + 1, "i")[start]
    own = (count > want) | (twice[np.minimum(start + count + want - 1, len(g))] > twice[start])
    return start, count, value[first], mix(content + count.astype(np.uint64)), own.astype(np.int64)


def _file(window: int, gram: int):
    def run(batches):
        for batch in batches:
            data, offsets = string_buffer(batch.column(2))
            keys = [batch.column(j).to_numpy() for j in range(2)]
            for x, y in slices(offsets):
                w = Words(data, offsets[x : y + 1], fold=False)
                start, count, low, content, own = runs_of(w.hash, w.doc, window, gram)
                doc = w.doc[start]
                yield pa.RecordBatch.from_arrays([*(pa.array(a.view(np.int64)) for a in (low, content)), *(pa.array(k[x:y][doc]) for k in keys), pa.array((start - w.first[doc]).astype(np.int64)), pa.array(count.astype(np.int64)), pa.array(own)], _RUN)

    return run


_RUN = ["m", "h", "u1", "u2", "start", "n", "own"]
_RUN_DDL = ", ".join(f"{c} long" for c in _RUN)


def _sift(batches):
    """Runs by (m, h, ...): those of a hash with several, each with the number of its portion among its copies in this task; lone ones go.

    A task can't see what its neighbours hold of its first and last hash, so these count as having several; so
    does a lone run that may repeat itself.
    """
    held: list[np.ndarray] | None = None
    several = None  # a hash already known to have several
    last, copies = None, 0

    def out(columns, take):
        nonlocal last, copies
        columns = [c[take] for c in columns]
        m, h = columns[0], columns[1]
        new = np.ones(len(m), bool)
        new[1:] = (m[1:] != m[:-1]) | (h[1:] != h[:-1])
        start = np.flatnonzero(new)
        nth = np.arange(len(m)) - np.repeat(start, np.diff(np.append(start, len(m))))
        if (m[0], h[0]) == last:
            nth[: start[1] if len(start) > 1 else None] += copies
        last, copies = (m[-1], h[-1]), int(nth[-1]) + 1
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(nth // PORTION)], [*_RUN, "portion"])

    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(j).to_numpy() for j in range(7)]
        if held is not None:
            columns = [np.concatenate(c) for c in zip(held, columns)]
        m = columns[0]
        edge = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1], [True]]))
        size = np.diff(edge)
        known = np.zeros(len(size), bool)
        if first:
            known[0] = True
            several, first = int(m[0]), False
        elif several is not None and m[0] == several:
            known[0] = True
        done = np.ones(len(size), bool)
        done[-1] = False
        if size[-1] > WAITING or known[-1]:
            known[-1] = done[-1] = True
            several = int(m[-1])
        take = np.repeat(done & (known | (size > 1) | (columns[6][edge[:-1]] > 0)), size)
        if take.any():
            yield out(columns, take)
        held = None if done[-1] else [c[edge[-2] :] for c in columns]
    if held is not None:
        yield out(held, np.ones(len(held[0]), bool))


class SuffixAutomaton:
    """Of several word sequences, each counted; states have a transition map, a suffix link, a length and an end count."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, transitions: dict[int, int], link: int) -> int:
        self.next.append(transitions)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int], times: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:  # an earlier sequence begins alike
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
            else:
                new, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
                last = new
            self.count[last] += times

    def finish(self) -> None:
        """End counts of every state: its own and those of all that it is the suffix link of."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def matches(self, words: list[int], most: int):
        """(matched length, end count of that match) at each word, the length being ``most`` at most."""
        s = l = 0
        for word in words:
            while s and word not in self.next[s]:
                s = self.link[s]
                l = self.length[s]
            s = self.next[s].get(word, 0)
            l = l + 1 if s else 0
            if l > most:
                l = most
            while s and self.length[self.link[s]] >= l:
                s = self.link[s]
            yield l, self.count[s]


def repeated(contents: list[np.ndarray], times: list[int], window: int) -> list[np.ndarray]:
    """For each run's words, which of its windows occur twice or more among all of them, each counted ``times``."""
    automaton = SuffixAutomaton()
    lists = [c.tolist() for c in contents]
    for c, t in zip(lists, times):
        automaton.add(c, t)
    automaton.finish()
    return [np.array([l == window and n > 1 for l, n in automaton.matches(c, window)][window - 1 :]) for c in lists]


def _single(window: int):
    """Chosen runs of each text, window by window: rows of one window, filed under the hash of it and of its run's hash."""

    def run(batches):
        for batch in batches:
            data, offsets = bytes_buffer(expanded(batch.column(1).to_pylist()))
            chosen, u1, u2 = (batch.column(j).to_pylist() for j in (0, 2, 3))
            for x, y in slices(offsets):
                w = Words(data, offsets[x : y + 1], fold=False)
                for i in range(y - x):
                    words = mix(w.hash[w.first[i] : w.first[i + 1]])
                    total = np.zeros(len(words) + 1, np.uint64)
                    np.cumsum(words * _power(_R, len(words), "r"), out=total[1:])
                    for r in chosen[x + i]:
                        at = np.arange(r["start"], r["start"] + r["n"])
                        h = mix((total[at + window] - total[at]) * _power(_RINV, len(words) + 1, "i")[at] + np.uint64(1))
                        m = mix(h ^ mix(np.array([r["m"]], np.int64).view(np.uint64)))
                        same = [np.full(len(at), v, np.int64) for v in (u1[x + i], u2[x + i])]
                        yield pa.RecordBatch.from_arrays([*(pa.array(a.view(np.int64)) for a in (m, h)), *map(pa.array, same), pa.array(at), pa.array(np.ones(len(at), np.int64)), pa.array(np.zeros(len(at), np.int64))], _RUN)

    return run


def _contents(window: int):
    """The words, as 32-bit hashes, of chosen runs of each text."""

    def run(batches):
        for batch in batches:
            data, offsets = bytes_buffer(expanded(batch.column(1).to_pylist()))
            chosen = batch.column(0).to_pylist()
            for x, y in slices(offsets):
                w = Words(data, offsets[x : y + 1], fold=False)
                word = (w.hash >> np.uint64(32)).astype(np.uint32)
                rows = [(r["m"], r["h"], r["c"], r["last"], word[(a := w.first[i] + r["start"]) : a + r["n"] + window - 1].tobytes()) for i in range(y - x) for r in chosen[x + i]]
                yield pa.RecordBatch.from_arrays([*(pa.array([r[j] for r in rows], pa.int64()) for j in range(4)), pa.array([r[4] for r in rows], pa.binary())], ["m", "h", "c", "last", "words"])

    return run


def _judge(window: int):
    """Runs by m: (m, h, last, at, k), k repeated windows from the run's at-th on."""

    def run(batches):
        key, rows = None, []

        def done():
            found = repeated([np.frombuffer(r[3], np.uint32) for r in rows], [r[1] for r in rows], window)
            out = []
            for (h, _, last, _), yes in zip(rows, found):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], yes.astype(np.int8), [0]])))
                out += [(key, h, last, int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2])]
            return out

        def said(out):
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(5)], ["m", "h", "last", "at", "k"])

        for batch in batches:
            out = []
            for m, *row in zip(*(batch.column(j).to_pylist() for j in range(5))):
                if m != key:
                    if rows:
                        out += done()
                    key, rows = m, []
                rows.append(row)
            yield said(out)
        if rows:
            yield said(done())

    return run


def _sorted(runs: DataFrame, n: int) -> DataFrame:
    return runs.repartitionByRange(n, *_RUN).sortWithinPartitions(*_RUN).mapInArrow(_sift, _RUN_DDL + ", portion long")


def _dealt_again(sifted: DataFrame, texts: DataFrame, window: int, n: int) -> DataFrame:
    """``sifted`` with the runs of shards of more than SHARD_WORDS distinct words window by window."""
    kinds = sifted.groupBy("m", "h").agg(F.max("n").alias("n"))
    large = materialize(kinds.groupBy("m").agg(F.sum(F.col("n") + window - 1).alias("words")).filter(F.col("words") > SHARD_WORDS).select("m"))
    if large.isEmpty():
        return sifted
    # a large shard is known in every one of n places, so that its runs needn't meet in one
    placed = sifted.withColumn("place", F.pmod(F.xxhash64("u1", "u2", "start"), F.lit(n)))
    known = large.select("m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("place"))
    small = placed.join(known, ["m", "place"], "left_anti").select(*_RUN, "portion")
    chosen = placed.join(known, ["m", "place"], "left_semi").groupBy("u1", "u2").agg(F.collect_set(F.struct("m", "start", "n")).alias("runs"))
    single = materialize(chosen.join(texts, ["u1", "u2"]).select("runs", "text", "u1", "u2").mapInArrow(_single(window), _RUN_DDL))
    out = materialize(small.unionByName(_sorted(single, n)))
    forget(sifted, single)
    return out


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(u1, u2, at, k): in the row with that key, the ``k`` windows from word ``at`` on also start elsewhere.  ``docs`` has (u1, u2, text)."""
    n = partitions_for(docs)
    texts = compressed(docs.select("u1", "u2", "text"))
    runs = materialize(docs.select("u1", "u2", "text").mapInArrow(_file(window, gram), _RUN_DDL))
    sifted = materialize(_sorted(runs, n))
    forget(runs)
    sifted = _dealt_again(sifted, texts, window, n)
    kinds = sifted.groupBy("m", "h").agg(F.count("*").alias("c"), F.max("portion").alias("last"), F.min(F.struct("u1", "u2", "start", "n")).alias("one"))
    chosen = kinds.select("one.u1", "one.u2", F.struct("m", "h", "c", "last", "one.start", "one.n").alias("r")).groupBy("u1", "u2").agg(F.collect_list("r").alias("runs"))
    contents = chosen.join(texts, ["u1", "u2"]).select("runs", "text").mapInArrow(_contents(window), "m long, h long, c long, last long, words binary").groupBy("m", "h").agg(F.max("c").alias("c"), F.max("last").alias("last"), F.first("words").alias("words"))
    judged = contents.select("m", "h", "c", "last", "words").repartition(n, "m").sortWithinPartitions("m", "h").mapInArrow(_judge(window), "m long, h long, last long, at long, k long")
    spread = judged.select("m", "h", "at", "k", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("portion"))
    return sifted.join(spread, ["m", "h", "portion"]).select("u1", "u2", (F.col("start") + F.col("at")).alias("at"), "k")


def _remove(window: int, with_text: bool):
    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(expanded(batch.column(1).to_pylist()), batch.column(2).to_pylist()):
                words = text.split()
                n, kept = len(words), words
                if spans:
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, [s["at"] for s in spans], 1)
                    np.add.at(edge, [s["at"] + s["k"] + window - 1 for s in spans], -1)
                    gone = np.cumsum(edge[:n]) > 0
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                joined = b" ".join(kept)
                out.append((n, n - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "surrogatepass") if with_text else None))
            columns = [batch.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array([o[3] for o in out], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) of every row of ``docs`` (doc_id, text).

    Each word covered by a window of ``window`` words that also starts anywhere else, in the same text too, is
    removed; all such windows go, the first ones as well.  A null or shorter text loses nothing; repeated rows
    are repeats of one another.  Windows are equal when the 32- or 64-bit hashes of all their words are.  A long text
    is in memory as a whole, with about 60 bytes a word; other columns are not read.
    """
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", "text").alias("u1"), F.xxhash64("text", F.lit(7), "doc_id").alias("u2"))
    found = repeated_windows(keyed.filter("text is not null"), window, gram)
    spans = found.groupBy("u1", "u2").agg(F.collect_set(F.struct("at", "k")).alias("spans"))
    names = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return compressed(keyed).join(spans, ["u1", "u2"], "left").select("doc_id", "text", "spans").mapInArrow(_remove(window, with_text), names)
