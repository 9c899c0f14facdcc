"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads windows of a text's bytes both ways, gives each byte a distribution over the learned
languages, and a document's distribution is the mean over all its bytes.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, string_buffer

#: Units of each direction; bytes of a training window; bytes of a window that is labelled.
UNITS, TRAIN_BYTES, WINDOW = 8, 64, 128
#: Labelled texts that the network is trained on at most, the first by a hash of their id, with all of their windows.
FIT_ROWS = 4000
#: Steps of training at least, more where all windows take more; windows of a step; learning rate.
ROUNDS, BATCH, RATE = 700, 384, 0.015
#: Windows that go through the network together.
TOGETHER = 2048

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass
class Network:
    """x: 256 by 3 units, u: units by 3 units, v: units by languages, of each direction; b: a bias by language."""

    languages: list[str]
    x: list[np.ndarray]
    u: list[np.ndarray]
    v: list[np.ndarray]
    b: np.ndarray


def _sigmoid(a: np.ndarray) -> np.ndarray:
    np.negative(a, out=a)
    np.exp(a, out=a)
    a += 1
    return np.reciprocal(a, out=a)


def _steps(x: np.ndarray, u: np.ndarray, codes: np.ndarray, h: np.ndarray, keep: list | None = None, inside: np.ndarray | None = None):
    """States after each row of ``codes`` (time by window): h' = z h + (1 - z) tanh(x_n + r (h u_n)).

    Outside, where ``inside`` (time by window) is 0, a state is 0, as if nothing had been read yet.
    """
    k = h.shape[1]
    for t, c in enumerate(codes):
        a = x[c]
        m = h @ u
        g = a[:, : 2 * k] + m[:, : 2 * k]
        np.clip(g, -30, 30, out=g)
        g = _sigmoid(g)
        z, r = g[:, :k], g[:, k:]
        n = r * m[:, 2 * k :]
        n += a[:, 2 * k :]
        n *= 2
        np.clip(n, -30, 30, out=n)
        n = _sigmoid(n)
        n *= 2
        n -= 1
        if keep is not None:
            keep.append((c, h, z, r, n, m[:, 2 * k :]))
        h = n + z * (h - n)
        if inside is not None:
            h *= inside[t][:, None]
        yield h


def _gradient(x_shape, u: np.ndarray, kept: list, into: list[np.ndarray], inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Backpropagation through time: gradients of x and u, from those of each state."""
    dx, du, k = np.zeros(x_shape, np.float32), np.zeros_like(u), u.shape[0]
    carry = np.zeros_like(into[0])
    for t in range(len(kept) - 1, -1, -1):
        c, h, z, r, n, mn = kept[t]
        d = into[t] + carry
        if inside is not None:
            d = d * inside[t][:, None]
        dz, dn = d * (h - n) * z * (1 - z), d * (1 - z) * (1 - n * n)
        dr = dn * mn * r * (1 - r)
        gates = np.concatenate([dz, dr, dn * r], 1)
        du += h.T @ gates
        carry = d * z + gates @ u.T
        np.add.at(dx, c, np.concatenate([dz, dr, dn], 1))
    return dx, du


def train(windows: np.ndarray, length: np.ndarray, label: np.ndarray, languages: list[str], seed: int = 5, rounds: int = ROUNDS) -> Network:
    """Adam on the mean cross entropy of every byte's label; ``windows`` are padded with 0 after ``length``.

    A step takes as many windows of each language, as far as they divide; each language's windows pass in an order
    by chance, again and again, and there are steps enough for all windows to pass once.
    """
    rng, k, c = np.random.default_rng(seed), UNITS, len(languages)
    parts = [(rng.normal(size=s) * w).astype(np.float32) for _ in range(2) for s, w in (((256, 3 * k), 0.3), ((k, 3 * k), 0.5 / np.sqrt(k)), ((k, c), 0.3))]
    parts.append(np.zeros(c, np.float32))
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    codes, n = _FOLD[windows], windows.shape[1]
    own = [rng.permutation(np.flatnonzero(label == i)) for i in range(c)]
    each, passed = max(1, BATCH // c), [0] * c
    rounds = max(rounds, -(-max(map(len, own)) // each))
    for step in range(1, rounds + 1):
        picks = []
        for i, w in enumerate(own):
            picks.append(w.take(range(passed[i], passed[i] + min(each, len(w))), mode="wrap"))
            passed[i] += len(picks[-1])
        pick = np.concatenate(picks)
        batch, y = codes[pick].T.astype(np.int64), label[pick]
        inside = (np.arange(n)[:, None] < length[pick][None, :]).astype(np.float32)
        kept: list[list] = [[], []]
        ahead = np.stack(list(_steps(parts[0], parts[1], batch, np.zeros((len(pick), k), np.float32), kept[0])))
        back = np.stack(list(_steps(parts[3], parts[4], batch[::-1], np.zeros((len(pick), k), np.float32), kept[1], inside[::-1])))[::-1]
        logit = ahead @ parts[2] + back @ parts[5] + parts[6]
        p = np.exp(logit - logit.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        p[:, np.arange(len(pick)), y] -= 1
        p *= (inside / inside.sum())[:, :, None]
        flat = p.reshape(-1, c)
        gx, gu = _gradient(parts[0].shape, parts[1], kept[0], list(p @ parts[2].T))
        hx, hu = _gradient(parts[3].shape, parts[4], kept[1], list((p @ parts[5].T)[::-1]), inside[::-1])
        grads = [gx, gu, ahead.reshape(-1, k).T @ flat, hx, hu, back.reshape(-1, k).T @ flat, flat.sum(0)]
        rate = RATE * (1 - step / (rounds + 1)) ** 0.5
        for j, g in enumerate(grads):
            np.clip(g, -1, 1, out=g)
            first[j] += 0.1 * (g - first[j])
            second[j] += 0.002 * (g * g - second[j])
            parts[j] -= (rate * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.998**step)) + 1e-8)).astype(np.float32)
    return Network(languages, [parts[0], parts[3]], [parts[1], parts[4]], [parts[2], parts[5]], parts[6])


def label_windows(net: Network, windows: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sums over each window's bytes of their distributions over the languages."""
    codes = np.ascontiguousarray(_FOLD[windows].T)
    n, m = codes.shape
    zero = np.zeros((m, UNITS), np.float32)
    logit = np.empty((n, m, len(net.languages)), np.float32)
    for t, h in enumerate(_steps(net.x[0], net.u[0], codes, zero)):
        np.matmul(h, net.v[0], out=logit[t])
    total = np.zeros((m, len(net.languages)))
    full = bool((length == n).all())
    inside = None if full else (np.arange(n - 1, -1, -1)[:, None] < length[None, :]).astype(np.float32)
    for t, h in zip(range(n - 1, -1, -1), _steps(net.x[1], net.u[1], codes[::-1], zero, inside=inside)):
        p = logit[t]
        p += h @ net.v[1]
        p += net.b
        np.exp(np.clip(p, -40, 40, out=p), out=p)
        p /= p.sum(1, keepdims=True)
        if not full:
            p *= (length > t)[:, None]
        total += p
    return total


def _cut(batches):
    """All windows of each text, from a place by chance on that the text alone sets: (lang, window)."""
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            b = text.encode("utf-8", "surrogatepass")
            count = -(-len(b) // TRAIN_BYTES)
            shift = int(np.random.default_rng(zlib.crc32(b)).integers(TRAIN_BYTES)) if count > 1 else 0
            at = np.minimum(np.arange(count) * TRAIN_BYTES + shift, max(0, len(b) - TRAIN_BYTES))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([b[a : a + TRAIN_BYTES] for a in at.tolist()], pa.binary())], ["lang", "w"])


_trained: dict[bytes, Network] = {}


def _train_once(windows: np.ndarray, length: np.ndarray, label: np.ndarray, languages: list[str]) -> Network:
    """:func:`train`, or the network that this process trained on the very same windows before."""
    key = hashlib.sha256(b"".join([windows.tobytes(), length.tobytes(), label.tobytes(), "\0".join(languages).encode("utf-8", "surrogatepass")])).digest()
    if key not in _trained:
        _trained.clear()
        _trained[key] = train(windows, length, label, languages)
    return _trained[key]


def fit_language(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Network | None:
    """Train on at most ``fit_rows`` rows of ``docs`` (doc_id, text, lang), a documented bound, and on the whole of each.

    Windows of TRAIN_BYTES bytes cover each text from a place by chance on; the driver holds them all, as it
    trains.  Copies teach once.  Rows without text, lang or id teach nothing; where an id
    repeats, any of its rows may be among the first ``fit_rows``.  None without any.
    """
    small_batches(docs.sparkSession)
    told = docs.filter("lang is not null and doc_id is not null and length(text) > 0").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    chosen = told.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = told.join(F.broadcast(chosen), "doc_id").select("text", "lang").distinct()
    keys = rows.select(F.xxhash64("text", "lang").alias("k")).distinct().orderBy("k").limit(fit_rows)
    rows = rows.join(F.broadcast(keys), F.xxhash64("text", "lang") == F.col("k")).select("text", "lang")
    got = rows.mapInArrow(_cut, "lang string, w binary").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by([("lang", "ascending"), ("w", "ascending")])  # the same whatever order the tasks end in
    names, raw = got.column("lang").combine_chunks().dictionary_encode(), got.column("w").combine_chunks()
    languages = sorted(names.dictionary.to_pylist())
    place = np.array([languages.index(x) for x in names.dictionary.to_pylist()])
    length = np.diff(np.frombuffer(raw.buffers()[1], np.int64 if pa.types.is_large_binary(raw.type) else np.int32)[raw.offset : raw.offset + len(raw) + 1]).astype(np.int64)
    windows = np.zeros((len(raw), TRAIN_BYTES), np.uint8)
    windows[np.arange(TRAIN_BYTES)[None, :] < length[:, None]] = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
    return _train_once(windows, length, place[names.indices.to_numpy()], languages)


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter; numerals such as a half or a Roman eight in one character are none."""
    return any(m.group().isalpha() for m in _WORDLIKE.finditer(text)) if text else False


_WORDLIKE = re.compile(r"[^\W\d_]")


def identify_language(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs`` (doc_id, text): the likeliest language and its probability.

    ``und`` with score 0 for a null text, one without a letter, or without a trained network.  Ties go to the
    language that sorts first.  A row's result depends on its text alone, so repeated rows agree; other columns are
    not read.  A long text is labelled whole, TOGETHER windows at a time, with its windows' places in memory.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = sent.value
        for batch in batches:
            data, offsets = string_buffer(batch.column(1))
            some = [has_letter(t) for t in batch.column(1).to_pylist()]
            for x, y in slices(offsets):
                langs, scores = ["und"] * (y - x), [0.0] * (y - x)
                if net is not None and offsets[y] > offsets[x]:
                    part = np.append(data[offsets[x] : offsets[y]], np.zeros(WINDOW, np.uint8))
                    size = np.diff(offsets[x : y + 1])
                    count = -(-size // WINDOW)
                    doc = np.repeat(np.arange(y - x), count)
                    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                    start = (offsets[x:y] - offsets[x])[doc] + nth * WINDOW
                    length = np.minimum(WINDOW, size[doc] - nth * WINDOW)
                    order = np.argsort(length, kind="stable")
                    total = np.zeros((y - x, len(net.languages)))
                    for at in range(0, len(order), TOGETHER):
                        o = order[at : at + TOGETHER]
                        wide = int(length[o].max())
                        windows = part[start[o][:, None] + np.arange(wide)[None, :]]
                        windows[np.arange(wide)[None, :] >= length[o][:, None]] = 0
                        np.add.at(total, doc[o], label_windows(net, windows, length[o]))
                    best = total.argmax(1)
                    for i in range(y - x):
                        if some[x + i]:
                            langs[i], scores[i] = net.languages[best[i]], float(min(1.0, total[i, best[i]] / size[i]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
