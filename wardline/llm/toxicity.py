"""Toxicity by noisy-channel deobfuscation.

A character trigram model, counted over all texts, is the language model; the channel says how leetspeak,
repetition, separators and spacing disguise letters.  Suspicious tokens become lattices that a Viterbi search
decodes, and the restored words are scored by evidence learned from labelled texts.
"""

from __future__ import annotations

import math
import os.path
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, slices, small_batches, string_buffer

# Symbols that commonly stand for letters.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
#: Classes of the character model: 0 a boundary, 1-26 letters, 27 anything else.
CLASSES = 28
#: Labelled texts that the evidence is learned from, the first by a hash of their id.
FIT_ROWS = 20_000
#: Toxic texts that must hold a feature, and its precision from which it is evidence.
LEAST_TEXTS, LEAST_PRECISION = 3, 0.2
#: Words whose evidence a worker keeps, and letters of the longest that it keeps.
KNOWN_WORDS, KNOWN_LETTERS = 400_000, 64
#: Slots after which a search settles the letters that all its paths share, so that paths stay short.
SETTLE = 64
#: Counts that a feature's precision is shrunk by.
PRIOR = 3.0
THRESHOLD = 0.7

_class = np.full(256, 27, np.int32)
_class[[9, 10, 11, 12, 13, 32]] = 0
_class[97:123] = np.arange(1, 27)
_class[65:91] = np.arange(1, 27)
_joined = re.compile(r"[^\W_](?:[.\-_*~][^\W_]){2,}\Z")
_run = re.compile(r"([^\W\d_])\1{2,}")
_leet = re.compile(r"(?=.*[^\W\d_])(?=.*[0-9@$!|+(<€£¡*])")
_strip_left, _strip_right = "\"'([{«¿.,;:?-_#%&", "\"')]}».,;:!?-_#%&"
_junk_tail = re.compile(r"([^\w\s])\1{2,}\Z")


def _count_trigrams(batches):
    total = np.zeros(CLASSES**3, np.int64)
    for batch in batches:
        data, offsets = string_buffer(batch.column(0))
        for x, y in slices(offsets):
            c = _class[data[offsets[x] : offsets[y]]]
            c = np.concatenate([[0, 0], c, [0]])
            total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "count"])


def character_model(texts: DataFrame) -> np.ndarray:
    """Natural log probabilities [a, b, c] of class c after a, b; counted over every text, at most 28^3 counts reach the driver."""
    rows = texts.select("text").mapInArrow(_count_trigrams, "gram long, count long").groupBy("gram").agg(F.sum("count").alias("count")).collect()
    count = np.zeros(CLASSES**3)
    for r in rows:
        count[r["gram"]] = r["count"]
    tri = count.reshape(CLASSES, CLASSES, CLASSES)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + CLASSES)
    p2 = (bi + 20 * p1) / (bi.sum(1, keepdims=True) + 20)
    return np.log((tri + 5 * p2[None]) / (tri.sum(2, keepdims=True) + 5))


def _letter(ch: str) -> str:
    base = unicodedata.normalize("NFKD", ch)[0]
    return base if "a" <= base <= "z" else ch


class Decoder:
    """Viterbi decoding of disguised words; without a disguise a word stays as it is."""

    def __init__(self, model: np.ndarray):
        self.lm = model.tolist()

    @staticmethod
    def _number(ch: str) -> int:
        return ord(ch) - 96 if "a" <= ch <= "z" else 0 if ch == " " else 27

    def slots(self, chars: str, spaced: bool) -> list[list[tuple[str, float]]]:
        out, i = [], 0
        known: dict[str, list[tuple[str, float]]] = {}
        while i < len(chars):
            ch, j = chars[i], i
            while j < len(chars) and chars[j] == ch:
                j += 1
            if (options := known.get(ch)) is None:
                if ch in STANDS_FOR:
                    options = [(x, math.log(0.6 / len(STANDS_FOR[ch]))) for x in STANDS_FOR[ch]]
                else:
                    options = [(ch, 0.0)]
                    if (base := _letter(ch)) != ch:
                        options.append((base, -1.0))
                known[ch] = options
            n = j - i
            if n >= 3 and not spaced:  # a stretched letter stands for one or two
                out.append([(x * k, p + (-0.3 if k == 1 else -1.4)) for x, p in options for k in (1, 2)])
            else:
                out += [options] * n
            i = j
        if spaced:  # a word may end after each but the last
            ends = {ch: [*s, *((x + " ", p - 4.0) for x, p in s)] for ch, s in known.items()}
            out = [ends[ch] for ch in chars[:-1]] + out[-1:]
        return out

    def best(self, chars: str, spaced: bool = False) -> str:
        beam = {(0, 0): (0.0, "")}
        done: list[str] = []
        for at, slot in enumerate(self.slots(chars, spaced), 1):
            now: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, said) in beam.items():
                for piece, p in slot:
                    x, y, s = a, b, score + p
                    for ch in piece:
                        c = self._number(ch)
                        s += self.lm[x][y][c]
                        x, y = y, c
                    if (k := (x, y)) not in now or s > now[k][0]:
                        now[k] = (s, said + piece)
            beam = now
            if at % SETTLE == 0 and (shared := os.path.commonprefix([said for _, said in beam.values()])):
                done.append(shared)
                beam = {k: (score, said[len(shared) :]) for k, (score, said) in beam.items()}
        return "".join(done) + max(((s + self.lm[a][b][0], said) for (a, b), (s, said) in beam.items()), default=(0.0, ""))[1]

    def restore(self, token: str) -> str:
        """The word behind a lower-cased token of any length."""
        token = _junk_tail.sub("", token).lstrip(_strip_left).rstrip(_strip_right)
        if len(token) < 3 or token.isalpha() and not _run.search(token):
            return token
        if _joined.match(token):
            token = re.sub(r"[.\-_*~]", "", token)
        elif not _run.search(token) and not _leet.match(token):
            return token
        return self.best(token)


def features(word: str) -> list[str]:
    """The word and its first letters, by which inflected forms share evidence."""
    return ["=" + word, *(word[:k] + "~" for k in (4, 5, 6) if len(word) >= k)]


def spaced_words(tokens: list[str], decoder: Decoder) -> list[str]:
    """Words spelled as four or more single characters in a row."""
    ones = "".join(["1" if len(t) == 1 and (t.isalpha() or t in STANDS_FOR) and t != "|" else "0" for t in tokens])
    out: list[str] = []
    for m in re.finditer("1{4,}", ones):
        out += decoder.best("".join(tokens[m.start() : m.end()]), spaced=True).split()
    return out


@dataclass
class ToxicityModel:
    """All that scoring needs, each of bounded size: character log probabilities, (t, c) by feature, logistic weights."""

    characters: np.ndarray
    evidence: dict[str, tuple[int, int]]
    weights: np.ndarray

    def scorer(self):
        decoder, evidence, weights = Decoder(self.characters), {f: t / (t + c + PRIOR) for f, (t, c) in self.evidence.items()}, self.weights

        class Known(dict):
            def __missing__(self, token: str) -> float:
                p = max((evidence.get(f, 0.0) for f in features(decoder.restore(token))), default=0.0)
                if len(token) <= KNOWN_LETTERS:
                    if len(self) > KNOWN_WORDS:
                        self.clear()
                    self[token] = p
                return p

        known = Known()

        def score(text: str | None) -> float:
            tokens = (text or "").lower().split()
            found = [p for p in map(known.__getitem__, {*tokens, *spaced_words(tokens, decoder)}) if p]
            return float(1 / (1 + np.exp(-describe(found, len(tokens)) @ weights)))

        return score


#: Strongest words of a text that are weighed each on its own; all others are weighed together.
SINGLE = 4


def describe(found: list[float], tokens: int) -> np.ndarray:
    """1, the strongest words' evidence, that of all other words together, and the text's length, as the logistic model takes them."""
    by = sorted(found, reverse=True)
    return np.array([1.0, *by[:SINGLE], *[0.0] * (SINGLE - len(by)), math.log1p(sum(by[SINGLE:])), math.log1p(tokens) / 10])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Newton's method; few or one-sided labels leave weights near a prior that trusts the strongest word."""
    prior = np.array([-5.0, 8.0, *[0.0] * (SINGLE + 1)])
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * (w - prior))
        w = w + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), which holds the rows to learn from and no others.

    The character model counts all texts of ``docs``.  Evidence comes from at most ``fit_rows`` labelled rows
    (a documented bound), copies counted once: a feature's weight is t / (t + c + PRIOR) for t toxic and c
    other texts that hold it, from LEAST_TEXTS toxic texts and a weight of LEAST_PRECISION on.  A logistic model
    over a text's words, each weighed without the text itself, gives the score.  Rows with a null label or id
    teach nothing; without labels nothing scores high.  Texts are read whole, one at a time; a label of a repeated
    id counts for each of its texts, and where ids repeat the first ``fit_rows`` rows by hash are taken.
    """
    small_batches(docs.sparkSession)
    characters = character_model(docs)
    chosen = labels.filter("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(fit_rows)
    labelled = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen.distinct()), "doc_id").select("text", "toxic").filter("text is not null").distinct().withColumn("k", F.xxhash64("text", "toxic")))
    first = labelled.select("k").distinct().orderBy("k").limit(fit_rows)
    sample = labelled.join(F.broadcast(first), "k", "left_semi").select("text", "toxic")

    def words_of(text, decoder):
        tokens = text.lower().split()
        return {decoder.restore(t) for t in set(tokens)} | set(spaced_words(tokens, decoder)), len(tokens)

    def count(batches):
        decoder, found = Decoder(characters), {}

        def out():
            keys = list(found)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([found[k][1] for k in keys], pa.int64()), pa.array([found[k][0] for k in keys], pa.int64())], ["feature", "t", "c"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in {f for w in words_of(text, decoder)[0] for f in features(w) if w}:
                    found.setdefault(f, [0, 0])[toxic > 0] += 1
            if len(found) > 300_000:
                yield out()
                found.clear()
        yield out()

    counts = sample.mapInArrow(count, "feature string, t long, c long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    weight = F.col("t") / (F.col("t") + F.col("c") + PRIOR)
    kept = counts.filter((F.col("t") >= LEAST_TEXTS) & (weight >= LEAST_PRECISION))
    evidence = {r["feature"]: (r["t"], r["c"]) for r in kept.collect()}

    def inputs(batches):
        decoder = Decoder(characters)
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, n = words_of(text, decoder)
                y, found = int(toxic > 0), []
                for w in words:
                    tc = [evidence[f] for f in features(w) if f in evidence]
                    if tc and (p := max((t - y) / (t + c - 1 + PRIOR) for t, c in tc)) > 0:
                        found.append(p)
                rows.append([float(y), *describe(found, n)])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], ["x"])

    rows = np.array([r["x"] for r in sample.mapInArrow(inputs, "x array<double>").collect()]).reshape(-1, SINGLE + 4)
    forget(labelled)
    return ToxicityModel(characters, evidence, _logistic(rows[:, 1:], rows[:, 0]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``score_col`` (0 to 1); null and empty texts score lowest.

    All rows and columns stay, an own column of that name is replaced.  A row's score depends on its text alone, so
    repeated rows score alike.  Texts are read whole; a long one takes memory in proportion to its words.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(score_col)
    at = docs.columns.index(text_col)

    def run(batches):
        score = sent.value.scorer()
        for batch in batches:
            scores = [score(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, score_col])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))
