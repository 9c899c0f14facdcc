"""Many phrases in one pass over a text: an Aho-Corasick automaton that each Python worker builds once for a list.

A text travels once in an Arrow batch, whatever the length of the list, and comes back as bits or as spans.  Bits
say which phrases a text holds; conditions on them are column expressions, so patterns that need certain phrases
run in the JVM and only where those stand.  Matching is of code points as they are; fold the text first where case
doesn't count, as :func:`phrase_bits` and :func:`phrase_spans` do on request.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of an element; a sign bit would only complicate masks.
WORD = 60
SPANS = "array<struct<start:int,end:int,phrase:int>>"
_FOLD = {c: c + 32 for c in range(65, 91)}
_built: dict = {}


def automaton(phrases: tuple[str, ...]):
    """Phrase -> its first place in the list; empty ones are left out.  The worker keeps the last few."""
    import ahocorasick

    if phrases not in _built:
        made = ahocorasick.Automaton()
        for i, p in reversed(list(enumerate(phrases))):
            if p:
                made.add_word(p, (i, len(p)))
        if len(made):
            made.make_automaton()
        if len(_built) >= 16:
            _built.pop(next(iter(_built)))
        _built[phrases] = made if len(made) else None
    return _built[phrases]


def phrase_bits(text: Column, phrases: Sequence[str]) -> Column:
    """array<long> of bits, of phrase i bit i % 60 of element i // 60; a null text has none."""
    phrases = tuple(phrases)
    size = -(-len(phrases) // WORD)

    @F.arrow_udf("array<long>")
    def find(texts: pa.Array) -> pa.Array:
        made = automaton(phrases)
        out = []
        for t in texts.to_pylist():
            if t is None:
                out.append(None)
                continue
            words = [0] * size
            for i in {v[0] for _, v in made.iter(t)} if made is not None else ():
                words[i // WORD] |= 1 << i % WORD
            out.append(words)
        return pa.array(out, pa.list_(pa.int64()))

    return find(text)


def any_bit(bits: Column, places: Iterable[int]) -> Column:
    """Whether one of the phrases at ``places`` is among the bits."""
    masks: dict[int, int] = {}
    for i in places:
        masks[i // WORD] = masks.get(i // WORD, 0) | 1 << i % WORD
    tests = [F.get(bits, F.lit(w)).bitwiseAND(F.lit(m).cast("long")) != 0 for w, m in sorted(masks.items())]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def whole(text: str, start: int, end: int) -> bool:
    """No letter or digit beside a span."""
    return not (start > 0 and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())


def occurrences(made, text: str, folded: str, whole_words: bool) -> list[tuple[int, int, int]]:
    """(start, end, phrase) of every occurrence, overlapping ones too."""
    found = [(at + 1 - n, at + 1, i) for at, (i, n) in made.iter(folded)] if made is not None else []
    return [s for s in found if whole(text, s[0], s[1])] if whole_words else found


def apart(found: list[tuple[int, int, int]], longest: bool = False) -> list[tuple[int, int, int]]:
    """Occurrences from left to right that don't overlap; of those with one start the shortest, or the longest."""
    out: list[tuple[int, int, int]] = []
    for s in sorted(found, key=lambda s: (s[0], -s[1] if longest else s[1], s[2])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def phrase_spans(text: Column, phrases: Sequence[str], fold: bool = True, whole_words: bool = False, overlapping: bool = False, longest: bool = False) -> Column:
    """Spans (start, end, place in the list) of phrases by start, in code points, the end exclusive.

    ``fold`` takes A-Z for a-z on both sides.  Without ``overlapping`` the leftmost stay, of those with one start
    the shortest, or the ``longest``.  A null text has none; an empty phrase is never found.
    """
    told = tuple(p.translate(_FOLD) if fold else p for p in phrases)

    @F.arrow_udf(SPANS)
    def find(texts: pa.Array) -> pa.Array:
        made = automaton(told)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("phrase", pa.int32())]))
        out = []
        for t in texts.to_pylist():
            if t is None:
                out.append(None)
                continue
            found = occurrences(made, t, t.translate(_FOLD) if fold else t, whole_words)
            out.append([dict(zip(("start", "end", "phrase"), s)) for s in (sorted(found) if overlapping else apart(found, longest))])
        return pa.array(out, kind)

    return find(text)


def phrases_masked(text: Column, phrases: Sequence[str], marks: Sequence[str], fold: bool = True, whole_words: bool = False) -> Column:
    """struct<n, clean>: phrases that stand apart from left to right, the shortest first, and the text with each phrase replaced by its mark.

    Phrases are replaced one after another in the order of the list, so an earlier one takes what a later one
    would overlap.
    """
    told = tuple(p.translate(_FOLD) if fold else p for p in phrases)
    marks = tuple(marks)

    @F.arrow_udf("struct<n:int,clean:string>")
    def find(texts: pa.Array) -> pa.Array:
        made = automaton(told)
        counts, clean = [], []
        for t in texts.to_pylist():
            if t is None:
                counts.append(None)
                clean.append(None)
                continue
            found = occurrences(made, t, t.translate(_FOLD) if fold else t, whole_words)
            counts.append(len(apart(found)))
            if not found:
                clean.append(t)
                continue
            taken, kept = bytearray(len(t)), []
            for a, b, i in sorted(found, key=lambda s: (s[2], s[0])):
                if not any(taken[a:b]):
                    taken[a:b] = b"\1" * (b - a)
                    kept.append((a, b, i))
            parts, at = [], 0
            for a, b, i in sorted(kept):
                parts += [t[at:a], marks[i]]
                at = b
            clean.append("".join([*parts, t[at:]]))
        return pa.StructArray.from_arrays([pa.array(counts, pa.int32()), pa.array(clean, pa.string())], ["n", "clean"])

    return find(text)
