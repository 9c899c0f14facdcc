"""Phrase automata against plain search, and what patterns require against the patterns themselves."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wardline.catalog import patterns as P
from wardline.functions import phrases as ph
from wardline.functions.text import Fields, clauses, once, with_fields
from wardline.operators import scanners as S


def texts(seed, n=80):
    rng = random.Random(seed)
    return ["".join(rng.choice("abAB .é1") for _ in range(rng.randrange(40))) for _ in range(n)] + [None, "", "a", "ab" * 5000]


def plain(text, phrases, whole):
    """Every occurrence by plain search."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    out = []
    for i, p in enumerate(phrases):
        at = low.find(p) if p and p not in phrases[:i] else -1
        while at >= 0:
            beside = text[at - 1 : at] if at else "", text[at + len(p) : at + len(p) + 1]
            if not whole or not any(c.isalnum() for c in beside):
                out.append((at, at + len(p), i))
            at = low.find(p, at + 1)
    return sorted(out)


@pytest.mark.parametrize("whole", [False, True])
def test_spans_and_bits_of_overlapping_phrases(spark, whole):
    phrases = ["a", "ab", "aba", "bab", "b a", "é", "", "a.", "ab", "b" * 70] + [f"x{i}" for i in range(100)]
    rows = texts(1)
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    got = df.select("t", ph.phrase_spans(F.col("t"), phrases, whole_words=whole, overlapping=True).alias("every"), ph.phrase_spans(F.col("t"), phrases, whole_words=whole).alias("apart"), ph.phrase_spans(F.col("t"), phrases, whole_words=whole, longest=True).alias("longest"), ph.phrase_bits(F.lower("t"), phrases).alias("bits")).collect()
    for r in got:
        if r.t is None:
            assert r.every is None and r.apart is None and r.bits is None
            continue
        want = plain(r.t, phrases, whole)
        assert [tuple(s) for s in r.every] == want
        for held, sign in ((r.apart, 1), (r.longest, -1)):
            kept, end = [], 0
            for s in sorted(want, key=lambda s: (s[0], sign * s[1])):
                if s[0] >= end:
                    kept.append(s)
                    end = s[1]
            assert [tuple(s) for s in held] == kept
        if not whole:
            assert {i for w, word in enumerate(r.bits) for i in range(w * ph.WORD, (w + 1) * ph.WORD) if word >> i % ph.WORD & 1} == {s[2] for s in want}


@pytest.mark.parametrize("whole", [False, True])
def test_long_and_short_lists_agree(spark, monkeypatch, whole):
    phrases = ["ab", "a", "b a", "1a", "bb", "é"]
    df = spark.createDataFrame([(t,) for t in texts(2)], "t string")
    out = []
    for few in (8, 0):
        monkeypatch.setattr(S, "FEW_PHRASES", few)
        out.append(S.with_verdict(df, S.ban_substrings(F.col("t"), phrases, whole)).collect())
        out.append(S.with_verdict(df, S.ban_competitors(F.col("t"), phrases)).collect())
    assert out[0] == out[2] and out[1] == out[3]


def test_ten_thousand_phrases(spark):
    phrases = [f"word{i}" for i in range(10_000)]
    df = spark.createDataFrame([("Word17, word9999x and word5 word55",)], "t string")
    v = S.with_verdict(df, S.ban_substrings(F.col("t"), phrases, whole_words=True)).first()
    assert (v.matches_count, v.sanitized) == (3, "******, word9999x and ***** ******")


def test_patterns_require_their_clauses():
    """Whatever a catalog pattern matches holds a string of each clause; matches are drawn from the patterns by their own parse trees."""
    rng = random.Random(3)

    def draw(tree):
        out = ""
        for op, of in tree:
            name = str(op)
            if name == "LITERAL":
                out += chr(of)
            elif name == "NOT_LITERAL":
                out += "z" if of != ord("z") else "y"
            elif name == "ANY":
                out += "q"
            elif name == "IN":
                kinds = {str(o): v for o, v in of}
                if "NEGATE" in kinds:
                    out += next((c for c in "q5 ~" if not any(str(o) == "LITERAL" and v == ord(c) or str(o) == "RANGE" and v[0] <= ord(c) <= v[1] for o, v in of)), "q")
                else:
                    o, v = rng.choice(of)
                    out += chr(v) if str(o) == "LITERAL" else chr(v[0]) if str(o) == "RANGE" else {"CATEGORY_DIGIT": "7", "CATEGORY_SPACE": " ", "CATEGORY_WORD": "w"}.get(str(v), "q")
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                out += "".join(draw(of[2]) for _ in range(of[0] + rng.randrange(2) if of[0] < of[1] else of[0]))
            elif name == "SUBPATTERN":
                out += draw(of[3])
            elif name == "BRANCH":
                out += draw(rng.choice(of[1]))
        return out

    from re import _parser

    n = 0
    for rows in (P.INJECTION, P.MODERATION, P.SAFETY, P.SECRETS, P.CREDENTIALS, P.ABUSE):
        for r in rows:
            tree = _parser.parse(r[-1])
            for _ in range(20):
                text = draw(tree)
                if re.search(r[-1], text):
                    n += 1
                    assert all(any(x in text.lower() for x in c) for c in clauses(r[-1])), (r[-1], text)
    assert n > 1000


def test_fields_are_computed_once(spark):
    """A struct's columns come from one evaluation of it, and names that clash stay apart."""
    df = spark.createDataFrame([(2, "x")], "a int, __fields string")
    v = once(F.struct((F.col("a") * 3).alias("b")), lambda x: {"c": x.b + 1, "d": x.b + 2})
    assert isinstance(v, Fields)
    out = with_fields(df, v, "p_")
    assert out.first().asDict() == {"a": 2, "__fields": "x", "p_c": 7, "p_d": 8}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(") == 1
