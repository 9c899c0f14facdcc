"""Detectors that need places in the text: abusive language with context, and code with its density."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import lexicon as L
from ..catalog import patterns as P
from ..functions.text import EPSILON
from . import spans
from .detectors import ABUSE_WEIGHT
from .scanners import CODE_PATTERNS
from .spans import SPANS

# Fixed values: (id, category, severity, confidence, words, context words or none).  Slurs are left out.
TOXIC_GROUPS = [
    ("severe-profanity-1", "severe_toxic", "critical", 0.95, ["f***", "s***", "a**hole", "b***h", "c***"], []),
    ("threat-kill-1", "threat", "critical", 0.92, ["kill you", "murder you", "end your life", "you will die", "you're dead", "going to kill", "gonna kill"], []),
    ("threat-harm-1", "threat", "critical", 0.88, ["hurt you", "beat you", "punch you", "attack you", "destroy you", "break your", "smash your"], []),
    ("threat-violence-1", "threat", "high", 0.75, ["watch your back", "coming for you", "i'll get you", "be afraid", "you should be scared", "regret this"], ["you", "your"]),
    ("threat-weapon-1", "threat", "critical", 0.95, ["shoot you", "stab you", "bring a gun", "knife you"], []),
    ("insult-intelligence-1", "insult", "medium", 0.75, ["idiot", "stupid", "dumb", "moron", "imbecile", "retard", "braindead", "brainless"], []),
    ("insult-general-1", "insult", "medium", 0.70, ["loser", "pathetic", "worthless", "useless", "garbage", "trash", "scum", "disgrace"], []),
    ("insult-appearance-1", "insult", "medium", 0.65, ["ugly", "fat", "disgusting", "hideous", "repulsive"], ["you", "your", "you're", "look"]),
    ("insult-incompetence-1", "insult", "medium", 0.70, ["incompetent", "failure", "hopeless", "joke", "clown", "fool"], []),
    ("hate-sexism-1", "identity_hate", "high", 0.80, ["women belong in", "women should", "females are", "typical woman", "stupid women"], []),
    ("hate-religious-1", "identity_hate", "high", 0.82, ["all muslims", "all jews", "all christians", "[religion] are terrorists", "[religion] are evil"], []),
    ("hate-xenophobia-1", "identity_hate", "high", 0.75, ["immigrants are", "foreigners are", "build the wall", "close the borders", "send them back"], ["all", "should", "need to", "must"]),
    ("obscene-sexual-1", "obscene", "high", 0.85, ["suck my", "blow me", "screw you", "f*** yourself"], []),
    ("obscene-crude-1", "obscene", "high", 0.80, ["piece of s***", "eat s***", "shove it", "go to hell", "kiss my a**"], []),
    ("toxic-hate-1", "toxic", "medium", 0.70, ["i hate you", "hate your", "despise you", "cant stand you", "can't stand you"], []),
    ("toxic-wish-harm-1", "toxic", "critical", 0.95, ["hope you die", "wish you were dead", "drop dead", "go die", "kys", "kill yourself"], []),
    ("toxic-dismissive-1", "toxic", "low", 0.60, ["shut up", "nobody cares", "no one asked", "stfu", "gtfo"], []),
    ("toxic-dehumanizing-1", "toxic", "high", 0.85, ["subhuman", "less than human", "not even human", "animal", "vermin", "cockroach"], ["you", "they", "them", "people"]),
]
#: Characters on either side of a match where its context words may stand.
CONTEXT = 50


def _expression(words: list[str]) -> str:
    one = lambda w: "".join("." if c == "*" else re.escape(c) for c in w)
    return r"(?<![0-9A-Za-z_])(?:" + "|".join(map(one, words)) + r")(?![0-9A-Za-z_])"


def toxic_spans(text: Column, threshold: float = 0.7, sensitivity: float = 0.5) -> Column:
    """Spans over the lower-cased text of single spaces.  A span that overlaps an earlier one of its category makes that one surer by .05."""
    shift = (sensitivity - 0.5) * 0.1

    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        compiled = [(i, c, s, round(min(1.0, max(0.0, p + shift)), 2), re.compile(_expression(w)), ctx) for i, c, s, p, w, ctx in TOXIC_GROUPS]

        def one(t):
            if t is None:
                return None
            t = re.sub(r"\s+", " ", t.lower()).strip()
            spans = []
            for i, category, severity, sure, pattern, context in compiled:
                for m in pattern.finditer(t):
                    around = t[max(0, m.start() - CONTEXT) : m.start() + CONTEXT]
                    if not context or any(c in around for c in context):
                        spans.append({"kind": i, "category": category, "severity": severity, "start": m.start(), "end": m.end(), "confidence": sure, "value": m.group()})
            kept: list[dict] = []
            for s in sorted(spans, key=lambda s: (s["start"], -s["confidence"])):
                if kept and s["start"] < kept[-1]["end"]:
                    if kept[-1]["category"] == s["category"]:
                        kept[-1]["confidence"] = min(1.0, kept[-1]["confidence"] + 0.05)
                else:
                    kept.append(s)
            return [s for s in kept if s["confidence"] >= threshold - EPSILON]

        return texts.map(one)

    return find(text)


#: Confidence of each kind of code; keywords count once each.
CODE_CONFIDENCE = {"n_fence": 1.0, "n_func": 0.95, "n_import": 0.9, "n_var": 0.85}


def code_risk(text: Column) -> Column:
    """struct(n, risk_score): spans of code that don't overlap, .6 times their share of the bytes and .4 times their mean confidence."""

    @F.pandas_udf("struct<n:int,risk_score:double>")
    def find(texts: pd.Series) -> pd.DataFrame:
        compiled = [(re.compile(p, re.ASCII), CODE_CONFIDENCE[k]) for k, p in CODE_PATTERNS.items()]

        def one(t):
            if not t:
                return (0, 0.0) if t == "" else (None, None)
            low = t.lower()
            spans = [(m.start(), m.end(), c) for p, c in compiled for m in p.finditer(t)]
            spans += [(at, at + len(k), 0.7) for k in L.BAN_CODE_KEYWORDS if (at := low.find(k)) >= 0]
            kept, end = [], 0
            for s in sorted(spans, key=lambda s: s[0]):
                if s[0] >= end:
                    kept.append(s)
                    end = s[1]
            if not kept:
                return 0, 0.0
            size = sum(len(t[a:b].encode("utf-8", "surrogatepass")) for a, b, _ in kept)
            return len(kept), min(1.0, 0.6 * size / len(t.encode("utf-8", "surrogatepass")) + 0.4 * sum(c for _, _, c in kept) / len(kept))

        return pd.DataFrame([one(t) for t in texts], columns=["n", "risk_score"])

    return find(text)


def abuse_risk(text: Column, threshold: float = 0.7, sensitivity: float = 0.5) -> Column:
    """struct(n, risk_score, severity) of model abuse: of overlapping matches the first stands, or a surer one that overlaps it."""
    rules = [spans.Rule(i, p, min(1.0, c + (sensitivity - 0.5) * 0.2), k, s) for i, k, s, c, p in P.ABUSE if min(1.0, max(0.0, c + (sensitivity - 0.5) * 0.2)) >= threshold - EPSILON]
    found = spans.spans_udf(rules, spans.surest)(text)
    load = lambda x: F.aggregate(x, F.lit(0.0), lambda a, m: a + F.try_element_at(weight, m.severity) * m.confidence)
    weight = F.create_map(*[F.lit(v) for kv in ABUSE_WEIGHT.items() for v in kv])
    severity = F
    kinds = F.transform(found, lambda m: m.severity)
    for name in ("critical", "high", "medium", "low"):
        severity = severity.when(F.array_contains(kinds, name), name)
    return F.struct(F.size(found).alias("n"), F.least(F.lit(1.0), F.round(load(found), 2)).alias("risk_score"), severity.otherwise("none").alias("severity"))
