"""Detectors: pattern catalogs with a sensitivity, and the risk rules of each agent."""

from __future__ import annotations

import re
import warnings
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..catalog import patterns as P
from ..functions.text import EPSILON, Fields, band, clamp, entropy, extract, gated, java, let, once, total

Verdict = dict[str, Column]

# Weights of severities in the noisy-or of secrets and credentials.
LEAK_WEIGHT = {"none": 0.0, "low": 0.2, "medium": 0.4, "high": 0.7, "critical": 1.0}
RANK = {"none": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
SCORE_BANDS = [(0.9, "critical"), (0.7, "high"), (0.4, "medium"), (0.1, "low")]


def _worst(counts: list[tuple[Column, str]]) -> Column:
    """Greatest severity among those with a count."""
    chain = F
    for s in ("critical", "high", "medium", "low"):
        if some := [n > 0 for n, of in counts if of == s]:
            chain = chain.when(reduce(lambda a, b: a | b, some), s)
    return chain.otherwise("none")


def _noisy_or(text: Column, rows: list[tuple[str, str, str, float, float]], sensitivity: float) -> Verdict:
    """rows: (id, category, severity, confidence, pattern, factor); risk 1 - exp(-sum of weight x confidence)."""
    rows = [r for r in rows]
    names = [f"c{i}" for i in range(len(rows))]
    shrink = 0.5 + 0.5 * sensitivity

    def judged(x):
        counts = [(x[n], r[2]) for n, r in zip(names, rows)]
        load = reduce(lambda a, b: a + b, [x[n] * (LEAK_WEIGHT[r[2]] * min(1.0, r[3] * shrink) * r[5]) for n, r in zip(names, rows)], F.lit(0.0))
        sure = F.greatest(F.lit(0.0), *[F.when(x[n] > 0, min(1.0, r[3] * shrink)).otherwise(0.0) for n, r in zip(names, rows)])
        n = total([x[n] for n in names])
        return F.struct(n.alias("n"), F.when(n > 0, 1 - F.exp(-load)).otherwise(0.0).alias("risk_score"), F.when(n > 0, sure).otherwise(1.0).alias("confidence"), _worst(counts).alias("severity"))

    out = gated(text, [r[4] for r in rows], lambda g: let({n: g.count(r[4]) for n, r in zip(names, rows)}, judged))
    return Fields(out, ("n", "risk_score", "confidence", "severity"))


def usable(patterns: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The (id, pattern) pairs whose pattern compiles; others are left out with a warning."""
    out = []
    for i, p in patterns:
        try:
            if spark := SparkSession.getActiveSession():
                spark._jvm.java.util.regex.Pattern.compile(java(p))
            else:
                re.compile(p)
            out.append((i, p))
        except Exception as e:  # noqa: BLE001  the JVM's error has no class here
            warnings.warn(f"pattern {i} is left out: {str(e).splitlines()[0]}", stacklevel=3)
    return out


def secrets(text: Column, sensitivity: float = 0.5, custom: list[tuple[str, str]] = ()) -> Verdict:
    """Leaked keys and tokens; ``custom`` adds (id, pattern) rows of medium severity and confidence .7, but for patterns that don't compile."""
    rows = [(i, c, s, f, p, 1.0) for i, c, s, f, p in P.SECRETS] + [(f"custom-{i}", "custom", "medium", 0.7, p, 1.0) for i, p in usable(custom)]
    return _noisy_or(text, rows, sensitivity)


def credentials(text: Column, sensitivity: float = 0.5, leave_out: tuple[str, ...] = ()) -> Verdict:
    """Exposed logins; a pair of name and password weighs half as much again."""
    return _noisy_or(text, [(i, c, s, f, p, 1.5 if pair else 1.0) for i, c, s, f, pair, p in P.CREDENTIALS if i not in leave_out], sensitivity)


# Places where a random string may be a secret.
ENTROPY_CONTEXTS = [
    r"""(?i)(?:api[_-]?key|secret|token|password|passwd|pwd|auth|credential|access[_-]?key)["']?\s*[:=]\s*["']?([a-zA-Z0-9+/=_-]{16,})""",
    r"(?:[A-Z_]+(?:KEY|SECRET|TOKEN|PASSWORD|CREDENTIAL))=([a-zA-Z0-9+/=_-]{16,})",
    r"""["']([a-zA-Z0-9+/=_-]{32,})["']""",
    r"(?i)Bearer\s+([a-zA-Z0-9._-]{20,})",
    r"(?i)Basic\s+([a-zA-Z0-9+/=]{16,})",
]


def entropy_candidates(text: Column, threshold: float = 4.5, sensitivity: float = 0.5) -> Verdict:
    """Distinct random-looking values after a telling word, and the confidence in the most random."""
    values = F.array_distinct(F.flatten(F.array(*[extract(text, p, 1) for p in ENTROPY_CONTEXTS])))
    scored = let({"h": F.filter(F.transform(values, entropy), lambda h: h >= threshold - EPSILON)}, lambda x: F.struct(F.size(x.h).alias("n"), F.array_max(x.h).alias("top")))
    return once(scored, lambda x: {"n": x.n, "confidence": F.coalesce((0.5 + 0.4 * (x.top - threshold) / (8 - threshold)) * (0.5 + 0.5 * sensitivity), F.lit(0.0)), "entropy": F.coalesce(x.top, F.lit(0.0))})


def _agent(text: Column, rows: list[tuple[str, str, float, float, str]], sensitivity: float, factor: float) -> Column:
    """Struct of n, risk, confidence, severity and n by category: the rules that three agents share."""
    names = [f"c{i}" for i in range(len(rows))]
    categories = list(dict.fromkeys(r[1] for r in rows))
    adjust = lambda c: clamp(c + (sensitivity - 0.5) * factor)

    def judged(x):
        n = total([x[k] for k in names])
        points, kinds, by = F.lit(0.0), F.lit(0), []
        for c in categories:
            own = [(x[k], r) for k, r in zip(names, rows) if r[1] == c]
            m = total([k for k, _ in own])
            worst = F.greatest(F.lit(0.0), F.lit(0.0), *[F.when(k > 0, r[2]).otherwise(0.0) for k, r in own])
            mean = reduce(lambda a, b: a + b, [k * r[3] for k, r in own]) / m
            points = points + F.when(m > 0, adjust(worst) * adjust(mean)).otherwise(0.0)
            kinds = kinds + (m > 0).cast("int")
            by.append(m.alias(f"n_{c}"))
        risk = F.when(kinds > 0, F.least(F.lit(1.0), points / kinds) * (0.5 + 0.5 * sensitivity)).otherwise(0.0)
        mean = reduce(lambda a, b: a + b, [x[k] * r[3] for k, r in zip(names, rows)]) / n
        sure = F.when(n > 0, adjust(mean + F.least(F.lit(0.2), n * 0.02))).otherwise(1.0)
        surest = {c: F.greatest(F.lit(0.0), F.lit(0.0), *[F.when(x[k] > 0, min(1.0, max(0.0, r[3] + (sensitivity - 0.5) * factor))).otherwise(0.0) for k, r in zip(names, rows) if r[1] == c]) for c in categories}
        return F.struct(n.alias("n"), risk.alias("risk_score"), sure.alias("confidence"), band(risk, SCORE_BANDS, "none").alias("severity"), *by, *(s.alias(f"sure_{c}") for c, s in surest.items()))

    return gated(text, [r[4] for r in rows], lambda g: let({k: g.count(r[4]) for k, r in zip(names, rows)}, judged))


def _both_cases(rows):
    return [(i, c, s, f, p if p.startswith("(?i)") else "(?i)" + p) for i, c, s, f, p in rows]


def injection(text: Column, sensitivity: float = 0.5) -> Verdict:
    """All matches of every injection pattern, in any case of letters."""
    out = _agent(text, _both_cases(P.INJECTION), sensitivity, 0.4)
    return Fields(out, ("n", "risk_score", "confidence", "severity", *(f"n_{c}" for c in dict.fromkeys(r[1] for r in P.INJECTION))))


# Categories that always block, and those that an age check opens.
MODERATION_CRITICAL = ("hate_discriminatory", "illegal_regulated", "self_harm", "child_safety", "terrorism_extremism")
MODERATION_ADULT = ("adult_content", "violence_graphic")
SAFETY_CRITICAL = ("hate_speech", "self_harm", "illegal_activity")


def _ladder(out: Column, categories: list[str], critical, adult, least: float, default: str, unsure: str, verified: bool, rules) -> Column:
    at_least = lambda names: reduce(lambda a, b: a | b, [out[f"sure_{c}"] >= least - EPSILON for c in names if c in categories], F.lit(False))
    action = F.when(out["n"] == 0, "ALLOW").when(out["confidence"] < least - EPSILON, unsure).when(at_least(critical), "BLOCK")
    if adult and not verified:
        action = action.when(at_least(adult), "AGE_GATE")
    elif adult:
        others = total([out[f"n_{c}"] for c in categories if c not in adult])
        action = action.when(at_least(adult) & (others == 0), "WARN")
    for rule in sorted((r for r in rules if r.get("enabled", True)), key=lambda r: r["priority"]):
        action = action.when((out[f"n_{rule['category']}"] > 0) & (out[f"sure_{rule['category']}"] >= rule["threshold"] - EPSILON), rule["action"])
    return action.otherwise(default)


def _decided(out: Column, critical: tuple[str, ...], action) -> Verdict:
    """The agent's measures and its action, from one struct that is computed once."""
    severity = lambda x: F.when(total([x[f"n_{c}"] for c in critical]) > 0, "critical").otherwise(x["severity"])
    return once(out, lambda x: {k: x[k] for k in ("n", "risk_score", "confidence")} | {"severity": severity(x), "action": action(x)})


def moderation(text: Column, sensitivity: float = 0.7, least: float = 0.8, default: str = "BLOCK", verified: bool = False, rules: list[dict] = ()) -> Verdict:
    """Rules: dicts of category, threshold, priority, action and enabled; the one of least priority that fires decides."""
    rows, categories = P.MODERATION, list(dict.fromkeys(r[1] for r in P.MODERATION))
    out = _agent(text, rows, sensitivity, 0.6)
    return _decided(out, MODERATION_CRITICAL, lambda x: _ladder(x, categories, MODERATION_CRITICAL, MODERATION_ADULT, least, default, "FLAG", verified, rules))


def safety(text: Column, sensitivity: float = 0.7, least: float = 0.8, default: str = "BLOCK", rules: list[dict] = ()) -> Verdict:
    categories = list(dict.fromkeys(r[1] for r in P.SAFETY))
    out = _agent(text, P.SAFETY, sensitivity, 0.6)
    return _decided(out, SAFETY_CRITICAL, lambda x: _ladder(x, categories, SAFETY_CRITICAL, (), least, default, "AUDIT", False, rules))


# Weights of severities in model abuse.
ABUSE_WEIGHT = {"none": 0.0, "low": 0.1, "medium": 0.25, "high": 0.4, "critical": 0.6}


def abuse_text(text: Column, threshold: float = 0.7, sensitivity: float = 0.5) -> Verdict:
    """Matches of abuse patterns whose confidence reaches the threshold; overlapping matches of two patterns both count, see text_agents.abuse_risk."""
    rows = [r for r in P.ABUSE if min(1.0, max(0.0, r[3] + (sensitivity - 0.5) * 0.2)) >= threshold - EPSILON]
    names = [f"c{i}" for i in range(len(rows))]

    def judged(x):
        load = reduce(lambda a, b: a + b, [x[k] * (ABUSE_WEIGHT[r[2]] * min(1.0, r[3] + (sensitivity - 0.5) * 0.2)) for k, r in zip(names, rows)])
        return F.struct(total([x[k] for k in names]).alias("n"), F.least(F.lit(1.0), F.round(load, 2)).alias("risk_score"), _worst([(x[k], r[2]) for k, r in zip(names, rows)]).alias("severity"))

    out = gated(text, [r[4] for r in rows], lambda g: let({k: g.count(r[4]) for k, r in zip(names, rows)}, judged))
    return Fields(out, ("n", "risk_score", "severity"))


def pattern_counts(text: Column, rows: list[tuple], leave_out: tuple[str, ...] = ()) -> Verdict:
    """Matches of each pattern of a catalog, as n_<id>."""
    names = {"n_" + r[0].replace("-", "_"): r[-1] for r in rows if r[0] not in leave_out}
    out = gated(text, list(names.values()), lambda g: F.struct(*(g.count(p).alias(n) for n, p in names.items())))
    return Fields(out, names)
