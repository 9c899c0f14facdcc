"""The browser build's scanners: a one-shot prompt scan, and personal data, abusive language and injection by rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import browser as B
from ..functions.text import bound, count, extract, found, let, total

Verdict = dict[str, Column]

# Weights of severities in the risk.
WEIGHT = {"none": 0.0, "low": 0.25, "medium": 0.5, "high": 0.75, "critical": 1.0}


def core_scan(text: Column, scanners: tuple[str, ...] = ("prompt-injection", "secrets")) -> Verdict:
    """Any injection pattern is risk .9, any secret 1; n_secrets counts every match of every pattern."""
    none = F.when(text.isNotNull(), F.lit(0))
    injection = reduce(lambda a, b: a | b, [found(text, p) for p in B.CORE_INJECTION]) if "prompt-injection" in scanners else F.lit(False)
    secrets = total([count(text, p) for _, p in B.CORE_SECRETS]) if "secrets" in scanners else none
    out = let({"i": injection, "s": secrets}, lambda x: F.struct(x.i.alias("i"), x.s.alias("s")))
    i, s = out["i"], out["s"]
    risk = F.when(s > 0, 1.0).when(i, 0.9).otherwise(0.0)
    return {"injection": i, "n_secrets": s, "risk_score": risk, "is_valid": risk <= 0}


def quick_scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the one-shot scan's verdict."""
    return df.withColumns(core_scan(F.col(text)))


def _risk(x: Column, factors: list[tuple[Column, str, Column]]) -> list[Column]:
    """n, risk_score, is_valid and severity of factors (count, severity, confidence): the mean of weight times confidence of those found."""
    n = total([c for c, _, _ in factors])
    kinds = total([(c > 0).cast("int") for c, _, _ in factors])
    load = reduce(lambda a, b: a + b, [F.when(c > 0, F.lit(WEIGHT[s]) * sure).otherwise(0.0) for c, s, sure in factors])
    severity = F
    for name in ("critical", "high", "medium", "low"):
        if some := [c > 0 for c, s, _ in factors if s == name]:
            severity = severity.when(reduce(lambda a, b: a | b, some), name)
    return [n.alias("n"), F.when(kinds > 0, F.least(F.lit(1.0), load / kinds)).otherwise(0.0).alias("risk_score"), (F.coalesce(kinds, F.lit(0)) == 0).alias("is_valid"), severity.otherwise("none").alias("severity")]


def luhn(number: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(number, "[^0-9]", ""))


def area(number: Column) -> Column:
    """Whether a social security number's first three digits can be."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    first = F.substring(digits, 1, 3).cast("int")
    return (F.length(digits) == 9) & (first != 0) & (first != 666) & (first < 900)


def sdk_pii(text: Column, kinds: tuple[str, ...] = B.SDK_PII_KINDS) -> Verdict:
    """Matches of every enabled pattern, cards and social security numbers validated; each type found is a factor of confidence .9."""
    rows = [r for r in B.SDK_PII if r[1] in kinds]
    valid = {"credit-card": luhn, "ssn": area}

    def counts(b):
        each = [F.size(F.filter(extract(b.t, p), valid[k])) if k in valid else count(b.t, p, b.low) for _, k, _, p in rows]
        return F.struct(*(c.alias(f"c{i}") for i, c in enumerate(each)))

    def judged(x):
        by = [total([x[f"c{i}"] for i, r in enumerate(rows) if r[1] == k]).alias("n_" + k.replace("-", "_")) for k in kinds]
        return F.struct(*_risk(x, [(x[f"c{i}"], r[2], F.lit(0.9)) for i, r in enumerate(rows)]), *by)

    out = F.get(F.transform(F.array(bound(text, counts)), judged), F.lit(0))
    return {n: out[n] for n in ("n", "risk_score", "is_valid", "severity", *("n_" + k.replace("-", "_") for k in kinds))}


def sdk_toxicity(text: Column, categories: tuple[str, ...] = B.SDK_TOXICITY_CATEGORIES, custom: tuple[str, ...] = (), allowed: tuple[str, ...] = ()) -> Verdict:
    """Matches of every enabled category's patterns; a category found is a factor whose confidence grows by .05 a match, to .95.

    ``custom`` words are a category of their own of medium severity, ``allowed`` words are no matches.
    """
    rows = [(c, s, ps) for c, s, ps in B.SDK_TOXICITY if c in categories]
    if custom:
        rows.append(("custom", "medium", [r"(?i)\b(" + "|".join("".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in w) for w in custom) + r")\b"]))

    def one(b, p):
        if not allowed:
            return count(b.t, p, b.low)
        return F.size(F.filter(extract(b.t, p), lambda m: ~F.lower(m).isin(*[w.lower() for w in allowed])))

    def counts(b):
        return F.struct(*(total([one(b, p) for p in ps]).alias(f"c{i}") for i, (_, _, ps) in enumerate(rows)))

    def judged(x):
        sure = lambda c: F.least(F.lit(0.95), 0.6 + c * 0.05)
        return F.struct(*_risk(x, [(x[f"c{i}"], s, sure(x[f"c{i}"])) for i, (_, s, _) in enumerate(rows)]))

    out = F.get(F.transform(F.array(bound(text, counts)), judged), F.lit(0))
    return {n: out[n] for n in ("n", "risk_score", "is_valid", "severity")}


def sdk_injection(text: Column, custom: tuple[str, ...] = (), jailbreaks: bool = True, role_play: bool = True) -> Verdict:
    """All matches of every pattern; one factor of high severity, its confidence .5 and .1 more for each match, to .9."""
    rows = [p for p in (*B.SDK_INJECTION, *custom) if (jailbreaks or "jailbreak" not in p and "DAN" not in p) and (role_play or not any(w in p for w in ("pretend", "roleplay", r"act\s+as")))]
    n = bound(text, lambda b: total([count(b.t, p, b.low) for p in rows]))
    out = let({"n": n}, lambda x: F.struct(*_risk(x, [(x.n, "high", F.least(F.lit(0.9), 0.5 + x.n * 0.1))])))
    return {k: out[k] for k in ("n", "risk_score", "is_valid", "severity")}


def hash_text(text: Column) -> Column:
    """The 32-bit rolling hash of a text's UTF-16 units, without its sign, in base 36."""
    units = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, u: F.pmod(h * 31 + u, F.lit(1 << 32))
    high, low = lambda c: F.floor((c - 0x10000) / 1024).cast("long") + 0xD800, lambda c: F.pmod(c - 0x10000, F.lit(1024)) + 0xDC00
    h = F.aggregate(units, F.lit(0).cast("long"), lambda h, c: F.when(c < 0x10000, step(h, c)).otherwise(step(step(h, high(c)), low(c))))
    return F.lower(F.conv(F.abs(F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)).cast("string"), 10, 36))
