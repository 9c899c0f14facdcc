"""Detector queries over ``documents``, and their SQL."""

from __future__ import annotations

from ..catalog import patterns as P
from ..operators import detectors as D
from .scan_oracles import docs, n_of, q
from .scan_queries import _documents

FULL = ["n", "risk_score", "confidence", "severity"]
#: Patterns that RE2 can't express: they look ahead or behind.
NO_SQL = ("basic-auth-decoded", "ssn-raw")
RULES = [
    {"category": "spam_misleading", "threshold": 0.5, "priority": 1, "action": "WARN"},
    {"category": "misinformation", "threshold": 0.5, "priority": 2, "action": "FLAG", "enabled": False},
    {"category": "harassment_bullying", "threshold": 0.9, "priority": 3, "action": "FLAG"},
]

QUERIES = {
    "detect_secrets": _documents("secrets", D.secrets, FULL),
    "detect_secrets_custom": _documents("secrets", lambda t: D.secrets(t, custom=[("member", r"\bmember-[0-9]{4}\b"), ("host", r"\bdb\.local\b")]), FULL),
    "detect_entropy": _documents("secrets", D.entropy_candidates, ["n", "confidence"]),
    "detect_credentials": _documents("secrets", lambda t: D.credentials(t, leave_out=NO_SQL), FULL),
    "detect_credentials_all": _documents("secrets", D.credentials, FULL),
    "detect_injection": _documents("injection", D.injection, [*FULL, "n_jailbreak", "n_role_manipulation"]),
    "detect_injection_unseeded": _documents(None, D.injection, FULL),
    "detect_moderation": _documents("moderation", D.moderation, [*FULL, "action"]),
    "detect_moderation_rules": _documents("moderation", lambda t: D.moderation(t, verified=True, rules=RULES), [*FULL, "action"]),
    "detect_safety": _documents("safety", D.safety, [*FULL, "action"]),
    "detect_abuse_text": _documents("abuse", D.abuse_text, ["n", "risk_score", "severity"]),
    "detect_pii_counts": _documents("pii", lambda t: D.pattern_counts(t, P.PII, NO_SQL), ["n_" + r[0].replace("-", "_") for r in P.PII if r[0] not in NO_SQL]),
}


def _counts(rows) -> str:
    return ", ".join(f"{n_of(r[-1])} AS c{i}" for i, r in enumerate(rows))


def _sum(items) -> str:
    return "(" + " + ".join(items or ["0"]) + ")"


def _worst(rows) -> str:
    whens = ""
    for s in ("critical", "high", "medium", "low"):
        if some := [f"c{i} > 0" for i, r in enumerate(rows) if r[2] == s]:
            whens += f" WHEN {' OR '.join(some)} THEN '{s}'"
    return f"CASE{whens} ELSE 'none' END"


def _leaks(rows, factor) -> str:
    """rows: (id, category, severity, confidence, ..., pattern)."""
    load = _sum([f"c{i} * {D.LEAK_WEIGHT[r[2]] * r[3] * 0.75 * factor(r)!r}::DOUBLE" for i, r in enumerate(rows)])
    sure = ", ".join(f"CASE WHEN c{i} > 0 THEN {r[3] * 0.75!r}::DOUBLE ELSE 0 END" for i, r in enumerate(rows))
    n = _sum([f"c{i}" for i in range(len(rows))])
    return f"""WITH {docs("secrets")}, c AS (SELECT doc_id, {_counts(rows)} FROM d)
SELECT doc_id, {n} AS n, round(CASE WHEN {n} > 0 THEN 1 - exp(-{load}) ELSE 0 END, 6)::DOUBLE AS risk_score, round(CASE WHEN {n} > 0 THEN greatest({sure}) ELSE 1 END, 6)::DOUBLE AS confidence, {_worst(rows)} AS severity FROM c"""


def _agent(family, rows, sensitivity, factor) -> str:
    """CTEs up to v: doc_id, n, risk, confidence, severity, n_<category>, sure_<category>."""
    shift = (sensitivity - 0.5) * factor
    adjust = lambda x: f"greatest(0, least(1, {x} + {shift!r}::DOUBLE))"
    kinds = list(dict.fromkeys(r[1] for r in rows))
    own = {k: [(i, r) for i, r in enumerate(rows) if r[1] == k] for k in kinds}
    per = []
    for k, rs in own.items():
        per += [f"{_sum([f'c{i}' for i, _ in rs])} AS n_{k}", f"greatest({', '.join(f'CASE WHEN c{i} > 0 THEN {r[2]!r}::DOUBLE ELSE 0 END' for i, r in rs)}, 0) AS worst_{k}"]
        per += [f"{_sum([f'c{i} * {r[3]!r}::DOUBLE' for i, r in rs])} AS load_{k}", f"greatest({', '.join(f'CASE WHEN c{i} > 0 THEN {min(1.0, max(0.0, r[3] + shift))!r}::DOUBLE ELSE 0 END' for i, r in rs)}, 0) AS sure_{k}"]
    points = _sum([f"CASE WHEN n_{k} > 0 THEN {adjust(f'worst_{k}')} * {adjust(f'load_{k} / n_{k}')} ELSE 0 END" for k in kinds])
    n, count = _sum([f"n_{k}" for k in kinds]), _sum([f"(n_{k} > 0)::INT" for k in kinds])
    load = _sum([f"load_{k}" for k in kinds])
    bands = "CASE " + " ".join(f"WHEN risk >= {a} - 1e-6 THEN '{s}'" for a, s in D.SCORE_BANDS) + " ELSE 'none' END"
    return f"""WITH {docs(family)}, c AS (SELECT doc_id, {_counts(rows)} FROM d), k AS (SELECT doc_id, {", ".join(per)} FROM c),
r AS (SELECT *, {n} AS n, CASE WHEN {n} > 0 THEN least(1, {points} / {count}) * {0.5 + 0.5 * sensitivity!r}::DOUBLE ELSE 0 END AS risk, CASE WHEN {n} > 0 THEN {adjust(f"({load} / {n} + least(0.2::DOUBLE, {n} * 0.02::DOUBLE))")} ELSE 1 END AS confidence FROM k),
v AS (SELECT *, {bands} AS severity FROM r)"""


_SHOWN = "doc_id, n::BIGINT AS n, round(risk, 6)::DOUBLE AS risk_score, round(confidence, 6)::DOUBLE AS confidence"


def _critical(names) -> str:
    return f"CASE WHEN {_sum([f'n_{k}' for k in names])} > 0 THEN 'critical' ELSE severity END AS severity"


def _at_least(names) -> str:
    return "(" + " OR ".join(f"sure_{k} >= 0.8 - 1e-6" for k in names) + ")"


_pairs = [r for r in P.CREDENTIALS if r[0] not in NO_SQL]
_custom = P.SECRETS + [("member", "custom", "medium", 0.7, r"\bmember-[0-9]{4}\b"), ("host", "custom", "medium", 0.7, r"\bdb\.local\b")]
_injection = D._both_cases(P.INJECTION)
_mod = list(dict.fromkeys(r[1] for r in P.MODERATION))
_others = _sum([f"n_{k}" for k in _mod if k not in D.MODERATION_ADULT])
_abuse = [r for r in P.ABUSE if r[3] >= 0.7 - 1e-6]
_H = "list_sum(list_transform(map_values(list_aggregate(string_split(x, ''), 'histogram')), lambda c: -(c::DOUBLE / length(x)) * log2(c::DOUBLE / length(x))))"

ORACLES = {
    "detect_secrets": _leaks(P.SECRETS, lambda r: 1.0),
    "detect_secrets_custom": _leaks(_custom, lambda r: 1.0),
    "detect_credentials": _leaks(_pairs, lambda r: 1.5 if r[4] else 1.0),
    "detect_entropy": f"""WITH {docs("secrets")}, c AS (SELECT doc_id, list_distinct(flatten([{", ".join(f"regexp_extract_all(text, {q(p)}, 1)" for p in D.ENTROPY_CONTEXTS)}])) AS v FROM d),
s AS (SELECT doc_id, list_filter(list_transform(v, lambda x: {_H}), lambda h: h >= 4.5 - 1e-6) AS h FROM c)
SELECT doc_id, len(h) AS n, round(coalesce((0.5::DOUBLE + 0.4::DOUBLE * (list_max(h) - 4.5::DOUBLE) / 3.5::DOUBLE) * 0.75::DOUBLE, 0), 6)::DOUBLE AS confidence FROM s""",
    "detect_injection": _agent("injection", _injection, 0.5, 0.4) + f" SELECT {_SHOWN}, severity, n_jailbreak::BIGINT AS n_jailbreak, n_role_manipulation::BIGINT AS n_role_manipulation FROM v",
    "detect_injection_unseeded": _agent(None, _injection, 0.5, 0.4) + f" SELECT {_SHOWN}, severity FROM v",
    "detect_moderation": _agent("moderation", P.MODERATION, 0.7, 0.6) + f" SELECT {_SHOWN}, {_critical(D.MODERATION_CRITICAL)}, CASE WHEN n = 0 THEN 'ALLOW' WHEN confidence < 0.8 - 1e-6 THEN 'FLAG' WHEN {_at_least(D.MODERATION_CRITICAL)} THEN 'BLOCK' WHEN {_at_least(D.MODERATION_ADULT)} THEN 'AGE_GATE' ELSE 'BLOCK' END AS action FROM v",
    "detect_moderation_rules": _agent("moderation", P.MODERATION, 0.7, 0.6) + f" SELECT {_SHOWN}, {_critical(D.MODERATION_CRITICAL)}, CASE WHEN n = 0 THEN 'ALLOW' WHEN confidence < 0.8 - 1e-6 THEN 'FLAG' WHEN {_at_least(D.MODERATION_CRITICAL)} THEN 'BLOCK' WHEN {_at_least(D.MODERATION_ADULT)} AND {_others} = 0 THEN 'WARN' WHEN n_spam_misleading > 0 AND sure_spam_misleading >= 0.5 - 1e-6 THEN 'WARN' WHEN n_harassment_bullying > 0 AND sure_harassment_bullying >= 0.9 - 1e-6 THEN 'FLAG' ELSE 'BLOCK' END AS action FROM v",
    "detect_safety": _agent("safety", P.SAFETY, 0.7, 0.6) + f" SELECT {_SHOWN}, {_critical(D.SAFETY_CRITICAL)}, CASE WHEN n = 0 THEN 'ALLOW' WHEN confidence < 0.8 - 1e-6 THEN 'AUDIT' WHEN {_at_least(D.SAFETY_CRITICAL)} THEN 'BLOCK' ELSE 'BLOCK' END AS action FROM v",
    "detect_abuse_text": f"WITH {docs('abuse')}, c AS (SELECT doc_id, {_counts(_abuse)} FROM d) SELECT doc_id, {_sum([f'c{i}' for i in range(len(_abuse))])} AS n, least(1, round({_sum([f'c{i} * {D.ABUSE_WEIGHT[r[2]] * r[3]!r}::DOUBLE' for i, r in enumerate(_abuse)])}, 2))::DOUBLE AS risk_score, {_worst(_abuse)} AS severity FROM c",
    "detect_pii_counts": f"WITH {docs('pii')} SELECT doc_id, {', '.join(f'{n_of(r[-1])} AS n_' + r[0].replace('-', '_') for r in P.PII if r[0] not in NO_SQL)} FROM d",
}
