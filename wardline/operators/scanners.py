"""Scanners: pure functions from a text column to named verdict columns.

Each returns a dict with ``risk_score`` (0 to 1) and ``is_valid`` among its columns, and what it measured.  A
null text has no risk: it is valid, or null where a scanner measures it.  Lists and weights are in :mod:`wardline.catalog.lexicon`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import lexicon as L
from ..functions.phrases import phrases_masked
from ..functions.text import EPSILON, band, best_weight, bound, count, extract, found, has, hits, let, once, text_entropy, total, with_fields, words

Verdict = dict[str, Column]


def with_verdict(df: DataFrame, verdict: Verdict, prefix: str = "") -> DataFrame:
    return with_fields(df, verdict, prefix)


def _binary(bad: Column, risk: Column | float = 1.0) -> Verdict:
    return {"risk_score": F.when(bad, risk).otherwise(0.0), "is_valid": ~bad}


def token_limit(text: Column, limit: int = 4096) -> Verdict:
    n = F.ceil(F.octet_length(text) / 4.0).cast("long")
    return {"token_count": n, "overflow": F.greatest(n - limit, F.lit(0))} | _binary(n > limit)


def _escaped(phrase: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in phrase)


#: Lists of more phrases are looked for by an automaton, shorter ones by patterns, with the same results.
FEW_PHRASES = 8


def _banned(text: Column, phrases: list[str], marks: list[str], whole_words: bool) -> Verdict:
    if not any(phrases):
        return {"matches_count": F.when(text.isNotNull(), F.lit(0)), "sanitized": text} | _binary(F.lit(False))
    if len(phrases) > FEW_PHRASES:
        found = phrases_masked(text, phrases, marks, whole_words=whole_words)
        return once(found, lambda x: {"matches_count": x.n, "sanitized": x.clean} | _binary(x.n > 0))
    around = (r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])") if whole_words else ("", "")
    one = lambda p: f"(?i){around[0]}{_escaped(p)}{around[1]}"
    some = [(p, m) for p, m in zip(phrases, marks) if p]
    n = F.regexp_count(text, F.lit(f"(?i){around[0]}(?:{'|'.join(_escaped(p) for p, _ in sorted(some, key=lambda x: len(x[0])))}){around[1]}"))
    clean = reduce(lambda t, x: F.regexp_replace(t, one(x[0]), x[1].replace("$", "\\$")), some, text)
    return {"matches_count": n, "sanitized": clean} | _binary(n > 0)


def ban_substrings(text: Column, phrases: list[str], whole_words: bool = False, mark: str = "*") -> Verdict:
    """Case-blind literals; whole words have no letter or digit beside them.  sanitized: each replaced by as many marks, in the order of the list.

    Matches don't overlap: the leftmost count, of those with one start the shortest.
    """
    return _banned(text, phrases, [mark * len(p) for p in phrases], whole_words)


def ban_competitors(text: Column, names: list[str], mark: str = "[COMPETITOR]") -> Verdict:
    """Whole names in any case; sanitized: each replaced by the mark."""
    return _banned(text, names, [mark] * len(names), True)


def regex_scan(text: Column, patterns: list[tuple[str, str, float]]) -> Verdict:
    """(name, pattern, risk): all matches counted, the greatest risk of a pattern found."""
    risk = F.greatest(F.lit(0.0), F.lit(0.0), *[F.when(found(text, p), F.lit(r)).otherwise(0.0) for _, p, r in patterns])
    return {"matches": total([count(text, p) for _, p, _ in patterns]), "risk_score": risk, "is_valid": risk <= 0}


def regex_output(text: Column, patterns: list[str], allow: bool = False) -> Verdict:
    """Deny: any match is invalid at .9.  Allow: none is invalid at .8."""
    n = total([count(text, p) for p in patterns])
    return {"matches": n} | (_binary(n == 0, F.lit(0.8)) if allow else _binary(n > 0, F.lit(0.9)))


# The code patterns.
CODE_PATTERNS = {
    "n_fence": r"```[\s\S]*?```|`[^`]+`",
    "n_func": r"\b(def|function|fn|func)\s+\w+\s*\(",
    "n_import": r"\b(import|from|#include|require|use)\s+[\w.]+",
    "n_var": r"\b(let|const|var|int|String|float|double)\s+\w+\s*=",
}


def code_counts(text: Column) -> Verdict:
    n = {k: count(text, p) for k, p in CODE_PATTERNS.items()}
    return n | _binary(total(list(n.values())) > 0)


ZERO_WIDTH, DIRECTION, CONTROL = "[\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}\\x{2060}\\x{180E}]", "[\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]", "[\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}\\x{7F}-\\x{9F}]"


def invisible_text(text: Column, threshold: float = 0.1) -> Verdict:
    z, d, c = (F.regexp_count(text, F.lit(p)) for p in (ZERO_WIDTH, DIRECTION, CONTROL))
    n = z + d + c
    mean = (z * 1.0 + d * 0.7 + c * 0.9) / F.greatest(n, F.lit(1))
    risk = F.when(n > 0, F.least(F.lit(1.0), 0.7 * n / F.greatest(F.octet_length(text), F.lit(1)) + 0.3 * mean)).otherwise(0.0)
    clean = F.regexp_replace(text, f"{ZERO_WIDTH}|{DIRECTION}|{CONTROL}", "")
    bad = risk >= threshold - EPSILON
    return {"n_zero_width": z, "n_direction": d, "n_control": c, "risk_score": risk, "is_valid": ~bad, "severity": F.when(bad, band(risk, [(0.7, "high"), (0.4, "medium")], "low")).otherwise("none"), "sanitized": clean}


def gibberish(text: Column, threshold: float = 0.7, min_bytes: int = 10) -> Verdict:
    """Weighted mean of letter entropy, repetition, vowel share, keyboard runs and word shape."""
    letters = F.regexp_replace(F.lower(text), r"[^\p{IsAlphabetic}]+", "")
    runs = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)(.)\1{2,}"), F.lit(0)), lambda r: 0.1 * (F.length(r) - 2) * (F.length(r) - 1))
    shaped = F.transform(words(text), lambda w: F.regexp_replace(w, r"[^\p{IsAlphabetic}]+", ""))
    odd = lambda ws: F.size(F.filter(ws, lambda w: (F.octet_length(w) >= 2) & (w.rlike("[^aeiouAEIOU]{5,}") | ((F.octet_length(w) > 3) & ~w.rlike("[aeiouAEIOU]")))))
    measured = let(
        {"l": letters, "e": text_entropy(letters), "w": shaped, "r": F.aggregate(runs, F.lit(0.0), lambda a, x: a + x), "bytes": F.octet_length(text), "m": bound(text, lambda b: hits(b.low, L.GIBBERISH_MASHING))},
        lambda x: F.struct(F.least(x.e / 4.7, F.lit(1.0)).alias("e"), F.regexp_count(x.l, F.lit("[aeiou]")).cast("double").alias("v"), F.length(x.l).alias("n"), odd(x.w).alias("o"), F.size(x.w).alias("k"), x.r.alias("r"), x.bytes.alias("bytes"), x.m.alias("m")),
    )

    def scored(x):
        ratio = x.v / x.n
        parts = {
            "entropy_score": (F.when(x.e > 0.85, (x.e - 0.85) / 0.15).otherwise(0.0), 2.0),
            "repetition": (F.when(x.bytes >= 3, F.least(F.lit(1.0), x.r / x.bytes)).otherwise(0.0), 1.5),
            "vowel_score": (F.when(x.n == 0, 0.0).when((ratio < 0.15) | (ratio > 0.6), F.least(F.lit(1.0), F.abs(ratio - 0.4) / 0.4)).otherwise(0.0), 1.5),
            "mashing": (F.least(F.lit(1.0), F.coalesce(x.m, F.lit(0)) / 5.0), 2.0),
            "word_score": (F.when(x.k > 0, x.o.cast("double") / x.k).otherwise(0.0), 1.5),
        }
        mean = reduce(lambda a, b: a + b, [s * w for s, w in parts.values()]) / sum(w for _, w in parts.values())
        return F.struct(*(s.alias(n) for n, (s, _) in parts.items()), F.when(x.bytes < min_bytes, 0.0).otherwise(mean).alias("risk_score"))

    names = ["entropy_score", "repetition", "vowel_score", "mashing", "word_score", "risk_score"]
    return once(F.get(F.transform(F.array(measured), scored), F.lit(0)), lambda x: {n: x[n] for n in names} | {"is_valid": x.risk_score < threshold - EPSILON})


SCRIPTS = {"ru": ("[А-яЁё]", 2), "ar": ("[\\x{0600}-\\x{06FF}]", 2), "zh": ("[\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}]", 3), "hi": ("[\\x{0900}-\\x{097F}]", 2)}


def language(text: Column, allowed: tuple[str, ...] = ("en",), min_confidence: float = 0.7, min_bytes: int = 10) -> Verdict:
    """Script histogram, then indicator words for Latin script."""
    codes = ("es", "fr", "de", "pt", "it")
    measures = {"n": F.regexp_count(text, F.lit(r"\p{IsAlphabetic}")), "latin": F.regexp_count(text, F.lit("[A-Za-zÀ-ÿ]")), "bytes": F.octet_length(text)}
    measures |= {f"k_{c}": F.regexp_count(text, F.lit(p)) for c, (p, _) in SCRIPTS.items()}
    measures["hits"] = bound(text, lambda b: F.struct(*(hits(b.low, getattr(L, f"LANGUAGE_{c.upper()}")).alias(c) for c in codes)))

    def judged(x):
        most = F.greatest(*(x.hits[c] for c in codes))
        latin = F.when(most < 2, "en")
        for c in codes:
            latin = latin.when(x.hits[c] == most, c)
        code, sure = F.when(x.n == 0, "unknown"), F.when(x.n == 0, 0.0)
        for c, (_, part) in SCRIPTS.items():
            yes = x[f"k_{c}"] > F.floor(x.n / part)
            code, sure = code.when(yes, c), sure.when(yes, x[f"k_{c}"] / x.n)
        yes = x.latin > F.floor(x.n / 2)
        return F.struct(F.when(F.coalesce(x.bytes, F.lit(0)) < min_bytes, "short").otherwise(code.when(yes, latin).otherwise("unknown")).alias("code"), sure.when(yes, x.latin / x.n).otherwise(0.3).alias("confidence"))

    def told(x):
        code, confidence = x["code"], x["confidence"]
        short, sure = code == "short", confidence >= min_confidence - EPSILON
        ok = code.isin(*allowed) if allowed else F.lit(True)
        return {"code": code, "confidence": confidence, "is_valid": short | ~sure | ok, "risk_score": F.when(short, 0.0).when(~sure, confidence * 0.5).when(ok, 0.0).otherwise(1.0)}

    return once(let(measures, judged), told)


def _indicated(x: Column, threshold: float) -> Verdict:
    bad = x["score"] >= threshold - EPSILON
    return {"n_indicators": x["n"], "risk_score": F.when(bad, x["score"]).otherwise(0.0), "is_valid": ~bad, "severity": F.when(bad, band(x["score"], [(0.9, "critical"), (0.7, "high")], "medium")).otherwise("none")}


def prompt_injection(text: Column, threshold: float = 0.7) -> Verdict:
    families = [(L.PROMPT_INJECTION_OVERRIDE, 0.95), (L.PROMPT_INJECTION_ROLEPLAY, 0.8), (L.PROMPT_INJECTION_CONTEXT, 0.75), (L.PROMPT_INJECTION_EXTRACTION, 0.9)]

    def measured(b):
        low, t = b.low, b.t
        fence = ((has(low, "```") | has(low, "---") | has(low, "===")) & (has(low, "ignore") | has(low, "system"))).cast("int")
        spread = (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) > 10) | ((F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))) / F.greatest(F.octet_length(t), F.lit(1)) > 0.5)
        return F.struct(*(hits(low, p).alias(f"h{i}") for i, (p, _) in enumerate(families)), fence.alias("fence"), spread.alias("spread"))

    def judged(x):
        first = total([x[f"h{i}"] for i in range(len(families))]) + x.fence
        more = x.spread & (first > 0)
        n = first + more.cast("int")
        points = reduce(lambda a, b: a + b, [x[f"h{i}"] * w for i, (_, w) in enumerate(families)]) + x.fence * 0.7 + F.when(more, 0.6).otherwise(0.0)
        return F.struct(n.alias("n"), F.when(n > 0, points / n).otherwise(0.0).alias("score"))

    return once(F.get(F.transform(F.array(bound(text, measured)), judged), F.lit(0)), lambda x: _indicated(x, threshold))


def toxicity(text: Column, threshold: float = 0.7, compat: bool = True) -> Verdict:
    """compat: censored words lose their asterisks before they are looked for; else an asterisk stands for a letter."""

    def measured(b):
        low = b.low
        severe = total([(has(low, p.replace("*", "")) if compat else found(low, r"\b" + p.replace("*", r"\w") + r"\b")).cast("int") for p in L.TOXICITY_SEVERE])
        return F.struct(severe.alias("severe"), *(hits(low, p).alias(k) for k, p in (("insults", L.TOXICITY_INSULTS), ("threats", L.TOXICITY_THREATS), ("hate", L.TOXICITY_IDENTITY_HATE))))

    def judged(x):
        score = F.greatest(
            F.when(x.severe > 0, 0.95).otherwise(0.0),
            F.when(x.insults > 0, F.least(F.lit(0.9), 0.6 + 0.1 * x.insults)).otherwise(0.0),
            F.when(x.threats > 0, 0.9).otherwise(0.0),
            F.when(x.hate > 0, F.least(F.lit(0.95), 0.7 + 0.1 * x.hate)).otherwise(0.0),
        )
        return F.struct((x.severe + x.insults + x.threats + x.hate).alias("n"), score.alias("score"))

    return once(F.get(F.transform(F.array(bound(text, measured)), judged), F.lit(0)), lambda x: _indicated(x, threshold))


def sentiment(text: Column, allowed: tuple[str, ...] = ("positive", "neutral")) -> Verdict:
    among = lambda w, items: F.size(F.filter(w, lambda x: x.isin(*items)))
    counts = let({"w": words(F.lower(text))}, lambda x: F.struct(among(x.w, L.SENTIMENT_POSITIVE).alias("p"), among(x.w, L.SENTIMENT_NEGATIVE).alias("n"), (among(x.w, L.SENTIMENT_NEGATION) > 0).alias("turned")))
    p, n = counts["p"], counts["n"]
    plus, both = F.when(counts["turned"], n).otherwise(p), p + n
    share = plus / both
    label = F.when(both == 0, "neutral").when(share > 0.6, "positive").when(1 - share > 0.6, "negative").otherwise("neutral")
    confidence = F.when(label == "positive", 0.7 + 0.3 * share).when(label == "negative", 0.7 + 0.3 * (1 - share)).otherwise(0.6)
    ok = label.isin(*allowed)
    return {"label": label, "confidence": confidence, "is_valid": ok, "risk_score": F.when(ok, 0.0).otherwise(confidence)}


TOPICS = {"violence": L.BAN_TOPICS_VIOLENCE, "illegal_drugs": L.BAN_TOPICS_ILLEGAL_DRUGS, "self_harm": L.BAN_TOPICS_SELF_HARM, "hate_speech": L.BAN_TOPICS_HATE_SPEECH}


def ban_topics(text: Column, topics: dict[str, list[str]] = TOPICS, threshold: float = 0.6) -> Verdict:
    """Keyword hits (not overlapping) by topic, ten times their share of the words."""
    low, n = F.lower(text), F.greatest(F.size(words(text)), F.lit(1))
    share = {t: F.least(F.lit(1.0), F.coalesce(total([F.regexp_count(low, F.lit(_escaped(k))) for k in ks]), F.lit(0)) / n * 10) for t, ks in topics.items()}
    kept = {t: F.when(s >= threshold - EPSILON, s).otherwise(0.0) for t, s in share.items()}
    risk = F.greatest(F.lit(0.0), *kept.values())
    return {"n_topics": total([(k > 0).cast("int") for k in kept.values()]), "risk_score": risk, "is_valid": risk <= 0}


BIAS = {"gender": L.BIAS_GENDER, "racial": L.BIAS_RACIAL, "age": L.BIAS_AGE, "religious": L.BIAS_RELIGIOUS, "political": L.BIAS_POLITICAL, "socioeconomic": L.BIAS_SOCIOECONOMIC, "disability": L.BIAS_DISABILITY}


def bias(text: Column, kinds: tuple[str, ...] = ("gender", "racial", "age", "religious"), threshold: float = 0.6) -> Verdict:
    phrases = [(p, w) for k in kinds for p, w in BIAS[k] if w >= threshold]
    out = bound(text, lambda b: F.struct(hits(b.low, phrases).alias("n"), best_weight(b.low, phrases).alias("risk")))
    return once(out, lambda x: {"n": x.n, "risk_score": x.risk, "is_valid": x.risk <= 0, "severity": F.when(x.risk <= 0, "none").otherwise(band(x.risk, [(0.85, "high"), (0.7, "medium")], "low"))})


def factuality(text: Column, threshold: float = 0.5) -> Verdict:
    """Penalties in list order, each shrunk by .8 for every phrase found before it."""
    phrases = L.FACTUALITY_HEDGING + L.FACTUALITY_SPECULATION + L.FACTUALITY_UNCERTAINTY

    def measured(b):
        penalties = F.filter(F.array(*[F.when(has(b.low, p), F.lit(w)) for p, w in phrases]), lambda x: x.isNotNull())
        loss = F.aggregate(penalties, F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("f")), lambda a, x: F.struct((a.s + x * a.f).alias("s"), (a.f * 0.8).alias("f")), lambda a: a.s)
        return F.struct(F.size(penalties).alias("n"), F.greatest(F.lit(0.0), 1 - loss).alias("score"))

    def told(x):
        bad = x.score < threshold - EPSILON
        return {"n": x.n, "score": x.score, "risk_score": F.when(bad, 1 - x.score).otherwise(0.0), "is_valid": ~bad, "severity": F.when(~bad, "none").when(x.score < 0.3 - EPSILON, "high").otherwise("medium")}

    return once(bound(text, measured), told)


def no_refusal(text: Column, threshold: float = 0.7, strict: bool = False, loose: bool = False) -> Verdict:
    def measured(b):
        low = b.low
        cannot = has(low, "cannot") | has(low, "can't")
        parts = [best_weight(low, L.NO_REFUSAL_DIRECT), F.when(cannot | has(low, "won't") | has(low, "shouldn't"), best_weight(low, L.NO_REFUSAL_SAFETY)).otherwise(0.0)]
        if not loose:
            parts.append(best_weight(low, L.NO_REFUSAL_CAPABILITY))
        if strict:
            parts.append(F.when((has(low, "sorry") | has(low, "apologize")) & (cannot | has(low, "unable")), 0.7).otherwise(0.0))
        return F.struct(F.greatest(F.lit(0.0), *parts).alias("score"))

    def told(x):
        bad = x.score >= threshold - EPSILON
        return {"risk_score": F.when(bad, x.score).otherwise(0.0), "is_valid": ~bad, "severity": F.when(bad, band(x.score, [(0.9, "high"), (0.7, "medium")], "low")).otherwise("none")}

    return once(bound(text, measured), told)


URL = r'https?://[^\s<>"]+|www\.[^\s<>"]+'


def url_threat(url: Column, blocked: tuple[str, ...] = ()) -> Column:
    """How suspicious one address is, 0 to 1."""
    low = F.lower(url)
    any_of = lambda items, test=F.contains: reduce(lambda a, b: a | b, [test(low, F.lit(x)) for x in items], F.lit(False))
    rules = [
        (any_of([b.lower() for b in blocked]), 0.95),
        (any_of(L.URL_SUSPICIOUS_TLDS), 0.75),
        (low.rlike(r"https?://(?:[0-9]{1,3}\.){3}[0-9]{1,3}"), 0.8),
        (F.length(url) - F.length(F.replace(url, F.lit("%"), F.lit(""))) > 5, 0.7),
        (has(low, "xn--"), 0.75),
        (has(url, "@"), 0.85),
        (hits(low, L.URL_PHISHING_WORDS) >= 2, 0.8),
        (F.length(low) - F.length(F.replace(low, F.lit("."), F.lit(""))) > 5, 0.7),
        (any_of(L.URL_DANGEROUS_EXTENSIONS, F.endswith), 0.85),
        (any_of(L.URL_SHORTENERS), 0.6),
    ]
    return F.greatest(*[F.when(c, w).otherwise(0.0) for c, w in rules])


def malicious_urls(text: Column, blocked: tuple[str, ...] = (), threshold: float = 0.6) -> Verdict:
    threats = F.filter(F.transform(extract(text, URL), lambda u: url_threat(u, blocked)), lambda s: s >= threshold - EPSILON)
    out = let({"t": threats}, lambda x: F.struct(F.size(x.t).alias("n"), F.coalesce(F.array_max(x.t), F.lit(0.0)).alias("risk")))
    return once(out, lambda x: {"n_threats": x.n, "risk_score": x.risk, "is_valid": x.risk <= 0, "severity": F.when(x.risk <= 0, "none").otherwise(band(x.risk, [(0.85, "high"), (0.7, "medium")], "low"))})


def url_reachability(text: Column, max_urls: int = 10) -> Verdict:
    """Share of the first addresses that don't parse; nothing is fetched."""
    urls = F.slice(extract(text, r'https?://[^\s<>"]+'), 1, max_urls)
    bad = F.size(F.filter(urls, lambda u: F.try_parse_url(u, F.lit("HOST")).isNull()))
    risk = F.when(F.size(urls) > 0, bad / F.size(urls)).otherwise(0.0)
    return {"n_urls": F.size(urls), "risk_score": risk, "is_valid": bad == 0}


def reading_time(text: Column, most: int = 300, least: int = 5, wpm: int = 200) -> Verdict:
    n = F.size(words(text))
    seconds = F.floor(n / float(wpm) * 60)
    return {"words": n, "chars": F.length(F.regexp_replace(text, r"\s+", "")), "sentences": F.greatest(F.regexp_count(text, F.lit("[.!?]")), F.lit(1)), "seconds": seconds, "is_valid": seconds.between(least, most), "risk_score": F.when(seconds < least, 0.7).when(seconds > most, 0.8).otherwise(0.0)}


def keywords(text: Column) -> Column:
    bare = F.transform(words(F.lower(text)), lambda w: F.regexp_replace(w, r"[^\p{IsAlphabetic}\p{N}]+", ""))
    return F.array_distinct(F.filter(bare, lambda w: (F.octet_length(w) >= 3) & ~w.isin(*L.RELEVANCE_STOP_WORDS)))


def relevance(prompt: Column, output: Column, threshold: float = 0.5) -> Verdict:
    """Jaccard similarity of the keywords, halved for an evasive output."""
    a, b, low = keywords(prompt), keywords(output), F.lower(output)
    common = F.size(F.array_intersect(a, b))
    evasive = F.greatest(best_weight(low, L.RELEVANCE_GENERIC), F.when((F.size(words(output)) < 10) & (hits(low, L.RELEVANCE_GENERIC) == 0), 0.6).otherwise(0.0))
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    generic = ~empty & (evasive > 0.7 + EPSILON)
    share = common / F.size(F.array_union(a, b))
    score = F.when(empty, 0.5).when(generic, share * 0.5).otherwise(share)
    ok = (score >= threshold - EPSILON) & ~generic
    return {"overlap": F.when(empty, 0).otherwise(common), "score": score, "is_generic": generic, "is_valid": ok, "risk_score": F.when(ok, 0.0).otherwise(1 - score)}


# The entity patterns of outputs.
SENSITIVE = {
    "n_email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "n_phone": r"(\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "n_ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "n_url": URL,
    "n_bank": r"\b\d{8,17}\b",
    "n_date": r"\b(?:\d{1,2}[-/]\d{1,2}[-/]\d{4}|\d{4}[-/]\d{1,2}[-/]\d{1,2})\b",
    "n_name": r"\b[A-Z][a-z]+ [A-Z][a-z]+\b",
}
CARD, IPV4 = r"\b(?:\d{4}[-\s]?){3}\d{4}\b", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"


def luhn_ok(number: Column) -> Column:
    digits = F.regexp_replace(number, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def octets_ok(ip: Column) -> Column:
    return F.forall(F.split(ip, r"\."), lambda o: o.cast("int") <= 255)


#: Where a pattern of SENSITIVE that begins with an option may begin at all.
_BEGINS = {"n_phone": "(?=[+(0-9])"}


def sensitive(text: Column) -> Verdict:
    def measured(b):
        digit = b.t.rlike("[0-9]")
        n = {k: count(b.t, _BEGINS.get(k, "") + p, b.low) for k, p in SENSITIVE.items()}
        n |= {k: F.when(digit, n[k]).otherwise(F.when(digit.isNotNull(), F.lit(0))) for k in ("n_phone", "n_ssn", "n_bank", "n_date")}
        n["n_card"] = F.when(digit, F.size(F.filter(extract(b.t, CARD), luhn_ok))).otherwise(F.when(digit.isNotNull(), F.lit(0)))
        n["n_ip"] = F.when(digit, F.size(F.filter(extract(b.t, IPV4), octets_ok))).otherwise(F.when(digit.isNotNull(), F.lit(0)))
        return F.struct(*(c.alias(k) for k, c in n.items()))

    bad = lambda x: total([x[k] for k in ("n_email", "n_phone", "n_card", "n_ssn", "n_ip")]) > 0
    return once(bound(text, measured), lambda x: {k: x[k] for k in (*SENSITIVE, "n_card", "n_ip")} | _binary(bad(x), F.lit(0.9)))


def mini_scans(text: Column) -> Verdict:
    """The three one-line scanners of the browser build."""
    low = F.lower(text)
    pii = (has(text, "@") & has(text, ".")) | (F.regexp_count(text, F.lit("[0-9]")) >= 10)
    toxic = has(low, "hate") | has(low, "kill") | has(low, "destroy")
    return {"injection": F.when(has(low, "ignore previous instructions"), 0.9).otherwise(0.0), "pii": F.when(pii, 0.7).otherwise(0.0), "toxicity": F.when(toxic, 0.8).otherwise(0.0)}


__all__ = [n for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")]
