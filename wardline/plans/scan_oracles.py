"""DuckDB SQL with the rows of :mod:`wardline.plans.scan_queries`."""

from __future__ import annotations

from ..catalog import lexicon as L
from ..functions.text import shared
from ..operators.scanners import BIAS, CARD, CODE_PATTERNS, IPV4, SENSITIVE, TOPICS, URL
from .scan_queries import BANNED, COMPETITORS, RULES
from .seeds import PHRASES, seeded_sql


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def n_of(pattern: str, t: str = "text") -> str:
    return f"len(regexp_extract_all({t}, {q(shared(pattern))}))"


def hits(phrases, t: str = "low") -> str:
    return "(" + " + ".join(f"contains({t}, {q(p if isinstance(p, str) else p[0])})::INT" for p in phrases) + ")"


def best(pairs, t: str = "low") -> str:
    return "greatest(0::DOUBLE, " + ", ".join(f"CASE WHEN contains({t}, {q(p)}) THEN {w}::DOUBLE ELSE 0 END" for p, w in pairs) + ")"


def bands(score: str, cuts, rest: str) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {a} - 1e-6 THEN '{n}'" for a, n in cuts) + f" ELSE '{rest}' END"


def docs(family: str | None, with_lang: bool = False) -> str:
    text = seeded_sql(family) if family else "text"
    return f"d AS (SELECT doc_id, {'lang, ' if with_lang else ''}text, lower(text) AS low FROM (SELECT doc_id, {'lang, ' if with_lang else ''}{text} AS text FROM documents))"


WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
LWORDS = r"list_filter(regexp_split_to_array(low, '\s+'), lambda x: x <> '')"


def lit_list(items) -> str:
    return "[" + ", ".join(map(q, items)) + "]"


def verdict(score: str, threshold: float, cuts, rest: str, extra: str = "") -> str:
    return f"SELECT doc_id, {extra} round(CASE WHEN {score} >= {threshold} - 1e-6 THEN {score} ELSE 0 END, 6) AS risk_score, {score} < {threshold} - 1e-6 AS is_valid, CASE WHEN {score} >= {threshold} - 1e-6 THEN {bands(score, cuts, rest)} ELSE 'none' END AS severity FROM s"


HIGH = [(0.9, "critical"), (0.7, "high")]
ORACLES: dict[str, str] = {}

ORACLES["scan_token_limit"] = "SELECT doc_id, ceil(strlen(text) / 4.0)::BIGINT AS token_count, greatest(ceil(strlen(text) / 4.0)::BIGINT - 512, 0) AS overflow, ceil(strlen(text) / 4.0) <= 512 AS is_valid FROM documents"

_clean = "text"
for _p in BANNED:
    _clean = f"regexp_replace({_clean}, {q('(?i)' + _p)}, {q('*' * len(_p))}, 'g')"
_any = "(?i)" + "|".join(sorted(BANNED, key=len))
ORACLES["scan_ban_substrings"] = f"SELECT doc_id, {n_of(_any)} AS matches_count, {n_of(_any)} = 0 AS is_valid, sha256({_clean}) AS sanitized FROM documents"

_whole = f"len(list_filter(regexp_split_to_array(low, '[^\\p{{L}}\\p{{N}}]+'), lambda x: list_contains({lit_list(COMPETITORS)}, x)))"
ORACLES["scan_ban_substrings_word"] = f"WITH {docs(None)} SELECT doc_id, {_whole} AS matches_count, {_whole} = 0 AS is_valid FROM d"
ORACLES["scan_ban_competitors"] = f"WITH {docs(None)} SELECT doc_id, {_whole} AS matches_count, {_whole} = 0 AS is_valid, ({_whole} > 0)::INT::DOUBLE AS risk_score FROM d"

_sum = " + ".join(n_of(p) for _, p, _ in RULES)
_risk = "greatest(0, " + ", ".join(f"CASE WHEN regexp_matches(text, {q(p)}) THEN {r}::DOUBLE ELSE 0 END" for _, p, r in RULES) + ")"
ORACLES["scan_regex_input"] = f"SELECT doc_id, {_sum} AS matches, {_risk}::DOUBLE AS risk_score, {_risk} <= 0 AS is_valid FROM documents"
ORACLES["scan_regex_deny"] = f"SELECT doc_id, {_sum} AS matches, CASE WHEN {_sum} > 0 THEN 0.9::DOUBLE ELSE 0 END AS risk_score, {_sum} = 0 AS is_valid FROM documents"
ORACLES["scan_regex_allow"] = f"SELECT doc_id, {_sum} AS matches, CASE WHEN {_sum} = 0 THEN 0.8::DOUBLE ELSE 0 END AS risk_score, {_sum} > 0 AS is_valid FROM documents"

_code = {k: n_of(p) for k, p in CODE_PATTERNS.items()}
ORACLES["scan_ban_code_counts"] = f"WITH {docs('code')} SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _code.items())}, ({' + '.join(_code.values())}) = 0 AS is_valid FROM d"

_z, _d, _c = r"[\x{200B}\x{200C}\x{200D}\x{FEFF}\x{2060}\x{180E}]", r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{7F}-\x{9F}]"
ORACLES["scan_invisible"] = f"""WITH {docs("invisible")}, c AS (SELECT doc_id, text, {n_of(_z)} AS z, {n_of(_d)} AS m, {n_of(_c)} AS k FROM d),
s AS (SELECT *, CASE WHEN z + m + k > 0 THEN least(1, 0.7::DOUBLE * (z + m + k) / strlen(text) + 0.3::DOUBLE * (z + m * 0.7::DOUBLE + k * 0.9::DOUBLE) / (z + m + k)) ELSE 0 END AS r FROM c)
SELECT doc_id, z AS n_zero_width, m AS n_direction, k AS n_control, round(r, 6) AS risk_score, r < 0.1 - 1e-6 AS is_valid,
CASE WHEN r < 0.1 - 1e-6 THEN 'none' ELSE {bands("r", [(0.7, "high"), (0.4, "medium")], "low")} END AS severity, sha256(regexp_replace(text, {q(_z + "|" + _d + "|" + _c)}, '', 'g')) AS sanitized FROM s"""

_letters = rf"""l AS (SELECT *, regexp_replace(low, '[^\p{{L}}]+', '', 'g') AS letters, {WORDS} AS w FROM d),
e AS (SELECT *, coalesce(list_sum(list_transform(map_values(list_aggregate(string_split(letters, ''), 'histogram')), lambda c: -(c::DOUBLE / length(letters)) * log2(c::DOUBLE / length(letters)))), 0) / 4.7 AS h,
  len(regexp_extract_all(letters, '[aeiou]'))::DOUBLE / nullif(length(letters), 0) AS r, list_transform(w, lambda x: regexp_replace(x, '[^\p{{L}}]+', '', 'g')) AS shaped FROM l)"""
_parts = {
    "entropy_score": "(CASE WHEN letters = '' THEN 0 WHEN least(h, 1) > 0.85 THEN (least(h, 1) - 0.85) / 0.15 ELSE 0 END)::DOUBLE",
    "vowel_score": "(CASE WHEN r < 0.15 OR r > 0.6 THEN least(1, abs(r - 0.4) / 0.4) ELSE 0 END)::DOUBLE",
    "mashing": f"least(1, {hits(L.GIBBERISH_MASHING)} / 5.0)::DOUBLE",
    "word_score": "(CASE WHEN len(w) > 0 THEN len(list_filter(shaped, lambda x: strlen(x) >= 2 AND (regexp_matches(x, '[^aeiouAEIOU]{5,}') OR (strlen(x) > 3 AND NOT regexp_matches(x, '[aeiouAEIOU]')))))::DOUBLE / len(w) ELSE 0 END)::DOUBLE",
}
ORACLES["scan_gibberish_parts"] = f"WITH {docs(None)}, {_letters} SELECT doc_id, {', '.join(f'round({v}, 6) AS {k}' for k, v in _parts.items())} FROM e"
ORACLES["scan_gibberish"] = f"""WITH {docs(None)}, {_letters},
c AS (SELECT doc_id, unnest(t) AS c, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, string_split(text, '') AS t FROM d)),
b AS (SELECT doc_id, pos, (c IS DISTINCT FROM lag(c) OVER (PARTITION BY doc_id ORDER BY pos))::INT AS new FROM c),
g AS (SELECT doc_id, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM b),
n AS (SELECT doc_id, run, count(*) AS k FROM g GROUP BY ALL HAVING count(*) >= 3),
x AS (SELECT doc_id, sum(0.1::DOUBLE * (k - 2) * (k - 1)) AS x FROM n GROUP BY doc_id),
p AS (SELECT doc_id, strlen(text) AS bytes, {', '.join(f'{v} AS {k}' for k, v in _parts.items())}, (CASE WHEN strlen(text) >= 3 THEN least(1, coalesce(x, 0) / strlen(text)) ELSE 0 END)::DOUBLE AS repetition FROM e LEFT JOIN x USING (doc_id)),
m AS (SELECT *, CASE WHEN bytes < 10 THEN 0 ELSE (entropy_score * 2 + repetition * 1.5::DOUBLE + vowel_score * 1.5::DOUBLE + mashing * 2 + word_score * 1.5::DOUBLE) / 8.5::DOUBLE END AS risk FROM p)
SELECT doc_id, round(repetition, 6) AS repetition, round(risk, 6) AS risk_score, risk < 0.7 - 1e-6 AS is_valid FROM m"""

_scripts = [("ru", "[А-яЁё]", 2), ("ar", r"[\x{0600}-\x{06FF}]", 2), ("zh", r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]", 3), ("hi", r"[\x{0900}-\x{097F}]", 2)]
_lat = {c: hits(getattr(L, f"LANGUAGE_{c.upper()}")) for c in ("es", "fr", "de", "pt", "it")}
_latin = "CASE WHEN greatest(es, fr, de, pt, it) < 2 THEN 'en' " + " ".join(f"WHEN {c} = greatest(es, fr, de, pt, it) THEN '{c}'" for c in _lat) + " END"
_language = rf"""l AS (SELECT *, {n_of(r"\p{L}")} AS n, {n_of("[A-Za-zÀ-ÿ]")} AS k_latin, {", ".join(f"{n_of(p)} AS k_{c}" for c, p, _ in _scripts)}, {", ".join(f"{v} AS {c}" for c, v in _lat.items())} FROM d),
f AS (SELECT *, CASE WHEN n = 0 THEN 'unknown' {" ".join(f"WHEN k_{c} > n // {p} THEN '{c}'" for c, _, p in _scripts)} WHEN k_latin > n // 2 THEN {_latin} ELSE 'unknown' END AS code,
  CASE WHEN n = 0 THEN 0 {" ".join(f"WHEN k_{c} > n // {p} THEN k_{c}::DOUBLE / n" for c, _, p in _scripts)} WHEN k_latin > n // 2 THEN k_latin::DOUBLE / n ELSE 0.3 END AS confidence FROM l)"""
ORACLES["scan_language"] = f"WITH {docs(None)}, {_language} SELECT doc_id, CASE WHEN strlen(text) < 10 THEN 'short' ELSE code END AS code, round(confidence, 6)::DOUBLE AS confidence, CASE WHEN strlen(text) < 10 THEN 0 WHEN confidence < 0.7 - 1e-6 THEN round(confidence * 0.5, 6) WHEN code = 'en' THEN 0 ELSE 1 END::DOUBLE AS risk_score, strlen(text) < 10 OR confidence < 0.7 - 1e-6 OR code = 'en' AS is_valid FROM f"
ORACLES["scan_language_confusion"] = f"WITH {docs(None, True)}, {_language} SELECT lang, CASE WHEN strlen(text) < 10 THEN 'short' ELSE code END AS code, count(*) AS n FROM f GROUP BY 1, 2"

_o, _r, _x, _e = (hits(p) for p in (L.PROMPT_INJECTION_OVERRIDE, L.PROMPT_INJECTION_ROLEPLAY, L.PROMPT_INJECTION_CONTEXT, L.PROMPT_INJECTION_EXTRACTION))
ORACLES["scan_prompt_injection"] = f"""WITH {docs("injection")}, c AS (SELECT doc_id, {_o} AS o, {_r} AS r, {_x} AS x, {_e} AS e,
  ((contains(low, '```') OR contains(low, '---') OR contains(low, '===')) AND (contains(low, 'ignore') OR contains(low, 'system')))::INT AS f,
  (length(text) - length(replace(text, chr(10), '')) > 10 OR (length(text) - length(replace(text, ' ', ''))) / strlen(text) > 0.5)::INT AS p FROM d),
n AS (SELECT *, CASE WHEN o + r + x + e + f > 0 THEN p ELSE 0 END AS g FROM c),
s AS (SELECT doc_id, o + r + x + e + f + g AS n_indicators, CASE WHEN o + r + x + e + f > 0 THEN (o * 0.95::DOUBLE + r * 0.8::DOUBLE + x * 0.75::DOUBLE + e * 0.9::DOUBLE + f * 0.7::DOUBLE + g * 0.6::DOUBLE) / (o + r + x + e + f + g) ELSE 0 END AS score FROM n)
{verdict("score", 0.7, HIGH, "medium", "n_indicators::BIGINT AS n_indicators,")}"""

_sv, _in, _th, _ih = hits([p.replace("*", "") for p in L.TOXICITY_SEVERE]), hits(L.TOXICITY_INSULTS), hits(L.TOXICITY_THREATS), hits(L.TOXICITY_IDENTITY_HATE)
for _name, _family in (("scan_toxicity", "toxicity"), ("scan_toxicity_unseeded", None)):
    ORACLES[_name] = f"""WITH {docs(_family)}, c AS (SELECT doc_id, {_sv} AS a, {_in} AS b, {_th} AS t, {_ih} AS i FROM d),
s AS (SELECT doc_id, a + b + t + i AS n_indicators, greatest(CASE WHEN a > 0 THEN 0.95::DOUBLE ELSE 0 END, CASE WHEN b > 0 THEN least(0.9::DOUBLE, 0.6::DOUBLE + 0.1::DOUBLE * b) ELSE 0 END, CASE WHEN t > 0 THEN 0.9::DOUBLE ELSE 0 END, CASE WHEN i > 0 THEN least(0.95::DOUBLE, 0.7::DOUBLE + 0.1::DOUBLE * i) ELSE 0 END) AS score FROM c)
{verdict("score", 0.7, HIGH, "medium", "n_indicators::BIGINT AS n_indicators,")}"""

_among = lambda items: f"len(list_filter({LWORDS}, lambda x: list_contains({lit_list(items)}, x)))"
ORACLES["scan_sentiment"] = f"""WITH {docs("sentiment")}, c AS (SELECT doc_id, {_among(L.SENTIMENT_POSITIVE)} AS p, {_among(L.SENTIMENT_NEGATIVE)} AS n, {_among(L.SENTIMENT_NEGATION)} > 0 AS t FROM d),
r AS (SELECT doc_id, p + n AS k, (CASE WHEN t THEN n ELSE p END)::DOUBLE / nullif(p + n, 0) AS share FROM c),
s AS (SELECT doc_id, CASE WHEN k = 0 THEN 'neutral' WHEN share > 0.6 THEN 'positive' WHEN 1 - share > 0.6 THEN 'negative' ELSE 'neutral' END AS label, share FROM r),
t AS (SELECT *, CASE label WHEN 'positive' THEN 0.7::DOUBLE + 0.3::DOUBLE * share WHEN 'negative' THEN 0.7::DOUBLE + 0.3::DOUBLE * (1 - share) ELSE 0.6::DOUBLE END AS c FROM s)
SELECT doc_id, label, round(c, 6) AS confidence, round(CASE WHEN label = 'negative' THEN c ELSE 0 END, 6) AS risk_score, label <> 'negative' AS is_valid FROM t"""

_shares = {t: "least(1, (" + " + ".join(n_of(k, "low") for k in ks) + ")::DOUBLE / k * 10)" for t, ks in TOPICS.items()}
_kept = [f"CASE WHEN {t} >= 0.6 - 1e-6 THEN {t} ELSE 0 END" for t in TOPICS]
ORACLES["scan_ban_topics"] = f"""WITH {docs("topics")}, k AS (SELECT *, greatest(1, len({WORDS})) AS k FROM d), s AS (SELECT doc_id, {", ".join(f"{v} AS {t}" for t, v in _shares.items())} FROM k)
SELECT doc_id, ({" + ".join(f"({t} >= 0.6 - 1e-6)::INT" for t in TOPICS)})::BIGINT AS n_topics, round(greatest(0, {", ".join(_kept)}), 6)::DOUBLE AS risk_score, greatest(0, {", ".join(_kept)}) <= 0 AS is_valid FROM s"""

for _name, _kinds in (("scan_bias", ("gender", "racial", "age", "religious")), ("scan_bias_all", tuple(BIAS))):
    _pairs = [(p, w) for k in _kinds for p, w in BIAS[k]]
    ORACLES[_name] = f"WITH {docs('bias')}, s AS (SELECT doc_id, {hits(_pairs)} AS n, {best(_pairs)} AS r FROM d) SELECT doc_id, n::BIGINT AS n, r AS risk_score, r <= 0 AS is_valid, CASE WHEN r <= 0 THEN 'none' ELSE {bands('r', [(0.85, 'high'), (0.7, 'medium')], 'low')} END AS severity FROM s"

_fact = L.FACTUALITY_HEDGING + L.FACTUALITY_SPECULATION + L.FACTUALITY_UNCERTAINTY
_flags = "[" + ", ".join(f"CASE WHEN contains(low, {q(p)}) THEN {w}::DOUBLE END" for p, w in _fact) + "]"
ORACLES["scan_factuality"] = f"""WITH {docs("hedging")}, c AS (SELECT doc_id, list_filter({_flags}, lambda x: x IS NOT NULL) AS p FROM d),
s AS (SELECT doc_id, len(p) AS n, greatest(0, 1 - coalesce(list_sum(list_transform(p, lambda x, i: x * pow(0.8::DOUBLE, i - 1))), 0)) AS score FROM c)
SELECT doc_id, n, round(score, 6)::DOUBLE AS score, round(CASE WHEN score < 0.5 - 1e-6 THEN 1 - score ELSE 0 END, 6)::DOUBLE AS risk_score, score >= 0.5 - 1e-6 AS is_valid,
CASE WHEN score >= 0.5 - 1e-6 THEN 'none' WHEN score < 0.3 - 1e-6 THEN 'high' ELSE 'medium' END AS severity FROM s"""

_cannot = "(contains(low, 'cannot') OR contains(low, 'can''t'))"
_parts = f"{best(L.NO_REFUSAL_DIRECT)}, CASE WHEN {_cannot} OR contains(low, 'won''t') OR contains(low, 'shouldn''t') THEN {best(L.NO_REFUSAL_SAFETY)} ELSE 0 END, {best(L.NO_REFUSAL_CAPABILITY)}"
_sorry = f"CASE WHEN (contains(low, 'sorry') OR contains(low, 'apologize')) AND ({_cannot} OR contains(low, 'unable')) THEN 0.7::DOUBLE ELSE 0 END"
for _name, _more in (("scan_no_refusal", "0"), ("scan_no_refusal_strict", _sorry)):
    ORACLES[_name] = f"WITH {docs('refusal')}, s AS (SELECT doc_id, greatest({_parts}, {_more}) AS score FROM d) " + verdict("score", 0.7, [(0.9, "high"), (0.7, "medium")], "low")

ORACLES["scan_reading_time"] = rf"""WITH {docs(None)}, s AS (SELECT doc_id, len({WORDS}) AS words, length(regexp_replace(text, '\s+', '', 'g')) AS chars, greatest({n_of("[.!?]")}, 1) AS sentences FROM d),
t AS (SELECT *, floor(words / 200.0::DOUBLE * 60)::BIGINT AS seconds FROM s)
SELECT *, seconds BETWEEN 5 AND 300 AS is_valid, CASE WHEN seconds < 5 THEN 0.7::DOUBLE WHEN seconds > 300 THEN 0.8::DOUBLE ELSE 0 END AS risk_score FROM t"""


def luhn(x: str) -> str:
    digits = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    each = f"list_transform(string_split({digits}, ''), lambda c, i: CASE WHEN (length({digits}) - i) % 2 = 0 THEN c::INT ELSE CASE WHEN c::INT > 4 THEN c::INT * 2 - 9 ELSE c::INT * 2 END END)"
    return f"(length({digits}) BETWEEN 13 AND 19 AND list_sum({each}) % 10 = 0)"


CARDS = f"len(list_filter(regexp_extract_all(text, {q(CARD)}), lambda x: {luhn('x')}))"
IPS = f"len(list_filter(regexp_extract_all(text, {q(IPV4)}), lambda x: len(list_filter(string_split(x, '.'), lambda o: o::INT > 255)) = 0))"
_sens = {k: n_of(p) for k, p in SENSITIVE.items()} | {"n_card": CARDS, "n_ip": IPS}
_bad = "n_email + n_phone + n_card + n_ssn + n_ip > 0"
ORACLES["scan_sensitive_counts"] = f"WITH {docs('pii')}, s AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _sens.items())} FROM d) SELECT *, CASE WHEN {_bad} THEN 0.9::DOUBLE ELSE 0 END AS risk_score, NOT ({_bad}) AS is_valid FROM s"

ORACLES["scan_mini"] = f"""WITH {docs("toxicity")} SELECT doc_id, CASE WHEN contains(low, 'ignore previous instructions') THEN 0.9::DOUBLE ELSE 0 END AS injection,
CASE WHEN (contains(text, '@') AND contains(text, '.')) OR {n_of("[0-9]")} >= 10 THEN 0.7::DOUBLE ELSE 0 END AS pii, CASE WHEN contains(low, 'hate') OR contains(low, 'kill') OR contains(low, 'destroy') THEN 0.8::DOUBLE ELSE 0 END AS toxicity FROM d"""


def _url_case(u: str) -> str:
    low = f"lower({u})"
    any_of = lambda items: "(" + " OR ".join(f"contains({low}, {q(x)})" for x in items) + ")"
    rules = [
        (f"contains({low}, 'bit.ly/x')", 0.95), (any_of(L.URL_SUSPICIOUS_TLDS), 0.75), (f"regexp_matches({low}, {q(r'https?://(?:[0-9]{1,3}\.){3}[0-9]{1,3}')})", 0.8),
        (f"length({u}) - length(replace({u}, '%', '')) > 5", 0.7), (f"contains({low}, 'xn--')", 0.75), (f"contains({u}, '@')", 0.85), (f"{hits(L.URL_PHISHING_WORDS, low)} >= 2", 0.8),
        (f"length({low}) - length(replace({low}, '.', '')) > 5", 0.7), ("(" + " OR ".join(f"ends_with({low}, {q(x)})" for x in L.URL_DANGEROUS_EXTENSIONS) + ")", 0.85), (any_of(L.URL_SHORTENERS), 0.6),
    ]
    return "greatest(" + ", ".join(f"CASE WHEN {c} THEN {w}::DOUBLE ELSE 0 END" for c, w in rules) + ")"


_items = ", ".join(q(p) for p in PHRASES["urls"])
ORACLES["scan_malicious_urls"] = f"""WITH d AS (SELECT page_id, url || ' ' || ([{_items}])[page_id % {len(PHRASES["urls"])} + 1] AS text FROM pages),
u AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(text, {q(URL)}), lambda u: {_url_case("u")}), lambda s: s >= 0.6 - 1e-6) AS t FROM d), s AS (SELECT page_id, len(t) AS n_threats, coalesce(list_max(t), 0)::DOUBLE AS r FROM u)
SELECT page_id, n_threats, r AS risk_score, CASE WHEN r <= 0 THEN 'none' ELSE {bands("r", [(0.85, "high"), (0.7, "medium")], "low")} END AS severity FROM s"""

_kw = lambda t: rf"list_distinct(list_filter(list_transform(list_filter(regexp_split_to_array(lower({t}), '\s+'), lambda x: x <> ''), lambda w: regexp_replace(w, '[^\p{{L}}\p{{N}}]+', '', 'g')), lambda w: strlen(w) >= 3 AND NOT list_contains({lit_list(L.RELEVANCE_STOP_WORDS)}, w)))"
TURNS = "t AS (SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS output FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"
ORACLES["scan_relevance"] = rf"""WITH {TURNS}, k AS (SELECT conv_id, turn, lower(output) AS low, {_kw("prompt")} AS a, {_kw("output")} AS b, len(list_filter(regexp_split_to_array(output, '\s+'), lambda x: x <> '')) AS n FROM t),
g AS (SELECT *, len(a) = 0 OR len(b) = 0 AS e, len(list_intersect(a, b)) AS c, greatest({best(L.RELEVANCE_GENERIC)}, CASE WHEN n < 10 AND {hits(L.RELEVANCE_GENERIC)} = 0 THEN 0.6::DOUBLE ELSE 0 END) AS v FROM k),
s AS (SELECT conv_id, turn, CASE WHEN e THEN 0 ELSE c END AS overlap, NOT e AND v > 0.7 + 1e-6 AS is_generic, CASE WHEN e THEN 0.5 ELSE c::DOUBLE / (len(a) + len(b) - c) * CASE WHEN v > 0.7 + 1e-6 THEN 0.5 ELSE 1 END END AS score FROM g)
SELECT conv_id, turn, overlap::BIGINT AS overlap, round(score, 6)::DOUBLE AS score, is_generic, score >= 0.5 - 1e-6 AND NOT is_generic AS is_valid FROM s"""

_syllables = "[bcdfghjklmnpqrstvwyz][aeiou][bcdfghjklmnpqrstvwyz][aeiou]"
ORACLES["scan_phrase_list"] = f"""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents),
m AS (SELECT doc_id, t, regexp_extract_all(t, '{_syllables}') AS found, list_filter(list_transform(range(1, len(t) - 2), lambda i: t[i:i + 3]), lambda x: regexp_full_match(x, '{_syllables}')) AS every FROM d)
SELECT doc_id, len(found) AS n, len(list_distinct(every)) AS n_distinct,
  CASE WHEN len(found) > 0 THEN len(regexp_extract(t, '(?s)^(.*?){_syllables}', 1)) END AS first FROM m"""
