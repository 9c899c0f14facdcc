"""Scanners for SQL users: temporary SQL functions over column expressions, which the optimizer sees through."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..catalog import lexicon as L


def _literal(phrase: str) -> str:
    return "'" + phrase.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hits(phrases: list[str], t: str = "lower(t)") -> str:
    return " + ".join(f"int(contains({t}, {_literal(p)}))" for p in phrases)


FUNCTIONS = {
    "guard_tokens": ("BIGINT", "ceil(octet_length(t) / 4.0)"),
    "guard_insults": ("INT", _hits(L.TOXICITY_INSULTS)),
    "guard_threats": ("INT", _hits(L.TOXICITY_THREATS)),
    "guard_injections": ("INT", _hits(L.PROMPT_INJECTION_OVERRIDE + L.PROMPT_INJECTION_EXTRACTION)),
    "guard_hate": ("INT", _hits(L.TOXICITY_IDENTITY_HATE)),
    "guard_jailbreaks": ("INT", _hits(L.PROMPT_INJECTION_ROLEPLAY + L.PROMPT_INJECTION_CONTEXT)),
    "guard_mashing": ("INT", _hits(L.GIBBERISH_MASHING)),
    "guard_refusals": ("INT", _hits([p for p, _ in L.NO_REFUSAL_DIRECT])),
    "guard_hedges": ("INT", _hits([p for p, _ in L.FACTUALITY_HEDGING + L.FACTUALITY_SPECULATION + L.FACTUALITY_UNCERTAINTY])),
    "guard_bias": ("INT", _hits([p for p, _ in L.BIAS_GENDER + L.BIAS_RACIAL + L.BIAS_AGE + L.BIAS_RELIGIOUS])),
    "guard_sentences": ("INT", "greatest(regexp_count(t, '[.!?]'), 1)"),
    "guard_reading_seconds": ("BIGINT", "floor(size(filter(split(t, r'\\s+'), x -> x <> '')) / 200.0D * 60)"),
    "guard_invisible": ("INT", "regexp_count(t, r'[\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}\\x{2060}\\x{180E}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]')"),
    "guard_octets": ("BOOLEAN", "forall(split(t, r'\\.'), x -> try_cast(x AS INT) BETWEEN 0 AND 255)"),
    "guard_mask": ("STRING", "CASE WHEN length(t) <= 8 THEN repeat('*', length(t)) ELSE concat(left(t, 4), repeat('*', length(t) - 8), right(t, 4)) END"),
    "guard_cache_key": ("STRING", "sha2(t, 256)"),
    "guard_words": ("INT", "size(filter(split(t, r'\\s+'), x -> x <> ''))"),
    "guard_card": ("BOOLEAN", "length(regexp_replace(t, '[^0-9]', '')) BETWEEN 13 AND 19 AND luhn_check(regexp_replace(t, '[^0-9]', ''))"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session: SELECT guard_tokens(text) FROM documents."""
    for name, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
    return sorted(FUNCTIONS)
