"""Scanner queries over ``documents``, ``pages`` and ``conversations``."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.phrases import phrase_bits, phrase_spans
from ..operators import scanners as S
from .seeds import seeded

R = lambda c: F.round(c, 6)
BANNED = ["thtion", "quemente", "erof"]
COMPETITORS = ["there", "stea", "enhe"]
RULES = [("digits", r"[0-9]{16}", 0.9), ("address", r"[0-9]{1,3}(\.[0-9]{1,3}){3}", 0.6), ("shout", r"[A-Z]{5,}", 0.3)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(family: str | None, scan, columns: dict[str, str] | list[str]):
    """A query of doc_id and some of a verdict's columns over documents, with phrases of a family or without."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select("doc_id", (seeded(family) if family else F.col("text")).alias("text"))
        return S.with_verdict(docs, scan(F.col("text"))).select("doc_id", *(_shown(F.col(c), c).alias(c) for c in columns))

    return query


def _shown(c: Column, name: str) -> Column:
    if name in ("risk_score", "score", "confidence", "entropy_score", "vowel_score", "mashing", "word_score", "repetition", "injection", "pii", "toxicity"):
        return R(c.cast("double"))
    if name == "sanitized":
        return F.sha2(c, 256)
    return c.cast("long") if name.startswith("n_") or name in ("n", "matches", "matches_count", "words", "chars", "sentences", "seconds", "overlap", "overflow", "token_count") else c


def scan_malicious_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", seeded("urls", "url", "page_id").alias("text"))
    v = S.malicious_urls(F.col("text"), blocked=("bit.ly/x",))
    return pages.select("page_id", v["n_threats"].cast("long").alias("n_threats"), R(v["risk_score"]).alias("risk_score"), v["severity"].alias("severity"))


def scan_url_wellformed(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", seeded("urls", "url", "page_id").alias("text"))
    v = S.url_reachability(F.col("text"))
    return pages.select("page_id", v["n_urls"].cast("long").alias("n_urls"), R(v["risk_score"]).alias("risk_score"))


def turns(spark, sf_dir) -> DataFrame:
    """Each user turn with the assistant's turn that follows it."""
    t = table(spark, sf_dir, "conversations")
    user = t.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    answer = t.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return user.join(answer, ["conv_id", "turn"])


def scan_relevance(spark, sf_dir):
    v = S.relevance(F.col("prompt"), F.col("output"))
    return turns(spark, sf_dir).select("conv_id", "turn", v["overlap"].cast("long").alias("overlap"), R(v["score"].cast("double")).alias("score"), v["is_generic"].alias("is_generic"), v["is_valid"].alias("is_valid"))


#: Ten thousand phrases: consonant, vowel, consonant, vowel.
SYLLABLES = ["".join(x) for x in itertools.product(*["bcdfghjklmnpqrstvwyz", "aeiou"] * 2)]


def scan_phrase_list(spark, sf_dir):
    """How often the phrases of a long list stand in each text, how many different ones do, and where the first begins."""
    docs = table(spark, sf_dir, "documents")
    low = F.lower("text")
    out = docs.select("doc_id", phrase_spans(low, SYLLABLES, fold=False).alias("spans"), phrase_bits(low, SYLLABLES).alias("bits"))
    distinct = F.aggregate("bits", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w))
    return out.select("doc_id", F.size("spans").cast("long").alias("n"), distinct.alias("n_distinct"), F.get("spans.start", F.lit(0)).cast("long").alias("first"))


def scan_language_confusion(spark, sf_dir):
    """Found language by told language, one row each."""
    docs = table(spark, sf_dir, "documents").select("lang", S.language(F.col("text"))["code"].alias("code"))
    return docs.groupBy("lang", "code").agg(F.count("*").alias("n"))


SCORE = ["risk_score", "is_valid", "severity"]
QUERIES = {
    "scan_token_limit": _documents(None, lambda t: S.token_limit(t, 512), ["token_count", "overflow", "is_valid"]),
    "scan_ban_substrings": _documents(None, lambda t: S.ban_substrings(t, BANNED), ["matches_count", "is_valid", "sanitized"]),
    "scan_ban_substrings_word": _documents(None, lambda t: S.ban_substrings(t, COMPETITORS, whole_words=True), ["matches_count", "is_valid"]),
    "scan_ban_competitors": _documents(None, lambda t: S.ban_competitors(t, COMPETITORS), ["matches_count", "is_valid", "risk_score"]),
    "scan_regex_input": _documents(None, lambda t: S.regex_scan(t, RULES), ["matches", "risk_score", "is_valid"]),
    "scan_regex_deny": _documents(None, lambda t: S.regex_output(t, [p for _, p, _ in RULES]), ["matches", "risk_score", "is_valid"]),
    "scan_regex_allow": _documents(None, lambda t: S.regex_output(t, [p for _, p, _ in RULES], allow=True), ["matches", "risk_score", "is_valid"]),
    "scan_ban_code_counts": _documents("code", S.code_counts, ["n_fence", "n_func", "n_import", "n_var", "is_valid"]),
    "scan_invisible": _documents("invisible", S.invisible_text, ["n_zero_width", "n_direction", "n_control", *SCORE, "sanitized"]),
    "scan_gibberish_parts": _documents(None, S.gibberish, ["entropy_score", "vowel_score", "mashing", "word_score"]),
    "scan_gibberish": _documents(None, S.gibberish, ["repetition", "risk_score", "is_valid"]),
    "scan_language": _documents(None, S.language, ["code", "confidence", "risk_score", "is_valid"]),
    "scan_phrase_list": scan_phrase_list,
    "scan_language_confusion": scan_language_confusion,
    "scan_prompt_injection": _documents("injection", S.prompt_injection, ["n_indicators", *SCORE]),
    "scan_toxicity": _documents("toxicity", S.toxicity, ["n_indicators", *SCORE]),
    "scan_toxicity_unseeded": _documents(None, S.toxicity, ["n_indicators", *SCORE]),
    "scan_sentiment": _documents("sentiment", S.sentiment, ["label", "confidence", "risk_score", "is_valid"]),
    "scan_ban_topics": _documents("topics", S.ban_topics, ["n_topics", "risk_score", "is_valid"]),
    "scan_bias": _documents("bias", S.bias, ["n", *SCORE]),
    "scan_bias_all": _documents("bias", lambda t: S.bias(t, tuple(S.BIAS)), ["n", *SCORE]),
    "scan_factuality": _documents("hedging", S.factuality, ["n", "score", *SCORE]),
    "scan_no_refusal": _documents("refusal", S.no_refusal, SCORE),
    "scan_no_refusal_strict": _documents("refusal", lambda t: S.no_refusal(t, strict=True), SCORE),
    "scan_reading_time": _documents(None, S.reading_time, ["words", "chars", "sentences", "seconds", "is_valid", "risk_score"]),
    "scan_sensitive_counts": _documents("pii", S.sensitive, [*S.SENSITIVE, "n_card", "n_ip", "risk_score", "is_valid"]),
    "scan_mini": _documents("toxicity", S.mini_scans, ["injection", "pii", "toxicity"]),
    "scan_malicious_urls": scan_malicious_urls,
    "scan_url_wellformed": scan_url_wellformed,
    "scan_relevance": scan_relevance,
}
