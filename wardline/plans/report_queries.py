"""Pipelines, anonymisation, reports and metrics over the driver tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import lexicon
from ..catalog import patterns as P
from ..functions.text import RISK_BANDS, count
from ..operators import detectors, metrics, scanners, spans, text_agents
from ..operators.pipeline import Guard, allow_block, apply_policy, combine, result, short_circuit
from . import detect_queries, scan_oracles
from .scan_oracles import docs, n_of, q
from .scan_queries import R, table, turns
from .seeds import PHRASES, seeded, seeded_sql


def _docs(spark: SparkSession, sf_dir: str, family: str | None, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *more, (seeded(family) if family else F.col("text")).alias("text"))




#: Words of the test tables' prose, and its languages.
OPTIONS = {"ban_substrings": {"phrases": ("thtion", "quemente")}, "ban_competitors": {"names": ("stea",)}, "language": {"allowed": ("en", "de", "fr", "es")}}


def _preset(name: str, output: bool = False, stop: bool = True):
    def query(spark, sf_dir):
        guard = Guard.preset(name, output, OPTIONS)
        out = (guard if stop else guard.short_circuit(None)).scan(_docs(spark, sf_dir, "toxicity"))
        return out.select("doc_id", F.col("n_results").cast("long").alias("n_results"), R(F.col("risk_score")).alias("risk_score"), "is_valid", "severity")

    return query


def pipe_policy(spark, sf_dir):
    guard = Guard.preset("standard").short_circuit(None)
    scanned = guard.scan(_docs(spark, sf_dir, "toxicity", "lang")).select("doc_id", "lang", "risk_score", "is_valid")
    policies = spark.createDataFrame([("de", "block", 0.5, "p1"), ("fr", "audit", 0.3, "p2"), ("es", "challenge", 0.95, "p3")], "lang string, action string, adjustment double, rule_id string")
    out = apply_policy(scanned, policies, "lang")
    return out.select("doc_id", R(F.col("risk_score")).alias("risk_score"), "is_valid", "policy_action", "policy_rule")


def pipe_allow_block(spark, sf_dir):
    v = allow_block(F.col("text"), ["the ", "der ", "que "], ["idiot", "@mail"])
    return _docs(spark, sf_dir, None).select("doc_id", v["allowed"].alias("allowed"), v["blocked"].alias("blocked"))


def pipe_prompt_output(spark, sf_dir):
    t = turns(spark, sf_dir)
    a = combine(Guard.preset("permissive").results(F.col("prompt")))
    b = combine(Guard.preset("permissive", output=True).results(F.col("output")))
    return t.select("conv_id", "turn", R(a["risk_score"]).alias("prompt_risk"), a["is_valid"].alias("prompt_valid"), R(b["risk_score"]).alias("output_risk"), b["is_valid"].alias("output_valid"))


def report_lang_risk(spark, sf_dir):
    """The flagship: documents by language and severity under the standard preset."""
    out = Guard.preset("standard").short_circuit(None).scan(_docs(spark, sf_dir, "toxicity", "lang"))
    return out.groupBy("lang", "severity").agg(F.count("*").alias("n"), R(F.avg("risk_score")).alias("avg_risk"), F.count_if(~F.col("is_valid")).alias("n_invalid"))


def report_category_severity(spark, sf_dir):
    """Secret matches by category and severity, by each alone, and in all."""
    d = _docs(spark, sf_dir, "secrets")
    sums = d.agg(*[F.sum(count(F.col("text"), r[-1])).alias(f"c{i}") for i, r in enumerate(P.SECRETS)])
    rows = sums.select(F.explode(F.array(*[F.struct(F.lit(r[1]).alias("category"), F.lit(r[2]).alias("severity"), F.col(f"c{i}").alias("n")) for i, r in enumerate(P.SECRETS)])).alias("x")).select("x.*").filter("n > 0")
    c, s = F.col("category"), F.col("severity")
    return rows.groupingSets([[c, s], [c], [s], []], c, s).agg(F.sum("n").alias("n"))


def report_accuracy(spark, sf_dir):
    v = scanners.toxicity(F.col("text"))
    d = _docs(spark, sf_dir, None).select("doc_id", (~v["is_valid"]).alias("guess"))
    m = metrics.accuracy(table(spark, sf_dir, "labels").filter("toxic is not null").join(d, "doc_id"), F.col("toxic") == 1, F.col("guess"))
    return m.select("tp", "fp", "tn", "fn", *(R(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


def _anon(strategy: str):
    def query(spark, sf_dir):
        return spans.redact(_docs(spark, sf_dir, "pii"), strategy=strategy).select("doc_id", F.col("n_redacted").cast("long").alias("n_redacted"), R(F.col("risk_score")).alias("risk_score"), F.sha2("redacted", 256).alias("redacted_hash"))

    return query


SIMPLE = [r for r in P.REDACTION if r[0] in ("pii-email", "secret-aws-access-key", "secret-github-pat", "secret-stripe-live", "secret-private-key", "cred-postgres-url")]


def anon_mask_columns(spark, sf_dir):
    """Masking by nested replacement alone: what column expressions can do when no match needs validating."""
    from functools import reduce

    from ..functions.text import java

    d = _docs(spark, sf_dir, "secrets")
    clean = reduce(lambda c, r: F.regexp_replace(c, java(r[-1]), f"[{r[2].upper()}]"), SIMPLE, F.col("text"))
    return d.select("doc_id", sum(count(F.col("text"), r[-1]) for r in SIMPLE).cast("long").alias("n"), F.sha2(clean, 256).alias("redacted_hash"))


def anon_placeholders(spark, sf_dir):
    _, mapping = spans.anonymise(_docs(spark, sf_dir, "pii"), "doc_id")
    return mapping.groupBy("entity_type").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("n_docs"))


def anon_roundtrip(spark, sf_dir):
    done, mapping = spans.anonymise(_docs(spark, sf_dir, "pii"), "doc_id", stored=True)
    back = spans.deanonymise(done, mapping, "doc_id")
    return back.select("doc_id", (F.col("restored") == F.col("text")).alias("equal"))


def anon_regex_counts(spark, sf_dir):
    t = F.col("text")
    kinds = [r for r in spans.ENTITIES if r.valid is None]
    return _docs(spark, sf_dir, "pii").select("doc_id", *(count(t, r.pattern).cast("long").alias("n_" + r.kind.lower()) for r in kinds), F.size(F.filter(scanners.extract(t, scanners.IPV4), scanners.octets_ok)).cast("long").alias("n_ip_address"))


def detect_pii(spark, sf_dir):
    found = _docs(spark, sf_dir, "pii").withColumn("spans", spans.detect_pii(F.col("text")))
    return found.select("doc_id", F.size("spans").cast("long").alias("n"), R(spans.spans_risk(F.col("spans"))).alias("risk_score"))


def detect_toxicity(spark, sf_dir):
    found = _docs(spark, sf_dir, "toxicity").withColumn("spans", text_agents.toxic_spans(F.col("text")))
    return found.select("doc_id", F.size("spans").cast("long").alias("n"), R(spans.spans_risk(F.col("spans"))).alias("risk_score"))


def scan_ban_code(spark, sf_dir):
    c = text_agents.code_risk(F.col("text"))
    return _docs(spark, sf_dir, "code").select("doc_id", c["n"].cast("long").alias("n"), R(c["risk_score"]).alias("risk_score"))


def sql_functions(spark, sf_dir):
    from ..functions.sql import register

    register(spark)
    return spark.sql("SELECT doc_id, guard_tokens(text) AS tokens, guard_insults(text) AS insults, guard_words(text) AS words, guard_hate(text) AS hate, guard_hedges(text) AS hedges, guard_sentences(text) AS sentences, guard_reading_seconds(text) AS seconds, guard_mask(left(text, 20)) AS masked, guard_cache_key(text) AS cache_key FROM {docs}", docs=_docs(spark, sf_dir, "toxicity"))


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


def metric_1min(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k"))
    out = metrics.rollup(e, "1 minute", ("event_type", "k"))
    return out.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "event_type", "k", R(F.col("avg")).alias("avg"), "max", "min", "n")


def metric_sliding_rate(spark, sf_dir):
    out = metrics.sliding_ratio(_events(spark, sf_dir), F.col("event_type") == "error", "60 minutes", "20 minutes")
    return out.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "n", "n_bad", R(F.col("ratio")).alias("ratio"), F.round("rate", 9).alias("rate"))


def metric_session(spark, sf_dir):
    out = metrics.sessions(_events(spark, sf_dir), "2 hours")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.col("last").cast("timestamp_ntz").alias("last"))


def metric_index_percentiles(spark, sf_dir):
    out = metrics.index_percentiles(_events(spark, sf_dir), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return out.select("event_type", "p50", "p95", "p99", R(F.col("mean")).alias("mean"), R(F.col("std_dev")).alias("std_dev"), "min", "max", "n")


def metric_alert_eval(spark, sf_dir):
    hourly = metrics.rollup(_events(spark, sf_dir), "1 hour", ("event_type",))
    series = hourly.select(F.col("event_type").alias("metric"), "bucket", F.col("n").cast("double").alias("value"))
    rules = spark.createDataFrame([("r1", "error", "gt", 3.0, 1), ("r2", "click", "ge", 2.0, 3), ("r3", "view", "lt", 2.0, 2)], "rule_id string, metric string, operator string, threshold double, for_buckets int")
    out = metrics.evaluate_alerts(series, rules)
    return out.select("rule_id", F.col("bucket").cast("timestamp_ntz").alias("bucket"), "value", "fired")


def metric_retention(spark, sf_dir):
    kept = metrics.retained(_events(spark, sf_dir), "10 DAYS")
    return kept.groupBy("event_type").agg(F.count("*").alias("n_kept"))


def metric_quota_calendar(spark, sf_dir):
    return metrics.calendar_quota(_events(spark, sf_dir), 3, "day").select("user_id", F.col("bucket").cast("timestamp_ntz").alias("bucket"), F.col("allowed").cast("long").alias("allowed"), F.col("denied").cast("long").alias("denied"))


def metric_quota_anchored(spark, sf_dir):
    return metrics.anchored_quota(_events(spark, sf_dir), (1, 1, 2)).groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("denied"))


def metric_token_bucket(spark, sf_dir):
    """One request in six hours, two at once."""
    return metrics.token_bucket(_events(spark, sf_dir), 1 / 360, 2).groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("denied"))


def metric_concurrency(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", F.col("ts").alias("begins"), (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("event_id") % 600).cast("int"), F.lit(1))).alias("ends"))
    return metrics.concurrency(e).select("user_id", F.col("max_overlap").cast("long").alias("max_overlap"))


def metric_scanner_stats(spark, sf_dir):
    e = _events(spark, sf_dir)
    ok = F.col("event_type") != "error"
    return e.groupBy((F.col("user_id") % 10).alias("scanner")).agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"), R(F.avg("value")).alias("avg_latency"), R(F.expr("percentile(value, 0.95)")).alias("p95"), R(F.expr("percentile(value, 0.99)")).alias("p99"))


def detect_behaviour(spark, sf_dir):
    day = _events(spark, sf_dir).groupBy("user_id", F.date_trunc("day", "ts").alias("bucket")).agg(F.count("*").alias("n"), F.sum("value").alias("tokens"), F.count_if(F.col("event_type") == "error").alias("violations"))
    v = metrics.behaviour_risk({"requests_per_minute": F.col("n") * 20, "tokens_per_session": F.col("tokens") * 1000, "previous_violations": F.col("violations")}, P.BEHAVIOUR)
    return day.select("user_id", F.col("bucket").cast("timestamp_ntz").alias("bucket"), v["n_signatures"].cast("long").alias("n_signatures"), v["risk_score"].alias("risk_score"))


def ml_softmax(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", metrics.softmax(F.col("embedding").cast("array<double>")).alias("p"))
    return e.select("vec_id", (F.array_position("p", F.array_max("p")) - 1).cast("long").alias("label"), F.round(F.array_max("p"), 6).alias("confidence"))


def ml_sigmoid_violations(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", metrics.sigmoid(F.col("embedding").cast("array<double>")).alias("p"))
    return e.select("vec_id", F.size(F.filter("p", lambda x: x >= 0.55)).cast("long").alias("n_violations"), F.exists("p", lambda x: x >= 0.6).alias("exceeds"))


def cache_dedupe(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    n = d.groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("c")).agg(F.sum("c").alias("total"), F.count("*").alias("distinct_texts"))
    return n.select("total", "distinct_texts", R(1 - F.col("distinct_texts") / F.col("total")).alias("hit_rate"))


def decision_events(spark, sf_dir):
    v = detectors.injection(F.col("text"))
    out = metrics.decision_events(_docs(spark, sf_dir, "injection"), "text", {"doc_id": F.col("doc_id"), "risk_score": R(v["risk_score"]), "severity": v["severity"]}, "prompt-injection", "1.0")
    return out.select("doc_id", "agent_id", "inputs_hash", "risk_score", "severity")


def _vault(spark, sf_dir) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select(F.col("user_id").alias("session_id"), F.concat(F.lit("["), F.col("event_type"), F.lit("_"), (F.col("event_id") % 3).cast("string"), F.lit("]")).alias("placeholder"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("expires_at"))


_NOW = "2024-01-20 12:00:00"


def vault_live_sessions(spark, sf_dir):
    live = metrics.live_mappings(_vault(spark, sf_dir).filter(F.col("expires_at") < F.lit("2024-01-21 12:00:00").cast("timestamp")), F.lit(_NOW).cast("timestamp"))
    return live.groupBy("session_id").agg(F.count("*").alias("n_live"))


def vault_cleanup(spark, sf_dir):
    return _vault(spark, sf_dir).agg(F.count_if(F.col("expires_at") < F.lit(_NOW).cast("timestamp")).alias("n_expired"))


def point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter("c_custkey = 7").select("c_custkey", "c_name", "c_nationkey")


def pipe_combine(spark, sf_dir):
    t = F.col("text")
    results = F.array(result("toxicity", scanners.toxicity(t)), result("token_limit", scanners.token_limit(t, 512)), result("injection", scanners.prompt_injection(t)))
    d = _docs(spark, sf_dir, "injection").withColumn("c", combine(results))
    return d.select("doc_id", F.col("c.n_results").cast("long").alias("n_results"), R(F.col("c.risk_score")).alias("risk_score"), F.col("c.is_valid").alias("is_valid"))


def pipe_short_circuit(spark, sf_dir):
    t = F.col("text")
    results = F.array(result("toxicity", scanners.toxicity(t)), result("token_limit", scanners.token_limit(t, 512)), result("injection", scanners.prompt_injection(t)))
    d = _docs(spark, sf_dir, "injection").withColumn("results", results).withColumn("c", combine(short_circuit(F.col("results"), 0.85)))
    return d.select("doc_id", F.col("c.n_results").cast("long").alias("n_results"), R(F.col("c.risk_score")).alias("risk_score"), F.col("c.is_valid").alias("is_valid"))


_NAMES = """pipe_policy pipe_allow_block pipe_prompt_output pipe_combine pipe_short_circuit report_lang_risk report_category_severity report_accuracy
anon_mask_columns anon_placeholders anon_roundtrip anon_regex_counts detect_pii detect_toxicity scan_ban_code sql_functions metric_1min metric_sliding_rate metric_session metric_index_percentiles
metric_alert_eval metric_retention metric_quota_calendar metric_quota_anchored metric_token_bucket metric_concurrency metric_scanner_stats detect_behaviour ml_softmax
ml_sigmoid_violations cache_dedupe decision_events vault_live_sessions vault_cleanup point_lookup""".split()
QUERIES = {n: globals()[n] for n in _NAMES}
QUERIES |= {f"anon_redact_{s}": _anon(s) for s in ("mask", "hash", "pseudonymize", "remove", "partial_mask")}
QUERIES |= {"pipe_preset_standard": _preset("standard"), "pipe_preset_permissive": _preset("permissive"), "pipe_preset_strict": _preset("strict"), "pipe_preset_standard_all": _preset("standard", stop=False), "pipe_preset_strict_output": _preset("strict", output=True), "pipe_preset_standard_output": _preset("standard", output=True)}

_S, _D = scan_oracles.ORACLES, detect_queries.ORACLES


def _part(name: str, family: str, of: str | None, sql: dict[str, str], valid: str = "is_valid") -> str:
    """A scanner's SQL over documents seeded by another family, as (doc_id, risk_score, is_valid)."""
    return f"SELECT doc_id, risk_score::DOUBLE AS r, {valid} AS v FROM (" + sql[name].replace(docs(of), docs(family)) + ")"


def _tokens(limit: int, family: str) -> str:
    return f"SELECT doc_id, (ceil(strlen(text) / 4.0) > {limit})::INT::DOUBLE AS r, ceil(strlen(text) / 4.0) <= {limit} AS v FROM (SELECT doc_id, {seeded_sql(family)} AS text FROM documents)"


def _combined(parts: list[str], stop: float | None, more: str = "") -> str:
    """CTEs up to z: doc_id, n_results, risk_score, is_valid."""
    with_ = ", ".join(f"p{i} AS ({p})" for i, p in enumerate(parts))
    joins = "p0 " + " ".join(f"JOIN p{i} USING (doc_id)" for i in range(1, len(parts)))
    k = len(parts)
    n = "CASE " + " ".join(f"WHEN p{i}.r >= {stop} - 1e-6 THEN {i + 1}" for i in range(k)) + f" ELSE {k} END" if stop else str(k)
    rows = f"j AS (SELECT doc_id, {n} AS n, [{', '.join(f'p{i}.r' for i in range(k))}] AS r, [{', '.join(f'p{i}.v' for i in range(k))}] AS v FROM {joins})"
    return f"WITH {with_}, {rows}, z AS (SELECT doc_id, n::BIGINT AS n_results, round(list_max(r[1:n]), 6) AS risk_score, NOT list_contains(v[1:n], false) AS is_valid FROM j)"


_SEV = "CASE WHEN risk_score <= 0 THEN 'none' " + " ".join(f"WHEN risk_score >= {a} - 1e-6 THEN '{s}'" for a, s in RISK_BANDS) + " ELSE 'low' END AS severity"
_LEAK = _part("detect_secrets", "toxicity", "secrets", _D, "risk_score < 0.5")
_TOX, _INJ, _INV = _part("scan_toxicity", "toxicity", "toxicity", _S), _part("scan_prompt_injection", "toxicity", "injection", _S), _part("scan_invisible", "toxicity", "invisible", _S)
_STD = [_LEAK, _TOX, _INJ, _INV, _tokens(4096, "toxicity")]
_THREE = [_part("scan_toxicity", "injection", "toxicity", _S), _tokens(512, "injection"), _part("scan_prompt_injection", "injection", "injection", _S)]
_turn_secrets = _D["detect_secrets"].replace(docs("secrets"), f"{scan_oracles.TURNS}, d AS (SELECT conv_id * 1000 + turn AS doc_id, prompt AS text, lower(prompt) AS low FROM t)")
_turn_invisible = _S["scan_invisible"].replace(docs("invisible"), f"{scan_oracles.TURNS}, d AS (SELECT conv_id * 1000 + turn AS doc_id, prompt AS text, lower(prompt) AS low FROM t)")
_turn_sensitive = _S["scan_sensitive_counts"].replace(docs("pii"), f"{scan_oracles.TURNS}, d AS (SELECT conv_id * 1000 + turn AS doc_id, output AS text, lower(output) AS low FROM t)")
_sets = " UNION ALL ".join(f"SELECT '{r[1]}' AS category, '{r[2]}' AS severity, sum({n_of(r[-1])}) AS n FROM d" for r in P.SECRETS)
_mask = "text"
for _r in SIMPLE:
    _mask = f"regexp_replace({_mask}, {q(_r[-1])}, '[{_r[2].upper()}]', 'g')"
_behave = [("n * 20", "requests_per_minute"), ("tokens * 1000", "tokens_per_session"), ("violations", "previous_violations")]
_hits = [(e, b) for e, m in _behave for b in P.BEHAVIOUR if b[4] == m]
_hit = " + ".join(f"({e} >= {b[5]} - 1e-6)::INT" for e, b in _hits)
_load = " + ".join(f"CASE WHEN {e} >= {b[5]} - 1e-6 THEN {metrics.BEHAVIOUR_WEIGHT[b[2]]}::DOUBLE * least(1, {b[3]}::DOUBLE * least(2, ({e})::DOUBLE / {b[5]})) ELSE 0 END" for e, b in _hits)

ORACLES = {
    "pipe_combine": _combined(_THREE, None) + " SELECT * FROM z",
    "pipe_short_circuit": _combined(_THREE, 0.85) + " SELECT * FROM z",
    "pipe_preset_standard": _combined(_STD, 0.9) + f" SELECT *, {_SEV} FROM z",
    "pipe_preset_standard_all": _combined(_STD, None) + f" SELECT *, {_SEV} FROM z",
    "pipe_preset_permissive": _combined([_LEAK, _INV], None) + f" SELECT *, {_SEV} FROM z",
    "report_lang_risk": _combined(_STD, None) + f", s AS (SELECT *, {_SEV} FROM z) SELECT lang, severity, count(*) AS n, round(avg(risk_score), 6) AS avg_risk, count(*) FILTER (NOT is_valid) AS n_invalid FROM s JOIN documents USING (doc_id) GROUP BY 1, 2",
    "pipe_policy": _combined(_STD, None) + ", p(lang, action, adjustment, rule_id) AS (VALUES ('de', 'block', 0.5::DOUBLE, 'p1'), ('fr', 'audit', 0.3::DOUBLE, 'p2'), ('es', 'challenge', 0.95::DOUBLE, 'p3')) SELECT doc_id, greatest(risk_score, coalesce(adjustment, 0)) AS risk_score, is_valid AND coalesce(action, '') <> 'block' AS is_valid, action AS policy_action, rule_id AS policy_rule FROM z JOIN documents USING (doc_id) LEFT JOIN p USING (lang)",
    "pipe_allow_block": "SELECT doc_id, contains(low, 'the ') OR contains(low, 'der ') OR contains(low, 'que ') AS allowed, contains(low, 'idiot') OR contains(low, '@mail') AS blocked FROM (SELECT doc_id, lower(text) AS low FROM documents)",
    "pipe_prompt_output": f"WITH a AS ({_turn_secrets}), b AS ({_turn_invisible}), c AS ({_turn_sensitive}) SELECT doc_id // 1000 AS conv_id, doc_id % 1000 AS turn, greatest(a.risk_score, b.risk_score) AS prompt_risk, a.risk_score < 0.5 AND b.is_valid AS prompt_valid, c.risk_score AS output_risk, c.is_valid AS output_valid FROM a JOIN b USING (doc_id) JOIN c USING (doc_id)",
    "report_category_severity": f"WITH {docs('secrets')}, c AS (SELECT * FROM ({_sets}) WHERE n > 0) SELECT category, severity, sum(n)::BIGINT AS n FROM c GROUP BY GROUPING SETS ((category, severity), (category), (severity), ())",
    "report_accuracy": "WITH s AS (" + _S["scan_toxicity_unseeded"] + "), c AS (SELECT count(*) FILTER (toxic = 1 AND NOT is_valid) AS tp, count(*) FILTER (toxic <> 1 AND NOT is_valid) AS fp, count(*) FILTER (toxic <> 1 AND is_valid) AS tn, count(*) FILTER (toxic = 1 AND is_valid) AS fn FROM labels JOIN s USING (doc_id) WHERE toxic IS NOT NULL), r AS (SELECT *, coalesce((tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0), 0) AS a, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS k FROM c) SELECT tp, fp, tn, fn, round(a, 6) AS accuracy, round(p, 6) AS precision, round(k, 6) AS recall, round(coalesce(2 * p * k / nullif(p + k, 0), 0), 6) AS f1 FROM r",
    "sql_functions": f"WITH {docs('toxicity')} SELECT doc_id, ceil(strlen(text) / 4.0)::BIGINT AS tokens, {scan_oracles.hits(lexicon.TOXICITY_INSULTS)} AS insults, len({scan_oracles.WORDS}) AS words, {scan_oracles.hits(lexicon.TOXICITY_IDENTITY_HATE)} AS hate, {scan_oracles.hits(lexicon.FACTUALITY_HEDGING + lexicon.FACTUALITY_SPECULATION + lexicon.FACTUALITY_UNCERTAINTY)} AS hedges, greatest({n_of('[.!?]')}, 1) AS sentences, floor(len({scan_oracles.WORDS}) / 200.0::DOUBLE * 60)::BIGINT AS seconds, CASE WHEN length(text) <= 8 THEN repeat('*', length(text)) ELSE left(text, 4) || repeat('*', least(length(text), 20) - 8) || right(left(text, 20), 4) END AS masked, sha256(text) AS cache_key FROM d",
    "anon_mask_columns": f"WITH {docs('secrets')} SELECT doc_id, {' + '.join(n_of(r[-1]) for r in SIMPLE)} AS n, sha256({_mask}) AS redacted_hash FROM d",
    "anon_roundtrip": "SELECT doc_id, true AS equal FROM documents",
    "anon_regex_counts": f"WITH {docs('pii')} SELECT doc_id, {', '.join(f'{n_of(r.pattern)} AS n_{r.kind.lower()}' for r in spans.ENTITIES if r.valid is None)}, {scan_oracles.IPS} AS n_ip_address FROM d",
    "metric_1min": "SELECT date_trunc('minute', ts) AS bucket, event_type, json_extract_string(props, '$.k') AS k, round(avg(value), 6) AS avg, max(value) AS max, min(value) AS min, count(*) AS n FROM events GROUP BY 1, 2, 3",
    "metric_sliding_rate": "WITH w AS (SELECT time_bucket(INTERVAL '20 minutes', ts) - INTERVAL (i * 20) MINUTE AS bucket, event_type FROM events, range(3) r(i)) SELECT bucket, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_bad, round(count(*) FILTER (event_type = 'error')::DOUBLE / count(*), 6) AS ratio, round(count(*)::DOUBLE / 3600, 9) AS rate FROM w GROUP BY 1",
    "metric_session": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER u <= INTERVAL '2 hours' THEN 0 ELSE 1 END AS b FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, max(ts) AS last FROM s GROUP BY user_id, k",
    "metric_index_percentiles": "WITH v AS (SELECT event_type, list_sort(list(value)) AS l, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1) SELECT event_type, " + ", ".join(f"l[least(floor(len(l) * {p}::DOUBLE)::BIGINT, len(l) - 1) + 1] AS {n}" for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))) + ", round(m, 6) AS mean, round(s, 6) AS std_dev, l[1] AS min, l[-1] AS max, len(l) AS n FROM v",
    "metric_alert_eval": "WITH h AS (SELECT event_type AS metric, date_trunc('hour', ts) AS bucket, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2), r(rule_id, metric, op, threshold, k) AS (VALUES ('r1', 'error', 'gt', 3.0, 1), ('r2', 'click', 'ge', 2.0, 3), ('r3', 'view', 'lt', 2.0, 2)), j AS (SELECT rule_id, bucket, value, k, CASE op WHEN 'gt' THEN value > threshold WHEN 'ge' THEN value >= threshold ELSE value < threshold END AS holds FROM h JOIN r USING (metric)), c AS (SELECT *, CASE WHEN NOT holds OR bucket - lag(bucket) OVER w <> INTERVAL '1 hour' OR lag(bucket) OVER w IS NULL THEN 1 ELSE 0 END AS cut FROM j WINDOW w AS (PARTITION BY rule_id ORDER BY bucket)), s AS (SELECT *, sum(cut) OVER (PARTITION BY rule_id ORDER BY bucket) AS run FROM c) SELECT rule_id, bucket, value, holds AND sum(holds::INT) OVER (PARTITION BY rule_id, run ORDER BY bucket) >= k AS fired FROM s",
    "metric_retention": "SELECT event_type, count(*) AS n_kept FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL '10 days' GROUP BY 1",
    "metric_quota_calendar": "SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS bucket, least(count(*), 3) AS allowed, greatest(count(*) - 3, 0) AS denied FROM events GROUP BY 1, 2",
    "metric_concurrency": "WITH m AS (SELECT user_id, ts AS t, 1 AS d FROM events UNION ALL SELECT user_id, ts + INTERVAL (event_id % 600) MINUTE + INTERVAL 1 SECOND, -1 FROM events), o AS (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS o FROM m) SELECT user_id, max(o)::BIGINT AS max_overlap FROM o GROUP BY 1",
    "metric_scanner_stats": "SELECT user_id % 10 AS scanner, count(*) AS total, count(*) FILTER (event_type <> 'error') AS valid, count(*) FILTER (event_type = 'error') AS invalid, round(avg(value), 6) AS avg_latency, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1",
    "detect_behaviour": f"WITH c AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS bucket, count(*) AS n, sum(value) AS tokens, count(*) FILTER (event_type = 'error') AS violations FROM events GROUP BY 1, 2), h AS (SELECT user_id, bucket, {_hit} AS k, {_load} AS load FROM c) SELECT user_id, bucket, k::BIGINT AS n_signatures, CASE WHEN k > 0 THEN round(least(1, load + CASE WHEN k >= 2 THEN 0.1::DOUBLE ELSE 0 END), 2) ELSE 0 END::DOUBLE AS risk_score FROM h",
    "ml_softmax": "WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: exp(x - list_max(embedding::DOUBLE[]))) AS e FROM embeddings) SELECT vec_id, list_position(e, list_max(e))::BIGINT - 1 AS label, round(list_max(e) / list_sum(e), 6) AS confidence FROM e",
    "ml_sigmoid_violations": "WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: 1.0 / (1.0 + exp(-x))) AS p FROM embeddings) SELECT vec_id, len(list_filter(p, lambda x: x >= 0.55))::BIGINT AS n_violations, len(list_filter(p, lambda x: x >= 0.6)) > 0 AS exceeds FROM e",
    "cache_dedupe": "SELECT count(*) AS total, count(DISTINCT text) AS distinct_texts, round(1 - count(DISTINCT text)::DOUBLE / count(*), 6) AS hit_rate FROM documents",
    "decision_events": f"SELECT doc_id, 'prompt-injection' AS agent_id, sha256({seeded_sql('injection')}) AS inputs_hash, risk_score, severity FROM ({_D['detect_injection']}) JOIN documents USING (doc_id)",
    "vault_live_sessions": "WITH v AS (SELECT user_id AS session_id, '[' || event_type || '_' || (event_id % 3) || ']' AS p, max(ts + INTERVAL 1 DAY) AS e FROM events WHERE ts + INTERVAL 1 DAY < TIMESTAMP '2024-01-21 12:00:00' GROUP BY 1, 2) SELECT session_id, count(*) AS n_live FROM v WHERE e >= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1",
    "vault_cleanup": "SELECT count(*) FILTER (ts + INTERVAL 1 DAY < TIMESTAMP '2024-01-20 12:00:00') AS n_expired FROM events",
    "point_lookup": "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = 7",
}

_pages = f"d AS (SELECT page_id, url || ' ' || ([{scan_oracles._items}])[page_id % {len(PHRASES['urls'])} + 1] AS text FROM pages)"
_urls = _S["scan_malicious_urls"].replace(_pages, docs("toxicity")).replace("page_id", "doc_id").replace("contains(lower(u), 'bit.ly/x')", "false")
_OUT = [_part("scan_sensitive_counts", "toxicity", "pii", _S), f"SELECT doc_id, risk_score::DOUBLE AS r, risk_score <= 0 AS v FROM ({_urls})", _part("scan_no_refusal", "toxicity", "refusal", _S)]
ORACLES["pipe_preset_standard_output"] = _combined(_OUT, 0.9) + f" SELECT *, {_SEV} FROM z"
