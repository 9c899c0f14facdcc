"""Browser rules, line scans, pipeline settings and reports over the driver tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import browser as B
from ..operators import browser, metrics, pipeline, scanners, spans, text_agents
from ..sources import lines
from . import report_queries as rq
from . import scan_oracles
from .scan_oracles import docs, n_of, q
from .scan_queries import R, _documents, table
from .seeds import seeded_sql

KINDS = ("email", "phone", "ssn", "credit-card", "ip-address", "passport", "drivers-license")
JUDGED = ["n", "risk_score", "is_valid", "severity"]


def _seeded(spark, sf_dir, family: str, *more: str) -> DataFrame:
    return rq._docs(spark, sf_dir, family, *more)


def scan_core(spark, sf_dir):
    v = browser.core_scan(F.col("text"))
    return _seeded(spark, sf_dir, "secrets").select("doc_id", v["injection"].alias("injection"), v["n_secrets"].cast("long").alias("n_secrets"), v["risk_score"].alias("risk_score"), v["is_valid"].alias("is_valid"))


def hash_texts(spark, sf_dir):
    """The rolling hash as a number, since SQL has no base 36."""
    return table(spark, sf_dir, "documents").select("doc_id", F.conv(browser.hash_text(F.col("text")), 36, 10).cast("long").alias("hash"))


def _lines(spark, sf_dir) -> DataFrame:
    return lines.scan_lines(_seeded(spark, sf_dir, "secrets").select(F.col("doc_id").cast("string").alias("file"), "text"))


def source_lines(spark, sf_dir):
    found = _lines(spark, sf_dir)
    return found.groupBy("category", "type", "severity").agg(F.count("*").alias("n"), F.countDistinct("file").alias("n_files"), F.max("line").cast("long").alias("last_line"), F.sum("column").alias("columns"), F.sum(F.length("preview")).alias("preview_length"))


def source_line_summary(spark, sf_dir):
    return lines.summary(_lines(spark, sf_dir))


def _scanned(spark, sf_dir, family="toxicity", *more: str) -> DataFrame:
    return pipeline.Guard.preset("standard").short_circuit(None).scan(_seeded(spark, sf_dir, family, *more))


def pipe_thresholds(spark, sf_dir):
    """Valid under the registry: secrets .9, toxicity .7, injection .8, others .5."""
    out = _scanned(spark, sf_dir).select("doc_id", pipeline.under_thresholds(F.col("results")).alias("results"))
    return out.select("doc_id", F.size(F.filter("results", lambda r: ~r.is_valid)).cast("long").alias("n_over"), F.forall("results", lambda r: r.is_valid).alias("is_valid"))


def pipe_settings(spark, sf_dir):
    """The standard preset under production settings: each distinct text scanned once, eight scanners before it may stop."""
    out = pipeline.Guard.preset("standard").configured("production").scan(_seeded(spark, sf_dir, "toxicity"))
    return out.select("doc_id", F.col("n_results").cast("long").alias("n_results"), R(F.col("risk_score")).alias("risk_score"), "is_valid", "severity")


def pipe_batch_report(spark, sf_dir):
    out = pipeline.batch_report(_scanned(spark, sf_dir), most=4000)
    return out.select("success_count", "failure_count", "n_valid", "n_invalid", R(F.col("max_risk")).alias("max_risk"))


def pipe_hooks(spark, sf_dir):
    action = F.element_at(F.array(*map(F.lit, ["continue", "approve", "reject", "modify"])), (F.col("doc_id") % 4 + 1).cast("int"))
    out = pipeline.apply_hooks(_scanned(spark, sf_dir), action, -0.25)
    return out.select("doc_id", "hook_action", R(F.col("risk_score")).alias("risk_score"), "is_valid")


def pipe_limits(spark, sf_dir):
    v = pipeline.within_limits(F.col("text"), F.col("doc_id") % 2000, F.col("doc_id") % 4)
    return table(spark, sf_dir, "documents").select("doc_id", v["tokens"].alias("tokens"), v["is_valid"].alias("is_valid"))


def pipe_hybrid(spark, sf_dir):
    """Toxicity's risk where it is clear, else the injection scanner's as a model that fails on every seventh text."""
    a, b = scanners.toxicity(F.col("text"))["risk_score"], scanners.prompt_injection(F.col("text"))["risk_score"]
    model = F.when(F.col("doc_id") % 7 != 0, b)
    h = pipeline.hybrid(a, model, safe=-1.0, risky=0.85)
    both = pipeline.hybrid(a, model, "both")
    return _seeded(spark, sf_dir, "toxicity").select("doc_id", R(h["risk_score"]).alias("risk_score"), h["method"].alias("method"), R(both["risk_score"]).alias("both_risk"), both["method"].alias("both_method"))


def _guesses(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang", scanners.language(F.col("text"))["code"].alias("code")).filter("lang is not null and code is not null")


def report_accuracy_by_class(spark, sf_dir):
    by = metrics.accuracy_by_class(_guesses(spark, sf_dir), F.col("lang"), F.col("code"))
    return by.select("label", "support", *(R(F.col(c)).alias(c) for c in ("precision", "recall", "f1")))


def report_accuracy_weighted(spark, sf_dir):
    return metrics.weighted_accuracy(_guesses(spark, sf_dir), F.col("lang"), F.col("code")).select(*(R(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


def report_confusion(spark, sf_dir):
    return metrics.confusion(_guesses(spark, sf_dir), F.col("lang"), F.col("code"))


def metric_tier_limits(spark, sf_dir):
    """Requests a day against each user's tier, its limits divided by 10000 to bite."""
    tier = F.element_at(F.array(*map(F.lit, metrics.TIERS)), (F.col("user_id") % len(metrics.TIERS) + 1).cast("int"))
    day = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("bucket")).agg(F.count("*").alias("n")).withColumn("tier", tier)
    out = day.join(F.broadcast(metrics.tier_limits(spark)), "tier")  # three rows
    return out.groupBy("tier").agg(F.count("*").alias("n_days"), F.count_if(F.col("n") > F.col("per_day") / 10000).alias("n_over"), F.max("n").alias("most"))


def metric_permits(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("begins"), (F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 96).cast("int"), secs=F.lit(1))).alias("ends"))
    return metrics.concurrent_permits(e, 2).groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("denied"))


def cache_lru(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.sha2(F.concat_ws(":", "event_type", (F.col("event_id") % 5).cast("string")), 256).alias("text_hash"))
    return metrics.cache_trace(e, 4, 5 * 86400).groupBy("user_id").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


BOUNDS = (0.0, 1.0, 5.0, 10.0, 50.0, 100.0, float("inf"))


def metric_histogram_quantile(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "value", F.explode(F.array(*map(F.lit, BOUNDS))).alias("le"))
    buckets = e.groupBy("event_type", "le").agg(F.count_if(F.col("value") <= F.col("le")).alias("n"))
    parts = [metrics.histogram_quantile(buckets, p, ("event_type",)).select("event_type", R(F.col("quantile")).alias(n)) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    return parts[0].join(parts[1], "event_type").join(parts[2], "event_type")


def metric_inference_ratios(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("model")).agg(
        F.count("*").alias("t"), F.count_if(F.col("event_type") != "view").alias("m"), F.count_if(F.col("event_type") == "view").alias("h"), F.count_if(F.col("event_type") == "click").alias("s"), F.floor(F.sum("value")).alias("ms"), F.count_if(F.col("event_type") == "error").alias("x")
    )
    v = metrics.inference_ratios(*(F.col(c) for c in ("t", "m", "h", "s", "ms", "x")))
    return e.select("model", *(R(c).alias(n) for n, c in v.items()))


CLAIMS = [("click", "2x"), ("view", ">0.5X"), ("error", "0.5-1.5x"), ("purchase", "none"), ("signup", "1.0-x")]


def metric_claims(spark, sf_dir):
    """Mean values of even users against those of odd ones, by kind of event and weekday, under claims of every form."""
    e = table(spark, sf_dir, "events").withColumn("test_name", F.dayofweek("ts").cast("string")).withColumn("category", F.col("event_type"))
    run = lambda odd: e.filter(F.col("user_id") % 2 == odd).groupBy("category", "test_name").agg(F.avg("value").alias("mean_ms"))
    claims = spark.createDataFrame(CLAIMS, "category string, claim string")
    out = metrics.compare_runs(run(0), run(1), claims)
    return out.select("category", "test_name", R(F.col("factor")).alias("factor"), "validated")


def metric_claim_categories(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("test_name", F.dayofweek("ts").cast("string")).withColumn("category", F.col("event_type"))
    run = lambda odd: e.filter(F.col("user_id") % 2 == odd).groupBy("category", "test_name").agg(F.avg("value").alias("mean_ms"))
    return metrics.claims_by_category(metrics.compare_runs(run(0), run(1), spark.createDataFrame(CLAIMS, "category string, claim string")))


def _vaulted(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.when(F.col("user_id") % 2 == 0, "sess_").otherwise(""), F.col("user_id").cast("string")).alias("session_id"), F.col("event_type").alias("entity_type"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("expires_at"))


def audit_log(spark, sf_dir):
    out = spans.audit_rows(_vaulted(spark, sf_dir), F.lit(rq._NOW).cast("timestamp"))
    return out.groupBy("event_type", "session", "entity_type").agg(F.sum("n").alias("n"))


def anon_session_roundtrip(spark, sf_dir):
    """Sessions of many documents: every text comes back as it was."""
    d = _seeded(spark, sf_dir, "pii").withColumn("session", F.concat(F.lit("s"), (F.col("doc_id") % 20).cast("string")))
    done, mapping = spans.anonymise(d, "session", order=("doc_id",), stored=True)
    return spans.deanonymise(done, mapping, "session").select("doc_id", (F.col("restored") == F.col("text")).alias("equal"))


def anon_session_counters(spark, sf_dir):
    """Placeholders of each session and kind: as many as the greatest number, so none stands for two."""
    d = _seeded(spark, sf_dir, "pii").withColumn("session", F.col("doc_id") % 20)
    _, mapping = spans.anonymise(d, "session", order=("doc_id",))
    number = F.regexp_extract("placeholder", r"_([0-9]+)\]$", 1).cast("long")
    by = mapping.groupBy("session_id", "entity_type").agg(F.count("*").alias("n"), F.countDistinct("placeholder").alias("names"), F.max(number).alias("most"))
    return by.select("session_id", "entity_type", "n", ((F.col("n") == F.col("names")) & (F.col("n") == F.col("most"))).alias("dense"))


def detect_abuse_risk(spark, sf_dir):
    v = text_agents.abuse_risk(F.col("text"))
    return _seeded(spark, sf_dir, "abuse").select("doc_id", v.alias("v")).select("doc_id", F.col("v.n").cast("long").alias("n"), F.col("v.risk_score").alias("risk_score"), F.col("v.severity").alias("severity"))


_NAMES = """scan_core hash_texts source_lines source_line_summary pipe_thresholds pipe_settings pipe_batch_report pipe_hooks pipe_limits pipe_hybrid report_accuracy_by_class
report_accuracy_weighted report_confusion metric_tier_limits metric_permits cache_lru metric_histogram_quantile metric_inference_ratios metric_claims metric_claim_categories audit_log
anon_session_roundtrip anon_session_counters detect_abuse_risk""".split()
QUERIES = {n: globals()[n] for n in _NAMES}
QUERIES |= {
    "scan_sdk_pii": _documents("pii", lambda t: browser.sdk_pii(t, KINDS), [*JUDGED, "n_email", "n_phone", "n_ssn", "n_credit_card", "n_ip_address"]),
    "scan_sdk_pii_default": _documents("pii", browser.sdk_pii, JUDGED),
    "scan_sdk_toxicity": _documents("topics", browser.sdk_toxicity, JUDGED),
    "scan_sdk_toxicity_custom": _documents("toxicity", lambda t: browser.sdk_toxicity(t, tuple(c for c, _, _ in B.SDK_TOXICITY), ("moron", "watch out"), ("racist",)), JUDGED),
    "scan_sdk_injection": _documents("injection", browser.sdk_injection, JUDGED),
}


def _risk(factors: list[tuple[str, str, str]], more: str = "") -> str:
    """SELECT of JUDGED from c by factors (count, severity, confidence)."""
    kinds = " + ".join(f"({n} > 0)::INT" for n, _, _ in factors)
    load = " + ".join(f"CASE WHEN {n} > 0 THEN {browser.WEIGHT[s]}::DOUBLE * {c} ELSE 0 END" for n, s, c in factors)
    worst = " ".join(f"WHEN {' OR '.join(f'{n} > 0' for n, x, _ in factors if x == s)} THEN '{s}'" for s in ("critical", "high", "medium", "low") if any(x == s for _, x, _ in factors))
    return f"SELECT doc_id, {' + '.join(n for n, _, _ in factors)} AS n, round(CASE WHEN {kinds} > 0 THEN least(1, ({load}) / ({kinds})) ELSE 0 END, 6)::DOUBLE AS risk_score, {kinds} = 0 AS is_valid, CASE {worst} ELSE 'none' END AS severity{more} FROM c"


_digits = "regexp_replace(x, '[^0-9]', '', 'g')"
_area = f"len({_digits}) = 9 AND {_digits}[1:3]::INT NOT IN (0, 666) AND {_digits}[1:3]::INT < 900"
_sum = f"list_sum(list_transform(range(1, len({_digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {_digits}[-i]::INT WHEN {_digits}[-i]::INT > 4 THEN {_digits}[-i]::INT * 2 - 9 ELSE {_digits}[-i]::INT * 2 END)) % 10 = 0"


def _pii_sql(kinds, more=()) -> str:
    rows = [r for r in B.SDK_PII if r[1] in kinds]
    valid = {"credit-card": _sum, "ssn": _area}
    n = [f"len(list_filter(regexp_extract_all(text, {q(p)}), lambda x: {valid[k]}))" if k in valid else n_of(p) for _, k, _, p in rows]
    counts = ", ".join(f"{c} AS c{i}" for i, c in enumerate(n))
    extra = "".join(", " + " + ".join(f"c{i}" for i, r in enumerate(rows) if r[1] == k) + f" AS n_{k.replace('-', '_')}" for k in more)
    return f"WITH {docs('pii')}, c AS (SELECT doc_id, {counts} FROM d) " + _risk([(f"c{i}", r[2], "0.9::DOUBLE") for i, r in enumerate(rows)], extra)


def _toxicity_sql(family, rows, allowed=()) -> str:
    one = lambda p: f"len(list_filter(regexp_extract_all(text, {q(p)}), lambda x: lower(x) NOT IN ({', '.join(map(q, allowed)) or q('')})))"
    counts = ", ".join(" + ".join(map(one, ps)) + f" AS c{i}" for i, (_, _, ps) in enumerate(rows))
    return f"WITH {docs(family)}, c AS (SELECT doc_id, {counts} FROM d) " + _risk([(f"c{i}", s, f"least(0.95::DOUBLE, 0.6::DOUBLE + c{i} * 0.05::DOUBLE)") for i, (_, s, _) in enumerate(rows)])


_found = []
for _p in B.LINE_INJECTION:
    _found.append(("Prompt Injection Attempt", "prompt-injection", "high", _p, 50, True))
_found += [(t, "secret", s, p, 20, False) for t, s, p in B.LINE_SECRETS] + [(t, "pii", s, p, 4, False) for t, s, p in B.LINE_PII]
_found += [("Potentially Toxic Content", "toxicity", "medium", p, 0, True) for p in B.LINE_TOXICITY]


def _line_rows(kind, category, severity, p, keep, first) -> str:
    m = f"regexp_extract_all(s, {q(p)})"
    shown = {50: "left(m, 50) || CASE WHEN length(m) > 50 THEN '...' ELSE '' END", 0: "m"}.get(keep, f"left(m, {keep}) || '****'")
    if first:
        return f"SELECT file, line, {q(kind)} AS type, '{category}' AS category, '{severity}' AS severity, strpos(s, m) AS col, {shown} AS preview FROM (SELECT file, line, s, {m}[1] AS m FROM l) WHERE m IS NOT NULL"
    pieces = f"string_split_regex(s, {q(p)})"
    at = "list_sum(list_transform(b[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(a[1:i - 1], lambda x: length(x))), 0)::BIGINT + 1"
    return f"SELECT file, line, {q(kind)}, '{category}', '{severity}', {at}, {shown} FROM (SELECT file, line, a, b, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS m FROM (SELECT file, line, {m} AS a, {pieces} AS b FROM l) WHERE len(a) > 0)"


_LINES = f"WITH {docs('secrets')}, l AS (SELECT doc_id::VARCHAR AS file, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS s FROM d), f AS (" + " UNION ALL ".join(_line_rows(*r) for r in _found) + ")"
_std = rq._combined(rq._STD, None)
_lang = scan_oracles.ORACLES["scan_language"]
_pairs = f"g AS (SELECT lang AS t, code AS p FROM ({_lang}) JOIN documents USING (doc_id) WHERE lang IS NOT NULL)"
_classes = f"WITH {_pairs}, c AS (SELECT t AS label FROM g UNION SELECT p FROM g), m AS (SELECT label, (SELECT count(*) FROM g WHERE t = label) AS support, (SELECT count(*) FROM g WHERE p = label) AS guessed, (SELECT count(*) FROM g WHERE t = label AND p = label) AS hit FROM c), r AS (SELECT label, support, coalesce(hit::DOUBLE / nullif(guessed, 0), 0) AS precision, coalesce(hit::DOUBLE / nullif(support, 0), 0) AS recall FROM m), s AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r)"
_runs = "WITH e AS (SELECT event_type AS category, (dayofweek(ts) + 1)::VARCHAR AS test_name, user_id % 2 AS odd, value FROM events), a AS (SELECT category, test_name, avg(value) AS v FROM e WHERE odd = 0 GROUP BY 1, 2), b AS (SELECT category, test_name, avg(value) AS v FROM e WHERE odd = 1 GROUP BY 1, 2), k(category, claim) AS (VALUES " + ", ".join(f"({q(c)}, {q(k)})" for c, k in CLAIMS) + "), j AS (SELECT category, test_name, a.v / nullif(b.v, 0) AS factor, replace(replace(claim, 'x', ''), 'X', '') AS k FROM a JOIN b USING (category, test_name) JOIN k USING (category)), o AS (SELECT category, test_name, factor, coalesce(CASE WHEN contains(k, '-') THEN len(string_split(k, '-')) = 2 AND factor >= coalesce(try_cast(trim(split_part(k, '-', 1)) AS DOUBLE), 0) AND factor <= coalesce(try_cast(trim(split_part(k, '-', 2)) AS DOUBLE), 'inf'::DOUBLE) WHEN starts_with(k, '>') THEN factor > coalesce(try_cast(trim(k[2:]) AS DOUBLE), 0) ELSE factor >= coalesce(try_cast(trim(k) AS DOUBLE), 0) END, false) AS validated FROM j)"
_inf = ", ".join("'inf'::DOUBLE" if b == float("inf") else f"{b}::DOUBLE" for b in BOUNDS)
_quantile = lambda p: f"(SELECT round(v, 6) FROM (SELECT CASE WHEN le = 'inf'::DOUBLE THEN low WHEN le <= 0 THEN le ELSE low + (le - low) * (total * {p}::DOUBLE - below) / (n - below) END AS v, le FROM h WHERE h.event_type = x.event_type AND n > 0 AND n >= total * {p}::DOUBLE) ORDER BY le LIMIT 1)"
_cut = "CASE WHEN length(s) <= 8 THEN left(s, 4) ELSE left(s, 8) END || '****'"
_tox, _inj = scan_oracles.ORACLES["scan_toxicity"], scan_oracles.ORACLES["scan_prompt_injection"].replace(docs("injection"), docs("toxicity"))
_tiers = ", ".join(f"({i}, '{t}', {v[2]})" for i, (t, v) in enumerate(metrics.TIERS.items()))

ORACLES = {
    "scan_core": f"WITH {docs('secrets')}, c AS (SELECT doc_id, {' OR '.join(f'regexp_matches(text, {q(p)})' for p in B.CORE_INJECTION)} AS injection, {' + '.join(n_of(p) for _, p in B.CORE_SECRETS)} AS n_secrets FROM d) SELECT doc_id, injection, n_secrets, CASE WHEN n_secrets > 0 THEN 1.0::DOUBLE WHEN injection THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS risk_score, NOT (injection OR n_secrets > 0) AS is_valid FROM c",
    "hash_texts": "SELECT doc_id, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)::BIGINT AS hash FROM (SELECT doc_id, list_reduce([0::BIGINT] || flatten(list_transform(string_split(text, ''), lambda c: CASE WHEN unicode(c) < 65536 THEN [greatest(unicode(c), 0)::BIGINT] ELSE [55296 + ((unicode(c) - 65536) // 1024)::BIGINT, 56320 + ((unicode(c) - 65536) % 1024)::BIGINT] END)), lambda h, u: (h * 31 + u) % 4294967296) AS h FROM documents)",
    "scan_sdk_pii": _pii_sql(KINDS, KINDS[:5]),
    "scan_sdk_pii_default": _pii_sql(B.SDK_PII_KINDS),
    "scan_sdk_toxicity": _toxicity_sql("topics", [r for r in B.SDK_TOXICITY if r[0] in B.SDK_TOXICITY_CATEGORIES]),
    "scan_sdk_toxicity_custom": _toxicity_sql("toxicity", [*B.SDK_TOXICITY, ("custom", "medium", [r"(?i)\b(moron|watch out)\b"])], ("racist",)),
    "scan_sdk_injection": f"WITH {docs('injection')}, c AS (SELECT doc_id, {' + '.join(n_of(p) for p in B.SDK_INJECTION)} AS c0 FROM d) " + _risk([("c0", "high", "least(0.9::DOUBLE, 0.5::DOUBLE + c0 * 0.1::DOUBLE)")]),
    "source_lines": _LINES + " SELECT category, type, severity, count(*) AS n, count(DISTINCT file) AS n_files, max(line)::BIGINT AS last_line, sum(col)::BIGINT AS columns, sum(length(preview))::BIGINT AS preview_length FROM f GROUP BY 1, 2, 3",
    "source_line_summary": _LINES + " SELECT count(DISTINCT file) AS n_files, count(*) AS n_issues, count(*) FILTER (category = 'prompt-injection') AS prompt_injection, count(*) FILTER (category = 'secret') AS secrets, count(*) FILTER (category = 'pii') AS pii, count(*) FILTER (category = 'toxicity') AS toxicity, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS n_{s}" for s in ("critical", "high", "medium", "low")) + " FROM f",
    "pipe_thresholds": _std + ", o AS (SELECT doc_id, " + " + ".join(f"(p{i}.r >= {t} - 1e-6)::INT" for i, t in enumerate((0.9, 0.7, 0.8, 0.5, 0.5))) + " AS k FROM p0 " + " ".join(f"JOIN p{i} USING (doc_id)" for i in range(1, 5)) + ") SELECT doc_id, k::BIGINT AS n_over, k = 0 AS is_valid FROM o",
    "pipe_settings": rq.ORACLES["pipe_preset_standard_all"],
    "pipe_batch_report": _std + f", o AS (SELECT z.*, length(text) > 0 AND length(text) <= 4000 AS ok FROM z JOIN (SELECT doc_id, {seeded_sql('toxicity')} AS text FROM documents) USING (doc_id)) SELECT count(*) FILTER (ok) AS success_count, count(*) FILTER (NOT ok) AS failure_count, count(*) FILTER (ok AND is_valid) AS n_valid, count(*) FILTER (ok AND NOT is_valid) AS n_invalid, max(risk_score) FILTER (ok) AS max_risk FROM o",
    "pipe_hooks": _std + " SELECT doc_id, ['continue', 'approve', 'reject', 'modify'][doc_id % 4 + 1] AS hook_action, CASE doc_id % 4 WHEN 0 THEN risk_score WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE round(greatest(0, risk_score - 0.25::DOUBLE), 6) END::DOUBLE AS risk_score, CASE doc_id % 4 WHEN 1 THEN true WHEN 2 THEN false ELSE is_valid END AS is_valid FROM z",
    "pipe_limits": r"SELECT doc_id, t AS tokens, t <= 800 AND doc_id % 2000 <= 1500 AND doc_id % 4 <= 2 AS is_valid FROM (SELECT doc_id, ceil((length(text) + len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]'))) / 4.0)::BIGINT AS t FROM documents)",
    "pipe_hybrid": f"WITH a AS (SELECT doc_id, risk_score AS h FROM ({_tox})), b AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN risk_score END AS m FROM ({_inj})) SELECT doc_id, (CASE WHEN h >= 0.85 - 1e-6 OR m IS NULL THEN h ELSE m END)::DOUBLE AS risk_score, CASE WHEN h >= 0.85 - 1e-6 THEN 'heuristic_short_circuit' WHEN m IS NULL THEN 'ml_fallback_to_heuristic' ELSE 'ml' END AS method, (CASE WHEN m IS NULL THEN h ELSE greatest(h, m) END)::DOUBLE AS both_risk, CASE WHEN m IS NULL THEN 'ml_fallback_to_heuristic' ELSE 'hybrid_both' END AS both_method FROM a JOIN b USING (doc_id)",
    "report_accuracy_by_class": _classes + " SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM s",
    "report_accuracy_weighted": _classes + " SELECT round(sum(recall * support) / sum(support), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM s",
    "report_confusion": f"WITH {_pairs} SELECT t AS label, p AS predicted, count(*) AS n FROM g GROUP BY 1, 2",
    "metric_tier_limits": f"WITH t(i, tier, per_day) AS (VALUES {_tiers}), c AS (SELECT user_id, date_trunc('day', ts) AS bucket, count(*) AS n FROM events GROUP BY 1, 2) SELECT tier, count(*) AS n_days, count(*) FILTER (n > per_day / 10000.0) AS n_over, max(n) AS most FROM c JOIN t ON user_id % {len(metrics.TIERS)} = i GROUP BY 1",
    "metric_histogram_quantile": f"WITH u AS (SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, (SELECT unnest([{_inf}]) AS le) GROUP BY 1, 2), h AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS below, max(n) OVER (PARTITION BY event_type) AS total FROM u WINDOW w AS (PARTITION BY event_type ORDER BY le)) SELECT event_type, {_quantile(0.5)} AS p50, {_quantile(0.95)} AS p95, {_quantile(0.99)} AS p99 FROM (SELECT DISTINCT event_type FROM events) x",
    "metric_inference_ratios": "SELECT user_id % 10 AS model, round(count(*) FILTER (event_type = 'view')::DOUBLE / count(*), 6) AS cache_hit_rate, round(count(*) FILTER (event_type = 'click')::DOUBLE / count(*), 6) AS heuristic_filter_rate, round(floor(sum(value))::DOUBLE / count(*), 6) AS avg_inference_ms, round(coalesce(count(*) FILTER (event_type = 'error')::DOUBLE / nullif(count(*) FILTER (event_type <> 'view'), 0), 0), 6) AS ml_error_rate FROM events GROUP BY 1",
    "metric_claims": _runs + " SELECT category, test_name, round(factor, 6) AS factor, validated FROM o",
    "metric_claim_categories": _runs + " SELECT category, count(*) AS n_tests, bool_and(validated) AS passed FROM o GROUP BY 1",
    "audit_log": f"WITH v AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'sess_' ELSE '' END || user_id AS s, event_type AS k, ts + INTERVAL 1 DAY AS e FROM events), r AS (SELECT 'anonymize_start' AS event_type, s, NULL AS entity_type FROM v UNION ALL SELECT 'anonymize_complete', s, NULL FROM v UNION ALL SELECT 'vault_store', s, k FROM v UNION ALL SELECT 'vault_expire', s, NULL FROM v WHERE e < TIMESTAMP '{rq._NOW}') SELECT event_type, {_cut} AS session, entity_type, count(*) AS n FROM r GROUP BY 1, 2, 3",
    "anon_session_roundtrip": "SELECT doc_id, true AS equal FROM documents",
}
