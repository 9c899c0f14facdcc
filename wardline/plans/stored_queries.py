"""Stored rollups that late batches renew, their percentiles, and alert transitions over ``events``, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, tagging
from ..sources import tables
from ..sources.scratch import work_folder
from ..streaming.aggregate import RollupTable
from .scan_queries import R, table

#: Batches that a table takes in, by a hash of the event: each holds rows of all times, so all but the first are late.
BATCHES = 4
POINTS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def _stored(spark, sf_dir, bucket: str, sketch: bool) -> RollupTable:
    events = table(spark, sf_dir, "events").withColumn("batch", F.pmod(F.xxhash64("event_id"), F.lit(BATCHES)))
    rollup = RollupTable(spark, f"{work_folder(spark)}/rollup", bucket, sketch=sketch)
    for k in range(BATCHES):
        rollup.apply(events.filter(F.col("batch") == k), k)
    rollup.apply(events.filter(F.col("batch") == BATCHES - 1), BATCHES - 1)  # comes again, as after a failure
    return rollup


def rollup_refreshed(spark, sf_dir):
    """The table after late batches and a repeated one: the rollup of all events."""
    out = _stored(spark, sf_dir, "1 hour", False).read()
    return out.select("bucket", "event_type", R("avg").alias("avg"), "max", "min", "n")


def rollup_percentiles(spark, sf_dir):
    """Percentiles by event type from merged sketches; each point's rank among the values is within 2 in a hundred."""
    told = _stored(spark, sf_dir, "1 day", True).percentiles(POINTS)
    values = table(spark, sf_dir, "events").select("event_type", "value").join(told.select("event_type", *POINTS), "event_type")
    ranks = values.groupBy("event_type").agg(F.count("*").alias("n"), *((F.count_if(F.col("value") <= F.col(p)) / F.count("*")).alias(p) for p in POINTS))
    return ranks.select("event_type", "n", *((F.abs(F.col(p) - q) <= 0.02).alias(f"{p}_within") for p, q in POINTS.items()))


# Rules over hourly counts: (rule_id, metric, operator, threshold, for_buckets).
RULES = [("r1", "error", "gt", 3.0, 1), ("r2", "click", "ge", 2.0, 3), ("r3", "view", "lt", 3.0, 2)]


def metric_alert_transitions(spark, sf_dir):
    """Where each rule turns pending, firing and resolved over hourly counts."""
    hours = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric"), F.date_trunc("hour", "ts").alias("bucket")).agg(F.count("*").cast("double").alias("value"))
    rules = spark.createDataFrame(RULES, "rule_id string, metric string, operator string, threshold double, for_buckets int")
    return metrics.alert_transitions(hours, rules).select("rule_id", "at", "state", "value")


def table_range(spark, sf_dir):
    """Counts by user of January's first week, from a table in partitions of a day of which only that week's are read."""
    at = f"{work_folder(spark)}/events"
    tables.write_partitioned(table(spark, sf_dir, "events"), at, sort=("user_id", "ts"), lookup={"event_id": 10_000})
    week = tables.between(spark.read.parquet(at), F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-08").cast("timestamp"))
    return week.groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first"), R(F.sum("value")).alias("total"))


#: Labels of words by their lengths: logits that no single label wins by far.
KINDS = ("NAME", "PLACE")


def anon_bio_constrained(spark, sf_dir):
    """The best BIO labels of the words of each turn, whose logits follow from the words' lengths."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    labels = tagging.bio_labels(KINDS)
    logit = lambda j: ((F.length("word") * (2 * j + 3) + F.col("pos") * (j + 1)) % 11) / F.lit(2.0)
    tokens = words.select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "pos", F.lit(0).alias("start"), F.lit(1).alias("end"), F.array(*map(logit, range(len(labels)))).alias("logits"))
    told = tagging.constrained_labels(tokens, labels)
    return told.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x.label), " ").alias("labels"))


QUERIES = {f.__name__: f for f in (rollup_refreshed, rollup_percentiles, metric_alert_transitions, table_range, anon_bio_constrained)}

_labels = tagging.bio_labels(KINDS)
_logits = "[" + ", ".join(f"((length(word) * {2 * j + 3} + pos * {j + 1}) % 11) / 2.0::DOUBLE" for j in range(len(_labels))) + "]"
_best = "list_position(s, list_max(s))"
# the place before each label on the best way to it: anything before O and B, its own B or I before I
_from = "[" + ", ".join(f"CASE WHEN s[{j}] >= s[{j + 1}] THEN {j} ELSE {j + 1} END" if x.startswith("I") else _best for j, x in enumerate(_labels)) + "]"

_rules = ", ".join(f"('{i}', '{m}', '{op}', {t}, {k})" for i, m, op, t, k in RULES)

ORACLES = {
    "table_range": "SELECT user_id, count(*) AS n, min(ts) AS first, round(sum(value), 6) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-08' GROUP BY 1",
    "anon_bio_constrained": f"""
        WITH RECURSIVE w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT conv_id || ':' || turn AS doc_id, string_split(text, ' ') AS w FROM conversations)),
        l AS (SELECT doc_id, pos, {_logits} AS x FROM w),
        v AS (
            SELECT doc_id, pos, list_transform(x, lambda y, j: CASE WHEN j IN ({", ".join(str(j + 1) for j, x in enumerate(_labels) if x.startswith("I"))}) THEN '-inf'::DOUBLE ELSE y END) AS s, list_transform(range(1, {len(_labels) + 1}), lambda j: [j]) AS p FROM l WHERE pos = 0
            UNION ALL
            SELECT doc_id, pos, list_transform(b, lambda k, j: s[k] + x[j]), list_transform(b, lambda k, j: list_append(p[k], j)) FROM (SELECT l.doc_id, l.pos, x, s, p, {_from} AS b FROM v JOIN l ON l.doc_id = v.doc_id AND l.pos = v.pos + 1)
        )
        SELECT doc_id, array_to_string(list_transform(p[{_best}], lambda j: ({_labels})[j]), ' ') AS labels FROM v WHERE pos = (SELECT max(pos) FROM l WHERE l.doc_id = v.doc_id)""",
    "rollup_refreshed": "SELECT date_trunc('hour', ts) AS bucket, event_type, round(avg(value), 6) AS avg, max(value) AS max, min(value) AS min, count(*) AS n FROM events GROUP BY 1, 2",
    "rollup_percentiles": f"SELECT event_type, count(*) AS n, {', '.join(f'true AS {p}_within' for p in POINTS)} FROM events GROUP BY 1",
    "metric_alert_transitions": f"""
        WITH h AS (SELECT event_type AS metric, date_trunc('hour', ts) AS bucket, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2), r(rule_id, metric, op, threshold, k) AS (VALUES {_rules}),
        j AS (SELECT rule_id, bucket, value, k, CASE op WHEN 'gt' THEN value > threshold WHEN 'ge' THEN value >= threshold ELSE value < threshold END AS holds FROM h JOIN r USING (metric)),
        c AS (SELECT *, coalesce(bucket - lag(bucket) OVER w = INTERVAL '1 hour' AND lag(holds) OVER w, false) AS goes_on, lead(bucket) OVER w AS after, lead(value) OVER w AS after_value FROM j WINDOW w AS (PARTITION BY rule_id ORDER BY bucket)),
        s AS (SELECT *, sum((NOT goes_on)::INT) OVER (PARTITION BY rule_id ORDER BY bucket) AS run FROM c WHERE holds),
        n AS (SELECT *, row_number() OVER (PARTITION BY rule_id, run ORDER BY bucket) AS held, lead(bucket) OVER (PARTITION BY rule_id, run ORDER BY bucket) IS NULL AS last FROM s)
        SELECT rule_id, bucket AS at, 'pending' AS state, value FROM n WHERE held = 1
        UNION ALL SELECT rule_id, bucket, 'firing', value FROM n WHERE held = k
        UNION ALL SELECT rule_id, bucket + INTERVAL '1 hour', 'resolved', CASE WHEN after = bucket + INTERVAL '1 hour' THEN after_value END FROM n WHERE last AND held >= k AND after IS NOT NULL""",
}
