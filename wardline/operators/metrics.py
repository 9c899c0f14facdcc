"""Reports over time-stamped events and verdicts: windows, rates, percentiles, alerts, quotas, sessions, accuracy."""

from __future__ import annotations

import heapq
from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import EPSILON


def rollup(events: DataFrame, bucket: str = "1 minute", keys: tuple[str, ...] = ("event_type",), value: str = "value", ts: str = "ts") -> DataFrame:
    """avg, max, min and count of a value by time bucket and keys."""
    w = F.window(ts, bucket)
    return events.groupBy(w.alias("w"), *keys).agg(F.avg(value).alias("avg"), F.max(value).alias("max"), F.min(value).alias("min"), F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), *keys, "avg", "max", "min", "n")


def sliding_ratio(events: DataFrame, bad: Column, window: str = "5 minutes", slide: str = "1 minute", ts: str = "ts") -> DataFrame:
    """Share of bad events and their rate a second in sliding windows."""
    w = F.window(ts, window, slide)
    out = events.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return out.select(F.col("w.start").alias("bucket"), "n", "n_bad", (F.col("n_bad") / F.col("n")).alias("ratio"), (F.col("n") / seconds).alias("rate"))


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Sessions of a key, closed by a gap: start, number of events, last event."""
    w = F.session_window(ts, gap)
    return events.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.max(ts).alias("last")).select(key, F.col("w.start").alias("start"), "n", "last")


def index_percentiles(events: DataFrame, group: str, value: str, points: dict[str, float]) -> DataFrame:
    """Percentiles as the element of 0-based index floor(n q), with mean, deviation and extremes.

    Values are counted first, so the ordered window sees distinct values alone.
    """
    counts = events.groupBy(group, value).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(group).orderBy(value)
    ranked = counts.withColumn("below", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy(group)))
    at = lambda q: F.min(F.when(F.col("below") > F.least(F.floor(F.col("n") * q), F.col("n") - 1), F.col(value)))
    picked = ranked.groupBy(group).agg(*[at(q).alias(name) for name, q in points.items()])
    return picked.join(events.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_dev"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("n")), group)


def compare(value: Column, operator: Column, threshold: Column) -> Column:
    ops = {"gt": value > threshold, "ge": value >= threshold, "lt": value < threshold, "le": value <= threshold, "eq": value == threshold, "ne": value != threshold}
    out = F
    for name, c in ops.items():
        out = out.when(operator == name, c)
    return out.otherwise(F.lit(False))


def evaluate_alerts(series: DataFrame, rules: DataFrame, step_seconds: int = 3600) -> DataFrame:
    """``series`` (metric, bucket, value) against ``rules`` (rule_id, metric, operator, threshold, for_buckets).

    A rule fires where it has held for that many buckets in a row: (rule_id, bucket, value, fired).
    """
    joined = series.join(rules, "metric").withColumn("holds", compare(F.col("value"), F.col("operator"), F.col("threshold")))
    order = Window.partitionBy("rule_id").orderBy("bucket")
    step = (F.unix_timestamp("bucket") - F.unix_timestamp(F.lag("bucket").over(order))) != step_seconds
    breaks = joined.withColumn("cut", (~F.col("holds") | F.coalesce(step, F.lit(True))).cast("int")).withColumn("run", F.sum("cut").over(order))
    held = F.sum(F.col("holds").cast("int")).over(Window.partitionBy("rule_id", "run").orderBy("bucket"))
    return breaks.withColumn("held", held).select("rule_id", "bucket", "value", (F.col("holds") & (F.col("held") >= F.col("for_buckets"))).alias("fired"))


def alert_transitions(series: DataFrame, rules: DataFrame, step_seconds: int = 3600, until: Column | None = None) -> DataFrame:
    """(rule_id, at, state, value): where each rule turns pending, firing or resolved over its ``series``.

    A rule is pending from the first bucket in which it holds, firing from the one that makes ``for_buckets`` in a
    row, and resolved, if it fired, at the first bucket that doesn't hold or is missing; there value is null.  Only
    buckets before ``until`` count; without it nothing is missing after the last one.
    """
    rows = series if until is None else series.filter(F.col("bucket") < until)
    joined = rows.join(rules, "metric").withColumn("holds", compare(F.col("value"), F.col("operator"), F.col("threshold")))
    order = Window.partitionBy("rule_id").orderBy("bucket")
    step = F.make_dt_interval(secs=F.lit(step_seconds))
    gap = F.coalesce(F.lag("bucket").over(order) + step != F.col("bucket"), F.lit(True))
    t = joined.withColumn("begins", F.col("holds") & (gap | ~F.lag("holds").over(order))).withColumn("run", F.sum(F.col("begins").cast("int")).over(order))
    t = t.withColumn("held", F.when(F.col("holds"), F.row_number().over(Window.partitionBy("rule_id", "run", "holds").orderBy("bucket"))))
    t = t.withColumn("next", F.lead("bucket").over(order)).withColumn("next_holds", F.lead("holds").over(order)).withColumn("next_value", F.lead("value").over(order))
    end = F.col("bucket") + step
    missing = (F.col("next") > end) if until is None else ((F.coalesce(F.col("next") > end, F.lit(True))) & (end < until))
    ended = F.col("holds") & (F.col("held") >= F.col("for_buckets"))
    state = lambda name, at, value: F.struct(F.lit(name).alias("state"), at.alias("at"), value.cast("double").alias("value"))
    here = F.filter(
        F.array(
            F.when(F.col("begins"), state("pending", F.col("bucket"), F.col("value"))),
            F.when(F.col("held") == F.greatest(F.col("for_buckets"), F.lit(1)), state("firing", F.col("bucket"), F.col("value"))),
            F.when(ended & missing, state("resolved", end, F.lit(None))).when(ended & (F.col("next") == end) & ~F.col("next_holds"), state("resolved", F.col("next"), F.col("next_value"))),
        ),
        lambda x: x.isNotNull(),
    )
    return t.select("rule_id", F.explode(here).alias("x")).select("rule_id", "x.at", "x.state", "x.value")


def retained(events: DataFrame, keep: str, ts: str = "ts", now: Column | None = None) -> DataFrame:
    """Rows younger than ``keep`` at ``now``, or at the newest row."""
    if now is not None:
        return events.filter(F.col(ts) >= now - F.expr(f"INTERVAL {keep}"))
    newest = events.agg(F.max(ts).alias("__newest"))
    return events.crossJoin(F.broadcast(newest)).filter(F.col(ts) >= F.col("__newest") - F.expr(f"INTERVAL {keep}")).drop("__newest")  # one row


def calendar_quota(events: DataFrame, limit: int, unit: str = "hour", key: str = "user_id") -> DataFrame:
    """Allowed and denied requests by key and calendar window; an approximation of windows anchored at first use."""
    counts = events.groupBy(key, F.date_trunc(unit, "ts").alias("bucket")).agg(F.count("*").alias("n"))
    return counts.select(key, "bucket", F.least("n", F.lit(limit)).alias("allowed"), F.greatest(F.col("n") - limit, F.lit(0)).alias("denied"))


# Requests a minute, hour and day, and at once, by tier.
TIERS = {"free": (100, 1000, 10000, 10), "pro": (1000, 10000, 100000, 50), "enterprise": (10000, 100000, 1000000, 200)}
#: Seconds of the windows: minute, hour, day and a month of 30 days, which is counted and never enforced.
WINDOWS = (60.0, 3600.0, 86400.0, 2592000.0)


def tier_limits(spark: SparkSession) -> DataFrame:
    """(tier, per_minute, per_hour, per_day, concurrent), one row a tier."""
    return spark.createDataFrame([(t, *v) for t, v in TIERS.items()], "tier string, per_minute long, per_hour long, per_day long, concurrent long")


def quota_step(state: list | None, now: float, limits: tuple[int, ...]) -> tuple[list, bool]:
    """State ([window end, count] for each window) and verdict after a request: a window begins at the first request after the last one's end, and only allowed requests count.

    Windows beyond ``limits`` are counted alone.
    """
    state = [[now + w, 0] for w in WINDOWS] if state is None else [[now + w, 0] if now >= end else [end, n] for (end, n), w in zip(state, WINDOWS)]
    ok = all(n < limit for (_, n), limit in zip(state, limits))
    return ([[end, n + 1] for end, n in state] if ok else state), ok


def anchored_quota(events: DataFrame, limits: tuple[int, ...] | str, key: str = "user_id") -> DataFrame:
    """(event_id, key, allowed, month_used) with quota windows anchored at first use, ``limits`` being numbers by window or a tier's name.

    Recursive by nature: each key's rows pass in order of time, one state at a time.
    """
    limits = TIERS[limits][:3] if isinstance(limits, str) else limits

    def run(frames):
        owner, state = object(), None
        for df in frames:
            verdicts, used = [], []
            for k, t in zip(df[key], df["ts"]):
                if k != owner:
                    owner, state = k, None
                state, ok = quota_step(state, t.timestamp(), limits)
                verdicts.append(ok)
                used.append(state[-1][1])
            yield pd.DataFrame({"event_id": df["event_id"], key: df[key], "allowed": verdicts, "month_used": used})

    return events.select("event_id", key, "ts").repartition(key).sortWithinPartitions(key, "ts", "event_id").mapInPandas(run, f"event_id long, {key} long, allowed boolean, month_used long")


def concurrent_permits(intervals: DataFrame, limit: int, key: str = "user_id") -> DataFrame:
    """(event_id, key, allowed) of rows (event_id, key, begins, ends): a request gets one of ``limit`` permits of its key and gives it back at its end; one that gets none holds none."""

    def run(frames):
        owner, held = object(), []
        for df in frames:
            verdicts = []
            for k, a, b in zip(df[key], df["begins"], df["ends"]):
                if k != owner:
                    owner, held = k, []
                while held and held[0] <= a:
                    heapq.heappop(held)
                verdicts.append(len(held) < limit)
                if verdicts[-1]:
                    heapq.heappush(held, b)
            yield pd.DataFrame({"event_id": df["event_id"], key: df[key], "allowed": verdicts})

    return intervals.select("event_id", key, "begins", "ends").repartition(key).sortWithinPartitions(key, "begins", "event_id").mapInPandas(run, f"event_id long, {key} long, allowed boolean")


def cache_trace(requests: DataFrame, size: int, ttl_seconds: float, cache: str = "user_id", key: str = "text_hash") -> DataFrame:
    """(event_id, cache, hit) of requests (event_id, ts, cache, key) to a least-recently-used cache of ``size`` entries that expire.

    A hit makes an entry the newest without prolonging it; a miss stores the key and, if the cache is full of
    others, the entry that was used longest ago goes, expired or not.  Sequential by nature: each cache's requests
    pass in order of time, with ``size`` entries in memory.
    """

    def run(frames):
        owner, entries = object(), OrderedDict()
        for df in frames:
            hits = []
            for c, k, t in zip(df[cache], df[key], df["ts"]):
                if c != owner:
                    owner, entries = c, OrderedDict()
                now = t.timestamp()
                hit = k in entries and now - entries[k] < ttl_seconds
                if hit:
                    entries.move_to_end(k)
                elif size > 0:
                    entries.pop(k, None)
                    if len(entries) >= size:
                        entries.popitem(last=False)
                    entries[k] = now
                hits.append(hit)
            yield pd.DataFrame({"event_id": df["event_id"], cache: df[cache], "hit": hits})

    kind = dict(requests.dtypes)[cache]
    return requests.select("event_id", cache, key, "ts").repartition(cache).sortWithinPartitions(cache, "ts", "event_id").mapInPandas(run, f"event_id long, {cache} {kind}, hit boolean")


def token_bucket(events: DataFrame, per_minute: float, burst: int | None = None, key: str = "user_id") -> DataFrame:
    """(event_id, key, allowed) under a leaky bucket: a request conforms unless it comes more than the burst ahead of its theoretical arrival."""
    gap, room = 60.0 / per_minute, 60.0 / per_minute * ((burst or per_minute) - 1)

    def run(frames):
        owner, due = object(), 0.0
        for df in frames:
            verdicts = []
            for k, t in zip(df[key], df["ts"]):
                now = t.timestamp()
                if k != owner:
                    owner, due = k, now
                due = max(due, now)
                ok = due - now <= room + 1e-9
                due += gap * ok
                verdicts.append(ok)
            yield pd.DataFrame({"event_id": df["event_id"], key: df[key], "allowed": verdicts})

    return events.select("event_id", key, "ts").repartition(key).sortWithinPartitions(key, "ts", "event_id").mapInPandas(run, f"event_id long, {key} long, allowed boolean")


def concurrency(intervals: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, max_overlap) of rows (key, begins, ends): a sweep over beginnings and ends, an end first at equal times."""
    moves = intervals.select(key, F.explode(F.array(F.struct(F.col("begins").alias("t"), F.lit(1).alias("d")), F.struct(F.col("ends").alias("t"), F.lit(-1).alias("d")))).alias("m")).select(key, "m.t", "m.d")
    merged = moves.groupBy(key, "t", "d").agg(F.sum("d").alias("step"))
    order = Window.partitionBy(key).orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
    return merged.withColumn("open", F.sum("step").over(order)).groupBy(key).agg(F.max("open").alias("max_overlap"))


# Weights of severities in behavioural abuse.
BEHAVIOUR_WEIGHT = {"low": 0.1, "medium": 0.25, "high": 0.4, "critical": 0.6}


def behaviour_risk(measures: dict[str, Column], thresholds: list[tuple], scale: float = 1.0) -> dict[str, Column]:
    """Signatures whose measure reaches its threshold, and the risk: confidence grows with the excess up to twice the threshold, two decimals.

    thresholds: (id, category, severity, confidence, measure, threshold); those of measures not given are left out.
    """
    hit, load = F.lit(0), F.lit(0.0)
    for _, _, severity, confidence, measure, at in thresholds:
        if measure in measures:
            v, t = measures[measure].cast("double"), at * scale
            yes = v >= t - EPSILON
            hit = hit + yes.cast("int")
            load = load + F.when(yes, BEHAVIOUR_WEIGHT[severity] * F.least(F.lit(1.0), confidence * F.least(F.lit(2.0), v / t))).otherwise(0.0)
    load = load + F.when(hit >= 2, 0.1).otherwise(0.0)
    return {"n_signatures": hit, "risk_score": F.when(hit > 0, F.round(F.least(F.lit(1.0), load), 2)).otherwise(0.0)}


def accuracy(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """One row of tp, fp, tn, fn, accuracy, precision, recall and f1; ratios are 0 without a denominator."""
    n = df.agg(F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(~truth & ~guess).alias("tn"), F.count_if(truth & ~guess).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = n.withColumn("accuracy", ratio(tp + tn, tp + fp + tn + fn)).withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    return n.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """(label, predicted, n) for every pair that occurs."""
    return df.groupBy(truth.alias("label"), guess.alias("predicted")).agg(F.count("*").alias("n"))


def accuracy_by_class(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """(label, support, precision, recall, f1) of every class among truths and guesses, 0 without a denominator."""
    pairs = confusion(df, truth, guess)
    sides = pairs.select(F.explode(F.array(F.struct(F.col("label").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed")), F.struct(F.col("predicted").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed")))).alias("x"), F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"))
    by = sides.groupBy(F.col("x.c").alias("label")).agg(F.sum("x.support").alias("support"), F.sum("x.guessed").alias("guessed"), (F.sum("hit") / 2).cast("long").alias("hit"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    by = by.withColumn("precision", ratio(F.col("hit"), F.col("guessed"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    return by.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("label", "support", "precision", "recall", "f1")


def weighted_accuracy(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """One row: accuracy, and precision, recall and f1 of the classes weighted by their support."""
    by = accuracy_by_class(df, truth, guess)
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support").cast("double")), F.lit(0.0))
    return by.agg(mean("recall").alias("accuracy"), mean("precision").alias("precision"), mean("recall").alias("recall"), mean("f1").alias("f1"))


def inference_ratios(total: Column, ml: Column, hits: Column, short: Column, milliseconds: Column, errors: Column) -> dict[str, Column]:
    """Cache hit rate, share that the heuristic settled, mean milliseconds and the model's error rate, from counters; 0 without a denominator."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return {"cache_hit_rate": ratio(hits, total), "heuristic_filter_rate": ratio(short, total), "avg_inference_ms": ratio(milliseconds, total), "ml_error_rate": ratio(errors, ml)}


def claim_holds(factor: Column, claim: Column) -> Column:
    """Whether a factor is what was claimed: "10x" that or more, ">10x" more, "10-25x" within both.  What can't be read as a bound is no bound."""
    told = F.regexp_replace(claim, "[xX]", "")
    number = lambda s: F.expr("double(null)") if s is None else F.trim(s).try_cast("double")
    parts = F.split(told, "-")
    within = (F.size(parts) == 2) & (factor >= F.coalesce(number(F.get(parts, F.lit(0))), F.lit(0.0))) & (factor <= F.coalesce(number(F.get(parts, F.lit(1))), F.lit(float("inf"))))
    over = factor > F.coalesce(number(F.substring(told, 2, 100)), F.lit(0.0))
    return F.when(F.contains(told, F.lit("-")), within).when(told.startswith(">"), over).otherwise(factor >= F.coalesce(number(told), F.lit(0.0)))


def compare_runs(baseline: DataFrame, candidate: DataFrame, claims: DataFrame, on: tuple[str, ...] = ("category", "test_name")) -> DataFrame:
    """Both runs' mean_ms by test, the baseline's over the candidate's, and whether it bears out the category's ``claims`` (category, claim)."""
    a, b = (df.select(*on, F.col("mean_ms").alias(n)) for df, n in ((baseline, "baseline_ms"), (candidate, "candidate_ms")))
    out = a.join(b, list(on)).join(claims, "category").withColumn("factor", F.try_divide("baseline_ms", "candidate_ms"))
    return out.withColumn("validated", F.coalesce(claim_holds(F.col("factor"), F.col("claim")), F.lit(False)))


def claims_by_category(compared: DataFrame) -> DataFrame:
    """(category, n_tests, passed): a category passes if all its tests do."""
    return compared.groupBy("category").agg(F.count("*").alias("n_tests"), F.every("validated").alias("passed"))


def histogram_quantile(buckets: DataFrame, q: float, keys: tuple[str, ...]) -> DataFrame:
    """(keys, quantile) of cumulative counts (keys, le, n), linear within a bucket.

    The last bucket, of no bound, gives the bound before it; the first begins at 0, unless its bound is 0 or less,
    which it then gives.  Null without counts or without a last bucket of no bound.
    """
    order = Window.partitionBy(*keys).orderBy("le")
    last = Window.partitionBy(*keys)
    b = buckets.withColumn("low", F.coalesce(F.lag("le").over(order), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("n").over(order), F.lit(0)))
    b = b.withColumn("rank", F.max("n").over(last) * q).withColumn("top", F.max("le").over(last)).withColumn("first", F.row_number().over(order) == 1)
    inside = F.when(F.col("le") == float("inf"), F.col("low")).when(F.col("first") & (F.col("le") <= 0), F.col("le")).otherwise(F.col("low") + (F.col("le") - F.col("low")) * (F.col("rank") - F.col("below")) / (F.col("n") - F.col("below")))
    hit = F.when((F.col("top") == float("inf")) & (F.col("n") > 0) & (F.col("n") >= F.col("rank")), F.struct("le", inside.alias("v")))
    return b.groupBy(*keys).agg(F.min(hit).alias("x")).select(*keys, F.col("x.v").alias("quantile"))


def softmax(logits: Column) -> Column:
    """Shifted by the greatest; all equal if nothing is left of the sum."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top).cast("double")))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(e, lambda x: x / total)).otherwise(F.transform(logits, lambda x: 1.0 / F.size(logits)))


def sigmoid(logits: Column) -> Column:
    return F.transform(logits, lambda x: 1.0 / (1.0 + F.exp(-x.cast("double"))))


def decision_events(df: DataFrame, text: str, outputs: dict[str, Column], agent: str, version: str) -> DataFrame:
    """Audit rows: the hash of the input and the outputs, never the text."""
    return df.select(F.lit(agent).alias("agent_id"), F.lit(version).alias("agent_version"), F.sha2(F.col(text), 256).alias("inputs_hash"), *(c.alias(n) for n, c in outputs.items()))


def live_mappings(mapping: DataFrame, now: Column) -> DataFrame:
    """Vault rows (session_id, placeholder, ..., expires_at) that haven't expired; of repeated keys the newest."""
    newest = Window.partitionBy("session_id", "placeholder").orderBy(F.desc("expires_at"))
    return mapping.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n").filter(F.col("expires_at") >= now)
