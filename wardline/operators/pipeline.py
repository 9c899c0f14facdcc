"""Composition of scanners: results as an array of structs, combined, cut short, put under policy and presets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import EPSILON, Fields, severity_of
from . import detectors, scanners

RESULT = "struct<scanner:string,risk_score:double,is_valid:boolean>"


def result(name: str, verdict: dict[str, Column], threshold: float | None = None) -> Column:
    """One scanner's result; detectors without is_valid are valid below ``threshold``."""
    if isinstance(verdict, Fields):
        return F.get(F.transform(F.array(verdict.struct), lambda x: result(name, {k: x[k] for k in verdict}, threshold)), F.lit(0))
    valid = verdict["is_valid"] if "is_valid" in verdict else verdict["risk_score"] < (0.5 if threshold is None else threshold)
    return F.struct(F.lit(name).alias("scanner"), verdict["risk_score"].cast("double").alias("risk_score"), valid.alias("is_valid"))


def combine(results: Column) -> Column:
    """Greatest risk, all valid, how many; nothing scanned is valid without risk."""
    return F.struct(
        F.size(results).alias("n_results"),
        F.coalesce(F.array_max(F.transform(results, lambda r: r.risk_score)), F.lit(0.0)).alias("risk_score"),
        F.forall(results, lambda r: r.is_valid).alias("is_valid"),
    )


def short_circuit(results: Column, threshold: float = 0.9) -> Column:
    """The results up to and with the first whose risk reaches the threshold."""
    hit = F.array_position(F.transform(results, lambda r: (r.risk_score >= threshold - 1e-6).cast("int")), F.lit(1))
    return F.when(hit > 0, F.slice(results, F.lit(1), hit.cast("int"))).otherwise(results)


def batched_short_circuit(results: Column, threshold: float = 0.9, at_once: int = 4) -> Column:
    """The same when scanners run ``at_once``: the whole batch of the first hit counts."""
    hit = F.array_position(F.transform(results, lambda r: (r.risk_score >= threshold - EPSILON).cast("int")), F.lit(1))
    return F.when(hit > 0, F.slice(results, F.lit(1), (F.ceil(hit / at_once) * at_once).cast("int"))).otherwise(results)


def apply_policy(df: DataFrame, policies: DataFrame, key: str) -> DataFrame:
    """``df`` (key, risk_score, is_valid, ...) under the policy rows (key, action, adjustment, rule_id): risk rises to the adjustment, block invalidates.

    ``policies`` is configuration; the join is left to the optimizer, which broadcasts it while it is small.
    """
    p = policies.select(F.col(key), F.col("action").alias("policy_action"), F.col("adjustment").alias("__adjust"), F.col("rule_id").alias("policy_rule"))
    out = df.join(p, key, "left")
    return out.withColumn("risk_score", F.greatest("risk_score", F.coalesce("__adjust", F.lit(0.0)))).withColumn("is_valid", F.col("is_valid") & (F.coalesce("policy_action", F.lit("")) != "block")).drop("__adjust")


def allow_block(text: Column, allowed: list = (), blocked: list = (), any_case: bool = True) -> dict[str, Column]:
    """Whether a rule of each list stands in the text; a rule is a string, or a pair of it and whether any case will do.

    ``any_case`` holds for plain strings.  An empty list allows all and blocks none.
    """
    low = F.lower(text)

    def one(rules, empty: bool) -> Column:
        found = [(r, any_case) if isinstance(r, str) else r for r in rules]
        return reduce(lambda a, b: a | b, [F.contains(low, F.lit(x.lower())) if loose else F.contains(text, F.lit(x)) for x, loose in found]) if found else F.lit(empty)

    return {"allowed": one(allowed, True), "blocked": one(blocked, False)}


# Risk thresholds by scanner, the one of all others, and where a pipeline stops.
THRESHOLDS = {"prompt_injection": 0.8, "secrets": 0.9, "toxicity": 0.7, "pii": 0.85, "ban_topics": 0.75}
DEFAULT_THRESHOLD, SHORT_CIRCUIT = 0.5, 0.95


def threshold_of(scanner: str) -> float:
    return THRESHOLDS.get(scanner, DEFAULT_THRESHOLD)


def under_thresholds(results: Column, thresholds: dict[str, float] | None = None) -> Column:
    """The results, each valid if its risk is below its scanner's threshold in the registry or in ``thresholds``."""
    known = THRESHOLDS | (thresholds or {})
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    least = lambda r: F.coalesce(F.try_element_at(table, r.scanner), F.lit(DEFAULT_THRESHOLD))
    return F.transform(results, lambda r: F.struct(r.scanner.alias("scanner"), r.risk_score.alias("risk_score"), (r.risk_score < least(r) - EPSILON).alias("is_valid")))


_INPUT: dict[str, Callable[..., dict[str, Column]]] = {
    "ban_substrings": lambda t, phrases=(), **more: scanners.ban_substrings(t, list(phrases), **more),
    "ban_code": scanners.code_counts,
    "ban_competitors": lambda t, names=(), **more: scanners.ban_competitors(t, list(names), **more),
    "secrets": detectors.secrets,
    "toxicity": scanners.toxicity,
    "prompt_injection": scanners.prompt_injection,
    "invisible_text": scanners.invisible_text,
    "gibberish": scanners.gibberish,
    "language": scanners.language,
    "token_limit": scanners.token_limit,
    "sentiment": scanners.sentiment,
}
_OUTPUT: dict[str, Callable[..., dict[str, Column]]] = {
    "sensitive": scanners.sensitive,
    "no_refusal": scanners.no_refusal,
    "relevance": lambda t, prompt=None, **more: scanners.relevance(F.lit("") if prompt is None else prompt, t, **more),
    "ban_topics": scanners.ban_topics,
    "bias": scanners.bias,
    "malicious_urls": scanners.malicious_urls,
    "factuality": scanners.factuality,
    "url_reachability": scanners.url_reachability,
}
SCANNERS = _INPUT | _OUTPUT
#: Scanners of an output that look at the prompt as well.
WITH_PROMPT = ("relevance",)

# Scanners, short-circuit threshold and batch size of each preset.
PRESETS = {
    "strict": (list(_INPUT), list(_OUTPUT), 0.7, 50),
    "standard": (["secrets", "toxicity", "prompt_injection", "invisible_text", "token_limit"], ["sensitive", "malicious_urls", "no_refusal"], 0.9, 100),
    "permissive": (["secrets", "invisible_text"], ["sensitive"], None, 200),
    "custom": ([], [], None, 100),
}


def scanner(name: str, **options) -> Callable[..., dict[str, Column]]:
    """A registered scanner with its options: scanner("ban_topics", topics=...), scanner("language", allowed=("en", "de"))."""
    return partial(SCANNERS[name], **options) if options else SCANNERS[name]


@dataclass(frozen=True)
class Settings:
    """How a guard runs.  ``parallel`` and ``max_concurrent`` set after how many scanners a pipeline may stop; tasks are Spark's.

    Times out nothing: a query's time is the cluster's to bound.
    """

    parallel: bool = True
    max_concurrent: int = 4
    short_circuit: float | None = None
    caching: bool = False
    cache_ttl_seconds: int = 300
    max_batch: int = 100


# The named settings.
SETTINGS = {
    "default": Settings(),
    "development": Settings(False, 1, None, False, 0, 10),
    "production": Settings(True, 8, 0.95, True, 300, 100),
    "high_throughput": Settings(True, 16, 0.9, True, 600, 500),
}


class BatchTooLarge(ValueError):
    """A batch holds more texts than the guard's settings allow."""


@dataclass
class Guard:
    """A pipeline of scanners: built step by step, applied to a DataFrame's text column."""

    steps: list[tuple[str, Callable]] = field(default_factory=list)
    threshold: float | None = None
    max_batch: int | None = None
    #: Scanners that finish before a pipeline may stop; texts that are scanned once however often they stand there.
    at_once: int = 1
    caching: bool = False

    @classmethod
    def preset(cls, name: str, output: bool = False, options: dict[str, dict] | None = None) -> Guard:
        """``options`` gives scanners by name their words and limits: {"ban_competitors": {"names": ["Acme"]}}."""
        inputs, outputs, threshold, batch = PRESETS[name]
        return cls([(n, scanner(n, **(options or {}).get(n, {}))) for n in (outputs if output else inputs)], threshold, batch)

    def add(self, name: str, own: Callable | None = None, **options) -> Guard:
        return replace(self, steps=[*self.steps, (name, own or scanner(name, **options))])

    def short_circuit(self, threshold: float | None) -> Guard:
        return replace(self, threshold=threshold)

    def configured(self, settings: str | Settings) -> Guard:
        """Under named settings or own ones."""
        s = SETTINGS[settings] if isinstance(settings, str) else settings
        return replace(self, threshold=s.short_circuit, max_batch=s.max_batch, at_once=s.max_concurrent if s.parallel else 1, caching=s.caching)

    def results(self, text: Column, prompt: Column | None = None) -> Column:
        told = lambda n, f: f(text, prompt=prompt) if n in WITH_PROMPT and prompt is not None else f(text)
        return F.array(*[result(n, told(n, f)) for n, f in self.steps]) if self.steps else F.array().cast(f"array<{RESULT}>")

    def scan(self, df: DataFrame, text: str = "text", before: Callable | None = None, after: Callable | None = None, prompt: str | None = None, max_length: int | None = None) -> DataFrame:
        """``df`` with results, n_results, risk_score, is_valid and severity.

        ``before`` and ``after`` are hooks, DataFrame to DataFrame.  ``max_length`` has only so many code points
        scanned.  With caching each distinct text (and prompt) is scanned once.
        """
        df = before(df) if before else df
        if self.caching:
            keys = [text] if prompt is None else [text, prompt]
            distinct = df.select(*keys).distinct()
            verdicts = self._scanned(distinct, text, prompt, max_length).select(*(F.col(k).alias(f"__{k}") for k in keys), "results", "n_results", "risk_score", "is_valid", "severity")
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
            out = df.join(verdicts, same).drop(*(f"__{k}" for k in keys))
        else:
            out = self._scanned(df, text, prompt, max_length)
        return after(out) if after else out

    def _scanned(self, df: DataFrame, text: str, prompt: str | None, max_length: int | None) -> DataFrame:
        t = F.col(text) if max_length is None else F.substring(text, 1, max_length)
        out = df.withColumn("results", self.results(t, None if prompt is None else F.col(prompt)))
        if self.threshold is not None:
            out = out.withColumn("results", batched_short_circuit(F.col("results"), self.threshold, self.at_once))
        return out.withColumn("__c", combine(F.col("results"))).select("*", "__c.*").drop("__c").withColumn("severity", severity_of(F.col("risk_score")))

    def scan_batch(self, df: DataFrame, text: str = "text") -> DataFrame:
        """:meth:`scan` of a batch; one of more rows than the settings allow is an error, found before anything is scanned."""
        if self.max_batch is not None and (n := df.limit(self.max_batch + 1).count()) > self.max_batch:
            raise BatchTooLarge(f"a batch holds {n} texts at least, {self.max_batch} are allowed")
        return self.scan(df, text)


def batch_report(scanned: DataFrame, text: str = "text", most: int | None = None) -> DataFrame:
    """One row over a scanned batch: success_count, failure_count, n_valid, n_invalid and max_risk.

    Items fail that no scan is defined for: null and empty texts, and texts of more than ``most`` code points.
    They count among failures alone.
    """
    ok = F.coalesce(F.length(text) > 0, F.lit(False))
    if most is not None:
        ok = ok & (F.length(text) <= most)
    return scanned.agg(F.count_if(ok).alias("success_count"), F.count_if(~ok).alias("failure_count"), F.count_if(ok & F.col("is_valid")).alias("n_valid"), F.count_if(ok & ~F.col("is_valid")).alias("n_invalid"), F.max(F.when(ok, F.col("risk_score"))).alias("max_risk"))


def apply_hooks(df: DataFrame, action: Column, adjust: Column | float = 0.0) -> DataFrame:
    """``df`` (risk_score, is_valid, ...) after a hook's word on each row, and hook_action.

    continue (or null) leaves a verdict, approve makes it valid without risk, reject invalid at full risk, modify
    adds ``adjust`` to the risk within 0 and 1, and fail is an error.
    """
    a = F.lower(F.coalesce(action, F.lit("continue")))
    risk = F.when(a == "approve", 0.0).when(a == "reject", 1.0).when(a == "modify", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("risk_score") + adjust)))
    risk = risk.when(a == "fail", F.raise_error(F.lit("a hook failed")).cast("double")).otherwise(F.col("risk_score"))
    out = df.withColumn("hook_action", a).withColumn("__risk", risk)
    valid = F.when(a == "approve", True).when(a == "reject", False).otherwise(F.col("is_valid"))
    return out.withColumn("is_valid", valid).withColumn("risk_score", F.col("__risk")).drop("__risk")


# Tokens, milliseconds and calls that one analysis may take.
LIMITS = {"tokens": 800, "milliseconds": 1500, "calls": 2}


def within_limits(text: Column, milliseconds: Column | None = None, calls: Column | None = None) -> dict[str, Column]:
    """tokens (a quarter of the UTF-16 length, rounded up), and whether text, time and calls keep within LIMITS."""
    units = F.length(text) + F.regexp_count(text, F.lit("[\\x{10000}-\\x{10FFFF}]"))
    tokens = F.ceil(units / 4.0).cast("long")
    ok = tokens <= LIMITS["tokens"]
    for used, name in ((milliseconds, "milliseconds"), (calls, "calls")):
        ok = ok if used is None else ok & (used <= LIMITS[name])
    return {"tokens": tokens, "is_valid": ok}


def hybrid(heuristic: Column, model: Column, mode: str = "hybrid", safe: float = 0.1, risky: float = 0.9) -> Column:
    """struct(risk_score, method) of a heuristic's risk and a model's, null where the model failed.

    heuristic or ml take one of them; both takes the greater; hybrid takes the heuristic's where it is clear, at or
    below ``safe`` or at or over ``risky``, and else the model's.  A failed model falls back to the heuristic.
    """
    told = lambda risk, method: F.struct(risk.cast("double").alias("risk_score"), F.lit(method).alias("method"))
    fallback = told(heuristic, "ml_fallback_to_heuristic")
    if mode == "heuristic":
        return told(heuristic, "heuristic")
    if mode == "ml":
        return F.when(model.isNotNull(), told(model, "ml")).otherwise(fallback)
    if mode == "both":
        return F.when(model.isNotNull(), told(F.greatest(heuristic, model), "hybrid_both")).otherwise(fallback)
    if mode != "hybrid":
        raise ValueError(f"no such mode: {mode}")
    clear = (heuristic <= safe + EPSILON) | (heuristic >= risky - EPSILON)
    return F.when(clear, told(heuristic, "heuristic_short_circuit")).when(model.isNotNull(), told(model, "ml")).otherwise(fallback)
