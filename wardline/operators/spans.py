"""Exact spans: what column expressions can't give, since they know no offsets.  Arrow batches, one pass a text.

Offsets are code points, the end exclusive.  Overlaps are settled by one of two rules:
``leftmost`` keeps the earliest span, of equal starts the surest, and drops what overlaps it;
``surest`` lets a span give way to a surer one that begins within it, whose end then counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import patterns as P
from ..functions.text import needs
from ..sources.scratch import work_folder

SPAN = "struct<kind:string,category:string,severity:string,start:int,end:int,confidence:double,value:string>"
SPANS = f"array<{SPAN}>"


def luhn(value: str, least: int = 13, most: int = 19) -> bool:
    digits = [int(c) for c in value if c.isdigit()]
    doubled = [d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(reversed(digits))]
    return least <= len(digits) <= most and sum(doubled) % 10 == 0


def octets(value: str) -> bool:
    return all(int(p) <= 255 for p in value.split("."))


def social_security(value: str) -> bool:
    d = "".join(c for c in value if c.isdigit())
    return len(d) == 9 and d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    confidence: float
    category: str = "pii"
    severity: str = "medium"
    valid: Callable[[str], bool] | None = None
    #: Confidence of a match that isn't valid, or None to drop it.
    invalid: float | None = None

    def matches(self, compiled: re.Pattern, text: str) -> Iterable[tuple]:
        for m in compiled.finditer(text):
            sure = self.confidence
            if self.valid and not self.valid(m.group()):
                if self.invalid is None:
                    continue
                sure = self.invalid
            if m.end() > m.start():
                yield self.kind, self.category, self.severity, m.start(), m.end(), sure, m.group()


def leftmost(spans: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for s in sorted(spans, key=lambda s: (s[3], -s[5])):
        if not out or s[3] >= out[-1][4]:
            out.append(s)
    return out


def surest(spans: list[tuple]) -> list[tuple]:
    """What :func:`resolve_overlaps` keeps, for spans as tuples."""
    out: list[tuple] = []
    for s in sorted(spans, key=lambda s: s[3]):
        if out and s[3] < out[-1][4]:
            if s[5] > out[-1][5]:
                out[-1] = s
        else:
            out.append(s)
    return out


def resolve_overlaps(spans: Column) -> Column:
    """An array of spans by start, each overlapping one giving way to a surer one; of equally sure ones the earlier stays."""
    by_start = F.array_sort(spans, lambda a, b: F.when(a.start < b.start, -1).when(a.start > b.start, 1).otherwise(0))
    none = F.filter(spans, lambda s: F.lit(False))

    def step(kept, s):
        last = F.try_element_at(kept, F.lit(-1))
        apart = F.size(kept) == 0
        rest = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(apart | (s.start >= last.end), F.concat(kept, F.array(s))).when(s.confidence > last.confidence, F.concat(rest, F.array(s))).otherwise(kept)

    return F.aggregate(by_start, none, step)


def spans_udf(rules: list[Rule], settle: Callable | None = leftmost, least: float = 0.0):
    """text -> array of spans.  Patterns are ASCII in their classes, as the catalogs mean them, and run only on texts with what they need."""
    wanted = [needs(r.pattern) for r in rules]

    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
        run = re.compile("[0-9]+")

        def one(text):
            if text is None:
                return None
            lower, digits = text.lower(), max(map(len, run.findall(text)), default=0)
            here = [n <= digits and all(any(x in (lower if folded else text) for x in c) for c in strings) for folded, strings, n in wanted]
            found = [s for r, c, yes in zip(rules, compiled, here) if yes for s in r.matches(c, text) if s[5] >= least]
            return [dict(zip(("kind", "category", "severity", "start", "end", "confidence", "value"), s)) for s in (settle(found) if settle else sorted(found, key=lambda s: s[3]))]

        return texts.map(one)

    return find


_VALID = {"luhn": luhn, "area_check": social_security, "ipv4": octets}


def pii_rules(sensitivity: float = 0.5, kinds: tuple[str, ...] = (), countries: tuple[str, ...] = ("us",)) -> list[Rule]:
    """The PII agent's rules: validated matches gain .05, others lose .20, all shift with the sensitivity; two decimals."""
    elsewhere = {"uk": ("phone-uk", "passport-uk", "address-uk-postcode"), "eu": ("dob-eu",)}
    drop = {i for c, ids in elsewhere.items() if c not in countries for i in ids}
    shift = (sensitivity - 0.5) * 0.1
    clamp = lambda x: round(min(1.0, max(0.0, x)), 2)
    out = []
    for i, kind, severity, confidence, validation, pattern in P.PII:
        if i in drop or kinds and kind not in kinds:
            continue
        valid = _VALID.get("ipv4" if i == "ipv4" else validation)
        out.append(Rule(kind, pattern, clamp(confidence + 0.05 + shift), "pii", severity, valid, clamp(confidence - 0.20 + shift) if valid else None))
    return out


def detect_pii(text: Column, sensitivity: float = 0.5, **options) -> Column:
    return spans_udf(pii_rules(sensitivity, **options), leftmost, max(0.3, 0.7 - 0.4 * sensitivity))(text)


# Weights of severities in the risk of spans.
RISK_WEIGHT = {"none": 0.0, "low": 0.25, "medium": 0.5, "high": 0.75, "critical": 1.0}


def spans_risk(spans: Column, mean_part: float = 0.6) -> Column:
    """Mean weight x confidence, and the greatest weight, mixed; two decimals."""
    weight = lambda s: F.element_at(F.create_map(*[F.lit(x) for kv in RISK_WEIGHT.items() for x in kv]), s.severity)
    mean = F.aggregate(spans, F.lit(0.0), lambda a, s: a + weight(s) * s.confidence) / F.size(spans)
    worst = F.array_max(F.transform(spans, weight))
    return F.when(F.size(spans) == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), mean * mean_part + worst * (1 - mean_part)), 2))


def redaction_rules(sensitivity: float = 0.7, categories: tuple[str, ...] = ("pii", "secret", "credential")) -> list[Rule]:
    scale = 0.5 + 0.5 * sensitivity
    out = []
    for _, category, kind, severity, confidence, pattern in P.REDACTION:
        if category in categories:
            valid = {"credit_card": luhn, "ssn": social_security}.get(kind)
            out.append(Rule(kind, pattern, min(1.0, confidence * scale), category, severity, valid, confidence * 0.5 * scale if valid else None))
    return out


def _digest(value: str) -> str:
    return hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()


def replacement(kind: str, value: str, strategy: str, mark: str | None = None, keep: int = 4) -> str:
    """What stands for a redacted value: mask, hash, pseudonymize, remove or partial_mask."""
    h = _digest(value)
    if strategy == "hash":
        return f"[HASH:{h[:16]}]"
    if strategy == "remove":
        return ""
    if strategy == "partial_mask":
        return "*" * len(value) if len(value) <= 2 * keep else value[:keep] + "*" * (len(value) - 2 * keep) + value[-keep:]
    if strategy == "pseudonymize":
        forms = {"email": f"user_{h[:8]}@example.com", "phone_number": f"+1-555-{h[:3]}-{h[3:7]}", "ssn": f"XXX-XX-{h[:4]}", "credit_card": f"****-****-****-{h[:4]}", "ip_address": f"192.0.2.{int(h[:2], 16)}"}
        return forms.get(kind, f"[REDACTED-{h[:8]}]")
    return mark or f"[{kind.upper()}]"


def replaced_udf(strategy: str, mark: str | None = None, keep: int = 4):
    """(text, spans that don't overlap) -> text with each span replaced."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text, found):
            if text is None:
                return None
            out, at = [], 0
            for s in found if found is not None else ():
                out += [text[at : s["start"]], replacement(s["kind"], s["value"], strategy, mark, keep)]
                at = s["end"]
            return "".join([*out, text[at:]])

        return pd.Series([one(t, f) for t, f in zip(texts, spans)])

    return run


def redact(df: DataFrame, text: str = "text", strategy: str = "mask", sensitivity: float = 0.7, least: float = 0.8, **options) -> DataFrame:
    """``df`` with spans, n_redacted, redacted and risk_score.  Overlapping spans are settled before anything is replaced."""
    found = spans_udf(redaction_rules(sensitivity), leftmost, least)(F.col(text))
    out = df.withColumn("spans", found)
    return out.withColumn("n_redacted", F.size("spans")).withColumn("redacted", replaced_udf(strategy, **options)(F.col(text), F.col("spans"))).withColumn("risk_score", spans_risk(F.col("spans"), 1.0))


# The anonymiser's entity patterns.
ENTITIES = [
    Rule("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.95),
    Rule("PHONE", r"(\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", 0.90),
    Rule("SSN", r"\b\d{3}-\d{2}-\d{4}\b", 0.95, valid=social_security),
    Rule("CREDIT_CARD", r"\b(?:\d{4}[-\s]?){3}\d{4}\b|\b\d{15}\b", 0.95, valid=luhn),
    Rule("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.90, valid=octets),
    Rule("URL", r'https?://[^\s<>"]+|www\.[^\s<>"]+', 0.85),
    Rule("DATE_OF_BIRTH", r"\b(?:\d{1,2}[-/]\d{1,2}[-/]\d{4}|\d{4}[-/]\d{1,2}[-/]\d{1,2})\b", 0.75),
    Rule("BANK_ACCOUNT", r"\b\d{8,17}\b", 0.70),
    Rule("DRIVER_LICENSE", r"\b[A-Z]\d{7}\b|\b\d{8,12}\b", 0.75),
    Rule("PASSPORT", r"\b[A-Z]{1,2}\d{7,8}\b", 0.75),
    Rule("MRN", r"\bMRN[-:]?\d{6,10}\b|\b\d{6,10}\b", 0.80),
    Rule("POSTAL_CODE", r"\b\d{5}(?:-\d{4})?\b", 0.85),
    Rule("PERSON", r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b", 0.60),
    Rule("ADDRESS", r"\b\d+\s+[A-Z][a-z]+\s+(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Boulevard|Blvd)\b", 0.65),
    Rule("ORGANIZATION", r"\b([A-Z][A-Za-z\s]+?)\s+(Inc|Corp|LLC|Ltd|Company|Co)\b", 0.65),
]


def entities(text: Column) -> Column:
    return spans_udf(ENTITIES, surest)(text)


#: What looks like a placeholder.
MARK = r"\[[A-Z_]+_[0-9]+\]"
_LITERAL = Rule("LITERAL", MARK, 1.0, "literal", "none")


def _with_literals(found: list[tuple]) -> list[tuple]:
    """Settled entities, and beside them what looks like a placeholder already."""
    kept = surest([s for s in found if s[0] != _LITERAL.kind])
    return sorted([*kept, *(s for s in found if s[0] == _LITERAL.kind and all(s[4] <= k[3] or k[4] <= s[3] for k in kept))], key=lambda s: s[3])


def marked_entities(text: Column) -> Column:
    """Entities, and as LITERAL the strings between them that look like placeholders, so that every placeholder of the outcome is our own."""
    return spans_udf([*ENTITIES, _LITERAL], _with_literals)(text)


def replace_spans(text: str, spans, numbers: dict[str, int]) -> tuple[str, list[dict]]:
    """(text with placeholders, mapping) of spans by start; ``numbers`` has the last number of each kind and goes on."""
    out, at, mapping = [], 0, []
    for s in spans:
        numbers[s["kind"]] = numbers.get(s["kind"], 0) + 1
        mark = f"[{s['kind']}_{numbers[s['kind']]}]"
        out += [text[at : s["start"]], mark]
        at = s["end"]
        mapping.append({"placeholder": mark, "entity_type": s["kind"], "original_value": s["value"], "confidence": s["confidence"]})
    return "".join([*out, text[at:]]), mapping


def anonymise(df: DataFrame, session: str, text: str = "text", ttl_seconds: int = 3600, order: tuple[str, ...] = (), now: Column | None = None, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """(``df`` with anonymised, mapping rows).  Placeholders are [KIND_n], n counting a session's entities of a kind from 1.

    What looks like a placeholder already becomes one of kind LITERAL, so restoring gives every text back as it was.

    A session's texts follow one another by the columns of ``order`` and then by a hash of the text; rows that agree
    in all of these are one text.  Mapping: session_id, placeholder, entity_type, original_value, confidence,
    ttl_seconds, and with ``now`` expires_at.  A null session is a session.  Only counts are ordered, not texts.
    With ``stored``, texts and their entities are written once to the shared folder, and what both outcomes read is that.
    """
    name, h, found, shift = "__s", "__h", "__e", "__o"
    rows = df.withColumn(name, F.col(session)).withColumn(h, F.xxhash64(text)).withColumn(found, marked_entities(F.col(text)))
    if stored:
        folder, schema = work_folder(df.sparkSession), rows.schema
        rows.write.option("compression", "zstd").parquet(folder)
        rows = df.sparkSession.read.schema(schema).parquet(folder)
    keys = [name, *order, h]
    kinds = rows.select(*keys, F.explode(F.col(f"{found}.kind")).alias("kind"))
    # rows that agree are one text: their number divides the counts again
    copies = rows.groupBy(*keys).agg(F.count("*").alias("copies"))
    counts = kinds.groupBy(*keys, "kind").agg(F.count("*").alias("n"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = reduce(lambda x, y: x & y, same)
    counts = counts.alias("a").join(copies.alias("b"), both).select(*(F.col(f"a.{k}") for k in keys), "kind", (F.col("n") / F.col("copies")).cast("long").alias("n"))
    earlier = Window.partitionBy(name, "kind").orderBy(*order, h).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    shifts = shifts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("kind", "before"))).alias(shift))  # one entry a kind

    @F.pandas_udf("struct<text:string,mapping:array<struct<placeholder:string,entity_type:string,original_value:string,confidence:double>>>")
    def run(texts: pd.Series, spans: pd.Series, shifts: pd.Series) -> pd.DataFrame:
        out_rows = []
        for t, found, before in zip(texts, spans, shifts):
            if t is None:
                out_rows.append((None, []))
                continue
            out_rows.append(replace_spans(t, found if found is not None else (), dict(before) if before is not None else {}))
        return pd.DataFrame(out_rows, columns=["text", "mapping"])

    joined = rows.alias("a").join(shifts.alias("b"), both, "left").select(*(F.col(f"a.{c}") for c in df.columns), F.col(f"a.{name}").alias(name), F.col(f"a.{found}").alias(found), shift)
    done = joined.withColumn("__a", run(F.col(text), F.col(found), F.col(shift)))
    mapping = done.select(F.col(name).alias("session_id"), F.explode("__a.mapping").alias("m")).select("session_id", "m.*", F.lit(ttl_seconds).alias("ttl_seconds")).distinct()
    if now is not None:
        mapping = mapping.withColumn("expires_at", now + F.make_dt_interval(secs=F.lit(ttl_seconds)))
    return done.select(*df.columns, F.col("__a.text").alias("anonymised")), mapping


def deanonymise(df: DataFrame, mapping: DataFrame, session: str, text: str = "anonymised") -> DataFrame:
    """``df`` with restored: placeholders of the row's session replaced by what they stand for; unknown ones stay.

    A mapping that gives one placeholder of a session two values is an error.  Each text meets the placeholders
    that it holds, not all of its session's.
    """
    mark = MARK
    one = mapping.groupBy(F.col("session_id").alias("__s"), F.col("placeholder").alias("__p")).agg(F.min("original_value").alias("__v"), F.max("original_value").alias("__w"))
    wrong = F.concat(F.lit("two values of "), F.col("__p"))
    one = one.select("__s", "__p", F.when(F.col("__v") == F.col("__w"), F.col("__v")).otherwise(F.raise_error(wrong)).alias("__v"))
    keyed = df.withColumn("__h", F.xxhash64(text))
    held = keyed.select(F.col(session).alias("__t"), "__h", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(mark), F.lit(0)))).alias("__q")).distinct()
    known = held.join(one, F.col("__t").eqNullSafe(F.col("__s")) & (F.col("__q") == F.col("__p"))).groupBy("__t", "__h").agg(F.collect_list(F.struct("__q", "__v")).alias("__m")).withColumnRenamed("__h", "__g")

    @F.pandas_udf("string")
    def run(texts: pd.Series, maps: pd.Series) -> pd.Series:
        def one(text, m):
            known = {x["__q"]: x["__v"] for x in (m if m is not None else ())}
            return None if text is None else re.sub(mark, lambda k: known.get(k.group(), k.group()), text)

        return pd.Series([one(t, m) for t, m in zip(texts, maps)])

    joined = keyed.join(known, F.col(session).eqNullSafe(F.col("__t")) & (F.col("__h") == F.col("__g")), "left")
    return joined.withColumn("restored", run(F.col(text), F.col("__m"))).select(*df.columns, "restored")


def shown_session(session: Column) -> Column:
    """A session's name as audit rows show it: its first 8 characters, of a name of 8 or less the first 4."""
    return F.concat(F.when(F.length(session) <= 8, F.substring(session, 1, 4)).otherwise(F.substring(session, 1, 8)), F.lit("****"))


def audit_rows(mapping: DataFrame, now: Column | None = None) -> DataFrame:
    """(event_type, session, entity_type, n) of an anonymisation: its start with the number of entities, each kind stored,
    its end, and with ``now`` the mappings of each session that have expired.  Names are cut, values never shown."""
    s = F.col("session_id").cast("string")
    per = mapping.groupBy(s.alias("s")).agg(F.count("*").alias("n"))
    row = lambda df, event, kind: df.select(F.lit(event).alias("event_type"), shown_session(F.col("s")).alias("session"), kind.cast("string").alias("entity_type"), "n")
    out = row(per, "anonymize_start", F.lit(None)).unionByName(row(per, "anonymize_complete", F.lit(None)))
    out = out.unionByName(row(mapping.groupBy(s.alias("s"), "entity_type").agg(F.count("*").alias("n")), "vault_store", F.col("entity_type")))
    if now is not None:
        out = out.unionByName(row(mapping.filter(F.col("expires_at") < now).groupBy(s.alias("s")).agg(F.count("*").alias("n")), "vault_expire", F.lit(None)))
    return out


def decode_bio(tokens: DataFrame, least: float = 0.85) -> DataFrame:
    """(doc_id, pos, label, start, end, confidence) of BIO-labelled tokens -> (doc_id, kind, start, end, confidence) entities.

    B begins an entity, I goes on with one of its kind or begins one, O ends it; tokens of no width are skipped.
    Gaps and islands over each document's positions.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    t = tokens.filter("end > start").withColumn("kind", F.when(F.col("label") != "O", F.substring("label", 3, 100)))
    t = t.withColumn("begins", F.col("kind").isNotNull() & (F.col("label").startswith("B-") | F.coalesce(F.lag("kind").over(order) != F.col("kind"), F.lit(True))))
    t = t.withColumn("island", F.sum(F.col("begins").cast("int")).over(order)).filter("kind is not null")
    return t.groupBy("doc_id", "island", "kind").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("confidence").alias("confidence")).filter(F.col("confidence") >= least).drop("island")
