"""Detectors as table functions: SQL users get a row for each span.

    SELECT d.doc_id, s.* FROM documents d, LATERAL guard_spans(d.text, 'entities') s

The rows are those of the exploded arrays of :mod:`wardline.operators.spans`.  The function takes a row at a time, since
table functions over Arrow batches can't stand in a lateral join; whole tables are better served by the columns there.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.spans import ENTITIES, leftmost, pii_rules, redaction_rules, surest

#: Rules, how overlaps are settled, and the least confidence, by name.  Add your own before registering.
DETECTORS = {
    "entities": (lambda: ENTITIES, surest, 0.0),
    "pii": (pii_rules, leftmost, 0.5),
    "redaction": (redaction_rules, leftmost, 0.8),
}
_KINDS = {"start": IntegerType(), "end": IntegerType(), "confidence": DoubleType()}
ROW = StructType([StructField(n, _KINDS.get(n, StringType())) for n in ("kind", "category", "severity", "start", "end", "confidence", "value")])


def span_function(detectors: dict):
    """The table function (text, detector) -> rows of spans, for ``detectors`` as in DETECTORS."""

    @F.udtf
    class GuardSpans:
        @staticmethod
        def analyze(text: AnalyzeArgument, detector: AnalyzeArgument) -> AnalyzeResult:
            if text.isTable or text.dataType.typeName() not in ("string", "void"):
                raise ValueError("guard_spans takes a column of texts")
            if not detector.isConstantExpression or detector.value not in detectors:
                raise ValueError(f"guard_spans knows the detectors {', '.join(detectors)}")
            return AnalyzeResult(ROW)

        def __init__(self):
            self.known: dict = {}

        def eval(self, text: str, detector: str):
            if text is None:
                return
            if detector not in self.known:
                rules, settle, least = detectors[detector]
                self.known[detector] = ([(r, re.compile(r.pattern, re.ASCII)) for r in rules()], settle, least)
            rules, settle, least = self.known[detector]
            yield from settle([s for r, c in rules for s in r.matches(c, text) if s[5] >= least])

    return GuardSpans


def register_tables(spark: SparkSession, detectors: dict | None = None) -> list[str]:
    """Make the table functions known to a session, with own ``detectors`` beside the library's."""
    spark.udtf.register("guard_spans", span_function(DETECTORS | (detectors or {})))
    return ["guard_spans"]
