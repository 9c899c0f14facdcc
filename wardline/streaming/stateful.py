"""State that outlives a batch: session vaults whose entries expire, and alerts that must hold for a while.

Both run on ``transformWithState``, which needs the RocksDB state store: set
``spark.sql.streaming.stateStore.providerClass`` to ``STATE_STORE``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.metrics import compare
from ..operators.spans import MARK, marked_entities, replace_spans

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Vault(StatefulProcessor):
    """A session's counters by kind and its placeholders, each gone ``ttl_seconds`` after it was last written."""

    def __init__(self, ttl_seconds: int):
        self.ttl_ms = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getMapState("numbers", "kind string", "n long", self.ttl_ms)
        self.vault = handle.getMapState("vault", "placeholder string", "entity_type string, original_value string, confidence double", self.ttl_ms)

    def _number(self, kind: str) -> int:
        return self.numbers.getValue((kind,))[0] if self.numbers.containsKey((kind,)) else 0

    def _restored(self, mark: re.Match) -> str:
        return self.vault.getValue((mark.group(),))[1] if self.vault.containsKey((mark.group(),)) else mark.group()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (r.ts is not None, r.ts, r.h)):
            mapping: list[dict] = []
            if r.text is None or r.restore:
                told = None if r.text is None else re.sub(MARK, self._restored, r.text)
            else:
                numbers = {kind: self._number(kind) for kind in {s["kind"] for s in r.spans}}
                told, mapping = replace_spans(r.text, r.spans, numbers)
                for kind, n in numbers.items():
                    self.numbers.updateValue((kind,), (n,))
                for m in mapping:
                    self.vault.updateValue((m["placeholder"],), (m["entity_type"], m["original_value"], m["confidence"]))
            yield Row(session=key[0], row_id=r.row_id, told=told, mapping=mapping)

    def close(self) -> None:
        pass


def vault_stream(texts: DataFrame, session: str, row_id: str, text: str = "text", ts: str = "ts", restore: str | None = None, ttl_seconds: int = 3600) -> DataFrame:
    """(session, row_id, told, mapping) of a stream: each text with its entities as placeholders, or restored where ``restore`` is true.

    Placeholders are numbered as :func:`wardline.operators.spans.anonymise` numbers them in order of ``ts``, over
    all batches; a batch's rows of one session are taken in that order.  A session's state is spread by its name, a
    null one being a session.  A placeholder is known for ``ttl_seconds`` of processing time, and its kind's counter
    at least as long, so that no number is given twice while it is known.  State that expires keeps a query running
    batches without data: with an ``availableNow`` trigger set ``spark.sql.streaming.noDataMicroBatches.enabled`` to
    false, or it never ends.
    """
    back = F.lit(False) if restore is None else F.coalesce(F.col(restore), F.lit(False))
    rows = texts.select(F.col(session).cast("string").alias("session"), F.col(row_id).cast("string").alias("row_id"), F.col(ts).alias("ts"), F.xxhash64(text).alias("h"), F.col(text).alias("text"), back.alias("restore"))
    rows = rows.withColumn("spans", marked_entities(F.col("text")))
    schema = "session string, row_id string, told string, mapping array<struct<placeholder:string,entity_type:string,original_value:string,confidence:double>>"
    return rows.groupBy("session").transformWithState(Vault(ttl_seconds), schema, "Append", "ProcessingTime")


class Sustained(StatefulProcessor):
    """One rule over one series: inactive, pending while it holds, firing once it has held long enough, resolved when it ends.

    Buckets wait until the watermark is past them, so their order of arrival doesn't matter; a bucket that never
    comes ends what held before it.
    """

    def __init__(self, step_seconds: int):
        self.step = step_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "value double, holds boolean, needed long")
        self.state = handle.getValueState("state", "status string, held long, last long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            self.waiting.updateValue((r.at,), (r.value, r.holds, r.needed))
            self.handle.registerTimer(r.at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        status, held, last = self.state.get() if self.state.exists() else ("inactive", 0, None)
        told = lambda at, state, value: Row(rule_id=key[0], at=at, state=state, value=value)
        for at, (value, holds, needed) in sorted((k[0], tuple(v)) for k, v in self.waiting.iterator() if k[0] < passed):
            self.waiting.removeKey((at,))
            if status != "inactive" and at > last + self.step:
                if status == "firing":
                    yield told(last + self.step, "resolved", None)
                status, held = "inactive", 0
            held = held + 1 if holds else 0
            if holds and status == "inactive":
                status = "pending"
                yield told(at, "pending", value)
            if holds and status == "pending" and held >= needed:
                status = "firing"
                yield told(at, "firing", value)
            if not holds:
                if status == "firing":
                    yield told(at, "resolved", value)
                status = "inactive"
            last = at
        if last is not None and status != "inactive":
            if last + self.step < passed:  # the bucket after the last one never came
                if status == "firing":
                    yield told(last + self.step, "resolved", None)
                status, held = "inactive", 0
            else:
                self.handle.registerTimer(last + self.step)
        self.state.update((status, held, last))

    def close(self) -> None:
        pass


def alert_stream(series: DataFrame, rules: DataFrame, step_seconds: int, late: str = "1 minute") -> DataFrame:
    """(rule_id, at, state, value) of a stream ``series`` (metric, bucket, value) under ``rules`` (rule_id, metric, operator, threshold, for_buckets).

    The transitions of :func:`wardline.operators.metrics.alert_transitions`, once the watermark, ``late`` behind the
    newest bucket, is past a bucket.  ``rules`` is configuration, not a stream.
    """
    rows = series.withWatermark("bucket", late).join(rules, "metric").withColumn("holds", compare(F.col("value"), F.col("operator"), F.col("threshold")))
    rows = rows.select(F.col("rule_id").cast("string").alias("rule_id"), "bucket", F.unix_millis("bucket").alias("at"), F.col("value").cast("double").alias("value"), "holds", F.col("for_buckets").cast("long").alias("needed"))
    out = rows.groupBy("rule_id").transformWithState(Sustained(step_seconds), "rule_id string, at long, state string, value double", "Append", "EventTime")
    return out.withColumn("at", F.timestamp_millis("at"))
