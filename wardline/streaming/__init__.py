"""The same operators on streams: scanned texts, windows under a watermark, quotas with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.metrics import quota_step, rollup, sliding_ratio
from ..operators.pipeline import Guard


def scan_stream(texts: DataFrame, preset: str = "standard", text: str = "text") -> DataFrame:
    """A stream of texts with their verdicts: the guard is made of column expressions, so nothing changes."""
    return Guard.preset(preset).scan(texts, text)


def rollup_stream(events: DataFrame, late: str = "1 minute", bucket: str = "1 minute", **options) -> DataFrame:
    """Rollups of a stream; rows later than the watermark are dropped, and state goes once a bucket is past it."""
    return rollup(events.withWatermark("ts", late), bucket, **options)


def error_ratio_stream(events: DataFrame, late: str = "1 minute", window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    return sliding_ratio(events.withWatermark("ts", late), F.col("event_type") == "error", window, slide)


def distinct_texts_stream(texts: DataFrame, late: str = "1 hour", text: str = "text", ts: str = "ts") -> DataFrame:
    """Each text once within the watermark: the stream's form of a result cache."""
    return texts.withColumn("text_hash", F.sha2(F.col(text), 256)).withWatermark(ts, late).dropDuplicatesWithinWatermark(["text_hash"])


def quota_stream(events: DataFrame, limits: tuple[int, ...], key: str = "user_id", idle_ms: int = 86_400_000) -> DataFrame:
    """(key, event_id, allowed) of a stream under quota windows anchored at first use; a key's state goes after ``idle_ms`` without requests."""

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = [list(w) for w in zip(state.get[0], state.get[1])] if state.exists else None
        for df in frames:
            df = df.sort_values(["ts", "event_id"])
            verdicts = []
            for t in df["ts"]:
                held, ok = quota_step(held, t.timestamp(), limits)
                verdicts.append(ok)
            yield pd.DataFrame({key: group[0], "event_id": df["event_id"], "allowed": verdicts})
        if held is not None:
            state.update(([float(e) for e, _ in held], [int(n) for _, n in held]))
            state.setTimeoutDuration(idle_ms)

    return events.select(key, "event_id", "ts").groupBy(key).applyInPandasWithState(step, f"{key} long, event_id long, allowed boolean", "ends array<double>, counts array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def decision_sink(stream: DataFrame, path: str, checkpoint: str):
    """Append decision events as Parquet; exactly once by the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
