"""A stored rollup that follows a stream: each batch renews the time partitions that its rows fall in, however late they come.

The table holds mergeable states by time bucket and keys, as Parquet in partitions of a day or an hour.  A batch is
rolled up, joined with what the touched partitions hold, and these alone are written anew.  Every partition
remembers the last batch that it holds, so a batch that comes again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import drop_older, part_of


class RollupTable:
    """Rollups by ``bucket`` and ``keys`` of a value, at ``path``; one writer at a time, its batch ids growing.

    ``sketch`` also keeps a quantile sketch of each bucket, of bounded size, for :meth:`percentiles`.
    """

    def __init__(self, spark: SparkSession, path: str, bucket: str = "1 minute", keys: tuple[str, ...] = ("event_type",), value: str = "value", ts: str = "ts", partition: str = "day", sketch: bool = False):
        self.spark, self.path, self.bucket, self.keys, self.value, self.ts, self.partition, self.sketch = spark, path, bucket, keys, value, ts, partition, sketch

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files.exists(path) and any("=" in f.getPath().getName() for f in files.listStatus(path))

    def states(self) -> DataFrame:
        """The stored states: part, bucket, keys, n, filled, total, low, high, sketch, batch_id; an error before the first batch."""
        return self.spark.read.schema(self._schema).parquet(self.path)

    def _part(self, at: Column) -> Column:
        return part_of(at, self.partition)

    def rolled(self, events: DataFrame) -> DataFrame:
        """The states of ``events`` alone, a row for each bucket and keys."""
        w, v = F.window(self.ts, self.bucket), F.col(self.value)
        quantiles = F.kll_sketch_agg_double(v.cast("double")) if self.sketch else F.lit(None).cast("binary")
        states = [F.count("*").alias("n"), F.count(v).alias("filled"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high")]
        out = events.groupBy(w.alias("w"), *self.keys).agg(*states, *([quantiles.alias("sketch")] if self.sketch else []))
        if not self.sketch:
            out = out.withColumn("sketch", quantiles)
        return out.select(self._part(F.col("w.start")).alias("part"), F.col("w.start").alias("bucket"), *self.keys, "n", "filled", "total", "low", "high", "sketch")

    def apply(self, events: DataFrame, batch_id: int) -> None:
        """Take in one batch of events.  A batch that a partition already holds changes nothing there."""
        told = F.lit(batch_id).cast("long")
        new = self.rolled(events).withColumn("batch_id", told).persist()
        try:
            self._schema = new.schema
            if not self._exists():
                self._write(new)
                return
            held = self.states()
            parts = new.select("part").distinct()
            # partitions are few and named by time; pruning reads no others
            touched = [r.part for r in parts.collect()]
            if not touched:
                return
            held = held.filter(F.col("part").isin(touched))
            done = held.groupBy("part").agg(F.max("batch_id").alias("last")).filter(F.col("last") >= told).select("part")
            both = held.unionByName(new).join(done, "part", "left_anti")
            sketch = F.kll_merge_agg_double("sketch") if self.sketch else F.max("sketch")
            merged = both.groupBy("part", "bucket", *self.keys).agg(F.sum("n").alias("n"), F.sum("filled").alias("filled"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), sketch.alias("sketch"))
            self._write(merged.withColumn("batch_id", told))
        finally:
            new.unpersist()

    def _write(self, states: DataFrame) -> None:
        states.hint("rebalance", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)

    def follow(self, events: DataFrame, checkpoint: str):
        """A stream writer that keeps the table; start it with the trigger of your choice."""
        return events.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)

    def read(self, since: Column | None = None, until: Column | None = None) -> DataFrame:
        """bucket, keys, avg, max, min, n, as a rollup of all events gives them; ``since`` and ``until`` (exclusive) read only their partitions."""
        out = self._between(since, until)
        return out.select("bucket", *self.keys, (F.col("total") / F.col("filled")).alias("avg"), F.col("high").alias("max"), F.col("low").alias("min"), "n")

    def _between(self, since: Column | None, until: Column | None) -> DataFrame:
        out = self.states()
        if since is not None:
            out = out.filter((F.col("part") >= self._part(since)) & (F.col("bucket") >= since))
        if until is not None:
            out = out.filter((F.col("part") <= self._part(until)) & (F.col("bucket") < until))
        return out

    def percentiles(self, points: dict[str, float], by: tuple[str, ...] | None = None, since: Column | None = None, until: Column | None = None) -> DataFrame:
        """Approximate percentiles over any span of buckets, from the merged sketches: ``by`` columns, n, and one for each point."""
        by = self.keys if by is None else by
        merged = self._between(since, until).groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
        return merged.select(*by, "n", *(F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(name) for name, q in points.items()))

    def retain(self, keep: str, now: Column) -> list[str]:
        """Drop the partitions that end before ``now`` less ``keep``; their names."""
        return drop_older(self.spark, self.path, keep, now, self.partition)
