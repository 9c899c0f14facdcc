"""Tables of time-stamped rows in partitions of time: what a range reads, a lookup finds and retention drops are whole files.

Rows are sorted within files, so the statistics of a row group tell which values it may hold, and columns that are
looked up by value get a Bloom filter, so a lookup opens the files' footers and reads few row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of time partitions.
PARTITIONS = {"day": "yyyy-MM-dd", "hour": "yyyy-MM-dd-HH", "month": "yyyy-MM"}


def part_of(at: Column, partition: str = "day") -> Column:
    return F.date_format(at, PARTITIONS[partition])


def write_partitioned(df: DataFrame, path: str, ts: str = "ts", partition: str = "day", sort: tuple[str, ...] = (), lookup: dict[str, int] | None = None, mode: str = "append") -> None:
    """Write ``df`` with a column ``part`` of its rows' time; rows without a time stand in the partition of null.

    ``sort`` orders the rows of a file; ``lookup`` names columns with Bloom filters and about how many values a file
    holds of each.  A partition of any size is written by several tasks, small ones together, as Spark rebalances
    them.  With mode ``overwrite`` only the partitions of ``df`` are replaced.
    """
    out = df.withColumn("part", part_of(F.col(ts), partition)).hint("rebalance", "part")
    if sort:
        out = out.sortWithinPartitions("part", *sort)
    writer = out.write.mode(mode).partitionBy("part").option("partitionOverwriteMode", "dynamic")
    for column, values in (lookup or {}).items():
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", str(values))
    writer.parquet(path)


def between(table: DataFrame, since: Column | None = None, until: Column | None = None, ts: str = "ts", partition: str = "day") -> DataFrame:
    """Rows of a partitioned table from ``since`` to before ``until``: whole partitions outside are never listed for reading."""
    out = table
    if since is not None:
        out = out.filter((F.col("part") >= part_of(since, partition)) & (F.col(ts) >= since))
    if until is not None:
        out = out.filter((F.col("part") <= part_of(until, partition)) & (F.col(ts) < until))
    return out


def drop_older(spark: SparkSession, path: str, keep: str, now: Column, partition: str = "day") -> list[str]:
    """Delete the partitions that end before ``now`` less ``keep``, and return their names.  Folders are listed, no row is read."""
    cut = spark.range(1).select(part_of(now - F.expr(f"INTERVAL {keep}"), partition)).first()[0]
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for f in files.listStatus(root):
        name = f.getPath().getName()
        if name.startswith("part=") and name[5:7].isdigit() and name[5:] < cut:
            files.delete(f.getPath(), True)
            gone.append(name[5:])
    return sorted(gone)


def files_read(df: DataFrame) -> int:
    """How many files the scans of ``df`` read, by their own count; runs ``df``."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves, n = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        metric = leaves.apply(i).metrics().get("numFiles")
        n += metric.get().value() if metric.isDefined() else 0
    return n
