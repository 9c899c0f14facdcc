"""Files scanned line by line: (file, line, column, type, category, severity, preview) of every finding."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import browser as B
from ..functions.text import has, java, required


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, text) of the files below a path that Spark can read, subfolders too; each file is one string."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def _numbered(batches):
    """Rows (file, block, text) in order, with each one's place in its part of the file."""
    last, held = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = (batch.column(j).to_pylist() for j in range(2))
        place = []
        for key in zip(file, block):
            held = held + 1 if key == last else 1
            last = key
            place.append(held)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(place, np.int64))], ["file", "block", "s", "place"])


def read_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, line, s) of the lines of files of any size, numbered from 1.

    Large files are read in parts.  A part's lines are numbered as they come, and the numbers of lines of the
    parts before it, a row each, are added.
    """
    read = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("s"))
    lines = read.mapInArrow(_numbered, "file string, block long, s string, place long")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = lines.groupBy("file", "block").agg(F.max("place").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(parts, ["file", "block"]).select("file", (F.col("before") + F.col("place")).alias("line"), "s")


def read_events(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    """JSON events, at rest or as they come."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).json(path)


def places(text: Column, pattern: str) -> Column:
    """array of (match, at) of a pattern's matches, ``at`` the code point of each from 1.

    What lies between matches and the matches before give a match's place; no pattern here matches nothing.
    """
    of = F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(0))
    between = F.split(text, java(pattern), -1)
    upto = lambda items, n: F.aggregate(F.slice(items, 1, n), F.lit(0), lambda a, x: a + F.length(x))
    found = F.transform(of, lambda m, i: F.struct(m.alias("match"), (upto(between, i + 1) + upto(of, i) + 1).alias("at")))
    if not (needed := required(pattern)):
        return found
    some = reduce(lambda a, b: a | b, [has(F.lower(text), x) for x in needed])
    return F.when(some, found).otherwise(F.array().cast("array<struct<match:string,at:int>>"))


def scan_lines(files: DataFrame, counts: bool = False) -> DataFrame:
    """Findings in ``files``, rows of (file, text) or of (file, line, s) as :func:`read_lines` gives.

    Every match of a secret or of personal data counts; of injection and abusive language the first in a line, at
    the place where its text first stands there.  Lines and columns are numbered from 1, columns in code points.
    With ``counts``, rows without a line's text stay, as one row each, and so does the column ``start`` (see ``parts``).
    """
    if "line" not in files.columns:
        files = files.select("file", F.posexplode(F.split("text", "\n")).alias("n", "s")).select("file", (F.col("n") + 1).alias("line"), "s")
    s = F.col("s")

    def rows(kind, category, severity, pattern, preview, first=False):
        at = lambda m: F.instr(s, m.match) if first else m.at
        some = places(s, pattern)
        return F.transform(F.slice(some, 1, 1) if first else some, lambda m: F.struct(F.lit(kind).alias("type"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), at(m).cast("int").alias("column"), preview(m.match).alias("preview")))

    short = lambda n: lambda m: F.concat(F.substring(m, 1, n), F.lit("****"))
    cut = lambda m: F.concat(F.substring(m, 1, 50), F.when(F.length(m) > 50, "...").otherwise(""))
    rules = [rows("Prompt Injection Attempt", "prompt-injection", "high", p, cut, True) for p in B.LINE_INJECTION]
    rules += [rows(t, "secret", severity, p, short(20)) for t, severity, p in B.LINE_SECRETS]
    rules += [rows(t, "pii", severity, p, short(4)) for t, severity, p in B.LINE_PII]
    rules += [rows("Potentially Toxic Content", "toxicity", "medium", p, lambda m: m, True) for p in B.LINE_TOXICITY]
    keys = ["file", "start", "line"] if counts else ["file", "line"]
    found = files.select(*keys, (F.explode_outer if counts else F.explode)(F.flatten(F.array(*rules))).alias("x"), *(["s"] if counts else []))
    if counts:
        found = found.filter("x is not null or s is null")
    return found.select(*keys, "x.column", "x.type", "x.category", "x.severity", "x.preview")


def summary(findings: DataFrame) -> DataFrame:
    """One row: files with findings, findings, and how many of each category and severity."""
    categories = {"prompt_injection": "prompt-injection", "secrets": "secret", "pii": "pii", "toxicity": "toxicity"}
    return findings.agg(
        F.countDistinct("file").alias("n_files"),
        F.count("*").alias("n_issues"),
        *(F.count_if(F.col("category") == c).alias(n) for n, c in categories.items()),
        *(F.count_if(F.col("severity") == x).alias(f"n_{x}") for x in ("critical", "high", "medium", "low")),
    )
