"""Interaction of document filters, over packed bitmaps.

Spark decides each row's failures: four from the text alone, the fifth by one table-wide minimum of ids for each
distinct text.  Tasks pack them, the labels and the parts into bitsets of NumPy words; AND-NOT and popcount give
what every subset of the filters keeps, and Spark sums these few counts by part.  Every order of the filters is a
path through the subsets, so all orders follow from the sums.
"""

from __future__ import annotations

import itertools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

SPACE = r"[\x20\x09-\x0D]+"
#: Rows whose bits are packed at a time.
BLOCK = 1 << 16

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column) -> dict[str, Column]:
    """Failures that a text alone decides; null counts as empty.

    A: under 100 words; B: fewer than 80 distinct words in a hundred; C: more than 10 of 100 code points are A-Z;
    D: holds one of ``#$%&*|``.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, _UPPER, ""))
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * n.cast("long"),
        "C": 100 * capitals.cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def repeats_earlier(rows: DataFrame, id_col: str, key: str, out: str) -> DataFrame:
    """``rows`` with ``out``: whether a row of a smaller id has the same ``key``.  A null id is never later than another.

    Only the smallest id of each key is compared, so copies shrink to one row a key and task before they travel,
    and rows then meet their key's minimum by id and key together, which spreads a key that many rows share.
    """
    low, k, one = fresh(rows, "low", "k", "one")
    first = rows.filter(F.col(id_col).isNotNull()).groupBy(F.col(key).alias(k)).agg(F.min(id_col).alias(low)).withColumn(one, F.lit(True))
    known = rows.filter(F.col(id_col).isNotNull()).join(first, (F.col(id_col) == F.col(low)) & (F.col(key) == F.col(k)), "left")
    known = known.withColumn(out, F.col(one).isNull()).drop(low, k, one)
    return known.unionByName(rows.filter(F.col(id_col).isNull()).withColumn(out, F.lit(False)))


def _subset_counts(filters: int, goods: int):
    """Batches of (part, failures..., marks...) -> (part, subset, kept, of each mark) by block."""

    def run(batches):
        names = ["part", "subset", "kept", *(f"kept_{i}" for i in range(goods))]
        subsets = 1 << filters

        def packed(rows: pa.Table):
            parts, part = np.unique(np.array(rows.column(0).to_pylist(), object).astype(str), return_inverse=True)
            order = np.argsort(part, kind="stable")  # a part's bits stand together
            ends = np.searchsorted(part[order], np.arange(len(parts) + 1))

            def words(bits: np.ndarray) -> np.ndarray:
                raw = np.packbits(bits, bitorder="little")
                return np.concatenate([raw, np.zeros(-len(raw) % 8, np.uint8)]).view(np.uint64)

            fails = [words(rows.column(1 + i).to_numpy(zero_copy_only=False)[order].astype(bool)) for i in range(filters)]
            marks = [words(rows.column(1 + filters + i).to_numpy(zero_copy_only=False)[order].astype(bool)) for i in range(goods)]
            out = np.zeros((len(parts), subsets, 1 + goods), np.int64)
            for p in range(len(parts)):
                lo, hi = ends[p], ends[p + 1]
                own = np.zeros(rows.num_rows, bool)
                own[lo:hi] = True
                span = slice(lo // 64, -(-hi // 64))
                left = [words(own)[span]]  # by subset: rows of the part that none of its filters removes
                for s in range(1, subsets):
                    low = s & -s
                    left.append(left[s ^ low] & ~fails[low.bit_length() - 1][span])
                for s in range(subsets):
                    out[p, s] = [np.bitwise_count(left[s]).sum(), *(np.bitwise_count(left[s] & m[span]).sum() for m in marks)]
            counts = out.reshape(-1, 1 + goods)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(parts, subsets).tolist(), pa.string()), pa.array(np.tile(np.arange(subsets), len(parts)), pa.int64()), *(pa.array(c) for c in counts.T)], names)

        held: list = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                yield packed(pa.Table.from_batches(held).combine_chunks())
                held, n = [], 0
        if n:
            yield packed(pa.Table.from_batches(held).combine_chunks())

    return run


def audit_filters(rows: DataFrame, part: str, failures: list[str], marks: list[str]) -> DataFrame:
    """(part, subset, kept, kept_0, ...): rows of each part that no filter of the subset removes, and how many of them have each mark.

    ``failures`` and ``marks`` are boolean columns, null being false; subset is a sum of 2 ** (place of the filter).
    Parts are told apart as strings, null as empty.  An empty table gives no rows.  Other columns are not read.
    """
    bits = [F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(f"b{i}") for i, c in enumerate([*failures, *marks])]
    schema = "part string, subset long, kept long" + "".join(f", kept_{i} long" for i in range(len(marks)))
    counted = rows.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), *bits).mapInArrow(_subset_counts(len(failures), len(marks)), schema)
    return counted.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in ["kept", *(f"kept_{i}" for i in range(len(marks)))]))


def all_orders(counts: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order of the filters and step: kept, removed, redundant, unique_fails, lost_0, ..., shapley, from :func:`audit_filters`.

    shapley is what the step's filter removes, summed over all orders.  The steps of all orders are a constant, and
    a part's counts, of fixed number, become one row of maps.
    """
    marks = [c for c in counts.columns if c.startswith("kept_")]
    full = (1 << len(letters)) - 1
    by = {c: F.map_from_entries(F.collect_list(F.struct("subset", c))) for c in ["kept", *marks]}
    wide = counts.groupBy("part").agg(*(m.alias(c) for c, m in by.items()))
    steps = []
    for order in itertools.permutations(range(len(letters))):
        before = 0
        for k, f in enumerate(order):
            steps.append(("".join(letters[i] for i in order), k + 1, before, 1 << f))
            before |= 1 << f
    ways: dict[tuple[int, int], int] = {}
    for _, _, before, bit in steps:
        ways[before, bit] = ways.get((before, bit), 0) + 1
    table = F.from_json(F.lit(json.dumps([dict(zip(("filter_order", "step", "before", "bit"), x)) for x in steps])), "array<struct<filter_order string, step int, before long, bit long>>")
    kept = lambda at: F.col("kept")[F.lit(at).cast("long")]
    # the value of each filter, once a part
    shares = F.map_from_arrays(
        F.array(*(F.lit(1 << i).cast("long") for i in range(len(letters)))),
        F.array(*(sum((n * (kept(s) - kept(s + b)) for (s, b), n in sorted(ways.items()) if b == 1 << i), F.lit(0).cast("long")) for i in range(len(letters)))),
    )
    each = wide.withColumn("shapley", shares).select("*", F.inline(table))
    after = F.col("before") + F.col("bit")
    removed = F.col("kept")[F.col("before")] - F.col("kept")[after]
    others = F.lit(full).cast("long") - F.col("bit")
    fails = kept(0) - F.col("kept")[F.col("bit")]
    return each.select(
        "part",
        "filter_order",
        "step",
        F.col("kept")[after].alias("kept"),
        removed.alias("removed"),
        (fails - removed).alias("redundant"),
        (F.col("kept")[others] - kept(full)).alias("unique_fails"),
        *((F.col(m)[F.col("before")] - F.col(m)[after]).alias(f"lost_{i}") for i, m in enumerate(marks)),
        F.col("shapley")[F.col("bit")].alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over ``docs`` (doc_id, text, lang) by lang, with ``labels`` (doc_id, quality, toxic).

    E fails a row whose text a row of smaller doc_id has; null and empty texts are equal.  A null doc_id fails no E
    and has no labels.  Repeated rows count as often as they stand there and, having one id, don't fail E for one
    another.  A document with several labels is good, or toxic, if one of them says so.  An empty table gives no
    rows.  Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.unhex(F.sha2(text, 256)).alias("key"), *(c.alias(f"fails_{k}") for k, c in text_failures(F.col("text")).items()))
    rows = repeats_earlier(materialize(rows), "doc_id", "key", "fails_E").drop("key")
    said = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
    known = rows.join(said, "doc_id", "left")
    return all_orders(audit_filters(known, "lang", [f"fails_{k}" for k in "ABCDE"], ["good", "bad"]), "ABCDE").withColumnsRenamed({"lost_0": "good_lost", "lost_1": "toxic_lost"})
