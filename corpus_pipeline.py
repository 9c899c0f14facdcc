"""The corpus pipeline: toxicity, near duplicates, personal data, mixing of sources, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import fresh, materialize
from wardline.llm.mixing import mix_sources
from wardline.llm.ngram_join import ngram_join
from wardline.llm.packing import pack
from wardline.llm.pii import sanitise
from wardline.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score THRESHOLD or more go; null and empty texts stay.  Learns from labels whose crc32(doc_id) mod 3 isn't 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    (score,) = fresh(docs, "score")
    return score_toxicity(docs, fit_toxicity(docs, labels), score_col=score).filter(F.col(score) < THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five-word shingles, the one of smallest id stays, null ids last.

    A document is a row's id and text together, so ids may be null or repeated: of rows that agree in both one
    stays, rows of one id whose texts aren't linked all stay.  Documents without words stay.
    """
    node, i, one, more = fresh(docs, "node", "id", "one", "more")
    keyed = docs.withColumn(node, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    linked = ngram_join(keyed.select(F.col(node).alias("doc_id"), "text"), k=5, num=4, den=5).select(F.col("doc_id").alias(node), F.col("component_id").alias(i)).distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(node).alias("node")))
    kept = materialize(keyed.select("doc_id", node).distinct().join(linked, node).groupBy(i).agg(first.alias(one)).select(F.col(f"{one}.node").alias(node)))
    # a second hash tells apart what shares a node by chance; copies of a row shrink to one a task before they travel
    rows = keyed.join(kept, node, "left_semi").withColumn(more, F.xxhash64(F.lit(1), F.col("text").cast("string"), F.col("doc_id").cast("long")))
    first = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns))
    return rows.groupBy(node, more).agg(first.alias(one)).select(*(F.col(f"{one}.`{c}`").alias(c) for c in docs.columns))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it become placeholders or go; all documents stay."""
    return sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands in the mix as often as its source's target takes it, whole; those that it doesn't take go.

    Rows that agree in id, source and text share the greatest of their numbers.
    """
    i, h, copies, each = fresh(docs, "id", "h", "copies", "each")
    told = mix_sources(docs.select("doc_id", "source", "text"), keep_hash=True).groupBy(F.col("doc_id").alias(i), F.col("row_hash").alias(h)).agg(F.max("copies").alias(copies))
    told = materialize(told.filter(F.col(copies) > 0)).alias("t")
    rows = docs.alias("d").join(told, F.col("d.doc_id").cast("long").eqNullSafe(F.col(f"t.{i}")) & (F.xxhash64("d.source", "d.text") == F.col(f"t.{h}")))
    return rows.withColumn(each, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int")))).select(*(F.col(f"d.{c}") for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens as pieces of documents, with their ids; a document's copies are packed one by one."""
    return pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", remove_personal_data),
    ("mixing", mix),
    ("packing", pack_sequences),
]

#: SQL can't express the learned score of the first stage; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
