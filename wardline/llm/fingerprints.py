"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

For term x of weight w, sample k draws r, c from Gamma(2, 1) and b uniform, all by hash of (x, k); with
t = floor(ln w / r + b), ln a = ln c - r (t - b) - r.  The term of least a gives the sample (x, t), and two
texts agree in a sample with probability sum of least weights over sum of greatest weights.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions_for

SPACE = r"[\x20\x09-\x0D]+"
SAMPLES = 32
#: Code points at the end of a text that are replaced in its edited form: one in so many.
PART = 2


def _half(h: Column, high: bool) -> Column:
    """(0, 1) from one half of a 64-bit hash."""
    bits = F.shiftrightunsigned(h, 33) if high else h.bitwiseAND(F.lit(0x7FFFFFFF))
    return (bits.cast("double") + 0.5) / float(1 << 31)


def sample(term: Column, log_weight: Column, k: int) -> Column:
    """Sample k of a term as a long: high bits order by ln a, the low 16 name (term, t)."""
    one, two, three = (F.xxhash64(term, F.lit(3 * k + j)) for j in range(3))
    r = -F.ln(_half(one, True) * _half(one, False))
    log_c = F.ln(-F.ln(_half(two, True) * _half(two, False)))
    b = _half(three, True)
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t.cast("double") - b) - r
    name = F.xxhash64(term, t + F.lit(k)).bitwiseAND(F.lit(0xFFFF))
    return F.shiftleft(((log_a + 400.0) * float(1 << 34)).cast("long"), 16).bitwiseOR(name)


def fingerprint_terms(counted: DataFrame, keys: list[str], weights: dict[str, str], samples: int = SAMPLES) -> DataFrame:
    """``counted`` (keys..., term long or null, weight columns) -> keys and a fingerprint for each of ``weights`` (name: column).

    4 hex digits a sample, empty without terms.  What depends on the term alone is computed once for all weights.
    """
    # a null logarithm makes a null sample, which no minimum takes; a condition around it would hide the shared parts
    logs = counted.select(*keys, "term", *(F.when(F.col("term").isNotNull(), F.ln(F.col(w).cast("double"))).alias(n) for n, w in weights.items()))
    lows = logs.groupBy(*keys).agg(*(F.min(sample(F.col("term"), F.col(n), k)).alias(f"{n}{k}") for k in range(samples) for n in weights))
    return lows.select(*keys, *(F.lower(F.concat_ws("", *(F.lpad(F.hex(F.col(f"{n}{k}").bitwiseAND(F.lit(0xFFFF))), 4, "0") for k in range(samples)))).alias(n) for n in weights))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of samples in which two fingerprints agree; two empty ones are alike, an empty and another not at all."""
    same = sum((F.substring(a, 4 * k + 1, 4) == F.substring(b, 4 * k + 1, 4)).cast("int") for k in range(samples))
    return F.when(a.isNull() | b.isNull(), None).when((a == "") | (b == ""), (a == b).cast("double")).otherwise(same / float(samples))


def _told_apart(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with repeats (long): rows of one id and text that are a large part of all stand twice, last with repeats 1.

    Each but the last of such rows is followed by its like, so one of them speaks for all, and only the last meets
    another text.  Groups of over a bucket's share of rows are settled so; they are fewer than buckets.
    """
    n = partitions_for(docs) * 4
    hashes = [F.col("doc_id"), F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]
    names = ["hid", "h1", "h2"]
    least = max(2, docs.count() // n)
    heavy = docs.groupBy(*(h.alias(x) for h, x in zip(hashes, names))).agg(F.count("*").alias("c")).filter(F.col("c") > least)
    heavy = materialize(heavy)  # below n rows, read twice
    same = reduce(lambda a, b: a & b, (h.eqNullSafe(F.col(x)) for h, x in zip(hashes, names)))
    few = docs.join(F.broadcast(heavy), same, "left_anti").select("doc_id", "text", F.lit(1).cast("long").alias("repeats"))
    many = docs.join(F.broadcast(heavy), same).groupBy(*names).agg(F.min("text").alias("text"), F.max("c").alias("c"))
    both = many.select(F.col("hid").alias("doc_id"), "text", F.explode(F.array(F.col("c") - 1, F.lit(1).cast("long"))).alias("repeats"))
    return few.unionByName(both)


def _repeated(rows: DataFrame) -> DataFrame:
    """Each row as often as its repeats say, made by several tasks where they are over 10,000."""
    lots = F.sequence(F.lit(0).cast("long"), F.floor((F.col("repeats") - 1) / 10_000))
    dealt = rows.withColumn("lot", F.explode(lots)).repartition(partitions_for(rows), "doc_id", "lot")
    left = F.least(F.col("repeats") - F.col("lot") * 10_000, F.lit(10_000)).cast("int")
    return dealt.withColumn("one", F.explode(F.array_repeat(F.lit(1), left))).drop("repeats", "lot", "one")


def _in_order(docs: DataFrame) -> DataFrame:
    """(bucket, ghost, doc_id, text), and repeats if some id is hot: ranges of ascending ids, each with the row that follows it as a ghost.

    Bounds are quantiles of the ids, as many as there are shuffle partitions, four times.  Rows of one id, or of none,
    are split by a hash of the text where they are many, and what agrees in both is told apart by `_told_apart`.
    """
    n = partitions_for(docs) * 4
    place = F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))
    told = docs.select(place.alias("p")).agg(F.percentile_approx("p", [i / n for i in range(1, n)], n * 20).alias("b")).first()["b"] or []
    # an id that several quantiles fall on fills several buckets, by the hash of the text, which orders its rows
    hot = {v: c for v, c in Counter(told).items() if c > 1}
    share = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x).cast("long") for x in sum(hot.items(), ())]), place), F.lit(1)) if hot else F.lit(1)
    part = F.least(share - 1, F.floor((F.xxhash64("text").cast("double") / 2.0**64 + 0.5) * share))
    bucket = F.size(F.filter(F.array(*map(F.lit, sorted({*told}))).cast("array<long>"), lambda b: b < place)).cast("long") * n + part
    docs = (_told_apart(docs) if hot else docs).withColumn("bucket", bucket)
    own = [c for c in docs.columns if c != "bucket"]
    # a bucket's first row, nulls last; the next bucket of the last is the first
    first = docs.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("h"))).alias("first"))
    last = Window.partitionBy(F.lit(1)).orderBy("bucket")
    first = first.select(F.col("bucket").alias("fb"), F.col("first.doc_id").alias("fid"), F.col("first.h").alias("fh"), F.coalesce(F.lag("bucket").over(last), F.max("bucket").over(Window.partitionBy(F.lit(1)))).alias("previous"))
    # at most as many rows as buckets
    tagged = docs.join(F.broadcast(first), (F.col("bucket") == F.col("fb")) & F.col("doc_id").eqNullSafe(F.col("fid")) & (F.xxhash64("text") == F.col("fh")), "left").select(*own, "bucket", "previous")
    none = F.array().cast("array<struct<bucket:long,ghost:int>>")
    both = F.concat(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ghost"))), F.when(F.col("previous").isNotNull(), F.array(F.struct(F.col("previous").alias("bucket"), F.lit(1).alias("ghost")))).otherwise(none))
    return tagged.select(*own, F.explode(both).alias("x")).select("x.bucket", "x.ghost", *own).repartition(n, "bucket")


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of ``docs`` (doc_id, text).

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next row's, by ascending id (null ids last, rows of one id by a hash of the text), the first following the
    last.  Null texts count as empty; an empty text's fingerprint is empty.  A single row follows itself.
    Equal texts have equal fingerprints, so repeated rows do.  A long text is a row of strings and of its distinct
    terms; other columns are not read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = _in_order(base)
    repeats = ["repeats"] if "repeats" in rows.columns else []
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), *map(F.desc, repeats))
    n, m = F.length("text"), F.floor(F.length("text") / PART).cast("int")
    rows = rows.select("bucket", "ghost", "doc_id", "text", *repeats, F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("next"))
    edited = F.concat(F.substring("text", F.lit(1), n - m), F.substring(F.coalesce("next", "text"), F.lit(1), m))
    about = rows.filter("ghost = 0").select("bucket", "rn", "doc_id", *repeats, n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"))
    # the words of both forms: those before the last space ahead of the cut, and either's rest
    stem = F.regexp_extract(F.substring("text", F.lit(1), n - m), r"(?s)^(.*[\x20\x09-\x0D])", 1)
    split = rows.select("bucket", "rn", "ghost", "text", edited.alias("edited"), F.when(F.col("ghost") == 0, stem).otherwise("").alias("stem"))
    part = lambda i, c: F.struct(F.lit(i).alias("part"), c.alias("t"))
    after = F.length("stem") + 1
    own = part(1, F.substring("text", after, F.length("text")))
    parts = F.when(F.col("ghost") == 0, F.array(part(0, F.col("stem")), own, part(2, F.substring("edited", after, F.length("edited"))))).otherwise(F.array(own))
    words = split.select("bucket", "rn", F.explode(parts).alias("x")).select("bucket", "rn", F.col("x.part").alias("part"), F.explode_outer(F.split(F.col("x.t"), SPACE)).alias("word"))
    terms = words.select("bucket", "rn", "part", F.when(F.col("word") != "", F.xxhash64("word")).alias("term"))
    counted = terms.groupBy("bucket", "rn", "term").agg(F.count(F.when(F.col("part") != 2, 1)).alias("w0"), F.count(F.when(F.col("part") != 1, 1)).alias("w1"))
    pair = fingerprint_terms(counted, ["bucket", "rn"], {"fingerprint": "w0", "edited_fingerprint": "w1"}, samples)
    pair = pair.withColumn("after", F.coalesce(F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("rn")), "fingerprint"))
    done = about.join(pair, ["bucket", "rn"]).select(
        "doc_id", *repeats, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("after"), samples).alias("near_next"),
    )
    return _repeated(done) if repeats else done
