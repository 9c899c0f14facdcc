"""Entity decoding, overlapping spans and batched pipelines over the driver tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.table import register_tables
from ..operators import intervals, scanners, spans
from ..operators.pipeline import allow_block, batched_short_circuit, combine, result
from . import report_queries as rq
from .scan_oracles import docs, q
from .scan_queries import R, table

#: Labels by a word's length modulo their number, and spans of one document.
LABELS = ("O", "B-PERSON", "I-PERSON", "I-ORG", "B-ORG", "I-PERSON")
SPANS_OF_ONE = 10


def anon_bio(spark, sf_dir):
    """Entities of words labelled by their lengths, ten places apart, by document and kind; empty words have no width."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word")).withColumn("n", F.length("word"))
    label = F.element_at(F.array(*map(F.lit, LABELS)), F.col("n") % len(LABELS) + 1)
    tokens = words.select("doc_id", "pos", label.alias("label"), (F.col("pos") * 10).alias("start"), (F.col("pos") * 10 + F.col("n")).alias("end"), F.when(F.col("n") % 4 == 0, 0.75).otherwise(1.0).alias("confidence"))
    found = spans.decode_bio(tokens)
    return found.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


def anon_resolve_overlaps(spark, sf_dir):
    """What is left of ten spans of each document, placed by its id, of three confidences."""

    def one(i):
        start = (F.col("doc_id") * 7 + i * 8) % 40
        sure = F.element_at(F.array(F.lit(0.5), F.lit(0.7), F.lit(0.9)), ((F.col("doc_id") + i * i) % 3 + 1).cast("int"))
        text = F.lit("")
        return F.struct(F.lit(f"k{i}").alias("kind"), text.alias("category"), text.alias("severity"), start.cast("int").alias("start"), (start + 3 + (F.col("doc_id") + i * 5) % 17).cast("int").alias("end"), sure.alias("confidence"), text.alias("value"))

    made = table(spark, sf_dir, "documents").select("doc_id", F.array(*map(one, range(SPANS_OF_ONE))).cast(spans.SPANS).alias("s"))
    return made.select("doc_id", spans.resolve_overlaps(F.col("s")).alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.array_join("s.kind", ",").alias("kinds"))


def pipe_batched(spark, sf_dir):
    """Three scanners, two at a time: all of a batch count if one of it stops the run."""
    t = F.col("text")
    results = F.array(result("toxicity", scanners.toxicity(t)), result("token_limit", scanners.token_limit(t, 512)), result("injection", scanners.prompt_injection(t)))
    d = rq._docs(spark, sf_dir, "injection").withColumn("results", results)
    d = d.withColumn("c", combine(batched_short_circuit(F.col("results"), 0.85, 2)))
    return d.select("doc_id", F.col("c.n_results").cast("long").alias("n_results"), R(F.col("c.risk_score")).alias("risk_score"), F.col("c.is_valid").alias("is_valid"))


def pipe_allow_block_cased(spark, sf_dir):
    """Lists whose rules differ in case: ``The `` as it is written, ``DER `` in any case."""
    v = allow_block(F.col("text"), ["The ", ("DER ", True)], [("MAIL", True), "Idiot"], any_case=False)
    return table(spark, sf_dir, "documents").select("doc_id", v["allowed"].alias("allowed"), v["blocked"].alias("blocked"))


#: Two detectors whose findings overlap.
NAMES, NUMBERED = r"[A-Z][a-z]+ [a-z]+", r"[a-z]+ [a-z0-9]+[.,]"


def _found(spark, sf_dir, kind: str, pattern: str):
    found = spans.spans_udf([spans.Rule(kind, pattern, 1.0)])(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.start", "s.end")


def detect_span_overlaps(spark, sf_dir):
    """Pairs of overlapping findings of two detectors, and how many code points they share, by document."""
    pairs = intervals.overlapping(_found(spark, sf_dir, "name", NAMES), _found(spark, sf_dir, "end", NUMBERED), ("doc_id",))
    shared = F.least("end", "other_end") - F.greatest("start", "other_start")
    return pairs.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(shared).cast("long").alias("shared"), F.min("start").cast("long").alias("first"))


def detect_spans_beside(spark, sf_dir):
    """Findings of the second detector that neither begin nor end within one of the first, by document."""
    left = intervals.beside(_found(spark, sf_dir, "end", NUMBERED), _found(spark, sf_dir, "name", NAMES), ("doc_id",), when=intervals.ends_within())
    return left.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("start").cast("long").alias("starts"))


def detect_spans_lateral(spark, sf_dir):
    """Spans of the table function in a lateral join, by kind: the same as of the arrays."""
    register_tables(spark)
    rq._docs(spark, sf_dir, "pii").createOrReplaceTempView("guard_documents")
    return spark.sql("SELECT s.kind, count(*) AS n, sum(s.end - s.start) AS letters FROM guard_documents d, LATERAL guard_spans(d.text, 'entities') s WHERE s.kind IN ('EMAIL') GROUP BY s.kind")


def anon_literal_roundtrip(spark, sf_dir):
    """Texts that hold strings like placeholders, anonymised and restored: each comes back as it was."""
    t = F.concat(F.lit("see [EMAIL_1], [[PERSON_2]] and "), F.col("text"), F.lit(" [X_[EMAIL_3]]"))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 50).alias("session"), t.alias("text"))
    done, mapping = spans.anonymise(docs, "session", order=("doc_id",), stored=True)
    return spans.deanonymise(done, mapping, "session").select("doc_id", F.sha2("restored", 256).alias("restored"), F.contains("anonymised", F.lit("[LITERAL_")).alias("marked"))


QUERIES = {f.__name__: f for f in (anon_bio, anon_resolve_overlaps, pipe_batched, pipe_allow_block_cased, detect_span_overlaps, detect_spans_beside, detect_spans_lateral, anon_literal_roundtrip)}


def _spans_sql(name: str, pattern: str) -> str:
    """Offsets of all matches: each begins after the pieces and matches before it."""
    return f"""{name}_m AS (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p FROM documents),
{name} AS (SELECT doc_id, (list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0))::BIGINT AS a, len(m[i]) AS w FROM {name}_m, LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i) r)"""


_both = f"WITH {_spans_sql('x', NAMES)}, {_spans_sql('y', NUMBERED)}"

_label = "([" + ", ".join(f"'{x}'" for x in LABELS) + f"])[length(word) % {len(LABELS)} + 1]"
_span = f"{{'start': (doc_id * 7 + i * 8) % 40, 'i': i, 'stop': (doc_id * 7 + i * 8) % 40 + 3 + (doc_id + i * 5) % 17, 'sure': ([0.5, 0.7, 0.9])[(doc_id + i * i) % 3 + 1]}}"

_email = next(r.pattern for r in spans.ENTITIES if r.kind == "EMAIL")

ORACLES = {
    "detect_spans_lateral": f"WITH {docs('pii')}, m AS (SELECT unnest(regexp_extract_all(text, {q(_email)})) AS m FROM d) SELECT 'EMAIL' AS kind, count(*) AS n, sum(len(m))::BIGINT AS letters FROM m",
    "detect_span_overlaps": f"{_both} SELECT x.doc_id, count(*) AS n, sum(least(x.a + x.w, y.a + y.w) - greatest(x.a, y.a))::BIGINT AS shared, min(x.a) AS first FROM x JOIN y ON x.doc_id = y.doc_id AND x.a < y.a + y.w AND y.a < x.a + x.w GROUP BY x.doc_id",
    "detect_spans_beside": f"{_both} SELECT doc_id, count(*) AS n, sum(a)::BIGINT AS starts FROM y WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = y.doc_id AND ((y.a >= x.a AND y.a < x.a + x.w) OR (y.a + y.w > x.a AND y.a + y.w <= x.a + x.w))) GROUP BY doc_id",
    "anon_literal_roundtrip": "SELECT doc_id, sha256('see [EMAIL_1], [[PERSON_2]] and ' || text || ' [X_[EMAIL_3]]') AS restored, true AS marked FROM documents",
    "anon_bio": f"""
        WITH w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)),
        t AS (SELECT doc_id, pos, {_label} AS label, pos * 10 AS a, pos * 10 + length(word) AS b, CASE WHEN length(word) % 4 = 0 THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END AS c FROM w WHERE length(word) > 0),
        p AS (SELECT *, lag(label) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM t),
        s AS (SELECT *, sum(CASE WHEN label LIKE 'B-%' OR before IS NULL OR before = 'O' OR before[3:] <> label[3:] THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM p),
        e AS (SELECT doc_id, label[3:] AS kind, run, min(a) AS a, max(b) AS b, avg(c) AS c FROM s WHERE label <> 'O' GROUP BY ALL)
        SELECT doc_id, kind, count(*) AS n, sum(a)::BIGINT AS starts, sum(b)::BIGINT AS ends FROM e WHERE c >= 0.85 GROUP BY ALL""",
    "anon_resolve_overlaps": f"""
        WITH RECURSIVE s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY x.start, x.i) AS nth, x FROM (SELECT doc_id, {_span} AS x FROM documents, range({SPANS_OF_ONE}) r(i))),
        k AS (
            SELECT doc_id, nth, [x] AS kept FROM s WHERE nth = 1
            UNION ALL
            SELECT s.doc_id, s.nth, CASE WHEN s.x.start >= kept[-1].stop THEN list_append(kept, s.x) WHEN s.x.sure > kept[-1].sure THEN list_append(kept[:-2], s.x) ELSE kept END
            FROM k JOIN s ON s.doc_id = k.doc_id AND s.nth = k.nth + 1
        )
        SELECT doc_id, len(kept)::BIGINT AS n, array_to_string(list_transform(kept, lambda y: 'k' || y.i), ',') AS kinds FROM k WHERE nth = {SPANS_OF_ONE}""",
    "pipe_batched": rq._combined(rq._THREE, None).replace("SELECT doc_id, 3 AS n", "SELECT doc_id, CASE WHEN p0.r >= 0.85 - 1e-6 OR p1.r >= 0.85 - 1e-6 THEN 2 ELSE 3 END AS n") + " SELECT * FROM z",
    "pipe_allow_block_cased": "SELECT doc_id, contains(text, 'The ') OR contains(lower(text), 'der ') AS allowed, contains(lower(text), 'mail') OR contains(text, 'Idiot') AS blocked FROM documents",
}
