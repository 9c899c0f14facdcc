"""Personal data: base patterns, and information-theoretic sanitisation of the terms that give them away.

Base spans are e-mail addresses, IP addresses, card and phone numbers.  Entities are protected at two levels: each
value, and each kind.  A term's disclosure of an entity is the share of the entity's information that the term
reveals, PMI(entity; term) / IC(entity) = 1 - ln P(entity | term) / ln P(entity), from co-occurrence in the whole
corpus.  Terms at or over the threshold are spans as well: they are generalised, or removed where they reveal
almost all.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, fresh, materialize, small_batches

KINDS = ("email", "ip", "card", "phone")
# The guards before a run only keep the search linear; a match can't begin there otherwise.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_REST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_TERM = re.compile(r"[^\W\d_]{3,}")

#: Words on either side of an entity that count as near it.
WINDOW = 8
#: Distinct contexts of the entity that must hold the term; shares of the entity's information from which a term
#: discloses it, and from which it is removed.
SUPPORT, DISCLOSURE, CERTAIN = 3, 0.9, 0.99
#: Bits of the filter of candidate terms: 2^22 of them are half a megabyte at any size of the corpus.
FILTER_BITS = 1 << 22


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str):
    """Leftmost non-overlapping matches of _EMAIL in linear time: each is looked for back from its @."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL_REST.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            low = m.end()
        at = text.find("@", m.end() if m else at + 1)
        if not m and at >= 0:
            low = max(low, text.rfind("@", low, at) + 1)


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind in the order of KINDS; code points, end exclusive."""
    if not text:
        return []
    out = [(s, e, 0) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _DIGITS.sub("", m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
                out.append((m.start(), m.end(), 3))
    out.sort(key=lambda x: (x[0], x[2]))
    return [(s, e, KINDS[k]) for s, e, k in out]


def join_spans(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _h64(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_WORD = re.compile(r"\S+")


def _near(text: str, spans):
    """(kind, entity, context, term): the terms among WINDOW words on either side of each entity, and a hash of them all.

    A word that the span cuts counts on both sides.  Only a text with spans has its words' places listed.
    """
    out = set()
    places = [m.span() for m in _WORD.finditer(text)]
    starts, ends = [a for a, _ in places], [b for _, b in places]
    for s, e, kind in spans:
        entity = _h64(f"{kind}:{text[s:e] if kind == 'email' else _DIGITS.sub('', text[s:e])}")
        at, after = bisect_left(starts, s), bisect_right(ends, e)
        around = [(a, min(b, s)) for a, b in places[max(0, at - WINDOW) : at]] + [(max(a, e), b) for a, b in places[after : after + WINDOW]]
        words = [m.group() for a, b in around for m in _TERM.finditer(text[a:b].lower())]
        context = _h64(" ".join(words))
        out.update((kind, entity, context, w) for w in words)
    return out


_NEAR = "struct<kind:string,entity:long,context:long,term:string>"
_NEAR_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("entity", pa.int64()), ("context", pa.int64()), ("term", pa.string())]))


def _detect(batches):
    for batch in batches:
        ids, texts, keys = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
        found = [base_spans(t) for t in texts]
        said = [join_spans(f) for f in found]
        near = [sorted(_near(t, f)) if f else [] for t, f in zip(texts, found)]
        yield pa.RecordBatch.from_arrays(
            [
                ids.cast(pa.int64()),
                keys,
                *(pa.array([sum(x[2] == k for x in f) for f in found], pa.int64()) for k in KINDS),
                pa.array([hashlib.sha256(s.encode()).hexdigest() for s in said], pa.string()),
                pa.array(said, pa.string()),
                pa.array([[dict(zip(("kind", "entity", "context", "term"), x)) for x in n] for n in near], _NEAR_ARROW),
            ],
            ["doc_id", "key", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "near"],
        )


def _terms_in(docs: DataFrame, terms: DataFrame, first_only: bool) -> DataFrame:
    """(doc_id, key, term, start, end) wherever a term of ``terms`` is a word of a text; exact, the filter only thins."""
    terms = terms.select("term").distinct()
    listed = materialize(terms)
    bits = np.zeros(FILTER_BITS // 8, np.uint8)

    def slots(batches):
        for batch in batches:
            at = [_h64(t) % FILTER_BITS for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a // 32 for a in at], pa.int64()), pa.array([1 << (a % 32) for a in at], pa.int64())], ["w", "bit"])

    for r in listed.mapInArrow(slots, "w long, bit long").groupBy("w").agg(F.expr("bit_or(bit)").alias("bits")).collect():
        bits[r["w"] * 4 : r["w"] * 4 + 4] = np.array([r["bits"]], "<u4").view(np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def find(batches):
        have = sent.value
        known: dict[str, bool] = {}
        for batch in batches:
            rows = []
            for i, text, key in zip(*(batch.column(j).to_pylist() for j in range(3))):
                if not text or not have.any():
                    continue
                low = text.lower()
                if len(low) != len(text):  # a letter that changes length: offsets need the text itself
                    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
                seen = set()
                for m in _TERM.finditer(low):
                    w = m.group()
                    if (yes := known.get(w)) is None:
                        if len(known) > 400_000:
                            known.clear()
                        a = _h64(w) % FILTER_BITS
                        yes = known[w] = bool(have[a >> 3] >> (a & 7) & 1)
                    if yes and not (first_only and w in seen):
                        seen.add(w)
                        rows.append((i, key, w, m.start(), m.end()))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["doc_id", "key", "term", "start", "end"])

    return docs.select("doc_id", "text", "key").mapInArrow(find, "doc_id long, key long, term string, start long, end long").join(listed, "term")


def share_revealed(both: Column, n: Column, entity: Column, texts: Column) -> Column:
    """1 - ln P(entity | term) / ln P(entity), with P(entity | term) = both / n and P(entity) = entity / texts; 1 for certainty.

    An entity that is in every text holds no information, so nothing reveals it.
    """
    base = F.ln(F.least(F.lit(1.0), entity / texts))
    return F.when(base < 0, 1 - F.ln(both / n) / base).otherwise(0.0)


def disclosures(found: DataFrame, docs: DataFrame, support: int = SUPPORT, threshold: float = DISCLOSURE) -> DataFrame:
    """(term, share): the terms that give an entity away, with the largest share of an entity's information that each reveals.

    Entities are values and kinds.  both counts an entity's distinct contexts with the term, entity its distinct
    contexts, texts the distinct texts of the corpus, and n the distinct texts with the term or the distinct
    contexts of any entity with it, whichever are more; copies so teach nothing.  n is those contexts at least,
    so only terms that reach the threshold among them are counted over the corpus.
    """
    near = materialize(found.select(F.explode("near").alias("x")).select("x.*").distinct())
    texts = found.select("key").distinct().count()
    levels = near.select("term", "context", F.explode(F.array(F.struct(F.lit("value").alias("level"), F.concat_ws(":", "kind", F.col("entity").cast("string")).alias("name")), F.struct(F.lit("kind").alias("level"), F.col("kind").alias("name")))).alias("e")).select("term", "context", "e.*").distinct()
    pairs = levels.groupBy("term", "level", "name").agg(F.count("*").alias("both")).filter(F.col("both") >= support)
    entities = levels.select("level", "name", "context").distinct().groupBy("level", "name").agg(F.count("*").alias("entity"))
    around = near.select("term", "context").distinct().groupBy("term").agg(F.count("*").alias("upto"))
    revealed = lambda n: share_revealed(F.col("both"), n, F.col("entity"), F.lit(float(max(1, texts))))
    best = pairs.join(around, "term").join(entities, ["level", "name"]).filter(revealed(F.col("upto")) >= threshold)
    best = materialize(best.select("term", "both", "entity", "upto"))
    forget(near)
    if best.isEmpty():
        return best.select("term", F.lit(1.0).alias("share"))
    n = _terms_in(docs, best, True).select("term", "key").distinct().groupBy("term").agg(F.count("*").alias("n"))
    told = best.join(n, "term").withColumn("share", revealed(F.greatest("n", "upto"))).filter(F.col("share") >= threshold)
    return materialize(told.groupBy("term").agg(F.max("share").alias("share")))


def _find(docs: DataFrame, id_col: str, text_col: str, support: int, threshold: float) -> DataFrame:
    """What :func:`find_pii` gives, as doc_id, with key, the hash of the row's text."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    found = materialize(base.mapInArrow(_detect, "doc_id long, key long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, base string, near array<" + _NEAR + ">"))
    told = disclosures(found, base, support, threshold)
    kept = found.drop("near")
    if told.isEmpty():
        out = kept.select("*", F.col("base").alias("spans"), F.lit(0).cast("long").alias("n_term"))
    else:
        at = _terms_in(base, told, False).join(told, "term").select("doc_id", "key", F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.lit(4).alias("k"), F.when(F.col("share") >= CERTAIN, "remove").otherwise("term").alias("kind")).alias("x")).distinct()
        terms = at.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(F.collect_list("x").alias("terms"))
        parts = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[1].cast("long").alias("s"), F.split(x, ":")[2].cast("long").alias("e"), F.array_position(F.array(*map(F.lit, KINDS)), F.split(x, ":")[0]).cast("int").alias("k"), F.split(x, ":")[0].alias("kind")))
        # order of a kind among spans with one start: as listed, terms last
        every = F.array_sort(F.concat(F.transform(parts, lambda x: F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e"), x.kind.alias("kind"))), F.transform(F.coalesce("terms", F.array()), lambda x: F.struct(x.s.alias("s"), (x.k + 1).alias("k"), x.e.alias("e"), x.kind.alias("kind")))))
        spans = F.array_join(F.transform(every, lambda x: F.concat_ws(":", x.kind, x.s.cast("string"), x.e.cast("string"))), ",")
        out = kept.join(terms, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left").select(*kept.columns, F.when(F.col("terms").isNull(), F.col("base")).otherwise(spans).alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term"))
    return out.select("doc_id", "key", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_term")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, threshold: float = DISCLOSURE) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term) of every row, spans being kind:start:end joined by commas.

    A null or empty text has no spans.  Each row has the spans of its own text, whether its id is null, repeated
    or neither; repeated rows have the same.  A text of any length is searched whole, in linear time, with the places
    of its words in memory if it has base spans.  Terms tie by no order: all that reach the threshold count.
    An empty table gives an empty one; other columns are not read.
    """
    return _find(docs, id_col, text_col, support, threshold).drop("key").withColumnRenamed("doc_id", id_col)


# What a span of each kind becomes.
PLACEHOLDER = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "remove": ""}


def sanitise_text(text: str | None, spans: str | None) -> str | None:
    """``text`` with its spans replaced; overlapping spans become the first one's placeholder together.

    Where what is left and right of a removed term makes a base span, that goes as well.
    """
    while text and spans:
        out, at, parts = [], 0, []
        for x in spans.split(","):
            kind, s, e = x.split(":")
            if parts and int(s) < parts[-1][1]:
                parts[-1][1] = max(parts[-1][1], int(e))
            else:
                parts.append([int(s), int(e), kind])
        for s, e, kind in parts:
            out += [text[at:s], PLACEHOLDER[kind]]
            at = e
        text = "".join([*out, text[at:]])
        spans = join_spans(base_spans(text))
    return text


def sanitise(docs: DataFrame, support: int = SUPPORT, threshold: float = DISCLOSURE) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the texts sanitised and n_chars, if there, counted anew; all rows and columns stay.

    Every row is sanitised by the spans of its own text; ids may be null or repeated.  No base span is left.
    """
    i, key, said = fresh(docs, "id", "key", "spans")
    spans = _find(docs, "doc_id", "text", support, threshold).filter("spans <> ''").select(F.col("doc_id").alias(i), F.col("key").alias(key), F.col("spans").alias(said)).distinct()
    names = docs.columns
    joined = docs.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(F.col("text").cast("string")) == F.col(key)), "left").select(*names, said)
    at = names.index("text")

    def run(batches):
        for batch in batches:
            said = batch.column(len(names)).to_pylist()
            texts = batch.column(at).to_pylist()
            own = None if len({*said}) == 1 and said[0] is None else True
            columns = [batch.column(i) for i in range(len(names))]
            if own:
                columns[at] = pa.array([sanitise_text(t, s) for t, s in zip(texts, said)], batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in names else out
