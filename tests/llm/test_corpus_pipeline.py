"""Each stage of the corpus pipeline against a brute-force version, over small tables with odd rows."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from wardline.llm.pii import base_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice(["the", "on", "er", "ing", "re", "at", "st"]) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(240):
        words = [word() for _ in range(rng.randrange(20, 60))]
        if i % 10 == 3:  # a near copy
            words = docs[-1][1].split()
            words[-1] = "changed"
        if i % 6 == 0:
            words[5:5] = ["idiot", "loser", "idiot"]
        if i % 7 == 0:
            words[3:3] = [f"user{i}@example.com", "10.0.0.1"]
        text = " ".join(words)
        docs.append((i, text, "en", "s" + "aaab"[i % 4], len(text)))
        labels.append((i, int("idiot" in text), 1))
    docs += [(900, None, None, None, None), (901, "", "en", "sa", 0), (902, docs[1][1], "en", "sb", len(docs[1][1])), (None, "no id here", "en", "sa", 10), (903, "mail bob@example.com about one thing and another", "en", "sa", 48), (903, "a text of its own at 10.0.0.1 it is", "en", "sa", 36), (None, "write to ann@example.com at once my friend", "en", "sa", 42), (None, "write to ann@example.com at once my friend", "en", "sa", 42), (902, docs[1][1], "en", "sb", len(docs[1][1]))]
    at = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, q, t) for i, t, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names = docs.columns
    stage = dict(C.STAGES)

    clean = C.materialize(stage["toxicity"](spark, docs, tables))
    assert clean.columns == names
    want = [r for r in docs.collect() if "idiot" not in (r.text or "")]
    assert rows(clean) == sorted(map(tuple, want), key=repr)

    one = C.materialize(stage["near_duplicates"](spark, clean, tables))
    assert one.columns == names
    shingles = {(r.doc_id, r.text): set(zip(*[WORD.findall(r.text or "")[k:] for k in range(5)])) for r in want}
    place = lambda k: (k[0] is None, k[0] or 0, str(k[1]))
    links = {i: [j for j in shingles if shingles[i] and 5 * len(shingles[i] & shingles[j]) >= 4 * len(shingles[i] | shingles[j])] for i in shingles}
    least = {}
    for i in shingles:
        seen, edge = {i}, [i]
        while edge:
            edge = [j for x in edge for j in links[x] if j not in seen and not seen.add(j)]
        least[i] = min(seen, key=place)
    assert sorted(((r.doc_id, r.text) for r in one.collect()), key=repr) == sorted((i for i in least if least[i] == i), key=repr)
    assert one.filter("doc_id is null").count() == 2 and one.filter("doc_id = 903").count() == 2

    safe = C.materialize(stage["pii"](spark, one, tables))
    assert safe.columns == names and safe.count() == one.count()
    mask = lambda t: t and re.sub(r"(user[0-9]+|ann|bob)@example\.com", "[EMAIL]", t).replace("10.0.0.1", "[IP]")
    assert rows(safe.select("doc_id", "text")) == sorted(((r.doc_id, mask(r.text)) for r in one.collect()), key=repr)
    assert not any(base_spans(r.text) or r.n_chars is not None and r.n_chars != len(r.text) for r in safe.collect())

    mixed = C.materialize(stage["mixing"](spark, safe, tables))
    assert mixed.columns == names
    size, got = collections.Counter(), collections.Counter()
    for r in safe.collect():
        size[r.source] += len(WORD.findall(r.text or ""))
    for r in mixed.collect():
        got[r.source] += len(WORD.findall(r.text or ""))
    assert set(map(tuple, mixed.collect())) <= set(map(tuple, safe.collect()))
    total = sum(size.values())
    assert abs(got["sa"] - min(3 * size["sa"], total / 3)) < 80 and abs(got["sb"] - min(3 * size["sb"], 2 * total / 3)) < 80

    packed = stage["packing"](spark, mixed, tables).collect()
    tokens = collections.Counter()
    for r in packed:
        tokens[r.sequence_id] += r.length
        assert len(r.ids) == r.length
    assert max(tokens.values()) <= 2048
    assert sum(tokens.values()) == sum(r.doc_tokens for r in packed if r.start == 0)


def test_clashing_columns(spark, tables):
    """Columns named as those that the stages make stay what they are."""
    docs = spark.read.parquet(f"{tables}/documents.parquet").filter("doc_id < 40")
    for c in ("toxicity", "__score", "__node", "__id", "__n", "__h", "__copies", "__each", "__spans", "component_id"):
        docs = docs.withColumn(c, F.lit("own"))
    for _, run in C.STAGES[:-1]:
        out = run(spark, docs, tables)
        assert out.columns == docs.columns and {r.toxicity for r in out.collect()} == {"own"}


def test_run(spark, tables):
    assert C.run(spark, tables).count() > 0 and C.ORACLE_SQL is None
