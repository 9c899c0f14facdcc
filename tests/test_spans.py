import random
import re

import pytest
from pyspark.sql import functions as F

from wardline.operators import spans as S
from wardline.operators import text_agents as A


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_validators():
    assert S.luhn("4111 1111 1111 1111") and not S.luhn("4111 1111 1111 1112") and not S.luhn("4111")
    assert S.social_security("123-45-6789") and not S.social_security("666-45-6789") and not S.social_security("123-00-6789")
    assert S.octets("255.0.0.1") and not S.octets("256.0.0.1")


def test_overlap_rules():
    span = lambda k, s, e, c: (k, "", "", s, e, c, "")
    found = [span("a", 0, 5, 0.5), span("b", 3, 9, 0.9), span("c", 8, 12, 0.7), span("d", 20, 22, 0.1)]
    assert [s[0] for s in S.leftmost(found)] == ["a", "c", "d"]
    assert [s[0] for s in S.surest(found)] == ["b", "d"]


@pytest.mark.parametrize("strategy", ["mask", "hash", "pseudonymize", "remove", "partial_mask"])
def test_redaction(spark, strategy):
    row = S.redact(frame(spark, "mail jane@example.com now", None, ""), strategy=strategy).orderBy("doc_id").collect()
    assert row[0]["n_redacted"] == 1 and "jane@example.com" not in row[0]["redacted"] and row[0]["redacted"].startswith("mail ")
    assert row[1]["redacted"] is None and row[2]["redacted"] == ""


def test_redacted_text_scans_clean(spark):
    first = S.redact(frame(spark, "a@b.co 4111111111111111 10.0.0.1 123-45-6789"))
    again = S.redact(first.select("doc_id", F.col("redacted").alias("text")))
    assert again.first()["n_redacted"] == 0


def test_round_trip(spark):
    rng = random.Random(1)
    parts = ["jane@example.com", "Mr John Doe", "192.168.1.1", "text", "é", "12 Oak Street", "4111-1111-1111-1111", "\n"]
    df = frame(spark, *[" ".join(rng.choices(parts, k=8)) for _ in range(50)], "", None)
    done, mapping = S.anonymise(df, "doc_id")
    back = S.deanonymise(done, mapping, "doc_id")
    assert back.filter(~F.col("restored").eqNullSafe(F.col("text"))).count() == 0
    assert done.filter("anonymised like '%jane@%'").count() == 0
    assert {r.placeholder for r in mapping.filter("entity_type = 'EMAIL'").collect()} >= {"[EMAIL_1]"}


def test_pii_spans_match_the_text(spark):
    df = frame(spark, "café 123-45-6789 jane@example.com 4111111111111111").withColumn("s", S.detect_pii(F.col("text")))
    row = df.first()
    assert [s.kind for s in row.s] == ["ssn", "email", "credit_card"]
    assert all(row.text[s.start : s.end] == s.value for s in row.s)


def test_bio(spark):
    t = [(1, i, label, i * 5, i * 5 + 4, c) for i, (label, c) in enumerate([("B-PER", 0.9), ("I-PER", 0.9), ("O", 1.0), ("I-LOC", 0.95), ("B-LOC", 0.95), ("I-ORG", 0.5)])]
    got = S.decode_bio(spark.createDataFrame(t, "doc_id long, pos int, label string, start int, end int, confidence double")).orderBy("start").collect()
    assert [(r.kind, r.start, r.end) for r in got] == [("PER", 0, 9), ("LOC", 15, 19), ("LOC", 20, 24)]


def test_toxic_spans(spark):
    df = frame(spark, "You are an IDIOT, idiotic", "so ugly a wall", "kill yourself", None).withColumn("s", A.toxic_spans(F.col("text"), 0.6)).orderBy("doc_id").collect()
    assert [s.value for s in df[0].s] == ["idiot"] and df[1].s == [] and df[2].s[0].category == "toxic" and df[3].s is None


def test_code_risk(spark):
    rows = frame(spark, "```int x```", "plain words here", "", None).withColumn("c", A.code_risk(F.col("text"))).orderBy("doc_id").collect()
    assert rows[0].c.risk_score == pytest.approx(1.0) and rows[1].c.risk_score == 0 and rows[2].c.n == 0 and rows[3].c.n is None
    assert re.search("x", "x")


def _sample(tree, rng, groups=None) -> str:
    """A string that a parsed pattern is likely to match."""
    out = ""
    for op, of in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(of)
        elif name in ("NOT_LITERAL", "ANY"):
            out += "~"
        elif name == "IN":
            kind, x = rng.choice(of)
            known = {"LITERAL": lambda x: chr(x), "RANGE": lambda x: chr(rng.randint(*x)), "CATEGORY": lambda x: {"CATEGORY_DIGIT": "7", "CATEGORY_SPACE": " "}.get(str(x), "w")}
            out += known[str(kind)](x) if str(of[0][0]) != "NEGATE" else "~"
        elif name == "BRANCH":
            out += _sample(rng.choice(of[1]), rng)
        elif name == "SUBPATTERN":
            out += _sample(of[3], rng)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(_sample(of[2], rng) for _ in range(rng.randint(of[0], min(of[1], of[0] + 2))))
    return out


def test_what_a_pattern_needs_stands_in_all_that_it_matches():
    import random
    import re
    from re import _parser

    from wardline.functions.text import needs

    rng, unseen = random.Random(5), []
    rules = [*S.ENTITIES, S._LITERAL, *S.pii_rules(countries=("us", "uk", "eu")), *S.redaction_rules()]
    patterns = [r.pattern for r in rules] + [r"a?b+(?:c|de){2}", r"(?i:AB)c", r"x(?=yz)", r"(?i)Σ?K\d\d-?\d", r"(\d)\1{3}", r"[^\d]\d{2}3[4-6]?", r"(?:ab|c?)d*", r"(?!no)\d{2}|[a-f]{3}", "(?x) a b"]
    for p in patterns:
        compiled, (folded, strings, digits), held = re.compile(p, re.ASCII), needs(p), 0
        for _ in range(300):
            text = _sample(_parser.parse(p), rng)
            text = rng.choice(("", "x ", "(", "x")) + (text.swapcase() if folded and rng.random() < 0.5 else text) + rng.choice(("", " y", "."))
            if m := compiled.search(text):
                held += 1
                told = m.group().lower() if folded else m.group()
                assert all(any(x in told for x in c) for c in strings), (p, text)
                assert digits <= max(map(len, re.findall("[0-9]+", told)), default=0), (p, text)
        unseen += [] if held else [p]
    assert len(unseen) < 4, unseen
