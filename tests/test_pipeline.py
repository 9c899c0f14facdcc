from pyspark.sql import functions as F

from wardline.operators import pipeline as P


def results(spark, *rows):
    return spark.createDataFrame([(list(rows),)], f"r array<{P.RESULT}>")


def test_combine_and_short_circuit(spark):
    df = results(spark, ("a", 0.2, True), ("b", 0.95, False), ("c", 0.5, False))
    got = df.select(P.combine(F.col("r")).alias("c"), P.combine(P.short_circuit(F.col("r"))).alias("s"), P.combine(P.batched_short_circuit(F.col("r"), 0.9, 3)).alias("b")).first()
    assert got.c.risk_score == 0.95 and not got.c.is_valid and got.c.n_results == 3
    assert got.s.n_results == 2 and got.b.n_results == 3
    empty = results(spark).select(P.combine(F.col("r")).alias("c")).first().c
    assert empty.is_valid and empty.risk_score == 0 and empty.n_results == 0


def test_order_does_not_matter_for_risk(spark):
    a = results(spark, ("a", 0.2, True), ("b", 0.7, False)).select(P.combine(F.col("r")).alias("c")).first().c
    b = results(spark, ("b", 0.7, False), ("a", 0.2, True)).select(P.combine(F.col("r")).alias("c")).first().c
    assert (a.risk_score, a.is_valid) == (b.risk_score, b.is_valid)


def test_guard(spark):
    df = spark.createDataFrame([(1, "you are an idiot"), (2, "a good day")], "id long, text string")
    got = {r.id: r for r in P.Guard().add("toxicity").add("token_limit").scan(df).collect()}
    assert not got[1].is_valid and got[1].severity == "high" and got[2].is_valid and got[2].severity == "none"
    hooked = P.Guard().add("toxicity").scan(df, before=lambda d: d.filter("id = 1"), after=lambda d: d.withColumn("seen", F.lit(1)))
    assert hooked.count() == 1 and "seen" in hooked.columns
    assert P.Guard().scan(df).filter("is_valid").count() == 2
    for name in P.PRESETS:
        assert P.Guard.preset(name).scan(df).count() == 2


def test_policy(spark):
    df = spark.createDataFrame([("x", 0.1, True), ("y", 0.6, True), ("z", 0.1, True)], "k string, risk_score double, is_valid boolean")
    rules = spark.createDataFrame([("x", "block", 0.5, "r1"), ("y", "audit", 0.2, "r2")], "k string, action string, adjustment double, rule_id string")
    got = {r.k: r for r in P.apply_policy(df, rules, "k").collect()}
    assert not got["x"].is_valid and got["x"].risk_score == 0.5 and got["y"].risk_score == 0.6 and got["z"].policy_rule is None


def test_allow_block(spark):
    v = P.allow_block(F.col("t"), ["Good"], ["bad"])
    row = spark.createDataFrame([("a good thing",)], "t string").select(v["allowed"].alias("a"), v["blocked"].alias("b")).first()
    assert row.a and not row.b
