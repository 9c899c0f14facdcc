"""Filter audit, token alignment and near-duplicate vectors against brute force and SQL, and on odd inputs."""

import bisect
import collections
import hashlib
import itertools
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import re

from wardline.llm import filter_audit, near_vectors, neighbours, oracles, queries
from wardline.llm import token_alignment as alignment

SF = "/root/testdata/sf0.01"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["op11_embedding_dedup", "op12_filter_audit"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({vars(oracles)[name]})").fetchall()
    same(map(tuple, df.collect()), want)


# filter audit


def audit(rows, labels):
    """Every order's steps counted one by one."""
    fails = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        f["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails.append((lang or "", f, any(q == 1 for j, q, _ in labels if j == i and i is not None), any(x == 1 for j, _, x in labels if j == i and i is not None)))
    out, shapley = [], collections.Counter()
    for part in {p for p, *_ in fails}:
        own = [x for x in fails if x[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, name in enumerate(order):
                gone = [x for x in left if x[1][name]]
                before = [x for x in own if any(x[1][o] for o in order[:k])]
                left = [x for x in left if not x[1][name]]
                shapley[part, name] += len(gone)
                out.append([part, "".join(order), k + 1, len(left), len(gone), sum(x[1][name] for x in before), sum(x[1][name] and sum(x[1].values()) == 1 for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)])
    return [(*r, shapley[r[0], r[1][r[2] - 1]]) for r in out]


def test_filter_audit_against_counting(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "BLOCK", 16)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(150)] + ["ABC", "a#b", "é", "x y"]
    texts = [" ".join(rng.choice(words[: rng.choice([20, 150, 154])]) for _ in range(rng.choice([0, 5, 99, 100, 101, 130]))) for _ in range(60)] + [None, "", " \t\n", "ABCDEFGHIJ" * 20, "a b\x0bc\x85d"]
    texts += [rng.choice(texts) for _ in range(60)]
    rows = [(rng.choice([None, *range(100)]) if rng.random() < 0.3 else 1000 + i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    rows += rows[:5]  # repeated rows
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i, _, _ in rows if rng.random() < 0.6] + [(None, 1, 1), (7, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "x", True) for r in rows], "doc_id long, text string, lang string, key int, fails_A string, good boolean").repartition(3)
    got = filter_audit.audit_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    same(map(tuple, got.collect()), audit(rows, labels))


def test_filter_audit_of_nothing_and_of_long_texts(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_documents(spark.createDataFrame([], "doc_id long, text string, lang string"), labels).count() == 0
    long = [(1, "Ab " * 700_000, "en"), (2, "x" * 2_000_000, "en"), (3, " ".join(map(str, range(200_000))), "en")]
    same(map(tuple, filter_audit.audit_documents(spark.createDataFrame(long, "doc_id long, text string, lang string"), labels).collect()), audit(long, []))


def test_copies_meet_by_id_and_key(spark):
    """Half of all rows share one text."""
    rows = spark.range(40_000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'same' ELSE string(id) END AS key")
    out = filter_audit.repeats_earlier(rows, "doc_id", "key", "late")
    assert out.filter("late").count() == 19_999


# token alignment


def aligned(rows):
    """Whole texts, token by token."""
    tok, docs = alignment.Tokenizers(A, B), []
    for i, t in rows:
        links, groups = collections.Counter(), []
        if t:
            told = [(tok.a.encode(" " + t, add_special_tokens=False).ids, tok.bytes_a), (tok.b.encode(t), tok.bytes_b)]
            if all(b"".join(table[k] for k in ids) == (" " + t).encode() for ids, table in told):
                ends = [list(itertools.accumulate(len(table[k]) for k in ids)) for ids, table in told]
                cut = sorted(set(ends[0]) & set(ends[1]))
                groups = [([], []) for _ in cut]
                for side in (0, 1):
                    for k, e in zip(told[side][0], ends[side]):
                        groups[bisect.bisect_left(cut, e)][side].append(k)
                links = collections.Counter(x for a, b in groups for x in itertools.product(a, b))
        docs.append((i, groups, links))
    count, best = collections.Counter(k for _, _, found in docs for k in found), collections.Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    for i, g, found in docs:
        sha = hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g).encode()).hexdigest() if g else ""
        yield i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(found.values()), sum(n for k, n in found.items() if count[k] == best[k[0]]), sum(n * count[k] for k, n in found.items()), sha


ODD = [None, "", " ", "  ", "a  b\n c \n\n d  ", "x▁y z", "▁", "<s> <|endoftext|> <0x41> </s> <unk>", "日本語のテキスト です　全角 空白", "é  b   c\x1c d\x85 e  f", "\t\ta\r\n\r\n  b", "😀😀 👩‍👩‍👧 x" * 3, "x" * 3000, "aé " * 500, "    def f():\n        return 1\n", "\x00 \x7f", "é ́x", "{\r\n }\r", "a" + " " * 300 + "b"]


def test_alignment_of_whole_tables(spark, monkeypatch):
    """All of the table and odd texts, in several blocks, units forgotten meanwhile."""
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 200_000)
    monkeypatch.setattr(alignment, "KNOWN_UNITS", 3000)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()] + [(-i, t) for i, t in enumerate(ODD)] + [(None, "a lone row"), (3, "a lone row"), (3, "a lone row")]
    docs = spark.createDataFrame([(*r, "x", 1, b"") for r in rows], "doc_id long, text string, block string, pairs int, times binary").repartition(3)
    same(map(tuple, alignment.align_tokenizers(docs, A, B).collect()), aligned(rows))


def test_alignment_of_random_characters(spark):
    rng = random.Random(11)
    letters = "ab .,\n\t'’ é中  　▂0x1F<>{}\r"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(60)))) for i in range(400)]
    same(map(tuple, alignment.align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()), aligned(rows))


def test_alignment_of_whole_texts_where_pieces_span_spaces(monkeypatch):
    tok = alignment.Tokenizers(A, B)
    texts = ["one two  three", "x▁y z", "", "a b a b"]
    by_unit = alignment._digest(alignment.Known(tok), texts)
    tok.by_unit = False
    for x, y in zip(by_unit, alignment._digest(alignment.Known(tok), texts)):
        assert np.array_equal(x, y)


def test_alignment_of_long_texts_and_of_nothing(spark):
    assert alignment.align_tokenizers(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    rows = [(1, " ".join(f"w{i % 977}" for i in range(400_000))), (2, "é" * 100_000)]
    same(map(tuple, alignment.align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()), aligned(rows))


# near vectors


def linked(rows, cosine=0.93):
    """All pairs, in exact fractions' stead with each vector scaled to at most 1."""
    unit = []
    for _, e, label in rows:
        v = None
        if label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e):
            v = np.array(e, float) / np.max(np.abs(np.array(e, float)))
            v = v / np.linalg.norm(v)
        unit.append(v)
    near = [[j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= cosine] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, edge = {i}, [i]
        while edge:
            edge = [j for x in edge for j in near[x] if j not in seen and not seen.add(j)]
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), low, rows[i][0] == low))
    return out


def clustered(rng, n, d, labels):
    centres = rng.normal(size=(n // 8 + 1, d))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, d)) * 0.25
    return [(int(i), [float(v) for v in x[i]], int(rng.integers(0, labels))) for i in rng.permutation(n)]


@pytest.mark.parametrize("shard_rows", [8192, 40])
def test_near_vectors_against_all_pairs(spark, shard_rows):
    """Every link, in one shard a label and in many."""
    rows = clustered(np.random.default_rng(3), 600, 12, 2)
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard_rows=shard_rows).collect()
    want = linked(rows)
    assert sum(r[1] for r in want) > 1000
    same(map(tuple, got), want)


def test_near_vectors_of_odd_rows(spark):
    """Nulls, zeros, infinities, lengths, copies, repeated and null ids, extreme sizes, names that clash."""
    rng = np.random.default_rng(4)
    base = [float(v) for v in rng.normal(size=6)]
    rows = [(1, base, 1), (2, base, 1), (3, base, 2), (4, base, None), (5, None, 1), (6, [], 1), (7, [0.0] * 6, 1), (8, [*base[:5], None], 1), (9, [*base[:5], float("nan")], 1), (10, [*base[:5], float("inf")], 1)]
    rows += [(20 + i, [v * s for v in base], 1) for i, s in enumerate((1e20, 1e-25, 1e200, 1e-300, 3.0, -1.0))] + [(30, base[:5], 1), (31, base[:5], 1)]
    rows += [(40, [1.0] + [0.0] * 5, 3), (40, [0.0, 1.0] + [0.0] * 4, 3), (40, [1.0] + [0.0] * 5, 3), (None, base, 4), (None, base, 4), (None, [1.0, 2.0], 5), (50, base, 4)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<double>, label int, node int, key string, times int")
    same(map(tuple, near_vectors.near_vectors(df).collect()), linked(rows))
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_with_one_vector_in_half_of_all_rows(spark):
    rng = np.random.default_rng(6)
    hot = [float(v) for v in rng.normal(size=4)]
    rows = [(i, hot if i % 2 else [float(v) for v in rng.normal(size=4)], 0) for i in range(3000)]
    got = {r.vec_id: r for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.93).sum(1) - 1
    assert all(got[i].n_links == near[i] for i in range(3000))
    assert len({got[i].component_id for i in range(1, 3000, 2)}) == 1


@pytest.mark.parametrize("spread", [0.35, 2.0])
def test_graph_recall_and_widening(spread):
    """A graph that begins with a beam of one still finds what the audit asks for."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50, 16))[rng.integers(0, 50, 3000)] + rng.normal(size=(3000, 16)) * spread
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = near_vectors.Graph(x.astype(np.float32))
    assert len(graph.layers) > 1 and all((e < len(e)).all() for e in graph.layers)
    q, c = near_vectors.links(x, x, graph, 0.8)
    due = int((x @ x.T >= 0.8).sum())
    assert len(q) >= 0.999 * due and len(set(zip(q.tolist(), c.tolist()))) == len(q)


def test_graph_prunes_seldom_and_own_links_need_no_beam(monkeypatch):
    """A node's edges are chosen anew a few times, not with each edge back; a shard's own links are found from each node's own place."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 16))
    x[:600] = x[600:1200] + rng.normal(size=(600, 16)) * 0.2
    x /= np.linalg.norm(x, axis=1)[:, None]
    chosen, diverse = [], near_vectors.diverse
    monkeypatch.setattr(near_vectors, "diverse", lambda x, of, *rest: chosen.append(len(of)) or diverse(x, of, *rest))
    graph = near_vectors.Graph(x.astype(np.float32))
    assert sum(chosen) < 6 * len(x)
    monkeypatch.setattr(near_vectors, "beam", None)
    got = {(a, b) for q, c in near_vectors.found_links(x, x, graph, 0.93, own=True) for a, b in zip(q.tolist(), c.tolist())}
    assert got == set(zip(*(i.tolist() for i in np.nonzero(x @ x.T >= 0.93)))) and len(got) > 3600


def test_dense_shards_by_products(monkeypatch):
    """Where a query has many links, and where a shard has too many to hold, products tell the same counts."""
    x = np.random.default_rng(10).normal(size=(400, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    part = (np.arange(400), np.ones(400, np.int64), x)
    want = (x @ x.T >= 0.93).sum(1) - 1
    for name, value in (("MANY", near_vectors.MANY), ("MANY", 100), ("DENSE", 1)):
        monkeypatch.setattr(near_vectors, name, value)
        got = near_vectors._Shard([part], 0.93).own().to_pylist()
        assert {r["node"]: r["links"] for r in got if r["other"] is None} == dict(enumerate(want.tolist()))


def test_forest_keeps_components():
    rng = random.Random(2)
    for _ in range(50):
        n = rng.randrange(1, 40)
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(0, 40))]
        a, b = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        nodes, low = near_vectors.forest(a, b, n)
        label = list(range(n))
        for _ in range(n):
            for p, q in pairs:
                label[p] = label[q] = min(label[p], label[q])
        assert dict(zip(nodes.tolist(), low.tolist())) == {i: x for i, x in enumerate(label) if x != i}


# nearest neighbours of vectors of any size


@pytest.mark.parametrize("size", [1e20, 1e-25, 1e60, 1e-60, 1e150, 1e-150, None])
def test_neighbours_of_any_size(spark, size):
    """Every finite vector takes part, doubles as doubles; None: all these sizes together, and one vector beyond single precision."""
    rng = np.random.default_rng(12)
    sizes = [1.0, 1e20, 1e-25, 1e60, 1e-60] if size is None else [size]
    x = rng.normal(size=(60, 8)) * np.array([sizes[i % len(sizes)] for i in range(60)])[:, None]
    kind = "float" if size in (1e20, 1e-25) else "double"
    x = x.astype(np.float32).astype(float) if kind == "float" else x
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(60)], f"vec_id long, embedding array<{kind}>")
    got = neighbours.nearest_neighbours(df, df.filter("vec_id % 20 = 0")).collect()
    assert len(got) == 60
    hit = 0
    for q in (0, 20, 40):
        score = x @ x[q]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, 21))
        assert all(s == pytest.approx(score[v], rel=1e-13, abs=1e-13 * np.abs(x[v]) @ np.abs(x[q])) for _, v, s in own)
        due = sorted((i for i in range(60) if i != q), key=lambda i: (-score[i], i))[:20]
        hit += len(set(due) & {v for _, v, _ in own})
    assert hit >= 54


def test_neighbours_of_one_double_apart(spark):
    """Vectors that single precision can't tell apart are ranked by their doubles."""
    rows = [(i, [1.0 + i * 2.0**-40, 0.5]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest_neighbours(df, df.filter("vec_id = 0"), k=20).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(29, 9, -1))
    assert [r.score for r in got] == [1.0 + i * 2.0**-40 + 0.25 for i in range(29, 9, -1)]
