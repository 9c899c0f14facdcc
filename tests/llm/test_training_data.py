"""The training-data operators against brute force, and on nulls, empty tables, ties, repeats and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from wardline.llm import common, fingerprints, language, lm, mixing, neighbours, ngram_join, packing, pii, substrings, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENS = public_tokenizers.path("word_bpe_49k.json")
VOCABULARY = [f"w{i}" for i in range(40)]


def corpus(seed=1, n=60, extra=True):
    """Random texts with copies, near copies, shared passages, repeats, and odd rows."""
    rng = random.Random(seed)
    passage = [rng.choice(VOCABULARY) for _ in range(60)]
    texts = []
    for _ in range(n):
        words = [rng.choice(VOCABULARY) for _ in range(rng.randrange(1, 120))]
        kind = rng.random()
        if kind < 0.2 and texts:
            words = WORD.findall(rng.choice(texts))
        elif kind < 0.4 and texts:
            words = WORD.findall(rng.choice(texts))
            words[rng.randrange(len(words))] = "new"
        elif kind < 0.5:
            at = rng.randrange(len(words))
            words[at:at] = passage
        elif kind < 0.55:
            words = ["again"] * rng.randrange(30, 60) + words
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    if extra:
        texts += ["", None, " \t ", "one", "one two", "é ß 中", "one two"]
    return list(enumerate(texts))


def frame(spark, rows):
    """With columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, "s", 1, 2.0, "c") for i, t in rows], "doc_id long, text string, sig string, n int, taken double, component string")


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5), (2, 1, 2)])
def test_ngram_join(spark, monkeypatch, k, num, den):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 8)  # groups are tiled
    rows = corpus(2) + [(None, "one two three four")]
    sets = {i: {tuple(w)} if 0 < len(w) < k else set(zip(*[w[j:] for j in range(k)])) for i, t in rows for w in [WORD.findall((t or "").lower())]}
    ids = [i for i in sets if i is not None]
    links = {i: [j for j in ids if j != i and sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])] for i in ids}

    def least(i):
        seen, edge = {i}, [i]
        while edge:
            edge = [j for x in edge for j in links[x] if j not in seen and not seen.add(j)]
        return min(seen)

    got = ngram_join.ngram_join(frame(spark, rows), k, num, den).collect()
    want = [(i, len(sets[i]), least(i) if i is not None else None, len(links[i]) if i is not None else 0) for i, _ in rows]
    same([tuple(r) for r in got], want)


@pytest.mark.parametrize("hot", [1000, 3])
def test_components(spark, monkeypatch, hot):
    """Chains, stars, cycles, loops, repeats and nulls, with hubs dealt out and without."""
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rng = random.Random(37)
    edges = [(i, i + 1) for i in range(100, 130)] + [(500, i) for i in range(501, 560)] + [(900, 901), (901, 902), (902, 900), (7, 7), (None, 3), (3, None)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)]
    near = collections.defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for i in sorted(near):
        if i not in want:
            edge = [i]
            while edge:
                j = edge.pop()
                if want.setdefault(j, i) == i:
                    edge += [x for x in near[j] if x not in want]
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == want and len(got) == len(want)


def test_ngram_join_hot_blocks(spark, monkeypatch):
    """Blocks with more sets than are taken pair by pair, in several segments."""
    monkeypatch.setattr(ngram_join, "FEW", 2)
    monkeypatch.setattr(ngram_join, "SEGMENT", 4)
    base = [f"b{i}" for i in range(40)]
    rows = [(i, " ".join([*base[: i % 40], f"x{i}", *base[i % 40 + 1 :]])) for i in range(60)]
    got = ngram_join.ngram_join(frame(spark, rows), 1, 4, 5)
    assert {r.component_id for r in got.collect()} == {0}


def test_ngram_join_hot_blocks_link_over_segments(spark, monkeypatch):
    """Copies of one text, edited independently: each is linked with it and with no other copy."""
    monkeypatch.setattr(ngram_join, "SEGMENT", 500)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 2401):
        words = list(base)
        for j in rng.sample(range(300), 32):
            words[j] = f"x{i}_{j}"
        rows.append((i, " ".join(words)))
    got = ngram_join.ngram_join(frame(spark, rows), 1, 4, 5).collect()
    assert {(r.component_id, r.n_links) for r in got if r.doc_id} == {(0, 1)}
    assert [r.n_links for r in got if r.doc_id == 0] == [2400]


@pytest.mark.parametrize("window", [5, 35])
def test_substrings(spark, monkeypatch, window):
    rows = corpus(3)
    count = collections.Counter(tuple(w[i : i + window]) for _, t in rows for w in [WORD.findall(t or "")] for i in range(len(w) - window + 1))

    def want():
        for i, t in rows:
            w = WORD.findall(t or "")
            gone = {j for a in range(len(w) - window + 1) if count[tuple(w[a : a + window])] > 1 for j in range(a, a + window)}
            kept = " ".join(x for j, x in enumerate(w) if j not in gone)
            yield i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()

    for most, portion in ((30_000, 1000), (100, 1)):  # with large shards dealt out again, and copies in portions
        monkeypatch.setattr(substrings, "SHARD_WORDS", most)
        monkeypatch.setattr(substrings, "PORTION", portion)
        same([tuple(r) for r in substrings.dedup_substrings(frame(spark, rows), window, 3).collect()], list(want()))


def test_suffix_automaton():
    rng = random.Random(4)
    for _ in range(100):
        runs = [np.array([rng.randrange(3) for _ in range(rng.randrange(5, 25))], np.uint32) for _ in range(rng.randrange(1, 5))]
        times = [rng.choice([1, 1, 2]) for _ in runs]
        count = collections.Counter()
        for r, t in zip(runs, times):
            for i in range(len(r) - 4):
                count[tuple(r[i : i + 5])] += t
        assert [x.tolist() for x in substrings.repeated(runs, times, 5)] == [[count[tuple(r[i : i + 5])] > 1 for i in range(len(r) - 4)] for r in runs]


@pytest.mark.parametrize("blocks", [3000, 3])
def test_lm_scores(spark, monkeypatch, blocks):
    monkeypatch.setattr(lm, "PART_BLOCKS", blocks)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(lm, "BUCKET_GRAMS", 500)
    rows = corpus(5)
    words = {i: WORD.findall(t or "") for i, t in rows}
    grams = {n: {i: collections.Counter(zip(*[w[j:] for j in range(n)])) for i, w in words.items()} for n in (1, 2, 3)}
    total = {n: sum(grams[n].values(), collections.Counter()) for n in grams}
    n_words = sum(map(len, words.values()))

    def score(i):
        c = lambda g: total[len(g)][g] - grams[len(g)][i][g]
        w, out = words[i], []
        for j in range(len(w)):
            for n in (3, 2):
                g = tuple(w[j - n + 1 : j + 1])
                if j >= n - 1 and c(g) > 0:
                    out.append(0.4 ** (3 - n) * c(g) / c(g[:-1]))
                    break
            else:
                out.append(0.16 * (c((w[j],)) + 1) / (n_words - len(w) + 1))
        return sum(map(math.log, out)) / len(out) if out else None

    for r in lm.score_texts(frame(spark, rows)).collect():
        want = score(r.doc_id)
        assert r.n_words == len(words[r.doc_id]) and (r.lm_score is None if want is None else abs(r.lm_score - want) < 1e-9)


def test_blocks_hold_the_same_rows_in_whatever_order_they_came(spark):
    rows = [(i % 7 if i % 5 else None, f"text {i % 3}" if i % 11 else None) for i in range(400)]

    def dealt(rows):
        docs = spark.sparkContext.parallelize(rows, 1).toDF("doc_id long, text string")
        return collections.Counter(map(tuple, lm._dealt(docs, 13).collect()))

    there, back = dealt(rows), dealt(rows[::-1])
    assert there == back and len({b for _, b, _ in there}) == 13


def test_pii_base_spans():
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    valid = {"email": lambda v, d: True, "ip": lambda v, d: all(int(x) <= 255 for x in v.split(".")), "card": lambda v, d: 12 <= len(d) <= 19 and pii.luhn(d), "phone": lambda v, d: 9 <= len(d) <= 15}
    rng = random.Random(6)
    for n in range(20000):
        text = "".join(rng.choice("a@@..-_1 +5(0é25\n" if n % 2 else "4111 1-.+()2") for _ in range(rng.randrange(60)))
        want = [(m.start(), m.end(), k) for k, p in patterns.items() for m in re.finditer(p, text) if valid[k](m.group(), re.sub("[^0-9]", "", m.group()))]
        want.sort(key=lambda s: (s[0], pii.KINDS.index(s[2])))
        assert pii.base_spans(text) == want, text


def pii_rows():
    """Texts of which some give an entity away by a term, among many that don't."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice(["the", "on", "er", "ing", "re", "at", "id", "or"]) for _ in range(2))
    rows = [(100 + i, " ".join(word() for _ in range(30))) for i in range(300)]
    rows += [(i, f"x{chr(98 + i) * 4} we met zanzibrook friend at ann@x.org number{i} w{chr(97 + i) * 3} today") for i in range(6)]
    rows += [(10, "nothing but Zanzibrook here"), (11, None), (12, ""), (13, "we met a friend today"), (14, "we met today with a friend who met"), (15, "met him")]
    # no value twice, but the word before them tells the kind
    rows += [(20 + i, f"{word()} {word()} ringvox +1 (55{i}) 555-010{i} {word()} {word()} {'y' * 3000 if i == 3 else ''} {word()}") for i in range(8)]
    return rows


def test_pii_terms(spark):
    rows = pii_rows()
    got = {r.doc_id: r for r in pii.find_pii(frame(spark, rows)).collect()}
    assert got[10].spans == "term:12:22" and got[0].n_email == 1 and got[11].spans == "" and got[12].n_term == 0
    assert all("remove:" in got[20 + i].spans and got[20 + i].n_phone == 1 for i in range(8))
    assert sum(got[100 + i].n_term for i in range(300)) == 0
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert clean[10] == "nothing but [TERM] here" and "[EMAIL]" in clean[0] and clean[11] is None and clean[12] == ""
    assert not any("ringvox" in (t or "") or pii.base_spans(t) for t in clean.values())
    assert pii.sanitise(frame(spark, rows)).columns == frame(spark, rows).columns


def test_pii_terms_by_counting(spark):
    """The share of information that each term reveals, counted anew over all texts in plain Python."""
    rows = [*pii_rows(), (50, "copy of ringvox +1 (550) 555-0100 zanzibrook"), (51, "copy of ringvox +1 (550) 555-0100 zanzibrook")]
    terms = lambda t: re.findall(r"[^\W\d_]{3,}", t.lower())
    held, contexts, entities, texts = collections.defaultdict(set), collections.defaultdict(set), collections.defaultdict(set), {t for _, t in rows}
    for t in texts:
        for s, e, kind in pii.base_spans(t):
            near = [w for part in (t[:s].split()[-8:], t[e:].split()[:8]) for x in part for w in terms(x)]
            for name in (kind, (kind, t[s:e] if kind == "email" else re.sub("[^0-9]", "", t[s:e]))):
                entities[name] |= {tuple(near)} if near else set()
                for w in near:
                    held[name, w].add(tuple(near))
                    contexts[w].add(tuple(near))
    with_term = collections.Counter(w for t in texts if t for w in set(terms(t)))
    want = {}
    for (name, w), c in held.items():
        n, base = max(with_term[w], len(contexts[w])), math.log(len(entities[name]) / len(texts))
        share = 1 - math.log(len(c) / n) / base
        if len(c) >= 3 and share >= 0.9:
            want[w] = max(want.get(w, 0), share)
    docs = frame(spark, rows).select("doc_id", "text").withColumn("key", F.xxhash64("text"))
    found = docs.select("doc_id", "text", "key").mapInArrow(pii._detect, "doc_id long, key long, " + ", ".join(f"n_{k} long" for k in pii.KINDS) + ", base_sha256 string, base string, near array<" + pii._NEAR + ">")
    got = {r.term: r.share for r in pii.disclosures(found, docs).collect()}
    assert {"ringvox", "zanzibrook"} <= set(want) and got == pytest.approx(want)


def test_pii_finds_planted_terms_among_documents(spark):
    """Terms planted in the corpus of the test tables, in distinct contexts of a few values, and nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = random.Random(5)
    some = lambda: " ".join("".join(rng.choice("aeiourstln") for _ in range(6)) for _ in range(4))
    planted = [(10**6 + i, f"{some()} oldgrove lodge 4539 1488 0343 6467 {some()}") for i in range(5)] + [(10**6 + 9, f"she lives near Oldgrove now {some()}")]
    got = pii.find_pii(docs.unionByName(spark.createDataFrame(planted, docs.schema)))
    hit = {r.doc_id: r.spans for r in got.filter("n_term > 0").collect()}
    assert hit[10**6 + 9] == "term:15:23" and all("card:" in hit[10**6 + i] for i in range(5)) and min(hit) >= 10**6


def test_pii_goes_whatever_the_id(spark):
    """Rows with a null or repeated id, copies or not, lose their base spans and terms as others do."""
    rows = [r for r in pii_rows() if r[0] not in range(10, 30)]
    odd = [(None, "write to bob@x.org or zanzibrook"), (None, "zanzibrook at 10.0.0.1"), (7, "bob@x.org said it"), (7, "it was said by 10.0.0.1 zanzibrook"), (7, "bob@x.org said it"), (0, "only here"), (None, "plain"), (7, None), (None, None)]
    mark = "[TERM]"
    want = [(None, f"write to [EMAIL] or {mark}"), (None, f"{mark} at [IP]"), (7, "[EMAIL] said it"), (7, f"it was said by [IP] {mark}"), (7, "[EMAIL] said it"), (0, "only here"), (None, "plain"), (7, None), (None, None)]
    got = [(r.doc_id, r.text) for r in pii.sanitise(frame(spark, rows + odd)).collect()]
    assert not [t for _, t in got if t and ("@" in t or "zanzibrook" in t or "10.0.0.1" in t or pii.base_spans(t))]
    same([x for x in got if (x[0] is None or x[0] < 100) and not (x[1] or "").startswith("x")], want)
    terms = [(r.doc_id, r.n_term, r.spans) for r in pii.find_pii(frame(spark, rows + odd)).collect() if r.doc_id == 7]
    same(terms, [(7, 0, "email:0:9"), (7, 0, "email:0:9"), (7, 0, ""), (7, 1, "ip:15:23,term:24:34")])


def test_sanitise_text_leaves_no_base_span():
    assert pii.sanitise_text("at 10.0abc.0.1 now", "remove:7:10") == "at [IP] now"
    rng = random.Random(32)
    for _ in range(3000):
        text = "".join(rng.choice("a@.-1 +5(0b") for _ in range(rng.randrange(40)))
        spans = sorted([*pii.base_spans(text), *((m.start(), m.end(), "remove") for m in re.finditer("b+", text))])
        assert not pii.base_spans(pii.sanitise_text(text, pii.join_spans(spans)))


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "a", "a", "a", "b", "c", None]), " ".join(["w"] * rng.randrange(30))) for i in range(400)] + [(None, "z", None), (401, "z", ""), (5, "a", "w w"), (5, "a", "w w")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("whole", F.lit(1))
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    names = ["a", "b", "c", "z", None]
    weight = dict(zip(names, [1, 2, 3, 1, 2]))
    left, share = set(names), {}
    while True:  # shares above their limit stop there, the rest is shared anew
        rest = sum(size.values()) - sum(share.values())
        over = [s for s in left if rest * weight[s] / sum(weight[x] for x in left) > 3 * size[s]]
        if not over:
            break
        share |= {s: 3 * size[s] for s in over}
        left -= set(over)
    share |= {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
    for s in names:
        assert abs(target[s] - share[s]) < 1e-6 and abs(taken[s] - target[s]) <= 0.5
    assert sorted(map(repr, mixing.mix_sources(df.repartition(7)).collect())) == sorted(map(repr, got))


def test_fingerprints(spark):
    rows = corpus(8, 40)
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(frame(spark, rows), 64).collect()}
    bag = lambda t: collections.Counter(WORD.findall(t))
    alike = lambda a, b: sum((bag(a) & bag(b)).values()) / sum((bag(a) | bag(b)).values()) if bag(a) | bag(b) else 1.0
    errors, seen = [], {}
    for i, (k, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint
        errors += [r.near_edited - alike(t, edited), r.near_next - alike(t, after)]
    assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < 0.3


@pytest.mark.parametrize("copies", [1, 30])
def test_neighbours(spark, copies):
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(300 // copies * 2, 16)), copies, 0).astype(np.float32)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] * 16), (None, [1.0] * 16), (9005, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit("x"))
    got = collections.defaultdict(list)
    for r in neighbours.nearest_neighbours(df, df.filter("vec_id % 20 = 0"), k=10, shard_bytes=3000).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = 0
    wide = x.astype(np.float64)
    for i in range(0, len(x), 20):
        s = (wide * wide[i]).sum(1)
        order = [j for j in np.lexsort((np.arange(len(x)), -s)) if j != i][:10]
        assert len(got[i]) == 10 and all(abs(s[j] - v) < 1e-9 for j, v in got[i])
        hit += len({j for j, _ in got[i]} & set(order))
    assert hit / (10 * len(range(0, len(x), 20))) >= 0.9


def test_mixing_by_groups_of_ranges(spark, monkeypatch):
    """Prefix sums over ranges in groups are those over all ranges at once."""
    rows = spark.range(5000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'hot' ELSE string(id % 7) END AS source", "repeat('word ', cast(1 + id % 9 AS int)) AS text")
    monkeypatch.setattr(mixing, "RANGE_ROWS", 5)
    out = []
    for ranges in (10**9, 7):
        monkeypatch.setattr(mixing, "GROUP_RANGES", ranges)
        out.append(sorted(map(tuple, mixing.mix_sources(rows).collect())))
    assert out[0] == out[1]


def test_cuts_are_the_cheapest():
    rng = random.Random(10)
    for _ in range(200):
        limit, n = rng.choice([8, 12, 16]), rng.randrange(1, 60)
        places = sorted({n, *(p for p in range(1, n) if rng.random() < 0.6 or p % limit == 0)})
        costs = [rng.choice([0, 4, 64]) for _ in places]
        pad = lambda k: 0 if k & (k - 1) == 0 else limit - k
        best = {0: 0.0}
        for p, c in zip(places, costs):
            best[p] = min(f + pad(p - q) + c + packing.WINDOW_COST for q, f in best.items() if p - q <= limit)
        got = packing.cuts(places, costs, limit, n)
        assert sum(pad(b - a) + costs[places.index(b)] + packing.WINDOW_COST for a, b in zip([0, *got], got)) == pytest.approx(best[n])


def test_packing(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "BUFFER", 3000)
    tok = Tokenizer.from_file(TOKENS)
    rows = corpus(11, 80) + [(90, "Straße it's 'S <|endoftext|> naïve!! 12.5 ²½"), (91, "x" * 5000), (92, "a. " * 4000)]
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    got = packing.pack(frame(spark, rows).repartition(2), TOKENS, with_ids=True).collect()
    at, sequences = collections.Counter(), collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == at[r.doc_id] and r.ids == piece.tolist() and r.ids_crc32 == zlib.crc32(piece.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        at[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert at == {i: len(v) for i, v in ids.items()}
    padding = 0
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end and length > 0
            end += length
        assert end <= 2048
        padding += 0 if end & (end - 1) == 0 else 2048 - end
    assert padding < 0.02 * sum(map(len, ids.values()))


def test_toxicity(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["the", "on", "er", "ing", "re", "at", "id", "or", "st", "lo"]) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(300):
        text, bad = " ".join(word() for _ in range(30)), i % 4 == 0
        rows.append((i, text + (" idiot loser" * 2 if bad else "")))
        labels.append((i, int(bad)))
    rows += [(900, "the on 1d10t er l0$er at"), (901, "on i d i o t at l o s e r"), (902, "the iiiidiot looooser"), (903, "on at the er ing"), (904, None), (905, "")]
    docs = frame(spark, rows)
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(got[i] >= 0.7 for i in (900, 901, 902)) and all(got[i] < 0.3 for i in (903, 904, 905))
    assert all((got[i] >= 0.7) == bool(y) for i, y in labels)
    none = toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert max(r.toxicity for r in toxicity.score_toxicity(docs, none).collect()) < 0.7


def test_decoder():
    model = np.log(np.full((28, 28, 28), 1 / 28))
    for word in ("idiot", "loser"):
        codes = [0, 0, *(ord(c) - 96 for c in word), 0]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            model[a, b, c] = -0.1
    d = toxicity.Decoder(model)
    assert [d.restore(x) for x in ("1d10t", "!d!0t,", "l0$er", "looooser", "i.d.i.o.t", "hello", "12345", "and&&&")] == ["idiot", "idiot", "loser", "loser", "idiot", "hello", "12345", "and"]
    assert toxicity.spaced_words("a i d i o t b".split(), d)


def test_decoder_takes_any_length(monkeypatch):
    model = np.log(np.full((28, 28, 28), 1 / 28))
    for word in ("idiot", "loser", "the", "on"):
        codes = [0, 0, *(ord(c) - 96 for c in word), 0, 0]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            model[a, b, c] = -0.1
    for c in range(28):
        model[1:, 0, c] = model[0, 0, c]
    d = toxicity.Decoder(model)
    assert d.restore("l" + "o" * 60 + "ser") == "loser" and d.restore("1d" + "i" * 5000 + "0t") == "idiot"
    assert d.restore("i.d.i." + "o." * 40 + "t") == "idiot"
    tokens = ["".join(random.Random(n).choice("idolser17") for _ in range(n)) + "a1" for n in range(50, 400, 50)]
    stepwise = [(d.restore(t), d.best(t, spaced=True)) for t in tokens]
    monkeypatch.setattr(toxicity, "SETTLE", 10**9)
    assert stepwise == [(d.restore(t), d.best(t, spaced=True)) for t in tokens]
    monkeypatch.undo()
    for n in range(8, 60):  # a word over any place of a long run of letters
        words = ["the", "on"] * n + ["idiot"] + ["on", "the"] * 12
        assert toxicity.spaced_words(list("".join(words)), d) == words


def test_language(spark):
    rng = random.Random(13)
    syllables = {"en": ["the", "ing", "wh", "er"], "fr": ["é", "que", "eau", "oi"], "de": ["ü", "sch", "ung", "ß"]}
    text = lambda k, n: " ".join("".join(rng.choices(syllables[k], k=2)) for _ in range(n))
    rows = [(i, text(k, rng.randrange(5, 80)), k) for i in range(240) for k in [rng.choice(list(syllables))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.fit_language(docs.filter("doc_id < 160"))
    held = docs.filter("doc_id >= 160").unionByName(spark.createDataFrame([(900, None, None), (901, "", None), (902, "12 34!", None)], docs.schema))
    got = {r.doc_id: r for r in language.identify_language(held, net).collect()}
    assert sum(got[i].lang_pred == k for i, _, k in rows[160:]) >= 0.95 * 80
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and all(0 <= r.score <= 1 for r in got.values())
    assert language.fit_language(docs.filter("false")) is None
    assert {r.lang_pred for r in language.identify_language(docs, None).collect()} == {"und"}


def test_gradients():
    """Backpropagation through time against finite differences."""
    rng = np.random.default_rng(14)
    k, codes = language.UNITS, rng.integers(0, 256, (6, 3))
    x, u = rng.normal(size=(256, 3 * k)) * 0.3, rng.normal(size=(k, 3 * k)) * 0.3
    weight = rng.normal(size=(6, 3, k))
    loss = lambda x, u: sum((h * w).sum() for h, w in zip(language._steps(x, u, codes, np.zeros((3, k))), weight))
    kept = []
    list(language._steps(x, u, codes, np.zeros((3, k)), kept))
    gx, gu = language._gradient(x.shape, u, kept, list(weight))
    inside = (np.arange(6)[:, None] >= np.array([0, 2, 4])[None, :]).astype(float)  # as the backward states of short windows
    masked = lambda x, u: sum((h * w).sum() for h, w in zip(language._steps(x, u, codes, np.zeros((3, k)), inside=inside), weight))
    kept = []
    list(language._steps(x, u, codes, np.zeros((3, k)), kept, inside))
    mx, mu = language._gradient(x.shape, u, kept, list(weight), inside)
    for at in [(codes[5, 2], 3), (codes[0, 0], 1), (codes[2, 1], 9)]:
        a, b = x.copy(), x.copy()
        a[at] += 1e-5
        b[at] -= 1e-5
        assert abs((masked(a, u) - masked(b, u)) / 2e-5 - mx[at]) < 1e-3 * max(1, abs(mx[at]))
    a, b = u.copy(), u.copy()
    a[1, 2] += 1e-5
    b[1, 2] -= 1e-5
    assert abs((masked(x, a) - masked(x, b)) / 2e-5 - mu[1, 2]) < 1e-3 * max(1, abs(mu[1, 2]))
    for m, g in ((x, gx), (u, gu)):
        for _ in range(10):
            at = (codes[0, 0], rng.integers(3 * k)) if m is x else (rng.integers(k), rng.integers(3 * k))
            a, b = m.copy(), m.copy()
            a[at] += 1e-5
            b[at] -= 1e-5
            slope = (loss(a, u) - loss(b, u) if m is x else loss(x, a) - loss(x, b)) / 2e-5
            assert abs(slope - g[at]) < 1e-3 * max(1, abs(slope))


def test_decoder_against_every_path():
    """The decoded word is the best of all paths through the lattice."""
    rng = np.random.default_rng(33)
    model = np.log(rng.dirichlet(np.full(28, 0.3), (28, 28)))
    d = toxicity.Decoder(model)
    for _ in range(300):
        chars = "".join(rng.choice(list("ab10$!é"), rng.integers(1, 7)))
        for spaced in (False, True):
            best = (-math.inf, "")
            for path in itertools.product(*d.slots(chars, spaced)):
                said, score, a, b = "".join(p for p, _ in path), sum(w for _, w in path), 0, 0
                for ch in [*said, " "]:
                    c = d._number(ch)
                    score += model[a, b, c]
                    a, b = b, c
                best = max(best, (score, said))
            assert best[1] == d.best(chars, spaced) or math.isclose(best[0], _said(d, chars, spaced, d.best(chars, spaced), model))


def _said(d, chars, spaced, word, model):
    """The best score of a path that says ``word``."""
    out = -math.inf
    for path in itertools.product(*d.slots(chars, spaced)):
        if "".join(p for p, _ in path) == word:
            score, a, b = sum(w for _, w in path), 0, 0
            for ch in [*word, " "]:
                c = d._number(ch)
                score += model[a, b, c]
                a, b = b, c
            out = max(out, score)
    return out


def test_toxicity_evidence_by_counting(spark):
    """Features' counts, and the logistic model's inputs, counted anew in plain Python."""
    rng = random.Random(34)
    rows = [(i, " ".join(rng.choice(["the", "idiot", "loser", "on", "1d10t", "at", "ring", "soft"]) for _ in range(rng.randrange(1, 8)))) for i in range(200)]
    labels = {i: int("idiot" in t or "1d10t" in t) for i, t in rows}
    docs = frame(spark, rows)
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    d, sample = toxicity.Decoder(model.characters), {(t, labels[i]) for i, t in rows}
    count = collections.defaultdict(lambda: [0, 0])
    for t, y in sample:
        for f in {f for w in t.split() for f in toxicity.features(d.restore(w))}:
            count[f][1 - y] += 1
    want = {f: (t, c) for f, (t, c) in count.items() if t >= 3 and t / (t + c + 3) >= 0.2}
    assert model.evidence == want and "=idiot" in want
    x, y = [], []
    for t, toxic in sample:
        found = []
        for w in {d.restore(w) for w in t.split()}:
            p = max((want[f][0] - toxic) / (sum(want[f]) + 2) for f in [*toxicity.features(w), None] if f in want) if any(f in want for f in toxicity.features(w)) else 0
            found += [p] if p > 0 else []
        x.append(toxicity.describe(found, len(t.split())))
        y.append(toxic)
    assert model.weights == pytest.approx(toxicity._logistic(np.array(x), np.array(y)), abs=1e-4)


def test_language_letters():
    assert not any(map(language.has_letter, (None, "", "½ ² Ⅷ", "12 34!", "_ ٣"))) and all(map(language.has_letter, ("1a", "½é", "中", "Ⅷ ж")))


def test_language_windows_by_hand(spark):
    """Pooling over windows and padding, against the plain recurrence of each window byte by byte."""
    rng, k, c = np.random.default_rng(35), language.UNITS, 3
    net = language.Network(["a", "b", "c"], *([rng.normal(size=s).astype(np.float32) * 0.5 for _ in range(2)] for s in ((256, 3 * k), (k, 3 * k), (k, c))), rng.normal(size=c).astype(np.float32))
    sig = lambda v: 1 / (1 + np.exp(-v))

    def states(x, u, codes):
        h, out = np.zeros(k), []
        for code in codes:
            a, m = x[code], h @ u
            z, r = sig(a[:k] + m[:k]), sig(a[k : 2 * k] + m[k : 2 * k])
            h = z * h + (1 - z) * np.tanh(a[2 * k :] + r * m[2 * k :])
            out.append(h)
        return out

    def pooled(text):
        b, total = text.encode(), np.zeros(c)
        for at in range(0, len(b), language.WINDOW):
            codes = [x + 32 if 65 <= x <= 90 else x for x in b[at : at + language.WINDOW]]
            for f, g in zip(states(net.x[0], net.u[0], codes), states(net.x[1], net.u[1], codes[::-1])[::-1]):
                e = np.exp(f @ net.v[0] + g @ net.v[1] + net.b)
                total += e / e.sum()
        return total / len(b)

    rows = [(i, "".join(random.Random(i).choice("abcDEF é") for _ in range(n)) + "x") for i, n in enumerate([1, 5, 127, 126, 300, 700])]
    for r in language.identify_language(frame(spark, rows), net).collect():
        p = pooled(rows[r.doc_id][1])
        assert abs(r.score - p.max()) < 1e-4 and r.lang_pred == net.languages[p.argmax()]


def test_language_whole_texts_are_windowed():
    """Windows for training come from all places of a text, not from its beginning alone."""
    text = "".join(chr(97 + i // 1000) for i in range(26_000))
    got = next(language._cut([pa.RecordBatch.from_arrays([pa.array([text]), pa.array(["x"])], ["text", "lang"])]))
    assert {chr(w[30]) for w in got.column(1).to_pylist()} == set("abcdefghijklmnopqrstuvwxyz") and got.num_rows == 407


def test_language_trains_on_all_windows(monkeypatch):
    """There are steps enough for every window to be among those of a step, however many there are."""
    monkeypatch.setattr(language, "BATCH", 8)
    rng = np.random.default_rng(1)
    windows = rng.integers(97, 123, (900, 4), dtype=np.uint8)
    seen = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and at.ndim == 1 and at.dtype.kind == "i" and len(at) < 900:
                seen.extend(at.tolist())
            return super().__getitem__(at)

    monkeypatch.setattr(language, "_FOLD", language._FOLD.view(Watched))
    language.train(windows, np.full(900, 4), np.array([0] * 700 + [1] * 200), ["a", "b"], rounds=3)
    assert set(seen) == set(range(900))


def test_sampler_in_plain_python(spark):
    """Fingerprints of weighted terms against the sampler written out in Python."""
    rng = random.Random(36)
    bags = [{rng.randrange(-(2**62), 2**62): rng.randrange(1, 9) for _ in range(rng.randrange(1, 12))} for _ in range(20)]
    df = spark.createDataFrame([(i, t, w) for i, bag in enumerate(bags) for t, w in bag.items()], "i long, term long, w long")
    got = {r.i: r.f for r in fingerprints.fingerprint_terms(df, ["i"], {"f": "w"}, 8).collect()}
    signed = lambda v: v - (v >> 63 << 64)
    first = lambda v, seed: xxhash.xxh64(struct.pack("<q", v), seed).intdigest()
    half = lambda h, high: ((h >> 33 if high else h & 0x7FFFFFFF) + 0.5) / 2**31
    for i, bag in enumerate(bags):
        out = ""
        for k in range(8):
            lows = []
            for x, w in bag.items():
                h = [xxhash.xxh64(struct.pack("<i", 3 * k + j), first(x, 42)).intdigest() for j in range(3)]
                r, log_c = -math.log(half(h[0], True) * half(h[0], False)), math.log(-math.log(half(h[1], True) * half(h[1], False)))
                b = half(h[2], True)
                t = math.floor(math.log(w) / r + b)
                name = first(t + k, first(x, 42)) & 0xFFFF
                lows.append((log_c - r * (t - b) - r, name))
            out += f"{min(lows)[1]:04x}"
        assert got[i] == out
    assert signed(2**63) == -(2**63)


def test_mixing_ranges_are_even_whatever_the_quality(spark):
    """A source of texts without Latin letters, whose keys are large, fills no range beyond its bound."""
    n = 60_000
    df = spark.range(n).selectExpr("id AS doc_id", "'s' AS source", "CASE WHEN id % 3 = 0 THEN 'слово дня' ELSE 'a word' END AS text")
    key = -F.ln(mixing.uniform(F.col("doc_id").cast("string"), F.lit("2"), seed=1)) / mixing.text_quality(F.col("text"))
    per = df.groupBy(F.floor(F.ln(key) * (n / (math.e * 1000)))).count().agg(F.max("count")).first()[0]
    assert per < 1200


def test_op6_many_rows_of_one_id(spark):
    """Rows of one id and of none are dealt to several buckets, in order of the text's hash."""
    rows = [(5, f"text {i} of five") for i in range(400)] + [(None, f"text {i} of none") for i in range(400)] + [(i, f"own {i}") for i in range(6, 200)]
    df = frame(spark, rows).repartition(3)
    spread = fingerprints._in_order(df.select("doc_id", "text")).filter("ghost = 0 and (doc_id = 5 or doc_id is null)").groupBy("doc_id").agg(F.countDistinct("bucket").alias("n")).collect()
    assert all(r.n >= 3 for r in spread)
    order = [r.text for r in frame(spark, rows).select("doc_id", "text").orderBy(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text")).collect()]
    want = collections.Counter()
    for t, after in zip(order, [*order[1:], order[0]]):
        want[hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()] += 1
    assert collections.Counter(r.edited_sha256 for r in fingerprints.fingerprint_documents(df, 4).collect()) == want


def test_op6_many_rows_of_one_id_and_text(spark):
    """Rows that agree in id and text fill no bucket, and each has its result: all but the last are followed by their like."""
    many = [(None, "404 not found on this server")] * 12_000 + [(7, "moved for good to a new place")] * 900 + [(7, None)] * 700
    rows = many + [(7, f"text {i} of seven") for i in range(30)] + [(None, f"text {i} of none") for i in range(30)] + [(i, f"own {i}") for i in range(8, 200)]
    df = frame(spark, rows).repartition(3)
    base = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    assert fingerprints._in_order(base).groupBy("bucket").count().agg(F.max("count")).first()[0] < 900
    order = base.orderBy(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text")).collect()
    want, alike = collections.Counter(), 0
    for r, after in zip(order, [*order[1:], order[0]]):
        t, n = r.text, len(r.text) // 2
        want[r.doc_id, len(t), hashlib.sha256((t[: len(t) - n] + after.text[:n]).encode()).hexdigest()] += 1
        alike += t == after.text
    got = fingerprints.fingerprint_documents(df, 4).collect()
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert sum(r.near_next == 1.0 for r in got) >= alike > 13_000


def test_shared_folder_must_be_told_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_clashing_columns(spark):
    """Columns named as those that operators make change nothing."""
    rows = [(i, f"the on er {i} idiot" if i % 4 == 0 else f"on at the {i}") for i in range(40)]
    extra = {c: F.lit(1) for c in ("__id", "__h", "__n", "__copies", "__each", "toxicity", "score", "key", "near", "portion", "nth", "k", "dim", "block", "rep")}
    plain, clash = frame(spark, rows), frame(spark, rows).withColumns(extra)
    lang = lambda d: d.withColumn("lang", F.lit("en"))
    for run in (pii.find_pii, mixing.mix_sources, ngram_join.ngram_join, lambda d: language.identify_language(d, None), lambda d: packing.pack(d, TOKENS), lambda d: substrings.dedup_substrings(d, 3, 2), lm.score_texts):
        if run is mixing.mix_sources:
            plain, clash = plain.withColumn("source", F.lit("s")), clash.withColumn("source", F.lit("s"))
        same(run(clash.coalesce(1)).collect(), run(plain.coalesce(1)).collect())
    assert language.fit_language(lang(clash).limit(0)) is None
    cleaned = pii.sanitise(clash)
    assert cleaned.columns == clash.columns and cleaned.count() == 40
    model = toxicity.fit_toxicity(clash, clash.selectExpr("doc_id", "CAST(doc_id % 4 = 0 AS int) AS toxic"))
    assert toxicity.score_toxicity(clash, model, score_col="s2").columns == [*clash.columns, "s2"]


def test_very_long_text(spark):
    """A text of two million words beside short ones."""
    rows = [(1, "again and again " * 660_000 + "Ann at ann@x.org"), (2, "short"), (3, None)]
    df = frame(spark, rows)
    assert {r.doc_id: (r.n_email, r.spans[:6]) for r in pii.find_pii(df).collect()}[1] == (1, "email:")
    assert {r.doc_id: r.n_shingles for r in ngram_join.ngram_join(df, 3, 9, 10).collect()} == {1: 6, 2: 1, 3: 0}
    assert {r.doc_id: r.n_words for r in substrings.dedup_substrings(df).collect()} == {1: 1_980_003, 2: 1, 3: 0}
    assert {r.doc_id: r.size for r in mixing.mix_sources(df.withColumn("source", F.lit("s"))).collect()} == {1: 1_980_003, 2: 1, 3: 0}


EMPTY = "doc_id long, text string, source string, lang string"


@pytest.mark.parametrize(
    "run",
    [
        ngram_join.ngram_join,
        substrings.dedup_substrings,
        lm.score_texts,
        pii.find_pii,
        pii.sanitise,
        mixing.mix_sources,
        fingerprints.fingerprint_documents,
        lambda d: packing.pack(d, TOKENS),
        lambda d: language.identify_language(d, None),
        lambda d: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, d.selectExpr("doc_id", "1 AS toxic"))),
        lambda d: neighbours.nearest_neighbours(*[d.selectExpr("doc_id AS vec_id", "CAST(NULL AS array<float>) AS embedding")] * 2),
    ],
)
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], EMPTY)).count() == 0


def test_null_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None), (None, None, None, None), (1, None, None, None)], EMPTY)
    for run in (ngram_join.ngram_join, substrings.dedup_substrings, lm.score_texts, pii.find_pii, mixing.mix_sources, fingerprints.fingerprint_documents, lambda d: packing.pack(d, TOKENS)):
        assert run(docs).count() == 3
