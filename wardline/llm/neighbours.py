"""Approximate nearest neighbours by inner product over robust-pruned directed graphs, one for each shard.

Vectors are dealt to shards by a hash of their id.  A shard's graph grows in batches: greedy searches propose
neighbours, relaxed distance pruning keeps diverse edges, reverse edges are pruned likewise.  Queries travel
in blocks to every shard, where a beam search finds each query's best, scored again in double precision;
blocks of results merge by query.  A shard's graph goes once to each task that searches it, ahead of a portion
of the blocks, which stream past it.  Work grows with queries times shards, so shards are as large as memory allows.  Largest inner product becomes least distance by one more coordinate,
sqrt(m^2 - |x|^2) with m the shard's greatest norm.  Equal vectors of a shard are one node.

Graphs are searched in single precision, so a shard holds vectors of like length, within a factor of 256, and it
and each query are scaled by powers of two; scores are of the original doubles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions_for, small_batches

#: Bytes of a shard's vectors, about; edges of a node; width of searches when building and when asking; relaxation.
SHARD_BYTES, DEGREE, BUILD_WIDTH, WIDTH, ALPHA = 4_000_000, 32, 64, 128, 1.2
#: Blocks of queries that stream past one copy of a graph, about.
PORTION = 64
#: A shard's vectors have lengths within a factor of 2 to this.
BAND_BITS = 8
#: Nodes added at a time; queries of a block; nodes that a search step expands; entry points besides the centre.
BATCH, BLOCK, BEAM, ENTRIES = 256, 512, 4, 7


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of each row's vector a (q, d) to b (q, m, d)."""
    diff = b - a[:, None, :]
    return np.einsum("qmd,qmd->qm", diff, diff)


def greedy(x: np.ndarray, edges: np.ndarray, entries: np.ndarray, asked: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all rows of ``asked``: (nodes, squared distances), nearest first, -1 and inf where there are fewer."""
    q, n = len(asked), len(x)
    rows = np.arange(q)[:, None]
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # the missing edge
    node = np.full((q, width), n)
    far = np.full((q, width), np.inf, np.float32)
    start = entries[:width]
    node[:, : len(start)] = start
    far[:, : len(start)] = _distance(asked, np.broadcast_to(x[start], (q, len(start), x.shape[1])))
    seen[:, start] = True
    done = node == n
    while True:
        open_far = np.where(done, np.inf, far)
        best = np.argpartition(open_far, min(BEAM, width - 1), 1)[:, :BEAM] if width > BEAM else np.argsort(open_far, 1)
        usable = np.isfinite(np.take_along_axis(open_far, best, 1))
        if not usable.any():
            break
        np.put_along_axis(done, best, True, 1)
        grown = np.where(usable, np.take_along_axis(node, best, 1), n)
        fresh = np.where((grown < n)[:, :, None], edges[np.minimum(grown, n - 1)], -1).reshape(q, -1)
        fresh = np.sort(np.where(fresh < 0, n, fresh), 1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = n
        fresh[seen[rows, fresh]] = n
        seen[rows, fresh] = True
        some = np.flatnonzero((fresh < n).any(0))
        if not some.size:
            continue
        fresh = fresh[:, some]
        d = np.where(fresh < n, _distance(asked, x[np.minimum(fresh, n - 1)]), np.inf).astype(np.float32)
        node, far, done = np.concatenate([node, fresh], 1), np.concatenate([far, d], 1), np.concatenate([done, fresh == n], 1)
        keep = np.argpartition(far, width - 1, 1)[:, :width]
        node, far, done = (np.take_along_axis(a, keep, 1) for a in (node, far, done))
    order = np.argsort(far, 1, kind="stable")
    node, far = np.take_along_axis(node, order, 1), np.take_along_axis(far, order, 1)
    return np.where(np.isfinite(far), node, -1), far


def prune(x: np.ndarray, of: np.ndarray, found: np.ndarray, alpha: float = ALPHA, degree: int = DEGREE) -> np.ndarray:
    """Edges of nodes ``of`` among candidates ``found`` (-1: none): the nearest left is kept, and those that are alpha times nearer to it than to the node go."""
    ok = (found >= 0) & (found != of[:, None])
    at = x[np.maximum(found, 0)]
    near = np.where(ok, _distance(x[of], at), np.inf)
    square = np.einsum("qmd,qmd->qm", at, at)
    apart = np.maximum(square[:, :, None] + square[:, None, :] - 2 * at @ at.transpose(0, 2, 1), 0)
    out = np.full((len(of), degree), -1)
    rows = np.arange(len(of))
    for j in range(degree):
        c = near.argmin(1)
        some = np.isfinite(near[rows, c])
        if not some.any():
            break
        out[some, j] = found[rows, c][some]
        gone = alpha * alpha * apart[rows, c] <= near
        near[gone] = np.inf
        near[rows, c] = np.inf
    return out


def build(x: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(edges (n, DEGREE) padded with -1, entry points) of a graph over distinct vectors."""
    n = len(x)
    edges = np.full((n, DEGREE), -1)
    order = np.random.default_rng(seed).permutation(n)
    centre = int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))
    order = np.concatenate([[centre], order[order != centre]])
    entries = order[: 1 + ENTRIES]
    at = 0
    while at < n:
        batch = order[at : at + max(64, min(BATCH, at))]
        square = (x[batch] ** 2).sum(1)
        among = square[:, None] + square[None, :] - 2 * x[batch] @ x[batch].T
        np.fill_diagonal(among, np.inf)
        found = batch[np.argsort(among, 1)[:, : min(16 if at else DEGREE, len(batch) - 1)]]
        if at:
            found = np.concatenate([greedy(x, edges, entries[:at], x[batch], BUILD_WIDTH)[0], found], 1)
        if found.shape[1]:
            edges[batch] = prune(x, batch, found)
        source = np.repeat(batch, DEGREE)
        target = edges[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        back = np.argsort(target, kind="stable")
        source, target = source[back], target[back]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        for low in range(0, len(nodes), 256):
            some, c = nodes[low : low + 256], count[low : low + 256]
            wide = np.full((len(some), DEGREE + int(c.max())), -1)
            wide[:, :DEGREE] = edges[some]
            nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            wide[np.repeat(np.arange(len(some)), c), DEGREE + nth] = source[first[low] : first[low] + c.sum()]
            wide = np.sort(wide, 1)[:, ::-1]
            wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
            full = (wide >= 0).sum(1) > DEGREE
            if full.any():
                edges[some[full]] = prune(x, some[full], wide[full])
            edges[some[~full]] = np.sort(wide[~full], 1)[:, ::-1][:, :DEGREE]
        at += len(batch)
    return edges, entries


def _scaled(x: np.ndarray, axis: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Doubles over the power of two (of all rows, or of each along ``axis``) that bounds them by 1, and its exponent."""
    power = np.frexp(np.abs(x).max(axis=axis, keepdims=True))[1]
    return np.ldexp(x, -power), power


def _packed(x: np.ndarray) -> bytes:
    """Doubles as bytes, four each where that loses nothing."""
    with np.errstate(over="ignore", under="ignore"):
        small = x.astype(np.float32)
    return small.tobytes() if (small == x).all() else x.tobytes()


def _unpacked(raw: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * rows * dim else np.float64).reshape(rows, dim).astype(np.float64)


def _lifted(x: np.ndarray) -> np.ndarray:
    square = (x.astype(np.float64) ** 2).sum(1)
    return np.concatenate([x, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], 1).astype(np.float32)


_GRAPH = "shard string, dim long, ids binary, firsts binary, vectors binary, edges binary, entries binary"


def _graphs(keep: int):
    def run(batches):
        shard, dim, ids, vectors = None, 0, [], []

        def done():
            x, i = np.frombuffer(b"".join(vectors), np.float64).reshape(-1, dim), np.array(ids)
            _, node = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, 8 * dim))).ravel(), return_inverse=True)
            order = np.lexsort((i, node))
            node, i = node[order], i[order]
            first = np.searchsorted(node, np.arange(node[-1] + 1))
            own = x[order[first]]
            # only the smallest ids of equal vectors can be among the nearest
            nth = np.arange(len(i)) - first[node]
            i, node = i[nth < keep], node[nth < keep]
            first = np.searchsorted(node, np.arange(node[-1] + 2))
            edges, entries = build(_lifted(_scaled(own)[0]))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard]), pa.array([dim], pa.int64()), *(pa.array([a], pa.binary()) for a in (i.astype(np.int64).tobytes(), first.astype(np.int64).tobytes(), _packed(own), edges.astype(np.int32).tobytes(), entries.astype(np.int64).tobytes()))],
                ["shard", "dim", "ids", "firsts", "vectors", "edges", "entries"],
            )

        for batch in batches:
            for s, d, i, v in zip(*(batch.column(j).to_pylist() for j in range(3)), batch.column(3)):
                if s != shard:
                    if ids:
                        yield done()
                    shard, dim, ids, vectors = s, d, [], []
                ids.append(i)
                vectors.append(v.values.to_numpy(zero_copy_only=False).astype(np.float64).tobytes())
        if ids:
            yield done()

    return run


def _blocks(batches):
    """(block, dim, ids, vectors) of at most BLOCK queries."""
    for batch in batches:
        by: dict[int, list] = {}
        for i, d, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            by.setdefault(d, []).append((i, v.values.to_numpy(zero_copy_only=False).astype(np.float64)))
        for d, held in by.items():
            for at in range(0, len(held), BLOCK):
                part = held[at : at + BLOCK]
                yield pa.RecordBatch.from_arrays([pa.array([part[0][0]], pa.int64()), pa.array([d], pa.int64()), pa.array([np.array([i for i, _ in part], np.int64).tobytes()], pa.binary()), pa.array([_packed(np.concatenate([v for _, v in part]))], pa.binary())], ["block", "qdim", "qids", "qvectors"])


_BOTH = ["shard", "portion", "dim", "ids", "vectors", "firsts", "edges", "entries", "block"]


def _search(k: int, width: int):
    """Rows by shard and portion, a graph ahead of blocks of queries, which have no edges."""

    def run(batches):
        lifted = wide = power = ids = firsts = edges = entries = None
        for batch in batches:
            for r in batch.to_pylist():
                d = r["dim"]
                if r["edges"] is not None:
                    ids, firsts = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["firsts"], np.int64)
                    edges, entries = np.frombuffer(r["edges"], np.int32).reshape(-1, DEGREE), np.frombuffer(r["entries"], np.int64)
                    wide, power = _scaled(_unpacked(r["vectors"], len(edges), d))
                    lifted = _lifted(wide)
                    continue
                qids = np.frombuffer(r["ids"], np.int64)
                q, powers = _scaled(_unpacked(r["vectors"], len(qids), d), 1)
                node, _ = greedy(lifted, edges, entries, np.concatenate([q, np.zeros((len(q), 1))], 1).astype(np.float32), min(max(width, k + 1), len(wide)))
                found, scores = [], []
                for i in range(len(q)):
                    some = node[i][node[i] >= 0]
                    score = np.ldexp((wide[some] * q[i]).sum(1), int(power.item() + powers[i, 0]))
                    n = np.diff(firsts)[some]
                    at = np.repeat(firsts[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    candidate, score = ids[at], np.repeat(score, n)
                    score, candidate = score[candidate != qids[i]], candidate[candidate != qids[i]]
                    order = np.lexsort((candidate, -score))[:k]
                    found.append(np.concatenate([candidate[order], np.full(k - len(order), -1)]).astype(np.int64))
                    scores.append(np.concatenate([score[order], np.full(k - len(order), -np.inf)]))
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.array([d], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in (qids, np.concatenate(found), np.concatenate(scores)))], ["block", "dim", "qids", "found", "scores"])

    return run


def _merge(k: int):
    def run(batches):
        key, qids, found, scores = None, None, None, None

        def done():
            n = (found >= 0).sum(1)
            ok = found >= 0
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n)), pa.array(np.concatenate([np.arange(1, m + 1) for m in n]).astype(np.int32), pa.int32()), pa.array(found[ok]), pa.array(scores[ok])], ["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                f, s = np.frombuffer(r["found"], np.int64).reshape(-1, k), np.frombuffer(r["scores"], np.float64).reshape(-1, k)
                if (r["block"], r["dim"]) != key:
                    if key is not None:
                        yield done()
                    key, qids, found, scores = (r["block"], r["dim"]), np.frombuffer(r["qids"], np.int64), f, s
                else:
                    found, scores = np.concatenate([found, f], 1), np.concatenate([scores, s], 1)
                    order = np.lexsort((found, -scores), axis=1)[:, :k]
                    found, scores = np.take_along_axis(found, order, 1), np.take_along_axis(scores, order, 1)
        if key is not None:
            yield done()

    return run


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, width: int = WIDTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found in ``vectors``, by largest inner product in double precision.

    Both have (vec_id, embedding).  Nearest first, ties to the smaller vec_id; a query isn't its own
    neighbour; fewer rows if there are fewer candidates.  Rows with a null id, or a vector that is null, empty,
    zero or holds a null or non-finite component take no part, and only vectors of one length meet.  Repeated
    rows count as often as they stand there, and equal vectors of a shard beyond the k + 1 of smallest id, which
    can't be among the nearest, leave its graph.  Components of any size take part as the doubles they are; a
    product beyond doubles is infinite.  Other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)

    def usable(df):
        e = F.col("embedding").cast("array<double>")
        ok = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.size(e).cast("long").alias("dim"), e.alias("embedding")).filter(F.col("vec_id").isNotNull() & ok)

    most = F.array_max(F.transform("embedding", F.abs))
    length = F.log2(most) + F.log2(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + (v / most) * (v / most))) / 2
    data = usable(vectors).withColumn("band", F.floor((length + BAND_BITS / 2) / BAND_BITS))
    n = partitions_for(vectors)
    shards = materialize(data.groupBy("dim", "band").agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.col("dim") * 4 / shard_bytes)).cast("long").alias("shards")))
    name = lambda nth: F.concat_ws(":", F.col("dim").cast("string"), F.col("band").cast("string"), nth.cast("string")).alias("shard")
    dealt = data.join(shards, ["dim", "band"]).select(name(F.pmod(F.xxhash64("vec_id"), "shards")), "dim", "vec_id", "embedding")
    graphs = materialize(dealt.repartition(n, "shard").sortWithinPartitions("shard", "vec_id").mapInArrow(_graphs(k + 1), _GRAPH))
    blocks = materialize(usable(queries).select("vec_id", "dim", "embedding").repartition(n, "vec_id").mapInArrow(_blocks, "block long, qdim long, qids binary, qvectors binary"))
    portions = blocks.groupBy(F.col("qdim").alias("dim")).agg(F.ceil(F.count("*") / PORTION).cast("long").alias("portions"))
    plan = materialize(shards.join(portions, "dim"))
    # every block meets every shard of its length: the number of shards sets how often a block is copied
    none = F.lit(None).cast("binary")
    told = graphs.join(portions, "dim").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("portions") - 1)).alias("portion"), "dim", "ids", "vectors", "firsts", "edges", "entries", F.lit(None).cast("long").alias("block"))
    asked = blocks.join(plan, F.col("qdim") == F.col("dim")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("nth"), F.pmod(F.xxhash64("block"), "portions").alias("portion"), "dim", "band", F.col("qids").alias("ids"), F.col("qvectors").alias("vectors"), "block")
    asked = asked.select(name(F.col("nth")), "portion", "dim", "ids", "vectors", none.alias("firsts"), none.alias("edges"), none.alias("entries"), "block")
    asked = asked.join(graphs.select("shard"), "shard", "left_semi")  # a shard may be empty
    both = told.unionByName(asked).select(*_BOTH).repartition(n, "shard", "portion").sortWithinPartitions("shard", "portion", F.col("edges").isNull(), "block")
    found = both.mapInArrow(_search(k, width), "block long, dim long, qids binary, found binary, scores binary")
    return found.repartition(n, "block", "dim").sortWithinPartitions("block", "dim").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")
