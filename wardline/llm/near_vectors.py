"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one for each shard.

Vectors meet only under equal labels.  Equal vectors of a label are one node that counts them; nodes are dealt to
shards by their place, so a label may hold any share of all rows.  A shard's graph has layers, each a geometric
share of the one below; a node enters from the layers above, a beam search proposes its neighbours and the diverse
ones stay.  One task builds a shard's graph and asks it: for the shard's own nodes from their own places on, for
those of half of the label's other shards, which follow as rows, by a beam from the top; from what lies near enough,
edges are followed as far as they stay near.  The beam widens until an audit finds all links of a spread sample,
which it holds against exact products; where it would grow to much of a shard, and where queries have more than
DENSE links on average, products of all are taken.  Each candidate's cosine is taken in double precision.  What
leaves a task is a count for each node and a forest of its links, whose components are joined by Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, fresh, join_hot, materialize, partitions_for, small_batches

#: Cosine of a link; vectors of a shard at most, about, and bytes of them.
COSINE, SHARD_ROWS, SHARD_BYTES = 0.93, 98_304, 50_400_000
#: Edges of a node in the lowest layer, half as many above; share of a layer's nodes in the next; beam when building.
DEGREE, LAYER_SHARE, BUILD_WIDTH = 24, 1 / 16, 32
#: Beam that searches begin with; queries that an audit holds against exact products; share of their links to find.
WIDTH, AUDIT, RECALL = 32, 256, 1.0
#: A layer of so many nodes is asked by products; places from which a search enters a layer; how far beyond the radius it goes on.
FLAT, ENTRIES, SLACK = 8192, 8, 1.5
#: Nodes added, and queries asked, at a time; nodes that a search step expands; pairs that are measured at a time.
BATCH, BLOCK, STEP, FRONT = 256, 512, 4, 16384
#: Links a query, on average, from which products take the place of searches; pairs of a shard held at once; rows of others that ask a shard at a time.
DENSE, MANY, ASKED = 1024, 16_000_000, 8192


def _apart(asked: np.ndarray, at: np.ndarray) -> np.ndarray:
    """1 - cosine of unit vectors: each row's ``asked`` (q, d) to its own ``at`` (q, m, d)."""
    return 1 - np.matmul(at, asked[:, :, None])[:, :, 0]


def beam(x: np.ndarray, edges: np.ndarray, starts: np.ndarray, asked: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of each row of ``asked`` from its own ``starts`` (q, s): (nodes, distances), nearest first, -1 and inf where there are fewer."""
    q, n = len(asked), len(x)
    rows = np.arange(q)[:, None]
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # the missing edge
    node = np.full((q, width), n)
    far = np.full((q, width), np.inf, np.float32)
    starts = np.sort(starts[:, :width], 1)
    starts = np.where(np.concatenate([np.zeros((q, 1), bool), starts[:, 1:] == starts[:, :-1]], 1), n, starts)
    node[:, : starts.shape[1]] = starts
    far[:, : starts.shape[1]] = np.where(starts < n, _apart(asked, x[np.minimum(starts, n - 1)]), np.inf)
    seen[rows, starts] = True
    done = node == n
    while True:
        still = np.where(done, np.inf, far)
        best = np.argpartition(still, min(STEP, width) - 1, 1)[:, :STEP]
        usable = np.isfinite(np.take_along_axis(still, best, 1))
        live = np.flatnonzero(usable.any(1))
        if not live.size:
            break
        np.put_along_axis(done, best, True, 1)
        grown = np.where(usable[live], np.take_along_axis(node[live], best[live], 1), n)
        more = np.where((grown < n)[:, :, None], edges[np.minimum(grown, n - 1)], -1).reshape(len(live), -1)
        more = np.sort(np.where(more < 0, n, more), 1)
        more[:, 1:][more[:, 1:] == more[:, :-1]] = n
        own = live[:, None]
        more[seen[own, more]] = n
        seen[own, more] = True
        more = np.sort(more, 1)
        more = more[:, : int((more < n).sum(1).max())]
        if not more.shape[1]:
            continue
        d = np.where(more < n, _apart(asked[live], x[np.minimum(more, n - 1)]), np.inf).astype(np.float32)
        all_node, all_far, all_done = np.concatenate([node[live], more], 1), np.concatenate([far[live], d], 1), np.concatenate([done[live], more == n], 1)
        keep = np.argpartition(all_far, width - 1, 1)[:, :width]
        node[live], far[live], done[live] = (np.take_along_axis(a, keep, 1) for a in (all_node, all_far, all_done))
    order = np.argsort(far, 1, kind="stable")
    node, far = np.take_along_axis(node, order, 1), np.take_along_axis(far, order, 1)
    return np.where(np.isfinite(far), node, -1), far


def diverse(x: np.ndarray, of: np.ndarray, found: np.ndarray, degree: int) -> np.ndarray:
    """Edges of nodes ``of`` among candidates ``found`` (-1: none): nearest first, each only if it is nearer to the node than to all taken; then the nearest of the rest."""
    ok = (found >= 0) & (found != of[:, None])
    at = x[np.maximum(found, 0)]
    near = np.where(ok, _apart(x[of], at), np.inf)
    among = 1 - np.matmul(at, at.transpose(0, 2, 1))
    out = np.full((len(of), degree), -1)
    rows = np.arange(len(of))
    taken = np.zeros(len(of), np.int64)
    left, open_ = near.copy(), near.copy()
    for _ in range(min(degree, found.shape[1])):
        c = open_.argmin(1)
        some = np.isfinite(open_[rows, c])
        if not some.any():
            break
        out[some, taken[some]] = found[rows, c][some]
        taken[some] += 1
        open_[some] = np.where(among[rows, c][some] < near[some], np.inf, open_[some])
        open_[rows[some], c[some]] = left[rows[some], c[some]] = np.inf
    for c in np.argsort(left, 1)[:, :degree].T:
        some = np.isfinite(left[rows, c]) & (taken < degree)
        out[some, taken[some]] = found[rows, c][some]
        taken[some] += 1
    return out


class Graph:
    """Layers over unit vectors, the lowest first: edges among their places; a layer above the lowest that has few nodes is asked as a whole and has none."""

    def __init__(self, x: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        level = np.floor(np.log(np.maximum(rng.random(len(x)), 1e-12)) / np.log(LAYER_SHARE)).astype(int)
        self.order = np.lexsort((rng.random(len(x)), -level))  # those of the highest layers come first
        self.own, self.place = x[self.order], np.argsort(self.order)
        sizes = [int((level >= k).sum()) for k in range(level.max(initial=0) + 1)]
        self.layers: list[np.ndarray] = [np.zeros((n, 0), np.int32) for n in sizes]
        for k in reversed(range(len(sizes))):
            if k == 0 or sizes[k] > FLAT:
                self.layers[k] = self._layer(k, sizes[k], DEGREE if k == 0 else DEGREE // 2)

    def entries(self, asked: np.ndarray, layer: int) -> np.ndarray:
        """Where each query enters ``layer``: places of the layers above that are near to it."""
        at, flat = np.zeros((len(asked), 1), np.int64), len(self.layers)
        for k in reversed(range(layer + 1, len(self.layers))):
            if len(self.layers[k]) <= FLAT:
                flat = k
        if flat < len(self.layers):
            own = self.own[: len(self.layers[flat])]
            parts = ENTRIES if len(own) >= 4 * ENTRIES else 1
            each = len(own) // parts
            near = asked @ own[: each * parts].T
            at = near.reshape(len(asked), parts, each).argmax(2) + np.arange(parts) * each
        for k in reversed(range(layer + 1, flat)):
            edges = self.layers[k]
            at = np.maximum(beam(self.own[: len(edges)], edges, at, asked, ENTRIES)[0], 0)
        return at

    def _layer(self, k: int, n: int, degree: int) -> np.ndarray:
        """Edges of the first ``n`` places, added in batches; a node has room for half as many more, and keeps the diverse ones when that is full."""
        x = self.own[:n]
        room = degree + degree // 2
        edges = np.full((n, room), -1, np.int32)
        has = np.zeros(n, np.int64)
        at = 0
        while at < n:
            batch = np.arange(at, min(n, at + max(32, min(BATCH, at))))
            among = 1 - x[batch] @ x[batch].T
            np.fill_diagonal(among, np.inf)
            found = batch[np.argsort(among, 1)[:, : min(16, len(batch) - 1)]]
            if at:
                found = np.concatenate([beam(x[:at], edges[:at], np.minimum(self.entries(x[batch], k), at - 1), x[batch], min(BUILD_WIDTH, at))[0], found], 1)
            if found.shape[1]:
                edges[batch, :degree] = diverse(x, batch, found, degree)
                has[batch] = (edges[batch] >= 0).sum(1)
            source, target = np.repeat(batch, degree), edges[batch, :degree].ravel()
            source, target = source[target >= 0], target[target >= 0]
            inside = target >= at  # within the batch an edge back may be there already
            if inside.any():
                there = np.zeros(len(source), bool)
                there[inside] = (edges[target[inside]] == source[inside][:, None]).any(1)
                source, target = source[~there], target[~there]
            back = np.argsort(target, kind="stable")
            source, target = source[back], target[back]
            nodes, first, count = np.unique(target, return_index=True, return_counts=True)
            nth = np.arange(len(target)) - np.repeat(first, count)
            fits = has[nodes] + count <= room
            some = np.repeat(fits, count)
            edges[target[some], has[target[some]] + nth[some]] = source[some]
            has[nodes[fits]] += count[fits]
            nodes, first, count = nodes[~fits], first[~fits], count[~fits]
            for low in range(0, len(nodes), BATCH):
                some, c, f = nodes[low : low + BATCH], count[low : low + BATCH], first[low : low + BATCH]
                wide = np.full((len(some), room + int(c.max())), -1)
                wide[:, :room] = edges[some]
                nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                wide[np.repeat(np.arange(len(some)), c), room + nth] = source[np.repeat(f, c) + nth]
                edges[some] = -1
                edges[some, :degree] = diverse(x, some, wide, degree)
                has[some] = (edges[some] >= 0).sum(1)
            at += len(batch)
        return edges

    def _flood(self, asked: np.ndarray, q: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, distance) of what the places ``c`` lead to, over edges between places within ``reach`` of the query; themselves included."""
        n, edges = len(self.own), self.layers[0]
        seen = np.zeros((len(asked), n), bool)
        seen[q, c] = True
        out, due = [(q, c, self._far(asked, q, c))], [(q, c)]
        while due:
            q, c = due.pop()
            if len(q) > FRONT:
                due += [(q[FRONT:], c[FRONT:])]
                q, c = q[:FRONT], c[:FRONT]
            more = edges[c]
            i, j = np.nonzero(more >= 0)
            q, c = q[i], more[i, j]
            new = ~seen[q, c]
            code = np.unique(q[new] * n + c[new])
            q, c = code // n, code % n
            seen[q, c] = True
            far = self._far(asked, q, c)
            near = far <= reach
            if near.any():
                out.append((q[near], c[near], far[near]))
                due.append((q[near], c[near]))
        return tuple(np.concatenate([o[i] for o in out]) for i in range(3))

    def _far(self, asked: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.float32), *(1 - np.einsum("ij,ij->i", asked[q[i : i + FRONT]], self.own[c[i : i + FRONT]]) for i in range(0, len(q), FRONT))])

    def within(self, asked: np.ndarray, radius: float, width: int, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) found at a distance of ``radius`` or less: what a beam ends with, or a query's own place, and what that leads to."""
        rows, nodes = [], []
        step = max(1, min(BLOCK, BLOCK * 64 // width, 50_000_000 // len(self.own)))
        for low in range(0, len(asked), step):
            some = asked[low : low + step]
            if places is None:
                node, far = beam(self.own, self.layers[0], self.entries(some, 0), some, min(width, len(self.own)))
                q, i = np.nonzero((node >= 0) & (far <= SLACK * radius))
                c = node[q, i]
            else:
                q, c = np.arange(len(some)), places[low : low + step]
            q, c, far = self._flood(some, q, c, SLACK * radius)
            rows.append(q[far <= radius] + low)
            nodes.append(self.order[c[far <= radius]])
        return np.concatenate(rows), np.concatenate(nodes)


def _blocks(asked: np.ndarray, x: np.ndarray, cosine: float):
    """Parts of all pairs (row of ``asked``, row of ``x``) that are near enough, by products."""
    step = max(1, min(256, 8_000_000 // len(x)))
    for low in range(0, len(asked), step):
        q, c = np.nonzero(asked[low : low + step] @ x.T >= cosine)
        yield q + low, c


def found_links(x: np.ndarray, y: np.ndarray, graph: Graph, cosine: float, own: bool = False):
    """Parts of the pairs (row of ``x``, row of ``y``) of unit vectors in double precision that ``graph``, over ``y``, finds and whose cosine is enough.

    ``own`` says that x is y: a query then begins at its own place.  The beam widens until audited queries find
    RECALL of what exact products find for them; where a beam of a large part of the shard doesn't, products of all do.
    """
    audited = np.unique(np.linspace(0, len(x) - 1, min(AUDIT, len(x))).astype(np.int64))
    due = sum(len(q) for q, _ in _blocks(x[audited], y, cosine))
    if due > DENSE * len(audited):  # searches would visit much of the shard
        yield from _blocks(x, y, cosine)
        return
    asked, radius = x.astype(np.float32), 1 - cosine + 1e-5
    places, width = graph.place if own else None, WIDTH

    def part(rows):
        q, c = graph.within(asked[rows], radius, width, None if places is None else places[rows])
        q = rows[q]
        near = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x[q[i : i + FRONT]], y[c[i : i + FRONT]]) for i in range(0, len(q), FRONT))])
        return q[near >= cosine], c[near >= cosine]

    while len(part(audited)[0]) < RECALL * due:
        if places is not None:
            places = None
            continue
        width *= 4
        if width > max(WIDTH, len(y) // 8):
            yield from _blocks(x, y, cosine)
            return
    for low in range(0, len(x), BLOCK):
        yield part(np.arange(low, min(low + BLOCK, len(x))))


def links(x: np.ndarray, y: np.ndarray, graph: Graph, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """All of :func:`found_links` at once."""
    parts = list(found_links(x, y, graph, cosine))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component), over n nodes, with the components of the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        then = label.copy()
        np.minimum.at(then, a, low)
        np.minimum.at(then, b, low)
        np.minimum.at(then, label[a], low)
        np.minimum.at(then, label[b], low)
        then = then[then]
        if (then == label).all():
            break
        label = then
    some = np.flatnonzero(label != np.arange(n))
    return some, label[some]


def _pieces(batches):
    """Rows (within, shard, asks, node, times, vector) -> runs of equal (within, shard) and asks, with their vectors scaled to unit length."""
    for batch in batches:
        told = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], 1)
        cuts = np.flatnonzero((told[1:] != told[:-1]).any(1)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(told)]):
            if high == low:
                continue
            nodes, times = (batch.column(i).slice(low, high - low).to_numpy() for i in (3, 4))
            x = batch.column(5).slice(low, high - low).flatten().to_numpy().reshape(high - low, -1)
            x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])  # by a power of two, so that no square overflows or vanishes
            yield tuple(told[low, :2]), bool(told[low, 2]), nodes, times, x / np.sqrt((x * x).sum(1))[:, None]


class _Shard:
    """A shard's own rows, its graph, and the links that they and those of other shards have there: (node, links, other), a count or an edge of a forest."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], cosine: float):
        self.nodes, self.times, self.x = (np.concatenate([p[i] for p in parts]) for i in range(3))
        parts.clear()
        self.cosine, self.graph = cosine, Graph(self.x.astype(np.float32))

    def own(self):
        n, codes, many = len(self.x), [], 0
        for q, c in found_links(self.x, self.x, self.graph, self.cosine, own=True):
            codes.append(np.unique(np.minimum(q, c)[q != c] * n + np.maximum(q, c)[q != c]))
            many += len(codes[-1])
            if many > MANY:  # too many to hold: by blocks of products, in which each row has all of its own
                codes.clear()
                return self._told(self.nodes, self.times, _blocks(self.x, self.x, self.cosine), True)
        code = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)  # each pair may have been found from both ends
        q, c = code // n, code % n
        return self._told(self.nodes, self.times, [(np.concatenate([q, c]), np.concatenate([c, q]))], True)

    def asked(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        nodes, times, x = (np.concatenate([p[i] for p in parts]) for i in range(3))
        return self._told(nodes, times, found_links(x, self.x, self.graph, self.cosine), False)

    def _told(self, nodes, times, found, own):
        n = len(self.nodes)
        count, back = np.zeros(len(nodes)), np.zeros(n)
        every = nodes if own else np.concatenate([self.nodes, nodes])
        a = b = np.zeros(0, np.int64)
        for q, c in found:
            if own:
                q, c = q[q != c], c[q != c]
            if not len(q):
                continue
            count += np.bincount(q, self.times[c], minlength=len(nodes))
            if not own:
                back += np.bincount(c, times[q], minlength=n)
            a, b = forest(np.concatenate([a, q + (0 if own else n)]), np.concatenate([b, c]), len(every))
        count = (count if own else np.concatenate([back, count])).astype(np.int64)
        some = np.flatnonzero(count)
        node = np.concatenate([every[some], every[a]])
        other = pa.array([*[None] * len(some), *every[b].tolist()], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(np.concatenate([count[some], np.zeros(len(a), np.int64)]), pa.int64()), other], ["node", "links", "other"])


def _links(cosine: float):
    """Rows sorted by shard, those of other shards that ask it after its own -> what :class:`_Shard` tells."""

    def run(batches):
        key, own, asks, shard = None, [], [], None

        def built():
            nonlocal shard
            if own and shard is None:
                shard = _Shard(own, cosine)
                yield shard.own()

        def asked():
            if asks and shard is not None:
                yield shard.asked(asks)
            asks.clear()

        for now, asking, *piece in _pieces(batches):
            if now != key:
                yield from built()
                yield from asked()
                key, shard = now, None
                own.clear()
            if not asking:
                own.append(piece)
                continue
            yield from built()
            asks.append(piece)
            if sum(len(p[0]) for p in asks) >= ASKED:
                yield from asked()
        yield from built()
        yield from asked()

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Rows of equal label link where the cosine of their vectors, of one length, is ``cosine`` or more.  n_links
    counts other rows linked directly, component_id is the smallest vec_id reachable by links, the row's own
    included, and kept says that it is the row's own.  A null label, and a vector that is null, empty, zero or
    holds a null or non-finite component, links with nothing; every other finite vector takes part, however large
    or small, and double components stay double.  Rows that share an id are told apart by their vectors; equal
    vectors of a label link.  A row with a null id takes part: its component is the smallest id that isn't null, and
    it is kept where there is none.  Other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    e = F.col("embedding").cast("array<double>")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), e.alias("embedding"))
    ok = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    n = partitions_for(vectors)
    # two hashes from different beginnings: 128 bits
    key = F.struct(F.xxhash64("label", "embedding").alias("h"), F.xxhash64(F.lit(7), "embedding", "label").alias("g"))
    usable = base.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("key", F.when(F.col("ok"), key))
    some = usable.filter("ok")
    distinct = some.groupBy("key").agg(F.count("*").alias("times"), F.min("vec_id").alias("low"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    distinct = materialize(distinct.withColumn("dim", F.size("embedding").cast("long")))
    # a shard is told by its label and length, ``within``, and its number there
    rows = F.greatest(F.lit(1.0), F.least(F.lit(float(shard_rows)), SHARD_BYTES / (8.0 * F.col("dim"))))
    plan = distinct.groupBy("label", "dim").agg(F.ceil(F.count("*") / rows).cast("long").alias("shards"))
    plan = materialize(plan.withColumn("within", F.monotonically_increasing_id()))
    dealt = distinct.join(plan, ["label", "dim"]).withColumn("shard", F.pmod(F.col("key.g"), "shards"))
    nodes = materialize(dealt.select(F.monotonically_increasing_id().alias("node"), "key", "times", "low", "within", "shard", "shards", F.col("embedding").alias("vector")))
    # each pair of shards meets once: a shard asks the next half of them, round about
    half = F.when(F.col("shards") > 1, F.sequence(F.lit(1).cast("long"), F.floor(F.col("shards") / 2).cast("long"))).otherwise(F.array().cast("array<long>"))
    others = F.filter(half, lambda j: (2 * j < F.col("shards")) | (F.col("shard") < j))
    goes = F.explode(F.concat(F.array(F.lit(0).cast("long")), others))
    met = nodes.withColumn("step", goes).select("within", F.pmod(F.col("shard") + F.col("step"), "shards").alias("shard"), (F.col("step") > 0).alias("asks"), "node", "times", "vector")
    tasks = max(n, min(2000, 3 * (plan.agg(F.sum("shards")).first()[0] or 0)))
    # by ranges, a third of a shard each: no two large shards meet in a task, as they may by hashes
    met = met.repartitionByRange(tasks, "within", "shard").sortWithinPartitions("within", "shard", "asks")
    found = materialize(met.mapInArrow(_links(cosine), "node long, links long, other long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    component = connected_components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    joined = nodes.select("node", "key", "times", "low").join(counts, "node", "left").join(component.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    joined = materialize(joined)
    least = joined.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("members"))
    told = materialize(join_hot(joined, least, "component", "node", "members").select("key", "times", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id"))
    (many,) = fresh(usable, "many")
    linked = join_hot(some.select("key", "vec_id"), told.withColumnRenamed("times", many), "key", "vec_id", many)
    rest = usable.filter(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.select("vec_id", "n_links", "component_id").unionByName(rest)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
