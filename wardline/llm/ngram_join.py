"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

The columns (n-grams) of a document are dealt by hash into blocks, as many as the pair bound for its size
allows different n-grams, and one more.  Two documents within the threshold then agree completely on one
block at least (pigeonhole), so documents without an equal block never meet.  Those with one are held against
the bound by parity vectors: each n-gram flips a bit, so vectors differ in no more bits than sets in n-grams.
What is left falls into small groups that hold every link.  In each the overlap counts of its pairs
accumulate over column chunks (a matrix product), and pairs below the size-derived bound go.

Hot groups: equal n-gram sets are one row with a multiplicity, found by a sort that deals copies into portions;
equal blocks are sorted by (block, set), so a hot block spreads over many tasks.  Its rows are dealt by hash into segments, and every segment is held against
itself and every other one, a pair of segments to a tile, which gives a star for each cluster; a large group is
tiled by size class and hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, connected_components, forget, grams, join_hot, materialize, mix, partitions_for, slices, small_batches, string_buffer, to_long

#: Rows and n-grams of one tile of the product.
TILE_ROWS, TILE_GRAMS = 1024, 2_000_000
#: Columns that one step of the product takes.
CHUNK = 2048
#: Bytes up to which the list of members with their tiles is broadcast; beyond, it is joined by a shuffle.
BROADCAST_BYTES = 16_000_000
#: Copies of one set, within a task of the sort, that find their class in one place.
PORTION = 1000


def _bounds(num: int, den: int, most: int) -> list[int]:
    """Size class starts: sizes that can link are in the same or in neighbouring classes."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * den // num + 1)
    return [*out, out[-1] * den // num + 1, (out[-1] * den // num + 1) * den // num + 1]


def gram_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word n-grams by document: values sorted within each, and the first index of each document.

    A document of fewer than k words has its whole sequence as one n-gram, one without words none.
    """
    w = Words(data, offsets, fold=True)
    count = np.diff(w.first)
    g = grams(w.hash, k)
    whole = np.flatnonzero(w.doc[: len(g)] == w.doc[k - 1 :]) if len(g) else np.zeros(0, np.int64)
    doc, value = w.doc[whole], g[whole]
    if (short := np.flatnonzero((count > 0) & (count < k))).size:
        h = np.full(len(short), 7, np.uint64)
        for j in range(k - 1):
            here = count[short] > j
            at = np.minimum(w.first[short] + j, len(w.hash) - 1)
            h = np.where(here, mix(h * np.uint64(0xA24BAED4963EE407) + w.hash[at] + np.uint64(j)), h)
        doc, value = np.concatenate([doc, short]), np.concatenate([value, h])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[keep], value[keep]
    return value, np.searchsorted(doc, np.arange(len(offsets)))


def _sums(where: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2^64 of ``value`` by ``where``."""
    low = np.bincount(where, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    high = np.bincount(where, (value >> np.uint64(32)).astype(np.float64), n)
    return low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))


def block_signatures(value: np.ndarray, first: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash of one whole block) for each block that may make a link, see the module's head."""
    size = np.diff(first)
    starts = np.array(_bounds(num, den, int(size.max(initial=1))))
    doc = np.repeat(np.arange(len(size)), size)
    mixed = mix(value ^ np.uint64(0x5851F42D4C957F2D))
    own = np.searchsorted(starts, np.maximum(size, 1), "right") - 1
    docs, sigs = [], []
    for up in (0, 1):
        c = own + up
        most = 2 * (starts[c + 1] - 1) * (den - num) // (den + num)
        blocks = most + 1 + most // 128
        base = np.concatenate([[0], np.cumsum(blocks)])
        at = base[doc] + (mixed % blocks.astype(np.uint64)[doc]).astype(np.int64)
        total = _sums(at, value, int(base[-1]))
        full = np.bincount(at, minlength=int(base[-1])) > 0
        of = np.repeat(np.arange(len(size)), blocks)
        filled = np.bincount(of[full], minlength=len(size))
        # too few filled blocks for the pigeonhole: the empty ones count as well
        take = (full | (filled <= most)[of]) & (size > 0)[of]
        part = np.arange(int(base[-1])) - base[of]
        sig = mix(total + mix((c[of].astype(np.uint64) << np.uint64(40)) + part.astype(np.uint64) + np.uint64(1)))
        docs.append(of[take])
        sigs.append(sig[take])
    doc, sig = np.concatenate(docs), np.concatenate(sigs)
    order = np.argsort(doc, kind="stable")
    return doc[order], sig[order]


def parity_vectors(value: np.ndarray, first: np.ndarray, num: int, den: int) -> list[bytes]:
    """For each set bits that its n-grams flip, a power of two of them and four times its pair bound at least.

    A vector folds to half its length by the exclusive or of its halves, so vectors of any two sizes compare.
    """
    size = np.diff(first)
    bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(1, 8 * size * (den - num) / (den + num)))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(bits)])
    doc = np.repeat(np.arange(len(size)), size)
    at = base[doc] + (mix(value + np.uint64(77)) & (bits[doc] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=int(base[-1])) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little")
    return [packed[a // 8 : b // 8].tobytes() for a, b in zip(base, base[1:])]


def _folded(vectors: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows of ``width`` 64-bit words, longer ones folded."""
    out = np.empty((len(vectors), width), np.uint64)
    for i, v in enumerate(vectors):
        w = np.frombuffer(v, np.uint64)
        while len(w) > width:
            w = w[: len(w) // 2] ^ w[len(w) // 2 :]
        out[i] = w
    return out


def _differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _describe(k: int, num: int, den: int):
    def run(batches):
        for batch in batches:
            data, offsets = string_buffer(batch.column(1))
            for x, y in slices(offsets):
                value, first = gram_sets(data, offsets[x : y + 1], k)
                doc = np.repeat(np.arange(y - x), np.diff(first))
                whole = [_sums(doc, mix(value + np.uint64(s)), y - x) for s in (11, 23)]
                of, sig = block_signatures(value, first, num, den)
                cut = np.searchsorted(of, np.arange(y - x + 1))
                none = np.diff(first) == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(x, y - x).cast(pa.int64()),
                        to_long(np.diff(first)),
                        pa.array(whole[0].view(np.int64), mask=none),
                        pa.array(whole[1].view(np.int64), mask=none),
                        pa.array([sig[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                        pa.array(parity_vectors(value, first, num, den), pa.binary()),
                    ],
                    ["id", "n", "s1", "s2", "sigs", "bits"],
                )

    return run


def _portions(batches):
    """Rows (s1, s2, id, n) in order, each with the number of its portion among the copies of its set in this task."""
    last, held = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        s1, s2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.ones(len(s1), bool)
        new[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
        start = np.flatnonzero(new)
        nth = np.arange(len(s1)) - np.repeat(start, np.diff(np.append(start, len(s1))))
        if (s1[0], s2[0]) == last:
            nth[: start[1] if len(start) > 1 else None] += held
        last, held = (s1[-1], s2[-1]), int(nth[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth // PORTION)], ["s1", "s2", "id", "n", "portion"])


def _spread(batches):
    for batch in batches:
        for x in range(0, batch.num_rows, 200):
            part = batch.slice(x, 200)
            sigs = [np.frombuffer(b.as_py(), np.int64) for b in part.column(2)]
            n = [len(s) for s in sigs]
            if sum(n):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(sigs)), pa.array(np.repeat(part.column(1).to_numpy(), n)), pa.array(np.repeat(part.column(0).to_numpy(), n))], ["sig", "s1", "id"]
                )


#: Distinct sets with one block that are taken pair by pair; more are held against one another in segments.
FEW = 16
#: Rows and n-grams of one segment of a hot block; a tile holds two segments at most.
SEGMENT, SEGMENT_GRAMS = 8192, 32_000_000


def _meet(batches):
    """Rows by (sig, s1, id), equal sets next to each other: pairs (a, b) of blocks with few sets, rows (a, sig) of others.

    A task can't see what its neighbours hold of its first and last block, so these go as rows too.
    """
    held: list[np.ndarray] | None = None
    first, several = True, None

    def rows(sig, i, take):
        return pa.RecordBatch.from_arrays([pa.array(i[take]), pa.nulls(int(take.sum()), pa.int64()), pa.array(sig[take])], ["a", "b", "sig"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(j).to_numpy() for j in range(3)]
        if held is not None:
            columns = [np.concatenate(c) for c in zip(held, columns)]
        sig, s1, i = columns
        keep = np.ones(len(sig), bool)
        keep[1:] = (sig[1:] != sig[:-1]) | (s1[1:] != s1[:-1])
        sig, s1, i = (c[keep] for c in (sig, s1, i))
        edge = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1], [True]]))
        size = np.diff(edge)
        open_ = np.zeros(len(size), bool)  # goes as rows whatever its size
        if first:
            open_[0] = True
            several, first = int(sig[0]), False
        elif several is not None and sig[0] == several:
            open_[0] = True
        done = np.ones(len(size), bool)
        done[-1] = open_[-1] or size[-1] > SEGMENT
        if done[-1]:
            open_[-1] = True
            several = int(sig[-1])
        many = np.repeat(done & (open_ | (size > FEW)), size)
        if many.any():
            yield rows(sig, i, many)
        few = done & ~open_ & (size > 1) & (size <= FEW)
        a, b = [], []
        for j in range(1, FEW):
            start = edge[:-1][few & (size > j)]
            left = size[few & (size > j)] - j
            at = np.repeat(start, left) + np.arange(left.sum()) - np.repeat(np.cumsum(left) - left, left)
            a.append(i[at])
            b.append(i[at + j])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.nulls(len(a), pa.int64())], ["a", "b", "sig"])
        held = None if done[-1] else [c[edge[-2] :] for c in (sig, s1, i)]
    if held is not None:
        yield rows(held[0], held[2], np.ones(len(held[0]), bool))


def _near_pairs(num: int, den: int):
    """Pairs whose parity vectors don't rule a link out."""

    def run(batches):
        for batch in batches:
            a, b, na, nb = (batch.column(j).to_numpy() for j in range(4))
            va, vb = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            width = np.array([min(len(x), len(y)) // 8 for x, y in zip(va, vb)])
            ok = np.zeros(len(a), bool)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                ok[at] = _differences(_folded([va[j] for j in at], w), _folded([vb[j] for j in at], w)) <= (na[at] + nb[at]) * (den - num) // (den + num)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    return run


def _tiles(rows: DataFrame) -> DataFrame:
    """``rows`` (sig, id, n, bits) as (sig, tile, side, id, n, bits): any two rows of a block share a tile.

    Sides 0 and 1 are two segments that are held against each other, side 2 one that is held against itself.
    """
    sized = rows.groupBy("sig").agg(F.greatest(F.ceil(F.count("*") / SEGMENT), F.ceil(F.sum("n") / SEGMENT_GRAMS)).alias("t"))
    large = materialize(sized.filter("t > 1"))
    t = F.coalesce("t", F.lit(1).cast("long"))
    dealt = rows.join(large, "sig", "left").select("sig", "id", "n", "bits", t.alias("t"), F.pmod(F.xxhash64("id", "sig"), t).alias("h"))
    h, t = F.col("h"), F.col("t")
    tile = lambda g: F.struct((F.least(h, g) * t + F.greatest(h, g)).alias("tile"), F.when(g == h, 2).when(g < h, 1).otherwise(0).cast("long").alias("side"))
    each = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), t - 1), tile)).alias("x")
    return dealt.select("sig", "id", "n", "bits", each).select("sig", "x.tile", "x.side", "id", "n", "bits")


def _clusters(num: int, den: int):
    """Rows (sig, tile, side, id, n, bits) by (sig, tile): edges (id, root of its cluster) within each tile."""

    def settle(side, ids, n, vectors):
        width = min(len(v) for v in vectors) // 8
        v = _folded(vectors, width)
        root = np.full(len(ids), -1)
        for i in range(len(ids)):
            if root[i] < 0:
                root[i] = i
                edge = [i]
                while edge:
                    j = edge.pop()
                    open_ = np.flatnonzero((root < 0) & ((side != side[j]) | (side == 2)))
                    if open_.size:
                        near = open_[_differences(v[open_], v[j]) <= (n[open_] + n[j]) * (den - num) // (den + num)]
                        root[near] = i
                        edge += near.tolist()
        other = root != np.arange(len(ids))
        return ids[other], ids[root[other]]

    def run(batches):
        key, held = None, ([], [], [], [])

        def done():
            a, b = settle(*map(np.array, held[:3]), held[3])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for sig, tile, *row in zip(*(batch.column(j).to_pylist() for j in range(6))):
                if (sig, tile) != key:
                    if key is not None:
                        yield done()
                    key, held = (sig, tile), ([], [], [], [])
                for to, x in zip(held, row):
                    to.append(x)
        if key is not None:
            yield done()

    return run


def _sets_of(k: int):
    def run(batches):
        for batch in batches:
            data, offsets = string_buffer(batch.column(batch.schema.get_field_index("text")))
            rest = [c for c in batch.schema.names if c != "text"]
            for x, y in slices(offsets):
                value, first = gram_sets(data, offsets[x : y + 1], k)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(x, y - x) for c in rest), pa.array([value[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())], [*rest, "grams"]
                )

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Overlap counts of all pairs of sets, accumulated over column chunks; only shared columns take part."""
    both = left + (right or [])
    sizes = [len(s) for s in both]
    row = np.repeat(np.arange(len(both)), sizes)
    _, column, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right if right is not None else left)), np.float32)
    for at in range(0, int(shared.sum()), CHUNK):
        x, y = np.searchsorted(column, [at, at + CHUNK])
        part = np.zeros((len(both), min(CHUNK, int(shared.sum()) - at)), np.float32)
        part[row[x:y], column[x:y] - at] = 1
        out += part[: len(left)] @ (part if right is None else part[len(left) :]).T
    return out


def _linked(group: dict, num: int, den: int):
    """Rows (a, root, links) of one tile."""
    side = group["side"]
    order = np.argsort(side, kind="stable")
    ids, n, mult = (group[c][order] for c in ("id", "n", "mult"))
    sets = [np.frombuffer(group["grams"][i], np.uint64) for i in order]
    n = np.array([len(s) for s in sets])
    k = int((side == 0).sum())
    alone = k == len(sets)
    a, b = np.arange(k), np.arange(len(sets)) if alone else np.arange(k, len(sets))
    if not len(a) or not len(b):
        return None
    o = overlaps(sets[:k], None if alone else sets[k:]).astype(np.int64)
    link = (den * o >= num * (n[a][:, None] + n[b][None, :] - o)) & (o > 0)
    if alone:
        np.fill_diagonal(link, False)
        links = link @ mult
    else:
        links = np.concatenate([link @ mult[k:], link.T @ mult[:k]])
        wide = np.zeros((len(sets), len(sets)), bool)
        wide[:k, k:] = link
        wide[k:, :k] = link.T
        link = wide
    root = np.full(len(sets), -1)
    for i in np.argsort(ids, kind="stable"):
        if root[i] < 0:
            edge = np.array([i])
            root[i] = i
            while edge.size:
                edge = np.flatnonzero(link[edge].any(0) & (root < 0))
                root[edge] = i
    return ids, ids[root], links


def _product(num: int, den: int):
    names = ["id", "n", "mult", "side", "grams"]

    def run(batches):
        key, held = None, {c: [] for c in names}

        def done():
            group = {c: (held[c] if c == "grams" else np.array(held[c])) for c in names}
            out = _linked(group, num, den)
            return None if out is None else pa.RecordBatch.from_arrays([to_long(x) for x in out], ["a", "b", "links"])

        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ["tile", *names]}
            for i, t in enumerate(columns["tile"]):
                if t != key:
                    if key is not None and (x := done()) is not None:
                        yield x
                    key, held = t, {c: [] for c in names}
                for c in names:
                    held[c].append(columns[c][i])
        if key is not None and (x := done()) is not None:
            yield x

    return run


def ngram_join(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, n_links) of every row: links are pairs whose sets of k-word n-grams have a Jaccard similarity of num/den or more.

    Words are runs other than space and 0x09-0x0D, with A-Z lower-cased.  component_id is the smallest id
    reachable by links, n_links the number of rows linked with this one.  A null or wordless text has no
    n-grams, links with nothing and is its own component; a row with a null id too, and its component is
    null.  Rows with one id are one node.  Other columns are not read.  An empty table gives an empty one.
    A long text is in memory as a whole, with about 40 bytes a word.  n_links needs every pair of a component, so
    work there grows with the square of its distinct sets, tile by tile.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = materialize(base.mapInArrow(_describe(k, num, den), "id long, n long, s1 long, s2 long, sigs binary, bits binary"))
    parts = partitions_for(docs)
    linkable, rest = sets.filter("id is not null and n > 0"), sets.filter("id is null or n = 0")
    dealt = materialize(linkable.select("s1", "s2", "id", "n").repartitionByRange(parts, "s1", "s2", "id").sortWithinPartitions("s1", "s2", "id").mapInArrow(_portions, "s1 long, s2 long, id long, n long, portion long"))
    classes = dealt.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("mult"), F.max("portion").alias("last"))
    classes = classes.select("s1", "s2", "rep", "mult", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("portion"))
    alone = rest.select("id", "n", F.col("id").alias("rep"), F.lit(1).cast("long").alias("mult"), F.lit(0).cast("long").alias("portion"))
    nodes = materialize(dealt.join(classes, ["s1", "s2", "portion"]).select("id", "n", "rep", "mult", "portion").unionByName(alone))
    forget(dealt)

    vectors = sets.filter("id is not null and n > 0").groupBy("id").agg(F.max(F.struct("n", "bits")).alias("v")).select("id", "v.n", "v.bits")
    spread = sets.filter("id is not null and n > 0").select("id", "s1", "sigs").mapInArrow(_spread, "sig long, s1 long, id long")
    met = materialize(spread.repartitionByRange(parts, "sig", "s1", "id").sortWithinPartitions("sig", "s1", "id").mapInArrow(_meet, "a long, b long, sig long"))
    few = met.filter("sig is null").select("a", "b").distinct()
    with_a = few.join(vectors.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("va")), "a")
    with_b = with_a.join(vectors.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("vb")), "b")
    near = with_b.select("a", "b", "na", "nb", "va", "vb").mapInArrow(_near_pairs(num, den), "a long, b long")
    rows = materialize(met.filter("sig is not null").select("sig", F.col("a").alias("id")).join(vectors, "id").select("sig", "id", "n", "bits"))
    stars = materialize(_tiles(rows).repartition(parts, "sig", "tile").sortWithinPartitions("sig", "tile").mapInArrow(_clusters(num, den), "a long, b long"))
    pairs = near.union(stars).distinct()
    rep = nodes.filter("id is not null").groupBy("id").agg(F.min("rep").alias("rep"))
    pairs = materialize(pairs)
    for side, other in (("a", "b"), ("b", "a")):  # ids give way to the classes' smallest ones
        met_by = rep.join(pairs.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("c")), "id").select(F.col("id").alias(side), "rep", "c")
        pairs = join_hot(pairs, met_by, side, other, "c").drop(side).withColumnRenamed("rep", side)
    groups = materialize(connected_components(pairs))
    forget(met, rows, stars)

    step = float(np.log(den / num) * 1.000001)
    own = nodes.filter("n > 0").groupBy("rep").agg(F.max("n").alias("n"), F.max("mult").alias("mult"))
    members = groups.select(F.col("id").alias("rep"), "component").join(own, "rep").withColumn("cls", F.floor(F.log("n") / step).cast("int"))
    by_class = members.groupBy("component", "cls").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    total = by_class.groupBy("component").agg(F.sum("c").alias("c_all"), F.sum("s").alias("s_all"), F.map_from_entries(F.collect_list(F.struct("cls", F.greatest(F.ceil(F.col("c") / TILE_ROWS), F.ceil(F.col("s") / TILE_GRAMS)).cast("int").alias("t")))).alias("tiles"))
    m = members.join(total, "component").withColumn("one", (F.col("c_all") <= TILE_ROWS) & (F.col("s_all") <= TILE_GRAMS))
    count = lambda c: F.coalesce(F.try_element_at("tiles", c), F.lit(0))
    m = m.withColumn("h", F.pmod(F.xxhash64("rep"), count(F.col("cls")).cast("long")).cast("int"))
    key = lambda c, h, d, g: F.concat_ws(":", c, h, d, g)
    c, h = F.col("cls"), F.col("h")
    upto = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f))
    same = upto(count(c), lambda g: F.struct(key(c, F.least(h, g), c, F.greatest(h, g)).alias("t"), F.when(g < h, 1).otherwise(0).alias("side")))
    above = upto(count(c + 1), lambda g: F.struct(key(c, h, c + 1, g).alias("t"), F.lit(0).alias("side")))
    below = upto(count(c - 1), lambda g: F.struct(key(c - 1, g, c, h).alias("t"), F.lit(1).alias("side")))
    none = F.array().cast("array<struct<t:string,side:int>>")
    tiles = F.when(F.col("one"), F.array(F.struct(F.lit("").alias("t"), F.lit(0).alias("side")))).otherwise(F.concat(F.coalesce(same, none), F.coalesce(above, none), F.coalesce(below, none)))
    m = materialize(m.select(F.col("rep").alias("id"), F.col("component"), "n", "mult", tiles.alias("tiles")))

    size = m.agg(F.count("*").alias("rows"), F.sum(F.size("tiles")).alias("tiles")).first()
    small = 64 * size["rows"] + 64 * (size["tiles"] or 0) <= BROADCAST_BYTES  # what a row and a tile's name take
    texts = base.join(F.broadcast(m) if small else m, "id")
    grams_of = texts.select("id", "n", "mult", "component", "tiles", "text").mapInArrow(_sets_of(k), "id long, n long, mult long, component long, tiles array<struct<t:string,side:int>>, grams binary")
    tiled = grams_of.select("id", "n", "mult", "grams", "component", F.explode("tiles").alias("x")).select("id", "n", "mult", F.col("x.side").cast("long").alias("side"), "grams", F.concat_ws("/", F.col("component").cast("string"), "x.t").alias("tile"))
    done = materialize(tiled.repartition(partitions_for(docs), "tile").sortWithinPartitions("tile").mapInArrow(_product(num, den), "a long, b long, links long"))
    final = connected_components(done.filter("a <> b").select("a", "b"))
    links = done.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    # what a class has got goes to each portion of its copies
    last = nodes.filter("rep is not null").groupBy("rep").agg(F.max("portion").alias("last"))
    told = links.join(final.withColumnRenamed("id", "rep"), "rep", "left").join(last, "rep")
    told = told.select("rep", "links", "component", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("portion"))
    found = nodes.filter("rep is not null").join(told, ["rep", "portion"], "left").select("id", "n", "rep", "mult", "links", "component")
    lost = nodes.filter("rep is null").select("id", "n", "rep", "mult", F.lit(0).cast("long").alias("links"), F.lit(None).cast("long").alias("component"))
    return found.unionByName(lost).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links")
    )
