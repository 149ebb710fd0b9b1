"""Near-duplicate vectors by a robust-pruned flat graph.

Centroids are fitted on a bounded sample; every vector goes to the nearest
ones, so neighbouring shards overlap. How many is measured before the search:
the links of up to ``AUDITED`` vectors, found by brute force against all rows,
tell the share of linked pairs that meet in a shard at each overlap. In each shard a flat
graph is built (nearest candidates and a few far ones, both robust-pruned, in
both directions). The adjacency lists of a vector from all its shards are
united and sent back to each of them. There every vector is searched for:
best-first from the shard's medoids, and with every vector within the range
expanded, until none is left. Each search is audited against brute force on
some queries and widened when it missed a link. Only pairs whose cosine in
double precision reaches the threshold count, in the smallest shard that both
ends share. The searches of the shards are united by checksums, not by pairs:
each shard reports, per vector and set of shards shared with its links, their
number and the exclusive or of their hashes. Where the reports of a set differ,
some shard missed a link: the vector is compared exactly with its smallest
shared shard. At the end the audited vectors give the recall of the result.

Equal vectors are one node with a multiplicity, so a hot vector costs one
row. Shards above ``BLOCK`` vectors are cut into blocks and searched block by
block, so a task holds two blocks at most; tasks emit counts and the edges of
a spanning forest, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, mix

THRESHOLD = 0.95
CELL = 1000  # aimed vectors per shard
MAX_CELLS = 4096
SAMPLE_PER_CELL = 16  # sampled vectors per centroid: 65,536 at most
OVERLAP, MOST_OVERLAP = 3, 8  # shards of a vector, chosen within these
COVER = 0.99  # share of the audited links that should meet in a shard
AUDITED = 2048  # vectors compared with all others
BLOCK = 2048
NEAR, FAR, ALPHA = 20, 8, 1.2  # kept neighbours per vector, and the pruning slack
BEAM = 24
MEDOIDS = 8
AUDIT = 32  # audited queries per shard


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on the driver; the sample's size is bounded."""
    rng = np.random.default_rng(3)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        own = (sample @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
    return c


def prune(dist: np.ndarray, cand: np.ndarray, keep: int) -> np.ndarray:
    """Robust pruning of each row's candidates (sorted by distance): a kept one
    removes those that are ALPHA times closer to it than to the row. -1: none."""
    n, width = cand.shape
    d = dist[np.arange(n)[:, None], cand]
    alive, out, kept = cand != np.arange(n)[:, None], np.full((n, keep), -1), np.zeros(n, int)
    for c in range(width):
        take = np.flatnonzero(alive[:, c] & (kept < keep))
        if not len(take):
            continue
        out[take, kept[take]] = cand[take, c]
        kept[take] += 1
        rest = cand[take, c + 1:]
        alive[take, c + 1:] &= ~(ALPHA * dist[cand[take, c][:, None], rest] <= d[take, c + 1:])
    return out


def build_graph(x: np.ndarray) -> list[np.ndarray]:
    """Neighbours (local numbers) of each vector of one block."""
    n = len(x)
    dist = np.sqrt(np.maximum(2 - 2 * (x @ x.T), 0))
    rng = np.random.default_rng(n)
    near = np.argsort(dist, axis=1, kind="stable")[:, :min(n, 2 * NEAR + 1)]
    far = rng.integers(0, n, (n, 8 * FAR))
    far = np.take_along_axis(far, np.argsort(dist[np.arange(n)[:, None], far], axis=1), 1)
    kept = np.concatenate([prune(dist, near, NEAR), prune(dist, far, FAR)], 1)
    a, b = np.repeat(np.arange(n), kept.shape[1]), kept.ravel()
    a, b = a[b >= 0], b[b >= 0]
    pair = np.unique(np.concatenate([a * n + b, b * n + a]))
    return np.split(pair % n, np.searchsorted(pair // n, np.arange(1, n)))


def medoids_of(x: np.ndarray, k: int = MEDOIDS) -> np.ndarray:
    """The medoid, then the vectors farthest from those chosen before."""
    chosen = [int((x @ x.mean(0)).argmax())]
    best = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(best.argmin()))
        best = np.maximum(best, x @ x[chosen[-1]])
    return np.unique(chosen)


def range_search(x: np.ndarray, adjacent: list[np.ndarray], q: np.ndarray, threshold: float,
                 beam: int) -> np.ndarray:
    """found[i, j]: vector j of the index was reached and is within the range of
    query i. Best-first with ``beam``, then every vector in range is expanded."""
    n, m = len(x), len(q)
    degree = np.array([len(a) for a in adjacent])
    start = np.cumsum(degree) - degree
    flat = np.concatenate(adjacent) if n else np.zeros(0, int)
    sims = np.full((m, n), -2.0)
    done = np.zeros((m, n), bool)
    med = medoids_of(x)
    sims[:, med] = q @ x[med].T
    active = np.arange(m)
    while len(active):
        s = sims[active]
        open_ = np.where(done[active], -3.0, s)
        k = min(beam, n)
        floor = np.partition(s, n - k, axis=1)[:, n - k]  # the beam's worst
        w = min(4, n)
        top = np.argpartition(open_, n - w, axis=1)[:, n - w:]
        pick = np.zeros(s.shape, bool)
        np.put_along_axis(pick, top, True, 1)
        pick &= (open_ > -1.5) & (open_ >= floor[:, None])
        pick |= open_ >= threshold
        qi, node = np.nonzero(pick)
        if not len(qi):
            break
        done[active[qi], node] = True
        d = degree[node]
        at = np.arange(d.sum()) - np.repeat(np.cumsum(d) - d, d)
        new = np.zeros(s.shape, bool)
        new[np.repeat(qi, d), flat[np.repeat(start[node], d) + at]] = True
        new &= s < -1.5
        ni, nn = np.nonzero(new)
        for lo in range(0, len(ni), 1 << 16):
            i, j = ni[lo:lo + (1 << 16)], nn[lo:lo + (1 << 16)]
            sims[active[i], j] = np.einsum("ij,ij->i", q[active[i]], x[j])
        active = active[np.unique(qi)]
    return sims >= threshold


def audited_search(x, adjacent, q, threshold: float) -> np.ndarray:
    """``range_search`` with a beam that is widened until no audited query
    misses a link; the last resort compares the two blocks in full."""
    probe = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))
    truth = q[probe] @ x.T >= threshold
    for beam in (BEAM, 4 * BEAM):
        found = range_search(x, adjacent, q, threshold, beam)
        if not (truth & ~found[probe]).any():
            return found
    return q @ x.T >= threshold


def shared_sets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per row the set of a's cells that b has too, as bits (bit i: a's i-th cell)."""
    out = np.zeros(len(a), np.int64)
    for lo in range(0, len(a), 1 << 15):
        same = (a[lo:lo + (1 << 15), :, None] == b[lo:lo + (1 << 15), None, :]).any(2)
        out[lo:lo + (1 << 15)] = same @ (1 << np.arange(a.shape[1]))
    return out


def digests(owner: np.ndarray, shared: np.ndarray, other: np.ndarray, mult: np.ndarray):
    """Per owner and set of two cells or more: (owner, set, links, their weight,
    exclusive or of their hashes)."""
    at = np.flatnonzero(shared & (shared - 1))
    at = at[np.lexsort((shared[at], owner[at]))]
    owner, shared, other, mult = owner[at], shared[at], other[at], mult[at]
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shared[1:] != shared[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return (np.zeros(0, np.int64),) * 5
    code = np.bitwise_xor.reduceat(mix(other.astype(np.uint64)), first).view(np.int64)
    return (owner[first], shared[first], np.diff(np.append(first, len(at))),
            np.add.reduceat(mult, first), code)


def audit(placed: DataFrame, queries: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Brute force of the queries (k, v, near) against all nodes: links[q, t] =
    other vectors linked with query q that share a cell with it at overlap t and
    none below (last column: at no overlap), and the weight of all its links."""
    width = MOST_OVERLAP
    links, weight = np.zeros((queries.num_rows, width + 2), np.int64), np.zeros(queries.num_rows, np.int64)
    if not queries.num_rows:
        return links, weight
    ask = placed.sparkSession.sparkContext.broadcast(
        (queries.column("k").to_numpy(), [np.array(v) for v in queries.column("v").to_pylist()],
         _padded(queries.column("near").to_pylist(), width, -1)))
    rank = np.maximum.outer(np.arange(1, width + 1), np.arange(1, width + 1)).astype(np.int8)

    def run(batches):
        key, vec, near = ask.value
        dims = np.array([len(v) for v in vec])
        for b in batches:
            size = pa.compute.list_value_length(b.column("v")).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                qs, rows = np.flatnonzero(dims == dim), np.flatnonzero(size == dim)
                part = b.take(pa.array(rows))
                for lo in range(0, len(rows), BLOCK):
                    t = part.slice(lo, BLOCK)
                    k, mult = t.column(0).to_numpy(), t.column(1).to_numpy()
                    hit = _matrix(pa.chunked_array([t.column(2)])) @ np.array([vec[q] for q in qs]).T >= threshold
                    hit &= k[:, None] != key[qs][None, :]
                    cells = _padded(t.column(3).to_pylist(), width, -2)
                    r, c = np.nonzero(hit)
                    level = np.empty(len(r), np.int64)
                    for i in range(0, len(r), 1 << 14):
                        same = cells[r[i:i + (1 << 14)], :, None] == near[qs[c[i:i + (1 << 14)]], None, :]
                        level[i:i + (1 << 14)] = np.where(same, rank, width + 1).min((1, 2))
                    code, inv = np.unique(qs[c] * (width + 2) + level, return_inverse=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(code), pa.array(np.bincount(inv, minlength=len(code)).astype(np.int64)),
                         pa.array(np.bincount(inv, mult[r], len(code)).astype(np.int64))], names=["at", "n", "w"])

    got = placed.select("k", "mult", "v", "near").mapInArrow(run, "at long, n long, w long") \
                .groupBy("at").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).toArrow()
    at = got.column("at").to_numpy()
    links[at // (width + 2), at % (width + 2)] = got.column("n").to_numpy()
    np.add.at(weight, at // (width + 2), got.column("w").to_numpy())
    return links, weight


def overlap_for(links: np.ndarray) -> int:
    """The smallest overlap at which COVER of the audited links share a cell, both
    of all links and of each linked vector's on average (so that one large
    group does not decide alone)."""
    own = links.sum(1)
    linked = links[own > 0]
    if not len(linked):
        return OVERLAP
    by_link = np.cumsum(linked.sum(0)) / linked.sum()
    by_vector = (np.cumsum(linked, 1) / own[own > 0, None]).mean(0)
    enough = np.flatnonzero(np.minimum(by_link, by_vector)[:MOST_OVERLAP + 1] >= COVER)
    return int(min(max(enough[0] if len(enough) else MOST_OVERLAP, OVERLAP), MOST_OVERLAP))


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, k, v): unit vectors in double precision, k a hash of the components;
    v is null for vectors that link with nothing."""
    src = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))

    def unit(batches):
        for b in batches:
            col = b.column("v")
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN
            size = np.array([0 if x is None else x for x in pa.compute.list_value_length(col).to_pylist()])
            rows, off = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
            top = np.zeros(len(size))
            full = np.flatnonzero(size)
            if len(full):
                top[full] = np.maximum.reduceat(np.abs(flat), off[full])  # NaN stays
            ok = np.isfinite(top) & (top > 0)
            flat, rows = flat[ok[rows]], rows[ok[rows]]
            flat = flat / top[rows]  # no overflow in the norm
            norm = np.sqrt(np.bincount(rows, flat * flat, len(size)))
            ends = np.concatenate([[0], np.cumsum(np.where(ok, size, 0))])
            v = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(~ok, False)),
                                         pa.array(flat / norm[rows]))
            yield pa.RecordBatch.from_arrays([b.column("id"), v], names=["id", "v"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(unit, f"id {kind}, v array<double>").withColumn("k", F.xxhash64("v", F.size("v")))


def links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
          threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: id, ``n_links`` (other vectors at or above the
    threshold), ``component_id`` (smallest id reachable by links), ``kept``, and
    on every row ``recall``: the share of the audited vectors' links that the
    result holds (null: they have none).

    Null, zero and non-finite vectors, and those with a null component, have
    no links and are a component each; vectors of different length are never
    linked. Repeated rows count as vectors of their own. A null id gives
    kept = false, and its component is null if it has no other id."""
    rows = materialize(unit_vectors(vectors, id_col, vec_col), "graph-vectors")
    nodes = rows.where("v IS NOT NULL").groupBy("k").agg(
        F.count("*").alias("mult"), F.first("v").alias("v"))
    nodes = materialize(nodes, "graph-nodes")
    n = nodes.count()
    k = max(1, min(MAX_CELLS, n // CELL))

    def drawn(df, key, most):  # about twice as many by hash, then no more than the bound
        return df.where(F.pmod(key, F.lit(1 << 20)) < F.lit(int(np.ceil(min(1.0, 2 * most / max(n, 1)) * (1 << 20))))
                        ).limit(most)

    pick = drawn(nodes, F.col("k"), 2 * k * SAMPLE_PER_CELL)
    by_dim: dict[int, list] = {}
    for r in pick.select("v").collect():
        by_dim.setdefault(len(r["v"]), []).append(r["v"])
    shared, base = {}, 0
    for dim in sorted(by_dim):
        c = centroids(np.array(by_dim[dim]), max(1, round(k * len(by_dim[dim]) / max(
            1, sum(map(len, by_dim.values()))))))
        shared[dim] = (base, c)
        base += len(c)
    spread = vectors.sparkSession.sparkContext.broadcast(shared)

    def assign(batches):
        for b in batches:
            cells = []
            vs = [np.array(v.as_py()) for v in b.column("v")]
            for v in vs:
                if len(v) in spread.value:
                    lo, c = spread.value[len(v)]
                    s = c @ v
                    cells.append((np.argsort(-s, kind="stable")[:MOST_OVERLAP] + lo).tolist())
                else:  # a length that the sample does not have
                    cells.append([-3 - len(v)])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(cells, pa.list_(pa.int32()))], names=[*b.schema.names, "near"])

    placed = materialize(nodes.mapInArrow(assign, "k long, mult long, v array<double>, near array<int>"),
                         "graph-cells")
    asked = drawn(placed, F.xxhash64(F.lit(9), "k"), AUDITED).select("k", "v", "near").toArrow()
    audited, weight = audit(placed, asked, threshold)
    placed = placed.withColumn("cells", F.array_sort(F.slice("near", 1, overlap_for(audited)))).drop("near")
    spots = placed.select("k", "mult", "v", "cells", F.explode("cells").alias("cell"))
    sizes = spots.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    spots = spots.join(sizes, "cell").withColumn(
        "blk", F.pmod(F.xxhash64(F.lit(5), "k"), F.col("blocks")).cast("int"))
    spots = materialize(spots, "graph-spots")

    def build(t: pa.Table) -> pa.Table:
        key = t.column("k").to_numpy()
        near = build_graph(_matrix(t.column("v")))
        return pa.table({"k": key, "near": pa.array([key[x].tolist() for x in near], pa.list_(pa.int64()))})

    graph = spots.select("cell", "blk", "k", "v").groupBy("cell", "blk") \
                 .applyInArrow(build, "k long, near array<long>")
    union = graph.groupBy("k").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    spots = materialize(spots.join(union, "k"), "graph-union")
    # block i searched in the index of block j, i <= j
    tasks = spots.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cell", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "k", "mult",
        "v", "cells", "near")

    def find(t: pa.Table) -> pa.Table:
        t = t.sort_by([("blk", "ascending"), ("k", "ascending")])
        cell, i, j = (t.column(c)[0].as_py() for c in ("cell", "i", "j"))
        key, mult, blk = (t.column(c).to_numpy() for c in ("k", "mult", "blk"))
        x, cells = _matrix(t.column("v")), np.array(t.column("cells").to_pylist())
        near = t.column("near").to_pylist()
        at = np.flatnonzero(blk == j)
        local = key[at]
        adjacent = []
        for r in at:
            p = np.array(near[r], np.int64)
            to = np.minimum(np.searchsorted(local, p), len(local) - 1) if len(local) else p[:0]
            adjacent.append(to[local[to] == p] if len(p) else to)
        ask = np.flatnonzero(blk == i)
        if not len(at) or not len(ask):
            return _found()
        found = audited_search(x[at], adjacent, x[ask], threshold)
        if i == j:
            found |= found.T
            found &= ~np.eye(len(found), dtype=bool)
        r, c = np.nonzero(found)
        a, b = ask[r], at[c]
        shared = shared_sets(cells[a], cells[b])
        own = np.flatnonzero(cells[a, _lowest(shared)] == cell)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, a[own], mult[b[own]])
        reports = [digests(key[a], shared, key[b], mult[b])]
        if i != j:
            np.add.at(total, b[own], mult[a[own]])
            reports.append(digests(key[b], shared_sets(cells[b], cells[a]), key[a], mult[a]))
        return pa.concat_tables([_found(key[total > 0], total[total > 0], _forest(key, a[own], b[own]))] + [
            pa.table({"a": k, "b": pa.nulls(len(k), pa.int64()), "w": w, "cell": np.full(len(k), cell),
                      "shared": s, "n": n, "x": h}) for k, s, n, w, h in reports])

    schema = "a long, b long, w long, cell long, shared long, n long, x long"
    out = materialize(tasks.groupBy("cell", "i", "j").applyInArrow(find, schema), "graph-links")
    # reports per vector, set and cell; a set whose cells do not agree is compared exactly
    reports = out.where("shared IS NOT NULL").groupBy("a", "shared", "cell").agg(
        F.sum("w").alias("w"), F.sum("n").alias("n"), F.bit_xor("x").alias("x"))
    differ = reports.groupBy("a", "shared").agg(
        F.count("*").alias("m"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("x").alias("x0"),
        F.max("x").alias("x1"), F.min_by("w", "cell").alias("w0"), F.min("cell").alias("c0")) \
        .where("m < bit_count(shared) OR n0 < n1 OR x0 < x1")
    place = spots.select(F.col("k").alias("a"), "cell", "blk", "v", "cells")
    lowest = F.expr("element_at(cells, cast(bit_count((shared & -shared) - 1) + 1 as int))")
    differ = differ.join(place, "a").where(F.col("cell") == lowest).select(
        "a", "shared", F.when(F.col("c0") == F.col("cell"), F.col("w0")).otherwise(0).alias("w0"),
        "cell", F.col("blk").alias("i"), "v", "cells")
    differ = materialize(differ, "graph-differ")
    against = spots.join(differ.select("cell", F.col("i").alias("i")).distinct(), "cell") \
                   .select("cell", "i", F.col("blk").alias("j"), "k", "mult", "v", "cells")
    sizes = spots.groupBy("cell").agg(F.max("blocks").alias("blocks"))
    again = differ.join(sizes, "cell").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
                  .select("cell", "i", "j", "a", "shared", "v", "cells")

    def exact(q: pa.Table, t: pa.Table) -> pa.Table:
        if not q.num_rows or not t.num_rows:
            return _found()
        asked, key, mult = q.column("a").to_numpy(), t.column("k").to_numpy(), t.column("mult").to_numpy()
        hit = _matrix(q.column("v")) @ _matrix(t.column("v")).T >= threshold
        r, c = np.nonzero(hit & (asked[:, None] != key[None, :]))
        same = shared_sets(np.array(q.column("cells").to_pylist())[r], np.array(t.column("cells").to_pylist())[c])
        keep = same == q.column("shared").to_numpy()[r]
        a, b = asked[r[keep]], c[keep]
        who, inv = np.unique(a, return_inverse=True)
        total = np.bincount(inv, mult[b], len(who)).astype(np.int64)
        both, inv = np.unique(np.concatenate([a, key[b]]), return_inverse=True)
        return _found(who, total, _forest(both, inv[:len(a)], inv[len(a):]))

    mended = materialize(again.groupBy("cell", "i", "j").cogroup(against.groupBy("cell", "i", "j"))
                         .applyInArrow(exact, schema), "graph-mended")
    # what the smallest shared cell had counted for these sets gives way to the exact count
    count = out.where("b IS NULL AND shared IS NULL").select("a", "w").unionByName(
        mended.where("b IS NULL").select("a", "w")).unionByName(
        differ.select("a", (-F.col("w0")).alias("w"))).groupBy(F.col("a").alias("c")).agg(F.sum("w").alias("w"))
    out = out.where("b IS NOT NULL").select("a", "b").unionByName(mended.where("b IS NOT NULL").select("a", "b"))
    comp = components(out, "graph")
    count = materialize(count, "graph-counts")
    recall = _recall(asked, weight, count)
    node = nodes.select("k", "mult").join(count, F.col("k") == F.col("c"), "left") \
        .join(comp, F.col("k") == F.col("node"), "left") \
        .select(F.col("k").alias("nk"), (F.col("mult") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"),
                F.coalesce("root", "k").alias("root"))
    joined = materialize(rows.select("id", F.when(F.col("v").isNotNull(), F.col("k")).alias("k"))
                         .join(node, F.col("k") == F.col("nk"), "left").select("id", "n_links", "root"),
                         "graph-rows")
    first = joined.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("low")) \
                  .withColumnRenamed("root", "r")
    done = joined.join(first, F.col("root") == F.col("r"), "left")
    comp_id = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("low"))
    return done.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                       comp_id.alias("component_id"),
                       F.coalesce(F.col("id") == comp_id, F.lit(False)).alias("kept"),
                       F.lit(recall).cast("double").alias("recall"))


def _recall(asked: pa.Table, weight: np.ndarray, count: DataFrame) -> float | None:
    """Share of the audited links that the counts hold; AUDITED rows at most."""
    linked = np.flatnonzero(weight)
    if not len(linked):
        return None
    truth = count.sparkSession.createDataFrame(
        list(zip(asked.column("k").to_numpy()[linked].tolist(), weight[linked].tolist())), "k long, t long")
    got = truth.join(count, F.col("k") == F.col("c"), "left").agg(
        F.sum(F.least("t", F.coalesce("w", F.lit(0))))).first()[0]
    return float(got / weight.sum())


def _lowest(bits: np.ndarray) -> np.ndarray:
    """Place of the lowest bit that is set."""
    return np.log2((bits & -bits).astype(np.float64)).astype(int)


def _padded(lists: list, width: int, fill: int) -> np.ndarray:
    out = np.full((len(lists), width), fill, np.int64)
    for row, x in zip(out, lists):
        row[:len(x)] = x
    return out


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks()
    values = col.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(col), -1).astype(np.float64)


def _forest(key, a, b) -> list[tuple]:
    """Edges that join what is not joined yet."""
    parent: dict = {}

    def find(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    edges = []
    for p, q in zip(a.tolist(), b.tolist()):
        rp, rq = find(p), find(q)
        if rp != rq:
            parent[max(rp, rq)] = min(rp, rq)
            edges.append((int(key[p]), int(key[q])))
    return edges


def _found(key=(), total=(), edges=()) -> pa.Table:
    """Counts (b is null) and forest edges of a task; no report."""
    n, e = len(key), np.array(edges, np.int64).reshape(-1, 2)
    none = pa.nulls(n + len(e), pa.int64())
    return pa.table({
        "a": pa.array(np.concatenate([np.asarray(key, np.int64), e[:, 0]])),
        "b": pa.array(np.concatenate([np.zeros(n, np.int64), e[:, 1]]),
                      mask=np.arange(n + len(e)) < n),
        "w": pa.array(np.concatenate([np.asarray(total, np.int64), np.zeros(len(e), np.int64)])),
        "cell": none, "shared": none, "n": none, "x": none})


def audit_recall(vectors: DataFrame, result: DataFrame, id_col: str = "vec_id",
                 vec_col: str = "embedding", threshold: float = THRESHOLD, every: int = 50) -> float:
    """Share of the links of the vectors with id divisible by ``every`` that the
    result holds, against brute force over all vectors in blocks of queries."""
    unit = unit_vectors(vectors, id_col, vec_col).where("v IS NOT NULL").select("id", "v")
    found = truth = 0
    ask = []

    def run(ask):
        spread = vectors.sparkSession.sparkContext.broadcast(
            (np.array([r["id"] for r in ask]), [r["v"] for r in ask]))

        def count(batches):
            ids, asked = spread.value
            total = np.zeros(len(ids), np.int64)
            width = np.array([len(v) for v in asked])
            for b in batches:
                size = pa.compute.list_value_length(b.column("v"))
                for dim in np.unique(width):
                    own = np.flatnonzero(width == dim)
                    v = b.column("v").filter(pa.compute.equal(size, int(dim)))
                    if len(v):
                        q = np.array([asked[i] for i in own])
                        total[own] += (_matrix(pa.chunked_array([v])) @ q.T >= threshold).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["id", "t"])

        got = unit.mapInArrow(count, "id long, t long").groupBy("id").agg((F.sum("t") - 1).alias("t"))
        r = got.join(result.select("id", "n_links"), "id").agg(F.sum(F.least("t", "n_links")), F.sum("t")).first()
        return r[0] or 0, r[1] or 0

    for row in unit.where(F.col("id") % every == 0).toLocalIterator():
        ask.append(row)
        if len(ask) == 4096:
            f, t = run(ask)
            found, truth, ask = found + f, truth + t, []
    if ask:
        f, t = run(ask)
        found, truth = found + f, truth + t
    return found / truth if truth else 1.0
