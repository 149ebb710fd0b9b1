"""Near-duplicate documents by Order MinHash.

A text's five-word shingles are labelled with their occurrence number. Each
of ``SKETCHES`` hash functions picks the ``PICKS`` smallest labelled shingles
and keeps them in text order, so two texts agree in a sketch only if they
share those shingles and their order, which follows edit similarity. Texts
that agree in a sketch are candidates, verified by aligning their shingle
sequences inside a band: linked if the aligned shingles are at least
``SIMILARITY`` of all (aligned / (a + b - aligned)).

Scale: texts with equal words are one node from the start. A bucket of equal
sketches never emits its pairs: first every member is compared with the
bucket's smallest member only; buckets whose members then still lie in
different components are compared in full inside tasks, in blocks of
``BLOCK`` members, and give only the links that join components. Components
are found by distributed rounds. Node ids are 64-bit hashes of the words. Rows
meet their node's and their class's row by a shuffle; nodes and classes with
more than 1 / ``HOT_KEYS`` of all rows, of which there are fewer than
``HOT_KEYS``, are sent to the rows instead, so no task gets a hot class.

Texts without words are copies of each other only if their bytes are equal;
null and empty texts are never linked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (TMP, WordHasher, annotate, components, flat_text, materialize, mix, row_key,
                     spill_lists, word_table)

WORDS = 5
SIMILARITY = 0.8
SKETCHES = 24
PICKS = 4
BLOCK = 512  # members of a bucket that are compared in one go
HOT_KEYS = 1000  # a key with more than 1 / HOT_KEYS of all rows is joined by broadcast

_C = np.uint64(0xD6E8FEB86659FD93)
FIELDS = "c1 long, n int, sketch array<long>, words binary"


def shingles(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hash of each run of k words; a shorter text is one shingle."""
    w = words.astype(np.uint64)
    with np.errstate(over="ignore"):
        if len(w) < k:
            h = np.uint64(len(w))
            for x in w:
                h = h * _C + x
            return mix(np.array([h], np.uint64)) if len(w) else np.zeros(0, np.uint64)
        h = np.zeros(len(w) - k + 1, np.uint64)
        for j in range(k):
            h = h * _C + w[j:len(w) - k + 1 + j]
        return mix(h)


def labelled(sh: np.ndarray) -> np.ndarray:
    """Shingles with their occurrence number, hashed."""
    order = np.argsort(sh, kind="stable")
    s = sh[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if new.all():
        return sh
    at = np.arange(len(s))
    occ = np.zeros(len(s), np.uint64)
    occ[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(occ == 0, sh, mix(sh + occ * _C))


class Sketcher:
    def __init__(self, sketches: int = SKETCHES, picks: int = PICKS):
        self.picks = picks
        seeds = mix(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.mult, self.band = seeds | np.uint64(1), mix(seeds)

    def __call__(self, sh: np.ndarray) -> np.ndarray:
        lab, k = labelled(sh), self.picks
        with np.errstate(over="ignore"):
            if len(lab) <= k:
                picked = np.tile(lab, (len(self.mult), 1))
            elif len(lab) * len(self.mult) > 1 << 21:  # long text: one function at a time
                at = [np.sort(np.argpartition(lab * m, k - 1)[:k]) for m in self.mult]
                picked = lab[np.array(at)]
            else:
                at = np.argpartition(lab[None, :] * self.mult[:, None], k - 1, axis=1)[:, :k]
                at.sort(axis=1)
                picked = lab[at]
            h = self.band.copy()
            for j in range(picked.shape[1]):
                h = h * _C + picked[:, j]
            return mix(h).view(np.int64)


def sketch_texts(text: pa.Array, hasher: WordHasher, sketcher: Sketcher) -> list[pa.Array]:
    raw, off = flat_text(text)
    rows, h = hasher(raw, off)
    n_words = np.bincount(rows, minlength=len(text))
    ends = np.cumsum(n_words)
    c1 = np.zeros(len(text), np.uint64)
    full = np.flatnonzero(n_words)
    with np.errstate(over="ignore"):
        place = (np.arange(len(h)) - np.repeat(ends - n_words, n_words)).astype(np.uint64)
        if len(full):
            c1[full] = mix(np.add.reduceat(mix(h ^ mix(place + _C)), (ends - n_words)[full]))
    small = (h >> np.uint64(32)).astype(np.uint32)
    count, lists, words = np.zeros(len(text), np.int32), [], []
    for i in range(len(text)):
        w = small[ends[i] - n_words[i]:ends[i]]
        words.append(w.tobytes())
        sh = shingles(w)
        count[i] = len(sh)
        lists.append(sketcher(sh) if len(sh) else np.zeros(0, np.int64))
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    return [pa.array(c1.view(np.int64), mask=n_words == 0), pa.array(count),
            spill_lists(flat, np.array([len(x) for x in lists], np.int64)),
            pa.array(words, pa.binary())]


def sketch_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k1, k2, c1, n, sketch, words) of every row: k1 and k2 name the row
    by id and text, c1 its words."""
    k1, k2 = row_key(id_col, text_col)
    text = F.col(f"`{text_col}`")
    src = docs.select(F.col(f"`{id_col}`").alias("id"), k1, k2, text.alias(f"{TMP}t"),
                      F.when(F.octet_length(text) > 0, F.xxhash64(F.lit(3), text)).alias(f"{TMP}raw"))

    def make():
        hasher, sketcher = WordHasher(word_table()), Sketcher()
        return lambda t: sketch_texts(t, hasher, sketcher)

    s = annotate(src, f"{TMP}t", make, FIELDS, "s",
                 ["id", f"{TMP}k1", f"{TMP}k2", f"{TMP}raw"], chunk_bytes=4 << 20)
    return s.select("id", F.col(f"{TMP}k1").alias("k1"), F.col(f"{TMP}k2").alias("k2"),
                    F.coalesce("s.c1", f"{TMP}raw", f"{TMP}k1").alias("c1"),
                    F.col("s.n").alias("n"), F.col("s.sketch").alias("sketch"),
                    F.col("s.words").alias("words"))


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether a banded alignment of two shingle sequences matches enough."""
    total = len(a) + len(b)
    need = int(np.ceil(similarity / (1 + similarity) * total - 1e-9))
    if not total or min(len(a), len(b)) < need:
        return False
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    pre = int(differ[0]) if len(differ) else m
    a, b = a[pre:], b[pre:]
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - m:][::-1] != b[len(b) - m:][::-1])
    post = int(differ[0]) if len(differ) else m
    a, b = a[:len(a) - post], b[:len(b) - post]
    if pre + post >= need:
        return True
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if pre + post + int(np.minimum(ca[ia], cb[ib]).sum()) < need:
        return False
    # longest common subsequence, one bit per place of a, within the band that
    # a sufficient alignment cannot leave
    band = total - 2 * need
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | (1 << i)
    all_ones = (1 << len(a)) - 1
    v, window = all_ones, (1 << (2 * band + 1)) - 1
    for j, x in enumerate(b.tolist()):
        hit = places.get(x)
        if hit is not None:
            u = v & hit & (window << (j - band) if j >= band else window >> (band - j))
            v = ((v + u) | (v - u)) & all_ones
    return pre + post + len(a) - v.bit_count() >= need


def verify_pairs(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) pairs whose texts align; ``words`` is (c1, words)."""
    wa = words.select(F.col("c1").alias("a"), F.col("words").alias("wa"))
    wb = words.select(F.col("c1").alias("b"), F.col("words").alias("wb"))

    def check(batches):
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                if a[i] not in kept:  # partners of one text often follow each other
                    kept = {a[i]: shingles(np.frombuffer(batch.column(2)[i].as_buffer(), np.uint32))}
                other = shingles(np.frombuffer(batch.column(3)[i].as_buffer(), np.uint32))
                ok[i] = aligned(kept[a[i]], other, similarity)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return pairs.join(wa, "a").join(wb, "b").select("a", "b", "wa", "wb") \
                .mapInArrow(check, "a long, b long")


def bucket_links(band: int, node, root, side, sketch, seqs, similarity: float) -> list[tuple]:
    """Links that join different components within one bucket, or between its
    two sides. Pairs that agree in an earlier sketch are left to that bucket.
    The shared shingles of all pairs are counted by a matrix product; only
    pairs that could still be similar are aligned."""
    g, size = len(node), np.array([len(x) for x in seqs])
    lab = [np.unique(labelled(x)) for x in seqs]
    flat, owner = np.concatenate(lab), np.repeat(np.arange(g), size)
    uniq, inv, cnt = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.cumsum(cnt > 1) - 1
    keep = cnt[inv] > 1
    col, owner = common[inv[keep]], owner[keep]
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    shared = np.zeros((g, g), np.float32)
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        i, j = np.searchsorted(col, [lo, lo + 4096])
        m = np.zeros((g, 4096), np.float32)
        m[owner[i:j], col[i:j] - lo] = 1
        shared += m @ m.T
    need = similarity / (1 + similarity) * (size[:, None] + size[None, :]) - 1e-3
    ok = np.triu(shared >= need, 1) & (root[:, None] != root[None, :])
    if side is not None:
        ok &= side[:, None] != side[None, :]
    ia, ib = np.nonzero(ok)
    fresh = ~(sketch[ia, :band] == sketch[ib, :band]).any(1)
    ia, ib = ia[fresh], ib[fresh]
    best = np.argsort(-shared[ia, ib] / need[ia, ib], kind="stable")
    parent: dict = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    links = []
    for i, j in zip(ia[best].tolist(), ib[best].tolist()):
        ra, rb = find(root[i]), find(root[j])
        if ra != rb and aligned(seqs[i], seqs[j], similarity):
            parent[max(ra, rb)] = min(ra, rb)
            links.append((node[i], node[j]))
    return links


def compare_buckets(live: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """Links between the components inside each (band, sig) bucket; ``live`` has
    node, root and m, the size of the bucket. A bucket of more than ``BLOCK``
    members is dealt to pairs of blocks, so that no task holds more than two."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    live = live.withColumn("blocks", blocks).withColumn(
        "x", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks")).cast("int"))
    live = live.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    live = live.select("band", "sig", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"),
                       (F.col("x") > F.col("y")).cast("int").alias("side"), "node", "root")
    rows = live.join(words, F.col("node") == F.col("c1")).drop("c1") \
               .repartition("band", "sig", "i", "j").sortWithinPartitions("band", "sig", "i", "j")
    key = ["band", "sig", "i", "j"]

    def run(batches):
        held, now = [], None

        def links():
            t = pa.Table.from_batches(held)
            if t.num_rows < 2:
                return []
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            seqs = [shingles(np.frombuffer(x.as_buffer(), np.uint32)) for x in t.column("words")]
            sk = np.array(t.column("sketch").to_pylist(), np.int64)
            side = None if i == j else t.column("side").to_numpy()
            return bucket_links(now[0], t.column("node").to_numpy(), t.column("root").to_numpy(),
                                side, sk, seqs, similarity)

        for batch in batches:
            keys = list(zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in key]))
            at = 0
            while at < len(keys):
                to = at
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                if keys[at] != now and held:
                    yield _pairs(links())
                    held = []
                now = keys[at]
                held.append(batch.slice(at, to - at))
                at = to
        if held:
            yield _pairs(links())

    return rows.mapInArrow(run, "a long, b long")


def _pairs(links: list[tuple]) -> pa.RecordBatch:
    a, b = (np.array(x, np.int64) for x in zip(*links)) if links else (np.zeros(0, np.int64),) * 2
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))],
                                      names=["a", "b"])


def join_spread(rows: DataFrame, side: DataFrame, key: str, hot: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with ``side`` (one row per key). The rows of the ``hot``
    keys, fewer than ``HOT_KEYS``, stay where they are."""
    hot = F.broadcast(hot.select(key))
    few = F.broadcast(side.join(hot, key, "left_semi"))
    return rows.join(hot, key, "left_semi").join(few, key, how).unionByName(
        rows.join(hot, key, "left_anti").join(side, key, how))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            similarity: float = SIMILARITY) -> DataFrame:
    """One row per document row: id, k1, k2, n (shingles), class_id (smallest
    id of the class), kept (the one row of the class that stays: the smallest
    id; of rows equal in id and text all are marked, see ``near_dedup``)."""
    rows = materialize(sketch_table(docs, id_col, text_col), "omh-sketch")
    nodes = rows.groupBy("c1").agg(
        F.max("n").alias("n"), F.min(F.struct("k1", "k2")).alias("r"), F.first("sketch").alias("sketch"),
        F.count("*").alias("rows"))
    every = materialize(nodes.select("c1", "n", "r.k1", "r.k2", "sketch", "rows"), "omh-nodes")
    nodes = every.where("n > 0").drop("rows")
    hot_rows = rows.count() / HOT_KEYS

    bands = nodes.select(F.col("c1").alias("node"), "n", F.posexplode("sketch").alias("band", "sig"))
    full = bands.groupBy("band", "sig").agg(F.count("*").alias("m"), F.min("node").alias("low")).where("m > 1")
    members = materialize(bands.join(full.drop("low"), ["band", "sig"])
                          .select("band", "sig", "node", "n"), "omh-members")

    near = F.expr(f"least(n, n_low) >= {similarity} * greatest(n, n_low)")
    used = members.select("node").distinct()
    pick = nodes.join(used, F.col("c1") == F.col("node")).select("c1", "k1", "k2")
    words = rows.join(pick, ["c1", "k1", "k2"]).select("c1", "k1", "k2", "sketch", "words") \
                .dropDuplicates(["c1", "k1", "k2"]).select("c1", "sketch", "words")
    words = materialize(words, "omh-words")

    # every member against the first of its bucket
    lead = members.groupBy("band", "sig").agg(F.min(F.struct("node", "n")).alias("l"), F.count("*").alias("m"))
    pairs = members.join(lead, ["band", "sig"]).withColumn("n_low", F.col("l.n")) \
        .where("node > l.node").where(near).select(F.col("l.node").alias("a"), F.col("node").alias("b"))
    found = verify_pairs(materialize(pairs.distinct(), "omh-pairs"), words, similarity)
    edges = materialize(found, "omh-links")
    # what is left: larger buckets whose members lie in different components
    live = members.join(components(edges, "omh"), "node", "left") \
                  .withColumn("root", F.coalesce("root", "node"))
    live = materialize(live, "omh-live")
    mixed = live.groupBy("band", "sig").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")) \
        .where("hi > lo AND m > 2").select("band", "sig", "m")
    rest = compare_buckets(live.join(mixed, ["band", "sig"]), words, similarity)
    comp = components(edges.unionByName(materialize(rest, "omh-links")), "omh")

    ids = join_spread(rows.select("id", "k1", "k2", "n", "c1"), comp.withColumnRenamed("node", "c1"),
                      "c1", every.where(F.col("rows") > hot_rows), "left")
    ids = materialize(ids.withColumn("root", F.coalesce("root", "c1")).drop("c1"), "omh-ids")
    first = ids.groupBy("root").agg(F.min(F.struct("id", "k1", "k2")).alias("f"),
                                    F.count("*").alias("rows"))
    first = materialize(first, "omh-first")
    return join_spread(ids, first.drop("rows"), "root",
                       first.where(F.col("rows") > hot_rows), "inner").select(
        "id", "k1", "k2", "n", F.col("f.id").alias("class_id"),
        (F.col("id").eqNullSafe(F.col("f.id")) & (F.col("k1") == F.col("f.k1"))
         & (F.col("k2") == F.col("f.k2"))).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, with its own columns: the smallest id, and
    of rows that agree in id and text one. Null ids come first; rows with null
    or empty texts are in a class of their own. Any other column passes."""
    kept = classes(docs, id_col, text_col, similarity).where("kept") \
        .select(F.col("k1").alias(f"{TMP}k1"), F.col("k2").alias(f"{TMP}k2")).distinct()
    # repeated rows go before the shuffle that the join needs, not after it
    keyed = docs.select("*", *row_key(id_col, text_col)).dropDuplicates([f"{TMP}k1", f"{TMP}k2"])
    return keyed.join(kept, [f"{TMP}k1", f"{TMP}k2"], "left_semi").drop(f"{TMP}k1", f"{TMP}k2")
