"""Prefix trie of conversations with subtree totals by parallel tree contraction.

A turn is hashed where it is read; only hashes and lengths are shuffled. The
key of a prefix is the sum, modulo 2 ** 48 and twice with different seeds, of
the hashes of its turns with their places, so it comes from running sums over
bounded chunks of a conversation (two different prefixes of one depth share
both sums with 2 ** -96). One aggregate over the prefixes gives the nodes; a
node is named by its smallest member and its depth.

Totals over subtrees: rounds of *rake* (every leaf adds its total to its
parent and goes) and *compress* (every run of nodes with a single child is
spliced out; the run's weight moves to the node above it, and the node below
it is attached there) until the root is raked. Nodes with the same smallest
member form one downward path, so runs are found by windows over aligned
blocks of depths of a path, which grow from round to round; no task holds a
whole long conversation, and a chain on one path takes two or three rounds
whatever its length. Chains that go from path to path are shortened by joins
of neighbours under a coin, in the rounds after one that has left more than half of its
nodes; so the rounds grow with the logarithm of the trie. Then the rounds
are undone in reverse: a spliced node's total is the weight of its run from
it downwards plus the total of the node below the run. Every round is a
written table.

Rows without a conversation id belong to no conversation and are left out.
Turns are ordered by turn (null first), equal ones by their hash; repeated
rows are turns of their own. Null role and text count as empty. An empty
table has no nodes. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.fill import number_rows
from .common import materialize

CHUNK = 4096  # turns of a conversation in one running sum, depths of the first blocks
GROWTH = 16  # of the blocks of depths from round to round
MASK = (1 << 48) - 1
RANGE_ROWS = 1_000_000
ID_BLOCK = 65_536  # conversation ids whose list is put together as one text

HEAD = 9  # a rebuilt conversation takes fewer than this many turns of another
FAMILY = 5  # conversations that share the first turns of one


def turn_rows(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """(conv, pos, t1, t2, bytes): place from 1, two hashes and the text's UTF-8 bytes."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.xxhash64(F.lit(1), r, t).alias("t1"),
        F.xxhash64(F.lit(2), t, r).alias("t2"), F.octet_length(t).cast("long").alias("bytes"))
    rows = materialize(rows.withColumn("place", F.monotonically_increasing_id()), "trie-turns")
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = number_rows(rows, "conv", ["turn", "t1", "t2", "place"], "pos", hot_keys="all",
                         range_partitions=max(least, -(-rows.count() // RANGE_ROWS)))
    return materialize(placed.select("conv", "pos", "t1", "t2", "bytes"), "trie-places")


def lengths(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv").agg(F.count("*").alias("n"))


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as their family's shared start and their own rest: turns of
    conv c are the first h of c - c % FAMILY, then its own after the first h, with
    h = crc32(c) % HEAD. Returns (turns with the rebuilt length ``n``, conversations
    (conv, n), the ones without turns too)."""
    own = lengths(turns)
    h = F.crc32(F.col("conv").cast("string")) % HEAD
    first = own.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = own.withColumns({"h": h, "b": F.col("conv") - F.col("conv") % FAMILY})
    convs = convs.join(first, F.col("b") == F.col("base"), "left")
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = materialize(convs.select("conv", "b", "h", taken.alias("taken"),
                                     (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), "trie-convs")
    heads = turns.where((F.col("pos") < HEAD) & (F.col("conv") % FAMILY == 0)).withColumnRenamed("conv", "base")
    shared = convs.join(heads, (F.col("b") == F.col("base")) & (F.col("pos") <= F.col("h"))) \
                  .select("conv", "pos", "t1", "t2", "bytes", "n")
    rest = turns.withColumnRenamed("conv", "c").join(convs, F.col("c") == F.col("conv")).where("pos > h") \
                .select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "t1", "t2", "bytes", "n")
    return shared.unionByName(rest), convs.select("conv", "n")


def _prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` with the key (k1, k2) of the prefix that ends at each, and its parent's (p1, p2)."""
    add = {f"a{i}": F.xxhash64(F.lit(i), "t1", "t2", "pos").bitwiseAND(MASK) for i in (1, 2)}
    rows = turns.withColumns({**add, "chunk": F.floor((F.col("pos") - 1) / CHUNK)})
    rows = materialize(rows.select("conv", "pos", "chunk", "bytes", "n", "a1", "a2"), "trie-rebuilt")
    sums = rows.groupBy("conv", "chunk").agg(*[F.sum(f"a{i}").bitwiseAND(MASK).alias(f"s{i}") for i in (1, 2)])
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("conv").alias("c"), F.col("chunk").alias("ch"),
                          *[F.sum(f"s{i}").over(before).bitwiseAND(MASK).alias(f"o{i}") for i in (1, 2)]).where("ch > 0")
    inside = Window.partitionBy("conv", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumns({f"r{i}": F.sum(f"a{i}").over(inside) for i in (1, 2)})
    run = run.join(offsets, (F.col("conv") == F.col("c")) & (F.col("chunk") == F.col("ch")), "left")
    key = {f"k{i}": (F.col(f"r{i}") + F.coalesce(f"o{i}", F.lit(0))).bitwiseAND(MASK) for i in (1, 2)}
    run = run.withColumns(key).withColumns({f"p{i}": (F.col(f"k{i}") - F.col(f"a{i}")).bitwiseAND(MASK) for i in (1, 2)})
    return run.select("conv", F.col("pos").alias("depth"), "n", "bytes", "k1", "k2", "p1", "p2")


def _list_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): digest of the ascending ids of ``ends`` per node.
    The lists are put together in blocks of ids; a digest reads one list's blocks
    in order, one at a time."""
    key = ["depth", "k1", "k2"]
    ids = F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",")
    pieces = ends.groupBy(*key, F.floor(F.col("conv") / ID_BLOCK).alias("block")).agg(ids.alias("ids"))
    ordered = pieces.repartition(*key).sortWithinPartitions(*key, "block")

    def digest(batches):
        at, sha, done = None, None, []
        for batch in batches:
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids"))):
                if node != at:
                    if at is not None:
                        done.append((*at, sha.hexdigest()))
                    at, sha = node, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            if len(done) >= 10_000:
                yield rows_of(done)
                done = []
        if at is not None:
            done.append((*at, sha.hexdigest()))
        if done:
            yield rows_of(done)

    def rows_of(done):
        cols = list(zip(*done))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                                          names=[*key, "ends_sha256"])

    return ordered.select(*key, "ids").mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie of ``turns`` (conv, pos, t1, t2, bytes, n) over all conversations
    ``convs`` (conv, n: its number of turns): one row per node with conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (both
    summed over the subtree) and ends_sha256."""
    prefixes = materialize(_prefixes(turns), "trie-prefixes")
    nodes = prefixes.groupBy("depth", "k1", "k2").agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv", "n_convs", zero.alias("bytes"),
        F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    nodes = materialize(nodes.unionByName(root), "trie-nodes")
    ends = prefixes.where("depth = n").select("depth", "k1", "k2", "conv").unionByName(
        convs.where("n = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv"))
    digests = _list_digests(ends).toDF("e_depth", "e1", "e2", "ends_sha256")
    above = nodes.select(F.col("depth").alias("u_depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"),
                         F.col("conv").alias("parent"))
    nodes = nodes.join(above, (F.col("depth") - 1 == F.col("u_depth")) & (F.col("p1") == F.col("u1"))
                       & (F.col("p2") == F.col("u2")), "left")
    nodes = nodes.join(digests, (F.col("depth") == F.col("e_depth")) & (F.col("k1") == F.col("e1"))
                       & (F.col("k2") == F.col("e2")), "left")
    nodes = materialize(nodes.select("conv", "depth", "parent", "n_convs", "bytes",
                                     F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")),
                        "trie-named")
    kids = nodes.groupBy(F.col("parent").alias("k_conv"), (F.col("depth") - 1).alias("k_depth")).agg(F.count("*").alias("kids"))
    state = nodes.join(kids, (F.col("conv") == F.col("k_conv")) & (F.col("depth") == F.col("k_depth")), "left") \
                 .withColumn("kids", F.coalesce("kids", F.lit(0)))
    state = materialize(state, "trie-state")
    totals = contract(state.select("conv", "depth", "parent", (F.col("depth") - 1).alias("parent_depth"), "kids",
                                   (F.col("kids") == 0).cast("long").alias("w1"),
                                   ((F.col("n_convs") - 1) * F.col("bytes")).alias("w2")))
    totals = totals.select(F.col("conv").alias("t_conv"), F.col("depth").alias("t_depth"), "w1", "w2")
    out = state.join(totals, (F.col("conv") == F.col("t_conv")) & (F.col("depth") == F.col("t_depth")))
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs",
                      F.col("kids").alias("n_children"), F.col("w1").alias("n_leaves"),
                      F.col("w2").alias("saved_tokens"), "ends_sha256")


# ---------------------------------------------------------------- contraction

NODE = ["conv", "depth", "parent", "parent_depth", "kids", "w1", "w2"]


def contract(state: DataFrame) -> DataFrame:
    """Subtree totals (conv, depth, w1, w2) of the weights w1 and w2 of ``state``
    (conv, depth, parent, parent_depth, kids, w1, w2), one row per node."""
    rounds, moved, block, turn = [], None, CHUNK, 0
    active, raked, before, slow = state, [], state.count(), False
    while before:
        leaf = F.col("kids") == 0
        raked.append(active.where(leaf).select("conv", "depth", "w1", "w2"))
        inner = _rake(active, moved)
        if slow:
            table, turn, slow = materialize(_mate(materialize(inner, "trie-raked"), turn), "trie-round"), turn + 1, False
            left, spliced = table.agg(F.count_if(~F.col("spliced")), F.count_if("spliced")).first()
        else:
            table = materialize(_compress(inner, block), "trie-round")
            left, spliced = table.agg(F.count_if(~F.col("spliced")), F.count_if("spliced")).first()
            block, slow = min(block * GROWTH, 1 << 60), 2 * left > before
        if spliced:
            rounds.append(table.where("spliced").select("conv", "depth", "below_conv", "below", "w1", "w2"))
        active, before = table.where(~F.col("spliced")).select(*NODE), left
        moved = table.where("not spliced and m1 is not null").select(
            "parent", "parent_depth", F.col("m1").alias("w1"), F.col("m2").alias("w2"), F.lit(0).cast("long").alias("kids"))
    if not raked:
        return state.select("conv", "depth", "w1", "w2")
    known = raked[0]
    for r in raked[1:]:
        known = known.unionByName(r)
    for gone in reversed(rounds):
        known = known.unionByName(materialize(_expand(gone, known), "trie-expanded"))
    return known


def _rake(active: DataFrame, moved: DataFrame | None) -> DataFrame:
    """The nodes that are no leaves, with the totals of their leaves (and the weights
    of spliced runs, from the round before) added and one child less for each leaf."""
    given = active.where("kids = 0").select("parent", "parent_depth", "w1", "w2", F.lit(1).cast("long").alias("kids"))
    given = given.unionByName(moved) if moved is not None else given
    given = given.groupBy(F.col("parent").alias("g_conv"), F.col("parent_depth").alias("g_depth")).agg(
        *[F.sum(c).alias(f"g_{c}") for c in ("w1", "w2", "kids")])
    left = active.where("kids > 0").join(
        given, (F.col("conv") == F.col("g_conv")) & (F.col("depth") == F.col("g_depth")), "left")
    none = F.lit(0).cast("long")
    return left.select("conv", "depth", "parent", "parent_depth", *[
        (F.col(c) + s * F.coalesce(f"g_{c}", none)).alias(c) for c, s in (("kids", -1), ("w1", 1), ("w2", 1))])


def _compress(left: DataFrame, block: int) -> DataFrame:
    """``left`` with ``spliced``: the node below is its only child, of the same path
    and block. For these: ``below`` (depth of the node below the run), and w1 and w2
    from the node to the end of its run. The node below a run has the parent of the
    run, and m1 and m2: the run's weight, for that parent."""
    path = Window.partitionBy("conv", "block").orderBy("depth")
    rows = left.withColumn("block", F.floor(F.col("depth") / F.lit(block)))
    only = (F.col("depth") > 0) & (F.col("kids") == 1) & (F.lead("parent").over(path) == F.col("conv")) \
        & (F.lead("parent_depth").over(path) == F.col("depth"))
    rows = rows.withColumn("spliced", F.coalesce(only, F.lit(False)))
    rows = rows.withColumn("run", F.coalesce(F.sum((~F.col("spliced")).cast("long")).over(
        path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = Window.partitionBy("conv", "block", "run").orderBy("depth")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    down = run.rowsBetween(Window.currentRow, Window.unboundedFollowing)

    def weight(c: str, frame) -> Column:
        return F.sum(F.when(F.col("spliced"), F.col(c))).over(frame)

    return rows.select(
        "conv", "depth", F.first("parent").over(whole).alias("parent"),
        F.first("parent_depth").over(whole).alias("parent_depth"), "kids", "spliced",
        F.col("conv").alias("below_conv"), F.max("depth").over(whole).alias("below"),
        *[F.when(F.col("spliced"), weight(c, down)).otherwise(F.col(c)).alias(c) for c in ("w1", "w2")],
        *[F.when(~F.col("spliced"), weight(c, whole)).alias(f"m{c[1]}") for c in ("w1", "w2")])


def _mate(left: DataFrame, turn: int) -> DataFrame:
    """As ``_compress``, for runs of nodes with a single child that go from path to
    path: of such a node and the node below it the upper one is spliced out when
    its coin shows heads and the lower one will stay, so no two neighbours go."""
    def single(d: str) -> Column:
        return (F.col(f"{d}kids") == 1) & F.col(f"{d}parent").isNotNull() & (
            F.xxhash64(F.lit(turn), F.col(f"{d}conv"), F.col(f"{d}depth")) % 2 == 0)

    above = left.select(*[F.col(c).alias(f"v_{c}") for c in NODE]).where(single("v_"))
    pairs = left.join(above, (F.col("parent") == F.col("v_conv")) & (F.col("parent_depth") == F.col("v_depth")) & ~(
        F.coalesce(single(""), F.lit(False))), "left")
    pairs = materialize(pairs, "trie-mates")
    goes = F.col("v_conv").isNotNull()
    none = F.lit(None).cast("long")
    gone = pairs.where(goes).select(
        F.col("v_conv").alias("conv"), F.col("v_depth").alias("depth"), F.col("v_parent").alias("parent"),
        F.col("v_parent_depth").alias("parent_depth"), F.col("v_kids").alias("kids"), F.lit(True).alias("spliced"),
        F.col("conv").alias("below_conv"), F.col("depth").alias("below"), F.col("v_w1").alias("w1"),
        F.col("v_w2").alias("w2"), none.alias("m1"), none.alias("m2"))
    stay = pairs.select(
        "conv", "depth", F.when(goes, F.col("v_parent")).otherwise(F.col("parent")).alias("parent"),
        F.when(goes, F.col("v_parent_depth")).otherwise(F.col("parent_depth")).alias("parent_depth"), "kids",
        F.lit(False).alias("spliced"), none.alias("below_conv"), none.alias("below"), "w1", "w2",
        F.col("v_w1").alias("m1"), F.col("v_w2").alias("m2")).join(gone.select("conv", "depth"), ["conv", "depth"], "left_anti")
    return stay.unionByName(gone)


def _expand(gone: DataFrame, known: DataFrame) -> DataFrame:
    """Totals of the nodes that one round has spliced out."""
    k = known.select(F.col("conv").alias("k_conv"), F.col("depth").alias("k_depth"),
                     F.col("w1").alias("k1"), F.col("w2").alias("k2"))
    return gone.join(k, (F.col("below_conv") == F.col("k_conv")) & (F.col("below") == F.col("k_depth"))).select(
        "conv", "depth", (F.col("w1") + F.col("k1")).alias("w1"), (F.col("w2") + F.col("k2")).alias("w2"))
