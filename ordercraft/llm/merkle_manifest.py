"""Merkle manifest of a dataset as a persistent path-copying tree.

Rows are the leaves. Every tree (one per source) is cut into aligned blocks of
16 ** 3 consecutive leaves; a task builds the three levels of a block, the
roots of the blocks are the leaves of the next floor, and so on, so a hot
source is many blocks and no task holds more than one. The roots of the
sources, in order, are the leaves of one last tree. On the way down every
block gets its upper path: the siblings at each level up to the common root.

A changed leaf makes a version of the tree that shares all untouched nodes
and copies only the ancestors of the leaf: three inside its block, the others
along the upper path of the block, which is how a version goes on through the
distributed floors. Versions are independent of each other (each starts from
the unchanged tree), so nothing has to be ordered between them.

A node is the lowercase hex SHA-256 of its children's hex digests; a level is
cut into runs of 16 (the last may be shorter, down to one) while it has more
than one node. Places in a source come from range partitions with counts of
the earlier ones, written to the shared folder, so they are stable.

Null values are marked in the leaf and differ from empty ones; rows without
a source form a source of their own (first), rows without an id come first
in their source. Equal ids are ordered by their leaf; equal rows have equal
leaves, and each has its place. An empty table gives an empty result. Other
columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.fill import number_rows
from .common import TMP, materialize

FAN, FLOOR = 16, 3  # children of a node, levels of a block
BLOCK = FAN ** FLOOR
DIGEST = 32
RANGE_ROWS = 1_000_000  # rows of one range partition

STEP = "array<struct<at: int, siblings: binary>>"


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 (binary) of values, each ``-`` if null, else its bytes' number, ``:`` and the value."""
    parts = []
    for v in values:
        v = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _node(children: bytes) -> bytes:
    return hashlib.sha256(children.hex().encode()).digest()


class Block:
    """Up to BLOCK consecutive nodes and ``depth`` levels above them. Versions
    share everything in it but the ancestors that they copy."""

    def __init__(self, nodes: list[bytes], depth: int):
        self.runs = []  # of each level: the children of each next node, as one string
        for _ in range(depth):
            runs = [b"".join(nodes[i:i + FAN]) for i in range(0, len(nodes), FAN)]
            self.runs.append(runs)
            nodes = [_node(r) for r in runs]
        self.top = nodes

    def steps(self, i: int) -> list[tuple[int, bytes]]:
        """(place in its run, the run's other nodes) at each level above node ``i``."""
        out = []
        for runs in self.runs:
            at, run = i % FAN, runs[i // FAN]
            out.append((at, run[:at * DIGEST] + run[(at + 1) * DIGEST:]))
            i //= FAN
        return out


def copy_path(digest: bytes, steps: list[tuple[int, bytes]]) -> list[bytes]:
    """The copied ancestors, lowest first, of a node that now has ``digest``."""
    out = []
    for at, siblings in steps:
        digest = _node(siblings[:at * DIGEST] + digest + siblings[at * DIGEST:])
        out.append(digest)
    return out


def levels(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    k = 0
    while n > 1:
        n, k = -(-n // FAN), k + 1
    return k


def _number(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Place (from 0) of each written row within ``key``, in column ``pos``."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-rows.count() // RANGE_ROWS))
    out = number_rows(rows, key, order, "pos", hot_keys="all", range_partitions=parts)
    return out.withColumn("pos", F.col("pos") - 1)


def _floor(nodes: DataFrame, carry: list[str], name: str) -> DataFrame:
    """One row per block of ``nodes`` (tree, pos, alone, full and ``carry``):
    tree, block, its nodes in order, the carried columns as lists, and its root
    if it is all of its tree (alone) or one block of many (full)."""
    kinds = {f.name: f.dataType for f in nodes.schema.fields}
    schema = T.StructType([T.StructField("tree", kinds["tree"]), T.StructField("block", T.LongType()),
                           T.StructField("nodes", T.ArrayType(T.BinaryType())),
                           T.StructField("alone", T.BinaryType()), T.StructField("full", T.BinaryType()),
                           *[T.StructField(c, T.ArrayType(kinds[c])) for c in carry]])

    def build(tab: pa.Table) -> pa.Table:
        tab = tab.sort_by("pos").combine_chunks()
        block = tab.column("pos")[0].as_py() // BLOCK
        sole = block == 0 and tab.num_rows == 1  # the only node: its tree is complete below
        digests = tab.column("alone" if sole else "full").to_pylist()
        depth = levels(len(digests))
        low = Block(digests, depth)
        alone, full = low.top[0], low.top[0]
        for _ in range(FLOOR - depth):
            full = _node(full)
        cols = [tab.column("tree").slice(0, 1), [block], [digests], [alone], [full]]
        cols += [[tab.column(c).to_pylist()] for c in carry]
        return pa.table([pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type)
                         for c, f in zip(cols, arrow)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    rows = nodes.select("tree", "pos", "alone", "full", *carry)
    return materialize(rows.groupBy("tree", F.floor(F.col("pos") / BLOCK)).applyInArrow(build, schema), name)


def _tower(nodes: DataFrame, carry: list[str], name: str) -> list[DataFrame]:
    """Floors of blocks until every tree is one block."""
    floors = [_floor(nodes, carry, f"{name}-floor")]
    while (floors[-1].agg(F.max("block")).first()[0] or 0) > 0:
        up = floors[-1].select("tree", F.col("block").alias("pos"), "alone", "full")
        floors.append(_floor(up, [], f"{name}-floor"))
    return floors


def _with_paths(floor: DataFrame, paths: DataFrame) -> DataFrame:
    p = paths.select(F.col("tree").alias("p_tree"), F.col("block").alias("p_block"), "sole", "steps", "root")
    return floor.join(p, F.col("tree").eqNullSafe(F.col("p_tree")) & (F.col("block") == F.col("p_block")))


def _paths(floors: list[DataFrame], lowest: int) -> DataFrame:
    """(tree, block, sole, steps, root) for each block of ``floors[lowest]``: whether it
    is its whole tree, its way up to the tree's root, and that root."""
    paths = floors[-1].select("tree", "block", F.lit(True).alias("sole"),
                              F.lit(None).cast(STEP).alias("steps"), F.col("alone").alias("root"))
    for floor in floors[:lowest:-1]:
        rows = _with_paths(floor, paths).select("tree", "block", "nodes", "sole", "steps", "root")
        schema = T.StructType([floor.schema["tree"], *T.StructType.fromDDL(
            f"block long, sole boolean, steps {STEP}, root binary").fields])
        paths = rows.mapInArrow(_descend(schema), schema)
    return paths


def _descend(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a row is a block
                tree, block, nodes, sole, steps, root = (c[i] for c in batch.columns)
                nodes, first = nodes.as_py(), block.as_py() * BLOCK
                low, above = Block(nodes, levels(len(nodes)) if sole.as_py() else FLOOR), steps.as_py() or []
                n = len(nodes)
                only = n == 1 and first == 0
                ways = [[{"at": a, "siblings": s} for a, s in low.steps(k)] + above for k in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree.as_py()] * n, arrow[0].type), pa.array(range(first, first + n), pa.int64()),
                     pa.array([only] * n, pa.bool_()), pa.array(ways, arrow[3].type),
                     pa.array([root.as_py()] * n, pa.binary())], schema=arrow)
    return run


def manifest(leaves: DataFrame, proofs: bool = False) -> DataFrame:
    """One row per row of ``leaves`` (id, source, leaf, changed: binary digests;
    ``changed`` null where the row is as it was).

    Returns id, source, place (in the source), leaf, subroot, root (hex digests of
    the unchanged trees), proof_sha256 (of the siblings' hex digests from the leaf
    to the root), versioned (the row makes a version of its own), copies (binary: the
    ancestors that this version copies, lowest first, up to its root; for the other
    rows, those recomputed from their leaf) and folded_root, the last of them. With
    ``proofs`` also the proof itself: the place in the run and the siblings per level."""
    rows = materialize(leaves.select(F.col("source").alias("tree"), "id", "leaf", "changed",
                                     F.monotonically_increasing_id().alias("place")), "merkle-leaves")
    placed = _number(rows, "tree", ["id", "leaf", "place"])
    placed = placed.withColumns({"alone": F.col("leaf"), "full": F.col("leaf")})
    floors = _tower(placed, ["id", "changed"], "merkle")
    below = _paths(floors, 0)

    subroots = materialize(below.where("block = 0").select(F.col("tree").alias("source"), "root"), "merkle-subroots")
    placed = _number(subroots.withColumn("tree", F.lit(0)), "tree", ["source"])
    placed = placed.withColumns({"alone": F.col("root"), "full": F.col("root")}).select(
        "tree", "pos", "alone", "full", "source")
    tops = _tower(placed, ["source"], "merkle-top")
    last = _with_paths(tops[0], _paths(tops, 0))
    above = last.mapInArrow(_sources(kind := T.StructType(
        [subroots.schema["source"], *T.StructType.fromDDL(f"up {STEP}, top binary").fields])), kind)

    # the upper paths are one row per block, so they meet the sources before the leaves do
    ways = below.join(above, F.col("tree").eqNullSafe(F.col("source"))).select(
        "tree", "block", "sole", "root", F.concat(F.coalesce("steps", F.array().cast(STEP)), "up").alias("steps"), "top")
    p = ways.select(F.col("tree").alias("p_tree"), F.col("block").alias("p_block"), "sole", "root", "steps", "top")
    blocks = floors[0].join(p, F.col("tree").eqNullSafe(F.col("p_tree")) & (F.col("block") == F.col("p_block")))
    blocks = blocks.select("tree", "block", "id", "nodes", "changed", "sole", "root", "steps", "top")
    out = T.StructType([
        T.StructField("id", floors[0].schema["id"].dataType.elementType),
        T.StructField("source", floors[0].schema["tree"].dataType),
        *T.StructType.fromDDL("place long, leaf string, subroot string, root string, proof_sha256 string, "
                              "versioned boolean, copies array<binary>, folded_root string"
                              + (f", proof {STEP}" if proofs else "")).fields])
    return blocks.mapInArrow(_proofs(out, proofs), out)


def _sources(schema: T.StructType):
    """Blocks of the tree over the sources -> source, its steps to the root, the root."""
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                nodes = r["nodes"]
                low = Block(nodes, levels(len(nodes)) if r["sole"] else FLOOR)
                ways = [[{"at": a, "siblings": s} for a, s in low.steps(k)] + (r["steps"] or [])
                        for k in range(len(nodes))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["source"], arrow[0].type), pa.array(ways, arrow[1].type),
                     pa.array([r["root"]] * len(nodes), pa.binary())], schema=arrow)
    return run


def _proofs(schema: T.StructType, proofs: bool):
    """Blocks of leaves with their upper paths -> one row per leaf."""
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                tree, block, ids, nodes, changed, sole, subroot, steps, top = (c[i] for c in batch.columns)
                nodes, changed, first = nodes.as_py(), changed.as_py(), block.as_py() * BLOCK
                n = len(nodes)
                low = Block(nodes, levels(n) if sole.as_py() else FLOOR)
                above = [(s["at"], s["siblings"]) for s in steps.as_py()]
                above_hex = b"".join(s for _, s in above).hex().encode()
                digests, copies, ways = [], [], []
                for k in range(n):
                    own = low.steps(k)
                    proof = hashlib.sha256(b"".join(s for _, s in own).hex().encode())
                    proof.update(above_hex)
                    digests.append(proof.hexdigest())
                    leaf = nodes[k] if changed[k] is None else changed[k]
                    copies.append(copy_path(leaf, own + above))
                    if proofs:
                        ways.append([{"at": a, "siblings": s} for a, s in own + above])
                folded = [(c[-1] if c else (nodes[k] if changed[k] is None else changed[k])).hex()
                          for k, c in enumerate(copies)]
                cols = [ids.values, [tree.as_py()] * n, range(first, first + n), [x.hex() for x in nodes],
                        [subroot.as_py().hex()] * n, [top.as_py().hex()] * n, digests,
                        [c is not None for c in changed], copies, folded] + ([ways] if proofs else [])
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)
    return run
