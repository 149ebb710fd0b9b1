"""Shared pieces: text batches, word hashing, scratch tables, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bounded_side, checkpoint_root

TMP = "__oc_"  # prefix of internal columns, so that users' names never clash
CHUNK_BYTES = 8 << 20  # text bytes that a Python worker handles at once

_U = np.uint64
_P = _U(0x9E3779B97F4A7C55)  # odd, so it has an inverse modulo 2**64
_PINV = _U(pow(int(_P), -1, 1 << 64))


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back. A table
    cuts the lineage and survives the loss of the executors that made it."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (null id: the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % mod


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two 64-bit hashes of (id, text): equal for repeated rows only."""
    a, b = F.col(id_col), F.col(text_col)
    return [F.xxhash64(F.lit(1), a.isNull(), a, b.isNull(), b).alias(f"{TMP}k1"),
            F.xxhash64(F.lit(2), b, b.isNull(), a, a.isNull()).alias(f"{TMP}k2")]


# ---------------------------------------------------------------- text batches

def text_chunks(batches: Iterator[pa.RecordBatch], text_col: int | str,
                chunk_bytes: int) -> Iterator[pa.Table]:
    """Rows regrouped so that each table holds about ``chunk_bytes`` of text
    (a longer text has a table of its own); nothing is cut."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = lengths_of(batch.column(text_col))
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            k = int(np.searchsorted(ends, base + chunk_bytes - size, "left")) + 1
            k = min(max(k, at + 1), batch.num_rows)
            held.append(batch.slice(at, k - at))
            size += int(ends[k - 1] - base)
            at = k
            if size >= chunk_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def lengths_of(arr: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc
    return pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def flat_text(arr: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets per row) of a string column; null is empty."""
    import pyarrow.compute as pc
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    arr = pc.fill_null(arr, "")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type)
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1]
    off = off.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def annotate(df: DataFrame, text_col: str, make: Callable, fields: str, out: str,
             keep: list[str] | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``df`` (or its ``keep`` columns) with a struct column ``out`` computed
    from the whole texts. ``make()`` is called once per task and returns a
    function from a string array to one array per field. A column that is
    already called ``out`` is replaced."""
    names = [c for c in (df.columns if keep is None else keep) if c.lower() != out.lower()]
    cols = [F.col(f"`{c}`") for c in names]
    at, n = names.index(text_col) if text_col in names else len(names), len(names)
    if at == n:
        cols.append(F.col(f"`{text_col}`").alias(f"{TMP}text"))
    src = df.select(*cols)
    struct = T.StructType.fromDDL(fields)
    schema = T.StructType([*src.schema.fields[:n], T.StructField(out, struct)])
    field_names = struct.fieldNames()

    def run(batches):
        work = make()
        for tab in text_chunks(batches, at, chunk_bytes):
            arrays = [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)
                      for c in tab.columns]
            value = pa.StructArray.from_arrays(work(arrays[at]), names=field_names)
            yield pa.RecordBatch.from_arrays([*arrays[:n], value], names=[*names, out])

    return src.mapInArrow(run, schema)


def spill_lists(values: np.ndarray, counts: np.ndarray, kind=None) -> pa.Array:
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))


# ---------------------------------------------------------------- bounded samples

SHARE = 64  # a text counts for at most 1 / SHARE of its language's bound while that fills the bound
SPARE = 4  # candidates: so many times the bound, by expectation
MAX_BROADCAST = 10_000  # languages whose bounds are broadcast


def text_hash(text: Column) -> Column:
    """The hash by which texts are told apart and drawn."""
    return F.xxhash64(F.lit(7), text)


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def language_sample(rows: DataFrame, name: str, sample_bytes: int, run: int, cut: Callable,
                    sample_rows: int | None = None, total_bytes: int | None = None,
                    keys: DataFrame | None = None) -> DataFrame:
    """(lang, piece): a training sample of ``rows`` (lang, text; no nulls), filled for
    each language by itself to ``sample_bytes`` (and ``sample_rows`` texts at most).

    Distinct texts are taken in hash order until the bound is reached; copies count
    once. A text counts for at most 1 / SHARE of the bound; in a language that does
    not fill the bound so, this share doubles until it does, and all its texts are
    taken (up to twice the bound). A text above its share gives runs of ``run``
    bytes that are spread evenly over the whole text. ``cut(raw, start, stop)`` is
    the piece (bytes) for such a run. ``total_bytes``: with more languages than it
    holds bounds, every language's bound is an equal part of it.

    The running sums go over candidates by hash, SPARE times the bound, so that
    they are bounded too; these hold less than the bound with less than
    exp(-72), and are then taken whole. ``keys`` (lang, h, b: hash and bytes): the
    texts to choose from, if not all of ``rows``; only those chosen are fetched."""
    h = text_hash(F.col("text"))
    texts = rows.select("lang", h.alias("h"), F.octet_length("text").cast("long").alias("b")) if keys is None else keys
    texts = texts.where("b > 0")
    texts = materialize(texts.groupBy("lang", "h").agg(F.max("b").alias("b")), f"{name}-texts")
    if total_bytes is not None:
        sample_bytes = max(min(sample_bytes, total_bytes // max(texts.select("lang").distinct().count(), 1)), 1)
    caps = [max(sample_bytes // SHARE, 1)]
    while caps[-1] < sample_bytes:
        caps.append(min(2 * caps[-1], sample_bytes))
    limit = sample_rows if sample_rows is not None else (1 << 62)
    sizes = texts.groupBy("lang").agg(F.count("*").alias("n"), *[
        F.sum(F.least("b", F.lit(c)).cast("double")).alias(f"s{i}") for i, c in enumerate(caps)])
    cap = F.lit(caps[-1])
    for i, c in reversed(list(enumerate(caps))):
        cap = F.when((F.col(f"s{i}") >= sample_bytes) | (F.col("n") > limit), c).otherwise(cap)
    full = (F.col("n") > limit) | (F.col("s0") > sample_bytes)
    rate = SPARE * F.least(sample_bytes / F.col("s0"), F.lit(float(max(limit, SHARE))) / F.col("n"))
    sizes = small(materialize(sizes.select(F.col("lang").alias("l"), cap.cast("long").alias("cap"), full.alias("full"),
                                           F.when(full, rate).otherwise(1.0).alias("rate")), f"{name}-sizes"))
    place = F.col("h") / float(1 << 64) + 0.5
    near = texts.join(sizes, F.col("lang") == F.col("l")).where(F.col("full") & (place < F.col("rate")))
    order = Window.partitionBy("lang").orderBy("h")
    near = near.select("lang", "h", F.row_number().over(order).alias("k"),
                       F.sum(F.least("b", "cap")).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("s"))
    last = near.where((F.col("k") <= limit) & (F.coalesce("s", F.lit(0)) < sample_bytes)) \
               .groupBy(F.col("lang").alias("m")).agg(F.max("h").alias("last"))
    bounds = sizes.join(last, F.col("l") == F.col("m"), "left") \
                  .select("l", "cap", F.coalesce("last", F.lit((1 << 63) - 1)).alias("last"))
    bounds = small(materialize(bounds, f"{name}-bounds"))
    if keys is None:
        picked = rows.withColumn("h", h).join(bounds, F.col("lang") == F.col("l")).where("h <= last")
    else:  # bounded by the sample
        chosen = texts.join(bounds, F.col("lang") == F.col("l")).where("h <= last") \
                      .select(F.col("l"), F.col("h").alias("chosen"), "cap")
        picked = rows.withColumn("h", h).join(bounded_side(chosen, f"{name}-chosen"),
                                              (F.col("lang") == F.col("l")) & (F.col("h") == F.col("chosen")))

    def pieces(batches):
        seen = set()
        for batch in batches:
            lang, key, cap, text = (batch.column(i) for i in range(4))
            out = []
            for i, at in enumerate(zip(lang.to_pylist(), key.to_pylist())):
                if at in seen:
                    continue
                seen.add(at)
                raw, most = flat_text(text.slice(i, 1))[0], cap[i].as_py()
                if len(raw) <= most:
                    out.append((*at, 0, cut(raw, 0, len(raw))))
                    continue
                size = min(run, most)
                starts = np.linspace(0, len(raw) - size, max(most // size, 1)).astype(np.int64)
                out += [(*at, j, cut(raw, int(x), int(x) + size)) for j, x in enumerate(starts)]
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
                     pa.array(cols[3], pa.binary())], names=["lang", "h", "part", "piece"])

    return picked.select("lang", "h", "cap", "text").mapInArrow(pieces, "lang string, h long, part int, piece binary") \
                 .groupBy("lang", "h", "part").agg(F.max("piece").alias("piece")) \
                 .where(F.octet_length("piece") > 0).select("lang", "piece")


# ---------------------------------------------------------------- word hashing

class WordHasher:
    """Start, end and 64-bit hash of each word of a byte string, by array
    operations: a word is a run of bytes that ``table`` does not map to 0.
    The hash is a polynomial modulo 2**64 over the mapped bytes, then mixed."""

    def __init__(self, table: np.ndarray, piece: int = 1 << 20):
        self.table, self.piece = table, piece
        self.pow = self.inv = np.zeros(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.pow) < n + 1:
            with np.errstate(over="ignore"):
                one = np.ones(n + 1, np.uint64)
                one[1:] = _P
                self.pow = np.cumprod(one, dtype=np.uint64)
                one[1:] = _PINV
                self.inv = np.cumprod(one, dtype=np.uint64)

    def __call__(self, raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of each word, hash of each word); ``cuts`` are row offsets."""
        rows, hashes, at, n = [], [], 0, len(raw)
        while at < n:
            to = min(n, at + self.piece)
            if to < n:  # end the piece where a row or a word ends
                nxt = cuts[np.searchsorted(cuts, to)]
                stop = to
                while stop < nxt:
                    sep = np.flatnonzero(self.table[raw[stop:min(stop + 65536, nxt)]] == 0)
                    if len(sep):
                        stop += int(sep[0])
                        break
                    stop = min(stop + 65536, nxt)
                to = stop
            r, h = self._piece(raw[at:to], cuts, at)
            rows.append(r)
            hashes.append(h)
            at = to
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(rows), np.concatenate(hashes)

    def _piece(self, raw, cuts, at):
        m = self.table[raw]
        word = m != 0
        edge = np.empty(len(m) + 1, bool)
        edge[0], edge[-1] = len(m) > 0 and word[0], False
        edge[1:-1] = word[1:] & ~word[:-1]
        lo, hi = np.searchsorted(cuts, [at, at + len(m)])
        inner = cuts[lo:hi] - at  # a row that starts inside a run starts a word
        inner = inner[(inner >= 0) & (inner < len(m))]
        edge[inner] |= word[inner]
        start = np.flatnonzero(edge)
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        stops = np.append(np.flatnonzero(~word), len(m))
        end = stops[np.searchsorted(stops, start)]
        end = np.minimum(end, np.append(start[1:], len(m)))
        self._powers(len(m))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(m) + 1, np.uint64)
            np.cumsum(m.astype(np.uint64) * self.pow[:len(m)], out=sums[1:])
            h = mix((sums[end] - sums[start]) * self.inv[start])
        return np.searchsorted(cuts, start + at, "right") - 1, h


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def word_table() -> np.ndarray:
    """Words are runs of a-z (after lower-casing A-Z), 0-9 and bytes >= 0x80."""
    t = lower_table()
    keep = np.zeros(256, bool)
    keep[48:58] = keep[65:91] = keep[97:123] = keep[128:] = True
    t[~keep] = 0
    return t


def space_table() -> np.ndarray:
    """Words are runs without space, tab, newline, VT, FF, CR; NUL is a word byte."""
    t = lower_table()
    t[0] = 255  # never occurs in UTF-8, so it can stand for NUL
    t[[32, 9, 10, 11, 12, 13]] = 0
    return t


# ---------------------------------------------------------------- components

def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): connected components of (a, b) edges, root = smallest node.

    Alternating large-star and small-star steps over the edge table; each
    round is written to the shared folder, and only one checksum row reaches
    the driver. The rounds grow with the logarithm of the component size."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) \
             .where("a < b").distinct()
    e = materialize(e, f"{name}-edges")

    def sign(d):
        r = d.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"),
                  F.sum(F.xxhash64("b", "a") % 1000003).alias("s")).first()
        return tuple(r)

    last = sign(e)
    while last[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")) \
                  .select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).where("b > a") \
                    .select(F.col("m").alias("a"), "b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "u")
        small = large.join(low, F.col("b") == F.col("u"))
        small = small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        e = materialize(small.where("a < b").distinct(), f"{name}-round")
        now = sign(e)
        if now == last:
            break
        last = now
    return e.select(F.col("b").alias("node"), F.col("a").alias("root"))
