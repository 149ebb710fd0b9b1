"""Language-model scores from sharded Elias-Fano n-gram tries.

The corpus is cut into batches of a few MB of text; a batch stores its
documents as numbers into its own vocabulary (one table in the shared folder).
Each batch sends its distinct word pairs with their training counts to the
shard of their first word, a few bytes a pair. A shard adds the counts up and
builds a trie of two levels: the contexts, and for each context its
successors. Contexts, the pointers into the successors and the successors
themselves are monotone sequences in Elias-Fano code, the smoothed
probabilities are 16-bit logarithms; the levels lie in one file that is mapped
into memory. The high bits are unpacked on load (8 bytes and more an element), so
only the stored form is compact. The shard answers every pair of every batch by a successor
search relative to its context, and sends back the codes, the context's count
and its number of successors. The batches then add up their documents.

Model: p(w | v) = max(c(vw) - D, 0) / c(v) + D * n1+(v) / c(v) * p1(w), with
p1(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)); an unseen context gives p1.

Frequent contexts (at least one shard's share of all training tokens, and the
start of a text) are spread over all shards by their successors; a batch asks a
shard only for the pairs it owns, and the shards' parts of those contexts'
counts are added up once for all batches. They are found from the word counts
of the batches, where a batch leaves out only what cannot matter in sum.
Words are 64-bit hashes, successors 40-bit hashes within their context (of n
successors about n^2 / 2^41 collide).
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHasher, flat_text, materialize, space_table, text_chunks

BATCH_BYTES = 5 << 20  # text in a batch
SHARD_BYTES = 8 << 20  # text per shard: their number follows the corpus
DISCOUNT = 0.75
HEAVY, HEAVY_MOST = 512, 1 << 20  # a context above 1 / (number of shards, within these) of the tokens is spread
BOS, EOS = 1, 2  # hashes of the start and the end of a text
SUCC = 40  # bits of a successor
SCALE, LOWEST = 5000.0, -12.0  # quantisation of log10 probabilities


class EliasFano:
    """A sorted sequence of 64-bit numbers: low bits packed, high bits in unary."""

    @staticmethod
    def encode(values: np.ndarray) -> dict:
        n = len(values)
        top = int(values[-1]) if n else 0
        low = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        packed = []
        for i in range(0, n, 1 << 18):
            part = values[i:i + (1 << 18)]
            bits = (part[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
            packed.append(bits.astype(np.uint8).ravel())
        flat = np.concatenate(packed) if packed else np.zeros(0, np.uint8)
        high = (values >> np.uint64(low)).astype(np.int64)
        unary = np.zeros(n + (int(high[-1]) if n else 0) + 1, np.uint8)
        unary[high + np.arange(n)] = 1
        return {"n": n, "low": low, "lows": np.concatenate(
            [np.packbits(flat, bitorder="little"), np.zeros(8, np.uint8)]),
            "highs": np.packbits(unary, bitorder="little"), "unary": len(unary)}

    def __init__(self, meta: dict, lows: np.ndarray, highs: np.ndarray):
        self.n, self.low, self.lows = meta["n"], meta["low"], lows
        bits = np.unpackbits(highs, bitorder="little")[:meta["unary"]]
        zeros = np.flatnonzero(bits == 0)
        self.ends = np.append(zeros - np.arange(len(zeros)), self.n)  # elements with high <= h
        self.ones = np.flatnonzero(bits)

    def lows_at(self, i: np.ndarray) -> np.ndarray:
        if self.low == 0:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.int64) * self.low
        view = np.lib.stride_tricks.as_strided(self.lows, (len(self.lows) - 7, 8), (1, 1))
        word = np.ascontiguousarray(view[bit >> 3]).view("<u8")[:, 0]
        return (word >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        high = (self.ones[i] - i).astype(np.uint64)
        return (high << np.uint64(self.low)) | self.lows_at(i)

    def find(self, x: np.ndarray, lo: np.ndarray | int = 0, hi: np.ndarray | None = None) -> np.ndarray:
        """Place of each x (within [lo, hi)), or -1: the successor of x is
        searched among the elements that share its high bits."""
        h = np.minimum(x >> np.uint64(self.low), np.uint64(len(self.ends))).astype(np.int64)
        last = len(self.ends) - 1
        a = np.where(h > 0, self.ends[np.minimum(np.maximum(h - 1, 0), last)], 0)
        b = np.where(h <= last, self.ends[np.minimum(h, last)], a)
        a, b = np.maximum(a, lo), b if hi is None else np.minimum(b, hi)
        end, want = b.copy(), x & np.uint64((1 << self.low) - 1)
        while True:
            at = np.flatnonzero(a < b)
            if not len(at):
                break
            mid = (a[at] + b[at]) >> 1
            less = self.lows_at(mid) < want[at]
            a[at] = np.where(less, mid + 1, a[at])
            b[at] = np.where(less, b[at], mid)
        hit = a < end
        hit[hit] = self.lows_at(a[hit]) == want[hit]
        return np.where(hit, a, -1)


class Trie:
    """Two levels in one memory-mapped file."""

    def __init__(self, contexts: np.ndarray, first: np.ndarray, keys: np.ndarray, counts: np.ndarray,
                 discount: float):
        """contexts: sorted hashes; first: start of each one's successors; keys:
        context number and successor, sorted; counts per key."""
        self.total = np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
        self.kinds = np.diff(np.append(first, len(keys)))
        own = np.repeat(np.arange(len(first)), self.kinds)
        prob = np.maximum(counts - discount, 1e-12) / self.total[own]
        codes = np.clip(np.rint((np.log10(prob) - LOWEST) * SCALE), 0, 65534).astype(np.uint16) + 1
        parts = [EliasFano.encode(x.astype(np.uint64)) for x in (contexts, first, keys)]
        self.file = tempfile.TemporaryFile()  # nameless: it goes with the task
        spans, at = [], 0
        for block in [b for p in parts for b in (p.pop("lows"), p.pop("highs"))] + [codes.view(np.uint8)]:
            self.file.write(block.tobytes())
            spans.append((at, len(block)))
            at += len(block)
        self.file.flush()
        mem = np.memmap(self.file, np.uint8, "r", shape=(at,)) if at else np.zeros(0, np.uint8)
        view = [mem[a:a + n] for a, n in spans]
        self.contexts, self.first, self.keys = (
            EliasFano(p, view[2 * i], view[2 * i + 1]) for i, p in enumerate(parts))
        self.codes = np.frombuffer(view[6], np.uint16) if len(view[6]) else np.zeros(0, np.uint16)
        self.bytes = at

    def lookup(self, contexts: np.ndarray, n_succ: np.ndarray, succ: np.ndarray):
        """(codes per successor, 0 if unseen; count and kinds per context)."""
        rank = self.contexts.find(contexts)
        known = rank >= 0
        total, kinds = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        total[known], kinds[known] = self.total[rank[known]], self.kinds[rank[known]]
        each = np.repeat(rank, n_succ)
        ask = np.flatnonzero(each >= 0)
        codes = np.zeros(len(succ), np.uint16)
        if len(ask):
            r = each[ask]
            lo = self.first.get(r).astype(np.int64)
            at = self.keys.find((r.astype(np.uint64) << np.uint64(SUCC)) | succ[ask], lo, lo + self.kinds[r])
            codes[ask[at >= 0]] = self.codes[at[at >= 0]]
        return codes, total, kinds


def pack_batch(tab: pa.Table, hasher: WordHasher) -> dict:
    """A batch's documents as numbers into its vocabulary (most frequent first)."""
    raw, off = flat_text(tab.column(2))
    rows, h = hasher(raw, off)
    n = np.bincount(rows, minlength=tab.num_rows)
    uniq, inv, cnt = np.unique(h, return_inverse=True, return_counts=True)
    order = np.argsort(-cnt, kind="stable")
    place = np.empty(len(uniq), np.uint32)
    place[order] = np.arange(len(uniq), dtype=np.uint32)
    idx = place[inv]
    train = tab.column(1).combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
    seen = np.bincount(idx[np.repeat(train, n)], minlength=len(uniq))
    return {"n": n, "train": train, "vocab": uniq[order], "idx": idx, "seen": seen}


def batch_pairs(n: np.ndarray, train: np.ndarray, idx: np.ndarray, vocab: np.ndarray,
                heavy: np.ndarray, shards: int):
    """Distinct word pairs of a batch, dealt to shards.

    Returns (words incl. start and end, pair number per token, and per pair in
    shard order: shard, first word, second word, training count)."""
    words = np.concatenate([vocab, np.array([BOS, EOS], np.uint64)])
    bos, eos = len(vocab), len(vocab) + 1
    ends = np.cumsum(n + 1) - 1  # place of each end in the stream of followers
    after = np.full(len(idx) + len(n), eos, np.int64)
    is_word = np.ones(len(after), bool)
    is_word[ends] = False
    after[is_word] = idx
    before = np.empty(len(after), np.int64)
    before[1:] = after[:-1]
    before[np.cumsum(n + 1) - (n + 1)] = bos
    before <<= 32
    before |= after
    del after, is_word
    pair, number = np.unique(before, return_inverse=True)
    del before
    count = np.bincount(number[np.repeat(train, n + 1)], minlength=len(pair))
    v, w = pair >> 32, pair & 0xFFFFFFFF
    shard = words[v] % np.uint64(shards)
    hot = np.isin(words[v], heavy)
    shard[hot] = (words[w[hot]] >> np.uint64(7)) % np.uint64(shards)
    order = np.argsort(shard.astype(np.int32), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return words, place[number], shard[order].astype(np.int64), v[order], w[order], count[order]


def shard_cells(shard, v):
    """Per shard that owns pairs of the batch: (shard, range of the pairs, contexts
    in order, successors of each)."""
    owners, bounds = np.unique(shard, return_index=True)
    for s, a, b in zip(owners.tolist(), bounds, np.append(bounds[1:], len(shard))):
        part = v[a:b]
        new = np.ones(len(part), bool)
        new[1:] = part[1:] != part[:-1]
        at = np.flatnonzero(new)
        yield s, a, b, part[at], np.diff(np.append(at, len(part)))


def five_bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def from_five(b: bytes | np.ndarray) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view("<u8")[:, 0]


def _batch_of(row: dict):
    n = np.frombuffer(row["n"], np.int64)
    train = np.frombuffer(row["train"], bool)
    idx = np.frombuffer(row["low"], np.uint16).astype(np.int64) \
        | np.frombuffer(row["high"], np.uint16).astype(np.int64) << 16
    return n, train, idx, np.frombuffer(row["vocab"], np.uint64)


def batches_of(docs: DataFrame, train: Column, id_col: str, text_col: str) -> DataFrame:
    """The batch table; it is written once, so batches keep their numbers."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(train, F.lit(False)).alias("train"),
                      F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([
        T.StructField("batch", T.LongType()), T.StructField("ids", T.ArrayType(src.schema["id"].dataType)),
        *[T.StructField(c, T.BinaryType()) for c in ("n", "train", "low", "high", "vocab", "seen")],
        T.StructField("tokens", T.LongType()), T.StructField("train_docs", T.LongType()),
        T.StructField("text_bytes", T.LongType())])

    def run(batches):
        hasher = WordHasher(space_table())
        part = TaskContext.get().partitionId()
        for k, tab in enumerate(text_chunks(batches, 2, BATCH_BYTES)):
            p = pack_batch(tab, hasher)
            train, n = p["train"], p["n"]
            ids = tab.column(0).combine_chunks()
            yield pa.RecordBatch.from_pylist([{
                "batch": (part << 32) + k, "ids": ids.to_pylist(), "n": n.astype(np.int64).tobytes(),
                "train": train.tobytes(), "low": (p["idx"] & 0xFFFF).astype(np.uint16).tobytes(),
                "high": (p["idx"] >> 16).astype(np.uint16).tobytes(), "vocab": p["vocab"].tobytes(),
                "seen": p["seen"].astype(np.uint32).tobytes(),
                "tokens": int((n[train] + 1).sum()), "train_docs": int(train.sum()),
                "text_bytes": int(len(p["idx"]) * 6)}], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    return materialize(src.mapInArrow(run, schema), "lm-batches")


def frequent_words(table: DataFrame, n_train: int, shards: int) -> np.ndarray:
    """Sorted hashes of the start of a text and of the words that hold at least
    1 / parts of the training tokens, ``parts`` being the number of shards (HEAVY
    to HEAVY_MOST). A batch sends the words that hold 1 / (2 * parts) of its own
    training tokens: what it leaves out is at most half of such a word's count, so
    none is missed, and at most 2 * parts words are found (16 MB of hashes)."""
    parts = min(max(HEAVY, shards), HEAVY_MOST)

    def often(batches):
        for b in batches:
            for vocab, seen in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h, c = np.frombuffer(vocab, np.int64), np.frombuffer(seen, np.uint32).astype(np.int64)
                at = np.flatnonzero((c > 0) & (c * (2 * parts) >= c.sum()))
                yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(c[at])], names=["h", "c"])

    found = table.select("vocab", "seen").mapInArrow(often, "h long, c long").groupBy("h") \
                 .agg(F.sum("c").alias("c")).where(F.col("c") * (2 * parts) >= n_train).select("h").toArrow()
    words = found.column("h").to_numpy().view(np.uint64)
    return np.unique(np.append(words, np.uint64(BOS)))


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
          discount: float = DISCOUNT) -> DataFrame:
    """Per document: id, ``train``, ``n_tokens`` (words and one end), ``n_known``,
    ``train_tokens``, ``base_score`` and ``score`` (log10 probability of the text).

    The counts come from all rows that ``train`` selects (null: not). Null texts
    are empty: one token, the end. Repeated rows count and are scored each. Without
    training rows all words have the same probability and nothing is known."""
    table = batches_of(docs, train, id_col, text_col)
    total = table.agg(F.sum("tokens").alias("n"), F.sum("train_docs").alias("d"),
                      F.sum("text_bytes").alias("b")).first()
    n_train, n_docs = int(total["n"] or 0), int(total["d"] or 0)
    shards = max(4, -(-int(total["b"] or 0) // SHARD_BYTES))
    heavy = frequent_words(table, n_train, shards)

    def ask(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                words, number, shard, v, w, count = batch_pairs(*_batch_of(row), heavy, shards)
                del number
                succ = words[w] & np.uint64((1 << SUCC) - 1)
                for s, a, z, ctx, ns in shard_cells(shard, v):
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (
                        row["batch"], s, words[ctx].tobytes(), ns.astype(np.uint32).tobytes(),
                        five_bytes(succ[a:z]), count[a:z].astype(np.uint32).tobytes())],
                        names=["batch", "shard", "ctx", "ns", "succ", "cnt"])

    asked = table.select("batch", "n", "train", "low", "high", "vocab").mapInArrow(
        ask, "batch long, shard long, ctx binary, ns binary, succ binary, cnt binary")

    def answer(t: pa.Table) -> pa.Table:
        cell = {c: [np.frombuffer(x.as_buffer(), k) for x in t.column(c)] for c, k in (
            ("ctx", np.uint64), ("ns", np.uint32), ("cnt", np.uint32), ("succ", np.uint8))}
        contexts, inv = np.unique(np.concatenate(cell["ctx"]), return_inverse=True)
        key = np.repeat(inv.astype(np.uint64), np.concatenate(cell["ns"]))
        key <<= np.uint64(SUCC)
        end = 0
        for x in cell["succ"]:
            end += len(x) // 5
            key[end - len(x) // 5:end] |= from_five(x)
        count = np.concatenate(cell["cnt"])
        key, count = key[count > 0], count[count > 0]
        order = np.argsort(key)
        key, count = key[order], count[order]
        del order, inv
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(new)
        key, count = key[at], np.add.reduceat(count, at, dtype=np.int64) if len(at) else count.astype(np.int64)
        owner = (key >> np.uint64(SUCC)).astype(np.int64)
        seen, first = np.unique(owner, return_index=True)
        rank = np.zeros(len(contexts), np.uint64)
        rank[seen] = np.arange(len(seen))
        key = (rank[owner] << np.uint64(SUCC)) | (key & np.uint64((1 << SUCC) - 1))
        trie = Trie(contexts[seen], first, key, count, discount)
        spread = np.isin(contexts[seen], heavy)
        del key, count, new, at, owner
        got = [trie.lookup(ctx, ns, from_five(x)) for ctx, ns, x in zip(cell["ctx"], cell["ns"], cell["succ"])]
        # the row without a batch: the shard's part of the frequent contexts
        part = {"codes": np.searchsorted(heavy, contexts[seen][spread]).astype(np.uint32),
                "total": trie.total[spread], "kinds": trie.kinds[spread]}
        return pa.table({
            "batch": pa.array([*t.column("batch").to_pylist(), None], pa.int64()),
            "shard": pa.array([*t.column("shard").to_pylist(), t.column("shard")[0].as_py()], pa.int64()),
            "codes": pa.array([*[g[0].tobytes() for g in got], part["codes"].tobytes()], pa.binary()),
            "total": pa.array([*[g[1].astype(np.int64).tobytes() for g in got],
                               part["total"].astype(np.int64).tobytes()], pa.binary()),
            "kinds": pa.array([*[g[2].astype(np.int64).tobytes() for g in got],
                               part["kinds"].astype(np.int64).tobytes()], pa.binary()),
            "words": pa.array([None] * len(got) + [int((~spread).sum())], pa.int64())})

    answers = materialize(asked.groupBy("shard").applyInArrow(
        answer, "batch long, shard long, codes binary, total binary, kinds binary, words long"), "lm-answers")
    parts = answers.where("batch IS NULL")
    words_seen = int(parts.agg(F.sum("words")).first()[0] or 0) + len(heavy) - 1 + int(n_docs > 0)

    def frequent_parts(batches):
        for b in batches:
            for at, total, kinds in zip(*(b.column(i).to_pylist() for i in range(3))):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.frombuffer(at, np.uint32).astype(np.int64)), pa.array(np.frombuffer(total, np.int64)),
                    pa.array(np.frombuffer(kinds, np.int64))], names=["i", "c", "k"])

    # one row per frequent context
    sums = parts.select("codes", "total", "kinds").mapInArrow(frequent_parts, "i long, c long, k long") \
                .groupBy("i").agg(F.sum("c").alias("c"), F.sum("k").alias("k")).toArrow()
    heavy_count, heavy_kinds = np.zeros(len(heavy), np.int64), np.zeros(len(heavy), np.int64)
    heavy_count[sums.column("i").to_numpy()] = sums.column("c").to_numpy()
    heavy_kinds[sums.column("i").to_numpy()] = sums.column("k").to_numpy()
    floor = n_train + 0.5 * (words_seen + 1)
    id_type = table.schema["ids"].dataType.elementType
    out_schema = T.StructType([T.StructField("id", id_type)]).add("train", "boolean").add(
        "n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add(
        "base_score", "double").add("score", "double")
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(out_schema)

    def add_up(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        doc = next(r for r in rows if r["shard"] is None)
        got = {r["shard"]: r for r in rows if r["shard"] is not None}
        n, tr, idx, vocab = _batch_of(doc)
        words, number, shard, v, w, _ = batch_pairs(n, tr, idx, vocab, heavy, shards)
        c = np.zeros(len(words), np.int64)
        kinds = np.zeros(len(words), np.int64)
        seen = np.zeros(len(v))  # discounted count of each pair
        for s, a, z, ctx, ns in shard_cells(shard, v):
            part = np.frombuffer(got[s]["total"], np.int64)
            c[ctx] = part
            kinds[ctx] = np.frombuffer(got[s]["kinds"], np.int64)
            code = np.frombuffer(got[s]["codes"], np.uint16).astype(np.float64)
            prob = np.where(code > 0, 10.0 ** ((code - 1) / SCALE + LOWEST), 0.0)
            seen[a:z] = prob * np.repeat(part, ns)
        hot = np.flatnonzero(np.isin(words, heavy))  # in several shards: their sums
        at = np.searchsorted(heavy, words[hot])
        c[hot], kinds[hot] = heavy_count[at], heavy_kinds[at]
        uni = c.copy()
        uni[len(vocab)], uni[len(vocab) + 1] = 0, n_docs
        p1 = (uni + 0.5) / floor
        ctx = c[v]
        p = np.where(ctx > 0, (seen + discount * kinds[v] * p1[w]) / np.maximum(ctx, 1), p1[w])
        starts = np.cumsum(n + 1) - (n + 1)
        follower = w[number]
        sums = [np.add.reduceat(x, starts) for x in (
            (uni[follower] > 0).astype(np.int64), np.log10(p1)[follower], np.log10(p)[number])]
        return pa.table([pa.array(doc["ids"], arrow.field(0).type), pa.array(tr), pa.array(n + 1), pa.array(sums[0]),
                         pa.array(np.full(len(n), n_train)), pa.array(sums[1]), pa.array(sums[2])],
                        schema=arrow)

    both = table.select("batch", "ids", "n", "train", "low", "high", "vocab").unionByName(
        answers.where("batch IS NOT NULL").select("batch", "shard", "codes", "total", "kinds"),
        allowMissingColumns=True)
    return both.groupBy("batch").applyInArrow(add_up, out_schema)
