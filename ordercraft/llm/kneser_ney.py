"""Quality by perplexity under an interpolated modified Kneser-Ney model.

A trigram model is trained on all trusted texts (rows that the labels call good),
distinct ones of each language. Every token (a word or the end of a text, with its
two predecessors) goes to the shard of its middle word, which there meets all counts
but two: the lowest order's share of its last word, and of a frequent middle word
those shares that other shards count as well. Frequent middle words are spread over
all shards by the word before them, frequent pairs by the word after.

A first sweep over the trusted texts finds the discounts, the lowest order and the
counts of what is spread; the second one counts again and scores. Shards are dealt to
a few rounds, one after the other, whose shuffles and tables go before the next one
starts, so that the disk holds a part of the tokens at a time. The shares of the
first HEAD_WORDS words of the lowest order are broadcast. Tokens that need another
one, or one of a spread word, are joined to it as rows, with the rest of their
probability as a linear form. The sums of equal texts are added up by the text's
hash. Documents above their language's perplexity quantile are marked.

With ``sample_rows`` the model is a small one instead, trained on a bounded sample
(``common.language_sample``) and broadcast; no query uses it.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize as scoped_table, scratch_scope
from .common import (TMP, WordHasher, annotate, flat_text, language_sample, materialize, mix, space_table,
                     text_chunks, text_hash)

SAMPLE_BYTES = 8_000_000  # of a language in a sampled model
TOTAL_BYTES = 16_000_000  # of all languages, in equal parts: bounds the broadcast table
RUN = 16_384  # bytes of a run of a text that is longer than its share of the sample
QUANTILE = 0.9  # documents above this share of their language's perplexities are marked
ACCURACY = 10_000  # of the distributed quantile: relative rank error below 1 / ACCURACY
SHARDS = 16  # of a sampled model
BATCH_BYTES = 16 << 20  # text in a batch of documents
SHARD_BYTES = 32 << 20  # text per shard of the whole model
LEAST_SHARDS = 8  # of a round
ROUND_BYTES = 16 << 20  # text in a round, until there are ROUNDS
ROUNDS = 4
TEXT_PARTS = 2  # of the trusted texts, whose rows meet their ids in a shuffle
COUNT_ROUNDS = 2  # of the first sweep: it reads the trusted texts only
HEAD_WORDS = 1 << 19  # words whose share of the lowest order is broadcast, 12 bytes each
HEAD_BIGRAMS = 1 << 18  # likewise bigrams of spread words, 20 bytes each
PIECE = 1 << 16  # text hashed at once: its arrays stay in the processor's cache
SAMPLED = 16  # one of so many texts tells which words are spread
BOS, EOS = 1, 2
_C = np.uint64(0xD6E8FEB86659FD93)


def trigram_stream(words: np.ndarray, rows: np.ndarray, n_rows: int):
    """(u, v, w, row): every word and the end of each text with its two predecessors."""
    n = np.bincount(rows, minlength=n_rows)
    stop = np.cumsum(n + 1)
    w = np.full(len(words) + n_rows, EOS, np.uint64)
    inside = np.ones(len(w), bool)
    inside[stop - 1] = False
    w[inside] = words
    row = np.repeat(np.arange(n_rows), n + 1)
    first = stop - (n + 1)
    v, u = np.full(len(w), BOS, np.uint64), np.full(len(w), BOS, np.uint64)
    v[1:] = w[:-1]
    v[first] = BOS
    u[1:] = v[:-1]
    u[first] = BOS
    return u, v, w, row


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * _C + b)


def trigram_counts(sample: DataFrame) -> DataFrame:
    """(u, v, w, c) of the sample's (text) rows."""

    def run(batches):
        hasher = WordHasher(space_table())
        for tab in text_chunks(batches, 0, 1 << 20):
            raw, off = flat_text(tab.column(0))
            rows, h = hasher(raw, off)
            u, v, w, _ = trigram_stream(h, rows, tab.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (u, v, w)],
                                             names=["u", "v", "w"])

    return sample.select("text").mapInArrow(run, "u long, v long, w long") \
                 .groupBy("u", "v", "w").agg(F.count("*").alias("c"))


def _seen(counts: DataFrame) -> list[int]:
    """Numbers of n-grams seen one to four times."""
    r = counts.agg(*[F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    return [x or 0 for x in r]


def _discounts(counts: DataFrame) -> list[float]:
    return _discounts_of(_seen(counts))


def _discounts_of(seen: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams seen one to four times."""
    n1, n2, n3, n4 = map(float, seen)
    if not n1 or not n2:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3))]


# Parts of the model: shares of n-grams (tri, bi, uni) and weights of contexts.
A3, G3, A2, G2, A1 = range(5)


LOW = np.uint64((1 << 48) - 1)  # bits of a hash that are kept: with its shard, 52 tell n-grams apart


def packed(keys: np.ndarray, values: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted 48-bit hashes and values in single precision, as the bytes that are broadcast."""
    keys = keys & LOW
    order = np.argsort(keys)
    return keys[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), values[order].astype("<f4").tobytes()


def unpacked(keys: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    full = np.zeros((len(keys) // 6, 8), np.uint8)
    full[:, :6] = np.frombuffer(keys, np.uint8).reshape(-1, 6)
    return full.view("<u8")[:, 0], np.frombuffer(values, "<f4")


class Shards:
    """Sorted (hash, value) tables, one per shard of the context's last word."""

    def __init__(self, parts: dict[int, tuple[np.ndarray, np.ndarray]]):
        none = np.zeros(0, np.uint64), np.zeros(0, np.float32)
        self.parts = [parts.get(i, none) for i in range(SHARDS)]

    def join(self, ask: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Value per asked hash, 0 where there is none; ``word`` decides the shard."""
        uniq, first, inv = np.unique(ask, return_index=True, return_inverse=True)
        shard, uniq = word[first] >> np.uint64(60), uniq & LOW
        out = np.zeros(len(uniq))
        for i, (keys, values) in enumerate(self.parts):
            at = np.flatnonzero(shard == i)
            if len(keys) and len(at):
                found = np.minimum(np.searchsorted(keys, uniq[at]), len(keys) - 1)
                out[at] = np.where(keys[found] == uniq[at], values[found], 0)
        return out[inv]


def unpack_model(held: dict) -> dict:
    got = [{} for _ in range(5)]
    for part, shard, *blobs in held["shards"]:
        got[part][shard] = unpacked(*blobs)
    names = ("a3", "g3", "a2", "g2", "a1")
    return {n: Shards(t) for n, t in zip(names, got)} | {"g1": held["g1"], "words": held["words"]}


def _cut(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array(d)[np.minimum(c, 3) - 1]


PACKED = "part int, shard int, keys binary, value binary"


def _pack_order(counts: DataFrame, cols: list[str], share: int, weight: int, d: list[float]) -> DataFrame:
    """Packed shares and context weights of the n-grams ``cols``, shard by shard: all
    n-grams of a context meet in the shard of the context's last word (bounded by
    the sample), where its total and weight are summed and joined to them."""
    def pack(tab: pa.Table) -> pa.Table:
        words = [tab.column(c).to_numpy().view(np.uint64) for c in cols]
        c, shard = tab.column("c").to_numpy(), tab.column("shard")[0].as_py()
        context = words[0] if len(cols) == 2 else pair_key(*words[:2])
        own, at = np.unique(context, return_inverse=True)
        total, mass = np.bincount(at, c), np.bincount(at, _cut(c, d))
        return _rows([(share, shard, *packed(pair_key(context, words[-1]), (c - _cut(c, d)) / total[at])),
                      (weight, shard, *packed(own, mass / total))])

    return _sharded(counts, cols[-2]).applyInArrow(pack, PACKED)


def _pack_words(uni: DataFrame, d: list[float], total: float) -> DataFrame:
    def pack(tab: pa.Table) -> pa.Table:
        c = tab.column("c").to_numpy()
        keys = tab.column("w").to_numpy().view(np.uint64)
        return _rows([(A1, tab.column("shard")[0].as_py(), *packed(keys, (c - _cut(c, d)) / total))])

    return _sharded(uni, "w").applyInArrow(pack, PACKED)


def _sharded(counts: DataFrame, word: str):
    return counts.withColumn("shard", F.shiftrightunsigned(word, 60).cast("int")).groupBy("shard")


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    names=["part", "shard", "keys", "value"])


def train(sample: DataFrame) -> dict:
    """The packed model. Counts are grouped in Spark, discounts, totals and weights
    joined and packed per shard in its tasks; the driver only passes the packed
    shards on (10 bytes an n-gram of the bounded sample)."""
    tri = materialize(trigram_counts(sample), "kn-tri")
    bi = materialize(tri.groupBy("v", "w").agg(F.count("*").alias("c")), "kn-bi")
    uni = materialize(bi.groupBy("w").agg(F.count("*").alias("c")), "kn-uni")
    total, words = uni.agg(F.sum("c"), F.count("*")).first()
    d1, held, g1 = _discounts(uni), [], 1.0
    if words:
        c = F.col("c")
        g1 = uni.agg(F.sum(F.when(c == 1, d1[0]).when(c == 2, d1[1]).otherwise(d1[2]))).first()[0] / total
        rows = _pack_order(tri, ["u", "v", "w"], A3, G3, _discounts(tri)).unionByName(
            _pack_order(bi, ["v", "w"], A2, G2, _discounts(bi))).unionByName(_pack_words(uni, d1, float(total)))
        held = [tuple(r) for r in rows.toLocalIterator()]
    return {"shards": held, "g1": g1, "words": words}


def log_probabilities(model: dict, u, v, w) -> np.ndarray:
    """log10 p(w | u v): each order's discounted share plus the weighted lower order.
    A context that was never seen passes the lower order on whole."""
    p = model["a1"].join(w, w) + model["g1"] / (model["words"] + 1)
    g2, g3 = model["g2"].join(v, v), model["g3"].join(pair_key(u, v), v)
    p = np.where(g2 > 0, model["a2"].join(pair_key(v, w), v) + g2 * p, p)
    p = np.where(g3 > 0, model["a3"].join(pair_key(pair_key(u, v), w), v) + g3 * p, p)
    return np.log10(p)


def _lang(df: DataFrame, lang_col: str) -> Column:
    if lang_col not in df.columns:
        return F.lit("")
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{lang_col}`").cast("string")), F.lit(""))


def trusted_sample(trusted: DataFrame, lang_col: str = "lang", text_col: str = "text",
                   sample_rows: int | None = None, ids: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """(lang, text): the bounded sample of each language; runs end between words.
    With ``ids`` (one column: ids of trusted rows of ``trusted``) the texts are
    chosen by hash and length alone, and only the chosen ones are read."""
    text = F.col(f"`{text_col}`")
    rows = trusted.where(text.isNotNull()).select(_lang(trusted, lang_col).alias("lang"), text.alias("text"))
    keys = None
    if ids is not None:
        good = ids.select(F.col(ids.columns[0]).alias("good_id")).distinct()
        keys = trusted.where(text.isNotNull()).select(
            F.col(f"`{id_col}`").alias("id"), _lang(trusted, lang_col).alias("lang"), text_hash(text).alias("h"),
            F.octet_length(text).cast("long").alias("b")).join(good, F.col("id") == F.col("good_id")).select("lang", "h", "b")

    def cut(raw, start, stop):
        gaps = start + np.flatnonzero(space_table()[raw[start:stop]] == 0)
        if start > 0:
            start = int(gaps[0]) if len(gaps) else stop
        if stop < len(raw):
            stop = int(gaps[-1]) if len(gaps) else start
        return raw[start:stop].tobytes()

    sample = language_sample(rows, "kn", SAMPLE_BYTES, RUN, cut, sample_rows, TOTAL_BYTES, keys)
    return sample.select("lang", F.col("piece").cast("string").alias("text"))


def trusted_texts(trusted: DataFrame, lang_col: str = "lang", text_col: str = "text",
                  ids: DataFrame | None = None, id_col: str = "doc_id", part: int = 0, parts: int = 1) -> DataFrame:
    """(lang, text): every distinct whole text of each language; with ``ids`` of the
    rows of ``trusted`` with these ids. With ``parts`` a part of them by their hash."""
    text = F.col(f"`{text_col}`")
    rows = trusted.where((F.octet_length(text) > 0) & (F.pmod(text_hash(text), F.lit(parts)) == part))
    if ids is not None:
        good = ids.select(F.col(ids.columns[0]).alias(f"{TMP}good"))
        rows = rows.join(good, F.col(f"`{id_col}`") == F.col(f"{TMP}good"), "left_semi")
    rows = rows.select(_lang(trusted, lang_col).alias("lang"), text_hash(text).alias("h"), text.alias("text"))
    return rows.groupBy("lang", "h").agg(F.max("text").alias("text")).select("lang", "text")


def _middles(u: np.ndarray, v: np.ndarray, spread: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places of spread middle words, and which of these belong to spread pairs."""
    hot = np.flatnonzero(np.isin(v, spread["words"]))
    return hot, np.isin(pair_key(u[hot], v[hot]), spread["pairs"])


def _thin(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 byte by byte, the first bytes first, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _wide(thin, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(thin, 4 * n, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4")[:, 0].astype(np.int64)


def _owner(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each hash, by equal ranges of its upper half."""
    return (h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)


def _to_shards(texts: DataFrame, train: bool, part: int, rounds: int, shards: int, spread: dict,
               shared=None) -> DataFrame:
    """The tokens of ``texts`` (key, text) for the shards of round ``part``: cells with
    their distinct words (by their place among the broadcast ones, if there), three
    numbers into these per token, and the texts they are of."""
    def run(batches):
        head = shared.value[1]["head"][0] if shared else np.zeros(0, np.uint64)
        hasher = WordHasher(space_table(), PIECE)
        task = TaskContext.get().partitionId()
        for k, tab in enumerate(text_chunks(batches, 1, BATCH_BYTES)):
            keys = tab.column(0).to_numpy()
            row, h = hasher(*flat_text(tab.column(1)))
            u, v, w, row = trigram_stream(h, row, tab.num_rows)
            del h
            shard = _owner(v, shards)
            hot, pairs = _middles(u, v, spread)
            by = pair_key(u[hot], v[hot])
            shard[hot] = _owner(np.where(pairs, pair_key(by, w[hot]), by), shards)
            first, last = part * shards // rounds, (part + 1) * shards // rounds
            mine = np.flatnonzero((shard >= first) & (shard < last))
            mine = mine[np.argsort(shard[mine].astype(np.int32), kind="stable")]
            owners, first = np.unique(shard[mine], return_index=True)
            for s, at in zip(owners.tolist(), np.split(mine, first[1:])):
                own = pa.array(np.concatenate([x[at] for x in (u, v, w)])).dictionary_encode()
                words, idx = own.dictionary.to_numpy(), own.indices.to_numpy()
                new = np.flatnonzero(np.diff(row[at], prepend=-1)) if not train else np.zeros(0, np.int64)
                runs = np.diff(np.append(new, len(at))).astype("<u4") if len(new) else new
                place = _find(head, words)
                cell = (_thin(place + 1), words[place < 0], _thin(idx), keys[row[at[new]]], runs)
                yield pa.RecordBatch.from_arrays([
                    *[pa.array([x]) for x in (s, train, (task << 32) + k, len(at), len(words))],
                    *[pa.array([bytes(x)], pa.binary()) for x in cell]], names=CELL)

    return texts.mapInArrow(run, "shard long, train boolean, batch long, tokens long, distinct long, head binary, words binary, "
                                 "numbers binary, texts binary, runs binary")


CELL = ["shard", "train", "batch", "tokens", "distinct", "head", "words", "numbers", "texts", "runs"]


def _cells(tab: pa.Table, train: bool, head: np.ndarray):
    """(distinct words, their places in ``head`` or -1, numbers of u, v and w, texts,
    tokens of each) of a shard's cells."""
    for i in np.flatnonzero(tab.column("train").to_numpy() == train).tolist():
        rest, texts, runs = (np.frombuffer(tab.column(c)[i].as_buffer(), k) for c, k in (
            ("words", np.uint64), ("texts", np.int64), ("runs", "<u4")))
        place = _wide(tab.column("head")[i].as_buffer(), tab.column("distinct")[i].as_py()) - 1
        words = np.empty(len(place), np.uint64)
        words[place >= 0], words[place < 0] = head[place[place >= 0]], rest
        idx = _wide(tab.column("numbers")[i].as_buffer(), 3 * tab.column("tokens")[i].as_py())
        yield words, place, idx.reshape(3, -1), texts, runs.astype(np.int64)


def _find(keys: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Place of each ``want`` in the sorted ``keys``, or -1; asked in order, which is faster."""
    if not len(keys):
        return np.full(len(want), -1)
    order = np.argsort(want)
    asked = want[order]
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    out = np.empty(len(want), np.int64)
    out[order] = np.where(keys[at] == asked, at, -1)
    return out


def _value(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``values[at]``, 0 where ``at`` is -1."""
    return np.append(values, np.zeros(1, values.dtype))[at]


_LOW32 = (1 << 32) - 1


class ShardCounts:
    """The counts of a shard's trusted tokens; n-grams as numbers of its own words:
    contexts (u, v), trigrams (context, w) and bigrams (v, w), each sorted."""

    def __init__(self, cells: pa.Table, head: np.ndarray = np.zeros(0, np.uint64)):
        held = [(words, idx) for words, _, idx, *_ in _cells(cells, True, head)]
        self.words = np.unique(np.concatenate([words for words, _ in held] or [np.zeros(0, np.uint64)]))
        u, v, w = np.concatenate([np.searchsorted(self.words, words)[idx] for words, idx in held]
                                 or [np.zeros((3, 0), np.int64)], axis=1)
        self.contexts, at = np.unique(u << 32 | v, return_inverse=True)
        self.tri, self.c3 = np.unique(at << 32 | w, return_counts=True)
        self.of = self.tri >> 32  # context of each trigram
        self.bi, self.c2 = np.unique((self.contexts[self.of] & _LOW32) << 32 | self.tri & _LOW32, return_counts=True)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return self.words[self.contexts >> 32], self.words[self.contexts & _LOW32]


SEEN3, SEEN2, WORD, SPREAD2, SPREAD3 = range(5)  # kinds of counts of the first sweep


def _sweep_counts(cells: pa.Table, spread: dict) -> pa.Table:
    """What the whole model needs to know of a shard: trigrams and bigrams by their
    count, bigrams by their last word, bigrams of spread words with their count, and
    of spread pairs the number of tokens (class 0) and of followers by their count."""
    n, out = ShardCounts(cells), []

    def add(kind, x, y, c):
        out.append([np.broadcast_to(np.asarray(a).astype(np.int64), len(c)) for a in (kind, x, y, c)])

    seen = np.arange(1, 5)
    add(SEEN3, seen, 0, np.bincount(n.c3, minlength=5)[1:5])
    first, last = n.bi >> 32, n.bi & _LOW32
    hot = np.isin(n.words, spread["words"])[first] if len(n.words) else np.zeros(0, bool)
    add(SEEN2, seen, 0, np.bincount(n.c2[~hot], minlength=5)[1:5])
    w, c = np.unique(last[~hot], return_counts=True)
    add(WORD, n.words[w].view(np.int64), 0, c)
    add(SPREAD2, n.words[first[hot]].view(np.int64), n.words[last[hot]].view(np.int64), n.c2[hot])
    at = np.flatnonzero(np.isin(pair_key(*n.pairs()), spread["pairs"]))
    key = pair_key(*n.pairs())[at].view(np.int64)
    for k in range(4):
        of = n.of if k == 0 else n.of[np.minimum(n.c3, 3) == k]
        c = np.bincount(of, n.c3 if k == 0 else None, minlength=len(n.contexts))[at]
        add(SPREAD3, key, k, c)
    return pa.table([np.concatenate(x) for x in zip(*out)], names=["kind", "x", "y", "c"])


def _spread(texts: DataFrame, shards: int) -> dict:
    """Middle words and pairs that hold a shard's share of the tokens. Texts chosen by
    their hash tell; this decides on places only, never on a count."""
    def often(batches):
        hasher = WordHasher(space_table(), PIECE)
        for tab in text_chunks(batches, 1, BATCH_BYTES):
            row, h = hasher(*flat_text(tab.column(1)))
            u, v, _, _ = trigram_stream(h, row, tab.num_rows)
            for kind, x in ((0, v), (1, pair_key(u, v))):
                key, c = np.unique(x, return_counts=True)
                at = np.flatnonzero(c * (2 * shards) >= len(x))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.append(np.full(len(at), kind), 2)), pa.array(np.append(key[at].view(np.int64), kind)),
                    pa.array(np.append(c[at], len(x)))], names=["kind", "x", "c"])

    found = texts.where(F.pmod("key", F.lit(SAMPLED)) == 0).mapInArrow(often, "kind long, x long, c long") \
                 .groupBy("kind", "x").agg(F.sum("c").alias("c"))
    total = F.max(F.when((F.col("kind") == 2) & (F.col("x") == 0), F.col("c")))
    total = found.agg(total.alias("n")).first()["n"] or 0
    rows = found.where((F.col("kind") < 2) & (F.col("c") * shards >= total)).collect()
    words, pairs = (np.unique(np.array([r.x for r in rows if r.kind == k], np.int64).view(np.uint64)) for k in (0, 1))
    return {"words": words, "pairs": pairs}


def _model(texts: DataFrame, rounds: int, shards: int, spread: dict) -> dict:
    """Discounts, the table of the lowest order (x, a1) and its first words, and of what
    is spread: contexts' weights and the table of bigrams' shares (x, y, a2)."""
    spark, counts = texts.sparkSession, None
    for part in range(rounds):
        got = _to_shards(texts, True, part, rounds, shards, spread).groupBy("shard").applyInArrow(
            lambda t: _sweep_counts(t, spread), "kind long, x long, y long, c long")
        got = scoped_table(got.groupBy("kind", "x", "y").agg(F.sum("c").alias("c")).where("c > 0"), "kn-counts")
        counts = got if counts is None else counts.unionByName(got)
    of_kind = lambda *k: counts.where(F.col("kind").isin(*k)).groupBy("kind", "x", "y").agg(
        F.sum("c").alias("c"))
    seen = {(r.kind, r.x): r.c for r in of_kind(SEEN3, SEEN2).collect()}
    seen3, seen2 = ([seen.get((k, i), 0) for i in (1, 2, 3, 4)] for k in (SEEN3, SEEN2))
    hot = len(spread["words"]) > 0
    uni = of_kind(WORD).select("x", "c")
    if hot:
        seen2 = [a + b for a, b in zip(seen2, _seen(of_kind(SPREAD2)))]
        uni = uni.unionByName(of_kind(SPREAD2).groupBy(F.col("y").alias("x")).agg(F.count("*").alias("c")))
    uni = scoped_table(uni.groupBy("x").agg(F.sum("c").alias("c")), "kn-uni")
    d1, d2, d3 = _discounts(uni), _discounts_of(seen2), _discounts_of(seen3)
    c, cut = F.col("c"), lambda d: F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
    total, words, mass = uni.agg(F.sum("c"), F.count("*"), F.sum(cut(d1))).first()
    a1 = uni.select("x", ((c - cut(d1)) / F.lit(float(total or 1))).cast("float").alias("a1"), "c")
    head = a1.orderBy(F.desc("c"), "x").limit(HEAD_WORDS) if words > HEAD_WORDS else a1
    head = head.select("x", "a1")
    if words > HEAD_WORDS and hot:  # a spread word is in it, or is known to be none
        asked = spark.createDataFrame([(int(x),) for x in spread["words"].view(np.int64)], "x long")
        head = head.unionByName(a1.join(F.broadcast(asked), "x", "left_semi").select("x", "a1")).distinct()
        head = head.unionByName(asked.join(a1, "x", "left_anti").withColumn("a1", F.lit(0).cast("float")))
    model = {"d2": d2, "d3": d3, "lowest": (mass / total if words else 1.0) / (words + 1), "a1": a1.select("x", "a1"),
             "head": _sorted(head), "whole": words <= HEAD_WORDS, "a2": None,
             "head2": (np.zeros(0, np.uint64), np.zeros(0, np.float32)), "whole2": True}
    weights = {}
    if hot:
        totals = of_kind(SPREAD2).groupBy("x").agg(F.sum("c").alias("total"), F.sum(cut(d2)).alias("mass"))
        totals = scoped_table(totals, "kn-spread")
        weights = {r.x: r.mass / r.total for r in totals.collect()}
        a2 = of_kind(SPREAD2).join(F.broadcast(totals), "x").select(
            "x", "y", ((c - cut(d2)) / F.col("total")).cast("float").alias("a2"), "c")
        whole = a2.count() <= HEAD_BIGRAMS
        head = (a2 if whole else a2.orderBy(F.desc("c"), "x", "y").limit(HEAD_BIGRAMS)).drop("c")
        model |= {"a2": a2.drop("c"), "head2": _sorted(head), "whole2": whole}
    model["g2"] = np.array([weights.get(int(x), 0) for x in spread["words"].view(np.int64)], np.float32)
    pairs = {}
    if len(spread["pairs"]):
        for r in of_kind(SPREAD3).collect():
            pairs.setdefault(r.x, [0, 0, 0, 0])[r.y] = r.c
    pairs = np.array([pairs.get(int(x), [0] * 4) for x in spread["pairs"].view(np.int64)], float).reshape(-1, 4)
    model["total3"] = np.maximum(pairs[:, 0], 1)
    model["g3"] = (pairs[:, 1:] @ np.array(d3) / model["total3"]).astype(np.float32)
    return model


def _sorted(head: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and values of a bounded table of words or bigrams."""
    *key, value = (c.to_numpy() for c in head.toArrow().columns)
    key = [k.view(np.uint64) for k in key]
    key = key[0] if len(key) == 1 else pair_key(*key)
    order = np.argsort(key)
    return key[order], value[order]


SUM, REST = {"key": "long", "base": "double", "n": "long", "ends": "long"}, {
    "key": "long", "v": "long", "w": "long", "base": "double", "b2": "double", "b1": "double"}
SCORED = "batch long, rest boolean, cols array<binary>"
KIND = {"long": np.int64, "double": np.float64}


def _scored(cells: pa.Table, spread: dict, m: dict) -> pa.Table:
    """A shard's tokens, a row a cell with the columns of SUM and one with those of REST:
    by text the sum of log10 p of those it can settle, with the numbers of all tokens
    and of ends; and every other token, whose p is base + b2 * (share of the bigram
    v w) + b1 * (lowest share of w)."""
    n = ShardCounts(cells, m["head"][0])
    cut3, cut2 = _cut(n.c3, m["d3"]), _cut(n.c2, m["d2"])
    total = np.bincount(n.of, n.c3, len(n.contexts))
    mass = np.bincount(n.of, cut3, len(n.contexts))
    g3 = (mass / np.maximum(total, 1)).astype(np.float32)
    pair = _find(spread["pairs"], pair_key(*n.pairs()))
    total, g3 = np.where(pair < 0, total, _value(m["total3"], pair)), np.where(pair < 0, g3, _value(m["g3"], pair))
    a3 = ((n.c3 - cut3) / total[n.of]).astype(np.float32)
    first = n.bi >> 32
    total = np.bincount(first, n.c2, len(n.words))
    a2 = ((n.c2 - cut2) / total[first]).astype(np.float32)
    g2 = (np.bincount(first, cut2, len(n.words)) / np.maximum(total, 1)).astype(np.float32)
    batch, out = cells.column("batch").to_numpy()[~cells.column("train").to_numpy()], []
    for words, at, (u, v, w), texts, runs in _cells(cells, False, m["head"][0]):
        own = _find(n.words, words)
        lowest = _value(m["head"][1], at).astype(float)
        known = at >= 0 if not m["whole"] else np.ones(len(words), bool)
        hot = _find(spread["words"], words)
        weight = np.where(hot < 0, _value(g2, own), _value(m["g2"], hot)).astype(float)
        lu, lv, lw = own[u], own[v], own[w]
        context = np.where((lu < 0) | (lv < 0), -1, lu << 32 | lv)
        context = _find(n.contexts, context)
        b, a = _value(g3, context).astype(float), np.zeros(len(u))
        ask = np.flatnonzero((context >= 0) & (lw >= 0))
        a[ask] = _value(a3, _find(n.tri, context[ask] << 32 | lw[ask]))
        if len(spread["pairs"]):
            pair = _find(spread["pairs"], pair_key(words[u], words[v]))
            b = np.where(pair < 0, b, _value(m["g3"], pair))
        a, b = np.where(b > 0, a, 0), np.where(b > 0, b, 1)
        middle, is_hot = weight[v], (hot >= 0)[v]
        share = np.zeros(len(u))
        ask = np.flatnonzero(~is_hot & (lv >= 0) & (lw >= 0))
        share[ask] = _value(a2, _find(n.bi, lv[ask] << 32 | lw[ask]))
        fixed = np.where(middle > 0, share + middle * m["lowest"], m["lowest"])
        slope = np.where(middle > 0, middle, 1)
        b2 = np.zeros(len(u))
        ask = np.flatnonzero(is_hot & (middle > 0))
        at = _find(m["head2"][0], pair_key(words[v[ask]], words[w[ask]]))
        fixed[ask] += _value(m["head2"][1], at)
        if not m["whole2"]:
            b2[ask] = np.where(at < 0, b[ask], 0)
        p = a + b * (fixed + slope * lowest[w])
        b1 = np.where(known[w], 0, b * slope)
        open_ = (b2 > 0) | (b1 > 0)
        of = np.repeat(np.arange(len(texts)), runs)
        done = np.flatnonzero(~open_)
        out.append((False, [texts, np.bincount(of[done], np.log10(p[done]), len(texts)), runs,
                            np.bincount(of[words[w] == EOS], minlength=len(texts))]))
        open_ = np.flatnonzero(open_)
        out.append((True, [texts[of[open_]], words[v[open_]].view(np.int64), words[w[open_]].view(np.int64),
                           p[open_], b2[open_], b1[open_]]))
    cols = [[x.astype(KIND[k]).tobytes() for x, k in zip(c, (REST if rest else SUM).values())] for rest, c in out]
    return pa.table([pa.array(np.repeat(batch, 2), pa.int64()), pa.array([rest for rest, _ in out], pa.bool_()),
                     pa.array(cols, pa.list_(pa.binary()))], names=["batch", "rest", "cols"])


def _unpacked(cols: pa.ChunkedArray | pa.Array, kinds: dict) -> list[np.ndarray]:
    """The columns of several rows, one after the other."""
    rows = [[np.frombuffer(x, KIND[k]) for x, k in zip(row, kinds.values())] for row in cols.to_pylist()]
    return [np.concatenate(x) for x in zip(*rows)]


def _sum_cells(tab: pa.Table) -> pa.Table:
    """(key, base, n, ends): a batch's sums, each text once."""
    key, *cols = _unpacked(tab.column("cols"), SUM)
    key, at = np.unique(key, return_inverse=True)
    return pa.table([key, *[np.bincount(at, c, len(key)).astype(c.dtype) for c in cols]], names=list(SUM))


def _rest_rows(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _unpacked(b.column(0).slice(i, 1), REST)],
                                             names=list(REST))


def _ddl(kinds: dict) -> str:
    return ", ".join(f"{c} {k}" for c, k in kinds.items())


def _settled(scored: DataFrame, model: dict) -> DataFrame:
    """(key, base, n, ends) of a round: tokens that wait for a share are joined to it."""
    done = scored.where("not rest").groupBy("batch").applyInArrow(_sum_cells, _ddl(SUM))
    if model["whole"] and model["whole2"]:
        return done
    rest = scored.where("rest").select("cols").mapInArrow(_rest_rows, _ddl(REST))
    for weight, side, on, value in (("b2", model["a2"], ["v", "w"], "a2"), ("b1", model["a1"], ["w"], "a1")):
        if model["whole2" if weight == "b2" else "whole"]:
            continue
        side = side.select(*[F.col(x).alias(f"on_{c}") for x, c in zip("xy", on)], value)
        met = rest.where(f"{weight} > 0")
        met = met.join(side, [F.col(c) == F.col(f"on_{c}") for c in on], "left")
        met = met.withColumn("base", F.col("base") + F.col(weight) * F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
        rest = rest.where(f"{weight} <= 0").unionByName(met.select(rest.columns))
    zero = F.lit(0).cast("long")
    return done.unionByName(rest.select("key", F.log10("base").alias("base"), zero.alias("n"), zero.alias("ends")))


# Shuffle files go when what they were written for has ended; small tables.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
            "spark.sql.parquet.compression.codec": "zstd"}


def whole_perplexities(docs: DataFrame, texts: list[DataFrame], text_col: str, names: list[str], out: str) -> DataFrame:
    """``names`` of ``docs`` with the struct ``out`` of :func:`perplexities`, by the
    model of all ``texts`` (in parts, read one after the other); round by round, each
    one's tables and shuffles go with it."""
    spark, text = docs.sparkSession, F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    asked = docs.select(text_hash(text).alias("key"), text.alias("text"))
    held = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, x in SETTINGS.items():
        spark.conf.set(k, x)
    try:
        with scratch_scope(spark):
            texts = [scoped_table(part, "kn-texts") for part in texts]
            trusted = functools.reduce(DataFrame.unionByName, texts).select(text_hash(F.col("text")).alias("key"), "text")
            size = sum(int(x.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) for x in (asked, trusted))
            rounds = min(ROUNDS, max(1, -(-size // ROUND_BYTES)))
            shards = rounds * max(LEAST_SHARDS, -(-size // (rounds * SHARD_BYTES)))
            spread = _spread(asked.unionByName(trusted), shards)
            model = _model(trusted, min(COUNT_ROUNDS, rounds), shards, spread)
            small = {k: model[k] for k in ("d2", "d3", "lowest", "head", "whole", "head2", "whole2", "g2", "total3", "g3")}
            shared, sums = spark.sparkContext.broadcast((spread, small)), None
            for part in range(rounds):
                with scratch_scope(spark):
                    cells = _to_shards(trusted, True, part, rounds, shards, spread, shared).unionByName(
                        _to_shards(asked, False, part, rounds, shards, spread, shared))
                    scored = cells.groupBy("shard").applyInArrow(lambda t: _scored(t, *shared.value), SCORED)
                    if not (model["whole"] and model["whole2"]):
                        scored = scoped_table(scored, "kn-scored")
                    got = _added(_settled(scored, model))
                    got = materialize(got, "kn-round")
                sums = got if sums is None else sums.unionByName(got)
            sums = materialize(_added(sums), "kn-sums") if rounds > 1 else sums
    finally:
        for k, x in held.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)
    tokens, log = F.col(f"{TMP}n").cast("long"), F.col(f"{TMP}base")
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], text_hash(text).alias(f"{TMP}key"))
    sums = sums.select(F.col("key").alias(f"{TMP}sum"), (F.col("n") / F.col("ends")).alias(f"{TMP}n"),
                       (F.col("base") / F.col("ends")).alias(f"{TMP}base"))
    return keyed.join(sums, F.col(f"{TMP}key") == F.col(f"{TMP}sum")).select(
        *[F.col(f"`{c}`") for c in names],
        F.struct(tokens.alias("n_tokens"), log.alias("log10_prob"),
                 F.when(tokens > 1, F.pow(F.lit(10.0), -log / tokens)).alias("perplexity")).alias(out))


def _added(sums: DataFrame) -> DataFrame:
    """Copies of a text come as often as it has ends."""
    return sums.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("base", "n", "ends")])


def perplexities(docs: DataFrame, trusted: DataFrame, text_col: str = "text",
                 keep: list[str] | None = None, out: str = "kn",
                 sample_rows: int | None = None, lang_col: str = "lang",
                 ids: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with a struct column ``out``: ``n_tokens`` (words and the end),
    ``log10_prob`` and ``perplexity`` (null for texts without words). ``trusted``
    has the trusted texts in ``text_col``; null texts are not used. Each text counts
    once in a language (``lang_col``; null: a language of its own), without this
    column once. ``ids``: the ids of the rows of ``trusted`` that are trusted
    (default: all). ``sample_rows`` (default None: the model is trained on all
    texts): a small model of up to so many texts of a language."""
    if sample_rows is None:
        names = [c for c in (docs.columns if keep is None else keep) if c.lower() != out.lower()]
        texts = [trusted_texts(trusted, lang_col, text_col, ids, id_col, i, TEXT_PARTS) for i in range(TEXT_PARTS)]
        return whole_perplexities(docs, texts, text_col, names, out)
    model = train(trusted_sample(trusted, lang_col, text_col, sample_rows, ids, id_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        hasher = WordHasher(space_table())
        m = unpack_model(shared.value)

        def work(text):
            raw, off = flat_text(text)
            rows, h = hasher(raw, off)
            u, v, w, row = trigram_stream(h, rows, len(text))
            total = np.bincount(row, log_probabilities(m, u, v, w), len(text))
            n = np.bincount(row, minlength=len(text))
            return [pa.array(n), pa.array(total),
                    pa.array(10.0 ** (-total / np.maximum(n, 1)), mask=n < 2)]
        return work

    return annotate(docs, text_col, make, "n_tokens long, log10_prob double, perplexity double", out, keep,
                    chunk_bytes=1 << 20)


def classify(docs: DataFrame, trusted: DataFrame, lang_col: str = "lang", text_col: str = "text",
             keep: list[str] | None = None, quantile: float = QUANTILE,
             sample_rows: int | None = None, ids: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """``docs`` (or ``keep``) with ``n_tokens``, ``log10_prob``, ``perplexity``,
    ``threshold`` (the quantile of the language's perplexities) and ``good``
    (at most the threshold). Null languages are a language of their own; a text
    without words has no perplexity and is not good; without ``lang_col`` all are one language. A trusted text counts
    once per language if ``trusted`` has ``lang_col``. Without trusted text all words are equally likely. Columns of these names are replaced."""
    new = ("n_tokens", "log10_prob", "perplexity", "threshold", "good")
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    named = docs.withColumn(f"{TMP}lang", F.col(f"`{lang_col}`") if lang_col in docs.columns else F.lit(None).cast("string"))
    scored = perplexities(named, trusted, text_col, [*names, f"{TMP}lang"], f"{TMP}kn", sample_rows,
                          lang_col, ids, id_col)
    scored = materialize(scored.select(*[F.col(f"`{c}`") for c in names], f"{TMP}lang", f"{TMP}kn.*"), "kn-scores")
    cuts = materialize(scored.groupBy(F.col(f"{TMP}lang").alias(f"{TMP}l")).agg(
        F.percentile_approx("perplexity", quantile, ACCURACY).alias("threshold")), "kn-thresholds")
    return scored.join(cuts, F.col(f"{TMP}lang").eqNullSafe(F.col(f"{TMP}l"))) \
        .withColumn("good", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False))) \
        .drop(f"{TMP}lang", f"{TMP}l")
