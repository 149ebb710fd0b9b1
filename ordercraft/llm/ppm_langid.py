"""Language identification by prediction by partial matching.

For each language the counts of byte n-grams up to ORDER + 1 form a context
tree. A byte costs the code length of its longest seen context, with an
escape (method C: distinct / (total + distinct)) for every context in which
it was not seen; the statistics stay frozen while scoring. A text's language
is the one with the shortest code.

The trees are learned on a bounded sample of labelled rows: for each language
its distinct texts in hash order up to ``SAMPLE_BYTES``, or all of them; a very
long text gives runs spread over it (``common.language_sample``). The n-grams
are counted in Spark and the counts, bounded by the sample, are broadcast. All
rows are scored whole, by table look-ups over arrays of bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import annotate, flat_text, language_sample, lower_table

ORDER = 3  # longest context in bytes
SAMPLE_BYTES = 1_000_000  # training bytes per language
RUN = 1024  # bytes of a run of a text that is longer than its share of the sample
PAD = 10  # each text is preceded by ORDER newlines
DENSE = 1 << 16  # contexts above which children are found by binary search
UNKNOWN = "und"


def gram_counts(docs: DataFrame, lang_col: str, text_col: str, train: Column,
                sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(lang, n, gram, c): byte n-gram counts of the training sample."""
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()) \
               .select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def cut(raw, start, stop):  # after the bytes before it
        held = np.concatenate([np.full(ORDER, PAD, np.uint8), raw])
        return held[start:stop + ORDER].tobytes()

    sample = language_sample(rows, "ppm", sample_bytes, RUN, cut)

    def count(batches):
        table = lower_table()
        held: dict = {}
        for batch in batches:
            for lang, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = table[np.frombuffer(piece, np.uint8)].astype(np.int64)
                size = len(x) - ORDER
                for n in range(1, ORDER + 2):
                    g = np.zeros(size, np.int64)
                    for j in range(n):
                        at = ORDER - n + 1 + j
                        g = g * 256 + x[at:at + size]
                    u, c = np.unique(g, return_counts=True)
                    d = held.setdefault((lang, n), {})
                    for k, v in zip(u.tolist(), c.tolist()):
                        d[k] = d.get(k, 0) + v
        for (lang, n), d in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(d)), pa.array([n] * len(d), pa.int32()),
                 pa.array(list(d.keys()), pa.int64()), pa.array(list(d.values()), pa.int64())],
                names=["lang", "n", "gram", "c"])

    return sample.mapInArrow(count, "lang string, n int, gram long, c long") \
                 .groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))


class Trees:
    """Code lengths per byte n-gram and language, with the escape costs."""

    def __init__(self, langs: list[str], grams: dict[int, tuple]):
        """grams: n -> (gram, language index, count) arrays."""
        self.langs, size = langs, len(langs)
        self.keys, counts = {}, {}
        for n in range(1, ORDER + 2):
            g, l, c = grams[n]
            pad = int.from_bytes(bytes([PAD]) * n, "big")  # a context, though never counted itself
            self.keys[n], inv = np.unique(np.append(g, pad), return_inverse=True)
            counts[n] = np.zeros((len(self.keys[n]) + 1, size))
            np.add.at(counts[n], (inv[:-1] + 1, l), c)  # row 0: not seen at all
        self.cost, self.escape = {}, {}
        total = counts[1].sum(0)
        distinct = (counts[1] > 0).sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.flat = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0) + 8.0
            seen = -np.log2(counts[1] / (total + distinct))
            self.cost[1] = np.where(counts[1] > 0, seen, self.flat)
            for n in range(2, ORDER + 2):
                ctx = self.index(n - 1, self.keys[n] >> 8)  # the first n - 1 bytes
                total = np.zeros_like(counts[n - 1])
                distinct = np.zeros_like(counts[n - 1])
                np.add.at(total, ctx, counts[n][1:])
                np.add.at(distinct, ctx, counts[n][1:] > 0)
                total[0] = distinct[0] = 0
                self.escape[n - 1] = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0)
                lower = self.cost[n - 1][self.index(n - 1, self.keys[n] & ((1 << 8 * (n - 1)) - 1))]
                seen = -np.log2(counts[n][1:] / (total + distinct)[ctx])
                cost = np.where(counts[n][1:] > 0, seen, self.escape[n - 1][ctx] + lower)
                self.cost[n] = np.concatenate([np.zeros((1, size)), cost])
        self.child = {}
        for n in range(2, ORDER + 2):  # (id of the first n - 1 bytes, last byte) -> id
            rows = len(self.keys[n - 1]) + 1
            at = self.index(n - 1, self.keys[n] >> 8) * 256 + (self.keys[n] & 255)
            if rows <= DENSE:
                dense = np.zeros(rows * 256, np.int32)
                dense[at] = np.arange(1, len(at) + 1)
                dense[:256] = 0
                self.child[n] = dense
            else:
                order = np.argsort(at)
                self.child[n] = (at[order], (order + 1).astype(np.int32))

    def index(self, n: int, grams: np.ndarray) -> np.ndarray:
        keys = self.keys[n]
        if not len(keys):
            return np.zeros(len(grams), np.int64)
        i = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        return np.where(keys[i] == grams, i + 1, 0)

    def step(self, n: int, ids: np.ndarray, byte: np.ndarray) -> np.ndarray:
        at, child = ids.astype(np.int64) * 256 + byte, self.child[n]
        if not isinstance(child, tuple):
            return child[at]
        keys, to = child
        if not len(keys):
            return np.zeros(len(at), np.int32)
        i = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
        return np.where(keys[i] == at, to[i], 0)

    def lengths(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length in bits per (text, language)."""
        rows = np.flatnonzero(np.diff(off) > 0)
        bits = np.zeros((len(off) - 1, len(self.langs)))
        if not len(rows) or not len(self.langs):
            return bits
        # newlines before every text, so that contexts never cross texts
        begin = off[rows] + ORDER * np.arange(len(rows))
        x = np.full(len(raw) + ORDER * len(rows), PAD, np.uint8)
        place = np.arange(len(raw)) + ORDER * np.repeat(np.arange(1, len(rows) + 1), np.diff(off)[rows])
        x[place] = raw
        one = np.zeros(256, np.int32)
        one[self.keys[1]] = np.arange(1, len(self.keys[1]) + 1)
        ids = {1: one[x]}
        for n in range(2, ORDER + 2):
            ids[n] = np.zeros(len(x), np.int32)
            ids[n][1:] = self.step(n, ids[n - 1][:-1], x[1:])
        top = ids[ORDER + 1][place]
        starts = off[rows]
        missed = np.flatnonzero(top == 0)
        at, doc = place[missed], np.searchsorted(starts, missed, "right") - 1
        for l in range(len(self.langs)):
            total = np.add.reduceat(np.ascontiguousarray(self.cost[ORDER + 1][:, l])[top], starts)
            if len(missed):
                extra = np.full(len(at), self.flat[l])
                c1 = ids[1][at]
                extra = np.where(c1 > 0, self.cost[1][c1, l], extra)
                for n in range(2, ORDER + 2):
                    c, ctx = ids[n][at], ids[n - 1][at - 1]
                    extra = np.where(c > 0, self.cost[n][c, l], self.escape[n - 1][ctx, l] + extra)
                total += np.bincount(doc, extra, len(starts))
            bits[rows, l] = total
        return bits


def has_letter(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    found = np.zeros(len(off) - 1, bool)
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = True
    rows = np.flatnonzero(np.diff(off) > 0)
    if len(rows):
        found[rows] = np.logical_or.reduceat(letter[raw], off[rows])
    for i in np.flatnonzero(~found):
        if off[i + 1] > off[i]:
            found[i] = any(c.isalpha() for c in raw[off[i]:off[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def identify(docs: DataFrame, train: Column, lang_col: str = "lang", text_col: str = "text",
             keep: list[str] | None = None, out: str = "ppm",
             sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``docs`` with a struct column ``out``: ``lang`` (a learned language, or
    ``und`` if the text is null or has no letter), ``score`` (its posterior
    under equal priors, 0 for ``und``) and ``bits`` (its code length).

    ``train`` selects the rows to learn from; those with a null language or
    text are not used. Without any, every text is ``und``. Ties go to the
    first language by name. A column called ``out`` is replaced."""
    counts = gram_counts(docs, lang_col, text_col, train, sample_bytes).toArrow()  # bounded by the sample
    names = np.array(counts.column("lang").to_pylist(), object)
    langs = sorted(set(names.tolist()))
    lang = np.searchsorted(np.array(langs, object), names) if langs else np.zeros(0, int)
    n, gram, c = (counts.column(x).to_numpy() for x in ("n", "gram", "c"))
    grams = {k: (gram[n == k], lang[n == k], c[n == k]) for k in range(1, ORDER + 2)}
    shared = docs.sparkSession.sparkContext.broadcast((langs, grams))

    def make():
        trees, table = Trees(*shared.value), lower_table()
        labels = np.array([*trees.langs, UNKNOWN], object)

        def work(text):
            raw, off = flat_text(text)
            known = has_letter(raw, off) & bool(trees.langs)
            bits = trees.lengths(table[raw], off)
            best = np.where(known, bits.argmin(1) if trees.langs else 0, len(trees.langs))
            least = bits.min(1) if trees.langs else np.zeros(len(text))
            odds = np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
            score = np.where(known, 1 / np.maximum(odds, 1), 0.0)
            return [pa.array(labels[best].tolist(), pa.string()), pa.array(score),
                    pa.array(np.where(known, least, 0.0))]
        return work

    return annotate(docs, text_col, make, "lang string, score double, bits double", out, keep,
                    chunk_bytes=1 << 20)
