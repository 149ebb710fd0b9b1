"""Benchmark decontamination by suffix arrays over the training texts.

The documents are cut into shards of a few MB inside the tasks that read
them. A shard's words become integers (the benchmark's vocabulary; any other
word is 0 and ends a match) and a suffix array is sorted over all positions
by prefix doubling. Every suffix of every benchmark item is then searched by
binary search, each distinct window once; from every place that is found the
longest verbatim match follows from the ranks of the windows after it, and is
reported with its places in both texts. Repetitive texts cost what others do:
no pair of occurrences is listed.

The job has no shuffle: a document lies in one shard, so its hits are
complete there, and a lost task only repeats its own shards. The benchmark is
a query set. It is sent to the tasks in blocks of a bounded size
(``BLOCK_BYTES``); a larger benchmark takes one pass per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TMP, annotate, flat_text, word_table

WINDOW = 13
BLOCK_BYTES = 4 << 20  # benchmark text that is searched in one pass
PIECE_PAIRS = 4 << 20  # (document, item) pairs that are told apart at a time
SPANS = "array<struct<item_id:string,item_start:int,doc_start:int,n_words:int>>"
HITS = "array<struct<start:int,stop:int>>"
FIELDS = f"n_words long, hits {HITS}, items array<string>, matches {SPANS}"


def byte_words(text: bytes, table: bytes) -> list[bytes]:
    return text.translate(table).split()


def _table() -> bytes:
    t = word_table()
    t[t == 0] = 32
    return t.tobytes()


class ItemIndex:
    """Vocabulary and window patterns of one block of benchmark items."""

    def __init__(self, items: list[tuple], window: int):
        table = _table()
        self.vocab: dict[bytes, int] = {}
        self.ids, seqs = [], []
        for item_id, text in items:
            words = byte_words((text or "").encode("utf-8", "surrogatepass"), table)
            if words:
                self.ids.append(None if item_id is None else str(item_id))
                seqs.append([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words])
        self.bits = max(1, len(self.vocab).bit_length())
        self.k = max(1, 62 // self.bits)  # words in one packed key
        self.segments = -(-window // self.k)
        pats, item, start, width = [], [], [], []
        for i, seq in enumerate(seqs):
            w = min(window, len(seq))
            for j in range(len(seq) - w + 1):
                pats.append(seq[j:j + w] + [0] * (self.segments * self.k - w))
                item.append(i)
                start.append(j)
                width.append(w)
        item, start, width = (np.array(x, np.int64) for x in (item, start, width))
        p = np.array(pats, np.int64).reshape(len(pats), self.segments, self.k)
        shift = self.bits * np.arange(self.k - 1, -1, -1, dtype=np.int64)
        rows = np.column_stack([(p << shift).sum(2), width])
        # each distinct window once; its occurrences in the items beside it
        rows, self.window = np.unique(rows, axis=0, return_inverse=True)
        self.window = self.window.reshape(-1)
        self.keys, self.width = rows[:, :-1], rows[:, -1]
        self.item, self.start = item, start  # of each window of the items, in their order
        used = np.clip(self.width[:, None] - self.k * np.arange(self.segments), 0, self.k)
        full = (1 << (self.bits * self.k)) - 1
        self.masks = full - ((np.int64(1) << (self.bits * (self.k - used))) - 1)
        pairs = np.unique(self.window * max(len(seqs), 1) + item) if len(item) else np.zeros(0, np.int64)
        self.holders = pairs % max(len(seqs), 1)  # items with each window
        self.held = np.searchsorted(pairs // max(len(seqs), 1), np.arange(len(self.keys) + 1))
        self.size = window


def suffix_array(ids: np.ndarray, index: ItemIndex, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions sorted by their next ``depth`` words, packed key per position).
    Positions that start with a foreign word cannot match and are left out."""
    n, k, bits = len(ids), index.k, index.bits
    padded = np.concatenate([ids, np.zeros(k, np.int64)])
    key, alive = padded[:n].copy(), padded[:n] != 0
    for j in range(1, k):
        nxt = padded[j:j + n]
        alive &= nxt != 0
        key <<= bits
        key += np.where(alive, nxt, 0)
    sa = np.flatnonzero(ids)
    sa = sa[np.argsort(key[sa], kind="stable")]
    ks = key[sa]
    head = np.empty(len(sa), bool)
    head[:1] = True
    head[1:] = ks[1:] != ks[:-1]
    rank = np.zeros(n + 1, np.int64)
    first = np.maximum.accumulate(np.where(head, np.arange(len(sa)), 0))
    rank[sa] = first + 1
    tied = ~head
    tied[:-1] |= ~head[1:]
    idx = np.flatnonzero(tied & ((ks & ((1 << bits) - 1)) != 0))
    while k < depth and len(idx):
        pos = sa[idx]
        pair = rank[pos] * (n + 1) + rank[np.minimum(pos + k, n)]
        order = np.argsort(pair, kind="stable")
        pos, pair = pos[order], pair[order]
        sa[idx] = pos
        head = np.empty(len(idx), bool)
        head[0] = True
        head[1:] = pair[1:] != pair[:-1]
        first = np.maximum.accumulate(np.where(head, np.arange(len(idx)), 0))
        rank[pos] = idx[first] + 1
        tied = ~head
        tied[:-1] |= ~head[1:]
        idx = idx[tied & (pair % (n + 1) != 0)]
        k *= 2
    return sa, key


def search(sa: np.ndarray, key: np.ndarray, index: ItemIndex) -> tuple[np.ndarray, np.ndarray]:
    """[low, high) range of suffixes that start with each pattern."""
    key = np.concatenate([key, np.zeros(index.segments * index.k + 1, np.int64)])

    def bound(upper: bool) -> np.ndarray:
        lo = np.zeros(len(index.keys), np.int64)
        hi = np.full(len(index.keys), len(sa), np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            pos, cmp = sa[mid], np.zeros(len(open_), np.int8)
            for s in range(index.segments):
                want = index.keys[open_, s]
                got = key[pos + s * index.k] & index.masks[open_, s]
                cmp = np.where(cmp == 0, np.sign(got - want), cmp)
            right = (cmp < 0) | (upper & (cmp == 0))
            lo[open_] = np.where(right, mid + 1, lo[open_])
            hi[open_] = np.where(right, hi[open_], mid)

    return bound(False), bound(True)


def shard_matches(text: pa.Array, index: ItemIndex, table: bytes) -> list[pa.Array]:
    """n_words, hits, items and matches of the documents of one shard."""
    raw, off = flat_text(text)
    raw = raw.tobytes()
    get, parts, counts = index.vocab.get, [], np.zeros(len(text), np.int64)
    for i in range(len(text)):
        words = byte_words(raw[off[i]:off[i + 1]], table)
        counts[i] = len(words)
        parts.append(np.fromiter((get(w, 0) for w in words), np.int64, len(words)))
        parts.append(np.zeros(1, np.int64))  # a match never runs into the next text
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(counts + 1)])  # of each document in ids
    sa, key = suffix_array(ids, index, index.segments * index.k)
    lo, hi = search(sa, key, index)
    found = hi - lo
    pat = np.repeat(np.arange(len(found)), found)
    at = np.arange(len(pat)) - np.repeat(np.cumsum(found) - found, found)
    pos = sa[lo[pat] + at]  # at most one window of each width per place
    order = np.argsort(pos, kind="stable")
    pos, pat = pos[order], pat[order]
    item, i_start, d_start, length = longest_matches(pos, pat, index)
    doc = np.searchsorted(begin, d_start, "right") - 1
    # words inside any window, as disjoint spans
    mark = np.zeros(len(ids) + 1, np.int64)
    np.add.at(mark, pos, 1)
    np.add.at(mark, pos + index.width[pat], -1)
    inside = np.concatenate([[False], np.cumsum(mark)[:-1] > 0, [False]])
    h_start = np.flatnonzero(inside[1:] & ~inside[:-1])
    h_stop = np.flatnonzero(~inside[1:] & inside[:-1])
    h_doc = np.searchsorted(begin, h_start, "right") - 1
    n = len(text)
    per_doc = np.bincount(doc, minlength=n)
    names = np.array(index.ids, object)
    pairs = holders(np.searchsorted(begin, pos, "right") - 1, pat, index)
    listed = [sorted({names[x] for x in g if names[x] is not None}) for g in np.split(
        pairs % (len(names) + 1), np.cumsum(np.bincount(pairs // (len(names) + 1), minlength=n))[:-1])] \
        if n else []
    spans = pa.StructArray.from_arrays(
        [pa.array(names[item].tolist(), pa.string()), pa.array(i_start, pa.int32()),
         pa.array(d_start - begin[doc], pa.int32()), pa.array(length, pa.int32())],
        names=["item_id", "item_start", "doc_start", "n_words"])
    hits = pa.StructArray.from_arrays(
        [pa.array(h_start - begin[h_doc], pa.int32()), pa.array(h_stop - begin[h_doc], pa.int32())],
        names=["start", "stop"])
    offs = pa.array(np.concatenate([[0], np.cumsum(per_doc)]), pa.int32())
    h_offs = pa.array(np.concatenate([[0], np.cumsum(np.bincount(h_doc, minlength=n))]), pa.int32())
    return [pa.array(counts), pa.ListArray.from_arrays(h_offs, hits),
            pa.array(listed, pa.list_(pa.string())), pa.ListArray.from_arrays(offs, spans)]


def holders(doc: np.ndarray, pat: np.ndarray, index: ItemIndex) -> np.ndarray:
    """Distinct doc * (items + 1) + item of the items that hold a window of the
    document, expanded in pieces of a bounded size."""
    if not len(index.keys):
        return np.zeros(0, np.int64)
    seen = np.unique(doc * len(index.keys) + pat)
    doc, pat = seen // len(index.keys), seen % len(index.keys)
    count = index.held[pat + 1] - index.held[pat]
    out, done, ends = np.zeros(0, np.int64), 0, np.cumsum(count)
    while done < len(pat):
        base = ends[done - 1] if done else 0
        stop = max(done + 1, int(np.searchsorted(ends, base + PIECE_PAIRS, "right")))
        n = count[done:stop]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(index.held[pat[done:stop]], n)
        out = np.unique(np.concatenate([out, np.repeat(doc[done:stop], n) * (len(index.ids) + 1) + index.holders[at]]))
        done = stop
    return out


def longest_matches(pos: np.ndarray, pat: np.ndarray, index: ItemIndex) -> tuple:
    """(item, item_start, doc_start, words) of the longest verbatim match from each
    place ``pos`` with window ``pat``, less those inside the one before; one item for
    each. Windows of short items are matches of their own.

    The windows of the found places and of the items are ranked together by prefix
    doubling, as far as the longest item reaches; the longest match of a place
    is with an item's neighbour in that order, and its length comes from the ranks.
    No pair of occurrences is ever listed."""
    full = index.width[pat] == index.size
    p, sym = pos[full], pat[full]
    first = np.zeros(len(index.keys), np.int64)  # an occurrence of each window
    first[index.window[::-1]] = np.arange(len(index.window))[::-1]
    short = first[pat[~full]]
    parts = [(index.item[short], index.start[short], pos[~full], index.width[pat[~full]])]
    hit = np.zeros(len(index.keys), bool)
    hit[sym] = True
    own = np.flatnonzero(hit[index.window])  # windows of the items that occur in the texts
    if len(p):
        n_doc, n = len(p), len(p) + len(own)
        symbol = np.concatenate([sym, index.window[own]])
        after = np.full(n + 1, n, np.int32)  # the next window of the same text; n: none
        after[:n_doc - 1][p[1:] == p[:-1] + 1] = np.flatnonzero(p[1:] == p[:-1] + 1) + 1
        run = (index.item[own][1:] == index.item[own][:-1]) & (own[1:] == own[:-1] + 1)
        after[n_doc:n - 1][run] = n_doc + np.flatnonzero(run) + 1
        left = np.arange(n) + 1  # number of windows from each to the end of its run
        ends = np.flatnonzero(after[:n] == n)
        left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1
        ranks, jumps = [np.append(np.unique(symbol, return_inverse=True)[1] + 1, 0).astype(np.int32)], [after]
        while 1 << (len(ranks) - 1) < left[n_doc:].max():
            r, j = ranks[-1].astype(np.int64), jumps[-1]
            ranks.append(np.append(np.unique(r[:n] * (n + 2) + r[j[:n]], return_inverse=True)[1] + 1, 0).astype(np.int32))
            jumps.append(j[j])
        order = np.lexsort((np.arange(n) < n_doc, ranks[-1][:n]))  # of equals, items first
        is_item = order >= n_doc
        seq = np.arange(n)
        before = np.maximum.accumulate(np.where(is_item, seq, -1))
        behind = np.minimum.accumulate(np.where(is_item, seq, n)[::-1])[::-1]
        place = np.empty(n, np.int64)
        place[order] = seq
        best, with_ = np.zeros(n_doc, np.int64), np.zeros(n_doc, np.int64)
        for near in (before[place[:n_doc]], behind[place[:n_doc]]):
            ok = np.flatnonzero((near >= 0) & (near < n))
            other = order[near[ok]]
            a, b, same = ok.astype(np.int32), other.astype(np.int32), np.zeros(len(ok), np.int64)
            for k in range(len(ranks) - 1, -1, -1):
                equal = (ranks[k][a] == ranks[k][b]) & (a < n) & (b < n)
                same += np.where(equal, 1 << k, 0)
                a, b = np.where(equal, jumps[k][a], a), np.where(equal, jumps[k][b], b)
            same = np.minimum(same, np.minimum(left[ok], left[other]))
            longer = same > best[ok]
            best[ok[longer]], with_[ok[longer]] = same[longer], other[longer]
        new = np.ones(n_doc, bool)
        new[1:] = (p[1:] != p[:-1] + 1) | (best[1:] >= best[:-1])
        at = own[with_[new] - n_doc]
        parts.append((index.item[at], index.start[at], p[new], best[new] + index.size - 1))
    item, i_start, d_start, words = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((item, d_start))
    return item[order], i_start[order], d_start[order], words[order]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """The benchmark in driver-side blocks of about ``block_bytes``; one block
    is held at a time by the caller's loop through ``toLocalIterator``."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0))
    rows = benchmark.where(F.col(text_col).isNotNull()) \
                    .select(F.col(id_col).cast("string"), F.col(text_col), size)
    block, held = [], 0
    for item_id, text, n in rows.toLocalIterator():
        block.append((item_id, text))
        held += n
        if held >= block_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


def annotate_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                     item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                     keep: list[str] | None = None, out: str = "contamination",
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (or its ``keep`` columns) with a struct column ``out``:
    ``n_words``; ``hits``, the disjoint spans of words inside any occurrence
    of a window; ``items``, the sorted ids of items with an occurring window;
    ``matches``, the longest verbatim match from each place (of at least a window,
    with one item that has it), less those inside the match before.

    Null and empty texts have no words and no hits. Items without words have
    no window. An item with a null id marks words but is not listed. Repeated
    document or item rows are treated one by one (ids are listed once). A
    column called ``out`` is replaced; other columns pass unchanged."""
    broad = docs.sparkSession.sparkContext
    done = None
    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    block = next(blocks, None)
    while block is not None:
        shared, block = broad.broadcast(block), next(blocks, None)
        cols = keep if keep is None or block is None else [*keep, text_col]

        def make(shared=shared):
            index, tab = ItemIndex(shared.value, window), _table()
            return lambda text: shard_matches(text, index, tab)

        if done is None:
            done = annotate(docs, text_col, make, FIELDS, out, cols)
        else:  # a further block: merge its findings into the earlier ones
            step = annotate(done, text_col, make, FIELDS, f"{TMP}more",
                            None if cols is None else [*cols, out])
            done = step.withColumn(out, F.struct(
                F.col(f"{out}.n_words").alias("n_words"),
                _merge_spans(F.concat(f"{out}.hits", f"{TMP}more.hits")).alias("hits"),
                F.array_sort(F.array_distinct(F.concat(f"{out}.items", f"{TMP}more.items")))
                 .alias("items"),
                F.concat(f"{out}.matches", f"{TMP}more.matches").alias("matches"))) \
                .drop(f"{TMP}more")
    if done is None:  # no items at all: every document is clean

        def none():
            index, tab = ItemIndex([(None, "x")], window), _table()
            index.ids, index.vocab = [None], {}
            return lambda text: shard_matches(text, index, tab)

        done = annotate(docs, text_col, none, FIELDS, out, keep)
    return done


def _merge_spans(spans):
    empty = F.expr(f"cast(array() as {HITS})")
    return F.aggregate(F.array_sort(spans), empty, lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= x["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"),
            F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop")))))
        .otherwise(F.concat(acc, F.array(x))))


def hit_words(out: str = "contamination"):
    return F.aggregate(F.col(f"{out}.hits"), F.lit(0).cast("long"),
                       lambda acc, x: acc + (x["stop"] - x["start"]).cast("long"))


def is_contaminated(out: str = "contamination"):
    n = hit_words(out)
    return (n > 0) & (n * 20 >= F.col(f"{out}.n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated (fewer than one word in twenty
    lies inside a benchmark window), with their own columns."""
    out = options.pop("out", f"{TMP}contamination")
    return annotate_matches(docs, benchmark, out=out, **options) \
        .where(~is_contaminated(out)).drop(out)
