"""The text operators against brute force on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordercraft.llm import (decontaminate, ef_trie_lm, interleave, kneser_ney, order_minhash, poisson_mix,
                            ppm_langid, pruned_graph, token_histogram, toxicity)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall((t or "").translate(LOW))


def prose(rng, n, vocab=400):
    return " ".join(f"w{x}" for x in rng.integers(0, vocab, n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty, long, repeated and hot rows, near copies, a shared passage."""
    rng = np.random.default_rng(1)
    passage = prose(rng, 30)
    out = [(0, None, "en", "a", 0), (1, "", None, "a", 0), (2, "!!! ...", "en", None, 7), (3, "Ünï çödé 7", "fr", "b", 9),
           (4, prose(rng, 30_000), "en", "a", 0), (None, prose(rng, 50), "en", "a", 0)]
    out += [(5, "same row here again and again", "en", "b", 1)] * 2
    base = prose(rng, 200).split()
    for i in range(10, 50):  # near copies with 0 to 5 changed words
        w = list(base)
        for j in rng.integers(0, 200, i % 6):
            w[j] = f"x{rng.integers(0, 9999)}"
        out.append((i, " ".join(w), "en", "a", 1))
    for i in range(50, 90):
        out.append((i, prose(rng, 40) + " " + passage + " " + prose(rng, int(rng.integers(1, 90))), "de", "a", 1))
    out += [(i, "an exact copy of five words", "es", "c", 1) for i in range(90, 120)]
    return out, passage


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows[0], DOCS).withColumn("shard", F.lit("mine")).withColumn("n_words", F.lit(1)).cache()


def brute_hits(text, windows):
    w = words(text)
    hit, items = [0] * len(w), set()
    for n in {len(k) for k in windows}:
        for j in range(len(w) - n + 1):
            found = windows.get(tuple(w[j:j + n]))
            if found:
                items |= found
                hit[j:j + n] = [1] * n
    return len(w), sum(hit), sorted(items)


def test_decontamination(spark, docs, rows):
    data, passage = rows
    p = passage.split()
    bench = [(1, passage), (2, " ".join(p[5:19])), (3, "w1"), (4, None), (5, "  "), (1, passage),
             (None, " ".join(p[:14])), (12, "AN exact-copy")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in bench:
        w = words(t)
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[j:j + n])] |= {str(i)} if i is not None else set()
            windows[tuple(w[j:j + n])] |= set()
    want = Counter()
    for i, t, *_ in data:
        w = words(t)
        hit, items = [0] * len(w), set()
        for k, v in windows.items():
            for j in range(len(w) - len(k) + 1):
                if tuple(w[j:j + len(k)]) == k:
                    items |= v
                    hit[j:j + len(k)] = [1] * len(k)
        want[(i, len(w), sum(hit), tuple(sorted(items)))] += 1
    for block in (1 << 20, 60):  # one block, then several
        d = decontaminate.annotate_matches(docs, b, block_bytes=block)
        assert d.columns == [*docs.columns, "contamination"]
        got = Counter((r.doc_id, r.c.n_words, r.h, tuple(r.c["items"])) for r in d.select(
            "doc_id", F.col("contamination").alias("c"), decontaminate.hit_words().alias("h")).collect())
        assert got == want
    m = d.where("doc_id = 50").first().contamination.matches
    assert any(x.item_id == "1" and x.n_words == 30 and x.item_start == 0 and x.doc_start == 40 for x in m)
    none = decontaminate.decontaminate(docs, b.limit(0))
    assert none.count() == len(data) and none.columns == docs.columns
    assert decontaminate.decontaminate(docs.limit(0), b).count() == 0


def brute_longest(words_of_doc, items, size=13):
    """(doc_start, words) of the longest match from each place, less those inside the one before."""
    out, before = [], 0
    for j in range(len(words_of_doc)):
        best = 0
        for it in items:
            if len(it) < size:
                if it and words_of_doc[j:j + len(it)] == it:
                    out.append((j, len(it)))
                continue
            for i in range(len(it) - size + 1):
                k = 0
                while i + k < len(it) and j + k < len(words_of_doc) and it[i + k] == words_of_doc[j + k]:
                    k += 1
                best = max(best, k if k >= size else 0)
        if best and j + best > before:
            out.append((j, best))
        before = j + best if best else 0
    return sorted(set(out))


def test_decontamination_matches_of_repetitive_texts(spark):
    rng = np.random.default_rng(31)
    items = [["a"] * 40, ["a", "b"] * 20, prose(rng, 60, 4).split(), ["c"] * 20 + ["d"] * 20, ["x", "y", "z"]]
    texts = [["a"] * 70, ["a"] * 10 + ["b", "a"] * 30, items[2][5:50] + ["q"] + items[2][20:] * 2, ["c"] * 50 + ["d"] * 9,
             ["x", "y", "z", "x", "y", "z"] * 3, ["a"] * 12, prose(rng, 300, 3).split()]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    for r in decontaminate.annotate_matches(d, b).collect():
        t, m = texts[r.doc_id], r.contamination.matches
        assert sorted({(x.doc_start, x.n_words) for x in m}) == brute_longest(t, items), r.doc_id
        for x in m:
            it = items[int(x.item_id)]
            assert it[x.item_start:x.item_start + x.n_words] == t[x.doc_start:x.doc_start + x.n_words]


def test_decontamination_of_a_million_equal_words():
    import resource
    import pyarrow as pa
    index, table = decontaminate.ItemIndex([(1, "a " * 2000), (2, "a " * 500)], 13), decontaminate._table()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    n, hits, items, matches = decontaminate.shard_matches(pa.array(["a " * 1_000_000]), index, table)
    assert n[0].as_py() == 1_000_000 and items[0].as_py() == ["1", "2"]
    assert hits[0].as_py() == [{"start": 0, "stop": 1_000_000}]
    m = matches[0].as_py()
    assert m[0] == {"item_id": "1", "item_start": 0, "doc_start": 0, "n_words": 2000}
    assert len(m) == 1_000_000 - 2000 + 1
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 3000  # MB


def test_interleaving(spark, docs, rows):
    got = interleave.shard_documents(docs, 7).collect()
    assert len(got) == len(rows[0])
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    per = Counter((r.source, r.shard) for r in got)
    total = Counter(r.source for r in got)
    assert all(abs(per[s, k] - total[s] / 7) <= 2 for s in total for k in range(7))
    texts = {r[0]: r[1] or "" for r in rows[0]}
    assert all(r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
               and r.grown_shard is None for r in got)
    again = {(r.doc_id, r.shard, r.slot) for r in interleave.shard_documents(docs.repartition(5), 7).collect()
             if r.doc_id != 5}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got if r.doc_id != 5}
    assert interleave.shard_documents(docs.limit(0), 7).count() == 0


def md5_60(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def test_poisson_mixture(spark, docs, rows):
    n = Counter(r[3] for r in rows[0])
    mass = sum(c ** 0.7 for c in n.values())
    want = Counter()
    for i, t, _, s, _ in rows[0]:
        lam = (n[s] ** 0.7 / mass) * len(rows[0]) / n[s]
        key = md5_60("mix-1", "" if i is None else i, hashlib.md5((t or "").encode()).hexdigest())
        u, k, p = md5_60(key, 0) / 2 ** 60, 0, math.exp(-lam)
        c = p
        while c <= u:
            k += 1
            p *= lam / k
            c += p
        want[i] += k
    got = Counter(r.doc_id for r in poisson_mix.poisson_mix(docs).collect())
    assert got == +want
    w = spark.createDataFrame([("c", 1.0), ("gone", 3.0)], "source string, weight double")
    big = poisson_mix.poisson_mix(docs, w, target_rows=30_000)  # rate 1000: split into parts
    counts = Counter(r.doc_id for r in big.select("doc_id", "copy").collect())
    assert set(counts) == set(range(90, 120)) and all(800 < c < 1200 for c in counts.values())
    assert abs(sum(counts.values()) - 30_000) < 1000
    assert big.select("doc_id", "copy").distinct().count() == sum(counts.values())
    assert poisson_mix.poisson_mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot_keys", [1000, 6, 1])
def test_order_minhash(spark, docs, rows, monkeypatch, hot_keys):
    """All keys, the two large groups, or no key take the broadcast way."""
    monkeypatch.setattr(order_minhash, "HOT_KEYS", hot_keys)

    def shingles(t):
        w = words(t)
        return frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()

    data = rows[0]
    sh = [shingles(r[1]) for r in data]
    root = list(range(len(data)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in range(len(data)):
        for b in range(a):
            if sh[a] and sh[b] and len(sh[a] & sh[b]) >= 0.8 * len(sh[a] | sh[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    lowest = {}
    for i, r in enumerate(data):
        lowest.setdefault(find(i), []).append(r[0])
    want = Counter((r[0], min((x for x in lowest[find(i)] if x is not None), default=None)
                    if None not in lowest[find(i)] else None) for i, r in enumerate(data))
    got = Counter((r.id, r.class_id) for r in order_minhash.classes(docs).collect())
    assert got == want
    kept = order_minhash.near_dedup(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter(min(v, key=lambda x: (x is not None, x)) for v in lowest.values())
    assert order_minhash.near_dedup(docs.limit(0)).count() == 0


def test_alignment_equals_a_plain_one():
    rng = np.random.default_rng(2)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b):
                prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    for _ in range(300):
        a = rng.integers(0, 9, rng.integers(1, 40)).astype(np.uint64)
        b = np.delete(a, rng.integers(0, len(a), 2)) if rng.random() < 0.5 else a.copy()
        for j in rng.integers(0, max(len(b), 1), 2):
            if len(b):
                b[j] = rng.integers(0, 9)
        m = lcs(a.tolist(), b.tolist())
        assert order_minhash.aligned(a, b) == (len(b) > 0 and m >= 0.8 * (len(a) + len(b) - m) - 1e-9)


def test_language(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400)
    extra = spark.createDataFrame([(-1, None, "en", "a", 0), (-2, "", "en", "a", 0), (-3, "123 $$", None, "a", 0),
                                   (-4, "ß", None, None, 0)], DOCS)
    d = d.unionByName(extra).withColumn("train", F.col("doc_id") % 3 != 1)
    got = ppm_langid.identify(d, F.col("train"), keep=["doc_id", "lang", "train"]).collect()
    by = {r.doc_id: r for r in got}
    assert [by[-i].ppm.lang for i in (1, 2, 3)] == ["und"] * 3 and by[-4].ppm.lang in {"en", "de", "fr", "es"}
    held = [r for r in got if not r.train and r.doc_id >= 0]
    assert sum(r.ppm.lang == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.ppm.score <= 1 for r in got)
    none = ppm_langid.identify(d, F.lit(False), keep=["doc_id"]).collect()
    assert {r.ppm.lang for r in none} == {"und"}


def test_language_sample_with_a_long_text_and_a_hot_group(spark):
    """One very long text or copy group neither empties a language's sample nor fills it alone."""
    rng = np.random.default_rng(12)
    bound = 20_000
    data = [("plain", f"{i} " + prose(rng, 300)) for i in range(200)]
    data += [("long", f"{i} " + prose(rng, 20)) for i in range(40)] + [("long", prose(rng, 300_000))]
    data += [("hot", f"{i} " + prose(rng, 20)) for i in range(40)] + [("hot", "copy " * 100)] * 3000
    d = spark.createDataFrame(data, "lang string, text string").repartition(5).cache()
    own = {x: sum(len(t) for t in {t for l, t in data if l == x}) for x in ("plain", "long", "hot")}

    def table(d):
        rows = ppm_langid.gram_counts(d, "lang", "text", F.lit(True), bound).where("n = 1").collect()
        return {x: sum(r.c for r in rows if r.lang == x) for x in own}

    n = table(d)
    assert bound <= n["plain"] <= bound * 1.1
    assert n["hot"] == own["hot"]  # all distinct texts, the copies once
    assert bound <= n["long"] <= 2 * bound and n == table(d.repartition(2))
    short = sum(len(t) for l, t in data if l == "long" and len(t) < 1000)
    assert n["long"] - short <= bound  # the short texts are all in it
    for seed in range(3):  # in whatever order the hashes come
        e = d.withColumn("text", F.concat(F.lit(f"{seed}"), "text"))
        assert all(x >= min(bound, own["hot"]) for x in table(e).values())


def test_code_lengths_equal_a_plain_model():
    text = b"abracadabra banana"
    grams = {n: Counter() for n in range(1, 5)}
    x = b"\n\n\n" + text
    for i in range(3, len(x)):
        for n in range(1, 5):
            grams[n][x[i - n + 1:i + 1]] += 1
    arrays = {n: (np.array([int.from_bytes(g, "big") for g in c]), np.zeros(len(c), int), np.array(list(c.values())))
              for n, c in grams.items()}
    trees = ppm_langid.Trees(["x"], arrays)

    def cost(context, s):
        n = len(context) + 1
        seen = {g[-1:]: c for g, c in grams[n].items() if g[:-1] == context}
        total, kinds = sum(seen.values()), len(seen)
        if s in seen:
            return -math.log2(seen[s] / (total + kinds))
        esc = -math.log2(kinds / (total + kinds)) if total else 0.0
        return esc + (cost(context[1:], s) if context else 8.0)

    for probe in (b"banana bread", b"abra", b"zzz"):
        y = b"\n\n\n" + probe
        want = sum(cost(y[i - 3:i], y[i:i + 1]) for i in range(3, len(y)))
        got = trees.lengths(np.frombuffer(probe, np.uint8), np.array([0, len(probe)]))[0, 0]
        assert abs(got - want) < 1e-6


def test_token_histogram(docs, rows):
    enc = token_histogram.load_encoding()
    n = Counter(len(enc.encode_ordinary(r[1] or "")) for r in rows[0])
    hist = token_histogram.length_histogram(docs).cache()
    got = {r.length: r for r in hist.collect()}
    assert {k: r.n_docs for k, r in got.items()} == dict(n)
    for k, r in got.items():
        assert r.docs_upto == sum(c for x, c in n.items() if x <= k)
        assert r.truncated_tokens == sum(min(x, k) * c for x, c in n.items())
    assert token_histogram.truncated_total(hist, 33).first()[0] == sum(min(x, 33) * c for x, c in n.items())
    flat = sorted(n.elements())
    assert token_histogram.quantile(hist, 0.5).first()[0] == flat[math.ceil(len(flat) / 2) - 1]
    assert token_histogram.length_histogram(docs.limit(0)).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(4)
    for top in (5, 1000, 1 << 40, 1 << 63):
        v = np.unique(rng.integers(0, top, 300, dtype=np.uint64))
        meta = ef_trie_lm.EliasFano.encode(v)
        ef = ef_trie_lm.EliasFano(meta, meta["lows"], meta["highs"])
        assert (ef.get(np.arange(len(v))) == v).all()
        ask = np.concatenate([v, v + np.uint64(1)])
        want = [int(np.searchsorted(v, x)) if x in v else -1 for x in ask]
        assert ef.find(ask).tolist() == want


@pytest.mark.parametrize("spread", [False, True])
def test_trie_scores(docs, rows, spark, monkeypatch, spread):
    if spread:  # many batches and shards, many contexts spread over them
        monkeypatch.setattr(ef_trie_lm, "BATCH_BYTES", 20_000)
        monkeypatch.setattr(ef_trie_lm, "SHARD_BYTES", 20_000)
        monkeypatch.setattr(ef_trie_lm, "HEAVY", 200)
    data = [r for r in rows[0]]
    train = docs.withColumn("t", F.coalesce(F.col("doc_id"), F.lit(0)) % 5 != 1)
    toks = [[*SPACED.findall((r[1] or "").translate(LOW)), None] for r in data]
    use = [(r[0] or 0) % 5 != 1 for r in data]
    c = Counter(w for t, u in zip(toks, use) if u for w in t)
    n, v = sum(c.values()), len(c)
    pairs, kinds = Counter(), Counter()
    for t, u in zip(toks, use):
        if u:
            for a, b in zip(["<s>", *t], t):
                pairs[a, b] += 1
    for a, _ in pairs:
        kinds[a] += 1
    ctx = {**c, "<s>": sum(use)}

    def p1(w):
        return (c[w] + 0.5) / (n + 0.5 * (v + 1))

    def p2(a, b):
        return (max(pairs[a, b] - 0.75, 0) + 0.75 * kinds[a] * p1(b)) / ctx[a] if ctx.get(a) else p1(b)

    want = sorted((r[0] or -1, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10(p1(w)) for w in t), 6),
                   sum(math.log10(p2(a, b)) for a, b in zip(["<s>", *t], t))) for r, t in zip(data, toks))
    got = sorted((r.id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.score)
                 for r in ef_trie_lm.score(train, F.col("t")).collect())
    assert [x[:4] for x in got] == [x[:4] for x in want]
    for a, b in zip(got, want):
        assert abs(a[4] - b[4]) <= 1e-6 * abs(b[4]) + 1e-6 and abs(a[5] - b[5]) <= 2e-3 * abs(b[5])
    assert ef_trie_lm.score(train.limit(0), F.col("t")).count() == 0
    assert {r.n_known for r in ef_trie_lm.score(train.limit(3), F.lit(False)).collect()} == {0}


def test_trie_counts_above_32_bits():
    keys = np.array([3, 9], np.uint64)
    t = ef_trie_lm.Trie(np.array([5], np.uint64), np.array([0]), keys, np.array([1 << 33, 1 << 33]), 0.75)
    codes, total, kinds = t.lookup(np.array([5, 6], np.uint64), np.array([2, 1]), np.array([9, 4, 3], np.uint64))
    assert total.tolist() == [1 << 34, 0] and kinds.tolist() == [2, 0]
    assert [c > 0 for c in codes] == [True, False, False]


def test_frequent_words_of_uneven_batches(spark):
    """A word that is frequent overall is found whatever its share in a batch."""
    def batch(*seen):
        return (bytearray(np.arange(10, 10 + len(seen), dtype=np.int64).tobytes()),
                bytearray(np.array(seen, np.uint32).tobytes()))
    rows = [batch(40, 30, 1, *[1] * 30)] * 3 + [batch(0, 0, 900, 100)]
    table = spark.createDataFrame(rows, "vocab binary, seen binary")
    n = 3 * 101 + 1000
    found = ef_trie_lm.frequent_words(table, n, 4).tolist()
    assert found[0] == ef_trie_lm.BOS and {10, 11, 12, 13} <= set(found) and len(found) <= 1 + 2 * ef_trie_lm.HEAVY


def test_batches_ask_only_owners():
    shard = np.array([2, 2, 2, 7])
    v = np.array([0, 0, 1, 0])
    cells = [(s, a, z, c.tolist(), n.tolist()) for s, a, z, c, n in ef_trie_lm.shard_cells(shard, v)]
    assert cells == [(2, 0, 3, [0, 1], [2, 1]), (7, 3, 4, [0], [1])]


def brute_kneser_ney(sample, texts):
    """log10 probability of each text: interpolated modified Kneser-Ney trigrams by plain counting."""
    def stream(t):
        w = ["<s>", "<s>", *SPACED.findall(t.translate(LOW)), "</s>"]
        return [tuple(w[i:i + 3]) for i in range(len(w) - 2)]

    tri = Counter(x for t in sample for x in stream(t))
    bi = Counter(x[1:] for x in tri)  # continuations
    uni = Counter(x[1] for x in bi)
    orders = [tri, bi, Counter({(w,): c for w, c in uni.items()})]
    cuts, total, mass = [], [], []
    for counts in orders:
        n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        if n[0] and n[1]:
            y = n[0] / (n[0] + 2 * n[1])
            raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
            d = [min(max(v, 0.05), k - 0.05) for v, k in zip(raw, (1, 2, 3))]
        else:
            d = [0.5, 0.75, 0.9]
        cuts.append(d)
        total.append(defaultdict(float))
        mass.append(defaultdict(float))
        for x, c in counts.items():
            total[-1][x[:-1]] += c
            mass[-1][x[:-1]] += d[min(c, 3) - 1]

    def p(gram, k=0):
        if k == 3:
            return 1 / (len(uni) + 1)
        context, c = gram[:-1], orders[k].get(gram, 0)
        if context not in total[k]:
            return p(gram[1:], k + 1)
        share = (c - cuts[k][min(c, 3) - 1]) / total[k][context] if c else 0
        return share + mass[k][context] / total[k][context] * (p(gram[1:], k + 1) if k < 2 else 1 / (len(uni) + 1))

    return [sum(math.log10(p(x)) for x in stream(t)) for t in texts]


def test_kneser_ney_against_plain_counts(spark, monkeypatch):
    rng = np.random.default_rng(21)
    sample = [prose(rng, int(n), 30) for n in rng.integers(0, 60, 80)] + ["a b c a b d", "B C a b c", "c c a", "c c a"]
    texts = [prose(rng, int(n), 35) for n in rng.integers(0, 50, 40)] + ["", "never seen words", "a", "a b c a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trusted = spark.createDataFrame([(t,) for t in sample], "text string")
    got = {r.doc_id: r for r in kneser_ney.perplexities(docs, trusted).collect()}
    want = brute_kneser_ney(sorted({t for t in sample if t}), texts)
    for i, (t, x) in enumerate(zip(texts, want)):
        assert abs(got[i].kn.log10_prob - x) < 1e-4 * max(1, abs(x)), t
        assert got[i].kn.n_tokens == len(t.split()) + 1


def test_kneser_ney(spark, docs):
    sample = spark.createDataFrame([("a b c a b d",), ("b c a b c",), ("c c a",)], "text string")
    m = kneser_ney.unpack_model(kneser_ney.train(sample))
    held = [k for k, _ in m["a1"].parts]
    vocab = np.unique(np.concatenate([x for x in (kneser_ney.trigram_counts(sample).select("w").distinct().toArrow()
                                                  .column("w").to_numpy().view(np.uint64),)]))
    assert sum(map(len, held)) == len(vocab)
    assert len(vocab) == m["words"] == 5
    for u, v in ((1, 1), (int(vocab[0]), int(vocab[1])), (77, 78)):
        u, v = (np.full(len(vocab) + 1, x, np.uint64) for x in (u, v))
        p = 10 ** kneser_ney.log_probabilities(m, u, v, np.append(vocab, np.uint64(99)))
        assert abs(p.sum() - 1) < 1e-6
    got = {r.doc_id: r for r in kneser_ney.classify(docs, docs.where("doc_id >= 10").select("text")).collect()}
    assert got[0].perplexity is None and not got[0].good and got[90].good
    assert got[90].perplexity < got[3].perplexity
    assert kneser_ney.classify(docs.limit(0), docs.select("text").limit(0)).count() == 0


def test_kneser_ney_ids_clashes_and_repeats(spark, docs):
    """Trusted rows by id give the model of these rows; repeated rows, long texts and
    columns with the results' names in other letters do no harm."""
    ids = docs.where("doc_id >= 10").select("doc_id")
    a = kneser_ney.classify(docs, docs, ids=ids)
    b = kneser_ney.classify(docs, docs.join(ids.distinct(), "doc_id"))
    cols = ["doc_id", "n_tokens", "log10_prob", "good"]
    assert a.count() == docs.count() and a.select(cols).exceptAll(b.select(cols)).count() == 0
    odd = docs.select("doc_id", "text", F.lit("mine").alias("Perplexity"), F.lit(1).alias("GOOD"))
    out = kneser_ney.classify(odd, docs)
    assert out.count() == docs.count() and sorted(c.lower() for c in out.columns).count("good") == 1


def test_kneser_ney_learns_a_rare_language(spark):
    """A language with one of a hundred trusted texts is learned from all it has."""
    rng = np.random.default_rng(13)

    def text(mark, order):
        w = [f"{mark}{i}" for i in range(40)]
        start = int(rng.integers(0, 40))
        return " ".join(w[(start + i) % 40] if order else w[int(rng.integers(0, 40))] for i in range(60))

    big = [(i, f"n{i} " + text("b", True), "big") for i in range(3000)]
    rare = [(i, f"n{i} " + text("r", True), "rare") for i in range(3000, 3030)]
    none = [(i, f"n{i} " + text("z", True), None) for i in range(3030, 3040)]
    trusted = spark.createDataFrame(big + rare + none, "doc_id long, text string, lang string")
    probe = [(i, text(m, i < 5), {"b": "big", "r": "rare"}.get(m), m) for m in "brz" for i in range(10)]
    docs = spark.createDataFrame(probe, "doc_id long, text string, lang string, mark string")
    got = kneser_ney.perplexities(docs, trusted, keep=["doc_id", "mark"], sample_rows=50).collect()
    worst = {m: max(r.kn.perplexity for r in got if r.mark == m and r.doc_id < 5) for m in "brz"}
    assert max(worst.values()) < 3  # the next word is nearly certain
    assert all(r.kn.perplexity > 10 for r in got if r.doc_id >= 5)
    n = {r.lang: r.n for r in kneser_ney.trusted_sample(trusted, sample_rows=50).groupBy("lang").agg(
        F.count("*").alias("n")).collect()}
    assert n == {"=big": 50, "=rare": 30, "": 10}


def test_kneser_ney_packed_tables():
    rng = np.random.default_rng(15)
    keys = np.append(rng.integers(0, 1 << 64, 5000, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64))
    got, value = kneser_ney.unpacked(*kneser_ney.packed(keys, np.arange(len(keys))))
    order = np.argsort(keys & kneser_ney.LOW)
    assert (got == (keys & kneser_ney.LOW)[order]).all() and (value == order).all()


def test_kneser_ney_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "TOTAL_BYTES", 40_000)
    monkeypatch.setattr(kneser_ney, "RUN", 500)
    rng = np.random.default_rng(14)
    data = [("a", f"{i} " + prose(rng, 100)) for i in range(300)] + [("b", prose(rng, 50_000)), ("b", "é " * 40), ("a", "x" * 90_000)]
    rows = kneser_ney.trusted_sample(spark.createDataFrame(data, "lang string, text string")).collect()
    size = {x: sum(len(r.text.encode()) for r in rows if r.lang == x) for x in ("=a", "=b")}
    assert 19_000 <= size["=a"] <= 22_000 and 15_000 <= size["=b"] <= 40_000
    seen = {w for _, t in data for w in t.split()}
    assert all(w in seen for r in rows for w in r.text.split())  # no word is cut


def test_toxicity(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    d = d.unionByName(spark.createDataFrame([(-1, None, None, None, 0), (-2, "", "en", "a", 0)], DOCS))
    d = d.withColumn("held", F.pmod("doc_id", F.lit(5)) == 0)
    s = toxicity.score(d, labels, ~F.col("held"), keep=["doc_id", "held"]).cache()
    assert s.count() == 1002
    rows = s.where("held").join(labels, "doc_id").collect()
    pos, neg = ([r.score for r in rows if r.toxic == k] for k in (1, 0))
    auc = np.mean([[1.0 if p > q else 0.5 * (p == q) for q in neg] for p in pos])
    assert auc > 0.85
    assert s.where("score < 0 or score > 1 or predicted != int(score >= 0.5)").count() == 0
    flat = toxicity.score(d, labels.where("toxic = 0"), ~F.col("held"), keep=["doc_id"])
    assert {r.score for r in flat.select("score").distinct().collect()} == {0.0}


def test_toxicity_repeats_clashes_and_empty_tables(spark):
    texts = ["you are a stupid idiot", "what a nice day it is", None, "", "x " * 20_000]
    data = [(i if i != 7 else None, texts[i % 5], float(i), "own", i) for i in range(60)] + [(3, "", 0.5, "hot", 1)] * 200
    d = spark.createDataFrame(data, "doc_id long, text string, Score double, features string, m int")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(60)] + [(1, None), (None, 1)],
                                   "doc_id long, toxic int")
    out = toxicity.score(d, labels, F.lit(True))
    assert [c for c in out.columns] == ["doc_id", "text", "features", "m", "score", "predicted"]
    got = out.collect()
    assert len(got) == 260 and {r.features for r in got} == {"own", "hot"}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    bad, good = ([r.score for r in got if r.text == texts[k]] for k in (0, 1))
    assert min(bad) > max(good)
    assert toxicity.score(d.limit(0), labels, F.lit(True)).count() == 0
    none = toxicity.score(d, labels.limit(0), F.lit(True))
    assert {r.score for r in none.select("score").distinct().collect()} == {0.0}
    one = toxicity.score(d, labels.where("doc_id in (0, 1)"), F.lit(True))  # no part has both classes
    assert one.where("score is null or score < 0 or score > 1").count() == 0


def test_pruned_graph(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 16))
    vecs = [base[i % 60] + rng.normal(scale=0.07, size=16) for i in range(240)]
    vecs += [base[0]] * 40
    data = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    n = len(data)
    odd = [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (n + 3, [None] + [1.0] * 15), (n + 4, []),
           (n + 5, [1.0, 2.0]), (n + 6, [float("inf")] + [1.0] * 15), (None, [5e300] + [0.0] * 15)]
    d = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>")
    x = np.array(vecs)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    low = np.arange(n)
    for _ in range(n):
        new = np.minimum(low, np.where(link, low[None, :], n).min(1))
        if (new == low).all():
            break
        low = new
    res = pruned_graph.links(d)
    got = {r.id: r for r in res.collect()}
    assert all(got[i].n_links == link[i].sum() and got[i].component_id == low[i] and got[i].kept == (low[i] == i)
               for i in range(n))
    assert all(got[n + k].n_links == 0 and got[n + k].component_id == n + k for k in range(7))
    assert got[None].kept is False
    assert pruned_graph.audit_recall(d.where("vec_id is not null"), res) == 1.0
    assert pruned_graph.links(d.limit(0)).count() == 0
    # blocks smaller than a shard
    keep, pruned_graph.BLOCK = pruned_graph.BLOCK, 50
    try:
        again = {r.id: r for r in pruned_graph.links(d).collect()}
    finally:
        pruned_graph.BLOCK = keep
    assert all(again[i].n_links == got[i].n_links and again[i].component_id == got[i].component_id for i in range(n))


def test_pruned_graph_reunites_searches(spark, monkeypatch, tmp_path):
    """Two searches that find nothing at all: the shards' reports differ, and the
    exact comparison brings the links back."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(50, 16))
    x = np.array([base[i % 50] + rng.normal(scale=0.07, size=16) for i in range(240)])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(5)],
                              "vec_id long, embedding array<double>")
    block = None

    def forgetful(index, adjacent, q, threshold):
        found = q @ index.T >= threshold
        for call in range(2):
            try:
                (tmp_path / f"{block}-{call}").touch(exist_ok=False)
                return np.zeros_like(found)
            except FileExistsError:
                pass
        return found

    x = np.concatenate([x, np.repeat(x[:1], 5, 0)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    truth = (x @ x.T >= 0.95).sum(1) - 1
    monkeypatch.setattr(pruned_graph, "audited_search", forgetful)
    monkeypatch.setattr(pruned_graph, "CELL", 80)  # three shards, every vector in each
    for block in (2048, 40):
        monkeypatch.setattr(pruned_graph, "BLOCK", block)
        got = {r.id: r for r in pruned_graph.links(d).collect()}
        assert [got[i].n_links for i in [*range(240), *range(1000, 1005)]] == truth.tolist()
        assert got[0].recall == 1.0
        assert {got[i].component_id for i in range(1000, 1005)} == {0}


def test_pruned_graph_many_cells(spark, monkeypatch):
    """Hundreds of shards: the overlap grows until linked vectors meet, and the
    operator's own recall agrees with brute force."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(1000, 24))
    x = np.array([base[i % 1000] + rng.normal(scale=0.16, size=24) for i in range(3000)])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(pruned_graph, "CELL", 12)
    out = pruned_graph.links(d).persist()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    truth = (x @ x.T >= 0.95).sum(1) - 1
    got = {r.id: r for r in out.collect()}
    held = sum(got[i].n_links for i in range(3000)) / truth.sum()
    assert all(got[i].n_links <= truth[i] for i in range(3000)) and truth.sum() > 1000
    assert held >= 0.97 and abs(got[0].recall - held) < 0.02
    assert pruned_graph.audit_recall(d, out) >= 0.95
    out.unpersist()
    links = np.zeros((3, pruned_graph.MOST_OVERLAP + 2), np.int64)
    assert pruned_graph.overlap_for(links) == pruned_graph.OVERLAP
    links[0, 1], links[1, 5] = 90, 10
    assert pruned_graph.overlap_for(links) == 5
    links[2, -1] = 10  # meet nowhere
    assert pruned_graph.overlap_for(links) == pruned_graph.MOST_OVERLAP


def test_pipeline(spark, docs, rows):
    import corpus_pipeline as cp
    d = docs.drop("shard", "n_words")
    sf = "/root/testdata/sf0.001"
    a = cp.language(spark, d, sf)
    gone = {0, 1, 2}
    assert a.columns == d.columns and not {r.doc_id for r in a.collect()} & gone
    b = cp.near_duplicates(spark, a, sf)
    ids = {r.doc_id for r in b.collect()}
    assert 90 in ids and not ids & set(range(91, 120)) and set(range(50, 90)) <= ids
    e = cp.mixture(spark, d, sf)
    assert e.columns == d.columns
    out = cp.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "shard", "slot"} <= set(out.columns)
    empty = d.limit(0)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0
