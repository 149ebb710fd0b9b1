"""Merkle manifest, conversation trie and forced-boundary BPE against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from ordercraft.llm import forced_bpe, merkle_manifest, prefix_trie, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


@pytest.fixture()
def tables(spark, tmp_path):
    """A folder with the given rows as a table."""
    def write(name, rows, schema):
        df = spark.createDataFrame(rows, schema)
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return write


# ---------------------------------------------------------------- Merkle manifest

def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_leaf(doc, text):
    vals = [doc[0], doc[3], doc[2], doc[4], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in vals))


def brute_tree(nodes):
    """(root, siblings of each node, bottom to top, with its place)."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 16] for i in range(0, len(nodes), 16)]
        for k, i in enumerate(at):
            run = runs[i // 16]
            ways[k].append((i % 16, run[:i % 16] + run[i % 16 + 1:]))
            at[k] = i // 16
        nodes = [sha("".join(r)) for r in runs]
    return nodes[0], ways


def brute_manifest(docs):
    by = defaultdict(list)
    for d in docs:
        by[d[3]].append(d)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        rows = sorted(by[s], key=lambda d: (d[0] is not None, d[0] or 0, brute_leaf(d, d[1])))
        trees[s] = rows, *brute_tree([brute_leaf(d, d[1]) for d in rows])
    root, tops = brute_tree([trees[s][1] for s in order])
    out = []
    for s, top in zip(order, tops):
        rows, subroot, ways = trees[s]
        for d, way in zip(rows, ways):
            leaf, steps = brute_leaf(d, d[1]), way + top
            cur = leaf
            if zlib.crc32(("" if d[0] is None else str(d[0])).encode()) % 5 == 0 and d[1] is not None:
                cur = brute_leaf(d, d[1].translate(LOW))
            for at, sibs in steps:
                cur = sha("".join(sibs[:at] + [cur] + sibs[at:]))
            out.append((d[0], leaf, subroot, root, sha("".join("".join(x) for _, x in steps)), cur, cur == root))
    return out


@pytest.fixture(scope="module")
def leaves():
    """A hot source, lone leaves, runs of one, nulls, repeated rows, equal ids, a long text."""
    rng = random.Random(3)
    out = [(i, f"Text {rng.random()}", "en", "hot", i) for i in range(600)]
    out += [(1000 + i, "Abc", "de", f"s{i}", None) for i in range(20)]
    out += [(2000 + i, "x", None, "seventeen", 1) for i in range(17)]
    out += [(None, "No id", "en", None, 1), (5, None, None, None, None), (5, "", "", "", 0), (10, "", "en", "", 0)]
    out += [(3000, "Same Row", "en", "hot", 8)] * 40 + [(3001, t, "en", "hot", 8) for t in ("b", "a", "C", None)]
    return out + [(4000, "Long Text é " * 100_000, "fr", "hot", 9)]


@pytest.mark.parametrize("floor", [1, 3])  # blocks of 16 leaves: many floors; of 4,096: one
def test_merkle_manifest(tables, spark, leaves, floor, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "FLOOR", floor)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 16 ** floor)
    d = queries.op11_merkle_manifest(spark, tables("documents", leaves, DOCS))
    got = [tuple(r) for r in d.collect()]
    want = brute_manifest(leaves)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert 0 < sum(not r[6] for r in want) < len(want)


def test_merkle_versions_share_all_but_ancestors(spark):
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(700)]
    new = hashlib.sha256(b"new").digest()
    rows = [(i, "s" if i < 650 else "t", x, new if i == 300 else None) for i, x in enumerate(digests)]
    d = merkle_manifest.manifest(spark.createDataFrame(rows, "id long, source string, leaf binary, changed binary"), proofs=True)
    got = {r["id"]: r for r in d.collect()}
    assert [i for i, r in got.items() if r["versioned"]] == [300]
    assert got[300]["folded_root"] != got[300]["root"] == got[0]["folded_root"]
    assert len(got[300]["copies"]) == 4  # three levels of the source, one over the sources
    for r in got.values():  # a proof leads from the leaf to the root
        cur = digests[r["id"]]
        for step in r["proof"]:
            at, sibs = step["at"] * 32, bytes(step["siblings"])
            cur = hashlib.sha256((sibs[:at] + cur + sibs[at:]).hex().encode()).digest()
        assert cur.hex() == r["root"]


def test_merkle_empty(tables, spark):
    d = queries.op11_merkle_manifest(spark, tables("documents", [], DOCS))
    assert d.count() == 0 and "folded_root" in d.columns


# ---------------------------------------------------------------- prefix trie

def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        kids = children[p]
        totals[p] = (sum(totals[k][0] for k in kids) or 1, own + sum(totals[k][1] for k in kids))
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), *totals[p],
             sha(",".join(str(c) for c in sorted(m) if built[c] == p))) for p, m in members.items()]


def turns():
    """Shared starts, equal conversations, a long one, nulls, a lone turn, clashing columns."""
    rng = random.Random(5)
    out = []
    for c in range(300):
        n = rng.randint(0, 9)
        out += [(c, t, rng.choice(["user", "bot"]), rng.choice(["hi", "yes é", "", "no"])) for t in range(n)]
    out += [(1000 + c, t, "user", f"same {t}") for c in range(60) for t in range(4)]
    out += [(2000, t, "user", f"long {t % 7}") for t in range(500)]
    out += [(2001, t, "user", f"long {t % 7}") for t in range(300)]
    out += [(2002, None, "user", "first"), (2002, 0, None, None), (2002, 1, "user", None), (None, 1, "user", "lost")]
    return out + [(5_000_000_003, 0, "user", "far id"), (5_000_000_003, 1, "user", "far id")]


@pytest.mark.parametrize("chunk,growth,ids", [(4096, 16, 65_536), (4, 2, 8)])
def test_prefix_trie(tables, spark, chunk, growth, ids, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "GROWTH", growth)
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", ids)
    rows = turns()
    d = queries.op12_prefix_trie(spark, tables("conversations", rows, "conv_id long, turn int, role string, text string"))
    assert sorted(map(repr, map(tuple, d.collect()))) == sorted(map(repr, brute_trie(rows)))


def test_contraction_of_random_trees(spark, monkeypatch):
    """Any tree whose nodes are named by (path, depth): totals equal plain sums."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 8)
    rng = random.Random(7)
    nodes = {(0, 0): None}
    tips, path = [(0, 0)], 0
    for _ in range(900):
        at = rng.choice(tips[-3:]) if rng.random() < 0.9 else rng.choice(list(nodes))
        below = (at[0], at[1] + 1)
        if below in nodes:
            path += 1
            below = (path, at[1] + 1)
        nodes[below] = at
        tips.append(below)
    kids = defaultdict(int)
    for p in nodes.values():
        kids[p] += 1
    weight = {v: (rng.randint(0, 5), rng.randint(0, 9)) for v in nodes}
    want = dict(weight)
    for v in sorted(nodes, key=lambda v: -v[1]):
        if (p := nodes[v]) is not None:
            want[p] = (want[p][0] + want[v][0], want[p][1] + want[v][1])
    rows = [(*v, *(p or (None, -1)), kids[v], *weight[v]) for v, p in nodes.items()]
    state = spark.createDataFrame(rows, "conv long, depth long, parent long, parent_depth long, kids long, w1 long, w2 long")
    got = prefix_trie.contract(state).collect()
    assert len(got) == len(nodes) and {(r[0], r[1]): (r[2], r[3]) for r in got} == want


def test_trie_of_nothing(tables, spark):
    schema = "conv_id long, turn int, role string, text string, depth string, parent int"
    assert queries.op12_prefix_trie(spark, tables("conversations", [], schema)).count() == 0
    rows = [(7, 0, None, None, "x", 1)]
    got = queries.op12_prefix_trie(spark, tables("conversations", rows, schema)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_trie([r[:4] for r in rows])))


# ---------------------------------------------------------------- forced-boundary BPE

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_str(forced_bpe.read_vocabulary())


ODD_TEXTS = ["", " ", None, "'stop don't we'll I'M '' 's", "ﬁ ﬂ Ünï ÇÖDÉ é Å K ſ", "x<|endoftext|>y <|startoftext|>",
             "<|endoftext|", "\x1c a\x1fb \x85 \xa0c d　e", "漢字かな交じり文 ΣΑΣ İI ß", "a" * 3000, "ab" * 2000,
             "1234567890 ²³ 3.14", "🤖🎉 a🤖b", "\x00\x01\x7f\t\n", "​x‍y", "q̣̇ ́ x", "각가"]


def test_forced_bpe_is_the_library(tables, spark, library):
    rng = random.Random(2)
    letters = [chr(x) for x in (*range(1, 127), 0xE9, 0x301, 0x327, 0x3A3, 0x130, 0x4E00, 0x1F600, 0xA0, 0x2028, 0x85)]
    texts = ODD_TEXTS + ["".join(rng.choices(letters, k=rng.randint(1, 50))) for _ in range(400)]
    texts += ["one long text " * 60_000, "é" * 20_000]
    rows = [(i, t, "en", "s", 1, "mine") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1, "again")]
    d = queries.op13_forced_boundary_bpe(spark, tables("documents", rows, DOCS + ", bpe string"))
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, d.collect())) == sorted(want)


def test_forced_bpe_keeps_columns_and_pieces(spark, library, monkeypatch):
    monkeypatch.setattr(forced_bpe, "PIECE_BYTES", 50)
    monkeypatch.setattr(forced_bpe, "CACHE_WORDS", 3)
    text = "Some words, and some more words; " * 40
    df = spark.createDataFrame([(1, text, "mine"), (2, None, "mine")], "doc_id long, text string, ids string")
    out = forced_bpe.encode(df, out="tokens").collect()
    assert [r["ids"] for r in out] == ["mine", "mine"]
    ids = np.frombuffer(out[0]["tokens"]["ids"], "<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert out[1]["tokens"]["ids"] == b"" and out[1]["tokens"]["decoded"] == ""
    assert forced_bpe.encode(df.limit(0)).count() == 0


def test_certain_cuts_are_inside_no_token(library):
    coder = forced_bpe.ForcedBoundaryEncoder(forced_bpe.read_vocabulary())
    cuts = 0
    for word in ("ndedti", "qjx", "zzqqw", "xkcdvbn", "jqzx"):
        fragments = coder.cut(word.encode())
        assert b"".join(f for f, _ in fragments) == word.encode()
        cuts += len(fragments) - 1
        for (a, _), (b, _) in zip(fragments, fragments[1:]):
            pair = (a[-1:] + b[:1]).decode()
            assert not any(pair in t.removesuffix("</w>")[:-1] for t in coder.names[:49406])
    assert cuts > 0
