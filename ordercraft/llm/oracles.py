"""DuckDB SQL of the queries that SQL can express, written from their contracts.

The other queries have none: trained models, hashed sketches, graphs, tokenizers
and quantised tries are held against brute force in the tests.
"""

# 2 ** 60 as the divisor of 60-bit hashes, the reversed CRC-32
# polynomial 3988292384, and the operators' seeds and parameters.
OP1 = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[j:j + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS j FROM iw WHERE len(w) > 0)),
dw AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
hits AS (
  SELECT p.rid, p.j, x.n, x.item_id
  FROM (SELECT rid, n, j, array_to_string(w[j:j + n - 1], ' ') AS gram
        FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS j
              FROM dw, (SELECT DISTINCT n FROM windows) k)) p
  JOIN windows x ON x.n = p.n AND x.gram = p.gram),
words AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(j, j + n)) AS place FROM hits) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ','
            ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)"""

# Each source's Poisson distribution is summed up step by step; a document is
# repeated once per step that its uniform number passes.
OP6 = """
WITH RECURSIVE s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT sum(n) AS rows, sum(pow(CAST(n AS DOUBLE), 0.7)) AS mass FROM s),
r AS (SELECT source, pow(CAST(n AS DOUBLE), 0.7) / mass * rows / n AS lam FROM s, t),
p AS (SELECT source, lam, 0 AS k, exp(-lam) AS q, exp(-lam) AS cdf FROM r
      UNION ALL SELECT source, lam, k + 1, q * lam / (k + 1), cdf + q * lam / (k + 1) FROM p WHERE k < lam + 12 * sqrt(lam) + 30),
key AS (SELECT row_number() OVER () AS rid, *, CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|'
          || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
u AS (SELECT *, CAST('0x' || substr(md5(CAST(h AS VARCHAR) || '|0'), 1, 15) AS BIGINT) / 1152921504606846976.0 AS u FROM key),
c AS (SELECT u.rid, count(*) AS n FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source AND p.cdf <= u.u GROUP BY u.rid)
SELECT doc_id, text, lang, source, n_chars, i AS copy, CAST('0x' || substr(md5('shuffle|' || CAST(h AS VARCHAR) || '|'
  || CAST(i AS VARCHAR)), 1, 15) AS BIGINT) AS mix_key
FROM (SELECT key.*, unnest(range(c.n)) AS i FROM key JOIN c USING (rid))"""

# DuckDB has no CRC-32: the table of 256 entries comes from its rule, the checksum
# from a fold over the bytes.
OP4 = """
WITH tab AS (SELECT list(c ORDER BY i) AS crc FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
  FROM range(256) r(i))),
d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS len FROM documents),
z AS (SELECT doc_id, lang, source, len + 16 AS size,
  xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, len),
    lambda i: CAST(('0x' || substr(hex(encode(t)), 2 * i + 1, 2)) AS BIGINT))),
    lambda a, x: xor(a >> 8, crc[xor(a & 255, x) + 1]))) AS text_crc32 FROM d, tab),
h AS (SELECT *, coalesce('s' || source, 'n') AS s, CAST('0x' || substr(md5('interleave-1|' || coalesce(CAST(doc_id AS VARCHAR), '')
  || '|' || CAST(size AS VARCHAR) || '|' || CAST(text_crc32 AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM z),
f AS (SELECT *, (row_number() OVER (PARTITION BY s ORDER BY h, doc_id, size, text_crc32) - 1
  + CAST('0x' || substr(md5('interleave-1|phase|' || s), 1, 15) AS BIGINT) / 1152921504606846976.0)
  / count(*) OVER (PARTITION BY s) AS f FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY f, h, doc_id, size, text_crc32) - 1 AS pos, count(*) OVER () AS n FROM f)
SELECT doc_id, lang, source, size, text_crc32, 'rows' AS law, CAST(pos * 40 // n AS INTEGER) AS shard,
  pos - ((pos * 40 // n) * n + 39) // 40 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p"""

# The checksum of short texts (decimal ids) by the same rule.
CRC_TABLE = """crc_tab AS (SELECT list(c ORDER BY i) AS crc FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
  FROM range(256) r(i)))"""


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text expression, next to ``crc_tab``."""
    return (f"xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), "
            f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))), "
            f"lambda a, x: xor(a >> 8, crc[xor(a & 255, x) + 1])))")


def _merkle_sql(levels: int = 6, top_levels: int = 4) -> str:
    """The levels of the trees one by one: enough for 16 ** levels rows of a source
    and 16 ** top_levels sources."""
    value = "coalesce(CAST(octet_length(encode({0})) AS VARCHAR) || ':' || {0}, '-')"

    def leaf(text):
        vals = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
        return "sha256(" + " || ".join(value.format(v) for v in vals) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [CRC_TABLE, f"""
d AS (SELECT *, row_number() OVER () AS rid, coalesce('s' || source, 'n') AS s, {leaf('text')} AS leaf,
  CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {leaf(lower)} END AS changed FROM documents, crc_tab)""", """
d0 AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p,
  count(*) OVER (PARTITION BY s) AS n, coalesce(changed, leaf) AS cur, '' AS proof FROM d)""", """
n0 AS (SELECT s, p, n, leaf AS x FROM d0)"""]

    def climb(k, total, doc, node):
        for i in range(k, total):
            ctes.append(f"""
r{node}{i} AS (SELECT s, p // 16 AS p, any_value(n) AS n, string_agg(x, '' ORDER BY p) AS run FROM {node}{i} GROUP BY s, p // 16)""")
            ctes.append(f"""
{node}{i + 1} AS (SELECT s, p, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(run) ELSE run END AS x FROM r{node}{i})""")
            ctes.append(f"""
{doc}{i + 1} AS (SELECT t.* REPLACE (t.p // 16 AS p, (t.n + 15) // 16 AS n,
    CASE WHEN t.n > 1 THEN sha256(substr(run, 1, 64 * (t.p % 16)) || cur || substr(run, 64 * (t.p % 16) + 65)) ELSE cur END AS cur,
    CASE WHEN t.n > 1 THEN proof || substr(run, 1, 64 * (t.p % 16)) || substr(run, 64 * (t.p % 16) + 65) ELSE proof END AS proof)
  FROM {doc}{i} t JOIN r{node}{i} r ON r.s = t.s AND r.p = t.p // 16)""")

    climb(0, levels, "d", "n")
    ctes.append(f"""
subs AS (SELECT s, x AS subroot, row_number() OVER (ORDER BY CASE WHEN s = 'n' THEN NULL ELSE s END NULLS FIRST) - 1 AS p,
  count(*) OVER () AS n FROM n{levels})""")
    ctes.append("""
m0 AS (SELECT 'all' AS s, p, n, subroot AS x FROM subs)""")
    ctes.append(f"""
e0 AS (SELECT 'all' AS s, u.p, u.n, doc_id, leaf, subroot, cur, proof FROM d{levels} t JOIN subs u ON u.s = t.s)""")
    climb(0, top_levels, "e", "m")
    return "WITH " + ",".join(ctes) + f"""
SELECT doc_id, leaf, subroot, x AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = x AS verified
FROM e{top_levels} JOIN m{top_levels} USING (s)"""


OP11 = _merkle_sql()

# Prefixes are running lists of turn digests; a node's subtree totals come from
# joining every node to the prefixes of its smallest member.
OP12 = f"""
WITH {CRC_TABLE},
t AS (SELECT conv_id AS c, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS x,
  octet_length(encode(coalesce(text, ''))) AS bytes,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, count(*) AS n FROM t GROUP BY c),
cv AS (SELECT o.c, o.c - o.c % 5 AS b, {crc32_sql('CAST(o.c AS VARCHAR)')} % 9 AS h, o.n FROM own o, crc_tab),
cw AS (SELECT cv.*, least(h, coalesce(own.n, 0)) AS taken FROM cv LEFT JOIN own ON own.c = cv.b),
r AS (SELECT cw.c, t.pos, x, bytes FROM cw JOIN t ON t.c = cw.b AND t.pos <= cw.h
  UNION ALL SELECT cw.c, t.pos - h + taken, x, bytes FROM cw JOIN t ON t.c = cw.c AND t.pos > cw.h),
p AS (SELECT c, pos AS depth, bytes, md5(string_agg(x, '') OVER (PARTITION BY c ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS k,
  lead(pos) OVER (PARTITION BY c ORDER BY pos) IS NULL AS ends FROM r
  UNION ALL SELECT cw.c, 0, 0, 'root', c NOT IN (SELECT c FROM r) FROM cw),
nodes AS (SELECT depth, k, min(c) AS c, count(*) AS n_convs, max(bytes) AS bytes,
  sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256
  FROM p GROUP BY depth, k),
up AS (SELECT v.depth, v.k, u.c AS parent FROM nodes v JOIN p q ON q.c = v.c AND q.depth = v.depth - 1
  JOIN nodes u ON u.depth = q.depth AND u.k = q.k),
kids AS (SELECT parent, depth - 1 AS depth, count(*) AS n FROM up GROUP BY ALL),
w AS (SELECT v.*, coalesce(kids.n, 0) AS n_children FROM nodes v LEFT JOIN kids ON kids.parent = v.c AND kids.depth = v.depth),
sub AS (SELECT q.depth, q.k, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
  sum((v.n_convs - 1) * v.bytes) AS saved FROM w v JOIN p q ON q.c = v.c AND q.depth <= v.depth GROUP BY q.depth, q.k)
SELECT w.c AS conv_id, CAST(w.depth AS BIGINT) AS depth, up.parent AS parent_conv_id, w.n_convs, w.n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN sub USING (depth, k) LEFT JOIN up USING (depth, k)"""

ORACLE = {"op1_suffix_decontamination": OP1, "op4_stratified_interleaving": OP4,
          "op6_poisson_mixture": OP6, "op11_merkle_manifest": OP11,
          "op12_prefix_trie": OP12}
