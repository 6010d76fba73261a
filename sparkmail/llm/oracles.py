"""DuckDB SQL for the ``opN_*`` queries that SQL can state."""

ORACLE = {}

ORACLE["op1_url_filter"] = """
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r AS (
  SELECT *,
         CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM u)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

ORACLE["op2_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def _matches(name, pattern, keep, part=None):
    """A list of (start, end) of a pattern's matches in column t; both found from the gaps between them."""
    pattern = pattern.replace("'", "''")
    m, g = f"regexp_extract_all(t, '{pattern}')", f"string_split_regex(t, '{pattern}')"
    p = f"regexp_extract_all(t, '{pattern}', {part})" if part else m
    return f"""
  {name}_m AS (SELECT doc_id, t, {m} AS m, list_transform({m}, lambda x: length(x)) AS lm,
                      list_transform({g}, lambda x: length(x)) AS lg, {p} AS p FROM d),
  {name} AS (SELECT doc_id, unnest(list_filter(list_transform(m, lambda x, i: {{
                 's': list_sum(lg[1:i]) + coalesce(list_sum(lm[1:i-1]), 0),
                 'e': list_sum(lg[1:i]) + list_sum(lm[1:i]), 'x': p[i]}}), lambda z: {keep})) AS z
             FROM {name}_m WHERE len(m) > 0)"""


def secret_scan_sql():
    from sparkmail.llm.secret_scan import BASE, MORE

    rules = BASE + MORE
    parts = [_matches(r.kind, r.pattern, f"length(z.x) >= {r.least}", r.group) for r in rules]
    found = " UNION ALL ".join(f"SELECT doc_id, z.s AS s, z.e AS e, {i} AS ord, '{r.kind}' AS kind FROM {r.kind}" for i, r in enumerate(rules))
    base = len(BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {",".join(parts)},
  f AS (SELECT *, kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR) AS shown FROM ({found})),
  a AS (SELECT doc_id, {", ".join(f"count(*) FILTER (ord = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))},
               string_agg(shown, ',' ORDER BY s, ord) FILTER (ord < {base}) AS base, string_agg(shown, ',' ORDER BY s, ord) AS spans
        FROM f GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""


ORACLE["op3_secret_scan"] = secret_scan_sql()

_LOWER = "translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op8_near_dup"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER.format(t='text')}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.doc_id = d.doc_id
"""

_WORDS = "regexp_extract_all(" + _LOWER + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE["op10_decontaminate"] = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(t='text')} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(t='text')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM w, (SELECT DISTINCT n FROM bw) x)),
h AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id
"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text, bit by bit."""
    step = "list_reduce(range(8), lambda b, i: xor(b >> 1, CASE WHEN b % 2 = 1 THEN 3988292384 ELSE 0 END), {})"
    return ("xor(list_reduce(list_transform(string_split(" + text + ", ''), lambda c: ord(c)::BIGINT), lambda a, c: xor(a >> 8, "
            + step.format("xor(a, c) % 256") + "), 4294967295::BIGINT), 4294967295::BIGINT)")


def _merkle(levels: int = 20, top_levels: int = 12) -> str:
    """Trees of 3 ** levels leaves at most, level by level; the second kind of tree joins the first ones' roots."""
    def field(c):
        return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"

    def leaf(text):
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    steps = [f"""docs AS (SELECT *, CASE WHEN doc_id IS NOT NULL AND {_crc32('doc_id::VARCHAR')} % 2 = 0
        THEN replace(text, chr(10), '') ELSE text END AS seen FROM documents),
    leaves AS (SELECT doc_id, coalesce('+' || source, '') AS tree, {leaf('text')} AS leaf, {leaf('seen')} AS claim FROM docs),
    placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY tree) AS n FROM leaves),
    a0 AS (SELECT tree, pos, leaf AS d, n FROM placed),
    f0 AS (SELECT doc_id, leaf, tree, pos, n, claim AS cur, '' AS proof FROM placed)"""]

    def climb(name, f, levels, keep):
        for k in range(levels):
            # A run's digests as one list; a tree of one node stays as it is.
            steps.append(f"""{name}r{k} AS (SELECT tree, pos // 3 AS pos, n, list(d ORDER BY pos) AS ds FROM {name}{k} GROUP BY tree, pos // 3, n),
    {name}{k + 1} AS (SELECT tree, pos, (n + 2) // 3 AS n, CASE WHEN n = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS d FROM {name}r{k}),
    {f}{k + 1} AS (SELECT {keep}, f.tree, f.pos // 3 AS pos, (f.n + 2) // 3 AS n,
        CASE WHEN f.n = 1 THEN cur ELSE sha256(array_to_string(ds[:f.pos % 3], '') || cur || array_to_string(ds[f.pos % 3 + 2:], '')) END AS cur,
        CASE WHEN f.n = 1 THEN proof ELSE proof || array_to_string(ds[:f.pos % 3], '') || array_to_string(ds[f.pos % 3 + 2:], '') END AS proof
        FROM {f}{k} f JOIN {name}r{k} r ON f.tree = r.tree AND f.pos // 3 = r.pos)""")

    climb("a", "f", levels, "doc_id, leaf")
    steps.append(f"""b0 AS (SELECT '^' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, d, count(*) OVER () AS n, tree AS source FROM a{levels}),
    g0 AS (SELECT doc_id, leaf, b.d AS subroot, b.tree, b.pos, b.n, cur, proof FROM f{levels} f JOIN b0 b ON f.tree = b.source)""")
    climb("b", "g", top_levels, "doc_id, leaf, subroot")
    return "WITH " + ",\n    ".join(steps) + f"""
    SELECT doc_id, leaf, subroot, b.d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = b.d AS verified
    FROM g{top_levels} g JOIN b{top_levels} b ON g.tree = b.tree"""


ORACLE["op13_merkle_manifest"] = _merkle()
