"""DuckDB SQL of the training-data queries that SQL can express, over the same whole tables."""

from __future__ import annotations

# Vectors as whole numbers; null, null and non-finite components take no part.
WHOLE = """
whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)"""

TOP_PRODUCTS = f"""
WITH {WHOLE},
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS "rank" FROM scored)
SELECT query_id, CAST("rank" AS INTEGER) AS "rank", vec_id, score FROM ranked WHERE "rank" <= 10"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    byte = "xor(c, CAST(b AS BIGINT))"
    bits = "list_reduce(range(0, 8), lambda r, k: xor(r >> 1, 3988292384 * (r & 1)), {0})"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: {bits.format(byte)}, CAST(4294967295 AS BIGINT)), 4294967295)"


PREFIX_TRIE = f"""
WITH own AS (
  SELECT conv_id, list({{'r': COALESCE(role, ''), 't': COALESCE("text", '')}} ORDER BY turn NULLS FIRST, role, "text") AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1
),
heads AS (SELECT *, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM own),
rebuilt AS (
  SELECT a.conv_id, list_concat(COALESCE(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns
  FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5
),
prefixes AS (
  SELECT conv_id, turns[1:d] AS p, d = len(turns) AS last
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
),
nodes AS (
  SELECT p, len(p) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(COALESCE(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM prefixes GROUP BY 1
),
children AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
linked AS (
  SELECT n.*, u.conv_id AS parent_conv_id, COALESCE(c.n_children, 0) AS n_children,
         CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * strlen(n.p[n.depth].t) END AS own
  FROM nodes n LEFT JOIN children c ON c.p = n.p LEFT JOIN nodes u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.p = n.p[1:n.depth - 1]
),
below AS (
  SELECT p[1:d] AS p, sum(own) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT p, own, n_children, unnest(range(0, depth + 1)) AS d FROM linked) GROUP BY 1
)
SELECT l.conv_id, l.depth, l.parent_conv_id, l.n_convs, l.n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens,
       l.ends_sha256
FROM linked l JOIN below b ON b.p = l.p"""


def _vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS (
  SELECT a.id, a.part, a.v, b.entry, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS gap
  FROM parts a JOIN book{k} b ON a.part = b.part
  QUALIFY ROW_NUMBER() OVER (PARTITION BY a.id, a.part ORDER BY gap, b.entry) = 1
)""")
        if k < rounds:
            steps.append(f"""
cells{k} AS (
  SELECT part, entry, i, sum(x) AS total, count(*) AS n
  FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{k}) GROUP BY ALL
),
mean{k} AS (
  SELECT part, entry, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM cells{k} GROUP BY ALL
),
book{k + 1} AS (
  SELECT b.part, b.entry, COALESCE(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m ON m.part = b.part AND m.entry = b.entry
)""")
    return f"""
WITH {WHOLE},
ordered AS (SELECT *, ROW_NUMBER() OVER (ORDER BY vec_id NULLS LAST, v) AS id FROM whole),
parts AS (
  SELECT id, part, v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}] AS v
  FROM (SELECT id, v, unnest(range(0, {parts})) AS part FROM ordered)
),
book0 AS (SELECT part, id - 1 AS entry, v FROM parts WHERE id <= {entries}),
{",".join(steps)},
codes AS (
  SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(gap) AS BIGINT) AS error FROM near{rounds} GROUP BY 1
),
books AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds}
)
SELECT o.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY o.label) AS BIGINT) AS label_error, b.codebooks_sha256
FROM ordered o JOIN codes c ON c.id = o.id CROSS JOIN books b"""


ORACLE: dict[str, str] = {
    "op11_top_products": TOP_PRODUCTS,
    "op12_prefix_trie": PREFIX_TRIE,
    "op13_vector_codes": _vector_codes(),
}
