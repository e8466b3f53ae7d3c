"""DuckDB SQL for the queries that SQL expresses; tests hold the others against brute force."""

from __future__ import annotations

EXACT_DEDUP = r"""
WITH hashed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM hashed
"""

# Each round of a recursion climbs one level of the trees that have several nodes left; a leaf
# carries its ancestor, its siblings so far, and what its own digest folds to. CRC32 is worked
# out bit by bit: each byte is followed by eight shifts.
MERKLE_MANIFEST = r"""
WITH RECURSIVE
enc AS (
  SELECT doc_id, source, text,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
         || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
         xor(4294967295, list_reduce(
           list_concat([4294967295], flatten(list_transform(
             string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END)) AS crc
  FROM documents
),
leaves AS (
  SELECT doc_id, source,
         sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN crc % 5 = 0 THEN sha256(head || coalesce(strlen(lowered) || ':' || lowered, '-')) END AS claim
  FROM enc
),
low AS (
  SELECT doc_id, source, leaf, 0 AS height, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS nodes, leaf AS node, '' AS siblings, coalesce(claim, leaf) AS folded
  FROM leaves
  UNION ALL
  SELECT l.doc_id, l.source, l.leaf, l.height + 1, l.pos // 16, (l.nodes + 15) // 16, sha256(array_to_string(r.run, '')),
         l.siblings || array_to_string(r.run[1:l.pos % 16], '') || array_to_string(r.run[l.pos % 16 + 2:], ''),
         sha256(array_to_string(r.run[1:l.pos % 16], '') || l.folded || array_to_string(r.run[l.pos % 16 + 2:], ''))
  FROM low l JOIN (
    SELECT source, pos // 16 AS up, list(node ORDER BY pos) AS run
    FROM (SELECT DISTINCT source, pos, node FROM low) GROUP BY source, pos // 16
  ) r ON r.source IS NOT DISTINCT FROM l.source AND r.up = l.pos // 16
  WHERE l.nodes > 1
),
subroots AS (
  SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS nodes
  FROM (SELECT DISTINCT source, node FROM low WHERE nodes = 1)
),
high AS (
  SELECT s.source, s.subroot, s.pos, s.nodes, s.subroot AS node, CAST([] AS STRUCT(l VARCHAR, r VARCHAR)[]) AS path
  FROM subroots s
  UNION ALL
  SELECT h.source, h.subroot, h.pos // 16, (h.nodes + 15) // 16, sha256(array_to_string(r.run, '')),
         list_append(h.path, {'l': array_to_string(r.run[1:h.pos % 16], ''), 'r': array_to_string(r.run[h.pos % 16 + 2:], '')})
  FROM high h JOIN (
    SELECT pos // 16 AS up, list(node ORDER BY pos) AS run FROM (SELECT DISTINCT pos, node FROM high) GROUP BY pos // 16
  ) r ON r.up = h.pos // 16
  WHERE h.nodes > 1
),
folding AS (
  SELECT w.doc_id, w.leaf, w.source, h.subroot, h.node AS root, h.path, w.siblings, w.folded, 1 AS step
  FROM low w JOIN high h ON w.source IS NOT DISTINCT FROM h.source
  WHERE w.nodes = 1 AND h.nodes = 1
  UNION ALL
  SELECT doc_id, leaf, source, subroot, root, path, siblings || path[step].l || path[step].r,
         sha256(path[step].l || folded || path[step].r), step + 1
  FROM folding WHERE step <= len(path)
)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM folding WHERE step = len(path) + 1
"""

_TERMS = r"""
regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')
"""

LEXICAL_SEARCH = f"""
WITH docs AS (SELECT doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
counted AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM docs) GROUP BY doc_id, term
),
lengths AS (SELECT doc_id, len(terms) AS n FROM docs WHERE len(terms) > 0),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * max(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counted, corpus GROUP BY term
),
asked AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counted USING (term) JOIN lengths USING (doc_id), corpus
  GROUP BY item_id, doc_id
),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

# Words come from text whose white space is single blanks. A link is two documents that share
# enough shingles; components grow from every document to the smallest id in reach.
JACCARD_JOIN = r"""
WITH RECURSIVE
worded AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
           lambda w: w <> '') AS words
  FROM documents
),
shingled AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []
                      WHEN len(words) <= 4 THEN [array_to_string(words, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')))
                 END AS shingles
  FROM worded
),
sets AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM shingled),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM shingled s JOIN reach r ON r.a = s.doc_id
GROUP BY s.doc_id, shingles
"""

ORACLES: dict[str, str] = {
    "op1_exact_dedup": EXACT_DEDUP,
    "op11_merkle_manifest": MERKLE_MANIFEST,
    "op12_lexical_search": LEXICAL_SEARCH,
    "op13_jaccard_join": JACCARD_JOIN,
}
