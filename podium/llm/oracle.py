"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from . import hybrid_rank, merkle_climb, rank_profiles, systematic_mix

_MIX = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source IS NULL, encode(source)) AS ordinal
  FROM d GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][((ordinal - 1) % 3 + 1)::INT] AS weight FROM per),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, ordinal) AS place FROM weighed),
steps AS (
  SELECT place, 2.0 * source_size / weight AS edge,
         (1.5 * (SELECT sum(source_size) FROM ranked)
          - coalesce(sum(2 * source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM ranked),
cut AS (SELECT level FROM steps WHERE level < edge ORDER BY place LIMIT 1),
targets AS (
  SELECT source, ordinal, source_size,
         least((2 * source_size)::DOUBLE, coalesce((SELECT level FROM cut), 1e300) * weight) AS target
  FROM weighed),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate,
         row_number() OVER (PARTITION BY t.ordinal ORDER BY d.size, d.doc_id NULLS FIRST) AS rank
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor({systematic_mix.offset()!r}::DOUBLE + rank::DOUBLE * rate)
         - floor({systematic_mix.offset()!r}::DOUBLE + (rank - 1)::DOUBLE * rate))::BIGINT * size)::BIGINT AS taken
FROM placed
"""

_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
WHERE rank <= 5
"""

_DEDUP = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

_WARC = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""

_CHAT = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
g AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS masked,
         -- <|im_start|>, the role, a line feed, the text, <|im_end|> and a line feed
         sum(12 + 10 + 2
             + length(role) + 2 * (length(role) - length(replace(role, chr(92), ''))) / 2
             + (length(role) - length(replace(role, '<|', ''))) / 2 + (length(role) - length(replace(role, chr(10), '')))
             + length(text) + (length(text) - length(replace(text, chr(92), '')))
             + (length(text) - length(replace(text, '<|', ''))) / 2)::BIGINT AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(masked)::BIGINT AS loss_chars,
       sha256(masked) AS loss_sha256, formatted_chars
FROM g
"""

# DuckDB has no crc32: it is folded from the decimal text, a byte at a time.
_CRC = """
crc AS (
  SELECT doc_id, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, len(doc_id::VARCHAR) + 1),
                                                    lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                             lambda x, z: xor(x >> 1, (x & 1) * 3988292384::BIGINT))) AS c
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
fold AS (SELECT doc_id, xor(c, 4294967295::BIGINT) % 3 AS fold FROM crc)
"""

_LANGUAGE = f"""
WITH {_CRC},
d AS (
  SELECT row_number() OVER () AS r, documents.doc_id, lang, fold,
         ' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}]+', ' ', 'g')) || ' ' AS s,
         coalesce(regexp_matches(text, '\\p{{L}}'), false) AS lettered
  FROM documents LEFT JOIN fold ON documents.doc_id = fold.doc_id),
places AS (SELECT r, s, unnest(range(1, length(s) + 1)) AS i FROM d WHERE lettered),
grams AS (
  SELECT r, substr(s, i, k) AS g FROM places, (VALUES (1), (2), (3)) AS kinds(k)
  WHERE i + k - 1 <= length(s) AND substr(s, i, k) <> ' ' AND (k < 3 OR substr(s, i + 1, 1) <> ' ')),
mine AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY n DESC, length(g), encode(g)) - 1 AS rank
  FROM (SELECT r, g, count(*) AS n FROM grams GROUP BY r, g)),
learnt AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(g), encode(g)) - 1 AS rank
  FROM (SELECT lang, g, sum(n) AS n FROM mine JOIN d USING (r) WHERE lang IS NOT NULL AND fold <> 1 GROUP BY lang, g)),
apart AS (
  SELECT m.r, l.lang,
         sum(CASE WHEN p.rank IS NULL THEN {rank_profiles.MOST} ELSE abs(p.rank - m.rank) END)::BIGINT AS away
  FROM mine m CROSS JOIN (SELECT DISTINCT lang FROM learnt) l
  LEFT JOIN learnt p ON p.lang = l.lang AND p.g = m.g AND p.rank < {rank_profiles.MOST}
  WHERE m.rank < {rank_profiles.MOST} GROUP BY m.r, l.lang),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY away, encode(lang)) AS place,
         lead(away) OVER (PARTITION BY r ORDER BY away, encode(lang)) AS second FROM apart)
SELECT doc_id, coalesce(fold = 1, false) AS held_out, coalesce(p.lang, 'und') AS lang_pred,
       CASE WHEN p.lang IS NULL THEN 0.0::DOUBLE WHEN second IS NULL THEN 1.0::DOUBLE WHEN second = 0 THEN 0.0::DOUBLE
            ELSE 1.0::DOUBLE - away::DOUBLE / second::DOUBLE END AS score
FROM d LEFT JOIN placed p ON p.r = d.r AND place = 1
"""

_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_RANKED = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, '{merkle_climb.UPPER}', '{merkle_climb.LOWER}'), '{_TERM}') AS t
  FROM documents WHERE text IS NOT NULL),
total AS (SELECT count(*)::BIGINT AS docs, sum(len(t))::BIGINT AS terms FROM d WHERE len(t) > 0),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, '{merkle_climb.UPPER}', '{merkle_climb.LOWER}'),
                                              '{_TERM}')) AS term FROM benchmark)
  GROUP BY item_id, term),
scored AS (
  SELECT item_id, d.doc_id, sum(times * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT
                                * (({hybrid_rank.SCALE}::BIGINT * tf)
                                   // (1000 * tf + 8 * (25 + (75 * len(t)::BIGINT * docs) // terms))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN d USING (r) CROSS JOIN total
  GROUP BY item_id, d.doc_id, r)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
WHERE rank <= {hybrid_rank.K}
"""


def _field(name: str) -> str:
    return f"coalesce(octet_length(encode({name}::VARCHAR)) || ':' || {name}::VARCHAR, '-')"


# Levels are numbered from the leaves up; each path is folded a level at a time.
_MERKLE = f"""
WITH RECURSIVE {_CRC},
f AS (
  SELECT doc_id, lang,
         {" || ".join(_field(c) for c in merkle_climb.FIELDS[:-1])} AS head, text,
         CASE WHEN fold = 0 THEN translate(text, '{merkle_climb.UPPER}', '{merkle_climb.LOWER}') ELSE text END AS claimed
  FROM documents LEFT JOIN fold USING (doc_id)),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, offered) - 1 AS pos,
         dense_rank() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS tree, count(*) OVER (PARTITION BY lang) AS width
  FROM (SELECT doc_id, lang, sha256(head || {_field("text")}) AS leaf, sha256(head || {_field("claimed")}) AS offered
        FROM f)),
low(tree, level, pos, width, h) AS (
  SELECT tree, 0, pos, width, leaf FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 8, (any_value(width) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM low WHERE width > 1 GROUP BY tree, level, pos // 8),
subroots AS (SELECT tree, h AS subroot FROM low WHERE width = 1),
high(level, pos, width, h) AS (
  SELECT 0, tree, (SELECT count(*) FROM subroots), subroot FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, (any_value(width) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM high WHERE width > 1 GROUP BY level, pos // 8),
heights AS (SELECT tree, max(level) AS height FROM low GROUP BY tree),
-- Every node with the step at which a path passes it, the subroots' tree behind the languages'.
runs AS (
  SELECT tree, level AS step, pos // 8 AS run, pos % 8 AS place, h FROM low WHERE width > 1
  UNION ALL
  SELECT t.tree, t.height + high.level, pos // 8, pos % 8, h FROM high CROSS JOIN heights t
  WHERE width > 1 AND pos // 8 = t.tree // pow(8, high.level + 1)::BIGINT),
paths AS (
  SELECT l.tree, l.pos, r.step, r.place, r.h,
         CASE WHEN r.step < t.height THEN (l.pos // pow(8, r.step)::BIGINT) % 8
              ELSE (l.tree // pow(8, r.step - t.height)::BIGINT) % 8 END AS own
  FROM leaves l JOIN heights t ON t.tree = l.tree
  JOIN runs r ON r.tree = l.tree AND r.run = CASE WHEN r.step < t.height THEN l.pos // pow(8, r.step + 1)::BIGINT
                                                  ELSE l.tree // pow(8, r.step - t.height + 1)::BIGINT END),
steps AS (
  SELECT tree, pos, step, coalesce(string_agg(h, '' ORDER BY place) FILTER (WHERE place < own), '') AS before,
         coalesce(string_agg(h, '' ORDER BY place) FILTER (WHERE place > own), '') AS after
  FROM paths GROUP BY tree, pos, step),
proofs AS (SELECT tree, pos, string_agg(before || after, '' ORDER BY step) AS proof, max(step) AS last
           FROM steps GROUP BY tree, pos),
folded(tree, pos, step, h) AS (
  SELECT tree, pos, 0, offered FROM leaves
  UNION ALL
  SELECT f.tree, f.pos, f.step + 1, sha256(s.before || f.h || s.after)
  FROM folded f JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.step = f.step)
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.h AS folded_root,
       f.h = r.h AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree
CROSS JOIN (SELECT h FROM high WHERE width = 1) r
LEFT JOIN proofs p ON p.tree = l.tree AND p.pos = l.pos
JOIN folded f ON f.tree = l.tree AND f.pos = l.pos AND f.step = coalesce(p.last + 1, 0)
"""

ORACLE = {
    "op1_impact_search": _TOP_K,
    "op5_systematic_mix": _MIX,
    "op6_chat_tree": _CHAT,
    "op8_block_naming": _DEDUP,
    "op9_capture_index": _WARC,
    "op11_rank_profiles": _LANGUAGE,
    "op12_hybrid_rank": _RANKED,
    "op13_merkle_climb": _MERKLE,
}
