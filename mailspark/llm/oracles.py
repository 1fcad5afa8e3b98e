"""DuckDB SQL for those queries that SQL can express.

They follow the contracts by plain joins over all rows: all pairs of vectors, all
documents that share a shingle, all windows of words.
"""

from __future__ import annotations

from mailspark.llm.chat import TOOLS
from mailspark.llm.decontamination import MIN_PART, MIN_SCORE, MIN_WORDS, SEEDS
from mailspark.llm.mixing import LIMIT, SHARE, WEIGHTS

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

# Smallest node that links (a, b), both ways, reach from each node.
_REACH = """
reach(node, other) AS (
  SELECT node, node FROM nodes
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other
),
named AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
"""

_OP1 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id AS node, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
),
usable AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.node AS a, b.node AS b FROM usable a JOIN usable b ON a.node <> b.node
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
),
nodes AS (SELECT node FROM v),
{_REACH}
SELECT n.node AS vec_id, (SELECT count(*) FROM links l WHERE l.a = n.node) AS n_links, n.component_id, n.node = n.component_id AS kept
FROM named n
"""

_order = "(source IS NULL), encode(source)"
_case = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
_OP4 = f"""
WITH sized AS (
  SELECT doc_id, source, text, len({_WORDS.format('text')})::BIGINT AS size FROM documents
),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY {_order}) - 1) % {len(WEIGHTS)} {_case} END AS weight, source_size * {LIMIT} AS bound FROM totals
),
ranked AS (
  SELECT *, (sum(source_size) OVER () * {SHARE}::DOUBLE
    - coalesce(sum(bound) OVER (ORDER BY bound / weight, {_order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY bound / weight, {_order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed
),
final AS (SELECT first(level ORDER BY bound / weight, {_order}) AS level FROM ranked WHERE level * weight <= bound),
targets AS (
  SELECT source, source_size, coalesce(least(final.level * weight, bound::DOUBLE), 0) AS target FROM ranked, final
),
numbered AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) AS n FROM sized
),
rated AS (
  SELECT n.doc_id, n.size, t.source_size, t.target, n.n, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix:' || n.source), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM numbered n JOIN targets t ON n.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  ((floor(n * rate + shift) - floor((n - 1) * rate + shift)) * size)::BIGINT AS taken
FROM rated
"""

_OP5 = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id AS node, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
),
shingled AS (
  SELECT node, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) END AS s FROM worded
),
posts AS (SELECT node, len(s) AS n, unnest(s) AS shingle FROM shingled),
shared AS (
  SELECT a.node AS a, b.node AS b, a.n AS na, b.n AS nb, count(*) AS c
  FROM posts a JOIN posts b ON a.shingle = b.shingle AND a.node < b.node AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80
  GROUP BY ALL
),
found AS (SELECT a, b FROM shared WHERE 100 * c >= 80 * (na + nb - c)),
links AS (SELECT a, b FROM found UNION ALL SELECT b, a FROM found),
nodes AS (SELECT node FROM worded),
{_REACH}
SELECT s.node AS doc_id, len(s.s)::BIGINT AS n_shingles, n.component_id, s.node = n.component_id AS kept
FROM shingled s JOIN named n ON n.node = s.node
"""

_entities = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&amp;", "&")]
_plain = "regexp_replace(block, '<[^>]*>', ' ', 'g')"
for _code, _char in _entities:
    _plain = f"replace({_plain}, '{_code}', '{_char}')"
_OP6 = rf"""
WITH cut AS (
  SELECT page_id, url, string_split_regex(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '</?(h1|p)>') AS blocks FROM pages
),
rows AS (SELECT page_id, url, unnest(range(len(blocks))) AS i, unnest(blocks) AS block FROM cut),
plain AS (SELECT page_id, url, i, trim(regexp_replace({_plain}, '\s+', ' ', 'g')) AS t FROM rows),
joined AS (SELECT page_id, url, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (t <> ''), '') AS text FROM plain GROUP BY page_id, url)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM joined
"""


def _seed(mask: str, words: str, at: str) -> str:
    looked = [f"{words}[{at} + {i + 1}]" for i, bit in enumerate(mask) if bit == "1"]
    return f"'{mask}:' || " + " || ' ' || ".join(looked)


_width = len(SEEDS[0])
_masks = [(m, f"len(w) >= {_width}") for m in SEEDS] + [("1" * n, f"len(w) = {n}") for n in range(MIN_WORDS, _width)]
_doc_seeds = " UNION ALL ".join(
    f"SELECT doc_id, p AS doc_p, {_seed(m, 'w', 'p')} AS seed FROM doc_at WHERE p + {len(m)} <= len(w)" for m, _ in _masks)
_item_seeds = " UNION ALL ".join(
    f"SELECT item_id, p AS item_p, {_seed(m, 'w', 'p')} AS seed FROM item_at WHERE p + {len(m)} <= len(w) AND {c}" for m, c in _masks)
_tokens = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{M}\p{N}_]+'), lambda x: x <> '')"
_OP7 = f"""
WITH d AS (SELECT doc_id, {_tokens} AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, {_tokens} AS w FROM benchmark WHERE text IS NOT NULL),
doc_at AS (SELECT doc_id, w, unnest(range(len(w))) AS p FROM d),
item_at AS (SELECT item_id, w, unnest(range(len(w))) AS p FROM b WHERE len(w) >= {MIN_WORDS}),
doc_seeds AS ({_doc_seeds}),
item_seeds AS ({_item_seeds}),
places AS (SELECT DISTINCT doc_id, item_id, doc_p - item_p AS shift FROM doc_seeds JOIN item_seeds USING (seed)),
points AS (
  SELECT o.doc_id, o.item_id, o.shift, len(b.w) AS item_words, unnest(range(len(b.w))) AS k,
    unnest(list_transform(range(len(b.w)), lambda k: CASE WHEN o.shift + k >= 0 AND coalesce(d.w[o.shift + k + 1] = b.w[k + 1], false) THEN 1 ELSE -1 END)) AS point
  FROM places o JOIN d USING (doc_id) JOIN b USING (item_id)
),
sums AS (SELECT *, sum(point) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k) AS upto FROM points),
floors AS (SELECT *, upto - point AS before FROM sums),
lows AS (
  SELECT *, min(before) OVER w AS low, arg_min(-k, before * 100000 - k) OVER w AS start_
  FROM floors WINDOW w AS (PARTITION BY doc_id, item_id, shift ORDER BY k ROWS UNBOUNDED PRECEDING)
),
best AS (
  SELECT doc_id, item_id, shift, item_words, max(upto - low) AS score, arg_max(k, (upto - low) * 100000 - k) AS last_, arg_max(-start_, (upto - low) * 100000 - k) AS first_
  FROM lows GROUP BY ALL
),
found AS (
  SELECT doc_id, item_id, score, item_words, shift + first_ AS doc_start, shift + last_ + 1 AS doc_end FROM best
  WHERE score >= least({MIN_SCORE}, greatest(ceil(item_words * {MIN_PART}::DOUBLE), least(item_words, {_width})))
)
SELECT DISTINCT doc_id, item_id, score::INT AS score, item_words::INT AS item_words, doc_start::INT AS doc_start, doc_end::INT AS doc_end FROM found
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, doc_start) = 1
"""

assert set(TOOLS["reply"]) == {"words", "draft", "to"}
_OP8 = """
WITH asked AS (
  SELECT conv_id, turn, turn * 4 AS t, text, len(string_split(text, ' ')) AS n,
    conv_id % 3 = 0 AS early, conv_id % 7 <> 0 OR turn % 2 = 0 AS answered, conv_id % 11 = 0 AS no_one, conv_id % 13 = 0 AS quoted
  FROM conversations WHERE role = 'assistant'
),
rows AS (
  SELECT conv_id, turn * 4 AS turn, role, turn * 4 AS place, 0 AS kind, 'plain' AS status, [] AS errors,
    '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' AS json
  FROM conversations WHERE role IS DISTINCT FROM 'assistant'
  UNION ALL
  SELECT conv_id, t, 'assistant', t, 0, CASE WHEN answered THEN 'answered' ELSE 'open' END,
    list_concat(CASE WHEN quoted THEN ['words is no integer'] ELSE [] END, CASE WHEN no_one THEN ['missing to'] ELSE [] END),
    '{"content":null,"role":"assistant","tool_calls":[{"arguments":{"draft":false' || CASE WHEN no_one THEN '' ELSE ',"to":"user"' END
      || ',"words":' || CASE WHEN quoted THEN '"' || n || '"' ELSE n::VARCHAR END || '},"id":"call_' || turn || '","name":"reply"}]}'
  FROM asked
  UNION ALL
  SELECT conv_id, CASE WHEN early THEN t - 1 ELSE t + 1 END, 'tool', CASE WHEN early THEN t ELSE t + 1 END, 1, 'linked', [],
    '{"content":' || to_json(text) || ',"role":"tool","tool_call_id":"call_' || turn || '"}'
  FROM asked WHERE answered
)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place, kind, turn) AS seq, turn, role, status, len(errors) = 0 AS valid, errors, json FROM rows
"""

_OP11 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND len(a.e) = len(b.e) AND a.vec_id IS DISTINCT FROM b.vec_id
),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
),
negatives AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank,
    other AS negative_id, positive_score, score AS negative_score
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_OP12 = f"""
WITH texts AS (SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
rows AS (SELECT row_no, doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM texts),
keyed AS (SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM rows),
often AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= 5
),
marked AS (SELECT k.*, o.key IS NOT NULL AND k.doc_id IS DISTINCT FROM o.keeper AS gone FROM keyed k LEFT JOIN often o USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_no, doc_id
"""

# Damage needs crc32, which DuckDB lacks; the cheapest edits are found turn by turn, with
# at most two inserts before each turn, as a search over the states of the grammar.
_OP13 = f"""
WITH RECURSIVE poly AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
),
spaced AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: unicode(x)::BIGINT) AS bytes
  FROM conversations
),
summed AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, bytes),
    lambda c, b: xor(c >> 8, t[(xor(c, b) % 256) + 1])), 4294967295) % 20 AS kind
  FROM spaced, poly
),
hurt AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM summed WHERE kind <> 0
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, rtrim(text, {_BLANKS}) AS body FROM hurt
),
judged AS (
  SELECT *, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS duplicate,
    right(body, 1) NOT IN ('.', '!', '?') AS cut, left(role, 1) AS initial, left(lag(role) OVER (PARTITION BY conv_id ORDER BY n), 1) AS before
  FROM placed
),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (cut AND NOT blank AND NOT duplicate) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS last
  FROM judged GROUP BY conv_id
),
inserts(p, s, icost, ins) AS (VALUES
  (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 2, 0, ''), (2, 3, 3, 'I'), (3, 3, 0, ''), (3, 2, 3, 'I')),
edges(s, ch, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
moves AS (
  SELECT p, s AS q, icost + 4 AS c, ins || 'D' AS a, NULL AS ch, TRUE AS delete FROM inserts
  UNION ALL SELECT p, q, icost, ins || 'K', ch, FALSE FROM inserts JOIN edges USING (s)
  UNION ALL SELECT p, q, icost + 3, ins || 'R', NULL, FALSE FROM inserts JOIN edges USING (s) WHERE ch <> 's'
),
ways AS (
  SELECT conv_id, 0::BIGINT AS n, 0 AS state, 0 AS cost, '' AS audit FROM counts
  UNION ALL
  SELECT conv_id, n, state, best.c, best.a FROM (
    SELECT w.conv_id, j.n, m.q AS state,
      min({{'c': w.cost + m.c + CASE WHEN NOT m.delete AND j.cut THEN 3 ELSE 0 END, 'a': w.audit || m.a}}) AS best
    FROM ways w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.n = w.n + 1
    JOIN moves m ON m.p = w.state AND (m.delete OR NOT (j.blank OR j.duplicate)) AND (m.ch IS NULL OR m.ch = j.initial)
    GROUP BY w.conv_id, j.n, m.q
  )
),
tails(state, more, rest) AS (VALUES (0, 0, ''), (1, 6, 'II'), (2, 3, 'I'), (3, 0, '')),
chosen AS (
  SELECT w.conv_id, min({{'c': cost + more, 'a': audit || rest}}) AS best
  FROM ways w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.last = w.n JOIN tails USING (state) GROUP BY w.conv_id
),
letters AS (
  SELECT conv_id, unnest(range(1, length(best.a) + 1)) AS i, unnest(string_split(best.a, '')) AS e,
    length(replace(best.a, 'D', '')) AS size FROM chosen WHERE best.a <> ''
),
steps AS (
  SELECT *, count(*) FILTER (e <> 'I') OVER upto AS n, count(*) FILTER (e <> 'D') OVER upto AS k
  FROM letters WINDOW upto AS (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING)
),
left_over AS (
  SELECT s.conv_id, s.i, CASE WHEN e = 'K' THEN role WHEN (k + size) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN e = 'I' THEN '' ELSE text END AS line
  FROM steps s LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.n = s.n AND e <> 'I' WHERE e <> 'D'
),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY i) AS whole FROM left_over GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
  coalesce(best.a, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN chosen b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""

ORACLES: dict[str, str] = {
    "op1_embedding_dedup": _OP1,
    "op4_mixing": _OP4,
    "op5_minhash_dedup": _OP5,
    "op6_html_extraction": _OP6,
    "op7_decontamination": _OP7,
    "op8_chat_formatting": _OP8,
    "op11_hard_negatives": _OP11,
    "op12_line_dedup": _OP12,
    "op13_conversation_repair": _OP13,
}
