"""DuckDB SQL of the queries that SQL can express."""

MIX_SOURCES = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM sized GROUP BY source),
capped AS (  -- sources by how soon they are full; with those before one full, the others share the rest by weight
  SELECT *, 3.0 * source_size AS most,
         ((SELECT sum(source_size) FROM totals) - coalesce(sum(3.0 * source_size) OVER before, 0)) / sum(weight) OVER rest AS factor,
         row_number() OVER (ORDER BY 3.0 * source_size / weight, source) AS place
  FROM totals
  WINDOW before AS (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (SELECT factor FROM capped WHERE factor * weight <= most ORDER BY place LIMIT 1),
targets AS (
  SELECT source, source_size, least(most, weight * coalesce((SELECT factor FROM level), 'inf'::DOUBLE)) AS target FROM capped),
classed AS (SELECT *, CAST(length(bin(size + 1)) AS INTEGER) AS class, length(bin(size + 1)) + 4.0::DOUBLE AS value FROM sized),
strata0 AS (SELECT source, class, value, sum(size) AS words FROM classed GROUP BY ALL),
tried AS (
  SELECT s.*, t.target,
         (t.target - 3 * coalesce(sum(words) OVER above, 0)) / nullif(sum(words * value) OVER below, 0) AS factor
  FROM strata0 s JOIN targets t ON t.source IS NOT DISTINCT FROM s.source
  WINDOW above AS (PARTITION BY s.source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         below AS (PARTITION BY s.source ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
factors AS (
  SELECT source, any_value(target) AS target, max_by(factor, class) FILTER (WHERE factor * value <= 3) AS factor FROM tried GROUP BY source),
expected AS (
  SELECT s.*, least(3.0::DOUBLE, greatest(0.0::DOUBLE,
           coalesce(f.factor, CASE WHEN f.target > 0 THEN 'inf'::DOUBLE ELSE 0.0 END) * value)) AS expected
  FROM strata0 s JOIN factors f ON f.source IS NOT DISTINCT FROM s.source),
strata AS (
  SELECT source, class, words, floor(expected + 1e-12) AS whole,
         CASE WHEN expected - floor(expected + 1e-12) > 1e-12 THEN expected - floor(expected + 1e-12) ELSE 0.0 END AS p FROM expected),
needs AS (
  SELECT s.source, greatest(0.0::DOUBLE, any_value(t.target) - sum(whole * words)) AS need
  FROM strata s JOIN targets t ON t.source IS NOT DISTINCT FROM s.source GROUP BY s.source),
drawn AS (
  SELECT c.*, s.whole, s.p, n.need,
         (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix'), 1, 12))::BIGINT + 0.5) / 281474976710656.0 AS u
  FROM classed c JOIN strata s ON s.source IS NOT DISTINCT FROM c.source AND s.class = c.class
  JOIN needs n ON n.source IS NOT DISTINCT FROM c.source),
ranked AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS q FROM drawn WHERE p > 0),
summed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id NULLS FIRST) AS so_far FROM ranked),
picked AS (SELECT *, so_far <= need AS taken FROM summed),
gaps AS (SELECT source, any_value(need) - coalesce(sum(size) FILTER (WHERE taken), 0) AS missing FROM picked GROUP BY source),
fillers AS (
  SELECT p.source, arg_min(doc_id, (abs(size - missing), doc_id)) AS filler
  FROM picked p JOIN gaps g ON g.source IS NOT DISTINCT FROM p.source
  WHERE NOT taken AND abs(size - missing) < missing GROUP BY p.source),
extra AS (
  SELECT p.source, p.doc_id, bool_or(taken OR coalesce(p.doc_id = f.filler, false)) AS taken
  FROM picked p LEFT JOIN fillers f ON f.source IS NOT DISTINCT FROM p.source GROUP BY ALL)
SELECT d.doc_id, d.size, t.source_size, t.target,
       CAST((d.whole + CASE WHEN d.p > 0 AND e.taken THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken
FROM drawn d JOIN targets t ON t.source IS NOT DISTINCT FROM d.source
LEFT JOIN extra e ON e.source IS NOT DISTINCT FROM d.source AND e.doc_id IS NOT DISTINCT FROM d.doc_id"""

BLOCK_SEARCH = """
WITH listed AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
sound AS (
  SELECT vec_id, min(v) AS v FROM listed
  WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0 GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score
  FROM sound q JOIN sound c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM placed WHERE place <= 20"""

#: crc32 is folded over the UTF-8 bytes of texts of U+0000 to U+00FF; near words by deletion of one place each.
SPELLING = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), i) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS name,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{7,}')) AS run
  FROM documents),
bytes AS (
  SELECT name, run, flatten(list_transform(string_split(name || ':' || run, ''), lambda c:
    CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c)::BIGINT >> 6), 128 + (unicode(c)::BIGINT & 63)] END)) AS b
  FROM runs),
hashed AS (
  SELECT run, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h
  FROM bytes, crc_table),
damaged AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word
  FROM hashed),
words AS (SELECT word, count(*) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cut AS (
  SELECT word, n, length(word) AS l, i, substr(word, 1, CAST(i - 1 AS INTEGER)) || substr(word, CAST(i + 1 AS INTEGER)) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.l = b.l AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS at FROM words
  UNION ALL SELECT k.word, f.form FROM walk k JOIN formed f ON f.word = k.at WHERE f.form IS NOT NULL),
ends AS (SELECT k.word, k.at AS root FROM walk k JOIN formed f ON f.word = k.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""

def _edit(way: str, cost: int | str, letter: str) -> str:
    """A way, nine digits of cost and its letters, with one more edit."""
    return f"(lpad(CAST(CAST({way}[1:9] AS INTEGER) + {cost} AS VARCHAR), 9, '0') || {way}[10:] || '{letter}')"


def _turn(state: str, kind: str, sources: list[str]) -> str:
    """The best way that ends in ``state`` after a turn: deleted, kept or reroled; at most one insert before it can be cheapest."""
    ways = [_edit(state, 4, "D")]
    for way in sources:
        ways.append(f"CASE WHEN fault IN ('w', 't') AND kind = '{kind}' THEN {_edit(way, 'more', 'K')} END")
        if kind != "s":
            ways.append(f"CASE WHEN fault IN ('w', 't') THEN {_edit(way, '3 + more', 'R')} END")
    return f"least({', '.join(ways)})"


#: Ways to each state (n none, s system, u user, a assistant) turn by turn; the least string is the cheapest, then the ASCII-least.
REPAIR = rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), i) ORDER BY i) AS t FROM range(256) r(i)),
hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                                        lambda x: CAST(unicode(x) AS BIGINT)),
                         lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS h
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed JOIN (VALUES (0), (1)) c(copy) ON h <> 0 AND (copy = 0 OR h = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE 'w' END AS fault,
         substr(role, 1, 1) AS kind, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || kind NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS last
  FROM faulty GROUP BY conv_id),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '000000000' AS n, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM placed
  UNION ALL
  SELECT conv_id, i, {_turn("n", "-", [])}, {_turn("s", "s", ["n"])}, {_turn("u1", "u", ["n", "s", "a1"])}, {_turn("a1", "a", ["u1"])}
  FROM (SELECT f.*, w.n, w.s, least(w.u, {_edit("w.n", 3, "I")}, {_edit("w.s", 3, "I")}, {_edit("w.a", 3, "I")}) AS u1,
               least(w.a, {_edit("w.u", 3, "I")}) AS a1, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS more
        FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)),
ended AS (
  SELECT c.*, least(n, a, {_edit("u", 3, "I")}) AS way FROM counted c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.last),
letters AS (
  SELECT conv_id, unnest(string_split(way[10:], '')) AS letter, unnest(range(1, length(way) - 8)) AS pos FROM ended WHERE length(way) > 9),
read AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS i,
         count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY pos) AS written FROM letters),
joined AS (
  SELECT r.conv_id, pos, letter, written, CASE WHEN letter <> 'I' THEN f.text ELSE '' END AS text, f.role,
         max(CASE WHEN letter = 'K' AND kind = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY r.conv_id) AS shift
  FROM read r LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (written - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
                             chr(10) ORDER BY pos) AS text
  FROM joined WHERE letter <> 'D' GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(CAST(way[1:9] AS BIGINT), 0) AS cost, coalesce(way[10:], '') AS audit,
       sha256(coalesce(r.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM d.conv_id"""

NEAR_VECTORS = """
WITH RECURSIVE listed AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0),
sound AS (
  SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM listed
  WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id, b.vec_id AS other FROM sound a JOIN sound b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
reached AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION SELECT r.vec_id, l.other FROM reached r JOIN links l ON l.vec_id = r.other),
named AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN named USING (vec_id) LEFT JOIN (SELECT vec_id, count(*) AS n FROM links GROUP BY vec_id) USING (vec_id)"""

ORACLES = {"op11_turn_repair": REPAIR, "op12_near_vectors": NEAR_VECTORS, "op13_spelling_variants": SPELLING, "op2_mix_sources": MIX_SOURCES, "op3_block_search": BLOCK_SEARCH}
