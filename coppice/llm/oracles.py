"""SQL of the queries whose results SQL can state, for an independent engine."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANK_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(pattern: str, text: str = "text") -> str:
    """A text's words as a list, A-Z in lower case; none for null."""
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{UPPER.lower()}'), '{pattern}')"


BY_ROOM = "ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST"
MIX = f"""
WITH d AS (SELECT doc_id, source, text, CAST(len({_words(BLANK_WORD)}) AS BIGINT) AS size FROM documents),
k AS (
  SELECT doc_id, source, size,
         -ln((CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '-42'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5)
             / 4503599627370496.0)
         / CASE WHEN size > 0 AND length(text) / size BETWEEN 4 AND 11 THEN 1.0 ELSE 0.5 END AS key
  FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3 AS cap
  FROM s),
r AS (
  SELECT *, row_number() OVER ({BY_ROOM}) AS room,
         (CAST(sum(source_size) OVER () AS DOUBLE)
          - CAST(coalesce(sum(cap) OVER ({BY_ROOM} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / sum(weight) OVER ({BY_ROOM} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
f AS (SELECT *, (SELECT level FROM r WHERE level * weight <= cap ORDER BY room LIMIT 1) AS first_level FROM r),
t AS (
  SELECT source, source_size, least(coalesce(first_level * weight, CAST(cap AS DOUBLE)), CAST(cap AS DOUBLE)) AS target FROM f),
b AS (SELECT *, CAST(round(target) AS BIGINT) AS budget FROM t),
e AS (SELECT *, least(budget // greatest(source_size, 1), 3) AS epochs FROM b),
o AS (
  SELECT k.*, source_size, target, epochs, budget - epochs * source_size AS rest,
         sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM o
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(BLANK_WORD)} AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram
  FROM d, unnest(range(1, greatest(len(w) - 5, 0) + 2)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 75 * (x.n + y.n - common)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.a = d.doc_id
"""

# A place where at most two words of a window differ has one of the window's thirds exact.
DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_words(ALNUM_WORD)} AS w FROM documents),
i AS (SELECT item_id, {_words(ALNUM_WORD)} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, w[s:s + least(10, len(w)) - 1] AS g, least(10, len(w)) AS k
  FROM i, unnest(range(1, greatest(len(w) - 10, 0) + 2)) t(s) WHERE len(w) > 0),
kinds AS (SELECT DISTINCT g, k, array_to_string(g, ' ') AS line FROM win),
grams AS (
  SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS line
  FROM d, (SELECT DISTINCT k FROM kinds), unnest(range(1, len(w) - k + 2)) t(s)),
exact AS (SELECT doc_id, s, kinds.k, kinds.g FROM grams JOIN kinds ON grams.line = kinds.line AND grams.k = kinds.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM exact, unnest(range(s, s + k)) t(p) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS items
  FROM exact JOIN win ON win.g = exact.g GROUP BY doc_id),
thirds AS (
  SELECT g, k, k * t // 3 AS skip, k * (t + 1) // 3 - k * t // 3 AS n,
         array_to_string(g[k * t // 3 + 1:k * (t + 1) // 3], ' ') AS part
  FROM kinds, range(3) u(t) WHERE k > 2),
parts AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS part
  FROM d, (SELECT DISTINCT n FROM thirds), unnest(range(1, len(w) - n + 2)) t(s)),
starts AS (
  SELECT DISTINCT doc_id, s - skip AS s, g, k FROM parts JOIN thirds ON parts.part = thirds.part AND parts.n = thirds.n),
close AS (
  SELECT d.doc_id, count(*) AS n_near FROM starts JOIN d ON d.doc_id = starts.doc_id
  WHERE s >= 1 AND s + k - 1 <= len(w) AND len(list_filter(range(k), lambda x: w[s + x] = g[x + 1])) >= k - 2 GROUP BY d.doc_id),
short AS (SELECT doc_id, count(*) AS n_near FROM exact WHERE k <= 2 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
       coalesce(close.n_near, 0) + coalesce(short.n_near, 0) AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id) LEFT JOIN close USING (doc_id) LEFT JOIN short USING (doc_id)
"""


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


URLS = f"""
WITH a AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (
  SELECT page_id, translate(raw, '{UPPER}', '{UPPER.lower()}') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM b),
r AS (
  SELECT *, CASE WHEN {_fits("example.org", "/en/1")} THEN 'example.org/en/1'
                 WHEN {_fits("example.org", "/es/")} THEN 'example.org/es/'
                 WHEN {_fits("com", "/fr/")} THEN 'com/fr/'
                 WHEN {_fits("com", "/de/")} THEN 'com/de/'
                 WHEN {_fits("org", "/")} THEN 'org/' END AS rule
  FROM c)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

def _matching(cells: str) -> str:
    """Length of the run of true values a list of comparisons begins with."""
    return f"coalesce(nullif(list_position({cells}, false), 0) - 1, len({cells}))"


def _merged(source: str, left: str, right: str) -> str:
    """Spans of ``source`` that overlap or touch as one per (doc_id, span)."""
    return f"""
  SELECT doc_id, min(s) AS s, max(e) AS e, min({left}) AS l, min({right}) AS r
  FROM (
    SELECT *, sum(CASE WHEN reached IS NULL OR s > reached THEN 1 ELSE 0 END)
              OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS span
    FROM (
      SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
      FROM {source}))
  GROUP BY doc_id, span"""


_EQUAL_LEFT = "list_transform(range(1, least(25, s, l.ks) + 1), lambda t: x.w[s - t + 1] = y.w[l.ks - t + 1])"
_EQUAL_RIGHT = "list_transform(range(1, least(25, len(x.w) - e, len(z.w) - r.ke) + 1), lambda t: x.w[e + t] = z.w[r.ke + t])"

REPEATS = rf"""
WITH d AS (
  SELECT doc_id, text, {_words(BLANK_WORD)} AS w, regexp_extract_all(text, '(?s).*?(?:[.!?] |\n)|.+\z') AS units
  FROM documents WHERE text IS NOT NULL),
u AS (
  SELECT doc_id, i, len(regexp_extract_all(units[i], '{BLANK_WORD}')) AS n
  FROM d, unnest(range(1, len(units) + 1)) t(i)),
c AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM u),
x AS (SELECT * FROM c WHERE n > 0),
lines AS (
  SELECT a.doc_id, a.upto - a.n AS s, b.upto AS e FROM x a ASOF JOIN x b ON a.doc_id = b.doc_id AND b.upto >= a.upto - a.n + 25),
k AS (
  SELECT doc_id, len(w) - 24 AS places, j, {{'k': substr(md5(w[j + 1]), 1, 8), 'j': j}} AS key
  FROM d, unnest(range(0, len(w) - 24)) t(j)),
cut AS (
  SELECT DISTINCT doc_id, best.j AS s, best.j + 25 AS e
  FROM (
    SELECT doc_id, j, places, min(key) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING) AS best FROM k)
  WHERE j = 0 OR j + 25 <= places),
q AS (
  SELECT doc_id, s, e, md5(array_to_string(w[s + 1:e], ' ')) AS digest
  FROM (SELECT doc_id, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM lines
        UNION SELECT doc_id, CAST(s AS BIGINT), CAST(e AS BIGINT) FROM cut) JOIN d USING (doc_id)),
f AS (SELECT digest, min({{'d': doc_id, 's': s}}) AS first FROM q GROUP BY digest),
g AS (
  SELECT doc_id, s AS place, e, first.d AS kd, first.s AS ks, first.s + e - s AS ke, doc_id = first.d AND s < first.s + e - s AS clipped
  FROM q JOIN f USING (digest) WHERE {{'d': doc_id, 's': s}} <> first),
o AS (SELECT doc_id, CASE WHEN clipped THEN ke ELSE place END AS s, e, clipped, kd, ks, ke FROM g),
m AS ({_merged("o", "{'s': s, 'c': clipped, 'kd': kd, 'ks': ks}", "{'e': -e, 'kd': kd, 'ke': ke}")}),
v AS (
  SELECT m.doc_id, s - CASE WHEN l.c THEN 0 ELSE {_matching(_EQUAL_LEFT)} END AS s, e + {_matching(_EQUAL_RIGHT)} AS e,
         l.kd AS kd, l.ks - CASE WHEN l.c THEN 0 ELSE {_matching(_EQUAL_LEFT)} END AS ks, l.c AS c
  FROM m JOIN d x ON x.doc_id = m.doc_id JOIN d y ON y.doc_id = l.kd JOIN d z ON z.doc_id = r.kd),
n AS ({_merged("v", "{'s': s, 'c': c, 'kd': kd, 'ks': ks}", "{'e': -e}")}),
places AS (
  SELECT doc_id, text, w, list_transform(regexp_extract_all(text, '[\x20\x09-\x0D]*{BLANK_WORD}'), lambda piece: length(piece)) AS sizes,
         list_transform(regexp_extract_all(text, '{BLANK_WORD}'), lambda word: length(word)) AS words
  FROM d)
SELECT doc_id, CAST(list_sum(sizes[1:s + 1]) - words[s + 1] AS INTEGER) AS "begin",
       CAST(CASE WHEN e < len(words) THEN list_sum(sizes[1:e + 1]) - words[e + 1] ELSE length(text) END AS INTEGER) AS "end",
       l.kd AS kept_doc_id, CAST(l.ks AS INTEGER) AS kept_word
FROM n JOIN places USING (doc_id)
"""

# The remainder of eight bits of a byte, and of all bytes of a number's digits.
_CRC_BYTE = "list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))"
_CRC = f"""xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda digit: CAST(ascii(digit) AS BIGINT))), lambda c, b: {_CRC_BYTE}), 4294967295)"""

# Words q apart are the same along a run of at least 16, whatever the period, so 16-grams q apart are.
RUNS = f"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{BLANK_WORD}') AS w, {_CRC} AS h FROM documents),
a AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
p AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - a) // (3 + g % 8) END AS p FROM a),
d AS (
  SELECT doc_id, n,
         CASE WHEN p IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w
  FROM p),
k AS (
  SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 16], ' ')) AS gram FROM d, unnest(range(0, greatest(n - 15, 0))) u(i)),
e AS (SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i),
s AS (
  SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 16 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS stretch FROM e)
  GROUP BY doc_id, q, stretch HAVING max(i) - min(i) + 16 + q >= greatest(24, 3 * q)),
r AS (
  SELECT * FROM s
  WHERE NOT EXISTS (
    SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.q < s.q AND s.q % o.q = 0 AND o.start <= s.start
      AND o.start + o.length >= s.start + s.length)),
best AS (
  SELECT doc_id, count(*) AS n_runs, first(start ORDER BY CAST(length AS DOUBLE) / q DESC, start, q) AS start,
         first(length ORDER BY CAST(length AS DOUBLE) / q DESC, start, q) AS length,
         first(q ORDER BY CAST(length AS DOUBLE) / q DESC, start, q) AS period,
         string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines
  FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, i FROM r, unnest(range(start + q, start + length)) u(i)),
kept AS (
  SELECT d.doc_id, string_agg(w[u.i + 1], ' ' ORDER BY u.i) AS words
  FROM d CROSS JOIN unnest(range(n)) u(i) LEFT JOIN gone ON gone.doc_id = d.doc_id AND gone.i = u.i
  WHERE gone.i IS NULL GROUP BY d.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

# Twenty bits of the digest at a time are four letters.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (
  SELECT page_id, strlen(payload) AS payload_bytes, max(page_id) OVER (PARTITION BY hex) AS kept,
         array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(hex, (i // 4) * 5 + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)
           for i in range(32)], '') AS payload_digest
  FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM b
"""

ORACLES: dict[str, str] = {
    "op2_mix": MIX,
    "op4_jaccard_join": JACCARD,
    "op6_decontaminate": DECONTAMINATE,
    "op8_url_filter": URLS,
    "op9_substring_dedup": REPEATS,
    "op12_periodic_runs": RUNS,
    "op13_warc": WARC,
}
