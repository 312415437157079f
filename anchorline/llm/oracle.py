"""DuckDB SQL for those text queries that SQL can express on whole tables.

Fingerprints, packing, the network, the differencing and the alignment are beyond
it; tests compare those with brute force.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from .lm import BACKOFF, MIN_COUNT

_LOW = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"


def _words(text: str, pattern: str) -> str:
    return f"coalesce(regexp_extract_all({text}, '{pattern}'), [])"


OP3 = f"""
WITH d AS (SELECT doc_id, {_words(_LOW, _ALNUM)} AS w FROM documents),
b AS (
  SELECT item_id, w, least(10, len(w)) AS k
  FROM (SELECT item_id, {_words(_LOW, _ALNUM)} AS w FROM benchmark WHERE item_id IS NOT NULL)
  WHERE len(w) > 0
),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM b)
),
places AS (
  SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS s
  FROM d, (SELECT DISTINCT k FROM windows)
),
hits AS (
  SELECT doc_id, s, p.k AS k, item_id
  FROM (SELECT doc_id, k, s, array_to_string(w[s : s + k - 1], ' ') AS g FROM places) p
  JOIN windows USING (k, g)
),
words AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + k)) AS pos FROM hits) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP4 = f"""
WITH d AS (SELECT doc_id, {_words("text", _WORD)} AS w FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(w[s : s + 49], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - 48)) AS s FROM d)
),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS pos
  FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY g) AS first FROM windows)
  WHERE first < doc_id
),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS words
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d)
  ANTI JOIN gone USING (doc_id, pos)
  GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP8 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, s, md5(substr(h, 2 * s - 1, 800)) AS g
  FROM (SELECT *, unnest(range(1, len(h) // 2 - 398)) AS s FROM d)
),
repeats AS (SELECT doc_id, s FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM windows) WHERE n > 1),
runs AS (
  SELECT doc_id, min(s) AS lo, max(s) + 400 AS hi
  FROM (
    SELECT doc_id, s, sum(opens) OVER (PARTITION BY doc_id ORDER BY s) AS run
    FROM (
      SELECT doc_id, s,
        CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 400 THEN 0 ELSE 1 END AS opens
      FROM repeats
    )
  )
  GROUP BY doc_id, run
),
cuts AS (
  SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 1) AS before FROM runs
),
spans AS (
  SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, max(hi) AS rest,
    string_agg(substr(h, 2 * before - 1, 2 * (lo - before)), '' ORDER BY lo) AS front
  FROM cuts JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN rest IS NULL THEN h ELSE front || substr(h, 2 * rest - 1) END)) AS kept_sha256
FROM d LEFT JOIN spans USING (doc_id)
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_LOW, _WORD)} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[s : s + 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w), 2))) AS s FROM d WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY ALL
),
links AS (
  SELECT a, b
  FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)
),
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a, b FROM pairs
  UNION
  SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
),
firsts AS (SELECT a AS doc_id, min(b) AS first FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(first, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(first, doc_id)) AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN firsts USING (doc_id)
"""

#: The same over shingles of five words, without the verdict.
OP11 = (
    OP9.replace("w[s : s + 1]", "w[s : s + 4]")
    .replace("greatest(len(w), 2)", "greatest(len(w) - 3, 2)")
    .replace(
        """ AS component_id,
  doc_id = least(doc_id, coalesce(first, doc_id)) AS kept""",
        " AS component_id",
    )
)

OP10 = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (SELECT doc_id, h, unnest(range(1, len(h) // 2 + 1)) AS s FROM d),
grams AS (
  SELECT doc_id, s, substr(h, 2 * s - 1, 2) AS c,
    CASE WHEN s > 1 THEN substr(h, 2 * s - 3, 4) END AS bc,
    CASE WHEN s > 2 THEN substr(h, 2 * s - 5, 6) END AS abc
  FROM places
),
c1 AS (SELECT c AS g, count(*) AS n FROM grams GROUP BY c),
c2 AS (SELECT bc AS g, count(*) AS n FROM grams WHERE bc IS NOT NULL GROUP BY bc),
c3 AS (SELECT abc AS g, count(*) AS n FROM grams WHERE abc IS NOT NULL GROUP BY abc),
total AS (SELECT sum(n)::DOUBLE AS n FROM c1),
ones AS (SELECT g, ln(c1.n / total.n) AS score FROM c1, total),
twos AS (
  SELECT c2.g, CASE WHEN c2.n >= {MIN_COUNT} THEN ln(c2.n / m.n) ELSE ln({BACKOFF}) + l.score END AS score
  FROM c2 JOIN c1 m ON m.g = c2.g[1:2] JOIN ones l ON l.g = c2.g[3:4]
),
threes AS (
  SELECT c3.g, CASE WHEN c3.n >= {MIN_COUNT} THEN ln(c3.n / h.n) ELSE ln({BACKOFF}) + t.score END AS score
  FROM c3 JOIN c2 h ON h.g = c3.g[1:4] JOIN twos t ON t.g = c3.g[3:6]
),
scored AS (
  SELECT doc_id, count(*) AS n_bytes,
    sum(CASE WHEN s = 1 THEN ones.score WHEN s = 2 THEN twos.score ELSE threes.score END) AS score
  FROM grams
  LEFT JOIN ones ON ones.g = c LEFT JOIN twos ON twos.g = bc LEFT JOIN threes ON threes.g = abc
  GROUP BY doc_id
)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, round(score, 3) AS log_score, round(score / n_bytes, 6) AS mean_log_score
FROM d LEFT JOIN scored USING (doc_id)
"""

#: Of ``op10_word_backoff``, which the entry registers beside the byte form.
OP10_WORDS = f"""
WITH d AS (SELECT doc_id, {_words("text", _WORD)} AS w FROM documents),
grams AS (
  SELECT doc_id, s, w[s] AS c,
    CASE WHEN s > 1 THEN w[s - 1] END AS b,
    CASE WHEN s > 2 THEN w[s - 2] END AS a
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d)
),
c1 AS (SELECT c, count(*) AS n FROM grams GROUP BY c),
c2 AS (SELECT b, c, count(*) AS n FROM grams WHERE s > 1 GROUP BY b, c),
c3 AS (SELECT a, b, c, count(*) AS n FROM grams WHERE s > 2 GROUP BY a, b, c),
total AS (SELECT sum(n)::DOUBLE AS n FROM c1),
ones AS (SELECT c, ln(c1.n / total.n) AS score FROM c1, total),
twos AS (
  SELECT c2.b, c2.c, CASE WHEN c2.n >= {MIN_COUNT} THEN ln(c2.n / m.n) ELSE ln({BACKOFF}) + l.score END AS score
  FROM c2 JOIN c1 m ON m.c = c2.b JOIN ones l ON l.c = c2.c
),
threes AS (
  SELECT c3.a, c3.b, c3.c, CASE WHEN c3.n >= {MIN_COUNT} THEN ln(c3.n / h.n) ELSE ln({BACKOFF}) + t.score END AS score
  FROM c3 JOIN c2 h ON h.b = c3.a AND h.c = c3.b JOIN twos t ON t.b = c3.b AND t.c = c3.c
),
scored AS (
  SELECT doc_id, count(*) AS n_words,
    sum(CASE WHEN s = 1 THEN ones.score WHEN s = 2 THEN twos.score ELSE threes.score END) AS score
  FROM grams LEFT JOIN ones USING (c) LEFT JOIN twos USING (b, c) LEFT JOIN threes USING (a, b, c)
  GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, round(score, 3) AS log_score, round(score / n_words, 6) AS mean_log_score
FROM d LEFT JOIN scored USING (doc_id)
"""


#: CRC-32 of the ASCII digits of an id, bit by bit.
_CRC = """xor(4294967295, list_reduce(
  list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, x: list_reduce(list_prepend(xor(crc, x), range(8)), lambda c, bit: xor(c >> 1, (c & 1) * 3988292384))
))"""

OP12 = f"""
WITH t AS (
  SELECT row_number() OVER () AS number, doc_id, {_words("text", _WORD)} AS w,
    CASE WHEN doc_id IS NOT NULL THEN {_CRC} END AS h
  FROM documents
),
u AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
v AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM u),
d AS (
  SELECT number, doc_id, n,
    CASE WHEN a IS NULL THEN w
    ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w
  FROM v
),
words AS (SELECT number, n, unnest(w) AS word, unnest(range(n)) AS i FROM d),
matches AS (
  SELECT x.number, x.i, y.i - x.i AS q
  FROM words x JOIN words y ON x.number = y.number AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4
),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY number, q ORDER BY i) AS island FROM matches),
stretches AS (
  SELECT number, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY number, q, island
  HAVING count(*) + q >= greatest(6, 4 * q)
),
runs AS (
  SELECT * FROM stretches x WHERE NOT EXISTS (
    FROM stretches y WHERE y.number = x.number AND y.q < x.q AND x.q % y.q = 0
      AND y.start <= x.start AND y.start + y.length >= x.start + x.length)
),
listed AS (
  SELECT number, count(*) AS n_runs, string_agg(concat_ws(',', start, length, q) || chr(10), '' ORDER BY start, q) AS lines,
    min((-length, start, q)) AS top
  FROM runs GROUP BY number
),
gone AS (SELECT DISTINCT number, unnest(range(start + q, start + length)) AS i FROM runs),
kept AS (
  SELECT number, string_agg(word, ' ' ORDER BY i) AS rest FROM words ANTI JOIN gone USING (number, i) GROUP BY number
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top[2] AS start, -top[1] AS length, top[3] AS period,
  (-1000 * top[1]) // top[3] AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(coalesce(rest, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (number) LEFT JOIN kept USING (number)
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP13 = f"""
WITH d AS (
  SELECT number, doc_id, w, len(w) AS n
  FROM (SELECT row_number() OVER () AS number, doc_id, {_words(_LOW, _TERM)} AS w FROM documents)
  WHERE len(w) > 0
),
b AS (SELECT item_id, unnest({_words(_LOW, _TERM)}) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS repeats FROM b GROUP BY ALL),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM d),
tf AS (
  SELECT number, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT number, doc_id, n, unnest(w) AS term FROM d) SEMI JOIN q USING (term)
  GROUP BY ALL
),
weight AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total
),
scored AS (
  SELECT item_id, number, doc_id,
    sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN weight USING (term), total
  GROUP BY item_id, number, doc_id
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS place
  FROM scored WHERE score > 0
)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked WHERE place <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_wu_manber": OP3,
        "op4_super_kmers": OP4,
        "op8_interval_tree": OP8,
        "op9_bayesian_minhash": OP9,
        "op10_stupid_backoff": OP10,
        "op11_prefix_join": OP11,
        "op12_tiled_runs": OP12,
        "op13_blocked_search": OP13,
    }
