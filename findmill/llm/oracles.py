"""DuckDB SQL of the queries that SQL can express; written from the contracts, not from the operators."""

from __future__ import annotations

_SPACES = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_SPACES}'), lambda x: x <> '')"


#: Everything reachable over the links l(a, b), both directions.
_REACH = "r(id, seen) AS (SELECT id, id FROM ids UNION SELECT r.id, l.b FROM r JOIN l ON r.seen = l.a)"

OP3 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
ids AS (SELECT vec_id AS id FROM embeddings), {_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM l WHERE l.a = r.id) AS n_links, min(seen) AS component_id, min(seen) = id AS kept FROM r GROUP BY id
"""

OP4 = f"""
WITH RECURSIVE t AS (SELECT doc_id, {_words(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * k >= 75 * (na + nb - k)),
ids AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT s.doc_id, len(g) AS n_shingles, c AS component_id FROM s JOIN (SELECT id, min(seen) AS c FROM r GROUP BY id) x ON s.doc_id = x.id
"""

OP9 = f"""
WITH t AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
u AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t WHERE len(w) >= 20)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS early FROM u),
g AS (SELECT DISTINCT doc_id, i + j AS pos FROM f, range(0, 20) x(j) WHERE early),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM t),
k AS (SELECT p.doc_id, count(g.pos) AS gone, string_agg(word, ' ' ORDER BY p.pos) FILTER (g.pos IS NULL) AS kept FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id)
SELECT t.doc_id, len(w) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k ON t.doc_id = k.doc_id
"""


def _terms(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP12 = f"""
WITH d AS (SELECT doc_id, {_terms('text', _TERM)} AS w FROM documents),
c AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, len(w) AS size, t, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM d) GROUP BY ALL),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
q AS (SELECT DISTINCT item_id, unnest({_terms('text', _TERM)}) AS t FROM benchmark),
s AS (SELECT item_id, doc_id, sum(floor(1000 * ln((2.0::DOUBLE * n + 2) / (2.0::DOUBLE * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * size * n) // l)))))::BIGINT AS score
      FROM q JOIN f USING (t) JOIN p USING (t), c GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10
"""

#: A word's bytes are its bits, lowest first; each bit shifts the register of the CRC once.
_CRC = """WITH h AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM every)),
     b AS (SELECT word, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS bytes FROM h)
SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, 8 * len(bytes)), lambda i: (bytes[i // 8 + 1] >> (i % 8)) & 1)),
                   lambda c, bit: xor(c >> 1, CASE WHEN (xor(c, bit) & 1) = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 10000 AS bucket FROM b"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, {_terms('text', _WORD)} AS w FROM documents),
a AS (SELECT unnest({_terms('text', _WORD)}) AS word FROM benchmark),
e AS (SELECT i, unnest(w) AS word FROM d),
every AS (SELECT word FROM e UNION ALL SELECT word FROM a),
k AS ({_CRC}),
s AS (SELECT bucket, count(*) AS s FROM e JOIN k USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM a JOIN k USING (word) GROUP BY bucket),
g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM e) + 10000) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM a) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t ON s.bucket = t.bucket),
w AS (SELECT i, sum(gain)::BIGINT AS weight FROM e JOIN k USING (word) JOIN g USING (bucket) GROUP BY i),
x AS (SELECT d.i, doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM d LEFT JOIN w ON d.i = w.i),
r AS (SELECT i, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM x LEFT JOIN r ON x.i = r.i
"""
