"""SQL of the queries that SQL can express, for DuckDB.

Components are the fixpoint of least labels over links. The mix, learned rules and scores, randomised filters and tokenisers have none.
"""

_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"
_LEAST = """reach(node, root) AS (
  SELECT id, id FROM nodes
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
parts AS (SELECT node, min(root) AS root FROM reach GROUP BY node)"""

SQL = {
    "op2_minhash_near_dedup": f"""WITH RECURSIVE w AS (
  SELECT doc_id AS id, {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sets AS (
  SELECT id, CASE WHEN len(w) >= 2 THEN list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))
                  ELSE w END AS s FROM w),
classes AS (SELECT s, min(id) AS c, len(s) AS n FROM sets GROUP BY s),
items AS (SELECT c, n, unnest(s) AS x FROM classes WHERE n > 0),
pairs AS (SELECT p.c AS a, q.c AS b, p.n AS na, q.n AS nb, count(*) AS k FROM items p JOIN items q ON p.x = q.x AND p.c <> q.c
         AND 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n) GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * k >= 80 * (na + nb - k)),
nodes AS (SELECT c AS id FROM classes WHERE n > 0),
{_LEAST}
SELECT t.id AS doc_id, len(t.s)::BIGINT AS n_shingles, CASE WHEN len(t.s) > 0 THEN p.root ELSE t.id END AS component_id,
       t.id = (CASE WHEN len(t.s) > 0 THEN p.root ELSE t.id END) AS kept
FROM sets t JOIN classes k ON k.s = t.s LEFT JOIN parts p ON p.node = k.c""",
    "op3_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS.format(text="text")} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x FROM places),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, range(13) r(k)),
marks AS (SELECT doc_id, list_sort(list(i)) AS g FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(len(m.g), 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN marks m ON m.doc_id = w.doc_id LEFT JOIN kept k ON k.doc_id = w.doc_id""",
    "op6_embedding_near_dedup": f"""WITH RECURSIVE v AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS v,
         coalesce(len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
                  AND list_bool_or(list_transform(embedding, lambda x: x <> 0)), false) AS fine FROM embeddings),
links AS (SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.id <> q.id AND p.fine AND q.fine AND list_cosine_similarity(p.v, q.v) >= 0.9),
nodes AS (SELECT id FROM v),
{_LEAST}
SELECT v.id AS vec_id, (SELECT count(*) FROM links l WHERE l.a = v.id)::BIGINT AS n_links, p.root AS component_id, p.root = v.id AS kept
FROM v JOIN parts p ON p.node = v.id""",
    "op13_collocations": r"""WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS t FROM d),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
      FROM w, range(1, 5) r(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 30),
cuts AS (SELECT lang, k, phrase, a, w, j, array_to_string(w[1:j], ' ') AS p, array_to_string(w[j + 1:], ' ') AS q
         FROM c, range(1, 4) t(j) WHERE j < k),
s AS (SELECT t.lang, t.phrase, t.a, t.j, x.f AS l, y.f AS r, (2000000::HUGEINT * t.a // (x.f + y.f))::BIGINT AS score
      FROM cuts t JOIN f x ON x.lang = t.lang AND x.phrase = t.p JOIN f y ON y.lang = t.lang AND y.phrase = t.q),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + z - 1], ' ') AS phrase, max(a) AS longer
           FROM c, range(2, 4) u(z), range(1, 4) v(i) WHERE z < k AND i + z - 1 <= k GROUP BY ALL),
left_ AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
          WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, n.n, k.score FROM ranked k JOIN n ON n.lang = k.lang WHERE k.rank <= 2000""",
}
