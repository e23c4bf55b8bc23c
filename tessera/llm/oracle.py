"""DuckDB SQL for the rows of the queries that SQL can express on whole tables."""

from tessera.llm import licenses

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Words of a text in lower case (A-Z only); none for a null.
WORDS = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"

#: Distinct 5-word shingles; a shorter sequence is one shingle.
SHINGLES = """
 SELECT DISTINCT {id} AS id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS s
 FROM (SELECT {id}, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM (SELECT {id}, {words} AS w FROM {table}) WHERE len(w) > 0)
"""


def _shingles(table: str, key: str) -> str:
    return SHINGLES.format(id=key, table=table, words=WORDS)


def _listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]::VARCHAR[]"


TEMPLATES = ",\n ".join(
    f"({i}, '{t.label}', {_listed(t.words)}, {_listed(t.must)}, {_listed(t.never)}, {t.needed}, {t.stride}, {t.exact})" for i, t in enumerate(licenses.TEMPLATES)
)

SQL = {
    "op3_jaccard": f"""
WITH RECURSIVE d AS MATERIALIZED ({_shingles("documents", "doc_id")}),
n AS MATERIALIZED (SELECT id, count(*) AS n FROM d GROUP BY id),
c AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM d x JOIN d y USING (s) WHERE x.id <> y.id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
r AS (SELECT id AS node, id AS seen FROM n UNION SELECT l.b, r.seen FROM r JOIN l ON l.a = r.node)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.least, doc_id) AS component_id
FROM documents LEFT JOIN n ON n.id = doc_id LEFT JOIN (SELECT node, min(seen) AS least FROM r GROUP BY node) m ON m.node = doc_id
""",
    "op6_exact": f"""
WITH n AS (SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
""",
    "op8_lines": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM d),
k AS (SELECT *, {LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.doc_id, k.pos, k.line, coalesce(f.first <> k.doc_id, false) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op9_substrings": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS t FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT t, min(doc_id) AS first FROM s GROUP BY t HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT s.doc_id, s.i, unnest(generate_series(0, 12)) AS k FROM s JOIN f USING (t) WHERE f.first < s.doc_id)),
a AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM d),
m AS (SELECT a.doc_id, a.i, a.x, g.i IS NOT NULL AS gone FROM a LEFT JOIN g ON g.doc_id = a.doc_id AND g.i = a.i),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
""",
    "op10_contamination": f"""
WITH d AS ({_shingles("documents", "doc_id")}), b AS ({_shingles("benchmark", "item_id")}),
n AS (SELECT id, count(*) AS n FROM b GROUP BY id),
c AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_common FROM d JOIN b USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_shingles, n_common, n_common / n AS containment FROM c JOIN n ON n.id = c.item_id WHERE 100 * n_common >= 80 * n
""",
    "op11_audit": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
x AS (SELECT part, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic,
 [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(first < doc_id, false)] AS bad
 FROM d JOIN f USING (t)),
g AS (SELECT part, bad, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM x GROUP BY part, bad),
l(i, c) AS (VALUES (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS idx, a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT idx, filter_order, unnest(range(1, 6)) AS step FROM o),
m AS (SELECT part, filter_order, step, n, n_good, n_toxic, list_bool_or([bad[k] FOR k IN idx[1 : step - 1]] || [false]) AS early, bad[idx[step]] AS fails, len([b FOR b IN bad IF b]) = 1 AS one FROM s, g),
r AS (SELECT part, filter_order, step, sum(n) FILTER (NOT early AND NOT fails) AS kept, sum(n) FILTER (NOT early AND fails) AS removed, sum(n) FILTER (early AND fails) AS redundant,
 sum(n) FILTER (one AND fails) AS unique_fails, sum(n_good) FILTER (NOT early AND fails) AS good_lost, sum(n_toxic) FILTER (NOT early AND fails) AS toxic_lost FROM m GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
 coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
 (sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley
FROM r
""",
    "op12_licenses": f"""
WITH t(template, label, words, must, never, needed, stride, exact) AS (VALUES {TEMPLATES}),
v AS (SELECT template, stride, unnest(list_distinct(words || must || never)) AS x FROM t),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS MATERIALIZED (SELECT * FROM (SELECT r, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS x FROM d) WHERE x IN (SELECT x FROM v)),
b AS (SELECT r, template, blk, list(DISTINCT x) AS held FROM (SELECT r, template, x, unnest([i // stride, i // stride - 1]) AS blk FROM p JOIN v USING (x)) WHERE blk >= 0 GROUP BY ALL),
n AS (SELECT r, template, label, len(list_intersect(list_distinct(words), held)) / len(list_distinct(words)) AS score FROM b JOIN t USING (template)
 WHERE NOT exact AND len(list_intersect(list_distinct(words), held)) >= needed AND len(list_intersect(must, held)) = len(must) AND len(list_intersect(never, held)) = 0),
q AS (SELECT p.r, p.i, label FROM p JOIN t ON exact AND p.x = words[1] JOIN d ON d.r = p.r WHERE d.w[i + 1 : i + len(words)] = words),
a AS (SELECT r, label, score FROM n UNION ALL SELECT r, label, 1.0 FROM q),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM q GROUP BY r),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM a GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
 coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN base USING (r) LEFT JOIN every USING (r)
""",
}
