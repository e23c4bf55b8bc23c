"""DuckDB twins of the registered queries.

Written by a different method than the Spark side wherever possible: dense
all-pairs scoring instead of candidate sets, window running sums instead of
folds, recursive CTEs for sequential recurrences, bitmask enumeration for
itemsets.  Tables are pre-registered views named like the parquet files.
"""

from __future__ import annotations

from tessera.functions.text import ENGLISH_STOP_WORDS

SQL: dict[str, str] = {}

WS = r"list_filter(regexp_split_to_array({x}, '\s+'), lambda t: t <> '')"


def _ws(x: str) -> str:
    return WS.format(x=x)


def bm25_ctes(doc_from: str, query_from: str) -> str:
    """CTEs d, dl, post, cs, idf, q, qt, pairs (raw BM25 of matching pairs)."""
    return f"""
d AS (SELECT doc_id, coalesce(source, '') AS source, {_ws('text')} AS toks FROM {doc_from}),
dl AS (SELECT doc_id, source, len(toks) AS dl FROM d),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM d) GROUP BY doc_id, term),
cs AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
dft AS (SELECT term, count(*) AS df FROM post GROUP BY term),
idf0 AS (SELECT term, df, ln((SELECT n FROM cs) - df + 0.5) - ln(df + 0.5) AS idf FROM dft),
idf AS (SELECT term, df, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0),
q AS ({query_from}),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_ws('query')}) AS term FROM q) GROUP BY query_id, term),
pairs AS (
  SELECT qt.query_id, post.doc_id,
         sum(qtf * idf.idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl.dl / (SELECT avgdl FROM cs)))) AS raw
  FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN dl USING (doc_id)
  GROUP BY qt.query_id, post.doc_id)"""


ALL_QUERIES = "SELECT item_id AS query_id, text AS query, []::VARCHAR[] AS kb FROM benchmark"
KB_QUERIES = """SELECT b.item_id AS query_id, b.text AS query,
       CASE WHEN d.source IS NULL THEN []::VARCHAR[] ELSE [d.source] END AS kb
FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id"""


def _norm(x: str, part: str = "query_id") -> str:
    return (f"CASE WHEN max({x}) OVER (PARTITION BY {part}) = min({x}) OVER (PARTITION BY {part}) THEN 0.5 "
            f"ELSE ({x} - min({x}) OVER (PARTITION BY {part})) / (max({x}) OVER (PARTITION BY {part}) - min({x}) OVER (PARTITION BY {part})) END")


def _bm25_search(query_from: str, extra_cols: str) -> str:
    return f"""
WITH {bm25_ctes('documents', query_from)},
dense AS (
  SELECT q.query_id, dl.doc_id, coalesce(p.raw, 0.0) AS raw
  FROM q JOIN dl ON (len(q.kb) = 0 OR list_contains(q.kb, dl.source))
  LEFT JOIN pairs p ON p.query_id = q.query_id AND p.doc_id = dl.doc_id),
nrm AS (SELECT query_id, doc_id, (floor(({_norm('raw')}) * 1000000 + 0.5) / 1000000) AS score FROM dense),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM nrm)
SELECT r.query_id, r.rank, r.doc_id, r.score, {extra_cols}
FROM r JOIN documents d USING (doc_id) WHERE r.rank <= 10"""


SQL["bm25_search"] = _bm25_search(ALL_QUERIES, "coalesce(d.source, '') AS source, d.lang")
SQL["kb_search"] = _bm25_search(KB_QUERIES, "coalesce(d.source, '') AS source")

VEC_CTES = """
dv AS (SELECT e.vec_id AS doc_id, e.embedding::DOUBLE[] AS v FROM embeddings e JOIN documents x ON x.doc_id = e.vec_id),
qv AS (SELECT e.vec_id AS query_id, e.embedding::DOUBLE[] AS v FROM embeddings e WHERE e.vec_id IN (SELECT item_id FROM benchmark))"""

SQL["semantic_search"] = f"""
WITH {VEC_CTES},
dense AS (SELECT qv.query_id, dv.doc_id, list_inner_product(qv.v, dv.v) AS sem FROM qv, dv),
nrm AS (SELECT query_id, doc_id, (floor(({_norm('sem')}) * 1000000 + 0.5) / 1000000) AS score FROM dense),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM nrm)
SELECT r.query_id, r.rank, r.doc_id, r.score, coalesce(d.source, '') AS source
FROM r JOIN documents d USING (doc_id) WHERE r.rank <= 10"""

HYBRID_CTES = f"""
{bm25_ctes('documents', ALL_QUERIES)},
{VEC_CTES},
dense AS (
  SELECT q.query_id, dl.doc_id, coalesce(p.raw, 0.0) AS raw,
         CASE WHEN qv.v IS NOT NULL AND dv.v IS NOT NULL THEN list_inner_product(qv.v, dv.v) END AS sem
  FROM q JOIN dl ON true LEFT JOIN qv USING (query_id) LEFT JOIN dv USING (doc_id)
  LEFT JOIN pairs p ON p.query_id = q.query_id AND p.doc_id = dl.doc_id),
nrm AS (SELECT query_id, doc_id, {_norm('raw')} AS bn, CASE WHEN sem IS NULL THEN 0.0 ELSE {_norm('sem')} END AS sn FROM dense),
fused AS (SELECT query_id, doc_id, (floor((bn) * 1000000 + 0.5) / 1000000) AS bm25, (floor((sn) * 1000000 + 0.5) / 1000000) AS semantic, (floor((0.6 * bn + 0.4 * sn) * 1000000 + 0.5) / 1000000) AS score FROM nrm),
hyb_all AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused),
hyb AS (SELECT * FROM hyb_all WHERE rank <= 10)"""

SQL["hybrid_search"] = f"""
WITH {HYBRID_CTES}
SELECT h.query_id, h.rank, h.doc_id, h.score, h.bm25, h.semantic, coalesce(d.source, '') AS source
FROM hyb h JOIN documents d USING (doc_id)"""

SQL["rerank_features"] = f"""
WITH {HYBRID_CTES},
fb AS (SELECT doc_id, avg(greatest(1, 1 + 4 * quality - toxic)) / 5.0 AS fb FROM labels GROUP BY doc_id)
SELECT h.query_id, h.doc_id, h.score,
       (floor((length(d.text) / 1000.0) * 1000000 + 0.5) / 1000000) AS length,
       (floor((coalesce(len(list_intersect(list_distinct({_ws('b.text')}), {_ws('d.text')})) / nullif(len(list_distinct({_ws('b.text')})), 0), 0.0)) * 1000000 + 0.5) / 1000000) AS overlap,
       0.8 AS freshness,
       (floor((coalesce(fb.fb, 0.9)) * 1000000 + 0.5) / 1000000) AS feedback
FROM hyb h JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = h.query_id LEFT JOIN fb USING (doc_id)"""

SQL["corpus_stats"] = f"""
WITH {bm25_ctes('documents', ALL_QUERIES)}
SELECT term, df, (floor((idf) * 1000000 + 0.5) / 1000000) AS idf, (SELECT n FROM cs) AS n_docs, (floor(((SELECT avgdl FROM cs)) * 1000000 + 0.5) / 1000000) AS avgdl FROM idf"""

SQL["appended_index"] = SQL["corpus_stats"]

SQL["mixed_search"] = f"""
WITH {HYBRID_CTES},
text AS (SELECT query_id, 'bm25' AS mode, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS rank, doc_id, bm25 AS score FROM fused),
own AS (SELECT query_id, doc_id, (floor(({_norm('sem')}) * 1000000 + 0.5) / 1000000) AS score FROM dense WHERE sem IS NOT NULL),
near AS (SELECT query_id, 'semantic' AS mode, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM own),
every AS (SELECT query_id, 'hybrid' AS mode, rank, doc_id, score FROM hyb_all UNION ALL SELECT * FROM text UNION ALL SELECT * FROM near)
SELECT query_id, mode, rank, doc_id, score FROM every
WHERE rank <= query_id % 10 + 1 AND mode = ['hybrid', 'semantic', 'bm25'][query_id % 3 + 1]"""

SQL["latest_feedback"] = """
WITH fb AS (SELECT event_id, ts, user_id AS doc_id, (1 + event_id % 5)::INTEGER AS score FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, event_id DESC) AS rn,
             max(ts) OVER (PARTITION BY doc_id) AS mts, count(*) OVER (PARTITION BY doc_id) AS n FROM fb)
SELECT doc_id, score, mts AS ts, n AS n_feedback FROM r WHERE rn = 1"""

SQL["top_queries"] = """
WITH lg AS (SELECT ts, event_type AS query FROM events),
m AS (SELECT max(ts) AS as_of FROM lg)
SELECT query, count(*) AS n FROM lg, m
WHERE ts > as_of - INTERVAL 7 DAYS AND ts <= as_of
GROUP BY query ORDER BY n DESC, query LIMIT 10"""

STOP_LIST = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS) + "]"

# ---------------------------------------------------------------- documents

SENTS = r"""list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
                                  lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"""
STRUCTURED = "(contains({x}, '# ') OR contains({x}, '## ') OR contains({x}, '<h1>') OR contains({x}, '<div'))"
HEADING = r"^\s*(#+ \s*\S|<h\d>)"


def _chunks_sql(src: str, id_col: str, text: str) -> str:
    """Structured: running sum of heading lines.  Otherwise: recursive walk over sentences."""
    st = STRUCTURED.format(x=text)
    return f"""
WITH RECURSIVE
src AS (SELECT {id_col} AS id, {text} AS t FROM {src}),
ln AS (SELECT id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i
       FROM src WHERE {STRUCTURED.format(x='t')}),
grp AS (SELECT id, i, line, sum(CASE WHEN i > 1 AND regexp_matches(line, '{HEADING}') THEN 1 ELSE 0 END)
               OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM ln),
structured AS (SELECT id, g + 1 AS chunk_no, string_agg(line, chr(10) ORDER BY i) AS chunk FROM grp GROUP BY id, g),
ss AS (SELECT id, {SENTS.format(x='t')} AS sents FROM src WHERE NOT {STRUCTURED.format(x='t')}),
s AS (SELECT id, unnest(sents) AS sent, unnest(range(1, len(sents) + 1)) AS i FROM ss),
walk(id, i, chunk_no, cur) AS (
  SELECT id, i, 1, length(sent) FROM s WHERE i = 1
  UNION ALL
  SELECT w.id, s.i,
         CASE WHEN w.cur + length(s.sent) > 1000 THEN w.chunk_no + 1 ELSE w.chunk_no END,
         CASE WHEN w.cur + length(s.sent) > 1000 THEN length(s.sent) ELSE w.cur + length(s.sent) END
  FROM walk w JOIN s ON s.id = w.id AND s.i = w.i + 1),
packed AS (SELECT w.id, w.chunk_no, string_agg(s.sent, ' ' ORDER BY s.i) AS chunk FROM walk w JOIN s USING (id, i) GROUP BY w.id, w.chunk_no),
allc AS (SELECT * FROM structured UNION ALL SELECT * FROM packed)
SELECT id AS {id_col}, chunk_no::BIGINT AS chunk_no, chunk, length(chunk)::BIGINT AS n_chars FROM allc"""


SQL["doc_chunks"] = _chunks_sql("documents", "doc_id", "text")
SQL["page_chunks"] = _chunks_sql("pages", "page_id", "replace(html, '<h1>', chr(10) || '<h1>')")

TITLE_LINE = r"list_filter(list_transform(string_split({x}, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: length(l) BETWEEN 1 AND 99)[1]"
HAS_HTML_TITLE = r"""(regexp_matches({x}, '(?i)<html[\s>]') AND regexp_matches({x}, '(?is)<title[^>]*>.*?</title>'))"""
HTML_TITLE = r"""replace(replace(replace(replace(replace(nullif(regexp_extract({x}, '(?is)<title[^>]*>(.*?)</title>', 1), ''),
          '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')"""
DATES = r"array_to_string(regexp_extract_all({x}, '(\d{{4}}-\d{{2}}-\d{{2}})', 1), ',')"


def _title(x: str) -> str:
    return f"CASE WHEN {HAS_HTML_TITLE.format(x=x)} THEN {HTML_TITLE.format(x=x)} ELSE {TITLE_LINE.format(x=x)} END"


SQL["doc_metadata"] = f"SELECT doc_id, {_title('text')} AS title, {DATES.format(x='text')} AS dates FROM documents"
SQL["page_metadata"] = f"SELECT page_id, {_title('html')} AS title, {DATES.format(x='html')} AS dates FROM pages"
SQL["order_dates"] = f"""
WITH o AS (SELECT o_orderkey, 'order ' || o_orderkey || ' on ' || strftime(o_orderdate, '%Y-%m-%d') AS text FROM orders)
SELECT o_orderkey, {DATES.format(x='text')} AS dates, {TITLE_LINE.format(x='text')} AS title FROM o"""

WORDS = r"regexp_extract_all({x}, '([\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s])', 1)"
SQL["quality_features"] = f"""
WITH w AS (SELECT doc_id, length(text)::BIGINT AS n_chars, {WORDS.format(x='text')} AS words FROM documents)
SELECT doc_id, n_chars, len(words)::BIGINT AS n_words,
       (floor((len(list_filter(words, lambda x: list_contains({STOP_LIST}, lower(x)))) / nullif(len(words), 0)) * 1000000 + 0.5) / 1000000) AS stop_ratio,
       (floor((1 - len(list_distinct(words)) / nullif(len(words), 0)) * 1000000 + 0.5) / 1000000) AS repetition
FROM w"""

SQL["skip_processed"] = """
WITH done AS (SELECT DISTINCT md5(d.text) AS h FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels)),
n AS (SELECT md5(text) AS file_hash, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY md5(text))
SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.h = n.file_hash)"""

LINES = r"CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array(regexp_replace({x}, '(\r\n|\n|\r)$', ''), '\r\n|\n|\r') END"
SQL["version_delta"] = f"""
WITH v AS (SELECT conv_id AS doc_id, turn AS version, text FROM conversations WHERE role = 'assistant'),
vp AS (SELECT doc_id, version, text, coalesce(lag(text) OVER (PARTITION BY doc_id ORDER BY version), '') AS prev FROM v),
cur AS (SELECT doc_id, version, line, count(*) AS n FROM (SELECT doc_id, version, unnest({LINES.format(x='text')}) AS line FROM vp) GROUP BY ALL),
old AS (SELECT doc_id, version, line, count(*) AS n FROM (SELECT doc_id, version, unnest({LINES.format(x='prev')}) AS line FROM vp) GROUP BY ALL),
d AS (SELECT coalesce(c.doc_id, o.doc_id) AS doc_id, coalesce(c.version, o.version) AS version, coalesce(c.line, o.line) AS line,
             coalesce(c.n, 0) - coalesce(o.n, 0) AS diff
      FROM cur c FULL OUTER JOIN old o ON c.doc_id = o.doc_id AND c.version = o.version AND c.line = o.line)
SELECT doc_id, version, line, CASE WHEN diff > 0 THEN 'added' ELSE 'removed' END AS change, abs(diff)::BIGINT AS n FROM d WHERE diff <> 0"""

# ---------------------------------------------------------------- behaviour

def _sessions_sql(gap_seconds: int) -> str:
    return f"""
e AS (SELECT event_id, user_id, ts, event_type, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
f AS (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) >= {gap_seconds * 1_000_000} THEN 1 ELSE 0 END)
                 OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sno FROM e),
g AS (SELECT *, min(ts) OVER (PARTITION BY user_id, sno) AS session_start FROM f),
s AS (SELECT event_id, user_id, ts, event_type, session_start,
             sha256(user_id::VARCHAR || '-' || epoch_us(session_start)::VARCHAR || 'tessera-session-salt') AS session_id FROM g)"""


SQL["sessions"] = f"WITH {_sessions_sql(1800)} SELECT event_id, user_id, ts, event_type, session_id, session_start FROM s"
SQL["session_summary"] = f"""
WITH {_sessions_sql(1800)}
SELECT user_id, session_id, session_start, max(ts) + INTERVAL 1800 SECONDS AS session_end, count(*) AS n_events,
       array_to_string(list_sort(list(DISTINCT event_type)), ',') AS items
FROM s GROUP BY user_id, session_id, session_start"""
SQL["frequent_patterns"] = f"""
WITH {_sessions_sql(12 * 3600)},
b AS (SELECT session_id, list(DISTINCT event_type) AS basket FROM s GROUP BY session_id),
n AS (SELECT count(*) AS n FROM b),
types AS (SELECT list_sort(list(DISTINCT event_type)) AS all_types FROM events),
subsets AS (SELECT list_filter(all_types, lambda x, i: ((m >> (i - 1)) & 1) = 1) AS items
            FROM types, range(1, (1 << len(all_types))::BIGINT) r(m)),
c AS (SELECT s.items, count(*) FILTER (WHERE list_has_all(b.basket, s.items)) AS freq FROM subsets s, b GROUP BY s.items)
SELECT array_to_string(items, ',') AS items, freq, (floor((freq / (SELECT n FROM n)) * 1000000 + 0.5) / 1000000) AS support
FROM c WHERE freq >= ceil(0.05::DOUBLE * (SELECT n FROM n))"""

# ---------------------------------------------------------------- evaluation

STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
EVAL_CTES = f"""
cases AS (
  SELECT u.conv_id::VARCHAR || '-' || u.turn::VARCHAR AS case_id, u.conv_id, u.turn, a.text AS expected,
         'cat' || (u.turn % 3)::VARCHAR AS category
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'),
resp AS (
  SELECT 'model-' || m::VARCHAR AS model, case_id, category, expected, conv_id % 5 AS run,
         CASE WHEN (conv_id * 31 + turn * 7) % 10 >= m THEN '  ' || expected || chr(10) ELSE 'I do not know.' END AS response
  FROM cases, range(0, 5) r(m)),
ncase AS (SELECT category, count(*) AS n_cases FROM cases GROUP BY category),
acc AS (
  SELECT r.model, r.category AS dim, 'accuracy' AS metric,
         sum(CASE WHEN {STRIP.format(x='r.response')} = {STRIP.format(x='r.expected')} THEN 1.0 ELSE 0.0 END) / n.n_cases AS score,
         n.n_cases, count(*) AS n_responses
  FROM resp r JOIN ncase n USING (category) GROUP BY r.model, r.category, n.n_cases)"""

SQL["eval_scores"] = f"WITH {EVAL_CTES} SELECT model, dim, metric, (floor((score) * 1000000 + 0.5) / 1000000) AS score, n_cases, n_responses FROM acc"
SQL["eval_composite"] = f"""
WITH {EVAL_CTES}, w(dim, weight) AS (VALUES ('cat0', 0.5::DOUBLE), ('cat1', 0.3::DOUBLE), ('cat2', 0.2::DOUBLE))
SELECT model, (floor((sum(weight * score) / sum(weight)) * 1000000 + 0.5) / 1000000) AS composite FROM acc JOIN w USING (dim) GROUP BY model"""
SQL["eval_radar"] = f"""
WITH {EVAL_CTES}
SELECT model, (floor((max(score) FILTER (WHERE dim = 'cat0')) * 1000000 + 0.5) / 1000000) AS cat0, (floor((max(score) FILTER (WHERE dim = 'cat1')) * 1000000 + 0.5) / 1000000) AS cat1,
       (floor((max(score) FILTER (WHERE dim = 'cat2')) * 1000000 + 0.5) / 1000000) AS cat2 FROM acc GROUP BY model"""
SQL["eval_recommend"] = f"""
WITH {EVAL_CTES},
req(req_id, dim, weight) AS (VALUES (1, 'cat0', 1.0::DOUBLE), (1, 'cat1', 0.0::DOUBLE), (1, 'cat2', 0.0::DOUBLE),
                                  (2, 'cat0', 0.2::DOUBLE), (2, 'cat1', 0.3::DOUBLE), (2, 'cat2', 0.5::DOUBLE)),
c AS (SELECT req_id, model, sum(weight * score) / (sqrt(sum(weight * weight)) * sqrt(sum(score * score))) AS cosine
      FROM req JOIN acc USING (dim) GROUP BY req_id, model),
r AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY cosine DESC NULLS LAST, model) AS rank FROM c)
SELECT req_id::BIGINT AS req_id, rank, model, (floor((cosine) * 1000000 + 0.5) / 1000000) AS cosine FROM r WHERE rank <= 3"""
SQL["eval_strengths"] = f"""
WITH {EVAL_CTES}
SELECT dim, model, (floor((score) * 1000000 + 0.5) / 1000000) AS score FROM
  (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY score DESC, model) AS rn FROM acc) WHERE rn = 1"""
SQL["eval_trend"] = f"""
WITH {EVAL_CTES},
h AS (SELECT model, run::BIGINT AS run,
             avg(CASE WHEN {STRIP.format(x='response')} = {STRIP.format(x='expected')} THEN 1.0 ELSE 0.0 END) AS score
      FROM resp GROUP BY model, run)
SELECT model, run, (floor((score) * 1000000 + 0.5) / 1000000) AS score,
       (floor((score - lag(score) OVER (PARTITION BY model ORDER BY run)) * 1000000 + 0.5) / 1000000) AS delta,
       (floor((avg(score) OVER (PARTITION BY model ORDER BY run ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) * 1000000 + 0.5) / 1000000) AS moving_avg
FROM h"""

# ---------------------------------------------------------------- routing

REGISTRY = """reg(model_idx, model, cost) AS (VALUES (0, 'gpt-3.5', 0.002::DECIMAL(18,6)), (1, 'claude-2', 0.0018::DECIMAL(18,6)),
  (2, 'stable-diffusion', 0.005::DECIMAL(18,6)), (3, 'whisper', 0.003::DECIMAL(18,6)), (4, 'palm-2', 0.0015::DECIMAL(18,6)))"""

TTL_CTES = """
tr AS (SELECT md5(props) AS cache_key, event_id AS req_id, ts, epoch_us(ts) AS t,
              row_number() OVER (PARTITION BY md5(props) ORDER BY epoch_us(ts), event_id) AS i FROM events),
tw(cache_key, i, exp, sid, hit) AS (
  SELECT cache_key, i, t + 3600000000, req_id, false FROM tr WHERE i = 1
  UNION ALL
  SELECT tr.cache_key, tr.i, CASE WHEN tr.t < tw.exp THEN tw.exp ELSE tr.t + 3600000000 END,
         CASE WHEN tr.t < tw.exp THEN tw.sid ELSE tr.req_id END, tr.t < tw.exp
  FROM tw JOIN tr ON tr.cache_key = tw.cache_key AND tr.i = tw.i + 1),
ttl AS (SELECT tr.cache_key, tr.req_id, tr.ts, tw.hit, tw.sid AS served_by FROM tw JOIN tr USING (cache_key, i))"""


def _budget_ctes(src: str) -> str:
    """Sequential walk per UTC day over ``src(req_id, ts, cost, qok)``: admit iff spent + cost <= 0.5."""
    return f"""
br AS (SELECT req_id, ts, CAST(ts AS DATE) AS day, cost, qok,
              row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY epoch_us(ts), req_id) AS i FROM {src}),
bw(day, i, spent, adm, before) AS (
  SELECT day, i, CASE WHEN cost <= 0.5 AND qok THEN cost ELSE 0 END::DECIMAL(18,6), cost <= 0.5, 0::DECIMAL(18,6) FROM br WHERE i = 1
  UNION ALL
  SELECT br.day, br.i, (bw.spent + CASE WHEN bw.spent + br.cost <= 0.5 AND br.qok THEN br.cost ELSE 0 END)::DECIMAL(18,6),
         bw.spent + br.cost <= 0.5, bw.spent
  FROM bw JOIN br ON br.day = bw.day AND br.i = bw.i + 1),
bud AS (SELECT br.req_id, br.day, br.ts, br.cost, bw.adm AS admitted, bw.before AS spent_before FROM bw JOIN br USING (day, i))"""


REQ = f"""{REGISTRY},
rq AS (SELECT e.event_id AS req_id, e.ts, reg.model, reg.cost, e.value / 50.0 >= 0.5 AS qok, e.value / 50.0 AS quality
       FROM events e JOIN reg ON reg.model_idx = e.event_id % 5)"""

SQL["ttl_cache"] = f"WITH RECURSIVE {TTL_CTES} SELECT cache_key, req_id, ts, hit, served_by FROM ttl"
SQL["budget_admission"] = f"WITH RECURSIVE {REQ}, {_budget_ctes('rq')} SELECT day, req_id, ts, cost, admitted, spent_before FROM bud"

ROUTE_CTES = f"""{REQ}, {TTL_CTES},
miss AS (SELECT rq.* FROM rq JOIN ttl USING (req_id) WHERE NOT ttl.hit),
{_budget_ctes('miss')},
routed AS (
  SELECT rq.req_id, CAST(rq.ts AS DATE) AS day, rq.model, rq.cost,
         CASE WHEN ttl.hit THEN 'cache_hit' WHEN NOT bud.admitted THEN 'budget_exceeded'
              WHEN rq.quality < 0.5 THEN 'quality_failed' ELSE 'ok' END AS status
  FROM rq JOIN ttl USING (req_id) LEFT JOIN bud USING (req_id))"""

SQL["route_log"] = f"WITH RECURSIVE {ROUTE_CTES} SELECT req_id, day, model, status FROM routed"
SQL["outcome_counts"] = f"WITH RECURSIVE {ROUTE_CTES} SELECT status, count(*) AS n FROM routed GROUP BY status"
SQL["spending_report"] = f"""WITH RECURSIVE {ROUTE_CTES}
SELECT day, model, sum(cost)::DECIMAL(18,6) AS spend, count(*) AS calls, GROUPING(day, model)::BIGINT AS level
FROM routed WHERE status = 'ok' GROUP BY ROLLUP (day, model)"""

PERF_CTES = f"""{REGISTRY},
pr AS (SELECT reg.model, e.event_id AS req_id, e.event_type <> 'error' AS success, e.value / 1000.0 AS latency,
              row_number() OVER (PARTITION BY reg.model ORDER BY epoch_us(e.ts), e.event_id) AS n
       FROM events e JOIN reg ON reg.model_idx = e.event_id % 5),
pw(model, n, sr, lat) AS (
  SELECT model, n, CASE WHEN success THEN 0.9::DOUBLE * 1.0 + 0.1 ELSE 0.9::DOUBLE * 1.0 END,
         CASE WHEN success THEN latency ELSE 0.0::DOUBLE END FROM pr WHERE n = 1
  UNION ALL
  SELECT pr.model, pr.n, CASE WHEN pr.success THEN 0.9::DOUBLE * pw.sr + 0.1 ELSE 0.9::DOUBLE * pw.sr END,
         CASE WHEN pr.success THEN (pw.lat * (pr.n - 1) + pr.latency) / pr.n ELSE pw.lat END
  FROM pw JOIN pr ON pr.model = pw.model AND pr.n = pw.n + 1),
perf AS (SELECT pr.model, pr.req_id, pr.n, pr.success, pw.sr, pw.lat FROM pw JOIN pr USING (model, n))"""

SQL["model_performance"] = f"""WITH RECURSIVE {PERF_CTES}
SELECT model, req_id, n, (floor((sr) * 1000000 + 0.5) / 1000000) AS success_rate, (floor((lat) * 1000000 + 0.5) / 1000000) AS avg_latency FROM perf"""
SQL["model_summary"] = f"""WITH RECURSIVE {PERF_CTES}
SELECT model, max(n) AS calls, count(*) FILTER (WHERE NOT success) AS failures,
       (floor((arg_max(sr, n)) * 1000000 + 0.5) / 1000000) AS success_rate, (floor((arg_max(lat, n)) * 1000000 + 0.5) / 1000000) AS avg_latency FROM perf GROUP BY model"""

_BOUNDS = ["0.005", "0.01", "0.025", "0.05", "0.1", "0.25", "0.5"]
SQL["latency_histogram"] = " UNION ALL ".join(
    [f"SELECT '{b}' AS le, count(*) FILTER (WHERE value / 1000.0 <= {b}) AS n FROM events" for b in _BOUNDS]
    + ["SELECT '+Inf' AS le, count(*) AS n FROM events"])

USER_INPUTS = "SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS input_id, text AS input FROM conversations WHERE role = 'user'"
SQL["workflow_runs"] = f"""
WITH u AS ({USER_INPUTS})
SELECT input_id, 'claude-2 response to preprocess:' || input || chr(10) || chr(10) || 'gpt-3.5 response to generate:' || input
       || chr(10) || chr(10) || 'palm-2 response to refine:' || input AS result, 3::BIGINT AS n_steps FROM u"""
SQL["tfidf_weights"] = f"""
WITH u AS ({USER_INPUTS}),
tf AS (SELECT input_id, term, count(*) AS tf FROM (SELECT input_id, unnest({_ws('input')}) AS term FROM u) GROUP BY ALL),
v AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(DISTINCT input_id) FROM u)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 1000),
w AS (SELECT input_id, term, tf * idf AS w FROM tf JOIN v USING (term))
SELECT input_id, term, {{r6}} AS weight FROM w JOIN (SELECT input_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY input_id) USING (input_id)""".replace("{r6}", "floor(w / norm * 1000000 + 0.5) / 1000000")
SQL["input_features"] = rf"""
WITH u AS ({USER_INPUTS})
SELECT input_id, length(input)::BIGINT AS length, length(regexp_replace(input, '[\p{{L}}\p{{N}}]', '', 'g'))::BIGINT AS special_chars FROM u"""

# ---------------------------------------------------------------- governance


def r6(x: str) -> str:
    return f"(floor(({x}) * 1000000 + 0.5) / 1000000)"


SQL["rule_filter"] = """
SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity FROM lineitem
WHERE l_returnflag IS NOT DISTINCT FROM 'R' AND l_linestatus IS NOT DISTINCT FROM 'F'"""

CALLS = """c AS (SELECT event_id, ts, event_type AS tool, props AS params, value,
                  (['admin', 'developer', 'guest', 'unknown'])[user_id % 4 + 1] AS role FROM events)"""
SQL["permission_audit"] = f"""
WITH {CALLS},
rm(role, perms) AS (VALUES ('admin', ['*']), ('developer', ['api:access', 'data:process']), ('guest', ['basic:read'])),
rq(tool, required) AS (VALUES ('view', ['basic:read']), ('click', ['api:access']), ('signup', ['data:process']),
                              ('purchase', ['api:access', 'data:process']), ('error', []::VARCHAR[])),
x AS (SELECT c.event_id, c.tool, c.role, coalesce(rm.perms, []::VARCHAR[]) AS perms, coalesce(rq.required, []::VARCHAR[]) AS required
      FROM c LEFT JOIN rm USING (role) LEFT JOIN rq USING (tool)),
y AS (SELECT *, CASE WHEN list_contains(perms, '*') THEN []::VARCHAR[]
                     ELSE list_sort(list_distinct(list_filter(required, lambda r: NOT list_contains(perms, r)))) END AS miss FROM x)
SELECT event_id, tool, role, len(miss) = 0 AS allowed, array_to_string(miss, ',') AS missing FROM y"""

SQL["validate_params"] = """
WITH p AS (SELECT event_id, json_extract_string(props, '$.k') AS k_raw, json_extract_string(props, '$.limit') AS l_raw FROM events)
SELECT event_id,
       TRY_CAST(k_raw AS INTEGER) AS k,
       CASE WHEN l_raw IS NULL THEN 10 ELSE TRY_CAST(l_raw AS INTEGER) END AS "limit",
       (k_raw IS NOT NULL AND TRY_CAST(k_raw AS INTEGER) IS NOT NULL AND (l_raw IS NULL OR TRY_CAST(l_raw AS INTEGER) IS NOT NULL)) AS is_valid,
       concat_ws(';', CASE WHEN k_raw IS NULL THEN 'k: field required' WHEN TRY_CAST(k_raw AS INTEGER) IS NULL THEN 'k: not a valid int' END,
                      CASE WHEN l_raw IS NOT NULL AND TRY_CAST(l_raw AS INTEGER) IS NULL THEN 'limit: not a valid int' END) AS errors
FROM p"""

SQL["call_keys"] = """
WITH kv0 AS (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events),
kv AS (SELECT event_id, k, json_extract_string(props, '$."' || k || '"') AS v FROM kv0),
canon AS (SELECT event_id, '{' || string_agg('"' || k || '":"' || v || '"', ',' ORDER BY k) || '}' AS j FROM kv GROUP BY event_id),
keys AS (SELECT e.event_id, e.event_type || ':' || md5(canon.j) AS call_key FROM events e JOIN canon USING (event_id))
SELECT call_key, count(*) AS n, min(event_id) AS first_event FROM keys GROUP BY call_key"""

SQL["tool_outcomes"] = """
SELECT event_type AS tool, count(*) AS invocations, count(*) FILTER (WHERE value < 100) AS successes,
       count(*) FILTER (WHERE value >= 100) AS failures FROM events GROUP BY event_type"""

# ---------------------------------------------------------------- monitoring

SQL["search_metrics"] = f"""
SELECT CAST(ts AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE event_id % 4 = 0) AS cache_hits,
       {r6("count(*) FILTER (WHERE event_id % 4 = 0) / count(*)")} AS hit_rate, {r6("avg(value)")} AS avg_response_ms
FROM events GROUP BY ROLLUP (CAST(ts AS DATE))"""

SQL["running_metrics"] = f"""
SELECT CAST(ts AS DATE) AS day, event_id,
       row_number() OVER w AS n, {r6("(sum(round(value * 100)::BIGINT) OVER w)::DOUBLE / row_number() OVER w / 100.0::DOUBLE")} AS running_avg
FROM events WINDOW w AS (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

SQL["request_rate"] = f"""
WITH {REGISTRY},
r AS (SELECT date_trunc('minute', e.ts) AS m, reg.model FROM events e JOIN reg ON reg.model_idx = e.event_id % 5),
w AS (SELECT m - to_minutes(k) AS window_start, model FROM r, range(0, 5) t(k))
SELECT window_start, model, count(*) AS n, {r6("count(*) / 300.0::DOUBLE")} AS rate FROM w GROUP BY window_start, model"""

SQL["anomalies"] = f"""
WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL),
z AS (SELECT *, (n - avg(n) OVER w) / nullif(stddev_samp(n) OVER w, 0) AS z FROM h
      WINDOW w AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT event_type, hour, n, {r6("z")} AS z, coalesce(abs(z) > 3, false) AS anomaly FROM z"""

# ---------------------------------------------------------------- clustering

SQL["vector_clusters"] = """
WITH RECURSIVE
pts AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
nb AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON a.id <> b.id AND list_distance(a.v, b.v) <= 1.1),
deg AS (SELECT pts.id, 1 + count(nb.b) AS n FROM pts LEFT JOIN nb ON nb.a = pts.id GROUP BY pts.id),
core AS (SELECT id FROM deg WHERE n >= 2),
ce AS (SELECT a, b FROM nb WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach(id, root) AS (SELECT id, id FROM core UNION SELECT ce.b, reach.root FROM reach JOIN ce ON ce.a = reach.id),
comp AS (SELECT id, min(root) AS c FROM reach GROUP BY id),
cid AS (SELECT c, dense_rank() OVER (ORDER BY c) - 1 AS cluster_id FROM (SELECT DISTINCT c FROM comp)),
border AS (SELECT nb.a AS id, min(cid.cluster_id) AS cluster_id FROM nb JOIN comp ON comp.id = nb.b JOIN cid USING (c)
           WHERE nb.a NOT IN (SELECT id FROM core) GROUP BY nb.a),
lab AS (SELECT comp.id, cid.cluster_id FROM comp JOIN cid USING (c) UNION ALL SELECT id, cluster_id FROM border)
SELECT pts.id AS vec_id, coalesce(lab.cluster_id, -1)::BIGINT AS cluster_id FROM pts LEFT JOIN lab USING (id)"""



def _collapsed(ctes: str, extra: str = "") -> str:
    """Clusters of the hits in ``cand(query_id, rank, doc_id, score)``, one hit per cluster, the first 10 of them."""
    return f"""
WITH RECURSIVE {ctes},
hv AS (SELECT h.query_id, h.doc_id, h.rank, e.embedding::DOUBLE[] AS v FROM cand h JOIN embeddings e ON e.vec_id = h.doc_id),
nb AS (SELECT a.query_id, a.rank AS a, b.rank AS b FROM hv a JOIN hv b ON a.query_id = b.query_id AND a.rank <> b.rank
       AND list_distance(a.v, b.v) <= 1.1),
reach(query_id, id, root) AS (SELECT DISTINCT query_id, a, a FROM nb
                              UNION SELECT nb.query_id, nb.b, reach.root FROM reach JOIN nb ON nb.query_id = reach.query_id AND nb.a = reach.id),
comp AS (SELECT query_id, id, min(root) AS c FROM reach GROUP BY query_id, id),
cid AS (SELECT query_id, c, dense_rank() OVER (PARTITION BY query_id ORDER BY c) - 1 AS cluster_id FROM (SELECT DISTINCT query_id, c FROM comp)),
lab AS (SELECT comp.query_id, comp.id AS rank, cid.cluster_id FROM comp JOIN cid USING (query_id, c)),
x AS (SELECT cand.*, coalesce(lab.cluster_id, -1)::BIGINT AS cluster_id FROM cand LEFT JOIN lab USING (query_id, rank)),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id, cluster_id ORDER BY rank) AS rn FROM x),
z AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM y WHERE cluster_id < 0 OR rn = 1)
SELECT query_id, rank, doc_id, score, {extra}cluster_id FROM z WHERE rank <= 10"""


SQL["collapsed_hits"] = _collapsed(f"{HYBRID_CTES}, cand AS (SELECT query_id, rank, doc_id, score FROM hyb_all WHERE rank <= 30)")

SQL["search_flow"] = _collapsed(f"""{HYBRID_CTES},
fb AS (SELECT doc_id, avg(greatest(1, 1 + 4 * quality - toxic)) / 5.0 AS fb FROM labels GROUP BY doc_id),
ft AS (SELECT h.query_id, h.doc_id, h.score, coalesce(fb.fb, 0.9) AS fb,
              coalesce(len(list_intersect(list_distinct({_ws('b.text')}), {_ws('d.text')})) / nullif(len(list_distinct({_ws('b.text')})), 0), 0.0) AS overlap
       FROM hyb_all h JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = h.query_id LEFT JOIN fb USING (doc_id) WHERE h.rank <= 30),
pr AS (SELECT query_id, doc_id, score, (floor((0.5::DOUBLE * score + 0.2::DOUBLE * overlap + 0.1::DOUBLE * 0.8::DOUBLE + 0.2::DOUBLE * fb) * 1000000 + 0.5) / 1000000) AS predicted FROM ft),
cand AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY predicted DESC, doc_id) AS rank FROM pr)""", "predicted, ")

SQL["eval_results"] = f"""
WITH {EVAL_CTES}
SELECT model, to_json(map_from_entries(list(struct_pack(k := dim, v := {r6('score')}) ORDER BY dim)))::VARCHAR AS scores,
       '{{"test_set":"conversations"}}' AS metadata
FROM acc GROUP BY model"""


SQL["processed_documents"] = f"""
WITH n AS ({SQL["skip_processed"]}),
c AS (SELECT doc_id, count(*) AS n_chunks FROM ({SQL["doc_chunks"]}) GROUP BY doc_id),
q AS ({SQL["quality_features"]})
SELECT n.file_hash, n.doc_id, n.n_copies, {_title('d.text')} AS title, coalesce(c.n_chunks, 0)::BIGINT AS n_chunks,
       q.n_chars, q.n_words, q.stop_ratio, q.repetition
FROM n JOIN documents d USING (doc_id) JOIN q USING (doc_id) LEFT JOIN c USING (doc_id)"""


SQL["similar_inputs"] = f"""
WITH d AS (SELECT DISTINCT props AS input FROM events),
s AS (SELECT input, CASE WHEN length(input) <= 3 THEN [input]
                         ELSE list_distinct(list_transform(range(1, length(input) - 1), lambda i: substring(input, i, 3))) END AS toks FROM d),
p AS (SELECT a.input AS input_a, b.input AS input_b,
             len(list_intersect(a.toks, b.toks)) / (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks))) AS j
      FROM s a JOIN s b ON a.input < b.input)
SELECT input_a, input_b, {r6('j')} AS jaccard FROM p WHERE j >= 0.6"""
