"""Independent SQL for the registered queries, run on the same tables by another engine."""

from __future__ import annotations

from tidemark.functions import text as rules_of
from tidemark.functions.text import STOP_WORDS
from tidemark.operators.linkage import MODEL_WEIGHTS, REPORT_TERMS
from tidemark.plans.inputs import GAP, RATE, SITE

SQL: dict[str, str] = {}


def _half_even(x: str) -> str:
    n = f"CAST(round(({x}) * 10000000000) AS HUGEINT)"
    return (
        f"(CASE WHEN {n} % 100000000 > 50000000 OR ({n} % 100000000 = 50000000 AND ({n} // 100000000) % 2 = 1) "
        f"THEN {n} // 100000000 + 1 ELSE {n} // 100000000 END) / 100.0"
    )


# --- the log the lines are derived from ------------------------------------------------------------

LOG = f"""
ev AS (
  SELECT event_id AS line_id, date_trunc('second', ts) AS ts, ts AS raw_ts, event_type, event_id % 20 AS ds,
         '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS ip,
         ['ocean%20winds','sea%20surface%20temperature','salinity','gravity','sea%20ice','ocean_wave'][event_id % 6 + 1] AS kw,
         ['ocean winds','sea surface temperature','salinity','gravity','sea ice','ocean wave'][event_id % 6 + 1] AS word,
         ['ocean wind','sea surfac temperatur','salin','graviti','sea ic','ocean wave'][event_id % 6 + 1] AS norm
  FROM events),
paths AS (
  SELECT *, CASE
      WHEN event_type = 'signup' THEN '/datasetlist?ids=Measurement:Sensor&values=Ocean%20Winds:QuikSCAT&search=' || kw
      WHEN event_type = 'click' THEN '/datasetlist?search=' || kw || '&view=list'
      WHEN event_type = 'view' THEN '/dataset/DS_' || ds || '?search=' || kw
      WHEN event_type = 'error' AND line_id % 4 = 1 THEN '/css/site.css'
      ELSE '/dataset/DS_' || ds END AS path
  FROM ev),
pages_seen AS (
  SELECT *, lag(path) OVER (PARTITION BY ip ORDER BY raw_ts, line_id) AS prev FROM paths WHERE event_type <> 'purchase'),
http AS (
  SELECT line_id, strftime(ts, '%Y-%m') AS month, 'http' AS log_type, ip, ts, CAST(epoch(ts) AS BIGINT) AS epoch,
         'GET ' || path || ' HTTP/1.1' AS request, lower(path) AS path, '200' AS response,
         CASE WHEN line_id % 10 = 0 THEN 0 ELSE line_id END AS bytes,
         CASE WHEN line_id % 5 = 0 OR prev IS NULL THEN '-' ELSE '{SITE}' || lower(prev) END AS referer,
         CASE WHEN event_type = 'error' AND line_id % 4 = 0 THEN 'curl/7.1' ELSE 'Mozilla/5.0' END AS agent,
         event_type, ds, word, norm, kw
  FROM pages_seen WHERE NOT (event_type = 'error' AND line_id % 4 = 2)),
ftp AS (
  SELECT line_id, strftime(ts, '%Y-%m') AS month, 'ftp' AS log_type, ip, ts, CAST(epoch(ts) AS BIGINT) AS epoch,
         '/data/ds_' || ds || '/f_' || line_id || CASE WHEN line_id % 3 = 0 THEN '.txt' ELSE '.nc' END AS request,
         1000 + line_id AS bytes, event_type, ds, word, norm, kw
  FROM ev WHERE event_type = 'purchase'),
web AS (SELECT * FROM http WHERE NOT (event_type = 'error' AND line_id % 4 IN (0, 1))),
visits AS (
  SELECT line_id, month, log_type, ip, ts, epoch, request, path, referer, bytes, event_type, ds, word, norm, kw FROM web
  UNION ALL
  SELECT line_id, month, log_type, ip, ts, epoch, request, NULL, NULL, bytes, event_type, ds, word, norm, kw FROM ftp),
peaks AS (
  SELECT month, ip, max(n) AS peak, CAST(sum(n) AS BIGINT) AS requests, bool_or(h) AS has_http
  FROM (SELECT month, ip, date_trunc('minute', ts) AS m, count(*) AS n, bool_or(log_type = 'http') AS h FROM visits GROUP BY ALL)
  GROUP BY ALL),
clean AS (
  SELECT v.*, CASE WHEN log_type = 'http' THEN '{SITE}' || path ELSE request END AS request_url
  FROM visits v JOIN peaks p USING (month, ip) WHERE p.peak < {RATE} AND p.has_http)"""

SQL["http_log_scan"] = f"""WITH {LOG}
SELECT line_id, month, log_type, ip, epoch, request, response, bytes, referer, agent FROM http"""
SQL["ftp_log_scan"] = f"WITH {LOG} SELECT line_id, month, log_type, ip, epoch, request, bytes FROM ftp"
SQL["visitor_requests"] = f"WITH {LOG} SELECT line_id, ip, epoch, request, referer, agent FROM web"
SQL["line_rejects"] = f"""WITH {LOG}
SELECT (SELECT count(*) FROM pages_seen) AS lines, (SELECT count(*) FROM pages_seen) - count(*) AS rejected,
       count(*) AS parsed, count(*) FILTER (WHERE agent = 'curl/7.1') AS crawler_agents, count(*) FILTER (WHERE path = '/css/site.css') AS assets
FROM http"""
SQL["lines_per_month"] = f"""WITH {LOG}
SELECT CASE WHEN event_type = 'error' AND line_id % 4 = 2 THEN NULL ELSE CAST(year(ts) AS INTEGER) END AS year,
       CASE WHEN event_type = 'error' AND line_id % 4 = 2 THEN NULL ELSE CAST(month(ts) AS INTEGER) END AS month,
       count(*) AS n FROM ev GROUP BY ALL"""
SQL["january_requests"] = f"""WITH {LOG}
SELECT month, log_type, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM visits WHERE month = '2024-01' GROUP BY ALL"""
SQL["request_urls"] = f"""WITH {LOG}
SELECT line_id, CASE WHEN log_type = 'http' THEN '{SITE}' || path ELSE request END AS request_url,
       coalesce(replace(referer, '{SITE}', ''), '') AS referer FROM visits"""
SQL["request_classes"] = f"""WITH {LOG}
SELECT line_id, CASE WHEN event_type IN ('signup', 'click') THEN 'datasetlist' WHEN event_type IN ('view', 'error') THEN 'dataset' ELSE 'ftp' END AS class,
       CASE WHEN event_type IN ('view', 'error') THEN 'ds_' || ds END AS dataset_id,
       CASE WHEN event_type IN ('view', 'error') THEN 'ds_' || ds END AS viewed,
       CASE WHEN event_type = 'purchase' AND line_id % 3 <> 0 THEN request END AS download
FROM visits"""
SQL["page_urls"] = """
WITH u AS (SELECT page_id, lower(trim(url)) AS url FROM pages),
q AS (SELECT page_id, url, split_part(url, '?', 2) AS part FROM u),
kv AS (SELECT page_id, unnest(string_split(part, '&')) AS piece, generate_subscripts(string_split(part, '&'), 1) AS pos FROM q WHERE part <> ''),
last_kv AS (SELECT page_id, split_part(piece, '=', 1) AS k, arg_max(split_part(piece, '=', 2), pos) AS v FROM kv GROUP BY ALL)
SELECT q.page_id, CASE WHEN part <> '' THEN split_part(url, '?', 1) END AS page,
       coalesce((SELECT string_agg(k || '=' || v, '&' ORDER BY k) FROM last_kv l WHERE l.page_id = q.page_id AND k <> ''), '') AS params,
       (SELECT v FROM last_kv l WHERE l.page_id = q.page_id AND k = 'page') AS page_param
FROM q"""
_INFO = """CASE WHEN event_type = 'signup' AND word = 'ocean winds' THEN norm || ',quikscat'
                WHEN event_type = 'signup' THEN norm || ',ocean wind,quikscat'
                WHEN event_type IN ('click', 'view') THEN norm ELSE '' END"""
SQL["search_keywords"] = f"""WITH {LOG}
SELECT line_id, CASE WHEN event_type IN ('signup', 'click', 'view') THEN word ELSE '' END AS word, {_INFO} AS info
FROM web"""
SQL["search_filters"] = f"""WITH {LOG}
SELECT line_id,
  CASE WHEN event_type = 'signup' AND word = 'ocean winds' THEN 'sensor:quikscat'
       WHEN event_type = 'signup' THEN 'measurement:ocean winds|sensor:quikscat' ELSE '' END AS filters,
  CASE WHEN event_type = 'signup' THEN 'measurement=ocean winds,search=' || replace(kw, '%20', ' ') || ',sensor=quikscat'
       WHEN event_type IN ('click', 'view') THEN 'search=' || replace(kw, '%20', ' ') ELSE '' END AS legacy
FROM web"""
SQL["visitor_peaks"] = f"WITH {LOG} SELECT month, ip, peak, requests, has_http FROM peaks"
SQL["crawler_visitors"] = f"WITH {LOG} SELECT month, ip FROM peaks WHERE peak >= {RATE} OR NOT has_http"
SQL["clean_requests"] = f"""WITH {LOG}
SELECT line_id, month, ip, log_type, epoch, request_url,
       CAST(coalesce(epoch - lag(epoch) OVER (PARTITION BY month, ip ORDER BY ts, line_id), 0) AS INTEGER) AS to_last
FROM clean"""


def _sessions(gap: int) -> str:
    return f"""
marked AS (
  SELECT *, CASE WHEN lag(epoch) OVER w IS NULL OR epoch - lag(epoch) OVER w > {gap} THEN 1 ELSE 0 END AS opens
  FROM clean WINDOW w AS (PARTITION BY month, ip ORDER BY ts, line_id)),
gs AS (
  SELECT * EXCLUDE (opens), ip || '@' || CAST(sum(opens) OVER (PARTITION BY month, ip ORDER BY ts, line_id) AS BIGINT) AS session_id
  FROM marked)"""


SESSIONS = f"{LOG}, {_sessions(GAP)}"


def _combined(gap: int) -> str:
    return f"""
spans AS (SELECT month, ip, session_id AS sid, max(epoch) AS e FROM gs GROUP BY ALL),
starts AS (
  SELECT *, CASE WHEN lag(e) OVER w IS NULL OR e - lag(e) OVER w >= {GAP} THEN 1 ELSE 0 END AS s
  FROM spans WINDOW w AS (PARTITION BY month, ip ORDER BY e, sid)),
chains AS (SELECT *, sum(s) OVER (PARTITION BY month, ip ORDER BY e, sid) AS chain FROM starts),
merged AS (SELECT month, ip, sid, first_value(sid) OVER (PARTITION BY month, ip, chain ORDER BY e, sid) AS new_id FROM chains),
quality AS (SELECT month, ip, count(*) AS n, count(*) FILTER (WHERE referer = '-') AS missing FROM gs GROUP BY ALL),
cs AS (
  SELECT g.* EXCLUDE (session_id), CASE WHEN q.n < 3 OR q.missing / q.n >= 0.8 THEN 'invalid' ELSE m.new_id END AS session_id
  FROM gs g JOIN merged m ON g.month = m.month AND g.ip = m.ip AND g.session_id = m.sid JOIN quality q ON g.month = q.month AND g.ip = q.ip)"""


SQL["gap_sessions"] = f"WITH {SESSIONS} SELECT line_id, month, ip, session_id FROM gs"
SQL["combined_sessions"] = f"""WITH {LOG}, {_sessions(1800)}, {_combined(1800)}
SELECT line_id, month, ip, session_id FROM cs"""
SQL["visitor_referers"] = f"""WITH {LOG}
SELECT month, ip, count(*) AS requests, count(*) FILTER (WHERE referer = '-') AS no_referer, round(count(*) FILTER (WHERE referer = '-') / count(*), 6) AS ratio
FROM clean GROUP BY ALL"""


def _statistics(source: str) -> str:
    return f"""
rows_in AS (SELECT * FROM {source} WHERE session_id <> 'invalid'),
base AS (
  SELECT month, ip, session_id, min(epoch) AS start_epoch, max(epoch) AS end_epoch, count(*) AS request_count,
         count(*) FILTER (WHERE event_type IN ('signup', 'click')) AS list_count, count(*) FILTER (WHERE event_type IN ('view', 'error')) AS view_count,
         count(*) FILTER (WHERE event_type = 'purchase') AS download_count
  FROM rows_in GROUP BY ALL),
good AS (SELECT * FROM base WHERE request_count >= 3 AND list_count BETWEEN 1 AND 100 AND view_count BETWEEN 1 AND 200 AND download_count <= 100),
words AS (
  SELECT month, ip, session_id, ts, line_id, unnest(string_split({_INFO}, ',')) AS word_item,
         generate_subscripts(string_split({_INFO}, ','), 1) AS pos
  FROM rows_in WHERE event_type IN ('signup', 'click')),
first_words AS (SELECT month, ip, session_id, word_item AS v, min((ts, line_id, pos)) AS at FROM words GROUP BY ALL),
first_views AS (SELECT month, ip, session_id, 'ds_' || ds AS v, min((ts, line_id)) AS at FROM rows_in WHERE event_type IN ('view', 'error') GROUP BY ALL),
first_loads AS (SELECT month, ip, session_id, request AS v, min((ts, line_id)) AS at FROM rows_in WHERE event_type = 'purchase' AND line_id % 3 <> 0 GROUP BY ALL)"""


def _lists(name: str, alias: str) -> str:
    return (
        f"coalesce((SELECT string_agg(f.v, ',' ORDER BY f.at) FROM {name} f "
        f"WHERE f.month = g.month AND f.ip = g.ip AND f.session_id = g.session_id), '') AS {alias}"
    )


SQL["session_statistics"] = f"""WITH {SESSIONS}, {_combined(GAP)}, {_statistics('cs')}
SELECT month, ip, session_id, '443/logmining/?sessionid=' || session_id || '&sessionType=sessionstats&requestType=cleanup' AS session_url,
       start_epoch, end_epoch, end_epoch - start_epoch AS duration, request_count, list_count, list_count AS keyword_list_count,
       view_count, download_count, round(request_count / nullif(end_epoch - start_epoch, 0), 8) AS request_rate,
       {_lists('first_words', 'keywords')},
       CAST((SELECT count(*) FROM first_words f WHERE f.month = g.month AND f.ip = g.ip AND f.session_id = g.session_id) AS INTEGER) AS keyword_count,
       {_lists('first_views', 'views')}, {_lists('first_loads', 'downloads')}
FROM good g"""
SQL["session_requests"] = f"""WITH {SESSIONS}, {_statistics('gs')},
numbered AS (
  SELECT r.line_id, r.session_id, CAST(row_number() OVER (PARTITION BY r.month, r.ip, r.session_id ORDER BY r.ts, r.line_id) AS INTEGER) AS seq
  FROM rows_in r JOIN good g ON r.month = g.month AND r.ip = g.ip AND r.session_id = g.session_id)
SELECT line_id, session_id, seq FROM numbered WHERE seq <= 100"""

# --- trees by order, and what they say -------------------------------------------------------------

NODES = f"""{SESSIONS},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY month, ip, session_id ORDER BY ts, line_id) AS seq,
         CASE WHEN event_type IN ('signup', 'click') THEN 'datasetlist' WHEN event_type = 'purchase' THEN 'ftp' ELSE 'dataset' END AS key
  FROM gs),
nodes AS (
  SELECT *, coalesce(path, request) AS node_request,
         count(*) FILTER (WHERE key = 'datasetlist') OVER w AS searches, count(*) FILTER (WHERE key = 'dataset') OVER w AS n_views
  FROM numbered
  WINDOW w AS (PARTITION BY month, ip, session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
placed AS (SELECT * FROM nodes WHERE key = 'datasetlist' OR (key = 'dataset' AND searches > 0) OR (key = 'ftp' AND n_views > 0)),
below AS (SELECT month, ip, session_id, seq, lead(key) OVER (PARTITION BY month, ip, session_id ORDER BY seq) AS next_key FROM placed WHERE key <> 'datasetlist'),
views AS (
  SELECT p.*, coalesce(b.next_key = 'ftp', false) AS downloaded
  FROM placed p JOIN below b USING (month, ip, session_id, seq) WHERE p.key = 'dataset'),
clicks AS (SELECT month, ip, session_id, norm AS keyword, 'ds_' || ds AS dataset, downloaded FROM views WHERE event_type = 'view')"""

SQL["click_through"] = f"WITH {NODES} SELECT month, session_id, keyword, dataset, downloaded FROM clicks"
SQL["click_json"] = f"WITH {NODES} SELECT session_id, keyword, dataset, downloaded FROM clicks"
SQL["dataset_keywords"] = f"WITH {NODES} SELECT dataset, keyword, count(*) AS n FROM clicks GROUP BY ALL"
SQL["clicks_with_metadata"] = f"""WITH {NODES},
known AS (SELECT 'ds_' || (p_partkey % 15) AS dataset, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS keyword_list FROM part GROUP BY ALL)
SELECT c.session_id, c.dataset, c.keyword, k.keyword_list FROM clicks c LEFT JOIN known k USING (dataset)"""
SQL["keyword_pairs"] = f"""WITH {NODES},
above AS (
  SELECT v.month, v.ip, v.session_id, v.seq AS view_seq, v.node_request AS view_url, replace(s.info, ',', '|') AS info,
         row_number() OVER (PARTITION BY v.month, v.ip, v.session_id, v.seq ORDER BY s.seq DESC) - 1 AS k
  FROM views v JOIN (SELECT *, {_INFO} AS info FROM nodes WHERE key = 'datasetlist') s
    ON s.month = v.month AND s.ip = v.ip AND s.session_id = v.session_id AND s.seq < v.seq
  WHERE v.downloaded)
SELECT a.month, a.session_id, a.view_url, b.info AS keyword_a, a.info AS keyword_b, round(1.0 / (a.k + 1), 8) AS weight
FROM above a JOIN above b ON a.month = b.month AND a.ip = b.ip AND a.session_id = b.session_id AND a.view_seq = b.view_seq AND a.k < b.k
WHERE a.info <> b.info"""
SQL["query_filter_pairs"] = f"""WITH {NODES},
last_search AS (
  SELECT v.month, v.ip, v.session_id, v.node_request AS view_url, v.seq AS view_seq, arg_max(s.node_request, s.seq) AS search_url,
         arg_max(s.word, s.seq) AS w, arg_max(s.event_type, s.seq) AS kind
  FROM views v JOIN nodes s ON s.key = 'datasetlist' AND s.month = v.month AND s.ip = v.ip AND s.session_id = v.session_id AND s.seq < v.seq
  GROUP BY ALL),
filtered AS (SELECT *, CASE WHEN w = 'ocean winds' THEN ['sensor:quikscat'] ELSE ['measurement:ocean winds', 'sensor:quikscat'] END AS fs FROM last_search WHERE kind = 'signup'),
out_rows AS (
  SELECT month, session_id, search_url, view_url, w AS query_a, unnest(fs) AS filter_b, 0 AS type FROM filtered
  UNION ALL SELECT month, session_id, search_url, view_url, w, array_to_string(fs, ',') || ',', 1 FROM filtered
  UNION ALL SELECT month, session_id, search_url, view_url, 'ocean winds', 'sensor:quikscat', 0 FROM filtered WHERE len(fs) = 2
  UNION ALL SELECT month, session_id, search_url, view_url, 'ocean winds', 'sensor:quikscat,', 1 FROM filtered WHERE len(fs) = 2
  UNION ALL SELECT month, session_id, search_url, view_url, 'quikscat', 'measurement:ocean winds', 0 FROM filtered WHERE len(fs) = 2
  UNION ALL SELECT month, session_id, search_url, view_url, 'quikscat', 'measurement:ocean winds,', 1 FROM filtered WHERE len(fs) = 2
  UNION ALL SELECT month, session_id, search_url, view_url, 'quikscat', '', 1 FROM filtered WHERE len(fs) = 1)
SELECT month, session_id, search_url, view_url, query_a, filter_b, CAST(type AS INTEGER) AS type, 1.0::DOUBLE AS weight FROM out_rows"""
SQL["session_comments"] = """
WITH r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS session_id, string_agg(role || ':' || text, chr(10) ORDER BY k) AS comments
FROM r WHERE k <= 3 GROUP BY conv_id"""
SQL["visitor_locations"] = f"""WITH {LOG},
ips AS (SELECT DISTINCT ip, CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) AS num FROM visits)
SELECT ip, n_name AS location FROM ips LEFT JOIN nation ON num BETWEEN n_nationkey * 60 AND n_nationkey * 60 + 49"""

# --- purchases -------------------------------------------------------------------------------------

BUYS = """
buys AS (
  SELECT l_orderkey, l_returnflag, l_linestatus, o_custkey, p_brand, p_type, replace(p_name, 'large', 'larg') AS keyword
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
sk AS (SELECT DISTINCT o_custkey AS ip, l_orderkey AS session_id, keyword FROM buys)"""
USER_TERMS = f"""{BUYS},
kv AS (SELECT keyword, ip, count(*) AS n FROM sk GROUP BY ALL),
users AS (SELECT ip FROM sk GROUP BY ip HAVING count(DISTINCT session_id) > 5),
terms AS (SELECT keyword FROM kv GROUP BY keyword HAVING count(*) > 5),
kept AS (SELECT * FROM kv WHERE ip IN (SELECT ip FROM users) AND keyword IN (SELECT keyword FROM terms))"""
TFIDF_TERMS = """
per_user AS (SELECT ip, count(*) AS df FROM kv GROUP BY ip),
weights AS (
  SELECT keyword AS term, ip AS feature, sqrt(n) * (1 + log10((SELECT count(DISTINCT keyword) FROM kv) / (df + 1))) AS weight
  FROM kept JOIN per_user USING (ip))"""


def _cosine(source: str, name: str) -> str:
    return f"""
{name}_len AS (SELECT term, sqrt(sum(weight * weight)) AS len FROM {source} GROUP BY term HAVING sum(weight * weight) > 0),
{name}_dot AS (SELECT a.term AS term_a, b.term AS term_b, sum(a.weight * b.weight) AS dot FROM {source} a JOIN {source} b ON a.feature = b.feature AND a.term < b.term GROUP BY ALL),
{name} AS (SELECT term_a, term_b, dot / (x.len * y.len) AS cosine FROM {name}_dot JOIN {name}_len x ON term_a = x.term JOIN {name}_len y ON term_b = y.term)"""


SQL["user_terms_binary"] = f"WITH {USER_TERMS} SELECT keyword AS term, ip AS feature, 1.0::DOUBLE AS weight FROM kept"
SQL["user_terms_tfidf"] = f"WITH {USER_TERMS}, {TFIDF_TERMS} SELECT term, feature, round(weight, 6) AS weight FROM weights"
SQL["user_history_cosine"] = f"""WITH {USER_TERMS}, {TFIDF_TERMS}, {_cosine('weights', 'cs')}
SELECT term_a, term_b, round(cosine, 6) AS weight FROM cs WHERE cosine <> 0"""
SQL["keyword_combinations"] = f"""WITH {BUYS}
SELECT a.keyword || ',' || b.keyword || ',' || c.keyword AS itemset, count(*) AS sessions
FROM sk a JOIN sk b ON a.session_id = b.session_id AND a.keyword < b.keyword JOIN sk c ON b.session_id = c.session_id AND b.keyword < c.keyword GROUP BY ALL"""
SQL["frequent_brand_sets"] = """WITH
words AS (SELECT DISTINCT l_orderkey AS o, unnest([p_brand, p_type]) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
SELECT a.w || ',' || b.w || ',' || c.w AS itemset, count(*) AS sessions
FROM words a JOIN words b ON a.o = b.o AND a.w < b.w JOIN words c ON b.o = c.o AND b.w < c.w
GROUP BY ALL HAVING count(*) >= 3"""
SQL["click_tfidf"] = f"""WITH {BUYS},
sized AS (SELECT l_orderkey AS doc, count(*) AS size FROM buys GROUP BY ALL),
df AS (SELECT keyword, count(DISTINCT l_orderkey) AS df FROM buys GROUP BY ALL)
SELECT DISTINCT b.keyword AS term, s.doc, round(ln(floor((SELECT count(*) FROM sized) / df.df)) / s.size, 6) AS weight
FROM buys b JOIN sized s ON b.l_orderkey = s.doc JOIN df ON b.keyword = df.keyword"""


def _tfidf(source: str, name: str) -> str:
    return f"""
{name}_df AS (SELECT doc, count(*) AS df FROM {source} GROUP BY doc),
{name} AS (SELECT term, doc AS feature, tf, tf * ln(((SELECT count(DISTINCT term) FROM {source}) + 1) / (df + 1)) AS weight FROM {source} JOIN {name}_df USING (doc))"""


BRANDS = f"""
brand_tf AS (SELECT replace(p_name, 'large', 'larg') AS term, p_brand || ' ' || p_type AS doc, count(*) AS tf FROM part GROUP BY ALL),
{_tfidf('brand_tf', 'brand')}"""
BRAND_COSINE = f"{BRANDS}, {_cosine('brand', 'brand_cs')}"
SQL["svd_term_cosine"] = f"""WITH {BRAND_COSINE}
SELECT term_a, term_b, {_half_even('cosine')} AS weight FROM brand_cs WHERE cosine > 1e-9"""
SQL["full_similarity"] = f"""WITH {BRAND_COSINE},
p AS (SELECT term_a, term_b, {_half_even('cosine')} AS weight FROM brand_cs WHERE cosine > 1e-9)
SELECT term_a, term_b, weight FROM p UNION ALL SELECT term_b, term_a, weight FROM p UNION ALL SELECT DISTINCT term, term, 1.0 FROM brand"""
SQL["transposed_matrix"] = f"WITH {BRANDS} SELECT feature AS term, term AS doc, tf, round(weight, 6) AS weight FROM brand"
SQL["term_brand_matrix"] = "SELECT replace(p_name, 'large', 'larg') AS term, " + ", ".join(
    f"CAST(count(*) FILTER (WHERE p_type = '{t}') AS DOUBLE) AS {t}" for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
) + " FROM part GROUP BY ALL"
def _matrix_file(cells: str, features: str) -> str:
    """CTE ``lines`` of a dense file of ``cells`` (term, feature, weight) over ``features`` (feature)."""
    return f"""
cols AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS id FROM (SELECT DISTINCT feature FROM {features})),
grid AS (SELECT t.term, c.id, coalesce(x.weight, 0.0::DOUBLE) AS weight FROM (SELECT DISTINCT term FROM {cells}) t CROSS JOIN cols c LEFT JOIN {cells} x ON x.term = t.term AND x.feature = c.feature),
lines AS (
  SELECT 0 AS section, NULL::VARCHAR AS term, 'Num,' || string_agg(feature, ',' ORDER BY id) AS line FROM cols
  UNION ALL SELECT 1, NULL, 'Num,' || string_agg('f' || id, ',' ORDER BY id) FROM cols
  UNION ALL SELECT 2, term, term || ',' || string_agg(CAST(weight AS VARCHAR), ',' ORDER BY id) FROM grid GROUP BY term)"""


SQL["user_term_file"] = f"""WITH {USER_TERMS}, cells AS (SELECT keyword AS term, CAST(ip AS VARCHAR) AS feature, 1.0::DOUBLE AS weight FROM kept),
{_matrix_file('cells', 'cells')}
SELECT CAST(section AS INTEGER) AS section, term, line FROM lines WHERE line IS NOT NULL"""
SQL["part_supplier_file"] = f"""WITH
cells AS (SELECT CAST(l_partkey AS VARCHAR) AS term, CAST(l_suppkey AS VARCHAR) AS feature, count(*)::DOUBLE AS weight FROM lineitem GROUP BY ALL),
names AS (SELECT CAST(s_suppkey AS VARCHAR) AS feature FROM supplier),
{_matrix_file('cells', 'names')}
SELECT CAST(section AS INTEGER) AS section, term, md5(line) AS line_md5, CAST(length(line) AS INTEGER) AS size FROM lines"""
SQL["embedding_cosine"] = f"""WITH
vals AS (SELECT CAST(vec_id AS VARCHAR) AS term, unnest(embedding)::DOUBLE AS weight, generate_subscripts(embedding, 1) AS feature FROM embeddings),
{_cosine('vals', 'cs')}
SELECT term_a, term_b, {_half_even('cosine')} AS weight FROM cs WHERE cosine > 1e-9"""

# --- texts -----------------------------------------------------------------------------------------

_TOKEN = rules_of.TOKEN.replace("'", "''")
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_GT0, _GT1, _EQ1 = rules_of.MEASURE_GT0, rules_of.MEASURE_GT1, rules_of.MEASURE_EQ1
_VOWEL, _SHORT = rules_of.HAS_VOWEL, rules_of.SHORT_SYLLABLE


def _match(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _suffix_step(table: dict[str, str], before: str) -> str:
    pattern = "^(.+?)(" + "|".join(sorted(table, key=len, reverse=True)) + ")$"
    swaps = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"""SELECT w, CASE WHEN length(x) > 2 AND {_match("regexp_extract(x, '" + pattern + "', 1)", _GT0)}
      THEN regexp_extract(x, '{pattern}', 1) || CASE regexp_extract(x, '{pattern}', 2) {swaps} END ELSE x END AS x FROM {before}"""


def _porter(source: str, p: str) -> str:
    """CTEs that end in ``{p}`` (w, s): the stem of every distinct w of ``source``."""
    drop = "^(.+?)(" + "|".join(sorted(rules_of.STEP4_SUFFIXES, key=len, reverse=True)) + ")$"
    cut = lambda n: f"left(x, length(x) - {n})"
    return f"""
{p}0 AS (SELECT DISTINCT w, regexp_replace(w, '^y', 'Y') AS x FROM {source}),
{p}1 AS (SELECT w, CASE WHEN length(x) <= 2 OR x LIKE '%ss' OR x NOT LIKE '%s' THEN x
    WHEN {_match('x', '^.+(ss|i)es$')} THEN {cut(2)} WHEN {_match('x', '^.+[^s]s$')} THEN {cut(1)} ELSE x END AS x FROM {p}0),
{p}2 AS (SELECT w, x, CASE WHEN length(x) <= 2 THEN 'none' WHEN x LIKE '%eed' THEN 'eed'
    WHEN x LIKE '%ed' AND {_match(cut(2), _VOWEL)} THEN 'cut' WHEN x LIKE '%ing' AND {_match(cut(3), _VOWEL)} THEN 'cut' ELSE 'none' END AS kind,
    CASE WHEN x LIKE '%eed' THEN {cut(3)} WHEN x LIKE '%ed' THEN {cut(2)} WHEN x LIKE '%ing' THEN {cut(3)} ELSE x END AS base FROM {p}1),
{p}3 AS (SELECT w, CASE WHEN kind = 'eed' AND {_match('base', _GT0)} THEN base || 'ee' WHEN kind <> 'cut' THEN x
    WHEN {_match('base', '(at|bl|iz)$')} THEN base || 'e'
    WHEN length(base) >= 2 AND right(base, 1) = base[-2:-2] AND NOT {_match('base', '[aeiouylsz]$')} THEN left(base, length(base) - 1)
    WHEN {_match('base', _SHORT)} THEN base || 'e' ELSE base END AS x FROM {p}2),
{p}4 AS (SELECT w, CASE WHEN length(x) > 2 AND x LIKE '%y' AND {_match(cut(1), _VOWEL)} THEN {cut(1)} || 'i' ELSE x END AS x FROM {p}3),
{p}5 AS ({_suffix_step(rules_of.STEP2_SUFFIXES, p + '4')}),
{p}6 AS ({_suffix_step(rules_of.STEP3_SUFFIXES, p + '5')}),
{p}7 AS (SELECT w, CASE WHEN length(x) <= 2 THEN x
    WHEN {_match('x', drop)} THEN CASE WHEN {_match("regexp_extract(x, '" + drop + "', 1)", _GT1)} THEN regexp_extract(x, '{drop}', 1) ELSE x END
    WHEN {_match('x', '^.+[st]ion$')} AND {_match(cut(3), _GT1)} THEN {cut(3)} ELSE x END AS x FROM {p}6),
{p}8 AS (SELECT w, CASE WHEN length(x) > 2 AND x LIKE '%e' AND ({_match(cut(1), _GT1)} OR ({_match(cut(1), _EQ1)} AND NOT {_match(cut(1), _SHORT)}))
    THEN {cut(1)} ELSE x END AS x FROM {p}7),
{p} AS (SELECT w, regexp_replace(CASE WHEN length(x) > 2 AND x LIKE '%ll' AND {_match('x', _GT1)} THEN {cut(1)} ELSE x END, '^Y', 'y') AS s FROM {p}8)"""


TOKENS = f"""
toks AS MATERIALIZED (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS w FROM documents)"""
COUNTS = f"""{TOKENS}, content AS (SELECT * FROM toks WHERE w NOT IN ({_STOP})), {_porter('content', 'st')},
counts AS MATERIALIZED (SELECT s AS term, doc, count(*) AS tf FROM content JOIN st USING (w) GROUP BY ALL)"""
SQL["token_stems"] = f"WITH {TOKENS}, {_porter('toks', 'st')} SELECT w AS token, s AS stem FROM st"
SQL["document_terms"] = f"WITH {COUNTS} SELECT term, doc, tf FROM counts"
SQL["document_tfidf"] = f"WITH {COUNTS}, {_tfidf('counts', 'tw')} SELECT term, feature AS doc, tf, round(weight, 6) AS weight FROM tw"
PASSAGE_WORDS = f"""{COUNTS},
btoks AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS w FROM benchmark),
bwords AS (SELECT DISTINCT ON (item_id) w FROM btoks WHERE w NOT IN ({_STOP}) ORDER BY item_id, length(w) DESC, w), {_porter('bwords', 'bst')},
asked_words AS (SELECT DISTINCT s AS term FROM bst WHERE s IN (SELECT term FROM counts)),
{_tfidf('counts', 'fw')},
fw_len AS (SELECT term, sqrt(sum(weight * weight)) AS len FROM fw GROUP BY term HAVING sum(weight * weight) > 0),
fw_dot AS (SELECT a.term AS x, b.term AS y, sum(a.weight * b.weight) AS dot FROM fw a JOIN fw b ON a.feature = b.feature AND a.term <> b.term WHERE a.term IN (SELECT term FROM asked_words) GROUP BY ALL),
fcs AS (SELECT x, y, dot / (p.len * q.len) AS cosine FROM fw_dot JOIN fw_len p ON x = p.term JOIN fw_len q ON y = q.term)"""
SQL["document_term_cosine"] = f"""WITH {COUNTS}, {_tfidf('counts', 'fw')},
fw_len AS (SELECT term, sqrt(sum(weight * weight)) AS len FROM fw GROUP BY term HAVING sum(weight * weight) > 0),
unit AS MATERIALIZED (SELECT term, feature, weight / len AS weight FROM fw JOIN fw_len USING (term) WHERE weight <> 0),
marks AS (SELECT term, list((feature, round(weight, 9)) ORDER BY feature) AS mark FROM unit GROUP BY term),
classes AS MATERIALIZED (SELECT term, min(term) OVER (PARTITION BY mark) AS first FROM marks),
sizes AS MATERIALIZED (SELECT first, row_number() OVER (ORDER BY first) AS id, count(*) AS size FROM classes GROUP BY first),
firsts AS MATERIALIZED (SELECT s.id, dense_rank() OVER (ORDER BY u.feature) AS feature, u.weight FROM unit u JOIN sizes s ON u.term = s.first),
dots AS (SELECT a.id AS a, b.id AS b, sum(a.weight * b.weight) AS cosine FROM firsts a JOIN firsts b ON a.feature = b.feature AND a.id < b.id GROUP BY ALL),
near AS (SELECT a, b, CAST(round({_half_even('cosine')} * 100) AS BIGINT) AS h FROM dots WHERE cosine > 0),
sides AS (SELECT a AS id, sum(size) AS links, sum(size * h) AS h FROM near JOIN sizes s ON b = s.id GROUP BY a
          UNION ALL SELECT b, sum(size), sum(size * h) FROM near JOIN sizes s ON a = s.id GROUP BY b),
ends AS (SELECT id, sum(links) AS links, sum(h) AS h FROM sides GROUP BY id)
SELECT c.term, c.first, CAST(coalesce(links, 0) + size - 1 AS BIGINT) AS links, CAST(coalesce(h, 0) + 100 * (size - 1) AS BIGINT) AS hundredths
FROM classes c JOIN sizes s ON c.first = s.first LEFT JOIN ends ON ends.id = s.id"""
SQL["corpus_word_counts"] = f"""WITH {TOKENS},
words AS (SELECT w FROM toks UNION ALL SELECT '' FROM documents WHERE len(regexp_extract_all(lower(text), '{_TOKEN}')) = 0)
SELECT w AS word, count(*) AS n FROM words WHERE NOT contains(w, '_') GROUP BY ALL"""
SQL["labelled_corpus"] = f"""WITH
names AS (SELECT doc_id, 'quality ' || quality AS label FROM labels UNION ALL SELECT doc_id, 'toxic ' || toxic FROM labels),
ids AS (SELECT doc_id, dense_rank() OVER (ORDER BY label) - 1 AS id FROM names WHERE doc_id IN (SELECT doc_id FROM documents)),
per_doc AS (SELECT doc_id, string_agg(id, ' ' ORDER BY id) AS ids, count(*) AS n FROM ids GROUP BY ALL)
SELECT d.doc_id AS short_name, CAST(coalesce(n, 0) AS INTEGER) AS labels,
       md5('[' || coalesce(ids, '') || ']' || chr(9) || array_to_string(regexp_extract_all(lower(text), '{_TOKEN}'), ' ') || ' lang_' || lang || ' source_' || source) AS line_md5
FROM documents d LEFT JOIN per_doc USING (doc_id)"""
SQL["normalised_phrases"] = f"""WITH
lists AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '{_TOKEN}'), lambda t: NOT list_contains([{_STOP}], t)) AS ws FROM conversations),
toks AS (SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM lists), {_porter('toks', 'st')},
joined AS (SELECT conv_id, turn, string_agg(s, ' ' ORDER BY pos) AS phrase FROM toks JOIN st USING (w) GROUP BY ALL)
SELECT l.conv_id, l.turn, md5(coalesce(phrase, '')) AS phrase_md5 FROM lists l LEFT JOIN joined j USING (conv_id, turn)"""

# --- rules -----------------------------------------------------------------------------------------

RULES = f"""{BUYS},
pairs_in AS (
  SELECT p_brand AS a, p_type AS b, 0 AS type FROM buys UNION ALL SELECT p_type, p_brand, 0 FROM buys
  UNION ALL SELECT p_brand, 'flag:' || l_returnflag, 0 FROM buys UNION ALL SELECT p_brand, 'status:' || l_linestatus, 0 FROM buys
  UNION ALL SELECT p_type, 'flag:' || l_returnflag, 0 FROM buys
  UNION ALL SELECT p_brand, 'flag:' || l_returnflag || ',status:' || l_linestatus || ',', 1 FROM buys),
sums AS (SELECT a, b, type, CAST(count(*) AS DOUBLE) AS n FROM pairs_in GROUP BY ALL),
lefts AS (SELECT a, type, sum(n) AS support FROM sums GROUP BY ALL),
visits_of AS (SELECT a, count(*) AS total FROM pairs_in GROUP BY ALL),
ranked AS (
  SELECT s.a, s.b, s.type, s.n, l.support, s.n / l.support AS conf,
         row_number() OVER (PARTITION BY least(s.a, s.b), greatest(s.a, s.b), s.type ORDER BY v.total DESC, s.a) AS k
  FROM sums s JOIN lefts l USING (a, type) JOIN visits_of v USING (a)),
found AS (SELECT a AS query_a, b AS filter_b, support AS support_a, conf AS confidence, n AS count, CAST(type AS INTEGER) AS type FROM ranked WHERE k = 1)"""
SQL["association_rules"] = f"WITH {RULES} SELECT query_a, filter_b, support_a, round(confidence, 8) AS confidence, count, type FROM found"
SQL["exported_rules"] = f"WITH {RULES} SELECT query_a, filter_b, support_a, {_half_even('confidence')} AS confidence, count FROM found WHERE type = 0 AND count >= 1"
_TOP5 = "row_number() OVER (PARTITION BY query_a ORDER BY {c} DESC, filter_b DESC)"
SQL["recommended_filters"] = f"""WITH {RULES},
r AS (SELECT query_a AS query, CAST({_TOP5.format(c='confidence')} AS INTEGER) AS rank, filter_b AS filter, round(confidence, 8) AS confidence
      FROM found WHERE type = 0 AND query_a IN (SELECT p_brand FROM part))
SELECT * FROM r WHERE rank <= 5"""
SQL["recommended_filters_json"] = f"""WITH {RULES},
cut4 AS (SELECT query_a, filter_b, round(confidence, 4) AS confidence FROM found WHERE type = 0 AND query_a IN (SELECT p_type FROM part)),
r AS (SELECT *, {_TOP5.format(c='confidence')} AS k FROM cut4)
SELECT query_a AS query, '{{"filters":[' || string_agg('{{"filter":"' || filter_b || '","weight":"' || confidence || '"}}', ',' ORDER BY k) || ']}}' AS filters
FROM r WHERE k <= 5 GROUP BY query_a"""

# --- linkage ---------------------------------------------------------------------------------------

_W = "CASE model " + " ".join(f"WHEN '{m}' THEN {w}" for m, w in MODEL_WEIGHTS.items()) + " END"
_NORM = "replace(lower({}), 'large', 'larg')"
ONTOLOGY = f"""
onto AS (
  SELECT {_NORM.format('o.p_name')} AS concept_a, {_NORM.format('s.p_name')} AS concept_b,
         CASE WHEN s.p_size % 2 = 0 THEN 0.75 ELSE 0.9 END::DOUBLE AS weight
  FROM part s JOIN part o ON o.p_partkey = s.p_partkey + 1)"""
PAIRS = f"""{USER_TERMS},
binary_terms AS (SELECT keyword AS term, ip AS feature, 1.0::DOUBLE AS weight FROM kept), {_cosine('binary_terms', 'hist')},
supp_tf AS (SELECT keyword AS term, l_orderkey AS doc, count(*) AS tf FROM buys GROUP BY ALL), {_tfidf('supp_tf', 'supp')}, {_cosine('supp', 'click_cs')},
{BRAND_COSINE},
term_pairs AS (
  SELECT term_a, term_b, {_half_even('cosine')} AS weight, 'userHistory' AS model FROM hist WHERE cosine > 1e-9
  UNION ALL SELECT term_a, term_b, {_half_even('cosine')}, 'userClicking' FROM click_cs WHERE cosine > 1e-9
  UNION ALL SELECT term_a, term_b, {_half_even('cosine')}, 'GCMDMetadata' FROM brand_cs WHERE cosine > 1e-9)"""


def _related(inputs: str) -> str:
    """CTEs from ``inputs`` (input, known) to related, fused and ranked terms."""
    return f"""
sides AS (
  SELECT term_a AS known, term_b AS term, weight, model FROM term_pairs UNION ALL SELECT term_b, term_a, weight, model FROM term_pairs
  UNION ALL SELECT concept_a, concept_b, weight, 'SWEET' FROM onto),
hits AS (SELECT i.input, i.known, s.term, s.weight, s.model, row_number() OVER (PARTITION BY i.input, s.model ORDER BY s.weight DESC, s.term) AS k
         FROM (SELECT DISTINCT input, known FROM {inputs}) i JOIN sides s USING (known)),
related AS (SELECT input, term, weight, model FROM hits WHERE k <= CASE WHEN model = 'SWEET' THEN 30 ELSE 20 END AND term <> known),
raw_fused AS (SELECT input, term, sum(weight * {_W}) AS sw, sum({_W}) AS m, count(*) AS n FROM related GROUP BY ALL),
fused AS (SELECT input, term, {_half_even('least(greatest(sw / m + (n - 2) * 0.05, 0), 1)')} AS weight FROM raw_fused),
graph_fused AS (SELECT input, term, {_half_even('least(greatest(sw / m + (m - 2) * 0.05, 0), 1)')} AS weight FROM raw_fused),
top AS (SELECT *, row_number() OVER (PARTITION BY input ORDER BY weight DESC, term DESC) AS k FROM fused),
graph_top AS (SELECT *, row_number() OVER (PARTITION BY input ORDER BY weight DESC, term DESC) AS k FROM graph_fused)"""


ASKED = f"asked AS (SELECT DISTINCT p_name AS input, {_NORM.format('p_name')} AS known FROM part)"
LINKED = f"{PAIRS}, {ONTOLOGY}, {ASKED}, {_related('asked')}"
_LINE = "string_agg(term || ' = ' || weight || ',', '' ORDER BY k)"
SQL["ontology_links"] = f"WITH {ONTOLOGY} SELECT concept_a, concept_b, weight, count(*) AS n FROM onto GROUP BY ALL"
SQL["region_ontology"] = """SELECT CASE r_name WHEN 'AFRICA' THEN 'africa' WHEN 'AMERICA' THEN 'america' WHEN 'ASIA' THEN 'asia' WHEN 'EUROPE' THEN 'europ' ELSE 'middl east' END AS concept_a,
  lower(n_name) AS concept_b, 0.75::DOUBLE AS weight FROM nation JOIN region ON n_regionkey = r_regionkey"""
SQL["model_term_pairs"] = f"WITH {PAIRS} SELECT term_a, term_b, weight, model FROM term_pairs"
SQL["related_terms"] = f"WITH {LINKED} SELECT input, term, weight, model FROM related"
SQL["fused_terms"] = f"WITH {LINKED} SELECT input, term, weight FROM fused"
SQL["linked_terms"] = f"""WITH {LINKED}
SELECT a.input, coalesce((SELECT {_LINE} FROM top t WHERE t.input = a.input AND k <= 12), '') AS text FROM asked a"""
SQL["expanded_queries"] = f"""WITH {LINKED}
SELECT a.input, '(' || replace(a.input, ' ', ' AND ') || ')' ||
  coalesce((SELECT string_agg(' OR (' || replace(term, ' ', ' AND ') || ')', '' ORDER BY k) FROM top t WHERE t.input = a.input AND k <= 3), '') AS query FROM asked a"""
SQL["vocabulary_graph"] = f"""WITH {LINKED}
SELECT a.input, '{{"nodes":[{{"name":"' || a.input || '","group":1}}' ||
  coalesce((SELECT string_agg(',{{"name":"' || term || '","group":10}}', '' ORDER BY k) FROM graph_top t WHERE t.input = a.input AND k <= 10), '') || '],"links":[' ||
  coalesce((SELECT string_agg('{{"source":' || k || ',"target":0,"value":' || weight || '}}', ',' ORDER BY k) FROM graph_top t WHERE t.input = a.input AND k <= 10), '') || ']}}' AS graph
FROM asked a"""
_FIXED = ", ".join(f"('{t}')" for t in REPORT_TERMS)
SQL["evaluation_report"] = f"""WITH {PAIRS}, {ONTOLOGY},
kn AS (SELECT keyword, count(*) AS n FROM sk GROUP BY ALL),
report AS (
  SELECT 'frequent' AS section, keyword AS input FROM (SELECT keyword FROM kn ORDER BY n DESC, keyword LIMIT 10)
  UNION ALL SELECT 'middle', keyword FROM kn WHERE n BETWEEN 19 AND 22
  UNION ALL SELECT 'fixed', t FROM (VALUES {_FIXED}) f(t)),
asked AS (SELECT input, input AS known FROM report), {_related('asked')}
SELECT section, input, coalesce((SELECT {_LINE} FROM top t WHERE t.input = r.input AND k <= 12), '') AS text FROM report r"""
SQL["keyword_suggestions"] = f"WITH {BUYS} SELECT keyword AS term, count(*) AS n FROM sk GROUP BY ALL"
SQL["pair_helpers"] = f"""WITH {ONTOLOGY}
SELECT DISTINCT concept_a, concept_b, concept_a AS other, md5(concept_a || ',' || concept_b) AS digest, '(' || replace(concept_a, ' ', ' AND ') || ')' AS both FROM onto"""
_EDITS = " OR ".join(f"(length(prefix) + {d} >= 1 AND levenshtein(left(term, length(prefix) + {d}), prefix) <= 2)" for d in (-2, -1, 0, 1, 2))
SQL["autocomplete"] = f"""WITH
terms AS (SELECT DISTINCT p_name AS term FROM part),
typed AS (SELECT DISTINCT unnest([substr(term, 1, 2), substr(term, 1, 6), substr(term, 1, 3) || substr(term, 5, 4), substr(term, 1, 2) || 'x' || substr(term, 3, 5)]) AS prefix FROM terms),
hits AS (
  SELECT prefix, term FROM typed JOIN terms ON length(prefix) < 3 AND starts_with(term, prefix)
  UNION ALL SELECT prefix, term FROM typed JOIN terms ON length(prefix) >= 3 AND left(term, 1) = left(prefix, 1) AND ({_EDITS})),
ranked AS (SELECT prefix, CAST(row_number() OVER (PARTITION BY prefix ORDER BY term) AS INTEGER) AS rank, term FROM hits)
SELECT prefix, rank, term FROM ranked WHERE rank <= 10"""


def _search(groups: str) -> str:
    """CTEs from ``qterms`` (input, part, s) and ``counts`` to ranked hits."""
    return f"""
qn AS (SELECT input, part, count(*) AS n_terms FROM {groups} GROUP BY ALL),
lens AS (SELECT doc, sum(tf) AS len FROM counts GROUP BY doc),
spread AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
consts AS (SELECT count(*) AS n, avg(len) AS mean FROM lens),
scored AS (
  SELECT c.term, c.doc, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS sc
  FROM counts c JOIN spread USING (term) JOIN lens USING (doc), consts WHERE c.term IN (SELECT s FROM {groups})),
parts_hit AS (
  SELECT q.input, q.part, doc, count(*) AS matched, sum(sc) AS sc FROM {groups} q JOIN scored ON q.s = scored.term GROUP BY ALL),
doc_hits AS (SELECT p.input, doc, round(sum(sc), 8) AS score FROM parts_hit p JOIN qn USING (input, part) WHERE matched = n_terms GROUP BY ALL),
ranked_hits AS (SELECT *, row_number() OVER (PARTITION BY input ORDER BY score DESC, doc) AS k, max(score) OVER (PARTITION BY input) AS best FROM doc_hits)"""


SQL["document_search"] = f"""WITH {PASSAGE_WORDS},
vocab AS (SELECT DISTINCT term AS w FROM counts), {_porter('vocab', 'v')},
term_pairs AS (SELECT DISTINCT least(x, y) AS term_a, greatest(x, y) AS term_b, {_half_even('cosine')} AS weight, 'GCMDMetadata' AS model FROM fcs WHERE cosine > 0),
onto AS (SELECT '' AS concept_a, '' AS concept_b, 0.0::DOUBLE AS weight WHERE false),
asked AS (SELECT w AS input, CASE WHEN w IN ({_STOP}) THEN '' ELSE s END AS known FROM v WHERE w IN (SELECT term FROM asked_words)), {_related('asked')},
phrases AS (SELECT input, 0 AS part, input AS phrase FROM asked UNION ALL SELECT input, k, term FROM top WHERE k <= 3),
qterms AS (SELECT p.input, p.part, v.s FROM phrases p JOIN v ON p.phrase = v.w WHERE p.phrase NOT IN ({_STOP})), {_search('qterms')}
SELECT input, CAST(k AS INTEGER) AS rank, doc, score, {_half_even('score / best * 100')} AS relevance FROM ranked_hits WHERE k <= 500"""
SQL["benchmark_search"] = f"""WITH {COUNTS},
btoks AS (SELECT text AS input, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS w FROM benchmark),
bcontent AS (SELECT DISTINCT input, w FROM btoks WHERE w NOT IN ({_STOP})), {_porter('bcontent', 'bs')},
qterms AS (SELECT DISTINCT input, 0 AS part, s FROM bcontent JOIN bs USING (w)), {_search('qterms')}
SELECT md5(input) AS input, CAST(k AS INTEGER) AS rank, doc, score, {_half_even('score / best * 100')} AS relevance FROM ranked_hits WHERE k <= 500"""

# --- metadata --------------------------------------------------------------------------------------

META = """
m AS (SELECT 'PART_' || p_partkey AS short_name, 'the ' || p_name AS long_name, p_name || ', ' || p_brand || ',' || p_name AS keyword, p_type AS term,
  '"' || p_type || ' goods","' || p_brand || '"' AS topic, 'size ' || p_size || ',' AS variable,
  CASE WHEN p_partkey % 4 <> 0 THEN '100% ' || p_name || ' & ' || p_type || '?' END AS abstract, p_name, p_brand, p_type, p_size FROM part)"""
SQL["metadata_json"] = f"WITH {META} SELECT short_name, long_name, keyword, term, topic, variable, abstract FROM m"
SQL["metadata_export"] = f"""WITH {META}
SELECT short_name, '{{"shortName":"' || short_name || '","longName":"' || long_name || '","keywordStr":"' || keyword || '","termStr":"' || term ||
  '","topicStr":"' || replace(topic, '"', '\\"') || '","variableStr":"' || variable || '"' ||
  coalesce(',"abstractStr":"100%25+' || replace(p_name, ' ', '+') || '+%26+' || p_type || '%3F"', '') || '}}' AS record
FROM m WHERE abstract IS NOT NULL
UNION ALL
SELECT short_name, '{{"shortName":"' || short_name || '","longName":"' || long_name || '","keywordStr":"' || keyword || '","termStr":"' || term ||
  '","topicStr":"' || replace(topic, '"', '\\"') || '","variableStr":"' || variable || '"}}' FROM m WHERE abstract IS NULL"""
SQL["metadata_delimited"] = """SELECT CAST(p_partkey AS VARCHAR) AS short_name, p_name AS long_name, p_brand AS topic, p_type AS term,
  CAST(p_size AS VARCHAR) AS variable, p_name || ', ' || p_type AS keyword FROM part"""
SQL["metadata_dif"] = """SELECT CAST(p_partkey AS VARCHAR) AS short_name, p_name AS long_name, 'made of ' || p_type AS abstract,
  p_type || ',size ' || p_size AS isotopic, p_brand || ',' || p_name AS sensor, p_type || ',' || p_size AS source, p_size || ',' || p_brand AS project FROM part"""
SQL["metadata_terms"] = f"""WITH {META}, s AS (SELECT short_name, [p_type, p_name, p_brand, p_name, p_type || ' goods', p_brand, 'size ' || p_size] AS terms,
  [p_type, p_type || ' goods', p_brand, 'size ' || p_size, p_name] AS subjects FROM m)
SELECT short_name, array_to_string(terms, '|') AS terms, array_to_string(subjects, '|') AS subjects,
  array_to_string(list_transform(subjects, lambda x: replace(x, ' ', '_')), ' ') AS tokens FROM s"""
SQL["metadata_split"] = f"WITH {META} SELECT short_name, CASE WHEN abstract IS NULL THEN 'without' ELSE 'described' END AS target FROM m"
SQL["feature_matrix_lines"] = """WITH v AS (SELECT 'v' || vec_id AS term, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT term, CAST(i - 1 AS INTEGER) AS feature, CASE WHEN x > 0.1 THEN 1.0 ELSE -1.0 END::DOUBLE AS weight FROM v WHERE x > 0.1 OR x < -0.1"""

# --- rules with memory, one request per step -------------------------------------------------------

REFERER_SESSIONS = f"""{LOG},
steps AS (
  SELECT *, row_number() OVER (PARTITION BY month, ip ORDER BY ts, line_id) AS n, lower(referer) AS ref,
         coalesce(contains(referer, '{SITE}/') AND referer <> '{SITE}/', false) AS in_site FROM clean),
walk AS (
  SELECT month, ip, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS line, 0 AS started, 0 AS sid,
         CAST([] AS STRUCT(s INTEGER, url VARCHAR, n BIGINT, t BIGINT)[]) AS seen
  FROM (SELECT DISTINCT month, ip FROM steps)
  UNION ALL
  SELECT month, ip, n, line_id, greatest(started, to_sid), to_sid,
         list_append(list_filter(seen, lambda k: NOT (k.s = to_sid AND k.url = request_url)),
                     struct_pack(s := to_sid, url := request_url, n := n, t := epoch))
  FROM (
    SELECT *, CASE
      WHEN log_type = 'ftp' AND started = 0 AND NOT has_zero THEN 0
      WHEN log_type = 'ftp' THEN CASE WHEN epoch - list_max(list_transform(list_filter(seen, lambda k: k.s = started), lambda k: k.t)) > {GAP} THEN started + 1 ELSE started END
      WHEN NOT in_site THEN started + 1
      WHEN hit IS NULL THEN CASE WHEN has_zero THEN started + 1 ELSE 0 END
      WHEN epoch - hit.t < {GAP} * len(list_filter(seen, lambda k: k.s > hit.s OR (k.s = hit.s AND k.n >= hit.n))) THEN hit.s
      ELSE started + 1 END AS to_sid
    FROM (
      SELECT o.month, o.ip, o.n, o.line_id, o.log_type, o.epoch, o.request_url, o.in_site, w.started, w.seen,
             len(list_filter(w.seen, lambda k: k.s = 0)) > 0 AS has_zero,
             list_sort(list_filter(w.seen, lambda k: k.url = o.ref))[-1] AS hit
      FROM walk w JOIN steps o ON o.month = w.month AND o.ip = w.ip AND o.n = w.n + 1))),
gs AS (SELECT c.*, c.ip || '@' || w.sid AS session_id FROM clean c JOIN walk w ON w.n > 0 AND w.line = c.line_id)"""
SQL["referer_sessions"] = f"WITH RECURSIVE {REFERER_SESSIONS} SELECT line_id, month, ip, session_id FROM gs"
SQL["referer_session_statistics"] = SQL["session_statistics"].replace(f"WITH {SESSIONS}", f"WITH RECURSIVE {REFERER_SESSIONS}")

TREE = f"""{SESSIONS},
tree_rows AS (
  SELECT *, row_number() OVER (PARTITION BY month, ip, session_id ORDER BY ts, line_id) AS seq, coalesce(path, request) AS page,
         CASE WHEN event_type IN ('signup', 'click') THEN 'datasetlist' WHEN event_type = 'purchase' THEN 'ftp' ELSE 'dataset' END AS key,
         coalesce(replace(lower(referer), '{SITE}', ''), '') AS ref
  FROM gs),
grow AS (
  SELECT month, ip, session_id, CAST(0 AS BIGINT) AS seq,
         CAST([] AS STRUCT(seq BIGINT, key VARCHAR, page VARCHAR, ds VARCHAR, pseq BIGINT, pkey VARCHAR, above VARCHAR[])[]) AS nodes
  FROM (SELECT DISTINCT month, ip, session_id FROM tree_rows)
  UNION ALL
  SELECT month, ip, session_id, seq, CASE
      WHEN (len(nodes) = 0 AND key <> 'datasetlist') OR nodes[-1].page = page OR (p IS NULL AND key <> 'datasetlist') THEN nodes
      ELSE list_append(nodes, struct_pack(seq := seq, key := key, page := page, ds := ds, pseq := coalesce(p.seq, 0), pkey := coalesce(p.key, 'root'),
             above := CASE WHEN p IS NULL THEN CAST([] AS VARCHAR[]) WHEN p.key = 'datasetlist' THEN list_prepend(p.page, p.above) ELSE p.above END)) END
  FROM (
    SELECT r.month, r.ip, r.session_id, r.seq, r.key, r.page, g.nodes, CASE WHEN r.key = 'dataset' THEN 'ds_' || r.ds END AS ds,
           CASE WHEN r.key = 'ftp' THEN list_filter(g.nodes, lambda x: x.key = 'dataset')[-1]
                WHEN r.ref <> '-' THEN list_filter(g.nodes, lambda x: x.page = r.ref)[-1] END AS p
    FROM grow g JOIN tree_rows r ON r.month = g.month AND r.ip = g.ip AND r.session_id = g.session_id AND r.seq = g.seq + 1)),
final AS (SELECT month, ip, session_id, arg_max(nodes, seq) AS nodes FROM grow GROUP BY ALL),
flat AS (SELECT month, ip, session_id, unnest(nodes) AS x FROM final),
kids AS (SELECT month, ip, session_id, x.pseq AS seq, count(*) AS n, bool_or(x.key = 'ftp') AS got FROM flat GROUP BY ALL),
tree AS (
  SELECT f.month, f.session_id, f.x.seq AS seq, f.x.key AS key, f.x.page AS request, f.x.ds AS dataset_id, f.x.pseq AS parent_seq,
         f.x.pkey AS parent_key, coalesce(k.n, 0) AS n_children, coalesce(k.got, false) AS downloaded, f.x.above[1] AS search_url,
         CASE WHEN f.x.key = 'dataset' AND k.got THEN array_to_string(f.x.above, '|') END AS search_path
  FROM flat f LEFT JOIN kids k ON k.month = f.month AND k.ip = f.ip AND k.session_id = f.session_id AND k.seq = f.x.seq)"""
SQL["session_tree"] = f"""WITH RECURSIVE {TREE}
SELECT month, session_id, CAST(seq AS INTEGER) AS seq, key, request, dataset_id, CAST(parent_seq AS INTEGER) AS parent_seq, parent_key,
       CAST(n_children AS INTEGER) AS n_children, downloaded, search_url, search_path FROM tree"""
SQL["tree_leaves"] = f"""WITH RECURSIVE {TREE}
SELECT 'view' AS kind, session_id, CAST(seq AS INTEGER) AS seq, key FROM tree WHERE key = 'dataset'
UNION ALL SELECT 'leaf', session_id, CAST(seq AS INTEGER), key FROM tree WHERE n_children = 0
UNION ALL SELECT 'download', session_id, CAST(seq AS INTEGER), key FROM tree WHERE n_children = 0 AND key = 'ftp'"""
_BROWSED = TREE.replace(
    f"coalesce(replace(lower(referer), '{SITE}', ''), '') AS ref",
    "coalesce(last_value(CASE WHEN event_type IN ('signup', 'click') THEN path END IGNORE NULLS) OVER "
    "(PARTITION BY month, ip, session_id ORDER BY ts, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-') AS ref",
) + f""",
pages AS (SELECT DISTINCT page, event_type AS kind, word AS w, {_INFO} AS info FROM tree_rows WHERE key = 'datasetlist')"""
SQL["tree_keyword_pairs"] = f"""WITH RECURSIVE {_BROWSED},
taken AS (
  SELECT f.month, f.ip, f.session_id, f.x.seq AS view_seq, f.x.page AS view_url, unnest(f.x.above) AS page, generate_subscripts(f.x.above, 1) - 1 AS k
  FROM flat f JOIN kids k ON k.month = f.month AND k.ip = f.ip AND k.session_id = f.session_id AND k.seq = f.x.seq
  WHERE f.x.key = 'dataset' AND k.got),
named AS (SELECT t.*, replace(p.info, ',', '|') AS info FROM taken t JOIN pages p USING (page))
SELECT a.month, a.session_id, a.view_url, b.info AS keyword_a, a.info AS keyword_b, round(1.0 / (a.k + 1), 8) AS weight
FROM named a JOIN named b ON a.month = b.month AND a.ip = b.ip AND a.session_id = b.session_id AND a.view_seq = b.view_seq AND a.k < b.k
WHERE a.info <> b.info"""
SQL["tree_query_filter_pairs"] = f"WITH RECURSIVE {_BROWSED}," + """
last_search AS (
  SELECT f.month, f.ip, f.session_id, f.x.page AS view_url, f.x.seq AS view_seq, p.page AS search_url, p.w, p.kind
  FROM flat f JOIN pages p ON p.page = f.x.above[1] WHERE f.x.key = 'dataset'),
""" + SQL["query_filter_pairs"][SQL["query_filter_pairs"].index("filtered AS"):]
_WORD_OF = "['ocean wind','sea surfac temperatur','salin','graviti','sea ic','ocean wave'][list_position(['ocean%20winds','sea%20surface%20temperature','salinity','gravity','sea%20ice','ocean_wave'], split_part(request, '?search=', 2))]"
SQL["tree_dataset_keywords"] = f"""WITH RECURSIVE {_BROWSED}
SELECT dataset_id AS dataset, {_WORD_OF} AS keyword, count(*) AS n FROM tree
WHERE key = 'dataset' AND parent_key = 'datasetlist' AND contains(request, '?search=') GROUP BY ALL"""
SQL["referer_click_through"] = f"""WITH RECURSIVE {TREE}
SELECT month, session_id, {_WORD_OF} AS keyword, dataset_id AS dataset, downloaded FROM tree
WHERE key = 'dataset' AND parent_key = 'datasetlist' AND contains(request, '?search=')"""
SQL["first_fit_tree"] = f"""WITH {SESSIONS},
k AS (
  SELECT *, row_number() OVER (PARTITION BY month, ip, session_id ORDER BY ts, line_id) AS seq,
         CASE WHEN event_type IN ('signup', 'click') THEN 'datasetlist' WHEN event_type = 'purchase' THEN 'ftp' ELSE 'dataset' END AS key
  FROM gs),
f AS (SELECT * FROM k k1 WHERE EXISTS (SELECT 1 FROM k k2 WHERE k2.month = k1.month AND k2.ip = k1.ip AND k2.session_id = k1.session_id AND k2.key = 'datasetlist' AND k2.seq <= k1.seq)),
p AS (
  SELECT *, CASE WHEN key = 'ftp' THEN min(CASE WHEN key = 'dataset' THEN seq END) OVER w ELSE max(CASE WHEN key = 'datasetlist' THEN seq END) OVER w END AS up
  FROM f WINDOW w AS (PARTITION BY month, ip, session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
kept AS (SELECT * FROM p WHERE key <> 'ftp' OR up IS NOT NULL)
SELECT a.month, a.session_id, CAST(a.seq AS INTEGER) AS seq, a.key, CAST(coalesce(a.up, 0) AS INTEGER) AS parent_seq,
       CASE WHEN a.key = 'ftp' THEN 'dataset' WHEN a.up IS NULL THEN 'root' ELSE 'datasetlist' END AS parent_key,
       CAST((SELECT count(*) FROM kept b WHERE b.month = a.month AND b.ip = a.ip AND b.session_id = a.session_id AND b.up = a.seq) AS INTEGER) AS n_children
FROM kept a"""
SQL["session_documents"] = f"""WITH RECURSIVE {TREE}, {_statistics('gs')},
listed AS (
  SELECT month, ip, session_id, string_agg(seq || ':' || epoch || ':' || log_type, '|' ORDER BY seq) AS requests
  FROM tree_rows GROUP BY ALL),
placed AS (SELECT month, ip, session_id, string_agg(x.seq, ',' ORDER BY x.seq) AS nodes FROM flat GROUP BY ALL),
said AS (SELECT '10.0.0.' || conv_id || '@1' AS session_id, string_agg(role || ':' || md5(text), '|' ORDER BY turn DESC) AS comments FROM conversations GROUP BY ALL),
spoken AS (SELECT month, ip, session_id, {_lists('first_words', 'keywords')} FROM good g)
SELECT month, ip, session_id, requests, '0' || coalesce(',' || nodes, '') AS tree_nodes, coalesce(comments, '') AS comments, coalesce(keywords, '') AS keywords
FROM listed LEFT JOIN placed USING (month, ip, session_id) LEFT JOIN said USING (session_id) LEFT JOIN spoken USING (month, ip, session_id)"""
SQL["svd_group_cosine"] = """WITH
sized AS (SELECT p_brand, count(*) * CAST(substr(p_brand, 7, 2) AS DOUBLE) ** 2 AS square FROM part GROUP BY p_brand),
kept AS (SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM sized ORDER BY square DESC LIMIT 5)),
named AS (SELECT CAST(p_partkey AS VARCHAR) AS term, p_brand FROM kept)
SELECT a.term AS term_a, b.term AS term_b, 1.0::DOUBLE AS weight FROM named a JOIN named b ON a.p_brand = b.p_brand AND a.term < b.term"""
SQL["topic_word_order"] = """SELECT CAST(t AS INTEGER) AS topic, CAST(r AS INTEGER) AS rank, true AS known, true AS once, true AS falling
FROM range(8) a(t), range(1, 11) b(r) WHERE (SELECT count(*) FROM part) > 0"""
SQL["versioned_events"] = """WITH
kept AS (
  SELECT event_id, user_id, event_type,
         strftime(CASE WHEN event_type = 'click' THEN ts + INTERVAL 1 DAY ELSE ts END, '%Y-%m-%d') AS day
  FROM events WHERE event_type <> 'error')
SELECT * FROM kept WHERE day <> (SELECT min(day) FROM kept) OR event_type = 'purchase'"""
SQL["prefixed_orders"] = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')"
SQL["stored_term_pairs"] = """WITH p AS (SELECT p_brand AS term_a, p_type AS term_b, count(*)::DOUBLE AS weight FROM part GROUP BY ALL)
SELECT term_a, term_b, weight, 'count' AS model FROM p UNION ALL SELECT term_a, term_b, 2 * weight, 'twice' FROM p"""
