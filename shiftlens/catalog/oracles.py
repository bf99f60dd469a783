"""The SQL counterpart of each registered query, for DuckDB over the same tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# Python's white space, spelt out: RE2 has no Unicode \s.
WHITESPACE = (
    r"[\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

ISO = "'%Y-%m-%dT%H:%M:%S.%f'"
LINE_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"
DIMS = 256

# Columns of the chunked tables as (name, type) in table order; the first is the key.
CHUNKED = {
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")],
}
ORDERS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]
NUMERIC = ("bigint", "int", "double")

SHIFT_FACT = """shift_fact AS (
  SELECT l_suppkey AS PUID, l_orderkey * 10 + l_linenumber AS ID, l_linenumber AS SHIFT_ID,
         l_shipdate AS ShiftStartTime, l_shipdate + INTERVAL 8 HOUR AS ShiftEndTime,
         1 - l_discount AS availability, l_quantity / 50 AS performance, 1 - l_tax AS quality,
         l_quantity AS total_count
  FROM lineitem)"""

ACCESS = """machine_access AS (
  SELECT s_suppkey AS PUID, 'U' || (s_suppkey % 10) AS user_code, 'P' || (s_suppkey % 4) AS Plantcode,
         'G' || n_regionkey AS groupcode
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

GOVERNED = f"""{SHIFT_FACT}, {ACCESS}, seen AS (
  SELECT * FROM shift_fact
  WHERE PUID IN (SELECT PUID FROM machine_access WHERE user_code = 'U3' AND Plantcode = 'P3'))"""

QUERY_LOG = """turns AS (
  SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
         lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
  FROM conversations),
query_log AS (
  SELECT 'q-' || conv_id || '-' || turn AS query_id, 'r-' || conv_id || '-' || turn AS response_id,
         text AS query_text, next_text AS response_text, 'U' || (conv_id % 10) AS user_code,
         'P' || (conv_id % 4) AS plant_code,
         TIMESTAMP '2025-05-01 00:00:00' + to_minutes(conv_id * 37 + turn) AS created_at, conv_id
  FROM turns WHERE role = 'user' AND next_role = 'assistant')"""


def words(text: str) -> str:
    """List of the white-space separated words of a text column."""
    return f"list_filter(string_split_regex({text}, '{WHITESPACE}+'), lambda w: w <> '')"


def stripped(text: str) -> str:
    """Text without white space at its ends."""
    return f"regexp_replace({text}, '^{WHITESPACE}+|{WHITESPACE}+$', '', 'g')"


TOKENS = f"""{QUERY_LOG}, token_log AS (
  SELECT strftime(created_at, '%Y-%m-%d %H:%M:%S') AS timestamp,
         CAST(len({words('response_text')}) AS BIGINT) AS nlp_tokens,
         CAST(len({words('query_text')}) AS BIGINT) AS table_tokens, CAST(0 AS BIGINT) AS viz_tokens
  FROM query_log),
token_lines AS (SELECT *, nlp_tokens + table_tokens + viz_tokens AS total_tokens FROM token_log)"""

RESPONSES = f"""{QUERY_LOG}, raw_responses AS (
  SELECT *, 'SELECT count(*) FROM shift_fact WHERE SHIFT_ID = ' || (conv_id % 7) AS sql_text FROM query_log),
responses AS (
  SELECT query_id, conv_id % 2 AS n_rows, conv_id % 11 <> 0 AS store_ready, response_text,
         CASE conv_id % 3
           WHEN 0 THEN response_text || chr(10) || '```sql' || chr(10) || chr(9) || sql_text || ' ' || chr(10) || '```' || chr(10) || 'Done.'
           WHEN 1 THEN response_text || ' ```sql ' || sql_text || chr(10)
           ELSE response_text END AS response
  FROM raw_responses),
parsed AS (
  SELECT *, contains(response, '```sql') AS has_sql,
         CASE WHEN contains(response, '```sql')
              THEN {stripped("string_split(string_split(response, '```sql')[2], '```')[1]")} END AS sql_query
  FROM responses)"""


def row_text(columns: list[tuple[str, str]]) -> str:
    """``col: value | col: value`` of a row."""
    return " || ' | ' || ".join(f"'{c}: ' || coalesce(CAST({c} AS VARCHAR), 'None')" for c, _ in columns)


def data_chunks(table: str, columns: list[tuple[str, str]]) -> str:
    """Data chunks of a table."""
    key = columns[0][0]
    return f"""SELECT CAST(i // 5 AS BIGINT) AS chunk_id, 'data' AS kind,
         'Data chunk:' || chr(10) || string_agg(t, chr(10) ORDER BY i) || chr(10) AS chunk_text
  FROM (SELECT row_number() OVER (ORDER BY {key}) - 1 AS i, {row_text(columns)} AS t FROM {table}) GROUP BY i // 5"""


def schema_chunk(table: str, columns: list[tuple[str, str]]) -> str:
    """The schema chunk of a table."""
    lines = " || ".join(f"'Column: {c}, Type: {t}' || chr(10)" for c, t in columns)
    return f"""SELECT CAST(ceil(count(*) / 5) AS BIGINT) AS chunk_id, 'schema' AS kind,
         'Table schema:' || chr(10) || {lines} AS chunk_text FROM {table}"""


def stats_chunks(table: str, columns: list[tuple[str, str]]) -> str:
    """The statistics chunks of a table."""
    def fixed(value: str) -> str:
        return f"CAST(CAST(round({value}, 6) AS DECIMAL(38,6)) AS VARCHAR)"

    parts = []
    for i, (c, t) in enumerate([x for x in columns if x[1] in NUMERIC]):
        low, high = (f"CAST({f}({c}) AS VARCHAR)" if t != "double" else fixed(f"{f}({c})") for f in ("min", "max"))
        parts.append(f"""SELECT CAST(ceil(count(*) / 5) AS BIGINT) + {1 + i} AS chunk_id, 'stats' AS kind,
         'Stats for {c}:' || chr(10) || 'Min: ' || {low} || ', Max: ' || {high} || ', Mean: ' || {fixed(f'avg({c})')}
         || ', Median: ' || {fixed(f'median(CAST({c} AS DOUBLE))')} || chr(10) AS chunk_text FROM {table}""")
    return " UNION ALL ".join(parts)


def _each(make) -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, * FROM ({make(t, cols)})" for t, cols in CHUNKED.items())


CHUNKS = f"""chunks AS (
  SELECT *, sha256(chunk_text) AS content_hash FROM (
    {_each(data_chunks)} UNION ALL {_each(schema_chunk)} UNION ALL {_each(stats_chunks)}))"""

SCHEMA_ROWS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST({i} AS INTEGER) AS ordinal, '{c}' AS column_name, '{k}' AS column_type, count(*) AS n_rows, count({c}) AS n_values FROM {t}"
    for t, cols in CHUNKED.items()
    for i, (c, k) in enumerate(cols)
)


def weights(name: str, source: str, key: str, text: str) -> str:
    """CTEs with the sparse unit vectors of a text column."""
    return f"""{name}_counts AS (
  SELECT {key}, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % {DIMS} AS bucket, count(*) AS n
  FROM (SELECT {key}, unnest({words(text)}) AS w FROM {source}) GROUP BY ALL),
{name}_norms AS (SELECT {key}, sqrt(sum(n * n)) AS norm FROM {name}_counts GROUP BY {key}),
{name}_weights AS (
  SELECT {key}, CAST(bucket AS INTEGER) AS bucket, n / norm AS weight FROM {name}_counts JOIN {name}_norms USING ({key}))"""


def text_scores(store: str, queries: str = "benchmark", key: str = "item_id") -> str:
    """CTEs that score every text of ``queries`` against every chunk of ``store`` (key, source, chunk_id)."""
    return f"""{weights('q', queries, key, 'text')},
{weights('c', store, 'ckey', 'chunk_text')},
shared AS (
  SELECT {key}, ckey, sum(a.weight * b.weight) AS s
  FROM q_weights a JOIN c_weights b USING (bucket) GROUP BY {key}, ckey),
scores AS (
  SELECT {key} AS query_id, source, chunk_id, round(coalesce(s, 0), 6) AS score
  FROM (SELECT {key} FROM {queries}) CROSS JOIN (SELECT ckey, source, chunk_id FROM {store})
  LEFT JOIN shared USING ({key}, ckey))"""


def components(name: str, key: str) -> str:
    """CTE with the non-zero components of the vectors of :func:`weights`, as text in order."""
    value = "CAST(CAST(weight AS DECIMAL(18,6)) AS VARCHAR)"
    return f"""{name}_components AS (
  SELECT {key}, string_agg(bucket || ':' || {value}, ',' ORDER BY bucket) AS components FROM {name}_weights GROUP BY {key})"""


CHUNK_VECTORS = f"""{CHUNKS}, keyed AS (SELECT *, table_name || '_' || chunk_id AS ckey FROM chunks),
{weights('v', 'keyed', 'ckey', 'chunk_text')}, {components('v', 'ckey')},
embedded AS (SELECT * FROM keyed JOIN v_components USING (ckey))"""

TAGGED = f"""{CHUNKS}, tagged AS (
  SELECT table_name || '_' || chunk_id AS ckey, table_name AS source, chunk_id, chunk_text FROM chunks)"""
CHUNK_SCORES = f"""{TAGGED},
{text_scores('tagged')}"""

DOC_SCORES = f"""docs AS (
  SELECT doc_id AS ckey, source, doc_id AS chunk_id, text AS chunk_text FROM documents),
{text_scores('docs')}"""

ROUTED = f"""{CHUNK_SCORES}, best AS (SELECT query_id, source, max(score) AS score FROM scores GROUP BY query_id, source),
routed AS (
  SELECT query_id, source, score FROM (
    SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM best) WHERE score >= 0.1 OR top < 0.1)"""

VECTOR_SCORES = """vectors AS (
  SELECT vec_id, CAST(label AS VARCHAR) AS source, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
scores AS (
  SELECT q.vec_id AS query_id, c.source, c.vec_id AS chunk_id, round(list_cosine_similarity(q.e, c.e), 6) AS score,
         list_cosine_similarity(q.e, c.e) AS exact_score
  FROM vectors q CROSS JOIN vectors c)"""

TOP_PER_SOURCE = """top AS (
  SELECT query_id, source, chunk_id, score,
         CAST(row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
  FROM scores)"""

TOP_OVERALL = """top AS (
  SELECT query_id, source, chunk_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, chunk_id) AS INTEGER) AS rank
  FROM scores)"""


def oracle(name: str, sql: str) -> None:
    """Register the counterpart of a query."""
    ORACLES[name] = sql


# ---- scans, sources, sinks

oracle("scan_sample", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000")
oracle("schema_profile", SCHEMA_ROWS)
oracle("sql_governed", f"""WITH {GOVERNED}
SELECT strftime(ShiftStartTime, '%Y') AS year, count(*) AS n_shifts,
       round(avg(availability * performance * quality), 6) AS oee
FROM seen WHERE performance >= 0.25 GROUP BY 1""")
oracle("store_count", f"WITH {CHUNKS} SELECT table_name, count(*) AS n_chunks FROM chunks GROUP BY table_name")
oracle("store_decode", f"""WITH {CHUNK_VECTORS}
SELECT table_name || '_' || chunk_id AS record_id, chunk_text, CAST({DIMS} AS INTEGER) AS n_dims, CAST(1 AS DOUBLE) AS norm, components FROM embedded""")
oracle("store_append", f"""WITH {CHUNK_VECTORS}
SELECT table_name || '_' || chunk_id AS record_id, table_name, chunk_id, kind, content_hash, CAST({DIMS} AS INTEGER) AS n_dims, components FROM embedded""")
oracle("store_versioned", ORACLES["store_append"])
oracle("log_scan_user", f"""WITH {QUERY_LOG}
SELECT query_id, response_id, query_text, response_text, strftime(created_at, {ISO}) AS created_at
FROM query_log WHERE user_code = 'U3' ORDER BY created_at DESC, query_id""")
oracle("log_append", f"""WITH {QUERY_LOG}
SELECT query_id, response_id, query_text, response_text, user_code, plant_code, strftime(created_at, {ISO}) AS created_at FROM query_log""")
oracle("log_time_travel", f"""WITH {QUERY_LOG}, v AS (
  SELECT 0 AS version, user_code FROM query_log UNION ALL SELECT 1, user_code FROM query_log WHERE NOT (user_code = 'U3' AND plant_code = 'P3'))
SELECT version, user_code, count(*) AS n_rows FROM v GROUP BY ALL""")
oracle("log_delete", f"""WITH {QUERY_LOG}
SELECT query_id, user_code, plant_code FROM query_log WHERE NOT (user_code = 'U3' AND plant_code = 'P3')""")
oracle("token_log_append", f"WITH {TOKENS} SELECT * FROM token_lines")
oracle("token_log_scan", f"WITH {TOKENS} SELECT timestamp, total_tokens, true AS adds_up FROM token_lines")
oracle("json_export", """SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"c_acctbal":'
       || CAST(c_acctbal AS DECIMAL(18,2)) || ',"c_mktsegment":"' || c_mktsegment || '"}' AS record,
       c_custkey, c_name, c_nationkey, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer""")
_CSV = """SELECT 'p_partkey,p_name,p_brand,p_type,p_size,p_retailprice' || chr(10) || string_agg(
         p_partkey || ',' || p_name || ',' || p_brand || ',' || p_type || ',' || p_size || ',' || p_retailprice || chr(10), '' ORDER BY p_partkey) AS csv_text
  FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 10)"""
oracle("csv_preview", f"SELECT csv_text, CAST(len({words('csv_text')}) AS INTEGER) AS n_tokens FROM ({_CSV})")
oracle("store_invalidate", f"""WITH {CHUNKS}
SELECT table_name || '_' || chunk_id AS record_id, table_name, content_hash FROM chunks WHERE table_name <> 'part'""")
_CHANGED = CHUNKS.replace("FROM supplier", "FROM (SELECT * REPLACE (s_acctbal + 10000 AS s_acctbal) FROM supplier)")
oracle("store_refresh_changed", f"""WITH {_CHANGED}, tagged AS (
  SELECT table_name || '_' || chunk_id AS ckey, table_name AS source, chunk_id, chunk_text FROM chunks),
{text_scores('tagged')}, {TOP_OVERALL}
SELECT query_id, rank, top.source, top.chunk_id, score, chunk_text
FROM top JOIN tagged ON tagged.source = top.source AND tagged.chunk_id = top.chunk_id WHERE rank <= 3""")
oracle("store_without_stale", f"""WITH {CHUNKS}
SELECT table_name || '_' || chunk_id AS record_id, table_name, kind, content_hash FROM chunks
WHERE table_name <> 'supplier' OR (kind <> 'data' AND chunk_text NOT LIKE 'Stats for s_acctbal%')""")
oracle("store_metadata", f"""WITH {CHUNKS}, schema_rows AS ({SCHEMA_ROWS}), cols AS (
  SELECT table_name, string_agg(column_name, ', ' ORDER BY ordinal) AS columns FROM schema_rows GROUP BY table_name)
SELECT table_name, '2025-06-01T00:00:00.000000' AS created_at, count(*) AS num_chunks, count(*) AS num_embeddings, any_value(columns) AS columns
FROM chunks JOIN cols USING (table_name) GROUP BY table_name""")

# ---- projections, filters, predicates

oracle("filter_eq", f"WITH {CHUNKS} SELECT table_name || '_' || chunk_id AS record_id, chunk_text FROM chunks WHERE table_name = 'part'")
oracle("filter_role", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
oracle("filter_date", "SELECT event_id, event_type, value FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15'")
oracle("select_numeric", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
oracle("access_guard", """SELECT 'given' AS case_name, count(*) AS n_rows FROM lineitem
UNION ALL SELECT unnest(['no_user', 'no_plant', 'blank_user', 'empty_plant', 'tab_user', 'newline_plant', 'no_break_user']), CAST(0 AS BIGINT)""")
oracle("mask_columns", f"""WITH {SHIFT_FACT}
SELECT strftime(ShiftStartTime, {ISO}) AS ShiftStartTime, strftime(ShiftEndTime, {ISO}) AS ShiftEndTime,
       round(availability, 6) AS availability, round(performance, 6) AS performance, round(quality, 6) AS quality, total_count
FROM shift_fact""")
oracle("chart_resolve", "SELECT o_orderkey, o_custkey FROM orders")
oracle("result_nonempty", f"""WITH {GOVERNED}
SELECT 'own_plant' AS case_name, count(*) > 0 AS nonempty FROM seen
UNION ALL SELECT 'other_plant', count(*) > 0 FROM shift_fact
  WHERE PUID IN (SELECT PUID FROM machine_access WHERE user_code = 'U3' AND Plantcode = 'P2')""")
_OUTCOME = """CASE WHEN NOT store_ready THEN 'fallback' WHEN has_sql AND n_rows > 0 THEN 'sql_rows'
            WHEN has_sql THEN 'sql_empty' ELSE 'text' END"""
oracle("response_outcome", f"""WITH {RESPONSES}
SELECT {_OUTCOME} AS outcome, count(*) AS n_responses, count(sql_query) AS n_sql FROM parsed GROUP BY 1""")
oracle("log_to_messages", f"""WITH {QUERY_LOG}
SELECT 'user' AS role, query_id AS id, query_text AS content, response_id, response_text AS text_response, strftime(created_at, {ISO}) AS created_at FROM query_log""")

# ---- joins

oracle("join_by_relationship", f"""WITH {SHIFT_FACT}, {ACCESS}
SELECT user_code, Plantcode, groupcode, strftime(ShiftStartTime, {ISO}) AS shift_start, total_count
FROM shift_fact JOIN machine_access USING (PUID)""")
oracle("join_by_relationship_left", f"""WITH {SHIFT_FACT}, {ACCESS}
SELECT user_code, Plantcode, count(*) AS n_shifts, count(PUID) AS n_machines
FROM shift_fact LEFT JOIN (SELECT * FROM machine_access WHERE user_code = 'U3') USING (PUID) GROUP BY ALL""")
oracle("sql_or_none", """SELECT 'good' AS case_name, count(*) AS n_rows FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT unnest(['fails_later', 'wrong_name', 'statement']), CAST(NULL AS BIGINT)""")
oracle("access_semi_join", f"WITH {GOVERNED} SELECT PUID, strftime(ShiftStartTime, {ISO}) AS shift_start, total_count FROM seen")
oracle("history_join_first", f"""WITH {QUERY_LOG}
SELECT query_id, response_id || '-again' AS response_id, response_text AS text_response FROM query_log""")
oracle("similarity_pairs", f"""WITH {VECTOR_SCORES}
SELECT query_id, source, count(*) AS n_pairs, min(score) AS min_score, max(score) AS max_score, round(avg(exact_score), 6) AS mean_score
FROM scores GROUP BY query_id, source""")
oracle("chunk_vector_join", f"WITH {CHUNK_VECTORS} SELECT table_name, chunk_id, kind, content_hash, CAST({DIMS} AS INTEGER) AS n_dims, components FROM embedded")
oracle("store_missing", f"WITH {CHUNKS} SELECT table_name, chunk_id, kind, content_hash FROM chunks WHERE table_name = 'part'")

# ---- aggregations

oracle("count_rows", "SELECT count(*) AS n_rows FROM lineitem")
oracle("column_stats", " UNION ALL ".join(
    f"""SELECT CAST({i} AS INTEGER) AS ordinal, '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_values,
  round(CAST(min({c}) AS DOUBLE), 6) AS min_value, round(CAST(max({c}) AS DOUBLE), 6) AS max_value,
  round(avg({c}), 6) AS mean_value, round(median(CAST({c} AS DOUBLE)), 6) AS median_value FROM lineitem"""
    for i, c in enumerate(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"])
))
LINE_NUMBERS = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split()
oracle("column_quantiles", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({share} AS DOUBLE) AS share, round(quantile_cont(CAST({c} AS DOUBLE), {share}), 6) AS value FROM lineitem"
    for c in LINE_NUMBERS for share in (0.05, 0.25, 0.5, 0.95)))
oracle("chart_bar", """SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders GROUP BY ALL""")
oracle("chart_bar_short", """SELECT event_type, count(*) AS n_events, CASE WHEN event_type = 'error' THEN 'bad' ELSE 'good' END AS tone
FROM events GROUP BY event_type""")
oracle("chart_heatmap", """SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS "F",
       round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS "O" FROM lineitem GROUP BY l_returnflag""")
oracle("chart_heatmap_long", "SELECT l_returnflag, l_suppkey, round(avg(l_quantity), 6) AS l_quantity FROM lineitem GROUP BY ALL")
oracle("chart_histogram", """SELECT CAST(CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice >= 500000 THEN 21
       ELSE floor(20 * (o_totalprice - 0) / (500000 - 0)) + 1 END AS BIGINT) AS bin, count(*) AS n_rows FROM orders GROUP BY 1""")
oracle("chart_histogram_values", """WITH o AS (
  SELECT CASE o_orderkey % 50 WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN 'Infinity'::DOUBLE WHEN 3 THEN '-Infinity'::DOUBLE WHEN 4 THEN NULL ELSE o_totalprice END AS p FROM orders),
k AS (SELECT p, CASE WHEN p IS NULL THEN 'null' WHEN isnan(p) THEN 'nan' WHEN isinf(p) THEN CASE WHEN p > 0 THEN 'infinity' ELSE '-infinity' END ELSE 'value' END AS kind FROM o),
f AS (SELECT count(*) AS n, min(p) AS low, max(p) AS high, quantile_disc(p, 0.75) - quantile_disc(p, 0.25) AS spread FROM k WHERE kind = 'value'),
b AS (SELECT low, high, least(200, CAST(ceil((high - low) / (2 * spread / pow(n, 1.0 / 3))) AS BIGINT)) AS bins FROM f),
c AS (SELECT kind, CASE WHEN kind = 'value' THEN least(bins - 1, floor((p - low) / ((high - low) / bins))) END AS bin, count(*) AS n_rows FROM k, b GROUP BY 1, 2)
SELECT kind, CAST(NULL AS VARCHAR) AS label, round(low + (high - low) * bin / bins, 6) AS low,
       round(CASE WHEN bin = bins - 1 THEN high ELSE low + (high - low) * (bin + 1) / bins END, 6) AS high, n_rows FROM c, b""")
oracle("chart_histogram_text", """SELECT CASE WHEN o_orderpriority IS NULL THEN 'null' ELSE 'category' END AS kind, o_orderpriority AS label,
       CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high, count(*) AS n_rows FROM orders GROUP BY ALL""")
oracle("chart_pie", """WITH totals AS (
  SELECT o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1),
whole AS (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS w FROM orders)
SELECT o_orderpriority, total, round(total / w, 6) AS share FROM totals, whole""")
oracle("embedding_stats", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT count(*) AS num_chunks, count(v) AS num_embeddings,
       CAST(arg_min(len(v), (CAST(label AS VARCHAR), vec_id)) AS INTEGER) AS dimensions,
       round(avg(sqrt(list_dot_product(v, v))), 4) AS avg_magnitude,
       round(min(list_min(v)), 4) AS min_value, round(max(list_max(v)), 4) AS max_value FROM e""")
oracle("embedding_row_mean", """SELECT CAST(label AS VARCHAR) AS table_name, vec_id AS chunk_id,
       round(list_avg(CAST(embedding AS DOUBLE[])), 6) AS mean_value FROM embeddings""")
oracle("chunk_kind_counts", f"""WITH {CHUNKS}
SELECT string_split(chunk_text, chr(10))[1] AS chunk_kind, count(*) AS n_chunks FROM chunks GROUP BY 1""")
oracle("store_memory_estimate", """SELECT CAST(label AS VARCHAR) AS table_name, count(*) AS num_embeddings,
       round(sum(len(embedding)) * 4 / 1048576.0, 6) AS size_mb FROM embeddings GROUP BY 1""")
oracle("store_complete", f"""WITH {CHUNKS}, counts AS (SELECT count(DISTINCT table_name) AS n FROM chunks)
SELECT 'all' AS case_name, CAST(3 AS BIGINT) AS n_tables, n AS n_stored, n = 3 AS complete FROM counts
UNION ALL SELECT 'one_missing', CAST(3 AS BIGINT), n - 1, false FROM counts""")
oracle("history_dates", f"WITH {QUERY_LOG} SELECT DISTINCT strftime(created_at, '%Y-%m-%d') AS date FROM query_log")
oracle("token_usage_daily", f"""WITH {TOKENS}
SELECT substr(timestamp, 1, 10) AS day, count(*) AS n_turns, CAST(sum(nlp_tokens) AS BIGINT) AS nlp_tokens,
       CAST(sum(table_tokens) AS BIGINT) AS table_tokens, CAST(sum(viz_tokens) AS BIGINT) AS viz_tokens,
       CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(avg(total_tokens), 6) AS mean_tokens,
       max(total_tokens) AS max_tokens
FROM token_lines GROUP BY 1""")
oracle("result_profile", """WITH result AS (SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS largest FROM orders GROUP BY o_custkey)
SELECT CAST(ordinal AS INTEGER) AS ordinal, column_name, column_type, n_rows FROM
  (VALUES (0, 'o_custkey', 'bigint'), (1, 'n_orders', 'bigint'), (2, 'largest', 'double')) AS c(ordinal, column_name, column_type),
  (SELECT count(*) AS n_rows FROM result)""")
oracle("oee_rollup", f"""WITH {GOVERNED}
SELECT strftime(ShiftStartTime, '%Y-%m') AS month, count(*) AS n_shifts, round(avg(availability), 6) AS availability,
       round(avg(performance), 6) AS performance, round(avg(quality), 6) AS quality,
       round(avg(availability * performance * quality), 6) AS oee,
       CAST(sum(CAST(total_count AS DECIMAL(18,2))) AS DOUBLE) AS total_count
FROM seen GROUP BY 1""")

# ---- top-k, ranks, limits

oracle("topk_per_source", f"WITH {VECTOR_SCORES}, {TOP_PER_SOURCE} SELECT * FROM top WHERE rank <= 3")
oracle("retrieve_indexed", f"WITH {VECTOR_SCORES}, {TOP_OVERALL} SELECT * FROM top WHERE rank <= 3")
oracle("retrieve_topk", f"WITH {VECTOR_SCORES}, {TOP_OVERALL} SELECT * FROM top WHERE rank <= 3")
oracle("retrieve_fallback", """SELECT source, chunk_id, rank FROM (
  SELECT CAST(label AS VARCHAR) AS source, vec_id AS chunk_id,
         CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INTEGER) AS rank FROM embeddings) WHERE rank <= 3""")
oracle("retrieve_contexts", f"""WITH {TAGGED}, talk AS (
  SELECT conv_id || '-' || turn AS qkey, role, text FROM conversations),
spoken AS (SELECT qkey, text FROM talk WHERE role <> 'system'),
{text_scores('tagged', 'spoken', 'qkey')}, {TOP_OVERALL}, numbered AS (
  SELECT source, chunk_id, row_number() OVER (PARTITION BY source ORDER BY chunk_id) AS i FROM tagged),
listed AS (SELECT source, chunk_id, CAST(row_number() OVER (ORDER BY source, i) AS INTEGER) AS rank FROM numbered WHERE i <= 3)
SELECT query_id, source, chunk_id, score, rank FROM top WHERE rank <= 3
UNION ALL SELECT qkey, source, chunk_id, NULL, rank FROM talk CROSS JOIN listed WHERE role = 'system'""")
oracle("chunk_index", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate,
       i AS row_index, i // 5 AS chunk_id
FROM (SELECT {LINE_KEYS}, row_number() OVER (ORDER BY {LINE_KEYS}) - 1 AS i FROM lineitem)""")
oracle("history_ranked", f"""WITH {QUERY_LOG}, dated AS (SELECT *, strftime(created_at, '%Y-%m-%d') AS date FROM query_log)
SELECT query_id, user_code, date, row_number() OVER (PARTITION BY user_code, date ORDER BY created_at DESC, query_id) AS place FROM dated""")
_LABEL = """CASE WHEN CAST(created_at AS DATE) = DATE '2025-05-03' THEN 'Today'
  WHEN CAST(created_at AS DATE) = DATE '2025-05-02' THEN 'Yesterday' ELSE strftime(created_at, '%Y-%m-%d') END"""


def preview(text: str) -> str:
    """First five words, with an ellipsis when there are more."""
    return f"array_to_string(list_slice({words(text)}, 1, 5), ' ') || CASE WHEN len({words(text)}) > 5 THEN '...' ELSE '' END"


oracle("history_panel", f"""WITH {QUERY_LOG}
SELECT query_id, user_code, {_LABEL} AS label, {preview('query_text')} AS preview,
       row_number() OVER (PARTITION BY user_code, CAST(created_at AS DATE) ORDER BY created_at DESC, query_id) AS place
FROM query_log WHERE conv_id % 5 <> 0""")
oracle("chart_line", f"""SELECT strftime(o_orderdate, {ISO}) AS o_orderdate, o_totalprice, o_orderpriority,
       row_number() OVER (ORDER BY orders.o_orderdate, o_totalprice, o_orderpriority) - 1 AS position FROM orders""")
oracle("chart_scatter", "SELECT p_size, p_retailprice, p_brand FROM part")
oracle("result_preview", """WITH result AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey)
SELECT 'head' AS part, * FROM (SELECT * FROM result ORDER BY o_custkey LIMIT 5)
UNION ALL SELECT 'tail' AS part, * FROM (SELECT * FROM result ORDER BY o_custkey DESC LIMIT 5)
WHERE o_custkey NOT IN (SELECT o_custkey FROM result ORDER BY o_custkey LIMIT 5)""")
oracle("store_samples", f"""WITH {CHUNKS}
SELECT table_name, chunk_id, CASE WHEN length(chunk_text) > 300 THEN substr(chunk_text, 1, 300) || '...' ELSE chunk_text END AS sample_text
FROM chunks ORDER BY table_name, chunk_id LIMIT 2""")
oracle("store_vector_samples", """SELECT CAST(label AS VARCHAR) AS table_name, vec_id AS chunk_id,
       array_to_string(list_transform(list_slice(CAST(embedding AS DOUBLE[]), 1, 20), lambda x: CAST(CAST(round(x, 6) AS DECIMAL(18,6)) AS VARCHAR)), ', ') AS leading_values,
       CAST(len(embedding) - 20 AS INTEGER) AS n_more
FROM embeddings ORDER BY CAST(label AS VARCHAR), vec_id LIMIT 1""")

# ---- unions

oracle("chunk_union", f"WITH {CHUNKS} SELECT * FROM chunks")
oracle("hits_union", f"WITH {CHUNK_SCORES}, {TOP_PER_SOURCE} SELECT * FROM top WHERE rank <= 3")
oracle("messages_union", f"""WITH {QUERY_LOG}
SELECT 'user' AS role, query_text AS content, query_id AS id, strftime(created_at, {ISO}) AS created_at FROM query_log
UNION ALL SELECT role, text, 'r-' || conv_id || '-' || turn, NULL FROM conversations WHERE role = 'assistant'""")

# ---- scalar functions

oracle("row_to_text", f"SELECT o_orderkey, {row_text(ORDERS)} AS row_text FROM orders")
oracle("chunk_text", data_chunks("orders", ORDERS))
oracle("chunk_any_schema", """SELECT CAST(i // 5 AS BIGINT) AS chunk_id, 'data' AS kind,
  'Data chunk:' || chr(10) || string_agg(t, chr(10) ORDER BY i) || chr(10) AS chunk_text
FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, 'part.key: ' || p_partkey || ' | sizes: {' || p_brand || ' -> ' || p_size || '} | types: ['
      || p_type || '] | box: {' || p_size || ', ' || p_brand || '}' AS t FROM part) GROUP BY i // 5""")
oracle("schema_chunk", f"SELECT table_name AS case_name, chunk_id, kind, chunk_text FROM ({_each(schema_chunk)})")
oracle("stats_chunk", f"SELECT table_name AS case_name, chunk_id, kind, chunk_text FROM ({_each(stats_chunks)})")
oracle("cosine", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
oracle("l2_norm", """SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings""")
oracle("extract_sql", f"WITH {RESPONSES} SELECT query_id, sql_query FROM parsed")
oracle("token_count", f"SELECT doc_id, CAST(len({words('text')}) AS INTEGER) AS n_tokens FROM documents")
oracle("text_preview", f"SELECT doc_id, {preview('text')} AS preview FROM documents")
oracle("relative_date", f"WITH {QUERY_LOG} SELECT query_id, {_LABEL} AS label FROM query_log")
oracle("ts_parts", f"""SELECT event_id, strftime(ts, {ISO}) AS iso, strftime(ts, '%Y-%m-%d') AS day,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS log_time, true AS parsed_back FROM events""")
oracle("json_codec", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.k') AS k_text,
       CAST(to_json([event_type, CAST(user_id AS VARCHAR)]) AS VARCHAR) AS encoded, event_type AS decoded FROM events""")
oracle("make_ids", """SELECT conv_id, turn, 'q-' || sha256(conv_id || chr(31) || turn) AS query_id,
       'r-' || sha256(conv_id || chr(31) || turn) AS response_id, 'conversations_' || conv_id || '_' || turn AS record_id FROM conversations""")
oracle("query_dedup", f"""WITH {QUERY_LOG}
SELECT sha256(query_text) AS query_hash, count(*) AS n_queries, min(query_id) AS first_query_id FROM query_log GROUP BY 1""")
oracle("context_assemble", f"""WITH {DOC_SCORES}, {TOP_OVERALL}
SELECT query_id, string_agg('From ' || top.source || ': ' || text, chr(10) ORDER BY rank) AS context
FROM top JOIN documents ON doc_id = chunk_id WHERE rank <= 3 GROUP BY query_id""")
_TABLE_INFO = f"""WITH {ROUTED}, schema_rows AS ({SCHEMA_ROWS}), lines AS (
  SELECT table_name AS source, 'Table ' || table_name || ': Columns: ' || %s AS line
  FROM schema_rows GROUP BY table_name)
SELECT query_id, string_agg(line, chr(10) ORDER BY source) AS table_info FROM routed JOIN lines USING (source) GROUP BY query_id""".replace("% ", "%% ")
oracle("table_info", _TABLE_INFO % "string_agg(column_name, ', ' ORDER BY ordinal)")
oracle("relationship_info", f"""WITH {ROUTED}, lines(source, position, line) AS (VALUES
  ('customer', 0, 'Relationship: CUSTOMER INNER JOIN nation ON CUSTOMER.c_nationkey = nation.n_nationkey'),
  ('customer', 1, 'Relationship: CUSTOMER INNER JOIN supplier ON CUSTOMER.c_nationkey = supplier.s_nationkey'),
  ('supplier', 0, 'Relationship: supplier INNER JOIN lineitem ON supplier.s_suppkey = lineitem.l_suppkey'),
  ('part', 0, 'Relationship: part INNER JOIN lineitem ON part.p_partkey = lineitem.l_partkey'))
SELECT query_id, string_agg(line, chr(10) ORDER BY source, position) AS relationship_info FROM routed JOIN lines USING (source) GROUP BY query_id""")
oracle("question_inputs", f"""SELECT query_id, coalesce(context, '') AS context, coalesce(table_info, '') AS table_info, coalesce(relationship_info, '') AS relationship_info
FROM ({ORACLES["context_assemble"]}) FULL JOIN ({_TABLE_INFO % "string_agg(column_name || ' (' || column_type || ')', ', ' ORDER BY ordinal)"}) USING (query_id)
FULL JOIN ({ORACLES["relationship_info"]}) USING (query_id)""")
oracle("response_text", f"""WITH {RESPONSES}, classed AS (SELECT *, {_OUTCOME} AS outcome FROM parsed)
SELECT query_id, outcome, CASE outcome
         WHEN 'sql_rows' THEN CASE WHEN length(response_text) % 2 = 0
           THEN 'SQL Query:' || chr(10) || '```sql' || chr(10) || sql_query || chr(10) || '```' || chr(10) ELSE '' END
           || response_text || chr(10) || chr(10) || 'Detailed results:' || chr(10)
         WHEN 'sql_empty' THEN 'No results found.'
         ELSE response END AS logged_text
FROM classed""")
oracle("created_default", f"""WITH {QUERY_LOG}
SELECT query_id AS id, strftime(created_at, {ISO}) AS created_at FROM query_log
UNION ALL SELECT response_id, '2025-05-04T12:00:00.000000' FROM query_log""")

# ---- streams

oracle("stream_token_daily", f"""WITH {TOKENS}
SELECT substr(timestamp, 1, 10) AS day, count(*) AS n_turns, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, max(total_tokens) AS max_tokens
FROM token_lines GROUP BY 1""")
oracle("stream_log_dedup", f"""WITH {QUERY_LOG}
SELECT query_id, response_id, user_code, plant_code, strftime(created_at, {ISO}) AS created_at FROM query_log""")
oracle("stream_embed_missing", f"""WITH once AS (SELECT source, min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents GROUP BY source, text),
{weights('d', 'documents', 'doc_id', 'text')}, {components('d', 'doc_id')}
SELECT source || '_' || doc_id AS record_id, source AS table_name, doc_id AS chunk_id, content_hash, CAST({DIMS} AS INTEGER) AS n_dims,
       coalesce(components, '') AS components FROM once LEFT JOIN d_components USING (doc_id)""")

# ---- embedding functions and routing

_DOC_WEIGHTS = f"""WITH {weights('d', 'documents', 'doc_id', 'text')}
SELECT doc_id, bucket, round(weight, 6) AS weight FROM d_weights"""
oracle("embed_batches", _DOC_WEIGHTS)
oracle("embed_hashed", _DOC_WEIGHTS)
oracle("cosine_sparse", f"""WITH {QUERY_LOG}, {weights('a', 'query_log', 'query_id', 'query_text')}, {weights('b', 'query_log', 'query_id', 'response_text')}
SELECT query_id, round(sum(a_weights.weight * b_weights.weight), 6) AS score
FROM a_weights JOIN b_weights USING (query_id, bucket) GROUP BY query_id""")
oracle("sparse_pairs", f"""WITH {QUERY_LOG}, talk AS (SELECT conv_id || '-' || turn AS turn_id, text FROM conversations),
{weights('a', 'query_log', 'query_id', 'query_text')}, {weights('b', 'talk', 'turn_id', 'text')}
SELECT query_id, turn_id, round(sum(a_weights.weight * b_weights.weight), 6) AS score
FROM a_weights JOIN b_weights USING (bucket) GROUP BY query_id, turn_id HAVING round(sum(a_weights.weight * b_weights.weight), 6) >= 0.9""")
oracle("route_tables", f"WITH {ROUTED} SELECT * FROM routed")
