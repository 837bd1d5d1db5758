"""Relational operators that are plain SQL: one declarative plan each.

The text names its tables in braces; the registry binds them to DataFrames (and,
for the comparison, to the same tables elsewhere).  Costs, limits and prices are
fixed values of the operators' defaults.
"""

PLANS: dict[str, str] = {
    # scans and table maintenance
    "load_text": "SELECT CAST(doc_id AS STRING) AS document_id, text, source, '' AS source_url FROM {documents} WHERE trim(text) <> ''",
    "read_relational_store": "SELECT conv_id AS session_id, turn AS message_id, role, text AS content FROM {conversations}",
    "scan_index_to_chunks": "SELECT doc_id, source, text FROM {documents} WHERE text IS NOT NULL AND trim(text) <> ''",
    "index_stats": "SELECT count(*) AS vectors, CAST(max(cardinality(embedding)) AS BIGINT) AS dimension, count(*) > 0 AS ok FROM {embeddings}",
    "delete_document": "SELECT d.doc_id, d.source FROM {documents} d LEFT ANTI JOIN {labels} l ON d.doc_id = l.doc_id AND l.toxic = 1",
    "replace_document": """WITH incoming AS (SELECT item_id AS doc_id, text FROM {benchmark}) SELECT doc_id, text FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM incoming i WHERE i.doc_id = d.doc_id) UNION ALL SELECT doc_id, text FROM incoming""",
    # filters
    "doc_scope_filter": """SELECT doc_id, source FROM {documents} WHERE lower(trim(coalesce(source, ''))) NOT IN ('src0', 'src1')""",
    "exclude_paths": """SELECT page_id, url FROM (SELECT page_id, url, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM {pages}) x
WHERE path NOT IN ('/sitemap') AND path NOT LIKE '/webinar-recordings/%' AND path NOT LIKE '/es/%' AND lower(path) NOT LIKE '%espanol%'""",
    "question_subset": """SELECT b.item_id, b.text FROM {benchmark} b WHERE b.item_id IN (SELECT doc_id FROM {labels} WHERE quality = 1) OR NOT EXISTS (SELECT 1 FROM {labels} WHERE quality = 1)""",
    "response_validation": """SELECT conv_id, turn, n BETWEEN 10 AND 5000 AS valid, CASE WHEN n < 10 THEN 'too short' WHEN n > 5000 THEN 'too long' ELSE '' END AS errors
FROM (SELECT conv_id, turn, role, length(coalesce(text, '')) AS n FROM {conversations}) x WHERE role = 'assistant'""",
    "context_limit_status": """SELECT conv_id, n_tokens, CASE WHEN n_tokens >= 100000 THEN 'block' WHEN n_tokens >= 90000 THEN 'warn' ELSE 'ok' END AS status
FROM (SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS n_tokens FROM {conversations} GROUP BY conv_id) t""",
    "needs_refetch_filter": """SELECT page_id, status FROM (SELECT page_id, CASE WHEN html IS NULL THEN 'error' WHEN length(html) < 1000 THEN 'static_failed' WHEN html NOT LIKE '%</article>%' THEN 'incomplete' ELSE 'ok' END AS status FROM {pages}) t
WHERE status IN ('static_failed', 'incomplete', 'error')""",
    # joins
    "article_context": "SELECT s.s_suppkey, n.n_name AS section, r.r_name AS category FROM {supplier} s LEFT JOIN {nation} n ON s.s_nationkey = n.n_nationkey LEFT JOIN {region} r ON n.n_regionkey = r.r_regionkey",
    "customer_order_totals": "SELECT c.c_custkey, c.c_name, count(o.o_orderkey) AS n_orders, round(coalesce(sum(o.o_totalprice), 0), 2) AS total FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey, c.c_name",
    "open_ticket_report": "SELECT o.o_orderkey, c.c_name, o.o_orderpriority FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'O' AND o.o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "keyed_lookup_with_default": """WITH times AS (SELECT '1-URGENT' AS priority, '1 hour' AS response_time UNION ALL SELECT '2-HIGH', '4 hours' UNION ALL SELECT '3-MEDIUM', '1 day')
SELECT o_orderkey, coalesce(t.response_time, '3 days') AS response_time FROM {orders} o LEFT JOIN times t ON t.priority = o.o_orderpriority""",
    "title_backfill": """SELECT c.conv_id, c.turn, coalesce(nullif(nullif(trim(d.source), ''), CAST(d.doc_id AS STRING)), CAST(c.conv_id AS STRING)) AS title FROM {conversations} c LEFT JOIN {documents} d ON d.doc_id = c.conv_id""",
    "stale_files": """SELECT p.page_id FROM {pages} p LEFT ANTI JOIN (SELECT DISTINCT lower(regexp_replace(link, '^.*/', '')) AS base FROM (SELECT explode(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM {pages}) x) l
ON l.base = lower(regexp_extract(regexp_replace(regexp_extract(p.url, '://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1))""",
    "question_set_drift": """WITH old AS (SELECT text FROM {benchmark} WHERE length(text) > 80), new AS (SELECT text FROM {benchmark} WHERE length(text) < 200)
SELECT 'missing' AS kind, text FROM (SELECT text FROM old EXCEPT SELECT text FROM new) a UNION ALL SELECT 'extra', text FROM (SELECT text FROM new EXCEPT SELECT text FROM old) b""",
    "before_after_checks": """WITH b AS (SELECT lang AS name, avg(CAST(quality AS DOUBLE)) AS rate FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id WHERE lang IS NOT NULL AND toxic = 0 GROUP BY lang),
a AS (SELECT lang AS name, avg(CAST(quality AS DOUBLE)) AS rate FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id WHERE lang IS NOT NULL AND toxic = 1 GROUP BY lang)
SELECT coalesce(b.name, a.name) AS name, round(b.rate, 4) AS before_rate, round(a.rate, 4) AS after_rate, round(a.rate - b.rate, 4) AS delta FROM b FULL OUTER JOIN a ON a.name = b.name WHERE EXISTS (SELECT 1 FROM a) AND EXISTS (SELECT 1 FROM b)""",
    # aggregates
    "sum_tokens_since": "SELECT conv_id, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS tokens, count(*) AS turns FROM {conversations} WHERE role = 'assistant' AND turn >= 1 GROUP BY conv_id",
    "month_to_date_spend": """SELECT spend, budget, CASE WHEN budget > 0 THEN round(100 * spend / budget, 1) END AS pct, CASE WHEN budget <= 0 THEN 'info' WHEN spend >= budget THEN 'over' WHEN spend >= CAST(0.8 AS DOUBLE) * budget THEN 'warn' ELSE 'ok' END AS level
FROM (SELECT round(coalesce(sum(value), 0), 4) AS spend, CAST(1000 AS DOUBLE) AS budget FROM {events} WHERE ts >= date_trunc('month', TIMESTAMP '2024-01-31 00:00:00') AND ts <= TIMESTAMP '2024-01-31 00:00:00') t""",
    "metric_series_total": """SELECT event_type, CASE WHEN event_type = 'purchase' THEN 'gauge' ELSE 'counter' END AS kind, CASE WHEN event_type = 'purchase' THEN round(max(CASE WHEN back = 1 THEN value END), 4) ELSE round(sum(value), 4) END AS total,
count(*) AS points FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back FROM {events}) t GROUP BY event_type""",
    "usage_meters": """SELECT user_id, used, cap, CASE WHEN cap > 0 THEN round(100 * used / cap, 1) END AS pct, CASE WHEN cap IS NULL OR cap <= 0 THEN 'info' WHEN used / cap >= 1 THEN 'over' WHEN used / cap >= CAST(0.8 AS DOUBLE) THEN 'warn' ELSE 'ok' END AS level
FROM (SELECT user_id, round(sum(value), 3) AS used, CAST(nullif(max(CASE WHEN event_type = 'purchase' THEN 500 ELSE 0 END), 0) AS DOUBLE) AS cap FROM {events} GROUP BY user_id) t""",
    "worst_level": """SELECT event_type, CASE max(CASE WHEN value >= 100 THEN 3 WHEN value >= 80 THEN 2 WHEN value IS NULL THEN 1 ELSE 0 END) WHEN 3 THEN 'over' WHEN 2 THEN 'warn' WHEN 1 THEN 'info' ELSE 'ok' END AS level FROM {events} GROUP BY event_type""",
    "check_pass_rates": """SELECT name, count(*) FILTER (WHERE passed) AS n_passed, count(*) FILTER (WHERE NOT passed) AS n_failed, round(avg(CAST(CASE WHEN passed THEN 1 ELSE 0 END AS DOUBLE)), 4) AS rate
FROM (SELECT 'quality' AS name, quality = 1 AS passed FROM {labels} UNION ALL SELECT 'clean', toxic = 0 FROM {labels} UNION ALL SELECT 'all_passed', quality = 1 AND toxic = 0 FROM {labels}) t GROUP BY name""",
    "check_summary_table": """SELECT 'all_checks' AS name, count(*) AS total, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS n_passed FROM {labels}
UNION ALL SELECT 'quality', count(*), count(*) FILTER (WHERE quality = 1) FROM {labels} UNION ALL SELECT 'clean', count(*), count(*) FILTER (WHERE toxic = 0) FROM {labels}""",
    "failure_taxonomy": """SELECT failure, n, examples, row_number() OVER (ORDER BY n DESC, failure) AS place FROM (SELECT CASE WHEN toxic = 1 THEN 'toxic' ELSE 'low quality' END AS failure, count(*) AS n, min(doc_id) AS examples
FROM {labels} WHERE toxic = 1 OR quality = 0 GROUP BY CASE WHEN toxic = 1 THEN 'toxic' ELSE 'low quality' END) t""",
    "span_totals": "SELECT user_id, event_type, round(sum(value), 4) AS total_ms FROM {events} GROUP BY user_id, event_type",
    "span_pivot_report": """SELECT user_id, round(sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END), 4) AS click, round(sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END), 4) AS view_ms, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4) AS purchase,
round(avg(CASE WHEN event_type <> 'error' THEN value END), 4) AS mean_ms FROM {events} GROUP BY user_id""",
    "running_context_size": """SELECT user_id, event_id, total FROM (SELECT user_id, event_id, total, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, ts DESC, event_id DESC) AS place
FROM (SELECT user_id, event_id, ts, coalesce(CASE WHEN event_type <> 'error' THEN value END, length(event_type) + length(coalesce(props, ''))) AS total FROM {events}) u) t WHERE place = 1""",
    "crawl_summary": """SELECT status, n, sum(n) OVER () AS pages, CAST(floor(words / greatest(n, 1)) AS BIGINT) AS mean_length FROM (SELECT status, count(*) AS n, CAST(sum(size) AS BIGINT) AS words FROM (SELECT CASE WHEN html IS NULL THEN 'error'
WHEN html LIKE '%<article>%' THEN 'ok' ELSE 'static_failed' END AS status, coalesce(length(html), 0) AS size FROM {pages}) t GROUP BY status) u""",
    "distinct_sources": "SELECT source, min(doc_id) AS first_seen FROM {documents} WHERE source IS NOT NULL AND source <> '' GROUP BY source",
    # windows and metering
    "tool_call_cap": "SELECT event_id, user_id, call_no, call_no > 3 AS over_cap FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS call_no FROM {events}) t",
    "history_window": """SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'model' ELSE role END AS role, text FROM (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back
FROM {conversations} WHERE trim(text) <> '') t WHERE back <= 10""",
    "turns_from_messages": """SELECT conv_id, turn, question, answer FROM (SELECT conv_id, min(CASE WHEN role = 'user' THEN turn END) AS turn, min(CASE WHEN role = 'user' THEN text END) AS question, min(CASE WHEN place = 1 THEN text END) AS answer FROM
(SELECT conv_id, turn, role, text, island, CASE WHEN role <> 'user' AND trim(text) <> '' THEN row_number() OVER (PARTITION BY conv_id, island, role <> 'user' AND trim(text) <> '' ORDER BY turn) END AS place FROM
(SELECT conv_id, turn, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM {conversations}) a) b WHERE island > 0 GROUP BY conv_id, island) c WHERE answer IS NOT NULL""",
    "latency_attribution": """SELECT user_id, span, CAST(sum(delta) AS BIGINT) AS micros FROM (SELECT user_id, lag(event_type) OVER w AS span,
unix_micros(CAST(ts AS TIMESTAMP)) - lag(unix_micros(CAST(ts AS TIMESTAMP))) OVER w AS delta FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) t WHERE span IS NOT NULL GROUP BY user_id, span""",
    "estimate_usd": """SELECT event_id, round((prompt * CAST(0.5 AS DOUBLE) + (total - prompt) * CAST(1.5 AS DOUBLE)) / 1000000, 9) AS usd FROM (SELECT event_id, CASE WHEN prompt > 0 THEN least(prompt, total) ELSE floor(total * CAST(0.8 AS DOUBLE)) END AS prompt, total
FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN 0 ELSE value END AS prompt, greatest(CASE WHEN event_type = 'click' THEN 0 ELSE value END, value * 10) AS total FROM {events}) t) u""",
    "unit_to_gb": "SELECT event_id, CASE event_type WHEN 'click' THEN value / 1000000000 WHEN 'view' THEN value / 1000000 ELSE value / 1000 END AS gb FROM {events}",
    "storage_estimate": "SELECT label, CAST(count(*) * (4 * max(cardinality(embedding)) + 256) AS BIGINT) AS bytes FROM {embeddings} GROUP BY label",
    "month_period": """SELECT event_id, date_trunc('month', ts) AS month_start, substr(CAST(ts AS STRING), 1, 7) AS label FROM {events}""",
    "telemetry_events": """SELECT event_id, coalesce(nullif(trim(substr(event_type, 1, 64)), ''), '-') AS name, coalesce(nullif(trim(substr(CAST(user_id AS STRING), 1, 64)), ''), '-') AS install, coalesce(nullif(trim(substr(CAST(value AS STRING), 1, 32)), ''), '-') AS amount,
coalesce(nullif(trim(substr(props, 1, 500)), ''), '-') AS detail FROM {events}""",
    "latency_score": "SELECT event_id, CASE WHEN value < 3 THEN 1.0 ELSE 0.0 END AS score FROM {events}",
    "query_analysis": """SELECT conv_id, turn, length(text) AS n_chars, length(trim(text)) - length(replace(trim(text), ' ', '')) + CASE WHEN trim(text) = '' THEN 0 ELSE 1 END AS n_words,
text LIKE '%?%' AS is_question FROM (SELECT conv_id, turn, role, regexp_replace(replace(replace(text, chr(10), ' '), chr(9), ' '), '( )+', ' ') AS text FROM {conversations}) x WHERE role = 'user'""",
    "classify_ticket": """SELECT conv_id, turn, CASE WHEN t LIKE '%error%' OR t LIKE '%bug%' OR t LIKE '%crash%' OR t LIKE '%not working%' OR t LIKE '%broken%' THEN 'technical'
WHEN t LIKE '%bill%' OR t LIKE '%charge%' OR t LIKE '%payment%' OR t LIKE '%invoice%' OR t LIKE '%refund%' THEN 'billing' ELSE 'general' END AS team FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM {conversations}) x""",
    "truncate_text": "SELECT doc_id, CASE WHEN length(text) > 2400 THEN substr(text, 1, 2400) || '...' ELSE text END AS text FROM {documents}",
    "upsert_memory": """SELECT user_id, props FROM (SELECT user_id, props, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM {events} WHERE trim(coalesce(props, '')) <> '') t WHERE back = 1 AND event_type <> 'error'""",
    "persist_turns": """SELECT conv_id, coalesce(max(CASE WHEN first_place = 1 THEN substr(text, 1, 100) END), 'New chat') AS title, count(*) AS n_messages, max(CASE WHEN back = 1 THEN length(coalesce(text, '')) END) AS token_count FROM
(SELECT conv_id, role, text, CASE WHEN role = 'user' AND trim(coalesce(text, '')) <> '' THEN row_number() OVER (PARTITION BY conv_id, role = 'user' AND trim(coalesce(text, '')) <> '' ORDER BY turn) END AS first_place, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM {conversations}) t GROUP BY conv_id""",
    # pages, spans and scores
    "page_metadata": """SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''), CAST(page_id AS STRING)) AS title, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host,
regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '://[^/?#]*/([^/?#]*)', 1) AS section,
trim(regexp_extract(html, '<meta name="description" content="([^"]*)"', 1)) AS description FROM {pages}""",
    "slug_collision_ids": """SELECT page_id, CASE WHEN count(*) OVER (PARTITION BY slug) > 1 THEN slug || '-' || CAST(page_id AS STRING) ELSE slug END AS file_id
FROM (SELECT page_id, coalesce(nullif(lower(regexp_extract(url, '://[^/?#]*/([^/?#]*)', 1)), ''), 'home') AS slug FROM {pages}) t""",
    "write_page_manifest": """WITH m AS (SELECT page_id, url, CASE WHEN html IS NULL THEN 'error' WHEN html LIKE '%<article>%' THEN 'ok' ELSE 'static_failed' END AS status FROM {pages})
SELECT 'page' AS kind, page_id, url, CASE WHEN status <> 'error' THEN CAST(page_id AS STRING) || '.md' END AS filename, status, CAST(1 AS BIGINT) AS pages FROM m
UNION ALL SELECT 'total', NULL, NULL, NULL, status, count(*) FROM m GROUP BY status""",
    "timing_sort": "SELECT event_id, event_type, value AS ms FROM {events} ORDER BY value DESC, event_id",
    "id_set_overlap": """WITH p AS (SELECT conv_id, turn, role, array_distinct(regexp_extract_all(lower(text), '[a-z0-9]+', 0)) AS words FROM {conversations}),
n AS (SELECT conv_id, turn, role, words, lead(words) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM p)
SELECT conv_id, turn, round(least(CAST(1 AS DOUBLE), CAST(array_size(array_intersect(words, answer)) AS DOUBLE) / greatest(array_size(words), 1)), 4) AS overlap FROM n WHERE role = 'user' AND answer IS NOT NULL""",
}
#: Where the other engine spells a thing differently.
SPELLING = {"explode(": "unnest(", "array_size(": "len(", "cardinality(embedding)": "len(embedding)", "LEFT ANTI JOIN": "ANTI JOIN", "unix_micros(CAST(ts AS TIMESTAMP))": "epoch_us(ts)"}
