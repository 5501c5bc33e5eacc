"""Registered feed-monitoring (P), audit/log (L) and cluster (O) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.quantities import cpu_cores, memory_bytes
from quarry.operators import audit as au
from quarry.operators import cluster as cl
from quarry.operators import monitoring as mo
from quarry.plans import fixtures as fx
from quarry.plans.registry import query


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_values(rows) -> str:
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else repr(v)
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


FEEDS = """
feeds AS (
  SELECT event_type AS name, ts AS last_refresh, value AS latency,
         CAST(event_id % 7 = 0 AS INTEGER) AS errors
  FROM events),
thresholds AS (
  SELECT * FROM (VALUES """ + _sql_values(fx.THRESHOLD_ROWS) + """) AS t(name, warning, critical)),
feeds_th AS (
  SELECT f.*, coalesce(t.warning, 5) AS warning, coalesce(t.critical, 10) AS critical
  FROM feeds f LEFT JOIN thresholds t USING (name))"""

FEED_NAMES = ["click", "error", "purchase", "signup", "view"]


@query("feed_rows", "WITH" + FEEDS + " SELECT name, last_refresh, latency, errors FROM feeds", ["latency"])
def feed_rows(t):
    """Typed status rows."""
    return mo.feed_rows(fx.v_feeds(t))


@query("feed_thresholds", "WITH" + FEEDS + " SELECT DISTINCT name, warning, critical FROM feeds_th")
def feed_thresholds(t):
    """Thresholds per name, 5/10 by default."""
    return mo.feed_thresholds(fx.v_feeds(t), fx.v_thresholds(t))


@query(
    "feed_kpis",
    "WITH" + FEEDS + """
    SELECT count(*) AS total, CAST(sum(errors) AS BIGINT) AS error_sum,
           CAST(count_if(errors > 0) AS BIGINT) AS failing_rows,
           CAST(count_if(latency > critical) AS BIGINT) AS high_latency_rows,
           avg(latency) AS avg_latency
    FROM feeds_th""",
    ["avg_latency"],
)
def feed_kpis(t):
    """P3."""
    return mo.feed_kpis(fx.v_feeds(t), fx.v_thresholds(t))


@query(
    "feed_status",
    "WITH" + FEEDS + """
    SELECT name, last_refresh, latency, errors,
           CASE WHEN latency > critical THEN 'red' WHEN latency > warning THEN 'orange' ELSE 'green' END AS status,
           CASE WHEN errors > 0 THEN 'red' ELSE 'green' END AS error_status
    FROM feeds_th""",
    ["latency"],
)
def feed_status(t):
    """P4."""
    return mo.feed_status(fx.v_feeds(t), fx.v_thresholds(t))


RECENT_SECONDS = 3600


@query(
    "recent_errors",
    "WITH" + FEEDS + f"""
    SELECT * FROM feeds
    WHERE last_refresh >= (SELECT max(last_refresh) FROM feeds) - to_seconds({RECENT_SECONDS})""",
    ["latency"],
)
def recent_errors(t):
    """P5: rows of the last hour before the latest row."""
    return mo.recent_errors(fx.v_feeds(t), seconds=RECENT_SECONDS)


@query("latency_trend", "WITH" + FEEDS + " SELECT last_refresh AS time, name, latency FROM feeds", ["latency"])
def latency_trend(t):
    """P6."""
    return mo.latency_trend(fx.v_feeds(t))


@query(
    "latency_heatmap",
    "WITH" + FEEDS + " SELECT date_trunc('day', last_refresh) AS time, "
    + ", ".join(f"max(latency) FILTER (WHERE name = '{n}') AS \"{n}\"" for n in FEED_NAMES)
    + " FROM feeds GROUP BY 1",
    FEED_NAMES,
)
def latency_heatmap(t):
    """Day x feed -> max latency."""
    return mo.latency_heatmap(fx.v_feeds(t))


@query("feed_names", "SELECT DISTINCT event_type AS name FROM events")
def feed_names(t):
    """P8."""
    return mo.feed_names(fx.v_feeds(t))


@query(
    "runs_since_midnight",
    """
    WITH runs AS (
      SELECT event_id AS run_id, event_type AS pipeline_name,
             """ + _sql_list(fx.RUN_STATUS) + """[event_id % 4 + 1] AS status, ts AS start_time
      FROM events),
    ref AS (SELECT max(start_time) AS as_of FROM runs)
    SELECT run_id, pipeline_name, status, start_time,
           date_diff('microsecond', start_time, as_of) / CAST(60e6 AS DOUBLE) AS minutes,
           CASE WHEN status = 'STARTED' AND date_diff('microsecond', start_time, as_of) / CAST(60e6 AS DOUBLE) > 60 THEN 'long-running'
                WHEN status = 'STARTED' THEN 'running'
                WHEN status = 'SUCCESS' THEN 'success'
                WHEN status = 'FAILURE' THEN 'failed'
                ELSE 'status: ' || status END AS state
    FROM runs, ref
    WHERE start_time >= date_trunc('day', as_of)""",
    ["minutes"],
)
def runs_since_midnight(t):
    """P9."""
    return mo.run_states(fx.v_runs(t))


@query(
    "stream_freshness",
    """
    WITH entries AS (
      SELECT event_type AS stream, CAST(epoch_us(ts) // 1000 AS VARCHAR) || '-' || CAST(event_id AS VARCHAR) AS entry_id
      FROM events),
    streams AS (SELECT DISTINCT event_type AS stream FROM events UNION ALL SELECT 'empty'),
    tips AS (SELECT stream, max(CAST(split_part(entry_id, '-', 1) AS BIGINT)) AS ms FROM entries GROUP BY 1),
    ref AS (SELECT max(epoch_ms(CAST(split_part(entry_id, '-', 1) AS BIGINT))) AS as_of FROM entries)
    SELECT s.stream, epoch_ms(tips.ms) AS latest_event_time, ref.as_of AS current_time,
           date_diff('microsecond', epoch_ms(tips.ms), ref.as_of) / CAST(1e6 AS DOUBLE) AS lag_seconds
    FROM streams s LEFT JOIN tips USING (stream), ref""",
    ["lag_seconds"],
)
def stream_freshness(t):
    """P10."""
    return mo.stream_freshness(fx.v_streams(t), fx.v_stream_entries(t))


@query(
    "rule_breaches",
    """
    WITH rules AS (
      SELECT * FROM (VALUES """ + _sql_values(fx.RULES) + """) AS r(name, value, text_value, category_filter)),
    metrics AS (
      SELECT event_id, """ + _sql_list([r[0] for r in fx.RULES]) + """[event_id % 18 + 1] AS name,
             value / 100 AS value,
             CASE WHEN event_id % 4 = 3 THEN 'touched ' || event_type ELSE 'quiet' END AS text,
             """ + _sql_list(fx.CATEGORIES) + """[user_id % 3 + 1] AS category
      FROM events)
    SELECT m.name, m.value, m.text, m.category, CAST(r.value AS DOUBLE) AS rule_value, r.text_value AS rule_text,
           NOT (length(regexp_extract(r.category_filter, '^\\(not in\\)\\s*(.*)$', 1)) > 0
                AND m.category = regexp_extract(r.category_filter, '^\\(not in\\)\\s*(.*)$', 1))
           AND CASE WHEN coalesce(length(r.text_value), 0) > 0
                    THEN coalesce(regexp_full_match(m.text, r.text_value), false)
                    ELSE m.value > r.value END AS breach
    FROM metrics m JOIN rules r USING (name)""",
    ["value", "rule_value"],
)
def rule_breaches(t):
    """P11."""
    return mo.rule_breaches(fx.v_metrics(t).drop("event_id"), fx.v_rules(t))


# --- L -----------------------------------------------------------------------

LOG_LINES = """
lines AS (
  SELECT 'pod-' || CAST(user_id AS VARCHAR) AS file, event_id AS line_no,
         strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' ' || upper(event_type) || ' ' || props AS line
  FROM events)"""

AUDIT = """
audit AS (
  SELECT ts AS event_time, 'user_' || CAST(user_id AS VARCHAR) AS "user",
         '10.0.0.' || CAST(user_id % 16 AS VARCHAR) AS address,
         'host-' || CAST(user_id % 7 AS VARCHAR) AS client_hostname,
         'SELECT ' || event_type || ' FROM ' || CASE WHEN event_id % 3 = 0 THEN 'sample_table' ELSE 'other_table' END AS query,
         'db.' || event_type AS table_name, CAST(floor(value * 100) AS BIGINT) AS read_rows,
         CAST(event_id % 5 + 1 AS INTEGER) AS read_parts,
         CASE WHEN event_id % 6 = 0 THEN 'ExceptionWhileProcessing' ELSE 'QueryFinish' END AS type,
         CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts + INTERVAL 1 HOUR END AS logout_time
  FROM events)"""


@query(
    "error_scan",
    "WITH" + LOG_LINES + """
    SELECT file, bool_or(regexp_matches(line, '(error|exception|failed|traceback)', 'i')) AS has_error,
           min(line_no) FILTER (WHERE regexp_matches(line, '(error|exception|failed|traceback)', 'i')) AS first_hit_line_no,
           arg_min(line, line_no) FILTER (WHERE regexp_matches(line, '(error|exception|failed|traceback)', 'i')) AS first_hit
    FROM lines GROUP BY file""",
)
def error_scan(t):
    """L1."""
    return au.error_scan(fx.v_log_lines(t))


TAIL_N = 20


@query(
    "tail_lines",
    "WITH" + LOG_LINES + f"""
    SELECT file, line_no, line FROM (
      SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no DESC) AS rn FROM lines)
    WHERE rn <= {TAIL_N}""",
)
def tail_lines(t):
    """L2: last 20 lines of every file."""
    return au.tail_lines(fx.v_log_lines(t), TAIL_N)


@query(
    "name_contains",
    "WITH" + LOG_LINES + """
    SELECT file, count(*) AS lines FROM lines WHERE contains(file, 'pod-1') GROUP BY file""",
)
def name_contains(t):
    """L3: sources whose name contains 'pod-1', with their line counts."""
    files = fx.v_log_lines(t).groupBy("file").agg(F.count(F.lit(1)).alias("lines"))
    return au.name_contains(files, "pod-1")


@query(
    "user_address_activity",
    "WITH" + AUDIT + """
    SELECT "user", address, count(*) AS queries, min(event_time) AS first_seen, max(event_time) AS last_seen
    FROM audit GROUP BY ALL""",
)
def user_address_activity(t):
    """L4."""
    return au.user_address_activity(fx.v_audit(t))


@query(
    "recent_matching_queries",
    "WITH" + AUDIT + """
    SELECT event_time, "user", address, client_hostname, query FROM audit
    WHERE query LIKE '%sample_table%' ORDER BY event_time DESC, "user", address, client_hostname, query LIMIT 10""",
)
def recent_matching_queries(t):
    """Top 10 newest (the limit is the feature)."""
    return au.recent_matching_queries(fx.v_audit(t), "%sample_table%", 10)


@query(
    "recent_sessions",
    "WITH" + AUDIT + """
    SELECT "user", address, client_hostname, event_time AS login_time, logout_time
    FROM audit ORDER BY login_time DESC, "user", address, client_hostname, logout_time NULLS FIRST LIMIT 10""",
)
def recent_sessions(t):
    """Top 10 newest sessions."""
    return au.recent_sessions(fx.v_sessions(t), 10)


@query(
    "open_sessions",
    "WITH" + AUDIT + """
    SELECT "user", address, client_hostname, event_time AS login_time,
           (epoch_us((SELECT max(event_time) FROM audit)) - epoch_us(event_time)) // 1000000 AS elapsed_sec
    FROM audit WHERE logout_time IS NULL""",
)
def open_sessions(t):
    """L7."""
    return au.open_sessions(fx.v_sessions(t))


REPORT_SECONDS = 6 * 3600


@query(
    "read_work_report",
    "WITH" + AUDIT + f"""
    SELECT table_name, CAST(sum(read_rows) AS BIGINT) AS rows_read, CAST(sum(read_parts) AS BIGINT) AS parts_read
    FROM audit
    WHERE type = 'QueryFinish' AND query LIKE '%sample_table%'
      AND event_time > (SELECT max(event_time) FROM audit) - to_seconds({REPORT_SECONDS})
    GROUP BY table_name""",
)
def read_work_report(t):
    """Window of 6 hours before the latest entry (5 minutes in the source's example)."""
    return au.read_work_report(fx.v_audit(t), "%sample_table%", REPORT_SECONDS)


@query(
    "failed_tasks",
    """
    SELECT CASE WHEN user_id % 3 = 0 THEN 'worker@queue-' ELSE 'worker@host-' END || CAST(user_id AS VARCHAR) AS worker,
           'task-' || CAST(event_id AS VARCHAR) AS task_id, event_type AS info
    FROM events WHERE user_id % 3 = 0""",
)
def failed_tasks(t):
    """Flatten worker -> task -> info replies for workers on 'queue'."""
    return au.failed_tasks(fx.v_task_replies(t), "queue")


# --- O -----------------------------------------------------------------------

CONTAINERS = """
containers AS (
  SELECT 'ns-' || lower(l_returnflag) AS namespace, 'pod-' || CAST(l_orderkey AS VARCHAR) AS pod,
         CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE 'node-' || CAST(l_orderkey % 10 AS VARCHAR) END AS node,
         'c' || CAST(l_linenumber AS VARCHAR) AS container,
         CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_partkey * CAST(1e-3 AS DOUBLE) END AS cpu_request,
         CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_partkey * 2 * CAST(1e-3 AS DOUBLE) END AS cpu_limit,
         CAST(floor(l_quantity) AS BIGINT) * 1048576 AS mem_request,
         CAST(floor(l_quantity) AS BIGINT) * 2 * 1048576 AS mem_limit,
         CASE l_linenumber % 3 WHEN 0 THEN l_partkey * 1000 * CAST(1e-9 AS DOUBLE) WHEN 1 THEN l_partkey * CAST(1e-6 AS DOUBLE)
              ELSE CAST(l_partkey % 4 AS DOUBLE) END AS cpu_usage,
         CASE WHEN l_linenumber = 7 THEN NULL
              WHEN l_linenumber % 4 = 0 THEN CAST(floor(l_quantity) AS BIGINT) * 1024 * 1024
              WHEN l_linenumber % 4 = 1 THEN CAST(floor(l_quantity) AS BIGINT) * 1048576
              WHEN l_linenumber % 4 = 2 THEN CAST(floor(l_quantity) AS BIGINT) * 1073741824
              ELSE CAST(floor(l_quantity) AS BIGINT) * 1000 END AS mem_usage,
         l_linestatus = 'F' AS ready, l_orderkey
  FROM lineitem),
usage AS (
  SELECT namespace, pod, sum(cpu_usage) AS cpu_usage, CAST(sum(mem_usage) AS BIGINT) AS mem_usage
  FROM (SELECT namespace, pod, cpu_usage, mem_usage FROM containers WHERE l_orderkey % 13 <> 0
        UNION ALL SELECT namespace, 'gone-' || pod, cpu_usage, mem_usage FROM containers WHERE l_orderkey % 19 = 0)
  GROUP BY ALL),
requests AS (
  SELECT namespace, pod, node,
         sum(coalesce(cpu_request, 0.0)) AS cpu_request, sum(coalesce(cpu_limit, 0.0)) AS cpu_limit,
         CAST(sum(coalesce(mem_request, 0)) AS BIGINT) AS mem_request,
         CAST(sum(coalesce(mem_limit, 0)) AS BIGINT) AS mem_limit
  FROM containers WHERE node IS NOT NULL GROUP BY ALL),
pods AS (
  SELECT r.*, coalesce(u.cpu_usage, 0.0) AS cpu_usage, coalesce(u.mem_usage, 0) AS mem_usage
  FROM requests r LEFT JOIN usage u USING (namespace, pod)),
nodes AS (
  SELECT 'node-' || CAST(s_suppkey % 12 AS VARCHAR) AS node, count(*) AS n FROM supplier GROUP BY 1)"""


@query(
    "cpu_quantity",
    "WITH" + CONTAINERS + " SELECT namespace, pod, container, cpu_usage AS cpu_cores FROM containers",
    ["cpu_cores"],
)
def cpu_quantity(t):
    """O1: parsed CPU usage per container."""
    c = fx.v_containers(t)
    return c.select("namespace", "pod", "container", cpu_cores(F.col("cpu_usage")).alias("cpu_cores"))


@query(
    "memory_quantity",
    "WITH" + CONTAINERS + " SELECT namespace, pod, container, mem_usage AS mem_bytes FROM containers",
)
def memory_quantity(t):
    """O2: parsed memory usage per container (decimal suffix -> NULL)."""
    c = fx.v_containers(t)
    return c.select("namespace", "pod", "container", memory_bytes(F.col("mem_usage")).alias("mem_bytes"))


@query("pod_usage", "WITH" + CONTAINERS + " SELECT * FROM usage", ["cpu_usage"])
def pod_usage(t):
    """O3."""
    return cl.pod_usage(fx.v_usage(t))


@query("pod_requests", "WITH" + CONTAINERS + " SELECT * FROM requests", ["cpu_request", "cpu_limit"])
def pod_requests(t):
    """O4."""
    return cl.pod_requests(fx.v_containers(t))


@query("pod_usage_join", "WITH" + CONTAINERS + " SELECT * FROM pods", ["cpu_request", "cpu_limit", "cpu_usage"])
def pod_usage_join(t):
    """O5."""
    return cl.pod_usage_join(fx.v_containers(t), fx.v_usage(t))


@query(
    "node_rollup",
    "WITH" + CONTAINERS + """
    SELECT n.node, n.n * CAST(4 AS DOUBLE) AS cpu_capacity, n.n * 8 * 1073741824 AS mem_capacity,
           n.n * CAST(3.6 AS DOUBLE) AS cpu_allocatable, n.n * 7 * 1073741824 AS mem_allocatable,
           p.namespace, p.pod, p.cpu_request, p.mem_request, p.cpu_usage, p.mem_usage
    FROM nodes n LEFT JOIN pods p USING (node)""",
    ["cpu_capacity", "cpu_allocatable", "cpu_request", "cpu_usage"],
)
def node_rollup(t):
    """O6 (long form; the nested form is ``cluster.node_rollup``)."""
    return cl.node_pods(fx.v_nodes(t), fx.v_containers(t), fx.v_usage(t))


@query(
    "pod_readiness",
    "WITH" + CONTAINERS + """
    SELECT namespace, pod, string_agg(container, ',' ORDER BY container) AS containers,
           count(container) AS n_containers, coalesce(bool_and(ready), true) AS ready
    FROM containers GROUP BY ALL""",
)
def pod_readiness(t):
    """O7."""
    return cl.pod_readiness(fx.v_containers(t))
