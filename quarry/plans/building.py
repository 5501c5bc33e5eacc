"""Registered mart-building (M), layout (B) and log-replay (K, S7) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import layout as ly
from quarry.operators import marts as mt
from quarry.operators import replay as rp
from quarry.plans import fixtures as fx
from quarry.plans.registry import query
from quarry.session import scratch_path
from quarry.sources.tables import register_views


def _sql_str(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _sql_arr(vs) -> str:
    return "CAST([" + ", ".join(_sql_str(v) for v in vs) + "] AS VARCHAR[])"


MARTS = """
marts AS (
  SELECT * FROM (VALUES """ + ", ".join(
    f"({_sql_str(r[0])}, {_sql_arr(r[3])}, {r[7]})" for r in fx.MART_ROWS
) + """) AS m(datamart_name, depends_on, enabled)),
mlog AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderpriority AS datamart_name,
         CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' WHEN 'P' THEN 'running' END AS status,
         o_orderdate AS end_time
  FROM orders),
ok AS (SELECT datamart_name, max(end_time) AS last_run FROM mlog WHERE status = 'success' GROUP BY 1)"""


@query(
    "enabled_marts",
    "WITH" + MARTS + """
    SELECT m.datamart_name, ok.last_run FROM marts m LEFT JOIN ok USING (datamart_name) WHERE m.enabled = 1""",
)
def enabled_marts(t):
    """M1 (+ M8 marker): enabled marts with their last successful run."""
    cfg = mt.enabled_marts(fx.v_marts(t))
    return mt.last_success(cfg, fx.v_mart_log(t))


@query(
    "last_success",
    "WITH" + MARTS + " SELECT m.datamart_name, ok.last_run FROM marts m LEFT JOIN ok USING (datamart_name)",
)
def last_success(t):
    """M8."""
    return mt.last_success(fx.v_marts(t), fx.v_mart_log(t))


@query(
    "mart_readiness",
    "WITH" + MARTS + """,
    deps AS (
      SELECT datamart_name, unnest(CASE WHEN len(depends_on) = 0 THEN [NULL] ELSE depends_on END) AS dep FROM marts)
    SELECT d.datamart_name,
           bool_and(d.dep IS NULL OR ok.last_run IS NOT NULL) AS ready,
           count(d.dep) AS n_dependencies,
           CAST(count_if(d.dep IS NOT NULL AND ok.last_run IS NULL) AS BIGINT) AS n_missing
    FROM deps d LEFT JOIN ok ON ok.datamart_name = d.dep
    GROUP BY d.datamart_name""",
)
def mart_readiness(t):
    """M2."""
    return mt.mart_readiness(fx.v_marts(t), fx.v_mart_log(t))


@query(
    "chunk_bounds",
    """
    WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders)
    SELECT CAST(i AS INTEGER) AS chunk_id, lo + i * 1000 AS chunk_start, lo + (i + 1) * 1000 AS chunk_end
    FROM b, range(0, CAST((hi - lo) // 1000 + 1 AS BIGINT)) AS r(i)""",
)
def chunk_bounds(t):
    """M3: orders on o_orderkey, size 1000."""
    return mt.chunk_bounds(t.orders, "o_orderkey", 1000)


@query(
    "chunked_build",
    """
    WITH b AS (SELECT min(o_orderkey) AS lo FROM orders)
    SELECT CAST(floor((o_orderkey - lo) / 1000) AS BIGINT) AS chunk_id,
           lo + CAST(floor((o_orderkey - lo) / 1000) AS BIGINT) * 1000 AS chunk_start,
           lo + (CAST(floor((o_orderkey - lo) / 1000) AS BIGINT) + 1) * 1000 AS chunk_end,
           count(*) AS rows
    FROM orders, b GROUP BY ALL""",
)
def chunked_build(t):
    """M4: orders inserted in chunks of o_orderkey, size 1000; the ledger's chunks that hold
    rows, and the rows that the target really has in them."""
    insert = mt.ChunkedInsert(t.spark, scratch_path(t.spark, "chunked"), "o_orderkey", 1000)
    ledger = insert.run(t.orders).where("rows > 0").drop("rows", "attempt")
    lo = t.orders.select(F.min("o_orderkey")).scalar()
    there = insert.rows(t.orders.schema).groupBy(((F.col("o_orderkey") - lo) / 1000).cast("bigint").alias("chunk_id")).agg(F.count(F.lit(1)).alias("rows"))
    return ledger.join(there, "chunk_id").select("chunk_id", "chunk_start", "chunk_end", "rows")


GRID_COLS = ["l_orderkey", "l_partkey"]
GRID_SIZE = 500

GRID = """
b AS (SELECT min(l_orderkey) AS lo1, max(l_orderkey) AS hi1, min(l_partkey) AS lo2, max(l_partkey) AS hi2 FROM lineitem),
grid AS (
  SELECT lo1 + i * 500 AS l_orderkey_start, lo1 + (i + 1) * 500 AS l_orderkey_end,
         lo2 + j * 500 AS l_partkey_start, lo2 + (j + 1) * 500 AS l_partkey_end
  FROM b, range(0, CAST((hi1 - lo1) // 500 + 1 AS BIGINT)) AS r1(i), range(0, CAST((hi2 - lo2) // 500 + 1 AS BIGINT)) AS r2(j))"""


@query("chunk_grid", "WITH" + GRID + " SELECT * FROM grid")
def chunk_grid(t):
    """M5: lineitem on (l_orderkey, l_partkey), size 500."""
    return mt.chunk_grid(t.lineitem, mt.parse_columns("l_orderkey, l_partkey"), GRID_SIZE)


CELL = 40  # small enough that some cells are empty


@query(
    "chunk_grid_build",
    f"""
    WITH b AS (SELECT min(l_orderkey) AS lo1, max(l_orderkey) AS hi1, min(l_partkey) AS lo2, max(l_partkey) AS hi2 FROM lineitem),
    n AS (SELECT lo1, lo2, (hi1 - lo1) // {CELL} + 1 AS n1, (hi2 - lo2) // {CELL} + 1 AS n2 FROM b),
    cells AS (SELECT (l_orderkey - lo1) // {CELL} AS i, (l_partkey - lo2) // {CELL} AS j, count(*) AS rows FROM lineitem, n GROUP BY ALL),
    in_line AS (SELECT i, j FROM cells UNION SELECT i, -1 FROM cells UNION SELECT i, n2 FROM cells, n),
    after AS (SELECT i, j, lead(j) OVER (PARTITION BY i ORDER BY j) AS nj FROM in_line),
    lines AS (SELECT DISTINCT i FROM cells UNION SELECT -1 UNION SELECT n1 FROM n),
    next_line AS (SELECT i, lead(i) OVER (ORDER BY i) AS ni FROM lines),
    boxes AS (
      SELECT i AS i1, i AS i2, j AS j1, j AS j2, rows FROM cells
      UNION ALL SELECT i, i, j + 1, nj - 1, 0 FROM after WHERE nj - j > 1
      UNION ALL SELECT i + 1, ni - 1, 0, n2 - 1, 0 FROM next_line, n WHERE ni - i > 1)
    SELECT lo1 + i1 * {CELL} AS l_orderkey_start, lo1 + (i2 + 1) * {CELL} AS l_orderkey_end,
           lo2 + j1 * {CELL} AS l_partkey_start, lo2 + (j2 + 1) * {CELL} AS l_partkey_end, rows
    FROM boxes, n""",
)
def chunk_grid_build(t):
    """M6: rows per occupied grid cell, and the runs of empty cells between them."""
    return mt.grid_boxes(t.lineitem, GRID_COLS, CELL)


def _run_urgent(t):
    register_views(t, ["orders"])
    cfg = next(dict(zip(fx.MART_SCHEMA_NAMES, r)) for r in fx.MART_ROWS if r[0] == "1-URGENT")
    base = scratch_path(t.spark, "marts")
    cfg["target_table"] = f"{cfg['target_table']}_{base.rsplit('-', 1)[1]}"
    log = mt.run_mart(t.spark, cfg, base, log_path=f"{base}/_log")
    return cfg, log


@query("run_mart", fx.MART_ROWS[0][2], ["total_price"])
def run_mart(t):
    """M9 (+ S9): run the '1-URGENT' mart from its config text, swap it in, read it back."""
    cfg, _ = _run_urgent(t)
    return t.spark.table(cfg["target_table"])


@query(
    "mart_run_log",
    "WITH built AS (" + fx.MART_ROWS[0][2] + f"""),
    b AS (SELECT min({fx.MART_ROWS[0][4]}) AS lo, max({fx.MART_ROWS[0][4]}) AS hi FROM built)
    SELECT '1-URGENT' AS datamart_name, 'success' AS status, 'success' AS message,
           CAST((hi - lo) // {fx.MART_ROWS[0][5]} + 1 AS INTEGER) AS chunk_count, {_sql_str(fx.MART_ROWS[0][2])} AS query FROM b""",
)
def mart_run_log(t):
    """M7: the run-log row written by a mart run (without its times and generated table name)."""
    _, log = _run_urgent(t)
    return log.select("datamart_name", "status", "message", "chunk_count", "query")


# --- layouts -------------------------------------------------------------------------

RANGE = ("1997-06-01", "1997-08-01")


@query(
    "layout_range_counts",
    "SELECT name AS table_name, (SELECT count(*) FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '"
    + RANGE[0] + "' AND DATE '" + RANGE[1] + "') AS cnt FROM (VALUES "
    + ", ".join(f"('{n}')" for n, _, _ in ly.LAYOUTS) + ") AS v(name)",
)
def layout_range_counts(t):
    """B1: the same closed date range counted on four layouts of lineitem."""
    paths = ly.write_layouts(fx.v_layout(t), scratch_path(t.spark, "layouts"))
    return ly.layout_range_counts(t.spark, paths, *RANGE)


@query(
    "date_key",
    """
    SELECT DISTINCT CAST(l_shipdate AS DATE) AS event_date,
           CAST(strftime(CAST(l_shipdate AS DATE), '%Y%m%d') AS INTEGER) AS date_int,
           CAST(strptime(strftime(CAST(l_shipdate AS DATE), '%Y%m%d'), '%Y%m%d') AS DATE) AS date_back
    FROM lineitem""",
)
def date_key(t):
    """B2: date -> yyyymmdd -> date, per distinct ship date."""
    d = t.lineitem.select(F.to_date("l_shipdate").alias("event_date")).distinct()
    k = ly.date_to_key(F.col("event_date"))
    return d.select("event_date", k.alias("date_int"), ly.key_to_date(k).alias("date_back"))


# --- replay ---------------------------------------------------------------------------

LOG = """
log AS (
  SELECT 'events' AS topic, CAST(user_id % 4 AS INTEGER) AS partition, event_id AS "offset", ts AS "timestamp",
         'user_' || CAST(user_id AS VARCHAR) AS key,
         CASE WHEN event_id % 50 = 0 THEN '{broken ' || props ELSE props END AS value
  FROM events),
t AS (SELECT max("timestamp") - INTERVAL 10 MINUTE AS at_ts FROM log),
k1 AS (
  SELECT topic, partition, min("offset") FILTER (WHERE "timestamp" >= (SELECT at_ts FROM t)) AS found_offset,
         min("offset") AS earliest_offset
  FROM log GROUP BY ALL)"""


def _at(log):
    """Replay time: ten minutes before the newest record (scalar subquery)."""
    return log.select(F.max("timestamp")).scalar() - F.expr("INTERVAL 10 MINUTES")


@query("replay_offsets", "WITH" + LOG + " SELECT *, coalesce(found_offset, earliest_offset) AS start_offset FROM k1")
def replay_offsets(t):
    """K1 with fallback to the earliest offset."""
    log = fx.v_log(t)
    return rp.replay_offsets(log, _at(log))


@query("replay_offsets_strict",
       "WITH" + LOG + " SELECT *, found_offset AS start_offset FROM k1 WHERE found_offset IS NOT NULL")
def replay_offsets_strict(t):
    """K2."""
    log = fx.v_log(t)
    return rp.replay_offsets_strict(log, _at(log))


@query("replay_earliest", "WITH" + LOG + " SELECT topic, partition, earliest_offset AS start_offset FROM k1")
def replay_earliest(t):
    """K3."""
    return rp.replay_earliest(fx.v_log(t))


@query("replay_missing_report", "WITH" + LOG + " SELECT topic, partition, earliest_offset FROM k1 WHERE found_offset IS NULL")
def replay_missing_report(t):
    """K4."""
    log = fx.v_log(t)
    return rp.replay_missing_report(log, _at(log))


@query(
    "replay_from",
    "WITH" + LOG + """
    SELECT l.topic, l.partition, l."offset", l."timestamp", l.key, l.value
    FROM log l JOIN k1 USING (topic, partition)
    WHERE l."offset" >= coalesce(k1.found_offset, k1.earliest_offset)""",
)
def replay_from(t):
    """K5: records from the K1 start of each partition."""
    log = fx.v_log(t)
    return rp.replay_from(log, rp.replay_offsets(log, _at(log)))


@query("partition_positions",
       "WITH" + LOG + ' SELECT topic, partition, max("offset") + 1 AS position FROM log GROUP BY ALL')
def partition_positions(t):
    """K6."""
    return rp.partition_positions(fx.v_log(t))


@query(
    "decode_or_skip",
    "WITH" + LOG + """
    SELECT topic, partition, "offset",
           CASE WHEN json_valid(value) THEN CAST(json_extract(value, '$.k') AS INTEGER) END AS k,
           coalesce(json_valid(value), false) AS decoded
    FROM log""",
)
def decode_or_skip(t):
    """Decoded payload field ``k`` and the decoded flag per record."""
    return rp.decode_or_skip(fx.v_log(t), "k INT")

