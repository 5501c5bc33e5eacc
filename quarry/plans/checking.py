"""Registered quality (Q1-Q5), profiling/loading (Q6-Q10) and ingestion
(F1-F11) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import ingest as ig
from quarry.operators import profile as pf
from quarry.operators import quality as qa
from quarry.plans import fixtures as fx
from quarry.plans.registry import query
from quarry.session import scratch_path
from quarry.sources.tables import TABLES

# --- Q1-Q5 ----------------------------------------------------------------------------

CONTROL = """
control AS (
  SELECT p_partkey AS file_id,
         'LOAD DATA INFILE ''f' || p_partkey || '.txt'' INTO TABLE parts ' ||
         CASE WHEN p_size % 4 = 0 THEN 'fields terminated by '';'' optionally enclosed by ''"'''
              WHEN p_size % 2 = 0 THEN 'FIELDS TERMINATED BY '';'' OPTIONALLY ENCLOSED BY ''"'''
              ELSE '' END AS ctl_config
  FROM part)"""


@query(
    "control_lookup",
    "WITH" + CONTROL + """
    SELECT r.file_id, c.ctl_config, c.ctl_config IS NOT NULL AS found
    FROM (SELECT DISTINCT l_partkey + 1000 AS file_id FROM lineitem) r LEFT JOIN control c USING (file_id)""",
)
def control_lookup(t):
    """Q1: control text for every requested file id (l_partkey + 1000; ids past
    the last part are reported as not found)."""
    req = t.lineitem.select((F.col("l_partkey") + 1000).alias("file_id")).distinct()
    return qa.control_lookup(req, fx.v_control(t))


@query(
    "parse_control",
    "WITH" + CONTROL + """
    SELECT file_id,
           coalesce(nullif(regexp_extract(ctl_config, '(?i)FIELDS\\s+TERMINATED\\s+BY\\s+''([^'']+)''', 1), ''), ',') AS separator,
           coalesce(nullif(regexp_extract(ctl_config, '(?i)OPTIONALLY\\s+ENCLOSED\\s+BY\\s+''([^'']+)''', 1), ''), '"') AS quotechar
    FROM control""",
)
def parse_control(t):
    """Q2."""
    c = fx.v_control(t)
    sep, quote = qa.parse_control(F.col("ctl_config"))
    return c.select("file_id", sep.alias("separator"), quote.alias("quotechar"))


@query(
    "load_delimited",
    """
    SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name,
           CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE c_mktsegment END AS segment
    FROM customer WHERE c_custkey % 10 <> 7""",
)
def load_delimited(t):
    """Q3: customer written as ';'-separated text (every 10th+3 line short, every
    10th+7 line long), read back all-string: long lines skipped, short padded."""
    c = t.customer
    k = F.col("c_custkey") % 10
    line = F.when(k == 3, F.concat_ws(";", "c_custkey", "c_name")) \
        .when(k == 7, F.concat_ws(";", "c_custkey", "c_name", "c_mktsegment", F.lit("extra"))) \
        .otherwise(F.concat_ws(";", "c_custkey", "c_name", "c_mktsegment"))
    path = scratch_path(t.spark, "delimited")
    c.select(line.alias("value")).write.text(path)
    return qa.load_delimited(t.spark, path, ["id", "name", "segment"], sep=";", quote='"')


def _kind_sql(col: str, table: str) -> str:
    return (f"(SELECT CASE typeof({col}) WHEN 'BIGINT' THEN 'int' WHEN 'INTEGER' THEN 'int' "
            f"WHEN 'DOUBLE' THEN 'real' WHEN 'TIMESTAMP' THEN 'date' WHEN 'DATE' THEN 'date' "
            f"WHEN 'BOOLEAN' THEN 'bool' ELSE 'string' END FROM {table} LIMIT 1)")


# fields with bounds that aren't numbers
BOUND_KIND = {"l_shipdate": "date", "c_name": "text", "c_mktsegment": "text"}


def _passes_sql(table: str, field: str, check: str, expected: str) -> str:
    """Verdict over (actual, actual_text); what can't be measured does not pass."""
    sign = {"min": ">=", "min_length": ">=", "max": "<=", "max_length": "<=", "max_nulls": "<="}.get(check)
    if check == "type":
        said = "actual_text = expected"
    elif check in ("min", "max") and BOUND_KIND.get(field) == "date":
        said = f"CAST(actual_text AS TIMESTAMP) {sign} TRY_CAST(expected AS TIMESTAMP)"
    elif check in ("min", "max") and field in BOUND_KIND:
        said = f"actual_text {sign} expected"
    else:
        said = f"actual {sign} TRY_CAST(expected AS DOUBLE)" if sign else "actual = 0"
    return f"SELECT *, coalesce({said}, false) AS passes FROM ({_check_sql(table, field, check, expected)})"


def _check_sql(table: str, field: str, check: str, expected: str) -> str:
    c = field
    if check == "type":
        actual, text = "CAST(NULL AS DOUBLE)", _kind_sql(c, table)
    else:
        text = "CAST(NULL AS VARCHAR)"
        agg = {
            "max_nulls": f"count(*) FILTER (WHERE {c} IS NULL)",
            "no_duplicates": f"count({c}) - count(DISTINCT {c})",
            "min_length": f"min(length(CAST({c} AS VARCHAR)))",
            "max_length": f"max(length(CAST({c} AS VARCHAR)))",
        }.get(check)
        if check in ("min", "max"):
            kind, agg = BOUND_KIND.get(c, "number"), f"{check}({c})"
            if kind != "number":
                shown = f"strftime({agg}, '%Y-%m-%d %H:%M:%S')" if kind == "date" else agg
                text = f"(SELECT {shown} FROM {table})"
                agg = "NULL"
        elif check == "sign" and c in BOUND_KIND:
            agg = "NULL"
        elif check == "sign":
            bad = {"positive": "<= 0", "non-negative": "< 0", "zero": "<> 0", "non-positive": "> 0",
                   "negative": ">= 0"}[expected]
            agg = f"count(*) FILTER (WHERE {c} {bad})"
        elif check == "allowed_values":
            vals = ", ".join("'" + v.strip() + "'" for v in expected.split("|"))
            agg = f"count(*) FILTER (WHERE {c} IS NOT NULL AND CAST({c} AS VARCHAR) NOT IN ({vals}))"
        elif check == "rex":
            agg = f"count(*) FILTER (WHERE {c} IS NOT NULL AND NOT regexp_matches(CAST({c} AS VARCHAR), '{expected}'))"
        actual = f"(SELECT CAST({agg} AS DOUBLE) FROM {table})" if agg != "NULL" else "CAST(NULL AS DOUBLE)"
    return (f"SELECT '{table}' AS table_name, '{field}' AS field, '{check}' AS \"check\", '{expected}' AS expected, "
            f"{actual} AS actual, {text} AS actual_text")


RESULTS = """
results AS (""" + "\n  UNION ALL ".join(_passes_sql(*r) for r in fx.CONSTRAINT_ROWS) + ")"


def _results(t):
    cons = fx.v_constraints(t)
    return qa.verify_constraints(t.customer, cons, "customer").unionByName(
        qa.verify_constraints(t.lineitem, cons, "lineitem"))


@query("verify_constraints", "WITH" + RESULTS + " SELECT * FROM results", ["actual"])
def verify_constraints(t):
    """Every constraint on customer and lineitem (some fail on purpose)."""
    return _results(t)


@query(
    "quality_run_log",
    "WITH" + RESULTS + f"""
    SELECT table_name, '{fx.CONSTRAINT_FILE}' AS constraint_file, CASE WHEN bool_and(passes) THEN 'Y' ELSE 'N' END AS passes,
           count(*) AS checks, CAST(count_if(NOT passes) AS BIGINT) AS failures,
           printf('%d checks, %d failures', count(*), count_if(NOT passes)) AS summary
    FROM results GROUP BY table_name""",
)
def quality_run_log(t):
    """Q4."""
    return qa.quality_run_log(_results(t), fx.CONSTRAINT_FILE)


@query(
    "quality_details",
    "WITH" + RESULTS + """
    SELECT table_name, field AS field_name, "check" AS check_type, expected AS expected_value,
           coalesce(actual_text, CAST(CAST(actual AS DECIMAL(20,4)) AS VARCHAR), 'null') AS actual_value,
           CASE WHEN passes THEN 'Y' ELSE 'N' END AS passes,
           CAST(json_object('check', "check", 'expected', expected, 'actual',
             coalesce(actual_text, CAST(CAST(actual AS DECIMAL(20,4)) AS VARCHAR), 'null'), 'passes', passes) AS VARCHAR) AS details_json
    FROM results""",
)
def quality_details(t):
    """Q5."""
    return qa.quality_details(_results(t))


# --- Q6-Q10 ---------------------------------------------------------------------------

# The columns of the given tables and the family of their types.
PROFILE_TABLES = {
    "region": "r_regionkey:int r_name:string",
    "nation": "n_nationkey:int n_name:string n_regionkey:int",
    "customer": "c_custkey:int c_name:string c_nationkey:int c_acctbal:float c_mktsegment:string",
    "supplier": "s_suppkey:int s_name:string s_nationkey:int s_acctbal:float",
    "part": "p_partkey:int p_name:string p_brand:string p_type:string p_size:int p_retailprice:float",
    "orders": "o_orderkey:int o_custkey:int o_orderstatus:string o_totalprice:float o_orderdate:datetime o_orderpriority:string",
    "lineitem": "l_orderkey:int l_partkey:int l_suppkey:int l_linenumber:int l_quantity:float l_extendedprice:float l_discount:float l_tax:float l_returnflag:string l_linestatus:string l_shipdate:datetime",
    "events": "event_id:int ts:datetime user_id:int event_type:string value:float props:string",
    "documents": "doc_id:int text:string lang:string source:string n_chars:int",
    "embeddings": "vec_id:int embedding:other label:int",
    "pages": "page_id:int url:string html:string",
    "benchmark": "item_id:int text:string",
    "labels": "doc_id:int quality:int toxic:int",
    "conversations": "conv_id:int turn:int role:string text:string",
}


def _suggest_sql(table: str, col: str, fam: str) -> str:
    inferred = pf.INFERRED[fam]
    if fam == "string":
        s = f"CASE WHEN count(DISTINCT {col}) / count({col}) < 0.5 THEN 'LowCardinality(String)' ELSE 'String' END"
    elif fam == "int":
        lo, hi = f"min({col})", f"max({col})"
        s = (f"CASE WHEN {lo} >= 0 THEN (CASE WHEN {hi} < 256 THEN 'UInt8' WHEN {hi} < 65536 THEN 'UInt16' "
             f"WHEN {hi} < 4294967296 THEN 'UInt32' ELSE 'UInt64' END) "
             f"ELSE (CASE WHEN {lo} >= -128 AND {hi} <= 127 THEN 'Int8' WHEN {lo} >= -32768 AND {hi} <= 32767 THEN 'Int16' "
             f"WHEN {lo} >= -2147483648 AND {hi} <= 2147483647 THEN 'Int32' ELSE 'Int64' END) END")
    elif fam == "float":
        s = f"CASE WHEN stddev_samp({col}) < 1e-3 THEN 'Float32' ELSE 'Float64' END"
    else:
        s = {"datetime": "'DateTime'", "bool": "'UInt8'"}.get(fam, "'String'")
    return (f"SELECT '{table}' AS table_name, '{col}' AS column_name, '{inferred}' AS inferred_type, "
            f"CASE WHEN count({col}) = 0 THEN 'String' ELSE {s} END AS suggested_type, count({col}) AS non_null "
            f"FROM {table}")


SUGGEST_SQL = "\nUNION ALL ".join(_suggest_sql(tb, *c.split(":")) for tb, cols in PROFILE_TABLES.items() for c in cols.split())


def _suggest(t):
    out = None
    for tb in PROFILE_TABLES:
        s = pf.suggest_types(t.read(tb), tb)
        out = s if out is None else out.unionByName(s)
    return out


@query("suggest_types", SUGGEST_SQL)
def suggest_types(t):
    """Q6 on every table (one aggregate and one shuffle of distinct text values per table)."""
    return _suggest(t)


INFER_SQL = " UNION ALL ".join(
    f"""SELECT '{tb}' AS table_name, d.column_name,
    CASE WHEN d.column_type IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT') THEN 'Int64'
         WHEN d.column_type IN ('DOUBLE', 'FLOAT') THEN 'Float64' WHEN d.column_type = 'BOOLEAN' THEN 'UInt8'
         WHEN d.column_type LIKE 'TIMESTAMP%' OR d.column_type = 'DATE' THEN 'DateTime' ELSE 'String' END AS inferred_type,
    u.non_null
    FROM (DESCRIBE {tb}) d JOIN (UNPIVOT (SELECT count(COLUMNS('(.*)')) AS '\\1' FROM {tb}) ON COLUMNS(*)
      INTO NAME column_name VALUE non_null) u USING (column_name)"""
    for tb in TABLES)


@query("infer_types", INFER_SQL)
def infer_types(t):
    """Q7 on every table: the inferred type per column, from the schema, with its non-NULL count."""
    out = None
    for tb in TABLES:
        df = t.read(tb)
        types = pf.infer_types(df)
        counts = df.agg(*[F.count(f"`{c}`").alias(f"n{i}") for i, (c, _) in enumerate(types)])
        entries = [F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("inferred_type"), F.col(f"n{i}").alias("non_null"))
                   for i, (c, k) in enumerate(types)]
        rows = counts.select(F.lit(tb).alias("table_name"), F.inline(F.array(*entries)))
        out = rows if out is None else out.unionByName(rows)
    return out


SCHEMA_OVERRIDE = {"c_custkey": "int", "c_nationkey": "smallint"}
OVERRIDE_SQL = """
SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, CAST(c_nationkey AS SMALLINT) AS c_nationkey,
       c_acctbal, c_mktsegment FROM customer"""


@query("apply_schema", OVERRIDE_SQL, ["c_acctbal"])
def apply_schema(t):
    """Q8: explicit types win over the inferred ones."""
    return pf.apply_schema(t.customer, SCHEMA_OVERRIDE)


def _load(t):
    base = scratch_path(t.spark, "loads")
    table = "loaded_customer_" + base.rsplit("-", 1)[1]
    log = pf.run_load(t.spark, lambda s: t.customer, table, base, SCHEMA_OVERRIDE, log_path=f"{base}/_load_log")
    return table, log


@query("run_load", OVERRIDE_SQL, ["c_acctbal"])
def run_load(t):
    """Q10 (+ S8): load customer with the schema override, read the table back
    (without the per-run load_id / load_timestamp stamps)."""
    table, _ = _load(t)
    return t.spark.table(table).drop("load_id", "load_timestamp")


@query("load_log", "SELECT count(*) AS row_count, 'success' AS status, '' AS error_message FROM customer")
def load_log(t):
    """Q9: the load-log row of a load (without id, time and generated table name)."""
    _, log = _load(t)
    return log.select("row_count", "status", "error_message")


# --- F1-F11 ---------------------------------------------------------------------------

INGEST = """
docs AS (
  SELECT d.doc_id, d.source, d.text, coalesce(l.quality, 1) AS quality, coalesce(l.toxic, 0) AS toxic
  FROM documents d LEFT JOIN labels l USING (doc_id)),
files AS (
  SELECT '/share/' || source || '_' || doc_id || '.csv' AS file_path, doc_id AS file_order, text, toxic FROM docs
  UNION ALL SELECT '/share/' || source || '_' || doc_id || '.xlsx', 1000000000 + doc_id, NULL, 0 FROM docs WHERE doc_id % 25 = 0
  UNION ALL SELECT '/share/' || source || '_empty_' || doc_id || '.csv', 2000000000 + doc_id, NULL, 0 FROM docs WHERE quality = 0),
lines AS (
  SELECT file_path, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS line_no, unnest(parts) AS line
  FROM (SELECT file_path, string_split(text, chr(10)) AS parts FROM files WHERE text IS NOT NULL)),
fp AS (
  SELECT file_path,
         md5(CAST(count(*) AS VARCHAR) || ':' || CAST(sum(CAST(CAST(('0x' || substr(md5(CAST(line_no AS VARCHAR) || ':' || line), 1, 15)) AS BIGINT) AS DECIMAL(38,0))) AS VARCHAR)) AS file_hash,
         count(*) AS rows
  FROM lines GROUP BY file_path),
rules AS (SELECT * FROM (VALUES """ + ", ".join(f"({o}, '{r}', '{tt}')" for o, r, tt in fx.ROUTE_RULES) + """) AS r(rule_order, regex, target_table)),
routed AS (
  SELECT f.file_path, f.file_order, arg_min(r.target_table, r.rule_order) AS target_table
  FROM files f LEFT JOIN rules r ON regexp_matches(regexp_extract(f.file_path, '[^/]+$', 0), '^(?:' || r.regex || ')')
  GROUP BY ALL),
st AS (
  SELECT *, CASE WHEN lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) IN ('csv') THEN 'SUCCESS' ELSE 'FAILED' END AS status
  FROM routed WHERE target_table IS NOT NULL),
good0 AS (
  SELECT s.file_path, s.file_order, s.target_table, fp.file_hash, coalesce(fp.rows, 0) AS rows
  FROM st s LEFT JOIN fp USING (file_path) WHERE s.status = 'SUCCESS'),
good1 AS (SELECT * FROM good0 WHERE rows > 0),
ledger0 AS (SELECT fp.file_hash FROM fp JOIN files f USING (file_path) WHERE f.toxic = 1),
good2 AS (
  SELECT * FROM good1 g
  WHERE file_order = (SELECT min(file_order) FROM good1 g2 WHERE g2.file_hash = g.file_hash)
    AND NOT EXISTS (SELECT 1 FROM ledger0 l WHERE l.file_hash = g.file_hash)),
existing AS (SELECT * FROM (VALUES """ + ", ".join(f"('{a}', {b})" for a, b in fx.EXISTING_VERSIONS) + """) AS e(target_table, v)),
versioned AS (
  SELECT g.*, CAST(coalesce(e.v, 0) + row_number() OVER (PARTITION BY g.target_table ORDER BY g.file_order) AS INTEGER) AS _version_id
  FROM good2 g LEFT JOIN existing e USING (target_table)),
flagged AS (
  SELECT *, _version_id = max(_version_id) OVER (PARTITION BY target_table) AS _is_latest FROM versioned),
ledger AS (
  SELECT file_path, file_hash, TIMESTAMP '""" + fx.RUN_TS + """' AS loaded_at, target_table, 'SUCCESS' AS status,
         CAST(NULL AS VARCHAR) AS error_message FROM versioned
  UNION ALL
  SELECT file_path, CAST(NULL AS VARCHAR), TIMESTAMP '""" + fx.RUN_TS + """', CAST(NULL AS VARCHAR), 'FAILED', 'Unsupported file type'
  FROM st WHERE status = 'FAILED')"""


class _Batch:
    """The ingestion fixture pieces for one Tables handle."""

    def __init__(self, t):
        self.files = fx.v_files(t)
        self.lines = fx.v_file_lines(self.files)
        self.rules = fx.v_route_rules(t)
        toxic = self.files.where(F.col("toxic") == 1).select("file_path")
        self.ledger = ig.content_fingerprint(self.lines.join(toxic, "file_path", "left_semi")).select("file_hash")
        self.existing = fx.v_existing_versions(t)
        self.manifest = self.files.select("file_path", "file_order")

    def plan(self):
        return ig.plan_batch(self.manifest, self.lines, self.rules, self.ledger, self.existing)

    def ledger_rows(self):
        p = self.plan()
        return ig.ingestion_ledger(p, F.lit(fx.RUN_TS).cast("timestamp_ntz"))


@query("route_files", "WITH" + INGEST + " SELECT file_path, target_table FROM routed")
def route_files(t):
    """F1."""
    b = _Batch(t)
    return ig.route_files(b.manifest, b.rules).select("file_path", "target_table")


@query("content_fingerprint", "WITH" + INGEST + " SELECT * FROM fp")
def content_fingerprint(t):
    """F2 (order-sensitive, decomposable)."""
    return ig.content_fingerprint(_Batch(t).lines)


@query("path_fingerprint", "WITH" + INGEST + " SELECT file_path, md5(file_path) AS path_hash FROM files")
def path_fingerprint(t):
    """F3."""
    return ig.path_fingerprint(_Batch(t).manifest).select("file_path", "path_hash")


@query("skip_already_loaded", "WITH" + INGEST + " SELECT file_path, file_hash FROM good2")
def skip_already_loaded(t):
    """files kept after the ledger and in-batch duplicate checks."""
    b = _Batch(t)
    p = b.plan()
    return p.where(F.col("status") == "SUCCESS").select("file_path", "file_hash")


@query("assign_version", "WITH" + INGEST + " SELECT file_path, target_table, _version_id FROM versioned")
def assign_version(t):
    """F5."""
    p = _Batch(t).plan()
    return p.where(F.col("status") == "SUCCESS").select("file_path", "target_table", "_version_id")


@query("latest_snapshot", "WITH" + INGEST + " SELECT file_path, target_table, _version_id, _is_latest FROM flagged")
def latest_snapshot(t):
    """F6."""
    p = _Batch(t).plan().where(F.col("status") == "SUCCESS").select("file_path", "target_table", "_version_id")
    return ig.latest_flags(p).select("file_path", "target_table", "_version_id", "_is_latest")


@query(
    "stamp_lineage",
    "WITH" + INGEST + """
    SELECT f.target_table, l.line_no, l.line, f._version_id, f._is_latest,
           regexp_extract(f.file_path, '[^/]+$', 0) AS _file_name, f.file_hash AS _file_hash,
           TIMESTAMP '""" + fx.RUN_TS + """' AS _load_timestamp
    FROM lines l JOIN flagged f USING (file_path)""",
)
def stamp_lineage(t):
    """the loaded rows with lineage columns."""
    b = _Batch(t)
    return ig.rows_for(b.plan(), b.lines, F.lit(fx.RUN_TS).cast("timestamp_ntz"))


@query("skip_empty_inputs", "WITH" + INGEST + " SELECT file_path FROM good0 WHERE rows = 0")
def skip_empty_inputs(t):
    """F8: routed, readable files skipped because they are empty."""
    b = _Batch(t)
    routed = ig.extension_status(ig.route_files(b.manifest, b.rules).where(F.col("target_table").isNotNull()))
    fp = ig.content_fingerprint(b.lines)
    ok = routed.where(F.col("status") == "SUCCESS").join(fp, "file_path", "left") \
        .withColumn("rows", F.coalesce("rows", F.lit(0)))
    return ok.join(ig.skip_empty(ok).select("file_path"), "file_path", "left_anti").select("file_path")


@query("ingestion_ledger", "WITH" + INGEST + " SELECT * FROM ledger")
def ingestion_ledger(t):
    """F9."""
    return _Batch(t).ledger_rows()


@query(
    "quarantine",
    "WITH" + INGEST + """
    SELECT file_path, '/share/quarantine/' || regexp_extract(file_path, '[^/]+$', 0) AS quarantine_path
    FROM ledger WHERE status = 'FAILED'""",
)
def quarantine(t):
    """F10."""
    return ig.quarantine(_Batch(t).ledger_rows(), "/share/quarantine")


@query(
    "batch_outcome",
    "WITH" + INGEST + """
    SELECT CAST(count_if(status = 'SUCCESS') AS BIGINT) AS succeeded, CAST(count_if(status = 'FAILED') AS BIGINT) AS failed,
           count_if(status = 'SUCCESS') = 0 AND count_if(status = 'FAILED') > 0 AS run_failed
    FROM ledger""",
)
def batch_outcome(t):
    """F11."""
    return ig.batch_outcome(_Batch(t).ledger_rows())
