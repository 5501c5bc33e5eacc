"""Views that map the driver's tables onto the reference's data shapes
(FIXTURES.md part B). Each view is a lazy DataFrame over the parquet scans, so
its work grows with the tables; the matching DuckDB text lives in
``quarry.plans.registry`` and must say the same thing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.tables import Tables

NTZ = "timestamp_ntz"


def ms(c) -> F.Column:
    return F.date_trunc("millisecond", c).cast(NTZ)


def v_ticks(t: Tables) -> DataFrame:
    """events as tick prices: instrument = event_type, price = value, event time cut
    to ms, insertion = event time + (event_id*37 % 5000) ms, t_dt = its date."""
    e = t.events
    ts = ms(F.col("ts"))
    return e.select(
        F.col("event_type").alias("instrument"),
        F.col("value").alias("price"),
        ts.alias("timestamp"),
        F.expr("timestampadd(MILLISECOND, (event_id * 37) % 5000, date_trunc('millisecond', ts))")
        .cast(NTZ)
        .alias("insertion_timestamp"),
        F.to_date("ts").alias("t_dt"),
    )


def ts_text(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def epoch_ms(c) -> F.Column:
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast(NTZ), c)


# --- feed monitoring (P1-P11) ---------------------------------------------

def v_feeds(t: Tables) -> DataFrame:
    """name = event_type, last_refresh = ts, latency = value, errors = 1 on every 7th event."""
    return t.events.select(
        F.col("event_type").alias("name"),
        F.col("ts").alias("last_refresh"),
        F.col("value").alias("latency"),
        (F.col("event_id") % 7 == 0).cast("int").alias("errors"),
    )


# Stored thresholds exist for two feed names only; the rest use 5 / 10.
THRESHOLD_ROWS = [("click", 50, 100), ("error", 20, 200)]


def v_thresholds(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(THRESHOLD_ROWS, "name string, warning int, critical int")


RUN_STATUS = ["STARTED", "SUCCESS", "FAILURE", "QUEUED"]


def v_runs(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("run_id"),
        F.col("event_type").alias("pipeline_name"),
        F.element_at(F.array(*[F.lit(s) for s in RUN_STATUS]), (F.col("event_id") % 4 + 1).cast("int")).alias("status"),
        F.col("ts").alias("start_time"),
    )


def v_stream_entries(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_type").alias("stream"),
        F.concat(epoch_ms(F.col("ts")).cast("string"), F.lit("-"), F.col("event_id").cast("string")).alias("entry_id"),
    )


def v_streams(t: Tables) -> DataFrame:
    """Every stream seen in the entries plus one stream that has none."""
    empty = t.spark.createDataFrame([("empty",)], "stream string")
    return t.events.select(F.col("event_type").alias("stream")).distinct().unionByName(empty)


# The alert rule list (name, value, text value, category filter).
RULES = [
    ("deltaFET / open interest", 0.01, "", ""),
    ("delta / market space cap", 0.01, "", ""),
    ("delta / volume", 0.2, "", ""),
    ("delta / volume 30 days", 0.2, "", ""),
    ("delta / VWAP volume", 0.2, "", ""),
    ("delta / auction volume", 0.15, "", "(not in) future.bond index"),
    ("delta", 1_000_000.0, "", ""),
    ("notification", 0.0, "touched.*", ""),
    ("session buys / volume", 0.1, "", ""),
    ("session sales / volume", 0.1, "", ""),
    ("close buys / auction volume", 0.1, "", ""),
    ("close sales / auction volume", 0.1, "", ""),
    ("tot buys / open interest", 0.01, "", ""),
    ("tot buys / market cap", 0.01, "", ""),
    ("session buys / volume 30 days", 0.1, "", ""),
    ("tot sales / open interest", 0.01, "", ""),
    ("tot sales / market cap", 0.01, "", ""),
    ("session sales / volume 30 days", 0.1, "", ""),
]
CATEGORIES = ["future.bond index", "equity", "option"]


def v_rules(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(RULES, "name string, value double, text_value string, category_filter string")


def v_metrics(t: Tables) -> DataFrame:
    """Metric rows: rule name by event_id % 18, value = value / 100, text
    'touched <type>' on every 4th event, category by user_id % 3."""
    names = F.array(*[F.lit(r[0]) for r in RULES])
    cats = F.array(*[F.lit(c) for c in CATEGORIES])
    return t.events.select(
        F.col("event_id"),
        F.element_at(names, (F.col("event_id") % 18 + 1).cast("int")).alias("name"),
        (F.col("value") / 100).alias("value"),
        F.when(F.col("event_id") % 4 == 3, F.concat(F.lit("touched "), F.col("event_type")))
        .otherwise(F.lit("quiet")).alias("text"),
        F.element_at(cats, (F.col("user_id") % 3 + 1).cast("int")).alias("category"),
    )


# --- audit and logs (L1-L10) ----------------------------------------------

def v_audit(t: Tables) -> DataFrame:
    """Query-log rows: one per event."""
    e = t.events
    table = F.when(F.col("event_id") % 3 == 0, F.lit("sample_table")).otherwise(F.lit("other_table"))
    return e.select(
        F.col("ts").alias("event_time"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 16).cast("string")).alias("address"),
        F.concat(F.lit("host-"), (F.col("user_id") % 7).cast("string")).alias("client_hostname"),
        F.concat(F.lit("SELECT "), F.col("event_type"), F.lit(" FROM "), table).alias("query"),
        F.concat(F.lit("db."), F.col("event_type")).alias("table_name"),
        F.floor(F.col("value") * 100).alias("read_rows"),
        (F.col("event_id") % 5 + 1).cast("int").alias("read_parts"),
        F.when(F.col("event_id") % 6 == 0, F.lit("ExceptionWhileProcessing")).otherwise(F.lit("QueryFinish")).alias("type"),
    )


def v_sessions(t: Tables) -> DataFrame:
    """Session rows: login = ts, logout one hour later, still open on every 10th."""
    return t.events.select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 16).cast("string")).alias("address"),
        F.concat(F.lit("host-"), (F.col("user_id") % 7).cast("string")).alias("client_hostname"),
        F.col("ts").alias("login_time"),
        F.when(F.col("event_id") % 10 == 0, F.lit(None).cast(NTZ))
        .otherwise(F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("logout_time"),
    )


def v_log_lines(t: Tables) -> DataFrame:
    """Log lines: file = pod of the user, line_no = event_id (increasing with
    time), line = '<ts> <TYPE> <props>'."""
    return t.events.select(
        F.concat(F.lit("pod-"), F.col("user_id").cast("string")).alias("file"),
        F.col("event_id").alias("line_no"),
        F.concat_ws(" ", ts_text(F.col("ts")), F.upper("event_type"), F.col("props")).alias("line"),
    )


def v_task_replies(t: Tables) -> DataFrame:
    """Failed-task replies ``map<worker, map<task_id, info>>``, one per event."""
    worker = F.concat(
        F.when(F.col("user_id") % 3 == 0, F.lit("worker@queue-")).otherwise(F.lit("worker@host-")),
        F.col("user_id").cast("string"),
    )
    task = F.create_map(F.concat(F.lit("task-"), F.col("event_id").cast("string")), F.col("event_type"))
    return t.events.select(F.create_map(worker, task).alias("failed"))


# --- cluster usage (O1-O7) --------------------------------------------------

def v_containers(t: Tables) -> DataFrame:
    """Container rows from lineitem: pod = order, container = line number."""
    li = t.lineitem
    q = F.floor("l_quantity")
    ln = F.col("l_linenumber")
    none = F.lit(None).cast("string")
    return li.select(
        F.concat(F.lit("ns-"), F.lower("l_returnflag")).alias("namespace"),
        F.concat(F.lit("pod-"), F.col("l_orderkey").cast("string")).alias("pod"),
        F.when(F.col("l_orderkey") % 17 == 0, none)
        .otherwise(F.concat(F.lit("node-"), (F.col("l_orderkey") % 10).cast("string"))).alias("node"),
        F.concat(F.lit("c"), ln.cast("string")).alias("container"),
        F.when(ln % 5 == 0, none).otherwise(F.concat(F.col("l_partkey").cast("string"), F.lit("m"))).alias("cpu_request"),
        F.when(ln % 5 == 0, none).otherwise(F.concat((F.col("l_partkey") * 2).cast("string"), F.lit("m"))).alias("cpu_limit"),
        F.concat(q.cast("string"), F.lit("Mi")).alias("mem_request"),
        F.concat((q * 2).cast("string"), F.lit("Mi")).alias("mem_limit"),
        F.when(ln % 3 == 0, F.concat((F.col("l_partkey") * 1000).cast("string"), F.lit("n")))
        .when(ln % 3 == 1, F.concat(F.col("l_partkey").cast("string"), F.lit("u")))
        .otherwise((F.col("l_partkey") % 4).cast("string")).alias("cpu_usage"),
        F.when(ln == 7, F.concat(q.cast("string"), F.lit("M")))
        .when(ln % 4 == 0, F.concat((q * 1024).cast("string"), F.lit("Ki")))
        .when(ln % 4 == 1, F.concat(q.cast("string"), F.lit("Mi")))
        .when(ln % 4 == 2, F.concat(q.cast("string"), F.lit("Gi")))
        .otherwise((q * 1000).cast("string")).alias("mem_usage"),
        (F.col("l_linestatus") == "F").alias("ready"),
    )


def v_usage(t: Tables) -> DataFrame:
    """Usage rows of the containers: none for every 13th order's pod, and some for pods
    that are not listed."""
    c = v_containers(t).select("namespace", "pod", "container", "cpu_usage", "mem_usage")
    key = F.substring("pod", 5, 20).cast("bigint")
    gone = c.where(key % 19 == 0).withColumn("pod", F.concat(F.lit("gone-"), F.col("pod")))
    return c.where(key % 13 != 0).unionByName(gone)


def v_nodes(t: Tables) -> DataFrame:
    """Nodes from suppliers (s_suppkey % 12): nodes 10 and 11 get no pods."""
    n = t.supplier.groupBy(F.concat(F.lit("node-"), (F.col("s_suppkey") % 12).cast("string")).alias("node")).agg(
        F.count(F.lit(1)).alias("_n"))
    return n.select(
        "node",
        (F.col("_n") * 4.0).alias("cpu_capacity"),
        (F.col("_n") * 8 * 1024**3).alias("mem_capacity"),
        (F.col("_n") * 3.6).alias("cpu_allocatable"),
        (F.col("_n") * 7 * 1024**3).alias("mem_allocatable"),
    )


# --- layouts (B1, B2, S11) ----------------------------------------------------

def v_layout(t: Tables) -> DataFrame:
    """lineitem as sensor rows: event_date = ship date, date_int = yyyymmdd,
    sensor_id = l_suppkey, value = l_quantity."""
    d = F.to_date("l_shipdate")
    return t.lineitem.select(
        d.alias("event_date"),
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_int"),
        F.col("l_suppkey").alias("sensor_id"),
        F.col("l_quantity").alias("value"),
    )


# --- marts (M1-M9) -------------------------------------------------------------

def _mart_sql(priority: str) -> str:
    return ("SELECT o_custkey, count(*) AS orders, sum(o_totalprice) AS total_price FROM orders "
            f"WHERE o_orderpriority = '{priority}' GROUP BY o_custkey")


# name, target, query, depends_on, chunk column, chunk size, concurrency, enabled, cron
MART_ROWS = [
    ("1-URGENT", "mart_urgent", _mart_sql("1-URGENT"), [], "o_custkey", 100, 4, 1, "*/15 * * * *"),
    ("2-HIGH", "mart_high", _mart_sql("2-HIGH"), ["1-URGENT"], "o_custkey", 100, 2, 1, "0 * * * *"),
    ("3-MEDIUM", "mart_medium", _mart_sql("3-MEDIUM"), [], None, None, 1, 1, "0 * * * *"),
    ("4-NOT SPECIFIED", "mart_unspecified", _mart_sql("4-NOT SPECIFIED"), ["3-MEDIUM"], None, None, 1, 0, "0 6 * * *"),
    ("5-LOW", "mart_low", _mart_sql("5-LOW"), ["4-NOT SPECIFIED"], None, None, 1, 1, "0 6 * * *"),
    ("customer_360", "mart_customer_360",
     "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer", ["1-URGENT", "2-HIGH"], "c_custkey", 250, 4, 1, "0 2 * * *"),
    ("weekly_rollup", "mart_weekly", "SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey",
     ["customer_360"], None, None, 1, 1, "0 3 * * 1"),
    ("legacy_export", "mart_legacy", "SELECT * FROM nation", [], None, None, 1, 0, "0 4 * * *"),
]
MART_SCHEMA = ("datamart_name string, target_table string, query string, depends_on array<string>, "
               "chunk_column string, chunk_size bigint, concurrency int, enabled int, schedule_cron string")


MART_SCHEMA_NAMES = [f.split()[0] for f in MART_SCHEMA.split(", ")]


def v_marts(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(MART_ROWS, MART_SCHEMA)


def v_mart_log(t: Tables) -> DataFrame:
    """Run log from orders: one run per order; F -> success, O -> failed, P -> running."""
    st = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed") \
        .when(F.col("o_orderstatus") == "P", "running")
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.col("o_orderpriority").alias("datamart_name"),
        st.alias("status"),
        F.col("o_orderdate").alias("end_time"),
    )


# --- log records (K1-K6, S7) ------------------------------------------------------

def v_log(t: Tables) -> DataFrame:
    """Log records: partition = user_id % 4, offset = event_id (increasing with
    time inside a partition, gaps allowed as after compaction), every 50th
    payload unreadable."""
    return t.events.select(
        F.lit("events").alias("topic"),
        (F.col("user_id") % 4).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("key"),
        F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("{broken "), F.col("props")))
        .otherwise(F.col("props")).alias("value"),
    )


# --- key-value data (D1-D9) --------------------------------------------------------

def v_dict(t: Tables) -> DataFrame:
    """Dict-in-a-string rows: props (NULL on every 13th, 'hello' on every 11th),
    looked up by 'k' (even ids) or 'z' (odd ids)."""
    e = t.events
    d = F.when(F.col("event_id") % 13 == 0, F.lit(None).cast("string")) \
        .when(F.col("event_id") % 11 == 0, F.lit("hello")).otherwise(F.col("props"))
    return e.select(
        F.col("event_id").alias("id"),
        d.alias("dict_column"),
        F.when(F.col("event_id") % 2 == 0, F.lit("k")).otherwise(F.lit("z")).alias("filter_key"),
    )


def _s(c) -> F.Column:
    return F.col(c).cast("string")


def v_kv(t: Tables) -> DataFrame:
    """One dotted-key dictionary built from customer, nation and region:
    ``c<n>.nation -> n<k>`` (prefix reference), ``n<k>.region -> r<j>``,
    ``c<n>.tags`` a list literal, ``c<n>.ref`` / ``n<k>.capital`` / ``r<j>.peer``
    whole-key references, and cycles through ``r<j>.hq -> c<j>`` and the peers."""
    c, n, r = t.customer, t.nation, t.region

    def kv(df, key, value):
        return df.select(key.alias("key"), value.alias("value"))

    ck = F.concat(F.lit("c"), _s("c_custkey"))
    nk = F.concat(F.lit("n"), _s("c_nationkey"))
    parts = [
        kv(c, F.concat(ck, F.lit(".name")), F.col("c_name")),
        kv(c, F.concat(ck, F.lit(".nation")), nk),
        kv(c, F.concat(ck, F.lit(".segment")), F.col("c_mktsegment")),
        kv(c, F.concat(ck, F.lit(".tags")),
           F.concat(F.lit('["'), F.col("c_mktsegment"), F.lit('", "n'),
                    ((F.col("c_nationkey") + 1) % 25).cast("string"), F.lit('"]'))),
        kv(c, F.concat(ck, F.lit(".ref")),
           F.concat(nk, F.when(F.col("c_custkey") % 2 == 0, F.lit(".name")).otherwise(F.lit(".capital")))),
        kv(n, F.concat(F.lit("n"), _s("n_nationkey"), F.lit(".name")), F.col("n_name")),
        kv(n, F.concat(F.lit("n"), _s("n_nationkey"), F.lit(".region")), F.concat(F.lit("r"), _s("n_regionkey"))),
        kv(n, F.concat(F.lit("n"), _s("n_nationkey"), F.lit(".capital")),
           F.concat(F.lit("r"), _s("n_regionkey"), F.lit(".name"))),
        kv(n, F.concat(F.lit("n"), _s("n_nationkey"), F.lit(".capital.city")),
           F.concat(F.lit("CITY_"), _s("n_nationkey"))),
        kv(r, F.concat(F.lit("r"), _s("r_regionkey"), F.lit(".name")), F.col("r_name")),
        kv(r, F.concat(F.lit("r"), _s("r_regionkey"), F.lit(".hq")), F.concat(F.lit("c"), _s("r_regionkey"))),
        kv(r, F.concat(F.lit("r"), _s("r_regionkey"), F.lit(".peer")),
           F.concat(F.lit("r"), ((F.col("r_regionkey") + 1) % 5).cast("string"), F.lit(".peer"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def v_tree(t: Tables) -> DataFrame:
    """Nested dictionaries, one per customer, as ``(entity, path, value)``."""
    c = t.customer
    ent = F.concat(F.lit("c"), _s("c_custkey"))

    def row(path, value):
        return c.select(ent.alias("entity"), F.array(*[F.lit(p) for p in path]).alias("path"), value.alias("value"))

    parts = [
        row(["profile", "name"], F.col("c_name")),
        row(["profile", "segment"], F.col("c_mktsegment")),
        row(["user.nation"], F.concat(F.lit("n"), _s("c_nationkey"))),
        row(["user.balance"], F.col("c_acctbal").cast("decimal(12,2)").cast("string")),
        row(["ignore.internal", "seq"], _s("c_custkey")),
        row(["tags", "ignore.me"], F.lit("x")),
        row(["tags", "user.segment"], F.col("c_mktsegment")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def v_wide_source(t: Tables) -> DataFrame:
    """Per order: ``price_<line>`` and ``volume_<line>`` entries. Line numbers
    repeat within an order in this data, so an entry sums its lines (a key is
    unique in a dictionary)."""
    li = t.lineitem
    ent = F.col("l_orderkey").alias("entity")
    p = li.select(ent, F.concat(F.lit("price_"), _s("l_linenumber")).alias("key"), F.col("l_extendedprice").alias("value"))
    v = li.select(ent, F.concat(F.lit("volume_"), _s("l_linenumber")).alias("key"), F.col("l_quantity").alias("value"))
    return p.unionByName(v).groupBy("entity", "key").agg(F.sum("value").alias("value"))


# --- file ingestion (F1-F11) ---------------------------------------------------------

def v_files(t: Tables) -> DataFrame:
    """One '/share/<source>_<doc_id>.csv' per document, in doc_id order; after these, an
    '.xlsx' that the reader does not handle beside every 25th document, and an empty file
    beside each document labelled quality 0."""
    d = t.documents.join(t.labels.select("doc_id", "quality", "toxic"), "doc_id", "left")

    def entries(rows, infix, ext, first, text, toxic):
        path = F.concat(F.lit("/share/"), F.col("source"), F.lit(infix), _s("doc_id"), F.lit(ext))
        return rows.select(path.alias("file_path"), (F.col("doc_id") + first).alias("file_order"), text.alias("text"), toxic.alias("toxic"))

    none, no = F.lit(None).cast("string"), F.lit(0)
    return (entries(d, "_", ".csv", 0, F.col("text"), F.coalesce("toxic", no))
            .unionByName(entries(d.where(F.col("doc_id") % 25 == 0), "_", ".xlsx", 10**9, none, no))
            .unionByName(entries(d.where(F.col("quality") == 0), "_empty_", ".csv", 2 * 10**9, none, no)))


def v_file_lines(files: DataFrame) -> DataFrame:
    """Lines of the non-empty files: (file_path, line_no from 0, line)."""
    return files.where(F.col("text").isNotNull()).select(
        "file_path", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


# Routing rules (order, regex on the base name, target).
ROUTE_RULES = [(1, "src1.*", "public.one"), (2, "src[02-9].*", "public.rest")]
EXISTING_VERSIONS = [("public.one", 3)]
RUN_TS = "2024-02-01 00:00:00"


def v_route_rules(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(ROUTE_RULES, "rule_order int, regex string, target_table string")


def v_existing_versions(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(EXISTING_VERSIONS, "target_table string, _version_id int")


# --- delimited files and quality (Q1-Q5) -----------------------------------------------

def v_control(t: Tables) -> DataFrame:
    """Control text per part: even sizes declare ';' and '"' (lower case when
    the size is a multiple of 4), odd sizes declare neither."""
    p = t.part
    infile = F.concat(F.lit("LOAD DATA INFILE 'f"), _s("p_partkey"), F.lit(".txt' INTO TABLE parts "))
    upper = F.lit("FIELDS TERMINATED BY ';' OPTIONALLY ENCLOSED BY '\"'")
    lower = F.lit("fields terminated by ';' optionally enclosed by '\"'")
    clause = F.when(F.col("p_size") % 4 == 0, lower).when(F.col("p_size") % 2 == 0, upper).otherwise(F.lit(""))
    return p.select(F.col("p_partkey").alias("file_id"), F.concat(infile, clause).alias("ctl_config"))


# table, field, check, expected (text; allowed values separated by '|')
CONSTRAINT_ROWS = [
    ("customer", "c_custkey", "type", "int"),
    ("customer", "c_custkey", "min", "0"),
    ("customer", "c_custkey", "no_duplicates", "true"),
    ("customer", "c_custkey", "max_nulls", "0"),
    ("customer", "c_acctbal", "min", "0"),
    ("customer", "c_acctbal", "max", "10000"),
    ("customer", "c_acctbal", "sign", "non-negative"),
    ("customer", "c_mktsegment", "allowed_values", "AUTOMOBILE|BUILDING|FURNITURE|HOUSEHOLD|MACHINERY"),
    ("customer", "c_mktsegment", "min_length", "5"),
    ("customer", "c_mktsegment", "max_length", "10"),
    ("customer", "c_name", "rex", "^Customer#[0-9]{9}$"),
    ("customer", "c_name", "no_duplicates", "true"),
    ("lineitem", "l_quantity", "type", "real"),
    ("lineitem", "l_quantity", "min", "1"),
    ("lineitem", "l_quantity", "max", "50"),
    ("lineitem", "l_discount", "max", "0.1"),
    ("lineitem", "l_discount", "sign", "non-negative"),
    ("lineitem", "l_returnflag", "allowed_values", "A|N|R"),
    ("lineitem", "l_shipdate", "type", "date"),
    ("lineitem", "l_shipdate", "max_nulls", "0"),
    ("lineitem", "l_orderkey", "no_duplicates", "true"),
    ("lineitem", "l_shipdate", "min", "1990-01-01"),
    ("lineitem", "l_shipdate", "max", "1995-01-01"),
    ("customer", "c_name", "min", "Customer#"),
    ("customer", "c_mktsegment", "max", "BUILDING"),
    ("customer", "c_name", "rex", '^"?Customer"?#'),
    ("customer", "c_acctbal", "min", "not a number"),
    ("customer", "c_name", "sign", "positive"),
]
CONSTRAINT_FILE = "constraints/quarry_checks.yaml"


def v_constraints(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(CONSTRAINT_ROWS, "table_name string, field string, check string, expected string")
