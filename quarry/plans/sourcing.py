"""Registered source/sink (S1-S13) and streaming (T17, T18, F12) queries.

Side-effecting operators write into a fresh folder under the shared
checkpoint folder and return what they wrote, read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import profile as pf
from quarry.operators.monitoring import settings_side
from quarry.plans import fixtures as fx
from quarry.plans.registry import query
from quarry.plans.tick_marts import BARS, DAILY, MINUTE
from quarry.session import scratch_path
from quarry.sources import files as fs
from quarry.sources import objects, sinks
from quarry.streaming import ingest as ist
from quarry.streaming import ticks as tst

LINEITEM_DOUBLES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CUSTOMER_TYPES = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double",
                  "c_mktsegment": "string"}


@query("read_by_extension", "SELECT * FROM customer", ["c_acctbal"])
def read_by_extension(t):
    """Customer exported as '.csv' and read back by extension (header,
    inferred types, then the table's types)."""
    path = scratch_path(t.spark, "export") + "/customer.csv"
    t.customer.write.option("header", "true").csv(path)
    return pf.apply_schema(fs.read_by_extension(t.spark, path), CUSTOMER_TYPES)


@query(
    "file_manifest",
    """SELECT o_orderstatus AS folder, count(*) AS rows,
              CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + length(CAST(o_custkey AS VARCHAR)) + 2) AS BIGINT) AS bytes,
              true AS timed, CAST(NULL AS VARCHAR) AS error FROM orders GROUP BY 1
    UNION ALL SELECT 'missing', 0, 0, false, 'PATH_NOT_FOUND'""",
)
def file_manifest(t):
    """S2 (+ S1): orders exported as CSV folders per status, and a folder that does not
    exist. The manifest's lengths, times and errors, added up per folder, with the rows read
    from the listed files."""
    base = scratch_path(t.spark, "manifest")
    t.orders.select("o_orderkey", "o_custkey", "o_orderstatus").write.partitionBy("o_orderstatus").csv(base)
    m = fs.file_manifest(t.spark, [base, base + "_missing"], regex=r"\.csv$")
    data = t.spark.read.schema("o_orderkey bigint, o_custkey bigint").csv(base).select(F.regexp_extract("_metadata.file_path", "[^/]+/[^/]+$", 0).alias("file"))
    in_file = data.groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    name = F.when(F.col("path").isNull(), "missing").otherwise(F.regexp_extract("path", "o_orderstatus=([^/]+)/", 1))
    entries = m.select(name.alias("folder"), F.regexp_extract("error", r"\[([A-Z_]+)", 1).alias("error"), F.regexp_extract("path", "[^/]+/[^/]+$", 0).alias("file"), "length", "modification_time")
    return entries.join(in_file, "file", "left").groupBy("folder", "error").agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
            F.bool_and(F.col("modification_time").isNotNull()).alias("timed"))


@query(
    "import_folder",
    """SELECT 'region' AS table_name, r_regionkey AS key, r_name AS name FROM region
    UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier""",
)
def import_folder(t):
    """Region, nation and supplier exported to one folder, imported as
    views; the rows of all three views are returned."""
    base = scratch_path(t.spark, "dbexport")
    for name in ("region", "nation", "supplier"):
        t.read(name).write.parquet(f"{base}/{name}")
    out = None
    for name in fs.import_folder(t.spark, base):
        rows = t.spark.table(name)
        key, label = rows.columns[:2]
        rows = rows.select(F.lit(name).alias("table_name"), F.col(key).cast("bigint").alias("key"), F.col(label).alias("name"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("relocate_prefix", "SELECT * FROM orders", ["o_totalprice"])
def relocate_prefix(t):
    """The files of orders (partitioned by status) copied as objects from one prefix to
    another with the relative keys kept, read back from the new prefix."""
    base = scratch_path(t.spark, "relocate")
    src, dst = f"{base}/src/orders", f"{base}/dst/orders"
    t.orders.write.partitionBy("o_orderstatus").parquet(src)
    fs.relocate_objects(t.spark, src, dst)
    return t.spark.read.schema(t.orders.schema).parquet(dst).select(*t.orders.columns)


@query("typed_rows_source", "SELECT * FROM events", ["value"])
def typed_rows_source(t):
    """Events as JSON rows read with a fixed schema."""
    path = scratch_path(t.spark, "jsonrows")
    fmt = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    t.events.write.options(**fmt).json(path)
    return fs.typed_rows_source(t.spark, path, t.events.schema, **fmt)


@query("append_autocreate", "SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem", LINEITEM_DOUBLES)
def append_autocreate(t):
    """A missing table is created from the frame's schema, then appended to twice."""
    base = scratch_path(t.spark, "append")
    name = "lineitem_copy_" + base.rsplit("-", 1)[1]
    sinks.append_autocreate(t.lineitem, name, base)
    sinks.append_autocreate(t.lineitem, name, base)
    return t.spark.table(name)


@query("append_refresh", "SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem", LINEITEM_DOUBLES)
def append_refresh(t):
    """Three refresh runs in append mode accumulate."""
    base = scratch_path(t.spark, "appendrefresh")
    name = "lineitem_runs_" + base.rsplit("-", 1)[1]
    for _ in range(3):
        sinks.append_refresh(t.lineitem, name, base)
    return t.spark.table(name)


@query("full_refresh_swap", "SELECT l_orderkey, l_linenumber, lower(l_returnflag) AS flag FROM lineitem")
def full_refresh_swap(t):
    """The table is built, then rebuilt into a new folder and switched;
    readers see the second build only."""
    base = scratch_path(t.spark, "swap")
    name = "lineitem_swap_" + base.rsplit("-", 1)[1]
    sinks.full_refresh_swap(t.lineitem, name, base)
    sinks.full_refresh_swap(t.lineitem.select("l_orderkey", "l_linenumber", F.lower("l_returnflag").alias("flag")), name, base)
    return t.spark.table(name)


@query(
    "partitioned_write",
    "SELECT *, CAST(strftime(o_orderdate, '%Y%m') AS INTEGER) AS order_month FROM orders",
    ["o_totalprice"],
)
def partitioned_write(t):
    """Orders partitioned by an int month key, sorted by customer inside
    each file, read back."""
    path = scratch_path(t.spark, "partitioned")
    df = t.orders.withColumn("order_month", F.date_format("o_orderdate", "yyyyMM").cast("int"))
    sinks.partitioned_write(df, path, ["order_month"], ["o_custkey", "o_orderkey"])
    return t.spark.read.parquet(path).select(*df.columns)


# Where each strategy leaves the rows.
PLACES = [("none", "inbox"), ("compress", "inbox"), ("compress", "inbox gz"), ("move", "archive"),
          ("move_and_compress", "inbox"), ("move_and_compress", "archive gz")]


@query(
    "postprocess_inputs",
    "SELECT strategy, place, customer.* FROM customer, (VALUES " + ", ".join(f"('{s}', '{p}')" for s, p in PLACES) + ") AS v(strategy, place)",
    ["c_acctbal"],
)
def postprocess_inputs(t):
    """Customer lands as JSON files once per strategy, the strategy runs on them; the rows
    found afterwards in inbox and archive, plain and compressed."""
    base = scratch_path(t.spark, "postprocess")
    out = None
    for strategy in objects.STRATEGIES:
        inbox, archive = f"{base}/{strategy}/inbox", f"{base}/{strategy}/archive"
        t.customer.write.json(inbox)
        objects.postprocess(fs.file_manifest(t.spark, [inbox]).select("path", "length"), strategy, archive)
        for place, folder, glob in (("inbox", inbox, "*.json"), ("inbox gz", inbox, "*.gz"), ("archive", archive, "*.json"), ("archive gz", archive, "*.gz")):
            if sinks.exists(t.spark, folder):
                found = t.spark.read.schema(t.customer.schema).option("pathGlobFilter", glob).json(folder).select(F.lit(strategy).alias("strategy"), F.lit(place).alias("place"), "*")
                out = found if out is None else out.unionByName(found)
    return out


def _run_arrivals(t, run_stream, waves: int = 4) -> None:
    """Ticks land in ``waves`` appends, the second of which comes last and so is late; after each landing the
    stream runs once (``availableNow``) and, through its checkpoint, picks up
    only the newly landed files, as a scheduled job would."""
    path = scratch_path(t.spark, "landing")
    ticks = fx.v_ticks(t)
    lo = ticks.select(F.min("timestamp")).scalar()
    hi = ticks.select(F.max("timestamp")).scalar()
    span = F.timestamp_diff("SECOND", lo, hi) + 1
    wave = F.floor(F.timestamp_diff("SECOND", lo, F.col("timestamp")) * waves / span)
    for w in [0, *range(2, waves), 1]:
        ticks.where(wave == w).write.mode("append").parquet(path)
        run_stream(t.spark.readStream.schema(ticks.schema).parquet(path))


@query("tick_minute_stream", "WITH" + MINUTE + " SELECT * FROM minute", BARS)
def tick_minute_stream(t):
    """Minute bars maintained over 4 arrival waves, one of them late;
    equals the batch T2 result."""
    base = scratch_path(t.spark, "t17")
    _run_arrivals(t, lambda s: tst.run_minute_stream(s, f"{base}/bars", f"{base}/_checkpoint"))
    return tst.current_minute_bars(t.spark, f"{base}/bars")


@query("tick_cascade_stream", "WITH" + DAILY + " SELECT * FROM daily", ["avg_price", "sum_price", "wavg_price"])
def tick_cascade_stream(t):
    """Daily marts refreshed level by level from each of 4 arrival waves; equals T5."""
    base = scratch_path(t.spark, "t18")
    _run_arrivals(t, lambda s: tst.run_cascade_stream(s, f"{base}/marts", f"{base}/_checkpoint"))
    return tst.current_mart(t.spark, f"{base}/marts", "daily")


# Routing rule for the Spark-written part files of F12, files per wave.
STREAM_RULES = [(1, "part-.*", "public.docs")]
FILES = 16


@query(
    "incremental_ingest",
    f"""
    WITH parts AS (SELECT doc_id % 3 AS w, doc_id // 3 % {FILES} AS f, doc_id, string_split(text, chr(10)) AS p FROM documents),
    l AS (
      SELECT w, f, row_number() OVER (PARTITION BY w, f ORDER BY doc_id, i) - 1 AS line_no, line
      FROM (SELECT w, f, doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS line FROM parts)),
    fp AS (
      SELECT w, f, md5(CAST(count(*) AS VARCHAR) || ':' || CAST(sum(CAST(CAST(('0x' || substr(md5(CAST(line_no AS VARCHAR) || ':' || line), 1, 15)) AS BIGINT) AS DECIMAL(38,0))) AS VARCHAR)) AS h
      FROM l GROUP BY w, f)
    SELECT 'public.docs' AS target_table, line_no, line, CAST(w AS INTEGER) AS wave, h AS _file_hash, 1 AS versions, w = 2 AS newest_wave,
           TIMESTAMP '""" + fx.RUN_TS + """' AS _load_timestamp
    FROM l JOIN fp USING (w, f)""",
)
def incremental_ingest(t):
    """documents land as several text files per wave, in three waves that hit one target;
    each run ingests only the files it has not seen. Files of one wave have no order of their
    own, so their versions are given as the wave they fall in and the number of versions that
    a file's lines have; the latest version lies in the last wave."""
    base = scratch_path(t.spark, "f12")
    inbox, out, ckpt = f"{base}/inbox", f"{base}/out", f"{base}/_checkpoint"
    rules = t.spark.createDataFrame(STREAM_RULES, "rule_order int, regex string, target_table string")
    for wave in range(3):
        docs = t.documents.where(F.col("doc_id") % 3 == wave).withColumn("part", F.expr(f"doc_id div 3 % {FILES}"))
        files = docs.repartitionById(FILES, F.col("part").cast("int")).sortWithinPartitions("part", "doc_id")
        files.select("part", "text").write.mode("append").partitionBy("part").text(inbox)
        ist.run_incremental(t.spark, inbox, rules, out, ckpt, fx.RUN_TS)
    rows = ist.loaded_rows(t.spark, out)
    of_file = rows.groupBy("_file_hash").agg(F.count_distinct("_version_id").cast("int").alias("versions"))
    newest = rows.where("_is_latest").select(F.expr(f"max(_version_id - 1) div {FILES}")).scalar()
    wave = F.expr(f"(_version_id - 1) div {FILES}")
    return rows.join(settings_side(of_file), "_file_hash").select("target_table", "line_no", "line", wave.cast("int").alias("wave"), "_file_hash", "versions",
                                                   (wave == newest).alias("newest_wave"), "_load_timestamp")
