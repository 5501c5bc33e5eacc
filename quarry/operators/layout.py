"""Date keys and table layouts (B1, B2, S3).

B1 writes one table four ways (by a date or by an int date key, sorted by either) and counts
the same closed date range on each; the counts must agree. Folders are months, so their number
does not grow with the days; inside, rows are sorted by the layout's day and then its order, so
that the Parquet statistics of row groups skip the other days. Each scan prunes months
(``PartitionFilters``) and pushes the day range down (``PushedFilters``).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# (name, day column, sort columns)
LAYOUTS = [
    ("date_part_date_order", "event_date", ["event_date", "sensor_id"]),
    ("date_part_int_order", "event_date", ["date_int", "sensor_id"]),
    ("int_part_date_order", "date_int", ["event_date", "sensor_id"]),
    ("int_part_int_order", "date_int", ["date_int", "sensor_id"]),
]


def date_to_key(d: Column) -> Column:
    """B2: date -> ``yyyymmdd`` int."""
    return F.date_format(d, "yyyyMMdd").cast("int")


def key_to_date(k: Column) -> Column:
    """B2: ``yyyymmdd`` int -> date (parsed as text, SURVEY 2.11 #19)."""
    return F.to_date(k.cast("string"), "yyyyMMdd")


def generate_rows(spark: SparkSession, n: int, base_date: str = "2024-01-01", days: int = 365,
                  sensors: int = 1000) -> DataFrame:
    """S3: ``n`` synthetic rows: date = base + id % days, sensor = id % sensors,
    value from a hash of the id (repeatable, unlike rand())."""
    r = spark.range(n)
    d = F.date_add(F.lit(base_date).cast("date"), (F.col("id") % days).cast("int"))
    return r.select(
        d.alias("event_date"),
        (F.col("id") % sensors).cast("int").alias("sensor_id"),
        (F.abs(F.xxhash64("id")) % 1_000_000 / 1_000_000.0).alias("value"),
    )


def month_of(part: str) -> Column:
    """The month (``yyyymm``) of a date or of an int date key."""
    if part == "date_int":
        return F.expr("date_int div 100").cast("int")
    return (F.year(part) * 100 + F.month(part)).cast("int")


def write_layout(df: DataFrame, path: str, part: str, order: list[str]) -> None:
    """One layout: month folders, rows in each file sorted by day and ``order``. ``rebalance``
    lets AQE split a month, or a single day, that holds much over several tasks and files of
    the advisory size, and write small months by one task."""
    (df.withColumn("month", month_of(part)).hint("rebalance", "month")
     .sortWithinPartitions("month", part, *[c for c in order if c != part])
     .write.mode("overwrite").partitionBy("month").parquet(path))


def write_layouts(df: DataFrame, base_path: str) -> dict[str, str]:
    """Write ``event_date, date_int, sensor_id, value`` rows in the four layouts,
    as four concurrent Spark jobs."""
    paths = {name: f"{base_path.rstrip('/')}/{name}" for name, _, _ in LAYOUTS}

    def write(layout):
        name, part, order = layout
        write_layout(df, paths[name], part, order)

    with ThreadPoolExecutor(max_workers=len(LAYOUTS)) as pool:
        list(pool.map(write, LAYOUTS))
    return paths


def range_count(spark: SparkSession, name: str, path: str, lo: str, hi: str) -> DataFrame:
    """Count rows with the date in ``[lo, hi]``: date layouts filter the date,
    int layouts filter the int key, as a user of each layout would; months prune folders."""
    t = spark.read.parquet(path)
    part = dict((n, p) for n, p, _ in LAYOUTS)[name]
    first, last = int(lo.replace("-", "")), int(hi.replace("-", ""))
    if part == "event_date":
        cond = F.col("event_date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))
    else:
        cond = F.col("date_int").between(first, last)
    months = F.col("month").between(first // 100, last // 100)
    return t.where(months & cond).agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(name).alias("table_name"), "cnt")


def layout_range_counts(spark: SparkSession, paths: dict[str, str], lo: str, hi: str) -> DataFrame:
    """B1: the four range counts as one result (one union plan; each branch
    reads only the partitions inside the range). The four tables' file
    listings are done concurrently up front."""
    with ThreadPoolExecutor(max_workers=len(paths)) as pool:
        counts = list(pool.map(lambda kv: range_count(spark, kv[0], kv[1], lo, hi), paths.items()))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
