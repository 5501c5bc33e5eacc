"""Logs and audit trails.

Log lines are rows ``(file, line_no, line)``; audit rows are query-log and
session-log shaped. Per-file results are plain aggregations (partial per task,
so one very large file does not land whole in one task); the tail of a file
is a ``row_number`` filter that Spark turns into a per-task group limit before
the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.monitoring import reference_time

# The error words searched for in log lines (case-insensitive).
ERROR_WORDS = ["error", "exception", "failed", "traceback"]
ERROR_PATTERN = "(?i)(" + "|".join(ERROR_WORDS) + ")"


def error_scan(lines: DataFrame, pattern: str = ERROR_PATTERN) -> DataFrame:
    """L1: per file, whether any line matches, and the first matching line.
    Every file is scanned (SURVEY 2.11 #20)."""
    hit = F.col("line").rlike(pattern)
    # numeric aggregates only (hash aggregation, partial per task); the first hit's text
    # comes from a group limit of one line per file and task, then one row per file
    per_file = lines.groupBy("file").agg(
        F.bool_or(hit).alias("has_error"),
        F.min(F.when(hit, F.col("line_no"))).alias("first_hit_line_no"),
    )
    first = F.row_number().over(Window.partitionBy("file").orderBy("line_no"))
    hits = lines.where(hit).withColumn("_rn", first).where(F.col("_rn") == 1).select("file", F.col("line").alias("first_hit"))
    return per_file.join(hits, "file", "left").select("file", "first_hit_line_no", "has_error", "first_hit")


def tail_lines(lines: DataFrame, n: int = 100) -> DataFrame:
    """L2: the last ``n`` lines of every file. ``row_number() <= n`` lets the
    optimizer keep at most ``n`` rows per file in each task before shuffling
    (WindowGroupLimit), so a huge file sends only ``n`` rows per task."""
    w = Window.partitionBy("file").orderBy(F.col("line_no").desc())
    return lines.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def name_contains(sources: DataFrame, text: str, col: str = "file") -> DataFrame:
    """L3: keep sources whose name contains ``text``."""
    return sources.where(F.col(col).contains(text))


def user_address_activity(audit: DataFrame) -> DataFrame:
    """L4: per user and address: query count, first and last seen; busiest first."""
    return (
        audit.groupBy("user", "address")
        .agg(F.count(F.lit(1)).alias("queries"), F.min("event_time").alias("first_seen"),
             F.max("event_time").alias("last_seen"))
        .orderBy(F.col("queries").desc())
    )


def recent_matching_queries(audit: DataFrame, like: str, n: int = 10) -> DataFrame:
    """Newest ``n`` queries whose text is LIKE ``like`` (top-k: a per-task
    take-ordered, then one merge of k rows per task)."""
    return (
        audit.where(F.col("query").like(like))
        .select("event_time", "user", "address", "client_hostname", "query")
        .orderBy(F.col("event_time").desc(), "user", "address", "client_hostname", "query")
        .limit(n)
    )


def recent_sessions(sessions: DataFrame, n: int = 10) -> DataFrame:
    """Newest ``n`` sessions by login time."""
    return (
        sessions.select("user", "address", "client_hostname", "login_time", "logout_time")
        .orderBy(F.col("login_time").desc(), "user", "address", "client_hostname", "logout_time")
        .limit(n)
    )


def open_sessions(sessions: DataFrame, as_of=None) -> DataFrame:
    """Sessions without logout at ``as_of`` (default: latest login), with
    seconds elapsed, longest first."""
    ref = reference_time(sessions, "login_time", as_of)
    return (
        sessions.where(F.col("logout_time").isNull() & (F.col("login_time") <= ref))
        .select("user", "address", "client_hostname", "login_time",
                F.timestamp_diff("SECOND", F.col("login_time"), ref).alias("elapsed_sec"))
        .orderBy(F.col("elapsed_sec").desc())
    )


def read_work_report(log: DataFrame, like: str, seconds: int = 300, as_of=None) -> DataFrame:
    """Finished queries of the last ``seconds`` matching ``like``: rows and
    parts read per table."""
    ref = reference_time(log, "event_time", as_of)
    return (
        log.where((F.col("type") == "QueryFinish") & F.col("query").like(like)
                  & (F.col("event_time") > ref - F.make_dt_interval(secs=F.lit(seconds))))
        .groupBy("table_name")
        .agg(F.sum("read_rows").alias("rows_read"), F.sum("read_parts").cast("bigint").alias("parts_read"))
    )


def failed_tasks(inspect: DataFrame, queue: str) -> DataFrame:
    """Flatten ``map<worker, map<task_id, info>>`` replies and keep workers
    whose name contains ``queue``."""
    w = inspect.select(F.explode("failed").alias("worker", "tasks")).where(F.col("worker").contains(queue))
    return w.select("worker", F.explode("tasks").alias("task_id", "info"))
