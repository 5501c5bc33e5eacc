"""Feed monitoring (P1-P11): typed status rows, per-name thresholds, KPIs,
status colours, recent errors, latency series and pivot, run states, stream
freshness and rule breaches.

Reference times are explicit parameters (default: the latest time in the
input), so a result never depends on the wall clock.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_WARNING = 5
DEFAULT_CRITICAL = 10


def feed_rows(raw: DataFrame) -> DataFrame:
    """Cast the status feed: last_refresh timestamp, latency double, errors int."""
    return raw.select(
        F.col("name").cast("string").alias("name"),
        F.col("last_refresh").cast("timestamp_ntz").alias("last_refresh"),
        F.col("latency").cast("double").alias("latency"),
        F.col("errors").cast("int").alias("errors"),
    )


def upsert_thresholds(current: DataFrame, edits: DataFrame) -> DataFrame:
    """P2 upsert: edited (name, warning, critical) rows replace stored ones.
    Both sides are small config tables (one row per feed name)."""
    both = current.withColumn("_p", F.lit(0)).unionByName(edits.withColumn("_p", F.lit(1)))
    w = Window.partitionBy("name").orderBy(F.col("_p").desc())
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_p")


#: rows up to which a list of settings is broadcast
MOST_SETTINGS = 100_000


def settings_side(settings: DataFrame) -> DataFrame:
    """A join's side of settings: broadcast if it has at most MOST_SETTINGS rows, which is
    counted first; a longer list is joined as the planner likes."""
    return F.broadcast(settings) if settings.limit(MOST_SETTINGS + 1).count() <= MOST_SETTINGS else settings


def with_thresholds(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Attach warning/critical per name, 5/10 where no row exists. The
    threshold table holds one row per feed name (broadcast while it is short)."""
    th = thresholds.select("name", "warning", "critical")
    return rows.join(settings_side(th), "name", "left").select(
        *[rows[c] for c in rows.columns],
        F.coalesce(th["warning"], F.lit(DEFAULT_WARNING)).alias("warning"),
        F.coalesce(th["critical"], F.lit(DEFAULT_CRITICAL)).alias("critical"),
    )


def feed_thresholds(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """P2 per name: the thresholds that apply."""
    return with_thresholds(rows.select("name").distinct(), thresholds)


def status_colour(latency: Column, warning: Column, critical: Column) -> Column:
    """Strictly above critical -> red, strictly above warning -> orange."""
    return F.when(latency > critical, "red").when(latency > warning, "orange").otherwise("green")


def feed_status(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """P4 per row: latency colour, and the v1 error colour (errors > 0 -> red)."""
    r = with_thresholds(rows, thresholds)
    return r.select(
        "name", "last_refresh", "latency", "errors",
        status_colour(F.col("latency"), F.col("warning"), F.col("critical")).alias("status"),
        F.when(F.col("errors") > 0, "red").otherwise("green").alias("error_status"),
    )


def feed_kpis(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """One row: total rows, error sum (v1), failing rows (v2), rows above their
    own critical threshold (looked up by name, SURVEY 2.11 #12), mean latency."""
    r = with_thresholds(rows, thresholds)
    return r.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum("errors").cast("bigint").alias("error_sum"),
        F.count_if(F.col("errors") > 0).alias("failing_rows"),
        F.count_if(F.col("latency") > F.col("critical")).alias("high_latency_rows"),
        F.avg("latency").alias("avg_latency"),
    )


def reference_time(df: DataFrame, ts: str, as_of=None) -> Column:
    """``as_of`` as a literal, or the latest ``ts`` of ``df`` as a scalar
    subquery (a partial max per task, no join and no driver round trip)."""
    if as_of is not None:
        return F.lit(as_of).cast("timestamp_ntz")
    return df.select(F.max(ts)).scalar()


def recent_errors(rows: DataFrame, seconds: int = 300, name: str | None = None, as_of=None) -> DataFrame:
    """P5: rows of the last ``seconds`` before ``as_of`` (default: latest row),
    optionally for one feed."""
    ref = reference_time(rows, "last_refresh", as_of)
    out = rows.where(F.col("last_refresh") >= ref - F.make_dt_interval(secs=F.lit(seconds)))
    if name is not None:
        out = out.where(F.col("name") == name)
    return out


def latency_trend(rows: DataFrame) -> DataFrame:
    """(time, name, latency) series, ordered by name and time."""
    return rows.select(F.col("last_refresh").alias("time"), "name", "latency").orderBy("name", "time")


def latency_heatmap(rows: DataFrame, names: Sequence[str] | None = None, bucket: str = "day") -> DataFrame:
    """Time bucket x name -> max latency. One column per name in the data; a list of
    ``names``, if given, selects some."""
    return (
        rows.groupBy(F.date_trunc(bucket, "last_refresh").cast("timestamp_ntz").alias("time"))
        .pivot("name", list(names) if names is not None else None)
        .agg(F.max("latency"))
    )


def feed_names(rows: DataFrame) -> DataFrame:
    """Distinct feed names."""
    return rows.select("name").distinct()


def run_states(runs: DataFrame, as_of=None) -> DataFrame:
    """Runs started since UTC midnight of ``as_of`` (default: latest start);
    minutes running = as_of - start; STARTED over 60 minutes is long-running."""
    ref = reference_time(runs, "start_time", as_of)
    r = runs.where(F.col("start_time") >= F.date_trunc("day", ref).cast("timestamp_ntz"))
    minutes = F.timestamp_diff("MICROSECOND", F.col("start_time"), ref) / 60e6
    state = (
        F.when((F.col("status") == "STARTED") & (minutes > 60), "long-running")
        .when(F.col("status") == "STARTED", "running")
        .when(F.col("status") == "SUCCESS", "success")
        .when(F.col("status") == "FAILURE", "failed")
        .otherwise(F.concat(F.lit("status: "), F.col("status")))
    )
    return r.select("run_id", "pipeline_name", "status", "start_time",
                    minutes.alias("minutes"), state.alias("state"))


def stream_freshness(streams: DataFrame, entries: DataFrame, as_of=None) -> DataFrame:
    """P10: per stream, the time of its latest entry (ms part of an ``ms-seq``
    id) and the lag to ``as_of``; a stream with no entries keeps NULL."""
    tips = entries.groupBy("stream").agg(
        F.max(F.split("entry_id", "-").getItem(0).try_cast("bigint")).alias("_ms")
    )
    ms = entries.select(F.timestamp_millis(F.split("entry_id", "-").getItem(0).try_cast("bigint"))
                        .cast("timestamp_ntz").alias("t"))
    ref = reference_time(ms, "t", as_of)
    out = streams.select("stream").join(tips, "stream", "left")
    latest = F.timestamp_millis("_ms").cast("timestamp_ntz")
    return out.select(
        "stream",
        latest.alias("latest_event_time"),
        ref.alias("current_time"),
        (F.timestamp_diff("MICROSECOND", latest, ref) / 1e6).alias("lag_seconds"),
    )


def rule_breaches(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Join metric rows to their rule by name (rules: a config list, broadcast while
    it is short). A rule with a text value breaches when the text matches that
    pattern; otherwise when value > rule value. ``(not in) X`` exempts category X."""
    r = rules.select(
        F.col("name"), F.col("value").alias("rule_value"), F.col("text_value").alias("rule_text"),
        F.col("category_filter"),
    )
    j = metrics.join(settings_side(r), "name", "inner")
    exempt_cat = F.regexp_extract("category_filter", r"^\(not in\)\s*(.*)$", 1)
    exempt = (F.length(exempt_cat) > 0) & (F.col("category") == exempt_cat)
    has_text = F.coalesce(F.length("rule_text"), F.lit(0)) > 0
    anchored = F.concat(F.lit("^(?:"), F.col("rule_text"), F.lit(")$"))
    text_hit = F.coalesce(F.regexp_like(F.col("text"), anchored), F.lit(False))
    breach = ~exempt & F.when(has_text, text_hit).otherwise(F.col("value") > F.col("rule_value"))
    return j.select("name", "value", "text", "category", "rule_value", "rule_text",
                    breach.alias("breach"))
