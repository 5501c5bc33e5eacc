"""Registered tick-mart queries (T1-T16) and their DuckDB statements."""

from __future__ import annotations

from quarry.operators import ticks as tk
from quarry.plans.fixtures import v_ticks
from quarry.plans.registry import query

# DuckDB side of the fixture view and of the rollup chain.
TICKS = """
ticks AS (
  SELECT event_type AS instrument, value AS price,
         date_trunc('millisecond', ts) AS "timestamp",
         date_trunc('millisecond', ts) + to_milliseconds((event_id * 37) % 5000) AS insertion_timestamp,
         CAST(ts AS DATE) AS t_dt
  FROM events)"""

MINUTE = TICKS + """,
minute AS (
  SELECT instrument, date_trunc('minute', "timestamp") AS ts_min, t_dt,
         count(*) AS trades, avg(price) AS avg_price, sum(price) AS sum_price,
         max(price) AS max_price, min(price) AS min_price
  FROM ticks GROUP BY ALL)"""

FIVE = MINUTE + """,
five AS (
  SELECT instrument, ts_min - to_minutes(CAST(minute(ts_min) % 5 AS BIGINT)) AS ts_5min,
         CAST(sum(trades) AS BIGINT) AS trades, avg(avg_price) AS avg_price, sum(sum_price) AS sum_price,
         max(max_price) AS max_price, min(min_price) AS min_price
  FROM minute GROUP BY ALL)"""

HOURLY = FIVE + """,
hourly AS (
  SELECT instrument, date_trunc('hour', ts_5min) AS ts_hour,
         CAST(sum(trades) AS BIGINT) AS trades, avg(avg_price) AS avg_price, sum(sum_price) AS sum_price,
         max(max_price) AS max_price, min(min_price) AS min_price
  FROM five GROUP BY ALL)"""

DAILY = HOURLY + """,
daily AS (
  SELECT instrument, CAST(ts_hour AS DATE) AS ts_day,
         CAST(sum(trades) AS BIGINT) AS trades, avg(avg_price) AS avg_price, sum(sum_price) AS sum_price,
         sum(sum_price) / sum(trades) AS wavg_price
  FROM hourly GROUP BY ALL)"""

BARS = ["avg_price", "sum_price", "max_price", "min_price"]


def _daily(t):
    return tk.tick_chain(v_ticks(t))


def _hourly(t):
    return tk.tick_hourly(tk.tick_5min(tk.tick_minute(v_ticks(t))))


@query("tick_source", "WITH" + TICKS + " SELECT * FROM ticks", ["price"])
def tick_source(t):
    """Tick rows with the derived partition date."""
    return tk.tick_source(v_ticks(t).drop("t_dt"))


@query("tick_minute", "WITH" + MINUTE + " SELECT * FROM minute", BARS)
def tick_minute(t):
    """T2."""
    return tk.tick_minute(v_ticks(t))


@query("tick_5min", "WITH" + FIVE + " SELECT * FROM five", BARS)
def tick_5min(t):
    """T3."""
    return tk.tick_5min(tk.tick_minute(v_ticks(t)))


@query("tick_hourly", "WITH" + HOURLY + " SELECT * FROM hourly", BARS)
def tick_hourly(t):
    """T4."""
    return _hourly(t)


@query("tick_daily", "WITH" + DAILY + " SELECT * FROM daily", ["avg_price", "sum_price", "wavg_price"])
def tick_daily(t):
    """T5 (flagship: ticks -> minute -> 5 min -> hour -> day)."""
    return _daily(t)


@query(
    "tick_daily_stats",
    "WITH" + HOURLY + """
    SELECT instrument, CAST(ts_hour AS DATE) AS ts_day,
           median(avg_price) AS median_price, stddev_pop(avg_price) AS stddev_price
    FROM hourly GROUP BY ALL""",
    ["median_price", "stddev_price"],
)
def tick_daily_stats(t):
    """T6."""
    return tk.tick_daily_stats(_hourly(t))


@query(
    "tick_latest_price",
    "WITH" + HOURLY + """
    SELECT instrument, CAST(ts_hour AS DATE) AS ts_day, arg_max(avg_price, ts_hour) AS last_avg_price
    FROM hourly GROUP BY ALL""",
    ["last_avg_price"],
)
def tick_latest_price(t):
    """T7."""
    return tk.tick_latest_price(_hourly(t))


@query(
    "tick_rolling_7d",
    "WITH" + DAILY + """
    SELECT instrument, ts_day,
           avg(avg_price) OVER (PARTITION BY instrument ORDER BY ts_day
                                ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS avg_price_7d
    FROM daily""",
    ["avg_price_7d"],
)
def tick_rolling_7d(t):
    """T8."""
    return tk.tick_rolling_7d(_daily(t))


@query(
    "tick_volatility_30d",
    "WITH" + DAILY + """
    SELECT instrument, ts_day,
           stddev_pop(avg_price) OVER (PARTITION BY instrument ORDER BY ts_day
                                       ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS vol_30d
    FROM daily""",
    ["vol_30d"],
)
def tick_volatility_30d(t):
    """T9."""
    return tk.tick_volatility_30d(_daily(t))


@query(
    "tick_extremes",
    "WITH" + DAILY + """
    SELECT instrument, max(avg_price) AS max_avg_price, min(avg_price) AS min_avg_price,
           arg_max(ts_day, avg_price) AS max_day, arg_min(ts_day, avg_price) AS min_day
    FROM daily GROUP BY ALL""",
    ["max_avg_price", "min_avg_price"],
)
def tick_extremes(t):
    """T10."""
    return tk.tick_extremes(_daily(t))


DELTAS = DAILY + """,
deltas AS (
  SELECT instrument, ts_day, avg_price,
         lag(avg_price, 1) OVER w AS prev_day_price,
         avg_price - lag(avg_price, 1) OVER w AS delta_price
  FROM daily WINDOW w AS (PARTITION BY instrument ORDER BY ts_day))"""


@query("tick_deltas", "WITH" + DELTAS + " SELECT * FROM deltas", ["avg_price", "prev_day_price", "delta_price"])
def tick_deltas(t):
    """T11."""
    return tk.tick_deltas(_daily(t))


@query(
    "tick_price_drops",
    "WITH" + DELTAS + """
    SELECT *, delta_price / prev_day_price * 100 AS drop_pct FROM deltas
    WHERE delta_price / prev_day_price * 100 < -5""",
    ["avg_price", "prev_day_price", "delta_price", "drop_pct"],
)
def tick_price_drops(t):
    """T12."""
    return tk.tick_price_drops(tk.tick_deltas(_daily(t)))


@query(
    "tick_daily_ranking",
    "WITH" + DAILY + """
    SELECT ts_day, instrument, trades,
           CAST(rank() OVER (PARTITION BY ts_day ORDER BY trades DESC) AS INTEGER) AS rank
    FROM daily""",
)
def tick_daily_ranking(t):
    """T13."""
    return tk.tick_daily_ranking(_daily(t))


@query(
    "tick_daily_range",
    "WITH" + TICKS + """
    SELECT instrument, t_dt AS ts_day, max(price) - min(price) AS price_range
    FROM ticks GROUP BY ALL""",
    ["price_range"],
)
def tick_daily_range(t):
    """T14."""
    return tk.tick_daily_range(v_ticks(t))


@query(
    "tick_summary",
    "WITH" + DAILY + """
    SELECT instrument, count(*) AS days_count, CAST(sum(trades) AS BIGINT) AS total_trades,
           avg(avg_price) AS long_term_avg_price
    FROM daily GROUP BY ALL""",
    ["long_term_avg_price"],
)
def tick_summary(t):
    """T15."""
    return tk.tick_summary(_daily(t))


@query(
    "tick_latency",
    "WITH" + TICKS + """
    SELECT instrument, "timestamp", insertion_timestamp,
           date_diff('millisecond', "timestamp", insertion_timestamp) AS latency_ms, t_dt
    FROM ticks""",
)
def tick_latency(t):
    """T16."""
    return tk.tick_latency(v_ticks(t))

