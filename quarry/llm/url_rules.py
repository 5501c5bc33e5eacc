"""Allow and block lists for urls, as a sort-merge range join.

A host is written with its labels reversed and closed by a dot (``a.example.net`` becomes
``net.example.a.``), so a rule's host covers one interval of keys: from ``net.example.`` up
to ``net.example/`` (the character after the dot). Intervals of two rules are nested or
apart. Urls and rules are cut into the same key ranges; within a range a sweep in key order
keeps a stack of the rules that are open, so each url sees only rules that cover its host.

A range starts at a sampled url key followed by a hash of the id, so one url or host with a
third of all rows is spread over many ranges. A rule goes to each range that it overlaps:
at most its nested chain at each boundary besides its own range.

Defined results: a null url, or one without ``://``, has an empty host and path and no
rule. A rule fits its host and all subdomains if the url's path starts with the rule's; the
longest rule text wins (then the longer host). Rules repeated with other verdicts: block
wins. Rules with a null host, path or verdict are ignored. Without a rule the verdict is
``default``. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: keys sampled per range, for the boundaries (the driver sorts RANGES x this many keys at most)
SAMPLES_PER_RANGE = 40
ROWS_PER_RANGE = 200_000


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    whole = F.coalesce(F.regexp_extract(rest, r"(?s)^([^?#]*)", 1), F.lit(""))
    host = F.regexp_extract(whole, r"(?s)^([^/]*)", 1)
    path = F.regexp_extract(whole, r"(?s)^[^/]*(.*)$", 1)
    return F.translate(host, _UPPER, _LOWER), path


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _sweep(batches: Iterator[pd.DataFrame], default: str) -> Iterator[pd.DataFrame]:
    """Rows sorted by (range, key, rules first) in; each url row out with its rule and verdict."""
    part_now = None
    stack: list[tuple[str, str, list]] = []  # (key, end, rules of that host), each inside the one before
    for rows in batches:
        rules, verdicts = [], []
        columns = (rows[c] for c in ("part", "key", "is_url", "path", "end", "host", "verdict"))
        for part, key, is_url, path, end, host, verdict in zip(*columns, strict=True):
            if part != part_now:
                stack, part_now = [], part
            while stack and stack[-1][1] <= key:
                stack.pop()
            if not is_url:
                if not stack or stack[-1][0] != key:
                    stack.append((key, end, []))
                stack[-1][2].append((len(host) + len(path), len(host), verdict == "block", path, host + path, verdict))
                continue
            fits = (rule for _, _, held in stack for rule in held if path.startswith(rule[3]))
            best = max(fits, default=None)
            rules.append(best[4] if best else None)
            verdicts.append(best[5] if best else default)
        urls = rows.loc[rows["is_url"], ["page_id", "host", "path"]]
        if len(urls):
            yield urls.assign(rule=pd.Series(rules, urls.index, object), verdict=pd.Series(verdicts, urls.index, object))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", n_ranges: int | None = None) -> DataFrame:
    """``rules`` has host, path and verdict (allow or block). Returns page_id, host, path,
    rule, verdict, one row per row of ``pages``."""
    spark = pages.sparkSession
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_path(F.col("url"))
    urls = urls.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.select("page_id", "host", "path", reversed_host(F.col("host")).alias("key"))
    known = rules.where("host is not null and path is not null and verdict is not null")
    known = known.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").distinct()
    known = known.select("host", "path", "verdict", reversed_host(F.col("host")).alias("key"))
    known = known.withColumn("end", F.expr("concat(substring(key, 1, length(key) - 1), '/')"))

    total = pages.count()
    n = n_ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // ROWS_PER_RANGE + 1)
    tie = F.lower(F.hex(F.xxhash64("page_id", "path")))
    spot = F.concat_ws("\x00", "key", tie)  # \x00 sorts before all that a longer key may add
    share = min(1.0, n * SAMPLES_PER_RANGE / max(total, 1))
    sample = sorted(r[0] for r in urls.sample(False, share, 7).select(spot).collect())
    bounds = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []

    @F.pandas_udf("int")
    def part_of(spots: pd.Series) -> pd.Series:
        return spots.map(lambda s: bisect_right(bounds, s)).astype("int32")

    last = F.lit(len(bounds))
    left = urls.select(
        part_of(spot).alias("part"), "key", F.lit(True).alias("is_url"), "path", F.lit("").alias("end"), "host", F.lit("").alias("verdict"), "page_id"
    )
    spread = known.select("*", F.explode(F.sequence(part_of("key"), F.least(part_of("end"), last))).alias("part"))
    right = spread.select("part", "key", F.lit(False).alias("is_url"), "path", "end", "host", "verdict", F.lit(None).cast(urls.schema["page_id"].dataType).alias("page_id"))
    both = left.unionByName(right).repartition(n, "part").sortWithinPartitions("part", "key", "is_url")

    kind = urls.schema["page_id"].dataType.simpleString()
    return both.mapInPandas(lambda rows: _sweep(rows, default), f"page_id {kind}, host string, path string, rule string, verdict string")


#: the rules of the registered query (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


OP2_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^?#]*)', 1, 's') ELSE '' END AS rest
  FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/]*(.*)$', 1, 's') AS path
  FROM u
), r(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT p.page_id, p.host, p.path, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(rverdict, length(rhost || rpath)) AS v
  FROM p LEFT JOIN r ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)
  GROUP BY p.page_id, p.host, p.path
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m
"""
