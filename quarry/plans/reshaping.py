"""Registered key-value reshaping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import dict_lookup, glob_to_regex
from quarry.operators import kv
from quarry.plans import fixtures as fx
from quarry.plans.registry import query

KV = """
kv AS (
  SELECT 'c' || c_custkey || '.name' AS key, c_name AS value FROM customer
  UNION ALL SELECT 'c' || c_custkey || '.nation', 'n' || c_nationkey FROM customer
  UNION ALL SELECT 'c' || c_custkey || '.segment', c_mktsegment FROM customer
  UNION ALL SELECT 'c' || c_custkey || '.tags', '["' || c_mktsegment || '", "n' || ((c_nationkey + 1) % 25) || '"]' FROM customer
  UNION ALL SELECT 'c' || c_custkey || '.ref',
                   'n' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN '.name' ELSE '.capital' END FROM customer
  UNION ALL SELECT 'n' || n_nationkey || '.name', n_name FROM nation
  UNION ALL SELECT 'n' || n_nationkey || '.region', 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'n' || n_nationkey || '.capital', 'r' || n_regionkey || '.name' FROM nation
  UNION ALL SELECT 'n' || n_nationkey || '.capital.city', 'CITY_' || n_nationkey FROM nation
  UNION ALL SELECT 'r' || r_regionkey || '.name', r_name FROM region
  UNION ALL SELECT 'r' || r_regionkey || '.hq', 'c' || r_regionkey FROM region
  UNION ALL SELECT 'r' || r_regionkey || '.peer', 'r' || ((r_regionkey + 1) % 5) || '.peer' FROM region),
items AS (
  SELECT key, CAST(generate_subscripts(lst, 1) - 1 AS INTEGER) AS idx, unnest(lst) AS item FROM (
    SELECT key, CASE WHEN value LIKE '[%]' AND json_valid(value) THEN from_json(value, '["VARCHAR"]')
                     ELSE [value] END AS lst
    FROM kv))"""

CLOSURE_EXCLUDE = ["*.segment", "r?.peer"]
EXCL = " OR ".join(f"regexp_full_match(key, '{glob_to_regex(g)}')" for g in CLOSURE_EXCLUDE)


@query(
    "dynamic_lookup",
    """
    WITH d AS (
      SELECT event_id AS id,
             CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'hello' ELSE props END AS dict_column,
             CASE WHEN event_id % 2 = 0 THEN 'k' ELSE 'z' END AS filter_key
      FROM events)
    SELECT id, dict_column, filter_key,
           CASE WHEN json_valid(dict_column) AND json_type(dict_column) = 'OBJECT'
                THEN json_extract_string(dict_column, '$."' || filter_key || '"') END AS filtered_value
    FROM d""",
)
def dynamic_lookup(t):
    """D1."""
    d = fx.v_dict(t)
    return d.withColumn("filtered_value", dict_lookup(F.col("dict_column"), F.col("filter_key")))


@query(
    "related_closure",
    "WITH RECURSIVE" + KV + f""",
    allowed AS (SELECT key, split_part(key, '.', 1) AS prefix FROM kv WHERE NOT ({EXCL})),
    clos(start_key, key) AS (
      SELECT key, key FROM allowed WHERE key LIKE 'c%.nation'
      UNION
      SELECT c.start_key, a.key FROM clos c JOIN items i ON i.key = c.key JOIN allowed a ON a.prefix = i.item)
    SELECT clos.start_key, clos.key, kv.value FROM clos JOIN kv USING (key)""",
)
def related_closure(t):
    """From every customer's 'c<n>.nation' key, excluding '*.segment' and 'r?.peer'."""
    d = fx.v_kv(t)
    starts = d.where(F.col("key").like("c%.nation")).select(F.col("key").alias("start_key"))
    return kv.related_closure(d, starts, CLOSURE_EXCLUDE)


@query(
    "reference_closure",
    "WITH RECURSIVE" + KV + """,
    clos(start_key, key) AS (
      SELECT key, key FROM kv WHERE key LIKE 'c%.ref'
      UNION
      SELECT c.start_key, k.key FROM clos c JOIN items i ON i.key = c.key JOIN kv k ON k.key = i.item)
    SELECT clos.start_key, clos.key, kv.value FROM clos JOIN kv USING (key)""",
)
def reference_closure(t):
    """D3: from every customer's 'c<n>.ref' key."""
    d = fx.v_kv(t)
    starts = d.where(F.col("key").like("c%.ref")).select(F.col("key").alias("start_key"))
    return kv.reference_closure(d, starts)


TREE = """
tree AS (
  SELECT 'c' || c_custkey AS entity, p.path, p.value FROM customer,
  LATERAL (VALUES (['profile', 'name'], c_name), (['profile', 'segment'], c_mktsegment),
                  (['user.nation'], 'n' || c_nationkey),
                  (['user.balance'], CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR)),
                  (['ignore.internal', 'seq'], CAST(c_custkey AS VARCHAR)),
                  (['tags', 'ignore.me'], 'x'), (['tags', 'user.segment'], c_mktsegment)) AS p(path, value))"""

PRUNE = ["ignore.*"]
PRUNE_SQL = f"list_bool_or(list_transform(path, lambda s: regexp_full_match(s, '{glob_to_regex(PRUNE[0])}')))"


@query(
    "prune_by_glob",
    "WITH" + TREE + f" SELECT entity, array_to_string(path, '/') AS path, value FROM tree WHERE NOT {PRUNE_SQL}",
)
def prune_by_glob(t):
    """Drop entries under keys matching 'ignore.*' at any depth."""
    p = kv.prune_by_glob(fx.v_tree(t), PRUNE)
    return p.select("entity", F.array_join("path", "/").alias("path"), "value")


@query(
    "strip_prefix",
    "WITH" + TREE + f"""
    SELECT entity, array_to_string(list_transform(path, lambda s: CASE WHEN starts_with(s, 'user.') THEN s[6:] ELSE s END), '/') AS path,
           value
    FROM tree WHERE NOT {PRUNE_SQL}""",
)
def strip_prefix(t):
    """Strip 'user.' at every depth after excluding 'ignore.*'."""
    p = kv.strip_prefix(fx.v_tree(t), "user.", PRUNE)
    return p.select("entity", F.array_join("path", "/").alias("path"), "value")


LINES = [str(i) for i in range(1, 8)]


@query(
    "prefix_to_wide",
    "SELECT l_orderkey AS entity, "
    + ", ".join(f"sum(l_extendedprice) FILTER (WHERE l_linenumber = {i}) AS \"{i}\"" for i in LINES)
    + " FROM lineitem GROUP BY l_orderkey",
    LINES,
)
def prefix_to_wide(t):
    """D6: 'price_<line>' entries -> one row per order, one column per line."""
    return kv.prefix_to_wide(fx.v_wide_source(t), "price_")


@query("list_literal", "WITH" + KV + " SELECT key, idx, item FROM items")
def list_literal(t):
    """Every value as a list (list-literal text parsed, scalars wrapped)."""
    return kv.list_items(fx.v_kv(t))


@query(
    "nest_dotted",
    "WITH" + KV + """
    SELECT split_part(key, '.', 1) AS "group",
           CASE WHEN position('.' IN key) > 0 THEN substr(key, position('.' IN key) + 1) ELSE '' END AS subpath, value
    FROM kv""",
)
def nest_dotted(t):
    """D8 (long form; ``kv.nested_json`` gives the nested form)."""
    return kv.nest_dotted(fx.v_kv(t))


@query(
    "resolve_references",
    "WITH" + KV + """,
    nested AS (
      SELECT split_part(key, '.', 1) AS "group",
             CASE WHEN position('.' IN key) > 0 THEN substr(key, position('.' IN key) + 1) ELSE '' END AS subpath, value
      FROM kv),
    prefixes AS (
      SELECT key, value, array_to_string(string_split(key, '.')[1:i], '.') AS prefix
      FROM kv, range(1, len(string_split(key, '.'))) AS r(i)),
    attached AS (
      SELECT DISTINCT p.prefix AS "group", substr(p.key, length(p.prefix) + 2) AS subpath, p.value
      FROM prefixes p JOIN items i ON i.item = p.prefix AND i.key <> p.key)
    SELECT * FROM nested UNION SELECT * FROM attached""",
)
def resolve_references(t):
    """D9 (long form)."""
    return kv.resolve_references(fx.v_kv(t))
