"""Key-value reshaping (D1-D9) on long tables.

A dictionary is stored as rows ``(key, value)`` (plus ``entity`` when a table
holds many dictionaries); a list value is list-literal text
``'["a", "b"]'`` whose items ``list_items`` explodes into ``(key, idx, item)``.
Nested dictionaries are rows ``(entity, path, value)`` with ``path`` the list
of keys from the root.

The two closures are fixpoint loops of joins over the distinct values met
(not over every start): each hop joins the newest pairs to the edges, drops
repeats and pairs already reached (``left_anti``), and each round checkpoints what it found
into the shared checkpoint folder so the plan stays short. The loop ends when a round adds nothing; it always ends because
the reached set only grows and is finite, so there is no round cap that could
cut results short.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import list_literal, matches_any_glob
from quarry.session import shared_dir


def list_items(kv: DataFrame) -> DataFrame:
    """D7 on a long table: ``(key, value)`` -> ``(key, idx, item)``."""
    return kv.select("key", F.posexplode(list_literal(F.col("value"))).alias("idx", "item"))


def first_segment(c) -> F.Column:
    return F.split(c, r"\.", 2).getItem(0)


HOPS_PER_ROUND = 3
RUNS_PER_TIER = 4
PAIR = ["seed", "node"]


class Reached:
    """Pairs reached so far, in checkpointed runs. A tier that has RUNS_PER_TIER runs becomes
    one run of the next, so what a hop is compared with are a few runs, however many
    rounds there were, and a pair is rewritten only as often as tiers grow."""

    def __init__(self):
        self.runs: list[tuple[int, DataFrame]] = []

    def add(self, pairs: DataFrame) -> None:
        self.runs.append((0, pairs))
        tier = 0
        while sum(t == tier for t, _ in self.runs) >= RUNS_PER_TIER:
            merged = self._union([f for t, f in self.runs if t == tier]).repartition(*PAIR).checkpoint()
            self.runs = [r for r in self.runs if r[0] != tier] + [(tier + 1, merged)]
            tier += 1

    @staticmethod
    def _union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def all(self) -> DataFrame:
        return self._union([f for _, f in self.runs])

    def minus(self, pairs: DataFrame) -> DataFrame:
        """What of ``pairs`` is new."""
        return pairs.join(self.all(), PAIR, "left_anti")


def _fixpoint(seeds: DataFrame, edges: DataFrame, max_rounds: int | None = None, hops: int = HOPS_PER_ROUND) -> DataFrame:
    """Pairs (seed, node) of all nodes that edges ``(node, next)`` lead to from each seed, the
    seed itself included.

    Semi-naive: every hop follows the pairs that the hop before found, without repeats and
    without those reached in earlier rounds, so a hop makes at most new pairs x a node's edges.
    A round is ``hops`` hops in one job, whose new pairs are checkpointed (reliably, so a lost
    executor does not send the job back to round one); it ends when a round finds nothing.
    A node that many seeds reach and that has many edges is split by AQE's skew join."""
    frontier = seeds.select(F.col("node").alias("seed"), "node").distinct().checkpoint()
    reached, rounds = Reached(), 0
    reached.add(frontier)
    while True:
        found, at = [], frontier
        for _ in range(hops):
            at = reached.minus(at.join(edges, "node").select("seed", F.col("next").alias("node")).distinct())
            found.append(at)
        frontier = Reached._union(found).distinct().checkpoint()
        if frontier.isEmpty():
            return reached.all()
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError(f"closure did not converge in {max_rounds} rounds")
        reached.add(frontier)


def _start_nodes(starts: DataFrame, keys: DataFrame, items: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(starts that are keys, the nodes ``(start_key, node)`` that their own values name)."""
    known = starts.select("start_key").distinct().join(keys.select(F.col("key").alias("start_key")).distinct(), "start_key", "left_semi")
    first = known.join(items.select(F.col("key").alias("start_key"), F.col("item").alias("node")), "start_key")
    return known, first.join(nodes, "node", "left_semi").distinct().checkpoint()


def related_closure(kv: DataFrame, starts: DataFrame, exclude: Sequence[str] | None = None,
                    max_rounds: int | None = None) -> DataFrame:
    """For every start key, the keys reached by following string values (or
    list items) to every key whose first dotted segment equals them. Excluded
    keys are neither kept nor followed; a start that is not a key reaches
    nothing. Returns ``(start_key, key, value)``.

    The walk goes over first segments, not keys: a segment leads to the segments that the
    values of its keys name. So a segment with a million keys is one node, what a value reaches
    is found once for all starts that hold it, and keys are joined once at the end."""
    shared_dir(kv.sparkSession)  # makes sure a checkpoint folder is set
    allowed = kv.select("key", "value").where(~matches_any_glob(F.col("key"), exclude))
    index = allowed.select(first_segment(F.col("key")).alias("node"), "key", "value").checkpoint()
    items = list_items(index).select("key", "item").where("item is not null")
    nodes = index.select("node").distinct()
    named = items.join(nodes.withColumnRenamed("node", "item"), "item", "left_semi")
    edges = named.select(first_segment(F.col("key")).alias("node"), F.col("item").alias("next")).distinct().checkpoint()
    known, first = _start_nodes(starts, index, items, nodes)
    per_node = _fixpoint(first.select("node"), edges, max_rounds)
    reached = first.withColumnRenamed("node", "seed").join(per_node, "seed").select("start_key", "node").distinct()
    # a start is among its own keys; it is added where no reached segment brings it
    own = known.withColumn("node", first_segment(F.col("start_key"))).join(reached, ["start_key", "node"], "left_anti")
    own_rows = own.join(index.drop("node"), F.col("start_key") == F.col("key")).select("start_key", "key", "value")
    return reached.join(index, "node").select("start_key", "key", "value").unionByName(own_rows)


def reference_closure(kv: DataFrame, starts: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """D3: for every start key, the keys whose whole name equals a value (or list
    item) reached from it, recursively. Returns ``(start_key, key, value)``."""
    shared_dir(kv.sparkSession)
    rows = kv.select("key", "value").checkpoint()
    items = list_items(rows).select("key", "item").where("item is not null")
    nodes = rows.select(F.col("key").alias("node")).distinct()
    edges = items.select(F.col("key").alias("node"), F.col("item").alias("next")).join(
        nodes.withColumnRenamed("node", "next"), "next", "left_semi").distinct().checkpoint()
    known, first = _start_nodes(starts, rows, items, nodes)
    per_node = _fixpoint(first.select("node"), edges, max_rounds)
    reached = first.withColumnRenamed("node", "seed").join(per_node, "seed").select("start_key", F.col("node").alias("key"))
    own = known.select("start_key", F.col("start_key").alias("key"))
    return reached.unionByName(own).distinct().join(rows, "key").select("start_key", "key", "value")


def prune_by_glob(tree: DataFrame, exclude: Sequence[str]) -> DataFrame:
    """Drop every entry under a key (at any depth) that matches a glob.
    Containers left empty disappear with their last row."""
    hit = F.exists(F.col("path"), lambda seg: matches_any_glob(seg, exclude))
    return tree.where(~hit)


def strip_prefix(tree: DataFrame, prefix: str, exclude: Sequence[str] | None = None) -> DataFrame:
    """After glob exclusion, remove ``prefix`` from every key at every depth."""
    t = prune_by_glob(tree, exclude) if exclude else tree
    n = len(prefix)
    path = F.transform("path", lambda seg: F.when(seg.startswith(prefix), seg.substr(n + 1, 1 << 30)).otherwise(seg))
    return t.withColumn("path", path)


def strip_prefix_map(m, prefix: str, exclude: Sequence[str] | None = None):
    """D5 on a flat ``map<string, …>`` column: ``map_filter`` then ``transform_keys``."""
    kept = F.map_filter(m, lambda k, v: ~matches_any_glob(k, exclude)) if exclude else m
    n = len(prefix)
    return F.transform_keys(kept, lambda k, v: F.when(k.startswith(prefix), k.substr(n + 1, 1 << 30)).otherwise(k))


def prefix_to_wide(kv: DataFrame, prefix: str, names: Sequence[str] | None = None) -> DataFrame:
    """Keys starting with ``prefix`` become one wide row per entity, the
    prefix stripped: every such key of the data is a column. A list of ``names``
    (stripped keys), if given, selects some."""
    n = len(prefix)
    k = kv.where(F.col("key").startswith(prefix)).withColumn("key", F.col("key").substr(n + 1, 1 << 30))
    return k.groupBy("entity").pivot("key", list(names) if names is not None else None).agg(F.first("value"))


def nest_dotted(kv: DataFrame) -> DataFrame:
    """D8, long form: ``a.b.c`` -> group ``a``, path ``b.c``."""
    parts = F.split("key", r"\.", 2)
    return kv.select(parts.getItem(0).alias("group"),
                     F.coalesce(parts.getItem(1), F.lit("")).alias("subpath"), "value")


def _proper_prefixes(key: Column) -> Column:
    """Every proper dotted prefix of a key: ``a.b.c`` -> ``[a, a.b]``."""
    parts = F.split(key, r"\.")
    steps = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.array_join(F.slice(parts, 1, i), "."))


def nested_json(kv: DataFrame) -> DataFrame:
    """D8, nested form: one row per first part of the keys, with what lies below it nested
    to full depth as JSON (``a.b.c`` -> group ``a``, ``{"b":{"c":…}}``; a key without a dot
    is its value). Built level by level by :func:`rebuild_json`, so a grouping holds one
    node's children. A key that is also a prefix of others keeps its value under ``""``."""
    inner = kv.select(F.explode(_proper_prefixes(F.col("key"))).alias("key")).distinct().withColumn("_inner", F.lit(True))
    parts = F.split("key", r"\.")
    path = F.when(F.coalesce("_inner", F.lit(False)), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    tree = kv.join(inner, "key", "left").select(path.getItem(0).alias("entity"), F.slice(path, 2, F.size(path)).alias("path"), "value")

    def as_json(value):
        listed = F.ltrim(value).startswith("[")
        return F.when(listed, F.to_json(list_literal(value))).otherwise(_json_text(value))

    return rebuild_json(tree, as_json).select(F.col("entity").alias("group"), "json")


def key_prefixes(kv: DataFrame) -> DataFrame:
    """Every proper dotted prefix of every key: ``a.b.c`` -> ``a``, ``a.b``."""
    return kv.select("key", "value", F.explode(_proper_prefixes(F.col("key"))).alias("prefix"))


def resolve_references(kv: DataFrame) -> DataFrame:
    """D9, long form: the nested groups (D8) plus, for every value or list item
    ``v`` equal to a dotted prefix of another key, that key's remainder
    attached under the name ``v``.

    References are first reduced per value (how many keys refer to it, and the
    key when only one does), so a value referenced by very many keys is one row
    before the join."""
    items = list_items(kv.select("key", "value")).select(F.col("item").alias("prefix"), F.col("key").alias("ref"))
    n_refs = items.groupBy("prefix").agg(F.count_distinct("ref").alias("n_refs"))
    only = items.join(n_refs.where(F.col("n_refs") == 1), "prefix").select("prefix", F.col("ref").alias("only_ref"))
    refs = n_refs.join(only.distinct(), "prefix", "left")
    pref = key_prefixes(kv)
    att = pref.join(refs, "prefix").where((F.col("n_refs") > 1) | (F.col("key") != F.col("only_ref")))
    attached = att.select(F.col("prefix").alias("group"),
                          F.expr("substr(key, length(prefix) + 2)").alias("subpath"), "value")
    return nest_dotted(kv).unionByName(attached).distinct()


def _json_text(c) -> F.Column:
    """A string as a JSON string literal (quotes and escapes)."""
    enc = F.to_json(F.array(c))
    return enc.substr(F.lit(2), F.length(enc) - 2)


def rebuild_json(tree: DataFrame, as_json=_json_text) -> DataFrame:
    """D4/D5 nested form: ``(entity, path, value)`` rows back into one JSON object
    per entity, keys sorted. Built bottom-up, one grouping per depth level;
    each group is one node's children (a dictionary's fan-out), never a whole
    table. ``as_json`` writes a value. The depth is one scalar read from the data. An output row holds a
    whole dictionary, so this is for dictionaries of bounded size; the long
    form is the representation that scales (the registered queries return it)."""
    depth = tree.select(F.max(F.size("path"))).first()[0] or 0
    cur = tree.select("entity", "path", as_json(F.col("value").cast("string")).alias("json"))
    for d in range(depth, 0, -1):
        at = cur.where(F.size("path") == d)
        member = F.concat(_json_text(F.element_at("path", -1)), F.lit(":"), F.col("json"))
        parent = at.groupBy("entity", F.slice("path", 1, d - 1).alias("path")).agg(
            F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(member)), ","), F.lit("}")).alias("json"))
        cur = cur.where(F.size("path") != d).unionByName(parent)
    return cur.where(F.size("path") == 0).select("entity", "json")
