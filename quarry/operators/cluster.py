"""Cluster usage rollups (O3-O7) over container rows

``namespace, pod, node, container, cpu_request, cpu_limit, mem_request,
mem_limit, cpu_usage, mem_usage, ready`` (quantities as text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.quantities import cpu_cores, memory_bytes


def container_quantities(c: DataFrame) -> DataFrame:
    """O1 + O2 on every quantity column."""
    return c.select(
        "namespace", "pod", "node", "container", "ready",
        *[cpu_cores(F.col(k)).alias(k) for k in ("cpu_request", "cpu_limit", "cpu_usage")],
        *[memory_bytes(F.col(k)).alias(k) for k in ("mem_request", "mem_limit", "mem_usage")],
    )


def pod_usage(c: DataFrame) -> DataFrame:
    """O3: container usage summed per (namespace, pod)."""
    q = c.select("namespace", "pod", cpu_cores(F.col("cpu_usage")).alias("cpu_usage"), memory_bytes(F.col("mem_usage")).alias("mem_usage"))
    return q.groupBy("namespace", "pod").agg(
        F.sum("cpu_usage").alias("cpu_usage"), F.sum("mem_usage").cast("bigint").alias("mem_usage")
    )


def pod_requests(c: DataFrame) -> DataFrame:
    """Request and limit sums per pod; an absent value counts 0; pods not
    yet placed on a node are skipped."""
    q = container_quantities(c).where(F.col("node").isNotNull())
    return q.groupBy("namespace", "pod", "node").agg(
        F.sum(F.coalesce("cpu_request", F.lit(0.0))).alias("cpu_request"),
        F.sum(F.coalesce("cpu_limit", F.lit(0.0))).alias("cpu_limit"),
        F.sum(F.coalesce("mem_request", F.lit(0))).cast("bigint").alias("mem_request"),
        F.sum(F.coalesce("mem_limit", F.lit(0))).cast("bigint").alias("mem_limit"),
    )


def pod_usage_join(pods: DataFrame, usage: DataFrame) -> DataFrame:
    """Placed pods with their requests (O4), left-joined to the usage rows summed per
    pod (O3); a pod without usage has 0, usage without a pod is left out."""
    used = pod_usage(usage).select("namespace", "pod", "cpu_usage", "mem_usage")
    return pod_requests(pods).join(used, ["namespace", "pod"], "left").select(
        "namespace", "pod", "node", "cpu_request", "cpu_limit", "mem_request", "mem_limit",
        F.coalesce("cpu_usage", F.lit(0.0)).alias("cpu_usage"),
        F.coalesce("mem_usage", F.lit(0)).cast("bigint").alias("mem_usage"),
    )


def node_pods(nodes: DataFrame, pods: DataFrame, usage: DataFrame) -> DataFrame:
    """O6, long form: every node with capacity and allocatable, one row per pod
    placed on it; a node without pods keeps one row with NULL pod columns."""
    pods = pod_usage_join(pods, usage)
    return nodes.join(pods, "node", "left").select(
        "node", "cpu_capacity", "mem_capacity", "cpu_allocatable", "mem_allocatable",
        "namespace", "pod", "cpu_request", "mem_request", "cpu_usage", "mem_usage",
    )


def node_rollup(nodes: DataFrame, pods: DataFrame, usage: DataFrame) -> DataFrame:
    """O6, nested form: one row per node with the sorted list of its pods
    (``[]`` when none). The list is bounded by the scheduler's pods-per-node
    limit, so collecting it per node is safe."""
    long = node_pods(nodes, pods, usage)
    pod = F.struct("namespace", "pod", "cpu_request", "mem_request", "cpu_usage", "mem_usage")
    return long.groupBy("node", "cpu_capacity", "mem_capacity", "cpu_allocatable", "mem_allocatable").agg(
        F.coalesce(F.sort_array(F.collect_list(F.when(F.col("pod").isNotNull(), pod))),
                   F.array()).alias("pods")
    )


def pod_readiness(c: DataFrame) -> DataFrame:
    """Per pod, its containers and whether all are ready (a pod without
    containers is ready). Containers per pod are few (a pod spec)."""
    return c.groupBy("namespace", "pod").agg(
        F.array_join(F.sort_array(F.collect_list("container")), ",").alias("containers"),
        F.count("container").alias("n_containers"),
        F.coalesce(F.bool_and("ready"), F.lit(True)).alias("ready"),
    )
