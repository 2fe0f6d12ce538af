"""Lineage graphs: reach, impact, anomaly overlay and export.

``nodes``: id, name, node_type, source_id; ``edges``: src, dst, edge_type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.primitives import reach


def downstream(start: DataFrame, edges: DataFrame, max_depth: int = 10) -> DataFrame:
    """(root, id, depth) of nodes fed by the start nodes."""
    return reach(start, edges, max_depth).filter("depth > 0")


def upstream(start: DataFrame, edges: DataFrame, max_depth: int = 10) -> DataFrame:
    """(root, id, depth) of nodes the start nodes are fed by."""
    return reach(start, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), max_depth).filter("depth > 0")


def impact(start: DataFrame, edges: DataFrame, direction: str = "both", max_depth: int = 10) -> DataFrame:
    """(root, upstream_count, downstream_count, total_affected)."""
    none = start.select(F.col("id").alias("root"), F.lit(None).cast("string").alias("way"))
    parts = none
    if direction in ("upstream", "both"):
        parts = parts.unionByName(upstream(start, edges, max_depth).select("root", F.lit("up").alias("way")))
    if direction in ("downstream", "both"):
        parts = parts.unionByName(downstream(start, edges, max_depth).select("root", F.lit("down").alias("way")))
    up, down = F.count_if(F.col("way") == "up"), F.count_if(F.col("way") == "down")
    return parts.groupBy("root").agg(up.alias("upstream_count"), down.alias("downstream_count"), (up + down).alias("total_affected"))


def around(start: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the graph around the start nodes."""
    ids = (start.select("id").unionByName(downstream(start, edges, max_depth).select("id"))
           .unionByName(upstream(start, edges, max_depth).select("id")).distinct())
    inner = (edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
             .join(ids.select(F.col("id").alias("dst")), "dst", "left_semi"))
    return nodes.join(ids, "id", "left_semi"), inner


def status_of(rate: Column) -> Column:
    """unknown, clean, low, medium (5 %), high (15 %)."""
    return (F.when(rate.isNull(), "unknown").when(rate >= 0.15, "high").when(rate >= 0.05, "medium")
            .when(rate > 0, "low").otherwise("clean"))


def with_status(nodes: DataFrame, detections: DataFrame) -> DataFrame:
    """Nodes with the status of their source's latest detection
    (source_id, ts, anomaly_rate). The latest one is found by aggregation."""
    latest = detections.groupBy("source_id").agg(F.max_by("anomaly_rate", "ts").alias("anomaly_rate"), F.max("ts").alias("detected_at"))
    return nodes.join(latest, "source_id", "left").withColumn("status", status_of(F.col("anomaly_rate")))


def impact_severity(source: Column, downstream_status: Column) -> Column:
    amplified = downstream_status.isin("medium", "high")
    return (F.when(amplified, F.when(source == "high", "critical").when(source == "medium", "high").otherwise("medium"))
            .when(source == "high", "high").when(source == "medium", "medium").when(source == "low", "low")
            .when(source == "clean", "none").otherwise("unknown"))


def anomaly_impact(start: DataFrame, nodes: DataFrame, edges: DataFrame, detections: DataFrame, max_depth: int = 10) -> DataFrame:
    """(root, id, depth, status, impact_severity) of the nodes below."""
    state = with_status(nodes, detections).select("id", "status")
    below = downstream(start, edges, max_depth)
    roots = state.select(F.col("id").alias("root"), F.col("status").alias("root_status"))
    return (below.join(roots, "root").join(state, "id")
            .select("root", "id", "depth", "root_status", "status", impact_severity(F.col("root_status"), F.col("status")).alias("impact_severity")))


def overall_severity(impacts: DataFrame) -> DataFrame:
    """(root, impacted, overall): worst severity, raised by numbers."""
    def n(level: str) -> Column:
        return F.count_if(F.col("impact_severity") == level)
    rooted_high = F.bool_or(F.col("root_status") == "high")
    return impacts.groupBy("root").agg(
        F.count(F.lit(1)).alias("impacted"),
        F.when(n("critical") > 0, "critical").when((n("high") >= 3) | ((n("high") > 0) & rooted_high), "critical")
        .when(n("high") > 0, "high").when(n("medium") >= 3, "high").when(n("medium") > 0, "medium")
        .when(n("low") > 0, "low").otherwise("none").alias("overall"))


def track(sources: DataFrame, targets: DataFrame, edges: DataFrame, edge_type: str) -> DataFrame:
    """Edges of an operation that are not in the graph yet. Sources and
    targets carry ``op``, the operation they belong to: id lists of single
    jobs, matched by operation."""
    made = (sources.select("op", F.col("id").alias("src")).join(targets.select("op", F.col("id").alias("dst")), "op")
            .select("src", "dst", F.lit(edge_type).alias("edge_type")).distinct())
    return made.join(edges.select("src", "dst", "edge_type"), ["src", "dst", "edge_type"], "left_anti")


def dataset(namespace: str) -> Column:
    return F.struct(F.lit(namespace).alias("namespace"), F.col("name").alias("name"))


PER_EVENT = 10_000
EMPTY = "array<struct<namespace:string,name:string>>"


def node_events(nodes: DataFrame, edges: DataFrame, namespace: str, at: str) -> DataFrame:
    """(event): a COMPLETE event per node with its inputs, as JSON lines.

    A node with more than PER_EVENT inputs reports them over several events
    of its run, all but one of type RUNNING; run events add up by their
    format, and no list grows with the graph.
    """
    names = nodes.select(F.col("id").alias("src"), F.col("name").alias("in_name"))
    fed = edges.select("src", F.col("dst").alias("id")).distinct()
    parts = fed.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / PER_EVENT).alias("parts"))
    inputs = (fed.join(parts, "id").withColumn("part", F.pmod(F.xxhash64("src"), F.col("parts"))).join(names, "src")
              .groupBy("id", "part").agg(F.array_sort(F.collect_set(F.struct(
                  F.lit(namespace).alias("namespace"), F.col("in_name").alias("name")))).alias("inputs")))
    kind = F.when(F.coalesce("part", F.lit(0)) == 0, "COMPLETE").otherwise("RUNNING")
    return nodes.join(inputs, "id", "left").select(F.to_json(F.struct(
        kind.alias("eventType"), F.lit(at).alias("eventTime"),
        F.struct(F.sha2(F.concat_ws("|", F.lit(at), F.col("id").cast("string")), 256).alias("runId")).alias("run"),
        F.struct(F.lit(namespace).alias("namespace"), F.col("name").alias("name")).alias("job"),
        F.coalesce("inputs", F.array().cast(EMPTY)).alias("inputs"), F.array(dataset(namespace)).alias("outputs"))).alias("event"))


def graph_events(nodes: DataFrame, namespace: str, job: str, at: str) -> DataFrame:
    """(event): START with the sources, COMPLETE with sources and outputs; a
    graph of more than PER_EVENT datasets adds RUNNING events for the rest."""
    parts = max(1, -(-nodes.count() // PER_EVENT))

    def listed(kinds: tuple[str, ...]) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("node_type").isin(*kinds), dataset(namespace))))
    rows = nodes.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(
        listed(("source",)).alias("inputs"), listed(("sink", "transform")).alias("outputs"))
    head = [F.lit(at).alias("eventTime"), F.struct(F.sha2(F.lit(f"{at}|{job}"), 256).alias("runId")).alias("run"),
            F.struct(F.lit(namespace).alias("namespace"), F.lit(job).alias("name")).alias("job"), F.col("inputs")]
    kind = lambda name: F.when(F.col("part") == 0, name).otherwise("RUNNING").alias("eventType")
    return rows.select(F.explode(F.array(
        F.to_json(F.struct(kind("START"), *head, F.array().cast(EMPTY).alias("outputs"))),
        F.to_json(F.struct(kind("COMPLETE"), *head, F.col("outputs"))))).alias("event"))
