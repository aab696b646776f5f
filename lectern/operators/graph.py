"""Typed entity graph: (id, type, name, metadata) and (source_id, target_id, relation)."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(entities: DataFrame, name: str, limit: int = 8) -> DataFrame:
    """Entities of a name, else of a prefix, at most ``limit``."""
    low = F.lower("name")
    exact = entities.where(low == name.lower()).withColumn("tier", F.lit(0))
    prefix = entities.where(low.startswith(name.lower()) & (low != name.lower())).withColumn("tier", F.lit(1))
    best = exact.unionByName(prefix)
    least = best.agg(F.min("tier").alias("least"))
    return best.crossJoin(F.broadcast(least)).where("tier = least").orderBy("name", "id").limit(limit).select("id", "type", "name")


def resolve_named(entities: DataFrame, name: str, bridge: DataFrame | None = None, limit: int = 8) -> DataFrame:
    """id, type, name, tier: entities of a name, else of a prefix, else those that the name stands for in another language.

    bridge: alias, name. The first tier that has any entity counts, at most ``limit`` of it.
    """
    low = F.lower("name")
    tiers = [entities.where(low == name.lower()), entities.where(low.startswith(name.lower()))]
    if bridge is not None:
        meant = bridge.where(F.lower("alias") == name.lower()).select(F.lower("name").alias("_n")).distinct()
        tiers.append(entities.join(meant, low == F.col("_n"), "left_semi"))
    out = None
    for i, t in enumerate(tiers):
        own = t.orderBy("name", "id").limit(limit).select("id", "type", "name", F.lit(i).alias("tier"))  # a few rows
        out = own if out is None else out.unionByName(own)
    least = out.agg(F.min("tier").alias("least"))
    return out.crossJoin(F.broadcast(least)).where("tier = least").drop("least")


def full_view(edges: DataFrame, passages: DataFrame) -> DataFrame:
    """id, relation, direction, other: the edges of every entity in both directions, and its passages (id, s, e) as ``passage``."""
    place = F.concat_ws("-", F.col("s").cast("string"), F.col("e").cast("string"))
    return view(edges).unionByName(passages.select("id", F.lit("mentioned").alias("relation"), F.lit("passage").alias("direction"), place.alias("other")))


def neighbours(edges: DataFrame, ids: DataFrame, relation: str, reverse: bool = False) -> DataFrame:
    """id, other: one hop along a relation, or against it."""
    a, b = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    e = edges.where(F.col("relation") == relation).select(F.col(a).alias("id"), F.col(b).alias("other"))
    return e.join(ids.select("id"), "id", "left_semi")


def symmetric(edges: DataFrame, relation: str) -> DataFrame:
    """id, other of a relation that is stored once, in both directions."""
    e = edges.where(F.col("relation") == relation)
    return e.select(F.col("source_id").alias("id"), F.col("target_id").alias("other")).union(e.select("target_id", "source_id")).distinct()


def view(edges: DataFrame) -> DataFrame:
    """id, relation, direction, other: everything that touches an entity."""
    out = edges.select(F.col("source_id").alias("id"), "relation", F.lit("out").alias("direction"), F.col("target_id").alias("other"))
    return out.unionByName(edges.select(F.col("target_id").alias("id"), "relation", F.lit("in").alias("direction"), F.col("source_id").alias("other")))


def cut(df: DataFrame) -> DataFrame:
    """A frontier without its lineage, in the shared checkpoint folder; a temporary one only for a local master."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp())
    return df.checkpoint()


def ancestors(edges: DataFrame, relation: str, depth: int = 8) -> DataFrame:
    """id, ancestor, hops: up to ``depth`` hops along a relation, the fewest of each pair.

    Each hop joins only the pairs that the one before reached for the first time, and the walk ends with none left.
    """
    e = cut(edges.where(F.col("relation") == relation).select("source_id", "target_id").distinct())
    now = e.select(F.col("source_id").alias("id"), F.col("target_id").alias("ancestor"), F.lit(1).cast("long").alias("hops"))
    out = now
    for hop in range(2, depth + 1):
        met = now.join(e, F.col("ancestor") == F.col("source_id")).select("id", F.col("target_id").alias("ancestor")).distinct()
        now = cut(met.join(out, ["id", "ancestor"], "left_anti").withColumn("hops", F.lit(hop).cast("long")))
        if now.isEmpty():
            break
        out = out.unionByName(now)
    return out


def without_dangling(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose ends both exist."""
    e = entities.select("id")
    return edges.join(e, edges["source_id"] == e["id"], "left_semi").join(e.withColumnRenamed("id", "tid"), F.col("target_id") == F.col("tid"), "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node that each node of undirected edges (u, v) is connected with.

    Every round takes the least label among the neighbours, then the label of that label, so long paths halve; it ends when no
    label moves. Labels are minima, summed up before they are shuffled, and each round is cut from its lineage.
    """
    both = cut(edges.where("u != v").select("u", "v").union(edges.where("u != v").select("v", "u")).distinct())
    now = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("component")).withColumnRenamed("u", "node"))
    while True:
        near = both.join(now, F.col("u") == F.col("node")).groupBy("v").agg(F.min("component").alias("least")).withColumnRenamed("v", "node")
        least = now.join(near, "node").select("node", F.least("component", "least").alias("component"), F.col("component").alias("old"))
        of = now.select(F.col("node").alias("component"), F.col("component").alias("of"))
        moved = cut(least.join(of, "component").select("node", F.least("component", "of").alias("component"), "old"))
        now = moved.drop("old")
        if moved.where("component != old").isEmpty():
            return now
