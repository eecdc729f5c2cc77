"""Connected components of an edge table, in rounds that stay on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _roots(parents: DataFrame) -> DataFrame:
    """(v, component): pointers to smaller vertices followed to their ends, doubling each time."""
    while True:
        above = parents.select(F.col("v").alias("component"), F.col("component").alias("further"))
        jumped = parents.join(above, "component", "left").select("v", F.coalesce("further", "component").alias("component"), (F.col("further") < F.col("component")).alias("moved"))
        jumped = cut(jumped, "parents")
        parents = jumped.select("v", "component")
        if not jumped.where("moved").limit(1).count():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(v, component): for each vertex of an edge, the smallest vertex it reaches.

    ``edges`` has longs ``a`` and ``b``. Each round points every vertex to its
    smallest neighbour (pre-aggregated on the map side), follows the pointers
    to their roots, and contracts the edges to roots: what is inside a tree is
    gone in the next round. Each round is written to the shared folder; only
    whether anything is left comes to the driver.
    """
    labels = None
    left = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while labels is None or left.limit(1).count():
        both = left.select(F.col("a").alias("v"), F.col("b").alias("component")).union(left.select("b", "a"))
        roots = _roots(cut(both.groupBy("v").agg(F.least("v", F.min("component")).alias("component")), "parents"))
        ends = [roots.select(F.col("v").alias(c), F.col("component").alias(f"root_{c}")) for c in ("a", "b")]
        across = left.join(ends[0], "a").join(ends[1], "b").where("root_a <> root_b")
        left = cut(across.select(F.greatest("root_a", "root_b").alias("a"), F.least("root_a", "root_b").alias("b")).distinct(), "edges")
        labels = roots if labels is None else composed(labels, roots)
    return labels


def composed(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """``labels`` with their components' own components, where ``roots`` has them."""
    above = roots.select(F.col("v").alias("component"), F.col("component").alias("further"))
    out = labels.join(above, "component", "left").select("v", F.coalesce("further", "component").alias("component"))
    return cut(out, "labels")
