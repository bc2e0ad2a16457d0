"""Connected components of a link table, in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelry.llm.shared import discard, saved


def _edges(links: DataFrame, a: str, b: str) -> DataFrame:
    return links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label for every node of links (label: a node of its component, the same for all), as a saved table.

    Each round, a node takes the smallest of itself and its neighbours as label, then its label's label, and the links are
    contracted: ends become their labels, and links inside a label go. The rounds end when no link is left. Smallest labels
    are combined before they are shuffled, and joins go between written tables, so a node with very many links is no single task.
    """
    edges, names = saved(_edges(links, a, b), "links"), None
    while names is None or not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        hooked = saved(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "hooked")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = saved(hooked.join(up, "label").select("node", F.col("top").alias("label")), "labels")
        names = jumped if names is None else saved(relabelled(names, jumped), "labels")
        at_u = edges.join(jumped.select(F.col("node").alias("u"), F.col("label").alias("lu")), "u")
        at_both = at_u.join(jumped.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v")
        contracted = saved(_edges(at_both, "lu", "lv"), "links")
        discard(edges, hooked)
        edges = contracted
    return names


def relabelled(labels: DataFrame, names: DataFrame) -> DataFrame:
    """labels (node, label) with the labels' own labels in names."""
    top = names.select(F.col("node").alias("label"), F.col("label").alias("top"))
    return labels.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
