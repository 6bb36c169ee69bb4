"""Connected components of a graph given as links, by contraction.

Each round maps every node to the smallest id among itself and its neighbours
and replaces the links by those between the names so given; names are always ids
of the same component, so the smallest id is the last name left.  Links and
names stay in DataFrames; nodes with many links are combined map-side or split
by the adaptive join.  Lineage is cut after each round by tables in the shared
folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def smallest_ids(links: DataFrame) -> DataFrame:
    """links (u, v) -> (id, component_id) for every node that has a link to another."""
    edges = materialize(links.where("u <> v").select("u", "v").distinct(), "links")
    names = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("name"), F.least("u", "v").alias("to")), "contraction")
        if names is None:
            names = step.select(F.col("name").alias("id"), F.col("to").alias("component_id"))
        else:
            hop = step.select(F.col("name").alias("component_id"), "to")
            names = names.join(hop, "component_id", "left").select("id", F.coalesce("to", "component_id").alias("component_id"))
        names = materialize(names, "names")
        a = step.select(F.col("name").alias("u"), F.col("to").alias("a"))
        b = step.select(F.col("name").alias("v"), F.col("to").alias("b"))
        next_edges = edges.join(a, "u").join(b, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        edges = materialize(next_edges, "links")
    if names is None:
        return links.sparkSession.createDataFrame([], "id long, component_id long")
    return names
