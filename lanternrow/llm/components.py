"""Connected components of links, by contraction; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def components(edges: DataFrame, rounds: list | None = None) -> DataFrame:
    """(id, component) for every id in edges (a, b: not null); component is the smallest id reached.

    Every round each root takes the smallest root that its tree is linked to, and roots jump to their
    root's root until they point at one that stays, so jumps are logarithmic in the longest path, chains
    in id order included. Then links are drawn between the roots that are left. A round needn't halve
    the trees: where a hub has the highest id, it joins its smallest neighbour first, and the others
    follow in the next round; rounds stay few. `rounds`, if given, gets the number of links of each round.
    """
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = stored(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id")), "labels")
    links = edges.filter("a < b")
    while not links.isEmpty():
        if rounds is not None:
            rounds.append(links.count())
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the smallest of a root and its neighbours; a pointer goes to a smaller root, so there is no circle
        up = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "up")
        while True:
            step = up.alias("x").join(up.alias("y"), F.col("x.to") == F.col("y.a")).select("x.a", F.col("y.to").alias("to"), (F.col("x.to") != F.col("y.to")).alias("moved"))
            step = stored(step, "up")
            up = step.select("a", "to")
            if step.filter("moved").isEmpty():
                break
        labels = stored(labels.join(up, labels["component"] == up["a"], "left").select("id", F.coalesce("to", "component").alias("component")), "labels")
        moved = links.join(up.select("a", F.col("to").alias("x")), "a").join(up.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        links = stored(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct(), "links")
    return labels
