"""Connected components: a small numpy form inside a task, and an iterated DataFrame form over all links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize


def spanning(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that connect the same nodes 0..n-1 as the links (u, v) do."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (new != new[new]).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            node = np.flatnonzero(label != np.arange(n))
            return node, label[node]
        label = new


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node in ``links`` (a, b): root is the smallest node of its component.

    Large-star and small-star rounds until nothing changes.  Each round is an aggregate with map-side minima and a
    join that Spark may split when a hub is hot; the links are written to the shared folder after each, and the number of
    distinct links never grows.
    """
    now = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(small, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = materialize(star)
        sums = [d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first() for d in (now, new)]
        if was is not None:
            discard(was)
        was, now = now, new
        if sums[0] == sums[1]:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
