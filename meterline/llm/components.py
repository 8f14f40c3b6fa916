"""Connected components of an edge table by alternating large-star and small-star steps.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Each step is a
grouped minimum (combined before the shuffle) and an equi-join, so a hub's edges are spread by
Spark's skew join; nothing is gathered in the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v) with the least of u and its neighbours as `m`."""
    least = pairs.groupBy("u").agg(F.min("v").alias("n")).select(F.col("u").alias("k"), F.least("u", "n").alias("m"))
    return pairs.join(least, F.col("u") == F.col("k")).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of `edges` (u, v): the least node reachable.

    Loops and repeated edges do no harm, rows with a null end are left out, and an empty table
    gives an empty one.
    """
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    down = materialise(down, "edges")
    while True:
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large")
        starred = _star(large)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select("u", F.col("m").alias("v")))
        small = materialise(small.where("u <> v").distinct(), "small")
        changed = small.join(down, ["u", "v"], "left_anti").limit(1).count() or down.count() != small.count()
        discard(down, large)
        down = small
        if not changed:
            break
    return down.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        down.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
