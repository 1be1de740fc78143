"""Connected components by alternating large and small stars.

Each round links every node's greater (then its lesser) neighbours to the least node near it, until nothing changes: the
rounds grow with the logarithm of the longest path. Least neighbours are aggregated before the shuffle; the tables of a
round are written to the shared folder, so their joins start from files and Spark can split a node of many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, save


def _star(both: DataFrame, large: bool) -> DataFrame:
    """``both``: (a, b) links. Large: b's above a go to a's least; small: b's below a, and a, go to it."""
    side = both if large else both.where("b < a")
    least = save(side.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    met = side.join(least, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    made = save(out.where("a <> b").distinct())
    discard(least)
    return made


def components(links: DataFrame) -> DataFrame:
    """``links``: (a, b), any order. Returns (node, root) of every node that is not its own root, root the least of its
    component."""
    now = save(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(seen)
        large = _star(now.union(now.select("b", "a")), True)
        small = _star(large, False)
        discard(now)
        discard(large)
        now = small
