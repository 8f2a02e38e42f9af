"""Connected components of a table of links, by alternating large and small stars.

A large star ties every larger neighbour of a node to the least node around it, a small star every smaller one; both only shrink
the distance to the least node of the component. Minima are combined before the shuffle and links are joined back by a plain join,
which adaptive execution splits where a node has very many links. Each round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import stored


def _star(links: DataFrame, centre: str, other: str, large: bool) -> DataFrame:
    least = links.groupBy(F.col(centre).alias("at")).agg(F.min(other).alias("low")).select("at", F.least("at", "low").alias("low"))
    around = links.select(F.col(centre).alias("at"), F.col(other).alias("to")).join(least, "at")
    if large:
        out = around.where("to > at").select(F.col("to").alias("a"), F.col("low").alias("b"))
    else:
        out = around.select(F.col("to").alias("a"), F.col("low").alias("b")).unionByName(least.select(F.col("at").alias("a"), F.col("low").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, name: str = "links", most_rounds: int = 60) -> DataFrame:
    """(a, b) links -> (node, root), the least node of the component, for every node that has a link to another and is not the root.

    Raises after `most_rounds` rounds rather than return roots that are not final; the number of rounds grows with the logarithm of
    the longest chain.
    """
    both = F.least("a", "b"), F.greatest("a", "b")
    now = stored(links.where("a <> b").select(both[1].alias("a"), both[0].alias("b")).distinct(), name)
    mark = None
    for _ in range(most_rounds):
        sym = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(sym, "a", "b", True)
        now = stored(_star(large, "a", "b", False), name)
        # links (node, least neighbour) that no longer change are final: count and an order-free digest tell
        seen = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftrightunsigned(F.xxhash64("b", "a"), 24))).first())
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen
    raise RuntimeError(f"components are not final after {most_rounds} rounds")
