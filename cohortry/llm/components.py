"""Connected components of a graph given as a table of links, by alternating stars.

Each round points every node's larger neighbours at its smallest one, then every node's smaller neighbours at the
smallest of them, until nothing changes: the number of rounds grows with the logarithm of the nodes. A round is two
aggregates with partial sums and two joins of written tables, which adaptive execution splits where a node has very
many links. Links and components stay on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written


def components(links: DataFrame, max_rounds: int = 60) -> Written:
    """A written table (``node``, ``root``) of the nodes that have links: the smallest node that each can reach.

    ``links`` has two columns of one orderable type. Links of a node to itself and links with nulls tell nothing;
    repeated links, in either direction, count once. No links give an empty table. Rounds go on until nothing changes;
    should ``max_rounds`` not be enough, an error is raised and nothing is returned.
    """
    a, b = links.columns
    ends = links.select(F.greatest(F.col(a), F.col(b)).alias("u"), F.least(F.col(a), F.col(b)).alias("v"))
    now = Written(ends.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "stars")
    was = None
    for _ in range(max_rounds):
        sign = tuple(now.df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if sign == was or not sign[0]:
            break
        was = sign
        both = now.df.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.df.select(F.col("v"), F.col("u")))
        least = Written(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")), "stars")
        # the write parts the aggregate from the join, whose two plain exchanges can then be split at a hot node
        large = Written(both.join(least.df, "x").where("y > x and y > m").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        small = large.df.groupBy("u").agg(F.min("v").alias("m"))
        step = large.df.join(small, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = Written(step.union(small.select("u", F.col("m").alias("v"))).distinct(), "stars")
        for old in (now, least, large):
            old.drop()
        now = after
    else:
        raise RuntimeError(f"components are not complete after {max_rounds} rounds")
    roots = now.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = Written(now.df.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots), "components")
    now.drop()
    return out
