"""Connected components by alternating large and small stars, as DataFrame joins.

Nothing is collected but one counter and one checksum a round. Rounds grow with the logarithm
of the largest component; every round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Stage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node that has an edge; root is the smallest node it reaches.

    Self-loops, repeated edges, either direction and nulls (dropped) are fine; no edge gives no row.
    """
    pair = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = Stage(pair.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        mark = now.df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.df.union(now.df.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = Stage(large, "large")
        least = large.df.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.df.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = Stage(hung.union(least.select("u", "m")).distinct(), "edges")
        large.drop()
        now.drop()
        now = after
    else:
        raise RuntimeError("components did not settle")
    stars = now.df
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select("v", "v").distinct())
