"""Connected components by large and small stars.

Both steps replace a node's edges by edges to the least node around it; only minima are aggregated, so a node with
any number of neighbours is no task of its own. The least node of each component is its label.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photofold.session import stored


def _large_star(edges: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """Every neighbour above u points to the least of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # Stored, so that the join can split a node with very many neighbours.
    least, remove = stored(least)
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), remove


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its neighbours below it point to the least of these; edges come as u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    below = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node``, ``label`` for every node that has an edge; ``edges`` has ``u`` and ``v`` (numbers, not null).

    The number of rounds grows with the logarithm of the longest chain; the driver sees one row count and
    one check sum per round. Each round is written below the session's shared folder, and removed after the next.
    """
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, remove = stored(now)
    seen = None
    for _ in range(most_rounds):
        large, remove_least = _large_star(now)
        new, remove_new = stored(_small_star(large))
        remove_least()
        remove()
        now, remove = new, remove_new
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == seen:
            break
        seen = sums
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
