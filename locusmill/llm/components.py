"""Connected components of a graph given as links, on the cluster: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.llm._tables import dropped, written


def _stars(links: DataFrame) -> bool:
    """Whether every node has one link at most to a smaller one, which itself has none."""
    ends = links.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
    per = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not per.where("up > 1 OR (up > 0 AND down > 0)").limit(1).count()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label (smallest node of its component) for every node that has a link to another one.

    links: columns a, b (long); directions, repeats and loops don't matter, rows with a null are no links. Each round
    links every node to the smallest neighbour it knows; a node with very many links costs one aggregated row per task
    and a join that adaptive execution can split. Each round's links are written to the shared folder; rounds end as soon as what is
    left are stars. No links: no rows.
    """
    tall = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(tall(links), "links")
    for _ in range(most_rounds):
        if _stars(now):
            break
        both = now.union(now.select("b", "a"))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # links from the smallest neighbour itself are lost by b > a, so each node's link to its smallest one is added
        large = tall(large.union(low.select("u", "m")))
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
        then = written(tall(small), "links")
        dropped(now)
        now = then
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    star = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = star.union(star.select("label", "label").distinct())
    out._locusmill_path = now._locusmill_path
    return out
