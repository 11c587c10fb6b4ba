"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut, drop


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(id, component): the smallest id that each id of links (a, b) reaches.

    Alternates the large-star and the small-star step: each vertex hangs its larger neighbours, then its smaller
    ones, under the smallest vertex it knows.  The number of rounds grows with the logarithm of the longest path; rows
    never exceed the links.  An error if most_rounds do not suffice.  Minima are taken within tasks first and written,
    so that both sides of the join are plain shuffles: Spark splits the rows of a vertex with very many links.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "_u"))
        large = cut(both.join(least, F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: a vertex and its smaller neighbours go under the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.withColumnRenamed("u", "_u"), F.col("u") == F.col("_u")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        seen = Observation()
        done = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        done = cut(done.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        for df in (edges, least, large):
            drop(df)
        edges = done
        now = seen.get["n"], seen.get["h"]
        if now == mark:
            own = edges.unionByName(edges.select(F.col("v").alias("u"), "v"))
            return own.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
        mark = now
    raise RuntimeError(f"components are not complete after {most_rounds} rounds")
