"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.plans.shared import reliable


#: Links that a task of a round works on at least; small graphs need few tasks and files.
TASK_LINKS = 200_000


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id it can reach.

    Links from an id to itself, repeated and reversed links change nothing; rows
    with a null end are left out; no links give no rows. Each round writes its
    links to the shared folder; rounds grow with the logarithm of the longest chain.
    """
    edges = reliable(
        links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct()
    )
    before, tasks = None, None
    while True:
        # large star: every larger neighbour of a vertex goes to the vertex's smallest neighbour
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: every smaller neighbour goes to the smallest, and so does the vertex
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        joined = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = reliable(joined.coalesce(tasks) if tasks else joined)
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before, tasks = seen, 1 + seen[0] // TASK_LINKS
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return roots.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
