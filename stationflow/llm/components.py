"""Connected components of links between texts, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.session import settle


def _with_least(pairs: DataFrame) -> DataFrame:
    """Pairs ``u, v`` with ``m``, the least of ``u`` and all its partners."""
    least = settle(pairs.groupBy("u").agg(F.min("v").alias("m"))).select(
        F.col("u").alias("_u"), F.least("u", "m").alias("m")
    )
    return pairs.join(least, F.col("u") == F.col("_u")).drop("_u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = settle(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    stars = _with_least(both).where(F.col("v") > F.col("u"))
    return settle(stars.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    stars = _with_least(down)
    linked = stars.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        stars.select("u", F.col("m").alias("v"))
    )
    return settle(linked.where(F.col("u") != F.col("v")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every linked node; a component's name is its least node.

    ``links`` has two columns of one orderable type, ``u`` and ``v``; loops and repeated links are
    harmless. The rounds grow with the logarithm of the longest chain; each is written to the
    shared folder. A star's centre may hold most links: minima are combined before the shuffle and
    the joins read tables, so adaptive execution can split them.
    """
    edges = settle(links.select("u", "v").where(F.col("u") != F.col("v")).distinct())
    before = None
    while (now := _state(edges)) != before:
        before = now
        if not now[0]:
            break
        edges = _small_star(_large_star(edges))
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
