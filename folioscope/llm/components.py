"""Connected components by alternating large and small stars.

Edges point to ever smaller ids until each component is one star around its smallest id.
Each round is a minimum per node, which is summed up before the shuffle, and a join whose
large keys Spark may split; no node's neighbours are ever collected.
"""

from pyspark.sql import functions as F

from .shared import stored


def _star(edges, small, n):
    """One star operation on undirected edges (a > b), ``n`` at most; it makes no more of them."""
    near = edges if small else edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # a table of its own, so that Spark can split the edges of a hot node in the join
    least = stored(near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least", 2 * n)
    joined = near.join(least, "a")
    if small:  # smaller neighbours and the node itself meet the smallest
        out = joined.select(F.col("b").alias("x"), F.col("m").alias("y")).union(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    else:  # larger neighbours meet the smallest
        out = joined.where("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    return out.where("x > y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _stars(edges):
    """Does every edge lead from a node of its own to the middle of a star?"""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("middle")).union(
        edges.select("b", F.lit(0), F.lit(1)))
    odd = ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("middle").alias("middle"))
    return odd.where("child > 1 OR child > 0 AND middle > 0").isEmpty()


def of(links):
    """(id, component) of every id in ``links`` (a, b), a stored table; the component is its smallest id."""
    n = links.count()
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "edges", n)
    while not _stars(edges):
        edges = stored(_star(_star(edges, False, n), True, n), "edges", n)
    middles = edges.select(F.col("b").alias("id")).distinct()
    return stored(edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        middles.select("id", F.col("id").alias("component"))), "components", 2 * n)
