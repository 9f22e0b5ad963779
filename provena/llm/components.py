"""Connected components of an undirected graph given as an edge table (large-star / small-star rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.common import bounded_broadcast, settled
from provena.session import cut_lineage


def _least(edges: DataFrame, rows: int) -> DataFrame:
    """Each node's smallest neighbour, written, and broadcast only if the rows are few: Spark takes edges for less than they are."""
    return bounded_broadcast(settled(edges.groupBy("a").agg(F.min("b").alias("m")), rows))


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both, 2 * rows)
    return both.join(least.select("a", F.least("a", "m").alias("m")), "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    out = edges.join(_least(edges, rows), "a").select(
        F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
    return out.select("e.*").filter(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """``(node, root)`` for every node that has an edge; ``root`` is the component's smallest node, itself included.

    ``edges`` has two columns of one orderable type; direction, repeats and self-loops don't matter,
    rows with a null end are ignored.  Each round writes its edges to the shared folder (short lineage,
    survives lost executors) and only a count and a checksum come to the driver.  A node with very many
    edges is pre-aggregated before its shuffle, and the join that follows can be split by skew handling.
    ``rows``: a bound on the number of edges if one is known, for the number of files of the first table.
    """
    x, y = edges.columns[:2]
    e = (edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"), F.col(x).isNull().alias("n"), F.col(y).isNull().alias("o"))
         .filter(~F.col("n") & ~F.col("o") & (F.col("a") != F.col("b"))).select("a", "b").distinct())
    e = cut_lineage(e) if rows is None else settled(e, rows)
    seen = None
    for _ in range(max_rounds):
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        e = settled(_small_star(_large_star(e, mark[0]), 2 * mark[0]), 2 * mark[0])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select("b").distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
