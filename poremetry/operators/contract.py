"""Connected components of a table of links, by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from poremetry.workspace import materialize, row_count


def smallest_reachable(links: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(*within, node, root): the smallest node reachable from every node named in ``links`` (*within, a, b).

    In each round every node joins the neighbour (or stays itself) that comes first by degree, then by a hash that
    changes with the round, and the links are rewritten on the joined nodes. A star collapses at once; on a path or any other
    graph without hubs the hash order removes a constant share of the nodes, so the rounds are logarithmic whatever
    way the nodes are numbered. Links are counted while they are written; nothing is collected. Nodes with the same root
    are no hot key: joins on written tables are left to adaptive skew splitting.
    """
    keys = list(within)
    edges = materialize(links.select(*keys, "a", "b").where("a <> b"))
    steps: list[DataFrame] = []
    while row_count(edges):
        both = edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        degree = materialize(both.groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("n")))
        rank = F.struct(-F.col("n"), F.xxhash64(F.lit(len(steps)), *keys, "a"), F.col("a"))
        order = degree.select(*keys, F.col("a").alias("b"), rank.alias("rank"))
        best = both.join(order, [*keys, "b"]).groupBy(*keys, "a").agg(F.min("rank").alias("best"))
        own = degree.select(*keys, "a", rank.alias("rank"))
        joined = materialize(
            best.join(own, [*keys, "a"]).select(*keys, "a", F.least("best", "rank")["a"].alias("p")))
        steps.append(joined)
        of_a = joined.select(*keys, "a", F.col("p").alias("pa"))
        of_b = joined.select(*keys, F.col("a").alias("b"), F.col("p").alias("pb"))
        edges = materialize(
            edges.join(of_a, [*keys, "a"]).join(of_b, [*keys, "b"])
            .select(*keys, F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a <> b").distinct())
    if not steps:
        return edges.select(*keys, F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps.pop().select(*keys, F.col("a").alias("node"), F.col("p").alias("hub"))
    while steps:
        later = found.select(*keys, F.col("node").alias("p"), "hub")
        found = materialize(
            steps.pop().join(later, [*keys, "p"], "left")
            .select(*keys, F.col("a").alias("node"), F.coalesce("hub", "p").alias("hub")))
    names = materialize(found.groupBy(*keys, "hub").agg(F.min("node").alias("root")))
    return materialize(found.join(names, [*keys, "hub"]).select(*keys, "node", "root"))
