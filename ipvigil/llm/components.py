"""Connected components of a link table by random contraction, without collecting links or nodes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ipvigil.llm.frames import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b: long); nodes are connected if and only if their roots are equal.

    In each round every node moves to the neighbour (or itself) with the smallest hash, and links follow. Hashes change
    each round, so a constant share of the nodes goes in every round, whatever the shape; hot nodes only meet map-side
    minima and plain equi-joins. Each round's links are written to the shared folder.
    """
    links = cut_lineage(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots, step = nodes.withColumn("root", F.col("node")), 0
    while not links.isEmpty():
        step += 1

        def ranked(column: str, step: int = step):
            return F.struct(F.xxhash64(F.lit(step), F.col(column)).alias("rank"), F.col(column).alias("to"))

        both = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near"))))
        moves = links.select(both.alias("x")).select("x.*").groupBy("node").agg(F.min(ranked("near")).alias("best"))
        moves = cut_lineage(moves.select("node", F.least("best", ranked("node"))["to"].alias("to")), "moves")
        roots = roots.join(moves.select(F.col("node").alias("root"), "to"), "root", "left")
        roots = cut_lineage(roots.select("node", F.coalesce("to", "root").alias("root")), "roots")
        moved = links.join(moves.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        moved = moved.join(moves.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").filter("x <> y")
        links = cut_lineage(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return roots
