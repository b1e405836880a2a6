"""Connected components of links by label propagation with pointer jumps."""

from pyspark.sql import DataFrame, functions as F

from .text import cut

NODES = 100_000         # labels are broadcast up to so many nodes, else joined by shuffles
SHARE = 50_000          # nodes of one partition


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of the nodes of the links (u, v): comp is the least node reachable.

    Every round takes the least label of a node and its neighbours and then the label of
    that label, until the sum of the labels no longer falls. Links and labels stay
    distributed and are cut to the shared folder each round; a node with most of the
    links is met by partial minima.
    """
    both = cut(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
               .filter("u <> v").distinct())
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select(
        "node", F.least("node", "v").alias("comp"))
    labels, before = cut(labels), None
    while True:
        n, total = labels.agg(F.count(F.lit(1)), F.sum(F.col("comp").cast("decimal(38,0)"))).first()
        if total == before:
            return labels
        before, parts = total, n // SHARE + 1
        labels = labels.coalesce(parts)

        def side(df):
            return F.broadcast(df) if n <= NODES else df.hint("merge")

        near = both.join(side(labels.withColumnRenamed("node", "v")), "v").select(F.col("u").alias("node"), "comp")
        hooked = cut(near.union(labels).groupBy("node").agg(F.min("comp").alias("comp")).coalesce(parts))
        jump = hooked.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        labels = cut(hooked.join(side(jump), "comp").select("node", F.col("next").alias("comp")))
