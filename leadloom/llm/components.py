"""Connected components of a table of links, by contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.tables import stored


def _roots(parents: DataFrame) -> DataFrame:
    """``(node, root)`` from ``(node, parent)`` with parent <= node, by pointer jumping."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        parents = stored(
            parents.join(above, "parent").select("node", F.col("root").alias("parent"), (F.col("root") < F.col("parent")).alias("moved")), "roots"
        )
        if parents.where("moved").isEmpty():
            return parents.select("node", F.col("parent").alias("root"))
        parents = parents.drop("moved")


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of the links ``(a, b)``: the smallest node it reaches.

    In each round every node points to its smallest neighbour, itself included; the trees this makes are
    flattened, links are rewritten to roots, and those within a root vanish. A round at least halves
    the roots that still have links, so there are few rounds, whatever the shape. Minima are combined
    before the exchange, so a node with very many links is no burden.
    """
    links = stored(links.select("a", "b").where("a <> b").distinct(), "links")
    names = None
    while not links.isEmpty():
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        roots = _roots(stored(parents.select("node", F.least("node", "parent").alias("parent")), "parents"))
        if names is None:
            names = roots.select("node", F.col("root").alias("component"))
        else:
            step = roots.select(F.col("node").alias("component"), "root")
            names = names.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        names = stored(names, "components")
        a, b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        links = stored(
            links.join(a, "a").join(b, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).where("a <> b").distinct(), "links"
        )
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")) if names is None else names
