"""Connected components of a link table, by smallest labels."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _buffers, _scratch


def components(links: DataFrame) -> DataFrame:
    """d, root (the smallest d reachable) of every d in links (a, b: long).

    Each round takes the smallest label among a node and its neighbours, then the label of that
    label; labels are written after each round, and the rounds end when none changes.
    """
    links = links.where("a <> b")
    edges = _scratch.written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = _scratch.written(edges.groupBy(F.col("a").alias("d")).agg(F.min("b").alias("low")).select("d", F.least("d", "low").alias("root")), "labels")
    while True:
        near = edges.join(labels.select(F.col("d").alias("b"), "root"), "b").groupBy(F.col("a").alias("d")).agg(F.min("root").alias("low"))
        own = labels.join(near, "d").select("d", F.col("root").alias("was"), F.least("root", "low").alias("root"))
        jump = labels.select(F.col("d").alias("root"), F.col("root").alias("next"))
        step = _scratch.written(own.join(jump, "root", "left").select("d", "was", F.least("root", F.coalesce("next", "root")).alias("root")), "labels")
        labels = step.select("d", "root")
        if step.where("was <> root").isEmpty():
            return labels
