"""Connected components of a table of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.scratch import settle


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``label`` (the smallest id reachable) of every node in ``links`` (a, b: long).

    Each round a node takes the smallest label among its neighbours and itself, then its label's own
    label; labels halve their distance, so a star needs one round and a chain few. Neighbours are
    aggregated before the shuffle and every table is settled, so a hub's rows can be split.
    """
    both = settle(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = settle(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select(
        "id", F.least("id", "m").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("m"))
        hopped = settle(labels.join(near, labels.id == near.a).select(
            "id", "label", F.least("label", "m").alias("hop")))
        roots = hopped.select(F.col("id").alias("root"), F.col("hop").alias("root_label"))
        jumped = settle(hopped.join(roots, hopped.hop == roots.root).select(
            "id", F.least("hop", "root_label").alias("label"),
            (F.least("hop", "root_label") < F.col("label")).alias("moved")))
        labels = jumped.select("id", "label")
        if jumped.where("moved").isEmpty():
            return labels
