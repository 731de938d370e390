"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """For each node of ``links`` (a, b): node and comp, the smallest node that it reaches.

    Each round takes the smallest label among neighbours and then the label's
    own label, so a path is halved rather than walked. Rounds are written, and
    end when a round changes nothing.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("heard"))
        near = labels.join(heard, labels["node"] == heard["a"]).select("node", F.least("comp", "heard").alias("comp"), F.col("comp").alias("was"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = written(near.join(up, "comp").select("node", F.least("comp", "up").alias("comp"), "was"), "labels")
        labels = new.select("node", "comp")
        if not new.where("comp != was").limit(1).count():
            return labels
