"""Connected components of a table of links, by least labels and pointer jumping; every round is a Spark job over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowforge.llm.common import hand_over, release, stage


def components(links: DataFrame) -> DataFrame:
    """``links`` (a long, b long) to (node, label): the least node that can be reached. Nodes without links are not listed."""
    both = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = lower.join(jump, "next").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("changed"))
        before, labels = labels, stage(moved)
        release(before)
        if labels.where("changed").isEmpty():
            release(both)
            return hand_over(labels.drop("changed"), labels)
