"""Connected components of a distributed link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node it is linked with, for every end of links (a, b).

    Each pass gives a node the smallest label among its neighbours and then its label's own
    label, so that paths halve; passes end when no label changes. Links never leave the
    executors, and each pass is written as a table, and its predecessor's table goes.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        now = labels.select("node", "label")
        near = both.join(now, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        step = now.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        up = step.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        last, labels = labels, stored(step.join(up, F.col("label") == F.col("up"), "left").select("node", "was", F.least("label", "up_label").alias("label")))
        release(links.sparkSession, last.stored_at)
        if labels.where("was <> label").isEmpty():
            release(links.sparkSession, both.stored_at)
            return labels.select("node", "label")
