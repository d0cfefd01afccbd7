"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notecode.session import materialised


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(id, component)``, the smallest id reachable, for every id that has a link.

    Each round takes the smallest label among the neighbours and then the label of that label, so the
    number of rounds grows with the logarithm of the longest path. Rounds are written to the shared
    folder; labels never reach the driver, only the number of changes does. Rows with a null end and
    links of an id to itself are ignored.
    """
    links = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = materialised(links.union(links.select("b", "a")).distinct(), "links")
    labels = materialised(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b")
        near = near.groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "id").select("id", F.least("component", "near").alias("now"), "component")
        target = hooked.select(F.col("id").alias("now"), F.col("now").alias("next"))
        jumped = hooked.join(target, "now").select("id", F.least("now", "next").alias("new"), "component")
        jumped = materialised(jumped, "labels")
        labels = jumped.select("id", F.col("new").alias("component"))
        if jumped.filter("new <> component").isEmpty():
            return labels
