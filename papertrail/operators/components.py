"""Connected components on an edge table, as a DataFrame loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrail.session import ensure_checkpoint_dir


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label every node of ``edges`` with the smallest node of its component.

    Works on edges only: nodes without an edge never enter the loop. Each round
    takes the smallest label among a node and its neighbours and then follows
    labels one step (pointer jumping), so paths shorten geometrically. Rounds are
    cut with ``checkpoint()``, whose files survive the loss of executors; the
    driver sees only the number of changed labels.
    Returns (node, component); ``a`` and ``b`` may be of any orderable type.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct().checkpoint()
    both = pairs.union(pairs.select("v", "u"))
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select(
        "node", F.least("node", "m").alias("component"))
    labels = labels.checkpoint()
    while True:
        heard = (both.join(labels.select(F.col("node").alias("v"), "component"), "v")
                 .groupBy(F.col("u").alias("node")).agg(F.min("component").alias("heard")))
        lowered = labels.join(heard, "node").select(
            "node", "component", F.least("component", "heard").alias("low"))
        # Hook: a lowered label is also offered to the old label, so whole trees move at once.
        hooks = lowered.groupBy(F.col("component").alias("node")).agg(F.min("low").alias("hook"))
        hooked = lowered.join(hooks, "node", "left").select(
            "node", "component", F.least("low", F.coalesce("hook", "low")).alias("low")).checkpoint()
        jumped = (hooked.join(hooked.select(F.col("node").alias("low"), F.col("low").alias("next")), "low", "left")
                  .select("node", F.col("component").alias("old"),
                          F.least("low", F.coalesce("next", "low")).alias("component"))).checkpoint()
        changed = jumped.filter("old <> component").limit(1).count()
        labels = jumped.select("node", "component")
        if changed == 0:
            return labels
