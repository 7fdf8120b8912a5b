"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.staging import staged


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) links -> (id, comp): comp is the smallest id that is reachable.

    Every round each id takes the smallest label among its neighbours and
    then the label of its label, so chains halve. Each round is written to the
    shared folder, so lineage stays short and lost executors redo one round.
    Ids without a link don't appear. An empty table gives an empty table.
    """
    both = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("comp").alias("near"))
        taken = labels.join(near, labels["id"] == near["a"]).select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        over = taken.select(F.col("id").alias("via"), F.col("comp").alias("far"))
        jumped = taken.join(over, taken["comp"] == over["via"], "left").select(
            "id", F.least("comp", F.coalesce("far", "comp")).alias("comp"), (F.least("comp", F.coalesce("far", "comp")) < F.col("old")).alias("moved")
        )
        done = staged(jumped, "labels")
        labels = done.select("id", "comp")
        if done.where("moved").limit(1).count() == 0:
            return labels
    raise RuntimeError("components did not settle")
