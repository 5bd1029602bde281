"""Connected components by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.spread import salted, spread_join
from quaestor.llm.storage import discard, written


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's component. edges: (a, b). A node of very many edges is dealt over tasks.

    Each round takes the least label of all neighbours, then that label's own label, so that chains shrink by
    more than half; it ends when nothing changes. Labels are written each round; only a count comes to the driver. The result is such a table, for discard().
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    dealt, repeated = salted(both, ["b"], "a")
    label = written(nodes.select("node", F.col("node").alias("label")))
    done = [label]
    while True:
        near = dealt.join(repeated(label.withColumnRenamed("node", "b")), ["b", "_salt"]).groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near, label["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = written(step)
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))  # a label is a node, and many may have it
        after = written(spread_join(step, jump, ["label"], "node").select("node", "old", F.least("label", "further").alias("label")), release=True)
        changed = after.filter("old != label").limit(1).count()
        discard(step, *done)
        label, done = after.select("node", "label"), [after]
        label._written_to = after._written_to
        if not changed:
            discard(both)
            return label
