"""Connected components of a link table, by hooking nodes to their smallest neighbour and contracting the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.shared import materialise, not_broadcast


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of a link; component is the smallest node reachable.

    Each round every node hooks to its smallest neighbour if that is smaller, and follows these hooks
    to their root. Links are then replaced by links between different roots, each once, and the next
    round sees only these: of two linked nodes one is no root, so at least half of the nodes go, and
    those of a large group that hang on one node all go in the first round. A link is thus not joined
    with labels in every round. Tables are written to the shared folder; only counts reach the driver,
    and no table is broadcast.
    No links give no rows.
    """
    given = links.select(F.col(a).alias("s"), F.col(b).alias("d")).filter("s is not null and d is not null and s <> d")
    left, labels = _distinct_links(given), None
    for _ in range(max_rounds):
        roots = _roots(left, max_rounds)
        if labels is None:
            labels = roots
        else:
            on = not_broadcast(roots.select(F.col("v").alias("l"), F.col("l").alias("to")))
            labels = materialise(labels.join(on, "l", "left").select("v", F.coalesce("to", "l").alias("l")), "labels")
        one, two = (not_broadcast(roots.select(F.col("v").alias(e), F.col("l").alias(f"{e}_root"))) for e in "sd")
        left = _distinct_links(left.join(one, "s").join(two, "d").select(F.col("s_root").alias("s"), F.col("d_root").alias("d")).filter("s <> d"))
        if not left.limit(1).count():
            return labels.select(F.col("v").alias("node"), F.col("l").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _distinct_links(links: DataFrame) -> DataFrame:
    return materialise(links.select(F.least("s", "d").alias("s"), F.greatest("s", "d").alias("d")).distinct(), "links")


def _roots(links: DataFrame, max_rounds: int) -> DataFrame:
    """(v, l) of every node: the root of its chain of smallest neighbours. Hooks lead to smaller nodes only, so there are no rings, and chains halve in each step."""
    each = links.select(F.explode(F.array(F.struct(F.col("s").alias("v"), F.col("s").alias("l")), F.struct(F.col("d").alias("v"), F.col("s").alias("l")))).alias("x"))
    hooks = materialise(each.groupBy("x.v").agg(F.min("x.l").alias("l")), "hooks")
    for _ in range(max_rounds):
        jump = not_broadcast(hooks.select(F.col("v").alias("l"), F.col("l").alias("j")))
        moved = materialise(hooks.join(jump, "l").select("v", F.col("l").alias("old"), F.col("j").alias("l")), "hooks")
        hooks = moved.select("v", "l")
        if not moved.filter("l <> old").limit(1).count():
            return hooks
    raise RuntimeError(f"chains did not settle in {max_rounds} steps")
