"""Where chains of links lead, by pointer doubling: the recursive join for chains of any length.

Every node has at most one link. In each round a node's pointer is replaced by that of the node it points to, so it spans
twice as many links: the number of rounds is the logarithm of the longest chain. Once a round brings no pointer to an end,
those that are left run into cycles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.sources.workspace import work_dir, written


def follow_links(links: DataFrame) -> DataFrame:
    """(node, end, steps, cyclic) of every node with a link: links (node, target), node being unique.

    `end` is the last node of the chain, which has no link or one to null, and `steps` the number of links to it. Of a chain
    that runs into a cycle, `end` is the smallest node of the cycle and steps is null.
    """

    def keep(df: DataFrame) -> DataFrame:
        return written(df, work_dir(df.sparkSession))

    links = keep(links.where("node IS NOT NULL AND target IS NOT NULL").select("node", "target"))
    linked = links.select(F.col("node").alias("target"), F.lit(True).alias("linked"))
    pointers = links.join(linked, "target", "left").select(
        "node", "target", F.lit(1).cast("long").alias("steps"), F.col("linked").isNull().alias("done")
    )
    pointers = keep(pointers)
    before, left = None, pointers.where("NOT done").count()
    while left and left != before:
        onward = pointers.select(
            F.col("node").alias("target"), F.col("target").alias("next"), F.col("steps").alias("more"), F.col("done").alias("there")
        )
        moved = pointers.where("NOT done").join(onward, "target")
        moved = moved.select("node", F.col("next").alias("target"), (F.col("steps") + F.col("more")).alias("steps"), F.col("there").alias("done"))
        pointers = keep(pointers.where("done").unionByName(moved))
        before, left = left, pointers.where("NOT done").count()
    ended = pointers.where("done").select("node", F.col("target").alias("end"), "steps", F.lit(False).alias("cyclic"))
    if not left:
        return ended

    # A pointer that spans all nodes that are left stands inside the cycle, and the nodes it spans there are the cycle.
    ring = links.join(pointers.where("NOT done").select("node"), "node", "left_semi")
    ring, span = keep(ring.withColumn("low", F.col("node"))), 1
    while span < left:
        onward = ring.select(F.col("node").alias("target"), F.col("target").alias("next"), F.col("low").alias("other"))
        ring = ring.join(onward, "target").select("node", F.col("next").alias("target"), F.least("low", "other").alias("low"))
        ring, span = keep(ring), span * 2
    inside = ring.select(F.col("node").alias("target"), F.col("low").alias("end"))
    looped = ring.select("node", "target").join(inside, "target")
    return ended.unionByName(looped.select("node", "end", F.lit(None).cast("long").alias("steps"), F.lit(True).alias("cyclic")))


def linked_reservations(reservations: DataFrame) -> DataFrame:
    """reservation_id, book_id, queue_position, depth of the reservations that hang together with the first of their book:
    each is linked with the one before it, and a gap in the queue ends the chain. Nothing is assumed about the positions but
    that they are unique in a book."""
    before = reservations.select("book_id", (F.col("queue_position") + 1).alias("queue_position"), F.col("reservation_id").alias("target"))
    chains = follow_links(
        reservations.join(before, ["book_id", "queue_position"]).select(F.col("reservation_id").alias("node"), "target")
    )
    first = reservations.where("queue_position = 1").select(F.col("reservation_id").alias("end"))
    depth = chains.join(first, "end", "left_semi").select(F.col("node").alias("reservation_id"), (F.col("steps") + 1).alias("depth"))
    depth = depth.unionByName(first.select(F.col("end").alias("reservation_id"), F.lit(1).cast("long").alias("depth")))
    return reservations.join(depth, "reservation_id").select("reservation_id", "book_id", "queue_position", "depth")
