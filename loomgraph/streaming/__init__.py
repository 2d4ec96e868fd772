"""Incremental use: batches of changed memberships refresh descriptions only where a community has changed enough."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

import loomgraph.operators.text  # noqa: F401
from loomgraph.plans.engine import plan


def refresh_descriptions(memberships: DataFrame, current: Callable[[], DataFrame], regenerate: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch of ``memberships`` (node, comm) is compared with ``current()``; ``regenerate`` gets the
    communities whose Jaccard similarity of old and new members is below 0.9."""

    def batch(new: DataFrame, _: int) -> None:
        old = current()
        changed = old.join(new.withColumnRenamed("comm", "__new"), "node", "left").selectExpr("node", "coalesce(__new, comm) AS comm")
        regenerate(plan(old.sparkSession, "refresh", vcomms=old, local_round=changed).filter("regenerate").select("comm"))

    return memberships.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
