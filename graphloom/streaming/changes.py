"""The change-capture merge as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.keyed import Keyed
from graphloom.operators.structured import newest


def follow(changes: DataFrame, target: Keyed, checkpoint: str, order: str, deleted: str | None = None, most: int = 8) -> StreamingQuery:
    """Merge each micro-batch of whole rows into a table by key.

    A batch writes what it changes, in the buckets of its keys; what is there already is not read for that. Buckets
    with more than so many batches since their base are compacted, the work of which is spread over these batches. Of the
    rows of a key the latest by order counts, then the largest by all columns, and a batch that is run again is passed
    over. Rows for which the column deleted is true take the key away.
    """

    def apply(batch: DataFrame, n: int) -> None:
        if target.meta().get("batch", -1) >= n:
            return
        latest = newest(batch, target.key, [F.col(order).desc(), F.to_json(F.struct(*sorted(batch.columns))).desc()])
        gone = latest.where(F.col(deleted)).select(*target.key) if deleted else None
        rows = latest.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else latest
        target.write(rows, gone, {"batch": n})
        target.compact(most)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
