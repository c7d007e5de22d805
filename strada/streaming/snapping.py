"""Locations as they arrive: each micro-batch of a stream is snapped to a network and appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strada.operators import cost, snap
from strada.plans.services import Network


def snap_stream(locations: DataFrame, net: Network, folder: str, checkpoint: str, profile: str | None = None, radius_m: float = snap.RADIUS) -> StreamingQuery:
    """locations: a streaming DataFrame (loc, lat, lon). Each batch is written under its own number, so that a batch that is
    run again after a failure replaces what it wrote. The network is static; nothing is kept between batches."""
    usable = cost.costed(net.edges, cost.profile(profile))

    def one(batch: DataFrame, number: int) -> None:
        snap.snap(batch, usable, most_m=radius_m).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return locations.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
