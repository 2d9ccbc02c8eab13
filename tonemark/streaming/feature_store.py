"""Feature store that fills as clips arrive."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from tonemark.sources import feature_store


def run(
    clips: DataFrame,
    embed: Callable[[object], np.ndarray],
    width: int,
    path: str,
    checkpoint: str,
    payload: str = "payload",
) -> DataFrame:
    """Drain the stream into the store and return the store.

    A batch that is replayed after a failure finds its clips already stored and
    adds nothing.
    """

    def add(batch: DataFrame, _epoch: int) -> None:
        feature_store.append(batch, embed, width, path, payload)

    query = (
        clips.select("clip_id", payload)
        .writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return feature_store.scan(clips.sparkSession, path)
