"""Clusters of a distance stream: its state is a spanning forest, kept from batch to batch.

Adding a pair twice or late changes nothing, as a forest of a forest and new pairs is
that of all pairs; no watermark is needed, and a batch that is run again is harmless.
With a folder the state outlives the driver: each batch writes the next state, and a
new driver goes on from the last whole one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkgrove.config import Thresholds
from linkgrove.operators.linkage import canonical, forest, labels_of, merge_forests
from linkgrove.storage import drop_path, list_paths, unstage


class ForestStream:
    """Holds the forest of all pairs seen so far; at most one pair fewer than objects."""

    def __init__(self, spark: SparkSession, thresholds: Thresholds, folder: str | None = None):
        self.spark, self.thresholds, self.folder = spark, thresholds, folder
        self.state: DataFrame | None = None
        self.batches = 0
        if folder and (last := self._states()):
            self.batches = last[-1]
            self.state = spark.read.parquet(f"{folder}/state-{last[-1]:09d}")

    def _states(self) -> list[int]:
        """Numbers of the states that were written wholly, rising."""
        done = [p for p in list_paths(self.spark, f"{self.folder}/state-*/_SUCCESS")]
        return sorted(int(p.rsplit("/", 2)[1].removeprefix("state-")) for p in done)

    def add(self, batch: DataFrame, batch_id: int | None = None) -> None:
        """Take in (id1, id2, dist) rows: the body of foreachBatch."""
        own = forest(canonical(batch, self.thresholds, False))
        before = self.state
        merged = own if before is None else merge_forests(before, own)
        self.batches += 1
        if self.folder:
            path = f"{self.folder}/state-{self.batches:09d}"
            merged.write.mode("overwrite").parquet(path)
            self.state = self.spark.read.parquet(path)
            for k in self._states()[:-2]:
                drop_path(self.spark, f"{self.folder}/state-{k:09d}")
        else:
            self.state = merged
        if before is not None:
            unstage(own)
            if hasattr(before, "stage_path"):
                unstage(before)

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """Run over a streaming relation; the query is given back."""
        writer = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def clusters(self, objects: DataFrame) -> DataFrame:
        """(subset, t_idx, obj, cluster) of what has come so far."""
        return labels_of(self.state, objects, self.thresholds)
