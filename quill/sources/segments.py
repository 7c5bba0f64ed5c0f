"""Stored indexes made of segments: each commit adds one, or a list of ids that are dead from then on.

A row counts from its segment's version; a later list of dead ids ends that. So an insert never touches what is
stored, and an id that comes back after a delete is alive again. Small segments are merged, oldest commits first in force.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.sources import commits
from quill.sources.shared import BROADCAST_BYTES, checkpoint, row_bytes

DEAD = "chunk_id long"
#: Segments beyond which a merge is due.
SEGMENTS = 8


@dataclass(frozen=True)
class Segmented:
    """A version of a stored index: its log and the version's state. Rows of the folder dead are ids."""

    log: commits.Log
    state: commits.State

    @property
    def spark(self) -> SparkSession:
        return self.log.spark

    def segments_of(self, folder: str) -> list[int]:
        return sorted(set(self.state.below(folder).values()))

    def rows_since(self, folder: str, schema: str) -> DataFrame:
        """All rows of a folder with the version since which they count."""
        files = self.state.below(folder)
        parts = [self.log.read(commits.State(files={f: v for f, v in files.items() if v == since}), schema, folder).withColumn("since", F.lit(since)) for since in sorted(set(files.values()))]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{schema}, since int")

    @cached_property
    def dead(self) -> DataFrame | None:
        """(chunk_id, died), or None if there never was a delete."""
        if not self.state.below("dead"):
            return None
        ids = checkpoint(self.rows_since("dead", DEAD).groupBy("chunk_id").agg(F.max("since").alias("died")))
        return F.broadcast(ids) if (ids.agg(F.sum(row_bytes(ids))).first()[0] or 0) <= BROADCAST_BYTES else ids

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows (chunk_id, since, ...) that no later list of dead ids names, without since."""
        if self.dead is not None:
            rows = rows.join(self.dead, "chunk_id", "left").where(F.col("died").isNull() | (F.col("died") <= F.col("since"))).drop("died")
        return rows.drop("since")

    def stage_dead(self, ids: DataFrame, staged: str | None = None) -> str:
        return self.log.stage(ids.select(F.col("chunk_id").cast("long").alias("chunk_id")).distinct().coalesce(1), "dead", staged=staged)

    def to_merge(self, folder: str, all_segments: bool = False) -> tuple[list[int], bool]:
        """The segments to write anew as one: all, or the newest ones that together are as large as the next older; and whether no other is left."""
        if set(self.state.below(folder)) - set(self.log.state().files):
            raise commits.Conflict("its segments are merged already")
        size = dict.fromkeys(self.segments_of(folder), 0)
        for name, since in self.state.below(folder).items():
            size[since] += self.log.bytes_of(name)
        chosen: list[int] = []
        for since in sorted(size, reverse=True):
            if not all_segments and len(chosen) > 1 and size[since] > sum(size[c] for c in chosen):
                break
            chosen.append(since)
        return chosen, len(chosen) == len(size)

    def files_of(self, segments: list[int], *folders: str) -> list[str]:
        return [f for folder in folders for f, v in self.state.below(folder).items() if v in segments]

    def only(self, files: list[str]) -> commits.State:
        """The version's state with no other files than these and the lists of dead ids."""
        keep = set(files)
        return commits.State(self.state.version, {f: v for f, v in self.state.files.items() if f in keep or f.startswith("dead/")}, self.state.properties)

    def commit_merge(self, staged: str, old: list[str], whole: bool) -> commits.State:
        """Put staged in the place of old. Lists of dead ids go once no older segment is left; commits that came meanwhile stay in force."""
        return self.log.commit(self.state, staged, old + (list(self.state.below("dead")) if whole else []), since=self.state.version, rebase=True)
