"""An inverted index that follows its corpus: segments, tombstones and merges.

Every batch adds a segment of postings; rows that are deleted or replaced get a tombstone, which hides what older segments
hold of them. Segments of a level are merged into one of the next level when there are ``fan_in`` of them, without the hidden
rows; tombstones go when no older segment is left. So a row is rewritten once per level, and the number of segments grows with the
logarithm of the number of batches.

What is valid stands in numbered manifest files, one small JSON text each, which a commit creates and never overwrites: of two
writers at a time one fails, and a job that dies before its commit leaves nothing that readers see. A batch is named, and a batch that is
committed already is skipped, so a streaming query may repeat it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import small
from .index import KEY, met
from .maintain import POSTINGS, postings


class SegmentConflict(RuntimeError):
    """Another writer committed in the meantime."""


class SegmentedIndex:
    """The index below ``path``; ``state`` is what the newest manifest says."""

    def __init__(self, spark: SparkSession, path: str, fan_in: int = 4):
        self.spark, self.path, self.fan_in = spark, path.rstrip("/"), fan_in

    def _file_system(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def state(self) -> dict:
        folder, files = self._file_system(f"{self.path}/_manifest")
        names = sorted(x.getPath().getName() for x in files.listStatus(folder) if x.getPath().getName().endswith(".json")) if files.exists(folder) else []
        if not names:
            return {"version": 0, "next": 1, "segments": [], "tombstones": [], "batches": []}
        return json.loads(self.spark.read.text(f"{self.path}/_manifest/{names[-1]}", wholetext=True).first().value)

    def _commit(self, state: dict) -> None:
        """Make the next manifest, if nobody else has."""
        version = state["version"] + 1
        name = f"{self.path}/_manifest/{version:012d}.json"
        place, files = self._file_system(name)
        try:
            out = files.create(place, False)
        except Exception as e:
            if files.exists(place):
                raise SegmentConflict(f"version {version} is there already") from e
            raise
        out.write(bytearray(json.dumps(state | {"version": version}), "utf-8"))
        out.close()

    def _write(self, rows: DataFrame, merged: bool = False) -> str:
        """A segment's folder. A batch's postings come in sorted runs; merged ones are sorted as a whole."""
        name = f"segment-{uuid.uuid4().hex}"
        order = ("token", "id")
        dealt = rows.select("db_id", "token", "id", "positions")
        dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order) if merged else dealt
        dealt.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(f"{self.path}/{name}")
        return name

    def apply(self, added: DataFrame | None = None, removed: DataFrame | None = None, batch: str | None = None) -> bool:
        """Add paragraphs, hide the (db_id, id) of ``removed`` in what was there before, or both as one step.

        Changed rows are given in both. Returns whether anything was done: a batch name is taken once.
        """
        state = self.state()
        if batch is not None and batch in state["batches"]:
            return False
        at = state["next"]
        if removed is not None:
            name = f"tombstones-{uuid.uuid4().hex}"
            removed.select(*KEY).distinct().write.parquet(f"{self.path}/{name}")
            state["tombstones"].append({"name": name, "at": at})
        if added is not None:
            state["segments"].append({"name": self._write(postings(added)), "at": at, "level": 0})
        state["batches"] = [*state["batches"], batch][-1000:] if batch is not None else state["batches"]
        self._commit(state | {"next": at + 1})
        return True

    def _hidden(self, state: dict, since: int) -> DataFrame | None:
        """(db_id, id, gone): the newest tombstone of each key that may hide rows of segments from ``since`` on."""
        found = [self.spark.read.schema("db_id string, id long").parquet(f"{self.path}/{t['name']}").withColumn("gone", F.lit(t["at"])) for t in state["tombstones"] if t["at"] > since]
        if not found:
            return None
        every = found[0]
        for f in found[1:]:
            every = every.unionAll(f)
        return every.groupBy(*KEY).agg(F.max("gone").alias("gone"))

    def _live(self, state: dict, segments: list[dict]) -> DataFrame:
        """Postings of some segments without hidden rows; segments newer than all tombstones aren't joined."""
        newest = max((t["at"] for t in state["tombstones"]), default=0)
        parts = {True: None, False: None}
        for s in segments:
            rows = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/{s['name']}").withColumn("at", F.lit(s["at"]))
            old = s["at"] < newest
            parts[old] = rows if parts[old] is None else parts[old].unionAll(rows)
        if parts[True] is not None:
            gone = self._hidden(state, min(s["at"] for s in segments))
            parts[True] = met(parts[True], small(gone, 48), how="left_anti", extra=F.col("at") < F.col("_gone"))
        found = [p for p in parts.values() if p is not None]
        if not found:
            return self.spark.createDataFrame([], POSTINGS)
        return (found[0] if len(found) == 1 else found[0].unionAll(found[1])).drop("at")

    def postings(self) -> DataFrame:
        """(db_id, token, id, positions) of all rows that are there now."""
        state = self.state()
        return self._live(state, state["segments"])

    def merge(self) -> int:
        """Merge full levels, lowest first; returns how many merges were done."""
        done = 0
        while True:
            state = self.state()
            levels: dict[int, list[dict]] = {}
            for s in state["segments"]:
                levels.setdefault(s["level"], []).append(s)
            full = [(level, own) for level, own in sorted(levels.items()) if len(own) >= self.fan_in]
            if not full:
                return done
            level, own = full[0]
            merged = {"name": self._write(self._live(state, own), True), "at": max(s["at"] for s in own), "level": level + 1}
            state["segments"] = [s for s in state["segments"] if s not in own] + [merged]
            oldest = min(s["at"] for s in state["segments"])
            state["tombstones"] = [t for t in state["tombstones"] if t["at"] > oldest]
            self._commit(state)
            done += 1

    def clean(self) -> int:
        """Remove folders that no manifest names: merged segments and what dead jobs left. No reader or writer may be active."""
        state = self.state()
        named = {x["name"] for x in (*state["segments"], *state["tombstones"])}
        folder, files = self._file_system(self.path)
        old = [x.getPath() for x in files.listStatus(folder) if x.getPath().getName().startswith(("segment-", "tombstones-")) and x.getPath().getName() not in named]
        for path in old:
            files.delete(path, True)
        return len(old)
