"""Operation logs as streams: JSON files of ops arrive in a folder, a state follows.

Each micro-batch is reduced to the last op of every document and written as a part of the state, before the
pointer to all parts is replaced in one step. The state is the last op of every document over all parts, and as
the last writer by seq wins, their order does not matter, and a batch that runs again after a failure changes nothing.

Parts are merged by size: FAN parts of about one size become one, and all become one when the others together
outgrow the largest. So what a batch writes follows the batch; a row is written again about once for every FAN-fold
growth of the state.

Deletions stay in the state so that late ops lose to them. With ``retain``, those whose seq is more than that far behind
the newest go when all parts are merged, and ops as old as that are late from then on and are left out.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.oplog import OPS
from ..sources.files import Folder

_STATE = "doc_id long, seq long, op string, terms array<string>"
POINTER = "STATE"
#: Parts of about one size that are merged, and how much larger the next size is.
FAN = 8


def _last(ops: DataFrame) -> DataFrame:
    """The last op of every document."""
    return ops.groupBy("doc_id").agg(F.max_by(F.struct("seq", "op", "terms"), "seq").alias("x")).select("doc_id", "x.seq", "x.op", "x.terms")


class OpStream:
    """State of a stream of ops, kept below ``root``."""

    def __init__(self, spark: SparkSession, source: str, root: str, retain: int | None = None):
        self.spark, self.source, self.root, self.retain = spark, source, root.rstrip("/"), retain
        self.folder = Folder(spark, root)

    def _current(self) -> dict | None:
        raw = self.folder.read(POINTER)
        return None if raw is None else json.loads(raw)

    def _read(self, parts: list[dict]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], _STATE)
        return self.spark.read.schema(_STATE).parquet(*[f"{self.root}/{p['version']}" for p in parts])

    def _write(self, rows: DataFrame) -> dict:
        version = f"state-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{version}")
        told = self._read([{"version": version}]).agg(F.count("*").alias("rows"), F.max("seq").alias("seq")).first()
        return {"version": version, "rows": told["rows"], "seq": told["seq"]}

    def _apply(self, batch: DataFrame, batch_id: int) -> None:
        now = self._current() or {"batch": -1, "parts": [], "floor": None}
        if now["batch"] >= batch_id:
            return  # this batch was committed before a restart
        ops = batch.select("doc_id", "seq", "op", "terms")
        if now["floor"] is not None:
            ops = ops.where(F.col("seq") > now["floor"])
        parts, floor, unused = self._merged([*now["parts"], self._write(_last(ops))], now["floor"])
        self.folder.write(POINTER, json.dumps({"batch": batch_id, "parts": parts, "floor": floor}))
        for version in {p["version"] for p in now["parts"]} - {p["version"] for p in parts} | unused:
            self.folder.delete(version)

    def _merged(self, parts: list[dict], floor: int | None) -> tuple[list[dict], int | None, set[str]]:
        """Parts after the merges that are due, the floor of late ops, and versions that were made on the way."""
        parts, unused = [p for p in parts if p["rows"]], {p["version"] for p in parts if not p["rows"]}
        while len(parts) > 1:
            largest = max(p["rows"] for p in parts)
            if sum(p["rows"] for p in parts) > 2 * largest:
                due = parts
            else:
                sizes = defaultdict(list)
                for p in parts:
                    sizes[(p["rows"].bit_length() - 1) // (FAN.bit_length() - 1)].append(p)
                due = next((ps for _, ps in sorted(sizes.items()) if len(ps) >= FAN), None)
                if due is None:
                    break
            rows = _last(self._read(due))
            if len(due) == len(parts) and self.retain is not None:
                floor = max(floor or 0, max(p["seq"] for p in parts) - self.retain)
                rows = rows.where((F.col("op") == "add") | (F.col("seq") > floor))
            unused |= {p["version"] for p in due}
            parts = [p for p in parts if p not in due] + [self._write(rows)]
        return parts, floor, unused

    def start(self, max_files: int = 100) -> StreamingQuery:
        """Takes in all files that are there and ends."""
        ops = self.spark.readStream.schema(OPS).option("maxFilesPerTrigger", max_files).json(self.source)
        return ops.writeStream.foreachBatch(self._apply).option("checkpointLocation", f"{self.root}/progress").trigger(availableNow=True).start()

    def state(self) -> DataFrame:
        """doc_id, terms of the live documents."""
        now = self._current()
        last = _last(self._read(now["parts"] if now else []))
        return last.where("op = 'add'").select("doc_id", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
