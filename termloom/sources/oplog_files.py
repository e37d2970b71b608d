"""An operation log with checkpoints in a folder, maintained by single ops, batches and compaction.

The log is a folder of numbered parts (``log_parts``). A commit is one small file that names the log, the
snapshot with its deltas, and how many records that has seen; commits are numbered, and a number goes to
one writer only. Whoever finds a number taken starts over from the commit that took it. So log, snapshot and
offset change together, in one step, and a crash between any two writes leaves the state before or after it.
What a commit no longer names is deleted when the next but one is made, so readers can finish.

The sidecar ``<checkpoint>.meta`` repeats the offset for others to read. It is written before its commit and
tells which one it belongs to; if another commit came to pass, that one's own offset counts. Without a
sidecar the offset counts as lost, until ``doctor`` finds it again from the states.

A record is logged before the commit. Replaying a suffix twice changes nothing, and a commit writes a
delta of the documents it changes. Compaction starts from checkpoint and suffix, so documents that were checkpointed
before a log reset stay; it seals the old log first, so that no record can slip in behind it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import LogStateError
from ..operators import oplog
from ..operators.index import LexicalIndex
from . import snapshot
from .files import Folder
from .log_parts import LogParts

#: Changes of at most so many records are written by one task, in one file each.
FEW_RECORDS = 10_000

_RECORD = "seq long, op string, doc_id long, terms array<string>, _broken string"


def _parsed(lines: DataFrame) -> DataFrame:
    read = lines.select("pos", F.from_json("line", _RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))
    good = F.col("r._broken").isNull() & F.col("r.op").isin("add", "delete") & F.col("r.doc_id").isNotNull()
    return read.withColumn("good", F.coalesce(good, F.lit(False)))


def _ops(read: DataFrame) -> DataFrame:
    return read.select((F.col("pos") + 1).alias("seq"), "r.op", "r.doc_id", "r.terms")


def parse_best_effort(lines: DataFrame) -> DataFrame:
    """The ops of (pos, line) up to the first line that is not a whole record; seq is pos + 1."""
    read = _parsed(lines)
    first_bad = read.where(~F.col("good")).agg(F.min("pos").alias("bad"))
    return _ops(read.join(F.broadcast(first_bad)).where(F.col("bad").isNull() | (F.col("pos") < F.col("bad"))))


def parse_strict(lines: DataFrame) -> DataFrame:
    """All ops of (pos, line); raises LogStateError if a line is not a whole record."""
    read = _parsed(lines)
    bad = read.where(~F.col("good")).agg(F.min("pos")).first()[0]
    if bad is not None:
        raise LogStateError(f"UnexpectedEof: record {bad + 1} of the log is torn or corrupt")
    return _ops(read)


class OpLog:
    """add, delete, append, search, checkpoint, status, doctor, compact, scan and validate over one folder."""

    def __init__(self, spark: SparkSession, root: str, checkpoint: str = "index.bin", log: str = "ops.log"):
        self.spark, self.folder = spark, Folder(spark, root)
        self.checkpoint_name, self.log_name, self.meta_name = checkpoint, log, f"{checkpoint}.meta"

    # -- commits

    def _commit_file(self, n: int) -> str:
        return f"{self.checkpoint_name}/{n:015d}.json"

    def _numbers(self) -> list[int]:
        return [int(x.removesuffix(".json")) for x in self.folder.names(self.checkpoint_name) if x.endswith(".json") and not x.startswith(".")]

    def _current(self) -> dict | None:
        """The last commit: number, id, log, pointer (of the snapshot), meta."""
        while numbers := self._numbers():
            raw = self.folder.read(self._commit_file(max(numbers)))
            if raw is not None:  # else others have gone on meanwhile
                return json.loads(raw) | {"number": max(numbers)}
        return None

    def _log(self, commit: dict | None) -> LogParts:
        return LogParts(self.spark, self.folder, commit["log"] if commit else self.log_name)

    def _try_commit(self, before: dict | None, log: str, pointer: dict, meta: dict, durable: bool) -> bool:
        """Makes the commit after ``before``, unless another writer made one."""
        number, made = (before["number"] if before else 0) + 1, uuid.uuid4().hex
        self.folder.write(self.meta_name, json.dumps(meta | {"commit": made}), durable)
        if not self.folder.write_new(self._commit_file(number), json.dumps({"id": made, "log": log, "pointer": pointer, "meta": meta}), durable):
            return False
        if before is not None:
            self._clean(number - 2, before, {"log": log, "pointer": pointer, "meta": meta})
        return True

    def _versions(self, commit: dict) -> set[str]:
        return snapshot.versions(commit["pointer"]) | snapshot.versions(commit["meta"].get("base"))

    def _clean(self, number: int, *kept: dict) -> None:
        """Deletes the commit ``number`` and what only it names."""
        raw = self.folder.read(self._commit_file(number)) if number > 0 else None
        if raw is None:
            return
        old = json.loads(raw)
        for version in self._versions(old).difference(*map(self._versions, kept)):
            self.folder.delete(version)
        if old["log"] not in {k["log"] for k in kept}:
            self.folder.delete(old["log"])
        self.folder.delete(self._commit_file(number))

    # -- reading

    def read_ops(self, strict: bool = False) -> DataFrame:
        lines = self._log(self._current()).lines()
        return parse_strict(lines) if strict else parse_best_effort(lines)

    def meta(self) -> dict | None:
        """{"applied_records", "applied_parts", "base"}; None if there is no sidecar."""
        return self._meta(self._current())

    def _meta(self, commit: dict | None) -> dict | None:
        raw = self.folder.read(self.meta_name)
        if raw is None:
            return None
        told = json.loads(raw)
        if "commit" in told and told["commit"] != (commit or {}).get("id"):
            return commit["meta"] if commit else {"applied_records": 0, "applied_parts": 0, "base": None}
        return told

    def checkpoint_index(self) -> LexicalIndex:
        return self._index_of(self._current())

    def _index_of(self, commit: dict | None) -> LexicalIndex:
        return LexicalIndex.empty(self.spark) if commit is None else snapshot.read_version(self.spark, self.folder.root, commit["pointer"])

    def scan(self, strict: bool = False) -> int:
        """Readable records, whatever the checkpoint says."""
        return self.read_ops(strict).count()

    def _applied(self, commit: dict | None, n_ops: int) -> int:
        """How many records the checkpoint has seen; an error if that cannot be known."""
        meta = self._meta(commit)
        if meta is not None:
            if meta["applied_records"] > n_ops:
                raise LogStateError(f"invalid meta: {meta['applied_records']} records applied, {n_ops} in the log")
            return meta["applied_records"]
        if n_ops == 0 or commit is None:
            return 0
        raise LogStateError("meta missing: cannot tell which records the checkpoint has; repair it with doctor(fix=True)")

    def _suffix(self, commit: dict | None, strict: bool = False, last: int | None = None) -> tuple[DataFrame, int]:
        """The ops that the checkpoint has not seen, up to the part ``last``, and how many it has.

        Only their parts are read if the checkpoint ends with a part; ``strict`` reads the whole log.
        """
        meta, parts = self._meta(commit), self._log(commit)
        known = None if meta is None else meta.get("applied_parts")
        if known is not None and not strict and (not known or self.folder.exists(parts.part(known))):
            return parse_best_effort(parts.lines(known, meta["applied_records"], last)), meta["applied_records"]
        ops = parse_strict(parts.lines(last=last)) if strict else parse_best_effort(parts.lines(last=last))
        applied = self._applied(commit, ops.count())
        return oplog.suffix(ops, applied), applied

    def state(self, strict: bool = False) -> DataFrame:
        """doc_id, terms of checkpoint and suffix."""
        return self._state(self._current(), strict)

    def _state(self, commit: dict | None, strict: bool = False) -> DataFrame:
        return oplog.merge(self._index_of(commit).bag(), self._suffix(commit, strict)[0])

    def index(self, strict: bool = False) -> LexicalIndex:
        """Checkpoint and suffix as one index; of the checkpoint, only rows of a query's terms are read."""
        commit = self._current()
        rest = self._suffix(commit, strict)[0]
        changed = self._index_of(commit).delete(rest)
        fresh = LexicalIndex.build(oplog.replay(rest))
        return LexicalIndex(postings=changed.postings().unionByName(fresh.postings()), doc_stats=changed.doc_stats().unionByName(fresh.doc_stats()))

    # -- writing

    def _pointer(self, commit: dict | None, rest: DataFrame, few: bool = False) -> dict:
        """A snapshot of the commit's with the ops ``rest`` applied."""
        if commit is None:
            return snapshot.write_version(LexicalIndex.build(oplog.replay(rest), unique=True), self.spark, self.folder.root)
        return snapshot.write_delta(self.spark, self.folder.root, commit["pointer"], oplog.replay(rest), rest.select("doc_id"), few)

    def _advance(self, append, durable: bool) -> None:
        """Logs records by ``append(parts, known)`` and commits what the log then holds beyond the checkpoint."""
        commit = self._current()
        rest, applied = self._suffix(commit)
        meta = self._meta(commit) or {}
        known = meta.get("applied_parts") or 0
        self._set_torn_aside(commit, rest, applied, known)
        if not append(self._log(commit), known):
            return
        while True:
            commit = self._current()
            parts, meta = self._log(commit), self._meta(commit) or {"base": None}
            last = parts.last(meta.get("applied_parts") or 0)
            rest, applied = self._suffix(commit, last=last)
            rest = rest.persist()
            waiting = rest.count()
            n = applied + waiting
            # a single op takes up all that waits, which can be a whole log
            pointer = self._pointer(commit, rest, waiting <= FEW_RECORDS)
            rest.unpersist()
            if self._try_commit(commit, parts.name, pointer, {"applied_records": n, "applied_parts": last, "base": meta.get("base")}, durable):
                return
            for version in snapshot.versions(pointer) - (snapshot.versions(commit["pointer"]) if commit else set()):
                self.folder.delete(version)

    def _set_torn_aside(self, commit: dict | None, rest: DataFrame, applied: int, known: int) -> None:
        """Takes a last part that cannot be read out of the log: no record may stand behind it."""
        parts = self._log(commit)
        last = parts.last(known)
        if last <= known or parts.sealed(last):
            return
        told = parts.lines(known, applied)
        bad = _parsed(told).where("not good").agg(F.min("pos")).first()[0]
        if bad is None:
            return
        if rest.count() < told.count() - 1 or self.folder.names(parts.part(last)) != [parts.part(last).rpartition("/")[2]]:
            raise LogStateError(f"record {bad + 1} of the log is corrupt and others follow it")
        self.folder.publish(parts.part(last), f"{parts.name}/.torn-{uuid.uuid4().hex}")

    def add(self, doc_id: int, text: str, durable: bool = False) -> None:
        self._advance(lambda parts, known: parts.append("add", doc_id, text.split(), known, durable), durable)

    def delete(self, doc_id: int, durable: bool = False) -> None:
        """Logged even if the document is not there."""
        self._advance(lambda parts, known: parts.append("delete", doc_id, None, known, durable), durable)

    def append(self, ops: DataFrame, durable: bool = False) -> None:
        """Logs a batch of ops (seq, op, doc_id, terms), in order of seq, as one part, and applies it."""
        self._advance(lambda parts, known: parts.append_all(ops, known), durable)

    def log_only(self, ops: DataFrame) -> None:
        """Logs a batch that no checkpoint takes up yet."""
        commit = self._current()
        self._log(commit).append_all(ops, (self._meta(commit) or {}).get("applied_parts") or 0)

    def checkpoint(self, reset_log: bool = False, durable: bool = False, strict: bool = False) -> None:
        """Writes checkpoint and meta; with ``reset_log`` the log starts anew from this checkpoint."""
        while True:
            commit = self._current()
            parts = self._log(commit)
            if reset_log:
                parts.seal()
            last = parts.last((self._meta(commit) or {}).get("applied_parts") or 0)
            rest, applied = self._suffix(commit, strict, last)
            n = applied + rest.count()
            pointer = self._pointer(commit, rest)
            if reset_log:
                log, meta = f"{self.log_name}-{uuid.uuid4().hex}", {"applied_records": 0, "applied_parts": 0, "base": pointer}
            else:
                log, meta = parts.name, {"applied_records": n, "applied_parts": last, "base": (self._meta(commit) or {}).get("base")}
            if self._try_commit(commit, log, pointer, meta, durable):
                return

    def status(self, strict: bool = False) -> DataFrame:
        """One row: what is there and how many records wait."""
        commit = self._current()
        parts = self._log(commit)
        n = self.scan(strict)
        applied = self._applied(commit, n)
        return self.spark.range(1).select(
            F.lit(commit is not None).alias("checkpoint"), F.lit(self._meta(commit) is not None).alias("meta"), F.lit(self.folder.exists(parts.part(1)) and not parts.sealed(1)).alias("log"),
            F.lit(n).cast("long").alias("records"), F.lit(applied).cast("long").alias("applied"), F.lit(max(n - applied, 0)).cast("long").alias("pending"),
        )

    def doctor(self, max_scan: int | None = None, fix: bool = False, durable: bool = False, strict: bool = False) -> int:
        """The number of applied records, found from the states if the sidecar is missing; ``fix`` writes it."""
        commit = self._current()
        ops = self.read_ops(strict)
        if self._meta(commit) is not None:
            return self._applied(commit, ops.count())
        found = oplog.infer_applied(ops, self._index_of(commit).bag(), max_scan)
        if found is None:
            raise LogStateError("no prefix of the log gives the checkpoint")
        if not fix:
            raise LogStateError(f"meta missing: {found} records seem to be applied; fix=True writes that")
        base = commit["meta"]["base"] if commit else None
        self.folder.write(self.meta_name, json.dumps({"applied_records": found, "base": base}), durable)
        return found

    def compact(self, durable: bool = False, strict: bool = False) -> int:
        """A log of one add per document, with checkpoint and meta to match; returns its length.

        Executors write the new log; one commit puts log, snapshot and offset in place. A compaction that was cut
        off leaves the old log sealed: it reads as before, and another compaction goes on from there.
        """
        while True:
            commit = self._current()
            self._log(commit).seal()
            fresh = LogParts(self.spark, self.folder, f"{self.log_name}-{uuid.uuid4().hex}")
            part = fresh.append_all(self._state(commit, strict).select(F.col("doc_id").alias("seq"), F.lit("add").alias("op"), "doc_id", "terms"))
            kept = parse_strict(fresh.lines())
            pointer = snapshot.write_version(LexicalIndex.build(oplog.replay(kept), unique=True), self.spark, self.folder.root)
            if self._try_commit(commit, fresh.name, pointer, {"applied_records": pointer["n_docs"], "applied_parts": part, "base": None}, durable):
                return pointer["n_docs"]
            self.folder.delete(fresh.name)
            self.folder.delete(pointer["version"])

    prune = compact

    def validate(self, strict: bool = False) -> bool:
        """Whether checkpoint and suffix give the same state as the whole log from its base."""
        commit = self._current()
        base = (self._meta(commit) or {}).get("base")
        start = LexicalIndex.empty(self.spark) if base is None else snapshot.read_version(self.spark, self.folder.root, base)
        return oplog.same_state(self._state(commit, strict), oplog.merge(start.bag(), self.read_ops(strict))).first()["valid"]
