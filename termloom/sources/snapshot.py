"""Index snapshots: a base of Parquet tables and deltas over it, behind a pointer that is swapped in one step.

Postings are range-partitioned and sorted by term, so a query's terms prune row groups by Parquet's own
statistics. A change writes a delta: the changed documents' own tables and ``gone``, the ids that no older part
holds any more. A row counts if no later part has its document in ``gone``. Deltas are merged with one another
when there are MOST_DELTAS of them, and with the base when they hold more than a BASE_SHARE of the documents, so a
change writes about as much as it changes.

The pointer is written last: a reader sees the old parts or the new ones. With ``durable`` the pointer is
synced; Spark's Parquet writer has no sync for data files, so their durability is that of the store.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import DOC_STATS, POSTINGS, TERM_STATS, CorpusStats, LexicalIndex
from .files import Folder

POINTER = "CURRENT"
GONE = "doc_id long"
MOST_DELTAS, BASE_SHARE = 8, 0.25
#: Merged deltas of at most so many documents are written by one task.
FEW_DOCS = 10_000
#: Ids of changed documents that are broadcast, some 64 bytes each.
MOST_BROADCAST = 1_000_000


def _write(index: LexicalIndex, base: str, few: bool = False) -> None:
    """Postings by term and documents by id; in one file each if they are few."""
    # counted row by row, postings shuffle once, into their ranges; those of a frequent term can fill several
    postings, docs = index.counted(), index.doc_stats()
    ordered = (postings.coalesce(1), docs.coalesce(1)) if few else (postings.repartitionByRange("term", "doc_id"), docs.repartitionByRange("doc_id"))
    ordered[0].sortWithinPartitions("term", "doc_id").write.parquet(f"{base}/postings")
    ordered[1].sortWithinPartitions("doc_id").write.parquet(f"{base}/doc_stats")


def _pointer(version: str, n_docs: int, total_len: int, deltas: list[dict]) -> dict:
    return {"version": version, "n_docs": n_docs, "total_len": total_len, "avg_doc_len": total_len / n_docs if n_docs else 0.0, "deltas": deltas}


def write_version(index: LexicalIndex, spark: SparkSession, root: str) -> dict:
    """Writes a base and returns what a pointer holds: version, corpus statistics and deltas (none yet)."""
    version = f"v-{uuid.uuid4().hex}"
    base = f"{root.rstrip('/')}/{version}"
    _write(index, base)
    postings = spark.read.schema(POSTINGS).parquet(f"{base}/postings")
    postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{base}/term_stats")
    s = LexicalIndex(postings=postings, doc_stats=spark.read.schema(DOC_STATS).parquet(f"{base}/doc_stats")).scalars()
    return _pointer(version, s.n_docs, s.total_len, [])


def _live(parts: list[DataFrame], gone: list[DataFrame], n_gone: int) -> DataFrame:
    """Rows of parts, the oldest first, without those whose document a later part has in ``gone`` (one for each part but the first).

    There are ``n_gone`` ids; unless they are very many they go to the rows, which stay where they are.
    """
    stacked = [p.withColumn("__part", F.lit(n)) for n, p in enumerate(parts)]
    ids = [g.withColumn("__part", F.lit(n + 1)) for n, g in enumerate(gone)]
    last = reduce(DataFrame.unionByName, ids).groupBy("doc_id").agg(F.max("__part").alias("__gone"))
    joined = reduce(DataFrame.unionByName, stacked).join(F.broadcast(last) if n_gone <= MOST_BROADCAST else last, "doc_id", "left")
    return joined.where("__gone IS NULL OR __part >= __gone").select(*parts[0].columns)


def read_version(spark: SparkSession, root: str, pointer: dict) -> LexicalIndex:
    table = lambda version, name, schema: spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{version}/{name}")
    deltas = [d["version"] for d in pointer.get("deltas", ())]
    every = [pointer["version"], *deltas]
    if deltas:
        gone = [table(d, "gone", GONE) for d in deltas]
        n_gone = sum(d["rows"] for d in pointer["deltas"])
        index = LexicalIndex(postings=_live([table(v, "postings", POSTINGS) for v in every], gone, n_gone), doc_stats=_live([table(v, "doc_stats", DOC_STATS) for v in every], gone, n_gone))
    else:
        v = pointer["version"]
        index = LexicalIndex(postings=table(v, "postings", POSTINGS), doc_stats=table(v, "doc_stats", DOC_STATS), term_stats=table(v, "term_stats", TERM_STATS))
    if "n_docs" in pointer:
        index._scalars = CorpusStats(pointer["n_docs"], pointer["total_len"], pointer["avg_doc_len"])
    return index


def versions(pointer: dict | None) -> set[str]:
    """The folders that a pointer reads."""
    return set() if pointer is None else {pointer["version"], *(d["version"] for d in pointer.get("deltas", ()))}


def write_delta(spark: SparkSession, root: str, pointer: dict, docs: DataFrame, gone: DataFrame, few: bool = False) -> dict:
    """A pointer to the same index with ``docs`` (doc_id, terms) put in place of what it held of them and of the ids ``gone`` (doc_id).

    Of the older parts only the lengths of changed documents are read, in the range of their ids.
    """
    version = f"d-{uuid.uuid4().hex}"
    base = f"{root.rstrip('/')}/{version}"
    ids = docs.select("doc_id").unionByName(gone.select("doc_id")).distinct()
    (ids.coalesce(1) if few else ids).write.parquet(f"{base}/gone")
    _write(LexicalIndex.build(docs), base, few)
    changed = spark.read.schema(GONE).parquet(f"{base}/gone")
    span = changed.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    if not span["n"]:
        Folder(spark, root).delete(version)
        return pointer
    held = read_version(spark, root, pointer).doc_stats().where(F.col("doc_id").between(span["low"], span["high"]))
    lengths = held.join(changed, "doc_id", "left_semi").select(F.lit("old").alias("side"), "doc_len").unionByName(spark.read.schema(DOC_STATS).parquet(f"{base}/doc_stats").select(F.lit("new").alias("side"), "doc_len"))
    told = {r.side: r for r in lengths.groupBy("side").agg(F.count("*").alias("n"), F.sum("doc_len").alias("total")).collect()}
    old, new = (told[side].asDict() if side in told else {"n": 0, "total": 0} for side in ("old", "new"))
    out = _pointer(pointer["version"], pointer["n_docs"] - old["n"] + new["n"], pointer["total_len"] - old["total"] + new["total"], [*pointer.get("deltas", ()), {"version": version, "rows": span["n"]}])
    rows = sum(d["rows"] for d in out["deltas"])
    if rows > BASE_SHARE * max(out["n_docs"], 1) and len(out["deltas"]) > 1 or rows > max(out["n_docs"], MOST_DELTAS):
        merged = write_version(read_version(spark, root, out), spark, root)
    elif len(out["deltas"]) >= MOST_DELTAS:
        merged = _merged(spark, root, out, rows)
    else:
        return out
    Folder(spark, root).delete(version)  # no pointer names it
    return merged


def _merged(spark: SparkSession, root: str, pointer: dict, rows: int) -> dict:
    """The same index with its deltas, of ``rows`` changed documents, merged into one."""
    version = f"d-{uuid.uuid4().hex}"
    base = f"{root.rstrip('/')}/{version}"
    table = lambda d, name, schema: spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{d['version']}/{name}")
    deltas = pointer["deltas"]
    gone = [table(d, "gone", GONE) for d in deltas]
    few = rows <= FEW_DOCS
    live = lambda name, schema: _live([table(d, name, schema) for d in deltas], gone[1:], rows)
    _write(LexicalIndex(postings=live("postings", POSTINGS), doc_stats=live("doc_stats", DOC_STATS)), base, few)
    ids = reduce(DataFrame.unionByName, gone).distinct()
    (ids.coalesce(1) if few else ids).write.parquet(f"{base}/gone")
    n = spark.read.schema(GONE).parquet(f"{base}/gone").count()
    return pointer | {"deltas": [{"version": version, "rows": n}]}


def _read_pointer(spark: SparkSession, root: str) -> dict:
    pointer = Folder(spark, root).read(POINTER)
    if pointer is None:
        raise FileNotFoundError(f"no saved index in {root}")
    return json.loads(pointer)


def _swap(spark: SparkSession, root: str, before: dict | None, pointer: dict, durable: bool) -> None:
    folder = Folder(spark, root)
    folder.write(POINTER, json.dumps(pointer), durable)
    for version in versions(before) - versions(pointer):
        folder.delete(version)


def save(index: LexicalIndex, spark: SparkSession, root: str, durable: bool = False) -> None:
    """Saves an index below ``root``; an older version goes once the new one is in place."""
    before = Folder(spark, root).read(POINTER)
    _swap(spark, root, None if before is None else json.loads(before), write_version(index, spark, root), durable)


def change(spark: SparkSession, root: str, docs: DataFrame | None = None, gone: DataFrame | None = None, durable: bool = False) -> None:
    """Puts ``docs`` (doc_id, terms) into a saved index, in place of older ones, and takes the ids ``gone`` (doc_id) out.

    Writes about as much as changes; an id in both ends up in the index.
    """
    before = _read_pointer(spark, root)
    docs = spark.createDataFrame([], "doc_id long, terms array<string>") if docs is None else docs
    gone = spark.createDataFrame([], GONE) if gone is None else gone
    _swap(spark, root, before, write_delta(spark, root, before, docs, gone), durable)


def load(spark: SparkSession, root: str) -> LexicalIndex:
    return read_version(spark, root, _read_pointer(spark, root))
