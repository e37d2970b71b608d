"""Command line: index and search text files, and maintain an index from an operation log."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .errors import RetrievalError
from .operators.index import LexicalIndex
from .operators.retrieve import retrieve
from .sources import lines, snapshot
from .sources.oplog_files import OpLog


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="termloom")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *, log: bool = False, flags: tuple[str, ...] = ()) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        if log:
            c.add_argument("--root", default=".")
            c.add_argument("--checkpoint", default="index.bin")
            c.add_argument("--log", default="ops.log")
        for f in flags:
            c.add_argument(f"--{f}", action="store_true")
        return c

    def ranked(c: argparse.ArgumentParser) -> None:
        c.add_argument("-k", type=int, default=10)
        c.add_argument("query", nargs="+")

    c = command("index", "build an index from a text file, one document a line", flags=("durable",))
    c.add_argument("-i", "--input", required=True)
    c.add_argument("-o", "--output", required=True)
    for name, about in (("search-index", "search a saved index"), ("search", "search a text file")):
        c = command(name, about)
        c.add_argument("-i", "--input", required=True)
        ranked(c)
    c = command("log-add", "log and apply a document", log=True, flags=("durable",))
    c.add_argument("--doc-id", type=int, required=True)
    c.add_argument("--text", required=True)
    c = command("log-delete", "log and apply a deletion", log=True, flags=("durable",))
    c.add_argument("--doc-id", type=int, required=True)
    ranked(command("log-search", "search checkpoint and suffix", log=True, flags=("strict",)))
    command("log-checkpoint", "write a checkpoint", log=True, flags=("reset-log", "durable", "strict"))
    command("log-status", "say what is there and what waits", log=True, flags=("strict",))
    c = command("log-doctor", "find how many records the checkpoint has", log=True, flags=("fix", "durable", "strict"))
    c.add_argument("--max-scan", type=int, default=10_000)
    for name in ("log-compact", "log-prune"):
        command(name, "rewrite the log to one add per document", log=True, flags=("durable", "strict"))
    command("log-scan", "count readable records", log=True, flags=("strict",))
    command("log-validate", "compare checkpoint and suffix with a full replay", log=True, flags=("strict",))
    return p


def _show(query: list[str], hits: DataFrame) -> None:
    print(f"Results for {query!r}:")
    for h in hits.orderBy("rank").collect():  # at most k rows
        print(f"  Doc {h.doc_id}: score {h.score:.4f}")


def run(a: argparse.Namespace, spark: SparkSession) -> None:
    if a.command == "index":
        index = LexicalIndex.build(lines.read_corpus(spark, a.input))
        snapshot.save(index, spark, a.output, a.durable)
        print(f"Indexed {index.scalars().n_docs} documents to {a.output}")
        return
    if a.command in ("search", "search-index"):
        index = snapshot.load(spark, a.input) if a.command == "search-index" else LexicalIndex.build(lines.read_corpus(spark, a.input))
        _show(a.query, retrieve(index, a.query, a.k, spark=spark))
        return
    log = OpLog(spark, a.root, a.checkpoint, a.log)
    if a.command == "log-add":
        log.add(a.doc_id, a.text, a.durable)
        print(f"ok: added document {a.doc_id}")
    elif a.command == "log-delete":
        log.delete(a.doc_id, a.durable)
        print(f"ok: deleted document {a.doc_id}")
    elif a.command == "log-search":
        _show(a.query, retrieve(log.index(a.strict), a.query, a.k, spark=spark))
    elif a.command == "log-checkpoint":
        log.checkpoint(a.reset_log, a.durable, a.strict)
        print("ok: wrote checkpoint")
    elif a.command == "log-status":
        for name, value in log.status(a.strict).first().asDict().items():
            print(f"{name}: {('present' if value else 'missing') if isinstance(value, bool) else value}")
    elif a.command == "log-doctor":
        print(f"ok: wrote meta, {n} records applied" if (n := log.doctor(a.max_scan, a.fix, a.durable, a.strict)) is not None and a.fix else f"ok: {n} records applied")
    elif a.command in ("log-compact", "log-prune"):
        n = log.compact(a.durable, a.strict)
        print(f"ok: {'compacted' if a.command == 'log-compact' else 'pruned'} the log to {n} records")
    elif a.command == "log-scan":
        print(f"ok: scanned log, {log.scan(a.strict)} records")
    elif a.command == "log-validate":
        if not log.validate(a.strict):
            raise RetrievalError("checkpoint and log give different states")
        print("ok: checkpoint and log agree")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    session = spark or SparkSession.builder.appName("termloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        run(a, session)
    except (RetrievalError, FileNotFoundError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
