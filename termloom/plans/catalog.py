"""The registered queries of the lexical engine: each applies one operator to the given tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..errors import RetrievalError
from ..functions import scoring
from ..functions.scoring import Bm25, Dirichlet, JelinekMercer, TfIdf
from ..operators import fuzzy, oplog
from ..operators.index import LexicalIndex
from ..operators.retrieve import MAX_SHARE, as_queries, candidates, plan_candidates, retrieve, score_documents
from ..sources import lines, oplog_files, snapshot
from ..sources.log_parts import LogParts
from ..sources.oplog_files import OpLog
from ..streaming.ingest import OpStream
from .corpus import MISSPELT, NARROW, QUERY, REPEATED, UNSEEN, benchmark_queries, docs, index, ops, table
from .oracle import SQL


def _scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; one of our own in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='termloom-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _ranked(params, query=QUERY, k: int = 10, mode: str = "matching"):
    return lambda spark, d: retrieve(index(spark, d), query, k, params, mode, spark)


def _benchmark(params):
    return lambda spark, d: retrieve(index(spark, d), benchmark_queries(spark, d), 10, params, spark=spark)


def _scored_all(params):
    def run(spark, d):
        i = index(spark, d)
        return score_documents(i, as_queries(spark, QUERY), i.document_ids(), params)

    return run


def _weights(formula):
    def run(spark, d):
        i = index(spark, d)
        return i.term_stats().select("term", F.round(formula(F.lit(i.scalars().n_docs), F.col("df")), 6).alias("idf"))

    return run


def _state(state: DataFrame) -> DataFrame:
    return state.select("doc_id", F.array_join(F.array_sort("terms"), " ").alias("terms"), F.size("terms").cast("long").alias("doc_len"))


def tokenize_docs(spark, d):
    return docs(spark, d).select("doc_id", F.explode("terms").alias("t")).groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.min("t").alias("first_term"), F.max("t").alias("last_term"))


def token_counts(spark, d):
    return docs(spark, d).select("doc_id", F.size("terms").cast("long").alias("doc_len"))


def _line_corpus(spark, d) -> str:
    """A folder with all texts as lines, in order of id: as many files as the sort has ranges, not one task's."""
    path = _scratch(spark, "lines")
    table(spark, d, "documents").orderBy("doc_id").select(F.col("text").alias("value")).write.text(path)
    return path


def line_corpus_scan(spark, d):
    """All texts, in order of id, as one corpus of lines."""
    corpus = lines.read_corpus(spark, _line_corpus(spark, d))
    return corpus.select("doc_id", F.size("terms").cast("long").alias("n_terms"))


def term_frequency_all_docs(spark, d):
    i = index(spark, d)
    return i.term_frequency(i.document_ids().select("doc_id", F.explode(F.array(*map(F.lit, QUERY))).alias("term")))


def document_length_all_docs(spark, d):
    i = index(spark, d)
    return i.document_length(i.document_ids())


def document_length_lookup(spark, d):
    """Of every document, and of an id after each that may not be there."""
    i = index(spark, d)
    ids = i.document_ids()
    return i.document_length(ids.unionByName(ids.select((F.col("doc_id") + 1).alias("doc_id"))).distinct())


def _terms(spark, terms):
    return spark.range(1).select(F.explode(F.array(*map(F.lit, terms))).alias("term"))


def upsert_documents(spark, d):
    """Every document whose id ends in 3 is replaced by one of three terms."""
    changed = docs(spark, d).where("doc_id % 10 = 3").select("doc_id", F.array(F.lit("a"), F.lit("b"), F.lit("a")).alias("terms"))
    return index(spark, d).upsert(changed).doc_stats()


def delete_documents(spark, d):
    gone = docs(spark, d).where("doc_id % 10 = 3")
    return index(spark, d).delete(gone).term_stats().select("term", "df")


def log_state_suffix_merge(spark, d):
    log = ops(spark, d)
    return _state(oplog.merge(oplog.replay(oplog.prefix(log, 4000)), oplog.suffix(log, 4000)))


def log_compact(spark, d):
    kept = oplog.compacted(oplog.replay(ops(spark, d)))
    return kept.select("seq", "op", "doc_id", F.array_join(F.array_sort("terms"), " ").alias("terms"))


#: Records of the log that the queries' checkpoints have seen.
APPLIED = 4000


def _folder_log(spark, d, pending: bool = True) -> OpLog:
    """The events as a log in a folder, the first APPLIED records in the checkpoint; the others wait, or are applied as well."""
    log, written = OpLog(spark, _scratch(spark, "log")), ops(spark, d)
    log.append(oplog.prefix(written, APPLIED))
    rest = oplog.suffix(written, APPLIED)
    (log.log_only if pending else log.append)(rest)
    return log


def _outcome(spark, name: str, act) -> DataFrame:
    """One row: what ``act`` returned, or which error it raised."""
    try:
        said = str(act())
    except RetrievalError as e:
        said = type(e).__name__
    return spark.range(1).select(F.lit(name).alias("what"), F.lit(said).alias("outcome"))


def _outcomes(spark, **acts) -> DataFrame:
    return reduce(DataFrame.unionByName, [_outcome(spark, name, act) for name, act in acts.items()])


def log_status(spark, d):
    return _folder_log(spark, d).status().select("records", "applied", "pending")


def log_status_files(spark, d):
    """What is there before and after a log exists."""
    new = OpLog(spark, _scratch(spark, "log")).status().withColumn("at", F.lit("new"))
    return new.unionByName(_folder_log(spark, d).status().withColumn("at", F.lit("pending")))


def log_append(spark, d):
    """The log as it is read back: two batches, then an add and a delete of its own for the last document."""
    log = _folder_log(spark, d)
    last = ops(spark, d).agg(F.max("doc_id")).first()[0]
    log.add(last, "one more  record")
    log.delete(last)
    return log.read_ops(strict=True).select("seq", "op", "doc_id", F.array_join(F.array_sort("terms"), " ").alias("terms"))


def log_add_delete_state(spark, d):
    """The checkpoint alone, after single ops were applied to it: no record waits."""
    log = _folder_log(spark, d)
    last = ops(spark, d).agg(F.max("doc_id")).first()[0]
    log.add(last + 1, "one more  record")
    log.delete(last)
    return _state(log.checkpoint_index().bag())


def log_compact_files(spark, d):
    """Compaction of checkpoint and suffix: the new log, and whether it validates."""
    log = _folder_log(spark, d)
    kept = log.compact(durable=True)
    valid, status = log.validate(), log.status().first()
    back = log.read_ops(strict=True).select("seq", "op", "doc_id", F.array_join(F.array_sort("terms"), " ").alias("terms"))
    return back.withColumn("valid", F.lit(valid and status.records == status.applied == kept))


def log_prune_validate(spark, d):
    log = _folder_log(spark, d, pending=False)
    before = log.validate()
    log.prune()
    return _state(log.state()).withColumn("valid", F.lit(before and log.validate()))


def log_checkpoint_reset(spark, d):
    """A checkpoint takes all in, the log starts anew, and one record follows."""
    log = _folder_log(spark, d)
    log.checkpoint(durable=True)
    seen = log.status().first()
    log.checkpoint(reset_log=True)
    empty = log.scan()
    log.log_only(spark.createDataFrame([(1, "delete", 0, None)], oplog.OPS))
    return _state(log.state()).select("*", F.lit(seen.applied).alias("applied"), F.lit(empty).cast("long").alias("left_in_log"), F.lit(log.validate()).alias("valid"))


def log_doctor(spark, d):
    """A lost sidecar: search and repair are refused, the offset is found again and written."""
    log = _folder_log(spark, d)
    log.folder.delete(log.meta_name)
    return _outcomes(spark, status=lambda: log.status().first().applied, dry=lambda: log.doctor(), fixed=lambda: log.doctor(fix=True), again=lambda: log.doctor(), valid=lambda: log.validate(), pending=lambda: log.status().first().pending)


def log_meta_guard(spark, d):
    """Every case of sidecar, checkpoint and log."""
    log = _folder_log(spark, d)
    told = log.folder.read(log.meta_name)
    n = log.scan()

    def wrong():
        log.folder.write(log.meta_name, f'{{"applied_records": {n + 1}}}')
        return log.status().first().applied

    def missing():
        log.folder.delete(log.meta_name)
        return log.state().count()

    def restored():
        log.folder.write(log.meta_name, told)
        return log.meta()["applied_records"]

    return _outcomes(spark, whole=lambda: log.status().first().applied, beyond=wrong, missing=missing, restored=restored, new=lambda: OpLog(spark, _scratch(spark, "log")).status().first().applied)


def log_scan_torn(spark, d):
    """A log whose record 7,000 is torn: what a scan reads, and what a strict one says."""
    log = OpLog(spark, _scratch(spark, "log"))
    written = ops(spark, d).select("seq", F.to_json(F.struct("op", "doc_id", "terms")).alias("value"))
    torn = written.withColumn("value", F.when(F.col("seq") == 7000, F.expr("substring(value, 1, length(value) - 3)")).otherwise(F.col("value")))
    parts = LogParts(spark, log.folder, log.log_name)
    torn.repartitionByRange(8, "seq").sortWithinPartitions("seq").select("value").write.text(log.folder.path(parts.part(1)))
    return _outcomes(spark, best_effort=lambda: log.scan(), strict=lambda: log.scan(strict=True))


def log_validate(spark, d):
    log = ops(spark, d)
    merged = oplog.merge(oplog.replay(oplog.prefix(log, 4000)), oplog.suffix(log, 4000))
    return oplog.same_state(merged, oplog.replay(log))


def log_infer_applied(spark, d):
    """A checkpoint of 5,000 records is recognised; later records may leave the state as it was."""
    log = ops(spark, d)
    state = oplog.replay(oplog.prefix(log, 5000))
    found = oplog.infer_applied(log, state, max_scan=10_000_000)
    same = oplog.same_state(state, oplog.replay(oplog.prefix(log, found)))
    return same.select(F.least(F.lit(found), F.lit(5000)).cast("long").alias("at_least"), F.col("valid").alias("same_state"))


def log_infer_largest_prefix(spark, d):
    """The largest prefix that gives the state of the first 5,000 records."""
    log = ops(spark, d)
    found = oplog.infer_applied(log, oplog.replay(oplog.prefix(log, 5000)))
    return log.agg(F.count("*").alias("records")).withColumn("found", F.lit(found).cast("long"))


def log_search_bm25(spark, d):
    return retrieve(LexicalIndex.build(oplog.replay(ops(spark, d))), ["click", "view"], 10, spark=spark)


def log_search_suffix(spark, d):
    """The same search over a stored checkpoint and the records behind it."""
    return retrieve(_folder_log(spark, d).index(), ["click", "view"], 10, spark=spark)


def saved_index_search(spark, d):
    """All texts as a corpus of lines, indexed and searched by the command line's own steps."""
    saved = _scratch(spark, "saved")
    cli.run(cli.parser().parse_args(["index", "-i", _line_corpus(spark, d), "-o", saved, "--durable"]), spark)
    return retrieve(snapshot.load(spark, saved), QUERY, 10, spark=spark)


def snapshot_change(spark, d):
    """A saved index, changed: ids that end in 3 get three terms, those that end in 7 go."""
    path = _scratch(spark, "snapshot")
    snapshot.save(index(spark, d), spark, path)
    every = docs(spark, d)
    snapshot.change(spark, path, every.where("doc_id % 10 = 3").select("doc_id", F.array(F.lit("a"), F.lit("b"), F.lit("a")).alias("terms")), every.where("doc_id % 10 = 7"), durable=True)
    changed = snapshot.load(spark, path)
    return changed.postings().select("term", "doc_id", "tf", "doc_len").withColumn("n_docs", F.lit(changed.scalars().n_docs))


def index_from_postings(spark, d):
    """Statistics of an index that was made of postings alone."""
    made = LexicalIndex.from_postings(index(spark, d).counted().select("term", "doc_id", "tf"))
    return made.postings().groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.max("doc_len").alias("doc_len"))


def guards(spark, d):
    """What is refused, and in which order: an empty query, an empty index, nothing asked for."""
    i, none = index(spark, d), LexicalIndex.empty(spark)
    return _outcomes(
        spark, empty_query=lambda: retrieve(i, [], 10, spark=spark).count(), empty_both=lambda: retrieve(none, [], 10, spark=spark).count(), empty_index=lambda: retrieve(none, QUERY, 10, spark=spark).count(),
        empty_index_k0=lambda: retrieve(none, QUERY, 0, spark=spark).count(), k0=lambda: retrieve(i, QUERY, 0, spark=spark).count(), k3=lambda: retrieve(i, QUERY, 3, spark=spark).count(),
        grams=lambda: fuzzy.FuzzyVocabulary.of_index(i, 0), documents=lambda: i.scalars().n_docs,
    )


def fuzzy_stored_vocabulary(spark, d):
    """Expansions looked up in a stored vocabulary."""
    path = _scratch(spark, "vocabulary")
    _expanded(spark, d)[1].save(path)
    return fuzzy.expand_terms(_terms(spark, MISSPELT), fuzzy.FuzzyVocabulary.load(spark, path)).withColumn("jaccard", F.round("jaccard", 6))


def candidate_plans(spark, d):
    """A broad query and a narrow one."""
    return plan_candidates(index(spark, d), as_queries(spark, {0: QUERY, 1: NARROW}))


def ql_planned(spark, d):
    """The broad query scores all documents, the narrow one those that match."""
    return retrieve(index(spark, d), {0: QUERY, 1: NARROW}, 20, Dirichlet(), "planned", spark)


def log_torn_tail_best_effort(spark, d):
    """A log whose record 7,000 was torn: what stands before it is read."""
    written = ops(spark, d).select((F.col("seq") - 1).alias("pos"), F.to_json(F.struct("seq", "op", "doc_id", "terms")).alias("line"))
    torn = written.withColumn("line", F.when(F.col("pos") == 6999, F.expr("substring(line, 1, length(line) - 3)")).otherwise(F.col("line")))
    return oplog_files.parse_best_effort(torn).select("seq", "op", "doc_id")


def stream_ops_replay(spark, d):
    source = _scratch(spark, "ops")
    ops(spark, d).repartitionByRange(8, "seq").write.json(source)
    stream = OpStream(spark, source, _scratch(spark, "stream"))
    stream.start(max_files=3).awaitTermination()
    return _state(stream.state())


def snapshot_roundtrip(spark, d):
    path = _scratch(spark, "snapshot")
    snapshot.save(index(spark, d), spark, path)
    return snapshot.load(spark, path).postings().select("term", "doc_id", "tf")


def _expanded(spark, d):
    i = index(spark, d)
    return i, fuzzy.FuzzyVocabulary.of_index(i)


QUERIES = {
    "tokenize_docs": tokenize_docs,
    "token_counts": token_counts,
    "line_corpus_scan": line_corpus_scan,
    "postings_build": lambda s, d: index(s, d).postings().select("term", "doc_id", "tf"),
    "postings_list_term": lambda s, d: index(s, d).postings_list("the"),
    "doc_stats": lambda s, d: index(s, d).doc_stats(),
    "corpus_stats": lambda s, d: index(s, d).corpus_stats().withColumn("avg_doc_len", F.round("avg_doc_len", 6)),
    "term_stats": lambda s, d: index(s, d).term_stats(),
    "term_frequency_lookup": term_frequency_all_docs,
    "term_frequency_all_docs": term_frequency_all_docs,
    "document_frequency_lookup": lambda s, d: index(s, d).document_frequency(_terms(s, QUERY + UNSEEN)),
    "document_length_lookup": document_length_lookup,
    "document_length_all_docs": document_length_all_docs,
    "document_ids": lambda s, d: index(s, d).document_ids(),
    "vocabulary": lambda s, d: index(s, d).terms(),
    "idf_bm25": _weights(scoring.idf_smoothed),
    "idf_standard": _weights(scoring.idf_standard),
    "idf_smoothed": _weights(scoring.idf_smoothed),
    "tf_linear": lambda s, d: index(s, d).postings().select("term", "doc_id", scoring.tf_linear(F.col("tf")).alias("weight")),
    "tf_log": lambda s, d: index(s, d).postings().select("term", "doc_id", F.round(scoring.tf_log(F.col("tf")), 6).alias("weight")),
    "candidates_any_term": lambda s, d: candidates(index(s, d), as_queries(s, QUERY)),
    "candidates_scan_all": lambda s, d: candidates(index(s, d), as_queries(s, QUERY), MAX_SHARE),
    "candidates_planned": lambda s, d: candidates(index(s, d), as_queries(s, {0: QUERY, 1: NARROW}), MAX_SHARE),
    "candidate_plans": candidate_plans,
    "bm25_top10": _ranked(Bm25()),
    "bm25l_top10": _ranked(Bm25.lower_bounded()),
    "bm25l_delta_top10": _ranked(Bm25.lower_bounded(0.8)),
    "bm25plus_top10": _ranked(Bm25.plus()),
    "bm25plus_delta_top10": _ranked(Bm25.plus(1.7)),
    "bm25_custom_k1_b": _ranked(Bm25(2.0, 0.3)),
    "bm25_dup_terms": _ranked(Bm25(), REPEATED),
    "bm25_unseen_terms": _ranked(Bm25(), UNSEEN),
    "bm25_score_docs": _scored_all(Bm25()),
    "bm25_score_all_docs": _scored_all(Bm25()),
    "bm25_batch_benchmark": _benchmark(Bm25()),
    "tfidf_default": _ranked(TfIdf()),
    "tfidf_linear": _ranked(TfIdf.linear()),
    "tfidf_smoothed": _ranked(TfIdf.smoothed()),
    "tfidf_linear_smoothed": _ranked(TfIdf("linear", "smoothed")),
    "tfidf_batch_benchmark": _benchmark(TfIdf()),
    "tfidf_score_docs": _scored_all(TfIdf()),
    "tfidf_score_all_docs": _scored_all(TfIdf()),
    "ql_dirichlet": _ranked(Dirichlet()),
    "ql_dirichlet_mu": _ranked(Dirichlet.of(250.0)),
    "ql_jm": _ranked(JelinekMercer()),
    "ql_jm_lambda": _ranked(JelinekMercer.of(0.2), REPEATED),
    "ql_dirichlet_scan_all": _ranked(Dirichlet(), QUERY, 50, "scan_all"),
    "ql_jm_boundary": _ranked(JelinekMercer.of(-1.0)),
    "ql_fallback_all_docs": _ranked(Dirichlet(), UNSEEN),
    "ql_batch_benchmark": _benchmark(Dirichlet()),
    "ql_planned": ql_planned,
    "kgrams_vocab": lambda s, d: _expanded(s, d)[1].grams.select("term", "gram"),
    "gram_overlap_jaccard": lambda s, d: fuzzy.overlaps(_terms(s, MISSPELT), _expanded(s, d)[1]).withColumn("jaccard", F.round("jaccard", 6)),
    "fuzzy_expand_term": lambda s, d: fuzzy.expand_terms(_terms(s, MISSPELT), _expanded(s, d)[1]).withColumn("jaccard", F.round("jaccard", 6)),
    "fuzzy_expand_query": lambda s, d: fuzzy.expand_queries(*_expanded(s, d), as_queries(s, MISSPELT)),
    "fuzzy_bm25": lambda s, d: fuzzy.fuzzy_retrieve(*_expanded(s, d), MISSPELT, 10, spark=s),
    "fuzzy_stored_vocabulary": fuzzy_stored_vocabulary,
    "guards": guards,
    "index_from_postings": index_from_postings,
    "saved_index_search": saved_index_search,
    "snapshot_change": snapshot_change,
    "log_status_files": log_status_files,
    "log_append": log_append,
    "log_add_delete_state": log_add_delete_state,
    "log_compact_files": log_compact_files,
    "log_prune_validate": log_prune_validate,
    "log_checkpoint_reset": log_checkpoint_reset,
    "log_doctor": log_doctor,
    "log_meta_guard": log_meta_guard,
    "log_scan_torn": log_scan_torn,
    "log_search_suffix": log_search_suffix,
    "log_infer_largest_prefix": log_infer_largest_prefix,
    "log_digests": lambda s, d: oplog.digests_by_prefix(ops(s, d)),
    "log_replay_state": lambda s, d: _state(oplog.replay(ops(s, d))),
    "log_state_prefix": lambda s, d: _state(oplog.replay(oplog.prefix(ops(s, d), 5000))),
    "log_state_suffix_merge": log_state_suffix_merge,
    "log_compact": log_compact,
    "log_status": log_status,
    "log_validate": log_validate,
    "log_digest_by_prefix": lambda s, d: oplog.digests_by_prefix(ops(s, d)).select("seq", "n_docs"),
    "log_infer_applied": log_infer_applied,
    "log_search_bm25": log_search_bm25,
    "upsert_documents": upsert_documents,
    "delete_documents": delete_documents,
    "log_torn_tail_best_effort": log_torn_tail_best_effort,
    "stream_ops_replay": stream_ops_replay,
    "snapshot_roundtrip": snapshot_roundtrip,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
