import json
import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from termloom import cli
from termloom.errors import LogStateError
from termloom.functions.text import whitespace_tokens
from termloom.operators import oplog
from termloom.operators.index import LexicalIndex
from termloom.operators.retrieve import _matched, _weighted, as_queries, retrieve
from termloom.operators.scan import numbered, running
from termloom.plans import catalog
from termloom.sources import lines, snapshot
from termloom.sources.files import Folder
from termloom.sources.log_parts import LogParts
from termloom.sources.oplog_files import OpLog
from termloom.streaming.ingest import OpStream

DOCS = "doc_id long, terms array<string>"


def state(df):
    return sorted((r.doc_id, sorted(r.terms)) for r in df.collect())


def ops_of(spark, rows):
    return spark.createDataFrame([(n + 1, *r) for n, r in enumerate(rows)], oplog.OPS)


ROWS = [("add", 1, ["a"]), ("add", 1, ["b", "b"]), ("delete", 1, None), ("add", 1, ["c"]), ("add", 2, ["d"]), ("delete", 9, None), ("add", 3, []), ("delete", 2, None)]


def test_last_writer_wins(spark):
    ops = ops_of(spark, ROWS)
    assert state(oplog.replay(ops)) == [(1, ["c"]), (3, [])]
    for applied in range(len(ROWS) + 1):
        merged = oplog.merge(oplog.replay(oplog.prefix(ops, applied)), oplog.suffix(ops, applied))
        assert state(merged) == [(1, ["c"]), (3, [])]
        again = oplog.merge(merged, oplog.suffix(ops, applied))
        assert state(again) == [(1, ["c"]), (3, [])]
    assert oplog.same_state(oplog.replay(ops), merged).first().valid
    assert oplog.differences(oplog.replay(ops), merged).count() == 0
    kept = oplog.compacted(oplog.replay(ops))
    assert [(r.seq, r.doc_id) for r in kept.orderBy("seq").collect()] == [(1, 1), (2, 3)]


def test_digests_of_prefixes_equal_replays(spark):
    ops = ops_of(spark, ROWS)
    plain = {n: tuple(oplog.digest(oplog.replay(oplog.prefix(ops, n))).first()) for n in range(1, len(ROWS) + 1)}
    for width in (2, 3, 65536):  # stretches of two and three records need three and two levels of totals
        assert {r.seq: (r.n_docs, r.mark, r.mark2) for r in oplog.digests_by_prefix(ops, width=width).collect()} == plain
    assert oplog.infer_applied(ops, oplog.replay(oplog.prefix(ops, 2))) == 2
    assert oplog.infer_applied(ops, oplog.replay(oplog.prefix(ops, 5))) == 6  # the largest prefix with that state
    assert oplog.infer_applied(ops, spark.createDataFrame([(7, ["q"])], DOCS)) is None
    with pytest.raises(ValueError):
        oplog.infer_applied(ops, oplog.replay(ops), max_scan=3)


def test_a_prefix_is_found_with_one_reading_of_the_log(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    ops = ops_of(spark, ROWS).mapInArrow(seen, oplog.OPS)
    assert oplog.infer_applied(ops, oplog.replay(oplog.prefix(ops_of(spark, ROWS), 5))) == 6
    assert read.value == len(ROWS)


def test_line_corpus(spark, tmp_path):
    path = tmp_path / "c.txt"
    for content, want in (
        (b"a b\r\n\nc\rd\ne", [["a", "b"], [], ["c", "d"], ["e"]]), (b"a\n", [["a"]]), (b"", []), (b"\n", [[]]), (b"a\n\n", [["a"], []]),
        ("x y　z \n".encode(), [["x", "y", "z"]]),
    ):
        path.write_bytes(content)
        assert [r.terms for r in lines.read_corpus(spark, str(path)).orderBy("doc_id").collect()] == want
    only = spark.createDataFrame([(None,), (" a  b ",)], "t string").select(whitespace_tokens(F.col("t")).alias("x"))
    assert sorted(r.x for r in only.collect()) == [[], ["a", "b"]]


def test_a_folder_is_one_line_corpus(spark, tmp_path):
    for name, content in (("b", "3\n4"), ("a", "0\n1\n2\n"), ("c", ""), ("d", "5\n")):
        (tmp_path / f"{name}.txt").write_text(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3")
    try:
        rows = lines.read_corpus(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.doc_id, *r.terms) for r in rows) == [(n, str(n)) for n in range(6)]


def test_no_task_writes_the_whole_line_corpus(spark, tmp_path):
    big = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat(cast(id as string), 30)").alias("text"))
    big.write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = catalog._line_corpus(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(Folder(spark, path).names()) > 2
    assert lines.read_lines(spark, path).where(F.expr("line <> repeat(cast(pos as string), 30)")).count() == 0
    assert lines.read_lines(spark, path).count() == 4000


def test_no_task_gets_all_postings_of_a_searched_term(spark, tmp_path):
    """The command line's index of a corpus of lines, with one term in all of them."""
    (tmp_path / "lines.txt").write_text("".join(f"the {n}\n" for n in range(4000)))
    root = f"file://{tmp_path}/saved"
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        cli.run(cli.parser().parse_args(["index", "-i", f"file://{tmp_path}/lines.txt", "-o", root]), spark)
        index = snapshot.load(spark, root).restricted(["the"])
        queries = as_queries(spark, ["the"])
        tasks = _matched(index, queries, _weighted(index, queries)).groupBy(F.spark_partition_id()).count().collect()
        best = retrieve(snapshot.load(spark, root), ["the"], 3, spark=spark).collect()
    finally:
        for k in held:
            spark.conf.unset(k)
    assert sum(t["count"] for t in tasks) == 4000 and max(t["count"] for t in tasks) < 4000
    assert [(h.rank, h.doc_id) for h in best] == [(1, 0), (2, 1), (3, 2)]


def test_snapshot_round_trip(spark, tmp_path):
    index = LexicalIndex.build(spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, ["b"])], DOCS))
    root = f"file://{tmp_path}/saved"
    snapshot.save(index, spark, root, durable=True)
    snapshot.save(index, spark, root)
    assert len([n for n in os.listdir(tmp_path / "saved") if n.startswith("v-")]) == 1
    back = snapshot.load(spark, root)
    assert sorted(map(tuple, back.postings().collect())) == sorted(map(tuple, index.postings().collect()))
    assert back.scalars() == index.scalars()
    assert retrieve(back, ["a", "b"], spark=spark).collect() == retrieve(index, ["a", "b"], spark=spark).collect()
    with pytest.raises(FileNotFoundError):
        snapshot.load(spark, f"file://{tmp_path}/nowhere")


def test_a_single_op_after_a_large_batch_is_not_one_task(spark, tmp_path):
    log = OpLog(spark, f"file://{tmp_path}")
    batch = spark.range(1, 12_001).select(F.col("id").alias("seq"), F.lit("add").alias("op"), F.col("id").alias("doc_id"), F.array(F.col("id").cast("string")).alias("terms"))
    log.append(oplog.prefix(batch, 10))
    log.log_only(oplog.suffix(batch, 10))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        log.add(7, "x")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = {n: len([f for f in os.listdir(tmp_path / n / "doc_stats") if f.endswith(".parquet")]) for n in os.listdir(tmp_path) if n.startswith(("d-", "v-"))}
    assert max(files.values()) > 1
    assert log.checkpoint_index().scalars().n_docs == 12_000
    assert log.checkpoint_index().postings_list("x").collect() == [(7, 1)]


def test_log_lost_meta_is_found_and_repaired(spark, tmp_path):
    log = OpLog(spark, f"file://{tmp_path}")
    assert log.status().first().asDict() == {"checkpoint": False, "meta": False, "log": False, "records": 0, "applied": 0, "pending": 0}
    log.add(1, "hello world")
    log.add(2, "hello rust", durable=True)
    os.remove(tmp_path / "index.bin.meta")
    with pytest.raises(LogStateError, match="meta missing"):
        log.status()
    with pytest.raises(LogStateError, match="meta missing"):
        log.doctor()
    assert log.doctor(fix=True) == 2
    assert log.validate() and log.status().first().pending == 0
    (tmp_path / "index.bin.meta").write_text(json.dumps({"applied_records": 7}))
    with pytest.raises(LogStateError, match="invalid meta"):
        log.state()


def test_log_survives_prune_reset_and_deletion(spark, tmp_path):
    log = OpLog(spark, f"file://{tmp_path}")
    for i, text in ((1, "a b"), (2, "b c"), (3, "c d"), (2, "b b")):
        log.add(i, text)
    log.delete(3)
    log.delete(8)
    want = [(1, ["a", "b"]), (2, ["b", "b"])]
    assert log.validate() and state(log.state()) == want
    assert log.prune() == 2 and log.validate() and state(log.state()) == want and log.scan() == 2
    log.checkpoint(reset_log=True)
    assert log.scan() == 0 and state(log.state()) == want and log.validate()
    log.add(5, "e")
    assert log.validate()
    assert log.compact() == 3 and state(log.state()) == [*want, (5, ["e"])] and log.validate()
    for i in (1, 2, 5):
        log.delete(i)
    assert log.compact() == 0 and log.scan() == 0 and state(log.state()) == []


def test_torn_and_corrupt_logs(spark, tmp_path):
    log = OpLog(spark, f"file://{tmp_path}")
    for i, text in ((1, "a b"), (2, "b c"), (3, "c d")):
        log.add(i, text)
    parts = sorted((tmp_path / "ops.log").glob("*.json"))
    assert len(parts) == 3
    whole = [p.read_bytes() for p in parts]
    parts[2].write_bytes(whole[2][:-3])
    assert log.scan() == 2
    with pytest.raises(LogStateError, match="UnexpectedEof"):
        log.scan(strict=True)
    parts[2].write_bytes(whole[2])
    parts[1].write_text("{oops\n")
    assert log.scan() == 1  # what stands before the bad record, nothing behind it


def test_prefix_sums_and_numbers_by_stretch(spark):
    rng = random.Random(2)
    keys = rng.sample(range(-(10**15), 10**15), 500)
    rows = spark.createDataFrame([(k, "x") for k in keys], "k long, number string").repartition(7)
    for width in (3, 40, 1000):
        got = {r.k: r.place for r in numbered(rows, "k", 500, "place", width).collect()}
        assert got == {k: n + 1 for n, k in enumerate(sorted(keys))}
    values = [(i, rng.randrange(100), rng.randrange(2**60)) for i in range(300)]
    for width in (2, 7, 500):
        got = {r.i: (r.s, r.x) for r in running(spark.createDataFrame(values, "i long, s long, x long").repartition(5), "i", 300, ["s"], ["x"], width=width).collect()}
        s = x = 0
        for i, a, b in values:
            s, x = s + a, x ^ b
            assert got[i] == (s, x)


def test_lines_are_numbered_across_splits(spark, tmp_path):
    rng = random.Random(4)
    want = ["é" * rng.randrange(60) + rng.choice(["", "\r", "\rx"]) for _ in range(5_000)]
    (tmp_path / "big.txt").write_bytes(("\n".join(want) + "\n").encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = lines.read_lines(spark, str(tmp_path / "big.txt"))
        assert rows.rdd.getNumPartitions() > 4
        got = {r.pos: r.line for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {n: x.removesuffix("\r") for n, x in enumerate(want)}


def test_log_grows_by_one_file_and_numbers_are_unique(spark, tmp_path):
    folder = Folder(spark, f"file://{tmp_path}")
    parts = LogParts(spark, folder, "log")
    ops = spark.range(100_000).select((F.col("id") + 1).alias("seq"), F.lit("add").alias("op"), "id", F.array(F.lit("t")).alias("terms")).withColumnRenamed("id", "doc_id")
    assert parts.append_all(ops) == 1 and parts.append_all(ops.limit(0)) == 0
    size, files = folder.size("log")
    assert parts.append("delete", 7, None) == 2
    grown, more = folder.size("log")
    assert more == files + 1 and grown - size < 100
    # writers at the same time: each record has a number of its own, none is lost
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda i: parts.append("add", i, ["a", "é"]), range(40)))
    assert sorted(numbers) == list(range(3, 43)) and parts.last() == 42 and parts.last(17) == 42
    told = {r.pos: json.loads(r.line) for r in parts.lines().where("pos >= 99990").collect()}
    assert [told[99_990 + i]["doc_id"] for i in range(10)] == list(range(99_990, 100_000)) and told[100_000] == {"op": "delete", "doc_id": 7, "terms": None}
    assert {n: told[99_998 + n]["doc_id"] for n in numbers} == dict(zip(numbers, range(40)))
    assert {r.pos for r in parts.lines(after=40, before=100_039).collect()} == {100_039, 100_040}
    assert parts.seal() == 42 and parts.seal() == 42 and parts.lines(after=42).count() == 0
    with pytest.raises(LogStateError, match="sealed"):
        parts.append("add", 1, [])
    assert not [n for n in os.listdir(tmp_path / "log") if n.startswith(".0") and not n.endswith(".crc")]


class Crash(Exception):
    pass


def test_compaction_that_is_cut_off_anywhere_leaves_a_whole_state(spark, tmp_path, monkeypatch):
    log = OpLog(spark, f"file://{tmp_path}")
    log.append(ops_of(spark, ROWS))
    log.add(4, "x y")
    want = [(1, ["c"]), (3, []), (4, ["x", "y"])]
    before, checks, inside = log._current()["number"], [], False

    def whole():
        reader = OpLog(spark, f"file://{tmp_path}")
        assert state(reader.state()) == want and reader.validate()
        checks.append(reader._current()["number"])

    def looked_at(step):
        def call(self, *a, **b):
            nonlocal inside
            if not inside:  # what a crash at this point would leave
                inside = True
                whole()
                inside = False
            return step(self, *a, **b)

        return call

    with monkeypatch.context() as m:
        for name in ("write", "write_new", "publish", "delete"):
            m.setattr(Folder, name, looked_at(getattr(Folder, name)))
        assert log.compact() == 3
    whole()
    assert len(checks) > 6 and set(checks) == {before, before + 1} and log.scan() == 3
    # cut off after the seal: the log reads as before, and the next compaction goes on
    with monkeypatch.context() as m:
        m.setattr(snapshot, "write_version", lambda *a: (_ for _ in ()).throw(Crash))
        with pytest.raises(Crash):
            log.compact()
    whole()
    with pytest.raises(LogStateError, match="sealed"):
        log.add(5, "z")
    assert log.compact() == 3
    log.add(5, "z")
    assert state(log.state()) == [*want, (5, ["z"])] and log.validate()


def test_concurrent_writers_lose_no_record(spark, tmp_path):
    log = OpLog(spark, f"file://{tmp_path}")
    log.add(0, "start")
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: OpLog(spark, f"file://{tmp_path}").add(i, f"t{i}"), range(1, 4)))
    assert state(log.state()) == [(0, ["start"]), *((i, [f"t{i}"]) for i in range(1, 4))] and log.scan() == 4 and log.validate()


def test_changes_write_what_they_change(spark, tmp_path):
    root = f"file://{tmp_path}/saved"
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    docs = {i: rng.choices(words, k=60) for i in range(4000)}
    frame = lambda d: spark.createDataFrame(sorted(d.items()), DOCS)
    snapshot.save(LexicalIndex.build(frame(docs)), spark, root)
    folder = Folder(spark, root)
    whole = folder.size()[0]
    new = {i: rng.choices(words, k=60) for i in [*range(0, 3900, 100), 9000]}  # 1 %
    snapshot.change(spark, root, frame(new), spark.createDataFrame([(5,), (77777,)], "doc_id long"))
    assert folder.size()[0] - whole < whole * 0.05
    docs |= new
    docs.pop(5)
    for step in range(7):  # deltas are merged on the way
        one = {step: ["only", "these"]}
        snapshot.change(spark, root, frame(one))
        docs |= one
    pointer = json.loads(folder.read(snapshot.POINTER))
    assert len(pointer["deltas"]) < snapshot.MOST_DELTAS and set(folder.names()) - {snapshot.POINTER} == snapshot.versions(pointer)
    got, want = snapshot.load(spark, root), LexicalIndex.build(frame(docs))
    assert sorted(map(tuple, got.postings().collect())) == sorted(map(tuple, want.postings().collect()))
    assert got.scalars() == want.scalars() and sorted(map(tuple, got.term_stats().collect())) == sorted(map(tuple, want.term_stats().collect()))
    assert retrieve(got, ["w1", "only"], spark=spark).collect() == retrieve(want, ["w1", "only"], spark=spark).collect()
    snapshot.change(spark, root, gone=frame(docs).where("doc_id >= 2000"))  # much: a new base
    assert not json.loads(folder.read(snapshot.POINTER))["deltas"] and snapshot.load(spark, root).scalars().n_docs == sum(i < 2000 for i in docs)


def test_stream_equals_replay(spark, tmp_path):
    ops = ops_of(spark, ROWS * 5)
    source = f"file://{tmp_path}/in"
    ops.orderBy("seq").coalesce(1).repartition(4).write.json(source)
    stream = OpStream(spark, source, f"file://{tmp_path}/out")
    stream.start(max_files=1).awaitTermination()
    assert state(stream.state()) == state(oplog.replay(ops))
    before = stream._current()
    assert len(before["parts"]) < 8
    stream._apply(ops, before["batch"])  # a batch that was committed already
    assert stream._current() == before
    late = spark.createDataFrame([(2, "add", 3, ["old"]), (99, "add", 3, ["new"])], oplog.OPS)
    late.coalesce(1).write.mode("append").json(source)
    stream.start().awaitTermination()
    assert dict(state(stream.state()))[3] == ["new"]


def test_stream_batches_write_what_they_bring(spark, tmp_path):
    stream = OpStream(spark, "unused", f"file://{tmp_path}/s", retain=50)
    plain, seq, sizes = {}, 0, []

    def batch(ids, op="add", start=None):
        nonlocal seq
        first = seq + 1 if start is None else start
        rows = [(first + n, op, i, [f"t{first + n}"] if op == "add" else None) for n, i in enumerate(ids)]
        if start is None:
            seq += len(ids)
        return spark.createDataFrame(rows, oplog.OPS), rows

    def apply(number, made):
        df, rows = made
        before = {n: stream.folder.size(n)[0] for n in stream.folder.names() if n.startswith("state-")}
        stream._apply(df, number)
        stream._apply(df, number)  # once more, as after a failure
        sizes.append(sum(stream.folder.size(n)[0] for n in stream.folder.names() if n.startswith("state-") and n not in before))
        for s, op, i, terms in rows:
            if s > plain.get(i, (0,))[0]:
                plain[i] = (s, op, terms)

    apply(0, batch(range(20_000)))
    for n in range(1, 13):
        apply(n, batch(range(n * 10, n * 10 + 30), "delete" if n % 4 == 0 else "add"))
    assert max(sizes[1:]) < sizes[0] / 20 and len(stream._current()["parts"]) < 8
    live = lambda: sorted((i, t) for i, (_, op, t) in plain.items() if op == "add")
    assert state(stream.state()) == live()
    apply(13, batch([45], start=seq - 300))  # late: document 45 has newer ops
    assert state(stream.state()) == live()
    apply(14, batch(range(30_000, 50_100)))  # outgrows the rest: all parts become one, deletions expire
    now = stream._current()
    assert len(now["parts"]) == 1 and now["floor"] == seq - 50 and stream._read(now["parts"]).where("op = 'delete'").count() == 0
    stream._apply(spark.createDataFrame([(now["floor"], "add", 47, ["late"])], oplog.OPS), 15)
    assert state(stream.state()) == live()


def test_command_line(spark, tmp_path, capsys):
    text = tmp_path / "docs.txt"
    text.write_text("hello world\nhello spark\n\n")
    saved, root = f"file://{tmp_path}/saved", f"file://{tmp_path}/log"
    run = lambda *a: cli.main(list(a), spark)
    assert run("index", "-i", str(text), "-o", saved) == 0
    assert run("search-index", "-i", saved, "-k", "1", "spark") == 0
    assert run("search", "-i", str(text), "spark") == 0
    out = capsys.readouterr().out
    assert "Indexed 3 documents" in out and out.count("  Doc 1: score ") == 2
    assert run("log-add", "--root", root, "--doc-id", "4", "--text", "hello world") == 0
    assert run("log-delete", "--root", root, "--doc-id", "5") == 0
    for c in ("log-status", "log-scan", "log-validate", "log-checkpoint", "log-doctor", "log-compact", "log-prune"):
        assert run(c, "--root", root) == 0
    assert run("log-search", "--root", root, "hello") == 0
    assert "  Doc 4: score " in capsys.readouterr().out
    assert run("search-index", "-i", f"file://{tmp_path}/none", "x") == 1
    assert "error" in capsys.readouterr().err
