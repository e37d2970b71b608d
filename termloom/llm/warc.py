"""WARC archives: writing page captures, reading records back, assembling transactions.

Writing: each page becomes three records: a request, a response or revisit, and a metadata record, the
outer two with WARC-Concurrent-To the middle one. Of pages with equal payloads of at least
MIN_REVISIT bytes the one with the smallest id is the response and the others are revisits, which carry
the payload's digest and length but not the payload. Spark's text writer writes the archives (gzip), so
they go wherever Spark can write. Only digests shuffle; a bounded filter of the repeated ones lets all
other pages go straight from the scan to the archive.

Reading (WARC/1.0 and 1.1): Spark's text reader splits an archive at what stands between records, one
record after the other and never a whole file in memory; a payload that holds this separator itself is put
together again by the record's Content-Length. Digests are computed from the payloads read. Archives that are
not compressed may be split among tasks; there a payload that holds a separator must not cross a split, so
compress archives (as usual) whose payloads are WARC records.

Assembly: request and metadata records find their response or revisit by the concurrent-to
identifiers, of which a record may have several and which either side may hold, directly or through one
more record. Every capture becomes one nested row.

Defined cases: a null payload is empty; pages without an id are captures too and come last when the
smallest id is sought; rows that repeat the response's id and payload are that response again; other
rows that repeat an id are captures of their own. Of several requests (or
metadata records) of a capture the one with the smallest record id is kept and all are counted; records
that name no capture that is there belong to none. Control characters and spaces in URLs are
escaped in headers. Columns besides page_id, url and html are ignored. An empty table gives no records
and an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, bit_filter, lookup, maybe_in, power_of_two, small_batches

MIN_REVISIT = 100
#: Written as the date of every record, so that archives can be made again bit by bit.
DATE = "2024-01-01T00:00:00Z"
VERSION = "WARC/1.1"
#: Fixed value of the WARC standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: What every version line of the standard begins with. Records are split at the line end before it: a longer
#: separator, which repeats its own beginning, is missed where the reader's buffer ends within it.
_START = "WARC/1."
_BETWEEN = f"\n{_START}"
_CAPTURES = ("response", "revisit")


def _firsts(pages: DataFrame, store: Store) -> tuple[DataFrame, int]:
    """hash, first, n: the smallest id of each payload that several pages have; and the number of pages."""
    signed = store.put(pages.select("page_id", F.octet_length("html").alias("size"), "hash"), "digests")
    groups = signed.where(F.col("size") >= MIN_REVISIT).groupBy("hash").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return store.put(groups, "firsts"), signed.count()


def _name(page: str, part: str) -> str:
    """SQL for a record's identifier; a page's id and its payload's digest name a capture."""
    return f"concat('<urn:page:', coalesce(cast({page} as string), ''), ':', digest, ':{part}>')"


def _record(kind: str, name: str, headers: list[str], block: str) -> str:
    """SQL for a record up to the first of the two line ends that close it."""
    lines = [f"'WARC-Type: {kind}'", f"concat('WARC-Record-ID: ', {name})", f"'WARC-Date: {DATE}'", "concat('WARC-Target-URI: ', uri)", *headers]
    head = ", ".join(f"{x}, '\\r\\n'" for x in lines)
    return f"concat('{VERSION}\\r\\n', {head}, 'Content-Length: ', octet_length({block}), '\\r\\n\\r\\n', {block}, '\\r\\n')"


def _transactions(rows: DataFrame) -> DataFrame:
    """One text per page: its three records. Pages with a ``first`` other than their own id are revisits."""
    uri = F.coalesce("url", F.lit(""))
    for plain, escaped in ((" ", "%20"), ("\r", "%0D"), ("\n", "%0A"), ("\t", "%09")):
        uri = F.replace(uri, F.lit(plain), F.lit(escaped))
    host = F.regexp_extract(uri, "://([^/?#]*)", 1)
    payload = "coalesce(html, '')"
    http = "concat('HTTP/1.1 200 OK\\r\\nContent-Type: text/html; charset=utf-8\\r\\nContent-Length: ', bytes, '\\r\\n\\r\\n')"
    main = _name("page_id", "capture")
    digest = "concat('WARC-Payload-Digest: sha256:', digest)"
    to_main = f"concat('WARC-Concurrent-To: ', {main})"
    request = _record("request", _name("page_id", "request"), [to_main, "'Content-Type: application/http; msgtype=request'"], "concat('GET ', uri, ' HTTP/1.1\\r\\nHost: ', host, '\\r\\n\\r\\n')")
    response = _record("response", main, [digest, "'Content-Type: application/http; msgtype=response'"], f"concat({http}, {payload})")
    revisit = _record(
        "revisit", main,
        [digest, f"'WARC-Profile: {REVISIT_PROFILE}'", f"concat('WARC-Refers-To: ', {_name('first', 'capture')})", "'Content-Type: application/http; msgtype=response'"],
        http,
    )
    metadata = _record("metadata", _name("page_id", "metadata"), [to_main, "'Content-Type: application/warc-fields'"], "concat('page_id: ', coalesce(cast(page_id as string), ''), '\\r\\n')")
    ready = rows.withColumn("uri", F.regexp_replace(uri, r"[\x00-\x1F\x7F]", "")).withColumn("host", host).withColumn("bytes", F.coalesce(F.octet_length("html"), F.lit(0))).withColumn("digest", F.lower(F.hex("hash")))
    # the writer's line end is the second of the two that close the last record
    return ready.select(F.expr(f"concat({request}, '\\r\\n', CASE WHEN first IS NULL OR first <=> page_id THEN {response} ELSE {revisit} END, '\\r\\n', {metadata})").alias("value"))


def write(pages: DataFrame, path: str, store: Store) -> None:
    """Writes the captures of ``pages`` (page_id, url, html) as WARC archives below ``path``."""
    rows = pages.select("page_id", "url", "html", F.unhex(F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)).alias("hash"))
    firsts, n = _firsts(rows, store)
    slot = F.expr(f"pmod(xxhash64(hash), {power_of_two(max(n, 1) * 64)}L)")
    words = store.put(bit_filter(firsts.select(slot.alias("slot"))), "filter")
    marked = maybe_in(rows, words, slot, "maybe")
    plain = marked.where("not maybe").select(*rows.columns, F.lit(None).cast(rows.schema["page_id"].dataType).alias("first"))
    others = lookup(marked.where("maybe").select(*rows.columns), firsts, ["hash"], "n", n, "left").select(*plain.columns)
    _transactions(plain.unionByName(others)).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


RECORD = (
    "record_id string, type string, uri string, date string, concurrent_to array<string>, refers_to string, content_type string, "
    "payload_bytes long, payload_digest string, digest_matches boolean, block binary"
)


def _parsed(piece: bytes, with_block: bool) -> tuple:
    """A RECORD of a record's bytes, from the end of its version line on."""
    head, _, block = piece.partition(b"\r\n\r\n")
    fields, concurrent = {}, []
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, _, value = line.partition(":")
        name = name.strip().lower()
        fields[name] = value.strip()
        if name == "warc-concurrent-to":
            concurrent.append(value.strip())
    block = block[: int(fields.get("content-length") or 0)]
    kind, size, digest, matches = fields.get("warc-type", ""), len(block), None, None
    named = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    if kind in _CAPTURES:
        http, _, payload = block.partition(b"\r\n\r\n")
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if kind == "revisit":  # the payload is elsewhere; its length is in the response's own header
            digest = named
            for line in http.decode("latin-1").split("\r\n"):
                name, _, value = line.partition(":")
                if name.strip().lower() == "content-length" and value.strip().isdigit():
                    size = int(value)
        elif named is not None:
            matches = named == digest
    get = fields.get
    return get("warc-record-id"), kind, get("warc-target-uri"), get("warc-date"), concurrent, get("warc-refers-to"), get("content-type"), size, digest, matches, block if with_block or kind == "metadata" else None


def _missing(piece: bytes) -> int:
    """How many bytes of the record are behind what looked like its end."""
    head, gap, block = piece.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n"):
        if line[:15].lower() == b"content-length:":
            # where the block itself begins like a record, the headers' last line end went with the separator
            return int(line[15:]) - len(block) if gap else int(line[15:]) and int(line[15:]) + 1
    return 0


def read(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """The records of all archives below ``path``; without blocks, only metadata records have theirs."""
    small_batches(spark)
    between, first = _BETWEEN.encode(), _START.encode()
    lines = spark.read.option("lineSep", _BETWEEN).text(path).select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"))
    names = [f.split(" ")[0] for f in RECORD.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}[f.split(" ")[1]] for f in RECORD.split(", ")]

    def made(records: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*records), kinds)], names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, left = None, [], 0
        for b in batches:
            out = []
            for piece, file in zip(b.column(0), b.column(1)):
                piece, file = piece.as_py(), file.as_py()
                if file != at:
                    if parts:  # cut off at its file's end
                        out.append(_parsed(b"".join(parts), with_block))
                    at, parts = file, []
                    piece = piece.removeprefix(first)
                if parts:
                    parts += (between, piece)
                    left -= len(between) + len(piece)
                else:
                    parts, left = [piece], _missing(piece)
                if left <= 0:
                    out.append(_parsed(b"".join(parts), with_block))
                    parts = []
                if len(out) >= 512:
                    yield made(out)
                    out = []
            if out:
                yield made(out)
        if parts:
            yield made([_parsed(b"".join(parts), with_block)])

    return lines.mapInArrow(parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture, request, requests, metadata, metadata_records."""
    fields = ["record_id", "type", "uri", "date", "refers_to", "content_type", "payload_bytes", "payload_digest", "digest_matches"]
    captures = records.where(F.col("type").isin(*_CAPTURES)).select(F.col("record_id").alias("root"), F.struct(*fields).alias("capture"))
    others = records.where(F.col("type").isin("request", "metadata"))
    named = records.select(F.col("record_id").alias("one"), F.explode("concurrent_to").alias("other")).where("one IS NOT NULL")
    links = named.unionByName(named.select(F.col("other").alias("one"), F.col("one").alias("other")))
    near = links.join(captures.select("root"), F.col("one") == F.col("root")).select("root", F.col("other").alias("id"), F.lit(1).alias("hops"))
    # records that are linked with one of those belong to its capture, unless they have one themselves
    far = links.join(near.select("root", F.col("id").alias("via")), F.col("one") == F.col("via")).select("root", F.col("other").alias("id"), F.lit(2).alias("hops"))
    placed = near.unionByName(far).groupBy("id").agg(F.min(F.struct("hops", "root")).alias("of")).select("id", F.col("of.root").alias("root"))
    rooted = others.join(placed, F.col("record_id") == F.col("id"))
    small = F.struct("record_id", "uri", "date", "content_type", F.decode("block", "UTF-8").alias("fields"))
    of = lambda kind, one, many: rooted.where(F.col("type") == kind).groupBy("root").agg(F.min(small).alias(one), F.count("*").alias(many))
    joined = captures.join(of("request", "request", "requests"), "root", "left").join(of("metadata", "metadata", "metadata_records"), "root", "left")
    return joined.select("capture", "request", F.coalesce("requests", F.lit(0)).alias("requests"), "metadata", F.coalesce("metadata_records", F.lit(0)).alias("metadata_records"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives, reads them back and assembles: one row per page.

    page_id, payload_bytes, payload_digest, record_type, refers_to, capture_id, request_id, metadata_id.
    """
    store = Store(pages.sparkSession, "warc")
    path = store.path("archive")
    write(pages, path, store)
    records = store.put(read(pages.sparkSession, path, with_block=False), "records")
    kind = pages.schema["page_id"].dataType
    page = F.expr("nullif(regexp_extract(metadata.fields, 'page_id: ([^\\\\r]*)', 1), '')").cast(kind)
    refers = F.expr("nullif(regexp_extract(capture.refers_to, '^<urn:page:(.*):[0-9a-f]+:capture>$', 1), '')").cast(kind)
    return assemble(records).select(
        page.alias("page_id"), F.col("capture.payload_bytes").alias("payload_bytes"), F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.type").alias("record_type"), refers.alias("refers_to"),
        F.col("capture.record_id").alias("capture_id"), F.col("request.record_id").alias("request_id"), F.col("metadata.record_id").alias("metadata_id"),
    )
