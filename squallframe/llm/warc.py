"""Legacy ARC archives turned into WARC archives, and the way there and back from a table of pages.

Archives are written by Spark's text writer, which passes bytes on as they are (one file per task), and read
whole by its binary reader, so they can lie in any store that Spark knows. An archive is as large as a task's input. Each WARC record is
a gzip member of its own, so that readers can seek it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squallframe.llm.common import materialize, shared_path, table

#: Field names of the URL record of each ARC version (fixed values of the format).
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: The profile of revisits by payload (fixed value of the WARC format).
SAME_PAYLOAD = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: When the legacy captures began, where the table doesn't tell: a page's is as many seconds later as its id says, within a year.
CAPTURED, YEAR = datetime(2004, 2, 29, 12, tzinfo=UTC), 365 * 86400
#: Parts into which pages whose payloads occur more than once are dealt, each with the first page of the payload.
SALTS = 16

PARSED = "kind string, page_id long, uri string, ip string, mime string, date string, head binary, payload binary, digest string, origin string"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to_id string, record_id string, uri string, ip string, date string"
SMALL_BATCH = 16 << 20
#: Bytes that are inflated at a time.
INFLATED = 16 << 10


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each gzip member of a file, which is one member where it isn't compressed."""
    view, at = memoryview(data), 0
    while at < len(data):
        if data[at : at + 2] != b"\x1f\x8b":
            yield at, bytes(view[at:])
            return
        start, one, parts = at, zlib.decompressobj(31), []
        while not one.eof and at < len(data):
            piece = view[at : at + INFLATED]
            parts.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield start, b"".join(parts)


def inflate(data: bytes) -> bytes:
    return b"".join(part for _, part in members(data))


def member(record: bytes) -> bytes:
    """A record as a gzip member but for its last byte, which is the writer's line separator, a zero.

    It is the highest byte of the record's length, zero up to 16 MiB; behind longer records an empty member stands.
    """
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    data = packer.compress(record) + packer.flush()
    return (data if data[-1] == 0 else data + zlib.compressobj(1, zlib.DEFLATED, 31).flush())[:-1]


def one_word(text: str | None) -> str:
    """A field of an ARC header line: no white space, never empty."""
    return "%20".join((text or "").split()) or "-"


def arc_values(batches: Iterator[pa.RecordBatch], version: int, name: str) -> Iterator[pa.RecordBatch]:
    """Lines of an ARC file: the file description, then a header line and document for each page."""
    fields = ARC_FIELDS[version]
    described = f"{version} 0 legacy\n{' '.join(fields)}\n"
    tail = ["200", "-", "-", "0", name] if version == 2 else []
    offset = 0

    def record(uri: str, mime: str, document: str, size: int, page: int = 0) -> str:
        tail[3:4] = [str(offset)] * bool(tail)
        date = CAPTURED + timedelta(seconds=page % YEAR)
        return f"{uri} 0.0.0.0 {date:%Y%m%d%H%M%S} {mime} {' '.join([*tail, str(size)])}\n{document}"

    first = record(f"filedesc://{name}", "text/plain", described, len(described))
    offset += len(first.encode()) + 1
    lines, held = [first], 0
    for batch in batches:
        for page, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            body = html or ""
            n = len(body.encode())
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\nX-Page-Id: {'' if page is None else page}\r\nX-Url-Given: {int(url is not None)}\r\n\r\n"
            line = record(one_word(url), "text/html", head + body, len(head) + n, page or 0)
            lines.append(line)
            offset += len(line) - len(body) + n + 1
            held += n
            if held > SMALL_BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
                lines, held = [], 0
    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])


def write_arc(pages: DataFrame, path: str, columns: list[str]) -> None:
    """Write pages as ARC files of version 1 (from even tasks) and 2 (from odd ones)."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        return arc_values(batches, 1 + task % 2, f"legacy-{task:05d}.arc")

    pages.select(*columns).mapInArrow(lines, "value string").write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path, lineSep="\n")


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and document of each record of an ARC file (its description too), by the declared lengths.

    The names of the fields are those that the file description declares, else those of the version whose number
    of fields the header line has. A header line may hold spaces in its URL only.
    """
    at, declared = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].decode("utf-8", "replace").strip()
        at = end + 1
        if not line:
            continue
        words = line.split(" ")
        names = declared or ARC_FIELDS[2 if len(words) >= len(ARC_FIELDS[2]) else 1]
        if line.startswith("filedesc://"):
            names = ARC_FIELDS[2 if len(words) == len(ARC_FIELDS[2]) else 1]
        extra = len(words) - len(names)
        if extra < 0:
            raise ValueError(f"ARC header line with {len(words)} of {len(names)} fields: {line[:200]!r}")
        values = [" ".join(words[: extra + 1]), *words[extra + 1 :]]
        header = dict(zip(names, values, strict=True))
        size = int(header["Archive-length"])
        document = data[at : at + size]
        if len(document) < size:
            raise ValueError(f"ARC record of {len(document)} of {size} bytes: {line[:200]!r}")
        at += size + 1
        if line.startswith("filedesc://"):
            described = document.decode("utf-8", "replace").splitlines()
            declared = described[1].split() if len(described) > 1 else None
        yield header, document


def http_parts(document: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its empty line) and payload; all is payload without an HTTP head."""
    if not document.startswith(b"HTTP/"):
        return b"", document
    cut = document.find(b"\r\n\r\n") + 4
    return (document[:cut], document[cut:]) if cut > 3 else (document, b"")


def http_field(head: bytes, name: str) -> str:
    start = head.lower().find(f"\r\n{name.lower()}:".encode())
    if start < 0:
        return ""
    start += len(name) + 3
    return head[start : head.find(b"\r\n", start)].decode("utf-8", "replace").strip()


def in_batches(rows: Iterator[tuple], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row) + 200
        if size > SMALL_BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    columns = list(zip(*held, strict=True)) or [[]] * len(schema)
    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def iso_date(date: str) -> str:
    """14 digits as WARC writes them; missing ones are those of the earliest moment."""
    d = date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def as_warc(header: dict[str, str], document: bytes, origin: str = "") -> tuple:
    """WARC kind, page_id, uri, ip, mime, date, HTTP head, payload and its digest of an ARC record, and where it comes from.

    A file description becomes a warcinfo record, a document with an HTTP head a response, any other one a resource.
    """
    uri, mime = header["URL"], header["Content-type"]
    if uri.startswith("filedesc://"):
        version, _, origin = (document.decode("utf-8", "replace").split("\n")[0].split(" ") + ["", "", ""])[:3]
        info = f"software: squallframe legacy archive converter\r\nformat: WARC File Format 1.0\r\nsource: ARC {version} of {origin}\r\n".encode()
        return "warcinfo", None, uri, None, "application/warc-fields", iso_date(header["Archive-date"]), b"", info, digest32(info), origin
    head, payload = http_parts(document)
    page = http_field(head, "X-Page-Id")
    return "response" if head else "resource", int(page) if page else None, uri, header["IP-address"], mime, iso_date(header["Archive-date"]), head, payload, digest32(payload), origin


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all ARC files under a path, as ``as_warc`` has them; a record comes from the archive of its file description, by its number there."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in PARSED.split(", "))])

    def rows(batches):
        for batch in batches:
            for content in batch.column(0):
                archive = ""
                for k, (header, document) in enumerate(parse_arc(inflate(content.as_py()))):
                    archive = header["URL"] if header["URL"].startswith("filedesc://") else archive
                    yield as_warc(header, document, f"{archive}:{k}")

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(lambda b: in_batches(rows(b), schema, lambda r: len(r[7])), PARSED)


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(map(str, parts)))}>"


def warc_value(kind, page, uri, ip, mime, date, head: bytes, payload: bytes, digest: str, origin: str, first) -> bytes:
    """A WARC record; ``first`` is (page_id, uri, date, origin) of the response that a revisit refers to, else null."""
    kind = "revisit" if first is not None else kind
    block = head if kind == "revisit" else head + payload
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(kind, page, uri, date, origin)}", f"WARC-Date: {date}"]
    if kind == "warcinfo":
        lines.append(f"WARC-Filename: {uri.removeprefix('filedesc://')}")
    else:
        lines += [f"WARC-Target-URI: {uri}", f"WARC-IP-Address: {ip}", f"WARC-Payload-Digest: sha1:{digest}"]
    if first is not None:
        lines += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {record_id('response', first['page_id'], first['uri'], first['date'], first['origin'])}", f"WARC-Refers-To-Target-URI: {first['uri']}", f"WARC-Refers-To-Date: {first['date']}"]
    lines += [f"Content-Type: {'application/http; msgtype=response' if head else mime}", f"WARC-Block-Digest: sha1:{digest32(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(records: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write records as WARC files; equal payloads of at least ``min_bytes`` revisit that of the smallest page_id.

    Payloads that several pages share are found by digest and length. Their first pages are there once for each salt, so
    that the pages of a payload that very many share are dealt to several tasks.
    """
    can = (F.col("kind") == "response") & (F.octet_length("payload") >= min_bytes) & F.col("page_id").isNotNull()
    shared = records.where(can).groupBy(F.col("digest").alias("__digest"), F.octet_length("payload").alias("__size"))
    firsts = shared.agg(F.min(F.struct("page_id", "uri", "date", "origin")).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    firsts = firsts.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = (F.col("digest") == F.col("__digest")) & (F.octet_length("payload") == F.col("__size")) & (F.pmod(F.xxhash64("page_id", "uri"), F.lit(SALTS)) == F.col("__part")) & can
    joined = records.join(firsts, same, "left").withColumn("__first", F.when(F.col("page_id") > F.col("__first.page_id"), F.col("__first")))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(11)), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([member(warc_value(*r)) for r in rows], pa.binary())], ["value"])

    written = joined.drop("__digest", "__size", "__part").mapInArrow(lines, "value binary")
    written.select(F.col("value").cast("string")).write.text(path, lineSep="\x00")


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record, by Content-Length."""
    at = 0
    while at < len(data):
        if data.startswith(b"\r\n", at):
            at += 2
            continue
        cut = data.index(b"\r\n\r\n", at)
        lines = data[at:cut].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        at = cut + 4 + int(fields["content-length"])
        yield fields, data[cut + 4 : at]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Responses, resources and revisits of all WARC files under a path, their digests checked against the blocks.

    refers_to_id is the record identifier that a revisit names; a revisit whose head doesn't declare its payload's length has none. A page without a url has no uri.
    """
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in READ.split(", "))])

    def rows(batches):
        for batch in batches:
            for content in batch.column(0):
                for fields, block in (r for _, part in members(content.as_py()) for r in parse_warc(part)):
                    kind = fields["warc-type"]
                    if kind not in ("response", "resource", "revisit"):
                        continue
                    head, payload = http_parts(block)
                    said = fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind != "revisit" and digest32(payload) != said or f"sha1:{digest32(block)}" != fields["warc-block-digest"]:
                        raise ValueError(f"digests of {fields['warc-record-id']} don't match")
                    page = http_field(head, "X-Page-Id")
                    declared = http_field(head, "Content-Length")
                    size = len(payload) if kind != "revisit" else int(declared) if declared.isascii() and declared.isdigit() else None
                    uri = None if http_field(head, "X-Url-Given") == "0" else fields["warc-target-uri"]
                    yield int(page) if page else None, size, said, kind, fields.get("warc-refers-to"), fields["warc-record-id"], uri, fields.get("warc-ip-address"), fields["warc-date"]

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(lambda b: in_batches(rows(b), schema, lambda r: 200), READ)


def resolved(records: DataFrame) -> DataFrame:
    """Add refers_to, the page of the response that a revisit names, found by its identifier, and that one's payload length where the
    revisit declares none; a response that isn't there, or has another payload, is an error."""
    responses = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("__id")).agg(F.min("page_id").alias("__page"), F.min("payload_digest").alias("__digest"), F.min("payload_bytes").alias("__bytes"))
    revisits = records.where("record_type = 'revisit'").join(responses, F.col("refers_to_id") == F.col("__id"), "left")
    right = F.col("__digest") == F.col("payload_digest")
    page = F.when(right, F.col("__page")).otherwise(F.raise_error(F.concat(F.lit("no response for "), "record_id")).cast("long"))
    return records.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits.withColumn("refers_to", page).withColumn("payload_bytes", F.coalesce("payload_bytes", "__bytes")).drop("__id", "__page", "__digest", "__bytes"))


def convert_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Pages through legacy ARC files of both versions into WARC files in the shared folder, and read back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to_id, record_id, uri, ip, date and refers_to.

    Edge cases: a null html is an empty payload; a null or blank url is written as "-", white space in one as
    %20; rows with a null id are always responses; repeated rows of a payload's smallest id are each a response,
    those of other ids each a revisit, and all have identifiers of their own; a very long html is held whole by one task at a time; an empty table gives archives without pages and no rows; other columns
    are ignored, whatever their names.
    """
    spark = pages.sparkSession
    arc, warc = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arc(pages, arc, [id_col, url_col, html_col])
    write_warc(read_arc(spark, arc), warc, min_bytes)
    return resolved(materialize(read_warc(spark, warc)))


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_id", "uri", "ip", "date")
