"""Web archives: legacy ARC files, their conversion to WARC, and both readers.

Every record is a gzip member of its own, as readers that seek expect. All files go through Spark's text writer
and its binaryFile reader, so any Hadoop file system serves: a row is a member's bytes, and what the writer puts
between two rows is a member without content. A file ends after so many records as FILE_BYTES hold on average; a
task holds one file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_broadcast, new_path, written

#: Fixed values of the two ARC versions: the fields of a record's header line.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Bytes of payload that an archive file holds, more or less.
FILE_BYTES = 64 << 20
#: Equal payloads under this many bytes are stored each time.
LEAST_BYTES = 1000


def member(data: bytes) -> bytes:
    """data as a gzip member; fast rather than small, as archives are written once and read once here."""
    one = zlib.compressobj(1, zlib.DEFLATED, 31)
    return one.compress(data) + one.flush()


def _with_heads(records, head: bytes, each: int):
    """Record batches of members, with head as the first of every `each` rows, which is where files begin."""
    n = 0
    yield pa.RecordBatch.from_pydict({"value": pa.array([head], pa.binary())})
    for some in records:
        out = []
        for r in some:
            n += 1
            if n % each == 0:
                out.append(head)
                n += 1
            out.append(r)
        yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})


def _write(members: DataFrame, path: str, each: int) -> None:
    """Rows of members as files of `each` rows. The writer separates rows by bytes, which Latin-1 gives unchanged."""
    between = {"lineSep": member(b"").decode("latin-1"), "encoding": "ISO-8859-1", "maxRecordsPerFile": each}
    members.select(F.col("value").cast("string")).write.options(**between).text(path)


def records_a_file(mean_bytes: float | None) -> int:
    return max(2, int(FILE_BYTES // max(1.0, mean_bytes or 1.0)))


def _arc_line(version: int, url: str, date: str, kind: str, length: int) -> str:
    mid = ["200", "-", "-", "0", "-"] if version == 2 else []
    return " ".join([url, "0.0.0.0", date, kind, *mid, str(length)])


def write_arc(pages: DataFrame, path: str, captured: str = "20240101000000") -> None:
    """Writes page_id, url, html rows as ARC files; tasks alternate between ARC versions 1 and 2.

    The page's id travels in the HTTP header of its block. Null html is an empty payload, a null url
    is "-"; white space in a url is percent-encoded, as the header line's fields are split by spaces.
    """

    each = records_a_file(pages.agg(F.avg(F.octet_length("html"))).head()[0])

    def run(batches):
        version = 1 + TaskContext.get().partitionId() % 2
        about = f"{version} 0 factloom\n{' '.join(ARC_FIELDS[version])}\n"

        def records():
            for b in batches:
                out = []
                for page, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    html = html or ""
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page is None else page}\r\n\r\n"
                    url = re.sub(r"\s", lambda m: "".join(f"%{x:02X}" for x in m[0].encode()), url or "-")
                    block = (head + html).encode()
                    out.append(member(_arc_line(version, url, captured, "text/html", len(block)).encode() + b"\n" + block + b"\n"))
                yield out

        yield from _with_heads(records(), member(f"{_arc_line(version, 'filedesc://part.arc', captured, 'text/plain', len(about))}\n{about}\n".encode()), each)

    _write(pages.select("page_id", "url", "html").mapInArrow(run, "value binary"), path, each)


def _unpacked(content: bytes) -> bytes:
    """All members of a gzip file; other content as it is."""
    out, at = [], 0
    while content[at : at + 2] == b"\x1f\x8b":
        one = zlib.decompressobj(31)
        while not one.eof and at < len(content):
            piece = content[at : at + 65536]
            out.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
    return b"".join([*out, content[at:]])


def arc_records(data: bytes):
    """(version, fields, block) of each record of an ARC file after the version block."""
    at, version, names = 0, None, None
    while at < len(data):
        end = data.index(b"\n", at)
        line = data[at:end].decode()
        at = end + 1
        if not line:
            continue
        parts = line.split(" ")
        length = int(parts[-1])
        block = data[at : at + length]
        if len(block) != length:
            raise ValueError(f"a record declares {length} bytes and has {len(block)}")
        at += length
        if version is None:
            if not line.startswith("filedesc://"):
                raise ValueError("an ARC file starts with its version block")
            version = int(block.split(b" ", 1)[0])
            names = ARC_FIELDS[version]
            continue
        if len(parts) != len(names):
            raise ValueError(f"ARC version {version} has {len(names)} fields: {line[:200]}")
        yield version, dict(zip(names, parts)), block


def _http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}, body


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """page_id, url, date, payload_bytes, payload_digest (hex SHA-1) and html of each record."""

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                rows = []
                for _, fields, block in arc_records(_unpacked(content.as_py())):
                    head, body = _http(block)
                    page = head.get("x-page-id", "")
                    rows.append((int(page) if page else None, fields["URL"], fields["Archive-date"], len(body), hashlib.sha1(body).hexdigest(), body if payloads else None))
                cols = list(zip(*rows)) or [()] * 6
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                names = ["page_id", "url", "date", "payload_bytes", "payload_digest", "payload"]
                whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
                for i in range(0, whole.num_rows, 1000):
                    yield whole.slice(i, 1000)

    return _files(spark, path).mapInArrow(run, "page_id long, url string, date string, payload_bytes long, payload_digest string, payload binary")


def record_id(page, url: str, date: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url} {date} {digest}')}>"


def _warc(fields: list[tuple[str, str]], block: bytes) -> bytes:
    named = [*fields, ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()), ("Content-Length", str(len(block)))]
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named) + "\r\n").encode() + block + b"\r\n\r\n"


def arc_to_warc(spark: SparkSession, arc: str, warc: str, least_bytes: int = LEAST_BYTES) -> None:
    """Converts ARC files to WARC files.

    Of records with equal payloads (SHA-1 and length) of at least least_bytes, that with the largest
    page_id is written as response, the others as revisit records without payload. Rows repeated
    under that page_id are responses, too. Ids, dates and digests derive from the ARC fields alone.
    """
    heads = written(read_arc(spark, arc, False).drop("payload"), "arc-heads")
    same = ["payload_digest", "payload_bytes"]
    top = heads.where(F.col("payload_bytes") >= least_bytes).groupBy(*same).agg(F.max_by(F.struct("page_id", "url", "date"), "page_id").alias("to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = heads.join(top, same).where("to.page_id IS NOT NULL AND NOT (page_id <=> to.page_id)").select("page_id", "payload_digest", "to").dropDuplicates(["page_id", "payload_digest"])
    revisits = maybe_broadcast(written(revisits, "revisits"))  # then no payload passes a shuffle
    each = records_a_file(heads.agg(F.avg("payload_bytes")).head()[0])

    def run(batches):
        task = TaskContext.get().partitionId()

        def records():
            for b in batches:
                out = []
                for r in b.to_pylist():
                    d, digest = r["date"], r["payload_digest"]
                    fields = [
                        ("WARC-Type", "response" if r["to"] is None else "revisit"), ("WARC-Record-ID", record_id(r["page_id"], r["url"], d, digest)), ("WARC-Target-URI", r["url"]),
                        ("WARC-Date", f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Content-Type", "application/http; msgtype=response"),
                    ]
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if r['page_id'] is None else r['page_id']}\r\nContent-Length: {r['payload_bytes']}\r\n\r\n"
                    if to := r["to"]:
                        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(to["page_id"], to["url"], to["date"], digest)), ("WARC-Refers-To-Target-URI", to["url"])]
                    out.append(member(_warc(fields, head.encode() if to else head.encode() + r["payload"])))
                yield out

        about = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(task))}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")]
        yield from _with_heads(records(), member(_warc(about, b"software: factloom\r\nformat: WARC File Format 1.0\r\n")), each)

    full = read_arc(spark, arc).alias("r").join(revisits.alias("v"), F.col("r.page_id").eqNullSafe(F.col("v.page_id")) & (F.col("r.payload_digest") == F.col("v.payload_digest")), "left")
    full = full.select("r.*", F.col("v.to").alias("to"))
    _write(full.mapInArrow(run, "value binary"), warc, each)


def warc_records(data: bytes):
    """(fields by lower-case name, block) of each record of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record starts with {first[:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + length]
        at = end + 4 + length + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest (hex), record_type, record_id, refers_to_id of each page's record.

    A response's digest is computed from its payload and must equal the one declared.
    """

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                rows = []
                for fields, block in warc_records(_unpacked(content.as_py())):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    head, body = _http(block)
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if fields["warc-type"] == "response" and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"{fields['warc-record-id']}: the payload is not as declared")
                    size = len(body) if fields["warc-type"] == "response" else int(head["content-length"])
                    page = head.get("x-page-id", "")
                    rows.append((int(page) if page else None, size, digest, fields["warc-type"], fields["warc-record-id"], fields.get("warc-refers-to")))
                cols = list(zip(*rows)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_to_id"])

    return _files(spark, path).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to_id string")


def archive(pages: DataFrame) -> DataFrame:
    """Pages as ARC, converted to WARC, read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    pages: page_id, url, html and other columns, which are ignored whatever their names. Null html is an empty payload, a
    null url "-". Of equal payloads of LEAST_BYTES or more that with the largest page_id is the response; rows repeated
    under that page_id are responses, too, and rows without page_id only revisit (where no equal payload has a page_id, all are
    responses). A payload, however long, is one record
    in one task. An empty table gives archives without records and an empty result.
    """
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc)
    arc_to_warc(spark, arc, warc)
    rows = written(read_warc(spark, warc), "warc-rows")
    target = rows.where("record_type = 'response'").join(rows.where("refers_to_id IS NOT NULL").select(F.col("refers_to_id").alias("record_id")).distinct(), "record_id", "left_semi")
    target = target.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).distinct()
    return rows.join(target, "refers_to_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
q AS (SELECT page_id, n, sha1(h) AS d, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS m FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m = page_id THEN NULL ELSE m END AS refers_to
FROM q
"""
