"""WARC archives: write captures, read records, assemble transactions.

``write_captures`` writes a request, a response (or revisit) and a metadata record
a page; the request and the metadata name their response in WARC-Concurrent-To.
Archives are WARC/1.1 files with a gzip member for each record, so a record can be read at its offset, written by Spark's own file writer
and committed with the job, so a retried task leaves nothing twice. They are rolled by bytes, at about FILE_BYTES. ``read_records`` streams records from archives
(.gz with one or many members, or plain) on any store that Spark reads, one
archive a row: an archive must stay below Spark's 2 GB limit for one value.
``assemble`` reads them once, joins the records of a capture and emits one nested row. Either side may name the other in
WARC-Concurrent-To, any number of times; a capture holds all its requests and metadata records, and records
whose response is not there make a capture without one.

Revisits: among equal payloads of at least ``min_bytes`` bytes the smallest page_id
is the response and all others are revisits that refer to it; rows that repeat
that page_id are responses too. Digests are bare upper-case base32 SHA-1.

Nulls: a null html is an empty payload, a null url an empty target, a null
page_id a capture without page id (never a revisit's target unless all are
null). Repeated page_ids: one capture a row, each with a record id of its own; a revisit names one that exists. Empty table: empty result.
Payloads may hold anything, record separators and WARC headers included: the
reader goes by Content-Length alone. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table

DATE = "2024-01-01T00:00:00Z"
CHUNK = 1 << 20
#: Bytes that count as one row of the writer, and rows of an archive.
ROW_BYTES, FILE_ROWS = 8 * CHUNK, 64
FILE_BYTES = ROW_BYTES * FILE_ROWS
RECORD = "record_id string, record_type string, target_uri string, concurrent_to array<string>, refers_to string, payload_digest string, content_type string, headers map<string,string>, payload binary, payload_bytes bigint, actual_digest string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, rid: str, uri: str, headers: dict[str, str], body: bytes, content_type: str) -> bytes:
    """One WARC/1.1 record without the two line ends that close it. Header values are kept to one line."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{rid}>", "WARC-Date": DATE, **({"WARC-Target-URI": uri} if uri else {}), **headers, "Content-Type": content_type, "Content-Length": str(len(body))}
    lines = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + body


def _one_line(v: str) -> str:
    """Per cent escapes for what would end a header line."""
    return re.sub(r"[\x00-\x1f]", lambda m: f"%{ord(m[0]):02X}", v)


def capture_records(page_id, base: str, url: str | None, payload: bytes, dig: str, refers_to: str | None) -> list[bytes]:
    """The records of a capture: request, response or revisit (of the record refers_to), metadata."""
    uri = url or ""
    rid = base + ":response"
    host, path = m.groups() if (m := re.match(r"[^:]*://([^/?#]*)([^#]*)", uri)) else ("", "")
    common = {"WARC-Payload-Digest": f"sha1:{dig}"}
    if refers_to is None:
        main = record("response", rid, uri, common, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload, "application/http;msgtype=response")
    else:
        more = common | {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{refers_to}>"}
        main = record("revisit", rid, uri, more, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload), "application/http;msgtype=response")
    ask = record("request", base + ":request", uri, {"WARC-Concurrent-To": f"<{rid}>"}, f"GET {_one_line(path) or '/'} HTTP/1.1\r\nHost: {_one_line(host)}\r\n\r\n".encode("utf-8", "surrogatepass"), "application/http;msgtype=request")
    meta = record("metadata", base + ":metadata", uri, {"WARC-Concurrent-To": f"<{rid}>"}, f"page-id: {'' if page_id is None else page_id}\r\n".encode(), "application/warc-fields")
    return [ask, main, meta]


def plan_captures(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """(page_id, base, url, html, refers_to): each row with the ids of its records and of the record it revisits. Only digests shuffle until the last join.

    Ids are urn:page:<page_id>. Rows of a page_id that repeats (or is null) are told apart: one of each payload is urn:page:<page_id>:<sha1>, the
    others have a number behind that. They are written first, so that numbers stay.
    """
    pid = F.col(f"`{id_col}`").alias("page_id")
    html = F.col(f"`{payload_col}`")
    body = F.coalesce(F.encode(html, "UTF-8"), F.lit(b""))
    rows = pages.select(pid, F.col(f"`{url_col}`").alias("url"), html.alias("html"), F.sha1(body).alias("sha"))
    sums = pages.select(pid, F.sha1(body).alias("sha"), F.octet_length(body).alias("n"))
    counted = sums.groupBy("page_id").agg(F.count("*").alias("rows"))
    twice = counted.where("rows > 1 OR page_id IS NULL").select(F.col("page_id").alias("t_id"))
    urn = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    plain = rows.withColumn("base", urn)
    if twice.limit(1).count():
        same = F.col("page_id").eqNullSafe(F.col("t_id"))
        odd = materialize(rows.join(twice, same, "left_semi").withColumn("row", F.monotonically_increasing_id()), "repeats")
        lead = odd.groupBy("page_id", "sha").agg(F.min("row").alias("lead")).select("lead")
        told = odd.join(lead, F.col("row") == F.col("lead"), "left")
        base = F.concat_ws(":", urn, "sha", F.when(F.col("lead").isNull(), (F.col("row") + 1).cast("string")))
        plain = plain.join(twice, same, "left_anti").unionByName(told.select("page_id", "url", "html", "sha", base.alias("base")))
    long = sums.where(F.col("n") >= min_bytes)
    first = long.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).where("rows > 1").select("sha", "first")
    first = first.join(twice, F.col("first").eqNullSafe(F.col("t_id")), "left_semi").withColumn("many", F.lit(True)).unionByName(first.join(twice, F.col("first").eqNullSafe(F.col("t_id")), "left_anti").withColumn("many", F.lit(False)))
    visits = long.join(first, "sha").where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("v_id"), F.col("sha").alias("v_sha"), "first", "many").distinct()
    some = plain.join(visits, F.col("page_id").eqNullSafe(F.col("v_id")) & (F.col("sha") == F.col("v_sha")), "left")
    refers = F.when(F.col("v_sha").isNotNull(), F.concat(F.lit("urn:page:"), F.coalesce(F.col("first").cast("string"), F.lit("")), F.when(F.col("many"), F.concat(F.lit(":"), "sha")).otherwise(""), F.lit(":response")))
    return some.select("page_id", "base", "url", "html", refers.alias("refers_to"))


#: A gzip member without content: the writer's line separator, so that members follow one another.
_EMPTY_MEMBER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 0xFF, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_captures(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, compression: str = "gzip") -> None:
    """Write archives of every row of pages under path. compression: gzip or none."""
    pack = _member if compression == "gzip" else bytes

    def run(batches):
        out: list[bytes] = []
        size = 0

        def rows():
            # a row for each ROW_BYTES, the further ones empty: the writer rolls files by rows
            return pa.RecordBatch.from_arrays([pa.array([b"".join(out), *[b""] * (size // ROW_BYTES - 1)], pa.binary())], ["rows"])

        for b in batches:
            for page_id, base, url, html, ref in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)]):
                payload = b"" if html is None else html.encode("utf-8", "surrogatepass")
                for r in capture_records(page_id, base, url, payload, digest(payload), ref):
                    out.append(pack(r + b"\r\n\r\n"))
                    size += len(out[-1])
                if size >= ROW_BYTES:
                    yield rows()
                    out, size = [], 0
        if out:
            yield rows()

    planned = plan_captures(pages, id_col, url_col, payload_col, min_bytes)
    # the text writer copies bytes as they are
    text = planned.mapInArrow(run, "rows binary").select(F.col("rows").cast("string").alias("value"))
    sep = _EMPTY_MEMBER.decode("latin-1") if compression == "gzip" else "\r\n"
    text.write.option("lineSep", sep).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", FILE_ROWS).text(path)


def _inflate(data: bytes):
    """The bytes of an archive in pieces."""
    view = memoryview(data)
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(view), CHUNK):
            yield bytes(view[at : at + CHUNK])
        return
    d = zlib.decompressobj(31)
    for at in range(0, len(view), CHUNK):
        piece = bytes(view[at : at + CHUNK])
        while piece:
            text = d.decompress(piece, CHUNK)
            if text:
                yield text
            piece = d.unconsumed_tail
            if d.eof:
                piece, d = d.unused_data, zlib.decompressobj(31)


def _length(http: dict[str, str], payload: bytes) -> int:
    """The length that a revisit's HTTP header states, else what is there."""
    n = http.get("content-length", "").partition(",")[0].strip()
    return int(n) if n.isdigit() else len(payload)


def parse(data: bytes):
    """(headers, body) of each record of an archive, one record held at a time."""
    pieces = _inflate(data)
    buf = bytearray()

    def fill(n: int) -> bool:
        while len(buf) < n:
            more = next(pieces, None)
            if more is None:
                return False
            buf.extend(more)
        return True

    while True:
        while fill(2) and buf[:2] == b"\r\n":
            del buf[:2]
        if not buf:
            return
        end = buf.find(b"\r\n\r\n")
        while end < 0:
            seen = max(0, len(buf) - 3)
            if not fill(len(buf) + 1):
                raise ValueError("a record header is cut off")
            end = buf.find(b"\r\n\r\n", seen)
        if not buf.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should start")
        head: dict[str, str] = {}
        for line in buf[:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            k, v = k.strip().lower(), v.strip()
            # a header that comes again keeps all its values
            head[k] = f"{head[k]}\n{v}" if k in head else v
        n = int(head["content-length"].partition("\n")[0])
        if not fill(end + 4 + n):
            raise ValueError("a record is cut off")
        body = bytes(buf[end + 4 : end + 4 + n])
        del buf[: end + 4 + n]
        yield head, body


def read_records(spark: SparkSession, path: str, types: tuple[str, ...] | None = None, content: bool = True) -> DataFrame:
    """Records of all archives under path (``write_captures`` output or others', plain or gzip).

    types: only these WARC types. content False: leave payloads out but still measure and digest them.
    """
    src = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("content_type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("actual_digest", pa.string())])

        def bare(x):
            return x[1:-1] if x and x[0] == "<" and x[-1] == ">" else x

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for b in batches:
            for cell in b.column(0):
                rows, size = [], 0
                for h, body in parse(cell.as_py()):
                    kind = (h.get("warc-type") or "").lower() or None
                    if types and kind not in types:
                        continue
                    at = body.find(b"\r\n\r\n") if h.get("content-type", "").startswith("application/http") else -4
                    payload = body[at + 4 :]
                    d = h.get("warc-payload-digest", "").rpartition(":")[2] or None
                    http = {}
                    if at >= 0:
                        for line in body[:at].decode("utf-8", "replace").split("\r\n")[1:]:
                            k, _, v = line.partition(":")
                            k, v = k.lower(), v.strip()
                            http[k] = f"{http[k]}, {v}" if k in http else v
                    rows.append((bare(h.get("warc-record-id")), kind, h.get("warc-target-uri"), [bare(x) for x in h.get("warc-concurrent-to", "").split("\n") if x], bare(h.get("warc-refers-to")), d, h.get("content-type"), list(http.items()), payload if content or kind not in ("response", "revisit", "resource") else None, _length(http, payload) if kind == "revisit" else len(payload), digest(payload) if kind == "response" else d))
                    size += len(payload) if content else 200
                    if size >= 4 << 20:
                        yield flush(rows)
                        rows, size = [], 0
                if rows:
                    yield flush(rows)

    return src.mapInArrow(run, RECORD)


def assemble(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """One nested row a capture: (capture_id, target_uri, page_id, response, requests, metadata), joined through concurrent-to ids.

    requests and metadata are arrays of (record_id, payload), by id. A capture without a response has the id that its records name (or their own).
    """
    every = materialize(read_records(spark, path, ("response", "revisit", "request", "metadata"), content), "records")
    main = every.where("record_type IN ('response', 'revisit')")
    side = every.where("record_type IN ('request', 'metadata')").select("record_id", "record_type", "target_uri", "concurrent_to", "payload")
    # who belongs to which capture: sides that name one, and sides that a capture names
    named = side.select("record_id", F.explode("concurrent_to").alias("capture"))
    back = main.where(F.size("concurrent_to") > 0).select(F.col("record_id").alias("capture"), F.explode("concurrent_to").alias("record_id"))
    links = named
    if back.limit(1).count():
        links = named.unionByName(back.join(side.select("record_id"), "record_id", "left_semi").select("record_id", "capture")).distinct()
        # a side that names another side is with that side's capture
        via = links.join(back.select(F.col("record_id").alias("capture"), F.col("capture").alias("real")), "capture").select("record_id", F.col("real").alias("capture"))
        known = links.join(back.select(F.col("record_id").alias("capture")).distinct(), "capture", "left_anti").select("record_id", "capture")
        links = known.unionByName(via).distinct()
    joined = side.join(links, "record_id", "left").withColumn("capture", F.coalesce("capture", "record_id"))
    member = lambda t: F.array_sort(F.collect_list(F.when(F.col("record_type") == t, F.struct("record_id", "payload"))))
    sides = joined.groupBy("capture").agg(member("request").alias("requests"), member("metadata").alias("metadata"), F.min("target_uri").alias("side_uri"))
    fields = [c for c in main.columns if c not in ("concurrent_to", "target_uri")]
    mains = main.select(F.col("record_id").alias("main_id"), F.col("target_uri").alias("main_uri"), F.struct(*fields).alias("response"))
    out = mains.join(sides, F.col("main_id") == F.col("capture"), "full_outer")
    none = F.array().cast("array<struct<record_id:string,payload:binary>>")
    out = out.withColumn("requests", F.coalesce("requests", none)).withColumn("metadata", F.coalesce("metadata", none))
    page = F.array_max(F.transform("metadata", lambda m: F.regexp_extract(F.decode(m["payload"], "UTF-8"), r"page-id: *(-?[0-9]+)", 1)))
    return out.select(
        F.coalesce("main_id", "capture").alias("capture_id"), F.coalesce("main_uri", "side_uri").alias("target_uri"), F.when(page != "", page).cast("long").alias("page_id"), "response", "requests", "metadata",
    )


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_captures(table(spark, sf_dir, "pages"), path)
    c = assemble(spark, path, content=False)
    ref = F.regexp_extract("response.refers_to", r"^urn:page:(-?[0-9]+)(:[0-9a-f]+)?:response$", 1)
    return c.select(
        "page_id", F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.actual_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"), F.when(ref != "", ref).cast("long").alias("refers_to"),
    )
