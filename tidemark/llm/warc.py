"""WARC writing, reading and transaction assembly.

`write_captures` turns each page into three records: a request, a response (or, for a payload of at least
``min_revisit`` bytes that an equal payload with a larger page_id represents, a revisit), and a metadata record; request
and metadata name the response in WARC-Concurrent-To, and a revisit names its response in WARC-Refers-To. Records are
written by Spark's own text writer (one record a row, the record end CR LF CR LF as line separator, gzip), so archives
go to whatever store the shared folder is in, under Spark's commit protocol. Pages are written by classes of length,
each with as many captures a file as make ``FILE_BYTES`` at most (a longer page is a file of its own).

`read_records` reads archives by Content-Length, never by looking for separators in payloads, and decompresses a file
bit by bit. `assemble` joins request, response and metadata records through the concurrent-to identifiers, in either
direction, and gives one nested row per capture. `captures` resolves what a revisit refers to: the response with that
record id, or where only payload digest and target URI are given, as WARC 1.1 allows, the response with those.

Record ids come from the row's place in the input of the one job that writes, so repeated rows are captures of their
own; the response of a payload that others revisit is named after its digest. Rows that tie for the largest page_id of a
payload are all responses; where rows tie in the url as well, no record id tells them apart, and revisits refer to them
by digest and URI.

Defined results: a null html is an empty payload; a null page_id or url stays null (null page_ids come last in a
payload's order, and are responses only where all are null); an empty table gives no archives and an empty result; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import new_path, small, stage

CRLF = "\r\n"
RECORD_END = CRLF + CRLF
FILE_BYTES = 64 << 20
#: Pages up to these lengths are written together.
CLASSES = (4 << 10, 32 << 10, 1 << 20)
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, type string, concurrent_to array<string>, refers_to string, refers_to_uri string, target_uri string, date string, content_type string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"


def _urn(kind: str, place: Column) -> Column:
    """A record id from the row's place."""
    return _uuid(kind, F.lpad(F.lower(F.hex(place)), 16, "0"))


def _uuid(kind: str, h: Column) -> Column:
    """16 hex digits in a UUID's last two groups."""
    return F.concat(F.lit(f"<urn:uuid:{kind}-0000-4000-"), F.substring(h, 1, 4), F.lit("-"), F.substring(h, 5, 12), F.lit(">"))


RESPONSE, REQUEST, METADATA, REPEATED = "00000001", "00000002", "00000003", "00000004"


def repeated_payloads(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = 1000) -> DataFrame:
    """(payload, response_page, response_url, alone) of payloads that more than one page has: the page with the largest page_id (ties: the largest url) represents them; alone: no other row is equal to it."""
    raw = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.where(F.octet_length(raw) >= min_revisit).select(F.sha1(raw).alias("payload"), F.struct(F.col(page_id).alias("page_id"), F.col(url).alias("url")).alias("p"))
    found = rows.groupBy("payload", "p").agg(F.count("*").alias("n")).groupBy("payload").agg(F.sum("n").alias("n"), F.max(F.struct("p", "n")).alias("x")).where("n > 1")
    return found.select("payload", F.col("x.p.page_id").alias("response_page"), F.col("x.p.url").alias("response_url"), (F.col("x.n") == 1).alias("alone"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """Headers with null values are left out; the record end is the writer's line separator."""
    lines = [F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.lit("WARC/1.1" + CRLF), F.concat_ws(CRLF, *lines, length), F.lit(RECORD_END), block)


def write_captures(pages: DataFrame, root: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = 1000) -> str:
    """Writes archives of all pages below root (a new shared folder if None) and returns it."""
    spark = pages.sparkSession
    root = root or new_path(spark, "warc")
    known = small(stage(repeated_payloads(pages, page_id, url, html, min_revisit), "warc-payloads"))
    raw = F.coalesce(F.col(html), F.lit(""))
    n_raw = F.octet_length(raw)
    bounds = [-1, *CLASSES, None]
    inside = [(n_raw > a) & (n_raw <= b if b else F.lit(True)) for a, b in zip(bounds, bounds[1:], strict=False)]
    found = pages.agg(*[F.max(F.when(c, n_raw)) for c in inside]).first()  # the longest page of each class
    for own_class, longest in zip(inside, found, strict=True):
        if longest is not None or not any(x is not None for x in found):  # an empty table makes an empty folder
            _write_class(pages, own_class, known, root, page_id, url, raw, max(1, FILE_BYTES // ((longest or 0) + 2048)))
    return root


def _write_class(pages: DataFrame, own_class: Column, known: DataFrame, root: str, page_id: str, url: str, raw: Column, rows_of_file: int) -> None:
    # places are given before the class is chosen, so that they differ between classes
    own = pages.select(F.monotonically_increasing_id().alias("place"), F.col(page_id).alias("page_id"), F.col(url).alias("url"), raw.alias("tm_html"), own_class.alias("own_class")).where("own_class")
    raw = F.col("tm_html")
    own = own.select("place", "page_id", "url", "tm_html", F.sha1(raw.cast("binary")).alias("digest"), F.octet_length(raw).cast("long").alias("n_bytes"))
    rows = own.join(known, own["digest"] == known["payload"], "left")
    revisit = F.col("payload").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_page"))
    first = F.col("payload").isNotNull() & F.col("page_id").eqNullSafe(F.col("response_page")) & F.col("url").eqNullSafe(F.col("response_url")) & F.col("alone")
    named = _uuid(REPEATED, F.substring("digest", 1, 16))
    record = F.when(first, named).otherwise(_urn(RESPONSE, F.col("place")))
    # header values hold no line ends
    one_line = lambda x: F.regexp_replace(x, r"[\r\n]", "")
    target = F.coalesce(one_line("url"), F.concat(F.lit("urn:page:"), F.col("place")))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(RECORD_END))
    common = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", target)]
    response = _record(
        [
            ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            ("WARC-Record-ID", record),
            *common,
            ("WARC-Payload-Digest", digest),
            ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
            ("WARC-Refers-To", F.when(revisit & F.col("alone"), named)),
            ("WARC-Refers-To-Target-URI", F.when(revisit, one_line("response_url"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(revisit, http).otherwise(F.concat(http, F.col("tm_html"))),
    )
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _urn(REQUEST, F.col("place"))), *common, ("WARC-Concurrent-To", record), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.lit(f"GET / HTTP/1.1{CRLF}Accept: text/html{RECORD_END}"),
    )
    # base64 keeps a URL's own line ends out of the field; a null value leaves the field out
    fields = F.concat_ws(CRLF, F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.concat(F.lit("page-url-base64: "), F.translate(F.base64(F.col("url").cast("binary")), CRLF, "")))
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _urn(METADATA, F.col("place"))), *common, ("WARC-Concurrent-To", record), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(fields, F.lit(CRLF)),
    )
    rows = rows.select(F.concat_ws(RECORD_END, request, response, metadata).alias("value"))
    rows.write.mode("append").option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", rows_of_file).text(root)


def _decompressed(raw: bytes) -> Iterator[bytes]:
    """The content of an archive piece by piece, gzipped in one member or in many, or plain."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    member = zlib.decompressobj(31)
    for at in range(0, len(raw), 1 << 16):
        piece = raw[at : at + (1 << 16)]
        while piece:
            if member.eof:
                piece = piece.lstrip(b"\x00")
                if not piece:
                    break
                member = zlib.decompressobj(31)
            yield member.decompress(piece)
            piece = member.unused_data if member.eof else b""


def parse_archive(raw: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers (names in lower case) and block of every record of one archive; only one record is held at a time."""
    pieces, buffer = _decompressed(raw), bytearray()

    def fill(n: int) -> bool:
        """Whether the buffer holds n bytes, after reading on where it does not."""
        while len(buffer) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    while True:
        while fill(2) and buffer[:2] == b"\r\n":
            del buffer[:2]
        if not buffer:
            return
        end = -1
        while (end := buffer.find(b"\r\n\r\n", max(0, end))) < 0:
            end = len(buffer) - 3
            if not fill(len(buffer) + 1):
                raise ValueError("the last record is cut off")
        version, *lines = buffer[:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at {bytes(buffer[:40])!r}")
        headers: dict[str, list[str]] = {}
        for line in lines:
            name, _, value = line.partition(":")
            headers.setdefault(name.lower(), []).append(value.strip())
        length = int(headers["content-length"][0])
        if not fill(end + 4 + length):
            raise ValueError("the last record is cut off")
        block = bytes(buffer[end + 4 : end + 4 + length])
        del buffer[: end + 4 + length]
        yield headers, block


def read_records(spark: SparkSession, root: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives below root, as RECORD. Digest and length are of the payload as read, for revisits as recorded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.strip().split(" ", 1)[0] for x in RECORD.replace("map<string,string>", "map").split(",")]
        kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for raw in batch.column(0):
                rows, held = [], 0
                for headers, block in parse_archive(raw.as_py()):
                    one = lambda k, h=headers: h.get(k, [None])[0]
                    kind, digest, payload, fields, n = one("warc-type"), one("warc-payload-digest"), block, None, None
                    if (one("content-type") or "").startswith("application/http"):
                        head = block[: 1 << 16].partition(b"\r\n\r\n")[0]
                        payload = block[len(head) + 4 :]
                        if kind == "revisit":
                            n = next((int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                    elif (one("content-type") or "") == "application/warc-fields":
                        fields = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode().split("\r\n") if x)]
                    if kind == "response":
                        n, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    elif digest:
                        digest = digest.rpartition(":")[2]
                    keep = payload if with_payload and kind != "revisit" else None
                    rows.append((one("warc-record-id"), kind, headers.get("warc-concurrent-to", []), one("warc-refers-to"), one("warc-refers-to-target-uri"), one("warc-target-uri"), one("warc-date"), one("content-type"), digest, n, fields, keep))
                    held += len(keep or b"") + 500
                    if held > 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(root).select("content")
    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit: capture_id, response, request, metadata (structs; the latter two arrays).

    A request or metadata record belongs to the response it names in WARC-Concurrent-To, or that names it; records
    that belong to no response are left out.
    """
    kept = records.where(F.col("type").isin("request", "response", "revisit", "metadata"))
    main = F.col("type").isin("response", "revisit")
    whole = F.struct(*[F.col(c) for c in records.columns])
    forward = kept.select(F.explode(F.when(main, F.array("record_id")).otherwise(F.col("concurrent_to"))).alias("capture_id"), "type", whole.alias("r"))
    named = kept.where(main & (F.size("concurrent_to") > 0)).select(F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("other"))
    others = kept.where(~main).select("record_id", "type", whole.alias("r"))
    backward = named.join(others, named["other"] == others["record_id"]).select("capture_id", "type", "r")
    grouped = forward.unionByName(backward).groupBy("capture_id").agg(
        F.first(F.when(main, F.col("r")), ignorenulls=True).alias("response"), F.collect_list(F.when(F.col("type") == "request", F.col("r"))).alias("request"), F.collect_list(F.when(F.col("type") == "metadata", F.col("r"))).alias("metadata")
    )
    return grouped.where(F.col("response").isNotNull())


def captures(assembled: DataFrame, page_type: str = "long") -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (the response's page_id) from assembled rows of `write_captures`."""
    fields = F.get(F.col("metadata"), F.lit(0))["fields"]
    by_uri = lambda digest, uri: F.concat(digest, F.lit(" "), uri)
    rows = assembled.select(
        fields["page-id"].cast(page_type).alias("page_id"),
        F.unbase64(fields["page-url-base64"]).cast("string").alias("url"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.when(F.col("response.type") == "revisit", F.coalesce(F.col("response.refers_to"), by_uri(F.col("response.payload_digest"), F.col("response.refers_to_uri")))).alias("wanted"),
        F.array("capture_id", by_uri(F.col("response.payload_digest"), F.col("response.target_uri"))).alias("names"),
    )
    rows = stage(rows, "warc-captures")
    wanted = small(stage(rows.where(F.col("wanted").isNotNull()).select(F.col("wanted").alias("name")).distinct(), "warc-wanted"))
    responses = rows.where("record_type = 'response'").select(F.explode("names").alias("name"), F.col("page_id").alias("refers_to")).join(wanted, "name", "left_semi")
    responses = small(stage(responses.groupBy("name").agg(F.max("refers_to").alias("refers_to")), "warc-responses"))
    return rows.join(responses, rows["wanted"] == responses["name"], "left").select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
