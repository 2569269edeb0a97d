"""WARC archives packaged in ZIP files: writer, and a range reader without extraction.

A package is a ZIP file of stored (uncompressed) members: ``archive/data.warc.gz`` with one gzip
member per WARC record, and ``indexes/index.cdxj`` with the place of every record. The reader
finds the end-of-directory records (ZIP64 ones too), parses the central directory, locates both
members by their local headers, and then reads each record by its byte range alone. On shared
file systems that is a ranged read of the file; on other stores Spark's binary reader supplies the
bytes and the same ranges are taken from them.

Packages are bounded by ``package_bytes``, so a task holds one package at a time. They are
written by Spark's text writer (one package a file, through the job's output commit, so a lost
executor leaves nothing behind); the line end it appends is declared as the archive's comment.

Payloads of at least ``min_bytes`` that occur more than once are stored once: the smallest page
id holds the response, the others are revisit records that refer to it. The digests meet in an
aggregate with map-side partial minima; a hot digest only makes a join that AQE can split.

Defined results: null payload reads as empty; a null page id is kept as null and never the one
referred to unless all ids of a payload are null (then all are responses); rows that share both
the smallest id and the payload are all responses; a null url is left out of the headers; repeated rows give
repeated records; an empty table gives no record. Other columns are not written.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ZIP record signatures and the revisit profile of WARC 1.1.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF
RECORD = "page_id: {id}, url: string, payload_bytes: bigint, payload_digest: string, record_type: string, refers_to: {id}, verified: boolean, payload: binary"


# -- ZIP ---------------------------------------------------------------------------------------
def zip_package(members: list[tuple[str, bytes]], comment: bytes = b"") -> bytes:
    """A ZIP file of stored members with ZIP64 directory records."""
    out, directory, at = [], [], 0
    for name, data in members:
        raw, crc = name.encode(), zlib.crc32(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        head = struct.pack("<4s5H3L2H", LOCAL, 45, 0x800, 0, 0, 33, crc, FULL32, FULL32, len(raw), len(extra)) + raw + extra
        extra64 = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
        directory.append(
            struct.pack("<4s6H3L5H2L", CENTRAL, 45, 45, 0x800, 0, 0, 33, crc, FULL32, FULL32, len(raw), len(extra64), 0, 0, 0, 0, FULL32) + raw + extra64
        )
        out += [head, data]
        at += len(head) + len(data)
    listing = b"".join(directory)
    end64 = struct.pack("<4sQ2H2L4Q", END64, 44, 45, 45, 0, 0, len(members), len(members), len(listing), at)
    locator = struct.pack("<4sLQL", LOCATOR64, 0, at + len(listing), 1)
    end = struct.pack("<4s4H2LH", END, 0, 0, FULL16, FULL16, FULL32, FULL32, len(comment))
    return b"".join([*out, listing, end64, locator, end, comment])


def zip_directory(read_at: Callable[[int, int], bytes], size: int) -> dict[str, tuple[int, int, int]]:
    """Members of a ZIP file by name: (offset of the local header, stored size, method)."""
    tail_at = max(0, size - 22 - FULL16)
    tail = read_at(tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)  # a signature inside the comment
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    _, _, _, _, count, length, offset, _ = struct.unpack_from("<4s4H2LH", tail, at)
    if FULL16 == count or FULL32 in (length, offset):
        locator = read_at(tail_at + at - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("ZIP64 locator missing")
        record = read_at(struct.unpack("<4sLQL", locator)[2], 56)
        if record[:4] != END64:
            raise ValueError("ZIP64 end of central directory missing")
        _, _, _, _, _, _, _, count, length, offset = struct.unpack("<4sQ2H2L4Q", record)
    listing, members, p = read_at(offset, length), {}, 0
    for _ in range(count):
        fields = struct.unpack_from("<4s6H3L5H2L", listing, p)
        if fields[0] != CENTRAL:
            raise ValueError("central directory entry expected")
        method, stored, plain, n, m, k, start = fields[4], fields[8], fields[9], fields[10], fields[11], fields[12], fields[16]
        name = listing[p + 46 : p + 46 + n].decode("utf-8", "replace")
        q, stop = p + 46 + n, p + 46 + n + m
        while q + 4 <= stop:
            kind, width = struct.unpack_from("<HH", listing, q)
            if kind == 1:  # 64-bit values, only of the fields that are full
                values = iter(struct.unpack_from(f"<{width // 8}Q", listing, q + 4))
                if plain == FULL32:
                    plain = next(values)
                if stored == FULL32:
                    stored = next(values)
                if start == FULL32:
                    start = next(values)
            q += 4 + width
        members[name] = (start, stored, method)
        p += 46 + n + m + k
    return members


def member_start(read_at: Callable[[int, int], bytes], header_at: int) -> int:
    """Where a member's stored bytes begin, from its local header."""
    head = read_at(header_at, 30)
    if head[:4] != LOCAL:
        raise ValueError("local file header expected")
    n, m = struct.unpack_from("<2H", head, 26)
    return header_at + 30 + n + m


# -- WARC --------------------------------------------------------------------------------------
def _id(page) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _page(record_id: str) -> str | None:
    value = record_id.strip("<>").rpartition(":")[2]
    return None if value == "none" else value


def warc_record(page, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record: a response with its payload, or a revisit when ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_id(page)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URL_SAFE = "".join(chr(c) for c in range(33, 127)).replace("%", "") + "%"


def _headers(block: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs if k}


def parse_record(record: bytes) -> dict:
    """Fields of a record; ``payload`` is None for a revisit, ``verified`` checks a response's digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    warc = _headers(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = warc.get("warc-payload-digest", "").removeprefix("sha256:")
    revisit = warc["warc-type"] == "revisit"
    return {
        "page_id": _page(warc["warc-record-id"]), "url": warc.get("warc-target-uri"), "payload_bytes": int(_headers(http)["content-length"]),
        "payload_digest": digest, "record_type": warc["warc-type"], "refers_to": _page(warc["warc-refers-to"]) if revisit else None,
        "verified": revisit or hashlib.sha256(payload).hexdigest() == digest, "payload": None if revisit else payload,
    }


# -- Spark -------------------------------------------------------------------------------------
def _packages(package_bytes: int) -> Callable:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        index: list[str] = []
        size = 0

        def package() -> pa.RecordBatch:
            data = zip_package([(ARCHIVE, b"".join(records)), (INDEX, ("\n".join(index) + "\n").encode())], b"\n")
            return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], ["package"])  # the writer adds the line end

        for batch in batches:
            for r in batch.to_pylist():
                record = gzip.compress(warc_record(r["page"], r["url"], r["payload"], r["digest"], r["refers_to"]), 6, mtime=0)
                if records and size + len(record) > package_bytes:
                    yield package()
                    records, index, size = [], [], 0
                where = {"url": r["url"], "digest": f"sha256:{r['digest']}", "offset": size, "length": len(record), "filename": "data.warc.gz"}
                index.append(f"{_id(r['page'])[1:-1]} 19700101000000 {json.dumps(where)}")
                records.append(record)
                size += len(record)
        if records:
            yield package()

    return build


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 100, package_bytes: int = 16 << 20) -> None:
    """Write one record per row of ``pages`` into packages under ``folder``."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    shared = (
        rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
        .agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    )
    refers = F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    joined = rows.join(shared, "digest", "left").select("page", "url", "payload", "digest", refers)
    packages = joined.mapInArrow(_packages(package_bytes), "package binary")
    packages.select(F.col("package").cast("string")).write.option("maxRecordsPerFile", 1).text(folder)


def _ranges(path: str, content: bytes | None) -> Callable[[int, int], bytes]:
    if content is not None:
        return lambda at, n: content[at : at + n]
    file = open(path, "rb")  # noqa: SIM115  closed with the closure

    def read_at(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    return read_at


def records(read_at: Callable[[int, int], bytes], size: int) -> Iterator[dict]:
    """The records of one package, each read by its byte range."""
    members = zip_directory(read_at, size)
    for name in (ARCHIVE, INDEX):
        if members[name][2] != 0:
            raise ValueError(f"{name} is compressed: its records cannot be read by range")
    base = member_start(read_at, members[ARCHIVE][0])
    listing = read_at(member_start(read_at, members[INDEX][0]), members[INDEX][1])
    for line in listing.decode().splitlines():
        where = json.loads(line.split(" ", 2)[2])
        yield parse_record(gzip.decompress(read_at(base + where["offset"], where["length"])))


def read(spark: SparkSession, folder: str, id_type: str = "bigint", payload: bool = True) -> DataFrame:
    """Every record of the packages under ``folder`` (columns of :data:`RECORD`)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    shared = folder.startswith("/") or folder.startswith("file:")
    files = files.select("path", "length", (F.lit(None).cast("binary") if shared else F.col("content")).alias("content"))
    names = [x.split(":")[0].strip() for x in RECORD.split(", ")]
    kinds = {"payload_bytes": pa.int64(), "verified": pa.bool_(), "payload": pa.binary()}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)

        for b in batches:
            for f in b.to_pylist():
                path = f["path"].removeprefix("file:")
                path = "/" + path.lstrip("/") if f["content"] is None else path
                rows, size = [], 0
                for r in records(_ranges(path, f["content"]), f["length"]):
                    if not payload:
                        r["payload"] = None
                    rows.append(r)
                    size += r["payload_bytes"]
                    if size > 4 << 20 or len(rows) >= 5000:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    text_ids = RECORD.replace("{id}", "string").replace(": ", " ")
    found = files.mapInArrow(parse, text_ids)
    return found.select(*[F.col(n).cast(id_type).alias(n) if n in ("page_id", "refers_to") else F.col(n) for n in names])
