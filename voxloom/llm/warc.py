"""WARC archives packaged in ZIP files: writing them, and reading records by byte range.

Each task writes ZIP files that hold a WARC file (one gzip member a record) and an index of
its records, both stored without compression of the ZIP's own. The reader parses the end of
the central directory (and its ZIP64 form), the directory, and a member's local header; it
then knows where in the ZIP file the index and each record lie, reads the index, and reads
records by range. Nothing is extracted, and no member is read whole.

Of records with equal payloads of ``least`` bytes or more, the one with the largest page_id
is a response; the others are revisits that refer to it and hold no payload. A null html is
an empty payload. Rows that repeat the largest page_id are responses all; a null page_id
counts as smaller than any other, and if all are null all are responses. An empty table
gives no archives and no rows. Columns other than page_id, url and html aren't written.

Files go to the folder that the cluster shares, through pyarrow's file systems, each under a
name of its own attempt; the manifest lists those of tasks that ended well, so a task that
runs again leaves nothing wrong behind.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.texts import map_rows, per_task
from voxloom.plans.durable import durable, shared_dir

ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 2 << 20
#: Archive bytes that one task reads back.
TASK_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to, revisit: bool) -> bytes:
    """``size``: of the payload, which a revisit names but doesn't hold."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page{_id(page_id)}>", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(url.split()))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page{_id(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The record's figures; a response's digest is taken anew from its payload and must agree."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    return {"page_id": _page(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _page(fields.get("warc-refers-to"))}


def _id(page_id) -> str:
    """The id as text that a header may hold; nothing for null."""
    return "" if page_id is None else ":" + quote(str(page_id), safe="")


def _page(urn: str | None) -> str | None:
    x = urn[len("<urn:page") : -1] if urn else ""
    return unquote(x[1:]) if x else None


class ZipDirectory:
    """The members of a ZIP file, found by range reads through ``read(at, n)``."""

    def __init__(self, read, size: int):
        self.read = read
        tail_at = max(0, size - 22 - FULL16)
        tail = read(tail_at, size - tail_at)
        end = tail.rfind(END)
        while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(END, 0, end)  # the signature may stand in the comment
        if end < 0:
            raise ValueError("no end of central directory")
        n, length, at = struct.unpack_from("<HII", tail, end + 10)
        if n == FULL16 or FULL32 in (length, at):
            where = tail_at + end - 20
            locator = read(where, 20) if where >= 0 else b""
            if locator[:4] == LOCATOR64:
                (end64,) = struct.unpack_from("<Q", locator, 8)
                record64 = read(end64, 56)
                if record64[:4] != END64:
                    raise ValueError("no ZIP64 end of central directory")
                n, length, at = struct.unpack_from("<QQQ", record64, 32)
        self.members = self._entries(read(at, length), n)

    @staticmethod
    def _entries(data: bytes, n: int) -> dict[str, dict]:
        out, at = {}, 0
        for _ in range(n):
            if data[at : at + 4] != ENTRY:
                raise ValueError("damaged central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            packed, size, a, b, c = struct.unpack_from("<IIHHH", data, at + 20)
            (offset,) = struct.unpack_from("<I", data, at + 42)
            name = data[at + 46 : at + 46 + a].decode("utf-8" if flags & 0x800 else "cp437")
            extra, end = at + 46 + a, at + 46 + a + b
            while extra + 4 <= end:
                tag, m = struct.unpack_from("<HH", data, extra)
                if tag == 1:  # ZIP64: just the fields that are full, in this order
                    wide = iter(struct.unpack_from(f"<{m // 8}Q", data, extra + 4))
                    size = next(wide) if size == FULL32 else size
                    packed = next(wide) if packed == FULL32 else packed
                    offset = next(wide) if offset == FULL32 else offset
                extra += 4 + m
            out[name] = {"offset": offset, "size": size, "packed": packed, "stored": method == 0}
            at = end + c
        return out

    def place(self, name: str) -> tuple[int, int]:
        """(first byte, bytes) of a stored member's data in the file."""
        m = self.members[name]
        if not m["stored"]:
            raise ValueError(f"{name} is compressed; it can't be read by range")
        head = self.read(m["offset"], 30)
        if head[:4] != LOCAL:
            raise ValueError("damaged local header")
        a, b = struct.unpack_from("<HH", head, 26)
        return m["offset"] + 30 + a + b, m["size"]


def _opened(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    f = system.open_input_file(inner)

    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    return read, f.size()


def classified(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, payload, size, digest, revisit, refers_to)."""
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.length("payload") >= least
    # Only digests that come again are met; a payload that comes once doesn't wait for a match.
    top = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").select("digest", "top")
    joined = rows.join(top, "digest", "left")
    revisit = F.col("top").isNotNull() & large & ~F.col("page_id").eqNullSafe(F.col("top"))
    return joined.select("page_id", "url", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), F.length("payload").alias("size"), "digest", revisit.alias("revisit"), F.when(revisit, F.col("top")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, bytes, records) of the archives written under ``folder``; ``records`` as from ``classified``."""

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(folder)
        system.create_dir(inner, recursive=True)
        warc, index = io.BytesIO(), []

        def flush():
            name = f"{uuid.uuid4().hex}.wacz"
            packed = io.BytesIO()
            with zipfile.ZipFile(packed, "w", zipfile.ZIP_STORED) as z:
                z.writestr(WARC_MEMBER, warc.getbuffer())
                z.writestr(INDEX_MEMBER, "".join(index))
            with system.open_output_stream(f"{inner}/{name}") as out:
                out.write(packed.getbuffer())
            got = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [packed.tell()], "records": [len(index)]}, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))
            warc.seek(0)
            warc.truncate()
            index.clear()
            return got

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                    data = gzip.compress(record(r["page_id"], r["url"], r["payload"], r["size"], digest, r["refers_to"], r["revisit"]), 3, mtime=0)
                    index.append(f"page{_id(r['page_id'])} {json.dumps({'offset': warc.tell(), 'length': len(data)})}\n")
                    warc.write(data)
                    if warc.tell() >= archive_bytes:
                        yield flush()
        if index:
            yield flush()

    from voxloom.plans.ship import ship

    ship(records.sparkSession)
    return durable(records.mapInArrow(write, "path string, bytes bigint, records bigint"))


def read_archives(archives: DataFrame, kind: str = "string") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record; ids are read as ``kind``."""

    @per_task
    def locate():
        def step(paths):
            out = [[], [], [], []]
            for path in paths:
                read, size = _opened(path)
                z = ZipDirectory(read, size)
                base, _ = z.place(WARC_MEMBER)
                where = [json.loads(x.split(" ", 1)[1]) for x in read(*z.place(INDEX_MEMBER)).decode().splitlines()]
                start = 0
                while start < len(where):  # neighbours are read in one range
                    end, n = start, 0
                    while end < len(where) and n < RANGE_BYTES:
                        n += where[end]["length"]
                        end += 1
                    for c, x in zip(out, (path, base + where[start]["offset"], n, [w["length"] for w in where[start:end]]), strict=True):
                        c.append(x)
                    start = end
            return out

        return step

    @per_task
    def fetch():
        def step(paths, ats, ns, lengths):
            out = []
            for path, at, n, each in zip(paths, ats, ns, lengths, strict=True):
                data, k = _opened(path)[0](at, n), 0
                for m in each:
                    out.append(parse(gzip.decompress(data[k : k + m])))
                    k += m
            return [[r[c] for r in out] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")] if out else None

        return step

    ranges = map_rows(archives.select("path"), locate, "path string, at bigint, n bigint, lengths array<bigint>")
    total = archives.agg(F.sum("bytes")).first()[0] or 0
    # Ranges say nothing of the bytes behind them, so the number of tasks is set by these.
    dealt = durable(ranges).repartition(max(1, -(-total // TASK_BYTES)), "path", "at")
    got = map_rows(dealt, fetch, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")
    return got.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def new_folder(spark: SparkSession, name: str = "warc") -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    folder = new_folder(pages.sparkSession)
    return read_archives(write_archives(classified(pages, least), folder, archive_bytes), pages.schema["page_id"].dataType.simpleString())
