"""WARC records in stored ZIP members (the layout of a web archive collection), written and range-read.

An archive holds ``archive/data-00000.warc.gz`` and following (each record its own gzip member) and
``indexes/index.cdx`` (one line a record: key, member, offset, length). All members are stored, so a record is a byte
range of the archive: the reader parses the end record, the ZIP64 records and the central directory, and never
extracts.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import bounded_batches, fresh_path, open_fs, put_atomic, written

#: Bytes after which a new WARC member begins, and that one range read takes at most (or one longer record).
MEMBER_BYTES = 64 << 20
READ_BYTES = 4 << 20
#: Repeated digests: broadcast up to this many (40 bytes each), joined by a shuffle beyond.
BROADCAST_DIGESTS = 200_000
INDEX_MEMBER = "indexes/index.cdx"


# -- reading ZIP --------------------------------------------------------------------------------------------------
class StoredZip:
    """Members of a ZIP file whose data is stored, by range reads: ``members`` has (offset of the data, size) by name."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail_at = max(0, size - 22 - 0xFFFF - 20)
        tail = file.read_at(size - tail_at, tail_at)
        i = tail.rfind(b"PK\x05\x06")
        while i >= 0 and i + 22 + struct.unpack_from("<H", tail, i + 20)[0] != len(tail):
            i = tail.rfind(b"PK\x05\x06", 0, i)
        if i < 0:
            raise ValueError("no ZIP end record")
        count, length, start = struct.unpack_from("<HII", tail, i + 10)
        if i >= 20 and tail[i - 20 : i - 16] == b"PK\x06\x07":
            at = struct.unpack_from("<Q", tail, i - 12)[0]
            big = file.read_at(56, at)
            if big[:4] != b"PK\x06\x06":
                raise ValueError("bad ZIP64 end record")
            count, length, start = struct.unpack_from("<QQQ", big, 32)
        directory, self.members, p = file.read_at(length, start), {}, 0
        for _ in range(count):
            if directory[p : p + 4] != b"PK\x01\x02":
                raise ValueError("bad central directory")
            flags, method = struct.unpack_from("<HH", directory, p + 8)
            packed, plain, n, extra, comment = struct.unpack_from("<IIHHH", directory, p + 20)
            local = struct.unpack_from("<I", directory, p + 42)[0]
            name = directory[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            q, end = p + 46 + n, p + 46 + n + extra
            while q + 4 <= end:
                kind, m = struct.unpack_from("<HH", directory, q)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{m // 8}Q", directory, q + 4))
                    plain = next(wide) if plain == 0xFFFFFFFF else plain
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    local = next(wide) if local == 0xFFFFFFFF else local
                q += 4 + m
            if method or flags & 1 or packed != plain:
                raise ValueError(f"{name} is not stored plainly")
            self.members[name] = (local, plain)
            p = end + comment
        self._data_at = {}

    def data_at(self, name: str) -> int:
        """Where the data of a member begins: after its local header, whose extra field may differ in length."""
        if name not in self._data_at:
            local = self.members[name][0]
            head = self.file.read_at(30, local)
            if head[:4] != b"PK\x03\x04":
                raise ValueError("bad local header")
            n, extra = struct.unpack_from("<HH", head, 26)
            self._data_at[name] = local + 30 + n + extra
        return self._data_at[name]

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        size = self.members[name][1]
        length = size - offset if length is None else length
        if offset < 0 or offset + length > size:
            raise ValueError("range outside the member")
        return self.file.read_at(length, self.data_at(name) + offset)


# -- records ------------------------------------------------------------------------------------------------------
class _Sink:
    """A stream without positions, for zipfile."""

    def __init__(self, out):
        self.out = out

    def write(self, data):
        self.out.write(data)
        return len(data)

    def flush(self):
        pass


def page_urn(page_id) -> str:
    return f"<urn:x-page:{page_id}>"


def warc_record(page_id, url: str | None, payload: bytes, digest: bytes, refers_to=None) -> bytes:
    """A response record, or a revisit (no payload) where ``refers_to`` is given; uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = (url or f"urn:x-page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {page_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {page_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload), names in lower case."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    lines = http.decode("latin-1").split("\r\n")[1:]
    return fields, {k.lower(): v for k, v in (x.split(": ", 1) for x in lines if x)}, payload


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archive(uri: str, records) -> int:
    """Stream (key, uncompressed record) pairs into one archive; returns the number of records."""
    n = 0

    def put(out):
        nonlocal n
        lines = []
        with zipfile.ZipFile(_Sink(out), "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            member, name, at = None, "", 0
            for key, record in records:
                if member is None or at >= MEMBER_BYTES:
                    if member:
                        member.close()
                    name, at = f"archive/data-{len(z.namelist()):05d}.warc.gz", 0
                    member = z.open(zipfile.ZipInfo(name), "w", force_zip64=True)
                packed = _gzip(record)
                member.write(packed)
                lines.append(f"{key} {name} {at} {len(packed)}\n")
                at += len(packed)
                n += 1
            if member:
                member.close()
            z.writestr(zipfile.ZipInfo(INDEX_MEMBER), "".join(lines))

    put_atomic(uri, put)
    return n


def read_archive(uri: str):
    """Yields (WARC headers, HTTP headers, payload) of all records that the index lists, by range reads."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as file:
        archive = StoredZip(file)
        entries = [(m, int(a), int(n)) for _, m, a, n in (x.split(" ") for x in archive.read(INDEX_MEMBER).decode().splitlines())]
        i = 0
        while i < len(entries):
            name, start, end, j = entries[i][0], entries[i][1], entries[i][1] + entries[i][2], i + 1
            while j < len(entries) and entries[j][0] == name and entries[j][1] == end and end + entries[j][2] - start <= READ_BYTES:
                end, j = end + entries[j][2], j + 1
            block = archive.read(name, start, end - start)
            for _, at, n in entries[i:j]:
                yield parse_record(zlib.decompress(block[at - start : at - start + n], 31))
            i = j


# -- the operator -------------------------------------------------------------------------------------------------
def archive_uri(path: str, part: int) -> str:
    return f"{path}/part-{part:06d}.wacz"


def write_pages(pages: DataFrame, path: str, revisit_from: int = 0) -> list[int]:
    """Write every row of ``pages`` (page_id, url, html) as a record; returns the numbers of the archives.

    Of equal payloads of at least ``revisit_from`` bytes the smallest page_id is the response, and rows with any other id
    are revisits of it. Rows that share the smallest id are responses each. A null page_id ranks last; if all ids
    of a payload are null, all are responses. Null html is an empty payload.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.unhex(F.sha1("html")))
    groups = rows.where(F.octet_length("html") >= revisit_from).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    groups = written(groups, "warc-repeated")
    n = groups.count()
    if n:
        rows = rows.join(F.broadcast(groups) if n <= BROADCAST_DIGESTS else groups, "digest", "left")
    else:
        rows = rows.withColumn("refers_to", F.lit(None).cast("long"))
    rows = rows.select("page_id", "url", "html", "digest", F.when(F.octet_length("html") >= revisit_from, F.col("refers_to")).alias("refers_to"))

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def records():
            for batch in batches:
                for lo in range(0, len(batch), 256):
                    part_rows = batch.slice(lo, 256)
                    html = part_rows.column(2).cast(pa.large_binary() if pa.types.is_large_string(part_rows.column(2).type) else pa.binary())
                    for key, url, payload, digest, first in zip(part_rows.column(0).to_pylist(), part_rows.column(1).to_pylist(), html.to_pylist(), part_rows.column(3).to_pylist(), part_rows.column(4).to_pylist(), strict=True):
                        yield key, warc_record(key, url, payload, digest, first if first != key else None)

        source = records()
        head = next(source, None)
        if head is not None:
            n = write_archive(archive_uri(path, part), (x for y in ([head], source) for x in y))
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([n])], ["part", "records"])

    # One row for each archive, whose number is that of the input partitions.
    return sorted(r.part for r in rows.mapInArrow(run, "part long, records long").collect())


def read_pages(spark, path: str, parts: list[int]) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records of the archives; a task for each."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        def number(urn: str | None):
            text = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
            return int(text) if text not in ("", "None") else None

        for batch in batches:
            for k in batch.column(0).to_pylist():
                rows = []
                for fields, http, payload in read_archive(archive_uri(path, parts[k])):
                    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError("payload digest mismatch")
                    rows.append({"page_id": number(fields["warc-record-id"]), "payload_bytes": int(http["content-length"]), "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("warc-refers-to"))})
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if not parts:
        return spark.createDataFrame([], out)
    return spark.range(0, len(parts), 1, numPartitions=len(parts)).mapInArrow(run, out)


def warc_roundtrip(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Write all pages, then read the archives back. See ``write_pages`` for nulls, ties and repeated rows; empty table: no rows."""
    bounded_batches(pages.sparkSession)
    path = fresh_path(pages.sparkSession, "warc")
    return read_pages(pages.sparkSession, path, write_pages(pages, path, revisit_from))
