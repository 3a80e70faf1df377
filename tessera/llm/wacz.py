"""WARC records in ZIP-packaged archives: written, indexed and read back by ranges.

An archive is a ZIP of stored members: ``archive/data.warc.gz`` (every record a gzip
member of its own), ``indexes/index.cdxj`` (CDXJ: a sorted line a record, with its key,
its time and a JSON object of url, digest, filename, offset and length) and
``datapackage.json``. The reader parses the end of the ZIP, the central directory and
their ZIP64 forms, finds the stored members under ``archive/`` and the indexes under
``indexes/`` (also gzipped ones), and then reads only the ranges of the records; nothing
is extracted. It reads archives of other software too: any names of WARC members, gzipped
or not; members that no index names are read from end to end; records other than
responses, resources and revisits are passed over.

Files are opened through Arrow's file systems, by URI, on the executors. A failed
attempt may leave an archive behind that no table names; a finished one is listed in
the table of archives that is written to the shared folder. Archives are read by a number
of tasks that the session's partitions and the number of archives set.

Defined results: a null payload is empty; a null url writes no target; a null id is
written as an empty name and read as null; a page that repeats an id and its payload
gives records of the same kind; repeated rows give a record each; a payload of any
length is one record; an empty table gives no archives and no records. Other columns are
ignored whatever their names. Of records of other software page_id and refers_to are
null, a digest that is missing is computed.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import urllib.parse
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import by_size, shared_dir, shuffle_partitions, written

#: Payloads of at least so many bytes are stored once.
LEAST = 1000
#: An archive is closed when its records take so many bytes.
ARCHIVE = 24 << 20
#: Bytes of records that are held at once.
STEP = 4 << 20
DATE, _TIME = "2024-01-01T00:00:00Z", "20240101000000"
_RECORDS, _INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_NAME = "urn:page:"


#: Names that Spark has for stores that Arrow knows by another.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "viewfs": "hdfs", "abfss": "abfs"}


def _opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    scheme, colon, rest = uri.partition(":")
    if scheme == "dbfs":  # mounted on every machine
        return pyarrow.fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(_SCHEMES.get(scheme, scheme) + colon + rest)


# --- records -------------------------------------------------------------------


def _quoted(url: str) -> str:
    return urllib.parse.quote(url, safe="".join(map(chr, range(33, 127))).replace("%", ""))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """A response record, or the revisit record of a payload that another page's record holds."""
    name = lambda i: f"<{_NAME}{'' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(4, f"WARC-Target-URI: {_quoted(url)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.split(b":", 1) for line in lines.split(b"\r\n")[1:] if b":" in line)
    return {k.strip().lower().decode(): v.strip().decode() for k, v in pairs}


def _sha1(told: str | None) -> str | None:
    """A digest as bare hexadecimal digits; None for none or another algorithm."""
    kind, _, value = (told or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value).hex()


def parsed(raw: bytes) -> dict | None:
    """The parts of a record, None if it is no capture; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    told = _fields(head)
    kind = told["warc-type"]
    if kind not in ("response", "resource", "revisit"):
        return None
    block = rest[: int(told["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n") if kind != "resource" else (b"", b"", block)
    digest, found = _sha1(told.get("warc-payload-digest")), hashlib.sha1(payload).hexdigest()
    if kind != "revisit" and digest not in (None, found):
        raise ValueError(f"payload of {told['warc-record-id']} doesn't match its digest")
    page = lambda x: int(n) if x and (n := x.strip("<>").removeprefix(_NAME)).lstrip("-").isdecimal() else None
    url, size = told.get("warc-target-uri"), _fields(http).get("content-length", "")
    return {
        "page_id": page(told["warc-record-id"]), "url": None if url is None else urllib.parse.unquote(url), "record_type": kind, "refers_to": page(told.get("warc-refers-to")),
        "payload_digest": digest or found, "payload_bytes": int(size) if kind == "revisit" and size.isdecimal() else len(payload), "payload": None if kind == "revisit" else payload,
    }


def cdxj(url: str | None, digest: str, kind: str, offset: int, length: int) -> str:
    """The index line of a record: the key (the host from its end on, the path), the time, a JSON object."""
    parts = urllib.parse.urlsplit(_quoted(url)) if url is not None else None
    key = "-" if parts is None else ",".join(reversed((parts.hostname or "").split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    fields = {"url": None if url is None else _quoted(url), "mime": "warc/revisit" if kind == "revisit" else "text/html", "status": "200", "digest": f"sha1:{digest}",
              "length": str(length), "offset": str(offset), "filename": _RECORDS.rpartition("/")[2]}
    return f"{key.lower()} {_TIME} {json.dumps(fields)}"


# --- ZIP -----------------------------------------------------------------------


def members(read: Callable[[int, int], bytes], size: int) -> dict[str, tuple[int, int, int]]:
    """Of a ZIP each member's method, local header's offset and size as stored. read(offset, length) gives bytes."""
    start = max(0, size - 22 - 65535)
    tail = read(start, size - start)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise ValueError("no ZIP: its end is missing")
    count, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, offset):
        locator = read(start + at - 20, 20)
        if locator[:4] != b"PK\6\7":
            raise ValueError("the ZIP64 locator is missing")
        end = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != b"PK\6\6":
            raise ValueError("the ZIP64 end is missing")
        count, length, offset = struct.unpack_from("<QQQ", end, 32)
    directory, found, at = read(offset, length), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\1\2":
            raise ValueError("the central directory is broken")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        stored, whole, names, extras, comment = struct.unpack_from("<IIHHH", directory, at + 20)
        (where,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + names : at + 46 + names + extras]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:  # holds, in this order, those values that don't fit above
                longs = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                whole = next(longs) if whole == 0xFFFFFFFF else whole
                stored = next(longs) if stored == 0xFFFFFFFF else stored
                where = next(longs) if where == 0xFFFFFFFF else where
            extra = extra[4 + n :]
        found[name] = method, where, stored
        at += 46 + names + extras + comment
    return found


def stored_at(read: Callable[[int, int], bytes], member: tuple[int, int, int]) -> int:
    """Where a stored member's bytes begin."""
    method, where, _ = member
    head = read(where, 30)
    if head[:4] != b"PK\3\4" or method != 0:
        raise ValueError("the member is broken or not stored")
    names, extras = struct.unpack_from("<HH", head, 26)
    return where + 30 + names + extras


# --- archives ------------------------------------------------------------------


class _Archive:
    def __init__(self, zip64: bool = False):
        self.records, self.index, self.at, self.zip64 = [], [], 0, zip64

    def add(self, raw: bytes, kind: str, url: str | None, digest: str) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = packer.compress(raw) + packer.flush()
        self.index.append(cdxj(url, digest, kind, self.at, len(packed)))
        self.records.append(packed)
        self.at += len(packed)

    def bytes(self) -> bytes:
        out = io.BytesIO()
        package = {"profile": "data-package", "resources": [{"path": _RECORDS}, {"path": _INDEX}]}
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as file:
            for name, parts in ((_RECORDS, self.records), (_INDEX, ["".join(f"{line}\n" for line in sorted(self.index)).encode()]), ("datapackage.json", [json.dumps(package).encode()])):
                with file.open(zipfile.ZipInfo(name), "w", force_zip64=self.zip64) as member:
                    for part in parts:
                        member.write(part)
        return out.getvalue()


def _saved(archive: _Archive, folder: str) -> str:
    uri = f"{folder}/{uuid.uuid4().hex}.wacz"
    files, path = _opened(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    with files.open_output_stream(f"{path}.part") as out:
        out.write(archive.bytes())
    files.move(f"{path}.part", path)  # a reader never sees half an archive
    return uri


def archived(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """Write the pages' records to archives in a folder; a table of the archives (path, records).

    Of equal payloads of at least `least` bytes the page with the largest id holds the payload.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    marked = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("size"))
    groups = marked.where(F.col("size") >= least).groupBy("digest").agg(F.max("id").alias("holder"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups, _ = written(groups.select("digest", "holder"), "holders")  # read back, its size is known to the planner
    told = marked.join(groups, "digest", "left").withColumn("refers_to", F.when(F.col("id").isNull() | (F.col("id") != F.col("holder")), F.col("holder")))
    told = told.select("id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", "size", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, archive = [], _Archive()
        for batch in by_size(batches, 2):
            for i, url, content, digest, size, refers in zip(*(c.to_pylist() for c in batch.columns)):
                archive.add(record(i, url, (content or "").encode(), digest, size, refers), "response" if refers is None else "revisit", url, digest)
                if archive.at >= ARCHIVE:
                    made.append((_saved(archive, folder), len(archive.index)))
                    archive = _Archive()
        if archive.index:
            made.append((_saved(archive, folder), len(archive.index)))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["path", "records"])

    return written(told.mapInArrow(run, "path string, records bigint"), "archives")[0]


def _indexed(read: Callable[[int, int], bytes], found: dict[str, tuple[int, int, int]]) -> dict[str, list[tuple[int, int]]]:
    """Of each WARC member that an index names the ranges of its records."""
    ranges: dict[str, list[tuple[int, int]]] = {}
    for name, member in found.items():
        if name.startswith("indexes/") and name.endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")):
            index = read(stored_at(read, member), member[2])
            while index:
                text, index = _gunzipped(index) if name.endswith(".gz") else (index, b"")
                for line in text.decode().splitlines():
                    if "{" in line and not line.startswith("!"):
                        entry = json.loads(line[line.index("{") :])
                        owner = next((n for n in (entry["filename"], f"archive/{entry['filename']}") if n in found), None)
                        if owner is None:
                            raise ValueError(f"the index names {entry['filename']}, which the archive lacks")
                        ranges.setdefault(owner, []).append((int(entry["offset"]), int(entry["length"])))
    return {name: sorted(set(places)) for name, places in ranges.items()}


def _gunzipped(raw: bytes) -> tuple[bytes, bytes]:
    """The first gzip member's bytes and what follows it."""
    unpacker = zlib.decompressobj(31)
    out = unpacker.decompress(raw) + unpacker.flush()
    if not unpacker.eof:
        raise ValueError("a gzip member is cut off")
    return out, unpacker.unused_data


def _scanned(read: Callable[[int, int], bytes], start: int, size: int, packed: bool) -> Iterator[bytes]:
    """All records of a WARC member from end to end, in steps of a few MB and never less than a record."""
    at, held = 0, b""
    while at < size or held:
        chunk = read(start + at, min(STEP, size - at))
        at, held = at + len(chunk), held + chunk
        while held:
            if packed:
                unpacker = zlib.decompressobj(31)
                out = unpacker.decompress(held)
                if not unpacker.eof:
                    break
                rest = unpacker.unused_data
            else:
                head, end, body = held.partition(b"\r\n\r\n")
                length = len(head) + 4 + int(_fields(head)["content-length"]) + 4 if end else len(held) + 1
                if length > len(held):
                    break
                out, rest = held[:length], held[length:]
            held = rest
            yield out
        if at >= size and held:
            raise ValueError("a record is cut off")


def _captures(read: Callable[[int, int], bytes], size: int) -> Iterator[bytes]:
    """The records of an archive, as uncompressed bytes."""
    found = members(read, size)
    ranges = _indexed(read, found)
    for name, member in found.items():
        if name.startswith("archive/") and name.endswith((".warc", ".warc.gz")):
            start, packed = stored_at(read, member), name.endswith(".gz")
            if name not in ranges:
                yield from _scanned(read, start, member[2], packed)
            for offset, length in ranges.get(name, ()):
                raw = read(start + offset, length)
                yield _gunzipped(raw)[0] if packed else raw


def archive_records(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives in a column path, read by their indexes' ranges."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_digest": pa.string(), "payload_bytes": pa.int64()}
    kinds |= {"payload": pa.binary()} if payloads else {}

    def table(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            files, name = _opened(path)
            with files.open_input_file(name) as file:
                rows, size = [], 0
                for raw in _captures(lambda at, n: file.read_at(n, at), file.size()):  # noqa: B023
                    if (row := parsed(raw)) is not None:
                        rows.append(row)
                        size += len(raw)
                    if size > STEP:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)

    names = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    tasks = min(archives.count(), 32 * shuffle_partitions(archives.sparkSession))
    return archives.select("path").repartition(max(1, tasks)).mapInArrow(run, ", ".join(f"{k} {names[t]}" for k, t in kinds.items()))


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives beside the session's work tables."""
    return f"{shared_dir(spark)}/wacz-{uuid.uuid4().hex}"


def op6_wacz(spark, sf_dir: str) -> DataFrame:
    archives = archived(spark.read.parquet(f"{sf_dir}/pages.parquet"), archive_folder(spark))
    return archive_records(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
  h AS (SELECT digest, max(page_id) AS holder, count(*) AS c FROM p WHERE n >= {LEAST} GROUP BY digest HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest, CASE WHEN holder IS NOT NULL AND page_id IS DISTINCT FROM holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM holder THEN holder END AS refers_to
FROM p LEFT JOIN h ON p.digest = h.digest
"""
