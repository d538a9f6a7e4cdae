"""WARC archives packaged in ZIP files: writer, and a reader that never extracts.

An archive is a ZIP file of stored (uncompressed) members: ``archive/*.warc.gz``, one gzip member per record after a
warcinfo record, and ``indexes/index.cdx``, sorted CDXJ lines with each record's offset and length.  The reader takes
packages of any writer: it parses the end record and the central directory, with their ZIP64 forms, finds the members'
data through the local headers, and takes every stored ``archive/*.warc`` or ``archive/*.warc.gz``.  Records are located
by the CDXJ or CDX lines below ``indexes/`` (plain or gzip); a member that no index names is walked record by record in
bounded reads.  Runs of neighbouring records become blocks, and each block is range-read where it lies.

Both sides run in Spark tasks and reach the files through pyarrow's filesystems, so any store that pyarrow
opens will do.  A task writes under a name of its own and renames when done; the manifest table names the
files that count, so a repeated task leaves at most an unused file.

Payloads: null counts as empty.  Of equal payloads of at least ``MIN_REVISIT`` bytes the record of the smallest id (of
equal ids the smallest url, null first) is a response and the others are revisits of it, with headers but no payload;
rows equal in id, url and payload cannot be told apart, so all of them are responses.  Rows with a null id are written
and read back with a null id.  Lengths and digests of responses are computed from the payload that was read, and a
payload that differs from a SHA-256 in its header is an error; those of revisits come from the header.  A record is
held in memory whole, so the largest page bounds a task.  Empty tables write nothing; further columns take no part and
may have any name.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import shared_dir, written

MIN_REVISIT, ARCHIVE_BYTES, BLOCK, BLOCK_BYTES, READ = 100, 64 << 20, 400, 8 << 20, 1 << 20
KINDS = ("response", "revisit", "resource")
COLUMNS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
LOCAL, CENTRAL, END, LOCATOR64, END64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06"


def open_store(uri: str):
    """(filesystem, path) of a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri else "file://" + uri)


# -- records ---------------------------------------------------------------------------------------------


def safe_uri(url: str | None) -> str:
    """The url without control characters and blanks."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def gzipped(kind: str, name: str, date: str, fields: list[str], block: bytes) -> bytes:
    """One gzip member with one record; its id is made of ``name``."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {date}", *fields, f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def info_bytes(name: str, date: str) -> bytes:
    return gzipped("warcinfo", name, date, [f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n")


def record_bytes(name: str, date: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone; page ids travel in fields of their own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [f"WARC-Target-URI: {safe_uri(url)}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        fields.append(f"Page-ID: {page_id}")
    if refers_to is None:
        return gzipped("response", name, date, fields, http + payload)
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    fields += [f"WARC-Profile: {profile}", f"WARC-Refers-To-Target-URI: {safe_uri(refers_url)}", f"WARC-Refers-To-Date: {date}", f"Refers-To-Page-ID: {refers_to}"]
    return gzipped("revisit", name, date, fields, http)


def headers(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and what follows the empty line."""
    head, _, rest = data.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}, rest


def named_digest(value: str) -> str | None:
    """Lower-case hex of a SHA-256 field in hex or base 32; null for other digests."""
    kind, _, text = value.partition(":")
    if kind.lower().replace("-", "") != "sha256":
        return None
    return text.lower() if len(text) == 64 else base64.b32decode(text.upper() + "=" * (-len(text) % 8)).hex()


def parse_record(data: bytes) -> tuple | None:
    """A row of COLUMNS from the bytes of one record; None for kinds that hold no page."""
    warc, rest = headers(data)
    kind = warc.get("warc-type")
    if kind not in KINDS:
        return None
    block = rest[: int(warc["content-length"])]
    http, payload = headers(block) if warc.get("content-type", "").startswith("application/http") else ({}, block)
    told = named_digest(warc.get("warc-payload-digest", ""))
    number = lambda x: int(x) if x else None
    if kind == "revisit":
        return number(warc.get("page-id")), number(http.get("content-length")), told, kind, number(warc.get("refers-to-page-id")), warc.get("warc-target-uri"), None
    digest = hashlib.sha256(payload).hexdigest()
    if told not in (None, digest):
        raise ValueError(f"payload of {warc.get('warc-record-id')} has another digest than its header names")
    return number(warc.get("page-id")), len(payload), digest, "response", None, warc.get("warc-target-uri"), payload


# -- indexes ---------------------------------------------------------------------------------------------


def cdx_line(url: str | None, date: str, kind: str, digest: str, offset: int, length: int, filename: str) -> str:
    """A CDXJ line; the key is the url."""
    more = {"url": safe_uri(url), "mime": "warc/revisit" if kind == "revisit" else "text/html", "status": "200", "digest": f"sha256:{digest}", "offset": str(offset), "length": str(length), "filename": filename}
    return f"{safe_uri(url) or '-'} {re.sub(r'[^0-9]', '', date)[:14]} {json.dumps(more)}\n"


def index_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """(file name, offset, length) of CDXJ lines, or of CDX lines by the letters of their heading."""
    letters: list[str] = []
    for line in text.splitlines():
        if line.lstrip().startswith("CDX "):
            letters = line.split()[1:]
        elif "{" in line:
            more = json.loads(line[line.index("{") :])
            yield more["filename"], int(more["offset"]), int(more["length"])
        elif letters and line.strip():
            row = dict(zip(letters, line.split(), strict=False))
            yield row["g"], int(row["V"]), int(row["S"])


def gzip_spans(file, at: int, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of every gzip member of a file's part, by inflating it in bounded reads."""
    start = end = 0
    while end < size:
        z, start = zlib.decompressobj(31), end
        while not z.eof:
            data = z.unconsumed_tail or read_at(file, at + end, min(READ, size - end))
            if not data:
                raise ValueError("a gzip member is cut off")
            z.decompress(data, READ)
            end += len(data) - len(z.unconsumed_tail) - len(z.unused_data)
        yield start, end - start


def plain_spans(file, at: int, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of every record of an uncompressed part, from record header to record header."""
    start = 0
    while start < size:
        head = b""
        while b"\r\n\r\n" not in head:
            more = read_at(file, at + start + len(head), min(4096, size - start - len(head)))
            if not more:
                raise ValueError("a record header is cut off")
            head += more
        length = head.index(b"\r\n\r\n") + 4 + int(headers(head)[0]["content-length"]) + 4
        yield start, length
        start += length


# -- ZIP packages ----------------------------------------------------------------------------------------


class ZipWriter:
    """Stored members, written once from front to back; ZIP64 fields wherever a value needs them."""

    def __init__(self, out):
        self.out, self.at, self.entries = out, 0, []

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, chunks: list[bytes]) -> None:
        raw, size, crc, offset = name.encode(), sum(map(len, chunks)), 0, self.at
        for c in chunks:
            crc = zlib.crc32(c, crc)
        extra = struct.pack("<HHQQ", 1, 16, size, size) if size >= 0xFFFFFFFF else b""
        shown = min(size, 0xFFFFFFFF)
        self.put(struct.pack("<4sHHHHHIIIHH", LOCAL, 45 if extra else 20, 0x800, 0, 0, 33, crc, shown, shown, len(raw), len(extra)) + raw + extra)
        for c in chunks:
            self.put(c)
        self.entries.append((raw, crc, size, offset))

    def close(self, zip64: bool = False) -> None:
        """zip64: write the ZIP64 end records even if no value needs them."""
        start = self.at
        for raw, crc, size, offset in self.entries:
            big = ([size, size] if size >= 0xFFFFFFFF else []) + ([offset] if offset >= 0xFFFFFFFF or zip64 else [])
            extra = struct.pack(f"<HH{len(big)}Q", 1, 8 * len(big), *big) if big else b""
            shown, place = min(size, 0xFFFFFFFF), 0xFFFFFFFF if offset >= 0xFFFFFFFF or zip64 else offset
            self.put(struct.pack("<4sHHHHHHIIIHHHHHII", CENTRAL, 45, 45 if extra else 20, 0x800, 0, 0, 33, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, place) + raw + extra)
        size, n = self.at - start, len(self.entries)
        if zip64 or n >= 0xFFFF or start >= 0xFFFFFFFF or size >= 0xFFFFFFFF:
            end = self.at
            self.put(struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start))
            self.put(struct.pack("<4sIQI", LOCATOR64, 0, end, 1))
            n, size, start = 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF
        self.put(struct.pack("<4sHHHHIIH", END, 0, 0, n, n, size, start, 0))


def read_at(file, offset: int, length: int) -> bytes:
    file.seek(offset)
    return file.read(length)


def zip_members(file, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (compression method, offset of the data, stored size), from the central directory."""
    tail_at = max(0, size - 65_557)
    tail = read_at(file, tail_at, size - tail_at)
    found = tail.rfind(END)
    while found >= 0 and found + 22 + struct.unpack_from("<H", tail, found + 20)[0] != len(tail):
        found = tail.rfind(END, 0, found)
    if found < 0:
        raise ValueError("no end record of a ZIP file")
    n, length, start = struct.unpack_from("<HII", tail, found + 10)
    if n == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        signature, _, end64, _ = struct.unpack("<4sIQI", read_at(file, tail_at + found - 20, 20))
        if signature == LOCATOR64:
            n, length, start = struct.unpack_from("<QQQ", read_at(file, end64, 56), 32)
    directory, at, members = read_at(file, start, length), 0, {}
    for _ in range(n):
        method = struct.unpack_from("<H", directory, at + 10)[0]
        stored, full = struct.unpack_from("<II", directory, at + 20)
        names, extras, comment = struct.unpack_from("<HHH", directory, at + 28)
        offset = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + names].decode("utf-8", "replace")
        extra, p = directory[at + 46 + names : at + 46 + names + extras], 0
        while p + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, p)
            if kind == 1:  # ZIP64 holds, in this order, what the entry could not
                wide = list(struct.unpack_from(f"<{width // 8}Q", extra, p + 4))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                stored = wide.pop(0) if stored == 0xFFFFFFFF else stored
                offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
            p += 4 + width
        local = read_at(file, offset, 30)
        names_here, extras_here = struct.unpack_from("<HH", local, 26)
        members[name] = (method, offset + 30 + names_here + extras_here, stored)
        at += 46 + names + extras + comment
    return members


# -- Spark jobs ------------------------------------------------------------------------------------------


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes every row as a record below ``folder``; returns the manifest (path, bytes, records)."""
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("body")).withColumns({"digest": F.sha2("body", 256), "bytes": F.length("body")})
    light = written(rows.where((F.col("bytes") >= MIN_REVISIT) & F.col("page_id").isNotNull()).select("digest", F.struct("page_id", "url").alias("own")), "digests")
    again = written(rows.where((F.col("bytes") >= MIN_REVISIT) & F.col("page_id").isNull()).select("digest"), "digests-unnamed")
    counts = light.groupBy("digest").agg(F.min("own").alias("first"), F.count("*").alias("n")).join(again.groupBy("digest").agg(F.count("*").alias("m")).hint("merge"), "digest", "left")
    firsts = written(counts.where("n + coalesce(m, 0) > 1").select("digest", "first"), "firsts").hint("merge")
    rows = rows.join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("bytes") >= MIN_REVISIT) & ~F.struct("page_id", "url").eqNullSafe(F.col("first"))
    rows = rows.select("page_id", "url", "body", "digest", F.when(revisit, F.col("first.page_id")).alias("refers"), F.when(revisit, F.col("first.url")).alias("refers_url"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        some = lambda x: None if pd.isna(x) else x

        def fresh():
            name = uuid.uuid4().hex
            info = info_bytes(f"{name}.warc.gz", date)
            return name, [info], [], len(info)

        def flush():
            with store.open_output_stream(f"{base}/.{name}.wacz") as out:
                z = ZipWriter(out)
                z.member(f"archive/{name}.warc.gz", chunks)
                z.member("indexes/index.cdx", ["".join(sorted(index)).encode()])
                z.close()
            store.move(f"{base}/.{name}.wacz", f"{base}/{name}.wacz")
            return pd.DataFrame({"path": [f"{folder}/{name}.wacz"], "bytes": [z.at], "records": [len(index)]})

        name, chunks, index, size = fresh()
        for pdf in batches:
            for page_id, link, data, digest, refer, target in zip(pdf["page_id"], pdf["url"], pdf["body"], pdf["digest"], pdf["refers"], pdf["refers_url"], strict=True):
                link, refer = some(link), some(refer)
                rec = record_bytes(f"{name}:{size}", date, None if pd.isna(page_id) else int(page_id), link, data, digest, None if refer is None else int(refer), some(target))
                index.append(cdx_line(link, date, "response" if refer is None else "revisit", digest, size, len(rec), f"{name}.warc.gz"))
                chunks.append(rec)
                size += len(rec)
                if size >= archive_bytes:
                    yield flush()
                    name, chunks, index, size = fresh()
        if index:
            yield flush()

    return written(rows.mapInPandas(write, "path string, bytes long, records long"), "manifest")


def package_blocks(path: str) -> Iterator[tuple[str, int, bool, list[int]]]:
    """(path, offset, whether gzip, lengths) of runs of neighbouring records of one package."""
    store, name = open_store(path)
    with store.open_input_file(name) as f:
        members, indexed = zip_members(f, f.size()), {}
        for member, (method, at, length) in members.items():
            if member.startswith("indexes/") and re.search(r"\.cdxj?(\.gz)?$", member):
                data = read_at(f, at, length)
                data = zlib.decompress(data, -15) if method == 8 else data
                for file, offset, n in index_spans((gzip.decompress(data) if member.endswith(".gz") else data).decode("utf-8", "replace")):
                    indexed.setdefault(file.rsplit("/", 1)[-1], set()).add((offset, n))
        for member, (method, at, length) in members.items():
            if not re.match(r"archive/.+\.warc(\.gz)?$", member):
                continue
            if method:
                raise ValueError(f"{path}: {member} must be stored, not compressed")
            zipped = member.endswith(".gz")
            spans = sorted(indexed.get(member.rsplit("/", 1)[-1], ())) or (gzip_spans if zipped else plain_spans)(f, at, length)
            first, lengths, next_at = 0, [], -1
            for offset, n in spans:
                if lengths and (offset != next_at or len(lengths) >= BLOCK or sum(lengths) >= BLOCK_BYTES):
                    yield path, at + first, zipped, lengths
                    lengths = []
                if not lengths:
                    first = offset
                lengths.append(n)
                next_at = offset + n
            if lengths:
                yield path, at + first, zipped, lengths


def read_archives(manifest: DataFrame, partitions: int | None = None) -> DataFrame:
    """Every record with a page in the archives listed in column ``path``, as COLUMNS."""

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                yield pd.DataFrame(list(package_blocks(path)), columns=["path", "at", "zipped", "lengths"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for pdf in batches:
            for path, at, zipped, lengths in zip(pdf["path"], pdf["at"], pdf["zipped"], pdf["lengths"], strict=True):
                store, name = open_store(path)
                with store.open_input_file(name) as f:
                    data = read_at(f, int(at), int(sum(lengths)))
                rows, p = [], 0
                for n in map(int, lengths):
                    rows.append(parse_record(gzip.decompress(data[p : p + n]) if zipped else data[p : p + n]))
                    p += n
                out = pd.DataFrame([r for r in rows if r], columns=names)
                yield out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    n = partitions or int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = written(manifest.select("path").repartition(n, "path").mapInPandas(plan, "path string, at long, zipped boolean, lengths array<long>"), "blocks")
    return blocks.repartition(n, "path", "at").mapInPandas(read, COLUMNS)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back."""
    return read_archives(write_archives(pages, shared_dir(pages.sparkSession, "archives"), key, url, html))
