"""Web archives packaged in ZIP files: written by tasks, read again record by record without extraction.

Writing: each task puts its rows, one gzip member a record, into ``archive/data.warc.gz`` of a ZIP file, with
``indexes/index.cdxj`` beside it; both members are stored, not deflated, so that a place in a member is a place in the
file. A file is closed at ROLL bytes or MOST records. Of rows with equal payloads of ``least`` bytes or more, the one of
the smallest key is a response and the others revisit it. A task names its files anew each time it runs; the manifest
goes through Spark's own commit, so files of tasks that were lost or ran twice are in no manifest and are never read.

Reading: (1) of each file the tail is read for the end of the central directory, or the ZIP64 one that its locator names,
then the directory itself in blocks, ZIP64 sizes included; (2) the index members are range-read, and their records
grouped into slices of SLICE bytes; an archive member that no index covers is one slice; (3) slices are dealt to tasks,
each of which range-reads its slice and parses one record after another. Memory is bounded by one record and, of an
index, one line and the places of its file's records.

Files are opened by the URI of their folder through pyarrow.fs (local and shared folders, HDFS, object stores).

Nulls and edges: a null payload is empty; a null key is kept, comes after every other and reads back as null; rows equal
in key and payload are all responses if theirs is the smallest key; a null URL is written as the record's id; characters
of a URL other than ASCII letters, digits and marks are percent-encoded; a long payload takes some three times its bytes
of memory; an empty table gives no files and no records; further columns are not archived. A payload that isn't the
length or digest that its record states, a member that is deflated or encrypted, or a directory cut short raises an error.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_or_shuffled, staged

#: Bytes and records of a file, after which the next one begins; bytes of a slice; bytes read at once.
ROLL, MOST, SLICE, BLOCK = 256 << 20, 200_000, 8 << 20, 1 << 20
#: Payloads from this length on are written once.
LEAST = 100
#: Rows of repeated payloads that are broadcast at most (a digest of 64 characters and a key: some 30 MB).
REPEATED = 200_000
#: Fixed values of the formats.
WARC, DATE = "WARC/1.1", "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, END64, LOCATOR64, ENTRY = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2"
LOCAL, FULL16, FULL32 = b"PK\3\4", 0xFFFF, 0xFFFFFFFF
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
MANIFEST = "path string, records bigint, bytes bigint"
RECORDS = "k string, url string, record_type string, r string, payload_bytes bigint, payload_digest string"
ID, NULL_ID = "<urn:page:", "<urn:null>"
URL_MARKS = "!#$&'()*+,/:;=?@[]~%"


def _id(key: str | None) -> str:
    return NULL_ID if key is None else f"{ID}{quote(key, safe='')}>"


def _key(record_id: str | None) -> str | None:
    return unquote(record_id[len(ID) : -1]) if record_id and record_id.startswith(ID) else None


def record(key: str | None, url: str | None, payload: bytes, digest: str, first: str | None) -> bytes:
    """One record: a response, or, where ``first`` is given, a revisit of that key's response."""
    target = quote(url, safe=URL_MARKS) if url else _id(key)[1:-1]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    head = {"WARC-Type": "response" if first is None else "revisit", "WARC-Record-ID": _id(key), "WARC-Date": DATE, "WARC-Target-URI": target, "WARC-Payload-Digest": f"sha256:{digest}"}
    if first is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _id(first)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return "".join([WARC, "\r\n", *(f"{k}: {v}\r\n" for k, v in head.items()), "\r\n"]).encode() + block + b"\r\n\r\n"


class _Forward:
    """A stream that can only be written on: zipfile then puts sizes behind the data and never goes back."""

    def __init__(self, stream):
        self.write, self.flush = stream.write, stream.flush


def _write(folder: str, roll: int, most: int) -> Callable:
    def archive(rows: Iterator[tuple]) -> Iterator[tuple[str, int, int]]:
        fs, root = pafs.FileSystem.from_uri(folder)
        row = next(rows, None)
        while row is not None:
            name, lines, at = f"{uuid.uuid4().hex}.wacz", [], 0
            with fs.open_output_stream(f"{root}/{name}") as stream:
                with zipfile.ZipFile(_Forward(stream), "w", zipfile.ZIP_STORED) as z:
                    with z.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True) as member:
                        while row is not None and at < roll and len(lines) < most:
                            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                            raw = packer.compress(record(*row)) + packer.flush()
                            member.write(raw)
                            about = {"offset": at, "length": len(raw), "digest": f"sha256:{row[3]}", "filename": ARCHIVE}
                            lines.append(f"{_id(row[0])[1:-1]} {DATE} {json.dumps(about)}\n")
                            at += len(raw)
                            row = next(rows, None)
                    with z.open(zipfile.ZipInfo(INDEX), "w") as member:
                        for line in sorted(lines):
                            member.write(line.encode())
                size = stream.tell()
            yield f"{folder}/{name}", len(lines), size

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(c.as_py() for c in cells) for part in parts for cells in zip(*part.columns))
        for file in archive(rows):
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in file], ["path", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, roll: int = ROLL, most: int = MOST) -> DataFrame:
    """Write a record of each row into files in ``folder`` (a URI that all executors reach); their manifest (path, records,
    bytes), written."""
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{key}`").alias("k"), F.col(f"`{url}`").cast("string").alias("u"), body.alias("b"), F.sha2(body, 256).alias("d"))
    long = rows.where((F.octet_length("b") >= least) & F.col("k").isNotNull())
    firsts = staged(long.groupBy("d").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    # only digests that occur twice are joined; a payload of a third of all rows is one row there
    marked = rows.join(small_or_shuffled(firsts, firsts.count(), REPEATED), "d", "left")
    other = F.when(F.col("k").eqNullSafe(F.col("first")), None).otherwise(F.col("first").cast("string"))
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    return staged(marked.select(F.col("k").cast("string").alias("k"), "u", "b", "d", other.alias("r")).mapInArrow(_write(folder, roll, most), MANIFEST))


class Package:
    """The members of a ZIP file, by range reads."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        """read(at, n) gives the ``n`` bytes at ``at``."""
        self.read, self.size = read, size

    def _directory(self) -> tuple[int, int]:
        """Where the central directory begins, and its bytes."""
        tail_at = max(0, self.size - 22 - FULL16)
        tail = self.read(tail_at, self.size - tail_at)
        i = tail.rfind(END)
        while i >= 0 and (len(tail) - i < 22 or i + 22 + struct.unpack_from("<H", tail, i + 20)[0] != len(tail)):
            i = tail.rfind(END, 0, i)
        if i < 0:
            raise ValueError("no end of a central directory: not a ZIP file, or cut short")
        count, size, start = struct.unpack_from("<HII", tail, i + 10)
        at = tail_at + i
        if at >= 20 and (count == FULL16 or FULL32 in (size, start)):
            mark, _, place = struct.unpack_from("<4sIQ", self.read(at - 20, 20))
            if mark == LOCATOR64:
                end = self.read(place, 56)
                if end[:4] != END64:
                    raise ValueError("the ZIP64 locator names no ZIP64 end of directory")
                size, start = struct.unpack_from("<QQ", end, 40)
        return start, size

    def members(self) -> Iterator[tuple[str, int, int]]:
        """(name, place of its local header, bytes) of each member; the directory is read in blocks."""
        at, left = self._directory()
        held, end = b"", at + left

        def need(n: int) -> None:
            nonlocal held, at
            while len(held) < n:
                if at >= end:
                    raise ValueError("the central directory is cut short")
                more = self.read(at, min(BLOCK, end - at))
                at, held = at + len(more), held + more

        while held or at < end:
            need(46)
            if held[:4] != ENTRY:
                break  # a digital signature may follow the entries
            flags, method = struct.unpack_from("<HH", held, 8)
            packed, size, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", held, 20)
            (place,) = struct.unpack_from("<I", held, 42)
            need(46 + n_name + n_extra + n_note)
            name = held[46 : 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            size, packed, place = self._wide(held[46 + n_name : 46 + n_name + n_extra], size, packed, place)
            held = held[46 + n_name + n_extra + n_note :]
            if name.endswith("/"):
                continue
            if method or flags & 1 or size != packed:
                raise ValueError(f"{name} is deflated or encrypted: only stored members can be read in ranges")
            yield name, place, size

    @staticmethod
    def _wide(extra: bytes, size: int, packed: int, place: int) -> tuple[int, int, int]:
        """The three numbers with those that don't fit 32 bits from the ZIP64 field, where they stand in this order."""
        i = 0
        while i + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, i)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, i + 4))
                return tuple(next(wide) if v == FULL32 else v for v in (size, packed, place))
            i += 4 + n
        return size, packed, place

    def data_at(self, place: int) -> int:
        """Where the bytes of the member begin whose local header is at ``place``."""
        head = self.read(place, 30)
        if head[:4] != LOCAL:
            raise ValueError("no local header where the directory says")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return place + 30 + n_name + n_extra

    def stream(self, at: int, size: int) -> Iterator[bytes]:
        for i in range(at, at + size, BLOCK):
            yield self.read(i, min(BLOCK, at + size - i))


def _lines(blocks: Iterator[bytes]) -> Iterator[bytes]:
    rest = b""
    for block in blocks:
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


def slices(package: Package, most: int = SLICE) -> Iterator[tuple[int, int, bool]]:
    """(place in the file, bytes, gzipped) of runs of neighbouring records of ``most`` bytes, or one larger record."""
    members = {name: (package.data_at(place), size) for name, place, size in package.members() if name.startswith(("archive/", "indexes/"))}
    places: dict[str, list[tuple[int, int]]] = {name: [] for name in members if name.startswith("archive/")}
    for name, (at, size) in members.items():
        for line in _lines(package.stream(at, size)) if name.startswith("indexes/") else ():
            if b"{" in line:
                about = json.loads(line[line.index(b"{") :])
                of = about["filename"] if about["filename"] in places else f"archive/{about['filename']}"
                places[of].append((int(about["offset"]), int(about["length"])))
    for name, found in places.items():
        at, size = members[name]
        packed, run = name.endswith(".gz"), None
        for offset, length in sorted(set(found)) or [(0, size)]:
            if run and offset == run[0] + run[1] and run[1] + length <= most:
                run = (run[0], run[1] + length)
                continue
            if run:
                yield at + run[0], run[1], packed
            run = (offset, length)
        if run and run[1]:
            yield at + run[0], run[1], packed


def _unpacked(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of gzip members one after another."""
    unpack = None
    for block in blocks:
        while block:
            unpack = unpack or zlib.decompressobj(31)
            yield unpack.decompress(block)
            block = unpack.unused_data
            unpack = None if unpack.eof else unpack
    if unpack:
        raise ValueError("a record is cut short")


def records(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a stream, with names of headers in lower case."""
    held = bytearray()

    def more() -> bool:
        block = next(blocks, None)
        if block is not None:
            held.extend(block)
        return block is not None

    while True:
        while (i := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if i < 0:
            if held.strip():
                raise ValueError("a record is cut short")
            return
        mark, *lines = held[:i].decode().lstrip("\r\n").split("\r\n")
        if not mark.startswith("WARC/"):
            raise ValueError("a record does not begin as one")
        head = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
        end = i + 4 + int(head["content-length"])
        while len(held) < end + 4 and more():
            pass
        if len(held) < end:
            raise ValueError("a record is cut short")
        yield head, bytes(memoryview(held)[i + 4 : end])
        del held[: end + 4]


def parsed(head: dict[str, str], block: bytes) -> tuple:
    """RECORDS' fields and the payload (None for a revisit) of a response or revisit; what it states is checked."""
    http, _, body = block.partition(b"\r\n\r\n")
    stated = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in http.decode("latin-1").split("\r\n")[1:])}
    kind, size, digest = head["warc-type"], int(stated["content-length"]), head["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
        raise ValueError(f"{head['warc-record-id']}: the payload is not what the record states")
    return _key(head["warc-record-id"]), head["warc-target-uri"], kind, _key(head.get("warc-refers-to")), size, digest, body if kind == "response" else None


def _opened(path: str):
    fs, name = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


def _reader(f) -> Callable[[int, int], bytes]:
    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    return read


def _sliced(most: int) -> Callable:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (x for part in parts for x in part.column(0).to_pylist()):
            with _opened(path) as f:
                rows = [(path, *s) for s in slices(Package(_reader(f), f.size()), most)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, (pa.string(), pa.int64(), pa.int64(), pa.bool_()))], ["path", "at", "size", "packed"])

    return run


def _read(with_payload: bool) -> Callable:
    names = [f.split()[0] for f in RECORDS.split(", ")] + ["payload"] * with_payload
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for part in parts:
            for path, at, size, packed in zip(*(c.to_pylist() for c in part.columns)):
                with _opened(path) as f:
                    blocks = Package(_reader(f), f.size()).stream(at, size)
                    for head, block in records(_unpacked(blocks) if packed else blocks):
                        if head["warc-type"] in ("response", "revisit"):
                            out.append(parsed(head, block)[: len(names)])
                            held += len(block) if with_payload else 256
                        if held > SLICE:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                            out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return run


def read_archives(manifest: DataFrame, key: str = "page_id", kind: str = "bigint", payload: bool = False, slice_bytes: int = SLICE) -> DataFrame:
    """(key, url, record_type, refers_to, payload_bytes, payload_digest[, payload]) of each response and revisit in the files
    of ``manifest`` (path); of a revisit, the bytes and digest are those that it states of the full payload."""
    files = manifest.count()
    tasks = manifest.sparkSession.sparkContext.defaultParallelism
    places = staged(manifest.select("path").repartition(max(1, min(files, 8 * tasks)), "path").mapInArrow(_sliced(slice_bytes), "path string, at bigint, size bigint, packed boolean"))
    n = places.count()
    schema = RECORDS + (", payload binary" if payload else "")
    out = places.repartition(max(1, min(n, 64 * tasks)), "path", "at").mapInArrow(_read(payload), schema)
    rest = ["payload_bytes", "payload_digest"] + ["payload"] * payload
    return out.select(F.col("k").cast(kind).alias(key), "url", "record_type", F.col("r").cast(kind).alias("refers_to"), *rest)


#: Whole pages, production parameters.
SQL = """
with p as (select page_id, coalesce(strlen(html), 0)::bigint as n, sha256(coalesce(html, '')) as d from pages),
q as (select *, case when n >= 100 then min(page_id) over (partition by d) else page_id end as first from p)
select page_id, n as payload_bytes, d as payload_digest, case when first = page_id then 'response' else 'revisit' end as record_type,
       case when first <> page_id then first end as refers_to
from q
"""
