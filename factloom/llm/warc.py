"""WARC archives as a Spark data source, format "warc".

Reading plans partitions from the sizes of the archive files, takes equality and IN predicates on record_type,
record_id, target_uri and payload_digest, parses a record's headers first, and goes on to the next record without
decoding the payload where a predicate fails or the payload isn't wanted. Records are written as gzip members whose
extra field SL has the member's size, so that the reader can step over them; other gzip members, of one record or of
many, are inflated as a stream, and plain archives are stepped over by Content-Length. A file is one task's.

Options of the reader: payload (default true; else the column is null), verify (default false: recompute digest and
length of response payloads and fail where they differ), partitionBytes, mode. Of the writer: date, level.

Archives of others: heads may end lines with LF alone; a payload is a response's block after its HTTP head, of any
length, or all of it without one, and is taken out of its chunks if it is chunked; payload_length is counted in the
record, not read from HTTP headers, but for revisits, which have nothing else to tell it, and is null where neither
does: for a chunked payload that isn't read, or a revisit without a usable Content-Length. Digests of md5, sha1,
sha256 and sha512 are verified, in base32 or hexadecimal, over the payload or its chunks as they stand; others
aren't. payload_digest has no prefix if it is of sha1. A record that is cut short, or whose head has no end or
no valid Content-Length, fails the query with its file and place, or with mode=dropmalformed is left out together with
what follows it in its file, which can't be told apart.

Writing stages files and renames them at commit, so a lost executor leaves no half archive that is read.

Defined cases: a null html is an empty payload; a null url has no target; a null page_id has no id header and never
answers for other records; of repeated rows with the smallest page_id of equal payloads all are responses; an empty
table writes no archive and reads back as no rows; header bytes that aren't UTF-8 are read with U+FFFD in their
place; page_id is a long, other types are cast to it; other columns are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from factloom.llm.common import Workspace, with_small

SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, payload_length long, headers map<string,string>, payload binary"
ARROW = pa.schema([(n, pa.string()) for n in ("record_type", "record_id", "target_uri", "date", "payload_digest", "refers_to")] + [("payload_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
#: Header names of the columns that predicates are pushed down on.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest"}
HEAD_BYTES = 1 << 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---------------------------------------------------------------- records


def member(content: bytes, level: int) -> bytes:
    """A gzip member with its own size and the content's in the extra field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(content) + deflate.flush()
    size = 12 + 20 + len(body) + 8
    extra = b"SL" + struct.pack("<HQQ", 16, size, len(content))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~")))
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-Id", str(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    return record(headers, http + payload if refers_to is None else http)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Malformed(ValueError):
    """An archive that can't be read as one."""


DIGESTS = {"md5": hashlib.md5, "sha1": hashlib.sha1, "sha256": hashlib.sha256, "sha512": hashlib.sha512}


def digest_fits(told: str, payloads: list[bytes]) -> bool:
    """Whether a digest (algorithm:value) is that of one of the payloads; one of another algorithm isn't looked at."""
    name, _, value = told.partition(":")
    make = DIGESTS.get(name.lower().replace("-", ""))
    if make is None:
        return True
    found = [make(x) for x in payloads]
    return value.upper().rstrip("=") in {base64.b32encode(d.digest()).decode().rstrip("=") for d in found} or value.lower() in {d.hexdigest() for d in found}


def unchunked(body: bytes) -> bytes | None:
    """The content of a chunked body; None if it isn't one that is whole."""
    out, at = [], 0
    while True:
        line = body.find(b"\n", at)
        try:
            size = int(body[at:line].split(b";")[0], 16) if line >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or line + 1 + size > len(body):
            return None
        if not size:
            return b"".join(out)
        out.append(body[line + 1 : line + 1 + size])
        at = body.find(b"\n", line + 1 + size) + 1
        if not at:
            return None


def length_of(headers: dict[str, str]) -> int | None:
    """Content-Length, of which a list of equal numbers is one; None if there is no valid one."""
    told = {x.strip() for x in headers.get("content-length", "").split(",")}
    value = told.pop()
    return int(value) if not told and value.isascii() and value.isdigit() else None


def record_length(head: bytes) -> int:
    length = length_of(fields(head))
    if length is None:
        raise Malformed("a record has no valid Content-Length")
    return length


def fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name."""
    lines = (x.partition(b":") for x in head.split(b"\n")[1:])
    return {k.decode("utf-8", "replace").strip().lower(): v.decode("utf-8", "replace").strip() for k, sep, v in lines if sep}


# ---------------------------------------------------------------- reading


class Part:
    """A record whose headers are known and whose block is read on demand."""

    def __init__(self, head: bytes, rest, length: int):
        self.headers, self.rest, self.length = fields(head), rest, length


def records(stream, size: int) -> Iterator[Part]:
    """Records of an archive file, headers first; what the caller doesn't ask for is stepped over."""
    at = 0
    while at < size:
        stream.seek(at)
        first = stream.read(min(HEAD_BYTES, size - at))
        if not first.strip(b"\r\n\0"):
            at += len(first)
            continue
        if first[:2] == b"\x1f\x8b" and not (first[3] == 4 and first[12:14] == b"SL"):
            stream.seek(at)
            yield from _inflated(stream)  # all that follows, as members of the stream
            return
        if first[:2] == b"\x1f\x8b":
            part, at = _gzip_part(stream, first, at, size)
        else:
            part, at = _plain_part(stream, first, at, size)
        yield part


def _head_end(known: bytes | bytearray, begin: int = 0) -> tuple[int, int]:
    """Where a head ends and what follows begins; -1 twice if it doesn't end."""
    ends = [(at, at + len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := known.find(mark, begin)) >= 0]
    return min(ends, default=(-1, -1))


def _split_head(known: bytes, more) -> tuple[bytes, bytes]:
    held, looked = bytearray(known), 0
    while (ends := _head_end(held, looked))[0] < 0:
        add = more()
        if not add:
            raise Malformed("a record's headers have no end")
        looked = max(0, len(held) - 3)
        held += add
    return bytes(held[: ends[0]]), bytes(held[ends[1] :])


def _plain_part(stream, first: bytes, at: int, size: int) -> tuple[Part, int]:
    skip = len(first) - len(first.lstrip(b"\r\n\0"))
    stream.seek(at + len(first))
    whole, known = first[skip:], 0

    def more() -> bytes:
        nonlocal known
        add = stream.read(HEAD_BYTES)
        known += len(add)
        return add

    head, rest = _split_head(whole, more)
    begin, length = at + len(first) + known - len(rest), record_length(head)

    def block(most: int | None = None) -> bytes:
        want = length if most is None else min(most, length)
        if len(rest) >= want:
            return rest[:want]
        stream.seek(begin)
        got = stream.read(want)
        if len(got) < want:
            raise Malformed("a record ends early")
        return got

    if begin + length > size:
        raise Malformed("a record ends early")
    return Part(head, block, length), begin + length


def _block_of(length: int, rest: bytes, read) -> tuple:
    """A block whose bytes are read on demand, and how many have been taken of it."""
    taken = bytearray(rest[:length])

    def block(most: int | None = None) -> bytes:
        want = length if most is None else min(most, length)
        while len(taken) < want:
            add = read(want - len(taken))
            if not add:
                raise Malformed("a record ends early")
            taken.extend(add)
        return bytes(taken[:want])

    return block, taken


def _gzip_part(stream, first: bytes, at: int, size: int) -> tuple[Part, int]:
    total = struct.unpack("<Q", first[16:24])[0]
    if total < 40 or at + total > size:
        raise Malformed("a record ends early")
    inflate = zlib.decompressobj(-15)
    known = inflate.decompress(first[32 : min(len(first), total - 8)], HEAD_BYTES)
    head, rest = _split_head(known, lambda: _more(inflate, stream))
    length = record_length(head)
    block, _ = _block_of(length, rest, lambda _: _more(inflate, stream))
    return Part(head, block, length), at + total


def _inflated(stream) -> Iterator[Part]:
    """Records of gzip members, read one after the other; of a block nothing is kept that isn't asked for."""
    known, plain = b"", gzip.GzipFile(fileobj=stream)  # read1 gives what there is before it meets a broken member
    while True:
        known = known.lstrip(b"\r\n\0") or plain.read1(HEAD_BYTES).lstrip(b"\r\n\0")
        if not known:
            if not plain.peek(1):
                return
            continue
        head, rest = _split_head(known, lambda: plain.read1(HEAD_BYTES))
        length = record_length(head)
        block, taken = _block_of(length, rest, plain.read1)
        yield Part(head, block, length)
        left = length - len(taken)
        known = rest[length:]
        while left > 0:
            skipped = len(plain.read1(min(left, 1 << 20)))
            if not skipped:
                raise Malformed("a record ends early")
            left -= skipped


def _more(inflate, stream) -> bytes:
    if inflate.unconsumed_tail:
        return inflate.decompress(inflate.unconsumed_tail, 1 << 20)
    chunk = stream.read(1 << 18)
    return inflate.decompress(chunk, 1 << 20) if chunk else b""


def files_of(path: str) -> tuple[fs.FileSystem, list[tuple[str, int]]]:
    system, at = fs.FileSystem.from_uri(path)
    if system.get_file_info(at).type == fs.FileType.File:
        return system, [(at, system.get_file_info(at).size)]
    found = system.get_file_info(fs.FileSelector(at, recursive=False, allow_not_found=True))
    return system, sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.endswith((".warc", ".warc.gz")))


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.most = int(options.get("partitionbytes", options.get("partitionBytes", 64 << 20)))
        self.mode = options.get("mode", "failfast").lower()
        if self.mode not in {"failfast", "dropmalformed"}:
            raise ValueError("mode is failfast or dropmalformed")
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters):  # noqa: N802  the data source API's name
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column not in HEADERS:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            name = HEADERS[column]
            if column == "payload_digest":
                values = {v if v and ":" in v else f"sha1:{v}" for v in values}
            self.wanted[name] = self.wanted[name] & values if name in self.wanted else values

    def partitions(self):
        out, held, size = [], [], 0
        for path, n in files_of(self.path)[1]:
            if held and size + n > self.most:
                out.append(Files(held))
                held, size = [], 0
            held.append((path, n))
            size += n
        return [*out, Files(held)]

    def read(self, partition: Files):
        system, _ = fs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        for path, size in partition.files:
            with system.open_input_file(path) as stream:
                for row in self.rows(path, stream, size):
                    rows.append(row)
                    held += len(row[-1] or b"") + 500
                    if held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    def rows(self, path: str, stream, size: int) -> Iterator[tuple]:
        """Rows of a file's records that are wanted; mode says what happens where it can't be read on."""
        n = 0
        try:
            for part in records(stream, size):
                if all(part.headers.get(name) in values for name, values in self.wanted.items()):
                    yield self.row(part)
                n += 1
        except (Malformed, EOFError, zlib.error, gzip.BadGzipFile, struct.error) as e:
            if self.mode == "failfast":
                raise Malformed(f"{path}, record {n}: {e}") from e

    def row(self, part: Part) -> tuple:
        h = part.headers
        kind, told = h.get("warc-type"), h.get("warc-payload-digest", "")
        http, payload, length = "http" in h.get("content-type", "") and kind in {"response", "revisit"}, None, None
        whole = self.payload or self.verify and kind == "response"
        raw = None
        if http:
            # the head may be longer than what is read at first
            most = part.length if whole else min(HEAD_BYTES, part.length)
            block = part.rest(most)
            while (ends := _head_end(block))[0] < 0 and most < part.length:
                most = min(8 * most, part.length)
                block = part.rest(most)
            head, begin = (block[: ends[0]], ends[1]) if ends[0] >= 0 else (b"", 0)
            own = fields(head)
            chunked = "chunked" in own.get("transfer-encoding", "").lower()
            if kind == "revisit":
                length = length_of(own)
            elif whole:
                raw = block[begin:]
                payload = unchunked(raw) if chunked else raw
                payload = raw if payload is None else payload
                length = len(payload)
            elif not chunked:
                length = part.length - begin
        else:
            length = part.length
            payload = raw = part.rest() if whole else None
        if self.verify and kind == "response" and not digest_fits(told, [payload, raw] if told else []):
            raise ValueError(f"payload of {h.get('warc-record-id')} differs from its headers")
        return kind, h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), told.removeprefix("sha1:") or None, h.get("warc-refers-to"), length, list(h.items()), payload if self.payload else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


# ---------------------------------------------------------------- writing


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class WarcWriter(DataSourceArrowWriter):
    """Rows (page_id long, url string, payload binary, refers_to long) as response and revisit records."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.date, self.level = options.get("date", "1970-01-01T00:00:00Z"), int(options.get("level", "3"))
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, at = fs.FileSystem.from_uri(self.path)
        staged = f"{at}/_staged-{self.run}"
        system.create_dir(staged, recursive=True)
        name, n = f"part-{uuid.uuid4().hex}.warc.gz", 0
        with system.open_output_stream(f"{staged}/{name}", compression=None) as out:
            info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None)), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            out.write(member(info, self.level))
            for batch in iterator:
                for page_id, url, payload, refers_to in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "payload", "refers_to")), strict=True):
                    payload = payload or b""
                    out.write(member(page_record(page_id, url, payload, digest_of(payload), refers_to, self.date), self.level))
                    n += 1
        return Written(name if n else None)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = fs.FileSystem.from_uri(self.path)
        if self.overwrite:
            for path, _ in files_of(self.path)[1]:
                system.delete_file(path)
        for m in messages:
            if m and m.file:
                system.move(f"{at}/_staged-{self.run}/{m.file}", f"{at}/{m.file}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, at = fs.FileSystem.from_uri(self.path)
        staged = f"{at}/_staged-{self.run}"
        if system.get_file_info(staged).type != fs.FileType.NotFound:
            system.delete_dir(staged)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with predicate pushdown."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# ---------------------------------------------------------------- pages


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """A record for each page; of equal payloads of min_bytes or more, all but the smallest page_id's are revisits."""
    spark = pages.sparkSession
    register(spark)
    work = Workspace(spark, "warc")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    firsts = known.filter(F.length("payload") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    firsts = work.table(firsts.select("sha", "first"), "firsts")  # only payloads that occur again
    joined = with_small(known, firsts, ["sha"], "left", F.lit(64))
    refers_to = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))
    joined.select("page_id", "url", "payload", refers_to.alias("refers_to")).write.format("warc").mode("append").save(path)


def warc_report(pages: DataFrame) -> DataFrame:
    """The digest of op6, read back from the archives; payloads of responses are decoded to verify them."""
    spark = pages.sparkSession
    path = f"{Workspace(spark, 'archives').path}/pages"
    write_pages(pages, path)
    found = spark.read.format("warc").option("payload", "false").option("verify", "true").load(path).filter(F.col("record_type").isin("response", "revisit"))
    return found.select(
        F.col("headers")["x-page-id"].cast("long").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.col("headers")["x-refers-to-page-id"].cast("long").alias("refers_to"),
    )
