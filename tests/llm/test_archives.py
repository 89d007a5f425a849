"""WARC archives of others: cut, headless, chunked, with odd heads and digests."""

import base64
import gzip
import hashlib

import pytest

from factloom.llm import warc

BODY = b"payload " * 200


def made(block=None, head=None, digest=None, kind="response", eol=b"\r\n", content="application/http"):
    """A record of an HTTP response (or of a block) with heads as given."""
    block = eol.join([b"HTTP/1.1 200 OK", *(head or []), b"", b""]) + BODY if block is None else block
    lines = [b"WARC/1.0", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <x>", b"Content-Type: " + content.encode(), b"Content-Length: %d" % len(block)]
    if digest:
        lines.append(b"WARC-Payload-Digest: " + digest.encode())
    return eol.join([*lines, b"", b""]) + block + b"\r\n\r\n"


def read(spark, folder, data, name="a.warc", **options):
    (folder / name).write_bytes(data)
    warc.register(spark)
    reader = spark.read.format("warc")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(f"file://{folder}").collect()


def sha1(x):
    return "sha1:" + warc.digest_of(x)


CHUNKED = b"".join(b"%x;note=1\r\n%s\r\n" % (len(BODY[i : i + 700]), BODY[i : i + 700]) for i in range(0, len(BODY), 700)) + b"0\r\n\r\n"


@pytest.mark.parametrize(
    ("record", "payload", "length"),
    [
        (made(), BODY, len(BODY)),  # no HTTP Content-Length
        (made(head=[b"Content-Length: 3"]), BODY, len(BODY)),  # a wrong one
        (made(head=[b"Content-Length: 11, 11"]), BODY, len(BODY)),
        (made(head=[b"Content-Length: many"]), BODY, len(BODY)),
        (made(eol=b"\n"), BODY, len(BODY)),  # bare LF heads
        (made(head=[b"X-Long: " + b"x" * 200_000]), BODY, len(BODY)),  # an HTTP head over 64 KB
        (made(block=b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + CHUNKED), BODY, None),
        (made(block=b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz" + BODY), b"zz" + BODY, None),  # said but not so
        (made(block=b"no head at all"), b"no head at all", 14),
        (made(block=b""), b"", 0),
        (made(block=b"\x00\xff", content="application/octet-stream", kind="resource"), b"\x00\xff", 2),
    ],
)
@pytest.mark.parametrize("packing", ["plain", "gzip", "member"])
def test_payloads(spark, tmp_path, record, payload, length, packing):
    data = {"plain": record * 2, "gzip": gzip.compress(record) + gzip.compress(record), "member": warc.member(record, 1) * 2}[packing]
    name = "a.warc" if packing == "plain" else "a.warc.gz"
    whole = read(spark, tmp_path, data, name)
    assert [(bytes(r["payload"]), r["payload_length"]) for r in whole] == [(payload, len(payload))] * 2
    assert [(r["payload"], r["payload_length"]) for r in read(spark, tmp_path, data, name, payload="false")] == [(None, length)] * 2


def test_revisits(spark, tmp_path):
    data = made(block=b"HTTP/1.1 200 OK\r\nContent-Length: 77\r\n\r\n", kind="revisit") + made(block=b"HTTP/1.1 200 OK\r\nContent-Length: 1, 2\r\n\r\n", kind="revisit")
    assert [(r["payload"], r["payload_length"]) for r in read(spark, tmp_path, data)] == [(None, 77), (None, None)]


@pytest.mark.parametrize("digest", [sha1(BODY), "sha256:" + hashlib.sha256(BODY).hexdigest(), "SHA-256:" + base64.b32encode(hashlib.sha256(BODY).digest()).decode(), "md5:" + hashlib.md5(BODY).hexdigest(), "xxh:1", None])
def test_digests_are_verified(spark, tmp_path, digest):
    (row,) = read(spark, tmp_path, made(digest=digest), verify="true")
    assert row["payload_digest"] == (digest and digest.removeprefix("sha1:"))
    if digest and digest.lower()[:3] in ("sha", "md5"):
        with pytest.raises(Exception, match="differs from its headers"):
            read(spark, tmp_path, made(block=b"HTTP/1.1 200 OK\r\n\r\nother", digest=digest), verify="true")


def test_digest_of_chunks(spark, tmp_path):
    for digest in (sha1(BODY), sha1(CHUNKED)):
        data = made(block=b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + CHUNKED, digest=digest)
        assert bytes(read(spark, tmp_path, data, verify="true")[0]["payload"]) == BODY


@pytest.mark.parametrize("payload", ["true", "false"])
@pytest.mark.parametrize(
    "tail",
    [
        ("a.warc", made()[:-900]),  # cut in its block
        ("a.warc", made()[:60]),  # cut in its head
        ("a.warc", made().replace(b"Content-Length", b"X-Length")),
        ("a.warc", made().replace(b"Content-Length: ", b"Content-Length: -")),
        ("a.warc.gz", gzip.compress(made())[:-30]),
        ("a.warc.gz", warc.member(made(), 1)[:-30]),
        ("a.warc.gz", gzip.compress(made()[:-900])),
    ],
)
def test_cut_archives(spark, tmp_path, tail, payload):
    """They fail with file and place, or give what stands before."""
    name, rest = tail
    first = made() if name == "a.warc" else warc.member(made(), 1) if rest[3] == 4 else gzip.compress(made())
    with pytest.raises(Exception, match=r"a\.warc.*record 1"):
        read(spark, tmp_path, first + rest, name, payload=payload)
    got = read(spark, tmp_path, first + rest, name, payload=payload, mode="dropmalformed")
    assert [r["payload_length"] for r in got] == [len(BODY)]


def test_mode_is_known(spark, tmp_path):
    with pytest.raises(Exception, match="failfast or dropmalformed"):
        read(spark, tmp_path, made(), mode="permissive")
