"""Archives in ZIP files: round trips, ZIP64 directories, revisits, odd rows and damaged files."""

import hashlib
import io
import uuid
import zipfile

import pytest

from tessera.llm import archives as A
from tessera.llm.common import shared_dir

PAGES = "page_id long, url string, html string, payload_bytes int"


def packed(members, method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(A._Forward(out), "w", method) as z:
        for name, body in members:
            z.writestr(name, body)
    return out.getvalue()


def package(raw):
    return A.Package(lambda at, n: raw[at : at + n], len(raw))


def bodies(raw):
    p = package(raw)
    return {name: b"".join(p.stream(p.data_at(at), size)) for name, at, size in p.members()}


MEMBERS = [(f"archive/part-{i}.warc", bytes([65 + i % 26]) * (i * 7)) for i in range(300)] + [("indexes/é.cdxj", b"x" * 50)]


@pytest.mark.parametrize("limit", [None, 100])
def test_members_of_plain_and_zip64_directories(monkeypatch, limit):
    if limit:  # sizes, places and counts over this are written as ZIP64
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", limit)
    raw = packed(MEMBERS)
    assert (A.END64 in raw) == bool(limit)
    assert bodies(raw) == dict(MEMBERS)


def test_directory_longer_than_a_block(monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 100)
    assert bodies(packed(MEMBERS)) == dict(MEMBERS)


def test_comment_that_looks_like_an_end():
    out = io.BytesIO(packed(MEMBERS[:3]))
    with zipfile.ZipFile(out, "a") as z:
        z.comment = b"a" + A.END + b"b" * 40
    assert bodies(out.getvalue()) == dict(MEMBERS[:3])


def test_damaged_and_deflated_files_are_refused():
    raw = packed(MEMBERS)
    with pytest.raises(ValueError, match="cut short"):
        bodies(raw[:-30])
    with pytest.raises(ValueError, match="deflated"):
        bodies(packed([("archive/a", b"a" * 1000)], zipfile.ZIP_DEFLATED))
    one = A.record("1", "http://a/", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    with pytest.raises(ValueError, match="cut short"):
        list(A.records(iter([one[:-20]])))
    head, block = next(A.records(iter([one])))
    with pytest.raises(ValueError, match="not what"):
        A.parsed(head, block[:-1] + b"X")


def test_records_in_small_blocks_and_without_an_index():
    rows = [(f"k {i}", f"http://x/{i}", b"\r\n\r\nWARC/1.1\r\n" * i, None) for i in range(5)] + [("k 5", None, b"", "k 0")]
    raw = b"".join(A.record(k, u, b, hashlib.sha256(b).hexdigest(), r) for k, u, b, r in rows)
    got = [A.parsed(*x) for x in A.records(raw[i : i + 3] for i in range(0, len(raw), 3))]
    assert [(g[0], g[3], g[4], g[6]) for g in got] == [(k, r, len(b), b if r is None else None) for k, _, b, r in rows]
    for name in ("archive/a.warc", "archive/b.warc.gz"):
        body = raw if name.endswith("c") else b"".join(map(gz, [raw[:50], raw[50:]]))
        p = package(packed([(name, body), ("datapackage.json", b"{}")]))
        ((at, size, zipped),) = A.slices(p)
        blocks = p.stream(at, size)
        assert [A.parsed(*x) for x in A.records(A._unpacked(blocks) if zipped else blocks)] == got


def gz(b):
    import gzip

    return gzip.compress(b)


def expected(rows):
    """By brute force: payload, digest, type and target of each row."""
    first = {}
    for i, _, h, _ in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, _, h, _ in rows:
        body, other = (h or "").encode(), first.get(h)
        other = None if other is None or other == i else other
        out.append((i, body, hashlib.sha256(body).hexdigest(), "response" if other is None else "revisit", other))
    return out


@pytest.mark.parametrize("roll", [A.ROLL, 2000])
def test_odd_rows_and_copies_come_back(spark, roll):
    same = "é" * 60
    rows = [(9, "http://a/?q=1 2\r\nX: y", same, 1), (3, "http://b/ü", same, 2), (4, None, same, 3), (5, "", None, 4), (6, "u", "", 5), (7, "u", "short", 6), (8, "u", "short", 7)]
    rows += [(None, "u", same, 8), (None, "u", "alone " * 50, 9), (10, "u", "long text " * 200_000, 10), (3, "http://b/ü", same, 2), (11, "u", "x" * 99, 0), (12, "u", "x" * 99, 0), (13, "u", "y" * 100, 0), (14, "u", "y" * 100, 0)]
    rows += [(i, "u", "copy of a third of the rows " * 5, 0) for i in range(100, 160)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    manifest = A.write_archives(pages, f"{shared_dir(spark)}/a-{uuid.uuid4().hex}", roll=roll)
    assert (manifest.count() > 3) == (roll < A.ROLL) and manifest.agg({"records": "sum"}).first()[0] == len(rows)
    got = A.read_archives(manifest, payload=True, slice_bytes=5000).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    want = sorted(expected(rows), key=key)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=key) == [(i, len(b), d, t, o) for i, b, d, t, o in want]
    assert {r.page_id: bytes(r.payload) for r in got if r.record_type == "response" and r.page_id} == {i: b for i, b, _, t, _ in want if t == "response" and i}
    assert {r.url for r in got if r.page_id in (4, 5, 3, 9)} == {"urn:page:4", "urn:page:5", "http://b/%C3%BC", "http://a/?q=1%202%0D%0AX:%20y"}


def test_text_keys_and_an_empty_table(spark):
    folder = f"{shared_dir(spark)}/a-{uuid.uuid4().hex}"
    pages = spark.createDataFrame([("a b>", "u", "z" * 200), ("é", "u", "z" * 200), ("", "u", "q")], "id string, link string, body string")
    got = A.read_archives(A.write_archives(pages, folder, "id", "link", "body"), "id", "string").collect()
    assert {(r.id, r.record_type, r.refers_to) for r in got} == {("a b>", "response", None), ("é", "revisit", "a b>"), ("", "response", None)}
    none = A.write_archives(pages.limit(0), folder, "id", "link", "body")
    assert none.count() == 0 and A.read_archives(none, "id", "string").count() == 0
