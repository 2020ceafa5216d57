from __future__ import annotations

import base64
import hashlib
import io
import zipfile

import pytest

from pricelens.llm import wacz
from tests.conftest import local_frame

DDL = "page_id long, url string, html string, digest string"


def reader(data: bytes):
    return lambda offset, size: data[offset : offset + size]


def test_directory_of_a_plain_archive():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as out:
        out.writestr("a.txt", b"alpha")
        out.writestr("dir/é.txt", b"beta", zipfile.ZIP_DEFLATED)
        out.comment = b"PK not the end"
    data = buffer.getvalue()
    members = wacz.read_directory(reader(data), len(data))
    assert [m.name for m in members] == ["a.txt", "dir/é.txt"]
    start = wacz.member_start(reader(data), members[0])
    assert data[start : start + members[0].size] == b"alpha"
    with pytest.raises(ValueError, match="compressed"):
        wacz.member_start(reader(data), members[1])
    with pytest.raises(ValueError, match="no end"):
        wacz.read_directory(reader(b"not a zip"), 9)


def test_zip64_directory_with_many_members():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as out:
        for i in range(66_000):  # more than a 16-bit count holds
            out.writestr(f"{i}", b"x%d" % i)
    data = buffer.getvalue()
    members = wacz.read_directory(reader(data), len(data))
    assert len(members) == 66_000
    start = wacz.member_start(reader(data), members[-1])
    assert data[start : start + members[-1].size] == b"x65999"


def test_zip64_extra_field(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)  # sizes and offsets go to the extra field
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as out:
        out.writestr("first", b"a" * 50)
        out.writestr("second", b"b" * 40)
    data = buffer.getvalue()
    members = wacz.read_directory(reader(data), len(data))
    for member, want in zip(members, (b"a" * 50, b"b" * 40), strict=True):
        start = wacz.member_start(reader(data), member)
        assert data[start : start + member.size] == want


@pytest.mark.parametrize("payload", [b"", b"x", "é\r\n\r\nWARC/1.1".encode() * 50])
def test_record_round_trip(payload):
    kept = wacz.parse_record(wacz.record("7", "http://a/\r\nb c", payload, None, False))
    assert (kept.page, kept.kind, kept.payload) == ("7", "response", payload)
    assert kept.url == "http://a/%0D%0Ab%20c"
    again = wacz.parse_record(wacz.record(None, None, payload, "7", True))
    assert (again.page, again.kind, again.refers_to, again.payload) == (None, "revisit", "7", b"")
    assert again.payload_bytes == len(payload) and again.digest == kept.digest


def test_a_damaged_payload_is_refused():
    import gzip

    whole = gzip.decompress(wacz.record("1", "u", b"payload", None, False))
    with pytest.raises(ValueError, match="digest"):
        wacz.parse_record(gzip.compress(whole.replace(b"\r\npayload", b"\r\nPAYLOAD")))


def test_pages_round_trip(spark, tmp_path, monkeypatch):
    rows = [(1, "u1", "same", "d"), (9, "u9", "same", "d"), (9, "u9", "same", "d"), (4, None, None, "d")]
    rows += [(5, "u5", "", "d"), (None, "u", "same", "d"), (None, "u", "alone", "d")]
    rows += [(100 + i, f"u{i}", f"page {i} " * 200, "d") for i in range(300)]
    manifest = wacz.write_archives(spark, local_frame(spark, rows, DDL), str(tmp_path / "a"))
    got = wacz.read_archives(manifest).collect()
    assert len(got) == len(rows) == sum(r["records"] for r in manifest.collect())
    same = [r for r in got if r["payload_bytes"] == 4]
    assert sorted((r["page"] or "", r["kind"], r["refers_to"] or "") for r in same) == [
        ("", "revisit", "9"), ("1", "revisit", "9"), ("9", "response", ""), ("9", "response", ""),
    ]
    empty = {r["page"]: r["kind"] for r in got if r["payload_bytes"] == 0}
    assert empty == {"5": "response", "4": "revisit"}
    texts = {str(i): t for i, _, t, _ in rows if i and i >= 100}
    for r in got:
        if r["page"] in texts:
            want = texts[r["page"]].encode()
            assert r["payload"] == want
            assert r["digest"] == base64.b32encode(hashlib.sha1(want).digest()).decode()


def test_small_payloads_are_all_responses(spark, tmp_path):
    rows = [(1, "u", "ab", "d"), (2, "u", "ab", "d"), (3, "u", "abc", "d"), (4, "u", "abc", "d")]
    manifest = wacz.write_archives(spark, local_frame(spark, rows, DDL), str(tmp_path / "b"), least=3)
    kinds = {r["page"]: r["kind"] for r in wacz.read_archives(manifest).collect()}
    assert kinds == {"1": "response", "2": "response", "3": "revisit", "4": "response"}


def test_no_pages(spark, tmp_path):
    manifest = wacz.write_archives(spark, local_frame(spark, [], DDL), str(tmp_path / "c"))
    assert manifest.collect() == [] and wacz.read_archives(manifest).collect() == []


def test_archives_roll_over(tmp_path):
    writer = wacz.ArchiveWriter(str(tmp_path))
    member = wacz.record("1", "u", b"x" * 100, None, False)
    for _ in range(3):
        writer.add("u", member, 100)
    writer.close()
    assert writer.records == 3 and writer.payload_bytes == 300
    with zipfile.ZipFile(writer.uri) as archive:  # another reader agrees
        assert archive.testzip() is None
        assert archive.namelist() == [wacz.DATA, wacz.INDEX, wacz.PACKAGE]
        assert all(i.compress_type == zipfile.ZIP_STORED for i in archive.infolist())
    ranges = list(wacz.index_archive(writer.uri))
    data = open(writer.uri, "rb").read()
    assert [wacz.parse_record(data[a : a + n]).page for a, n in ranges] == ["1"] * 3
