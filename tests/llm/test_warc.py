"""Archives: round trip, revisits, salvage after damage."""

import base64
import gzip
import hashlib
import random

from sylvan.llm.warc import read_archives, salvage, write_and_read_back, write_archives

PAGES = [
    (1, "http://a.example/x y\r\nEvil: 1", "<p>one</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    (2, None, None),
    (3, "http://a.example/3", ""),
    (4, "http://a.example/4", "<p>é日本</p>"),
    (7, "http://a.example/7", "<p>é日本</p>"),
    (7, "http://a.example/7", "<p>é日本</p>"),
    (5, "http://a.example/5", "x" * 300_000),
    (None, "http://a.example/n", "<p>é日本</p>"),
]


def expected(rows):
    first = {}
    for i, _, h in rows:
        k = h or ""
        first[k] = i if first.get(k) is None else max(first[k], i if i is not None else first[k])
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first[h or ""]
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == f else "revisit", None if i == f else f))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, record string")


def test_round_trip(spark):
    got = [tuple(r) for r in write_and_read_back(frame(spark, PAGES)).collect()]
    assert order(got) == order(expected(PAGES))


def test_empty(spark):
    assert write_and_read_back(frame(spark, [])).collect() == []


def test_least(spark):
    got = write_and_read_back(frame(spark, PAGES), least=100).collect()
    assert {r.record_type for r in got} == {"response"}


def archive(n=6):
    out = []
    for i in range(n):
        payload = f"<p>page {i}</p>".encode() * 20
        http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
        block = http + payload
        d = [base64.b32encode(hashlib.sha1(x).digest()) for x in (block, payload)]
        head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Block-Digest: sha1:%s\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % (i, *d, len(block))
        out.append(head + block + b"\r\n\r\n")
    return out


def read(data):
    found = list(salvage(data))
    return [x["record_id"] for k, _, _, x in found if k == "record"], [(a, n) for k, a, n, _ in found if k == "gap"]


def ids(*n):
    return [f"<urn:page:{i}>" for i in n]


def test_whole_archives():
    parts = archive()
    assert read(b"".join(parts)) == (ids(*range(6)), [])
    assert read(b"".join(map(gzip.compress, parts))) == (ids(*range(6)), [])
    assert read(gzip.compress(b"".join(parts))) == (ids(*range(6)), [])
    assert read(b"") == ([], [])


def test_flipped_byte_in_plain_archive():
    parts = archive()
    whole = bytearray(b"".join(parts))
    at = len(parts[0]) + len(parts[1]) - 30
    whole[at] ^= 1
    assert read(bytes(whole)) == (ids(0, 2, 3, 4, 5), [(len(parts[0]), len(parts[1]))])


def test_lost_bytes_and_junk():
    parts = archive()
    plain = b"junk\r\n" + parts[0] + parts[1][:100] + parts[2] + parts[3] + b"tail"
    got, gaps = read(plain)
    assert got == ids(0, 2, 3)
    assert gaps == [(0, 6), (6 + len(parts[0]), 100), (len(plain) - 4, 4)]


def test_damaged_members():
    z = [gzip.compress(p) for p in archive()]
    broken = bytearray(z[2])
    broken[len(broken) // 2] ^= 0x55
    whole = z[0] + z[1] + bytes(broken) + z[3][: len(z[3]) // 2] + z[4] + b"\0\0\0" + z[5]
    got, gaps = read(whole)
    assert got == ids(0, 1, 4, 5)
    starts = [len(z[0]) + len(z[1]), len(z[0]) + len(z[1]) + len(z[2])]
    assert [a for a, _ in gaps][:2] == starts and gaps[-1][1] == 3


def test_any_damage_keeps_the_other_records():
    r = random.Random(5)
    for compress in (False, True):
        parts = [gzip.compress(p) if compress else p for p in archive()]
        for _ in range(60):
            hit = r.randrange(len(parts))
            bad = bytearray(parts[hit])
            bad[r.randrange(len(bad))] ^= r.randrange(1, 256)
            got, gaps = read(b"".join(bytes(bad) if i == hit else p for i, p in enumerate(parts)))
            assert [x for x in ids(*range(6)) if x not in got] in ([], ids(hit))
            assert len(gaps) <= 2


def test_gaps_are_logged_by_the_reader(spark, tmp_path):
    write_archives(frame(spark, PAGES[:5]).coalesce(1), f"file://{tmp_path}/w", codec="none")
    (f,) = (tmp_path / "w").glob("part-*")
    data = bytearray(f.read_bytes())
    data[data.index(b"<p>one") + 3] ^= 1
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0").write_bytes(bytes(data))
    rows = read_archives(spark, f"file://{tmp_path}/bad", payload=True).collect()
    assert [r.reason for r in rows if r.kind == "gap"] == ["block digest differs"]
    assert len([r for r in rows if r.kind == "record"]) == 4


def test_records_ahead_of_the_damage_are_kept():
    whole = gzip.compress(b"".join(archive()))
    for at in (-6, -2):  # check sum and length of a member that is intact
        bad = bytearray(whole)
        bad[at] ^= 1
        got, gaps = read(bytes(bad))
        assert got == ids(*range(6)) and len(gaps) == 1
    r = random.Random(3)
    parts = [p.replace(b"WARC-Type", b"X-Fill: %s\r\nWARC-Type" % bytes(r.choices(b"abcdefghijklmnop", k=900)), 1) for p in archive(40)]
    bad = bytearray(gzip.compress(b"".join(parts)))
    bad[-200] ^= 0x55
    assert read(bytes(bad))[0][:38] == ids(*range(38))


def test_own_archives_lose_the_damaged_record_alone(spark, tmp_path):
    pages = [(i, f"http://a.example/{i}", f"<p>page {i}</p>" * 30) for i in range(50)]
    write_archives(frame(spark, pages).coalesce(1), f"file://{tmp_path}/w")
    data = bytearray(b"".join(f.read_bytes() for f in (tmp_path / "w").glob("part-*")))
    whole = read(bytes(data))
    assert sorted(whole[0]) == sorted(ids(*range(50))) and whole[1] == []
    data[len(data) // 2] ^= 0x55
    assert len(read(bytes(data))[0]) >= 49
    assert gzip.decompress(b"".join(f.read_bytes() for f in (tmp_path / "w").glob("part-*"))).count(b"WARC/1.1\r\n") == 50


def record(payload, *headers, length=None):
    head = b"".join(b"%s\r\n" % h for h in headers)
    return b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:9>\r\n%sContent-Length: %s\r\n\r\n%s\r\n\r\n" % (head, b"%d" % len(payload) if length is None else length, payload)


def test_headers_of_other_writers():
    body = b"abc"
    sha1, sha256 = hashlib.sha1(body), hashlib.sha256(body)
    good = [
        b"WARC-Block-Digest: sha1:" + sha1.hexdigest().encode(),
        b"WARC-Block-Digest: SHA-256:" + sha256.hexdigest().encode(),
        b"WARC-Block-Digest: sha256:" + base64.b32encode(sha256.digest()),
        b"WARC-Block-Digest: sha1:" + base64.b32encode(sha1.digest()).lower(),
        b"WARC-Block-Digest: blake3:00",
        b"X-Note: one\r\n two\r\n\tthree",
        b"X-Note: one\r\nX-Note: two",
    ]
    for h in good:
        assert read(record(body, h)) == (ids(9), []), h
    for h in (b"WARC-Block-Digest: md5:00", b"no colon"):
        assert read(record(body, h))[0] == []


def test_no_header_stops_the_reader():
    good = archive(2)
    for n in (b"9" * 5000, b"99999999999999999999", b"-1", b"", b"1e3", "٣".encode()):
        got, gaps = read(good[0] + record(b"abc", length=n) + good[1])
        assert got == ids(0, 1) and len(gaps) == 1
    http = b"HTTP/1.1 200 OK\r\nContent-Length: " + b"9" * 5000 + b"\r\n\r\nx"
    assert read(record(http, b"Content-Type: application/http"))[0] == ids(9)


def test_fuzzed_headers():
    r = random.Random(8)
    parts = archive()
    for _ in range(300):
        bad = bytearray(parts[2])
        end = bad.index(b"\r\n\r\n") + 4
        for _ in range(r.randrange(1, 6)):
            at = r.randrange(end)
            bad[at : at + r.randrange(3)] = bytes(r.choices(b"\r\n\t :;0123456789sha\xff\x00WARC/", k=r.randrange(4)))
        got, _ = read(b"".join([*parts[:2], bytes(bad), *parts[3:]]))
        assert set(ids(0, 1, 3, 4, 5)) <= set(got)


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    from sylvan.llm import warc

    monkeypatch.setattr(warc, "FILE_BYTES", 100_000)
    write_archives(frame(spark, [(i, None, f"{i} " + "y" * 20_000) for i in range(30)]).coalesce(1), f"file://{tmp_path}/w")
    assert len(list((tmp_path / "w").glob("part-*"))) >= 6


def test_own_archives_with_a_gap_are_an_error(spark, monkeypatch):
    import pytest

    from sylvan.llm import warc

    monkeypatch.setattr(warc, "_members", lambda batches: (b.slice(0, 0) if False else __import__("pyarrow").RecordBatch.from_arrays([__import__("pyarrow").array([gzip.compress(b"junk")] * len(b))], ["record"]) for b in batches))
    with pytest.raises(RuntimeError, match="read back"):
        write_and_read_back(frame(spark, PAGES[3:5])).collect()
