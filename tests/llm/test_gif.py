"""GIF: LZW against a bit-by-bit decoder, rendering rules, payload round trip."""

import contextlib
import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from sylvan.llm import gif


def slow(stream, m):
    clear, end = 1 << m, (1 << m) + 1
    out, bits, have, width, table, prev, it = b"", 0, 0, m + 1, None, None, iter(stream)
    while True:
        while have < width:
            bits |= next(it) << have
            have += 8
        c = bits & ((1 << width) - 1)
        bits >>= width
        have -= width
        if c == clear:
            table, width, prev = [bytes((i,)) for i in range(clear)] + [b"", b""], m + 1, None
        elif c == end:
            return out
        elif prev is None:
            prev = table[c]
            out += prev
        else:
            now = table[c] if c < len(table) else prev + prev[:1]
            out += now
            if len(table) < 4096:
                table.append(prev + now[:1])
                width += len(table) == 1 << width and width < 12
            prev = now


@pytest.mark.parametrize("n", [0, 1, 2, 64, 300, 5000, 60000])
@pytest.mark.parametrize("k", [1, 2, 7, 256])
def test_lzw(n, k):
    r = random.Random(n * k)
    d = bytes(r.randrange(k) for _ in range(n))
    s = gif.lzw_encode(d)
    assert slow(s, 8) == d == gif.lzw_decode(s, 8, n)


def test_deferred_clear():
    r = random.Random(2)
    d = bytes(r.randrange(4) for _ in range(40000))
    table = {bytes((i,)): i for i in range(4)}
    codes, bits, free, width, w = [4], [3], 6, 3, b""
    for x in d:  # never clears again
        if w + bytes((x,)) in table:
            w += bytes((x,))
            continue
        codes.append(table[w])
        bits.append(width)
        if free < 4096:
            table[w + bytes((x,))] = free
            free += 1
            if free > 1 << width and width < 12:
                width += 1
        w = bytes((x,))
    codes += [table[w], 5]
    bits += [width, width]
    s = gif._pack(np.array(codes), np.array(bits))
    assert gif.lzw_decode(s, 2, len(d)) == d


def test_broken_stream_yields_what_it_can():
    s = gif.lzw_encode(b"abcabcabc" * 50)
    assert b"abcabcabc" * 50 == gif.lzw_decode(s[:-1], 8, 450) or len(gif.lzw_decode(s[:-1], 8, 450)) > 400
    assert gif.lzw_decode(s[:10], 8, 450) == (b"abcabcabc" * 50)[: len(gif.lzw_decode(s[:10], 8, 450))]


def image(w, h, at, samples, control=None, palette=None, interlace=False):
    out = b""
    if control:
        dispose, delay, clear = control
        out += struct.pack("<BBBBHBB", 0x21, 0xF9, 4, dispose << 2 | (clear is not None), delay, clear or 0, 0)
    out += struct.pack("<BHHHHB", 0x2C, *at, w, h, (0x81 if palette else 0) | (0x40 if interlace else 0)) + (palette or b"")
    return out + b"\x08" + gif._blocks(gif.lzw_encode(bytes(samples)))


def movie(w, h, *parts):
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255]) + b"".join(parts) + b"\x3b"


def test_disposal_transparency_and_palettes():
    g = movie(
        2, 2,
        image(2, 2, (0, 0), [1, 1, 1, 1], (1, 5, None)),
        image(1, 1, (1, 0), [2], (2, 7, None)),  # cleared after
        image(2, 1, (0, 1), [3, 0], (3, 0, 0)),  # index 0 is transparent; canvas restored after
        image(1, 1, (0, 0), [1], None, bytes([9, 9, 9, 200, 100, 50, 0, 0, 0, 0, 0, 0])),
    )
    f = list(gif.frames(g))
    assert [x.delay_ms for x in f] == [50, 70, 0, 0]
    red, green, blue, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert f[0].pixels.tolist() == [[red, red], [red, red]]
    assert f[1].pixels.tolist() == [[red, green], [red, red]]
    assert f[2].pixels.tolist() == [[red, none], [blue, red]]
    assert f[3].pixels.tolist() == [[[200, 100, 50, 255], none], [red, red]]
    assert f[2].histogram().sum() == 3 and f[0].histogram()[48] == 4


def test_interlace():
    rows = list(range(11))
    order = [0, 8, 4, 2, 6, 10, 1, 3, 5, 7, 9]
    g = b"GIF87a" + struct.pack("<HHBBB", 1, 11, 0xF7, 0, 0) + gif.GREYS + image(1, 11, (0, 0), [rows[i] for i in order], interlace=True) + b"\x3b"
    assert next(gif.frames(g)).pixels[:, 0, 0].tolist() == rows


def test_not_a_gif():
    with pytest.raises(ValueError):
        list(gif.frames(b"PNG"))


TEXTS = [(1, "hello"), (2, ""), (3, None), (4, "é" * 32), (5, "long " * 80_000), (5, "hello"), (None, "x" * 64)]


def test_payload_round_trip(spark):
    df = spark.createDataFrame([(*r, "g") for r in TEXTS], "doc_id long, text string, gif string")
    got = sorted((tuple(r)[:5] for r in gif.store_and_read_back(df).collect()), key=str)
    want = []
    for d, t in TEXTS:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        want.append((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert got == sorted(want, key=str)
    assert gif.store_and_read_back(df.limit(0)).collect() == []


def test_frame_rows(spark):
    df = spark.createDataFrame([(1, gif.encode_samples(bytes(range(64)) * 5000)), (2, None)], "doc_id long, gif binary")
    rows = gif.decode_frames(df.select("doc_id", "gif")).orderBy("frame").collect()
    assert [(r.doc_id, r.frame, r.delay_ms, r.height, sum(r.histogram)) for r in rows] == [(1, 0, 100, 4096, 64 * 4096), (1, 1, 100, 4096, 64 * 4096)]


def test_damaged_media_are_logged_and_do_not_stop_the_rest(spark):
    good = gif.encode_samples(bytes(64))
    large = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0xF7, 0, 0) + gif.GREYS + b"\x3b"
    cut = [good[:n] for n in (10, 100, 789, 792, 798)]
    rows = gif.decode_frames(spark.createDataFrame(list(enumerate([good, b"", b"GIF89a", large, *cut])), "doc_id long, gif binary")).collect()
    assert [r.doc_id for r in rows if r.error is None][:1] == [0]
    assert {r.doc_id for r in rows if r.error} >= {1, 2, 3, 4, 5}
    for n in range(len(good)):
        with contextlib.suppress(ValueError):
            list(gif.frames(good[:n]))
