"""GIF media column: encoding, decoding and colour histograms.

The decoder reads any GIF87a/89a stream: LZW codes of growing width with clear
and deferred clear codes, global and local palettes, interlacing, frame
rectangles, transparency and the four disposal methods.  Frames come out as
rendered on the canvas, with their delay and a histogram of 64 colours (the
two high bits of red, green and blue).

A payload is stored as the samples of grey frames ``WIDTH`` wide (palette entry
i is grey i), at most ``ROWS`` rows a frame, so what the renderer shows is the
payload again, byte for byte.

Nulls: a null text is stored like an empty one: 64 zero bytes.  Equal texts
give equal media.  Media is made and decoded one document at a time; a document
of any length takes as many frames as it needs, each decoded and released in
turn.  Repeated rows are stored each; other columns are ignored.  An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import in_batches, materialise

WIDTH, ROWS = 64, 4096
#: Milliseconds that a payload frame is shown.
DELAY_MS = 100
#: Pixels of a canvas or frame that is rendered, at most.
PIXELS = 1 << 25
_MAX = 4096


def _widths(min_size: int) -> np.ndarray:
    """Bits of the i-th code after a clear code, as a decoder reads it."""
    first = (1 << min_size) + 2
    entries = first + np.maximum(np.arange(_MAX - first + 2) - 1, 0)  # in the table when code i is read
    return np.minimum(np.floor(np.log2(entries)).astype(np.int64) + 1, 12)


_template = {m: _widths(m) for m in range(2, 9)}
_offsets = {m: np.concatenate(([0], np.cumsum(w))) for m, w in _template.items()}
_SINGLE = [bytes((i,)) for i in range(256)]


def lzw_encode(samples: bytes, min_size: int = 8) -> bytes:
    """Code stream of ``samples``, beginning with a clear code and ending with the end code."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    codes: list[int] = []
    segments: list[int] = []
    at, n = 0, len(samples)
    while True:
        table: dict[int, int] = {}
        free = end + 1
        codes.append(clear)
        segments.append(len(codes))
        if at < n:
            prefix = samples[at]
            at += 1
            put = codes.append
            get = table.get
            for at in range(at, n):  # noqa: B020
                sample = samples[at]
                key = prefix << 8 | sample
                known = get(key)
                if known is not None:
                    prefix = known
                    continue
                put(prefix)
                prefix = sample
                if free == _MAX - 1:
                    break
                table[key] = free
                free += 1
            else:
                at = n
                put(prefix)
                break
            # The table is full: the sample at ``at`` begins the next segment.
        else:
            break
    codes.append(end)
    all_codes = np.array(codes, np.int64)
    bits = np.empty(len(all_codes), np.int64)
    stops = [*segments[1:], len(codes) + 1]
    bits[0] = min_size + 1
    t = _template[min_size]
    for a, b in zip(segments, stops, strict=True):
        bits[a:b] = t[: min(b, len(codes)) - a]  # the next clear code has its segment's last width
    return _pack(all_codes, bits)


def _pack(codes: np.ndarray, bits: np.ndarray) -> bytes:
    """Codes of the given widths, least bits first."""
    out = []
    carry = np.zeros(0, np.uint8)
    for i in range(0, len(codes), 100_000):
        c, w = codes[i : i + 100_000], bits[i : i + 100_000]
        plane = ((c[:, None] >> np.arange(12)) & 1).astype(np.uint8)
        flat = np.concatenate((carry, plane[np.arange(12) < w[:, None]]))
        whole = len(flat) // 8 * 8
        out.append(np.packbits(flat[:whole], bitorder="little").tobytes())
        carry = flat[whole:]
    return b"".join(out) + (np.packbits(carry, bitorder="little").tobytes() if len(carry) else b"")


def lzw_decode(stream: bytes, min_size: int, most: int) -> bytes:
    """Samples of a code stream, ``most`` at most; what a broken stream yields up to the break."""
    if not 2 <= min_size <= 8:
        raise ValueError("code size")
    clear, end = 1 << min_size, (1 << min_size) + 1
    data = np.frombuffer(stream + bytes(8), np.uint8)
    total = len(stream) * 8
    widths, offsets = _template[min_size], _offsets[min_size]
    base = _SINGLE[:clear] + [b"", b""]
    at, got, size = 0, [], 0
    while at < total and size < most:
        # All codes up to the next clear code have known widths; read as many as the table can take, then 12 bits each.
        bit = at + offsets[:-1]
        fits = int(np.searchsorted(bit + widths, total, "right"))
        codes = _read(data, bit[:fits], widths[:fits])
        stop = np.flatnonzero((codes == clear) | (codes == end))
        seen = int(stop[0]) if len(stop) else len(codes)
        ended = len(stop) > 0 and codes[seen] == end
        run = codes[:seen].tolist()
        consumed = int(offsets[seen + 1]) if len(stop) else int(offsets[fits])
        if not len(stop) and fits == len(widths):  # deferred clear: the table stays full
            while True:
                more = at + consumed + 12 * np.arange(4096)
                more = more[more + 12 <= total]
                codes = _read(data, more, np.full(len(more), 12))
                stop = np.flatnonzero((codes == clear) | (codes == end))
                take = int(stop[0]) if len(stop) else len(codes)
                run += codes[:take].tolist()
                consumed += 12 * (take + (len(stop) > 0))
                ended = len(stop) > 0 and codes[take] == end
                if len(stop) or not len(more):
                    break
        if run:
            table = base.copy()
            grow, put = table.append, got.append
            before = table[run[0]] if run[0] < clear else None
            if before is None:
                return b"".join(got)[:most]
            put(before)
            count = len(table)
            for code in run[1:]:
                if code < count:
                    now = table[code]
                elif code == count and count < _MAX:
                    now = before + before[:1]
                else:
                    return b"".join(got)[:most]
                put(now)
                if count < _MAX:
                    grow(before + now[:1])
                    count += 1
                before = now
            size = sum(map(len, got)) if len(got) > 100_000 else size
        if ended or not consumed or (not len(stop) and at + consumed + 3 > total):
            break
        at += consumed
    return b"".join(got)[:most]


def _read(data: np.ndarray, bit: np.ndarray, widths: np.ndarray) -> np.ndarray:
    byte = bit >> 3
    word = data[byte].astype(np.int64) | data[byte + 1].astype(np.int64) << 8 | data[byte + 2].astype(np.int64) << 16
    return (word >> (bit & 7)) & ((1 << widths) - 1)


def _blocks(data: bytes) -> bytes:
    """Data sub-blocks of up to 255 bytes, and the terminator."""
    return b"".join(bytes((min(255, len(data) - i),)) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


GREYS = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))


def encode_samples(payload: bytes) -> bytes:
    """An animated GIF whose grey frames hold ``payload``, whose length is a multiple of WIDTH."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), GREYS]
    for top in range(0, rows, ROWS):
        part = payload[top * WIDTH : (top + ROWS) * WIDTH]
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 4, DELAY_MS // 10, 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


@dataclass(frozen=True)
class Frame:
    """A frame as shown: the canvas, and the rectangle that the frame itself drew."""

    delay_ms: int
    pixels: np.ndarray  # (height, width, 4): red, green, blue, opacity
    box: tuple[int, int, int, int]  # left, top, width, height

    def histogram(self) -> np.ndarray:
        """Opaque pixels by colour, in 64 bins."""
        p = self.pixels[self.pixels[..., 3] > 0]
        return np.bincount((p[:, 0] >> 6).astype(np.int64) * 16 + (p[:, 1] >> 6) * 4 + (p[:, 2] >> 6), minlength=64)


def frames(gif: bytes) -> Iterator[Frame]:
    """Rendered frames of a GIF, in order; ValueError if it is not one, breaks off within a block or is of more than ``PIXELS``."""
    try:
        yield from _frames(gif)
    except (struct.error, IndexError) as why:
        raise ValueError(f"broken off: {why}") from why


def _frames(gif: bytes) -> Iterator[Frame]:
    if gif[:6] not in (b"GIF87a", b"GIF89a") or len(gif) < 13:
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", gif, 6)
    at = 13
    palette = None
    if flags & 0x80:
        n = 2 << (flags & 7)
        palette = np.frombuffer(gif, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    if width * height > PIXELS:
        raise ValueError(f"{width} by {height} pixels")
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, dispose, clear_index = 0, 0, None

    def sub_blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(gif) and gif[at]:
            parts.append(gif[at + 1 : at + 1 + gif[at]])
            at += 1 + gif[at]
        return b"".join(parts), at + 1

    while at < len(gif) and gif[at] != 0x3B:
        if gif[at] == 0x21:
            body, end = sub_blocks(at + 2)
            if gif[at + 1] == 0xF9 and len(body) >= 4:
                dispose, delay = body[0] >> 2 & 7, struct.unpack_from("<H", body, 1)[0] * 10
                clear_index = body[3] if body[0] & 1 else None
            at = end
            continue
        if gif[at] != 0x2C:
            raise ValueError(f"unknown block {gif[at]:#x}")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", gif, at + 1)
        at += 10
        colours = palette
        if flags & 0x80:
            n = 2 << (flags & 7)
            colours = np.frombuffer(gif, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        if colours is None:
            raise ValueError("no palette")
        if w * h > PIXELS:
            raise ValueError(f"a frame of {w} by {h} pixels")
        stream, end = sub_blocks(at + 1)
        samples = np.zeros(w * h, np.uint8)
        found = np.frombuffer(lzw_decode(stream, gif[at], w * h), np.uint8)
        samples[: len(found)] = found
        drawn = np.zeros(w * h, bool)
        drawn[: len(found)] = True
        at = end
        image, there = samples.reshape(h, w), drawn.reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            image, there = image[np.argsort(order)], there[np.argsort(order)]
        if clear_index is not None:
            there = there & (image != clear_index)
        before = canvas.copy() if dispose == 3 else None
        w_in, h_in = max(0, min(w, width - left)), max(0, min(h, height - top))
        image, there = image[:h_in, :w_in], there[:h_in, :w_in]
        part = canvas[top : top + h_in, left : left + w_in]
        shown = np.zeros((256, 4), np.uint8)
        shown[: len(colours), :3] = colours
        shown[:, 3] = 255
        part[there] = shown[image[there]]
        yield Frame(delay, canvas.copy(), (left, top, w_in, h_in))
        if dispose == 2:
            part[:] = 0
        elif dispose == 3:
            canvas = before
        delay, dispose, clear_index = 0, 0, None


def decode_samples(gif: bytes) -> tuple[bytes, np.ndarray, int, int]:
    """Payload of a grey GIF from its rendered frames, with their histogram, number and length in ms."""
    parts, bins, n, ms = [], np.zeros(64, np.int64), 0, 0
    for f in frames(gif):
        left, top, w, h = f.box
        grey = f.pixels[top : top + h, left : left + w, 0]
        parts.append(grey.tobytes())
        bins += np.bincount((grey.reshape(-1) >> 6).astype(np.int64) * 21, minlength=64)
        n, ms = n + 1, ms + f.delay_ms
    return b"".join(parts), bins, n, ms


FRAME_SCHEMA = "frame int, delay_ms int, width int, height int, rgba binary, histogram array<long>, error string"


def decode_frames(media: DataFrame, gif_col: str = "gif", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a frame of each GIF: its number, delay, size, pixels and 64-colour histogram; a null gives none.

    A GIF that can't be read, or not to its end, has a last row with the error alone.
    """
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in media.select(*keep).schema)
    names = [f.split()[0] for f in FRAME_SCHEMA.split(", ")]
    kinds = [*[pa.int32()] * 4, pa.binary(), pa.list_(pa.int64()), pa.string()]

    def rows(data: bytes) -> Iterator[tuple]:
        try:
            for k, f in enumerate(frames(data)):
                yield k, f.delay_ms, f.pixels.shape[1], f.pixels.shape[0], f.pixels.tobytes(), f.histogram().tolist(), None
        except ValueError as why:
            yield *[None] * 6, str(why)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in enumerate(b.column(len(keep))):
                own = [b.column(j).slice(i, 1) for j in range(len(keep))]
                for row in rows(x.as_py()) if x.is_valid else ():
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array([v], kind) for v, kind in zip(row, kinds, strict=True))], [*keep, *names])

    return in_batches(media.select(*keep, gif_col), run, f"{kept}, {FRAME_SCHEMA}")


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, gif) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, size, first = [], [], 0
            for i, t in enumerate(b.column(1)):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                made.append(encode_samples(pad(raw)))
                size.append(len(raw))
                if i + 1 == len(b) or sum(map(len, made)) > 16_000_000:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(made)), pa.array(size, pa.int64()), pa.array(made, pa.binary())], ["doc_id", "n_bytes", "gif"])
                    made, size, first = [], [], i + 1

    return in_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, n_bytes long, gif binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """Digests and features of each stored GIF's payload, as decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(2):
                gif = x.as_py()
                payload, bins, n, ms = decode_samples(gif)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(gif), hashlib.sha256(gif).hexdigest(), f"{n} frames {ms} ms {'/'.join(map(str, bins[::21]))}"))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], [f.split()[0] for f in FEATURES.split(", ")])

    return in_batches(media, run, FEATURES)


def store_and_read_back(docs: DataFrame) -> DataFrame:
    """Store every text as a GIF, read the stored bytes and compute the features."""
    return features(materialise(to_media(docs), "gif"))
