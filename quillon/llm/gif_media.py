"""GIF media columns (operator 2): lossless storage of bytes as palette indices, and a full reader.

The reader parses blocks, decodes LZW code streams, applies palettes,
interlacing, transparency and disposal, and gives timed frames with colour
histograms. The writer stores a payload as LZW-compressed frames of WIDTH
columns over a grey palette. Code widths depend only on how many codes came
since the last clear code, so codes are packed and unpacked as arrays, and the
reader follows pointers into its own output in place of a code table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WIDTH, FRAME_ROWS, DELAY_CS = 64, 4096, 10
BINS = 8
#: Codes that are unpacked at a time, and entries of a full table (fixed by the format).
_RUN, _FULL = 4096, 4096
#: A larger canvas or frame is taken for a damaged file.
MOST_PIXELS = 1 << 26
_GREY = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    palette: bytes
    pixels: np.ndarray  # height x width palette indices


@lru_cache(maxsize=64)
def _widths(least_bits: int, since: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the next _RUN codes begins (in bits) and how wide it is, `since` codes after a clear code."""
    size = (1 << least_bits) + 2 + np.maximum(np.arange(since, since + _RUN) - 1, 0)
    width = np.minimum(np.floor(np.log2(size)).astype(np.int64) + 1, 12)
    return np.concatenate([[0], np.cumsum(width)[:-1]]), width


def lzw_encode(data: bytes) -> bytes:
    """Code stream of bytes (eight bits a sample): the table grows to its limit, then a clear code starts anew."""
    codes, runs = [256], [1]  # codes of each stretch up to and with its clear code
    roots = [{-1: i} for i in range(256)]  # a trie: -1 holds a node's code
    entry, node, add = 258, roots[data[0]], codes.append
    for c in data[1:]:
        if c in node:
            node = node[c]
            continue
        add(node[-1])
        if entry < _FULL:
            node[c] = {-1: entry}
            entry += 1
        else:
            add(256)
            runs.append(len(codes))
            roots = [{-1: i} for i in range(256)]
            entry = 258
        node = roots[c]
    codes += [node[-1], 257]
    runs.append(len(codes))
    sizes = np.diff([0, *runs])
    widths = _widths(8, 0)[1]
    width = np.concatenate([widths[:n] for n in sizes])
    at = np.cumsum(width) - width
    total = int(at[-1] + width[-1])
    value = np.array(codes, np.uint32) << (at & 7).astype(np.uint32)
    out = np.zeros((total >> 3) + 4, np.uint8)
    byte = at >> 3
    for j in range(3):  # a code lies in three bytes at most, and shares bits with none
        np.bitwise_or.at(out, byte + j, (value >> np.uint32(8 * j) & np.uint32(255)).astype(np.uint8))
    return out[: -(-total // 8)].tobytes()


def _sub_blocks(data: bytes) -> bytes:
    full = len(data) // 255
    head = np.empty((full, 256), np.uint8)
    head[:, 0] = 255
    head[:, 1:] = np.frombuffer(data, np.uint8, full * 255).reshape(full, 255)
    rest = data[full * 255 :]
    return head.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def write_gif(payload: bytes) -> bytes:
    """A GIF89a whose frames' palette indices are the payload, whose length is a positive multiple of WIDTH."""
    if not payload or len(payload) % WIDTH:
        raise ValueError(f"payload of {len(payload)} bytes: not a positive multiple of {WIDTH}")
    rows = len(payload) // WIDTH
    u16 = lambda x: x.to_bytes(2, "little")
    out = [b"GIF89a", u16(WIDTH), u16(min(rows, FRAME_ROWS)), b"\xf7\0\0", _GREY]
    samples = np.frombuffer(payload, np.uint8)
    for at in range(0, rows, FRAME_ROWS):
        part = samples[at * WIDTH : (at + FRAME_ROWS) * WIDTH]
        out += [b"\x21\xf9\x04\x04", u16(DELAY_CS), b"\0\0", b"\x2c\0\0\0\0", u16(WIDTH), u16(len(part) // WIDTH), b"\0\x08", _sub_blocks(lzw_encode(part.tobytes()))]
    return b"".join([*out, b"\x3b"])


def _jumped(to: np.ndarray) -> np.ndarray:
    """Where chains of pointers end; an end points to itself."""
    while True:
        further = to[to]
        if (further == to).all():
            return to
        to = further


def _expand(codes: np.ndarray, clear: int) -> bytes:
    """What codes between two clear codes stand for, without a table: the entry that step j made is the output of step j and one byte more, so that a code copies bytes that lie further ahead in the output."""
    n = len(codes)
    if not n:
        return b""
    literal = codes < clear
    made = np.where(literal, np.arange(n), codes - (clear + 2))  # the step that made the entry
    if (made < 0).any() or (made > np.arange(n) - ~literal).any() or (codes >= _FULL).any():
        raise ValueError("an LZW code names no entry")
    # Length of each output: one more than that of the step it copies.
    length, back = (~literal).astype(np.int64), made
    while True:
        further = back[back]
        if (further == back).all():
            break
        length, back = length + length[back], further
    length += 1
    place = np.cumsum(length) - length
    source = np.arange(int(place[-1] + length[-1])) + np.repeat(place[made] - place, length)
    value = np.zeros(len(source), np.uint8)
    value[place[literal]] = codes[literal] & 255
    return value[_jumped(source)].tobytes()


def lzw_decode(data: bytes, least_bits: int) -> bytes:
    """Any GIF code stream: variable widths, clear and end codes, codes that name the entry being made, a full table that isn't cleared."""
    if not 1 <= least_bits <= 11:
        raise ValueError(f"LZW codes of {least_bits} bits")
    clear, end = 1 << least_bits, (1 << least_bits) + 1
    raw, bits = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32), 8 * len(data)
    at, since = 0, 0
    out: list[bytes] = []
    held: list[np.ndarray] = []  # codes since the last clear code
    while True:
        begin, width = _widths(least_bits, min(since, _FULL))
        n = int(np.searchsorted(begin + width, bits - at, "right"))
        place = at + begin[:n]
        byte = place >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (place & 7).astype(np.uint32) & ((1 << width[:n]) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else n
        held.append(codes[:stop].astype(np.int64))
        if n and stop == n:
            at, since = at + int(begin[n - 1] + width[n - 1]), since + n
            continue
        out.append(_expand(np.concatenate(held), clear))
        held.clear()
        if not n or codes[stop] == end:
            return b"".join(out)
        at, since = at + int(begin[stop] + width[stop]), 0


def _joined(media: bytes, at: int) -> tuple[bytes, int]:
    found = []
    while media[at]:
        found.append(media[at + 1 : at + 1 + media[at]])
        at += 1 + media[at]
    return b"".join(found), at + 1


def read_gif(media: bytes) -> tuple[tuple[int, int], list[Frame]]:
    """Canvas size and frames. Raises ValueError on what is no GIF or larger than MOST_PIXELS; a file cut short gives the frames before the cut."""
    if media[:6] not in (b"GIF87a", b"GIF89a") or len(media) < 13:
        raise ValueError("no GIF header")
    size = (int.from_bytes(media[6:8], "little"), int.from_bytes(media[8:10], "little"))
    if size[0] * size[1] > MOST_PIXELS:
        raise ValueError(f"canvas of {size[0]} x {size[1]} pixels")
    flags, at = media[10], 13
    common = b""
    if flags & 128:
        common = media[at : at + (3 << ((flags & 7) + 1))]
        at += len(common)
    frames: list[Frame] = []
    delay = disposal = 0
    clear: int | None = None
    try:
        while media[at] != 0x3B:
            kind = media[at]
            if kind == 0x21:
                label = media[at + 1]
                body, at = _joined(media, at + 2)
                if label == 0xF9 and len(body) >= 4:
                    disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little") * 10
                    clear = body[3] if body[0] & 1 else None
            elif kind == 0x2C:
                left, top, width, height = (int.from_bytes(media[at + k : at + k + 2], "little") for k in (1, 3, 5, 7))
                if width * height > MOST_PIXELS:
                    raise ValueError(f"frame of {width} x {height} pixels")
                flags, at = media[at + 9], at + 10
                palette = common
                if flags & 128:
                    palette = media[at : at + (3 << ((flags & 7) + 1))]
                    at += len(palette)
                data, end = _joined(media, at + 1)
                pixels = np.frombuffer(lzw_decode(data, media[at])[: width * height].ljust(width * height, b"\0"), np.uint8).reshape(height, width)
                at = end
                if flags & 64:
                    order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, height, step)]
                    pixels = pixels[np.argsort(order)]
                frames.append(Frame(left, top, width, height, delay, disposal, clear, palette, pixels))
                delay = disposal = 0
                clear = None
            else:
                raise ValueError(f"unknown block {kind:#x}")
    except IndexError:
        pass
    return size, frames


def render(size: tuple[int, int], frames: list[Frame]) -> Iterator[np.ndarray]:
    """RGBA canvases (height x width x 4), one per frame, after disposal of the frames before."""
    canvas = np.zeros((size[1], size[0]), np.uint32)
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        colours = np.zeros((256, 4), np.uint8)
        table = np.frombuffer(f.palette, np.uint8, len(f.palette) // 3 * 3).reshape(-1, 3)  # a palette cut short leaves black
        colours[: len(table), :3] = table
        colours[:, 3] = 255
        part = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        pixels = f.pixels[: part.shape[0], : part.shape[1]]
        drawn = colours.view(np.uint32).ravel()[pixels]
        part[:] = drawn if f.transparent is None else np.where(pixels != f.transparent, drawn, part)
        yield canvas.copy().view(np.uint8).reshape(size[1], size[0], 4)
        if f.disposal == 2:
            part[:] = 0
        elif before is not None:
            canvas = before


def histogram(rgba: np.ndarray) -> list[int]:
    """Counts of red, green and blue in BINS equal ranges each, of pixels that are not transparent."""
    flat = rgba.reshape(-1, 4)
    if not flat[:, 3].all():
        flat = flat[flat[:, 3] > 0]
    return np.concatenate([np.bincount(flat[:, c] // (256 // BINS), minlength=BINS) for c in range(3)]).tolist()


def store_texts(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_bytes and media, a GIF of the text's UTF-8 bytes with zero bytes up to a positive multiple of WIDTH. Null counts as empty; doc_id may be null or repeated; other columns are not looked at."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [t.as_py() or b"" for t in part.column(1).cast(pa.large_binary())]
                media = [write_gif(t.ljust(max(1, -(-len(t) // WIDTH)) * WIDTH, b"\0")) for t in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_bytes long, media binary")


def timed_frames(media: bytes) -> Iterator[tuple[Frame, int, np.ndarray, list[int]]]:
    """Frame, start in milliseconds, rendered canvas and its colour histogram, of each frame."""
    size, frames = read_gif(media)
    start = 0
    for f, rgba in zip(frames, render(size, frames), strict=True):
        yield f, start, rgba, histogram(rgba)
        start += f.delay_ms


def stored_features(media: DataFrame) -> DataFrame:
    """Per row of `media` (doc_id, n_bytes, media): the payload read back from the GIF, its digests, and as feature its frames, duration and the colour histogram of the rendered frames (red, green, blue; BINS each). Null media give null columns."""

    def row(blob: bytes | None) -> tuple:
        if blob is None:
            return (None,) * 6
        samples, ends, colours = [], 0, np.zeros(3 * BINS, np.int64)
        for f, start, _, seen in timed_frames(blob):
            samples.append(f.pixels.tobytes())
            ends = start + f.delay_ms
            colours += seen
        payload = b"".join(samples)
        feature = f"frames={len(samples)};ms={ends};rgb={','.join(map(str, colours.tolist()))}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(blob), hashlib.sha256(blob).hexdigest(), feature

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(m.as_py()) for m in batch.column(2)]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "n_bytes", *names])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def frames_of(media: DataFrame) -> DataFrame:
    """One row per frame of `media` (doc_id, media): doc_id, frame, start_ms, delay_ms, width, height, rgba (the rendered canvas) and histogram. A null or unreadable file gives no rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
        names = ["doc_id", "frame", "start_ms", "delay_ms", "width", "height", "rgba", "histogram"]
        for batch in batches:
            for doc_id, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not blob.is_valid:
                    continue
                try:
                    for k, (f, start, rgba, seen) in enumerate(timed_frames(blob.as_py())):
                        values = [doc_id, k, start, f.delay_ms, rgba.shape[1], rgba.shape[0], rgba.tobytes(), seen]
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)
                except ValueError:
                    continue

    return media.select("doc_id", "media").mapInArrow(work, "doc_id long, frame int, start_ms long, delay_ms long, width int, height int, rgba binary, histogram array<bigint>")
