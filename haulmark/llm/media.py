"""Media columns: baseline JPEG written and read in numpy, with DC-only luminance thumbnails.

A payload byte is kept as one flat 8x8 block: with a DC quantiser of 8 the quantised DC
coefficient of a block of value v is v - 128 exactly, so the stored file is lossless for its
payload. Rows are 64 blocks wide; every block row is a restart interval, which lets the reader
decode all intervals side by side. Payloads over `MAX_ROWS` block rows become several JPEG
streams, one after the other.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_chunks, small_batches, text_bytes

ROW = 64
MAX_ROWS = 8191  # of 8 pixels: a JPEG has 65535 lines at most
#: Bytes of text that one numpy pass handles.
CHUNK = 1 << 19
QUANTISER = 8
#: Code counts by length and symbols of the standard luminance DC table (ITU-T T.81, K.3).
DC_COUNTS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_SYMBOLS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
#: End-of-block is the only AC symbol: one bit.
AC_COUNTS = [1] + [0] * 15
AC_SYMBOLS = [0]


def _codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol -> (code, length)."""
    out, code, i = {}, 0, 0
    for length, count in enumerate(counts, 1):
        for symbol in symbols[i : i + count]:
            out[symbol] = (code, length)
            code += 1
        i += count
        code <<= 1
    return out


def _lookup(counts: list[int], symbols: list[int]) -> np.ndarray:
    """For each 16-bit peek: length * 256 + symbol; 0 where no code fits."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, (code, length) in _codes(counts, symbols).items():
        at = code << (16 - length)
        table[at : at + (1 << (16 - length))] = length * 256 + symbol
    return table


def _encode_tables() -> tuple[np.ndarray, np.ndarray]:
    """By DC difference + 255: the bits of a whole block (DC code, magnitude, end-of-block), and their number."""
    codes, (end, end_len) = _codes(DC_COUNTS, DC_SYMBOLS), _codes(AC_COUNTS, AC_SYMBOLS)[0]
    bits, lens = np.zeros(511, np.uint64), np.zeros(511, np.uint64)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        code, length = codes[size]
        magnitude = diff if diff >= 0 else diff + (1 << size) - 1
        bits[diff + 255] = (((code << size) | magnitude) << end_len) | end
        lens[diff + 255] = length + size + end_len
    return bits, lens


BITS, LENS = _encode_tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    return b"".join((
        b"\xff\xd8",
        _segment(0xDB, b"\0" + bytes([QUANTISER] * 64)),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, ROW * 8, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\x00" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS)),
        _segment(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS)),
        _segment(0xDD, struct.pack(">H", ROW)),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ))


def _pack(samples: np.ndarray) -> list[bytes]:
    """The entropy-coded bytes of each row of 64 samples, stuffed and padded with ones."""
    n = len(samples)
    dc = samples.astype(np.int32) - 128
    diff = np.diff(dc, axis=1, prepend=0) + 255
    bits, lens = BITS[diff], LENS[diff]
    for _ in range(2):  # a block has 15 bits at most: four of them fit in 64
        bits = (bits[:, 0::2] << lens[:, 1::2]) | bits[:, 1::2]
        lens = lens[:, 0::2] + lens[:, 1::2]
    total = lens.sum(1)
    n_bytes = ((total + np.uint64(7)) // np.uint64(8)).astype(np.int64)
    starts = np.zeros(n, np.int64)
    np.cumsum((n_bytes[:-1] + 7) // 8, out=starts[1:])
    words = np.zeros(int(starts[-1] + (n_bytes[-1] + 7) // 8) + 1, np.uint64)
    ends = np.cumsum(lens, axis=1)
    at = (ends - lens).astype(np.int64) + starts[:, None] * 64
    word, off = at >> 6, (at & 63).astype(np.uint64)
    room = np.uint64(64) - off
    over = lens > room
    spill = np.where(over, lens - room, 0).astype(np.uint64)
    high = np.where(over, bits >> spill, bits << np.where(over, np.uint64(0), room - lens))
    np.add.at(words, word.ravel(), high.ravel())
    low = bits[over] << (np.uint64(64) - spill[over])
    np.add.at(words, word[over] + 1, low)
    pad = (n_bytes * 8 - total.astype(np.int64)).astype(np.uint64)
    last = starts * 64 + total.astype(np.int64)
    np.add.at(words, last >> 6, np.where(pad > 0, ((np.uint64(1) << pad) - np.uint64(1)) << (np.uint64(64) - (last & 63).astype(np.uint64) - pad), np.uint64(0)))
    raw = words.astype(">u8").tobytes()
    return [raw[s * 8 : s * 8 + k].replace(b"\xff", b"\xff\x00") for s, k in zip(starts.tolist(), n_bytes.tolist(), strict=True)]


def pad_payload(data: bytes) -> bytes:
    """`data` with zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % ROW or (0 if data else ROW))


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """One stored form each; payloads have positive multiples of 64 bytes."""
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW)
    scans = _pack(samples) if len(samples) else []
    out, at = [], 0
    for p in payloads:
        parts, rows = [], len(p) // ROW
        for first in range(0, rows, MAX_ROWS):
            some = scans[at + first : at + min(rows, first + MAX_ROWS)]
            parts.append(_header(len(some)))
            for i, scan in enumerate(some):
                parts.append(scan if i == len(some) - 1 else scan + bytes((0xFF, 0xD0 + i % 8)))
            parts.append(b"\xff\xd9")
        at += rows
        out.append(b"".join(parts))
    return out


@dataclass
class Frame:
    """What the markers of one JPEG stream say, and where its scan lies."""

    width: int = 0
    height: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quantisers: dict[int, int] = field(default_factory=dict)  # of DC
    tables: dict[int, np.ndarray] = field(default_factory=dict)  # class * 16 + id
    restart: int = 0
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # index of part, DC table, AC table
    data: tuple[int, int] = (0, 0)


_TABLES: dict[bytes, np.ndarray] = {}


def parse_frames(media: bytes) -> list[Frame]:
    """The JPEG streams in `media`. ValueError for what is no baseline JPEG of one scan."""
    frames, at = [], 0
    while at < len(media):
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("no JPEG start")
        at, frame = at + 2, Frame()
        while True:
            if len(media) < at + 2 or media[at] != 0xFF:
                raise ValueError("no JPEG marker")
            marker = media[at + 1]
            if marker == 0xD9:
                at += 2
                break
            size = int.from_bytes(media[at + 2 : at + 4], "big")
            body, at = media[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xC0:
                _, frame.height, frame.width, n = struct.unpack(">BHHB", body[:6])
                frame.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not baseline")
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    frame.quantisers[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    counts = list(body[1:17])
                    whole = body[: 17 + sum(counts)]
                    if whole[1:] not in _TABLES:
                        _TABLES[whole[1:]] = _lookup(counts, list(whole[17:]))
                    frame.tables[whole[0]] = _TABLES[whole[1:]]
                    body = body[len(whole) :]
            elif marker == 0xDD:
                frame.restart = int.from_bytes(body, "big")
            elif marker == 0xDA:
                ids = [p[0] for p in frame.parts]
                frame.scan = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                end = at
                while True:  # the next marker that is neither stuffing nor a restart
                    end = media.find(b"\xff", end)
                    if end < 0 or end + 1 >= len(media):
                        raise ValueError("scan without end")
                    if media[end + 1] and not 0xD0 <= media[end + 1] <= 0xD7:
                        break
                    end += 2
                frame.data, at = (at, end), end
        frames.append(frame)
    return frames


def _intervals(media: bytes, frame: Frame) -> list[bytes]:
    """The restart intervals of the scan, unstuffed."""
    raw, cuts, at = media[frame.data[0] : frame.data[1]], [0], 0
    marks = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero((marks[:-1] == 0xFF) & (marks[1:] >= 0xD0) & (marks[1:] <= 0xD7)) if len(raw) > 1 else []
    cuts = [0, *(int(x) + 2 for x in at), len(raw) + 2]
    return [raw[a : b - 2].replace(b"\xff\x00", b"\xff") for a, b in zip(cuts, cuts[1:], strict=False)]


def _decode(intervals: list[bytes], layout: list[tuple[int, np.ndarray, np.ndarray]], mcus: np.ndarray) -> list[np.ndarray]:
    """Quantised DC of the blocks of each part: one array (interval, block) by index of part.

    layout: for each block of an MCU its part, DC table and AC table; mcus: MCUs of each interval.
    """
    lens = np.fromiter(map(len, intervals), np.int64, len(intervals))
    starts = np.concatenate(([0], np.cumsum(lens + 4)))[:-1]
    raw = np.frombuffer(b"".join(x + b"\xff\xff\xff\xff" for x in intervals) + b"\xff" * 8, np.uint8).astype(np.uint32)
    peek = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    limit = (starts + lens + 3) * 8
    at, n, most = starts * 8, len(intervals), int(mcus.max())
    per = [sum(p == k for p, _, _ in layout) for k in range(max(p for p, _, _ in layout) + 1)]
    out = [np.zeros((n, most * k), np.int32) for k in per]
    dc = np.zeros((len(per), n), np.int32)
    seen = [0] * len(per)

    def bits(pos: np.ndarray) -> np.ndarray:
        return (peek[pos >> 3] >> (16 - (pos & 7)).astype(np.uint32)) & 0xFFFF

    def value(raw_bits: np.ndarray, size: np.ndarray) -> np.ndarray:
        v = (raw_bits >> (16 - size).astype(np.uint32)).astype(np.int32)
        half = np.int32(1) << np.maximum(size - 1, 0)
        return np.where((size > 0) & (v < half), v - (half << 1) + 1, v)

    for mcu in range(most):
        live = np.flatnonzero(mcus > mcu) if (mcus <= mcu).any() else slice(None)
        pos = at[live]
        for part, dc_table, ac_table in layout:
            code = dc_table[bits(pos)]
            if not code.all():
                raise ValueError("bad DC code")
            size = code & 255
            pos = pos + (code >> 8)
            dc[part, live] += value(bits(pos), size)
            pos = pos + size
            out[part][live, seen[part]] = dc[part, live]
            seen[part] += 1
            code = ac_table[bits(pos)]  # AC coefficients are skipped
            pos = pos + (code >> 8)
            if not code.all():
                raise ValueError("bad AC code")
            left = np.flatnonzero(code & 255)
            index = np.ones(len(pos), np.int32)
            while len(left):
                run, size = (code[left] & 255) >> 4, code[left] & 15
                pos[left] += size
                index[left] += run + 1
                left = left[index[left] < 64]
                if not len(left):
                    break
                code[left] = ac_table[bits(pos[left])]
                if not code[left].all():
                    raise ValueError("bad AC code")
                pos[left] += code[left] >> 8
                left = left[(code[left] & 255) != 0]
        if (pos > limit[live]).any():
            raise ValueError("scan ends early")
        at[live] = pos
    return out


@dataclass
class Thumbnail:
    width: int
    height: int
    luma: np.ndarray  # a sample for each 8x8 block of the first part


def decode_many(media: list[bytes]) -> list[list[Thumbnail]]:
    """The DC-only luminance thumbnails of the JPEG streams in each stored form."""
    frames = [(i, f) for i, m in enumerate(media) for f in parse_frames(m)]
    groups: dict[tuple, list[int]] = {}
    for k, (_, f) in enumerate(frames):
        key = (tuple((f.parts[p][1], f.parts[p][2], id(f.tables[dc]), id(f.tables[16 + ac])) for p, dc, ac in f.scan),)
        groups.setdefault(key, []).append(k)
    done: list[Thumbnail | None] = [None] * len(frames)
    for members in groups.values():
        first = frames[members[0]][1]
        if len(first.parts) == 1:
            first.parts = [(first.parts[0][0], 1, 1, first.parts[0][3])]
        layout = [(p, first.tables[dc], first.tables[16 + ac]) for p, dc, ac in first.scan for _ in range(first.parts[p][1] * first.parts[p][2])]
        intervals, mcus, shapes = [], [], []
        for k in members:
            i, f = frames[k]
            own = _intervals(media[i], f)
            h, v = (1, 1) if len(f.parts) == 1 else (max(p[1] for p in f.parts), max(p[2] for p in f.parts))
            across, down = -(-f.width // (8 * h)), -(-f.height // (8 * v))
            total, step = across * down, f.restart or across * down
            if len(own) != -(-total // step):
                raise ValueError("restart intervals are missing")
            intervals += own
            mcus += [min(step, total - x) for x in range(0, total, step)]
            shapes.append((k, len(own), across, down, total, step))
        planes, at = _decode(intervals, layout, np.array(mcus)), 0
        for k, n, across, down, total, step in shapes:
            f = frames[k][1]
            _, h, v, q = f.parts[0]
            if len(f.parts) == 1:
                h = v = 1
            flat = planes[0][at : at + n, : step * h * v].ravel()[: total * h * v]
            at += n
            blocks = flat.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            luma = np.clip(blocks * f.quantisers.get(q, 1) // 8 + 128, 0, 255).astype(np.uint8)
            done[k] = Thumbnail(f.width, f.height, luma[: -(-f.height // 8), : -(-f.width // 8)])
    out: list[list[Thumbnail]] = [[] for _ in media]
    for (i, _), thumb in zip(frames, done, strict=True):
        out[i].append(thumb)
    return out


def difference_hash(luma: np.ndarray) -> str:
    """64 bits: whether each cell of an 8x9 sampling of the thumbnail is darker than its right one."""
    rows = np.arange(8) * luma.shape[0] // 8
    cols = np.arange(9) * luma.shape[1] // 9
    cells = luma[np.ix_(rows, cols)]
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def _chunked(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, bytes, np.ndarray]]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(column))
        for i, j in row_chunks(offsets, CHUNK):
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]].tobytes(), offsets[i : j + 1] - offsets[i]


def encode_column(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, media, n_bytes): the text of each row as a stored JPEG, and its bytes unpadded.

    Null and empty texts are stored as 64 zero bytes; very long texts become several streams of one
    file; equal texts have equal media; repeated rows are stored each; null keys stay null; other
    columns are left out; an empty table gives an empty table.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in _chunked(batches, 1):
            cuts = offsets.tolist()
            stored = encode_payloads([pad_payload(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])
            yield pa.record_batch([rows.column(0), pa.array(stored, pa.binary()), pa.array(np.diff(offsets))], ["key", "media", "n_bytes"])

    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text)).mapInArrow(per_batch, f"key {kind}, media binary, n_bytes long")
    return out.withColumnRenamed("key", key)


def read_column(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads stored JPEGs back: dimensions, thumbnail hashes and the payload that the thumbnails hold.

    Keeps `key` and `n_bytes`. A file of several streams has its dimensions joined by '+'. Null
    media or what is no baseline JPEG fails the job with a ValueError: stored bytes are never skipped.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for i, j in row_chunks(offsets, 2 * CHUNK):
                rows = batch.slice(i, j - i)
                media = rows.column(1).to_pylist()
                out = []
                for own, thumbs in zip(media, decode_many(media), strict=True):
                    payload = b"".join(t.luma.tobytes() for t in thumbs)
                    size = "+".join(f"{t.width}x{t.height}" for t in thumbs)
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(own), hashlib.sha256(own).hexdigest(), f"{size}:{''.join(difference_hash(t.luma) for t in thumbs)}"))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.record_batch([rows.column(0), rows.column(2), *columns], names)

    small_batches(stored.sparkSession)
    kind = stored.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select(F.col(key).alias("key"), "media", "n_bytes").mapInArrow(per_batch, schema).withColumnRenamed("key", key)
