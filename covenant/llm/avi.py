"""Media columns: AVI motion-JPEG files, their frames, and shots.

An AVI file is a RIFF tree: a header list, a ``movi`` list of chunks, and an ``idx1``
index of where each chunk starts (an OpenDML index is not read: without ``idx1`` all
chunks of ``movi`` are frames). Frames are baseline JPEG images, decoded without any
other frame: grey ones, and colour ones in one scan, of which all components are decoded
and the brightness is kept. Frames without Huffman tables, as is usual in AVI, have the
standard ones. All scans of a batch are decoded
together: each restart interval is a stream of its own, and one numpy step decodes
the next symbol of every stream.

Any bytes can be stored losslessly: each byte is the level of one 8x8 block, whose DC
coefficient, at a quantiser of 8, is exact. A frame has 64 blocks a row and up to 64
rows; the last is filled up with 0, and the true length stands in an INFO chunk.

Shots are cut where the histograms of two frames differ by more than a threshold that
adapts to the differences just before. Null and empty contents, and files that are
not such AVIs, give no frames and no clips; repeated rows are read alike; an empty
table gives an empty result. Only the key and the named column are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import sliced

#: Blocks in a row (one restart interval), and rows in a frame at most.
ROW, ROWS = 64, 64
FPS = 25
#: Bytes of payload that are coded and decoded together.
BATCH_BYTES = 1 << 20
#: Adaptive cut: a difference over MEAN_TIMES the mean of the last WINDOW ones, and over LEAST_CUT.
WINDOW, MEAN_TIMES, LEAST_CUT, BINS = 8, 2.5, 0.25, 32

# Fixed values of JPEG: DC code lengths (how many codes of 1 to 16 bits) for categories 0 to 11,
# and the order in which an 8x8 block's coefficients are stored.
DC_BITS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
#: The one AC code we write: end of block.
AC_BITS, AC_SYMBOLS = (1, *[0] * 15), (0,)


# The standard Huffman tables (code lengths, symbols) of frames that bring none, by class and number.
STANDARD_TABLES = {
    0x00: ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), bytes(range(12))),
    0x01: ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), bytes(range(12))),
    0x10: (
        (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125),
        bytes.fromhex(
            "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a"
            "535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9ba"
            "c2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
        ),
    ),
    0x11: (
        (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119),
        bytes.fromhex(
            "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a"
            "535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9ba"
            "c2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
        ),
    ),
}


@cache
def zigzag() -> np.ndarray:
    """Place in the block of the k-th stored coefficient: along anti-diagonals, turning at each."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


@cache
def cosines() -> np.ndarray:
    k, x = np.mgrid[0:8, 0:8]
    return np.where(k == 0, np.sqrt(0.125), 0.5 * np.cos((2 * x + 1) * k * np.pi / 16))


def codes(bits: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a canonical Huffman table."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for symbol in symbols[at : at + n]:
            out[symbol] = code, length
            code += 1
        code, at = code << 1, at + n
    return out


def lookup(bits: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """For each 16 bits ahead: 256 * code length + symbol; 0 where no code fits."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, (code, length) in codes(bits, symbols).items():
        table[code << (16 - length) : (code + 1) << (16 - length)] = 256 * length + symbol
    return table


_SHORT: dict[tuple[int, int], np.ndarray] = {}


def short_blocks(dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """For each 16 bits ahead that hold a DC code, its extra bits and an end of block: 65536 * bits + 32768 + difference; else 0."""
    if (key := (id(dc), id(ac))) not in _SHORT:
        bits = np.arange(1 << 16)
        length, size = dc >> 8, np.minimum(dc & 255, 16)
        extra = ((bits << length) & 0xFFFF) >> (16 - size)
        difference = np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)
        close = ac[(bits << (length + size)) & 0xFFFF]
        total = length + size + (close >> 8)
        fits = (length > 0) & (close > 0) & (close & 255 == 0) & (total <= 16)
        _SHORT[key] = np.where(fits, (total << 16) + 0x8000 + difference, 0)
    return _SHORT[key]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@cache
def jpeg_header(rows: int) -> bytes:
    """Everything before the scan of a frame of ROW x rows blocks."""
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xDB, bytes([0]) + bytes([8]) * 64),
            _segment(0xC0, struct.pack(">BHHB3B", 8, 8 * rows, 8 * ROW, 1, 1, 0x11, 0)),
            _segment(0xC4, b"\x00" + bytes(DC_BITS) + bytes(range(12))),
            _segment(0xC4, b"\x10" + bytes(AC_BITS) + bytes(AC_SYMBOLS)),
            _segment(0xDD, struct.pack(">H", ROW)),
            _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
        )
    )


@cache
def _symbols() -> np.ndarray:
    """For each DC difference from -255 on: its code, its extra bits and the end of block as one number; how many bits."""
    table = codes(DC_BITS, tuple(range(12)))
    rows = []
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        code, length = table[size]
        rows.append((((code << size) | (diff if diff >= 0 else diff + (1 << size) - 1)) << 1, length + size + 1))
    return np.array(rows, np.int32).T.copy()


def scans(levels: np.ndarray) -> list[bytes]:
    """The entropy-coded bytes of each row of levels (rows x ROW), without restart markers."""
    diff = np.diff(levels.astype(np.int32), axis=1, prepend=128)
    number, n = _symbols()[:, diff + 255]
    until = np.cumsum(n, axis=1, dtype=np.int32)
    total = (until[:, -1] + 7) // 8
    base = np.cumsum(total, dtype=np.int64) - total
    at = until - n
    number = number << (24 - n - (at & 7))
    where = ((at >> 3) + base[:, None]).ravel()
    out = np.zeros(int(total.sum()) + 4)
    for k in range(3):  # no number has more than 17 bits
        out += np.bincount(where + k, ((number >> (16 - 8 * k)) & 255).ravel(), len(out))
    last = base + total - 1
    out[last] += (1 << (8 * total - until[:, -1])) - 1  # a row is filled up with 1 bits
    raw = out[: int(total.sum())].astype(np.uint8)
    stuffed = np.ones(len(raw), np.int64) + (raw == 255)
    ends = np.cumsum(stuffed)
    wide = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    wide[ends - stuffed] = raw
    whole, cuts = wide.tobytes(), ends[last]
    return [whole[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]


def _frames(rows: list[bytes], height: int) -> list[bytes]:
    """JPEG images of height rows each."""
    out = []
    for at in range(0, len(rows), height):
        parts = [jpeg_header(height)]
        for k, row in enumerate(rows[at : at + height]):
            if k:
                parts.append(bytes((0xFF, 0xD0 + (k - 1) % 8)))
            parts.append(row)
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int, height: int, note: bytes = b"", fps: int = FPS) -> bytes:
    """An AVI file of one MJPG stream with an index."""
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width & 0xFFFF, height & 0xFFFF)
    image = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", 3 * width * height, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", image)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", note)) if note else b""
    body, index, at = [], [], 4
    for frame in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        body.append(_chunk(b"00dc", frame))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + header + info + _chunk(b"LIST", b"movi" + b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks between two offsets; stops at a damaged one."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > end:
            return
        yield name, at + 8, at + 8 + size
        at += 8 + size + size % 2


def read_avi(data: bytes | None) -> dict | None:
    """fps, note and the frames that the index names (all video chunks if it has none); None if it isn't an AVI."""
    if not data or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        return None
    out = {"fps": float(FPS), "note": b"", "frames": [], "width": 0, "height": 0}
    movi, index = None, []
    for name, a, b in _chunks(data, 12, len(data)):
        kind = data[a : a + 4] if name == b"LIST" else b""
        if kind == b"hdrl":
            for inner, x, _ in _chunks(data, a + 4, b):
                if inner == b"avih":
                    fields = struct.unpack_from("<14I", data, x)
                    out |= {"fps": 1e6 / max(1, fields[0]), "width": fields[8], "height": fields[9]}
        elif kind == b"INFO":
            out["note"] = next((data[x:y] for inner, x, y in _chunks(data, a + 4, b) if inner == b"ICMT"), b"")
        elif kind == b"movi":
            movi = a, b
        elif name == b"idx1":
            index = [struct.unpack_from("<4sIII", data, k) for k in range(a, b - 15, 16)]
    if movi:
        places = [(movi[0] + at + 8, movi[0] + at + 8 + size) for name, _, at, size in index if name[2:] in (b"dc", b"db")]
        places = places or [(x, y) for name, x, y in _chunks(data, movi[0] + 4, movi[1]) if name[2:] in (b"dc", b"db")]
        out["frames"] = [data[x:y] for x, y in places]
    return out


@cache
def _tables(bits: bytes, symbols: bytes) -> np.ndarray:
    return lookup(tuple(bits), tuple(symbols))


def parse_jpeg(data: bytes) -> dict | None:
    """Size, components, tables and scan of a baseline image with one scan; None if it is something else.

    pattern has the component of each block of a unit, in order; grid the units across and down.
    """
    out = {"restart": 0, "huffman": {}, "quants": {}}
    frame: list[tuple[int, int, int]] = []
    at = 2
    if data[:2] != b"\xff\xd8":
        return None
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while len(body) >= 65 and body[0] < 16:
                out["quants"][body[0] & 15], body = np.frombuffer(body[1:65], np.uint8).astype(np.int64), body[65:]
        elif marker == 0xC0:
            _, out["height"], out["width"], n = struct.unpack_from(">BHHB", body)
            parts = [body[6 + 3 * k : 9 + 3 * k] for k in range(n)]
            if not out["height"] or not out["width"] or any(len(p) < 3 or not p[1] & 15 or not p[1] >> 4 for p in parts):
                return None
            frame = [(p[0], p[1], p[2]) for p in parts]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return None
        elif marker == 0xC4:
            while len(body) > 16:
                n = sum(body[1:17])
                out["huffman"][body[0]] = _tables(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            return _with_scan(out, frame, body, data[at + 2 + size :].removesuffix(b"\xff\xd9"))
        at += 2 + size
    return None


def _with_scan(out: dict, frame: list[tuple[int, int, int]], header: bytes, scan: bytes) -> dict | None:
    chosen = [(header[1 + 2 * k], header[2 + 2 * k]) for k in range(header[0])] if header and len(header) > 2 * header[0] else []
    if not frame or [name for name, _ in chosen] != [name for name, _, _ in frame]:
        return None  # components in scans of their own
    one = len(frame) == 1
    across, down = (1, 1) if one else (max(f >> 4 for _, f, _ in frame), max(f & 15 for _, f, _ in frame))
    out["sampling"] = (1, 1) if one else (frame[0][1] >> 4, frame[0][1] & 15)
    if out["sampling"] != (across, down):
        return None  # brightness is coarser than colour
    out["pattern"] = (0,) if one else tuple(k for k, (_, f, _) in enumerate(frame) for _ in range((f >> 4) * (f & 15)))
    out["grid"] = -(-out["width"] // (8 * across)), -(-out["height"] // (8 * down))
    huffman = out["huffman"] or {k: _tables(bytes(bits), symbols) for k, (bits, symbols) in STANDARD_TABLES.items()}
    out["tables"] = [huffman.get(key) for _, t in chosen for key in (t >> 4, 16 + (t & 15))]
    out["quant"] = out["quants"].get(frame[0][2], np.ones(64, np.int64))
    out["scan"] = scan
    return None if any(t is None for t in out["tables"]) else out


def decode(images: list[dict], kept: int = 64) -> list[np.ndarray]:
    """The first kept dequantised coefficients (blocks x kept, in stored order) of each parsed image's first component.

    All images must share their Huffman tables and pattern; decode_all() groups them so.
    """
    pattern = np.array(images[0]["pattern"])
    parts = int(pattern.max()) + 1
    sizes = np.array([i["grid"][0] * i["grid"][1] * len(pattern) for i in images])
    each = np.array([i["restart"] * len(pattern) for i in images])
    each = np.where(each, each, sizes)
    raw = np.frombuffer(b"".join(i["scan"] for i in images) + b"\xff" * 8, np.uint8)
    begins = np.cumsum([0, *(len(i["scan"]) for i in images)])
    # after a 255, a 0 is only stuffing, and 0xD0 to 0xD7 end a restart interval
    after = np.flatnonzero(raw[:-1] == 255) + 1
    marks = after[(raw[after] >= 0xD0) & (raw[after] <= 0xD7)]
    keep = np.ones(len(raw), bool)
    keep[after[raw[after] == 0]] = keep[marks] = keep[marks - 1] = False
    line = raw[keep].astype(np.int64)
    starts = np.sort(np.concatenate([begins[:-1], marks + 1]))
    image = np.searchsorted(begins, starts, "right") - 1
    nth = np.arange(len(starts)) - np.searchsorted(starts, begins[:-1])[image]
    left = np.clip(sizes[image] - nth * each[image], 0, each[image])
    total = int(sizes.sum())
    block = (np.cumsum(sizes) - sizes)[image] + nth * each[image]
    out = np.zeros((total, kept), np.int32)
    ahead = np.zeros(len(line) + 1, np.int64)
    ahead[: len(line) - 3] = (line[:-3] << 24) | (line[1:-2] << 16) | (line[2:-1] << 8) | line[3:]
    bit = 8 * (np.cumsum(keep)[starts] - keep[starts])
    ends = np.append(bit[1:], 8 * (len(line) - 8))
    place, levels = np.zeros(len(starts), np.int64), np.zeros((len(starts), parts), np.int64)
    all_tables = np.concatenate(images[0]["tables"])
    turn = block - (np.cumsum(sizes) - sizes)[image]

    def peek(at: np.ndarray, count: int) -> np.ndarray:
        return (ahead[at >> 3] >> (32 - count - (at & 7))) & ((1 << count) - 1)

    # A step decodes a whole block where its DC value and the end of block fit into 16 bits; streams that meet
    # another block leave this loop and go on symbol by symbol below.
    alive = np.flatnonzero(left > 0) if parts == 1 else np.empty(0, np.int64)
    whole = short_blocks(*images[0]["tables"]) if len(alive) else None
    b, at, last, value, end = bit[alive], block[alive], (block + left)[alive], levels[alive, 0], ends[alive]
    while len(alive):
        found = whole[peek(b, 16)]
        ok = (found > 0) & (at < last) & (b <= end)
        if not ok.all():
            stop = alive[~ok]
            bit[stop], left[stop], block[stop], levels[stop, 0] = b[~ok], (last - at)[~ok], at[~ok], value[~ok]
            alive, b, at, last, value, end, found = alive[ok], b[ok], at[ok], last[ok], value[ok], end[ok], found[ok]
        value = value + (found & 0xFFFF) - 0x8000
        out[at, 0] = value
        b = b + (found >> 16)
        at = at + 1
    alive = np.flatnonzero((left > 0) & (bit <= ends))
    while len(alive):
        b, p = bit[alive], place[alive]
        part = pattern[turn[alive] % len(pattern)]
        found = all_tables[peek(b, 16) + 65536 * (2 * part + (p > 0))]
        length, symbol = found >> 8, found & 255
        dc = p == 0
        run, size = np.where(dc, 0, symbol >> 4), np.where(dc, symbol, symbol & 15)
        b = b + length
        extra = peek(b, 16) >> (16 - size)
        value = np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)
        b = b + size
        levels[alive, part] += np.where(dc, value, 0)
        p = p + run
        put = (dc | (size > 0)) & (p < kept)
        out[block[alive][put], p[put]] = np.where(dc, levels[alive, part], value)[put]
        # symbol 0 ends a block, 0xF0 skips 16
        p = np.where(~dc & (size == 0) & (run < 15), 64, p + 1)
        done = p >= 64
        bit[alive], place[alive] = b, np.where(done, 0, p)
        block[alive] += done
        turn[alive] += done
        left[alive] -= done
        alive = alive[(left[alive] > 0) & (length > 0) & (b <= ends[alive])]
    return [_raster(own, x) * x["quant"][:kept] for own, x in zip(np.split(out, np.cumsum(sizes)[:-1]), images, strict=True)]


def _raster(blocks: np.ndarray, image: dict) -> np.ndarray:
    """The first component's blocks, row by row, of an image's blocks in the order of its units; those beyond its edges go."""
    if len(image["pattern"]) == 1:
        return blocks
    (units, rows), (h, v) = image["grid"], image["sampling"]
    own = blocks.reshape(rows, units, len(image["pattern"]), -1)[:, :, : h * v]
    own = own.reshape(rows, units, v, h, -1).transpose(0, 2, 1, 3, 4).reshape(rows * v, units * h, -1)
    return own[: -(-image["height"] // 8), : -(-image["width"] // 8)].reshape(-1, own.shape[2])


def decode_all(frames: list[bytes], kept: int = 64) -> list[np.ndarray | None]:
    """Coefficients of each frame (None: not a baseline image), decoded in groups of equal tables and patterns."""
    parsed = [parse_jpeg(x) for x in frames]
    groups: dict[tuple, list[int]] = {}
    for k, image in enumerate(parsed):
        if image:
            groups.setdefault((image["pattern"], *map(id, image["tables"])), []).append(k)
    out: list[np.ndarray | None] = [None] * len(frames)
    for members in groups.values():
        for k, coefficients in zip(members, decode([parsed[k] for k in members], kept), strict=True):
            out[k] = coefficients
    return out


def pixels(coefficients: np.ndarray, width: int, height: int) -> np.ndarray:
    """8-bit samples of an image from its coefficients."""
    blocks = np.zeros(coefficients.shape, np.float64)
    blocks[:, zigzag()] = coefficients
    c = cosines()
    image = np.rint(c.T @ blocks.reshape(-1, 8, 8) @ c + 128).clip(0, 255).astype(np.uint8)
    across = -(-width // 8)
    return image.reshape(-1, across, 8, 8).swapaxes(1, 2).reshape(-1, 8 * across)[:height, :width]


def block_levels(coefficients: np.ndarray) -> np.ndarray:
    """Mean sample of each block: what the DC coefficient alone gives."""
    return (coefficients[:, 0] // 8 + 128).clip(0, 255).astype(np.uint8)


def payload(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length, and the bytes with 0 appended up to a positive multiple of ROW."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + b"\0" * (ROW - len(raw) if not raw else -len(raw) % ROW)


def encode(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload (a positive multiple of ROW bytes)."""
    heights = [min(ROWS, len(p) // ROW) for p in payloads]
    padded = [p + b"\0" * (-len(p) % (ROW * h)) for p, h in zip(payloads, heights, strict=True)]
    rows = scans(np.frombuffer(b"".join(padded), np.uint8).reshape(-1, ROW))
    out, at = [], 0
    for data, p, h in zip(payloads, padded, heights, strict=True):
        n = len(p) // ROW
        out.append(write_avi(_frames(rows[at : at + n], h), 8 * ROW, 8 * h, b"%d" % len(data)))
        at += n
    return out


def shots(histograms: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of each shot. histograms: a row of shares for each frame."""
    cuts, recent = [0], []
    for k, d in enumerate(0.5 * np.abs(np.diff(histograms, axis=0)).sum(axis=1), 1):
        if d > LEAST_CUT and d > MEAN_TIMES * (sum(recent) / len(recent) if recent else 0):
            cuts.append(k)
            recent = []
        else:
            recent = [*recent[1 - WINDOW :], float(d)]
    return list(zip(cuts, [*cuts[1:], len(histograms)], strict=True)) if len(histograms) else []


def histogram(levels: np.ndarray) -> np.ndarray:
    return np.bincount(levels // (256 // BINS), minlength=BINS) / max(1, len(levels))


def read_clips(files: list[bytes | None]) -> list[tuple[list[np.ndarray], list[tuple[int, int]], float]]:
    """For each file: the block levels of its frames, its shots, its frames a second."""
    parsed = [read_avi(x) for x in files]
    frames = [f for x in parsed if x for f in x["frames"]]
    levels = [block_levels(c) if c is not None else np.empty(0, np.uint8) for c in decode_all(frames, 1)]
    out, at = [], 0
    for x in parsed:
        own = levels[at : at + len(x["frames"])] if x else []
        at += len(own)
        out.append((own, shots(np.array([histogram(f) for f in own])) if own else [], x["fps"] if x else float(FPS)))
    return out


def clips(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, clip, first_frame, n_frames, start_s, end_s: the shots of each AVI file in a binary column."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 16):
            rows = []
            for name, (_, found, fps) in zip(batch["key"].to_pylist(), read_clips(batch["content"].to_pylist()), strict=True):
                rows += [(name, k, a, b - a, a / fps, b / fps) for k, (a, b) in enumerate(found)]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("key", "clip", "first_frame", "n_frames", "start_s", "end_s"), r, strict=True)) for r in rows],
                pa.schema([("key", batch["key"].type), ("clip", pa.int32()), ("first_frame", pa.int64()), ("n_frames", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64())]),
            )

    rows = files.select(F.col(key).alias("key"), F.col(content).alias("content"))
    return rows.mapInArrow(run, f"key {kind}, clip int, first_frame bigint, n_frames bigint, start_s double, end_s double").withColumnRenamed("key", key)


def stored(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key and content: each text's payload as an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 64):
            files = encode([payload(t)[1] for t in batch["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(files, pa.binary())], names=["key", "content"])

    rows = docs.select(F.col(key).alias("key"), F.col(column).alias("text"))
    return rows.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, content binary").withColumnRenamed("key", key)


DIGEST = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
    "media_bytes bigint, media_sha256 string, feature string, n_frames bigint, n_clips bigint"
)


def _digest(n_bytes: int, file: bytes, levels: list[np.ndarray], found: list[tuple[int, int]], fps: float) -> tuple:
    back = b"".join(x.tobytes() for x in levels)[: int(read_avi(file)["note"])]
    feature = ";".join(f"{a / fps:.2f}-{b / fps:.2f}:{int(np.mean([np.mean(x) for x in levels[a:b]]) * 100)}" for a, b in found)
    return (
        n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]),
        len(file), hashlib.sha256(file).hexdigest(), feature, len(levels), len(found),
    )


def round_trip(docs: DataFrame) -> DataFrame:
    """Each text stored as AVI bytes, read back, and described: DIGEST's columns."""

    def some(texts: list[str | None]) -> list[tuple]:
        made = [payload(t) for t in texts]
        files = encode([p for _, p in made])
        return [_digest(n, f, *read) for (n, _), f, read in zip(made, files, read_clips(files), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, rows, part, size = batch["text"].to_pylist(), [], [], 0
            for text in texts:
                part.append(text)
                size += len(text or "")
                if size > BATCH_BYTES:
                    rows += some(part)
                    part, size = [], 0
            rows += some(part) if part else []
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names=[x.split()[0] for x in DIGEST.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, DIGEST)
