"""AVI with motion JPEG: writing, RIFF parsing, intra-frame decoding and shot detection, in numpy.

Payload bytes are stored as quantised DCT coefficients of grey baseline JPEG frames (all quantisers 1), one byte
a coefficient in zigzag order, so that storing is lossless. A byte b is the coefficient b-128, or b-127 from 128
on: never 0, so there are no runs and no ends of block. The Huffman tables of the frames give size s a code of
16-s bits: with its s value bits every coefficient takes two bytes, which numpy encodes and decodes at once. Other
tables, runs and restarts go through the plain decoder.
"""

from __future__ import annotations

import re
import struct

import numpy as np

SIDE, BLOCKS = 32, 16
FRAME = BLOCKS * 64
FPS = 4
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _canonical(bits: list[int], values: list[int]) -> dict[tuple[int, int], int]:
    """(length, code) to symbol, as JPEG derives them from a DHT segment."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out[length, code] = values[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _table(sizes: range) -> tuple[bytes, dict[int, tuple[int, int]]]:
    order = sorted(sizes, reverse=True)
    bits = [sum(16 - s == length for s in order) for length in range(1, 17)]
    return bytes(bits) + bytes(order), {s: (length, code) for (length, code), s in _canonical(bits, order).items()}


DC_SPEC, DC_CODES = _table(range(10))
AC_SPEC, AC_CODES = _table(range(1, 9))


def _word(v: int, codes: dict[int, tuple[int, int]]) -> int:
    s = abs(v).bit_length()
    return codes[s][1] << s | (v if v > 0 else v + (1 << s) - 1) & ((1 << s) - 1)


COEF = np.array([b - 128 if b < 128 else b - 127 for b in range(256)], np.int16)
BYTE = np.zeros(257, np.uint8)
BYTE[COEF + 128] = np.arange(256)
AC_WORD = np.array([_word(int(c), AC_CODES) for c in COEF], np.uint16)
DC_WORD = np.array([_word(d, DC_CODES) for d in range(-256, 257)], np.uint16)
AC_VALUE, DC_VALUE = np.zeros(65536, np.int16), np.zeros(65536, np.int16)
AC_VALUE[AC_WORD], DC_VALUE[DC_WORD] = COEF, np.arange(-256, 257)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


HEAD = (
    b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + _segment(0xC4, b"\x00" + DC_SPEC) + _segment(0xC4, b"\x10" + AC_SPEC) + _segment(0xDA, b"\1\1\0\0\x3f\0")
)
END = b"\xff\xd9"


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def encode_frames(payload: np.ndarray) -> list[bytes]:
    """JPEG frames of bytes; the last is filled up with zeros."""
    n = -(-len(payload) // FRAME)
    x = np.zeros(n * FRAME, np.uint8)
    x[: len(payload)] = payload
    x = x.reshape(n, BLOCKS, 64)
    out = AC_WORD[x]
    out[:, :, 0] = DC_WORD[np.diff(COEF[x[:, :, 0]], axis=1, prepend=0) + 256]
    raw = out.astype(">u2").tobytes()
    size = 2 * FRAME
    return [HEAD + raw[i : i + size].replace(b"\xff", b"\xff\0") + END for i in range(0, n * size, size)]


def write(payload: bytes) -> bytes:
    """An AVI file of a payload whose length its strd chunk holds."""
    frames = encode_frames(np.frombuffer(payload, np.uint8))
    most = max((len(f) for f in frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    strl = b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<Q", len(payload)))
    index, at = [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + (len(f) & 1)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", strl))
    movi = _chunk(b"LIST", b"movi" + b"".join(_chunk(b"00dc", f) for f in frames))
    return _chunk(b"RIFF", b"AVI " + hdrl + movi + _chunk(b"idx1", b"".join(index)))


def chunks(data: bytes, at: int, end: int):
    """(name, start, end) of the chunks in a list."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > end:
            raise ValueError(f"chunk {name!r} at {at} is cut off")
        yield name, at + 8, at + 8 + size
        at += 8 + size + (size & 1)


def _segments(data: bytes):
    """(start, end) of what follows the name of each RIFF list: 'AVI ', and 'AVIX' in files beyond a gigabyte."""
    at = 0
    while data[at : at + 4] == b"RIFF" and data[at + 8 : at + 12] in (b"AVI ", b"AVIX"):
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield at + 12, min(len(data), at + 8 + size)
        at += 8 + size + (size & 1)


def _standard_index(data: bytes, a: int) -> list[tuple[int, int]]:
    """(place, size) of the chunks in an OpenDML index chunk; the highest bit of a size marks frames that are no key frames."""
    longs, _, kind, n, _, base = struct.unpack_from("<HBBIIQ", data, a)
    if kind != 1 or longs != 2:
        raise ValueError("not an index of chunks")
    pairs = struct.unpack_from(f"<{2 * n}I", data, a + 24)
    return [(base + at, size & 0x7FFFFFFF) for at, size in zip(pairs[::2], pairs[1::2], strict=True)]


def read(data: bytes) -> tuple[list[bytes], float, int | None]:
    """(frames in the order of the index, frames a second, payload length) of an AVI file with MJPG video.

    Frames are found by OpenDML indexes if there are any, else by the old index, else by walking through the lists.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, length, movi, old, new, walked = 0.0, None, None, None, [], []
    for segment in _segments(data):
        todo = [(*segment, False)]
        while todo:
            start, end, inside = todo.pop()
            lists = []
            for name, a, b in chunks(data, start, end):
                if name == b"LIST":
                    if data[a : a + 4] == b"movi" and movi is None:
                        movi = a
                    lists.append((a + 4, b, inside or data[a : a + 4] == b"movi"))
                elif name == b"strh" and data[a : a + 4] == b"vids":
                    scale, rate = struct.unpack_from("<II", data, a + 20)
                    fps = rate / scale if scale else 0.0
                elif name == b"strd":
                    length = struct.unpack_from("<Q", data, a)[0]
                elif name == b"idx1":
                    old = [struct.unpack_from("<4sIII", data, i) for i in range(a, b - 15, 16)]
                elif inside and name[:2] == b"ix":
                    if data[a + 8 : a + 12][2:] in (b"dc", b"db"):
                        new += _standard_index(data, a)
                elif inside and name[2:] in (b"dc", b"db"):
                    walked.append(data[a:b])
            todo += lists[::-1]
    if movi is None:
        return [], fps, length
    if new:
        return [data[at : at + size] for at, size in new], fps, length
    if old is None:
        return walked, fps, length
    frames = [(at, size) for name, _, at, size in old if name[2:] in (b"dc", b"db")]
    # Offsets count from the word 'movi', or in some files from the start.
    base = movi if frames and data[movi + frames[0][0] : movi + frames[0][0] + 4][2:] in (b"dc", b"db") else 0
    found = [data[base + at + 8 : base + at + 8 + size] for at, size in frames]
    # The old index of a file of several segments is that of the first.
    return (found if len(found) >= len(walked) else walked), fps, length


#: Fixed values of the JPEG standard, for frames that leave their tables out as motion JPEG may: codes by length, symbols.
#: The symbols of AC tables that are not listed follow in ascending order.
DC_LENGTHS = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], [0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0])
AC_LENGTHS = ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119])
AC_FIRST = (
    "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82",
    "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1",
)


def _standard() -> dict[int, dict[tuple[int, int], int]]:
    every = {0x00, 0xF0} | {run << 4 | size for run in range(16) for size in range(1, 11)}
    out = {}
    for k in range(2):
        first = list(bytes.fromhex(AC_FIRST[k]))
        out[k] = _canonical(DC_LENGTHS[k], list(range(12)))
        out[0x10 | k] = _canonical(AC_LENGTHS[k], first + sorted(every - {*first}))
    return out


STANDARD = _standard()


def _lookup(codes: dict[tuple[int, int], int]) -> tuple[list[int], list[int]]:
    """(length, symbol) by the next 16 bits; length 0 where no code begins so."""
    length, symbol = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
    for (n, code), s in codes.items():
        length[code << (16 - n) : (code + 1) << (16 - n)], symbol[code << (16 - n) : (code + 1) << (16 - n)] = n, s
    return length.tolist(), symbol.tolist()


class _Bits:
    """The bits of a scan between restarts, in place."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.end = raw + b"\0\0\0\0", 0, 8 * len(raw)

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        i = self.at >> 3
        next_ = int.from_bytes(self.raw[i : i + 3], "big") >> (8 - (self.at & 7)) & 0xFFFF
        n = table[0][next_]
        self.at += n
        if not n or self.at > self.end:
            raise ValueError("no such code" if self.at <= self.end else "scan is cut off")
        return table[1][next_]

    def number(self, s: int) -> int:
        if not s:
            return 0
        i = self.at >> 3
        v = int.from_bytes(self.raw[i : i + 4], "big") >> (32 - (self.at & 7) - s) & ((1 << s) - 1)
        self.at += s
        if self.at > self.end:
            raise ValueError("scan is cut off")
        return v if v >> (s - 1) else v - (1 << s) + 1


def decode(frame: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(coefficients in zigzag order by block, quantisers, width, height) of the first component of a baseline JPEG.

    That is grey, or the brightness of colour frames, whose blocks are in the order of the scan. Tables that a frame
    leaves out are the standard's.
    """
    at, tables, quant, parts, width, height, restart = 2, dict(STANDARD), {}, [], 0, 0, 0
    while frame[at + 1] != 0xDA:
        if frame[at] != 0xFF:
            raise ValueError(f"no marker at {at}")
        if frame[at + 1] == 0xFF:  # filling
            at += 1
            continue
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int32)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _canonical([*body[1:17]], [*body[17 : 17 + n]])
                body = body[17 + n :]
        elif marker == 0xC0:
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("eight bits a sample only")
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("baseline only")
        at += 2 + size
    size, n = struct.unpack_from(">H", frame, at + 2)[0], frame[at + 4]
    which = {frame[at + 5 + 2 * k]: frame[at + 6 + 2 * k] for k in range(n)}
    if not parts or n != len(parts):
        raise ValueError("one scan of all components only")
    looked = {k: _lookup(tables[k]) for k in {t >> 4 for t in which.values()} | {0x10 | t & 15 for t in which.values()}}
    data = frame[at + 2 + size : frame.rindex(END)]
    wide, high = (max(p[1] for p in parts), max(p[2] for p in parts)) if n > 1 else (1, 1)
    units = -(-width // (8 * wide)) * -(-height // (8 * high))
    plan = [(k, looked[which[p[0]] >> 4], looked[0x10 | which[p[0]] & 15]) for k, p in enumerate(parts) for _ in range(p[1] * p[2] if n > 1 else 1)]
    out = np.zeros((units * sum(k == 0 for k, _, _ in plan), 64), np.int16)
    block, done = 0, 0
    for piece in re.split(rb"\xff[\xd0-\xd7]", data) if restart else [data]:
        bits, last = _Bits(piece.replace(b"\xff\0", b"\xff")), [0] * n
        for _ in range(min(restart or units, units - done)):
            for part, dc, ac in plan:
                last[part] += bits.number(bits.symbol(dc))
                k, own = 1, [last[part]] + [0] * 63
                while k < 64:
                    rs = bits.symbol(ac)
                    if rs == 0:
                        break
                    k += rs >> 4
                    if k > 63:
                        raise ValueError("run beyond the block")
                    if rs & 15:
                        own[k] = bits.number(rs & 15)
                    k += 1
                if part == 0:
                    out[block] = own
                    block += 1
            done += 1
    if done < units:
        raise ValueError("scan is cut off")
    return out, quant[parts[0][3]], width, height


def coefficients(frames: list[bytes]) -> np.ndarray:
    """Of frames in the geometry of write(): (frame, block, 64)."""
    size = 2 * FRAME
    raw = [f[len(HEAD) : -2].replace(b"\xff\0", b"\xff") if f.startswith(HEAD) else b"" for f in frames]
    if all(len(r) == size for r in raw):
        w = np.frombuffer(b"".join(raw), ">u2").astype(np.uint16).reshape(len(frames), BLOCKS, 64)
        out = AC_VALUE[w]
        out[:, :, 0] = np.cumsum(DC_VALUE[w[:, :, 0]], axis=1)
        return out
    return np.stack([decode(f)[0] for f in frames]).reshape(len(frames), BLOCKS, 64)


def payload(data: bytes) -> bytes:
    """The bytes that write() stored."""
    frames, _, length = read(data)
    return BYTE[coefficients(frames) + 128].tobytes()[:length] if frames else b""


def _basis() -> np.ndarray:
    k = np.arange(8)
    c = np.sqrt(np.where(k == 0, 1 / 8, 2 / 8))[:, None] * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    full = np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)
    return full[ZIGZAG].astype(np.float32)


BASIS = _basis()


def histograms(coefs: np.ndarray) -> np.ndarray:
    """Counts of 16 grey levels in each frame's pixels; in blocks of frames, so that memory stays small."""
    out = np.zeros((len(coefs), 16), np.int64)
    for i in range(0, len(coefs), 256):
        part = coefs[i : i + 256]
        grey = np.clip(part.reshape(-1, 64).astype(np.float32) @ BASIS + 128.5, 0, 255).astype(np.uint8) >> 4
        at = np.repeat(np.arange(len(part)) * 16, part.shape[1] * 64) + grey.ravel()
        out[i : i + 256] = np.bincount(at, minlength=16 * len(part)).reshape(-1, 16)
    return out


def shots(h: np.ndarray) -> list[tuple[int, int, float]]:
    """(first frame, end, mean difference) of the shots among histograms.

    A cut is where the difference to the frame before (half the L1 distance, as a share of the pixels) exceeds
    both 0.1 and the mean of the shot's differences so far by three deviations; the first difference of a shot
    is held against 0.25.
    """
    if not len(h):
        return []
    d = (np.abs(np.diff(h, axis=0)).sum(axis=1) / (2 * h[0].sum())).tolist()
    out, start, n, s, q = [], 0, 0, 0.0, 0.0
    for i, x in enumerate(d, 1):
        limit = max(0.1, s / n + 3 * max(0.0, q / n - (s / n) ** 2) ** 0.5 + 0.02) if n else 0.25
        if x > limit:
            out.append((start, i, s / n if n else 0.0))
            start, n, s, q = i, 0, 0.0, 0.0
        else:
            n, s, q = n + 1, s + x, q + x * x
    return [*out, (start, len(h), s / n if n else 0.0)]
