"""Progressive JPEG in numpy: scans accumulate into coefficient arrays, which become full-resolution RGB tensors.

decode() reads progressive files of 8-bit samples with spectral selection and successive approximation, any sampling
factors and restart intervals. A scan whose Huffman tables hold one symbol has every bit at a known place and is read as
one array operation; any other scan is read symbol by symbol.

encode_bytes() stores bytes without loss in the format's own unit, the quantised coefficient: byte b is the AC
coefficient b + 256 of 4:2:0 blocks (63 a block). The offset gives every coefficient the same size category, so such files take the array path. Luma goes as a high-bit
scan for each of two spectral bands and a refinement scan, chroma as one scan each.
"""

from __future__ import annotations

import struct
from bisect import bisect_left

import numpy as np

# The zigzag order of an 8 x 8 block.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])

_SCALE = 1 << 16
_u = np.arange(8)
_BASIS = np.cos((2 * _u[None, :] + 1) * _u[:, None] * np.pi / 16) * np.where(_u[:, None] == 0, np.sqrt(1 / 8), 0.5)
#: (64 coefficients in zigzag order, 64 samples) in whole numbers: float64 sums of them are exact in any order.
IDCT = np.round(np.kron(_BASIS, _BASIS) * _SCALE)[ZIGZAG]

SPLIT, SIZE = 5, 8  # the low band is 1..SPLIT; bits of a coefficient in its first scan


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _stuffed(bits: np.ndarray) -> bytes:
    """Bits as entropy-coded bytes: filled up with ones, a zero after each 0xFF."""
    short = -len(bits) % 8
    raw = np.packbits(np.concatenate([bits, np.ones(short, np.uint8)]) if short else bits)
    return raw.tobytes().replace(b"\xff", b"\xff\x00")


def _scan(component: int, first: int, last: int, high: int, low: int, bits: np.ndarray) -> bytes:
    return _segment(0xDA, bytes([1, component, 0, first, last, high << 4 | low])) + _stuffed(bits)


def _one_symbol(kind: int, symbol: int) -> bytes:
    return _segment(0xC4, bytes([kind << 4, 1, *[0] * 15, symbol]))


def layout(n_bytes: int) -> tuple[int, int]:
    """(MCU columns, MCU rows) whose 6 blocks of 63 bytes hold n_bytes."""
    mcus = max(1, -(-n_bytes // (6 * 63)))
    cols = max(1, int(np.ceil(np.sqrt(mcus))))
    return cols, -(-mcus // cols)


def encode_bytes(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG whose AC coefficients, read by component, row and zigzag order, are payload + 256."""
    cols, rows = layout(len(payload))
    if max(cols, rows) > 4095:
        raise ValueError("payload too large for one image")
    n = cols * rows
    data = np.zeros(6 * n * 63, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    parts = data[: 4 * n * 63], data[4 * n * 63 : 5 * n * 63], data[5 * n * 63 :]
    out = [b"\xff\xd8", _segment(0xDB, bytes([0, *[1] * 64])), _segment(0xC2, struct.pack(">BHHB", 8, rows * 16, cols * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))]
    out += [_one_symbol(0, 0), _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0])), _stuffed(np.zeros(6 * n, np.uint8)), _one_symbol(1, SIZE)]
    luma, chroma = parts[0].reshape(-1, 63), parts[1:]
    own = np.unpackbits(luma.reshape(-1, 1), axis=1).reshape(len(luma), 63, 8)
    bits = np.zeros((len(luma), 63, 1 + SIZE), np.uint8)  # the code 0, then (byte + 256) >> 1, whose top bit is set
    bits[:, :, 1] = 1
    bits[:, :, 2:] = own[:, :, :7]
    out += [_scan(1, 1, SPLIT, 0, 1, bits[:, :SPLIT].reshape(-1)), _scan(1, SPLIT + 1, 63, 0, 1, bits[:, SPLIT:].reshape(-1)), _one_symbol(1, SIZE + 1)]
    for k, part in enumerate(chroma, 2):
        bits = np.zeros((len(part), 2 + SIZE), np.uint8)  # the code 0, then byte + 256
        bits[:, 1] = 1
        bits[:, 2:] = np.unpackbits(part).reshape(-1, 8)
        out.append(_scan(k, 1, 63, 0, 0, bits.reshape(-1)))
    bits = np.zeros((len(luma), 64), np.uint8)  # the code 0 (end of block), then the low bit of each coefficient
    bits[:, 1:] = own[:, :, 7]
    return b"".join([*out, _one_symbol(1, 0), _scan(1, 1, 63, 1, 0, bits.reshape(-1)), b"\xff\xd9"])


class Image:
    """Size, quantisation and accumulated coefficients (zigzag order) of each component."""

    def __init__(self, height: int, width: int, parts: list[dict]):
        self.height, self.width, self.parts = height, width, parts
        self.hmax, self.vmax = max(p["h"] for p in parts), max(p["v"] for p in parts)
        self.mcu_cols, self.mcu_rows = -(-width // (8 * self.hmax)), -(-height // (8 * self.vmax))
        for p in parts:
            p["cols"], p["rows"] = -(-(-(-width * p["h"] // self.hmax)) // 8), -(-(-(-height * p["v"] // self.vmax)) // 8)
            p["wide"], p["high"] = self.mcu_cols * p["h"], self.mcu_rows * p["v"]
            p["coef"] = np.zeros((p["high"] * p["wide"], 64), np.int16)


class _Bits:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def one(self) -> int:
        byte = self.raw[self.at >> 3] if self.at >> 3 < len(self.raw) else 0xFF
        bit = byte >> (7 - (self.at & 7)) & 1
        self.at += 1
        return bit

    def many(self, n: int) -> int:
        x = 0
        for _ in range(n):
            x = x << 1 | self.one()
        return x

    def symbol(self, table: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.one()
            if (n, code) in table:
                return table[n, code]
        raise ValueError("bad Huffman code")

    def signed(self, n: int) -> int:
        x = self.many(n)
        return x if n == 0 or x >> (n - 1) else x - (1 << n) + 1


def _blocks_of(image: Image, parts: list[dict]) -> list[list[tuple[dict, int]]]:
    """The blocks of each MCU of a scan, in order."""
    if len(parts) == 1:
        p = parts[0]
        return [[(p, r * p["wide"] + c)] for r in range(p["rows"]) for c in range(p["cols"])]
    return [[(p, (r * p["v"] + y) * p["wide"] + c * p["h"] + x) for p in parts for y in range(p["v"]) for x in range(p["h"])] for r in range(image.mcu_rows) for c in range(image.mcu_cols)]


def _slow_scan(image: Image, parts: list[dict], dc: list[dict], ac: list[dict], first: int, last: int, high: int, low: int, pieces: list[bytes], every: int) -> None:
    """Any scan, symbol by symbol."""
    mcus = _blocks_of(image, parts)
    which = {id(p): i for i, p in enumerate(parts)}
    step = every or max(1, len(mcus))
    for piece, start in zip(pieces, range(0, len(mcus), step), strict=False):
        bits, before, run = _Bits(piece), [0] * len(parts), 0
        for p, b in (x for m in mcus[start : start + step] for x in m):
            block, i = p["coef"][b], which[id(p)]
            if first == 0:
                if high:
                    block[0] |= bits.one() << low
                else:
                    before[i] += bits.signed(bits.symbol(dc[i]))
                    block[0] = before[i] << low
            elif not high:
                if run:
                    run -= 1
                    continue
                k = first
                while k <= last:
                    r, s = divmod(bits.symbol(ac[i]), 16)
                    if s == 0 and r < 15:
                        run = (1 << r) + bits.many(r) - 1
                        break
                    k += r
                    if s:
                        block[k] = bits.signed(s) << low if s else 0
                    k += 1
            else:
                k = first
                if not run:
                    while k <= last:
                        r, s = divmod(bits.symbol(ac[i]), 16)
                        new = 0
                        if s == 0 and r < 15:
                            run = (1 << r) + bits.many(r)
                            break
                        if s:
                            new = (1 << low) if bits.one() else -(1 << low)
                        while k <= last:
                            if block[k]:
                                _correct(bits, block, k, low)
                            elif r == 0:
                                if new:
                                    block[k] = new
                                k += 1
                                break
                            else:
                                r -= 1
                            k += 1
                if run:
                    while k <= last:
                        if block[k]:
                            _correct(bits, block, k, low)
                        k += 1
                    run -= 1


def _correct(bits: _Bits, block: np.ndarray, k: int, low: int) -> None:
    if bits.one() and not abs(int(block[k])) >> low & 1:
        block[k] += (1 << low) if block[k] > 0 else -(1 << low)


def _fast_scan(image: Image, parts: list[dict], dc: list[dict], ac: list[dict], first: int, last: int, high: int, low: int, piece: bytes) -> bool:
    """A scan whose symbols are all the same; False if it isn't one."""
    if first == 0 and high == 0 and all(set(t.values()) == {0} and (1, 0) in t for t in dc):
        return True  # every difference is zero, and so is every DC coefficient
    if len(parts) != 1 or first == 0 or len(ac[0]) != 1 or (1, 0) not in ac[0]:
        return False
    p, symbol, n = parts[0], ac[0][1, 0], last - first + 1
    if (p["cols"], p["rows"]) != (p["wide"], p["high"]):
        return False
    count, raw = len(p["coef"]), np.frombuffer(piece, np.uint8)
    if not high and 0 < symbol < 16:
        bits = np.unpackbits(raw, count=count * n * (1 + symbol)).reshape(count * n, 1 + symbol)
        if bits[:, 0].any() or not bits[:, 1].all():
            return False
        value = np.packbits(bits[:, max(1, symbol - 7) :].reshape(-1)).astype(np.int16) if symbol >= 8 else bits[:, 1:].astype(np.int16) @ (1 << np.arange(symbol)[::-1]).astype(np.int16)
        for i in range(8, symbol):
            value += bits[:, symbol - i].astype(np.int16) << i
        p["coef"][:, first : last + 1] = (value << low).reshape(count, n)
        return True
    if high and symbol == 0 and (p["coef"][:, first : last + 1] > 0).all():
        bits = np.unpackbits(raw, count=count * (1 + n)).reshape(count, 1 + n)
        if bits[:, 0].any():
            return False
        p["coef"][:, first : last + 1] |= bits[:, 1:].astype(np.int16) << low
        return True
    return False


def _codes(body: bytes) -> tuple[dict[tuple[int, int], int], bytes]:
    counts, rest = body[:16], body[16:]
    table, code, at = {}, 0, 0
    for n, c in enumerate(counts, 1):
        for _ in range(c):
            table[n, code] = rest[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table, rest[at:]


def decode(media: bytes, slow: bool = False) -> Image:
    """All scans of a progressive file, accumulated. slow: take every scan symbol by symbol."""
    if media[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    a = np.frombuffer(media, np.uint8)
    ff = np.flatnonzero(a[:-1] == 255)
    marks = ff[(a[ff + 1] != 0) & (a[ff + 1] != 255)]
    ends = marks[(a[marks + 1] < 0xD0) | (a[marks + 1] > 0xD7)].tolist()
    marks = marks.tolist()
    at, quant, dc, ac, every, image = 2, {}, {}, {}, 0, None
    while True:
        marker = media[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack(">H", media[at + 2 : at + 4])[0]
        body, at = media[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                kind, slot = divmod(body[0], 16)
                (ac if kind else dc)[slot], body = _codes(body[1:])
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            depth, height, width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8:
                raise ValueError("only 8-bit samples")
            image = Image(height, width, [{"id": c, "h": s >> 4, "v": s & 15, "q": q} for c, s, q in (body[6 + 3 * i : 9 + 3 * i] for i in range(n))])
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a progressive file")
        elif marker == 0xDA:
            n = body[0]
            parts = [next(p for p in image.parts if p["id"] == body[1 + 2 * i]) for i in range(n)]
            slots = [body[2 + 2 * i] for i in range(n)]
            first, last, (high, low) = body[1 + 2 * n], body[2 + 2 * n], divmod(body[3 + 2 * n], 16)
            end = ends[bisect_left(ends, at)]
            cuts = [at, *marks[bisect_left(marks, at) : bisect_left(marks, end)], end]
            pieces = [media[s + 2 * (i > 0) : e].replace(b"\xff\x00", b"\xff") for i, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
            tables = [dc.get(s >> 4, {}) for s in slots], [ac.get(s & 15, {}) for s in slots]
            if slow or every or not _fast_scan(image, parts, *tables, first, last, high, low, pieces[0]):
                _slow_scan(image, parts, *tables, first, last, high, low, pieces, every)
            at = end
    for p in image.parts:
        p["quant"] = quant[p["q"]]
    return image


def stored_bytes(image: Image, n: int) -> bytes:
    """What encode_bytes() stored, from the coefficients."""
    return b"".join(p["coef"][:, 1:].astype(np.uint8).tobytes() for p in image.parts)[:n]  # modulo 256


def rgb(image: Image) -> np.ndarray:
    """(height, width, 3) samples: inverse transform, chroma repeated to full resolution, colours converted."""
    planes = []
    for p in image.parts:
        coef = p["coef"] if (p["quant"] == 1).all() else p["coef"] * p["quant"]
        flat = coef.astype(np.float64) @ IDCT  # whole numbers below 2 ** 53: exact
        plane = ((flat.astype(np.int64) + _SCALE // 2 >> 16) + 128).clip(0, 255).astype(np.int32)
        plane = plane.reshape(p["high"], p["wide"], 8, 8).transpose(0, 2, 1, 3).reshape(p["high"] * 8, p["wide"] * 8)
        for axis, times in ((0, image.vmax // p["v"]), (1, image.hmax // p["h"])):
            plane = plane.repeat(times, axis) if times > 1 else plane
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.empty((image.height, image.width, 3), np.uint8)
    out[:, :, 0] = (y + (91881 * cr + 32768 >> 16)).clip(0, 255)
    out[:, :, 1] = (y - (22554 * cb + 46802 * cr + 32768 >> 16)).clip(0, 255)
    out[:, :, 2] = (y + (116130 * cb + 32768 >> 16)).clip(0, 255)
    return out
