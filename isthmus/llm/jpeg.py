"""Progressive JPEG (4:2:0, Huffman): a payload writer and a reader of coefficients and RGB.

The writer stores one payload byte in each quantised coefficient, the unit that JPEG keeps losslessly: every byte maps to
a value of magnitude class 8, so all codes have one length. The reader is for any 8-bit progressive Huffman file with one
or three components: it accumulates spectral-selection and successive-approximation scans into coefficient arrays. Scans
whose code positions are known in advance (one code in the table, correction bits) are read by numpy, the others bit by bit.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np

#: Raster index of each zigzag position.
ZIGZAG = np.array([8 * r + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])

BANDS = ((1, 5), (6, 63))
SHIFT = 14


def _idct() -> np.ndarray:
    """(zigzag coefficient, raster sample), scaled by 2**SHIFT to whole numbers: products in float64 are exact, so equal blocks give equal samples."""
    c = np.array([[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
    full = np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)
    return np.rint(full[ZIGZAG] * (1 << SHIFT))


IDCT = _idct()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, number: int, symbols: list[int], length: int) -> bytes:
    """DHT segment of codes that all have one length."""
    return _segment(0xC4, bytes([kind << 4 | number] + [len(symbols) if n == length else 0 for n in range(1, 17)] + symbols))


def _scan(component: int, dc: int, ac: int, ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([1, component, dc << 4 | ac, ss, se, ah << 4 | al]))


def _packed(bits: np.ndarray) -> bytes:
    """Bits to bytes, filled up with ones, with a zero after each 255."""
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")


def _runs(n: int) -> Iterator[tuple[int, int, int]]:
    """End-of-band runs over n blocks: start, blocks, class."""
    at = 0
    while at < n:
        run = min(n - at, 32767)
        yield at, run, run.bit_length() - 1
        at += run


def encode(payload: bytes) -> bytes:
    """The JPEG that holds the payload (a positive multiple of 64 bytes)."""
    blocks = len(payload) // 64
    mcus = -(-blocks // 6)
    wide = math.isqrt(mcus - 1) + 1
    high = -(-mcus // wide)
    m = wide * high
    data = np.zeros((6 * m, 64), np.uint8)
    data[:blocks] = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    parts = {1: data[: 4 * m], 2: data[4 * m : 5 * m], 3: data[5 * m :]}
    out = [
        b"\xff\xd8", _segment(0xFE, b"payload blocks %d" % blocks), _segment(0xDB, bytes([0] + [1] * 64)),
        _segment(0xC2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _table(0, 0, [7], 1), _table(1, 0, [7], 1), _table(1, 1, [r << 4 for r in range(15)], 4), _segment(0xDD, b"\x00\x01"),
    ]
    for k, b in parts.items():
        # with a restart after each block, the difference is the value: 0, then seven bits
        dc = np.full((len(b), 3), 0xFF, np.uint8)
        dc[:, 0] = b[:, 0] >> 1
        dc[:, 2] = 0xD0 + np.arange(len(b)) % 8
        out += [_scan(k, 0, 0, 0, 0, 0, 1), dc.tobytes()[:-2]]
    out.append(_segment(0xDD, b"\x00\x00"))
    for ss, se in BANDS:
        for k, b in parts.items():
            out += [_scan(k, 0, 0, ss, se, 0, 1), (b[:, ss : se + 1] >> 1).tobytes()]
    for k, b in parts.items():
        out += [_scan(k, 0, 0, 0, 0, 1, 0), _packed(b[:, 0] & 1)]
    for k, b in parts.items():
        low = (b[:, 1:] & 1) ^ (b[:, 1:] < 128)
        bits = []
        for at, run, size in _runs(len(b)):
            head = size << size | run - (1 << size)
            bits += [np.array([head >> i & 1 for i in range(3 + size, -1, -1)], np.uint8), low[at : at + run].reshape(-1)]
        out += [_scan(k, 0, 1, 1, 63, 1, 0), _packed(np.concatenate(bits))]
    out.append(b"\xff\xd9")
    return b"".join(out)


class _Bits:
    """Bits of an entropy-coded segment, one at a time or many."""

    def __init__(self, data: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
        self.at = 0

    def take(self, n: int) -> int:
        v = 0
        for b in self.bits[self.at : self.at + n].tolist():
            v = v << 1 | b
        self.at += n
        return v

    def many(self, n: int) -> np.ndarray:
        self.at += n
        return self.bits[self.at - n : self.at]

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        v = n = 0
        while n < 16:
            v, n = v << 1 | int(self.bits[self.at]), n + 1
            self.at += 1
            if (s := codes.get((n, v))) is not None:
                return s
        raise ValueError("no such code")


def _signed(v: int, size: int) -> int:
    return v if size == 0 or v >> (size - 1) else v - (1 << size) + 1


class Image:
    """A parsed file: components as (blocks, 64) coefficients in zigzag order, with sampling and quantisation."""

    def __init__(self, data: bytes) -> None:
        self.comment, self.quant, self.tables, self.restart = b"", {}, {}, 0
        at = 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while at < len(data):
            if data[at] != 0xFF:
                raise ValueError("marker expected")
            marker = data[at + 1]
            if marker == 0xD9:
                break
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                self._quantisation(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xC2:
                self._frame(body)
            elif 0xC0 <= marker <= 0xCF:
                raise ValueError("not a progressive Huffman file")
            elif marker == 0xDA:
                at = self._scan(body, data, at)

    def _quantisation(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, n = body[at] >> 4, body[at] & 15
            self.quant[n] = np.frombuffer(body, ">u2" if wide else "u1", 64, at + 1).astype(np.int64)
            at += 65 + 64 * wide

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            counts, codes, code = body[at + 1 : at + 17], {}, 0
            k = at + 17
            for n, count in enumerate(counts, 1):
                for _ in range(count):
                    codes[n, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            self.tables[body[at]] = codes
            at = k

    def _frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(n)]
        self.hmax, self.vmax = max(p[1] >> 4 for p in parts), max(p[1] & 15 for p in parts)
        self.wide, self.high = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        self.parts = {p[0]: {"h": p[1] >> 4, "v": p[1] & 15, "q": p[2], "coef": np.zeros((self.high * (p[1] & 15), self.wide * (p[1] >> 4), 64), np.int16)} for p in parts}

    def _scan(self, body: bytes, data: bytes, at: int) -> int:
        n = body[0]
        parts = [(self.parts[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
        ss, se, ah, al = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        if n == 1 and self._known(parts[0], ss, se, ah, al, data, at) is not None:
            return self._end
        segments = []
        while True:  # to the next marker that is no restart
            end = at
            while True:
                end = data.index(b"\xff", end)
                if data[end + 1]:
                    break
                end += 2
            segments.append(data[at:end])
            if not 0xD0 <= data[end + 1] <= 0xD7:
                break
            at = end + 2
        grids = [self._grid(p, n) for p, _, _ in parts]
        units = len(grids[0]) if n == 1 else self.wide * self.high
        step = self.restart or units
        for k, segment in enumerate(segments):
            self._decode(parts, grids, range(k * step, min(units, (k + 1) * step)), _Bits(segment), ss, se, ah, al)
        return end

    def _grid(self, part: dict, n: int) -> np.ndarray:
        """Views of the blocks in scan order: those of the picture for one component, by unit if interleaved."""
        c = part["coef"]
        if n == 1:
            high, wide = -(-self.height * part["v"] // (8 * self.vmax)), -(-self.width * part["h"] // (8 * self.hmax))
            return np.stack(np.meshgrid(np.arange(high), np.arange(wide), indexing="ij"), -1).reshape(-1, 1, 2)
        rows, cols = np.meshgrid(np.arange(c.shape[0]), np.arange(c.shape[1]), indexing="ij")
        both = np.stack([rows, cols], -1).reshape(self.high, part["v"], self.wide, part["h"], 2)
        return both.transpose(0, 2, 1, 3, 4).reshape(self.high * self.wide, -1, 2)

    def _known(self, which: tuple, ss: int, se: int, ah: int, al: int, data: bytes, at: int) -> bool | None:
        """Read a scan of one component whose code positions are known ahead; None if they aren't."""
        part, dc, ac = which
        if (self.height * part["v"]) % (8 * self.vmax) or (self.width * part["h"]) % (8 * self.hmax):
            return None
        flat = part["coef"].reshape(-1, 64)
        n = len(flat)
        codes = self.tables.get(dc if ss == 0 else 16 | ac, {})
        if ah == 0 and codes == {(1, 0): 7}:  # a zero and seven bits for each coefficient: never 255
            if ss == 0 and self.restart == 1:
                raw = np.frombuffer(data, np.uint8, 3 * n - 2, at)
                if data[at + 3 * n - 2] != 0xFF or (raw[1::3] != 0xFF).any() or (raw[2::3] & 0xF8 != 0xD0).any() or raw[::3].max() > 127:
                    return None
                v, self._end = raw[::3].astype(np.int16), at + 3 * n - 2
                flat[:, 0] = np.where(v < 64, v - 127, v) << al
                return True
            if ss and not self.restart:
                size = n * (se - ss + 1)
                raw = np.frombuffer(data, np.uint8, size, at)
                if data[at + size] != 0xFF or raw.max() > 127:
                    return None
                v, self._end = raw.reshape(n, -1).astype(np.int16), at + size
                flat[:, ss : se + 1] = np.where(v < 64, v - 127, v) << al
                return True
        return None

    def _decode(self, parts: list, grids: list, units: range, bits: _Bits, ss: int, se: int, ah: int, al: int) -> None:
        if ss == 0:
            if ah and len(parts) == 1:
                g = grids[0][units.start : units.stop, 0]
                parts[0][0]["coef"][g[:, 0], g[:, 1], 0] |= bits.many(len(g)).astype(np.int16) << al
                return
            before = [0] * len(parts)
            for u in units:
                for k, (part, dc, _) in enumerate(parts):
                    for r, c in grids[k][u]:
                        if ah:
                            part["coef"][r, c, 0] |= bits.take(1) << al
                        else:
                            size = bits.symbol(self.tables[dc])
                            before[k] += _signed(bits.take(size), size)
                            part["coef"][r, c, 0] = before[k] << al
            return
        part, _, ac = parts[0]
        codes, grid = self.tables[16 | ac], grids[0]
        u = units.start
        while u < units.stop:
            block = part["coef"][grid[u, 0, 0], grid[u, 0, 1]]
            k, run = ss, 0
            while k <= se:
                rs = bits.symbol(codes)
                zeros, size = rs >> 4, rs & 15
                if size == 0 and zeros < 15:
                    run = (1 << zeros) + bits.take(zeros)
                    break
                value = 0
                if size:
                    value = _signed(bits.take(size), size) << al if not ah else (1 << al if bits.take(1) else -(1 << al))
                if not ah:
                    k += zeros
                    if size:
                        block[k] = value
                    k += 1
                    continue
                while k <= se:  # pass zeros without history, correcting what has some
                    if block[k]:
                        if bits.take(1):
                            block[k] += 1 << al if block[k] > 0 else -(1 << al)
                    elif zeros == 0:
                        block[k] = value
                        k += 1
                        break
                    else:
                        zeros -= 1
                    k += 1
            if run == 0:
                u += 1
                continue
            if ah:  # one bit for each coefficient with a history, here from k and in the other blocks of the run
                self._correct(part["coef"], grid[u : u + 1, 0], k, se, bits, al)
                self._correct(part["coef"], grid[u + 1 : u + run, 0], ss, se, bits, al)
            u += run

    @staticmethod
    def _correct(coef: np.ndarray, at: np.ndarray, ss: int, se: int, bits: _Bits, al: int) -> None:
        if ss > se or not len(at):
            return
        old = coef[at[:, 0], at[:, 1], ss : se + 1]
        which = old != 0
        more = np.zeros(old.shape, np.int16)
        more[which] = bits.many(int(which.sum()))
        coef[at[:, 0], at[:, 1], ss : se + 1] = old + np.where(old > 0, more, -more) * (1 << al)

    def payload(self) -> bytes:
        """The bytes that `encode` stored."""
        flat = np.concatenate([p["coef"].reshape(-1, 64) for p in self.parts.values()])
        flat = flat[: int(self.comment.rsplit(b" ", 1)[1])]
        out = np.where(flat < 0, flat + 255, flat)
        out[:, 0] = np.where(flat[:, 0] < 0, flat[:, 0] + 254, flat[:, 0])
        return out.astype(np.uint8).tobytes()

    def strips(self, most: int = 512) -> Iterator[np.ndarray]:
        """RGB rows, top to bottom, in strips of at most about `most` units, so that memory stays bounded."""
        step = max(1, most // self.wide)
        for top in range(0, self.high, step):
            planes = []
            for p in self.parts.values():
                c = p["coef"][top * p["v"] : (top + step) * p["v"]]
                s = (c.reshape(-1, 64) * self.quant[p["q"]]).astype(np.float64) @ IDCT
                s = np.clip((s.astype(np.int64) + (1 << (SHIFT - 1)) >> SHIFT) + 128, 0, 255).astype(np.int32)
                planes.append((s.reshape(*c.shape[:2], 8, 8).transpose(0, 2, 1, 3).reshape(c.shape[0] * 8, -1), self.vmax // p["v"], self.hmax // p["h"]))
            wide = [np.repeat(np.repeat(x, v, 0), h, 1) if v * h > 1 else x for x, v, h in planes[:1]]
            if len(planes) == 1:
                rgb = np.repeat(wide[0][:, :, None], 3, 2).astype(np.uint8)
            else:
                (cb, v, h), (cr, v2, h2) = planes[1:]
                cb, cr = cb - 128, cr - 128
                red, blue = 91881 * cr + 32768 >> 16, 116130 * cb + 32768 >> 16
                green = -22554 * cb - 46802 * cr + 32768 >> 16 if (v, h) == (v2, h2) else None
                if green is None:
                    raise ValueError("chroma planes differ in sampling")
                rgb = np.empty((*wide[0].shape, 3), np.uint8)
                for k, add in enumerate((red, green, blue)):
                    rgb[:, :, k] = np.clip(wide[0] + np.repeat(np.repeat(add, v, 0), h, 1), 0, 255)
            yield rgb[: self.height - top * 8 * self.vmax, : self.width]

    def rgb(self) -> np.ndarray:
        """The full-resolution (height, width, 3) tensor."""
        return np.concatenate(list(self.strips()))
