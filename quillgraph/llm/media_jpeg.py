"""Operator 1: media columns of progressive JPEG.

The decoder follows ITU T.81 for progressive Huffman images of one or three
components: every scan adds a band of coefficients (spectral selection) or one
more bit of them (successive approximation) to the coefficient arrays; then
blocks are inverse-transformed in numpy, chroma is upsampled to full resolution
and the RGB tensor is stored beside the bytes.

JPEG is lossless in its coefficients, so these carry payload bytes: byte b is
the quantised coefficient b for b >= 128, else b - 255.  All of them are of
magnitude category 8, which makes the entropy-coded scans of regular width: the
decoder reads such scans as arrays and any other by symbols.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import slices, written

UNIT = 192
#: Rows and columns of the 64 coefficients in zigzag order, from the rule: along
#: antidiagonals, upwards on even ones.
ZIGZAG = np.array([8 * r + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])
_C = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: Zigzag-ordered coefficients of a block times this matrix are its 64 samples.
_INVERSE = np.einsum("ux,vy->uvxy", _C, _C).reshape(64, 64)[ZIGZAG].astype(np.float32)
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S)
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")
_WIDE_MCUS = 64
MAX_RUN = 32767


# ---------------------------------------------------------------- encoder


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, ident: int, symbols: bytes, length: int) -> bytes:
    counts = bytearray(16)
    counts[length - 1] = len(symbols)
    return bytes([kind << 4 | ident]) + bytes(counts) + symbols


def _packed(bits: np.ndarray) -> bytes:
    """Bits, filled up with ones, with zero bytes stuffed after 0xFF."""
    if fill := -len(bits) % 8:
        bits = np.concatenate((bits, np.ones(fill, np.uint8)))
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _scan(parts: list[tuple[int, int, int]], first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    head = bytes([len(parts)]) + b"".join(bytes([c, dc << 4 | ac]) for c, dc, ac in parts) + bytes([first, last, high << 4 | low])
    return _segment(0xDA, head) + data


def grid(n_bytes: int) -> tuple[int, int]:
    """Rows and columns of MCUs (six blocks each) that hold so many bytes."""
    mcus = -(-n_bytes // 384)
    rows = min(-(-mcus // _WIDE_MCUS), 4095)
    return rows, -(-mcus // rows)


def _mcu_order(rows: int, cols: int) -> np.ndarray:
    """Indexes of all blocks (luma raster, then both chroma rasters) as an interleaved scan has them."""
    y = np.arange(4 * rows * cols).reshape(rows, 2, cols, 2).transpose(0, 2, 1, 3).reshape(-1, 4)
    c = 4 * rows * cols + np.arange(rows * cols)[:, None]
    return np.hstack((y, c, c + rows * cols)).ravel()


def encode(payload: bytes) -> bytes:
    """A progressive 4:2:0 image whose coefficients are the payload.

    Luma blocks, then the blocks of each chroma component, are filled in raster
    order; what is left over holds spaces.  A comment holds the payload's length.
    """
    rows, cols = grid(len(payload))
    n_mcus = rows * cols
    b = np.full(n_mcus * 384, 32, np.uint8)
    b[: len(payload)] = np.frombuffer(payload, np.uint8)
    b = b.reshape(-1, 64)
    parts = (b[: 4 * n_mcus], b[4 * n_mcus : 5 * n_mcus], b[5 * n_mcus :])
    out = [
        b"\xff\xd8",
        _segment(0xFE, b"payload" + struct.pack(">Q", len(payload))),
        _segment(0xDB, b"\x00" + b"\x01" * 64),
        _segment(0xC2, struct.pack(">BHHB", 8, 16 * rows, 16 * cols, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00"),
        # direct-current categories 0-11 in 4 bits; one symbol, category 7, in 1 bit; runs of ended blocks in 4 bits
        _segment(0xC4, _huffman(0, 0, bytes(range(12)), 4) + _huffman(1, 0, b"\x07", 1) + _huffman(1, 1, bytes(range(0, 0xF0, 16)), 4)),
    ]
    order = _mcu_order(rows, cols)
    dc = b[:, 0].astype(np.int32)
    value = np.where(dc < 128, dc - 255, dc)
    interleaved = (value >> 1)[order].reshape(-1, 6)
    diff = np.empty_like(interleaved)
    luma = interleaved[:, :4].ravel()
    diff[:, :4] = np.diff(luma, prepend=0).reshape(-1, 4)
    diff[:, 4] = np.diff(interleaved[:, 4], prepend=0)
    diff[:, 5] = np.diff(interleaved[:, 5], prepend=0)
    diff = diff.ravel()
    size = np.ceil(np.log2(np.abs(diff) + 1)).astype(np.int32)
    code = (size << size) | np.where(diff < 0, diff + (1 << size) - 1, diff)
    wide = ((code << (12 - size)).astype(">u2")).view(np.uint8).reshape(-1, 2)
    bits = np.unpackbits(wide, axis=1)
    out.append(_scan([(1, 0, 0), (2, 0, 0), (3, 0, 0)], 0, 0, 0, 1, _packed(bits[np.arange(16) < (4 + size)[:, None]])))
    # a coefficient of the first scans is the bit 0 and the upper 7 bits of its byte
    half = b >> 1
    n = 4 * n_mcus
    for c, x, bands in ((1, half[:n], ((1, 5), (6, 63))), (2, half[n : n + n_mcus], ((1, 63),)), (3, half[n + n_mcus :], ((1, 63),))):
        for lo, hi in bands:
            out.append(_scan([(c, 0, 0)], lo, hi, 0, 1, x[:, lo : hi + 1].tobytes()))
    out.append(_scan([(1, 0, 0), (2, 0, 0), (3, 0, 0)], 0, 0, 1, 0, _packed((value & 1).astype(np.uint8)[order])))
    for c, x in zip((1, 2, 3), parts, strict=True):
        low = ((x[:, 1:] & 1) ^ (x[:, 1:] < 128)).astype(np.uint8)
        bits = []
        for i in range(0, len(low), MAX_RUN):
            run = low[i : i + MAX_RUN]
            k = len(run).bit_length() - 1
            head = f"{k:04b}" + (f"{len(run) - (1 << k):0{k}b}" if k else "")
            bits += [np.frombuffer(head.encode(), np.uint8) - 48, run.ravel()]
        out.append(_scan([(c, 0, 1)], 1, 63, 1, 0, _packed(np.concatenate(bits))))
    return b"".join(out) + b"\xff\xd9"


# ---------------------------------------------------------------- decoder


class _Bits:
    """Entropy-coded bits: single reads and reads of many at once."""

    def __init__(self, raw: bytes):
        self.raw = raw.replace(b"\xff\x00", b"\xff")
        self.end = 8 * len(self.raw)
        self.padded = np.frombuffer(self.raw + bytes(8), np.uint8)
        self.at = 0

    def peek16(self) -> int:
        i = self.at >> 3
        p = self.padded
        return (int(p[i]) << 16 | int(p[i + 1]) << 8 | int(p[i + 2])) >> (8 - (self.at & 7)) & 0xFFFF

    def take(self, n: int) -> int:
        if not n:
            return 0
        if self.at + n > self.end:
            raise ValueError("a scan ends early")
        x = self.peek16() >> (16 - n)
        self.at += n
        return x

    def symbol(self, table: _Table) -> int:
        x = table.lookup[self.peek16()]
        if x < 0 or self.at >= self.end:
            raise ValueError("no such code")
        self.at += x >> 8
        return x & 255

    def many(self, n: int) -> np.ndarray:
        """The next n bits as an array."""
        if self.at + n > self.end:
            raise ValueError("a scan ends early")
        i, shift = self.at >> 3, self.at & 7
        bits = np.unpackbits(self.padded[i : (self.at + n + 7) >> 3])[shift : shift + n]
        self.at += n
        return bits

    def windows(self) -> list[int]:
        """The 32 bits from each bit on (fewer at the end)."""
        p = self.padded
        wide = np.zeros(len(self.raw), np.uint64)
        for k in range(5):
            wide = wide << np.uint64(8) | p[k : k + len(self.raw)].astype(np.uint64)
        return ((wide[:, None] >> (np.uint64(8) - np.arange(8, dtype=np.uint64))) & np.uint64(0xFFFFFFFF)).ravel().tolist()


class _Table:
    """A Huffman table: for 16 bits ahead, the length and symbol of the code there."""

    known: dict[bytes, _Table] = {}

    def __init__(self, counts: bytes, symbols: bytes):
        look = np.full(1 << 16, -1, np.int32)
        code = at = 0
        for n, count in enumerate(counts, 1):
            for s in symbols[at : at + count]:
                look[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
                code += 1
            at += count
            code <<= 1
        self.lookup = look.tolist()
        self.only = symbols[0] if len(symbols) == 1 and counts[0] == 1 else None

    @classmethod
    def of(cls, counts: bytes, symbols: bytes) -> _Table:
        key = counts + symbols
        if key not in cls.known:
            if len(cls.known) > 64:
                cls.known.clear()
            cls.known[key] = cls(counts, symbols)
        return cls.known[key]


@dataclass
class _Component:
    ident: int
    h: int
    v: int
    quant: int
    rows: int = 0  # blocks, of whole MCUs
    cols: int = 0
    real_rows: int = 0  # blocks that a scan of this component alone has
    real_cols: int = 0
    coefs: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


def _extend(x: int, size: int) -> int:
    return x if not size or x >> (size - 1) else x - (1 << size) + 1


@dataclass
class Image:
    """What the scans gave: coefficients in zigzag order by component, and samples."""

    height: int
    width: int
    components: list[_Component]
    quants: dict[int, np.ndarray]
    comment: bytes

    def planes(self) -> list[np.ndarray]:
        """Samples of each component at its own resolution, of whole MCUs."""
        out = []
        for c in self.components:
            x = c.coefs.astype(np.float32)
            q = self.quants[c.quant]
            if (q != 1).any():
                x *= q
            s = x @ _INVERSE
            s += np.float32(128.5)
            np.clip(s, 0, 255, out=s)
            out.append(s.astype(np.uint8).reshape(c.rows, c.cols, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.rows, 8 * c.cols))
        return out

    def rgb(self) -> np.ndarray:
        """The height x width x 3 tensor; chroma is upsampled by repetition."""
        hs, vs = max(c.h for c in self.components), max(c.v for c in self.components)
        full = [np.repeat(np.repeat(p, vs // c.v, 0), hs // c.h, 1)[: self.height, : self.width] for p, c in zip(self.planes(), self.components, strict=True)]
        if len(full) == 1:
            return np.repeat(full[0][:, :, None], 3, 2)
        y, cb, cr = (p.astype(np.float32) for p in full)
        cb -= 128
        cr -= 128
        out = np.empty((self.height, self.width, 3), np.uint8)
        for k, x in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
            x += np.float32(0.5)
            out[:, :, k] = np.clip(x, 0, 255, out=x)
        return out


def decode(data: bytes) -> Image:
    """Accumulates all scans of a progressive image."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, quants, tables, image, interval, comment = 2, {}, {}, None, 0, b""
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(data) and data[at : at + 2] != b"\xff\xd9":
            raise ValueError("the image ends early")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide, k = body[i] >> 4, body[i] & 15
                quants[k] = np.frombuffer(body, ">u2" if wide else ">u1", 64, i + 1).astype(np.float32)
                i += 129 if wide else 65
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                counts = body[i + 1 : i + 17]
                n = sum(counts)
                tables[body[i]] = _Table.of(counts, body[i + 17 : i + 17 + n])
                i += 17 + n
        elif marker == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif marker == 0xFE:
            comment = body
        elif marker == 0xC2:
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or n not in (1, 3):
                raise ValueError("8 bits and one or three components are supported")
            comps = [_Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            hs, vs = max(c.h for c in comps), max(c.v for c in comps)
            for c in comps:
                c.rows, c.cols = -(-height // (8 * vs)) * c.v, -(-width // (8 * hs)) * c.h
                c.real_rows, c.real_cols = -(-(-(-height * c.v // vs)) // 8), -(-(-(-width * c.h // hs)) // 8)
                c.coefs = np.zeros((c.rows * c.cols, 64), np.int32)
            image = Image(height, width, comps, quants, comment)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only progressive Huffman images are supported")
        elif marker == 0xDA:
            if image is None:
                raise ValueError("a scan before the frame")
            m = _MARKER.search(data, at)
            end = m.start() if m else len(data)
            _read_scan(image, body, data[at:end], tables, interval)
            at = end
    if image is None:
        raise ValueError("no progressive frame")
    image.comment = comment
    return image


def _read_scan(image: Image, head: bytes, raw: bytes, tables: dict[int, _Table], interval: int) -> None:
    n = head[0]
    by = {c.ident: c for c in image.components}
    parts = [(by[head[1 + 2 * k]], head[2 + 2 * k] >> 4, head[2 + 2 * k] & 15) for k in range(n)]
    lo, hi, approx = head[1 + 2 * n : 4 + 2 * n]
    high, low = approx >> 4, approx & 15
    if n > 1:
        units = [_order_of(c, image) for c, _, _ in parts]
        total = len(units[0])
    else:
        c = parts[0][0]
        units = [(np.arange(c.real_rows)[:, None] * c.cols + np.arange(c.real_cols)).reshape(-1, 1)]
        total = len(units[0])
    chunks = _RESTART.split(raw) if interval else [raw]
    for i, chunk in enumerate(chunks):
        span = slice(i * interval, (i + 1) * interval) if interval else slice(0, total)
        bits = _Bits(chunk)
        if lo == 0 and high:
            flat = np.hstack([u[span] + 0 for u in units])
            got = bits.many(flat.size).reshape(flat.shape).astype(np.int32) << low
            k = 0
            for (c, _, _), u in zip(parts, units, strict=True):
                c.coefs[u[span].ravel(), 0] |= got[:, k : k + u.shape[1]].ravel()
                k += u.shape[1]
        elif lo == 0:
            _first_dc(bits, parts, [u[span] for u in units], tables, low)
        else:
            (c, _, ac), own = parts[0], units[0][span].ravel()
            (_refine_ac if high else _first_ac)(bits, c, own, tables[0x10 | ac], lo, hi, low)


def _order_of(c: _Component, image: Image) -> np.ndarray:
    """Block indexes of a component, a row an MCU."""
    return np.arange(c.rows * c.cols).reshape(c.rows // c.v, c.v, c.cols // c.h, c.h).transpose(0, 2, 1, 3).reshape(-1, c.v * c.h)


def _first_dc(bits: _Bits, parts: list, units: list[np.ndarray], tables: dict[int, _Table], low: int) -> None:
    windows, at, n = bits.windows(), 0, len(units[0])
    looks = [tables[dc].lookup for _, dc, _ in parts]
    seen = [[] for _ in parts]
    last = [0] * len(parts)
    each = [(k, look) for k, (look, u) in enumerate(zip(looks, units, strict=True)) for _ in range(u.shape[1])]
    for _ in range(n):
        for k, look in each:
            w = windows[at]
            x = look[w >> 16]
            if x < 0:
                raise ValueError("no such code")
            size, used = x & 255, x >> 8
            at += used + size
            if size:
                v = w >> (32 - used - size) & ((1 << size) - 1)
                last[k] += v if v >> (size - 1) else v - (1 << size) + 1
            seen[k].append(last[k])
    if at > bits.end:
        raise ValueError("a scan ends early")
    for (c, _, _), u, s in zip(parts, units, seen, strict=True):
        c.coefs[u.ravel(), 0] = np.array(s, np.int32) << low


def _first_ac(bits: _Bits, c: _Component, own: np.ndarray, table: _Table, lo: int, hi: int, low: int) -> None:
    width = hi - lo + 1
    if table.only is not None and 0 < table.only < 16:  # each coefficient is the code 0 and so many bits
        size = table.only
        n = len(own) * width
        if size == 7:
            v = bits.padded[:n].astype(np.int32)
            ok = 8 * n <= bits.end and (n == 0 or v.max() < 128)
        else:
            raw = bits.many(n * (size + 1)).reshape(n, size + 1)
            ok = not raw[:, 0].any()
            v = raw[:, 1:].astype(np.int32) @ (1 << np.arange(size - 1, -1, -1))
        if not ok:
            raise ValueError("no such code")
        v = np.where(v >> (size - 1), v, v - (1 << size) + 1)
        c.coefs[own, lo : hi + 1] = (v << low).reshape(-1, width)
        return
    run = 0
    for i in own.tolist():
        if run:
            run -= 1
            continue
        k, block = lo, c.coefs[i]
        while k <= hi:
            s = bits.symbol(table)
            zeros, size = s >> 4, s & 15
            if size:
                k += zeros
                block[k] = _extend(bits.take(size), size) * (1 << low)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) + bits.take(zeros) - 1
                break


def _refine_ac(bits: _Bits, c: _Component, own: np.ndarray, table: _Table, lo: int, hi: int, low: int) -> None:
    step, run, j = 1 << low, 0, 0
    while j < len(own):
        k, block = lo, c.coefs[own[j]]
        while not run and k <= hi:
            s = bits.symbol(table)
            zeros, size = s >> 4, s & 15
            new = 0
            if size:
                new = step if bits.take(1) else -step
            elif zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            while k <= hi:  # pass the known coefficients and as many zeros
                if block[k]:
                    if bits.take(1):
                        block[k] += step if block[k] > 0 else -step
                elif zeros:
                    zeros -= 1
                else:
                    break
                k += 1
            if new and k <= hi:
                block[k] = new
            k += 1
        if run and k == lo:  # ended blocks: a bit for each known coefficient of all of them
            some = own[j : j + run]
            x = c.coefs[some, lo : hi + 1]
            known = np.flatnonzero(x)
            flat = x.ravel()
            flat[known] += bits.many(len(known)).astype(np.int32) * np.sign(flat[known]) * step
            c.coefs[some, lo : hi + 1] = flat.reshape(x.shape)
            j += len(some)
            run -= len(some)
            continue
        if run:
            for k in range(k, hi + 1):
                if block[k] and bits.take(1):
                    block[k] += step if block[k] > 0 else -step
            run -= 1
        j += 1


def payload_of(image: Image) -> bytes:
    """The bytes that :func:`encode` put into the coefficients."""
    if not image.comment.startswith(b"payload"):
        raise ValueError("the image carries no payload")
    (n,) = struct.unpack_from(">Q", image.comment, 7)
    v = np.concatenate([c.coefs.ravel() for c in image.components])[:n]
    size = np.abs(v)
    if len(v) != n or (n and (size.min() < 128 or size.max() > 255)):
        raise ValueError("a coefficient is no byte")
    return np.where(v < 0, v + 255, v).astype(np.uint8).tobytes()


def feature_of(rgb: np.ndarray) -> str:
    """Size, channel means and deviations, and a 64-bit hash of a coarse grid of brightness."""
    h, w, _ = rgb.shape
    flat = rgb.reshape(-1, 3)
    n = len(flat)
    sums = flat.sum(axis=0, dtype=np.int64).tolist()
    rows = np.add.reduceat(rgb.sum(axis=2, dtype=np.int32), np.arange(8) * h // 8, axis=0)
    cells = np.add.reduceat(rows, np.arange(8) * w // 8, axis=1).ravel()
    bits = (cells > np.median(cells)).astype(np.uint8)
    return f"{h}x{w}:{','.join(f'{s / n:.4f}' for s in sums)}:{np.packbits(bits).tobytes().hex()}"


# ---------------------------------------------------------------- columns


def padded(raw: bytes) -> bytes:
    """Spaces are appended up to a positive multiple of 192 bytes."""
    return raw + b" " * ((-len(raw) % UNIT) or (0 if raw else UNIT))


def with_media(df: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """Adds a column of progressive JPEG that carries each text (null: empty)."""
    src, field_at = df.withColumn(media_col, F.coalesce(F.col(text_col).cast("string"), F.lit(""))), len([c for c in df.columns if c != media_col])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, media_col):
                cols = part.columns
                texts = cols[field_at].cast(pa.binary()).to_pylist()
                cols[field_at] = pa.array([encode(padded(t)) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    src = src.select(*[c for c in df.columns if c != media_col], media_col)
    return src.mapInArrow(add, src.withColumn(media_col, F.col(media_col).cast("binary")).schema)


_DECODED = "payload binary, height int, width int, rgb binary, feature string"


def with_tensors(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Decodes a media column: adds payload, height, width, rgb (the tensor's
    bytes, row by row) and feature.  A null medium gives nulls; one that can't be
    decoded raises, naming the fault."""
    extra = T.StructType.fromDDL(_DECODED).fields
    schema = T.StructType([*[f for f in df.schema.fields if f.name not in {x.name for x in extra}], *extra])
    src = df.select(*[f.name for f in schema.fields[: -len(extra)]])
    place = src.columns.index(media_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, media_col):
                got = []
                for m in part.column(place).to_pylist():
                    if m is None:
                        got.append((None,) * 5)
                        continue
                    image = decode(m)
                    rgb = image.rgb()
                    got.append((payload_of(image), image.height, image.width, rgb.tobytes(), feature_of(rgb)))
                kinds = (pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.string())
                more = [pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=schema.names)

    return src.mapInArrow(add, schema)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature, height, width, tensor_bytes.

    The media are stored as a table of bytes in the shared folder and read back;
    the tensors are decoded from what was read (:func:`with_tensors` keeps them).
    Null and empty texts carry 192 spaces; a text of any length is one image;
    repeated rows give equal rows; a null identifier stays; an empty table gives
    no rows; other columns, whatever their names, are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_media(rows.withColumn("n_bytes", F.octet_length("text").cast("long")))
    got = with_tensors(written(rows.drop("text"), "media", "zstd"))
    return got.select(
        F.col("doc_id").alias(id_col),
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "height",
        "width",
        F.octet_length("rgb").cast("long").alias("tensor_bytes"),
    )


def op1_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
