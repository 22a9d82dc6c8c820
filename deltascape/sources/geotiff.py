"""GeoTIFF files without native libraries: reading (strips or tiles; raw, LZW or deflate; predictor 1 or 2) and writing."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

#: Bytes of TIFF's field types, and numpy's kinds of sample formats, fixed values.
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8}
TYPE_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
KIND = {1: "u", 2: "i", 3: "f"}


@dataclass
class Raster:
    """Bands (first axis), the affine (a, b, c, d, e, f), the EPSG code and the nodata value."""

    bands: np.ndarray
    affine: tuple[float, float, float, float, float, float] = (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)
    epsg: int | None = None
    nodata: float | None = None
    tags: dict[str, str] = field(default_factory=dict)

    @property
    def valid(self) -> np.ndarray:
        """Pixels with data in all of the first three bands."""
        b = self.bands[:3]
        ok = np.isfinite(b).all(axis=0)
        return ok if self.nodata is None or np.isnan(self.nodata) else ok & (b != self.nodata).all(axis=0)

    @property
    def projected(self) -> bool:
        return self.epsg is not None and self.epsg != 4326

    @property
    def pixel_m(self) -> float:
        a, b, _, d, e, _ = self.affine
        return abs(a * e - b * d) ** 0.5 if self.projected and a * e - b * d else 1.0


def lzw_decode(data: bytes) -> bytes:
    """TIFF's LZW: codes of growing width, most significant bit first."""
    out, table, width, bits, held, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        while bits >= width:
            code = (held >> (bits - width)) & ((1 << width) - 1)
            bits -= width
            held &= (1 << bits) - 1
            if code == 256:
                table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            if code == 257:
                return bytes(out)
            entry = table[code] if code < len(table) else last + last[:1]
            out += entry
            if last:
                table.append(last + entry[:1])
            last = entry
            width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            out.append((held >> (bits - 8)) & 255)
            bits -= 8
            held &= (1 << bits) - 1

    table = {bytes([i]): i for i in range(256)}
    width, word = 9, b""
    put(256, width)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = len(table) + 2 if len(table) >= 256 else 258
        if len(table) + 2 > 4094:
            put(256, width)
            table, width = {bytes([k]): k for k in range(256)}, 9
        else:
            width = 9 + (len(table) + 2 > 511) + (len(table) + 2 > 1023) + (len(table) + 2 > 2047)
        word = data[i : i + 1]
    if word:
        put(table[word], width)
    put(257, width)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def read(data: bytes) -> Raster:
    """The first image of a classic TIFF."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a classic TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    found: dict[int, tuple] = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, count = struct.unpack(order + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        size = TYPE_SIZE.get(kind, 1) * count
        start = at + 10 + 12 * k if size <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * k : at + 14 + 12 * k])[0]
        raw = data[start : start + size]
        found[tag] = (raw.rstrip(b"\0").decode("latin-1"),) if kind == 2 else struct.unpack(f"{order}{count}{TYPE_CODE[kind]}", raw) if kind in TYPE_CODE else (raw,)
    one = lambda tag, default=None: found.get(tag, (default,))[0]
    width, height, n = one(256), one(257), one(277, 1)
    kind = np.dtype(f"{order}{KIND[one(339, 1)]}{one(258, 8) // 8}")
    planar, compression, predictor = one(284, 1), one(259, 1), one(317, 1)
    tiled = 324 in found
    tw, th = (one(322), one(323)) if tiled else (width, min(one(278, height), height))
    offsets, counts = found[324 if tiled else 273], found[325 if tiled else 279]
    across, down = -(-width // tw), -(-height // th)
    bands = np.zeros((n, height, width), kind.newbyteorder("="))
    for k, (start, size) in enumerate(zip(offsets, counts, strict=True)):
        raw = data[start : start + size]
        if compression == 5:
            raw = lzw_decode(raw)
        elif compression in (8, 32946):
            raw = zlib.decompress(raw)
        elif compression != 1:
            raise ValueError(f"compression {compression} is not supported")
        plane, place = divmod(k, across * down) if planar == 2 else (0, k)
        row, column = divmod(place, across)
        own = 1 if planar == 2 else n
        rows = th if tiled else min(th, height - row * th)
        block = np.frombuffer(raw, kind, count=rows * tw * own).reshape(rows, tw, own)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        y, x = row * th, column * tw
        part = np.moveaxis(block, 2, 0)[:, : height - y, : width - x]
        bands[plane : plane + own, y : y + part.shape[1], x : x + part.shape[2]] = part
    scale, tie, matrix = found.get(33550), found.get(33922), found.get(34264)
    if matrix:
        affine = (matrix[0], matrix[1], matrix[3], matrix[4], matrix[5], matrix[7])
    elif scale and tie:
        affine = (scale[0], 0.0, tie[3] - tie[0] * scale[0], 0.0, -scale[1], tie[4] + tie[1] * scale[1])
    else:
        affine = (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)
    keys = found.get(34735, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    nodata = one(42113)
    return Raster(bands, affine, codes.get(3072) or codes.get(2048), float(nodata) if nodata not in (None, "") else None)


def write(raster: Raster, compression: str = "lzw", rows_per_strip: int = 64) -> bytes:
    """A little-endian, striped TIFF with all bands side by side."""
    bands = np.asarray(raster.bands)
    n, height, width = bands.shape
    kind = bands.dtype.newbyteorder("<")
    pixels = np.ascontiguousarray(np.moveaxis(bands, 0, -1).astype(kind))
    pack = {"lzw": lzw_encode, "deflate": zlib.compress, "none": bytes}[compression]
    strips = [pack(pixels[y : y + rows_per_strip].tobytes()) for y in range(0, height, rows_per_strip)]
    sample = {"u": 1, "i": 2, "f": 3}[kind.kind]
    a, _, c, _, e, f = raster.affine
    geographic = raster.epsg == 4326
    keys = [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, raster.epsg or 32767]
    fields: list[tuple[int, int, list]] = [
        (256, 4, [width]), (257, 4, [height]), (258, 3, [kind.itemsize * 8] * n), (259, 3, [{"lzw": 5, "deflate": 8, "none": 1}[compression]]), (262, 3, [2 if n >= 3 else 1]), (273, 4, []), (277, 3, [n]),
        (278, 4, [rows_per_strip]), (279, 4, [len(s) for s in strips]), (284, 3, [1]), (339, 3, [sample] * n), (33550, 12, [a, -e, 0.0]), (33922, 12, [0.0, 0.0, 0.0, c, f, 0.0]), (34735, 3, keys),
    ]
    if raster.nodata is not None:
        fields.append((42113, 2, [f"{raster.nodata:g}\0".encode()]))
    head = 8 + 2 + 12 * len(fields) + 4
    spare, where, entries = b"", {}, []
    for tag, t, values in fields:
        if tag == 273:
            values = [0] * len(strips)
        raw = values[0] if t == 2 else struct.pack(f"<{len(values)}{TYPE_CODE[t]}", *values)
        count = len(raw) if t == 2 else len(values)
        if len(raw) > 4:
            where[tag] = head + len(spare)
            entries.append(struct.pack("<HHII", tag, t, count, where[tag]))
            spare += raw + b"\0" * (len(raw) % 2)
        else:
            entries.append(struct.pack("<HHI", tag, t, count) + raw.ljust(4, b"\0"))
    starts, at = [], head + len(spare)
    for s in strips:
        starts.append(at)
        at += len(s)
    packed = struct.pack(f"<{len(starts)}I", *starts)
    k = [t for t, _, _ in fields].index(273)
    if 273 in where:
        i = where[273] - head
        spare = spare[:i] + packed + spare[i + len(packed) :]
    else:
        entries[k] = entries[k][:8] + packed
    return struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(fields)) + b"".join(entries) + struct.pack("<I", 0) + spare + b"".join(strips)
