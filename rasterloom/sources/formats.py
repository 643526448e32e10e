"""Image formats: bytes to arrays with the axes z, y, x (and channel), and back.

What numpy, struct and zlib can decode; each decoder gives the array and the spacing of x, y, z.
"""

from __future__ import annotations

import gzip
import struct
import zlib

import numpy as np

Decoded = tuple[np.ndarray, tuple[float, float, float]]
EVEN = (1.0, 1.0, 1.0)

#: Channels by colour type of PNG.
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PNG_START = b"\x89PNG\r\n\x1a\n"


def png(raw: bytes) -> Decoded:
    """A PNG image without interlacing: grey, colours, palette, with alpha or without."""
    if raw[:8] != PNG_START:
        raise ValueError("not a PNG image")
    at, data, palette, head = 8, [], None, None
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if head is None:
        raise ValueError("a PNG image without a header")
    wide, high, depth, colour, _, _, interlaced = head
    if interlaced:
        raise ValueError("interlaced PNG images are not supported")
    channels = PNG_CHANNELS[colour]
    step, line = max(1, channels * depth // 8), -(-wide * channels * depth // 8)
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(high, line + 1)
    out, before = np.zeros((high, line), np.uint8), np.zeros(line, np.uint8)
    for k in range(high):
        out[k] = before = unfiltered(int(rows[k, 0]), rows[k, 1:], before, step)
    if depth == 16:
        pixels = out.reshape(-1).view(">u2").reshape(high, wide, channels)
    elif depth == 8:
        pixels = out.reshape(high, wide, channels)
    else:
        bits = np.unpackbits(out, axis=1)[:, : wide * channels * depth].reshape(high, wide * channels, depth)
        pixels = (bits @ (1 << np.arange(depth)[::-1])).reshape(high, wide, channels)
    if colour == 3:
        pixels = palette[pixels[..., 0]]  # type: ignore[index]
    pixels = pixels.astype(float)
    return (pixels[None, ..., 0] if pixels.shape[-1] == 1 else pixels[None]), EVEN


def unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row of bytes without its filter."""
    if kind == 0:
        return row.copy()
    if kind == 2:
        return row + above
    if kind == 1:
        out = np.zeros(-(-len(row) // step) * step, np.uint8)
        out[: len(row)] = row
        return np.cumsum(out.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[: len(row)]
    out, up, left, corner = row.tolist(), above.tolist(), [0] * step, [0] * step
    for k, x in enumerate(out):
        a, b, c = left[k % step], up[k], corner[k % step]
        if kind == 3:
            x += (a + b) // 2
        else:
            p = a + b - c
            pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
            x += a if pa <= pb and pa <= pc else b if pb <= pc else c
        out[k] = left[k % step] = x & 255
        corner[k % step] = b
    return np.array(out, np.uint8)


def to_png(grid: np.ndarray, spacing: tuple[float, ...] = EVEN) -> bytes:
    """The middle slice, cut to 0 to 255; vector pixels of three or four channels are colours."""
    plane = np.clip(grid[grid.shape[0] // 2], 0, 255).astype(np.uint8)
    plane = plane[..., None] if plane.ndim == 2 else plane
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[plane.shape[-1]]
    rows = np.concatenate([np.zeros((plane.shape[0], 1), np.uint8), plane.reshape(plane.shape[0], -1)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", plane.shape[1], plane.shape[0], 8, colour, 0, 0, 0)
    return PNG_START + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


#: Element types of NRRD.
NRRD_TYPES = {"uchar": "u1", "unsigned char": "u1", "uint8": "u1", "uint8_t": "u1", "signed char": "i1", "int8": "i1", "int8_t": "i1", "short": "i2", "int16": "i2", "int16_t": "i2", "ushort": "u2", "unsigned short": "u2", "uint16": "u2", "uint16_t": "u2", "int": "i4", "int32": "i4", "int32_t": "i4", "uint": "u4", "unsigned int": "u4", "uint32": "u4", "uint32_t": "u4", "float": "f4", "double": "f8"}


def nrrd(raw: bytes) -> Decoded:
    """An NRRD image that holds its data, raw or compressed."""
    head, _, body = raw.partition(b"\n\n")
    if not head.startswith(b"NRRD"):
        raise ValueError("not an NRRD image")
    fields = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in head.decode("latin-1").replace("\r", "").split("\n")[1:] if ":" in line and line[0] != "#" and ":=" not in line)}
    if "data file" in fields or "datafile" in fields:
        raise ValueError("only NRRD images that hold their data are supported")
    if fields["encoding"] in ("gzip", "gz"):
        body = gzip.decompress(body)
    elif fields["encoding"] != "raw":
        raise ValueError(f"NRRD encoding {fields['encoding']} is not supported")
    size = [int(n) for n in fields["sizes"].split()]
    step = [1.0] * len(size)
    if "spacings" in fields:
        step = [1.0 if x.lower() == "nan" else abs(float(x)) for x in fields["spacings"].split()]
    elif "space directions" in fields:
        vectors = [v for v in fields["space directions"].replace("none", "(1)").split(")") if "(" in v]
        step = [sum(float(x) ** 2 for x in v.strip(" (").split(",")) ** 0.5 for v in vectors]
    kind = (">" if fields.get("endian") == "big" else "<") + NRRD_TYPES[fields["type"]]
    size, step = [*size, 1, 1][:3], [*step, 1.0, 1.0][:3]
    return np.frombuffer(body, kind, int(np.prod(size))).reshape(size[::-1]).astype(float), tuple(step)  # type: ignore[return-value]


def to_nrrd(grid: np.ndarray, spacing: tuple[float, ...] = EVEN) -> bytes:
    """An NRRD image of doubles."""
    head = f"NRRD0004\ntype: double\ndimension: 3\nsizes: {' '.join(map(str, grid.shape[::-1]))}\nspacings: {' '.join(map(str, spacing))}\nendian: little\nencoding: gzip\n\n"
    return head.encode() + gzip.compress(np.ascontiguousarray(grid, "<f8").tobytes(), mtime=0)


#: Bytes of the field types of TIFF, and of its element types by format and bits.
TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8}
TIFF_TYPES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


def tiff(raw: bytes) -> Decoded:
    """A TIFF image in strips, raw, deflated or packed; its pages are slices."""
    end = {b"II": "<", b"MM": ">"}[raw[:2]]
    at, planes = struct.unpack(end + "I", raw[4:8])[0], []
    while at:
        tags, n = {}, struct.unpack(end + "H", raw[at : at + 2])[0]
        for k in range(n):
            tag, kind, count = struct.unpack(end + "HHI", raw[at + 2 + 12 * k : at + 10 + 12 * k])
            size = TIFF_SIZES.get(kind, 1) * count
            place = at + 10 + 12 * k if size <= 4 else struct.unpack(end + "I", raw[at + 10 + 12 * k : at + 14 + 12 * k])[0]
            if kind in (1, 3, 4):
                tags[tag] = struct.unpack(f"{end}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind]}", raw[place : place + size])
        wide, high, channels = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
        packing = tags.get(259, (1,))[0]
        unpack = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpacked}.get(packing)
        if unpack is None or 322 in tags or tags.get(317, (1,))[0] != 1:
            raise ValueError("TIFF images in tiles, or of this compression, are not supported")
        data = b"".join(unpack(raw[a : a + b]) for a, b in zip(tags[273], tags[279]))
        kind = end + TIFF_TYPES[tags.get(339, (1,))[0], tags.get(258, (8,))[0]]
        plane = np.frombuffer(data, kind, wide * high * channels).reshape(high, wide, channels).astype(float)
        planes.append(plane[..., 0] if channels == 1 else plane)
        at = struct.unpack(end + "I", raw[at + 2 + 12 * n : at + 6 + 12 * n])[0]
    return np.stack(planes), EVEN


def unpacked(raw: bytes) -> bytes:
    """Bytes from runs of equal ones and of others."""
    out, k = bytearray(), 0
    while k < len(raw):
        n = raw[k]
        if n < 128:
            out += raw[k + 1 : k + 2 + n]
            k += 2 + n
        else:
            out += raw[k + 1 : k + 2] * (257 - n if n > 128 else 0)
            k += 2
    return bytes(out)


def to_tiff(grid: np.ndarray, spacing: tuple[float, ...] = EVEN) -> bytes:
    """A TIFF image of 32-bit floats with a page for each slice."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for plane in grid.astype("<f4"):
        data = plane.tobytes()
        place = len(out)
        out += data
        struct.pack_into("<I", out, link, len(out))
        fields = [(256, 4, plane.shape[1]), (257, 4, plane.shape[0]), (258, 3, 32), (259, 3, 1), (262, 3, 1), (273, 4, place), (277, 3, 1), (278, 4, plane.shape[0]), (279, 4, len(data)), (339, 3, 3)]
        out += struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", tag, kind, 1, value) for tag, kind, value in fields)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


#: Element types of legacy VTK files.
VTK_TYPES = {"unsigned_char": "u1", "char": "i1", "unsigned_short": "u2", "short": "i2", "unsigned_int": "u4", "int": "i4", "float": "f4", "double": "f8"}


def vtk(raw: bytes) -> Decoded:
    """A legacy VTK file of structured points with one number a point, as text or binary."""
    head, mark, body = raw.partition(b"LOOKUP_TABLE default\n")
    if not head.startswith(b"# vtk") or not mark:
        raise ValueError("only legacy VTK files of structured points are supported")
    lines = [line.split() for line in head.decode("latin-1").splitlines()]
    fields = {line[0].upper(): line[1:] for line in lines[2:] if line}
    size = [int(n) for n in fields["DIMENSIONS"]]
    step = tuple(float(x) for x in fields.get("SPACING", fields.get("ASPECT_RATIO", ["1", "1", "1"])))
    kind = VTK_TYPES[fields["SCALARS"][1]]
    data = np.frombuffer(body, ">" + kind, int(np.prod(size))) if "BINARY" in fields else np.array(body.split()[: int(np.prod(size))], float)
    return data.reshape(size[::-1]).astype(float), step  # type: ignore[return-value]


def to_vtk(grid: np.ndarray, spacing: tuple[float, ...] = EVEN) -> bytes:
    """A legacy VTK file of doubles."""
    size = " ".join(map(str, grid.shape[::-1]))
    head = f"# vtk DataFile Version 3.0\nimage\nBINARY\nDATASET STRUCTURED_POINTS\nDIMENSIONS {size}\nORIGIN 0 0 0\nSPACING {' '.join(map(str, spacing))}\nPOINT_DATA {grid.size}\nSCALARS v double 1\nLOOKUP_TABLE default\n"
    return head.encode() + np.ascontiguousarray(grid, ">f8").tobytes() + b"\n"


def bmp(raw: bytes) -> Decoded:
    """A BMP image of 8, 24 or 32 bits without compression."""
    start, _, wide, high, _, bits, packing = struct.unpack("<IIiiHHI", raw[10:34])
    if raw[:2] != b"BM" or packing or bits not in (8, 24, 32):
        raise ValueError("only BMP images of 8, 24 or 32 bits without compression are supported")
    line = -(-wide * bits // 32) * 4
    rows = np.frombuffer(raw, np.uint8, line * abs(high), start).reshape(abs(high), line)[:, : wide * bits // 8]
    rows = rows[::-1] if high > 0 else rows
    if bits == 8:
        return rows[None].astype(float), EVEN
    return rows.reshape(abs(high), wide, bits // 8)[None, ..., [2, 1, 0]].astype(float), EVEN


#: Value representations of DICOM that have a long length.
DICOM_LONG = frozenset((b"OB", b"OD", b"OF", b"OL", b"OW", b"SQ", b"UC", b"UN", b"UR", b"UT"))


def dicom(raw: bytes) -> Decoded:
    """A DICOM image of one or more grey frames in little-endian order without compression."""
    if raw[128:132] != b"DICM":
        raise ValueError("not a DICOM file")
    at, found, explicit = 132, {}, True
    while at + 8 <= len(raw):
        group, element = struct.unpack("<HH", raw[at : at + 4])
        kind = raw[at + 4 : at + 6]
        if explicit or group == 2:
            wide = kind in DICOM_LONG
            size = struct.unpack("<I", raw[at + 8 : at + 12])[0] if wide else struct.unpack("<H", raw[at + 6 : at + 8])[0]
            at += 12 if wide else 8
        else:
            size = struct.unpack("<I", raw[at + 4 : at + 8])[0]
            at += 8
        if size == 0xFFFFFFFF:
            if (group, element) == (0x7FE0, 0x10):
                raise ValueError("compressed DICOM images are not supported")
            size = raw.find(b"\xfe\xff\xdd\xe0", at) + 8 - at
        found[group, element] = raw[at : at + size]
        at += size
        if (group, element) == (2, 0x10):
            explicit = found[2, 0x10].rstrip(b"\0 ") != b"1.2.840.10008.1.2"
    number = lambda k, other: struct.unpack("<H", found[k][:2])[0] if k in found else other
    text = lambda k, other: found[k].decode("latin-1").strip(" \0") if k in found else other
    high, wide, bits, signed = number((0x28, 0x10), 0), number((0x28, 0x11), 0), number((0x28, 0x100), 8), number((0x28, 0x103), 0)
    if number((0x28, 2), 1) != 1 or (0x7FE0, 0x10) not in found:
        raise ValueError("only grey DICOM images are supported")
    frames = int(text((0x28, 8), "1") or 1)
    data = np.frombuffer(found[0x7FE0, 0x10], f"<{'i' if signed else 'u'}{bits // 8}", frames * high * wide).reshape(frames, high, wide).astype(float)
    data = data * float(text((0x28, 0x1053), "1") or 1) + float(text((0x28, 0x1052), "0") or 0)
    dy, dx = [float(x) for x in text((0x28, 0x30), "1\\1").split("\\")][:2]
    return data, (dx, dy, float(text((0x18, 0x50), "1") or 1))
