"""Image formats in bytes: TIFF, NIfTI, PNG and Zarr chunks, by their public specifications. Arrays are (z, y, x)."""

from __future__ import annotations

import gzip
import io
import json
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa

#: Sizes of TIFF field types; data types of NIfTI by their numbers.
TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def as_volume(a: np.ndarray) -> np.ndarray:
    """Two-dimensional images are one slice; further axes in front are counted into z."""
    return a[None] if a.ndim == 2 else a.reshape(-1, *a.shape[-2:])


# --- TIFF


def _tiff_page(at: int, shape: tuple[int, int], kind: np.dtype, data: bytes, last: bool) -> bytes:
    """A page's directory and strip for place ``at`` of the file."""
    code = {"u": 1, "i": 2, "f": 3}[kind.kind]
    tags = [(256, 4, shape[1]), (257, 4, shape[0]), (258, 3, 8 * kind.itemsize), (259, 3, 1), (262, 3, 1), (273, 4, 0), (277, 3, 1), (278, 4, shape[0]), (279, 4, len(data)), (339, 3, code)]
    strip = at + 2 + 12 * len(tags) + 4
    out = bytearray(struct.pack("<H", len(tags)))
    for tag, t, v in tags:
        out += struct.pack("<HHI", tag, t, 1) + struct.pack("<I" if t == 4 else "<HH", *([strip if tag == 273 else v] if t == 4 else [v, 0]))
    out += struct.pack("<I", 0 if last else strip + len(data) + (len(data) & 1)) + data + b"\0" * (len(data) & 1)
    return bytes(out)


def write_tiff(a: np.ndarray) -> bytes:
    """All slices as pages, uncompressed, one strip each, little-endian."""
    a = as_volume(np.asarray(a))
    out = io.BytesIO()
    sink = Pages(out, a.shape, a.dtype.name, ".tif")
    for page in a:
        sink.add(page.astype(a.dtype.newbyteorder("<")).tobytes())
    sink.close()
    return out.getvalue()


class Pages:
    """A TIFF or NIfTI file of a known shape, written slice by slice (bytes, little-endian). A TIFF file ends at 4 GB."""

    def __init__(self, to: BinaryIO, shape: tuple[int, int, int], dtype: str, suffix: str):
        if suffix not in (".tif", ".tiff", ".nii", ".nii.gz"):
            raise ValueError(f"no writer of single files for {suffix!r}")
        self.shape, self.kind, self.tiff, self.done = shape, np.dtype(dtype), suffix.startswith(".tif"), 0
        self.to = gzip.GzipFile(fileobj=to, mode="wb", compresslevel=1, mtime=0) if suffix.endswith(".gz") else to
        self.at = 8
        if self.tiff and shape[0] * (shape[1] * shape[2] * self.kind.itemsize + 200) >= 1 << 32:
            raise ValueError("a TIFF file can't hold this volume; write slices or NIfTI")
        self.to.write(struct.pack("<2sHI", b"II", 42, 8) if self.tiff else _nifti_first(shape, self.kind))

    def add(self, data: bytes) -> None:
        self.done += 1
        page = _tiff_page(self.at, self.shape[1:], self.kind, data, self.done == self.shape[0]) if self.tiff else data
        self.at += len(page)
        self.to.write(page)

    def close(self) -> None:
        if isinstance(self.to, gzip.GzipFile):
            self.to.close()


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends. A width ends one code early, as the format says."""
    out, table, width, before = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, None
    held = n = 0
    for byte in data:
        held, n = held << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code, held = held >> n, held & ((1 << n) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, before = 9, None
            continue
        entry = table[code] if code < len(table) else before + before[:1]
        out += entry
        if before is not None:
            table.append(before + entry[:1])
        before = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


def _unpacked(data: bytes, compression: int) -> bytes:
    if compression == 1:
        return data
    if compression == 5:
        return _lzw(data)
    if compression in (8, 32946):
        return zlib.decompress(data)
    if compression == 32773:  # runs of bytes
        out, i = bytearray(), 0
        while i < len(data):
            n = data[i]
            if n < 128:
                out += data[i + 1 : i + 2 + n]
                i += 2 + n
            else:
                out += data[i + 1 : i + 2] * (257 - n if n > 128 else 0)
                i += 2 if n > 128 else 1
        return bytes(out)
    raise ValueError(f"TIFF compression {compression} isn't supported")


def _tiff_pages(data: bytes) -> Iterator[tuple[dict[int, list[int]], np.dtype]]:
    """Tags and data type of each page."""
    e = {b"II": "<", b"MM": ">"}[data[:2]]
    at = struct.unpack(e + "I", data[4:8])[0]
    while at:
        n = struct.unpack(e + "H", data[at : at + 2])[0]
        tags: dict[int, list[int]] = {}
        for i in range(n):
            tag, t, count = struct.unpack(e + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
            size = TIFF_SIZES.get(t, 1) * count
            field = data[at + 10 + 12 * i : at + 14 + 12 * i]
            if size > 4:
                where = struct.unpack(e + "I", field)[0]
                field = data[where : where + size]
            if t in (1, 3, 4):
                tags[tag] = np.frombuffer(field[:size], e + {1: "u1", 3: "u2", 4: "u4"}[t]).tolist()
        if tags.get(277, [1])[0] != 1:
            raise ValueError("TIFF pages with several samples aren't supported")
        yield tags, np.dtype(e + {1: "u", 2: "i", 3: "f"}[tags.get(339, [1])[0]] + str(tags.get(258, [8])[0] // 8))
        at = struct.unpack(e + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])[0]


def read_tiff(data: bytes) -> np.ndarray:
    """Pages of the largest height and width, in order; strips, one sample for each pixel."""
    pages = []
    for tags, kind in _tiff_pages(data):
        width, height = tags[256][0], tags[257][0]
        raw = b"".join(_unpacked(data[o : o + s], tags.get(259, [1])[0]) for o, s in zip(tags[273], tags[279], strict=True))
        page = np.frombuffer(raw, kind, width * height).reshape(height, width)
        pages.append(np.cumsum(page, axis=1, dtype=kind) if tags.get(317, [1])[0] == 2 else page)  # differences along a row
    if not pages:
        raise ValueError("a TIFF file without pages")
    best = max(pages, key=lambda p: p.size).shape
    return np.stack([p for p in pages if p.shape == best])


# --- NIfTI


def _nifti_first(shape: tuple[int, int, int], kind: np.dtype) -> bytes:
    """What stands before the values: the header of a single file whose axes are x, y, z; beyond 32,767 places of an axis that of NIfTI-2."""
    code = next(k for k, v in NIFTI_TYPES.items() if v == kind.str[1:])
    if max(shape) >= 1 << 15:
        head = bytearray(544)
        struct.pack_into("<i8s2h", head, 0, 540, b"n+2\0\r\n\x1a\n", code, 8 * kind.itemsize)
        struct.pack_into("<8q", head, 16, 3, shape[2], shape[1], shape[0], 1, 1, 1, 1)
        struct.pack_into("<8d", head, 104, 1, 1, 1, 1, 1, 1, 1, 1)
        struct.pack_into("<q2d", head, 168, 544, 1, 0)
        return bytes(head)
    head = bytearray(348)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, shape[2], shape[1], shape[0], 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, code, 8 * kind.itemsize)
    struct.pack_into("<8f", head, 76, 1, 1, 1, 1, 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    head[344:348] = b"n+1\0"
    return bytes(head) + b"\0" * 4


def write_nifti(a: np.ndarray, packed: bool = False) -> bytes:
    a = as_volume(np.asarray(a))
    out = _nifti_first(a.shape, a.dtype) + a.astype(a.dtype.newbyteorder("<")).tobytes()
    return gzip.compress(out, 1) if packed else out


def _nifti_head(data: bytes) -> tuple[str, str, tuple[int, int, int], int, float, float]:
    """Byte order, type, (z, y, x), offset, slope and shift from the first 352 bytes."""
    e = "<" if struct.unpack("<i", data[:4])[0] in (348, 540) else ">"
    second = struct.unpack(e + "i", data[:4])[0] == 540
    dim = struct.unpack(e + "8q", data[16:80]) if second else struct.unpack(e + "8h", data[40:56])
    if dim[0] > 3 and any(d > 1 for d in dim[4 : dim[0] + 1]):
        raise ValueError("NIfTI files of more than three axes aren't supported")
    kind = NIFTI_TYPES[struct.unpack(e + "h", data[12:14] if second else data[70:72])[0]]
    offset, slope, shift = struct.unpack(e + "q2d", data[168:192]) if second else struct.unpack(e + "3f", data[108:120])
    x, y, z = (max(1, d) for d in (*dim[1 : dim[0] + 1], 1, 1, 1)[:3])
    return e, kind, (z, y, x), int(offset), slope, shift


def read_nifti(data: bytes) -> np.ndarray:
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    e, kind, (z, y, x), offset, slope, shift = _nifti_head(data)
    a = np.frombuffer(data, e + kind, x * y * z, offset).reshape(z, y, x)
    return a if slope in (0, 1) and shift == 0 else a * slope + shift


# --- PNG


def write_png(a: np.ndarray) -> bytes:
    """One grey slice of 8 or 16 bits."""
    a = np.asarray(a).reshape(a.shape[-2:])
    rows = a.astype(">u2" if a.dtype.itemsize == 2 else "u1")
    raw = b"".join(b"\0" + r.tobytes() for r in rows)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8 * a.dtype.itemsize, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """Grey images of 8 or 16 bits without interlacing; colour is refused, as it would pass for slices."""
    at, packed, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 8 + n])
        elif kind == b"IDAT":
            packed += data[at + 8 : at + 8 + n]
        at += 12 + n
    width, height, bits, colour, _, _, interlaced = head
    if colour or interlaced or bits not in (8, 16):
        raise ValueError("only grey PNG files of 8 or 16 bits without interlacing are supported")
    step, row = bits // 8, width * bits // 8
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, row + 1)
    out = np.zeros((height, row), np.uint8)
    above = np.zeros(row, np.uint8)
    for i in range(height):
        how, line = raw[i, 0], raw[i, 1:]
        if how == 0:
            out[i] = line
        elif how == 2:
            out[i] = line + above
        elif how == 1:
            for s in range(step):
                out[i, s::step] = np.cumsum(line[s::step], dtype=np.uint8)
        else:
            cur = out[i]
            for j in range(row):
                a = int(cur[j - step]) if j >= step else 0
                b, c = int(above[j]), int(above[j - step]) if j >= step else 0
                if how == 3:
                    guess = (a + b) // 2
                else:
                    guess = min((a, b, c), key=lambda v, p=a + b - c: abs(p - v))
                cur[j] = (int(line[j]) + guess) & 255
        above = out[i]
    return out.view(">u2").astype(np.uint16)[None] if bits == 16 else out[None]


# --- Zarr, version 2


#: Compressors of stores as their metadata names them, and the numbers of the codecs inside Blosc frames.
COMPRESSORS = {"none": None, "zlib": {"id": "zlib", "level": 1}, "blosc": {"id": "blosc", "cname": "lz4", "clevel": 5, "shuffle": 1, "blocksize": 0}}
BLOSC_CODECS = {1: "lz4_raw", 2: "snappy", 3: "zlib", 4: "zstd"}


def zarr_metadata(shape: tuple[int, ...], chunks: tuple[int, ...], dtype: str, compressor: str = "none") -> str:
    return json.dumps({"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": np.dtype(dtype).str, "compressor": COMPRESSORS[compressor], "fill_value": 0, "order": "C", "filters": None})


def blosc_packed(data: bytes, item: int) -> bytes:
    """A Blosc frame of one block: bytes of equal place in their items side by side, then LZ4."""
    n = len(data) // item * item
    shuffled = np.frombuffer(data, np.uint8, n).reshape(-1, item).T.tobytes() + data[n:]
    body = pa.Codec("lz4_raw").compress(shuffled, asbytes=True)
    if len(body) >= len(data):  # flag 2: stored as it is
        return struct.pack("<BBBBIII", 2, 1, 2, item, len(data), len(data), len(data) + 16) + data
    return struct.pack("<BBBBIII", 2, 1, 1 << 5 | 16 | 1, item, len(data), len(data), len(body) + 24) + struct.pack("<Ii", 20, len(body)) + body


def blosc_unpacked(data: bytes) -> bytes:
    """The bytes of a Blosc frame (version 1 format: byte shuffle or none; LZ4, Snappy, zlib or Zstandard)."""
    _, _, flags, item, size, block, _ = struct.unpack("<BBBBIII", data[:16])
    if flags & 2:
        return data[16 : 16 + size]
    codec = BLOSC_CODECS.get(flags >> 5)
    if codec is None or flags & 4:
        raise ValueError("Blosc frames by BloscLZ or with shuffled bits aren't supported")
    count, out = -(-size // block) if size else 0, []
    for i, at in enumerate(struct.unpack(f"<{count}I", data[16 : 16 + 4 * count])):
        n = min(block, size - i * block)
        # blocks but a shorter last one are split in a stream for each byte of an item, unless flag 16 says no
        parts = item if not flags & 16 and item <= 16 and block // item >= 128 and n == block else 1
        streams = []
        for _ in range(parts):
            (packed,) = struct.unpack("<i", data[at : at + 4])
            raw = data[at + 4 : at + 4 + packed]
            whole = n // parts
            streams.append(raw if packed == whole else zlib.decompress(raw) if codec == "zlib" else pa.Codec(codec).decompress(raw, whole, asbytes=True))
            at += 4 + packed
        plain = b"".join(streams)
        if flags & 1 and item > 1:
            m = n // item * item
            plain = np.frombuffer(plain, np.uint8, m).reshape(item, -1).T.tobytes() + plain[m:]
        out.append(plain)
    return b"".join(out)


def write_chunk(a: np.ndarray, chunks: tuple[int, ...], compressor: str = "none") -> bytes:
    """A chunk is always full; what lies beyond the array is zero."""
    full = np.zeros(chunks, a.dtype)
    full[tuple(slice(0, n) for n in a.shape)] = a
    data = full.tobytes()
    return zlib.compress(data, 1) if compressor == "zlib" else blosc_packed(data, a.dtype.itemsize) if compressor == "blosc" else data


def read_chunk(data: bytes, meta: dict) -> np.ndarray:
    how = (meta["compressor"] or {"id": "none"})["id"]
    unpack = {"none": bytes, "zlib": zlib.decompress, "gzip": gzip.decompress, "blosc": blosc_unpacked, "zstd": lambda d: pa.input_stream(pa.py_buffer(d), compression="zstd").read()}
    if how not in unpack:
        raise ValueError(f"Zarr compressor {how!r} isn't supported")
    return np.frombuffer(unpack[how](data), meta["dtype"]).reshape(meta["chunks"], order=meta.get("order", "C"))


def header(data: bytes, suffix: str) -> tuple[int, int, int, str]:
    """Depth, height, width and type name of a file, pixels left alone."""
    if suffix in (".tif", ".tiff"):
        pages = [(t[257][0], t[256][0], k.name) for t, k in _tiff_pages(data)]
        if not pages:
            raise ValueError("a TIFF file without pages")
        height, width, kind = max(pages, key=lambda p: p[0] * p[1])
        return sum(p[:2] == (height, width) for p in pages), height, width, kind
    if suffix in (".nii", ".nii.gz", ".gz"):
        first = zlib.decompressobj(31).decompress(data, 352) if data[:2] == b"\x1f\x8b" else data[:352]
        _, kind, shape, _, slope, shift = _nifti_head(first)
        return (*shape, np.dtype(kind).name if slope in (0, 1) and shift == 0 else "float64")
    if suffix == ".png":
        width, height, bits = struct.unpack(">IIB", data[16:25])
        return 1, height, width, f"uint{bits}"
    raise ValueError(f"no reader for {suffix!r}")


def decode(data: bytes, suffix: str) -> np.ndarray:
    if suffix in (".tif", ".tiff"):
        return read_tiff(data)
    if suffix in (".nii", ".nii.gz", ".gz"):
        return read_nifti(data)
    if suffix == ".png":
        return read_png(data)
    raise ValueError(f"no reader for {suffix!r}")


def encode(a: np.ndarray, suffix: str) -> bytes:
    if suffix in (".tif", ".tiff"):
        return write_tiff(a)
    if suffix in (".nii", ".nii.gz"):
        return write_nifti(a, suffix == ".nii.gz")
    if suffix == ".png":
        return write_png(a)
    raise ValueError(f"no writer for {suffix!r}")
