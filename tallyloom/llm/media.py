"""Media columns: Netpbm and BMP bytes to arrays, area-resized tiles and difference hashes.

Netpbm P1 to P6 (comments, up to 8 bits a sample) and uncompressed BMP (palettes of 1, 4 or 8
bits, 24 and 32 bits) decode to arrays of unsigned bytes, grey (rows, columns) or colour
(rows, columns, 3). Tiles are area means, read from an integral image at fractional corners;
they are written in NPY form. The difference hash has a bit for each of 8 x 8 neighbours.

Null, empty, cut or unknown media give null results, never an error. A text is stored as a
grey image of 64 columns: its bytes and then zeros up to full rows, one row at least; null
texts count as empty. Repeated rows stay, equal texts get equal media and features.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from tallyloom.sources.workspace import pin

COLUMNS = 64


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """Grey as P5, colour as P6."""
    kind = 5 if pixels.ndim == 2 else 6
    return b"P%d\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Grey with a palette of 256, colour with 24 bits; rows from the bottom up."""
    rows, columns = pixels.shape[:2]
    if pixels.ndim == 2:
        bits, shown = 8, pixels
        grey = np.arange(256, dtype=np.uint8)
        palette = np.stack([grey, grey, grey, np.zeros_like(grey)], 1).tobytes()
    else:
        bits, palette, shown = 24, b"", pixels[:, :, ::-1].reshape(rows, -1)
    padded = np.zeros((rows, (shown.shape[1] + 3) // 4 * 4), np.uint8)
    padded[:, : shown.shape[1]] = shown[::-1]
    body = padded.tobytes()
    start = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", start + len(body), 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, columns, rows, 1, bits, 0, len(body), 2835, 2835, len(palette) // 4, 0)
    return head + info + palette + body


def _numbers(data: bytes, at: int, count: int) -> tuple[list[int], int]:
    """``count`` numbers of a Netpbm header and the place after them."""
    found: list[int] = []
    while len(found) < count:
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            at = data.find(b"\n", at) if data[at] == 35 else at + 1
            if at < 0:
                raise ValueError("comment without end")
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        found.append(int(data[at:end]))
        at = end
    return found, at


def decode_netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    if data[:1] != b"P" or not 1 <= kind <= 6:
        raise ValueError("no Netpbm image")
    bitmap = kind in (1, 4)
    header, at = _numbers(data, 2, 2 if bitmap else 3)
    columns, rows, most = (*header, 1)[:3]
    if columns < 1 or rows < 1 or not 1 <= most <= 255:
        raise ValueError("unsupported size or depth")
    depth = 3 if kind in (3, 6) else 1
    count = rows * columns * depth
    if kind == 1:
        digits = bytes(c for c in data[at:] if c in b"01")
        values = 1 - (np.frombuffer(digits[:count], np.uint8) - 48)
    elif kind in (2, 3):
        values = np.array(data[at:].split()[:count], np.int64)
    elif kind == 4:
        width = (columns + 7) // 8
        packed = np.frombuffer(data, np.uint8, rows * width, at + 1).reshape(rows, width)
        values = 1 - np.unpackbits(packed, axis=1)[:, :columns].reshape(-1)
    else:
        values = np.frombuffer(data, np.uint8, count, at + 1)
    if len(values) < count or values.max(initial=0) > most:
        raise ValueError("samples are missing or too large")
    if most != 255:
        values = (values.astype(np.int64) * 255 + most // 2) // most
    shape = (rows, columns) if depth == 1 else (rows, columns, 3)
    return values.astype(np.uint8).reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    magic, _, _, _, start = struct.unpack_from("<2sIHHI", data)
    size, columns, rows, _, bits, packing, _, _, _, used, _ = struct.unpack_from("<IiiHHIIiiII", data, 14)
    if magic != b"BM" or size < 40 or packing != 0 or bits not in (1, 4, 8, 24, 32) or columns < 1 or rows == 0:
        raise ValueError("unsupported bitmap")
    height = abs(rows)
    width = (columns * bits + 31) // 32 * 4
    body = np.frombuffer(data, np.uint8, height * width, start).reshape(height, width)
    if rows > 0:
        body = body[::-1]
    if bits >= 24:
        samples = body[:, : columns * bits // 8].reshape(height, columns, bits // 8)
        return np.ascontiguousarray(samples[:, :, 2::-1])
    if bits == 8:
        index = body[:, :columns]
    elif bits == 4:
        index = np.stack([body >> 4, body & 15], 2).reshape(height, -1)[:, :columns]
    else:
        index = np.unpackbits(body, axis=1)[:, :columns]
    colours = np.frombuffer(data, np.uint8, (used or 1 << bits) * 4, 14 + size).reshape(-1, 4)
    shown = colours[index][:, :, 2::-1]
    if (colours[:, 0] == colours[:, 1]).all() and (colours[:, 1] == colours[:, 2]).all():
        shown = shown[:, :, 0]
    return np.ascontiguousarray(shown)


def decode_media(data: bytes | None) -> np.ndarray | None:
    try:
        return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)
    except (ValueError, IndexError, struct.error, TypeError):
        return None


def area_resize(pixels: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means over equal rectangles, as doubles; grey or colour."""
    flat = pixels.astype(np.int64).reshape(pixels.shape[0], pixels.shape[1], -1)
    total = np.zeros((flat.shape[0] + 1, flat.shape[1] + 1, flat.shape[2]), np.int64)
    np.cumsum(np.cumsum(flat, 0), 1, out=total[1:, 1:])

    def corners(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        edge = np.arange(parts + 1) * size
        low = np.minimum(edge // parts, size - 1)
        return low, (edge - low * parts) / parts

    y, dy = corners(flat.shape[0], rows)
    x, dx = corners(flat.shape[1], columns)
    lines = total[y] + (total[y + 1] - total[y]) * dy[:, None, None]
    at = lines[:, x] + (lines[:, x + 1] - lines[:, x]) * dx[None, :, None]
    sums = at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]
    means = sums / (flat.shape[0] * flat.shape[1] / (rows * columns))
    return means[:, :, 0] if pixels.ndim == 2 else means


def difference_hash(pixels: np.ndarray) -> str:
    grey = pixels if pixels.ndim == 2 else (pixels.astype(np.int64) @ np.array([299, 587, 114]) + 500) // 1000
    small = np.round(area_resize(grey, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_bytes(values: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(values), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def npy_tile(pixels: np.ndarray, side: int) -> bytes:
    means = area_resize(pixels, side, side)
    return npy_bytes(np.clip(np.rint(np.round(means, 6)), 0, 255).astype(np.uint8))


def media_columns(media: DataFrame, data: str = "media", tile: int = 32) -> DataFrame:
    """Adds ``height``, ``width``, ``tile`` (NPY, ``tile`` x ``tile``) and ``feature`` to all columns."""
    names = ["height", "width", "tile", "feature"]
    clash = set(names) & set(media.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    where = media.columns.index(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                cols: list[list] = [[], [], [], []]
                for value in part.column(where):
                    pixels = decode_media(value.as_py())
                    row = [None] * 4
                    if pixels is not None:
                        row = [pixels.shape[0], pixels.shape[1], npy_tile(pixels, tile), difference_hash(pixels)]
                    for col, item in zip(cols, row, strict=True):
                        col.append(item)
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*part.schema.names, *names]
                )

    kinds = (IntegerType(), IntegerType(), BinaryType(), StringType())
    added = [StructField(n, k) for n, k in zip(names, kinds, strict=True)]
    return media.mapInArrow(run, StructType([*media.schema.fields, *added]))


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes`` and the image of each text: P5 for an odd number of rows, else BMP."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                media, sizes = [], []
                for value in part.column(1):
                    raw = (value.as_py() or "").encode()
                    rows = max(1, -(-len(raw) // COLUMNS))
                    pixels = np.frombuffer(raw.ljust(rows * COLUMNS, b"\0"), np.uint8).reshape(rows, COLUMNS)
                    media.append(encode_netpbm(pixels) if rows % 2 else encode_bmp(pixels))
                    sizes.append(len(raw))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"]
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, media binary")


def stored_text_media(docs: DataFrame, tile: int = 32) -> DataFrame:
    """Store the texts' images as a table, read it again, and describe what was read."""
    stored = pin(text_media(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                media = [x.as_py() for x in part.column(2)]
                got = [decode_media(x) for x in media]
                raw = [x.tobytes() for x in got]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(map(len, raw), pa.int64()),
                     pa.array([hashlib.sha256(x).hexdigest() for x in raw]),
                     pa.array([zlib.crc32(x[-64:]) for x in raw], pa.int64()),
                     pa.array(map(len, media), pa.int64()),
                     pa.array([hashlib.sha256(x).hexdigest() for x in media]),
                     pa.array([difference_hash(x) for x in got]),
                     pa.array([npy_tile(x, tile) for x in got], pa.binary())],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
                           "media_bytes", "media_sha256", "feature", "tile"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored.mapInArrow(
        run,
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string, tile binary",
    )
    return rows.withColumn("tile", F.sha2("tile", 256)).withColumnRenamed("tile", "tile_sha256")
