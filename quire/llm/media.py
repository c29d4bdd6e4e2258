"""Media columns: Netpbm and BMP bytes decoded to arrays, resized, tiled and hashed.

``decode`` reads P1 to P6 and uncompressed 8, 24 and 32 bit BMP into numpy
arrays, ``area_resize`` averages exact box areas by integral images,
``npy_tiles`` writes tiles as NPY bytes and ``difference_hash`` compares
neighbouring cells of a 9 x 8 reduction.

Defined cases: null bytes or null text count as empty; a malformed image raises
``ValueError`` in ``decode`` and gives null columns in ``media_columns``; equal
bytes give equal values, so repeated rows and ties agree; extra columns pass
through, but one of the name of a result is replaced.  Each row is worked on alone,
so memory is bounded by the longest row.

The query goes all the way: a text is stored as PGM, decoded, written as NPY tiles,
and payload and features are computed from the tiles that were read back.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import ship, table

QUERY = "op3_media_columns"
ORACLE_SQL = None

WIDTH = 64
_HEADER_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)")


def encode_pgm(payload: bytes, width: int = WIDTH) -> bytes:
    """8-bit grey samples, row by row, as binary PGM; the payload is a multiple of the width."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must fill whole rows")
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def encode_bmp(grey: np.ndarray) -> bytes:
    """8-bit grey BMP: rows from the bottom, padded to four bytes."""
    h, w = grey.shape
    rows = np.zeros((h, (w + 3) // 4 * 4), np.uint8)
    rows[:, :w] = grey[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    at = 14 + 40 + 1024
    head = struct.pack("<2sIHHI", b"BM", at + rows.size, 0, 0, at)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + info + palette.tobytes() + rows.tobytes()


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    at, fields = 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _HEADER_TOKEN.match(data, at)
        if not m:
            raise ValueError("bad Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    w, h, top = *fields[:2], fields[2] if len(fields) == 3 else 1
    channels = 3 if kind in (3, 6) else 1
    if w < 1 or h < 1 or not 0 < top < 65536:
        raise ValueError("bad Netpbm size")
    n = w * h * channels
    if kind == 1:  # digits may touch each other
        bits = re.sub(rb"#[^\n]*|[^01]", b"", data[at:])[:n]
        flat = 1 - (np.frombuffer(bits, np.uint8) - 48)
    elif kind in (2, 3):
        flat = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[:n], dtype=np.int64)
    elif kind == 4:
        row = (w + 7) // 8
        packed = np.frombuffer(data, np.uint8, count=row * h, offset=at + 1).reshape(h, row)
        flat = 1 - np.unpackbits(packed, axis=1)[:, :w].reshape(-1)
    else:
        flat = np.frombuffer(data, np.uint8 if top < 256 else ">u2", count=n, offset=at + 1)
    if flat.size != n:
        raise ValueError("Netpbm data is too short")
    flat = flat.astype(np.uint8 if top < 256 else np.uint16)
    return flat.reshape((h, w, 3) if channels == 3 else (h, w))


def _decode_bmp(data: bytes) -> np.ndarray:
    at, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    w, h, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing or bits not in (8, 24, 32) or w < 1 or h == 0:
        raise ValueError("only uncompressed 8, 24 and 32 bit BMP is read")
    stride, rows = (w * bits // 8 + 3) // 4 * 4, abs(h)
    grid = np.frombuffer(data, np.uint8, count=stride * rows, offset=at).reshape(rows, stride)
    if h > 0:
        grid = grid[::-1]
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, count=used * 4, offset=14 + size).reshape(used, 4)[:, 2::-1]
        image = palette[grid[:, :w]]
        return image[..., 0] if (palette == palette[:, :1]).all() else image
    return grid[:, : w * bits // 8].reshape(rows, w, bits // 8)[..., 2::-1]


def decode(data: bytes | None) -> np.ndarray:
    """The image as (h, w) or (h, w, 3); bilevel images have 1 for white."""
    data = data or b""
    try:
        if re.match(rb"P[1-6]\s", data):
            return _decode_netpbm(data)
        if data[:2] == b"BM":
            return _decode_bmp(data)
    except (struct.error, IndexError) as e:
        raise ValueError(f"damaged image: {e}") from e
    raise ValueError("neither Netpbm nor BMP")


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's exact area, by an integral image (float64)."""
    grey = image.astype(np.float64)
    if grey.ndim == 3:
        grey = grey @ np.array([0.299, 0.587, 0.114])
    for axis, n in ((0, height), (1, width)):
        size = grey.shape[axis]
        total = np.concatenate([np.zeros_like(grey.take([0], axis)), np.cumsum(grey, axis)], axis)
        edges = np.arange(n + 1) * size / n
        low = np.minimum(edges.astype(np.int64), size - 1)
        part = (edges - low).reshape([-1, 1] if axis == 0 else [1, -1])
        at = total.take(low, axis) + part * grey.take(low, axis)
        grey = np.diff(at, axis=axis) * (n / size)
    return grey


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hex: is a cell of the 8 x 9 reduction darker than its right neighbour?"""
    cells = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def npy_tiles(image: np.ndarray, side: int = 256) -> list[tuple[int, int, bytes]]:
    """(row, column, NPY bytes) of each tile; border tiles are smaller."""
    tiles = []
    for y in range(0, image.shape[0], side):
        for x in range(0, image.shape[1], side):
            np.save(out := io.BytesIO(), np.ascontiguousarray(image[y : y + side, x : x + side]), allow_pickle=False)
            tiles.append((y // side, x // side, out.getvalue()))
    return tiles


def untile(tiles: list[tuple[int, int, bytes]]) -> np.ndarray:
    """The image that ``npy_tiles`` cut."""
    rows: dict[int, list] = {}
    for y, x, data in sorted(tiles):
        rows.setdefault(y, []).append(np.load(io.BytesIO(data), allow_pickle=False))
    return np.concatenate([np.concatenate(r, axis=1) for r in rows.values()], axis=0)


_MEDIA = ("height", "width", "dhash", "tiles")


def media_columns(df: DataFrame, media: str = "media", side: int = 256) -> DataFrame:
    """``df`` with ``height``, ``width``, ``dhash`` and ``tiles`` (row, col, npy) of an image column."""
    ship(df.sparkSession)
    kind = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("dhash", pa.string()), ("tiles", pa.list_(pa.struct([("row", pa.int32()), ("col", pa.int32()), ("npy", pa.binary())])))])

    def read(data: bytes | None) -> dict | None:
        try:
            image = decode(data)
        except ValueError:
            return None
        tiles = [{"row": y, "col": x, "npy": t} for y, x, t in npy_tiles(image, side)]
        return {"height": image.shape[0], "width": image.shape[1], "dhash": difference_hash(image), "tiles": tiles}

    @F.arrow_udf("struct<height:int,width:int,dhash:string,tiles:array<struct<row:int,col:int,npy:binary>>>")
    def column(data: pa.Array) -> pa.Array:
        return pa.array((read(x.as_py()) for x in data), kind)

    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in _MEDIA]
    return df.select(*kept, column(F.col(f"`{media}`")).alias("__media")).select(*kept, *(F.col(f"__media.{c}") for c in _MEDIA))


def text_media(text: str | None) -> tuple:
    """A text stored as 8-bit samples, decoded, tiled and read back from its tiles, and the features of that."""
    raw = (text or "").encode()
    padded = raw + b"\0" * ((-len(raw)) % WIDTH or (0 if raw else WIDTH))
    stored = encode_pgm(padded)
    tiles = npy_tiles(decode(stored))
    image = untile(tiles)
    back = image.tobytes()
    return (
        len(raw),
        len(back),
        hashlib.sha256(back).hexdigest(),
        zlib.crc32(back[-WIDTH:]),
        len(stored),
        hashlib.sha256(stored).hexdigest(),
        difference_hash(image),
        len(tiles),
        sum(len(t) for _, _, t in tiles),
    )


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_tiles", pa.int64()), ("tile_bytes", pa.int64())]
)


def _text_batches(batches):
    for batch in batches:
        rows = [text_media(x.as_py()) for x in batch.column("text")]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 9
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(_OUT)[1:], strict=True))], schema=_OUT
        )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(_text_batches, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_tiles long, tile_bytes long")
