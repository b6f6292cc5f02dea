"""Media columns: Netpbm and BMP images to numpy arrays, area-resized by integral images, NPY tiles, difference hashes.

Edge cases: null and empty payloads are padded to one block; formats other than P1 to P6 and uncompressed BMP of 8, 24
or 32 bits are refused with ValueError by ``decode``; equal payloads give equal images, tiles and hashes.
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
from pyspark.sql.types import BinaryType, LongType, StringType

from .common import col, plain, sliced, staged, with_fields

#: Payload bytes come in multiples of this; the tiles' side.
BLOCK, TILE = 576, 16


def netpbm(pixels: np.ndarray) -> bytes:
    """P5 of a grey array, P6 of an RGB array."""
    h, w = pixels.shape[:2]
    return b"P%d\n%d %d\n255\n" % (6 if pixels.ndim == 3 else 5, w, h) + np.ascontiguousarray(pixels).tobytes()


def bmp(pixels: np.ndarray) -> bytes:
    """A 24-bit BMP of an RGB array, or an 8-bit one with a grey palette."""
    h, w = pixels.shape[:2]
    grey = pixels.ndim == 2
    rows = (pixels if grey else pixels[:, :, ::-1]).reshape(h, -1)[::-1]
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4)))
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if grey else b""
    start = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if grey else 24, 0, rows.size, 2835, 2835, 256 * grey, 0) + palette + rows.tobytes()


def _fields(data: bytes, n: int) -> tuple[list[int], int]:
    """Numbers of a Netpbm header, comments left out, and where the samples begin."""
    found, at = [], 2
    while len(found) < n:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            while data[at : at + 1] not in (b"\n", b""):
                at += 1
            continue
        first = at
        while data[at : at + 1].isdigit():
            at += 1
        if first == at:
            raise ValueError("bad Netpbm header")
        found.append(int(data[first:at]))
    return found, at + 1


def decode(data: bytes) -> np.ndarray:
    """The samples of an image: height x width, x 3 for colour; 8 bits, or 16 for Netpbm of greater range."""
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        kind = int(data[1:2])
        (w, h, *top), at = _fields(data, 2 if kind in (1, 4) else 3)
        planes = 3 if kind in (3, 6) else 1
        if kind == 4:
            bits = np.unpackbits(np.frombuffer(data, np.uint8, h * -(-w // 8), at).reshape(h, -1), axis=1)[:, :w]
            return (1 - bits) * np.uint8(255)
        if kind in (1, 2, 3):
            body = b"\n".join(line.split(b"#")[0] for line in data[at - 1 :].split(b"\n"))
            if kind == 1:
                body = b" ".join(bytes((b,)) for b in body if b in b"01")
            samples = np.array(body.split(), np.int64)[: w * h * planes]
            if kind == 1:
                return ((1 - samples) * 255).astype(np.uint8).reshape(h, w)
            samples = samples.astype(np.uint8 if top[0] < 256 else np.uint16)
        else:
            samples = np.frombuffer(data, np.uint8 if top[0] < 256 else ">u2", w * h * planes, at)
        return samples.reshape((h, w, 3) if planes == 3 else (h, w))
    if data[:2] == b"BM":
        start, size, w, h, _, bits, packed = struct.unpack_from("<I I i i H H I", data, 10)
        if packed or bits not in (8, 24, 32) or size < 40:
            raise ValueError("only uncompressed BMP of 8, 24 or 32 bits")
        stride = (w * bits // 8 + 3) // 4 * 4
        rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)
        rows = (rows[::-1] if h > 0 else rows)[:, : w * bits // 8]
        if bits > 8:
            return rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1]
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(used, 4)[:, 2::-1]
        out = palette[rows]
        return out[:, :, 0] if (palette == palette[:, :1]).all() else out
    raise ValueError("not Netpbm or BMP")


def area_resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the areas that the new pixels cover, from one integral image; edges inside a pixel count by share."""
    h, w = grey.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(grey, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def along(table: np.ndarray, size: int, n: int, axis: int) -> np.ndarray:
        edge = np.arange(n + 1) * (size / n)
        low = np.minimum(edge.astype(np.int64), size - 1)
        part = (edge - low).reshape((-1, 1) if axis == 0 else (1, -1))
        return np.diff(np.take(table, low, axis) * (1 - part) + np.take(table, low + 1, axis) * part, axis=axis)

    return along(along(total, h, height, 0), w, width, 1) / (h / height * (w / width))


def difference_hash(grey: np.ndarray) -> int:
    """64 bits: whether each of 8 x 9 areas is darker than its right neighbour."""
    small = np.round(area_resize(grey, 8, 9), 6)
    return int.from_bytes(np.packbits(small[:, :-1] < small[:, 1:]).tobytes(), "big")


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def to_grey(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.ndim == 2 else pixels.mean(axis=2)


def encode_payload(payload: bytes) -> bytes:
    """A padded payload as an image, by the number of its blocks: grey Netpbm, colour Netpbm, or BMP."""
    kind = len(payload) // BLOCK % 3
    samples = np.frombuffer(payload, np.uint8)
    if kind == 0:
        return netpbm(samples.reshape(-1, 24))
    pixels = samples.reshape(-1, 16, 3)
    return netpbm(pixels) if kind == 1 else bmp(pixels)


def media_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts stored as images: doc_id, n_bytes, media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            images = [encode_payload(r + b"\xff" * ((-len(r)) % BLOCK or (0 if r else BLOCK))) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(images, pa.binary())], ["doc_id", "n_bytes", "media"])

    key = df.schema[id_col].dataType.simpleString()
    return df.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, f"doc_id {key}, n_bytes long, media binary")


def media_features(media: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, the decoded payload's digests, the stored form's, the difference hash and the NPY tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            rows = []
            for data in batch.column(batch.num_columns - 1).to_pylist():
                pixels = decode(data)
                payload = np.ascontiguousarray(pixels).tobytes()
                grey = to_grey(pixels)
                tile = npy(np.rint(area_resize(grey, TILE, TILE)).astype(np.uint8))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), f"{difference_hash(grey):016x}", tile))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, t) for c, t in zip(columns, arrow, strict=True))], schema.names)

    more = (("payload_bytes", LongType()), ("payload_sha256", StringType()), ("tail_crc32", LongType()), ("media_bytes", LongType()), ("media_sha256", StringType()), ("difference_hash", StringType()), ("tile_npy", BinaryType()))
    arrow = [{LongType: pa.int64(), StringType: pa.string(), BinaryType: pa.binary()}[type(t)] for _, t in more]
    schema = with_fields(media, keep, *more)
    return plain(media, keep, F.col("media")).mapInArrow(run, schema)


def media_query(docs: DataFrame) -> DataFrame:
    """Every text stored as an image in the shared folder, read back, decoded and described; the NPY tiles are written
    there as well, and the feature is the difference hash with the checksum of the tile read back."""
    stored = staged(media_table(docs), "media", rows=500)
    tiles = staged(media_features(stored, ["doc_id", "n_bytes"]), "tiles", rows=500)
    feature = F.concat("difference_hash", F.lit("-"), F.lpad(F.lower(F.hex(F.crc32("tile_npy"))), 8, "0"))
    return tiles.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
