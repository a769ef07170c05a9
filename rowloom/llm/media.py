"""Media columns: Netpbm and BMP images as binary columns, decoded to numpy arrays.

Images are decoded losslessly, resized by area with integral images, and written as NPY tiles with difference
hashes. Any bytes can be stored as an image too: bytes_to_media pads a payload with 255 to whole pictures, and
media_to_bytes reads the samples back.

Edge cases: a null text is an empty payload (one picture of padding); a null or undecodable image gives null
features and a reason in `error`; repeated rows get equal results; an empty table gives an empty one; payloads of any
length are stored whole; only the named columns are read, so extra columns may have any name.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm._arrow import col, map_arrow, one_pass, texts, without

#: Payload bytes of the smallest picture: 24 x 24 grey or 8 x 24 colour samples.
UNIT = 576
GREY_WIDTH, COLOUR_WIDTH = 24, 8
#: Samples that resizing turns to floating point at a time.
STRIP = 1 << 20
HASH_SIDE = 8
TILE = 16

_SPACE = b" \t\n\r\v\f"


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """Binary PGM for height x width, PPM for height x width x 3 samples of 8 bits."""
    h, w = pixels.shape[:2]
    return b"P%d\n%d %d\n255\n" % (5 if pixels.ndim == 2 else 6, w, h) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Uncompressed 24-bit BMP, bottom row first, rows padded to four bytes."""
    h, w = pixels.shape[:2]
    row = -(-3 * w // 4) * 4
    body = np.zeros((h, row), np.uint8)
    body[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)
    return struct.pack("<2sIHHI", b"BM", 54 + body.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def _netpbm_header(data: bytes, count: int) -> tuple[list[int], int]:
    """The header's numbers, with comments skipped, and where they end."""
    values, at = [], 2
    while len(values) < count:
        while at < len(data) and (data[at] in _SPACE or data[at] == 35):
            at = (data.find(b"\n", at) + 1 or len(data)) if data[at] == 35 else at + 1
        end = at
        while end < len(data) and 48 <= data[end] <= 57:
            end += 1
        if end == at:
            raise ValueError("a Netpbm header ends early")
        values.append(int(data[at:end]))
        at = end
    return values, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as uint8 or uint16 samples; bitmaps give 0 for black and 255 for white."""
    kind = data[1] - 48
    channels = 3 if kind in (3, 6) else 1
    values, at = _netpbm_header(data, 2 if kind in (1, 4) else 3)
    w, h = values[:2]
    top = values[2] if len(values) > 2 else 1
    if not 0 < top < 65536:
        raise ValueError("a Netpbm maximum is out of range")
    if kind == 1:
        bits = [c == 49 for c in data[at:] if c in b"01"]
        flat = np.where(np.array(bits[: w * h], bool), 0, 255).astype(np.uint8)
    elif kind == 4:
        rows = np.frombuffer(data, np.uint8, -(-w // 8) * h, at + 1).reshape(h, -1)
        flat = np.where(np.unpackbits(rows, axis=1)[:, :w], 0, 255).astype(np.uint8).ravel()
    elif kind in (2, 3):
        flat = np.array(data[at:].split()[: w * h * channels], np.uint16 if top > 255 else np.uint8)
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, w * h * channels, at + 1)
    if flat.size != w * h * channels:
        raise ValueError("a Netpbm image ends early")
    return flat.reshape((h, w, 3) if channels == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits as height x width x 3, top row first."""
    start, header, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or bits not in (1, 4, 8, 24, 32) or w <= 0 or h == 0:
        raise ValueError("a BMP of this kind is not supported")
    rows = np.frombuffer(data, np.uint8, -(-w * bits // 32) * 4 * abs(h), start).reshape(abs(h), -1)
    if h > 0:
        rows = rows[::-1]
    if bits >= 24:
        return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, colours * 4, 14 + header).reshape(-1, 4)[:, 2::-1]
    per = 8 // bits
    shifts = np.arange(per - 1, -1, -1, dtype=np.uint8) * np.uint8(bits)
    index = ((rows[:, :, None] >> shifts) & np.uint8((1 << bits) - 1)).reshape(abs(h), -1)[:, :w]
    return palette[index]


def decode(data: bytes) -> np.ndarray:
    if data[:2] == b"BM":
        return decode_bmp(data)
    if len(data) > 2 and data[:1] == b"P" and 49 <= data[1] <= 54:
        return decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def _integral(samples: np.ndarray, size: int) -> np.ndarray:
    """The integral along axis 0 at size + 1 even cuts, interpolated between samples. Samples are added up in strips, so
    beside them no more is held than the integral at the cuts."""
    n, rest = len(samples), samples.shape[1:]
    at = np.arange(size + 1) * (n / size)
    low = np.minimum(at.astype(np.int64), n - 1)
    part = at - low
    strip = max(1, STRIP // max(1, int(np.prod(rest))))
    out, total = np.empty((size + 1, *rest)), np.zeros(rest)
    for start in range(0, n, strip):
        block = samples[start : start + strip].astype(np.float64)
        before = np.zeros((len(block) + 1, *rest))
        np.cumsum(block, axis=0, out=before[1:])
        here = slice(*np.searchsorted(low, (start, start + len(block))))
        i = low[here] - start
        out[here] = total + before[i] + part[here].reshape(-1, *[1] * len(rest)) * block[i]
        total = total + before[-1]
    return out


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's exact area, fractions of samples included, from the integral image."""
    h, w = pixels.shape[:2]
    down = np.diff(_integral(pixels, height), axis=0)
    cells = np.diff(_integral(down.swapaxes(0, 1), width), axis=0).swapaxes(0, 1)
    return cells / ((h / height) * (w / width))


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.ndim == 2 else (pixels.astype(np.float64) @ np.array([0.299, 0.587, 0.114]))


def difference_hash(pixels: np.ndarray, side: int = HASH_SIDE) -> str:
    """Bits of whether each cell is darker than its right neighbour, as hexadecimal digits; cells are turned grey after resizing, which is the same."""
    small = np.round(grey(area_resize(pixels, side, side + 1)), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(pixels: np.ndarray, side: int = TILE) -> bytes:
    """The picture area-resized to side x side 8-bit samples, in the NPY format."""
    out = io.BytesIO()
    np.save(out, np.clip(np.round(area_resize(pixels, side, side), 0), 0, 255).astype(np.uint8))
    return out.getvalue()


def bytes_to_media(payload: bytes) -> bytes:
    """A payload padded with 255 to whole pictures: an odd number of units as PGM, an even one as BMP."""
    units = max(1, -(-len(payload) // UNIT))
    flat = np.frombuffer(payload + b"\xff" * (units * UNIT - len(payload)), np.uint8)
    return encode_netpbm(flat.reshape(-1, GREY_WIDTH)) if units % 2 else encode_bmp(flat.reshape(-1, COLOUR_WIDTH, 3))


def media_to_bytes(media: bytes) -> bytes:
    return np.ascontiguousarray(decode(media)).tobytes()


def text_to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media: every whole text stored as a picture."""
    id_type = df.schema[id_col].dataType.simpleString()

    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [t.encode() for t in texts(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(len, raw), pa.int64()), pa.array(map(bytes_to_media, raw), pa.binary())], names=["id", "n_bytes", "media"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(source, lambda batches: one_pass(batches, build), f"id {id_type}, n_bytes bigint, media binary")


FEATURES = "width int, height int, channels int, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, tile binary, dhash string, error string"


def _features(media: bytes | None) -> dict:
    try:
        if media is None:
            raise ValueError("null")
        pixels = decode(media)
        payload = np.ascontiguousarray(pixels).tobytes()
        return {
            "width": pixels.shape[1], "height": pixels.shape[0], "channels": 1 if pixels.ndim == 2 else pixels.shape[2],
            "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]),
            "tile": npy_tile(pixels), "dhash": difference_hash(pixels),
        }
    except (ValueError, IndexError, struct.error) as error:
        return {"error": str(error)}


def media_features(df: DataFrame, media_col: str = "media") -> DataFrame:
    """All columns of df (those named like a feature, in any letter case, are replaced) and the FEATURES of its images."""
    names = [f.split()[0] for f in FEATURES.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string()]
    kept = without(df.columns, tuple(names))
    own = [f"k{i}" for i in range(len(kept))]
    source = df.select(*(col(c).alias(k) for c, k in zip(kept, own, strict=True)), col(media_col).alias("media"))
    fields = [f"{k} {source.schema[k].dataType.simpleString()}" for k in own]

    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [_features(m) for m in batch.column("media").to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in own), *(pa.array([f.get(n) for f in found], t) for n, t in zip(names, types, strict=True))], names=[*own, *names])

    return map_arrow(source, lambda batches: one_pass(batches, build), ", ".join([*fields, FEATURES])).toDF(*kept, *names)
