"""Media columns: Netpbm and BMP to numpy arrays, area resizing, NPY tiles, difference hashes.

Images are 8-bit: an array has shape (height, width) or (height, width, 3).
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_SPACE = b" \t\n\r\x0b\x0c"


def _fields(data: bytes, count: int) -> tuple[list[int], int]:
    """count numbers of a Netpbm header, with comments left out; the place after the last one."""
    found: list[int] = []
    at = 2
    while len(found) < count:
        m = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)").match(data, at)
        if not m:
            raise ValueError("the Netpbm header is cut off")
        found.append(int(m[1]))
        at = m.end()
    return found, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as 8-bit samples; bitmaps give 0 (black) and 255, other maxima are scaled to 255."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    bitmap, plain, colour = kind in (b"P1", b"P4"), kind in (b"P1", b"P2", b"P3"), kind in (b"P3", b"P6")
    head, at = _fields(data, 2 if bitmap else 3)
    width, height, top = (*head, 1) if bitmap else head
    if not (width > 0 and height > 0 and 0 < top < 65536):
        raise ValueError("bad size in the Netpbm header")
    shape = (height, width, 3) if colour else (height, width)
    n = int(np.prod(shape))
    if plain:
        body = re.sub(rb"#[^\n\r]*", b"", data[at:])
        cells = re.findall(rb"[01]" if bitmap else rb"\d+", body)[:n]
        if len(cells) < n:
            raise ValueError("the Netpbm samples are cut off")
        values = np.array(cells, dtype="S8").astype(np.int64)
    else:
        if data[at : at + 1] not in [bytes([c]) for c in _SPACE]:
            raise ValueError("the Netpbm header has no end")
        raw = data[at + 1 :]
        need = height * ((width + 7) // 8) if bitmap else n * (2 if top > 255 else 1)
        if len(raw) < need:
            raise ValueError("the Netpbm samples are cut off")
        if bitmap:
            rows = np.frombuffer(raw, np.uint8, need).reshape(height, -1)
            values = np.unpackbits(rows, axis=1)[:, :width]
        elif top == 255:
            return np.frombuffer(raw, np.uint8, need).reshape(shape)
        else:
            values = np.frombuffer(raw, ">u2" if top > 255 else np.uint8, n)
    values = values.reshape(shape).astype(np.int64)
    if bitmap:
        return ((1 - values) * 255).astype(np.uint8)
    return ((values * 255 + top // 2) // top).clip(0, 255).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 bits (through its palette), 24 or 32 bits; grey palettes give one channel."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    start = struct.unpack_from("<I", data, 10)[0]
    head, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed not in (0,) or bits not in (8, 24, 32) or width <= 0 or height == 0:
        raise ValueError("unsupported BMP")
    stride, n = (width * bits // 8 + 3) // 4 * 4, abs(height)
    if len(data) < start + stride * n:
        raise ValueError("the BMP samples are cut off")
    rows = np.frombuffer(data, np.uint8, stride * n, start).reshape(n, stride)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.zeros((256, 3), np.uint8)
        table = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(used, 4)
        palette[:used] = table[:, 2::-1]
        if (palette[:, 0] == palette[:, 1]).all() and (palette[:, 0] == palette[:, 2]).all():
            return palette[:, 0][rows]
        return palette[rows]
    return np.ascontiguousarray(rows.reshape(n, width, bits // 8)[:, :, 2::-1])


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey BMP."""
    height, width = samples.shape
    stride = (width + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = samples[::-1]
    grey = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    grey[:, 3] = 0
    start = 54 + 1024
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", start + rows.size, 0, 0, start, 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0) + grey.tobytes() + rows.tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return ((image.astype(np.uint32) @ np.array([299, 587, 114], np.uint32) + 500) // 1000).astype(np.uint8)


def resize_area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's area, fractions of samples included, from an integral image."""
    h, w = image.shape
    down, across = np.arange(height + 1) * h / height, np.arange(width + 1) * w / width

    # The integral is linear between whole places, so fractional borders are interpolated.
    # Summing across the short rows first keeps the work at the size of the image.
    sums = np.zeros((h, w + 1))
    np.cumsum(image, axis=1, dtype=np.float64, out=sums[:, 1:])
    low = np.minimum(across.astype(np.int64), w - 1)
    part = sums[:, low] + (across - low) * (sums[:, low + 1] - sums[:, low])
    whole = np.zeros((h + 1, width + 1))
    np.cumsum(part, axis=0, out=whole[1:])
    low = np.minimum(down.astype(np.int64), h - 1)
    corner = whole[low] + (down - low)[:, None] * (whole[low + 1] - whole[low])
    cells = np.diff(np.diff(corner, axis=0), axis=1) / ((h / height) * (w / width))
    return np.clip(np.rint(cells), 0, 255).astype(np.uint8)


def difference_hash(image: np.ndarray) -> str:
    """64 bits, as hexadecimal: whether each of 8 x 9 cells is darker than its right neighbour."""
    cells = resize_area(grey(image), 8, 9)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def encode_npy(samples: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(samples), allow_pickle=False)
    return out.getvalue()


def decode_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def media_tiles(media: DataFrame, id_col: str, media_col: str, side: int = 16) -> DataFrame:
    """Per image: width, height, channels, dhash, and tile, a side x side NPY file of its grey values.

    Null or undecodable media keep their row, with an error text and the other
    columns null. Repeated rows stay repeated; other columns are left behind.
    """

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, data in zip(batch["id"], batch["media"], strict=True):
                try:
                    image = decode(bytes(data if data is not None else b""))
                    rows.append((key, image.shape[1], image.shape[0], 1 if image.ndim == 2 else 3, difference_hash(image), encode_npy(resize_area(grey(image), side, side)), None))
                except ValueError as e:
                    rows.append((key, None, None, None, None, None, str(e)))
            out = pd.DataFrame(rows, columns=["id", "width", "height", "channels", "dhash", "tile", "error"], dtype=object)
            yield out.rename(columns={"id": id_col})

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(media[id_col].alias("id"), media[media_col].alias("media")).mapInPandas(
        tiles, f"`{id_col}` {kind}, width int, height int, channels int, dhash string, tile binary, error string"
    )


def store(payload: bytes, form: str) -> bytes:
    """payload as 8-bit samples, 64 to a row."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    return {"pgm": encode_pgm, "bmp": encode_bmp, "npy": encode_npy}[form](samples)


def read_back(data: bytes) -> np.ndarray:
    return decode_npy(data) if data[:6] == b"\x93NUMPY" else decode(data)


def text_media(docs: DataFrame, form: str = "pgm", side: int = 16) -> DataFrame:
    """Store every whole text as an image, read it back and describe it.

    Per row of docs: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature (the difference hash) and tile, an NPY file.
    A null text counts as empty, and an empty one fills one row of 64 zeros. Rows
    with a null doc_id and repeated rows are kept as they are; columns of docs
    beside doc_id and text are not read. One row is in memory at a time, so the
    longest text bounds a task.
    """

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                data = text.encode("utf-8") if isinstance(text, str) else b""
                media = store(data + bytes(-len(data) % 64 or (0 if data else 64)), form)
                image = read_back(media)
                back = image.tobytes()
                rows.append((key, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), encode_npy(resize_area(image, side, side))))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"])
            out["doc_id"] = pd.array([None if pd.isna(k) else int(k) for k in out["doc_id"]], dtype="Int64")
            yield out

    return docs.select("doc_id", "text").mapInPandas(
        describe, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"
    )
