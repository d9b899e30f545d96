"""Greyscale PNG tiles without an image library: encoding, decoding, tile tables."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(image: np.ndarray) -> bytes:
    """An 8- or 16-bit greyscale image (rows, columns)."""
    depth = 16 if image.dtype.itemsize == 2 else 8
    rows = image.astype(">u2" if depth == 16 else "u1")
    raw = b"".join(b"\0" + r.tobytes() for r in rows)
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], depth, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """(rows, columns, channels) of a PNG that is neither interlaced nor paletted."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = head
    if depth not in (8, 16) or colour == 3 or interlaced:
        raise ValueError("unsupported PNG")
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    step = channels * depth // 8
    raw = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), dtype=np.uint8)
    above = np.zeros(width * step, dtype=np.uint8)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].copy()
        if kind == 1:
            line = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            cur, up = line.astype(int), above.astype(int)
            for x in range(len(cur)):
                left = cur[x - step] if x >= step else 0
                corner = up[x - step] if x >= step else 0
                if kind == 3:
                    guess = (left + up[x]) // 2
                else:
                    p = left + up[x] - corner
                    guess = min((left, up[x], corner), key=lambda v: abs(p - v))
                cur[x] = (cur[x] + guess) & 255
            line = cur.astype(np.uint8)
        out[y] = above = line
    pixels = out.view(">u2").astype(np.uint16) if depth == 16 else out
    return pixels.reshape(height, width, channels)


def png_tiles(dense: DataFrame) -> DataFrame:
    """(tn, tw, image array of 256 * 256) -> (tn, tw, content): one 16-bit PNG for each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [encode_png(np.clip(np.array(v.as_py()), 0, 65535).astype(np.uint16).reshape(256, 256)) for v in batch.column("image")]
            yield pa.RecordBatch.from_arrays([batch.column("tn"), batch.column("tw"), pa.array(content, pa.binary())], ["tn", "tw", "content"])

    return dense.selectExpr("cast(tn as bigint) tn", "cast(tw as bigint) tw", "image").mapInArrow(run, "tn long, tw long, content binary")


def pixels(tiles: DataFrame, *keys: str) -> DataFrame:
    """(keys, r, c, value): the pixels of image files' first channel that are not 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, content in enumerate(batch.column("content")):
                image = decode_png(content.as_py())[:, :, 0]
                r, c = np.nonzero(image)
                held = [pa.array([batch.column(k)[i].as_py()] * len(r), pa.int64()) for k in keys]
                yield pa.RecordBatch.from_arrays([*held, pa.array(r, pa.int64()), pa.array(c, pa.int64()), pa.array(image[r, c].astype(np.int64))], [*keys, "r", "c", "value"])

    shape = ", ".join([*(f"{k} long" for k in keys), "r long", "c long", "value long"])
    return tiles.select(*keys, "content").mapInArrow(run, shape)
