"""PNG and BMP images as RGBA rows, and back, with the standard library only. Other formats need a decoder of their own:
register one with register_decoder()."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PNG = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type: grey, RGB, palette, grey with alpha, RGBA.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_decoders: dict[str, Callable[[bytes], np.ndarray]] = {}
_encoders: dict[str, Callable[[np.ndarray], bytes]] = {}


def register_decoder(ext: str, decode: Callable[[bytes], np.ndarray], encode: Callable[[np.ndarray], bytes]) -> None:
    _decoders[ext], _encoders[ext] = decode, encode


def _unfiltered(raw: bytes, height: int, row: int, step: int) -> np.ndarray:
    out, before, at = np.empty((height, row), np.uint8), np.zeros(row, np.uint8), 0
    for y in range(height):
        kind, line = raw[at], np.frombuffer(raw, np.uint8, row, at + 1).copy()
        at += row + 1
        if kind == 1:
            for x in range(step):
                line[x::step] = np.cumsum(line[x::step], dtype=np.uint8)
        elif kind == 2:
            line += before
        elif kind in (3, 4):  # each byte depends on the one just made
            for x in range(row):
                a = int(line[x - step]) if x >= step else 0
                b, c = int(before[x]), int(before[x - step]) if x >= step else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                line[x] = (int(line[x]) + guess) & 255
        elif kind:
            raise ValueError("unknown PNG filter")
        out[y] = before = line
    return out


def decode_png(data: bytes) -> np.ndarray:
    if not data.startswith(PNG):
        raise ValueError("not a PNG image")
    at, chunks = 8, {}
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        chunks[kind] = chunks.get(kind, b"") + data[at + 8 : at + 8 + n]
        at += 12 + n
    try:
        width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
        if depth != 8 or interlaced or colour not in SAMPLES:
            raise ValueError("this kind of PNG image is not supported")
        n = SAMPLES[colour]
        px = _unfiltered(zlib.decompress(chunks[b"IDAT"]), height, width * n, n).reshape(height, width, n)
    except (KeyError, struct.error, zlib.error, IndexError) as error:
        raise ValueError("a broken PNG image") from error
    if colour == 3:
        palette = np.frombuffer(chunks[b"PLTE"], np.uint8).reshape(-1, 3)
        alpha = np.full(len(palette), 255, np.uint8)
        given = np.frombuffer(chunks.get(b"tRNS", b""), np.uint8)
        alpha[: len(given)] = given
        return np.concatenate([palette, alpha[:, None]], axis=1)[px[..., 0]]
    rgb = np.repeat(px[..., :1], 3, -1) if n < 3 else px[..., :3]
    return np.concatenate([rgb, px[..., -1:] if n in (2, 4) else np.full((height, width, 1), 255, np.uint8)], axis=-1)


def encode_png(image: np.ndarray) -> bytes:
    h, w = image.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, w * 4)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def decode_dib(data: bytes, bits_at: int | None = None) -> np.ndarray:
    """An uncompressed bitmap of 24 or 32 bits, beginning with its information header."""
    if len(data) < 40:
        raise ValueError("not a bitmap")
    size, w, h, _, depth, packed = struct.unpack_from("<IiiHHI", data)
    at = size if bits_at is None else bits_at
    if packed or depth not in (24, 32) or w <= 0 or not h:
        raise ValueError("this kind of bitmap is not supported")
    stride = (w * depth // 8 + 3) // 4 * 4
    if at + stride * abs(h) > len(data):
        raise ValueError("a broken bitmap")
    px = np.frombuffer(data, np.uint8, stride * abs(h), at).reshape(abs(h), stride)[:, : w * depth // 8].reshape(abs(h), w, depth // 8)
    px = px[::-1] if h > 0 else px
    return np.concatenate([px[..., 2::-1], np.full((abs(h), w, 1), 255, np.uint8)], axis=-1)


def encode_dib(image: np.ndarray) -> bytes:
    h, w = image.shape[:2]
    stride = (w * 3 + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : w * 3] = image[::-1, :, 2::-1].reshape(h, w * 3)
    return struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, stride * h, 0, 0, 0, 0) + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a bitmap")
    return decode_dib(data[14:], struct.unpack_from("<I", data, 10)[0] - 14)


def encode_bmp(image: np.ndarray) -> bytes:
    dib = encode_dib(image)
    return b"BM" + struct.pack("<IHHI", 14 + len(dib), 0, 0, 54) + dib


register_decoder(".png", decode_png, encode_png)
register_decoder(".bmp", decode_bmp, encode_bmp)


def decode(data: bytes, ext: str) -> np.ndarray:
    if ext not in _decoders:
        raise ValueError(f"no decoder for {ext}")
    return _decoders[ext](data)


def encode(image: np.ndarray, ext: str) -> bytes:
    return _encoders[ext](image)


def decoded(files: DataFrame) -> DataFrame:
    """Pixels of images (relative, ext, content): image_id, ext, w, h, data (RGBA rows), error."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, ext, content in zip(b["relative"], b["ext"], b["content"]):
                try:
                    image = decode(content, ext)
                    rows.append((name, ext, image.shape[1], image.shape[0], image.tobytes(), None))
                except ValueError as error:
                    rows.append((name, ext, 0, 0, None, str(error)))
            yield pd.DataFrame(rows, columns=["image_id", "ext", "w", "h", "data", "error"])

    return files.select("relative", "ext", "content").mapInPandas(each, "image_id string, ext string, w int, h int, data binary, error string")
