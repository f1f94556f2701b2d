"""Operator 1, media columns: bytes as PNG images in a binary column, and a perceptual hash of each image.

`png_encode` writes 8-bit grey or RGB samples as a PNG file whose image data is one zlib stream cut into IDAT chunks.
`png_decode` tests the signature, the order and the CRC of every chunk, and zlib's own checksum, then undoes the five row
filters with numpy. `cosine_hash` shrinks the image to 32 x 32 grey samples by area means and keeps the signs of the 8 x 8
lowest cosine-transform frequencies against their median (the constant one aside): 64 bits.

Nulls count as empty. An empty text gives one row of spaces. Equal bytes give equal files and hashes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingspark.llm.arrays import in_small_batches

SIGNATURE = b"\x89PNG\r\n\x1a\n"
ROW = 192
IDAT_BYTES = 1 << 16


class MediaError(ValueError):
    """The stored form is damaged."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _filtered(rows: np.ndarray, bpp: int, kinds: tuple[int, ...]) -> np.ndarray:
    """Each row under the filter, of `kinds`, with the least sum of absolute differences; a filter byte before each."""
    up = np.zeros_like(rows)
    up[1:] = rows[:-1]
    left = np.zeros_like(rows)
    left[:, bpp:] = rows[:, :-bpp]
    corner = np.zeros_like(rows)
    corner[:, bpp:] = up[:, :-bpp]
    forms = {0: lambda: rows, 1: lambda: rows - left, 2: lambda: rows - up}
    forms[3] = lambda: rows - ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)

    def paeth() -> np.ndarray:
        a, b, c = (x.astype(np.int16) for x in (left, up, corner))
        pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        return rows - np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)

    forms[4] = paeth
    made = [forms[k]() for k in kinds]
    cost = np.stack([np.abs(m.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64) for m in made])
    best = cost.argmin(axis=0)
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    for i, (kind, m) in enumerate(zip(kinds, made, strict=True)):
        out[best == i, 0] = kind
        out[best == i, 1:] = m[best == i]
    return out


def png_encode(samples: bytes, width: int, channels: int = 3, kinds: tuple[int, ...] = (0, 1, 2), level: int = 1) -> bytes:
    """A PNG file with these samples, row by row; their number must be a multiple of width * channels."""
    stride = width * channels
    if not samples or len(samples) % stride:
        raise MediaError(f"{len(samples)} samples don't fill rows of {stride}")
    rows = np.frombuffer(samples, np.uint8).reshape(-1, stride)
    body = zlib.compress(_filtered(rows, channels, kinds).tobytes(), level)
    header = struct.pack(">IIBBBBB", width, len(rows), 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    return b"".join([SIGNATURE, _chunk(b"IHDR", header), *(_chunk(b"IDAT", body[i : i + IDAT_BYTES]) for i in range(0, len(body), IDAT_BYTES)), _chunk(b"IEND", b"")])


def _unfiltered(raw: np.ndarray, bpp: int) -> np.ndarray:
    kinds, rows = raw[:, 0], raw[:, 1:].copy()
    if not kinds.any():
        return rows
    if kinds.max() > 4:
        raise MediaError("unknown row filter")
    height, stride = rows.shape
    sub = kinds == 1
    if sub.any():
        rows[sub] = np.add.accumulate(rows[sub].reshape(-1, stride // bpp, bpp), axis=1, dtype=np.uint8).reshape(-1, stride)
    if not (kinds > 1).any():
        return rows
    y = 0
    while y < height:
        kind = kinds[y]
        if kind == 2:  # a run of rows that add to the one above is one running sum
            end = y + 1
            while end < height and kinds[end] == 2:
                end += 1
            if y:
                rows[y] += rows[y - 1]
            rows[y:end] = np.add.accumulate(rows[y:end], axis=0, dtype=np.uint8)
            y = end
            continue
        if kind > 2:
            above = rows[y - 1].reshape(-1, bpp).astype(np.int16) if y else np.zeros((stride // bpp, bpp), np.int16)
            line = rows[y].reshape(-1, bpp)
            a = c = np.zeros(bpp, np.int16)
            for x in range(len(line)):
                b = above[x]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
                line[x] = (line[x] + guess) & 255
                a, c = line[x].astype(np.int16), b
        y += 1
    return rows


def png_decode(data: bytes) -> tuple[np.ndarray, int]:
    """(samples as height x stride, channels); raises MediaError on any damage."""
    if data[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, header, parts, stream, ended = 8, None, [], zlib.decompressobj(), False
    while at < len(data):
        if len(data) - at < 12:
            raise MediaError("cut chunk")
        (length,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + length]
        if len(data) - at < 12 + length or struct.unpack_from(">I", data, at + 8 + length)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise MediaError(f"checksum of {kind!r}")
        at += 12 + length
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            try:
                parts.append(stream.decompress(body))
            except zlib.error as error:
                raise MediaError(str(error)) from error
        elif kind == b"IEND":
            ended = True
            break
    if header is None or not ended or not stream.eof:
        raise MediaError("cut file")
    width, height, depth, colour, *rest = header
    if depth != 8 or colour not in (0, 2) or any(rest):
        raise MediaError("only 8-bit grey or RGB without interlace is read")
    channels = 1 if colour == 0 else 3
    raw = np.frombuffer(b"".join(parts), np.uint8)
    if len(raw) != height * (width * channels + 1):
        raise MediaError("wrong number of samples")
    return _unfiltered(raw.reshape(height, -1), channels), channels


SIDE, LOW = 32, 8
_k = np.arange(SIDE)
_DCT = np.cos(np.pi * (2 * _k[None, :] + 1) * _k[:LOW, None] / (2 * SIDE))


def _means(x: np.ndarray, n: int) -> np.ndarray:
    """n area means along the first axis, of equal shares of it."""
    total = np.zeros((len(x) + 1, *x.shape[1:]))
    np.cumsum(x, axis=0, out=total[1:])
    edge = np.arange(n + 1) * (len(x) / n)
    low = np.minimum(edge.astype(np.int64), len(x) - 1)
    at = total[low] + (edge - low)[:, None] * x[low]
    return np.diff(at, axis=0) * (n / len(x))


def cosine_hash(samples: np.ndarray, channels: int) -> bytes:
    grey = samples.reshape(len(samples), -1, channels).mean(axis=2) if channels > 1 else samples.astype(float)
    small = _means(_means(grey, SIDE).T, SIDE).T
    low = np.round(_DCT @ small @ _DCT.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def media_columns(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media, image_hash, read_back): each text as an RGB PNG of 64 pixels a row, and what was read back from it.

    One narrow pass without a shuffle: a lost executor costs its own partitions only.
    """
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                sizes, media, hashes, back = [], [], [], []
                for value in batch.column(1):
                    payload = (value.as_py() or "").encode()
                    sizes.append(len(payload))
                    payload += b" " * (-len(payload) % ROW or (0 if payload else ROW))
                    media.append(stored := png_encode(payload, ROW // 3))
                    samples, channels = png_decode(stored)
                    hashes.append(cosine_hash(samples, channels))
                    back.append(samples.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(hashes, pa.binary()), pa.array(back, pa.binary())], names=[key, "n_bytes", "media", "image_hash", "read_back"])

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {key_type}, n_bytes long, media binary, image_hash binary, read_back binary")


@in_small_batches
def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's stored form."""
    rows = media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            back, media = ([x.as_py() for x in b.column(i)] for i in (4, 2))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).cast(pa.int64()), b.column(1),
                    pa.array([len(x) for x in back], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in back]), pa.array([zlib.crc32(x[-16:]) for x in back], pa.int64()),
                    pa.array([len(x) for x in media], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in media]), pa.array([x.as_py().hex() for x in b.column(3)]),
                ],
                names=[f.split()[0] for f in digest.split(", ")],
            )

    return rows.mapInArrow(run, digest)
