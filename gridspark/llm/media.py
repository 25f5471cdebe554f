"""Media columns: Netpbm and BMP to arrays, area resize by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.session import scratch

from .common import documents, id_text

WIDTH = 64
_PNM_FIELD = re.compile(rb"(?:\s+|#[^\n]*\n)*([0-9]+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """Binary greymap of a 2-D uint8 array."""
    rows, cols = samples.shape
    return b"P5\n%d %d\n255\n" % (cols, rows) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey BMP, rows bottom up and padded to four bytes."""
    rows, cols = samples.shape
    stride = (cols + 3) // 4 * 4
    body = np.zeros((rows, stride), np.uint8)
    body[:, :cols] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    palette[:, 3] = 0
    start = 54 + 1024
    head = np.zeros(54, np.uint8)
    head[:2] = np.frombuffer(b"BM", np.uint8)
    fields = head[2:].view(np.uint16)
    fields[0:2] = np.array([start + body.size], "<u4").view("<u2")
    fields[4:6] = np.array([start], "<u4").view("<u2")
    fields[6:8] = np.array([40], "<u4").view("<u2")
    fields[8:12] = np.array([cols, rows], "<i4").view("<u2")
    fields[12:14] = (1, 8)
    fields[22:24] = np.array([256], "<u4").view("<u2")
    return head.tobytes() + palette.tobytes() + body.tobytes()


def decode_pnm(data: bytes) -> np.ndarray:
    """P2, P3, P5 or P6 with at most 255 as greatest value; colour keeps a third axis."""
    kind, at, fields = data[:2], 2, []
    for _ in range(3):
        found = _PNM_FIELD.match(data, at)
        if not found:
            raise ValueError("broken Netpbm header")
        fields.append(int(found[1]))
        at = found.end()
    cols, rows, top = fields
    if not 0 < top < 256 or kind not in (b"P2", b"P3", b"P5", b"P6"):
        raise ValueError("unsupported Netpbm kind")
    shape = (rows, cols) if kind in (b"P2", b"P5") else (rows, cols, 3)
    count = int(np.prod(shape))
    if kind in (b"P5", b"P6"):
        flat = np.frombuffer(data, np.uint8, count, at + 1)
    else:
        plain = re.sub(rb"#[^\n]*", b" ", data[at:]).split()
        flat = np.array(plain[:count], dtype=np.int64).astype(np.uint8)
    if flat.size != count:
        raise ValueError("short Netpbm raster")
    return flat.reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP with 8 bits and a palette, or 24 or 32 bits; bottom-up or top-down."""
    word = lambda at, kind: int(np.frombuffer(data, kind, 1, at)[0])
    start, head, cols, rows = word(10, "<u4"), word(14, "<u4"), word(18, "<i4"), word(22, "<i4")
    bits, packing = word(28, "<u2"), word(30, "<u4")
    if packing != 0 or bits not in (8, 24, 32) or cols <= 0 or rows == 0:
        raise ValueError("unsupported BMP kind")
    stride = (cols * bits // 8 + 3) // 4 * 4
    body = np.frombuffer(data, np.uint8, stride * abs(rows), start).reshape(abs(rows), stride)
    body = body[:, : cols * bits // 8]
    if rows > 0:
        body = body[::-1]
    if bits == 8:
        colours = word(46, "<u4") or 256
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + head).reshape(colours, 4)[:, 2::-1]
        out = palette[body]
        return out[:, :, 0] if (palette == palette[:, :1]).all() else out
    return body.reshape(abs(rows), cols, bits // 8)[:, :, 2::-1]


def decode_image(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_pnm(data)


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return (image.astype(np.uint32) @ np.array([299, 587, 114], np.uint32) // 1000).astype(np.uint8)


def area_resize(image: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Mean of the exact area under each target sample, from an integral image.

    Bounds between samples are interpolated in the integral image, which is exact because the
    integral of a piecewise constant image is linear inside each sample.
    """
    high, wide = image.shape
    total = np.zeros((high + 1, wide + 1), np.float64)
    np.cumsum(np.cumsum(image, 0, dtype=np.int64), 1, out=total[1:, 1:], dtype=np.float64)

    def at(edges, size, table):
        low = np.minimum(edges.astype(np.int64), size - 1)
        part = (edges - low).reshape(-1, *[1] * (table.ndim - 1))
        return table[low] * (1 - part) + table[low + 1] * part

    lines = at(np.arange(rows + 1) * (high / rows), high, total)
    cells = at(np.arange(cols + 1) * (wide / cols), wide, np.ascontiguousarray(lines.T)).T
    sums = np.diff(np.diff(cells, axis=0), axis=1)
    return np.rint(sums * (rows * cols / (high * wide))).clip(0, 255).astype(np.uint8)


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hex: is each of nine columns in eight rows darker than its right neighbour."""
    small = area_resize(image, 8, 9).astype(np.int16)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_bytes(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def media_tiles(media: DataFrame, tile: int = 16) -> DataFrame:
    """Add ``tile`` (NPY bytes of the square resized image), ``feature`` and ``error`` to a table with
    columns ``doc_id`` and ``media`` (binary); a null or broken image gives nulls and an error text."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, data in zip(batch["doc_id"], batch["media"]):
                try:
                    image = grey(decode_image(data))
                    rows.append((key, npy_bytes(area_resize(image, tile, tile)), difference_hash(image), None))
                except (ValueError, TypeError, IndexError) as error:
                    rows.append((key, None, None, str(error) or type(error).__name__))
            yield pd.DataFrame(rows, columns=["doc_id", "tile", "feature", "error"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "media").mapInPandas(work, f"doc_id {kind}, tile binary, feature string, error string")


def text_media(docs: DataFrame, form: str = "pgm", width: int = WIDTH) -> DataFrame:
    """Store each text losslessly as 8-bit samples of a greymap (``pgm`` or ``bmp``).

    Null counts as empty. UTF-8 bytes are padded with zeros to a positive multiple of ``width``
    and become the rows of an image ``width`` wide. Columns: doc_id, n_bytes, media.
    """
    encode = {"pgm": encode_pgm, "bmp": encode_bmp}[form]

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [text.encode() for text in batch["text"]]
            padded = [data.ljust(max(width, -(-len(data) // width) * width), b"\0") for data in raw]
            images = [encode(np.frombuffer(data, np.uint8).reshape(-1, width)) for data in padded]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": [len(d) for d in raw], "media": images})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(store, f"doc_id {kind}, n_bytes long, media binary")


def media_features(media: DataFrame, tile: int = 16) -> DataFrame:
    """Decode stored media and describe them; a row of ``text_media`` in, a row of digests out.

    The payload is what the decoder gives back. Equal texts give equal values in every column.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, size, data in zip(batch["doc_id"], batch["n_bytes"], batch["media"]):
                image = decode_image(data)
                payload = image.tobytes()
                stored = npy_bytes(area_resize(image, tile, tile))
                rows.append((
                    key, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]),
                    len(data), hashlib.sha256(data).hexdigest(), difference_hash(image),
                    hashlib.sha256(stored).hexdigest(),
                ))
            yield pd.DataFrame(rows, columns=names)

    kind = media.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string, tile_sha256 string"
    )
    names = [field.split()[0] for field in schema.split(", ")]
    return media.select("doc_id", "n_bytes", "media").mapInPandas(read, schema)


def op7_media_columns(spark, sf_dir: str) -> DataFrame:
    """Every text as a greymap in a media table on shared storage, read back and described."""
    place = scratch(spark, "media")
    text_media(id_text(documents(spark, sf_dir))).write.option("compression", "zstd").parquet(place)
    return media_features(spark.read.parquet(place))
