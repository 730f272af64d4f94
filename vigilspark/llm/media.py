"""Media columns: binary payloads kept as lossless WebP images, and images as pixel arrays.

to_images() stores payloads as 8-bit red, green, blue samples; pixels_of() decodes a
column of WebP files into pixel arrays; describe() gets the payload back and tells of it.

Most images share prefix codes that are fitted on the bytes of all texts, so that many are
written and read side by side; an image that own codes make clearly smaller has its own.
Both depend on the text and the whole table only, so equal texts give equal files.

Defined results: null text counts as empty and has one row of blanks; a payload beyond the
IMAGE_BYTES that one image holds is several images, laid end to end in one file (each RIFF
tells its length) with their features joined by `;`; a file that is not lossless WebP gives null pixels and an error text; null doc_ids and repeated rows are
kept each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp
from .common import map_arrow, record_batch, table

#: Bytes of one image row at least (64 pixels of three samples); payloads are padded to a multiple.
ROW = 192
#: Bytes of the payloads or files that are written or read side by side.
PORTION = 1 << 18
#: Bytes of payload that one image holds at most.
IMAGE_BYTES = webp.MAX_SIDE * (webp.MAX_SIDE // 64 * ROW)


def padded(raw: bytes, unit: int = ROW) -> bytes:
    return raw + b" " * (-len(raw) % unit if raw else unit)


def samples_of(payload: bytes) -> np.ndarray:
    """A payload of whole rows, IMAGE_BYTES at most, as red, green, blue samples; wider rows where there would be too many."""
    wide = -(-(len(payload) // ROW) // webp.MAX_SIDE)
    return np.frombuffer(payload + b"\0" * (-len(payload) % (wide * ROW)), np.uint8).reshape(-1, wide * ROW // 3, 3)


def parts_of(size: int, most: int) -> list[tuple[int, int]]:
    """Where a payload's images begin and end."""
    return [(i, min(i + most, size)) for i in range(0, size, most)]


def files_of(image: bytes) -> list[bytes]:
    """WebP files that lie end to end."""
    out, at = [], 0
    while at < len(image):
        end = at + 8 + int.from_bytes(image[at + 4 : at + 8], "little")
        out.append(image[at:end])
        at = end
    return out


def payload_of(pixels: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(pixels[..., :3]).tobytes()[:size]


def feature_of(pixels: np.ndarray) -> str:
    """Size, mean of each colour, and a 64-bit hash of which of 8 x 8 fields are brighter than the mean."""
    h, w = pixels.shape[:2]
    rgb = pixels[..., :3].astype(np.int64)
    means = rgb.mean(axis=(0, 1))
    light = rgb.sum(axis=2)
    y, x = (np.unique(np.arange(8) * n // 8) for n in (h, w))
    fields = np.add.reduceat(np.add.reduceat(light, y, axis=0), x, axis=1)
    areas = np.outer(np.diff(y, append=h), np.diff(x, append=w))
    bright = (fields * h * w > light.sum() * areas).ravel()
    return f"{w}x{h}:{means[0]:.3f},{means[1]:.3f},{means[2]:.3f}:{np.packbits(bright).tobytes().hex()}"


def pixels_of(images: DataFrame, column: str = "image") -> DataFrame:
    """All columns with width, height, pixels (red, green, blue, alpha bytes by row) and error; such columns are replaced."""
    from pyspark.sql import types as T

    images = images.drop("width", "height", "pixels", "error")
    at = images.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # one image at a time bounds the memory
                row, image = b.slice(i, 1), b.column(at)[i].as_py()
                try:
                    px = webp.decode(image) if image is not None else None
                    error = None if px is not None else "no image"
                except (webp.WebpError, IndexError, ValueError) as e:
                    px, error = None, str(e) or "damaged"
                out = [None] * 3 if px is None else [px.shape[1], px.shape[0], px.tobytes()]
                yield pa.RecordBatch.from_arrays([*row.columns, *(pa.array([v], t) for v, t in zip((*out, error), (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True))], names=[*b.schema.names, "width", "height", "pixels", "error"])

    extra = [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("pixels", T.BinaryType()), T.StructField("error", T.StringType())]
    return map_arrow(images, run, T.StructType([*images.schema.fields, *extra]))


OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_TYPES = {"long": pa.int64(), "string": pa.string()}
_OUT = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in OUT.split(", ")])
IMAGES = "doc_id long, n_bytes long, payload_bytes long, image binary"
_IMAGES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("image", pa.binary())])


def shared_codes(docs: DataFrame) -> webp.Shared:
    """Prefix codes by the symbols of all payloads of docs (text); a few hundred sums reach the driver."""
    most, cached = IMAGE_BYTES, 1 << webp.SHARED_CACHE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(257 + cached, np.int64)
        for b in batches:
            raw = [(t or "").encode() for t in b.column(0).to_pylist()]
            for lo, hi in _portions([max(len(r), ROW) for r in raw]):
                payloads = [padded(r) for r in raw[lo:hi]]
                literals, runs, places = webp.symbols_of([samples_of(p[i:j]) for p in payloads for i, j in parts_of(len(p), most)])
                seen += np.concatenate([literals, [runs], places])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen))), pa.array(seen)], names=["symbol", "n"])

    seen = np.zeros(257 + cached, np.int64)
    for symbol, n in map_arrow(docs.select("text"), count, "symbol long, n long").groupBy("symbol").agg(F.sum("n")).collect():
        seen[symbol] = n
    return webp.Shared(seen[:256], int(seen[256]), seen[257:])


def to_images(docs: DataFrame, shared: webp.Shared | None = None) -> DataFrame:
    """doc_id, n_bytes, payload_bytes and image of each text of docs (doc_id, text); the shared codes are those of docs by default."""
    shared, most = shared or shared_codes(docs), IMAGE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            images: list[bytes] = []
            for lo, hi in _portions([max(len(r), ROW) for r in raw]):
                payloads = [padded(r) for r in raw[lo:hi]]
                parts = [parts_of(len(p), most) for p in payloads]
                files = iter(webp.encode_many([samples_of(p[i:j]) for p, at in zip(payloads, parts, strict=True) for i, j in at], shared))
                images += [b"".join(next(files) for _ in at) for at in parts]
            yield record_batch(_IMAGES, [b.column(0), [len(r) for r in raw], [len(r) + -len(r) % ROW or ROW for r in raw], images])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, IMAGES)


def _portions(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of about PORTION bytes together."""
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= PORTION or i + 1 == len(sizes):
            yield lo, i + 1
            lo, held = i + 1, 0


def describe(images: DataFrame) -> DataFrame:
    """What the stored images of to_images() hold, read back from their bytes."""
    most = IMAGE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            sizes, images = b.column(2).to_pylist(), b.column(3).to_pylist()
            for lo, hi in _portions([len(x) for x in images]):
                files = [files_of(x) for x in images[lo:hi]]
                pixels = iter(webp.decode_many([f for own in files for f in own]))
                for size, image, own in zip(sizes[lo:hi], images[lo:hi], files, strict=True):
                    px = [next(pixels) for _ in own]
                    payload = b"".join(payload_of(x, j - i) for x, (i, j) in zip(px, parts_of(size, most), strict=True))
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), ";".join(map(feature_of, px))))
            yield record_batch(_OUT, [b.column(0), b.column(1), *map(list, zip(*rows, strict=True))] if rows else [[] for _ in _OUT])

    return map_arrow(images.select("doc_id", "n_bytes", "payload_bytes", "image"), run, OUT)


def op6_media(spark, sf_dir: str) -> DataFrame:
    return describe(to_images(table(spark, sf_dir, "documents")))
