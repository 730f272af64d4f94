"""Token-id files with bit-plane shuffling.

A file is a container of fixed-size blocks of ids. Each block is transposed into byte
or bit planes, each plane is compressed with zstandard, and a chunk index lists the
compressed size of every plane, so that one block can be read without the others.
A second index lists the documents whose ids the file holds.

Files travel as rows (shard, seq, first_doc, n_ids, content) of a Parquet table in the
shared folder: any store that Spark writes to holds them, a lost task rewrites its own.

Defined results: null text counts as empty and yields just the end id; repeated doc_ids
stay separate documents, in order of a hash of their texts; null doc_ids come first; an empty table gives an empty table of files; other columns of
the input are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, record_batch, table, written
from .tokens import encoder, tokenizer_path

MAGIC = b"TPL1"
#: magic, plane kind (0 bytes, 1 bits), planes per block, ids per block, ids, blocks, documents
HEADER = struct.Struct("<4sBBIQII")
BLOCK_IDS = 1 << 16
#: Ids after which a file is closed; a longer document still stays in one file.
FILE_IDS = 1 << 19
LEVEL = 1


def _planes(ids: np.ndarray, bits: bool, n: int) -> list[bytes]:
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(n)]
    return [np.packbits(raw[:, i >> 3] >> (i & 7) & 1).tobytes() for i in range(n)]


def write_file(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, plane: str = "byte", block_ids: int = BLOCK_IDS, level: int = LEVEL) -> bytes:
    """The bytes of one file. plane: "byte" or "bit"; masked doc_ids are null, and a third list tells which."""
    bits = plane == "bit"
    top = int(ids.max()).bit_length() if len(ids) else 0
    n_planes = max(1, top if bits else -(-top // 8))
    pack = zstandard.ZstdCompressor(level=level).compress
    blocks = [[pack(p) for p in _planes(ids[i : i + block_ids], bits, n_planes)] for i in range(0, len(ids), block_ids)]
    index = np.array([len(p) for b in blocks for p in b], "<u4").tobytes()
    none, doc_ids = np.ma.getmaskarray(doc_ids), np.ma.filled(doc_ids, 0)
    docs = pack(np.concatenate([np.diff(doc_ids, prepend=0), lengths, *([none] if none.any() else [])]).astype("<i8").tobytes())
    head = HEADER.pack(MAGIC, bits, n_planes, block_ids, len(ids), len(blocks), len(doc_ids))
    return b"".join([head, struct.pack("<I", len(docs)), docs, index, *(p for b in blocks for p in b)])


def _open(content: bytes) -> tuple:
    magic, bits, n_planes, block_ids, n, n_blocks, n_docs = HEADER.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEADER.size
    (size,) = struct.unpack_from("<I", content, at)
    docs = np.frombuffer(zstandard.ZstdDecompressor().decompress(content[at + 4 : at + 4 + size]), "<i8")
    at += 4 + size
    index = np.frombuffer(content, "<u4", n_blocks * n_planes, at).reshape(n_blocks, n_planes)
    return bits, n_planes, block_ids, n, docs, index, at + index.nbytes


def read_block(content: bytes, block: int) -> np.ndarray:
    """The ids of one block, found by the chunk index."""
    bits, n_planes, block_ids, n, _, index, at = _open(content)
    at += int(index[:block].sum())
    size = min(block_ids, n - block * block_ids)
    raw = np.zeros((size, 4), np.uint8)
    unpack = zstandard.ZstdDecompressor().decompress
    for i, length in enumerate(index[block].tolist()):
        plane = np.frombuffer(unpack(content[at : at + length]), np.uint8)
        at += length
        if bits:
            raw[:, i >> 3] |= np.unpackbits(plane, count=size) << (i & 7)
        else:
            raw[:, i] = plane
    return raw.view("<u4").ravel()


def read_file(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids (masked if some are null), lengths and ids of a file."""
    _, _, _, n, docs, index, _ = _open(content)
    k = HEADER.unpack_from(content)[-1]
    doc_ids = np.cumsum(docs[:k])
    ids = np.concatenate([read_block(content, b) for b in range(len(index))]) if n else np.zeros(0, "<u4")
    return np.ma.array(doc_ids, mask=docs[2 * k :] != 0) if len(docs) > 2 * k else doc_ids, docs[k : 2 * k], ids


FILES = "shard int, seq int, first_doc long, n_ids long, content binary"
_FILES = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("first_doc", pa.int64()), ("n_ids", pa.int64()), ("content", pa.binary())])
_DOCS = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, word_ends: bool, plane: str = "byte", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode docs (doc_id, text), append end_id to each and write files in ascending doc_id order, null ids first.

    Order comes from a range partitioning: shard is the partition, seq the file in it.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, seq, end = TaskContext.get().partitionId(), 0, struct.pack("<I", end_id)
        enc = encoder(tokenizer, word_ends)
        names: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            lengths = np.array([len(p) // 4 for p in parts], np.int64)
            doc_ids = np.ma.array([x or 0 for x in names], np.int64, mask=[x is None for x in names])
            content = write_file(doc_ids, lengths, ids, plane)
            return record_batch(_FILES, [[shard], [seq], [names[0]], [len(ids)], [content]])

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, raw in zip(batch.column(0).to_pylist(), enc.ids(texts), strict=True):
                names.append(doc)
                parts.append(raw + end)
                held += len(raw) // 4 + 1
                if held >= file_ids:
                    yield close()
                    names, parts, held, seq = [], [], 0, seq + 1
        if names:
            yield close()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("doc_id").asc_nulls_first(), F.col("mark").asc()
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return written(map_arrow(ranged.select("doc_id", "text"), encode, FILES, keeps="tokens"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """shard, seq, doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, from the files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, seq, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                doc_ids, lengths, ids = read_file(content)
                raw, stops = memoryview(ids.tobytes()), np.cumsum(lengths)
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((stops - lengths).tolist(), stops.tolist(), strict=True)]
                n = len(doc_ids)
                yield record_batch(_DOCS, [np.full(n, shard, np.int32), np.full(n, seq, np.int32), doc_ids, stops - lengths, lengths.copy(), np.array(crcs, np.int64)])

    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    shards = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("shard", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("in_shard")).join(shards, "shard").select("shard", "seq", (F.col("in_shard") + F.col("shard_start")).alias("file_start"))
    docs = map_arrow(files.select("shard", "seq", "content"), decode, "shard int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["shard", "seq"]).select("doc_id", (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard", "seq")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    files = write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2, word_ends=True)
    return read_token_files(files)
