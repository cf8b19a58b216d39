"""Token ids as length-delimited binary records with masked checksums, and an offset index for shuffled reads.

A record is its length (8 bytes, little-endian), the length's masked CRC-32C (4), the data, and the data's masked
CRC-32C (4). The data is a sequence: a byte that is 1 if the id isn't NULL, the id (8), the bytes of a token id (1: 2 or
4), and the token ids.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import narrow, new_folder, shared_dir, written
from ._text import slices

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_HEAD = struct.Struct("<BqB")
_CHUNK = 512


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1).astype(np.uint32)
    return t


def _advance(crc: np.ndarray, n: int) -> np.ndarray:
    t = _crc_table()
    for _ in range(n):
        crc = t[crc & 0xFF] ^ (crc >> np.uint32(8))
    return crc


@lru_cache(maxsize=64)
def _shift(power: int) -> np.ndarray:
    """Tables (4, 256) that advance a checksum over _CHUNK * 2**power zero bytes."""
    if power == 0:
        unit = np.arange(256, dtype=np.uint32)
        return np.stack([_advance(unit << np.uint32(8 * i), _CHUNK) for i in range(4)])
    half = _shift(power - 1)
    return np.stack([_apply(half, half[i]) for i in range(4)])


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 0xFF] ^ table[1][(crc >> np.uint32(8)) & 0xFF] ^ table[2][(crc >> np.uint32(16)) & 0xFF] ^ table[3][crc >> np.uint32(24)]


def masked_crc(parts: list[bytes]) -> np.ndarray:
    """Masked CRC-32C of each part: the checksum turned right by 15 bits, plus a constant.

    All parts advance together: they are cut into chunks with the short one first (zeros before the first byte leave a
    checksum of 0 unchanged), the chunks' checksums are taken side by side, and joined by multiplication with powers of x.
    """
    size = np.array([len(p) for p in parts], np.int64)
    out = np.zeros(len(parts), np.uint32)
    count = np.maximum(-(-size // _CHUNK), 1)
    first = np.concatenate([[0], np.cumsum(count)])
    data = np.zeros(int(first[-1]) * _CHUNK, np.uint8)
    for i, p in enumerate(parts):
        end = int(first[i + 1]) * _CHUNK
        data[end - len(p) : end] = np.frombuffer(p, np.uint8)
    # the start value of all ones is as if the first four bytes were inverted; shorter parts take the plain way
    start = first[1:] * _CHUNK - size
    short = size < 4
    for j in range(4):
        data[(start + j)[~short]] ^= 0xFF
    steps = np.ascontiguousarray(data.reshape(-1, _CHUNK).T)
    crc = np.zeros(int(first[-1]), np.uint32)
    t = _crc_table()
    for row in steps:
        crc = t[(crc ^ row) & 0xFF] ^ (crc >> np.uint32(8))
    # fold: the k-th chunk from a part's end is advanced by k chunks
    behind = np.repeat(first[1:], count) - 1 - np.arange(int(first[-1]))
    for power in range(int(behind.max(initial=0)).bit_length()):
        at = (behind >> power) & 1 == 1
        crc[at] = _apply(_shift(power), crc[at])
    out = np.bitwise_xor.reduceat(crc, first[:-1])
    for i in np.flatnonzero(short):
        c = np.uint32(0xFFFFFFFF)
        for b in parts[i]:
            c = t[(int(c) ^ b) & 0xFF] ^ (c >> np.uint32(8))
        out[i] = c
    out = out ^ np.uint32(0xFFFFFFFF)
    return ((out >> np.uint32(15)) | (out << np.uint32(17))) + np.uint32(0xA282EAD8)


def ranks(path: str) -> bytes:
    """The ranks of a byte-level tokenizer, read where the job starts; executors get them sent."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def encoder(data: bytes):
    """The byte-level tokenizer of these ranks."""
    import tiktoken

    found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=found, special_tokens={})


def serialize(doc_id: int | None, tokens: np.ndarray) -> bytes:
    return _HEAD.pack(doc_id is not None, doc_id or 0, tokens.dtype.itemsize) + tokens.tobytes()


def deserialize(data: bytes) -> tuple[int | None, np.ndarray]:
    known, doc_id, width = _HEAD.unpack_from(data)
    return doc_id if known else None, np.frombuffer(data, np.dtype("<u2" if width == 2 else "<u4"), offset=_HEAD.size)


def frame(parts: list[bytes]) -> list[bytes]:
    """Framed records of serialized sequences."""
    heads = [struct.pack("<Q", len(p)) for p in parts]
    a, b = masked_crc(heads), masked_crc(parts)
    return [b"".join((h, x.tobytes(), p, y.tobytes())) for h, x, p, y in zip(heads, a.astype("<u4"), parts, b.astype("<u4"))]


def unframe(records: list[bytes]) -> list[bytes]:
    """Serialized sequences of framed records; ValueError on a wrong length or checksum."""
    heads, parts = [r[:8] for r in records], [r[12:-4] for r in records]
    for r, p, x, y in zip(records, parts, masked_crc(heads), masked_crc(parts)):
        if len(r) < 16 or struct.unpack("<Q", r[:8])[0] != len(p):
            raise ValueError("record of wrong length")
        if struct.unpack("<I", r[8:12])[0] != x or struct.unpack("<I", r[-4:])[0] != y:
            raise ValueError("record with wrong checksum")
    return parts


def resolved(spark: SparkSession, folder: str) -> str:
    """The folder as a URI that every executor opens alike.

    A path without a scheme belongs to the default file system of the cluster, as for Spark itself. On a cluster, a local
    path must lie in the shared folder of spark.checkpoint.dir. ValueError if it doesn't, or if no file system is known.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()
    scheme, _, rest = p.partition(":")
    if scheme in ("s3a", "s3n"):
        p = f"s3:{rest}"
    elif scheme == "dbfs":
        p = f"file:///dbfs/{rest.lstrip('/')}"
    elif scheme == "file":
        p = f"file:///{rest.lstrip('/')}"
        master = spark.sparkContext.master
        shared = shared_dir(spark) if not master.startswith("local") or master.startswith("local-cluster") else None
        if shared is not None and not rest.lstrip("/").startswith(shared.partition(":")[2].lstrip("/") if shared.startswith("file:") else shared.lstrip("/")):
            raise ValueError(f"{folder} is local, but not in the folder that all executors share")
    pafs.FileSystem.from_uri(p)
    return p


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def write_records(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Tokenize docs (doc_id, text) and write one data and one index file for each partition; the index as a DataFrame.

    Rows (shard, record, doc_id, offset, length, n_tokens). Index files hold the offset and length of each record as two
    8-byte integers. A file gets its name only when it is whole, and its content depends on the input alone, so a task
    that runs again, or twice, does no harm. NULL texts have no record, empty ones a record without tokens; NULL ids
    stay NULL; repeated rows have a record each. Token ids take 2 bytes if the vocabulary allows, else 4. Only the job's
    start reads the tokenizer's file.
    """
    from pyspark import TaskContext

    folder = resolved(docs.sparkSession, folder)
    sent = docs.sparkSession.sparkContext.broadcast(ranks(tokenizer))  # about a megabyte

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value)
        kind = np.dtype("<u2" if enc.n_vocab <= 1 << 16 else "<u4")
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        ctx = TaskContext.get()
        shard, mark = f"part-{ctx.partitionId():05d}", f"{ctx.taskAttemptId()}.tmp"
        offset, record, index, rows = 0, 0, [], []
        with fs.open_output_stream(f"{base}/{shard}.rec.{mark}") as f:
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1)
                for lo, hi in slices(texts):
                    got = [np.array(enc.encode_ordinary(t), kind) for t in texts.slice(lo, hi - lo).to_pylist()]
                    framed = frame([serialize(i, t) for i, t in zip(ids[lo:hi], got)])
                    f.write(b"".join(framed))
                    size = np.array([len(x) for x in framed], np.int64)
                    at = offset + np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
                    index.append(np.stack([at, size], axis=1).astype("<i8").tobytes())
                    n = len(framed)
                    rows.append(pa.RecordBatch.from_arrays([pa.array([shard] * n), pa.array(np.arange(record, record + n)), b.column(0).slice(lo, n), pa.array(at), pa.array(size), pa.array([len(t) for t in got], pa.int32())], names=["shard", "record", "doc_id", "offset", "length", "n_tokens"]))
                    offset, record = offset + int(size.sum()), record + n
        with fs.open_output_stream(f"{base}/{shard}.idx.{mark}") as f:
            f.write(b"".join(index))
        for kind_ in ("rec", "idx"):
            fs.move(f"{base}/{shard}.{kind_}.{mark}", f"{base}/{shard}.{kind_}")
        yield from rows

    d = narrow(docs, "doc_id", "text").where("text is not null")
    return written(d.mapInArrow(part, "shard string, record long, doc_id long, offset long, length long, n_tokens int"), "token-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, tokens) of the index's rows, in any order, each read at its offset and held against its checksums."""
    folder = resolved(index.sparkSession, folder)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        files: dict = {}
        for b in batches:
            found = []
            for shard, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if shard not in files:
                    files[shard] = fs.open_input_file(f"{base}/{shard}.rec")
                found.append(files[shard].read_at(length, offset))
            got = [deserialize(p) for p in unframe(found)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1].tolist() for g in got], pa.list_(pa.int32()))], names=["doc_id", "tokens"])

    return index.select("shard", "offset", "length").mapInArrow(part, "doc_id long, tokens array<int>")


def shuffled(index: DataFrame, folder: str, seed: int = 0) -> DataFrame:
    """read_records() in an order that depends on seed alone; only the index is sorted, never the data."""
    key = F.xxhash64(F.lit(seed), "shard", "record")
    return read_records(index.orderBy(key, "shard", "record"), folder)


def tokenize(spark: SparkSession, docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """write_records() into a new folder of the shared one; folder is a column of the index.

    The records are the result, so the folder stays.
    """
    folder = new_folder(spark, "token-records")
    return write_records(docs, folder, tokenizer).withColumn("folder", F.lit(folder))
