"""Token ids as directly addressable codes: any token can be read without decoding its neighbours.

Ids are cut into 8-bit chunks. Level k holds the k-th chunk of every id that has one, a bitmap of the ids that go on
to level k + 1, and a rank directory (ones before each 512-bit block). Token i is found by one rank per level.

Nulls: a null text is empty; null doc_ids come first. Repeated rows are kept, ordered by doc_id and then text. Texts of
any length are whole: a segment is closed after TARGET_TOKENS, and a longer document is a segment alone. Empty table: an
empty set of files. Other columns of the input are ignored, whatever their names.

The exchange into ascending order carries texts, which are smaller than their ids, and the sorted rows are encoded straight into segments: no table of
ids is written between. The number of shards follows from the number of bytes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, fresh_path
from .encoding import encoder

MAGIC = b"DAC1"
BLOCK = 512
#: Tokens after which a segment is closed.
TARGET_TOKENS = 1 << 20
#: A shard has about SHARD_TOKENS; a small table is spread over the session's shuffle partitions, as long as each gets MIN_SHARD_TOKENS.
SHARD_TOKENS, MIN_SHARD_TOKENS = 1 << 26, 1 << 17
#: Pieces that a worker remembers: about 200 MB at most, as nothing else large is held while segments are made.
PIECES = 1 << 19
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)

SEGMENTS = "shard int, segment int, shard_start long, n_tokens long, doc_ids array<long>, ends array<long>, payload binary"


def pack(ids: np.ndarray) -> bytes:
    """ids (unsigned 32-bit) as one directly addressable payload."""
    levels, left = [], np.ascontiguousarray(ids, dtype=np.uint32)
    while len(left):
        more = left > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ranks = np.cumsum(_ONES[bits].reshape(-1, BLOCK // 8).sum(1, dtype=np.uint64), dtype=np.uint64)
        ranks = np.concatenate([np.zeros(1, np.uint64), ranks[:-1]])
        levels.append(struct.pack("<QI", len(left), len(ranks)) + ranks.astype("<u8").tobytes() + bits.tobytes() + (left & 0xFF).astype(np.uint8).tobytes())
        left = left[more] >> 8
    return MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)


class TokenCodes:
    """A view of one payload."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != MAGIC:
            raise ValueError("not a token-code payload")
        (count,), at = struct.unpack_from("<I", payload, 4), 8
        self.levels = []
        for _ in range(count):
            n, blocks = struct.unpack_from("<QI", payload, at)
            ranks = np.frombuffer(payload, "<u8", blocks, at + 12)
            bits = np.frombuffer(payload, np.uint8, blocks * BLOCK // 8, at + 12 + 8 * blocks)
            chunks = np.frombuffer(payload, np.uint8, n, at + 12 + 8 * blocks + len(bits))
            self.levels.append((ranks, bits, chunks))
            at += 12 + 8 * blocks + len(bits) + n

    def __len__(self) -> int:
        return len(self.levels[0][2]) if self.levels else 0

    def access(self, i: int) -> int:
        """Token i alone: a chunk and a rank per level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (ranks, bits, chunks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            byte, bit = divmod(i, 8)
            if not bits[byte] >> bit & 1:
                break
            block = i // BLOCK
            i = int(ranks[block]) + int(_ONES[bits[block * BLOCK // 8 : byte]].sum()) + int(_ONES[bits[byte] & ((1 << bit) - 1)])
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        if not self.levels:
            return np.zeros(0, np.uint32)
        deeper = np.zeros(0, np.uint32)
        for _, bits, chunks in reversed(self.levels):
            here = chunks.astype(np.uint32)
            if len(deeper):
                here[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)] |= deeper << np.uint32(8)
            deeper = here
        return deeper


def _segments(batches, path: str, end_id: int):
    """Arrow batches of doc_id, text in order -> segments of this task's shard. The encoder, which is of bounded size, stays for the worker's next task."""
    shard, end, tok = TaskContext.get().partitionId(), np.asarray([end_id], "<u4").tobytes(), encoder(path, PIECES)
    docs, ends, parts, size, number, start = [], [], [], 0, 0, 0

    def flush():
        nonlocal docs, ends, parts, size, number, start
        payload = pack(np.frombuffer(b"".join(parts), "<u4"))
        row = [[shard], [number], [start], [size], [docs], [ends], [payload]]
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        names = ("shard", "segment", "shard_start", "n_tokens", "doc_ids", "ends", "payload")
        start, number = start + size, number + 1
        docs, ends, parts, size = [], [], [], 0
        return pa.record_batch([pa.array(v, t) for v, t in zip(row, types)], names=list(names))

    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            data = tok.encode(texts[i].as_py()) + end
            docs.append(ids[i].as_py())
            parts.append(data)
            size += len(data) // 4
            ends.append(size)
            if size >= TARGET_TOKENS:
                yield flush()
    if docs:
        yield flush()


def shards_for(tokens: int, spread: int) -> int:
    """How many shards so many tokens get, where `spread` tasks would run at once."""
    return max(1, -(-tokens // SHARD_TOKENS), min(spread, tokens // MIN_SHARD_TOKENS))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, partitions: int | None = None) -> None:
    """Encodes docs(doc_id, text) and writes segment files to path, in ascending doc_id order over shards and segments."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # a token takes a byte or more, so the bytes bound the tokens
    most = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    n = partitions or shards_for(most, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    arrow_map(ordered, lambda b: _segments(b, tokenizer, end_id), SEGMENTS).write.option("compression", "none").parquet(path)


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """shard, base: tokens of the shards before it. One row per partition of the writer's range exchange, so its size is bounded by that setting."""
    totals = spark.read.schema(SEGMENTS).parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))


def _documents(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            base, docs, ends = batch.column(0)[i].as_py(), batch.column(1)[i].values, np.asarray(batch.column(2)[i].values)
            data = TokenCodes(batch.column(3)[i].as_py()).all().astype("<u4").tobytes()
            starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
            crc = np.fromiter((zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts, ends)), np.int64, len(ends))
            yield pa.record_batch([docs, pa.array(starts + base), pa.array(ends - starts), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files."""
    parts = spark.read.schema(SEGMENTS).parquet(path).join(F.broadcast(_shards(spark, path)), "shard")
    rows = parts.select((F.col("base") + F.col("shard_start")).alias("start"), "doc_ids", "ends", "payload")
    return arrow_map(rows, _documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(spark: SparkSession, path: str, positions: list[int]) -> DataFrame:
    """position, id for a stated list of global token positions: segments that hold none are skipped, the others are accessed by rank."""
    wanted = np.asarray(sorted(set(positions)), np.int64)

    def hits(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                start, n = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                own = wanted[np.searchsorted(wanted, start) : np.searchsorted(wanted, start + n)]
                if len(own):
                    codes = TokenCodes(batch.column(2)[i].as_py())
                    yield pa.record_batch([pa.array(own), pa.array([codes.access(int(p - start)) for p in own], pa.int64())], names=["position", "id"])

    start = F.col("base") + F.col("shard_start")
    parts = spark.read.schema(SEGMENTS).parquet(path).join(F.broadcast(_shards(spark, path)), "shard")
    if len(wanted):
        parts = parts.where((start <= int(wanted[-1])) & (start + F.col("n_tokens") > int(wanted[0])))
    return arrow_map(parts.select(start.alias("start"), "n_tokens", "payload"), hits, "position long, id long")


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "token-codes")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_documents(spark, path)
