"""Best-fit packing by large-item matching, planned on the histogram of lengths.

Pieces longer than a third of the capacity ("large") can share a sequence in twos at most: from the longest down, each takes the
longest large partner that still fits. Smaller pieces, longest first, go to the fullest sequence that still has
room, else to a new one. Equal lengths are interchangeable, so the plan needs only the count of every length: at most `capacity`
numbers on the driver, whatever the input. Pieces then find their place by their rank within their length.

Null text: empty, a piece with the end id alone. Repeated rows are packed each. Documents longer than the capacity, and only
those, are cut. Empty table: empty result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialise
from .encoding import drop_encoders, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"


def _cut(batches, path: str, end_id: int, capacity: int):
    tok, end = encoder(path), np.asarray([end_id], "<u4").tobytes()
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = tok.encode(text.as_py()) + end
            for k, at in enumerate(range(0, len(data), 4 * capacity)):
                part = data[at : at + 4 * capacity]
                rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
        columns = list(zip(*rows)) or [()] * 5
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
    drop_encoders()


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32. No exchange."""
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda b: _cut(b, tokenizer, end_id, capacity), PIECES)


def plan(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """Places for every length: runs (first rank, first sequence, pieces in a row in each sequence, offset of the first).

    Of a run, the piece of rank first + i goes to sequence first_sequence + i // k, at offset + (i % k) * length.
    """
    left = {n: c for n, c in counts.items() if c}
    given: dict[int, int] = {}
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    gaps: dict[int, list[tuple[int, int]]] = {}  # free tokens -> groups (first sequence, sequences)
    order: list[int] = []  # the keys of gaps, ascending
    new = 0

    def put(length: int, count: int, first: int, k: int, offset: int) -> None:
        runs.setdefault(length, []).append((given.get(length, 0), first, k, offset))
        given[length] = given.get(length, 0) + count

    def free(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, count))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        n, at = left[a], bisect_left(large, capacity - a + 1) - 1
        if n == 1 and at >= 0 and large[at] == a:
            at -= 1
        b = large[at] if at >= 0 else 0
        if not b:
            put(a, n, new, 1, 0)
            free(capacity - a, new, n)
            new += n
            large.pop()
            continue
        if a == b:
            pairs = n // 2
            put(a, 2 * pairs, new, 2, 0)
            free(capacity - 2 * a, new, pairs)
            new += pairs
            left[a] = n % 2
            if not left[a]:
                large.pop()
            continue
        pairs = min(n, left[b])
        put(a, pairs, new, 1, 0)
        put(b, pairs, new, 1, a)
        free(capacity - a - b, new, pairs)
        new += pairs
        for x in (a, b):
            left[x] -= pairs
            if not left[x]:
                large.remove(x)

    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        n = left[s]
        while n:
            at = bisect_left(order, s)
            if at == len(order):  # nothing has room: new sequences, filled with pieces of this length
                k = capacity // s
                full, rest = divmod(n, k)
                if full:
                    put(s, full * k, new, k, 0)
                    free(capacity - k * s, new, full)
                if rest:
                    put(s, rest, new + full, rest, 0)
                    free(capacity - rest * s, new + full, 1)
                new += full + bool(rest)
                break
            gap = order[at]
            first, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            k = gap // s
            full = min(count, n // k)
            if full:
                put(s, full * k, first, k, capacity - gap)
                free(gap - k * s, first, full)
                free(gap, first + full, count - full)
                n -= full * k
            else:
                put(s, n, first, n, capacity - gap)
                free(gap - n * s, first, 1)
                free(gap, first + 1, count - 1)
                n = 0
    return runs


def _place(batches, tables: dict[int, tuple[np.ndarray, ...]]):
    for batch in batches:
        length, rank = (batch.column(i).to_numpy() for i in (3, 5))
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        values, starts = np.unique(length[order], return_index=True)
        for n, rows in zip(values, np.split(order, starts[1:])):
            ranks, firsts, ks, offsets = tables[int(n)]
            run = np.searchsorted(ranks, rank[rows], side="right") - 1
            i = rank[rows] - ranks[run]
            sequence[rows] = firsts[run] + i // ks[run]
            offset[rows] = offsets[run] + i % ks[run] * n
        yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """sequence_id and offset for every row of pieces, a table on disk that reads the same twice.

    Ranks within a length are dealt over salts, so that a length with any share of the rows is spread: rank = pieces of earlier
    salts + row number within (length, salt).
    """
    spark = pieces.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    tables = {n: tuple(np.asarray(c, np.int64) for c in zip(*rows)) for n, rows in plan(histogram, capacity).items()}
    before = counts.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("_own", own).join(before, ["length", "_salt"])
    rows = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_own")).alias("rank"))
    return arrow_map(rows, lambda b: _place(b, tables), PLACED)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    return pack_pieces(materialise(pieces_of(docs, tokenizer, end_id, capacity), "pieces"), capacity)


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
