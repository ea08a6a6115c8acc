"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import Scratch, discard, fresh_path, materialise, remove, scratch, shared_dir

__all__ = ["Scratch", "discard", "fresh_path", "materialise", "remove", "scratch", "shared_dir"]

#: Java regex of the white space that separates words: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Bits of a membership filter for each key that it holds, and the bounds of its size: 4 KB to 32 MB, so that it can always be broadcast.
#: Beyond 2 ** 28 keys nearly everything passes it: results stay right, more rows go through an exchange.
BITS_PER_KEY = 16
MIN_FILTER_BITS, MAX_FILTER_BITS = 1 << 15, 1 << 28
#: Keys that hold more than 1 / HEAVY_KEYS of the rows are heavy: there are at most that many, whatever the input.
HEAVY_KEYS = 1000
#: Bytes of a batch that goes to a Python worker. By rows alone, 10,000 whole texts would go at once.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of about BATCH_BYTES, with the worker's free memory given back when its task ends. The session's limit is
    lowered to that where it is higher: it bounds what a batch takes in the executor and in the worker."""
    spark = df.sparkSession
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_SETTING))
    if size > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(trimmed(run), schema)


def trimmed(run):
    """run, a function for mapInArrow, with the worker's free memory given back when its task ends: Python workers wait for the tasks of later
    stages, and what they hold counts against the executor."""

    @wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    """Returns free memory to the system."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """docs as one struct column, row, with columns of our own beside it: no name of theirs can meet one of ours. `row.*` unpacks it."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def join_spread(rows: DataFrame, table: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with table(key, count, ...), which has one row for each key and the number of its rows as `count`.

    Heavy keys, HEAVY_KEYS of them at most, meet their row by broadcast, where they are; the others go by an exchange.
    Both sides are read twice, so they should be on disk.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    heavy = table.where(F.col(count) * HEAVY_KEYS > total)
    light = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(table.where(F.col(count) * HEAVY_KEYS <= total), key, how)
    return rows.join(F.broadcast(heavy), key).unionByName(light)


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row: a lambda variable can't be inlined again by the optimizer."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text: maximal runs of anything but SPACE; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def sha_hex(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _bit(digest: Column, bits: int) -> Column:
    """A bit number from a binary digest (its first 8 bytes are hashed again, so any digest is fine)."""
    return F.pmod(F.xxhash64(digest), F.lit(bits))


def filter_bits(keys: int) -> int:
    """The size of a filter for so many keys: a power of two within the bounds."""
    return min(MAX_FILTER_BITS, max(MIN_FILTER_BITS, 1 << (BITS_PER_KEY * keys).bit_length()))


class Membership:
    """A bitmap filter of digests, sized to their number: bits / 32768 rows of 4 KB."""

    def __init__(self, keys: DataFrame, digest: str, count: int | None = None) -> None:
        self.bits = filter_bits(keys.count() if count is None else count)
        bit = _bit(F.col(digest), self.bits)
        self.bitmap = keys.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bitmap"))

    def mark(self, df: DataFrame, digest: str, name: str) -> DataFrame:
        """df with a boolean column: whether the row's digest may be among those of the filter. False positives occur, members are
        never missed. A map-side step."""
        bit = _bit(F.col(digest), self.bits)
        byte = F.conv(F.hex(F.expr("substring(_bitmap, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
        hit = byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) != 0
        placed = df.withColumns({"_bucket": F.bitmap_bucket_number(bit), "_at": F.bitmap_bit_position(bit)})
        return placed.join(F.broadcast(self.bitmap), "_bucket", "left").withColumn(name, F.coalesce(hit, F.lit(False))).drop("_bucket", "_at", "_bitmap")

    def maybe(self, df: DataFrame, digest: str) -> DataFrame:
        """Rows of df whose digest may be among those of the filter."""
        return self.mark(df, digest, "_maybe").where("_maybe").drop("_maybe")


def keep_decided(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """row.* of rows(row, doc, digest) that stay, by decided(doc, digest, stays), a table on disk: verdicts on every row whose digest is up for a
    decision. Rows of other digests stay without an exchange: a bitmap tells them. Of rows equal in doc and digest one stays; they
    are brought together before the join, so that a row with many repetitions is one row of a task in the exchange.
    """
    once = decided.groupBy("doc", "digest").agg(F.max("stays").alias("stays"))
    asked = Membership(decided.select("digest"), "digest").mark(rows, "digest", "asked")
    clear = asked.where(~F.col("asked")).select("row.*")
    unclear = asked.where("asked").groupBy("doc", "digest").agg(F.first("row").alias("row"))
    met = unclear.alias("u").join(once.alias("d"), F.col("u.doc").eqNullSafe(F.col("d.doc")) & (F.col("u.digest") == F.col("d.digest")), "left")
    # false positives of the bitmap have no verdict: they were never asked about
    return clear.unionByName(met.where(F.coalesce("d.stays", F.lit(True))).select("u.row.*"))
