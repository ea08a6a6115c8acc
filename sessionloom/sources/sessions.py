"""Raw session logs to the event table: session_code, pos, item, ts (ms), etype."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import dense_codes

NESTED = "session bigint, events array<struct<aid:bigint,ts:bigint,type:string>>"
PARALLEL = "session string, ts array<bigint>, prev_items array<string>, type array<string>"


def detect_schema(spark: SparkSession, path: str) -> str:
    """`events` (nested) or `parallel`, by the keys of the first record; neither: ValueError."""
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    keys = json.loads(first[0].value) if first else {}
    for key, name in (("events", "events"), ("prev_items", "parallel")):
        if key in keys:
            return name
    raise ValueError(f"no known session schema in {path}: {sorted(keys)}")


def read_sessions(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One row per session from newline-delimited JSON, with an explicit schema; a malformed record fails."""
    kind = schema or detect_schema(spark, path)
    return spark.read.schema(NESTED if kind == "events" else PARALLEL).json(path, mode="FAILFAST")


def explode_sessions(raw: DataFrame, key: str = "session") -> DataFrame:
    """key, pos (from 1), item, ts, etype. Empty and null arrays give no row; a shorter ts or type array gives nulls."""
    if "events" in raw.columns:
        rows = raw.select(key, F.posexplode("events").alias("at", "ev"))
        return rows.select(key, (F.col("at") + 1).alias("pos"), F.col("ev.aid").cast("string").alias("item"), F.col("ev.ts").alias("ts"), F.col("ev.type").alias("etype"))
    rows = raw.select(key, "ts", "type", F.posexplode("prev_items").alias("at", "item"))
    return rows.select(key, (F.col("at") + 1).alias("pos"), "item", F.get("ts", F.col("at")).alias("ts"), F.get("type", F.col("at")).alias("etype"))


def coded_events(raw: DataFrame) -> DataFrame:
    """The event table with dense session codes in the order of (first ts, session). Each record is a session of its own, also where ids repeat."""
    first = F.col("events")[0]["ts"] if "events" in raw.columns else F.get("ts", F.lit(0))
    size = F.size("events") if "events" in raw.columns else F.size("prev_items")
    keyed = dense_codes(raw.where(size > 0).withColumn("_first_ts", F.coalesce(first, F.lit(0))), ["_first_ts", "session"], "session_code")
    return explode_sessions(keyed, "session_code")


def synthetic_sessions(spark: SparkSession, sessions: int, items: int, seed: int = 7) -> DataFrame:
    """session, ts, prev_items, type: made-up logs. Lengths are exponential (mean 4.5) within 1 and 60, items fall as rank ** -0.9
    (by the inverse of the continuous distribution), types are 8:1:1, and times rise. The same rows for a seed, however they are spread."""

    def uniform(*parts):
        return (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    length = F.least(F.greatest(F.floor(-4.5 * F.log(uniform(F.lit("n"), "id"))), F.lit(1)), F.lit(60)).cast("int")
    steps = spark.range(sessions).select("id", F.sequence(F.lit(1), length).alias("at"))
    item = lambda p: F.least(F.floor(F.pow(1 + uniform(F.lit("i"), "id", p) * (float(items + 1) ** 0.1 - 1), F.lit(10.0))), F.lit(items)).cast("string")
    kind = lambda p: F.when(uniform(F.lit("t"), "id", p) < 0.8, "clicks").when(uniform(F.lit("t"), "id", p) < 0.9, "carts").otherwise("orders")
    start = F.lit(1_660_000_000_000) + F.floor(uniform(F.lit("s"), "id") * 28 * 86_400_000)
    gap = lambda p: (p - 1) * 60_000 + F.floor(uniform(F.lit("g"), "id", p) * 60_000)
    return steps.select(F.col("id").cast("string").alias("session"), F.transform("at", lambda p: (start + gap(p)).cast("long")).alias("ts"), F.transform("at", item).alias("prev_items"), F.transform("at", kind).alias("type"))
