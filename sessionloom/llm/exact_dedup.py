"""Exact deduplication on a log-structured merge index of SHA-256 digests.

A batch of rows fills one memtable per input split, which is flushed as a sorted run: a Parquet file ordered by digest, with one entry per digest of
the split, and a bitmap filter over the run, sized to its entries. Once FANOUT runs stand on a level, compaction merges them into one run of the next
level, an entry per digest with the identifier to keep and the number of rows. A lookup of further rows probes the filters
first and reads only the runs in which one of them hits; hits are then verified against the texts byte by byte. Digests that stand
for several texts (a collision; none is known) are grouped by the texts themselves.
DataFrame functions only.

Null text: equal to the empty text. Null doc_id: stays only if no other row of the text has one. Repeated rows (equal doc_id and text):
one stays. Texts of any length are whole. Empty table: empty result. Other columns of the input are kept by deduplicate()
and ignored by verdicts(), whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Membership, fresh_path, join_spread, keep_decided, materialise, packed, sha_hex

ENTRY = "digest binary, keep struct<present:boolean,doc_id:long,rid:long>, copies long"
#: Runs of a level that are merged into one of the next.
FANOUT = 4


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _row() -> Column:
    return F.struct(F.col("doc_id").isNotNull().alias("present"), "doc_id", "rid")


def _best(column: str, keep: str) -> Column:
    """The entry to keep: the smallest doc_id or the largest one, a null one last in either case."""
    order = F.col(column)
    if keep == "largest":
        return F.max(order)
    # the smallest: present rows first
    return F.min_by(order, F.struct(~order["present"], order["doc_id"], order["rid"]))


@dataclass
class Run:
    """Entries in the order of their digests, and the filter over them."""

    path: str
    entries: int
    filter: DataFrame
    bits: int

    def membership(self) -> Membership:
        own = Membership.__new__(Membership)
        own.bits, own.bitmap = self.bits, self.filter
        return own


class DigestIndex:
    """Runs under path by level. `probed` names the runs that the last lookup read."""

    def __init__(self, spark: SparkSession, path: str, keep: str = "smallest", fanout: int = FANOUT) -> None:
        self.spark, self.path, self.keep, self.fanout = spark, path, keep, fanout
        self.levels: list[list[Run]] = [[]]
        self.written, self.batches, self.probed = 0, 0, []

    def _run(self, entries: DataFrame, level: int) -> Run:
        """Writes entries, sorted within each part, as a run of the level, and its filter beside it."""
        name = f"{self.path}/level-{level}-run-{self.written}"
        self.written += 1
        entries.sortWithinPartitions("digest").write.option("parquet.bloom.filter.enabled#digest", "true").parquet(name)
        stored = self.spark.read.schema(ENTRY).parquet(name)
        count = stored.count()
        members = Membership(stored, "digest", count)
        members.bitmap.write.parquet(f"{name}-filter")
        run = Run(name, count, self.spark.read.schema(members.bitmap.schema).parquet(f"{name}-filter"), members.bits)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        return run

    def flush(self, docs: DataFrame) -> DataFrame:
        """Adds docs(doc_id, text): each split is a memtable, which becomes a sorted part of a run of level 0, an entry per row. No exchange.
        Gives digest, doc_id, rid; row numbers of later batches follow those of earlier ones."""
        rid = F.monotonically_increasing_id() + (self.batches << 53)
        self.batches += 1
        rows = docs.select(digest_of(F.col("text")).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), rid.alias("rid"))
        run = self._run(rows.select("digest", _row().alias("keep"), F.lit(1).cast("long").alias("copies")), 0)
        return self.spark.read.schema(ENTRY).parquet(run.path).select("digest", "keep.doc_id", "keep.rid")

    def add(self, docs: DataFrame) -> DataFrame:
        """flush(), and compaction of each level that is full."""
        rows = self.flush(docs)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1
        return rows

    def _merged(self, runs: list[Run]) -> DataFrame:
        """One entry per digest. Partial results per sorted part go first, so a digest with any share of the rows is a row per part in the exchange."""
        together = self.spark.read.schema(ENTRY).parquet(*(r.path for r in runs))
        return together.groupBy("digest").agg(_best("keep", self.keep).alias("keep"), F.sum("copies").alias("copies"))

    def compact(self, level: int | None = None) -> None:
        """Merges the runs of a level (None: of all levels) into one run of the next, with one entry per digest."""
        merged = self.levels if level is None else [self.levels[level]]
        runs, into = [r for own in merged for r in own], max(1, len(self.levels) - 1) if level is None else level + 1
        if not runs or level is None and len(runs) == 1 and not self.levels[0]:
            return
        for own in merged:
            own.clear()
        self._run(self._merged(runs), into)

    def entries(self) -> DataFrame:
        """digest, keep, copies over all runs: one entry per digest."""
        runs = [r for own in self.levels for r in own]
        if not runs:
            return self.spark.createDataFrame([], ENTRY)
        return self._merged(runs) if len(runs) > 1 or self.levels[0] else self.spark.read.schema(ENTRY).parquet(runs[0].path)

    def lookup(self, docs: DataFrame, texts: DataFrame) -> DataFrame:
        """doc_id, rid, digest, keep, copies of the rows of docs(doc_id, text) whose text the index holds. texts(doc_id, text): the documents that it was
        built from, for the verification of hits."""
        rows = materialise(docs.select("doc_id", digest_of(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("rid")), "digest-asked")
        self.probed, found = [], None
        for run in [r for own in self.levels for r in own]:
            asked = run.membership().maybe(rows.select("digest").distinct(), "digest")
            if asked.isEmpty():
                continue
            self.probed.append(run.path)
            hits = self.spark.read.schema(ENTRY).parquet(run.path).join(asked, "digest")
            found = hits if found is None else found.unionByName(hits)
        if found is None:
            return rows.join(self.spark.createDataFrame([], ENTRY), "digest").select("doc_id", "rid", "digest", "keep", "copies")
        found = materialise(found.groupBy("digest").agg(_best("keep", self.keep).alias("keep"), F.sum("copies").alias("copies")), "digest-found")
        both = docs.select("doc_id", "text").unionByName(texts.select("doc_id", "text"))
        wrong = differing(both, found)
        hits = rows.join(found, "digest")
        # rows of a digest that stands for several texts are held against the texts themselves
        doubtful = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("rid")).withColumn("digest", digest_of(F.col("text"))).join(wrong, "digest")
        known = texts.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", digest_of(F.col("text"))).join(wrong, "digest").select("text").distinct()
        right = doubtful.join(known, "text").select("rid", "digest")
        sure = hits.join(wrong, "digest", "left_anti").unionByName(hits.join(right, ["rid", "digest"], "left_semi"))
        return sure.select("doc_id", "rid", "digest", "keep", "copies")


def differing(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """digest of those in shared(digest), a table on disk, whose texts in docs aren't the same bytes throughout; a table on disk.

    The smallest and the largest text of a digest are equal only if all are; partial results per task make a group of any
    size a row per task in the exchange. A bitmap over the shared digests keeps other texts out.
    """
    texts = docs.select(digest_of(F.col("text")).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    texts = Membership(shared.select("digest"), "digest").maybe(texts, "digest")
    return materialise(texts.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high")).where("low <> high").select("digest"), "digest-collisions")


def verdicts(docs: DataFrame, keep: str = "smallest", batches: list[DataFrame] | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row per row of docs(doc_id, text). batches: docs in parts, each a batch of its own."""
    spark = docs.sparkSession
    index = DigestIndex(spark, fresh_path(spark, "digest-index"), keep)
    rows = None
    for part in batches or [docs]:
        added = index.add(part)
        rows = added if rows is None else rows.unionByName(added)
    index.compact()
    entries = index.entries()
    shared = materialise(entries.where("copies > 1"), "digest-shared")
    # the filter over shared digests settles most rows where they are; its false positives find no entry
    asked = Membership(shared, "digest").mark(rows, "digest", "asked")
    unclear = materialise(asked.where("asked").drop("asked"), "digest-unclear")
    met = join_spread(unclear, shared, "digest", "copies", "left")
    alone = asked.where(~F.col("asked")).drop("asked").withColumns({"keep": F.lit(None).cast(shared.schema["keep"].dataType), "copies": F.lit(None).cast("long")})
    single = F.col("copies").isNull()
    named = alone.unionByName(met).select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"), F.coalesce("copies", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("rid") == F.col("keep.rid"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
    wrong = differing(docs, shared)
    return named if wrong.isEmpty() else _split_collisions(named, docs, wrong, keep)


def _split_collisions(named: DataFrame, docs: DataFrame, wrong: DataFrame, keep: str) -> DataFrame:
    """Digests that stand for several texts (none is known): their rows are grouped by the texts themselves."""
    bad = wrong.select(F.lower(F.hex("digest")).alias("text_sha256"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("rid"))
    rows = materialise(rows.withColumn("text_sha256", F.sha2("text", 256)).join(bad, "text_sha256"), "digest-collided")
    groups = rows.withColumn("row", _row()).groupBy("text").agg(_best("row", keep).alias("keep"), F.count("*").alias("group_size"))
    own = rows.join(groups, "text").select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), "text_sha256")
    return named.join(bad, "text_sha256", "left_anti").select(own.columns).unionByName(own)


def deduplicate(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of docs that stay, with all their columns. Only texts of shared digests move."""
    rows = packed(docs, doc=F.col("doc_id").cast("long"), digest=F.unhex(sha_hex(F.col("text"))))
    shared = verdicts(docs, keep).where("group_size > 1")
    decided = materialise(shared.select(F.col("doc_id").alias("doc"), F.unhex("text_sha256").alias("digest"), F.col("kept").alias("stays")), "digest-decided")
    return keep_decided(rows, decided)


def op4_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
