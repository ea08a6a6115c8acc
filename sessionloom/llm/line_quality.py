"""Quality rules: base counts of each text, and lines that too many documents of one host carry.

Lines are normalised (lower case, white space runs as one space, trimmed) and hashed; a line that more distinct documents of a host
hold than its limit allows is removed from all of them; a document that keeps less than `min_kept_tenths` of its words is rejected. The limit of a
host is `max_docs`, or `max_percent` of its documents where that is more.
DataFrame functions only. Texts are read once: counts and line hashes go to a narrow table, and all exchanges carry that.

Null text: no words, so the base fails; in cleaned_text() it stays null. Null host (source): a host of its own. Rows of a host that agree in doc_id and lines are one
document for the counts, and each has its own verdict. Texts of any length are whole; lines without a word are never removed. Empty table:
empty result. Other columns of the input are ignored by line_quality() and kept by cleaned_text(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, SPACES, join_spread, materialise, packed, quoted, words_of

SYMBOLS = "#*$%&|<>"
#: A line is boilerplate of a host when more of its documents than this hold it, in number and in percent.
MAX_DOCS, MAX_PERCENT = 20, 2
#: Tenths of its words that a document must keep.
MIN_KEPT_TENTHS = 3


def with_repeated_words(rows: DataFrame) -> DataFrame:
    """rows(words, ...) with n_repeat_words: words that lie in a 3-word window which the text holds twice or more.

    One step a projection, each read more than once by the next, so that the optimizer keeps them apart and none is nested deep.
    """
    hashed = F.transform(F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2)))
    rows = rows.withColumn("windows", hashed)
    # windows in the order of their hashes, for texts that repeat any
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("placed", F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i: (x["h"] == F.get("placed", i - 1)["h"]) | (x["h"] == F.get("placed", i + 1)["h"])
    rows = rows.withColumn("starts", F.array_sort(F.transform(F.filter("placed", same), lambda x: x["i"])))
    # starts ascend: each window adds the words up to the next one's start, three at most
    after = F.transform("starts", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("starts", i + 1) - p, F.lit(3))))
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(after, F.lit(0), lambda n, x: n + x), F.lit(0)).cast("long"))
    return rows.drop("windows", "placed", "starts")


def normalised(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(line), SPACE, " "), F.lit(" "))


def features(docs: DataFrame, host: str) -> DataFrame:
    """One narrow row per document: base counts, and hash and words of every line that has a word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col(quoted(host)).cast("string").alias("host"), text.alias("text"))
    rows = rows.select(
        "rid", "doc_id", "host", words_of(F.col("text")).alias("words"), F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("raw"),
    )
    rows = with_repeated_words(rows).withColumn("n_words", F.size("words").cast("long")).drop("words")
    rows = rows.withColumn("n_dup_lines", (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long")).withColumn("clean", F.transform("raw", normalised))
    line = lambda x: F.struct(F.xxhash64(x).alias("hash"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("words"))
    return rows.select("rid", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.transform("clean", line).alias("lines"))


def _host_key() -> Column:
    """A host as a key that is never null: its name behind a sign, nothing for a null one."""
    return F.coalesce(F.concat(F.lit("="), F.col("host")), F.lit(""))


def _line_key() -> Column:
    return F.concat(F.col("hash").cast("string"), F.col("key"))


def _frequent(documents: DataFrame, max_docs: int, max_percent: float) -> DataFrame:
    """line, docs of the lines above their host's limit, for documents(key, doc_id, hashes), hashes without repeats; a table on disk. line names host and line."""
    # a document that stands several times in its host counts once
    once = materialise(documents.dropDuplicates(["key", "doc_id", "hashes"]).select("key", "hashes"), "line-documents")
    hosts = materialise(once.groupBy("key").agg(F.count("*").alias("of_host")), "line-hosts")
    # partial sums bound a frequent line: a row per task
    counts = once.select("key", F.explode("hashes").alias("hash")).groupBy("key", "hash").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs)
    limited = join_spread(materialise(counts, "line-counts"), hosts, "key", "of_host").where(100 * F.col("docs") > max_percent * F.col("of_host"))
    return materialise(limited.select(_line_key().alias("line"), "docs"), "line-frequent")


def line_quality(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_percent: float = MAX_PERCENT, min_kept_tenths: int = MIN_KEPT_TENTHS) -> DataFrame:
    """doc_id, base counts, base_failed, kept, n_removed_words, n_removed_lines for docs(doc_id, text, host)."""
    table = materialise(features(docs, host), "line-quality")
    lines = table.select("rid", _host_key().alias("key"), F.explode("lines").alias("l")).select("rid", "key", F.col("l.hash").alias("hash"), F.col("l.words").alias("words"))
    hashes = F.array_sort(F.array_distinct(F.transform("lines", lambda x: x["hash"])))
    frequent = _frequent(table.select(_host_key().alias("key"), "doc_id", hashes.alias("hashes")), max_docs, max_percent)
    gone = join_spread(lines.withColumn("line", _line_key()), frequent, "line", "docs").groupBy("rid").agg(F.sum("words").cast("long").alias("n_removed_words"), F.count("*").alias("n_removed_lines"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    removed = F.coalesce("n_removed_words", F.lit(0).cast("long"))
    stays = 10 * (F.col("n_words") - removed) >= min_kept_tenths * F.col("n_words")
    return table.drop("lines", "host").join(gone, "rid", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & stays).alias("kept"),
        removed.alias("n_removed_words"), F.coalesce("n_removed_lines", F.lit(0).cast("long")).alias("n_removed_lines"),
    )


def cleaned_text(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_percent: float = MAX_PERCENT) -> DataFrame:
    """docs with the frequent lines taken out of text. The lines to remove are joined per row, as an array of hashes."""
    kept_names = [F.col(f"row.{quoted(c)}") if c != "text" else F.col("text") for c in docs.columns]
    rows = packed(docs, rid=F.monotonically_increasing_id(), doc_id=F.col("doc_id").cast("long"), host=F.col(quoted(host)).cast("string"), text=F.col("text"))
    rows = materialise(rows, "line-docs")
    blank = F.xxhash64(F.lit(""))
    hashes = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.xxhash64(normalised(x))), lambda h: h != blank)))
    hashed = rows.select("rid", _host_key().alias("key"), "doc_id", hashes.alias("hashes"))
    frequent = _frequent(hashed.drop("rid"), max_docs, max_percent)
    lines = hashed.select("rid", "key", F.explode("hashes").alias("hash")).withColumn("line", _line_key())
    gone = join_spread(lines, frequent, "line", "docs").groupBy("rid").agg(F.collect_set("hash").alias("gone"))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: ~F.coalesce(F.array_contains(F.col("gone"), F.xxhash64(normalised(x))), F.lit(False))), "\n")
    return rows.join(gone, "rid", "left").withColumn("text", kept).select(kept_names)


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, host, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d
), g AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), c AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS times FROM g), (VALUES (0), (1), (2)) AS o(k) WHERE times > 1 GROUP BY rid
), l AS (
  SELECT rid, host, trim(regexp_replace(lower(line), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS line FROM (SELECT rid, host, unnest(lines) AS line FROM w)
), u AS (
  SELECT DISTINCT host, doc_id, lines FROM (SELECT w.rid, any_value(w.host) AS host, any_value(w.doc_id) AS doc_id, list_sort(list_distinct(list(l.line) FILTER (l.line IS NOT NULL))) AS lines FROM w LEFT JOIN l USING (rid) GROUP BY w.rid)
), f AS (
  SELECT host, line FROM (SELECT host, unnest(lines) AS line, of_host FROM (SELECT *, count(*) OVER (PARTITION BY host) AS of_host FROM u))
  GROUP BY host, line HAVING count(*) > {MAX_DOCS} AND 100 * count(*) > {MAX_PERCENT} * max(of_host)
), r AS (
  SELECT l.rid, sum(len(string_split(l.line, ' ')))::BIGINT AS gone_words, count(*) AS gone_lines FROM l JOIN f ON l.host IS NOT DISTINCT FROM f.host AND l.line = f.line GROUP BY l.rid
), b AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(r.gone_words, 0)::BIGINT AS n_removed_words, coalesce(r.gone_lines, 0)::BIGINT AS n_removed_lines
  FROM w LEFT JOIN c USING (rid) LEFT JOIN r USING (rid)
)
SELECT *, NOT base_failed AND 10 * (n_words - n_removed_words) >= {MIN_KEPT_TENTHS} * n_words AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
"""
