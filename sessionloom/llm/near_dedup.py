"""Near-duplicate detection by ProbMinHash, banding and exact verification.

Documents are weighted sets of 5-word shingles (words in lower case), weight 1 + ln(times). Each shingle is a Poisson process
of its weight as the rate: its arrivals fall into random registers, each register keeps its earliest arrival, and a shingle
stops once its next arrival is later than every register's (early termination). Two registers agree with the probability
Jaccard similarity of the sets. Registers are hashed in bands; documents that share a band are candidates. Copies that repeat a
passage a different number of times can be far apart by these weights, so documents with a repeated shingle have the bands of unit
weights as well, whose registers agree with the plain Jaccard similarity; without a repeated shingle, both are the same.
Candidates are verified on the exact Jaccard similarity of their shingle sets, `threshold` or more; classes are the connected components of the links.

Verification goes in rounds and doesn't list the pairs within a bucket: a few leaders of each bucket meet its members, links join classes, and
buckets whose members are all of one class are done; the next round takes more leaders of those that are left. Two documents that share a
bucket end up compared, in one class, or with too few shingles in common to link, so no link is lost among candidates. Texts with the same words are one node from the start.

Null and blank texts have no shingle and are alone. Texts of 1 to 4 words are one shingle of these words. Repeated rows (equal doc_id
and text): one is kept. Null doc_id: never chosen before another. Texts of any length are whole. Empty table: empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import SPACE, SPACES, Membership, arrow_map, discard, join_spread, keep_decided, materialise, packed, scratch

SHINGLE = 5
THRESHOLD = 0.8
#: A pair at the threshold shares no band of unit weights with a probability of about (1 - 0.8 ** ROWS) ** BANDS = 0.0001.
BANDS, ROWS = 24, 5
#: How many times more leaders a bucket has in the next round.
GROWTH = 4
#: Words of the documents that are hashed at once: bounds the memory of a task, but for a single longer text.
CHUNK_WORDS = 1 << 18

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hash of every shingle, for documents given as word hashes end to end."""
    total, starts = len(words), np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(lengths)), lengths)
    spot = np.arange(total) - starts[doc]
    size = np.minimum(lengths, SHINGLE)[doc]
    first = spot + size <= lengths[doc]
    at, size, h = np.flatnonzero(first), size[first], np.zeros(int(first.sum()), np.uint64)
    for k in range(SHINGLE):
        own = at + k < total
        w = np.where((k < size) & own, words[np.minimum(at + k, total - 1)], np.uint64(0))
        h = _mix(h * np.uint64(0x100000001B3) + w + np.uint64(k + 1))
    return doc[first], h


def weighted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with the times it occurs, ordered by document and shingle."""
    if not len(h):
        return doc, h, np.zeros(0, np.int64)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
    return doc[starts], h[starts], np.diff(np.append(starts, len(h)))


def signatures(doc: np.ndarray, h: np.ndarray, weights: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """ProbMinHash registers, docs x registers: the shingle that arrives first in each. Documents without shingles keep zeros."""
    first = np.full(docs * registers, np.inf)
    winner = np.zeros(docs * registers, np.uint64)
    time, active, step = np.zeros(len(h)), np.arange(len(h)), 0
    while len(active):
        step = (step + int(_GOLDEN)) & _MASK
        own, d = h[active], doc[active]
        draw = _mix(own + np.uint64(step))
        # 53 bits for the waiting time of the next arrival; a second draw for its register
        time[active] += -np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * 2.0**-53) / weights[active]
        register = d * registers + (_mix(draw ^ _GOLDEN) % np.uint64(registers)).astype(np.int64)
        t = time[active]
        better = t < first[register]
        at, t_better, own_better = register[better], t[better], own[better]
        order = np.lexsort((own_better, t_better))[::-1]  # the earliest is written last
        first[at[order]] = t_better[order]
        winner[at[order]] = own_better[order]
        some = np.unique(d)
        latest = np.zeros(docs)
        latest[some] = first.reshape(docs, registers)[some].max(1)
        active = active[t < latest[d]]
    return winner.reshape(docs, registers)


def band_keys(winners: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each document and band; the band is part of the key."""
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN, (len(winners), bands)).copy()
    for r in range(rows):
        keys = _mix(keys * np.uint64(0x100000001B3) + winners[:, np.arange(bands) * rows + r])
    return keys


def _chunks(batch, at: int):
    """Row numbers, word hashes end to end and word counts, CHUNK_WORDS or so at a time."""
    column = batch.column(at)
    offsets = np.asarray(column.offsets).astype(np.int64)
    values = np.asarray(column.values).view(np.uint64)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + CHUNK_WORDS, side="right")) - 1)
        yield start, end, values[offsets[start] : offsets[end]], np.diff(offsets[start : end + 1])
        start = end


def _banded(batches, bands: int, rows: int):
    for batch in batches:
        for start, end, words, lengths in _chunks(batch, 2):
            doc, h, times = weighted(*shingles(words, lengths))
            keys = band_keys(signatures(doc, h, 1 + np.log(times), end - start, bands * rows), bands, rows)
            lists = [k if n else None for k, n in zip(keys.view(np.int64), lengths)]
            repeating = np.unique(doc[times > 1])
            if len(repeating):
                own = np.isin(doc, repeating)
                units = np.searchsorted(repeating, doc[own])
                plain = band_keys(signatures(units, h[own], np.ones(len(units)), len(repeating), bands * rows), bands, rows)
                for d, k in zip(repeating, plain.view(np.int64)):
                    lists[d] = np.unique(np.concatenate([lists[d], k]))
            yield pa.record_batch([batch.column(0)[start:end], batch.column(1)[start:end], pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "digest", "bands"])


def _sets(batches):
    """node, set: the distinct shingles of each document as sorted 64-bit hashes."""
    for batch in batches:
        for start, end, words, lengths in _chunks(batch, 1):
            doc, h, _ = weighted(*shingles(words, lengths))
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=end - start))]).astype(np.int32)
            yield pa.record_batch([batch.column(0)[start:end], pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], names=["node", "set"])


def normal_words(text: Column) -> Column:
    """The text's words in lower case, a space between two."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACE, " "), F.lit(SPACES))


def _word_hashes(normal: Column) -> Column:
    return F.when(normal == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(normal, " ", -1), lambda w: F.xxhash64(w)))


def classes_of(edges: DataFrame) -> DataFrame:
    """node, label for edges(a, b): label is the smallest node of the connected component; a table on disk. Nodes without edges are absent.

    Each step hooks every node to its smallest neighbour, follows the hooks to their roots and contracts: the nodes that still
    have edges at least halve.
    """
    with scratch(edges.sparkSession) as made:
        labels = None
        edges = materialise(edges.where("a <> b"), "cc-edges")
        while not edges.isEmpty():
            both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            parent = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).withColumnRenamed("a", "node"), "cc-parents")
            while True:
                up = parent.select(F.col("node").alias("_n"), F.col("p").alias("up"))
                jumped = materialise(parent.join(up, parent["p"] == up["_n"]).select("node", F.col("up").alias("p"), (F.col("up") != F.col("p")).alias("moved")), "cc-parents")
                parent = jumped.select("node", "p")
                if jumped.where("moved").isEmpty():
                    break
            root = parent.select(F.col("node").alias("_n"), F.col("p").alias("root"))
            new = root.select(F.col("_n").alias("node"), F.col("root").alias("label"))
            if labels is not None:
                old = labels.join(root, labels["label"] == root["_n"], "left").select("node", F.coalesce("root", "label").alias("label"))
                new = old.unionByName(new.join(labels, "node", "left_anti"))
            labels = materialise(new, "cc-labels")
            other = root.select(F.col("_n").alias("_m"), F.col("root").alias("root_b"))
            edges = materialise(edges.join(root, edges["a"] == root["_n"]).join(other, edges["b"] == other["_m"]).select(F.col("root").alias("a"), F.col("root_b").alias("b")).where("a <> b").distinct(), "cc-edges")
        if labels is None:
            labels = materialise(edges.select(F.col("a").alias("node"), F.col("b").alias("label")), "cc-labels")
        made.keep(labels)
        return labels


def _links(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b), a table on disk, whose sets are similar enough. Bitmaps keep the sets of other nodes out of the exchanges."""
    number = pairs.count()
    left = Membership(pairs, "a", number).maybe(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    right = Membership(pairs, "b", number).maybe(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    sizes = F.least(F.size("set_a"), F.size("set_b")), F.greatest(F.size("set_a"), F.size("set_b"))
    # sets of too different sizes can't be similar: no need to intersect
    met = pairs.join(left, "a").join(right, "b").where(sizes[0] >= threshold * sizes[1])
    both = F.size(F.array_intersect("set_a", "set_b"))
    return met.where(both >= threshold * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")


def _shared(state: DataFrame, sets: DataFrame) -> DataFrame:
    """node, r: how many of a node's shingles some node of another label has too. No overlap with another label exceeds it. Half of each hash
    is enough: where halves agree by chance, r is only larger."""
    halves = F.explode(F.transform("set", lambda x: F.shiftright(x, 32).cast("int")))
    owned = state.select("node", "label").distinct().join(sets, "node").select("node", "label", halves.alias("shingle"))
    common = owned.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("shingle")
    return owned.join(common, "shingle").groupBy("node").agg(F.count("*").cast("int").alias("r"))


def _can_link(r: Column, n: Column, r2: Column, n2: Column, threshold: float) -> Column:
    """Whether sets of n and n2 shingles, of which r and r2 at most are common, can reach the threshold."""
    most = F.least(r, r2)
    return most >= threshold * (n + n2 - most)


def _opened(state: DataFrame, threshold: float) -> DataFrame:
    """The rows of state whose bucket has nodes of several labels, one of which the row's node may link to; a table on disk."""
    open_keys = state.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least")).where("low < high").select("key", "least")
    able = F.col("r") >= threshold * (F.col("n") + F.greatest(F.col("least") - F.col("r"), F.lit(0)))
    return materialise(state.join(open_keys, "key").where(able).drop("least"), "near-state")


def _components(members: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame | None:
    """node, label after all rounds, for members(key, node) of buckets with two nodes or more.

    Leaders come in the order of how crowded their buckets are, so that the centre of a group of copies goes first. What
    is compared, besides: only nodes of different labels; only in the smallest bucket that both share; and only if the numbers of shingles
    that each shares with other labels allow a link at all. These conditions drop no link. What a round wrote goes when the next state stands.
    """
    spark = members.sparkSession
    sizes = members.groupBy("key").agg(F.count("*").alias("members"))
    score = members.join(sizes, "key").groupBy("node").agg(F.sum("members").alias("score"))
    known = sets.select("node", F.size("set").alias("n")).join(score, "node").join(nodes.select("node", "bands"), "node")
    state = _opened(members.join(known, "node").withColumns({"r": F.col("n"), "label": F.col("node")}), threshold)
    labels, links, leaders, turn = None, None, 1, 0
    while not state.isEmpty():
        with scratch(spark) as made:
            own = state
            if turn in (1, 2):
                own = materialise(state.drop("r").join(_shared(state, sets), "node").select(state.columns), "near-state")
            order = Window.partitionBy("key").orderBy(F.desc("score"), "node")
            lead = own.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= leaders)
            lead = materialise(lead.select("key", *(F.col(c).alias(f"{c}_2") for c in ("node", "label", "n", "r", "bands"))), "near-leaders")
            able = (F.col("label") != F.col("label_2")) & _can_link(F.col("r"), F.col("n"), F.col("r_2"), F.col("n_2"), threshold)
            first = F.array_min(F.array_intersect("bands", "bands_2")) == F.col("m.key")
            met = own.alias("m").join(lead, (F.col("m.key") == lead["key"]) & able & first)
            pairs = materialise(met.select(F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b")).distinct(), "near-pairs")
            new = materialise(_links(pairs, sets, threshold), "near-links")
            # leaders have met every member of their bucket
            rest = own.join(lead.select("key", F.col("node_2").alias("node")), ["key", "node"], "left_anti")
            before = labels
            if not new.isEmpty():
                links = new if links is None else links.unionByName(new)
                labels = classes_of(links)
                rest = rest.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
                made.keep(new)
                made.keep(labels)
            following = _opened(rest.select(state.columns), threshold)
            made.keep(following)
        if before is not None and before is not labels:
            discard(before)
        discard(state)
        state, turn = following, turn + 1
        leaders = leaders * GROWTH if turn > 1 else 1
        # plans of the round are garbage now: once they are collected, Spark's cleaner deletes their shuffle files
        gc.collect()
        spark._jvm.System.gc()
    return labels


def classify(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id, class_size, kept, digest: a row per row of docs(doc_id, text). class_id: the smallest doc_id of the class."""
    spark = docs.sparkSession
    with scratch(spark) as made:
        normal = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal_words(F.col("text")).alias("normal"))
        hashed = normal.select("doc_id", F.unhex(F.sha2("normal", 256)).alias("digest"), _word_hashes(F.col("normal")).alias("words"))
        banded = arrow_map(hashed, lambda b: _banded(b, bands, rows), "doc_id long, digest binary, bands array<long>")
        table = materialise(banded.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "digest", "bands"), "near-bands")

        # texts with the same words: one node, whose keys any of its rows can give
        named = table.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.min("rid").alias("node"), F.any_value("bands").alias("bands"), F.count("*").alias("copies"))
        nodes = materialise(named, "near-nodes")
        keys = nodes.where(F.col("bands").isNotNull()).select(F.explode("bands").alias("key"), "node")
        shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        members = materialise(keys.join(shared, "key"), "near-members")

        # shingle sets of the nodes in such buckets alone; a bitmap keeps other texts out of the exchange
        involved = materialise(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "digest", "first_id"), "near-involved")
        texts = normal.withColumn("digest", F.unhex(F.sha2("normal", 256)))
        texts = Membership(involved, "digest").maybe(texts, "digest")
        own = texts.join(involved, (texts["digest"] == involved["digest"]) & texts["doc_id"].eqNullSafe(involved["first_id"])).select("node", "normal")
        once = own.groupBy("node").agg(F.min("normal").alias("normal"))
        sets = materialise(arrow_map(once.select("node", _word_hashes(F.col("normal")).alias("words")), _sets, "node long, set array<long>"), "near-sets")

        labels = _components(members, nodes, sets, threshold)
        found = nodes.select("node", "digest", "first_id", "copies")
        found = found.withColumn("label", F.col("node")) if labels is None else found.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        # a class is known from its nodes, and its first row by the smallest doc_id and then row number of its first node
        lead = F.struct(F.col("first_id").isNull().alias("absent"), "first_id", "node")
        groups = materialise(found.groupBy("label").agg(F.min(lead).alias("first"), F.sum("copies").alias("class_size"), F.count("*").alias("nodes")), "near-groups")
        found = materialise(found.select("digest", "label", "copies"), "near-found")
        classes = join_spread(found, groups, "label", "nodes").select("digest", "copies", F.col("first.first_id").alias("class_id"), F.col("first.node").alias("first_node"), "class_size")
        classes = materialise(classes, "near-classes")
        # rows of one text are spread too: a text with a large share of the rows meets its class where its rows lie
        placed = materialise(join_spread(table.select("rid", "doc_id", "digest"), classes, "digest", "copies"), "near-placed")
        made.keep(placed)
    first_row = placed.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("first_node").agg(F.min("rid").alias("first_rid"))
    # blank texts are alone
    blank = F.col("digest") == F.unhex(F.lit("e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"))
    single = placed.where(blank | (F.col("class_size") == 1)).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), "digest")
    several = placed.where(~blank & (F.col("class_size") > 1))
    others = several.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", "class_id", "class_size", F.lit(False).alias("kept"), "digest")
    # few rows of a class have its smallest doc_id: the first of them stays
    leads = several.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).join(first_row, "first_node")
    leads = leads.select("doc_id", "class_id", "class_size", (F.col("rid") == F.col("first_rid")).alias("kept"), "digest")
    return single.unionByName(others).unionByName(leads)


def without_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, one of each class, with all their columns."""
    rows = packed(docs, doc=F.col("doc_id").cast("long"), digest=F.unhex(F.sha2(normal_words(F.col("text")), 256)))
    several = classify(docs, **options).where("class_size > 1")
    decided = materialise(several.select(F.col("doc_id").alias("doc"), "digest", F.col("kept").alias("stays")), "near-decided")
    return keep_decided(rows, decided)


def op8_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("digest")
