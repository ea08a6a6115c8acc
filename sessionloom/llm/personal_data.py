"""Personal data: base patterns, and identifiers that bootstrapped contexts point at.

Seeds: base entities (email, ip, card, phone), and anchored values, identifier-like tokens behind a word that names an identifier and one of
`: = #`. What stands around a candidate token gives its patterns, in three forms: the two words before it, with or without the word
after it, and the one word before it with the word after it. Digits, letter case, white space, and the brackets and quotes around the token are
generalised. Patterns and instances (the distinct tokens) form a graph over the whole corpus, which is scored in rounds: a pattern's
confidence is the share of its distinct instances that are believed; a pattern with `min_support` distinct instances and `min_confidence` is sure; an
instance is believed if it is a seed or has a pattern that was sure in the round before. So an instance that a sure pattern points at lends its
belief to its other contexts. It ends when a round finds no new sure pattern, or after `rounds`. Every candidate with a sure pattern that touches no base
span is marked as kind `id`, whatever its length or shape.

Candidates: tokens of 4 characters or more with a digit or @, and tokens of any kind behind `: = #`. Not found: other tokens, such as
plain words or numbers under 4 digits behind a context without such a sign.
DataFrame functions only. Texts are scanned once, map-side; the graph and the joins carry spans and patterns, no texts. A scan takes
n log n steps for n matches in a text.

Null text: no spans. Repeated rows count each, but an instance counts once for a pattern, however often it is copied. Texts of any length are whole;
patterns are linear and don't recurse. Empty table: empty result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, join_spread, let, materialise

KINDS = ("email", "ip", "card", "phone", "id")
#: The base patterns. Look-behinds and possessive loops only save steps: what matches, and where, is as with
#: the plain patterns, and a digit run of the wrong length for a card is passed over as a whole.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: A candidate token: one that looks like an identifier, or any behind a sign.
BODY = r"@?[A-Za-z0-9_]++(?:(?:[.%+/@-]++|(?<=[0-9]):)[A-Za-z0-9_]++)*+"
SHAPED = r"(?=[A-Za-z_.%+/-]*+[0-9@])(?=[A-Za-z0-9_.%+/@:-]{4})"
SIGNED = r"(?<=[:=#][\x20\t]{0,2}[\x22'`(\[{<‘“„«‹]{0,1})"
TOKEN = rf"(?<![\p{{L}}\p{{N}}_@%+/-])(?:{SHAPED}|{SIGNED}){BODY}"
#: What may open before a token, or close after it, and says nothing about it.
OPENING = r"(?<![(\[{<\x22'`‘“„«‹])[(\[{<\x22'`‘“„«‹]++$"
CLOSING = r"^[)\]}>\x22'`’”»›.,;:!?\x20\t]*+([^\x20\x09-\x0D]*+)"
#: Words that name an identifier. A token with a digit, of 4 characters or more, behind such a word and a sign is a seed.
ANCHORS = (
    "access account acct api apikey auth authorization badge bearer card code contact cookie credential credentials cvc cvv email employee fax handle iban id "
    "identifier key licence login mail member mobile nino nonce pass passcode passport passwd password patient personnel phone pin pwd secret serial session sid signature "
    "sin ssn swift tel telephone token uid user userid username uuid vat"
).split()
ANCHOR = r"(?:^|[^a-z])(?:" + "|".join(ANCHORS) + r")\x20?[:=#]\x20?$"
MIN_SUPPORT = 5
MIN_CONFIDENCE = 0.8
ROUNDS = 8

SPAN = "array<struct<kind:int,start:int,end:int>>"
CANDIDATE = "array<struct<start:int,end:int,token:string,left:string,right:string>>"


def running(values: Column, combine) -> Column:
    """The running results of combine(earlier, later) over an array, in log n steps over it: after step k each place covers the 2 ** k values up to it."""
    steps = F.array(*[F.lit(1 << k) for k in range(31)])
    add = lambda done, s: F.transform(done, lambda x, i: F.when(i >= s, combine(F.get(done, i - s), x)).otherwise(x))
    return let(values, lambda v: F.aggregate(F.filter(steps, lambda s: s < F.size(v)), v, add))


def _placed(text: Column, pattern: str, empty: Column, one) -> Column:
    """one(match, start, end, piece before, piece after, number) for every match of pattern in text: the pieces between matches give their places."""

    def placed(m: Column) -> Column:
        def with_pieces(p: Column) -> Column:
            lengths = F.transform(m, lambda x, i: F.length(F.get(p, i)) + F.length(x))
            ends = running(lengths, lambda a, b: a + b)
            return let(ends, lambda e: F.transform(m, lambda x, i: one(x, F.get(e, i) - F.length(x), F.get(e, i), F.get(p, i), F.get(p, i + 1), i)))

        return let(F.split(text, pattern, -1), with_pieces)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, empty).otherwise(placed(m)))


def _found(text: Column, kind: int, pattern: str, guard: Column, valid) -> Column:
    """Valid spans of pattern in text, in order."""
    empty = F.from_json(F.lit("[]"), "array<struct<kind:int,start:int,end:int,match:string>>")
    span = lambda x, start, end, *_: F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x.alias("match"))
    spans = F.filter(_placed(text, pattern, empty, span), lambda s: valid(s["match"]))
    return F.when(guard, F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))).otherwise(F.from_json(F.lit("[]"), SPAN))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def step(total, i):
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), step) % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """Valid base spans by kind as listed, then start: array<struct<kind,start,end>>."""
    digit = F.rlike(text, F.lit("[0-9]"))
    return F.concat(
        _found(text, 0, EMAIL, F.contains(text, F.lit("@")), lambda m: F.lit(True)),
        _found(text, 1, IP, digit & F.rlike(text, F.lit(r"[0-9]\.[0-9]")), lambda m: F.rlike(m, F.lit(rf"^{PART}\.{PART}\.{PART}\.{PART}$"))),
        _found(text, 2, CARD, digit, lambda m: luhn(_digits(m))),
        _found(text, 3, PHONE, F.contains(text, F.lit("+")), lambda m: F.length(_digits(m)).between(9, 15)),
    )


def _general(words: Column) -> Column:
    """Lower case, digits as 0, white space as single spaces."""
    return F.regexp_replace(F.translate(F.lower(words), "123456789", "000000000"), SPACE, " ")


def contexts(text: Column) -> Column:
    """Candidate tokens with what stands around them: array<struct<start,end,token,left,right>>. left: two words and what adjoins the token;
    right: the next word. A sign stands for a token before or after."""
    empty = F.from_json(F.lit("[]"), CANDIDATE)

    def one(x, start, end, before, after, i):
        left = F.concat(F.when(i > 0, "␟").otherwise(""), _general(F.regexp_replace(before, OPENING, "")))
        return F.struct(start.alias("start"), end.alias("end"), x.alias("token"), F.substring_index(left, " ", -3).alias("left"), _general(F.regexp_extract(after, CLOSING, 1)).alias("right"))

    return F.when(F.rlike(text, F.lit("[0-9@:=#]")), _placed(text, TOKEN, empty, one)).otherwise(empty)


def _touching(base: Column, candidates: Column) -> Column:
    """For each candidate whether a base span overlaps it. In the order of base starts and candidate ends, the furthest base end so far tells."""
    event = lambda at, kind, reach, i: F.struct(at.alias("at"), kind.alias("kind"), reach.alias("reach"), i.alias("i"))
    starts = F.transform(base, lambda b: event(b["start"], F.lit(1), b["end"], F.lit(-1)))
    ends = F.transform(candidates, lambda c, i: event(c["end"], F.lit(0), F.lit(0), i))

    def told(events: Column) -> Column:
        reach = running(F.transform(events, lambda e: e["reach"]), lambda a, b: F.greatest(a, b))
        of_candidates = F.filter(F.zip_with(events, reach, lambda e, r: F.struct(e["i"].alias("i"), r.alias("reach"))), lambda x: x["i"] >= 0)
        return let(F.array_sort(of_candidates), lambda x: F.transform(candidates, lambda c, i: F.get(x, i)["reach"] > c["start"]))

    return let(F.array_sort(F.concat(starts, ends)), told)


def _patterns(left: Column, right: Column) -> Column:
    """The three forms; a context without a letter before the token says nothing."""
    two, one = left, F.substring_index(left, " ", -2)
    forms = F.array(F.concat(F.lit("2+ "), two, F.lit(" … "), right), F.concat(F.lit("2  "), two), F.concat(F.lit("1+ "), one, F.lit(" … "), right))
    told = F.array(F.rlike(two, F.lit(r"\p{L}")), F.rlike(two, F.lit(r"\p{L}")), F.rlike(one, F.lit(r"\p{L}")) & (right != ""))
    return F.filter(forms, lambda x, i: F.get(told, i))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document, without its text: rid, doc_id, base (spans), candidates with patterns, instance and seed. Written once."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    scanned = rows.select("rid", "doc_id", base_spans(F.col("text")).alias("base"), contexts(F.col("text")).alias("found"))
    touched = F.when(F.size("base") > 0, _touching(F.col("base"), F.col("found")))

    def candidate(c: Column, touches: Column) -> Column:
        anchored = F.rlike(c["left"], F.lit(ANCHOR)) & F.rlike(c["token"], F.lit("[0-9]")) & (F.length(c["token"]) >= 4)
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), _patterns(c["left"], c["right"]).alias("patterns"), F.xxhash64(F.lower(c["token"])).alias("instance"), (touches | anchored).alias("seed"), touches.alias("base"))

    # let: once per row, not once per candidate
    candidates = let(touched, lambda t: F.transform("found", lambda c, i: candidate(c, F.coalesce(F.get(t, i), F.lit(False)))))
    return materialise(scanned.select("rid", "doc_id", "base", candidates.alias("candidates")), "personal-scan")


def _candidates(scanned: DataFrame) -> DataFrame:
    """rid, start, end, pattern, instance, seed, base: a row per candidate and pattern."""
    rows = scanned.where(F.size("candidates") > 0).select("rid", F.explode("candidates").alias("c"))
    return rows.select("rid", "c.start", "c.end", "c.instance", "c.seed", "c.base", F.explode("c.patterns").alias("pattern"))


def patterns(scanned: DataFrame, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """pattern, support, confidence of the patterns that are sure; a table on disk."""
    edges = materialise(_candidates(scanned).groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "personal-edges")
    enough = materialise(edges.groupBy("pattern").agg(F.count("*").alias("support")).where(F.col("support") >= min_support), "personal-support")
    edges = materialise(join_spread(edges, enough, "pattern", "support"), "personal-edges")
    instances = materialise(edges.groupBy("instance").agg(F.count("*").alias("times"), F.max("seed").alias("believed")), "personal-instances")
    before = -1
    for _ in range(rounds):
        told = join_spread(edges.select("pattern", "support", "instance"), instances, "instance", "times")
        scored = told.groupBy("pattern").agg(F.max("support").alias("support"), F.avg(F.col("believed").cast("double")).alias("confidence"))
        sure = materialise(scored.where(F.col("confidence") >= min_confidence), "personal-patterns")
        found = sure.count()
        if found == before or not found:
            break
        before = found
        reached = join_spread(edges.select("pattern", "instance"), sure.select("pattern", "support"), "pattern", "support").select("instance").distinct()
        more = instances.join(reached.withColumn("reached", F.lit(True)), "instance", "left")
        instances = materialise(more.select("instance", "times", (F.col("believed") | F.coalesce("reached", F.lit(False))).alias("believed")), "personal-instances")
    return sure


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts, base_sha256, spans, n_id, n_spans for docs(doc_id, text)."""
    scanned = scan(docs)
    sure = patterns(scanned, **options)
    rows = _candidates(scanned).where(~F.col("base")).select("rid", "start", "end", "pattern")
    places = materialise(rows.groupBy("pattern").agg(F.count("*").alias("places")).join(sure.select("pattern"), "pattern"), "personal-places")
    marked = join_spread(rows, places, "pattern", "places").select("rid", "start", "end").distinct()
    more = marked.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct(F.lit(4).alias("kind"), "start", "end"))).alias("more"))
    text_of = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    rows = scanned.drop("candidates").join(more, "rid", "left").withColumn("more", F.coalesce("more", F.from_json(F.lit("[]"), SPAN)))
    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return rows.select(
        "doc_id", *counts, F.sha2(text_of(F.col("base")), 256).alias("base_sha256"), text_of(F.concat("base", "more")).alias("spans"),
        F.size("more").cast("long").alias("n_id"), (F.size("base") + F.size("more")).cast("long").alias("n_spans"),
    )


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
