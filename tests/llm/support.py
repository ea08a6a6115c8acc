"""Small documents with every odd case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is that for it with as on be at by this are from or an river stone window garden winter letter number morning silver market engine circle".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice("abcdefgh") * r.randint(0, 2)) for _ in range(n))


def odd_rows():
    long = prose(1, 6000)
    rows = [
        (1, prose(2, 80), "en", "a", 1),
        (2, prose(2, 80), "en", "a", 1),  # a copy
        (3, None, "en", "a", None),
        (4, "", None, "b", 0),
        (5, " \n\t ", "fr", None, 4),
        (6, long, "en", "b", len(long)),
        (7, prose(2, 80) + " more", "en", "a", 1),  # a near copy
        (8, "one two", "en", None, 7),
        (8, "one two", "en", None, 7),  # a repeated row
        (None, "no id here at all", "de", "b", 17),
        (9, "... 12 !!", "es", "c", 9),
        (10, "x" * 50_000, "en", "c", 50_000),
        (11, "été déjà vu où ça", "fr", "c", 17),
        (12, "汉字 и кириллица 𝔘𝔫𝔦", "en", "c", 5),
        (13, "<|endoftext|> a <|startoftext|>b's don't İx", "en", "c", 5),
    ]
    return rows


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def clashing(df):
    """df with more columns, of names that operators use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("x") for n in ("rid", "digest", "key", "node", "label", "size", "host", "hash", "kept", "length", "words", "bucket", "_salt", "at", "rank", "normal", "lines", "base", "start", "target", "row", "doc", "docs", "copies", "cut", "stays", "asked", "keep", "place", "line", "rows",
        "_own", "_n", "_doc", "_size", "_copies", "_sha256", "_asked", "_bucket", "_at", "_bitmap", "_digest", "_rid", "_gone", "_maybe", "a.b", "with `tick")})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
