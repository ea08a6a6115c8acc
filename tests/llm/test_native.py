"""Quality, exact deduplication, personal data and mixing against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import exact_dedup, line_quality, mixing, personal_data
from sessionloom.llm.queries import ORACLE_SQL, QUERIES

from .support import SCHEMA, clashing, empty, odd_docs, odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_agrees_on_odd_rows(spark, name, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    odd_docs(spark).coalesce(1).write.parquet(path)
    got = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a = sorted_rows(got.select(columns).collect())
    b = sorted_rows(want.project(",".join(columns)).fetchall())
    assert a == b


def base_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def plain_quality(rows, limit, percent):
    norm = lambda x: " ".join(WORD.findall(x.lower()))
    once = {(host, doc, frozenset(norm(x) for x in (text or "").split("\n") if norm(x))) for doc, text, _, host, _ in rows}
    docs, of_host = Counter((host, x) for host, _, lines in once for x in lines), Counter(host for host, _, _ in once)
    out = []
    for doc, text, _, host, _ in rows:
        n, chars, symbols, dup, repeat = base_counts(text)
        gone = [norm(x) for x in (text or "").split("\n") if norm(x) and docs[host, norm(x)] > limit and 100 * docs[host, norm(x)] > percent * of_host[host]]
        failed = n < 50 or 100 * repeat > 50 * n
        removed = sum(len(x.split(" ")) for x in gone)
        out.append((doc, n, chars, symbols, dup, repeat, failed, not failed and 10 * (n - removed) >= 3 * n, removed, len(gone)))
    return out


def quality_rows():
    r = random.Random(9)
    common = [prose(90 + i, 40) for i in range(3)]
    rows = odd_rows()
    for i in range(60):
        lines = [prose(200 + i, r.randint(5, 120)), *r.sample(common, r.randint(0, 3)), prose(i % 5, 6)]
        r.shuffle(lines)
        rows.append((100 + i, "\n".join(lines).upper() if i % 7 == 0 else "\n".join(lines), "en", "abc"[i % 3] if i % 4 else None, 1))
    rows.append((999, "a b c a b c a b x y\n" * 30, "en", "z", 1))
    return rows


def depleted_rows():
    """Documents that are frequent lines for the most part, and repeated rows that mustn't make a line frequent."""
    common = "\n".join(prose(70 + i, 30) for i in range(3))
    rows = [(2000 + i, f"{common}\n{prose(300 + i, 10)}", "en", "d", 1) for i in range(9)] + [(2100 + i, prose(400 + i, 90), "en", "d", 1) for i in range(9)]
    return rows + [(2200, prose(500, 80), "en", "d", 1)] * 12


@pytest.mark.parametrize("limit, percent", [(6, 2), (6, 30), (3, 50)])
def test_line_quality(spark, limit, percent):
    rows = quality_rows() + depleted_rows()
    docs = clashing(spark.createDataFrame(rows, SCHEMA))
    got = line_quality.line_quality(docs.drop("host"), max_docs=limit, max_percent=percent).collect()
    assert sorted_rows(got) == sorted_rows(plain_quality(rows, limit, percent))
    verdict = {r.doc_id: r for r in got}
    assert not any(verdict[2000 + i].base_failed for i in range(9))
    assert {verdict[2000 + i].kept for i in range(9)} == {percent == 50}  # nine documents of nineteen hold each line
    assert verdict[2200].kept and verdict[2200].n_removed_lines == 0


def test_cleaned_text(spark):
    rows = [(i, f"Own line {i}\nThe  Same line\nx{i}", "en", "a", 1) for i in range(8)] + [(9, "the same LINE", "en", "b", 1)]
    rows += [(10, None, "en", "a", 1), (11, "", "en", None, 1)]
    docs = clashing(spark.createDataFrame(rows, SCHEMA))
    cleaned = line_quality.cleaned_text(docs, max_docs=5)
    assert cleaned.columns == docs.columns
    got = {r.doc_id: r.text for r in cleaned.collect()}
    assert got == {**{i: f"Own line {i}\nx{i}" for i in range(8)}, 9: "the same LINE", 10: None, 11: ""}


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, keep):
    rows = odd_rows() + [(None, None, None, None, None), (50, prose(2, 80), "en", "a", 1)]
    docs = clashing(spark.createDataFrame(rows, SCHEMA))
    got = exact_dedup.verdicts(docs, keep).collect()
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[t or ""].append(d)
    pick = min if keep == "smallest" else max
    want = []
    for text, ids in groups.items():
        best = pick((d for d in ids if d is not None), default=None)
        taken = False
        for d in ids:
            kept = d == best and not taken
            taken |= kept
            want.append((d, best, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    assert sorted_rows(got) == sorted_rows(want)
    left = exact_dedup.deduplicate(docs, keep)
    assert left.columns == docs.columns and left.count() == len(groups) == left.select(F.coalesce("text", F.lit(""))).distinct().count()


def test_index_in_batches(spark):
    docs = odd_docs(spark)
    parts = [docs.where("doc_id <= 5"), docs.where("doc_id > 5 OR doc_id IS NULL")]
    assert sorted_rows(exact_dedup.verdicts(docs, "smallest", parts).collect()) == sorted_rows(exact_dedup.verdicts(docs, "smallest").collect())


def test_collisions_are_split(spark, monkeypatch):
    """With a digest that says too little, the bytes decide."""
    monkeypatch.setattr(exact_dedup, "digest_of", lambda text: F.unhex(F.sha2(F.substring(F.coalesce(text, F.lit("")), 1, 1), 256)))
    docs = spark.createDataFrame([(1, "ab"), (2, "ac"), (3, "ab"), (4, "x")], "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, exact_dedup.fresh_path(spark, "i"), "largest")
    index.add(docs)
    index.compact()
    assert exact_dedup.differing(docs, exact_dedup.materialise(index.entries(), "e")).count() == 1
    more = spark.createDataFrame([(7, "ab"), (8, "ad"), (9, "x"), (10, "y")], "doc_id long, text string")
    assert sorted(r.doc_id for r in index.lookup(more, docs).collect()) == [7, 9]
    monkeypatch.undo()
    whole = exact_dedup.verdicts(docs, "largest")
    wrong = spark.createDataFrame([(bytearray.fromhex(hashlib.sha256(b"ab").hexdigest()),)], "digest binary")
    assert sorted_rows(exact_dedup._split_collisions(whole, docs, wrong, "largest").collect()) == sorted_rows(whole.collect())


def test_index_levels_and_lookup(spark):
    """Full levels are merged, entries keep the smallest identifiers, and a lookup reads only runs that its filters hit."""
    index = exact_dedup.DigestIndex(spark, exact_dedup.fresh_path(spark, "i"), "smallest", fanout=3)
    batches = [[(100 * b + i, f"text {b} {i}") for i in range(40)] + [(100 * b + 99, "in all")] for b in range(5)]
    frames = [spark.createDataFrame(b, "doc_id long, text string") for b in batches]
    for f in frames:
        index.add(f)
    assert [len(own) for own in index.levels] == [2, 1]
    texts = spark.createDataFrame([r for b in batches for r in b], "doc_id long, text string")
    asked = spark.createDataFrame([(9001, "text 4 7"), (9002, "text 4 8"), (9003, "text 4 7"), (9004, "nowhere"), (9005, None)], "doc_id long, text string")
    got = {r.doc_id: (r.keep.doc_id, r.copies) for r in index.lookup(asked, texts).collect()}
    assert got == {9001: (407, 1), 9002: (408, 1), 9003: (407, 1)}
    assert index.probed == [index.levels[0][1].path]
    got = {r.doc_id: (r.keep.doc_id, r.copies) for r in index.lookup(spark.createDataFrame([(9006, "in all"), (9007, "text 0 3")], "doc_id long, text string"), texts).collect()}
    assert got == {9006: (99, 5), 9007: (3, 1)} and len(index.probed) == 3
    assert index.lookup(spark.createDataFrame([(1, "nowhere")], "doc_id long, text string"), texts).count() == 0 and index.probed == []
    index.compact()
    assert [len(own) for own in index.levels] == [0, 1]
    entries = index.entries().collect()
    assert len(entries) == 201 and {e.copies for e in entries} == {1, 5} and [e.keep.doc_id for e in entries if e.copies == 5] == [99]
    for own in index.levels:
        for run in own:
            digests = [bytes(r.digest) for r in spark.read.parquet(run.path).withColumn("f", F.input_file_name()).select("f", "digest").collect()]
            assert len(digests) == run.entries


def plain_base(text):
    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m[0])]


def pii_texts():
    r = random.Random(3)
    pieces = ["a@b.co", "_x@y.zz", "1.2.3.4", "256.1.1.1", "0001.002.3.255", "10.0.0.1", "0.00.000.0", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "+1 (22) 333-4444.", "+12345678", "+1 234 567 890 123 4567", "12", "  ", ".", "@", "+", "-", "é", "x", "\n", "5", "𝔘", "a.b-c%+@d-e.f.g", "99999999999999999999999999", "..", "@x.y"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(1, 25))) for _ in range(600)]
    return texts + ["", "a" * 20_000, "1" * 20_000, "1 " * 20_000, "1." * 20_000, "a@" * 5_000, "+1" * 5_000, "mail a@b.co_x@y.zz", "1.2.3.4.5.6.7.8", "12  4111111111111111"]


def test_personal_data_base(spark):
    texts = pii_texts()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in personal_data.personal_data(clashing(docs)).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        spans = plain_base(t)
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")), t
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (got[i].spans + ",").startswith(want)


def bootstrapping_rows():
    rows = [(i, f"{prose(i, 6)} reach me at: user{i}@mail.example.com {prose(50 + i, 4)}") for i in range(12)]
    rows += [(500 + i, f"{prose(i, 6)} Reach me at: u{i}@mail.example.com") for i in range(24)]
    rows += [(20, "words here reach me at: handle_77 and so on"), (21, "version is 2024_10 here"), (22, "Reach me  at: (nick-55) fine"), (23, 'so reach me at: "nick-56" then')]
    rows += [(24, "so reach me at: [\u201cnick-57\u201d] then"), (25, "so reach them at: (nick-58) then"), (26, "REACH me at: bob")]
    rows += [(30 + i, f"{prose(i, 5)} version is {i}20_10 {prose(i, 3)}") for i in range(12)]
    # anchored values, then another context of theirs, then others in that context
    rows += [(50 + i, f'{prose(i, 4)} api token = "k{i}zz{i}" {prose(i, 2)}') for i in range(8)]
    rows += [(60 + i, f"{prose(i, 4)} entry was signed by k{i}zz{i} on {prose(i, 2)}") for i in range(8)]
    rows += [(70, "so it was signed by q77x on monday"), (71, "it was signed by q77x."), (72, "Was Signed\nby\t'Q99/x'"), (73, "paid with 7001a today")]
    return rows + [(80, "1234 5678 " * 40), (81, "x@y.zz: " * 30), (82, None), (83, "reach me at: user1@mail.example.com, reach me at: 10.0.0.1; reach me at: ab-12")]


def ids_of(spans):
    return [tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s.startswith("id:")]


def test_bootstrapping(spark):
    rows = bootstrapping_rows()
    got = {r.doc_id: ids_of(r.spans) for r in personal_data.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    found = {d: [texts[d][a:b] for a, b in spans] for d, spans in got.items() if spans}
    assert {d: found.get(d) for d in (20, 22, 23, 24, 26, 70, 71, 72, 83)} == {20: ["handle_77"], 22: ["nick-55"], 23: ["nick-56"], 24: ["nick-57"], 26: ["bob"], 70: ["q77x"], 71: ["q77x"], 72: ["Q99/x"], 83: ["ab-12"]}
    assert all(found[50 + i] == found[60 + i] == [f"k{i}zz{i}"] for i in range(8))
    assert set(found) == {20, 22, 23, 24, 26, 70, 71, 72, 83, *range(50, 58), *range(60, 68)}


def plain_spans(rows, support=5, confidence=0.8):
    """The spans of kind id, by loops over all candidates and patterns."""
    import regex

    pd_ = personal_data
    general = lambda s: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]", "0", s.lower()))
    seen, seeds, found = defaultdict(set), set(), []
    for n, (_, text) in enumerate(rows):
        text = text or ""
        base, end = [(a, b) for _, a, b in plain_base(text)], 0
        # look-behinds there see no letters beyond the basic plane
        matches = list(regex.finditer(pd_.TOKEN, re.sub("[\U00010000-\U0010ffff]", "\u2400", text)))
        for i, m in enumerate(matches):
            before, after = text[end : m.start()], text[m.end() : matches[i + 1].start() if i + 1 < len(matches) else len(text)]
            end = m.end()
            left = " ".join((("\u241f" if i else "") + general(regex.sub(pd_.OPENING, "", before))).split(" ")[-3:])
            right = general(regex.match(pd_.CLOSING, after)[1])
            one = " ".join(left.split(" ")[-2:])
            own = []
            if regex.search(r"\p{L}", left):
                own += [f"2+ {left} \u2026 {right}", f"2  {left}"]
            if regex.search(r"\p{L}", one) and right:
                own.append(f"1+ {one} \u2026 {right}")
            token = text[m.start() : m.end()].lower()
            touches = any(a < m.end() and b > m.start() for a, b in base)
            if touches or re.search(pd_.ANCHOR, left) and re.search("[0-9]", token) and len(token) >= 4:
                seeds |= {(p, token) for p in own}
            for p in own:
                seen[p].add(token)
            found.append((n, m.start(), m.end(), own, touches))
    seen = {p: t for p, t in seen.items() if len(t) >= support}
    believed = {t for p, t in seeds if p in seen}
    while True:
        sure = {p for p, t in seen.items() if len(t & believed) / len(t) >= confidence}
        more = believed | {t for p in sure for t in seen[p]}
        if more == believed:
            break
        believed = more
    return {n: [(a, b) for k, a, b, own, touches in found if k == n and not touches and set(own) & sure] for n in range(len(rows))}


def test_bootstrapping_against_brute_force(spark):
    r = random.Random(12)
    cues = ["reach me at: ", "signed by ", "token = \"", "paid with ", "version ", "see (", "user#", "at 5 ", "code:"]
    ids = [f"k{i}z{i}" for i in range(15)] + [f"u{i}@m.co" for i in range(12)] + ["1.2.3.4", "abc", "2024", "v2.1", "10:30:11", "@nick", "+12 345 678 901"]
    rows = [(i, " ".join(prose(r.randint(0, 99), r.randint(0, 3)) + " " + r.choice(cues) + r.choice(ids) + r.choice(["", '"', ".", " and", ") on"]) for _ in range(r.randint(1, 6)))) for i in range(250)]
    rows += [(1000 + i, t) for i, t in bootstrapping_rows()] + [(2000 + i, t) for i, t in enumerate(pii_texts()[:300])]
    got = {x.doc_id: x for x in personal_data.personal_data(clashing(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    want = plain_spans(rows)
    assert sum(map(len, want.values())) > 200
    for n, (d, _) in enumerate(rows):
        assert ids_of(got[d].spans) == want[n], rows[n]
        assert got[d].n_id == len(want[n]) and got[d].n_spans == got[d].n_id + got[d].n_email + got[d].n_ip + got[d].n_card + got[d].n_phone


def test_a_long_text_of_tokens(spark):
    import time

    text = " ".join(f"tok{i} = a{i}b, call +1 (555) 555-{i % 10000:04d} or u{i}@m.example.com" for i in range(14_000))
    assert len(text) > 900_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    personal_data.scan(docs.limit(0))
    began = time.process_time(), time.time()
    got = personal_data.scan(docs).selectExpr("size(base) AS b", "size(candidates) AS c").first()
    assert time.time() - began[1] < 30 and got.b == 28_000 and got.c >= 56_000


def plain_targets(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > epochs * sizes[s]]
        if not over:
            return fixed | {s: level * w[s] for s in free}
        fixed |= {s: epochs * sizes[s] for s in over}


def test_mixing(spark):
    r = random.Random(5)
    rows = odd_rows() + [(100 + i, prose(i, r.randint(1, 30)), "en", r.choice(["s1", "s2", "s3", "s3", "s3", "s3", None]), 1) for i in range(400)]
    docs = clashing(spark.createDataFrame(rows, SCHEMA))
    got = mixing.quotas(docs).collect()
    sizes, by_doc = Counter(), Counter()
    for d, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
        by_doc[d, len(WORD.findall(t or "")), s] += 1
    want = plain_targets(dict(sizes))
    assert len(got) == len(rows)
    source = {d: s for d, _, _, s, _ in rows}
    taken = Counter()
    for x in got:
        s = source[x.doc_id]
        assert x.source_size == sizes[s] and x.target == pytest.approx(want[s])
        assert 0 <= x.taken <= 3 * x.size and (x.size == 0 or x.taken % x.size == 0)
        taken[s] += x.taken
    for s in sizes:
        longest = max((len(WORD.findall(t or "")) for _, t, _, o, _ in rows if o == s), default=0)
        assert abs(taken[s] - want[s]) <= longest
    assert sorted_rows(got) == sorted_rows(mixing.quotas(docs.repartition(7)).collect())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(x.text or "")) for x in mixed.collect()) == sum(x.taken for x in got)
    assert Counter(x.doc_id for x in mixed.collect()) == Counter({d: n for d, n in ((d, sum(x.copies for x in got if x.doc_id == d)) for d in {x.doc_id for x in got}) if n})


def test_mixing_rows_that_share_doc_id_and_size(spark):
    """They differ in source or text: each source has its own cut, and no row loses copies to another."""
    r = random.Random(6)
    rows = [(i % 60, prose(i, 5 + i % 7), "en", "abcde"[i % 5], 1) for i in range(300)] + [(7, prose(1, 9), "en", "a", 1)] * 5
    docs = clashing(spark.createDataFrame(rows, SCHEMA))
    got = mixing.quotas(docs).collect()
    mixed = [tuple(x)[:5] for x in mixing.mix(docs).collect()]
    r.shuffle(rows)
    taken = Counter()
    for x in got:
        taken[x.source_size] += x.taken
    words = Counter()
    for row in mixed:
        words[row[3]] += len(row[1].split())
    sizes = Counter()
    for row in rows:
        sizes[row[3]] += len(row[1].split())
    assert sorted(words.values()) == sorted(taken.values()) and set(mixed) <= set(rows)
    want = plain_targets(dict(sizes))
    assert all(abs(words[s] - want[s]) <= 45 for s in sizes)
    # many sources: rows meet them by an exchange
    few, mixing.FEW_SOURCES = mixing.FEW_SOURCES, 2
    try:
        assert sorted_rows(mixing.quotas(docs).collect()) == sorted_rows(got)
    finally:
        mixing.FEW_SOURCES = few


def test_empty(spark):
    docs = empty(spark)
    assert line_quality.line_quality(docs).count() == 0
    assert exact_dedup.verdicts(docs).count() == exact_dedup.deduplicate(docs).count() == 0
    assert personal_data.personal_data(docs).count() == 0
    assert mixing.quotas(docs).count() == mixing.mix(docs).count() == 0
