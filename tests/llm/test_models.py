"""Language identification, near duplicates and page text."""

import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from sessionloom.llm import html_text, language, near_dedup

from .support import SCHEMA, clashing, empty, odd_docs, odd_rows, prose

SF = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.predict(docs, language.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def plain_profile(text, ranks):
    from collections import Counter

    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    counts = Counter()
    for w in words:
        for marked, n in ((w, 1), (f" {w} ", 2), (f" {w} ", 3)):
            counts.update(marked[i : i + n] for i in range(len(marked) - n + 1))
    return counts


@pytest.mark.parametrize("text", ["Ab cd, AB", "x", "l'été déjà vu 𝔘", prose(3, 200), "a  b\n\nc1d"])
def test_grams_equal_plain_counts(text):
    codes, counts = language.grams(text)
    plain = plain_profile(text, 10)
    assert sorted(counts.tolist()) == sorted(plain.values()) and len(set(codes.tolist())) == len(plain)


def plain_prediction(text, profiles, ranks):
    """Out-of-place distances by plain loops. Of equal counts, the gram that comes first in the order of its code: shorter ones first, then by code points."""
    order = lambda g: (len(g), [0 if c == " " else ord(c) for c in g])
    own = sorted(((n, g) for g, n in plain_profile(text, ranks).items()), key=lambda x: (-x[0], order(x[1])))[:ranks]
    if not own:
        return "und", 0.0
    places = {lang: {g: i for i, g in enumerate(grams)} for lang, grams in profiles.items()}
    distances = {lang: sum(min(abs(p[g] - i), ranks) if g in p else ranks for i, (_, g) in enumerate(own)) for lang, p in places.items()}
    best = min(sorted(distances), key=distances.get)
    return best, 1 - distances[best] / (ranks * len(own))


def test_language_against_plain_distances(spark):
    """Learned and predicted by loops over whole texts: the same languages and the same scores."""
    ranks, by_lang = 120, defaultdict(lambda: __import__("collections").Counter())
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 4 = 1").collect()] + [r[:3] for r in odd_rows()]
    import zlib

    for d, text, lang in rows:
        if lang is not None and (d is None or zlib.crc32(str(d).encode()) % 5):
            by_lang[lang].update(plain_profile(text or "", ranks))
    order = lambda g: (len(g), [0 if c == " " else ord(c) for c in g])
    profiles = {lang: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], order(x[0])))[:ranks]] for lang, c in by_lang.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in language.predict(docs, language.learn(docs, max_docs=10**6, ranks=ranks)).collect()}
    assert got == {(d, lang, round(score, 9)) for d, (lang, score) in ((d, plain_prediction(text or "", profiles, ranks)) for d, text, _ in rows)}


def test_language_odd_rows(spark):
    docs = clashing(odd_docs(spark))
    got = {(r.doc_id, r.lang_pred, r.score > 0) for r in language.predict(docs, language.learn(docs)).collect()}
    for d in (3, 4, 5, 9):
        assert (d, "und", False) in got
    assert len([1 for r in language.predict(docs, language.learn(docs)).collect()]) == len(odd_rows())
    nothing = language.predict(docs, language.Profiles({}, 10)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    kept = language.with_language(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} & {3, 4, 5, 9} == set()
    assert language.predict(empty(spark), language.learn(empty(spark))).count() == 0


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_classes(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by_shingle = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by_shingle[x].append(i)
    for i, s in enumerate(sets):
        near = {k for x in s for k in by_shingle[x] if k < i}
        for k in near:
            both = len(s & sets[k])
            if both >= 0.8 * (len(s) + len(sets[k]) - both):
                up[root(i)] = root(k)
    return [root(i) for i in range(len(rows))]


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def near_rows():
    r, rows = random.Random(8), []
    for g in range(25):
        words = [f"w{r.randint(0, 3000)}" for _ in range(r.randint(6, 300))]
        for _ in range(r.choice([1, 1, 2, 3, 40 if g == 3 else 4])):
            own = list(words)
            for _ in range(r.randint(0, max(1, len(words) // 45))):
                own[r.randrange(len(own))] = f"n{r.randint(0, 9999)}"
            rows.append((len(rows), " ".join(own)))
    return rows


def test_near_dedup_against_all_pairs(spark):
    rows = near_rows() + [(1000, None), (1001, ""), (1002, " "), (1003, "one two"), (1004, "One  TWO"), (1005, rows[0][1].upper() if (rows := near_rows()) else "")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in near_dedup.classify(docs).collect()}
    want = plain_classes(rows)
    assert same_partition([got[d].class_id for d, _ in rows], want)
    assert sum(r.kept for r in got.values()) == len(set(want))
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())
    left = near_dedup.without_near_copies(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in got.values() if r.kept)


def test_near_dedup_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    got = {r.doc_id: r.class_id for r in near_dedup.classify(docs).collect()}
    assert same_partition([got[d] for d, _ in rows], plain_classes(rows))


def test_near_copies_that_repeat_passages_differently(spark):
    """Equal sets but for a word, a part of the shingles many times in one text: far apart by the weights."""
    r, rows = random.Random(4), []
    for g in range(120):
        passage, rest = ([f"{c}{r.randint(0, 10**6)}" for _ in range(n)] for c, n in (("p", 60), ("q", 100)))
        other = [*rest[:-1], "changed"]
        rows += [(2 * g, " ".join(passage + passage[:4] + rest)), (2 * g + 1, " ".join(passage * 50 + passage[:4] + other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_dedup.classify(docs).collect()}
    want = plain_classes(rows)
    assert len(set(want)) == 120 and same_partition([got[d] for d, _ in rows], want)


def test_near_copies_with_passages_of_their_own(spark):
    """Shared words, and in each text a passage of its own many times: near by their sets, far by their weights."""
    r, rows = random.Random(7), []
    word = lambda: f"w{r.randint(0, 10**7)}"
    for g in range(40):
        shared = [word() for _ in range(200)]
        rows += [(2 * g + k, " ".join(shared + [word() for _ in range(15)] * 300)) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_dedup.classify(docs).collect()}
    want = plain_classes(rows)
    assert len(set(want)) == 40
    assert sum(got[2 * g] == got[2 * g + 1] for g in range(40)) >= 39 and len(set(got.values())) >= 40


def test_near_dedup_odd_rows(spark):
    got = near_dedup.classify(clashing(odd_docs(spark))).collect()
    assert len(got) == len(odd_rows()) and sum(r.kept for r in got if r.doc_id == 8) == 1
    assert {r.class_id for r in got if r.doc_id in (1, 2, 7)} == {1}
    assert near_dedup.classify(empty(spark)).count() == 0


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(2)
    shared, a, b = (rng.integers(1, 2**63, n).astype(np.uint64) for n in (300, 60, 90))
    wa = {int(x): w for x, w in zip(np.concatenate([shared, a]), rng.uniform(0.5, 4, 360))}
    wb = {int(x): wa.get(int(x), 1.0) * f for x, f in zip(np.concatenate([shared, b]), rng.uniform(0.5, 1.5, 390))}
    exact = 0.0
    for x in wa.keys() & wb.keys():
        exact += 1 / sum(max(wa.get(y, 0) / wa[x], wb.get(y, 0) / wb[x]) for y in wa.keys() | wb.keys())
    doc = np.repeat([0, 1], [len(wa), len(wb)])
    h = np.array([*wa, *wb], np.uint64)
    w = np.array([*wa.values(), *wb.values()])
    z = near_dedup.signatures(doc, h, w, 2, 4096)
    assert abs((z[0] == z[1]).mean() - exact) < 0.03


def test_connected_components(spark):
    r = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randint(0, 80), 100 + r.randint(0, 80)) for _ in range(60)] + [(500, 501), (501, 500)]
    got = {x.node: x.label for x in near_dedup.classes_of(spark.createDataFrame(pairs, "a long, b long")).collect()}
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {i: root(i) for i in got} and set(got) == {i for p in pairs if p[0] != p[1] for i in p}


PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";track(0);</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/x">Home of the site</a></li></ul></nav><!-- ad --><div class="ad">Buy the best of all things in the world and be happy with it for all of your life, now.</div>
%s<aside class="sidebar">The most read of the day and what is in it for you and for us all, said the people who are in the know.</aside>
<form><label>Name</label><input name="q"><button>Send</button></form><div id="comments"><p>I was there and it was not at all like that, said he who is a reader of this and of that.</p></div>
<div class="cookie-notice">We use cookies on this site and you can say no to them if you will, as it is in the law.</div><footer>&copy; 2020 Site</footer></body></html>"""


def test_article():
    body = '<article><h1>Title&amp;more</h1><p>The first <b>part</b> of\n it is &lt;here&gt; and it has a <a href="/y">link</a> in the text of it.<br>More of it.</p><p>Short.</p><ul><li>One</li><li>Two &eacute;t&#233;</li></ul><div class="share">Share this</div><p>Ierchpa oumentvi queon.</article>'
    assert html_text.main_text(PAGE % body) == "Title&more\nThe first part of it is <here> and it has a link in the text of it. More of it.\nShort.\nOne\nTwo été\nIerchpa oumentvi queon."


def test_page_without_article():
    body = "<div><h2>On the house</h2><p>" + "It was the best of the times for all of us and we were in the house with them. " * 4 + "</p><p>It rained.</p><p>" + "And so it was that the man in the house had to be on his way to the river. " * 4 + "</p></div>"
    got = html_text.main_text(PAGE % body).split("\n")
    assert got[0] == "On the house" and got[2] == "It rained." and len(got) == 4


@pytest.mark.parametrize("wrap", ['<div class="content has-sidebar">', '<div id="page" class="with-header">', '<div class="no-comments">', '<div class="sidebar">'])
def test_names_of_wrappers_keep_the_page(wrap):
    article = "<article><h1>Xy</h1><p>It was the best of the times for all of us and we were in the house with them.</p></article>"
    assert html_text.main_text(PAGE % f"{wrap}{article}</div>").startswith("Xy\nIt was") and len(html_text.main_text(PAGE % f"{wrap}{article}</div>").split("\n")) == 2
    if "sidebar" not in wrap.split('"')[1].split():
        text = "<h2>On the house</h2><p>" + "It was the best of the times for all of us and we were in the house with them. " * 4 + "</p>"
        assert html_text.main_text(PAGE % f"{wrap}{text}</div>").startswith("On the house\nIt was")


def test_names_inside_an_article():
    body = '<article><h1>Xy</h1><p>It was the best of the times for all of us and we were in the house with them.</p><h2 id="share-prices-fall">Share prices fall</h2><section id="related-work"><p>Work of <span class="share-price">others</span>.</p></section>%s</article>'
    gone = '<div class="related-posts"><p><a href="/a">One more</a></p></div><div class="comments"><article><p>I was there and it was not at all like that, said he who is a reader of this.</p></article></div>'
    assert html_text.main_text(PAGE % body % gone).split("\n")[2:] == ["Share prices fall", "Work of others."]


UNLISTED = {
    "ru": "Вчера вечером в городе открылась новая библиотека, и жители пришли посмотреть на книги, которые собирали много лет.",
    "pl": "Wczoraj wieczorem otwarto nową bibliotekę, do której mieszkańcy przyszli obejrzeć książki zbierane przez wiele lat.",
    "zh": "昨天晚上城里新开了一家图书馆，居民们纷纷前来参观多年来收集的书籍。" * 3,
}


@pytest.mark.parametrize("lang", UNLISTED)
def test_languages_without_stop_words(lang):
    text = UNLISTED[lang]
    links = "".join(f'<a href="/{i}">{text[:20]}</a> ' for i in range(6))
    html = f"<html><body><nav><a href='/'>{text[:9]}</a></nav><div><p>{text}</p><p>{text[:30]}</p><p>{text}</p></div><div>{links}</div><footer>{text}</footer></body></html>"
    assert html_text.main_text(html).split("\n") == [text, text[:30].strip(), text]


def test_another_script_beside_a_listed_language():
    english = "It was the best of the times for all of us and we were in the house with them. " * 4
    html = f"<html><body><nav><a href='/'>Home</a></nav><p>{english}</p><p>{UNLISTED['ru']}</p><p>{'Lorem keyword stuffing banana printer ' * 3}</p></body></html>"
    assert html_text.main_text(html).split("\n") == [english.strip(), UNLISTED["ru"]]


def test_short_article_stays():
    assert html_text.main_text(PAGE % "<article><h1>Xy</h1><p>Enoipa.</p><p>Auxpa.</p></article>") == "Xy\nEnoipa.\nAuxpa."


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "a < b", "<!-- x", "<script>", "</p></div>", "<p title='x>y", "&amp", "&#xZZ;", "<" * 5000, "<a " * 5000, "<div>" * 3000 + "x", "<p title=\"" * 2000, "<b><i></b></i>", "<script>a</scr"])
def test_broken_pages_end(html):
    assert isinstance(html_text.main_text(html), str)


def plain_blocks(page):
    """Labels by loops: each ambiguous block looks outwards, step by step, for decided ones of its own part."""
    blocks = html_text.blocks_of(page)
    density = html_text.page_density(blocks)
    first = [html_text.first_pass(b, density) for b in blocks]
    out = []
    for i, b in enumerate(blocks):
        if first[i] in ("good", "bad"):
            out.append(first[i])
            continue
        told = [(abs(k - i), first[k], k > i) for k, o in enumerate(blocks) if o.main == b.main and not o.bad and first[k] in ("good", "bad")]
        nearest = [min((t for t in told if t[2] == side), default=None) for side in (False, True)]
        sides = {t[1] for t in nearest if t}
        linked = 2 * b.link > len(b.text)
        if b.main:
            out.append("good" if "good" in sides or not sides and not linked else "bad")
        elif not sides:
            out.append("bad" if linked or "good" in first else "good")
        elif len(sides) == 1:
            out.append(*sides)
        elif nearest[0][0] != nearest[1][0]:
            out.append(min(nearest)[1])
        else:
            out.append("good" if first[i] == "near" or b.heading and nearest[1][1] == "good" else "bad")
    return [b.text for b, label in zip(blocks, out) if label == "good"]


def pages_and_articles(spark):
    import re
    from html import unescape

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        want = [t for part in re.split(r"</?(?:p|h1)>", inner) if (t := " ".join(unescape(re.sub(r"<[^>]*>?", " " if part.startswith("<br") else "", part)).split()))]
        yield r.page_id, r.html, want


def without_article(html):
    return html.replace("<article", "<div").replace("</article", "</div")


def test_blocks_decide_without_article_tags(spark, monkeypatch):
    """With plain div tags for the article, density, links, length and neighbours find its lines, and nothing else; and they do decide."""
    pages = [(without_article(html), want) for _, html, want in pages_and_articles(spark)]
    got = [html_text.main_text(html).split("\n") for html, _ in pages]
    assert got == [plain_blocks(html) for html, _ in pages]
    lines = sum(len(want) for _, want in pages)
    assert sum(len(set(g) & set(w)) for g, (_, w) in zip(got, pages)) >= 0.95 * sum(len(set(w)) for _, w in pages)
    assert sum(len(set(g) - set(w)) for g, (_, w) in zip(got, pages)) == 0 < lines
    monkeypatch.setattr(html_text, "POOR", 0.0)
    assert sum(html_text.main_text(html).split("\n") != g for (html, _), g in zip(pages, got)) > 100


def test_second_pass_against_loops():
    r = random.Random(11)
    english = "It was the best of the times for all of us and we were in the house with them"
    poor = "Lorem keyword stuffing banana printer cartridge cheap brand"
    link = '<a href="/x">' + english[:40] + "</a>"
    for _ in range(400):
        parts = []
        for _ in range(r.randint(1, 14)):
            body = r.choice([english, english * 4, poor, poor * 3, link, link * 3, "Short one", "Short " + link, UNLISTED["ru"], "© 2020 Site"])
            tag = r.choice(["p", "div", "h2", "li", "nav", "article", "section"])
            parts.append(f"<{tag}>{body}</{tag}>" if tag != "article" else f"<article><p>{body}</p><p>{r.choice([english, poor, 'Short'])}</p></article>")
        html = "<html><body>" + "".join(parts) + "</body></html>"
        assert html_text.main_text(html) == "\n".join(plain_blocks(html)), html


def test_poor_blocks_and_their_neighbours():
    english = "It was the best of the times for all of us and we were in the house with them. " * 4
    poor = "Lorem keyword stuffing banana printer cartridge cheap brand " * 3
    page = lambda *parts: "<html><body><nav><a href='/'>Home</a></nav>" + "".join(f"<div>{p}</div>" for p in parts) + "</body></html>"
    assert html_text.main_text(page(english, "Short.", english, "Odd one", poor, "Last", poor)).split("\n") == [english.strip(), "Short.", english.strip()]
    assert html_text.main_text(page("Only", "short lines")).split("\n") == ["Only", "short lines"]
    assert html_text.main_text(page("Menu", "<a href='/a'>One</a> <a href='/b'>Two</a>")) == ""


def test_pages(spark):
    got = {r.page_id: r for r in html_text.extract(clashing(spark.read.parquet(f"{SF}/pages.parquet"))).collect()}
    for page_id, _, want in pages_and_articles(spark):
        assert got[page_id].text == "\n".join(want) and got[page_id].n_chars == len(got[page_id].text)
    nothing = spark.createDataFrame([(1, None, None), (None, "u", "")], "page_id long, url string, html string")
    assert [(r.text, r.n_chars) for r in html_text.extract(nothing).collect()] == [("", 0), ("", 0)]


def test_no_output_files_here():
    assert not Path("spark-warehouse").exists()
