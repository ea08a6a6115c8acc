import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sessionloom.llm import packing, token_codes, token_counts
from sessionloom.llm.common import fresh_path
from sessionloom.llm.encoding import WordEncoder

from .support import clashing, empty, odd_docs, odd_rows, prose

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


def ids(library, path, text):
    return library[path].encode(text or "", add_special_tokens=False).ids


TEXTS = [r[1] for r in odd_rows()] + ["It's WE'LL 'sx ''s don''t!'s", "ÀÉÎ ŒUVRE ß ǅ", "à é \x85\xa0b \x1c c", "½² 1234 x²", "Σας ΣΣ", " a　b", "tab\there\r\nline", "ŉ K ſ", "a_b-c__ --!?'"]


def test_encoder_equals_library(library):
    tok = WordEncoder(WORD)
    for text in TEXTS * 2:
        assert np.frombuffer(tok.encode(text), "<u4").tolist() == ids(library, WORD, text), text


def test_encoder_random_characters(library):
    rng, tok = np.random.default_rng(3), WordEncoder(WORD)
    for top in (0x80, 0x180, 0x250, 0x3000):
        for _ in range(200):
            text = "".join(map(chr, rng.integers(1, top, 40)))
            assert np.frombuffer(tok.encode(text), "<u4").tolist() == ids(library, WORD, text), text


def test_counts_equal_library(library):
    counter = token_counts.TokenCounter(BYTE)
    rng = np.random.default_rng(4)
    for text in TEXTS + ["aaaa" * 3000, "  two   spaces \n\n x ", *("".join(map(chr, rng.integers(1, 0x250, 60))) for _ in range(200))]:
        assert counter.count(text) == len(ids(library, BYTE, text)), text


def test_counts_of_characters_that_unicode_versions_class_differently(library):
    counter = token_counts.TokenCounter(BYTE)
    for c in [*range(0x500, 0x600), 0x88F, 0xC5C, 0xCDC, *range(0x2080, 0x20D0), *range(0xA7C0, 0xA7E0), *range(0x1F8A0, 0x1F8B0), *range(0x32390, 0x323A0)]:
        text = f"a{chr(c)}1 {chr(c)}{chr(c)}'s<|endoftext|>{chr(c)}"
        assert counter.count(text) == len(ids(library, BYTE, text)), hex(c)


def test_encoder_equals_library_on_all_documents(library):
    """Both ways give the same ids for every whole text of a table."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    tok = WordEncoder(WORD)
    assert tok.pattern is not None
    fast = 0
    for text in texts:
        fast += bool(text) and not tok.other.search(text)
        assert np.frombuffer(tok.encode(text), "<u4").tolist() == ids(library, WORD, text)
    assert fast > 900


def test_encoder_takes_other_files_by_the_library(library, tmp_path):
    import json

    spec = json.load(open(WORD, encoding="utf-8"))
    for change in ({"normalizer": None}, {"pre_tokenizer": spec["pre_tokenizer"]["pretokenizers"][1]}, {"post_processor": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(spec | change), encoding="utf-8")
        assert WordEncoder(str(path)).pattern is None
    assert WordEncoder(BYTE).pattern is None


def test_shards_follow_the_tokens():
    n = token_codes.shards_for
    assert n(0, 200) == n(10, 200) == 1 and n(10**9, 200) == 200 and n(10**14, 200) == -(-(10**14) // token_codes.SHARD_TOKENS)


def test_codes_round_trip_and_access():
    rng = np.random.default_rng(5)
    for n in (0, 1, 511, 512, 513, 5000):
        for top in (2, 256, 49408, 2**32):
            values = rng.integers(0, top, n).astype(np.uint32)
            codes = token_codes.TokenCodes(token_codes.pack(values))
            assert len(codes) == n and (codes.all() == values).all()
            for i in rng.integers(0, n, 20) if n else ():
                assert codes.access(int(i)) == values[i]


def test_token_codes(spark, library):
    path = fresh_path(spark, "t")
    token_codes.write_tokens(clashing(odd_docs(spark)), path, WORD, end_id=2)
    got = [tuple(r) for r in token_codes.read_documents(spark, path).orderBy("start").collect()]
    want, all_ids = [], []
    for doc, text, *_ in sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        own = [*ids(library, WORD, text), 2]
        want.append((doc, len(all_ids), len(own), zlib.crc32(np.asarray(own, "<u4").tobytes())))
        all_ids += own
    assert got == want
    places = [0, 7, len(all_ids) // 2, len(all_ids) - 1]
    assert {r.position: r.id for r in token_codes.read_tokens(spark, path, places).collect()} == {p: all_ids[p] for p in places}


def test_token_codes_segments(spark, library, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i, 30)) for i in range(50)], "doc_id long, text string")
    path = fresh_path(spark, "t")
    monkeypatch.setattr(token_codes, "TARGET_TOKENS", 100)
    token_codes.write_tokens(docs, path, WORD, end_id=2, partitions=3)
    got = token_codes.read_documents(spark, path).orderBy("doc_id").collect()
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert len(got) == 50


def test_token_counts(spark, library):
    got = token_counts.token_counts(clashing(odd_docs(spark)), BYTE, 1024).collect()
    want = [(d, len((t or "").encode()), n := len(ids(library, BYTE, t)), n > 1024) for d, t, *_ in odd_rows()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[-1][0] + own[-1][1] <= capacity
    return len(bins)


def test_packing(spark, library):
    got = packing.pack_documents(clashing(odd_docs(spark)), WORD).collect()
    check_packing(got, 4096)
    want = []
    for doc, text, *_ in odd_rows():
        own = [*ids(library, WORD, text), 1]
        want += [(doc, k, at, len(p := own[at : at + 4096]), zlib.crc32(np.asarray(p, "<u4").tobytes())) for k, at in enumerate(range(0, len(own), 4096))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("seed", range(12))
def test_plan_against_plain_best_fit(seed):
    """Every piece has a place of its own, and there are no more bins than plain best-fit decreasing needs, but for a few."""
    rng, capacity = np.random.default_rng(seed), 100
    lengths = np.minimum(np.ceil(rng.lognormal(2.5 + seed % 4 * 0.4, 1, 400)).astype(int), capacity)
    counts = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}
    bins = {}
    for n, runs in packing.plan(counts, capacity).items():
        assert runs[0][0] == 0
        for (rank, first, k, offset), end in zip(runs, [r[0] for r in runs[1:]] + [counts[n]]):
            for i in range(end - rank):
                bins.setdefault(first + i // k, []).append((offset + i % k * n, n))
    assert sorted(n for b in bins.values() for _, n in b) == sorted(lengths.tolist())
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[-1][0] + own[-1][1] <= capacity
        assert sum(3 * n > capacity for _, n in own) <= 2
    plain = []
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [i for i, room in enumerate(plain) if room >= n]
        if fits:
            plain[min(fits, key=plain.__getitem__)] -= n
        else:
            plain.append(capacity - n)
    assert len(bins) <= len(plain) + 2


def test_empty(spark):
    path = fresh_path(spark, "t")
    token_codes.write_tokens(empty(spark), path, WORD, 2)
    assert token_codes.read_documents(spark, path).count() == 0
    assert token_counts.token_counts(empty(spark), BYTE, 9).count() == 0
    assert packing.pack_documents(empty(spark), WORD).count() == 0
