"""The corpus pipeline, stage by stage and as a whole, against brute force."""

from collections import Counter, defaultdict

import corpus_pipeline
from sessionloom.llm import language
from sessionloom.llm.common import materialise
from sessionloom.llm.encoding import encoder

from .support import SCHEMA, empty, odd_rows, prose
from .test_models import plain_classes
from .test_native import plain_targets


def pipeline_rows():
    rows = odd_rows()
    for i in range(40):
        rows.append((100 + i, prose(i, 60 + i), "en", "abc"[i % 3], 1))
        if i % 4 == 0:
            rows.append((200 + i, prose(i, 60 + i), "en", "abc"[i % 2], 1))  # a copy
        if i % 5 == 0:
            rows.append((300 + i, prose(i, 60 + i) + " more", "en", "abc"[i % 3], 1))  # a near copy
    return rows


def plain_stages(spark, rows):
    """Rows after language, exact and near deduplication; languages as predicted over all rows."""
    docs = spark.createDataFrame(rows, SCHEMA)
    said = {(r.doc_id, r.lang_pred, r.score) for r in language.predict(docs, language.learn(docs)).collect()}
    known = {d for d, lang, score in said if lang != language.UND and score >= language.MIN_SCORE}
    a = [r for r in rows if r[0] in known]
    by_text = defaultdict(list)
    for r in a:
        by_text[r[1]].append(r)
    b = [max(same, key=lambda r: (r[0] is not None, r[0] or 0)) for same in by_text.values()]
    classes = defaultdict(list)
    for r, label in zip(b, plain_classes([(r[0], r[1]) for r in b])):
        classes[label].append(r)
    c = [min(same, key=lambda r: (r[0] is None, r[0] or 0)) for same in classes.values()]
    return a, b, c


def test_run_against_brute_force(spark, tmp_path):
    import public_tokenizers

    rows = pipeline_rows()
    want = plain_stages(spark, rows)
    assert len(rows) > len(want[0]) > len(want[1]) > len(want[2])
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    for (name, stage), left in zip(corpus_pipeline.STAGES, want):
        got = materialise(stage(spark, got, str(tmp_path)), "test-stage")
        assert got.columns == docs.columns
        assert Counter(map(tuple, got.collect())) == Counter(left), name
    mixed = corpus_pipeline.mixing(spark, got, str(tmp_path)).collect()
    words = lambda r: len(r[1].split())
    sizes = Counter()
    for r in want[2]:
        sizes[r[3]] += words(r)
    taken = Counter()
    for r in mixed:
        taken[r[3]] += words(r)
    assert {tuple(r) for r in mixed} <= set(want[2]) and max(Counter(map(tuple, mixed)).values()) <= 3
    for s, target in plain_targets(dict(sizes)).items():
        assert abs(taken[s] - target) <= max(words(r) for r in want[2] if r[3] == s)

    # every mixed row is packed whole, and no two pieces overlap
    tok = encoder(public_tokenizers.path("word_bpe_49k.json"))
    pieces, held = Counter(), defaultdict(list)
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[p.doc_id, p.piece, p.start, p.length] += 1
        held[p.sequence_id].append((p.offset, p.length))
    cut = Counter()
    for r in mixed:
        n = len(tok.encode(r[1])) // 4 + 1
        cut.update((r[0], k, at, min(4096, n - at)) for k, at in enumerate(range(0, n, 4096)))
    assert pieces == cut
    for spans in held.values():
        ends = [0] + [o + n for o, n in sorted(spans)]
        assert ends[-1] <= 4096 and all(o >= e for (o, _), e in zip(sorted(spans), ends))


def test_run_on_an_empty_table(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
