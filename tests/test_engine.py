"""Closed-form cases and hazards of the session engine."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import stats
from sessionloom.operators import candidates as C
from sessionloom.operators import drift as D
from sessionloom.operators import experiments as X
from sessionloom.operators import metrics as M
from sessionloom.operators import sessions as S
from sessionloom.operators import vectors as E
from sessionloom.operators.lexical import BM25
from sessionloom.operators.ranking import Ranker, expected, lambdas, ndcg, tree_shap, tree_values
from sessionloom.operators.running import quantiles, running_sums
from sessionloom.operators.serving import placeholder
from sessionloom.sources.io import dense_codes, flat_metrics, read_tabular
from sessionloom.sources.sessions import coded_events, detect_schema, read_sessions, synthetic_sessions
from sessionloom.streaming.popularity import windowed_popularity

EVENTS = "session_code long, pos int, item string, ts long, etype string"


def test_metrics_closed_form(spark):
    ranked = spark.createDataFrame([("s", i + 1, x) for i, x in enumerate("badec")], "g string, rank int, item string")
    truth = spark.createDataFrame([("s", x) for x in "acf"] + [("none", "z")], "g string, item string")
    got = {r.g: r for r in M.session_metrics(ranked, truth, ["g"], (3,)).collect()}
    s = got["s"]
    assert (s.recall_3, s.precision_3, s.hit_rate_3, s.mrr_3) == (pytest.approx(1 / 3), pytest.approx(1 / 3), 1.0, 0.5)
    assert s.map_3 == pytest.approx(1 / 6) and s.ndcg_3 == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3) + 0.5))
    assert got["none"].recall_3 == got["none"].ndcg_3 == 0.0  # truth without a list counts


def test_weighted_recall(spark):
    means = spark.createDataFrame([("clicks", 0.25), ("carts", 1.0)], "etype string, recall_20 double")
    assert M.weighted_recall(means).first()[0] == pytest.approx(0.275)
    assert M.macro_average(means, "recall_20").first()[0] == pytest.approx(1.25 / 3)


def test_history_cut_rounds_half_up(spark):
    got = [r[0] for r in spark.range(2, 16).select(S.history_cut(F.col("id"))).collect()]
    assert got == [1, 2, 3, 4, 4, 5, 6, 6, 7, 8, 8, 9, 10, 11]


def test_raw_logs(spark, tmp_path):
    nested, parallel, other = (str(tmp_path / n) for n in ("n.json", "p.json", "o.json"))
    open(nested, "w").write("\n".join(json.dumps(x) for x in [{"session": 7, "events": [{"aid": 1, "ts": 5, "type": "clicks"}, {"aid": 2, "ts": 6, "type": "carts"}]}, {"session": 8, "events": []}]))
    open(parallel, "w").write(json.dumps({"session": "x", "ts": [5], "prev_items": ["1", "2"], "type": ["clicks", "carts"]}))
    open(other, "w").write('{"a": 1}')
    assert detect_schema(spark, nested) == "events" and detect_schema(spark, parallel) == "parallel"
    with pytest.raises(ValueError):
        detect_schema(spark, other)
    assert [tuple(r) for r in coded_events(read_sessions(spark, nested)).orderBy("pos").collect()] == [(1, 1, "1", 5, "clicks"), (1, 2, "2", 6, "carts")]
    assert [tuple(r) for r in coded_events(read_sessions(spark, parallel)).orderBy("pos").collect()] == [(1, 1, "1", 5, "clicks"), (1, 2, "2", None, "carts")]
    with pytest.raises(TypeError):
        read_tabular(spark, 3)


def test_dense_codes(spark):
    rows = spark.createDataFrame([(random.Random(i).random(), i) for i in range(200)], "x double, i long")
    got = dense_codes(rows, ["x", "i"], "code").orderBy("x").collect()
    assert [r.code for r in got] == list(range(1, 201))


def test_temporal_split(spark):
    rows = spark.createDataFrame([(300, "c"), (100, "a"), (400, "d"), (200, "b")], "t long, k string")
    assert {r.k for r in S.temporal_split(rows, 0.5, "t", "k").where("is_train").collect()} == {"a", "b"}
    assert S.temporal_split(rows.limit(0), 0.5, "t", "k").count() == 0
    with pytest.raises(ValueError):
        S.temporal_split(rows, 1.0, "t", "k")
    with pytest.raises(KeyError):
        S.temporal_split(rows, 0.5, "no", "k")


@pytest.mark.parametrize("gap", [1, 3, 50])
def test_covis_pairs_against_loops(spark, gap):
    r, rows, want = random.Random(gap), [], {}
    for s in range(6):
        items = [str(r.randint(0, 4)) for _ in range(r.randint(1, 40))]
        rows += [(s, i + 1, x, i, "clicks") for i, x in enumerate(items)]
        for i in range(len(items)):
            for j in range(i + 1, min(len(items), i + gap + 1)):
                want[items[i], items[j]] = want.get((items[i], items[j]), 0) + 1
    got = {(x.i, x.j): x.c for x in C.covis_pairs(spark.createDataFrame(rows, EVENTS), gap).collect()}
    assert got == want and any(i == j for i, j in got)  # an item follows itself


def test_retrieve_counts_repeats_and_drops_history(spark):
    nb = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.0), ("b", "c", 0.5)], "i string, j string, weight double")
    items = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "session_code long, item string")
    assert [(r.item, r.score) for r in C.retrieve(items, nb).collect()] == [("c", 4.5)]


def test_unknown_types(spark):
    e = spark.createDataFrame([(1, 1, "a", 0, "clicks"), (1, 2, "a", 1, "odd")], EVENTS)
    row = C.popularity(e).first()
    assert (row.clicks_all, row.total_all, row.orders_7d) == (1, 2, 0)
    assert S.positives(e.withColumn("is_hist", F.lit(0))).first().label == 1
    ctx = S.session_context(e).first()
    assert (ctx["items"], ctx.n_events, ctx.n_clicks, ctx.span_ms) == (["a"], 2, 2, 1)


def test_bm25(spark):
    docs = spark.createDataFrame([(0, ["red", "shoe", "sale"]), (1, ["blue", "shoe"]), (2, ["red", "hat"])], "doc_id long, tokens array<string>")
    index = BM25(docs)
    q = spark.createDataFrame([(1, ["red", "shoe", "red"]), (2, ["none"]), (3, [])], "query_id long, tokens array<string>")
    got = index.search(q).orderBy("query_id", "rank").collect()
    assert [r.doc_id for r in got if r.query_id == 1][0] == 0 and {r.query_id for r in got} == {1}
    for bad in ({"k1": 0}, {"b": 1.5}):
        with pytest.raises(ValueError):
            BM25(docs, **bad)


def test_vectors(spark):
    items = spark.createDataFrame([(i, [math.cos(i), math.sin(i), 0.1]) for i in range(30)] + [(99, [0.0, 0.0, 0.0])], "item_id long, vec array<double>")
    q = items.where("item_id < 3").withColumnRenamed("item_id", "query_id")
    top = E.exact_topk(q, items, 1).collect()
    assert {(r.query_id, r.item_id) for r in top} == {(0, 0), (1, 1), (2, 2)} and all(r.score == pytest.approx(1) for r in top)
    index = E.IvfIndex(items, nlist=4)
    assert index.exact  # small sets are searched whole
    assert E.recall_against(index.search(q, 5, 1), E.exact_topk(q, items, 5)).first()[0] == 1.0
    eye = [([[1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0]], [0.0, 0, 0])]
    out = items.where("item_id < 2").select(E.tower(eye)("vec").alias("v")).collect()
    assert all(sum(x * x for x in r.v) == pytest.approx(1) for r in out)


def test_assignment_and_power(spark):
    import hashlib

    digest = int.from_bytes(hashlib.sha256(b"salt:42").digest()[:8], "big") % 1000
    assert spark.range(42, 43).select(X.hash_bucket(F.col("id"), "salt")).first()[0] == digest
    arms = spark.range(4000).select(X.assign_arm(F.col("id"), salt="x").alias("a")).groupBy("a").count().collect()
    assert all(abs(r["count"] - 2000) < 200 for r in arms)
    assert spark.range(5).select(X.assign_arm(F.col("id"), 0.0).alias("a")).distinct().first().a == "control"
    assert X.required_sample_size(0.2, 0.05) > X.required_sample_size(0.2, 0.1)
    for bad in ((0, 0.1), (0.2, 0), (0.9, 0.5)):
        with pytest.raises(ValueError):
            X.required_sample_size(*bad)
    with pytest.raises(ValueError):
        X.hash_bucket(F.col("id"), buckets=0)


def test_cuped_keeps_the_mean(spark):
    rows = spark.createDataFrame(list(zip([10.0, 12.0, 13.0, 15.0, 17.0], [1.0, 2.0, 3.0, 4.0, 5.0], [7.0] * 5)), "y double, x double, c double")
    out = X.cuped(rows, "y", "x").agg(F.avg("y_adj").alias("m"), F.var_pop("y_adj").alias("v"), F.var_pop("y").alias("w")).first()
    assert out.m == pytest.approx(13.4) and out.v < 0.1 * out.w
    assert X.cuped(rows, "y", "c").where("y <> y_adj").count() == 0


def two_arms(spark, a, b):
    return spark.createDataFrame([("control", float(v)) for v in a] + [("treatment", float(v)) for v in b], "arm string, y double")


def test_ab_test_paths(spark):
    r = random.Random(0)
    normal = X.ab_test(two_arms(spark, [r.gauss(0, 1) for _ in range(400)], [r.gauss(0.5, 1) for _ in range(400)]), "y")
    assert normal["test"] in ("t_test", "welch_t_test") and normal["reject_null"]
    skewed = X.ab_test(two_arms(spark, [r.lognormvariate(0, 1) for _ in range(500)], [r.lognormvariate(0.5, 1) for _ in range(500)]), "y")
    assert skewed["test"] == "mann_whitney_u" and skewed["reject_null"]
    assert X.ab_test(two_arms(spark, [1] * 5, [1] * 5), "y")["test"] == "constant_groups"
    with pytest.raises(ValueError):
        X.ab_test(two_arms(spark, [1], [1, 2]), "y")


def test_distributions_against_known_values():
    assert stats.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert stats.f_sf(4.965, 1, 10) == pytest.approx(0.05, abs=1e-4)
    assert stats.kolmogorov_sf(1.358) == pytest.approx(0.05, abs=1e-3)
    assert stats.mann_whitney(0.0, 4, 4, 0)[1] == pytest.approx(2 / 70)
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]  # W = 0.79, p = 0.007
    assert stats.shapiro_p(weights) == pytest.approx(0.0067, abs=0.001)
    assert stats.shapiro_p([1, 1, 1, 1]) == 1.0


def test_drift(spark):
    r = random.Random(0)
    ref = spark.createDataFrame([(r.gauss(0, 1), r.gauss(0, 1), "x", int(i % 3 == 0)) for i in range(300)], "a double, b double, tag string, flag int")
    cur = spark.createDataFrame([(r.gauss(0.8, 1), r.gauss(0, 1), "x", 1) for _ in range(300)], "a double, b double, tag string, flag int")
    s = D.drift_summary(ref, cur)
    by = {c["column"]: c for c in s["columns"]}
    assert by["a"]["drift_detected"] and not by["b"]["drift_detected"] and set(by) == {"a", "b", "flag"}
    assert by["flag"]["psi"] == pytest.approx(0, abs=1e-9)  # two values make one bin
    assert D.drift_gate({"drift_share": 0.3}) and not D.drift_gate({"drift_share": 0.31}) and not D.drift_gate({})


def test_running_sums(spark):
    r = random.Random(2)
    rows = [(k, v, r.randint(1, 5)) for k in "ab" for v in r.sample(range(10_000), 300)]
    got = running_sums(spark.createDataFrame(rows, "k string, v long, n long"), ["k"], "v", {"n": "upto"}).collect()
    assert len(got) == 600
    for x in got:
        assert x.upto == sum(n for k, v, n in rows if k == x.k and v <= x.v)


def test_running_sums_are_dealt_evenly(spark, monkeypatch):
    """One outlier, or a heavy tail, doesn't put the other values into one range."""
    from sessionloom.operators import running

    ranges = []
    monkeypatch.setattr(running, "materialise", lambda df, name: ranges.append(df.cache()) or ranges[-1])
    df = spark.range(4000).selectExpr("if(id = 0, 1e15, pow(1.004, id)) AS v", "1L AS n")
    got = running_sums(df, [], "v", {"n": "upto"}).orderBy("v").collect()
    assert [x.upto for x in got] == list(range(1, 4001))
    sizes = sorted(r["count"] for r in ranges[0].groupBy("_at").count().collect())
    assert len(sizes) > 1 and sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_quantiles(spark):
    r = random.Random(4)
    rows = [(k, r.choice([None, r.randint(-50, 50), r.randint(0, 10_000)])) for k in "abc" for _ in range(r.choice([1, 2, 333]))] + [("one", 7)]
    df, shares = spark.createDataFrame(rows, "k string, v long"), [0.0, 0.1, 0.5, 0.8, 1.0]
    want = {x.k: x.q for x in df.where("v IS NOT NULL").groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    got = {x.k: x["quantiles"] for x in quantiles(df, ["k"], "v", shares).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert [x["quantiles"] for x in quantiles(df.where("v IS NULL"), [], "v", [0.5]).collect()] == [[None]]
    assert quantiles(spark.createDataFrame([(1,), (2,), (4,), (9,)], "v long"), [], "v", [0.8]).first()[0] == [pytest.approx(6.0)]


def test_temporal_split_with_null_times(spark):
    r = random.Random(5)
    rows = [(i, r.choice([None, 5, r.randint(0, 10**12)])) for i in range(101)]
    first = {i for i, _ in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[0]))[:70]}
    got = S.temporal_split(spark.createDataFrame(rows, "id long, t long"), 0.7, "t", "id").collect()
    assert len(got) == 101 and {x.id for x in got if x.is_train} == first


def test_tree_shap_adds_up():
    leaf = lambda v, n: {"value": v, "n": n}
    tree = {"feature": 0, "threshold": 0.5, "n": 10, "left": {"feature": 1, "threshold": 2, "n": 6, "left": leaf(1.0, 2), "right": {"feature": 0, "threshold": 0.1, "n": 4, "left": leaf(3.0, 1), "right": leaf(4.0, 3)}}, "right": leaf(7.0, 4)}
    import numpy as np

    x = np.array([[0.0, 1], [0.3, 5], [0.9, 0], [0.05, 3]])
    phi = tree_shap(tree, x, 2)
    assert tree_values(tree, x).tolist() == [1.0, 4.0, 7.0, 3.0]
    assert phi.sum(1) == pytest.approx(tree_values(tree, x) - expected(tree))

    def known(node, row, features):
        """The mean of the leaves that a row reaches where only some features are known."""
        if "value" in node:
            return node["value"]
        if node["feature"] in features:
            return known(node["left"] if row[node["feature"]] <= node["threshold"] else node["right"], row, features)
        return sum(node[c]["n"] * known(node[c], row, features) for c in ("left", "right")) / node["n"]

    for row, own in zip(x, phi):
        first = (known(tree, row, {0}) - known(tree, row, set()) + known(tree, row, {0, 1}) - known(tree, row, {1})) / 2
        assert own[0] == pytest.approx(first)


def test_lambdas_against_pairs():
    import numpy as np

    gains, scores = np.array([0.0, 3, 1, 0, 7]), np.array([0.4, 0.1, -0.2, 0.4, 0.0])
    order = sorted(range(5), key=lambda i: -scores[i])
    d = [1 / math.log2(order.index(i) + 2) for i in range(5)]
    ideal = sum(g / math.log2(r + 2) for r, g in enumerate(sorted(gains, reverse=True)))
    grad, bend = [0.0] * 5, [0.0] * 5
    for i in range(5):
        for j in range(5):
            if gains[i] > gains[j]:
                rho = 1 / (1 + math.exp(scores[i] - scores[j]))
                swap = (gains[i] - gains[j]) * abs(d[i] - d[j]) / ideal
                grad[i], grad[j] = grad[i] + rho * swap, grad[j] - rho * swap
                bend[i], bend[j] = bend[i] + rho * (1 - rho) * swap, bend[j] + rho * (1 - rho) * swap
    got = lambdas(gains, scores)
    assert got[0] == pytest.approx(grad) and got[1] == pytest.approx(bend)
    assert not lambdas(np.zeros(3), np.arange(3.0))[0].any()  # nothing to tell apart
    assert ndcg(gains, gains) == 1.0 and ndcg(np.zeros(2), np.zeros(2)) == 0.0


def test_lambdamart_learns_an_order(spark):
    rng = random.Random(3)
    rows = []
    for s in range(40):
        for i in range(12):
            x = rng.random()
            label = 3 if x > 0.9 else 1 if x > 0.7 else 0
            rows.append((s, f"i{i}", label, *(x if f == "covis_score" else 0.0 for f in C.FEATURES)))
    frame = spark.createDataFrame(rows, "session_code long, item string, label int, " + ", ".join(f"{f} double" for f in C.FEATURES))
    model = Ranker.fit(frame.where("session_code % 10 > 0"), rounds=6, rate=0.5, valid=frame.where("session_code % 10 = 0"), patience=2)
    assert 0 < len(model.trees) <= 6
    assert model.importance(spark).first().feature == "covis_score"
    scored = model.score(frame).select("label", "score").collect()
    mean = lambda v: sum(r.score for r in scored if r.label == v) / max(1, sum(r.label == v for r in scored))
    assert mean(0) < mean(1) < mean(3)
    explained = model.explain(frame.where("session_code = 1")).collect()
    assert all(sum(r.contributions) == pytest.approx(r.score - r.base) for r in explained)
    assert Ranker.fit(frame.where("label = 0"), rounds=1).trees == []


def test_exact_search_in_blocks(spark):
    items = spark.createDataFrame([(i, [math.cos(i * 0.7), math.sin(i * 0.7), i % 3 * 0.2]) for i in range(40)], "item_id long, vec array<double>")
    q = items.withColumnRenamed("item_id", "query_id")
    whole = {tuple(r) for r in E.exact_topk(q, items, 4).select("query_id", "item_id", "rank").collect()}
    assert whole == {tuple(r) for r in E.exact_topk(q, items, 4, block=7).select("query_id", "item_id", "rank").collect()} and len(whole) == 160
    skip = q.select("query_id", F.col("query_id").alias("item_id"))
    rest = E.IvfIndex(items, nlist=64).search(q, 3, 1, skip=skip).collect()
    assert len(rest) == 120 and all(r.query_id != r.item_id for r in rest)


def test_next_item_queries_and_hits(spark):
    e = spark.createDataFrame([(1, p, f"i{p}", p, "clicks") for p in range(1, 6)] + [(2, p, f"j{p}", p, "clicks") for p in range(1, 5)], EVENTS)
    rows = S.next_item_queries(e, S.sessions_meta(e)).collect()
    assert {(r.session_code, r.item) for r in rows if r.is_target} == {(1, "i4"), (2, "j3")}  # 3 of 5, 2 of 4
    targets = spark.createDataFrame([(1, "i4"), (2, "j3")], "query_id long, target string")
    found = spark.createDataFrame([(1, "i4", 11), (1, "x", 1)], "query_id long, item_id string, rank int")
    r = E.next_item_hits(found, targets).first()
    assert (r.n_queries, r.hit_10, r.hit_50) == (2, 0.0, 0.5)


def test_item2vec_has_single_items(spark):
    e = spark.createDataFrame([(s, p, f"i{p}", p, "clicks") for s in range(4) for p in range(1, 5)] + [(9, 1, "i1", 1, "clicks"), (9, 2, "once", 2, "clicks"), (10, 1, "alone", 1, "clicks")], EVENTS)
    got = {r.item_id: r.vec for r in E.item2vec(e, dim=4, partitions=1).collect()}
    assert set(got) == {"i1", "i2", "i3", "i4", "once", "alone"} and all(len(v) == 4 for v in got.values())


def test_synthetic_sessions(spark):
    raw = synthetic_sessions(spark, 400, 50)
    rows = raw.collect()
    assert rows == synthetic_sessions(spark, 400, 50).repartition(3).orderBy(F.col("session").cast("int")).collect()
    assert all(1 <= len(r.ts) <= 60 and r.ts == sorted(r.ts) and len(r.ts) == len(r.prev_items) == len(r.type) for r in rows)
    assert all(1 <= int(i) <= 50 for r in rows for i in r.prev_items)
    clicks = [t == "clicks" for r in rows for t in r.type]
    assert 0.74 < sum(clicks) / len(clicks) < 0.86


def test_placeholder_and_flat_metrics(spark):
    rows = placeholder(spark.createDataFrame([("s",)], "seed string"), "seed", 5).collect()
    assert len(rows) == 5 and rows[0].score == 1.0 and all(r.item.startswith("item_") for r in rows)
    assert flat_metrics({"a": {"recall@20": 1, "x": "t", "b": True}}) == {"a.recall_at_20": 1.0}


def test_windowed_popularity(spark):
    day = 86_400_000
    e = spark.createDataFrame([(1, 1, "a", 0, "clicks"), (1, 2, "a", 8 * day, "orders")], EVENTS)
    got = windowed_popularity(e).where("clicks > 0").collect()
    assert len(got) == 7 and all(r.total == 1 for r in got)


def test_repeated_session_ids_are_sessions_of_their_own(spark, tmp_path):
    path = str(tmp_path / "r.json")
    rows = [{"session": 7, "events": [{"aid": 1, "ts": 5, "type": "clicks"}]}, {"session": 7, "events": [{"aid": 2, "ts": 9, "type": "carts"}]}]
    open(path, "w").write("\n".join(map(json.dumps, rows)))
    assert sorted(tuple(r) for r in coded_events(read_sessions(spark, path)).collect()) == [(1, 1, "1", 5, "clicks"), (2, 1, "2", 9, "carts")]


def test_graph_in_parts(spark, tmp_path):
    r = random.Random(1)
    e = spark.createDataFrame([(s, p, f"i{r.randint(0, 9)}", p, "clicks") for s in range(30) for p in range(1, r.randint(2, 30))], EVENTS)
    path, out = f"{tmp_path}/parts", f"{tmp_path}/merged"
    C.write_partial_pairs(e, path, 3, only=[0, 1])
    with pytest.raises(FileNotFoundError):
        C.merge_partial_pairs(spark, path, 3, out)
    C.write_partial_pairs(e, path, 3, only=[2])
    C.merge_partial_pairs(spark, path, 3, out, parts=2)
    got = C.merge_partial_pairs(spark, path, 3, out, parts=2, start=1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, C.build_co_visitation(e).collect()))


def test_saved_index(spark, tmp_path):
    r = random.Random(2)
    for n in (20, 200):
        items = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(n)], "item_id long, vec array<double>")
        index = E.IvfIndex(items, nlist=4)
        index.save(f"{tmp_path}/{n}")
        queries = items.where("item_id % 7 = 0").withColumnRenamed("item_id", "query_id")
        found = lambda x: sorted((a.query_id, a.item_id, a.rank) for a in x.search(queries, 5, 2).collect())  # noqa: B023, E731
        assert found(E.IvfIndex.load(spark, f"{tmp_path}/{n}")) == found(index)


def test_arguments_are_checked(spark):
    for bad in (lambda: X.assign_arm(F.lit(1), fraction=1.5), lambda: X.required_sample_size(0.1, 0.05, alpha=0.6)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        X.cuped(spark.createDataFrame([(1.0, 2.0)], "y double, x double"), "y", "x")
    arms = [r.arm for r in spark.range(50).select(X.assign_arm(F.col("id"), 0.0, arms=("old", "new")).alias("arm")).collect()]
    assert set(arms) == {"old"}


def test_explain_as_served(spark):
    from sessionloom.operators.serving import Recommender

    e = spark.createDataFrame([(1, 1, "a", 1, "clicks"), (1, 2, "b", 2, "carts"), (2, 1, "a", 3, "clicks")], EVENTS)
    split = {"feature": C.FEATURES.index("covis_score"), "threshold": 0.5, "n": 4, "gain": 1.0, "left": {"value": -1 / 3, "n": 3}, "right": {"value": 1.0, "n": 1}}
    shop = Recommender(C.popularity(e), C.build_co_visitation(e, min_count=1), Ranker([(1.0, split)]))
    one = shop.explain(e, spark.createDataFrame([(1, "b"), (2, "b")], "session_code long, item string")).collect()
    assert {(r.session_code, r.item, r.base, r.score) for r in one} == {(1, "b", 0.0, -0.333333), (2, "b", 0.0, -0.333333)}
    with pytest.raises(KeyError):
        shop.explain(e, spark.createDataFrame([(1, "nowhere")], "session_code long, item string"))


def test_every_query_takes_every_session(spark, monkeypatch):
    from sessionloom.plans import catalogue as Q

    monkeypatch.setattr(Q, "SAMPLE", 3)
    monkeypatch.setattr(Q, "_rankers", {})
    path = "/root/testdata/sf0.01"
    sides = {side: S.side_of(Q.Log(spark, path).meta, side).where("n_events >= 2").count() for side in ("valid", "train")}
    assert min(sides.values()) > 3
    assert Q.QUERIES["dense_search"](spark, path).select("query_id").distinct().count() == sides["valid"]
    assert Q.outcomes(spark, path).count() == sides["valid"]
    frames = []
    monkeypatch.setattr(Q.Ranker, "fit", classmethod(lambda cls, frame: frames.append(frame) or cls([])))
    assert Q.QUERIES["two_stage_rank"](spark, path).select("session_code").distinct().count() == sides["valid"]
    assert frames[0].select("session_code").distinct().count() == sides["train"]
    assert Q.QUERIES["recommend_sessions"](spark, path).select("session_code").distinct().count() == sides["valid"]
    assert Q.QUERIES["history_cut"](spark, path).select("session_code").distinct().count() == sides["valid"]
    assert Q.QUERIES["sample_sessions_md5"](spark, path).count() == 3


def test_every_candidate_is_explained(spark, monkeypatch):
    from sessionloom.plans import catalogue as Q

    path = "/root/testdata/sf0.001"
    leaf = {"value": 1.0, "n": 1.0}
    monkeypatch.setattr(Q.Ranker, "fit", classmethod(lambda cls, frame: cls([(0.1, leaf)])))
    monkeypatch.setattr(Q, "_rankers", {})
    frame = Q.Log(spark, path).frame(False)
    assert frame.where("in_history = 0").count() > 0
    want = sorted(map(tuple, frame.select("session_code", "item").collect()))
    assert sorted((r.session_code, r.item) for r in Q.QUERIES["explain_rows"](spark, path).collect()) == want


def _ranking_frame(spark, sessions, candidates, seed):
    r = random.Random(seed)
    values = r.sample(range(10_000), sessions * candidates)
    rows = [(s, f"i{i:03}", r.choice([0, 0, 1, 2, 3]), *(float(values[s * candidates + i]) if f == "covis_score" else 0.0 for f in C.FEATURES)) for s in range(sessions) for i in range(candidates)]
    return rows, spark.createDataFrame(rows, "session_code long, item string, label int, " + ", ".join(f"{f} double" for f in C.FEATURES))


def test_a_split_is_the_best_of_all(spark):
    import numpy as np

    from sessionloom.operators.ranking import GAINS, _cuts, query_groups

    rows, frame = _ranking_frame(spark, 10, 20, 1)
    at = 3 + C.FEATURES.index("covis_score")
    x, g, h = [], [], []
    for s in range(10):
        mine = [r for r in rows if r[0] == s]
        gradient, curvature = lambdas(np.array([float(GAINS[r[2]]) for r in mine]), np.zeros(20))
        x, g, h = x + [r[at] for r in mine], [*g, *gradient], [*h, *curvature]
    x, g, h = map(np.array, (x, g, h))
    gain = lambda m: g[m].sum() ** 2 / h[m].sum() + g[~m].sum() ** 2 / h[~m].sum() - g.sum() ** 2 / h.sum()
    best = max(x[:], key=lambda t: gain(x <= t) if t < x.max() else 0.0)
    root = Ranker.fit(frame, rounds=1, depth=1).trees[0][1]
    assert root["threshold"] == best and root["gain"] == pytest.approx(gain(x <= best)) and root["left"]["n"] == (x <= best).sum()
    assert root["left"]["value"] == pytest.approx(g[x <= best].sum() / h[x <= best].sum())
    # more values than bins: even shares
    rows, frame = _ranking_frame(spark, 50, 20, 2)
    ends = _cuts(query_groups(frame))[C.FEATURES.index("covis_score")]
    sizes = np.bincount(np.searchsorted(ends, [r[at] for r in rows]))
    assert len(ends) == 255 and 3 <= sizes.min() and sizes.max() <= 4


def test_both_sides_share_the_graph(spark, monkeypatch):
    from sessionloom.plans import catalogue as Q

    calls, own = [], C.covis_pairs
    monkeypatch.setattr(Q, "_rankers", {})
    monkeypatch.setattr(Q.Ranker, "fit", classmethod(lambda cls, frame: cls([])))
    monkeypatch.setattr(C, "covis_pairs", lambda events: calls.append(1) or own(events))
    Q.QUERIES["two_stage_rank"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_explanations_by_pattern(spark):
    """More patterns of agreement than rows, and Arrow batches without a Python row each."""
    import numpy as np

    tree = {"value": 1.0, "n": 1}
    for f in range(9):
        tree = {"feature": f, "threshold": 0.5, "n": tree["n"] + 2, "left": {"value": f / 3, "n": 2}, "right": tree}
    x = np.array([[1.0] * 9, [0.0] * 9, [i % 2 for i in range(9)]])
    assert tree_shap(tree, x, 9).sum(1) == pytest.approx(tree_values(tree, x) - expected(tree))
    frame = spark.createDataFrame([(1, "a", *map(float, range(len(C.FEATURES))))], "session_code long, item string, " + ", ".join(f"{f} double" for f in C.FEATURES))
    told = Ranker([(0.5, tree)]).explain(frame)
    assert "MapInArrow" in told._jdf.queryExecution().toString()
    row = told.first()
    assert sum(row.contributions) == pytest.approx(row.score - row.base) and row.base == pytest.approx(0.5 * expected(tree))


def test_systems_share_the_candidates(spark, monkeypatch):
    from sessionloom.plans import catalogue as Q

    frames, own = [], C.feature_frame
    monkeypatch.setattr(Q, "_rankers", {})
    monkeypatch.setattr(Q.Ranker, "fit", classmethod(lambda cls, frame: cls([])))
    monkeypatch.setattr(C, "feature_frame", lambda *a, **k: frames.append(k["labelled"]) or own(*a, **k))
    assert Q.QUERIES["two_stage_metrics"](spark, "/root/testdata/sf0.001").count() == 3
    assert sorted(frames) == [False, True]


def test_recommendations_score_the_graph_once(spark, monkeypatch):
    from sessionloom.operators import serving as V

    r = random.Random(6)
    e = spark.createDataFrame([(s, p, r.choice([None, *"abcdefghij"]), p, "clicks") for s in range(6) for p in range(1, 9)], EVENTS)
    pop, near, hist = C.popularity(e), C.build_co_visitation(e, min_count=1), S.history(e.withColumn("is_hist", F.lit(1)))
    want = {(x.session_code, x.item): x.source for x in C.candidate_sources(S.sessions_meta(e), C.covis_scores(hist, near, 100), C.popular_pool(pop)).collect()}
    calls, own = [], C.covis_scores
    for module in (C, V):
        monkeypatch.setattr(module, "covis_scores", lambda *a: calls.append(1) or own(*a), raising=False)
    got = V.Recommender(pop, near).recommend(e).collect()
    assert len(calls) == 1 and got and all(x.source == ("ranker" if x.item is None else want[x.session_code, x.item]) for x in got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
