"""Every query of the engine by name, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates as C
from ..operators import drift as D
from ..operators import experiments as X
from ..operators import metrics as M
from ..operators import serving as V
from ..operators import sessions as S
from ..operators import vectors as E
from ..operators.lexical import BM25, tokens
from ..operators.ranking import Ranker
from ..operators.running import quantiles
from ..sources.adapters import basket_events, table, user_events
from ..sources.io import fresh_path, materialise
from ..sources.sessions import coded_events, read_sessions, synthetic_sessions
from . import sql as Q

SAMPLE, TYPES, SYSTEMS = 100, S.TYPES, ("popularity", "covisitation")
QUERIES, ORACLE_SQL = {}, {}


def register(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


class Log:
    """An event table and what queries derive from it. What several parts read is written once, as stored(name)."""

    def __init__(self, spark: SparkSession, sf_dir: str, side: str = "valid", events=user_events) -> None:
        self.spark, self.sf_dir, self.side, self.source, self.tables = spark, sf_dir, side, events, {}

    events = cached_property(lambda self: self.source(self.spark, self.sf_dir))
    meta = cached_property(lambda self: S.sessions_meta(self.events))
    sample = cached_property(lambda self: S.side_of(self.stored("meta"), self.side).where("n_events >= 2"))
    marked = cached_property(lambda self: S.with_history(self.events, self.stored("sample")))
    hist = cached_property(lambda self: S.history(self.stored("marked")))
    truth = cached_property(lambda self: S.ground_truth(self.stored("marked")))
    pop = cached_property(lambda self: C.popularity(self.events))
    pool = cached_property(lambda self: C.popular_pool(self.stored("pop")))
    pairs = cached_property(lambda self: C.covis_pairs(self.events))
    neighbours = cached_property(lambda self: C.covis_neighbours(self.pairs))
    covis = cached_property(lambda self: C.covis_scores(self.hist, self.stored("neighbours")))

    def stored(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = materialise(getattr(self, name), name)
        return self.tables[name]

    candidates = cached_property(lambda self: self.frame(False))

    def kept(self) -> Log:
        """Self, its events written too: for queries that pass over them many times."""
        self.events = self.stored("events")
        return self

    def on(self, side: str) -> Log:
        """The other side of the same events, with what both sides share."""
        other = Log(self.spark, self.sf_dir, side, self.source)
        other.events, other.tables = self.events, {n: self.stored(n) for n in ("meta", "pop", "neighbours")}
        return other

    def frame(self, labelled: bool) -> DataFrame:
        return C.feature_frame(self.stored("marked"), self.stored("sample"), self.stored("pop"), self.stored("neighbours"), labelled=labelled)

    @cached_property
    def ranked(self) -> DataFrame:
        """system, etype, session_code, item, rank of the two systems that need no model."""
        popular = C.rank_popular(self.stored("sample"), self.stored("pop"), self.hist).select(F.lit("popularity").alias("system"), "etype", "session_code", "item", "rank")
        covis = C.rank_by_score(self.candidates, "covis_score", self.hist)
        types = F.explode(F.array(*map(F.lit, TYPES)))
        return popular.unionByName(covis.select(F.lit("covisitation").alias("system"), types.alias("etype"), "session_code", "item", "rank"))

    @cached_property
    def metrics(self) -> DataFrame:
        systems = F.explode(F.array(*map(F.lit, SYSTEMS)))
        return M.session_metrics(self.ranked, self.truth_of(systems), ["system", "etype", "session_code"])

    def truth_of(self, systems) -> DataFrame:
        return self.truth.where(F.col("etype").isin(*TYPES)).select(systems.alias("system"), "etype", "session_code", "item")


def metric_columns() -> list[str]:
    return [f"{n}_{k}" for k in (5, 10, 20) for n in M.NAMES]


BASE = (Q.EV, Q.META, Q.THR)
SIDE = (*BASE, Q.side("valid"), Q.MARKED, Q.HIST)
TRAIN = (*BASE, Q.side("train"), Q.MARKED, Q.HIST, Q.POSITIVES)
GRAPH = (Q.PAIRS, Q.NB, Q.CS)
FULL = (*SIDE, Q.POSITIVES, Q.TRUTH, *GRAPH, Q.POP, Q.POOL, Q.CAND, Q.frame(C.FEATURES, False), Q.REC_POP, Q.REC_COVIS, Q.RANKED, Q.TRUTHS, Q.metrics())


# -- sources and sessions


def _raw(spark: SparkSession, sf_dir: str, nested: bool) -> DataFrame:
    """The event log as newline-delimited JSON, written and read back."""
    events = user_events(spark, sf_dir)
    rows = events.groupBy("session_code").agg(F.array_sort(F.collect_list(F.struct("pos", "item", "ts", "etype"))).alias("e"))
    if nested:
        raw = rows.select(F.col("session_code").alias("session"), F.transform("e", lambda x: F.struct(x["item"].cast("long").alias("aid"), x["ts"].alias("ts"), x["etype"].alias("type"))).alias("events"))
    else:
        raw = rows.select(F.lpad(F.col("session_code").cast("string"), 12, "0").alias("session"), F.col("e.ts").alias("ts"), F.col("e.item").alias("prev_items"), F.col("e.etype").alias("type"))
    path = fresh_path(spark, "raw-log")
    raw.write.json(path)
    return read_sessions(spark, path)


CODED = """SELECT dense_rank() OVER (ORDER BY first_ts, session_code) AS session_code, pos, item, ts, etype FROM (SELECT *, min(ts) FILTER (pos = 1) OVER (PARTITION BY session_code) AS first_ts FROM ev)"""


@register("etl_events_nested", Q.query(Q.EV, select=CODED))
def etl_events_nested(spark, sf_dir):
    return coded_events(_raw(spark, sf_dir, True))


@register("etl_events_parallel", Q.query(Q.EV, select=CODED))
def etl_events_parallel(spark, sf_dir):
    return coded_events(_raw(spark, sf_dir, False))


@register("basket_events", Q.query(Q.BASKETS, select="SELECT etype, count(*) AS n, count(DISTINCT session_code) AS sessions, max(pos) AS longest, sum(ts * pos)::DOUBLE AS checksum FROM ev GROUP BY 1"))
def baskets(spark, sf_dir):
    return basket_events(spark, sf_dir).groupBy("etype").agg(F.count("*").alias("n"), F.countDistinct("session_code").alias("sessions"), F.max("pos").alias("longest"), F.sum((F.col("ts") * F.col("pos")).cast("decimal(38,0)")).cast("double").alias("checksum"))


@register("sessions_meta", Q.query(Q.EV, Q.META, select="SELECT * FROM meta"))
def sessions_meta(spark, sf_dir):
    return Log(spark, sf_dir).meta


@register("temporal_threshold", Q.query(*BASE, select="SELECT round(threshold, 3) AS threshold FROM thr"))
def temporal_threshold(spark, sf_dir):
    return rounded(S.temporal_threshold(Log(spark, sf_dir).meta), "threshold", digits=3)


@register("split_counts", Q.query(*BASE, select="SELECT count(*) FILTER (min_ts < threshold) AS n_train, count(*) FILTER (min_ts >= threshold) AS n_val, min(min_ts) AS min_ts, max(max_ts) AS max_ts, quantile_cont(n_events, 0.5)::DOUBLE AS median_len, max(n_events) AS max_len, sum(n_events)::BIGINT AS n_events FROM meta, thr"))
def split_counts(spark, sf_dir):
    return S.split_counts(Log(spark, sf_dir).meta)


@register("positional_split", Q.query(Q.EV, Q.META, select="SELECT session_code, min_ts, row_number() OVER (ORDER BY min_ts, session_code) <= floor(count(*) OVER () * 0.8) AS is_train FROM meta"))
def positional_split(spark, sf_dir):
    return S.temporal_split(Log(spark, sf_dir).meta.select("session_code", "min_ts"), 0.8, "min_ts", "session_code")


@register("sample_sessions_md5", Q.query(*BASE, Q.side("train"), select=f"SELECT * FROM smp ORDER BY md5(session_code::VARCHAR), session_code LIMIT {SAMPLE}"))
def sample_sessions(spark, sf_dir):
    return S.sample_sessions(Log(spark, sf_dir, "train").sample, SAMPLE)


@register("history_cut", Q.query(*SIDE, select="SELECT session_code, pos, item, ts, etype, is_hist FROM mk"))
def history_cut(spark, sf_dir):
    return Log(spark, sf_dir).marked


@register("positives_graded", Q.query(*TRAIN, select="SELECT * FROM pos"))
def positives_graded(spark, sf_dir):
    return S.positives(Log(spark, sf_dir, "train").marked)


@register("ground_truth", Q.query(*SIDE, Q.TRUTH, select="SELECT * FROM gt"))
def ground_truth(spark, sf_dir):
    return Log(spark, sf_dir).truth


@register("session_context", Q.query(Q.EV, "t AS (SELECT *, CASE WHEN etype IN ('carts', 'orders') THEN etype ELSE 'clicks' END AS kind FROM ev)", "f AS (SELECT session_code, item, min(pos) AS pos FROM ev GROUP BY 1, 2)", select="""
SELECT session_code, items, n_events, n_clicks, n_carts, n_orders, span_ms FROM (SELECT session_code, count(*) AS n_events, count(*) FILTER (kind = 'clicks') AS n_clicks, count(*) FILTER (kind = 'carts') AS n_carts, count(*) FILTER (kind = 'orders') AS n_orders, CASE WHEN count(ts) >= 2 THEN max(ts) - min(ts) ELSE 0 END AS span_ms FROM t GROUP BY 1)
JOIN (SELECT session_code, string_agg(item, ',' ORDER BY pos) AS items FROM f GROUP BY 1) USING (session_code)"""))  # fmt: skip
def session_context(spark, sf_dir):
    return S.session_context(Log(spark, sf_dir).events).withColumn("items", F.array_join("items", ","))


# -- candidates


@register("popularity_windows", Q.query(Q.EV, Q.POP, select="SELECT * FROM pop"))
def popularity_windows(spark, sf_dir):
    return Log(spark, sf_dir).pop


@register("popular_pool", Q.query(Q.EV, Q.POP, Q.POOL, select="SELECT item FROM pool"))
def popular_pool(spark, sf_dir):
    return Log(spark, sf_dir).pool


@register("covis_pairs", Q.query(Q.EV, Q.PAIRS, select="SELECT * FROM pr"))
def covis_pairs(spark, sf_dir):
    return Log(spark, sf_dir).pairs


@register("covis_neighbours", Q.query(Q.EV, Q.PAIRS, Q.NB, select="SELECT * FROM nb"))
def covis_neighbours(spark, sf_dir):
    return Log(spark, sf_dir).neighbours


def _coded_pairs(spark, sf_dir) -> DataFrame:
    """Basket pairs on integer codes: the fixture's items are numbers, so the code is a cast and costs no join."""
    events = basket_events(spark, sf_dir)
    return C.covis_pairs(events.withColumn("code", F.col("item").cast("int")), item="code").select(F.col("i").cast("string").alias("i"), F.col("j").cast("string").alias("j"), "c")


@register("covis_neighbours_baskets", Q.query(Q.BASKETS, Q.PAIRS, Q.NB, select="SELECT * FROM nb"))
def covis_neighbours_baskets(spark, sf_dir):
    return C.covis_neighbours(_coded_pairs(spark, sf_dir))


@register("covis_neighbours_resumed", Q.query(Q.EV, Q.PAIRS, Q.NB, select="SELECT * FROM nb"))
def covis_neighbours_resumed(spark, sf_dir):
    """The graph in two runs: the first writes some buckets, the second the others, and merges all."""
    path, events = fresh_path(spark, "pair-counts"), materialise(Log(spark, sf_dir).events, "events")
    C.write_partial_pairs(events, path, buckets=3, only=[0, 2])
    C.write_partial_pairs(events, path, buckets=3, only=[1])
    return C.merge_partial_pairs(spark, path, 3, f"{path}-merged", parts=2)


@register("covis_stats", Q.query(Q.EV, Q.PAIRS, Q.NB, select="SELECT count(*) AS n_pairs, count(DISTINCT i) AS n_items, sum(weight) AS total FROM nb"))
def covis_stats(spark, sf_dir):
    return Log(spark, sf_dir).neighbours.agg(F.count("*").alias("n_pairs"), F.countDistinct("i").alias("n_items"), F.sum("weight").alias("total"))


@register("covis_session_scores", Q.query(*SIDE, *GRAPH, select="SELECT * FROM cs"))
def covis_session_scores(spark, sf_dir):
    return Log(spark, sf_dir).covis


@register("covis_retrieve", Q.query(*SIDE, Q.PAIRS, Q.NB, select="""
SELECT session_code, item, score, row_number() OVER (PARTITION BY session_code ORDER BY score DESC, item) AS rank FROM (SELECT session_code, j AS item, sum(weight) AS score FROM (SELECT session_code, item FROM mk WHERE is_hist = 1) s JOIN nb ON nb.i = s.item GROUP BY 1, 2) r
WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.session_code = r.session_code AND h.item = r.item) QUALIFY rank <= 100"""))  # fmt: skip
def covis_retrieve(spark, sf_dir):
    log = Log(spark, sf_dir)
    return C.retrieve(log.marked.where("is_hist = 1").select("session_code", "item"), log.neighbours)


@register("candidate_union", Q.query(*SIDE, *GRAPH, Q.POP, Q.POOL, Q.CAND, select="SELECT * FROM cand"))
def candidate_union(spark, sf_dir):
    log = Log(spark, sf_dir)
    return C.candidate_union(log.sample, log.covis, log.pool)


@register("candidate_sources", Q.query(*SIDE, *GRAPH, Q.POP, Q.POOL, Q.CAND, select="SELECT c.session_code, c.item, CASE WHEN cs.item IS NOT NULL THEN 'covisitation' ELSE 'popularity' END AS source FROM cand c LEFT JOIN cs ON cs.session_code = c.session_code AND cs.item = c.item"))
def candidate_sources(spark, sf_dir):
    log = Log(spark, sf_dir)
    return C.candidate_sources(log.sample, log.covis, log.pool)


TRAIN_FRAME = (*TRAIN, *GRAPH, Q.POP, Q.POOL, Q.CAND, Q.frame(C.FEATURES, True))


@register("feature_frame", Q.query(*TRAIN_FRAME, select="SELECT * FROM fr"))
def feature_frame(spark, sf_dir):
    return Log(spark, sf_dir, "train").frame(True)


@register("frame_group_sizes", Q.query(*TRAIN_FRAME, select="SELECT session_code, count(*) AS n_rows FROM fr GROUP BY 1"))
def frame_group_sizes(spark, sf_dir):
    return C.group_sizes(Log(spark, sf_dir, "train").frame(True))


@register("holdout_flag", Q.query(*TRAIN_FRAME, select="SELECT session_code, item, (SELECT count(DISTINCT session_code % 10 = 0) = 2 FROM fr) AND session_code % 10 = 0 AS is_valid FROM fr"))
def holdout_flag(spark, sf_dir):
    return C.holdout(Log(spark, sf_dir, "train").frame(True).select("session_code", "item"))


# -- evaluation


@register("rec_popularity", Q.query(*FULL, select="SELECT * FROM rp"))
def rec_popularity(spark, sf_dir):
    log = Log(spark, sf_dir)
    return C.rank_popular(log.sample, log.pop, log.hist)


@register("rec_covis", Q.query(*FULL, select="SELECT * FROM rc"))
def rec_covis(spark, sf_dir):
    log = Log(spark, sf_dir)
    return C.rank_by_score(log.frame(False), "covis_score", log.hist)


@register("ir_session_metrics", Q.query(*FULL, select=f"SELECT system, etype, session_code, n_rel, {Q.rounded(metric_columns())} FROM sm"))
def ir_session_metrics(spark, sf_dir):
    return rounded(Log(spark, sf_dir).metrics, *metric_columns())


@register("ir_mean_metrics", Q.query(*FULL, select="SELECT system, etype, count(*) AS n_sessions, {} FROM sm GROUP BY 1, 2".format(", ".join(f"round(avg({c}), 6) AS {c}" for c in metric_columns()))))
def ir_mean_metrics(spark, sf_dir):
    return rounded(M.mean_metrics(Log(spark, sf_dir).metrics, ["system", "etype"]), *metric_columns())


@register("ir_macro", Q.query(*FULL, select="SELECT system, round(sum(m) / 3, 6) AS macro_ndcg_20 FROM (SELECT system, etype, avg(ndcg_20) AS m FROM sm GROUP BY 1, 2) GROUP BY 1"))
def ir_macro(spark, sf_dir):
    return rounded(M.macro_average(M.mean_metrics(Log(spark, sf_dir).metrics, ["system", "etype"]), "ndcg_20", ["system"]), "macro_ndcg_20")


@register("weighted_recall20", Q.query(*FULL, select="SELECT system, round(sum(w * m), 6) AS weighted_recall_20 FROM (SELECT system, etype, avg(recall_20) AS m FROM sm GROUP BY 1, 2) JOIN (VALUES ('clicks', 0.10::DOUBLE), ('carts', 0.25::DOUBLE), ('orders', 0.65::DOUBLE)) AS t(etype, w) USING (etype) GROUP BY 1"))
def weighted_recall20(spark, sf_dir):
    return rounded(M.weighted_recall(M.mean_metrics(Log(spark, sf_dir).metrics, ["system", "etype"]), by=["system"]), "weighted_recall_20")


OUTCOMES = "oc AS (SELECT session_code, n_events, {} FROM smp LEFT JOIN sm USING (session_code) GROUP BY 1, 2)".format(
    ", ".join(f"coalesce(max(hit_rate_20) FILTER (system = '{s}' AND etype = '{t}'), 0)::INT AS hit20_{s}_{t}, coalesce(max(recall_20) FILTER (system = '{s}' AND etype = '{t}'), 0) AS recall20_{s}_{t}" for s in SYSTEMS for t in TYPES)
)
ARMS = "ar AS (SELECT session_code, n_events::DOUBLE AS x, CASE WHEN b < 500 THEN 'treatment' ELSE 'control' END AS arm, (CASE WHEN b < 500 THEN hit20_covisitation_clicks ELSE hit20_popularity_clicks END)::DOUBLE AS y FROM (SELECT *, (('0x' || substr(sha256('replay:' || session_code), 1, 16))::UBIGINT % 1000)::INT AS b FROM oc))"
AGG = "ag AS (SELECT count(y) FILTER (arm = 'control') AS n_c, sum(y) FILTER (arm = 'control') AS s_c, avg(y) FILTER (arm = 'control') AS m_c, var_samp(y) FILTER (arm = 'control') AS v_c, count(y) FILTER (arm = 'treatment') AS n_t, sum(y) FILTER (arm = 'treatment') AS s_t, avg(y) FILTER (arm = 'treatment') AS m_t, var_samp(y) FILTER (arm = 'treatment') AS v_t FROM ar)"


def outcomes(spark, sf_dir) -> DataFrame:
    log = Log(spark, sf_dir)
    return materialise(M.session_outcomes(log.metrics, log.stored("sample"), list(SYSTEMS)), "outcomes")


@register("session_outcomes", Q.query(*FULL, OUTCOMES, select="SELECT session_code, n_events, {} FROM oc".format(", ".join(f"hit20_{s}_{t}, round(recall20_{s}_{t}, 6) AS recall20_{s}_{t}" for s in SYSTEMS for t in TYPES))))
def session_outcomes(spark, sf_dir):
    return rounded(outcomes(spark, sf_dir), *(f"recall20_{s}_{t}" for s in SYSTEMS for t in TYPES))


# -- experiments


def arms(spark, sf_dir) -> DataFrame:
    arm = X.assign_arm(F.col("session_code"), salt="replay")
    y = F.when(F.col("arm") == "treatment", F.col("hit20_covisitation_clicks")).otherwise(F.col("hit20_popularity_clicks"))
    return outcomes(spark, sf_dir).withColumn("arm", arm).select("session_code", F.col("n_events").cast("double").alias("x"), "arm", y.cast("double").alias("y"))


@register("arm_assignment", Q.query(Q.EV, select="SELECT session_code, b AS bucket, CASE WHEN b < 500 THEN 'treatment' ELSE 'control' END AS arm FROM (SELECT DISTINCT session_code, (('0x' || substr(sha256('replay:' || session_code), 1, 16))::UBIGINT % 1000)::INT AS b FROM ev)"))
def arm_assignment(spark, sf_dir):
    return Log(spark, sf_dir).events.select("session_code").distinct().select("session_code", X.hash_bucket(F.col("session_code"), "replay").alias("bucket"), X.assign_arm(F.col("session_code"), salt="replay").alias("arm"))


@register("power_inputs", Q.query(*FULL, OUTCOMES, select="SELECT count(*) AS n, round(avg(hit20_popularity_clicks), 6) AS baseline, round(var_samp(hit20_popularity_clicks), 6) AS variance FROM oc"))
def power_inputs(spark, sf_dir):
    y = F.col("hit20_popularity_clicks")
    return rounded(outcomes(spark, sf_dir).agg(F.count("*").alias("n"), F.avg(y).alias("baseline"), F.var_samp(y).alias("variance")), "baseline", "variance")


@register("two_proportion_z", Q.query(*FULL, OUTCOMES, ARMS, AGG, select="SELECT round(m_c, 6) AS rate_control, round(m_t, 6) AS rate_treatment, round(CASE WHEN se > 0 THEN (m_t - m_c) / se ELSE 0 END, 6) AS z FROM (SELECT *, sqrt(p * (1 - p) * (1.0 / n_c + 1.0 / n_t)) AS se FROM (SELECT *, (s_c + s_t) / (n_c + n_t) AS p FROM ag))"))
def two_proportion_z(spark, sf_dir):
    return rounded(X.two_proportion_z(arms(spark, sf_dir), "y"), "rate_control", "rate_treatment", "z")


@register("welch_z", Q.query(*FULL, OUTCOMES, ARMS, AGG, select="SELECT round(m_c, 6) AS mean_control, round(m_t, 6) AS mean_treatment, round(CASE WHEN v_c / n_c + v_t / n_t > 0 THEN (m_t - m_c) / sqrt(v_c / n_c + v_t / n_t) ELSE 0 END, 6) AS z FROM ag"))
def welch_z(spark, sf_dir):
    return rounded(X.welch_z(arms(spark, sf_dir), "y"), "mean_control", "mean_treatment", "z")


@register("cuped_adjusted", Q.query(*FULL, OUTCOMES, ARMS, select="SELECT session_code, arm, round(y - t * (x - m), 6) AS y_adj FROM ar, (SELECT CASE WHEN var_pop(x) > 0 THEN covar_pop(y, x) / var_pop(x) ELSE 0 END AS t, avg(x) AS m FROM ar)"))
def cuped_adjusted(spark, sf_dir):
    return rounded(X.cuped(arms(spark, sf_dir), "y", "x"), "y_adj").select("session_code", "arm", "y_adj")


@register("ab_lift", Q.query(*FULL, OUTCOMES, ARMS, AGG, select="SELECT round(m_c, 6) AS mean_control, round(m_t, 6) AS mean_treatment, round(CASE WHEN m_c > 0 THEN (m_t - m_c) / m_c END, 6) AS lift FROM ag"))
def ab_lift(spark, sf_dir):
    return rounded(X.lift(arms(spark, sf_dir), "y"), "mean_control", "mean_treatment", "lift")


VALUE_ARMS = "va AS (SELECT value AS y, CASE WHEN (('0x' || substr(sha256('values:' || event_id), 1, 16))::UBIGINT % 1000) < 500 THEN 'treatment' ELSE 'control' END AS arm FROM events)"


def value_arms(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("value").alias("y"), X.assign_arm(F.col("event_id"), salt="values").alias("arm"))


@register("mann_whitney_u", Q.query(VALUE_ARMS, select="SELECT count(*) FILTER (arm = 'control') AS n_control, count(*) FILTER (arm = 'treatment') AS n_treatment, sum(r) FILTER (arm = 'treatment') - count(*) FILTER (arm = 'treatment') * (count(*) FILTER (arm = 'treatment') + 1) / 2 AS u, (SELECT sum(n * n * n - n)::BIGINT FROM (SELECT count(*) AS n FROM va GROUP BY y)) AS ties FROM (SELECT arm, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS r FROM va)"))
def mann_whitney_u(spark, sf_dir):
    return X.mann_whitney_u(value_arms(spark, sf_dir), "y")


@register("arm_summary", Q.query(VALUE_ARMS, select=f"SELECT arm, count(y) AS n, {', '.join(f'round({e}, 6) AS {n}' for n, e in (('mean', 'avg(y)'), ('std', 'stddev_samp(y)'), ('median', 'quantile_cont(y, 0.5)'), ('min', 'min(y)'), ('max', 'max(y)')))} FROM va GROUP BY 1"))
def arm_summary(spark, sf_dir):
    return rounded(X.arm_summary(value_arms(spark, sf_dir), "y"), "mean", "std", "median", "min", "max")


@register("ab_test_values")
def ab_test_values(spark, sf_dir):
    r = X.ab_test(value_arms(spark, sf_dir), "y")
    return spark.createDataFrame([(r["test"], float(r["statistic"]), float(r["p_value"]), bool(r["reject_null"]))], "test string, statistic double, p_value double, reject_null boolean")


@register("ab_metrics")
def ab_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("arm", X.assign_arm(F.col("l_orderkey"), salt="lines"))
    told = X.ab_metrics(materialise(rows.select("arm", *DRIFT), "arms"), DRIFT)
    return spark.createDataFrame([(m, r["test"], float(r["mean_control"]), float(r["mean_treatment"]), float(r["p_value"])) for m, r in told.items()], "metric string, test string, mean_control double, mean_treatment double, p_value double")


@register("ab_replay")
def ab_replay(spark, sf_dir):
    r = X.ab_replay(outcomes(spark, sf_dir), "hit20_popularity_clicks", "hit20_covisitation_clicks")
    return spark.createDataFrame([(r["decision"], r["effect"]["lift"], float(r["effect"]["raw_p"]), float(r["effect"]["cuped_p"]))], "decision string, lift double, raw_p double, cuped_p double")


@register("ratio_metrics", "SELECT l_returnflag, round(sum(l_tax) / nullif(sum(l_quantity), 0) * 100, 6) AS conversion_rate, round(sum(l_quantity) / nullif(sum(l_extendedprice), 0) * 100, 6) AS click_rate, round(sum(l_discount) / nullif(sum(l_tax), 0), 6) AS earning_per_purchase FROM lineitem GROUP BY 1")
def ratio_metrics(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*(F.sum(f"l_{c}").alias(c) for c in ("quantity", "extendedprice", "tax", "discount")))
    out = X.ratio_metrics(sums, "quantity", "extendedprice", "tax", "discount").select("l_returnflag", "conversion_rate", "click_rate", "earning_per_purchase")
    return rounded(out, "conversion_rate", "click_rate", "earning_per_purchase")


# -- drift

DRIFT = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
WINDOWED = """lo AS (SELECT name, v, CASE WHEN e <= (SELECT quantile_cont(epoch_us(l_shipdate) // 1000, 0.5) FROM lineitem) THEN 'ref' ELSE 'cur' END AS side FROM (
  {}))""".format(" UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS v, epoch_us(l_shipdate) // 1000 AS e FROM lineitem" for c in DRIFT))
KS = """ks AS (SELECT name, max(n_ref) AS n_ref, max(n_cur) AS n_cur, max(abs(r / n_ref::DOUBLE - c / n_cur::DOUBLE)) AS ks FROM (SELECT name, sum(r) OVER (PARTITION BY name ORDER BY v)::BIGINT AS r, sum(c) OVER (PARTITION BY name ORDER BY v)::BIGINT AS c, sum(r) OVER (PARTITION BY name)::BIGINT AS n_ref, sum(c) OVER (PARTITION BY name)::BIGINT AS n_cur
  FROM (SELECT name, v, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS c FROM lo GROUP BY 1, 2)) GROUP BY name)"""
PSI = """ed AS (SELECT name, list_sort(list_distinct(quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM lo WHERE side = 'ref' GROUP BY 1),
bn AS (SELECT lo.name, side, len(list_filter(list_slice(e, 2, -2), lambda x: x <= v)) AS bin FROM lo JOIN ed USING (name)),
bc AS (SELECT i.name, i.bin, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS c FROM (SELECT name, unnest(range(0, len(e) - 1)) AS bin FROM ed) i LEFT JOIN bn ON bn.name = i.name AND bn.bin = i.bin GROUP BY 1, 2),
ps AS (SELECT name, sum((c - r) * ln(c / r)) AS psi FROM (SELECT name, greatest(r / sum(r) OVER (PARTITION BY name), 1e-6) AS r, greatest(c / sum(c) OVER (PARTITION BY name), 1e-6) AS c FROM bc) GROUP BY 1)"""


def drift_windows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return D.halves(table(spark, sf_dir, "lineitem"), F.unix_millis(F.col("l_shipdate").cast("timestamp")))


def drift_rows(spark, sf_dir) -> DataFrame:
    a, b = drift_windows(spark, sf_dir)
    return D._long(a, DRIFT, "ref").union(D._long(b, DRIFT, "cur"))


@register("ks_statistic", Q.query(WINDOWED, KS, select="SELECT name, n_ref, n_cur, round(ks, 9) AS ks FROM ks"))
def ks_statistic(spark, sf_dir):
    return rounded(D.ks_statistics(drift_rows(spark, sf_dir)), "ks", digits=9)


@register("psi", Q.query(WINDOWED, PSI, select="SELECT name, round(psi, 9) AS psi FROM ps"))
def psi(spark, sf_dir):
    return rounded(D.psi_values(drift_rows(spark, sf_dir)), "psi", digits=9)


@register("drift_summary", Q.query(WINDOWED, KS, PSI, select="SELECT count(*) AS n_columns, round(max(ks), 9) AS max_ks, round(max(psi), 9) AS max_psi, count(*) FILTER (psi >= 0.1) AS n_high_psi FROM ks JOIN ps USING (name)"))
def drift_summary(spark, sf_dir):
    rows = D.drift_columns(*drift_windows(spark, sf_dir), columns=DRIFT)
    return rows.agg(F.count("*").alias("n_columns"), F.round(F.max("ks"), 9).alias("max_ks"), F.round(F.max("psi"), 9).alias("max_psi"), S.count_if(F.col("psi") >= 0.1).alias("n_high_psi"))


@register("drift_detected")
def drift_detected(spark, sf_dir):
    summary = D.drift_summary(*drift_windows(spark, sf_dir))
    return spark.createDataFrame([(c["column"], c["ks"], c["p_value"], c["psi"], c["drift_detected"]) for c in summary["columns"]], "column string, ks double, p_value double, psi double, drift_detected boolean")


@register("percentiles_latency", "SELECT {} FROM events".format(", ".join(f"round(quantile_cont(value, {p}), 6) AS p{int(p * 100)}" for p in (0.5, 0.95, 0.99))))
def percentiles_latency(spark, sf_dir):
    shares = [0.5, 0.95, 0.99]
    return quantiles(table(spark, sf_dir, "events"), [], "value", shares).select(*(F.round(F.col("quantiles")[i], 6).alias(f"p{int(p * 100)}") for i, p in enumerate(shares)))


@register("metrics_unpivot", Q.query(*FULL, select="SELECT system || '.' || etype || '.' || replace(name, '@', '_at_') AS metric, round(value, 6) AS value FROM (UNPIVOT (SELECT system, etype, avg(recall_20) AS \"recall@20\", avg(ndcg_20) AS \"ndcg@20\" FROM sm GROUP BY 1, 2) ON \"recall@20\", \"ndcg@20\" INTO NAME name VALUE value)"))
def metrics_unpivot(spark, sf_dir):
    means = M.mean_metrics(Log(spark, sf_dir).metrics, ["system", "etype"]).select("system", "etype", F.col("recall_20").alias("recall@20"), F.col("ndcg_20").alias("ndcg@20"))
    long = means.unpivot(["system", "etype"], ["recall@20", "ndcg@20"], "name", "value")
    return long.select(F.concat_ws(".", "system", "etype", F.replace("name", F.lit("@"), F.lit("_at_"))).alias("metric"), F.round("value", 6).alias("value"))


@register("request_digest", Q.query(Q.EV, select="""SELECT session_code, substr(sha256('{"h":[' || string_agg('"' || item || '"', ',' ORDER BY pos) || '],"k":20}'), 1, 32) AS digest FROM ev GROUP BY 1"""))
def request_digest(spark, sf_dir):
    return V.request_digest(Log(spark, sf_dir).events)


# -- text and vectors


def _bm25(spark, sf_dir) -> BM25:
    return BM25(table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("tokens")))


TOK = "lambda x: x <> ''"
BM = f"""dt AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), {TOK}) AS tokens FROM documents),
st AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS avgdl FROM dt),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM dt) GROUP BY 1, 2),
df AS (SELECT term, df, ln((n_docs - df + 0.5) / (df + 0.5) + 1) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), st)"""


@register("bm25_stats", Q.query(BM, select="SELECT term, df, round(idf, 9) AS idf FROM df"))
def bm25_stats(spark, sf_dir):
    return rounded(_bm25(spark, sf_dir).df, "idf", digits=9)


@register("bm25_search", Q.query(BM, f"qt AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), {TOK})) AS term FROM benchmark)", select="""
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN df USING (term) JOIN tf USING (term), st GROUP BY 1, 2) WHERE score > 0 QUALIFY rank <= 10"""))  # fmt: skip
def bm25_search(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tokens(F.col("text")).alias("tokens"))
    return rounded(_bm25(spark, sf_dir).search(queries), "score")


def _items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))


def _query_vectors(spark, sf_dir) -> DataFrame:
    """The stated query set of searches: every row whose id is divisible by 50."""
    return _items(spark, sf_dir).where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")


COS = "cm AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings i WHERE q.vec_id % 50 = 0)"


@register("vec_exact_topk", Q.query(COS, select="SELECT query_id, item_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM cm QUALIFY rank <= 10"))
def vec_exact_topk(spark, sf_dir):
    return rounded(E.exact_topk(_query_vectors(spark, sf_dir), _items(spark, sf_dir), 10), "score")


@register("vec_mean_pool", "SELECT label, dim, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT label, unnest(range(0, len(embedding))) AS dim, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2")
def vec_mean_pool(spark, sf_dir):
    return rounded(E.mean_pool(table(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("vec")), "label"), "mean")


@register("vec_l2_to_cosine", Q.query(COS, select="SELECT query_id, item_id, round(score, 6) AS score FROM cm"))
def vec_l2_to_cosine(spark, sf_dir):
    unit = lambda df: df.withColumn("vec", E.normalised(F.col("vec")))
    met = unit(_items(spark, sf_dir)).crossJoin(F.broadcast(unit(_query_vectors(spark, sf_dir)).withColumnRenamed("vec", "q")))
    squared = F.aggregate(F.zip_with("vec", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return met.select("query_id", "item_id", F.round(E.cosine_of_distance(squared), 6).alias("score"))


def _ivf(spark, sf_dir):
    items = _items(spark, sf_dir)
    return E.IvfIndex(items, nlist=32), items


@register("ivf_search")
def ivf_search(spark, sf_dir):
    return _ivf(spark, sf_dir)[0].search(_query_vectors(spark, sf_dir), 10, nprobe=16)


@register("ivf_recall")
def ivf_recall(spark, sf_dir):
    index, items = _ivf(spark, sf_dir)
    queries = _query_vectors(spark, sf_dir)
    return E.recall_against(index.search(queries, 10, nprobe=16), E.exact_topk(queries, items, 10))


@register("item2vec_neighbours")
def item2vec_neighbours(spark, sf_dir):
    vectors = materialise(E.item2vec(Log(spark, sf_dir).events), "item2vec")
    return E.exact_topk(vectors.where("cast(item_id AS int) % 50 = 0").withColumnRenamed("item_id", "query_id"), vectors, 10)


NEXT = "nx AS (SELECT m.session_code, greatest(1, floor(m.n_events * 0.7::DOUBLE)::BIGINT) AS n_history FROM meta m, thr WHERE min_ts >= floor(threshold) AND n_events >= 4)"


def _next_item(log: Log) -> DataFrame:
    return S.next_item_queries(log.events, S.side_of(log.meta, "valid").where("n_events >= 4"))


@register("ann_val_queries", Q.query(*BASE, NEXT, select="SELECT nx.session_code, n_history, item AS target FROM nx JOIN ev ON ev.session_code = nx.session_code AND ev.pos = n_history + 1"))
def ann_val_queries(spark, sf_dir):
    rows = _next_item(Log(spark, sf_dir)).where("is_target")
    return rows.select("session_code", (F.col("pos") - 1).cast("long").alias("n_history"), F.col("item").alias("target"))


@register("ann_next_item_hits")
def ann_next_item_hits(spark, sf_dir):
    log = Log(spark, sf_dir)
    rows, vectors = _next_item(log), materialise(E.item2vec(log.events), "item2vec")
    hist = rows.where("is_hist").select("session_code", F.col("item").alias("item_id"))
    queries = materialise(E.pool_history(hist, vectors), "history-vectors")
    targets = rows.where("is_target").select(F.col("session_code").alias("query_id"), F.col("item").alias("target"))
    systems = {"ann": E.IvfIndex(vectors, nlist=8).search(queries, 100, nprobe=4), "exact": E.exact_topk(queries, vectors, 100)}
    ann, exact = (E.next_item_hits(found, targets).select(F.lit(name).alias("system"), "*") for name, found in systems.items())
    return ann.unionByName(exact)


@register("dense_search")
def dense_search(spark, sf_dir):
    log = Log(spark, sf_dir)
    vectors = materialise(E.item2vec(log.events), "item2vec")
    shop = V.Recommender(log.pop, log.neighbours, index=E.IvfIndex(vectors, nlist=8))
    return shop.search(log.marked.where("is_hist = 1"), vectors, 20, nprobe=4)


@register("synthetic_sessions")
def synthetic(spark, sf_dir):
    return coded_events(synthetic_sessions(spark, sessions=5000, items=500))


# -- ranking


_rankers: dict[tuple[str, str], Ranker] = {}


def _ranker(log: Log) -> Ranker:
    """The ranker of a log, fitted once a session."""
    key = log.spark.sparkContext.applicationId, log.sf_dir
    if key not in _rankers:
        _rankers[key] = Ranker.fit(log.on("train").frame(True))
    return _rankers[key]


def _two_stage(log: Log, frame: DataFrame) -> DataFrame:
    return C.rank_by_score(_ranker(log).score(frame), "score", log.hist)


@register("two_stage_rank")
def two_stage_rank(spark, sf_dir):
    log = Log(spark, sf_dir).kept()
    return _two_stage(log, log.candidates)


@register("two_stage_metrics")
def two_stage_metrics(spark, sf_dir):
    """system, weighted_recall_20, macro_ndcg_20 of all three systems."""
    log = Log(spark, sf_dir).kept()
    types = F.explode(F.array(*map(F.lit, TYPES)))
    # two systems rank the same candidates
    log.candidates = log.stored("candidates")
    ranked = log.ranked.unionByName(_two_stage(log, log.candidates).select(F.lit("two_stage").alias("system"), types.alias("etype"), "session_code", "item", "rank"))
    truth = log.truth_of(F.explode(F.array(*map(F.lit, (*SYSTEMS, "two_stage")))))
    means = materialise(M.mean_metrics(M.session_metrics(ranked, truth, ["system", "etype", "session_code"]), ["system", "etype"]), "means")
    return rounded(M.weighted_recall(means, by=["system"]).join(M.macro_average(means, "ndcg_20", ["system"]), "system"), "weighted_recall_20", "macro_ndcg_20")


@register("ltr_importance")
def ltr_importance(spark, sf_dir):
    return _ranker(Log(spark, sf_dir).kept()).importance(spark)


@register("explain_rows")
def explain_rows(spark, sf_dir):
    log = Log(spark, sf_dir).kept()
    return _ranker(log).explain(log.candidates)


@register("recommend_sessions")
def recommend_sessions(spark, sf_dir):
    log = Log(spark, sf_dir).kept()
    return V.Recommender(log.stored("pop"), log.stored("neighbours"), _ranker(log)).recommend(log.stored("marked").where("is_hist = 1").drop("is_hist"))


@register("placeholder_candidates")
def placeholder_candidates(spark, sf_dir):
    return V.placeholder(Log(spark, sf_dir).meta, "session_code", 20)


