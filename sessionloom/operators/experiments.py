"""Experiments: arms, power, tests, variance reduction. Sums are Spark's; closed forms on one row are the driver's."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from .running import running_sums


def hash_bucket(unit: Column, salt: str = "", buckets: int = 1000) -> Column:
    """The first 64 bits of SHA-256 of salt:unit, modulo buckets."""
    if buckets <= 0:
        raise ValueError("buckets must be positive")
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), unit.cast("string")), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % buckets).cast("int")


def assign_arm(unit: Column, fraction: float = 0.5, salt: str = "", buckets: int = 1000, arms: tuple[str, str] = ("control", "treatment")) -> Column:
    """The second arm for the given fraction of units, the first for the rest."""
    if not 0 <= fraction <= 1:
        raise ValueError("the fraction lies between 0 and 1")
    return F.when(hash_bucket(unit, salt, buckets) < fraction * buckets, arms[1]).otherwise(arms[0])


def required_sample_size(baseline: float, mde: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """Units per arm for a two-sided two-proportion test of a relative effect."""
    target = baseline * (1 + mde)
    if not 0 < baseline < 1 or mde <= 0 or not 0 < alpha < 0.5 or not 0 < power < 1 or not 0 < target < 1:
        raise ValueError("rates and power lie between 0 and 1, alpha below a half, and the effect is positive")
    z = NormalDist().inv_cdf
    pooled = (baseline + target) / 2
    spread = z(1 - alpha / 2) * math.sqrt(2 * pooled * (1 - pooled)) + z(power) * math.sqrt(baseline * (1 - baseline) + target * (1 - target))
    return math.ceil((spread / (target - baseline)) ** 2)


def _arms(rows: DataFrame, y: str) -> DataFrame:
    one = lambda arm: F.when(F.col("arm") == arm, F.col(y))
    return rows.agg(*(f(one(a)).alias(f"{n}_{a[0]}") for a in ("control", "treatment") for n, f in (("n", F.count), ("sum", F.sum), ("mean", F.avg), ("var", F.var_samp))))


def two_proportion_z(rows: DataFrame, y: str) -> DataFrame:
    """One row: both rates and the pooled z of rows(arm, y in 0 and 1); no spread: z is 0."""
    p = (F.col("sum_c") + F.col("sum_t")) / (F.col("n_c") + F.col("n_t"))
    se = F.sqrt(p * (1 - p) * (1 / F.col("n_c") + 1 / F.col("n_t")))
    return _arms(rows, y).select(F.col("mean_c").alias("rate_control"), F.col("mean_t").alias("rate_treatment"), F.when(se > 0, (F.col("mean_t") - F.col("mean_c")) / se).otherwise(0.0).alias("z"))


def welch_z(rows: DataFrame, y: str) -> DataFrame:
    se = F.sqrt(F.col("var_c") / F.col("n_c") + F.col("var_t") / F.col("n_t"))
    return _arms(rows, y).select(F.col("mean_c").alias("mean_control"), F.col("mean_t").alias("mean_treatment"), F.when(se > 0, (F.col("mean_t") - F.col("mean_c")) / se).otherwise(0.0).alias("z"))


def two_sided_p(z: float) -> float:
    return 2 * (1 - NormalDist().cdf(abs(z)))


def lift(rows: DataFrame, y: str) -> DataFrame:
    c, t = F.col("mean_c"), F.col("mean_t")
    return _arms(rows, y).select(c.alias("mean_control"), t.alias("mean_treatment"), F.when(c > 0, (t - c) / c).alias("lift"))


def cuped(rows: DataFrame, y: str, x: str) -> DataFrame:
    """rows with y_adj = y - theta (x - mean of x); theta from all arms together; a constant x changes nothing."""
    if len(rows.select(y).limit(2).collect()) < 2:
        raise ValueError("the adjustment needs two units")
    var = F.var_pop(x)
    theta = rows.agg(F.when(var > 0, F.covar_pop(y, x) / var).otherwise(0.0).alias("_theta"), F.avg(x).alias("_mean"))
    return rows.crossJoin(F.broadcast(theta)).withColumn("y_adj", F.col(y) - F.col("_theta") * (F.col(x) - F.col("_mean"))).drop("_theta", "_mean")


def arm_summary(rows: DataFrame, y: str) -> DataFrame:
    """n, mean, std (0 for one unit), median, min, max by arm."""
    return rows.groupBy("arm").agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.coalesce(F.stddev_samp(y), F.lit(0.0)).alias("std"), F.percentile(y, 0.5).alias("median"), F.min(y).alias("min"), F.max(y).alias("max"))


def mann_whitney_u(rows: DataFrame, y: str) -> DataFrame:
    """One row: n_control, n_treatment, u (of treatment), ties (sum of t^3 - t). Ranks come from counts per distinct value."""
    per_value = rows.where(F.col(y).isNotNull()).groupBy(F.col(y).alias("v")).agg(F.count("*").alias("n"), F.count(F.when(F.col("arm") == "treatment", 1)).alias("t"))
    upto = running_sums(per_value, [], "v", {"n": "upto"})
    ranked = upto.withColumn("rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("t") * F.col("rank")).alias("r"), F.sum("t").alias("n_treatment"), F.sum(F.col("n") - F.col("t")).alias("n_control"), F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    return sums.select("n_control", "n_treatment", (F.col("r") - F.col("n_treatment") * (F.col("n_treatment") + 1) / 2).alias("u"), "ties")


def ab_test(rows: DataFrame, y: str, alpha: float = 0.05, normality_sample: int = 5000) -> dict:
    """Shapiro on at most normality_sample units an arm, in MD5 order; normal arms: Levene, then Student's or Welch's t; else Mann-Whitney."""
    rows = rows.where(F.col(y).isNotNull()).select("arm", F.col(y).cast("double").alias("y"))
    a = _arms(rows, "y").first()
    if a["n_c"] < 2 or a["n_t"] < 2:
        raise ValueError("each arm needs two units")
    spread = rows.agg(F.min("y").alias("low"), F.max("y").alias("high")).first()
    means = {"mean_control": a["mean_c"], "mean_treatment": a["mean_t"]}
    if spread["low"] == spread["high"]:
        return means | {"test": "constant_groups", "statistic": 0.0, "p_value": 1.0, "reject_null": False}
    sample = rows.withColumn("_at", F.row_number().over(Window.partitionBy("arm").orderBy(F.md5(F.col("y").cast("string")), "y"))).where(F.col("_at") <= normality_sample)
    arms = {r["arm"]: r["ys"] for r in sample.groupBy("arm").agg(F.collect_list("y").alias("ys")).collect()}
    normal = {arm: stats.shapiro_p(ys) for arm, ys in arms.items()}
    if min(normal.values()) > alpha:
        medians = rows.groupBy("arm").agg(F.percentile("y", 0.5).alias("_m"))
        off = rows.join(F.broadcast(medians), "arm").select("arm", F.abs(F.col("y") - F.col("_m")).alias("z"))
        z = _arms(off, "z").first()
        n, k = a["n_c"] + a["n_t"], (z["n_c"] * z["mean_c"] + z["n_t"] * z["mean_t"]) / (a["n_c"] + a["n_t"])
        within = (z["n_c"] - 1) * z["var_c"] + (z["n_t"] - 1) * z["var_t"]
        w = (n - 2) * (z["n_c"] * (z["mean_c"] - k) ** 2 + z["n_t"] * (z["mean_t"] - k) ** 2) / within if within else 0.0
        equal = stats.f_sf(w, 1, n - 2) > alpha
        statistic, p = stats.t_test(a["mean_t"], a["var_t"], a["n_t"], a["mean_c"], a["var_c"], a["n_c"], equal)
        name = "t_test" if equal else "welch_t_test"
    else:
        u = mann_whitney_u(rows, "y").first()
        statistic, p = stats.mann_whitney(u["u"], u["n_treatment"], u["n_control"], u["ties"])
        name = "mann_whitney_u"
    return means | {"test": name, "statistic": statistic, "p_value": p, "reject_null": p < alpha, "normality": normal}


def ab_metrics(rows: DataFrame, metrics: list[str], alpha: float = 0.05) -> dict[str, dict]:
    """ab_test() of each metric column of rows(arm, ...). Each is tested at alpha on its own."""
    return {m: ab_test(rows, m, alpha) for m in metrics}


def ab_replay(outcomes: DataFrame, control: str, challenger: str, covariate: str = "n_events", salt: str = "replay", alpha: float = 0.05, mde: float = 0.05, p99_ms: float | None = None, budget_ms: float = 50.0) -> dict:
    """Each arm reads its own system's column: control rows `control`, treatment rows `challenger`. Decision: ship, hold or inconclusive."""
    arm = assign_arm(F.col("session_code"), salt=salt)
    rows = outcomes.withColumn("arm", arm).withColumn("y", F.when(F.col("arm") == "treatment", F.col(challenger)).otherwise(F.col(control)).cast("double"))
    raw, adjusted = two_proportion_z(rows, "y").first(), welch_z(cuped(rows, "y", covariate), "y_adj").first()
    sizes = {r["arm"]: r["count"] for r in rows.groupBy("arm").count().collect()}
    rate, moved = raw["rate_control"] or 0.0, (raw["rate_treatment"] or 0.0) - (raw["rate_control"] or 0.0)
    need = required_sample_size(rate, mde, alpha) if 0 < rate and rate * (1 + mde) < 1 else None
    p, safe = two_sided_p(adjusted["z"]), p99_ms is None or p99_ms <= budget_ms
    powered = need is not None and min(sizes.get("control", 0), sizes.get("treatment", 0)) >= need
    decision = "ship" if p < alpha and moved > 0 and safe else "hold" if p < alpha or not safe or powered else "inconclusive"
    effect = {"lift": moved / rate if rate else None, "raw_z": raw["z"], "raw_p": two_sided_p(raw["z"]), "cuped_z": adjusted["z"], "cuped_p": p}
    return {"n": sizes, "effect": effect, "power": {"required": need, "powered": powered}, "hypothesis": ab_test(rows, "y", alpha) if min(sizes.get("control", 0), sizes.get("treatment", 0)) >= 2 else None, "guardrail": {"p99_ms": p99_ms, "ok": safe}, "decision": decision}


def ratio_metrics(rows: DataFrame, clicks: str, impressions: str, purchases: str, earning: str) -> DataFrame:
    """Conversion rate in percent and earning per purchase; null where the divisor is 0."""
    return rows.withColumns({"conversion_rate": F.try_divide(F.col(purchases), F.col(clicks)) * 100, "click_rate": F.try_divide(F.col(clicks), F.col(impressions)) * 100, "earning_per_purchase": F.try_divide(F.col(earning), F.col(purchases))})
