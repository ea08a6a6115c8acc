"""Drift between two windows: KS, PSI, a gate and a report."""

from __future__ import annotations

import html as _html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats
from ..sources.io import read_tabular, write_report
from .running import quantiles, running_sums

#: A column has drifted if p is below the first and PSI at least the second.
MAX_P, MIN_PSI = 0.05, 0.1


def numeric_columns(reference: DataFrame, current: DataFrame) -> list[str]:
    """Columns that are numbers (or truth values) on both sides, in the order of the reference."""
    kinds = lambda df: {f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))}
    both = kinds(reference) & kinds(current)
    return [c for c in reference.columns if c in both]


def _long(df: DataFrame, columns: list[str], side: str) -> DataFrame:
    """name, v, side: finite values only."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns]))
    rows = df.select(pairs.alias("x")).select("x.name", "x.v", F.lit(side).alias("side"))
    return rows.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < F.lit(float("inf"))))


def ks_statistics(rows: DataFrame) -> DataFrame:
    """name, n_ref, n_cur, ks of rows(name, v, side); an empty side gives 0."""
    side = lambda s: F.count(F.when(F.col("side") == s, 1))
    per_value = rows.groupBy("name", "v").agg(side("ref").alias("r"), side("cur").alias("c"))
    totals = per_value.groupBy("name").agg(F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"))
    upto = running_sums(per_value, ["name"], "v", {"r": "r_upto", "c": "c_upto"})
    gap = F.when((F.col("n_ref") > 0) & (F.col("n_cur") > 0), F.abs(F.col("r_upto") / F.col("n_ref") - F.col("c_upto") / F.col("n_cur"))).otherwise(0.0)
    return upto.join(totals, "name").groupBy("name").agg(F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"), F.max(gap).alias("ks"))


def psi_values(rows: DataFrame, bins: int = 10) -> DataFrame:
    """name, psi of rows(name, v, side): bins [a, b) between distinct quantiles of the reference, open at both ends. Fewer than two edges: 0."""
    edges = quantiles(rows.where("side = 'ref'"), ["name"], "v", [i / bins for i in range(bins + 1)]).select("name", F.array_distinct("quantiles").alias("edges"))
    inner = edges.select("name", F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0))).alias("inner"), F.size("edges").alias("n_edges"))
    binned = rows.join(inner, "name").select("name", "side", "n_edges", F.size("inner").alias("n_inner"), F.size(F.filter("inner", lambda e: e <= F.col("v"))).alias("bin"))
    side = lambda s: F.count(F.when(F.col("side") == s, 1))
    counts = binned.groupBy("name", "n_edges", "n_inner", "bin").agg(side("ref").alias("r"), side("cur").alias("c"))
    full = inner.select("name", F.explode(F.sequence(F.lit(0), F.size("inner"))).alias("bin"), "n_edges").join(counts.select("name", "bin", "r", "c"), ["name", "bin"], "left").fillna(0, ["r", "c"])
    totals = full.groupBy("name").agg(F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"))
    share = lambda n, total: F.greatest(F.when(F.col(total) > 0, F.col(n) / F.col(total)).otherwise(0.0), F.lit(1e-6))
    r, c = share("r", "n_ref"), share("c", "n_cur")
    terms = F.when((F.col("n_edges") >= 2) & (F.col("n_ref") > 0) & (F.col("n_cur") > 0), (c - r) * F.ln(c / r)).otherwise(0.0)
    return full.join(totals, "name").groupBy("name").agg(F.sum(terms).alias("psi"))


def drift_columns(reference: DataFrame, current: DataFrame, columns: list[str] | None = None, bins: int = 10) -> DataFrame:
    """name, n_ref, n_cur, ks, psi for every numeric column that both have."""
    names = columns or numeric_columns(reference, current)
    rows = _long(reference, names, "ref").union(_long(current, names, "cur"))
    return ks_statistics(rows).join(psi_values(rows, bins), "name")


def drift_summary(reference: DataFrame, current: DataFrame, bins: int = 10) -> dict:
    """Per column and over all: one row per column comes to the driver."""
    out = []
    for r in sorted(drift_columns(reference, current, bins=bins).collect(), key=lambda r: r["name"]):
        p = stats.ks_p(r["ks"], r["n_ref"], r["n_cur"])
        out.append({"column": r["name"], "ks": r["ks"], "p_value": p, "psi": r["psi"], "drift_detected": p < MAX_P and r["psi"] >= MIN_PSI})
    drifted = sum(c["drift_detected"] for c in out)
    return {"n_columns": len(out), "n_drifted": drifted, "drift_share": drifted / len(out) if out else 0.0, "columns": out}


def drift_gate(summary: dict, threshold: float = 0.3) -> bool:
    """Whether the share is within the threshold; a summary without one fails."""
    share = summary.get("drift_share")
    return isinstance(share, (int, float)) and share <= threshold


def drift_report(spark, reference, current, path: str) -> dict:
    """Writes path.json and path.html; reference and current are DataFrames or paths."""
    summary = drift_summary(read_tabular(spark, reference), read_tabular(spark, current))
    write_report(summary, f"{path}.json")
    cells = "".join(f"<tr><td>{_html.escape(c['column'])}</td><td>{c['ks']:.4f}</td><td>{c['psi']:.4f}</td><td>{c['drift_detected']}</td></tr>" for c in summary["columns"])
    with open(f"{path}.html", "w", encoding="utf-8") as f:
        f.write(f"<!doctype html><title>Drift</title><p>{summary['n_drifted']} of {summary['n_columns']} columns</p><table><tr><th>column<th>KS<th>PSI<th>drift</tr>{cells}</table>")
    return summary


def halves(df: DataFrame, order: Column) -> tuple[DataFrame, DataFrame]:
    """The lower and the upper half by a number, cut at its exact median."""
    cut = quantiles(df.select(order.alias("_order")), [], "_order", [0.5]).first()[0][0]
    return df.where(order <= cut), df.where(order > cut)
