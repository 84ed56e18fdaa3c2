"""Metrics of evaluation runs: pass rates, regressions, matrices, trends, agreement."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lowest pass rate by level, and the weights of the overall score.
GATES = {"L1": 0.90, "L2": 0.70, "L3": 0.50}
WEIGHTS = (0.4, 0.3, 0.1, 0.1, 0.1)


def pass_rates(results: DataFrame, *by: str) -> DataFrame:
    """Pass rates by each prefix of the columns, from all rows down (a roll-up)."""
    return results.rollup(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.col("pass").cast("int")), 6).alias("pass_rate"))


def layered_gate(results: DataFrame, gates: dict[str, float] = GATES) -> DataFrame:
    least = F.create_map(*(F.lit(x) for g in gates.items() for x in g))[F.col("level")]
    return results.groupBy("level").agg(F.round(F.avg(F.col("pass").cast("int")), 6).alias("pass_rate")).withColumn("gate_ok", F.col("pass_rate") >= least)


def compare_runs(before: DataFrame, now: DataFrame, key: str, drop: float = 0.5) -> DataFrame:
    """Per key of either run (columns key, score): score_before, score_now, change: new, gone, regressed, improved, same."""
    a, b = before.select(key, F.col("score").alias("score_before")), now.select(key, F.col("score").alias("score_now"))
    delta = F.col("score_now") - F.col("score_before")
    change = F.when(F.col("score_before").isNull(), "new").when(F.col("score_now").isNull(), "gone").when(delta < -drop, "regressed").when(delta > drop, "improved").otherwise("same")
    return a.join(b, key, "full_outer").withColumn("change", change)


def matrix(results: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Pass rate of each row by the values of a column."""
    return results.groupBy(row).agg(*(F.round(F.avg(F.when(F.col(column) == v, F.col("pass").cast("int"))), 6).alias(v) for v in values))


def priorities(cells: DataFrame) -> DataFrame:
    """Cells (level, pass_rate) with colour (green from 0.8, yellow from 0.6, else red) and turn: red before yellow before green, then by level."""
    rate = F.col("pass_rate")
    c = cells.withColumn("colour", F.when(rate >= 0.8, "green").when(rate >= 0.6, "yellow").otherwise("red"))
    return c.withColumn("turn", F.struct(F.array_position(F.array(*map(F.lit, ("red", "yellow", "green"))), F.col("colour")).alias("colour"), "level"))


def diversity(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.round(F.countDistinct(value) / F.count(value), 6).alias("diversity"))


def weighted(columns: list[Column], weights: tuple[float, ...] = WEIGHTS) -> Column:
    return sum((c * w for c, w in zip(columns[1:], weights[1:])), columns[0] * weights[0])


def cost_latency(calls: DataFrame, by: list[str], price: float) -> DataFrame:
    return calls.groupBy(*by).agg(F.round(F.sum("tokens") * price, 6).alias("cost"), F.round(F.avg("latency"), 6).alias("mean_latency"))


def pareto(points: DataFrame, by: list[str]) -> DataFrame:
    """Points (cost, quality) that no point of their group beats: at least as good and cheaper, or better and as dear.

    Equal points stay or go together. What is null (group, cost or quality) compares with nothing and stays.
    """
    at = [*by, "cost"]
    unknown = functools.reduce(Column.__or__, (F.col(c).isNull() for c in [*at, "quality"]))
    best = points.where(~unknown).groupBy(*at).agg(F.max("quality").alias("quality"))
    cheaper = F.max("quality").over(Window.partitionBy(*by).orderBy("cost").rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("_best", cheaper).where("_best is null or quality > _best").select(*at, "quality", F.lit(True).alias("_front"))
    return points.join(front, [*at, "quality"], "left").where(F.col("_front") | unknown).select(*points.columns)


def coverage(all_items: DataFrame, covered: DataFrame, key: str, by: list[str]) -> DataFrame:
    hit = covered.select(key).distinct().withColumn("_hit", F.lit(1))
    return all_items.join(hit, key, "left").groupBy(*by).agg(F.round(F.avg(F.coalesce("_hit", F.lit(0))), 6).alias("coverage"))


def falling(series: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows that end three falls in a row."""
    w = Window.partitionBy(*by).orderBy(order)
    v = [F.col(value), *(F.lag(value, k).over(w) for k in (1, 2, 3))]
    return series.withColumn("_f", (v[0] < v[1]) & (v[1] < v[2]) & (v[2] < v[3])).where("_f").drop("_f")


def kappa(ratings: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters, one row; null without disagreement by chance."""
    cells = ratings.groupBy(a, b).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    agreed = cells.withColumn("_t", total).agg(F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("o"), F.first("_t").alias("t"))
    rows, cols = cells.groupBy(F.col(a).alias("v")).agg(F.sum("n").alias("r")), cells.groupBy(F.col(b).alias("v")).agg(F.sum("n").alias("c"))
    chance = rows.join(cols, "v").agg(F.coalesce(F.sum(F.col("r") * F.col("c")), F.lit(0)).alias("e"))
    po, pe = F.col("o") / F.col("t"), F.col("e") / (F.col("t") * F.col("t"))
    return agreed.crossJoin(chance).select(F.round(F.when(pe < 1, (po - pe) / (1 - pe)), 6).alias("kappa"))


def t_test(results: DataFrame, by: list[str], run: str, value: str) -> DataFrame:
    """Welch's t statistic and degrees of freedom of the values of two runs (run is true or false) in each group; null without spread."""
    side = lambda is_run: F.when(F.col(run) == is_run, F.col(value).cast("double"))
    found = results.groupBy(*by).agg(*(f(side(r)).alias(f"{n}{int(r)}") for r in (False, True) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    e0, e1 = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    spread = F.nullif(e0 + e1, F.lit(0.0))
    freedom = spread * spread / F.nullif(e0 * e0 / (F.col("n0") - 1) + e1 * e1 / (F.col("n1") - 1), F.lit(0.0))
    return found.select(*by, ((F.col("m1") - F.col("m0")) / F.sqrt(spread)).alias("t"), freedom.alias("freedom"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
