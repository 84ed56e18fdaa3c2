"""Score gates, audit dashboards, paper admission and plan checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Audit indicators of each of the seven elements.
INDICATORS = {1: 3, 2: 3, 3: 3, 4: 3, 5: 3, 6: 3, 7: 1}


def gates(scores: DataFrame, reliability: int = 9, validity: int = 9, rigor: int = 8) -> DataFrame:
    """Add rigor (the lower of both scores), red (either below its gate), yellow (rigor below its gate) and passed."""
    s = scores.withColumn("rigor", F.least("reliability", "validity"))
    s = s.withColumn("red", (F.col("reliability") < reliability) | (F.col("validity") < validity)).withColumn("yellow", F.col("rigor") < rigor)
    return s.withColumn("passed", ~F.col("red") & ~F.col("yellow"))


def dashboard(gated: DataFrame, by: list[str]) -> DataFrame:
    """Pass rate, red and yellow counts and the weakest element (lowest mean rigor, then lowest number) of each group."""
    part = gated.groupBy(*by, "element").agg(F.count("*").alias("n"), F.count_if("passed").alias("p"), F.count_if("red").alias("r"), F.count_if("yellow").alias("y"), F.avg("rigor").alias("m"))
    return part.groupBy(*by).agg(
        F.round(F.sum("p") / F.sum("n"), 6).alias("pass_rate"), F.sum("r").alias("red"), F.sum("y").alias("yellow"), F.min_by("element", F.struct("m", "element")).alias("weakest")
    )


SCORES = ("channel", "practice", "reliability", "validity", "fit")


def admit(papers: DataFrame, above: int = 40) -> DataFrame:
    return papers.withColumn("total", sum((F.col(c) for c in SCORES[1:]), F.col(SCORES[0]))).where(F.col("total") > above)


def top_papers(papers: DataFrame, by: list[str], order: list[str], k: int = 3) -> DataFrame:
    """At most k admitted papers of each group, highest total first."""
    w = Window.partitionBy(*by).orderBy(F.desc("total"), *order)
    return admit(papers).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def plan_checks(steps: DataFrame) -> DataFrame:
    """Per plan: steps within 3 and 9, a first step of at most 15 minutes, every step's granularity below 3, an unbroken chain.

    steps: plan_id, step, input, output, granularity, minutes; the chain holds if each input is the output before. With a
    column question (whether a step asks one), questions_ok too: at most 3.
    """
    w = Window.partitionBy("plan_id").orderBy("step")
    s = steps.withColumn("_before", F.lag("output").over(w)).withColumn("_n", F.row_number().over(w))
    broken = (F.col("_n") > 1) & ~F.col("input").eqNullSafe(F.col("_before"))
    return s.groupBy("plan_id").agg(
        F.count("*").alias("steps"), F.count("*").between(3, 9).alias("steps_ok"), (F.min_by("minutes", "step") <= 15).alias("first_ok"), F.bool_and(F.col("granularity") < 3).alias("granular_ok"), (F.count_if(broken) == 0).alias("chain_ok"),
        *([(F.count_if("question") <= 3).alias("questions_ok")] if "question" in steps.columns else []),
    )


def quotas(items: DataFrame, quota: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The first quota rows of each class; classes without a quota give none. quota is the small side."""
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.join(quota, by).where("rank <= quota")


def groups_of(items: DataFrame, by: list[str], order: list[str], size: int = 5) -> DataFrame:
    """Number the rows of each class in groups of a fixed size."""
    return items.withColumn("group_no", F.ceil(F.row_number().over(Window.partitionBy(*by).orderBy(*order)) / size))
