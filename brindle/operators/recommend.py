"""Weighted rule scoring of templates against answers, with top-k and category-diverse choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from brindle.functions.sizes import small

# Lowest and highest difficulty by preference, and team size by context.
DIFFICULTY = {"simple": (1, 4), "moderate": (4, 7), "complex": (7, 10)}
TEAM = {"solo": (1, 1), "small": (2, 6), "medium": (3, 15), "large": (5, 99)}


def _bounds(table: dict[str, tuple[int, int]], key, k: int):
    return F.create_map(*(x for name, pair in table.items() for x in (F.lit(name), F.lit(pair[k]))))[key]


def score(templates: DataFrame, answers: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """Each template for each request with its score. templates is the small side.

    templates: id, categories, difficulty, popularity, is_common, description, best_for, team_lo, team_hi.
    answers: request, scenario, multi_scenario, difficulty_preference, team_context, specific_need.
    """
    return _scored(answers.crossJoin(small(templates)), keywords)


def by_class(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (answers of score(), request being a struct of all that counts) and members (request, class). Equal answers score alike."""
    members = answers.select("request", F.struct(*(c for c in answers.columns if c != "request")).alias("class"))
    classes = members.select("class").distinct()
    return classes.select(F.col("class").alias("request"), "class.*"), members


def nominees(templates: DataFrame, classes: DataFrame, keywords: dict[str, list[str]], k: int = 3) -> DataFrame:
    """The k best of all templates for each class and first category, which are enough for top(), diverse() and low_match().

    Any number of templates is scored, once a class; classes is the small side. A task holds k of each class and category;
    from 128 such groups on (spark.sql.objectHashAggregate.sortBased.fallbackThreshold) Spark sorts the rest of a task's pairs, on disk where need be.
    Columns: request, id, categories, is_common, score.
    """
    score, common = F.col("score"), F.col("is_common")
    # Ascending in what desc(score), desc(is_common), id order by: NaN first, nulls last.
    place = F.struct(score.isNull().alias("a"), (~F.isnan("score")).alias("b"), (-score).alias("c"), common.isNull().alias("d"), (~common).alias("e"), "id", "categories", "is_common", "score")
    scored = _scored(templates.repartition("id").crossJoin(small(classes)), keywords)
    best = scored.groupBy("request", F.element_at("categories", 1)).agg(InternalFunction.collect_top_k(place, k, True).alias("best"))
    return best.select("request", F.explode("best").alias("best")).select("request", *(f"best.{c}" for c in ("id", "categories", "is_common", "score")))


def of_members(chosen: DataFrame, members: DataFrame) -> DataFrame:
    """What was chosen for each class, for each request of the class."""
    return members.join(chosen.withColumnRenamed("request", "class"), "class").drop("class")


def _scored(pairs: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    scenario = F.array_contains("categories", F.col("scenario")) | ((F.col("scenario") == "multiple") & F.arrays_overlap("categories", "multi_scenario"))
    preference = F.col("difficulty_preference")
    in_range = F.col("difficulty").between(_bounds(DIFFICULTY, preference, 0), _bounds(DIFFICULTY, preference, 1))
    team = (F.col("team_lo") <= _bounds(TEAM, F.col("team_context"), 1)) & (F.col("team_hi") >= _bounds(TEAM, F.col("team_context"), 0))
    need = F.lit(False)
    for name, words in keywords.items():
        hit = F.arrays_overlap("best_for", F.array(*map(F.lit, words)))
        for w in words:
            hit = hit | F.contains("description", F.lit(w))
        need = F.when(F.col("specific_need") == name, hit).otherwise(need)
    points = lambda c, n: F.when(c, n).otherwise(0)
    total = points(scenario, 3) + F.when(in_range, 2).when(preference == "any", 1).otherwise(0) + points(team, 1) + points(need, 3) + F.col("popularity") * 0.1 + points(F.col("is_common"), 0.5)
    return pairs.withColumn("score", F.round(total, 6))


def top(scored: DataFrame, k: int = 3) -> DataFrame:
    """The k best of each request: by score, common ones first among equals, then by id."""
    w = Window.partitionBy("request").orderBy(F.desc("score"), F.desc("is_common"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def diverse(scored: DataFrame, k: int = 3) -> DataFrame:
    """The k best, but if all share their first category, the last gives way to the best of another one."""
    w = Window.partitionBy("request").orderBy(F.desc("score"), F.desc("is_common"), "id")
    main = scored.withColumn("_c", F.element_at("categories", 1)).withColumn("rank", F.row_number().over(w))
    first = main.withColumn("_lead", F.first("_c").over(w)).withColumn("_other", F.min(F.when(F.col("_c") != F.col("_lead"), F.col("rank"))).over(Window.partitionBy("request")))
    last = F.when(F.coalesce("_other", F.lit(k)) > k, F.col("_other")).otherwise(k)
    kept = first.where((F.col("rank") < k) | (F.col("rank") == last))
    return kept.withColumn("rank", F.least("rank", F.lit(k))).drop("_c", "_lead", "_other")


def next_questions(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions (question_id, trigger ``key=value`` or null) to ask of each request (request, answers: map)."""
    key, value = F.split_part("trigger", F.lit("="), F.lit(1)), F.split_part("trigger", F.lit("="), F.lit(2))
    return answers.crossJoin(small(questions)).where(F.col("trigger").isNull() | (F.try_element_at("answers", key) == value)).select("request", "question_id")


def low_match(scored: DataFrame, above: float = 3.0) -> DataFrame:
    """Requests whose best score does not exceed the limit."""
    return scored.groupBy("request").agg(F.max("score").alias("best")).where(F.col("best") <= above)
