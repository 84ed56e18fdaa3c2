"""Task lines ``name--M/D``: parse, derive, rank, summarise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import bands


def keep_task_lines(lines: DataFrame, comments: bool = False) -> DataFrame:
    """Trimmed lines with a delimiter; with ``comments`` lines that begin with # go too. Columns line, pos."""
    lines = lines.withColumn("line", F.trim("line")).where((F.length("line") > 0) & (F.instr("line", "--") > 0))
    return lines.where(~F.startswith("line", F.lit("#"))) if comments else lines


def parse(lines: DataFrame, as_of: Column, dashes: bool = False) -> DataFrame:
    """Add name and deadline (23:59:59 in the year of as_of; null for a bad line).

    The name ends at the first ``--``. Of what follows, only the first chunk between ``--`` counts; of a range ``a~b`` the
    last date. A date is month/day, more parts are ignored; with ``dashes`` month-day is taken too.
    """
    rest = F.expr("substr(line, instr(line, '--') + 2)")
    chunk = F.when(F.instr(rest, "--") > 0, F.split_part(rest, F.lit("--"), F.lit(2))).otherwise(rest)
    date = F.trim(F.element_at(F.split(F.trim(chunk), "~"), -1))
    parts = F.split(date, "[/-]" if dashes else "/")
    number = lambda k: F.try_element_at(parts, F.lit(k)).try_cast("int")
    named = lines.withColumn("name", F.trim(F.substring_index("line", "--", 1)))
    return named.withColumns({"_m": number(1), "_d": number(2)}).withColumn("deadline", F.when(F.col("_m").isNotNull() & F.col("_d").isNotNull(), F.try_make_timestamp_ntz(F.year(as_of), F.col("_m"), F.col("_d"), F.lit(23), F.lit(59), F.lit(59.0)))).drop("_m", "_d")


def good(parsed: DataFrame) -> DataFrame:
    return parsed.where("deadline is not null")


def quarantined(parsed: DataFrame) -> DataFrame:
    return parsed.where("deadline is null")


def derive(tasks: DataFrame, as_of: Column, days_only: bool = False) -> DataFrame:
    """All derived columns of tasks with a deadline."""
    seconds = F.col("during_seconds")
    m = bands.milestones(seconds, as_of, days_only)
    return (
        tasks.withColumn("during_seconds", bands.remaining_seconds(as_of, F.col("deadline")))
        .withColumn("category", bands.band(seconds))
        .withColumns({
            "label": bands.label(F.col("category")),
            "ddl": F.date_format("deadline", "MM/dd HH:mm"),
            "ddl_short": bands.month_day(F.col("deadline")),
            "during_str": bands.remaining_text(seconds),
            "progress": bands.progress(seconds, F.col("category")),
            "node1_date": m.first,
            "node2_date": m.second,
            "node1_formula": m.first_formula,
            "node2_formula": m.second_formula,
            "days_left": F.round(seconds / 86400, 1),
            "hours_left": F.floor(seconds / 3600),
        })
    )


def ranked(tasks: DataFrame, by_name: bool = False) -> DataFrame:
    """Most urgent first, ties in file order; ``by_name`` ties by name. Overdue tasks come first of all."""
    return tasks.orderBy("during_seconds", "name" if by_name else "pos")


def numbered(tasks: DataFrame, *by: str) -> DataFrame:
    """Add the two-digit ordinal in each list; without columns that tell lists apart, all tasks are one list, numbered in one task."""
    return tasks.withColumn("no", bands.ordinal(F.row_number().over(Window.partitionBy(*by).orderBy("during_seconds", "pos"))))


def folded(tasks: DataFrame) -> DataFrame:
    """Add whether a task is overdue, so that a report folds it away from the active ones."""
    return tasks.withColumn("folded", F.col("during_seconds") <= 0)


def counts(tasks: DataFrame) -> DataFrame:
    """One row: tasks of each band and in all."""
    return tasks.agg(*(F.count_if(F.col("category") == c).alias(c) for c in bands.LABELS), F.count("*").alias("total"))


def summary(tasks: DataFrame) -> DataFrame:
    """One row: total, expired, both counts of urgent tasks (all in the band, and those not overdue), the nearest deadline ahead."""
    urgent = F.col("category") == "C"
    return tasks.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("during_seconds") <= 0).alias("expired"),
        F.count_if(urgent).alias("urgent"),
        F.count_if(urgent & (F.col("during_seconds") > 0)).alias("urgent_ahead"),
        F.min(F.when(F.col("during_seconds") > 0, F.col("during_seconds") / 86400)).alias("nearest_days"),
    )


def dedupe_latest(tasks: DataFrame, keys: list[str], latest: list[Column]) -> DataFrame:
    """Of rows with the same keys the one that comes last."""
    w = Window.partitionBy(*keys).orderBy(*(c.desc() for c in latest))
    return tasks.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def todo_lines(lines: DataFrame, as_of: Column, added: DataFrame | None = None) -> DataFrame:
    """A todo list rewritten: comments on top, then the latest entry of each name by date. added lines come after all others."""
    if added is not None:
        last = F.lit((lines.agg(F.max("pos").alias("m")).first()["m"] or 0) + 1)
        lines = lines.select("line", "pos").unionByName(added.select("line", (F.col("pos") + last).alias("pos")))
    comments = lines.where(F.startswith(F.trim("line"), F.lit("#"))).select("line", F.lit(0).alias("_k"), F.lit(None).cast("timestamp_ntz").alias("deadline"), "pos")
    found = dedupe_latest(good(parse(keep_task_lines(lines, comments=True), as_of)), ["name"], [F.col("deadline"), F.col("pos")])
    return comments.unionByName(found.select("line", F.lit(1).alias("_k"), "deadline", "pos")).orderBy("_k", "deadline", "pos").select("line")


def timeline(tasks: DataFrame, hours: str, group: list[str], order: list[str], width_px: float = 1000.0, crowded_px: float = 80.0) -> DataFrame:
    """Add position (0 to 100, logarithmic), side (up, down by turns) and row (a new one after each crowded gap), by group."""
    w = Window.partitionBy(*group)
    by = w.orderBy(hours, *order)
    placed = tasks.withColumn("position", bands.log_position(F.col(hours), F.max(hours).over(w)))
    gap = (F.col("position") - F.lag("position").over(by)) / 100 * width_px
    return (
        placed.withColumn("side", F.when(F.row_number().over(by) % 2 == 1, "up").otherwise("down"))
        .withColumn("_gap", (F.coalesce(gap, F.lit(crowded_px)) < crowded_px).cast("int"))
        .withColumn("row", 1 + F.sum("_gap").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("_gap")
    )


def to_json(tasks: DataFrame) -> DataFrame:
    """One JSON object a task: name, ddl, remaining, category (the label)."""
    return tasks.select(F.to_json(F.struct("name", "ddl", F.col("during_str").alias("remaining"), F.col("label").alias("category"))).alias("json"))


TASKS_DATA = "total_tasks bigint, categories map<string, bigint>, tasks array<struct<during_hours: double, category: string>>"


def read_back(results: DataFrame, urgent: str = "C类", keep: list[str] | None = None) -> DataFrame:
    """Summary of result objects (column value, JSON of TASKS_DATA): the columns to keep, total, expired, both counts of urgent tasks."""
    keep = keep or []
    r = results.select(*keep, F.from_json("value", TASKS_DATA).alias("r")).select(*keep, "r.*")
    late = F.filter("tasks", lambda t: t["during_hours"] <= 0)
    ahead = F.filter("tasks", lambda t: (t["category"] == urgent) & (t["during_hours"] > 0))
    return r.select(*keep, F.col("total_tasks").alias("total"), F.size(late).alias("expired"), F.coalesce(F.try_element_at("categories", F.lit(urgent)), F.lit(0)).alias("urgent"), F.size(ahead).alias("urgent_ahead"))
