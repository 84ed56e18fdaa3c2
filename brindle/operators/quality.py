"""Checks of inputs: counts, duplicate names, both channels of a read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


def report(lines: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row: non-blank lines, parsed rows, duplicate names, and whether all is well. One count by name, and one over it."""
    total = lines.where(F.length(F.trim("line")) > 0).select(F.lit(True).alias("_line"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("timestamp_ntz").alias("deadline"))
    named = total.unionByName(parsed.select(F.lit(False).alias("_line"), "name", "deadline")).groupBy("_line", "name").agg(F.count("*").alias("n"), F.count("deadline").alias("d"))
    counted = named.agg(
        F.coalesce(F.sum(F.when(F.col("_line"), F.col("n"))), F.lit(0)).alias("lines"), F.coalesce(F.sum(F.when(~F.col("_line"), F.col("d"))), F.lit(0)).alias("parsed"), F.count_if(~F.col("_line") & (F.col("n") > 1)).alias("duplicate_names")
    )
    return counted.withColumn("ok", (F.col("lines") == F.col("parsed")) & (F.col("duplicate_names") == 0))


def same_content(as_lines: DataFrame, as_bytes: DataFrame) -> DataFrame:
    """Per path: lines and bytes of a text read as lines (path, line, pos) and as bytes (path, content), and whether they agree."""
    a = as_lines.groupBy("path").agg(F.count("*").alias("lines"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n"), 256).alias("_a"))
    text = F.regexp_replace(F.regexp_replace(F.decode("content", "UTF-8"), r"\r\n?", "\n"), r"\n\z", "")
    b = as_bytes.select("path", F.length("content").alias("bytes"), F.sha2(text, 256).alias("_b"))
    return a.join(b, "path", "full_outer").select("path", "lines", "bytes", F.col("_a").eqNullSafe(F.col("_b")).alias("same"))
