"""Reads: text lines with their places, Markdown ledgers, rule files, file inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, pos, line of each file read whole, so that pos is the place in its file. For files that fit one task."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace(F.regexp_replace("value", r"\r\n?", "\n"), r"\n\z", "").alias("value"))
    return whole.select("path", F.posexplode(F.split("value", "\n")).alias("pos", "line")).select("path", F.col("pos").cast("bigint").alias("pos"), "line")


def contents(spark: SparkSession, path: str) -> DataFrame:
    """path, content: the second channel of a read."""
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), "content")


def rules(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """seq, name, path, bytes, modified of the files below a path, without their contents; seq follows path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    from pyspark.sql import Window

    return files.select(F.row_number().over(Window.orderBy("path")).alias("seq"), F.element_at(F.split("path", "/"), -1).alias("name"), "path", "bytes", "modified")


def folders(spark: SparkSession, path: str) -> DataFrame:
    """Distinct names of the folders that hold files below a path."""
    return inventory(spark, path).select(F.element_at(F.split("path", "/"), -2).alias("name")).distinct()


def ledger(lines_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Totals (bucket, total) and entries (bucket, seq, date, memo, amount: spending is positive) of Markdown ledgers.

    The bucket is the first letter of the file's name. Amounts in the files are signed as shown, spending negative.
    """
    b = lines_.withColumn("bucket", F.upper(F.regexp_extract("path", r"([A-Da-d])[^/]*$", 1)))
    totals = b.where(F.col("line").rlike(r"总额[：:]")).select("bucket", F.regexp_extract("line", r"总额[：:]\s*(-?[0-9.]+)", 1).try_cast("decimal(18,2)").alias("total"))
    cells = F.transform(F.split("line", r"\|"), lambda x: F.trim(x))
    rows = b.where(F.col("line").rlike(r"^\s*\|\s*[0-9]{1,2}/[0-9]{1,2}\s*\|")).select("bucket", F.col("pos").alias("seq"), cells.alias("c"))
    return totals, rows.select("bucket", "seq", F.col("c")[1].alias("date"), F.col("c")[2].alias("memo"), (-F.col("c")[3].try_cast("decimal(18,2)")).cast("decimal(18,2)").alias("amount"))
