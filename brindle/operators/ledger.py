"""Envelope ledgers as events: set totals, post, delete; balances are always derived."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Envelope codes and names.
ENVELOPES = (("A", "生活"), ("B", "学习"), ("C", "储值"), ("D", "消费"))
MONEY = "decimal(18,2)"
POST = r"^(.+?)-(-?[0-9]+(?:\.[0-9]+)?)-([A-Da-d])$"
TOTAL = r"^([A-Da-d]):(-?[0-9]+(?:\.[0-9]+)?)$"


def envelopes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ENVELOPES), "bucket string, envelope string")


def route(commands: DataFrame) -> DataFrame:
    """Tokens of command lines (seq, text): action (total, delete, post, bad), bucket, memo, amount.

    A line may begin with ``money`` or ``money:``; a word ``删除`` (or ``delete``) before entries makes them deletions.
    """
    text = F.regexp_replace(F.trim("text"), r"^money:?\s*", "")
    word = F.posexplode(F.split(text, r"\s+")).alias("place", "token")
    t = commands.select("seq", text.rlike(r"^(删除|删|delete)").alias("_delete"), word).where("token <> ''")
    t = t.where(~F.col("token").isin("删除", "删", "delete"))
    bare = F.regexp_replace("token", r"^(删除|delete)", "")
    total, post = F.col("token").rlike(TOTAL), bare.rlike(POST)
    return t.select(
        "seq",
        "place",
        F.when(total, "total").when(post & F.col("_delete"), "delete").when(post, "post").otherwise("bad").alias("action"),
        F.upper(F.when(total, F.regexp_extract("token", TOTAL, 1)).otherwise(F.regexp_extract(bare, POST, 3))).alias("bucket"),
        F.when(~total, F.regexp_extract(bare, POST, 1)).alias("memo"),
        F.when(total, F.regexp_extract("token", TOTAL, 2)).when(post, F.regexp_extract(bare, POST, 2)).try_cast(MONEY).alias("amount"),
    )


def state(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Totals (bucket, total) and the entries that stand (bucket, seq, place, memo, amount).

    The last total of a bucket counts and clears what came before it; a deletion takes out all equal entries before it.
    """
    at = F.struct("seq", "place")
    totals = actions.where("action = 'total'").groupBy("bucket").agg(F.max_by("amount", at).alias("total"), F.max(at).alias("_set"))
    gone = actions.where("action = 'delete'").groupBy("bucket", "memo", "amount").agg(F.max(at).alias("_gone"))
    posts = actions.where("action = 'post'").join(totals.select("bucket", "_set"), "bucket", "left").join(gone, ["bucket", "memo", "amount"], "left")
    stands = posts.where("(_set is null or struct(seq, place) > _set) and (_gone is null or struct(seq, place) > _gone)")
    return totals.select("bucket", "total"), stands.select("bucket", "seq", "place", "memo", "amount")


def delete(entries: DataFrame, kill: DataFrame) -> DataFrame:
    """Entries without those equal in memo, amount and bucket to a row of kill. Balances after it come from balances()."""
    return entries.join(kill.select("memo", "amount", "bucket"), ["memo", "amount", "bucket"], "left_anti")


def deleted(entries: DataFrame, kill: DataFrame) -> DataFrame:
    """bucket, n: how many entries delete() takes out of each bucket."""
    gone = entries.join(kill.select("memo", "amount", "bucket"), ["memo", "amount", "bucket"], "left_semi")
    return gone.groupBy("bucket").agg(F.count("*").alias("n"))


def balances(entries: DataFrame, totals: DataFrame, order: list[str], by: Sequence[str] = ("bucket",)) -> DataFrame:
    """Add the balance of each bucket after each entry: its total less what was spent so far. by: the columns of a bucket."""
    spent = F.sum("amount").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return entries.join(totals, list(by)).withColumn("balance", (F.col("total") - spent).cast(MONEY)).drop("total")


def cards(entries: DataFrame, totals: DataFrame, buckets: DataFrame) -> DataFrame:
    """One row per envelope, tightest first: total, used, remaining, whether used is shown, whether it is depleted."""
    used = entries.groupBy("bucket").agg(F.sum("amount").alias("used"))
    out = buckets.join(totals, "bucket", "left").join(used, "bucket", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast(MONEY) for c in ("total", "used")}).withColumn("remaining", (F.col("total") - F.col("used")).cast(MONEY))
    return out.withColumn("show_used", (F.col("used") != 0) | (F.col("remaining") != F.col("total"))).withColumn("depleted", F.col("remaining") <= 0).orderBy("remaining", "bucket")


def card_text(found: DataFrame) -> DataFrame:
    line = "+------------------+"
    row = lambda name, c: F.format_string(f"|  {name}：%s    |", F.col(c).cast("string"))
    parts = [F.lit(line), F.format_string("|  %s · %s  |", "bucket", "envelope"), F.lit(line), row("总额", "total"), F.when(F.col("show_used"), row("已用", "used")), row("剩余", "remaining"), F.when(F.col("depleted"), F.lit("|  ⚠️ 已用尽      |")), F.lit(line)]
    return found.select("bucket", "remaining", F.concat_ws("\n", *parts).alias("card"))


def announced(actions: DataFrame, buckets: DataFrame) -> DataFrame:
    """seq, place, line: what is said of each posting and deletion before the cards; spending is shown as negative."""
    named = actions.where(F.col("action").isin("post", "delete")).join(buckets, "bucket", "left")
    signed = F.concat(F.when(F.col("amount") > 0, "-").otherwise("+"), F.abs("amount").cast("string"))
    post = F.concat(F.lit("📝 "), F.col("memo"), F.lit(" · "), F.col("envelope"), F.lit(" "), signed)
    gone = F.concat(F.lit("🗑️ 已删除 · "), F.col("memo"), F.lit(" · "), F.col("envelope"), F.lit(" "), F.col("amount").cast("string"))
    return named.select("seq", "place", F.when(F.col("action") == "post", post).otherwise(gone).alias("line"))


def card_page(found: DataFrame) -> DataFrame:
    """One row, page: the cards of one ledger's envelopes, tightest first, a blank line between them."""
    ordered = F.array_sort(F.collect_list(F.struct("remaining", "bucket", "card")))
    return card_text(found).agg(F.array_join(F.transform(ordered, lambda x: x["card"]), "\n\n").alias("page"))
