"""Queries of the engine's operators on the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import bands
from brindle.operators import evalmetrics, ledger, quality, recommend, router, scorecard, tasks, textcheck
from brindle.plans.registry import query, table
from brindle.sources import sinks
from brindle.streaming import watch

AS_OF = "1998-06-15 20:30:00"


def moment(text: str):
    return F.lit(datetime.datetime.fromisoformat(text)).cast("timestamp_ntz")


#: The band of a column of seconds, in SQL.
BAND_SQL = """CASE WHEN s <= 0 THEN 'expired' WHEN s/3600 < 4 THEN 'critical' WHEN s/86400/7 > 12 THEN 'long_term'
 WHEN s/3600 BETWEEN 4 AND 24 THEN 'C' WHEN s/86400 BETWEEN 1 AND 2 THEN 'C' WHEN s/86400/7 BETWEEN 1 AND 3 THEN 'C'
 WHEN s/86400 > 2 AND s/86400 <= 4 THEN 'B' WHEN s/86400/7 > 3 AND s/86400/7 <= 9 THEN 'B'
 WHEN s/86400 > 4 AND s/86400 <= 7 THEN 'A' WHEN s/86400/7 > 9 AND s/86400/7 <= 12 THEN 'A' ELSE 'out' END"""


def orders_as_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.timestamp_add("SECOND", F.lit(86399), F.col("o_orderdate")).alias("deadline"))


ORDERS_SQL = f"""SELECT o_orderkey, o_custkey, deadline, date_diff('microsecond', TIMESTAMP '{AS_OF}', deadline)/1e6 AS s
 FROM (SELECT o_orderkey, o_custkey, o_orderdate + INTERVAL 86399 SECOND AS deadline FROM orders)"""


@query("q_task_band", f"""WITH t AS (SELECT date_diff('microsecond', TIMESTAMP '{AS_OF}', l_shipdate + INTERVAL 86399 SECOND)/1e6 AS s FROM lineitem)
SELECT {BAND_SQL} AS category, count(*) AS n FROM t GROUP BY 1""")  # fmt: skip
def q_task_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    deadline = F.timestamp_add("SECOND", F.lit(86399), F.col("l_shipdate"))
    s = bands.remaining_seconds(moment(AS_OF), deadline)
    return table(spark, sf_dir, "lineitem").select(bands.band(s).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("q_task_band_subday", f"""WITH t AS (SELECT date_diff('microsecond', TIMESTAMP '2024-01-08', ts)/1e6 AS s FROM events)
SELECT {BAND_SQL} AS category, count(*) AS n FROM t GROUP BY 1""")  # fmt: skip
def q_task_band_subday(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bands.remaining_seconds(moment("2024-01-08 00:00:00"), F.col("ts"))
    return table(spark, sf_dir, "events").select(bands.band(s).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


_DURING = """CASE WHEN w <= 0 THEN '已逝 ' || CASE WHEN a//86400 > 0 THEN (a//86400) || '日' || (a%86400//3600) || '时' WHEN a%86400//3600 > 0 THEN (a%86400//3600) || '时' || (a%3600//60) || '分' ELSE (a%3600//60) || '分' END
 ELSE '余 ' || CASE WHEN a//86400 > 0 THEN (a//86400) || '日' ELSE '' END || CASE WHEN a//86400 > 0 OR a%86400//3600 > 0 THEN (a%86400//3600) || '时' ELSE '' END || (a%3600//60) || '分' END"""
_MD = "month({0}) || '/' || day({0})"


@query("q_task_cards", f"""WITH t AS ({ORDERS_SQL}), b AS (SELECT *, {BAND_SQL} AS category, CAST(trunc(s) AS BIGINT) AS w, abs(CAST(trunc(s) AS BIGINT)) AS a,
 CAST(round_even(s/86400, 0) AS BIGINT) AS d, CAST(round_even(s/86400*24, 0) AS BIGINT) AS h FROM t),
 n AS (SELECT *, CASE WHEN d >= 2 THEN d WHEN h >= 2 THEN h END AS total, CASE WHEN d >= 2 THEN '日' ELSE '时' END AS unit FROM b),
 m AS (SELECT *, CAST(floor(sqrt(total)) AS BIGINT) AS n1, total - CAST(floor(sqrt(total)) AS BIGINT) AS rest FROM n),
 k AS (SELECT *, CASE WHEN rest > 0 THEN CAST(floor(sqrt(rest)) AS BIGINT) ELSE 0 END AS n2, CASE WHEN d >= 2 THEN INTERVAL 1 DAY ELSE INTERVAL 1 HOUR END AS step FROM m),
 x AS (SELECT *, TIMESTAMP '{AS_OF}' + step * CAST(n1 AS INTEGER) AS t1, TIMESTAMP '{AS_OF}' + step * CAST(n1 + n2 AS INTEGER) AS t2 FROM k)
SELECT o_orderkey, category, {_DURING} AS during_str, {_MD.format('deadline')} AS ddl_short,
 round(CASE category WHEN 'expired' THEN 1.0 WHEN 'critical' THEN 0.95 WHEN 'long_term' THEN 0.05 WHEN 'C' THEN greatest(0.7, least(0.9, 1 - s/3600/504)) WHEN 'B' THEN greatest(0.4, least(0.65, 1 - s/3600/1512)) WHEN 'A' THEN greatest(0.15, least(0.35, 1 - s/3600/2016)) ELSE 0.5 END, 6) AS progress,
 CASE WHEN total IS NULL THEN NULL WHEN d >= 2 THEN {_MD.format('t1')} WHEN CAST(t1 AS DATE) = DATE '{AS_OF[:10]}' THEN strftime(t1, '%H:%M') ELSE {_MD.format('t1')} || ' ' || strftime(t1, '%H:%M') END AS node1_date,
 CASE WHEN total IS NULL OR n2 <= 0 THEN NULL WHEN d >= 2 THEN {_MD.format('t2')} WHEN CAST(t2 AS DATE) = DATE '{AS_OF[:10]}' THEN strftime(t2, '%H:%M') ELSE {_MD.format('t2')} || ' ' || strftime(t2, '%H:%M') END AS node2_date,
 '√' || total || CASE WHEN abs(sqrt(total) - n1) < 0.001 THEN ' = ' ELSE ' ≈ ' END || n1 || unit AS node1_formula,
 CASE WHEN n2 > 0 THEN '√' || rest || CASE WHEN abs(sqrt(rest) - n2) < 0.001 THEN ' = ' ELSE ' ≈ ' END || n2 || unit END AS node2_formula FROM x""")  # fmt: skip
def q_task_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tasks.derive(orders_as_tasks(spark, sf_dir), moment(AS_OF))
    return found.select("o_orderkey", "category", "during_str", "ddl_short", F.round("progress", 6).alias("progress"), "node1_date", "node2_date", "node1_formula", "node2_formula")


@query("q_task_next", f"""WITH t AS ({ORDERS_SQL}) SELECT o_custkey, o_orderkey, s AS during_seconds FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey) AS r FROM t WHERE s > 0) WHERE r = 1""")
def q_task_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = orders_as_tasks(spark, sf_dir).withColumn("during_seconds", bands.remaining_seconds(moment(AS_OF), F.col("deadline"))).where("during_seconds > 0")
    return t.groupBy("o_custkey").agg(F.min(F.struct("during_seconds", "o_orderkey")).alias("x")).select("o_custkey", "x.o_orderkey", "x.during_seconds")


@query("q_task_top10", f"""WITH t AS ({ORDERS_SQL}) SELECT o_orderkey, s AS during_seconds FROM t ORDER BY s, o_orderkey LIMIT 10""")
def q_task_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = orders_as_tasks(spark, sf_dir).withColumn("during_seconds", bands.remaining_seconds(moment(AS_OF), F.col("deadline"))).withColumn("pos", F.col("o_orderkey"))
    return tasks.ranked(t).select("o_orderkey", "during_seconds").limit(10)


@query("q_task_summary", f"""WITH t AS ({ORDERS_SQL}), b AS (SELECT s, {BAND_SQL} AS category FROM t)
SELECT count(*) AS total, count(*) FILTER (s <= 0) AS expired, count(*) FILTER (category = 'C') AS urgent, count(*) FILTER (category = 'C' AND s > 0) AS urgent_ahead, round(min(CASE WHEN s > 0 THEN s/86400 END), 6) AS nearest_days FROM b""")
def q_task_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.summary(tasks.derive(orders_as_tasks(spark, sf_dir), moment(AS_OF))).withColumn("nearest_days", F.round("nearest_days", 6))


@query("q_task_tiles", f"""WITH t AS ({ORDERS_SQL}), b AS (SELECT {BAND_SQL} AS c FROM t) SELECT {', '.join(f"count(*) FILTER (c = '{c}') AS {c}" for c in bands.LABELS)}, count(*) AS total FROM b""")
def q_task_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.counts(tasks.derive(orders_as_tasks(spark, sf_dir), moment(AS_OF)))


@query("q_task_left", f"""WITH t AS ({ORDERS_SQL}) SELECT o_orderkey, round(s/86400, 1) AS days_left, CAST(floor(s/3600) AS BIGINT) AS hours_left, s <= 0 AS folded FROM t""")
def q_task_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.folded(tasks.derive(orders_as_tasks(spark, sf_dir), moment(AS_OF))).select("o_orderkey", "days_left", "hours_left", "folded")


@query("q_task_by_name", f"""WITH t AS ({ORDERS_SQL}) SELECT o_orderkey, o_custkey, s AS during_seconds FROM t ORDER BY s, 'c' || o_custkey, o_orderkey LIMIT 25""")
def q_task_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = orders_as_tasks(spark, sf_dir).withColumn("during_seconds", bands.remaining_seconds(moment(AS_OF), F.col("deadline"))).withColumn("name", F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).withColumn("pos", F.col("o_orderkey"))
    return tasks.ranked(t, by_name=True).select("o_orderkey", "o_custkey", "during_seconds").limit(25)


@query("q_task_ordinals", f"""WITH t AS ({ORDERS_SQL}), r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey) AS r FROM t) SELECT o_orderkey, CASE WHEN r < 10 THEN '0' ELSE '' END || r AS no FROM r""")
def q_task_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = orders_as_tasks(spark, sf_dir).withColumn("during_seconds", bands.remaining_seconds(moment(AS_OF), F.col("deadline")))
    return tasks.numbered(t.withColumn("pos", F.col("o_orderkey")), "o_custkey").select("o_orderkey", "no")


# Each customer's orders as one result object, written as JSON and read back.
@query("q_read_back", f"""WITH t AS ({ORDERS_SQL}), b AS (SELECT o_custkey, s, {BAND_SQL} AS c FROM t)
SELECT o_custkey, count(*) AS total, count(*) FILTER (s <= 0) AS expired, count(*) FILTER (c = 'C') AS urgent, count(*) FILTER (c = 'C' AND s > 0) AS urgent_ahead FROM b GROUP BY o_custkey""")
def q_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.derive(orders_as_tasks(spark, sf_dir), moment(AS_OF)).select("o_custkey", (F.col("during_seconds") / 3600).alias("during_hours"), F.col("label").alias("category"))
    objects = t.groupBy("o_custkey").agg(
        F.to_json(F.struct(F.count("*").alias("total_tasks"), F.create_map(F.lit("C类"), F.count_if(F.col("category") == bands.LABELS["C"])).alias("categories"), F.collect_list(F.struct("during_hours", F.when(F.col("category") == bands.LABELS["C"], "C类").otherwise(F.col("category")).alias("category"))).alias("tasks"))).alias("value")
    )
    return tasks.read_back(objects, keep=["o_custkey"]).select("o_custkey", "total", F.col("expired").cast("long"), F.col("urgent").cast("long"), F.col("urgent_ahead").cast("long"))


_LINES = "CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN p_name || '--' || (p_partkey % 14) || '/' || (p_partkey % 33) WHEN 2 THEN p_name || '--4/13~' || (1 + p_partkey % 12) || '/' || (1 + p_partkey % 28) WHEN 3 THEN p_name || '-- 4-8' WHEN 4 THEN '  ' || p_name || ' -- ' || (1 + p_partkey % 12) || '/' || (1 + p_partkey % 31) || '/2030 ' WHEN 5 THEN p_name || '--b--' || (1 + p_partkey % 12) || '/9--5/1' ELSE p_name || '--2/29' END"


@query("q_parse_lines", f"""WITH l AS (SELECT p_partkey, trim({_LINES}) AS line FROM part), r AS (SELECT *, substr(line, instr(line, '--') + 2) AS rest FROM l WHERE instr(line, '--') > 0),
 c AS (SELECT *, trim(CASE WHEN instr(rest, '--') > 0 THEN string_split(rest, '--')[2] ELSE rest END) AS chunk FROM r), d AS (SELECT *, trim(string_split(chunk, '~')[-1]) AS date FROM c),
 p AS (SELECT *, try_cast(string_split(date, '/')[1] AS INTEGER) AS m, try_cast(string_split(date, '/')[2] AS INTEGER) AS dd FROM d)
SELECT p_partkey AS pos, trim(string_split(line, '--')[1]) AS name, try_cast(('1998-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(dd AS VARCHAR), 2, '0') || ' 23:59:59') AS TIMESTAMP) AS deadline FROM p""")
def q_parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.expr(_LINES).alias("line"))
    return tasks.parse(tasks.keep_task_lines(lines), moment(AS_OF)).select("pos", "name", "deadline")


_PARSED_SQL = f"""l AS (SELECT p_partkey, trim({_LINES}) AS line FROM part), r AS (SELECT *, substr(line, instr(line, '--') + 2) AS rest FROM l WHERE instr(line, '--') > 0),
 c AS (SELECT *, trim(CASE WHEN instr(rest, '--') > 0 THEN string_split(rest, '--')[2] ELSE rest END) AS chunk FROM r), d AS (SELECT *, trim(string_split(chunk, '~')[-1]) AS date FROM c),
 p AS (SELECT *, trim(string_split(line, '--')[1]) AS name, try_cast(('1998-' || lpad(CAST(try_cast(string_split(date, '/')[1] AS INTEGER) AS VARCHAR), 2, '0') || '-' || lpad(CAST(try_cast(string_split(date, '/')[2] AS INTEGER) AS VARCHAR), 2, '0') || ' 23:59:59') AS TIMESTAMP) AS deadline FROM d)"""


@query("q_task_quarantine", f"WITH {_PARSED_SQL} SELECT p_partkey AS pos, line FROM p WHERE deadline IS NULL")
def q_task_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.expr(_LINES).alias("line"))
    return tasks.quarantined(tasks.parse(tasks.keep_task_lines(lines), moment(AS_OF))).select("pos", "line")


# The list is the first half of the lines by place, its input the whole list once more with later dates.
@query("q_todo_rewrite", f"""WITH {_PARSED_SQL}, g AS (SELECT line, name, deadline, p_partkey AS pos, 0 AS k FROM p WHERE deadline IS NOT NULL UNION ALL SELECT name || '-- 12/31', name, TIMESTAMP '1998-12-31 23:59:59', p_partkey, 1 FROM p WHERE deadline IS NOT NULL AND p_partkey % 2 = 0),
 w AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY deadline DESC, k DESC, pos DESC) AS r FROM g) SELECT line FROM w WHERE r = 1 UNION ALL SELECT '# ' || n_name FROM nation""")
def q_todo_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "part").select(F.expr(_LINES).alias("line"), F.col("p_partkey").cast("long").alias("pos"))
    comments = table(spark, sf_dir, "nation").select(F.concat(F.lit("# "), "n_name").alias("line"), F.col("n_nationkey").cast("long").alias("pos"))
    added = tasks.good(tasks.parse(tasks.keep_task_lines(lines), moment(AS_OF))).where("pos % 2 = 0").select(F.concat("name", F.lit("-- 12/31")).alias("line"), "pos")
    return tasks.todo_lines(lines.unionByName(comments), moment(AS_OF), added)


@query("q_quality_dup", "SELECT c_mktsegment || c_nationkey AS name, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def q_quality_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicates(table(spark, sf_dir, "customer").select(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("name")), "name")


@query("q_quality_report", f"""WITH l AS (SELECT {_LINES} AS line FROM part), g AS (SELECT count(*) AS lines FROM l WHERE trim(line) <> ''), k AS (SELECT trim(line) AS line FROM l WHERE instr(line, '--') > 0),
 r AS (SELECT trim(string_split(line, '--')[1]) AS name, substr(line, instr(line, '--') + 2) AS rest FROM k), d AS (SELECT name, trim(string_split(trim(CASE WHEN instr(rest, '--') > 0 THEN string_split(rest, '--')[2] ELSE rest END), '~')[-1]) AS date FROM r),
 p AS (SELECT name, try_cast(('1998-' || lpad(CAST(try_cast(string_split(date, '/')[1] AS INTEGER) AS VARCHAR), 2, '0') || '-' || lpad(CAST(try_cast(string_split(date, '/')[2] AS INTEGER) AS VARCHAR), 2, '0')) AS DATE) AS dl FROM d)
SELECT lines, (SELECT count(dl) FROM p) AS parsed, (SELECT count(*) FROM (SELECT name FROM p GROUP BY name HAVING count(*) > 1)) AS duplicate_names, lines = (SELECT count(dl) FROM p) AND (SELECT count(*) FROM (SELECT name FROM p GROUP BY name HAVING count(*) > 1)) = 0 AS ok FROM g""")
def q_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.expr(_LINES).alias("line"))
    return quality.report(lines, tasks.parse(tasks.keep_task_lines(lines), moment(AS_OF)))


@query("q_dedupe_latest", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def q_dedupe_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.dedupe_latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])


@query("q_timeline_pos", f"""WITH t AS ({ORDERS_SQL}), h AS (SELECT o_orderkey, o_custkey % 10 AS lane, s/3600 AS h FROM t WHERE s > 0),
 p AS (SELECT *, ln(1 + h)/ln(1 + max(h) OVER (PARTITION BY lane))*100 AS position FROM h), g AS (SELECT *, CASE WHEN (position - lag(position) OVER w)/100*1000 < 80 THEN 1 ELSE 0 END AS gap, row_number() OVER w AS r FROM p WINDOW w AS (PARTITION BY lane ORDER BY h, o_orderkey))
SELECT o_orderkey, lane, round(position, 6) AS position, CASE WHEN r % 2 = 1 THEN 'up' ELSE 'down' END AS side, CAST(1 + sum(gap) OVER (PARTITION BY lane ORDER BY h, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS row FROM g""")
def q_timeline_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bands.remaining_seconds(moment(AS_OF), F.col("deadline"))
    t = orders_as_tasks(spark, sf_dir).select("o_orderkey", (F.col("o_custkey") % 10).alias("lane"), (s / 3600).alias("h")).where("h > 0")
    return tasks.timeline(t, "h", ["lane"], ["o_orderkey"]).select("o_orderkey", "lane", F.round("position", 6).alias("position"), "side", "row")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = lambda c: F.col(c).cast(ledger.MONEY)
    return table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", F.lit("-"), F.col("l_suppkey").cast("string")).alias("bucket"), "l_orderkey", "l_linenumber", F.col("l_partkey").alias("memo"), money("l_quantity").alias("amount"))


_ENTRIES = "SELECT l_returnflag || '-' || l_suppkey AS bucket, l_orderkey, l_linenumber, l_partkey AS memo, CAST(l_quantity AS DECIMAL(18,2)) AS amount FROM lineitem"


@query("q_ledger_balance", f"""WITH e AS ({_ENTRIES}) SELECT bucket, l_orderkey, l_linenumber, amount, CAST(100000 - sum(amount) OVER (PARTITION BY bucket ORDER BY l_orderkey, l_linenumber, memo, amount ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS balance FROM e""")
def q_ledger_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    return ledger.balances(e, _buckets(spark, sf_dir), ["l_orderkey", "l_linenumber", "memo", "amount"]).select("bucket", "l_orderkey", "l_linenumber", "amount", "balance")


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A total for each flag and supplier."""
    flags = F.explode(F.array(*map(F.lit, "ANR"))).alias("flag")
    return table(spark, sf_dir, "supplier").select(flags, F.col("s_suppkey").cast("string").alias("key")).select(F.concat("flag", F.lit("-"), "key").alias("bucket"), F.lit(100000).cast(ledger.MONEY).alias("total"))


_KILLED = f"""e AS ({_ENTRIES}), k AS (SELECT DISTINCT memo, amount, bucket FROM e WHERE memo % 5 = 0 AND l_linenumber = 1)"""


@query("q_ledger_rebalance", f"""WITH {_KILLED}, s AS (SELECT * FROM e ANTI JOIN k USING (memo, amount, bucket)) SELECT bucket, l_orderkey, l_linenumber, amount, CAST(100000 - sum(amount) OVER (PARTITION BY bucket ORDER BY l_orderkey, l_linenumber, memo, amount ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS balance FROM s""")
def q_ledger_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    left = ledger.delete(e, e.where("memo % 5 = 0 and l_linenumber = 1"))
    return ledger.balances(left, _buckets(spark, sf_dir), ["l_orderkey", "l_linenumber", "memo", "amount"]).select("bucket", "l_orderkey", "l_linenumber", "amount", "balance")


@query("q_ledger_deleted", f"""WITH {_KILLED} SELECT bucket, count(*) AS n FROM e SEMI JOIN k USING (memo, amount, bucket) GROUP BY bucket""")
def q_ledger_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    return ledger.deleted(e, e.where("memo % 5 = 0 and l_linenumber = 1"))


@query("q_ledger_cards", """WITH e AS (SELECT l_returnflag AS bucket, sum(CAST(l_quantity AS DECIMAL(18,2))) AS used FROM lineitem GROUP BY 1), t(bucket, total) AS (VALUES ('A', 500000), ('N', 200), ('R', 300000), ('X', 10)),
 c AS (SELECT t.bucket, CAST(total AS DECIMAL(18,2)) AS total, CAST(coalesce(used, 0) AS DECIMAL(18,2)) AS used FROM t LEFT JOIN e USING (bucket))
SELECT bucket, total, used, CAST(total - used AS DECIMAL(18,2)) AS remaining, used <> 0 AS show_used, total - used <= 0 AS depleted FROM c""")
def q_ledger_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("bucket"), F.col("l_quantity").cast(ledger.MONEY).alias("amount"))
    totals = spark.createDataFrame([("A", 500000), ("N", 200), ("R", 300000), ("X", 10)], "bucket string, total int").withColumn("total", F.col("total").cast(ledger.MONEY))
    return ledger.cards(e, totals, totals.select("bucket"))


@query("q_ledger_delete", f"""WITH e AS ({_ENTRIES}), k AS (SELECT DISTINCT memo, amount, bucket FROM e WHERE memo % 5 = 0 AND l_linenumber = 1), s AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.memo = e.memo AND k.amount = e.amount AND k.bucket = e.bucket))
SELECT bucket, count(*) AS n, CAST(100000 - sum(amount) AS DECIMAL(18,2)) AS balance FROM s GROUP BY bucket""")
def q_ledger_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    left = ledger.delete(e, e.where("memo % 5 = 0 and l_linenumber = 1"))
    return left.groupBy("bucket").agg(F.count("*").alias("n"), (F.lit(100000) - F.sum("amount")).cast(ledger.MONEY).alias("balance"))


_COMMANDS = "CASE WHEN o_orderkey % 50 = 0 THEN 'money a:' || (o_orderkey % 900 + 100) || ' B:500' WHEN o_orderkey % 7 = 0 THEN '删除 m' || (o_orderkey % 20) || '-' || (o_orderkey % 9) || '-A' WHEN o_orderkey % 11 = 0 THEN 'oops' ELSE 'm' || (o_orderkey % 20) || '-' || (o_orderkey % 9) || '-a r-' || '-3-B' END"


@query("q_ledger_events", f"""WITH c AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 50 = 0 THEN 1 WHEN o_orderkey % 7 = 0 THEN 2 WHEN o_orderkey % 11 = 0 THEN 3 ELSE 4 END AS k FROM orders),
 sets AS (SELECT max(seq) AS s FROM c WHERE k = 1), a AS (SELECT seq, 'A' AS bucket, 'm' || (seq % 20) AS memo, CAST(seq % 9 AS DECIMAL(18,2)) AS amount, k FROM c WHERE k IN (2, 4)), b AS (SELECT seq, 'B' AS bucket, 'r' AS memo, CAST(-3 AS DECIMAL(18,2)) AS amount, k FROM c WHERE k = 4),
 e AS (SELECT * FROM a UNION ALL SELECT * FROM b), st AS (SELECT * FROM e WHERE k = 4 AND seq > (SELECT s FROM sets) AND NOT EXISTS (SELECT 1 FROM e d WHERE d.k = 2 AND d.bucket = e.bucket AND d.memo = e.memo AND d.amount = e.amount AND d.seq > e.seq)),
 t AS (SELECT 'A' AS bucket, CAST((SELECT s FROM sets) % 900 + 100 AS DECIMAL(18,2)) AS total UNION ALL SELECT 'B', CAST(500 AS DECIMAL(18,2)))
SELECT t.bucket, t.total, count(st.seq) AS n, CAST(t.total - coalesce(sum(st.amount), 0) AS DECIMAL(18,2)) AS remaining FROM t LEFT JOIN st USING (bucket) GROUP BY t.bucket, t.total""")
def q_ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals, stands = ledger.state(ledger.route(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.expr(_COMMANDS).alias("text"))))
    used = stands.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("amount").alias("used"))
    return totals.join(used, "bucket", "left").select("bucket", "total", F.coalesce("n", F.lit(0)).alias("n"), (F.col("total") - F.coalesce("used", F.lit(0))).cast(ledger.MONEY).alias("remaining"))


@query("q_ledger_announced", """WITH c AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 50 = 0 THEN 1 WHEN o_orderkey % 7 = 0 THEN 2 WHEN o_orderkey % 11 = 0 THEN 3 ELSE 4 END AS k FROM orders)
SELECT seq, CASE WHEN k = 2 THEN '🗑️ 已删除 · m' || seq % 20 || ' · 生活 ' || seq % 9 || '.00' ELSE '📝 m' || seq % 20 || ' · 生活 ' || CASE WHEN seq % 9 > 0 THEN '-' ELSE '+' END || seq % 9 || '.00' END AS line FROM c WHERE k IN (2, 4) UNION ALL SELECT seq, '📝 r · 学习 +3.00' FROM c WHERE k = 4""")
def q_ledger_announced(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = ledger.route(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.expr(_COMMANDS).alias("text")))
    return ledger.announced(actions, ledger.envelopes(spark)).select("seq", "line")


_LINE = "'+------------------+'"


@query("q_ledger_page", f"""WITH e AS (SELECT CASE l_returnflag WHEN 'N' THEN 'C' ELSE l_returnflag END AS bucket, sum(CAST(l_quantity AS DECIMAL(18,2))) AS used FROM lineitem GROUP BY 1), t(bucket, envelope, total) AS (VALUES ('A', '生活', 500000), ('B', '学习', 20), ('C', '储值', 200), ('D', '消费', 0)),
 c AS (SELECT bucket, envelope, CAST(total AS DECIMAL(18,2)) AS total, CAST(coalesce(used, 0) AS DECIMAL(18,2)) AS used, CAST(total - coalesce(used, 0) AS DECIMAL(18,2)) AS remaining FROM t LEFT JOIN e USING (bucket))
SELECT string_agg({_LINE} || chr(10) || '|  ' || bucket || ' · ' || envelope || '  |' || chr(10) || {_LINE} || chr(10) || '|  总额：' || total || '    |' || chr(10) || CASE WHEN used <> 0 THEN '|  已用：' || used || '    |' || chr(10) ELSE '' END || '|  剩余：' || remaining || '    |' || chr(10) || CASE WHEN remaining <= 0 THEN '|  ⚠️ 已用尽      |' || chr(10) ELSE '' END || {_LINE}, chr(10) || chr(10) ORDER BY remaining, bucket) AS page FROM c""")
def q_ledger_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "N", "C").otherwise(F.col("l_returnflag")).alias("bucket"), F.col("l_quantity").cast(ledger.MONEY).alias("amount"))
    totals = spark.createDataFrame([("A", 500000), ("B", 20), ("C", 200), ("D", 0)], "bucket string, total int").withColumn("total", F.col("total").cast(ledger.MONEY))
    return ledger.card_page(ledger.cards(e, totals, ledger.envelopes(spark)))


@query("q_ledger_markdown", """WITH e AS (SELECT CAST(l_suppkey % 10 AS VARCHAR) AS bucket, l_orderkey * 10 + l_linenumber AS seq, max(l_shipdate) AS l_shipdate, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amount FROM lineitem GROUP BY 1, 2), b AS (SELECT *, CAST(100000 - sum(amount) OVER (PARTITION BY bucket ORDER BY seq ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS balance FROM e)
SELECT bucket, '总额：100000.00' || chr(10) || chr(10) || '| 日期 | 摘要 | 金额 | 余额 |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg('| ' || month(l_shipdate) || '/' || day(l_shipdate) || ' | m | ' || CAST(-amount AS DECIMAL(18,2)) || ' | ' || balance || ' |', chr(10) ORDER BY seq) AS text FROM b GROUP BY bucket""")
def q_ledger_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("seq")
    lines = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).cast("string").alias("bucket"), seq).agg(F.max("l_shipdate").alias("day"), F.sum(F.col("l_quantity").cast(ledger.MONEY)).cast(ledger.MONEY).alias("amount"))
    e = lines.select("bucket", "seq", bands.month_day(F.col("day")).alias("date"), F.lit("m").alias("memo"), "amount")
    totals = spark.range(10).select(F.col("id").cast("string").alias("bucket"), F.lit(100000).cast(ledger.MONEY).alias("total"))
    return sinks.ledger_markdown(e, totals)


_CATS = ("planning", "analysis", "communication", "meeting", "sales")
_NEEDS = {"root": ["k0", "k3"], "decide": ["k1"], "plan": ["k2", "k5"]}


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    p, c = F.col("p_partkey"), F.col("c_custkey")
    templates = table(spark, sf_dir, "part").select(
        p.alias("id"), F.array(pick(_CATS, p), pick(_CATS, p % 3)).alias("categories"), (p % 10 + 1).alias("difficulty"), (p % 8 + 3).alias("popularity"), (p % 11 == 0).alias("is_common"),
        F.col("p_name").alias("description"), F.array(F.concat(F.lit("k"), (p % 6).cast("string"))).alias("best_for"), (p % 5 + 1).alias("team_lo"), (p % 5 + 4).alias("team_hi"),
    )
    answers = table(spark, sf_dir, "customer").select(
        c.alias("request"), pick((*_CATS, "multiple"), c).alias("scenario"), F.array(F.lit("sales"), F.lit("meeting")).alias("multi_scenario"),
        pick(("simple", "moderate", "complex", "any"), c).alias("difficulty_preference"), pick(("solo", "small", "medium", "large"), c % 3).alias("team_context"), pick((*_NEEDS, "other"), c).alias("specific_need"),
    )
    return templates, answers


def _recommended(spark: SparkSession, sf_dir: str, choose) -> DataFrame:
    """What choose() takes of all parts, scored once a class of equal answers."""
    templates, answers = _sides(spark, sf_dir)
    classes, members = recommend.by_class(answers)
    return recommend.of_members(choose(recommend.nominees(templates, classes, _NEEDS)), members)


_SCORED = """WITH t AS (SELECT p_partkey AS id, ['planning','analysis','communication','meeting','sales'][p_partkey % 5 + 1] AS c1, ['planning','analysis','communication','meeting','sales'][p_partkey % 3 + 1] AS c2, p_partkey % 10 + 1 AS difficulty, p_partkey % 8 + 3 AS popularity, p_partkey % 11 = 0 AS is_common, p_name AS description, 'k' || (p_partkey % 6) AS bf, p_partkey % 5 + 1 AS lo, p_partkey % 5 + 4 AS hi FROM part),
 a AS (SELECT c_custkey AS request, ['planning','analysis','communication','meeting','sales','multiple'][c_custkey % 6 + 1] AS scenario, c_custkey % 4 AS dp, c_custkey % 3 AS tc, c_custkey % 4 AS need FROM customer),
 s AS (SELECT request, id, is_common, c1, round(CASE WHEN scenario IN (c1, c2) OR (scenario = 'multiple' AND (c1 IN ('sales','meeting') OR c2 IN ('sales','meeting'))) THEN 3 ELSE 0 END
  + CASE WHEN dp = 3 THEN 1 WHEN difficulty BETWEEN [1,4,7][dp + 1] AND [4,7,10][dp + 1] THEN 2 ELSE 0 END + CASE WHEN lo <= [1,6,15][tc + 1] AND hi >= [1,2,3][tc + 1] THEN 1 ELSE 0 END
  + CASE WHEN (need = 0 AND (bf IN ('k0','k3') OR contains(description,'k0') OR contains(description,'k3'))) OR (need = 1 AND (bf = 'k1' OR contains(description,'k1'))) OR (need = 2 AND (bf IN ('k2','k5') OR contains(description,'k2') OR contains(description,'k5'))) THEN 3 ELSE 0 END
  + popularity * 0.1::DOUBLE + CASE WHEN is_common THEN 0.5 ELSE 0 END, 6) AS score FROM a CROSS JOIN t),
 r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, is_common DESC, id) AS rank FROM s)"""


@query("q_recommend_top3", f"{_SCORED} SELECT request, rank, id, CAST(score AS DOUBLE) AS score FROM r WHERE rank <= 3")
def q_recommend_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recommended(spark, sf_dir, lambda s: recommend.top(s).select("request", "rank", "id", "score"))


@query("q_recommend_diverse", f"""{_SCORED}, l AS (SELECT *, first_value(c1) OVER (PARTITION BY request ORDER BY rank) AS lead FROM r), o AS (SELECT request, min(rank) FILTER (c1 <> lead) AS other FROM l GROUP BY request)
SELECT request, least(rank, 3) AS rank, id, CAST(score AS DOUBLE) AS score FROM l JOIN o USING (request) WHERE rank < 3 OR rank = CASE WHEN coalesce(other, 3) > 3 THEN other ELSE 3 END""")
def q_recommend_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recommended(spark, sf_dir, lambda s: recommend.diverse(s).select("request", "rank", "id", "score"))


@query("q_recommend_low", f"{_SCORED} SELECT request, CAST(max(score) AS DOUBLE) AS best FROM s GROUP BY request HAVING max(score) <= 8")
def q_recommend_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recommended(spark, sf_dir, lambda s: recommend.low_match(s, 8.0))


@query("q_next_questions", """SELECT c_custkey AS request, q AS question_id FROM customer, (VALUES (1, NULL, NULL), (2, 'scenario', 'AUTOMOBILE'), (3, 'scenario', 'BUILDING'), (4, 'nation', '7'), (5, 'other', 'x')) t(q, k, v) WHERE k IS NULL OR k = 'scenario' AND v = c_mktsegment OR k = 'nation' AND v = CAST(c_nationkey AS VARCHAR)""")
def q_next_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = spark.createDataFrame([(1, None), (2, "scenario=AUTOMOBILE"), (3, "scenario=BUILDING"), (4, "nation=7"), (5, "other=x")], "question_id int, trigger string")
    answers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request"), F.create_map(F.lit("scenario"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string")).alias("answers"))
    return recommend.next_questions(questions, answers)


@query("q_stars", "SELECT event_id, least(5, CAST(ceil(value / 10 / 2) AS INTEGER)) AS stars FROM events")
def q_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", bands.stars(F.col("value") / 10).alias("stars"))


@query("q_audit_dashboard", """WITH s AS (SELECT l_suppkey % 20 AS audit, l_linenumber AS element, least(5 + l_orderkey % 6, 5 + l_partkey % 6) AS rigor, 5 + l_orderkey % 6 < 9 OR 5 + l_partkey % 6 < 9 AS red FROM lineitem),
 e AS (SELECT audit, element, avg(rigor) AS m FROM s GROUP BY 1, 2) SELECT audit, round(avg(CASE WHEN NOT red AND rigor >= 8 THEN 1 ELSE 0 END), 6) AS pass_rate, count(*) FILTER (red) AS red, count(*) FILTER (rigor < 8) AS yellow, (SELECT arg_min(element, (m, element)) FROM e WHERE e.audit = s.audit) AS weakest FROM s GROUP BY audit""")
def q_audit_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("audit"), F.col("l_linenumber").alias("element"), (5 + F.col("l_orderkey") % 6).alias("reliability"), (5 + F.col("l_partkey") % 6).alias("validity"))
    return scorecard.dashboard(scorecard.gates(s), ["audit"])


@query("q_paper_top3", """WITH p AS (SELECT p_brand, p_partkey, (p_partkey % 11) + (p_partkey // 3 % 11) + (p_size % 11) + (p_partkey // 7 % 11) + (p_partkey // 2 % 11) AS total FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY total DESC, p_partkey) AS rank FROM p WHERE total > 40) SELECT p_brand, p_partkey, total, rank FROM r WHERE rank <= 3""")
def q_paper_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").selectExpr("p_brand", "p_partkey", "p_partkey % 11 AS channel", "p_partkey div 3 % 11 AS practice", "p_size % 11 AS reliability", "p_partkey div 7 % 11 AS validity", "p_partkey div 2 % 11 AS fit")
    return scorecard.top_papers(p, ["p_brand"], ["p_partkey"]).select("p_brand", "p_partkey", "total", "rank")


@query("q_plan_chain", """WITH w AS (SELECT conv_id, turn, role, length(text) AS n, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)
SELECT conv_id AS plan_id, count(*) AS steps, count(*) BETWEEN 3 AND 9 AS steps_ok, arg_min(n, turn) <= 15 AS first_ok, bool_and(n % 5 < 3) AS granular_ok, count(*) FILTER (r > 1 AND (CASE WHEN role = 'assistant' THEN 'user' ELSE 'assistant' END) IS DISTINCT FROM before) = 0 AS chain_ok FROM w GROUP BY conv_id""")
def q_plan_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("plan_id"), F.col("turn").alias("step"), F.when(F.col("role") == "assistant", "user").otherwise("assistant").alias("input"), F.col("role").alias("output"), (F.length("text") % 5).alias("granularity"), F.length("text").alias("minutes"))
    return scorecard.plan_checks(c)


@query("q_plan_questions", """SELECT conv_id AS plan_id, count(*) AS steps, count(*) FILTER (contains(text, 'w')) <= 3 AS questions_ok FROM conversations GROUP BY conv_id""")
def q_plan_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("plan_id"), F.col("turn").alias("step"), F.col("role").alias("input"), F.col("role").alias("output"), F.lit(1).alias("granularity"), F.lit(1).alias("minutes"), F.contains("text", F.lit("w")).alias("question"))
    return scorecard.plan_checks(c).select("plan_id", "steps", "questions_ok")


@query("q_quota", "SELECT doc_id, lang, rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents) JOIN (VALUES ('en', 30), ('de', 15), ('fr', 10)) q(lang, quota) USING (lang) WHERE rank <= quota")
def q_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    quota = spark.createDataFrame([("en", 30), ("de", 15), ("fr", 10)], "lang string, quota int")
    return scorecard.quotas(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), quota, "lang", [F.desc("n_chars"), "doc_id"]).select("doc_id", "lang", "rank")


@query("q_group_blocks", "SELECT p_brand, CAST(ceil(r / 5.0) AS BIGINT) AS group_no, count(*) AS n FROM (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) GROUP BY 1, 2")
def q_group_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecard.groups_of(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), ["p_brand"], ["p_partkey"]).groupBy("p_brand", "group_no").agg(F.count("*").alias("n"))


@query("q_text_stats", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars, count(*) FILTER (length(line) - length(replace(line, '<', '')) > 3) AS crowded, max(length(line)) AS longest FROM l GROUP BY doc_id""")
def q_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    counted = textcheck.marker_counts(lines)
    return counted.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("m1") > 3).alias("crowded"), F.max(F.length("text")).cast("long").alias("longest"))


@query("q_sentence_checks", r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[。！？.!?\n]+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, CAST(len(s) AS BIGINT) AS sentences, CAST(len(list_filter(s, lambda x: length(x) > 40)) AS BIGINT) AS too_long, len(s) <= 5 AS count_ok FROM s""")
def q_sentence_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = textcheck.sentence_checks(table(spark, sf_dir, "documents"))
    return c.select("doc_id", F.col("sentences").cast("long"), F.col("too_long").cast("long"), "count_ok")


@query("q_html_outline", """SELECT page_id, CAST(len(regexp_extract_all(html, '<h[1-6][ >]')) AS BIGINT) AS headings, CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS paragraphs, CAST(len(regexp_extract_all(html, '<li[ >]')) AS BIGINT) AS items FROM pages""")
def q_html_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textcheck.outline(table(spark, sf_dir, "pages"))


# The whole rule: of what begins with #, three equal digits or three equal pairs; or a word.
@query("q_forbidden_colours", r"""WITH h AS (SELECT page_id AS doc_id, html || CASE page_id % 6 WHEN 0 THEN '#fff;' WHEN 1 THEN 'color:#12a' WHEN 2 THEN ' Gray ' WHEN 3 THEN '#a1A1a1 ' WHEN 4 THEN '#a1a1a2 #1212' ELSE ' grayish #7778' END AS text FROM pages),
 c AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '#[0-9A-Za-z]+'), lambda x: lower(x[2:])) AS codes FROM h)
SELECT doc_id, regexp_matches(text, '(?i)\b(black|white|gr[ae]y)\b') OR len(list_filter(codes, lambda x: regexp_matches(x, '^([0-9a-f]{3}|[0-9a-f]{6})$') AND (len(x) = 3 AND x[1] = x[2] AND x[2] = x[3] OR len(x) = 6 AND x[1:2] = x[3:4] AND x[3:4] = x[5:6]))) > 0 AS forbidden FROM c""")
def q_forbidden_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.element_at(F.array(*map(F.lit, ("#fff;", "color:#12a", " Gray ", "#a1A1a1 ", "#a1a1a2 #1212", " grayish #7778"))), (F.col("page_id") % 6 + 1).cast("int"))
    return textcheck.forbidden_colours(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.concat("html", more).alias("text")))


@query("q_hierarchy", """WITH n AS (SELECT 'B' || p_partkey // 3 || '-' || (p_partkey % 4) || CASE WHEN p_partkey % 2 = 0 THEN '-' || (p_partkey % 3) ELSE '' END AS id, p_size % 5 AS steps FROM part)
SELECT array_to_string(string_split(id, '-')[:-2], '-') AS parent, count(*) AS children, count(*) <= 3 AND max(len(string_split(id, '-')) - 1) <= 3 AND max(steps) <= 3 AS ok FROM n GROUP BY 1""")
def q_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").selectExpr("concat('B', p_partkey div 3, '-', p_partkey % 4, CASE WHEN p_partkey % 2 = 0 THEN concat('-', p_partkey % 3) ELSE '' END) AS id", "p_size % 5 AS steps")
    return textcheck.hierarchy(n)


@query("q_missing_ids", """WITH s AS (SELECT doc_id, unnest(['B' || doc_id % 50 || '-' || doc_id % 5, 'B1-' || doc_id % 3 || '-2']) AS id FROM documents), o AS (SELECT doc_id, unnest(['B' || doc_id % 50 || '-' || doc_id % 7, 'B1-' || doc_id % 3 || '-2']) AS id FROM labels)
SELECT * FROM s EXCEPT SELECT * FROM o""")
def q_missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "documents").selectExpr("doc_id", "concat('see B', doc_id % 50, '-', doc_id % 5, ' and (B1-', doc_id % 3, '-2), not B7 or b1-1') AS text")
    output = table(spark, sf_dir, "labels").selectExpr("doc_id", "concat('<b>B', doc_id % 50, '-', doc_id % 7, '</b>B1-', doc_id % 3, '-2') AS text")
    return textcheck.missing_ids(source, output)


@query("q_node_ids", "SELECT doc_id, 'B' || doc_id % 50 || '-' || doc_id % 5 AS id FROM documents")
def q_node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textcheck.node_ids(table(spark, sf_dir, "documents").selectExpr("doc_id", "concat('B', doc_id % 50, '-', doc_id % 5, ': B', doc_id % 50, '-', doc_id % 5) AS text"))


# A text of two headings, ids and words; the output lacks a heading of every third and an id of every fifth.
@query("q_lossless", """SELECT p_partkey AS doc_id, CAST(length(replace(p_name, ' ', '')) + 2 * length(CAST(p_partkey AS VARCHAR)) + 10 AS BIGINT) AS source_chars, CAST(2 AS BIGINT) AS source_headings,
 CAST(length(replace(p_name, ' ', '')) + 2 * length(CAST(p_partkey AS VARCHAR)) + 10 - CASE WHEN p_partkey % 5 = 0 THEN length(CAST(p_partkey AS VARCHAR)) + 3 ELSE 0 END AS BIGINT) AS output_chars, CAST(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS output_headings,
 CAST(CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS lost_ids, p_partkey % 5 > 0 AND p_partkey % 3 > 0 AS ok FROM part""")
def q_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    source = p.selectExpr("p_partkey AS doc_id", "concat('# Head\n## ', p_name, '\nB1-', p_partkey, ' B', p_partkey, '-2') AS text")
    output = p.selectExpr("p_partkey AS doc_id", "concat('<h2>Head</h2>\n', if(p_partkey % 3 = 0, '<p>', '<h3>'), p_name, '</h3><p>B1-', p_partkey, if(p_partkey % 5 = 0, '', concat(' <i>B', p_partkey, '-2</i>')), '</p>') AS text")
    c = textcheck.lossless(source, output)
    return c.select("doc_id", *(F.col(x).cast("long") for x in ("source_chars", "source_headings", "output_chars", "output_headings", "lost_ids")), "ok")


@query("q_markdown_blocks", r"""WITH t AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id) AS r, unnest(string_split(text, chr(10))) AS line FROM documents WHERE NOT contains(text, '```')),
 l AS (SELECT doc_id, CASE WHEN regexp_matches(line, '^#{1,6}\s') THEN 'heading' WHEN regexp_matches(line, '^\s*([-*+]|[0-9]+[.)])\s') THEN 'list' WHEN regexp_matches(line, '^\s*\|') THEN 'table' ELSE 'paragraph' END AS kind FROM t WHERE trim(line, ' ') <> '')
SELECT doc_id, kind, count(*) AS n FROM l GROUP BY 1, 2""")
def q_markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = textcheck.blocks(table(spark, sf_dir, "documents").where("not contains(text, '```')").select("doc_id", "text"))
    return found.groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query("q_html_tags", "SELECT n_nationkey, 'h' || least(n_nationkey % 7 + 1, 6) AS tag FROM nation")
def q_html_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", textcheck.html_tag((F.col("n_nationkey") % 7).cast("int")).alias("tag"))


@query("q_markers_total", """WITH l AS (SELECT doc_id, replace(replace(line, 'a', '<'), 'b', '{') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
 m AS (SELECT doc_id, length(line) - length(replace(line, '「', '')) AS a, length(line) - length(replace(line, '<', '')) AS b, length(line) - length(replace(line, '{', '')) AS c, length(line) - length(replace(line, '（', '')) AS d FROM l)
SELECT doc_id, CAST(sum(a + b + c + d) AS BIGINT) AS markers, count(*) FILTER (greatest(a, b, c, d) <= 3) AS each_ok, count(*) FILTER (a + b + c + d <= 3) AS all_ok FROM m GROUP BY doc_id""")
def q_markers_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text")).withColumn("text", F.translate("text", "ab", "<{"))
    return textcheck.marker_counts(lines).groupBy("doc_id").agg(F.sum("markers").cast("long").alias("markers"), F.count_if("each_ok").alias("each_ok"), F.count_if("all_ok").alias("all_ok"))


@query("q_parts_compared", """WITH a AS (SELECT c_mktsegment || c_nationkey AS unit, count(*) AS a FROM customer GROUP BY 1), b AS (SELECT c_mktsegment || (c_nationkey + 1) AS unit, count(*) AS b FROM customer WHERE c_custkey % 3 > 0 GROUP BY 1), x AS (SELECT unit, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b USING (unit))
SELECT unit, CASE WHEN b = 0 THEN 'omitted' WHEN a = 0 THEN 'invented' WHEN b > a THEN 'repeated' ELSE 'reduced' END AS change, abs(a - b) AS n FROM x WHERE a <> b""")
def q_parts_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    unit = lambda n: F.concat("c_mktsegment", n.cast("string")).alias("unit")
    return textcheck.parts_compared(c.select(unit(F.col("c_nationkey"))), c.where("c_custkey % 3 > 0").select(unit(F.col("c_nationkey") + 1)))


@query("q_route", f"""WITH m AS (SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN 'ddl:' WHEN 1 THEN 'ddltodo: ' WHEN 2 THEN ' qa:' WHEN 3 THEN 'none ' WHEN 4 THEN 'prefix-config:' ELSE 'pre:' END || text AS text FROM conversations), p(prefix, route) AS (VALUES {', '.join(f"('{p}', '{r}')" for p, r in router.ROUTES)}),
 j AS (SELECT m.*, p.*, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(prefix) DESC) AS r FROM m LEFT JOIN p ON starts_with(ltrim(text), prefix)) SELECT conv_id, turn, route, trim(substr(ltrim(text), length(prefix) + 1)) AS args FROM j WHERE r = 1""")
def q_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "concat(CASE (conv_id + turn) % 6 WHEN 0 THEN 'ddl:' WHEN 1 THEN 'ddltodo: ' WHEN 2 THEN ' qa:' WHEN 3 THEN 'none ' WHEN 4 THEN 'prefix-config:' ELSE 'pre:' END, text) AS text")
    return router.route(m).select("conv_id", "turn", "route", "args")


@query("q_throttle", """WITH RECURSIVE e AS (SELECT DISTINCT user_id, ts FROM events), a(user_id, ts) AS (SELECT user_id, min(ts) FROM e GROUP BY user_id UNION ALL SELECT user_id, t FROM (SELECT a.user_id, (SELECT min(e.ts) FROM e WHERE e.user_id = a.user_id AND e.ts >= a.ts + INTERVAL 1 HOUR) AS t FROM a) WHERE t IS NOT NULL) SELECT user_id, ts FROM a""")
def q_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.throttle(table(spark, sf_dir, "events"), ["user_id"], "ts", 3600)


@query("q_created_events", """WITH RECURSIVE e AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type <> 'purchase'), a(user_id, ts) AS (SELECT user_id, min(ts) FROM e GROUP BY user_id UNION ALL SELECT user_id, t FROM (SELECT a.user_id, (SELECT min(e.ts) FROM e WHERE e.user_id = a.user_id AND e.ts >= a.ts + INTERVAL 1 HOUR) AS t FROM a) WHERE t IS NOT NULL)
SELECT user_id, ts FROM a UNION ALL SELECT user_id, ts FROM events WHERE event_type = 'purchase'""")
def q_created_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return watch.with_created(watch.throttle(e.where("event_type <> 'purchase'"), ["user_id"], "ts", 3600), e.where("event_type = 'purchase'").select("user_id", "ts"))


@query("q_alive", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'error' ELSE 'ready' END = 'ready' AND event_id % 7 > 0 AND date_diff('microsecond', ts, TIMESTAMP '2024-01-08') / 1e6 < 86400 AS alive FROM events""")
def q_alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 1, "error").otherwise("ready").alias("status"), F.when(F.col("event_id") % 7 > 0, F.col("ts").cast("string")).otherwise("no time").alias("last_update"))
    return watch.alive(states, datetime.datetime(2024, 1, 8), 86400).select("event_id", "alive")


# All labels against all labels with ids shifted by one.
@query("q_eval_regression", """WITH a AS (SELECT doc_id, CAST(quality AS DOUBLE) AS score FROM labels), b AS (SELECT doc_id + 1 AS doc_id, CAST(toxic AS DOUBLE) AS score FROM labels)
SELECT doc_id, a.score AS score_before, b.score AS score_now, CASE WHEN a.score IS NULL THEN 'new' WHEN b.score IS NULL THEN 'gone' WHEN b.score - a.score < -0.5 THEN 'regressed' WHEN b.score - a.score > 0.5 THEN 'improved' ELSE 'same' END AS change FROM a FULL JOIN b USING (doc_id)""")
def q_eval_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "labels")
    a = runs.select("doc_id", F.col("quality").cast("double").alias("score"))
    b = runs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("toxic").cast("double").alias("score"))
    return evalmetrics.compare_runs(a, b, "doc_id")


_RESULTS = "SELECT event_type AS capability, 'L' || (user_id % 3 + 1) AS level, value > 50 AS pass FROM events"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("capability"), F.concat(F.lit("L"), (F.col("user_id") % 3 + 1).cast("string")).alias("level"), (F.col("value") > 50).alias("pass"))


@query("q_eval_matrix", f"WITH r AS ({_RESULTS}) SELECT capability, " + ", ".join(f"round(avg(CAST(pass AS INT)) FILTER (level = '{x}'), 6) AS \"{x}\"" for x in ("L1", "L2", "L3")) + " FROM r GROUP BY 1")
def q_eval_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalmetrics.matrix(_results(spark, sf_dir), "capability", "level", ["L1", "L2", "L3"])


@query("q_eval_rates", f"WITH r AS ({_RESULTS}) SELECT capability, level, count(*) AS n, round(avg(CAST(pass AS INT)), 6) AS pass_rate FROM r GROUP BY ROLLUP (capability, level)")
def q_eval_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalmetrics.pass_rates(_results(spark, sf_dir), "capability", "level")


@query("q_eval_gate", f"WITH r AS ({_RESULTS}) SELECT level, round(avg(CAST(pass AS INT)), 6) AS pass_rate, round(avg(CAST(pass AS INT)), 6) >= CASE level WHEN 'L1' THEN 0.9 WHEN 'L2' THEN 0.7 ELSE 0.5 END AS gate_ok FROM r GROUP BY 1")
def q_eval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalmetrics.layered_gate(_results(spark, sf_dir))


@query("q_eval_pareto", "SELECT p_brand, p_partkey, p_retailprice AS cost, p_size AS quality FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND (b.p_retailprice < a.p_retailprice AND b.p_size >= a.p_size OR b.p_retailprice = a.p_retailprice AND b.p_size > a.p_size))")
def q_eval_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalmetrics.pareto(table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("cost"), F.col("p_size").alias("quality")), ["p_brand"])


@query("q_eval_coverage", "SELECT lang, round(avg(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END), 6) AS coverage FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY lang")
def q_eval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalmetrics.coverage(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id", ["lang"])


@query("q_eval_diversity", "SELECT event_type, round(count(DISTINCT user_id) / count(user_id), 6) AS diversity FROM events GROUP BY 1")
def q_eval_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalmetrics.diversity(table(spark, sf_dir, "events"), ["event_type"], "user_id")


@query("q_eval_cost", "SELECT event_type, round(CAST(sum(user_id) AS DOUBLE) * 0.002, 6) AS cost, round(avg(value), 6) AS mean_latency FROM events GROUP BY 1")
def q_eval_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalmetrics.cost_latency(table(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("tokens"), F.col("value").alias("latency")), ["event_type"], 0.002)


@query("q_eval_falling", "SELECT user_id, event_id, value FROM (SELECT *, value < lag(value) OVER w AND lag(value) OVER w < lag(value, 2) OVER w AND lag(value, 2) OVER w < lag(value, 3) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE f")
def q_eval_falling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalmetrics.falling(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value")


@query("q_eval_kappa", "WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY 1, 2), t AS (SELECT CAST(sum(n) AS DOUBLE) AS t, sum(CASE WHEN a = b THEN n ELSE 0 END) AS o FROM c), e AS (SELECT sum(r * k) AS e FROM (SELECT a AS v, sum(n) AS r FROM c GROUP BY 1) JOIN (SELECT b AS v, sum(n) AS k FROM c GROUP BY 1) USING (v)) SELECT round((o/t - e/(t*t)) / (1 - e/(t*t)), 6) AS kappa FROM t, e")
def q_eval_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalmetrics.kappa(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("q_eval_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def q_eval_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(b, "vec_id").select("vec_id", F.round(evalmetrics.cosine(F.col("embedding"), F.col("b")), 6).alias("similarity"))


@query("q_file_kinds", "SELECT CASE WHEN e IN ('mp4','mov','avi','mkv','flv','wmv','webm') THEN 'video' WHEN e IN ('mp3','wav','m4a','flac','aac','ogg') THEN 'audio' WHEN e IN ('txt','md','doc','docx','pdf','html') THEN 'text' ELSE 'other' END AS kind, count(*) AS n FROM (SELECT lower(regexp_extract(p_name || ['.mp4', '.WAV', '.md', '.x', ''][p_partkey % 5 + 1], '\\.([A-Za-z0-9]+)$', 1)) AS e FROM part) GROUP BY 1".replace("\\\\", "\\"))
def q_file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("p_name", F.element_at(F.array(*map(F.lit, (".mp4", ".WAV", ".md", ".x", ""))), (F.col("p_partkey") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "part").select(bands.file_kind(path).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("q_eval_weighted", "SELECT p_partkey, CAST(round(0.4 * p_size + 0.3 * (p_partkey % 7) + 0.1 * (p_partkey % 5) + 0.1 * (p_partkey % 3) + 0.1 * (p_partkey % 2), 6) AS DOUBLE) AS score FROM part")
def q_eval_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [F.col("p_size"), *(F.col("p_partkey") % k for k in (7, 5, 3, 2))]
    return table(spark, sf_dir, "part").select("p_partkey", F.round(evalmetrics.weighted([c.cast("double") for c in columns]), 6).alias("score"))


@query("q_eval_priorities", f"""WITH r AS (SELECT event_type AS capability, 'L' || (user_id % 3 + 1) AS level, value > 50 AS pass FROM events), c AS (SELECT capability, level, round(avg(CAST(pass AS INT)), 6) AS pass_rate FROM r GROUP BY 1, 2),
 k AS (SELECT *, CASE WHEN pass_rate >= 0.8 THEN 'green' WHEN pass_rate >= 0.6 THEN 'yellow' ELSE 'red' END AS colour FROM c) SELECT capability, level, colour, row_number() OVER (PARTITION BY capability ORDER BY CASE colour WHEN 'red' THEN 1 WHEN 'yellow' THEN 2 ELSE 3 END, level) AS place FROM k""")
def q_eval_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _results(spark, sf_dir).groupBy("capability", "level").agg(F.round(F.avg(F.col("pass").cast("int")), 6).alias("pass_rate"))
    by = Window.partitionBy("capability").orderBy("turn")
    return evalmetrics.priorities(cells).select("capability", "level", "colour", F.row_number().over(by).alias("place"))


@query("q_eval_ttest", """WITH v AS (SELECT event_type, avg(value) FILTER (user_id % 2 = 0) AS m0, avg(value) FILTER (user_id % 2 = 1) AS m1, var_samp(value) FILTER (user_id % 2 = 0) / count(value) FILTER (user_id % 2 = 0) AS e0, var_samp(value) FILTER (user_id % 2 = 1) / count(value) FILTER (user_id % 2 = 1) AS e1, count(value) FILTER (user_id % 2 = 0) AS n0, count(value) FILTER (user_id % 2 = 1) AS n1 FROM events GROUP BY 1)
SELECT event_type, round((m1 - m0) / sqrt(e0 + e1), 6) AS t, round((e0 + e1) * (e0 + e1) / (e0 * e0 / (n0 - 1) + e1 * e1 / (n1 - 1)), 4) AS freedom FROM v""")
def q_eval_ttest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evalmetrics.t_test(table(spark, sf_dir, "events").withColumn("run", F.col("user_id") % 2 == 1), ["event_type"], "run", "value")
    return found.select("event_type", F.round("t", 6).alias("t"), F.round("freedom", 4).alias("freedom"))
