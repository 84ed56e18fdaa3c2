"""Writes: an escaped HTML report, JSON arrays, ledgers, state. Reports are of bounded lists and made on the driver."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REPORT_ROWS = 10_000
#: So many numbers of a ledger's seq are written as one text before a bucket's texts are joined.
BLOCK = 1 << 14


def report_rows(tasks: DataFrame) -> list[dict]:
    """The rows of a report; a list that is too long for one is an error, not a shorter report."""
    rows = tasks.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report holds at most {REPORT_ROWS} rows; write the table instead")
    return [r.asDict() for r in rows]


def html_report(tasks: DataFrame, path: str, title: str) -> None:
    """Cards of ranked tasks with their numbers; texts are escaped."""
    rows = report_rows(tasks)
    counts: dict[str, int] = {}
    for r in rows:
        counts[r["category"]] = counts.get(r["category"], 0) + 1
    tiles = "".join(f"<li>{c}: {counts.get(c, 0)}</li>" for c in ("critical", "C", "B", "A", "expired")) + f"<li>total: {len(rows)}</li>"
    cards = []
    for n, r in enumerate(rows, 1):
        nodes = "".join(f"<p>{html.escape(r[k + '_date'])} ({html.escape(r[k + '_formula'])})</p>" for k in ("node1", "node2") if r[k + "_date"])
        cards.append(f'<section class="{r["category"]}"><h2>#{n:02d} {html.escape(r["name"])}</h2><p>{html.escape(r["ddl"])} {html.escape(r["during_str"])} {html.escape(r["label"])}</p><progress max="1" value="{r["progress"]:.4f}"></progress>{nodes}</section>')
    Path(path).write_text(f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><ul>{tiles}</ul>{"".join(cards)}</body></html>', encoding="utf-8")


def json_array(tasks: DataFrame, path: str) -> None:
    """All tasks in their order; too many for a report are an error here too."""
    from brindle.operators.tasks import to_json

    Path(path).write_text(json.dumps([json.loads(r["json"]) for r in report_rows(to_json(tasks))], ensure_ascii=False, indent=2), encoding="utf-8")


def framed(result: dict) -> str:
    """A result between the marks that callers of a command look for."""
    return f"RESULT_JSON_START\n{json.dumps(result, ensure_ascii=False)}\nRESULT_JSON_END"


def write_state(path: str, status: str, last_update: str, report_path: str | None = None) -> None:
    if status not in ("regenerating", "ready", "error", "unknown"):
        raise ValueError(status)
    Path(path).write_text(json.dumps({"status": status, "last_update": last_update, "report_path": report_path}), encoding="utf-8")


def append_actions(actions: DataFrame, path: str) -> None:
    """Add a ledger's actions (of ledger.route) to its table. Nothing is rewritten: a new total is an action like the others."""
    actions.write.mode("append").parquet(path)


def rewrite_todo(lines: DataFrame, path: str) -> None:
    """Write the lines of todo_lines() in their order to a new path."""
    lines.select(F.col("line").alias("value")).write.text(path)


def ledger_markdown(entries: DataFrame, totals: DataFrame) -> DataFrame:
    """bucket, text: each bucket's ledger file, balances derived.

    Entries are summed, numbered with balances and written as text in blocks of seq; a bucket's task only joins the texts of its blocks.
    """
    from brindle.operators.ledger import balances

    at = ["bucket", "block"]
    e = entries.withColumn("block", F.coalesce(F.expr(f"seq div {BLOCK}"), F.lit(-(1 << 63))))
    before = F.sum("spent").over(Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    opening = e.groupBy(*at).agg(F.sum("amount").alias("spent")).join(totals, "bucket").select(*at, (F.col("total") - F.coalesce(before, F.lit(0))).alias("total"))
    row = F.concat(F.lit("| "), F.col("date"), F.lit(" | "), F.col("memo"), F.lit(" | "), (-F.col("amount")).cast("string"), F.lit(" | "), F.col("balance").cast("string"), F.lit(" |"))
    in_order = lambda by, text: F.transform(F.array_sort(F.collect_list(F.struct(by, text.alias("text")))), lambda r: r["text"])
    rows = balances(e, opening, ["seq"], at).groupBy(*at).agg(F.array_join(in_order("seq", row), "\n").alias("text")).where("text <> ''")
    head = totals.select("bucket", F.lit(None).cast("bigint").alias("block"), F.concat(F.lit("总额："), F.col("total").cast("string"), F.lit("\n\n| 日期 | 摘要 | 金额 | 余额 |\n|---|---|---|---|")).alias("text"))
    # concat_ws makes the whole text once, at its size; a head alone ends its line.
    whole = F.concat_ws("\n", in_order("block", F.col("text")), F.when(F.count("*") == 1, ""))
    return head.unionByName(rows).groupBy("bucket").agg(F.when(F.count("text") == F.count("*"), whole).alias("text"))
