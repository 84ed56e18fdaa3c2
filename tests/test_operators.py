"""Worked examples and edges of the engine's operators."""

import datetime
import json

import pytest
from brindle.functions import bands
from brindle.operators import evalmetrics, ledger, quality, recommend, router, scorecard, tasks, textcheck
from brindle.sources import sinks, text
from brindle.streaming import watch
from pyspark.sql import functions as F

def now():
    return F.lit(datetime.datetime(2026, 4, 9, 8, 11, 17)).cast("timestamp_ntz")


def lines(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "pos long, line string")


@pytest.fixture(scope="module")
def sample(spark):
    return tasks.derive(tasks.good(tasks.parse(tasks.keep_task_lines(lines(spark, "机械原理作业--4/8", "计算机绘图&autocad--4/9", "互换性实验报告--4/8")), now())), now())


def test_sample_list(sample):
    rows = tasks.ranked(sample).collect()
    assert [r["pos"] for r in rows] == [0, 2, 1]
    r = rows[2]
    assert (r["ddl"], r["during_seconds"], r["category"], r["label"], r["during_str"], r["progress"]) == ("04/09 23:59", 56922.0, "C", "紧迫", "余 15时48分", 0.9)
    assert (r["node1_date"], r["node2_date"], r["node1_formula"], r["node2_formula"]) == ("12:11", "15:11", "√16 = 4时", "√12 ≈ 3时")
    assert rows[0]["during_str"] == "已逝 8时11分" and rows[0]["node1_date"] is None and rows[0]["progress"] == 1.0
    c = tasks.counts(sample).first()
    assert (c["C"], c["expired"], c["total"]) == (1, 2, 3)
    assert [r["no"] for r in tasks.numbered(sample).orderBy("no").collect()] == ["01", "02", "03"]


def test_bad_lines(spark):
    good = {"a--4/8--4/9": (4, 9), "a--b--4/8--5/1": None, "a--4/13~4/16": (4, 16), "a--4/8/2027": (4, 8)}
    bad = ["x--abc", "x--4-8", "x--2/29", "x--13/1", "x--"]
    p = {r["line"]: r["deadline"] for r in tasks.parse(tasks.keep_task_lines(lines(spark, "no delimiter", "", *good, *bad)), now()).collect()}
    assert len(p) == len(good) + len(bad)
    assert all(p[b] is None for b in bad)
    assert p["a--4/8--4/9"].day == 9 and p["a--4/13~4/16"].day == 16 and p["a--4/8/2027"].year == 2026 and p["a--b--4/8--5/1"].day == 8
    assert tasks.parse(lines(spark, "x--4-8"), now(), dashes=True).first()["deadline"].day == 8


D, H = 86400, 3600
EDGES = [(0, "expired"), (1e-6, "critical"), (4 * H - 1, "critical"), (4 * H, "C"), (24 * H, "C"), (2 * D, "C"), (2 * D + 1, "B"), (4 * D, "B"), (4 * D + 1, "A"), (7 * D - 1, "A"), (7 * D, "C"), (21 * D, "C"), (21 * D + 1, "B"), (63 * D, "B"), (63 * D + 1, "A"), (84 * D, "A"), (84 * D + 1, "long_term")]


def test_band_edges_and_no_gap(spark):
    got = spark.createDataFrame([(float(s), c) for s, c in EDGES], "s double, want string").select("want", bands.band(F.col("s")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    assert spark.range(0, 8_000_000, 131).where(bands.band(F.col("id").cast("double")) == "out").count() == 0


def test_milestones(spark):
    nine = F.lit(datetime.datetime(2026, 4, 15)).cast("timestamp_ntz")
    m = bands.milestones(F.lit(9.0 * D), nine)
    r = spark.range(1).select(m.first, m.second, m.first_formula, m.second_formula).first()
    assert tuple(r) == ("4/18", "4/20", "√9 = 3日", "√6 ≈ 2日")
    evening = F.lit(datetime.datetime(2026, 4, 15, 19)).cast("timestamp_ntz")
    m = bands.milestones(F.lit(12.0 * H), evening)
    assert tuple(spark.range(1).select(m.first, m.second).first()) == ("22:00", "4/16 01:00")
    m = bands.milestones(F.lit(12.0 * H), evening, days_only=True)
    assert tuple(spark.range(1).select(m.first, m.second).first()) == (None, None)
    m = bands.milestones(F.lit(2.5 * D), nine)  # halves go to the even number
    assert spark.range(1).select(m.first_formula).first()[0] == "√2 ≈ 1日"


def test_todo(spark):
    got = tasks.todo_lines(lines(spark, "# note", "", "b--4/9", "a--4/8", "b--4/12"), now()).collect()
    assert [r["line"] for r in got] == ["# note", "a--4/8", "b--4/12"]


def test_read_back_and_sinks(spark, sample, tmp_path):
    data = json.dumps({"total_tasks": 3, "categories": {"C类": 2, "B类": 1}, "tasks": [{"during_hours": h, "category": c} for h, c in ((-1, "C类"), (5, "C类"), (100, "B类"))]}, ensure_ascii=False)
    assert tuple(tasks.read_back(spark.createDataFrame([(data,)], "value string")).first()) == (3, 1, 2, 1)
    ranked = tasks.ranked(sample)
    sinks.html_report(ranked, str(tmp_path / "r.html"), "报告")
    page = (tmp_path / "r.html").read_text("utf-8")
    assert "计算机绘图&amp;autocad" in page and "#01" in page and "expired: 2" in page
    sinks.json_array(ranked, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text("utf-8"))[2] == {"name": "计算机绘图&autocad", "ddl": "04/09 23:59", "remaining": "余 15时48分", "category": "紧迫"}
    sinks.write_state(str(tmp_path / "s.json"), "ready", "2026-04-09T08:11:17", None)
    states = spark.read.schema("status string, last_update string").json(str(tmp_path / "s.json"))
    assert watch.alive(states, datetime.datetime(2026, 4, 9, 8, 16, 16)).first()["alive"] is True
    assert watch.alive(states, datetime.datetime(2026, 4, 9, 8, 16, 17)).first()["alive"] is False
    assert sinks.framed({"a": 1}).split("\n")[1] == '{"a": 1}'


def commands(spark, *rows):
    return ledger.route(spark.createDataFrame(list(enumerate(rows)), "seq int, text string"))


def shown(spark, *rows):
    totals, entries = ledger.state(commands(spark, *rows))
    return {r["bucket"]: (int(r["total"]), int(r["used"]), int(r["remaining"]), r["show_used"]) for r in ledger.cards(entries, totals, ledger.envelopes(spark)).collect()}


def test_ledger(spark):
    start = "money A:3000 B:3000 C:2000 D:2000"
    assert shown(spark, start) == {"A": (3000, 0, 3000, False), "B": (3000, 0, 3000, False), "C": (2000, 0, 2000, False), "D": (2000, 0, 2000, False)}
    post = "早餐-10-a 午餐-25-A 房租-2900-A"
    totals, entries = ledger.state(commands(spark, start, post))
    assert [int(r["balance"]) for r in ledger.balances(entries, totals, ["seq", "place"]).orderBy("place").collect()] == [2990, 2965, 65]
    assert shown(spark, start, "早餐-10-A", "删除 早餐-10-A")["A"] == (3000, 0, 3000, False)
    assert shown(spark, start, post, "money A:5000")["A"] == (5000, 0, 5000, False)
    assert shown(spark, start, "退款--30-D", "饭-5-B")["D"] == (2000, -30, 2030, True)
    assert shown(spark, "money: A:10", "x-12-A")["A"] == (10, 12, -2, True)
    assert commands(spark, "what").first()["action"] == "bad"
    card = ledger.card_text(ledger.cards(entries, totals, ledger.envelopes(spark))).where("bucket = 'A'").first()["card"]
    assert "A · 生活" in card and "已用：2935.00" in card


def test_ledger_files(spark, tmp_path):
    (tmp_path / "A.md").write_text("总额：3000\n\n| 日期 | 摘要 | 金额 | 余额 |\n|---|---|---|---|\n| 04/09 | 早餐 | -10 | 2990 |\n| 04/09 | 退款 | 30 | 3020 |\n", "utf-8")
    read = text.lines(spark, str(tmp_path))
    totals, entries = text.ledger(read)
    assert [(r["memo"], int(r["amount"])) for r in entries.orderBy("seq").collect()] == [("早餐", 10), ("退款", -30)]
    again = sinks.ledger_markdown(entries, totals).first()["text"]
    assert "| 04/09 | 退款 | 30.00 | 3020.00 |" in again
    both = quality.same_content(read, text.contents(spark, str(tmp_path)))
    assert both.first()["same"] is True and both.first()["lines"] == 6
    files = text.inventory(spark, str(tmp_path)).collect()
    assert [(r["seq"], r["name"]) for r in files] == [(1, "A.md")]
    assert text.folders(spark, str(tmp_path)).first()["name"] == tmp_path.name


def test_recommend(spark):
    t = spark.createDataFrame([("x", ["planning"], 5, 8, True, "做战略", ["定位"], 2, 6), ("y", ["planning"], 5, 8, False, "", [], 2, 6), ("z", ["sales"], 9, 1, False, "", [], 1, 1), ("w", ["planning"], 9, 1, False, "", [], 1, 1)], "id string, categories array<string>, difficulty int, popularity int, is_common boolean, description string, best_for array<string>, team_lo int, team_hi int")
    a = spark.createDataFrame([(1, "planning", [], "moderate", "small", "strategy"), (2, "multiple", ["sales"], "any", "solo", "none")], "request int, scenario string, multi_scenario array<string>, difficulty_preference string, team_context string, specific_need string")
    s = recommend.score(t, a, {"strategy": ["战略", "规划"]})
    got = {(r["request"], r["id"]): r["score"] for r in s.collect()}
    assert got[1, "x"] == 3 + 2 + 1 + 3 + 0.8 + 0.5 and got[1, "y"] == 6.8 and got[2, "z"] == 3 + 1 + 1 + 0.1
    assert [r["id"] for r in recommend.top(s).where("request = 1").orderBy("rank").collect()] == ["x", "y", "w"]
    assert [r["id"] for r in recommend.diverse(s).where("request = 1").orderBy("rank").collect()] == ["x", "y", "z"]
    assert recommend.low_match(s, 5.1).count() == 1
    q = spark.createDataFrame([("a", None), ("b", "scenario=multiple")], "question_id string, trigger string")
    m = spark.createDataFrame([(1, {"scenario": "x"}), (2, {"scenario": "multiple"})], "request int, answers map<string,string>")
    assert sorted(map(tuple, recommend.next_questions(q, m).collect())) == [(1, "a"), (2, "a"), (2, "b")]


def test_scorecard(spark):
    g = scorecard.gates(spark.createDataFrame([(1, 1, 9, 9), (1, 2, 9, 8), (1, 3, 7, 10)], "audit int, element int, reliability int, validity int"))
    assert [(r["red"], r["yellow"], r["passed"]) for r in g.orderBy("element").collect()] == [(False, False, True), (True, False, False), (True, True, False)]
    assert tuple(scorecard.dashboard(g, ["audit"]).first()) == (1, 0.333333, 2, 1, 3)
    p = spark.createDataFrame([(1, 8, 8, 8, 8, 8), (2, 9, 8, 8, 8, 8)], "id int, channel int, practice int, reliability int, validity int, fit int")
    assert [r["id"] for r in scorecard.admit(p).collect()] == [2]
    steps = spark.createDataFrame([(1, 1, "", "a", 2, 15), (1, 2, "a", "b", 2, 60), (1, 3, "b", "c", 2, 60), (2, 1, "", "a", 3, 16), (2, 2, "x", "b", 1, 1)], "plan_id int, step int, input string, output string, granularity int, minutes int")
    assert [tuple(r) for r in scorecard.plan_checks(steps).orderBy("plan_id").collect()] == [(1, 3, True, True, True, True), (2, 2, False, False, False, False)]


def test_textcheck(spark):
    src = spark.createDataFrame([(1, "# T\nB0-1-2-3 text 「x」「y」「z」「w」\n```\n# code\n```\n- item\n#### deep\n| a |")], "doc_id int, text string")
    b = textcheck.blocks(src).orderBy("pos").collect()
    assert [(r["kind"], r["level"]) for r in b] == [("heading", 1), ("paragraph", 0), ("code", 0), ("list", 0), ("heading", 4), ("table", 0)]
    good = spark.createDataFrame([(1, "<h2>T</h2><p>B0-1-2-3 text 「x」「y」「z」「w」 # code - item</p>```<h5>deep</h5>``` | a |")], "doc_id int, text string")
    assert textcheck.lossless(src, good).first()["lost_ids"] == 0
    assert textcheck.lossless(src, spark.createDataFrame([(1, "<h2>T</h2>")], "doc_id int, text string")).first()["ok"] is False
    assert textcheck.missing_ids(src, good.withColumn("text", F.lit("B0-1"))).first()["id"] == "B0-1-2-3"
    c = textcheck.marker_counts(src).first()
    assert c["m0"] == 4 and not c["each_ok"]
    h = spark.createDataFrame([(f"B0-1-{k}", 2) for k in range(4)] + [("B0-1", 3)], "id string, steps int")
    assert {r["parent"]: r["ok"] for r in textcheck.hierarchy(h).collect()} == {"B0-1": False, "B0": True}
    col = spark.createDataFrame([(1, "color:#fff"), (2, "#fffaf0"), (3, "#808080"), (4, "a Gray b"), (5, "#12a4b5")], "doc_id int, text string")
    assert [r["forbidden"] for r in textcheck.forbidden_colours(col).orderBy("doc_id").collect()] == [True, False, True, True, False]


def test_router(spark):
    m = spark.createDataFrame([(k, t) for k, t in enumerate(("ddl: a", "ddltodo:x--4/8", "ddl", "ddlx", " qa: b ", None))], "id int, text string")
    assert [(r["route"], r["args"]) for r in router.route(m).orderBy("id").collect()] == [("tasks", "a"), ("todo", "x--4/8"), ("tasks-mode", None), (None, None), ("questions", "b"), (None, None)]


def test_throttle(spark):
    t0 = datetime.datetime(2026, 1, 1)
    times = [0, 0.6, 1.2, 1.9, 2.3, 2.4]
    e = spark.createDataFrame([("f", t0 + datetime.timedelta(seconds=s)) for s in times], "path string, ts timestamp_ntz")
    assert [(r["ts"] - t0).total_seconds() for r in watch.throttle(e, ["path"], "ts", 1).orderBy("ts").collect()] == [0, 1.2, 2.3]


def test_streams(spark, tmp_path):
    src, t0 = tmp_path / "in", datetime.datetime(2026, 1, 1)
    e = spark.createDataFrame([("f", t0 + datetime.timedelta(seconds=s)) for s in (0, 0.6, 1.2, 1.9, 2.3, 2.4)], "path string, ts timestamp")
    e.coalesce(1).write.parquet(str(src))
    stream = watch.throttle_stream(spark.readStream.schema(e.schema).parquet(str(src)), "path", "ts", 1)
    q = stream.writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [round((r["ts"] - t0).total_seconds(), 1) for r in spark.table("kept").orderBy("ts").collect()] == [0, 1.2, 2.3]
    folder = tmp_path / "tasks"
    folder.mkdir()
    (folder / "tasks_1.txt").write_text("a--4/8\n")
    (folder / "tasks_2.txt").write_text("b--4/9\nc--4/10\n")
    seen, states = [], []
    for _ in range(2):
        watch.watch(spark, str(folder), lambda d, n: seen.append([r["line"] for r in d.where("line <> ''").orderBy("pos").collect()]), states.append, str(tmp_path / "w")).awaitTermination(120)
        (folder / "tasks_3.txt").write_text("d--4/11\n")
    assert seen == [["b--4/9", "c--4/10"], ["d--4/11"]] and states == ["regenerating", "ready"] * 2


def test_evalmetrics(spark):
    r = spark.createDataFrame([("L1", True)] * 9 + [("L1", False), ("L3", False)], "level string, pass boolean")
    assert {x["level"]: x["gate_ok"] for x in evalmetrics.layered_gate(r).collect()} == {"L1": True, "L3": False}
    same = spark.createDataFrame([(1, 1), (0, 0)], "a int, b int")
    assert evalmetrics.kappa(same, "a", "b").first()[0] == 1.0


def test_all_templates_by_class(spark):
    """The best template comes last by id; answers with a null and repeated ones are served too."""
    rows = [(i, ["planning" if i % 3 else "sales", "sales"], i % 10 + 1, i % 8, False, "", ["k"], 1, 9) for i in range(1, 200)] + [(200, ["planning", "sales"], 3, 30, True, "", ["k"], 1, 9)]
    templates = spark.createDataFrame(rows, "id int, categories array<string>, difficulty int, popularity int, is_common boolean, description string, best_for array<string>, team_lo int, team_hi int")
    answers = spark.createDataFrame([(1, "planning", ["sales"], "simple", "solo", "a"), (2, "planning", ["sales"], "simple", "solo", "a"), (3, "multiple", ["sales"], None, "solo", "b")], "request int, scenario string, multi_scenario array<string>, difficulty_preference string, team_context string, specific_need string")
    needs = {"a": ["k"]}
    classes, members = recommend.by_class(answers)
    assert classes.count() == 2
    some, each = recommend.nominees(templates, classes, needs), recommend.score(templates, answers, needs)
    for choose in (recommend.top, recommend.diverse):
        plain = lambda d: sorted((r["request"], r["rank"], r["id"], r["score"]) for r in d.collect())
        got = plain(recommend.of_members(choose(some), members))
        assert got == plain(choose(each)) and len(got) == 9 and {r[2] for r in got if r[1] == 1} == {200}
    low = lambda d: sorted((r["request"], r["best"]) for r in d.collect())
    assert low(recommend.of_members(recommend.low_match(some, 99.0), members)) == low(recommend.low_match(each, 99.0))


def test_a_json_array_is_whole_or_refused(sample, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "REPORT_ROWS", 3)
    sinks.json_array(tasks.ranked(sample), str(tmp_path / "whole.json"))
    assert len(json.loads((tmp_path / "whole.json").read_text("utf-8"))) == 3
    monkeypatch.setattr(sinks, "REPORT_ROWS", 2)
    with pytest.raises(ValueError):
        sinks.json_array(tasks.ranked(sample), str(tmp_path / "cut.json"))
    assert not (tmp_path / "cut.json").exists()


def test_appended_ledger_and_rewritten_todo(spark, tmp_path):
    path = str(tmp_path / "actions")
    for seq, line in enumerate(["A:100 B:50", "lunch-20-a tea-5-A", "删除 tea-5-A", "book-7-B A:60", "cake-61-A"]):
        sinks.append_actions(ledger.route(spark.createDataFrame([(seq, line)], "seq long, text string")), path)
    actions = spark.read.parquet(path)
    totals, stands = ledger.state(actions)
    assert sorted((r["bucket"], float(r["amount"])) for r in stands.collect()) == [("A", 61.0), ("B", 7.0)]
    assert {r["bucket"]: float(r["total"]) for r in totals.collect()} == {"A": 60.0, "B": 50.0}
    said = [r["line"] for r in ledger.announced(actions, ledger.envelopes(spark)).orderBy("seq", "place").collect()]
    assert said == ["📝 lunch · 生活 -20.00", "📝 tea · 生活 -5.00", "🗑️ 已删除 · tea · 生活 5.00", "📝 book · 学习 -7.00", "📝 cake · 生活 -61.00"]
    page = ledger.card_page(ledger.cards(stands, totals, ledger.envelopes(spark))).first()["page"]
    assert page.count("\n\n") == 3 and page.index("A · 生活") < page.index("C · 储值") < page.index("B · 学习") and page.count("已用尽") == 3
    entries = spark.createDataFrame([("A", 1, "x", 5), ("A", 2, "x", 5), ("A", 3, "y", 1)], "bucket string, seq int, memo string, amount int")
    assert [tuple(r) for r in ledger.deleted(entries, entries.where("seq = 1")).collect()] == [("A", 2)]
    todo = tasks.todo_lines(lines(spark, "# top", "b--4/9", "a--4/8"), now(), lines(spark, "b--4/30", "c--4/1"))
    sinks.rewrite_todo(todo, str(tmp_path / "todo"))
    written = [x for f in sorted((tmp_path / "todo").glob("part-*")) for x in f.read_text().splitlines()]
    assert written == ["# top", "c--4/1", "a--4/8", "b--4/30"]


def test_broadcast_only_what_is_counted(spark):
    from brindle.functions.sizes import small

    plan = lambda n: spark.range(50).crossJoin(small(spark.range(n), 10))._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(10) and "broadcast" not in plan(11)


def test_throttle_of_one_key_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        e = spark.range(1000).select(F.lit("k").alias("k"), F.lit(1).alias("j"), F.timestamp_micros(F.col("id") * 300_000).alias("t")).union(spark.sql("select null, 1, timestamp_micros(5L) union all select 'k', 1, null"))
        got = watch.throttle(e, ["k", "j"], "t", 1).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len([r for r in got if r["k"] == "k"]) == 250 and len(got) == 251


def test_priorities_and_t_test(spark):
    cells = spark.createDataFrame([("L1", 0.9), ("L2", 0.59), ("L1", 0.3), ("L3", 0.6), ("L1", 0.79)], "level string, pass_rate double")
    assert [(r["colour"], r["level"]) for r in evalmetrics.priorities(cells).orderBy("turn", "pass_rate").collect()] == [("red", "L1"), ("red", "L2"), ("yellow", "L1"), ("yellow", "L3"), ("green", "L1")]
    values = [(0, v, False) for v in (1.0, 2.0, 3.0, 4.0)] + [(0, v, True) for v in (2.0, 4.0, 6.0, 8.0)] + [(1, 1.0, False), (1, 1.0, True)]
    got = {r["g"]: r for r in evalmetrics.t_test(spark.createDataFrame(values, "g int, v double, run boolean"), ["g"], "run", "v").collect()}
    assert abs(got[0]["t"] - 1.7320508) < 1e-6 and abs(got[0]["freedom"] - 4.4117647) < 1e-6 and got[1]["t"] is None


def test_rules_and_folded(spark, sample, tmp_path):
    (tmp_path / "rules.json").write_text('[{"id": 1, "name": "a"},\n {"id": 2}]', encoding="utf-8")
    assert [tuple(r) for r in text.rules(spark, str(tmp_path / "rules.json"), "id int, name string").orderBy("id").collect()] == [(1, "a"), (2, None)]
    assert sorted((r["pos"], r["folded"]) for r in tasks.folded(sample).collect()) == [(0, True), (1, False), (2, True)]


def test_a_ledger_file_is_written_in_blocks(spark, monkeypatch):
    """No task but a block's holds single entries: a bucket's joins the texts of its blocks, whose balances go on from block to block."""
    totals = spark.sql("select bucket, cast(total as decimal(18,2)) as total from values ('A', 1000), ('B', 5), ('N', null) as t(bucket, total)")
    at = [None, *range(-9, 27)]
    entries = spark.createDataFrame([("A", s, f"d{k}", None if k == 20 else "m", k) for k, s in enumerate(at)][::-1] + [("B", 5, "d", "m", None), ("Z", 5, "d", "m", 1), ("N", 5, "d", "m", 1)], "bucket string, seq long, date string, memo string, amount int")
    entries = entries.withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    monkeypatch.setattr(sinks, "BLOCK", 4, raising=False)
    found = sinks.ledger_markdown(entries, totals)
    steps = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "collect_list" in x]
    assert len(steps) == 2 and all("block" in x for x in steps)
    head = "总额：{}.00\n\n| 日期 | 摘要 | 金额 | 余额 |\n|---|---|---|---|\n"
    rows = [f"| d{k} | m | {-k}.00 | {1000 - sum(range(k + 1))}.00 |" for k in range(len(at)) if k != 20]
    assert {r["bucket"]: r["text"] for r in found.collect()} == {"A": head.format(1000) + "\n".join(rows), "B": head.format(5), "N": None}


def test_nominees_are_kept_without_sorting_the_pairs(spark):
    """Ties, nulls and NaN rank as in top(), and no task sorts or holds the pairs of templates and classes."""
    values = [0.0, 1.0, None, float("nan"), 1.0]
    rows = [(f"t{i:03}", ["planning", "sales"] if i % 3 else [None, "sales"], i % 10 + 1, values[i % 5], [True, False, None][i % 7 % 3], "", ["k"], 1, 9) for i in range(90)]
    templates = spark.createDataFrame(rows, "id string, categories array<string>, difficulty int, popularity double, is_common boolean, description string, best_for array<string>, team_lo int, team_hi int")
    kinds = [("planning", "simple", "a"), ("multiple", None, "b"), ("sales", "any", None)]
    answers = spark.createDataFrame([(n, s, ["sales"], d, "solo", q) for n, (s, d, q) in enumerate(kinds)], "request int, scenario string, multi_scenario array<string>, difficulty_preference string, team_context string, specific_need string")
    # One with every score null or NaN besides, where only the order of these decides.
    for pick in (F.lit(True), F.col("popularity").isNull(), F.isnan("popularity") | F.col("popularity").isNull()):
        some = templates.where(pick)
        classes, members = recommend.by_class(answers)
        found, each = recommend.nominees(some, classes, {"a": ["k"]}), recommend.score(some, answers, {"a": ["k"]})
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Sort " not in plan and "Window" not in plan
        for choose in (recommend.top, recommend.diverse):
            plain = lambda d: sorted((r["request"], r["rank"], r["id"], str(r["score"])) for r in d.collect())
            assert plain(recommend.of_members(choose(found), members)) == plain(choose(each))


def test_equal_points_of_a_front_stay_together(spark):
    nan = float("nan")
    rows = [("a", 1.0, 5.0), ("a", 1.0, 5.0), ("a", 1.0, 4.0), ("a", 2.0, 5.0), ("a", 3.0, 7.0), ("a", 3.0, 7.0), ("a", 4.0, nan), ("a", nan, nan), ("b", 0.0, 1.0), ("b", -0.0, 1.0), ("b", None, 9.0), ("b", None, 0.0), ("b", 2.0, None), (None, 1.0, 1.0), (None, 2.0, 0.0)]
    points = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, g string, cost double, quality double")
    found = evalmetrics.pareto(points, ["g"])
    assert found.columns == points.columns
    assert sorted(r["id"] for r in found.collect()) == [0, 1, 4, 5, 6, 8, 9, 10, 11, 12, 13, 14]
    import duckdb

    db = duckdb.connect()
    db.execute("create table p (id int, g varchar, cost double, quality double)")
    db.executemany("insert into p values (?, ?, ?, ?)", [(k, *r) for k, r in enumerate(rows)])
    want = db.execute("select id from p a where not exists (select 1 from p b where b.g = a.g and (b.cost < a.cost and b.quality >= a.quality or b.cost = a.cost and b.quality > a.quality)) order by id").fetchall()
    assert [x for (x,) in want] == sorted(r["id"] for r in found.collect())
    assert sorted(r["id"] for r in evalmetrics.pareto(points.where("g = 'a'"), []).collect()) == [0, 1, 4, 5, 6]
