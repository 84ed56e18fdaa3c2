"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import json
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
from brindle.llm import ann, chat, components, decontam, html, jaccard, langid, names, packing, pii, suffixdedup, tokenbin
from brindle.llm.common import lean, process_cache
from pyspark.sql import functions as F

ROOT = Path(__file__).parent.parent.parent
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, _block int, rep long, spans string, lang_pred string, _row string, score int"


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeé日") for _ in range(rng.randint(2, 7))) for _ in range(120)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = make(14)
    out = [None, "", " \n\t ", "a", "A b", "a B c d", "!!! ...", "x" * 49, "x" * 50, "y" * 3000, "ab" * 400, "long " * 4000]
    base = [make(rng.randint(20, 90)) for _ in range(12)]
    for b in base:
        w = b.split()
        out += [b, b, b.upper() if b.isascii() else b, " ".join(w[:-1]), " ".join([*w, "more"]), b.replace(w[3], "zz", 1), f"{make(30)} {passage} {make(9)}", passage]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, None if i % 4 == 0 else "en", f"s{i % 3}", None, 7, 1, -1, "x", "y", "z", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[20]], DOCS).repartition(5)  # one row twice


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(texts):
    return {i * 3: t for i, t in enumerate(texts)}


def test_decontamination(spark, docs, texts, empty):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x))
    rng = random.Random(3)
    items = [(10, None), (11, ""), (12, "a"), (2, "B c"), (3, "?!")] + [(20 + k, " ".join(words(t)[2:16])) for k, t in enumerate(rng.sample([t for t in texts if t and len(t) > 200], 6))]
    items += [items[-1]]
    benchmark = spark.createDataFrame([(i, t, i) for i, t in items], "item_id long, text string, doc_id long")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[k : k + 10])].add(i)
    want = {}
    for d, t in by_id(texts).items():
        w, hit, found = words(t), set(), set()
        for win, who in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    found |= who
                    hit |= set(range(k, k + len(win)))
        want[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(found))
    for part in (1 << 25, 150):
        got = decontam.summary(decontam.matches(docs, benchmark, part_bytes=part)).collect()
        assert sorted(map(tuple, got)) == sorted([(d, *x) for d, x in want.items()] + [(60, *want[60])])
    kept = decontam.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, x in want.items() if not x[-1]}
    assert decontam.matches(empty, benchmark).count() == 0
    assert decontam.decontaminate(docs, benchmark.limit(0)).count() == docs.count()


def test_decontamination_keeps_each_row_with_any_number_of_parts(spark):
    benchmark = spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(12))) for k in range(6)], "item_id long, text string")
    hit = " ".join(f"w2x{i}" for i in range(12))
    d = spark.createDataFrame([(1, hit), (1, hit), (None, hit), (None, hit.replace("x", "y")), (2, None), (2, None)], "doc_id long, text string")
    rows = [sorted(decontam.summary(decontam.matches(d, benchmark, part_bytes=part)).collect(), key=repr) for part in (1 << 25, 60)]
    assert rows[0] == rows[1] and len(rows[1]) == 6 and sum(r["contaminated"] for r in rows[1]) == 3


WORKER = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[2]).config("spark.executorEnv.PYTHONPATH", "").getOrCreate()
from brindle.llm import decontam, langid
d = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven", "en")], "doc_id long, text string, lang string")
b = spark.createDataFrame([(5, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
print(decontam.matches(d, b).first()["matches"][0]["length"], langid.predict(d, langid.train(d)).first()["lang_pred"])
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    said = subprocess.run([sys.executable, "-c", WORKER, str(ROOT), str(tmp_path)], capture_output=True, text=True, cwd=tmp_path)
    assert said.stdout.split() == ["10", "en"], said.stderr[-2000:]


MEMORY = """
import random, re, sys
sys.path.insert(0, sys.argv[1])
from pathlib import Path
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[2]).getOrCreate()
import public_tokenizers
from brindle.llm import packing
random.seed(3)
words = ["".join(random.choices("abcdefghij", k=8)) for _ in range(50_000)]
Path(sys.argv[2], "d.txt").write_text("\\n".join(" ".join(random.choices(words, k=500)) for _ in range(6000)))
d = spark.read.text(sys.argv[2] + "/d.txt").selectExpr("monotonically_increasing_id() as doc_id", "value as text")

def probe(batches):
    import pyarrow as pa
    mb = sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) // 1024
    for _ in batches:
        yield pa.RecordBatch.from_pydict({"mb": pa.array([mb], pa.int64())})

packing.cut(d, public_tokenizers.path("word_bpe_49k.json")).write.format("noop").mode("overwrite").save()
print(max(spark.range(1).coalesce(1).mapInArrow(probe, "mb long").collect()[0][0] for _ in range(3)))
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="reads the kernel's figures")
def test_workers_give_memory_back(tmp_path):
    said = subprocess.run([sys.executable, "-c", MEMORY, str(ROOT), str(tmp_path)], capture_output=True, text=True, cwd=tmp_path, timeout=300)
    assert said.stdout.split(), said.stderr[-2000:]
    assert int(said.stdout) < 130, said.stdout


def test_tasks_drop_the_caches_of_other_operators():
    held = {"ids": process_cache("ids"), "others": process_cache("others")}
    for x in held.values():
        x["key"] = 1
    assert list(lean([1, 2], ("ids",))) == [1, 2] and "key" in held["ids"] and not held["others"]
    assert list(lean([])) == [] and not held["ids"]


def test_longest_matches_span_windows(spark):
    d = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)))], "doc_id long, text string")
    b = spark.createDataFrame([(5, " ".join(f"w{i}" for i in range(8, 30)))], "item_id long, text string")
    assert [tuple(m) for m in decontam.matches(d, b).first()["matches"]] == [(5, 0, 8, 22)]


def test_chat_round_trip_and_machine(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "### x: </turn>\\b\\\\h"), (2, 1, "assistant", None), (2, 0, None, "###### a: b"), (3, 0, "system", ""), (3, 1, "user", "#"), (3, 2, "assistant", "##</turn"), (4, 0, "us:er</turn>", ": x"), (5, 0, "assistant", "a"), (None, 0, "user", "q")]
    t = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    f = chat.format_chats(t)
    got = {r["conv_id"]: r for r in chat.read_chats(f).collect()}
    for c in {r[0] for r in rows}:
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        assert [tuple(x) for x in got[c]["turns"]] == want
        assert "".join(s["text"] for s in got[c]["segments"]) == got[c]["formatted"]
    assert {c: r["valid"] for c, r in got.items()} == {1: True, 2: False, 3: True, 4: False, 5: False, None: False}
    s = {r["conv_id"]: r for r in chat.summary(f).collect()}
    assert s[1]["loss_sha256"] == hashlib.sha256(rows[1][3].encode()).hexdigest() and s[1]["loss_chars"] == len(rows[1][3])
    assert chat.summary(chat.format_chats(t.limit(0))).count() == 0


def luhn(d):
    return sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def test_personal_data(spark, docs, empty):
    rng = random.Random(4)
    parts = ["a@b.co", "x@y", "a@b.c@d.ef", "a.b@c.d_e@f.gh", "@", "1.2.3.4", "256.1.1.1", "001.2.3.0004", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "+49 (30) 1234-567", "+1 2", "+1234567890123456", "🙂", "é", " ", " ", "\n", "9", "-", ".", "+"]
    texts = [None, "", "1" * 100_000, "a" * 100_000, "1 " * 40_000, "a@" * 20_000, "1." * 20_000] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(800)]
    d = spark.createDataFrame([(i, t, "c", "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, _row string, kind int").repartition(4)
    got = {r["doc_id"]: r for r in pii.summary(pii.find(d)).collect()}
    for i, t in enumerate(texts):
        base = [(k, m.start(), m.end()) for k, p, ok in BASE for m in re.finditer(p, t or "") if ok(m[0])]
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        assert set(said.split(",")) <= set(got[i]["spans"].split(",")) | {""}
    assert pii.find(empty).count() == 0
    r = pii.redact(d)
    assert r.columns == d.columns and r.count() == len(texts)
    out = {x["doc_id"]: x["text"] for x in r.collect()}
    assert out[0] is None and out[1] == "" and not any(re.search(BASE[0][1], x) for x in out.values() if x)


def test_bootstrap_discovers(spark):
    seeds = [(i, f"call Rufnummer: +49 30 {1000000 + i} now") for i in range(8)] + [(50 + i, f"+49 30 {2000000 + i} ist privat") for i in range(8)]
    unseen = [(100, "die Rufnummer: 030/5551234 heute"), (101, "die Menge 030/5551234 heute"), (102, "ohne"), (103, "Rufnummer: 030 555 12 34"), (104, "unter 030-5551234 ist man da")]
    unseen += [(105, "Rufnummer: " + "(" * 50 + "030" + "-" * 60 + "5551234"), (106, "Rufnummer: x030/5551234 und Rufnummer: 030/5551234x")]
    d = spark.createDataFrame(seeds + unseen, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.summary(pii.find(d)).collect()}
    assert got[100] == "phone:15:26" and got[101] == "" and got[102] == "" and got[103] == "phone:11:24" and got[104] == "phone:6:17"
    assert got[105] == "" and got[106] == ""
    out = {r["doc_id"]: r["text"] for r in pii.redact(d).collect()}
    assert out[100] == "die Rufnummer: [phone] heute" and out[103] == "Rufnummer: [phone]" and out[104] == "unter [phone] ist man da"


def test_bootstrap_finds_unseen_identifiers_in_real_documents(spark):
    """Numbers in forms that the base patterns miss, planted in real texts where base ones stand."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("text is not null").orderBy("doc_id").collect()
    rng = random.Random(5)
    planted, made = {}, []
    for r in rows:
        words = r["text"].split(" ")
        at = rng.randrange(len(words) + 1)
        if r["doc_id"] % 50 == 1:
            words[at:at] = ["Kontakt:", f"+49 40 {rng.randrange(10**6, 10**7)}"]
        elif r["doc_id"] % 50 == 2:
            before = " ".join([*words[:at], "Kontakt: "])
            number = f"040/{rng.randrange(10**6, 10**7)}"
            planted[r["doc_id"]] = f"phone:{len(before)}:{len(before) + len(number)}"
            words[at:at] = ["Kontakt:", number]
        made.append((r["doc_id"], " ".join(words)))
    found = {r["doc_id"]: r for r in pii.summary(pii.find(spark.createDataFrame(made, "doc_id long, text string"))).collect()}
    assert len(planted) > 10 and all(span in found[d]["spans"].split(",") for d, span in planted.items())
    more = {d for d, r in found.items() if hashlib.sha256(r["spans"].encode()).hexdigest() != r["base_sha256"]}
    assert more == set(planted)


def test_personal_data_of_very_many_matches(spark):
    d = spark.createDataFrame([(1, "a@b.co, " * 20_000), (2, "1 " * 40_000 + "x"), (3, "1 (" * 30_000), (4, "tel 12-34" * 10_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.summary(pii.find(d)).collect()}
    said = ",".join(f"email:{8 * k}:{8 * k + 6}" for k in range(20_000))
    assert got[1]["n_email"] == 20_000 and got[1]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[1]["spans"] == said
    assert {r["doc_id"]: r["text"] for r in pii.redact(d).collect()}[1] == "[email], " * 20_000


def removed(texts, length=50):
    seen, out = {}, {}
    for d, t in sorted(by_id(texts).items()):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen.setdefault(b[i : i + length], d) < d:
                gone[i : i + length] = b"\1" * length
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_suffix_dedup(docs, texts, empty, monkeypatch):
    want = removed(texts)
    for size in (1 << 20, 1500):
        monkeypatch.setattr(names.Blocks.__init__, "__defaults__", (size, 0))
        got = suffixdedup.summary(suffixdedup.repeats(docs)).collect()
        assert sorted(map(tuple, got)) == sorted([(d, *x) for d, x in want.items()] + [(60, *want[60])])
    assert suffixdedup.repeats(empty).count() == 0


def test_suffix_dedup_of_repeated_and_clashing_rows(spark):
    a, b = "a passage that is longer than fifty bytes, as it has to be here", "another text, also longer than fifty bytes, to have two of them"
    rows = [(1, a), (1, a), (1, a), (2, a), (2, a), (3, b), (3, a + b), (4, b), (5, None), (5, None), (5, ""), (None, a)]
    got = suffixdedup.summary(suffixdedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    la, lb = len(a), len(b)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in got) == sorted([(1, la, 0)] * 3 + [(2, la, la)] * 2 + [(3, lb, 0), (3, la + lb, la), (4, lb, lb)] + [(5, 0, 0)] * 3)


def groups(texts):
    return groups_of(by_id(texts))


def groups_of(texts):
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {d: d for d in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {d: (len(sets[d]), label[d]) for d in sets}


def test_jaccard_join(docs, texts, empty, monkeypatch):
    want = groups(texts)
    for size in (1 << 20, 1500):
        monkeypatch.setattr(names.Blocks.__init__, "__defaults__", (size, 0))
        got = jaccard.near_duplicates(docs).collect()
        assert sorted(map(tuple, got)) == sorted([(d, *x) for d, x in want.items()] + [(60, *want[60])])
    assert jaccard.near_duplicates(empty).count() == 0


def test_jaccard_join_of_repeated_and_clashing_rows(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, a), (1, a), (2, a), (3, a), (3, a), (7, b), (7, a + " x"), (8, b + " y"), (9, None), (9, None), (9, ""), (10, ""), (None, a)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # Both texts of 7 are linked, each with its own group.
    assert sorted(map(tuple, got)) == sorted([(1, 36, 1)] * 2 + [(2, 36, 1), (3, 36, 1), (3, 36, 1), (7, 36, 7), (7, 37, 1), (8, 37, 7), (9, 0, 9), (9, 0, 9), (9, 0, 9), (10, 0, 10)])


def test_jaccard_join_of_texts_just_below_the_threshold(spark):
    """Short texts of one template: none are linked, and no pair of them is counted but with the leader."""
    common = " ".join(f"c{k}" for k in range(20))
    made = [(i, f"{common} x{i} y{i} z{i}") for i in range(5000)] + [(5000 + i, f"{common} u{i // 2} v{i // 2} w{i % 2}") for i in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    want = groups_of({i: t for i, t in made[:60] + made[5000:]})
    assert all(got[i] == i for i in range(5000)) and all(got[d] == want[d][1] for d in range(5000, 5040))


def test_jaccard_join_of_excerpts_and_mixed_sizes(spark):
    """Excerpts of one long text, with changes: links among texts of one leader that the leader does not make."""
    rng = random.Random(8)
    long = [f"w{i}" for i in range(600)]
    made = []
    for i in range(150):
        at, n = rng.randrange(0, 500), rng.choice([12, 30, 60, 90])
        w = long[at : at + n]
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(12)}"
        made.append((i, " ".join(w)))
    made.append((999, " ".join(long)))
    got = sorted(map(tuple, jaccard.near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).collect()))
    assert got == sorted((d, *x) for d, x in groups_of(dict(made)).items())


def test_fragments_are_intervals_of_the_order(spark):
    d = spark.createDataFrame([(i, f"{'all of these have this in them ' if i % 2 == 0 else ''}{' '.join(f'g{i // 4}k{k}' for k in range(12))} end{i}") for i in range(64)], "doc_id long, text string")
    _, texts = jaccard.features(d, 5, 80)
    rows = texts.collect()
    assert {p["f"] for r in rows for p in r["parts"]} == {0, 1, 4}  # shingles that 2 to 3, 4 to 7 and 32 to 63 texts have
    sets = {r["node"]: {s for p in r["parts"] for s in p["seg"]} for r in rows}
    a, b = rows[0]["node"], max((n for n in sets if n != rows[0]["node"]), key=lambda n: len(sets[n] & sets[rows[0]["node"]]))
    found = jaccard.measured(spark.createDataFrame([(a, b)], "a long, b long"), texts).first()
    assert found["o"] == len(sets[a] & sets[b]) and {m["s"] for m in found["more"]} == sets[a] - sets[b]


def test_jaccard_chain_around_the_threshold(spark):
    """Texts that drift apart word by word: neighbours link, ends don't, and the component holds them all."""
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(30):
        w = base.copy()
        for j in range(k):
            w[(j * 7) % 120] = f"v{j}"
        texts.append(" ".join(w))
    random.Random(2).shuffle(texts)
    d = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: tuple(r)[1:] for r in jaccard.near_duplicates(d).collect()} == groups(texts)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(2001, 2000)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + k: 1000 for k in range(50)}, 2000: 2000, 2001: 2000}


def test_language_id(spark, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("score", F.lit("clash"))
    model = langid.train(d.where(~langid.held_out()))
    got = langid.predict(d, model).where(langid.held_out()).select("lang", "lang_pred", "rejected").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert np.mean([r["rejected"] for r in got]) < 0.01
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (4, "the"), (5, "日本語のテキスト" * 30), (6, "der " * 50_000), (7, "²½Ⅷ①"), (8, "\u0301\u094d")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert langid.clean("हिन्दी, 12 Ⅷ") == "हिन्दी" and langid.predict(odd, model, keep_text=False).columns == ["doc_id", "lang_pred", "score", "rejected"]
    assert [out[k]["lang_pred"] for k in (1, 2, 3, 7, 8)] == ["und"] * 5 and out[5]["rejected"] and out[4]["lang_pred"] == "en" and not out[4]["rejected"]
    assert langid.train(empty) is None and langid.train(d.withColumn("lang", F.lit(None).cast("string"))) is None
    assert langid.predict(odd, None).where("lang_pred = 'und' and rejected").count() == 8
    assert langid.predict(empty, model).count() == 0


def test_language_id_of_very_many_languages_and_repeats(spark):
    """No language is too rare to be predicted, and a row that is repeated very often takes no other row's place."""
    made = [(i, " ".join(f"{chr(0x4E00 + i)}{chr(0x4E00 + (7 * i + k) % 300)}" for k in range(20)), f"x{i:03d}") for i in range(300)] + [(9, "a row that is here very often", "zz")] * 3000
    d = spark.createDataFrame(made, "doc_id long, text string, lang string").repartition(4)
    model = langid.train(d)
    assert len(model.languages) == 301
    assert langid.predict(d, model).where("lang <> lang_pred").count() == 0


def test_language_id_rejects_after_short_texts_only(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(d.where(~langid.held_out()).withColumn("text", F.substr("text", F.lit(1), F.lit(100))))
    assert (model.limits > 0).all() and (np.diff(model.limits, axis=1) >= 0).all()
    odd = spark.createDataFrame([(k, t) for k, t in enumerate(["日本語のテキスト" * 30, "日本語のテキスト", "Ελληνικά κείμενα εδώ " * 400])], "doc_id long, text string")
    assert langid.predict(odd, model).where("rejected").count() == 3
    got = langid.predict(d, model).where(langid.held_out()).select("lang", "lang_pred", "rejected").collect()
    assert np.mean([r["rejected"] for r in got]) < 0.01
    assert langid.filled(np.array([np.inf, 0.3, np.inf, 0.2, np.inf, np.inf, 0.4, np.inf])).tolist() == [0.2, 0.2, 0.2, 0.2, 0.2, 0.4, 0.4, 0.4]


def test_packing(docs, texts, empty):
    path = P.path("word_bpe_49k.json")
    pieces = packing.cut(docs, path).withColumn("_salt", F.lit("clash"))
    rows = [r.asDict() for r in packing.pack(pieces).collect()]
    from brindle.llm.tok import load

    ids = {d: np.array(load(path).encode(t or "", add_special_tokens=False).ids + [1], "<u4") for d, t in by_id(texts).items()}
    for r in rows:
        x = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(x) == r["length"] <= 4096 and zlib.crc32(x.tobytes()) == r["ids_crc32"] and r["start"] == 4096 * r["piece"] and r["_salt"] == "clash"
    twice = ids[20 * 3]
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values())) + len(twice)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.pack(packing.cut(empty, path)).count() == 0


def test_two_for_smallest_fits_more_tightly():
    counts = np.zeros(11, np.int64)
    counts[[7, 2, 3]] = [1, 1, 0]
    counts[[1]] = 2
    assert packing.plan(counts, 10)[0] == ([7, 2, 1], 1)
    counts = np.zeros(101, np.int64)
    counts[[60, 35, 22, 18]] = 1  # 60+35 leaves 5; 22+18 in place of 35 leave none
    assert packing.plan(counts, 100) == [([60, 22, 18], 1), ([35], 1)]
    counts = np.random.default_rng(1).integers(0, 30, 4097)
    counts[0] = 0
    bins = packing.plan(counts)
    used = np.zeros(4097, np.int64)
    for lengths, times in bins:
        assert sum(lengths) <= 4096
        np.add.at(used, lengths, times)
    assert (used == counts).all()
    assert sum(t for _, t in bins) <= 1.005 * (counts * np.arange(4097)).sum() / 4096 + 1


READ = """
import sys
from pyspark.sql import SparkSession
from brindle.llm import tokenbin
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
tokenbin.summary(tokenbin.read(spark, sys.argv[1])).orderBy("start").coalesce(1).write.json(sys.argv[2])
"""


def test_token_files(spark, docs, texts, empty, tmp_path):
    path = P.path("byte_bpe_50k.json")
    out = str(tmp_path / "tokens")
    assert tokenbin.write(docs, path, out, block_ids=500) == out
    from brindle.llm.tok import load

    at, want = 0, []
    rows = sorted(tokenbin.read(spark, out).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted([*by_id(texts), 60])
    for r in rows:
        ids = np.array(load(path).encode(by_id(texts)[r["doc_id"]] or "", add_special_tokens=False).ids + [0], "<u4")
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (at, len(ids), ids.tobytes())
        want.append({"doc_id": r["doc_id"], "start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())})
        at += len(ids)
    # The files alone are enough for another process.
    subprocess.run([sys.executable, "-c", READ, out, str(tmp_path / "read")], check=True, cwd=ROOT, capture_output=True)
    assert [json.loads(x) for f in (tmp_path / "read").glob("*.json") for x in f.read_text().splitlines()] == want
    assert tokenbin.read(spark, tokenbin.write(empty, path)).count() == 0


def test_token_files_of_one_doc_id(spark):
    """A doc_id that most rows have is dealt out all the same, and each of its rows stays."""
    d = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit(1).alias("n"))
    path = tokenbin.write(d, P.path("byte_bpe_50k.json"), block_ids=200)
    rows = sorted(tokenbin.summary(tokenbin.read(spark, path)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted(7 if i % 3 else i for i in range(3000))
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
    parts = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n").alias("n")).collect()
    assert len(parts) > 4 and max(r["n"] for r in parts) < 0.5 * sum(r["n"] for r in parts)


def test_variable_length_coding():
    x = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], np.uint32)
    control, data = tokenbin.put(x)
    assert len(control) == 3 and len(data) == 1 + 1 + 2 + 2 + 3 + 3 + 4 + 4 + 1
    assert (tokenbin.get(control, data, len(x)) == x).all()
    assert tokenbin.get(*tokenbin.put(x[:0]), 0).size == 0


def recall(found, x, queries, top=20):
    """Share of the true nearest among the found: both from matrix x, ids are its rows."""
    hits = 0
    for at in range(0, len(queries), 500):
        some = queries[at : at + 500]
        scores = x[some] @ x.T
        scores[np.arange(len(some)), some] = -np.inf
        best = np.argpartition(-scores, top, axis=1)[:, :top]
        hits += sum(len({*b} & found[q]) for q, b in zip(some.tolist(), best.tolist()))
    return hits / (top * len(queries))


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 12)) + rng.integers(0, 4, 700)[:, None]
    x[50:300] = x[50]  # one vector very often
    x[690:, 9:] = 0  # given without its end
    rows = [(int(i), v.tolist() if i < 690 else v[:9].tolist(), "clash") for i, v in enumerate(x)]
    rows += [(900, None, ""), (901, [0.0] * 12, ""), (902, [float("nan")] * 12, ""), (903, [1.0, None] * 6, ""), (920, [], ""), (None, [1.0], "")]
    v = spark.createDataFrame(rows + rows[:2] + [(1, (x[1] + 9).tolist(), "")], "vec_id long, embedding array<double>, node string")
    got = collections.defaultdict(list)
    for r in ann.nearest(v, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    assert sorted(got) == list(range(0, 700, 20))
    for q, found in got.items():
        s = (x * x[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:20]
        assert len(found) == 20 and all(abs(s[i] - y) < 1e-9 for i, y in found)
        hits += len({i for i, _ in found} & set(order))
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
    assert hits / (20 * len(got)) >= 0.9
    assert ann.nearest(v.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(v.where("vec_id in (0, 1)"), F.col("vec_id") % 20 == 0).collect()[0]["vec_id"] == 1


def test_nearest_neighbours_of_ten_thousand(spark):
    rng = np.random.default_rng(9)
    near = rng.normal(size=(60, 24))
    x = near[rng.integers(0, 60, 10_000)] + 0.8 * rng.normal(size=(10_000, 24))
    v = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = collections.defaultdict(set)
    for r in ann.nearest(v, F.col("vec_id") % 20 == 0).collect():
        found[r["query_id"]].add(r["vec_id"])
    assert recall(found, x, np.arange(0, 10_000, 20)) >= 0.9


PAGE = """<!doctype html><html><head><title>T</title><style>x{}</style></head><body><header class="site-header">Logo <a href=/>Home</a></header>
<nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><div class="cookie notice">We use cookies</div><script>var a="<p>no</p>";</script>
<article><header><h1>Head&amp;line</h1></header><p>First   <b>bold</b> text,<br>with&nbsp;a line.<p>Second <a href=c>linked</a>.</p><!-- gone <p>x</p> --><aside>Related <a href=d>x</a></aside>
<form><label>Mail</label><input name=q></form><ul><li>item one</li><li>item two</li></ul></article><div id="comments"><p>Great post, many words in this reader comment here indeed.</p></div><footer>&copy; us</footer>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "", ""), (4, "v", "plain &lt;text&gt; only, without any mark"), (5, "w", "<p>unclosed <b>bold <i>it"), (6, "x", "<nav>" * 3000 + "<p>deep"), (7, "y", "<script>never closed")]
    p = spark.createDataFrame([(*r, 1) for r in rows + rows[:1]], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in html.extract(p).collect()}
    assert got[1]["text"] == "Head&line\nFirst bold text, with a line.\nSecond linked.\nitem one\nitem two"
    assert got[1]["n_chars"] == len(got[1]["text"])
    assert [got[k]["text"] for k in (2, 3, 6, 7)] == [""] * 4
    assert got[4]["text"] == "plain <text> only, without any mark" and got[5]["text"] == "unclosed bold it"
    assert html.extract(p).count() == len(rows) + 1 and html.extract(p.limit(0)).count() == 0


# Held-out pages: main text in uppercase, the rest in lowercase.
HELD_OUT = [
    "<div class='content has-sidebar'><article><h2>TITLE</h2><p>{T}</p><ul><li><a href=x>ONE</a><li><a href=y>TWO</a></ul></article><div class=sidebar><p>{t}</p></div></div>",
    "<form id=aspnetForm><div class=site-header>{t}</div><article><p>{T}</p><form><label>mail</label><button>send</button></form><p>X</p></article></form>",
    "<article><p>{T}</p><div class='legal-analysis'><h3>LAW</h3><p>{T}</p></div><aside>{t}</aside><div class='share-story'><a href=a>share</a><span> </span></div><p>{T}</p></article>",
    "<article><header><h1>TITLE</h1></header><div class=adSlot>{t}</div><p>{T}</p><section id=comments><article class=comment><p>{t}</p></article></section><footer>tags</footer></article>",
    "<div id=nav><a href=a>one</a> <a href=b>two</a></div><div class=text><h1>TITLE</h1><p>{T}<p>{T}<a href=c>LINK</a></div><ul><li><a href=x>more</a><li><a href=y>links</a><li><a href=z>here</a></ul><div class='cookie-notice'>{t}</div>",
    "<div role=banner>{t}</div><article class='post'><table><tr><td>CELL<td><a href=c>LINKED</a></table><p>{T}</p><nav><a href=n>next</a></nav></article><div>{t}</div><footer>{t}</footer>",
    "<article><p><a href=r>REFERENCE</a></p><p><a href=r>REFERENCE</a></p><p><a href=r>REFERENCE</a></p></article><div class=related><a href=x>more</a></div>",
]


def test_html_tree_on_held_out_pages():
    tree = html.grow(html.LABELLED)
    for page in HELD_OUT:
        page = page.replace("{T}", "SOME WORDS OF THE TEXT, " * 6).replace("{t}", "other words, not of it, " * 6)
        found = html.blocks(page)
        want = [b[0] for b in found if b[0].isupper()]
        assert want and html.main_text(page, tree).split("\n") == want, page


def test_html_tree_decides_by_many_features():
    def used(tree, article):
        if "label" in tree:
            return set()
        if html.FEATURES[tree["feature"]] == "article":
            return {"article"} | used(tree["high" if article > tree["cut"] else "low"], article)
        return {html.FEATURES[tree["feature"]]} | used(tree["low"], article) | used(tree["high"], article)

    assert len(used(html.grow(html.LABELLED), 1.0)) >= 4
    tree = html.grow(html.LABELLED)
    assert all(html.decide(tree, tuple(row[:-1])) == row[-1] for row in html.LABELLED)
