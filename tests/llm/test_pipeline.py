"""The pipeline's stages against brute force on a small corpus, and the guard for its absence."""

import random

import corpus_pipeline
import pytest
from brindle.llm.common import materialize

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 300").collect()
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in base]
    item = " ".join(f"{a}ing the {b}er" for a, b in zip("abcdefgh", "ijklmnop"))
    more = [(5000, None, "en", "s", None), (5001, "", None, None, 0), (5002, "12 + 34 = 46 !!", "en", "s", 15), (5003, f"{rows[1][1]} so {item} it was", "en", "s", None), (5004, rows[2][1], "en", "s", None), (5005, f"{' '.join(reversed(rows[7][1].split()))} write to me.you@mail.example.org please", None, "s", None)]
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows + more, COLUMNS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, {r[0]: r for r in rows + more}


def test_stages(spark, world):
    sf, rows = world
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, sf), name)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        held[name] = {r["doc_id"]: r for r in out.collect()}
        docs = out
    assert {5000, 5001, 5002}.isdisjoint(held["language_id"]) and len(held["language_id"]) == len(rows) - 3
    assert held["language_id"][5005]["lang"] == rows[7][2]
    from tests.llm.test_operators import groups

    ids = sorted(held["language_id"])
    found = groups([held["language_id"][d]["text"] for d in ids])
    assert set(held["near_duplicates"]) == {d for k, d in enumerate(ids) if found[3 * k][1] == 3 * k}
    assert 5004 not in held["near_duplicates"] and 5003 in held["near_duplicates"]
    assert set(held["near_duplicates"]) - set(held["decontaminate"]) == {5003}
    assert set(held["personal_data"]) == set(held["decontaminate"])
    assert held["personal_data"][5005]["text"].endswith("write to [email] please") and held["personal_data"][5005]["n_chars"] == len(held["personal_data"][5005]["text"])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in last.collect()} == set(held["personal_data"])
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, last.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_stages_of_nothing(spark, world):
    docs = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, world[0])
        assert out.count() == 0, name


def test_stages_with_repeated_rows_and_other_columns(spark, world):
    """Repeated rows, clashing ids, null ids, columns with the names that stages use themselves."""
    sf, rows = world
    base = [r for r in sorted(rows.values()) if r[1] and len(r[1]) > 300 and r[0] < 60]
    a, b = base[0], base[1]
    made = [(*r[:4], k, "x", "y") for k, r in enumerate(base)] * 2
    made += [(base[-1][0], f"{b[1]} more", *a[2:4], 1, "x", "y"), (None, a[1], "en", "s", 7, "x", "y"), (None, None, None, None, None, None, None), (7000, None, None, "s", None, "x", "y"), (7000, a[1], "en", "s", 3, "x", "y")]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, spans long, _digest string, _doc string")
    out = materialize(corpus_pipeline.STAGES[0][1](spark, docs, sf), "a")
    assert out.columns == docs.columns and out.count() == len(made) - 2
    near = materialize(corpus_pipeline.STAGES[1][1](spark, out, sf), "b")
    assert near.columns == docs.columns
    from tests.llm.test_operators import groups_of

    found = groups_of({r[0]: r[1] for r in base})
    kept = sorted(((r["doc_id"], r["text"]) for r in near.collect()), key=repr)
    assert kept == sorted([(r[0], r[1]) for r in base if found[r[0]][1] == r[0]] + [(None, a[1])], key=repr)
    for name, stage in corpus_pipeline.STAGES[2:4]:
        near = materialize(stage(spark, near, sf), name)
        assert near.columns == docs.columns
    assert corpus_pipeline.STAGES[4][1](spark, near, sf).where("doc_id is null").count() > 0
