"""Every query of the engine against its SQL in DuckDB, over whole tables."""

import glob
import os

import duckdb
import pytest
from brindle.plans import queries  # noqa: F401
from brindle.plans.registry import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return str(v) if v is not None and not isinstance(v, (bool, int)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rel = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)
    have = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert len(have) == len(want)
    assert have == want, next((a, b) for a, b in zip(have, want) if a != b)


def test_all_orders_are_tasks(spark, db):
    n = db.execute("select count(*) from orders").fetchone()[0]
    tiles = QUERIES["q_task_tiles"](spark, SF).first()
    assert tiles["total"] == n == QUERIES["q_task_cards"](spark, SF).count() and tiles["long_term"] > 0


def test_whole_texts_are_routed_and_all_labels_compared(spark, db):
    longest = db.execute("select max(length(text)) from conversations where (conv_id + turn) % 6 in (0, 4, 5)").fetchone()[0]
    assert QUERIES["q_route"](spark, SF).agg(F.max(F.length("args"))).first()[0] >= longest - 1 > 10
    got = QUERIES["q_eval_regression"](spark, SF)
    n = db.execute("select count(*) from labels").fetchone()[0]
    assert got.where("score_before is not null").count() == n == got.where("score_now is not null").count()
