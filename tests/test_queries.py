"""Queries against their SQL on the smallest tables: a sample of each family (the driver runs them all)."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexmill import plans

DATA = "/root/testdata/sf0.001"
SAMPLE = ["tokenize_forms", "sentence_rebuild", "contraction_pairs", "vocab_counts", "transition_counts", "ending_candidates", "eval_metrics", "error_grouping_sets", "entity_to_sentence", "trigram_detect", "bench_upsert", "conllu_lines", "reg_dominant"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def same(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    result = duck.execute(plans.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    order = lambda rows: sorted(map(repr, rows))
    assert order([tuple(same(r[c]) for c in columns) for r in df.collect()]) == order([tuple(map(same, r)) for r in result.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
