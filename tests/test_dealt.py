"""Documents are dealt once, as texts; what their tokens are ordered, grouped or looked up by moves no token."""

import os
import re

import pytest

from lexmill import plans
from lexmill.operators import joins, training
from lexmill.sources import teitok

DATA = "/root/testdata/sf0.001"
QUERIES = ["uas_las", "eval_metrics", "part_metrics", "metrics_file", "lemma_errors", "covering_spans", "tree_depth", "align_greedy", "detag_merged", "conllu_lines", "conllu_fields", "conllu_roundtrip", "conllu_problems", "json_payload", "token_ids", "conllu_ranges"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", QUERIES)
def test_no_token_is_shuffled_by_its_place(spark, name):
    by = re.findall(r"Exchange hashpartitioning\((doc_id#\d+L?[^)]*)\), (\w+)", plan(plans.QUERIES[name](spark, DATA)))
    assert by and {kind for _, kind in by} == {"REPARTITION_BY_NUM"}, by


def test_beside_is_a_left_join(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "c"), (2, 1, None), (3, None, "d")], "doc int, n int, x string")
    side = spark.createDataFrame([(1, 1, "p", 7), (2, 1, None, 8), (4, 1, "q", 9), (3, None, "r", 10)], "doc int, n long, y string, z int")
    got = joins.beside(rows, side, ("doc", "n"))
    want = rows.join(side, ["doc", "n"], "left")
    assert got.columns == want.columns and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_tags_are_made_different_before_they_move(spark):
    tags = spark.createDataFrame([("NOUN",), ("ADVX",), ("ADVX",), (None,)], "upos string")
    out = training.extended_upos(tags)
    assert sorted(map(repr, out.collect())) == ["Row(upos='ADVX')", "Row(upos=None)"]
    assert "Generate" not in plan(out) and plan(out).count("Exchange") == 2  # the plan and its first version


def test_texts_of_a_batch_leave_piece_by_piece(spark):
    from pyspark.sql import functions as F

    tok = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(700)), lambda k: F.concat(F.lit('<tok id="w-'), k, F.lit('" upos="X">a</tok>'))), " ")
    files = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("<TEI><text><s>"), tok, F.lit("</s></text></TEI>")).alias("xml"))
    out = teitok.parsed(files)
    assert "MapInArrow" in plan(out)
    assert sorted(map(tuple, out.groupBy("doc_id").count().collect())) == [(k, 700) for k in range(40)]
