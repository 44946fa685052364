"""What is dear is computed once and moved once: no filter is pushed down as a copy of it, no boxes are shuffled."""

import re

from pyspark.sql import functions as F

from fieldleaf.operators import flatten, geometry, intake, judge
from fieldleaf.queries import QUERIES


def filters(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [x for x in plan.split("\n") if re.match(r"[\s:+|-]*Filter ", x)]


def test_gaps_filter_copies_no_checks(spark, sf):
    assert not [x for x in filters(QUERIES["e1_gaps"](spark, sf)) if "translate(" in x]


def test_status_filter_parses_nothing(spark):
    read = flatten.envelopes(flatten.completions(spark.createDataFrame([(1, "[]")], "page_id long, answer string")))
    placed = flatten.numbered(flatten.answer_rows(read)).where("row_no is not null")
    assert not [x for x in filters(placed) if "parse_json" in x or "from_json" in x]


def test_cell_filter_places_once(spark):
    boxes = spark.createDataFrame([(1, 0.1, 0.1, 0.2, 0.2)], "page_id long, l double, t double, r double, b double")
    far = geometry.placed(boxes.withColumn("l", F.sqrt("l"))).where("row_no is not null")
    assert not [x for x in filters(far) if "SQRT" in x.upper()]


def test_boxes_are_not_shuffled(spark, sf):
    plan = QUERIES["c6_cell_text"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("BroadcastHashJoin") < plan.index("Exchange hashpartitioning")


def test_explained_is_one_shuffle(spark):
    rows = spark.createDataFrame([(1, 1, "a(x)"), (1, 2, "a(y)"), (1, 3, "a"), (1, 4, None), (2, 1, "a")], "page_id long, row_no int, place string")
    got = judge.explained(rows)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r["page_id"], r["row_no"], r["explained"]) for r in got.collect()) == [(1, 1, None), (1, 2, None), (1, 3, "x"), (1, 4, None), (2, 1, None)]


def test_uploads_are_no_file_each(spark, tmp_path):
    uploads = spark.range(0, 500, 1, 2).select("id", F.encode(F.when(F.col("id") % 2 == 0, "The x").otherwise("The " + "y" * 99), "UTF-8").alias("content"))
    intake.store_uploads(uploads, f"{tmp_path}/up")
    stored = spark.read.parquet(f"{tmp_path}/up")
    got = intake.triage_uploads(stored, 50, b"The ")
    assert len(stored.inputFiles()) <= 2
    assert {tuple(r) for r in got.groupBy("status", "length").count().collect()} == {(200, 5, 250), (413, 103, 250)}
    assert "ReadSchema: struct<id:bigint,length:bigint>" in got._jdf.queryExecution().executedPlan().toString()


def test_boxes_need_no_function_of_elements(spark, sf):
    plan = lambda name: QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan("b9_detections")
    assert "zip_with" not in plan("b10_anchored") and "aggregate(" not in plan("b10_anchored")
    point = "struct<y: string, x: string, more: string>"
    rows = [(1, [("a", 0.9, [("1", "5", ""), ("0.5", "7", "")]), (" ", 0.9, []), ("b", 0.1, [("1", "?", "")]), ("c", None, []), ("d", None, None), ("e", None, [("2", "3", ""), None])])]
    boxes = flatten.detection_boxes(spark.createDataFrame(rows, f"page_id long, detections array<struct<text: string, confidence: double, points: array<{point}>>>"))
    got = {r["text"]: (r["l"], r["t"], r["r"], r["b"], r["unsure"], r["note"]) for r in boxes.collect()}
    none = (None,) * 4
    assert got == {"a": (5, 0.5, 7, 1, False, ""), "b": (*none, True, "unreadable position"), "c": (*none, False, "no position"), "d": (*none, False, "no position"), "e": (*none, False, "unreadable position")}
    entry = "array<struct<segments: array<struct<start: long, end: long>>, vertices: array<struct<x: double, y: double>>>>"
    pages = [(1, "ab cd", [([(3, 5)], [(2.0, 3.0)]), ([(None, 1), (4, 5)], []), ([(1, 3)], [(4.0, 1.0), (0.0, 2.0)])], [])]
    got = [(r["seq"], r["text"], r["l"], r["t"], r["r"], r["b"], r["note"]) for r in flatten.anchored_boxes(spark.createDataFrame(pages, f"page_id long, text string, symbols {entry}, tokens {entry}")).collect()]
    assert sorted(got) == [(1, "ad", *none, "no position"), (2, "b", 0, 1, 4, 2, ""), (3, "cd", 2, 3, 2, 3, "")]


def test_compared_cells_are_not_moved_again(spark, sf):
    """The stored cells are bucketed by page: only the other side, and the counts, are shuffled."""
    plan = QUERIES["h1_compare"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
