"""What queries on larger tables rest on, told by their plans."""

import json

import pytest

from quire.operators import leaves as L
from quire.plans import all_plans

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return all_plans()[0][name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["formula_leaks", "formula_leaks_json"])
def test_books_are_never_one_row(spark, name):
    assert "collect_list" not in plan(spark, name)


def test_leaks_of_parts(spark):
    rows = [("b", "", {"name": "$n$"}), ("b", "topics[7]", {"body": "a $x$", "notes": {"k": ["none", "$y$"]}})]
    parts = spark.createDataFrame([(k, p, json.dumps(d)) for k, p, d in rows], "k string, path string, d string")
    assert sorted((r.path, r.value) for r in L.leaks_of_json(parts, ["k"], "d", path="path").collect()) == [("name", "$n$"), ("topics[7].body", "a $x$"), ("topics[7].notes.k[1]", "$y$")]
    typed = spark.createDataFrame([("b", "topics[7]", ("a $x$", ["$y$"]))], "k string, path string, d struct<body:string,more:array<string>>")
    assert sorted((r.path, r.value) for r in L.leaks(typed, ["k"], "d", path="path").collect()) == [("topics[7].body", "a $x$"), ("topics[7].more[0]", "$y$")]


@pytest.mark.parametrize("name", ["chapter_slices", "recorded_slices"])
def test_books_lines_are_not_broadcast(spark, name):
    assert "BroadcastHashJoin" not in plan(spark, name)


@pytest.mark.parametrize("name", ["chapter_summaries", "study_notes", "chapter_maps", "exported_texts", "options_parse"])
def test_long_work_on_a_small_table_is_spread(spark, name):
    assert "hashpartitioning(p_partkey" in plan(spark, name) and "REPARTITION_BY_NUM" in plan(spark, name)


@pytest.mark.parametrize("name", ["structured_questions", "resolved_figures"])
def test_topics_are_read_once_for_all_their_arrays(spark, name):
    assert plan(spark, name).count("lineitem.parquet") == 1


def test_figures_are_looked_up_in_their_topic(spark):
    made = plan(spark, "resolved_figures")
    assert made.count("Join") == 1  # the books' lines


def test_merged_parts_are_dealt_out_once(spark):
    made = plan(spark, "merged_replies")
    assert "Broadcast" not in made and made.count("Exchange") == 3  # lines by order, orders, elements by topic


def test_a_text_is_looked_at_once(spark):
    assert plan(spark, "classify_rules").count("<[^>]+>") == 1
    assert plan(spark, "readable_documents").count("mathrm") == 2  # a head and lines


def test_an_attempts_answers_are_not_multiplied_before_they_are_counted(spark):
    made = plan(spark, "practice_report")
    assert "Expand" not in made and made.count("Exchange") == 2


def test_paragraphs_after_the_first_that_is_fit_are_not_looked_at(spark):
    assert "aggregate(split(" in plan(spark, "excerpts")


@pytest.mark.parametrize("name", ["slim_topics", "export_payloads"])
def test_topics_are_worked_out_once(spark, name):
    assert ", true, [t#" in plan(spark, name)  # an outer explode


@pytest.mark.parametrize("name", ["align_greedy", "question_bank", "blocks_parse"])
def test_chapters_go_whole_and_their_lines_are_no_rows(spark, name):
    made = plan(spark, name)
    assert "Generate" not in made and made.count("MapInArrow") == 2
