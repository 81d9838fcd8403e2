"""Plans that keep a query's work in proportion to its input."""

import pytest

from pepspark.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["f12_feature_columns", "r1_composite_score", "r1_composite_score_earlier", "r8_cascade", "x9_x14_linear_descriptors", "x26_shuffle_residues"])
def test_texts_are_cut_once_in_batches(spark, name):
    text = plan(spark, name)
    assert text.count("MapInArrow") == 1 and "regexp_replace" not in text and "lambdafunction" not in text


@pytest.mark.parametrize("name", ["r7_score_table", "r8_cascade"])
def test_words_come_without_their_sources(spark, name):
    assert "source_db" not in plan(spark, name)


def test_cascade_normalizes_and_tests_a_word_once(spark):
    text = plan(spark, "r8_cascade")
    assert text.count("trim(") == 1 and text.count("RLIKE") == 1


def test_control_gap_joins_nothing(spark):
    text = plan(spark, "q15_control_gap")
    assert "Join" not in text and "lambdafunction" not in text


def test_linear_descriptors_count_each_residue_once(spark):
    assert plan(spark, "x9_x14_linear_descriptors").count("replace(sequence") <= 20


def test_outliers_clean_labelled_texts_only(spark):
    text = plan(spark, "q11_iqr_bounds")
    cleaned, joined = text.index("clean("), text.index("Join Inner, (doc_id")
    assert cleaned < joined  # the join lies below the cleaning


def test_known_keys_are_folded_before_the_join(spark):
    text = plan(spark, "j3_novel_only")
    assert "Aggregate" in text[text.index("LeftAnti") :]


def test_merge_without_payload_sorts_no_payload(spark):
    assert "struct" not in plan(spark, "u3_merge_into")


@pytest.mark.parametrize("name", ["t2_novel_stream", "t4_visitation_stream"])
def test_log_slices_are_written_by_all_tasks(spark, name, monkeypatch):
    from pepspark.plans import scoring_queries as sq

    followed = [log for log in sq._growing_log(spark, SF)]
    assert 1 < len(followed) <= 4
    monkeypatch.setattr("pyspark.sql.DataFrame.coalesce", None)
    assert QUERIES[name](spark, SF).count() > 0
