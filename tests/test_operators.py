"""Relational, glucose, cohort and text-to-SQL operators on small literal tables."""

from __future__ import annotations

import json
import math
import statistics

import pytest
from pyspark.sql import functions as F

from trialspark.operators import cohorts, glucose, relational, text_to_sql
from trialspark.plans.store import FolderStore


def rows(df, *order) -> list[tuple]:
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# ------------------------------------------------------------------ relational


def test_sort_rows_puts_nulls_last(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "a int")
    assert rows(relational.sort_rows(df, "a")) == [(1,), (2,), (None,)]
    assert rows(relational.sort_rows(df, "-a")) == [(2,), (1,), (None,)]
    assert rows(relational.first_rows(df, 2, "-a")) == [(2,), (1,)]


def test_breakdown_and_frequency(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("a", 2.0, 3), ("b", None, 4), (None, 9.0, 1)], "arm string, x double, n int")
    assert rows(relational.breakdown(df, "arm", "x", "n"), F.asc_nulls_last("arm")) == [
        ("a", 2, 1.5, 5),
        ("b", 1, None, 4),
        (None, 1, 9.0, 1),
    ]
    assert rows(relational.frequency(df, "arm")) == [("a", 2), ("b", 1), (None, 1)]
    assert rows(relational.frequency(df, "arm", skip_nulls=True)) == [("a", 2), ("b", 1)]


def test_joined_breakdown_equals_plain_join(spark):
    """Folding before the join must not change anything, repeated subjects included."""
    subjects = spark.createDataFrame(
        [(1, "x", "m"), (2, "x", "f"), (3, "y", "f"), (3, "y", "f"), (4, "z", "m")], "id int, arm string, sex string"
    )
    results = spark.createDataFrame(
        [(1, 6.0), (1, 7.0), (1, None), (2, 8.0), (3, 5.0), (9, 1.0)] + [(2, 10.0)] * 100, "id int, a1c double"
    )
    plain = (
        subjects.join(results, "id")
        .where("a1c is not null")
        .groupBy("arm", "sex")
        .agg(F.round(F.avg("a1c"), 2), F.count("a1c"))
    )
    got = relational.joined_breakdown(subjects, results, "id", ["arm", "sex"], "a1c")
    assert rows(got, "arm", "sex") == rows(plain, "arm", "sex")


@pytest.fixture
def trials(spark):
    one = spark.createDataFrame([(1, 10.0, "p")], "PtID int, tir double, other string")
    two = spark.createDataFrame([(1.0, 5), (2.0, 6), (None, 7)], "in_range double, subj int")
    none = spark.createDataFrame([], "id int, v double")
    names = {
        "one": {"subject": "PtID", "tir": "tir"},
        "two": {"subject": "subj", "tir": "in_range"},
        "none": {"subject": "id", "tir": "v"},
    }
    return relational.aligned({"one": one, "two": two, "none": none}, names)


def test_trials_combined_and_individual(trials):
    assert rows(relational.combined_trials(trials, "tir")) == [(3, 13 / 3)]
    per_trial = relational.individual_trials(trials, ["one", "two", "none"], "tir")
    assert rows(per_trial, "trial") == [("none", 0, None), ("one", 1, 10.0), ("two", 2, 1.5)]


def test_text_average(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2.5"), ("a", "n/a"), ("a", None), ("b", "x")], "g string, t string")
    assert rows(relational.text_average(df, "g", "t"), "g") == [("a", 2, 4, 1.75), ("b", 0, 1, None)]


def test_compare_results(spark):
    left = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert rows(relational.compare_results(left, left.orderBy("a"))) == [(True, 0, 0)]
    assert rows(relational.compare_results(left, left.distinct())) == [(False, 1, 0)]
    other = spark.createDataFrame([(2, "x"), (1, None), (3, None)], "c int, d string")
    assert rows(relational.compare_results(left, other)) == [(False, 1, 1)]
    nothing = left.where("false")
    assert rows(relational.compare_results(nothing, nothing)) == [(True, 0, 0)]
    with pytest.raises(ValueError):
        relational.compare_results(left, left.select("a"))


# --------------------------------------------------------------------- glucose

VALUES = [53.9, 54.0, 69.9, 70.0, 120.0, 180.0, 180.1, 250.0, 250.1, 400.0]


def test_glucose_metrics(spark):
    readings = spark.createDataFrame([("s", v) for v in VALUES] + [("s", None), ("one", 100.0), ("zero", None)], "id string, g double")
    by_id = {r["id"]: r for r in glucose.glucose_metrics(readings, ["id"], "g").collect()}
    s = by_id["s"]
    assert s["n_readings"] == 10
    assert (s["pct_below_70"], s["pct_below_54"]) == (30.0, 10.0)
    assert (s["pct_in_range"], s["pct_above_180"], s["pct_above_250"]) == (30.0, 40.0, 20.0)
    assert s["mean_glucose"] == pytest.approx(statistics.mean(VALUES))
    assert s["gmi"] == pytest.approx(3.31 + 0.02392 * statistics.mean(VALUES))
    assert s["sd"] == pytest.approx(statistics.stdev(VALUES))
    assert s["cv"] == pytest.approx(100 * statistics.stdev(VALUES) / statistics.mean(VALUES))
    assert by_id["one"]["sd"] is None or math.isnan(by_id["one"]["sd"])
    assert by_id["zero"]["n_readings"] == 0 and by_id["zero"]["pct_in_range"] is None


def test_ranges_add_up(spark):
    readings = spark.range(2000).select((F.col("id") % 7).alias("id"), (F.rand(7) * 400).alias("g"))
    for r in glucose.glucose_metrics(readings, ["id"], "g").collect():
        assert r["pct_below_70"] + r["pct_in_range"] + r["pct_above_180"] == pytest.approx(100)


# --------------------------------------------------------------------- cohorts


def test_adverse_events_are_zero_filled(spark):
    subjects = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id int, arm string")
    events = spark.createDataFrame([(1, "DKA"), (1, "DKA"), (2, "SH"), (9, "DKA"), (3, "cold")], "id int, event string")
    kinds = {"dka": ["DKA"], "severe_hypo": ["SH", "Severe Hypoglycemia"]}
    got = cohorts.adverse_event_counts(events, subjects, "id", "arm", "event", kinds)
    assert rows(got, F.asc_nulls_last("arm")) == [("a", 2, 1), ("b", 0, 0), (None, 0, 0)]


def test_age_and_buckets(spark):
    df = spark.createDataFrame([(17, 1.0), (18, 25.0), (None, None)], "age int, bmi double")
    got = df.select(cohorts.age_cohort("age"), cohorts.bucket("bmi", [18.5, 25], ["low", "mid", "high"]))
    assert rows(got) == [("pediatric", "low"), ("adult", "high"), (None, None)]
    with pytest.raises(ValueError):
        cohorts.bucket("bmi", [1], ["only"])


def test_cohort_and_arm_summaries(spark):
    df = spark.createDataFrame([(1, 10, "pump", 1.0), (2, 20, "pump", 3.0), (3, 40, None, 5.0)], "id int, age int, arm string, x double")
    summary = cohorts.cohort_summary(df, {"cohort": cohorts.age_cohort("age")}, "x")
    assert rows(summary, "cohort") == [("adult", 2, 4.0, 3.0, 5.0), ("pediatric", 1, 1.0, 1.0, 1.0)]
    assert rows(cohorts.arm_breakdown(df, "arm", "id", ["x", "age"])) == [("pump", 2, 2.0, 15.0)]
    assert rows(cohorts.value_summary(df, ["arm"], "x"), F.asc_nulls_last("arm")) == [("pump", 2, 2.0), (None, 1, 5.0)]


def test_baseline_change(spark):
    visits = spark.createDataFrame(
        [(1, 0, 1, 8.0, True), (1, 3, 2, 7.0, False), (1, 6, 3, 6.5, False), (2, 1, 4, 9.0, False), (3, None, 5, 1.0, True)],
        "id int, visit int, row int, a1c double, flag boolean",
    )
    got = cohorts.baseline_change(visits, "id", "visit", "a1c", "row")
    assert rows(got, "id") == [(1, 3, 0, 6, 8.0, 6.5, -1.5), (2, 1, 1, 1, 9.0, 9.0, 0.0)]
    flagged = cohorts.baseline_change(visits, "id", "visit", "a1c", "row", baseline=F.col("flag"))
    assert rows(flagged, "id")[1] == (2, 1, None, 1, None, 9.0, None)
    assert rows(cohorts.baseline_change(visits, "id", "visit", "a1c"), "id") == rows(got, "id")


def test_baseline_ties_follow_the_tie_break(spark):
    visits = spark.createDataFrame([(1, 0, 2, 20.0), (1, 0, 1, 10.0), (1, 5, 3, 30.0), (1, 5, 4, 40.0)], "id int, visit int, row int, v double")
    assert rows(cohorts.baseline_change(visits, "id", "visit", "v", "row")) == [(1, 4, 0, 5, 10.0, 40.0, 30.0)]


def test_link_outcomes(spark):
    people = spark.createDataFrame([(1, "m"), (2, "f")], "pt_id int, sex string")
    outcomes = spark.createDataFrame([(1, 70.0), (1, 60.0), (3, 1.0)], "subject_id int, tir double")
    assert rows(cohorts.link_outcomes(people, "pt_id", outcomes, "subject_id"), "tir") == [(1, "m", 60.0), (1, "m", 70.0)]


def test_terms(spark):
    df = spark.createDataFrame([(50.0, 10), (70.0, 17), (180.0, 18), (251.0, None), (None, 40)], "g double, age int")
    names = {"glucose": "g", "age": "age"}
    got = cohorts.term_counts(df, list(cohorts.TERMS), names)
    assert {r["term"]: (r["n"], r["n_known"]) for r in got.collect()} == {
        "lows": (1, 4), "hypoglycemia": (1, 4), "severe lows": (1, 4),
        "highs": (1, 4), "hyperglycemia": (1, 4), "severe highs": (1, 4),
        "in-range": (2, 4), "tir": (2, 4),
        "kids": (2, 4), "pediatric": (2, 4), "adults": (2, 4),
    }
    assert df.where(cohorts.term_predicate(" Kids ", names)).count() == 2


# ----------------------------------------------------------------- text to SQL


def test_training_tables_get_no_requests(spark):
    names = ("visits", *text_to_sql.TRAINING_TABLES)
    bullets = spark.createDataFrame([(n, "x") for n in names], "table_name string, text string")
    assert {r["table_name"] for r in text_to_sql.pair_requests(bullets, 2).collect()} == {"visits"}
    assert text_to_sql.pair_requests(bullets, 2, left_out=()).count() == 8
    assert text_to_sql.pair_requests(bullets.where("table_name <> 'visits'"), 2).count() == 0


def test_pair_requests(spark):
    bullets = spark.createDataFrame([("b", "B {schema}"), ("a", "A")], "table_name string, text string")
    got = rows(text_to_sql.pair_requests(bullets, 2, "<{schema}>"), "table_name", "request_no")
    assert got == [("a", 1, "<A>"), ("a", 2, "<A>"), ("b", 1, "<B {schema}>"), ("b", 2, "<B {schema}>")]


def test_question_prompts(spark):
    questions = spark.createDataFrame([("how many {schema}?",)], "q string")
    schema = spark.createDataFrame([("S",)], "schema_text string")
    prompt = text_to_sql.question_prompts(questions, "q", schema, "{schema}/{question}/{schema}").first()["prompt"]
    assert prompt == "S/how many {schema}?/S"


def envelope(response) -> str:
    return json.dumps({"response": response, "model": "m"})


ANSWERS = {
    envelope(json.dumps(["q", "c", "r"])): ("q", "c", "r", None),
    envelope(json.dumps(["é\n", 'a "b"', ""])): ("é\n", 'a "b"', "", None),
    envelope('[1, true, null]'): ("1", "True", "None", None),
    envelope('[{"k":2}, [1], false]'): ('{"k":2}', "[1]", "False", None),
    envelope(json.dumps(["only", "two"])): (None, None, None, "not_three_items"),
    envelope("[]"): (None, None, None, "not_three_items"),
    envelope('{"a": 1}'): (None, None, None, "not_a_list"),
    envelope('"abc"'): (None, None, None, "not_a_list"),
    envelope('["a", "b", "c"'): (None, None, None, "bad_json"),
    envelope("SELECT 1"): (None, None, None, "bad_json"),
    envelope(["a", "b", "c"]): (None, None, None, "response_not_text"),
    "{}": (None, None, None, "not_three_items"),
    "[1]": (None, None, None, "bad_envelope"),
    '{"response": "[]", "response": "[\\"a\\", \\"b\\", \\"c\\"]"}': ("a", "b", "c", None),
    '{"response": "[\\"a\\", \\"b\\", \\"c\\"]", "response": 3}': (None, None, None, "response_not_text"),
    '{"response": "[\\"a\\", \\"b\\", \\"c\\"]", "response": "[]"}': (None, None, None, "not_three_items"),
    '{"x": 1, "x": 2}': (None, None, None, "not_three_items"),
    '{"x": 1, "x": 2} {}': (None, None, None, "bad_envelope"),
    '{"x": 1, "x": 2}, {}': (None, None, None, "bad_envelope"),
    '{"x": 1, "x": 2': (None, None, None, "bad_envelope"),
    '{"x": 1, "x": 2}], "b": [{}': (None, None, None, "bad_envelope"),
    '{"x": 1, "x": 2}] }': (None, None, None, "bad_envelope"),
    '{"x": 1, "x": 2}]': (None, None, None, "bad_envelope"),
    "HTTP 500": (None, None, None, "bad_envelope"),
}


@pytest.mark.parametrize("answer", ANSWERS)
def test_parse_pair_answers(spark, answer):
    df = spark.createDataFrame([(answer,)], "answer string")
    got = text_to_sql.parse_pair_answers(df, "answer").first()
    assert (got["prompt"], got["chosen"], got["rejected"], got["reason"]) == ANSWERS[answer]


def test_missing_answer(spark):
    df = spark.createDataFrame([(None,)], "answer string")
    assert text_to_sql.parse_pair_answers(df, "answer").first()["reason"] == "bad_envelope"


PAIR = ("What is the average age?", "SELECT AVG(age) FROM demographics;", "SELECT SUM(age) FROM demographics;")


def test_training_rows_and_tables(spark, tmp_path):
    pairs = spark.createDataFrame([PAIR], "prompt string, chosen string, rejected string")
    store = FolderStore(spark, str(tmp_path))
    for _ in range(2):
        text_to_sql.append_training_tables(pairs, store)
    assert rows(store.read("pretrain_data")) == [(f"Question: {PAIR[0]}\\nSQL: {PAIR[1]}",)] * 2
    assert rows(store.read("sft_data")) == [PAIR[:2]] * 2
    assert rows(store.read("dpo_data")) == [PAIR] * 2
    assert store.read("sft_data").columns == ["prompt", "completion"]
