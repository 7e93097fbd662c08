"""Header clean-up and synonym harmonisation."""

from __future__ import annotations

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from trialspark.operators.harmonize import (
    harmonize,
    load_synonyms,
    standard_names,
    unique_headers,
)


def test_unique_headers():
    assert unique_headers(["id", "ID", "Id", "id_1"]) == ["id", "ID_1", "Id_2", "id_1_1"]
    assert unique_headers(["a", "", " c ", ""]) == ["a", "column1", "c", "column3"]


def test_collision_falls_back_to_own_name():
    headers = unique_headers(["Pt_NumHospDKA", "NumHospDKA", "NumHospDKA"])
    assert headers == ["Pt_NumHospDKA", "NumHospDKA", "NumHospDKA_1"]
    assert standard_names(headers) == ["numhospdka", "NumHospDKA_2", "NumHospDKA_1"]


def test_own_name_kept_when_standard_name_is_taken():
    assert standard_names(["age", "years"], {"AGE": ["years"]}) == ["age", "years"]


def test_no_synonyms():
    assert standard_names(["A", "B"], {}) == ["A", "B"]


@settings(deadline=None)
@given(st.lists(st.sampled_from(["a", "A", "b", "a_2", "x", "X_2", "std"]), max_size=8))
def test_standard_names_are_distinct_and_complete(columns):
    names = standard_names(unique_headers(columns), {"std": ["a", "x"], "b": ["A_1"]})
    assert len(names) == len(columns)
    assert len({name.lower() for name in names}) == len(names)


def test_load_synonyms(tmp_path):
    assert load_synonyms(tmp_path / "missing.json") == {}
    file = tmp_path / "map.json"
    file.write_text(json.dumps({"std": ["One"]}), encoding="utf-8")
    assert load_synonyms(file) == {"std": ["One"]}


def test_harmonize_renames_only(spark):
    df = spark.createDataFrame([(1, 2, 3)], "PtID int, `NumHospDKA` int, other int")
    out = harmonize(df)
    assert out.columns == ["PtID", "numhospdka", "other"]
    assert [tuple(r) for r in out.collect()] == [(1, 2, 3)]
