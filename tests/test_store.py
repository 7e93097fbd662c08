"""Appends to several tables of a folder store at once."""

from __future__ import annotations

import pytest

from trialspark.plans.store import FolderStore


def test_all_tables_or_none(spark, tmp_path):
    store = FolderStore(spark, str(tmp_path / "tables"))
    good = spark.range(3)
    bad = good.selectExpr("raise_error('lost') AS id")
    store.append_all({"first": good, "second": good})
    with pytest.raises(Exception, match="lost"):
        store.append_all({"first": good, "second": bad})
    assert [store.read(name).count() for name in ("first", "second")] == [3, 3]
    store.append_all({"first": good, "second": good.limit(1)})
    assert [store.read(name).count() for name in ("first", "second")] == [6, 4]
    assert store.exists("first") and not store.exists("third")
    store.append("first", good)
    assert store.read("first").count() == 9
    assert store.names() == ["first", "second"]


def test_create_leaves_an_appended_table_alone(spark, tmp_path):
    store = FolderStore(spark, str(tmp_path / "tables"))
    store.append_all({"only": spark.range(2)})
    store.create("only", spark.range(5))
    assert store.read("only").count() == 2
