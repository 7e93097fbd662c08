"""Loading folders: naming, isolation, idempotence, report."""

from __future__ import annotations

import pytest

from trialspark.plans.load import load_folder
from trialspark.plans.store import CatalogStore, FolderStore
from trialspark.sources.discovery import discover_files


@pytest.fixture(params=["folder", "catalog"])
def store(request, spark, tmp_path):
    if request.param == "folder":
        yield FolderStore(spark, str(tmp_path / "tables"))
        return
    spark.sql("CREATE DATABASE load_test")
    yield CatalogStore(spark, "load_test")
    spark.sql("DROP DATABASE load_test CASCADE")


def report_of(df) -> dict[str, tuple]:
    return {row["path"].rsplit("/", 1)[1]: (row["table"], row["status"], row["n_rows"]) for row in df.collect()}


def test_load_folder(spark, tmp_path, store):
    data = tmp_path / "in"
    (data / "deep" / "er").mkdir(parents=True)
    (data / "visits.csv").write_text("subject,dose\n41,15\n87,27\n")
    (data / "7 arms.csv").write_text("arm,size\nA,33\n")
    (data / "deep" / "lab-values.txt").write_text("subject\tdose\n41\t40\n87\t2\n")
    (data / "deep" / "er" / "Wide chars.txt").write_bytes("subject|dose\n5|1\n6|41\n".encode("utf-16"))
    (data / "twice.csv").write_text("Pt_NumHospDKA,NumHospDKA,NumHospDKA\n1,2,3\n")
    (data / "latin.csv").write_bytes(b"site,n\nM\xfcnster\xe9,8\n")
    (data / "._visits.csv").write_text("id\n1\n")
    (data / "Study Glossary.csv").write_text("id\n1\n")
    (data / "Protocol.txt").write_text("id\n1\n")
    (data / "notes.md").write_text("id\n1\n")
    (data / "brackets [1].csv").write_text("id\n5\n")
    (data / "odd columns.csv").write_text("Pt ID,c.d,x(y)=`z`\n1,2,3\n")

    # Spark's catalog takes letters, digits and underscores only; a folder takes any name.
    in_folder = isinstance(store, FolderStore)
    brackets = ("brackets_[1]", "loaded", 1) if in_folder else ("brackets_[1]", "failed", None)
    report = report_of(load_folder(spark, str(data), store))
    assert report == {
        "visits.csv": ("visits", "loaded", 2),
        "7 arms.csv": ("t_7_arms", "loaded", 1),
        "lab-values.txt": ("lab_values", "loaded", 2),
        "Wide chars.txt": ("wide_chars", "loaded", 2),
        "twice.csv": ("twice", "loaded", 1),
        "latin.csv": ("latin", "failed", None),
        "brackets [1].csv": brackets,
        "odd columns.csv": ("odd_columns", "loaded", 1),
    }
    for name in ("visits", "lab_values", "wide_chars"):
        assert store.read(name).selectExpr("sum(dose)").first()[0] == 42
    assert store.read("twice").columns == ["numhospdka", "NumHospDKA_2", "NumHospDKA_1"]
    assert store.read("odd_columns").columns == ["Pt ID", "c.d", "x(y)=`z`"]
    assert store.names() == sorted(t for t, status, _ in report.values() if status == "loaded")

    again = report_of(load_folder(spark, str(data), store))
    assert {status for _, status, _ in again.values()} == {"skipped", "failed"}


def test_existing_table_is_untouched(spark, tmp_path, store):
    store.create("visits", spark.createDataFrame([("kept",)], "mark string"))
    data = tmp_path / "in"
    data.mkdir()
    (data / "Visits.csv").write_text("subject,dose\n3,8\n")
    assert report_of(load_folder(spark, str(data), store)) == {
        "Visits.csv": ("visits", "skipped", None)
    }
    assert [tuple(r) for r in store.read("visits").collect()] == [("kept",)]


def test_first_file_of_a_name_that_loads_wins(spark, tmp_path):
    store = FolderStore(spark, str(tmp_path / "tables"))
    data = tmp_path / "in"
    for folder in ("a", "b", "c"):
        (data / folder).mkdir(parents=True)
    (data / "a" / "x.txt").write_text("id\n1\n")
    (data / "b" / "x.csv").write_bytes(b"id,t\n1,\xff\n")
    (data / "c" / "X.csv").write_text("id\n3\n")
    rows = load_folder(spark, str(data), store).collect()
    outcome = {r["path"].split("/")[-2]: r["status"] for r in rows}
    assert outcome == {"b": "failed", "c": "loaded", "a": "skipped"}
    assert store.read("x").first()[0] == 3


def test_synonyms_are_a_parameter(spark, tmp_path):
    store = FolderStore(spark, str(tmp_path / "tables"))
    data = tmp_path / "in"
    data.mkdir()
    (data / "t.csv").write_text("PtID,A\n1,2\n")
    load_folder(spark, str(data), store, synonyms={"pt_id": ["ptid"]})
    assert store.read("t").columns == ["pt_id", "A"]


def test_empty_folder_reports_nothing(spark, tmp_path):
    assert load_folder(spark, str(tmp_path), FolderStore(spark, str(tmp_path / "t"))).count() == 0


def test_interrupted_write_is_repeated(spark, tmp_path):
    """A table folder without data, as a lost driver leaves it, does not count as a table."""
    store = FolderStore(spark, str(tmp_path / "tables"))
    (tmp_path / "tables" / "t" / "_temporary").mkdir(parents=True)
    data = tmp_path / "in"
    data.mkdir()
    (data / "t.csv").write_text("id\n1\n")
    assert report_of(load_folder(spark, str(data), store)) == {"t.csv": ("t", "loaded", 1)}


def test_discovery_groups_part_files(spark, tmp_path):
    data = str(tmp_path / "in")
    spark.range(100).repartition(3).write.csv(f"{data}/big.csv")
    (tmp_path / "in" / "part-of.csv").write_text("id\n1\n")
    rows = {r["name"]: r["n_parts"] for r in discover_files(spark, data).collect()}
    assert rows == {"big.csv": 3, "part-of.csv": 1}


def test_names_that_spark_hides_are_loaded(spark, tmp_path):
    data = tmp_path / "in"
    for folder in ("_d", ".h/_e", "_f [1]", ".extracting-x", "plain"):
        (data / folder).mkdir(parents=True)
    (data / "_a.csv").write_text("id,n\n1,20\n2,22\n")
    (data / "plain" / ".b.txt").write_text("id|n\n3,5|4\n")
    (data / "_d" / "c.csv").write_text("id\n1\n")
    (data / ".h" / "_e" / "_d.csv").write_text("id\n1\n2\n3\n")
    (data / "_f [1]" / "f.txt").write_text("id\n1\n")
    spark.range(10).repartition(2).write.csv(str(data / "_d" / "_parts.csv"), header=True)
    (data / "_bad.csv").write_bytes(b"site,n\nM\xfcnster\xe9,8\n")
    (data / "_d" / "._c.csv").write_text("id\n1\n")
    (data / ".extracting-x" / "half.csv").write_text("id\n1\n")
    store = FolderStore(spark, str(tmp_path / "tables"))
    report = load_folder(spark, str(data), store)
    assert report_of(report) == {
        "_a.csv": ("t__a", "loaded", 2),
        ".b.txt": ("t_.b", "loaded", 1),
        "c.csv": ("c", "loaded", 1),
        "_d.csv": ("t__d", "loaded", 3),
        "f.txt": ("f", "loaded", 1),
        "_parts.csv": ("t__parts", "loaded", 10),
        "_bad.csv": ("t__bad", "failed", None),
    }
    assert store.read("t__a").selectExpr("sum(n)").first()[0] == 42
    assert store.names() == ["c", "f", "t_.b", "t__a", "t__d", "t__parts"]
    again = load_folder(spark, str(data), store).where("status = 'loaded'")
    assert again.count() == 0


def test_archives_in_hidden_folders_are_unpacked(spark, tmp_path):
    import zipfile

    from trialspark.sources.archives import expand_archives

    for folder in ("_z", ".z"):
        (tmp_path / folder).mkdir()
        with zipfile.ZipFile(tmp_path / folder / "_x.zip", "w") as zipped:
            zipped.writestr("_rows.csv", "id\n1\n")
    report = [r["status"] for r in expand_archives(spark, str(tmp_path)).collect()]
    assert report == ["extracted"] * 2
    assert (tmp_path / "_z" / "_x" / "_rows.csv").exists() and (tmp_path / ".z" / "_x" / "_rows.csv").exists()
    assert [r["status"] for r in expand_archives(spark, str(tmp_path)).collect()] == ["skipped"] * 2


def test_half_written_table_is_written_anew(spark, tmp_path):
    import os

    store = FolderStore(spark, str(tmp_path / "store"))
    store.create("visits", spark.range(3).toDF("n"))
    os.remove(tmp_path / "store" / "visits" / "_SUCCESS")
    assert not store.exists("visits")
    store.create("visits", spark.range(100).toDF("n"))
    assert store.exists("visits") and store.read("visits").count() == 100
