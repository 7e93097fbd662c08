"""Catalog pages, archives and the fetch plan."""

from __future__ import annotations

import os
import zipfile

import pytest

from trialspark.plans.fetch import fetch_manifest
from trialspark.sources.archives import _safe_member, expand_archives
from trialspark.sources.catalog_pages import TABLE_ID, datasets_in, extract_datasets

FILLER = "<td>a</td><td>b</td><td>c</td>"


def page(rows: str, attributes: str = f'id="{TABLE_ID}"') -> str:
    return f"<html><body><table {attributes}>{rows}</table></body></html>"


def row(protocol: str, dataset: str, document: str, attributes: str = "") -> str:
    return f"<tr {attributes}><td>{protocol}</td>{FILLER}<td>{dataset}</td><td>{document}</td></tr>"


VALID = row("Trial", '<img alt="http://d">', '<a data-url="http://doc"></a>')

PAGES = {
    "no_table": ("<html></html>", []),
    "other_table": (page(VALID, 'id="other"'), []),
    "valid": (page(VALID), [("Trial", "http://d", "http://doc")]),
    "single_quotes": (page(VALID, f"id='{TABLE_ID}'"), [("Trial", "http://d", "http://doc")]),
    "header": (page(row("H", "", "", 'class="headerstyle"')), []),
    "header_with_more": (page(row("H", "", "", 'class="headerstyle x"')), [("H", None, None)]),
    "group": (page(f'<tr><td class="a GroupHeaderStyle">G</td>{FILLER}<td></td><td></td></tr>'), []),
    "short": (page("<tr><td>one</td></tr>"), []),
    "no_protocol": (page(row(" \n", "", "")), []),
    "empty_alt": (page(row("T", '<img alt="">', "")), [("T", "", None)]),
    "image_first": (page(row("T", '<img alt="i"><a data-url="u">', "")), [("T", "i", None)]),
    "first_image_decides": (page(row("T", '<img><img alt="i"><a data-url="u"></a>', "")), [("T", "u", None)]),
    "first_data_link": (page(row("T", "<a>x</a><a data-url='u'></a><a data-url='v'></a>", "")), [("T", "u", None)]),
    "nested_text": (page(row(" T <b>&amp;</b> U<script>x()</script><!-- no -->", "", "")), [("T & U", None, None)]),
    "commented_out": (f"<!-- {page(VALID)} -->", []),
    "only_first_table": (page(VALID) + page(row("Second", "", "")), [("Trial", "http://d", "http://doc")]),
    "stray_end_tags": (page("</div></p>" + VALID + "</span>"), [("Trial", "http://d", "http://doc")]),
}


@pytest.mark.parametrize("name", PAGES)
def test_datasets_in(name):
    html, wanted = PAGES[name]
    assert datasets_in(html) == wanted


def test_extract_datasets(spark):
    pages = spark.createDataFrame([(i, html) for i, (html, _) in enumerate(PAGES.values())], "id int, html string")
    rows = extract_datasets(pages, "id").collect()
    got = sorted((r["id"], r["position"], r["protocol"], r["dataset_url"], r["document_url"]) for r in rows)
    wanted = [
        (i, at, protocol, dataset or None, document or None)
        for i, (_, found) in enumerate(PAGES.values())
        for at, (protocol, dataset, document) in enumerate(found, start=1)
    ]
    assert got == wanted


def test_expand_archives(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    with zipfile.ZipFile(tmp_path / "deep" / "test data.zip", "w", zipfile.ZIP_DEFLATED) as zipped:
        zipped.writestr("test.csv", "id,name\n1,a\n" * 50000)
        zipped.writestr("sub/folder/other.txt", "x")
        zipped.writestr("../../evil.csv", "id\n1\n")
    (tmp_path / "bad.zip").write_text("no archive")
    with zipfile.ZipFile(tmp_path / "done.zip", "w") as zipped:
        zipped.writestr("new.csv", "id\n1\n")
    (tmp_path / "done").mkdir()
    (tmp_path / "done" / "old.csv").write_text("id\n1\n")

    report = expand_archives(spark, str(tmp_path))
    rows = {(os.path.basename(r["archive"]), r["member"]): (r["status"], r["error"]) for r in report.collect()}
    assert rows == {
        ("test data.zip", "test.csv"): ("extracted", None),
        ("test data.zip", "sub/folder/other.txt"): ("extracted", None),
        ("test data.zip", "../../evil.csv"): ("extracted", None),
        ("bad.zip", None): ("failed", "Bad Zip File"),
        ("done.zip", None): ("skipped", None),
    }
    target = tmp_path / "deep" / "test data"
    assert (target / "test.csv").read_text() == "id,name\n1,a\n" * 50000
    assert (target / "sub" / "folder" / "other.txt").read_text() == "x"
    assert (target / "evil.csv").exists() and not (tmp_path / "evil.csv").exists()
    assert os.listdir(tmp_path / "done") == ["old.csv"]
    assert sorted(os.listdir(tmp_path / "deep")) == ["test data", "test data.zip"]

    again = expand_archives(spark, str(tmp_path)).collect()
    assert sorted(r["status"] for r in again) == ["failed", "skipped", "skipped"]


def test_damaged_member_fails_its_archive(spark, tmp_path):
    file = tmp_path / "damaged.zip"
    with zipfile.ZipFile(file, "w") as zipped:
        zipped.writestr("a.csv", "id\n1\n")
        zipped.writestr("b.csv", "payload payload payload")
    file.write_bytes(file.read_bytes().replace(b"payload payload payload", b"payload damaged payload"))
    rows = {r["member"]: r["status"] for r in expand_archives(spark, str(tmp_path)).collect()}
    assert rows == {"a.csv": "held_back", "b.csv": "failed"}
    assert not (tmp_path / "damaged").exists()


def test_archives_without_files_become_empty_folders(spark, tmp_path):
    zipfile.ZipFile(tmp_path / "none.zip", "w").close()
    with zipfile.ZipFile(tmp_path / "folders.zip", "w") as zipped:
        zipped.writestr("only/", "")
    (tmp_path / "text.zip").write_bytes(b"x")
    for _ in range(2):
        rows = {r["archive"].rsplit("/", 1)[1]: (r["member"], r["status"]) for r in expand_archives(spark, str(tmp_path)).collect()}
        assert rows == {"none.zip": (None, "extracted"), "folders.zip": (None, "extracted"), "text.zip": (None, "failed")}
        assert (tmp_path / "none").is_dir() and (tmp_path / "folders").is_dir()
        assert not list(tmp_path.glob(".extracting-*"))


def test_safe_member():
    assert _safe_member("/abs/x.csv") == "abs/x.csv"
    assert _safe_member("a\\..\\b.csv") == "a/b.csv"
    assert _safe_member("folder/") is None


def test_fetch_manifest(spark):
    datasets = spark.createDataFrame(
        [
            (1, "Trial (A)", "http://x/file%20one.zip", "https://doi.org/10.1/a"),
            (2, "Trial A", "http://y/file%20one.zip", "https://doi.org/10.1/b"),
            (3, "B", "http://x/dir/", None),
            (4, "B", None, "http://x/there.pdf"),
            (5, "C", None, None),
            (6, "D", "http://x/same.zip", "http://y/same.zip"),
            (7, "D", "http://z/other", "http://w/same.zip"),
        ],
        "n int, protocol string, dataset_url string, document_url string",
    )
    existing = spark.createDataFrame([("data/B/there.pdf",)], "target string")
    rows = fetch_manifest(datasets, "n", existing, "data").orderBy("n", "kind").collect()
    assert [(r["n"], r["kind"], r["target"], r["action"]) for r in rows] == [
        (1, "dataset", "data/Trial_A/file one.zip", "download"),
        (1, "document", "data/Trial_A/dataset_link.txt", "save_link"),
        (2, "dataset", "data/Trial_A/file one.zip", "skip_exists"),
        (2, "document", "data/Trial_A/dataset_link.txt", "skip_exists"),
        (3, "dataset", "data/B/downloaded_file", "download"),
        (4, "document", "data/B/there.pdf", "skip_exists"),
        (6, "dataset", "data/D/same.zip", "download"),
        (6, "document", "data/D/same.zip", "skip_exists"),
        (7, "dataset", "data/D/other", "download"),
        (7, "document", "data/D/same.zip", "skip_exists"),
    ]


def test_fetch_manifest_with_a_hot_target(spark):
    """A third of all requests want one file: the requests are folded before the shuffle."""
    datasets = spark.range(3000).selectExpr(
        "id as n",
        "if(id % 3 = 0, 'Hot', concat('P', id)) as protocol",
        "'http://x/one.zip' as dataset_url",
        "cast(null as string) as document_url",
    )
    existing = spark.createDataFrame([("data/P1/one.zip",)], "target string")
    manifest = fetch_manifest(datasets, "n", existing, "data")
    counts = {r["action"]: r["count"] for r in manifest.groupBy("action").count().collect()}
    assert counts == {"download": 1 + 2000 - 1, "skip_exists": 999 + 1}
    assert manifest.where("action = 'download' and target like '%Hot%'").first()["n"] == 0
    plan = manifest._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "LeftAnti" not in plan and "partial_min" in plan
