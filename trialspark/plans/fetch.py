"""Plan of what to fetch for a table of datasets; transfers are left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.functions.text import is_doi, sanitize_name, target_file_name


def fetch_manifest(datasets: DataFrame, order_by: str, existing: DataFrame, base: str) -> DataFrame:
    """One row per wanted link: ``(order_by, kind, url, target, action)``.

    ``order_by`` is the unique processing order of the datasets, ``existing`` a
    ``(target)`` listing of files that are there already. A target is written
    once, by its first request; later requests, and targets that exist, are
    ``skip_exists``. Others are ``save_link`` (DOI) or ``download``.

    First requests and existing files meet in one partial aggregate by target,
    and the winners go back by the unique request key, so a target wanted by a
    third of all requests never meets in one task.
    """
    folder = F.concat_ws("/", F.lit(base), sanitize_name("protocol"))
    targets = datasets.select(
        order_by,
        "dataset_url",
        "document_url",
        F.concat_ws("/", folder, target_file_name("dataset_url")).alias("dataset_target"),
        F.concat_ws("/", folder, target_file_name("document_url")).alias("document_target"),
    )
    # Both links of a dataset may name one file: then the document is the repeat.
    repeats = F.col("dataset_url").isNotNull() & F.col("dataset_target").eqNullSafe(F.col("document_target"))
    links = [
        F.struct(
            F.lit(step).alias("step"),
            F.lit(kind).alias("kind"),
            F.col(f"{kind}_url").alias("url"),
            F.col(f"{kind}_target").alias("target"),
            repeated.alias("repeated"),
        )
        for step, kind, repeated in ((1, "dataset", F.lit(False)), (2, "document", repeats))
    ]
    requests = targets.select(order_by, F.inline(F.array(*links))).where("url is not null")
    known = existing.select(
        "target",
        F.lit(None).cast(datasets.schema[order_by].dataType).alias(order_by),
        F.lit(None).cast("int").alias("step"),
        F.lit(True).alias("present"),
    )
    candidates = requests.where("not repeated").select(
        "target", order_by, "step", F.lit(False).alias("present")
    )
    to_fetch = (
        candidates.union(known)
        .groupBy("target")
        .agg(
            F.min(order_by).alias(order_by),
            F.min_by("step", order_by).alias("step"),
            F.bool_or("present").alias("present"),
        )
        .where("not present")
        .select(order_by, "step", F.lit(True).alias("wanted"))
    )
    return requests.join(to_fetch, [order_by, "step"], "left").select(
        order_by,
        "kind",
        "url",
        "target",
        F.when(F.col("wanted").isNull(), "skip_exists")
        .when(is_doi("url"), "save_link")
        .otherwise("download")
        .alias("action"),
    )
