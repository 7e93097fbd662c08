"""The operators of this subpackage bound to the sample tables, by query name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm import (
    decontamination,
    fill_in_middle,
    hard_negatives,
    language,
    line_dedup,
    line_rules,
    near_dedup,
    pieces,
    pii,
    quality,
    suffix_dedup,
    toxicity,
    url_filter,
)
from trialspark.llm.hashed_linear import held_out

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(function):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents").select("doc_id", "text")


def labelled_texts(spark: SparkSession, folder: str, label: str) -> DataFrame:
    """Texts with a label that may be learnt from: not the held-out fifth."""
    labels = _table(spark, folder, "labels").where(f"{label} IS NOT NULL")
    marks = labels.select("doc_id", F.col(label).alias("label"))
    return _texts(spark, folder).join(marks, "doc_id").where(~held_out())


def _scored(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]


@_query
def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """The number in a page's URL is the document it shows, whose quality mark labels the URL."""
    pages = _table(spark, folder, "pages").select("page_id", "url")
    shown = F.expr("try_cast(regexp_extract(url, '/[a-z]+/([0-9]+)', 1) AS bigint)")
    labels = _table(spark, folder, "labels").where("quality IS NOT NULL")
    marks = labels.select("doc_id", (1 - F.col("quality")).alias("label"))
    labelled = pages.join(marks, shown == F.col("doc_id")).select("url", "label")
    model = url_filter.fit(labelled.where(~url_filter.held_out()))
    threshold = url_filter.choose_threshold(labelled.where(url_filter.held_out()), model)
    return url_filter.judge(pages, model, RULES, threshold.score).select(
        "page_id", "host", "path", "rule", "verdict", "score"
    )


@_query
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    model = toxicity.fit(labelled_texts(spark, folder, "toxic"))
    return _scored(toxicity.score(_texts(spark, folder), model), 0.5)


@_query
def op3_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(_texts(spark, folder), _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


ORACLES["op3_benchmark_decontamination"] = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size,
    array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS window_text
  FROM item_words, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS r(s) WHERE len(w) > 0
), doc_words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), doc_windows AS (
  SELECT doc_id, size, s, array_to_string(w[s : s + size - 1], ' ') AS window_text
  FROM doc_words, (SELECT DISTINCT size FROM windows) AS sizes, unnest(range(1, len(w) - size + 2)) AS r(s)
), hits AS (
  SELECT doc_id, s, d.size AS size, item_id FROM doc_windows AS d JOIN windows AS i USING (window_text)
), positions AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(s, s + size)) AS r(p) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS written
  FROM hits GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(written, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN positions USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@_query
def op4_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.repeated_bytes(_texts(spark, folder))
    lengths = F.transform("spans", lambda span: span["end"] - span["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate(lengths, F.lit(0).cast("long"), lambda total, one: total + one).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        "kept_sha256",
    )


@_query
def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    weights = quality.fit(labelled_texts(spark, folder, "quality"))
    return _scored(quality.score(_texts(spark, folder), weights), quality.THRESHOLD)


@_query
def op9_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(_texts(spark, folder), 85)


@_query
def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    vocabulary = pieces.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.tokenize(_texts(spark, folder), vocabulary).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


@_query
def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.with_spans(_texts(spark, folder))
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE_KINDS))

    def number(kind: str):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        *(number(kind) for kind in pii.BASE_KINDS),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("pii")).alias("spans"),
    )


@_query
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    apart = held_out(parts=3, part=1)
    profiles = language.fit(docs.where(~apart))
    found = language.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", apart.alias("held_out"), "lang_pred", "score")


@_query
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    model = line_rules.fit(labelled_texts(spark, folder, "quality"))
    return line_rules.judge(_texts(spark, folder), model).drop("text")


@_query
def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.without_frequent_lines(_texts(spark, folder)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256")
    )


ORACLES["op11_line_dedup"] = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT r, doc_id, unnest(range(1, len(lines) + 1)) AS place, unnest(lines) AS line FROM texts
), keyed AS (
  SELECT *, translate(
    trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
), marked AS (
  SELECT k.r, k.doc_id, k.place, k.line, f.key IS NOT NULL AS dropped FROM keyed AS k LEFT JOIN frequent AS f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""


@_query
def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    found = fill_in_middle.cut(_texts(spark, folder))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return found.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"),
        F.sha2(F.encode(back, "UTF-8"), 256).alias("restored_sha256"),
    )


ORACLES["op12_fill_in_middle"] = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents
), draws AS (
  SELECT *, [CAST('0x' || substr(hex, 1 + 8 * i, 8) AS UBIGINT) FOR i IN range(0, 4)] AS h, len(u) AS n FROM units
), cuts AS (
  SELECT *, CAST(least(h[1] % (n + 1), h[2] % (n + 1)) AS BIGINT) AS a,
    CAST(greatest(h[1] % (n + 1), h[2] % (n + 1)) AS BIGINT) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
           OR h[3] % 100 >= 100 THEN 'plain'
         WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM draws
), parts AS (
  SELECT *, array_to_string(u[1 : a], '') AS prefix, array_to_string(u[a + 1 : b], '') AS middle,
    array_to_string(u[b + 1 : n], '') AS suffix FROM cuts
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


@_query
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.usable(_table(spark, folder, "embeddings").withColumn("label", relabelled))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


ORACLES["op13_hard_negatives"] = r"""
WITH points AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS p
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same,
    CAST(list_dot_product(a.p, b.p) AS BIGINT) AS score
  FROM points AS a JOIN points AS b ON a.id <> b.id WHERE a.id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
