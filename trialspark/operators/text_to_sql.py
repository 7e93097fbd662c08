"""Text-to-SQL data: requests and prompts out, model answers in, training rows."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.operators.cohorts import ADULT_AGE
from trialspark.operators.glucose import HIGH, LOW, VERY_HIGH, VERY_LOW
from trialspark.plans.store import TableStore
from trialspark.session import ensure_checkpoint_dir

PAIR_REQUEST = (
    "Here is one table of a database:\n{schema}\n"
    "Write a question about it, a SQL query that answers the question, and a query "
    "that looks right but is not. Answer with a JSON array of three strings: "
    '["question", "right query", "wrong query"].'
)

QUESTION_PROMPT = (
    "Translate the request below into one Spark SQL SELECT statement.\n\n"
    "Tables:\n{schema}\n\n"
    "Vocabulary:\n"
    f"- lows: glucose under {LOW} mg/dL (severe: under {VERY_LOW})\n"
    f"- highs: glucose over {HIGH} mg/dL (severe: over {VERY_HIGH})\n"
    f"- in range: glucose from {LOW} to {HIGH} mg/dL\n"
    "- HbA1c: laboratory results in percent, missing ones left out\n"
    "- variability: sample standard deviation of glucose, and CV, which is 100 times it by the mean\n"
    "- mean glucose and GMI: average glucose, and 3.31 + 0.02392 times it\n"
    "- adverse events: counts of DKA and of severe hypoglycaemia, zero where none is recorded\n"
    "- demographics: age, sex, BMI and years with diabetes, one row per subject\n"
    "- arms: the treatment a subject was assigned to, such as pump, injections or closed loop\n"
    f"- kids: age under {ADULT_AGE}; adults: age {ADULT_AGE} and over\n"
    "- baseline: visit 0 or the baseline flag; end of trial: the greatest visit\n"
    "Rules:\n"
    "- trials combined: UNION ALL the aligned rows, then aggregate\n"
    "- trials one by one: aggregate each under a literal trial name, then UNION ALL\n"
    "- outcomes by demographics: join on the subject id, whose column name may differ by table\n"
    "- numbers kept as text: CAST before averaging; nulls do not count\n"
    "- use only the tables and columns listed above\n\n"
    "Request: {question}"
)


def _filled(template: str, **values: Column) -> Column:
    """Template with its ``{name}`` slots replaced by columns, as one concat."""
    parts: list[Column] = []
    rest = template
    while rest:
        slots = [(rest.find("{" + name + "}"), name) for name in values]
        start, name = min((slot for slot in slots if slot[0] >= 0), default=(len(rest), ""))
        if start:
            parts.append(F.lit(rest[:start]))
        if name:
            parts.append(values[name])
        rest = rest[start + len(name) + 2 :]
    return F.concat(*parts)


# The tables that this module writes, which no request is about.
TRAINING_NAMES = ("pretrain_data", "sft_data", "dpo_data")


def pair_requests(
    bullets: DataFrame,
    count: int,
    template: str = PAIR_REQUEST,
    left_out: Collection[str] = TRAINING_NAMES,
) -> DataFrame:
    """``(table_name, request_no, prompt)``: ``count`` identical requests per table.

    The tables ``left_out`` get none, so that a second run does not ask about the
    training tables of the first.

    ``bullets`` is ``(table_name, text)``, one row per table. The grid is a
    distributed range that looks its table up in an array of the texts, so it
    needs no join and is as parallel as it is long.
    """
    tables = F.array_sort(F.collect_list(F.struct("table_name", "text")))
    bullets = bullets.where(~F.col("table_name").isin(*left_out)) if left_out else bullets
    listing = bullets.agg(tables.alias("tables"))
    n_tables = bullets.count()
    slots = bullets.sparkSession.range(count * n_tables)
    return (
        slots.withColumn("at", (F.col("id") % n_tables + 1).cast("int"))
        .select(
            F.element_at(listing.scalar(), F.col("at")).alias("t"),
            F.expr(f"id div {n_tables} + 1").alias("request_no"),
        )
        .select(
            F.col("t.table_name").alias("table_name"),
            "request_no",
            _filled(template, schema=F.col("t.text")).alias("prompt"),
        )
    )


def question_prompts(
    questions: DataFrame, question: str, schema_text: DataFrame, template: str = QUESTION_PROMPT
) -> DataFrame:
    """Questions with a ``prompt`` column; ``schema_text`` is a one-row table."""
    schema = schema_text.scalar()
    return questions.withColumn(
        "prompt", _filled(template, schema=schema, question=F.col(question))
    )


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _item_text(item: Column) -> Column:
    """A JSON item as text; objects and arrays keep their JSON form."""
    kind = F.schema_of_variant(item)
    text = item.cast("string")
    return (
        F.when(item.isNull() | (kind == "VOID"), "None")
        .when(kind == "BOOLEAN", F.initcap(text))
        .otherwise(text)
    )


def _outcome(reason: str | None, items: Column | None = None) -> Column:
    values = [F.lit(None).cast("string")] * 3
    if items is not None:
        values = [_item_text(F.get(items, F.lit(position))) for position in range(3)]
    return F.struct(
        values[0].alias("prompt"),
        values[1].alias("chosen"),
        values[2].alias("rejected"),
        F.lit(reason).cast("string").alias("reason"),
    )


def _parsed_list(parsed: Column) -> Column:
    """Outcome of the JSON value inside a response."""
    return F.when(parsed.isNull(), _outcome("bad_json")).otherwise(
        _let(
            F.try_variant_get(parsed, "$", "array<variant>"),
            lambda items: F.when(items.isNull(), _outcome("not_a_list"))
            .when(F.size(items) != 3, _outcome("not_three_items"))
            .otherwise(_outcome(None, items)),
        )
    )


def _parsed_response(response: Column) -> Column:
    """Outcome of what an answer holds under ``response``."""
    return (
        F.when(response.isNull(), _outcome("not_three_items"))
        .when(F.schema_of_variant(response) != "STRING", _outcome("response_not_text"))
        .otherwise(_let(F.try_parse_json(response.cast("string")), _parsed_list))
    )


def _parsed_repeats(text: Column) -> Column:
    """Outcome of an answer that is no JSON text without repeated keys.

    Reading one field keeps the last of several of its name. The text is put into an array
    of an outer object: with just that object's two keys and one element in the array, it
    is one whole object.
    """
    outer = F.concat(F.lit('{"answer": ['), text, F.lit('], "end": 1}'))
    objects = F.from_json(outer, "struct<answer array<struct<response variant>>>")["answer"]
    whole = F.json_object_keys(outer) == F.array(F.lit("answer"), F.lit("end"))
    found = _let(
        F.when(whole, objects),
        lambda parsed: F.when(
            (F.size(parsed) == 1) & F.get(parsed, F.lit(0)).isNotNull(),
            _let(F.get(parsed, F.lit(0))["response"], _parsed_response),
        ).otherwise(_outcome("bad_envelope")),
    )
    # Other texts than objects are not parsed again.
    return F.when(text.rlike(r"^\s*\{"), found).otherwise(_outcome("bad_envelope"))


def _parsed_envelope(envelope: Column, text: Column) -> Column:
    """Outcome of an answer's JSON object; ``envelope`` is null if a key repeats or it is none."""
    is_object = F.schema_of_variant(envelope).startswith("OBJECT")
    return (
        F.when(envelope.isNull(), _parsed_repeats(text))
        .when(~is_object, _outcome("bad_envelope"))
        .otherwise(_let(F.try_variant_get(envelope, "$.response", "variant"), _parsed_response))
    )


def parse_pair_answers(answers: DataFrame, answer: str) -> DataFrame:
    """Model answers with ``prompt, chosen, rejected, reason`` added.

    An answer is a JSON object whose ``response`` (default: an empty list) is a
    text that holds a JSON array of three items. Items become strings. For any
    other answer the three columns are null and ``reason`` says why.

    Of an envelope's repeated keys the last one counts. Each JSON text is parsed once (one with
    repeated keys, or a broken object, twice); the outcome comes out of a generator, so that
    a later filter on it does not parse the answer again.
    """
    text = F.col(answer)
    outcome = _let(F.try_parse_json(text), lambda envelope: _parsed_envelope(envelope, text))
    return answers.select("*", F.inline(F.array(outcome)))


def valid_pairs(parsed: DataFrame) -> DataFrame:
    """Accepted answers as ``(prompt, chosen, rejected)``."""
    return parsed.where("reason is null").select("prompt", "chosen", "rejected")


def pretrain_rows(pairs: DataFrame) -> DataFrame:
    """``(text)``: question and query joined by a literal backslash and ``n``."""
    return pairs.select(
        F.concat(F.lit("Question: "), "prompt", F.lit("\\nSQL: "), "chosen").alias("text")
    )


def sft_rows(pairs: DataFrame) -> DataFrame:
    """``(prompt, completion)``."""
    return pairs.select("prompt", F.col("chosen").alias("completion"))


def dpo_rows(pairs: DataFrame) -> DataFrame:
    """``(prompt, chosen, rejected)``."""
    return pairs.select("prompt", "chosen", "rejected")


# The training tables.
TRAINING_TABLES = dict(zip(TRAINING_NAMES, (pretrain_rows, sft_rows, dpo_rows)))


def append_training_tables(pairs: DataFrame, store: TableStore) -> None:
    """Append the pairs to the three training tables at once; a repeated call adds them again.

    Over a folder store a failure leaves all three tables as they were.

    The pairs are checkpointed first, so that all three tables get the same rows
    even if an executor is lost between the writes.
    """
    ensure_checkpoint_dir(pairs.sparkSession)
    settled = pairs.checkpoint()
    store.append_all({name: rows(settled) for name, rows in TRAINING_TABLES.items()})
