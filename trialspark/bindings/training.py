"""Text-to-SQL queries: conversation turns as questions and model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.bindings.catalog import SQL_BULLETS, SQL_SCHEMA_TEXT, sampled_schema
from trialspark.bindings.registry import all_tables, query, sql_text, table
from trialspark.functions.text import sql_from_answer, sql_from_console_answer
from trialspark.operators import text_to_sql as ops
from trialspark.plans import catalog as plans
from trialspark.plans.store import FolderStore
from trialspark.session import new_workspace


def _sql_template(template: str, **values: str) -> str:
    """Template as a SQL concatenation, slots replaced by SQL expressions."""
    text = sql_text(template)
    for name, expression in values.items():
        text = text.replace("{" + name + "}", f"' || {expression} || '")
    return text


@query(
    f"""SELECT table_name, request_no, {_sql_template(ops.PAIR_REQUEST, schema='text')} AS prompt
    FROM {SQL_BULLETS}, (SELECT unnest(range(1, (SELECT count(*) FROM conversations) + 1)) AS request_no)"""
)
def pair_requests(spark: SparkSession, folder: str) -> DataFrame:
    """As many requests per table as there are conversation turns."""
    count = table(spark, folder, "conversations").count()
    return ops.pair_requests(plans.schema_bullets(spark, all_tables(spark, folder)), count)


@query(
    f"""SELECT conv_id, turn, {_sql_template(
        ops.QUESTION_PROMPT,
        schema="(SELECT string_agg(text, chr(10) || chr(10) ORDER BY table_name) FROM " + SQL_SCHEMA_TEXT + ")",
        question="text",
    )} AS prompt FROM conversations WHERE role = 'user'"""
)
def render_prompts(spark: SparkSession, folder: str) -> DataFrame:
    questions = table(spark, folder, "conversations").where("role = 'user'")
    schema = plans.joined_schema_text(sampled_schema(spark, folder))
    return ops.question_prompts(questions, "text", schema).select("conv_id", "turn", "prompt")


def _turn_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """User turns with the assistant turn that follows."""
    turns = table(spark, folder, "conversations")
    users = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("asked"))
    replies = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("replied")
    )
    return users.join(replies, ["conv_id", "turn"])


SQL_TURN_PAIRS = """(SELECT u.conv_id, u.turn, u.text AS asked, a.text AS replied
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant')"""

# Forms of a model answer, and why a form is refused.
REFUSED_FORMS = (
    ("two_items", "not_three_items"),
    ("truncated", "bad_json"),
    ("object", "not_a_list"),
    ("no_response", "not_three_items"),
    ("raw_list", "response_not_text"),
    ("no_envelope", "bad_envelope"),
)


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of turns as a model answer in every form, good and bad."""
    asked, replied = F.col("asked"), F.col("replied")
    wrong = F.concat(F.lit("not \"this\": "), replied)

    def envelope(response: Column) -> Column:
        return F.to_json(F.struct(response.alias("response"), F.lit(True).alias("done")))

    listed = F.to_json(F.array(asked, replied, wrong))
    forms = {
        "strings": envelope(listed),
        "mixed": envelope(F.concat(F.lit(" [12, true, "), F.to_json(F.array(replied)), F.lit("]\n"))),
        "two_items": envelope(F.to_json(F.array(asked, replied))),
        "truncated": envelope(F.substring(listed, F.lit(1), F.length(listed) - 1)),
        "object": envelope(F.to_json(F.struct(asked, replied, wrong.alias("wrong")))),
        "no_response": F.to_json(F.struct(asked)),
        "raw_list": F.concat(F.lit('{"response": '), listed, F.lit("}")),
        "no_envelope": asked,
    }
    cells = [F.struct(F.lit(name).alias("form"), text.alias("answer")) for name, text in forms.items()]
    return _turn_pairs(spark, folder).select("conv_id", "turn", F.inline(F.array(*cells)))


SQL_ACCEPTED = f"""(SELECT conv_id, turn, 'strings' AS form, asked AS prompt, replied AS chosen,
        'not "this": ' || replied AS rejected FROM {SQL_TURN_PAIRS}
    UNION ALL SELECT conv_id, turn, 'mixed', '12', 'True', to_json([replied])::VARCHAR FROM {SQL_TURN_PAIRS})"""


@query(f"SELECT conv_id, turn, form, prompt, chosen, rejected FROM {SQL_ACCEPTED}")
def parse_pairs(spark: SparkSession, folder: str) -> DataFrame:
    parsed = ops.parse_pair_answers(_answers(spark, folder), "answer")
    return parsed.where("reason is null").drop("answer", "reason")


@query(
    f"SELECT conv_id, turn, form, reason FROM {SQL_TURN_PAIRS}, (VALUES "
    + ", ".join(f"('{form}', '{reason}')" for form, reason in REFUSED_FORMS)
    + ") AS v(form, reason)"
)
def pair_rejects(spark: SparkSession, folder: str) -> DataFrame:
    parsed = ops.parse_pair_answers(_answers(spark, folder), "answer")
    return parsed.where("reason is not null").select("conv_id", "turn", "form", "reason")


@query(
    f"""SELECT conv_id, turn, asked AS prompt, replied AS chosen, 'last' AS rejected, NULL AS reason FROM {SQL_TURN_PAIRS}
    UNION ALL SELECT conv_id, turn, NULL, NULL, NULL, 'bad_envelope' FROM {SQL_TURN_PAIRS}"""
)
def repeated_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Answers that name their response twice; a second object behind the first spoils one."""
    listed = [F.to_json(F.array("asked", "replied", F.lit(word))) for word in ("first", "last")]
    named = [F.regexp_extract(F.to_json(F.struct(text.alias("response"))), r"(?s)^\{(.*)\}$", 1) for text in listed]
    twice = F.concat(F.lit('{"done": true, '), named[0], F.lit(', "done": false, '), named[1], F.lit("}"))
    answers = _turn_pairs(spark, folder).select(
        "conv_id", "turn", F.explode(F.array(twice, F.concat(twice, F.lit(", {}")))).alias("answer")
    )
    return ops.parse_pair_answers(answers, "answer").drop("answer")


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return ops.valid_pairs(ops.parse_pair_answers(_answers(spark, folder), "answer"))


@query(f"SELECT 'Question: ' || prompt || '\\nSQL: ' || chosen AS text FROM {SQL_ACCEPTED}")
def pretrain_rows(spark: SparkSession, folder: str) -> DataFrame:
    return ops.pretrain_rows(_pairs(spark, folder))


@query(f"SELECT prompt, chosen AS completion FROM {SQL_ACCEPTED}")
def sft_rows(spark: SparkSession, folder: str) -> DataFrame:
    return ops.sft_rows(_pairs(spark, folder))


@query(f"SELECT prompt, chosen, rejected FROM {SQL_ACCEPTED}")
def dpo_rows(spark: SparkSession, folder: str) -> DataFrame:
    return ops.dpo_rows(_pairs(spark, folder))


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, 2 * count(*) AS n, 2 * sum(length({text}))::BIGINT AS n_chars FROM {SQL_ACCEPTED}"
        for name, text in (
            ("pretrain_data", "prompt || chosen"),
            ("sft_data", "prompt || chosen"),
            ("dpo_data", "prompt || chosen || rejected"),
        )
    )
)
def training_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The three tables after two appends of the same pairs."""
    store = FolderStore(spark, new_workspace(spark, "training"))
    pairs = _pairs(spark, folder)
    for _ in range(2):
        ops.append_training_tables(pairs, store)

    def size(name: str, text: Column) -> DataFrame:
        return store.read(name).agg(
            F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("n"),
            F.sum(F.length(text)).alias("n_chars"),
        )

    frame = len("Question: ") + len("\\nSQL: ")
    pretrain = size("pretrain_data", F.substring("text", frame + 1, 2**31 - 1))
    return (
        pretrain.union(size("sft_data", F.concat("prompt", "completion")))
        .union(size("dpo_data", F.concat("prompt", "chosen", "rejected")))
    )


# Forms of an answer around a SQL text, as (name, before, after).
ANSWER_FORMS = (
    ("bare", " \n", "\n "),
    ("fenced", "```sql\n", "\n```"),
    ("fenced_upper", "Thinking.\n```DuckDB\n", "\n```\nDone. ```sql\nSELECT 0\n```"),
    ("fenced_inline", "```", "```"),
    ("fenced_other", "```text\n", "\n```"),
    ("word", "SQL\n", ""),
    ("open_fence", "duckdb\n", "\n```"),
)

# Python's idea of white space, for DuckDB's regular expressions.
_SQL_STRIP = r"regexp_replace({0}, '^[\s\x1c-\x1f\x{{85}}\pZ]+|[\s\x1c-\x1f\x{{85}}\pZ]+$', '', 'g')"


def _sql_forms() -> str:
    values = ", ".join(f"('{n}', {sql_text(b)}, {sql_text(a)})" for n, b, a in ANSWER_FORMS)
    return f"(SELECT conv_id, turn, form, before || text || after AS answer, text FROM conversations, (VALUES {values}) AS v(form, before, after))"


def _forms(spark: SparkSession, folder: str) -> DataFrame:
    cells = [
        F.struct(F.lit(name).alias("form"), F.concat(F.lit(before), "text", F.lit(after)).alias("answer"))
        for name, before, after in ANSWER_FORMS
    ]
    return table(spark, folder, "conversations").select("conv_id", "turn", F.inline(F.array(*cells)))


@query(
    f"""SELECT conv_id, turn, form, CASE form
        WHEN 'fenced_other' THEN {_SQL_STRIP.format("'text' || chr(10) || text")}
        ELSE {_SQL_STRIP.format('text')} END AS sql
    FROM {_sql_forms()}"""
)
def extract_sql_api(spark: SparkSession, folder: str) -> DataFrame:
    return _forms(spark, folder).select("conv_id", "turn", "form", sql_from_answer("answer").alias("sql"))


@query(
    f"""WITH stripped AS (SELECT conv_id, turn, form, {_SQL_STRIP.format('answer')} AS s FROM {_sql_forms()}),
    opened AS (SELECT *, CASE WHEN NOT starts_with(s, '```') THEN s
        WHEN len(string_split(s, chr(10))) > 2 THEN array_to_string(string_split(s, chr(10))[2:-2], chr(10))
        ELSE replace(s, '```', '') END AS o FROM stripped)
    SELECT conv_id, turn, form, CASE WHEN lower(o) LIKE 'sql' || chr(10) || '%' THEN substr(o, 5)
        WHEN lower(o) LIKE 'duckdb' || chr(10) || '%' THEN substr(o, 8) ELSE o END AS sql
    FROM opened"""
)
def extract_sql_console(spark: SparkSession, folder: str) -> DataFrame:
    return _forms(spark, folder).select(
        "conv_id", "turn", "form", sql_from_console_answer("answer").alias("sql")
    )
