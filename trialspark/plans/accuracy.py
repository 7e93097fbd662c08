"""Execution accuracy: do predicted statements give the results of the gold ones?"""

from __future__ import annotations

from functools import reduce
from itertools import islice

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.operators.relational import compare_results
from trialspark.plans.sql import NotReadOnly, run_sql

VERDICT_SCHEMA = "pair_id long, verdict string, n_predicted long, n_gold long"

EQUAL, DIFFERENT = "equal", "different"
PREDICTED_FAILED, GOLD_FAILED = "predicted_failed", "gold_failed"

# A 64-bit hash is summed in pieces of this many bits, so that sums over 2^41 rows fit.
PIECE_BITS = 22
PIECES = 3


def execution_accuracy(spark: SparkSession, pairs: DataFrame, pairs_per_job: int = 32) -> DataFrame:
    """Verdict for each row ``(pair_id, predicted, gold)`` of SQL texts over the session's views.

    Returns ``(pair_id, verdict, n_predicted, n_gold)``. Results are equal if they hold the
    same rows equally often, in any order and under any column names; numbers compare by
    value, dates with timestamps, other types only with themselves (values with maps inside by
    their JSON text). A statement that is
    no read-only query, or fails, gives ``predicted_failed`` or ``gold_failed`` (the gold
    one is looked at first) and no counts. Results of different widths or types are
    different, again without counts.

    One job fingerprints the results of ``pairs_per_job`` pairs: signed sums of row hashes,
    so each task sends one row per pair, however large the results are. Only pairs with
    equal fingerprints are compared row by row, by a second job. A job that fails as it
    runs is repeated in halves, down to the pair that fails. Texts pass the driver, which has to plan them; rows
    of results never do.
    """
    texts = pairs.select("pair_id", "predicted", "gold").toLocalIterator()
    verdicts: list[tuple] = []
    while batch := list(islice(texts, pairs_per_job)):
        verdicts += _judged(spark, batch)
    return spark.createDataFrame(verdicts, VERDICT_SCHEMA)


def _judged(spark: SparkSession, batch: list[Row]) -> list[tuple]:
    planned, verdicts = [], []
    for number, row in enumerate(batch):
        gold, predicted = _planned(spark, row["gold"]), _planned(spark, row["predicted"])
        if gold is None or predicted is None:
            verdicts.append((row["pair_id"], GOLD_FAILED if gold is None else PREDICTED_FAILED, None, None))
        elif not _comparable(predicted, gold):
            failed = _failing(predicted, gold)
            verdicts.append((row["pair_id"], failed or DIFFERENT, None, None))
        else:
            planned.append((number, row["pair_id"], predicted, gold))
    return verdicts + _compared(planned)


def _planned(spark: SparkSession, text: str | None) -> DataFrame | None:
    try:
        result = run_sql(spark, text or "")
        result.schema  # noqa: B018 - analysis fails here, if it does
    except (PySparkException, NotReadOnly):
        return None
    columns = [f"c{i}" for i in range(len(result.columns))]
    kinds = [field.dataType for field in result.schema.fields]
    return result.toDF(*columns).select(*map(_hashable, columns, kinds))


def _hashable(name: str, kind: T.DataType) -> Column:
    """A column in a form that can be hashed and grouped: maps as sorted entries, else as JSON text."""
    if isinstance(kind, T.MapType) and not _holds_map(kind.valueType):
        return F.array_sort(F.map_entries(name)).alias(name)
    return F.to_json(F.struct(name)).alias(name) if _holds_map(kind) else F.col(name)


def _holds_map(kind: T.DataType) -> bool:
    return any(word in kind.simpleString() for word in ("map<", "variant"))


def _family(kind: T.DataType) -> object:
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return kind.simpleString()


def _comparable(predicted: DataFrame, gold: DataFrame) -> bool:
    left, right = ([_family(field.dataType) for field in df.schema.fields] for df in (predicted, gold))
    return len(left) == len(right) and all(
        ours == theirs or "void" in (ours, theirs) for ours, theirs in zip(left, right)
    )


def _failing(predicted: DataFrame, gold: DataFrame) -> str | None:
    for result, verdict in ((gold, GOLD_FAILED), (predicted, PREDICTED_FAILED)):
        try:
            result.write.format("noop").mode("overwrite").save()
        except PySparkException:
            return verdict
    return None


def _compared(planned: list[tuple]) -> list[tuple]:
    """Verdicts of pairs that could be planned; fails for none of them."""
    if not planned:
        return []
    try:
        prints = {row["number"]: row for row in reduce(DataFrame.union, map(_fingerprint, planned)).collect()}
        ties = [pair for pair in planned if _tied(prints[pair[0]])]
        exact = [compare_results(pair[2], pair[3]).select(F.lit(pair[0]).alias("number"), "equal") for pair in ties]
        equal = {row["number"] for row in reduce(DataFrame.union, exact).where("equal").collect()} if exact else set()
    except PySparkException:
        half = len(planned) // 2
        if half:
            return _compared(planned[:half]) + _compared(planned[half:])
        (_, pair_id, predicted, gold) = planned[0]
        return [(pair_id, _failing(predicted, gold) or DIFFERENT, None, None)]
    return [
        (pair_id, EQUAL if number in equal else DIFFERENT, prints[number]["n_predicted"], prints[number]["n_gold"])
        for number, pair_id, _, _ in planned
    ]


def _pieces(row_hash: Column) -> list[Column]:
    mask = (1 << PIECE_BITS) - 1
    return [F.shiftrightunsigned(row_hash, PIECE_BITS * i).bitwiseAND(F.lit(mask)) for i in range(PIECES)]


def _fingerprint(pair: tuple) -> DataFrame:
    """``(number, n_predicted, n_gold, s0..)``: all sums are 0 if both results hold the same rows."""
    number, _, predicted, gold = pair
    names = [f"c{i}" for i in range(len(gold.columns))]
    signed = (
        predicted.toDF(*names)
        .withColumn("_sign", F.lit(1))
        .union(gold.toDF(*names).withColumn("_sign", F.lit(-1)))
    )
    # A union brings both sides to common types, so equal values have equal hashes.
    hashes = [F.xxhash64(F.lit(seed), *names) for seed in (1, 2)]
    pieces = [piece for row_hash in hashes for piece in _pieces(row_hash)]
    sums = [F.coalesce(F.sum(F.col("_sign") * piece), F.lit(0)).alias(f"s{i}") for i, piece in enumerate(pieces)]
    return signed.agg(
        F.count_if(F.col("_sign") == 1).alias("n_predicted"), F.count_if(F.col("_sign") == -1).alias("n_gold"), *sums
    ).select(F.lit(number).alias("number"), "*")


def _tied(seen: Row) -> bool:
    return seen["n_predicted"] == seen["n_gold"] and not any(seen[f"s{i}"] for i in range(2 * PIECES))
