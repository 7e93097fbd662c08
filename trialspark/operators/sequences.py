"""Operators on the order of a subject's rows: as-of join, episodes, time-weighted range.

All rows are sorted once over the whole cluster, by subject and time, and cut into
ranges of about equal size ("pieces"), so a subject with a third of all rows is cut by
time and never sits in one task. Tasks stream over their piece in batches. What crosses
a border between pieces is settled afterwards from a row or two per piece; the pieces'
results are stored first, so that both steps see the same cuts even if executors are lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from datetime import timedelta

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from trialspark.operators.glucose import HIGH, LOW
from trialspark.session import new_workspace

Batches = Iterable[pa.RecordBatch]
RIGHT, LEFT = 0, 1
SHARES = ("below", "inside", "above")


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _key_names(by: Sequence[str]) -> list[str]:
    return [f"k{at}" for at in range(len(by))]


def _key_columns(by: Sequence[str]) -> list[Column]:
    return [_named(name).alias(key) for name, key in zip(by, _key_names(by))]


def _in_pieces(rows: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Rows sorted over all pieces, with the number of their ``piece``; one shuffle."""
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranges.withColumn("piece", F.spark_partition_id())


def _stored(pieces: DataFrame, purpose: str) -> DataFrame:
    """Results of pieces, written once; rows of borders apart, so that reading them costs little."""
    path = new_workspace(pieces.sparkSession, purpose)
    pieces.write.partitionBy("border").parquet(path)
    return pieces.sparkSession.read.schema(pieces.schema).parquet(path)


def _starts_key(batch: pa.RecordBatch, last: pa.RecordBatch | None, keys: Sequence[str]) -> np.ndarray:
    """For each row whether its key differs from that of the row before, be it in the last batch."""
    changed = np.zeros(batch.num_rows, dtype=bool)
    changed[0] = last is None
    for key in keys:
        values = batch.column(key)
        before = values.slice(0, 1) if last is None else last.column(key)
        chain = pa.concat_arrays([before, values])
        differs = pc.fill_null(pc.not_equal(chain.slice(1), chain.slice(0, len(values))), True)
        changed |= differs.to_numpy(zero_copy_only=False)
    return changed


def _carried(keys: Sequence[str], schema: pa.Schema):
    """Task of ``asof_join``: left rows with the last right row of their key in the piece."""

    def work(batches: Batches) -> Iterator[pa.RecordBatch]:
        last, seen = None, None
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            right = batch.column("r")
            seen = pa.nulls(1, right.type) if seen is None else seen
            place = np.arange(1, size + 1)
            side = batch.column("side").to_numpy()
            latest = np.maximum.accumulate(np.where(side == RIGHT, place, 0))
            begun = np.maximum.accumulate(np.where(_starts_key(batch, last, keys), place, 0))
            chosen = pa.array(latest, pa.int64(), mask=latest < begun)
            match = pa.concat_arrays([seen, right]).take(chosen)
            asked = pa.array(side == LEFT)
            out = {key: batch.column(key) for key in keys} | {"l": batch.column("l"), "r": match}
            out |= {"piece": batch.column("piece"), "border": pa.array(np.zeros(size, np.int32))}
            yield pa.RecordBatch.from_arrays([out[name] for name in schema.names], schema.names).filter(asked)
            last, seen = batch.slice(size - 1), match.slice(size - 1)
        if last is not None:
            out = {key: last.column(key) for key in keys} | {"l": pa.nulls(1, last.column("l").type), "r": seen}
            out |= {"piece": last.column("piece"), "border": pa.array([1], pa.int32())}
            yield pa.RecordBatch.from_arrays([out[name] for name in schema.names], schema.names)

    return work


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_time: str,
    right_time: str,
    into: str = "match",
    forward: bool = False,
    max_gap: timedelta | None = None,
) -> DataFrame:
    """Left rows, each with the last right row of its keys at or before its time.

    The right row comes as one struct column ``into``, null where there is none or where
    it is more than ``max_gap`` away. ``forward`` takes the first one at or after instead.
    Of right rows with equal keys and times the one with the greatest hash wins, equal
    rows being the same anyhow. Left rows with a null among keys or time match nothing,
    such right rows are not matched. Every left row comes out once, repeated ones too.
    ``by`` names columns of both sides.

    Both sides go through one shuffle, a sort and one write. Rows equal in all columns
    share a piece, which only streams them.
    """
    keys = _key_names(by)
    left_type, right_type = left.schema, right.schema
    whole_left = F.struct(*(_named(name) for name in left.columns))
    whole_right = F.struct(*(_named(name) for name in right.columns))
    usable = _named(right_time).isNotNull()
    for name in by:
        usable &= _named(name).isNotNull()

    def entries(df: DataFrame, time: str, side: int, l: Column, r: Column) -> DataFrame:
        tie = F.xxhash64(*(F.to_json(F.struct(_named(name))) for name in df.columns))
        return df.select(
            *_key_columns(by), _named(time).alias("t"), F.lit(side).alias("side"), tie.alias("tie"),
            l.alias("l"), r.alias("r"),
        )

    rows = entries(right.where(usable), right_time, RIGHT, F.lit(None).cast(left_type), whole_right).union(
        entries(left, left_time, LEFT, whole_left, F.lit(None).cast(right_type))
    )
    time_order = F.col("t").desc_nulls_first() if forward else F.col("t").asc_nulls_first()
    pieces = _in_pieces(rows, [*keys, time_order, "side", "tie"])
    fields = [StructField(f.name, f.dataType) for f in rows.schema.fields if f.name in (*keys, "l", "r")]
    schema = StructType([*fields, StructField("piece", IntegerType()), StructField("border", IntegerType())])
    carried = pieces.mapInArrow(_carried(keys, pa.schema([(name, pa.null()) for name in schema.names])), schema)
    stored = _stored(carried, "asof")

    # The state at the start of a piece is the one that the last earlier piece with any left behind.
    borders = stored.where("border = 1")
    held = borders.where("r IS NOT NULL").select(F.col("piece").alias("source"), *(F.col(k).alias(f"b{k}") for k in keys), F.col("r").alias("earlier"))
    numbers = borders.agg(
        F.collect_list("piece").alias("pieces"), F.collect_list(F.when(F.col("r").isNotNull(), F.col("piece"))).alias("sources")
    )
    before = F.filter("sources", lambda source: source < F.col("at"))
    chained = (
        numbers.select(F.explode("pieces").alias("at"), "sources")
        .select("at", F.array_max(before).alias("source"))
        .join(held, "source")
    )
    same = F.col("piece") == F.col("at")
    for key in keys:
        same &= F.col(key) == F.col(f"b{key}")
    match = F.coalesce("r", "earlier")
    known = stored.where("border = 0").join(chained, same, "left").select("l", match.alias("r"))
    if max_gap is not None:
        apart = F.col("r").getField(right_time) - F.col("l").getField(left_time)
        near = (apart if forward else -apart) <= F.lit(max_gap)
        known = known.withColumn("r", F.when(near, F.col("r")))
    return known.select(*(F.col("l").getField(name).alias(name) for name in left.columns), F.col("r").alias(into))


def _micros(times: pa.Array) -> np.ndarray:
    return times.cast(pa.int64()).to_numpy()


def _gap(later, earlier) -> int:
    return (later - earlier) // timedelta(microseconds=1)


def _readings(readings: DataFrame, by: Sequence[str], time: str, value: str) -> DataFrame:
    """Readings in pieces as keys, ``t`` and ``v``; rows with a null among them left out."""
    rows = readings.select(*_key_columns(by), _named(time).alias("t"), _named(value).cast("double").alias("v"))
    keys = _key_names(by)
    return _in_pieces(rows.dropna(subset=[*keys, "t", "v"]), [*keys, "t", "v"])


def _keys_of(batch: pa.RecordBatch, keys: Sequence[str]) -> dict:
    return {key: batch.column(key)[0].as_py() for key in keys}


def _runs(keys: Sequence[str], below: float, max_gap: int, names: Sequence[str]):
    """Task of ``episodes``: runs of low readings in a piece, those at its borders marked."""

    def work(batches: Batches) -> Iterator[pa.RecordBatch]:
        last, open_run, schema, first = None, None, None, True
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            types = {key: batch.column(key).type for key in keys}
            types |= {"start_time": batch.column("t").type, "end_time": batch.column("t").type}
            types |= {"n_readings": pa.int64(), "least": pa.float64(), "piece": pa.int32(), "head": pa.bool_(), "tail": pa.bool_(), "border": pa.int32()}
            schema = pa.schema([(name, types[name]) for name in names])
            time, value = _micros(batch.column("t")), batch.column("v").to_numpy()
            low = value < below
            joined = np.zeros(size, dtype=bool)
            joined[1:] = low[:-1] & (np.diff(time) <= max_gap)
            if open_run is not None:
                joined[0] = time[0] - _micros(last.column("t"))[0] <= max_gap
            joined &= low & ~_starts_key(batch, last, keys)
            begins = np.flatnonzero(low & ~joined)
            if open_run is not None:
                if joined[0]:
                    stop = int(begins[0]) if len(begins) else size
                    stop = min(stop, int(np.argmin(low)) if not low.all() else size)
                    open_run["end_time"] = batch.column("t")[stop - 1].as_py()
                    open_run["n_readings"] += stop
                    open_run["least"] = min(open_run["least"], float(value[:stop].min()))
                    closed = stop < size
                else:
                    closed = True
                if closed:
                    yield pa.RecordBatch.from_pylist([open_run | {"border": int(open_run["head"])}], schema)
                    open_run = None
            if len(begins):
                # A run ends before the next begin or the next reading that is not low.
                high = np.append(np.flatnonzero(~low), size)
                stops = np.minimum(np.append(begins[1:], size), high[np.searchsorted(high, begins)])
                bounds = np.stack([begins, stops], axis=1).ravel()
                least = np.minimum.reduceat(np.append(value, np.inf), bounds)[::2]
                head = (begins == 0) & first
                arrays = {key: batch.column(key).take(pa.array(begins)) for key in keys}
                arrays |= {
                    "start_time": batch.column("t").take(pa.array(begins)),
                    "end_time": batch.column("t").take(pa.array(stops - 1)),
                    "n_readings": pa.array(stops - begins, pa.int64()),
                    "least": pa.array(least),
                    "piece": batch.column("piece").take(pa.array(begins)),
                    "head": pa.array(head),
                    "tail": pa.array(np.zeros(len(begins), dtype=bool)),
                    "border": pa.array(head.astype(np.int32)),
                }
                found = pa.RecordBatch.from_arrays([arrays[name] for name in names], schema=schema)
                if stops[-1] == size:
                    open_run = found.slice(len(begins) - 1).to_pylist()[0]
                    found = found.slice(0, len(begins) - 1)
                if found.num_rows:
                    yield found
            last, first = batch.slice(size - 1), False
        if open_run is not None:
            yield pa.RecordBatch.from_pylist([open_run | {"tail": True, "border": 1}], schema)
        if last is not None:
            # Says that the piece has readings, so that runs around it do not meet.
            yield pa.RecordBatch.from_pylist([{"piece": last.column("piece")[0].as_py(), "n_readings": 0, "border": 1}], schema)

    return work


def _met_runs(keys: Sequence[str], max_gap: int):
    """Runs at borders, joined where they meet; at most two runs a piece."""

    def work(batches: Batches) -> Iterator[pa.RecordBatch]:
        rows, schema = [], None
        for batch in batches:
            rows += batch.to_pylist()
            schema = batch.schema
        pieces: dict[int, list[dict]] = {}
        for row in sorted(rows, key=lambda row: row["piece"]):
            pieces.setdefault(row["piece"], []).extend([row] if row["n_readings"] else [])
        done, pending = [], None
        for runs in pieces.values():
            head = next((run for run in runs if run["head"]), None)
            tail = next((run for run in runs if run["tail"]), None)
            if pending and head and all(pending[k] == head[k] for k in keys) and _gap(head["start_time"], pending["end_time"]) <= max_gap:
                joined = {
                    "start_time": pending["start_time"],
                    "n_readings": pending["n_readings"] + head["n_readings"],
                    "least": min(pending["least"], head["least"]),
                }
                head.update(joined)
                pending = None
            if pending:
                done.append(pending)
            if head and head is not tail:
                done.append(head)
            pending = tail
        done += [pending] if pending else []
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return work


def episodes(
    readings: DataFrame,
    by: Sequence[str],
    time: str,
    value: str,
    below: float,
    least_duration: timedelta = timedelta(minutes=15),
    max_gap: timedelta = timedelta(minutes=30),
) -> DataFrame:
    """Episodes of low readings: the keys, ``start_time, end_time, n_readings, least``.

    An episode is a longest run of consecutive readings of one subject, all less than
    ``below`` and each at most ``max_gap`` after the one before. It lasts from its first
    to its last reading, ``least_duration`` or longer. Rows with a null key, time or value
    are no readings; NaN is never low.
    """
    keys, gap = _key_names(by), max_gap // timedelta(microseconds=1)
    pieces = _readings(readings, by, time, value)
    kept = {field.name: field.dataType for field in pieces.schema.fields}
    fields = {key: kept[key] for key in keys} | {"start_time": kept["t"], "end_time": kept["t"]}
    fields |= {"n_readings": LongType(), "least": DoubleType(), "piece": IntegerType(), "head": BooleanType(), "tail": BooleanType(), "border": IntegerType()}
    schema = StructType([StructField(name, kind) for name, kind in fields.items()])
    stored = _stored(pieces.mapInArrow(_runs(keys, below, gap, list(fields)), schema), "episodes")
    met = stored.where("border = 1").repartition(1).mapInArrow(_met_runs(keys, gap), schema)
    runs = stored.where("border = 0").union(met)
    long_enough = F.col("end_time") - F.col("start_time") >= F.lit(least_duration)
    return runs.where(long_enough).select(
        *(F.col(key).alias(name) for key, name in zip(keys, by)), "start_time", "end_time", "n_readings", "least"
    )


def _share_of(value: float) -> str:
    return "below" if value < LOW else "above" if value > HIGH else "inside"


def _weights(keys: Sequence[str], max_gap: int, names: Sequence[str]):
    """Task of ``time_weighted_range``: microseconds per key and share, and the piece's border readings."""

    def work(batches: Batches) -> Iterator[pa.RecordBatch]:
        last, schema = None, None
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            types = {key: batch.column(key).type for key in keys} | dict.fromkeys(SHARES, pa.int64())
            types |= {"t": batch.column("t").type, "v": pa.float64(), "piece": pa.int32(), "border": pa.int32()}
            schema = pa.schema([(name, types[name]) for name in names])

            def reading(row: pa.RecordBatch) -> pa.RecordBatch:
                return pa.RecordBatch.from_pylist([row.to_pylist()[0] | {"border": 1}], schema)

            if last is None:
                yield reading(batch.slice(0, 1))
            changed = _starts_key(batch, last, keys)
            first = batch.slice(0, 1) if last is None else last
            time = np.concatenate([_micros(first.column("t")), _micros(batch.column("t"))])
            value = np.concatenate([first.column("v").to_numpy(), batch.column("v").to_numpy()])[:-1]
            # The time up to a reading counts as the reading before it.
            weight = np.where(changed, 0, np.minimum(np.diff(time), max_gap))
            segments = np.flatnonzero(changed)
            segments = segments if len(segments) and segments[0] == 0 else np.append(0, segments)
            parts = {"below": value < LOW, "above": value > HIGH}
            parts["inside"] = ~(parts["below"] | parts["above"])
            arrays = {key: batch.column(key).take(pa.array(segments)) for key in keys}
            arrays |= {share: pa.array(np.add.reduceat(np.where(part, weight, 0), segments), pa.int64()) for share, part in parts.items()}
            arrays["piece"] = batch.column("piece").take(pa.array(segments))
            arrays["border"] = pa.array(np.zeros(len(segments), np.int32))
            yield pa.RecordBatch.from_arrays(
                [arrays.get(name, pa.nulls(len(segments), types[name])) for name in names], schema=schema
            )
            last = batch.slice(size - 1)
        if last is not None:
            yield pa.RecordBatch.from_pylist([last.to_pylist()[0] | {"border": 1}], schema)

    return work


def _met_weights(keys: Sequence[str], max_gap: int):
    """Times between the last reading of a piece and the first one of the next."""

    def work(batches: Batches) -> Iterator[pa.RecordBatch]:
        rows, schema = [], None
        for batch in batches:
            rows += batch.to_pylist()
            schema = batch.schema
        pieces: dict[int, list[dict]] = {}
        for row in sorted(rows, key=lambda row: row["piece"]):
            pieces.setdefault(row["piece"], []).append(row)
        bounds = [sorted(ends, key=lambda row: (*(row[k] for k in keys), row["t"], row["v"])) for ends in pieces.values()]
        between = []
        for earlier, later in zip(bounds, bounds[1:]):
            a, b = earlier[-1], later[0]
            if all(a[key] == b[key] for key in keys):
                weight = min(_gap(b["t"], a["t"]), max_gap)
                between.append({key: a[key] for key in keys} | dict.fromkeys(SHARES, 0) | {_share_of(a["v"]): weight})
        if between:
            yield pa.RecordBatch.from_pylist(between, schema)

    return work


def time_weighted_range(
    readings: DataFrame,
    by: Sequence[str],
    time: str,
    value: str,
    max_gap: timedelta = timedelta(minutes=30),
) -> DataFrame:
    """Share of time below 70, from 70 to 180 and above, per group of ``by``.

    A reading counts until the next one of its group, at most ``max_gap``; the last one
    counts nothing. Returns the keys, ``seconds`` and ``pct_time_below, pct_time_in_range,
    pct_time_above``, null where no time passed. Rows with a null key, time or value are
    no readings; of readings at one time the greatest counts.
    """
    keys, gap = _key_names(by), max_gap // timedelta(microseconds=1)
    pieces = _readings(readings, by, time, value)
    kept = {field.name: field.dataType for field in pieces.schema.fields}
    fields: Mapping = {key: kept[key] for key in keys} | dict.fromkeys(SHARES, LongType())
    fields = {**fields, "t": kept["t"], "v": DoubleType(), "piece": IntegerType(), "border": IntegerType()}
    schema = StructType([StructField(name, kind) for name, kind in fields.items()])
    stored = _stored(pieces.mapInArrow(_weights(keys, gap, list(fields)), schema), "weights")
    met = stored.where("border = 1").repartition(1).mapInArrow(_met_weights(keys, gap), schema)
    totals = stored.where("border = 0").union(met).groupBy(*keys).agg(*(F.sum(share).alias(share) for share in SHARES))
    all_time = F.col("below") + F.col("inside") + F.col("above")

    def percent(share: str) -> Column:
        return F.when(all_time > 0, F.lit(100.0) * F.col(share) / all_time)

    return totals.select(
        *(F.col(key).alias(name) for key, name in zip(keys, by)),
        (all_time / F.lit(1e6)).alias("seconds"),
        percent("below").alias("pct_time_below"),
        percent("inside").alias("pct_time_in_range"),
        percent("above").alias("pct_time_above"),
    )
