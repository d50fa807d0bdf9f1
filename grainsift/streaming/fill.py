"""Forward fill on a stream, per key.

A *global* forward fill is impossible on a stream, one per key is not: the state of a key is
its last value and the time up to which it has been filled, and it expires when the key has
been silent for long. This is the one operator of the library's core that runs in Python
workers: the state needs a function of its own (batches go through Arrow).

A call of that function costs milliseconds however few rows it gets, so it is called for parts
of the keys, not for every key: the state of a part holds its keys with their values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.hashing import distinct_text
from ..functions.schema import col, require, type_of
from .streams import event_time

PARTS = 512  # calls in a micro-batch, at most


def _key_text(df: DataFrame, keys: Sequence[str]) -> Column:
    """Text that is equal exactly when the cells of the keys are (NULL equals NULL)."""
    cells = [F.hex(col(k)) if isinstance(type_of(df, k), T.BinaryType) else distinct_text(col(k), type_of(df, k)) for k in keys]
    return F.to_json(F.array(*cells))


def fill_forward_stream(
    stream: DataFrame, column: str, keys: Sequence[str], time_column: str, order_by: Sequence[str] = (), *,
    delay: str = "1 hour", expire_seconds: int = 30 * 86400, late: str = "late",
    parts: int = PARTS,
) -> DataFrame:
    """The rows with missing cells (NaN included) filled by the last value above of their key.

    Rows of a key follow by time and then by ``order_by``, within a micro-batch and from batch
    to batch. A row that is older than what has been filled for its key is late: it is passed
    on unfilled, with True in the column ``late``, and changes nothing. Rows older than the
    watermark are dropped. The value of a key that has been silent for ``expire_seconds`` of
    event time is forgotten.

    Keys are dealt into ``parts`` by a hash. A task holds the rows that one part has in one
    micro-batch, which the trigger's limits bound, and a value for each of its live keys.
    ``parts`` must not change while a checkpoint is in use.
    """
    require(stream, column, time_column, *keys, *order_by)
    if late in stream.columns:
        raise ValueError(f"there is a column {late!r} already")
    timed = event_time(stream, time_column)
    names, value_type = timed.columns, type_of(timed, column)
    order = [time_column, *order_by]
    instant = "__instant"  # microseconds, so that no time zone takes part inside the workers
    rows = timed.withWatermark(time_column, delay).withColumn(instant, F.unix_micros(col(time_column)))
    # times leave the workers as the number they came in as
    key = _key_text(timed, keys)
    plain = rows.select(
        *[F.col(instant).alias(n) if n == time_column else col(n) for n in names], col(time_column).alias("__mark"),
        key.alias("__key"), F.pmod(F.xxhash64(key), F.lit(parts)).alias("__part"))
    own = {"__mark", "__key", "__part"}
    schema = T.StructType([*[f for f in plain.schema.fields if f.name not in own], T.StructField(late, T.BooleanType())])
    state_type = T.StructType([
        T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("values", T.ArrayType(value_type)),
        T.StructField("untils", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType()))])

    def fill(part: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        held, present = {}, set()  # key: (value, filled until, silent until)
        if state.exists:
            ids, values, untils, ends = state.get
            held = dict(zip(ids, zip(values, untils, ends)))
        watermark = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            frame = pd.concat(list(frames), ignore_index=True)
            frame = frame.sort_values(["__key", *order], kind="stable", na_position="first", ignore_index=True)
            present = set(frame["__key"])
            old = frame[time_column].isna()
            if held:
                old = old | (frame[time_column] < frame["__key"].map({k: h[1] for k, h in held.items()}))
            fresh = frame.loc[~old, ["__key", time_column, column]]
            filled = fresh.groupby("__key", sort=False)[column].ffill()
            known = {k: h[0] for k, h in held.items() if k in present and h[0] is not None}
            if known:
                filled = filled.where(filled.notna(), fresh["__key"].map(known))
            frame.loc[~old, column] = filled
            ends_of_keys = ~fresh["__key"].duplicated(keep="last")
            last = filled[ends_of_keys]
            for k, until, value in zip(fresh.loc[ends_of_keys, "__key"], fresh.loc[ends_of_keys, time_column], last):
                plain_value = None if pd.isna(value) else value.item() if hasattr(value, "item") else value
                held[k] = (plain_value, int(until), 0)
            for k in present & held.keys():
                value, until, _ = held[k]
                held[k] = (value, until, max(until // 1000 + expire_seconds * 1000, watermark + 1))
            frame[late] = old
            yield frame[[*names, late]]
        held = {k: h for k, h in held.items() if k in present or h[2] >= watermark}
        if held:
            values, untils, ends = zip(*held.values())
            state.update((list(held), list(values), list(untils), list(ends)))
            state.setTimeoutTimestamp(max(min(ends), watermark + 1))
        elif state.exists:
            state.remove()

    out = plain.groupBy("__part").applyInPandasWithState(fill, schema, state_type, "append", "EventTimeTimeout")
    return out.withColumn(time_column, F.timestamp_micros(col(time_column)))
