"""The watcher of guides as a stream: what is remembered of a feed is keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Ticks that are Python objects at once.
CHUNK = 10_000
STATE = "at long, tick long, digest string, changed_s long, draws map<string, long>"


def remembered(ticks: DataFrame) -> DataFrame:
    """A stream of ticks with changed, changed_s and first_s, as `operators.watch.remembered` gives them for a table.

    Ticks of a batch are taken in order; one that is not after the last one of its feed was seen before, or comes too late, and gives no row. So a source that is read again changes nothing.
    A feed's ticks of a batch are held as Arrow columns, their strings as numbers of a dictionary; CHUNK of them at a time are Python objects.
    """
    columns = ticks.columns
    kind = T.StructType([*ticks.schema.fields, T.StructField("changed", T.BooleanType()), T.StructField("changed_s", T.LongType()), T.StructField("first_s", T.LongType())])

    arrow = to_arrow_schema(ticks.schema)

    def compact(tables: Iterator[pd.DataFrame]) -> pa.Table:
        parts = []
        for table in tables:
            part = pa.Table.from_pandas(table, schema=arrow, preserve_index=False)
            parts.append(pa.table([c.dictionary_encode() if pa.types.is_string(c.type) else c for c in part.columns], names=part.column_names))
        return pa.concat_tables(parts).unify_dictionaries()

    def update(key: tuple, tables: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, tick, digest, changed_s, draws = state.get if state.exists else (-1, -1, None, None, {})
        draws, table = dict(draws), compact(tables)
        order = table.select(["seen_s", "tick_id"]).to_pandas().sort_values(["seen_s", "tick_id"]).index.to_numpy()
        for start in range(0, len(order), CHUNK):
            out = []
            for row in table.take(order[start : start + CHUNK]).to_pylist():
                if (row["seen_s"], row["tick_id"]) <= (at, tick):
                    continue
                at, tick = row["seen_s"], row["tick_id"]
                changed = row["digest"] is not None and row["digest"] != digest
                if row["digest"] is not None:
                    digest = row["digest"]
                    draws.setdefault(str(row["draw_code"]), at)
                changed_s = at if changed else changed_s
                out.append((*(row[c] for c in columns), changed, changed_s, draws.get(str(row["draw_code"]))))
            if out:
                yield pd.DataFrame(out, columns=kind.names).astype(object)
        state.update((at, tick, digest, changed_s, draws))

    return ticks.groupBy("feed").applyInPandasWithState(update, kind, STATE, "append", "NoTimeout")
