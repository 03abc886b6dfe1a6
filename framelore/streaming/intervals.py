"""The interval map as keyed state of a stream.

Each entity keeps its disjoint intervals in order in the state store; every
arriving interval finds its overlaps by binary search and merges them.  After
each micro-batch the periods and gaps of the touched entities are emitted
(update mode).  An entity's state holds its periods, not its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framelore.operators.intervals import IntervalMap

STATE = "starts array<bigint>, ends array<bigint>"
OUT = "entity string, kind string, start_at bigint, end_at bigint"


def _update(touch: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, ends = state.get if state.exists else ([], [])
        held = IntervalMap(touch, list(starts), list(ends))
        for batch in batches:
            for s, e in zip(batch["start_at"].tolist(), batch["end_at"].tolist()):
                held.insert(int(s), int(e))
        state.update((held.starts, held.ends))
        rows = [(key[0], "period", s, e) for s, e in held.periods()] + [(key[0], "gap", s, e) for s, e in held.gaps()]
        yield pd.DataFrame(rows, columns=["entity", "kind", "start_at", "end_at"])

    return run


def stream_intervals(rows: DataFrame, touch: int) -> DataFrame:
    """Periods and gaps of the entities that each micro-batch touched; rows as in ``merge_intervals``.

    Late rows need no watermark: an interval that arrives late is inserted in
    its place.  Rows without entity, with a null or negative bound or an end
    before the start are left out.
    """
    good = rows.select("entity", "start_at", "end_at").where("entity is not null and start_at >= 0 and end_at >= start_at")
    return good.groupBy("entity").applyInPandasWithState(_update(touch), OUT, STATE, "update", GroupStateTimeout.NoTimeout)
