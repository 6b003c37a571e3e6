"""A stateful fold per key that takes rows in the order of their event time, and forgets a key when it has expired.

A call of a stateful Python function costs some milliseconds, whatever it is given. Spark's groups are therefore buckets
of keys: a batch makes at most ``BUCKETS`` calls, however many keys it has, and the keys of a bucket share a timer.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "keys binary"
BUCKETS = 4096


def _folded(fold: Callable, new: list, expires: Callable, out_columns: list[str]):
    def run(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = json.loads(zlib.decompress(state.get[0])) if state.exists else []
        places = {key: (current, rows) for key, current, rows in known}
        if not state.hasTimedOut:
            for batch in batches:
                for row in json.loads(f"[{','.join(batch['row'])}]"):
                    places.setdefault(row.pop("key"), (new, []))[1].append(row)
        watermark = state.getCurrentWatermarkMs()
        out, kept, due = [], [], []
        for key, (current, rows) in places.items():
            rows.sort(key=lambda r: (r["at"], r["turn"] is not None, r["turn"] or 0))
            done = 0
            while done < len(rows) and rows[done]["at"] // 1000 < watermark:
                current, told = fold(current, rows[done])
                out.append((key, *told))
                done += 1
            rows, ends = rows[done:], expires(current)
            if rows or (ends is not None and ends // 1000 >= watermark):
                kept.append((key, current, rows))
                due += [x // 1000 for x in (ends, rows[0]["at"] if rows else None) if x is not None]
        if kept:
            state.update((zlib.compress(json.dumps(kept).encode(), 1),))
            state.setTimeoutTimestamp(max(min(due), watermark + 1))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(dict(zip(out_columns, zip(*out))), dtype=object)  # whole numbers stay whole beside nulls

    return run


def fold_in_event_order(rows: DataFrame, late: str, fold: Callable, new: list, expires: Callable, told: str, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of ``rows`` that the watermark has passed.

    ``rows``: key (string), ts, turn (orders equal times, null first) and columns of text, whole numbers or booleans.
    ``fold(state, row)`` gives the next state (a list that JSON can hold, never changed in place) and the values of
    ``told``, a schema without the key; the row has its time in microseconds as ``at``. ``expires(state)`` is the time
    from which the state is worth nothing. Rows later than the watermark are dropped; newer ones than it wait in the
    key's state, and a timer asks for them. A row without a time, which no watermark passes, is left out.

    A batch rewrites the buckets it has rows or due timers for. ``buckets`` must stay the same for a checkpoint: take
    more of them where a bucket's live keys would be many thousands.
    """
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).filter("ts is not null").withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    columns = [c for c in timed.columns if c not in ("key", "ts")]
    packed = F.to_json(F.struct("key", *columns), {"ignoreNullFields": "false"})
    schema = f"key string, {told}"
    run = _folded(fold, new, expires, [c.split()[0] for c in schema.split(", ")])
    bucketed = timed.select("ts", F.pmod(F.hash("key"), F.lit(buckets)).alias("bucket"), packed.alias("row"))
    return bucketed.groupBy("bucket").applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
