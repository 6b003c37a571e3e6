"""Finite state machines over ordered rows per key, cut like any ordered scan.

The state after a row depends on the state before it, so neither sums nor last values can carry it. But a row is a map
from states to states, and maps compose: the pieces of a hot key are first folded into one map each, the maps before a
piece give the state it begins with, and then every piece is scanned on its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StructField, StructType

from docweave.operators.ordering import TARGET_ROWS, cut_pieces

Step = Callable[[int, int], tuple[int, tuple[int, ...]]]


def _grouped(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows of a group in order within one partition; ``_first`` marks where a group begins."""
    return df.withColumn("_first", F.row_number().over(W.partitionBy(*group).orderBy(*order)) == 1)


def _maps(step: Step, states: int):
    """One row per group: its last row with the map of its codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        current, last = None, None
        for batch in batches:
            firsts, codes = batch["_first"].to_pylist(), batch["_code"].to_pylist()
            for at, (first, code) in enumerate(zip(firsts, codes)):
                if first:
                    if last is not None:
                        yield last.append_column("_map", pa.array([current.tolist()], pa.list_(pa.int32())))
                    current = np.arange(states)
                if code not in tables:
                    tables[code] = np.array([step(code, s)[0] for s in range(states)])
                current, last = tables[code][current], batch.slice(at, 1)
        if last is not None:
            yield last.append_column("_map", pa.array([current.tolist()], pa.list_(pa.int32())))

    return run


def _entries(start: int):
    """The state in which each piece of a key begins, from the maps of the pieces before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start
        for batch in batches:
            entered = []
            for first, piece in zip(batch["_first"].to_pylist(), batch["_map"].to_pylist()):
                state = start if first else state
                entered.append(state)
                state = piece[state]
            yield batch.append_column("_entry", pa.array(entered, pa.int32()))

    return run


def _states(step: Step, start: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, known = start, {}
        for batch in batches:
            out = []
            for first, entry, code in zip(batch["_first"].to_pylist(), batch["_entry"].to_pylist(), batch["_code"].to_pylist()):
                state = start if first else state
                if entry is not None:  # the row in front of a piece
                    state = entry
                    out.append((state, *[None] * len(names)))
                    continue
                move = known.get((code, state))
                if move is None:
                    move = known[code, state] = step(code, state)
                out.append((state, *move[1]))
                state = move[0]
            for name, values in zip(["_state", *names], zip(*out) if out else [[]] * (len(names) + 1)):
                batch = batch.append_column(name, pa.array(values, pa.int32()))
            yield batch

    return run


def _wider(df: DataFrame, *names: str, kind: DataType = IntegerType()) -> StructType:
    return StructType([*df.schema.fields, *[StructField(n, kind) for n in names]])


def scan_transitions(cut: DataFrame, keys: list[str], order: list[str], code: Column, step: Step, states: int, start: int, emitted: list[str]) -> DataFrame:
    """``_state`` before each row and the whole numbers ``emitted`` for it, over rows of ``cut_pieces``.

    ``step(code, state)`` gives the next state and the emitted numbers; ``code`` is a bigint, states are 0 ... ``states`` - 1.
    All columns pass through Python as Arrow batches, so wide texts are better joined afterwards.
    """
    rows = cut.withColumn("_code", code.cast("bigint"))
    group = [*keys, "_piece"]
    pieces = _grouped(rows.filter("_hot").select(*group, "_code", *[c for c in order if c not in keys]), group, order).select(*group, "_code", "_first")
    maps = pieces.mapInArrow(_maps(step, states), _wider(pieces, "_map", kind=ArrayType(IntegerType()))).drop("_first", "_code")
    maps = _grouped(maps, keys, ["_piece"])
    entries = maps.mapInArrow(_entries(start), _wider(maps, "_entry")).filter("_piece > 0").select(*group, "_entry", F.lit(0).alias("_own"))
    both = rows.withColumns({"_own": F.lit(1), "_entry": F.lit(None).cast("int")}).unionByName(entries, allowMissingColumns=True)
    both = _grouped(both, group, ["_own", *order])
    return both.mapInArrow(_states(step, start, emitted), _wider(both, "_state", *emitted)).filter("_own = 1").select(*cut.columns, "_state", *emitted)


def transition_scan(df: DataFrame, keys: list[str], order: list[str], code: Column, step: Step, states: int, start: int, emitted: list[str],
                    target_rows: int = TARGET_ROWS) -> DataFrame:
    """``scan_transitions`` over a whole table; keys of more than ``target_rows`` rows are cut."""
    return scan_transitions(cut_pieces(df, keys, order, target_rows), keys, order, code, step, states, start, emitted).drop("_piece", "_hot")
