"""Exact ordered folds per key: rules where each row depends on the row before.

Rounding or rejection at every step makes such a fold impossible to express as a
window sum. Rows are sorted inside Spark partitions and streamed through a small
step function, so no group is ever held in memory.

A key too big for one task is cut into contiguous ranges that are folded side by
side from estimated start states. The estimates are then checked against the end
state of the preceding range, and only ranges whose start was wrong are folded
again, until every start equals the end before it. The result is exactly that of
one sequential pass.
"""

from __future__ import annotations

import ast
from bisect import bisect_right
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import PART, is_hot, range_split

State = tuple
Step = Callable[[State, tuple], tuple[State, tuple]]
# (state, offsets, row) -> (offsets after the row, slope): states of one number that lie
# ``offsets`` from ``state`` before the row, relative to the new state after it.
Near = Callable[[State, np.ndarray, tuple], tuple[np.ndarray, float]]

# Kinds of result columns.
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}

# States to either side of an estimated start whose ends are computed with it.
BAND = 2048


def _rows(batches, columns):
    for pdf in batches:
        yield from zip(*(pdf[c].tolist() for c in columns))


def _values(column: pa.Array) -> list:
    return column.to_pylist() if column.null_count or not pa.types.is_integer(column.type) else column.to_numpy().tolist()


def _emit(keys, inputs, init, carried, step, outputs, starts, last_only=False):
    """Rows with their results; keys and carried columns pass as they came, never as Python values.

    ``last_only`` leaves out rows that the next row of the batch follows in its key.
    """
    kept, names = [*keys, *carried], [*keys, *carried, *[n for n, _ in outputs]]
    kinds = [_ARROW[t] for _, t in outputs]

    def run(batches):
        current, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            out, ends = [], []
            columns = lambda some: zip(*[_values(batch.column(c)) for c in some])
            # a null whole number is no key: each such row is folded by itself
            whole = [i for i, c in enumerate(keys) if batch.column(c).null_count and pa.types.is_integer(batch.column(c).type)]
            for at, (key, row, begin) in enumerate(zip(columns(keys), columns(inputs), columns(init))):
                if key != current or (whole and any(key[i] is None for i in whole)):
                    if last_only and at:
                        ends.append(at - 1)
                    current, state = key, begin
                    if starts is not None and (key[0], key[1:]) in starts:
                        state = starts[(key[0], key[1:])]
                state, result = step(state, row)
                out.append(result)
            passed = [batch.column(c) for c in kept]
            if last_only:
                ends.append(len(out) - 1)
                out, passed = [out[i] for i in ends], [c.take(pa.array(ends)) for c in passed]
            found = [pa.array(values, kind) for values, kind in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([*passed, *found], names=names)

    return run


class _Band:
    """Ends of the states up to ``width`` from a start, as a step function of the offset."""

    def __init__(self, width: int):
        self.starts = np.arange(-width, width + 1)
        self.offsets = self.starts.copy()
        self.slope, self.rows = 1.0, 0

    def pass_row(self, near: Near, state: State, row: tuple) -> None:
        if self.slope == 0.0 and len(self.offsets) == 1:
            return
        self.offsets, slope = near(state, self.offsets, row)
        self.slope *= slope
        self.rows += 1
        if self.rows % 64 == 0:
            self.merge()

    def merge(self) -> None:
        """Starts next to each other that have met go on as one."""
        first = np.r_[True, self.offsets[1:] != self.offsets[:-1]]
        self.starts, self.offsets = self.starts[first], self.offsets[first]

    def text(self) -> str:
        self.merge()
        return repr((self.starts.tolist(), self.offsets.tolist(), self.slope))


def _ends(keys, inputs, init, step, starts, near, width):
    """One row per range: first and last key, start used, end of the last key and, for a
    range of one key, the ends of the starts nearby."""
    n_keys, n_in = len(keys), len(inputs)
    columns = [*keys, *inputs, *init]

    def run(batches):
        firsts, lasts, bands, current = {}, {}, {}, None
        state = begin = band = None
        for row in _rows(batches, columns):
            key = row[:n_keys]
            part, rest = key[0], key[1:]
            if key != current:
                current = key
                begin = state = starts.get((part, rest), row[n_keys + n_in:])
                band = None
                if near is not None and part not in firsts:
                    band = bands[part] = _Band(width)
                firsts.setdefault(part, rest)
            given = row[n_keys:n_keys + n_in]
            if band is not None:
                band.pass_row(near, state, given)
            state, _ = step(state, given)
            lasts[part] = (rest, begin, state)
        yield pd.DataFrame(
            [(p, repr(firsts[p]), *map(repr, lasts[p]), bands[p].text() if p in bands and firsts[p] == lasts[p][0] else "None") for p in lasts],
            columns=["part", "first", "last", "begin", "finish", "band"])

    return run


def _end_for(want: State, begin: State, finish: State, band, additive) -> tuple[State, bool]:
    """End of a range of one key for the start ``want``, and whether it is sure."""
    if want == begin:
        return finish, True
    if band is None:
        return tuple(w + f - b if add else f for w, f, b, add in zip(want, finish, begin, additive)), False
    starts, offsets, slope = band
    off, width = want[0] - begin[0], -starts[0]
    if abs(off) <= width:
        return (finish[0] + offsets[bisect_right(starts, off) - 1],), True
    return (finish[0] + round(slope * off),), False


def settled_starts(arranged, keys, inputs, init, step, additive, near=None) -> tuple[dict, int]:
    """Exact start of every range that begins inside a key, and the rounds it took.

    ``arranged(parts)`` gives the sorted rows of some ranges (None: of all).
    """
    starts: dict = {}
    ends: dict[int, tuple] = {}
    todo, rounds = None, 0
    while todo is None or todo:
        width = BAND if near is not None and rounds else 0
        found = arranged(todo).mapInPandas(
            _ends(keys, inputs, init, step, starts, near, width),
            "part int, first string, last string, begin string, finish string, band string").collect()
        rounds += 1
        for r in found:
            ends[r.part] = tuple(map(ast.literal_eval, (r.first, r.last, r.begin, r.finish, r.band)))
        todo, before = [], None
        for part in sorted(ends):
            first, last, begin, finish, band = ends[part]
            end = finish
            if before is not None and before[0] == first:
                starts[part, first] = want = before[1]
                if first == last:  # else the end belongs to another key and does not hang on this start
                    end, sure = _end_for(want, begin, finish, band, additive)
                    if not sure:
                        todo.append(part)
            before = (last, end)
    return starts, rounds


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    inputs: Sequence[str],
    init: Sequence[str],
    step: Step,
    outputs: Sequence[tuple[str, str]],
    carried: Sequence[str] = (),
    additive: Sequence[bool] | None = None,
    hot: bool | None = None,
    near: Near | None = None,
    last_only: bool = False,
) -> DataFrame:
    """Fold rows of each key in ``order``.

    ``inputs`` feed ``step(state, inputs) -> (state, outputs)``; ``init`` columns
    hold the key's starting state (repeated on its rows). Inputs and state are
    whole numbers without nulls, keys are whole numbers or text. ``outputs`` are (name, type); ``carried`` columns pass through.
    ``additive`` marks state parts that mostly shift by a fixed amount per range,
    which makes the first estimates good; ``near`` (for a state of one number) says how
    states close by fare. Pass ``hot`` where it is already known. ``last_only`` is for those who
    take the last row of a key: most rows before it do not come out.
    """
    types = dict(df.dtypes)
    schema = ", ".join(
        [f"`{c}` {types[c]}" for c in (*keys, *carried)] + [f"`{n}` {t}" for n, t in outputs])
    columns = list(dict.fromkeys([*keys, *inputs, *init, *carried]))
    if not (is_hot(df, keys) if hot is None else hot):
        sorted_rows = df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*columns)
        return sorted_rows.mapInArrow(_emit(keys, inputs, init, carried, step, outputs, None, last_only), schema)

    split = range_split(df, keys, order)
    part_keys = [PART, *keys]

    def arranged(parts=None):
        rows = split if parts is None else split.filter(F.col(PART).isin(parts))
        return rows.repartition(PART).sortWithinPartitions(*part_keys, *order).select(PART, *columns)

    starts, _ = settled_starts(arranged, part_keys, inputs, init, step, additive or [False] * len(init), near)
    wide = ", ".join([f"`{PART}` int", schema])
    out = arranged().mapInArrow(_emit(part_keys, inputs, init, carried, step, outputs, starts, last_only), wide)
    return out.drop(PART)
