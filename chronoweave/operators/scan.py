"""Finite state machines over ordered rows, in parallel: what a stretch of rows does to every state is a table, and tables compose.

Rows are cut by range over (key, order) into parts of a bounded size, so that one key may hold any share of them. Each
part says for each of its keys which state every state would become; those few rows are composed along a key, and
each part then runs its rows from the state that is now known. Nothing holds all rows of a key.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.session import written


@dataclass(frozen=True)
class Machine:
    """`moves[symbol][state]` is the next state; symbols and states are numbers from 0 on, `start` the state before the first row."""

    moves: tuple[tuple[int, ...], ...]
    start: int = 0

    def run(self, symbols: list[int], state: int) -> list[int]:
        """The state after each row."""
        after = []
        for s in symbols:
            state = self.moves[s][state]
            after.append(state)
        return after


def scanned(rows: DataFrame, machine: Machine, symbol: Column, keys: list[str], order: list[str]) -> DataFrame:
    """keys, order, symbol, before and after of each row: the states around it. `order` must tell the rows of a key apart, else those that tie are in any order.

    Rows with a null symbol change nothing and come back with the state they met. Null keys are a key of their own.
    """
    names = [*keys, *order]
    slim = rows.select(*names, symbol.cast("int").alias("symbol"))
    cut = slim.repartitionByRange(*names).withColumn("part", F.spark_partition_id())
    cut = written(cut, "scan")
    kind = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    fields = ", ".join(f"{n} {kind[n]}" for n in keys)

    def stretches(table: pa.Table) -> list[tuple[pa.Table, int, int]]:
        """The rows of a part in order, with the first row of each key and the row behind its last."""
        table = table.sort_by([(n, "ascending") for n in names]).combine_chunks()
        new = np.zeros(len(table), bool)
        new[:1] = True
        for n in keys:
            code = table[n].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        edge = np.append(np.flatnonzero(new), len(table)).tolist()
        return table, list(zip(edge[:-1], edge[1:], strict=True))

    def symbols(table: pa.Table, a: int, b: int) -> list:
        return [s for s in table["symbol"].slice(a, b - a).to_pylist() if s is not None]

    def summary(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        table, found = stretches(table)
        ends = []
        for a, b in found:
            here, states = symbols(table, a, b), range(len(machine.moves[0]))
            ends.append([machine.run(here, s)[-1] if here else s for s in states])
        first = table.take(pa.array([a for a, _ in found], pa.int64()))
        return pa.table({**{n: first[n] for n in keys}, "part": pa.array([part] * len(found), pa.int32()), "ends": pa.array(ends, pa.list_(pa.int32()))})

    def composed(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        state, starts = machine.start, []
        for ends in table["ends"].to_pylist():
            starts.append(state)
            state = ends[state]
        return table.select([*keys, "part"]).append_column("state", pa.array(starts, pa.int32()))

    def run(table: pa.Table, starts: pa.Table) -> pa.Table:
        table, found = stretches(table)
        known = {tuple(r[n] for n in keys): r["state"] for r in starts.to_pylist()}
        before, after = [], []
        for a, b in found:
            state = known[tuple(table[n][a].as_py() for n in keys)]
            for s in table["symbol"].slice(a, b - a).to_pylist():
                before.append(state)
                state = state if s is None else machine.moves[s][state]
                after.append(state)
        return table.select([*names, "symbol"]).append_column("before", pa.array(before, pa.int32())).append_column("after", pa.array(after, pa.int32()))

    ends = cut.groupBy("part").applyInArrow(summary, f"{fields}, part int, ends array<int>")
    starts = written(ends.groupBy(*keys).applyInArrow(composed, f"{fields}, part int, state int"), "scan-starts")
    out = ", ".join(f"{n} {kind[n]}" for n in [*names, "symbol"])
    return cut.groupBy("part").cogroup(starts.groupBy("part")).applyInArrow(run, f"{out}, before int, after int")


# ---- the machines of the protocols

ACTIONS = ("wiring", "measurement", "writing", "cleanup", "terminal")


def protocol(moves: dict, last_phase: int) -> Machine:
    """The machine of a table action -> phase -> (stage, next phase); states are the phases and, behind them, that of a reached end.

    Symbols are those of ACTIONS, `terminal` being the cleanup that ends the sequence; a cleanup that doesn't changes nothing.
    """
    phases, over = range(last_phase + 1), last_phase + 1
    table = [tuple(moves.get(a, {}).get(p, (None, p))[1] for p in phases) + (over,) for a in ACTIONS[:-1]]
    return Machine((*table, (over,) * (last_phase + 2)))


def protocol_symbol(terminal: Column) -> Column:
    """The symbol of a row by its action, `terminal` telling whether it is the cleanup that ends the sequence; null for other actions."""
    known = F.create_map(*(x for i, a in enumerate(ACTIONS[:-1]) for x in (F.lit(a), F.lit(i))))
    return F.when(F.coalesce(terminal, F.lit(False)), F.lit(len(ACTIONS) - 1)).otherwise(F.try_element_at(known, F.col("action")))


def protocol_stage(moves: dict, last_phase: int, symbol: Column, before: Column) -> Column:
    """The stage of a row by its symbol and the state before it: noise behind the end, null without a move."""
    known = [(i, p, stage) for i, a in enumerate(ACTIONS[:-1]) for p, (stage, _) in moves.get(a, {}).items()]
    out = F.when(before > last_phase, F.lit("noise")).when(symbol == len(ACTIONS) - 1, F.lit("material_cleanup"))
    for i, p, stage in known:
        out = out.when((symbol == i) & (before == p), F.lit(stage))
    return out


def persistence(persist: int) -> Machine:
    """Two sides, left for the other after `persist` rows in a row beyond its threshold; the first row only picks the side.

    Symbols add up 1 (at or below the lower threshold), 2 (at or above the upper one) and 4 (at or above the middle).
    States are side * persist + rows in a row so far, side 0 the lower one, and behind them the start.
    """
    start = 2 * persist

    def move(symbol: int, state: int) -> int:
        if state == start:
            return symbol // 4 * persist
        side, streak = divmod(state, persist)
        streak = streak + 1 if symbol & (2 >> side) else 0  # side 0 is left upwards, side 1 downwards
        return (1 - side) * persist if streak >= persist else side * persist + streak

    return Machine(tuple(tuple(move(s, x) for x in range(start + 1)) for s in range(8)), start)


def persistence_symbol(value: Column, down: Column, up: Column) -> Column:
    return (value <= down).cast("int") + (value >= up).cast("int") * 2 + (value >= (down + up) / 2).cast("int") * 4
