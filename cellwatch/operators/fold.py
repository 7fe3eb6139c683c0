"""Keyed ordered fold: run levels of scans over every order, in row order.

A *level* is a ``prepare`` function (vectorized columns from columns) and the
scans that may use its results.  Scans of one level need only columns of
earlier levels, which fixes how many passes a cut order takes: per level one
pass that summarizes each segment, then one pass that runs all of them.

Orders that fit a task take a single pass after a single exchange.  In it the orders of an Arrow
batch run side by side, a row of each at a time (``lanes.py``).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import settle
from .lanes import Lanes
from .scans import Scan
from .segments import MOST_BROADCAST_ROWS, SEGMENT, listed, split_long, task_of_segment

ENTRY = "entry_state"
STATE = "state"
ERROR = "error"
SOUND = "sound"


@dataclass(frozen=True)
class Level:
    prepare: Callable[[dict], dict] | None
    scans: tuple[Scan, ...]


@dataclass(frozen=True)
class Program:
    """Levels, a last vectorized step, and the columns it all results in.

    ``inputs`` are the row columns the levels read, ``text_inputs`` those of
    them that hold text.  ``outputs`` maps result columns to their types.
    """

    levels: tuple[Level, ...]
    inputs: tuple[str, ...]
    outputs: dict[str, T.DataType]
    finish: Callable[[dict], dict] | None = None
    text_inputs: tuple[str, ...] = ()

    def initial(self) -> dict:
        return {s.name: s.initial() for level in self.levels for s in level.scans}

    def run(self, cols: dict, states: dict, depth: int | None = None) -> dict:
        """Run the first ``depth`` levels, updating ``states`` in place."""
        for level in self.levels[:depth]:
            if level.prepare:
                cols = {**cols, **level.prepare(cols)}
            for scan in level.scans:
                out, states[scan.name] = scan.run(cols, states[scan.name])
                cols = {**cols, **out}
        if depth is None and self.finish:
            cols = {**cols, **self.finish(cols)}
        return cols

    def run_lanes(self, cols: dict, lengths: list[int], states: list[dict]) -> dict:
        """``run`` of many orders whose rows follow each other, with the very same results.

        ``lengths`` are the orders' rows, ``states`` the state each is entered with and, in the end, left with.
        """
        lanes = Lanes(np.array(lengths))
        for level in self.levels:
            if level.prepare:
                cols = {**cols, **level.prepare(cols)}
            for scan in level.scans:
                out, after = scan.run_lanes(cols, lanes, [s[scan.name] for s in states])
                for state, value in zip(states, after):
                    state[scan.name] = value
                cols = {**cols, **out}
        if self.finish:
            cols = {**cols, **self.finish(cols)}
        return cols

    def columns(self, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        """The inputs of one Arrow batch as numpy columns, null numbers as NaN."""
        cols = {}
        for name in self.inputs:
            values = batch.column(name).to_numpy(zero_copy_only=False)
            cols[name] = values if name in self.text_inputs else np.asarray(values, dtype=float)
        return cols


def _pieces(batch: pa.RecordBatch, key: str) -> list[tuple[int, int]]:
    """Row ranges of one order and segment each."""
    edges = {0, batch.num_rows}
    for name in (key, SEGMENT):
        if name in batch.schema.names:
            values = batch.column(name).to_numpy(zero_copy_only=False)
            edges.update((np.flatnonzero(values[1:] != values[:-1]) + 1).tolist())
    bounds = sorted(edges)
    return list(zip(bounds, bounds[1:]))


class _Walker:
    """Walks a sorted partition batch by batch and tells where an order or segment begins.

    Orders that begin with an unsound row are stepped over; ``kept`` has the states they were entered with.
    """

    def __init__(self, key: str):
        self.key = key
        self.here = None
        self.lost = False
        self.kept: list[tuple[tuple, str]] = []

    def parts(self, batch: pa.RecordBatch):
        """Yield ``(lo, hi, ident, begins, entry)``; a row that only brings a state is stepped over."""
        keys, entries = batch.column(self.key), batch.column(ENTRY)
        marks = batch.column(SEGMENT) if SEGMENT in batch.schema.names else None
        snapshots = batch.column("snapshot").to_numpy(zero_copy_only=False)
        sound = batch.column(SOUND).to_numpy(zero_copy_only=False)
        for lo, hi in _pieces(batch, self.key):
            ident = (keys[lo].as_py(), marks[lo].as_py() if marks is not None else 0)
            begins, self.here = ident != self.here, ident
            if begins:
                self.lost = not sound[lo]
            if self.lost:
                self.kept.extend((ident, entries[i].as_py()) for i in range(lo, hi) if snapshots[i])
                continue
            entry = entries[lo].as_py() if begins else None
            yield lo + int(snapshots[lo]), hi, ident, begins, entry


def _run_rows(program: Program, key: str, carry: list[str], schema: pa.Schema, with_state: bool):
    """Arrow map: every row with its results, and on request a state row per segment."""

    def state_rows(ended: list[tuple]) -> pa.RecordBatch:
        rows = []
        for ident, states in ended:
            row = {key: ident[0], STATE: states if isinstance(states, str) else json.dumps(states)}
            if SEGMENT in schema.names:
                row[SEGMENT] = ident[1]
            rows.append(row)
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker, states, previous = _Walker(key), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ranges, entered, finished = [], [], []
            for lo, hi, ident, begins, entry in walker.parts(batch):
                if begins:
                    if with_state and previous is not None:
                        finished.append((previous, states))
                    states, previous = {**program.initial(), **json.loads(entry or "{}")}, ident
                if lo < hi:
                    ranges.append((lo, hi))
                    entered.append(states)
            if ranges:
                rows = batch
                if sum(hi - lo for lo, hi in ranges) < batch.num_rows:
                    rows = batch.take(pa.array(np.concatenate([np.arange(*r) for r in ranges])))
                # Orders of a batch run side by side; their states are updated in place.
                done = program.run_lanes(program.columns(rows), [hi - lo for lo, hi in ranges], entered)
                arrays = []
                for field in schema:
                    if field.name in program.outputs:
                        arrays.append(pa.array(done[field.name], type=field.type, from_pandas=False))
                    elif field.name == STATE:
                        arrays.append(pa.nulls(rows.num_rows, field.type))
                    else:
                        arrays.append(rows.column(field.name).cast(field.type))
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
            if finished:
                yield state_rows(finished)
            if with_state and walker.kept:
                yield state_rows(walker.kept)
            walker.kept.clear()
        if with_state and previous is not None:
            yield state_rows([(previous, states)])

    return apply


def _per_segment(program: Program, key: str, depth: int, exits: bool):
    """Arrow map: per segment its summary at level ``depth``, or with ``exits`` its end state.

    With ``exits``, a segment that follows its predecessor in the same task is entered with what that one ended in;
    ``used`` is the state of this level that a segment was entered with.
    """
    scans = program.levels[depth].scans
    prepare = program.levels[depth].prepare
    schema = pa.schema([(key, pa.string()), (SEGMENT, pa.int64()), *((n, pa.string()) for n in ("known", "used", "told"))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker, ident, known, used, states, told = _Walker(key), None, None, None, None, None
        done: list[dict] = []

        def report():
            done.append({key: ident[0], SEGMENT: ident[1], "known": json.dumps(known), "used": used, "told": json.dumps(told)})

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = program.columns(batch)
            for lo, hi, at, begins, entry in walker.parts(batch):
                if begins:
                    if ident is not None:
                        report()
                    follows = exits and ident is not None and at == (ident[0], ident[1] + 1)
                    ident, known = at, json.loads(entry or "{}")
                    states = {**program.initial(), **known, **(told if follows else {})}
                    told = {s.name: states[s.name] if exits else s.unknown() for s in scans}
                    used = json.dumps(told) if exits else None
                if lo == hi:
                    continue
                piece = {n: c[lo:hi] for n, c in cols.items()}
                if exits:
                    program.run(piece, states, depth + 1)
                    told = {s.name: states[s.name] for s in scans}
                else:
                    piece = program.run(piece, states, depth)
                    if prepare:
                        piece = {**piece, **prepare(piece)}
                    for scan in scans:
                        told[scan.name] = scan.absorb(told[scan.name], piece)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done.clear()
        if ident is not None:
            report()
            yield pa.RecordBatch.from_pylist(done, schema=schema)

    return apply


def _chain(program: Program, key: str, depth: int):
    """Arrow map of summaries in order: the state each segment is entered with.

    ``known`` has the states of earlier levels, ``tried`` those of this one, ``entry`` both.
    """
    scans = program.levels[depth].scans
    schema = pa.schema([(key, pa.string()), (SEGMENT, pa.int64()), *((n, pa.string()) for n in ("entry", "known", "tried"))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, states = None, None
        for batch in batches:
            out = []
            for row in batch.select([key, SEGMENT, "known", "told"]).to_pylist():
                known, told = json.loads(row["known"]), json.loads(row["told"])
                if states is None or row[key] != here:
                    here, states = row[key], {s.name: known.get(s.name, s.initial()) for s in scans}
                out.append({key: here, SEGMENT: row[SEGMENT], "entry": json.dumps({**known, **states}),
                            "known": row["known"], "tried": json.dumps(states)})
                states = {s.name: s.resolve(told[s.name], states[s.name]) for s in scans}
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return apply


class _LongOrders:
    """Entry states of the segments of long orders, level by level."""

    def __init__(self, program: Program, rows: DataFrame, key: str, order: list[str], bound: int):
        self.program, self.key, self.order, self.rows, self.bound = program, key, order, rows, bound
        heads = rows.groupBy(key, SEGMENT).agg(F.min(F.struct(*order)).alias("head"))
        within = Window.partitionBy(key)
        self.heads = settle(heads.withColumn(
            "last", F.col(SEGMENT) == F.max(SEGMENT).over(within)).withColumn(
            "first", F.col(SEGMENT) == F.min(SEGMENT).over(within)))
        self.entries = None

    def entered(self, entries: DataFrame | None) -> DataFrame:
        """Rows with each segment's entry state on its first row."""
        if entries is None:
            return self.rows
        at_head = entries.join(self.heads, [self.key, SEGMENT]).where(~F.col("first")).select(
            self.key, SEGMENT, "head", "entry")
        if self.bound > MOST_BROADCAST_ROWS:
            # Entry states are rows of their own, which sort before those of their segment; a task's segments of an order stay together.
            brought = at_head.select(self.key, SEGMENT, F.col("entry").alias(ENTRY), F.lit(True).alias(SOUND), F.lit(True).alias("snapshot"))
            return self.rows.unionByName(brought, allowMissingColumns=True).repartition(
                self.key, task_of_segment()).sortWithinPartitions(self.key, SEGMENT, F.col("snapshot").desc(), *self.order)
        # The join leaves rows where they are.
        joined = self.rows.join(listed(at_head, self.bound), [self.key, SEGMENT], "left")
        entry = F.when(F.struct(*self.order) == F.col("head"), F.coalesce(ENTRY, "entry")).otherwise(F.col(ENTRY))
        return joined.withColumn(ENTRY, entry).drop("head", "entry").sortWithinPartitions(self.key, SEGMENT, *self.order)

    def _ask(self, rows: DataFrame, depth: int, exits: bool) -> DataFrame:
        needed = [self.key, SEGMENT, ENTRY, SOUND, "snapshot", *self.program.inputs]
        return rows.select(*dict.fromkeys(needed)).mapInArrow(
            _per_segment(self.program, self.key, depth, exits),
            f"{self.key} string, {SEGMENT} long, known string, used string, told string")

    def solve(self) -> DataFrame:
        for depth, level in enumerate(self.program.levels):
            if not all(s.summarizes for s in level.scans):
                self.entries = self._settle_by_trial(depth)
                continue
            told = self._ask(self.entered(self.entries), depth, exits=False)
            chained = settle(told.repartition(self.key).sortWithinPartitions(self.key, SEGMENT).mapInArrow(
                _chain(self.program, self.key, depth),
                f"{self.key} string, {SEGMENT} long, entry string, known string, tried string"))
            if all(s.exact for s in level.scans):
                self.entries = chained.select(self.key, SEGMENT, "entry")
            else:
                self.entries = self._settle_by_trial(depth, chained)
        return self.entered(self.entries)

    def _settle_by_trial(self, depth: int, chained: DataFrame | None = None) -> DataFrame:
        """Entry states of a level whose summaries are missing, or not exact to the last bit.

        All segments run from a guess, that of the summaries (``chained``) if there are any; a segment whose predecessor ended
        otherwise than assumed runs again.  When none is left, every segment
        has been entered with exactly the state its predecessor ended in.
        Segments of an order that one task has cut run one after the other, so a round
        settles at least one more task of every order, most orders are settled in
        one round, and recurrences that forget their start settle in a few.
        """
        scans = self.program.levels[depth].scans
        guess = json.dumps({s.name: s.guess() for s in scans}) if chained is None else None
        if chained is not None:
            known = chained.select(self.key, SEGMENT, F.col("known").alias("entry"), "tried")
        elif self.entries is not None:
            known = self.entries.withColumn("tried", F.lit(guess))
        else:
            known = self.heads.select(self.key, SEGMENT, F.lit("{}").alias("entry"), F.lit(guess).alias("tried"))

        def merged(base: str, added: str):
            """Two flat JSON objects as one, by text: both are written by this module."""
            return F.when(F.col(base) == "{}", F.col(added)).otherwise(
                F.concat(F.expr(f"substring({base}, 1, length({base}) - 1)"), F.lit(", "),
                         F.expr(f"substring({added}, 2)")))

        state = settle(known.withColumn("told", F.lit(None).cast("string")))
        ordered = Window.partitionBy(self.key).orderBy(SEGMENT)
        in_task = Window.partitionBy(self.key, task_of_segment()).orderBy(SEGMENT)
        rows = self.rows
        while True:
            open_ = state.where(F.col("told").isNull())
            trial = open_.select(self.key, SEGMENT, merged("entry", "tried").alias("entry"))
            fresh = self._ask(self._over(rows).entered(trial), depth, exits=True)
            ended = fresh.select(self.key, SEGMENT, F.col("told").alias("fresh"), "used")
            state = state.join(listed(ended, self.bound), [self.key, SEGMENT], "left").withColumns({
                "told": F.coalesce("fresh", "told"), "tried": F.coalesce("used", "tried")}).drop("fresh", "used")
            state = state.withColumn("due", F.coalesce(F.lag("told").over(ordered), "tried"))
            # A segment that runs again takes those behind it in its task along.
            again = F.max(F.col("due") != F.col("tried")).over(in_task)
            state = settle(state.withColumn("told", F.when(~again, F.col("told"))).withColumn("tried", F.col("due")).drop("due"))
            open_ = state.where(F.col("told").isNull()).select(self.key, SEGMENT)
            if open_.isEmpty():
                return settle(state.select(self.key, SEGMENT, merged("entry", "tried").alias("entry")))
            rows = self.rows.join(listed(open_, self.bound), [self.key, SEGMENT], "left_semi")

    def _over(self, rows: DataFrame) -> "_LongOrders":
        other = object.__new__(_LongOrders)
        other.__dict__.update(self.__dict__, rows=rows)
        return other


def keyed_fold(
    rows: DataFrame,
    program: Program,
    key: str,
    order: list[str],
    carry: list[str],
    sizes: DataFrame | None = None,
    limit: int | None = None,
    states: DataFrame | None = None,
    with_state: bool = False,
) -> DataFrame:
    """Run ``program`` over each order's rows; an order with an ``error`` yields nothing.

    ``carry`` columns pass through.  ``states`` (key, ``state``) are entry
    states of orders that started in an earlier run.  ``with_state`` adds a
    ``state`` column that is null on result rows, and one row per order in
    which only the key and the state are set.
    """
    if ERROR not in rows.columns:
        rows = rows.withColumn(ERROR, F.lit(None).cast("string"))
    needed = list(dict.fromkeys([key, *order, *carry, *program.inputs]))
    # A row without a key belongs to no order.
    rows = rows.where(F.col(key).isNotNull()).select(*needed, F.col(ERROR).isNull().alias(SOUND), F.lit(None).cast("string").alias(ENTRY),
                       F.lit(False).alias("snapshot"))
    if states is not None:
        # A state row has no time, so it sorts before all rows of its order.
        rows = rows.unionByName(
            states.select(key, F.col(STATE).alias(ENTRY), F.lit(True).alias(SOUND), F.lit(True).alias("snapshot")),
            allowMissingColumns=True)
    split = split_long(rows, key, order, sizes, limit)

    kept = list(dict.fromkeys([key, *carry]))
    fields = [T.StructField(c, rows.schema[c].dataType) for c in kept]
    fields += [T.StructField(n, t) for n, t in program.outputs.items()]
    if with_state:
        fields.append(T.StructField(STATE, T.StringType()))

    def mapped(part: DataFrame, schema: T.StructType) -> DataFrame:
        return part.mapInArrow(
            _run_rows(program, key, kept, to_arrow_schema(schema), with_state), schema)

    # Rows in error sort before all others of their order, so the fold knows at
    # an order's first row whether the order is lost.
    together = split.short.repartition(key).sortWithinPartitions(key, SOUND, *order)
    result = mapped(together, T.StructType(fields))
    if split.long is None:
        return result

    failed = listed(settle(split.long.where(~F.col(SOUND)).select(key).distinct()), split.bound)
    long_rows = split.long.join(failed, key, "left_anti")
    solver = _LongOrders(program, long_rows, key, order, split.bound)
    long_fields = T.StructType([*fields, T.StructField(SEGMENT, T.LongType())])
    long_result = mapped(solver.solve(), long_fields)
    if with_state:
        last = listed(solver.heads.where("last").select(key, SEGMENT, F.lit(True).alias("is_last")), split.bound)
        long_result = long_result.join(last, [key, SEGMENT], "left").where(
            F.col(STATE).isNull() | F.col("is_last")).drop("is_last")
        # A failed order leaves with the state it came with.
        kept = split.long.where("snapshot").join(failed, key, "left_semi").select(key, F.col(ENTRY).alias(STATE))
        long_result = long_result.unionByName(kept, allowMissingColumns=True)
    return result.unionByName(long_result.drop(SEGMENT))
