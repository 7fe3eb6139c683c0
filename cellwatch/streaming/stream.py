"""Structured Streaming: the same per-order program, with its state kept between micro-batches."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import Config
from ..operators.features import KEY, features, with_soc
from ..operators.fold import ERROR, Program, STATE
from ..plans.safety import TIME, event_columns, safety_program
from ..session import scratch_path
from ..sources.grids import Grids
from ..sources.sinks import DAY

#: Second partition column of what a stream writes: the micro-batch, so that one that runs again replaces itself.
BATCH = "batch"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FAILED = "failed"
#: Key of the row that ends a replay.
NO_ORDER = "no order"


#: Column by which the watermark goes, and seconds of telemetry that wait together.
EVENT_TIME, BUCKET_SECONDS = "event_time", 600
#: Rows of one call that are sorted at once; more go through the state store, bucket by bucket.
CHUNK_ROWS = 50_000
#: Orders of a stream that waits for late rows share so many keys, and a key's orders so many entries of states; fixed
#: for a checkpoint.
GROUP, ORDER_GROUPS, STATE_BLOCKS = "order_group", 4096, 16


def _packed(frame: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(raw)).read_all().to_pandas()


class OrderProcessor(StatefulProcessor):
    """Runs the program over the rows that arrive for an order.

    Without a lateness, rows of one micro-batch are put in order and run at once; rows of
    different micro-batches have to arrive in order.  With one, rows wait in the state store
    until the watermark has passed their bucket of ``bucket_seconds``, and then run in
    order; rows that come later than that are left out by Spark, which counts them.

    Up to ``chunk_rows`` rows of an order wait as they came, an entry for each frame, and an order has one timer at a
    time, for the bucket that ends first: few rows over a long time cost few entries and timers.  More rows wait in an
    entry for each bucket.  So what a call holds is a chunk of ``chunk_rows`` and the rows of a bucket; without a
    lateness, a call with more rows puts them into buckets as they come and runs these one after the other.  An
    order with an unusable row reports that row once and yields nothing from then on; see ``sound_events`` for
    what it gave before.
    """

    def __init__(self, program: Program, order: Sequence[str], columns: Sequence[str], keep_seconds: int | None = None,
                 waits: bool = False, bucket_seconds: int = BUCKET_SECONDS, chunk_rows: int = CHUNK_ROWS):
        self.program, self.order, self.columns, self.keep_seconds = program, list(order), list(columns), keep_seconds
        self.waits, self.bucket_seconds, self.chunk_rows = waits, bucket_seconds, chunk_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        keep = None if self.keep_seconds is None else self.keep_seconds * 1000
        self.handle = handle
        self.carried = handle.getValueState("carried", "states string", ttlDurationMs=keep)
        # Entries by their first bucket; part is negative where later buckets' rows are among them.
        self.waiting = handle.getMapState("waiting", "bucket long, part long", "rows binary", ttlDurationMs=keep)
        self.parts = handle.getValueState("parts", "n long", ttlDurationMs=keep)
        #: Rows that wait as they came, and the bucket that the order's timer is for.
        self.loose = handle.getValueState("loose", "rows long", ttlDurationMs=keep)
        self.timer = handle.getValueState("timer", "bucket long", ttlDurationMs=keep)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """An order goes on from the state that a batch run has left."""
        self.carried.update((initialState[STATE].iloc[0],))

    def _states(self) -> dict:
        return {**self.program.initial(), **json.loads(self.carried.get()[0])} if self.carried.exists() else self.program.initial()

    def _carry(self, states: dict) -> None:
        self.carried.update((json.dumps(states),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        states = self._states()
        if FAILED in states:
            return
        held, count, broken, spilled = [], 0, None, False
        for frame in rows:
            unsound = frame[ERROR].notna().to_numpy()
            if unsound.any():
                bad = frame[unsound]
                broken = pd.concat([bad] if broken is None else [broken, bad]).sort_values(self.order, ignore_index=True).head(1)
            if broken is not None:
                continue
            held.append(frame)
            count += len(frame)
            if spilled or count > self.chunk_rows:
                for one in held:
                    self._put(one)
                held, spilled = [], True
        if broken is not None:
            self.waiting.clear()
            self.carried.update((json.dumps({FAILED: broken[ERROR].iloc[0]}),))
            yield broken.assign(**dict.fromkeys(self.program.outputs, None))[self.columns]
        elif self.waits:
            if held:
                self._put_loose(held)
        elif not spilled:
            yield self._run(held, states)
            self._carry(states)
        else:
            yield from self._release(None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(timerValues.getCurrentWatermarkInMs())

    def _buckets(self, frame: pd.DataFrame) -> np.ndarray:
        return (frame["epoch"].to_numpy() // self.bucket_seconds).astype("int64")

    def _ends(self, bucket: int) -> int:
        """When a bucket ends, in milliseconds."""
        return (bucket + 1) * self.bucket_seconds * 1000

    def _number(self) -> int:
        return self.parts.get()[0] if self.parts.exists() else 0

    def _wake(self, bucket: int) -> None:
        """See to it that the order is called once ``bucket`` has ended."""
        if self.waits and not (self.timer.exists() and self.timer.get()[0] <= bucket):
            self.timer.update((bucket,))
            self.handle.registerTimer(self._ends(bucket))

    def _put(self, frame: pd.DataFrame) -> None:
        """Rows into the state store, by bucket."""
        number, buckets = self._number(), self._buckets(frame)
        for bucket, part in frame.groupby(buckets):
            self.waiting.updateValue((int(bucket), number), (_packed(part),))
            number += 1
        self.parts.update((number,))
        self._wake(int(buckets.min()))

    def _put_loose(self, frames: list[pd.DataFrame]) -> None:
        """Rows into the state store as they came, as long as those fit a chunk."""
        frame = pd.concat(frames) if len(frames) > 1 else frames[0]
        rows = self.loose.get()[0] if self.loose.exists() else 0
        if rows + len(frame) > self.chunk_rows:
            self._put(frame)
            return
        number, first = self._number(), int(self._buckets(frame).min())
        self.waiting.updateValue((first, -1 - number), (_packed(frame),))
        self.parts.update((number + 1,))
        self.loose.update((rows + len(frame),))
        self._wake(first)

    def _release(self, until: int | None) -> Iterator[pd.DataFrame]:
        """Run the buckets that end by ``until`` (in milliseconds), all of them without one, in order."""
        places = sorted((int(b), int(n)) for b, n in self.waiting.keys())
        ready = [p for p in places if until is None or self._ends(p[0]) <= until]
        later = [b for b, _ in places[len(ready):]]
        loose = [_unpacked(bytes(self.waiting.getValue(p)[0])) for p in ready if p[1] < 0]
        if loose:
            frame = pd.concat(loose) if len(loose) > 1 else loose[0]
            of = self._buckets(frame)
            stays = np.zeros(len(of), bool) if until is None else self._ends(of) > until
            for place in (p for p in ready if p[1] < 0):
                self.waiting.removeKey(place)
            if stays.any():
                number, first = self._number(), int(of[stays].min())
                self.waiting.updateValue((first, -1 - number), (_packed(frame[stays]),))
                self.parts.update((number + 1,))
                later.append(first)
            self.loose.update((self.loose.get()[0] - int((~stays).sum()),))
            frame, of = frame[~stays], of[~stays]
        states = self._states() if ready else None
        for bucket, group in groupby((p for p in ready if p[1] >= 0), key=lambda p: p[0]):
            here = list(group)
            if loose and (of < bucket).any():
                yield self._run([frame[of < bucket]], states)
            rows = [_unpacked(bytes(self.waiting.getValue(p)[0])) for p in here]
            if loose:
                rows.append(frame[of == bucket])
                frame, of = frame[of > bucket], of[of > bucket]
            yield self._run(rows, states)
            for place in here:
                self.waiting.removeKey(place)
        if loose and len(of):
            yield self._run([frame], states)
        if ready:
            self._carry(states)
        if self.waits:
            self.timer.clear()
            if later:
                self._wake(min(later))

    def _run(self, frames: list[pd.DataFrame], states: dict) -> pd.DataFrame:
        arrived = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]
        rows = {n: arrived[n].to_numpy() for n in {*self.order, *self.program.inputs, *self.columns} if n not in self.program.outputs}
        if len(arrived) > 1:
            at = pd.DataFrame({n: rows[n] for n in self.order}).sort_values(self.order).index.to_numpy()
            rows = {n: c[at] for n, c in rows.items()}
        cols = {n: rows[n] if n in self.program.text_inputs else rows[n].astype(float) for n in self.program.inputs}
        results = self.program.run(cols, states)
        return pd.DataFrame({n: results[n] if n in self.program.outputs else rows[n] for n in self.columns}, copy=False)

    def close(self) -> None:
        pass


class GroupProcessor(OrderProcessor):
    """The same for rows that wait, with many orders to a key, which run side by side.

    A call costs many times what a row costs, so orders share the calls, the waiting entries and the timer of their
    group; ``chunk_rows`` holds for the group.  States are kept in ``STATE_BLOCKS`` entries by order, each read and written when rows of
    one of its orders run.  An order that has failed is an entry of ``lost``; what still waits of it is left out when its time comes.
    """

    def __init__(self, program: Program, order: Sequence[str], columns: Sequence[str], bucket_seconds: int = BUCKET_SECONDS,
                 chunk_rows: int = CHUNK_ROWS):
        super().__init__(program, order, columns, None, True, bucket_seconds, chunk_rows)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.blocks = handle.getMapState("blocks", "block int", "states string")
        self.lost = handle.getMapState("lost", "orderid string", "reason string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        states = self._states()
        for name, own in zip(initialState[KEY].astype(str), initialState[STATE]):
            self._block(states, name)[name] = own
        self._carry(states)

    def _states(self) -> dict:
        """Blocks of the orders whose rows run, by order; the state of one that runs is a dictionary, the others' are text."""
        return {}

    def _block(self, states: dict, name: str) -> dict:
        number = zlib.crc32(name.encode()) % STATE_BLOCKS
        if number not in states:
            kept = self.blocks.getValue((number,))
            states[number] = {} if kept is None else json.loads(kept[0])
        return states[number]

    def _entered(self, states: dict, name: str) -> dict:
        """The state of an order, to be updated in place."""
        block = self._block(states, name)
        if not isinstance(block.get(name), dict):
            block[name] = {**self.program.initial(), **json.loads(block.get(name, "{}"))}
        return block[name]

    def _carry(self, states: dict) -> None:
        for number, block in states.items():
            texts = {name: json.dumps(own) if isinstance(own, dict) else own for name, own in block.items()}
            self.blocks.updateValue((number,), (json.dumps(texts),))

    def _lost(self) -> set[str]:
        return {k[0] for k in self.lost.keys()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lost, fresh = self._lost(), set()
        held, count, broken, spilled = [], 0, None, False
        for frame in rows:
            frame, names = frame.drop(columns=GROUP), frame[KEY].astype(str)
            if lost:
                frame = frame[~names.isin(lost).to_numpy()]
            unsound = frame[ERROR].notna().to_numpy()
            if unsound.any():
                bad = frame[unsound]
                broken = pd.concat([bad] if broken is None else [broken, bad]).sort_values(self.order, ignore_index=True).drop_duplicates(KEY)
                fresh.update(bad[KEY].astype(str))
            if fresh:
                frame = frame[~frame[KEY].astype(str).isin(fresh).to_numpy()]
            if not len(frame):
                continue
            held.append(frame)
            count += len(frame)
            if spilled or count > self.chunk_rows:
                for one in held:
                    self._put(one)
                held, spilled = [], True
        if broken is not None:
            for name, reason in zip(broken[KEY].astype(str), broken[ERROR]):
                self.lost.updateValue((name,), (reason,))
            yield broken.assign(**dict.fromkeys(self.program.outputs, None))[self.columns]
        if held:
            self._put_loose(held)

    def _run(self, frames: list[pd.DataFrame], states: dict) -> pd.DataFrame:
        arrived = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]
        names, lost = arrived[KEY].astype(str), self._lost()
        if lost:
            arrived = arrived[~names.isin(lost).to_numpy()]
        if not len(arrived):
            return pd.DataFrame(columns=self.columns)
        arrived = arrived.sort_values([KEY, *self.order])
        names = arrived[KEY].astype(str).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        rows = {n: arrived[n].to_numpy() for n in {*self.program.inputs, *self.columns} if n not in self.program.outputs}
        cols = {n: rows[n] if n in self.program.text_inputs else rows[n].astype(float) for n in self.program.inputs}
        entered = [self._entered(states, name) for name in names[starts].tolist()]
        results = self.program.run_lanes(cols, np.diff(np.append(starts, len(names))).tolist(), entered)
        return pd.DataFrame({n: results[n] if n in self.program.outputs else rows[n] for n in self.columns}, copy=False)


def stream_rows(
    telemetry: DataFrame, grids: Grids, config: Config = Config(), tiebreak: Sequence[str] = (),
    keep_seconds: int | None = None, lateness: str | None = None, states: DataFrame | None = None,
) -> DataFrame:
    """Processed rows of a telemetry stream, and one ``error`` row per failed order.

    An order's state goes ``keep_seconds`` after its last rows, by default never; rows
    that come later start anew.  Rows without an order are left out.  With a ``lateness``
    (``"30 minutes"``) rows may come out of order across micro-batches by so much, and wait
    as long; it excludes ``keep_seconds``.  ``states`` (order, ``state``) are what a batch run has left, from
    which the stream's first micro-batch goes on.
    """
    if lateness is not None and keep_seconds is not None:
        raise ValueError("a stream that waits for late rows goes by event time and cannot drop states by processing time")
    program = safety_program(config, grids)
    feats = with_soc(features(telemetry, tuple(tiebreak)), grids)
    carry = [KEY, *tiebreak, TIME, "dt", "batteryid", "volt_min", "temp_id", "temp_max", ERROR]
    schema = T.StructType(
        [T.StructField(c, feats.schema[c].dataType) for c in carry]
        + [T.StructField(n, t) for n, t in program.outputs.items()])
    needed = list(dict.fromkeys([*carry, *program.inputs]))
    rows = feats.select(*needed).where(F.col(KEY).isNotNull())
    if lateness is not None:
        rows = rows.withColumn(EVENT_TIME, F.timestamp_seconds("epoch")).withWatermark(EVENT_TIME, lateness)
        group = F.pmod(F.xxhash64(F.col(KEY).cast("string")), F.lit(ORDER_GROUPS)).cast("int").alias(GROUP)
        return rows.select(group, "*").groupBy(GROUP).transformWithStateInPandas(
            statefulProcessor=GroupProcessor(program, [TIME, *tiebreak], schema.names),
            outputStructType=schema, outputMode="Append", timeMode="EventTime",
            initialState=None if states is None else states.where(F.col(KEY).isNotNull()).select(group, KEY, STATE).groupBy(GROUP))
    return rows.groupBy(KEY).transformWithStateInPandas(
        statefulProcessor=OrderProcessor(program, [TIME, *tiebreak], schema.names, keep_seconds),
        outputStructType=schema, outputMode="Append", timeMode="None" if keep_seconds is None else "ProcessingTime",
        initialState=None if states is None else states.select(KEY, STATE).groupBy(KEY))


def sound_events(events: DataFrame, failed: DataFrame) -> DataFrame:
    """Events of the orders that have not failed.

    A stream has written an order's events before it meets the row that fails it; the batch leaves such an
    order out.  Reading the event table this way gives what the batch gives.
    """
    return events.join(failed.select(KEY).distinct(), KEY, "left_anti").select(*events.columns)


def start_events(
    telemetry: DataFrame, target: str, failed: str, checkpoint: str, grids: Grids, config: Config = Config(),
    tiebreak: Sequence[str] = (), trigger: dict | None = None, keep_seconds: int | None = None,
    extra: Sequence[Column | str] = (), lateness: str | None = None, states: DataFrame | None = None,
):
    """Start the stream into two parquet folders, the event table and the failed orders; returns the streaming query.

    Events have the columns of the batch job, those of ``tiebreak`` and ``extra``, and are
    partitioned by ``day`` and micro-batch.  The source should bound a micro-batch
    (``maxFilesPerTrigger``, ``maxBytesPerTrigger``), as each is written as a whole.  For ``lateness`` and
    ``states`` see ``stream_rows``; ``states`` count when the checkpoint is new.
    ``config`` must not change between runs on one checkpoint.
    """
    telemetry.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def write(rows: DataFrame, number: int) -> None:
        rows = rows.withColumn(BATCH, F.lit(number)).persist()
        events = event_columns(rows.where(F.col(ERROR).isNull()), (*tiebreak, *extra, F.col("dt").alias(DAY), BATCH))
        lost = rows.where(F.col(ERROR).isNotNull()).select(KEY, ERROR, BATCH)
        for part, path, by in ((events.hint("rebalance", DAY), target, (DAY, BATCH)), (lost, failed, (BATCH,))):
            part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
        rows.unpersist()

    return (
        stream_rows(telemetry, grids, config, tiebreak, keep_seconds, lateness, states)
        .writeStream.foreachBatch(write).outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def replay(
    spark: SparkSession, parts: Sequence[DataFrame], grids: Grids, config: Config = Config(),
    tiebreak: Sequence[str] = (), extra: Sequence[Column | str] = (), lateness: str | None = None, states: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Feed ``parts`` to one stream, a run each, and return the events of sound orders and the failed orders.

    With a ``lateness``, a row of no order, far ahead in time, comes last, so that no row is left waiting.
    """
    work = scratch_path(spark, "replay")
    if lateness is not None:
        kind = parts[-1].schema[TIME].dataType
        parts = [*parts, parts[-1].limit(1).withColumns({KEY: F.lit(NO_ORDER), TIME: F.lit("2200-01-01 00:00:00").cast(kind)})]
    for part in parts:
        part.write.mode("append").parquet(f"{work}/in")
        source = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1000).parquet(f"{work}/in")
        start_events(source, f"{work}/events", f"{work}/failed", f"{work}/state", grids, config, tiebreak, extra=extra,
                     lateness=lateness, states=states).awaitTermination()
    failed = spark.read.schema(f"{KEY} string, {ERROR} string, {BATCH} int").parquet(f"{work}/failed")
    return sound_events(spark.read.parquet(f"{work}/events").drop(DAY, BATCH), failed), failed.drop(BATCH)
