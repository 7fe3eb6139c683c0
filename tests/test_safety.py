"""The batch job, its switches and its stream."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwatch.config import Cell, Config
from cellwatch.operators.features import KEY
from cellwatch.plans import safety
from cellwatch.plans.safety import EVENT_COLUMNS, run_batch, safety_program
from cellwatch.sources.sinks import DAY, read_events, write_events
from cellwatch.sources.telemetry import between_dates, read_telemetry
from cellwatch.streaming.stream import replay

TIE = ("event_id",)


def frame(df):
    return df.toPandas().sort_values("event_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def stored(spark, telemetry, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("telemetry") / "raw")
    telemetry.write.partitionBy("dt").parquet(path)
    return path


def test_event_columns(telemetry, grids):
    events = safety.fault_events(telemetry, grids, tiebreak=TIE)
    assert tuple(events.columns) == EVENT_COLUMNS
    types = dict(events.dtypes)
    assert types["ISC_FAULT"] == "int" and types["TempId"] == "bigint" and types["DeltaP"] == "double"
    assert types["dt"] == "string" and types["ISC_FAULT_ret"] == "int"


def test_scans_prune_partitions(spark, stored):
    rows = read_telemetry(spark, stored, "2024-01-05", "2024-01-06")
    assert {r.dt for r in rows.select("dt").distinct().collect()} == {"2024-01-05", "2024-01-06"}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    partition_filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "2024-01-05" in partition_filters and "2024-01-06" in partition_filters


def test_missing_columns_are_named(spark, stored, tmp_path):
    spark.read.parquet(stored).drop("cell_min_tem").write.parquet(str(tmp_path / "less"))
    with pytest.raises(ValueError, match="cell_min_tem"):
        read_telemetry(spark, str(tmp_path / "less"), "2024-01-05", "2024-01-06")


def test_ranges_run_one_after_the_other_equal_one_run(spark, stored, grids, telemetry, tmp_path):
    target = str(tmp_path / "events")
    spans = [("2024-01-01", "2024-01-10"), ("2024-01-11", "2024-01-31")]
    first = run_batch(spark, stored, target, *spans[0], grids, tiebreak=TIE)
    second = run_batch(spark, stored, target, *spans[1], grids, tiebreak=TIE, states=first.states)
    again = run_batch(spark, stored, target, *spans[1], grids, tiebreak=TIE, states=first.states)
    assert second.failed.count() == 0
    got = frame(again.events)
    want = frame(safety.event_columns(safety.safety_rows(telemetry, grids, tiebreak=TIE), TIE))
    assert len(got) == len(want) and got["event_id"].is_unique
    for c in EVENT_COLUMNS:
        assert (got[c] == want[c]).all() or np.allclose(got[c], want[c], atol=1e-9), c


def test_empty_ranges_write_nothing(spark, stored, grids, tmp_path):
    run = run_batch(spark, stored, str(tmp_path / "none"), "2030-01-01", "2030-01-02", grids, tiebreak=TIE)
    assert run.failed.count() == 0 and run.states.count() == 0


def test_append_and_catalog_tables(spark, telemetry, grids):
    rows = safety.safety_rows(telemetry, grids, tiebreak=TIE)
    events = safety.event_columns(rows, ("event_id", F.col("dt").alias(DAY))).where("event_id < 200")
    count = events.count()
    for _ in range(2):
        write_events(events, "fault_events_test")
    assert read_events(spark, "fault_events_test").count() == count
    write_events(events, "fault_events_test", mode="append")
    assert read_events(spark, "fault_events_test").count() == 2 * count
    with pytest.raises(ValueError):
        write_events(events, "fault_events_test", mode="replace")


def test_dates_are_inclusive(telemetry):
    days = {r.dt for r in between_dates(telemetry, "2024-01-03", "2024-01-05").select("dt").distinct().collect()}
    assert days == {"2024-01-03", "2024-01-04", "2024-01-05"}


# --- switches, on hand-made columns ---------------------------------------------

def walk(config, grids, **columns):
    n = len(next(iter(columns.values())))
    base = {
        "epoch": 1.7e9 + 20.0 * np.arange(n), "temp_max": np.full(n, 30.0), "temp_avg": np.full(n, 29.0),
        "temp_ambient": np.full(n, 25.0), "delta_v": np.full(n, 0.01), "delta_t": np.full(n, 1.0),
        "soc_avg": np.full(n, 0.5), "soc_min": np.full(n, 0.5), "volt_avg": np.full(n, 3.45),
        "volt_min": np.full(n, 3.44), "current": np.full(n, -10.0), "dt": np.full(n, "d", dtype=object),
    }
    program = safety_program(config, grids)
    return program.run({**base, **{k: np.asarray(v) for k, v in columns.items()}}, program.initial())


def test_pmax_measures_its_gap_from_the_epoch_unless_told_otherwise(grids):
    temps = 30.0 + np.repeat(np.arange(6.0), 12)
    as_is = walk(Config(), grids, temp_max=temps)
    mended = walk(replace(Config(), fix_pmax_time=True), grids, temp_max=temps)
    assert np.abs(as_is["max_slope"]).max() < 1e-7
    assert np.abs(mended["max_slope"]).max() > 1e-3


def test_drift_alarm_input(grids):
    hot = np.full(60, 20.0)
    as_is = walk(Config(), grids, delta_t=hot)
    assert as_is["wtt"].max() == 0
    assert walk(replace(Config(), wtt_input="delta_t"), grids, delta_t=hot)["wtt"].max() == 4


def test_debounce(grids):
    spike = np.where(np.isin(np.arange(30), (10, 11, 12)), 0.2, 0.01)
    assert walk(Config(), grids, delta_v=spike)["wv"].max() == 2
    assert walk(Config().debounced(), grids, delta_v=spike)["wv"].max() == 1


def test_heat_alarm_is_reported_but_raises_no_flag(grids):
    config = replace(Config(), cell=Cell(heat_decay=0.5, area=1.0))
    out = walk(config, grids, temp_max=np.full(40, 60.0))
    assert out["wp"].max() == 4 and not (out["isc"] | out["cap"] | out["heat"]).any()


def test_soc_method(grids):
    stateless = walk(Config(), grids, soc_avg=np.full(50, 0.9))
    filtered = walk(replace(Config(), soc_method="ekf"), grids, soc_avg=np.full(50, 0.9))
    assert stateless["delta_soc"][-1] == pytest.approx(0.4 * (1 - 0.99 ** 50))
    assert filtered["delta_soc"][-1] != pytest.approx(stateless["delta_soc"][-1])


def test_fault_dates_and_codes(grids):
    dv = np.array([0.01] * 3 + [0.2] * 3 + [0.01] * 4)
    days = np.array(list("aabbccddee"), dtype=object)
    out = walk(Config(), grids, delta_v=dv, dt=days)
    assert out["cap"].tolist() == [0, 0, 0, 0, 1, 1, 0, 0, 0, 0]
    assert out["cap_ret"].tolist() == [1] * 4 + [2] * 6 and out["heat_ret"].tolist() == [1] * 10
    assert out["event_dt"].tolist() == list("aaaa" + "cccccc")


def test_more_alarm_never_means_fewer_faults():
    levels = np.array(np.meshgrid(range(5), range(5), range(3), range(3))).reshape(4, -1)
    base = safety.fault_flags(*levels)
    for i in range(4):
        raised = levels.copy()
        raised[i] += 1
        for name, flags in safety.fault_flags(*raised).items():
            assert (flags >= base[name]).all()


def test_unknown_switches_are_refused():
    with pytest.raises(ValueError):
        Config(soc_method="guess")
    with pytest.raises(ValueError):
        Config(wtt_input="delta_x")


# --- stream ----------------------------------------------------------------------

def test_stream_keeps_state_and_drops_failed_orders(spark, telemetry, grids, tmp_path):
    some = telemetry.where(F.col("event_id") % 2 == 0).withColumn(
        "bcs_currentmeasure", F.when(F.col("event_id") == 10, "off").otherwise(F.col("bcs_currentmeasure").cast("string")))
    lost = some.where("event_id = 10").first()[KEY]
    parts = [some.where("event_id < 300"), some.where("event_id >= 300")]
    events, failed = replay(spark, parts, grids, tiebreak=TIE)
    assert events.columns == ["event_id", *EVENT_COLUMNS] and [r[KEY] for r in failed.collect()] == [lost]
    got, want = frame(events), frame(safety.event_columns(safety.safety_rows(some, grids, tiebreak=TIE), TIE))
    assert lost not in set(got[KEY]) and len(got) == len(want)
    for c in EVENT_COLUMNS:
        assert (got[c] == want[c]).all(), c


def test_stream_waits_for_late_rows_and_takes_back_what_failed_orders_gave(spark, telemetry, grids):
    some = telemetry.where(F.col("event_id") % 2 == 0).withColumn(
        "bcs_currentmeasure", F.when(F.col("event_id") == 950, "off").otherwise(F.col("bcs_currentmeasure").cast("string")))
    lost = some.where("event_id = 950").first()[KEY]
    # Rows of two days change places across the triggers.
    cut, swapped = F.col("dt") >= "2024-01-15", F.col("dt").isin("2024-01-14", "2024-01-15") & (F.col("event_id") % 4 == 0)
    parts = [some.where(cut == swapped), some.where(cut != swapped)]
    events, failed = replay(spark, parts, grids, tiebreak=TIE, lateness="3 days")
    assert [r[KEY] for r in failed.collect()] == [lost]
    got, want = frame(events), frame(safety.event_columns(safety.safety_rows(some, grids, tiebreak=TIE), TIE))
    assert lost not in set(got[KEY]) and len(got) == len(want)
    for c in EVENT_COLUMNS:
        assert (got[c] == want[c]).all(), c


class Store:
    """What the processor keeps, in memory."""

    def __init__(self):
        self.values, self.entries, self.most = {}, {}, 0

    def getValueState(self, name, schema, ttlDurationMs=None):
        store = self.values

        class Value:
            exists = staticmethod(lambda: name in store)
            get = staticmethod(lambda: store[name])
            update = staticmethod(lambda v: store.__setitem__(name, v))

        return Value

    def getMapState(self, name, key, value, ttlDurationMs=None):
        class Map:
            keys = staticmethod(lambda: iter(list(self.entries)))
            getValue = staticmethod(lambda k: self.entries[k])
            updateValue = staticmethod(lambda k, v: self.entries.__setitem__(k, v))
            removeKey = staticmethod(lambda k: self.entries.pop(k))
            clear = staticmethod(self.entries.clear)

        return Map


def test_a_call_with_many_rows_runs_bucket_by_bucket(telemetry, grids):
    """A million rows would be the same: what is sorted at once is a bucket, not the call."""
    from cellwatch.operators.features import features, with_soc
    from cellwatch.streaming.stream import OrderProcessor

    rows = with_soc(features(telemetry, TIE), grids).where("error is null").withColumn(KEY, F.lit("one")).toPandas()
    program = safety_program(Config(), grids)
    columns = [KEY, "event_id", "reltime", *program.outputs]

    def run(chunk_rows):
        processor = OrderProcessor(program, ["reltime", "event_id"], columns, bucket_seconds=86_400, chunk_rows=chunk_rows)
        store = Store()
        processor.init(store)
        shuffled = rows.sample(frac=1, random_state=3)
        calls = [shuffled.iloc[i:i + 100] for i in range(0, len(shuffled), 100)]
        out = list(processor.handleInputRows(("one",), iter(calls), None))
        assert not store.entries
        return out, store.values["carried"]

    (whole,), state = run(10**9)
    parts, state_of_parts = run(200)
    assert len(parts) > 20 and max(map(len, parts)) < len(rows) / 10 and state == state_of_parts
    import pandas as pd

    pd.testing.assert_frame_equal(pd.concat(parts, ignore_index=True), whole)


class WaitingStore(Store):
    """Counts timers and entries."""

    def __init__(self):
        super().__init__()
        self.timers, self.written = [], 0

    def getValueState(self, name, schema, ttlDurationMs=None):
        value = super().getValueState(name, schema, ttlDurationMs)
        value.clear = staticmethod(lambda: self.values.pop(name, None))
        return value

    def getMapState(self, name, key, value, ttlDurationMs=None):
        entries = super().getMapState(name, key, value, ttlDurationMs)

        def put(k, v):
            self.written += 1
            self.entries[k] = v

        entries.updateValue = staticmethod(put)
        return entries

    def registerTimer(self, at):
        self.timers.append(at)


class Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_rows_that_wait_cost_few_entries_and_timers(telemetry, grids):
    """Rows of one order far apart, out of order: what is run is in order, whatever part of the rows waits by bucket."""
    import pandas as pd

    from cellwatch.operators.features import features, with_soc
    from cellwatch.streaming.stream import OrderProcessor

    rows = with_soc(features(telemetry, TIE), grids).where("error is null").withColumn(KEY, F.lit("one")).toPandas()
    program = safety_program(Config(), grids)
    columns = [KEY, "event_id", "reltime", *program.outputs]
    rows = rows.sort_values(["reltime", "event_id"], ignore_index=True)
    whole = OrderProcessor(program, ["reltime", "event_id"], columns)._run([rows], program.initial())
    shuffled = rows.sample(frac=1, random_state=5)
    for chunk_rows in (10**9, 400, 1):
        processor = OrderProcessor(program, ["reltime", "event_id"], columns, waits=True, chunk_rows=chunk_rows)
        store, out = WaitingStore(), []
        processor.init(store)
        for at in range(0, len(rows), 100):
            assert not list(processor.handleInputRows(("one",), iter([shuffled.iloc[at:at + 100]]), None))
        assert len(store.timers) <= 10
        if chunk_rows > len(rows):
            assert store.written == 10
        for share in (0.3, 0.30001, 0.8, 2):
            at = rows["epoch"].min() + share * (rows["epoch"].max() - rows["epoch"].min())
            calls = len(store.timers)
            out += list(processor.handleExpiredTimer(("one",), Watermark(int(at * 1000)), None))
            assert sum(map(len, out)) <= (rows["epoch"] <= at).sum() and len(store.timers) <= calls + 1
        assert not store.entries and store.values.get("loose", (0,)) == (0,)
        pd.testing.assert_frame_equal(pd.concat(out, ignore_index=True), whole)


def test_orders_that_wait_share_calls(telemetry, grids):
    """Orders of a group take one entry, one timer and one run at a time, and give what each gives alone."""
    import pandas as pd

    from cellwatch.operators.features import features, with_soc
    from cellwatch.operators.fold import Program
    from cellwatch.streaming import stream

    rows = with_soc(features(telemetry, TIE), grids).where("error is null").toPandas()
    program, runs = safety_program(Config(), grids), []

    class Counted(Program):
        def run_lanes(self, cols, lengths, states):
            runs.append(len(lengths))
            return super().run_lanes(cols, lengths, states)

    counted = Counted(**{f: getattr(program, f) for f in ("levels", "inputs", "outputs", "finish", "text_inputs")})
    columns = [KEY, "event_id", "reltime", "error", *program.outputs]
    orders = sorted(set(rows[KEY]))
    bad, worse = orders[1], orders[2]
    rows.loc[rows[rows[KEY] == bad].index[-1], "error"] = "unusable"
    rows.loc[rows[rows[KEY] == worse].index[:2], "error"] = ["second", "first"]
    single = stream.OrderProcessor(program, ["reltime", "event_id"], columns)
    want = [single._run([rows[rows[KEY] == o]], program.initial()) for o in orders if o not in (bad, worse)]

    class Maps(WaitingStore):
        """With a map for each name."""

        def getMapState(self, name, key, value, ttlDurationMs=None):
            if name == "waiting":
                return super().getMapState(name, key, value, ttlDurationMs)
            kept = self.values.setdefault(name, {})

            class Map:
                keys = staticmethod(lambda: iter(list(kept)))
                getValue = staticmethod(lambda k: kept.get(k))
                updateValue = staticmethod(lambda k, v: kept.__setitem__(k, v))

            return Map

    rows[stream.GROUP] = 5
    cut = rows["epoch"].median()
    for chunk_rows in (10**9, 300):
        runs.clear()
        processor, store, out = stream.GroupProcessor(counted, ["reltime", "event_id"], columns, chunk_rows=chunk_rows), Maps(), []
        processor.init(store)
        for part, until in ((rows["epoch"] < cut, cut - 90_000), (rows["epoch"] >= cut, 2 * cut)):
            frame = rows[part].sample(frac=1, random_state=2)
            out += list(processor.handleInputRows((5,), iter([frame.iloc[i:i + 150] for i in range(0, len(frame), 150)]), None))
            out += list(processor.handleExpiredTimer((5,), Watermark(int(until * 1000)), None))
        if chunk_rows > len(rows):
            assert len(runs) == 2 and min(runs) > 5 and store.written == 3 and len(store.timers) <= 3
        assert not store.entries and store.values.get("loose", (0,)) == (0,)
        whole = pd.concat([o.astype(object) for o in out if len(o)])
        failed = whole[whole["error"].notna()]
        first = rows[rows["error"].notna()].sort_values(["reltime", "event_id"]).drop_duplicates(KEY)
        assert sorted(zip(failed[KEY], failed["error"])) == sorted(zip(first[KEY], first["error"])) and len(failed) == 2
        sound = whole[whole["error"].isna() & ~whole[KEY].isin([bad, worse])]
        got = sound.sort_values([KEY, "reltime", "event_id"], ignore_index=True)
        pd.testing.assert_frame_equal(got, pd.concat(want, ignore_index=True), check_dtype=False)
        assert not (whole[KEY] == worse)[whole["error"].isna()].any()


def test_stream_of_grouped_orders_goes_on_from_states(spark, telemetry, grids, monkeypatch):
    from cellwatch.operators.fold import STATE
    from cellwatch.streaming import stream

    monkeypatch.setattr(stream, "ORDER_GROUPS", 2)
    cut = F.col("dt") >= "2024-01-15"
    folded = safety.safety_rows(telemetry.where(~cut), grids, tiebreak=TIE, with_state=True)
    states = folded.where(F.col(STATE).isNotNull()).select(KEY, STATE)
    events, failed = replay(spark, [telemetry.where(cut)], grids, tiebreak=TIE, lateness="3 days", states=states)
    got = frame(events)
    want = frame(safety.event_columns(safety.safety_rows(telemetry, grids, tiebreak=TIE), TIE))
    want = want[want["reltime"].astype(str) >= "2024-01-15"].reset_index(drop=True)
    assert failed.count() == 0 and len(got) == len(want) > 100
    for c in EVENT_COLUMNS:
        assert (got[c] == want[c]).all(), c
