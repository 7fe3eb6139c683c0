"""The registered queries in SQL for an independent engine.

Column and window queries are plain SQL.  Keyed folds are recursive queries
that walk each order row by row.  Thresholds, cell constants, breaks and grids are
stated here by themselves, so that a wrong constant of the pipeline shows.
"""

from __future__ import annotations

from typing import NamedTuple

from . import catalog


class Levels(NamedTuple):
    """Thresholds of an alarm, from level 1 up."""

    rise: tuple[float, ...]
    settle: tuple[float, ...]
    clear: tuple[float, ...]


# Alarm thresholds.
WP = Levels((1.03, 1.23, 1.43, 1.63), (0.93, 1.13, 1.33, 1.53), (0.85, 1.05, 1.25, 1.45))
WSOC = Levels((0.066, 0.106, 0.146, 0.186), (0.056, 0.096, 0.136, 0.176), (0.046, 0.086, 0.126, 0.166))
WTT = Levels((7.0, 11.0, 15.0, 19.0), (6.0, 10.0, 14.0, 18.0), (5.0, 9.0, 13.0, 17.0))
WV = Levels((0.07, 0.12), (0.05, 0.1), (0.03, 0.08))
WT = Levels((8.0, 12.0), (7.0, 11.0), (6.0, 10.0))
# Thresholds of single queries.
SCALED_WP = Levels((5.0, 10.0, 20.0, 40.0), (4.0, 8.0, 16.0, 32.0), (3.0, 6.0, 12.0, 24.0))
VALUE_LEVELS = Levels((20.0, 40.0, 60.0, 80.0), (15.0, 35.0, 55.0, 75.0), (10.0, 30.0, 50.0, 70.0))

# Breaks of the sample grids.
TEMPS = (-20.0, 0.0, 25.0, 60.0)
RATES = (0.0, 0.5, 1.0, 4.0)
SOC = (0.0, 0.05, 0.15, 0.9, 0.95, 1.0)
OCV = (3.0, 3.3, 3.4, 3.5, 3.6, 4.2)


def d(x: float) -> str:
    """A number as a double literal."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"


TELEMETRY = """
tel as (
 select e.event_id, cast(e.user_id as varchar) orderid, concat('B', cast(e.user_id % 7 as varchar)) batteryid,
  e.ts reltime, strftime(e.ts, '%Y-%m-%d') dt,
  case when e.event_id % 97 = 0 then null else round(3.45::double-0.1::double*(e.event_id % 5)/5,4) end cell_min_volt,
  case when e.event_id % 101 = 0 then null else 30::double+(e.event_id % 9) end cell_max_tem,
  case when e.event_id % 11 = 0 then '[]' else concat('[', array_to_string(list_transform(m.embedding[1:48],
   lambda x: cast(round(3.45::double+0.4::double*cast(x as double),4) as varchar)), ', '), ']') end bmv_singlevolt,
  case when e.event_id % 13 = 0 then null else concat('[', array_to_string(list_transform(m.embedding[49:64],
   lambda x: cast(round(25::double+40::double*cast(x as double),2) as varchar)), ', '), ']') end bmt_singletemp,
  round(3.45::double-0.1::double*(e.event_id % 5)/5+0.02::double*(e.event_id % 8),4) cell_max_volt,
  30::double+(e.event_id % 9)-(e.event_id % 17) cell_min_tem,
  round(e.value-50::double,2) bcs_currentmeasure
 from events e join embeddings m on m.vec_id = e.event_id % (select count(*) from embeddings))"""


def parse(text: str) -> str:
    """A list text as a list of doubles, null when an item is unreadable."""
    items = f"list_filter(list_transform(string_split(trim({text}, '[]'), ','), lambda x: trim(x)), lambda x: x <> '')"
    cast = f"list_transform({items}, lambda x: try_cast(x as double))"
    return f"case when len(list_filter({cast}, lambda x: x is null)) = 0 then {cast} end"


def joined(column: str, digits: int) -> str:
    """All items of a list as text, as whole numbers of the last digit."""
    item = f"round(x * {d(10 ** digits)})::bigint::varchar"
    return f"array_to_string(list_transform({column}, lambda x: coalesce({item}, 'null')), ',')"


ARRAYS = f"""
parsed as (select *, {parse('bmv_singlevolt')} cells, {parse('bmt_singletemp')} temps from tel),
arrays as (select *, list_transform(cells, lambda v: case when v > 3.35e0 then v else list_max(cells) end) volts
 from parsed where len(cells) > 0 and len(temps) > 0)"""

REST_VOLT = "(list_reduce(volts, lambda a, x: a + x) - list_min(volts)) / (len(volts) - 1)"
REST_TEMP = "(list_reduce(temps, lambda a, x: a + x) - list_max(temps)) / (len(temps) - 1)"


def curve(x: str, xs, ys) -> str:
    """Piecewise linear with extended ends."""
    pieces = [f"{d(y0)} + ({x} - {d(x0)}) * {d(y1 - y0)} / {d(x1 - x0)}"
              for x0, y0, x1, y1 in zip(xs, ys, xs[1:], ys[1:])]
    cases = " ".join(f"when {x} < {d(b)} then {p}" for b, p in zip(xs[1:-1], pieces))
    return f"case {cases} else {pieces[-1]} end"


def clamp(x: str, lo: float, hi: float) -> str:
    return f"greatest({d(lo)}, least({d(hi)}, {x}))"


def soc_of(volt: str) -> str:
    return curve(f"({clamp(volt, OCV[0], OCV[-1])})", OCV, SOC)


FEATURES = f"""{TELEMETRY},
complete as (select *, {parse('bmv_singlevolt')} cells, {parse('bmt_singletemp')} temps
 from tel where cell_min_volt is not null and cell_max_tem is not null),
routed as (select *, coalesce(len(cells), 0) = 0 or coalesce(len(temps), 0) = 0 pack_only,
 list_transform(cells, lambda v: case when v > 3.35e0 then v else list_max(cells) end) volts from complete),
valued as (select *,
 case when pack_only then cell_max_volt - 2 * (cell_max_volt - cell_min_volt) else list_min(volts) end volt_min,
 case when pack_only then cell_min_volt else {REST_VOLT} end volt_avg,
 case when pack_only then cell_max_tem else list_max(temps) end temp_max,
 case when pack_only then (cell_max_tem + cell_min_tem) / 2 else {REST_TEMP} end temp_avg,
 case when pack_only then cell_min_tem else list_min(temps) end temp_ambient,
 case when pack_only then 1 else list_position(temps, list_max(temps)) - 1 end::bigint temp_id,
 -bcs_currentmeasure as current, floor(epoch(reltime))::bigint as epoch from routed),
feat as (select *, volt_avg - volt_min delta_v, temp_max - temp_avg delta_t,
 {soc_of('volt_avg')} soc_avg, {soc_of('volt_min')} soc_min from valued)"""


# --- alarms --------------------------------------------------------------------

def _reached(t: Levels, x: str, above: int) -> list[tuple[int, str]]:
    """(level, condition) for levels over ``above``, highest first."""
    return [(k, f"{x} >= {d(t.rise[k - 1])}") for k in range(len(t.rise), above, -1)]


def _rest(level: int) -> str:
    return f"warn{level}" if level else "normal"


def alarm_sql(t: Levels, state: str, x: str) -> tuple[str, str]:
    """Next state and reported level, as expressions over the state before and the input."""
    top, four = len(t.rise), len(t.rise) == 4
    next_, level = [f"when {state} = 'start' then 'normal'"], [f"when {state} = 'start' then 0"]
    for k in range(1, top + 1):
        at = f"{state} = 'pending{k}'"
        next_.append(f"when {at} and {x} < {d(t.settle[k - 1])} then '{_rest(k - 1)}'")
        level.append(f"when {at} and {x} < {d(t.settle[k - 1])} then {k - 1}")
        confirmed = f"{at} and {x} >= {d(t.rise[k - 1])}" if four else at
        next_.append(f"when {confirmed} then '{_rest(k)}'")
        level.append(f"when {confirmed} then {k}")
    for k in range(top + 1):
        at = f"{state} = '{_rest(k)}'"
        drop = f"when {at} and {x} < {d(t.clear[k - 1])}" if k else None
        rises = [f"when {at} and {c} then 'pending{j}'" for j, c in _reached(t, x, k)]
        if four:
            level.append(f"when {at} then {k}")
            next_ += rises + ([f"{drop} then '{_rest(k - 1)}'"] if drop else [])
        else:
            if drop:
                next_.append(f"{drop} then '{_rest(k - 1)}'")
                level.append(f"{drop} then {k - 1}")
            next_ += rises
            if k == 1:
                level.append(f"when {at} and {_reached(t, x, 1)[0][1]} then 1")
            else:
                level.append(f"when {at} then {k}")
    return f"case {' '.join(next_)} else {state} end", f"case {' '.join(level)} else 0 end"


# --- recursive folds -----------------------------------------------------------

def fold_sql(source: str, state: dict[str, str], stages: list[dict[str, str]], keep: str = "") -> str:
    """CTEs ending in ``r``: a walk over ``source`` in order.

    ``state`` maps a column to its first value; in a stage, ``col`` is the value
    before the row and ``n_col`` the one after, once a stage has set it.
    """
    inner = "select r.*, q.* exclude (orderid, rn) , q.rn as q_rn from r join o q on q.orderid = r.orderid and q.rn = r.rn + 1"
    for stage in stages:
        inner = f"select *, {', '.join(f'{e} as n_{n}' for n, e in stage.items())} from ({inner})"
    first = ", ".join(f"{v} as {n}" for n, v in state.items())
    after = ", ".join(f"n_{n}" for n in state)
    return f"""
o as materialized (select *, row_number() over (partition by orderid order by reltime, event_id)::bigint rn,
 from ({source})),
r as (select orderid, 0::bigint rn, null::bigint row_id, {first} from o where rn = 1
 union all select orderid, q_rn, event_id, {after} from ({inner}))"""


def smooth(name: str, x: str, keep: float) -> str:
    return f"{d(keep)} * {name} + (1 - {d(keep)}) * {x}"


ZERO = "0.0::double"
HOLD_STATE = {"hold_count": "0::bigint", "held": ZERO}
# "hold_hit" is the value that is compared: the input itself on the first row.
HOLD_STAGES = [
    {"hold_hit": "case when hold_count = 0 then temp_max else held end"},
    {"hold_count": "case when n_hold_hit = temp_max then 1 else hold_count + 1 end"},
    {"held": "case when n_hold_count > 10 then temp_max else n_hold_hit end"},
]

HEAT_SOURCE = """select *, lag(temp_avg, 1, 0.0::double) over w avg_before, lag(epoch, 1, 0) over w epoch_before
 from feat window w as (partition by orderid order by reltime, event_id)"""
HEAT_STATE = {
    **HOLD_STATE, "mc": "1::bigint", "mp": "1::bigint", "ac": "1::bigint", "ap": "1::bigint",
    "ms": ZERO, "me": ZERO, "as_": ZERO, "ae": ZERO,
}


def heat_stages() -> list[dict[str, str]]:
    keep = 0.999

    def power(slope: str, excess: str) -> str:
        return f"{slope} * 1.0e0 * 900e0 + {excess} * 15e0 * 0.01e0"

    return [
        *HOLD_STAGES,
        {"m_near": "abs(n_held - held) < 0.1e0", "a_near": "abs(temp_avg - avg_before) < 0.1e0",
         "m_gap": "epoch",
         "a_gap": "case when epoch - epoch_before <= 0 then 20 else epoch - epoch_before end"},
        {"mc": "case when n_m_near then mc + 1 else 1 end", "mp": "case when n_m_near then mp else mc end",
         "ac": "case when n_a_near then ac + 1 else 1 end", "ap": "case when n_a_near then ap else ac end"},
        {"ms": smooth("ms", "((n_held - held) / n_m_gap / n_mp)", keep),
         "me": smooth("me", "(n_held - temp_ambient)", keep),
         "as_": smooth("as_", "((temp_avg - avg_before) / n_a_gap / n_ap)", keep),
         "ae": smooth("ae", "(temp_avg - temp_ambient)", keep)},
        {"p_max": power("n_ms", "n_me"), "p_avg": power("n_as_", "n_ae")},
        {"delta_p": "n_p_max - n_p_avg"},
    ]


def _alarm_stage(name: str, t, x: str) -> dict[str, str]:
    next_, level = alarm_sql(t, f"{name}_state", x)
    return {f"{name}_state": next_, name: level}


def _alarm_state(*names: str) -> dict[str, str]:
    return {c: v for n in names for c, v in ((f"{n}_state", "'start'"), (n, "0"))}


SMOOTH_STAGE = {
    "delta_soc": smooth("delta_soc", "(soc_avg - soc_min)", 0.99),
    "drift": smooth("drift", "delta_v", 0.9),
}
SAFETY_STATE = {
    **HEAT_STATE, "delta_p": ZERO, "delta_soc": ZERO, "drift": ZERO, **_alarm_state("wp", "wsoc", "wtt", "wv", "wt"),
}
SAFETY_STAGES = [
    *heat_stages(),
    SMOOTH_STAGE,
    {**_alarm_stage("wp", WP, "n_delta_p"), **_alarm_stage("wsoc", WSOC, "n_delta_soc"),
     **_alarm_stage("wtt", WTT, "n_drift"), **_alarm_stage("wv", WV, "delta_v"),
     **_alarm_stage("wt", WT, "delta_t")},
]
FLAGS = """
flagged as (select r.*, o.reltime, o.batteryid, o.dt, o.volt_min, o.temp_id, o.temp_max,
 (wtt + wsoc + wv + wt >= 5)::int isc, (wv + wsoc >= 2)::int cap, (wt + wtt >= 2)::int heat
 from r join o on o.event_id = r.row_id),
faults as (select *, sum(isc) over w isc_total, sum(cap) over w cap_total, sum(heat) over w heat_total,
 coalesce(last_value(case when isc + cap + heat > 0 then dt end ignore nulls) over w, first_value(dt) over w) event_dt
 from flagged window w as (partition by orderid order by rn rows unbounded preceding)),
events_out as (select *, (1 + (isc_total > 0)::int) isc_ret, (1 + (cap_total > 0)::int) cap_ret,
 (1 + (heat_total > 0)::int) heat_ret from faults)"""


def _safety(select: str, features: str = FEATURES, source: str = HEAT_SOURCE) -> str:
    return (f"with recursive {features}, {fold_sql(source, SAFETY_STATE, SAFETY_STAGES)}, {FLAGS} {select}")


def _fold(features: str, source: str, state, stages, select: str) -> str:
    return f"with recursive {features}, {fold_sql(source, state, stages)} {select}"


EVENT_SELECT = """select row_id event_id, wp wp_level, reltime, orderid, isc "ISC_FAULT", cap "Cap_dep_FAULT",
 heat "Heat_gen_FAULT", batteryid, round(volt_min, 6) "MinVoltage", temp_id "TempId", round(temp_max, 6) "MaxTemp",
 round(delta_p, 6) "DeltaP", heat_ret "Heat_gen_FAULT_ret", cap_ret "Cap_dep_FAULT_ret", isc_ret "ISC_FAULT_ret",
 event_dt dt from events_out"""


# --- Kalman SOC ------------------------------------------------------------------

def grid_nodes() -> dict[str, list[float]]:
    """The nodes of all grids by the formulas of the test data, row by row; tau runs the other way along its rows."""
    def nodes(value, across) -> list[float]:
        return [value(x, y) for x in TEMPS for y in across]

    resistances = {
        "R0_C": lambda x, y: 0.002 * (1 + 0.917364813 * y ** 2) * (1 - x / 200),
        "R0_D": lambda x, y: 0.003 * (2 - 0.051736481 * y ** 2) * (1 + x ** 2 / 9000),
        "R1_C": lambda x, y: 0.001 * (1 + y + 0.817364813 * y ** 2) * (1 - x / 200),
        "R1_D": lambda x, y: 0.0015 * (1 + 0.517364813 * y ** 2) * (1 + x ** 2 / 8000),
    }
    return {
        **{f"TI2{name}": nodes(value, RATES) for name, value in resistances.items()},
        **{f"TSOC2{name}": nodes(value, SOC) for name, value in resistances.items()},
        "TSOC2tao_C": nodes(lambda x, y: 20 + 40 * y + 0.0917364813 * (x + 20) * y ** 2, SOC[::-1]),
        "TSOC2tao_D": nodes(lambda x, y: 30 + 25.17364813 * y ** 2 + x / 10, SOC[::-1]),
        "TSOC2OCV": nodes(lambda x, y: 3.2 + 0.5 * y + 0.1173648129 * y ** 2 + 0.0000053719 * x ** 2, SOC),
        "TSOC2dVdS": nodes(lambda x, y: 0.6 + 0.3173648129 * y ** 2 + 0.001 * x, SOC),
    }


def item(values, at: str) -> str:
    return f"([{', '.join(map(d, values))}])[{at}]"


def bracket(x: str, breaks) -> str:
    """Number, from 1, of the break at or before ``x``, the last one apart."""
    return f"len(list_filter([{', '.join(map(d, breaks[:-1]))}], lambda b: b <= {x}))"


def bilinear(grid: str, t: str, ti: str, y: str, yi: str) -> str:
    """Value of a grid inside its cell ``ti``, ``yi``: each corner counts by the rectangle opposite to it."""
    nodes, across = grid_nodes()[grid], RATES if grid.startswith("TI") else SOC
    x0, x1 = item(TEMPS, ti), item(TEMPS, f"{ti} + 1")
    y0, y1 = item(across, yi), item(across, f"{yi} + 1")

    def corner(i: int, j: int) -> str:
        return item(nodes, f"({ti} - 1 + {i}) * {len(across)} + {yi} + {j}")

    return (f"(({corner(0, 0)} * ({x1} - {t}) * ({y1} - {y}) + {corner(1, 0)} * ({t} - {x0}) * ({y1} - {y})"
            f" + {corner(0, 1)} * ({x1} - {t}) * ({y} - {y0}) + {corner(1, 1)} * ({t} - {x0}) * ({y} - {y0}))"
            f" / (({x1} - {x0}) * ({y1} - {y0})))")


def model_stages(p: str, temp: str, current: str, soc: str) -> list[dict[str, str]]:
    """Stages that end in ``r0``, ``r1``, ``tao``, ``ocv`` and ``dvds``; charge and discharge have tables of their own."""
    t, rate, s = f"n_{p}t", f"n_{p}rate", f"n_{p}s"

    def by_rate(name: str) -> str:
        return bilinear(f"TI2{name}", t, f"{t}i", rate, f"{rate}i")

    def by_soc(name: str) -> str:
        return bilinear(f"TSOC2{name}", t, f"{t}i", s, f"{s}i")

    def directed(value) -> str:
        return f"case when {current} > 0 then {value('C')} else {value('D')} end"

    return [
        {f"{p}t": clamp(temp, TEMPS[0], TEMPS[-1]), f"{p}rate": clamp(f"abs({current} / 150e0)", RATES[0], RATES[-1]),
         f"{p}s": clamp(soc, SOC[0], SOC[-1])},
        {f"{p}ti": bracket(t, TEMPS), f"{p}ratei": bracket(rate, RATES), f"{p}si": bracket(s, SOC)},
        {f"{p}r0": directed(lambda c: f"{by_rate(f'R0_{c}')} * {by_soc(f'R0_{c}')}"),
         f"{p}r1": directed(lambda c: f"{by_rate(f'R1_{c}')} * {by_soc(f'R1_{c}')}"),
         f"{p}tao": directed(lambda c: by_soc(f"tao_{c}")), f"{p}ocv": by_soc("OCV"), f"{p}dvds": by_soc("dVdS")},
    ]


def staged(source: str, stages: list[dict[str, str]]) -> str:
    """``source`` with the columns of each stage, named ``n_`` and the name."""
    for stage in stages:
        source = f"(select *, {', '.join(f'{e} as n_{n}' for n, e in stage.items())} from {source})"
    return source


def kalman(side: str, temp: str, volt: str) -> tuple[dict[str, str], list[dict[str, str]]]:
    p = f"{side}_"
    m, slope, spread = f"n_{p}m_", f"n_{p}m_dvds", f"n_{p}spread"
    state = {f"{p}soc": ZERO, f"{p}rows": "0", f"{p}var": ZERO, f"{p}at": "0::bigint", f"{p}u1": ZERO,
             f"{p}r1": ZERO, f"{p}i": ZERO, f"{p}result": ZERO, f"{p}model": ZERO}
    stages = [
        *model_stages(f"{p}m_", temp, "current", f"{p}soc"),
        {f"{p}elapsed": f"epoch - {p}at", f"{p}v": clamp(volt, OCV[0], OCV[-1])},
        {f"{p}gap": f"case when n_{p}elapsed > 100 or n_{p}elapsed <= 0 then 20 else n_{p}elapsed end",
         f"{p}reset": f"{p}rows <= 1 or n_{p}elapsed > 1800", f"{p}spread": f"0.01e0 + {p}var"},
        {f"{p}fade": f"exp(-n_{p}gap / 1.0e0)",
         f"{p}gain": f"{spread} * {slope} / ({slope} * {slope} * {spread} + 0.001e0) / n_{p}gap"},
        {f"{p}var": f"(1 - n_{p}gain * {slope}) * {spread}",
         f"{p}u1": f"n_{p}fade * {p}u1 + {p}r1 * {p}i * (1 - n_{p}fade)", f"{p}r1": f"{m}r1",
         f"{p}i": "current", f"{p}at": "epoch", f"{p}rows": f"{p}rows + 1", f"{p}open": soc_of(volt)},
        {f"{p}model": f"n_{p}u1 + {m}ocv + {m}r0 * current"},
        {f"{p}next": f"greatest(0.0e0, least(1.0e0, {p}soc + n_{p}gap * {p}i / 150e0 * 0.999e0 / 3600"
                     f" + n_{p}gain * (n_{p}v - n_{p}model)))"},
        {f"{p}result": f"case when n_{p}reset then n_{p}open else n_{p}next end",
         f"{p}soc": f"case when n_{p}reset then 0.995e0 * {p}soc + (1 - 0.995e0) * n_{p}open else n_{p}next end"},
    ]
    return state, stages


def _events_ekf() -> str:
    """The event job on the filtered state of charge: both recurrences in one walk."""
    avg_state, avg_stages = kalman("avg", "temp_avg", "volt_avg")
    min_state, min_stages = kalman("min", "temp_max", "volt_min")
    soc_stages = [{**a, **m} for a, m in zip(avg_stages, min_stages)]
    stages = [*soc_stages, *[
        {**s, "delta_soc": smooth("delta_soc", "(n_avg_soc - n_min_soc)", 0.99)} if "delta_soc" in s else s for s in SAFETY_STAGES]]
    return f"with recursive {FEATURES}, {fold_sql(HEAT_SOURCE, {**avg_state, **min_state, **SAFETY_STATE}, stages)}, {FLAGS} {EVENT_SELECT}"


def _events_drift() -> str:
    """The event job with the drift alarm on the temperature gap, and another heat alarm."""
    stages = [{**s, "drift": smooth("drift", "delta_t", 0.9)} if "drift" in s else s for s in SAFETY_STAGES[:-1]]
    stages.append({**SAFETY_STAGES[-1], **_alarm_stage("wp", SCALED_WP, "n_delta_p")})
    return (f"with recursive {FEATURES}, {fold_sql(HEAT_SOURCE, SAFETY_STATE, stages)}, {FLAGS} select row_id event_id,"
            " wp, wsoc, wtt, wv, wt, isc, cap, heat, isc_ret, cap_ret, heat_ret, event_dt from events_out")


def _resumed() -> str:
    """Events after the second date; rows of orders that fail in between play no part."""
    source = HEAT_SOURCE.replace("from feat", f"""from (select * from feat where not (orderid::bigint % 3 = 0
 and dt between '{catalog.RESUME_AT}' and '{catalog.SECOND_END}' and exists (select 1 from tel t
 where t.orderid = feat.orderid and t.dt between '{catalog.RESUME_AT}' and '{catalog.SECOND_END}'
 and t.cell_min_volt is not null and t.cell_max_tem is not null)))""")
    return _safety(EVENT_SELECT + f" where reltime::date > '{catalog.SECOND_END}'", source=source)


def _soc_ekf() -> str:
    avg_state, avg_stages = kalman("avg", "temp_avg", "volt_avg")
    min_state, min_stages = kalman("min", "temp_max", "volt_min")
    stages = [{**a, **m} for a, m in zip(avg_stages, min_stages)]
    columns = ", ".join(
        f"round({side}_{part}, 6) ekf_{side}{name}"
        for side in ("avg", "min") for part, name in (("result", ""), ("model", "_model"), ("soc", "_carried")))
    return _fold(FEATURES, "select * from feat", {**avg_state, **min_state}, stages,
                 f"select row_id event_id, {columns} from r where row_id is not null")


def _text(stamp: str, fraction: str = "") -> str:
    return f"strftime(reltime, '%Y-%m-%d %H:%M:%S{fraction}')"


VALUES = "vals as (select event_id, user_id::varchar orderid, ts reltime, value from events)"

BROKEN = FEATURES.replace("from tel where", """from (select * exclude (orderid, cell_max_volt, reltime, bcs_currentmeasure),
  case when event_id % 503 <> 0 then orderid end orderid,
  case when event_id % 491 <> 0 then cell_max_volt end cell_max_volt, reltime,
  case when event_id % 487 <> 0 then bcs_currentmeasure end bcs_currentmeasure,
  case when event_id % 499 <> 0 then reltime end usable from tel) where""")
ROW_ERROR = """case when cell_max_volt is null then 'cell_max_volt unreadable'
 when bcs_currentmeasure is null then 'bcs_currentmeasure unreadable'
 when usable is null then 'reltime unreadable' end"""

INTERP_X = "(event_id % 170) / 100::double + 2.8e0"
PLANE_X, PLANE_Y = "(bcs_currentmeasure + 20)", "((event_id % 23) / 20::double - 0.05e0)"
TIME_TEXT = f"""case when event_id % 11 = 0 or event_id % 13 = 0 or event_id % 17 = 0 then null
 else floor(epoch(reltime))::bigint end"""


def statements() -> dict[str, str]:
    """SQL per query name; queries without an entry have no SQL form."""
    tel = f"with {TELEMETRY}"
    arrays = f"{tel}, {ARRAYS}"
    feat = f"with {FEATURES}"
    digits = {"r0": 12, "r1": 12, "tao": 6, "ocv": 6, "dvds": 6}
    scan_lo, scan_hi = catalog.RANGE
    cells_text = """case when event_id % 29 = 0 then '[3.1, x]' when event_id % 31 = 0 then ''
 when event_id % 37 = 0 then '[[1],2]' when event_id % 41 = 0 then ' [3.4 , ,3.5]'
 when event_id % 43 = 0 then '[3.4d, 3.5]' else bmv_singlevolt end"""
    nodes = grid_nodes()
    order = "(partition by orderid order by reltime, event_id)"
    four_next, four_level = alarm_sql(VALUE_LEVELS, "level_state", "value")
    current = "case when current > 0 then 1 else -1 end"
    return {
        "scan_date_range": f"{tel} select event_id, orderid, dt, cell_min_volt from tel "
                           f"where dt between '{scan_lo}' and '{scan_hi}'",
        "grid_load": "select event_id, " + ", ".join(
            f"round(([{', '.join(map(d, z))}])[event_id % {len(z)} + 1], 9) {name.lower()}" for name, z in nodes.items()) + " from events",
        "cast_double": f"""{tel} select event_id,
 try_cast(case when event_id % 19 = 0 then 'n/a' when event_id % 23 = 0 then '[3.4]'
  else cell_min_volt::varchar end as double) cell_min_volt,
 try_cast(case when event_id % 29 = 0 then '' else cell_max_tem::varchar end as double) cell_max_tem from tel""",
        "null_skip": f"{tel} select event_id, cell_min_volt, cell_max_tem from tel "
                     "where cell_min_volt is not null and cell_max_tem is not null",
        "parse_cells": f"""{tel}, given as (select event_id, {cells_text} txt from tel),
 lists as (select event_id, {parse('txt')} cells from given)
 select event_id, coalesce(len(cells), -1)::int n_cells, {joined('cells', 4)} cells from lists""",
        "scalar_or_list": f"""{tel}, given as (select event_id, event_id % 5 = 0 v, event_id % 7 = 0 t,
  {parse('bmv_singlevolt')} cells, {parse('bmt_singletemp')} temps, cell_max_volt, cell_min_tem from tel)
 select event_id, case when v then list_max(cells) else cell_max_volt end pack_max_volt,
  case when t then list_min(temps) else cell_min_tem end pack_min_tem, cell_max_volt plain_max_volt from given""",
        "clean_cells": f"{arrays} select event_id, len(volts)::int n_cells, {joined('volts', 4)} cells from arrays",
        "arg_extremes": f"""{arrays} select event_id, list_min(volts) low_volt,
 (list_position(volts, list_min(volts)) - 1)::bigint low_index, list_max(temps) high_temp,
 (list_position(temps, list_max(temps)) - 1)::bigint high_index from arrays""",
        "leave_one_out_mean": f"{arrays} select event_id, round({REST_VOLT}, 6) rest_volt,"
                              f" round({REST_TEMP}, 6) rest_temp from arrays",
        "pack_features": f"""{tel} select event_id,
 round(cell_max_volt - 2 * (cell_max_volt - cell_min_volt), 6) volt_min, round(cell_min_volt, 6) volt_avg,
 round(cell_max_tem, 6) temp_max, round((cell_max_tem + cell_min_tem) / 2, 6) temp_avg,
 round(cell_min_tem, 6) temp_ambient, 1::bigint temp_id from tel
 where cell_min_volt is not null and cell_max_tem is not null""",
        "parse_time": f"{tel} select event_id, {TIME_TEXT} epoch from tel",
        "parse_time_list": f"""{tel} select event_id,
 (case when event_id % 5 = 0 then 2 when event_id % 7 = 0 then 1 when event_id % 11 = 0 then -1 else 1 end)::int n_times,
 case when event_id % 5 = 0 then concat(moment, ',', moment) when event_id % 7 <> 0 and event_id % 11 = 0 then null
  else moment end epochs from (select event_id, floor(epoch(reltime))::bigint::varchar moment from tel)""",
        "features": f"{feat} select event_id, orderid, epoch, pack_only, temp_id, "
                    + ", ".join(f"round({c}, 6) {c}" for c in catalog.FEATURE_COLUMNS) + " from feat",
        "crate_sign": f"{feat} select event_id, round(abs(current / 150e0), 6) crate, {current} direction from feat",
        "interp_1d": f"{tel} select event_id, round({curve(f'({INTERP_X})', OCV, SOC)}, 6) y from tel",
        "interp_2d": f"{tel} select event_id, round({bilinear('TSOC2R0_C', 'n_t', 'n_ti', 'n_s', 'n_si')}, 9) r0,"
                     f" round({bilinear('TSOC2OCV', 'n_t', 'n_ti', 'n_s', 'n_si')}, 6) ocv from " + staged("tel", [
                         {"t": clamp(PLANE_X, TEMPS[0], TEMPS[-1]), "s": clamp(PLANE_Y, SOC[0], SOC[-1])},
                         {"ti": bracket("n_t", TEMPS), "si": bracket("n_s", SOC)}]),
        "soc_ocv": f"{feat} select event_id, round(soc_avg, 6) soc_avg, round(soc_min, 6) soc_min from feat",
        "lookup_params": f"{feat} select event_id, {', '.join(f'round(n_{n}, {k}) {n}' for n, k in digits.items())} from "
                         + staged("feat", model_stages("", "temp_avg", "current", "soc_avg")),
        "order_row_number": f"{tel} select event_id, orderid, (row_number() over {order})::int \"row_number\" from tel",
        "gap_seconds": f"""{feat}, g as (select event_id, epoch - lag(epoch, 1, 0) over {order} gap from feat)
 select event_id, case when gap > 100 or gap <= 0 then 20 else gap end soc_gap,
 case when gap <= 0 then 20 else gap end heat_gap from g""",
        "run_length": f"""{feat},
 a as (select *, case when abs(temp_max - lag(temp_max, 1, 0e0) over {order}) < 0.1e0 then 0 else 1 end ch from feat),
 b as (select *, sum(ch) over {order} isl from a),
 c as (select *, row_number() over (partition by orderid, isl order by reltime, event_id)
   + case when isl = 0 then 1 else 0 end counter from b),
 e as (select *, case when ch = 1 then coalesce(lag(counter) over {order}, 1) end pc from c)
 select event_id, counter::int counter, coalesce(last_value(pc ignore nulls) over
  (partition by orderid order by reltime, event_id rows unbounded preceding), 1)::int counter_delay from e""",
        "running_faults": _safety("select row_id event_id, isc_total::bigint isc_total, cap_total::bigint cap_total,"
                                  " heat_total::bigint heat_total from events_out"),
        "fault_ret": _safety("select row_id event_id, isc_ret, cap_ret, heat_ret from events_out"),
        "last_fault_dt": _safety("select row_id event_id, event_dt from events_out"),
        "distinct_orders": f"{tel} select distinct orderid from tel",
        "fault_rate": _safety("""select orderid, "rows", round(isc / "rows", 6) isc_rate, round(cap / "rows", 6) cap_rate,
 round(heat / "rows", 6) heat_rate from (select orderid, sum(isc)::double isc, sum(cap)::double cap,
  sum(heat)::double heat from flagged group by orderid) join
 (select orderid, count(*) "rows" from tel group by orderid) using (orderid)"""),
        "running_fault_rate": _safety("""select row_id event_id, round(isc_total::double / "rows", 9) isc_rate,
 round(cap_total::double / "rows", 9) cap_rate, round(heat_total::double / "rows", 9) heat_rate from events_out join
 (select orderid, count(*) "rows" from tel group by orderid) using (orderid)"""),
        "ewma": _fold(VALUES, "select * from vals", {"smooth": ZERO},
                      [{"smooth": smooth("smooth", "value", catalog.VALUE_DECAY)}],
                      "select row_id event_id, floor(smooth * 1e6 + 0.5e0) / 1e6 smooth from r where row_id is not null"),
        "ewma_delta": _fold(FEATURES, "select * from feat", {"delta_soc": ZERO, "drift": ZERO}, [SMOOTH_STAGE],
                            "select row_id event_id, round(delta_soc, 6) delta_soc, round(drift, 6) drift"
                            " from r where row_id is not null"),
        "temp_hold": _fold(FEATURES, "select * from feat", HOLD_STATE, HOLD_STAGES,
                           "select row_id event_id, held from r where row_id is not null"),
        "heat_power": _fold(FEATURES, HEAT_SOURCE, {**HEAT_STATE, "p_max": ZERO, "p_avg": ZERO, "delta_p": ZERO},
                            heat_stages(),
                            "select row_id event_id, round(p_max, 6) p_max, round(p_avg, 6) p_avg,"
                            " round(delta_p, 6) delta_p from r where row_id is not null"),
        "soc_ekf": _soc_ekf(),
        "alarm_four_level": _fold(VALUES, "select * from vals", {"level_state": "'start'", "level": "0"},
                                  [{"level_state": four_next, "level": four_level}],
                                  "select row_id event_id, level, level_state from r where row_id is not null"),
        "alarm_two_level": _fold(FEATURES, "select * from feat", _alarm_state("wv", "wt"),
                                 [{**_alarm_stage("wv", WV, "delta_v"),
                                   **_alarm_stage("wt", WT, "delta_t")}],
                                 "select row_id event_id, wv, wv_state, wt, wt_state from r where row_id is not null"),
        "fault_flags": _safety("select row_id event_id, wsoc, wtt, wv, wt, isc, cap, heat from flagged"),
        "event_output": _safety(EVENT_SELECT),
        "event_output_cut": _safety(EVENT_SELECT),
        "event_output_ekf": _events_ekf(),
        "event_output_drift": _events_drift(),
        "resume_after_failure": _resumed(),
        "failed_orders": f"with {BROKEN}, told as (select orderid, case when orderid is null then 'orderid missing'"
                         f" else {ROW_ERROR} end error from feat)"
                         " select orderid, min(error) error from told where error is not null group by orderid",
        "surviving_events": _safety(
            'select orderid, count(*) "rows", sum(cap)::bigint cap_total from flagged group by orderid',
            features=BROKEN + f", sound as (select * from feat f where orderid is not null and not exists (select 1 from feat b"
                              f" where b.orderid = f.orderid and {ROW_ERROR.replace('cell_max', 'b.cell_max').replace('when bcs', 'when b.bcs').replace('usable', 'b.usable')} is not null))",
            source=HEAT_SOURCE.replace("from feat", "from sound")),
        "resume_equals_full": _safety(EVENT_SELECT),
        "stream_equals_batch": _safety(EVENT_SELECT),
        "stream_of_late_rows": _safety(EVENT_SELECT),
        "stream_from_batch": _safety(EVENT_SELECT),
        "sink_roundtrip": _safety('select dt "day", count(*) "rows", count(distinct row_id) events,'
                                  " sum(cap)::bigint cap_total from flagged group by 1"),
    }
