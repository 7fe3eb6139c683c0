"""Parameters of the safety pipeline: cell constants, alarm thresholds, switches."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class FourLevel:
    """Thresholds of a four-level alarm; index 0 belongs to level 1.

    ``rise`` opens a pending level, ``settle`` abandons it, ``clear`` leaves a
    level that was reached.  ``debounce_rows`` is how many rows a pending level
    waits before a row may confirm it.
    """

    rise: tuple[float, ...]
    settle: tuple[float, ...]
    clear: tuple[float, ...]
    debounce_rows: int = 0


@dataclass(frozen=True)
class TwoLevel:
    """Thresholds of a two-level alarm, named as in :class:`FourLevel`.

    ``sticky`` keeps reporting level 1 while the alarm stays there; without it
    a row that changes nothing at level 1 reports 0.
    """

    rise: tuple[float, float]
    settle: tuple[float, float]
    clear: tuple[float, float]
    debounce_rows: int = 0
    sticky: bool = False


@dataclass(frozen=True)
class Cell:
    """Cell constants.  Fixed values: they decide results."""

    mass: float = 1.0
    heat_capacity: float = 900.0
    convection: float = 15.0
    area: float = 0.01
    heat_decay: float = 0.999
    capacity: float = 150.0
    process_noise: float = 0.01
    measure_noise: float = 0.001
    series: int = 1


# Alarm thresholds.
HEAT_OFFSET = 0.5
HEAT_ALARM = FourLevel(
    rise=(0.53 + HEAT_OFFSET, 0.73 + HEAT_OFFSET, 0.93 + HEAT_OFFSET, 1.13 + HEAT_OFFSET),
    settle=(0.43 + HEAT_OFFSET, 0.63 + HEAT_OFFSET, 0.83 + HEAT_OFFSET, 1.03 + HEAT_OFFSET),
    clear=(0.35 + HEAT_OFFSET, 0.55 + HEAT_OFFSET, 0.75 + HEAT_OFFSET, 0.95 + HEAT_OFFSET),
)
SOC_ALARM = FourLevel(
    rise=(0.066, 0.106, 0.146, 0.186),
    settle=(0.056, 0.096, 0.136, 0.176),
    clear=(0.046, 0.086, 0.126, 0.166),
)
DRIFT_ALARM = FourLevel(
    rise=(7.0, 11.0, 15.0, 19.0),
    settle=(6.0, 10.0, 14.0, 18.0),
    clear=(5.0, 9.0, 13.0, 17.0),
)
VOLT_ALARM = TwoLevel(rise=(0.07, 0.12), settle=(0.05, 0.1), clear=(0.03, 0.08))
TEMP_ALARM = TwoLevel(rise=(8.0, 12.0), settle=(7.0, 11.0), clear=(6.0, 10.0))

# The nominal waits, in rows, of the alarms above.
NOMINAL_DEBOUNCE = {"wp": 5, "wsoc": 5, "wv": 5, "wt": 5, "wtt": 3}

# Fixed values of the pipeline.
LOW_CELL_VOLT = 3.35
SOC_DECAY = 0.99
VOLT_DECAY = 0.9
NEAR_EQUAL_TEMP = 0.1
SPIKE_ROWS = 10
DEFAULT_GAP = 20
SOC_MAX_GAP = 100
EKF_RESET_GAP = 1800
COULOMB_EFFICIENCY = 0.999
EKF_SETTLE = 0.995
ISC_LEVELS = 5
PAIR_LEVELS = 2


@dataclass(frozen=True)
class Config:
    """Everything a run can be told.  Use :func:`dataclasses.replace` to override.

    Switches (defaults keep the established results):
      * ``fix_pmax_time``: the heat power of the hottest cell measures its gap
        from the previous row instead of from the epoch.
      * ``wtt_input``: ``"delta_v"`` (smoothed voltage gap) or ``"delta_t"``.
      * ``soc_method``: ``"ocv"`` (open-circuit lookup) or ``"ekf"``.
      * ``debounce_rows`` and ``sticky`` on the alarms, see :meth:`debounced`.
    """

    cell: Cell = field(default_factory=Cell)
    wp: FourLevel = HEAT_ALARM
    wsoc: FourLevel = SOC_ALARM
    wtt: FourLevel = DRIFT_ALARM
    wv: TwoLevel = VOLT_ALARM
    wt: TwoLevel = TEMP_ALARM
    fix_pmax_time: bool = False
    wtt_input: str = "delta_v"
    soc_method: str = "ocv"

    def debounced(self) -> "Config":
        """The same configuration with the nominal debounce waits in force."""
        waits = {
            name: replace(getattr(self, name), debounce_rows=rows)
            for name, rows in NOMINAL_DEBOUNCE.items()
        }
        return replace(self, **waits)

    @staticmethod
    def of(values: dict) -> "Config":
        """The defaults with some fields given; parts of ``cell`` and of the alarms may be left out.

        Example: ``{"soc_method": "ekf", "wp": {"debounce_rows": 5}, "debounced": true}``.
        """
        config = Config()
        values = dict(values)
        if values.pop("debounced", False):
            config = config.debounced()
        for name, value in values.items():
            if not hasattr(config, name):
                raise ValueError(f"no parameter {name!r}")
            if isinstance(value, dict):
                lists = {k: tuple(v) if isinstance(v, list) else v for k, v in value.items()}
                value = replace(getattr(config, name), **lists)
            config = replace(config, **{name: value})
        return config

    def __post_init__(self) -> None:
        if self.wtt_input not in ("delta_v", "delta_t"):
            raise ValueError(f"wtt_input must be delta_v or delta_t, not {self.wtt_input!r}")
        if self.soc_method not in ("ocv", "ekf"):
            raise ValueError(f"soc_method must be ocv or ekf, not {self.soc_method!r}")
