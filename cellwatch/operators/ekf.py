"""State of charge by an extended Kalman filter over one order's rows."""

from __future__ import annotations

from bisect import bisect_right
from math import exp

import numpy as np

from ..config import COULOMB_EFFICIENCY, Cell, DEFAULT_GAP, EKF_RESET_GAP, EKF_SETTLE, SOC_MAX_GAP
from ..sources.grids import Grids
from .scans import Scan


def _between(x: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left break index and share of the interval, at the edges clamped."""
    x = np.clip(x, breaks[0], breaks[-1])
    left = np.clip(np.searchsorted(breaks, x, side="right") - 1, 0, len(breaks) - 2)
    return left, (x - breaks[left]) / (breaks[left + 1] - breaks[left])


def _blend(grid: np.ndarray, left: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Rows of ``grid`` interpolated along its first axis."""
    return grid[left] * (1 - share)[:, None] + grid[left + 1] * share[:, None]


class KalmanSoc(Scan):
    """Filtered state of charge and modelled voltage.

    Inputs are temperature, voltage, current and epoch seconds.  Temperature
    and current are known up front, so their lookups are done for all rows at
    once; only the lookup along the state of charge is left to the row loop.

    The recurrence is not linear in its state, so no fixed-size summary
    exists.  It forgets where it started, though, and the fold makes use of
    that when it has to cut an order.
    """

    summarizes = False

    def __init__(self, name: str, temp: str, volt: str, current: str, epoch: str, grids: Grids, cell: Cell):
        super().__init__(name, temp, volt, current, epoch)
        self.grids = grids
        self.cell = cell

    @property
    def outputs(self):
        return (self.name, f"{self.name}_model", f"{self.name}_carried")

    def initial(self):
        return {"soc": 0.0, "rows": 0, "variance": 0.0, "epoch": 0.0, "tao": 1.0,
                "u1": 0.0, "r1": 0.0, "current": 0.0}

    def _profiles(self, temp, current):
        """Per row, the cell model's values at every SOC break."""
        g = self.grids
        t_left, t_share = _between(temp, np.asarray(g.temp))
        r_left, r_share = _between(np.abs(current / self.cell.capacity), np.asarray(g.rate))
        rows = np.arange(len(temp))

        def along_soc(name):
            return _blend(g.tables[name], t_left, t_share)

        def at_rate(name):
            by_rate = _blend(g.tables[name], t_left, t_share)
            return by_rate[rows, r_left] * (1 - r_share) + by_rate[rows, r_left + 1] * r_share

        charging = (current > 0)[:, None]

        def directed(build):
            return np.where(charging, build("C"), build("D"))

        return [p.tolist() for p in (
            directed(lambda d: at_rate(f"TI2R0_{d}")[:, None] * along_soc(f"TSOC2R0_{d}")),
            directed(lambda d: at_rate(f"TI2R1_{d}")[:, None] * along_soc(f"TSOC2R1_{d}")),
            directed(lambda d: along_soc(f"TSOC2tao_{d}")),
            along_soc("TSOC2OCV"),
            along_soc("TSOC2dVdS"),
        )]

    def run(self, cols, state):
        temp, volt, current, epoch = (np.asarray(cols[c], dtype=float) for c in self.inputs)
        g, cell = self.grids, self.cell
        breaks = list(g.soc)
        clamped = np.clip(volt, min(g.ocv), max(g.ocv))
        looked_up = self._soc_of(clamped)
        soc, rows, variance = state["soc"], state["rows"], state["variance"]
        before, tao, u1 = state["epoch"], state["tao"], state["u1"]
        r1_before, i_before = state["r1"], state["current"]
        socs, models, carried = [], [], []
        for now, v, i, opened, r0s, r1s, taos, ocvs, slopes in zip(
            epoch.tolist(), clamped.tolist(), current.tolist(), looked_up.tolist(),
            *self._profiles(temp, current),
        ):
            inside = min(max(soc, breaks[0]), breaks[-1])
            at = min(max(bisect_right(breaks, inside) - 1, 0), len(breaks) - 2)
            share = (inside - breaks[at]) / (breaks[at + 1] - breaks[at])
            r0, r1, tao_now, ocv, slope = (
                p[at] * (1 - share) + p[at + 1] * share for p in (r0s, r1s, taos, ocvs, slopes))
            elapsed = now - before
            gap = elapsed if 0 < elapsed <= SOC_MAX_GAP else DEFAULT_GAP
            reset = rows <= 1 or elapsed > EKF_RESET_GAP
            before, rows = now, min(rows + 1, 2)
            if tao != 0:
                fade = exp(-gap / tao)
            else:
                fade, tao = 1.0, tao_now
            spread = cell.process_noise + variance
            gain = spread * slope / (slope * slope * spread + cell.measure_noise) / gap
            variance = (1 - gain * slope) * spread
            u1 = fade * u1 + r1_before * i_before * (1 - fade)
            r1_before = r1 / cell.series
            model = u1 + ocv + r0 * i
            counted = soc + gap * i_before / cell.capacity * COULOMB_EFFICIENCY / 3600
            i_before = i
            if reset:
                result = opened
                soc = EKF_SETTLE * soc + (1 - EKF_SETTLE) * opened
            else:
                result = soc = min(max(counted + gain * (v - model), 0.0), 1.0)
            socs.append(result)
            models.append(model)
            carried.append(soc)
        out = {self.name: np.array(socs), f"{self.name}_model": np.array(models),
               f"{self.name}_carried": np.array(carried)}
        return out, {"soc": soc, "rows": rows, "variance": variance, "epoch": before, "tao": tao,
                     "u1": u1, "r1": r1_before, "current": i_before}

    def _soc_of(self, volt: np.ndarray) -> np.ndarray:
        """Open-circuit voltage to state of charge; ``volt`` is inside the curve or NaN."""
        x, y = np.asarray(self.grids.ocv), np.asarray(self.grids.soc)
        left = np.clip(np.searchsorted(x, volt, side="right") - 1, 0, len(x) - 2)
        return y[left] + (volt - x[left]) * (y[left + 1] - y[left]) / (x[left + 1] - x[left])

    def guess(self):
        """A plausible state in mid-order, where a cut segment starts its first trial."""
        return {**self.initial(), "soc": 0.5, "rows": 2}
