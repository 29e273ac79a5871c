"""Ordering features of many tracks of one size at once, on numpy arrays: what a search scores its orders by.

The same quantities as :mod:`hitloom.operators.features` has as columns, for tracks that don't exist as rows.
"""

from __future__ import annotations

import re

import numpy as np

from hitloom.functions import geometry as G, physics as P
from hitloom.functions.arrays import material_way

_RESIDUAL = re.compile(r"(rsg|rsl|rlg|rc_cap|rc|rth_cap|rth)_(sum|mean|norm|wmean)_([12])(v?)(_first|_penalty_removed)?")
_RANGE = re.compile(r"(-log_)?(cross|p|klein-nishina)_(.+?)_((?:sum|mean|max|min)(?:_nonfinal)?|final)")


def attenuations(e: np.ndarray) -> dict[str, np.ndarray]:
    """Attenuation in 1/cm by absorption, Compton scattering, pairs, and in all."""
    with np.errstate(all="ignore"):
        x = np.log(e * 1e6)
        a, b, c, d, f = P.ABSORPTION_FIT
        out = {"abs": np.exp(a * np.log1p(np.exp(b * (x - c))) + d * x + f)}
        a, b, c, d, f = P.COMPTON_FIT
        out["compt"] = np.exp(a * np.exp(b * (x - c)) + d * x + f)
        a, b, c = P.PAIR_FIT
        ev = e * 1e6
        out["pair"] = np.where(ev > P.PAIR_THRESHOLD_EV, np.exp(a * x**2 + b * x + c) * (ev * (ev - P.PAIR_THRESHOLD_EV)) ** 3, 0.0)
    out = {k: v * (P.RANGE / P.BARN) for k, v in out.items()}
    return out | {"total": out["abs"] + out["compt"] + out["pair"]}


class Tracks:
    """Hits ``x`` (..., m, 3), ``e`` (..., m) in order, energy of the ray ``start`` (...), and what follows from the order.

    Arrays of turns have m - 1 places. ``tango``: the start is raised to the estimate from the turns where that is larger.
    """

    def __init__(self, x: np.ndarray, e: np.ndarray, start: np.ndarray, inner: float, model: str = "default", eres: float = 1e-3, tango: bool = False):
        self.x, self.e, self.m = x, e, e.shape[-1]
        m = self.m
        with np.errstate(all="ignore"):
            prev = np.concatenate([np.zeros_like(x[..., :1, :]), x[..., :-1, :]], -2)
            step = x - prev
            self.way = np.sqrt((step**2).sum(-1))
            self.shell = material_way(prev, x, inner)
            ab, bc = (np.where(w > 0, w, 1.0) for w in (self.way[..., :-1], self.way[..., 1:]))
            moved = (self.way[..., :-1] > 0) & (self.way[..., 1:] > 0)
            self.cos = np.where(moved, np.clip((step[..., :-1, :] * step[..., 1:, :]).sum(-1) / (ab * bc), -1, 1), -1.0)
            w0, w1 = G.POSITION_ERROR[model]
            s = np.where(e > 0, w0 + w1 * np.sqrt(0.1 / np.where(e > 0, e, 1)), w0)
            sa = np.concatenate([np.full_like(s[..., :1], w0), s[..., :-1]], -1)[..., :-1]
            sb, sc = s[..., :-1], s[..., 1:]
            spread = (sa**2 + sb**2) / ab**2 + 2 * sb**2 * self.cos / (ab * bc) + (sb**2 + sc**2) / bc**2
            self.cos_err = np.sqrt((1 - self.cos**2) * spread)
            omc, dep = 1 - self.cos, e[..., :-1]
            self.omc = omc
            o = np.where(omc > 0, omc, np.nan)
            root = np.sqrt(dep**2 / 4 + dep * P.MEC2 / o)
            fill = lambda v: np.where(omc > 0, v, P.FILL)
            self.local, self.d_e, self.d_cos = fill(dep / 2 + root), fill(0.5 + (dep / 4 + P.MEC2 / o / 2) / root), fill(dep * P.MEC2 / (2 * root * o**2))
            self.local_sigma = np.sqrt((eres * self.d_e) ** 2 + (self.cos_err * self.d_cos) ** 2)
            before = np.cumsum(e, -1) - e
            if tango and m > 1:
                weight = 1 / (self.local_sigma + eres * np.sqrt(np.arange(1, m)))
                estimate = ((before[..., :-1] + self.local) * weight).sum(-1) / weight.sum(-1)
                start = np.where(estimate > start, estimate, start)
            self.start = start
            self.energy = start[..., None] - before
            ei = self.energy[..., :-1]
            eo = ei - dep
            self.after = eo
            g = ei / (1 + ei / P.MEC2 * omc)
            left = m - np.arange(m - 1)
            theory = 1 + P.MEC2 / np.where(ei > 0, ei, np.nan) - P.MEC2 / np.where(eo > 0, eo, np.nan)
            capped = np.maximum(theory, -1)
            share, share2 = g / ei, g / np.where(eo != 0, eo, np.nan)
            self.penalty = np.where(np.isnan(theory), np.nan, (theory < -1).astype(float))
            self.beyond = np.where(np.isnan(theory), np.nan, np.maximum(0, -1 - theory))
            theory_err = eres * (P.MEC2 * eres * np.sqrt(1 / ei**4 + (left - 1) * (1 / eo**2 - 1 / ei**2)))
            angle = np.arccos(self.cos)
            fix = lambda v: np.where(np.isnan(v), 2 * np.pi, np.abs(v))
            rth_sigma = np.sqrt((self.cos_err / np.sqrt(np.where(self.cos**2 < 1, 1 - self.cos**2, np.nan))) ** 2 + (theory_err / np.sqrt(np.abs(1 - theory**2))) ** 2)
            rc_sigma = np.sqrt(self.cos_err**2 + theory_err**2)
            rsg_sigma = np.sqrt(eres**2 * (share**4 + left * (1 - share**2) ** 2) + (self.cos_err * g**2 / P.MEC2) ** 2)
            rsl_sigma = np.sqrt(eres**2 * ((1 - self.d_e) ** 2 + left - 1) + (self.cos_err * self.d_cos) ** 2)
            rlg_sigma = np.sqrt(eres**2 * ((self.d_e - 1 - share2**2) ** 2 + left * share2**4) + self.cos_err**2 * (self.d_cos - g**2 / P.MEC2) ** 2)
            plain = np.where((ei > 0) & (eo > 0) & (ei > eo), np.arccos(theory), 0.0)
            self.residuals = {
                "rsg": (np.abs(eo - g), rsg_sigma), "rsl": (np.abs(ei - self.local), rsl_sigma), "rlg": (np.abs(self.local - dep - g), rlg_sigma),
                "rc": (np.abs(self.cos - theory), rc_sigma), "rc_cap": (np.abs(self.cos - capped), rc_sigma),
                "rth": (fix(angle - plain), rth_sigma), "rth_cap": (fix(angle - np.arccos(capped)), rth_sigma),
            }
            self.mu = attenuations(self.energy)

    def _residual(self, name: str, stat: str, power: int, scaled: bool, which: str) -> np.ndarray:
        r, s = self.residuals[name]
        keep = 1 - self.penalty if which == "_penalty_removed" else 1.0
        if stat == "wmean":
            if which == "_first":
                return r[..., 0] ** power
            out = np.nansum((r / s) ** power * keep, -1) / np.nansum(keep / s**power, -1)
            return np.where(np.nansum(keep, -1) < 1, 0.0, out) if which else out
        v = r / s if scaled else r
        if which == "_first":
            return v[..., 0] ** power / (self.m - 1 if stat == "mean" else 1)
        if stat == "norm":
            return np.sqrt(np.nansum(v**2, -1)) / self.m
        return np.nansum(v**power * keep, -1) / (self.m - 1 if stat == "mean" else 1)

    def _along(self, log: bool, kind: str, what: str) -> np.ndarray:
        if kind == "cross":
            name, _, by = what.partition("_")
            return self.mu[name] * {"": 1.0, "dist": self.way, "ge_dist": self.shell}[by]
        if kind == "p":
            v = self.mu[what] / self.mu["total"]
        else:
            ratio = self.after / self.energy[..., :-1] if what.endswith("sum") else 1 / (1 + self.energy[..., :-1] / P.MEC2 * self.omc)
            sin2 = self.omc * (2 - self.omc)
            v = np.pi * P.R_0**2 * ratio * (1 + ratio * (ratio - sin2)) * np.sqrt(np.maximum(sin2, 0))
            v = v / (self.mu["compt"][..., :-1] / P.RANGE) if what.startswith("rel_") else v * P.RANGE
        return -np.log(np.where(v > 0, v, np.nan)) if log else v

    def feature(self, name: str) -> np.ndarray:
        """One feature by its name; NaN where it isn't defined."""
        with np.errstate(all="ignore"):
            if f := _RESIDUAL.fullmatch(name):
                return self._residual(f[1], f[2], int(f[3]), bool(f[4]), f[5] or "")
            if f := _RANGE.fullmatch(name):
                v, stat = self._along(bool(f[1]), f[2], f[3]), f[4]
                if stat == "final":
                    return v[..., -1]
                if stat.endswith("_nonfinal"):
                    v, stat = v[..., : self.m - 1], stat.removesuffix("_nonfinal")
                none = np.isnan(v).all(-1)
                v = {"sum": np.nansum, "mean": lambda a, i: np.nansum(a, i) / (~np.isnan(a)).sum(i), "max": np.fmax.reduce, "min": np.fmin.reduce}[stat](v, -1)
                return np.where(none, np.nan, v)
            if name.startswith("c_penalty_"):
                v = self.beyond if "ell" in name else self.penalty
                v = v ** int(name[-1])
                return np.nansum(v, -1) if "sum" in name else np.nansum(v, -1) / (~np.isnan(v)).sum(-1)
            if f := re.fullmatch(r"(ge_)?distances_(sum|mean)", name):
                return getattr(self.shell if f[1] else self.way, f[2])(-1)
            radius = np.sqrt((self.x**2).sum(-1))
            weight = 1 / self.local_sigma**2
            return {
                "first_r": lambda: radius[..., 0], "final_r": lambda: radius[..., -1], "first_energy_ratio": lambda: self.e[..., 0] / self.e.sum(-1),
                "final_energy_ratio": lambda: self.e[..., -2] / (self.e[..., -2] + self.e[..., -1]),
                "first_is_not_largest": lambda: (self.e.max(-1) > self.e[..., 0]).astype(float), "first_is_not_closest": lambda: (radius.min(-1) < radius[..., 0]).astype(float),
                "tango_variance": lambda: self.local.var(-1), "tango_sigma": lambda: self.local.std(-1), "tango_v_variance": lambda: 1 / weight.sum(-1), "tango_v_sigma": lambda: np.sqrt(1 / weight.sum(-1)),
            }[name]()


def weighted(x: np.ndarray, e: np.ndarray, start: np.ndarray, weights: dict[str, float], inner: float, model: str = "default", eres: float = 1e-3) -> np.ndarray:
    """Weighted sum of features of every order; a feature that isn't defined counts as 0, one of the suffix ``_tango`` is taken at that start."""
    out = np.zeros(e.shape[:-1])
    for tango in (False, True):
        own = {k.removesuffix("_tango"): w for k, w in weights.items() if k.endswith("_tango") == tango and w}
        if own:
            t = Tracks(x, e, start, inner, model, eres, tango)
            for k, w in own.items():
                out = out + w * np.nan_to_num(t.feature(k), nan=0.0, posinf=0.0, neginf=0.0)
    return out
