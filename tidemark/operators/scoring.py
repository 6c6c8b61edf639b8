"""Scores of mined rules: the generations' formulas, style scores, filters.

``train``, ``sel`` and ``fin`` are metric dicts of search.metrics(), ``mon`` one of
search.month_stats(), ``fw`` one of search.forward_summary(). What isn't finite is 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.search import Found, _z, lcb


def break_even(target: float = 10.0, stop: float = -6.0) -> float:
    """The precision at which gains and losses cancel."""
    return abs(stop) / (target + abs(stop))


def sampling_discount(p: float, n: float, least: float = 0.55) -> bool:
    """Whether a rate less 1 / sqrt(n) still reaches ``least``."""
    return n > 0 and p - 1 / math.sqrt(n) >= least


def precision_score(train: dict, sel: dict, mon: dict, weight: float = 6.0) -> float:
    """The earlier final score: precision and stability without returns."""
    p = _z(sel["precision"])
    gap = abs(_z(train["precision"]) - p)
    good = 140 * p + 80 * _z(sel["lcb"]) + 25 * _z(sel["lift"]) + 70 * _z(mon["mp"]) + 55 * _z(mon["mnp"]) + 70 * mon["pass"] + 20 * _z(train["precision"])
    return good + weight * math.log1p(sel["n"]) + 120 * max(0, p - 0.65) + 250 * max(0, p - 0.7) - 90 * gap - 60 * _z(mon["sdp"]) - 4 * mon["bad"] - 25 * mon["crash"]


def base_score(train: dict, sel: dict, fin: dict, mon: dict, weight: float = 6.0, use_final: bool = False) -> float:
    """The automatic miner's score. ``use_final`` ranks with the hold-out too, as it did;
    off, the hold-out stays unseen."""
    p, f = _z(sel["precision"]), _z(fin["precision"])
    good = 45 * _z(sel["avg_return"]) + 120 * p + 90 * _z(sel["lcb"]) + 18 * _z(sel["lift"]) + 8 * _z(sel["profit_factor"]) + 55 * _z(mon["mp"]) + 40 * _z(mon["mnp"]) + 25 * _z(mon["mr"]) + 18 * _z(mon["mnr"]) + 50 * mon["pass"]
    good += weight * math.log1p(sel["n"]) - 90 * abs(_z(train["precision"]) - p) - 45 * _z(mon["sdp"]) - 10 * _z(mon["sdr"]) - 25 * mon["crash"]
    return good + (20 * _z(fin["avg_return"]) + 25 * f - 45 * abs(p - f) if use_final else 0.0)


def styles(sel: dict, fin: dict, mon: dict, fw: dict, even: float = 0.375) -> dict[str, float]:
    """Five views of a rule: high precision, coverage, stable, aggressive, defensive."""
    p, r, n = _z(sel["precision"]), _z(sel["avg_return"]), math.log1p(sel["n"])
    pf, gap, over = _z(fin["precision"]), abs(_z(sel["precision"]) - _z(fin["precision"])), max(0.0, _z(sel["precision"]) - even)
    fp, fmin, fr, crash = fw.get("pass_rate", 0.0), _z(fw.get("min_p")), _z(fw.get("min_r")), fw.get("crash", 0)
    return {
        "high_precision": 180 * p + 130 * _z(sel["lcb"]) + 80 * pf + 35 * r + 2 * n - 70 * gap - 25 * mon["crash"],
        "coverage": 35 * n + 25 * math.log1p(fin["n"]) + 100 * sel["pos_recall"] + 70 * fin["pos_recall"] + 140 * over + 45 * r - 15 * mon["crash"],
        "stable": 120 * mon["pass"] + 90 * _z(mon["mnp"]) + 35 * _z(mon["mnr"]) + 110 * fp + 90 * fmin + 35 * fr + 70 * _z(sel["lcb"]) - 80 * _z(mon["sdp"]) - 20 * _z(mon["sdr"]) - 35 * mon["crash"] - 30 * crash,
        "aggressive": 80 * r + 45 * _z(fin["avg_return"]) + 22 * n + 120 * sel["pos_recall"] + 90 * over + 10 * _z(sel["lift"]) - 12 * mon["crash"],
        "defensive": 150 * _z(sel["lcb"]) + 120 * p + 100 * _z(fin["lcb"]) + 90 * _z(mon["mnp"]) + 80 * fmin + 30 * r - 45 * mon["crash"] - 35 * crash,
    }


def selector_score(m: dict, cap: float = 0.15) -> float:
    """The feature selector's training score; too much coverage costs."""
    return 100 * _z(m["precision"]) + 30 * _z(m["lift"]) + 1.5 * math.log1p(m["positive"]) + 4 * m["pos_recall"] - 120 * max(0, m["selected_rate"] - cap)


def stop_avoid_score(n: float, hit: float, base: float, no_lift: float = 0.0) -> float:
    """``no_lift``: the lift over a base of 0; NaN makes the score NaN."""
    rate = hit / n if n else 0.0
    return rate**2 * math.log1p(n) * max(rate / base if base else no_lift, 0.01)


def broad_score(n: float, pos: float, base: float, no_lift: float = 0.0) -> float:
    """For wide rules that are to be joined: rate above the base, lift, bound, and size."""
    rate = pos / n if n else 0.0
    return max(rate - base + 0.06, 0.001) * (rate / base if base else no_lift) ** 0.6 * max(lcb(pos, n) if n else 0.0, 0.0) * math.log1p(n) ** 1.8 * math.log1p(pos) ** 1.2


def walk_forward_score(n: float, pos: float) -> float:
    return (pos / n) ** 3 * math.log1p(n) if n else 0.0


def class0_score(bad: float, protect: float, strong: float, n: float) -> float:
    """For rules that avoid class 0 rows and protect the rest."""
    return bad**2.5 * math.log1p(n) * (1 - protect) ** 1.5 * (1 - strong) ** 2


@dataclass(frozen=True)
class Final:
    """Bounds of the final filter."""

    min_train_precision: float = 0.38
    min_selection_precision: float = 0.6
    min_selection_count: int = 25
    min_selection_lift: float = 1.2
    min_selection_avg_return: float = 1.0
    min_month_precision: float = 0.3
    min_month_return: float = -1.5
    max_crash_months: int = 2
    min_test_precision: float = 0.5
    min_test_count: int = 30
    min_test_lift: float = 1.05
    min_test_avg_return: float = 2.0
    min_fw_mean_precision: float = 0.5
    min_fw_min_precision: float = 0.35
    min_fw_mean_return: float = 0.3
    min_fw_min_return: float = -1.5
    min_fw_pass_rate: float = 0.65
    min_fw_total: int = 30
    max_fw_crash: int = 2


STRICT = Final(min_train_precision=0.0, min_selection_precision=0.65, min_selection_count=20, min_selection_lift=0.0, min_selection_avg_return=2.0, min_month_precision=0.0, min_month_return=-99.0, max_crash_months=999, min_test_lift=0.0, min_fw_min_precision=0.0, min_fw_mean_return=-99.0, min_fw_min_return=-99.0, min_fw_total=0, max_fw_crash=999)


def passes(f: Found, fw: dict, b: Final = Final()) -> bool:
    """All clauses of the final filter; a missing forward summary counts as zeros."""
    t, s, x, m = f.train, f.selection, f.final, f.months
    return all(
        (
            _z(t["precision"]) >= b.min_train_precision, _z(s["precision"]) >= b.min_selection_precision, s["n"] >= b.min_selection_count, _z(s["lift"]) >= b.min_selection_lift, _z(s["avg_return"]) >= b.min_selection_avg_return,
            _z(m["mnp"]) >= b.min_month_precision, _z(m["mnr"]) >= b.min_month_return, m["crash"] <= b.max_crash_months, _z(x["precision"]) >= b.min_test_precision, x["n"] >= b.min_test_count, _z(x["lift"]) >= b.min_test_lift,
            _z(x["avg_return"]) >= b.min_test_avg_return, _z(fw.get("mean_p")) >= b.min_fw_mean_precision, _z(fw.get("min_p")) >= b.min_fw_min_precision, _z(fw.get("mean_r")) >= b.min_fw_mean_return,
            _z(fw.get("min_r")) >= b.min_fw_min_return, fw.get("pass_rate", 0.0) >= b.min_fw_pass_rate, fw.get("total", 0) >= b.min_fw_total, fw.get("crash", 0) <= b.max_fw_crash,
        )
    )


def export_styles(found: list[Found], scores: dict[str, dict[str, float]], each: int = 10) -> list[tuple[str, Found]]:
    """The best rules of each style in turn; no rule comes twice."""
    out, used = [], set()
    for style in ("high_precision", "stable", "coverage"):
        ranked = sorted((f for f in found if f.text not in used), key=lambda f: (-scores[f.text][style], f.text))[:each]
        used |= {f.text for f in ranked}
        out += [(style, f) for f in ranked]
    return out


TIERS = ((0.70, 0.10), (0.67, 0.08), (0.64, 0.06), (0.60, 0.04), (0.0, 0.0))


def tier(rate: float, coverage: float) -> int:
    """The best of five nested tiers that a rate and a coverage reach."""
    return next(i for i, (r, c) in enumerate(TIERS) if rate >= r and coverage >= c)


def joined_report(left: DataFrame, right: DataFrame, keys: list[str], defaults: dict[str, float]) -> DataFrame:
    """All rows of a report with what another says of the same keys, and defaults where it says nothing."""
    out = left.join(right.select(*keys, *defaults), keys, "left")
    return out.select(*left.columns, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()])
