"""Beam search for rules, scored where the rows are.

A depth's candidates go to all tasks (their number is bounded by beam and atoms, not by
the data). A task turns its rows into one boolean vector for each atom, ANDs them for
each candidate and multiplies with the columns to sum: rows, positives and returns of
each split, and a fingerprint. Only sums for each candidate leave the tasks, so a depth
is one pass over the rows and the driver never holds a row or a mask.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import number
from tidemark.operators.metrics import flag
from tidemark.operators.rules import Atom, Rule, can_add, canonical, text

SPLITS = ("train", "selection", "final")


@dataclass(frozen=True)
class Config:
    """Gates and sizes of the miner; names follow the metrics they bound."""

    max_depth: int = 5
    beam_width: int = 350
    top_k: int = 120
    min_train_count: int = 50
    min_selection_count: int = 25
    min_train_precision: float = 0.34
    min_selection_precision: float = 0.42
    min_train_lift: float = 1.02
    min_selection_lift: float = 1.08
    min_selection_lcb: float = 0.3
    min_selection_avg_return: float = 0.2
    max_precision_gap: float = 0.28
    beam_min_count: int = 45
    beam_min_lift: float = 1.0
    fast_min_selection_count: int = 18
    fast_min_selection_precision: float = 0.34
    fast_min_selection_lift: float = 1.05
    fast_min_selection_avg_return: float = -0.3
    min_month_count: int = 5
    month_pass_precision: float = 0.42
    month_pass_lift: float | None = 1.05
    month_pass_avg_return: float = 0.0
    month_crash_precision: float = 0.3
    month_crash_avg_return: float = -1.0
    min_selection_usable_months: int = 2
    min_selection_pass_month_rate: float = 0.2
    min_selection_month_min_precision: float = 0.3
    min_selection_month_min_return: float = -2.0
    max_selection_crash_months: int = 2
    selection_count_weight: float = 6.0
    dup_count_tol: float = 0.1
    dup_precision_gain: float = 0.01
    simplify_precision_drop: float = 0.015
    simplify_min_count_ratio: float = 0.85
    intervals: frozenset = frozenset()
    correlated: frozenset = frozenset()
    groups: dict = field(default_factory=dict)
    limits: dict = field(default_factory=dict)
    first_features: frozenset = frozenset()


def _sum_columns(y: str, r: str) -> list[str]:
    return ["n", y, r, "win", "loss", "fa", "fb"]


def prepared(df: DataFrame, features: list[str], y: Column, ret: Column, row_key: list[str], month: Column | None = None) -> DataFrame:
    """What a pass reads: features, split, label, return and a hash of the row's key."""
    return df.select(*[number(c).alias(c) for c in features], "split", flag(y).cast("double").alias("y"), ret.cast("double").alias("r"), F.xxhash64(*row_key).alias("h"), (month if month is not None else F.lit("")).alias("month"))


def sums(rows: DataFrame, atoms: list[Atom], candidates: list[tuple[int, ...]], by_month: bool = False, chunk: int = 256) -> dict:
    """{(candidate, split[, month]): [n, positives, returns, wins, losses, fingerprints]} and, under
    candidate -1, the same for all rows. Candidates are tuples of atom numbers."""
    used = sorted({i for c in candidates for i in c})
    names = sorted({atoms[i].feature for i in used})

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            cols = {c: b.column(c).to_numpy(zero_copy_only=False) for c in names}
            n = b.num_rows
            hold = {}
            with np.errstate(invalid="ignore"):
                for i in used:
                    a, x = atoms[i], cols[atoms[i].feature].astype(float)
                    hold[i] = {">=": x >= a.threshold, "<=": x <= a.threshold, ">": x > a.threshold, "==": x == a.threshold}[a.op]
            y, r = b.column("y").to_numpy(zero_copy_only=False), np.nan_to_num(b.column("r").to_numpy(zero_copy_only=False).astype(float))
            h = b.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            values = np.stack([np.ones(n), y, r, np.where(r > 0, r, 0), np.where(r < 0, r, 0), (h & np.uint64(0xFFFFF)).astype(float), ((h >> np.uint64(40)) & np.uint64(0xFFFFF)).astype(float)], 1)
            split, month = b.column("split").to_numpy(zero_copy_only=False), b.column("month").to_numpy(zero_copy_only=False)
            keys = np.array([f"{s}\t{m}" if by_month else s for s, m in zip(split, month, strict=True)])
            kinds, at = np.unique(keys, return_inverse=True)
            wide = np.zeros((n, len(kinds) * 7))
            for k in range(len(kinds)):
                wide[:, k * 7 : k * 7 + 7] = values * (at == k)[:, None]
            for i in range(0, len(candidates), chunk):
                part = candidates[i : i + chunk]
                mask = np.empty((len(part), n))
                for j, c in enumerate(part):
                    m = hold[c[0]].copy() if c else np.ones(n, bool)
                    for a in c[1:]:
                        m &= hold[a]
                    mask[j] = m
                got = mask @ wide
                for k, kind in enumerate(kinds):
                    key = (i, str(kind))
                    block = got[:, k * 7 : k * 7 + 7]
                    total[key] = total[key] + block if key in total else block
            for k, kind in enumerate(kinds):
                key = (-1, str(kind))
                block = wide[:, k * 7 : k * 7 + 7].sum(0)[None]
                total[key] = total[key] + block if key in total else block
        for (i, kind), block in total.items():
            some = np.flatnonzero(block[:, 0] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(some + i if i >= 0 else some - 1, pa.int64()), pa.array([kind] * len(some), pa.string()), pa.array(list(block[some]), pa.list_(pa.float64()))], names=["c", "k", "v"])

    parts = rows.select(*names, "split", "y", "r", "h", "month").mapInArrow(run, "c long, k string, v array<double>")
    out = parts.groupBy("c", "k").agg(*[F.sum(F.get("v", F.lit(j))).alias(f"v{j}") for j in range(7)]).collect()
    return {(r.c, *r.k.split("\t")): [r[f"v{j}"] for j in range(7)] for r in out}


def lcb(pos: float, n: float, z: float = 1.96) -> float:
    if n <= 0:
        return math.nan
    p = pos / n
    return (p + z * z / (2 * n) - z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def metrics(v: list[float] | None, whole: list[float] | None) -> dict:
    """Rule metrics from sums; NaN where nothing is selected."""
    n, pos, r, win, loss = (v or [0.0] * 5)[:5]
    total, all_pos = (whole or [0.0, 0.0])[:2]
    base = all_pos / total if total else math.nan
    p = pos / n if n else math.nan
    return {
        "n": int(n), "positive": int(pos), "precision": p, "lcb": lcb(pos, n), "base_rate": base, "lift": p / base if n and base > 0 else math.nan,
        "pos_recall": pos / all_pos if all_pos else 0.0, "selected_rate": n / total if total else 0.0, "avg_return": r / n if n else math.nan,
        "profit_factor": win / -loss if loss < 0 else math.nan,
    }


def month_stats(found: dict, c: int, split: str, cfg: Config) -> dict:
    """Stability of a candidate over the months of a split; sentinels where no month is usable."""
    months = sorted({k[2] for k in found if k[0] == -1 and k[1] == split})
    rows = [metrics(found.get((c, split, m)), found[(-1, split, m)]) for m in months]
    usable = [m for m in rows if m["n"] >= cfg.min_month_count]
    if not usable:
        return {"usable": 0, "mp": math.nan, "mnp": math.nan, "sdp": math.nan, "mr": math.nan, "mnr": math.nan, "sdr": math.nan, "pass": 0.0, "bad": len(rows), "crash": len(rows) if rows else 999}
    p, r = np.array([m["precision"] for m in usable]), np.array([m["avg_return"] for m in usable])
    good = (p >= cfg.month_pass_precision) & (r >= cfg.month_pass_avg_return)
    if cfg.month_pass_lift is not None:
        good &= np.array([m["lift"] for m in usable]) >= cfg.month_pass_lift
    crash = (p < cfg.month_crash_precision) | (r < cfg.month_crash_avg_return)
    return {"usable": len(usable), "mp": p.mean(), "mnp": p.min(), "sdp": p.std(), "mr": r.mean(), "mnr": r.min(), "sdr": r.std(), "pass": good.mean(), "bad": int((~good).sum()), "crash": int(crash.sum())}


def _z(x) -> float:
    return float(x) if x is not None and math.isfinite(x) else 0.0


FAILED = -1e18


def beam_score(train: dict, cfg: Config) -> float:
    """What a candidate is worth on the training rows alone."""
    if train["n"] < cfg.beam_min_count or _z(train["lift"]) < cfg.beam_min_lift:
        return FAILED
    return 22 * _z(train["avg_return"]) + 50 * _z(train["precision"]) + 28 * _z(train["lcb"]) + 9 * _z(train["lift"]) + 2 * math.log1p(train["n"])


def fast_gate(sel: dict, cfg: Config) -> bool:
    return sel["n"] >= cfg.fast_min_selection_count and _z(sel["precision"]) >= cfg.fast_min_selection_precision and _z(sel["lift"]) >= cfg.fast_min_selection_lift and _z(sel["avg_return"]) >= cfg.fast_min_selection_avg_return


def final_score(train: dict, sel: dict, mon: dict, cfg: Config) -> float:
    """The weighted score behind thirteen gates; FAILED where a gate isn't passed."""
    finite = all(math.isfinite(m[k]) for m in (train, sel) for k in ("precision", "lift", "avg_return"))
    gap = abs(_z(train["precision"]) - _z(sel["precision"]))
    gates = (
        train["n"] >= cfg.min_train_count, sel["n"] >= cfg.min_selection_count, finite, _z(train["lift"]) >= cfg.min_train_lift, _z(sel["lift"]) >= cfg.min_selection_lift,
        _z(train["precision"]) >= cfg.min_train_precision, _z(sel["precision"]) >= cfg.min_selection_precision, _z(sel["avg_return"]) >= cfg.min_selection_avg_return,
        gap <= cfg.max_precision_gap, mon["usable"] >= cfg.min_selection_usable_months, mon["pass"] >= cfg.min_selection_pass_month_rate,
        _z(mon["mnp"]) >= cfg.min_selection_month_min_precision, _z(mon["mnr"]) >= cfg.min_selection_month_min_return, mon["crash"] <= cfg.max_selection_crash_months, _z(sel["lcb"]) >= cfg.min_selection_lcb,
    )
    if not all(gates):
        return FAILED
    p = sel["precision"]
    good = 110 * p + 75 * _z(sel["lcb"]) + 18 * sel["lift"] + 42 * sel["avg_return"] + 7 * _z(sel["profit_factor"]) + 55 * _z(mon["mp"]) + 45 * _z(mon["mnp"]) + 25 * _z(mon["mr"]) + 18 * _z(mon["mnr"])
    good += 45 * mon["pass"] + 15 * train["precision"] + cfg.selection_count_weight * math.log1p(sel["n"]) + 120 * max(0, p - 0.6) + 220 * max(0, p - 0.7)
    return good - 80 * gap - 45 * _z(mon["sdp"]) - 10 * _z(mon["sdr"]) - 3 * mon["bad"] - 25 * mon["crash"]


@dataclass
class Found:
    rule: Rule
    train: dict
    selection: dict
    final: dict
    months: dict
    score: float
    mask: tuple

    @property
    def text(self) -> str:
        return text(self.rule)


def evaluate(rows: DataFrame, candidates: list[Rule], cfg: Config) -> list[Found]:
    """Full metrics, months and score of some rules, in one pass."""
    atoms = sorted({a for r in candidates for a in r})
    place = {a: i for i, a in enumerate(atoms)}
    cand = [tuple(place[a] for a in r) for r in candidates]
    found = sums(rows, atoms, cand, by_month=True)
    whole: dict = {}
    for (c, split, _), v in found.items():
        whole[c, split] = [a + b for a, b in zip(whole.get((c, split), [0.0] * 7), v, strict=True)]
    out = []
    for c, rule in enumerate(candidates):
        m = {s: metrics(whole.get((c, s)), whole.get((-1, s))) for s in SPLITS}
        mon = month_stats(found, c, "selection", cfg)
        mask = tuple(tuple(whole.get((c, s), [0.0] * 7)[i] for i in (0, 5, 6)) for s in SPLITS[:2])
        out.append(Found(rule, m["train"], m["selection"], m["final"], mon, final_score(m["train"], m["selection"], mon, cfg), mask))
    return out


def beam_search(rows: DataFrame, atoms: list[Atom], cfg: Config = Config()) -> list[Found]:
    """The best rules that pass all gates, near duplicates removed, best first.

    Each depth extends the beam by every compatible atom, scores all in one pass, drops
    rules that repeat a training mask, and keeps the best by training score; those that
    pass the fast gates on the selection rows are evaluated in full. Ties go by text.
    """
    atoms = sorted(atoms, key=lambda a: a.key)
    place = {a: i for i, a in enumerate(atoms)}
    beam: list[Rule] = [()]
    seen: set = set()
    masks: set = set()
    kept: list[Found] = []
    for depth in range(cfg.max_depth):
        new: dict[tuple, Rule] = {}
        for rule in beam:
            for a in atoms:
                if depth == 0 and cfg.first_features and a.feature not in cfg.first_features:
                    continue
                if can_add(rule, a, cfg.intervals, cfg.correlated, cfg.groups, cfg.limits):
                    r = canonical((*rule, a))
                    key = tuple(x.key for x in r)
                    if key not in seen:
                        seen.add(key)
                        new[key] = r
        if not new:
            break
        cand = sorted(new.values(), key=text)
        found = sums(rows, atoms, [tuple(place[a] for a in r) for r in cand])
        scored = []
        for c, r in enumerate(cand):
            train = metrics(found.get((c, "train")), found.get((-1, "train")))
            score = beam_score(train, cfg)
            if score <= FAILED / 10:
                continue
            v = found[(c, "train")]
            mask = (v[0], v[5], v[6])
            if depth and mask in masks:
                continue
            masks.add(mask)
            scored.append((-score, text(r), r, metrics(found.get((c, "selection")), found.get((-1, "selection")))))
        scored.sort(key=lambda s: s[:2])
        beam = [s[2] for s in scored[: cfg.beam_width]]
        if fast := [s[2] for s in scored[: cfg.beam_width] if fast_gate(s[3], cfg)]:
            kept += [f for f in evaluate(rows, fast, cfg) if f.score > FAILED / 10]
        if not beam:
            break
    kept.sort(key=lambda f: (-f.score, f.text))
    return distinct_rules(kept, cfg)[: cfg.top_k]


def distinct_rules(found: list[Found], cfg: Config) -> list[Found]:
    """Without rules that pick the same rows as a better one, or that are a better one with
    more or fewer atoms, about as many rows and hardly more precision."""
    out: list[Found] = []
    for f in found:
        near = False
        for g in out:
            if f.mask[0] == g.mask[0] or f.mask[1] == g.mask[1]:
                near = True
            else:
                a, b = {x.feature for x in f.rule}, {x.feature for x in g.rule}
                size = abs(f.selection["n"] - g.selection["n"]) / max(g.selection["n"], 1)
                near = size <= cfg.dup_count_tol and _z(f.selection["precision"]) - _z(g.selection["precision"]) <= cfg.dup_precision_gain and (a <= b or b <= a)
            if near:
                break
        if not near:
            out.append(f)
    return out


def simplified(rows: DataFrame, found: Found, cfg: Config) -> Found:
    """Atoms dropped one at a time while the gates hold, precision hardly falls and rows stay."""
    best = found
    while len(best.rule) > 1:
        options = [best.rule[:i] + best.rule[i + 1 :] for i in range(len(best.rule))]
        good = [f for f in evaluate(rows, options, cfg) if f.score > FAILED / 10 and best.selection["precision"] - f.selection["precision"] <= cfg.simplify_precision_drop and f.selection["n"] >= cfg.simplify_min_count_ratio * best.selection["n"]]
        if not good:
            return best
        best = max(good, key=lambda f: (f.score, f.text))
    return best


def forward_months(months: list[str], n: int = 6, warm_up: int = 6) -> list[str]:
    """n months after the warm-up, evenly spaced (positions round half to even)."""
    later = sorted(set(months))[warm_up:]
    if len(later) <= n:
        return later
    at = sorted({round(i * (len(later) - 1) / (n - 1)) for i in range(n)}) if n > 1 else [len(later) - 1]
    return [later[i] for i in at]


def forward_summary(rows: DataFrame, rules: list[Rule], months: list[str], least: int = 5, precision: float = 0.38, lift: float | None = 1.05, ret: float = 0.0, crash_precision: float = 0.3, crash_return: float = -1.0) -> list[dict]:
    """Each rule on each chosen month, all rows of a month together, and how many pass."""
    atoms = sorted({a for r in rules for a in r})
    place = {a: i for i, a in enumerate(atoms)}
    found = sums(rows.withColumn("split", F.lit("all")).where(F.col("month").isin(months)), atoms, [tuple(place[a] for a in r) for r in rules], by_month=True)
    out = []
    for c, rule in enumerate(rules):
        got = [metrics(found.get((c, "all", m)), found.get((-1, "all", m))) for m in months]
        usable = [m for m in got if m["n"] >= least]
        good = [m for m in usable if m["precision"] >= precision and m["avg_return"] >= ret and (lift is None or _z(m["lift"]) >= lift)]
        crash = [m for m in usable if m["precision"] < crash_precision or m["avg_return"] < crash_return]
        mean = lambda k, f=np.mean, u=usable: float(f([m[k] for m in u])) if u else math.nan
        out.append({"rule": text(rule), "splits": len(usable), "total": sum(m["n"] for m in got), "mean_p": mean("precision"), "min_p": mean("precision", np.min), "mean_r": mean("avg_return"), "min_r": mean("avg_return", np.min), "pass_rate": len(good) / len(usable) if usable else 0.0, "crash": len(crash)})
    return out
