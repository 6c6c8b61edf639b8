"""Choosing among mined rules: rule sets, scenarios, portfolios, walk-forward, usefulness.

Greedy steps need union counts of many sets over the same rows. Rows are first grouped
by the pattern of rules that hold (natively, with partial sums); what a step needs are
sums over patterns. Patterns are far fewer than rows; if they are few enough to hold,
steps run on the driver in numpy, else each step is one aggregation over the patterns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.folders import kept
from tidemark.operators import metrics, search
from tidemark.operators.rules import Atom, Rule, rule_column, text
from tidemark.operators.search import SPLITS, Found, lcb

def return_values() -> dict[str, Column]:
    """Sums over selected rows that the set scores use, for rows from search.prepared()."""
    return {"n": F.lit(1.0), "y": F.col("y"), "r": F.col("r"), "gw": F.greatest(F.col("r"), F.lit(0.0)), "gl": F.least(F.col("r"), F.lit(0.0)), "loss": (F.col("r") < 0).cast("double")}


class Patterns:
    """Sums of values by split for any union of rules."""

    def __init__(self, rows: DataFrame, rules: list[Rule], values: dict[str, Column] | None = None, most: int = 200_000):
        values = values or return_values()
        self.names, self.rules = list(values), rules
        bits = F.concat(F.lit(""), *[F.when(rule_column(r, rows.columns), "1").otherwise("0") for r in rules])
        self.table = rows.groupBy(bits.alias("bits"), "split").agg(*[F.sum(v).alias(k) for k, v in values.items()])
        first = self.table.limit(most + 1).collect()  # bounded
        self.held = None
        if len(first) <= most:
            self.splits = sorted({r.split for r in first})
            seen: dict[str, int] = {}
            for r in first:
                seen.setdefault(r.bits, len(seen))
            self.bits = np.array([[c == "1" for c in b] for b in seen], bool).reshape(len(seen), len(rules))
            self.held = {s: np.zeros((len(seen), len(self.names))) for s in self.splits}
            for r in first:
                self.held[r.split][seen[r.bits]] = [r[n] or 0.0 for n in self.names]
        else:
            self.table = kept(self.table, "patterns")  # every step reads it again
            self.splits = sorted(r.split for r in self.table.select("split").distinct().collect())

    def union(self, sets: list[tuple[int, ...]]) -> list[dict[str, dict[str, float]]]:
        """For each set of rule numbers, split to value sums over the rows any rule picks."""
        if not sets:
            return []
        if self.held is not None:
            out = []
            for i in range(0, len(sets), 512):
                masks = np.stack([self.bits[:, list(s)].any(1) for s in sets[i : i + 512]]).astype(float)
                sums = {s: masks @ w for s, w in self.held.items()}
                out += [{s: dict(zip(self.names, v[k].tolist(), strict=True)) for s, v in sums.items()} for k in range(len(masks))]
            return out
        out = []
        for i in range(0, len(sets), 50):
            aggs = []
            for k, s in enumerate(sets[i : i + 50]):
                hit = F.lit(False)
                for j in s:
                    hit = hit | (F.substring("bits", j + 1, 1) == "1")
                aggs += [F.sum(F.when(hit, F.col(n)).otherwise(0.0)).alias(f"{n}{k}") for n in self.names]
            got = {r.split: r for r in self.table.groupBy("split").agg(*aggs).collect()}
            out += [{s: {n: got[s][f"{n}{k}"] or 0.0 for n in self.names} for s in self.splits} for k in range(len(sets[i : i + 50]))]
        return out

    def whole(self) -> dict[str, dict[str, float]]:
        rows = self.table.groupBy("split").agg(*[F.sum(n).alias(n) for n in self.names]).collect()
        return {r.split: {n: r[n] or 0.0 for n in self.names} for r in rows}


def facts(v: dict[str, float] | None, whole: dict[str, float] | None) -> dict[str, float]:
    """Precision, lift, return, profit factor and shares of a union in one split."""
    v, whole = v or {}, whole or {}
    n, y = v.get("n", 0.0), v.get("y", 0.0)
    base = whole.get("y", 0.0) / whole["n"] if whole.get("n") else 0.0
    p = y / n if n else 0.0
    return {"n": n, "p": p, "lift": p / base if base else 0.0, "r": v.get("r", 0.0) / n if n else 0.0, "pf": v.get("gw", 0.0) / -v["gl"] if v.get("gl", 0.0) < 0 else 0.0, "loss": v.get("loss", 0.0) / n if n else 0.0, "share": n / whole["n"] if whole.get("n") else 0.0}


@dataclass(frozen=True)
class SetGates:
    """Bounds of unions of rules: rows, precision, lift and mean return on two splits; mean and
    least precision, mean return, share of passing months and crashes ahead."""

    # The set search's own bounds and weights.
    top: int = 16
    sizes: tuple[int, ...] = (2, 3, 4)
    least_new: int = 5
    selection: tuple[int, float, float, float] = (50, 0.58, 1.1, 1.0)
    final: tuple[int, float, float, float] = (50, 0.5, 1.0, 2.0)
    forward: tuple[float, float, float, float, int] = (0.5, 0.35, 0.3, 0.65, 2)
    weights: tuple[float, float] = (8.0, 10.0)
    month: tuple[int, float, float, float] = (5, 0.38, 1.05, 0.0)
    crash: tuple[float, float] = (0.3, -1.0)


def by_months(rows: DataFrame, months: list[str]) -> DataFrame:
    """Rows of some months, each month a split."""
    return rows.where(F.col("month").isin(months)).withColumn("split", F.col("month"))


def ahead_of(got: dict[str, dict], whole: dict[str, dict], gates: SetGates) -> dict[str, float]:
    """How a union does over months: means and minima of those with enough rows, NaN without any."""
    usable = [f for m in sorted(whole) if (f := facts(got.get(m), whole[m]))["n"] >= gates.month[0]]
    good = [f for f in usable if f["p"] >= gates.month[1] and f["lift"] >= gates.month[2] and f["r"] >= gates.month[3]]
    crash = [f for f in usable if f["p"] < gates.crash[0] or f["r"] < gates.crash[1]]
    mean = lambda k: sum(f[k] for f in usable) / len(usable) if usable else math.nan
    return {"p": mean("p"), "low": min((f["p"] for f in usable), default=math.nan), "r": mean("r"), "pass": len(good) / len(usable) if usable else 0.0, "crash": len(crash) if usable else len(whole) or 999}


def exhaustive(table: Patterns, names: list[str], gates: SetGates = SetGates(), ahead: Patterns | None = None) -> list[dict]:
    """All unions of 2 to 4 of the top rules that pass the gates and in which each member adds rows, best first.

    ``ahead``: patterns of the same rules by month, for the gates and score terms on the
    months ahead; without it these are left out. A mean that no month gives passes its gate.
    """
    top = min(gates.top, len(names))
    sets = [s for k in gates.sizes for s in combinations(range(top), k)]
    prefixes = sorted({s[:k] for s in sets for k in range(1, len(s) + 1)})
    got = dict(zip(prefixes, table.union(prefixes), strict=True))
    whole = table.whole()
    rows = lambda s: got[s].get("selection", {}).get("n", 0.0) if s else 0.0
    grow = [s for s in sets if all(rows(s[: k + 1]) - rows(s[:k]) >= gates.least_new for k in range(len(s)))]
    later, all_months = (dict(zip(grow, ahead.union(grow), strict=True)), ahead.whole()) if ahead else ({}, {})
    out = []
    for s in grow:
        f = {x: facts(got[s].get(x), whole.get(x)) for x in SPLITS}
        a, b = f["selection"], f["final"]
        if not a["n"] or not b["n"] or any(x[k] < least for x, bounds in ((a, gates.selection), (b, gates.final)) for k, least in zip(("n", "p", "lift", "r"), bounds, strict=True)):
            continue
        # The weights of the set score.
        score = 95 * a["p"] + 115 * b["p"] + 35 * a["r"] + 50 * b["r"] + gates.weights[0] * math.log1p(a["n"]) + gates.weights[1] * math.log1p(b["n"])
        if ahead:
            m = ahead_of(later[s], all_months, gates)
            p, low, r, passing, crashes = gates.forward
            if m["p"] < p or m["low"] < low or m["r"] < r or m["pass"] < passing or m["crash"] > crashes:
                continue
            score += 55 * search._z(m["p"]) + 45 * search._z(m["low"]) + 25 * search._z(m["r"]) - 25 * m["crash"]
        out.append({"kind": "exhaustive", "members": [names[i] for i in s], "score": score, "facts": f})
    return sorted(out, key=lambda x: (-x["score"], -x["facts"]["final"]["r"], -x["facts"]["final"]["p"], -x["facts"]["final"]["n"], -x["facts"]["selection"]["p"], x["members"]))


def _greedy(table: Patterns, names: list[str], kind: str, split: str, most: int, least_new: int, score, accept, target_share: float = 1.0) -> dict | None:
    """Add the best acceptable rule until none is left; ties go by rule text."""
    whole = table.whole()
    chosen: tuple[int, ...] = ()
    now = facts(None, whole.get(split))
    while len(chosen) < most and now["share"] < target_share:
        options = [i for i in range(len(names)) if i not in chosen]
        best = None
        for i, got in zip(options, table.union([(*chosen, i) for i in options]), strict=True):
            f = facts(got.get(split), whole.get(split))
            new = f["n"] - now["n"]
            if new >= least_new and accept(f):
                rank = (score(f, new), [-ord(ch) for ch in names[i]])
                if best is None or rank > best[0]:
                    best = (rank, i, f)
        if best is None:
            break
        chosen, now = (*chosen, best[1]), best[2]
    if not chosen:
        return None
    (got,) = table.union([chosen])
    return {"kind": kind, "members": [names[i] for i in chosen], "score": score(now, now["n"]), "facts": {s: facts(got.get(s), whole.get(s)) for s in SPLITS}}


def greedy_ev(table, names, split="selection", most=20, least_new=3, least_ev=-2.0, least_pf=0.0, target_share=0.5):
    """By expected value: each step takes the rule whose union scores best above the floors;
    it ends when the union covers the target share of rows."""
    score = lambda f, new: 100 * f["r"] + 5 * f["pf"] + 80 * f["share"] + 0.08 * new + 20 * (f["p"] - f["loss"])
    return _greedy(table, names, "ev", split, most, least_new, score, lambda f: f["r"] >= least_ev and f["pf"] >= least_pf, target_share)


def greedy_precision(table, names, split="selection", most=20, least_new=3, floor=0.3):
    """By union precision: the most new rows while the union stays precise."""
    return _greedy(table, names, "precision", split, most, least_new, lambda f, new: new, lambda f: f["p"] >= floor)


def greedy_style(table: Patterns, names: list[str], split: str = "selection", most: int = 8, least_new: int = 3, floor: float = 0.2, ret: float = -3.0) -> dict | None:
    """One pass in the given order: a rule joins if it adds rows and the union keeps the floors."""
    whole = table.whole()
    chosen: tuple[int, ...] = ()
    now = facts(None, whole.get(split))
    for i in range(len(names)):
        if len(chosen) == most:
            break
        f = facts(table.union([(*chosen, i)])[0].get(split), whole.get(split))
        if f["n"] - now["n"] >= least_new and f["p"] >= floor and f["r"] >= ret:
            chosen, now = (*chosen, i), f
    if not chosen:
        return None
    (got,) = table.union([chosen])
    return {"kind": "style", "members": [names[i] for i in chosen], "score": now["p"], "facts": {s: facts(got.get(s), whole.get(s)) for s in SPLITS}}


def scenarios(table: Patterns, names: list[str], options: tuple[tuple[int, float, int], ...] = ((3, 0.5, 8), (3, 0.4, 12), (5, 0.3, 16), (8, 0.2, 20)), split: str = "train", judge: str = "selection") -> list[dict]:
    """A greedy set for each (least new rows, precision floor, most rules), the best first.

    Sets are made on one split and ranked on another: by the tier that precision and
    coverage reach, then by coverage. A set that picks nothing there comes last.
    """
    from tidemark.operators.scoring import tier

    out = []
    for least_new, floor, most in options:
        found = greedy_precision(table, names, split, most, least_new, floor)
        if found:
            f = found["facts"][judge]
            out.append(found | {"kind": f"new {least_new}, precision {floor}, rules {most}", "score": f["p"], "_rank": (f["n"] == 0, tier(f["p"], f["share"]), -f["share"])})
    return [{k: v for k, v in x.items() if k != "_rank"} for x in sorted(out, key=lambda x: (*x["_rank"], x["kind"]))]


def greedy_all(table: Patterns, names: list[str]) -> list[dict]:
    return [x for x in (greedy_ev(table, names), greedy_precision(table, names), greedy_style(table, names)) if x]


def sets_frame(spark, sets: list[dict]) -> DataFrame:
    rows = [(i, s["kind"], " || ".join(s["members"]), len(s["members"]), float(s["score"]), *[float(s["facts"][x][k]) for x in SPLITS for k in ("n", "p", "r")]) for i, s in enumerate(sets, 1)]
    cols = ", ".join(f"{x}_{k} double" for x in SPLITS for k in ("n", "precision", "return"))
    return spark.createDataFrame(rows, f"rank int, kind string, rules string, size int, score double, {cols}")


def portfolio(found: list[Found], size: int = 20, per_set: int = 3, per_family: int = 2, per_pair: int = 8, precision: float = 0.3) -> list[Found]:
    """Rules in score order under caps for feature sets, families and feature pairs, while
    the mean precision holds; without the caps' fill, a second pass drops the family cap."""
    picked: list[Found] = []
    for strict in (True, False):
        for f in sorted(found, key=lambda f: (-(100 * f.selection["precision"] + 8 * search._z(f.selection["lift"]) + 2 * math.log1p(f.selection["n"])), f.text)):
            if f in picked or len(picked) >= size:
                continue
            features = sorted({a.feature for a in f.rule})
            family = sorted(a.feature + a.op for a in f.rule)
            sets = sum(sorted({a.feature for a in g.rule}) == features for g in picked)
            families = sum(sorted(a.feature + a.op for a in g.rule) == family for g in picked)
            pairs = max((sum({a, b} <= {x.feature for x in g.rule} for g in picked) for a, b in combinations(features, 2)), default=0)
            mean = (sum(g.selection["precision"] for g in picked) + f.selection["precision"]) / (len(picked) + 1)
            if sets < per_set and pairs < per_pair and mean >= precision and (families < per_family or not strict):
                picked.append(f)
    return picked


# What each row of classes 1 to 3 takes off an avoid rule's worth, and the powers of its parts.
CLASS_PENALTY = {1: 0.35, 2: 3.2, 3: 5.5}
PRECISION_POWER, LIFT_POWER, WILSON_POWER, COVERAGE_POWER = 2.1, 1.0, 1.25, 1.25


def avoid_score(n: float, good: float, penalty: float, base: float) -> float:
    """What an avoid rule is worth: it should pick class 0, hardly any class 3 and few of the others."""
    if not n or not good or not base:
        return 0.0
    rate = good / n
    return rate**PRECISION_POWER * (rate / base) ** LIFT_POWER * max(lcb(good, n), 1e-9) ** WILSON_POWER * math.log1p(good) ** COVERAGE_POWER * math.log1p(n) * max(0.01, 1 - penalty / n)


def avoid_set(df: DataFrame, atoms: list[Atom], key: list[str], least: int = 15, beam: int = 60, depth: int = 2, most: int = 12, class3_share: float = 0.15, least_new: int = 3) -> list[tuple]:
    """Mine avoid rules on train rows and choose some: primary adds, smaller fills, repair.

    Covers as much of class 0 as it can while the share of class 3 that is lost stays
    under the cap; a rule without which no more class 0 is lost than class 3 is gained
    goes again. Returns (step, rule, rows, class0, class3, covered shares).
    """
    penalty = F.coalesce(*[F.when(F.col("target_class") == c, F.lit(p)) for c, p in CLASS_PENALTY.items()], F.lit(0.0))
    rows = search.prepared(df, sorted({a.feature for a in atoms}), F.col("target_class") == 0, penalty, key)
    found: dict[Rule, float] = {}
    level: list[Rule] = [()]
    for _ in range(depth):
        cand = sorted({tuple(sorted((*r, a), key=lambda x: x.key)) for r in level for a in atoms if all(a.feature != x.feature for x in r)}, key=text)
        place = {a: i for i, a in enumerate(atoms)}
        got = search.sums(rows, atoms, [tuple(place[a] for a in r) for r in cand])
        whole = got.get((-1, "train"), [0.0] * 7)
        base = whole[1] / whole[0] if whole[0] else 0.0
        scored = sorted(((avoid_score(v[0], v[1], v[2], base), r) for c, r in enumerate(cand) if (v := got.get((c, "train"))) and v[0] >= least), key=lambda x: (-x[0], text(x[1])))
        level = [r for _, r in scored[:beam]]
        found |= {r: s for s, r in scored[:beam] if s > 0}
    rules = sorted(found, key=lambda r: (-found[r], text(r)))[: 4 * beam]
    if not rules:
        return []
    table = Patterns(rows, rules, {"n": F.lit(1.0), "y": F.col("y"), "r": (F.col("r") == CLASS_PENALTY[3]).cast("double")})
    whole = table.whole().get("train", {"n": 0.0, "y": 0.0, "r": 0.0})
    zero = {"n": 0.0, "y": 0.0, "r": 0.0}
    held = lambda s: table.union([s])[0].get("train", zero) if s else zero
    chosen: tuple[int, ...] = ()
    for need in (least_new * 3, least_new):  # primary, then fill
        while len(chosen) < most:
            now = held(chosen)
            options = [i for i in range(len(rules)) if i not in chosen]
            best = None
            for i, got in zip(options, table.union([(*chosen, i) for i in options]), strict=True):
                v = got.get("train", zero)
                new = v["y"] - now["y"]
                if new >= need and v["r"] <= class3_share * whole["r"]:
                    rank = (new - 3 * (v["r"] - now["r"]), -i)
                    if best is None or rank > best[0]:
                        best = (rank, i)
            if best is None or best[0][0] <= 0:
                break
            chosen = (*chosen, best[1])
    for i in list(chosen):  # repair
        rest = tuple(j for j in chosen if j != i)
        if held(chosen)["y"] - held(rest)["y"] <= held(chosen)["r"] - held(rest)["r"]:
            chosen = rest
    out = []
    for k in range(len(chosen)):
        v = held(chosen[: k + 1])
        out.append((k + 1, text(rules[chosen[k]]), int(v["n"]), int(v["y"]), int(v["r"]), v["y"] / whole["y"] if whole["y"] else 0.0, v["r"] / whole["r"] if whole["r"] else 0.0))
    return out


def walk_forward(monthly: DataFrame, last: int) -> DataFrame:
    """For the last months: counts of all months before, and the month's own. One row a month."""
    past = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    df = monthly.withColumns({"train_n": F.sum("selected_count").over(past), "train_pos": F.sum("positive_count").over(past), "_back": F.row_number().over(Window.orderBy(F.desc("month")))})
    df = df.where(F.col("_back") <= last)
    return df.select("month", "train_n", F.try_divide("train_pos", "train_n").alias("train_precision"), F.col("selected_count").alias("valid_n"), F.try_divide("positive_count", "selected_count").alias("valid_precision"))


def fold_bounds(start: float = 0.35, valid: float = 0.13, folds: int = 5) -> list[tuple[int, float, float]]:
    """Row shares of consecutive validation blocks."""
    return [(i, round(start + valid * i, 6), round(min(1.0, start + valid * (i + 1)), 6)) for i in range(folds)]


def folds(df: DataFrame, order: list[str], bounds: list[tuple[int, float, float]] | None = None) -> DataFrame:
    """Rows with their fold by position; a row in several folds comes several times."""
    n = df.count()
    share = (F.col("at") - 1) / float(max(n, 1))
    blocks = F.array(*[F.when((share >= a) & (share < b), F.lit(i)) for i, a, b in (bounds or fold_bounds())])
    return metrics.positions(df, order).withColumn("fold", F.explode(F.filter(blocks, lambda x: x.isNotNull()))).drop("at")


def folds_pass(rates: list[tuple[int, float]], least_count: int = 6, least_rate: float = 0.6, least_mean: float = 0.6, least_recent: float = 0.55, least_folds: int = 3) -> bool:
    """Whether (count, rate) by fold hold up: enough folds, their mean and the newest."""
    used = [r for n, r in rates if n >= least_count]
    good = [r for r in used if r >= least_rate]
    return len(good) >= least_folds and sum(used) / len(used) >= least_mean and used[-1] >= least_recent


def usefulness(df: DataFrame, features: list[str], y: Column, found: list[Found]) -> DataFrame:
    """Grade of each feature from its AUC, its best bin, and the rules that use it.

    S: strong alone and in rules; A: helps in rules; B: some signal; C: none.
    """
    spark = df.sparkSession
    alone = {r.feature: r for r in metrics.auc(df, features, y).collect()}  # one row a feature
    rows = []
    for f in features:
        best = metrics.decile_report(df, f, y, F.lit(0.0)).agg(F.max("lift")).first()[0] or 0.0
        using = [x for x in found if any(a.feature == f for a in x.rule)]
        ps = [x.selection["precision"] for x in using]
        lifts = [search._z(x.selection["lift"]) for x in using]
        ops = [a.op for x in using for a in x.rule if a.feature == f]
        agree = ops.count(alone[f].direction) / len(ops) if ops and f in alone else 0.0
        a = alone[f].auc if f in alone and alone[f].auc is not None else 0.5
        mean_p, mean_lift = (sum(ps) / len(ps), sum(lifts) / len(lifts)) if using else (0.0, 0.0)
        score = 35 * max(0, a - 0.5) + 12 * max(0, best - 1) + 25 * max(0, mean_lift - 1) + 70 * max(0, mean_p - 0.5) + 0.4 * len(using) - (8 if ops and agree < 0.5 else 0)
        grade = "S" if a >= 0.55 and len(using) >= 5 else "A" if len(using) >= 5 else "B" if a >= 0.53 or using else "C"
        rows.append((f, float(a), float(best), len(using), float(mean_p), float(mean_lift), float(agree), float(score), grade))
    return spark.createDataFrame(rows, "feature string, auc double, best_bin_lift double, usage int, mean_precision double, mean_lift double, direction_agreement double, score double, grade string")
