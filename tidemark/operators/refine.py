"""Around the search: which side of a feature matters, which features are alike, what a
feature adds, and whether applied rules kept their promise."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import metrics, rules, search
from tidemark.operators.rules import Atom, Rule, rule_column


def inferred_ops(df: DataFrame, features: list[str], y: Column, ret: Column, grid: list[float], least: int = 100, margin: float = 0.35, no_lift: float = 0.0) -> dict[str, list[str]]:
    """For each feature the side whose best threshold scores higher, or both within ``margin``.

    ``no_lift``: the lift where no row is positive; NaN favours no side.
    """
    table = rules.quantile_table(df, features, grid).collect()  # features times grid values
    atoms = {f"{i}": Atom(r.feature, op, round(r.value, 10)) for i, (r, op) in enumerate((r, op) for r in table if r.value is not None for op in (">=", "<="))}
    got = metrics.many_rules(df, {k: rules.atom_column(a) for k, a in atoms.items()}, y, ret).collect()
    best: dict[tuple[str, str], float] = {}
    for r in got:
        if r.selected_count >= least:
            a = atoms[r.rule]
            score = 3 * (r.avg_return or 0) + 5 * (r.precision_lcb or 0) + 0.5 * (no_lift if r.lift is None else r.lift) + 0.1 * math.log1p(r.selected_count)
            if not math.isnan(score):
                best[a.feature, a.op] = max(best.get((a.feature, a.op), float("-inf")), score)
    out = {}
    for f in features:
        sides = {op: best[f, op] for op in (">=", "<=") if (f, op) in best}
        top = max(sides.values(), default=None)
        out[f] = [op for op in sides if top - sides[op] <= margin] if sides else []
    return out


def correlated(df: DataFrame, features: list[str], threshold: float = 0.92) -> frozenset[frozenset[str]]:
    """Pairs of features whose rank correlation reaches the threshold either way."""
    rows = metrics.spearman(df, features).where(F.abs("rho") >= threshold).collect()  # pairs of features
    return frozenset(frozenset((r.feature_a, r.feature_b)) for r in rows)


def pruned(features: list[str], pairs: frozenset[frozenset[str]], score: dict[str, float]) -> list[str]:
    """Of each correlated pair the feature with the better score (then by name) stays."""
    gone = set()
    for pair in sorted(pairs, key=sorted):
        a, b = sorted(pair, key=lambda f: (-score.get(f, 0.0), f))
        if a not in gone:
            gone.add(b)
    return [f for f in features if f not in gone]


def leave_one_out(rows: DataFrame, atoms: list[Atom], cfg: search.Config, top: int = 10) -> list[tuple[str, float, float, float]]:
    """(feature, mean precision of the top rules with it, without it, what it adds)."""
    mean = lambda fs: sum(f.selection["precision"] for f in fs[:top]) / len(fs[:top]) if fs else 0.0
    whole = mean(search.beam_search(rows, atoms, cfg))
    out = []
    for f in sorted({a.feature for a in atoms}):
        less = mean(search.beam_search(rows, [a for a in atoms if a.feature != f], cfg))
        out.append((f, whole, less, whole - less))
    return out


def contribution(rows: DataFrame, found: list[search.Found], cfg: search.Config) -> list[tuple[str, str, float, int]]:
    """(rule, feature, precision it adds, rows it takes): each rule against itself without a feature."""
    less: list[Rule] = [tuple(a for a in f.rule if a.feature != x) for f in found for x in sorted({a.feature for a in f.rule})]
    names = [(f, x) for f in found for x in sorted({a.feature for a in f.rule})]
    open_ = replace(cfg, min_train_count=0)
    got = search.evaluate(rows, less, open_) if less else []
    return [(f.text, x, f.selection["precision"] - search._z(g.selection["precision"]), g.selection["n"] - f.selection["n"]) for (f, x), g in zip(names, got, strict=True)]


def verified(df: DataFrame, catalog: dict[str, Rule], y: Column) -> DataFrame:
    """Count and success of each rule on new rows, and the plain and weighted mean of all."""
    each = metrics.many_rules(df, {n: rule_column(r, df.columns) for n, r in catalog.items()}, y).select("rule", "selected_count", "positive_count", "precision")
    whole = each.agg(F.sum("selected_count").alias("selected_count"), F.sum("positive_count").alias("positive_count"), F.avg("precision").alias("plain"))
    both = whole.select(F.inline(F.array(F.struct(F.lit("mean").alias("rule"), "selected_count", "positive_count", F.col("plain").alias("precision")), F.struct(F.lit("weighted").alias("rule"), "selected_count", "positive_count", F.try_divide("positive_count", "selected_count").alias("precision")))))
    return each.unionByName(both)
