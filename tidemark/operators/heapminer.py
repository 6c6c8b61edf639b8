"""Rules by a beam that is a bounded heap, with a floor to be saved and one to be extended.

A depth's candidates are the beam's rules with one literal more, as sorted literal numbers,
each once. Tasks pack the literals of their rows into bits, AND them for every candidate
and count rows by class; a candidate's counts are summed over the tasks by Spark, scored
there, and only the best that pass a floor come to the driver: ``beam`` rules to extend and
``top`` to save. The floor for extending starts low and grows with depth.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import number
from tidemark.operators import rules
from tidemark.operators.metrics import wilson
from tidemark.operators.rules import Atom, Rule, canonical, text
from tidemark.operators.topk import Order, top_k


@dataclass(frozen=True)
class Sizes:
    """Rules that are extended and saved, the least rows of a rule, its most literals, and how
    many candidates one pass counts."""

    beam: int = 30_000
    top: int = 10_000
    least: int = 80
    depth: int = 4
    block: int = 500_000


@dataclass(frozen=True)
class StopGoal:
    """Rules that pick rows which stop before they reach their target: class 1 of 2."""

    classes: int = 2
    # Floors and weights of the stop miner.
    least_rate: float = 0.58
    least_lift: float = 1.25
    growth: tuple[float, float, float] = (1.08, 0.04, 0.08)  # lift, margin over the base rate and the growth of the lift by depth
    margin_growth: float = 0.04

    def scored(self, df: DataFrame, whole: list[int]) -> DataFrame:
        base = whole[1] / sum(whole) if sum(whole) else 0.0
        df = df.withColumns({"rate": F.col("k1") / F.col("n"), "hits": F.col("k1")})
        df = df.withColumn("lift", F.col("rate") / base if base else F.lit(0.0))
        return df.withColumn("score", F.col("rate") * F.col("rate") * F.log1p("n") * F.greatest("lift", F.lit(0.01)))

    def _floor(self, whole: list[int]) -> tuple[float, float]:
        base = whole[1] / sum(whole) if sum(whole) else 0.0
        return base, max(self.least_rate, base * self.least_lift)

    def saves(self, whole: list[int]) -> Column:
        return F.col("rate") >= self._floor(whole)[1]

    def extends(self, whole: list[int], depth: int) -> Column:
        base, least = self._floor(whole)
        lift, margin, growth = self.growth
        return F.col("rate") >= min(max(base * (lift + depth * growth), base + margin + depth * self.margin_growth), least)

    beam_order = (("score", True), ("rate", True), ("hits", True), ("n", True))
    saved_order = (("score", True), ("rate", True), ("n", True))


@dataclass(frozen=True)
class NoBounceGoal:
    """Rules that pick class 0 of 4, hardly any of class 3 and few of the others."""

    classes: int = 4
    # Floors, penalties and powers of the no-bounce miner.
    least_rate: float = 0.32
    least_lift: float = 0.66
    least_wilson: float = 0.16
    most_class23: float = 0.7
    rates: tuple[float, ...] = (0.25, 0.3, 0.36, 0.42, 0.48)
    lifts: tuple[float, ...] = (0.68, 0.78, 0.9, 1.02, 1.12)
    penalties: tuple[float, float, float] = (0.35, 3.2, 5.5)
    powers: tuple[float, float, float, float] = (2.1, 1.0, 1.25, 1.25)

    def scored(self, df: DataFrame, whole: list[int]) -> DataFrame:
        base = whole[0] / sum(whole) if sum(whole) else 0.0
        df = df.withColumns({"rate": F.col("k0") / F.col("n"), "hits": F.col("k0"), "wilson": wilson(F.col("k0"), F.col("n"), empty=0.0, floor=True), **{f"c{k}": F.col(f"k{k}") / F.col("n") for k in (1, 2, 3)}})
        df = df.withColumn("lift", F.col("rate") / base if base else F.lit(0.0))
        penalty = F.greatest(F.lit(0.01), 1 - sum(p * F.col(f"c{k}") for k, p in enumerate(self.penalties, 1)))
        rate, lift, bound, cover = self.powers
        score = F.pow("rate", F.lit(rate)) * F.pow("lift", F.lit(lift)) * F.pow(F.greatest("wilson", F.lit(1e-9)), F.lit(bound)) * F.pow(F.log1p("hits"), F.lit(cover)) * F.log1p("n") * penalty
        return df.withColumn("score", score if base else F.lit(0.0))

    def saves(self, whole: list[int]) -> Column:
        return (F.col("rate") >= self.least_rate) & (F.col("lift") >= self.least_lift) & (F.col("wilson") >= self.least_wilson) & (F.col("c2") + F.col("c3") <= self.most_class23)

    def extends(self, whole: list[int], depth: int) -> Column:
        at = min(depth, len(self.rates) - 1)
        return (F.col("rate") >= self.rates[at]) & (F.col("lift") >= self.lifts[at])

    beam_order = (("score", True), ("wilson", True), ("rate", True), ("lift", True), ("hits", True), ("n", True))
    saved_order = (("score", True), ("wilson", True), ("rate", True), ("lift", True), ("c3", False), ("c2", False), ("hits", True), ("n", True))


@dataclass(frozen=True)
class BroadGoal:
    """Wide rules that pick positives (class 1 of 2) a little more often than chance, to be joined."""

    classes: int = 2
    # Floors over the base rate and powers of the broad miner.
    rate_up: float = 0.005
    least_lift: float = 1.0
    least_wilson: float = 0.3
    rates_up: tuple[float, ...] = (-0.08, -0.04, -0.02)
    lifts: tuple[float, ...] = (0.8, 0.88, 0.94)
    margin: float = 0.06
    powers: tuple[float, float, float, float, float] = (1.0, 0.6, 1.0, 1.8, 1.2)

    def _base(self, whole: list[int]) -> float:
        return whole[1] / sum(whole) if sum(whole) else 0.0

    def scored(self, df: DataFrame, whole: list[int]) -> DataFrame:
        base = self._base(whole)
        df = df.withColumns({"rate": F.col("k1") / F.col("n"), "hits": F.col("k1"), "wilson": wilson(F.col("k1"), F.col("n"), empty=0.0, floor=True)})
        df = df.withColumn("lift", F.col("rate") / base if base else F.lit(0.0))
        up, lift, bound, size, cover = (F.lit(p) for p in self.powers)
        least = lambda c: F.greatest(c, F.lit(0.001))
        score = F.pow(least(F.col("rate") - base + self.margin), up) * F.pow(least(F.col("lift")), lift) * F.pow(least(F.col("wilson")), bound) * F.pow(F.log1p("n"), size) * F.pow(F.log1p("hits"), cover)
        return df.withColumn("score", score if base else F.lit(0.0))

    def saves(self, whole: list[int]) -> Column:
        return (F.col("rate") >= self._base(whole) + self.rate_up) & (F.col("lift") >= self.least_lift) & (F.col("wilson") >= self.least_wilson)

    def extends(self, whole: list[int], depth: int) -> Column:
        at = min(depth, len(self.rates_up) - 1)
        return (F.col("rate") >= self._base(whole) + self.rates_up[at]) & (F.col("lift") >= self.lifts[at])

    beam_order = (("score", True), ("wilson", True), ("rate", True), ("lift", True), ("hits", True), ("n", True))
    saved_order = (("score", True), ("wilson", True), ("rate", True), ("hits", True), ("n", True))


@dataclass(frozen=True)
class Mined:
    """A saved rule with its rows by class on the rows that it was mined on."""

    rule: Rule
    counts: tuple[int, ...]
    score: float

    @property
    def text(self) -> str:
        return text(self.rule)


# -- literals ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Grid:
    """How a feature's literals are made: one for each value if it has at most ``few`` (0: never),
    else both bounds at quantiles, and manual (op, threshold)s."""

    quantiles: str = "thirteen"
    few: int = 8
    least: int = 80
    manual: dict[str, list[tuple[str, float]]] = field(default_factory=dict)
    digits: int | None = None


def cardinalities(df: DataFrame, features: list[str], most: int) -> dict[str, dict[float, int] | None]:
    """For each feature its values and how many rows have each, None if there are more than ``most``.

    One pass: a task gives up counting a feature as soon as it has seen ``most`` + 1 values,
    so neither a task nor the driver holds more than that for a feature and task.
    """
    long = df.select(*[number(c).cast("double").alias(c) for c in features])

    def run(batches):
        seen: dict[str, dict[float, int] | None] = {c: {} for c in features}
        for b in batches:
            for c in features:
                if (held := seen[c]) is None:
                    continue
                values, counts = np.unique(b.column(c).drop_null().to_numpy(zero_copy_only=False), return_counts=True)
                for v, n in zip(values.tolist(), counts.tolist(), strict=True):
                    held[v] = held.get(v, 0) + n
                    if len(held) > most:
                        seen[c] = None
                        break
        for c, held in seen.items():
            rows = [(c, None, None)] if held is None else [(c, v, n) for v, n in held.items()]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64())], names=["feature", "value", "n"])

    found = long.mapInArrow(run, "feature string, value double, n long").groupBy("feature", "value").agg(F.sum("n").alias("n"))
    out: dict[str, dict[float, int] | None] = {c: {} for c in features}
    for r in found.groupBy("feature").agg(F.count_distinct("value").alias("d"), F.max(F.col("value").isNull()).alias("over"), F.slice(F.array_sort(F.collect_list(F.struct("value", "n"))), 1, most + 1).alias("v")).collect():
        out[r.feature] = None if r.over or r.d > most else {x.value: x.n for x in r.v}
    return out


def make_literals(df: DataFrame, features: list[str], grid: Grid) -> list[Atom]:
    """Literals of each feature that is there and has two values at least, by feature and threshold,
    that hold in ``least`` rows; a literal's rows are counted in one pass for all."""
    features = [c for c in features if c in df.columns]
    if not features:
        return []
    few = cardinalities(df, features, max(grid.few, 1))
    out: dict[tuple, Atom] = {}

    def add(feature: str, op: str, value: float, source: str):
        atom = Atom(feature, op, round(float(value), grid.digits if grid.digits is not None else 10), source)
        out.setdefault(atom.key, atom)

    wide = [c for c in features if few[c] is None or len(few[c]) > max(grid.few, 1)]
    for c in features:
        if c not in wide:
            if len(few[c]) >= 2:
                for v, n in sorted(few[c].items()):
                    if n >= grid.least:
                        add(c, "==", v, "value")
    if wide:
        for r in rules.quantile_table(df, wide, rules.GRIDS[grid.quantiles]).orderBy("feature", "q").collect():  # features times grid values
            if r.value is not None:
                for op in ("<=", ">="):
                    add(r.feature, op, r.value, f"q{r.q:.3f}")
    for c in features:
        if few[c] is None or len(few[c]) >= 2:
            for op, v in grid.manual.get(c, []):
                add(c, op, v, "manual")
    atoms = sorted(out.values(), key=lambda a: a.key)
    return [a for a, n in zip(atoms, literal_counts(df, atoms), strict=True) if n >= grid.least]


def literal_counts(df: DataFrame, atoms: list[Atom]) -> list[int]:
    """The rows in which each literal holds."""
    if not atoms:
        return []
    rows = prepared(df, sorted({a.feature for a in atoms}), F.lit(0))
    held = {r.c: r.n for r in tallies(rows, atoms, np.arange(len(atoms), dtype=np.int32)[:, None], 1).collect()}  # a row a literal
    return [held.get(i, 0) for i in range(len(atoms))]


# -- counting and mining --------------------------------------------------------------------------


def extensions(beam: np.ndarray, literals: list[Atom], groups: dict[str, str] | None = None, limits: dict[str, int] | None = None) -> np.ndarray:
    """All rules of the beam with one literal more: of a feature it lacks, within the limits of
    groups. Rules are rows of sorted literal numbers, each once and in order."""
    names = sorted({a.feature for a in literals})
    feature = np.array([names.index(a.feature) for a in literals], np.int32)
    kinds = sorted({(groups or {}).get(f, "") for f in names} & set(limits or {}))
    group = np.array([kinds.index(g) if (g := (groups or {}).get(a.feature, "")) in kinds else -1 for a in literals], np.int32)
    out = []
    for i in range(0, len(beam), 1024):
        part = beam[i : i + 1024]
        free = np.ones((len(part), len(literals)), bool)
        for j in range(part.shape[1]):
            free &= feature[part[:, j]][:, None] != feature[None]
        for k, name in enumerate(kinds):
            used = (group[part] == k).sum(1) if part.shape[1] else np.zeros(len(part), int)
            free &= ~((used[:, None] >= limits[name]) & (group[None] == k))
        row, lit = np.nonzero(free)
        out.append(np.sort(np.concatenate((part[row], lit[:, None].astype(np.int32)), 1), 1))
    return np.unique(np.concatenate(out), axis=0) if out else beam[:0]


def tallies(rows: DataFrame, literals: list[Atom], candidates: np.ndarray, classes: int, chunk: int = 4096) -> DataFrame:
    """c, n, k0, k1, ...: rows and rows of each class of every candidate (a row of literal numbers)
    that holds anywhere. ``rows`` has the features and ``k``, the class."""
    used = np.unique(candidates)
    atoms = {int(i): literals[i] for i in used}
    place = np.zeros(len(literals), np.int64)
    place[used] = np.arange(len(used))
    local = place[candidates]
    names = sorted({a.feature for a in atoms.values()})

    def packed(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1).view(np.uint64)

    def run(batches):
        total = np.zeros((len(local), classes), np.int64)
        for b in batches:
            n = -(-b.num_rows // 64) * 64
            cols = {c: b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names}
            bits = np.zeros((len(atoms), n), bool)
            with np.errstate(invalid="ignore"):
                for j, a in enumerate(atoms.values()):
                    x = cols[a.feature]
                    bits[j, : b.num_rows] = x >= a.threshold if a.op == ">=" else x <= a.threshold if a.op == "<=" else x > a.threshold if a.op == ">" else x == a.threshold
            k = np.full(n, -1)
            k[: b.num_rows] = b.column("k").to_numpy(zero_copy_only=False)
            literal, kind = packed(bits), packed(k[None] == np.arange(classes)[:, None])
            for i in range(0, len(local), chunk):
                part = local[i : i + chunk]
                mask = literal[part[:, 0]]
                for j in range(1, part.shape[1]):
                    mask &= literal[part[:, j]]
                for c in range(classes):
                    total[i : i + chunk, c] += np.bitwise_count(mask & kind[c]).sum(1, dtype=np.int64)
        some = np.flatnonzero(total.sum(1))
        for i in range(0, len(some), 100_000):
            at = some[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(total[at, c]) for c in range(classes))], names=["c", *(f"k{c}" for c in range(classes))])

    schema = "c long, " + ", ".join(f"k{c} long" for c in range(classes))
    parts = rows.select(*names, "k").mapInArrow(run, schema)
    out = parts.groupBy("c").agg(*[F.sum(f"k{c}").alias(f"k{c}") for c in range(classes)])
    return out.withColumn("n", sum(F.col(f"k{c}") for c in range(classes)))


def prepared(df: DataFrame, features: list[str], klass: Column, *more: Column | str) -> DataFrame:
    """What a pass reads: the features as finite numbers, and the class. Rows without one are left out."""
    return df.select(*[number(c).cast("double").alias(c) for c in features], klass.cast("int").alias("k"), *more).where(F.col("k").isNotNull())


def mine(rows: DataFrame, literals: list[Atom], goal: StopGoal | NoBounceGoal | BroadGoal, sizes: Sizes = Sizes(), groups: dict[str, str] | None = None, limits: dict[str, int] | None = None) -> list[Mined]:
    """The ``top`` saved rules, best first; ties go by the rules' literals.

    Differs from a heap per process in one way: a rule that two parents lead to is in the
    beam once, so that it takes no other's place.
    """
    literals = sorted(literals, key=lambda a: a.key)
    found = {r.k: r.n for r in rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a class
    whole = [found.get(k, 0) for k in range(goal.classes)]
    beam, saved = np.zeros((1, 0), np.int32), []
    key: Order = [("c", False)]
    for depth in range(sizes.depth):
        candidates = extensions(beam, literals, groups, limits)
        next_beam, kept = [], []
        for i in range(0, len(candidates), sizes.block):
            part = candidates[i : i + sizes.block]
            scored = goal.scored(tallies(rows, literals, part, goal.classes).where(F.col("n") >= sizes.least), whole).persist()
            try:
                kept += [(part[r.c], r) for r in top_k(scored.where(goal.saves(whole)), sizes.top, [*goal.saved_order, *key]).collect()]
                next_beam += [(part[r.c], r) for r in top_k(scored.where(goal.extends(whole, depth)), sizes.beam, [*goal.beam_order, *key]).collect()]
            finally:
                scored.unpersist()
        saved += kept
        next_beam.sort(key=lambda x: (*_sort_key(x[1], goal.beam_order), tuple(x[0])))
        beam = np.array([c for c, _ in next_beam[: sizes.beam]], np.int32).reshape(-1, depth + 1)
        if not len(beam):
            break
    saved.sort(key=lambda x: (*_sort_key(x[1], goal.saved_order), len(x[0]), tuple(x[0])))
    return [Mined(canonical(literals[i] for i in c), tuple(r[f"k{k}"] for k in range(goal.classes)), r.score) for c, r in saved[: sizes.top]]


def _sort_key(row, order) -> tuple:
    return tuple(-row[c] if down else row[c] for c, down in order)
