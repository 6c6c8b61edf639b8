"""Atoms, rules and rule sets: generation, text, compilation to columns, catalog.

An atom compares a feature with a threshold, a rule is the conjunction of its atoms, a
rule set the disjunction of its rules. Values that aren't finite numbers match nothing.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import number

# The quantile grids.
GRIDS = {
    "decile": [i / 10 for i in range(1, 10)],
    "v4": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 0.975],
    "fine": [0.025, 0.05, 0.075, 0.1, 0.125, 0.15, 0.175, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.825, 0.85, 0.875, 0.9, 0.925, 0.95, 0.975],
    "twenty": [0.02 + i * (0.96 / 19) for i in range(20)],
    "thirteen": [0.1 + i * (0.8 / 12) for i in range(13)],
}
OPS = (">=", "<=", ">", "==")


@dataclass(frozen=True, order=True)
class Atom:
    feature: str
    op: str
    threshold: float
    source: str = ""

    def __str__(self) -> str:
        return f"{self.feature} {self.op} {shown(self.threshold)}"

    @property
    def key(self) -> tuple:
        return self.feature, self.op, round(self.threshold, 10)


Rule = tuple[Atom, ...]


def shown(x: float) -> str:
    """Up to ten decimals without trailing zeros; very small or large values in %g."""
    if x and not 1e-4 <= abs(x) < 1e6:
        return f"{x:g}"
    return f"{x:.10f}".rstrip("0").rstrip(".") or "0"


def canonical(atoms) -> Rule:
    return tuple(sorted(atoms, key=lambda a: a.key))


def text(rule: Rule) -> str:
    return " AND ".join(map(str, canonical(rule)))


def parse(rule: str) -> Rule:
    """The inverse of text()."""
    out = []
    for part in filter(None, (p.strip() for p in rule.split(" AND "))):
        m = re.fullmatch(r"(\w+)\s*(>=|<=|==|>)\s*(\S+)", part)
        if not m:
            raise ValueError(f"no atom: {part!r}")
        out.append(Atom(m[1], m[2], float(m[3])))
    return canonical(out)


def atom_column(atom: Atom, columns: list[str] | None = None) -> Column:
    """True or false, never null; false for a column that isn't there."""
    if columns is not None and atom.feature not in columns:
        return F.lit(False)
    x, t = number(F.col(atom.feature)), F.lit(float(atom.threshold))
    hit = {">=": x >= t, "<=": x <= t, ">": x > t, "==": x == t}[atom.op]
    return F.coalesce(hit, F.lit(False))


def rule_column(rule: Rule, columns: list[str] | None = None) -> Column:
    """All atoms hold; the empty rule holds everywhere."""
    return reduce(lambda a, b: a & b, [atom_column(a, columns) for a in rule], F.lit(True))


def set_column(rules: list[Rule], columns: list[str] | None = None) -> Column:
    """Any rule holds; the empty set holds nowhere."""
    return reduce(lambda a, b: a | b, [rule_column(r, columns) for r in rules], F.lit(False))


def eligible(df: DataFrame, least_distinct: int = 8, exclude_prefixes: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns with values and at least so many distinct ones, in one aggregation."""
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    names = [c for c, t in df.dtypes if (t in kinds or t.startswith("decimal")) and not c.startswith(exclude_prefixes or ("\0",))]
    if not names:
        return []
    found = df.agg(*[F.count_distinct(c).alias(c) for c in names]).first()
    return [c for c in names if found[c] >= least_distinct]


#: Columns that tell the outcome, by prefix: never features.
OUTCOMES = ("validation_", "day_to_", "target_", "stop_", "no_target_", "fast_success_", "slow_success_", "fail_success_", "ret")


def quantile_table(df: DataFrame, features: list[str], grid: list[float]) -> DataFrame:
    """feature, q, value: linear quantiles of all features from one aggregation."""
    qs = F.array(*[F.lit(q) for q in grid])
    wide = df.agg(*[F.percentile(number(c), qs).alias(c) for c in features])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.arrays_zip(qs.alias("q"), F.col(c).alias("value")).alias("z")) for c in features]))).select("feature", F.inline("z"))


def make_atoms(df: DataFrame, features: list[str], grid: str | list[float] = "v4", ops: dict[str, list[str]] | None = None, manual: dict[str, list[tuple[str, float]]] | None = None, least_distinct: int = 8) -> list[Atom]:
    """Atoms at quantiles of each feature with enough distinct values, then manual ones.

    Of equal (feature, op, threshold) the first source stays. The driver gets the
    quantiles: features times grid values.
    """
    grid = GRIDS[grid] if isinstance(grid, str) else grid
    features = [c for c in features if c in df.columns]
    if not features:
        return []
    distinct = df.agg(*[F.count_distinct(number(c)).alias(c) for c in features]).first()
    features = [c for c in features if distinct[c] >= least_distinct]
    if not features:
        return []
    values = {(r.feature, r.q): r.value for r in quantile_table(df, features, grid).collect()}
    out: dict[tuple, Atom] = {}
    for c in features:
        for q in grid:
            if (v := values.get((c, q))) is not None:
                for op in (ops or {}).get(c, [">=", "<="]):
                    a = Atom(c, op, round(float(v), 10), f"q{q:.3f}")
                    out.setdefault(a.key, a)
        for op, v in (manual or {}).get(c, []):
            a = Atom(c, op, round(float(v), 10), "manual")
            out.setdefault(a.key, a)
    return list(out.values())


def literals(df: DataFrame, features: list[str], few: int = 50) -> list[Atom]:
    """``<=`` and ``>`` at every value of features with under ``few`` distinct values, else at deciles."""
    distinct = df.agg(*[F.count_distinct(number(c)).alias(c) for c in features]).first()
    small = [c for c in features if distinct[c] < few]
    out = []
    if small:
        held = df.agg(*[F.array_sort(F.collect_set(number(c))).alias(c) for c in small]).first()  # under ``few`` values each
        out += [(c, v) for c in small for v in held[c]]
    if rest := [c for c in features if distinct[c] >= few]:
        out += sorted({(r.feature, round(r.value, 4)) for r in quantile_table(df, rest, GRIDS["decile"]).collect() if r.value is not None})
    return [Atom(c, op, float(v)) for c, v in out for op in ("<=", ">")]


def gated_atoms(df: DataFrame, atoms: list[Atom], y: Column, least: int = 100, precision: float = 0.0, lift: float = 1.0) -> list[Atom]:
    """Atoms that reach a count, precision and lift on their own."""
    from tidemark.operators.metrics import many_rules

    rows = many_rules(df, {str(i): atom_column(a) for i, a in enumerate(atoms)}, y).collect()
    good = {int(r.rule) for r in rows if r.selected_count >= least and (r.precision or 0) >= precision and (r.lift or 0) >= lift}
    return [a for i, a in enumerate(atoms) if i in good]


def can_add(rule: Rule, atom: Atom, intervals: frozenset[str] = frozenset(), correlated: frozenset[frozenset] = frozenset(), groups: dict[str, str] | None = None, limits: dict[str, int] | None = None) -> bool:
    """One atom a feature, or two opposite bounds that leave room for interval features;
    no feature correlated with one already used; no more atoms of a group than its limit."""
    same = [a for a in rule if a.feature == atom.feature]
    if same:
        if atom.feature not in intervals or len(same) > 1 or same[0].op == atom.op:
            return False
        low, high = sorted((same[0], atom), key=lambda a: a.op != ">=")
        return low.threshold <= high.threshold
    if any(frozenset((a.feature, atom.feature)) in correlated for a in rule):
        return False
    if groups and limits and (g := groups.get(atom.feature)) in limits:
        return sum(groups.get(a.feature) == g for a in rule) < limits[g]
    return True


def applied(df: DataFrame, catalog: list[tuple[str, Rule, str]], weights: dict[str, float] | None = None) -> DataFrame:
    """Adds signal, rule_names, rule_count and rule_priority (weights by style) for (name, rule, style)s."""
    weights = weights or {"high_precision": 3.0, "stable": 3.0, "coverage": 2.0}
    cols = df.columns
    hits = F.filter(F.array(*[F.when(rule_column(r, cols), F.struct(F.lit(n).alias("name"), F.lit(weights.get(s, 1.0)).alias("w"))) for n, r, s in catalog]), lambda x: x.isNotNull())
    df = df.withColumn("_hits", hits)
    return df.withColumns(
        {
            "signal": F.size("_hits") > 0,
            "rule_names": F.array_join(F.transform("_hits", lambda x: x["name"]), ","),
            "rule_count": F.size("_hits"),
            "rule_priority": F.aggregate("_hits", F.lit(0.0), lambda s, x: s + x["w"]),
        }
    ).drop("_hits")


def good_minus_avoid(df: DataFrame, good: dict[str, Rule], stop: dict[str, Rule], bounce: dict[str, Rule]) -> DataFrame:
    """Rows that a good rule picks and no avoid rule rejects, as ``selected``, with the flags and names."""
    cols = df.columns
    names = lambda rules: F.array_join(F.filter(F.array(*[F.when(rule_column(r, cols), F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull()), ",")
    df = df.withColumns({"good_names": names(good), "stop_avoid_names": names(stop), "bounce_avoid_names": names(bounce)})
    flags = {f"{k}_any": (F.col(f"{k}_names") != "").cast("int") for k in ("good", "stop_avoid", "bounce_avoid")}
    df = df.withColumns(flags).withColumn("avoid_any", F.greatest("stop_avoid_any", "bounce_avoid_any"))
    return df.withColumn("selected", F.when((F.col("good_any") == 1) & (F.col("avoid_any") == 0), 1).otherwise(0))


def first_match(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds first_rule: the number of the first rule that holds, null for none."""
    cols = df.columns
    return df.withColumn("first_rule", F.coalesce(*[F.when(rule_column(r, cols), F.lit(i)) for i, r in enumerate(rules)], F.lit(None).cast("int")))


def to_frame(spark: SparkSession, rules: list[tuple[str, Rule, dict]]) -> DataFrame:
    """A catalog table: rule_id, rule, atoms, and metrics as JSON."""
    rows = [(i, text(r), [(a.feature, a.op, a.threshold, a.source) for a in r], json.dumps(m, sort_keys=True, default=float)) for i, r, m in rules]
    return spark.createDataFrame(rows, "rule_id string, rule string, atoms array<struct<feature:string,op:string,threshold:double,source:string>>, metrics string")


def from_frame(df: DataFrame) -> list[tuple[str, Rule, dict]]:
    """A catalog's rules, in order of rule_id."""
    return [(r.rule_id, tuple(Atom(*a) for a in r.atoms), json.loads(r.metrics)) for r in df.orderBy("rule_id").collect()]


def signatures(df: DataFrame) -> DataFrame:
    """family (features with ops), feature_set and pairs of a catalog table."""
    family = F.array_join(F.array_sort(F.transform("atoms", lambda a: F.concat(a["feature"], a["op"]))), "|")
    names = F.array_sort(F.array_distinct(F.transform("atoms", lambda a: a["feature"])))
    pairs = F.flatten(F.transform(names, lambda a: F.transform(F.filter(names, lambda b: b > a), lambda b: F.concat_ws("+", a, b))))
    return df.withColumns({"family": family, "feature_set": F.array_join(names, "|"), "pairs": F.array_join(pairs, ",")})
