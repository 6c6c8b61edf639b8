"""Rules: text, compatibility, compilation, search and selection against brute force."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import forecast, metrics, rules, search, selection
from tidemark.operators.rules import Atom


@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from([">=", "<=", ">", "=="]), st.floats(-1e5, 1e5).map(lambda x: round(x, 4))), max_size=4))
@settings(max_examples=80, deadline=None)
def test_text_round_trip(atoms):
    rule = rules.canonical([Atom(*a) for a in atoms])
    assert [a.key for a in rules.parse(rules.text(rule))] == [a.key for a in rule]


def test_odd_values_match_nothing(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (float("inf"),), (1.0,)], "f double")
    for op, want in ((">=", 1), ("<=", 1), (">", 0), ("==", 1)):
        assert df.where(rules.atom_column(Atom("f", op, 1.0))).count() == want
    assert df.where(rules.rule_column(())).count() == 4 and df.where(rules.set_column([])).count() == 0
    assert df.where(rules.rule_column((Atom("gone", ">=", 0.0),), df.columns)).count() == 0


def test_compatibility():
    low, high = Atom("f", ">=", 1.0), Atom("f", "<=", 2.0)
    assert not rules.can_add((low,), high)
    assert rules.can_add((low,), high, intervals=frozenset("f"))
    assert not rules.can_add((Atom("f", ">=", 3.0),), high, intervals=frozenset("f"))
    assert not rules.can_add((low, high), Atom("f", ">=", 1.5), intervals=frozenset("f"))
    assert not rules.can_add((low,), Atom("g", ">=", 1.0), correlated=frozenset([frozenset("fg")]))
    assert not rules.can_add((low,), Atom("g", ">=", 1.0), groups={"f": "v", "g": "v"}, limits={"v": 1})


def panel(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n).round(3), rng.integers(0, 6, n).astype(float)
    y = rng.random(n) < 1 / (1 + np.exp(-1.5 * a + 0.3 * b))
    rows = [(i, float(a[i]), float(b[i]) if i % 11 else None, bool(y[i]), float(np.where(y[i], 10.0, -6.0)), SPLIT[min(2, i * 5 // (3 * n)) if i < n * 0.6 else (1 if i < n * 0.8 else 2)], f"m{i % 8}") for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, y boolean, ret double, split string, month string")


SPLIT = search.SPLITS


def test_few_distinct_values_make_no_atoms(spark):
    df = spark.createDataFrame([(float(i % 7), float(i % 8)) for i in range(56)], "seven double, eight double")
    assert {a.feature for a in rules.make_atoms(df, ["seven", "eight"])} == {"eight"}
    held = rules.make_atoms(df, ["eight"], [0.5], manual={"eight": [(">=", 3.5), ("<=", 9.0)]})
    assert [(a.op, a.threshold, a.source) for a in held] == [(">=", 3.5, "q0.500"), ("<=", 3.5, "q0.500"), ("<=", 9.0, "manual")]
    assert len(rules.literals(df, ["seven"])) == 14


def test_sums_equal_plain_counts(spark):
    df = panel(spark).repartition(3)
    pdf = df.toPandas()
    atoms = [Atom("a", ">=", 0.1), Atom("a", "<=", 0.8), Atom("b", "<=", 3.0), Atom("b", "==", 2.0)]
    cand = [(), *itertools.combinations(range(4), 1), (0, 1), (0, 2), (0, 1, 2)]
    rows = search.prepared(df, ["a", "b"], F.col("y"), F.col("ret"), ["id"], F.col("month"))
    got = search.sums(rows, atoms, cand, by_month=True)
    tests = [pdf.a >= 0.1, pdf.a <= 0.8, pdf.b <= 3, pdf.b == 2]
    for c, ids in enumerate(cand):
        m = np.logical_and.reduce([np.ones(len(pdf), bool), *[tests[i] for i in ids]])
        for (split, month), g in pdf[m].groupby(["split", "month"]):
            v = got[c, split, month]
            assert v[:3] == [len(g), g.y.sum(), g.ret.sum()]
    native = {r.rule: r for r in metrics.many_rules(df, {"r": rules.rule_column((atoms[0], atoms[2]))}, F.col("y")).collect()}["r"]
    plain = search.metrics([sum(got[6, s, m][i] for s in SPLIT for m in [f"m{k}" for k in range(8)] if (6, s, m) in got) for i in range(5)], [len(pdf), pdf.y.sum()])
    assert native.precision == pytest.approx(plain["precision"]) and native.lift == pytest.approx(plain["lift"]) and native.precision_lcb == pytest.approx(plain["lcb"])


def test_beam_finds_the_best_rule_of_all(spark):
    df = panel(spark, 900, 2)
    cfg = search.Config(max_depth=2, beam_width=500, min_train_count=20, min_selection_count=8, min_train_precision=0, min_selection_precision=0, min_train_lift=0, min_selection_lift=0, min_selection_lcb=0, min_selection_avg_return=-99, max_precision_gap=1, beam_min_count=20, beam_min_lift=0, fast_min_selection_count=1, fast_min_selection_precision=0, fast_min_selection_lift=0, fast_min_selection_avg_return=-99, min_month_count=1, min_selection_usable_months=0, min_selection_pass_month_rate=0, min_selection_month_min_precision=0, min_selection_month_min_return=-99, max_selection_crash_months=99)
    rows = search.prepared(df, ["a", "b"], F.col("y"), F.col("ret"), ["id"], F.col("month"))
    atoms = rules.make_atoms(df, ["a", "b"], "decile", least_distinct=5)
    found = search.beam_search(rows, atoms, cfg)
    every = [rules.canonical(x) for k in (1, 2) for x in itertools.combinations(atoms, k) if len({a.feature for a in x}) == k]
    best = max(search.evaluate(rows, every, cfg), key=lambda f: (f.score, f.text))
    assert found[0].score == pytest.approx(best.score) and [f.score for f in found] == sorted((f.score for f in found), reverse=True)
    assert len({f.mask[0] for f in found}) == len(found)
    assert search.simplified(rows, found[0], cfg).score > search.FAILED / 10


def test_empty_rule_metrics():
    m = search.metrics(None, [10, 3])
    assert m["n"] == 0 and math.isnan(m["precision"]) and math.isnan(m["lift"]) and m["pos_recall"] == 0
    assert math.isnan(search.metrics([4, 0, 8, 8, 0], [10, 0])["lift"]) and math.isnan(search.metrics([4, 0, 8, 8, 0], [10, 0])["profit_factor"])
    assert search.month_stats({}, 0, "selection", search.Config())["crash"] == 999


def test_unions_in_numpy_and_in_spark_agree(spark):
    df = panel(spark)
    rows = search.prepared(df, ["a", "b"], F.col("y"), F.col("ret"), ["id"], F.col("month"))
    some = [rules.parse(t) for t in ("a >= 0.5", "b <= 1", "a <= -1", "a >= 0 AND b <= 3")]
    sets = [(0,), (0, 1), (1, 2, 3), (0, 1, 2, 3)]
    here, there = selection.Patterns(rows, some), selection.Patterns(rows, some, most=2)
    assert there.held is None and here.union(sets) == there.union(sets)
    n = df.where(rules.set_column([some[1], some[2], some[3]]) & (F.col("split") == "train")).count()
    assert here.union(sets)[2]["train"]["n"] == n
    every = selection.SetGates(selection=(1, 0.0, 0.0, -99.0), final=(1, 0.0, 0.0, -99.0), forward=(0.0, 0.0, -99.0, 0.0, 999))
    best = selection.exhaustive(here, [rules.text(r) for r in some], every)
    assert best == selection.exhaustive(there, [rules.text(r) for r in some], every) and best[0]["score"] == max(b["score"] for b in best)
    assert selection.exhaustive(here, [rules.text(r) for r in some]) == []  # the set search's own bounds are strict
    months = sorted(r.month for r in df.select("month").distinct().collect())
    ahead = [selection.Patterns(selection.by_months(rows, months), some, most=m) for m in (2, 200_000)]
    more = [selection.exhaustive(here, [rules.text(r) for r in some], every, a) for a in ahead]
    assert more[0] == more[1] and sorted(x["members"] for x in more[0]) == sorted(x["members"] for x in best)
    for x in more[0]:
        hit = rules.set_column([rules.parse(t) for t in x["members"]])
        use = [r for r in df.where(hit).groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y").cast("int")).alias("p"), F.avg("ret").alias("r")).collect() if r.n >= 5]
        crash = sum(r.p < 0.3 or r.r < -1 for r in use) if use else len(months)
        p, low, r = (np.mean([u.p for u in use]), min(u.p for u in use), np.mean([u.r for u in use])) if use else (0, 0, 0)
        was = next(b["score"] for b in best if b["members"] == x["members"])
        assert x["score"] == pytest.approx(was + 55 * p + 45 * low + 25 * r - 25 * crash)
    for x in selection.greedy_all(here, [rules.text(r) for r in some]):
        assert len(set(x["members"])) == len(x["members"])


def test_splits(spark):
    df = spark.createDataFrame([(i // 3, i) for i in range(30)], "today int, id int")
    got = metrics.date_split(df).groupBy("split").agg(F.countDistinct("today").alias("n")).collect()
    assert {r.split: r.n for r in got} == {"train": 6, "selection": 2, "final": 2}
    two = metrics.date_split(df.where("today < 2")).groupBy("split").count().collect()
    assert sum(r["count"] for r in two) == 6
    assert {r.split: r["count"] for r in metrics.row_split(df, ["today", "id"]).groupBy("split").count().collect()} == {"train": 21, "valid": 9}


def test_forward_months_round_half_to_even():
    months = [f"2020-{i:02d}" for i in range(1, 13)] + ["2021-01", "2021-02"]
    later = months[6:]
    assert search.forward_months(months) == [later[i] for i in sorted({round(i * 7 / 5) for i in range(6)})]
    assert search.forward_months(months[:6]) == []


def test_forecast_parts_do_not_leak(spark):
    import datetime as dt

    n = 80
    df = spark.createDataFrame([("A", dt.date(2024, 1, 1) + dt.timedelta(i), float(i)) for i in range(n)], "instrument string, session date, close double")
    got = forecast.windows(df).collect()
    assert max(r.y[-1] for r in got if r.part == "train") < 60 <= min(r.x[0] for r in got if r.part == "valid")
    assert [r.base for r in got if r.part == "predict"] == [77.0, 78.0, 79.0]
    out = forecast.forecast(forecast.windows(df)).where("part = 'predict'").orderBy("session").collect()
    assert out[-1].predicted == pytest.approx([80, 81, 82], abs=0.5)
    r = spark.range(1).select(forecast.recursive(F.array(F.lit(1.0), F.lit(2.0)), lambda x: x[0] + x[1], 4).alias("v")).first()
    assert r.v == [3.0, 5.0, 8.0, 13.0]
