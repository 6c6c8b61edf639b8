"""Quantiles by bits, run summaries, rule modules, shuffled columns and small reports."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import importance, metrics, quantiles, rules, scoring, topk
from tidemark.operators.rules import Atom
from tidemark.sources import modules, summaries

GRID = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.9, 1.0]


def test_quantiles_equal_percentiles(spark):
    rng = random.Random(3)
    odd = [0.0, -0.0, 1e-320, -1e-320, 1e300, -1e300, float("inf"), float("-inf"), 0.1, 0.1, float("nan"), None]
    rows = [(rng.choice(["a", "b", None]), rng.choice([*odd, rng.gauss(0, 1), float(rng.randint(-3, 3))]), float(i), None) for i in range(3000)] + [("one", 7.5, None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double").repartition(5)
    got = {(r.g, r.feature, r.q): r.value for r in quantiles.quantiles(df, ["x", "y", "z"], GRID, ["g"]).collect()}
    groups = {r[0] for r in rows}
    for g in groups:
        for i, f in ((1, "x"), (2, "y"), (3, "z")):
            values = np.array(sorted(r[i] for r in rows if r[0] == g and r[i] is not None and not math.isnan(r[i])))
            for q in GRID:
                if not len(values):
                    assert (g, f, q) not in got
                    continue
                at = q * (len(values) - 1)
                low, high = values[math.floor(at)], values[math.ceil(at)]
                want = low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high
                assert got[g, f, q] == want or (math.isnan(want) and math.isnan(got[g, f, q]))
    plain = df.where("y is not null").agg(F.percentile("y", F.array(*[F.lit(q) for q in GRID])).alias("p")).first().p
    whole = {r.q: r.value for r in quantiles.quantiles(df, ["y"], GRID).collect()}
    assert [whole[q] for q in GRID] == plain


def test_no_task_holds_a_groups_values(spark):
    plan = quantiles.quantiles(spark.range(100).selectExpr("id * 1.0D as x"), ["x"], [0.5])._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("percentile", "collect_list", "collect_set", "SortAggregate"))
    assert quantiles.quantiles(spark.createDataFrame([], "x double"), ["x"], [0.5]).collect() == []


def test_ordered_bits_order_like_values(spark):
    values = [float("-inf"), -1e300, -2.0, -1.0, -1e-320, 0.0, 1e-320, 0.5, 1.0, 2.0, 1e300, float("inf")]
    df = spark.createDataFrame([(v,) for v in [*values, -0.0]], "v double").select("v", quantiles.ordered_bits(F.col("v")).alias("b"))
    bits = {str(r.v): r.b for r in df.collect()}
    assert [bits[str(v)] for v in values] == sorted(bits[str(v)] for v in values) and bits["-0.0"] == bits["0.0"]
    assert [r[0] for r in df.select(quantiles.from_ordered_bits(F.col("b"))).collect()] == [*values, 0.0]


def test_summaries_are_taken_in_the_pass_that_writes(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(i, float(i) if i % 5 else None) for i in range(100)], "i long, x double").mapInArrow(counting, "i long, x double")
    run = summaries.Run(spark, str(tmp_path), "2024-01")
    got = run.write(df, "rows", {"total": F.sum("x"), "top": F.max("x"), "none": F.sum(F.lit(None).cast("double"))})
    assert got == {"rows": 100, "total": float(sum(i for i in range(100) if i % 5)), "top": 99.0} and seen.value == 100
    run.write(run.read("rows").where("i < 0"), "empty", {"total": F.sum("x")})
    summaries.Run(spark, str(tmp_path), "2024-02").write(run.read("rows").where("i < 10"), "rows", {"top": F.max("x")})
    found = {(r.run, r.artefact): (r.rows, r.metrics) for r in summaries.summaries(spark, str(tmp_path)).collect()}
    assert found["2024-01", "empty"] == (0, {}) and found["2024-02", "rows"] == (10, {"top": 9.0}) and len(found) == 3
    assert {r.artefact: (r.run, r.rows) for r in summaries.latest(summaries.summaries(spark, str(tmp_path))).collect()} == {"rows": ("2024-02", 10), "empty": ("2024-01", 0)}
    with pytest.raises(ValueError):
        run.write(df, "rows", {"rows": F.count("i")})


ATOMS = st.lists(st.tuples(st.sampled_from(["a", "b", "it's"]), st.sampled_from(rules.OPS), st.floats(allow_nan=False, allow_infinity=False)), max_size=4)


@given(st.lists(ATOMS, max_size=5))
@settings(max_examples=60, deadline=None)
def test_modules_round_trip(found):
    catalog = [(f"rule {i}", rules.canonical(Atom(*a) for a in atoms), {"n": float(i)}) for i, atoms in enumerate(found)]
    text = modules.source(catalog)
    assert modules.parsed(text) == catalog and modules.source(modules.parsed(text)) == text


def test_modules_apply_as_the_operator_does(spark, tmp_path):
    catalog = [("low", rules.parse("x <= 1.5 AND y > 0"), {"n": 3.0}), ("eq", (Atom("y", "==", 2.0, "value"),), {}), ("all", (), {}), ("gone", rules.parse("absent >= 1"), {})]
    modules.write(spark, f"{tmp_path}/rules/mined.py", catalog)
    modules.write(spark, f"{tmp_path}/rules/mined.py", catalog, "Again.")
    text = modules.read(spark, f"{tmp_path}/rules/mined.py")
    module = modules.loaded(text)
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (None, 1.0), (float("nan"), 0.0), (1.5, None)], "x double, y double")
    got = df.select("*", module.mask(df).alias("m"), module.names(df).alias("names")).collect()
    want = rules.applied(df, [(n, r, "stable") for n, r, _ in catalog]).collect()
    assert [(r.m, r.names) for r in got] == [(r.signal, r.rule_names) for r in want]
    assert [(r.rule_id, r.rule) for r in modules.catalog_frame(spark, text).orderBy("rule_id").collect()] == sorted((n, rules.text(r)) for n, r, _ in catalog)
    namespace = {}
    exec(text, namespace)  # importable without this package
    assert df.where(namespace["build"](df)["low"]).count() == 1


def test_modules_of_others_are_not_run():
    text = modules.source([("a", rules.parse("x >= 1"), {})])
    with pytest.raises(ValueError, match="changed by hand"):
        modules.loaded(text.replace("def mask(df):", "import os\n\n\ndef mask(df):"))
    for bad in ("RULES = {'a': [('x', '!=', 1.0)]}", "RULES = {'a': [__import__('os')]}", "OTHER = {}"):
        with pytest.raises(ValueError):
            modules.parsed(bad)
    with pytest.raises(ValueError):
        modules.source([("a", (), {}), ("a", (), {})])


def test_shuffled_columns_are_permutations(spark):
    df = spark.createDataFrame([(i, float(i % 17)) for i in range(500)], "k long, v double").repartition(7)
    one, two = (sorted((r.k, r.v, r.other_v) for r in importance.shuffled(df, ["k"], ["v"], s).collect()) for s in (1, 2))
    assert [r[:2] for r in one] == [(i, float(i % 17)) for i in range(500)]
    assert sorted(r[2] for r in one) == sorted(r[1] for r in one) and one != two and sum(r[1] == r[2] for r in one) < 100
    assert one == sorted((r.k, r.v, r.other_v) for r in importance.shuffled(df.repartition(3), ["k"], ["v"], 1).collect())
    assert sorted(r.at for r in importance.numbered(df, ["v", "k"], "at").collect()) == list(range(500))


def test_the_true_lag_ranks_first(spark):
    rng = np.random.default_rng(1)
    x, z = rng.normal(size=(1200, 4)), rng.normal(size=(1200, 4))
    y = 3 * x[:, 2] + 0.5 * z[:, 3] + 0.1 * rng.normal(size=1200)
    rows = [(i, [float(v) for v in x[i]], [float(v) for v in z[i]], float(y[i]), i % 3 > 0) for i in range(1200)]
    frames, names = importance.flat(spark.createDataFrame(rows, "k long, x array<double>, z array<double>, y double, train boolean"), ["x", "z"], 4, ["k", "y", "train"])
    model = importance.fitted(frames.where("train"), names, "y", trees=15)
    found = importance.permutation(model, frames.where("not train"), ["k"], names, "y", seeds=(1, 2))
    got = {r.input: r.importance for r in found.collect()}
    assert sorted(got, key=got.get, reverse=True)[:2] == ["x_t-1", "z_t-0"] and got["x_t-1"] > 0.5 and set(got) == set(names)
    base = {r.feature: r.importance for r in importance.by_base(found).collect()}
    assert base == pytest.approx({f: sum(max(0.0, v) for n, v in got.items() if n.startswith(f)) for f in "xz"})
    assert importance.permutation(model, frames.where("k < 0"), ["k"], names, "y").collect() == []


def test_small_reports(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 3), ("a", 1), ("b", None), ("b", 5), ("c", None)], "g string, v int")
    assert sorted((r.g, r.value, r.n) for r in metrics.mode(df, "v", ["g"]).collect()) == [("a", 1, 2), ("b", 5, 1)]
    assert sorted((r.g, r.v, r.place) for r in topk.head(df.where("v is not null"), 1, ["g"], [F.desc("v")]).collect()) == [("a", 3, 1), ("b", 5, 1)]
    left, right = spark.createDataFrame([("x", 1), ("y", 2)], "rule string, n int"), spark.createDataFrame([("x", 0.5, 3)], "rule string, p double, crash int")
    assert sorted(map(tuple, scoring.joined_report(left, right, ["rule"], {"p": 0.0, "crash": 99}).collect())) == [("x", 1, 0.5, 3), ("y", 2, 0.0, 99)]
