"""Avoid miners and scenarios against plain versions: full sorts, masks and trying everything."""

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import heapminer as H
from tidemark.operators import scenarios as S
from tidemark.operators.rules import Atom, canonical
from tidemark.operators.search import lcb
from tidemark.operators.topk import Bounded, top_k
from tidemark.plans import avoid, registry, scenario_config

SF = "/root/testdata/sf0.01"


# -- bounded top-k ---------------------------------------------------------------------------


@pytest.mark.parametrize("k", [0, 1, 7, 100, 5000])
@pytest.mark.parametrize("parts", [1, 3, 17])
def test_top_k_equals_a_full_sort(spark, k, parts):
    rng = random.Random(k)
    rows = [(i, rng.choice([None, float(rng.randint(0, 9))]), rng.choice("abc")) for i in range(2000)]
    df = spark.createDataFrame(rows, "key long, score double, name string").repartition(parts)
    got = [tuple(r) for r in top_k(df, k, [("score", True), ("name", False), ("key", False)]).collect()]
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2], r[0]))[:k]
    assert sorted(got) == sorted(want)


def test_bounded_tops_merge_like_one(spark):
    import pyarrow as pa

    rng = random.Random(2)
    table = pa.table({"v": [rng.randint(0, 50) for _ in range(9000)], "key": list(range(9000))})
    one = Bounded(40, [("v", True), ("key", False)])
    one.take(table)
    parts = []
    for i in range(0, 9000, 700):
        part = Bounded(40, [("v", True), ("key", False)])
        for j in range(i, min(i + 700, 9000), 130):
            part.take(table.slice(j, min(130, i + 700 - j)))
        parts.append(part)
    merged = parts[0]
    for p in parts[1:]:
        merged.take(p.best())
    assert merged.best().to_pylist() == one.best().to_pylist()
    assert max(p.rows for p in parts) <= 2 * 40 + 1024


# -- literals and mining -----------------------------------------------------------------------


def panel(n=600, seed=5, classes=2):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=n).round(2), rng.integers(0, 4, n).astype(float), rng.normal(size=n).round(1)
    signal = a + 0.7 * (b == 2) + rng.normal(size=n)
    k = (signal > 0.6).astype(int) if classes == 2 else np.digitize(signal, [-1, 0.5, 1.5])
    a[rng.random(n) < 0.05] = np.nan
    rows = [(None if math.isnan(x) else float(x), float(y), float(z), int(w), "valid" if i % 4 == 0 else "train") for i, (x, y, z, w) in enumerate(zip(a, b, c, k, strict=True))]
    return rows, "a double, b double, c double, k int, split string"


def held(atom, row, names=("a", "b", "c")):
    x = row[names.index(atom.feature)]
    return x is not None and {">=": x >= atom.threshold, "<=": x <= atom.threshold, "==": x == atom.threshold}[atom.op]


def test_literals_by_cardinality(spark):
    rows, schema = panel()
    df = spark.createDataFrame([(*r, None, 1.0) for r in rows], schema + ", nothing double, one double").repartition(5)
    few = H.cardinalities(df, ["a", "b", "nothing", "one"], 8)
    assert few["a"] is None and few["nothing"] == {} and few["one"] == {1.0: 600}
    assert few["b"] == {float(v): sum(r[1] == v for r in rows) for v in range(4)}
    got = H.make_literals(df, ["a", "b", "nothing", "one", "absent"], H.Grid("thirteen", 8, 30, {"a": [(">=", 0.25)], "b": [("<=", 1.0)]}))
    values = np.array([r[0] for r in rows if r[0] is not None])
    want = {("a", op, round(float(q), 10)) for q in np.quantile(values, np.linspace(0.1, 0.9, 13)) for op in ("<=", ">=")} | {("a", ">=", 0.25), ("b", "<=", 1.0)}
    want |= {("b", "==", float(v)) for v in range(4)}
    count = lambda k: sum(held(Atom(*k), r) for r in rows)
    assert {a.key for a in got} == {k for k in want if count(k) >= 30}
    assert H.literal_counts(df, got) == [count(a.key) for a in got]


def plain_miner(rows, literals, goal, sizes, groups, limits):
    """Masks of all candidates, sorted in full."""
    literals = sorted(literals, key=lambda a: a.key)
    masks = np.array([[held(a, r) for r in rows] for a in literals])
    k = np.array([r[3] for r in rows])
    whole = [int((k == c).sum()) for c in range(goal.classes)]
    base = whole[1 if goal.classes == 2 else 0] / len(rows)

    def facts(mask):
        n, by = int(mask.sum()), [int((mask & (k == c)).sum()) for c in range(goal.classes)]
        if isinstance(goal, H.BroadGoal):
            rate, w = by[1] / n, max(0.0, lcb(by[1], n))
            score = max(rate - base + 0.06, 0.001) * max(rate / base, 0.001) ** 0.6 * max(w, 0.001) * math.log1p(n) ** 1.8 * math.log1p(by[1]) ** 1.2
            return dict(n=n, by=by, rate=rate, lift=rate / base, wilson=w, score=score, beam=(score, w, rate, rate / base, by[1], n), saved=(-score, -w, -rate, -by[1], -n))
        if goal.classes == 2:
            rate = by[1] / n
            score = rate * rate * math.log1p(n) * max(rate / base, 0.01)
            return dict(n=n, by=by, rate=rate, lift=rate / base, score=score, beam=(score, rate, by[1], n), saved=(-score, -rate, -n))
        rate, w = by[0] / n, max(0.0, lcb(by[0], n))
        c1, c2, c3 = (x / n for x in by[1:])
        p, lift = max(0.01, 1 - goal.penalties[0] * c1 - goal.penalties[1] * c2 - goal.penalties[2] * c3), rate / base
        score = rate**2.1 * lift * max(w, 1e-9) ** 1.25 * math.log1p(by[0]) ** 1.25 * math.log1p(n) * p
        return dict(n=n, by=by, rate=rate, lift=lift, wilson=w, c23=c2 + c3, score=score, beam=(score, w, rate, lift, by[0], n), saved=(-score, -w, -rate, -lift, c3, c2, -by[0], -n))

    def saves(f):
        if isinstance(goal, H.BroadGoal):
            return f["rate"] >= base + goal.rate_up and f["lift"] >= goal.least_lift and f["wilson"] >= goal.least_wilson
        if goal.classes == 2:
            return f["rate"] >= max(goal.least_rate, base * goal.least_lift)
        return f["rate"] >= goal.least_rate and f["lift"] >= goal.least_lift and f["wilson"] >= goal.least_wilson and f["c23"] <= goal.most_class23

    def extends(f, depth):
        if isinstance(goal, H.BroadGoal):
            at = min(depth, len(goal.rates_up) - 1)
            return f["rate"] >= base + goal.rates_up[at] and f["lift"] >= goal.lifts[at]
        if goal.classes == 2:
            return f["rate"] >= min(max(base * (1.08 + 0.08 * depth), base + 0.04 + 0.04 * depth), max(goal.least_rate, base * goal.least_lift))
        at = min(depth, len(goal.rates) - 1)
        return f["rate"] >= goal.rates[at] and f["lift"] >= goal.lifts[at]

    beam, saved = [()], []
    for depth in range(sizes.depth):
        new = set()
        for r in beam:
            for i, a in enumerate(literals):
                g = groups.get(a.feature)
                if all(literals[j].feature != a.feature for j in r) and sum(groups.get(literals[j].feature) == g for j in r) < limits.get(g, 99):
                    new.add(tuple(sorted((*r, i))))
        found = [(c, facts(m)) for c in sorted(new) if (m := masks[list(c)].all(0)).sum() >= sizes.least]
        saved += [(f["saved"], len(c), c, f) for c, f in found if saves(f)]
        beam = [c for c, f in sorted(found, key=lambda x: (tuple(-v for v in x[1]["beam"]), x[0])) if extends(f, depth)][: sizes.beam]
    return [(canonical(literals[i] for i in c), tuple(f["by"])) for _, _, c, f in sorted(saved, key=lambda x: x[:3])][: sizes.top]


GOALS = [replace(H.StopGoal(), least_rate=0.3, least_lift=1.1), replace(H.NoBounceGoal(), least_rate=0.1, least_wilson=0.02, most_class23=0.95, rates=(0.12, 0.15, 0.2), lifts=(0.7, 0.9, 1.0)), replace(H.BroadGoal(), least_wilson=0.2)]


@pytest.mark.parametrize("goal", GOALS)
@pytest.mark.parametrize("parts,block", [(1, 500_000), (6, 50)])
def test_mined_rules_equal_a_full_sort(spark, goal, parts, block):
    rows, schema = panel(classes=goal.classes)
    df = spark.createDataFrame(rows, schema).repartition(parts)
    literals = H.make_literals(df, ["a", "b", "c"], H.Grid("decile", 8, 20))
    sizes, groups, limits = H.Sizes(beam=12, top=60, least=20, depth=3, block=block), {"a": "X", "c": "X", "b": "Y"}, {"X": 1}
    got = H.mine(H.prepared(df, ["a", "b", "c"], F.col("k")), literals, goal, sizes, groups, limits)
    want = plain_miner(rows, literals, goal, sizes, groups, limits)
    assert len(got) > 5 and [(m.rule, m.counts) for m in got] == want
    free = H.mine(H.prepared(df, ["a", "b", "c"], F.col("k")), literals, goal, replace(sizes, depth=2))
    assert [(m.rule, m.counts) for m in free] == plain_miner(rows, literals, goal, replace(sizes, depth=2), {}, {})


# -- scenarios ------------------------------------------------------------------------------------


def pool(rng, n):
    """Rules that overlap, of one or two literals."""
    out = []
    while len(out) < n:
        atoms = [Atom("a", rng.choice([">=", "<="]), round(rng.uniform(-1.5, 1.5), 2)), Atom("b", "==", float(rng.randint(0, 3))), Atom("c", rng.choice([">=", "<="]), round(rng.uniform(-1.5, 1.5), 1))]
        rule = canonical(rng.sample(atoms, rng.randint(1, 2)))
        if rule not in out:
            out.append(rule)
    return out


def masks_of(rules, rows, split):
    part = [r for r in rows if r[4] == split]
    return np.array([[all(held(a, r) for a in rule) for r in part] for rule in rules]), np.array([r[3] for r in part])


def plain_stop_set(usable, train, valid, s):
    """Every candidate in every step, from masks."""
    (tm, ty), (vm, vy) = train, valid
    tu, vu, chosen = np.zeros(len(ty), bool), np.zeros(len(vy), bool), []
    tries = 0
    while len(chosen) < s.max_rules:
        best = None
        for c in usable:
            if c in chosen:
                continue
            tries += 1
            tn, vn = tm[c.rule] & ~tu, vm[c.rule] & ~vu
            ta, va, tt, vt = int(tn.sum()), int(vn.sum()), int((tn & (ty == 1)).sum()), int((vn & (vy == 1)).sum())
            if ta < s.added_total or va < s.added_valid_total or tt < s.added_target or vt < s.added_valid_target or not ta or not va:
                continue
            tr, vr = tt / ta, vt / va
            gap = abs(tr - vr)
            now = (vu & (vy == 1)).sum() / vu.sum() if vu.any() else 0.0
            after = (int((vu & (vy == 1)).sum()) + vt) / (int(vu.sum()) + va)
            if tr < s.train_rate or vr < s.valid_rate or gap > s.gap or after < s.next_rate or (chosen and after < now - s.drop):
                continue
            if s.objective == "rate":
                score = after * 160 + vr * 90 + min(tr, vr) * 35 + vt * 1.15 + va * 0.05 - (va - vt) * 0.9 - (ta - tt) * 0.14 + c.stability * 0.05
                score *= max(1 - gap, 0.01) ** 2
            else:
                score = vt * 2 + va * 0.15 + vr * 20 + min(tr, vr) * 10 - (va - vt) * 0.35 - (ta - tt) * 0.1 + c.stability * 0.08
                score *= max(1 - gap, 0.01) ** 1.5
            key = (score, after, vr, vt, -(va - vt), c.stability)
            if best is None or key > best[0]:
                best = key, c
        if best is None:
            break
        chosen.append(best[1])
        tu |= tm[best[1].rule]
        vu |= vm[best[1].rule]
    return chosen, tries


STOPS = [
    S.StopScenario("rate", 8, 6, 2, 2, 1, 0.0, 0.0, 0.6, 0.0, 1.0),
    S.StopScenario("tight", 8, 5, 2, 2, 1, 0.25, 0.25, 0.3, 0.3, 0.02),
    S.StopScenario("cover", 10, 4, 1, 1, 1, 0.1, 0.1, 0.5, 0.2, 0.05, "coverage"),
]


@pytest.mark.parametrize("seed,most", [*((i, 200_000) for i in range(6)), (0, 0), (1, 0)])
def test_lazy_sets_equal_trying_all(spark, seed, most):
    rng = random.Random(seed)
    rows, schema = panel(900, seed)
    rules = pool(rng, 12 if most else 8)
    cover = S.Coverage(spark.createDataFrame(rows, schema).repartition(3), rules, 2, most)
    train, valid = (masks_of(rules, rows, s) for s in ("train", "valid"))
    usable = S.candidates(cover)
    for c in usable:
        assert c.train == (int(train[0][c.rule].sum()), int((train[0][c.rule] & (train[1] == 1)).sum()))
    assert [c.stability for c in usable] == sorted((c.stability for c in usable), reverse=True)
    for s in STOPS:
        assert S.stop_set(cover, usable, s, batch=1 + seed % 3) == plain_stop_set(usable, train, valid, s)[0]
    facts = S.union_facts(cover, [c.rule for c in usable[:3]])
    union = valid[0][[c.rule for c in usable[:3]]].any(0)
    assert (facts[1]["matched"], facts[1]["target"]) == (int(union.sum()), int((union & (valid[1] == 1)).sum()))


def test_lazy_sets_evaluate_few(spark):
    rows, schema = panel(3000, 11)
    rules = pool(random.Random(11), 150)
    cover = S.Coverage(spark.createDataFrame(rows, schema), rules, 2)
    usable = S.candidates(cover)
    train, valid = (masks_of(rules, rows, s) for s in ("train", "valid"))
    before = cover.evaluated
    s = replace(STOPS[0], max_rules=12)
    got = S.stop_set(cover, usable, s, batch=4)
    want, tries = plain_stop_set(usable, train, valid, s)
    assert got == want and len(got) > 3
    assert cover.evaluated - before < tries / 3


def test_choice_among_scenarios():
    made = lambda rate, cover, n, train=None: {"train": {"rate": train or rate}, "valid": {"rate": rate, "coverage": cover, "matched": n}}
    assert S.chosen_scenario([]) is None
    assert S.chosen_scenario([made(0.66, 0.2, 900), made(0.69, 0.13, 600), made(0.70, 0.13, 600, 0.6)]) == 1  # steady first tier
    assert S.chosen_scenario([made(0.66, 0.2, 900), made(0.70, 0.115, 520)]) == 1  # strict tier
    assert S.chosen_scenario([made(0.66, 0.2, 900), made(0.676, 0.105, 460)]) == 1  # fallback tier
    assert S.chosen_scenario([made(0.60, 0.2, 900), made(0.62, 0.19, 850), made(0.64, 0.17, 700)]) == 1  # keeps most of the coverage
    assert S.chosen_scenario([made(0.60, 0.2, 900), made(0.64, 0.17, 700)]) == 1  # accepted, but for a bucket
    results = [made(0.60, 0.2, 900), made(0.603, 0.19, 850)]
    assert S.chosen_scenario(results) == 1 and results[1]["score"] == pytest.approx(0.603 * 1e5 + 0.19 * 5e3 + math.log1p(850) * 100 + 5e4)


AVOIDS = [
    S.AvoidScenario("loose", 0.7, 0.5, 0.2, 0.6, 0.35, 0.45, 0.2, 0.2, 0.2, 0.05, 0.7, 0.9, 0.6, 600.0, 7.0, 50.0, 60.0, 0.3),
    S.AvoidScenario("capped", 0.9, 0.4, 0.2, 0.35, 0.12, 0.3, 0.3, 0.25, 0.3, 0.1, 0.5, 0.6, 0.4, 600.0, 9.0, 300.0, 500.0, 5.0),
]


def plain_avoid(cands, masks, y, train, s, max_rules):
    """The three stages without exchanges, from masks; returns members and the stages of the steps."""
    (tm, ty), c0 = train, int((y == 0).sum())
    chosen, steps, safe_best = [], [], None

    def mixed(union):
        n = int(union.sum())
        p = lambda k: int((union & (y == k)).sum()) / n if n else 0.0
        return dict(n=n, rate=p(0), class2=p(2), class3=p(3), class23=int((union & (y >= 2)).sum()) / n if n else 0.0, coverage=int((union & (y == 0)).sum()) / c0)

    def union(members):
        return masks[[c.rule for c in members]].any(0) if members else np.zeros(len(y), bool)

    def best(key):
        found = [(k, -i) for i, c in enumerate(cands) if c not in chosen and (k := key(c)) is not None]
        return cands[-max(found)[1]] if found else None

    def counts(c):
        now, tn = union(chosen), tm[[x.rule for x in chosen]].any(0) if chosen else np.zeros(len(ty), bool)
        return np.array([[int((m & (lab == k)).sum()) for k in range(4)] for m, lab in ((tm[c.rule] & ~tn, ty), (masks[c.rule] & ~now, y))])

    def now_counts():
        u = union(chosen)
        return np.array([[0] * 4, [int((u & (y == k)).sum()) for k in range(4)]])

    whole = np.array([int((y == k).sum()) for k in range(4)])
    reached = lambda: (m := mixed(union(chosen)))["coverage"] >= s.target and m["class23"] <= s.class23 and m["class3"] <= s.class3
    for stage in ("primary", "fill", "repair"):
        while len(chosen) < max_rules and not (stage != "primary" and reached()):
            key = (lambda c: S._repair_key(s, c, counts(c), now_counts(), whole)) if stage == "repair" else (lambda c, stage=stage: S._stage_key(s, c, counts(c), now_counts(), whole, stage == "fill"))
            c = best(key)
            if c is None:
                break
            chosen.append(c)
            steps.append(stage)
            m = mixed(union(chosen))
            if m["n"] >= 10 and S.within_caps(m, s) and m["rate"] >= max(0.3, s.rate_post - 0.12) and (safe_best is None or S.checkpoint_score(m, s) > safe_best[0]):
                safe_best = S.checkpoint_score(m, s), list(chosen)
    m = mixed(union(chosen))
    if safe_best and not (S.within_caps(m, s) and m["coverage"] >= mixed(union(safe_best[1]))["coverage"]):
        chosen = safe_best[1]
        steps.append("rollback")
    return [c.rule for c in chosen], steps, safe_best


@pytest.mark.parametrize("seed", range(5))
def test_avoid_stages_hold_caps_and_never_end_below_the_checkpoint(spark, seed):
    rows, schema = panel(1200, 20 + seed, 4)
    rules = pool(random.Random(seed), 14)
    cover = S.Coverage(spark.createDataFrame(rows, schema), rules, 4)
    mined = [H.Mined(r, (1,), 10.0 - i) for i, r in enumerate(rules)]
    cands = S.avoid_candidates(cover, mined, avoid.LOOSE_TIERS, least=5, rate_=0.0, lift=0.0, wilson=0.0)
    train, valid = (masks_of(rules, rows, s) for s in ("train", "valid"))
    for s in AVOIDS:
        for most in (3, 10):
            members, steps, checkpoint = plain_avoid(cands, *valid, train, s, most)
            got = S.avoid_scenario(cover, cands, s, most, exchanges=0)
            assert list(got.members) == members and [x[0] for x in got.steps] == steps
            assert all(c2 <= s.class2 and c3 <= s.class3 and c23 <= s.class23 for _, _, c2, c3, c23 in got.steps)
            more = S.avoid_scenario(cover, cands, s, most, exchanges=5)
            assert len(more.members) == len(members)
            if checkpoint:
                assert S.within_caps(more.valid, s)
                if S.safe(got.valid, s):
                    assert S.checkpoint_score(more.valid, s) >= S.checkpoint_score(got.valid, s) and S.safe(more.valid, s)
                exchanged = [x[0] for x in more.steps].count("exchange")
                assert exchanged == 0 or S.checkpoint_score(more.valid, s) > S.checkpoint_score(got.valid, s) or not S.safe(got.valid, s)


def test_exchange_finds_the_better_member(spark):
    rows, schema = panel(1200, 33, 4)
    rules = pool(random.Random(8), 10)
    cover = S.Coverage(spark.createDataFrame(rows, schema), rules, 4)
    cands = S.avoid_candidates(cover, [H.Mined(r, (1,), 1.0) for r in rules], avoid.LOOSE_TIERS, least=5, rate_=0.0, lift=0.0, wilson=0.0)
    s = AVOIDS[0]
    got = S.avoid_scenario(cover, cands, s, 2, exchanges=50)
    if got.members and S.safe(got.valid, s):
        held_score = S.checkpoint_score(got.valid, s)
        whole = cover.whole[1]
        for out in got.members:  # no single exchange is better
            for c in cands:
                members = [m for m in got.members if m != out] + [c.rule]
                if c.rule not in got.members:
                    m = S.mix(cover.union(members)[1], whole)
                    assert not S.safe(m, s) or S.checkpoint_score(m, s) <= held_score


def test_choice_among_avoid_results():
    made = lambda name, cover, rate, c23, c3: S.AvoidResult(name, (), {}, dict(n=100, rate=rate, class2=c23 - c3, class3=c3, class23=c23, coverage=cover), 0.0, ())
    options = [replace(AVOIDS[0], name=n) for n in "abc"]
    assert S.chosen_avoid([], options) is None
    assert S.chosen_avoid([made("a", 0.06, 0.64, 0.11, 0.04), made("b", 0.05, 0.69, 0.07, 0.02), made("c", 0.3, 0.6, 0.2, 0.1)], options) == 1
    assert S.chosen_avoid([made("a", 0.06, 0.64, 0.11, 0.04), made("c", 0.3, 0.6, 0.2, 0.1)], options) == 0
    assert S.chosen_avoid([made("a", 0.6, 0.3, 0.5, 0.3), made("b", 0.036, 0.5, 0.15, 0.05)], options) == 0  # meets its scenario
    assert S.chosen_avoid([made("a", 0.01, 0.3, 0.9, 0.9), made("b", 0.02, 0.2, 0.95, 0.9)], options) == 0


GOODS = [
    S.GoodScenario("precise", 0.6, 0.5, 0.5, 0.2, 0.45, 0.4, 16.0, 0.45, 900.0, 150.0, 4.5, 300.0),
    S.GoodScenario("wide", 0.0, 0.0, 0.85, 0.5, 0.2, 0.15, 10.0, 0.5, 1200.0, 20.0, 1.15, 0.0),
]


def plain_good(cands, train, valid, s, pool, max_rules):
    """Both stages from masks; the best union on the way."""
    (tm, ty), (vm, vy) = train, valid
    base, tu, vu, chosen, best = vy.mean(), np.zeros(len(ty), bool), np.zeros(len(vy), bool), [], None
    under = lambda r: (max(0.0, s.target - r) + 3 * max(0.0, s.floor - r)) * s.under_penalty if s.target else 0.0
    for fill in (False, True):
        while len(chosen) < max_rules and not (fill and (vu & (vy == 1)).sum() / vy.sum() >= s.cover):
            found = []
            for at, (i, stable) in enumerate(cands):
                new = vm[i] & ~vu
                n, hits = int(new.sum()), int((new & (vy == 1)).sum())
                if i in chosen or n < pool.added[fill] or hits < pool.added_hits[fill] or hits / n < (s.added_fill if fill else s.added_primary):
                    continue
                u = vu | vm[i]
                r, cov = (u & (vy == 1)).sum() / u.sum(), (u & (vy == 1)).sum() / vy.sum()
                if r < (s.floor if s.target else max(0.0, base - 0.015)) or (fill and cov >= s.cover * 1.05):
                    continue
                score = hits * s.hit_w + n * s.row_w + cov * s.cover_w + r * s.rate_w + max(r - base, 0) * 250 + 0.15 * (tm[i] & ~tu & (ty == 1)).sum() - (n - hits) * s.miss_penalty + stable * 0.02 - under(r)
                found.append((score, cov, r, hits, n, stable, -at, i))
            if not found:
                break
            i = max(found)[-1]
            chosen.append(i)
            tu, vu = tu | tm[i], vu | vm[i]
            n, hits = int(vu.sum()), int((vu & (vy == 1)).sum())
            r, cov = hits / n, hits / vy.sum()
            score = hits * s.hit_w + n * s.row_w + cov * s.cover_w + r * s.rate_w + max(r - base, 0) * 350 - (n - hits) * s.miss_penalty - under(r) + 15000 * (cov >= s.soft_cover) + 30000 * (cov >= s.cover)
            if best is None or score > best[0]:
                best = score, list(chosen)
    return best[1] if best else []


@pytest.mark.parametrize("seed", range(4))
def test_good_scenarios_equal_plain_versions(spark, seed):
    rows, schema = panel(1000, 40 + seed)
    rules = pool(random.Random(seed), 16)
    cover = S.Coverage(spark.createDataFrame(rows, schema), rules, 2)
    bounds = S.Pool(count=10, rate_up=-0.2, lift=0.6, wilson=0.02, added=(5, 3), added_hits=(2, 1))
    cands = S.good_candidates(cover, [H.Mined(r, (1, 1), 5.0 + i) for i, r in enumerate(rules)], bounds)
    train, valid = (masks_of(rules, rows, s) for s in ("train", "valid"))
    assert len(cands) > 3
    for s in GOODS:
        got = S.good_scenario(cover, cands, s, bounds, 8)
        assert got["members"] == plain_good(cands, train, valid, s, bounds, 8)
        u = valid[0][got["members"]].any(0) if got["members"] else np.zeros(len(valid[1]), bool)
        assert (got["valid"]["n"], got["valid"]["hits"]) == (int(u.sum()), int((u & (valid[1] == 1)).sum()))


def test_choice_among_good_results():
    made = lambda rate, n, cover, score: {"valid": {"rate": rate, "n": n, "coverage": cover}, "score": score}
    assert S.chosen_good([]) is None
    assert S.chosen_good([made(0.8, 600, 0.1, 1), made(0.79, 900, 0.2, 0), made(0.9, 400, 0.9, 9)]) == 1
    assert S.chosen_good([made(0.7, 600, 0.1, 1), made(0.6, 900, 0.2, 5)]) == 1


def test_scenario_tables():
    assert len({s.name for s in scenario_config.STOP_SCENARIOS}) == 15 and len({s.name for s in scenario_config.AVOID_SCENARIOS}) == 5
    assert [t.class23 for t in scenario_config.AVOID_TIERS] == sorted(t.class23 for t in scenario_config.AVOID_TIERS)


# -- queries --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def halves(spark):
    df = avoid.halves(spark, SF).select(*avoid.FEATURES, "weekday", avoid.STOP, avoid.GOOD, "target_class", "split").toPandas()
    return df.where(df.notna(), np.nan)


def picked(df, text):
    out = np.ones(len(df), bool)
    for part in text.split(" AND "):
        f, op, t = part.split(" ")
        x = df[f].astype(float)
        out &= (x >= float(t)) if op == ">=" else (x <= float(t)) if op == "<=" else (x == float(t))
    return out


@pytest.mark.parametrize("name", ["heap_miner_stop", "heap_miner_no_bounce"])
def test_mined_rules_are_counted_right(spark, halves, name):
    train = halves[halves.split == "train"]
    hit = train[avoid.STOP].astype(bool) if "stop" in name else train.target_class == 0
    found = registry.QUERIES[name](spark, SF).collect()
    assert len(found) > 20 and [r.score for r in found] == sorted((r.score for r in found), reverse=True)
    for r in found[::10]:
        m = picked(train, r.rule)
        assert (r.n, r.hits) == (int(m.sum()), int((m & hit).sum())) and r.rate == pytest.approx(r.hits / r.n) and r.n >= avoid.SIZES.least


@pytest.mark.parametrize("name", ["stop_scenarios", "no_bounce_scenarios", "broad_scenarios"])
def test_scenarios_are_counted_right(spark, halves, name):
    found = registry.QUERIES[name](spark, SF).collect()
    assert sum(r.taken for r in found) == 1 and any(r["size"] > 1 for r in found)
    for r in found:
        for split in ("train", "valid"):
            part = halves[halves.split == split]
            hit = part.target_class == 0 if name == "no_bounce_scenarios" else part[avoid.STOP if name == "stop_scenarios" else avoid.GOOD].astype(bool)
            m = np.zeros(len(part), bool)
            for rule in filter(None, r.rules.split(" || ")):
                m |= picked(part, rule)
            n = r[f"{split}_matched"] if name == "stop_scenarios" else r[f"{split}_n"]
            assert n == m.sum() and r[f"{split}_rate"] == pytest.approx((m & hit).sum() / max(m.sum(), 1)) and r[f"{split}_coverage"] == pytest.approx((m & hit).sum() / hit.sum())


