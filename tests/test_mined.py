"""Queries without SQL against plain versions: mined rules and sets are counted again by DuckDB."""

import math

import duckdb
import numpy as np
import pytest
from compare import TABLES

from tidemark.operators import rules as R
from tidemark.operators import search, selection
from tidemark.plans import registry, sql
from tidemark.plans import rules as plans

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    con.execute(f"CREATE TABLE splitted AS WITH {sql.SIGNALS},{plans.SPLIT} SELECT * FROM splitted")
    return con


@pytest.fixture(scope="module")
def got(spark):
    held = {}

    def run(name):
        if name not in held:
            held[name] = registry.QUERIES[name](spark, SF).collect()
        return held[name]

    return run


def counted(duck, condition):
    """Rows, positives and mean return of the rows that a condition picks, by split."""
    rows = duck.execute(f"SELECT split, count(*), sum(CAST({plans.Y} AS INT)), avg(ret) FROM splitted WHERE {condition} GROUP BY split").fetchall()
    return {s: (n, (y or 0) / n, r) for s, n, y, r in rows}


def where(text):
    return plans.condition(text)


def test_mined_rules_are_counted_right(got, duck):
    found = got("beam_search")
    assert found and [r.score for r in found] == sorted((r.score for r in found), reverse=True) and len({r.rule for r in found}) == len(found)
    for r in found:
        want = counted(duck, where(r.rule))
        for s in search.SPLITS:
            n, p, ret = want.get(s, (0, math.nan, math.nan))
            assert r[f"{s}_n"] == n and r[f"{s}_precision"] == pytest.approx(p, nan_ok=True, abs=2e-6) and r[f"{s}_return"] == pytest.approx(ret, nan_ok=True, abs=2e-6)
        assert r.train_n >= plans.LOOSE.min_train_count and r.selection_precision >= plans.LOOSE.min_selection_precision and len(R.parse(r.rule)) <= plans.LOOSE.max_depth


@pytest.mark.parametrize("name", ["or_sets_exhaustive", "or_sets_greedy", "good_scenarios"])
def test_sets_are_counted_right(got, duck, name):
    found = got(name)
    assert found
    for r in found[:: max(1, len(found) // 25)]:
        members = r.rules.split(" || ")
        assert len(members) == len(set(members)) == r["size"]
        want = counted(duck, " OR ".join(f"({where(m)})" for m in members))
        for s in search.SPLITS:
            n, p, ret = want.get(s, (0, 0.0, 0.0))
            assert r[f"{s}_n"] == n and r[f"{s}_precision"] == pytest.approx(p, abs=2e-6) and r[f"{s}_return"] == pytest.approx(ret, abs=2e-6)
    if name == "or_sets_exhaustive":
        assert [r.score for r in found] == sorted((r.score for r in found), reverse=True) and {r["size"] for r in found} <= set(selection.SetGates.sizes)


def test_portfolio_is_made_of_mined_rules(got):
    mined = {r.rule: r for r in got("beam_search")}
    picked = got("portfolio_diversified")
    assert picked and all((mined[r.rule].selection_n, mined[r.rule].selection_precision) == (r.n, r.precision) for r in picked)
    features = [tuple(sorted({a.feature for a in R.parse(r.rule)})) for r in picked]
    assert max(features.count(f) for f in features) <= 3 and np.mean([r.precision for r in picked]) >= 0.3


def test_avoid_rules_are_counted_right(got, duck):
    found = got("avoid_scenario")
    whole = duck.execute("SELECT sum(CAST(target_class = 0 AS INT)), sum(CAST(target_class = 3 AS INT)) FROM splitted WHERE split = 'train'").fetchone()
    assert found
    for k, r in enumerate(found):
        union = " OR ".join(f"({where(x.rule)})" for x in found[: k + 1])
        n, zero, three = duck.execute(f"SELECT count(*), sum(CAST(target_class = 0 AS INT)), sum(CAST(target_class = 3 AS INT)) FROM splitted WHERE split = 'train' AND ({union})").fetchone()
        assert (r.n, r.class0, r.class3) == (n, zero, three) and three <= 0.15 * whole[1]
        assert r.covered_class0 == pytest.approx(zero / whole[0]) and r.covered_class3 == pytest.approx(three / whole[1])


def test_avoid_score_weighs_the_classes():
    assert selection.avoid_score(100, 80, 0.35 * 10 + 3.2 * 5 + 5.5 * 2, 0.5) < selection.avoid_score(100, 80, 0.35 * 10, 0.5)
    p = 1 - (0.35 * 10 + 3.2 * 5 + 5.5 * 2) / 100
    assert selection.avoid_score(100, 80, 0.35 * 10 + 3.2 * 5 + 5.5 * 2, 0.5) == pytest.approx(0.8**2.1 * 1.6 * search.lcb(80, 100) ** 1.25 * math.log1p(80) ** 1.25 * math.log1p(100) * p)
    assert selection.avoid_score(0, 0, 0, 0.5) == selection.avoid_score(10, 0, 0, 0.5) == 0


def brute_auc(x, y):
    order = np.argsort(x, kind="stable")
    ranks = np.empty(len(x))
    ranks[order] = np.arange(1, len(x) + 1)
    for v in np.unique(x):
        ranks[x == v] = ranks[x == v].mean()
    pos = y.sum()
    return (ranks[y].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


def test_simplified_rules_keep_their_promise(got, duck):
    mined = {r.rule: r for r in got("beam_search")}
    found = got("simplified_rules")
    assert found and [r.rule for r in found] == list(mined)[: len(found)]
    for r in found:
        n, p, _ = counted(duck, where(r.simplified))["selection"]
        assert (r.n, r.precision) == (mined[r.rule].selection_n, mined[r.rule].selection_precision) and (r.simplified_n, r.simplified_precision) == (n, pytest.approx(p))
        assert set(R.parse(r.simplified)) <= set(R.parse(r.rule))
        kept = len(R.parse(r.rule)) - len(R.parse(r.simplified))
        assert n >= plans.LOOSE.simplify_min_count_ratio**kept * r.n and p >= r.precision - kept * plans.LOOSE.simplify_precision_drop - 1e-9


def test_styles_take_the_best_rules_that_are_left(got):
    scores = {r.rule: r for r in got("final_filter")}
    used = set()
    for style in ("high_precision", "stable", "coverage"):
        best = sorted((t for t in scores if t not in used), key=lambda t: (-scores[t][style], t))[:5]
        assert [r.rule for r in got("exported_styles") if r["style"] == style] == best
        used |= set(best)


def test_correlated_pruning(got, duck):
    cols = duck.execute(f"SELECT {', '.join(plans.MINED)}, {plans.Y} FROM splitted").fetchnumpy()
    y = np.ma.filled(cols[plans.Y], False).astype(bool)
    rows = {r.feature: r for r in got("correlated_pruning")}
    assert set(rows) == set(plans.MINED) and any(r.kept for r in rows.values())
    for f, r in rows.items():
        x = np.ma.masked_invalid(np.ma.asarray(cols[f], dtype=float))
        ok = ~np.ma.getmaskarray(x)
        auc = brute_auc(x.data[ok], y[ok])
        assert r.auc == pytest.approx(max(auc, 1 - auc), abs=1e-6)


def test_features_that_are_left_out(got):
    out = got("leave_one_feature_out")
    assert {r.feature for r in out} == set(plans.MINED) and all(r.adds == pytest.approx(r.with_it - r.without_it) for r in out)
    top = [r.selection_precision for r in got("beam_search")[:10]]
    assert all(r.with_it == pytest.approx(np.mean(top)) for r in out)
    grades = got("feature_grade")
    assert {r.feature for r in grades} == set(plans.MINED) and {r.grade for r in grades} <= set("SABC")
    used = [{a.feature for a in R.parse(r.rule)} for r in got("beam_search")]
    assert all(r.usage == sum(r.feature in u for u in used) for r in grades)


def test_contribution_and_filter_refer_to_mined_rules(got, duck):
    mined = {r.rule for r in got("beam_search")}
    assert {r.rule for r in got("final_filter")} == mined
    some = got("feature_contribution")
    assert some and {r.rule for r in some} <= mined and all(r.feature in r.rule for r in some)


def test_adx_follows_directional_movement(spark):
    """Wilder's mean of |+DI - -DI| / (+DI + -DI), from the query of the two lines."""
    adx = registry.QUERIES["adx"](spark, SF).toPandas().sort_values(["instrument", "session"])
    lines = registry.QUERIES["directional"](spark, SF).toPandas().sort_values(["instrument", "session"])
    plus, minus = lines.plus_di.astype(float), lines.minus_di.astype(float)
    dx = (100 * (plus - minus).abs() / (plus + minus).where(plus + minus > 0)).rename("dx")
    want = dx.groupby(lines.instrument.values).transform(lambda d: d.ewm(alpha=1 / 14, adjust=False).mean())
    assert len(adx) == len(want) and (adx.adx14.astype(float).values - want.values)[~want.isna().values].__abs__().max() < 1e-2
    assert (adx.adx14.isna().values == want.isna().values).all()


def facts(mask, y, ret, rows):
    """Metrics of a mask among some rows, from masks alone."""
    n, pos = int((mask & rows).sum()), int((mask & rows & y).sum())
    r = ret[mask & rows]
    base = (rows & y).sum() / rows.sum()
    p = pos / n if n else math.nan
    return {"n": n, "positive": pos, "precision": p, "lcb": search.lcb(pos, n), "base_rate": base, "lift": p / base if n and base else math.nan, "pos_recall": pos / (rows & y).sum(), "selected_rate": n / rows.sum(), "avg_return": r.sum() / n if n else math.nan, "profit_factor": r[r > 0].sum() / -r[r < 0].sum() if (r < 0).any() else math.nan}


def months_of(mask, y, ret, rows, month, cfg):
    each = [facts(mask, y, ret, rows & (month == m)) for m in sorted(set(month[rows]))]
    usable = [m for m in each if m["n"] >= cfg.min_month_count]
    if not usable:
        return {"usable": 0, "mp": math.nan, "mnp": math.nan, "sdp": math.nan, "mr": math.nan, "mnr": math.nan, "sdr": math.nan, "pass": 0.0, "bad": len(each), "crash": len(each) or 999}
    p, r, lift = (np.array([m[k] for m in usable]) for k in ("precision", "avg_return", "lift"))
    good = (p >= cfg.month_pass_precision) & (r >= cfg.month_pass_avg_return) & (lift >= cfg.month_pass_lift)
    return {"usable": len(usable), "mp": p.mean(), "mnp": p.min(), "sdp": p.std(), "mr": r.mean(), "mnr": r.min(), "sdr": r.std(), "pass": good.mean(), "bad": int((~good).sum()), "crash": int(((p < cfg.month_crash_precision) | (r < cfg.month_crash_avg_return)).sum())}


def plain_beam(df, atoms, cfg, depth):
    """The beam on whole masks: texts of the rules that pass all gates, best first, with their scores."""
    y, ret, split, month = df[plans.Y].astype(bool).values, df.ret.astype(float).fillna(0).values, df.split.values, df.month.values
    atoms = sorted(atoms, key=lambda a: a.key)
    masks = {a: np.nan_to_num(df[a.feature].astype(float).values, nan=math.inf if a.op == "<=" else -math.inf).__ge__(a.threshold) if a.op == ">=" else df[a.feature].astype(float).values <= a.threshold for a in atoms}
    train, sel = split == "train", split == "selection"
    beam, seen, known, kept = [()], set(), set(), []
    for d in range(depth):
        new = sorted({R.canonical((*r, a)) for r in beam for a in atoms if R.can_add(r, a, cfg.intervals, cfg.correlated, cfg.groups, cfg.limits)} - seen, key=R.text)
        seen |= set(new)
        scored = []
        for r in new:
            m = np.logical_and.reduce([masks[a] for a in r])
            t = facts(m, y, ret, train)
            if (score := search.beam_score(t, cfg)) > search.FAILED / 10:
                key = (m & train).tobytes()
                if not (d and key in known):
                    known.add(key)
                    scored.append((-score, R.text(r), r, m, t))
        scored.sort(key=lambda x: x[:2])
        beam = [x[2] for x in scored[: cfg.beam_width]]
        for _, name, r, m, t in scored[: cfg.beam_width]:
            s = facts(m, y, ret, sel)
            if search.fast_gate(s, cfg):
                mon = months_of(m, y, ret, sel, month, cfg)
                if (final := search.final_score(t, s, mon, cfg)) > search.FAILED / 10:
                    kept.append((-final, name, r, s, (m & train).tobytes(), (m & sel).tobytes()))
    kept.sort(key=lambda x: x[:2])
    out = []
    for f in kept:
        a = {x.feature for x in f[2]}
        near = lambda g: abs(f[3]["n"] - g[3]["n"]) / max(g[3]["n"], 1) <= cfg.dup_count_tol and f[3]["precision"] - g[3]["precision"] <= cfg.dup_precision_gain and (a <= {x.feature for x in g[2]} or {x.feature for x in g[2]} <= a)
        if not any(f[4] == g[4] or f[5] == g[5] or near(g) for g in out):
            out.append(f)
    return [(f[1], -f[0]) for f in out[: cfg.top_k]]


def test_beam_search_equals_a_plain_miner(spark, got):
    from tidemark.plans.rules import LOOSE, MINED, split_rows

    df = split_rows(spark, SF).select(*MINED, plans.Y, "ret", "split", "month")
    atoms = R.make_atoms(df.where("split = 'train'"), MINED, "decile")
    want = plain_beam(df.toPandas(), atoms, LOOSE, LOOSE.max_depth)
    found = [(r.rule, r.score) for r in got("beam_search")]
    assert [r for r, _ in found] == [r for r, _ in want] and [s for _, s in found] == pytest.approx([s for _, s in want])


def test_preset_search_equals_a_plain_miner(spark, got):
    from dataclasses import replace

    from tidemark.plans import config
    from tidemark.plans.rules import LOOSE, split_rows

    names = config.features("balanced")
    cfg = replace(LOOSE, max_depth=2, intervals=frozenset(config.INTERVALS), groups=config.FEATURE_GROUPS, limits={"VOLATILITY": 2, "CANDLE": 2, "POSITION": 1})
    df = split_rows(spark, SF).select(*names, plans.Y, "ret", "split", "month")
    atoms = R.make_atoms(df.where("split = 'train'"), names, "v4", config.ops(names))
    want = plain_beam(df.toPandas(), atoms, cfg, 2)
    found = [(r.rule, r.score) for r in got("preset_search")]
    assert [r for r, _ in found] == [r for r, _ in want] and [s for _, s in found] == pytest.approx([s for _, s in want])
