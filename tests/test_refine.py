"""Scores, filters, refinement and delivery."""

import datetime as dt
import math

import pytest

from tidemark.operators import refine, rules, scoring, search
from tidemark.sources import delivery


def found(name, p=0.7, n=40, r=3.0):
    m = {"n": n, "positive": int(p * n), "precision": p, "lcb": search.lcb(p * n, n), "base_rate": 0.4, "lift": p / 0.4, "pos_recall": 0.1, "selected_rate": 0.05, "avg_return": r, "profit_factor": 2.0}
    mon = {"usable": 5, "mp": p, "mnp": p - 0.1, "sdp": 0.05, "mr": r, "mnr": 0.5, "sdr": 0.2, "pass": 0.8, "bad": 1, "crash": 0}
    return search.Found(rules.parse(f"{name} >= 1"), m, m, m, mon, 1.0, ())


FW = {"mean_p": 0.6, "min_p": 0.5, "mean_r": 1.0, "min_r": 0.5, "pass_rate": 0.8, "total": 60, "crash": 0}


def test_filters_and_styles():
    good = found("a")
    assert scoring.passes(good, FW) and scoring.passes(good, FW, scoring.STRICT)
    assert not scoring.passes(found("a", p=0.55), FW) and not scoring.passes(good, {}) and not scoring.passes(good, FW | {"crash": 3})
    scores = {f.text: scoring.styles(f.selection, f.final, f.months, FW) for f in (good, found("b", 0.6, 90), found("c", 0.65))}
    out = scoring.export_styles([good, found("b", 0.6, 90), found("c", 0.65)], scores, each=1)
    assert [s for s, _ in out] == ["high_precision", "stable", "coverage"] and len({f.text for _, f in out}) == 3
    assert scoring.break_even() == pytest.approx(0.375) and scoring.sampling_discount(0.7, 100) and not scoring.sampling_discount(0.6, 100)
    assert scoring.tier(0.71, 0.2) == 0 and scoring.tier(0.71, 0.09) == 1 and scoring.tier(0.1, 0.0) == 4
    assert scoring.base_score(good.train, good.selection, good.final, good.months, use_final=True) > scoring.base_score(good.train, good.selection, good.final, good.months)
    assert scoring.broad_score(0, 0, 0.4) == 0 and scoring.walk_forward_score(8, 4) == pytest.approx(0.125 * math.log1p(8)) and scoring.stop_avoid_score(0, 0, 0) == 0


def test_pruning_keeps_the_better_of_a_pair():
    pairs = frozenset([frozenset("ab"), frozenset("bc")])
    assert refine.pruned(["a", "b", "c"], pairs, {"a": 0.6, "b": 0.7, "c": 0.5}) == ["b"]
    assert refine.pruned(["a", "b", "c"], frozenset(), {}) == ["a", "b", "c"]


def test_html_tables(spark):
    page = "<table><tr><th>x</th></tr></table><table><tr><th>Symbol</th><th>Name</th></tr><tr><td> A </td><td>Al<b>pha</b></td></tr><tr><td>B</td></tr></table>"
    assert [tuple(r) for r in delivery.html_table(spark, page).collect()] == [("A", "Alpha"), ("B", None)]
    with pytest.raises(ValueError):
        delivery.html_table(spark, page, ("Ticker",))


def test_lists_go_back_in_time():
    has = {dt.date(2024, 1, 5): ["A"]}
    assert delivery.listed_on(dt.date(2024, 1, 7), lambda d: has.get(d, [])) == (dt.date(2024, 1, 5), ["A"])
    assert delivery.listed_on(dt.date(2024, 2, 7), lambda d: has.get(d, [])) == (dt.date(2024, 2, 7), [])


def test_posting_in_chunks(spark, tmp_path):
    folder = str(tmp_path)

    def send(chunk):
        import os
        import uuid

        flag = f"{folder}/failed"
        if not os.path.exists(flag):
            open(flag, "w").close()
            raise OSError("once")
        with open(f"{folder}/{uuid.uuid4()}.chunk", "w") as f:
            f.write(str(len(chunk)))

    delivery.post(spark.range(25).coalesce(1), send, size=10, pause=0)
    assert sorted(int(p.read_text()) for p in tmp_path.glob("*.chunk")) == [5, 10, 10]
