"""Queries of the avoid-rule miners: literals, mining with a bounded heap, and scenarios."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.functions import columns as c
from tidemark.operators import heapminer, metrics, rules, scenarios
from tidemark.operators.heapminer import BroadGoal, Grid, NoBounceGoal, Sizes, StopGoal
from tidemark.operators.rules import text
from tidemark.operators.scenarios import AvoidScenario, Pool, StopScenario, Tier, Valid
from tidemark.plans import scenario_config, sql
from tidemark.plans.market import query, signal_rows

# Features of the stop miner, their groups and how many of a group a rule may use.
FEATURES = ["vol5", "rebound_from_7d_low", "dist_to_ma5", "tr_value_ratio_5d", "max_drop_7d", "upper_wick_ratio", "lower_wick_ratio", "vol15", "dist_to_ma20", "bb_perc", "gap_pct", "room_to_60d_high", "ma5_chg_rate", "pct_vs_lastweek", "atr_pct"]
GROUPS = {"vol5": "VOLATILITY", "vol15": "VOLATILITY", "atr_pct": "VOLATILITY", "rebound_from_7d_low": "REBOUND", "dist_to_ma5": "POSITION", "dist_to_ma20": "POSITION", "tr_value_ratio_5d": "VOLUME", "max_drop_7d": "DROP", "upper_wick_ratio": "CANDLE", "lower_wick_ratio": "CANDLE", "bb_perc": "BAND", "gap_pct": "GAP", "room_to_60d_high": "HIGH_ROOM", "ma5_chg_rate": "TREND", "pct_vs_lastweek": "WEEK_POSITION"}
LIMITS = {"VOLATILITY": 3, "POSITION": 2, "CANDLE": 2, "REBOUND": 1, "VOLUME": 1, "DROP": 1, "BAND": 1, "GAP": 1, "HIGH_ROOM": 1, "TREND": 1, "WEEK_POSITION": 1}
STOP, GOOD = "stop_before_target_10", "target_before_stop_10"

#: Features with SQL of their own; the weekday stands for those with few values.
PLAIN = ["vol5", "rebound_from_7d_low", "dist_to_ma5", "tr_value_ratio_5d", "max_drop_7d", "dist_to_ma20", "gap_pct", "weekday"]

#: Floors for the noisy driver panel, where no rule lifts the rate by the miners' own quarter; sizes are smaller
#: than the miners' own, which Sizes() holds.
SIZES = Sizes(beam=150, top=300, least=40, depth=3)
#: Rules that never bounce are alike: only a long list of them covers more than a few rows.
BOUNCE_SIZES = replace(SIZES, top=3000)
LOOSE_STOP = StopGoal(least_rate=0.2, least_lift=1.04)
LOOSE_BOUNCE = NoBounceGoal(least_rate=0.05, least_lift=1.1, least_wilson=0.02, most_class23=0.98, rates=(0.03, 0.04, 0.05), lifts=(0.8, 0.9, 1.0), penalties=(0.35, 0.5, 0.6))
LOOSE_BROAD = BroadGoal(rate_up=0.0, least_wilson=0.02)
LOOSE_POOL = Pool(count=15, wilson=0.02, added=(5, 3), added_hits=(2, 1))
LOOSE_VALID = Valid(train_count=40, valid_count=10, train_rate=0.1, valid_rate=0.1, train_lift=1.02, valid_lift=1.0, gap=0.25)
LOOSE_STOP_SCENARIOS = [
    StopScenario("strict", 8, 20, 4, 8, 2, 0.1, 0.1, 0.15, 0.1, 0.01),
    StopScenario("balanced", 12, 14, 3, 5, 1, 0.05, 0.05, 0.25, 0.05, 0.03),
    StopScenario("wide", 16, 8, 2, 3, 1, 0.0, 0.0, 0.4, 0.0, 1.0, "coverage"),
]
LOOSE_TIERS = [Tier("all", 3, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0)]
LOOSE_AVOID_SCENARIOS = [
    AvoidScenario("guard", 0.20, 0.15, 0.10, 0.90, 0.88, 0.10, 0.12, 0.10, 0.12, 0.05, 0.90, 0.95, 0.90, 620.0, 9.0, 76.0, 92.0, 0.4),
    AvoidScenario("reach", 0.60, 0.40, 0.20, 0.97, 0.97, 0.20, 0.05, 0.03, 0.08, 0.02, 0.95, 0.99, 0.95, 620.0, 7.0, 47.0, 62.0, 0.2),
]


def halves(spark, sf_dir, smooth: bool = True):
    """Signals with their weekday, split in two by days."""
    df = signal_rows(spark, sf_dir, smooth).withColumn("weekday", F.dayofweek("today").cast("double"))
    return metrics.date_split(df, parts=(0.8,), names=("train", "valid"))


TWO = """days AS (SELECT today, row_number() OVER (ORDER BY today) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT today FROM signals)),
halves AS (SELECT s.*, CAST(dayofweek(today) + 1 AS DOUBLE) AS weekday, CASE WHEN i < least(greatest(CAST(floor(n * 0.8) AS INT), 1), n - 1) THEN 'train' ELSE 'valid' END AS split FROM signals s JOIN days USING (today))"""


@query("split_two_ways", f"WITH {sql.SIGNALS},{TWO} SELECT split, count(*) AS n, min(today) AS first_day, max(today) AS last_day FROM halves GROUP BY split")
def split_two_ways(spark, sf_dir):
    """Train and valid days, each with one day at least."""
    return halves(spark, sf_dir, False).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("today").alias("first_day"), F.max("today").alias("last_day"))


def _literals_sql(kind: str, grid: str, few: int, least: int) -> str:
    wide = " UNION ALL ".join(f"SELECT '{f}' AS feature, op, round(quantile_cont({f}, {q}), 10) AS t FROM train, (VALUES ('<='), ('>=')) o(op) GROUP BY op HAVING count(DISTINCT {f}) > {max(few, 1)}" for f in PLAIN for q in rules.GRIDS[grid])
    equal = " UNION ALL ".join(f"SELECT '{f}' AS feature, '==' AS op, {f} AS t FROM train WHERE {f} IS NOT NULL AND (SELECT count(DISTINCT {f}) FROM train) BETWEEN 2 AND {few} GROUP BY {f}" for f in PLAIN)
    values = ", ".join(f"'{f}'" for f in PLAIN)
    return f"""SELECT '{kind}' AS miner, feature, op, round(t, 6) AS threshold, count(*) AS n FROM (SELECT DISTINCT * FROM ({wide}{' UNION ALL ' + equal if few else ''})) JOIN
        (SELECT unnest([{values}]) AS feature, unnest([{', '.join(PLAIN)}]) AS x FROM train) USING (feature)
        WHERE CASE op WHEN '<=' THEN x <= t WHEN '>=' THEN x >= t ELSE x = t END GROUP BY feature, op, t HAVING count(*) >= {least}"""


STOP_GRID, BOUNCE_GRID = Grid("thirteen", 8, 40), Grid("twenty", 0, 25)


@query("avoid_literals", f"WITH {sql.SIGNALS},{TWO}, train AS (SELECT * FROM halves WHERE split = 'train') {_literals_sql('stop', 'thirteen', 8, 40)} UNION ALL {_literals_sql('bounce', 'twenty', 0, 25)}")
def avoid_literals(spark, sf_dir):
    """What the two avoid miners make rules of, and the rows in which each literal holds."""
    train = halves(spark, sf_dir, False).where("split = 'train'").persist()
    try:
        out = []
        for kind, grid in (("stop", STOP_GRID), ("bounce", BOUNCE_GRID)):
            atoms = heapminer.make_literals(train, PLAIN, grid)
            out += [(kind, a.feature, a.op, a.threshold, n) for a, n in zip(atoms, heapminer.literal_counts(train, atoms), strict=True)]
    finally:
        train.unpersist()
    return spark.createDataFrame(out, "miner string, feature string, op string, threshold double, n long").withColumn("threshold", c.rounded("threshold", 6))


@contextmanager
def mined(spark, sf_dir, goal, grid: Grid, sizes: Sizes = SIZES):
    """Rows of both splits, kept while they are read again, and the rules mined on train rows."""
    df = halves(spark, sf_dir)
    features = [*FEATURES, "weekday"]
    klass = F.col("target_class") if isinstance(goal, NoBounceGoal) else metrics.flag(STOP if isinstance(goal, StopGoal) else GOOD)
    rows = heapminer.prepared(df, features, klass, "split").persist()
    try:
        train = rows.where("split = 'train'")
        found = heapminer.mine(train, heapminer.make_literals(train, features, grid), goal, sizes, GROUPS, LIMITS)
        yield rows, found
    finally:
        rows.unpersist()


def _mined_frame(spark, found, goal):
    k = 0 if isinstance(goal, NoBounceGoal) else 1
    return spark.createDataFrame([(i, m.text, len(m.rule), sum(m.counts), m.counts[k], m.counts[k] / sum(m.counts), m.score) for i, m in enumerate(found, 1)], "rank int, rule string, size int, n long, hits long, rate double, score double")


@query("heap_miner_stop")
def heap_miner_stop(spark, sf_dir):
    """Rules that pick signals which stop before their target."""
    with mined(spark, sf_dir, LOOSE_STOP, STOP_GRID) as (_, found):
        return _mined_frame(spark, found, LOOSE_STOP)


@query("heap_miner_no_bounce")
def heap_miner_no_bounce(spark, sf_dir):
    """Rules that pick signals which never bounce, and few that do."""
    with mined(spark, sf_dir, LOOSE_BOUNCE, BOUNCE_GRID) as (_, found):
        return _mined_frame(spark, found, LOOSE_BOUNCE)


FACTS = ("matched", "target", "rate", "coverage")


@query("stop_scenarios")
def stop_scenarios(spark, sf_dir):
    """Sets of stop-avoid rules under each scenario's constraints, and the one that is taken."""
    with mined(spark, sf_dir, LOOSE_STOP, STOP_GRID) as (rows, found):
        names = [m.text for m in found]
        cover = scenarios.Coverage(rows, [m.rule for m in found], 2)
        results, taken = scenarios.stop_scenarios(cover, [*LOOSE_STOP_SCENARIOS, *scenario_config.STOP_SCENARIOS], LOOSE_VALID)
    out = [(r["name"], i == taken, len(r["members"]), " || ".join(names[m] for m in r["members"]), float(r["score"]), *[float(r[s][k]) for s in ("train", "valid") for k in FACTS]) for i, r in enumerate(results)]
    return spark.createDataFrame(out, "scenario string, taken boolean, size int, rules string, score double, " + ", ".join(f"{s}_{k} double" for s in ("train", "valid") for k in FACTS))


MIX = ("n", "rate", "coverage", "class2", "class3", "class23")


@query("no_bounce_scenarios")
def no_bounce_scenarios(spark, sf_dir):
    """Sets of no-bounce rules in stages under caps on classes 2 and 3, and the one that is taken."""
    options = [*LOOSE_AVOID_SCENARIOS, *scenario_config.AVOID_SCENARIOS]
    with mined(spark, sf_dir, LOOSE_BOUNCE, BOUNCE_GRID, BOUNCE_SIZES) as (rows, found):
        names = [text(m.rule) for m in found]
        cover = scenarios.Coverage(rows, [m.rule for m in found], 4)
        pool = scenarios.avoid_candidates(cover, found, [*scenario_config.AVOID_TIERS, *LOOSE_TIERS], least=40, rate_=0.05, lift=1.0, wilson=0.0)
        results = [scenarios.avoid_scenario(cover, pool, s, max_rules=12, exchanges=2) for s in options]
    taken = scenarios.chosen_avoid(results, options)
    out = [(r.scenario, i == taken, len(r.members), " || ".join(names[m] for m in r.members), ",".join(s[0] for s in r.steps), float(r.score), *[float(x[k]) for x in (r.train, r.valid) for k in MIX]) for i, r in enumerate(results)]
    return spark.createDataFrame(out, "scenario string, taken boolean, size int, rules string, steps string, score double, " + ", ".join(f"{s}_{k} double" for s in ("train", "valid") for k in MIX))


@query("broad_scenarios")
def broad_scenarios(spark, sf_dir):
    """Unions of wide good rules under six scenarios of precision and coverage, and the one that is taken."""
    with mined(spark, sf_dir, LOOSE_BROAD, STOP_GRID) as (rows, found):
        names = [m.text for m in found]
        cover = scenarios.Coverage(rows, [m.rule for m in found], 2)
        able = scenarios.good_candidates(cover, found, LOOSE_POOL)
        results = [scenarios.good_scenario(cover, able, s, LOOSE_POOL, max_rules=30) for s in scenario_config.GOOD_SCENARIOS]
    taken, facts = scenarios.chosen_good(results), ("n", "hits", "rate", "lift", "coverage")
    out = [(r["name"], i == taken, len(r["members"]), r["stage"], " || ".join(names[m] for m in r["members"]), float(r["score"]), *[float(r[s][k]) for s in ("train", "valid") for k in facts]) for i, r in enumerate(results)]
    return spark.createDataFrame(out, "scenario string, taken boolean, size int, stage string, rules string, score double, " + ", ".join(f"{s}_{k} double" for s in ("train", "valid") for k in facts))
