"""Scenarios and gates for sets of avoid rules."""

from __future__ import annotations

from tidemark.operators.scenarios import AvoidScenario, GoodScenario, StopScenario, Tier

# Name, most rules; rows and targets that a rule adds on train rows, then on valid rows; least rates of
# what it adds on train and valid rows, widest gap between them; least rate of the union, its largest fall; objective.
STOP_SCENARIOS = [
    StopScenario("depth4_precision68_stable_balance", 18, 14, 9, 9, 6, 0.600, 0.610, 0.13, 0.675, 0.004),
    StopScenario("depth4_precision69_guard", 14, 16, 10, 10, 7, 0.615, 0.630, 0.12, 0.685, 0.003),
    StopScenario("depth4_coverage_keep_rate_guard", 20, 12, 7, 8, 5, 0.585, 0.595, 0.14, 0.660, 0.006),
    StopScenario("precision68_v2_improve_balance", 20, 12, 8, 7, 5, 0.600, 0.620, 0.16, 0.680, 0.004),
    StopScenario("precision69_strict_balance", 16, 14, 9, 8, 6, 0.615, 0.640, 0.15, 0.690, 0.003),
    StopScenario("precision675_coverage_keep", 24, 10, 6, 6, 4, 0.590, 0.600, 0.18, 0.675, 0.005),
    StopScenario("rate_up_strict_keep_coverage", 12, 18, 11, 12, 7, 0.595, 0.605, 0.16, 0.615, 0.004),
    StopScenario("rate_up_balanced_keep_coverage", 12, 16, 9, 10, 6, 0.585, 0.590, 0.18, 0.610, 0.006),
    StopScenario("rate_up_soft_keep_coverage", 12, 15, 8, 10, 5, 0.575, 0.580, 0.19, 0.605, 0.008),
    StopScenario("rate_up_balanced_more_rules", 18, 14, 8, 8, 5, 0.580, 0.585, 0.19, 0.608, 0.006),
    StopScenario("rate_up_soft_more_rules", 20, 12, 7, 8, 5, 0.570, 0.575, 0.20, 0.605, 0.008),
    StopScenario("rate_up_strict_more_rules_fill", 18, 12, 7, 6, 4, 0.585, 0.600, 0.18, 0.620, 0.003),
    StopScenario("rate_up_precision_fill_keep_coverage", 22, 10, 6, 6, 4, 0.580, 0.595, 0.19, 0.618, 0.0035),
    StopScenario("rate_up_high_coverage_guard", 24, 8, 5, 6, 4, 0.575, 0.590, 0.20, 0.616, 0.003),
    StopScenario("coverage_keep_rate_loose_fallback", 12, 15, 8, 10, 5, 0.57, 0.565, 0.20, 0.595, 0.012, "coverage"),
]

# Name; coverage aimed at, acceptable and soft; caps on classes 2 and 3 together, 3 and 2; least rates below
# and above the soft coverage; least rate of what a rule adds, and in the fill; most of classes 2 and 3 that it adds, in
# the fill, and of class 3; weights of coverage and class 0; penalties of classes 2 and 3, of 3, and of both as added.
AVOID_SCENARIOS = [
    AvoidScenario("v2plus_cov5_c23_08_quality", 0.050, 0.048, 0.040, 0.080, 0.030, 0.070, 0.66, 0.62, 0.24, 0.08, 0.20, 0.34, 0.08, 6200.0, 9.0, 760.0, 920.0, 42.0),
    AvoidScenario("v2plus_cov4_c23_10_guard", 0.040, 0.040, 0.034, 0.100, 0.035, 0.085, 0.66, 0.60, 0.30, 0.10, 0.20, 0.35, 0.08, 4200.0, 9.0, 620.0, 760.0, 38.0),
    AvoidScenario("v2plus_cov42_c23_12_balance", 0.042, 0.040, 0.035, 0.120, 0.040, 0.105, 0.63, 0.58, 0.24, 0.06, 0.26, 0.42, 0.10, 5000.0, 8.0, 520.0, 680.0, 30.0),
    AvoidScenario("v2plus_cov5_c23_12_reach", 0.050, 0.045, 0.038, 0.120, 0.045, 0.110, 0.60, 0.54, 0.18, 0.03, 0.30, 0.50, 0.12, 6200.0, 7.0, 470.0, 620.0, 24.0),
    AvoidScenario("baseline_cov5_c23_12_balanced", 0.050, 0.050, 0.040, 0.120, 0.065, 0.110, 0.60, 0.50, 0.28, 0.00, 0.24, 1.00, 0.14, 2800.0, 7.0, 430.0, 540.0, 28.0),
]

# Rows, rate, lift and Wilson bound of class 0 at least; classes 1, 2, 3 and both of 2 and 3 at most.
AVOID_TIERS = [
    Tier("micro_zero_class23_pool", 1, 0.45, 0.85, 0.00, 1.00, 0.00, 0.00, 0.00),
    Tier("ultra_low_class23_pool", 2, 0.34, 0.65, 0.04, 0.92, 0.12, 0.06, 0.14),
    Tier("strict_class23_pool", 3, 0.30, 0.58, 0.03, 0.94, 0.20, 0.10, 0.24),
    Tier("reach_low_class23_pool", 3, 0.25, 0.50, 0.02, 0.96, 0.32, 0.18, 0.42),
    Tier("diagnostic_pool", 3, 0.20, 0.42, 0.01, 0.98, 0.50, 0.34, 0.65),
]

# Name; target and floor of precision; coverage aimed at, and soft; least precision of what a rule adds,
# and in the fill; weights of hits, rows, coverage and precision; penalties of misses and of falling short.
GOOD_SCENARIOS = [
    GoodScenario("precision80_attempt", 0.80, 0.72, 0.20, 0.08, 0.70, 0.66, 18.0, 0.20, 500.0, 260.0, 7.0, 450.0),
    GoodScenario("precision70_coverage", 0.70, 0.63, 0.45, 0.20, 0.62, 0.58, 16.0, 0.45, 900.0, 150.0, 4.5, 300.0),
    GoodScenario("precision60_coverage", 0.60, 0.555, 0.65, 0.35, 0.54, 0.51, 14.0, 0.75, 1250.0, 90.0, 2.8, 200.0),
    GoodScenario("precision55_mass", 0.55, 0.515, 0.80, 0.50, 0.50, 0.485, 12.0, 1.10, 1550.0, 55.0, 2.0, 120.0),
    GoodScenario("max_profit_like", 0.0, 0.0, 0.85, 0.55, 0.44, 0.415, 10.0, 0.50, 1200.0, 20.0, 1.15, 0.0),
    GoodScenario("max_recall_soft", 0.0, 0.0, 0.90, 0.65, 0.405, 0.395, 8.0, 1.40, 1800.0, 10.0, 0.85, 0.0),
]
