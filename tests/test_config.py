"""Presets."""

from tidemark.operators import signals
from tidemark.plans import config


def test_presets_name_features_of_the_signal_table():
    every = {f for fs in config.FEATURE_SETS.values() for f in fs}
    assert every <= set(signals.FEATURES) and every <= set(config.FEATURE_GROUPS)
    assert config.features("core2") == config.features("no_today")
    assert "intraday_return" not in config.features("all_no_today_no_intraday") and "intraday_return" in config.features("all_no_today")
    assert config.features(custom=["today_pct", "vol5"]) == ["vol5"]
    assert config.ops(["dist_to_ma5", "max_drop_7d", "vol5"]) == {"dist_to_ma5": [">=", "<="], "max_drop_7d": ["<="], "vol5": [">="]}
