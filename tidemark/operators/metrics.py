"""Rule, return, class and regression metrics as aggregations.

"coverage" has two meanings among miners; here ``pos_recall`` is the share of positives
that a rule selects and ``selected_rate`` the share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio


def wilson(positive: Column, n: Column, z: float = 1.96, empty=None, floor: bool = False) -> Column:
    """Lower bound of the share positive / n; ``empty`` where n is 0; ``floor``: not below 0."""
    p, n = ratio(positive, n), F.when(n > 0, n.cast("double"))
    bound = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    bound = F.greatest(bound, F.lit(0.0)) if floor else bound
    return F.coalesce(bound, F.lit(empty)) if empty is not None else bound


def flag(c: str | Column) -> Column:
    """1 where true, else 0."""
    x = F.col(c) if isinstance(c, str) else c
    return F.coalesce(x.cast("boolean"), F.lit(False)).cast("int")


def counts(mask: Column, y: Column, prefix: str = "") -> list[Column]:
    """Aggregates that rule_columns() turns into metrics."""
    m, y = flag(mask), flag(y)
    return [F.sum(m).alias(f"{prefix}selected_count"), F.sum(m * y).alias(f"{prefix}positive_count"), F.sum(y).alias(f"{prefix}total_positive"), F.count(F.lit(1)).alias(f"{prefix}total_count")]


def rule_columns(prefix: str = "", z: float = 1.96) -> dict[str, Column]:
    n, pos, all_pos, total = (F.col(f"{prefix}{c}") for c in ("selected_count", "positive_count", "total_positive", "total_count"))
    precision, base = ratio(pos, n), ratio(all_pos, total)
    return {
        f"{prefix}precision": precision,
        f"{prefix}precision_lcb": wilson(pos, n, z),
        f"{prefix}base_rate": base,
        f"{prefix}lift": F.try_divide(precision, base),
        f"{prefix}pos_recall": F.coalesce(ratio(pos, all_pos), F.lit(0.0)),
        f"{prefix}selected_rate": F.coalesce(ratio(n, total), F.lit(0.0)),
    }


def return_aggs(ret: Column, mask: Column, median: bool = True) -> list[Column]:
    r = F.when(flag(mask) == 1, ret)
    out = [
        F.avg(r).alias("avg_return"),
        F.coalesce(F.sum(r), F.lit(0.0)).alias("sum_return"),
        F.avg((r > 0).cast("double")).alias("win_rate_return"),
        F.avg(F.when(r > 0, r)).alias("avg_win"),
        F.avg(F.when(r < 0, r)).alias("avg_loss"),
        F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)).alias("gross_win"),
        F.coalesce(F.sum(F.when(r < 0, r)), F.lit(0.0)).alias("gross_loss"),
    ]
    return out + ([F.median(r).alias("median_return")] if median else [])


def return_columns() -> dict[str, Column]:
    return {"win_loss_ratio": F.try_divide(F.col("avg_win"), F.abs("avg_loss")), "profit_factor": F.when(F.col("gross_loss") < 0, F.col("gross_win") / F.abs("gross_loss"))}


def rule_metrics(df: DataFrame, mask: Column, y: Column, ret: Column | None = None, by: list[str] | None = None, median: bool = True) -> DataFrame:
    """One row for each group with the metrics of a mask against a label, and of returns."""
    aggs = counts(mask, y) + (return_aggs(ret, mask, median) if ret is not None else [])
    out = df.groupBy(*(by or [])).agg(*aggs)
    return out.withColumns(rule_columns() | (return_columns() if ret is not None else {}))


def many_rules(df: DataFrame, rules: dict[str, Column], y: Column, ret: Column | None = None, by: list[str] | None = None, batch: int = 100) -> DataFrame:
    """rule_metrics of many rules, in one pass for each batch: every rule is a set of
    conditional aggregates in one row, which is then unpacked."""
    out = None
    names = list(rules)
    for i in range(0, len(names), batch):
        aggs = [F.sum(flag(y)).alias("total_positive"), F.count(F.lit(1)).alias("total_count")]
        parts = []
        for k, name in enumerate(names[i : i + batch]):
            m = flag(rules[name])
            aggs += [F.sum(m).alias(f"n{k}"), F.sum(m * flag(y)).alias(f"p{k}")]
            part = [F.lit(name).alias("rule"), F.col(f"n{k}").alias("selected_count"), F.col(f"p{k}").alias("positive_count")]
            if ret is not None:
                r = F.when(m == 1, ret)
                aggs += [F.sum(r).alias(f"r{k}"), F.sum(F.when(r > 0, r)).alias(f"w{k}"), F.sum(F.when(r < 0, r)).alias(f"l{k}")]
                part += [F.col(f"r{k}").alias("sum_return"), F.col(f"w{k}").alias("gross_win"), F.col(f"l{k}").alias("gross_loss")]
            parts.append(F.struct(*part))
        wide = df.groupBy(*(by or [])).agg(*aggs)
        rows = wide.select(*(by or []), "total_positive", "total_count", F.inline(F.array(*parts)))
        out = rows if out is None else out.unionByName(rows)
    out = out.withColumns(rule_columns())
    if ret is not None:
        out = out.withColumns({"avg_return": ratio("sum_return", "selected_count"), "profit_factor": F.when(F.col("gross_loss") < 0, F.coalesce("gross_win", F.lit(0.0)) / F.abs("gross_loss"))})
    return out


def monthly_summary(monthly: DataFrame, by: list[str], least: int = 5, precision: float = 0.42, lift: float | None = 1.05, ret: float = 0.0, crash_precision: float = 0.3, crash_return: float = -1.0) -> DataFrame:
    """Stability over months with at least ``least`` selected rows; population deviations.

    Without usable months every month is bad and a crash. ``lift`` None: not part of passing.
    """
    ok = F.col("selected_count") >= least
    good = (F.col("precision") >= precision) & (F.col("avg_return") >= ret)
    good = good & (F.col("lift") >= lift) if lift is not None else good
    crash = (F.col("precision") < crash_precision) | (F.col("avg_return") < crash_return)
    when = lambda c: F.when(ok, F.col(c))
    aggs = [F.sum(flag(ok)).alias("n_usable_months"), F.count(F.lit(1)).alias("_months")]
    for c, name in (("precision", "precision"), ("avg_return", "return")):
        aggs += [F.avg(when(c)).alias(f"mean_month_{name}"), F.min(when(c)).alias(f"min_month_{name}"), F.stddev_pop(when(c)).alias(f"std_month_{name}")]
    aggs += [F.avg(when("selected_count")).alias("mean_month_count"), F.sum("selected_count").alias("total_month_count"), F.sum(flag(ok & good)).alias("_good"), F.sum(flag(ok & crash)).alias("_crash")]
    out = monthly.groupBy(*by).agg(*aggs)
    usable = F.col("n_usable_months") > 0
    return out.withColumns(
        {
            "pass_month_rate": F.coalesce(ratio("_good", "n_usable_months"), F.lit(0.0)),
            "bad_month_count": F.when(usable, F.col("n_usable_months") - F.col("_good")).otherwise(F.col("_months")),
            "crash_month_count": F.when(usable, F.col("_crash")).otherwise(F.col("_months")),
        }
    ).drop("_good", "_crash", "_months")


def ev_metrics(df: DataFrame, mask: Column, level: int = 10, target: float = 10.0, stop: float = -6.0, by: list[str] | None = None) -> DataFrame:
    """Rates of the four outcomes, expected value two ways, profit factor, edge and timing."""
    m = flag(mask) == 1
    won, lost, same, none = (F.col(f"{c}_{level}") for c in ("target_before_stop", "stop_before_target", "target_stop_same_day", "no_target_no_stop"))
    share = lambda c, name: F.avg(F.when(m, flag(c).cast("double"))).alias(name)
    day, out_day = F.when(m & won, F.col(f"day_to_{level}")), F.when(m & lost, F.col("stop_day"))
    aggs = [F.sum(flag(mask)).alias("n"), share(won, "win_rate"), share(lost, "loss_rate"), share(same, "same_day_rate"), share(none, "none_rate"), F.avg(day).alias("day_mean")]
    aggs += [F.percentile(day, F.lit(q)).alias(f"day_p{round(q * 100)}") for q in (0.5, 0.75, 0.9)]
    aggs += [F.avg((day <= k).cast("double")).alias(f"target_within_{k}d") for k in (3, 4, 5)] + [F.avg((out_day <= k).cast("double")).alias(f"stop_within_{k}d") for k in (2, 3)]
    out = df.groupBy(*(by or [])).agg(*aggs)
    gain, loss = F.col("win_rate") * target, F.col("loss_rate") * abs(stop)
    even = abs(stop) / (target + abs(stop))
    return out.withColumns(
        {
            "risk_reward": F.lit(target / abs(stop)),
            "break_even": F.lit(even),
            "ev": gain + F.col("loss_rate") * stop,
            "ev_same_as_win": (F.col("win_rate") + F.col("same_day_rate")) * target + F.col("loss_rate") * stop,
            "profit_factor": F.try_divide(gain, loss),
            "edge": F.col("win_rate") - even,
        }
    )


def class_mix(df: DataFrame, mask: Column, column: str = "target_class", by: list[str] | None = None) -> DataFrame:
    """How the selected rows spread over classes 0 to 3, and what share of each class they take."""
    m = flag(mask)
    is_class = lambda k: flag(F.col(column) == k)
    aggs = [F.sum(m).alias("n"), F.count(F.lit(1)).alias("total")] + [x for k in range(4) for x in (F.sum(m * is_class(k)).alias(f"class{k}"), F.sum(is_class(k)).alias(f"all{k}"))]
    out = df.groupBy(*(by or [])).agg(*aggs)
    cols = {f"class{k}_rate": ratio(f"class{k}", "n") for k in range(4)} | {f"loss{k}_rate": ratio(f"class{k}", f"all{k}") for k in range(4)}
    cols |= {"class23_rate": ratio(F.col("class2") + F.col("class3"), "n"), "coverage": ratio("n", "total"), "base_rate": ratio("all0", "total"), "wilson_low": wilson(F.col("class0"), F.col("n"), empty=0.0, floor=True)}
    out = out.withColumns(cols)
    return out.withColumn("lift", F.try_divide(F.col("class0_rate"), F.col("base_rate"))).drop(*[f"all{k}" for k in range(4)])


def deciles(df: DataFrame, feature: str, bins: int = 10) -> DataFrame:
    """Rows with bin_left and bin_right: right-closed quantile bins, the lowest value included;
    equal edges are dropped. Rows without the feature are left out."""
    edges = df.agg(F.array_distinct(F.percentile(feature, F.array(*[F.lit(i / bins) for i in range(bins + 1)]))).alias("edges"))
    rows = df.where(F.col(feature).isNotNull()).crossJoin(F.broadcast(edges))  # one row
    at = F.greatest(F.size(F.filter("edges", lambda e: e < F.col(feature))), F.lit(1))
    return rows.where("size(edges) > 1").withColumn("bin_left", F.get("edges", at - 1)).withColumn("bin_right", F.get("edges", at)).drop("edges")


def decile_report(df: DataFrame, feature: str, y: Column, ret: Column, bins: int = 10) -> DataFrame:
    whole = df.agg(F.avg(flag(y).cast("double")).alias("base_rate"))
    out = deciles(df.select(feature, flag(y).alias("_y"), ret.alias("_r")), feature, bins).groupBy("bin_left", "bin_right").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("positives"), F.avg("_r").alias("avg_return"))
    out = out.crossJoin(F.broadcast(whole))
    return out.select(F.lit(feature).alias("feature"), "bin_left", "bin_right", "n", "positives", ratio("positives", "n").alias("precision"), F.try_divide(ratio("positives", "n"), F.col("base_rate")).alias("lift"), "avg_return")


def woe_iv(df: DataFrame, feature: str, y: Column, bins: int = 10, smooth: float = 0.5) -> DataFrame:
    """Weight of evidence by bin and its share of the information value."""
    b = deciles(df.select(feature, flag(y).alias("_y")), feature, bins).groupBy("bin_left", "bin_right").agg(F.sum("_y").alias("good"), F.sum(1 - F.col("_y")).alias("bad"))
    whole = Window.partitionBy(F.lit(1))
    k = F.count(F.lit(1)).over(whole)
    good = (F.col("good") + smooth) / (F.sum("good").over(whole) + smooth * k)
    bad = (F.col("bad") + smooth) / (F.sum("bad").over(whole) + smooth * k)
    return b.select(F.lit(feature).alias("feature"), "bin_left", "bin_right", "good", "bad", F.ln(good / bad).alias("woe"), ((good - bad) * F.ln(good / bad)).alias("iv"))


def long_form(df: DataFrame, names: list[str], keep: list[Column] | None = None) -> DataFrame:
    """One row for each feature and row: feature, value and the kept columns."""
    return df.select(*(keep or []), F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in names])))


def auc(df: DataFrame, names: list[str], y: Column) -> DataFrame:
    """Mann–Whitney AUC of each feature, turned so that it is 0.5 or more, and its direction.

    Rows are counted per distinct value before anything is ordered.
    """
    long = long_form(df, names, [flag(y).alias("_y")]).where("value is not null")
    counts_ = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("ties"), F.sum("_y").alias("pos"))
    below = Window.partitionBy("feature").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts_.withColumn("rank", F.coalesce(F.sum("ties").over(below), F.lit(0)) + (F.col("ties") + 1) / 2)
    out = ranked.groupBy("feature").agg(F.sum(F.col("rank") * F.col("pos")).alias("rank_sum"), F.sum("pos").alias("n_pos"), F.sum(F.col("ties") - F.col("pos")).alias("n_neg"))
    raw = F.try_divide(F.col("rank_sum") - F.col("n_pos") * (F.col("n_pos") + 1) / 2, F.col("n_pos") * F.col("n_neg"))
    return out.select("feature", "n_pos", "n_neg", raw.alias("auc_raw"), F.greatest(raw, 1 - raw).alias("auc"), F.when(raw >= 0.5, ">=").otherwise("<=").alias("direction"))


def spearman(df: DataFrame, names: list[str]) -> DataFrame:
    """Rank correlations of all pairs of features over the rows that have both."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    cells = F.inline(F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs]))
    both = df.select(cells).where("x is not null and y is not null").groupBy("feature_a", "feature_b", "x", "y").agg(F.count(F.lit(1)).alias("n"))

    def ranks(c):
        c_counts = both.groupBy("feature_a", "feature_b", c).agg(F.sum("n").alias("ties"))
        below = Window.partitionBy("feature_a", "feature_b").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
        return c_counts.select("feature_a", "feature_b", c, (F.coalesce(F.sum("ties").over(below), F.lit(0)) + (F.col("ties") + 1) / 2).alias(f"r{c}"))

    on = ["feature_a", "feature_b"]
    ranked = both.join(ranks("x"), [*on, "x"]).join(ranks("y"), [*on, "y"])
    s = ranked.groupBy(*on).agg(F.sum("n").alias("n"), *[F.sum(e * F.col("n")).alias(a) for a, e in (("sx", F.col("rx")), ("sy", F.col("ry")), ("sxx", F.col("rx") * F.col("rx")), ("syy", F.col("ry") * F.col("ry")), ("sxy", F.col("rx") * F.col("ry")))])
    top = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    low = F.sqrt(F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * F.sqrt(F.col("n") * F.col("syy") - F.col("sy") * F.col("sy"))
    return s.select(*on, "n", F.try_divide(top, low).alias("rho"))


def mode(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """The most frequent value of each group and its rows; the least of equally frequent ones.

    Values are counted before they are compared, so no task holds a group's rows.
    """
    by = by or []
    counted = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*by).agg(F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("value"))).alias("_best")).select(*by, "_best.value", "_best.n")


def timing(df: DataFrame, day: str, mask: Column) -> DataFrame:
    """How many reach the level on each day, and the share so far."""
    c = df.where((flag(mask) == 1) & (F.col(day) > 0)).groupBy(F.col(day).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    run = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as days are watched
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).withColumn("cum_share", F.sum("n").over(run) / F.sum("n").over(Window.partitionBy(F.lit(1))))


def date_split(df: DataFrame, day: str = "today", parts: tuple[float, ...] = (0.6, 0.2), names: tuple[str, ...] = ("train", "selection", "final")) -> DataFrame:
    """Rows with a ``split`` by distinct days: the first int(n · share) days, and so on.

    Boundaries are days, so rows of one day stay together; with fewer days than parts,
    rows are dealt by their position instead. Every part has a day at least.
    """
    days = df.select(day).where(F.col(day).isNotNull()).distinct()
    n = days.count()
    if n < len(names):
        return row_split(df, [day], parts, names)
    cuts, share = [], 0.0
    for i, p in enumerate(parts):
        share += p
        low = cuts[-1] + 1 if cuts else 1
        cuts.append(min(max(int(n * share), low), n - (len(parts) - i)))
    ranked = days.withColumn("_i", F.row_number().over(Window.orderBy(day)))
    edges = [r[0] for r in ranked.where(F.col("_i").isin([c + 1 for c in cuts])).orderBy("_i").collect()]
    part = F.lit(names[-1])
    for name, edge in reversed(list(zip(names, edges, strict=False))):
        part = F.when(F.col(day) < F.lit(edge), name).otherwise(part)
    return df.where(F.col(day).isNotNull()).withColumn("split", part)


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``at``, their position from 1 in an order whose first key is a day.

    Days are counted and summed up (as many rows as there are days); rows are numbered
    within their day. No task orders all rows.
    """
    first, rest = order[0], order[1:] or order
    starts = df.groupBy(F.col(first).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.withColumn("_before", F.sum("_n").over(Window.orderBy("_day")) - F.col("_n")).drop("_n")
    numbered = df.withColumn("_k", F.row_number().over(Window.partitionBy(first).orderBy(*rest)))
    return numbered.join(starts, F.col(first).eqNullSafe(F.col("_day"))).withColumn("at", F.col("_before") + F.col("_k")).drop("_day", "_before", "_k")


def row_split(df: DataFrame, order: list[str], parts: tuple[float, ...] = (0.7,), names: tuple[str, ...] = ("train", "valid")) -> DataFrame:
    """Rows with a ``split`` by position in an order; rows of one day may fall apart."""
    n, cuts, share = df.count(), [], 0.0
    for p in parts:
        share += p
        cuts.append(int(n * share))
    part = F.lit(names[-1])
    for name, cut in reversed(list(zip(names, cuts, strict=False))):
        part = F.when(F.col("at") <= cut, name).otherwise(part)
    return positions(df, order).withColumn("split", part).drop("at")


def regression(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None, eps: float = 1e-8) -> DataFrame:
    """MSE, RMSE, MAE, MAPE, sMAPE and R2 of arrays by horizon, then averaged over horizons."""
    rows = df.select(*(by or []), F.posexplode(F.arrays_zip(F.col(actual).alias("a"), F.col(predicted).alias("p"))).alias("h", "x")).select(*(by or []), "h", F.col("x.a").alias("a"), F.col("x.p").alias("p"))
    err = F.col("a") - F.col("p")
    per = rows.groupBy(*(by or []), "h").agg(
        F.avg(err * err).alias("mse"),
        F.avg(F.abs(err)).alias("mae"),
        F.avg(F.abs(err) / F.greatest(F.abs("a"), F.lit(eps))).alias("mape"),
        F.avg(200 * F.abs(err) / F.greatest(F.abs("a") + F.abs("p"), F.lit(1e-12))).alias("smape"),
        F.var_pop("a").alias("_var"),
        F.count(F.lit(1)).alias("n"),
    )
    per = per.withColumn("r2", 1 - F.try_divide(F.col("mse"), F.col("_var")))
    out = per.groupBy(*(by or [])).agg(F.avg("mse").alias("mse"), F.avg("mae").alias("mae"), (100 * F.avg("mape")).alias("mape"), F.avg("smape").alias("smape"), F.avg("r2").alias("r2"), F.max("n").alias("n"))
    return out.withColumn("rmse", F.sqrt("mse"))


def best_f1(df: DataFrame, score: str, y: Column) -> DataFrame:
    """The threshold with the best F1 (the largest on ties): counts per score, then running sums."""
    c = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(flag(y)).alias("pos"), F.count(F.lit(1)).alias("n"))
    down = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    t = c.withColumn("tp", F.sum("pos").over(down)).withColumn("k", F.sum("n").over(down)).withColumn("all_pos", F.sum("pos").over(Window.partitionBy(F.lit(1))))
    f1 = F.try_divide(2.0 * F.col("tp"), (F.col("k") + F.col("all_pos")).cast("double"))
    return t.withColumn("f1", f1).agg(F.max_by(F.struct("threshold", "f1", ratio("tp", "k").alias("precision"), ratio("tp", "all_pos").alias("recall")), F.struct("f1", "threshold")).alias("b")).select("b.*")
