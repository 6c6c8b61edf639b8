"""Choosing avoid rules under constraints: scenarios run over a table of rule patterns.

Rows are grouped by the set of candidate rules that hold in them, by split: what a step
needs are sums over these patterns of what a rule adds to the union so far. Few patterns
are held by the driver as bits; more stay a table in Spark, and a step is one aggregation.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.folders import kept
from tidemark.operators.heapminer import Mined
from tidemark.operators.rules import Rule
from tidemark.operators.search import lcb

TRAIN, VALID = 0, 1


class Coverage:
    """Rows by class that rules add to a union, on train and valid rows."""

    def __init__(self, rows: DataFrame, rules: list[Rule], classes: int, most: int = 200_000):
        """``rows``: features, ``k`` (class), ``split`` ('train' or 'valid')."""
        self.rules, self.classes, self.evaluated, self.passes = rules, classes, 0, 0
        atoms = sorted({a for r in rules for a in r}, key=lambda a: a.key)
        place = {a: i for i, a in enumerate(atoms)}
        local = [[place[a] for a in r] for r in rules]
        names = sorted({a.feature for a in atoms})

        def patterns(batches):
            for b in batches:
                cols = {c: b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names}
                with np.errstate(invalid="ignore"):
                    held = [{">=": np.greater_equal, "<=": np.less_equal, ">": np.greater, "==": np.equal}[a.op](cols[a.feature], a.threshold) for a in atoms]
                bits = np.ones((b.num_rows, len(local)), bool)
                for j, parts in enumerate(local):
                    for i in parts:
                        bits[:, j] &= held[i]
                packed = np.packbits(bits, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in packed], pa.binary()), b.column("k"), b.column("split")], names=["bits", "k", "split"])

        found = rows.select(*names, "k", "split").mapInArrow(patterns, "bits binary, k int, split string")
        sums = [F.count_if(F.col("k") == c).alias(f"k{c}") for c in range(classes)]
        table = kept(found.groupBy("bits", "split").agg(*sums))
        self.whole = np.zeros((2, classes), np.int64)
        for r in table.groupBy("split").agg(*[F.sum(f"k{c}").alias(f"k{c}") for c in range(classes)]).collect():
            self.whole[int(r.split == "valid")] = [r[f"k{c}"] for c in range(classes)]
        first = table.limit(most + 1).collect()  # bounded
        if len(first) <= most:
            self.table = None
            self.bits = np.unpackbits(np.array([list(r.bits) for r in first], np.uint8).reshape(len(first), -1), axis=1)[:, : len(rules)].astype(bool)
            self.values = np.zeros((len(first), 2, classes))
            for i, r in enumerate(first):
                self.values[i, int(r.split == "valid")] = [r[f"k{c}"] for c in range(classes)]
        else:
            self.table = table

    def added(self, chosen: list[int], candidates: list[int]) -> np.ndarray:
        """[candidate, split, class]: rows that each candidate alone would add to the union of the chosen."""
        self.evaluated += len(candidates)
        chosen, candidates = list(chosen), list(candidates)
        return self._sums(lambda bits: bits[:, candidates] & ~bits[:, chosen].any(1)[:, None], len(candidates))

    def union(self, chosen: list[int]) -> np.ndarray:
        """[split, class]: rows in which any of the chosen holds."""
        chosen = list(chosen)
        return self._sums(lambda bits: bits[:, chosen].any(1)[:, None], 1)[0]

    def _sums(self, columns, count: int) -> np.ndarray:
        if not count:
            return np.zeros((0, 2, self.classes), np.int64)
        if self.table is None:
            return np.rint(np.einsum("pc,psk->csk", columns(self.bits).astype(float), self.values)).astype(np.int64)
        self.passes += 1
        classes, width = self.classes, 2 * self.classes

        def run(batches):
            total = np.zeros((count, 2, classes), np.int64)
            for b in batches:
                bits = np.unpackbits(np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint8).reshape(b.num_rows, -1), axis=1).astype(bool)
                new = columns(bits).astype(float)
                values = np.stack([b.column(f"k{c}").to_numpy(zero_copy_only=False) for c in range(classes)], 1).astype(float)
                for s, name in enumerate(("train", "valid")):
                    part = np.array([x == name for x in b.column("split").to_pylist()], bool)
                    total[:, s] += np.rint(new[part].T @ values[part]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(range(count), pa.int64()), pa.array(list(total.reshape(count, -1)), pa.list_(pa.int64()))], names=["c", "v"])

        sums = self.table.mapInArrow(run, "c long, v array<long>").groupBy("c").agg(*[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(width)])
        out = np.zeros((count, width), np.int64)
        for r in sums.collect():  # a row a candidate
            out[r.c] = [r[f"v{i}"] for i in range(width)]
        return out.reshape(count, 2, classes)


# -- rules that avoid stops --------------------------------------------------------------------------


@dataclass(frozen=True)
class Valid:
    """What a candidate must reach on train and valid rows, and the weights of its stability."""

    # Fixed values.
    train_count: int = 80
    valid_count: int = 35
    train_rate: float = 0.58
    valid_rate: float = 0.60
    train_lift: float = 1.25
    valid_lift: float = 1.15
    gap: float = 0.14
    valid_weight: float = 1.25
    gap_power: float = 2.0


@dataclass(frozen=True)
class StopScenario:
    """Constraints on what a rule adds and on the union's rate, and what is maximised."""

    name: str
    max_rules: int
    added_total: int
    added_target: int
    added_valid_total: int
    added_valid_target: int
    train_rate: float
    valid_rate: float
    gap: float
    next_rate: float
    drop: float
    objective: str = "rate"


@dataclass(frozen=True)
class Candidate:
    """A mined rule with (total, target) on train and valid rows."""

    rule: int
    train: tuple[int, int]
    valid: tuple[int, int]
    stability: float
    passes: bool


def rate(total: int, target: int) -> float:
    return target / total if total else 0.0


def candidates(cover: Coverage, valid: Valid = Valid()) -> list[Candidate]:
    """All rules of the coverage with their stability, the most stable first."""
    base = [rate(int(w.sum()), int(w[1])) for w in cover.whole]
    out = []
    for i, v in enumerate(cover.added([], list(range(len(cover.rules))))):
        (tn, tp), (vn, vp) = ((int(x.sum()), int(x[1])) for x in v)
        tr, vr = rate(tn, tp), rate(vn, vp)
        lifts = [r / b if b else 0.0 for r, b in zip((tr, vr), base, strict=True)]
        gap = abs(tr - vr)
        stability = min(tr, vr) * math.log1p(tn) * math.log1p(vn) * max(lifts[0], 0.01) * max(lifts[1], 0.01) ** valid.valid_weight * max(1 - gap, 0.01) ** valid.gap_power
        passes = tn >= valid.train_count and vn >= valid.valid_count and tr >= valid.train_rate and vr >= valid.valid_rate and lifts[0] >= valid.train_lift and lifts[1] >= valid.valid_lift and gap <= valid.gap
        out.append(Candidate(i, (tn, tp), (vn, vp), stability, passes))
    return sorted(out, key=lambda c: (-c.stability, -min(rate(*c.train), rate(*c.valid)), -c.valid[0], c.rule))


def _weighed(s: StopScenario, next_rate, vr, tr, target, total, valid_false, train_false, stability, gap):
    """The score of an addition, for numbers or for bounds of them."""
    # Weights of the two objectives.
    if s.objective == "rate":
        score = next_rate * 160 + vr * 90 + np.minimum(tr, vr) * 35 + target * 1.15 + total * 0.05 - valid_false * 0.9 - train_false * 0.14 + stability * 0.05
        power = 2.0
    else:
        score = target * 2 + total * 0.15 + vr * 20 + np.minimum(tr, vr) * 10 - valid_false * 0.35 - train_false * 0.1 + stability * 0.08
        power = 1.5
    # a negative score is the greater the larger the gap
    return np.where(score > 0, score * np.maximum(1 - gap[0], 0.01) ** power, score * np.maximum(1 - gap[1], 0.01) ** power)


def _addition(s: StopScenario, c: Candidate, v: np.ndarray, union: np.ndarray, first: bool) -> tuple | None:
    """The key by which an addition is chosen, None if the scenario forbids it. ``v``, ``union``: [split, (false, true)]."""
    (tf, tt), (vf, vt) = v.tolist()
    tn, vn = tf + tt, vf + vt
    if tn < max(s.added_total, 1) or vn < max(s.added_valid_total, 1) or tt < s.added_target or vt < s.added_valid_target:
        return None
    tr, vr = tt / tn, vt / vn
    gap = abs(tr - vr)
    now = rate(int(union[VALID].sum()), int(union[VALID][1]))
    after = (int(union[VALID][1]) + vt) / (int(union[VALID].sum()) + vn)
    if tr < s.train_rate or vr < s.valid_rate or gap > s.gap or after < s.next_rate or (not first and after < now - s.drop):
        return None
    score = float(_weighed(s, after, vr, tr, vt, vn, vf, tf, c.stability, (gap, gap)))
    return score, after, vr, vt, -vf, c.stability


def _bounds(s: StopScenario, stale: np.ndarray, seen: np.ndarray, union: np.ndarray, stability: np.ndarray, first: bool) -> np.ndarray:
    """An upper bound of each candidate's score from what it added to an earlier union; -inf
    where the scenario surely forbids it.

    What a rule adds shrinks as the union grows, by no more than the union has grown: so
    its false and true rows lie between the earlier ones and those less the growth.
    """
    high = stale.astype(float)  # [candidate, split, (false, true)]
    low = np.maximum(high - (union[None] - seen), 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        top = np.nan_to_num(high[:, :, 1] / (high[:, :, 1] + low[:, :, 0]))
        bottom = np.nan_to_num(low[:, :, 1] / (low[:, :, 1] + high[:, :, 0]))
    n, t = union[VALID].sum(), union[VALID][1]
    true, false = high[:, VALID, 1], low[:, VALID, 0]
    after = (t + true) / np.maximum(n + true + false, 1)
    apart = np.maximum(np.maximum(bottom[:, TRAIN] - top[:, VALID], bottom[:, VALID] - top[:, TRAIN]), 0.0)
    widest = np.maximum(top[:, TRAIN] - bottom[:, VALID], top[:, VALID] - bottom[:, TRAIN])
    score = _weighed(s, after, top[:, VALID], top[:, TRAIN], true, high[:, VALID].sum(1), false, low[:, TRAIN, 0], stability, (apart, widest))
    now = t / n if n else 0.0
    eps = 1e-9
    never = (high[:, TRAIN].sum(1) < max(s.added_total, 1)) | (high[:, VALID].sum(1) < max(s.added_valid_total, 1)) | (high[:, TRAIN, 1] < s.added_target) | (true < s.added_valid_target)
    never |= (top[:, TRAIN] < s.train_rate - eps) | (top[:, VALID] < s.valid_rate - eps) | (apart > s.gap + eps) | (after < s.next_rate - eps)
    if not first:
        never |= after < now - s.drop - eps
    return np.where(never, -np.inf, score + eps * (1 + np.abs(score)))


def stop_set(cover: Coverage, usable: list[Candidate], s: StopScenario, batch: int = 16) -> list[Candidate]:
    """Greedily the best addition until none is allowed; the same rules as by trying all each time.

    Bounds from stale additions order a heap; only its top is evaluated again, ``batch`` at a
    time, until the best that is known exactly is above all other bounds. Ties go to the
    candidate that comes first.
    """
    stale = np.array([[[c.train[0] - c.train[1], c.train[1]], [c.valid[0] - c.valid[1], c.valid[1]]] for c in usable]).reshape(-1, 2, 2)
    seen = np.zeros_like(stale)
    stability = np.array([c.stability for c in usable])
    union, chosen = np.zeros((2, 2), np.int64), []
    while len(chosen) < s.max_rules:
        exact: dict[int, tuple | None] = {}
        best = None
        bound = _bounds(s, stale, seen, union, stability, not chosen)
        heap = [(-b, i) for i, b in enumerate(bound.tolist()) if b > -math.inf and i not in chosen]
        heapq.heapify(heap)
        while heap and (best is None or -heap[0][0] >= best[0][0]):
            part = []
            while heap and len(part) < batch and (best is None or -heap[0][0] >= best[0][0]):
                part.append(heapq.heappop(heap)[1])
            fresh = [i for i in part if (seen[i] == union).all()]
            again = [i for i in part if i not in fresh]
            if again:
                stale[again] = cover.added([usable[i].rule for i in chosen], [usable[i].rule for i in again])
                seen[again] = union
            for i in part:
                exact[i] = _addition(s, usable[i], stale[i], union, not chosen)
                if exact[i] is not None and (best is None or exact[i] > best[0] or (exact[i] == best[0] and i < best[1])):
                    best = exact[i], i
        if best is None:
            break
        chosen.append(best[1])
        union = union + stale[best[1]]
    return [usable[i] for i in chosen]


@dataclass(frozen=True)
class Choice:
    """Bounds by which one of several scenarios' sets is taken."""

    # Fixed values: (rate, coverage, rows) of three tiers, then what a set must keep of the widest one.
    tiers: tuple[tuple[float, float, int], ...] = ((0.68, 0.125, 550), (0.69, 0.11, 500), (0.675, 0.1, 450))
    rate_gain: float = 0.006
    keep: tuple[float, float] = (0.82, 0.72)
    least: tuple[float, int] = (0.08, 300)
    buckets: tuple[tuple[float, float], ...] = ((0.94, 0.92), (0.92, 0.9), (0.9, 0.88))
    gap_weight: float = 0.75


def union_facts(cover: Coverage, chosen: list[int]) -> list[dict]:
    """matched, target, rate and coverage of a union on train and valid rows."""
    out = []
    for s, v in enumerate(cover.union(chosen)):
        n, t = int(v.sum()), int(v[1])
        out.append({"matched": n, "target": t, "rate": rate(n, t), "coverage": rate(int(cover.whole[s][1]), t)})
    return out


def chosen_scenario(results: list[dict], choice: Choice = Choice()) -> int | None:
    """The number of the result that is taken; adds ``score`` to each.

    By tiers of rate and coverage; else sets that gain rate over the widest one and keep
    most of its coverage, by how much they keep; else the best score.
    """
    if not results:
        return None
    valid = [r["valid"] for r in results]
    widest = max(valid, key=lambda v: (v["coverage"], v["matched"], v["rate"]))
    least_cover = max(choice.least[0], widest["coverage"] * choice.keep[0])
    least_rows = max(choice.least[1], int(widest["matched"] * choice.keep[1]))
    accepted = []
    for i, (r, v) in enumerate(zip(results, valid, strict=True)):
        gain = v["rate"] - widest["rate"]
        wide = v["coverage"] >= least_cover and v["matched"] >= least_rows
        # The weights of the score.
        score = v["rate"] * 100_000 + v["coverage"] * 5_000 + math.log1p(v["matched"]) * 100
        score += 50_000 if wide else -max(0.0, least_cover - v["coverage"]) * 200_000 - max(0, least_rows - v["matched"]) * 5
        if wide and gain >= choice.rate_gain:
            score += 200_000 + gain * 500_000
            accepted.append(i)
        r["score"] = score
    steady = lambda i: (valid[i]["rate"] - abs(results[i]["train"]["rate"] - valid[i]["rate"]) * choice.gap_weight, valid[i]["coverage"], valid[i]["matched"])
    for least in choice.tiers:
        if good := [i for i, v in enumerate(valid) if v["rate"] >= least[0] and v["coverage"] >= least[1] and v["matched"] >= least[2]]:
            return max(good, key=steady)
    plain = lambda i: (valid[i]["rate"], valid[i]["coverage"], valid[i]["matched"])
    share = lambda i, k: valid[i][k] / widest[k] if widest[k] else 0.0
    for cover_kept, rows_kept in choice.buckets:
        if bucket := [i for i in accepted if share(i, "coverage") >= cover_kept and share(i, "matched") >= rows_kept]:
            return max(bucket, key=plain)
    if accepted:
        return max(accepted, key=plain)
    return max(range(len(results)), key=lambda i: (results[i]["score"], valid[i]["rate"], valid[i]["coverage"]))


def stop_scenarios(cover: Coverage, options: list[StopScenario], valid: Valid = Valid(), choice: Choice = Choice()) -> tuple[list[dict], int | None]:
    """A result for each scenario (name, members, facts on train and valid, score), and which is taken."""
    usable = [c for c in candidates(cover, valid) if c.passes]
    results = []
    for s in options:
        members = [c.rule for c in stop_set(cover, usable, s)]
        train, held = union_facts(cover, members)
        results.append({"name": s.name, "members": members, "train": train, "valid": held})
    return results, chosen_scenario(results, choice)


# -- rules that avoid rows which never bounce ----------------------------------------------------------


@dataclass(frozen=True)
class Tier:
    """A gate for candidates on valid rows."""

    name: str
    count: int
    rate: float
    lift: float
    wilson: float
    class1: float
    class2: float
    class3: float
    class23: float


@dataclass(frozen=True)
class AvoidScenario:
    """Caps on classes 2 and 3 of the union, what a rule must add, coverage aimed at, and weights."""

    name: str
    target: float
    acceptable: float
    soft: float
    class23: float
    class3: float
    class2: float
    rate_pre: float
    rate_post: float
    added_rate: float
    added_rate_fill: float
    added_c23: float
    added_c23_fill: float
    added_c3: float
    coverage_w: float
    class0_w: float
    c23_penalty: float
    c3_penalty: float
    added_c23_penalty: float


@dataclass(frozen=True)
class AvoidCandidate:
    rule: int
    train: tuple[int, ...]
    valid: tuple[int, ...]
    score: float
    stable: float
    tier: str


def mix(counts, whole) -> dict[str, float]:
    """Rates of the classes among selected rows, and lift, coverage and Wilson bound of class 0."""
    n, total = int(sum(counts)), int(sum(whole))
    p = [rate(n, int(c)) for c in counts]
    base = rate(total, int(whole[0]))
    return {"n": n, "rate": p[0], "class1": p[1], "class2": p[2], "class3": p[3], "class23": rate(n, int(counts[2] + counts[3])), "lift": p[0] / base if base else 0.0, "coverage": rate(int(whole[0]), int(counts[0])), "wilson": max(0.0, lcb(int(counts[0]), n)) if n else 0.0}


def avoid_candidates(cover: Coverage, mined: list[Mined], tiers: list[Tier], least: int = 25, rate_: float = 0.32, lift: float = 0.66, wilson: float = 0.16) -> list[AvoidCandidate]:
    """Mined rules that hold up on train rows and reach a tier on valid rows, in the order of mining."""
    out = []
    for i, v in enumerate(cover.added([], list(range(len(cover.rules))))):
        tr, va = (mix(v[s], cover.whole[s]) for s in (TRAIN, VALID))
        if tr["n"] < least or tr["rate"] < rate_ or tr["lift"] < lift or tr["wilson"] < wilson:
            continue
        reached = next((t for t in tiers if va["n"] >= t.count and va["rate"] >= t.rate and va["lift"] >= t.lift and va["wilson"] >= t.wilson and va["class1"] <= t.class1 and va["class2"] <= t.class2 and va["class3"] <= t.class3 and va["class23"] <= t.class23), None)
        if reached is None:
            continue
        # What instability and lost rows of classes 2 and 3 take off.
        stable = mined[i].score * (1 - min(abs(tr["rate"] - va["rate"]), 0.7)) * max(0.02, 1 - va["class23"] * 1.2 - va["class3"] * 1.8)
        out.append(AvoidCandidate(i, tuple(v[TRAIN].tolist()), tuple(v[VALID].tolist()), mined[i].score, stable, reached.name))
    return out


def within_caps(m: dict, s: AvoidScenario) -> bool:
    return m["class23"] <= s.class23 and m["class3"] <= s.class3 and m["class2"] <= s.class2


def safe(m: dict, s: AvoidScenario) -> bool:
    """Whether a union may become the checkpoint: enough rows, caps held and a rate to show."""
    # Ten rows, and 0.12 below the scenario's rate.
    return m["n"] >= 10 and within_caps(m, s) and m["rate"] >= max(0.3, s.rate_post - 0.12)


def checkpoint_score(m: dict, s: AvoidScenario) -> float:
    # The weights of a checkpoint.
    score = m["coverage"] * 3_600_000 + m["rate"] * 20_000 - m["class23"] * s.c23_penalty * 1_000 - m["class3"] * s.c3_penalty * 1_000 - max(0.0, s.acceptable - m["coverage"]) * 5_200_000 + math.log1p(m["n"]) * 1_300
    return score + (900_000 if m["coverage"] >= s.acceptable else 0)


def result_score(m: dict, s: AvoidScenario) -> float:
    # The weights of a result and its bonuses.
    score = m["coverage"] * 2_500_000 + m["rate"] * 40_000 - m["class23"] * 350_000 - m["class3"] * 550_000 - max(0.0, s.acceptable - m["coverage"]) * 4_500_000 - abs(s.target - m["coverage"]) * 400_000 + math.log1p(m["n"]) * 1_000
    score += 650_000 * (m["coverage"] >= s.acceptable) + 250_000 * (m["coverage"] >= s.target)
    score += next((b for most, b in ((0.10, 140_000), (0.12, 90_000), (0.15, 40_000)) if m["class23"] <= most), 0)
    return score + next((b for most, b in ((0.05, 160_000), (0.06, 100_000), (0.08, 30_000)) if m["class3"] <= most), 0)


def _stage_key(s: AvoidScenario, c: AvoidCandidate, v: np.ndarray, union: np.ndarray, whole: np.ndarray, fill: bool) -> tuple | None:
    """The key of an addition in the primary or fill stage, None if it isn't allowed."""
    n, tn = int(v[VALID].sum()), int(v[TRAIN].sum())
    hit, c2, c3 = (int(v[VALID][k]) for k in (0, 2, 3))
    if n < (1 if fill else 3) or hit < (1 if fill else 2):
        return None
    added, train_added = hit / n, rate(tn, int(v[TRAIN][0]))
    least = s.added_rate_fill if fill else s.added_rate
    if added < least or train_added < max(0.08, least - 0.24) or (c2 + c3) / n > (s.added_c23_fill if fill else s.added_c23) or c3 / n > s.added_c3:
        return None
    m = mix(union[VALID] + v[VALID], whole)
    if m["rate"] < (s.rate_pre if m["coverage"] < s.soft else s.rate_post) or not within_caps(m, s):
        return None
    short = max(0.0, s.acceptable - m["coverage"])
    bonus = 1400 if m["coverage"] >= s.acceptable else 350 if m["coverage"] >= s.soft else 0
    # The weights of an addition.
    score = hit * (s.class0_w + (5 if fill else 0)) + n * (1.7 if fill else 1.0) + added * (4 if fill else 10) + max(0.0, lcb(hit, n)) * 3 + m["coverage"] * s.coverage_w + bonus
    score += max(0.0, s.class23 - m["class23"]) * 1800 + max(0.0, s.class3 - m["class3"]) * 2600 + int(v[TRAIN][0]) * 0.1 - (n - hit) * (0.5 if fill else 1.0) - (c2 + c3) * s.added_c23_penalty - c3 * (s.added_c23_penalty + 5)
    score += -m["class23"] * s.c23_penalty - m["class3"] * s.c3_penalty - m["class2"] * s.c23_penalty * 0.6 - short * 1800 + c.stable * 0.004
    return m["coverage"] >= s.acceptable, score, -short, -m["class3"], -m["class23"], hit, m["coverage"], m["rate"], -(c2 + c3), c.stable


def _repair_key(s: AvoidScenario, c: AvoidCandidate, v: np.ndarray, union: np.ndarray, whole: np.ndarray) -> tuple | None:
    n = int(v[VALID].sum())
    hit, c2, c3 = (int(v[VALID][k]) for k in (0, 2, 3))
    if n <= 0 or hit <= 0:
        return None
    m = mix(union[VALID] + v[VALID], whole)
    if not within_caps(m, s):
        return None
    # The weights of a repair.
    score = hit * 150 + hit / n * 22 + m["coverage"] * s.coverage_w - n * 0.16 - (c2 + c3 + c3 * 1.8) * 130 - m["class23"] * s.c23_penalty * 4 - m["class3"] * s.c3_penalty * 4.5 - max(0.0, s.target - m["coverage"]) * 1200 + c.stable * 0.001
    return m["coverage"] >= s.acceptable, score, hit, -(c2 + c3), -m["class3"], -m["class23"], m["coverage"], m["rate"]


@dataclass(frozen=True)
class AvoidResult:
    scenario: str
    members: tuple[int, ...]
    train: dict
    valid: dict
    score: float
    steps: tuple[tuple[str, int, float, float, float], ...]  # stage, rule, class 2, class 3 and both after the step


def avoid_scenario(cover: Coverage, pool: list[AvoidCandidate], s: AvoidScenario, max_rules: int = 220, repairs: int = 150, exchanges: int = 20) -> AvoidResult:
    """Primary additions, smaller fills until coverage is reached, repairs, and exchanges.

    Caps hold after every step. The best safe union is kept as a checkpoint; a repair only asks
    for the caps, so if the end is less than the checkpoint, the set goes back to it. Then members
    are exchanged for candidates outside as long as that gives a better checkpoint; ``exchanges``
    0 leaves this out. Of equal keys the candidate that comes first is taken.
    """
    whole, rules = cover.whole[VALID], [c.rule for c in pool]
    chosen: list[int] = []
    union = np.zeros((2, cover.classes), np.int64)
    steps: list[tuple] = []
    best: tuple[float, list[int], np.ndarray] | None = None

    def record(stage: str, i: int):
        nonlocal best
        m = mix(union[VALID], whole)
        steps.append((stage, rules[i], m["class2"], m["class3"], m["class23"]))
        if safe(m, s) and (best is None or checkpoint_score(m, s) > best[0]):
            best = checkpoint_score(m, s), list(chosen), union.copy()

    def step(stage: str, key) -> bool:
        nonlocal union
        options = [i for i in range(len(pool)) if i not in chosen]
        found = cover.added([rules[i] for i in chosen], [rules[i] for i in options])
        top = None
        for i, v in zip(options, found, strict=True):
            if (k := key(pool[i], v)) is not None and (top is None or k > top[0]):
                top = k, i, v
        if top is None:
            return False
        chosen.append(top[1])
        union = union + top[2]
        record(stage, top[1])
        return True

    def reached() -> bool:
        m = mix(union[VALID], whole)
        return m["coverage"] >= s.target and m["class23"] <= s.class23 and m["class3"] <= s.class3

    while len(chosen) < max_rules and step("primary", lambda c, v: _stage_key(s, c, v, union, whole, False)):
        pass
    while len(chosen) < max_rules and not reached() and step("fill", lambda c, v: _stage_key(s, c, v, union, whole, True)):
        pass
    for _ in range(repairs):
        if len(chosen) >= max_rules or reached() or not step("repair", lambda c, v: _repair_key(s, c, v, union, whole)):
            break
    m = mix(union[VALID], whole)
    if best is not None and not (within_caps(m, s) and m["coverage"] >= mix(best[2][VALID], whole)["coverage"]):
        _, chosen, union = best[0], list(best[1]), best[2]
        steps.append(("rollback", -1, *(mix(union[VALID], whole)[k] for k in ("class2", "class3", "class23"))))
    for _ in range(exchanges):
        now = mix(union[VALID], whole)
        held = checkpoint_score(now, s) if safe(now, s) else -math.inf
        top = None
        for out in chosen:
            rest = [i for i in chosen if i != out]
            base = cover.union([rules[i] for i in rest])
            options = [i for i in range(len(pool)) if i not in chosen]
            for i, v in zip(options, cover.added([rules[j] for j in rest], [rules[i] for i in options]), strict=True):
                m = mix((base + v)[VALID], whole)
                if safe(m, s) and checkpoint_score(m, s) > max(held, top[0] if top else -math.inf):
                    top = checkpoint_score(m, s), [*rest, i], base + v, i
        if top is None:
            break
        chosen, union = top[1], top[2]
        record("exchange", top[3])
    train, valid = (mix(union[k], cover.whole[k]) for k in (TRAIN, VALID))
    return AvoidResult(s.name, tuple(rules[i] for i in chosen), train, valid, result_score(valid, s), tuple(steps))


def quality(m: dict) -> float:
    # Rate and coverage against lost rows of classes 2 and 3.
    return m["rate"] * 1000 + m["coverage"] * 650 - m["class23"] * 900 - m["class3"] * 1350 + math.log1p(m["n"]) * 8


#: Bounds of (coverage, rate, class 2 and 3, class 3), from the best result down.
AVOID_TIERS = ((0.05, 0.68, 0.08, 0.03), (0.048, 0.68, 0.08, 0.03), (0.05, 0.63, 0.12, 0.045), (0.04, 0.63, 0.1, 0.035), (0.04, 0.63, 0.12, 0.04), (0.0, 0.63, 0.12, 0.04))


def chosen_avoid(results: list[AvoidResult], options: list[AvoidScenario]) -> int | None:
    """The result of the best tier, then one that meets its scenario, then the best quality."""
    if not results:
        return None
    by = {s.name: s for s in options}
    met = lambda r: r.valid["coverage"] >= by[r.scenario].acceptable and within_caps(r.valid, by[r.scenario])
    # The least that is of use.
    useful = lambda r: r.valid["coverage"] >= 0.035 and r.valid["class23"] <= 0.16 and r.valid["class3"] <= 0.06
    tiers = [lambda r, t=t: r.valid["coverage"] >= t[0] and r.valid["rate"] >= t[1] and r.valid["class23"] <= t[2] and r.valid["class3"] <= t[3] for t in AVOID_TIERS]
    for fits in (*tiers, met, useful, lambda r: True):
        if good := [i for i, r in enumerate(results) if fits(r)]:
            return max(good, key=lambda i: (quality(results[i].valid), -i))
    return None


# -- rules that pick positives, joined for coverage --------------------------------------------------------


@dataclass(frozen=True)
class Pool:
    """What a broad rule must reach on valid rows, and what a step must add there."""

    # Fixed values; rows and positives that are added, in the primary stage and in the fill.
    count: int = 80
    rate_up: float = -0.005
    lift: float = 0.985
    wilson: float = 0.28
    gap: float = 0.9
    added: tuple[int, int] = (20, 10)
    added_hits: tuple[int, int] = (8, 4)
    slack: float = 0.015
    beyond: float = 1.05


@dataclass(frozen=True)
class GoodScenario:
    """Precision and coverage aimed at, the least precision of what a rule adds, and weights.
    A target precision of 0 only asks for about the base rate."""

    name: str
    target: float
    floor: float
    cover: float
    soft_cover: float
    added_primary: float
    added_fill: float
    hit_w: float
    row_w: float
    cover_w: float
    rate_w: float
    miss_penalty: float
    under_penalty: float


def good_facts(v: np.ndarray, whole: np.ndarray) -> dict[str, float]:
    """n, hits, rate, lift, coverage and Wilson bound of (false, true) rows."""
    n, hits = int(v.sum()), int(v[1])
    base = rate(int(whole.sum()), int(whole[1]))
    r = rate(n, hits)
    return {"n": n, "hits": hits, "rate": r, "lift": r / base if base else 0.0, "coverage": rate(int(whole[1]), hits), "wilson": max(0.0, lcb(hits, n)) if n else 0.0}


def good_candidates(cover: Coverage, mined: list[Mined], pool: Pool = Pool()) -> list[tuple[int, float]]:
    """(rule, stable score) of the mined rules that the pool lets in, in the order of mining."""
    base = rate(int(cover.whole[VALID].sum()), int(cover.whole[VALID][1]))
    out = []
    for i, v in enumerate(cover.added([], list(range(len(cover.rules))))):
        tr, va = (good_facts(v[k], cover.whole[k]) for k in (TRAIN, VALID))
        gap = tr["rate"] - va["rate"]
        if va["n"] >= pool.count and va["rate"] - base >= pool.rate_up and va["lift"] >= pool.lift and va["wilson"] >= pool.wilson and gap <= pool.gap:
            # What a rate above the base, rows and a gap are worth.
            out.append((i, mined[i].score * (1 + max(0.0, va["rate"] - base) * 5) * (1 + math.log1p(va["n"]) / 8) * (1 - min(max(0.0, gap), 0.85))))
    return out


def _under(s: GoodScenario, r: float) -> float:
    return (max(0.0, s.target - r) + max(0.0, s.floor - r) * 3) * s.under_penalty if s.target > 0 else 0.0


def good_score(m: dict, s: GoodScenario, base: float) -> float:
    """What a union is worth. Bonuses for coverage and for 1,000, 3,000 and 8,000 rows."""
    score = m["hits"] * s.hit_w + m["n"] * s.row_w + m["coverage"] * s.cover_w + m["rate"] * s.rate_w + max(m["rate"] - base, 0.0) * 350 - (m["n"] - m["hits"]) * s.miss_penalty - _under(s, m["rate"])
    score += 15_000 * (m["coverage"] >= s.soft_cover) + 30_000 * (m["coverage"] >= s.cover)
    return score + 5_000 * (m["n"] >= 1_000) + 10_000 * (m["n"] >= 3_000) + 20_000 * (m["n"] >= 8_000)


def _good_key(s: GoodScenario, pool: Pool, v: np.ndarray, union: np.ndarray, whole: np.ndarray, base: float, stable: float, fill: bool) -> tuple | None:
    n, hits = int(v[VALID].sum()), int(v[VALID][1])
    if n < max(pool.added[fill], 1) or hits < pool.added_hits[fill] or hits / n < (s.added_fill if fill else s.added_primary):
        return None
    m = good_facts(union[VALID] + v[VALID], whole)
    if m["rate"] < (s.floor if s.target > 0 else max(0.0, base - pool.slack)) or (fill and m["coverage"] >= s.cover * pool.beyond):
        return None
    # The weights of an addition that no scenario sets.
    score = hits * s.hit_w + n * s.row_w + m["coverage"] * s.cover_w + m["rate"] * s.rate_w + max(m["rate"] - base, 0.0) * 250 + int(v[TRAIN][1]) * 0.15 - (n - hits) * s.miss_penalty + stable * 0.02 - _under(s, m["rate"])
    return score, m["coverage"], m["rate"], hits, n, stable


def good_scenario(cover: Coverage, candidates_: list[tuple[int, float]], s: GoodScenario, pool: Pool = Pool(), max_rules: int = 200) -> dict:
    """Primary additions, then smaller ones until coverage is reached; the best union on the way is taken,
    the earliest of equal ones. Of equal keys the candidate that comes first is added."""
    whole = cover.whole[VALID]
    base = rate(int(whole.sum()), int(whole[1]))
    chosen: list[int] = []
    union = np.zeros((2, cover.classes), np.int64)
    best = (-math.inf, 0, union, "none")
    for stage in ("primary", "fill"):
        while len(chosen) < max_rules:
            if stage == "fill" and good_facts(union[VALID], whole)["coverage"] >= s.cover:
                break
            options = [i for i in range(len(candidates_)) if i not in chosen]
            found = cover.added([candidates_[i][0] for i in chosen], [candidates_[i][0] for i in options])
            top = None
            for i, v in zip(options, found, strict=True):
                key = _good_key(s, pool, v, union, whole, base, candidates_[i][1], stage == "fill")
                if key is not None and (top is None or key > top[0]):
                    top = key, i, v
            if top is None:
                break
            chosen.append(top[1])
            union = union + top[2]
            score = good_score(good_facts(union[VALID], whole), s, base)
            if score > best[0]:
                best = score, len(chosen), union, stage
    score, size, union, stage = best
    facts = [good_facts(union[k], cover.whole[k]) for k in (TRAIN, VALID)]
    return {"name": s.name, "members": [candidates_[i][0] for i in chosen[:size]], "stage": stage, "score": score if size else -1e18, "train": facts[0], "valid": facts[1], "tried": len(chosen)}


def chosen_good(results: list[dict], least: float = 0.78, rows: int = 500) -> int | None:
    """The widest of the results that are precise enough on enough rows, else the one with the best score."""
    if not results:
        return None
    precise = [i for i, r in enumerate(results) if r["valid"]["rate"] >= least and r["valid"]["n"] >= rows]
    return max(precise, key=lambda i: (results[i]["valid"]["coverage"], -i)) if precise else max(range(len(results)), key=lambda i: (results[i]["score"], -i))
