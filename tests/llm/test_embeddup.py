"""Embedding links and classes against all cosines."""

import numpy as np

from tidemark.llm import embeddup, registry


def brute(rows):
    ok = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n = len(rows)
    link = np.zeros((n, n), bool)
    for d in {len(v) for _, v in rows if ok(v)}:
        at = [i for i, (_, v) in enumerate(rows) if ok(v) and len(v) == d]
        x = np.array([rows[i][1] for i in at], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        link[np.ix_(at, at)] = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    label = list(range(n))
    moved = True
    while moved:
        moved = False
        for a, b in np.argwhere(link):
            if label[b] > label[a]:
                label[b], moved = label[a], True
    out = []
    for i, (vec_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None]
        comp = min(ids, default=None)
        out.append((vec_id, int(link[i].sum()), comp, vec_id == comp))
    return sorted(out, key=str)


def run(spark, rows, block):
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<float>, n_links long")
    return sorted((tuple(r) for r in embeddup.near_duplicates(df, block=block).collect()), key=str)


def test_links_equal_all_cosines(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(150)]
    centre = rng.normal(size=16)
    rows += [(200 + i, (centre + rng.normal(size=16) * rng.choice([0.02, 0.2, 0.4])).tolist()) for i in range(250)]
    rows += [(500 + i, rows[3][1]) for i in range(40)] + [(3, rows[3][1]), (None, rows[3][1]), (None, rows[200][1])]
    rows += [(600, None), (601, []), (602, [0.0] * 16), (603, [float("nan")] * 16), (604, [1.0] * 15 + [float("inf")]), (605, [None] + [1.0] * 15), (606, (centre * 1e30).tolist()), (607, (centre * 1e-30).tolist()), (608, [1.0, 2.0]), (609, [2.0, 4.0]), (None, None)]
    want = brute(rows)
    for block in (16, 1024):
        assert run(spark, rows, block) == want
    assert max(w[1] for w in want) > 40 and run(spark, [], 16) == []


def test_on_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in registry.table(spark, sf_dir, "embeddings").collect()]
    assert run(spark, rows, 64) == brute(rows)
