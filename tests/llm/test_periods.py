"""Runs against plain comparison at every lag, whole texts and in ranges of lags."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import periods, registry


def brute_runs(w, least=24, times=3):
    n, out = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha(listed), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def random_words(rng):
    w = [rng.randint(0, rng.choice([0, 1, 3, 50])) for _ in range(rng.randint(0, 200))]
    if rng.random() < 0.6 and w:
        a = rng.randrange(len(w))
        p = 1 + (len(w) - a) // rng.randint(3, 10)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    return w


@pytest.mark.parametrize("least,times", [(24, 3), (4, 2), (1, 2), (10, 4)])
def test_scan_equals_plain_comparison(least, times):
    rng = random.Random(least)
    for _ in range(120):
        docs = [random_words(rng) for _ in range(rng.randint(1, 8))]
        assert periods.scan([np.array(d, np.int32) for d in docs], least, times) == [brute_runs(d, least, times) for d in docs]


def test_ranges_of_lags_find_all_runs_together():
    rng = random.Random(5)
    for _ in range(100):
        w = random_words(rng)
        found = {}
        for lo in range(1, len(w), 7):
            for s, n, q in periods.scan([np.array(w, np.int32)], lags=(lo, lo + 7))[0]:
                found[s, n] = min(q, found.get((s, n), q))
        assert sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2])) == brute_runs(w)


ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "a " * 24), (6, "a " * 23), (7, "a b c " * 9 + "d"), (8, "x " + "a b " * 12 + "y " + "a b " * 12), (None, "q r " * 30),
    (9, "é ü \x0b\x0c w " * 10), (10, "same text " * 40), (10, "same text " * 40), (11, "\U0001f600 \x00 z " * 9), (12, " ".join(f"w{i % 2000}" for i in range(7000))),
]


@pytest.mark.parametrize("long", [1 << 16, 100])
def test_odd_texts(spark, long):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"runs": F.lit(1), "_text": F.lit("x"), "start": F.lit(2), "_key": F.lit("k")})
    got = periods.digests(periods.find(periods.planted(docs), long=long)).collect()
    order = lambda r: str(r)
    assert sorted(map(tuple, got), key=order) == sorted((brute_row(*r) for r in ODD), key=order)


def test_query_equals_plain_version(spark, sf_dir):
    docs = registry.table(spark, sf_dir, "documents")
    want = sorted(brute_row(r.doc_id, r.text) for r in docs.collect())
    assert sorted(map(tuple, registry.QUERIES["op11_periodic_runs"](spark, sf_dir).collect())) == want
    by_ranges = periods.digests(periods.find(periods.planted(docs), long=4000))
    assert sorted(map(tuple, by_ranges.collect())) == want
    assert sum(r[1] > 0 for r in want) > 10


def test_carried_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a " * 30, "x")], "doc_id int, text string, source string")
    (row,) = periods.find(docs, carry=("source",)).collect()
    assert (row.doc_id, row.source, row.n_words, [tuple(r) for r in row.runs], row.collapsed) == (1, "x", 30, [(0, 30, 1)], "a")
    assert periods.find(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periods.find(docs.withColumn("runs", F.lit(1)), carry=("runs",))
