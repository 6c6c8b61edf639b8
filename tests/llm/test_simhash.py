"""Fingerprints, links and components against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tests_llm_helpers import brute_components, brute_fingerprint, close_pairs
from tidemark.llm import registry, simhash
from tidemark.llm.components import components


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(i, i + 1) for i in range(500, 620)] + [(1000, 1000), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [e for e in edges if None not in e and e[0] != e[1]]
    assert got == brute_components({n for e in real for n in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_of_clouds_and_strays(spark):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 1 << 62))
    fps = {centre, 0, (1 << 64) - 1, 1 << 63}
    for _ in range(700):  # a cloud in which keys hold far more than ``most``
        fps.add(centre ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 4))}))
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 300)}
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    for most in (8, 100_000):
        edges = [(r.a, r.b) for r in simhash.links(spark.createDataFrame(signed, "fp long"), most).collect()]
        assert all((a ^ b).bit_count() <= 2 or ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2 for a, b in edges)
        want = brute_components([f[0] for f in signed], [(signed[i][0], signed[j][0]) for i, j in close_pairs(fps)])
        got = brute_components([f[0] for f in signed], edges)
        assert got == want


def test_only_entries_under_shared_keys_are_shuffled_again(spark):
    rng = np.random.default_rng(2)
    fps = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 2000)]
    fps += [f ^ 5 for f in fps[:50]] + [f ^ (1 << 40) for f in fps[50:100]] + [0, -1, -2, -(1 << 63)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(3)
    every = df.select("fp", F.explode(simhash._keys()).alias("key")).select("fp", "key.slot", "key.value")
    keys = every.groupBy("slot", "value").count().where("count > 1").select("slot", "value").cache()
    want = {tuple(r) for r in every.join(keys, ["slot", "value"]).select("fp", "slot", "value").collect()}
    for bits in (26, 12):
        got = [tuple(r) for r in simhash._entries_among(df, keys, bits).collect()]
        assert want and want <= set(got) and len(got) == len(set(got)) and (bits == 12 or len(got) < 1.1 * len(want))
    assert simhash._entries_among(df, keys.where("slot < 0")).count() == 0


def test_near_duplicates_on_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text, "x") for r in registry.table(spark, sf_dir, "documents").collect()]
    long = next(t for _, t, _ in rows if len(t) > 3000)
    rows += [(9001, None, "x"), (9002, "", "x"), (9003, " \t\n", "x"), (9004, long + " Tail", "x"), (9004, long + " Tail", "x"), (9005, "ONE two", "x"), (9006, "one\x0btwo", "x"), (9007, "one two", "x")]
    docs = spark.createDataFrame([*rows, (None, "one two", "x")], "doc_id long, text string, fp string")
    got = {}
    for r in simhash.near_duplicates(docs).withColumn("hex", simhash.hex16()).collect():
        got.setdefault(r.doc_id, (r.hex, r.component_id))
    fps = {i: brute_fingerprint(t) for i, t, _ in rows}
    ids = sorted(fps)
    want = brute_components(ids, [(ids[i], ids[j]) for i, j in close_pairs([fps[i] for i in ids])])
    assert {i: got[i] for i in ids} == {i: (f"{fps[i]:016x}", want[i]) for i in ids}
    assert got[None][1] == 9005 and got[9003] == (16 * "0", 9001)
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_rows_kept_do_not_depend_on_the_broadcast_bound(spark, sf_dir):
    docs = registry.table(spark, sf_dir, "documents").unionByName(registry.table(spark, sf_dir, "documents").limit(5))
    got = [sorted((r.doc_id, r.n_chars) for r in simhash.one_of_each(docs, most_broadcast=most).collect()) for most in (0, 1000)]
    comp = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got[0] == got[1] and [i for i, _ in got[0]] == sorted({c for c in comp.values()})
