"""The pipeline against plain Python; the language operator's accuracy and cases."""

import hashlib
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests_llm_helpers import brute_components, brute_contamination, brute_fingerprint, brute_secrets, close_pairs, tiktoken_encoding
from tidemark.llm import langid, registry, secrets


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return registry.table(spark, sf_dir, "documents")


def test_pipeline_equals_plain_python(spark, sf_dir, documents):
    rows = {r.doc_id: r.text for r in documents.collect()}
    lang = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(documents).collect()}
    kept = sorted(i for i in rows if lang[i][0] != "und" and lang[i][1] >= 0.3)
    fps = [brute_fingerprint(rows[i]) for i in kept]
    comp = brute_components(range(len(kept)), close_pairs(fps))
    kept = [i for k, i in enumerate(kept) if comp[k] == k]
    items = [(r.item_id, r.text) for r in registry.table(spark, sf_dir, "benchmark").collect()]
    kept = [i for i, c in zip(kept, brute_contamination([rows[i] for i in kept], items), strict=True) if not c[4]]
    enc = tiktoken_encoding()
    want = {}
    for i in kept:
        text, at, parts = rows[i], 0, []
        spans = [tuple(map(int, s.split(":")[1:])) for s in brute_secrets(text)[4].split(",") if s]
        for a, b in spans:
            if a >= at:
                parts += [text[at:a], "[secret]"]
            at = max(at, b)
        text = "".join([*parts, text[at:]])
        ids = enc.encode_ordinary(text)
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r[0]: tuple(r)[1:] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and len(want) < len(rows)


def test_stages_keep_the_columns(spark, sf_dir, documents):
    odd = documents.limit(0).unionByName(spark.createDataFrame([(None, "and the words of the text", None, None, None), (5, None, "en", "s", 0), (6, "", None, "s", 0), (7, "the same the same", "fr", "s", 1), (7, "the same the same", "fr", "s", 1), (8, "the same the same", "en", "t", 1), (9, "key password=abcdefghijkl", "en", "t", 3)], documents.schema))
    docs = documents.unionByName(odd)
    clashing = docs.selectExpr("*", "1 AS row", "'x' AS spans", "2 AS fp", "3 AS number", "4 AS items", "'y' AS lang_pred", "5 AS n_words")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, clashing = stage(spark, docs, sf_dir), stage(spark, clashing, sf_dir)
        assert docs.schema.simpleString() == documents.schema.simpleString()
    assert sorted(map(str, clashing.select(*documents.columns).collect())) == sorted(map(str, docs.collect()))
    assert clashing.select("row", "spans", "fp", "number", "items", "lang_pred", "n_words").distinct().collect() == [(1, "x", 2, 3, 4, "y", 5)]
    got = docs.where("doc_id is null or (doc_id between 5 and 9 and length(text) < 60)").collect()
    assert sorted(((r.doc_id, r.text) for r in got if r.text in ("and the words of the text", "the same the same", "key [secret]")), key=str) == [(7, "the same the same"), (9, "key [secret]"), (None, "and the words of the text")]
    empty = documents.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_language_accuracy_and_cases(spark, documents):
    got = {r.doc_id: r for r in langid.identify(documents).collect()}
    lang = {r.doc_id: r.lang for r in documents.collect()}
    held = [i for i in lang if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in got if got[i].held_out} == set(held)
    assert np.mean([got[i].lang_pred == lang[i] for i in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values())
    rows = [(1, None), (2, ""), (3, "123 !? 456"), (None, "the and of the with"), (4, "x" * 300000), (5, "é")]
    odd = spark.createDataFrame([(i, t, None, "n") for i, t in rows], "doc_id long, text string, lang string, lang_pred string")
    out = {r.doc_id: r for r in langid.identify(odd, langid.learn(documents)).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and out[None].lang_pred == "en" and out[None].held_out is False
    assert out[4].lang_pred != "und" and out[5].lang_pred != "und"
    assert {r.lang_pred for r in langid.identify(odd).collect()} == {"und"}


def test_entropy_leaves_plain_documents_alone(spark, documents):
    found = secrets.find(documents)
    more = found.where("exists(spans, s -> s.ord >= 3) and not exists(base, s -> true)").count()
    assert more <= 0.02 * documents.count()


def test_network_is_the_stated_convolution():
    """Prediction by tables of pairs against filters slid over each window, and gradients against differences."""
    rng = np.random.default_rng(5)
    net = langid.Net(["a", "b", "c"], seed=3)
    net.params["bias"][:] = rng.normal(0, 0.5, net.params["bias"].shape)
    p = net.params

    def direct(window):
        tops = []
        for w in langid.WIDTHS:
            h = [sum(p[f"w{w}.{j}"][window[i + j]].astype("f8") for j in range(w)) for i in range(langid.WINDOW)]
            tops.append(np.max(h, 0))
        z = np.maximum(np.concatenate(tops) + p["bias"], 0) @ p["out"].astype("f8") + p["last"]
        e = np.exp(z - z.max())
        return e / e.sum()

    for text in ("short", "é" * 64, "x" * 128, "word and " * 70, "z" * 127, "y" * 129):
        data = text.encode()
        n = -(-(len(data) + langid.PAD) // langid.WINDOW)
        whole = np.zeros(n * langid.WINDOW + langid.PAD, np.uint8)
        whole[: len(data)] = np.frombuffer(data, np.uint8)
        probs = [direct(whole[k * langid.WINDOW : (k + 1) * langid.WINDOW + langid.PAD]) for k in range(n)]
        assert np.allclose(net.compiled().windows(whole, n), probs, atol=1e-5)
        weights = [min(langid.WINDOW, max(0, len(data) - k * langid.WINDOW)) for k in range(n)]
        mean = np.average(probs, 0, weights)
        ((lang, score),) = net.compiled().predict([text])
        assert lang == net.langs[int(mean.argmax())] and abs(score - mean.max()) < 1e-5

    net.params = p = {k: v.astype("f8") for k, v in p.items()}
    x, y = rng.integers(97, 123, (6, langid.WINDOW + langid.PAD)).astype(np.uint8), rng.integers(0, 3, 6)
    loss = lambda: -np.mean([np.log(direct(row)[k]) for row, k in zip(x, y, strict=True)])
    for name, g in net.step(x, y).items():
        for at in np.argsort(-np.abs(g).ravel())[:3]:
            flat, h = p[name].reshape(-1), 1e-6
            old = flat[at]
            flat[at] = old + h
            up = loss()
            flat[at] = old - h
            down = loss()
            flat[at] = old
            assert abs((up - down) / (2 * h) - g.ravel()[at]) < 1e-4


def test_training_windows_cover_whole_texts(spark):
    """Each window has the same chance, far ones of long texts too; the sample keeps to its bound and repeats."""
    assert list(langid.drawn(5, 1.0, 0.9, 1)) == [0, 1, 2, 3, 4] and list(langid.drawn(0, 0.5, 0.1, 1)) == []
    hits = np.zeros(40)
    for i in range(4000):
        for k in langid.drawn(40, 0.1, (i + 0.5) / 4000, i):
            hits[k] += 1
    assert np.all(np.abs(hits - 400) < 100)
    long = "".join(f"{i:08d}" for i in range(16 * 3000))
    rows = [(8, long, "n", "xx"), (3, long, "n", "xx"), (11, "", "n", "xx"), (12, None, "n", "xx"), (7, "tail", None, "xx"), (9, "bb " * 50, "m", "yy"), (10, "q", "und", "zz")]
    keep = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, key string")
    x, y, langs = langid.training_windows(d, 200)
    assert langs == sorted({r[2] for r in keep if r[2] not in (None, "und") and r[1]}) and np.bincount(y).max() <= 200
    starts = [int(bytes(w[:8])) // 16 for w, k in zip(x, y, strict=True) if langs[k] == "n"]
    assert len(starts) == len(set(starts)) == 200 and min(starts) < 300 and max(starts) > 2700
    again = langid.training_windows(d.repartition(3), 200)
    assert np.array_equal(x, again[0]) and np.array_equal(y, again[1])
    assert langid.identify(d.where("false")).count() == 0
