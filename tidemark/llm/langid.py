"""Language identification by a byte convolutional network, trained in numpy.

A text's bytes are cut into windows of 128. Filters of widths 2, 3 and 4 slide over
each window (one table of weights per filter offset and byte), their largest value
in the window goes through a rectifier, and a softmax over the learned languages
follows; a text's distribution is the mean over all its windows, weighted by bytes.

Training takes a bounded sample, ``per_lang`` windows of each language: every window of
every labelled row that isn't held out has the same chance, wherever it stands in its
text. Chances are drawn from hashes of the doc_id and the text; texts without a drawn
window stay in the JVM, and only drawn windows come to the driver. Predictions read the
text alone.

Defined cases: null texts and texts without letters are ``und`` with score 0, and so
is everything if there is nothing to learn from, an empty table included (which gives no
rows); a null doc_id isn't held out; rows with a null lang are predicted, not learned
from; repeated rows are kept; texts of any length are read whole; of languages with equal
sums the one first in the alphabet wins; of the documents only doc_id, text and lang are
read, other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices_of, small_batches

WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 16
PAD = max(WIDTHS) - 1
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}").search


def held_out():
    """Rows that training never sees: crc32 of the doc_id as text leaves 1 by 3."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


class Net:
    """weights[w][j]: (256, FILTERS) for filters of width w at offset j."""

    def __init__(self, langs: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.params = {f"w{w}.{j}": rng.normal(0, 0.3, (256, FILTERS)).astype("f4") for w in WIDTHS for j in range(w)}
        n = FILTERS * len(WIDTHS)
        self.params |= {"bias": np.zeros(n, "f4"), "out": rng.normal(0, n**-0.5, (n, len(langs))).astype("f4"), "last": np.zeros(len(langs), "f4")}

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients for windows x (n, WINDOW + PAD) of labels y."""
        p, n = self.params, len(x)
        tops, where = [], []
        for w in WIDTHS:
            h = sum(p[f"w{w}.{j}"][x[:, j : j + WINDOW]] for j in range(w))
            where.append(h.argmax(1))
            tops.append(h.max(1))
        z = np.concatenate(tops, 1) + p["bias"]
        a = np.maximum(z, 0)
        logits = a @ p["out"] + p["last"]
        e = np.exp(logits - logits.max(1, keepdims=True))
        d = e / e.sum(1, keepdims=True)
        d[np.arange(n), y] -= 1
        d /= n
        g = {"out": a.T @ d, "last": d.sum(0)}
        dz = (d @ p["out"].T) * (z > 0)
        g["bias"] = dz.sum(0)
        rows, f = np.arange(n)[:, None], np.arange(FILTERS)
        for k, w in enumerate(WIDTHS):
            part = dz[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(w):
                at = x[rows, where[k] + j].astype(np.int64) * FILTERS + f
                g[f"w{w}.{j}"] = np.bincount(at.ravel(), part.ravel(), 256 * FILTERS).reshape(256, FILTERS).astype("f4")
        return g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 192, rate: float = 0.01, seed: int = 1) -> None:
        """Adam over random windows; half of each batch is cut to a random part, as short texts are."""
        rng, p = np.random.default_rng(seed), self.params
        m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
        for t in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            rows = x[pick]
            for i in range(batch // 2):
                n = int(rng.integers(6, WINDOW))
                at = int(rng.integers(0, WINDOW - n + 1))
                part = rows[i, at : at + n].copy()
                rows[i] = 0
                rows[i, :n] = part
            for k, g in self.step(rows, y[pick]).items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                p[k] -= (rate * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype("f4")

    def compiled(self) -> Compiled:
        return Compiled(self.params, self.langs)


class Compiled:
    """For prediction: tables over pairs of bytes, one gather for all first pairs."""

    def __init__(self, p: dict[str, np.ndarray], langs: list[str]):
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(1 << 16, FILTERS)
        self.first = np.concatenate([pair(p[f"w{w}.0"], p[f"w{w}.1"]) for w in WIDTHS], 1)
        self.third = p["w3.2"]
        self.second = pair(p["w4.2"], p["w4.3"])
        self.bias, self.out, self.last, self.langs = p["bias"], p["out"], p["last"], langs

    def windows(self, data: np.ndarray, n: int) -> np.ndarray:
        """Distributions of n windows; data holds n * WINDOW + PAD bytes."""
        probs = np.empty((n, len(self.langs)), "f4")
        for i in range(0, n, 256):
            k = min(256, n - i)
            part = data[i * WINDOW : (i + k) * WINDOW + PAD]
            pairs = part[:-1].astype(np.int32) << 8 | part[1:]
            size = k * WINDOW
            h = self.first.take(pairs[:size], 0)
            h[:, FILTERS : 2 * FILTERS] += self.third.take(part[2 : size + 2], 0)
            h[:, 2 * FILTERS :] += self.second.take(pairs[2 : size + 2], 0)
            h = h.reshape(k, WINDOW, -1)
            while h.shape[1] > 1:
                half = h.shape[1] // 2
                h = np.maximum(h[:, :half], h[:, half:])
            logits = np.maximum(h[:, 0] + self.bias, 0) @ self.out + self.last
            e = np.exp(logits - logits.max(1, keepdims=True))
            probs[i : i + k] = e / e.sum(1, keepdims=True)
        return probs

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        kept = [(i, t.encode()) for i, t in enumerate(texts) if t and _LETTER(t)]
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not kept or not self.langs:
            return out
        counts = [-(-(len(b) + PAD) // WINDOW) for _, b in kept]
        n = sum(counts)
        data, weight = np.zeros(n * WINDOW + PAD, np.uint8), np.full(n, float(WINDOW), "f8")
        at = 0
        for (_, b), c in zip(kept, counts, strict=True):
            data[at * WINDOW : at * WINDOW + len(b)] = np.frombuffer(b, np.uint8)
            weight[at + c - 1] = max(0, len(b) - (c - 1) * WINDOW)
            at += c
        probs = self.windows(data, n) * weight[:, None]
        sums = np.add.reduceat(probs, np.concatenate(([0], np.cumsum(counts)[:-1])), 0)
        best, total = sums.argmax(1), sums.sum(1)
        for (i, _), k, s, t in zip(kept, best, sums, total, strict=True):
            out[i] = (self.langs[k], float(min(1.0, s[k] / t)))
        return out


def drawn(n: int, p: float, u: float, seed: int):
    """Which of n windows are drawn, each with chance p: gaps between draws are geometric, the first one is that of ``u``."""
    if p >= 1:
        yield from range(n)
        return
    rng, gap = np.random.default_rng(seed), lambda u: np.floor(np.log1p(-u) / np.log1p(-p))
    k = gap(u)
    while k < n:
        yield int(k)
        k += 1 + gap(rng.random())


def training_windows(docs: DataFrame, per_lang: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Up to per_lang windows of each language, with their labels: those with the smallest hashes of twice as many drawn."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang").where(F.col("lang").isNotNull() & (F.octet_length("text") > 0) & ~held_out())
    rows = rows.select("doc_id", "text", "lang", F.ceil(F.octet_length("text") / F.lit(WINDOW)).alias("n"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(x for x in counts if x != UNKNOWN)
    if not langs:
        return np.empty((0, WINDOW + PAD), np.uint8), np.empty(0, np.int64), []
    chance = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, 1.5 * per_lang / counts[k]))]), F.col("lang"))
    key = F.xxhash64("doc_id", F.lit("sample"), "text")
    unit = F.shiftrightunsigned(key, 11) / F.lit(float(1 << 53))
    some = rows.where(F.col("lang").isin(langs)).select("lang", "text", key.alias("key"), unit.alias("u"), chance.alias("p"), "n")
    picked = some.where(F.col("u") < 1 - F.pow(1 - F.col("p"), F.col("n")))

    def cut(batches):
        for b in batches:
            out = ([], [], [])
            for lang, text, key, u, p, n in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                data = text.encode()
                for k in drawn(n, p, u, key % (1 << 64)):
                    for x, v in zip(out, (lang, key, data[k * WINDOW : (k + 1) * WINDOW + PAD]), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["lang", "key", "part"])

    found = small_batches(picked).mapInArrow(cut, "lang string, key long, part binary")
    found = found.select("lang", F.xxhash64("key", "part").alias("u"), "part").orderBy("u", "lang", "part").limit(2 * per_lang * len(langs)).collect()
    x, y, used = [], [], dict.fromkeys(langs, 0)
    for r in found:
        if used[r.lang] < per_lang:
            used[r.lang] += 1
            x.append(np.frombuffer(bytes(r.part).ljust(WINDOW + PAD, b"\0"), np.uint8))
            y.append(langs.index(r.lang))
    return (np.stack(x) if x else np.empty((0, WINDOW + PAD), np.uint8)), np.array(y, np.int64), langs


def learn(docs: DataFrame, per_lang: int = 4800) -> Net:
    x, y, langs = training_windows(docs, per_lang)
    net = Net(langs if len(x) else [])
    if len(x):
        net.train(x, y)
    return net


def identify(docs: DataFrame, net: Net | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; the net is learned from docs if none is given."""
    params, langs = (lambda n: (n.params, n.langs))(net or learn(docs))

    def run(batches):
        model = Compiled(params, langs)
        for batch in batches:
            for b in slices_of(batch, 2):
                found = model.predict(b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, net: Net | None = None, least: float = 0.3) -> DataFrame:
    """The rows of docs, all columns as they are, whose text has a language: not ``und`` and a score of ``least``."""
    params, langs = (lambda n: (n.params, n.langs))(net or learn(docs))
    at = docs.columns.index("text")

    def run(batches):
        model = Compiled(params, langs)
        for batch in batches:
            for b in slices_of(batch, at):
                yield b.filter(pa.array([x != UNKNOWN and s >= least for x, s in model.predict(b.column(at).to_pylist())], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
