"""Packed pieces cover every example once, keep all limits and need little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import packing, registry
from tidemark.llm.packing import Examples, Limits, Packer


def packed(examples, limits):
    held, out = Examples(), []
    packer = Packer(limits, held)
    for i, (n, mask) in enumerate(examples):
        held.add(i, i, np.arange(n), mask)
        out += packer.add(i)
    return out + list(packer.finish())


def padding(lengths, most):
    return sum(most - n for n in lengths if n & (n - 1))


@pytest.mark.parametrize("limits", [Limits(), Limits(64, 5, 40, 32, 4), Limits(100, 3, 100, 16, 1), Limits(1, 1, 1, 1, 1), Limits(4096, 512, 1000)])
def test_limits_hold_and_every_token_lies_once(limits):
    rng = random.Random(limits.tokens)
    for masked in (False, True):
        sizes = [rng.choice([1, 2, rng.randint(1, limits.tokens), rng.randint(1, 3 * limits.tokens)]) for _ in range(300)]
        examples = [(n, np.array([rng.random() < 0.6 for _ in range(n)]) if masked else None) for n in sizes]
        taken, lengths = defaultdict(list), []
        for sequence in packed(examples, limits):
            lengths.append(sum(p.length for p in sequence))
            loss = sum(int(examples[p.example][1][p.start : p.start + p.length].sum()) if masked else p.length for p in sequence)
            assert 0 < lengths[-1] <= limits.tokens and len(sequence) <= limits.segments and loss <= limits.loss
            assert loss == sum(p.loss for p in sequence)
            for p in sequence:
                taken[p.example].append((p.start, p.length))
        for i, n in enumerate(sizes):
            at = 0
            for start, length in sorted(taken[i]):
                assert start == at and length > 0
                at += length
            assert at == n
        assert padding(lengths, limits.tokens) <= (limits.least - 1) * len(lengths)


def test_dot_product_choice():
    """With few segments left and many tokens, long pieces are taken; the other way round, short ones."""
    long_first = packed([(50, None), (8, None), (8, None), (50, None)], Limits(100, 2, 100, 8, 4))
    assert [p.example for p in long_first[0]] in ([0, 3], [3, 0])


def test_masks_bound_what_bears_loss(spark):
    ids = np.arange(300, dtype="<u4").tobytes()
    rows = [(i, ids, (b"\x01" * 100 + b"\x00" * 200) if i % 2 else None, "x") for i in range(20)] + [(None, b"", b"", "x"), (None, None, None, "x")]
    df = spark.createDataFrame(rows, "example long, ids binary, mask binary, start string")
    got = packing.pack(df, "example", mask_col="mask", limits=Limits(1024, 4, 512, 8, 8)).collect()
    loss, size = defaultdict(int), defaultdict(int)
    for r in got:
        if r.example is not None:
            assert r.ids == ids[4 * r.start : 4 * (r.start + r.length)] and r.example_tokens == 300
            loss[r.sequence_id] += max(0, min(100, r.start + r.length) - r.start) if r.example % 2 else r.length
        size[r.sequence_id] += r.length
    assert max(loss.values()) <= 512 and max(size.values()) <= 1024
    assert sum(r.example is None and r.length == 0 for r in got) == 2
    with pytest.raises(Exception, match="a byte for each token"):
        packing.pack(spark.createDataFrame([(1, ids, b"\x01")], "example long, ids binary, mask binary"), "example", mask_col="mask").collect()


def checked(rows, docs):
    """Padded share, after comparing all rows with each text's own encoding."""
    tok = Tokenizer.from_file(registry.tokenizer_path(registry.WORD_TOKENIZER))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(docs)
    for doc_id, texts in docs.items():
        want = sorted(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for t in texts)
        if len(texts) > 1:  # repeated rows: their pieces together
            assert sum(p.length for p in pieces[doc_id]) == sum(len(w) // 4 for w in want)
            continue
        at = 0
        for p in sorted(pieces[doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want[0]) // 4 and p.ids_crc32 == zlib.crc32(want[0][4 * at : 4 * (at + p.length)])
            at += p.length
        assert at == len(want[0]) // 4
    lengths = []
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        lengths.append(at)
        assert 0 < at <= 4096
    return padding(lengths, 4096) / sum(lengths)


def test_query_against_each_texts_own_encoding(spark, sf_dir):
    docs = {r.doc_id: [r.text] for r in registry.table(spark, sf_dir, "documents").collect()}
    assert checked(registry.QUERIES["op13_packing"](spark, sf_dir).collect(), docs) < 0.005


def test_odd_texts(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "word " * 30_000), (4, "a"), (4, "a"), (None, "no id"), (5, "\x00 é <|endoftext|> \n")] + [(i, "x") for i in range(100, 400)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_id": F.lit(1), "ids": F.lit(2), "offset": F.lit(3)}).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    docs = defaultdict(list)
    for k, t in rows:
        docs[k].append(t)
    assert checked(registry.QUERIES["op13_packing"](spark, str(tmp_path)).collect(), docs) < 0.01
    assert packing.pack_texts(spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0), registry.tokenizer_path(registry.WORD_TOKENIZER), 2).collect() == []


def test_nothing_is_shuffled(spark, sf_dir):
    assert "Exchange" not in registry.QUERIES["op13_packing"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
